"""Rows that repeat doc_ids with equal, near and different texts, against brute force over the texts."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from voltaloom.llm import jaccard


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def classes(rows):
    """The class of each text: a number; texts without words or of rows without doc_id have none."""
    sets = {}
    for i, t in rows:
        if i is not None and shingles(t):
            sets.setdefault(shingles(t), set()).add(i)
    keys = list(sets)
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            both = len(keys[a] & keys[b])
            if 5 * both >= 4 * (len(keys[a]) + len(keys[b]) - both) and both:
                root[find(a)] = find(b)
    number = {k: find(x) for x, k in enumerate(keys)}
    least = {}
    for k, c in number.items():
        least[c] = min([*sets[k], least.get(c, 1 << 60)])
    return number, least


def table(seed):
    rng = random.Random(seed)
    bases = [[f"v{rng.randrange(90)}" for _ in range(rng.choice([3, 5, 9, 30, 45]))] for _ in range(40)]
    rows = []
    for _ in range(500):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [f"x{rng.randrange(30)}"]
        rows.append((rng.choice([None, *range(60)]) if rng.random() < 0.9 else rng.randrange(1000), rng.choice([None, ""]) if rng.random() < 0.05 else " ".join(w)))
    return rows + [(7, " ".join(bases[0]))] * 40


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_and_survivors(spark, seed):
    rows = table(seed)
    number, least = classes(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = Counter((i, len(shingles(t)), (least[number[shingles(t)]] if shingles(t) else i) if i is not None else None) for i, t in rows)
    got = jaccard.jaccard_classes(df)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want
    kept = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()]
    plain = [(i, t) for i, t in rows if i is None or not shingles(t)]
    assert Counter(r for r in kept if r[0] is None or not shingles(r[1])) == Counter(plain)
    judged = Counter(r for r in kept if r[0] is not None and shingles(r[1]))
    heads = Counter(number[shingles(t)] for _, t in judged)
    assert set(heads) == set(number.values()) and max(heads.values()) == 1  # one document of each class, and of every class one
    assert all(i == least[number[shingles(t)]] for i, t in judged)
    every = Counter(rows)
    assert all(n == every[r] for r, n in judged.items())


def test_no_unique_text_goes_with_its_doc_id(spark):
    base = [f"a{i}" for i in range(40)]
    other = [f"b{i}" for i in range(40)]
    rows = [(1, " ".join(base)), (4, " ".join([*base, "more"])), (4, " ".join(other)), (9, " ".join([*other, "more"]))]
    kept = jaccard.one_per_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == [rows[0], rows[2]]
    with pytest.raises(ValueError, match="50"):
        jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), percent=40)
