"""Joins on hot keys, repeated ids, ties and line dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaloom.llm import common, decontaminate, jaccard, line_chunks

WORDS = [f"w{i}" for i in range(500)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_join(spark, how):
    many = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.lit(5)).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    one = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    rows = lambda df: sorted(map(tuple, df.select("k", "v", "x").collect()), key=lambda r: r[1])
    assert rows(common.spread_join(many, one, ["k"], ["v"], how)) == rows(many.join(one, "k", how))


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, k) for k in range(1, 1500)] + [(k, k + 1) for k in range(2000, 2040)] + [(5000, 5001)]
    got = {r.id: r.component_id for r in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{k: 0 for k in range(1500)}, **{k: 2000 for k in range(2000, 2041)}, 5000: 5000, 5001: 5000}


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(1)
    a, b, c = (text(rng, 40) for _ in range(3))
    rows = [(1, a), (4, a), (4, b), (7, c), (7, c), (None, a), (9, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone_id", F.lit(1)).withColumn("key", F.lit("clash"))
    left = sorted(((r.doc_id or 0), r.text or "") for r in jaccard.one_per_class(docs).collect())
    assert left == sorted([(1, a), (4, b), (7, c), (7, c), (0, a), (9, ""), (9, "")])


def test_many_short_texts_against_brute_force(spark):
    rng = random.Random(8)
    hot = text(rng, 10).split()
    rows = [(k, " ".join([*hot, text(rng, 12)])) for k in range(10, 200)] + [(1, " ".join(hot[:9])), (2, " ".join(hot))]
    for k in range(300, 900):  # sets of a few frequent shingles only
        at = rng.randrange(4)
        rows.append((k, " ".join(hot[at : at + rng.randint(1, 10 - at)])))
    sets = {k: frozenset(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: find(k) for k in sets}


def test_contaminated_rows_by_their_own_text(spark):
    rng = random.Random(2)
    item, short = text(rng, 30), "who wrote this old book"
    rows = [(1, f"{text(rng, 20)} {item}"), (1, text(rng, 30)), (None, item), (None, text(rng, 9)), (2, None), (3, f"he asked {short} twice"), (4, "who wrote this old letter")]
    bench = spark.createDataFrame([(1, item), (2, short), (3, "too few words"), (1, None), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    assert sorted((r.doc_id or 0, r.text or "") for r in decontaminate.clean_documents(docs, bench).collect()) == sorted((i or 0, t or "") for i, t in (rows[1], rows[3], rows[4], rows[6]))
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == {(1, 1), (None, 1), (3, 2)}
    assert decontaminate.clean_documents(docs.limit(0), bench).count() == 0


def test_leaks_in_several_blocks_equal_one(spark, monkeypatch):
    rng = random.Random(3)
    items = [(k, text(rng, rng.randint(4, 40))) for k in range(40)]
    rows = [(k, f"{text(rng, 10)} {items[k % 40][1]} {text(rng, 5)}") for k in range(80)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 800)
    assert sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())) == one and len(one) >= 80


def plain_alignment(a, b):
    m, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1, j + 1] = max(0, m[i, j] + (2 if x == y else -1), m[i, j + 1] - 1, m[i + 1, j] - 1)
            best = max(best, m[i + 1, j + 1])
    return best / (2 * max(1, len(a)))


def test_alignment_equals_plain_tables():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 15))] for _ in range(2))
        score, first, last = decontaminate.align(np.array(a), np.array(b))
        assert score == plain_alignment(a, b)
        if score:
            assert plain_alignment(a, b[first : last + 1]) == score


@pytest.mark.parametrize("change", ["edit 0.05", "edit 0.1", "edit 0.2", "cut 0.6", "cut 0.8", "exact 1"])
def test_recall_of_edited_copies(change):
    """At least 95 of 100 items are found in a text that holds a changed version, in clean texts none. How often a version occurs doesn't matter: test_frequent_leaks.py."""
    rng, kind, share = random.Random(5), change.split()[0], float(change.split()[1])
    items = decontaminate.Items([(k, text(rng, 40)) for k in range(100)])
    names = {v: w for w, v in items.vocabulary.items()}
    found = 0
    for item, h in items.words.items():
        w = [names[int(x)] for x in h]
        if kind == "edit":
            for k in rng.sample(range(len(w)), round(share * len(w))):
                w[k] = rng.choice(WORDS)
        elif kind == "cut":
            w = w[: round(share * len(w))]
        doc = text(rng, 30).split() + w + text(rng, 30).split()
        found += any(x[0] == item for x in decontaminate.leaks(items, doc, {}))
    assert found >= 95
    assert not any(decontaminate.leaks(items, text(rng, 200).split(), {}) for _ in range(20))


def test_line_dedup_against_brute_force(spark):
    """Passages of whole lines between texts of their own: every later copy goes, all else stays."""
    rng = random.Random(6)
    passages = [[text(rng, rng.randint(3, 12)) for _ in range(12)] for _ in range(15)]
    rows = []
    for k in range(150):
        own = [[f"own{k} {text(rng, rng.randint(2, 30))} {k}" for _ in range(rng.randint(1, 4))] for _ in range(3)]
        p, q = rng.sample(range(15), 2)
        rows.append((k, [(own[0], None), (passages[p], p), (own[1], None), (passages[q], q), (own[2], None)]))
    seen, want = set(), {}
    for k, parts in rows:
        kept = [x for lines, p in parts if p is None or p not in seen for x in lines]
        seen.update(p for _, p in parts if p is not None)
        want[k] = "\n".join(kept)
    docs = spark.createDataFrame([(k, "\n".join(x for lines, _ in parts for x in lines)) for k, parts in rows], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in line_chunks.remove_repeated_chunks(docs.withColumn("cut_id", F.lit(1)).withColumn("cuts", F.lit(2)).withColumn("key", F.lit(3))).collect()}
    assert got == want


def test_line_dedup_of_repeated_rows_and_a_common_passage(spark):
    rng = random.Random(7)
    passage = "\n".join(text(rng, 9) for _ in range(8))
    rows = [(5, f"{passage}\nend"), (5, f"{passage}\nend"), (5, f"start\n{passage}"), (None, passage), (6, None), (7, "")] + [(10 + k, f"{passage}\nown line {k}") for k in range(1300)]
    got = Counter((r.doc_id, r.text) for r in line_chunks.remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert all(got[10 + k, f"own line {k}"] == 1 for k in range(1300)) and got[None, passage] == 1 and got[6, None] == 1 and got[7, ""] == 1
    whole = [t for (i, t), n in got.items() if i == 5 and passage in t]
    assert len(whole) == 1  # the one that stands first, in all its repeated rows
    assert got[5, "end"] + got[5, f"{passage}\nend"] == 2
