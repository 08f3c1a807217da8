import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from voltaloom.llm import weighted_samples as ws


def weights(text):
    return Counter(re.findall(r"[^\x20\x09-\x0D]+", text))


def similarity(a, b):
    a, b = weights(a), weights(b)
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def documents(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["文字", "é", "😀"]
    found = []
    for i in range(n):
        size = rng.choice([0, 1, 2, 5, 20, 60, 200])
        found.append((3 * i, rng.choice(["\n", " "]).join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=size))))
    return found


def plainly(rows):
    """doc_id, n_chars, edited text, its next text: rows without doc_id stand apart."""
    ordered = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: r[0])
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        yield i, len(t), t, t[: len(t) - half] + after[:half], after


def test_edited_texts_and_likeness_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(ws, "PART_ROWS", 20)
    rows = [*documents(160, 3), (1000, None), (1001, ""), (1002, "word " * 5000), (1003, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in ws.fingerprints(df).collect()}
    assert len(got) == len(rows)
    prints, far = {}, []
    for i, n, text, edited, after in plainly(rows):
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(frozenset(weights(text).items()), r["fingerprint"]) == r["fingerprint"]
        assert prints.setdefault(frozenset(weights(edited).items()), r["edited_fingerprint"]) == r["edited_fingerprint"]
        far += [r["near_edited"] - similarity(text, edited), r["near_next"] - similarity(text, after)]
    assert abs(sum(far) / len(far)) < 0.03  # all texts share the draws of 43 words, so errors do not cancel out as they do below
    assert (sum(x * x for x in far) / len(far)) ** 0.5 < 0.1  # the spread of 32 samples


def test_samples_collide_as_often_as_weights_agree(spark):
    sets = [({1: 1.0, 2: 3.0, 3: 0.5}, {1: 2.0, 2: 3.0, 4: 0.25}), ({7: 10.0}, {7: 1.0}), ({7: 100.0, 8: 1.0}, {7: 90.0, 8: 5.0}), ({1: 1.0}, {2: 1.0}), ({k: 1.0 for k in range(100)}, {k: 1.0 for k in range(50, 150)})]
    rows = [(s, t, a.get(t, 0.0), b.get(t, 0.0)) for s, (a, b) in enumerate(sets) for t in {**a, **b}]
    df = spark.createDataFrame(rows, "s long, term long, a double, b double").withColumn("term", F.xxhash64("term"))
    got = ws.least_samples(df, ["s"], ["a", "b"], 4000).select("s", ws.likeness(F.col("a"), F.col("b"))).collect()
    for s, near in got:
        a, b = sets[s]
        true = sum(min(a.get(t, 0), b.get(t, 0)) for t in {**a, **b}) / sum(max(a.get(t, 0), b.get(t, 0)) for t in {**a, **b})
        assert abs(near - true) < 4 * (true * (1 - true) / 4000) ** 0.5 + 1e-9, (s, near, true)


def test_repeated_and_missing_ids_and_extra_columns(spark):
    rows = [(1, "a b c d", 9), (1, "a b c d", 9), (1, "other words", 9), (2, "x y z", 9), (None, "x y z", 9), (None, None, 9)]
    got = ws.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, part int")).collect()
    assert len(got) == 6
    by = Counter((r["doc_id"], r["fingerprint"]) for r in got)
    assert sorted(by.values()) == [1, 1, 1, 1, 2]
    loose = [r for r in got if r["doc_id"] is None]
    assert sorted((r["n_chars"], r["near_next"]) for r in loose) == [(0, 1.0), (5, 0.0)]
    assert {r["edited_sha256"] for r in loose} == {hashlib.sha256(x).hexdigest() for x in (b"x y", b"")}
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 5}) == 1


def test_one_row_and_none(spark):
    one = ws.fingerprints(spark.createDataFrame([(5, "all alone here")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["near_next"]) for r in one] == [(5, 1.0)]
    assert ws.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_and_few_shuffles(spark):
    plan = ws.fingerprints(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning(part") == 4  # the texts' twice, the second one reused when it runs, and both sides of the last join
