"""Edited copies of an item are found however many documents hold them."""

import random

import pytest

from voltaloom.llm import decontaminate

WORDS = [f"w{i}" for i in range(400)]


@pytest.mark.parametrize("copies", [10, 11, 1000])
def test_edited_copy_in_many_documents(spark, copies):
    rng = random.Random(17)
    item = [rng.choice(WORDS) for _ in range(30)]
    edited = list(item)
    edited[8] = edited[20] = "changed"
    rows = [(i, " ".join([*rng.choices(WORDS, k=20), *edited, *rng.choices(WORDS, k=9)])) for i in range(copies)]
    rows += [(5000 + i, " ".join([*rng.choices(WORDS, k=30), *item[:4], *rng.choices(WORDS, k=30)])) for i in range(40)]  # a phrase alone is no leak
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.score, r.first_word, r.last_word) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(got) == set(range(copies))
    assert all(score >= 54 / 60 and first <= 20 and last >= 49 for score, first, last in got.values())
