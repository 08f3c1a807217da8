"""Short near copies that stand in every Arrow batch, against brute force."""

from voltaloom.llm import jaccard


def test_short_near_copies_in_many_batches_link(spark):
    base = [f"b{i}" for i in range(8)]
    versions = [" ".join(base)] + [" ".join([*base, f"x{v}"]) for v in range(20)]  # each of the 20 shares 4 of 5 shingles with the first
    rows = [(k, versions[k % len(versions)]) for k in range(300 * len(versions))]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(len(versions)))
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(docs).collect()}
    finally:
        spark.conf.set(key, before)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in versions]
    assert all(5 * len(sets[0] & s) >= 4 * len(sets[0] | s) for s in sets)
    assert len(got) == len(rows) and set(got.values()) == {0}
