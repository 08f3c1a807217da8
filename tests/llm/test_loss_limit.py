"""A limit of loss-bearing tokens that binds holds in every sequence."""

from pyspark.sql import functions as F

from voltaloom.llm import packing
from voltaloom.llm.queries import tokenizer


def test_loss_limit_binds(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(60)), i % 2) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, answer int").coalesce(1)
    path = tokenizer("word_bpe_49k.json")
    out = packing.pack_documents(docs, path, loss_tokens=F.when(F.col("answer") == 0, 0), loss=512).toPandas()
    whole = packing.pack_documents(docs, path, loss=512).toPandas()
    bear = out[out.doc_id % 2 == 1].groupby("sequence_id").length.sum()
    assert bear.max() <= 512 and bear.max() > 256
    size = out.groupby("sequence_id").length.sum()
    assert size.max() > 512 >= whole.groupby("sequence_id").length.sum().max()  # documents without loss fill what the limit leaves
    for frame in (out, whole):
        assert (frame.groupby("doc_id").length.sum() == frame.groupby("doc_id").doc_tokens.first()).all() and frame.doc_id.nunique() == 120
