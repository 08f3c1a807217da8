import hashlib
import random
import re

from pyspark.sql import functions as F

from voltaloom.llm import infill

#: A unit's text, as a pattern.
PATTERNS = {"code points": r"(?s).", "words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]*[\x20\x09-\x0D]*", "lines": r"[^\n]*\n|[^\n]+"}


def units(text, unit):
    if unit == "words":  # white space at the start belongs to the first word
        found = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
        lead = text[: len(text) - len("".join(found))]
        if not lead:
            return found
        return [lead, *found]
    return [x for x in re.findall(PATTERNS[unit], text) if x]


def plainly(doc_id, text, unit):
    text = text or ""
    parts = units(text, unit)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(parts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, text, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, text, f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    alphabet = ["a", "b", " ", " ", "\n", "\t", "é", "文", "😀", "<", ">", "P", "S", "M"]
    found = ["".join(rng.choices(alphabet, k=rng.choice([0, 1, 2, 3, 7, 15, 16, 17, 60, 400]))) for _ in range(250)]
    return [*found, None, "", " ", "\n\n", "😀" * 50, "<<P", "a<P>b", "<M", "x" * 100_001, "文 " * 40_000, found[3], found[9]]


def test_every_unit_and_chunk_size_against_a_plain_version(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "a repeated id"), (3, "a repeated id"), (None, "without id " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for unit, chunk in (("code points", 16), ("words", 16), ("lines", infill.CHUNK)):
        made = infill.fill_in_middle(df, unit, chunk)
        got = sorted(map(tuple, made.collect()), key=repr)
        assert got == sorted((plainly(i, t, unit) for i, t in rows), key=repr), (unit, chunk)
        assert made.where(infill.restore(F.col("output"), F.col("form")) != F.col("text")).count() == 0


def test_forms_take_their_shares(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    n = dict(infill.fill_in_middle(df).groupBy("form").count().collect())
    assert abs(n["plain"] - 400) < 80 and abs(n["spm"] - 720) < 110 and abs(n["psm"] - 2880) < 140


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert infill.fill_in_middle(empty).count() == 0
    odd = spark.createDataFrame([(1, "abc", "x", 5, 7, 9)], "doc_id long, text string, cut string, n int, key int, h1 int")
    assert [tuple(r) for r in infill.fill_in_middle(odd, chunk=2).collect()] == [plainly(1, "abc", "code points")]


def test_many_rows_of_one_long_text(spark):
    text = "one long text of many copies, 文字 " * 3000
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    got = sorted(map(tuple, infill.fill_in_middle(df, chunk=1024).collect()))
    assert got == [plainly(i, text, "code points") for i in range(300)]
