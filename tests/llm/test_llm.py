"""Each operator against brute force or a round trip, and on odd tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaloom.llm import decontaminate, html_text, jaccard, licenses, line_chunks, packing, quality, simple8b, tokens, toxicity
from voltaloom.llm.queries import tokenizer

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c"), (4, "one"), (4, "one"), (5, "x " * 30_000), (6, "ñ é\r\n z\x0b|"), (7, "w1 w2 w3 w4 w5 w6")]
WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("host", F.lit("h"))


def corpus():
    rng = random.Random(3)
    rows = []
    for g in range(40):
        base = text(rng, rng.randint(8, 120)).split()
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((" ".join(w)))
    hot = text(rng, 90).split()
    for k in range(60):  # one large group, so that a bucket is searched in blocks
        w = list(hot)
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append(" ".join(w))
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(900, None), (901, ""), (902, "a b"), (903, "A  b")]


def test_jaccard_equals_brute_force(spark):
    rows = corpus()
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(frame(spark, rows)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_line_chunks_remove_later_copies_only(spark):
    rng = random.Random(5)
    passage = "\n".join(text(rng, 11) for _ in range(6))
    rows = [(i, "\n".join([text(rng, 30), passage, text(rng, 9)] if i % 2 else [text(rng, 20), text(rng, 15)])) for i in range(20)]
    got = {r.doc_id: r for r in line_chunks.remove_repeated_chunks(frame(spark, rows)).collect()}
    for i, t in rows:
        if i % 2 == 0 or i == 1:
            assert got[i].text == t and got[i].removed_lines == 0
        else:
            assert got[i].text == "\n".join([t.split("\n")[0], t.split("\n")[-1]]) and got[i].removed_lines == 6


def test_leaks_exact_and_edited(spark):
    rng = random.Random(7)
    items = [(k, text(rng, 30)) for k in range(5)]
    edited = items[1][1].split()
    for k in (4, 13, 22):
        edited[k] = "changed"
    rows = [(1, f"{text(rng, 50)} {items[0][1]} {text(rng, 20)}"), (2, f"{text(rng, 9)} {' '.join(edited)}"), (3, text(rng, 200)), *ODD]
    bench = spark.createDataFrame([*items, (9, None), (None, "x"), (8, "few words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, rows), bench).collect()}
    assert got == {(1, 0), (2, 1)}


def test_packing_holds_each_id_once_without_padding(spark):
    rng = random.Random(9)
    rows = [(100 + i, text(rng, rng.choice([1, 5, 300, 6000]))) for i in range(200)] + ODD
    enc = tokens.Encoder(tokenizer("word_bpe_49k.json"))
    out = packing.pack_documents(frame(spark, rows).coalesce(1), tokenizer("word_bpe_49k.json")).toPandas()
    size = out.groupby("sequence_id").length.sum()
    assert ((size == 4096) | (size & (size - 1) == 0)).all()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and len(g) <= packing.SEGMENTS
    for i, t in rows[:200]:
        ids = np.append(enc.encode([t])[0], 2).astype("<u4")
        g = out[out.doc_id == i].sort_values("start")
        assert g.length.sum() == len(ids) == g.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(g.start, g.length, g.ids_crc32))


@pytest.mark.parametrize("most", [1, 2, 300, 1 << 40, (1 << 64) - 1])
def test_simple8b_round_trip(most):
    rng = random.Random(most)
    for n in (0, 1, 4096, 9000):
        v = np.array([0 if rng.random() < 0.4 else rng.randint(0, most) for _ in range(n)], np.uint64)
        words, offsets = simple8b.pack(v)
        assert (simple8b.unpack(words, offsets, n) == v).all()


def test_token_files(spark):
    rows = [(i, t) for i, t in ODD if i != 4] + [(10 + i, f"text {i}, more.") for i in range(30)]
    docs, path = frame(spark, rows), tokenizer("byte_bpe_50k.json")
    folder = simple8b.token_folder(docs)
    got = {r.doc_id: r for r in simple8b.read_tokens(simple8b.write_tokens(docs, path, folder), folder).collect()}
    start, enc = 0, tokens.Encoder(path)
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.append(enc.encode([t or ""])[0], 2).astype("<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_whole_texts_ids(name):
    from tokenizers import Tokenizer

    enc, whole = tokens.Encoder(tokenizer(name)), Tokenizer.from_file(tokenizer(name))
    odd = ["a  b", "a\n b", " x  \n\n y ", "\x1ca \x85b\xa0c", "<|endoftext|> hi", "J̌ ̈x a.\nb. C.,", "a\n\n\nb c", "ab### c!? d_! x,%%% y&&&\nz", "don't. it's", "", " ", "\n\n###\n"]
    for t, ids, (a, b) in zip(odd, enc.encode(odd), enc.offsets(odd)):
        e = whole.encode(t, add_special_tokens=False)
        assert e.ids == ids.tolist() and e.offsets == list(zip(a.tolist(), b.tolist()))


def test_section_tokens_sum_and_fields(spark):
    got = tokens.section_tokens(frame(spark, ODD), tokenizer("byte_bpe_50k.json")).toPandas()
    assert (got.groupby(["doc_id", "doc_tokens"], dropna=False).n_tokens.sum().reset_index().query("doc_id not in [4]").eval("n_tokens - doc_tokens") == 0).all()
    f = spark.createDataFrame([(1, "ab cd", None), (2, None, "x")], "doc_id long, a string, b string")
    assert {r.field for r in tokens.field_tokens(f, "doc_id", ["a", "b"], tokenizer("byte_bpe_50k.json")).collect()} == {"a", "b"}
    assert tokens.attribute(np.array([0, 3, 5]), np.array([3, 6, 9]), np.array([0, 4, 9])).tolist() == [0, 1, 1]


def test_toxicity_learns_and_folds(spark):
    rng = random.Random(11)
    rows = [(i, text(rng, 40) + (" vileword nastyterm" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows[:300]] + [(None, 1)], "doc_id long, toxic int")
    lex = toxicity.learn(frame(spark, rows), labels)
    more = [(1000, text(rng, 30) + " V1lew0rd nа$tyterm"), *ODD]  # a Cyrillic letter among them
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(frame(spark, rows[300:] + more), lex).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i, _ in rows[300:]) and got[1000] >= 0.7 and got[2] < 0.7
    spared = toxicity.Lexicon(lex.terms, [toxicity.fold("vileword garden")], lex.curve)
    assert not spared.hits(toxicity.fold("a vileword garden"), spared.automaton())


def test_quality_counts_against_brute_force(spark):
    rng = random.Random(13)
    rows = [*((i, t) for i, t in ODD if i not in (4,)), *((20 + i, (text(rng, 12) + "\n") * rng.choice([1, 2, 3])) for i in range(10)), *((40 + i, text(rng, 50)) for i in range(30))]
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows), F.lit("h")).collect()}
    for i, t in rows:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x]
        at: dict = {}
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        n = len({k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)})
        assert (got[i].n_words, got[i].n_repeat_words) == (len(w), n)
        assert got[i].base_failed == (len(w) < 20 or 100 * n > 30 * len(w))


def test_main_text(spark):
    page = "<html><body><nav><ul><li>menu</ul></nav><header class=top>Site</header><div class='cookie-notice'>We use cookies</div><article><header><h1>Title &amp; more</h1></header><p>First <b>bold<br> text<p>Second<script>x()</script><p class='notice-legal'>Follow us on every page</p><div class=share>Share</div><section id=comments><p>me too</p></section></article><aside>side</aside><form>f</form><footer>foot</footer>"
    pages = [(i, f"http://a.example/{i}", page.replace("Second", f"Second {i}")) for i in range(10)] + [(90, None, None), (91, "x", ""), (None, "http://a.example/", "<p>bare")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for limit in (html_text.MAX_BROADCAST, 0):
        got = {r.page_id: r.text for r in html_text.main_texts(df, limit).collect()}
        assert got[3] == "Title & more\nFirst bold text\nSecond 3" or got[3].startswith("Title & more\nFirst bold text\nSecond 3")
        assert got[90] == "" and got[91] == "" and got[None] == "bare"


def test_license_inheritance(spark):
    rows = [(1, "r/a/LICENSE", "Released under the MIT License."), (2, "r/a/b/x.txt", "plain words only"), (3, "r/y.txt", "none"), (4, "r/a/z.txt", "words first\nLicensed under the Apache License, Version 2.0.\n" + "many other words here " * 9), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string")
    got = {r.doc_id: (r.license, r.how) for r in licenses.scan_licenses(df, F.col("p")).collect()}
    assert got == {1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: (None, "none"), 4: ("Apache-2.0", "header"), 5: (None, "none")}


def test_empty_tables_and_odd_rows(spark):
    path = tokenizer("byte_bpe_50k.json")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for rows in ([], ODD):
        docs = frame(spark, rows)
        lex = toxicity.learn(docs, labels)
        n = len(rows)
        assert toxicity.score_toxicity(docs, lex).count() == line_chunks.remove_repeated_chunks(docs).count() == jaccard.jaccard_classes(docs).count() == n
        assert quality.judge(docs, F.col("host")).count() == licenses.scan_licenses(docs, F.lit("a/b")).count() == n
        assert decontaminate.find_leaks(docs, bench).count() == 0
        assert packing.pack_documents(docs, path).select("doc_id").count() >= n
        folder = simple8b.token_folder(docs)
        assert simple8b.read_tokens(simple8b.write_tokens(docs, path, folder), folder).count() == n
        assert tokens.section_tokens(docs, path).count() >= n
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert corpus_pipeline.run(spark, d).count() > 0
