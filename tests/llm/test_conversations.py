"""Conversations as examples whose loss-bearing tokens are limited, and tokens that cross the boundaries of sections."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from voltaloom.llm import packing, tokens
from voltaloom.llm.queries import tokenizer

SCHEMA = "conv_id long, turn int, role string, text string"


def rows(n=60):
    rng = random.Random(4)
    return [(c, t, "user" if t % 2 == 0 else "assistant", " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(60)))) for c in range(n) for t in range(rng.choice([1, 2, 7, 30]))]


def test_every_token_once_and_the_loss_limit_binds(spark):
    conv = rows()
    path = tokenizer("word_bpe_49k.json")
    df = spark.createDataFrame(conv, SCHEMA).repartition(1)
    got = packing.pack_conversations(df, path, turns=8, tokens=1024, loss=300).toPandas()
    t = Tokenizer.from_file(path)
    parts = {}
    for c, k, role, text in sorted(conv):
        parts.setdefault((c, k // 8), []).append((role, text))
    want = {}
    for key, turns in parts.items():
        ids = [*t.encode("\n".join(x for _, x in turns), add_special_tokens=False).ids, 2]
        size = sum(len(x) for _, x in turns)
        want[key] = ids, sum(len(x) for r, x in turns if r == "assistant") / size if size else 0.0
    assert set(zip(got.conv_id, got.part, strict=True)) == set(want)
    for key, frame in got.groupby(["conv_id", "part"]):
        ids, share = want[key]
        frame = frame.sort_values("start")
        assert frame.start.tolist() == [0, *np.cumsum(frame.length)[:-1]] and frame.length.sum() == len(ids) == frame.doc_tokens.iloc[0]
        assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for s, n, c in zip(frame.start, frame.length, frame.ids_crc32, strict=True))
        assert abs(frame.loss_share.iloc[0] - share) < 1e-12
    bear = (got.length * got.loss_share).groupby(got.sequence_id).sum()
    free = packing.pack_conversations(df, path, turns=8, tokens=1024).toPandas()
    assert bear.max() <= 301 and bear.max() > 200 and (free.length * free.loss_share).groupby(free.sequence_id).sum().max() > 301
    assert got.groupby("sequence_id").length.sum().max() <= 1024


def test_odd_conversations(spark):
    odd = [(1, 0, None, None), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (None, 0, "user", "alone"), (None, 0, "user", "alone"), (2, None, "assistant", "too"), (3, 70, "user", "")]
    got = packing.conversation_examples(spark.createDataFrame(odd, SCHEMA)).collect()
    assert sorted((r.conv_id or 0, r.part if r.part is not None else -1, r.text, r.loss_share) for r in got) == [(0, 0, "alone", 0.0), (0, 0, "alone", 0.0), (1, 0, "\na\na", 1.0), (2, -1, "too", 1.0), (3, 1, "", 0.0)]
    empty = packing.pack_conversations(spark.createDataFrame([], SCHEMA), tokenizer("word_bpe_49k.json"))
    assert empty.count() == 0 and "conv_id" in empty.columns


def test_attribution_against_counting_characters():
    """The section with most of a token's characters, the earlier of equals, one token at a time."""
    rng = random.Random(7)
    for _ in range(300):
        bounds = [0, *sorted(rng.sample(range(1, 60), rng.randrange(8))), 60]
        spans = [(a, min(60, a + rng.randrange(9))) for a in sorted(rng.randrange(60) for _ in range(25))]
        want = []
        for a, b in spans:
            inside = [len(range(max(a, lo), min(b, hi))) for lo, hi in zip(bounds, bounds[1:], strict=False)]
            at = next(k for k in range(len(bounds) - 1) if bounds[k] <= a < bounds[k + 1])
            want.append(inside.index(max(inside)) if b > a else at)
        got = tokens.attribute(np.array([a for a, _ in spans]), np.array([b for _, b in spans]), np.array(bounds)).tolist()
        assert got == want
    assert tokens.attribute(np.array([2]), np.array([6]), np.array([0, 4, 8])).tolist() == [0]  # two characters on either side


def test_sections_against_the_library(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices(["ab", " ", "\n", "\n\n", "é", "文", "12"], k=rng.randrange(40))) for _ in range(60)]
    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {}
    for r in tokens.section_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.start_char, r.end_char, r.n_tokens)
    for i, text in enumerate(texts):
        parts = text.split("\n")
        ends = np.cumsum([len(p) + 1 for p in parts])
        bounds = [0, *ends[:-1].tolist(), len(text)]
        n = [0] * len(parts)
        for a, b in t.encode(text, add_special_tokens=False).offsets:
            inside = [max(0, min(b, hi) - max(a, lo)) for lo, hi in zip(bounds, bounds[1:], strict=False)]
            own = [k for k in range(len(parts)) if bounds[k] <= a < bounds[k + 1]]
            n[inside.index(max(inside)) if max(inside) else own[-1] if own else len(parts) - 1] += 1
        assert [x[2] for _, x in sorted(got[i].items())] == n, text
