"""Passages of 51 to 56 words are found however short their lines are."""

import random

import pytest

from voltaloom.llm import line_chunks


def passages(rng, per):
    for g in range(60):
        n = rng.randint(51, 56)
        words = [f"g{g}p{k}" for k in range(n)]
        yield "\n".join(" ".join(words[k : k + per]) for k in range(0, n, per))


@pytest.mark.parametrize("per", [1, 2, 3, 4, 5, 6, 7, 8, 11, 24])
def test_any_passage_holds_a_whole_chunk(per):
    rng = random.Random(per)
    for p in [x for _ in range(10) for x in passages(rng, per)]:
        p = p.replace("p", f"q{rng.random()}")
        sides = [["\n".join(" ".join(f"{rng.random()}" for _ in range(8)) for _ in range(3)) for _ in range(2)] for _ in range(2)]
        a, b = ({c[0] for c in line_chunks.chunks(f"{x}\n{p}\n{y}".encode())} for x, y in sides)
        assert a & b


@pytest.mark.parametrize("per", [1, 3, 5, 8])
def test_passages_of_short_lines_are_removed_whole(spark, per):
    rng = random.Random(100 + per)
    line = lambda n: " ".join(f"r{rng.randrange(1 << 40)}" for _ in range(n))
    rows, want = [], {}
    for g, p in enumerate(passages(rng, per)):
        for k in range(2):
            around = [line(rng.choice([1, 8])) for _ in range(8)]
            text = "\n".join([*around[:4], p, *around[4:]])
            rows.append((2 * g + k, text))
            want[2 * g + k] = "\n".join(around) if k else text
    got = {r.doc_id: r.text for r in line_chunks.remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
