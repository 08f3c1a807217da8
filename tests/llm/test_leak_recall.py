"""No alignment of the threshold is missed, whatever the kind of change: against the alignment of each item with the whole document."""

import random
import time

import numpy as np
import pytest

from voltaloom.llm import decontaminate as D

VOCABULARY = [f"w{i}" for i in range(300)]


def word(rng):
    return VOCABULARY[min(299, int(rng.paretovariate(0.6)) - 1)]  # few words make up most of a text


def changed(item, kind, rng):
    w = list(item)
    if kind == "random":
        for i in rng.sample(range(len(w)), len(w) // 4):
            w[i] = "other"
    elif kind.startswith("every"):
        for i in range(2, len(w), int(kind[5:])):
            w[i] = "other"
    elif kind.startswith("insert"):
        w = [x for i, y in enumerate(w) for x in ([y, "more"] if i % int(kind[6:]) == 0 else [y])]
    elif kind == "delete":
        w = [x for i, x in enumerate(w) if i % 4]
    elif kind == "swap":
        for i in range(0, len(w) - 1, 4):
            w[i], w[i + 1] = w[i + 1], w[i]
    elif kind == "cut":
        w = w[: max(1, int(len(w) * 0.6))]
    return w


KINDS = ["whole", "random", "every4", "every3", "insert3", "insert2", "delete", "swap", "cut"]


@pytest.mark.parametrize("length", [4, 7, 8, 12, 40, 200])
def test_all_kinds_of_change(length):
    rng = random.Random(length)
    texts = [[word(rng) for _ in range(length)] for _ in range(30)]
    items = D.Items([(k, " ".join(t)) for k, t in enumerate(texts)], D.THRESHOLD)
    wanted = found = 0
    for kind in KINDS:
        for _ in range(8):
            k = rng.randrange(30)
            doc = [*[word(rng) for _ in range(rng.randrange(60))], *changed(texts[k], kind, rng), *[word(rng) for _ in range(rng.randrange(60))]]
            got = {x[0]: x[1] for x in D.leaks(items, doc, {})}
            h = items.numbers(doc)
            for item in range(30):
                score = D.align(items.words[item], h)[0]
                if score >= items.threshold[item]:
                    wanted += 1
                    found += abs(got.get(item, 0) - score) < 1e-9
                else:
                    assert item not in got
    assert found == wanted and wanted >= (len(KINDS) * 8 * 0.7 if length >= 12 else 8)


def test_ten_thousand_items_of_one_template():
    """Items that share an instruction line: a document with that line alone is compared with none of them."""
    rng = random.Random(9)
    line = [f"t{i}" for i in range(12)]
    items = D.Items([(k, " ".join([*line, *[f"u{rng.randrange(5000)}" for _ in range(18)]])) for k in range(10_000)], D.THRESHOLD)
    doc = [*line, *[f"u{rng.randrange(5000)}" for _ in range(300)]]
    began = time.process_time()
    for _ in range(20):
        assert D.leaks(items, doc, {}) == []
    assert time.process_time() - began < 20
    leaked = [*doc, *[x for x in VOCABULARY[:5]], *[w for w in [next(a for a, b in items.vocabulary.items() if b == n) for n in items.words[77].tolist()]]]
    assert 77 in {x[0] for x in D.leaks(items, leaked, {})}


def test_ties_go_to_the_first_place_and_each_item_is_told():
    items = D.Items([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x y"), (4, "")])
    doc = "q a b c d e f g h q q q q q q q q q q q q q q q q a b c d e f g h".split()
    assert [(x[0], x[1], x[2], x[3]) for x in D.leaks(items, doc, {})] == [(1, 1.0, 1, 8), (2, 1.0, 1, 8)]
    assert D.leaks(items, [], {}) == [] and D.leaks(D.Items([]), doc, {}) == [] and np.array_equal(items.ids, [1, 2])
