"""The automaton's hits against plain search, and learning from repeated and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from voltaloom.llm import toxicity

WORDS = "bad badly worse ugly uglier nice not so very the a good badge".split()


def plain_hits(lexicon, folded):
    best, spared = {}, []
    for term, weight in lexicon.terms.items():
        for at in range(len(folded)):
            if folded.startswith(term, at) and (at not in best or weight > best[at][1]):
                best[at] = (term, weight)
    for phrase in lexicon.exceptions:  # its last space begins the next word
        spared += [(at, at + len(phrase) - 1) for at in range(len(folded)) if folded.startswith(phrase, at)]
    return [(at, *x) for at, x in sorted(best.items()) if not any(lo <= at < hi for lo, hi in spared)]


@pytest.mark.parametrize("seed", range(20))
def test_hits_equal_plain_search(seed):
    rng = random.Random(seed)
    terms = {f" {w}{rng.choice([' ', ''])}": rng.uniform(1, 4) for w in rng.sample(WORDS, 6)}
    lexicon = toxicity.Lexicon(terms, [toxicity.fold(" ".join(rng.sample(WORDS, 2))) for _ in range(3)])
    automaton = lexicon.automaton()
    for n in (0, 1, 5, 200):
        t = toxicity.fold(" ".join(rng.choice(WORDS) for _ in range(n)))
        assert lexicon.hits(t, automaton) == plain_hits(lexicon, t)


def test_folding():
    assert toxicity.fold("B4D  b@d bàd ЬAD вad") == toxicity.fold("bad bad bad ьad bad")
    assert toxicity.fold("") == "  " and toxicity.fold("!!!") == "  "


def test_repeated_documents_count_once_and_odd_tables(spark):
    rows = [(k, f"plain words here {k} " + ("vileword" if k % 3 == 0 else "")) for k in range(90)]
    docs = spark.createDataFrame(rows + [(0, "vileword other")] * 50 + [(None, "vileword"), (500, None)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)] + [(None, 1), (3, None), (500, 0)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    scored = {(r.doc_id, r.text): r.score for r in toxicity.score_toxicity(docs, lexicon).collect()}
    assert min(scored[k, t] for k, t in rows if k % 3 == 0) > max(scored[k, t] for k, t in rows if k % 3)
    assert 0 <= scored[500, None] < 0.7
    none = toxicity.learn(docs.limit(0), labels)
    assert not none.terms and toxicity.score_toxicity(docs.limit(0), none).count() == 0
