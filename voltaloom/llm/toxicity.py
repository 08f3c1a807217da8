"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding: compatibility decomposition, accents dropped, lower case, homoglyphs and digits or signs that stand for letters mapped to one
letter of each look-alike class (l, 1, | and ! become i), everything that is no letter to a space.

The lexicon is learned: whole words and word beginnings (stems of STEM letters) whose share of documents differs most between
toxic and other labelled documents, weighted by their log odds. Exception phrases (a term with a neighbour) are learned from
neighbours with which a term occurs in documents that are not toxic; they cancel the hit. More of both can be given.
A logistic curve over the weighted hits, their share of the words (normalisation by length) and the number of different terms gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaloom.llm.common import materialize, small

# Look-alike characters and the letter that stands for their class.
HOMOGLYPHS = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
#: Lengths of the word beginnings that may become entries.
STEM = (4, 5, 6, 7)
#: Labelled rows for fitting at most. This bounds the lexicon too: an entry or exception stands in five of them at least.
MAX_ROWS = 40_000

_SIGN = re.compile(r"[!|@$](?=\w)|(?<=\w)[!|@$](?=\w)")
_OTHER = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Words of folded text, a space before and after each."""
    t = unicodedata.normalize("NFKD", text).lower() if not text.isascii() else text.lower()
    if not t.isascii():
        t = "".join(c for c in t if not unicodedata.combining(c))
    return f" {_OTHER.sub(' ', _SIGN.sub(lambda m: HOMOGLYPHS[m.group()], t).translate(_FOLD)).strip()} "


_FOLD = str.maketrans({k: v for k, v in HOMOGLYPHS.items() if k not in "!|@$"})


@dataclass
class Lexicon:
    """terms: folded entry (" word " or " stem") to weight; exceptions: folded phrases whose terms do not count; curve: of the score."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (-3.0, 0.5, 0.5, 0.5)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            a.add_word(term, (term, len(term), weight))
        for phrase in self.exceptions:
            a.add_word(phrase, (phrase, len(phrase), None))
        a.make_automaton()
        return a

    def hits(self, folded: str, automaton) -> list[tuple[int, str, float]]:
        """(place of the word, term, weight) of the best term of each word that no exception phrase covers."""
        if not len(automaton):
            return []
        best, spared = {}, []
        for end, (term, n, weight) in automaton.iter(folded):
            start = end - n + 1
            if weight is None:
                spared.append((start, end))
            elif start not in best or best[start][1] < weight:
                best[start] = (term, weight)
        for lo, hi in spared:
            for at in [x for x in best if lo <= x < hi]:
                del best[at]
        return [(at, *x) for at, x in sorted(best.items())]

    def features(self, folded: str, automaton) -> tuple[float, float, float]:
        found = self.hits(folded, automaton)
        total, words = sum(w for *_, w in found), max(1, folded.count(" ") - 1)
        return math.log1p(total), math.log1p(100 * total / (words + 20)), math.log1p(len({t for _, t, _ in found}))

    def score(self, folded: str, automaton) -> float:
        z = self.curve[0] + sum(c * x for c, x in zip(self.curve[1:], self.features(folded, automaton), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _terms(words: set[str]) -> set[str]:
    out = {f" {w} " for w in words if len(w) > 2}
    out.update(f" {w[:n]}" for w in words for n in STEM if len(w) > n)
    return out


def _count_terms(batches):
    for batch in small(batches, 4096):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            seen[label].update(_terms(set(fold(text or "").split())))
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[k][n] for n in names], pa.int64()) for k in (1, 0))], ["term", "pos", "neg"])


def _count_phrases(terms: dict[str, float]):
    lexicon = Lexicon(terms)

    def run(batches):
        automaton = lexicon.automaton()
        for batch in small(batches, 4096):
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                t, phrases = fold(text or ""), set()
                for at, _, _ in lexicon.hits(t, automaton):
                    end = t.find(" ", at + 1)
                    before, after = t.rfind(" ", 0, at), t.find(" ", end + 1)
                    if at > 0 and before >= 0:
                        phrases.add(t[before : end + 1])
                    if after > 0:
                        phrases.add(t[at : after + 1])
                seen[label].update(phrases)
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[k][n] for n in names], pa.int64()) for k in (1, 0))], ["term", "pos", "neg"])

    return run


def _features(lexicon: Lexicon):
    def run(batches):
        a = lexicon.automaton()
        for batch in small(batches):
            rows = [lexicon.features(fold(t or ""), a) for t in batch.column("text").to_pylist()]
            cols = [pa.array([r[k] for r in rows], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, batch.column("label")], ["x", "y", "z", "label"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        h = x.T @ (x * w[:, None]) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def learn(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Fit a lexicon on at most max_rows rows of labels (doc_id, label 0 or 1), those first by a hash of doc_id.

    Rows of labels without doc_id or label are left out; of repeated doc_ids the largest label and the first text in order count. Without
    labelled documents, or with one label only, the lexicon is empty and every score is low.
    """
    sample = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")  # the sample has max_rows rows of 12 bytes at most
    rows = materialize(rows, "tox-train")
    size = {int(r.label): r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, [], (-3.0, 0.0, 0.0, 0.0))
    c = rows.mapInArrow(_count_terms, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    c = c.where("pos >= 5").withColumn("lift", F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (n0 + 1))).where("lift > 1.5")
    c = c.withColumn("z", (F.col("pos") - (F.col("pos") + F.col("neg")) * (n1 / (n0 + n1))) / F.sqrt((F.col("pos") + F.col("neg")) * (n1 / (n0 + n1)))).where("z > 6")
    top = c.select("term", "lift").collect()
    terms: dict[str, float] = {}
    for r in sorted(top, key=lambda r: (len(r.term), r.term)):
        shorter = [terms[r.term[:n]] for n in range(STEM[0] + 1, len(r.term)) if r.term[:n] in terms]
        if not shorter or max(shorter) < r.lift - 0.7:
            terms[r.term] = float(r.lift)
    p = rows.mapInArrow(_count_phrases(terms), "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    learned = [r.term for r in p.where("neg >= 5 and pos * 10 <= neg").orderBy("term").collect()]
    lexicon = Lexicon(terms, learned + [fold(x) for x in exceptions])
    got = rows.mapInArrow(_features(lexicon), "x double, y double, z double, label int").collect()  # max_rows rows at most
    m = np.array([tuple(r) for r in got], float)
    lexicon.curve = _logistic(m[:, :3], m[:, 3])
    return lexicon


def _score(lexicon: Lexicon):
    def run(batches):
        a = lexicon.automaton()
        for batch in small(batches):
            k = batch.schema.get_field_index("text")
            scores, hits = [], []
            for t in batch.column(k).to_pylist():
                f = fold(t or "")
                scores.append(lexicon.score(f, a))
                hits.append(len(lexicon.hits(f, a)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(hits, pa.int64())], [*batch.schema.names, "score", "n_hits"])

    return run


def score_toxicity(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of documents with score (0 to 1) and n_hits of the whole text; null and empty texts score as texts without hits.

    Columns of documents named score or n_hits are replaced.
    """
    names = [c for c in documents.columns if c not in ("score", "n_hits")]
    docs = documents.select(*names).withColumn("text", F.col("text").cast("string"))
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + ["score double", "n_hits long"]
    return docs.mapInArrow(_score(lexicon), ", ".join(fields))
