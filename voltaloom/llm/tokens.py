"""Token ids of whole texts with the tokenizers library, and attribution of tokens to parts of a text.

The ids and spans are those of the library's plain call on the whole text, without added special tokens. A text is cut only where no
pre-token of the tokenizer can reach across, and each distinct piece is encoded by the library once while a cache of bounded size holds it. Texts that hold a special
token's string or a separator control character, and all tokenizers of other kinds, are encoded whole. A test compares all this with the library on odd texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaloom.llm.common import small

#: Pieces that each generation of a cache holds at most.
CACHE = 1_000_000

#: White space in Python, but not in the tokenizers; and what marks keys.
_CONTROL = re.compile("[\x00\x1c-\x1f]")
#: Runs of white space that the byte-level pre-tokenizer keeps together.
_RUN = re.compile(r"\s\s\s|\s\s\Z")
#: Pieces of any text: all but the last of a run of white space before a word; a word with the one before; a run at the end.
_PIECE = re.compile(r"\s+(?=\s\S)|\s?\S+|\s+")
_PLAIN = re.compile(r" ?\S+")
_MARKS = "([!-&(-/:-@\\[-`{-~]*)"
#: Pieces of one or two pre-tokens: letters (or, in byte-level tokenizers, digits) and the ASCII marks that end them.
_SIMPLE = {"byte": re.compile("( ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+))" + _MARKS), "word": re.compile("([a-z]+)" + _MARKS)}
#: Byte-level letters: printable Latin-1 characters stand for themselves, the others for those from U+0100 on, in order.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 0x100 + k for k, b in enumerate(sorted(set(range(256)).difference(_SHOWN)))}
_COMBINING = re.compile("[̀-ͯ]")
_encoders: dict[str, Encoder] = {}


class Memo(dict):
    """What make gives for a key, kept in two generations: keys still in use pass on to the new one."""

    def __init__(self, make, limit: int = CACHE):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    def __init__(self, path: str):
        os.environ["RAYON_NUM_THREADS"] = "1"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        kinds = [x["type"] for x in norm.get("normalizers", [])]
        split = (pre.get("pretokenizers") or [{}])[0]
        self.special = [x["content"].lower() for x in spec["added_tokens"]]
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not norm:
            self.kind = "byte"
        elif kinds == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and "\\s" in split["pattern"]["Regex"]:
            self.kind = "word"
        self.dtype = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() < 1 << 16 else np.uint32)
        self.feed = np.array(self.raw("\n"), self.dtype).tobytes()
        self.ids, self.spans = Memo(self.piece_ids), Memo(self.piece_spans)

    def raw(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def whole(self, text: str) -> bool:
        """Whether a text is not to be cut."""
        if self.kind == "whole" or _CONTROL.search(text):
            return True
        low = text.lower() if any(s[:2] in text for s in self.special) else ""
        return any(s in low for s in self.special)

    def cut(self, text: str) -> list[str]:
        """Keys of the pieces of a text: each stands for what `piece` tells of it."""
        if self.kind == "word":  # white space is dropped; fewer distinct pieces in lower case
            if text.isascii() or not _COMBINING.search(text):
                text = text.encode().lower().decode()  # A-Z only
            return text.replace("\n", " ").split(" ")
        if _RUN.search("\n" + text):
            return [p[1:] if p[0] == " " and p[1:2] > " " else "\x00" + p for p in _PIECE.findall(text)]
        return ("\x00" + text.replace("\n", " \n")).split(" ")

    def piece(self, key: str) -> str:
        """White space before a word belongs to it: keys leave out a space; with a NUL before them they leave out nothing."""
        return key if self.kind == "word" or key[:1] == "\n" else key[1:] if key[:1] == "\x00" else " " + key

    def tokens(self, piece: str) -> list | None:
        """Tokens of the library's model for a piece that is known to be one or two pre-tokens."""
        m = _SIMPLE[self.kind].fullmatch(piece)
        if m is None:
            return None
        word, marks = m.groups()
        if self.kind == "byte":
            word = word.replace(" ", "\u0120") if piece.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        tokenize = self.tokenizer.model.tokenize
        return tokenize(word) + tokenize(marks) if marks else tokenize(word)

    def piece_ids(self, key: str) -> bytes:
        if key[:1] == "\n" and _PLAIN.fullmatch(key, 1) and key[1] != " " and self.kind == "byte":  # the line feed is a pre-token
            return self.feed + self.ids["\x00" + key[1:]]
        piece = self.piece(key)
        tokens = self.tokens(piece)
        return np.array(self.raw(piece) if tokens is None else [t.id for t in tokens], self.dtype).tobytes()

    def piece_spans(self, key: str) -> tuple[bytes, bytes, int]:
        piece = self.piece(key)
        tokens = self.tokens(piece) if piece.isascii() else None
        if tokens is not None:  # a byte is a character
            ends = list(accumulate([len(t.value) for t in tokens]))
            return array("i", [0, *ends[:-1]]).tobytes(), array("i", ends).tobytes(), ends[-1]
        e = self.tokenizer.encode_batch([piece], add_special_tokens=False)[0]
        starts, ends = np.array(e.offsets, np.int32).reshape(-1, 2).T
        return starts.tobytes(), ends.tobytes(), len(piece)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        cut = [None if self.whole(t) else self.cut(t) for t in texts]
        get = self.ids.__getitem__
        return [np.array(self.raw(t), self.dtype) if c is None else np.frombuffer(b"".join(map(get, c)), self.dtype) for t, c in zip(texts, cut, strict=True)]

    def offsets(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Character spans (starts, ends) of each text's tokens."""
        cut = [None if self.kind != "byte" or self.whole(t) else self.cut(t) for t in texts]
        held = self.spans
        out = []
        for t, c in zip(texts, cut, strict=True):
            if c is None:
                e = self.tokenizer.encode_batch([t], add_special_tokens=False)[0]
                out.append(tuple(np.array(e.offsets, np.int64).reshape(-1, 2).T))
                continue
            starts, ends, sizes = zip(*[held[p] for p in c], strict=True) if c else ((), (), ())
            sizes = np.array(sizes, np.int64)
            base = np.repeat(np.cumsum(sizes) - sizes, np.fromiter(map(len, starts), np.int64, len(starts)) // 4)
            out.append(tuple(np.frombuffer(b"".join(x), np.int32) + base for x in (starts, ends)))
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and path; its cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Part of each token: that with most of its characters, the earlier one of equals; part p is [bounds[p], bounds[p + 1]).

    Tokens without characters, as of a letter's later bytes, belong where they start.
    """
    last = len(bounds) - 2
    lo = np.clip(np.searchsorted(bounds, starts, "right") - 1, 0, last)
    hi = np.clip(np.searchsorted(bounds, np.maximum(ends - 1, starts), "right") - 1, 0, last)
    for k in np.nonzero(hi > lo)[0]:
        parts = np.arange(lo[k], hi[k] + 1)
        lo[k] = parts[np.argmax(np.minimum(ends[k], bounds[parts + 1]) - np.maximum(starts[k], bounds[parts]))]
    return lo


def _sections(path: str, separator: str):
    def run(batches):
        enc = encoder(path)
        for batch in small(batches):
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for lo in range(0, len(ids), 256):
                cols: list[list[np.ndarray]] = [[], [], [], [], []]
                names = []
                for i, t, (a, b) in zip(ids[lo : lo + 256], texts[lo : lo + 256], enc.offsets(texts[lo : lo + 256]), strict=True):
                    sizes = [len(x) for x in t.split(separator)]
                    bounds = np.cumsum([0, *(n + len(separator) for n in sizes)])
                    bounds[-1] = len(t)
                    n = np.bincount(attribute(a, b, bounds), minlength=len(sizes)) if len(a) else np.zeros(len(sizes), np.int64)
                    names += [i] * len(sizes)
                    for c, v in zip(cols, (np.arange(len(sizes)), bounds[:-1], bounds[1:], n, np.full(len(sizes), len(a))), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.array(np.concatenate(c).astype(np.int64)) for c in cols)], ["doc_id", "section", "start_char", "end_char", "n_tokens", "doc_tokens"])

    return run


def section_tokens(documents: DataFrame, path: str, separator: str = "\n") -> DataFrame:
    """Tokens of each section of each document: doc_id, section, start_char, end_char, n_tokens, doc_tokens.

    Ids and spans are those of the whole text; sections are parted by separator, which belongs to the section before it. A token that
    crosses a boundary goes to the section with most of its characters, of equals the earlier. Null and empty texts
    are one section without tokens. Repeated rows and rows without doc_id are counted each.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_sections(path, separator), "doc_id long, section long, start_char long, end_char long, n_tokens long, doc_tokens long")


def field_tokens(rows: DataFrame, key: str, fields: list[str], path: str, joiner: str = "\n") -> DataFrame:
    """Tokens of each field when a row's fields are joined and encoded as one text: key, field, n_tokens.

    The joiner belongs to the field before it; null fields are empty texts. The same rule as for sections.
    """

    def run(batches):
        enc = encoder(path)
        for batch in small(batches):
            parts = list(zip(*([x or "" for x in batch.column(f).to_pylist()] for f in fields), strict=True))
            counts = []
            for p, (a, b) in zip(parts, enc.offsets([joiner.join(p) for p in parts]), strict=True):
                bounds = np.cumsum([0, *(len(x) + len(joiner) for x in p)])
                bounds[-1] -= len(joiner)
                counts.append(np.bincount(attribute(a, b, bounds), minlength=len(fields)) if len(a) else np.zeros(len(fields), np.int64))
            keys = [k for k in batch.column(key).to_pylist() for _ in fields]
            n = np.concatenate(counts) if counts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fields * len(parts), pa.string()), pa.array(n.astype(np.int64))], [key, "field", "n_tokens"])

    return rows.select(F.col(key).cast("long").alias(key), *(F.col(f).cast("string").alias(f) for f in fields)).mapInArrow(run, f"`{key}` long, field string, n_tokens long")
