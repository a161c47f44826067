"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A letter trigram is bound into one vector by multiplying
the letters' vectors, permuted (rolled) by their place; a text's vector is the bundle (sum) of its trigrams'
vectors; a language's prototype is the bundle over all its learning texts, each scaled to the same weight
per trigram. A text goes to the language of highest cosine.

The trigram counts of each language are sums over all learning rows, made on Spark, and are bundled there: one
vector per language comes to the driver. Latin letters up to U+017F have SYMBOLS symbols; every other letter has a
symbol of its own, its vector made from a seeded hash of the lower-cased letter. Prediction is one Arrow pass without
a shuffle. A letter is any code point of category L; all else counts as word borders. Long texts are read piece by
piece; trigrams over the edges of pieces count as all others.

Defined results: a null text or one without a letter is `und` with score 0, as is every text if nothing
could be learned; rows with a null lang or text teach nothing; a null doc_id learns as the text 'null' would
not: it takes no part in learning and is not held out; repeated rows count as often as they occur; equal
cosines go to the alphabetically first language; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlens.llm.shared_keys import MIX, mixed

SYMBOLS, BORDER, OTHERS = 64, 0, 4
NARROW = SYMBOLS**3  # trigrams from here on hold a symbol from SYMBOLS on
BITS = 21  # of a symbol in them
DIMENSIONS, SEED = 1024, 20240229
PIECE = 1 << 20  # characters read at a time


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Code point to symbol: a-z, then the lower-case letters up to U+017F in turn, other letters SYMBOLS and the lower-cased code point; 0 for anything else."""
    out = np.zeros(0x110000, np.int32)
    latin = sorted({c for i in range(0x41, 0x180) if (c := chr(i).lower()).isalpha() and len(c) == 1})
    symbol = {c: 1 + i % (SYMBOLS - OTHERS - 1) for i, c in enumerate(latin)}
    for i in range(0x180):
        if chr(i).isalpha():
            out[i] = symbol.get(chr(i).lower()[0], SYMBOLS - 1)
    for i in range(0x180, sys.maxunicode + 1):
        if unicodedata.category(chr(i))[0] == "L":
            low = ord(chr(i).lower()[0])
            out[i] = out[low] if low < 0x180 else SYMBOLS + low
    return out


@lru_cache(maxsize=1)
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))


def symbol_vectors(symbols: np.ndarray) -> np.ndarray:
    """The vectors of symbols: letter_vectors below SYMBOLS, from there on bits of a seeded hash."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    bits = mixed(mixed(symbols.astype(np.uint64) + np.uint64(SEED))[:, None] + words * MIX)
    out = np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1
    known = symbols < SYMBOLS
    out[known] = letter_vectors()[symbols[known]]
    return out


def bound(trigrams: np.ndarray) -> np.ndarray:
    """The vectors of trigrams: (a * SYMBOLS + b) * SYMBOLS + c, or from NARROW on a, b and c in BITS each."""
    wide = trigrams >= NARROW
    if wide.any():
        out, mask = np.empty((len(trigrams), DIMENSIONS), np.int8), (1 << BITS) - 1
        t = trigrams[wide]
        symbols, at = np.unique(np.concatenate([t >> 2 * BITS, t >> BITS & mask, t & mask]), return_inverse=True)
        v, (a, b, c) = symbol_vectors(symbols), at.reshape(3, -1)
        out[wide] = np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]
        out[~wide] = bound(trigrams[~wide])
        return out
    v = letter_vectors()
    first, second = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)
    return first[trigrams // SYMBOLS**2] * second[trigrams // SYMBOLS % SYMBOLS] * v[trigrams % SYMBOLS]


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Symbols of a text in pieces, with one BORDER between words and at both ends; a piece repeats the last two symbols of the one before."""
    tail, border = np.zeros(0, np.int32), np.full(1, BORDER, np.int32)
    for i in range(0, max(len(text), 1), PIECE):
        codes = _codes()[np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "replace"), np.uint32)]
        s = np.concatenate([tail[-1:], border[: i == 0], codes, border[: i + PIECE >= len(text)]])
        keep = (s != BORDER) | np.concatenate([[True], s[:-1] != BORDER])
        s = np.concatenate([tail[:-1], s[keep]])
        yield s
        tail = s[-2:]


def trigrams_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of a text in order and how often each occurs, words bordered by one BORDER; none without a letter."""
    found = []
    for s in _pieces(text):
        if len(s) < 3:
            continue
        if s.max() >= SYMBOLS:
            s = s.astype(np.int64)
        a, b, c = s[:-2], s[1:-1], s[2:]
        t = (a * SYMBOLS + b) * SYMBOLS + c
        if s.dtype == np.int64:
            t = np.where(np.maximum(np.maximum(a, b), c) < SYMBOLS, t, (a << 2 * BITS) | (b << BITS) | c)
        found.append(np.unique(t[b != BORDER], return_counts=True))
    if len(found) < 2:
        return found[0] if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    at, of = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
    return at, np.bincount(of, np.concatenate([n for _, n in found]), len(at)).astype(np.int64)


class Bound:
    """Trigram vectors in the order they were first asked for; starts anew past `limit` rows."""

    def __init__(self, limit: int = 24_000):
        self.limit, self.place, self.rows, self.n = limit, None, None, 0

    def __call__(self, trigrams: np.ndarray) -> np.ndarray:
        wide = trigrams >= NARROW
        if wide.any():  # not kept
            out = np.empty((len(trigrams), DIMENSIONS), np.int8)
            out[wide], out[~wide] = bound(trigrams[wide]), self(trigrams[~wide])
            return out
        if self.place is None or self.n + len(trigrams) > self.limit:
            self.place, self.rows, self.n = np.full(SYMBOLS**3, -1, np.int32), np.empty((max(self.limit, len(trigrams)), DIMENSIONS), np.int8), 0
        new = trigrams[self.place[trigrams] < 0]
        if len(new):
            self.rows[self.n : self.n + len(new)] = bound(new)
            self.place[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
        return self.rows[self.place[trigrams]]


@lru_cache(maxsize=1)
def _bound() -> Bound:
    return Bound()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from text and lang of docs."""
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                at, n = trigrams_of(text)
                if len(at):
                    n, wide = n / np.sqrt((n * n).sum()), int(np.searchsorted(at, NARROW))
                    sums.setdefault(lang, np.zeros(NARROW))[at[:wide]] += n[:wide]
                    if wide < len(at):
                        yield weights(lang, at[wide:], n[wide:])
                    if len(sums) > 64:  # a task holds few languages at a time
                        for x in list(sums):
                            yield told(x, sums.pop(x))
        for lang, s in sums.items():
            yield told(lang, s)

    def told(lang, s):
        at = np.flatnonzero(s)
        return weights(lang, at, s[at])

    def weights(lang, at, w):
        return pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(w)], ["lang", "trigram", "weight"])

    def bundled(batches):
        sums: dict[str, np.ndarray] = {}  # in millionths, so that order does not matter
        for b in batches:
            lang, at = np.array(b.column("lang").to_pylist(), object), b.column("trigram").to_numpy()
            w = (b.column("weight").to_numpy() * 1e6).round()
            for x in set(lang.tolist()):
                mine = np.flatnonzero(lang == x)
                for i in range(0, len(mine), 4096):
                    j = mine[i : i + 4096]
                    sums[x] = sums.get(x, 0) + (w[j] @ bound(at[j])).astype(np.int64)
        for x, vector in sums.items():
            yield pa.record_batch([pa.array([x] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(vector)], ["lang", "place", "value"])

    counted = docs.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(count, "lang string, trigram long, weight double")
    summed = counted.groupBy("lang", "trigram").agg(F.round(F.sum("weight"), 6).alias("weight"))
    vectors = summed.mapInArrow(bundled, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value")).toPandas()  # languages x DIMENSIONS
    langs, rows = [], []
    for lang, g in vectors.groupby("lang"):
        vector = np.zeros(DIMENSIONS)
        vector[g["place"].to_numpy()] = g["value"].to_numpy()
        langs.append(lang)
        rows.append(vector / max(np.linalg.norm(vector), 1e-12))
    return langs, np.array(rows).reshape(len(langs), DIMENSIONS)


def predict(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine, 0 at least) of each row of docs, with the prototypes of learn."""
    langs, found = prototypes(learn)
    shared = docs.sparkSession.sparkContext.broadcast((langs, found.astype(np.float32)))  # languages x DIMENSIONS

    def run(batches):
        langs, profile = shared.value
        for b in batches:
            names, scores = [], []
            for text in b.column("text").to_pylist():
                vector = np.zeros(DIMENSIONS, np.float32)
                at, n = trigrams_of(text or "")
                for j in range(0, len(at), 8192):
                    vector += n[j : j + 8192].astype(np.float32) @ _bound()(at[j : j + 8192]).astype(np.float32)
                size = float(np.linalg.norm(vector))
                if not size or not langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                cosine = profile @ vector / size
                best = int(cosine.argmax())
                names.append(langs[best])
                scores.append(min(1.0, max(0.0, float(cosine[best]))))
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    asked = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return asked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """Predictions for all of docs; learned from the rows that are not held out."""
    return predict(docs, docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
