"""Alignment of two tokenizations of the same text: a byte-level BPE (A) and a sentencepiece model (B).

Byte-owner arrays: token indices of A and of B are repeated over the bytes they own. Where the pair of owners changes,
an overlap ends; where both change at once, A and B tokens both end, which is a cut; cuts make groups. All chunks of a
block of texts that were not seen before are aligned by one pass over their joined bytes. Chunks are cut where neither
tokenizer joins what stands left and right (see chunk_table), so each distinct one is aligned once per worker.

How often an id pair is linked is counted over all documents in three steps, none of which moves an occurrence:

1. Tasks take texts in blocks of about BLOCK bytes and write each document's links as places in the block's list of
   distinct pairs, and that list with the number of the block's documents that hold each pair.
2. The lists, a fraction of the text, are added up: documents of each pair, and the highest count of each A id.
3. Counts go back to the blocks that hold the pair, and each block adds up its documents' links.

A pair that nearly all blocks hold is joined apart (join_hot). A block, and so a group of step 3, is bounded by its bytes
or is one document. The id pairs of one group are built as distinct ids times distinct ids.

Defined results: a null or empty text, or one whose joined A or B bytes are not a space and the text (such as a text that
holds U+2581), has no tokens: zeros and the empty string. A null doc_id is passed through; repeated rows are documents of
their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadlens.llm import chunk_table
from quadlens.llm.common import join_hot, new_path, staged

BLOCK = 3 << 20  # bytes of text taken together; a task holds some forty times as many
SHORT, KEPT = 64, 360_000  # characters of a chunk that a worker keeps, and how many
SHIFT = 1 << 31  # an id pair as one number: a * SHIFT + b
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@lru_cache(maxsize=2)
def _plain_bpe(path: str):
    """The byte-level tokenizer, for which special strings in a text are plain text."""
    from tokenizers import Tokenizer

    chunk_table.byte_bpe(path)
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level entries write bytes: printable bytes stand for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def _a_bytes(path: str) -> list[bytes]:
    letters, vocabulary = byte_letters(), _plain_bpe(path).get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
    return out


@lru_cache(maxsize=2)
def _b_bytes(path: str) -> list[bytes]:
    model = chunk_table.piece_model(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]


def owners(lengths: np.ndarray) -> np.ndarray:
    """For each byte, the index of the token that owns it."""
    return np.repeat(np.arange(len(lengths)), lengths)


def changes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where, byte by byte, overlaps begin and groups begin, of two byte-owner arrays over the same bytes."""
    of_a, of_b = np.append(True, a[1:] != a[:-1]), np.append(True, b[1:] != b[:-1])
    return np.flatnonzero(of_a | of_b), np.flatnonzero(of_a & of_b)


class Aligner:
    """Groups of tokens of chunks, aligned many at a time."""

    def __init__(self, a_path: str, b_path: str):
        chunk_table.check_markers(b_path)
        self.a, self.b = _plain_bpe(a_path), chunk_table.piece_model(b_path)
        self.a_bytes, self.b_bytes = _a_bytes(a_path), _b_bytes(b_path)
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.opens = np.array([x[:1] == b" " for x in self.a_bytes])
        self.known, self.old = {}, {}

    def _encode_a(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk behind a space. Chunks of one word go to the library many to a call: what begins with a space tells them apart."""
        out = []
        for batch in chunk_table.by_bytes(chunks):
            ids = []
            if not any(" " in x for x in batch):
                ids = self.a.encode_batch_fast([" " + " ".join(batch)], add_special_tokens=False)[0].ids
            at = np.flatnonzero(self.opens[ids]).tolist()
            if len(at) == len(batch):
                out += [ids[i:j] for i, j in zip(at, [*at[1:], len(ids)])]
            else:
                out += [e.ids for e in self.a.encode_batch_fast([" " + x for x in batch], add_special_tokens=False)]
        return out

    def align(self, chunks: list[str]) -> list[tuple | None]:
        """For each chunk behind a space (n_a, n_b, n_groups, groups as text, pairs, times or nothing where all are 1), None if its bytes do not come back."""
        one = [i for i, x in enumerate(chunks) if " " not in x]
        ids = [None] * len(chunks)
        for places in (one, [i for i, x in enumerate(chunks) if " " in x]):
            for i, found in zip(places, self._encode_a([chunks[i] for i in places])):
                ids[i] = found
        rows = self._sound(chunks, ids, self.b.encode(chunks, num_threads=1) if chunks else [])
        out = [None] * len(chunks)
        if not rows:
            return out
        n_a, n_b = (np.fromiter(map(len, (r[k] for r in rows)), np.int64, len(rows)) for k in (1, 2))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(r[k] for r in rows), np.int64) for k in (1, 2))
        of_a, of_b = owners(self.a_size[flat_a]), owners(self.b_size[flat_b])
        # tokens of both end at a chunk's end, so groups never cross chunks
        _, cuts = changes(of_a, of_b)
        group = np.searchsorted(cuts, np.arange(len(of_a)), "right") - 1
        group_a = group[np.searchsorted(of_a, np.arange(len(flat_a)))]
        group_b = group[np.searchsorted(of_b, np.arange(len(flat_b)))]
        start_a, start_b = (np.searchsorted(g, np.arange(len(cuts) + 1)) for g in (group_a, group_b))
        chunk = np.searchsorted(np.cumsum(n_a), start_a[:-1], "right")  # of each group
        pairs, times, of = self._pairs(flat_a, flat_b, group_a, group_b, chunk)
        first, last = np.searchsorted(of, np.arange(len(rows))).tolist(), np.searchsorted(of, np.arange(len(rows)), "right").tolist()
        # groups as text
        text_a, text_b = [list(map(str, x.tolist())) for x in (flat_a, flat_b)]
        start_a, start_b = start_a.tolist(), start_b.tolist()
        told = [f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for i, j, k, m in zip(start_a, start_a[1:], start_b, start_b[1:])]
        edge = np.searchsorted(chunk, np.arange(len(rows) + 1)).tolist()
        once = (np.maximum.reduceat(times, first) == 1).tolist()
        for r, (i, a, b) in enumerate(rows):
            x = slice(first[r], last[r])
            out[i] = (len(a), len(b), edge[r + 1] - edge[r], ";".join(told[edge[r] : edge[r + 1]]), pairs[x].tobytes(), b"" if once[r] else times[x].tobytes())
        return out

    def _sound(self, chunks: list[str], ids_a: list, ids_b: list) -> list[tuple]:
        """(place, A ids, B ids) of the chunks whose joined bytes are a space and the chunk, on both sides."""
        want = (" " + " ".join(chunks)).encode()
        as_a, as_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        if want == b"".join(map(as_a, chain.from_iterable(ids_a))) == b"".join(map(as_b, chain.from_iterable(ids_b))):
            size = np.fromiter((1 + (len(x) if x.isascii() else len(x.encode())) for x in chunks), np.int64, len(chunks))
            ends = np.cumsum(size)
            if all((np.cumsum(t[np.fromiter(chain.from_iterable(ids), np.int64)])[np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) - 1] == ends).all() for t, ids in ((self.a_size, ids_a), (self.b_size, ids_b))):
                return list(zip(range(len(chunks)), ids_a, ids_b))
        rows = []
        for i, (x, a, b) in enumerate(zip(chunks, ids_a, ids_b)):
            want = b" " + x.encode()
            if b"".join(map(as_a, a)) == want and b"".join(map(as_b, b)) == want:
                rows.append((i, a, b))
        return rows

    @staticmethod
    def _pairs(flat_a, flat_b, group_a, group_b, chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each chunk and how many links each has, with the chunks' numbers, ascending."""
        a, times_a = np.unique(group_a * SHIFT + flat_a, return_counts=True)
        b, times_b = np.unique(group_b * SHIFT + flat_b, return_counts=True)
        begin = np.searchsorted(b, (a // SHIFT) * SHIFT)
        n = np.searchsorted(b, (a // SHIFT + 1) * SHIFT) - begin
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair, times, of = np.repeat(a % SHIFT, n) * SHIFT + b[at] % SHIFT, np.repeat(times_a, n) * times_b[at], np.repeat(chunk[a // SHIFT], n)
        order = np.lexsort((pair, of))
        pair, times, of = pair[order], times[order], of[order]
        new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])))
        return pair[new], np.add.reduceat(times, new), of[new]

    def look_up(self, chunks: list[str]) -> list:
        """Two tables of KEPT / 2 chunks take turns: what is found in the old one moves to the new one, the rest goes when it is full."""
        missing = []
        for x in chunks:
            if x not in self.known:
                if x in self.old:
                    self.known[x] = self.old[x]
                else:
                    missing.append(x)
        found = dict(zip(missing, self.align(missing)))
        out = [found[x] if x in found else self.known[x] for x in chunks]
        if len(self.known) + len(found) > KEPT // 2:
            self.old, self.known = self.known, {}
        self.known.update((x, r) for x, r in found.items() if len(x) <= SHORT)
        return out


@lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The chunks of the texts, none empty: whose each is, which distinct chunk it is, and the distinct chunks."""
    lists = pc.split_pattern(texts, " ")
    first = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    at, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    of = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(at))))
    # a chunk that is empty or has white space at an edge makes its text odd: only single spaces inside are cuts
    odd_chunk = np.array([not x or x[0].isspace() or x[-1].isspace() for x in distinct], bool)
    odd = np.bincount(of, weights=odd_chunk[at], minlength=len(texts)) > 0
    plain = ~odd[of]
    more = {x: i for i, x in enumerate(distinct)}
    extra_of, extra_at = [], []
    for i in np.flatnonzero(odd).tolist():
        for x in chunk_table.SAFE_CUT.split(" " + texts[i].as_py()):
            extra_of.append(i)
            extra_at.append(more.setdefault(x[1:], len(more)))
    of, at = np.concatenate([of[plain], np.array(extra_of, np.int64)]), np.concatenate([at[plain], np.array(extra_at, np.int64)])
    order = np.argsort(of, kind="stable")
    used, at = np.unique(at[order], return_inverse=True)
    names = list(more)
    return of[order], at, [names[i] for i in used.tolist()]


DOC, PAIRS = 0, 1
ONES = np.ones(1, np.int64).tobytes()
BLOCKS = "kind int, block string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, times array<long>, pairs array<long>, docs array<int>"


def _block_rows(doc_ids: pa.Array, texts: pa.Array, aligner: Aligner) -> pa.RecordBatch:
    """The rows of one block: its documents, and last its distinct pairs."""
    n = len(texts)
    of, at, names = _chunks(texts)
    found = aligner.look_up(names)
    lost = np.array([x is None for x in found], bool)
    bad = np.bincount(of, weights=lost[at], minlength=n) > 0 if len(of) else np.ones(n, bool)
    bad |= pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    found = [x or (0, 0, 0, "", b"", b"") for x in found]
    kept = ~bad[of]
    of, at = of[kept], at[kept]
    n_a, n_b, n_groups = (np.bincount(of, weights=np.array([x[k] for x in found], np.int64)[at], minlength=n).astype(np.int64) for k in range(3))
    edge, told = np.searchsorted(of, np.arange(n + 1)).tolist(), [x[3] for x in found]
    at_list = at.tolist()
    sha = ["" if b else hashlib.sha256(";".join(map(told.__getitem__, at_list[i:j])).encode()).hexdigest() for b, i, j in zip(bad.tolist(), edge, edge[1:])]
    # each document's distinct chunks with their occurrences, then its distinct pairs with their links
    key, seen = np.unique(of * (len(names) + 1) + at, return_counts=True)
    doc, chunk = key // (len(names) + 1), key % (len(names) + 1)
    pool, pool_times = np.frombuffer(b"".join(x[4] for x in found), np.int64), np.frombuffer(b"".join(x[5] or ONES * (len(x[4]) // 8) for x in found), np.int64)
    size = np.array([len(x[4]) // 8 for x in found], np.int64)
    begin = np.cumsum(size) - size
    distinct, place = np.unique(pool, return_inverse=True)
    m = size[chunk]
    take = np.repeat(begin[chunk] - (np.cumsum(m) - m), m) + np.arange(m.sum())
    key, times = np.repeat(doc, m) * (len(distinct) + 1) + place[take], np.repeat(seen, m) * pool_times[take]
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    key, times = key[new], np.add.reduceat(times, new) if len(new) else times
    doc, place = key // (len(distinct) + 1), key % (len(distinct) + 1)
    docs = np.bincount(place, minlength=len(distinct))
    held = np.flatnonzero(docs)  # chunks of texts without tokens are not counted
    place = (np.cumsum(docs > 0) - 1)[place] if len(place) else place
    links = np.bincount(doc, weights=times, minlength=n).astype(np.int64)
    offsets = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    name, shape = uuid.uuid4().hex, {}
    empty = lambda t: pa.array([None], t)
    lists = lambda off, x, t: pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x, t))
    both = lambda x, t: pa.concat_arrays([pa.array(x, t), empty(t)])
    one = np.array([0, len(held)], np.int32)
    shape["kind"] = pa.array([DOC] * n + [PAIRS], pa.int32())
    shape["block"] = pa.array([name] * (n + 1), pa.string())
    shape["doc_id"] = pa.concat_arrays([doc_ids, empty(pa.int64())])
    for c, x in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", links)):
        shape[c] = both(x, pa.int64())
    shape["groups_sha256"] = both(sha, pa.string())
    shape["at"] = pa.concat_arrays([lists(offsets, place, pa.int32()), empty(pa.list_(pa.int32()))])
    shape["times"] = pa.concat_arrays([lists(offsets, times, pa.int64()), empty(pa.list_(pa.int64()))])
    shape["pairs"] = pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), lists(one, distinct[held], pa.int64())])
    shape["docs"] = pa.concat_arrays([pa.nulls(n, pa.list_(pa.int32())), lists(one, docs[held], pa.int32())])
    return pa.record_batch(list(shape.values()), list(shape))


def _blocks(docs: DataFrame, a_path: str, b_path: str, block: int) -> DataFrame:
    def run(batches):
        aligner, ids, texts, size = _aligner(a_path, b_path), [], [], 0
        for b in batches:
            text = b.column("text").fill_null("")
            for i, j in chunk_table.grouped(pc.binary_length(text).to_numpy(), block):
                ids.append(b.column("doc_id")[i:j])
                texts.append(text[i:j])
                size += pc.sum(pc.binary_length(texts[-1])).as_py() + 64 * (j - i)
                if size >= block:
                    yield _block_rows(pa.concat_arrays(ids), pa.concat_arrays(texts), aligner)
                    ids, texts, size = [], [], 0
        if ids:
            yield _block_rows(pa.concat_arrays(ids), pa.concat_arrays(texts), aligner)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


def _scored(docs: pa.Table, told: pa.Table) -> pa.Table:
    """Links of one block's documents against the counts of its pairs."""
    rank = told.column("rank").to_numpy()
    count, best = np.zeros(len(rank), np.int64), np.zeros(len(rank), bool)
    count[rank] = told.column("count").to_numpy()
    best[rank] = told.column("best").to_numpy(zero_copy_only=False)
    at, times = docs.column("at").combine_chunks(), docs.column("times").combine_chunks()
    n = at.value_lengths().fill_null(0).to_numpy()
    of, at, times = np.repeat(np.arange(len(n)), n), at.flatten().to_numpy(), times.flatten().to_numpy()

    def total(x):
        out = np.zeros(len(n), np.int64)
        np.add.at(out, of, x)
        return pa.array(out)

    columns = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    columns |= {"n_best": total(times * best[at]), "count_sum": total(times * count[at]), "groups_sha256": docs.column("groups_sha256")}
    return pa.table(columns)


def alignment_report(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs."""
    spark = docs.sparkSession
    rows = staged(_blocks(docs, a_path, b_path, block), new_path(spark, "aligned"))
    lists = rows.where(F.col("kind") == PAIRS)
    held = lists.select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("rank", "x")).select("block", "rank", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = held.groupBy("pair").agg(F.sum("docs").alias("count"), F.count("*").alias("n"))
    highest = F.max("count").over(Window.partitionBy("a"))  # at most as many rows an A id as B has ids
    counts = counts.withColumn("a", F.expr(f"pair div {SHIFT}L")).withColumn("best", F.col("count") == highest).drop("a")
    counts = join_hot(held.select("block", "rank", "pair"), counts, ["pair"]).select(F.col("block").alias("of"), "rank", "count", "best")
    told = rows.where(F.col("kind") == DOC).select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times")
    return told.groupBy("block").cogroup(counts.groupBy("of")).applyInArrow(_scored, SCHEMA)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids, b_ids, cuts (byte offsets in space and text where both end), overlaps (pairs of token indices) of each row."""
    def run(batches):
        from_a, from_b, a_bytes, b_bytes = _plain_bpe(a_path), chunk_table.piece_model(b_path), _a_bytes(a_path), _b_bytes(b_path)
        for batch in batches:
            rows = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                a, b = (from_a.encode(" " + t, add_special_tokens=False).ids, from_b.encode(t)) if t else ([], [])
                want = (" " + (t or "")).encode()
                if not t or b"".join(a_bytes[x] for x in a) != want or b"".join(b_bytes[x] for x in b) != want:
                    rows.append((i, [], [], [], []))
                    continue
                of_a, of_b = owners([len(a_bytes[x]) for x in a]), owners([len(b_bytes[x]) for x in b])
                both, cuts = changes(of_a, of_b)
                rows.append((i, a, b, [*cuts[1:].tolist(), len(want)], [{"a": x, "b": y} for x, y in zip(of_a[both].tolist(), of_b[both].tolist())]))
            columns = list(zip(*rows)) or [[]] * 5
            ints = pa.list_(pa.int32())
            types = [pa.int64(), ints, ints, pa.list_(pa.int64()), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "a_ids", "b_ids", "cuts", "overlaps"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, cuts array<long>, overlaps array<struct<a:int,b:int>>")
