"""Which keys of a document occur in another document too.

The operators that compare documents by 64-bit keys (shingles, anchors) start here. Keys travel as packed
blobs, not as rows: a map task sends each bucket (a range of key hashes) the keys of a group of documents,
the bucket's task sorts them and finds those of more than one document, and what it found goes back to
the documents' blocks (documents by hash of doc_id). Each blob is zstandard-compressed.

Skew: a key that occurs in several documents of one group is known to be shared at once; its bucket gets it
once per group, however many documents hold it, so a key in a third of all documents costs a bucket no more
than one entry per group. Buckets and blocks are sized by bytes, so their number grows with the input.

Past FAN buckets or blocks a group would have next to no keys for each of them. Keys then travel in two steps: to
some root of as many ranges, of which tasks gather REGROUP keys at a time and deal these to their buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a row carries: keys for a bucket, keys known to be shared, or a payload for a block.
KEYS, SHARED, PAYLOAD = 0, 1, 2
ROW = "part int, block int, kind int, blob binary"
FIELDS = ["part", "block", "kind", "blob"]
GROUP_BYTES = 4 << 20
FAN, REGROUP = 4096, 1 << 22
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_of(doc: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(doc.astype(np.int64).view(np.uint64) + MIX) % np.uint64(blocks)).astype(np.int64)


def packed(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed blob."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.kind), a.dtype.itemsize, len(a)))], np.int64)
    return zstandard.compress(head.tobytes() + b"".join(_planes(a).tobytes() for a in arrays), level)


def _planes(a: np.ndarray) -> np.ndarray:
    """64-bit numbers byte by byte, so that unused high bytes compress away."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T if a.dtype.itemsize == 8 else a


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 3 * n, 8), 8 + 24 * n, []
    for kind, size, length in head.reshape(-1, 3).tolist():
        a = np.frombuffer(raw, np.uint8, size * length, at)
        a = np.ascontiguousarray(a.reshape(8, -1).T).reshape(-1) if size == 8 else a
        out.append(a.view(f"<{chr(kind)}{size}"))
        at += size * length
    return out


def by_part(part: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of each part that occurs, in their order."""
    order = np.argsort(part.astype(np.uint16) if n <= 1 << 16 else part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(n + 1)) if n < len(part) else None
    if edges is None:
        found, first = np.unique(part[order], return_index=True)
        for p, a, b in zip(found.tolist(), first, [*first[1:], len(order)]):
            yield p, order[a:b]
        return
    for p in range(n):
        if edges[p] < edges[p + 1]:
            yield p, order[edges[p] : edges[p + 1]]


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    part, block, kind, blob = zip(*rows) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(part, pa.int32()), pa.array(block, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], FIELDS)


def text_groups(batches, most: int = GROUP_BYTES) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(doc_ids, texts as UTF-8) of groups of about `most` bytes; rows without an id are left out."""
    docs, texts, size = [], [], 0
    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
            if doc is None:
                continue
            docs.append(doc)
            texts.append(text or b"")
            size += len(texts[-1])
            if size >= most or len(docs) >= 20_000:
                yield np.array(docs, np.int64), texts
                docs, texts, size = [], [], 0
    if docs:
        yield np.array(docs, np.int64), texts


class Deal:
    """How many buckets and blocks there are, and how many ranges (0: none) keys go to first."""

    def __init__(self, buckets: int, blocks: int, fan: int | None = None):
        fan = FAN if fan is None else fan
        most = max(buckets, blocks)
        self.buckets, self.blocks, self.ranges = buckets, blocks, int(most**0.5) + 1 if most > fan else 0


def key_rows(docs: np.ndarray, key: np.ndarray, at: np.ndarray, deal: Deal, with_docs: bool = True) -> list[tuple]:
    """Rows for the entries of one group: entry i is key[i] of document docs[at[i]]; at ascends."""
    rows = []
    order = np.argsort(key, kind="stable")
    k, d = key[order], docs[at[order]]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    multi, told = np.zeros(len(k), bool), k[:0]
    if len(k):
        several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        multi[order] = np.repeat(several, np.diff(np.append(first, len(k))))
        told = k[first[several]]
    single, shared = np.flatnonzero(~multi), np.flatnonzero(multi)
    block = block_of(docs, deal.blocks)[at[shared]]
    if deal.ranges:
        for p, i in by_part((told % np.uint64(deal.buckets)).astype(np.int64) % deal.ranges, deal.ranges):
            rows.append((p, -1, KEYS, _told(told[i])))
        for p, i in by_part((key[single] % np.uint64(deal.buckets)).astype(np.int64) % deal.ranges, deal.ranges):
            rows.append((p, -1, KEYS, _entries(docs, key, at, single[i])))
        for p, i in by_part(block % deal.ranges, deal.ranges):
            rows.append((p, -1, SHARED, _entries(docs, key, at, shared[i])))
        return rows
    for p, i in by_part((told % np.uint64(deal.buckets)).astype(np.int64), deal.buckets):
        rows.append((p, -1, KEYS, _told(told[i])))
    for p, i in by_part((key[single] % np.uint64(deal.buckets)).astype(np.int64), deal.buckets):
        rows.append((p, -1, KEYS, _entries(docs, key, at, single[i])))
    for p, i in by_part(block, deal.blocks):
        rows.append((p % deal.buckets, p, SHARED, _entries(docs, key, at, shared[i], with_docs)))
    return rows


def regrouped(deal: Deal, with_docs: bool):
    """The second of two steps: what came to ranges goes on to its buckets and blocks."""
    def flush(held: dict) -> Iterator[tuple]:
        for (kind, _), parts in held.items():
            docs, keys = (np.concatenate(x) for x in zip(*parts))
            if not len(docs):  # keys known to be shared
                keys = np.unique(keys)
                for p, i in by_part((keys % np.uint64(deal.buckets)).astype(np.int64), deal.buckets):
                    yield p, -1, KEYS, _told(keys[i])
                continue
            order = np.argsort(docs, kind="stable")
            own, at = np.unique(docs[order], return_inverse=True)
            keys = keys[order]
            if kind == KEYS:
                for p, i in by_part((keys % np.uint64(deal.buckets)).astype(np.int64), deal.buckets):
                    yield p, -1, KEYS, _entries(own, keys, at, i)
            else:
                for p, i in by_part(block_of(own, deal.blocks)[at], deal.blocks):
                    yield p % deal.buckets, p, SHARED, _entries(own, keys, at, i, with_docs)

    def run(batches):
        held, size = {}, 0
        for b in batches:
            yield b.filter(pc.greater_equal(b.column("block"), 0))  # for blocks already
            b = b.filter(pc.less(b.column("block"), 0))
            for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist()):
                docs, keys = entries(blob)
                held.setdefault((kind, len(docs) > 0), []).append((docs, keys))
                size += len(keys)
                if size >= REGROUP:
                    rows = list(flush(held))
                    held, size = {}, 0
                    for i in range(0, len(rows), 512):
                        yield as_batch(rows[i : i + 512])
        rows = list(flush(held))
        for i in range(0, len(rows), 512):
            yield as_batch(rows[i : i + 512])

    return run


def _told(key: np.ndarray) -> bytes:
    return packed(np.zeros(0, np.int64), np.zeros(0, np.uint32), key)


def _entries(docs, key, at, i, with_docs: bool = True) -> bytes:
    if not with_docs:
        return _told(np.unique(key[i]))
    a = at[i]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return packed(docs[a[first]], np.diff(np.append(first, len(a))).astype(np.uint32), key[i])


def entries(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """doc (empty if left out) and key of each entry."""
    docs, counts, key = unpacked(blob)
    return np.repeat(docs, counts), key


def find_shared(table: pa.Table, blocks: int, with_docs: bool) -> pa.Table:
    """One bucket's rows: what is for blocks passes through; keys of more than one document go back to their blocks."""
    rows, docs, keys, told = [], [], [], []
    for block, kind, blob in zip(table.column("block").to_pylist(), table.column("kind").to_pylist(), table.column("blob").to_pylist()):
        if kind != KEYS:
            rows.append((0, block, kind, blob))
            continue
        d, k = entries(blob)
        if len(d):
            docs.append(d)
            keys.append(k)
        else:
            told.append(k)
    if docs:
        doc, key = np.concatenate(docs), np.concatenate(keys)
        docs, keys = [], []
        order = np.argsort(key)
        k, d = key[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        if told:
            several |= np.isin(k[first], np.concatenate(told))
        found = order[np.repeat(several, np.diff(np.append(first, len(k))))]
        del order, k, d
        found = found[np.argsort(doc[found], kind="stable")]
        doc, key = doc[found], key[found]
        own, at = np.unique(doc, return_inverse=True)
        for p, i in by_part(block_of(doc, blocks), blocks):
            rows.append((0, p, SHARED, _entries(own, key, at, i, with_docs)))
    return pa.Table.from_batches([as_batch(rows)])


def shared_blobs(docs: DataFrame, emit: Callable, deal: Deal, with_docs: bool = True) -> DataFrame:
    """block, kind, blob: for each block the shared keys of its documents (SHARED) and the payloads emit adds, rows of other kinds.

    emit(doc_ids, texts) gives the rows of one group of documents, made with key_rows. Without with_docs, a
    block is told its shared keys only, not which document holds which.
    """
    def run(batches):
        for ids, texts in text_groups(batches):
            rows = emit(ids, texts)
            for i in range(0, len(rows), 512):
                yield as_batch(rows[i : i + 512])

    sent = docs.select("doc_id", "text").mapInArrow(run, ROW)
    if deal.ranges:
        sent = sent.repartition("part", F.pmod(F.xxhash64("blob"), F.lit(deal.ranges)))  # many tasks a range
        sent = sent.mapInArrow(regrouped(deal, with_docs), ROW)
    blocks = deal.blocks
    return sent.groupBy("part").applyInArrow(lambda t: find_shared(t, blocks, with_docs), ROW).select("block", "kind", "blob")
