"""Best-fit packing by minimum bin slack.

Each document becomes token ids plus an end id, cut into pieces of at most `capacity` tokens. What a bin can
hold depends on the pieces' lengths alone, so the search runs over the histogram of lengths, which has at
most `capacity` entries however large the input: around the largest length left, bitset subset-sum dynamic
programming finds the combination that fills a bin best, and it is removed as many times as the histogram
holds it. That gives at most a few thousand patterns. Back on Spark, each piece's rank among the pieces of
its length (a running sum over per-task counts, so no length is gathered in one task) says which bin of
which pattern it fills.

Defined results: a null text counts as empty and packs as its end id alone; a null doc_id is passed
through; repeated rows are packed once each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadlens.llm import chunk_table
from quadlens.llm.common import checkpointed


@lru_cache(maxsize=2)
def _ids(path: str, ranks: str | None) -> chunk_table.BytePieces:
    return chunk_table.BytePieces(path, counts=False, ranks=ranks)


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, with its task and its place among the task's pieces of that length."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"

    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            docs, rows = iter(b.column("doc_id").to_pylist()), []
            for edge, ids in _ids(path, ranks).results(b.column("text")):
                raw = memoryview(ids.tobytes())
                for a, z in zip(edge.tolist(), edge[1:].tolist()):
                    doc, n = next(docs), z - a + 1  # the end id comes last
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for k, (i, j) in enumerate(zip(edges, edges[1:])):
                        crc = zlib.crc32(raw[4 * (a + i) : 4 * min(a + j, z)])
                        rows.append((doc, k, i, j - i, zlib.crc32(tail, crc) if j == n else crc, task, seen[j - i]))
                        seen[j - i] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of the combination of available lengths with the largest sum up to room, larger lengths first."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        steps.append((length, reach))
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            reach = (reach | reach << (k * length)) & mask
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        copies = 0
        while not before >> (at - copies * length) & 1:
            copies += 1
        if copies:
            chosen.append((length, copies))
            at -= copies * length
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, copies)]): how many bins are filled by which combination."""
    counts, out = {x: n for x, n in histogram.items() if n}, []
    while counts:
        top = max(counts)
        counts[top] -= 1
        chosen = dict(fullest(counts, capacity - top))
        counts[top] += 1
        chosen[top] = chosen.get(top, 0) + 1
        bins = min(counts[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            counts[x] -= bins * n
            if not counts[x]:
                del counts[x]
        out.append((bins, sorted(chosen.items(), reverse=True)))
    return out


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, copies in a bin, first bin, offset) in order of rank."""
    out, ranks, bin0 = {}, {}, 0
    for bins, chosen in patterns:
        offset = 0
        for length, copies in chosen:
            out.setdefault(length, []).append((ranks.get(length, 0), copies, bin0, offset))
            ranks[length] = ranks.get(length, 0) + bins * copies
            offset += length * copies
        bin0 += bins
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def pack(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece. ranks: see BytePieces."""
    spark = docs.sparkSession
    cut = checkpointed(pieces(docs, path, capacity, end, ranks))
    per_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_task = checkpointed(per_task.select("task", "length", "n", before.alias("before")))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    where = spark.sparkContext.broadcast(places(minimum_bin_slack(histogram, capacity)))  # bounded by the patterns, not by the input

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("before").to_numpy() + b.column("nth").to_numpy()
            bins, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at, table = np.flatnonzero(length == x), where.value[int(x)]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                nth = rank[at] - row[:, 0]
                bins[at], offset[at] = row[:, 2] + nth // row[:, 1], row[:, 3] + nth % row[:, 1] * x
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(bins), pa.array(offset)], [*keep, "sequence_id", "offset"])

    ranked = cut.join(per_task.select("task", "length", "before"), ["task", "length"])
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
