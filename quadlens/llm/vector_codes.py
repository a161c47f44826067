"""Product codes of vectors, their codebooks fitted by rounds of assignment and averaging, found by VA-file filtering.

Components become whole numbers, vectors are cut into equal consecutive parts, and each part is assigned to the nearest
entry of its codebook. The entries stand in a vector-approximation file: each of their coordinates is quantised to
2^bits cells. For a batch of vectors, a lookup table per coordinate and cell holds the least and the greatest squared
difference; added up along the entries' cells (one matrix product with the cells as indicators) they bound every
distance from below and above. Entries whose lower bound is above the least upper bound are out; only the others are
compared, by distances of whole numbers.

Each round is one pass over the table: tasks give sums and counts per entry, which Spark adds up. The codebooks, at most
`entries` vectors and so bounded by parameters, are all that the driver holds.

Defined results: vectors that are null or empty or hold a null or non-finite component take no part; every finite
component does, however large (then with Python's whole numbers). Vectors of different dimensions, or of one that the
parts do not divide, raise a ValueError. Rows count one by one: rows that repeat a vec_id are seeds each, in order of
their vectors, and null vec_ids come last. Equal distances go to the lower entry, so of equal entries only the first is
used. Errors beyond 64 bits are given as the largest number of 64 bits. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quadlens.llm.common import join_hot, new_path, staged

MOST = (1 << 63) - 1
STEP = 2048  # vectors looked at together
LIMB = 32
FAR, NEAR = 1 + 1e-4, 1e-15  # well above what rounding adds: to sums of single floats, and to scaled differences


@dataclass
class Codebooks:
    """books[p] is the whole-number matrix of part p, one row an entry; wide: beyond 64-bit arithmetic."""

    books: list[np.ndarray]
    scale: int
    bits: int
    wide: bool

    @property
    def dim(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their components."""
    n, length = len(column), column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    of = np.repeat(np.arange(n), length)
    bad = np.bincount(of, weights=~np.isfinite(flat), minlength=n) > 0
    good = (length > 0) & ~bad
    return good, flat[good[of]].reshape(-1, dim)


def whole(m: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * m), exactly; scale is a power of two."""
    if not wide:
        return np.floor(m * scale).astype(np.int64)
    return np.array([[int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in r] for r in m.tolist()], object).reshape(m.shape)


def _scaled(m: np.ndarray, unit: int) -> np.ndarray:
    """m / unit as doubles, for whole numbers of any size."""
    return m / float(unit) if m.dtype != object else np.array([[x / unit for x in r] for r in m.tolist()]).reshape(m.shape)


def _largest(m: np.ndarray) -> int:
    return max(1, abs(int(m.max())), abs(int(m.min())))


class ApproximationFile:
    """The entries of one codebook by cells, for nearest-entry searches with integer distances."""

    def __init__(self, book: np.ndarray, bits: int):
        self.book, (n, dim) = book, book.shape
        self.unit = _largest(book)
        x = _scaled(book, self.unit)
        cells = 1 << bits
        # cells of about equally many distinct coordinates, each as wide as what lies in it
        order = np.argsort(x, axis=0, kind="stable")
        cell = np.empty((n, dim), np.int64)
        np.put_along_axis(cell, order, (np.arange(n) * cells // n)[:, None], axis=0)
        self.low, self.high = np.full((dim, cells), np.inf), np.full((dim, cells), -np.inf)
        d = np.broadcast_to(np.arange(dim), (n, dim))
        np.minimum.at(self.low, (d, cell), x)
        np.maximum.at(self.high, (d, cell), x)
        used = np.isfinite(self.low)
        self.low, self.high = np.where(used, self.low, 0.0), np.where(used, self.high, 0.0)
        self.member = np.zeros((dim * cells, n), np.float32)  # which cells each entry lies in
        self.member[(d * cells + cell).ravel(), np.repeat(np.arange(n), dim)] = 1

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each row of q to each entry, in a common unit."""
        unit = max(self.unit, _largest(q))
        x, slack = _scaled(q, unit)[:, :, None], NEAR
        below, above = self.low * (self.unit / unit) - x, x - self.high * (self.unit / unit)
        least = np.maximum(np.maximum(below, above) - slack, 0.0)
        most = np.maximum(np.abs(below), np.abs(above)) + slack
        table = lambda t: np.square(t).astype(np.float32).reshape(len(q), -1)
        return table(least) @ self.member, table(most) @ self.member

    def candidates(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, entry) that the bounds leave, row by row, entries ascending."""
        low, high = self.bounds(q)
        return np.nonzero(low <= high.min(1)[:, None] * np.float32(FAR) + np.float32(1e-30))

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of q, ties to the lower, and its squared distance."""
        if not len(q):
            return np.zeros(0, np.int64), np.zeros(0, q.dtype)
        row, entry = self.candidates(q)
        gap = q[row] - self.book[entry]
        dist = (gap * gap).sum(1)
        start = np.searchsorted(row, np.arange(len(q)))
        best = np.minimum.reduceat(dist, start)
        hit = np.flatnonzero(dist == best[row])
        first = hit[np.searchsorted(row[hit], np.arange(len(q)))]
        return entry[first], best


def _assigned(codebooks: Codebooks):
    """A function from an Arrow list column to (rows that take part, whole numbers, codes, errors)."""
    files = [ApproximationFile(b, codebooks.bits) for b in codebooks.books]

    def run(column):
        good, m = _matrix(column, codebooks.dim)
        q = whole(m, codebooks.scale, codebooks.wide)
        code, error = np.zeros((len(q), len(files)), np.int64), np.zeros(len(q), q.dtype)
        for a in range(0, len(q), STEP):
            at = 0
            for p, f in enumerate(files):
                part = q[a : a + STEP, at : at + f.book.shape[1]]
                code[a : a + STEP, p], found = f.nearest(part)
                error[a : a + STEP] += found
                at += f.book.shape[1]
        return good, q, code, error

    return run


def _limbs(x: np.ndarray, n: int) -> np.ndarray:
    """Whole numbers as n limbs of LIMB bits each, the last one signed; sums of limbs stand for sums of numbers."""
    if n == 1:
        return x.astype(np.int64)[..., None]
    parts = [(x >> (LIMB * i)) & ((1 << LIMB) - 1) for i in range(n - 1)]
    return np.stack([p.astype(np.int64) for p in [*parts, x >> (LIMB * (n - 1))]], -1)


def _taking_part(vectors: DataFrame) -> DataFrame:
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < math.inf))
    return vectors.where((F.size("embedding") > 0) & good)


def _moved(vectors: DataFrame, codebooks: Codebooks, limbs: int) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floor of the mean of its parts."""
    width = codebooks.books[0].shape[1]

    def run(batches):
        assign, sums = _assigned(codebooks), {}
        for b in batches:
            _, q, code, _ = assign(b.column("embedding"))
            for p in range(len(codebooks.books)):
                order = np.argsort(code[:, p], kind="stable")
                entry, start, n = np.unique(code[order, p], return_index=True, return_counts=True)
                if len(entry):
                    added = np.add.reduceat(_limbs(q[order, p * width : (p + 1) * width], limbs), start, axis=0)
                    for e, k, s in zip(entry.tolist(), n.tolist(), added):
                        n0, s0 = sums.get((p, e), (0, 0))
                        sums[p, e] = n0 + k, s0 + s
        keys = list(sums)
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([sums[k][1].ravel() for k in keys], pa.list_(pa.int64()))]
        yield pa.record_batch(columns, ["part", "entry", "n", "s"])

    found = vectors.select("embedding").mapInArrow(run, "part int, entry int, n long, s array<long>")
    totals = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width * limbs)]
    books = [b.copy() for b in codebooks.books]
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():  # one row an entry
        limb = [[r[f"s{d * limbs + i}"] for i in range(limbs)] for d in range(width)]
        books[r["part"]][r["entry"]] = [sum(x << (LIMB * i) for i, x in enumerate(xs)) // r["n"] for xs in limb]
    return books


def fit(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, bits: int = 4) -> Codebooks | None:
    """Codebooks that start as the parts of the `entries` smallest vec_ids; None if no vector takes part."""
    vectors = _taking_part(vectors.select("vec_id", "embedding"))
    top = F.max(F.array_max(F.transform("embedding", lambda e: F.abs(e.cast("double")))))
    seen = vectors.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("dim"), top.alias("top"), F.count("*").alias("n")).first()
    if not seen["n"]:
        return None
    if seen["low"] != seen["dim"] or seen["dim"] % parts:
        raise ValueError(f"vectors of {seen['low']} to {seen['dim']} components have no {parts} equal parts")
    dim, most = seen["dim"], (int(seen["top"]) + 1) * scale
    wide = dim * (2 * most) ** 2 > MOST
    limbs = 1 if seen["n"] * most < 1 << 62 else 2 + (most.bit_length() // LIMB)
    seeds = vectors.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    seeds = whole(np.array([r[0] for r in seeds], np.float64), scale, wide)
    width = dim // parts
    found = Codebooks([seeds[:, p * width : (p + 1) * width].copy() for p in range(parts)], scale, bits, wide)
    for _ in range(rounds):
        found = Codebooks(_moved(vectors, found, limbs), scale, bits, wide)
    return found


def encode(vectors: DataFrame, codebooks: Codebooks, *keep: str) -> DataFrame:
    """vec_id, keep, code (two hex digits a part) and error of each vector that takes part."""
    fields = [StructField("vec_id", LongType()), *(vectors.schema[c] for c in keep), StructField("code", StringType()), StructField("error", LongType())]
    schema = StructType(fields)

    def run(batches):
        assign, shape = _assigned(codebooks), to_arrow_schema(schema)
        for b in batches:
            good, _, code, error = assign(b.column("embedding"))
            hexes = np.char.mod("%02x", code) if len(code) else code
            told = ["".join(x) for x in hexes.tolist()]
            columns = [b.column(c).filter(pa.array(good)).cast(shape.field(c).type) for c in ("vec_id", *keep)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(told, shape.field("code").type), pa.array([min(int(x), MOST) for x in error.tolist()], pa.int64())], schema=shape)

    return vectors.select("vec_id", "embedding", *keep).mapInArrow(run, schema)


def code_report(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, bits: int = 4) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each vector that takes part."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part, so a codebook has at most 256 entries")
    spark = vectors.sparkSession
    codebooks = fit(vectors, parts, entries, rounds, scale, bits)
    if codebooks is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    label = [F.col("label").isNotNull().alias("told"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label")]
    rows = staged(encode(vectors, codebooks, "label").select("vec_id", "code", "error", *label), new_path(spark, "codes"))
    within = lambda c: F.least(c, F.lit(MOST)).cast("long")
    sums = rows.groupBy("told", "label").agg(within(F.sum(F.col("error").cast("decimal(19,0)"))).alias("label_error"), F.count("*").alias("n"))
    return join_hot(rows, sums, ["told", "label"]).select("vec_id", "code", "error", "label_error", F.lit(codebooks.sha256()).alias("codebooks_sha256"))


def _round(i: int) -> str:
    return f"""
d{i} AS (SELECT v.id, p.part, c.entry, list_dot_product(list_transform(range(1, len(p.v) + 1), lambda k: p.v[k] - c.v[k]), list_transform(range(1, len(p.v) + 1), lambda k: p.v[k] - c.v[k])) AS dist
  FROM v JOIN p USING (id) JOIN b{i} c ON c.part = p.part),
a{i} AS (SELECT id, part, min(dist) AS dist, arg_min(entry, struct_pack(dist, entry)) AS entry FROM d{i} GROUP BY id, part),
"""


def oracle(rounds: int = 4) -> str:
    """The same rows by comparing every part with every entry."""
    out = """
WITH RECURSIVE kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda e: floor(1024 * CAST(e AS DOUBLE))) AS u
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), v AS (SELECT id FROM kept),
p AS (SELECT id, part, u[part * len(u) // 4 + 1 : (part + 1) * len(u) // 4] AS v FROM kept, range(4) t(part)),
b0 AS (SELECT part, id - 1 AS entry, v FROM p WHERE id <= 256),
"""
    for i in range(rounds):
        out += _round(i) + f"""
m{i} AS (SELECT part, entry, list(x ORDER BY k) AS v FROM (
  SELECT part, entry, k, floor(sum(x) / count(*)) AS x FROM (SELECT a.part, a.entry, unnest(range(len(p.v))) AS k, unnest(p.v) AS x FROM a{i} a JOIN p USING (id, part)) GROUP BY ALL) GROUP BY part, entry),
b{i + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m USING (part, entry)),
"""
    return out + _round(rounds) + f"""
e AS (SELECT id, CAST(sum(dist) AS BIGINT) AS error, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM kept JOIN e USING (id)
"""
