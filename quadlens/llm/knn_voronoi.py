"""Exact top-k by inner product: a Voronoi kNN join.

Vectors are made whole numbers, floor(scale * x). An extra coordinate sqrt(R^2 - |x|^2), with R the largest
norm, turns the largest inner products of a query into its smallest Euclidean distances, so that distance
bounds apply. Pivots split queries and data into Voronoi cells. A summary per cell (radius, the distances of
its members nearest to the pivot) bounds, for each group of queries, the distance of the k-th neighbour; a
data vector is replicated to a group only if the triangle inequality cannot rule it out. A group of at most
`block` queries then reads its data as one sorted stream, slice by slice of some `slice_rows` vectors, with the
k best so far as the bound for what follows, so that a slice gives k rows per query however many it reads.

Equal vectors are reduced to their k+1 smallest ids before anything is replicated, so a vector that fills a
third of the table costs no more than any other. Pivots come from a bounded sample (a parameter) and grow with
the root of the number of queries; they steer the work, never the result. Sent to the driver: the sample, and
k + 3 numbers for each pivot.

Defined results: vectors that are null or empty, hold a null or non-finite component or have a null id take no
part; every finite component does, however large: inner products are exact whole numbers, compared as such, and
a score beyond 64 bits is given as the nearest one within. Vectors of different dimensions have no inner product
and raise a ValueError. A query with fewer than k candidates gets them all; rows that repeat an id and its vector
count once; an id with several vectors gets the best answers of all of them; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadlens.llm.common import checkpointed

SLACK = 1e-6
LONGS = -(1 << 63), (1 << 63) - 1
SENT = "grp int, qb int, slice int, kind int, id long, ids array<long>, u array<double>"
QUERY, DATA = 0, 1


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, u array<double> of the vectors that take part; scale (a power of two) times u is floor(scale * x), exactly."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < math.inf))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", x.alias("x"), good.alias("good"))
    small = 2.0**53 / scale  # from there on scale * x is whole
    floor = lambda e: F.when(F.abs(e) < small, F.floor(F.when(F.abs(e) < small, e).otherwise(0.0) * scale).cast("double") / scale).otherwise(e)
    return rows.where(F.col("good") & (F.size("x") > 0)).select("vec_id", F.transform("x", floor).alias("u"))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _whole(m: np.ndarray, scale: int, exact: bool) -> np.ndarray:
    """scale * m: as doubles where products of these are exact, else as Python's whole numbers."""
    if exact:
        return m * scale
    return np.array([[int(x) * scale if abs(x) >= 2**53 else int(x * scale) for x in row] for row in m.tolist()], object).reshape(m.shape)


def _lifted(m: np.ndarray, limit: float) -> np.ndarray:
    """Data with the extra coordinate."""
    return np.hstack([m, np.sqrt(np.maximum(0.0, limit - (m * m).sum(1)))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def _pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice of n points."""
    chosen, far = [0], _distances(points, points[:1])[:, 0]
    while len(chosen) < min(n, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def _sortable(score: int) -> bytes:
    """Bytes in the order of whole numbers of any size."""
    size = abs(score)
    raw = size.to_bytes((size.bit_length() + 7) // 8, "big")
    raw = len(raw).to_bytes(4, "big") + raw
    return b"\1" + raw if score >= 0 else b"\0" + bytes(255 - x for x in raw) + b"\xff"


class _Best:
    """The k best of each query of one group, over the data seen so far."""

    def __init__(self, k: int, scale: int, dim: int, exact: bool):
        self.k, self.scale, self.dim, self.exact = k, scale, dim, exact
        self.own, self.rows, self.q = [], [], None
        self.of, self.ids, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64 if exact else object)

    def ask(self, batch: pa.RecordBatch) -> None:
        self.own.append(batch.column("id").to_numpy())
        self.rows.append(_whole(_matrix(batch.column("u"), self.dim), self.scale, self.exact))

    def see(self, batch: pa.RecordBatch, step: int = 2048) -> None:
        if self.q is None:
            if not self.rows:
                return
            self.q, self.own = np.concatenate(self.rows), np.concatenate(self.own)
            self.last = np.full(len(self.q), -np.inf if self.exact else -math.inf, self.score.dtype)
        x = _whole(_matrix(batch.column("u"), self.dim), self.scale, self.exact)
        lists = batch.column("ids")
        edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten().to_numpy()
        for a in range(0, len(x), step):
            self._take(self.q @ x[a : a + step].T, edge[a : a + step + 1], flat)

    def _take(self, score: np.ndarray, edge: np.ndarray, flat: np.ndarray) -> None:
        k, last = self.k, self.last
        if self.exact and score.shape[1] > k + 1:  # one more than k: a query is no neighbour of its own
            last = np.maximum(last, np.partition(score, -(k + 1), axis=1)[:, -(k + 1)])
        of, col = np.nonzero((score >= last[:, None]).astype(bool))
        n = (edge[1:] - edge[:-1])[col]
        at = np.repeat(edge[:-1][col] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found, ids, of = np.repeat(score[of, col], n), flat[at], np.repeat(of, n)
        good = ids != self.own[of]
        of, ids, found = (np.concatenate(x) for x in ((self.of, of[good]), (self.ids, ids[good]), (self.score, found[good])))
        if self.exact:
            order = np.lexsort((ids, -found, of))
        else:
            order = np.array(sorted(range(len(of)), key=lambda j: (of[j], -found[j], ids[j])), np.int64)
        of, ids, found = of[order], ids[order], found[order]
        first = np.searchsorted(of, np.arange(len(self.q)))
        rank = np.arange(len(of)) - first[of]
        kept = rank < k
        self.of, self.ids, self.score = of[kept], ids[kept], found[kept]
        full = rank == k - 1
        self.last[of[full]] = found[full]

    def rows_out(self) -> pa.RecordBatch:
        score = [int(x) for x in self.score.tolist()]
        order = pa.nulls(len(score), pa.binary()) if self.exact else pa.array([_sortable(x) for x in score], pa.binary())
        score = pa.array([min(max(x, LONGS[0]), LONGS[1]) for x in score], pa.int64())
        own = np.asarray(self.own)[self.of] if len(self.of) else np.zeros(0, np.int64)
        return pa.record_batch([pa.array(own), pa.array(self.ids), score, order], ["query_id", "vec_id", "score", "wide"])


def _solver(k: int, scale: int, dim: int, exact: bool):
    """Reads streams sorted by (grp, qb, slice, kind): each group's queries, then its data."""
    def run(batches):
        at, best = None, None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("grp", "qb", "slice", "kind")], 1)
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else []
            for i, j in zip(cuts, [*cuts[1:], len(keys)]):
                key, kind = tuple(keys[i, :3]), keys[i, 3]
                if key != at:
                    if best is not None:
                        yield best.rows_out()
                    at, best = key, _Best(k, scale, dim, exact)
                part = b.slice(i, j - i)
                best.ask(part) if kind == QUERY else best.see(part)
        if best is not None:
            yield best.rows_out()

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, n_pivots: int | None = None, sample: int = 4096, block: int = 2048, slice_rows: int = 1 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id `every` divides, the k others of highest inner product."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows = checkpointed(quantized(vectors, scale).dropDuplicates(["vec_id", "u"]))
    seen = rows.agg(F.min(F.size("u")).alias("low"), F.max(F.size("u")).alias("dim"), F.max(F.array_max(F.transform("u", F.abs))).alias("top"), F.count_if(F.col("vec_id") % every == 0).alias("n")).first()
    if not seen["n"]:
        return spark.createDataFrame([], schema)
    if seen["low"] != seen["dim"]:
        raise ValueError(f"vectors of {seen['low']} and of {seen['dim']} components have no inner product")
    dim = seen["dim"]
    unit = 2.0 ** min(1023, math.ceil(math.log2(seen["top"]))) if seen["top"] else 1.0  # bounds are taken over components of about 1
    limit = rows.agg(F.max(F.aggregate("u", F.lit(0.0), lambda s, e: s + (e / unit) * (e / unit)))).first()[0] or 1.0
    slack = SLACK * (1 + limit**0.5)  # well above what rounding adds to a distance
    exact = math.log2(limit) + 2 * (math.log2(unit) + math.log2(scale)) < 52.5  # products and their sums are whole doubles
    # the smallest ids of each distinct vector
    nth = F.row_number().over(Window.partitionBy("u").orderBy("vec_id"))
    data = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("u").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    data = checkpointed(data)
    n_pivots = n_pivots or max(8, math.ceil(seen["n"] ** 0.5 / 4))
    points = data.select("u").orderBy(F.xxhash64("u")).limit(max(sample, 4 * n_pivots)).toArrow().column("u")
    pivots = spark.sparkContext.broadcast(_pivots(_lifted(_matrix(points, dim) / unit, limit), n_pivots))  # n_pivots rows

    def nearest(m):
        d = _distances(m, pivots.value)
        c = d.argmin(1)
        return c.astype(np.int32), d[np.arange(len(c)), c]

    def cells(batches):
        for b in batches:
            c, far = nearest(_lifted(_matrix(b.column("u"), dim) / unit, limit))
            yield pa.record_batch([pa.array(c), pa.array(far), b.column("u"), b.column("ids")], ["cell", "far", "u", "ids"])

    def query_cells(batches):
        for b in batches:
            c, far = nearest(np.hstack([_matrix(b.column("u"), dim) / unit, np.zeros((b.num_rows, 1))]))
            yield pa.record_batch([b.column("vec_id"), b.column("u"), pa.array(c), pa.array(far)], ["vec_id", "u", "grp", "far"])

    data = checkpointed(data.mapInArrow(cells, "cell int, far double, u array<double>, ids array<long>"))
    queries = checkpointed(rows.where(F.col("vec_id") % every == 0).mapInArrow(query_cells, "vec_id long, u array<double>, grp int, far double"))
    by_far = F.row_number().over(Window.partitionBy("cell").orderBy("far"))
    nearest_of = data.select("cell", "far").withColumn("nth", by_far).where(F.col("nth") <= k + 1)
    summary = nearest_of.groupBy("cell").agg(F.sort_array(F.collect_list("far")).alias("near")).collect()  # n_pivots rows of k + 1 numbers
    groups = queries.groupBy("grp").agg(F.max("far").alias("reach"), F.count("*").alias("n")).collect()  # n_pivots rows
    # for each group: the largest distance at which a k-th neighbour can lie; a query is no neighbour of its own, so one more than k
    near = np.full((len(pivots.value), k + 1), np.inf)
    for r in summary:
        near[r["cell"], : len(r["near"])] = r["near"]
    grp, reach = np.array([r["grp"] for r in groups]), np.array([r["reach"] for r in groups])
    blocks = np.array([-(-r["n"] // block) for r in groups])
    between = _distances(pivots.value[grp], pivots.value)
    bound = np.array([np.partition((x + between[g][:, None] + near).ravel(), k)[k] for g, x in enumerate(reach)])
    wide = reach + bound + slack
    groups = spark.sparkContext.broadcast((grp, between, wide, blocks))  # n_pivots^2 numbers, an eightieth of the queries
    slices = max(1, -(-data.count() // slice_rows))

    def replicated(batches):
        grp, between, wide, blocks = groups.value
        for b in batches:
            if not b.num_rows:
                continue
            cell, far = b.column("cell").to_numpy(), b.column("far").to_numpy()
            part = pa.array((b.column("h").to_numpy() % slices).astype(np.int32))
            for g in range(len(grp)):
                i = np.flatnonzero(np.abs(between[g][cell] - far) <= wide[g])  # triangle inequality
                for q in range(blocks[g] if len(i) else 0):
                    at, n = pa.array(i), len(i)
                    one = lambda x, n=n: pa.array(np.full(n, x, np.int32))
                    yield pa.record_batch([one(grp[g]), one(q), part.take(at), one(DATA), pa.nulls(n, pa.int64()), b.column("ids").take(at), b.column("u").take(at)], ["grp", "qb", "slice", "kind", "id", "ids", "u"])

    sent = data.withColumn("h", F.pmod(F.xxhash64("u"), F.lit(1 << 30))).mapInArrow(replicated, SENT)
    n_blocks = F.element_at(F.create_map(*[F.lit(int(x)) for pair in zip(grp, blocks) for x in pair]), F.col("grp"))
    asked = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    asked = asked.select("grp", F.pmod(F.xxhash64("vec_id"), n_blocks.cast("long")).cast("int").alias("qb"), "slice", F.lit(QUERY).alias("kind"), F.col("vec_id").alias("id"), F.lit(None).cast("array<long>").alias("ids"), "u")
    keys = ["grp", "qb", "slice"]
    stream = sent.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "kind")
    best = stream.mapInArrow(_solver(k, scale, dim, exact), "query_id long, vec_id long, score long, wide binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("wide"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
