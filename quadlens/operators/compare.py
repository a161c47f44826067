"""Run-to-run comparison: metric deltas and paired bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlens.functions.stats import pct
from quadlens.operators.graph import cut
from quadlens.operators.splits import numbered


def flattened(row: DataFrame) -> DataFrame:
    """metric, value of each numeric column of a one-row report; structs are entered by path."""
    def paths(schema, prefix=""):
        for f in schema.fields:
            name = f"{prefix}{f.name}"
            if f.dataType.typeName() == "struct":
                yield from paths(f.dataType, f"{name}.")
            elif f.dataType.typeName() in ("double", "float", "long", "integer", "decimal"):
                yield name

    pairs = [F.struct(F.lit(p).alias("metric"), F.col(p).cast("double").alias("value")) for p in paths(row.schema)]
    return row.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("value IS NOT NULL")


def deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, a, b, delta of the metrics both reports (metric, value) have."""
    return a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), "metric").withColumn("delta", F.col("b") - F.col("a"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with one row per key: the one with the largest order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def paired_points(a: DataFrame, b: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """a joined with b point by point (suffix 2); a group with other points on the two sides is an error."""
    other = b.select(*[F.col(c) if c in keys else F.col(c).alias(f"{c}2") for c in b.columns])
    both = cut(a.withColumn("_a", F.lit(1)).join(other.withColumn("_b", F.lit(1)), keys, "full"))
    odd = both.where("_a IS NULL OR _b IS NULL").select(group).first()
    if odd:
        raise ValueError(f"{odd[0]} has different points on the two sides")
    return both.drop("_a", "_b")


def set_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of now that before lacks (what: new) and rows of before that now lacks (gone)."""
    return now.subtract(before).withColumn("what", F.lit("new")).unionByName(before.subtract(now).withColumn("what", F.lit("gone")))


def natural_key(name: Column) -> Column:
    """A string in whose order digit runs count as numbers: their length comes first."""
    parts = F.regexp_extract_all(name, F.lit(r"\d+|\D+"), 0)
    digits = lambda x: F.regexp_replace(x, "^0+(?=\\d)", "")
    padded = lambda x: F.when(x.rlike("^\\d"), F.concat(F.lpad(F.length(digits(x)).cast("string"), 6, "0"), digits(x))).otherwise(x)
    return F.array_join(F.transform(parts, padded), "")


def _interval(items: DataFrame, draws: DataFrame, weight_b: str) -> DataFrame:
    """One row: weighted means, their difference and the 95 % interval of the draws' differences d."""
    ends = draws.agg(pct("d", 0.025).alias("lo"), pct("d", 0.975).alias("hi"))  # as many numbers as draws
    mean = lambda v, w: (F.sum(F.col(v) * F.col(w)) / F.sum(w)).alias(v)
    whole = items.agg(mean("a", "weight"), mean("b", weight_b))
    return whole.crossJoin(ends).select("a", "b", (F.col("b") - F.col("a")).alias("delta"), "lo", "hi", ((F.col("lo") > 0) == (F.col("hi") > 0)).alias("excludes_zero"))


def slot_bootstrap(pairs: DataFrame, draws: int = 20_000, seed: int = 20260731) -> DataFrame:
    """paired_bootstrap for few items, by a hash per draw and slot, which any engine can repeat: draws times items rows."""
    items = cut(numbered(pairs.where("a IS NOT NULL AND b IS NOT NULL"), "item"))
    n = max(items.count(), 1)
    slots = items.sparkSession.range(draws * n).select(F.floor(F.col("id") / n).alias("draw"), (F.col("id") % n).alias("slot"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "draw", "slot").cast("binary")), 1, 8), 16, 10).cast("long") % n
    taken = slots.select("draw", pick.alias("n")).groupBy("draw", "n").agg(F.count("*").alias("times"))
    w = F.col("times") * F.col("weight")
    each = taken.join(items, "n").groupBy("draw").agg((F.sum(w * F.col("a")) / F.sum(w)).alias("ma"), (F.sum(w * F.col("b")) / F.sum(w)).alias("mb"))
    return _interval(items, each.withColumn("d", F.col("mb") - F.col("ma")), "weight")


RANGE, TOGETHER = 4096, 1 << 20  # items of a range, and picks looked at together


def range_counts(n: int, first: int, draws: int, chunk: int, seed: int, size: int = RANGE) -> np.ndarray:
    """How many of its n picks each draw of a chunk of draws makes among the items of the range of `size` that begins at first.

    All picks are split between the two halves of the ranges by a binomial draw, those of a half between its halves, and so on
    down to one range. Each split has a generator of its own, named by seed, chunk and place, so every range finds the same
    splits above it.
    """
    count = np.full(draws, n, np.int64)
    lo, hi = 0, -(-n // size)
    at = first // size
    while hi - lo > 1:
        mid = (lo + hi) // 2
        whole, left = min(hi * size, n) - lo * size, (mid - lo) * size
        taken = np.random.Generator(np.random.PCG64([seed, chunk, lo, hi])).binomial(count, left / whole)
        lo, hi, count = (lo, mid, taken) if at < mid else (mid, hi, count - taken)
    return count


def resampled_sums(values: np.ndarray, n: int, first: int, draws: int, chunk: int, seed: int, size: int = RANGE) -> np.ndarray:
    """Sums of the columns of values, those of the items from `first` on, over the picks of each draw of a chunk."""
    counts = range_counts(n, first, draws, chunk, seed, size)
    rng = np.random.Generator(np.random.PCG64([seed, chunk, first, n, 1]))
    out, edge, a = np.zeros((draws, values.shape[1])), np.concatenate([[0], np.cumsum(counts)]), 0
    while a < draws:
        b = max(a + 1, int(np.searchsorted(edge, edge[a] + TOGETHER, "right")) - 1)
        at = rng.integers(0, len(values), edge[b] - edge[a])
        some = np.flatnonzero(counts[a:b])  # a draw without a pick here has no sum
        if len(some):
            out[a + some] = np.add.reduceat(values[at], (edge[a:b] - edge[a])[some])
        a = b
    return out


def paired_bootstrap(pairs: DataFrame, draws: int = 20_000, seed: int = 20260731, chunk: int = 2500, size: int = RANGE) -> DataFrame:
    """pairs (item, weight, a, b and, where b has weights of its own, weight_b): weighted means, their difference and a 95 %
    interval from resampled items. Each draw takes as many items as there are, with replacement.

    Items are numbered and cut into ranges of `size`; tasks take a range and `chunk` draws, find how many picks fall into the
    range (range_counts), make them and give four sums a draw. No pick is a row.
    """
    own = "weight_b" in pairs.columns
    given = pairs.where("a IS NOT NULL AND b IS NOT NULL AND weight IS NOT NULL" + (" AND weight_b IS NOT NULL" if own else ""))
    items = cut(numbered(given.select("item", *[F.col(c).cast("double").alias(c) for c in ("weight", "a", "b", *(["weight_b"] if own else []))]), "item"))
    n = items.count()
    w, v = F.col("weight"), F.col("weight_b" if own else "weight")
    sums = items.select("n", w.alias("w"), (w * F.col("a")).alias("wa"), v.alias("v"), (v * F.col("b")).alias("vb"))
    chunks = [(c, min(chunk, draws - c * chunk)) for c in range(-(-draws // chunk))]
    asked = sums.withColumn("chunk", F.explode(F.array(*[F.lit(c) for c, _ in chunks]))).withColumn("range", F.floor(F.col("n") / size))

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("n").to_numpy())
        values = np.stack([table.column(c).to_numpy()[order] for c in ("w", "wa", "v", "vb")], 1)
        c, first = table.column("chunk")[0].as_py(), int(table.column("n").to_numpy().min())
        found = resampled_sums(values, n, first, chunks[c][1], c, seed, size)
        return pa.table({"draw": pa.array(np.arange(len(found)) + c * chunk), **{k: found[:, i] for i, k in enumerate(("w", "wa", "v", "vb"))}})

    each = asked.groupBy("range", "chunk").applyInArrow(run, "draw long, w double, wa double, v double, vb double")
    each = each.groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("w", "wa", "v", "vb")])
    each = each.withColumn("d", F.try_divide("vb", "v") - F.try_divide("wa", "w"))
    return _interval(items, each, "weight_b" if own else "weight")
