"""Held-out splits by family, stratified by z, and the audits that hold them to account by content hash."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlens.operators.graph import components, cut

#: Suffixes that derived exports add to a patch's name (fixed values).
SUFFIXES = (r"_sel_.*$", r"_region_\d+$", r"_v\d+(\.tifxyz)?$", r"_(flatboi|copy|front|back|new|lasagna|growpatch)$")


def family_key(name: Column) -> Column:
    """name without derived-export suffixes, cut until nothing changes and never to nothing.

    A suffix has three characters at least, so a third of the name's length is as many rounds as can change it.
    """
    def cut(acc: Column) -> Column:
        for s in SUFFIXES:
            acc = F.when(F.regexp_replace(acc, s, "") == "", acc).otherwise(F.regexp_replace(acc, s, ""))
        return acc

    rounds = F.floor(F.char_length(name) / 3) + 1
    return F.aggregate(F.sequence(F.lit(1).cast("long"), rounds), name, lambda acc, _: cut(acc))


def merged_families(items: DataFrame) -> DataFrame:
    """items (name, family, geometry_hash) with the family root: families that share a geometry are one, transitively."""
    twins = items.groupBy("geometry_hash").agg(F.min("family").alias("b"), F.count_distinct("family").alias("n")).where("n > 1")
    links = items.join(twins, "geometry_hash").where("family <> b").select(F.col("family").alias("a"), "b").distinct()
    roots = components(links)
    return items.join(roots.select(F.col("node").alias("family"), "comp"), "family", "left").withColumn("root", F.coalesce("comp", "family")).drop("comp")


def running_sums(rows: DataFrame, weights: dict[str, Column], *by: str) -> DataFrame:
    """rows with, for each name of weights (whole numbers), its sum over the rows ahead in the order of by (unique), and as
    total_name its sum over all: rows are dealt by range and summed within each range; the driver only adds up the ranges' sums."""
    placed = cut(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()).withColumns({f"_w_{k}": w.cast("long") for k, w in weights.items()}))
    sums = sorted(tuple(r) for r in placed.groupBy("_part").agg(*[F.sum(f"_w_{k}") for k in weights]).collect())
    first, total = [], [0] * len(weights)
    for part, *n in sums:
        first.append((part, *total))
        total = [t + x for t, x in zip(total, n)]
    first = rows.sparkSession.createDataFrame(first, "_part int, " + ", ".join(f"_f_{k} long" for k in weights))  # as many rows as ranges
    w = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.join(F.broadcast(first), "_part").withColumns({k: F.col(f"_f_{k}") + F.sum(f"_w_{k}").over(w) - F.col(f"_w_{k}") for k in weights})
    placed = placed.withColumns({f"total_{k}": F.lit(t).cast("long") for k, t in zip(weights, total)})
    return placed.drop("_part", *[f"{p}{k}" for k in weights for p in ("_f_", "_w_")])


def running(rows: DataFrame, weight: Column, *by: str) -> DataFrame:
    """rows with before, the sum of weight over the rows ahead in the order of by (unique), and total."""
    return running_sums(rows, {"before": weight}, *by).withColumnRenamed("total_before", "total")


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """rows with n, their number from 0 in the order of by (unique), and total."""
    return running(rows, F.lit(1), *by).withColumnRenamed("before", "n")


def z_stratified(items: DataFrame, fraction: float, seed: int, pcg64: bool = False) -> DataFrame:
    """items (name, root, z) with side: of each block of families in z order one family is held out.

    Families are numbered in z order range by range, so no task has to hold them all. The family is picked by hash of
    seed; with pcg64, by one draw of a seeded PCG64 per block, in the blocks' order, for splits that must match
    published ones (a number a block is then made on the driver).
    """
    if not 0 < fraction <= 0.5:
        raise ValueError("the held-out fraction must be in (0, 0.5]")
    fam = items.groupBy("root").agg(F.avg("z").alias("z"))
    fam = numbered(fam, "z", "root")
    blocks = F.greatest(F.lit(1), F.bround(F.col("total") * fraction).cast("long"))
    # block b covers [rint(b * total / blocks), rint((b + 1) * total / blocks))
    guess = F.floor(F.col("n") * blocks / F.col("total"))
    start = lambda b: F.rint(b * (F.col("total") / blocks))
    b = F.when(F.col("n") < start(guess), guess - 1).when(F.col("n") >= start(guess + 1), guess + 1).otherwise(guess)
    fam = fam.withColumn("block", b.cast("long"))
    if pcg64:
        sizes = fam.groupBy("block").agg(F.count("*").alias("k"), F.min("n").alias("first")).orderBy("block").collect()
        rng = np.random.default_rng(seed)
        drawn = [(r["block"], r["first"] + int(rng.integers(0, r["k"]))) for r in sizes]
        drawn = fam.sparkSession.createDataFrame(drawn, "block long, picked long")
        fam = fam.join(drawn, "block").withColumn("held", F.col("n") == F.col("picked"))
    else:
        pick = F.row_number().over(Window.partitionBy("block").orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), "root"), 256)))
        fam = fam.withColumn("held", pick == 1)
    return items.join(fam.select("root", "block", "held"), "root").withColumn("side", F.when(F.col("held"), "heldout").otherwise("fit")).drop("held")


def crossing(split: DataFrame) -> DataFrame:
    """Geometries found on both sides: none, in a sound split."""
    return split.where("side = 'fit'").select("geometry_hash").intersect(split.where("side = 'heldout'").select("geometry_hash"))


def audit_inputs(inputs: DataFrame, held_out: DataFrame) -> DataFrame:
    """Fit inputs whose geometry is held out."""
    return inputs.join(held_out.select("geometry_hash").distinct(), "geometry_hash", "left_semi")


def audit_scored(scored: DataFrame, held_out: DataFrame) -> DataFrame:
    """Scored patches whose geometry is not held out."""
    return scored.join(held_out.select("geometry_hash").distinct(), "geometry_hash", "left_anti")
