"""Layered surfaces, evidence patches and annotated strips woven from rows of tables, so that they grow with them.

A row's key gives its place on a spiral, its other columns give noise and damage. Rows without a key, or with a key below
zero, are no vertex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlens.functions.vectors import TURN

FIRST, WINDINGS, PITCH = 10, 8, 10.0
THETA, Z_STEP = 90, 4.0  # columns of a surface, and how far rows lie apart
PATCH_ROWS, PATCH_COLS = 5, 8
STRIP = 10  # points of a strip


def _spiral(winding: Column, theta: Column, more: Column) -> tuple[Column, Column]:
    total = winding * TURN + theta
    radius = F.lit(PITCH) * total / TURN + more
    return F.sin(total) * radius, F.cos(total) * radius


def _noise(value: Column, scale: float) -> Column:
    """Whole units of a value, modulo 100, as a number from -scale to scale."""
    return (F.pmod(F.floor(value), F.lit(100)).cast("double") / 100 - 0.5) * (2 * scale)


def family(orders: DataFrame) -> DataFrame:
    """One surface a winding, a vertex an order: keys run over windings, then columns, then rows. The price moves a vertex
    by up to a tenth along the radius; every 89th whole price is a vertex without a place."""
    k = F.col("o_orderkey")
    cell = orders.where("o_orderkey >= 0").select((FIRST + k % WINDINGS).cast("int").alias("winding"), F.floor(k / WINDINGS).alias("_n"), F.coalesce("o_totalprice", F.lit(0.0)).alias("_v"))
    cell = cell.select("winding", F.floor(F.col("_n") / THETA).cast("int").alias("row"), (F.col("_n") % THETA).cast("int").alias("col"), "_v")
    y, x = _spiral(F.col("winding"), F.col("col") * (TURN / THETA), _noise(F.col("_v"), 0.1))
    z = (F.col("row") * F.lit(Z_STEP)).cast("float")
    return cell.select(F.format_string("w%03d", "winding").alias("surface"), "winding", "row", "col", z.alias("z"), y.cast("float").alias("y"), x.cast("float").alias("x"), (F.floor("_v") % 89 != 0).alias("valid"))


def patches(customers: DataFrame) -> DataFrame:
    """Evidence patches of PATCH_ROWS x PATCH_COLS customers: patch, number, row, col, z, y, x, label, valid.

    The balance moves a vertex by up to two tenths along the radius. Every ninth patch runs over the seam and carries
    labels: turns since its first column, unknown at the first column past the seam.
    """
    size = PATCH_ROWS * PATCH_COLS
    k = F.col("c_custkey")
    at = customers.where("c_custkey >= 0").select(F.floor(k / size).alias("number"), F.floor(k % size / PATCH_COLS).cast("int").alias("row"), (k % PATCH_COLS).cast("int").alias("col"), F.coalesce("c_acctbal", F.lit(0.0)).alias("_v"))
    n, seam = F.col("number"), F.col("number") % 9 == 8
    winding = F.lit(11) + n % 7
    start = F.when(seam, 5.6).otherwise((n * 7 % 50).cast("double") / 10)
    step = F.when(seam, 2.8).otherwise(1.2) / (PATCH_COLS - 1)
    theta = start + F.col("col") * step
    y, x = _spiral(winding, theta, _noise(F.col("_v"), 0.2))
    turn, before = F.floor(theta / TURN), F.floor((theta - step) / TURN)
    label = F.when(seam, F.when((F.col("col") > 0) & (turn != before), None).otherwise(turn.cast("double")))
    z = ((n + F.col("row")) * F.lit(2.0)).cast("float")
    return at.select(F.format_string("patch%d_w%d", n, winding).alias("patch"), "number", "row", "col", z.alias("z"), y.cast("float").alias("y"), x.cast("float").alias("x"), label.alias("label"), F.lit(True).alias("valid"))


def strips(parts: DataFrame) -> DataFrame:
    """Annotated strips of STRIP parts each: source, collection, name, point, z, y, x, wind_a.

    By turns: along one winding; over three quarters of a turn; along one winding with the smallest parts a pitch off;
    across windings with relative winding numbers, those of the largest parts missing; and far from any surface.
    """
    k = F.col("p_partkey")
    at = parts.where("p_partkey >= 0").select(F.floor(k / STRIP).alias("collection"), (k % STRIP).alias("point"), F.coalesce("p_size", F.lit(1)).alias("_v"))
    c, p, kind = F.col("collection"), F.col("point"), F.col("collection") % 5
    name = F.element_at(F.array(*map(F.lit, ("same", "arc", "off", "ladder", "far"))), (kind + 1).cast("int"))
    winding = F.when(kind == 3, 11 + p % 5).when(kind == 4, 30 + p).otherwise(11 + c % 6)
    theta = F.when(kind == 3, F.lit(1.5)).otherwise((c % 6).cast("double") + p * F.when(kind == 1, TURN * 0.75 / (STRIP - 1)).otherwise(0.1))
    more = F.when((kind == 2) & (F.col("_v") <= 3), PITCH).otherwise(0.3)
    y, x = _spiral(winding, theta, more)
    told = F.when((kind == 3) & (F.col("_v") < 48), (p % 5).cast("double"))
    return at.select(F.lit("parts").alias("source"), "collection", F.format_string("%s%d", name, c).alias("name"), "point", ((c % 20) * 2.0 + p).cast("double").alias("z"), y.alias("y"), x.alias("x"), told.alias("wind_a"))
