"""Closed-form layered surfaces with plantable defects, generated in the cluster from spark.range.

A family is a table of vertices: surface, winding, row, col, z, y, x (float), valid. Defects map vertices to
vertices, so they compose and stay lazy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlens.functions.vectors import TURN

DEMO_SWAP = (13, 14, 1.0, 2.2)
DEMO_COLLAPSE = (16, 4.0, 5.0, 0.9)
#: The demo's evidence patches: winding and azimuth range; the last runs over the seam and carries labels.
DEMO_PATCHES = [(11, 0.4, 1.6), (12, 2.0, 3.2), (13, 1.2, 2.4), (14, 1.0, 2.2), (15, 4.2, 5.4), (16, 4.0, 5.2), (12, 5.0, 6.2), (17, 0.2, 1.4), (12, 5.6, 8.4)]


def _spiral(winding: Column, theta: Column, pitch: float, center) -> tuple[Column, Column]:
    total = winding * TURN + theta
    radius = F.lit(pitch) * total / TURN
    return (F.lit(float(center[0])) + F.sin(total) * radius).cast("float"), (F.lit(float(center[1])) + F.cos(total) * radius).cast("float")


def family(spark: SparkSession, windings: int = 8, first: int = 10, pitch: float = 10.0, z_count: int = 20, z_step: float = 4.0, theta_count: int = 90, center=(0.0, 0.0)) -> DataFrame:
    """An ideal spiral, one surface a winding."""
    i = F.col("id")
    grid = spark.range(windings * z_count * theta_count).select(
        (first + F.floor(i / (z_count * theta_count))).cast("int").alias("winding"),
        (F.floor(i / theta_count) % z_count).cast("int").alias("row"),
        (i % theta_count).cast("int").alias("col"),
    )
    y, x = _spiral(F.col("winding"), F.col("col") * (TURN / theta_count), pitch, center)
    z = (F.col("row") * F.lit(z_step)).cast("float")
    return grid.select(F.format_string("w%03d", "winding").alias("surface"), "winding", "row", "col", z.alias("z"), y.alias("y"), x.alias("x"), F.lit(True).alias("valid"))


def patches(spark: SparkSession, spec=DEMO_PATCHES, pitch: float = 10.0, z_range=(8.0, 68.0), rows: int = 8, cols: int = 12, center=(0.0, 0.0)) -> DataFrame:
    """Evidence patches sampled from the ideal spiral: patch, row, col, z, y, x, label (null where unknown), valid.

    A patch that passes a full turn carries labels: turns since its first column, unknown at the first column
    past a seam.
    """
    table = spark.createDataFrame([(i, f"patch{i}_w{w}", w, float(a), float(b)) for i, (w, a, b) in enumerate(spec)], "k int, patch string, winding int, t0 double, t1 double")
    grid = spark.range(rows * cols).select((F.floor(F.col("id") / cols)).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    at = table.crossJoin(F.broadcast(grid))  # a grid of fixed size per patch
    theta = F.col("t0") + F.col("col") * ((F.col("t1") - F.col("t0")) / (cols - 1))
    y, x = _spiral(F.col("winding"), theta, pitch, center)
    z = (F.lit(z_range[0]) + F.col("row") * F.lit((z_range[1] - z_range[0]) / (rows - 1))).cast("float")
    turn, before = F.floor(theta / TURN), F.floor((theta - (F.col("t1") - F.col("t0")) / (cols - 1)) / TURN)
    label = F.when(F.col("t1") > TURN, F.when((F.col("col") > 0) & (turn != before), None).otherwise(turn.cast("double")))
    return at.select("patch", "row", "col", z.alias("z"), y.alias("y"), x.alias("x"), label.alias("label"), F.lit(True).alias("valid"))


def _in_band(t0: float, t1: float, theta_count: int) -> Column:
    theta = F.col("col") * (TURN / theta_count)
    return (theta >= t0) & (theta < t1)


def swap_band(vertices: DataFrame, w1: int, w2: int, t0: float, t1: float, theta_count: int = 90) -> DataFrame:
    """Two windings exchange their geometry inside an azimuth band."""
    w = F.when(_in_band(t0, t1, theta_count) & F.col("winding").isin(w1, w2), F.lit(w1 + w2) - F.col("winding")).otherwise(F.col("winding")).cast("int")
    return vertices.withColumn("winding", w).withColumn("surface", F.format_string("w%03d", "winding"))


def collapse_gap(vertices: DataFrame, winding: int, t0: float, t1: float, factor: float = 0.95, theta_count: int = 90) -> DataFrame:
    """One winding pulled towards its inner neighbour inside an azimuth band."""
    inner = vertices.where(F.col("winding") == winding - 1).select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("y").alias("_y"), F.col("x").alias("_x"))
    hit = (F.col("winding") == winding) & _in_band(t0, t1, theta_count)
    rest = F.lit(1.0 - factor).cast("float")
    moved = vertices.where(hit).join(inner, (F.col("row") == F.col("_r")) & (F.col("col") == F.col("_c")))
    pull = lambda c: (F.col(f"_{c}") + (F.col(c) - F.col(f"_{c}")) * rest).cast("float").alias(c)
    moved = moved.select("surface", "winding", "row", "col", "z", pull("y"), pull("x"), "valid")
    return vertices.where(~hit).unionByName(moved)


def _radially(vertices: DataFrame, grow, center=(0.0, 0.0)) -> DataFrame:
    """r becomes r + grow(theta) for each vertex."""
    cy, cx = (F.lit(float(c)) for c in center)
    dy, dx = F.col("y").cast("double") - cy, F.col("x").cast("double") - cx
    r = F.sqrt(dy * dy + dx * dx)
    new = r + grow(F.atan2(dy, dx))
    safe = F.greatest(r, F.lit(1e-9))
    return vertices.withColumns({"y": (dy / safe * new + cy).cast("float"), "x": (dx / safe * new + cx).cast("float")})


def radial_drift(vertices: DataFrame, amplitude: float, center=(0.0, 0.0)) -> DataFrame:
    return _radially(vertices, lambda t: F.lit(amplitude) * F.sin(t), center)


def displace(vertices: DataFrame, amount: float, z_band: tuple[float, float] | None = None, windings: list[int] | None = None) -> DataFrame:
    """A constant radial shift of some windings inside a half-open z band."""
    hit = F.lit(True)
    if z_band:
        hit = hit & (F.col("z") >= z_band[0]) & (F.col("z") < z_band[1])
    if windings is not None:
        hit = hit & F.col("winding").isin(windings)
    return _radially(vertices, lambda t: F.when(hit, F.lit(amount)).otherwise(F.lit(0.0)))


def pitch_ramp(vertices: DataFrame, pitch: float, z0: float, span: float) -> DataFrame:
    """A radial shift that grows with z from nothing to one pitch."""
    share = F.least(F.greatest((F.col("z").cast("double") - z0) / span, F.lit(0.0)), F.lit(1.0))
    return _radially(vertices, lambda t: F.lit(pitch) * share)


def punch_holes(vertices: DataFrame, count: int, size: int, rows: int, cols: int, seed: int = 0) -> DataFrame:
    """count square blocks of vertices invalid in every surface; their corners follow from seed."""
    hit = F.lit(False)
    for k in range(count):
        i, j = (7919 * k + 104729 * seed + 3) % max(rows - size, 1), (6101 * k + 15485863 * seed + 5) % max(cols - size, 1)
        hit = hit | (F.col("row").between(i, i + size - 1) & F.col("col").between(j, j + size - 1))
    return vertices.withColumn("valid", F.col("valid") & ~hit)


def _uniform(*parts) -> Column:
    """A number in (0, 1) from a hash of parts; the same whatever the partitioning."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def jitter(vertices: DataFrame, scale: float, seed: int = 0, key: str = "winding") -> DataFrame:
    """Normal noise of this scale on every coordinate of every vertex, by hash of seed and cell."""
    def normal(axis: str) -> Column:
        at = [seed, F.col(key), F.col("row"), F.col("col"), axis]
        return F.sqrt(-2 * F.log(_uniform(*at, "r"))) * F.cos(TURN * _uniform(*at, "t"))

    return vertices.withColumns({a: (F.col(a).cast("double") + F.lit(scale) * normal(a)).cast("float") for a in "zyx"})


def demo(spark: SparkSession, clean: bool = False) -> DataFrame:
    """The demo family: 8 windings, with a sheet swap and a collapsed gap unless clean."""
    out = family(spark)
    return out if clean else collapse_gap(swap_band(out, *DEMO_SWAP), *DEMO_COLLAPSE)


def strips(spark: SparkSession, pitch: float = 10.0, center=(0.0, 0.0)) -> DataFrame:
    """Annotated point strips on the ideal spiral: source, collection, name, point, z, y, x, wind_a.

    Along one winding; over three quarters of a turn; with one point a pitch off; across windings with relative
    winding numbers, some of them missing; and one far from any surface.
    """
    rows = []
    def add(k, name, points):
        for n, (w, t, dr, a) in enumerate(points):
            total = w * TURN + t
            r = pitch * total / TURN + dr
            rows.append(("demo", k, name, n, 20.0 + 2.0 * n, center[0] + math.sin(total) * r, center[1] + math.cos(total) * r, a))
    add(1, "same", [(13, 0.2 + 0.125 * n, 0.0, None) for n in range(9)])
    add(2, "arc", [(14, 2.5 + TURN * 0.75 * n / 11, 0.0, None) for n in range(12)])
    add(3, "off", [(11, 3.0 + 0.1 * n, pitch if n == 4 else 0.3, None) for n in range(8)])
    add(4, "ladder", [(11 + n, 1.5, 0.5, float(n)) for n in range(4)] + [(15, 1.5, 0.0, None)])
    add(5, "far", [(30 + n, 0.5, 0.0, None) for n in range(3)])
    add(6, "edge", [(12, 4.0 + 0.05 * n, 8.0 if n == 2 else 0.0, None) for n in range(5)])
    return spark.createDataFrame(rows, "source string, collection long, name string, point long, z double, y double, x double, wind_a double")
