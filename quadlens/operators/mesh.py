"""Quads, faces and neighbours of grid surfaces, as relational steps on vertex tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadlens.functions.vectors import cross, norm, sub, triple, unit


def quads(vertices: DataFrame, keys: list[str], carry: list[str] = ()) -> DataFrame:
    """keys, row, col, corner coordinates {z,y,x}{00,10,01,11} (float) of each quad with four valid corners.

    Each vertex is sent to the four quads it is a corner of and one aggregation gathers them: a single shuffle,
    combined map-side. carry: vertex columns gathered the same way.
    """
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    names = ["z", "y", "x", *carry]
    rows = vertices.where("valid").select(*keys, "row", "col", *names, F.explode(corners).alias("k"))
    rows = rows.select(*keys, (F.col("row") - F.col("k.i")).alias("row"), (F.col("col") - F.col("k.j")).alias("col"), (F.col("k.i") * 2 + F.col("k.j")).alias("k"), *names)
    rows = rows.where("row >= 0 AND col >= 0")
    at = {0: "00", 1: "01", 2: "10", 3: "11"}
    gathered = [F.max(F.when(F.col("k") == k, F.col(n))).alias(f"{n}{at[k]}") for k in at for n in names]
    return rows.groupBy(*keys, "row", "col").agg(F.count("*").alias("_n"), *gathered).where("_n = 4").drop("_n")


def centers(q: DataFrame) -> DataFrame:
    """q with its center (cz, cy, cx): the single-precision mean of the corners, as double."""
    mean = lambda a: (((F.col(f"{a}00") + F.col(f"{a}10")) + F.col(f"{a}01")) + F.col(f"{a}11")).cast("float")
    return q.withColumns({f"c{a}": (mean(a) / F.lit(4.0)).cast("float").cast("double") for a in "zyx"})


def quad_normals(q: DataFrame) -> DataFrame:
    """q with its unit normal (nz, ny, nx), from the diagonals."""
    d = lambda s, t: tuple((F.col(f"{a}{s}") - F.col(f"{a}{t}")).cast("float").cast("double") for a in "zyx")
    n = unit(cross(d("11", "00"), d("01", "10")))
    return q.withColumns({f"n{a}": c for a, c in zip("zyx", n)})


def grid_sizes(vertices: DataFrame, keys: list[str]) -> DataFrame:
    return vertices.groupBy(*keys).agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))


def faces(vertices: DataFrame, by: list[str] = ()) -> DataFrame:
    """Triangles of all windings: by (columns that tell families apart), winding, row, col, block, u, corners a, b, c, centroid g and radius.

    u is the continuous winding coordinate: the winding plus the column's share of the surface.
    """
    keys = [*by, "winding"]
    q = quads(vertices, keys).join(grid_sizes(vertices, keys).select(*keys, "w"), keys)
    q = q.withColumn("u", F.col("winding") + (F.col("col") + 0.5) / F.greatest(F.col("w") - 1, F.lit(1)))
    tri = lambda block, *ks: F.struct(F.lit(block).alias("block"), *[F.col(f"{a}{k}").cast("double").alias(f"{n}{a}") for n, k in zip("abc", ks) for a in "zyx"])
    f = q.select(*keys, "row", "col", "u", F.explode(F.array(tri(0, "10", "00", "01"), tri(1, "10", "01", "11"))).alias("t")).select(*keys, "row", "col", "u", "t.*")
    f = f.withColumns({f"g{a}": (F.col(f"a{a}") + F.col(f"b{a}") + F.col(f"c{a}")) / 3 for a in "zyx"})
    g = triple("g")
    return f.withColumn("radius", F.greatest(*(norm(sub(triple(n), g)) for n in "abc")))


def face_normals(f: DataFrame) -> DataFrame:
    """f with its unit normal (mz, my, mx)."""
    a, b, c = (triple(n) for n in "abc")
    return f.withColumns({f"m{k}": v for k, v in zip("zyx", unit(cross(sub(b, a), sub(c, a))))})


def degenerate_faces(f: DataFrame) -> DataFrame:
    """How many faces have equal first corners, other equal corners, or corners on one line."""
    same = lambda p, q: (F.col(f"{p}z") == F.col(f"{q}z")) & (F.col(f"{p}y") == F.col(f"{q}y")) & (F.col(f"{p}x") == F.col(f"{q}x"))
    a, b, c = (triple(n) for n in "abc")
    n = cross(sub(b, a), sub(c, a))
    ab, other = same("a", "b"), same("a", "c") | same("b", "c")
    line = (n[0] == 0) & (n[1] == 0) & (n[2] == 0) & ~ab & ~other
    return f.agg(F.count("*").alias("n_faces"), F.count_if(ab).alias("n_first_equal"), F.count_if(other & ~ab).alias("n_other_equal"), F.count_if(line).alias("n_collinear"))


def boundary_quads(q: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, col, boundary: whether a side neighbour is missing."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(own).alias("own")) for i, j, own in ((0, 0, 1), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0))])
    told = q.select(*keys, "row", "col", F.explode(steps).alias("s")).select(*keys, (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), F.col("s.own").alias("own"))
    return told.groupBy(*keys, "row", "col").agg(F.max("own").alias("own"), F.count("*").alias("n")).where("own = 1").select(*keys, "row", "col", (F.col("n") < 5).alias("boundary"))


def grid_edges(points: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """Right and down neighbours among points: keys, way ('row' or 'col'), row, col and carry of both (suffix 2)."""
    out = None
    for way, i, j in (("row", 1, 0), ("col", 0, 1)):
        other = points.select(*keys, (F.col("row") - i).alias("row"), (F.col("col") - j).alias("col"), *[F.col(c).alias(f"{c}2") for c in carry])
        e = points.select(*keys, "row", "col", *carry).join(other, [*keys, "row", "col"]).withColumn("way", F.lit(way))
        out = e if out is None else out.unionByName(e)
    return out


def split_combined(vertices: DataFrame, blocks: list[tuple[int, int, int]]) -> DataFrame:
    """One wide surface cut into windings: blocks of (winding, first column, end); each keeps the next block's first column."""
    spark = vertices.sparkSession
    ranges = spark.createDataFrame(blocks, "_w int, j0 int, j1 int")  # as many rows as windings
    last = vertices.agg(F.max("col").alias("last"))
    cut = vertices.drop("winding", "surface").join(ranges, F.col("col").between(F.col("j0"), F.col("j1"))).crossJoin(F.broadcast(last)).where("col <= last")
    return cut.select(F.format_string("w%03d", "_w").alias("surface"), F.col("_w").alias("winding"), "row", (F.col("col") - F.col("j0")).alias("col"), "z", "y", "x", "valid")


def row_spacing(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """spacing: the median over surfaces of the median step between their rows' mean z."""
    rows = vertices.where("valid").groupBy(*keys, "row").agg(F.avg("z").alias("z"))
    step = F.col("z") - F.lag("z").over(Window.partitionBy(*keys).orderBy("row"))
    per = rows.withColumn("step", step).where("step IS NOT NULL").groupBy(*keys).agg(F.median("step").alias("step"))
    return per.agg(F.median("step").alias("spacing"))


def vertex_labels(q: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys, row, col, label: a vertex is labelled if every quad it touches is labelled and all agree."""
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    told = q.select(*keys, "row", "col", label, F.explode(corners).alias("k")).select(*keys, (F.col("row") + F.col("k.i")).alias("row"), (F.col("col") + F.col("k.j")).alias("col"), label)
    g = told.groupBy(*keys, "row", "col").agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.count(label).alias("n"), F.count("*").alias("all"))
    return g.where("lo = hi AND n = all").select(*keys, "row", "col", F.col("lo").alias(label))
