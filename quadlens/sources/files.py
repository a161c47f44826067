"""Surfaces, point strips, axes and reports on disk.

A collection of surfaces (a run's windings, or patches) is a folder with `vertices/`, a Parquet table
(surface, row, col, z, y, x and, if there, valid, mask and label), and `meta/`, JSON lines with a row per
surface: its size, its bounding box in (x, y, z) order and, for one wide surface that holds several windings, their
column ranges. Point strips, axes and reports are JSON. No TIFF codec is needed; what is in TIFF files has to be
written as such tables first.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlens.operators import mesh

#: How surfaces of a run are named (fixed): winding, spliced or not, and an optional tag.
WINDING = r"^w(\d+)(_spliced)?(?:_.+)?$"
VARIANTS = ("spliced", "plain", "any")
#: The point-strip files' version key and the versions that are read (fixed).
VERSION_KEY, VERSIONS = "vc_pointcollections_json_version", ("1",)
POINTS = "source string, collection long, name string, point long, z double, y double, x double, wind_a double, is_absolute boolean"
RANGES = "array<struct<winding: int, j0: int, j1: int>>"
META = f"surface string, h int, w int, n_valid long, bbox array<array<double>>, ranges {RANGES}"


def finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def write_surfaces(vertices: DataFrame, path: str, ranges: list[tuple[int, int, int]] | None = None) -> None:
    """vertices (surface, row, col, z, y, x, valid and more) as a collection; ranges: (winding, first column, last) of a wide surface."""
    ends = [F.array(*[f(F.when(F.col("valid"), F.col(a).cast("double"))) for a in "xyz"]) for f in (F.min, F.max)]
    told = F.from_json(F.lit(json.dumps([dict(zip(("winding", "j0", "j1"), r)) for r in ranges or []])), RANGES)
    meta = vertices.groupBy("surface").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"), F.count_if("valid").alias("n_valid"), F.array(*ends).alias("bbox")).withColumn("ranges", told)
    meta.write.mode("overwrite").json(f"{path}/meta")
    drop = [c for c in ("winding",) if c in vertices.columns]
    vertices.drop(*drop).repartition("surface").sortWithinPartitions("surface", "row", "col").write.mode("overwrite").parquet(f"{path}/vertices")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(META).json(f"{path}/meta")


def read_surfaces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, errors) of a collection: a vertex is valid unless it says otherwise, is masked (0), is the sentinel (-1, -1, -1)
    or is not finite. Labels that are zero all over a surface are none. Surfaces without a valid quad, or with a cell twice, are left out and told in errors (surface, error)."""
    rows = spark.read.parquet(f"{path}/vertices")
    columns = rows.columns
    valid = finite("z") & finite("y") & finite("x") & ~((F.col("z") == -1) & (F.col("y") == -1) & (F.col("x") == -1))
    for name, good in (("valid", F.coalesce(F.col("valid") if "valid" in rows.columns else F.lit(True), F.lit(True))), ("mask", F.coalesce(F.col("mask") != 0, F.lit(True)) if "mask" in rows.columns else F.lit(True))):
        valid = valid & good
    label = F.col("label").cast("double") if "label" in rows.columns else F.lit(None).cast("double")
    label = F.when(~F.isnan(label), label)
    rows = rows.select(F.col("surface").cast("string").alias("surface"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(a).cast("float").alias(a) for a in "zyx"], label.alias("label"), valid.alias("valid"))
    if "label" in columns:  # a grid of nothing but zeros tells of one winding, not of relative ones
        some = rows.where("label <> 0").select("surface").distinct().withColumn("_told", F.lit(True))
        rows = rows.join(some, "surface", "left").withColumn("label", F.when(F.col("_told"), F.col("label"))).drop("_told")
    cells = rows.groupBy("surface", "row", "col").agg(F.count("*").alias("n")).groupBy("surface").agg(F.max("n").alias("most"))
    quads = mesh.quads(rows, ["surface"]).groupBy("surface").agg(F.count("*").alias("n_quads"))
    told = cells.join(quads, "surface", "left")
    error = F.when(F.col("most") > 1, "a cell is given twice").when(F.col("n_quads").isNull(), "no valid quad")
    errors = told.select("surface", error.alias("error")).where("error IS NOT NULL")
    return rows.join(errors, "surface", "left_anti"), errors


def run_windings(vertices: DataFrame, variant: str = "spliced") -> DataFrame:
    """vertices of the surfaces that a run's winding names choose, with `winding`: spliced ones where there are any, or plain ones only."""
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {', '.join(VARIANTS)}")
    names = vertices.select("surface").distinct().where(F.col("surface").rlike(WINDING))
    names = names.select("surface", F.regexp_extract("surface", WINDING, 1).cast("int").alias("winding"), (F.regexp_extract("surface", WINDING, 2) != "").alias("spliced"))
    twice = names.groupBy("winding", "spliced").agg(F.sort_array(F.collect_list("surface")).alias("names")).where(F.size("names") > 1).limit(1).collect()
    if twice:
        raise ValueError(f"{' and '.join(twice[0]['names'])} are the same winding {twice[0]['winding']}")
    if variant == "plain":
        names = names.where(~F.col("spliced"))
    chosen = names.groupBy("winding").agg(F.max_by("surface", "spliced").alias("surface"))
    return vertices.join(chosen, "surface")


def read_run(spark: SparkSession, path: str, variant: str = "spliced") -> DataFrame:
    """surface, winding, row, col, z, y, x, valid of a run's windings; one wide surface with column ranges is cut into them."""
    vertices, errors = read_surfaces(spark, path)
    bad = errors.where(F.col("surface").rlike(WINDING)).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['surface']}: {bad[0]['error']}")
    found = run_windings(vertices, variant)
    keep = ["surface", "winding", "row", "col", "z", "y", "x", "valid"]
    if not found.isEmpty():
        return found.select(*keep)
    wide = read_meta(spark, path).where(F.size("ranges") > 0).limit(2).collect()
    if len(wide) != 1:
        raise ValueError(f"{path}: {'several' if wide else 'no'} surfaces with column ranges, and none named like a winding")
    blocks = [(r["winding"], r["j0"], r["j1"]) for r in wide[0]["ranges"]]
    return mesh.split_combined(vertices.where(F.col("surface") == wide[0]["surface"]), blocks).select(*keep)


def read_patches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(patches, errors): vertices with `patch` and, where known, `label`; a folder without one good patch is an error."""
    vertices, errors = read_surfaces(spark, path)
    if vertices.isEmpty():
        raise ValueError(f"{path}: no patch could be read")
    return vertices.withColumnRenamed("surface", "patch"), errors.withColumnRenamed("surface", "patch")


def loader_stats(vertices: DataFrame) -> DataFrame:
    """One row: surfaces, the least and the median share of valid vertices, sizes and the range of z."""
    per = vertices.groupBy("surface").agg(F.avg(F.col("valid").cast("double")).alias("share"), (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"), F.min(F.when(F.col("valid"), F.col("z"))).alias("lo"), F.max(F.when(F.col("valid"), F.col("z"))).alias("hi"))
    return per.agg(F.count("*").alias("n_surfaces"), F.percentile("share", F.lit(0.1)).alias("valid_p10"), F.percentile("share", F.lit(0.5)).alias("valid_p50"), F.max("h").alias("max_h"), F.max("w").alias("max_w"), F.min("lo").alias("z_min"), F.max("hi").alias("z_max"))


def sampled(vertices: DataFrame, n: int, seed: int) -> DataFrame:
    """The vertices of n surfaces, drawn by hash of the seed."""
    few = vertices.select("surface").distinct().orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), "surface"), 256)).limit(n)
    return vertices.join(few, "surface", "left_semi")


def read_points(spark: SparkSession, *paths: str) -> DataFrame:
    """Annotated strips (POINTS) from point-collection files: positions as zyx, or else p (x, y, z) reversed; a missing wind_a is null."""
    point = "struct<zyx: array<double>, p: array<double>, wind_a: double>"
    schema = f"struct<{VERSION_KEY}: string, collections: map<string, struct<name: string, metadata: struct<winding_is_absolute: boolean>, points: map<string, {point}>>>>"
    files = spark.read.text(list(paths), wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"), F.from_json("value", schema).alias("j"))
    version = F.coalesce(F.col(f"j.{VERSION_KEY}"), F.lit("missing"))
    wrong = F.concat(F.col("source"), F.lit(f": unsupported {VERSION_KEY} "), version, F.lit(f" (supported: {', '.join(VERSIONS)})"))
    files = files.select("source", F.when(version.isin(*VERSIONS), F.col("j.collections")).otherwise(F.raise_error(wrong).cast("void")).alias("collections"))
    each = files.select("source", F.explode("collections").alias("id", "c"))
    each = each.select("source", F.col("id").cast("long").alias("collection"), F.coalesce("c.name", F.concat(F.lit("collection_"), "id")).alias("name"), F.coalesce("c.metadata.winding_is_absolute", F.lit(False)).alias("is_absolute"), F.explode("c.points").alias("point", "q"))
    at = F.coalesce("q.zyx", F.reverse("q.p"))
    wind = F.when(~F.isnan("q.wind_a"), F.col("q.wind_a"))
    return each.select("source", "collection", "name", F.col("point").cast("long").alias("point"), *[F.get(at, i).alias(a) for i, a in enumerate("zyx")], wind.alias("wind_a"), "is_absolute")


def points_in_window(points: DataFrame, z_range: tuple[float, float], least: int = 1) -> DataFrame:
    """The points inside the window, of strips that keep at least so many of them."""
    inside = points.where(F.col("z").between(*z_range))
    return inside.join(inside.groupBy("source", "collection").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n"), ["source", "collection"], "left_semi")


def read_umbilicus(spark: SparkSession, given: str) -> DataFrame:
    """z, y, x of an axis: 'y,x', or a JSON file with a list of (z, y, x) or {"control_points": ...}; other shapes are refused."""
    parts = given.split(",")
    if len(parts) == 2 and not given.endswith(".json"):
        points = [(0.0, *map(float, parts))]
    else:
        text = spark.read.text(given, wholetext=True).first()["value"]  # one axis
        points = json.loads(text)
        points = points.get("control_points") if isinstance(points, dict) else points
        if not isinstance(points, list) or not points or not all(isinstance(p, (list, tuple)) and len(p) == 3 for p in points):
            raise ValueError(f"{given}: an axis is a list of (z, y, x)")
    if not all(abs(float(v)) < float("inf") for p in points for v in p):
        raise ValueError(f"{given}: an axis needs finite numbers")
    return spark.createDataFrame([tuple(map(float, p)) for p in points], "z double, y double, x double")


def found_files(spark: SparkSession, path: str, name: str = "*.parquet", recursive: bool = True) -> DataFrame:
    """path, sha256 of the files of that name in a folder, and in those below it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", str(recursive).lower()).load(path if recursive else f"{path}/*")
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def surface_hashes(vertices: DataFrame) -> DataFrame:
    """surface, geometry_hash: SHA-256 over all cells of a surface in order (float32, invalid ones as such)."""
    cell = F.concat_ws(",", "row", "col", *[F.when(F.col("valid"), F.hex(F.col(a).cast("float").cast("string").cast("binary"))).otherwise("") for a in "zyx"])
    rows = vertices.select("surface", "row", F.struct("col", cell.alias("c")).alias("c")).groupBy("surface", "row").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x["c"]), ";"), 256).alias("h"))
    return rows.groupBy("surface").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "h"))), lambda x: x["h"]), ""), 256).alias("geometry_hash"))


def z_center(meta: DataFrame, vertices: DataFrame) -> DataFrame:
    """surface, z: the middle of the bounding box; without one, or at its sentinel -1, the mean z of valid vertices; without these, 0."""
    box = (F.col("bbox")[0][2] + F.col("bbox")[1][2]) / 2
    mean = vertices.where("valid").groupBy("surface").agg(F.avg(F.col("z").cast("double")).alias("mean_z"))
    return meta.join(mean, "surface", "left").select("surface", F.coalesce(F.when(box != -1, box), "mean_z", F.lit(0.0)).alias("z"))
