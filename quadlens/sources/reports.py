"""Reports and splits as files: JSON payloads, Markdown views of them, tables beside them.

A report is a folder: `report.json` holds what is bounded (aggregates, counters, the worst bins), `patches/`,
`bins/` and `strips/` hold the tables it was made from (JSON lines, Parquet), however long they are. The Markdown view
is a function of these files alone. All paths go through the file system that Spark is set up with.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlens.operators.compare import deltas, natural_key, paired_bootstrap

TOP_PATCHES, TOP_OFFENDERS = 50, 10


def _open(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _open(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).first()  # one report
    return row["value"] if row else ""


def plain(value):
    """A row as JSON values; numbers that are not finite are null."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def shown(value, kind: str = ".3f") -> str:
    if value is None:
        return "n/a"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return str(value) if isinstance(value, int) else f"{100 * value:.1f} %" if kind == "%" else format(value, kind)


def table(names: list[str], rows: list[list[str]]) -> str:
    return "\n".join(["| " + " | ".join(x) + " |" for x in (names, ["---"] * len(names), *rows)])


def write_report(spark: SparkSession, out: str, meta: dict, aggregate: DataFrame | None = None, patches: DataFrame | None = None, intrinsic: DataFrame | None = None, worst: DataFrame | None = None, bins: DataFrame | None = None) -> dict:
    """The payload that went into report.json; tables are written beside it, then the Markdown view."""
    payload = {"meta": meta, "heldout_aggregate": plain(aggregate.first()) if aggregate is not None else None, "intrinsic": plain(intrinsic.first()) if intrinsic is not None else None}
    if worst is not None:
        payload["intrinsic"]["worst"] = [plain(r) for r in worst.collect()]  # a top list
    for name, rows in (("patches", patches), ("bins", bins)):
        if rows is not None:
            rows.write.mode("overwrite").json(f"{out}/{name}")
    write_text(spark, f"{out}/report.json", json.dumps(payload, indent=2, sort_keys=True))
    render(spark, out)
    return payload


def worst_patches(patches: DataFrame, top: int = TOP_PATCHES) -> DataFrame:
    """The patches with the largest 99th percentile first."""
    return patches.orderBy(F.desc_nulls_last("dist_p99"), "patch").limit(top)


def render(spark: SparkSession, out: str) -> str:
    """report.md anew from report.json and the tables beside it."""
    payload = json.loads(read_text(spark, f"{out}/report.json"))
    parts = ["# Report", table(["setting", "value"], [[k, shown(v)] for k, v in sorted(payload["meta"].items())])]
    if payload["heldout_aggregate"]:
        share = lambda k: "%" if k.startswith(("frac", "mean", "min", "within")) else ".3f"
        parts += ["## Held-out evidence", table(["metric", "value"], [[k, shown(v, share(k))] for k, v in payload["heldout_aggregate"].items()])]
        rows = worst_patches(spark.read.json(f"{out}/patches")).collect()
        names = [c for c in ("patch", "n_points", "dist_p50", "dist_p90", "dist_p99", "frac_within_tau", "sheet_consistency", "modal_winding") if rows and c in rows[0]]
        parts += [f"### Patches with the largest distances ({len(rows)})", table(names, [[shown(r[c]) for c in names] for r in rows])]
    if payload["intrinsic"]:
        counters = {k: v for k, v in payload["intrinsic"].items() if k != "worst"}
        parts += ["## Order of windings", table(["metric", "value"], [[k, shown(v, "%" if k.startswith("frac") else ".4g")] for k, v in counters.items()])]
        worst = payload["intrinsic"].get("worst", [])[:TOP_OFFENDERS]
        if worst:
            parts += ["### Worst bins", table(list(worst[0]), [[shown(v, ".4g") for v in r.values()] for r in worst])]
    text = "\n\n".join(parts) + "\n"
    write_text(spark, f"{out}/report.md", text)
    return text


def in_step(spark: SparkSession, out: str) -> bool:
    """Whether report.md is what report.json says."""
    before = read_text(spark, f"{out}/report.md")
    return before.rstrip("\n") == render(spark, out).rstrip("\n")


def report_rows(spark: SparkSession, out: str) -> DataFrame:
    """metric, value of a report's numbers; nested ones by path."""
    def paths(value, prefix=""):
        for k, v in value.items():
            if isinstance(v, dict):
                yield from paths(v, f"{prefix}{k}.")
            elif isinstance(v, (int, float)) and not isinstance(v, bool):
                yield f"{prefix}{k}", float(v)

    payload = json.loads(read_text(spark, f"{out}/report.json"))
    parts = ("heldout_aggregate", "intrinsic")
    if not isinstance(payload, dict) or not all(isinstance(payload.get(k, 0), (dict, type(None))) for k in parts):
        raise ValueError(f"{out}/report.json is no report")
    rows = list(paths({k: payload[k] or {} for k in parts}))
    return spark.createDataFrame(rows, "metric string, value double")


def report_patches(spark: SparkSession, out: str, unseen: bool = False) -> DataFrame:
    """A report's patches; with unseen, the numbers over their unseen points, for patches that have some."""
    rows = spark.read.json(f"{out}/patches")
    if not unseen:
        return rows
    names = [c for c in rows.columns if c.startswith("unseen_")]
    return rows.where("n_unseen > 0").select("patch", F.col("n_unseen").alias("n_points"), *[F.col(c).alias(c.removeprefix("unseen_")) for c in names])


def bootstrap(spark: SparkSession, a: str, b: str, metric: str, unseen: bool = False, draws: int = 20_000, seed: int = 20260731) -> DataFrame:
    """The difference of a patch metric between two reports with its 95 % interval over resampled patches; each report weighs a
    patch by its own points. With unseen, over the numbers of the patches' unseen points."""
    one, two = (report_patches(spark, x, unseen).select("patch", F.col("n_points").alias("weight"), F.col(metric).alias("value")) for x in (a, b))
    pairs = one.select(F.col("patch").alias("item"), "weight", F.col("value").alias("a")).join(two.select(F.col("patch").alias("item"), F.col("weight").alias("weight_b"), F.col("value").alias("b")), "item")
    if pairs.isEmpty():
        raise ValueError(f"{a} and {b} have no patch in common")
    return paired_bootstrap(pairs, draws, seed)


def compare(spark: SparkSession, a: str, b: str, out: str) -> DataFrame:
    """metric, a, b, delta of what both reports hold, written as Markdown in natural order."""
    rows = deltas(report_rows(spark, a), report_rows(spark, b)).orderBy(natural_key(F.col("metric")))
    if rows.isEmpty():
        raise ValueError(f"{a} and {b} have no metric in common")
    lines = [[r["metric"], shown(r["a"], ".4g"), shown(r["b"], ".4g"), shown(r["delta"], "+.4g")] for r in rows.collect()]  # a row a metric
    write_text(spark, out, "\n\n".join(["# Comparison", table(["metric", "a", "b", "delta"], lines)]) + "\n")
    return rows


def write_strips(spark: SparkSession, out: str, meta: dict, verdicts: DataFrame, offenders: DataFrame, pooled: DataFrame) -> dict:
    """Annotation report: strips by agreement, those without any first, each with its worst offset."""
    worst = offenders.groupBy("source", "collection").agg(F.max_by("offset", F.abs("offset")).alias("worst_offset"))
    rows = verdicts.join(worst, ["source", "collection"], "left").withColumn("agreement", F.try_divide("n_agree", "n_within_tau"))
    rows.write.mode("overwrite").json(f"{out}/strips")
    offenders.write.mode("overwrite").json(f"{out}/offenders")
    payload = {"meta": meta, "pooled": {r["kind"]: {k: v for k, v in plain(r).items() if k != "kind"} for r in pooled.collect()}}  # a row a kind
    write_text(spark, f"{out}/annotations.json", json.dumps(payload, indent=2, sort_keys=True))
    top = strips_by_agreement(rows).limit(TOP_PATCHES).collect()
    names = ["source", "collection", "name", "kind", "n_points", "n_within_tau", "n_agree", "agreement", "worst_offset"]
    blocks = [table(["kind", "decidable points", "agreement"], [[k, shown(v["n_within_tau"]), shown(v["agreement"], "%")] for k, v in payload["pooled"].items()]), table(names, [[shown(r[c]) for c in names] for r in top])]
    write_text(spark, f"{out}/annotations.md", "\n\n".join(["# Annotated strips", *blocks]) + "\n")
    return payload


def strips_by_agreement(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.coalesce("agreement", F.lit(0.0)), "source", "collection")


def write_split(items: DataFrame, vertices: DataFrame, out: str, meta: dict) -> dict:
    """Both sides of a split as collections, and its manifest. Old files go, so no copy stays on the wrong side."""
    from quadlens.sources.files import write_surfaces

    spark = items.sparkSession
    for side in ("fit", "heldout"):
        names = items.where(F.col("side") == side).select(F.col("name").alias("surface"))
        write_surfaces(vertices.join(names, "surface", "left_semi"), f"{out}/{side}")
    items.select("name", "side", "root", "geometry_hash").write.mode("overwrite").json(f"{out}/manifest")
    counts = items.agg(F.count("*").alias("n_patches"), F.count_distinct("root").alias("n_families"), F.count_if(F.col("side") == "heldout").alias("n_heldout")).first()
    meta = meta | counts.asDict()
    write_text(spark, f"{out}/split.json", json.dumps(meta, indent=2, sort_keys=True))
    return meta
