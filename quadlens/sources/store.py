"""A store of scenarios: one table, one partition a scenario, written again without touching the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(rows: DataFrame, path: str, *by: str) -> None:
    """Writes the partitions (columns `by`) that rows have, in place of what the store had of them; others stay.

    A partition is replaced when the job commits, so a run that fails or is repeated leaves one copy or the old one.
    """
    if not by or any(c not in rows.columns for c in by):
        raise ValueError(f"a store is partitioned by columns of its rows, not by {list(by)}")
    rows.repartition(*by, F.pmod(F.xxhash64(*[c for c in rows.columns if c not in by]), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def load(spark: SparkSession, path: str, **only) -> DataFrame:
    """The store's rows, of all scenarios or of those whose partition columns have the given values (others are not read)."""
    rows = spark.read.parquet(path)
    for c, v in only.items():
        rows = rows.where(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return rows


def missing(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Rows of wanted (partition columns) that the store has not yet: what a broken-off run has still to do."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return wanted
    return wanted.join(spark.read.parquet(path).select(*wanted.columns).distinct(), wanted.columns, "left_anti")
