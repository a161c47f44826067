"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the set the operators' word and line rules name.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it (a no-op where it is installed)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset in a local run."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quadlens-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing has yet; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    fs, at = _on_disk(spark, path)
    fs.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _on_disk(spark, path)
    fs.delete(at, True)


def _on_disk(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def staged(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """df as a Parquet table at a new path (compressed, unlike a checkpoint)."""
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # an empty table leaves no file to read the schema from


HOT = 1000  # at most so many keys can have more than a thousandth of all rows


def join_hot(rows: DataFrame, told: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """rows inner-joined with told, which has one row a key with n, how many of rows have it; n goes.

    A key with more than a HOTth of all rows would land in one task. There are fewer than HOT such keys, so
    these are broadcast, and only the rows of other keys are shuffled.
    """
    told = checkpointed(told)
    total = told.agg(F.sum(n).alias("n")).first()["n"] or 0
    hot = F.broadcast(told.where(F.col(n) * HOT > total).drop(n))  # fewer than HOT rows
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(told.where(F.col(n) * HOT <= total).drop(n), keys)
    return rows.join(hot, keys).unionByName(cold)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII strings take the JVM's fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def whole_rows(docs: DataFrame, *names: str) -> DataFrame:
    """docs as one column `row` and copies of names, so that no column an operator adds can clash with those of docs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{c}`") for c in names])


def as_before(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """rows (see whole_rows) with the columns of docs; those in `new` that docs has are replaced."""
    return rows.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
