"""Connected components on the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that is unset in a local run."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quadlens-")
        sc.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing has yet; removed when the driver ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage, as a table in the shared folder.

    Unlike a checkpoint, a table's size is known. A checkpoint keeps the size its plan was guessed to have, which joins
    multiply: in a loop of joins the number of its digits grows from round to round without end.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # an empty table leaves no file to read the schema from


HOT = 1000  # at most so many keys can have more than a thousandth of all rows


def join_counted(rows: DataFrame, told: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """rows inner-joined with told, which has one row a key and in n how many of rows have it; n goes.

    Keys with more than a HOTth of the rows, fewer than HOT, are broadcast, so that none of them lands in one task; the rows
    of all other keys are shuffled.
    """
    total = told.agg(F.sum(n)).first()[0] or 0
    hot, cold = told.where(F.col(n) * HOT > total).drop(n), told.where(F.col(n) * HOT <= total).drop(n)
    if cold.isEmpty():
        return rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node each node of links (a, b) is connected with.

    Every node points to another one of its component. In a round it and, through it, the node it points to hear of the least
    node that its neighbours' pointers point to, and pointers to pointers are cut short; so trees are hooked on to trees as a
    whole, and rounds grow with the log of the number of nodes, whatever the order of labels along a path.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    alone = links.where("a = b").select(F.col("a").alias("node")).distinct()
    nodes = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("f"))
    labels = cut(nodes.unionByName(alone.join(nodes, "node", "left_anti").select("node", F.col("node").alias("f"))))
    while True:
        two = labels.join(labels.select(F.col("node").alias("f"), F.col("f").alias("ff")), "f")
        heard = edges.join(two.select(F.col("node").alias("b"), "ff"), "b").groupBy(F.col("a").alias("node")).agg(F.min("ff").alias("h"))
        x = two.join(heard, "node", "left").withColumn("h", F.coalesce("h", "ff"))
        own = x.select("node", F.least("f", "ff", "h").alias("new"), F.col("f").alias("old"))
        told = x.select(F.col("f").alias("node"), F.col("h").alias("new"), F.when(F.lit(False), F.col("f")).alias("old"))
        step = cut(own.unionByName(told).groupBy("node").agg(F.min("new").alias("f"), F.max("old").alias("old")))
        labels = step.select("node", "f")
        if step.where("f <> old").isEmpty():
            return labels.withColumnRenamed("f", "comp")
