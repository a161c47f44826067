"""Line dedup over levelled sorted runs.

Documents come in batches of ascending doc_id. The keys of the lines seen so far live in runs: tables
bucketed and sorted by the key's hash. A batch's keys are merge-anti-joined with every run; those no run
holds become a new run of level 0. When a level has `fanout` runs, they are merged into one of the next
level, so a key is rewritten a logarithmic number of times. Everything is DataFrame work in the JVM.

A line that very many documents hold is one row among the keys; back at the documents' lines its owner is
broadcast (see join_hot), so that its lines do not meet in one task.

Defined results: a null or empty text is one empty line; a null doc_id takes no part and keeps every
line; rows that repeat a doc_id are one document, and each row loses its own lines; extra columns are passed
through by dedup_documents (n_chars need not be there) and left out of the report, whatever their names; an empty
table gives an empty result. Keys are compared by 128 bits of hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlens.llm.common import ASCII_SPACE, as_before, checkpointed, join_hot, lower_ascii, new_path, partitions, remove, staged, whole_rows

KEY = ["h1", "h2"]
BATCH_DOCUMENTS = 50_000_000
BROADCAST_BYTES = 16 << 20


def line_keys(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, version, pos, h1, h2 of each line whose key (trimmed, A-Z lower-cased) has min_chars code points; version tells rows of one doc_id apart."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line"))
    lines = rows.select("doc_id", "version", "pos", F.btrim("line", F.lit(ASCII_SPACE)).alias("k")).where(F.char_length("k") >= min_chars)
    lines = lines.select("doc_id", "version", "pos", lower_ascii(F.col("k")).alias("k"))
    return lines.select("doc_id", "version", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"))


class LineRuns:
    """Levels of sorted runs of (h1, h2, owner): the key and the smallest doc_id that holds it."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.buckets = spark, fanout, partitions(spark)
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, keys: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        keys.write.option("path", path).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        remove(self.spark, run[1])

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(x) for level in self.levels for x, _ in level]

    def add(self, keys: DataFrame, level: int = 0) -> None:
        """keys become a run; full levels are merged upwards."""
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(self._write(keys))
        if len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self.spark.table(old[0][0])
            for x, _ in old[1:]:
                merged = merged.unionByName(self.spark.table(x))
            self.add(merged.repartition(self.buckets, *KEY), level + 1)
            self.levels[level] = []
            for x in old:
                self._drop(x)

    def split(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """keys (h1, h2, owner, last, n) as (new keys, keys found in more than one document with their owner and n)."""
        new, seen = keys, None
        for run in self.runs():
            again = keys.select(*KEY, "n").join(run.hint("merge"), KEY)
            seen = again if seen is None else seen.unionByName(again)
            new = new.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        shared = new.where("last > owner").select(*KEY, "owner", "n")
        return new.select(*KEY, "owner"), shared if seen is None else shared.unionByName(seen)

    def drop(self) -> None:
        for level in self.levels:
            for x in level:
                self._drop(x)
        self.levels = []


def dropped_lines(docs: DataFrame, min_chars: int = 10, batches: int | None = None, fanout: int = 2) -> DataFrame:
    """doc_id, version, dropped: for each row that loses lines, the places of those lines. At least four batches, of BATCH_DOCUMENTS at most."""
    spark = docs.sparkSession
    batches = batches or max(4, -(-docs.count() // BATCH_DOCUMENTS))
    edges = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.1 / batches)
    batch = F.lit(0)
    for e in sorted(set(edges)):
        batch = batch + (F.col("doc_id") > F.lit(int(e))).cast("int")
    path = new_path(spark, "lines")
    runs, lost = LineRuns(spark, fanout), None
    try:
        lines = staged(line_keys(docs, min_chars).withColumn("batch", batch), path, "batch")
        for i in range(batches):
            mine = lines.where(F.col("batch") == i).drop("batch")
            keys = checkpointed(mine.groupBy(*KEY).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n")))
            new, shared = runs.split(keys)
            gone = join_hot(mine, shared, KEY).where("doc_id <> owner").groupBy("doc_id", "version").agg(F.collect_set("pos").alias("dropped"))
            gone = checkpointed(gone)
            lost = gone if lost is None else lost.unionByName(gone)
            if i + 1 < batches:
                runs.add(new)
    finally:
        runs.drop()
        remove(spark, path)
    return lost


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """row (all of docs), doc_id and text, with the places of the lines that go in `gone` and all lines in `lines`."""
    lost = dropped_lines(docs.select("doc_id", "text"), **options)
    size = lost.agg(F.sum(F.size("dropped") * 4 + 64).alias("n")).first()["n"] or 0
    lost = lost.select(F.col("doc_id").alias("lost_id"), "version", F.col("dropped").alias("gone"))
    lost = F.broadcast(lost) if size <= BROADCAST_BYTES else lost  # measured
    same = (F.col("row.doc_id") == F.col("lost_id")) & (F.xxhash64("row.text") == F.col("version"))
    left = whole_rows(docs).join(lost, same, "left").select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "gone")
    return left.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))


def kept_text():
    """The lines that stay, joined by line feeds. array_except works by hash, so long texts stay linear."""
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    return F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n"))


def line_dedup_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    n_dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return dedup_lines(docs.select("doc_id", "text"), **options).select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), F.sha2(kept_text(), 256).alias("kept_sha256")
    )


def dedup_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with text cut to the lines that stay and n_chars, if there, to match; a text that loses nothing is left as it is (null too)."""
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept_text())
    n_chars = lambda: F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.char_length("kept").cast("long"))
    out = dedup_lines(docs, **options).withColumn("kept", text)
    return as_before(out, docs, text=F.col("kept"), **({"n_chars": n_chars()} if "n_chars" in docs.columns else {}))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, p.pos AS pos, p.line AS line,
         translate(trim(p.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'pos': i, 'line': x})) AS p FROM documents)
), own AS (
  SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(o.owner <> l.doc_id, false) AS gone FROM lines l LEFT JOIN own o ON l.k = o.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
