"""Records and files that may be broken: what can be read, and a table of what is wrong with the rest."""

from __future__ import annotations

import io

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

BAD = "_corrupt_record"


def parsed(rows: DataFrame, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the fields of schema in place of the JSON column text, rows with an error): a record is missing (null) or
    malformed (no JSON object, or a field of another type); no record ends the job."""
    j = F.from_json(text, f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    kind = F.when(F.col(text).isNull(), "missing").when(F.col("_j").isNull() | F.col(f"_j.{BAD}").isNotNull(), "malformed")
    told = rows.withColumn("_j", j).withColumn("error", kind)
    rest = [c for c in rows.columns if c != text]
    names = [f.name for f in StructType.fromDDL(schema).fields]
    good = told.where("error IS NULL").select(*rest, *[F.col(f"_j.{c}").alias(c) for c in names])
    return good, told.where("error IS NOT NULL").select(*rest, text, "error")


def read_files(spark: SparkSession, path: str, schema: StructType, name: str = "*.parquet") -> tuple[DataFrame, DataFrame]:
    """(rows, errors): Parquet files under path, decoded one by one with the columns of schema and `file`; a file that cannot be
    decoded, or lacks a column, gives one row of errors (file, error) and ends nothing. Each file has to fit a task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(path).select("path", "content")
    both = StructType([*(StructField(f.name, f.dataType) for f in schema.fields), StructField("file", StringType()), StructField("error", StringType()), StructField("_n", LongType())])
    shape, names = to_arrow_schema(both), schema.fieldNames()

    def told(file: str, error: str) -> pa.RecordBatch:
        values = {"file": file, "error": error, "_n": 0}
        return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in shape], schema=shape)

    def run(batches):
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content")):
                try:
                    table = pq.read_table(io.BytesIO(content.as_py()), columns=names).select(names)
                    columns = [table.column(f.name).cast(f.type).combine_chunks() for f in shape if f.name in names]
                except (pa.ArrowException, OSError, KeyError, ValueError) as e:
                    yield told(file, str(e).splitlines()[0][:200])
                    continue
                n = table.num_rows
                rest = [pa.array([file] * n, pa.string()), pa.nulls(n, pa.string()), pa.array([n] * n, pa.int64())]
                whole = pa.Table.from_arrays([*columns, *rest], schema=shape)
                yield from whole.to_batches(max_chunksize=65_536)

    found = files.mapInArrow(run, both)
    return found.where("error IS NULL").drop("error", "_n"), found.where("error IS NOT NULL").select("file", "error")
