"""Shared helpers: the cluster's shared folder, null-safe text, map-only Arrow jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Where the setting is missing and the session runs in one process (tests), a
    temporary folder is set instead; on a cluster a missing setting is an error,
    because a local folder would not be seen by the other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/otelframe-{uuid.uuid4().hex}"


#: Shuffle files go as soon as the job that made them has been written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_parquet(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    write_parquet(df, path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Give back the space of materialized tables that nothing reads any more: each is
    overwritten by an empty one."""
    for table in tables:
        path = table.inputFiles()[0].rpartition("/")[0] if table.inputFiles() else None
        if path:
            none = (F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema)
            write_parquet(table.sparkSession.range(0, 0, 1, 1).select(*none), path)


def dealt_anew(column: str = "gram") -> Column:
    """The same value in an expression that Spark does not see through: a join on it
    deals its side anew and can then split a hot key's rows, at no cost in bytes."""
    return F.bitwise_not(F.bitwise_not(column))


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def map_texts(df: DataFrame, columns: list, schema: str | StructType, rows: Callable[[dict], dict], keep: tuple[str, ...] = (), at_once: int = 2000) -> DataFrame:
    """Map-only job over ``columns`` of ``df``: ``rows`` gets a dict of Python lists for
    ``at_once`` rows at most and returns a dict of lists or arrays for the columns of
    ``schema``. Columns in ``keep`` pass by as they are (then a row gives a row)."""
    made = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    source = df.select(*columns)
    result = StructType([source.schema[k] for k in keep] + made.fields)
    fields = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, at_once) for b in batches for i in range(0, b.num_rows, at_once)):
            out = rows(batch.select([n for n in batch.schema.names if n not in keep]).to_pydict())
            arrays = [batch.column(f.name).cast(f.type) if f.name in keep else pa.array(out[f.name], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return source.mapInArrow(run, result)
