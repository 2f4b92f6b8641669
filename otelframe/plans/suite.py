"""Named SQL over the signal views, one query or a whole suite at a time."""

from __future__ import annotations

import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession, signals: dict[str, DataFrame]) -> None:
    """The signals as temp views, for raw SQL."""
    for name, df in signals.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)


def _run(spark: SparkSession, name: str, sql: str, out: str | None, limit: float | None, pool: str) -> tuple:
    """One query under a tag of its own; when its time is up, the tag's jobs are stopped."""
    began, rows, columns, error = time.time(), None, [], None
    tag, late = f"suite-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(limit, stop) if limit else None
    spark.sparkContext.addJobTag(tag)
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
    try:
        if timer:
            timer.start()
        df = spark.sql(sql)
        columns = df.columns
        if out:
            target = f"{out}/query_name={name}"
            df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("row")).write.mode("overwrite").parquet(target)
            rows = spark.read.parquet(target).count()
        else:
            rows = df.count()
    except Exception as e:  # noqa: BLE001  the report carries it
        error = f"stopped after {limit:g} s" if late.is_set() else str(e).split("\n")[0]
    finally:
        if timer:
            timer.cancel()
        spark.sparkContext.removeJobTag(tag)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
    return name, rows, columns, error, time.time() - began


def run_suite(spark: SparkSession, saved: DataFrame, out: str | None = None, at_once: int = 4, limit: float | None = None) -> DataFrame:
    """Run each saved query (name, sql), ``at_once`` of them side by side: name, rows,
    columns, error, seconds. Result rows go to ``out``, one folder a query, as JSON text.
    A query that fails, or takes more than ``limit`` seconds and is stopped, does not touch
    the others; each has a scheduler pool of its own (fair where
    ``spark.scheduler.mode`` is FAIR; else a query also waits for the tasks of those before
    it, and that time counts). The suite itself is a short list, read to the driver."""
    queries = saved.select("name", "sql").orderBy("name").collect()
    with ThreadPoolExecutor(max(1, at_once)) as threads:
        done = list(threads.map(lambda q: _run(spark, q.name, q.sql, out, limit, f"suite-{q.name}"), queries))
    return spark.createDataFrame(done, "name string, rows long, columns array<string>, error string, seconds double")
