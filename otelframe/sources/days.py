"""Which days hold a trace, and what a day holds: small sets kept next to a signal's table.

A set has a row for each distinct key and day. A change of the table adds its rows before
it happens, so that a set never lacks a key; a row more than once, or of a change that
broke off, does no harm, because sets are read as sets and a day's rows are looked at
only where the key is. ``fold`` rewrites a set in the order of its keys, without repeats
and without days that are gone: then a lookup of a key meets few row groups.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from otelframe.sources.ledger import Files, each

#: Key columns of the sets of each signal.
SETS = {
    "traces": {"trace": ("trace_id",), "names": ("tenant", "service_name")},
    "logs": {"trace": ("trace_id",), "names": ("tenant", "service_name")},
    "metrics": {"names": ("tenant", "service_name", "metric_name")},
}
KEYS_PER_FILE = 2_000_000


def _folder(root: str, signal: str, name: str) -> str:
    return f"{root}/.days/{signal}-{name}"


def has(spark: SparkSession, root: str, signal: str, name: str) -> bool:
    folder = _folder(root, signal, name)
    return any(n.endswith(".parquet") for n in Files(spark, folder).names(folder))


def add(rows: DataFrame, root: str, signal: str) -> None:
    """Add the keys of ``rows`` (the signal's columns, tenant and date) to all sets. The rows
    are read once."""
    every = list(dict.fromkeys(k for keys in SETS[signal].values() for k in keys))
    known = rows.select(*every, "date").distinct().persist()
    for name, keys in SETS[signal].items():
        found = known.select(*keys, "date").distinct()
        if name == "trace":
            found = found.where("trace_id <> ''")
        found.hint("rebalance").sortWithinPartitions(*keys).write.mode("append").option("compression", "zstd").parquet(_folder(root, signal, name))
    known.unpersist()


def read(spark: SparkSession, root: str, signal: str, name: str) -> DataFrame:
    """The keys and days of a set; a key may come with one day more than once."""
    ddl = ", ".join(f"{k} string" for k in SETS[signal][name])
    if not has(spark, root, signal, name):
        return spark.createDataFrame([], f"{ddl}, date date")
    return spark.read.schema(f"{ddl}, date date").parquet(_folder(root, signal, name))


def fold(spark: SparkSession, root: str, signal: str, live: list[str]) -> None:
    """Rewrite the sets sorted by key, for the days ``live`` (``2024-01-31``). Only the
    files that were read go; one that breaks off leaves rows twice, which does no harm."""
    for name, keys in SETS[signal].items():
        if not has(spark, root, signal, name):
            continue
        source = read(spark, root, signal, name)
        before = source.inputFiles()
        rows = source.where(F.col("date").cast("string").isin(live)).distinct()
        pieces = max(1, -(-rows.count() // KEYS_PER_FILE))
        folder, staged = _folder(root, signal, name), f"{root}/.days/.fold-{uuid.uuid4().hex}"
        rows.repartitionByRange(pieces, *keys).sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(staged)
        files = Files(spark, folder)
        for n in files.names(staged):
            if n.endswith(".parquet"):
                files.rename(f"{staged}/{n}", f"{folder}/{n}")
        each(files.delete, before)
        files.delete(staged)
        spark.catalog.refreshByPath(folder)


def of_traces(spark: SparkSession, root: str, signal: str, trace_ids: list[str]) -> list[str]:
    """The days that hold rows of any of the traces (calendar days, so a bounded list)."""
    found = read(spark, root, signal, "trace").where(F.col("trace_id").isin(trace_ids))
    return sorted(str(r.date) for r in found.select("date").distinct().collect())
