"""Signal tables as date-partitioned Parquet: append, scan, compact, retain.

Partitions are event dates (UTC), so a time-bounded scan prunes exactly; rows of any
age may be appended, by batches and streams alike. A table is a set of plain files, so
appends, micro-batches and maintenance can be mixed. Each of them is one change in the
table's ledger (``otelframe.sources.ledger``): it happens as a whole or not at all, a
change that broke off is finished by the next one, and scans see it as done. A batch
that comes again is left out, also when its files have been compacted since.

The tenant is a column of the stored rows (``TENANT``), so that a reader's tenant filter
reaches the scan. Sets of traces and names by day (``otelframe.sources.days``) are kept
beside the rows, so that a lookup by trace id reads only that trace's days.
"""

from __future__ import annotations

import datetime
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from otelframe.functions.attrs import TENANT_KEY, attr
from otelframe.functions.window import MINUTE, TimeWindow, duration
from otelframe.schemas import SCHEMAS, SORT_KEYS, TIME_COLUMN, conform
from otelframe.sources import days, footers
from otelframe.sources.ledger import Change, Files, Ledger

SLACK = 60 * MINUTE
#: A partition with fewer rows a file than this is fragmented.
LEAST_FILE_ROWS = 1000
DAY = 24 * 60 * MINUTE
#: Stored next to a signal's columns: its tenant, for push-down.
TENANT = "tenant"


def utc(spark: SparkSession) -> None:
    """Dates and times are UTC throughout."""
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def date_of(column: str):
    return F.to_date(F.timestamp_micros(F.col(column)))


def stored(df: DataFrame, signal: str) -> DataFrame:
    """Rows as they are written: the signal's columns, its tenant and its date."""
    rows = conform(df, signal)
    rows = rows.withColumns({TENANT: attr("resource_attributes", TENANT_KEY), "date": date_of(TIME_COLUMN[signal])})
    return rows.hint("rebalance", "date")  # few files a day; a large day is split


def _write(rows: DataFrame, staged: str) -> None:
    rows.write.mode("overwrite").partitionBy("date").option("compression", "zstd").parquet(staged)


def _listed(spark: SparkSession, path: str, names: set[str] | None = None) -> list[str]:
    """Data files of a table's date folders, or of those in ``names``."""
    found = Files(spark, path).matching(f"{path}/date=*/*.parquet")
    return sorted(f for f in found if names is None or f.rsplit("/", 2)[1] in names)


def _staged(df: DataFrame, ledger: Ledger, root: str, signal: str, name: str) -> Change:
    """Write rows to a change's folder, and add their keys to the sets of the table."""
    spark, staged = df.sparkSession, ledger.stage(name)
    _write(stored(df, signal), staged)
    files = _listed(spark, staged)
    if files:
        days.add(spark.read.schema(_stored_schema(signal)).parquet(staged), root, signal)
    return Change(name, staged, [[f, f"{root}/{signal}/{f.rsplit('/', 2)[1]}/{name}-{n:05d}.zstd.parquet"] for n, f in enumerate(files)], [])


def _commit(ledger: Ledger, change: Change) -> None:
    ledger.record(change)
    ledger.finish(change)


def append(df: DataFrame, root: str, signal: str) -> None:
    """Append rows to a signal's table; they become visible at once."""
    utc(df.sparkSession)
    ledger = Ledger(df.sparkSession, root, signal)
    _commit(ledger, _staged(df, ledger, root, signal, f"append-{uuid.uuid4().hex}"))


def append_batch(df: DataFrame, root: str, signal: str, batch: str) -> bool:
    """Append a micro-batch once. ``batch`` is the stream's name, ``-`` and the batch's
    number, which grows. False if that batch, or a later one of its stream, is in the table:
    then nothing is written. A try that broke off is finished or begun again."""
    spark = df.sparkSession
    utc(spark)
    name = re.sub(r"[^A-Za-z0-9-]", "-", batch)
    stream, _, number = name.rpartition("-")
    if not stream or not number.isdigit():
        stream, number = name, "0"
    ledger = Ledger(spark, root, signal)
    ledger.recover()
    if ledger.last(stream) >= int(number):
        return False
    change = _staged(df, ledger, root, signal, f"batch-{name}")
    _commit(ledger, change._replace(batch=stream, number=int(number)))
    return True


def _stored_schema(signal: str) -> StructType:
    return StructType([*SCHEMAS[signal].fields, StructField(TENANT, StringType()), StructField("date", DateType())])


def _move(ledger: Ledger, change: Change) -> None:
    """Publish a compaction."""
    _commit(ledger, change)


def _place(column: str = "_metadata.file_path"):
    """Date folder and name of a file."""
    return F.substring_index(F.col(column), "/", -2)


def _table(spark: SparkSession, root: str, signal: str) -> DataFrame:
    """All rows, with the place of their file. While a change is open (its writer broke off,
    or is at work), its replaced files are left out and those not yet moved are read where
    they are staged."""
    path, schema = f"{root}/{signal}", _stored_schema(signal)
    files = Files(spark, root)
    changes = Ledger(spark, root, signal).open_changes()
    parts = []
    if files.exists(path):
        rows = spark.read.schema(schema).parquet(path)
        replaced = [("/".join(f.rsplit("/", 2)[1:]),) for c in changes for f in c.replaced]
        rows = rows.select("*", _place().alias("_file"))
        if replaced:
            rows = rows.join(spark.createDataFrame(replaced, "_file string"), "_file", "left_anti").select(rows.columns)
        parts.append(rows)
    for c in changes:
        waiting = [source for source, target in c.moves if not files.exists(target)]
        if waiting:
            parts.append(spark.read.schema(schema).option("basePath", c.staged).parquet(*waiting).select("*", _place().alias("_file")))
    if not parts:
        return spark.createDataFrame([], StructType([*schema.fields, StructField("_file", StringType())]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def day_names(spark: SparkSession, root: str, signal: str) -> list[str]:
    """Days that have rows (``2024-01-31``), from the names of folders."""
    path = f"{root}/{signal}"
    found = {n[5:] for n in Files(spark, path).names(path) if re.fullmatch(r"date=\d{4}-\d\d-\d\d", n)}
    found |= {target.rsplit("/", 2)[1][5:] for c in Ledger(spark, root, signal).open_changes() for _, target in c.moves}
    return sorted(found)


def scan(spark: SparkSession, root: str, signal: str, since: int | None = None, until: int | None = None, tenant: str | None = None, keep_date: bool = False, dates: list[str] | None = None, keep_tenant: bool = False) -> DataFrame:
    """All rows of a signal under its full schema (missing columns are absent values), an
    empty table where there is none.

    ``since`` and ``until`` (micros) prune dates, with an hour of slack; they are no row
    filters; ``dates`` are the only days read. ``tenant`` keeps one tenant's rows by the
    stored column, which reaches the files. ``keep_date`` and ``keep_tenant`` leave the
    partition column and the stored tenant in the result.
    """
    rows = _table(spark, root, signal)
    if since is not None:
        rows = rows.where(F.col("date") >= F.to_date(F.timestamp_micros(F.lit(since - SLACK))))
    if until is not None:
        rows = rows.where(F.col("date") <= F.to_date(F.timestamp_micros(F.lit(until + SLACK))))
    if dates is not None:
        rows = rows.where(F.col("date").isin([datetime.date.fromisoformat(d) for d in dates]))
    if tenant is not None:
        rows = rows.where(F.col(TENANT) == tenant)
    return conform(rows, signal, ["date"] * keep_date + [TENANT] * keep_tenant)


def of_traces(spark: SparkSession, root: str, signal: str, trace_ids: list[str], tenant: str | None = None) -> DataFrame:
    """The rows of some traces. Only the days that hold them are read, and in these only
    row groups that may have their ids; no time is needed."""
    rows = scan(spark, root, signal, tenant=tenant, dates=days.of_traces(spark, root, signal, trace_ids), keep_tenant=tenant is not None)
    return rows.where(F.col("trace_id").isin(trace_ids))


def names(spark: SparkSession, root: str, signal: str) -> DataFrame:
    """Distinct tenant, service_name (and metric_name) of all rows, from the day sets."""
    live = [datetime.date.fromisoformat(d) for d in day_names(spark, root, signal)]
    found = days.read(spark, root, signal, "names").where(F.col("date").isin(live))
    return found.drop("date").distinct()


def windowed(spark: SparkSession, root: str, signal: str, window: TimeWindow, tenant: str | None = None) -> DataFrame:
    """The rows that a search or metric query over ``window`` can need, with their stored
    tenant: only the days of the window are listed and read, and the query's tenant filter
    reaches the files."""
    return scan(spark, root, signal, window.start, window.end if window.until else None, tenant, keep_tenant=True)


def row_groups(spark: SparkSession, root: str, signal: str, names: set[str] | None = None) -> DataFrame:
    """file, row_group, rows, bytes, least, most, date of a table's published files (of the
    date folders ``names`` only), from their footers."""
    found = footers.read(spark, _listed(spark, f"{root}/{signal}", names), TIME_COLUMN[signal])
    return found.withColumn("date", F.to_date(F.regexp_extract("file", "date=([0-9-]+)", 1)))


def layout(spark: SparkSession, root: str, signal: str) -> DataFrame:
    """date, files, row_groups, rows, bytes, oldest, newest of each partition. Only footers
    are read."""
    by_day = row_groups(spark, root, signal).groupBy("date")
    return by_day.agg(
        F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("row_groups"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.min("least").alias("oldest"), F.max("most").alias("newest")
    )


def within(spark: SparkSession, root: str, signal: str, window: TimeWindow, tenant: str | None = None, slack: int = 0) -> DataFrame:
    """The rows of a window, with their stored tenant. Of the window's days only the files
    are read whose footers say that they may hold such a time, and of these only such row
    groups, as the time filter reaches the reader.

    Metric queries that look at the points before a window pass their ``slack`` (micros).
    The names of one window's files reach the driver, as they do for any scan. While a
    change is open the days are read whole.
    """
    utc(spark)
    start, end = window.start - slack, window.end + slack if window.until else None
    path, column = f"{root}/{signal}", TIME_COLUMN[signal]
    name = lambda at: (datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=at)).date().isoformat()
    if Ledger(spark, root, signal).open_changes():
        rows = scan(spark, root, signal, start, end, tenant, keep_tenant=True)
    else:
        held = {f"date={d}" for d in day_names(spark, root, signal) if name(start) <= d and (end is None or d <= name(end))}
        near = footers.overlapping(row_groups(spark, root, signal, held), start, end) if held else None
        files = sorted(r.file for r in near.select("file").distinct().collect()) if held else []
        reader = spark.read.schema(_stored_schema(signal))
        rows = reader.option("basePath", path).parquet(*files) if files else spark.createDataFrame([], _stored_schema(signal))
        # on the file's own column, so that it reaches the row groups
        rows = rows.where(F.col(column) >= start)
        rows = rows if end is None else rows.where(F.col(column) < end)
        rows = conform(rows if tenant is None else rows.where(F.col(TENANT) == tenant), signal, [TENANT])
    inside = F.col(column) >= start
    return rows.where(inside if end is None else inside & (F.col(column) < end))


def partitions(spark: SparkSession, root: str, signal: str) -> DataFrame:
    """date, files, rows of each partition."""
    by_file = _table(spark, root, signal).groupBy("date", "_file").agg(F.count(F.lit(1)).alias("n"))
    return by_file.groupBy("date").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("rows"))


def fragmented(spark: SparkSession, root: str, signal: str, least: int = LEAST_FILE_ROWS) -> DataFrame:
    """Partitions of several files with few rows in each."""
    return partitions(spark, root, signal).where((F.col("files") > 1) & (F.col("rows") / F.col("files") < least))


def compact(spark: SparkSession, root: str, signal: str, dates: DataFrame, rows_per_file: int = 5_000_000) -> None:
    """Rewrite the partitions in ``dates`` (date) as few files, sorted by the signal's keys,
    and fold the day sets.

    Changes that broke off are finished first. The files of these partitions are listed, and
    only they are read; their rows are staged, and one change in the ledger replaces the files
    read by them: at every moment a scan sees the rows once. What is appended in the meantime
    is another file and stays. Maintenance of one table runs once at a time.
    """
    path = f"{root}/{signal}"
    ledger = Ledger(spark, root, signal)
    ledger.recover(maintenance=True)
    wanted = {f"date={r.date}" for r in dates.select("date").distinct().collect()}  # calendar days
    files = _listed(spark, path, wanted)
    if not files:
        return
    rows = spark.read.schema(_stored_schema(signal)).option("basePath", path).parquet(*files)
    counted = rows.groupBy("date").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("pieces"))
    dealt = rows.join(F.broadcast(counted), "date").withColumn("_piece", F.pmod(F.xxhash64(*SORT_KEYS[signal]), F.col("pieces")))
    name = f"compact-{uuid.uuid4().hex}"
    staged = ledger.stage(name)
    _write(dealt.repartition("date", "_piece").drop("_piece", "pieces").sortWithinPartitions("date", *SORT_KEYS[signal]), staged)
    moves = [[f, f"{path}/{f.rsplit('/', 2)[1]}/{name}-{n:05d}.zstd.parquet"] for n, f in enumerate(_listed(spark, staged))]
    _move(ledger, Change(name, staged, moves, files))
    days.fold(spark, root, signal, day_names(spark, root, signal))
    spark.catalog.refreshByPath(path)


def compact_closed(spark: SparkSession, root: str, signal: str, as_of: int) -> None:
    """Compact fragmented days before yesterday (by ``as_of``)."""
    before = F.date_sub(F.to_date(F.timestamp_micros(F.lit(as_of))), 1)
    compact(spark, root, signal, fragmented(spark, root, signal).where(F.col("date") < before))


def compact_recent(spark: SparkSession, root: str, signal: str, as_of: int) -> None:
    """Compact fragmented partitions of yesterday and today."""
    first = F.date_sub(F.to_date(F.timestamp_micros(F.lit(as_of))), 1)
    compact(spark, root, signal, fragmented(spark, root, signal).where(F.col("date") >= first))


def expired(spark: SparkSession, root: str, signal: str, keep: str, as_of: int) -> list[str]:
    """Names of date folders that end before ``as_of - keep``; others are no dates."""
    limit = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=as_of - duration(keep))
    ends = {n: datetime.datetime.fromisoformat(n) + datetime.timedelta(days=1) for n in day_names(spark, root, signal)}
    return [f"date={n}" for n, end in sorted(ends.items()) if end <= limit]


def retain(spark: SparkSession, root: str, keep: str, as_of: int) -> dict[str, list[str]]:
    """Drop partitions older than ``keep`` (such as "30d") of every signal."""
    utc(spark)
    gone = {}
    for signal in SCHEMAS:
        Ledger(spark, root, signal).recover()
        gone[signal] = expired(spark, root, signal, keep, as_of)
        for name in gone[signal]:
            Files(spark, root).delete(f"{root}/{signal}/{name}")
        if gone[signal]:
            spark.catalog.refreshByPath(f"{root}/{signal}")
    return gone
