"""Metric aggregation: number points, and histograms as increments of their series.

A cumulative histogram series (same attributes, resource, start and bounds) becomes
increments by looking back one point; deltas pass. Increments are summed by time
bucket and group, bucket lists element by element, and quantiles are interpolated in
the bucket where the running count crosses the rank.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from otelframe.functions.attrs import AttrFilter, attr_condition, group_key, group_keys
from otelframe.functions.window import TimeWindow, bucket_start, step_of
from otelframe.operators.search import of_tenant

NUMBER = {"avg": F.avg, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
SCALARS = ("avg", "mean", "sum", "min", "max", "count")
CUMULATIVE = "AGGREGATION_TEMPORALITY_CUMULATIVE"
SERIES = ["attributes", "resource_attributes", "start_timestamp", "explicit_bounds", "aggregation_temporality"]


def metric_scope(metrics: DataFrame, tenant: str, metric_name: str, window: TimeWindow, filters: Iterable[AttrFilter] = ()) -> DataFrame:
    if not metric_name:
        raise ValueError("metric_name is required")
    found = of_tenant(metrics, tenant).where((F.col("metric_name") == metric_name) & window.holds("timestamp"))
    for f in filters:
        found = found.where(attr_condition(f))
    return found


def query_metric(
    metrics: DataFrame, tenant: str, metric_name: str, aggregation: str, window: TimeWindow, group_by: str | list[str] = "", filters: Iterable[AttrFilter] = (),
    step: str | None = None, metric_type: str | None = None, exact: bool = False,
) -> DataFrame:
    """One row per group (and time bucket with ``step``): [time], group keys, value.

    ``metric_type`` is read from the newest point where it isn't given. Aggregations:
    avg, mean, sum, min, max, count, p50, p95, p99, and ``buckets`` (le, value) for
    histograms with explicit bounds. ``exact`` takes exact quantiles of number points.
    """
    aggregation = aggregation.lower()
    if aggregation not in SCALARS and aggregation not in QUANTILES and aggregation != "buckets":
        raise ValueError(f"aggregation {aggregation!r} is not supported")
    size = step_of(step, window)
    keys = group_keys(group_by)
    scope = metric_scope(metrics, tenant, metric_name, window, filters)
    if metric_type is None:
        metric_type = scope.agg(F.max_by("metric_type", F.struct("timestamp", "metric_type"))).first()[0]
    time = [bucket_start("timestamp", size).alias("time")] if size else []
    names = (["time"] if size else []) + keys
    if metric_type == "summary":
        raise ValueError("summary points hold quantiles and cannot be aggregated")
    if metric_type == "exponential_histogram" and (aggregation in QUANTILES or aggregation == "buckets"):
        raise ValueError(f"{aggregation} needs a histogram with explicit buckets")
    if metric_type not in ("histogram", "exponential_histogram"):
        if aggregation == "buckets" and metric_type is not None:
            raise ValueError("buckets needs a histogram with explicit buckets")
        points = scope.select(*time, *[group_key(k) for k in keys], "value_double")
        if aggregation == "buckets":
            return points.groupBy(*names).agg(F.lit(None).cast("double").alias("le"), F.lit(0.0).alias("value")).where("false")
        return number_points(points, names, aggregation, exact)
    made = increments(scope.withColumns({f"_{k}": group_key(k) for k in keys}), window.start)
    made = made.select(*time, *[F.col(f"`_{k}`").alias(k) for k in keys], "dc", "ds", "db", "min", "max", "count", "explicit_bounds")
    quoted = [F.col(f"`{n}`") for n in names]
    if aggregation in SCALARS:
        return ordered(histogram_scalar(made, quoted, aggregation), quoted)
    merged = merged_buckets(made, quoted)
    if aggregation == "buckets":
        return bucket_rows(merged, quoted)
    return ordered(bucket_quantile(merged, quoted, QUANTILES[aggregation]), quoted)


def ordered(rows: DataFrame, names: list[Column]) -> DataFrame:
    """By all group keys; a single row needs no order."""
    return rows.orderBy(*names) if names else rows


def number_points(points: DataFrame, names: list[str], aggregation: str, exact: bool) -> DataFrame:
    quoted = [F.col(f"`{n}`") for n in names]
    if aggregation in QUANTILES:
        q = QUANTILES[aggregation]
        value = F.percentile("value_double", q) if exact else F.percentile_approx("value_double", q, 10_000)
    else:
        value = NUMBER[aggregation]("value_double")
    return ordered(points.groupBy(*quoted).agg(value.cast("double").alias("value")), quoted)


def increments(points: DataFrame, cut: int) -> DataFrame:
    """``points`` with dc, ds (count and sum gained since the point before) and db (the
    same for bucket counts, null for a baseline and where the list's length changed).

    A series' first point counts in full if the series began at or after ``cut``, the
    window's start, else it is a baseline; a dropped count is a restart and counts in
    full. Each increment belongs to the later point's time and groups.
    """
    w = Window.partitionBy(*SERIES).orderBy("timestamp")
    lists = F.from_json("bucket_counts", "array<double>")
    df = points.where("aggregation_temporality is not null").withColumn("_b", lists)
    df = df.withColumns({"_pc": F.lag("count").over(w), "_ps": F.lag("sum").over(w), "_pb": F.lag("_b").over(w)})
    delta, first, reset = F.col("aggregation_temporality") != CUMULATIVE, F.col("_pc").isNull(), F.col("count") < F.col("_pc")
    inside = F.col("start_timestamp") >= cut

    def scalar(value: Column, gained: Column) -> Column:
        return F.when(delta | reset | (first & inside), value).when(first, F.lit(0)).otherwise(gained).cast("double")

    gained = F.zip_with("_b", "_pb", lambda x, y: x - y)
    buckets = F.when(delta | reset | (first & inside), F.col("_b")).when(first | (F.size("_b") != F.size("_pb")), F.lit(None)).otherwise(gained)
    return df.withColumns({"dc": scalar(F.col("count"), F.col("count") - F.col("_pc")), "ds": scalar(F.col("sum"), F.col("sum") - F.col("_ps")), "db": buckets}).drop("_b", "_pc", "_ps", "_pb")


def histogram_scalar(made: DataFrame, names: list[Column], aggregation: str) -> DataFrame:
    if aggregation in ("min", "max"):
        known = made.where((F.col("count") > 0) & ((F.col("min") != 0) | (F.col("max") != 0)))
        return known.groupBy(*names).agg(NUMBER[aggregation](aggregation).alias("value"))
    total = {"count": F.sum("dc"), "sum": F.sum("ds")}.get(aggregation, F.try_divide(F.sum("ds"), F.sum("dc")))
    return made.groupBy(*names).agg(total.cast("double").alias("value"))


def merged_buckets(made: DataFrame, names: list[Column]) -> DataFrame:
    """names, lo, hi (null for an open end), n: bucket increments summed by their edges.
    Points whose bounds are not a JSON list of numbers are left out."""
    bounds = F.from_json("explicit_bounds", "array<double>")
    each = made.where("db is not null").withColumn("_e", bounds).where("_e is not null").select(*names, "_e", F.posexplode("db").alias("pos", "n"))
    edges = each.select(*names, F.get("_e", F.col("pos") - 1).alias("lo"), F.get("_e", F.col("pos")).alias("hi"), "n")
    return edges.groupBy(*names, "lo", "hi").agg(F.sum("n").alias("n"))


def bucket_rows(merged: DataFrame, names: list[Column]) -> DataFrame:
    """names, le (null for the open end), value: counts by upper edge."""
    rows = merged.groupBy(*names, F.col("hi").alias("le")).agg(F.sum("n").alias("value"))
    return rows.orderBy(*names, F.col("le").asc_nulls_last())


def bucket_quantile(merged: DataFrame, names: list[Column], q: float) -> DataFrame:
    """names, value: linear interpolation in the bucket that holds the rank. The first
    lower edge counts as 0 below a positive upper one; the open last bucket answers
    its lower edge; groups without observations answer null."""
    by = [*names] or [F.lit(1)]
    order = [F.col("hi").asc_nulls_last(), F.col("lo").asc_nulls_first()]
    w = Window.partitionBy(*by).orderBy(*order)
    run = merged.withColumn("m", F.greatest("n", F.lit(0.0))).withColumns(
        {
            "cum": F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "total": F.sum("m").over(Window.partitionBy(*by)),
            "edge": F.last(F.coalesce("hi", "lo"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    rank = F.lit(q) * F.col("total")
    low = F.when(F.col("lo").isNotNull(), F.col("lo")).when(F.col("hi") > 0, F.lit(0.0))
    inside = low + (F.col("hi") - low) * (rank - (F.col("cum") - F.col("m"))) / F.col("m")
    answer = F.when(F.col("hi").isNull(), F.coalesce("lo", "edge")).when(low.isNull(), F.col("hi")).otherwise(inside)
    hit = (F.col("total") > 0) & (F.col("m") > 0) & (F.col("cum") >= rank)
    first = F.min_by(F.when(hit, answer), F.when(hit, F.struct("cum", F.coalesce("hi", F.lit(float("inf"))))))
    return run.groupBy(*names).agg(first.alias("value"))
