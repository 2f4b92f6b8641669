"""Exemplars: from a metric to concrete requests, and the slowest requests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from otelframe.functions.attrs import AttrFilter, group_key, group_keys
from otelframe.functions.window import Range, TimeWindow, limited
from otelframe.operators.metrics import metric_scope
from otelframe.operators.search import latest, span_scope
from otelframe.sources.shared import written

EXEMPLARS = "array<struct<time_unix_nano: bigint, trace_id: string, span_id: string, value: double>>"


def query_exemplars(metrics: DataFrame, tenant: str, metric_name: str, window: TimeWindow, group_by: str | list[str] = "", filters: Iterable[AttrFilter] = (), value: Range = Range(), limit: int | None = None) -> DataFrame:
    """group keys, timestamp, value, trace_id, span_id: each request once (its newest
    exemplar within the value range), highest value first. A step does not apply."""
    keys = group_keys(group_by)
    scope = metric_scope(metrics, tenant, metric_name, window, filters).where(~F.coalesce(F.col("exemplars"), F.lit("")).isin("", "[]"))
    each = scope.select(*[group_key(k) for k in keys], F.explode(F.from_json("exemplars", EXEMPLARS)).alias("e")).select(*[f"`{k}`" for k in keys], "e.*")
    each = each.where((F.coalesce("trace_id", F.lit("")) != "") & F.col("value").isNotNull() & value.holds("value"))
    newest = F.row_number().over(Window.partitionBy("trace_id", "span_id").orderBy(F.desc("time_unix_nano"), F.desc("value")))
    found = each.withColumn("_n", newest).where("_n = 1").withColumn("timestamp", F.expr("time_unix_nano div 1000"))
    return found.select(*[f"`{k}`" for k in keys], "timestamp", "value", "trace_id", "span_id").orderBy(F.desc("value"), F.desc("timestamp"), "trace_id", "span_id").limit(limited(limit, 20, 200))


def slow_requests_from_metric(metrics: DataFrame, tenant: str, metric_name: str, window: TimeWindow, service: str = "", filters: Iterable[AttrFilter] = (), value: Range = Range(), limit: int | None = None) -> DataFrame:
    """trace_id, span_id, timestamp, value, unit of the highest exemplars; values are
    rounded where the metric's unit is ms."""
    filters = [*filters, *([AttrFilter("service.name", service)] if service else [])]
    found = query_exemplars(metrics, tenant, metric_name, window, "", filters, value, limited(limit, 5, 20))
    unit = latest(metrics.where(F.col("timestamp") >= window.start), tenant, metric_name, "metric_unit").withColumnRenamed("metric_unit", "unit")
    joined = found.join(F.broadcast(unit))  # one row
    rounded = F.when(F.col("unit") == "ms", F.round("value", 2)).otherwise(F.col("value"))
    return joined.select("trace_id", "span_id", "timestamp", rounded.alias("value"), "unit").orderBy(F.desc("value"), F.desc("timestamp"))


def slow_requests_from_spans(traces: DataFrame, tenant: str, window: TimeWindow, service: str = "", span_name: str = "", filters: Iterable[AttrFilter] = (), value: Range = Range(), limit: int | None = None) -> DataFrame:
    """The same from root spans, slowest first."""
    roots = span_scope(traces, tenant, service, filters, value).where((F.col("parent_span_id") == "") & window.holds("start_time"))
    if span_name:
        roots = roots.where(F.col("span_name") == span_name)
    top = roots.orderBy(F.desc("duration_ms"), F.desc("start_time"), "trace_id", "span_id").limit(limited(limit, 5, 20))
    return top.select("trace_id", "span_id", F.col("start_time").alias("timestamp"), F.round("duration_ms", 2).alias("value"), F.lit("ms").alias("unit"))


def slow_requests(traces: DataFrame, logs: DataFrame, slow: DataFrame, tenant: str) -> DataFrame:
    """Each slow request with a brief summary of its trace. The requests, few by then, are
    written once."""
    from otelframe.operators.traces import BRIEF, trace_summaries

    slow = written(slow)
    summaries = trace_summaries(traces, logs, slow.select("trace_id").distinct().withColumn("pos", F.lit(0)), tenant, BRIEF)
    return slow.join(summaries.drop("pos"), "trace_id", "left")
