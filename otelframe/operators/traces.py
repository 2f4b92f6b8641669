"""Trace summaries: facets over the capped spans of the asked traces, which are written once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from otelframe.operators.search import of_tenant
from otelframe.sources.shared import written

MAX_SPANS = 5000
ERROR = "STATUS_CODE_ERROR"
WARN_NUMBER, BODY_CHARS = 13, 300
MAX_DEPTH = 50
#: Groups in which the spans of a trace above the cap are ranked first.
SLICES = 64
SPAN_COLUMNS = ["trace_id", "span_id", "parent_span_id", "service_name", "span_name", "start_time", "end_time", "duration_ms", "status_code", "status_message"]


class Limits(NamedTuple):
    groups: int = 15
    slowest: int = 10
    errors: int = 10
    problems: int = 10


FULL, BRIEF = Limits(), Limits(3, 3, 1, 1)


def trace_ids(spark, ids: list[str]) -> DataFrame:
    """Asked traces with their place; blank ids are an input error, repeats stay."""
    if not ids or any(not i for i in ids):
        raise ValueError("trace_id is required")
    return spark.createDataFrame(list(enumerate(ids)), "pos int, trace_id string").select("trace_id", "pos")


def capped_spans(traces: DataFrame, ids: DataFrame, tenant: str, cap: int = MAX_SPANS) -> DataFrame:
    """The first ``cap`` spans of each asked trace by start and id, with the trace's true
    size ``span_total``."""
    own = of_tenant(traces, tenant).join(ids.select("trace_id").distinct(), "trace_id", "left_semi")
    return _capped(own, cap)


def _capped(own: DataFrame, cap: int) -> DataFrame:
    """Sizes are counted before they travel. Only traces above the cap are ranked, first in
    SLICES groups of their spans, so that no task sorts more than SLICES * cap of them."""
    sizes = own.groupBy("trace_id").agg(F.count(F.lit(1)).alias("span_total"))
    sized = own.join(sizes, "trace_id")
    order = [F.col("start_time"), F.col("span_id")]
    large = sized.where(F.col("span_total") > cap).withColumn("_slice", F.pmod(F.xxhash64("span_id", "start_time"), F.lit(SLICES)))
    for keys in (["trace_id", "_slice"], ["trace_id"]):
        large = large.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= cap)
    return sized.where(F.col("span_total") <= cap).unionByName(large.drop("_slice", "_rn"))


def roots(spans: DataFrame) -> DataFrame:
    """trace_id, root_id, root_missing: the earliest span without a parent, else the
    earliest span."""
    order = F.struct((F.col("parent_span_id") != "").alias("child"), "start_time", "span_id")
    return spans.groupBy("trace_id").agg(F.min(order).alias("r")).select("trace_id", F.col("r.span_id").alias("root_id"), F.col("r.child").alias("root_missing"))


def self_times(spans: DataFrame) -> DataFrame:
    """``spans`` with self_us: the duration minus the union of direct children clipped
    to it, never below 0."""
    p = spans.select("trace_id", F.col("span_id").alias("pid"), F.col("start_time").alias("ps"), F.col("end_time").alias("pe"))
    c = spans.where("parent_span_id <> ''").select("trace_id", F.col("parent_span_id").alias("pid"), F.col("span_id").alias("cid"), "start_time", "end_time")
    clipped = c.join(p, ["trace_id", "pid"]).select("trace_id", "pid", "cid", F.greatest("start_time", "ps").alias("s"), F.least("end_time", "pe").alias("e")).where("e > s")
    reach = F.max("e").over(Window.partitionBy("trace_id", "pid").orderBy("s", "e", "cid").rowsBetween(Window.unboundedPreceding, -1))
    covered = clipped.withColumn("reach", reach).groupBy("trace_id", "pid").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce("reach", "s")))).alias("covered"))
    joined = spans.join(covered.withColumnRenamed("pid", "span_id"), ["trace_id", "span_id"], "left")
    return joined.withColumn("self_us", F.greatest(F.lit(0), F.col("end_time") - F.col("start_time") - F.coalesce("covered", F.lit(0)))).drop("covered")


def timed_spans(traces: DataFrame, tenant: str, ids: DataFrame | None = None, cap: int = MAX_SPANS) -> DataFrame:
    """Capped spans of the asked traces (all of the tenant's without ``ids``), with their
    self times. The capped spans are written once, as three sides of joins read them."""
    own = of_tenant(traces, tenant).select(*SPAN_COLUMNS)
    if ids is not None:
        own = own.join(ids.select("trace_id").distinct(), "trace_id", "left_semi")
    return self_times(written(_capped(own, cap)))


def span_groups(spans: DataFrame, root: DataFrame) -> DataFrame:
    """Spans by (service, name) without the root: count, total, self and longest time,
    errors, and place in the trace's order."""
    rest = spans.join(root, "trace_id").where("span_id <> root_id")
    groups = rest.groupBy("trace_id", "service_name", "span_name").agg(*_group_stats())
    order = Window.partitionBy("trace_id").orderBy(F.desc("self_ms"), F.desc("total_ms"), F.desc("count"), "service_name", "span_name")
    return groups.withColumn("place", F.row_number().over(order))


def _group_stats(of: Column | None = None) -> list[Column]:
    """Figures of a group of spans, of those that ``of`` holds for."""
    of = F.lit(True) if of is None else of
    only = lambda c: F.when(of, F.col(c))
    return [
        F.count_if(of).alias("count"), F.round(F.sum(only("duration_ms")), 2).alias("total_ms"), F.round(F.sum(only("self_us")) / 1000, 2).alias("self_ms"),
        F.round(F.max(only("duration_ms")), 2).alias("max_ms"), F.count_if(of & (F.col("status_code") == ERROR)).alias("errors"),
    ]


def span_services(spans: DataFrame) -> DataFrame:
    """Spans and errors by service."""
    return spans.groupBy("trace_id", "service_name").agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("status_code") == ERROR).alias("errors"))


def slowest_spans(spans: DataFrame, root: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("trace_id").orderBy(F.desc("duration_ms"), "start_time", "span_id")
    return spans.join(root, "trace_id").where("span_id <> root_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def error_spans(spans: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("trace_id").orderBy("start_time", "span_id")
    return spans.where(F.col("status_code") == ERROR).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def trace_times(spans: DataFrame) -> DataFrame:
    """Start, duration and errors of each trace."""
    return spans.groupBy("trace_id").agg(*_time_stats())


def _time_stats() -> list[Column]:
    return [
        F.min("start_time").alias("start_time"), F.round(F.greatest(F.lit(0), F.max("end_time") - F.min("start_time")) / 1000, 2).alias("duration_ms"),
        F.count_if(F.col("status_code") == ERROR).alias("error_count"), F.count(F.lit(1)).alias("kept"),
    ]


def trace_logs(logs: DataFrame, ids: DataFrame, tenant: str) -> DataFrame:
    return of_tenant(logs, tenant).join(ids.select("trace_id").distinct(), "trace_id", "left_semi")


def _severity() -> Column:
    return F.when(F.col("severity_text") == "", "UNSET").otherwise(F.upper("severity_text"))


def log_severities(logs: DataFrame) -> DataFrame:
    """Logs by upper-case severity; an empty one is UNSET."""
    return logs.groupBy("trace_id", _severity().alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def log_problems(logs: DataFrame, n: int) -> DataFrame:
    """Warnings and worse, oldest first, long bodies cut."""
    order = Window.partitionBy("trace_id").orderBy("timestamp", "span_id", "body")
    body = F.when(F.length("body") > BODY_CHARS, F.concat(F.left("body", F.lit(BODY_CHARS)), F.lit("..."))).otherwise(F.col("body"))
    found = logs.where(F.col("severity_number") >= WARN_NUMBER).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return found.select("trace_id", "place", "timestamp", "service_name", "severity_text", body.alias("body"), "span_id")


def _values(rows: Column, n: int | None = None) -> Column:
    """The fields ``v`` of the first ``n`` rows in order."""
    ordered = F.array_sort(rows)
    return F.transform(ordered if n is None else F.slice(ordered, 1, n), lambda x: x["v"])


def trace_summaries(traces: DataFrame, logs: DataFrame, ids: DataFrame, tenant: str, limits: Limits = FULL, cap: int = MAX_SPANS) -> DataFrame:
    """One row per asked trace (trace_id, pos), unknown ids included with span_count 0:
    sizes, times, root, services, groups, slowest, errors, and logs of the trace.

    Capped spans with their self times are written once and read by two group-bys: one by
    trace, one by trace, service and name, which a third sums up by trace. Lists by trace
    hold ``cap`` spans at most.
    """
    asked = written(ids.select("trace_id", "pos"))
    spans = written(timed_spans(traces, tenant, asked, cap).withColumn("self_ms", F.round(F.col("self_us") / 1000, 2)))
    brief = F.struct("span_id", "service_name", "span_name", "start_time", "duration_ms", "self_ms", "status_code", "status_message")
    first = F.struct((F.col("parent_span_id") != "").alias("child"), "start_time", "span_id", brief.alias("v"))
    slow = F.struct((-F.col("duration_ms")).alias("less"), "start_time", "span_id", brief.alias("v"))
    failed = F.when(F.col("status_code") == ERROR, F.struct("start_time", "span_id", brief.alias("v")))
    by_trace = spans.groupBy("trace_id").agg(*_time_stats(), F.first("span_total").alias("span_total"), F.min(first).alias("r"), F.collect_list(slow).alias("slow"), F.collect_list(failed).alias("failed"))
    by_trace = by_trace.select(
        "trace_id", "span_total", "kept", "start_time", "duration_ms", "error_count", F.col("r.v").alias("root"), F.col("r.child").alias("root_missing"),
        F.when(F.col("r.child"), F.lit(0.0)).otherwise(F.col("r.v.self_ms")).alias("untraced_ms"),
        _values(F.filter("slow", lambda x: x["span_id"] != F.col("r.span_id")), limits.slowest).alias("slowest"), _values(F.col("failed"), limits.errors).alias("errors"),
    )
    rooted = spans.withColumn("root_id", F.min(first).over(Window.partitionBy("trace_id"))["span_id"])
    named = rooted.groupBy("trace_id", "service_name", "span_name").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("status_code") == ERROR).alias("all_errors"), *_group_stats(F.col("span_id") != F.col("root_id")))
    figures = F.struct("service_name", "span_name", "count", "total_ms", "self_ms", "max_ms", "errors")
    group = F.when(F.col("count") > 0, F.struct((-F.col("self_ms")).alias("a"), (-F.col("total_ms")).alias("b"), (-F.col("count")).alias("c"), "service_name", "span_name", figures.alias("v")))
    services = named.groupBy("trace_id", "service_name").agg(F.sum("all").alias("spans"), F.sum("all_errors").alias("errors"), F.collect_list(group).alias("g"))
    service = F.struct((-F.col("spans")).alias("less"), "service_name", F.struct("service_name", "spans", "errors").alias("v"))
    by_group = services.groupBy("trace_id").agg(F.collect_list(service).alias("s"), F.flatten(F.collect_list("g")).alias("g"))
    by_group = by_group.select("trace_id", _values(F.col("s")).alias("services"), F.size("g").cast("long").alias("groups_total"), _values(F.col("g"), limits.groups).alias("groups"))

    own_logs = trace_logs(logs, asked, tenant).select("trace_id", "timestamp", "service_name", "severity_text", "severity_number", "body", "span_id")
    counted = log_severities(own_logs).groupBy("trace_id").agg(F.sum("n").alias("log_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("by_severity"))
    problem = F.struct("place", F.struct("timestamp", "service_name", "severity_text", "body", "span_id").alias("v"))
    problems = log_problems(own_logs, limits.problems).groupBy("trace_id").agg(_values(F.collect_list(problem)).alias("problems"))

    out = asked
    for facet in (by_trace, by_group, counted, problems):
        out = out.join(facet, "trace_id", "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns(
        {
            "span_count": F.coalesce("span_total", zero), "error_count": F.coalesce("error_count", zero), "groups_total": F.coalesce("groups_total", zero),
            "groups_more": F.greatest(zero, F.coalesce("groups_total", zero) - limits.groups), "log_count": F.coalesce("log_count", zero),
            "truncated": F.coalesce(F.col("span_total") > F.col("kept"), F.lit(False)), "root_missing": F.coalesce("root_missing", F.lit(False)),
        }
    )
    return out.drop("span_total", "kept").orderBy("pos")


def depths(spans: DataFrame, cap: int = MAX_DEPTH) -> DataFrame:
    """trace_id, span_id, depth: steps up the parent chain, at most ``cap``. Each round
    doubles the steps that a span knows and is written; rounds end when every span has
    reached its topmost one, so a chain takes few joins. Of rows with one span id the least
    parent counts, so that each id has one depth."""
    once = spans.groupBy("trace_id", "span_id").agg(F.min("parent_span_id").alias("at"))
    known = once.select("trace_id", F.col("span_id").alias("at"), F.lit(True).alias("has"))
    up = once.select("trace_id", "span_id", "at").join(known, ["trace_id", "at"], "left")
    jump = up.select("trace_id", "span_id", F.when(F.col("has"), F.col("at")).alias("at"), F.when(F.col("has"), 1).otherwise(0).alias("depth"))
    steps = 1
    while steps < cap:
        jump = written(jump)
        if jump.where("at is not null").isEmpty():
            break
        above = jump.select("trace_id", F.col("span_id").alias("at"), F.col("at").alias("further"), F.col("depth").alias("more"))
        jump = jump.join(above, ["trace_id", "at"], "left").select("trace_id", "span_id", F.col("further").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        steps *= 2
    return jump.select("trace_id", "span_id", F.least("depth", F.lit(cap)).alias("depth"))


def waterfall(spans: DataFrame) -> DataFrame:
    """Offset and width of each span in percent of its trace, and its depth."""
    spans = written(spans.select("trace_id", "span_id", "parent_span_id", "span_name", "start_time", "end_time"))
    w = Window.partitionBy("trace_id")
    first, last = F.min("start_time").over(w), F.max("end_time").over(w)
    placed = spans.withColumn("_first", first).withColumn("_total", F.greatest(last - first, F.lit(1)))
    placed = placed.select(
        "trace_id", "span_id", "span_name", "start_time",
        ((F.col("start_time") - F.col("_first")) / F.col("_total") * 100).alias("offset_pct"),
        F.greatest((F.col("end_time") - F.col("start_time")) / F.col("_total") * 100, F.lit(0.3)).alias("width_pct"),
    )
    return placed.join(depths(spans), ["trace_id", "span_id"])


def attach_logs(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Logs with ``level``: span where their span is in the trace, else trace."""
    keys = spans.select("trace_id", "span_id").distinct().withColumn("_has", F.lit(True))
    joined = logs.join(keys, ["trace_id", "span_id"], "left")
    return joined.withColumn("level", F.when(F.col("_has") & (F.col("span_id") != ""), "span").otherwise("trace")).drop("_has")


def group_share(groups: DataFrame, times: DataFrame) -> DataFrame:
    """Percent of the trace's duration spent in each group itself, within 0 and 100."""
    joined = groups.join(times.select("trace_id", "duration_ms"), "trace_id")
    share = F.when(F.col("duration_ms") > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("self_ms") / F.col("duration_ms") * 100))).otherwise(0.0)
    return joined.withColumn("share_pct", share).drop("duration_ms")
