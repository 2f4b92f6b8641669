"""The library's operators as queries over derived signals, with oracle SQL.

Each entry runs over the whole derived tables; limits are those of top-k operators.
Times are counted back from fixed instants inside the data.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from otelframe.functions.attrs import AttrFilter, attr, finite_columns, stored
from otelframe.functions.units import from_ms, to_ms
from otelframe.functions.window import MINUTE, Range, TimeWindow
from otelframe.operators import compare, exemplars, metrics, search, series, traces
from otelframe.plans.suite import register
from otelframe.sources import otlp, store
from otelframe.sources.fixtures import oracle, signals
from otelframe.sources.shared import new_folder


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
DAY = 24 * 60
#: 1998-01-01 for spans, 2024-01-11 for events (UTC, microseconds).
SPANS_AT, EVENTS_AT = 883_612_800_000_000, 1_704_931_200_000_000
SPANS = TimeWindow(SPANS_AT, 3 * 365 * DAY)
EVENTS = TimeWindow(EVENTS_AT, DAY)
SPANS_SQL = f"start_time >= {SPANS.start}"
EVENTS_SQL = f"timestamp >= {EVENTS.start}"
ACME, TENANT = "acme", "json_extract_string(resource_attributes, '$.\"tenant.id\"') = 'acme'"


def query(name: str, sql: str | None):
    """Register a function of (signals, spark); ``sql`` reads the same views."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(signals(spark, sf_dir), spark)

        QUERIES[name] = Query(run, oracle(sql) if sql else None)
        return f

    return add


def js(column: str, key: str) -> str:
    return f"json_extract_string({column}, '$.\"{key}\"')"


# ---- sources ----


@query("s08_stored_floats", "select service_name, round(sum(case when isfinite(v) then v else 0 end), 4) as total, count(*) as n from (select service_name, case when duration_ms > 90 then 'inf'::double when duration_ms < 10 then 'nan'::double else duration_ms end as v from traces where parent_span_id <> '') group by service_name")
def _(s, spark):
    v = F.when(F.col("duration_ms") > 90, F.lit(float("inf"))).when(F.col("duration_ms") < 10, F.lit(float("nan"))).otherwise(F.col("duration_ms"))
    return s["traces"].where("parent_span_id <> ''").groupBy("service_name").agg(F.round(F.sum(stored(v)), 4).alias("total"), F.count(F.lit(1)).alias("n"))


def _stored(s, *names: str) -> str:
    """The signals appended to a store of their own in the shared folder."""
    root = new_folder(s["traces"].sparkSession)
    for name in names:
        store.append(s[name], root, name)
    return root


@query("s13_scan_counts", "select 'traces' as signal, count(*) as n, count(distinct service_name) as services, cast(sum(length(attributes)) as bigint) as chars from traces union all select 'logs', count(*), count(distinct service_name), cast(sum(length(attributes)) as bigint) from logs union all select 'metrics', count(*), count(distinct service_name), cast(sum(length(attributes)) as bigint) from metrics")
def _(s, spark):
    root = _stored(s, *s)
    parts = [store.scan(spark, root, n).agg(F.lit(n).alias("signal"), F.count(F.lit(1)).alias("n"), F.count_distinct("service_name").alias("services"), F.sum(F.length("attributes")).alias("chars")) for n in s]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s14_pruned_scan", f"select service_name, count(*) as n, max(timestamp) as newest from logs where {TENANT} and timestamp >= {EVENTS.start} group by service_name")
def _(s, spark):
    pruned = store.windowed(spark, _stored(s, "logs"), "logs", EVENTS, ACME)
    return pruned.where(EVENTS.holds("timestamp")).groupBy("service_name").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("newest"))


@query("s16_compacted_scan", "select cast(epoch_us(date_trunc('day', make_timestamp(timestamp))) as bigint) as day, count(*) as n, count(distinct body) as bodies, 1 as files from logs group by 1")
def _(s, spark):
    root = _stored(s, "logs")
    store.compact(spark, root, "logs", store.partitions(spark, root, "logs"))
    day = F.expr("(timestamp div 86400000000) * 86400000000").alias("day")
    rows = store.scan(spark, root, "logs").groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("body").alias("bodies"))
    files = store.partitions(spark, root, "logs").select(F.unix_micros(F.to_timestamp(F.col("date").cast("string"))).alias("day"), F.col("files").cast("int").alias("files"))
    return rows.join(files, "day")


@query("s19_retained_scan", "select count(*) as n, min(timestamp) as oldest from logs where timestamp >= (1704931200000000 - 5 * 86400000000)")
def _(s, spark):
    root = _stored(s, "logs")
    store.retain(spark, root, "5d", EVENTS_AT)
    return store.scan(spark, root, "logs").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("oldest"))


# ---- export requests, made from the signals ----


def _pairs(column: str):
    """A JSON object of strings as a typed attribute list."""
    entries = F.map_entries(F.from_json(column, "map<string,string>"))
    return F.transform(entries, lambda e: F.struct(e["key"], F.struct(e["value"].alias("stringValue")).alias("value")))


def _nanos(column: str):
    return F.concat(F.col(column).cast("string"), F.lit("000"))


def _requests_of(rows: DataFrame, outer: str, middle: str, inner: str, record) -> DataFrame:
    """One export request for each row."""
    scoped = F.array(F.struct(F.struct(F.lit("lib").alias("name"), F.lit("1").alias("version")).alias("scope"), F.array(record).alias(inner)))
    resource = F.struct(F.struct(_pairs("resource_attributes").alias("attributes")).alias("resource"), scoped.alias(middle))
    return rows.select(F.to_json(F.struct(F.array(resource).alias(outer))).alias("value"))


@query("s01_flatten_traces", f"select trace_id, span_id, parent_span_id, service_name, span_name, span_kind, start_time, end_time, round(duration_ms, 3) as duration_ms, status_code, status_message, {js('attributes', 'part')} as part, {js('attributes', 'http.route')} as route, {js('resource_attributes', 'tenant.id')} as tenant, 'lib' as scope_name from traces")
def _(s, spark):
    record = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id"), F.base64(F.encode("span_id", "utf-8")).alias("spanId"), F.base64(F.encode("parent_span_id", "utf-8")).alias("parentSpanId"), F.col("span_name").alias("name"),
        F.when(F.col("span_kind") == "SPAN_KIND_SERVER", F.lit("2")).otherwise(F.col("span_kind")).alias("kind"), _nanos("start_time").alias("startTimeUnixNano"), _nanos("end_time").alias("endTimeUnixNano"),
        _pairs("attributes").alias("attributes"), F.struct(F.col("status_code").alias("code"), F.col("status_message").alias("message")).alias("status"),
    )
    rows = otlp.flatten_traces(_requests_of(s["traces"], "resourceSpans", "scopeSpans", "spans", record))
    text = lambda c: F.decode(F.unhex(c), "utf-8").alias(c)
    return rows.select(
        "trace_id", text("span_id"), text("parent_span_id"), "service_name", "span_name", "span_kind", "start_time", "end_time", F.round("duration_ms", 3).alias("duration_ms"), "status_code", "status_message",
        attr("attributes", "part").alias("part"), attr("attributes", "http.route").alias("route"), attr("resource_attributes", "tenant.id").alias("tenant"), "scope_name",
    )


@query("s02_flatten_logs", f"select timestamp, observed_timestamp, trace_id, severity_number, severity_text, body, service_name, {js('attributes', 'k')} as k from logs")
def _(s, spark):
    record = F.struct(
        _nanos("timestamp").alias("timeUnixNano"), _nanos("observed_timestamp").alias("observedTimeUnixNano"), F.col("trace_id").alias("traceId"), F.col("severity_number").alias("severityNumber"),
        F.col("severity_text").alias("severityText"), F.struct(F.col("body").alias("stringValue")).alias("body"), _pairs("attributes").alias("attributes"),
    )
    rows = otlp.flatten_logs(_requests_of(s["logs"], "resourceLogs", "scopeLogs", "logRecords", record))
    return rows.select("timestamp", "observed_timestamp", "trace_id", "severity_number", "severity_text", "body", "service_name", attr("attributes", "k").alias("k"))


@query("s03_flatten_metrics", f"select metric_name, metric_unit, metric_type, timestamp, start_timestamp, round(value_double, 6) as value_double, count, round(sum, 6) as sum, bucket_counts, {js('attributes', 'event_type')} as event_type, is_monotonic, aggregation_temporality, json_extract_string(nullif(exemplars, ''), '$[0].trace_id') as exemplar from metrics")
def _(s, spark):
    point = [_nanos("timestamp").alias("timeUnixNano"), _nanos("start_timestamp").alias("startTimeUnixNano"), _pairs("attributes").alias("attributes")]
    numbers = F.array(F.struct(*point, F.col("value_double").alias("asDouble")))
    seen = F.transform(F.from_json(F.when(F.col("exemplars") == "", "[]").otherwise(F.col("exemplars")), exemplars.EXEMPLARS), lambda e: F.struct(e["time_unix_nano"].cast("string").alias("timeUnixNano"), e["trace_id"].alias("traceId"), e["value"].alias("asDouble")))
    buckets = F.array(F.struct(
        *point, F.col("count").cast("string").alias("count"), "sum", "min", "max", F.from_json("bucket_counts", "array<string>").alias("bucketCounts"),
        F.from_json("explicit_bounds", "array<double>").alias("explicitBounds"), seen.alias("exemplars"),
    ))
    kind = lambda k, v: F.when(F.col("metric_type") == k, v)
    temporality = F.col("aggregation_temporality").alias("aggregationTemporality")
    record = F.struct(
        F.col("metric_name").alias("name"), F.col("metric_unit").alias("unit"), kind("gauge", F.struct(numbers.alias("dataPoints"))).alias("gauge"),
        kind("sum", F.struct(numbers.alias("dataPoints"), F.col("is_monotonic").alias("isMonotonic"), temporality)).alias("sum"),
        kind("histogram", F.struct(buckets.alias("dataPoints"), temporality)).alias("histogram"),
    )
    rows = otlp.flatten_metrics(_requests_of(s["metrics"], "resourceMetrics", "scopeMetrics", "metrics", record))
    return rows.select(
        "metric_name", "metric_unit", "metric_type", "timestamp", "start_timestamp", F.round("value_double", 6).alias("value_double"), "count", F.round("sum", 6).alias("sum"), "bucket_counts",
        attr("attributes", "event_type").alias("event_type"), "is_monotonic", "aggregation_temporality", F.get_json_object("exemplars", "$[0].trace_id").alias("exemplar"),
    )


@query("s10_stamped_tenants", f"select {js('resource_attributes', 'tenant.id')} as sent, case when service_name = 'svc-1' then 'globex' else {js('resource_attributes', 'tenant.id')} end as tenant, count(*) as n from logs where service_name in ('svc-0', 'svc-1') or (service_name = 'svc-2' and {TENANT}) group by 1, 2")
def _(s, spark):
    """svc-0 sends for all tenants, svc-1 for one, svc-2 for some; other senders have no key."""
    keys = s["logs"].where("service_name in ('svc-0', 'svc-1', 'svc-2')").select(F.col("service_name").alias("sender_key")).distinct()
    keys = keys.withColumn("tenants", F.expr("case sender_key when 'svc-0' then array() when 'svc-1' then array('globex') else array('acme', 'nobody') end"))
    sent = attr("resource_attributes", "tenant.id")
    accepted, _ = otlp.stamp_tenants(s["logs"].withColumn("sender_key", F.col("service_name")).withColumn("sent", sent), keys)
    return accepted.groupBy("sent", sent.alias("tenant")).agg(F.count(F.lit(1)).alias("n"))


@query("s21_finite_results", "select span_name, case when n > 7000 then null else round(total, 4) end as total, n from (select span_name, sum(duration_ms) as total, count(*) as n from traces group by span_name)")
def _(s, spark):
    rows = s["traces"].groupBy("span_name").agg(F.sum("duration_ms").alias("total"), F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("total", F.when(F.col("n") > 7000, F.lit(float("nan"))).otherwise(F.round("total", 4)))
    return finite_columns(rows)


# ---- predicates ----


def spans_found(name: str, conditions: str, **options) -> None:
    sql = f"select trace_id, span_id, start_time, duration_ms from traces where {TENANT} and {conditions} order by start_time desc, trace_id, span_id limit 100"

    @query(name, sql)
    def _(s, spark):
        window = options.get("window", SPANS)
        args = {k: v for k, v in options.items() if k != "window"}
        return search.search_spans(s["traces"], ACME, window, **args).select("trace_id", "span_id", "start_time", "duration_ms")


_a, _r = "attributes", "resource_attributes"
spans_found("p01_tenant", SPANS_SQL)
spans_found("p03_attr_equals", f"{SPANS_SQL} and ({js(_a, 'line.status')} = 'F' or {js(_r, 'line.status')} = 'F')", filters=[AttrFilter("line.status", "F")])
spans_found("p03b_resource_equals", f"{SPANS_SQL} and ({js(_a, 'service.name')} = 'supplier-2' or {js(_r, 'service.name')} = 'supplier-2')", filters=[AttrFilter("service.name", "supplier-2")])
spans_found("p04_attr_not_equals", f"{SPANS_SQL} and coalesce({js(_a, 'line.status')}, '') <> 'F' and coalesce({js(_r, 'line.status')}, '') <> 'F'", filters=[AttrFilter("line.status", "F", "!=")])
spans_found("p04b_attr_present", f"{SPANS_SQL} and (coalesce({js(_a, 'part')}, '') <> '' or coalesce({js(_r, 'part')}, '') <> '')", filters=[AttrFilter("part", "", "!=")])
spans_found("p05_span_columns", f"{SPANS_SQL} and span_kind = 'SPAN_KIND_CLIENT' and status_code <> 'STATUS_CODE_ERROR'", filters=[AttrFilter("span_kind", "SPAN_KIND_CLIENT"), AttrFilter("status_code", "STATUS_CODE_ERROR", "!=")])
spans_found("p07_closed_window", f"start_time >= {SPANS_AT - 90 * DAY * MINUTE} and start_time < {SPANS_AT - 30 * DAY * MINUTE}", window=TimeWindow(SPANS_AT, 90 * DAY, 30 * DAY))
spans_found("p08_duration_range", f"{SPANS_SQL} and duration_ms >= 40 and duration_ms <= 50", duration=Range(40, 50))
spans_found("p09_service", f"{SPANS_SQL} and service_name = 'svc-3'", service="svc-3")


def logs_found(name: str, conditions: str, window: TimeWindow = EVENTS, **options) -> None:
    sql = f"select timestamp, trace_id, severity_text, body from logs where {TENANT} and {conditions} order by timestamp desc, body, trace_id limit 100"

    @query(name, sql)
    def _(s, spark):
        return search.search_logs(s["logs"], ACME, window, **options).select("timestamp", "trace_id", "severity_text", "body")


TRACE_9 = "00000000000000000000000000000009"
logs_found("p10_severity", f"{EVENTS_SQL} and upper(severity_text) = 'WARN'", severity="warn")
logs_found("p11_body_wildcards", f"{EVENTS_SQL} and body ilike '%USER 1_ %'", body="USER 1_ ")
logs_found("q03_logs_by_trace", f"trace_id = '{TRACE_9}'", TimeWindow(EVENTS_AT, 0), trace_id=TRACE_9)
logs_found("q03b_logs_by_service", f"{EVENTS_SQL} and service_name = 'svc-1' and ({js(_a, 'k')} = '1' or {js(_r, 'k')} = '1')", service="svc-1", filters=[AttrFilter("k", "1")])


@query("p02_attribute_access", f"select coalesce({js(_r, 'host.name')}, 'none') as host, {js(_a, 'k')} as k, count(*) as n from metrics where metric_name = 'event.gauge' group by 1, 2")
def _(s, spark):
    return s["metrics"].where("metric_name = 'event.gauge'").groupBy(F.coalesce(attr("resource_attributes", "host.name"), F.lit("none")).alias("host"), attr("attributes", "k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("p12_status_shorthand", "select trace_id, span_id, service_name from traces where status_code = 'STATUS_CODE_ERROR' order by start_time desc, trace_id, span_id limit 50")
def _(s, spark):
    found = s["traces"].where(F.col("status_code") == F.concat(F.lit("STATUS_CODE_"), F.upper(F.lit("error"))))
    return found.orderBy(F.desc("start_time"), "trace_id", "span_id").limit(50).select("trace_id", "span_id", "service_name")


@query("p15_limit_cap", f"select count(*) as n from (select 1 from traces where {TENANT} and {SPANS_SQL} limit 1000)")
def _(s, spark):
    return search.search_spans(s["traces"], ACME, SPANS, limit=5000).agg(F.count(F.lit(1)).alias("n"))


# ---- lookups ----

#: A trace of the tenant at every scale.
TRACE_109 = f"{109:032x}"


@query("q01_lookup_trace", f"select span_id, parent_span_id, start_time, duration_ms, status_code from traces where trace_id = '{TRACE_109}' and {TENANT} order by start_time, span_id limit 1000")
def _(s, spark):
    return search.lookup_trace(s["traces"], TRACE_109, ACME).select("span_id", "parent_span_id", "start_time", "duration_ms", "status_code")


@query("q04_browse_errors", "select trace_id, span_id, duration_ms from traces where service_name = 'supplier-4' and status_code = 'STATUS_CODE_ERROR' order by start_time desc, trace_id, span_id limit 300")
def _(s, spark):
    found = search.browse(s["traces"], "start_time", {"service_name": "supplier-4", "status": "error"}, 300)
    return found.select("trace_id", "span_id", "duration_ms")


@query("q05_raw_sql", "select service_name, status_code, count(*) as n from traces group by 1, 2")
def _(s, spark):
    register(spark, s)
    return spark.sql("select service_name, status_code, count(*) as n from traces group by 1, 2")


@query("q06_tenants", f"select distinct tenant from (select {js(_r, 'tenant.id')} as tenant from traces union select {js(_r, 'tenant.id')} from logs union select {js(_r, 'tenant.id')} from metrics)")
def _(s, spark):
    return search.list_tenants(s["traces"], s["logs"], s["metrics"])


@query("q07_services", f"select 'traces' as signal, service_name from (select distinct service_name from traces where {TENANT}) union all select 'logs', service_name from (select distinct service_name from logs where {TENANT})")
def _(s, spark):
    of = lambda n: search.list_values(s[n], ACME, "service_name").select(F.lit(n).alias("signal"), "service_name")
    return of("traces").unionByName(of("logs"))


@query("q08_metric_names", f"select distinct metric_name from metrics where {TENANT}")
def _(s, spark):
    return search.list_values(s["metrics"], ACME, "metric_name")


@query("q09_latest_unit", f"select arg_max(metric_unit, timestamp) as metric_unit from metrics where {TENANT} and metric_name = 'event.delta'")
def _(s, spark):
    return search.latest(s["metrics"], ACME, "event.delta", "metric_unit")


# ---- number metrics ----

GAUGE = f"metrics where {TENANT} and metric_name = 'event.gauge' and {EVENTS_SQL}"


def number_query(name: str, agg: str, sql_value: str, group: str = "", keys: str = "", step: str | None = None, metric: str = "event.gauge") -> None:
    size = 3_600_000_000
    parts = ([f"(timestamp // {size}) * {size} as time"] if step else []) + ([keys] if keys else [])
    scope = GAUGE.replace("event.gauge", metric)
    by = f" group by {', '.join(str(i + 1) for i in range(len(parts) + max(0, keys.count(' as ') - 1)))}" if parts else ""
    sql = f"select {', '.join([*parts, ''])} round({sql_value}, 4) as value from {scope}{by}".replace(",  round", ", round")

    @query(name, sql)
    def _(s, spark):
        rows = metrics.query_metric(s["metrics"], ACME, metric, agg, EVENTS, group, step=step, exact=True)
        return rows.withColumn("value", F.round("value", 4))


HOST, K = f"{js(_r, 'host.name')} as \"resource.host.name\"", f"{js(_a, 'k')} as \"attr.k\""
number_query("a01_avg", "avg", "avg(value_double)")
number_query("a01b_sum_by_host", "sum", "sum(value_double)", "resource.host.name", HOST)
number_query("a01c_min_by_service", "min", "min(value_double)", "service.name", 'service_name as "service.name"')
number_query("a01d_max", "max", "max(value_double)")
number_query("a01e_count_by_key", "count", "cast(count(value_double) as double)", "attr.k", K)
number_query("a02_p50", "p50", "quantile_cont(value_double, 0.5)")
number_query("a02b_p95_by_host", "p95", "quantile_cont(value_double, 0.95)", "resource.host.name", HOST)
number_query("a02c_p99", "p99", "quantile_cont(value_double, 0.99)")
number_query("a03_two_keys", "mean", "avg(value_double)", "resource.host.name,service_name", f"{HOST}, service_name as service_name")
number_query("a04_step", "sum", "sum(value_double)", step="1h")
number_query("a04b_step_by_host", "count", "cast(count(value_double) as double)", "resource.host.name", HOST, step="1h")

# ---- histograms ----

_SERIES = "partition by attributes, resource_attributes, start_timestamp, explicit_bounds, aggregation_temporality order by timestamp"


def within(window: TimeWindow) -> str:
    return f"timestamp >= {window.start}" + (f" and timestamp < {window.end}" if window.end else "")


def histogram_sql(metric: str, body: str, window: TimeWindow = EVENTS) -> str:
    """Oracle views: inc (increments a point) and bucket (increments a bucket)."""
    return f""", pts as (
  select *, cast(bucket_counts as json)::double[] as b, aggregation_temporality = '{metrics.CUMULATIVE}' as cum
  from metrics where {TENANT} and metric_name = '{metric}' and {within(window)}),
lagged as (
  select *, lag(count) over w as pc, lag(sum) over w as ps, lag(b) over w as pb from pts window w as ({_SERIES})),
inc as (
  select *, case when not cum or count < pc or (pc is null and start_timestamp >= {window.start}) then count when pc is null then 0 else count - pc end as dc,
         case when not cum or count < pc or (pc is null and start_timestamp >= {window.start}) then sum when pc is null then 0 else sum - ps end as ds,
         case when not cum or count < pc or (pc is null and start_timestamp >= {window.start}) then b when pc is null or len(b) <> len(pb) then null
              else [x[1] - x[2] for x in list_zip(b, pb)] end as db
  from lagged),
bucket as (
  select inc.*, unnest(db) as n, generate_subscripts(db, 1) as pos, cast(explicit_bounds as json)::double[] as edges from inc where db is not null),
edge as (
  select *, case when pos > 1 then edges[pos - 1] end as lo, case when pos <= len(edges) then edges[pos] end as hi from bucket)
{body}"""


TYPE = f"{js(_a, 'event_type')}"
HOUR = "(timestamp // 3600000000) * 3600000000"
HALF_DAY = "(timestamp // 21600000000) * 21600000000"


def histogram_query(name: str, metric: str, agg: str, body: str, group: str = "", step: str | None = None, window: TimeWindow = EVENTS) -> None:
    @query(name, histogram_sql(metric, body, window))
    def _(s, spark):
        rows = metrics.query_metric(s["metrics"], ACME, metric, agg, window, group, step=step, metric_type="histogram")
        return rows.withColumn("value", F.round("value", 4))


def quantile_sql(q: float, keys: str = "") -> str:
    """Interpolated quantile over view edge, grouped by ``keys`` (one, with its alias)."""
    names = [keys.rsplit(" as ", 1)[1]] if keys else []
    by = ", ".join(names)
    lead = f"{by}, " if by else ""
    group = f" group by {by}" if by else ""
    over = f"partition by {by} " if by else ""
    return f"""
, merged as (select {keys + ', ' if keys else ''}lo, hi, sum(n) as n from edge group by {', '.join(str(i + 1) for i in range(len(names) + 2))}),
run as (select *, greatest(n, 0) as m, sum(greatest(n, 0)) over ({over}order by hi nulls last, lo nulls first rows unbounded preceding) as c,
               sum(greatest(n, 0)) over ({over}) as total from merged),
hit as (select *, {q} * total as rank, row_number() over ({over}order by c, hi nulls last) as k from run where total > 0 and m > 0 and c >= {q} * total),
keyed as (select distinct {by or '1 as one'} from merged)
select {('keyed.' + ', keyed.'.join(names) + ', ') if names else ''}round(case when hi is null then lo when lo is null and hi <= 0 then hi
       else coalesce(lo, 0) + (hi - coalesce(lo, 0)) * (rank - (c - m)) / m end, 4) as value
from keyed left join hit on k = 1{''.join(f' and keyed.{n} is not distinct from hit.{n}' for n in names)}"""


EVENT = f'{TYPE} as "attr.event_type"'
histogram_query("a06_histogram_min", "event.value", "min", f"select {EVENT}, round(min(min), 4) as value from pts where count > 0 and (min <> 0 or max <> 0) group by 1", "attr.event_type")
histogram_query("a06b_histogram_max", "event.value", "max", "select round(max(max), 4) as value from pts where count > 0 and (min <> 0 or max <> 0)")
histogram_query("a07_histogram_count", "event.value", "count", f"select {EVENT}, round(cast(sum(dc) as double), 4) as value from inc group by 1", "attr.event_type")
histogram_query("a07b_histogram_sum", "event.value", "sum", f"select {EVENT}, round(sum(ds), 4) as value from inc group by 1", "attr.event_type")
histogram_query("a07c_histogram_avg", "event.value", "avg", "select round(sum(ds) / sum(dc), 4) as value from inc")


@query("a05_type_dispatch", histogram_sql("event.delta", f"select {EVENT}, round(cast(sum(dc) as double), 4) as value from inc group by 1"))
def _(s, spark):
    """The latest point tells that this is a histogram; nothing is passed in."""
    rows = metrics.query_metric(s["metrics"], ACME, "event.delta", "count", EVENTS, "attr.event_type")
    return rows.withColumn("value", F.round("value", 4))


histogram_query("a08_histogram_step", "event.value", "count", f"select {HOUR} as time, round(cast(sum(dc) as double), 4) as value from inc group by 1", step="1h")
histogram_query("a08b_step_by_type", "event.value", "sum", f"select {HALF_DAY} as time, {EVENT}, round(sum(ds), 4) as value from inc group by 1, 2", "attr.event_type", "6h")
histogram_query("a08c_mid_series_window", "event.value", "count", f"select {EVENT}, round(cast(sum(dc) as double), 4) as value from inc group by 1", "attr.event_type", window=TimeWindow(EVENTS_AT, 20 * 60, 2 * 60))
histogram_query("a09_delta_sum", "event.delta", "sum", f"select {EVENT}, round(sum(ds), 4) as value from inc group by 1", "attr.event_type")
histogram_query("a10_bucket_increments", "event.value", "buckets", "select hi as le, round(sum(n), 4) as value from edge group by 1")
histogram_query("a11_buckets_by_step", "event.value", "buckets", f"select {HALF_DAY} as time, hi as le, round(sum(n), 4) as value from edge group by 1, 2", step="6h")
histogram_query("a12_buckets_by_type", "event.delta", "buckets", f"select {EVENT}, hi as le, round(sum(n), 4) as value from edge group by 1, 2", "attr.event_type")
histogram_query("a13_histogram_p50", "event.value", "p50", quantile_sql(0.5))
histogram_query("a13b_histogram_p95_by_type", "event.value", "p95", quantile_sql(0.95, EVENT), "attr.event_type")
histogram_query("a13c_histogram_p99_by_step", "event.value", "p99", quantile_sql(0.99, f"{HOUR} as time"), step="1h")
histogram_query("a14_bucket_edges", "event.delta", "p50", quantile_sql(0.5, EVENT), "attr.event_type")


@query("a16_distinct", "select service_name, count(distinct trace_id) as traces, count(distinct span_name) as names from traces group by 1")
def _(s, spark):
    return s["traces"].groupBy("service_name").agg(F.count_distinct("trace_id").alias("traces"), F.count_distinct("span_name").alias("names"))


@query("a17_conditional", "select span_kind, count(*) filter (where duration_ms >= 50) as slow, count(*) filter (where duration_ms < 50) as rest from traces group by 1")
def _(s, spark):
    return s["traces"].groupBy("span_kind").agg(F.count_if(F.col("duration_ms") >= 50).alias("slow"), F.count_if(F.col("duration_ms") < 50).alias("rest"))


@query("a18_arg_extremes", "select service_name, (min(struct_pack(a := start_time, b := trace_id, c := span_id))).c as first_span, (max(struct_pack(a := start_time, b := trace_id, c := span_id))).c as last_span from traces group by 1")
def _(s, spark):
    order = F.struct("start_time", "trace_id", "span_id")
    return s["traces"].groupBy("service_name").agg(F.min_by("span_id", order).alias("first_span"), F.max_by("span_id", order).alias("last_span"))


# ---- window functions and joins ----


@query("w01_lag", "select metric_name, attributes, timestamp, coalesce(count - lag(count) over (partition by metric_name, attributes, start_timestamp order by timestamp), 0) as gained from metrics where metric_name = 'event.value'")
def _(s, spark):
    w = Window.partitionBy("metric_name", "attributes", "start_timestamp").orderBy("timestamp")
    points = s["metrics"].where("metric_name = 'event.value'")
    return points.select("metric_name", "attributes", "timestamp", F.coalesce(F.col("count") - F.lag("count").over(w), F.lit(0)).alias("gained"))


@query("w02_segments", """, d as (select attributes, timestamp, case when count < lag(count) over (partition by attributes order by timestamp) then 1 else 0 end as drop_ from metrics where metric_name = 'event.value')
select attributes, timestamp, cast(sum(drop_) over (partition by attributes order by timestamp rows unbounded preceding) as bigint) as segment from d""")
def _(s, spark):
    w = Window.partitionBy("attributes").orderBy("timestamp")
    d = s["metrics"].where("metric_name = 'event.value'").withColumn("reset", F.coalesce((F.col("count") < F.lag("count").over(w)).cast("long"), F.lit(0)))
    return d.select("attributes", "timestamp", F.sum("reset").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"))


CAPPED = "select *, row_number() over (partition by trace_id order by start_time, span_id) as rn, count(*) over (partition by trace_id) as span_total from traces"


@query("w03_cap_per_trace", f"select trace_id, span_id, span_total, span_total > 3 as truncated from ({CAPPED}) where rn <= 3")
def _(s, spark):
    ids = s["traces"].select("trace_id").distinct()
    every = s["traces"].withColumn("resource_attributes", F.lit('{"tenant.id":"acme"}'))
    return traces.capped_spans(every, ids, ACME, 3).select("trace_id", "span_id", "span_total", (F.col("span_total") > 3).alias("truncated"))


@query("w05_values_per_key", f"select key, value, n, count(*) over (partition by key) as values from (select 'line.status' as key, {js(_a, 'line.status')} as value, count(*) as n from traces group by 1, 2 union all select 'http.route', {js(_a, 'http.route')}, count(*) from traces group by 1, 2) where value is not null")
def _(s, spark):
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), attr("attributes", k).alias("value")) for k in ("line.status", "http.route")]))
    counted = s["traces"].select(both.alias("p")).select("p.*").where("value is not null").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("values", F.count(F.lit(1)).over(Window.partitionBy("key")))


@query("w06_offsets", "select trace_id, span_id, start_time - min(start_time) over (partition by trace_id) as offset_us from traces")
def _(s, spark):
    return s["traces"].select("trace_id", "span_id", (F.col("start_time") - F.min("start_time").over(Window.partitionBy("trace_id"))).alias("offset_us"))


@query("j01_spans_with_logs", "select t.trace_id, t.span_id, t.service_name, l.timestamp, l.body from traces t join logs l on t.trace_id = l.trace_id and t.span_id = l.span_id")
def _(s, spark):
    return s["traces"].select("trace_id", "span_id", "service_name").join(s["logs"].select("trace_id", "span_id", "timestamp", "body"), ["trace_id", "span_id"])


@query("j02_left_join_condition", "select t.service_name, count(l.timestamp) as error_logs, count(*) as n from traces t left join logs l on t.trace_id = l.trace_id and l.severity_text = 'ERROR' where t.parent_span_id = '' group by 1")
def _(s, spark):
    t, logs = s["traces"].where("parent_span_id = ''").alias("t"), s["logs"].alias("l")
    joined = t.join(logs, (F.col("t.trace_id") == F.col("l.trace_id")) & (F.col("l.severity_text") == "ERROR"), "left")
    return joined.groupBy("t.service_name").agg(F.count("l.timestamp").alias("error_logs"), F.count(F.lit(1)).alias("n"))


@query("j04_trace_batch", f"select trace_id, span_id, start_time from traces where {TENANT} and trace_id in (select lpad(lower(hex(x)), 32, '0') from range(1, 400, 7) r(x))")
def _(s, spark):
    ids = spark.range(1, 400, 7).select(F.lpad(F.lower(F.hex("id")), 32, "0").alias("trace_id"))
    return traces.capped_spans(s["traces"], ids, ACME).select("trace_id", "span_id", "start_time")


@query("j07_logs_by_level", """, k as (select distinct trace_id, span_id from traces)
select case when k.span_id is not null and l.span_id <> '' then 'span' else 'trace' end as level, count(*) as n, count(distinct l.trace_id) as traces
from logs l left join k on l.trace_id = k.trace_id and l.span_id = k.span_id group by 1""")
def _(s, spark):
    return traces.attach_logs(s["logs"], s["traces"]).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trace_id").alias("traces"))


@query("j08_union_distinct", "select service_name from traces union select service_name from logs union select service_name from metrics")
def _(s, spark):
    return s["traces"].select("service_name").union(s["logs"].select("service_name")).union(s["metrics"].select("service_name")).distinct()


@query("j09_union_by_name", "select service_name, cast(start_time as bigint) as at, cast(null as varchar) as body from traces where parent_span_id = '' union all select service_name, timestamp, body from logs")
def _(s, spark):
    left = s["traces"].where("parent_span_id = ''").select("service_name", F.col("start_time").alias("at"))
    return left.unionByName(s["logs"].select("body", "service_name", F.col("timestamp").alias("at")), allowMissingColumns=True)


# ---- trace summaries, over every trace of one tenant ----

SUMMARY = f""", own as (select * from (select *, row_number() over (partition by trace_id order by start_time, span_id) as rn from traces where {TENANT}) where rn <= 5000),
rooted as (select trace_id, (min(struct_pack(a := parent_span_id <> '', b := start_time, c := span_id))).c as root_id, min(parent_span_id <> '') as root_missing from own group by 1),
clip as (select c.trace_id, p.span_id as pid, c.span_id as cid, greatest(c.start_time, p.start_time) as s, least(c.end_time, p.end_time) as e
         from own c join own p on c.trace_id = p.trace_id and c.parent_span_id = p.span_id where c.parent_span_id <> ''),
reach as (select *, max(e) over (partition by trace_id, pid order by s, e, cid rows between unbounded preceding and 1 preceding) as prev from clip where e > s),
cover as (select trace_id, pid, sum(greatest(0, e - greatest(s, coalesce(prev, s)))) as covered from reach group by 1, 2),
timed as (select o.*, r.root_id, r.root_missing, greatest(0, o.end_time - o.start_time - coalesce(covered, 0)) as self_us
          from own o join rooted r using (trace_id) left join cover on o.trace_id = cover.trace_id and o.span_id = cover.pid)
"""
_E = "status_code = 'STATUS_CODE_ERROR'"


def _own(s) -> DataFrame:
    return traces.timed_spans(s["traces"], ACME)


@query("t01_capped_spans", f"select trace_id, count(*) as kept, max(span_total) as span_total, max(span_total) > count(*) as truncated from (select * from (select *, row_number() over (partition by trace_id order by start_time, span_id) as rn, count(*) over (partition by trace_id) as span_total from traces where {TENANT}) where rn <= 4) group by 1")
def _(s, spark):
    ids = s["traces"].select("trace_id").distinct()
    kept = traces.capped_spans(s["traces"], ids, ACME, 4).groupBy("trace_id").agg(F.count(F.lit(1)).alias("kept"), F.max("span_total").alias("span_total"))
    return kept.withColumn("truncated", F.col("span_total") > F.col("kept"))


@query("t02_roots", SUMMARY + "select trace_id, root_id, root_missing from rooted")
def _(s, spark):
    return traces.roots(_own(s))


@query("t03_self_times", SUMMARY + "select trace_id, span_id, cast(self_us as bigint) as self_us from timed")
def _(s, spark):
    return _own(s).select("trace_id", "span_id", "self_us")


@query("t04_untraced", SUMMARY + "select trace_id, case when root_missing then 0 else round(self_us / 1000, 2) end as untraced_ms from timed where span_id = root_id")
def _(s, spark):
    spans = _own(s)
    rooted = spans.join(traces.roots(spans), "trace_id").where("span_id = root_id")
    return rooted.select("trace_id", F.when(F.col("root_missing"), F.lit(0.0)).otherwise(F.round(F.col("self_us") / 1000, 2)).alias("untraced_ms"))


@query("t05_trace_times", SUMMARY + f"select trace_id, min(start_time) as start_time, count(*) filter (where {_E}) as error_count, round((max(end_time) - min(start_time)) / 1000, 2) as duration_ms from own group by 1")
def _(s, spark):
    return traces.trace_times(_own(s)).drop("kept")


@query("t06_trace_services", SUMMARY + f"select trace_id, service_name, count(*) as spans, count(*) filter (where {_E}) as errors from own group by 1, 2")
def _(s, spark):
    return traces.span_services(_own(s))


GROUPS = f"""grp as (select trace_id, service_name, span_name, count(*) as count, round(sum(duration_ms), 2) as total_ms, round(sum(self_us) / 1000, 2) as self_ms,
               round(max(duration_ms), 2) as max_ms, count(*) filter (where {_E}) as errors from timed where span_id <> root_id group by 1, 2, 3)"""


@query("t07_span_groups", SUMMARY + f", {GROUPS} select *, row_number() over (partition by trace_id order by self_ms desc, total_ms desc, count desc, service_name, span_name) as place from grp")
def _(s, spark):
    spans = _own(s)
    return traces.span_groups(spans, traces.roots(spans))


@query("t08_slowest_spans", SUMMARY + "select trace_id, span_id, place from (select *, row_number() over (partition by trace_id order by duration_ms desc, start_time, span_id) as place from timed where span_id <> root_id) where place <= 3")
def _(s, spark):
    spans = _own(s)
    return traces.slowest_spans(spans, traces.roots(spans), 3).select("trace_id", "span_id", "place")


@query("t09_error_spans", SUMMARY + f"select trace_id, span_id, place from (select *, row_number() over (partition by trace_id order by start_time, span_id) as place from own where {_E}) where place <= 10")
def _(s, spark):
    return traces.error_spans(_own(s), 10).select("trace_id", "span_id", "place")


LOGS = f"logs where {TENANT} and trace_id in (select trace_id from traces)"


@query("t10_log_severities", f"select trace_id, case when severity_text = '' then 'UNSET' else upper(severity_text) end as severity, count(*) as n from {LOGS} group by 1, 2")
def _(s, spark):
    return traces.log_severities(traces.trace_logs(s["logs"], s["traces"].select("trace_id").distinct(), ACME))


@query("t10b_log_problems", f"select trace_id, place, timestamp, body from (select *, row_number() over (partition by trace_id order by timestamp, span_id, body) as place from {LOGS} and severity_number >= 13) where place <= 2")
def _(s, spark):
    own = traces.trace_logs(s["logs"], s["traces"].select("trace_id").distinct(), ACME)
    return traces.log_problems(own, 2).select("trace_id", "place", "timestamp", "body")


@query("t12_summaries", SUMMARY + f""", {GROUPS}, gt as (select trace_id, count(*) as groups_total from grp group by 1),
lg as (select trace_id, count(*) as log_count from {LOGS} group by 1),
times as (select trace_id, count(*) as span_count, count(*) filter (where {_E}) as error_count, round((max(end_time) - min(start_time)) / 1000, 2) as duration_ms from own group by 1)
select k.trace_id, coalesce(span_count, 0) as span_count, coalesce(error_count, 0) as error_count, duration_ms, r.root_id, coalesce(groups_total, 0) as groups_total,
       greatest(0, coalesce(groups_total, 0) - 3) as groups_more, coalesce(log_count, 0) as log_count
from (select distinct trace_id from traces) k left join times using (trace_id) left join rooted r using (trace_id) left join gt using (trace_id) left join lg using (trace_id)""")
def _(s, spark):
    ids = s["traces"].select("trace_id").distinct().withColumn("pos", F.lit(0))
    done = traces.trace_summaries(s["traces"], s["logs"], ids, ACME, traces.BRIEF)
    return done.select("trace_id", "span_count", "error_count", "duration_ms", F.col("root.span_id").alias("root_id"), "groups_total", "groups_more", "log_count")


# ---- exemplars and slow requests ----

_EX = """, ex as (select json_extract(e, '$.time_unix_nano')::bigint as tn, json_extract_string(e, '$.trace_id') as trace_id, json_extract_string(e, '$.span_id') as span_id, json_extract(e, '$.value')::double as value
from (select unnest(cast(exemplars as json)::json[]) as e from metrics where {t} and metric_name = 'event.value' and {w} and exemplars not in ('', '[]')))
select tn // 1000 as timestamp, value, trace_id, span_id{more} from ex where trace_id <> '' and value is not null{range}
qualify row_number() over (partition by trace_id, span_id order by tn desc, value desc) = 1 order by value desc, timestamp desc, trace_id, span_id limit {n}"""


@query("e01_exemplars", _EX.format(t=TENANT, w=EVENTS_SQL, range=" and value <= 20000", n=200, more=""))
def _(s, spark):
    return exemplars.query_exemplars(s["metrics"], ACME, "event.value", EVENTS, value=Range(None, 20000.0), limit=500)


@query("e02_slow_from_metric", _EX.format(t=TENANT, w=EVENTS_SQL, range="", n=20, more=", 'ms' as unit"))
def _(s, spark):
    return exemplars.slow_requests_from_metric(s["metrics"], ACME, "event.value", EVENTS, limit=20)


SLOW = f"select trace_id, span_id, start_time as timestamp, round(duration_ms, 2) as value, 'ms' as unit from traces where {TENANT} and {SPANS_SQL} and parent_span_id = '' order by duration_ms desc, start_time desc, trace_id, span_id limit 20"


@query("e03_slow_from_spans", SLOW)
def _(s, spark):
    return exemplars.slow_requests_from_spans(s["traces"], ACME, SPANS, limit=50)


@query("e04_slow_with_summaries", f"select trace_id, value, (select count(*) from traces t where t.trace_id = x.trace_id) as span_count from ({SLOW}) x")
def _(s, spark):
    slow = exemplars.slow_requests_from_spans(s["traces"], ACME, SPANS, limit=20)
    return exemplars.slow_requests(s["traces"], s["logs"], slow, ACME).select("trace_id", "value", "span_count")


# ---- comparison ----

SCOPE = f""", scope as (select *, duration_ms >= quantile_cont(duration_ms, 0.95) over () as slow from traces where {TENANT} and {SPANS_SQL} and span_kind = 'SPAN_KIND_CLIENT'),
sizes as (select count(*) filter (where slow) as slow_n, count(*) filter (where not slow) as rest_n from scope),
pairs as (
  select slow, 'span_name' as key, span_name as value from scope union all select slow, 'status_code', status_code from scope
  union all select slow, 'line.status', {js(_a, 'line.status')} from scope union all select slow, 'part', {js(_a, 'part')} from scope
  union all select slow, 'resource.service.name', {js(_r, 'service.name')} from scope union all select slow, 'resource.tenant.id', {js(_r, 'tenant.id')} from scope),
counted as (select key, value, count(*) filter (where slow) as a, count(*) filter (where not slow) as b, count(*) over (partition by key) as k from pairs where value is not null and value <> '' group by 1, 2),
shares as (select key, value, round(100.0e0 * a / slow_n, 1) as slow_pct, round(100.0e0 * b / rest_n, 1) as rest_pct from counted, sizes where k <= 50 and a + b >= 5)
"""


def _scope(s):
    scope = search.span_scope(s["traces"], ACME, filters=[AttrFilter("span_kind", "SPAN_KIND_CLIENT")]).where(SPANS.holds("start_time"))
    limit = scope.agg(F.percentile("duration_ms", 0.95).alias("p"))
    return scope.join(F.broadcast(limit)).withColumn("slow", F.col("duration_ms") >= F.col("p"))


@query("c04_group_sizes", SCOPE + "select slow_n, rest_n from sizes")
def _(s, spark):
    return compare.compare_spans(s["traces"], ACME, SPANS, kind="client", exact=True).sizes.select("slow_n", "rest_n")


@query("c03_threshold", f"select round(quantile_cont(duration_ms, 0.95), 6) as threshold_ms from traces where {TENANT} and {SPANS_SQL} and span_kind = 'SPAN_KIND_SERVER'")
def _(s, spark):
    return compare.compare_spans(s["traces"], ACME, SPANS, exact=True).sizes.select(F.round("threshold_ms", 6).alias("threshold_ms"))


@query("c06_features", SCOPE + "select key, value, count(*) as n, count(*) filter (where slow) as slow_n from pairs where value is not null and value <> '' group by 1, 2")
def _(s, spark):
    return compare.features(_scope(s), False).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if("slow").alias("slow_n"))


@query("c08_shares", SCOPE + "select *, round(slow_pct - rest_pct, 1) as diff from shares")
def _(s, spark):
    scope = _scope(s)
    sizes = scope.agg(F.count_if("slow").alias("slow_n"), F.count_if(~F.col("slow")).alias("rest_n"))
    return compare.pair_shares(compare.features(scope, False), sizes, False)


@query("c10_comparison", SCOPE + "select key, value, slow_pct, rest_pct, round(slow_pct - rest_pct, 1) as diff from shares order by abs(round(slow_pct - rest_pct, 1)) desc, diff desc, key, value limit 50")
def _(s, spark):
    return compare.compare_spans(s["traces"], ACME, SPANS, kind="client", exact=True, sample=False, limit=50).rows.drop("also")


SERVERS = f""", scope as (select *, duration_ms >= quantile_cont(duration_ms, 0.95) over () as slow from traces where {TENANT} and {SPANS_SQL} and span_kind = 'SPAN_KIND_SERVER'),
sizes as (select count(*) filter (where slow) as slow_n, count(*) filter (where not slow) as rest_n from scope),
pairs as (
  select slow, 'span_name' as key, span_name as value from scope union all select slow, 'status_code', status_code from scope
  union all select slow, 'http.route', {js(_a, 'http.route')} from scope union all select slow, 'cust', {js(_a, 'cust')} from scope
  union all select slow, 'resource.service.name', {js(_r, 'service.name')} from scope union all select slow, 'resource.tenant.id', {js(_r, 'tenant.id')} from scope),
counted as (select key, value, count(*) filter (where slow) as a, count(*) filter (where not slow) as b, count(*) over (partition by key) as k from pairs where value is not null and value <> '' group by 1, 2),
shares as (select key, value, round(100.0e0 * a / slow_n, 1) as slow_pct, round(100.0e0 * b / rest_n, 1) as rest_pct from counted, sizes where k <= 50 and a + b >= 5)
"""


@query("c09_twin_facts", SERVERS + """, twin as (select n.* from shares n join shares r on r.key = 'http.route' and n.key = 'span_name' and n.value = r.value and n.slow_pct = r.slow_pct and n.rest_pct = r.rest_pct)
select s.key, s.value, s.slow_pct, s.rest_pct, round(s.slow_pct - s.rest_pct, 1) as diff, case when t.value is null or s.key <> 'http.route' then '' else 'span_name=' || t.value end as also
from shares s left join twin t on s.value = t.value where s.key <> 'span_name' or t.value is null
order by abs(round(s.slow_pct - s.rest_pct, 1)) desc, diff desc, s.key, s.value limit 50""")
def _(s, spark):
    """Root spans are named by their route: one fact under two keys."""
    found = compare.compare_spans(s["traces"], ACME, SPANS, kind="server", exact=True, sample=False, limit=50).rows
    return found.withColumn("also", F.array_join("also", ";"))


@query("c05_sampled_sizes", SCOPE + "select slow_n, rest_n, true as sampled, true as bounded from sizes")
def _(s, spark):
    """Sizes are true ones although both groups are sampled, to about 40 spans each."""
    done = compare.compare_spans(s["traces"], ACME, SPANS, kind="client", exact=True, cap=40, limit=50)
    shares = done.rows.agg(F.coalesce(F.bool_and((F.col("slow_pct") <= 100) & (F.col("rest_pct") <= 100)), F.lit(True)).alias("bounded"))
    return done.sizes.select("slow_n", "rest_n", "sampled").join(F.broadcast(shares))  # one row each


# ---- derived series ----

REQUESTS = f"metrics where {TENANT} and metric_name = 'event.requests' and {EVENTS_SQL}"
CODE = f"coalesce({js(_a, 'http.response.status_code')}, {js(_a, 'http.status_code')})"


def _requests(s) -> DataFrame:
    found = metrics.metric_scope(series.status_code(s["metrics"]), ACME, "event.requests", EVENTS)
    return found.withColumn("time", F.expr("(timestamp div 3600000000) * 3600000000"))


@query("d01_server_errors", f"select {HOUR} as time, sum(value_double) as value from {REQUESTS} and try_cast({CODE} as double) >= 500 group by 1")
def _(s, spark):
    counted = _requests(s).groupBy("time", "status_code").agg(F.sum("value_double").alias("value"))
    return series.server_errors(counted, "status_code", ["time"])


@query("d02_status_column", f"select {CODE} as status_code, count(*) as n from {REQUESTS} group by 1")
def _(s, spark):
    return _requests(s).groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))


@query("d03_segments", """, p as (select distinct attributes, timestamp from metrics where metric_name = 'event.delta'),
d as (select *, timestamp - lag(timestamp) over (partition by attributes order by timestamp) as gap from p),
m as (select *, min(gap) over (partition by attributes) as step from d)
select attributes, timestamp, cast(sum(case when gap > 1.5 * step then 1 else 0 end) over (partition by attributes order by timestamp rows unbounded preceding) as bigint) as segment from m""")
def _(s, spark):
    points = s["metrics"].where("metric_name = 'event.delta'").select("attributes", "timestamp").distinct()
    return series.split_at_gaps(points, ["attributes"], "timestamp")


@query("d05_units", "select metric_name, round(sum(v * f), 3) as in_ms, round(sum(v), 3) as back from (select metric_name, case when metric_type = 'histogram' then sum else value_double end as v, case metric_unit when 'ms' then 1.0e0 when 's' then 1000.0e0 end as f from metrics) where f is not null group by 1")
def _(s, spark):
    v = F.when(F.col("metric_type") == "histogram", F.col("sum")).otherwise(F.col("value_double"))
    ms = to_ms(v, F.col("metric_unit"))
    rows = s["metrics"].select("metric_name", ms.alias("ms"), from_ms(ms, F.col("metric_unit")).alias("v")).where("ms is not null")
    return rows.groupBy("metric_name").agg(F.round(F.sum("ms"), 3).alias("in_ms"), F.round(F.sum("v"), 3).alias("back"))


@query("d06_one_grid", histogram_sql("event.value", quantile_sql(0.95, f"{HOUR} as time").replace("select keyed.time", f""", lat as (select keyed.time""", 1) + f"""),
req as (select {HOUR} as time, sum(value_double) as requests from {REQUESTS} group by 1),
err as (select {HOUR} as time, sum(value_double) as errors from {REQUESTS} and try_cast({CODE} as double) >= 500 group by 1)
select time, requests, errors, lat.value as p95 from req full join err using (time) full join lat using (time)"""))
def _(s, spark):
    total = _requests(s).groupBy("time").agg(F.sum("value_double").alias("value"))
    counted = _requests(s).groupBy("time", "status_code").agg(F.sum("value_double").alias("value"))
    p95 = metrics.query_metric(s["metrics"], ACME, "event.value", "p95", EVENTS, step="1h", metric_type="histogram")
    return series.on_one_grid(total, series.server_errors(counted, "status_code", ["time"]), p95.withColumn("value", F.round("value", 4)))


@query("d07_distribution", histogram_sql("event.delta", f""", bk as (select {EVENT}, hi as le, sum(n) as value from edge group by 1, 2),
pl as (select *, lag(le) over (partition by "attr.event_type" order by le nulls last) as lo, row_number() over (partition by "attr.event_type" order by le nulls last) as k from bk),
sh as (select *, min(case when value > 0 then k end) over (partition by "attr.event_type") as a, max(case when value > 0 then k end) over (partition by "attr.event_type") as z from pl)
select "attr.event_type", lo, le, round(value, 4) as value from sh where k between a and z"""))
def _(s, spark):
    rows = metrics.query_metric(s["metrics"], ACME, "event.delta", "buckets", EVENTS, "attr.event_type", metric_type="histogram")
    p50 = metrics.query_metric(s["metrics"], ACME, "event.delta", "p50", EVENTS, "attr.event_type", metric_type="histogram")
    plain = rows.withColumnRenamed("attr.event_type", "type")
    shown = series.distribution(plain, {"p50": p50.withColumnRenamed("attr.event_type", "type")}, ["type"])
    return shown.select(F.col("type").alias("attr.event_type"), "lo", "le", F.round("value", 4).alias("value"))


@query("d08_waterfall", f"""select trace_id, span_id, round((start_time - min(start_time) over w) / greatest(1, max(end_time) over w - min(start_time) over w) * 100, 6) as offset_pct,
round(greatest(0.3, (end_time - start_time) / greatest(1, max(end_time) over w - min(start_time) over w) * 100), 6) as width_pct,
case when parent_span_id = '' then 0 else 1 end as depth from traces where {TENANT} window w as (partition by trace_id)""")
def _(s, spark):
    done = traces.waterfall(search.span_scope(s["traces"], ACME))
    return done.select("trace_id", "span_id", F.round("offset_pct", 6).alias("offset_pct"), F.round("width_pct", 6).alias("width_pct"), "depth")


@query("d09_bar_share", "select service_name, value, value / greatest(1, max(value) over ()) as share from (select service_name, cast(count(*) as double) as value from traces group by 1)")
def _(s, spark):
    return series.bar_share(s["traces"].groupBy("service_name").agg(F.count(F.lit(1)).cast("double").alias("value")))


@query("d12_group_share", SUMMARY + f""", {GROUPS}, times as (select trace_id, round((max(end_time) - min(start_time)) / 1000, 2) as d from own group by 1)
select trace_id, service_name, span_name, round(case when d > 0 then least(100, greatest(0, self_ms / d * 100)) else 0 end, 4) as share_pct from grp join times using (trace_id)""")
def _(s, spark):
    spans = _own(s)
    done = traces.group_share(traces.span_groups(spans, traces.roots(spans)), traces.trace_times(spans))
    return done.select("trace_id", "service_name", "span_name", F.round("share_pct", 4).alias("share_pct"))


@query("d13_bucket_to_requests", _EX.format(t=TENANT, w=EVENTS_SQL, range=" and value >= 5000 and value <= 10000", n=20, more=", 'ms' as unit"))
def _(s, spark):
    """The bucket (50, 100] ms of the latency histogram, as hundredths, to requests."""
    return exemplars.slow_requests_from_metric(s["metrics"], ACME, "event.value", EVENTS, value=Range(5000.0, 10000.0), limit=20)
