"""Queries that go through a store: lookups by its day sets, batches that come again, rejected
lines, streams and their state, sketches, exact samples. Each builds its store from the derived
signals in the shared folder, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from otelframe.functions.attrs import attr
from otelframe.functions.window import TimeWindow
from otelframe.operators import compare, metrics, search, sketches, traces
from otelframe.plans.analysis import (
    _E, _a, _nanos, _pairs, _r, _requests_of, _stored, ACME, EVENT, EVENTS, EVENTS_AT, GAUGE, GROUPS, LOGS, SCOPE, SPANS, SPANS_SQL, SUMMARY, TENANT, TRACE_109, histogram_sql, js, query,
)
from otelframe.plans.suite import register, run_suite
from otelframe.sources import otlp, store
from otelframe.sources.ledger import Ledger
from otelframe.sources.shared import new_folder
from otelframe.streaming.increments import streamed_increments
from otelframe.streaming.ingest import ingest, rejected_lines

SOME_IDS = "select lpad(lower(hex(x)), 32, '0') from range(1, 400, 7) r(x)"


def some_ids() -> list[str]:
    return [f"{x:032x}" for x in range(1, 400, 7)]


# ---- lookups by trace id, and names, from the day sets ----


@query("q01b_indexed_trace", f"select span_id, parent_span_id, start_time, duration_ms, count(distinct start_time // 86400000000) over () as days_read from traces where trace_id = '{TRACE_109}' and {TENANT} order by start_time, span_id limit 1000")
def _(s, spark):
    root = _stored(s, "traces")
    found = store.of_traces(spark, root, "traces", [TRACE_109], ACME)
    days = F.lit(len(store.days.of_traces(spark, root, "traces", [TRACE_109]))).cast("long").alias("days_read")
    return search.lookup_trace(found, TRACE_109, ACME).select("span_id", "parent_span_id", "start_time", "duration_ms", days)


@query("j04b_indexed_batch", f"select 'span' as kind, trace_id, span_id, start_time as at from traces where {TENANT} and trace_id in ({SOME_IDS}) union all select 'log', trace_id, span_id, timestamp from logs where {TENANT} and trace_id in ({SOME_IDS})")
def _(s, spark):
    """Spans and logs of a batch of traces, each signal from those traces' days only."""
    root, ids = _stored(s, "traces", "logs"), some_ids()
    asked = traces.trace_ids(spark, ids)
    spans = traces.capped_spans(store.of_traces(spark, root, "traces", ids, ACME), asked, ACME).select(F.lit("span").alias("kind"), "trace_id", "span_id", F.col("start_time").alias("at"))
    logs = traces.trace_logs(store.of_traces(spark, root, "logs", ids, ACME), asked, ACME)
    return spans.unionByName(logs.select(F.lit("log").alias("kind"), "trace_id", "span_id", F.col("timestamp").alias("at")))


@query("t12c_indexed_summaries", SUMMARY + f""",
times as (select trace_id, count(*) as span_count, count(*) filter (where {_E}) as error_count, round((max(end_time) - min(start_time)) / 1000, 2) as duration_ms from own group by 1)
select k.trace_id, coalesce(span_count, 0) as span_count, coalesce(error_count, 0) as error_count, duration_ms, coalesce(log_count, 0) as log_count
from ({SOME_IDS}) k(trace_id) left join times using (trace_id) left join (select trace_id, count(*) as log_count from logs where {TENANT} group by 1) l using (trace_id)""")
def _(s, spark):
    root, ids = _stored(s, "traces", "logs"), some_ids()
    both = [store.of_traces(spark, root, n, ids, ACME) for n in ("traces", "logs")]
    return traces.trace_summaries(*both, traces.trace_ids(spark, ids), ACME, traces.BRIEF).select("trace_id", "span_count", "error_count", "duration_ms", "log_count")


@query("q07b_names_after_upkeep", f"""select distinct 'logs' as signal, {js(_r, 'tenant.id')} as tenant, service_name as name from logs where timestamp >= {EVENTS_AT - 5 * store.DAY}
union all select distinct 'services', {js(_r, 'tenant.id')}, service_name from metrics where timestamp >= {EVENTS_AT - 5 * store.DAY}
union all select distinct 'metrics', {js(_r, 'tenant.id')}, metric_name from metrics where timestamp >= {EVENTS_AT - 5 * store.DAY}""")
def _(s, spark):
    """Tenants, services and metric names from the day sets, after appends, compaction and retention."""
    root = _stored(s, "logs", "metrics")
    store.append(s["logs"].where(f"timestamp < {EVENTS_AT - 4 * store.DAY}"), root, "logs")
    store.compact(spark, root, "logs", store.partitions(spark, root, "logs"))
    store.retain(spark, root, "5d", EVENTS_AT)
    of = lambda signal, kind, column: store.names(spark, root, signal).select(F.lit(kind).alias("signal"), "tenant", F.col(column).alias("name")).distinct()
    return of("logs", "logs", "service_name").unionByName(of("metrics", "services", "service_name")).unionByName(of("metrics", "metrics", "metric_name"))


@query("t12b_summary_lists", SUMMARY + f""", {GROUPS},
sv as (select trace_id, service_name, count(*) as n from own group by 1, 2),
er as (select trace_id, span_id, row_number() over (partition by trace_id order by start_time, span_id) as place from own where {_E}),
sl as (select trace_id, span_id, row_number() over (partition by trace_id order by duration_ms desc, start_time, span_id) as place from timed where span_id <> root_id),
gr as (select *, row_number() over (partition by trace_id order by self_ms desc, total_ms desc, count desc, service_name, span_name) as place from grp),
lg as (select * from {LOGS}),
pr as (select trace_id, body, row_number() over (partition by trace_id order by timestamp, span_id, body) as place from lg where severity_number >= 13),
se as (select trace_id, case when severity_text = '' then 'UNSET' else upper(severity_text) end as severity, count(*) as n from lg group by 1, 2)
select trace_id, 'service' as list, cast(row_number() over (partition by trace_id order by n desc, service_name) as bigint) as place, service_name as item, n from sv
union all select trace_id, 'group', place, service_name || '/' || span_name, count from gr where place <= 3
union all select trace_id, 'slowest', place, span_id, 0 from sl where place <= 3
union all select trace_id, 'error', place, span_id, 0 from er where place <= 1
union all select trace_id, 'problem', place, body, 0 from pr where place <= 1
union all select trace_id, 'severity', 0, severity, n from se""")
def _(s, spark):
    """All lists of all summaries, an item a row."""
    ids = s["traces"].select("trace_id").distinct().withColumn("pos", F.lit(0))
    done = traces.trace_summaries(s["traces"], s["logs"], ids, ACME, traces.BRIEF)
    item, none = F.struct(F.lit(0).cast("long").alias("place"), F.lit("").alias("item"), F.lit(0).cast("long").alias("n")), F.lit(0).cast("long")

    def listed(name: str, text, n=lambda x: none):
        rows = F.transform(name, lambda x, i: F.struct((i + 1).cast("long").alias("place"), text(x).alias("item"), n(x).cast("long").alias("n")))
        return F.coalesce(rows, F.array().cast(f"array<{'struct<place: bigint, item: string, n: bigint>'}>"))

    levels = F.transform(F.map_entries("by_severity"), lambda e: F.struct(none.alias("place"), e["key"].alias("item"), e["value"].alias("n")))
    lists = {
        "service": listed("services", lambda x: x["service_name"], lambda x: x["spans"]), "group": listed("groups", lambda x: F.concat(x["service_name"], F.lit("/"), x["span_name"]), lambda x: x["count"]),
        "slowest": listed("slowest", lambda x: x["span_id"]), "error": listed("errors", lambda x: x["span_id"]), "problem": listed("problems", lambda x: x["body"]),
        "severity": F.coalesce(levels, F.filter(F.array(item), lambda x: F.lit(False))),
    }
    named = F.array(*[F.struct(F.lit(k).alias("list"), v.alias("items")) for k, v in lists.items()])
    rows = done.select("trace_id", F.explode(named).alias("l")).select("trace_id", "l.list", F.explode("l.items").alias("i"))
    return rows.select("trace_id", "list", "i.place", "i.item", "i.n")


# ---- export requests ----


def _log_lines(rows: DataFrame) -> DataFrame:
    record = F.struct(
        _nanos("timestamp").alias("timeUnixNano"), F.col("trace_id").alias("traceId"), F.col("severity_number").alias("severityNumber"), F.col("severity_text").alias("severityText"),
        F.struct(F.col("body").alias("stringValue")).alias("body"), _pairs("attributes").alias("attributes"),
    )
    return _requests_of(rows, "resourceLogs", "scopeLogs", "logRecords", record)


def _point_lines(rows: DataFrame, field: str, *more) -> DataFrame:
    point = F.struct(_nanos("timestamp").alias("timeUnixNano"), _nanos("start_timestamp").alias("startTimeUnixNano"), _pairs("attributes").alias("attributes"), F.col("count").cast("string").alias("count"), "sum", *more)
    record = F.struct(F.col("metric_name").alias("name"), F.struct(F.array(point).alias("dataPoints"), F.lit("1").alias("aggregationTemporality")).alias(field))
    return _requests_of(rows, "resourceMetrics", "scopeMetrics", "metrics", record)


_B = "cast(bucket_counts as json)::bigint[]"


@query("s03c_exponential_points", f"select timestamp, {js(_a, 'event_type')} as event_type, 'exponential_histogram' as metric_type, count, round(sum, 6) as sum, round(max, 6) as max, 2 as scale, ({_B})[1] as zeros, 3 as first, ({_B})[3] as second, 'AGGREGATION_TEMPORALITY_DELTA' as temporality from metrics where metric_name = 'event.delta'")
def _(s, spark):
    b = F.from_json("bucket_counts", "array<string>")
    side = F.struct(F.lit(3).alias("offset"), F.slice(b, 2, 3).alias("bucketCounts"))
    lines = _point_lines(s["metrics"].where("metric_name = 'event.delta'"), "exponentialHistogram", "min", "max", F.lit(2).alias("scale"), b[0].alias("zeroCount"), side.alias("positive"))
    part = lambda path: F.get_json_object("bucket_counts", path)
    return otlp.flatten_metrics(lines).select(
        "timestamp", attr("attributes", "event_type").alias("event_type"), "metric_type", "count", F.round("sum", 6).alias("sum"), F.round("max", 6).alias("max"), part("$.scale").cast("int").alias("scale"),
        part("$.zero_count").cast("long").alias("zeros"), part("$.positive.offset").cast("int").alias("first"), part("$.positive.bucket_counts[1]").cast("long").alias("second"), F.col("aggregation_temporality").alias("temporality"),
    )


@query("s03d_summary_points", f"select timestamp, {js(_a, 'event_type')} as event_type, 'summary' as metric_type, count, round(sum, 6) as sum, round(min, 6) as low, round(max, 6) as high, 2 as quantiles from metrics where metric_name = 'event.delta'")
def _(s, spark):
    values = F.array(F.struct(F.lit(0.0).alias("quantile"), F.col("min").alias("value")), F.struct(F.lit(1.0).alias("quantile"), F.col("max").alias("value")))
    rows = otlp.flatten_metrics(_point_lines(s["metrics"].where("metric_name = 'event.delta'"), "summary", values.alias("quantileValues")))
    part = lambda path: F.round(F.get_json_object("quantile_values", path).cast("double"), 6)
    return rows.select(
        "timestamp", attr("attributes", "event_type").alias("event_type"), "metric_type", "count", F.round("sum", 6).alias("sum"), part("$[0].value").alias("low"), part("$[1].value").alias("high"),
        F.json_array_length("quantile_values").alias("quantiles"),
    )


@query("s06_events_and_links", f"""select r.trace_id, count(c.span_id) as n_events, (min(struct_pack(a := c.start_time, b := c.span_id, c := c.span_name))).c as first_event,
json_extract_string((min(struct_pack(a := c.start_time, b := c.span_id, c := c.attributes))).c, '$.part') as first_part, 1 as n_links, r.trace_id as link
from traces r left join traces c on c.trace_id = r.trace_id and c.parent_span_id = r.span_id where r.parent_span_id = '' group by r.trace_id""")
def _(s, spark):
    """Root spans whose children are sent as events, each with a link to its own trace."""
    t = s["traces"]
    kids = t.where("parent_span_id <> ''").groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.array_sort(F.collect_list(F.struct("start_time", F.col("span_id").alias("kid"), "span_name", "attributes"))).alias("kids"))
    rooted = t.where("parent_span_id = ''").join(kids, ["trace_id", "span_id"], "left")
    events = F.transform("kids", lambda k: F.struct(k["span_name"].alias("name"), F.concat(k["start_time"].cast("string"), F.lit("000")).alias("timeUnixNano"), _pairs(k["attributes"]).alias("attributes")))
    record = F.struct(F.col("trace_id").alias("traceId"), F.col("span_name").alias("name"), events.alias("events"), F.array(F.struct(F.col("trace_id").alias("traceId"))).alias("links"))
    rows = otlp.flatten_traces(_requests_of(rooted, "resourceSpans", "scopeSpans", "spans", record))
    return rows.select(
        "trace_id", F.json_array_length("events").cast("long").alias("n_events"), F.get_json_object("events", "$[0].name").alias("first_event"),
        F.get_json_object("events", "$[0].attributes.part").alias("first_part"), F.json_array_length("links").alias("n_links"), F.get_json_object("links", "$[0].trace_id").alias("link"),
    )


# ---- streams ----

@query("x01_streamed_lines", """select 'row' as kind, service_name as name, count(*) as n from logs where timestamp % 7 > 2 group by 2
union all select 'rejected', case timestamp % 7 when 0 then 'not JSON' when 1 then 'no resourceLogs' else 'not an object' end, count(*) from logs where timestamp % 7 <= 2 group by 2""")
def _(s, spark):
    """Lines through the stream: rows of good ones, causes of the others, each line once.
    Of seven lines one is cut off, one is of another signal, and one is no object."""
    folder = new_folder(spark)
    kind = F.pmod("timestamp", F.lit(7)).cast("string")
    lines = _log_lines(s["logs"].withColumn("resource_attributes", F.concat(F.lit('{"_":"'), kind, F.lit('",'), F.substring("resource_attributes", 2, 1 << 20))))
    nth = F.regexp_extract("value", r'"key":"_","value":\{"stringValue":"(\d)"', 1)
    broken = F.when(nth == "0", F.expr("left(value, length(value) - 3)")).when(nth == "1", F.lit('{"resourceSpans":[]}')).when(nth == "2", F.lit('["resourceLogs"]')).otherwise(F.col("value"))
    lines.select(broken.alias("value")).write.text(f"{folder}/in")
    ingest(spark, f"{folder}/in", f"{folder}/out", "logs", f"{folder}/checkpoint", every=None).awaitTermination()
    good = store.scan(spark, f"{folder}/out", "logs").groupBy(F.lit("row").alias("kind"), F.col("service_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    bad = rejected_lines(spark, f"{folder}/out").groupBy(F.lit("rejected").alias("kind"), F.col("cause").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return good.unionByName(bad)


@query("s10b_streamed_tenants", f"""select 'row' as kind, case when service_name = 'svc-1' then 'globex' else {js(_r, 'tenant.id')} end as tenant, count(*) as n from logs where service_name in ('svc-0', 'svc-1') or (service_name = 'svc-2' and {TENANT}) group by 2
union all select 'rejected', service_name, count(*) from logs where service_name not in ('svc-0', 'svc-1') and not (service_name = 'svc-2' and {TENANT}) group by 2""")
def _(s, spark):
    """svc-0 sends for all tenants, svc-1 for one, svc-2 for some; other senders have no key."""
    folder = new_folder(spark)
    _log_lines(s["logs"]).write.text(f"{folder}/in")
    rows = [("svc-0", []), ("svc-1", ["globex"]), ("svc-2", [ACME, "nobody"])]
    ingest(
        spark, f"{folder}/in", f"{folder}/out", "logs", f"{folder}/checkpoint", every=None, sender=F.regexp_extract("value", r"(svc-\d+)", 1),
        keys=lambda session: session.createDataFrame(rows, "sender_key string, tenants array<string>"),
    ).awaitTermination()
    good = store.scan(spark, f"{folder}/out", "logs", keep_tenant=True).groupBy(F.lit("row").alias("kind"), "tenant").agg(F.count(F.lit(1)).alias("n"))
    bad = rejected_lines(spark, f"{folder}/out").where("cause = 'tenant'").groupBy(F.lit("rejected").alias("kind"), F.col("sender_key").alias("tenant")).agg(F.count(F.lit(1)).alias("n"))
    return good.unionByName(bad)


@query("x02_late_lines", "select cast(timestamp // 86400000000 as bigint) as day, count(*) as n, 2 as runs from logs group by 1")
def _(s, spark):
    """The newer half is streamed first; late rows are taken and seen by the next scan."""
    folder, half = new_folder(spark), EVENTS_AT - 5 * store.DAY
    for n, part in enumerate((F.col("timestamp") >= half, F.col("timestamp") < half)):
        _log_lines(s["logs"].where(part)).write.mode("append").text(f"{folder}/in")
        ingest(spark, f"{folder}/in", f"{folder}/out", "logs", f"{folder}/checkpoint", every=None).awaitTermination()
    return store.scan(spark, f"{folder}/out", "logs").groupBy(F.expr("timestamp div 86400000000").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.lit(n + 1).alias("runs"))


@query("x03_replayed_batches", "select service_name, count(*) as n, count(distinct body) as bodies from logs group by 1")
def _(s, spark):
    """Batches that come again, before and after a compaction, and two that broke off: one
    before its record was written, one after. Every row is there once."""
    root = new_folder(spark)
    part = lambda k: s["logs"].where(F.pmod("timestamp", F.lit(4)) == k)
    put = lambda k: store.append_batch(part(k), root, "logs", f"feed-{k}")
    for k in (0, 1, 1):
        put(k)
    store.compact(spark, root, "logs", store.partitions(spark, root, "logs"))
    put(1)
    ledger = Ledger(spark, root, "logs")
    ledger.record(store._staged(part(2), ledger, root, "logs", "batch-feed-2")._replace(batch="feed", number=2))
    store._staged(part(3).limit(10), ledger, root, "logs", "batch-feed-3")
    put(2)
    put(3)
    return store.scan(spark, root, "logs").groupBy("service_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("body").alias("bodies"))


@query("a07d_streamed_increments", histogram_sql("event.value", f"select {EVENT}, round(cast(sum(dc) as double), 4) as n, round(sum(ds), 4) as total, round(sum(list_sum(db)), 4) as in_buckets from inc group by 1"))
def _(s, spark):
    """Points in three batches, out of order, then one far ahead that lets the others pass."""
    folder = new_folder(spark)
    points = metrics.metric_scope(s["metrics"], ACME, "event.value", EVENTS).drop("value_int", "flags")
    for k in range(3):
        points.where(F.pmod(F.xxhash64("timestamp"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{folder}/points")
    ahead = points.limit(1).withColumn("timestamp", F.lit(EVENTS_AT + 400 * store.DAY)).withColumn("metric_name", F.lit("tick"))
    ahead.coalesce(1).write.mode("append").parquet(f"{folder}/points")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/points")
    done = streamed_increments(stream, EVENTS.start, late="60 days")
    keep = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/made/batch={batch}")
    done.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    made = spark.read.schema(done.schema).parquet(f"{folder}/made").where("metric_name <> 'tick'")
    full = F.aggregate("db", F.lit(0.0), lambda a, x: a + x)
    return made.groupBy(attr("attributes", "event_type").alias("attr.event_type")).agg(F.round(F.sum("dc"), 4).alias("n"), F.round(F.sum("ds"), 4).alias("total"), F.round(F.sum(full), 4).alias("in_buckets"))


# ---- sketches and samples ----


def _rank_holds(rows: DataFrame, value: str, by: list[str], estimates: DataFrame, q: float, error: float) -> DataFrame:
    """by, n, within: whether the estimate's true rank is within ``error`` of ``q``."""
    joined = rows.join(F.broadcast(estimates), by) if by else rows.crossJoin(F.broadcast(estimates))  # a row for each group
    below, upto = F.count_if(F.col(value) < F.col("estimate")), F.count_if(F.col(value) <= F.col("estimate"))
    n = F.count(F.lit(1))
    return joined.groupBy(*by).agg(n.alias("n"), ((below <= n * (q + error)) & (upto >= n * (q - error))).alias("within"))


@query("a02d_sketched_p95", f"select {js(_r, 'host.name')} as host, count(*) as n, true as within from {GAUGE} group by 1")
def _(s, spark):
    """Hourly sketches of a gauge, merged over the window by host: ranks within 0.02."""
    points = metrics.metric_scope(s["metrics"], ACME, "event.gauge", EVENTS).withColumn("host", attr("resource_attributes", "host.name"))
    hourly = sketches.hourly_sketches(points, "value_double", "timestamp", ["host", "service_name"])
    p95 = sketches.merged(hourly, ["host"], EVENTS).select("host", sketches.quantile(0.95).alias("estimate"))
    return _rank_holds(points, "value_double", ["host"], p95, 0.95, 0.02)


@query("c03b_sketched_threshold", f"select span_kind, count(*) as n, true as within from traces where {TENANT} and {SPANS_SQL} group by 1")
def _(s, spark):
    spans = search.span_scope(s["traces"], ACME).where(SPANS.holds("start_time"))
    hourly = sketches.hourly_sketches(spans, "duration_ms", "start_time", ["span_kind"])
    p95 = sketches.merged(hourly, ["span_kind"], SPANS).select("span_kind", sketches.quantile(0.95).alias("estimate"))
    return _rank_holds(spans, "duration_ms", ["span_kind"], p95, 0.95, 0.02)


@query("c05b_drawn_spans", SCOPE + "select trace_id, span_id, slow from scope qualify row_number() over (partition by slow order by md5(concat(trace_id, '|', span_id, '|7')), trace_id, span_id) <= 40")
def _(s, spark):
    return compare.compare_spans(s["traces"], ACME, SPANS, kind="client", exact=True, cap=40).drawn.select("trace_id", "span_id", "slow")


# ---- what other rows leave out ----


@query("p12b_browse_shorthand", "select trace_id, span_id, service_name from traces where status_code = 'STATUS_CODE_ERROR' order by start_time desc, trace_id, span_id limit 50")
def _(s, spark):
    return search.browse(s["traces"], "start_time", {"status": "error"}, 50).select("trace_id", "span_id", "service_name")


@query("d08b_deep_waterfall", f"""select trace_id, span_id, cast(case when parent_span_id = '' then 0 else row_number() over (partition by trace_id, parent_span_id = '' order by span_id) end as int) as depth from (select distinct trace_id, span_id, parent_span_id from traces where {TENANT})""")
def _(s, spark):
    """The line items of an order as a chain, each the parent of the next."""
    own = search.span_scope(s["traces"], ACME).dropDuplicates(["trace_id", "span_id"])
    before = F.lag("span_id").over(Window.partitionBy("trace_id", F.col("parent_span_id") == "").orderBy("span_id"))
    chained = own.withColumn("parent_span_id", F.coalesce(F.when(F.col("parent_span_id") != "", before), "parent_span_id"))
    return traces.waterfall(chained).select("trace_id", "span_id", F.col("depth").cast("int").alias("depth"))


@query("s18_fragmented_days", "select cast(timestamp // 86400000000 as bigint) as day, count(*) as n from logs group by 1 having count(distinct timestamp % 2) = 2")
def _(s, spark):
    root = new_folder(spark)
    for k in (0, 1):
        store.append(s["logs"].where(F.pmod("timestamp", F.lit(2)) == k), root, "logs")
    found = store.fragmented(spark, root, "logs", 1 << 40)
    return found.select(F.expr("unix_date(date)").cast("long").alias("day"), F.col("rows").alias("n"))


@query("s18b_layout", "select cast(timestamp // 86400000000 as bigint) as day, count(*) as n, min(timestamp) as oldest, max(timestamp) as newest, true as counted from logs group by 1")
def _(s, spark):
    """Rows and range of times of each day, from the footers of two appends."""
    root = new_folder(spark)
    for k in (0, 1):
        store.append(s["logs"].where(F.pmod("timestamp", F.lit(2)) == k), root, "logs")
    found = store.layout(spark, root, "logs")
    return found.select(F.expr("unix_date(date)").cast("long").alias("day"), F.col("rows").alias("n"), "oldest", "newest", F.expr("row_groups >= files and bytes > 0").alias("counted"))


QUARTER = TimeWindow(EVENTS_AT, 18 * 60, 12 * 60)


@query("s14b_quarter_of_a_day", f"select service_name, count(*) as n, min(timestamp) as oldest, max(timestamp) as newest from logs where {TENANT} and timestamp >= {QUARTER.start} and timestamp < {QUARTER.end} group by service_name")
def _(s, spark):
    """Six hours of a table to which each quarter of the days was appended by itself."""
    root = new_folder(spark)
    for k in range(4):
        store.append(s["logs"].where((F.col("timestamp") % store.DAY) / F.lit(store.DAY // 4) >= k).where((F.col("timestamp") % store.DAY) / F.lit(store.DAY // 4) < k + 1), root, "logs")
    found = store.within(spark, root, "logs", QUARTER, ACME)
    return found.groupBy("service_name").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


@query("a15_refused_aggregations", histogram_sql("event.delta", """select kind, agg, kind = 'summary' or agg in ('p50', 'buckets', 'median') as refused, (select count(*) from pts) as points
from (values ('exponential_histogram'), ('summary')) k(kind), (values ('count'), ('avg'), ('p50'), ('buckets'), ('median')) a(agg)"""))
def _(s, spark):
    """Which aggregations of which kinds of points are input errors."""
    done = []
    for kind in ("exponential_histogram", "summary"):
        for agg in ("count", "avg", "p50", "buckets", "median"):
            try:
                metrics.query_metric(s["metrics"], ACME, "event.delta", agg, EVENTS, metric_type=kind)
                done.append((kind, agg, False))
            except ValueError:
                done.append((kind, agg, True))
    points = metrics.metric_scope(s["metrics"], ACME, "event.delta", EVENTS).agg(F.count(F.lit(1)).alias("points"))
    return spark.createDataFrame(done, "kind string, agg string, refused boolean").crossJoin(F.broadcast(points))  # one row


@query("v01_suite", "select 'a_by_kind' as name, count(distinct span_kind) as n, 2 as columns, true as done from traces union all select 'b_wrong', 0, 0, false union all select 'c_bodies', count(distinct body), 1, true from logs")
def _(s, spark):
    register(spark, s)
    saved = [("a_by_kind", "select span_kind, count(*) as n from traces group by 1"), ("b_wrong", "select nothing from traces"), ("c_bodies", "select distinct body from logs")]
    done = run_suite(spark, spark.createDataFrame(saved, "name string, sql string"), new_folder(spark))
    return done.select("name", F.coalesce("rows", F.lit(0)).alias("n"), F.size("columns").alias("columns"), F.col("error").isNull().alias("done"))
