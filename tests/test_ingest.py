"""OTLP/JSON flattening, tenants, the store, streaming and saved queries."""

import json

import pytest
from pyspark.sql import functions as F

from otelframe.functions.units import from_ms, to_ms
from otelframe.functions.window import duration
from otelframe.operators import series
from otelframe.plans import cookbook
from otelframe.plans.suite import register, run_suite
from otelframe.schemas import LOG_SCHEMA, METRIC_SCHEMA, SPAN_SCHEMA
from otelframe.sources import fixtures, otlp, store
from otelframe.streaming.ingest import ingest, live_rollup

T0 = 1_700_000_000_000_000
kv = lambda k, **v: {"key": k, "value": v}
RESOURCE = {"attributes": [kv("service.name", stringValue="shop"), kv("tenant.id", stringValue="acme")]}
SPAN = {
    "traceId": "AQIDBAUGBwgJCgsMDQ4PEA==", "spanId": "01020304050607AB", "name": "test-span", "kind": 2, "startTimeUnixNano": "1700000000000000999", "endTimeUnixNano": "1700000000100000999",
    "status": {"code": "STATUS_CODE_ERROR", "message": "no"},
    "attributes": [kv("z", intValue="5"), kv("q", stringValue='GE"T'), kv("list", arrayValue={"values": [{"stringValue": "a"}, {"doubleValue": 1.5}]}), kv("map", kvlistValue={"values": [kv("b", boolValue=True)]}), kv("z", intValue="6")],
    "events": [{"name": "e", "timeUnixNano": "5", "attributes": [kv("k", bytesValue="AQI=")]}], "links": [{"traceId": "0A", "spanId": "0b"}],
}
TRACES = {"resourceSpans": [{"resource": RESOURCE, "scopeSpans": [{"scope": {"name": "lib", "version": "1"}, "spans": [SPAN, {"traceId": "0a", "spanId": "0b", "startTimeUnixNano": "2000000", "endTimeUnixNano": "1000000"}]}]}]}
POINT = {"timeUnixNano": "1700000000000000000", "startTimeUnixNano": "1600000000000000000", "attributes": [kv("a", stringValue="b")]}


def requests(spark, *messages):
    return spark.createDataFrame([(json.dumps(m),) for m in messages], "value string")


def test_spans(spark):
    a, b = otlp.flatten_traces(requests(spark, TRACES)).orderBy(F.desc("start_time")).collect()
    assert (a.trace_id, a.span_id, a.span_kind, a.status_code) == ("0102030405060708090a0b0c0d0e0f10", "01020304050607ab", "SPAN_KIND_SERVER", "STATUS_CODE_ERROR")
    assert (a.start_time, a.end_time, a.duration_ms, a.service_name, a.scope_name) == (T0, T0 + 100_000, 100.0, "shop", "lib")
    assert a.attributes == '{"list":["a",1.5],"map":{"b":true},"q":"GE\\"T","z":6}'
    assert json.loads(a.events) == [{"name": "e", "time_unix_nano": 5, "dropped_attributes_count": 0, "attributes": {"k": "0102"}}]
    assert json.loads(a.links)[0]["trace_id"] == "0a"
    assert (b.duration_ms, b.status_code, b.attributes, b.events, b.parent_span_id) == (-1.0, "STATUS_CODE_UNSET", "{}", "[]", "")
    assert otlp.flatten_traces(requests(spark, TRACES)).schema.names == SPAN_SCHEMA.names


def test_logs(spark):
    message = {"resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": [{"logRecords": [{"timeUnixNano": "1700000000000000000", "severityNumber": 17, "severityText": "ERROR", "body": {"stringValue": "boom"}}, {"body": {"kvlistValue": {"values": [kv("a", intValue="1")]}}}, {"body": {"bytesValue": "AQI="}}, {}]}]}]}
    rows = otlp.flatten_logs(requests(spark, message)).collect()
    assert [r.body for r in rows] == ["boom", '{"a":1}', "0102", ""]
    assert (rows[0].timestamp, rows[0].severity_number, rows[0].service_name) == (T0, 17, "unknown")


def test_metric_points(spark):
    metrics = [
        {"name": "g", "unit": "ms", "gauge": {"dataPoints": [{**POINT, "asInt": "7"}, {**POINT, "asDouble": 2.5}]}},
        {"name": "s", "sum": {"dataPoints": [{**POINT, "asDouble": 1.5}], "aggregationTemporality": 2, "isMonotonic": True}},
        {"name": "h", "histogram": {"aggregationTemporality": "AGGREGATION_TEMPORALITY_DELTA", "dataPoints": [{**POINT, "count": "3", "sum": 4.5, "min": 1.0, "max": 2.0, "bucketCounts": ["1", "2"], "explicitBounds": [10.0], "exemplars": [{"timeUnixNano": "9", "traceId": "0a", "spanId": "0b", "asDouble": 2.25}]}]}},
        {"name": "x", "exponentialHistogram": {"aggregationTemporality": 1, "dataPoints": [{**POINT, "count": "3", "scale": 2, "zeroCount": "1", "positive": {"offset": 1, "bucketCounts": ["1", "1"]}}]}},
        {"name": "q", "summary": {"dataPoints": [{**POINT, "count": "2", "sum": 3.0, "quantileValues": [{"quantile": 0.5, "value": 1.5}]}]}},
    ]
    df = otlp.flatten_metrics(requests(spark, {"resourceMetrics": [{"resource": RESOURCE, "scopeMetrics": [{"metrics": metrics}]}]}))
    rows = {(r.metric_name, r.value_double): r for r in df.collect()}
    assert df.schema.names == METRIC_SCHEMA.names and len(rows) == 6
    assert rows["g", 7.0].value_int == 7 and rows["g", 2.5].value_int == 0
    assert rows["s", 1.5].is_monotonic and rows["s", 1.5].aggregation_temporality == "AGGREGATION_TEMPORALITY_CUMULATIVE"
    h = rows["h", 0.0]
    assert (h.count if not callable(h.count) else h["count"], h.bucket_counts, json.loads(h.explicit_bounds), h["min"], h["max"]) == (3, "[1,2]", [10.0], 1.0, 2.0)
    assert json.loads(h.exemplars) == [{"time_unix_nano": 9, "trace_id": "0a", "span_id": "0b", "value": 2.25}]
    assert json.loads(rows["x", 0.0].bucket_counts) == {"scale": 2, "zero_count": 1, "positive": {"offset": 1, "bucket_counts": [1, 1]}}
    assert json.loads(rows["q", 0.0].quantile_values) == [{"quantile": 0.5, "value": 1.5}]


def test_tenants(spark):
    rows = otlp.flatten_traces(requests(spark, TRACES)).limit(1)
    sent = rows.crossJoin(spark.createDataFrame([(k,) for k in ("one", "all", "some", "wrong", "none")], "sender_key string"))
    keys = spark.createDataFrame([("one", ["globex"]), ("all", []), ("some", ["acme", "x"]), ("wrong", ["x", "y"])], "sender_key string, tenants array<string>")
    accepted, rejected = otlp.stamp_tenants(sent, keys)
    got = {r.sender_key: json.loads(r.resource_attributes)["tenant.id"] for r in accepted.collect()}
    assert got == {"one": "globex", "all": "acme", "some": "acme"}
    assert {r.sender_key for r in rejected.collect()} == {"wrong", "none"}


def test_store_life_cycle(spark, tmp_path):
    root = str(tmp_path)
    assert store.scan(spark, root, "logs").count() == 0 and store.scan(spark, root, "logs").schema.names == LOG_SCHEMA.names
    rows = otlp.flatten_traces(requests(spark, TRACES)).where("start_time > 100000").cache()
    for _ in range(3):
        store.append(rows, root, "traces")
    late = rows.withColumn("start_time", F.col("start_time") - 5 * store.DAY)
    store.append(late, root, "traces")
    assert store.scan(spark, root, "traces").count() == 4
    assert store.scan(spark, root, "traces", T0).count() == 3
    assert [(r.files, r.rows) for r in store.fragmented(spark, root, "traces").collect()] == [(3, 3)]
    before = sorted(map(str, store.scan(spark, root, "traces").collect()))
    store.compact_closed(spark, root, "traces", T0 + store.DAY)  # yesterday is not closed yet
    assert store.fragmented(spark, root, "traces").count() == 1
    store.compact_recent(spark, root, "traces", T0 + store.DAY)
    assert store.fragmented(spark, root, "traces").count() == 0
    assert sorted(map(str, store.scan(spark, root, "traces").collect())) == before
    (tmp_path / "traces" / "notes").mkdir()
    assert store.retain(spark, root, "30d", T0 + 20 * store.DAY)["traces"] == []
    assert store.retain(spark, root, "4d", T0 + store.DAY)["traces"] == ["date=2023-11-09"]
    assert store.scan(spark, root, "traces").count() == 3 and (tmp_path / "traces" / "notes").exists()
    for bad in ("", "0d", "5 parsecs"):
        with pytest.raises(ValueError):
            duration(bad)


def test_streaming_ingest_takes_each_line_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(TRACES) + "\n")
    start = lambda: ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), "traces", str(tmp_path / "cp"), every=None).awaitTermination()
    start()
    assert store.scan(spark, str(tmp_path / "out"), "traces").count() == 2
    (tmp_path / "in" / "b.json").write_text(json.dumps(TRACES) + "\n")
    start()
    start()
    assert store.scan(spark, str(tmp_path / "out"), "traces").count() == 4


def test_streams_batches_and_maintenance_share_a_table(spark, tmp_path):
    root, source = str(tmp_path / "out"), tmp_path / "in"
    source.mkdir()
    count = lambda: store.scan(spark, root, "traces").count()
    rows = otlp.flatten_traces(requests(spark, TRACES)).where("start_time > 100000").cache()
    take = lambda: ingest(spark, str(source), root, "traces", str(tmp_path / "cp"), every=None).awaitTermination()
    (source / "a.json").write_text(json.dumps(TRACES) + "\n")
    take()
    assert count() == 2
    store.append(rows.unionAll(rows), root, "traces")
    store.append(rows.withColumn("start_time", F.col("start_time") - 9 * store.DAY), root, "traces")
    assert count() == 5
    store.compact(spark, root, "traces", store.partitions(spark, root, "traces"))
    assert count() == 5 and store.partitions(spark, root, "traces").where("files > 1").count() == 0
    (source / "b.json").write_text(json.dumps(TRACES) + "\n")
    take()
    store.append(rows, root, "traces")
    assert count() == 8
    assert store.retain(spark, root, "5d", T0 + store.DAY)["traces"] == ["date=1970-01-01", "date=2023-11-05"]
    assert count() == 5
    store.compact_recent(spark, root, "traces", T0 + store.DAY)
    assert count() == 5 and store.scan(spark, root, "traces", tenant="acme").count() == 5 and store.scan(spark, root, "traces", tenant="x").count() == 0


def test_a_batch_that_comes_again_replaces_itself(spark, tmp_path):
    rows = otlp.flatten_traces(requests(spark, TRACES)).cache()
    for batch in ("s-1", "s-12", "s-1"):
        store.append_batch(rows, str(tmp_path), "traces", batch)
    assert store.scan(spark, str(tmp_path), "traces").count() == 4


def test_compaction_leaves_what_came_meanwhile(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    rows = otlp.flatten_traces(requests(spark, TRACES)).where("start_time > 100000").cache()
    for _ in range(2):
        store.append(rows, root, "traces")
    move = store._move

    def late(*args):
        store.append(rows, root, "traces")  # after the files were listed and read
        move(*args)

    monkeypatch.setattr(store, "_move", late)
    store.compact(spark, root, "traces", store.partitions(spark, root, "traces"))
    assert store.scan(spark, root, "traces").count() == 3


def test_windows_prune_days(spark, tmp_path):
    from otelframe.functions.window import TimeWindow

    rows = otlp.flatten_traces(requests(spark, TRACES)).where("start_time > 100000").cache()
    for days in range(6):
        store.append(rows.withColumn("start_time", F.col("start_time") - days * store.DAY), str(tmp_path), "traces")
    found = store.windowed(spark, str(tmp_path), "traces", TimeWindow(T0 + 1, 60), "acme")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1 and "PartitionFilters: [isnotnull(date" in plan and "EqualTo(tenant,acme)" in plan


def test_values_of_any_depth(spark):
    def deep(n):
        return {"intValue": "1"} if not n else {"kvlistValue": {"values": [kv(f"k{n}", **deep(n - 1))]}} if n % 2 else {"arrayValue": {"values": [deep(n - 1), {"stringValue": 'q"'}, {"arrayValue": {}}]}}

    def plain(n):
        return 1 if not n else {f"k{n}": plain(n - 1)} if n % 2 else [plain(n - 1), 'q"', []]

    span = {**SPAN, "attributes": [kv("a", **deep(6)), kv("b", kvlistValue={"values": []})], "events": [{"name": "e", "attributes": [kv("x", **deep(6))]}]}
    row = otlp.flatten_traces(requests(spark, {"resourceSpans": [{"resource": RESOURCE, "scopeSpans": [{"spans": [span]}]}]})).first()
    assert json.loads(row.attributes) == {"a": plain(6), "b": {}}
    assert json.loads(row.events)[0]["attributes"] == {"x": plain(6)}
    beyond = {**SPAN, "attributes": [kv("a", **deep(otlp.DEPTH + 2))]}
    text = otlp.flatten_traces(requests(spark, {"resourceSpans": [{"resource": RESOURCE, "scopeSpans": [{"spans": [beyond]}]}]})).first().attributes
    assert json.loads(text) and "null" not in text


def test_live_rollup(spark, tmp_path):
    rows = spark.createDataFrame([("m", T0 + i * 10_000_000, float(i), "web") for i in range(12)], "metric_name string, timestamp long, value_double double, service_name string")
    rows.write.parquet(str(tmp_path / "points"))
    stream = live_rollup(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "points")), "1 minute", ["service_name"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("rolled").start()
    q.processAllAvailable()
    q.stop()
    got = [(r["count"], r["sum"], r["min"], r["max"]) for r in spark.table("rolled").orderBy("time").collect()]
    assert sum(c for c, *_ in got) == 12 and sum(s for _, s, *_ in got) == 66.0


def test_saved_queries_run_on_after_a_failure(spark, tmp_path):
    register(spark, fixtures.signals(spark, "/root/testdata/sf0.001"))
    saved = spark.createDataFrame([("a_roots", cookbook.spark_text("k03_root_spans")), ("b_bad", "select nope from traces"), ("c_kinds", cookbook.spark_text("k05_spans_by_kind"))], "name string, sql string")
    done = {r.name: r for r in run_suite(spark, saved, str(tmp_path / "out")).collect()}
    assert (done["a_roots"].rows, done["c_kinds"].rows, done["c_kinds"].columns) == (20, 2, ["span_kind", "spans"])
    assert done["b_bad"].rows is None and "nope" in done["b_bad"].error
    assert spark.read.parquet(str(tmp_path / "out")).where("query_name = 'c_kinds'").count() == 2


def test_units_gaps_and_marks(spark):
    rows = spark.createDataFrame([(2.0, "s"), (5.0, "µs"), (1.0, "parsec"), (1.0, None)], "v double, unit string")
    got = [(r.a, r.b) for r in rows.select(to_ms(F.col("v"), F.col("unit")).alias("a"), from_ms(F.col("v"), F.col("unit")).alias("b")).collect()]
    assert got == [(2000.0, 0.002), (0.005, 5000.0), (None, None), (None, None)]
    points = spark.createDataFrame([("k", t) for t in (0, 10, 20, 40, 50)], "k string, time long")
    assert [r.segment for r in series.split_at_gaps(points, ["k"]).orderBy("time").collect()] == [0, 0, 0, 1, 1]
    buckets = spark.createDataFrame([("k", le, v) for le, v in ((1.0, 0.0), (2.0, 3.0), (3.0, 0.0), (4.0, 1.0), (None, 0.0))], "k string, le double, value double")
    p50 = spark.createDataFrame([("k", 1.5)], "k string, value double")
    shown = series.distribution(buckets, {"p50": p50}, ["k"]).orderBy("le").collect()
    assert [(r.lo, r.le, r.value, r.p50) for r in shown] == [(1.0, 2.0, 3.0, True), (2.0, 3.0, 0.0, False), (3.0, 4.0, 1.0, False)]
    codes = spark.createDataFrame([(1, "503", 2.0), (1, "200", 9.0), (2, "none", 1.0), (1, "500", 1.0)], "time long, code string, value double")
    assert [(r.time, r.value) for r in series.server_errors(codes, "code", ["time"]).collect()] == [(1, 3.0)]


def test_lines_are_parsed_once(spark):
    """Neither kinds of points, nor filters that Spark infers, nor unions below repeat the parsing."""
    for signal, flatten in otlp.FLATTEN.items():
        lines = spark.range(3).selectExpr("concat('{\"', id, '\": 1}') as value")
        plan = flatten(lines.unionByName(lines)).select("attributes")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(f"from_json(StructField({otlp.OUTER[signal]}") == 1, signal


def test_enumerated_values(spark):
    df = spark.createDataFrame([("2",), ("SPAN_KIND_CLIENT",), ("SOME_KIND",), ("9",), ("",), (None,)], "k string")
    got = [r[0] for r in df.select(otlp.enum(F.col("k"), otlp.KINDS)).collect()]
    assert str(otlp.enum(F.col("k"), otlp.KINDS)).startswith("Column<'CASE WHEN")  # no cast of a known name, which throws
    assert got == ["SPAN_KIND_SERVER", "SPAN_KIND_CLIENT", "SOME_KIND", "9", "", "SPAN_KIND_UNSPECIFIED"]
