"""The store's ledger, day sets, rejected lines, and streams over it."""

import json
import time

import pytest
from pyspark.sql import functions as F

from otelframe.functions.attrs import attr
from otelframe.functions.window import TimeWindow
from otelframe.operators import compare, metrics, search, sketches
from otelframe.plans.suite import run_suite
from otelframe.sources import days, otlp, store
from otelframe.sources.ledger import Files, Ledger
from otelframe.streaming.increments import streamed_increments
from otelframe.streaming.ingest import accept, ingest, rejected_lines

T0 = 1_700_000_000_000_000


@pytest.fixture(scope="module")
def logs(spark):
    """1,000 logs of 100 traces over 10 days; a trace lies within one day."""
    trace = F.expr("lower(lpad(hex(id div 10), 32, '0'))")
    when = (F.lit(T0) + (F.col("id") / F.lit(100)).cast("long") * store.DAY + F.col("id")).cast("long")
    who = F.when(F.col("id") % 3 == 0, "acme").otherwise("globex")
    rows = spark.range(1000).select(
        when.alias("timestamp"), trace.alias("trace_id"), F.concat(F.lit("b"), "id").alias("body"), F.concat(F.lit("svc-"), F.col("id") % 4).alias("service_name"),
        F.concat(F.lit('{"tenant.id":"'), who, F.lit('"}')).alias("resource_attributes"),
    )
    return rows.cache()


def bodies(spark, root):
    return sorted(r.body for r in store.scan(spark, root, "logs").select("body").collect())


class Crash(Exception):
    pass


def crash_at(monkeypatch, n):
    """The n-th change of a file from here on fails, and all after it."""
    left = [n]

    def breaking(f):
        def run(self, *args):
            left[0] -= 1
            if left[0] < 0:
                raise Crash
            return f(self, *args)

        return run

    for name in ("rename", "delete", "write", "make_folder"):
        monkeypatch.setattr(Files, name, breaking(getattr(Files, name)))


def test_a_batch_is_there_once_wherever_it_breaks_off(spark, tmp_path, logs):
    part = lambda k: logs.where((F.pmod("timestamp", F.lit(2)) == k) & (F.col("timestamp") < T0 + 2 * store.DAY))
    everything = sorted(r.body for r in part(0).unionByName(part(1)).collect())
    broke = 0
    for n in range(0, 40, 3):
        root = str(tmp_path / f"r{n}")
        store.append_batch(part(0), root, "logs", "s-0")
        first = bodies(spark, root)
        with pytest.MonkeyPatch.context() as patch:
            crash_at(patch, n)
            try:
                store.append_batch(part(1), root, "logs", "s-1")
            except Crash:
                broke += 1
            else:
                broke = -broke  # no further step
        assert bodies(spark, root) in (first, everything)  # as a whole or not at all
        store.append_batch(part(1), root, "logs", "s-1")
        assert bodies(spark, root) == everything
        if broke <= 0:
            break
    assert broke < 0


def test_rows_stay_wherever_a_compaction_breaks_off(spark, tmp_path, logs):
    part = lambda k: logs.where((F.pmod("timestamp", F.lit(2)) == k) & (F.col("timestamp") < T0 + 2 * store.DAY))
    everything = sorted(r.body for r in part(0).unionByName(part(1)).collect())
    n = 0
    while True:
        root = str(tmp_path / f"r{n}")
        for k in (0, 1):
            store.append_batch(part(k), root, "logs", f"s-{k}")
        with pytest.MonkeyPatch.context() as patch:
            crash_at(patch, n)
            try:
                store.compact(spark, root, "logs", store.partitions(spark, root, "logs"))
                ended = True
            except Crash:
                ended = False
        assert bodies(spark, root) == everything
        assert not store.append_batch(part(1), root, "logs", "s-1")  # it comes again
        assert bodies(spark, root) == everything
        store.compact(spark, root, "logs", store.partitions(spark, root, "logs"))
        assert bodies(spark, root) == everything and store.partitions(spark, root, "logs").where("files > 1").count() == 0
        if ended:
            break
        n += 6
    assert n >= 6


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size()) if leaves.apply(k).metrics().contains("numFiles"))


def test_a_trace_is_read_from_its_days(spark, tmp_path, logs):
    root = str(tmp_path)
    for k in range(3):
        store.append(logs.where(F.pmod("timestamp", F.lit(3)) == k), root, "logs")
    wanted = f"{7:032x}"
    full = store.scan(spark, root, "logs").where(F.col("trace_id") == wanted)
    found = store.of_traces(spark, root, "logs", [wanted], "acme")
    assert files_read(found) * 10 == files_read(full) == 30
    got = search.search_logs(found, "acme", TimeWindow(T0, 60), trace_id=wanted, limit=100).collect()
    assert sorted(r.body for r in got) == sorted(f"b{i}" for i in range(70, 80) if i % 3 == 0)
    assert days.of_traces(spark, root, "logs", [wanted, f"{95:032x}", "none"]) == ["2023-11-14", "2023-11-23"]
    assert store.of_traces(spark, root, "logs", ["none"]).count() == 0
    store.compact(spark, root, "logs", store.partitions(spark, root, "logs"))
    assert days.read(spark, root, "logs", "trace").count() == 100
    assert files_read(store.of_traces(spark, root, "logs", [wanted], "acme")) == 1


def test_names_equal_a_full_scan(spark, tmp_path, logs):
    root = str(tmp_path)

    def check():
        full = store.scan(spark, root, "logs", keep_tenant=True).select("tenant", "service_name").distinct()
        assert sorted(store.names(spark, root, "logs").collect()) == sorted(full.collect())
        return full.count()

    assert check() == 0
    store.append(logs.where("id is null" if "id" in logs.columns else "false"), root, "logs")
    store.append(logs, root, "logs")
    old = logs.limit(5).select("*").withColumn("service_name", F.lit("old")).withColumn("timestamp", F.lit(T0 - 20 * store.DAY))
    store.append(old, root, "logs")
    assert check() == 10
    store.compact(spark, root, "logs", store.partitions(spark, root, "logs"))
    assert check() == 10
    store.retain(spark, root, "15d", T0)
    assert check() == 8


def test_searches_use_the_stored_tenant(spark, tmp_path, logs):
    store.append(logs, str(tmp_path), "logs")
    day = TimeWindow(T0 + 3 * store.DAY, 2 * 1440, 1440)
    found = search.search_logs(store.windowed(spark, str(tmp_path), "logs", day), "acme", day, limit=1000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tenant,acme)" in plan and "tenant.id" not in plan and found.columns == store.scan(spark, str(tmp_path), "logs").columns
    assert found.count() == 33
    with pytest.raises(ValueError):
        search.of_tenant(store.scan(spark, str(tmp_path), "logs", keep_tenant=True), " ")


# ---- lines ----

GOOD = {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}, {"key": "tenant.id", "value": {"stringValue": "acme"}}]}, "scopeLogs": [{"logRecords": [{"timeUnixNano": "1700000000000000000", "body": {"stringValue": "hi"}}]}]}]}
LINES = {
    json.dumps(GOOD): None, "{}": None, "": "empty", "  ": "empty", "{nope": "not JSON", "[1]": "not an object", '"x"': "not an object", "7": "not an object",
    '{"resourceSpans": []}': "no resourceLogs", '{"resourceLogs": "x"}': "wrong types", '{"resourceLogs": null}': "wrong types", '{"resourceLogs": []}': None,
}


def test_every_line_is_accepted_or_rejected(spark):
    lines = spark.createDataFrame([(v, "k") for v in LINES] + [(None, "k")], "value string, sender_key string")
    good, bad = otlp.split(lines, "logs")
    assert {r.value for r in good.collect()} == {v for v, c in LINES.items() if c is None}
    assert {r.value: r.cause for r in bad.collect()} == {v: c for v, c in LINES.items() if c} | {None: "empty"}
    assert good.columns == lines.columns
    rows, rejected = accept(lines, "logs", spark.createDataFrame([("other", [])], "sender_key string, tenants array<string>"))
    assert rows.count() == 0 and rejected.where("cause = 'tenant'").count() == 1 and rejected.count() == bad.count() + 1


def test_streams_stamp_tenants_with_changing_keys(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    keys = {"a": ["globex"], "b": []}
    take = lambda: ingest(
        spark, str(source), root, "logs", str(tmp_path / "cp"), every=None, sender=F.regexp_extract("_metadata.file_name", r"^(\w)", 1),
        keys=lambda s: s.createDataFrame(list(keys.items()), "sender_key string, tenants array<string>"),
    ).awaitTermination()
    tenants = lambda: sorted(r.tenant for r in store.scan(spark, root, "logs", keep_tenant=True).collect())
    for name in "abc":
        (source / f"{name}1.json").write_text("\n".join([json.dumps(GOOD), "{nope"]) + "\n")
    take()
    assert tenants() == ["acme", "globex"]
    causes = lambda: sorted((r.sender_key, r.cause) for r in rejected_lines(spark, root).collect())
    assert causes() == [("a", "not JSON"), ("b", "not JSON"), ("c", "not JSON"), ("c", "tenant")]
    del keys["a"]
    keys["c"] = ["initech"]
    for name in "ac":
        (source / f"{name}2.json").write_text(json.dumps(GOOD) + "\n")
    take()
    take()
    assert tenants() == ["acme", "globex", "initech"] and causes()[0] == ("a", "not JSON") and ("a", "tenant") in causes() and len(causes()) == 5


# ---- state of series ----


def test_streamed_increments_equal_batch_ones(spark, tmp_path):
    hour = 3_600_000_000
    rows = []
    for name, steps in (("a", [5, 9, 9, 2, 7]), ("b", [1, 4, 8, 16, 3])):  # b restarts at the last point, a at the fourth
        for k, c in enumerate(steps):
            rows.append(("m", name, T0 + k * hour, T0 - (hour if name == "a" else -1), float(c), c * 2.0, f"[{c},{c + 1}]" if k != 2 else "[1]", "[10]", metrics.CUMULATIVE))
    rows += [("m", "d", T0 + k * hour, T0, 3.0, 6.0, "[1,2]", "[10]", "AGGREGATION_TEMPORALITY_DELTA") for k in range(3)]
    ddl = "metric_name string, attributes string, timestamp long, start_timestamp long, count double, sum double, bucket_counts string, explicit_bounds string, aggregation_temporality string"
    points = spark.createDataFrame(rows, ddl).withColumns({"resource_attributes": F.lit("{}"), "service_name": F.lit("s"), "min": F.lit(0.0), "max": F.lit(0.0)})
    want = {(r.attributes, r.timestamp): (r.dc, r.ds, r.db) for r in metrics.increments(points, T0).collect()}
    folder = str(tmp_path / "points")
    start = lambda: (
        streamed_increments(spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(folder), T0, "1 day").writeStream
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"made/n={n}"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    )
    for keep in (F.pmod("timestamp", F.lit(2 * hour)) == T0 % (2 * hour), F.pmod("timestamp", F.lit(2 * hour)) != T0 % (2 * hour)):
        points.where(keep).coalesce(1).write.mode("append").parquet(folder)
        start()  # a run of its own: state comes from the checkpoint
    points.limit(1).withColumn("attributes", F.lit("later")).withColumn("timestamp", F.lit(T0 + 100 * 24 * hour)).write.mode("append").parquet(folder)
    start()
    got = {(r.attributes, r.timestamp): (r.dc, r.ds, r.db) for r in spark.read.parquet(str(tmp_path / "made")).collect() if r.attributes != "later"}
    assert got == want and len(want) == 13


# ---- samples, sketches, suites ----


def test_a_sample_has_exactly_its_size(spark):
    spans = spark.range(5000).select(F.hex("id").alias("trace_id"), F.lit("s").alias("span_id"), (F.col("id") % 7 == 0).alias("slow")).cache()
    want = [r.trace_id for r in spans.orderBy(compare.draw(3), "trace_id").limit(200).collect()]
    assert sorted(r.trace_id for r in compare.bottom_k(spans, 200, 5000, 3).collect()) == sorted(want)
    assert compare.bottom_k(spans, 200, 10**9, 3).count() == 200  # too few below the bound: all are sorted
    assert compare.bottom_k(spans, 6000, 5000, 3).count() == 5000


def test_sketches_merge(spark):
    points = spark.range(20_000).select((F.lit(T0) + F.col("id") * 1_000_000).alias("t"), (F.col("id") * 7919 % 20_000).cast("double").alias("v"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("k"))
    hourly = sketches.hourly_sketches(points, "v", "t", ["k"]).cache()
    assert hourly.count() == 12
    for q in (0.5, 0.95, 0.99):
        for r in sketches.merged(hourly, ["k"]).select(sketches.quantile(q).alias("v"), "n").collect():
            assert r.n == 10_000 and abs(r.v / 20_000 - q) < 0.02
    window = TimeWindow(T0 + 2 * sketches.HOUR, 60)
    assert sketches.merged(hourly, [], window).first().n == 17_200  # hours that the window cuts count as a whole
    assert sketches.hourly_sketches(points.where("false"), "v", "t", ["k"]).count() == 0


def test_an_endless_query_ends_alone(spark):
    saved = [("a", "select 1 as x"), ("endless", "select id from range(0, 4000000000, 1, 2000) where sha2(cast(id as string), 512) = 'x'"), ("z", "select 2 as y, 3 as w")]
    began = time.time()
    done = {r.name: r for r in run_suite(spark, spark.createDataFrame(saved, "name string, sql string"), at_once=1, limit=8).collect()}
    assert done["a"].rows == done["z"].rows == 1 and done["z"].columns == ["y", "w"]
    assert done["endless"].rows is None and done["endless"].error == "stopped after 8 s" and time.time() - began < 90


def test_giant_traces_are_ranked_in_slices(spark):
    from otelframe.operators import traces

    rows = spark.range(3000).select(F.when(F.col("id") < 2900, "big").otherwise(F.concat(F.lit("t"), F.col("id") % 10)).alias("trace_id"), (F.col("id") * 37 % 1000).alias("start_time"), F.hex("id").alias("span_id"), F.lit('{"tenant.id":"t"}').alias("resource_attributes"))
    ids = rows.select("trace_id").distinct()
    got = traces.capped_spans(rows, ids, "t", 50)
    big = sorted((r.start_time, r.span_id) for r in got.where("trace_id = 'big'").collect())
    assert big == sorted((r.start_time, r.span_id) for r in rows.where("trace_id = 'big'").collect())[:50]
    assert got.where("trace_id <> 'big'").count() == 100 and {r.span_total for r in got.collect()} == {2900, 10}
    assert attr("resource_attributes", "tenant.id") is not None


def test_values_of_twenty_levels(spark):
    def typed(n):
        if not n:
            return {"doubleValue": 2.5}
        inner = typed(n - 1)
        return {"kvlistValue": {"values": [{"key": "z", "value": {"bytesValue": "AQI="}}, {"key": f"k{n}", "value": inner}, {"key": "z", "value": {"intValue": "4"}}]}} if n % 2 else {"arrayValue": {"values": [inner, {"stringValue": 'q"é'}, {}]}}

    def plain(n):
        return 2.5 if not n else {f"k{n}": plain(n - 1), "z": 4} if n % 2 else [plain(n - 1), 'q"é', None]

    for n in (3, 4, 20):
        record = {"body": typed(n), "attributes": [{"key": "a", "value": typed(n)}, {"key": "b", "value": {"arrayValue": {"values": []}}}]}
        lines = spark.createDataFrame([(json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [record]}]}]}),)], "value string")
        row = otlp.flatten_logs(lines).first()
        assert json.loads(row.attributes) == {"a": plain(n), "b": []} and json.loads(row.body) == plain(n)


def test_a_window_reads_a_fraction_of_a_days_files(spark, tmp_path):
    """24 appends of an hour each: one hour is in one file, its rows equal a full scan's."""
    root, hour = str(tmp_path), store.DAY // 24
    start = T0 - T0 % store.DAY
    rows = spark.range(2400).select((F.lit(start) + F.col("id") * (hour // 100)).alias("timestamp"), F.concat(F.lit("b"), "id").alias("body"), F.lit('{"tenant.id":"acme"}').alias("resource_attributes"))
    for k in range(24):
        store.append(rows.where(F.expr(f"body >= 'b' and (timestamp - {start}) div {hour} = {k}")), root, "logs")
    window = TimeWindow(start + 10 * hour, 120, 60)
    found = store.within(spark, root, "logs", window, "acme")
    want = sorted(r.body for r in store.scan(spark, root, "logs").where(window.holds("timestamp")).collect())
    assert sorted(r.body for r in found.collect()) == want and len(want) == 100
    assert len(found.inputFiles()) == 1 and len(store.scan(spark, root, "logs").inputFiles()) == 24
    assert store.within(spark, root, "logs", window, "globex").count() == 0
    assert len(store.within(spark, root, "logs", window, slack=hour).inputFiles()) == 3
    assert store.within(spark, root, "logs", TimeWindow(start - 40 * store.DAY, 60, 1)).count() == 0
    assert store.within(spark, root, "logs", TimeWindow(start + store.DAY, 60)).count() == 100  # without an upper bound
    day = store.layout(spark, root, "logs").first()
    assert (day.files, day.row_groups, day.rows, day.oldest, day.newest) == (24, 24, 2400, start, start + 2399 * (hour // 100))
    store.compact(spark, root, "logs", store.partitions(spark, root, "logs"))
    assert sorted(r.body for r in store.within(spark, root, "logs", window, "acme").collect()) == want
    assert store.layout(spark, root, "logs").first().files == 1


def test_a_window_is_whole_while_a_change_is_open(spark, tmp_path, logs):
    root = str(tmp_path)
    store.append(logs.where("timestamp % 2 = 0"), root, "logs")
    window = TimeWindow(T0 + 2 * store.DAY, 24 * 60, 1)
    want = logs.where(window.holds("timestamp"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Ledger, "finish", lambda self, change: None)
        store.append(logs.where("timestamp % 2 = 1"), root, "logs")
    assert sorted(r.body for r in store.within(spark, root, "logs", window).collect()) == sorted(r.body for r in want.collect())
    assert store.within(spark, str(tmp_path / "none"), "logs", window).count() == 0
