"""Trace summaries, comparison, searches and exemplars on small frames."""

import pytest

from otelframe.functions.attrs import AttrFilter
from otelframe.functions.window import MINUTE, Range, TimeWindow
from otelframe.operators import compare, exemplars, search, traces
from otelframe.schemas import conform

NOW = 1_700_000_000_000_000
RES = '{"service.name":"web","tenant.id":"acme"}'
SPAN = "trace_id string, span_id string, parent_span_id string, service_name string, span_name string, start_time long, end_time long, duration_ms double, status_code string, span_kind string, attributes string, resource_attributes string"


def span(trace, sid, parent, start_ms, end_ms, name="op", service="web", status="STATUS_CODE_OK", kind="SPAN_KIND_SERVER", attrs="{}", res=RES):
    return (trace, sid, parent, service, name, NOW + start_ms * 1000, NOW + end_ms * 1000, float(end_ms - start_ms), status, kind, attrs, res)


def spans(spark, rows):
    return conform(spark.createDataFrame(rows, SPAN), "traces")


def logs(spark, rows=()):
    ddl = "trace_id string, span_id string, timestamp long, severity_number int, severity_text string, body string, resource_attributes string, service_name string"
    return conform(spark.createDataFrame(list(rows), ddl), "logs")


def test_self_time_is_duration_minus_the_union_of_children(spark):
    rows = [span("t", "r", "", 0, 100), span("t", "a", "r", 10, 40), span("t", "b", "r", 30, 60), span("t", "c", "r", 90, 150), span("t", "d", "a", 0, 20)]
    got = {r.span_id: r.self_us for r in traces.self_times(spans(spark, rows)).collect()}
    assert got == {"r": 40_000, "a": 20_000, "b": 30_000, "c": 60_000, "d": 20_000}


def test_summary(spark):
    rows = [span("t", "r", "", 0, 200), *[span("t", f"s{i}", "r", 10 * i, 10 * i + 10, "SELECT", "db") for i in range(5)], span("t", "e", "r", 100, 210, "charge", "pay", "STATUS_CODE_ERROR"), span("t", "x", "", 0, 999, res='{"tenant.id":"other"}')]
    found = logs(spark, [("t", "r", NOW + 2, 9, "info", "fine", RES, "web"), ("t", "e", NOW + 1, 17, "ERROR", "b" * 400, RES, "pay"), ("t", "", NOW, 13, "", "warn", RES, "pay")])
    ids = traces.trace_ids(spark, ["t", "nope", "t"])
    first, second, third = traces.trace_summaries(spans(spark, rows), found, ids, "acme").collect()
    assert (first.span_count, first.error_count, first.duration_ms, first.root.span_id, first.root_missing) == (7, 1, 210.0, "r", False)
    assert [(g.service_name, g["count"], g.self_ms) for g in first.groups] == [("pay", 1, 110.0), ("db", 5, 50.0)]
    assert first.untraced_ms == 50.0
    assert first.services[0].service_name == "db" and first.services[0].spans == 5
    assert [e.span_id for e in first.errors] == ["e"] and first.slowest[0].span_id == "e"
    assert first.by_severity == {"INFO": 1, "ERROR": 1, "UNSET": 1}
    assert [len(p.body) for p in first.problems] == [4, 303]
    assert second.span_count == 0 and second.root is None and second.trace_id == "nope"
    assert third.pos == 2 and third.span_count == 7
    with pytest.raises(ValueError):
        traces.trace_ids(spark, ["a", ""])


def test_cap_keeps_the_true_count_and_missing_root(spark):
    rows = [span("t", f"s{i}", "gone", i, i + 1) for i in range(6)]
    done = traces.trace_summaries(spans(spark, rows), logs(spark), traces.trace_ids(spark, ["t"]), "acme", cap=4).first()
    assert (done.span_count, done.truncated, done.root_missing, done.root.span_id, done.untraced_ms) == (6, True, True, "s0", 0.0)


def test_depth_of_a_chain_and_a_cycle(spark):
    rows = [span("t", "s0", "", 0, 1), *[span("t", f"s{i}", f"s{i - 1}", 0, 1) for i in range(1, 60)], span("u", "a", "b", 0, 1), span("u", "b", "a", 0, 1)]
    got = {(r.trace_id, r.span_id): r.depth for r in traces.depths(spans(spark, rows)).collect()}
    assert got["t", "s0"] == 0 and got["t", "s37"] == 37 and got["t", "s59"] == 50 and got["u", "a"] == 50


def test_comparison_names_the_shared_value(spark):
    rows = []
    for i in range(200):
        slow = i < 20
        attrs = f'{{"cache":"{"miss" if (slow and i < 18) or (not slow and i % 20 == 0) else "hit"}","request.id":"{i}","http.route":"/o","url.path":"/o"}}'
        rows.append(span(f"t{i}", f"s{i}", "", -i, -i + (500 if slow else 10), "GET /o", attrs=attrs))
    done = compare.compare_spans(spans(spark, rows), "acme", TimeWindow(NOW + MINUTE), service="web", slow=Range(100), limit=50)
    sizes, found = done.sizes.first(), {(r.key, r.value): r for r in done.rows.collect()}
    assert (sizes.slow_n, sizes.rest_n, sizes.sampled) == (20, 180, False)
    assert (found["cache", "miss"].slow_pct, found["cache", "miss"].rest_pct, found["cache", "miss"].diff) == (90.0, 5.0, 85.0)
    assert not any(k == "request.id" or k == "resource.service.name" for k, _ in found)
    assert found["http.route", "/o"].also == ["span_name=GET /o", "url.path=/o"]
    small = compare.compare_spans(spans(spark, rows), "acme", TimeWindow(NOW + MINUTE), slow=Range(100), cap=50)
    assert small.sizes.first().sampled and small.sizes.first().rest_n == 180
    with pytest.raises(ValueError):
        compare.span_kind("serverish")
    assert compare.span_kind("Client") == ("SPAN_KIND_CLIENT", True) and compare.span_kind("any") == ("", True)


def test_not_equals_keeps_rows_without_the_key(spark):
    rows = [span("t", k, "", 0, 1, attrs=a) for k, a in (("a", '{"http.route":"/a"}'), ("b", '{"http.route":"/b"}'), ("n", "{}"), ("bad", "{nope"))]
    ask = lambda f: {r.span_id for r in search.search_spans(spans(spark, rows), "acme", TimeWindow(NOW + MINUTE), filters=[f]).collect()}
    assert ask(AttrFilter("http.route", "/a", "!=")) == {"b", "n", "bad"}
    assert ask(AttrFilter("http.route", "", "!=")) == {"a", "b"}
    assert ask(AttrFilter("http.route", "/a")) == {"a"}
    for bad in (AttrFilter("", "x"), AttrFilter("k", "x", "~")):
        with pytest.raises(ValueError):
            ask(bad)


def test_windows_and_tenants(spark):
    rows = [span("t", f"m{m}", "", -m * 60_000, -m * 60_000 + 5) for m in (5, 15, 25, 70)]
    ask = lambda w, tenant="acme": [r.span_id for r in search.search_spans(spans(spark, rows), tenant, w).collect()]
    assert ask(TimeWindow(NOW)) == ["m5", "m15", "m25"]
    assert ask(TimeWindow(NOW, 20, 10)) == ["m15"]
    assert ask(TimeWindow(NOW), "globex") == []
    for bad in (TimeWindow(NOW, 10, 10), TimeWindow(NOW, -1)):
        with pytest.raises(ValueError):
            ask(bad)
    with pytest.raises(ValueError):
        Range(5, 1).holds("duration_ms")


def test_exemplars_once_each_highest_first(spark):
    ddl = "metric_name string, metric_type string, metric_unit string, timestamp long, exemplars string, attributes string, resource_attributes string"
    e = lambda t, s, v, n: f'{{"time_unix_nano":{n},"trace_id":"{t}","span_id":"{s}","value":{v}}}'
    rows = [("m", "histogram", "ms", NOW - MINUTE, f"[{x}]", "{}", RES) for x in (e("a", "1", 5.555, 1000), e("a", "1", 7, 2000) + "," + e("", "2", 99, 1), e("b", "1", 6, 3000))] + [("m", "histogram", "ms", NOW, "[]", "{}", RES)]
    frame = conform(spark.createDataFrame(rows, ddl), "metrics")
    got = exemplars.query_exemplars(frame, "acme", "m", TimeWindow(NOW + 1)).collect()
    assert [(r.trace_id, r.value, r.timestamp) for r in got] == [("a", 7.0, 2), ("b", 6.0, 3)]
    assert [r.value for r in exemplars.query_exemplars(frame, "acme", "m", TimeWindow(NOW + 1), value=Range(None, 6)).collect()] == [6.0, 5.555]
    slow = exemplars.slow_requests_from_metric(frame, "acme", "m", TimeWindow(NOW + 1), value=Range(5, 6)).collect()
    assert [(r.trace_id, r.value, r.unit) for r in slow] == [("b", 6.0, "ms"), ("a", 5.56, "ms")]
