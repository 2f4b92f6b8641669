"""Histogram increments, merges and quantiles against plain Python over random series."""

import random

import pytest
from pyspark.sql import functions as F

from otelframe.functions.window import MINUTE, TimeWindow
from otelframe.operators.metrics import CUMULATIVE, query_metric
from otelframe.schemas import METRIC_SCHEMA, conform

NOW = 1_700_000_000_000_000
DELTA = "AGGREGATION_TEMPORALITY_DELTA"
WINDOW = TimeWindow(NOW, 60)


def point(route, temporality, start, at, count, total, buckets, name="latency", bounds="[10,100]", tenant="acme"):
    """start and at are minutes before NOW."""
    return (name, "histogram", NOW - at * MINUTE, NOW - start * MINUTE, count, float(total), buckets, bounds, f'{{"http.route":"{route}"}}', f'{{"tenant.id":"{tenant}"}}', temporality)


def frame(spark, rows):
    ddl = "metric_name string, metric_type string, timestamp long, start_timestamp long, count long, sum double, bucket_counts string, explicit_bounds string, attributes string, resource_attributes string, aggregation_temporality string"
    return conform(spark.createDataFrame(rows, ddl), "metrics")


BOUNDS = [5, 20, 80, 400]


def drawn(seed):
    """Random series of eight routes, a third of them deltas, and the increments within the
    window that they stand for: (route, minutes before NOW, buckets, sum). Of a cumulative
    series the first point of the window is the base and stands for none, also where there
    are points before the window; it restarts once or never."""
    rng, rows, increments = random.Random(seed), [], []
    for i in range(8):
        route = f"/r{i}"
        times = sorted(rng.sample(range(1, 60), rng.randint(4, 12)), reverse=True)
        if i % 3 == 0:
            for at in times:
                part, total = [rng.randint(0, 9) for _ in range(5)], rng.randint(1, 900)
                rows.append(point(route, DELTA, at + 1, at, sum(part), total, str(part), bounds=str(BOUNDS)))
                increments.append((route, at, part, total))
            continue
        held, held_sum, start = [rng.randint(40, 60) for _ in range(5)], 5000, 300
        rows.append(point(route, CUMULATIVE, start, rng.randint(65, 85), sum(held), held_sum, str(held), bounds=str(BOUNDS)))
        restart = rng.choice([None, *times])
        for at in times:
            part, total = [rng.randint(0, 4) for _ in range(5)], rng.randint(1, 90)
            if at == restart:
                held, held_sum, start = [0] * 5, 0, at
            held, held_sum = [x + y for x, y in zip(held, part)], held_sum + total
            rows.append(point(route, CUMULATIVE, start, at, sum(held), held_sum, str(held), bounds=str(BOUNDS)))
            if at != times[0]:
                increments.append((route, at, part, total))
    rows += [point(f"/r{i}", DELTA, 31, 30, 50, 50, "[50,0,0,0,0]", tenant="other", bounds=str(BOUNDS)) for i in range(8)]
    rows += [point("/r1", DELTA, 31, 30, 50, 50, "[50,0,0,0,0]", name="size", bounds=str(BOUNDS))]
    return rows, increments


@pytest.fixture(scope="module", params=[4, 19])
def series(request, spark):
    rows, increments = drawn(request.param)
    return frame(spark, rows).cache(), increments


def by_route(increments):
    """Buckets and sum of each route, and of all together under None."""
    out = {}
    for route, _, part, total in increments:
        for key in (route, None):
            held, so_far = out.get(key, ([0] * 5, 0))
            out[key] = [x + y for x, y in zip(held, part)], so_far + total
    return out


def quantile(buckets, q):
    """Linear within a bucket, the last bound above it."""
    rank, before = q * sum(buckets), 0
    for low, high, n in zip([0, *BOUNDS], BOUNDS, buckets):
        if n and before + n >= rank:
            return low + (high - low) * (rank - before) / n
        before += n
    return BOUNDS[-1]


def values(df, key="attr.http.route"):
    return {(r[key] if key else None): r["value"] for r in df.collect()}


def ask(frame, agg, group="attr.http.route", **more):
    return query_metric(frame, "acme", more.pop("name", "latency"), agg, more.pop("window", WINDOW), group, **more)


def test_counts_sums_and_averages(series):
    rows, increments = series
    want = by_route(increments)
    total = want.pop(None)
    assert values(ask(rows, "count")) == {k: sum(b) for k, (b, _) in want.items()}
    assert values(ask(rows, "sum")) == {k: t for k, (_, t) in want.items()}
    assert values(ask(rows, "avg")) == pytest.approx({k: t / sum(b) for k, (b, t) in want.items()})
    assert values(ask(rows, "count", ""), None) == {None: sum(total[0])}
    assert values(ask(rows, "sum", "", name="size"), None) == {None: 50}


@pytest.mark.parametrize("agg, q", [("p50", 0.5), ("p95", 0.95)])
def test_quantiles(series, agg, q):
    rows, increments = series
    want = {k: quantile(b, q) for k, (b, _) in by_route(increments).items()}
    total = want.pop(None)
    assert values(ask(rows, agg)) == pytest.approx(want)
    assert values(ask(rows, agg, ""), None)[None] == pytest.approx(total)


def test_buckets(series):
    rows, increments = series
    want = {(k, float(e) if e else None): n for k, (b, _) in by_route(increments).items() if k for e, n in zip([*BOUNDS, None], b) if n}
    got = {(r["attr.http.route"], r["le"]): r["value"] for r in ask(rows, "buckets").collect() if r["value"]}
    assert got == want


def test_steps_add_up_to_the_window(series):
    rows, increments = series
    steps = ask(rows, "count", "", step="5m")
    assert steps.columns == ["time", "value"]
    assert steps.agg(F.sum("value")).first()[0] == sum(sum(part) for _, _, part, _ in increments)


def test_baseline_gives_a_zero_row_and_no_bucket(spark):
    rows = frame(spark, [point("/x", CUMULATIVE, 120, 30, 10, 100, "[5,5,0]")])
    assert values(ask(rows, "count")) == {"/x": 0}
    assert ask(rows, "buckets").count() == 0


def test_bucket_list_length_change(spark):
    c = CUMULATIVE
    rows = frame(spark, [point("/x", c, 50, 40, 5, 50, "[1,2,2]"), point("/x", c, 50, 30, 10, 100, "[1,2,2,5]"), point("/x", c, 50, 20, 15, 150, "[2,4,4,5]")])
    assert values(ask(rows, "count")) == {"/x": 15}
    assert sum(r["value"] for r in ask(rows, "buckets").collect()) == 10


def test_bad_bounds_are_left_out(spark):
    rows = frame(spark, [point("/x", DELTA, 50, 40, 5, 50, "[1,2,2]", bounds="nope"), point("/x", DELTA, 50, 39, 5, 50, "[5,0,0]")])
    assert values(ask(rows, "p50"))["/x"] == pytest.approx(5.0)


def test_invalid_input(series, spark):
    rows, _ = series
    with pytest.raises(ValueError):
        ask(rows, "median")
    with pytest.raises(ValueError):
        query_metric(rows, " ", "latency", "count", WINDOW)
    with pytest.raises(ValueError):
        ask(rows, "count", "span_name")
    with pytest.raises(ValueError):
        ask(rows, "count", "", step="1ms")
    with pytest.raises(ValueError):
        ask(rows, "p50", metric_type="exponential_histogram")
    with pytest.raises(ValueError):
        ask(rows, "avg", metric_type="summary")
    empty = spark.createDataFrame([], METRIC_SCHEMA)
    assert ask(empty, "buckets", "").count() == 0
    assert ask(empty, "count").count() == 0
