"""Increments of cumulative histogram series in a stream.

The batch form (``operators.metrics.increments``) looks back one point in a series. Here
each series keeps its last point as state between micro-batches, and the points that may
still be overtaken by older ones: a point waits until the watermark has passed it, so that
increments are made in the order of time, whatever the order of arrival and wherever a
batch ends. Restarts of a counter, first points and deltas count as in the batch form.

State is kept in RocksDB: a few numbers for each series, and its waiting points.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from otelframe.operators.metrics import CUMULATIVE, SERIES

KEYS = ["metric_name", "service_name", *SERIES]
POINT = "timestamp long, count double, sum double, min double, max double, bucket_counts string"
MADE = f"metric_name string, service_name string, attributes string, resource_attributes string, start_timestamp long, explicit_bounds string, aggregation_temporality string, {POINT}, dc double, ds double, db array<double>"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def buckets(text: str | None) -> list[float] | None:
    try:
        return [float(x) for x in json.loads(text)]
    except (TypeError, ValueError):
        return None


def gained(point: tuple, last: tuple | None, delta: bool, inside: bool) -> tuple[float, float, list[float] | None]:
    """(dc, ds, db) of a point (timestamp, count, sum, min, max, bucket_counts) after the
    series' ``last`` one. ``inside``: the series began after the cut."""
    own = buckets(point[5])
    if delta or (last is None and inside) or (last is not None and point[1] < last[1]):
        return point[1], point[2], own
    if last is None:
        return 0.0, 0.0, None
    before = buckets(last[5])
    same = own is not None and before is not None and len(own) == len(before)
    return point[1] - last[1], point[2] - last[2], [a - b for a, b in zip(own, before, strict=True)] if same else None


class SeriesIncrements(StatefulProcessor):
    """Last point and waiting points of one series."""

    def __init__(self, cut: int):
        self.cut = cut

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", POINT)
        self.waiting = handle.getListState("waiting", POINT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        points = [tuple(r) for frame in rows for r in frame[["timestamp", "count", "sum", "min", "max", "bucket_counts"]].itertuples(index=False, name=None)]
        yield from self._take(key, points, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._take(key, [], timerValues)

    def _take(self, key: tuple, points: list[tuple], timers) -> Iterator[pd.DataFrame]:
        """Make increments of the points that the watermark has passed; the others wait."""
        if self.waiting.exists():
            points = [*map(tuple, self.waiting.get()), *points]
        points.sort(key=lambda p: p[0])
        passed = timers.getCurrentWatermarkInMs() * 1000
        ready, later = [p for p in points if p[0] <= passed], [p for p in points if p[0] > passed]
        last = tuple(self.last.get()) if self.last.exists() else None
        delta, inside = key[6] != CUMULATIVE, key[4] >= self.cut
        made = []
        for p in ready:
            made.append((*key, *p, *gained(p, last, delta, inside)))
            last = p
        if ready:
            self.last.update(last)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(-(-later[0][0] // 1000))
        else:
            self.waiting.clear()
        if made:
            yield pd.DataFrame(made, columns=[f.split()[0] for f in MADE.split(", ")])

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of this kind needs it."""
    spark.conf.set(STATE_STORE, ROCKSDB)


def streamed_increments(points: DataFrame, cut: int, late: str = "1 hour") -> DataFrame:
    """A stream of histogram points with dc, ds and db, as the batch form has them for the
    window that starts at ``cut``. Points that come more than ``late`` after newer ones of
    any series are left out; the query's progress counts them."""
    use_rocksdb(points.sparkSession)
    known = points.where("aggregation_temporality <> ''").select(
        *KEYS, "timestamp", F.col("count").cast("double").alias("count"), "sum", "min", "max", "bucket_counts", F.timestamp_micros("timestamp").alias("ts")
    )
    grouped = known.withWatermark("ts", late).groupBy(*KEYS)
    return grouped.transformWithStateInPandas(SeriesIncrements(cut), MADE, "Append", "EventTime")
