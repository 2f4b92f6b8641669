"""Quantile sketches (KLL): made once for each hour and key, merged for any window and group.

A sketch holds some hundred numbers whatever the count of values behind it, so a table of
them answers percentiles over long windows without the points. The rank of an answer is
off by about 1.65 / ``SIZE`` of the count, with a probability of 99 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otelframe.functions.window import TimeWindow, bucket_start, duration

#: Numbers that a sketch keeps at its top level.
SIZE = 400
HOUR = duration("1h")


def hourly_sketches(rows: DataFrame, value: str, time: str, keys: list[Column | str], size: int = SIZE) -> DataFrame:
    """keys, hour (micros), sketch, n: a sketch of ``value`` for each hour of ``time`` and
    key. Values are summed up in sketches before they travel."""
    known = rows.where(F.col(value).isNotNull())
    grouped = known.groupBy(*keys, bucket_start(time, HOUR).alias("hour"))
    return grouped.agg(F.kll_sketch_agg_double(value, F.lit(size)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, by: list[str], window: TimeWindow | None = None) -> DataFrame:
    """by, sketch, n: the sketches of a group, those of the window's hours if one is given
    (hours that the window cuts count as a whole)."""
    if window is not None:
        sketches = sketches.where(F.col("hour") + HOUR > window.start)
        if window.until:
            sketches = sketches.where(F.col("hour") < window.end)
    names = [F.col(f"`{b}`") for b in by]
    return sketches.groupBy(*names).agg(F.kll_merge_agg_double("sketch", F.lit(SIZE)).alias("sketch"), F.sum("n").alias("n"))


def quantile(q: float, sketch: str = "sketch") -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))
