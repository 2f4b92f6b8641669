"""Series derived from query results: error rates, gaps, distributions, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from otelframe.functions.attrs import attr


def server_errors(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Sum of ``value`` over status codes of 500 and above; other texts are no codes."""
    code = F.expr(f"try_cast(`{column}` as double)")
    return rows.where(code >= 500).groupBy(*by).agg(F.sum("value").alias("value"))


def status_code(metrics: DataFrame) -> DataFrame:
    """``metrics`` with status_code from the newer attribute name, else the older one."""
    return metrics.withColumn("status_code", F.coalesce(attr("attributes", "http.response.status_code"), attr("attributes", "http.status_code")))


def split_at_gaps(series: DataFrame, by: list[str], time: str = "time") -> DataFrame:
    """``series`` with segment: a jump of more than 1.5 steps starts a new one; the step
    is the smallest spacing of the series."""
    w = Window.partitionBy(*by).orderBy(time)
    gaps = series.withColumn("_d", F.col(time) - F.lag(time).over(w))
    gaps = gaps.withColumn("_step", F.min("_d").over(Window.partitionBy(*by)))
    jump = F.coalesce((F.col("_d") > F.col("_step") * 1.5).cast("int"), F.lit(0))
    return gaps.withColumn("segment", F.sum(jump).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d", "_step")


def distribution(buckets: DataFrame, quantiles: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Bucket rows (by, le, value) without the empty ones at both ends, with the lower
    edge and a mark for each bucket that holds a quantile (frames by, value)."""
    w = Window.partitionBy(*by).orderBy(F.col("le").asc_nulls_last())
    placed = buckets.withColumn("lo", F.lag("le").over(w)).withColumn("_n", F.row_number().over(w))
    full = F.when(F.col("value") > 0, F.col("_n"))
    whole = Window.partitionBy(*by)
    shown = placed.withColumn("_a", F.min(full).over(whole)).withColumn("_z", F.max(full).over(whole)).where("_n between _a and _z")
    for name, frame in quantiles.items():
        shown = shown.join(frame.withColumnRenamed("value", f"_{name}"), by, "left")
        q = F.col(f"_{name}")
        inside = q.isNotNull() & (F.col("lo").isNull() | (q > F.col("lo"))) & (F.col("le").isNull() | (q <= F.col("le")))
        shown = shown.withColumn(name, F.coalesce(inside, F.lit(False))).drop(f"_{name}")
    return shown.drop("_n", "_a", "_z")


def bar_share(rows: DataFrame, value: str = "value") -> DataFrame:
    """Each row's value against the largest (at least 1); for aggregated frames."""
    return rows.withColumn("share", F.col(value) / F.greatest(F.max(value).over(Window.partitionBy()), F.lit(1)))


def on_one_grid(requests: DataFrame, errors: DataFrame, latency: DataFrame) -> DataFrame:
    """time, requests, errors, p95: three series (time, value) side by side."""
    named = [df.select("time", F.col("value").alias(n)) for df, n in ((requests, "requests"), (errors, "errors"), (latency, "p95"))]
    return named[0].join(named[1], "time", "full").join(named[2], "time", "full").orderBy("time")
