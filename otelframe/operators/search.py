"""Searches, lookups and discovery over the signal tables.

All take a frame of a signal's rows: any, or one of the store, pruned to a window's days
(``store.windowed``) or a trace's days (``store.of_traces``) and with its stored tenant.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otelframe.functions.attrs import AttrFilter, attr, attr_condition, span_condition, tenant_is
from otelframe.functions.window import Range, TimeWindow, limited


#: Column of the stored tenant.
STORED_TENANT = "tenant"


def _all(conditions: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def of_tenant(rows: DataFrame, tenant: str) -> DataFrame:
    """One tenant's rows. Where the rows carry the stored tenant (``store.scan`` with
    ``keep_tenant``) that column decides, reaches the files and is left out then; else it
    is read from the resource attributes."""
    condition = tenant_is(tenant)  # a blank tenant is an error either way
    if STORED_TENANT in rows.columns:
        return rows.where(F.col(STORED_TENANT) == tenant).drop(STORED_TENANT)
    return rows.where(condition)


def span_scope(traces: DataFrame, tenant: str, service: str = "", filters: Iterable[AttrFilter] = (), duration: Range = Range()) -> DataFrame:
    """Spans of a tenant under a service, filters and a duration range."""
    conditions = [*[span_condition(f) for f in filters], duration.holds("duration_ms")]
    if service:
        conditions.append(F.col("service_name") == service)
    return of_tenant(traces, tenant).where(_all(conditions))


def lookup_trace(traces: DataFrame, trace_id: str, tenant: str, limit: int | None = None) -> DataFrame:
    """All spans of a trace, by start time."""
    if not trace_id:
        raise ValueError("trace_id is required")
    found = of_tenant(traces, tenant).where(F.col("trace_id") == trace_id)
    return found.orderBy("start_time", "span_id").limit(limited(limit, 1000, 10_000))


def search_spans(traces: DataFrame, tenant: str, window: TimeWindow, service: str = "", filters: Iterable[AttrFilter] = (), duration: Range = Range(), limit: int | None = None) -> DataFrame:
    """Newest spans first."""
    found = span_scope(traces, tenant, service, filters, duration).where(window.holds("start_time"))
    return found.orderBy(F.desc("start_time"), "trace_id", "span_id").limit(limited(limit, 100, 1000))


def search_logs(logs: DataFrame, tenant: str, window: TimeWindow, service: str = "", trace_id: str = "", severity: str = "", body: str = "", filters: Iterable[AttrFilter] = (), limit: int | None = None) -> DataFrame:
    """Newest logs first. With a trace id and no ``since`` (0) the window has no start.
    Severity is compared without case; ``%`` and ``_`` in ``body`` are wildcards."""
    conditions = [attr_condition(f) for f in filters]
    if trace_id and not window.since:
        if window.until:
            conditions.append(F.col("timestamp") < window.end)
    else:
        conditions.append(window.holds("timestamp"))
    if service:
        conditions.append(F.col("service_name") == service)
    if trace_id:
        conditions.append(F.col("trace_id") == trace_id)
    if severity:
        conditions.append(F.upper("severity_text") == severity.upper())
    if body:
        conditions.append(F.col("body").ilike(f"%{body}%"))
    return of_tenant(logs, tenant).where(_all(conditions)).orderBy(F.desc("timestamp"), "body", "trace_id").limit(limited(limit, 100, 1000))


def browse(signal: DataFrame, time_column: str, equal: dict[str, str], limit: int | None = None) -> DataFrame:
    """Newest rows of a signal under equalities, without a tenant; rows of one time by
    their other columns. ``status`` is short for a status code; metric types are taken in
    lower case."""
    conditions = []
    for key, value in equal.items():
        if not value:
            continue
        if key == "status":
            conditions.append(F.col("status_code") == "STATUS_CODE_" + value.upper())
        elif key == "metric_type":
            conditions.append(F.col(key) == value.lower())
        else:
            conditions.append(F.col(key) == value)
    n = 20 if limit is None else max(0, min(limit, 10_000))
    ties = [c for c in ("trace_id", "span_id", "metric_name", "service_name", "body", "attributes", "resource_attributes") if c in signal.columns]
    return signal.where(_all(conditions)).orderBy(F.desc(time_column), *ties).limit(n)


def list_tenants(traces: DataFrame, logs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Distinct tenants over the three signals."""
    each = [df.select(attr("resource_attributes", "tenant.id").alias("tenant")) for df in (traces, logs, metrics)]
    return each[0].union(each[1]).union(each[2]).where("tenant is not null and tenant <> ''").distinct().orderBy("tenant")


def list_values(signal: DataFrame, tenant: str, column: str) -> DataFrame:
    """Distinct non-empty values of a column: services of traces or of logs, metric names."""
    return of_tenant(signal, tenant).where(F.col(column) != "").select(column).distinct().orderBy(column)


def latest(metrics: DataFrame, tenant: str, metric_name: str, column: str) -> DataFrame:
    """Unit or type of the newest point of a metric."""
    found = of_tenant(metrics, tenant).where(F.col("metric_name") == metric_name)
    return found.agg(F.max_by(column, F.struct("timestamp", column)).alias(column))
