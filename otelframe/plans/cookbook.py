"""Ready-made SQL over the views traces, logs and metrics.

``COOKBOOK`` maps a name to its text in Spark's dialect, or to that and the SQL
oracle's where they differ. Limits come with a total order.
"""

from __future__ import annotations

from otelframe.functions.window import MINUTE
from otelframe.sources.fixtures import oracle

TRACE = "lpad(lower(hex(77)), 32, '0')"
ERRORS = "count(*) filter (where status_code = 'STATUS_CODE_ERROR')"
#: The last hour, five minutes and so on are counted back from here (1997-06-01 UTC).
AS_OF = 865_123_200_000_000
#: A time of day at which spans are there (2001-07-11 01:00 UTC), for the last hour.
HOUR_END = 994_813_200_000_000
DAY = 24 * 60 * MINUTE
_j = "json_extract_string({c}, '$.\"{k}\"')"
_g = "get_json_object({c}, \"$['{k}']\")"


def both(text: str, **keys: str) -> tuple[str, str]:
    """One text for both dialects; {name} stands for an attribute ``column:key``."""
    parts = {n: v.split(":") for n, v in keys.items()}
    return text.format(**{n: _g.format(c=c, k=k) for n, (c, k) in parts.items()}), text.format(**{n: _j.format(c=c, k=k) for n, (c, k) in parts.items()})


COOKBOOK: dict[str, str | tuple[str, str]] = {
    "k01_slowest_spans": "select service_name, span_name, duration_ms, trace_id from traces order by duration_ms desc, trace_id, span_id limit 10",
    "k02_error_rate_by_service": f"select service_name, count(*) as total, {ERRORS} as errors, round(100.0e0 * {ERRORS} / count(*), 2) as error_pct from traces group by service_name",
    "k03_root_spans": "select trace_id, span_id, service_name, span_name, start_time, duration_ms from traces where parent_span_id = '' order by start_time desc, trace_id limit 20",
    "k04_trace_waterfall": f"select span_id, span_name, parent_span_id, duration_ms, start_time - min(start_time) over () as offset_us from traces where trace_id = {TRACE}",
    "k05_spans_by_kind": "select span_kind, count(*) as spans from traces group by span_kind",
    "k06_p99_by_operation": (
        "select span_name, round(percentile(duration_ms, 0.99), 6) as p99_ms, count(*) as total from traces group by span_name having count(*) > 10",
        "select span_name, round(quantile_cont(duration_ms, 0.99), 6) as p99_ms, count(*) as total from traces group by span_name having count(*) > 10",
    ),
    "k07_attribute_filter": both("select span_name, duration_ms, span_id from traces where {a} = 'O' order by duration_ms desc, span_id limit 10", a="attributes:line.status"),
    "k08_error_messages": "select service_name, span_name, status_message, duration_ms, span_id from traces where status_code = 'STATUS_CODE_ERROR' order by start_time desc, trace_id, span_id limit 20",
    "k09_recent_error_logs": "select service_name, severity_text, body, trace_id from logs where severity_text = 'ERROR' order by timestamp desc, body limit 20",
    "k10_log_volume": "select severity_text, count(*) as total from logs group by severity_text",
    "k11a_body_search": "select timestamp, service_name, body from logs where body ilike '%USER 7 %' order by timestamp desc, body limit 20",
    "k11b_multi_term_errors": "select timestamp, service_name, body from logs where severity_text = 'ERROR' and (body ilike '%value 99%' or body ilike '%user 42 %') order by timestamp desc, body limit 10",
    "k12_logs_of_trace": f"select timestamp, severity_text, body, span_id from logs where trace_id = {TRACE}",
    "k13_latest_gauges": "select service_name, metric_name, value_double, timestamp from metrics where metric_type = 'gauge' order by timestamp desc, value_double limit 20",
    "k14_histogram_stats": "select metric_name, count, sum, min, max, case when count > 0 then round(sum / count, 6) else 0 end as avg from metrics where metric_type = 'histogram' order by timestamp desc, metric_name, attributes limit 20",
    "k15_metric_inventory": "select metric_name, metric_type, count(*) as data_points from metrics where service_name = 'svc-2' group by metric_name, metric_type",
    "k16_monotonic_counters": "select metric_name, attributes, value_double, timestamp from metrics where is_monotonic = true order by timestamp desc, attributes limit 20",
    "k17_error_spans_with_logs": "select l.timestamp, l.severity_text, l.body, t.span_name, t.duration_ms from traces t join logs l on t.trace_id = l.trace_id and t.span_id = l.span_id where t.status_code = 'STATUS_CODE_ERROR' order by l.timestamp desc, l.body limit 20",
    "k18_services_with_errors": "select t.service_name, count(distinct t.trace_id) as error_traces, count(distinct l.trace_id) as error_logs from traces t left join logs l on t.trace_id = l.trace_id and l.severity_text = 'ERROR' where t.status_code = 'STATUS_CODE_ERROR' group by t.service_name",
    "k19a_last_hour": f"select service_name, count(*) as spans from traces where start_time >= {HOUR_END - 60 * MINUTE} and start_time < {HOUR_END} group by service_name",
    "k19b_date_range": (
        "select service_name, count(*) as spans from traces where start_time >= unix_micros(timestamp'1997-05-01 00:00:00') and start_time < unix_micros(timestamp'1997-06-01 00:00:00') group by service_name",
        "select service_name, count(*) as spans from traces where start_time >= epoch_us(timestamp '1997-05-01 00:00:00') and start_time < epoch_us(timestamp '1997-06-01 00:00:00') group by service_name",
    ),
    "k20a_readable_times": (
        "select date_format(timestamp_micros(start_time), 'yyyy-MM-dd HH:mm:ss') as ts, span_name, span_id from traces order by start_time, trace_id, span_id limit 5",
        "select strftime(make_timestamp(start_time), '%Y-%m-%d %H:%M:%S') as ts, span_name, span_id from traces order by start_time, trace_id, span_id limit 5",
    ),
    "k20b_spans_per_minute": (
        "select unix_micros(date_trunc('minute', timestamp_micros(start_time))) as minute, count(*) as span_count from traces group by 1 order by 1 desc limit 60",
        "select epoch_us(date_trunc('minute', make_timestamp(start_time))) as minute, count(*) as span_count from traces group by 1 order by 1 desc limit 60",
    ),
    "k21_json_number_and_key": both("select count(*) as with_key, cast(sum(cast({a} as bigint) % 10) as bigint) as digits from traces where {a} is not null", a="attributes:part"),
    "k22_failures_by_operation": "select span_name, count(*) as failures, round(avg(duration_ms), 4) as avg_duration from traces where service_name = 'supplier-3' and status_code = 'STATUS_CODE_ERROR' group by span_name",
    "k23_recent_error_rate": f"select service_name, round({ERRORS} * 100.0e0 / count(*), 4) as error_pct from traces where start_time >= {AS_OF - DAY} and start_time < {AS_OF} group by service_name having {ERRORS} > 0",
    "k24_slowest_endpoints": (
        "select service_name, span_name, round(percentile(duration_ms, 0.99), 6) as p99_ms from traces group by service_name, span_name order by p99_ms desc, service_name, span_name limit 10",
        "select service_name, span_name, round(quantile_cont(duration_ms, 0.99), 6) as p99_ms from traces group by service_name, span_name order by p99_ms desc, service_name, span_name limit 10",
    ),
    "k25_histogram_mean": "select metric_name, service_name, attributes, round(sum / nullif(count, 0), 6) as avg_ms, max as max_ms from metrics where metric_name = 'event.value' order by timestamp desc, attributes limit 20",
    "k26a_spans_by_status": "select service_name, status_code, count(*) as spans from traces group by service_name, status_code",
    "k26b_mean_and_p95": (
        "select service_name, round(avg(duration_ms), 4) as mean_ms, round(percentile(duration_ms, 0.95), 6) as p95_ms from traces group by service_name",
        "select service_name, round(avg(duration_ms), 4) as mean_ms, round(quantile_cont(duration_ms, 0.95), 6) as p95_ms from traces group by service_name",
    ),
}


def spark_text(name: str) -> str:
    text = COOKBOOK[name]
    return text if isinstance(text, str) else text[0]


def oracle_text(name: str) -> str:
    text = COOKBOOK[name]
    return oracle(text if isinstance(text, str) else text[1])
