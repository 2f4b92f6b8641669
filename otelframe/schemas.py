"""The three signal tables. Absent values are empty strings or 0, times are Unix
microseconds, nested values are JSON text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

def _schema(ddl: str) -> StructType:
    kinds = {"string": StringType(), "bigint": LongType(), "double": DoubleType(), "int": IntegerType(), "boolean": BooleanType()}
    return StructType([StructField(n, kinds[k]) for n, k in (p.split() for p in ddl.split(","))])


SPAN_SCHEMA = _schema(
    "trace_id string, span_id string, parent_span_id string, trace_state string, service_name string, span_name string, span_kind string, "
    "start_time bigint, end_time bigint, duration_ms double, status_code string, status_message string, attributes string, "
    "resource_attributes string, scope_name string, scope_version string, events string, links string"
)
LOG_SCHEMA = _schema(
    "timestamp bigint, observed_timestamp bigint, trace_id string, span_id string, severity_number int, severity_text string, body string, "
    "attributes string, resource_attributes string, service_name string, scope_name string, scope_version string, flags bigint, event_name string"
)
METRIC_SCHEMA = _schema(
    "metric_name string, metric_description string, metric_unit string, metric_type string, timestamp bigint, start_timestamp bigint, "
    "value_double double, value_int bigint, count bigint, sum double, min double, max double, bucket_counts string, explicit_bounds string, "
    "quantile_values string, attributes string, resource_attributes string, service_name string, scope_name string, scope_version string, "
    "exemplars string, flags bigint, is_monotonic boolean, aggregation_temporality string"
)
SCHEMAS = {"traces": SPAN_SCHEMA, "logs": LOG_SCHEMA, "metrics": METRIC_SCHEMA}
TIME_COLUMN = {"traces": "start_time", "logs": "timestamp", "metrics": "timestamp"}
#: Sort order inside a compacted file.
SORT_KEYS = {"traces": ["trace_id", "start_time"], "logs": ["service_name", "timestamp"], "metrics": ["metric_name", "timestamp"]}


def conform(df: DataFrame, signal: str, also: Sequence[str] = ()) -> DataFrame:
    """``df`` with exactly the signal's columns, and those in ``also`` as they are; missing
    ones and nulls become the absent value of their type."""
    out = [F.col(c) for c in also]
    for f in SCHEMAS[signal].fields:
        kind = f.dataType.simpleString()
        absent = F.lit("" if kind == "string" else False if kind == "boolean" else 0).cast(f.dataType)
        out.append((F.coalesce(F.col(f.name).cast(f.dataType), absent) if f.name in df.columns else absent).alias(f.name))
    return df.select(*out)
