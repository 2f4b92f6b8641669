"""Attribute access and filters on JSON text columns."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

TENANT_KEY = "tenant.id"
#: Filter keys of spans that name a column instead of an attribute.
SPAN_COLUMNS = ("span_name", "status_code", "span_kind")
#: Metric columns that results may be grouped by.
GROUP_COLUMNS = ("service_name", "metric_name", "metric_type", "metric_unit", "scope_name", "scope_version", "aggregation_temporality")
_KEY = re.compile(r"^[A-Za-z0-9_.\-/]+$")


class AttrFilter(NamedTuple):
    key: str
    value: str
    op: str = "="


def attr(column: str, key: str) -> Column:
    """Text of one attribute; the key, dots included, is taken literally. Null where
    the key is missing or the JSON is malformed."""
    if "'" in key or "\\" in key:
        return F.from_json(F.col(column), "map<string,string>").getItem(key)
    return F.get_json_object(F.col(column), f"$['{key}']")


def tenant_is(tenant: str) -> Column:
    """Isolation predicate; a blank tenant is an input error."""
    if not tenant or not tenant.strip():
        raise ValueError("tenant is required")
    return attr("resource_attributes", TENANT_KEY) == tenant


def attr_condition(f: AttrFilter) -> Column:
    """Record or resource scope. ``!=`` keeps rows without the key; ``!= ''`` keeps rows
    that have the key, non-empty, in either scope."""
    if not f.key:
        raise ValueError("filter key is required")
    a, r = attr("attributes", f.key), attr("resource_attributes", f.key)
    if f.op == "=":
        return (a == f.value) | (r == f.value)
    if f.op == "!=":
        a, r = F.coalesce(a, F.lit("")) != f.value, F.coalesce(r, F.lit("")) != f.value
        return (a | r) if f.value == "" else (a & r)
    raise ValueError(f"filter operator {f.op!r} is not supported")


def span_condition(f: AttrFilter) -> Column:
    """As ``attr_condition``, but reserved keys name span columns."""
    if f.key not in SPAN_COLUMNS:
        return attr_condition(f)
    if f.op == "=":
        return F.col(f.key) == f.value
    if f.op == "!=":
        return F.col(f.key) != f.value
    raise ValueError(f"filter operator {f.op!r} is not supported")


def group_key(name: str) -> Column:
    """A grouping column under the caller's spelling: an allowed column, or a data
    point or resource attribute by prefix."""
    for prefix, column in (("attr.", "attributes"), ("attributes.", "attributes"), ("resource.", "resource_attributes"), ("resource_attributes.", "resource_attributes")):
        if name.startswith(prefix):
            key = name[len(prefix) :]
            if not _KEY.match(key):
                raise ValueError(f"group_by {name!r} is not a groupable column")
            return attr(column, key).alias(name)
    if name == "service.name":
        return F.col("service_name").alias(name)
    if name in GROUP_COLUMNS:
        return F.col(name)
    raise ValueError(f"group_by {name!r} is not a groupable column; allowed columns: {', '.join(GROUP_COLUMNS)}")


def group_keys(spec: str | list[str] | None) -> list[str]:
    """Names of a comma-separated list, without blanks and repeats."""
    names = spec.split(",") if isinstance(spec, str) else list(spec or [])
    return list(dict.fromkeys(n.strip() for n in names if n.strip()))


def finite(column: Column) -> Column:
    """Null for NaN and infinities, as results are written."""
    return F.when(F.isnan(column) | (F.abs(column) == float("inf")), F.lit(None)).otherwise(column)


def stored(column: Column) -> Column:
    """0 for NaN and infinities, as points are stored."""
    return F.when(F.isnan(column) | (F.abs(column) == float("inf")), F.lit(0.0)).otherwise(column)


def finite_columns(df):
    """Every double column without NaN and infinities."""
    return df.select(*[finite(F.col(f"`{n}`")).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])
