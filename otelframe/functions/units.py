"""Conversion of measured values to and from milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds in one unit; the micro sign exists as two characters.
MS_PER_UNIT = {"ms": 1.0, "s": 1000.0, "us": 0.001, "ns": 0.000001, "µs": 0.001, "μs": 0.001}


def unit_to_ms(unit: Column) -> Column:
    """Milliseconds in one unit, null for an unknown unit."""
    pairs = [x for k, v in MS_PER_UNIT.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.trim(F.coalesce(unit, F.lit(""))))


def to_ms(value: Column, unit: Column) -> Column:
    return F.try_multiply(value, unit_to_ms(unit))


def from_ms(ms: Column, unit: Column) -> Column:
    return F.try_divide(ms, unit_to_ms(unit))
