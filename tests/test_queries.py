"""The registry: names, oracle coverage, and a sample of queries against the oracle."""

import duckdb
import pytest

from otelframe.plans import registry
from otelframe.sources.fixtures import TABLES

SF = "/root/testdata/sf0.001"
SOME = ["k02_error_rate_by_service", "p04_attr_not_equals", "a08c_mid_series_window", "a13b_histogram_p95_by_type", "t03_self_times", "t07_span_groups", "e01_exemplars", "c08_shares", "d07_distribution", "s14b_quarter_of_a_day", "s18b_layout"]


def test_every_query_has_an_oracle():
    assert set(registry.oracle_sql()) == set(registry.queries())


@pytest.mark.parametrize("name", SOME)
def test_equal_to_the_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = sorted(map(repr, found.fetchall()))
    df = registry.queries()[name](spark, SF)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert sorted(df.columns) == sorted(columns) and got == want
