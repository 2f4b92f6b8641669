"""Signals derived from business tables, so that the library runs on any such data.

Each order is a trace (one root span, one child per line item), each event a log
record and a gauge point; hourly sums of events are histogram points, cumulative with
a daily restart and, under another name, as deltas. The same SQL text serves Spark
and, with other function names, the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from otelframe.schemas import conform

TABLES = ("orders", "lineitem", "events")


def _sql(us: str, div: str) -> dict[str, str]:
    micros = us.format
    ten = lambda k: f"case {k} % 3 when 0 then 'acme' when 1 then 'globex' else 'initech' end"
    traces = f"""
with r as (
  select o_orderkey as k, lpad(lower(hex(o_orderkey)), 32, '0') as trace_id, {ten('o_custkey')} as tenant,
         {micros('o_orderdate')} + (o_orderkey % 86400) * 1000000 as st,
         cast(floor(o_totalprice) as bigint) * 10 as du, o_custkey, o_orderpriority, o_orderstatus
  from orders)
select trace_id, concat('r', k) as span_id, '' as parent_span_id, concat('svc-', o_custkey % 5) as service_name,
       o_orderpriority as span_name, 'SPAN_KIND_SERVER' as span_kind, st as start_time, st + du as end_time, du / 1000.0e0 as duration_ms,
       case o_orderstatus when 'F' then 'STATUS_CODE_ERROR' else 'STATUS_CODE_OK' end as status_code,
       case o_orderstatus when 'F' then concat('order ', k, ' failed') else '' end as status_message,
       concat('{{"http.route":"', o_orderpriority, '","cust":"', o_custkey, '"}}') as attributes,
       concat('{{"service.name":"svc-', o_custkey % 5, '","tenant.id":"', tenant, '"}}') as resource_attributes
from r
union all
select trace_id, concat('l', l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber), concat('r', k),
       concat('supplier-', l_suppkey % 7), concat('ship ', l_returnflag), 'SPAN_KIND_CLIENT', st + (l_partkey % 100) * 1000,
       st + (l_partkey % 100) * 1000 + cast(l_quantity as bigint) * 2000, cast(l_quantity as bigint) * 2.0e0,
       case l_returnflag when 'R' then 'STATUS_CODE_ERROR' else 'STATUS_CODE_OK' end,
       case l_returnflag when 'R' then 'returned' else '' end,
       concat('{{"line.status":"', l_linestatus, '","part":"', l_partkey, '"}}'),
       concat('{{"service.name":"supplier-', l_suppkey % 7, '","tenant.id":"', tenant, '"}}')
from lineitem join r on l_orderkey = k"""
    logs = f"""
select {micros('ts')} as timestamp, {micros('ts')} as observed_timestamp,
       case when event_id % 4 = 0 then '' else lpad(lower(hex(event_id % 1000)), 32, '0') end as trace_id,
       case when event_id % 4 = 0 then '' when event_id % 3 = 0 then concat('r', event_id % 1000) else concat('x', event_id) end as span_id,
       case event_type when 'error' then 17 when 'signup' then 13 else 9 end as severity_number,
       case event_type when 'error' then 'ERROR' when 'signup' then 'Warn' when 'view' then '' else 'INFO' end as severity_text,
       concat(event_type, ' by user ', user_id, ' value ', cast(cast(round(value * 100) as bigint) as varchar(20))) as body,
       props as attributes,
       concat('{{"service.name":"svc-', user_id % 5, '","tenant.id":"', {ten('user_id')}, '"}}') as resource_attributes,
       concat('svc-', user_id % 5) as service_name
from events"""
    hour, day = 3_600_000_000, 86_400_000_000
    metrics = f"""
with e as (
  select event_id, event_type, user_id, user_id % 3 as u, {micros('ts')} as t, value, props, cast(round(value * 100) as bigint) as v100 from events),
h as (
  select *, (t {div} {hour}) * {hour} as hr, (t {div} {day}) * {day} as dy from e),
top as (
  select *, row_number() over (partition by event_type, u, hr order by v100 desc, event_id desc) as place from h),
g as (
  select event_type, u, hr, dy, count(*) as c, cast(sum(v100) as bigint) as s100, min(value) as lo, max(value) as hi,
         cast(sum(case when value <= 10 then 1 else 0 end) as bigint) as b1,
         cast(sum(case when value > 10 and value <= 50 then 1 else 0 end) as bigint) as b2,
         cast(sum(case when value > 50 and value <= 100 then 1 else 0 end) as bigint) as b3,
         cast(sum(case when value > 100 then 1 else 0 end) as bigint) as b4,
         max(case when place = 1 then event_id end) as top_event, max(case when place = 1 then v100 end) as top_v100, max(case when place = 1 then t end) as top_t
  from top group by event_type, u, hr, dy),
run as (
  select *, cast(sum(c) over w as bigint) as rc, cast(sum(s100) over w as bigint) as rs, min(lo) over w as rlo, max(hi) over w as rhi,
         cast(sum(b1) over w as bigint) as r1, cast(sum(b2) over w as bigint) as r2, cast(sum(b3) over w as bigint) as r3, cast(sum(b4) over w as bigint) as r4
  from g window w as (partition by event_type, u, dy order by hr rows between unbounded preceding and current row)),
points as (
  select 'event.gauge' as metric_name, 'ms' as metric_unit, 'gauge' as metric_type, t as timestamp, 0 as start_timestamp, value as value_double,
         0 as count, 0.0e0 as sum, 0.0e0 as min, 0.0e0 as max, '' as bucket_counts, '' as explicit_bounds, props as attributes,
         user_id as owner, '' as exemplars, false as is_monotonic, '' as aggregation_temporality from e
  union all
  select 'event.requests', '1', 'sum', t, 0, 1.0e0, 0, 0.0e0, 0.0e0, 0.0e0, '', '',
         concat('{{"', case when event_id % 2 = 0 then 'http.response.status_code' else 'http.status_code' end, '":"',
                case event_type when 'error' then '503' when 'signup' then '404' when 'click' then 'none' else '200' end, '"}}'),
         user_id, '', true, 'AGGREGATION_TEMPORALITY_DELTA' from e
  union all
  select 'event.value', 'ms', 'histogram', hr + {hour}, dy, 0.0e0, rc, rs / 100.0e0, rlo, rhi, concat('[', r1, ',', r2, ',', r3, ',', r4, ']'), '[10,50,100]',
         concat('{{"event_type":"', event_type, '","u":"', u, '"}}'), u,
         concat('[{{"time_unix_nano":', top_t, '000,"trace_id":"', lpad(lower(hex(top_event % 1000)), 32, '0'), '","span_id":"r', top_event % 1000, '","value":', top_v100, '}}]'),
         false, 'AGGREGATION_TEMPORALITY_CUMULATIVE' from run
  union all
  select 'event.delta', 's', 'histogram', hr + {hour}, hr, 0.0e0, c, s100 / 100.0e0, lo, hi, concat('[', b1, ',', b2, ',', b3, ',', b4, ']'), '[10,50,100]',
         concat('{{"event_type":"', event_type, '","u":"', u, '"}}'), u, '', false, 'AGGREGATION_TEMPORALITY_DELTA' from g)
select metric_name, metric_unit, metric_type, timestamp, start_timestamp, value_double, count, sum, min, max, bucket_counts, explicit_bounds, attributes,
       concat('{{"host.name":"h', owner % 4, '","service.name":"svc-', owner % 5, '","tenant.id":"', {ten('owner')}, '"}}') as resource_attributes,
       concat('svc-', owner % 5) as service_name, exemplars, is_monotonic, aggregation_temporality
from points"""
    return {"traces": traces, "logs": logs, "metrics": metrics}


SPARK_SQL = _sql("unix_micros(cast({} as timestamp))", "div")
ORACLE_SQL = _sql("epoch_us({})", "//")


def signals(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """traces, logs and metrics with their full sets of columns."""
    from otelframe.sources.store import utc

    utc(spark)
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return {name: conform(spark.sql(text), name) for name, text in SPARK_SQL.items()}


def signal(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return signals(spark, sf_dir)[name]


def oracle(body: str) -> str:
    """``body`` over the views traces, logs and metrics (those it names), for the SQL
    oracle; a further CTE may start with ", name as (...)"."""
    used = [n for n in ORACLE_SQL if n in body]
    views = ", ".join(f"{n} as ({ORACLE_SQL[n]})" for n in used)
    return f"with {views}{'' if body.lstrip().startswith(',') else ' '}{body}"
