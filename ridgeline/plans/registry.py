"""Named queries with their SQL: a query is (spark, sf_dir) -> DataFrame; its SQL gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The bindings of sources/bindings.py as common table expressions.
BASE = """
with recursive alldeals as (
  select l_suppkey as complex_id, cast(ceil(l_quantity / 10) as int) as type_id, cast(round(l_extendedprice) as int) as amount,
         cast(round(cast(round(l_extendedprice) as int) / l_quantity) as int) as pyeong, strftime(l_shipdate, '%Y%m') as month,
         cast(l_shipdate as date) as deal_date, l_orderkey as order_id, cast(l_linenumber as int) as line_no, l_quantity as m2,
         coalesce(l_returnflag = 'R', false) as cancelled from lineitem),
deals as (select * exclude (cancelled) from alldeals where not cancelled and m2 > 0 and amount is not null),
complexes as (
  select s_suppkey as complex_id, s_name as name, cast(floor(s_acctbal) as int) as households, cast(n_nationkey as int) as sigungu_key,
         n_name as sigungu_name, cast(r_regionkey as int) as sido_key, r_name as sido_name, cast(n_nationkey * 10 + s_suppkey % 3 as int) as dong_key,
         37.0::double + (s_suppkey * 7919 % 1000) / 10000::double as lat, 127.0::double + (s_suppkey * 104729 % 1000) / 10000::double as lng
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
monthly as (
  select complex_id, type_id, month, cast(round(avg(amount)) as int) as price, min(amount) as low, max(amount) as high,
         cast(round(avg(pyeong)) as int) as pyeong, count(*) as deals from deals group by all),
quotes as (
  select cast(c_nationkey as int) as region, c_mktsegment as name, o_orderpriority as type_id, strftime(o_orderdate, '%Y%m') as month,
         cast(floor(avg(cast(floor(o_totalprice) as bigint)) + 0.5) as int) as price from orders join customer on o_custkey = c_custkey group by all),
ev as (select event_id, ts, user_id as visitor_id, event_type as event_name, value, cast(json_extract_string(props, '$.k') as int) as k from events),
ends as (
  select complex_id, type_id, arg_max(month, month) filter (month <= '199606') as start_month, arg_max(price, month) filter (month <= '199606') as start_price,
         arg_max(pyeong, month) filter (month <= '199606') as start_pyeong, arg_max(month, month) filter (month <= '200006') as end_month,
         arg_max(price, month) filter (month <= '200006') as end_price, arg_max(pyeong, month) filter (month <= '200006') as end_pyeong
  from monthly where month <= '200006' group by all),
growing as (
  select complex_id, avg(start_pyeong) as start_pyeong, avg(end_pyeong) as end_pyeong, count(*) as types from ends
  where start_pyeong is not null group by all),
items as (
  select c.*, cast(types as int) as types, cast(floor(start_pyeong + 0.5) as int) as start_pyeong, cast(floor(end_pyeong + 0.5) as int) as end_pyeong,
         round(end_pyeong / start_pyeong - 1, 6) as growth_rate, cast(floor(end_pyeong - start_pyeong + 0.5) as int) as growth_amount
  from growing join complexes c using (complex_id))
"""

#: More bindings, named by the queries that use them.
MORE = {
    "apts": """apts as (select c_custkey as apt_id, c_name as name, cast(floor(c_acctbal) as int) as households, cast(c_nationkey as int) as region,
      case when c_custkey % 11 = 0 then '' else ['11', '26', '41', '45', '50', '99'][c_custkey % 6 + 1] || lpad(cast(c_nationkey as varchar), 3, '0') || lpad(cast(c_custkey % 9 as varchar), 3, '0') || '00' end as legal_code,
      ['서울특별시', '부산광역시', '경기', '전북특별자치도', '제주', '경북'][c_custkey % 6 + 1] || ' ' || ['강남구', '수원시 팔달구', '화성시', '가평군', '읍내 가곡면'][c_custkey % 5 + 1] || ' ' || ['역삼동', '반송동', '', '석우동'][c_custkey % 4 + 1] || ' ' || (c_custkey % 50 + 1) || '-' || (c_custkey % 3) as address,
      ['역삼동', '반송동', '', '석우동'][c_custkey % 4 + 1] as dong, (c_custkey % 50 + 1) || '-' || (c_custkey % 3) as jibun,
      case when c_custkey % 13 <> 0 then 37.0::double + (c_custkey * 7919 % 1000) / 10000::double end as lat,
      case when c_custkey % 13 <> 0 then 127.0::double + (c_custkey * 104729 % 1000) / 10000::double end as lng from customer)""",
    "jobs": """jobs as (select o_orderkey as job_id, cast(o_custkey % 25 as int) as region, case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'requested' end as status,
      cast(o_orderpriority[1:1] as int) as years_back, o_orderdate as created_at, cast(floor(o_totalprice) as bigint) as total from orders)""",
    "queue": """queue as (select l_orderkey as job_id, cast(l_linenumber as int) as item, l_partkey as source_id, case l_returnflag when 'R' then 'failed' when 'A' then 'completed' else 'pending' end as status,
      l_shipdate as updated_at, case when l_partkey % 3 = 0 then '' else 'dong' || (l_partkey % 7) end as dong, cast(l_quantity as int) as pyeong from lineitem)""",
    "heads": """heads as (select *, case when snapshot_id % 2 = 0 then 'start' else 'end' end as basis, [3, 6, 12, 36, 60][snapshot_id % 5 + 1] as period_months,
      case when snapshot_id % 7 = 0 then 'building' when snapshot_id % 5 = 0 then 'superseded' else 'active' end as status from (
      select o_orderpriority as source, strftime(o_orderdate, '%Y%m') as end_month, cast(count(*) as bigint) as item_count, cast(count(distinct o_custkey % 10) as bigint) as band_count,
      max(o_orderdate) as updated_at, max(o_orderkey) as snapshot_id from orders group by 1, 2))""",
}


def more(names: str, select: str) -> str:
    """SQL over further bindings: `select` may go on with expressions of its own before its select."""
    parts = ", ".join(MORE[n] for n in names.split())
    return f"with {parts}, {select[5:]}" if select.startswith("with ") else f"with {parts} {select}"


def query(name: str, sql: str | None = None, base: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = (BASE if base else "") + (", " + sql[5:] if base and sql.startswith("with ") else sql)
        return f

    return add
