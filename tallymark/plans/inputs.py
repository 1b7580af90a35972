"""Domain tables derived from the driver tables.

The projections are plain SQL expressions that both engines read the same way,
so the statements in the plans can reuse them for their ``WITH`` clauses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymark.plans.registry import table

DOCKET_CORE = {
    "id": "cast(o_orderkey as string)",
    "ord": "o_orderkey",
    "product_name": "concat('Product ', cast(o_orderkey % 97 as string))",
    "brand": "concat('Brand#', cast(o_custkey % 25 as string))",
    "barcode": "case when o_orderkey % 3 = 0 then '' else concat('890', lpad(cast(o_orderkey % 89 as string), 10, '0')) end",
    "officer_name": "concat('Officer ', cast(o_custkey % 7 as string))",
    "inspection_type": "case when o_orderpriority = '1-URGENT' then 'Port of Entry Inward' else 'Routine Audit' end",
    "overall_status": "case o_orderstatus when 'F' then 'COMPLIANT' when 'O' then 'NON_COMPLIANT' else 'NEEDS_REVIEW' end",
    "status": "case o_orderstatus when 'F' then 'Compliant' when 'O' then 'Non-Compliant' else 'Under Review' end",
    "compliance_score": "cast(cast(floor(o_totalprice) as bigint) % 101 as int)",
    "created_at": "o_orderdate",
}
DOCKET_PARTY = {
    "manufacturer": "c_name",
    "category": "case when o_orderkey % 11 = 0 then '' else c_mktsegment end",
    "zone": "case when n_nationkey = 24 then '' else n_name end",
}
DOCKET_COUNT = {"violation_count": "coalesce(vc, 0)"}

VIOLATION = {
    "violation_id": "concat('V-', cast(l_orderkey as string), '-', cast(l_linenumber as string))",
    "case_id": "cast(l_orderkey as string)",
    "rule_reference": "case l_linenumber % 4 when 0 then 'Rule 6(1)(e)' when 1 then 'Rule 6(1)(c)' when 2 then 'Rule 13' else '' end",
    "violation_type": "case when l_discount > 0.07 then 'Missing tax phrase' when l_discount > 0.03 then 'Prohibited unit' else 'Incomplete address' end",
    "severity": "case when l_quantity > 35 then 'High' when l_quantity > 15 then 'Medium' else 'Low' end",
}


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{expr} as {name}" for name, expr in columns.items()]


def dockets(spark: SparkSession, data_dir: str, parties: bool = False, counts: bool = False) -> DataFrame:
    """Orders read as inspection dockets; joins are added only when asked for."""
    df = table(spark, data_dir, "orders")
    columns = dict(DOCKET_CORE)
    if counts:
        per_case = (table(spark, data_dir, "lineitem")
                    .groupBy("l_orderkey").count().withColumnRenamed("count", "vc"))
        df = df.join(per_case, df.o_orderkey == per_case.l_orderkey, "left")
        columns |= DOCKET_COUNT
    if parties:
        customer = table(spark, data_dir, "customer")
        nation = table(spark, data_dir, "nation")
        df = df.join(customer, df.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
        columns |= DOCKET_PARTY
    return df.selectExpr(*_select(columns))


def violations(spark: SparkSession, data_dir: str) -> DataFrame:
    return table(spark, data_dir, "lineitem").selectExpr(*_select(VIOLATION))


def _sql_list(columns: dict[str, str]) -> str:
    return ", ".join(_select(columns))


WITH_DOCKETS = f"""with dockets as (
  select {_sql_list({**DOCKET_CORE, **DOCKET_COUNT, **DOCKET_PARTY})}
  from orders
  left join (select l_orderkey, count(*) as vc from lineitem group by l_orderkey) q on q.l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey),
violations as (select {_sql_list(VIOLATION)} from lineitem)
"""
