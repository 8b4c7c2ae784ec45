"""Whole plans, bound to the driver's tables and compiled."""

from __future__ import annotations

from gristmill.catalog import Catalog
from gristmill.plans.compiler import compile_plan
from gristmill.queries import query, table


def catalog(spark, sf, *names: str) -> Catalog:
    out = Catalog(spark)
    for name in names:
        out.add(name, table(spark, sf, name))
    return out


@query(
    """
WITH g AS (SELECT c_mktsegment, sum(o_totalprice) AS total, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  WHERE year(o_orderdate) = 1997 AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1)
SELECT c_mktsegment, round(total, 2) AS total, n, round_even(100 * total / nullif(sum(total) OVER (), 0), 2) AS share FROM g
"""
)
def plan_flagship(spark, sf):
    """Join over a verified key, filters on both sides, groups, a share, sorted and limited."""
    from pyspark.sql import functions as F

    tables = catalog(spark, sf, "orders", "customer")
    tables.discover_links({"orders": ["o_custkey"], "customer": ["c_custkey"]})
    plan = {
        "table": "orders",
        "join": {"right_table": "customer", "left_column": "o_custkey", "right_column": "c_custkey"},
        "filters": [{"column": "o_orderdate", "op": "eq", "value": 1997}, {"column": "mktsegment", "op": "in", "value": ["building", "Machinery", "no such"]}],
        "group_by": ["c_mktsegment"],
        "aggregations": [{"fn": "sum", "column": "o_totalprice", "alias": "total"}, {"fn": "count", "alias": "n"}],
        "derived": [{"alias": "share", "kind": "pct_of_total", "num": "total"}],
        "sort": {"by": "total", "desc": True},
        "limit": 10,
    }
    return compile_plan(plan, tables).df.withColumn("total", F.round("total", 2))


@query("SELECT DISTINCT n_name, n_regionkey FROM nation WHERE n_nationkey BETWEEN 5 AND 12")
def plan_listing(spark, sf):
    plan = {"table": "nation", "filters": [{"column": "n_nationkey", "op": "between", "value": [5, 12]}], "select": ["n_name", "regionkey"], "sort": {"by": "n_nationkey", "desc": False}}
    return compile_plan(plan, catalog(spark, sf, "nation")).df


@query(
    """
SELECT "SOURCE", count(*) AS n, round(sum(acctbal), 2) AS total
FROM (SELECT 'customer' AS "SOURCE", c_acctbal AS acctbal FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY 1
"""
)
def plan_union(spark, sf):
    from pyspark.sql import functions as F

    tables = Catalog(spark)
    for name in ("customer", "supplier"):
        df = table(spark, sf, name)
        tables.add(name, df.select(F.col(f"{name[0]}_name").alias("name"), F.col(f"{name[0]}_nationkey").alias("nation"), F.col(f"{name[0]}_acctbal").alias("acctbal")))
    plan = {"table": "customer", "union": ["supplier"], "group_by": ["SOURCE"], "aggregations": [{"fn": "count", "alias": "n"}, {"fn": "sum", "column": "acctbal", "alias": "total"}]}
    return compile_plan(plan, tables).df.withColumn("total", F.round("total", 2))
