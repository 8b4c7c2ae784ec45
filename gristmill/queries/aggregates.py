"""Aggregations, reports, charts, sorts, unions, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.columns import ROW_ID, qcol
from gristmill.operators import aggregates as A
from gristmill.operators import ordering as O
from gristmill.operators import profiling as R
from gristmill.queries import query, table

M = A.Measure


def rounded(df, *names, places=2):
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


@query(
    """
SELECT l_returnflag, nullif(l_linestatus, 'F') AS status, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 4) AS mean, round(median(l_quantity), 2) AS middle,
  min(l_shipdate) AS first, max(l_quantity) AS most, count(*) AS n, count(nullif(l_quantity, 1)) AS filled, count(DISTINCT l_suppkey) AS suppliers
FROM lineitem GROUP BY ALL
"""
)
def group_agg_all_fns(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns({"status": F.nullif("l_linestatus", F.lit("F")), "q": F.nullif("l_quantity", F.lit(1.0))})
    measures = [M("sum", "l_extendedprice", "total"), M("mean", "l_quantity", "mean"), M("median", "l_quantity", "middle"), M("min", "l_shipdate", "first"), M("max", "l_quantity", "most"), M("count", None, "n"), M("count", "q", "filled"), M("nunique", "l_suppkey", "suppliers")]
    return rounded(rounded(A.aggregate(rows, ["l_returnflag", "status"], measures), "total", "middle"), "mean", places=4)


@query("SELECT round(sum(o_totalprice), 2) AS total, count(*) AS n, count(DISTINCT o_custkey) AS customers, max(o_orderdate) AS last FROM orders")
def global_agg(spark, sf):
    return rounded(A.aggregate(table(spark, sf, "orders"), [], [M("sum", "o_totalprice", "total"), M("count", None, "n"), M("nunique", "o_custkey", "customers"), M("max", "o_orderdate", "last")]), "total")


OPEN = "SELECT o_orderstatus, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS v FROM orders"


def open_orders(spark, sf):
    """Orders of which one whole group has no value."""
    return table(spark, sf, "orders").select("o_orderstatus", F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("v"))


@query(f"SELECT o_orderstatus, round(coalesce(sum(v), 0), 2) AS total FROM ({OPEN}) GROUP BY 1")
def agg_sum(spark, sf):
    return rounded(A.aggregate(open_orders(spark, sf), ["o_orderstatus"], [M("sum", "v", "total")]), "total")


@query(f"SELECT o_orderstatus, round(avg(v), 4) AS mean FROM ({OPEN}) GROUP BY 1")
def agg_mean(spark, sf):
    return rounded(A.aggregate(open_orders(spark, sf), ["o_orderstatus"], [M("mean", "v", "mean")]), "mean", places=4)


@query(f"SELECT o_orderstatus, round(median(v), 4) AS middle FROM ({OPEN}) GROUP BY 1")
def agg_median(spark, sf):
    return rounded(A.aggregate(open_orders(spark, sf), ["o_orderstatus"], [M("median", "v", "middle")]), "middle", places=4)


@query(f"SELECT o_orderstatus, min(v) AS least, max(v) AS most FROM ({OPEN}) GROUP BY 1")
def agg_min_max(spark, sf):
    return A.aggregate(open_orders(spark, sf), ["o_orderstatus"], [M("min", "v", "least"), M("max", "v", "most")])


@query(f"SELECT o_orderstatus, count(*) AS n, count(v) AS filled FROM ({OPEN}) GROUP BY 1")
def agg_count(spark, sf):
    return A.aggregate(open_orders(spark, sf), ["o_orderstatus"], [M("count", None, "n"), M("count", "v", "filled")])


@query("SELECT o_orderpriority, count(DISTINCT nullif(o_custkey, 1)) AS customers FROM orders GROUP BY 1")
def agg_nunique(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderpriority", F.nullif("o_custkey", F.lit(1)).alias("k"))
    return A.aggregate(rows, ["o_orderpriority"], [M("nunique", "k", "customers")])


@query("SELECT s_nationkey, round(coalesce(sum(CASE WHEN s_suppkey % 5 <> 0 THEN round(s_acctbal, 2) END), 0), 2) AS total FROM supplier GROUP BY 1")
def agg_coerced_text(spark, sf):
    text = F.when(F.col("s_suppkey") % 5 == 0, "n/a").otherwise(F.round("s_acctbal", 2).cast("string"))
    rows = table(spark, sf, "supplier").select("s_nationkey", text.alias("amount"))
    return rounded(A.aggregate(rows, ["s_nationkey"], [M("sum", "amount", "total", coerce=True)]), "total")


@query("SELECT nullif(l_returnflag, 'N') AS flag, round(sum(l_extendedprice), 2) AS total, count(l_extendedprice) AS rows FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def report_sum_count(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.nullif("l_returnflag", F.lit("N")).alias("flag"), "l_extendedprice")
    return rounded(A.report_sum_count(rows, "flag", "l_extendedprice"), "total")


@query("SELECT p_brand AS label, round(sum(p_retailprice), 2) AS value FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, 1 LIMIT 8")
def chart_topk(spark, sf):
    return rounded(A.chart_topk(table(spark, sf, "part"), "p_brand", "p_retailprice"), "value")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem GROUP BY ALL")
def chart_group_hue(spark, sf):
    return rounded(A.chart_groups(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", "l_linestatus"), "l_extendedprice")


@query(
    """
WITH s AS (SELECT c_nationkey::VARCHAR AS label, sum(c_acctbal) AS value FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS r FROM s)
SELECT CASE WHEN r <= 5 THEN label ELSE 'Other' END AS label, round(sum(value), 2) AS value FROM r GROUP BY 1
"""
)
def topn_other(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("n"), "c_acctbal")
    return rounded(A.topn_other(rows, "n", "c_acctbal", 5), "value")


@query(
    """
SELECT l_returnflag, round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0), 2) AS "F", round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0), 2) AS "O" FROM lineitem GROUP BY 1
"""
)
def pivot_sum(spark, sf):
    return rounded(A.pivot_sum(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", ["F", "O"]), "F", "O")


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round_even(avg({c}), 2) AS mean, round_even(stddev_samp({c}), 2) AS std, round_even(min({c}), 2) AS min, "
        f"round_even(quantile_cont({c}, 0.25), 2) AS q25, round_even(median({c}), 2) AS median, round_even(quantile_cont({c}, 0.75), 2) AS q75, round_even(max({c}), 2) AS max FROM lineitem"
        for c in NUMBERS
    )
)
def describe_numeric(spark, sf):
    return A.describe_numeric(table(spark, sf, "lineitem").select(*NUMBERS))


@query("SELECT p_type, round(sum(p_retailprice), 2) AS p_retailprice FROM part WHERE p_brand = 'Brand#11' GROUP BY 1")
def sum_by_type(spark, sf):
    return rounded(A.sum_by_type(table(spark, sf, "part"), "p_type", "p_retailprice", "Brand#11", "p_brand"), "p_retailprice")


@query(
    """
SELECT o_orderpriority, round(sum(o_totalprice * CASE WHEN o_orderstatus = 'F' THEN 1.5 ELSE 1 END), 2) AS o_totalprice, t AS "TABLE"
FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS t FROM orders)
WHERE o_custkey = 11 AND o_orderdate <= TIMESTAMP '1999-01-01' AND (o_orderdate + INTERVAL 900 DAY >= TIMESTAMP '1999-01-01') GROUP BY ALL
"""
)
def funds_by_type(spark, sf):
    rows = table(spark, sf, "orders").withColumn("e", F.col("o_orderdate") + F.expr("INTERVAL 900 DAY"))
    tables = {"even": rows.where("o_orderkey % 2 = 0"), "odd": rows.where("o_orderkey % 2 <> 0")}
    return rounded(A.funds_by_type(tables, 11, "1999-01-01", {"F": 1.5}, "o_custkey", "o_orderpriority", "o_totalprice", "o_orderstatus", "o_orderdate", "e"), "o_totalprice")


@query("SELECT 'lineitem' AS \"table\", 'l_extendedprice' AS \"column\", round(sum(l_extendedprice), 2) AS total FROM lineitem")
def headline_amount(spark, sf):
    tables = {"lineitem": (table(spark, sf, "lineitem"), "l_extendedprice"), "customer": (table(spark, sf, "customer"), "c_acctbal"), "supplier": (table(spark, sf, "supplier"), "s_acctbal")}
    return rounded(A.headline_amount(tables), "total")


STAR = {"customer": 5, "lineitem": 11, "nation": 3, "orders": 6, "part": 6, "region": 2, "supplier": 4}


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows, {n} AS columns FROM {t}" for t, n in STAR.items()))
def inventory(spark, sf):
    return A.inventory({t: table(spark, sf, t) for t in STAR})


@query("SELECT count(DISTINCT p_brand) AS distinct_p_brand, count(DISTINCT p_type) AS distinct_p_type, round(sum(abs(p_retailprice)), 2) AS abs_p_retailprice, sum(abs(p_size))::DOUBLE AS abs_p_size FROM part")
def chart_spec_stats(spark, sf):
    return rounded(A.chart_spec_stats(table(spark, sf, "part"), ["p_brand", "p_type"], ["p_retailprice", "p_size"]), "abs_p_retailprice")


@query("SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def value_counts_topk(spark, sf):
    return A.value_counts_topk(table(spark, sf, "part"), "p_brand")


@query("SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL")
def collapse_duplicates(spark, sf):
    return A.collapse_duplicates(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus"))


@query("SELECT 'unit' AS \"column\", 'EUR' AS value UNION ALL SELECT 'empty', NULL")
def constant_columns(spark, sf):
    return A.constant_columns(table(spark, sf, "supplier").select("s_suppkey", "s_name", F.lit("EUR").alias("unit"), F.lit(None).cast("string").alias("empty")))


PROFILED = (("o_orderkey", "number"), ("o_totalprice", "number"), ("o_orderpriority", "text"), ("year", "number"))
YEARED = "SELECT o_orderkey, o_totalprice, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, year(o_orderdate) AS year FROM orders"


def profiled(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"), F.year("o_orderdate").alias("year"))


PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", round((count(*) - count({c})) / count(*), 4) AS null_rate, "
    f"round(count(DISTINCT {c}) / count({c}), 4) AS unique_ratio, min({c})::VARCHAR AS least, max({c})::VARCHAR AS most, round(count(try_cast({c} AS DOUBLE)) / count({c}), 4) AS numeric_rate, "
    f"round(count(*) FILTER (try_cast({c} AS DOUBLE) = floor(try_cast({c} AS DOUBLE)) AND try_cast({c} AS DOUBLE) BETWEEN 1900 AND 2100) / nullif(count(try_cast({c} AS DOUBLE)), 0), 4) AS year_share, count(*) AS rows FROM o"
    for c, k in PROFILED
)


@query(f"WITH o AS ({YEARED}) {PROFILE}")
def profile_columns(spark, sf):
    return R.profile_columns(profiled(spark, sf))


@query("SELECT * FROM (VALUES ('o_orderkey', false), ('o_totalprice', false), ('o_orderpriority', false), ('year', true)) AS t(\"column\", year_like)")
def year_like(spark, sf):
    return R.year_like(R.profile_columns(profiled(spark, sf)))


@query(
    """
SELECT 'l_orderkey' AS key, count(*) AS rows, count(DISTINCT l_orderkey) AS "distinct", round(count(DISTINCT l_orderkey) / count(*), 4) AS ratio FROM lineitem
UNION ALL SELECT 'l_orderkey+l_linenumber', count(*), count(DISTINCT (l_orderkey, l_linenumber)), round(count(DISTINCT (l_orderkey, l_linenumber)) / count(*), 4) FROM lineitem
"""
)
def key_uniqueness(spark, sf):
    return R.key_uniqueness(table(spark, sf, "lineitem"), [["l_orderkey"], ["l_orderkey", "l_linenumber"]])


@query("SELECT o_orderkey, nullif(o_totalprice, 0) AS o_totalprice FROM orders")
def sort_desc_nulls_last(spark, sf):
    return O.sort_rows(table(spark, sf, "orders").select("o_orderkey", F.nullif("o_totalprice", F.lit(0.0)).alias("o_totalprice")), "o_totalprice")


@query("SELECT DISTINCT o_custkey FROM orders")
def sort_unselected_distinct(spark, sf):
    rows = table(spark, sf, "orders").withColumn(ROW_ID, F.col("o_orderkey"))
    return O.distinct_listing(rows, ["o_custkey"], "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def topk(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderkey").alias(ROW_ID))
    return O.top_rows(rows, "o_totalprice", 10).drop(ROW_ID)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 200")
def head_overview(spark, sf):
    place = F.struct("l_orderkey", "l_linenumber")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", place.alias(ROW_ID))
    return O.head(rows, 200).drop(ROW_ID)


@query(
    """
SELECT c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment, 'customer' AS "SOURCE" FROM customer
UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier
"""
)
def union_tagged(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("Name"), F.col("s_nationkey").alias("NATION KEY"), F.col("s_acctbal").alias("acct_bal"))
    return O.union_tagged({"customer": c, "supplier": s})


@query(
    """
WITH w AS (SELECT o_custkey, sum(o_totalprice) FILTER (year(o_orderdate) = 1996) AS a, sum(o_totalprice) FILTER (year(o_orderdate) = 1997) AS b FROM orders GROUP BY 1)
SELECT o_custkey, 1996 AS "YEAR", 'total' AS "MEASURE", round(a, 2) AS "VALUE" FROM w UNION ALL SELECT o_custkey, 1997, 'total', round(b, 2) FROM w
"""
)
def unpivot_years(spark, sf):
    year = lambda y: F.sum(F.when((F.col("o_orderdate") >= f"{y}-01-01") & (F.col("o_orderdate") < f"{y + 1}-01-01"), F.col("o_totalprice"))).alias(f"{y} total")
    wide = table(spark, sf, "orders").groupBy("o_custkey").agg(year(1996), year(1997))
    return rounded(O.unpivot_years(wide), "VALUE")


@query(
    """
SELECT count(*) AS "1_source", count(*) FILTER (o_orderstatus = 'F') AS "2_filters", count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS "3_groups" FROM orders
"""
)
def provenance_counts(spark, sf):
    orders = table(spark, sf, "orders")
    kept = orders.where(F.col("o_orderstatus") == "F")
    grouped = kept.groupBy(qcol("o_custkey")).count()
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return orders.agg(F.count(F.lit(1)).alias("1_source")).select("1_source", count(kept).alias("2_filters"), count(grouped).alias("3_groups"))
