"""Filters and projections. The tables have no missing values, so queries make some."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.columns import qcol
from gristmill.operators import aggregates as A
from gristmill.operators import filters as P
from gristmill.operators.ordering import distinct_listing
from gristmill.operators.profiling import key_uniqueness
from gristmill.queries import query, table

PRIORITY = "SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS p FROM orders"
ENDED = "SELECT o_orderkey, o_orderdate AS s, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + INTERVAL 90 DAY END AS e FROM orders"


def priorities(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))


def quantities(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(1.0)).alias("q"))


QUANTITY = "SELECT l_orderkey, l_linenumber, nullif(l_quantity, 1) AS q FROM lineitem"


@query(f"SELECT * FROM ({PRIORITY}) WHERE p = '1-URGENT'")
def filter_eq_text(spark, sf):
    return priorities(spark, sf).where(P.text_in(qcol("p"), [" 1-URGENT "]))


@query(f"SELECT * FROM ({PRIORITY}) WHERE p IS DISTINCT FROM '1-URGENT'")
def filter_ne_text(spark, sf):
    return priorities(spark, sf).where(P.text_not_in(qcol("p"), ["1-URGENT"]))


@query(f"SELECT * FROM ({PRIORITY}) WHERE p IN ('1-URGENT', '2-HIGH')")
def filter_in_text(spark, sf):
    return priorities(spark, sf).where(P.text_in(qcol("p"), ["1-URGENT", "2-HIGH"]))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget')")
def filter_contains(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name").where(P.contains(qcol("p_name"), "WIDGET"))


@query(f"SELECT * FROM ({QUANTITY}) WHERE q >= 45")
def filter_cmp_num(spark, sf):
    return quantities(spark, sf).where(P.compare_number(qcol("q"), "ge", 45))


@query(f"SELECT * FROM ({QUANTITY}) WHERE q IS DISTINCT FROM 2")
def filter_ne_num(spark, sf):
    return quantities(spark, sf).where(P.compare_number(qcol("q"), "ne", 2))


@query(f"SELECT * FROM ({QUANTITY}) WHERE q IN (3, 7)")
def filter_in_num(spark, sf):
    return quantities(spark, sf).where(P.number_in(qcol("q"), [3, 7]))


@query(f"SELECT * FROM ({QUANTITY}) WHERE q BETWEEN 10 AND 12")
def filter_between_num(spark, sf):
    return quantities(spark, sf).where(P.number_between(qcol("q"), 10, 12))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1997")
def filter_year(spark, sf):
    return table(spark, sf, "orders").where(P.in_year(qcol("o_orderdate"), 1997)).select("o_orderkey", "o_totalprice")


@query(f"SELECT o_orderkey FROM ({ENDED}) WHERE e IS DISTINCT FROM TIMESTAMP '1998-01-01'")
def filter_date_cmp(spark, sf):
    return ended(spark, sf).where(P.compare_date(qcol("e"), "ne", "1998-01-01")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-05-31'")
def filter_date_between(spark, sf):
    return table(spark, sf, "orders").where(P.date_between(qcol("o_orderdate"), "1996-03-01", "1996-05-31")).select("o_orderkey")


def ended(spark, sf):
    end = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("INTERVAL 90 DAY"))
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("s"), end.alias("e"))


@query(f"SELECT o_orderkey FROM ({ENDED}) WHERE s <= TIMESTAMP '1998-01-01' AND (e >= TIMESTAMP '1998-01-01' OR e IS NULL)")
def filter_asat(spark, sf):
    return P.filter_as_at(ended(spark, sf), "1998-01-01", "s", "e").select("o_orderkey")


@query(f"SELECT o_orderkey FROM ({PRIORITY}) WHERE p IS NULL")
def filter_isnull(spark, sf):
    return P.apply(priorities(spark, sf), [P.BoundFilter("isnull", "p")]).select("o_orderkey")


@query("SELECT c_name, c_mktsegment FROM customer")
def project(spark, sf):
    return table(spark, sf, "customer").select("c_name", "c_mktsegment")


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders", name="distinct_listing")
def distinct_listing_(spark, sf):
    return distinct_listing(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"])


@query("SELECT n_name, n_nationkey, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def companion_code(spark, sf):
    """A name brings its code into the grouping, for the two are verified to be one to one."""
    nation = table(spark, sf, "nation")
    counts = key_uniqueness(nation, [["n_name"], ["n_name", "n_nationkey"]]).select("distinct").distinct().count()
    keys = ["n_name", "n_nationkey"] if counts == 1 else ["n_name"]
    joined = table(spark, sf, "customer").select("c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return A.aggregate(joined, keys, [A.Measure("count", None, "customers")])


def with_total(spark, sf):
    rows = table(spark, sf, "customer").select("c_mktsegment", "c_acctbal")
    return rows.unionByName(rows.agg(F.lit("Grand Total").alias("c_mktsegment"), F.sum("c_acctbal").alias("c_acctbal")))


TOTAL = "SELECT c_mktsegment, c_acctbal FROM customer UNION ALL SELECT 'Grand Total', sum(c_acctbal) FROM customer"


@query("SELECT c_mktsegment, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def exclude_totals(spark, sf):
    out = A.aggregate(P.exclude_totals(with_total(spark, sf)), ["c_mktsegment"], [A.Measure("sum", "c_acctbal", "total")])
    return out.withColumn("total", F.round("total", 2))


@query(f"SELECT c_mktsegment, count(*) AS n, bool_or(lower(c_mktsegment) LIKE '% total') AS label FROM ({TOTAL}) GROUP BY 1")
def summary_label(spark, sf):
    rows = with_total(spark, sf)
    return rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.bool_or(P.summary_label(qcol("c_mktsegment"))).alias("label"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(concat_ws(chr(1), s_suppkey::VARCHAR, s_name, s_nationkey::VARCHAR)), '7')")
def any_cell_contains(spark, sf):
    return P.any_cell_contains(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "7").select("s_suppkey", "s_name")


STATUS = "SELECT o_orderstatus, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1"


def per_status(spark, sf):
    return A.aggregate(table(spark, sf, "orders"), ["o_orderstatus"], [A.Measure("sum", "o_totalprice", "total"), A.Measure("count", None, "n")])


@query(f"SELECT o_orderstatus, round_even(total / nullif(n, 0), 4) AS mean FROM ({STATUS})")
def derived_ratio(spark, sf):
    return A.ratio(per_status(spark, sf), "total", "n", "mean").select("o_orderstatus", "mean")


@query(f"SELECT o_orderstatus, round_even(100 * total / nullif(sum(total) OVER (), 0), 2) AS pct FROM ({STATUS})")
def pct_of_total(spark, sf):
    return A.pct_of_total(per_status(spark, sf), "total", "pct").select("o_orderstatus", "pct")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
def having(spark, sf):
    counts = A.aggregate(table(spark, sf, "orders"), ["o_custkey"], [A.Measure("count", None, "n")])
    return A.having(counts, [("n", "ge", 15)])


@query("SELECT s_suppkey, round(s_acctbal * CASE s_nationkey WHEN 3 THEN 1.1 WHEN 7 THEN 0.9 ELSE 1.0 END, 2) AS eur FROM supplier")
def fx_convert(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", F.concat(F.lit("n"), F.col("s_nationkey")).alias("currency"))
    return A.convert_currency(rows, "s_acctbal", "currency", {"n3": 1.1, "N7": 0.9}, "eur").select("s_suppkey", F.round("eur", 2).alias("eur"))
