"""Cleaning and typing. Text columns are written from numbers and dates and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.columns import qcol
from gristmill.functions import dates as D
from gristmill.functions import numbers as N
from gristmill.operators import profiling as R
from gristmill.queries import query, table
from gristmill.sources.extract import list_pairs


def us_text(column):
    return F.format_number(column, 2)


def eu_text(column):
    return F.translate(us_text(column), ",.", ".,")


@query("SELECT s_suppkey, round(s_acctbal, 2) AS amount FROM supplier")
def eu_number_parse(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", eu_text(F.col("s_acctbal")).alias("amount"))
    return N.read_numbers(rows, ["amount"])


@query("SELECT s_suppkey, round(s_acctbal, 2) AS amount FROM supplier")
def us_number_parse(spark, sf):
    bal = F.col("s_acctbal")
    text = F.when(bal < 0, F.concat(F.lit("("), us_text(-bal), F.lit(")"))).otherwise(us_text(bal))
    return N.read_numbers(table(spark, sf, "supplier").select("s_suppkey", text.alias("amount")), ["amount"])


@query("SELECT * FROM (VALUES ('eu', 'EU'), ('us', 'US'), ('mixed', NULL), ('code', NULL)) AS t(\"column\", locale)")
def locale_vote(spark, sf):
    bal = F.col("s_acctbal")
    mixed = F.when(F.col("s_suppkey") % 2 == 0, eu_text(bal)).otherwise(us_text(bal))
    code = F.concat(F.lit("1."), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"))
    rows = table(spark, sf, "supplier").select(eu_text(bal).alias("eu"), us_text(bal).alias("us"), mixed.alias("mixed"), code.alias("code"))
    return N.locale_votes(rows, rows.columns).select("column", "locale")


@query("SELECT s_suppkey, s_name FROM supplier")
def strip_cells(spark, sf):
    return R.strip_cells(table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit(" \t"), "s_name", F.lit("\n ")).alias("s_name")))


@query(
    """
SELECT 'a' AS "column", count(*) AS filled, count(*) FILTER (o_orderkey % 10 <> 0) AS as_number, 0 AS as_date, 'number' AS type FROM orders
UNION ALL SELECT 'b', count(*), count(*) FILTER (o_orderkey % 2 = 0), 0, 'text' FROM orders
UNION ALL SELECT 'c', count(*), 0, count(*), 'date' FROM orders
"""
)
def coerce_keep_ratio(spark, sf):
    key = F.col("o_orderkey")
    a = F.when(key % 10 == 0, "n/a").otherwise(F.round("o_totalprice", 2).cast("string"))
    b = F.when(key % 2 == 0, key.cast("string")).otherwise("x")
    rows = table(spark, sf, "orders").select(a.alias("a"), b.alias("b"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("c"))
    return R.coercions(rows)


@query("SELECT 'eu' AS \"column\", 31 AS first, 12 AS second, true AS dayfirst UNION ALL SELECT 'us', 12, 31, false UNION ALL SELECT 'iso', max(year(o_orderdate)), 12, NULL FROM orders")
def dayfirst_detect(spark, sf):
    show = lambda f: F.date_format("o_orderdate", f)
    rows = table(spark, sf, "orders").select(show("dd.MM.yyyy").alias("eu"), show("MM/dd/yyyy").alias("us"), show("yyyy-MM-dd").alias("iso"))
    return D.dayfirst(rows, ["eu", "us", "iso"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN date_trunc('day', o_orderdate) END AS d, date_trunc('day', o_orderdate) AS e FROM orders")
def date_parse(spark, sf):
    text = F.when(F.col("o_orderkey") % 7 == 0, "someday").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("d"), F.date_format("o_orderdate", "yyyy/MM/dd").alias("e"))
    return rows.select("o_orderkey", D.parse_date(qcol("d")).alias("d"), D.parse_date(qcol("e"), "%Y/%m/%d").alias("e"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0")
def dropna_all(spark, sf):
    some = F.col("c_custkey") % 5 != 0
    rows = table(spark, sf, "customer").select(F.when(some, F.col("c_custkey")).alias("c_custkey"), F.when(some, F.col("c_name")).alias("c_name"), F.lit(None).cast("string").alias("empty"))
    return R.dropna_all(rows)


@query("SELECT s_suppkey::DOUBLE AS a, s_name AS b FROM supplier")
def typed_if_all_numeric(spark, sf):
    return R.typed_if_all_numeric(table(spark, sf, "supplier").select(F.format_number("s_suppkey", 0).alias("a"), F.col("s_name").alias("b")))


@query("SELECT n_nationkey, n_name AS label, (n_nationkey * 1000 + 0.5)::DOUBLE AS value FROM nation UNION ALL SELECT n_nationkey, 'rank', n_regionkey::DOUBLE FROM nation")
def list_extract(spark, sf):
    text = F.concat(F.lit("Figures below\n- "), "n_name", F.lit(": "), F.format_number(F.col("n_nationkey") * 1000 + 0.5, 1), F.lit("\n* rank: "), F.col("n_regionkey").cast("string"), F.lit("\nno figure: none"))
    return list_pairs(table(spark, sf, "nation").select("n_nationkey", text.alias("text")), "text")


@query("SELECT o_orderkey, last_day(o_orderdate) AS last FROM orders")
def month_end(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", D.month_end(F.col("o_orderdate")).alias("last"))


@query("SELECT 'fixed' AS \"column\", DATE '2024-01-31' AS day, 1.0::DOUBLE AS share")
def content_date(spark, sf):
    return D.content_date(table(spark, sf, "orders").select(F.col("o_orderdate"), F.lit("2024-01-31").cast("date").alias("fixed")), ["o_orderdate", "fixed"])


@query("SELECT o_orderkey, o_orderdate::DATE AS eu, o_orderdate::DATE AS iso FROM orders")
def filename_asof(spark, sf):
    name = lambda f: F.concat(F.lit("CY01_"), F.date_format("o_orderdate", f), F.lit("_v2.xlsx"))
    return table(spark, sf, "orders").select("o_orderkey", D.filename_asof(name("dd-MM-yyyy")).alias("eu"), D.filename_asof(name("yyyy-MM-dd")).alias("iso"))


@query(
    """
WITH p AS (SELECT o_orderkey, year(o_orderdate)::VARCHAR AS y, floor(o_totalprice)::BIGINT AS whole, o_totalprice = floor(o_totalprice) AS even, o_totalprice AS v FROM orders
  UNION ALL SELECT -o_orderkey, year(o_orderdate)::VARCHAR, floor(o_totalprice)::BIGINT, true, floor(o_totalprice) FROM orders),
s AS (SELECT o_orderkey, y, CASE WHEN even AND whole BETWEEN 1900 AND 2100 THEN whole::VARCHAR WHEN even THEN format('{:,}', whole) ELSE format('{:,.2f}', v) END AS us FROM p)
SELECT o_orderkey, us, translate(us, ',.', '.,') AS eu, y FROM s
"""
)
def fmt_number(spark, sf):
    """Prices as they are, and their whole parts."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    both = rows.unionByName(rows.select((-F.col("o_orderkey")).alias("o_orderkey"), "o_orderdate", F.floor("o_totalprice").cast("double").alias("o_totalprice")))
    price = F.col("o_totalprice")
    return both.select("o_orderkey", N.fmt_number(price).alias("us"), N.fmt_number(price, "EU").alias("eu"), N.fmt_number(F.year("o_orderdate")).alias("y"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS us, round(o_totalprice, 2) AS eu FROM orders")
def canon_number(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", N.canon_number(us_text(price)).alias("us"), N.canon_number(eu_text(price), "EU").alias("eu"))


@query("SELECT l_orderkey, l_linenumber, format('{:.3f}%', round(l_discount * 100, 6)) AS rate FROM lineitem")
def rate_percent(spark, sf):
    return N.rate_percent(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount", "rate").drop("l_discount")


@query("WITH h AS (SELECT o_orderkey, floor(o_totalprice / 100) * 100 AS v FROM orders) SELECT o_orderkey, CASE WHEN v >= 1e6 THEN format('{:.1f}M', v / 1e6) WHEN v >= 1000 THEN format('{:.1f}K', v / 1000) ELSE format('{:.0f}', v) END AS shown FROM h")
def human_number(spark, sf):
    """Whole hundreds, so that no figure lies between two of one place."""
    hundreds = F.floor(F.col("o_totalprice") / 100) * 100
    return table(spark, sf, "orders").select("o_orderkey", N.human_number(hundreds).alias("shown"))


@query(
    """
WITH f AS (SELECT event_id, event_id - lag(event_id) OVER (ORDER BY event_id) > 3 AS gap FROM events WHERE event_id % 97 > 3)
SELECT event_id, sum(coalesce(gap, false)::INT) OVER (ORDER BY event_id)::BIGINT AS region FROM f
"""
)
def region_split(spark, sf):
    """Regions of the rows that remain where four of every 97 are blank."""
    return R.regions(table(spark, sf, "events").select("event_id"), "event_id", F.col("event_id") % 97 <= 3, blanks=3)
