"""Joins, comparisons, upserts and relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import joins as J
from gristmill.operators import profiling as R
from gristmill.queries import query, table

HOLED = "SELECT o_orderkey, nullif(o_custkey, 7) AS k FROM orders"
CUSTOMERS = "SELECT nullif(c_custkey, 5) AS k, c_name, c_nationkey FROM customer WHERE c_custkey <> 7"


def holed_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.nullif("o_custkey", F.lit(7)).alias("k"))


def holed_customers(spark, sf):
    return table(spark, sf, "customer").where("c_custkey <> 7").select(F.nullif("c_custkey", F.lit(5)).alias("k"), "c_name", "c_nationkey")


@query(f"SELECT o.o_orderkey, o.k, c.c_name, c.c_nationkey FROM ({HOLED}) o LEFT JOIN ({CUSTOMERS}) c ON o.k IS NOT DISTINCT FROM c.k")
def join_left(spark, sf):
    return J.left_join(holed_orders(spark, sf), holed_customers(spark, sf), "k", "k")


@query(f"SELECT o.o_orderkey, o.k, c.c_name, c.c_nationkey FROM ({HOLED}) o JOIN ({CUSTOMERS}) c ON o.k IS NOT DISTINCT FROM c.k")
def join_inner(spark, sf):
    return J.inner_join(holed_orders(spark, sf), holed_customers(spark, sf), "k", "k")


@query(
    """
WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1),
b AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS o_custkey, round(coalesce(a.v, 0), 2) AS y96, round(coalesce(b.v, 0), 2) AS y97,
  round(coalesce(b.v, 0) - coalesce(a.v, 0), 2) AS delta, round_even(100 * (coalesce(b.v, 0) - coalesce(a.v, 0)) / nullif(coalesce(a.v, 0), 0), 2) AS pct,
  CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN b.k IS NOT NULL THEN 'new' ELSE 'gone' END AS "STATUS"
FROM a FULL JOIN b ON a.k = b.k
"""
)
def compare_snapshots(spark, sf):
    orders = table(spark, sf, "orders")
    year = lambda y: orders.where((F.col("o_orderdate") >= f"{y}-01-01") & (F.col("o_orderdate") < f"{y + 1}-01-01"))
    m = "o_totalprice"
    out = J.compare_snapshots(year(1996), year(1997), "o_custkey", [m], "1996", "1997")
    two = lambda c: F.round(F.col(f"`{c}`"), 2)
    return out.select("o_custkey", two(f"{m}_1996").alias("y96"), two(f"{m}_1997").alias("y97"), two(f"{m}_delta").alias("delta"), F.col(f"{m}_pct").alias("pct"), "STATUS")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return J.semi_join(table(spark, sf, "customer").select("c_custkey", "c_name"), urgent, "c_custkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_join(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return J.anti_join(table(spark, sf, "customer").select("c_custkey", "c_name"), urgent, "c_custkey", "o_custkey")


@query(
    """
SELECT doc_id, source, n_chars, 'old' AS version FROM documents WHERE source NOT IN ('src1', 'src2')
UNION ALL SELECT doc_id + 1000000, source, n_chars * 2, 'new' FROM documents WHERE source IN ('src1', 'src2')
"""
)
def upsert_by_source(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    new = docs.where("source IN ('src1', 'src2')").select((F.col("doc_id") + 1000000).alias("doc_id"), "source", (F.col("n_chars") * 2).alias("n_chars"), F.lit("new").alias("version"))
    return J.upsert_by_source(docs.withColumn("version", F.lit("old")), new)


@query(
    """
WITH want AS (SELECT DISTINCT sha1('m1' || chr(0) || text) AS key FROM documents),
have AS (SELECT DISTINCT sha1('m1' || chr(0) || text) AS key FROM documents WHERE lang = 'en')
SELECT key FROM want WHERE key NOT IN (SELECT key FROM have)
"""
)
def embed_cache_miss(spark, sf):
    key = F.sha1(F.concat_ws("\0", F.lit("m1"), F.col("text")).cast("binary"))
    docs = table(spark, sf, "documents")
    return J.anti_join(docs.select(key.alias("key")).distinct(), docs.where("lang = 'en'").select(key.alias("key")), "key", "key")


KEYS = {"customer": ["c_custkey", "c_nationkey"], "orders": ["o_custkey", "o_orderkey"], "nation": ["n_nationkey", "n_regionkey"], "region": ["r_regionkey"], "supplier": ["s_suppkey", "s_nationkey"]}
KEY_VALUES = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {c}::VARCHAR AS v FROM {t}" for t, cs in KEYS.items() for c in cs)
KEY_ROWS = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, count({c}) AS filled FROM {t}" for t, cs in KEYS.items() for c in cs)


def keyed(spark, sf):
    return {t: table(spark, sf, t) for t in KEYS}


@query(
    f"""
WITH v AS ({KEY_VALUES}), f AS ({KEY_ROWS}), d AS (SELECT t, c, count(*) AS d FROM v GROUP BY ALL HAVING count(*) BETWEEN 3 AND 50000),
s AS (SELECT a.t AS ct, a.c AS cc, b.t AS pt, b.c AS pc, count(*) AS n FROM v a JOIN v b ON a.v = b.v AND a.t <> b.t GROUP BY ALL),
q AS (SELECT s.*, round(n / x.d, 4) AS coverage FROM s JOIN d x ON ct = x.t AND cc = x.c JOIN d y ON pt = y.t AND pc = y.c JOIN f ON pt = f.t AND pc = f.c
  WHERE n >= 0.95 * x.d AND y.d >= 0.95 * f.filled)
SELECT ct AS child_table, cc AS child_column, pt AS parent_table, pc AS parent_column, coverage FROM q
QUALIFY row_number() OVER (PARTITION BY ct, cc, pt ORDER BY coverage DESC, pc) = 1
"""
)
def fk_discovery(spark, sf):
    return R.relationships(keyed(spark, sf), KEYS)


JACCARD = f"""
WITH v AS ({KEY_VALUES}), d AS (SELECT t, c, count(*) AS d FROM v GROUP BY ALL),
s AS (SELECT a.t AS lt, a.c AS lc, b.t AS rt, b.c AS rc, count(*) AS n FROM v a JOIN v b ON a.v = b.v AND a.t < b.t GROUP BY ALL)
SELECT lt AS left_table, lc AS left_column, rt AS right_table, rc AS right_column, n AS shared,
  round(n / (x.d + y.d - n), 4) AS jaccard, round(n / least(x.d, y.d), 4) AS coverage, least(x.d, y.d) AS least_distinct
FROM s JOIN d x ON lt = x.t AND lc = x.c JOIN d y ON rt = y.t AND rc = y.c
"""


@query(JACCARD)
def jaccard_columns(spark, sf):
    return R.jaccard_columns(keyed(spark, sf), KEYS)


@query(
    f"""
WITH j AS ({JACCARD}), w AS (
  SELECT *, regexp_replace(lower(left_column), '[\\W_]|code|id|key|no', '', 'g') AS bl, regexp_replace(lower(right_column), '[\\W_]|code|id|key|no', '', 'g') AS br FROM j),
g AS (SELECT *, CASE WHEN lower(left_column) = lower(right_column) AND jaccard > 0.7 THEN 'same_name' WHEN bl = br AND bl <> '' AND jaccard > 0.8 THEN 'similar_name'
  WHEN regexp_matches(lower(left_column), '(id|key|code)$') AND regexp_matches(lower(right_column), '(id|key|code)$') AND jaccard > 0.75 THEN 'id_pattern'
  WHEN coverage >= 0.6 AND least_distinct >= 8 THEN 'shared_values' END AS way FROM w)
SELECT left_table, left_column, right_table, right_column, way, CASE WHEN way = 'shared_values' THEN coverage ELSE jaccard END AS strength FROM g WHERE way IS NOT NULL
"""
)
def fk_dedup(spark, sf):
    found = R.shared_keys(R.jaccard_columns(keyed(spark, sf), KEYS))
    names = ["left_table", "left_column", "right_table", "right_column", "way", "strength"]
    return R.strongest(found.select(*names).unionByName(found.select(*names))).select(*names)


@query("SELECT upper(trim(n_name)) AS value FROM nation INTERSECT SELECT 'NATION_' || s_nationkey FROM supplier")
def set_intersect(spark, sf):
    names = table(spark, sf, "supplier").select(F.concat(F.lit("nation_"), F.col("s_nationkey")).alias("name"))
    return J.set_intersect(table(spark, sf, "nation"), names, "n_name", "name")
