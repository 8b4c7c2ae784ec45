"""The value index and resolution of words to stored values."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import text as X
from gristmill.operators import joins as J
from gristmill.operators import values as V
from gristmill.queries import query, table
from gristmill.session import stored

# On these tables all text is ASCII, where the normal form is lower case with single spaces.
NORM = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
COLUMNS = {"part": ["p_name", "p_brand", "p_type"], "nation": ["n_name"], "customer": ["c_mktsegment"]}
INDEX = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {NORM.format(c)} AS norm, trim({c}) AS display, count(*) AS count FROM {t} GROUP BY {c}" for t, cs in COLUMNS.items() for c in cs
)


def index(spark, sf):
    return V.value_index({t: table(spark, sf, t).select(*cs) for t, cs in COLUMNS.items()})


@query(INDEX)
def value_index(spark, sf):
    return index(spark, sf)


@query(f"SELECT norm, string_agg(display, '|' ORDER BY display) AS spellings FROM (SELECT DISTINCT {NORM.format('d')} AS norm, d AS display FROM (SELECT p_name AS d FROM part UNION SELECT upper(p_name) FROM part)) GROUP BY 1")
def column_domain(spark, sf):
    rows = table(spark, sf, "part").select("p_name")
    both = rows.unionByName(rows.select(F.upper("p_name").alias("p_name")))
    return V.column_domain(both, "p_name").select("norm", F.array_join("spellings", "|").alias("spellings"))


@query(
    f"""
WITH i AS (SELECT norm, sum(count)::BIGINT AS count FROM ({INDEX}) GROUP BY 1),
t AS (SELECT norm, count, list_distinct(list_filter(regexp_extract_all(norm, '[a-z0-9]+'), lambda x: length(x) >= 4)) AS tokens FROM i),
e AS (SELECT unnest(tokens) AS token, norm, count FROM t WHERE len(tokens) >= 2)
SELECT token, norm, count FROM e QUALIFY row_number() OVER (PARTITION BY token ORDER BY count DESC, norm) <= 4
"""
)
def token_index(spark, sf):
    return V.token_index(index(spark, sf))


QUESTION = "total price of Brand#12 parts for the building segment in NATION_3, buildings and machiner of nation_21"


@query(
    f"""
WITH i AS ({INDEX}), q AS (SELECT ' {QUESTION.lower()} ' AS q),
w AS (SELECT unnest(words) AS word, unnest(range(len(words))) AS place FROM (SELECT list_filter(regexp_extract_all('{QUESTION.lower()}', '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3) AS words)),
part AS (
  SELECT "table", "column", norm, display, count, arg_min(least(length(norm), length(word)) / greatest(length(norm), length(word)), place) AS share
  FROM i, w WHERE (contains(norm, word) OR contains(word, norm)) AND least(length(norm), length(word)) / greatest(length(norm), length(word)) >= 0.6 GROUP BY ALL
),
v AS (SELECT norm, sum(count)::BIGINT AS count, list_distinct(list_filter(regexp_extract_all(norm, '[a-z0-9]+'), lambda x: length(x) >= 4)) AS tokens FROM i GROUP BY norm),
t AS (SELECT token, norm FROM (SELECT unnest(tokens) AS token, norm, count FROM v WHERE len(tokens) >= 2) QUALIFY row_number() OVER (PARTITION BY token ORDER BY count DESC, norm) <= 4),
hit AS (
  SELECT i.*, 10 + least(length(norm), 30) / 10 AS score, 'whole' AS kind FROM i, q WHERE contains(q, ' ' || norm || ' ') AND length(norm) >= 3
  UNION ALL SELECT "table", "column", norm, display, count, 5 + share, 'contained' FROM part WHERE length(norm) >= 3
  UNION ALL SELECT i.*, 4 + least(length(token), 20) / 20, 'token' FROM i JOIN t USING (norm) JOIN w ON token = word WHERE length(word) >= 4
),
best AS (SELECT "table", "column", norm, display, count, max(round(score, 4)) AS score, arg_max(kind, score) AS kind FROM hit GROUP BY ALL),
c AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY "table", "column" ORDER BY score DESC, count DESC, norm, display) <= 3)
SELECT "table", "column", norm, display, count, score, kind FROM c ORDER BY score DESC, count DESC, "table", "column", norm LIMIT 12
"""
)
def value_hits(spark, sf):
    """Values that a question names whole, by a part, or by a token."""
    return V.value_hits(stored(index(spark, sf)), QUESTION, typos=False)


@query()
def value_typos(spark, sf):
    """Values that a question misspells; similarity by matching blocks has no SQL."""
    return V.value_hits(stored(index(spark, sf)), "all the bulding parts, larg brushd stel")


MISSPELT = ("furnitre", "agreemnt", "straße", "machiner", "paymnt")
ASCII = tuple(w for w in MISSPELT if w.isascii())


@query(
    " UNION ALL ".join(
        f"SELECT token, '{w}' AS word FROM t WHERE left(token, 1) = '{w[0]}' AND length(token) BETWEEN {len(w)} * 0.75 / 1.25 - 1e-9 AND {len(w)} * 1.25 / 0.75 + 1e-9 AND levenshtein(token, '{w}') <= 0.25 * (length(token) + {len(w)}) + 1e-9"
        f" AND 2.0 * ({' + '.join(f'least({w.count(c)}, length(token) - length(replace(token, $${c}$$, $$$$)))' for c in sorted(set(w)))}) / (length(token) + {len(w)}) >= 0.75 - 1e-9"
        for w in ASCII
    ).replace("SELECT", "WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) SELECT", 1)
)
def typo_candidates(spark, sf):
    """ASCII words of all documents that may be as like as 0.75 to misspelt ones, by bounds of the similarity."""
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("token"))
    return V.like_candidates(words, ASCII, 0.75)


@query()
def misspelt_words(spark, sf):
    """Words of all documents like misspelt ones; similarity by matching blocks has no SQL."""
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))).alias("token"))
    return V.like(words, MISSPELT, 0.75)


@query("SELECT 'p_brand' AS \"column\", count(*) AS count, 'Brand#12' AS spellings FROM part WHERE p_brand = 'Brand#12'")
def value_rebind(spark, sf):
    return V.value_rebind(index(spark, sf), "part", "BRAND#12").select("column", "count", F.array_join("spellings", "|").alias("spellings"))


@query("SELECT 'part' AS \"table\", 'p_name' AS \"column\", lower(p_name) AS norm, p_name AS display, count(*) AS count FROM part WHERE list_sort(string_split(lower(p_name), ' ')) = list_sort(string_split((SELECT min(lower(p_name)) FROM part), ' ')) GROUP BY p_name")
def resolve_token_set(spark, sf):
    first = table(spark, sf, "part").agg(F.min(F.lower("p_name"))).first()[0]
    return V.resolve_token_set(index(spark, sf), " ".join(reversed((first or "").split())))


@query(
    f"""
WITH i AS (SELECT norm, sum(count)::BIGINT AS count FROM ({INDEX}) GROUP BY 1), w AS (SELECT list_distinct(string_split((SELECT min(lower(p_name)) FROM part), ' ')) AS w),
m AS (SELECT norm, count FROM i, w WHERE len(list_intersect(regexp_extract_all(norm, '[a-z0-9]+'), w)) = len(w))
SELECT norm, count FROM m WHERE (SELECT count(*) FROM m) = 1
"""
)
def resolve_phrase(spark, sf):
    first = table(spark, sf, "part").agg(F.min(F.lower("p_name"))).first()[0]
    return V.resolve_phrase(index(spark, sf), first or "")


@query()
def resolve_fuzzy(spark, sf):
    """Names close to a misspelled one; similarity by matching blocks has no SQL."""
    first = table(spark, sf, "part").agg(F.min(F.lower("p_name"))).first()[0] or ""
    return V.resolve_fuzzy(V.column_domain(table(spark, sf, "part"), "p_name"), " ".join(w[:-1] + "x" for w in first.split()))


@query()
def close_matches(spark, sf):
    return V.close_matches(V.column_domain(table(spark, sf, "part"), "p_type"), "standart")


@query()
def similarity_ratio(spark, sf):
    """Similarity of every part's name and type."""
    rows = table(spark, sf, "part")
    return rows.select("p_partkey", F.round(X.similarity_ratio(F.lower("p_name"), F.lower("p_type")), 6).alias("ratio"))


@query("SELECT DISTINCT lower(p_name) AS norm FROM part WHERE (SELECT string_agg(left(x, 1), '') FROM unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS u(x)) LIKE 'r%' AND left(regexp_extract_all(lower(p_name), '[a-z0-9]+')[2], 1) = 'w'")
def acronym_match(spark, sf):
    return V.acronym_match(V.column_domain(table(spark, sf, "part"), "p_name"), "RW")


@query("SELECT s_suppkey, n_name AS name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey <> 4")
def code_lookup(spark, sf):
    codes = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit(" n"), F.col("s_nationkey")).alias("code"))
    mapping = table(spark, sf, "nation").where("n_nationkey <> 4").select(F.concat(F.lit("N"), F.col("n_nationkey"), F.lit(" ")).alias("code"), "n_name")
    return J.code_lookup(codes, mapping, "code", "code", "n_name").select("s_suppkey", "name")


@query("SELECT s_suppkey, s_suppkey % 3 <> 0 AS code FROM supplier")
def code_shape(spark, sf):
    shaped = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.concat(F.lit("CY"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")))
    return table(spark, sf, "supplier").select("s_suppkey", X.looks_like_code(shaped).alias("code"))
