"""Text functions, chunks and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.columns import qcol
from gristmill.functions import text as X
from gristmill.operators import cells as C
from gristmill.operators import postings as P
from gristmill.operators import retrieval as H
from gristmill.queries import query, table
from gristmill.session import stored

WORDS = "the reonth of password"


@query("SELECT p_partkey, trim(regexp_replace(lower('  ' || p_name || '  '), '\\s+', ' ', 'g')) AS norm FROM part")
def norm_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.norm_text(F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t "))).alias("norm"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS tokens, md5(array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ')) AS digest FROM documents")
def tokenize(spark, sf):
    tokens = X.tokenize(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(tokens).alias("tokens"), F.md5(F.array_join(tokens, " ")).alias("digest"))


@query("SELECT p_partkey, upper(p_name) AS name FROM part")
def strip_upper(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.strip_upper(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  \t")), F.lit("\n"))).alias("name"))


@query("SELECT p_partkey, regexp_extract(p_brand, '#(\\d+)$', 1)::INT AS brand FROM part")
def regex_extract(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.regexp_extract("p_brand", r"#(\d+)$", 1).try_cast("int").alias("brand"))


@query("SELECT doc_id, sha1(text) AS s, md5(text) AS m FROM documents")
def hash_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("s"), F.md5(F.col("text").cast("binary")).alias("m"))


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def json_extract(spark, sf):
    fenced = F.concat(F.lit("<think>{no}</think>Result: ```json\n"), F.col("props"), F.lit("\n``` done {"))
    return table(spark, sf, "events").select("event_id", F.get_json_object(X.json_extract(fenced), "$.k").try_cast("bigint").alias("k"))


LOW_EVENTS = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'funds of cy' || lpad((event_id % 100)::VARCHAR, 2, '0') || ' at 7.' || (event_id % 12 + 1) || '.2023 in usd' ELSE 'bond totals' END AS q FROM events"


@query(f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'CY' || lpad((event_id % 100)::VARCHAR, 2, '0') END AS code, CASE WHEN event_id % 2 = 0 THEN '2023-' || lpad((event_id % 12 + 1)::VARCHAR, 2, '0') || '-07' END AS day, CASE WHEN event_id % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency, CASE WHEN event_id % 2 = 0 THEN 'FUND' ELSE 'BOND' END AS kind FROM ({LOW_EVENTS})")
def param_extract(spark, sf):
    n = F.col("event_id")
    even = F.concat(F.lit("funds of cy"), F.lpad((n % 100).cast("string"), 2, "0"), F.lit(" at 7."), (n % 12 + 1).cast("string"), F.lit(".2023 in usd"))
    rows = table(spark, sf, "events").select(n, F.when(n % 2 == 0, even).otherwise("bond totals").alias("q"))
    q = qcol("q")
    return rows.select("event_id", X.first_code(q).alias("code"), X.first_iso_date(q).alias("day"), X.first_currency(q).alias("currency"), X.first_fund_type(q).alias("kind"))


@query()
def chunk_text(spark, sf):
    """Chunks of every document, digests in place of their texts; packing paragraphs has no SQL."""
    return H.build_chunks(table(spark, sf, "documents")).select("doc_id", "source", "position", F.length("chunk").alias("size"), F.md5("chunk").alias("digest"))


def bm25_sql(limit: int) -> str:
    words = WORDS.split()
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * coalesce(tf{i} * 2.5 / nullif(tf{i} + 1.5 * (0.25 + 0.75 * size / mean), 0), 0)" for i in range(len(words)))
    return f"""
WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents), c AS (SELECT id, len(t) AS size, {tf} FROM t),
s AS (SELECT count(*) AS n, avg(size) AS mean, {df} FROM c)
SELECT id, round({score}, 6) AS score FROM c, s WHERE {some} ORDER BY score DESC, id LIMIT {limit}
"""


@query(bm25_sql(20))
def bm25_topk(spark, sf):
    return H.bm25_topk(table(spark, sf, "documents"), WORDS)


@query(bm25_sql(20))
def bm25_indexed(spark, sf):
    """The same from an inverted index of all documents, of which the question reads its own terms."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("doc_id").alias("n"))
    index = stored(P.postings(docs, "doc_id", "text"))
    own = stored(index.where(F.col("term").isin(X.tokens_of(WORDS))))
    return P.bm25_topk([P.Part(own, docs.count(), P.tokens_in(index))], WORDS)


DENSE = "SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 20"


def first_vector(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]


@query(DENSE)
def dense_topk(spark, sf):
    return H.dense_topk(table(spark, sf, "embeddings"), first_vector(spark, sf))


@query(DENSE)
def dense_cells(spark, sf):
    """The same from cells, of which the triangle inequality leaves most unread where vectors lie in clusters."""
    rows = table(spark, sf, "embeddings")
    centres = C.fit(rows)
    placed = stored(C.placed(rows, centres))
    return C.exact_topk(placed, centres, [tuple(r) for r in C.summary(placed).collect()], first_vector(spark, sf))


FUSED = f"""
WITH d AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({DENSE})), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({bm25_sql(20)}))
SELECT id, round(sum(w), 6) AS score FROM (SELECT id, 0.8 / (60 + r) AS w FROM d UNION ALL SELECT id, 0.2 / (60 + r) FROM b) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5
"""


@query(FUSED)
def rrf_fuse(spark, sf):
    dense = H.dense_topk(table(spark, sf, "embeddings"), first_vector(spark, sf))
    sparse = H.bm25_topk(table(spark, sf, "documents"), WORDS)
    return H.rrf_fuse([(dense, H.DENSE_WEIGHT), (sparse, H.SPARSE_WEIGHT)])


@query(
    f"""
WITH h AS (SELECT id, score, text FROM ({bm25_sql(20)}) JOIN documents ON id = doc_id), u AS (SELECT id, sum(length(text)) OVER (ORDER BY score DESC, id) AS used FROM h)
SELECT id, used::BIGINT AS used FROM u WHERE used <= 6000
"""
)
def context_budget(spark, sf):
    docs = table(spark, sf, "documents")
    hits = H.bm25_topk(docs, WORDS).join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    return H.context_budget(hits, "text", [F.desc("score"), F.col("id")]).select("id", "used")
