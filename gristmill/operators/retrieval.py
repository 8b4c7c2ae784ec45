"""Hybrid retrieval over text chunks: dense and BM25 rankings, fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.columns import qcol
from gristmill.functions.text import chunk_text, cosine, tokenize, tokens_of
from gristmill.session import stored

K1, B = 1.5, 0.75
RRF_K, DENSE_WEIGHT, SPARSE_WEIGHT = 60, 0.8, 0.2
FETCH, TOP, CONTEXT_CHARS = 20, 5, 6000


def build_chunks(rows: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id", "source")) -> DataFrame:
    """``keep``, ``position`` and ``chunk`` of each text's chunks; texts without any give no row."""
    return rows.select(*[qcol(c) for c in keep], F.posexplode(chunk_text(qcol(text))).alias("position", "chunk"))


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "chunk", tag: str | None = "source", batch: int = 64, vector: str = "embedding") -> DataFrame:
    """``rows`` with a unit vector of each text, which is led by its source's name if ``tag`` is given.

    ``embedder`` maps texts to vectors and runs in the executors, ``batch`` texts at a time.
    """
    shown = F.concat_ws(" ", F.concat(F.lit("["), qcol(tag), F.lit("]")), qcol(text)) if tag else qcol(text)
    schema = T.StructType([*rows.schema.fields, T.StructField(vector, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            found: list[list[float]] = []
            for lo in range(0, len(texts), batch):
                for v in embedder(texts[lo : lo + batch]):
                    size = sum(x * x for x in v) ** 0.5 or 1.0
                    found.append([x / size for x in v])
            arrays = [*b.columns[:-1], pa.array(found, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.withColumn("__shown", shown).mapInArrow(run, schema)


def dense_topk(vectors: DataFrame, query: Sequence[float], k: int = FETCH, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of the greatest cosine, ties to the smaller key; planned as a top-k."""
    asked = F.array(*[F.lit(float(v)) for v in query])
    return vectors.select(qcol(key).alias("id"), F.round(cosine(qcol(vector), asked), 6).alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(k)


def _times(tokens: str, word: str) -> Column:
    """Occurrences of a word: what removing it takes away (compiled, unlike a lambda per token)."""
    return F.size(tokens) - F.size(F.array_remove(tokens, word))


def bm25_scores(rows: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, score)`` of every row, 0 without a token of the query.

    Only the query's tokens are counted, inside each row, and written as a few numbers a
    row, from which the statistics and the scores come: texts are read and cut into tokens
    once, none is exploded, and nothing but those numbers is shuffled. A repeated query
    token counts again.
    """
    terms = tokens_of(query)
    names = sorted(set(terms))
    if not names:
        return rows.select(qcol(key).alias("id"), F.lit(0.0).alias("score"))
    tokens = tokenize(F.coalesce(qcol(text), F.lit("")))
    counted = rows.select(qcol(key).alias("id"), tokens.alias("tokens")).select("id", F.size("tokens").alias("size"), *[_times("tokens", w).alias(f"tf{i}") for i, w in enumerate(names)])
    counted = stored(counted)
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(names))]).first()
    score = F.lit(0.0)
    for i, w in enumerate(names):
        idf = F.log(1 + (F.lit(float(stats["n"])) - stats[f"df{i}"] + 0.5) / F.lit(stats[f"df{i}"] + 0.5))
        tf = F.col(f"tf{i}").cast("double")
        part = idf * F.try_divide(tf * (K1 + 1), tf + K1 * (1 - B + B * F.col("size") / F.lit(float(stats["mean"] or 1.0))))
        score = score + terms.count(w) * F.coalesce(part, F.lit(0.0))
    return counted.select("id", score.alias("score"))


def bm25_topk(rows: DataFrame, query: str, k: int = FETCH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The k best rows that have a token of the query at all."""
    best = bm25_scores(rows, query, key, text).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return best.where("score > 0")


def ranked(top: DataFrame) -> DataFrame:
    """Ranks from 0 of a short list, best first."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)


def rrf_fuse(lists: Sequence[tuple[DataFrame, float]], k: int = RRF_K, top: int = TOP) -> DataFrame:
    """``(id, score)``: weight / (k + rank + 1) summed over the lists, each of a bounded length."""
    parts = None
    for frame, weight in lists:
        part = ranked(frame).select("id", (F.lit(weight) / (F.lit(k) + F.col("rank") + 1)).alias("score"))
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy("id").agg(F.round(F.sum("score"), 6).alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(top)


def context_budget(hits: DataFrame, text: Column | str, order: Sequence[Column], budget: int = CONTEXT_CHARS) -> DataFrame:
    """The leading rows whose texts fit the budget together; ``hits`` is a short list."""
    size = F.length(F.col(text) if isinstance(text, str) else text)
    before = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return hits.withColumn("used", before).where(F.col("used") <= budget)
