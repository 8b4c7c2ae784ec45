"""A stored inverted index: postings by term and span of rows, with bounds that let spans go unread.

A span is a run of SPAN neighbouring rows, the same for all terms. A row of the index has a
term, a span, and the span's rows that hold the term; beside them stand how many these are,
the highest count and the least size among them. Sorted by term and written as Parquet, a
question reads the row groups of its own terms only; from the small columns alone it learns
each span's highest possible score, and it reads the rows of those spans that can still reach
the k-th best. What is left out cannot be among the best, so the result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.columns import qcol
from gristmill.functions.text import tokenize, tokens_of
from gristmill.operators.retrieval import FETCH, K1, B

SPAN = 4096
#: Spans that set the mark, and spans up to which the rest are named one by one in the filter of the scan.
FIRST, NAMED = 4, 1000
#: Scores are rounded to six places, so bounds may be as much too low.
SLACK = 1e-6


@dataclass
class Part:
    """The index of one set of rows: postings, how many rows and tokens it has, and the ids that hold no more."""

    postings: DataFrame
    n: int
    total: int
    gone: DataFrame | None = None
    gone_n: int = 0
    gone_total: int = 0


def postings(rows: DataFrame, key: str = "chunk_id", text: str = "chunk", number: str = "n") -> DataFrame:
    """``(term, span, n, most, least, docs)`` of all ``rows``; ``docs`` has (id, tf, size) by id.

    ``number`` counts the rows; which rows share a span is up to it. Rows without tokens have no postings.
    """
    cut = rows.select(qcol(key).alias("id"), F.expr(f"`{number}` div {SPAN}").alias("span"), tokenize(F.coalesce(qcol(text), F.lit(""))).alias("tokens"))
    kind = dict(cut.dtypes)["id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each term of each text: terms are counted where their text is, so they travel counted, once."""
        for batch in batches:
            tokens = batch.column("tokens")
            terms = pa.table({"row": pc.list_parent_indices(tokens), "term": tokens.flatten()})
            found = terms.group_by(["row", "term"], use_threads=False).aggregate([("term", "count")])
            held = pa.table({"id": batch.column("id"), "span": batch.column("span"), "size": pc.list_value_length(tokens)}).take(found["row"])
            out = pa.table({"term": found["term"], "span": held["span"], "id": held["id"], "tf": found["term_count"].cast(pa.int32()), "size": held["size"]})
            yield from out.combine_chunks().to_batches(max_chunksize=65_536)

    counted = cut.mapInArrow(count, f"term string, span long, id {kind}, tf int, size int").repartition("term", "span")
    # a span has SPAN rows at most, so a list does
    return counted.groupBy("term", "span").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("size").alias("least"), F.sort_array(F.collect_list(F.struct("id", "tf", "size"))).alias("docs")
    )


def sizes(rows: DataFrame, text: str = "chunk") -> tuple[int, int]:
    """Rows and tokens of a table."""
    n, total = rows.agg(F.count(F.lit(1)), F.sum(F.size(tokenize(F.coalesce(qcol(text), F.lit("")))))).first()
    return n, total or 0


def tokens_in(index: DataFrame) -> int:
    """The tokens of all rows of an index, from its counts, without reading texts again."""
    return index.select(F.explode("docs.tf").alias("tf")).agg(F.sum("tf")).first()[0] or 0


def write(index: DataFrame, path: str) -> None:
    """Postings as Parquet, by term, in row groups small enough to be skipped; a filter of terms for each."""
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = index.repartitionByRange(tasks, "term", "span").sortWithinPartitions("term", "span")
    ordered.write.option("parquet.block.size", str(4 << 20)).option("parquet.bloom.filter.enabled#term", "true").parquet(path)


def _weight(tf: Column, size: Column, mean: float) -> Column:
    tf = tf.cast("double")
    return F.coalesce(F.try_divide(tf * (K1 + 1), tf + K1 * (1 - B + B * size / F.lit(mean or 1.0))), F.lit(0.0))


def _by_term(values: dict[str, float]) -> Column:
    """The value of the row's term."""
    return reduce(lambda c, kv: c.when(F.col("term") == kv[0], F.lit(kv[1])), values.items(), F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(0.0))


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def bm25_topk(parts: Sequence[Part], query: str, k: int = FETCH) -> DataFrame:
    """``(id, score)`` of the ``k`` best rows of all parts, ties by id, as a scan of the live rows gives them."""
    asked = tokens_of(query)
    names = sorted(set(asked))
    spark = parts[0].postings.sparkSession
    none = spark.createDataFrame([], f"id {dict(parts[0].postings.select(F.col('docs')[0]['id'].alias('id')).dtypes)['id']}, score double")
    n = sum(p.n - p.gone_n for p in parts)
    if not names or not n:
        return none
    mean = sum(p.total - p.gone_total for p in parts) / n
    held = [p.postings.where(F.col("term").isin(names)).withColumn("part", F.lit(i)) for i, p in enumerate(parts)]

    def docs(i: int, rows: DataFrame) -> DataFrame:
        """Live rows of a part's postings, one for each term."""
        each = rows.select("part", "term", F.explode("docs").alias("d")).select("part", "term", "d.id", "d.tf", "d.size")
        return each if parts[i].gone is None else each.join(parts[i].gone.select(F.col("id")), "id", "left_anti")

    # documents that hold a term: spans know, but for rows that went since
    heads = _union([h.select("part", "term", "span", "n", "most", "least") for h in held])
    have = {r["term"]: r["n"] for r in heads.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    stale = [(i, h) for i, h in enumerate(held) if parts[i].gone is not None]
    if stale:
        lost = _union([h.select("term", F.explode("docs.id").alias("id")).join(parts[i].gone.select(F.col("id")), "id", "left_semi").select("term") for i, h in stale])
        for r in lost.groupBy("term").count().collect():
            have[r["term"]] -= r["count"]
    idf = spark.range(1).select(*[F.log(1 + (F.lit(float(n)) - have[t] + 0.5) / F.lit(have[t] + 0.5)).alias(f"w{i}") for i, t in enumerate(names) if have.get(t)])
    found = idf.first().asDict() if idf.columns else {}
    weight = {t: asked.count(t) * found[f"w{i}"] for i, t in enumerate(names) if f"w{i}" in found}
    if not weight:
        return none
    factor = _by_term(weight)
    # a count can be no higher and a size no lower than its span's, and the weight grows with the one and falls with the other
    bounds = heads.withColumn("bound", factor * _weight(F.col("most"), F.col("least"), mean)).groupBy("part", "span").agg(F.sum("bound").alias("bound"))

    def scored(choose: list[Column | None]) -> DataFrame:
        rows = _union([docs(i, h if c is None else h.where(c)) for i, (h, c) in enumerate(zip(held, choose)) if c is not False])
        each = rows.groupBy("part", "id").agg(F.sum(factor * _weight(F.col("tf"), F.col("size"), mean)).alias("score"))
        return each.select("id", F.round("score", 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)

    def named(spans: list) -> list:
        by = [[r["span"] for r in spans if r["part"] == i] for i in range(len(parts))]
        return [F.col("span").isin(x) if x else False for x in by]

    best = bounds.orderBy(F.desc("bound"), "part", "span").limit(FIRST).collect()
    if not best:
        return none
    top = scored(named(best)).collect()
    mark = top[k - 1]["score"] - SLACK if len(top) >= k else 0.0
    worth = bounds.where(F.col("bound") >= mark)
    some = worth.limit(NAMED + 1).collect()
    if len(some) <= NAMED:
        return scored(named(some))
    # too many to name: the scan is joined with them
    kept = worth.select("part", "span")
    held = [h.join(kept, ["part", "span"], "left_semi") for h in held]
    return scored([None] * len(parts))
