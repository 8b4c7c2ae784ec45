"""Ranked lexical search by sort-based accumulation, in whole numbers.

The items of a block (their number is bounded) give a vocabulary. Every document is cut
once; of its terms those of the vocabulary stay, with their counts, in one compact row.
A task then takes ranges of documents: it concatenates what they add to each item, packs
(item, document of the range) into a key, sorts the keys by 16-bit digits and sums runs of
equal keys. A document lies in one range only, so its sums are complete there, and only
the best of each item leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import documents, map_columns, settle, slices

#: Items of one block, and terms of a block after which it is closed.
BLOCK_ITEMS, BLOCK_TERMS = 8192, 1 << 20
#: Documents of a range (its numbers have one digit) and contributions sorted at once.
RANGE, SORTED_AT_ONCE = 1 << 16, 1 << 21
TOP = 10
RESULT = ("item_id", "rank", "score")


def _bytes_table() -> bytes:
    """Separators become a space and A-Z their small letters; all else stays."""
    plain = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in plain else 0x20 for b in range(256))


TABLE = _bytes_table()


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


@dataclass
class Block:
    """Items of a search and their vocabulary: term ``t``'s items are ``item[start[t]:start[t + 1]]``, each with its repeats."""

    ids: list
    number: dict[bytes, int]
    start: np.ndarray
    item: np.ndarray
    often: np.ndarray


def block_of(items: list[tuple[object, list[bytes]]]) -> Block:
    number: dict[bytes, int] = {}
    pairs = np.array([(number.setdefault(t, len(number)), i) for i, (_, words) in enumerate(items) for t in words], dtype=np.int64).reshape(-1, 2)
    keys, often = np.unique(pairs[:, 0] << 32 | pairs[:, 1], return_counts=True)
    start = np.searchsorted(keys >> 32, np.arange(len(number) + 1))
    return Block([k for k, _ in items], number, start, keys & 0xFFFFFFFF, often.astype(np.int64))


def blocks(items: DataFrame, key: str, text: str) -> Iterator[Block]:
    """``items`` in blocks of bounded size, in the order of the table."""
    held: list[tuple[object, list[bytes]]] = []
    size = 0
    for k, t in items.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        held.append((k, terms(t)))
        size += len(held[-1][1])
        if len(held) == BLOCK_ITEMS or size >= BLOCK_TERMS:
            yield block_of(held)
            held, size = [], 0
    if held:
        yield block_of(held)


def radix_order(keys: np.ndarray, digits: int) -> np.ndarray:
    """The order that sorts ``keys``, by 16-bit digits from the lowest on; equal keys stay as they are."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for d in range(1, digits):
        order = order[np.argsort((keys[order] >> (16 * d) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def weights(size: int, have: np.ndarray) -> np.ndarray:
    """Weight of a term in ``have`` of ``size`` documents: floor(1000 ln((2 size + 2) / (2 have + 1)))."""
    return np.array([math.floor(1000 * math.log((2 * size + 2) / (2 * h + 1))) for h in have.tolist()], dtype=np.int64)


def best(scores: np.ndarray, nulls: np.ndarray, keys: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores, equal ones by key with null last."""
    at = np.arange(len(scores))
    if len(scores) > top:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - top)[len(scores) - top])
    return at[np.lexsort((keys[at], nulls[at], -scores[at]))[:top]]


class Accumulator:
    """Sums of every item over ranges of documents, of which the ``top`` of each item are kept."""

    def __init__(self, block: Block, weight: np.ndarray, size: int, length: int, top: int):
        self.block, self.weight, self.size, self.length, self.top = block, weight, size, length, top
        self.kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, keys: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, found: list[np.ndarray], often: list[np.ndarray]) -> None:
        """A range of documents: keys, whether null, lengths, and their numbered terms with counts."""
        b = self.block
        doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
        term, tf = np.concatenate(found).astype(np.int64), np.concatenate(often).astype(np.int64)
        m = 25 + (75 * lengths * self.size) // self.length
        impact = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        n = b.start[term + 1] - b.start[term]
        ends = np.searchsorted(doc, np.arange(len(found)), side="right")
        work = np.concatenate([[0], np.cumsum(n)])[ends]
        first = 0
        while first < len(found):
            done = work[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(work, done + SORTED_AT_ONCE, side="right")))
            lo, hi = (ends[first - 1] if first else 0), ends[last - 1]
            self._sum(keys, nulls, term[lo:hi], doc[lo:hi], impact[lo:hi], n[lo:hi])
            first = last

    def _sum(self, keys: np.ndarray, nulls: np.ndarray, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n: np.ndarray) -> None:
        if not n.sum():
            return
        at = np.repeat(self.block.start[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        packed = self.block.item[at] << 16 | np.repeat(doc, n)
        value = np.repeat(impact, n) * self.block.often[at]
        order = radix_order(packed, 2)
        packed, value = packed[order], value[order]
        start = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
        total, packed = np.add.reduceat(value, start), packed[start]
        packed, total = packed[total > 0], total[total > 0]
        item, doc = packed >> 16, packed & 0xFFFF
        edges = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]])) if len(item) else []
        for lo, hi in zip(edges[:-1], edges[1:]):
            self._offer(int(item[lo]), total[lo:hi], nulls[doc[lo:hi]], keys[doc[lo:hi]])

    def _offer(self, item: int, scores: np.ndarray, nulls: np.ndarray, keys: np.ndarray) -> None:
        if item in self.kept:
            old = self.kept[item]
            if len(old[0]) == self.top:
                some = scores >= old[0][-1]
                scores, nulls, keys = scores[some], nulls[some], keys[some]
            scores, nulls, keys = np.concatenate([old[0], scores]), np.concatenate([old[1], nulls]), np.concatenate([old[2], keys])
        at = best(scores, nulls, keys, self.top)
        self.kept[item] = scores[at], nulls[at], keys[at]


def matched(rows: DataFrame, block: Block, key: str, text: str) -> DataFrame:
    """``(key, n, found, often)``: each document's number of terms, and those of the block with their counts. No shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(block.number)

    def start():
        number = shared.value.get

        def work(texts):
            out: dict[str, list] = {"n": [], "found": [], "often": []}
            for text in texts:
                words = terms(text)
                ids = np.fromiter(map(number, words, repeat(-1)), dtype=np.int64, count=len(words))
                found, often = np.unique(ids[ids >= 0], return_counts=True)
                out["n"].append(len(words))
                out["found"].append(found.astype("<i4").tobytes())
                out["often"].append(often.astype("<i4").tobytes())
            return out

        return work

    plain = rows.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return map_columns(plain, ["text"], ["key"], {"n": pa.int64(), "found": pa.binary(), "often": pa.binary()}, start)


def frequencies(held: DataFrame, block: Block) -> np.ndarray:
    """Documents that hold each term of the block; a task sends one row for each term that it met."""
    size = len(block.number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                flat = b"".join(part.column(0).to_pylist())
                have += np.bincount(np.frombuffer(flat, dtype="<i4"), minlength=size)
        some = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.int64()), pa.array(have[some], type=pa.int64())], names=["term", "n"])

    out = np.zeros(size, dtype=np.int64)
    for r in held.select("found").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def search(rows: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``top`` documents of ``rows`` for each row of ``items``: ``(item_id, rank, key, score)``.

    Scores are whole numbers as in the module's formulas, over the statistics of all rows.
    Only scores above 0 count; equal ones are in the order of the key, null keys last, and
    rows of one key and score are interchangeable. Null and empty texts have no terms and
    are no documents in the counts; items without terms give no rows; repeated rows and
    repeated items stand for themselves. Texts of any length are cut whole. Other columns
    are not read. Keys must be whole numbers, and a key column called like a result column
    is an error. An empty table of either kind gives no rows.

    Items are worked off in blocks of BLOCK_ITEMS; a block's vocabulary is all that travels
    to the tasks, and each block reads the documents once.
    """
    spark = rows.sparkSession
    if not isinstance(rows.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must hold whole numbers")
    if key.lower() in RESULT:
        raise ValueError(f"the key column cannot be called {key}")
    kind = items.schema[item_key].dataType
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("key", T.LongType()), T.StructField("score", T.LongType())])
    out = None
    for block in blocks(items, item_key, item_text):
        held = settle(matched(rows, block, key, text))
        size, length = held.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        if not size or not block.number:
            continue
        shared = spark.sparkContext.broadcast((block, weights(size, frequencies(held, block))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, size=size, length=length) -> Iterator[pa.RecordBatch]:
            sums = Accumulator(*shared.value, size, length, top)
            for batch in batches:
                for part in slices(batch, RANGE):
                    keys = part.column("key")
                    plain = np.asarray(keys.fill_null(0), dtype=np.int64)
                    found = [np.frombuffer(x, dtype="<i4") for x in part.column("found").to_pylist()]
                    often = [np.frombuffer(x, dtype="<i4") for x in part.column("often").to_pylist()]
                    if found:
                        sums.add(plain, np.asarray(keys.is_null()), np.asarray(part.column("n")), found, often)
            for item, (scores, nulls, keys) in sums.kept.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), item)), pa.array(keys, mask=nulls), pa.array(scores)], names=["item", "key", "score"])

        found = held.mapInArrow(run, schema)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(block.ids)), T.StructType([T.StructField("item", T.LongType()), T.StructField("id", kind)]))
        part = ranked.join(names, "item").select(F.col("id").alias("item_id"), "rank", F.col("key").alias(key), "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField(key, T.LongType()), T.StructField("score", T.LongType())]))
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each item of ``benchmark``."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle() -> str:
    return r"""
    WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ts FROM documents),
    q AS (SELECT row_number() OVER () AS item, item_id, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ts FROM benchmark),
    n AS (SELECT row_number() OVER () AS row, doc_id, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
    all_ AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n),
    tf AS (SELECT row, t, count(*)::BIGINT AS tf FROM (SELECT row, unnest(ts) AS t FROM n) GROUP BY ALL),
    w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, all_ GROUP BY t, docs),
    qt AS (SELECT item, item_id, t, count(*)::BIGINT AS often FROM (SELECT item, item_id, unnest(ts) AS t FROM q) GROUP BY ALL),
    s AS (SELECT item, item_id, row, n.doc_id, sum(often * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
          FROM qt JOIN w USING (t) JOIN tf USING (t) JOIN n USING (row), all_ GROUP BY ALL)
    SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, row)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 10
    """
