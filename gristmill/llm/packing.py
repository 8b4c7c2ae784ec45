"""Lexical retrieval packing: windows filled with texts that share rare tokens.

Documents are dealt by topic into shards of bounded size: a tree of centroids, fitted on
a sample of projected tf-idf vectors, has leaves of related documents; adjacent leaves
fill a shard, and a leaf larger than a shard is dealt evenly over several. Each shard has
its own inverted index over token ids, with the document frequencies, the number and
the mean length of the whole table's documents in BM25. Whole windows of long documents
stand alone; what is left of each document waits in a pool. The largest part of the pool seeds a window, and
the index returns the unused neighbours that score highest for it, which fill the
window greedily; the one that overflows it is cut, and its rest stays in the pool. So
only a shard's last window can need padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.ann import _nearest, kmeans
from gristmill.llm.common import hashed_share, map_columns, settle

WINDOW = 2048
#: Bytes of a shard, two for each id, about what the text has; each row counts for ROW_BYTES more, which bounds a shard's rows.
SHARD_BYTES = 1_500_000
ROW_BYTES = 1024
#: Shards have numbers below SHARD_STEP windows apart.
SHARD_STEP = 1 << 32
#: Shards that a task works through, one by one, so that tasks stay even as the table grows.
SHARDS_PER_TASK = 32
K1, B = 1.2, 0.75
END = 1
#: Columns of a piece, besides its document's key.
PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: Dimensions of a document's projected vector, vectors that topics are fitted on at most (in expectation), topics for a shard and topics at most.
DIMENSIONS = 128
TRAIN_DOCUMENTS = 32_000
SHARD_TOPICS, MOST_TOPICS = 8, 4096


def byte_alphabet() -> dict[str, int]:
    """Character -> byte in byte-level vocabularies: printable Latin-1 stands for itself,
    the other bytes, ascending, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a byte-level BPE ``tokenizer.json`` whose ids are its merge ranks.

    Its ids are those of the ``tokenizers`` library with its defaults and without tokens
    around a text (tests hold them against it), at a quarter of the time. Strings of added
    tokens within a text get their own ids, as there.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if any(t[flag] for t in spec.get("added_tokens", []) for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that depend on their surroundings are not supported")
    to_byte = byte_alphabet()
    ranks = {bytes(map(to_byte.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def encode(texts: list[str | None], tokens: tiktoken.Encoding) -> list[np.ndarray]:
    """Ids of each whole text, then the end id."""
    end = np.array([END], dtype="<u4")
    return [np.concatenate([tokens.encode_to_numpy(t, allowed_special="all"), end]) if t else end for t in texts]


@dataclass
class Corpus:
    """What BM25 needs of a whole table: documents, their mean length, and for each token the documents that have it."""

    size: int
    mean: float
    have: np.ndarray

    def idf(self) -> np.ndarray:
        return np.log((self.size - self.have + 0.5) / (self.have + 0.5))


def pairs_of(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, document, occurrences) of all distinct tokens of each document, by token."""
    owner = np.repeat(np.arange(len(parts), dtype=np.uint64), [len(p) for p in parts])
    pairs, often = np.unique(np.concatenate(parts).astype(np.uint64) << np.uint64(32) | owner, return_counts=True)
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), often


def walk(centres: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``centres`` in an order where neighbours are close: from ``start`` always to the nearest one not seen yet."""
    order, rest, at = [], np.ones(len(centres), dtype=bool), start
    for _ in range(len(centres)):
        order.append(int(np.where(rest, centres @ at, -np.inf).argmax()))
        rest[order[-1]], at = False, centres[order[-1]]
    return centres[order]


class Topics:
    """Leaves of a two-level tree of centroids over documents' projected tf-idf vectors, numbered so that related ones are adjacent."""

    def __init__(self, corpus: Corpus):
        rng = np.random.default_rng(0)
        self.weight = np.maximum(corpus.idf(), 0) * rng.choice([-1.0, 1.0], size=len(corpus.have))
        self.place = rng.integers(0, DIMENSIONS, size=len(corpus.have))
        self.top = np.zeros((1, DIMENSIONS))
        self.below = [np.zeros((1, DIMENSIONS))]

    def vectors(self, parts: list[np.ndarray]) -> np.ndarray:
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        flat = np.concatenate([np.zeros(0, dtype="<u4"), *parts])
        x = np.bincount(owner * DIMENSIONS + self.place[flat], weights=self.weight[flat], minlength=len(parts) * DIMENSIONS).reshape(-1, DIMENSIONS)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def fit(self, sample: np.ndarray, leaves: int) -> None:
        leaves = max(1, min(leaves, MOST_TOPICS, len(sample) // 8))
        rng = np.random.default_rng(1)
        self.top = walk(kmeans(sample, max(1, round(leaves**0.5)), rng), np.zeros(DIMENSIONS))
        at = _nearest(sample, self.top)
        self.below = []
        for k in range(len(self.top)):
            mine = sample[at == k]
            here = max(1, round(leaves * len(mine) / len(sample)))
            self.below.append(walk(kmeans(mine, min(here, len(mine)), rng), self.top[k - 1] if k else self.top[k]) if len(mine) else self.top[k : k + 1])

    def leaves(self, parts: list[np.ndarray]) -> np.ndarray:
        x = self.vectors(parts)
        at, out, base = _nearest(x, self.top), np.zeros(len(x), dtype=np.int64), 0
        for k, centres in enumerate(self.below):
            mine = np.flatnonzero(at == k)
            if len(mine):
                out[mine] = base + _nearest(x[mine], centres)
            base += len(centres)
        return out


class Index:
    """BM25 postings of one shard: for every token, the documents that have it and its weight there.

    Frequencies, number and mean length are those of ``corpus``, or of the shard itself
    without one. Tokens in over half the documents have no positive idf and no postings.
    """

    def __init__(self, parts: list[np.ndarray], corpus: Corpus | None = None):
        self.size = len(parts)
        term, doc, often = pairs_of(parts)
        start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        have = np.diff(np.concatenate([start, [len(term)]]))
        idf = corpus.idf()[term[start]] if corpus else np.log((self.size - have + 0.5) / (have + 0.5))
        keep = np.repeat(idf > 0, have)
        sizes = np.array([len(p) for p in parts], dtype=np.float64)
        norm = K1 * (1 - B + B * sizes / (corpus.mean if corpus else sizes.mean()))
        weight = np.repeat(idf, have) * often * (K1 + 1) / (often + norm[doc])
        self.doc, self.weight = doc[keep], weight[keep]
        have = have[idf > 0]
        self.start = np.concatenate([[0], np.cumsum(have)])
        number = np.repeat(np.arange(len(have)), have)
        by_doc = np.argsort(self.doc, kind="stable")
        self.terms = number[by_doc]
        self.terms_of = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=self.size))])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the distinct tokens of ``seed``."""
        terms = self.terms[self.terms_of[seed] : self.terms_of[seed + 1]]
        first, have = self.start[terms], self.start[terms + 1] - self.start[terms]
        before = np.cumsum(have) - have
        at = np.repeat(first - before, have) + np.arange(int(have.sum()))
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.size)


def remainder(ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """What is left of a document behind its whole windows."""
    return ids[len(ids) // window * window :]


def pack(parts: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover every id of every document once."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    size = np.array([len(p) for p in parts], dtype=np.int64)
    done = size // window * window
    for doc in np.flatnonzero(done).tolist():
        for start in range(0, int(done[doc]), window):
            pieces.append((doc, start, window, sequence, 0))
            sequence += 1
    pool = np.flatnonzero(size > done)
    if not len(pool):
        return pieces
    index = Index([remainder(parts[d], window) for d in pool], corpus)
    left = size[pool] - done[pool]
    total = size[pool]
    filled = 0

    def take(k: int) -> None:
        nonlocal filled
        n = int(min(left[k], window - filled))
        pieces.append((int(pool[k]), int(total[k] - left[k]), n, sequence, filled))
        left[k] -= n
        filled += n

    for seed in np.argsort(-left, kind="stable").tolist():
        while left[seed]:
            filled = 0
            take(seed)
            if filled < window:
                score = np.where(left > 0, index.scores(seed), -1.0)
                for k in np.argsort(-score, kind="stable").tolist():
                    if filled == window or not left[k]:
                        break
                    take(k)
            sequence += 1
    return pieces


def parts_of(ids: list[bytes], window: int, kind: str) -> list[np.ndarray]:
    return [remainder(np.frombuffer(i, dtype=kind), window) for i in ids]


def count_corpus(encoded: DataFrame, window: int = WINDOW, kind: str = "<u4") -> Corpus:
    """Frequencies over the pool of the whole table: what documents leave behind their whole windows. One aggregate."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, size, total = np.zeros(0, dtype=np.int64), 0, 0
        for batch in batches:
            parts = [p for p in parts_of(batch.column(0).to_pylist(), window, kind) if len(p)]
            if parts:
                found = np.bincount(pairs_of(parts)[0], minlength=len(have))
                found[: len(have)] += have
                have, size, total = found, size + len(parts), total + sum(map(len, parts))
        some = np.flatnonzero(have)
        # the numbers -1 and -2 stand for the documents and for their length
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], type=pa.int64()), pa.array([size, total, *have[some].tolist()], type=pa.int64())], names=["token", "n"])

    found = encoded.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(found["token"].tolist(), found["n"].tolist()))
    size, total = n.pop(-1, 0), n.pop(-2, 0)
    have = np.zeros(max(n, default=0) + 1, dtype=np.int64)
    have[list(n)] = list(n.values())
    return Corpus(size, total / max(1, size), have)


def deal(encoded: DataFrame, corpus: Corpus, shard_bytes: int = SHARD_BYTES, window: int = WINDOW, kind: str = "<u4") -> tuple[DataFrame, int]:
    """``encoded`` with a ``shard``, and the number of shards: adjacent leaves of the topic tree together, large leaves over several.

    Which of a large leaf's shards takes a row follows the row's number, so repeated rows are spread too.
    """
    spark = encoded.sparkSession
    width = np.dtype(kind).itemsize
    weigh = (F.octet_length("ids") / width * 2 + ROW_BYTES).cast("long")
    weight = encoded.agg(F.sum(weigh)).first()[0] or 0
    if weight <= shard_bytes:
        return encoded.withColumn("shard", F.lit(0).cast("long")), 1
    topics = Topics(corpus)
    plain = spark.sparkContext.broadcast(topics)

    def project():
        return lambda ids: {"x": [v.tobytes() for v in plain.value.vectors(parts_of(ids, window, kind)).astype("<f4")]}

    # documents without a remainder are in no pool and need no topic
    pooled = encoded.where(F.octet_length("ids") % (width * window) != 0)
    sample = map_columns(hashed_share(pooled, F.col("row"), TRAIN_DOCUMENTS), ["ids"], ["ids"], {"x": pa.binary()}, project).select("x", F.xxhash64("ids").alias("h")).toPandas().sort_values(["h", "x"])["x"]
    if len(sample):
        topics.fit(np.stack([np.frombuffer(x, dtype="<f4") for x in sample]).astype(np.float64), SHARD_TOPICS * -(-weight // shard_bytes))
    fitted = spark.sparkContext.broadcast(topics)

    def place():
        return lambda ids: {"leaf": fitted.value.leaves(parts_of(ids, window, kind))}

    leaved = map_columns(encoded, ["ids"], ["key", "ids", "row"], {"leaf": pa.int64()}, place)
    sizes = {r["leaf"]: r["n"] for r in leaved.groupBy("leaf").agg(F.sum(weigh).alias("n")).collect()}
    homes, shards, room = [], 0, 0
    for leaf in sorted(sizes):
        n = max(1, -(-sizes[leaf] // shard_bytes))
        if n > 1 or sizes[leaf] > room:
            shards, room = shards + n, n * shard_bytes
        room = 0 if n > 1 else room - sizes[leaf]
        homes.append((leaf, shards - 1, n))
    at = F.broadcast(spark.createDataFrame(homes, "leaf long, last long, parts long"))
    return leaved.join(at, "leaf").select("key", "ids", (F.col("last") - F.pmod(F.xxhash64("row"), F.col("parts"))).alias("shard")), shards


def pack_documents(rows: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each piece of each document: ``key`` and the columns of ``PIECE``.

    Null and empty texts are the end id alone. Repeated rows and rows without a key are
    documents of their own. A text of any length is encoded whole; its whole windows stand
    alone, and its task holds its ids once. Documents of equal rank take turns by key, then
    ids. Other columns of ``rows`` are not read; a key column called like one of ``PIECE``
    is an error. Texts are encoded once; one shuffle, by topic. The number of shards follows
    the bytes of the table, so a shard's work is the same at any size. An empty table gives
    no rows.
    """
    if key.lower() in PIECE:
        raise ValueError(f"the key column cannot be called {key}")
    # the key travels as text, which keeps large integers next to nulls exact
    plain = rows.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"))

    kind = "<u2" if tokenizer(path, pattern).n_vocab <= 1 << 16 else "<u4"  # as ids are stored

    def start():
        tokens = tokenizer(path, pattern)
        return lambda texts: {"ids": [p.astype(kind).tobytes() for p in encode(texts, tokens)]}

    # the row's number is taken from the settled table, whose partitions stay as they are
    encoded = settle(map_columns(plain, ["text"], ["key"], {"ids": pa.binary()}, start)).withColumn("row", F.monotonically_increasing_id())
    corpus = count_corpus(encoded, window, kind)
    shared = rows.sparkSession.sparkContext.broadcast(corpus)
    dealt, shards = deal(encoded, corpus, shard_bytes, window, kind)
    schema = "key string, " + ", ".join(f"{c} long" for c in PIECE)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "ids"], na_position="first", kind="stable")
        parts = [np.frombuffer(i, dtype=kind).astype("<u4") for i in pdf["ids"]]
        keys, base = pdf["key"].tolist(), int(pdf["shard"].iloc[0]) * SHARD_STEP
        found = pack(parts, window, shared.value)
        return pd.DataFrame(
            {
                "key": pd.Series([keys[d] for d, *_ in found], dtype=object),
                "start": [start for _, start, *_ in found],
                "length": [n for _, _, n, _, _ in found],
                "ids_crc32": [zlib.crc32(parts[d][start : start + n].tobytes()) for d, start, n, _, _ in found],
                "doc_tokens": [len(parts[d]) for d, *_ in found],
                "sequence_id": [base + s for _, _, _, s, _ in found],
                "offset": [at for *_, at in found],
            }
        )

    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // SHARDS_PER_TASK))
    out = dealt.repartition(tasks, "shard").groupBy("shard").applyInPandas(run, schema)
    return out.select(F.col("key").cast(rows.schema[key].dataType).alias(key), *[c for c in out.columns if c != "key"])


def op6_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens that hold every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
