"""Exact nearest vectors from stored cells: the triangle inequality leaves out what cannot be near.

Every unit vector lies in the cell of its nearest centre, with its distance from it. Written
as Parquet by cell and distance, the files' own statistics bound each row group. A vector
whose distance to its centre differs from the query's by more than the k-th best distance is
farther than that, whatever the centre; so a question reads, of each cell, a band of
distances. Nothing is approximate: what is not read cannot be among the best.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.columns import qcol
from gristmill.functions.text import cosine
from gristmill.operators.retrieval import FETCH

#: Vectors in a cell aimed at, cells at most, vectors that centres are fitted on at most, rounds of fitting.
CELL, MOST_CELLS, SAMPLE, ROUNDS = 512, 1024, 20_000, 8
#: Cells that set the mark, and what rounding may add to a distance.
FIRST, SLACK = 4, 2e-3


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = np.asarray(vectors, dtype=np.float64)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def fit(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> np.ndarray:
    """Centres of the cells, from a bounded sample chosen by a hash of the key."""
    live = rows.where(qcol(vector).isNotNull())
    n = live.count()
    share = SAMPLE / max(n, 1)
    some = live if share >= 1 else live.where(F.pmod(F.xxhash64(qcol(key), F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = [r[0] for r in some.orderBy(F.xxhash64(qcol(key), F.lit(9))).select(qcol(vector)).limit(SAMPLE).collect()]
    if not found:
        return np.zeros((0, 0))
    x = unit(np.array(found))
    cells = int(np.clip(n // CELL, 1, min(MOST_CELLS, len(x))))
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        at = nearest(x, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        size = np.bincount(at, minlength=cells)[:, None]
        centres = np.where(size > 0, sums / np.maximum(size, 1), centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]
    at = square.argmin(1)
    return at, np.linalg.norm(x - centres[at], axis=1)


def placed(rows: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``rows`` with ``cell`` and ``apart``, the distance of the unit vector from the cell's centre; null and zero vectors have neither."""
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("apart", T.DoubleType())])
    place = rows.columns.index(vector)
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                cell: list[int | None] = [None] * batch.num_rows
                apart: list[float | None] = [None] * batch.num_rows
                vectors = batch.column(place).to_pylist()
                live = [i for i, v in enumerate(vectors) if v is not None and all(x is not None for x in v) and any(v)]
                if live:
                    at, far = nearest(unit(np.array([vectors[i] for i in live])), shared.value)
                    for i, a, f in zip(live, at.tolist(), far.tolist()):
                        cell[i], apart[i] = a, f
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(apart, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def write(rows: DataFrame, path: str) -> None:
    """Placed vectors by cell and distance, in row groups small enough to be skipped."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(tasks, "cell", "apart").sortWithinPartitions("cell", "apart").write.option("parquet.block.size", str(4 << 20)).parquet(path)


def summary(rows: DataFrame) -> DataFrame:
    """``(cell, n, low, high)``: the number of vectors of each cell and the band of their distances."""
    return rows.where("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("apart").alias("low"), F.max("apart").alias("high"))


def bands(cells: Sequence[Sequence], centres: np.ndarray, query: np.ndarray, reach: float) -> list[tuple[int, float, float]]:
    """``(cell, from, to)``: the distances from each centre at which a vector within ``reach`` of the query may lie."""
    out = []
    for cell, _, low, high in cells:
        d = float(np.linalg.norm(query - centres[cell]))
        lo, hi = max(low, d - reach), min(high, d + reach)
        if lo <= hi:
            out.append((cell, lo, hi))
    return out


def within(rows: DataFrame, wanted: Sequence[tuple[int, float, float]]) -> DataFrame:
    """The vectors of the bands; there are MOST_CELLS at most. The filter on cells and the widest band reaches the scan."""
    if not wanted:
        return rows.where(F.lit(False))
    near = rows.where(F.col("cell").isin([c for c, *_ in wanted]) & F.col("apart").between(min(lo for _, lo, _ in wanted), max(hi for *_, hi in wanted)))
    each = F.broadcast(rows.sparkSession.createDataFrame([(int(c), float(lo), float(hi)) for c, lo, hi in wanted], "cell int, from_ double, to_ double"))
    return near.join(each, "cell").where(F.col("apart").between(F.col("from_"), F.col("to_"))).drop("from_", "to_")


def exact_topk(rows: DataFrame, centres: np.ndarray, cells: Sequence[Sequence], query: Sequence[float], k: int = FETCH, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, score)``: the ``k`` placed vectors of the greatest cosine, ties by id, as a full scan gives them.

    ``cells`` are the rows of ``summary``. The cells nearest to the query give a first mark;
    every vector that can reach it is then read.
    """
    q = np.asarray(query, dtype=np.float64)
    asked = F.array(*[F.lit(float(v)) for v in q])

    def best(some: DataFrame) -> DataFrame:
        return some.select(qcol(key).alias("id"), F.round(cosine(qcol(vector), asked), 6).alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(k)

    if not len(cells) or not np.linalg.norm(q):
        return best(rows.where(F.lit(False)))
    q = q / np.linalg.norm(q)
    near = sorted(cells, key=lambda c: float(np.linalg.norm(q - centres[c[0]])))
    first, held = [], 0
    while len(first) < len(near) and (len(first) < FIRST or held < k):
        first.append(near[len(first)])
        held += first[-1][1]
    top = best(within(rows, bands(first, centres, q, np.inf))).collect()
    # the distance of unit vectors is the root of twice what their cosine lacks
    reach = np.sqrt(max(0.0, 2 - 2 * top[k - 1]["score"])) + SLACK if len(top) >= k else np.inf
    return best(within(rows, bands(cells, centres, q, reach)))
