"""Approximate nearest neighbours by inner product: inverted file, product quantisation, exact reranking.

Cells have centroids that are sums: a coarse centroid and, in large tables, a fine one that
all coarse cells share, so their number grows with the table while what is fitted stays
small. Centroids and the codebooks of the residuals are fitted in numpy on a bounded sample;
every vector is indexed under its cell with the codes of its residual. A query probes the
cells whose centroids are nearest and works out the products of their vectors by asymmetric
distance tables, from the codes alone. Exact products are taken of those only that these
place within reach of the best. How many cells are probed, and what is within reach, is
measured: some sampled queries are held against every vector by brute force; the share
TARGET of their true neighbours must lie in the probed cells, and the share KEPT must have
products that the codes do not put lower than the reach.

Vectors stay where they are indexed; queries travel to the shards that they probe.
Of equal vectors only as many as a result has places can be among the nearest, those
with the least ids; the others are left out of the search beforehand, which keeps groups
of copies small. Equal queries are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import hashed_share, map_columns, settle

NEAREST = 20
#: Vectors that the index is fitted on at most (in expectation); coarse and fine centroids
#: at most, which make two million cells; rows of a cell up to there.
TRAIN_VECTORS = 30_000
MOST_COARSE, MOST_FINE = 2048, 1024
CELL_ROWS = 400
SUBSPACES, CODES = 16, 256
ROUNDS = 8
#: Share of true neighbours that the probed cells must hold, share whose products the codes may not
#: underrate beyond the reach, and the queries that both are measured by.
TARGET, KEPT = 0.96, 0.98
TRIAL_QUERIES = 200
#: Candidates of a query in a shard whose exact product is taken first, for a mark.
RERANK = 32
#: Vectors of a shard, up to the evenness of a hash; queries of a shard that one task takes, and queries searched at once.
SHARD_ROWS, TASK_QUERIES, BLOCK = 8192, 32_768, 256


@dataclass
class Quantiser:
    """Cell ``i * len(fine) + j`` has the centroid ``coarse[i] + fine[j]``."""

    coarse: np.ndarray  # I x dim
    fine: np.ndarray  # J x dim
    codebooks: np.ndarray  # SUBSPACES x CODES x (dim / SUBSPACES)
    probes: int
    reach: float = np.inf  # what the codes may underrate a product by, for a query of length 1

    @property
    def size(self) -> int:
        return len(self.coarse) * len(self.fine)

    def centroids(self, cells: np.ndarray) -> np.ndarray:
        return self.coarse[cells // len(self.fine)] + self.fine[cells % len(self.fine)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        at = _nearest(x, self.coarse)
        return at * len(self.fine) + _nearest(x - self.coarse[at], self.fine)

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = _split(x - self.centroids(cells))
        return np.stack([_nearest(rest[:, m], self.codebooks[m]) for m in range(SUBSPACES)], axis=1).astype(np.uint8)

    def products(self, queries: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """queries x vectors: the products that cells and codes give."""
        out = queries @ self.centroids(cells).T
        tables = self.tables(queries)
        for m in range(SUBSPACES):
            out += tables[:, m][:, codes[:, m]]
        return out

    def order(self, queries: np.ndarray, most: int | None = None) -> np.ndarray:
        """Cells of each query to probe, the nearest centroids, in the order of their numbers.

        The product with a sum is the sum of two products, and a cell among the best ``most``
        has its parts at places of the two orders whose numbers multiply to ``most`` or less.
        """
        most = min(self.probes if most is None else most, self.size)
        first, second = queries @ self.coarse.T, queries @ self.fine.T
        if most == self.size:
            return np.tile(np.arange(self.size), (len(queries), 1))
        a, b = np.argsort(-first, axis=1, kind="stable"), np.argsort(-second, axis=1, kind="stable")
        i, j = np.divmod(np.arange(min(most, a.shape[1]) * min(most, b.shape[1])), min(most, b.shape[1]))
        near = (i + 1) * (j + 1) <= most
        i, j = i[near], j[near]
        out = np.empty((len(queries), most), dtype=np.int64)
        for q in range(len(queries)):
            score = first[q, a[q, i]] + second[q, b[q, j]]
            best = np.argpartition(-score, most - 1)[:most]
            out[q] = np.sort(a[q, i[best]] * len(self.fine) + b[q, j[best]])
        return out

    def places(self, query: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells are nearer to ``query`` than each of ``cells``."""
        every = np.sort(((query @ self.coarse.T)[:, None] + (query @ self.fine.T)[None]).ravel())
        mine = (query @ self.coarse.T)[cells // len(self.fine)] + (query @ self.fine.T)[cells % len(self.fine)]
        return len(every) - np.searchsorted(every, mine, side="right")

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x SUBSPACES x CODES: inner product with every code."""
        return np.einsum("qmd,mcd->qmc", _split(queries), self.codebooks)


def _split(x: np.ndarray) -> np.ndarray:
    """Vectors as SUBSPACES parts, padded with zeros to a multiple."""
    width = -(-x.shape[1] // SUBSPACES)
    padded = np.zeros((len(x), SUBSPACES * width))
    padded[:, : x.shape[1]] = x
    return padded.reshape(len(x), SUBSPACES, width)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = (centres**2).sum(axis=1) / 2
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = (half - x[lo : lo + 4096] @ centres.T).argmin(axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster starts again at a random point."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, centres)
        order = np.argsort(at, kind="stable")
        count = np.bincount(at, minlength=len(centres))
        some = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], (np.cumsum(count) - count)[some], axis=0)
        centres[some] = sums / count[some, None]
        none = np.flatnonzero(count == 0)
        centres[none] = x[rng.integers(len(x), size=len(none))]
    return centres


def fit(sample: np.ndarray, rows: int, seed: int = 0) -> Quantiser:
    """Fit centroids and codebooks for an index of ``rows`` vectors. All cells are probed until ``probes`` is set."""
    rng = np.random.default_rng(seed)
    wanted = max(1, rows // CELL_ROWS)
    coarse = kmeans(sample, int(min(MOST_COARSE, wanted, max(1, len(sample) // 8))), rng)
    rest = sample - coarse[_nearest(sample, coarse)]
    fine = int(min(MOST_FINE, wanted // len(coarse), max(1, len(sample) // 8)))
    fine = kmeans(rest, fine, rng) if fine > 1 else np.zeros((1, sample.shape[1]))
    rest = _split(rest - fine[_nearest(rest, fine)])
    some = rng.permutation(len(rest))[:8192]
    books = np.zeros((SUBSPACES, CODES, rest.shape[2]))
    for m in range(SUBSPACES):
        found = kmeans(rest[some, m], min(CODES, len(some)), rng)
        books[m, : len(found)] = found
        books[m, len(found) :] = found[:1]
    return Quantiser(coarse, fine, books, len(coarse) * len(fine))


def probes_for(quantiser: Quantiser, queries: np.ndarray, found: list[np.ndarray], target: float = TARGET) -> int:
    """Cells to probe so that the share ``target`` of the cells ``found`` (of each query's true neighbours) is among them."""
    depth = np.sort(np.concatenate([np.zeros(0, dtype=np.int64), *[quantiser.places(q, cells) for q, cells in zip(queries, found)]]))
    return quantiser.size if not len(depth) else int(depth[min(len(depth) - 1, int(np.ceil(target * len(depth))))]) + 1


def reach_for(quantiser: Quantiser, queries: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], kept: float = KEPT) -> float:
    """What the codes underrate the products of all but ``1 - kept`` of the true neighbours by, at most.

    ``found`` are cells, codes and exact products of each query's true neighbours.
    """
    under = [(s - quantiser.products(q[None], cells, codes)[0]) / np.linalg.norm(q) for q, (cells, codes, s) in zip(queries, found) if len(s)]
    return float(np.quantile(np.concatenate(under), kept)) if under else np.inf


def search(quantiser: Quantiser, ids: np.ndarray, cells: np.ndarray, codes: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, exact score) of up to ``nearest`` found for each query among these vectors.

    The codes alone say whose exact products are taken.
    """
    order = np.argsort(cells, kind="stable")
    ids, cells, codes, vectors = ids[order], cells[order], codes[order], vectors[order]
    here, starts = np.unique(cells, return_index=True)
    starts = np.append(starts, len(cells))
    probed = quantiser.order(queries)
    place = np.searchsorted(here, probed)
    mine = (place < len(here)) & (here[np.minimum(place, len(here) - 1)] == probed)
    asks, asked = np.nonzero(mine)[0], place[mine]
    approx = np.full((len(queries), len(cells)), -np.inf)
    by_cell = np.argsort(asked, kind="stable")
    edges = np.searchsorted(asked[by_cell], np.arange(len(here) + 1))
    for cell in range(len(here)):
        who = asks[by_cell[edges[cell] : edges[cell + 1]]]
        if len(who):
            lo, hi = starts[cell], starts[cell + 1]
            approx[who, lo:hi] = quantiser.products(queries[who], cells[lo:hi], codes[lo:hi])
    lengths = np.linalg.norm(queries, axis=1)
    found_q, found_v, found_s = [], [], []
    for q in range(len(queries)):
        some = np.flatnonzero(np.isfinite(approx[q]))
        mark = -np.inf
        if len(some) > max(RERANK, nearest):
            first = some[np.argpartition(-approx[q, some], RERANK)[:RERANK]]
            if len(first) >= nearest:
                mark = np.sort((vectors[first] * queries[q]).sum(axis=1))[-nearest]
            some = some[approx[q, some] >= mark - quantiser.reach * lengths[q] - 1e-9 * lengths[q]] if np.isfinite(quantiser.reach) else some
            some = np.union1d(some, first)
        exact = (vectors[some] * queries[q]).sum(axis=1)
        best = np.lexsort((ids[some], -exact))[:nearest]
        found_q.append(np.full(len(best), q))
        found_v.append(ids[some][best])
        found_s.append(exact[best])
    none = np.zeros(0, dtype=np.int64)
    return query_ids[np.concatenate([none, *found_q])], np.concatenate([none, *found_v]), np.concatenate([none.astype(float), *found_s])


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components finite numbers."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, number) & F.exists(vector, lambda v: v != 0), F.lit(False))


def exact_neighbours(vectors: DataFrame, keys: np.ndarray, queries: np.ndarray, nearest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cells, codes and products of the ``nearest`` vectors of each query among all rows of ``vectors`` (v, x, cell, codes), by brute force.

    A task keeps the best of what it reads, so it gives ``nearest`` rows a query at most.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((keys, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = shared.value
        score = np.zeros((len(asked), 0))
        key, cell, code = score.astype(np.int64), score.astype(np.int64), np.zeros((len(asked), 0, SUBSPACES), dtype=np.uint8)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, asked.shape[1])
            v, c = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, SUBSPACES)
            new = np.where(v[None] == own[:, None], -np.inf, asked @ x.T)
            at = np.argsort(-new, axis=1, kind="stable")[:, :nearest]
            score = np.concatenate([score, np.take_along_axis(new, at, axis=1)], axis=1)
            key, cell, code = np.concatenate([key, v[at]], axis=1), np.concatenate([cell, c[at]], axis=1), np.concatenate([code, codes[at]], axis=1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :nearest]
            score, key, cell = (np.take_along_axis(a, best, axis=1) for a in (score, key, cell))
            code = np.take_along_axis(code, best[:, :, None], axis=1)
        q, at = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(key[q, at]), pa.array(score[q, at]), pa.array(cell[q, at]), pa.array([c.tobytes() for c in code[q, at]], type=pa.binary())], names=["q", "v", "s", "cell", "codes"])

    each = vectors.select("v", "x", "cell", "codes").mapInArrow(run, "q long, v long, s double, cell long, codes binary")
    best = each.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "v"))).where(F.col("_r") <= nearest)
    found = best.select("q", "cell", "codes", "s").toPandas()
    at = [np.flatnonzero(found["q"].to_numpy() == q) for q in range(len(queries))]
    codes = np.frombuffer(b"".join(found["codes"]), dtype=np.uint8).reshape(-1, SUBSPACES)
    return [(found["cell"].to_numpy()[i], codes[i], found["s"].to_numpy()[i]) for i in at]


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for each of ``queries``, rows of the same shape as ``vectors``.

    Rows without a key or a usable vector, or of another than the most common length,
    take no part. A vector is no neighbour of the query of its own key. If fewer are
    found than asked, all are returned; none for an empty table. Ties go to smaller keys.
    Rows equal in key and vector count once, as candidates and as queries; different
    vectors of one key are candidates and queries of their own. Other columns are not read.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col(f"`{key}`").cast("long").alias("v"), F.col(f"`{vector}`").alias("x")).where(F.col("v").isNotNull() & usable(F.col("x")))
    lengths = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, rows = lengths["d"], lengths["count"]
    good = good.where(F.size("x") == dim)
    asked = queries.select(F.col(f"`{key}`").cast("long").alias("q"), F.col(f"`{vector}`").cast(vectors.schema[vector].dataType).alias("x")).where(F.col("q").isNotNull() & usable(F.col("x")) & (F.size("x") == dim)).distinct()

    def matrix(values: list) -> np.ndarray:
        return np.array(values, dtype=np.float64).reshape(-1, dim)

    taken = hashed_share(good, F.xxhash64("v", "x"), TRAIN_VECTORS).orderBy("v", "x").toPandas()
    sample = matrix(taken["x"].to_list())
    quantiser = fit(sample, rows)
    unprobed = spark.sparkContext.broadcast(quantiser)

    one_more = nearest + 1
    ranked = F.row_number().over(Window.partitionBy("x").orderBy("v"))
    once = good.distinct().withColumn("_r", ranked).where(F.col("_r") <= one_more).select("v", "x")

    def start():
        q = unprobed.value

        def work(values):
            x = matrix(values)
            cells = q.cells(x)
            return {"cell": cells, "codes": [c.tobytes() for c in q.codes(x, cells)]}

        return work

    indexed = settle(map_columns(once, ["x"], ["v", "x"], {"cell": pa.int64(), "codes": pa.binary()}, start))
    trial = np.random.default_rng(1).permutation(len(sample))[:TRIAL_QUERIES]
    true = exact_neighbours(indexed, taken["v"].to_numpy()[trial], sample[trial], nearest)
    quantiser.probes = probes_for(quantiser, sample[trial], [cells for cells, _, _ in true])
    quantiser.reach = reach_for(quantiser, sample[trial], true)
    shared = spark.sparkContext.broadcast(quantiser)

    # cells go to shards of even size; large ones are split by a hash. There are at most MOST_COARSE * MOST_FINE cells
    counts = indexed.groupBy("cell").count().toPandas().sort_values("cell")
    cells, last, parts = counts["cell"].to_numpy(), [], []
    shards, room = 0, 0
    for n in counts["count"].tolist():
        whole = -(-n // SHARD_ROWS)
        if n > room:
            shards, room = shards + whole, SHARD_ROWS
        last.append(shards - 1)
        parts.append(whole)
        room -= min(room, n)
    slots = spark.sparkContext.broadcast((cells, np.array(last, dtype=np.int64), np.array(parts, dtype=np.int64)))

    def begin_place():
        known, end, split = slots.value

        def work(ids, at):
            i = np.searchsorted(known, np.array(at, dtype=np.int64))
            mixed = np.array(ids, dtype=np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            return {"shard": end[i] - (mixed % split[i].astype(np.uint64)).astype(np.int64)}

        return work

    placed = map_columns(indexed, ["v", "cell"], ["v", "x", "cell", "codes"], {"shard": pa.int64()}, begin_place)

    classes = settle(asked.select("x").distinct()).withColumn("k", F.monotonically_increasing_id())

    def begin_probe():
        q = shared.value
        known, end, split = slots.value

        def shards_of(probed: np.ndarray) -> list[int]:
            i = np.searchsorted(known, probed)
            i = i[(i < len(known)) & (known[np.minimum(i, len(known) - 1)] == probed)]
            n = split[i]
            return np.unique(np.repeat(end[i] - n + 1, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)).tolist()

        def work(values):
            x = matrix(values)
            return {"shards": [shards_of(row) for lo in range(0, len(x), BLOCK) for row in q.order(x[lo : lo + BLOCK])]}

        return work

    probing = map_columns(classes, ["x"], ["k", "x"], {"shards": pa.list_(pa.int64())}, begin_probe).select("k", "x", F.explode("shards").alias("shard"))
    # a shard is copied only where its queries are too many for a task
    tasks = probing.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / TASK_QUERIES).alias("tasks"))
    many = spark.createDataFrame([(r["shard"], r["tasks"]) for r in tasks.where("tasks > 1").collect()], "shard long, tasks long")
    left = placed.join(many, "shard", "left").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("tasks", F.lit(1).cast("long")) - 1))).drop("tasks")
    right = probing.join(many, "shard", "left").withColumn("task", F.pmod(F.xxhash64("k"), F.coalesce("tasks", F.lit(1).cast("long")))).drop("tasks")

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"k": [], "v": [], "s": []}).astype({"k": "int64", "v": "int64"})
        if not len(left) or not len(right):
            return none
        codes = np.frombuffer(b"".join(left["codes"]), dtype=np.uint8).reshape(-1, SUBSPACES)
        ids, at, x = left["v"].to_numpy(), left["cell"].to_numpy(), matrix(left["x"].to_list())
        out = [none]
        for lo in range(0, len(right), BLOCK):
            some = right.iloc[lo : lo + BLOCK]
            k, v, s = search(shared.value, ids, at, codes, x, some["k"].to_numpy(), matrix(some["x"].to_list()), one_more)
            out.append(pd.DataFrame({"k": k, "v": v, "s": s}))
        return pd.concat(out)

    found = left.groupBy("shard", "task").cogroup(right.groupBy("shard", "task")).applyInPandas(find, "k long, v long, s double")
    best = found.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("s"), "v"))).where(F.col("_r") <= one_more)
    lists = best.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("_r", "v", "s"))).alias("found"))  # nearest + 1 of them at most
    members = asked.join(classes, "x").select("q", "k")
    mine = members.join(lists, "k").select("q", F.slice(F.filter("found", lambda f: f["v"] != F.col("q")), 1, nearest).alias("found"))
    return mine.select(F.col("q").alias("query_id"), F.posexplode("found").alias("rank", "f")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("f.v").alias("vec_id"), F.col("f.s").alias("score"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0))
