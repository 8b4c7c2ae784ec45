"""Document quality by Bradley-Terry pairwise ranking.

Every text gets a vector of its whole content: some shape features, and the counts of its
words and of its byte 4-grams, hashed into HASHED places with signs. All labelled rows are
dealt into blocks, where each meets rows of the other class in preference pairs (a good
text against a poor one); a linear score is learnt by logistic loss on the pairs' feature
differences. A score becomes a number between 0 and 1 whose acceptance mark sits at a
quantile of the training scores: the share of poor texts among the labelled rows.

Training is a number of passes over the blocks. Each pass sums some arrays (counts, moments,
the loss with its derivatives) over them, where they are; only the sums come to the driver.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import id_crc, map_columns, settle, slices

#: Labelled rows of a block (in expectation), and its preference pairs at least.
BLOCK_ROWS, PAIRS = 4096, 2048
#: Newton steps at most, and the decrement that ends them.
STEPS, SETTLED = 40, 1e-6
#: How strongly weights are drawn to 0; rows of the matrix of second derivatives that are summed in one place.
DECAY, PANEL = 1e-3, 64
#: Labels whose side of a join is broadcast at most, and bits of the map that stands for more of them: for each, and in all.
BROADCAST_LABELS, LABEL_BITS, MOST_BITS = 250_000, 16, 1 << 27
#: Bits of a value that each pass of a search for its rank settles.
RADIX = (11, 11, 10)
ACCEPT = 0.7
#: Places that words and 4-grams are hashed to, and their share in a vector's scale beside shape features.
HASHED, CONTENT = 512, 0.25
#: Quantile knots for the hinge terms that let a feature's effect bend.
KNOTS = (0.05, 0.25, 0.75, 0.95)

FEATURES = (
    "log_words", "word_length", "distinct_words", "same_as_previous", "upper", "digits", "marks", "bars",
    "exclamations", "other_bytes", "stops", "line_words", "repeated_lines", "longest_word", "blank",
)

_STOPS = [ord(c) for c in ".,;:?"]
_MARKS = [ord(c) for c in "#$%&*@^~<>{}[]\\/=+_"]


def features(text: str | None) -> list[float]:
    """Shape of a whole text; an empty or null text has the features of no words."""
    words = (text or "").split()
    if not words:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    raw = text.encode("utf-8", "replace")
    n = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    count = len(words)
    lines = [x for x in text.split("\n") if x]
    letters = max(1, int(n[65:91].sum() + n[97:123].sum()))
    return [
        math.log1p(count),
        (len(raw) - int(n[[9, 10, 13, 32]].sum())) / count,
        len(set(words)) / math.sqrt(count),
        sum(map(eq, words, words[1:])) / count,
        int(n[65:91].sum()) / letters,
        int(n[48:58].sum()) / len(raw),
        int(n[_MARKS].sum()) / count,
        int(n[124]) / count,
        int(n[33]) / count,
        int(n[128:].sum()) / len(raw),
        int(n[_STOPS].sum()) / count,
        math.log1p(count / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(max(map(len, words))),
        0.0,
    ]


def content(text: str | None) -> np.ndarray:
    """Words and byte 4-grams of a whole text, hashed, damped and of unit length; zeros without words."""
    out = np.zeros(HASHED)
    words = (text or "").lower().split()
    if not words:
        return out
    hashed = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), dtype=np.int64, count=len(words))
    out += np.bincount(hashed % HASHED, weights=1 - 2 * (hashed >> 31), minlength=HASHED)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    if len(raw) >= 4:
        gram = (raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)) * np.uint32(0x9E3779B1)
        gram = ((gram ^ gram >> np.uint32(15)) * np.uint32(0x85EBCA77)).astype(np.int64)
        out += np.bincount((gram >> 22) % HASHED, weights=1 - 2 * (gram >> 5 & 1), minlength=HASHED)
    out = np.sign(out) * np.log1p(np.abs(out))
    return out / max(1e-12, float(np.linalg.norm(out)))


def vector(text: str | None) -> np.ndarray:
    """Shape features, then the content, of a text."""
    return np.concatenate([features(text), content(text)]).astype(np.float32)


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([vector(t) for t in texts], dtype=np.float32).reshape(-1, len(FEATURES) + HASHED)


@dataclass
class Ranker:
    knots: np.ndarray  # features x KNOTS
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    mark: float
    spread: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(bent(x, self.knots))

    def scaled(self, raw: np.ndarray) -> np.ndarray:
        """``raw`` itself, scaled in place."""
        raw -= self.mean
        raw /= self.scale
        return np.clip(raw, -6, 6, out=raw)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (self.expand(x) @ self.weights.astype(np.float32)).astype(np.float64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, growing with the strength, exactly ACCEPT at the mark."""
        z = (self.strength(x) - self.mark) / self.spread + math.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def bent(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Vectors with hinges for the shape features, between these and the content."""
    shape, n = x[:, : len(FEATURES)], len(FEATURES)
    out = np.empty((len(x), n * (1 + len(KNOTS)) + HASHED), dtype=np.float32)
    out[:, :n] = shape
    out[:, n:-HASHED] = np.maximum(shape[:, :, None] - knots[None], 0).reshape(len(x), -1)
    out[:, -HASHED:] = x[:, n:]
    return out


def gradient(gap: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gradient of the mean logistic loss of feature differences (better less worse) and of the decay."""
    loss = 1 / (1 + np.exp(np.clip(gap @ weights, -40, 40)))
    return -(loss @ gap) / len(gap) + DECAY * weights


def curvature(gap: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Second derivatives of the mean logistic loss of feature differences and of the decay."""
    loss = 1 / (1 + np.exp(np.clip(gap @ weights, -40, 40)))
    bowed = gap * np.sqrt(loss * (1 - loss)).astype(gap.dtype)[:, None]
    return (bowed.T @ bowed).astype(np.float64) / len(gap) + DECAY * np.eye(len(weights))


#: What a pass computes of a block (vectors, and which are good): arrays by number.
Work = Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]
#: A pass: the sums of the arrays of each number over all blocks.
Passes = Callable[[Work], dict[int, np.ndarray]]


def summed(found: Iterator[tuple[int, np.ndarray]], into: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    for number, part in found:
        into[number] = into[number] + part if number in into else part.astype(np.float64)
    return into


def pairs_of(good: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(better, worse, turns): each row of the larger class meets a row of the other one in each of ``turns``
    turns, whose rows take turns. A class without rows has the place behind all rows."""
    rng = np.random.default_rng(seed)
    better, worse = (np.flatnonzero(g) if g.any() else np.array([len(good)]) for g in (good, ~good))
    each = max(len(better), len(worse))
    turns = -(-PAIRS // each)
    ends = [np.concatenate([np.resize(rng.permutation(side), each) for _ in range(turns)]) for side in (better, worse)]
    return ends[0], ends[1], turns


def by_rank(passes: Passes, values: Callable[[np.ndarray], np.ndarray], columns: int, places: Callable[[int], Sequence[float]]) -> np.ndarray:
    """Values at ``places(n)`` (from 0; between two ranks: interpolated) of each of ``columns`` sorted columns of
    n float32 ``values``, exactly: the bits of a value are settled from the highest on by counting."""
    left, shift = {}, 32
    targets = [(c, 0) for c in range(columns)]
    for bits in RADIX:
        shift -= bits

        def work(x, good, targets=targets, shift=shift, bits=bits):
            raw = (values(x).astype(np.float32) + np.float32(0)).view(np.uint32).astype(np.int64)
            code = np.where(raw >> 31, raw ^ 0xFFFFFFFF, raw | 1 << 31)
            for j, (c, high) in enumerate(targets):
                mine = code[:, c]
                yield j, np.bincount(mine[mine >> (shift + bits) == high] >> shift & (1 << bits) - 1, minlength=1 << bits)

        below = [np.cumsum(n) for _, n in sorted(passes(work).items())]
        if not left:
            at = places(int(below[0][-1]))
            left = {(c, rank): (0, rank) for c in range(columns) for p in at for rank in (math.floor(p), math.ceil(p))}
        for (c, rank), (high, rest) in left.items():
            sums = below[targets.index((c, high))]
            cell = int(np.searchsorted(sums, rest, side="right"))
            left[c, rank] = (high << bits | cell, rest - int(sums[cell - 1] if cell else 0))
        targets = sorted({(c, high) for (c, _), (high, _) in left.items()})

    def value(c: int, rank: int) -> float:
        code = left[c, rank][0]
        return float(np.uint32(code & 0x7FFFFFFF if code >> 31 else code ^ 0xFFFFFFFF).view(np.float32))

    return np.array([[value(c, math.floor(p)) + (value(c, math.ceil(p)) - value(c, math.floor(p))) * (p - math.floor(p)) for p in at] for c in range(columns)])


def learn(passes: Passes, seed: int = 0) -> Ranker:
    """Learn strengths from the pairs of all blocks, of which at least one has a row. With one class
    only all weights are 0 and the mark accepts everything if that class is the good one.

    Scores that tie at the mark are accepted."""
    knots = by_rank(passes, lambda x: x[:, : len(FEATURES)], len(FEATURES), lambda n: [q * (n - 1) for q in KNOTS])

    def moments(x, good):
        raw = bent(x, knots).astype(np.float64)
        yield 0, np.array([len(raw), good.sum()])
        yield 1, raw.sum(axis=0)
        yield 2, (raw * raw).sum(axis=0)
        yield 3, raw[good].sum(axis=0)

    found = passes(moments)
    (n, n_good), mean = found[0], found[1] / found[0][0]
    spread = np.sqrt(np.maximum(found[2] / n - mean * mean, 0))
    ranker = Ranker(knots, mean.astype(np.float32), np.where(spread > 1e-6, spread, 1.0).astype(np.float32), np.zeros(len(mean)), 0.0, 1.0)
    ranker.scale[-HASHED:] /= CONTENT
    if n_good in (0, n):
        ranker.mark = 0.0 if n_good else 1.0
        return ranker
    means = ranker.scaled(np.array([found[3] / n_good, (found[1] - found[3]) / (n - n_good)], dtype=np.float32))

    def derived(x, good, weights):
        # the place behind all rows: a class that has none in the block is there by its mean
        z = np.concatenate([ranker.expand(x), means[[int(good.all())]] if good.all() or not good.any() else means[:0]])
        better, worse, turns = pairs_of(good, seed)
        gap, share = z[better] - z[worse], len(better) / turns
        yield -1, share * gradient(gap, weights)
        yield -2, share * np.array([1.0, np.logaddexp(0, -(gap @ weights)).mean() + DECAY / 2 * weights @ weights])
        bow = share * curvature(gap, weights)
        for at in range(0, len(bow), PANEL):
            yield at, bow[at : at + PANEL]

    weights, best, step = ranker.weights, math.inf, ranker.weights
    for _ in range(STEPS):
        got = passes(lambda x, good, weights=weights: derived(x, good, weights))
        total, loss = got.pop(-2)
        if loss / total > best:
            step = step / 2  # too far
        else:
            ranker.weights, best, grad = weights, loss / total, got.pop(-1) / total
            step = np.linalg.solve(np.concatenate([got[at] for at in sorted(got) if at >= 0]) / total, grad)
            if grad @ step < SETTLED:
                break
        weights = ranker.weights - step
    strengths = lambda x: ranker.strength(x)[:, None]
    at = min(n - 1, max(1, round(n - n_good)))
    ranker.mark = float(by_rank(passes, strengths, 1, lambda _: [at - 0.5])[0, 0])

    def widths(x, good):
        yield 0, np.array([(strengths(x) - ranker.mark).sum(), ((strengths(x) - ranker.mark) ** 2).sum()]) / n

    first, second = passes(widths)[0]
    ranker.spread = max(1e-6, math.sqrt(max(0.0, second - first * first)) / 2)
    return ranker


def train(x: np.ndarray, good: np.ndarray, seed: int = 0) -> Ranker:
    """Learn from vectors in one place; without any, everything is accepted."""
    if not len(x):
        x, good = np.zeros((1, len(FEATURES) + HASHED), dtype=np.float32), np.ones(1, dtype=bool)
    return learn(lambda work: summed(work(x, good), {}), seed)


def blocks_of(rows: DataFrame, text: str, good: str) -> DataFrame:
    """The distinct vectors of ``rows`` and whether they are good, dealt by hash into blocks: a row each."""
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for batch in slices(whole):
                kept = []
                for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    x = vector(t).tobytes()
                    digest = hashlib.blake2b(x, digest_size=16).digest()
                    if digest + bytes([g]) not in seen:
                        seen.add(digest + bytes([g]))
                        kept.append((int.from_bytes(digest[:8], "big") % blocks, x, g))
                columns = list(zip(*kept)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.bool_()))], names=["block", "x", "good"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["x", "good"]).sort_values(["x", "good"])
        return pd.DataFrame({"x": [b"".join(pdf["x"])], "good": [bytes(pdf["good"].tolist())]})

    plain = rows.select(F.col(text).alias("text"), (F.col(good) == 1).alias("good"))
    dealt = plain.mapInArrow(run, "block long, x binary, good boolean").repartition(blocks, "block")
    return settle(dealt.groupBy("block").applyInPandas(gather, "x binary, good binary"))


def passes_over(blocks: DataFrame) -> Passes:
    """Passes over stored blocks. A task sums what its blocks give; the tasks' sums are added number by number."""

    def one(work: Work) -> dict[int, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    x = np.frombuffer(batch.column(0)[i].as_buffer(), dtype=np.float32).reshape(-1, len(FEATURES) + HASHED)
                    total = summed(work(x, np.frombuffer(batch.column(1)[i].as_buffer(), dtype=bool)), total)
            shapes = {k: list(v.shape) for k, v in total.items()}
            yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int64()), pa.array(list(shapes.values()), type=pa.list_(pa.int64())), pa.array([v.tobytes() for v in total.values()], type=pa.binary())], names=["number", "shape", "part"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(p, dtype=np.float64) for p in sorted(pdf["part"]))
            return pd.DataFrame({"number": pdf["number"][:1], "shape": pdf["shape"][:1], "part": [total.tobytes()]})

        schema = "number long, shape array<long>, part binary"
        found = blocks.mapInArrow(run, schema).groupBy("number").applyInPandas(add, schema).collect()
        return {r["number"]: np.frombuffer(r["part"], dtype=np.float64).reshape(r["shape"]) for r in found}

    return one


def fit(rows: DataFrame, text: str = "text", good: str = "quality") -> Ranker:
    """Train on all rows with a label; of equal vectors with equal labels one counts.

    The driver holds sums only: of weights, second derivatives and counts, whatever the number of rows.
    """
    blocks = blocks_of(rows.where(F.col(good).isNotNull()), text, good)
    return train(np.zeros((0, 0)), np.zeros(0, dtype=bool)) if blocks.isEmpty() else learn(passes_over(blocks))


def rate(rows: DataFrame, ranker: Ranker, text: str = "text", keep: list[str] | None = None, score: str = "score") -> DataFrame:
    """``rows`` (columns ``keep``, default all) with the score of each whole text; no shuffle.

    Null texts count as empty; texts of any length are read whole; repeated rows are scored
    alike. A column of the new name gives way. An empty table gives none.
    """

    def start():
        return lambda texts: {score: ranker.score(matrix(texts))}

    return map_columns(rows, [text], rows.columns if keep is None else keep, {score: pa.float64()}, start)


def labelled(spark, sf_dir: str) -> DataFrame:
    """Documents of all ids with a quality label that training may see.

    Repeated labels of an id count once, by their mean; all rows of an id take part. Up to
    BROADCAST_LABELS labels go to the documents. With more of them, documents whose id has no bit in a
    map of labelled ids (bounded, so with very many labels it tells fewer apart) go, and the rest are joined by a shuffle.
    """
    seen = F.pmod(id_crc(F.col("doc_id")), F.lit(4)) != 2
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(seen & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    marks = marks.groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("quality"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    many = marks.count()
    if many <= BROADCAST_LABELS:
        return docs.join(F.broadcast(marks), "doc_id")
    return mapped(docs, marks, min(MOST_BITS, many * LABEL_BITS)).join(marks, "doc_id")


def mapped(docs: DataFrame, marks: DataFrame, bits: int) -> DataFrame:
    """Rows of ``docs`` whose id has its bit in a map of ``bits`` bits of the ids of ``marks``: all that are there, and few others."""
    place = (F.pmod(id_crc(F.col("doc_id")), F.lit(bits)) + 1).alias("place")
    part, bit = F.bitmap_bucket_number("place"), F.bitmap_bit_position("place")
    map_ = marks.select(place).groupBy(part.alias("part")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    placed = docs.select("*", place).withColumn("part", part).join(F.broadcast(map_), "part")
    return placed.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*docs.columns)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of a quarter of the ids are never read.

    All other labels are learnt from.
    """
    held = F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2
    ranker = fit(labelled(spark, sf_dir))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = rate(docs, ranker, keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
