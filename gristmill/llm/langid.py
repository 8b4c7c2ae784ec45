"""Language identification by a byte convolutional network.

The network reads text as UTF-8 bytes folded to a small alphabet, in windows of
``WINDOW`` bytes. Filters of several widths slide over a window, each filter keeps
its maximum, and a softmax layer turns the maxima into language probabilities. It
is trained in numpy on labelled text and applied to batches of windows; a text's
probabilities are the mean over all of its windows, weighted by their bytes.

A filter of width w is a sum of w table rows, one per byte. For inference, tables of
neighbouring bytes are added in advance, so that a width of 4 takes two look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import hashed_share, id_crc, map_columns

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Rows that training reads at most (in expectation), and windows it keeps of them.
TRAIN_ROWS = 3000
TRAIN_WINDOWS = 12_000
STEPS = 500
BATCH = 96
#: Bytes of windows that are evaluated at once.
BLOCK = 1 << 17
UNDETERMINED = "und"


def _alphabet() -> tuple[np.ndarray, int]:
    """Byte -> symbol: 0 pads, letters without case, one symbol each for blanks, digits
    and other ASCII, and one for every byte of a multi-byte character."""
    table = np.full(256, 3, dtype=np.int32)
    table[[9, 10, 11, 12, 13, 32]] = 1
    table[48:58] = 2
    for i in range(26):
        table[97 + i] = table[65 + i] = 4 + i
    table[128:] = np.arange(30, 158)
    return table, 158


SYMBOL, SYMBOLS = _alphabet()


@dataclass
class Network:
    """``filters[w][k]`` is the table of the k-th byte of width w: symbols x FILTERS."""

    labels: list[str]
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    head: np.ndarray
    head_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width: tables over pairs of symbols, or one symbol at an odd end."""
        out = []
        for width, parts in self.filters.items():
            steps = []
            for k in range(0, width - 1, 2):
                steps.append((parts[k][:, None, :] + parts[k + 1][None, :, :]).reshape(-1, FILTERS))
            if width % 2:
                steps.append(parts[width - 1])
            steps[0] = steps[0] + self.bias[width]
            out.append([np.ascontiguousarray(s, dtype=np.float32) for s in steps])
        return out


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, each a row of the symbols of its bytes and of the few behind them
    that its filters reach; and for every window the index of its text and its number of bytes.

    Behind a text's end is padding, never another text. An empty text has no window.
    """
    sizes, width = np.array([len(t) for t in texts], dtype=np.int64), max(WIDTHS)
    counts = -(-sizes // WINDOW)
    symbols = np.zeros(int(counts.sum() + 1) * WINDOW + width, dtype=np.int32)
    starts = np.cumsum(counts) - counts
    for text, at in zip(texts, (starts * WINDOW).tolist()):
        symbols[at : at + len(text)] = SYMBOL[np.frombuffer(text, dtype=np.uint8)]
    owner = np.repeat(np.arange(len(texts)), counts)
    grid = np.lib.stride_tricks.sliding_window_view(symbols, WINDOW + width)[::WINDOW][: len(owner)].copy()
    grid[(np.cumsum(counts) - 1)[counts > 0], WINDOW:] = 0
    filled = np.minimum(sizes[owner] - (np.arange(len(owner)) - starts[owner]) * WINDOW, WINDOW)
    return grid, owner, filled


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def window_probabilities(net: Network, tables: list[list[np.ndarray]], grid: np.ndarray) -> np.ndarray:
    """Probabilities (windows x labels). A filter that starts in a window may read the few
    bytes behind it, so no byte sequence of a text is missed."""
    out = np.empty((len(grid), len(net.labels)), dtype=np.float64)
    block = max(1, BLOCK // WINDOW)
    for lo in range(0, len(grid), block):
        part = grid[lo : lo + block]
        pairs = part[:, :-1] * SYMBOLS + part[:, 1:]
        pooled = []
        for steps in tables:
            total = steps[0].take(pairs[:, :WINDOW], axis=0)
            for k, table in enumerate(steps[1:], start=1):
                at = 2 * k
                total += table.take((pairs if len(table) > SYMBOLS else part)[:, at : at + WINDOW], axis=0)
            pooled.append(total.max(axis=1))
        hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
        out[lo : lo + block] = _softmax(hidden @ net.head + net.head_bias)
    return out


def cut(text: bytes) -> list[bytes]:
    """The windows of a text that training takes: symbols of WINDOW bytes and of the few behind
    them that filters reach; the last one only if it is a quarter full, or alone."""
    grid, _, filled = windows_of([text])
    return [row.astype(np.uint8).tobytes() for w, row in enumerate(grid) if not w or filled[w] >= WINDOW // 4]


def train(windows: list[bytes], labels: list[str], seed: int = 0) -> Network:
    """Fit a network by Adam on windows (see ``cut``) drawn evenly over the labels.

    Equal windows of equal labels are kept once. With no window the network has the single
    label ``und``.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(labels)) or [UNDETERMINED]
    index = {name: i for i, name in enumerate(names)}
    width = max(WIDTHS)
    kept = sorted({(w, index[label]) for w, label in zip(windows, labels)})
    kept = [kept[i] for i in rng.permutation(len(kept))[:TRAIN_WINDOWS]]
    grid = np.frombuffer(b"".join(w for w, _ in kept), dtype=np.uint8).reshape(-1, WINDOW + width).astype(np.int32)
    target = np.array([label for _, label in kept], dtype=np.int64)
    filters = {w: rng.normal(0, 0.3, (w, SYMBOLS, FILTERS)) for w in WIDTHS}
    bias = {w: np.zeros(FILTERS) for w in WIDTHS}
    head = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(names)))
    head_bias = np.zeros(len(names))
    net = Network(names, filters, bias, head, head_bias)
    if len(names) < 2:
        return net
    groups = [g for g in (np.flatnonzero(target == c) for c in range(len(names))) if len(g)]
    params = [*filters.values(), *bias.values(), head, head_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    columns = np.arange(FILTERS)
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(g, BATCH // len(groups) + 1) for g in groups])
        x, y = grid[pick], target[pick]
        pooled, peaks = [], []
        for w in WIDTHS:
            score = sum(filters[w][k][x[:, k : k + WINDOW]] for k in range(w))
            peak = score.argmax(axis=1)
            peaks.append(peak)
            pooled.append(np.take_along_axis(score, peak[:, None, :], axis=1)[:, 0, :] + bias[w])
        raw = np.concatenate(pooled, axis=1)
        hidden = np.maximum(raw, 0)
        delta = _softmax(hidden @ head + head_bias)
        delta[np.arange(len(y)), y] -= 1
        delta /= len(y)
        back = (delta @ head.T) * (raw > 0)
        grads = []
        for i, w in enumerate(WIDTHS):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            grad = np.zeros_like(filters[w])
            for k in range(w):
                seen = np.take_along_axis(x, peaks[i] + k, axis=1)
                np.add.at(grad[k], (seen, np.broadcast_to(columns, seen.shape)), part)
            grads.append(grad)
        grads += [back[:, i * FILTERS : (i + 1) * FILTERS].sum(axis=0) for i in range(len(WIDTHS))]
        grads += [hidden.T @ delta + 1e-4 * head, delta.sum(axis=0)]
        for p, g, m, v in zip(params, grads, first, second):
            g = g.astype(np.float32)  # sums differ in their last digits from run to run; networks should not
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def predict(net: Network, tables: list[list[np.ndarray]], texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Label and probability of every text; ``und`` and 0 without a letter. Of equally likely
    labels the first in order is taken."""
    raw = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
    grid, owner, filled = windows_of(raw)
    probability = window_probabilities(net, tables, grid) * filled[:, None]
    total = np.zeros((len(raw), len(net.labels)))
    np.add.at(total, owner, probability)
    labels, scores = [], []
    for text, row, size in zip(texts, total, raw):
        if not size or not any(map(str.isalpha, text)):
            labels.append(UNDETERMINED)
            scores.append(0.0)
        else:
            best = int(row.argmax())
            labels.append(net.labels[best])
            scores.append(float(min(1.0, row[best] / len(size))))
    return labels, scores


def fit(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", bound: int = TRAIN_ROWS) -> Network:
    """Train on windows of about ``bound`` rows at most with a text and a label.

    Rows are chosen by a hash of ``key`` and text and cut where they are; of their windows
    about TRAIN_WINDOWS at most, chosen by a hash too, come to the driver, whatever the
    texts' lengths. Repeated windows count once.
    """
    usable = rows.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(key, text, label)
    sample = hashed_share(usable, F.xxhash64(key, text), bound).select(F.col(text).alias("text"), F.col(label).alias("label"))

    def start():
        return lambda texts: {"windows": [cut(t.encode("utf-8", "replace")) for t in texts]}

    windows = map_columns(sample, ["text"], ["label"], {"windows": pa.list_(pa.binary())}, start).select("label", F.explode("windows").alias("window")).distinct()
    seen = hashed_share(windows, F.xxhash64("window", "label"), TRAIN_WINDOWS).orderBy("window", "label").toPandas()
    return train([bytes(w) for w in seen["window"]], list(seen["label"]))


def identify(rows: DataFrame, net: Network, text: str = "text", keep: list[str] | None = None, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``rows`` (columns ``keep``, default all) with the predicted language and its probability.

    Null, empty and letterless texts get ``und`` and 0. Columns of the new names give way. Texts of any length are read
    whole. The network is a few hundred kilobytes whatever the input; no shuffle.
    """
    bound = rows.sparkSession.sparkContext.broadcast((net, net.tables()))

    def start():
        model, steps = bound.value

        def work(texts):
            labels, scores = predict(model, steps, texts)
            return {pred: labels, score: scores}

        return work

    return map_columns(rows, [text], rows.columns if keep is None else keep, {pred: pa.string(), score: pa.float64()}, start)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document; a third of the ids is held out from training.

    Null ids count as the empty text in the hold-out rule; repeated rows each get a row;
    an empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(id_crc(F.col("doc_id")), F.lit(3)) == 1
    net = fit(docs.where(~held))
    out = identify(docs.select("doc_id", "text"), net, keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
