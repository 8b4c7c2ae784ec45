"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

A text is cut into paragraphs by one rule at any length: a paragraph is a run of words
within a line that ends behind a word whose last character is one of ``LAST``, or after
LONGEST_RUN words. Each paragraph's digest goes into one cell of every part of a table; a
cell keeps a count, the xor of its digests and the xor of their checks. Tables of two
versions are subtracted cell by cell, which cancels what they share; peeling cells that
hold a single digest then recovers the paragraphs that differ. If peeling stalls, both
tables are rebuilt with twice the cells; items of more than MOST_CELLS cells' worth are
split by a hash over several tables, so no table outgrows memory. The likeness of two
texts is the Dice coefficient of their paragraphs, from the sizes of the two sets and of
the recovered difference.

A repeated paragraph enters as its digest mixed with its number of occurrence, so
that the items of a table form a set and repeats are compared too.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import map_columns

PARTS = 3
#: Cells of the table in a fingerprint, and of the largest table; items beyond it go to SPLIT tables, by a hash.
BASE_CELLS = 24
MOST_CELLS = 1 << 22
SPLIT = 4
#: Last characters of words that end a run: a rule on the word alone, so cuts survive
#: edits elsewhere. Of the characters beyond ASCII every third ends a run.
LAST = ".,;:!?|dsgxzuy0-9#$%&*" + "".join(map(chr, range(0x80, 0x3000, 3)))
LONGEST_RUN = 16
RUN = re.compile(rf"(?:\S+\s+){{0,{LONGEST_RUN - 1}}}?\S*[{LAST}](?!\S)|(?:\S+\s+){{0,{LONGEST_RUN - 1}}}\S+")
#: Texts whose tables are built side by side.
GROUP = 500
#: Rows of a range of keys, ranges at most, and keys sampled for each. Beyond 327 million
#: rows ranges grow; they are sorted with spilling and read in a stream, so only tasks' times do.
ROWS_PER_RANGE = 5_000
MOST_RANGES = 1 << 16
KEYS_PER_RANGE = 16
#: Copies of a repeated row that are put out together.
COPIES = 1_000


def paragraphs(text: str) -> list[str]:
    """Pieces of the whole text, without blank ends; the rule is the same at any length."""
    return [run for line in text.split("\n") for run in RUN.findall(line)]


def digests(text: str) -> np.ndarray:
    """Sorted distinct 64-bit items of a text: the digests of its paragraphs, repeats numbered."""
    hashed = np.array([xxhash.xxh64_intdigest(p) for p in paragraphs(text)], dtype=np.uint64)
    hashed.sort()
    if len(hashed) > 1 and (hashed[1:] == hashed[:-1]).any():
        first = np.concatenate([[True], hashed[1:] != hashed[:-1]])
        at = np.flatnonzero(first)
        nth = np.arange(len(hashed)) - np.repeat(at, np.diff(np.concatenate([at, [len(hashed)]])))
        hashed = np.unique(hashed ^ _mix(nth.astype(np.uint64), 99) * (nth > 0).astype(np.uint64))
    return hashed


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _places(items: np.ndarray, cells: int) -> np.ndarray:
    """PARTS x items: the cell of each item in each part."""
    part = cells // PARTS
    return np.stack([_mix(items, p) % np.uint64(part) + np.uint64(p * part) for p in range(PARTS)]).astype(np.int64)


class Tables:
    """Tables of several texts side by side, all of ``cells`` cells."""

    def __init__(self, number: int, cells: int):
        if cells % PARTS:
            raise ValueError("cells must be a multiple of the parts")
        self.number, self.cells = number, cells
        self.count = np.zeros(number * cells, dtype=np.int64)
        self.keys = np.zeros(number * cells, dtype=np.uint64)
        self.checks = np.zeros(number * cells, dtype=np.uint64)

    def put(self, owner: np.ndarray, items: np.ndarray, sign: int | np.ndarray) -> None:
        at = (_places(items, self.cells) + owner[None] * self.cells).ravel()
        self.count += np.bincount(at, weights=np.broadcast_to(sign, (PARTS, len(items))).ravel(), minlength=len(self.count)).astype(np.int64)
        np.bitwise_xor.at(self.keys, at, np.tile(items, PARTS))
        np.bitwise_xor.at(self.checks, at, np.tile(_mix(items, 50), PARTS))

    def subtract(self, other: Tables) -> Tables:
        out = Tables(0, self.cells)
        out.number = self.number
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, item, sign) of all recovered items, and whether each table came out empty."""
        owners, items, signs = [], [], []
        for _ in range(10 * self.cells + 10):
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[self.checks[pure] == _mix(self.keys[pure], 50)]
            if not len(pure):
                break
            # an item found in several parts counts once; should two mixed names collide, one waits a round
            _, once = np.unique(_mix(self.keys[pure], 51) ^ _mix((pure // self.cells).astype(np.uint64), 52), return_index=True)
            pure = pure[once]
            owner, item, sign = pure // self.cells, self.keys[pure], self.count[pure]
            self.put(owner, item, -sign)
            owners.append(owner)
            items.append(item)
            signs.append(sign)
        left = (self.count != 0) | (self.keys != 0)
        done = ~left.reshape(self.number, self.cells).any(axis=1)
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *owners]), np.concatenate([none.astype(np.uint64), *items]), np.concatenate([none, *signs]), done


def _pack(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return owner, np.concatenate([np.zeros(0, dtype=np.uint64), *sets])


def build(sets: list[np.ndarray], cells: int) -> Tables:
    tables = Tables(len(sets), cells)
    tables.put(*_pack(sets), 1)
    return tables


def differences(left: list[np.ndarray], right: list[np.ndarray], base_left: Tables | None = None, base_right: Tables | None = None, depth: int = 0) -> list[int]:
    """Size of the symmetric difference of each pair of sets, by subtraction and peeling.

    Pairs that stall are tried again with larger tables: at least twice the cells, and
    as many as the spread of the counts in the subtracted table asks for. Where that is
    more than MOST_CELLS, both sets are split by a hash, and the parts' differences add up.
    """
    sizes, levels = [0] * len(left), {0: list(range(len(left)))}
    while levels:
        level = min(levels)
        todo = levels.pop(level)
        cells = BASE_CELLS << level
        if cells > MOST_CELLS:
            for i in todo:
                a, b = (_mix(s[i], 60 + depth) % np.uint64(SPLIT) for s in (left, right))
                sizes[i] = sum(differences([left[i][a == k] for k in range(SPLIT)], [right[i][b == k] for k in range(SPLIT)], depth=depth + 1))
            continue
        a = base_left if base_left and not level else build([left[i] for i in todo], cells)
        b = base_right if base_right and not level else build([right[i] for i in todo], cells)
        apart = a.subtract(b)
        parts = apart.count.reshape(len(todo), PARTS, -1)
        guess = ((parts - parts.mean(axis=2, keepdims=True)) ** 2).sum(axis=2).mean(axis=1)
        owner, _, _, done = apart.peel()
        found = np.bincount(owner, minlength=len(todo))
        for k, i in enumerate(todo):
            if done[k]:
                sizes[i] = int(found[k])
            else:
                wanted = max(cells * 2, 1.5 * float(guess[k]))
                levels.setdefault(max(level + 1, int(np.ceil(np.log2(wanted / BASE_CELLS)))), []).append(i)
    return sizes


def recover(left: str, right: str) -> tuple[set[int], set[int]]:
    """Paragraph items of ``left`` that ``right`` lacks, and the reverse."""
    a, b, cells = digests(left), digests(right), BASE_CELLS
    while True:
        _, items, signs, done = build([a], cells).subtract(build([b], cells)).peel()
        if done[0]:
            return set(items[signs > 0].tolist()), set(items[signs < 0].tolist())
        cells *= 2


def likeness(a: int, b: int, differing: int) -> float:
    """Dice coefficient of two sets from their sizes and their difference; 1 for two empty ones."""
    return 1.0 if not a + b else max(0.0, 1.0 - differing / (a + b))


def render(tables: Tables, sizes: list[int]) -> list[str]:
    """Fingerprints as text: the number of items, then the cells."""
    shape = (tables.number, tables.cells)
    cells = np.concatenate([tables.count.astype("<u4").view(np.uint8).reshape(*shape, 4), tables.keys.astype("<u8").view(np.uint8).reshape(*shape, 8), tables.checks.astype("<u8").view(np.uint8).reshape(*shape, 8)], axis=2)
    return [f"{n}:{base64.b64encode(cells[i].tobytes()).decode()}" for i, n in enumerate(sizes)]


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _fingerprint_rows(texts: list[str | None], following: list[str | None]) -> dict[str, list]:
    texts, following = [t or "" for t in texts], [t or "" for t in following]
    changed = [edited(t, n) for t, n in zip(texts, following)]
    known: dict[str, np.ndarray] = {}

    def items(text: str) -> np.ndarray:
        found = known.get(text)
        if found is None:
            found = known[text] = digests(text)
        return found

    own, new, after = [items(t) for t in texts], [digests(t) for t in changed], [items(t) for t in following]
    own_tables, new_tables, after_tables = build(own, BASE_CELLS), build(new, BASE_CELLS), build(after, BASE_CELLS)
    to_new, to_after = differences(own, new, own_tables, new_tables), differences(own, after, own_tables, after_tables)
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed],
        "fingerprint": render(own_tables, [len(s) for s in own]),
        "edited_fingerprint": render(new_tables, [len(s) for s in new]),
        "near_edited": [likeness(len(a), len(b), d) for a, b, d in zip(own, new, to_new)],
        "near_next": [likeness(len(a), len(b), d) for a, b, d in zip(own, after, to_after)],
    }


def _range_number(at: Column, cuts: list[str], kind: str) -> tuple[Column, Column]:
    """Number of ``cuts`` (sorted, each in JSON) at or below ``at``, and the greatest of them, by a search in two steps."""
    group = max(1, math.isqrt(len(cuts)))
    groups = ["[" + ",".join(cuts[i : i + group]) + "]" for i in range(0, len(cuts), group)]
    known = F.from_json(F.lit("[" + ",".join(groups) + "]"), f"array<array<{kind}>>")  # a constant, which the optimiser computes once
    coarse = F.size(F.filter(F.transform(known, lambda g: F.get(g, F.lit(0))), lambda c: c <= at)) - 1
    mine = F.get(known, coarse)
    fine = F.size(F.filter(mine, lambda c: c <= at))
    return F.when(coarse < 0, 0).otherwise(coarse * group + fine), F.get(mine, fine - 1)


def with_next(rows: DataFrame, key: str = "doc_id", text: str = "text", range_rows: int = ROWS_PER_RANGE) -> tuple[DataFrame, DataFrame | None]:
    """``(key, _text, _next)``: each row with the text of the next row by key, the last with that of the first.

    Null keys come first; rows of one key are ordered by a hash of their texts. Rows go to
    ranges cut at rows of a bounded sample. The rows at a range's cut are shown to the
    range before it too, so one shuffle of the texts gives every row its successor.

    The successor of all but the last of equal rows is their own text. Where equal rows
    are more than a range holds, one of them stays in the ranges; the second frame has the
    others, once, with their number in ``_copies``. It is None where there are none.
    """
    if not isinstance(rows.schema[key].dataType, (T.IntegralType, T.StringType)):
        raise ValueError("the key must be a whole number or text")
    plain = rows.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"))
    total = plain.count()
    range_rows = max(range_rows, -(-total // MOST_RANGES))
    crowds: list = []
    if total > range_rows:  # at most MOST_RANGES groups of more rows than a range's
        crowds = plain.groupBy("_key", "_hash").count().where(F.col("count") > range_rows).select("_key", "_hash").collect()
    repeated = None
    if crowds:
        listed = F.broadcast(plain.sparkSession.createDataFrame([tuple(r) for r in crowds], plain.select("_key", "_hash").schema))
        same = plain["_key"].eqNullSafe(listed["_key"]) & (plain["_hash"] == listed["_hash"])
        copies = plain.join(listed, same, "left_semi").groupBy("_key", "text", "_hash").agg(F.count(F.lit(1)).alias("n"))
        plain = plain.join(listed, same, "left_anti").unionByName(copies.drop("n"))
        repeated = copies.where("n > 1").select(F.col("_key").alias(key), F.col("text").alias("_text"), F.col("text").alias("_next"), (F.col("n") - 1).alias("_copies"))
    at = F.struct(F.col("_key").isNotNull().alias("has"), F.col("_key").alias("key"), F.col("_hash").alias("hash"))
    as_json = {"ignoreNullFields": "false"}
    ranges = max(1, -(-total // range_rows))
    cuts: list[str] = []
    if ranges > 1:
        share = F.lit(int((1 << 30) * min(1.0, ranges * KEYS_PER_RANGE / total)))
        near = plain.select("_key", "_hash").where(F.pmod(F.xxhash64("_key", "_hash", F.lit(7)), F.lit(1 << 30)) < share)
        sample = [r[0] for r in near.select(at.alias("at")).distinct().orderBy("at").select(F.to_json("at", as_json)).collect()]
        cuts = list(dict.fromkeys(sample[len(sample) * i // ranges] for i in range(1, ranges))) if sample else []
    kind = plain.select(at.alias("at")).schema["at"].dataType.simpleString()
    number, cut = _range_number(at, cuts, kind) if cuts else (F.lit(0), F.lit(None).cast(kind))
    # the first rows of all go to the last range once more; those at a cut to the range before it
    least = plain.agg(F.to_json(F.min(at), as_json)).first()[0] or "null"
    shown = F.when(at == F.from_json(F.lit(least), kind), len(cuts)).when(at == cut, number - 1)
    homes = F.array(F.struct(number.cast("int").alias("r"), F.lit(0).alias("guest")), F.struct(shown.cast("int").alias("r"), F.lit(1).alias("guest")))
    dealt = plain.select("_key", "text", "_hash", F.explode(F.filter(homes, lambda h: h["r"].isNotNull())).alias("home")).select("_key", "text", "_hash", "home.r", "home.guest")
    order = Window.partitionBy("r").orderBy("guest", F.col("_key").asc_nulls_first(), "_hash", F.col("text").asc_nulls_first())
    single = dealt.withColumn("_next", F.lead("text").over(order)).where("guest = 0")
    return single.select(F.col("_key").alias(key), F.col("text").alias("_text"), "_next"), repeated


def _copied(rows: DataFrame, copies: str) -> DataFrame:
    """``rows``, each as often as its column ``copies`` says, in lots of COPIES that are dealt out."""
    size = F.lit(COPIES).cast("long")
    lots = rows.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, size))).repartition("_lot", rows.columns[0])
    return lots.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(size, F.col(copies) - F.col("_lot"))))).drop("_lot", "_one", copies)


def fingerprint_pairs(rows: DataFrame, key: str = "doc_id", text: str = "text", range_rows: int = ROWS_PER_RANGE) -> DataFrame:
    """``key``, and the fingerprints of each text, of its edited text, and their likenesses.

    Null texts count as empty, with the fingerprint of no paragraphs; two empty texts are
    alike. A table of one row has itself as its next. Rows of one key follow each other in
    the order of a hash of their texts, equal rows as they come; rows without a key come
    first. Texts of any length are taken whole. Other columns of ``rows`` are not read; a
    key column called like a column of the result is an error. An empty table gives none.
    """

    def start():
        def work(texts, following):
            parts = [_fingerprint_rows(texts[lo : lo + GROUP], following[lo : lo + GROUP]) for lo in range(0, len(texts), GROUP)]
            return {name: [v for part in parts for v in part[name]] for name in added}

        return work

    added = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
    if key.lower() in (*added, "_text", "_next", "_copies"):
        raise ValueError(f"the key column cannot be called {key}")
    single, repeated = with_next(rows, key, text, range_rows)
    done = map_columns(single, ["_text", "_next"], [key], added, start)
    if repeated is None:
        return done
    return done.unionByName(_copied(map_columns(repeated, ["_text", "_next"], [key, "_copies"], added, start), "_copies"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
