"""SimHash fingerprints and near-duplicate components by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most ``d`` bits, cut into ``d // 2 + 1``
segments, have a segment where they differ in at most one bit. Every fingerprint is
indexed under each segment with each one of its bits wiped (a one-wildcard variant),
so such a pair meets in an equality join; the join condition verifies the distance.
Texts with the same fingerprint are one class before any join, so copies of any
number cost one row there.

Few bits apart is close to a copy. For texts that share a given part of their shingles,
``similar_texts`` takes the same variants of a fingerprint whose letters are least hashes of
the shingles in place of bits: two texts agree in a letter as often as their shingles do,
wherever the edits are, so some segment differs in one letter at most with high probability.
The shingles themselves are then verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import map_columns, settle

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
BITS = 64
SEED = 42
#: Similar texts: Jaccard coefficient of the sets of shingles of so many words.
SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: Their fingerprints: segments and letters of each. Of texts of the wanted similarity 0.74 of the
#: segments are one letter apart at most, so 0.995 of such texts meet; of texts half as similar, few.
SEGMENTS, LETTERS = 4, 5
#: Rounds in which the texts of a bucket that are still apart meet another of its texts, before all that are left meet.
ROUNDS = 2
#: Longs of a text's map of shingles, which bounds what two texts share, and tasks that a bucket's pairs are dealt over.
MAP_LONGS, DEAL = 16, 16
#: A node with more than one in HUBS of all links (and HUB_LINKS, or HUB_TEXTS pairs, at least) is spread over SPREAD tasks.
HUBS, HUB_LINKS, HUB_TEXTS, SPREAD = 1000, 50_000, 1_000, 64
#: Links at most that one task joins to components; more of them take rounds of stars until so many are left, or to the end.
LINKS_AT_ONCE = 200_000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned SimHash of the whole text; a bit is set if over half the shingle hashes have it."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    runs = zip(*(tokens[i:] for i in range(words))) if len(tokens) > words else [tokens]
    hashes = np.fromiter((digest(b" ".join(run), SEED) for run in runs), dtype=np.uint64)
    big = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(big), 1 << 16):
        ones += np.unpackbits(big[lo : lo + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(rows: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = SHINGLE_WORDS) -> DataFrame:
    """Columns ``keep`` and ``fp``, the fingerprint as a signed 64-bit integer. No shuffle."""

    def start():
        return lambda texts: {"fp": np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)}

    return map_columns(rows, [text], keep, {"fp": pa.int64()}, start)


def links(fps: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """All pairs ``a < b`` of the distinct ``fp`` values at most ``distance`` bits apart, each once.

    A pair meets under one key for each segment with one differing bit and under every
    key of an equal segment. It is accepted only in its first such segment, at its
    differing bit or at bit 0, so no pass to remove repeats is needed. Spark takes the keys
    for no larger than ``fps``, which has one row for BITS of them, so none are broadcast.
    """
    if not 1 <= distance <= 14:
        raise ValueError("distance must lie in 1..14")
    segments = distance // 2 + 1
    edges = [round(BITS * s / segments) for s in range(segments + 1)]
    masks = [((1 << edges[s + 1]) - 1) ^ ((1 << edges[s]) - 1) for s in range(segments)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    wiped = []
    for s in range(segments):
        for bit in range(edges[s], edges[s + 1]):
            left = masks[s] & ~(1 << bit)
            wiped.append(F.struct(F.lit(bit).cast("byte").alias("bit"), F.col("fp").bitwiseAND(F.lit(left - (1 << 64) if left >> 63 else left)).alias("rest")))
    keys = fps.select("fp", F.explode(F.array(*wiped)).alias("key")).select("fp", "key.bit", "key.rest")
    a, b = keys.alias("a"), keys.alias("b")
    apart: Column = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    # Under an equal key the segment of its bit differs in that bit or not at all.
    chosen: Column = F.lit(False)
    for s in range(segments):
        mine = F.col("a.bit").between(edges[s], edges[s + 1] - 1)
        differs = apart.bitwiseAND(F.lit(signed[s])) != 0
        first = F.lit(True)
        for earlier in range(s):
            first &= F.bit_count(apart.bitwiseAND(F.lit(signed[earlier]))) > 1
        chosen |= mine & (differs | (F.col("a.bit") == edges[s])) & first
    found = merged(
        a,
        b,
        (F.col("a.bit") == F.col("b.bit"))
        & (F.col("a.rest") == F.col("b.rest"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(apart) <= distance)
        & chosen,
    )
    return found.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """``left`` JOIN ``right``, sorted on both sides: a side that is small, or taken for small, would pass through the driver to be broadcast, once for each join."""
    return left.join(right.hint("merge"), on, how)


def spread(links_: DataFrame, stars: DataFrame, total: int, least: int = HUB_LINKS) -> DataFrame:
    """``links_`` (u, v) JOIN ``stars`` (u, m, n) on u, where n is the number of links of u.

    A node's links go to one task unless they are more than one in HUBS of all; those nodes
    are HUBS at most and come to the driver, and their links are dealt over SPREAD tasks.
    """
    most = max(least, total // HUBS)
    return dealt(links_, stars, [r["u"] for r in stars.where(F.col("n") > most).select("u").collect()] if total > most else [])


def dealt(links_: DataFrame, stars: DataFrame, hubs: list[int]) -> DataFrame:
    """``links_`` (u, v) JOIN ``stars`` (u, ...) on u, the links of each of ``hubs`` dealt over SPREAD tasks."""
    if not hubs:
        return merged(links_, stars, "u")
    hub = F.col("u").isin(*hubs)
    salted = links_.withColumn("salt", F.when(hub, F.pmod(F.xxhash64("v"), F.lit(SPREAD))).otherwise(F.lit(0).cast("long")))
    every = F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))
    return merged(salted, stars.withColumn("salt", F.explode(F.when(hub, every).otherwise(F.array(F.lit(0).cast("long"))))), ["u", "salt"]).drop("salt")


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links (u, v), ascending, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        new, low = root.copy(), np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _joined(pairs: DataFrame) -> DataFrame:
    """``(node, root)`` of links (u, v) that one task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(i).to_numpy() for i in (0, 1)] for batch in batches]
        if parts:
            nodes, roots = least_reached(*map(np.concatenate, zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])

    return settle(pairs.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(run, "node long, root long"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge, root being the least node it reaches.

    Nodes are whole numbers. Up to LINKS_AT_ONCE links are joined in one task. Of more,
    alternating large-star and small-star rounds are taken, until so many are left or
    nothing changes; each round is written to the shared checkpoint folder, and only
    counts, a sum and the hubs come to the driver. A node's neighbours are never gathered
    there: the stars need their minimum only.
    """
    pairs = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before, total = None, 2 * pairs.count()
    while total > 2 * LINKS_AT_ONCE:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # large-star: larger neighbours of u point to the least node of its star
        large = spread(both, low, total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        # small-star: u's smaller neighbours and u itself point to the least of them
        small = spread(large, least, total).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        pairs = settle(small)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        total = 2 * now[0]
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    return _joined(pairs)


def near_duplicates(rows: DataFrame, text: str = "text", key: str = "doc_id", words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """``(key, fp, component_id)``: one row per row of ``rows``.

    ``component_id`` is the least ``key`` among all rows reachable over fingerprints at
    most ``distance`` bits apart. Texts without words have fingerprint 0 and are linked
    like others; null texts count as empty. Rows with a null key take part but never
    name a component unless all its keys are null. Texts of any length are read whole;
    repeated rows each get a row. Other columns are not read; a key column called like a
    result column is an error. An empty table gives no rows.
    """
    if key.lower() in ("fp", "component_id"):
        raise ValueError(f"the key column cannot be called {key}")
    plain = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    prints = settle(fingerprints(plain, "text", ("key",), words))
    classes = prints.groupBy("fp").agg(F.min("key").alias("least"))
    found = components(links(classes.select("fp"), distance))
    return _members(prints, classes, found, "fp", key)


def shingles(text: str | None, words: int = SIMILAR_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; the whole sequence if it has fewer words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    runs = zip(*(tokens[i:] for i in range(words))) if len(tokens) > words else [tokens]
    return np.unique(np.fromiter((digest(b" ".join(run), SEED) for run in runs), dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Share of two sets' union that both have; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, size=n, dtype=np.uint64) | np.uint64(1)


_TIMES, _PLUS = _odd(SEGMENTS * LETTERS, 1), _odd(SEGMENTS * LETTERS, 2)


def letters(text: str | None, words: int = SIMILAR_WORDS) -> np.ndarray:
    """SEGMENTS * LETTERS letters: the least of as many hashes over the set of shingles; zeros without any."""
    return least(shingles(text, words))


def least(hashed: np.ndarray) -> np.ndarray:
    """The letters of a set of shingles."""
    out = np.zeros(SEGMENTS * LETTERS, dtype=np.uint64)
    for i in range(len(out) if len(hashed) else 0):
        h = hashed * _TIMES[i] + _PLUS[i]
        out[i] = ((h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)).min()
    return out


def variants(print_: np.ndarray) -> np.ndarray:
    """Keys of all one-wildcard variants: a hash of the segment's place, its wiped letter's place and its other letters."""
    keys = []
    for segment, part in enumerate(print_.reshape(SEGMENTS, LETTERS)):
        for wiped in range(LETTERS):
            rest = np.delete(part, wiped).astype("<u8").tobytes()
            keys.append(xxhash.xxh64_intdigest(rest, segment * LETTERS + wiped))
    return np.array(keys, dtype=np.uint64).view(np.int64)


def shingle_map(hashed: np.ndarray) -> np.ndarray:
    """MAP_LONGS longs in which each shingle sets a bit."""
    bits = np.zeros(64 * MAP_LONGS, dtype=np.uint8)
    bits[(hashed >> np.uint64(20)).astype(np.int64) % len(bits)] = 1
    return np.packbits(bits).view(np.int64)


def _may_be_alike(a: str, b: str, similarity: float) -> Column:
    """Whether two texts can share enough shingles, by their numbers and maps: a bit that only
    one has is a shingle, at least, that the other lacks. No alike pair is left out."""
    only = lambda x, y: reduce(add, [F.bit_count(F.col(f"{x}.m{i}").bitwiseAND(F.bitwise_not(f"{y}.m{i}"))) for i in range(MAP_LONGS)])
    most = F.least(F.col(f"{a}.size") - only(a, b), F.col(f"{b}.size") - only(b, a))
    return most * (1 + similarity) >= similarity * (F.col(f"{a}.size") + F.col(f"{b}.size")) - 1e-6


def _left_over(apart: DataFrame, traits: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b), a > b, of ids that share a bucket, lie in different components and may be alike, each once.

    A bucket's pairs are dealt over DEAL tasks and streamed; what passes the bound is kept.
    """
    rows = merged(apart.select("id", "k", "root"), traits, "id")
    left = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(DEAL))).alias("a")
    right = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEAL - 1).cast("long")))).alias("b")
    close = (F.least("a.size", "b.size") >= similarity * F.greatest("a.size", "b.size") - 1e-6) & _may_be_alike("a", "b", similarity)
    same = (F.col("a.k") == F.col("b.k")) & (F.col("a.part") == F.col("b.part"))
    met = left.join(right.hint("merge"), same & (F.col("a.id") > F.col("b.id")) & (F.col("a.root") != F.col("b.root")) & close)
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of ids of ``texts`` (id, text) whose texts share enough shingles.

    ``texts`` has each id once, and only ids that can stand in a pair. A text of many pairs is spread.
    """

    def start():
        known = lru_cache(maxsize=64)(lambda t: shingles(t, words))
        return lambda left, right: {"alike": [jaccard(known(x), known(y)) >= similarity for x, y in zip(left, right)]}

    total = pairs.count()
    if not total:
        return pairs
    most = max(HUB_TEXTS, total // HUBS)

    def with_text(rows: DataFrame, end: str, as_: str) -> DataFrame:
        often = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        hubs = [r[end] for r in often.collect()] if total > most else []
        other = "b" if end == "a" else "a"
        full = dealt(rows.withColumnsRenamed({end: "u", other: "v"}), texts.select(F.col("id").alias("u"), F.col("text").alias(as_)), hubs)
        return full.withColumnsRenamed({"u": end, "v": other})

    full = with_text(with_text(pairs, "a", "x"), "b", "y")
    return map_columns(full, ["x", "y"], ["a", "b"], {"alike": pa.bool_()}, start).where("alike").select("a", "b")


def similar_texts(rows: DataFrame, text: str = "text", key: str = "doc_id", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``(key, text_class, component_id)``: one row per row of ``rows``; ``text_class`` numbers the distinct texts.

    ``component_id`` is the least ``key`` among all rows reachable over texts whose sets of
    shingles of ``words`` words have a Jaccard coefficient of ``similarity`` or more, as far
    as the variants of their fingerprints bring them together. Equal texts are one class
    from the start (told by two 64-bit hashes). Texts of fewer words are one shingle; null,
    empty and wordless texts are alike. Rows with a null key take part but never name a
    component unless all its keys are null. Texts of any length are read whole. Other
    columns are not read; a key column called like a result column is an error. An empty
    table gives no rows.

    The texts of a bucket are first compared with one of them, its centre, which is the one whose
    buckets are the fullest: in a family of copies the text that the others were made from.
    What is alike is settled. In buckets of several components, texts meet two more centres in
    a further round. Then every two texts of a bucket that are still of different components
    meet, so no link between texts that share a variant is lost. Pairs that cannot be alike, by the
    numbers and maps of their shingles, go before texts travel; this step alone grows with the
    square of what is left of a bucket, streamed over DEAL tasks.
    """
    if key.lower() in ("text_class", "component_id"):
        raise ValueError(f"the key column cannot be called {key}")
    body = F.col(f"`{text}`")
    plain = rows.select(F.col(f"`{key}`").alias("key"), F.when(body.rlike(r"[^\x20\x09-\x0D]"), body).alias("text"))
    plain = plain.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})

    def start():
        def work(texts: list[str | None]) -> dict[str, object]:
            sets = [shingles(t, words) for t in texts]
            return {"keys": [variants(least(h)) for h in sets], "size": [len(h) for h in sets], "map": [shingle_map(h) for h in sets]}

        return work

    prints = settle(map_columns(plain, ["text"], ["key", "h1", "h2"], {"keys": pa.list_(pa.int64()), "size": pa.int64(), "map": pa.list_(pa.int64())}, start))
    classes = settle(prints.groupBy("h1", "h2").agg(F.min("key").alias("least"), *[F.first(c).alias(c) for c in ("keys", "size", "map")])).withColumn("id", F.monotonically_increasing_id())
    numbers = classes.select("h1", "h2", "id", "least")

    keyed = classes.select("id", F.explode("keys").alias("k"))
    crowded = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = settle(merged(keyed, crowded, "k"))
    weight = shared.groupBy("id").agg(F.sum("n").alias("w"))
    apart = settle(merged(shared.select("id", "k"), weight, "id").withColumns({"root": F.col("id"), "used": F.lit(False)}))
    # texts travel once, and only those that share a bucket: one row of each class
    some = merged(numbers, apart.select("id").distinct(), "id", "left_semi")
    own = merged(plain, some, ["h1", "h2"]).where(F.col("key").eqNullSafe(F.col("least")))
    texts = settle(own.groupBy("id").agg(F.first("text").alias("text")))
    links_: DataFrame | None = None
    tried: DataFrame | None = None
    found: DataFrame | None = None
    for turn in range(ROUNDS):
        # the fullest buckets first; after that another one of these, and any text that was no centre yet
        fresh_ = F.struct("id", "root")
        orders = [F.struct(~F.col("used"), F.col("w"), F.xxhash64("id", F.lit(turn))), F.struct(~F.col("used"), F.xxhash64("id", F.lit(~turn)))][: 1 + (turn > 0)]
        centres = apart.groupBy("k").agg(F.array_distinct(F.array(*[F.max_by(fresh_, o) for o in orders])).alias("cs"))
        met = settle(merged(apart, centres, "k"))
        each = met.withColumn("c", F.explode("cs")).where(F.col("root") != F.col("c.root"))
        pairs = each.select(F.greatest("id", "c.id").alias("a"), F.least("id", "c.id").alias("b")).distinct()
        new = settle(pairs if tried is None else merged(pairs, tried, ["a", "b"], "left_anti"))
        alike = settle(_verified(new, texts, words, similarity))
        tried = new if tried is None else tried.unionByName(new)
        links_ = alike if links_ is None else links_.unionByName(alike)
        if found is None or not alike.isEmpty():
            found = components(links_)
        placed = met.select("id", "k", "w", (F.col("used") | F.exists("cs", lambda c: c["id"] == F.col("id"))).alias("used"))
        placed = merged(placed, found.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        several = placed.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("k")
        apart = settle(merged(placed, several, "k", "left_semi"))
        if apart.isEmpty():
            break
    else:
        traits = classes.select("id", "size", *[F.col("map")[i].alias(f"m{i}") for i in range(MAP_LONGS)])
        rest = settle(merged(_left_over(apart, traits, similarity), tried, ["a", "b"], "left_anti"))
        alike = settle(_verified(rest, texts, words, similarity))
        if not alike.isEmpty():
            found = components(links_.unionByName(alike))
    return _members(merged(prints, numbers, ["h1", "h2"]).select("key", F.col("id").alias("text_class")), classes.select(F.col("id").alias("text_class"), "least"), found, "text_class", key)


def _members(prints: DataFrame, classes: DataFrame, found: DataFrame, code: str, key: str) -> DataFrame:
    """``(key, code, component_id)`` of all ``prints``, from the classes' least keys and the components ``found``."""
    reached = settle(merged(classes, found.withColumnRenamed("node", code), code, "left").select(code, "least", F.coalesce("root", code).alias("u")))
    named = reached.groupBy("u").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    member = spread(reached.select("u", F.col(code).alias("v")), named, reached.count()).select(F.col("v").alias(code), "component_id")
    return merged(prints, member, code).select(F.col("key").alias(key), code, "component_id")


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
