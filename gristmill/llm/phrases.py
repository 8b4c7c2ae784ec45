"""Phrase collocations from generalised suffix automata of shards.

A phrase that occurs often enough consists of words, pairs and triples that do. Three
counting passes add up hashed words, pairs and triples in tables of a fixed number of slots,
which leave bitmaps of a fixed size; a bit that is not set proves its phrase too rare, so
texts are cut there without loss, at any size of the table. Of the remaining runs each task
builds suffix automata, shard by shard; pairs in no such run are counted apart. A state of an
automaton stands for substrings with the same end positions, so its count is theirs, and its
suffix link tells how far a substring can grow to the left without losing an occurrence.
Counts are summed over shards; a phrase is subsumed if all shards name the same word before
it, or behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import documents, settle, slices

LEAST, WORDS, TOP, UNKNOWN = 100, 5, 2000, "und"
#: Slots are the first 32 bits of a hash; SLOTS_A_BIT of them share a bit of a bitmap, ROW_SLOTS are counted together.
SLOTS_A_BIT, ROW_SLOTS = 32, 1 << 23
#: Words of a shard, distinct words of a language that a task numbers, and counts it holds before it sends them.
SHARD_WORDS, HELD, HELD_SLOTS = 150_000, 1 << 19, 1 << 22
RESULT = ("rank", "phrase", "a", "l", "r", "n", "score")

#: A-Z become small, what parts pieces becomes a line feed, a tab a space.
_TABLE = bytearray(range(256))
_TABLE[0x41:0x5B] = range(0x61, 0x7B)
for _b in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_b] = 0x0A
_TABLE[9] = 0x20
TABLE = bytes(_TABLE)
BREAK = b"\n"


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with a line feed between its pieces; empty strings mean nothing."""
    return (text or "").encode("utf-8", "replace").translate(TABLE).replace(b"\n", b" \n ").split(b" ")


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in this order."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def passes(bits: bytes, h: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the bits of the hashes."""
    at = (h >> np.uint64(32)) // np.uint64(SLOTS_A_BIT)
    return (np.frombuffer(bits, dtype=np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Numbers(dict):
    """Words of one language by number, with their hashes; 0 is nothing and 1 the end of a piece."""

    def __init__(self, lang: str, often: bytes | None):
        super().__init__({b"": 0, BREAK: 1})
        self.names = [b"", BREAK]
        self.lang = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"), 3))
        self.filter = often
        self.code = np.zeros(2, dtype=np.uint64)
        self.often = np.zeros(2, dtype=bool)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.names)
        self.names.append(word)
        return n

    def read(self, texts: list[str | None]) -> np.ndarray:
        """Numbers of all words of some texts in one array, 1 behind every piece."""
        parts = []
        for text in texts:
            words = tokens(text)
            parts += [np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words)), np.ones(1, dtype=np.int64)]
        if len(self.names) > len(self.code):
            new = np.array([xxhash.xxh64_intdigest(w) for w in self.names[len(self.code) :]], dtype=np.uint64)
            new = mixed(np.full(len(new), self.lang), new)
            self.code = np.concatenate([self.code, new])
            self.often = np.concatenate([self.often, np.ones(len(new), dtype=bool) if self.filter is None else passes(self.filter, new)])
        flat = np.concatenate(parts)
        return flat[flat != 0]


def frequent_pairs(words: Numbers, ids: np.ndarray, pairs: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """For each two neighbours whether they may be frequent, and their hash."""
    ok, code = words.often[ids], words.code[ids]
    both = ok[:-1] & ok[1:]
    h = mixed(code[:-1], code[1:])
    if pairs is not None:
        both[both] = passes(pairs, h[both])
    return both, h


def frequent_triples(words: Numbers, ids: np.ndarray, both: np.ndarray, h: np.ndarray, triples: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The same for each three neighbours, from what ``frequent_pairs`` gave."""
    three = both[:-1] & both[1:]
    h = mixed(h[:-1], words.code[ids[2:]])
    if triples is not None:
        three[three] = passes(triples, h[three])
    return three, h


class Automaton:
    """Generalised suffix automaton over runs of numbered words."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count, self.end = [-1], [0], [0], [0]
        self.text: list[int] = []

    def add(self, run: list[int]) -> None:
        """A run of words; its substrings count once for each place."""
        following, link, length, count, end, text = self.next, self.link, self.length, self.count, self.end, self.text
        last = 0
        for word in run:
            text.append(word)
            q = following[last].get(word)
            if q is not None and length[q] == length[last] + 1:
                last = q
                count[q] += 1
                continue
            if q is None:
                new = len(length)
                following.append({})
                link.append(0)
                length.append(length[last] + 1)
                count.append(1)
                end.append(len(text))
                p = last
                while p >= 0 and word not in following[p]:
                    following[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = following[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, word)
                last = new
            else:
                last = self._split(last, q, word)
                count[last] += 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A state of its own for the substrings of ``q`` that are as long as those of ``p`` and one word."""
        clone = len(self.length)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        self.end.append(self.end[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def substrings(self, most: int, least: int = 2) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """``(words, count, before, behind)`` of all distinct substrings of ``least`` to ``most`` words.

        ``before`` is the word that stands before every occurrence, ``behind`` the one that
        stands behind every one; -1 if there is none. Counts go up the suffix links first.
        """
        order = np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist()
        total = self.count.copy()
        for v in order:
            if self.link[v] > 0:
                total[self.link[v]] += total[v]
        for v in order:
            shortest = max(least, self.length[self.link[v]] + 1)
            if shortest > most:
                continue
            behind = -1
            for word, to in self.next[v].items():
                if total[to] == total[v]:
                    behind = word
            at = self.end[v]
            for size in range(shortest, min(most, self.length[v]) + 1):
                before = self.text[at - size - 1] if size < self.length[v] else -1
                yield tuple(self.text[at - size : at]), total[v], before, behind


def direct(run: list[int], lo: int, hi: int, most: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
    """What ``Automaton.substrings`` gives, for the substrings of a run that end behind ``lo`` and not behind ``hi``."""
    for size in range(2, most + 1):
        found: dict[tuple[int, ...], list[int]] = {}
        for end in range(max(size, lo + 1), hi + 1):
            start = end - size
            before, behind = run[start - 1] if start else -1, run[end] if end < len(run) else -1
            known = found.setdefault(tuple(run[start:end]), [0, before, behind])
            known[0] += 1
            if known[1] != before:
                known[1] = -1
            if known[2] != behind:
                known[2] = -1
        for words, (n, before, behind) in found.items():
            yield words, n, before, behind


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str | None]]]:
    """The texts of a batch (lang, text), language by language, some at a time."""
    for part in slices(batch, 200):
        by: dict[str, list[str | None]] = {}
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            by.setdefault(lang, []).append(text)
        yield from by.items()


def packed(values: np.ndarray) -> bytes:
    """Small numbers byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 4 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def bitmap(rows: DataFrame, size: int, filters: list, least: int) -> bytes:
    """Bits of the phrases of ``size`` words (1 to 3) that may occur ``least`` times, by the bitmaps of fewer words.

    A task sends the slots that it met, sorted, as differences; rows of slots are added up one by one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [f.value for f in filters] + [None] * (3 - len(filters))
        known: dict[str, Numbers] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        many = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            slots, at = np.unique(np.concatenate([s for s, _ in held]), return_inverse=True)
            return slots, np.minimum(np.bincount(at, weights=np.concatenate([n for _, n in held])), 1 << 31).astype(np.int64)

        def send() -> Iterator[pa.RecordBatch]:
            slots, n = merged()
            edges = np.searchsorted(slots, np.arange(0, (1 << 32) + 1, ROW_SLOTS, dtype=np.uint64)).tolist()
            out = [(r, hi - lo, packed(np.diff(slots[lo:hi].astype(np.int64), prepend=r * ROW_SLOTS)), packed(n[lo:hi])) for r, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])) if hi > lo]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["row", "n", "steps", "counts"])

        for batch in batches:
            for lang, texts in by_language(batch):
                words = known.get(lang)
                if words is None or len(words) > HELD:
                    words = known[lang] = Numbers(lang, bits[0])
                ids = words.read(texts)
                if size == 1:
                    h = words.code[ids[ids > 1]]
                else:
                    ok, h = frequent_pairs(words, ids, bits[1])
                    if size == 3:
                        ok, h = frequent_triples(words, ids, ok, h, None) if len(ids) > 2 else (ok[:0], h[:0])
                    h = h[ok]
                slots, n = np.unique(h >> np.uint64(32), return_counts=True)
                held.append((slots, n))
                many += len(slots)
                if many > HELD_SLOTS:
                    held = [merged()]
                    many = len(held[0][0])
                    if many > HELD_SLOTS // 2:
                        yield from send()
                        held, many = [], 0
        if held:
            yield from send()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, held, many = -1, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            slots, at = np.unique(np.concatenate([s for s, _ in held]), return_inverse=True)
            return slots, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        def done() -> pa.RecordBatch:
            slots, n = merged()
            bits = np.zeros(ROW_SLOTS // SLOTS_A_BIT, dtype=np.uint8)
            bits[slots[n >= least] // SLOTS_A_BIT] = 1
            return pa.RecordBatch.from_arrays([pa.array([row]), pa.array([np.packbits(bits, bitorder="little").tobytes()])], names=["row", "bits"])

        for batch in batches:
            for r, n, steps, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if r != row:
                    if row >= 0:
                        yield done()
                    row, held, many = r, [], 0
                held.append((np.cumsum(unpacked(steps, n)), unpacked(counts, n)))
                many += n
                if many > HELD_SLOTS:
                    held = [merged()]
                    many = len(held[0][0]) // 2  # a row has ROW_SLOTS slots at most
        if row >= 0:
            yield done()

    counted = rows.mapInArrow(count, "row long, n long, steps binary, counts binary")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = counted.repartition(tasks, "row").sortWithinPartitions("row").mapInArrow(add, "row long, bits binary")
    width = ROW_SLOTS // SLOTS_A_BIT // 8
    out = bytearray((1 << 32) // SLOTS_A_BIT // 8)
    for r in sums.toLocalIterator():
        out[r["row"] * width : (r["row"] + 1) * width] = r["bits"]
    return bytes(out)


class Counts(dict):
    """(lang, phrase) -> [n, before, behind], added up; a side is a word only while all agree on it."""

    def add(self, found: Iterator[tuple]) -> None:
        get = self.get
        for lang, phrase, n, before, behind in found:
            known = get((lang, phrase))
            if known is None:
                self[lang, phrase] = [n, before, behind]
            else:
                known[0] += n
                if known[1] != before:
                    known[1] = None
                if known[2] != behind:
                    known[2] = None

    def batch(self, keys: list[tuple[str, bytes]]) -> pa.RecordBatch:
        columns = [pa.array([k[0] for k in keys], type=pa.string()), pa.array([k[1] for k in keys], type=pa.binary()), pa.array([self[k][0] for k in keys], type=pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([self[k][i] for k in keys], type=pa.binary()) for i in (1, 2))], names=list(COUNTED))


COUNTED = ("lang", "phrase", "n", "before", "behind")


def summed(sent: DataFrame, least: int) -> DataFrame:
    """``COUNTED`` of all phrases that occur ``least`` times, and of empty ones, from what tasks sent by row.

    A task adds up one row after another.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, total = -1, Counts()

        def done() -> pa.RecordBatch:
            return total.batch([k for k, v in total.items() if v[0] >= least or not k[1]])

        for batch in batches:
            for part in slices(batch, 1):
                r = part.column(0)[0].as_py()
                if r != row:
                    yield done()
                    row, total = r, Counts()
                with pa.ipc.open_stream(part.column(1)[0].as_buffer()) as reader:
                    for held in reader:
                        total.add(zip(*(held.column(i).to_pylist() for i in range(5))))
        yield done()

    tasks = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(tasks, "row").sortWithinPartitions("row").mapInArrow(add, "lang string, phrase binary, n long, before binary, behind binary")


def count_phrases(rows: DataFrame, filters: list, most: int) -> DataFrame:
    """``(row, counts)``: counts of each task's shards, for words and phrases that may be frequent, packed by a hash of the phrase.

    ``before`` and ``behind`` are the word on that side of all of a shard's occurrences, if it
    is one and may make a frequent phrase. The empty phrase has the number of all words.
    """
    ranges = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    class Language:
        """What a task holds of a language: its words, their counts, pairs in no run, and an automaton."""

        def __init__(self, lang: str, counts: Counts):
            self.lang, self.words, self.counts = lang, Numbers(lang, filters[0].value), counts
            self.total, self.single = 0, np.zeros(0, dtype=np.int64)
            self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
            self.automaton = Automaton()

        def take(self, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
            words = self.words
            ids = words.read(texts)
            self.total += int((ids > 1).sum())
            found = np.bincount(ids, minlength=len(words.names))
            found[: len(self.single)] += self.single
            self.single = found
            both, h = frequent_pairs(words, ids, filters[1].value)
            three = frequent_triples(words, ids, both, h, filters[2].value)[0] if len(ids) > 2 else both[:0]
            # a run is where every three neighbours may be frequent; other pairs stand alone
            inside = np.zeros(len(both) + 1, dtype=bool)
            inside[: len(three)] |= three
            inside[1 : len(three) + 1] |= three
            alone = np.flatnonzero(both & ~inside[: len(both)])
            if len(alone):
                self.pairs.append(np.unique(ids[alone] << 32 | ids[alone + 1], return_counts=True))
                if sum(len(p) for p, _ in self.pairs) > HELD_SLOTS:
                    yield from self.send_pairs()
            edges = np.flatnonzero(np.diff(np.concatenate([[0], three.astype(np.int8), [0]])))
            for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
                run = ids[lo : hi + 2].tolist()
                if len(run) > SHARD_WORDS:
                    for at in range(0, len(run), SHARD_WORDS):
                        yield from self.send(direct(run, at, min(len(run), at + SHARD_WORDS), most))
                    continue
                self.automaton.add(run)
                if len(self.automaton.text) >= SHARD_WORDS:
                    yield from self.close()

        def close(self) -> Iterator[pa.RecordBatch]:
            automaton, self.automaton = self.automaton, Automaton()
            yield from self.send(automaton.substrings(most))

        def send_pairs(self) -> Iterator[pa.RecordBatch]:
            if self.pairs:
                keys, at = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([n for _, n in self.pairs])).astype(np.int64)
                self.pairs = []
                yield from self.send(((k >> 32, k & 0xFFFFFFFF), c, -1, -1) for k, c in zip(keys.tolist(), n.tolist()))

        def rest(self) -> Iterator[pa.RecordBatch]:
            yield from self.send_pairs()
            yield from self.close()
            some = np.flatnonzero(self.words.often[: len(self.single)] & (self.single > 0))
            yield from self.send(((i,), n, -1, -1) for i, n in zip(some.tolist(), self.single[some].tolist()))
            yield from self.send(iter([((0,), self.total, -1, -1)]))

        def send(self, found: Iterator[tuple[tuple[int, ...], int, int, int]]) -> Iterator[pa.RecordBatch]:
            names = self.words.names
            name = lambda i: None if i < 0 else names[i]
            while part := list(islice(found, 50_000)):
                self.counts.add((self.lang, b" ".join([names[i] for i in w]), n, name(b), name(e)) for w, n, b, e in part)
                if len(self.counts) > HELD:
                    yield from sent(self.counts)

    def sent(counts: Counts) -> Iterator[pa.RecordBatch]:
        """All counts by row, each row's compressed; none are left."""
        by: dict[int, list[tuple[str, bytes]]] = {}
        for key in counts:
            by.setdefault(xxhash.xxh32_intdigest(key[1], 5) % ranges, []).append(key)
        for row, keys in by.items():
            sink = pa.BufferOutputStream()
            batch = counts.batch(sorted(keys))
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([row], type=pa.int64()), pa.array([sink.getvalue().to_pybytes()], type=pa.binary())], names=["row", "counts"])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Language] = {}
        counts = Counts()
        for batch in batches:
            for lang, texts in by_language(batch):
                if lang not in known:
                    known[lang] = Language(lang, counts)
                yield from known[lang].take(texts)
                if len(known[lang].words) > HELD:
                    yield from known.pop(lang).rest()
                # all automata of a task together are bounded
                while sum(len(x.automaton.text) for x in known.values()) >= SHARD_WORDS:
                    yield from max(known.values(), key=lambda x: len(x.automaton.text)).close()
        for held in known.values():
            yield from held.rest()
        yield from sent(counts)

    return rows.mapInArrow(run, "row long, counts binary")


def collocations(rows: DataFrame, least: int = LEAST, most: int = WORDS, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: ``(lang, rank, phrase, a, l, r, n, score)``.

    As in the contract: phrases of 2 to ``most`` words that occur ``least`` times, scored by
    their weakest cut, without those that a longer one explains wholly. Scores are exact
    whole numbers. Null texts count as empty; a null language is ``und``; texts of any
    length are read whole; repeated rows count as often as they stand there; a language
    without such phrases has no rows, nor has an empty table. Other columns are not read. A
    language column called like a result column is an error.
    """
    if lang.lower() in RESULT:
        raise ValueError(f"the language column cannot be called {lang}")
    context = rows.sparkSession.sparkContext
    plain = rows.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").alias("text"))
    filters: list = []
    for size in (1, 2, 3):
        filters.append(context.broadcast(bitmap(plain, size, filters, least)))

    counted = settle(summed(count_phrases(plain, filters, most), least).withColumn("ws", F.split(F.col("phrase").cast("string"), " ")))
    size = counted.where(F.col("phrase") == b"").select("lang", F.col("n").alias("total"))
    known = counted.select("lang", "phrase", F.col("n").alias("f"))
    phrases = counted.where(F.size("ws") > 1)
    open_ = phrases.where((F.size("ws") == most) | F.col("before").isNull() & F.col("behind").isNull())
    cuts = open_.select("lang", "phrase", F.col("n").alias("a"), "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    first, rest = F.array_join(F.slice("ws", F.lit(1), F.col("k")), " "), F.array_join(F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k")), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", first.cast("binary").alias("first"), rest.cast("binary").alias("rest"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    full = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(size, "lang")
    # at most 1000 times the square of the number of words: 38 digits hold it
    score = F.expr("cast(1000 * cast(a AS decimal(38, 0)) * cast(total AS decimal(38, 0)) div (cast(l AS decimal(38, 0)) * cast(r AS decimal(38, 0))) AS long)")
    weakest = full.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", F.col("total").alias("n"))).alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    out = weakest.select("lang", F.col("phrase").cast("string").alias("phrase"), "c.a", "c.l", "c.r", "c.n", "c.score")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.select(F.col("lang").alias(lang), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of ``documents``."""
    return collocations(documents(spark, sf_dir))


def oracle() -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, array_to_string(ws[i : i + {k - 1}], ' ') AS p, count(*)::BIGINT AS f FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM pieces WHERE len(ws) >= {k}) GROUP BY ALL" for k in range(1, WORDS + 1)
    )
    return rf"""
    WITH pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws
                    FROM (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
    f AS MATERIALIZED ({grams}),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS MATERIALIZED (SELECT lang, k, p, f AS a, string_split(p, ' ') AS ws FROM f WHERE k > 1 AND f >= {LEAST}),
    inside AS (SELECT DISTINCT s.lang, s.p FROM (SELECT lang, a, array_to_string(ws[i : j], ' ') AS p FROM (SELECT lang, a, ws, k, unnest(range(1, k)) AS i FROM c), unnest(range(i + 1, k + 1)) AS t(j) WHERE j - i + 1 < k) s
               JOIN c ON c.lang = s.lang AND c.p = s.p WHERE 100 * s.a >= 100 * c.a),
    cuts AS (SELECT c.lang, c.p, c.a, t.k AS cut, x.f AS l, y.f AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
             FROM c ANTI JOIN inside USING (lang, p), unnest(range(1, c.k)) AS t(k)
             JOIN f x ON x.lang = c.lang AND x.p = array_to_string(c.ws[1 : t.k], ' ') JOIN f y ON y.lang = c.lang AND y.p = array_to_string(c.ws[t.k + 1 : ], ' ') JOIN n ON n.lang = c.lang),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1)
    SELECT lang, rank, p AS phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM best) WHERE rank <= {TOP}
    """
