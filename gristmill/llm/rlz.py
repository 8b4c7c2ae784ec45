"""Repeated passages by relative Lempel-Ziv parsing against indexed reference blocks.

Texts are stored once in volumes of bounded size, compressed. Of every window of words the
run of SEED words with the least hash is its seed; equal windows have equal seeds, so what
repeats elsewhere shows in the seeds' hashes alone. Each volume asks the shards of the seed
index for its distinct seeds, once each however often it holds them, and learns the first
place of those that stand in more than one place. Where a seed is at its first place, the
text around it becomes a reference block; where it is not, the windows of the seed become a
suspect, which goes to that block and is factored greedily against it. Factors as long as a
window are repeats; windows across the ends of factors are looked up in the block's index.

Windows that a block does not hold can still repeat another text with the same seed, and
then both are left over, because both were compared with the same block. So what is left
over is settled among itself, by equal digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import documents, settle, slices

#: Words of a window, of a seed, and of a reference block between its margins.
WINDOW, SEED, BLOCK_WORDS = 20, 6, 256
#: Bytes of text in a volume, windows of a suspect, seeds of a shard (a seed comes once in about SEED_BYTES of text).
VOLUME_BYTES, SUSPECT_WINDOWS, SHARD_SEEDS, SEED_BYTES = 8 << 20, 2048, 1 << 19, 48
#: Suspects of a reference block that one task compares, about.
SHARE = 4096
#: Effort of compressing texts, which are written once and travel twice.
LEVEL = 6
#: Places in a text that a seed's value is told apart by, among equal ones.
PLACES = np.uint64((1 << 20) - 1)
#: Distinct words whose hashes a task remembers.
HELD = 1 << 19
#: A null key comes after all others.
LAST = (1 << 63) - 1


class Codes(dict):
    """Word -> 64-bit hash; forgets all when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word, 11)
        return code


def runs_hashed(codes: np.ndarray, words: int) -> np.ndarray:
    """A hash of every run of ``words`` hashed words."""
    n = len(codes) - words + 1
    h = codes[:n].copy()
    for j in range(1, words):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[j : j + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` neighbours of ``h`` the place of the least, by its first 44 bits, then by place."""
    place = np.arange(len(h), dtype=np.uint64)
    value, size = h & ~PLACES | place & PLACES, 1
    while size < width:
        step = min(size, width - size)
        value = np.minimum(value[:-step], value[step:])
        size += step
    first = place[: len(value)]
    return (first + ((value - first) & PLACES)).astype(np.int64)


def seeds(codes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the seed of every window of a text; nothing if it is shorter than a window."""
    if len(codes) < window:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = runs_hashed(codes, SEED)
    at = least_places(h, window - SEED + 1)
    return h[at], at


def hashed(words: list[bytes], known: Codes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def pack_texts(texts: list[bytes]) -> tuple[bytes, bytes]:
    """Texts compressed together, and their sizes."""
    return pa.Codec("zstd", compression_level=LEVEL).compress(b"".join(texts), asbytes=True), np.array([len(t) for t in texts], dtype="<i8").tobytes()


def unpack_texts(blob: bytes, sizes: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, dtype="<i8")).tolist()
    joined = pa.decompress(blob, ends[-1], codec="zstd", asbytes=True)
    return [joined[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def whole(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def steps(h: np.ndarray) -> np.ndarray:
    """Ascending hashes as differences."""
    return np.diff(h, prepend=np.uint64(0)).view(np.int64)


def hashes(steps_: np.ndarray) -> np.ndarray:
    return np.cumsum(steps_.view(np.uint64), dtype=np.uint64)


def volumes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(v, keys, blob, sizes, bytes)``: the rows in volumes of about VOLUME_BYTES, numbered, written to the shared folder."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        texts: list[bytes] = []
        held = 0

        def volume() -> pa.RecordBatch:
            blob, sizes = pack_texts(texts)
            return pa.RecordBatch.from_arrays([pa.array([np.array(keys, dtype="<i8").tobytes()]), pa.array([blob]), pa.array([sizes]), pa.array([held])], names=["keys", "blob", "sizes", "bytes"])

        for many in batches:
            for batch in slices(many, 200):
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    keys.append(LAST if k is None else k)
                    texts.append((t or "").encode("utf-8", "replace"))
                    held += len(texts[-1])
                    if held >= VOLUME_BYTES:
                        yield volume()
                        keys, texts, held = [], [], 0
        if keys:
            yield volume()

    plain = rows.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`"))
    return settle(plain.mapInArrow(store, "keys binary, blob binary, sizes binary, bytes long")).withColumn("v", F.monotonically_increasing_id())


def _volumes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, list[bytes]]]:
    """Each volume of a task by itself: its row, keys and texts."""
    for many in batches:
        for batch in slices(many, 1):
            row = batch.to_pylist()[0]
            yield row, np.frombuffer(row["keys"], dtype="<i8"), unpack_texts(row["blob"], row["sizes"])


def questions(stored: DataFrame, shards: int, window: int) -> DataFrame:
    """``(shard, v, size, h, key, doc, at, n)``: for each volume and shard the distinct seeds, ascending, with their first place there and the texts' number."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Codes()
        for row, keys, texts in _volumes_of(batches):
            hs, docs, ats, more = [], [], [], []
            for d, text in enumerate(texts):
                h, at = seeds(hashed(text.split(), known), window)
                if len(h):
                    at = np.unique(at, return_index=True)
                    h, first, often = np.unique(h[at[1]], return_index=True, return_counts=True)
                    hs.append(h)
                    docs.append(np.full(len(h), d, dtype=np.int64))
                    ats.append(at[0][first])
                    # a text that holds the seed twice counts as two
                    more.append(np.minimum(often, 2))
            if not hs:
                continue
            h, doc, at, n = np.concatenate(hs), np.concatenate(docs), np.concatenate(ats), np.concatenate(more)
            order = np.lexsort((at, keys[doc], h))
            h, doc, at, n = h[order], doc[order], at[order], n[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.add.reduceat(n, start)
            h, doc, at = h[start], doc[start], at[start]
            edges = [*np.searchsorted(h, np.array([((s << 32) // shards) << 32 for s in range(shards)], dtype=np.uint64)).tolist(), len(h)]
            out = [(s, lo, hi) for s, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])) if hi > lo]
            columns = [pa.array(x, type=pa.int64()) for x in ([s for s, *_ in out], [row["v"]] * len(out), [hi - lo for _, lo, hi in out])]
            columns += [pa.array([squeezed(steps(x[lo:hi]) if x is h else x[lo:hi]) for _, lo, hi in out], type=pa.binary()) for x in (h, keys[doc], doc, at, n)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "v", "size", *ASKED])

    return stored.select("v", "keys", "blob", "sizes").mapInArrow(ask, "shard long, v long, size long, " + ", ".join(f"{c} binary" for c in ASKED))


ASKED = ("h", "key", "doc", "at", "n")
ANSWER = ("h", "rkey", "rv", "rdoc", "rat", "n")


def answers(asked: DataFrame) -> DataFrame:
    """``(v, size, h, rkey, rv, rdoc, rat, n)``: of each volume's seeds those that stand in several places, with their first place and the number of texts.

    A shard has SHARD_SEEDS or so of them, one for each volume that holds a seed.
    """

    def answer(keys: tuple, table: pa.Table) -> pa.Table:
        vs = np.asarray(table.column("v"))
        lengths = table.column("size").to_pylist()
        h, key, doc, at, n = (np.concatenate([hashes(whole(x, m)) if c == "h" else whole(x, m) for x, m in zip(table.column(c).to_pylist(), lengths)]) for c in ASKED)
        asker = np.repeat(np.arange(len(vs)), lengths)
        order = np.lexsort((asker, at, key, h))
        sorted_ = h[order]
        start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        total = np.add.reduceat(n[order], start)
        group = np.empty(len(h), dtype=np.int64)
        group[order] = np.repeat(np.arange(len(start)), np.diff(np.concatenate([start, [len(h)]])))
        first = order[start][group]
        many = total[group] > 1
        columns: dict[str, list] = {"v": [], "size": []} | {c: [] for c in ANSWER}
        ends = np.cumsum(lengths)
        for i, (lo, hi) in enumerate(zip(ends - lengths, ends)):
            mine = lo + np.flatnonzero(many[lo:hi])
            if not len(mine):
                continue
            f = first[mine]
            columns["v"].append(vs[i])
            columns["size"].append(len(mine))
            for c, x in zip(ANSWER, (steps(h[mine]), key[f], vs[asker[f]], doc[f], at[f], total[group[mine]])):
                columns[c].append(squeezed(x))
        return pa.table({c: pa.array(columns[c], type=pa.int64()) for c in ("v", "size")} | {c: pa.array(columns[c], type=pa.binary()) for c in ANSWER})

    return asked.groupBy("shard").applyInArrow(answer, "v long, size long, " + ", ".join(f"{c} binary" for c in ANSWER))


def cut(stored: DataFrame, answered: DataFrame, window: int) -> DataFrame:
    """Reference blocks and suspects: ``(rv, rdoc, block, salt, kind, v, doc, key, start, words)``.

    A block (kind 0) is named by its volume, text and number there, and comes once for every
    SHARE suspects (kind 1) of its most frequent seed; a suspect goes to one of these by its
    volume and text. ``start`` is the place of the first of the ``words``.
    """
    margin = window - SEED

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Codes()
        names = ["rv", "rdoc", "block", "salt", "kind", "v", "doc", "key", "start", "words"]
        kinds = [pa.int64()] * 9 + [pa.binary()]
        for row, keys, texts in _volumes_of(batches):
            found = [np.concatenate([hashes(whole(a[c], a["size"])) if c == "h" else whole(a[c], a["size"]) for a in row["answers"]]) for c in ANSWER]
            order = np.argsort(found[0])
            h, rkey, rv, rdoc, rat, total = (x[order] for x in found)
            salts = np.maximum(1, -(-total // SHARE))
            block = rat // BLOCK_WORDS
            out: list[tuple] = []
            for d, text in enumerate(texts):
                words = text.split()
                own, at = seeds(hashed(words, known), window)
                if not len(own):
                    continue
                i = np.minimum(np.searchsorted(h, own), len(h) - 1)
                several = h[i] == own
                first = several & (rkey[i] == keys[d]) & (rat[i] == at)
                mine = first & (rv[i] == row["v"]) & (rdoc[i] == d)
                key = int(keys[d])
                for b in np.unique(block[i[mine]]).tolist():
                    lo, hi = max(0, b * BLOCK_WORDS - margin), (b + 1) * BLOCK_WORDS + window
                    here = b" ".join(words[lo:hi])
                    for salt in range(int(salts[i[mine]][block[i[mine]] == b].max())):
                        out.append((row["v"], d, b, salt, 0, row["v"], d, key, lo, here))
                suspect = np.flatnonzero(several & ~first)
                if len(suspect):
                    j = i[suspect]
                    new = (np.diff(suspect) != 1) | (rv[j][1:] != rv[j][:-1]) | (rdoc[j][1:] != rdoc[j][:-1]) | (block[j][1:] != block[j][:-1])
                    edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(suspect)]
                    for lo, hi in zip(edges[:-1], edges[1:]):
                        for a in range(lo, hi, SUSPECT_WINDOWS):
                            s, e, to = int(suspect[a]), int(suspect[min(hi, a + SUSPECT_WINDOWS) - 1]), int(j[a])
                            salt = (row["v"] * 31 + d) % int(salts[to])
                            out.append((int(rv[to]), int(rdoc[to]), int(block[to]), salt, 1, row["v"], d, key, s, b" ".join(words[s : e + window])))
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=names)

    gathered = answered.groupBy("v").agg(F.collect_list(F.struct("size", *ANSWER)).alias("answers"))
    full = stored.select("v", "keys", "blob", "sizes").join(gathered, "v")
    return full.mapInArrow(find, "rv long, rdoc long, block long, salt long, kind long, v long, doc long, key long, start long, words binary")


class Reference:
    """A reference block, indexed by its runs of SEED words."""

    def __init__(self, words: list[bytes], key: int, start: int):
        self.key, self.start = key, start
        self.number: dict[bytes, int] = {}
        self.words = [self.number.setdefault(w, len(self.number)) for w in words]
        self.index: dict[tuple[int, ...], list[int]] = {}
        for j in range(len(words) - SEED + 1):
            self.index.setdefault(tuple(self.words[j : j + SEED]), []).append(j)

    def factors(self, phrase: list[int], key: int, start: int) -> list[tuple[int, int]]:
        """Greedy parse of a phrase: (place, length) of the longest matches; words between them are in no run of the block.

        ``key`` and ``start`` place the phrase: matches in its own text must begin before it.
        """
        out, i, block = [], 0, self.words
        while i + SEED <= len(phrase):
            longest = 0
            for j in self.index.get(tuple(phrase[i : i + SEED]), ()):
                if len(block) - j <= longest or self.key == key and self.start + j >= start + i:
                    break
                n = SEED
                most = min(len(phrase) - i, len(block) - j)
                while n < most and phrase[i + n] == block[j + n]:
                    n += 1
                longest = max(longest, n)
            if longest:
                out.append((i, longest))
            i += longest or 1
        return out

    def repeats(self, words: list[bytes], key: int, start: int, window: int) -> list[bool]:
        """Whether the block holds each window of a suspect, at an earlier place."""
        phrase = [self.number.get(w, -1) for w in words]
        n = len(phrase) - window + 1
        found = [False] * n
        for i, length in self.factors(phrase, key, start):
            for s in range(i, i + length - window + 1):
                found[s] = True
        for s in range(n):  # windows across the ends of factors
            if not found[s]:
                for j in self.index.get(tuple(phrase[s : s + SEED]), ()):
                    if self.key == key and self.start + j >= start + s:
                        break
                    if self.words[j : j + window] == phrase[s : s + window]:
                        found[s] = True
                        break
        return found


def spans_of(found: list[bool], start: int, window: int) -> list[tuple[int, int]]:
    """Words covered by the windows found, as (first, behind the last) with ``start`` for the first window."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.array(found, dtype=np.int8), [0]])))
    return [(start + a, start + b - 1 + window) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def parsed(pieces: DataFrame, window: int) -> DataFrame:
    """``(v, doc, start, stop, key, w1, w2)``: spans that repeat an earlier text, and windows left over with their digest.

    A block comes before its suspects, so a task holds one block at a time.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = None
        names, kinds = ["v", "doc", "start", "stop", "key", "w1", "w2"], [pa.int64()] * 7
        for many in batches:
            for batch in slices(many):
                out: list[tuple] = []
                for row in batch.to_pylist():
                    words = row["words"].split(b" ")
                    if row["kind"] == 0:
                        reference = Reference(words, row["key"], row["start"])
                        continue
                    found = reference.repeats(words, row["key"], row["start"], window)
                    out += [(row["v"], row["doc"], a, b, None, None, None) for a, b in spans_of(found, row["start"], window)]
                    for s, yes in enumerate(found):
                        if not yes:
                            digest = xxhash.xxh3_128_intdigest(b" ".join(words[s : s + window]))
                            w1, w2 = np.array([digest >> 64, digest & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64).view(np.int64).tolist()
                            out.append((row["v"], row["doc"], row["start"] + s, row["start"] + s + window, row["key"], w1, w2))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=names)

    name = ["rv", "rdoc", "block", "salt"]
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(tasks, *name).sortWithinPartitions(*name, "kind").mapInArrow(parse, "v long, doc long, start long, stop long, key long, w1 long, w2 long")


def remove_repeats(rows: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, n_removed, kept)``: every row's text without the words of windows that begin earlier too.

    A window is ``window`` words in a row of one text; earlier is a smaller key, or the same
    key and an earlier word. All windows are those of the input. ``kept`` are the other
    words, joined by a space. Null, empty and short texts keep what they have; a null key
    comes after all others (as 2^63 - 1); rows of one key count as one text, so equal rows
    are not repeats of each other. Texts of any length are read whole. Other columns are not
    read. Keys must be whole numbers; a key column called like a result column is an error.
    An empty table gives no rows.
    """
    if not isinstance(rows.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must hold whole numbers")
    if key.lower() in ("n_words", "n_removed", "kept"):
        raise ValueError(f"the key column cannot be called {key}")
    if window < 2 * SEED:
        raise ValueError(f"a window must have {2 * SEED} words at least")
    stored = volumes(rows, key, text)
    total = stored.agg(F.sum("bytes")).first()[0] or 0
    asked = questions(stored, max(1, -(-total // (SEED_BYTES * SHARD_SEEDS))), window)
    told = settle(parsed(cut(stored, answers(asked), window), window))
    left = told.where(F.col("w1").isNotNull())
    place = F.struct("key", "start")
    firsts = left.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("w1", "w2", "first")
    later = left.join(firsts, ["w1", "w2"]).where(F.struct("key", "start") > F.col("first"))
    spans = told.where(F.col("w1").isNull()).select("v", "doc", "start", "stop").unionByName(later.select("v", "doc", "start", "stop"))
    by = spans.groupBy("v").agg(F.collect_list(F.struct("doc", "start", "stop")).alias("spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["key", "n_words", "n_removed", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for row, keys, texts in _volumes_of(batches):
            mine: dict[int, list[tuple[int, int]]] = {}
            for s in row["spans"] or ():
                mine.setdefault(s["doc"], []).append((s["start"], s["stop"]))
            out, size = [], 0
            for d, body in enumerate(texts):
                words = body.split()
                n = len(words)
                if d in mine:
                    gone = np.zeros(n + 1, dtype=np.int64)
                    for a, b in mine[d]:
                        gone[a] += 1
                        gone[b] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:n] == 0).tolist()]
                out.append((None if keys[d] == LAST else int(keys[d]), n, n - len(words), b" ".join(words).decode("utf-8")))
                size += len(body)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=names)

    full = stored.select("v", "keys", "blob", "sizes").join(by, "v", "left")
    kept = full.mapInArrow(keep, "key long, n_words long, n_removed long, kept string")
    return kept.select(F.col("key").cast(rows.schema[key].dataType).alias(key), "n_words", "n_removed", "kept")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words without repeated windows of twenty."""
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def oracle() -> str:
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    p AS (SELECT row, doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda j: sha256(array_to_string(ws[j : j + {WINDOW - 1}], ' ')))) AS h FROM d),
    w AS (SELECT row, doc_id, i, h, word FROM p),
    f AS (SELECT h, min((coalesce(doc_id, {LAST}), i)) AS first FROM w WHERE h IS NOT NULL GROUP BY h),
    m AS (SELECT w.row, w.i, w.word, coalesce((coalesce(w.doc_id, {LAST}), w.i) > f.first, false) AS again FROM w LEFT JOIN f USING (h)),
    k AS (SELECT row, i, word, bool_or(again) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM m),
    o AS (SELECT row, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY row)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (row)
    """
