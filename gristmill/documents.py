"""Documents in parts: chunks with their inverted index and, with an embedder, their vectors.

A part is made once, for the sources that were loaded together, and not changed any more. A
source that is loaded again leaves the older parts by the ids of its chunks, which stand in a
list of their own; counts are kept as differences, so statistics are those of the live chunks.
``compacted`` writes small parts and such lists together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import cells as C
from gristmill.operators import postings as P
from gristmill.operators import retrieval as H
from gristmill.session import stored
from gristmill.sources.files import cache_key, cache_misses
from gristmill.sources.store import Manifest, Store

Embedder = Callable[[list[str]], list[list[float]]]
CHUNK = ("source", "location", "position", "chunk")
#: Parts after which a save writes them together.
MOST_PARTS = 16
SUMMARY = "cell int, centre array<double>, n long, low double, high double"


@dataclass
class Part:
    """Chunks (``chunk_id``, ``n`` and the columns of CHUNK), their index, and what of them holds no more."""

    chunks: DataFrame
    index: P.Part
    vectors: DataFrame | None = None  # chunk_id, embedding, cell, apart
    centres: np.ndarray | None = None
    bands: list[Sequence] | None = None
    entry: dict[str, Any] | None = None  # as the manifest has it, if it is stored

    def live(self, rows: DataFrame) -> DataFrame:
        return rows if self.index.gone is None else rows.join(self.index.gone.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")


class Documents:
    """The parts of a store of documents, oldest first."""

    def __init__(self, embedder: Embedder | None = None, model: str = "", parts: Sequence[Part] = ()):
        self.embedder, self.model, self.parts = embedder, model, list(parts)
        self.cache: list[DataFrame] = []  # (key, embedding) of texts embedded before
        self.fresh: list[DataFrame] = []  # those of this session

    @property
    def chunks(self) -> DataFrame | None:
        """All live chunks."""
        return reduce(DataFrame.unionByName, [p.live(p.chunks).select(*CHUNK) for p in self.parts]) if self.parts else None

    @property
    def count(self) -> int:
        return sum(p.index.n - p.index.gone_n for p in self.parts)

    def add(self, chunks: DataFrame) -> None:
        """Take up the chunks of some sources, in place of what these sources had."""
        part = self._made(chunks.select(*CHUNK))
        sources = part.chunks.select("source").distinct()
        self.parts = [self._without(p, sources) for p in self.parts]
        self.parts.append(part)

    def remove(self, sources: DataFrame) -> None:
        """Forget the sources in the column ``source``."""
        self.parts = [self._without(p, sources.select("source").distinct()) for p in self.parts]

    def _without(self, part: Part, sources: DataFrame) -> Part:
        lost = part.live(part.chunks).join(sources, "source", "left_semi")
        n, total = P.sizes(lost)
        if not n:
            return part
        gone = stored(lost.select(F.col("chunk_id").alias("id")))
        if part.index.gone is not None:
            gone = part.index.gone.select("id").unionByName(gone)
        entry = None if part.entry is None else {**part.entry, "lost": True}
        return replace(part, index=replace(part.index, gone=gone, gone_n=part.index.gone_n + n, gone_total=part.index.gone_total + total), entry=entry)

    def _made(self, chunks: DataFrame) -> Part:
        """A part of chunks: neighbours in a source are neighbours in the numbers that spans count."""
        tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keyed = chunks.withColumn("chunk_id", F.xxhash64("source", "location", "position"))
        ordered = keyed.repartitionByRange(tasks, "source", "location", "position").sortWithinPartitions("source", "location", "position")
        numbered = stored(ordered.withColumn("n", F.monotonically_increasing_id()))
        part = Part(numbered, P.Part(stored(P.postings(numbered)), *P.sizes(numbered)))
        return self._with_vectors(part) if self.embedder is not None else part

    def _with_vectors(self, part: Part) -> Part:
        """The part with the vectors of its chunks; texts that were embedded before are looked up, equal ones embedded once."""
        shown = F.concat_ws(" ", F.concat(F.lit("["), F.col("source"), F.lit("]")), F.col("chunk"))
        texts = part.chunks.select("chunk_id", shown.alias("text"))
        known = reduce(DataFrame.unionByName, [*self.cache, *self.fresh], texts.sparkSession.createDataFrame([], "key string, embedding array<float>"))
        new = stored(H.embed(cache_misses(texts, known, self.model), self.embedder, "text", None).select("key", "embedding"))
        self.fresh.append(new)
        keyed = texts.select("chunk_id", cache_key(self.model, F.col("text")).alias("key"))
        vectors = stored(keyed.join(known.unionByName(new), "key").select("chunk_id", "embedding"))
        centres = C.fit(vectors, key="chunk_id")
        if not len(centres):
            return replace(part, vectors=None)
        placed = stored(C.placed(vectors, centres))
        return replace(part, vectors=placed, centres=centres, bands=[tuple(r) for r in C.summary(placed).collect()])

    def sparse(self, query: str, k: int = H.FETCH) -> DataFrame:
        """``(id, score)`` of the best chunks by BM25, from the index."""
        return P.bm25_topk([p.index for p in self.parts], query, k)

    def dense(self, vector: Sequence[float], k: int = H.FETCH) -> DataFrame | None:
        """``(id, score)`` of the nearest chunks; None if any part has no vectors."""
        if not self.parts or any(p.vectors is None and p.index.n for p in self.parts):
            return None
        lists = [C.exact_topk(p.live(p.vectors), p.centres, p.bands, vector, k, "chunk_id") for p in self.parts if p.index.n]
        return reduce(DataFrame.unionByName, lists).orderBy(F.desc("score"), "id").limit(k) if lists else None

    def hits(self, found: DataFrame) -> DataFrame:
        """The chunks of a short list of ids, with its scores."""
        some = found.select("id").collect()
        wanted = [p.chunks.where(F.col("chunk_id").isin([r["id"] for r in some])) if some else p.chunks.where(F.lit(False)) for p in self.parts]
        rows = reduce(DataFrame.unionByName, [p.live(w).select("chunk_id", *CHUNK) for p, w in zip(self.parts, wanted)])
        return found.join(rows.withColumnRenamed("chunk_id", "id"), "id").orderBy(F.desc("score"), "id")

    def compacted(self) -> None:
        """All live chunks as one part, made anew."""
        if self.parts:
            self.parts = [self._made(stored(self.chunks))]

    def beside(self, others: Sequence[Part]) -> None:
        """Put parts of another save before those that are new here; a source that is new here leaves them."""
        new = [p for p in self.parts if p.entry is None]
        if new and others:
            sources = reduce(DataFrame.unionByName, [p.chunks.select("source") for p in new]).distinct()
            others = [self._without(p, sources) for p in others]
        self.parts = [p for p in self.parts if p.entry is not None] + list(others) + new

    def save(self, store: Store, manifest: Manifest) -> None:
        """Write the parts that the store lacks and put all of them into ``manifest``."""
        if len(self.parts) > MOST_PARTS:
            self.compacted()
        entries = []
        for i, part in enumerate(self.parts):
            entry = dict(part.entry or {})
            if not entry:
                entry = {"path": store.write(part.chunks, "chunks"), "postings": store.new_path("postings"), "n": part.index.n, "total": part.index.total}
                P.write(part.index.postings, f"{store.folder}/{entry['postings']}")
                if part.vectors is not None:
                    entry["cells"] = store.new_path("cells")
                    C.write(part.vectors, f"{store.folder}/{entry['cells']}")
                    known = {b[0]: b[1:] for b in part.bands or ()}
                    rows = [(i, c, *known.get(i, (0, 0.0, 0.0))) for i, c in enumerate(part.centres.tolist())]
                    entry |= {"summary": store.write(store.spark.createDataFrame(rows, SUMMARY), "summary"), "model": self.model}
            if part.index.gone is not None and (entry.pop("lost", False) or "gone" not in entry):
                entry["gone"] = [store.write(part.index.gone.select("id"), "gone")]
            entry |= {"gone_n": part.index.gone_n, "gone_total": part.index.gone_total}
            entries.append(entry)
            self.parts[i] = replace(part, entry=entry)
        manifest.documents = entries
        if self.fresh:
            manifest.vectors = [*manifest.vectors, store.write(reduce(DataFrame.unionByName, self.fresh), "vectors")]
            self.cache, self.fresh = [*self.cache, *self.fresh], []

    @classmethod
    def open(cls, store: Store, manifest: Manifest, embedder: Embedder | None = None, model: str = "") -> Documents:
        """The documents of a version. Vectors of another model are not taken up, and made anew if an embedder is given."""
        out = cls(embedder, model)
        out.cache = [store.frame(p) for p in manifest.vectors]
        for e in manifest.documents:
            gone = reduce(DataFrame.unionByName, [store.frame(g) for g in e["gone"]]) if e.get("gone") else None
            part = Part(store.frame(e["path"]), P.Part(store.frame(e["postings"]), e["n"], e["total"], gone, e.get("gone_n", 0), e.get("gone_total", 0)), entry=e)
            if e.get("cells") and e.get("model", "") == model:
                rows = store.frame(e["summary"]).orderBy("cell").collect()  # MOST_CELLS at most
                part = replace(part, vectors=store.frame(e["cells"]), centres=np.array([r["centre"] for r in rows]), bands=[(r["cell"], r["n"], r["low"], r["high"]) for r in rows if r["n"]])
            elif embedder is not None:
                part = replace(out._with_vectors(part), entry=None)
            out.parts.append(part)
        return out
