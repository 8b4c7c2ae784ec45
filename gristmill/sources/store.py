"""A store of immutable parts and numbered manifests.

A save writes new parts beside the old ones and then one manifest, ``manifests/<number>.json``,
that names every part of the version. The file is made under its own name or not at all, so a
version is there whole or it is not, a save that dies leaves parts that no manifest names, and
of two saves on one version the second is told so. Readers hold the parts of the version
they opened; ``vacuum`` alone removes parts, those that the last manifests do not name.
"""

from __future__ import annotations

import copy
import json
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Versions that ``vacuum`` keeps, and seconds that a part without a manifest may be one of a save under way.
KEPT_VERSIONS, GRACE = 3, 3600.0


class StoreConflict(RuntimeError):
    """Another save made the next version first."""


@dataclass
class Manifest:
    """A version: tables by name, document parts in order, and metadata by table."""

    number: int = 0
    tables: dict[str, dict[str, Any]] = field(default_factory=dict)
    documents: list[dict[str, Any]] = field(default_factory=list)
    vectors: list[str] = field(default_factory=list)  # parts of the cache of embeddings
    links: list[dict[str, Any]] = field(default_factory=list)

    def copy(self) -> Manifest:
        return copy.deepcopy(self)

    def paths(self) -> set[str]:
        """Every part that the version needs."""
        out = set(self.vectors)
        for t in self.tables.values():
            out |= {t[k] for k in ("path", "values", "tokens") if t.get(k)}
        for d in self.documents:
            out |= {d[k] for k in ("path", "postings", "cells", "summary") if d.get(k)} | set(d.get("gone", ()))
        return out


class Store:
    """The parts and manifests under one folder, in whatever store Spark's file systems reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str) -> Any:
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self) -> Any:
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The versions that are there, ascending."""
        fs, at = self._fs(), self._path("manifests")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int | None = None) -> Manifest:
        """The manifest of a version, of the last one if none is named; of an empty store an empty one.

        A manifest that is cut short, as a store without atomic creation may leave, counts as not there.
        """
        known = self.numbers()
        if number is not None and number not in known:
            raise ValueError(f"the store has no version {number}")
        for n in reversed(known) if number is None else [number]:
            try:
                text = "\n".join(r[0] for r in self.spark.read.text(str(self._path(f"manifests/{n:012}.json").toString()), wholetext=True).collect())
                return Manifest(**json.loads(text))
            except (ValueError, TypeError):
                if number is not None:
                    raise
        return Manifest()

    def write(self, df: DataFrame, kind: str) -> str:
        """A new part; it belongs to no version until a manifest names it."""
        path = self.new_path(kind)
        df.write.parquet(f"{self.folder}/{path}")
        return path

    def new_path(self, kind: str) -> str:
        return f"parts/{kind}-{int(time.time() * 1000):013}-{uuid.uuid4().hex[:12]}"

    def frame(self, path: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{path}")

    def commit(self, manifest: Manifest, base: Manifest) -> Manifest:
        """Make ``manifest`` the version after ``base``; StoreConflict if there is one already."""
        made = manifest.copy()
        made.number = base.number + 1
        fs, at = self._fs(), self._path(f"manifests/{made.number:012}.json")
        body = bytearray(json.dumps(made.__dict__, ensure_ascii=False, default=str).encode("utf-8"))
        fs.mkdirs(self._path("manifests"))
        whole = self._path(f"manifests/.{uuid.uuid4().hex}.tmp")
        out = fs.create(whole, False)
        try:
            out.write(body)
        finally:
            out.close()
        # renaming onto a name that is there fails: the first of two saves wins
        if fs.exists(at) or not fs.rename(whole, at):
            fs.delete(whole, False)
            raise StoreConflict(f"version {made.number} of {self.folder} was made by another save")
        return made

    def vacuum(self, keep: int = KEPT_VERSIONS, grace: float = GRACE) -> list[str]:
        """Remove parts and manifests of all but the last ``keep`` versions; parts younger than ``grace`` seconds stay."""
        numbers = self.numbers()
        held = set().union(*(self.read(n).paths() for n in numbers[-keep:])) if numbers else set()
        fs, at, gone = self._fs(), self._path("parts"), []
        if fs.exists(at):
            for status in fs.listStatus(at):
                name = f"parts/{status.getPath().getName()}"
                if name not in held and int(name.split("-")[1]) / 1000 < time.time() - grace:
                    fs.delete(status.getPath(), True)
                    gone.append(name)
        for n in numbers[:-keep]:
            fs.delete(self._path(f"manifests/{n:012}.json"), False)
        return gone
