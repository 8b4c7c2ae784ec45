"""A streaming source of a folder's changed files: new ones, and ones replaced under their name.

Spark's own file source knows files by their paths, so it passes over a file that is written
anew. This one keeps manifests, numbered from 1, of every file's time of change and size; the
offset of a batch is a manifest's number, and its rows are the files in which two manifests
differ. Manifests lie beside the query's checkpoint, so a batch that runs again after a
failure has the same rows, and one that was finished does not come back.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "path string, signature string, gone boolean"
#: Files of one partition of a batch.
FILES = 1000


class Files(InputPartition):
    def __init__(self, rows: list[tuple[str, str | None, bool]]):
        super().__init__(0)
        self.rows = rows


class ChangedFilesReader(DataSourceStreamReader):
    """Options: ``folder``, ``manifests`` (a folder of this query's own) and ``pattern`` of file names."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.manifests, self.pattern = options["folder"], options["manifests"].rstrip("/"), options.get("pattern", "*")

    @staticmethod
    def _at(path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def listed(self) -> dict[str, str]:
        """path -> time of change and size of the files that are there; no content is read."""
        store, root = self._at(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {f.path: f"{f.mtime_ns or 0}:{f.size}" for f in found if f.is_file and fnmatch(f.base_name, self.pattern) and not f.base_name.startswith(("~$", ".", "_"))}

    def held(self, number: int) -> dict[str, str]:
        if number < 1:
            return {}
        store, root = self._at(self.manifests)
        with store.open_input_stream(f"{root}/{number:012}.json") as file:
            return json.loads(file.read().decode("utf-8"))

    def last(self) -> int:
        store, root = self._at(self.manifests)
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"manifest": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The last manifest, after a new one if the folder differs from it."""
        number, now = self.last(), self.listed()
        if now != self.held(number):
            store, root = self._at(self.manifests)
            store.create_dir(root, recursive=True)
            number += 1
            # whole under another name first, so that a manifest is never cut short
            with store.open_output_stream(f"{root}/.{number:012}.tmp") as file:
                file.write(json.dumps(now).encode("utf-8"))
            store.move(f"{root}/.{number:012}.tmp", f"{root}/{number:012}.json")
        return {"manifest": number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = self.held(start["manifest"]), self.held(end["manifest"])
        rows = [(p, s, False) for p, s in sorted(after.items()) if before.get(p) != s] + [(p, None, True) for p in sorted(before) if p not in after]
        return [Files(rows[i : i + FILES]) for i in range(0, len(rows), FILES)] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.rows


class ChangedFiles(DataSource):
    """``spark.readStream.format("changed_files")``; rows of ``path``, ``signature`` and whether the file is ``gone``."""

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return ChangedFilesReader(dict(self.options))


def changed_files(spark: SparkSession, folder: str, manifests: str, pattern: str = "*") -> DataFrame:
    """The stream of a folder's changes."""
    spark.dataSource.register(ChangedFiles)
    return spark.readStream.format("changed_files").option("folder", folder).option("manifests", manifests).option("pattern", pattern).load()


def follow_changes(spark: SparkSession, folder: str, checkpoint: str, ingest: Callable[[list[str], list[str]], None], pattern: str = "*", once: bool = False, interval: str = "60 seconds") -> StreamingQuery:
    """Hand the paths of changed and of gone files to ``ingest``, batch by batch.

    ``ingest`` may see a batch again after a failure and must bear that, as an upsert by
    source does; a batch that it finished does not come again, restarts included. A batch's
    paths come to the driver, as names only.
    """

    def take(batch: DataFrame, _: int) -> None:
        rows = batch.collect()
        changed, gone = [r["path"] for r in rows if not r["gone"]], [r["path"] for r in rows if r["gone"]]
        if changed or gone:
            ingest(changed, gone)

    writer = changed_files(spark, folder, f"{checkpoint}/manifests", pattern).writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint}/offsets")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
