"""Folders that change: which files are new, and tables kept up to date by source file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gristmill.columns import qcol

MANIFEST = "path string, signature string"


def signatures(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, signature)`` of a folder's files: time of change and size. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.concat_ws(":", F.unix_millis("modificationTime").cast("string"), F.col("length").cast("string")).alias("signature")).where(~F.contains("path", F.lit("/~$")))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new or differ from the manifest."""
    return now.join(before, ["path", "signature"], "left_anti")


def poll(spark: SparkSession, folder: str, manifest: str, ingest: Callable[[list[str]], None], pattern: str = "*") -> list[str]:
    """One round: hand changed files to ``ingest`` and remember their signatures.

    The first round remembers only. Signatures are kept after a successful ``ingest``, so
    a failed round is tried again; ``ingest`` must therefore bear repeats, as an upsert does.
    """
    now = signatures(spark, folder, pattern)
    path = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        now.write.parquet(manifest)
        return []
    found = changed(now, spark.read.schema(MANIFEST).parquet(manifest))
    paths = [r["path"] for r in found.select("path").collect()]
    if paths:
        ingest(paths)
        found.write.mode("append").parquet(manifest)
    return paths


def upsert_partitions(df: DataFrame, target: str, source: str = "source") -> None:
    """Replace the partitions of the sources in ``df`` and leave all others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(target)


def follow(spark: SparkSession, folder: str, schema: T.StructType | str, target: str, checkpoint: str, source: str = "source", fmt: str = "json", once: bool = False, interval: str = "60 seconds", **options: str) -> StreamingQuery:
    """Stream a folder's new files into ``target``, each file's rows under its name as their source.

    Batches replace whole sources, so a batch that runs again after a failure changes
    nothing: at least once delivery, the outcome of exactly once.
    """
    stream = spark.readStream.format(fmt).schema(schema).options(**options).load(folder)
    named = stream.withColumn(source, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    writer = named.writeStream.foreachBatch(lambda batch, _: upsert_partitions(batch, target, source)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def windowed(events: DataFrame, at: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", lateness: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; on a stream, events later than ``lateness`` are left out.

    An extension: the engine itself knows no event time.
    """
    rows = events.withWatermark(at, lateness) if events.isStreaming else events
    frame = F.window(qcol(at), width, slide) if slide else F.window(qcol(at), width)
    out = rows.groupBy(frame.alias("w"), qcol(key)).agg(F.count(F.lit(1)).alias("n"), F.sum(qcol(value)).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), qcol(key), "n", "total")


def sessions(events: DataFrame, at: str = "ts", key: str = "user_id", gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    """Sessions of a key's events with gaps shorter than ``gap``; an extension, like ``windowed``."""
    rows = events.withWatermark(at, lateness) if events.isStreaming else events
    out = rows.groupBy(F.session_window(qcol(at), gap).alias("w"), qcol(key)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), qcol(key), "n")
