"""The engine's Spark session."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# What the operators rely on; everything about size is left to the cluster.
SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # what operators write to the checkpoint folder goes when nothing refers to it any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(name: str = "gristmill", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the folder that ``spark.checkpoint.dir`` names, which all
    executors share. A session on one machine without that setting gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)
