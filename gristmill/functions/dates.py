"""Dates written as text or in file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.columns import qcol, stripped

# Strptime directives and what Spark calls them.
DIRECTIVES = {"%d": "d", "%m": "M", "%Y": "yyyy", "%y": "yy", "%H": "H", "%M": "m", "%S": "s", "%b": "MMM", "%B": "MMMM"}
PARTS = r"^\s*(\d{1,4})[./-](\d{1,2})[./-](\d{1,4})"


def spark_format(strptime: str) -> str:
    for directive, letters in DIRECTIVES.items():
        strptime = strptime.replace(directive, letters)
    return strptime


def dayfirst(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, first, second, dayfirst) from the largest first and second parts of each column's dates.

    A first part over 12 means day first, a second part over 12 month first; a first part
    over 31 (a year) or neither leaves it open.
    """
    part = lambda c, k: F.max(F.regexp_extract(qcol(c), PARTS, k).try_cast("int"))
    found = df.agg(*[part(c, k).alias(f"{i}_{k}") for i, c in enumerate(columns) for k in (1, 2)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{i}_1").alias("first"), F.col(f"{i}_2").alias("second")) for i, c in enumerate(columns)])
    verdict = F.when(F.col("first") > 31, None).when(F.col("first") > 12, True).when(F.col("second") > 12, False)
    return found.select(F.explode(rows).alias("v")).select("v.*").withColumn("dayfirst", verdict)


def parse_date(column: Column, strptime: str | None = None, day_first: bool = True) -> Column:
    """A timestamp by an explicit format, else by the usual ones; null where none fits."""
    text = stripped(column)
    if strptime is not None:
        return F.try_to_timestamp(text, F.lit(spark_format(strptime))).cast("timestamp_ntz")
    usual = ["yyyy-M-d", "yyyy-M-d H:m:s", *(["d.M.yyyy", "d/M/yyyy", "d-M-yyyy"] if day_first else ["M.d.yyyy", "M/d/yyyy", "M-d-yyyy"])]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in usual]).cast("timestamp_ntz")


def month_end(column: Column) -> Column:
    return F.last_day(column)


def filename_asof(name: Column) -> Column:
    """The day in a file's name, ``dd-mm-yyyy`` or ``yyyy-mm-dd`` with any of ``-._``."""
    day_first = F.regexp_extract(name, r"(?<!\d)(\d{1,2}[-._]\d{1,2}[-._](?:19|20)\d{2})(?!\d)", 1)
    iso = F.regexp_extract(name, r"(?<!\d)((?:19|20)\d{2}[-._]\d{1,2}[-._]\d{1,2})(?!\d)", 1)
    return F.coalesce(F.try_to_date(F.translate(day_first, "._", "--"), "d-M-yyyy"), F.try_to_date(F.translate(iso, "._", "--"), "yyyy-M-d"))


def content_date(df: DataFrame, columns: list[str], share: float = 0.9, least: int = 10) -> DataFrame:
    """(column, day, share) of the date column with the most constant value, if it is constant
    enough over enough values; no row otherwise."""
    days = df.select(*[qcol(c).cast("date").alias(c) for c in columns]).unpivot([], [qcol(c) for c in columns], "column", "day").where("day is not null")
    counts = days.groupBy("column", "day").count()
    best = counts.groupBy("column").agg(F.max_by("day", F.struct("count", "day")).alias("day"), F.max("count").alias("n"), F.sum("count").alias("all"))
    fit = best.where((F.col("all") >= least) & (F.col("n") >= share * F.col("all")))
    return fit.select("column", "day", (F.col("n") / F.col("all")).alias("share")).orderBy(F.desc("share"), "column").limit(1)
