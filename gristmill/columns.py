"""Column helpers that every operator shares."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "__row_id"
IS_SUMMARY = "__is_summary"


def qcol(name: str, frame: str | None = None) -> Column:
    """A column by its literal name, whatever dots, colons or quotes the name has."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{frame}.{quoted}" if frame else quoted)


def stripped(column: Column) -> Column:
    """Text without white space of any kind at either end."""
    return F.regexp_replace(column.cast("string"), r"^\s+|\s+$", "")


def number(column: Column) -> Column:
    """A double, or null where the value is none."""
    return column.try_cast("double")


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null are the same missing value everywhere behind a scan."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.select(*[F.when(~F.isnan(qcol(c)), qcol(c)).alias(c) if c in floating else qcol(c) for c in df.columns])


def with_row_id(df: DataFrame) -> DataFrame:
    """Number the rows in scan order. Ids ascend with file and position but have gaps."""
    if ROW_ID in df.columns:
        return df
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (ROW_ID, IS_SUMMARY)]


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def all_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out
