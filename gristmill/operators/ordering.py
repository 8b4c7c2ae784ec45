"""Sorting, limits, distinct listings, unions, unpivoted years."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.columns import ROW_ID, qcol, visible

YEAR = re.compile(r"(?<!\d)((?:19|20)\d{2})(?!\d)")


def order_by(df: DataFrame, by: str | None, descending: bool = True) -> list[Column]:
    """Sort keys: missing values last either way, then the row's place in its source if known."""
    keys = []
    if by is not None:
        keys.append(qcol(by).desc_nulls_last() if descending else qcol(by).asc_nulls_last())
    if ROW_ID in df.columns:
        keys.append(F.col(ROW_ID).asc())
    return keys


def sort_rows(df: DataFrame, by: str, descending: bool = True) -> DataFrame:
    return df.orderBy(*order_by(df, by, descending))


def head(df: DataFrame, n: int) -> DataFrame:
    """The first n rows in source order."""
    keys = order_by(df, None)
    return (df.orderBy(*keys) if keys else df).limit(n)


def top_rows(df: DataFrame, by: str, n: int, descending: bool = True) -> DataFrame:
    """Planned as a top-k: no full sort, n rows a task."""
    return sort_rows(df, by, descending).limit(n)


def distinct_listing(df: DataFrame, select: Sequence[str], by: str | None = None, descending: bool = True) -> DataFrame:
    """Distinct rows of ``select``, in the order of each one's first appearance after the sort.

    ``by`` may be a column that is not selected. A row's rank is the least sort key among
    its repeats, so one aggregation does it: no sort before the distinct.
    """
    columns = [qcol(c) for c in select]
    place = F.col(ROW_ID) if ROW_ID in df.columns else F.lit(0)
    if by is None:
        return df.groupBy(*columns).agg(F.min(place).alias("__place")).orderBy("__place").select(*columns)
    rank = F.struct(qcol(by).isNull().alias("none"), qcol(by).alias("key"), (-place if descending else place).alias("place"))
    if descending:  # of the largest keys the earliest row; nulls count as the smallest
        rank = F.struct(qcol(by).isNotNull().alias("some"), qcol(by).alias("key"), (-place).alias("place"))
        found = df.groupBy(*columns).agg(F.max(rank).alias("__rank"))
        return found.orderBy(F.desc("__rank"), *[c.asc_nulls_last() for c in columns]).select(*columns)
    return df.groupBy(*columns).agg(F.min(rank).alias("__rank")).orderBy(F.asc("__rank"), *[c.asc_nulls_last() for c in columns]).select(*columns)


def plain_name(name: str) -> str:
    return re.sub(r"[\W_]+", "", name).casefold()


def aligned(tables: Sequence[DataFrame]) -> list[str]:
    """Columns of the first table that all others have, names compared without case and marks."""
    others = [{plain_name(c) for c in visible(t)} for t in tables[1:]]
    return [c for c in visible(tables[0]) if all(plain_name(c) in o for o in others)]


def union_tagged(tables: dict[str, DataFrame], tag: str = "SOURCE") -> DataFrame:
    """All rows of at least two tables one below the other, with the table's name.

    Columns meet by their plain names and keep the first table's spelling; what a
    table lacks is null. The tables must share at least two columns and half of the
    first one's; else ValueError.
    """
    names = list(tables)
    frames = [tables[n] for n in names]
    if len(frames) < 2:
        raise ValueError("a union needs two tables")
    common = aligned(frames)
    if len(common) < max(2, len(visible(frames[0])) // 2):
        raise ValueError("the tables share too few columns")
    spelling = {plain_name(c): c for c in visible(frames[0])}
    label = tag
    while label in spelling.values():
        label += "_FILE"
    parts = []
    for name, df in zip(names, frames):
        parts.append(df.select(*[qcol(c).alias(spelling.get(plain_name(c), c)) for c in visible(df)], F.lit(name).alias(label)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def year_columns(columns: Sequence[str]) -> dict[str, tuple[int, str]]:
    """Columns with a year in their names: column -> (year, what the name says besides)."""
    found = {}
    for c in columns:
        m = YEAR.search(c)
        if m:
            found[c] = (int(m[1]), " ".join((c[: m.start()] + " " + c[m.end() :]).split()).strip(" _-") or "VALUE")
    return found if len({year for year, _ in found.values()}) >= 2 else {}


def unpivot_years(df: DataFrame) -> DataFrame:
    """A table with years in its column names as rows of (other columns, YEAR, MEASURE, VALUE).

    Values are numbers; rows without a value stay. ValueError if fewer than two years.
    """
    wide = year_columns(visible(df))
    if not wide:
        raise ValueError("no columns of at least two years")
    ids = [c for c in visible(df) if c not in wide]
    numbers = df.select(*[qcol(c) for c in ids], *[qcol(c).try_cast("double").alias(c) for c in wide])
    long = numbers.unpivot([qcol(c) for c in ids], [qcol(c) for c in wide], "__column", "VALUE")
    lookup = lambda k: F.create_map(*[F.lit(x) for c, v in wide.items() for x in (c, v[k])])
    return long.select(*[qcol(c) for c in ids], F.element_at(lookup(0), F.col("__column")).alias("YEAR"), F.element_at(lookup(1), F.col("__column")).alias("MEASURE"), "VALUE")
