"""Ruled tables of document pages, given as grids: stitched over pages, checked, merged.

A PDF library is not part of the engine; whatever extracts the grids supplies
``(file, page, table, row, cells)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATTERN_AGREES, NUMBER_NAMES, GLUED = 0.8, 0.3, 0.15


def _numeric(cell: Column) -> Column:
    return F.translate(cell, ",", ".").try_cast("double").isNotNull()


def stitch(grids: DataFrame) -> DataFrame:
    """``grids`` with ``part``, the number of the table that each piece belongs to within its file.

    A page's first table goes on from the page before's last one if it is as wide and
    the two have numbers in the same columns, to PATTERN_AGREES.
    """
    shape = grids.groupBy("file", "page", "table").agg(
        F.max(F.size("cells")).alias("width"),
        F.max_by(F.transform("cells", _numeric), "row").alias("pattern"),
    )
    order = Window.partitionBy("file").orderBy("page", "table")
    agree = F.size(F.filter(F.zip_with("pattern", F.lag("pattern").over(order), lambda a, b: a == b), lambda same: same)) >= PATTERN_AGREES * F.col("width")
    follows = (F.col("width") == F.lag("width").over(order)) & (F.col("page") == F.lag("page").over(order) + 1) & agree
    marked = shape.withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    parts = marked.withColumn("part", F.sum("_new").over(order)).select("file", "page", "table", "part")
    return grids.join(parts, ["file", "page", "table"])


def quality(names: list[str], body: DataFrame) -> bool:
    """Whether an extracted table is sound: few names are numbers, few cells hold several numbers."""
    from gristmill.columns import is_text, qcol
    from gristmill.sources.grids import numberish

    if not names or sum(map(numberish, names)) / len(names) > NUMBER_NAMES:
        return False
    texts = [f.name for f in body.schema if is_text(f.dataType)]
    if not texts:
        return True
    cells = F.filter(F.array(*[F.trim(qcol(c)) for c in texts]), lambda c: c.isNotNull() & (c != ""))
    glued = F.filter(cells, lambda c: c.rlike(r"\d[\d,.]*\s+[\d(]") & (F.length(F.regexp_replace(c, r"\D", "")) >= 6))
    total, bad = body.agg(F.sum(F.size(cells)), F.sum(F.size(glued))).first()
    return not total or bad / total <= GLUED


def merge_same_headers(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables with the same columns become one, under the first one's name."""
    groups: dict[tuple, list[str]] = {}
    for name, df in tables.items():
        groups.setdefault(tuple(df.columns), []).append(name)
    out = {}
    for names in groups.values():
        df = tables[names[0]]
        for other in names[1:]:
            df = df.unionByName(tables[other])
        out[names[0]] = df
    return out
