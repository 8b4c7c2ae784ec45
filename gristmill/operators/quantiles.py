"""Exact quantiles without gathering a column's values in one task.

A built-in exact percentile keeps every distinct value of its group in one buffer. Here the
range around each wanted rank is cut into cells, which every task counts for its own rows, and
the one that holds the rank is cut again, until it has one value or few enough to sort. All
columns and ranks go together: a pass is one grouping by cell.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.columns import qcol

#: Values of a range that are sorted in one place, and cells that a longer range is cut into.
FEW, CELLS = 50_000, 1024
HUGE = sys.float_info.max


@dataclass(frozen=True)
class _Range:
    """The values of a column from ``low`` to ``high``, ``inside`` in number; ``below`` are less than ``low``."""

    column: int
    low: float
    high: float
    below: int
    inside: int


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], few: int = FEW) -> dict[str, list[float | None]]:
    """Interpolated quantiles of numeric columns; None for a column without values.

    Missing values and NaN do not count. A pass brings a bounded number of cells for each
    wanted rank to the driver, whatever the number of rows.
    """
    clean = df.select(*[F.when(~F.isnan(qcol(c).cast("double")), qcol(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    parts = [f(F.col(f"c{i}")).alias(f"{k}{i}") for i in range(len(columns)) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    first = clean.agg(*parts).first()
    places = {i: [s * (first[f"n{i}"] - 1) for s in shares] for i in range(len(columns)) if first[f"n{i}"]}
    held = {(i, f(x)): _Range(i, first[f"lo{i}"], first[f"hi{i}"], 0, first[f"n{i}"]) for i, xs in places.items() for x in xs for f in (math.floor, math.ceil)}
    values = clean.unpivot([], list(clean.columns), "column", "v").where("v is not null")
    found: dict[tuple[int, int], float] = {}
    while held:
        found |= {s: r.low for s, r in held.items() if r.low == r.high}
        small = {s: r for s, r in held.items() if r.low < r.high and r.inside <= few}
        found |= _sorted(values, small)
        wide = {s: r for s, r in held.items() if r.low < r.high and r.inside > few}
        held = _cut(values, wide)
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    for i, ranks in places.items():
        for k, x in enumerate(ranks):
            a, b = found[i, math.floor(x)], found[i, math.ceil(x)]
            out[columns[i]][k] = a if a == b else a + (b - a) * (x - math.floor(x))
    return out


def _by_range(ranges: Sequence[_Range], value: Sequence[Column]) -> Column:
    """Of each row the value of the range that it lies in; null in none. Ranges of a column are apart."""
    out = None
    for i in sorted({r.column for r in ranges}):
        mine = [(F.col("v").between(r.low, r.high), x) for r, x in zip(ranges, value) if r.column == i]
        inner = reduce(lambda c, w: c.when(*w), mine[1:], F.when(*mine[0]))
        at = F.col("column") == f"c{i}"
        out = F.when(at, inner) if out is None else out.when(at, inner)
    return out


def _sorted(values: DataFrame, searches: dict[tuple[int, int], _Range]) -> dict[tuple[int, int], float]:
    """The values of the ranks of short ranges."""
    if not searches:
        return {}
    ranges = list(dict.fromkeys(searches.values()))
    wanted = [[rank for (_, rank), r in searches.items() if r == one] for one in ranges]
    places = reduce(lambda c, j: c.when(F.col("r") == j, F.array(*[F.lit(rank - ranges[j].below) for rank in wanted[j]])), range(1, len(ranges)), F.when(F.col("r") == 0, F.array(*[F.lit(rank - ranges[0].below) for rank in wanted[0]])))
    lists = values.select(_by_range(ranges, [F.lit(j) for j in range(len(ranges))]).alias("r"), "v").where("r is not null").groupBy("r").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    rows = lists.select("r", F.transform(places, lambda k: F.get("vs", k.cast("int"))).alias("vs")).collect()
    return {(ranges[row["r"]].column, rank): v for row in rows for rank, v in zip(wanted[row["r"]], row["vs"])}


def _cut(values: DataFrame, searches: dict[tuple[int, int], _Range]) -> dict[tuple[int, int], _Range]:
    """For each rank, the range of the values in the cell that holds it. The ends of a range are
    cells of their own, so what is left gets shorter whatever the values are."""
    if not searches:
        return {}
    ranges = list(dict.fromkeys(searches.values()))
    cells = CELLS + 2

    def code(j: int, r: _Range) -> Column:
        # halves keep the width of the range of doubles finite
        low, high = (min(max(x, -HUGE), HUGE) / 2 for x in (r.low, r.high))
        v = F.least(F.greatest(F.col("v"), F.lit(-HUGE)), F.lit(HUGE)) / 2
        inner = F.least(F.floor((v - low) / (high - low) * CELLS), F.lit(CELLS - 1)) if high > low else F.lit(0).cast("long")
        cell = F.when(F.col("v") == r.low, 0).when(F.col("v") == r.high, cells - 1).otherwise(inner + 1)
        return F.lit(j * cells).cast("long") + cell

    coded = values.select(_by_range(ranges, [code(j, r) for j, r in enumerate(ranges)]).alias("code"), "v").where("code is not null")
    counted = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    out: dict[tuple[int, int], _Range] = {}
    before = {j: r.below for j, r in enumerate(ranges)}
    of = [[s for s, r in searches.items() if r == one] for one in ranges]
    for row in sorted(counted, key=lambda x: x["code"]):
        j = row["code"] // cells
        for s in of[j]:
            if before[j] <= s[1] < before[j] + row["n"]:
                out[s] = _Range(s[0], row["lo"], row["hi"], before[j], row["n"])
        before[j] += row["n"]
    return out
