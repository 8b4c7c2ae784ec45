"""Grouped and global aggregation, shares and ratios, and the aggregates of reports."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.columns import all_of, is_date, is_number, is_text, number, qcol, visible
from gristmill.operators.filters import COMPARE
from gristmill.operators.quantiles import exact_quantiles
from gristmill.session import stored

#: Rows up to which exact quartiles come from one aggregation buffer a column.
ONE_PASS_ROWS = 5_000_000

FUNCTIONS = ("sum", "mean", "median", "min", "max", "count", "nunique")


@dataclass
class Measure:
    """One aggregation; ``coerce`` reads a text column as numbers first."""

    fn: str
    column: str | None
    alias: str
    coerce: bool = False

    def expression(self) -> Column:
        if self.fn == "count" and self.column is None:
            return F.count(F.lit(1)).alias(self.alias)
        if self.column is None:
            raise ValueError(f"{self.fn} needs a column")
        c = number(qcol(self.column)) if self.coerce else qcol(self.column)
        if self.fn == "sum":  # of nothing is 0
            out = F.coalesce(F.sum(c), F.lit(0.0))
        elif self.fn == "mean":
            out = F.avg(c)
        elif self.fn == "median":  # exact, interpolated
            out = F.median(c)
        elif self.fn in ("min", "max", "count"):
            out = getattr(F, self.fn)(c)
        elif self.fn == "nunique":
            out = F.count_distinct(c)
        else:
            raise ValueError(f"unknown aggregation {self.fn!r}")
        return out.alias(self.alias)


def aggregate(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """Group by ``keys`` (none: one row for the whole table); null is a group of its own.

    Medians are exact and come apart from the rest, for a built-in one keeps all distinct
    values of a group in one buffer.
    """
    medians = [m for m in measures if m.fn == "median" and m.column is not None]
    expressions = [m.expression() for m in measures if m not in medians]
    if not keys:
        for m in medians:
            column = (number(qcol(m.column)) if m.coerce else qcol(m.column)).cast("double")
            value = exact_quantiles(df.select(column.alias("v")), ["v"], [0.5])["v"][0]
            expressions.append(F.lit(value).cast("double").alias(m.alias))
        out = df.agg(*expressions, F.count(F.lit(1)).alias("__n")).drop("__n")
        return out.select(*[qcol(m.alias) for m in measures])
    named = [f"__k{i}" for i in range(len(keys))]
    if not medians:
        return df.groupBy(*[qcol(k) for k in keys]).agg(*expressions)
    out = df.groupBy(*[qcol(k).alias(n) for k, n in zip(keys, named)]).agg(*expressions, F.count(F.lit(1)).alias("__n"))
    for i, m in enumerate(medians):
        found = group_medians(df, keys, m, named)
        same = [out[n].eqNullSafe(found[n]) for n in named]
        out = out.join(found, all_of(same), "left").drop(*[found[n] for n in named])
    return out.select(*[qcol(n).alias(k) for k, n in zip(keys, named)], *[qcol(m.alias) for m in measures])


#: Distinct values of a group that are ranked in one sorted stream, and cells that a longer range is cut into.
FEW, CELLS = 50_000, 1024
HUGE = sys.float_info.max


def group_medians(df: DataFrame, keys: Sequence[str], measure: Measure, named: Sequence[str], few: int = FEW) -> DataFrame:
    """The exact median of each group with a value, interpolated; its keys are called ``named``.

    Values are counted. As long as a group has more than ``few`` of them, its range is cut
    into CELLS cells, the cells are counted, which every task does for its own rows, and the
    one that holds the rank is kept. So no group is sorted in one task beyond ``few`` values.
    """
    column = (number(qcol(measure.column)) if measure.coerce else qcol(measure.column)).cast("double")
    values = df.select(*[qcol(k).alias(n) for k, n in zip(keys, named)], column.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    counted = stored(values.groupBy(*named, "__v").agg(F.count(F.lit(1)).alias("__c")))
    # a search for each of the two middle ranks: of what lies from lo to hi, the value with so many before it
    sizes = counted.groupBy(*named).agg(F.sum("__c").alias("__all"), F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    ranks = F.array_distinct(F.array(F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)))
    open_ = stored(sizes.withColumn("__rank", F.explode(ranks)).withColumns({"__before": F.lit(0).cast("long")}).drop("__all"))
    done: list[DataFrame] = []
    while True:
        wide = (F.col("__n") > few) & (F.col("__lo") < F.col("__hi"))
        done.append(_middle(_inside(counted, open_.where(~wide), named), named))
        open_ = open_.where(wide)
        if open_.isEmpty():
            break
        rows = _inside(counted, open_, named)
        # halves keep the width of the range of doubles finite; a cell is never the whole range, for lo and hi lie apart
        half = lambda c: F.least(F.greatest(F.col(c), F.lit(-HUGE)), F.lit(HUGE)) / 2
        cell = F.least(F.floor(F.coalesce(F.try_divide(half("__v") - half("__lo"), half("__hi") - half("__lo")), F.lit(0.0)) * CELLS), F.lit(CELLS - 1))
        cells = rows.groupBy(*named, "__rank", "__before", cell.alias("__cell")).agg(F.sum("__c").alias("__c"), F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*named, "__rank").orderBy("__cell"))
        held = cells.withColumn("__upto", upto).where((F.col("__upto") > F.col("__rank")) & (F.col("__upto") - F.col("__c") <= F.col("__rank")))
        open_ = stored(held.select(*named, "__n", "__lo", "__hi", "__rank", (F.col("__upto") - F.col("__c")).alias("__before")))
    return reduce(DataFrame.unionByName, done).groupBy(*named).agg(F.avg("__value").alias(measure.alias))


def _inside(counted: DataFrame, searches: DataFrame, named: Sequence[str]) -> DataFrame:
    """The values from ``lo`` to ``hi`` of each search."""
    mine = searches.withColumnsRenamed({n: f"{n}_" for n in named})
    same = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in named]
    return counted.join(mine.drop("__n"), all_of([*same, F.col("__v").between(F.col("__lo"), F.col("__hi"))])).drop(*[f"{n}_" for n in named])


def _middle(rows: DataFrame, named: Sequence[str]) -> DataFrame:
    """The value of each search's rank, from its values in order."""
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*named, "__rank").orderBy("__v"))
    ranked = rows.withColumn("__upto", upto)
    at = (F.col("__upto") > F.col("__rank")) & (F.col("__upto") - F.col("__c") <= F.col("__rank"))
    return ranked.where(at).select(*named, F.col("__v").alias("__value"))


def having(df: DataFrame, conditions: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Keep groups by (name, op, value); a group without the value goes, but for ``ne``."""
    for name, op, value in conditions:
        c = qcol(name)
        df = df.where(~c.eqNullSafe(F.lit(value)) if op == "ne" else F.coalesce(COMPARE[op](c, F.lit(value)), F.lit(False)))
    return df


def pct_of_total(df: DataFrame, column: str, alias: str) -> DataFrame:
    """Percentage of the column's sum over the rows of ``df``, two places, half to even.

    The total is a scalar subquery, so the groups are never gathered in one task.
    """
    total = df.select(qcol(column).alias("v")).agg(F.sum("v")).scalar()
    return df.withColumn(alias, F.bround(F.try_divide(F.lit(100.0) * qcol(column), total), 2))


def ratio(df: DataFrame, over: str, under: str, alias: str) -> DataFrame:
    """Quotient to four places; null over zero."""
    return df.withColumn(alias, F.bround(F.try_divide(qcol(over), qcol(under)), 4))


def report_sum_count(df: DataFrame, category: str, amount: str) -> DataFrame:
    """Sum and number of amounts per category, largest first; rows without a category are left out."""
    c = qcol(amount)
    out = df.where(qcol(category).isNotNull()).groupBy(qcol(category)).agg(F.coalesce(F.sum(c), F.lit(0.0)).alias("total"), F.count(c).alias("rows"))
    return out.orderBy(F.desc_nulls_last("total"), qcol(category))


def chart_topk(df: DataFrame, category: str, amount: str, k: int = 8) -> DataFrame:
    """The k categories of the largest sums."""
    out = df.where(qcol(category).isNotNull()).groupBy(qcol(category).alias("label")).agg(F.coalesce(F.sum(qcol(amount)), F.lit(0.0)).alias("value"))
    return out.orderBy(F.desc("value"), "label").limit(k)


def chart_groups(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    keys = [qcol(x)] + ([qcol(hue)] if hue else [])
    return df.groupBy(*keys).agg(F.coalesce(F.sum(qcol(y)), F.lit(0.0)).alias(y))


def topn_other(df: DataFrame, label: str, value: str, n: int, other: str = "Other") -> DataFrame:
    """Sums of the n largest labels, and of all the others together.

    The largest come from a sum per label, so rows are shuffled once, already summed.
    """
    sums = df.groupBy(qcol(label).alias("label")).agg(F.coalesce(F.sum(qcol(value)), F.lit(0.0)).alias("value"))
    top = sums.orderBy(F.desc("value"), "label").limit(n)
    rest = sums.agg(F.sum("value").alias("all"), F.count(F.lit(1)).alias("labels"))
    shown = top.agg(F.sum("value").alias("top"))
    tail = rest.where(F.col("labels") > n).select(F.lit(other).alias("label"), (F.col("all") - shown.scalar()).alias("value"))
    return top.unionByName(tail)


def pivot_sum(df: DataFrame, x: str, hue: str, y: str, values: Sequence[str] | None = None) -> DataFrame:
    """Sums with a column per value of ``hue``, 0 where there is none.

    Give ``values`` where they are known; else a pass collects them, up to Spark's
    limit on pivot columns.
    """
    wide = df.groupBy(qcol(x)).pivot(hue, list(values) if values is not None else None).agg(F.sum(qcol(y)))
    return wide.na.fill(0.0, subset=[c for c in wide.columns if c != x])


def describe_numeric(df: DataFrame, one_pass_rows: int = ONE_PASS_ROWS) -> DataFrame:
    """count, mean, std, min, quartiles and max of every numeric column, two places, exact quartiles.

    One pass over the table for all columns together. Beyond ``one_pass_rows`` rows the
    quartiles are searched for in passes of bounded memory (``quantiles``), just as exact.
    """
    names = [f.name for f in df.schema if is_number(f.dataType) and f.name in visible(df)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, count long, mean double, std double, min double, q25 double, median double, q75 double, max double")
    shares = [0.25, 0.5, 0.75]
    large = df.count() > one_pass_rows  # from file statistics, where the table is as stored
    known = exact_quantiles(df, names, shares) if large else {}
    parts = []
    for i, name in enumerate(names):
        c = qcol(name).cast("double")
        quartiles = F.array(*[F.lit(v).cast("double") for v in known[name]]) if large else F.percentile(c, shares)
        stats = {"n": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "lo": F.min(c), "hi": F.max(c), "q": quartiles}
        parts += [e.alias(f"{k}{i}") for k, e in stats.items()]
    two = lambda c: F.bround(c, 2)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"), F.col(f"n{i}").alias("count"), two(F.col(f"mean{i}")).alias("mean"), two(F.col(f"std{i}")).alias("std"), two(F.col(f"lo{i}")).alias("min"),
                *[two(F.get(F.col(f"q{i}"), F.lit(k))).alias(q) for k, q in enumerate(("q25", "median", "q75"))], two(F.col(f"hi{i}")).alias("max"),
            )
            for i, name in enumerate(names)
        ]
    )
    return df.agg(*parts).select(F.explode(rows).alias("d")).select("d.*")


def sum_by_type(df: DataFrame, group: str, value: str, company: str | None = None, company_column: str = "COMPANY_CODE") -> DataFrame:
    """Sum per type, of one company's rows if a company is named; rows without a type are left out."""
    if company is not None and company_column in df.columns:
        df = df.where(qcol(company_column) == company)
    return df.where(qcol(group).isNotNull()).groupBy(qcol(group)).agg(F.coalesce(F.sum(qcol(value)), F.lit(0.0)).alias(value))


def convert_currency(df: DataFrame, amount: str, currency: str, rates: dict[str, float], alias: str) -> DataFrame:
    """Amounts times the rate of their currency (upper-cased); 1 for a currency without a rate."""
    table = F.create_map(*[F.lit(x) for code, rate in sorted(rates.items()) for x in (code.upper(), float(rate))]) if rates else None
    rate = F.coalesce(F.element_at(table, F.upper(stripped_upper(currency))), F.lit(1.0)) if rates else F.lit(1.0)
    return df.withColumn(alias, qcol(amount) * rate)


def stripped_upper(name: str) -> Column:
    return F.upper(F.trim(qcol(name).cast("string")))


def funds_by_type(tables: dict[str, DataFrame], company: str, day: str, rates: dict[str, float], company_column: str, group: str, amount: str, currency: str, start: str, end: str) -> DataFrame:
    """Funds of a company valid on a day, converted and summed per type, over all tables that have the columns."""

    from gristmill.operators.filters import filter_as_at

    parts = []
    for name, df in sorted(tables.items()):
        if not {company_column, group, amount} <= set(df.columns):
            continue
        rows = filter_as_at(df.where(qcol(company_column) == company), day, start, end)
        rows = convert_currency(rows, amount, currency, rates, amount) if currency in df.columns else rows
        parts.append(sum_by_type(rows, group, amount).withColumn("TABLE", F.lit(name)))
    if not parts:
        raise ValueError("no table has the columns asked for")
    return reduce(DataFrame.unionByName, parts)


def headline_amount(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The table whose amount column has the largest absolute total."""

    parts = [df.agg(F.coalesce(F.sum(qcol(c)), F.lit(0.0)).alias("total")).select(F.lit(name).alias("table"), F.lit(c).alias("column"), "total") for name, (df, c) in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc(F.abs("total")), "table").limit(1)


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of every table."""

    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows", F.lit(len(visible(df))).alias("columns")) for n, df in sorted(tables.items())])


def pages_of(chunks: DataFrame) -> DataFrame:
    """Pages per document of a chunk table."""
    return chunks.groupBy("source").agg(F.count_distinct("location").alias("pages"), F.count(F.lit(1)).alias("chunks"))


def collapse_duplicates(df: DataFrame, count: str = "count", least: int = 20, share: float = 0.6) -> DataFrame | None:
    """Distinct rows with their number, most frequent first, if a listing of over ``least``
    rows has at most ``share`` of them distinct; else None."""
    names = visible(df)
    grouped = df.groupBy(*[qcol(c) for c in names]).agg(F.count(F.lit(1)).alias(count))
    rows, distinct = grouped.agg(F.sum(count), F.count(F.lit(1))).first()
    if not rows or rows <= least or distinct > share * rows:
        return None
    return grouped.orderBy(F.desc(count), *[qcol(c).asc_nulls_last() for c in names])


def constant_columns(df: DataFrame) -> DataFrame:
    """(column, value) of every column with one value only, nulls counted as a value."""
    names = visible(df)
    parts = []
    for i, c in enumerate(names):
        parts += [F.count_distinct(qcol(c)).alias(f"d{i}"), F.max(qcol(c).isNull()).alias(f"n{i}"), F.max(qcol(c).cast("string")).alias(f"v{i}")]
    one = df.agg(*parts)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(f"d{i}") + F.col(f"n{i}").cast("int")).alias("distinct"), F.col(f"v{i}").alias("value")) for i, c in enumerate(names)])
    return one.select(F.explode(rows).alias("c")).where("c.distinct <= 1").select("c.column", "c.value")


def value_counts_topk(df: DataFrame, column: str, k: int = 12) -> DataFrame:
    """The k most frequent values, ties to the smaller."""
    out = df.where(qcol(column).isNotNull()).groupBy(qcol(column).cast("string").alias("value")).count()
    return out.orderBy(F.desc("count"), "value").limit(k)


def best_amount_column(df: DataFrame, hints: Sequence[str] = ("amount", "outstanding", "total", "balance", "value")) -> str | None:
    """The numeric column named by a hint, else that of the largest absolute sum."""
    names = [f.name for f in df.schema if is_number(f.dataType) and f.name in visible(df)]
    for hint in hints:
        for name in names:
            if hint in name.lower():
                return name
    if not names:
        return None
    sums = df.agg(*[F.abs(F.sum(qcol(c).cast("double"))).alias(str(i)) for i, c in enumerate(names)]).first()
    return names[max(range(len(names)), key=lambda i: sums[i] or 0.0)]


def category_columns(df: DataFrame, most: int = 60, hints: Sequence[str] = ("company", "country", "bank", "currency", "type")) -> list[str]:
    """Text columns of 2 to ``most`` values, hinted ones first."""
    names = [f.name for f in df.schema if is_text(f.dataType) and f.name in visible(df)]
    if not names:
        return []
    counts = df.agg(*[F.count_distinct(qcol(c)).alias(str(i)) for i, c in enumerate(names)]).first()
    fit = [c for i, c in enumerate(names) if 2 <= counts[i] <= most]
    return sorted(fit, key=lambda c: not any(h in c.lower() for h in hints))


def chart_spec(df: DataFrame) -> dict | None:
    """Kind and columns of a default chart.

    x is a time column, else the category closest to twelve values; y the measure of
    the largest absolute sum; few slices make a pie, many bars lie down.
    """
    dates = [f.name for f in df.schema if is_date(f.dataType)]
    numbers = [f.name for f in df.schema if is_number(f.dataType) and f.name in visible(df) and not f.name.lower().endswith(("id", "key", "code", "year"))]
    texts = [f.name for f in df.schema if is_text(f.dataType) and f.name in visible(df)]
    if not numbers or not (dates or texts):
        return None
    stats = chart_spec_stats(df, texts, numbers).first()
    y = max(numbers, key=lambda c: stats[f"abs_{c}"] or 0.0)
    if dates:
        return {"kind": "line", "x": dates[0], "y": y}
    x = min(texts, key=lambda c: abs(stats[f"distinct_{c}"] - 12))
    n = stats[f"distinct_{x}"]
    return {"kind": "pie" if 3 <= n <= 4 else "barh" if n > 12 else "bar", "x": x, "y": y}


def chart_spec_stats(df: DataFrame, texts: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Distinct values of the categories and absolute sums of the measures, in one pass."""
    return df.agg(*[F.count_distinct(qcol(c)).alias(f"distinct_{c}") for c in texts], *[F.sum(F.abs(qcol(c).cast("double"))).alias(f"abs_{c}") for c in numbers])
