"""Numbers written as text: locales, reading, showing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.columns import qcol, stripped

# Shapes of European and of accounting numbers, of what only one of the
# two ever writes, and of what both might.
EU_SHAPE = r"^-?\d{1,3}(\.\d{3})+(,\d+)?$|^-?\d+,\d+$"
US_SHAPE = r"^-?\(?\$?\s?\d{1,3}(,\d{3})*(\.\d+)?\)?$|^-?\d+(\.\d+)?$"
US_STRONG = r"^-?\(?\$?\s?\d{1,3}(,\d{3}){2,}(\.\d+)?\)?$|^-?\(?\$?\s?\d{1,3}(,\d{3})+\.\d+\)?$|^-?\d+\.\d+$"
EU_STRONG = r"^-?\d{1,3}(\.\d{3})+(,\d+)?$|^-?\d+,\d{1,2}$"
LONE_COMMA, LONE_DOT = r"^-?\d{1,3},\d{3}$", r"^-?\d{1,3}\.\d{3}$"
MATCH, KEEP, LEAST = 0.8, 0.95, 2


def eu_number(column: Column) -> Column:
    """``1.234,56`` as a double; null where that leaves no number."""
    return F.translate(F.replace(stripped(column), F.lit("."), F.lit("")), ",", ".").try_cast("double")


def us_number(column: Column) -> Column:
    """``(1,234.50)`` and ``$1,234.50`` as a signed double; null where that leaves no number."""
    text = F.translate(stripped(column), "$ ", "")
    digits = F.translate(text, "(),", "").try_cast("double")
    return F.when(F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")")), -digits).otherwise(digits)


def locale_votes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, us, eu, lone_comma, lone_dot, locale): one pass over all columns.

    What only one locale writes decides; signs of both leave it open. Without any, lone
    comma groups are US thousands unless there are lone dot groups, which may be codes.
    """
    parts = []
    for i, c in enumerate(columns):
        text = stripped(qcol(c))
        dot = text.rlike(LONE_DOT)
        us = ~dot & text.rlike(US_STRONG)
        eu = ~dot & ~text.rlike(US_STRONG) & text.rlike(EU_STRONG)
        comma = ~text.rlike(US_STRONG) & ~text.rlike(EU_STRONG) & text.rlike(LONE_COMMA)
        parts += [F.count_if(x).alias(f"{i}_{k}") for k, x in (("us", us), ("eu", eu), ("lone_comma", comma), ("lone_dot", dot))]
    names = ("us", "eu", "lone_comma", "lone_dot")
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{k}").alias(k) for k in names]) for i, c in enumerate(columns)])
    some = {k: F.col(k) > 0 for k in names}
    locale = F.when(some["us"] & some["eu"], None).when(some["us"], "US").when(some["eu"], "EU").when(some["lone_comma"] & ~some["lone_dot"], "US")
    return df.agg(*parts).select(F.explode(rows).alias("v")).select("v.*").withColumn("locale", locale)


def read_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns that are numbers of one locale become doubles; others stay.

    At least LEAST values, MATCH of them in the locale's shape and KEEP of those readable.
    One aggregate decides for all columns.
    """
    if not columns:
        return df
    kinds = {"EU": (eu_number, EU_SHAPE, ","), "US": (us_number, US_SHAPE, ".,")}
    parts = []
    for i, c in enumerate(columns):
        text = stripped(qcol(c))
        some = text.isNotNull() & (text != "")
        parts.append(F.count_if(some).alias(f"n{i}"))
        for kind, (read, shape, signs) in kinds.items():
            parts += [F.count_if(text.rlike(shape)).alias(f"{kind}_fit{i}"), F.count_if(some & read(qcol(c)).isNotNull()).alias(f"{kind}_kept{i}"), F.count_if(text.rlike(f"[{signs}]")).alias(f"{kind}_sign{i}")]
    stats = df.agg(*parts).first()
    locale = {r["column"]: r["locale"] for r in locale_votes(df, columns).collect()}
    chosen: dict[str, Column] = {}
    for i, c in enumerate(columns):
        n, kind = stats[f"n{i}"], locale[c]
        if kind and n >= LEAST and stats[f"{kind}_fit{i}"] >= MATCH * n and stats[f"{kind}_kept{i}"] >= KEEP * n and stats[f"{kind}_sign{i}"]:
            chosen[c] = kinds[kind][0](qcol(c))
    return df.select(*[chosen.get(c, qcol(c)).alias(c) for c in df.columns])


def fmt_number(column: Column, style: str = "US", places: int = 2) -> Column:
    """A number for display: grouped, EU style with the marks exchanged; whole numbers bare,
    years from 1900 to 2100 ungrouped."""
    whole = column == F.round(column)
    year = whole & column.between(1900, 2100)
    us = F.when(whole, F.format_number(column, 0)).otherwise(F.format_number(column, places))
    shown = us if style == "US" else F.translate(us, ",.", ".,") if style == "EU" else F.translate(us, ",", "")
    return F.when(year, F.format_string("%.0f", column.cast("double"))).otherwise(shown)


def canon_number(column: Column, style: str = "US") -> Column:
    """The number that a displayed text stands for; null if none."""
    bare = F.translate(column, ", ", "") if style != "EU" else F.translate(F.translate(column, ". ", ""), ",", ".")
    return bare.try_cast("double")


def rate_percent(df: DataFrame, column: str, alias: str) -> DataFrame:
    """A rate shown as a percentage with three places; fractions, where no rate exceeds 1, times 100."""
    most = df.agg(F.max(F.abs(qcol(column))).alias("m")).scalar()
    return df.withColumn(alias, F.format_string("%.3f%%", qcol(column).cast("double") * F.when(most <= 1, 100.0).otherwise(1.0)))


def human_number(column: Column) -> Column:
    """1.2K, 3.4M, 5.6B; smaller numbers with no place."""
    size = F.abs(column)
    show = lambda by, mark: F.concat(F.format_string("%.1f", column / by), F.lit(mark))
    return F.when(size >= 1e9, show(1e9, "B")).when(size >= 1e6, show(1e6, "M")).when(size >= 1e3, show(1e3, "K")).otherwise(F.format_string("%.0f", column.cast("double")))


def clip_negative(column: Column) -> Column:
    return F.greatest(column, F.lit(0.0))


_NUMBER = re.compile(r"(?<![\w.,])-?\d{1,3}(?:,\d{3})+(?:\.\d+)?(?![\w])|(?<![\w.,])-?\d+(?:\.\d+)?(?![\w])")


def numbers_in(text: str) -> list[float]:
    return [float(m.replace(",", "")) for m in _NUMBER.findall(text)]


def echoes(answer: str, source: str) -> bool:
    """Whether every number of an answer is one of the source's, to a millionth or at two places."""
    have = numbers_in(source)
    return all(any(abs(a - b) <= 1e-6 * max(abs(a), abs(b), 1e-12) or round(a, 2) == round(b, 2) for b in have) for a in numbers_in(answer))


# Fixed value: a free-standing number of four whole digits or more, apart from dates, codes and grouped numbers.
_BARE = re.compile(r"(?<![\w.,])(-?\d{4,}(?:\.\d+)?)(?![\d,])(?!\.\d)(?!\w)")


def reformat(text: str, style: str = "US") -> str:
    """Bare numbers of a text regrouped for display. Rates, codes, dates and years stay as they are,
    and everything does in the plain style."""
    if style == "plain":
        return text

    def show(m: re.Match) -> str:
        value = float(m[0])
        if value == int(value):
            shown = m[0] if "." not in m[0] and 1900 <= value <= 2100 else str(int(value)) if 1900 <= value <= 2100 else f"{int(value):,}"
        else:
            shown = f"{value:,.2f}"
        return shown.translate(str.maketrans(",.", ".,")) if style == "EU" else shown

    return _BARE.sub(show, text)
