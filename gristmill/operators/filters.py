"""Predicates with the engine's null rules.

Inequality keeps rows without a value; every other comparison drops them. Text is
compared without surrounding white space, numbers as doubles, dates as timestamps;
what cannot be read as the kind asked for counts as missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from functools import reduce
from operator import eq, ge, gt, le, lt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.columns import any_of, is_text, number, qcol, stripped

COMPARE = {"eq": eq, "gt": gt, "ge": ge, "lt": lt, "le": le}


# Conditions are null where a value is missing, which a filter drops; a ``coalesce`` to
# false would say the same but keep them from the scan.


def text_in(column: Column, values: Sequence[str], exact: bool = False) -> Column:
    """``exact``: the values are stored spellings, so that the scan can look for them."""
    return column.isin(*values) if exact else stripped(column).isin(*[v.strip() for v in values])


def text_not_in(column: Column, values: Sequence[str], exact: bool = False) -> Column:
    return ~F.coalesce(text_in(column, values, exact), F.lit(False))


def contains(column: Column, needle: str) -> Column:
    """Case-insensitive and literal."""
    return F.contains(F.lower(column.cast("string")), F.lower(F.lit(needle)))


def _literal(value: float) -> Column:
    """A whole number as such, so that a comparison with a whole-number column needs no cast of it."""
    value = float(value)
    return F.lit(int(value)) if value.is_integer() and abs(value) < 2**53 else F.lit(value)


def compare_number(column: Column, op: str, value: float, text: bool = True) -> Column:
    """``text``: the column may hold text, of which what is no number counts as missing."""
    v = number(column) if text else column
    return ~v.eqNullSafe(_literal(value)) if op == "ne" else COMPARE[op](v, _literal(value))


def number_in(column: Column, values: Sequence[float], text: bool = True) -> Column:
    return (number(column) if text else column).isin(*[_literal(v) for v in values])


def number_between(column: Column, low: float, high: float, text: bool = True) -> Column:
    return (number(column) if text else column).between(_literal(low), _literal(high))


def moment(value: date | datetime | str) -> Column:
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    return F.lit(datetime(*value.timetuple()[:6])).cast("timestamp_ntz")


def as_moment(column: Column, text: bool = False) -> Column:
    return F.try_to_timestamp(column).cast("timestamp_ntz") if text else column


def in_year(column: Column, year: int, text: bool = False) -> Column:
    """A half-open range rather than ``year(column)``, so that a scan can skip by it."""
    at = as_moment(column, text)
    return (at >= moment(date(year, 1, 1))) & (at < moment(date(year + 1, 1, 1)))


def compare_date(column: Column, op: str, value: date | datetime | str, or_null: bool = False, text: bool = False) -> Column:
    at = as_moment(column, text)
    if op == "ne":
        return ~at.eqNullSafe(moment(value))
    found = COMPARE[op](at, moment(value))
    return found | at.isNull() if or_null else found


def date_between(column: Column, low: date | datetime | str, high: date | datetime | str, text: bool = False) -> Column:
    return as_moment(column, text).between(moment(low), moment(high))


def as_at(start: Column, end: Column, day: date | datetime | str) -> Column:
    """Valid on a day: begun by then, and not ended before it (no end means still valid)."""
    return (start <= moment(day)) & ((end >= moment(day)) | end.isNull())


def filter_as_at(df: DataFrame, day: date | datetime | str, start: str = "Start_date", end: str = "End_date") -> DataFrame:
    """Rows valid on ``day``; unchanged if either column is missing."""
    if start not in df.columns or end not in df.columns:
        return df
    return df.where(as_at(qcol(start), qcol(end), day))


def any_cell_contains(df: DataFrame, needle: str) -> DataFrame:
    """Rows of which any cell, shown as text, has the needle in any case."""
    if not needle.strip():
        return df
    joined = F.concat_ws("\u0001", *[qcol(c).cast("string") for c in df.columns])
    return df.where(F.contains(F.lower(joined), F.lower(F.lit(needle.strip()))))


@dataclass
class BoundFilter:
    """A filter after binding: its kind says how ``values`` are compared with ``column``."""

    kind: str
    column: str
    values: list = field(default_factory=list)
    op: str = "eq"
    or_null: bool = False
    text: bool = False  # a date or number held as text
    exact: bool = False  # text values are stored spellings

    def on(self, df: DataFrame) -> DataFrame:
        """Rows of a table as it was read, in which a missing number may be a NaN, that pass. The
        column is compared bare, so that the scan can skip by it."""
        kind = next(f.dataType for f in df.schema if f.name == self.column)
        if not isinstance(kind, (T.DoubleType, T.FloatType)):
            return df.where(self.condition())
        nan = F.isnan(qcol(self.column))
        if self.kind == "isnull" or self.or_null:
            return df.where(self.condition() | nan)
        # a NaN is greater than every number and equal to none
        return df.where(self.condition()).where(~nan) if self.kind == "notnull" or self.op in ("gt", "ge") else df.where(self.condition())

    def condition(self) -> Column:
        c, v = qcol(self.column), self.values
        if self.kind == "text_in":
            return text_in(c, v, self.exact)
        if self.kind == "text_not_in":
            return text_not_in(c, v, self.exact)
        if self.kind == "contains":
            return contains(c, v[0])
        if self.kind == "number":
            return compare_number(c, self.op, v[0], self.text)
        if self.kind == "number_in":
            return number_in(c, v, self.text)
        if self.kind == "number_between":
            return number_between(c, v[0], v[1], self.text)
        if self.kind == "year":
            return in_year(c, int(v[0]), self.text)
        if self.kind == "date":
            return compare_date(c, self.op, v[0], self.or_null, self.text)
        if self.kind == "date_between":
            return date_between(c, v[0], v[1], self.text)
        if self.kind == "isnull":
            return c.isNull()
        if self.kind == "notnull":
            return c.isNotNull()
        raise ValueError(f"unknown filter kind {self.kind!r}")


def apply(df: DataFrame, filters: Sequence[BoundFilter]) -> DataFrame:
    """All of the filters; the only disjunction is a date filter's ``or_null``."""
    return reduce(lambda d, f: d.where(f.condition()), filters, df)


# Words that mark a row as a total, in English and Greek.
SUMMARY_WORDS = ("total", "subtotal", "grand total", "sum", "totals", "συνολο", "μερικο συνολο", "γενικο συνολο", "αθροισμα", "συνολα")
SUMMARY_COLUMNS, SUMMARY_LENGTH = 8, 40


def summary_label(column: Column) -> Column:
    """Whether a cell is a total's label: a summary word, alone or first or last in a short text.

    Case, Greek accents and the amount of white space do not matter. One pattern looks
    for all words, and long cells are passed over before it.
    """
    words = "|".join(w.replace(" ", r"\s+") for w in sorted(SUMMARY_WORDS, key=len, reverse=True))
    text = F.translate(F.lower(column.cast("string")), "άέήίόύώϊϋΐΰς", "αεηιουωιυιυσ")
    found = text.rlike(rf"(?s)^\s*(?:{words})(?:\s.*)?$|^.*\s(?:{words})\s*$")
    short = F.length(F.regexp_replace(stripped(column), r"\s+", " ")) <= SUMMARY_LENGTH
    return F.coalesce((F.length(column.cast("string")) <= 4 * SUMMARY_LENGTH) & found & short, F.lit(False))


def is_summary_row(df: DataFrame) -> Column:
    """A row with a total's label in any of its first text columns."""
    names = [f.name for f in df.schema if is_text(f.dataType)][:SUMMARY_COLUMNS]
    return any_of(summary_label(qcol(n)) for n in names)


def exclude_totals(df: DataFrame) -> DataFrame:
    return df.where(~is_summary_row(df))
