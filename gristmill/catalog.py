"""The catalogue: named tables with their profiles, roles and relationships.

Only metadata stays on the driver: one profile row per column, the domains of columns
below a stated cardinality, and relationships. Tables stay lazy DataFrames.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import cached_property, reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.columns import IS_SUMMARY, ROW_ID, is_text, nan_to_null, qcol, visible, with_row_id
from gristmill.functions.text import plain
from gristmill.operators import values as V
from gristmill.operators.filters import BoundFilter, apply, is_summary_row
from gristmill.operators.ordering import plain_name, unpivot_years, year_columns
from gristmill.operators.profiling import profile_columns, relationships
from gristmill.session import stored

DIMENSION_VALUES, DIMENSION_RATIO = 200, 0.1
NUMERIC_TEXT, UNIQUE, UNIQUE_LEAST = 0.9, 0.95, 5
# Units read off a column's name, and words for a percentage.
UNITS = ("eur", "usd", "gbp", "chf", "ron", "huf", "pln", "czk", "bgn")
PERCENT = ("percent", "ποσοστο")


@dataclass
class ColumnProfile:
    name: str
    kind: str  # number, date, bool, text, empty
    role: str  # identifier, measure, dimension, date, year, text, empty
    distinct: int = 0
    null_rate: float = 0.0
    unique_ratio: float = 0.0
    numeric_rate: float = 0.0
    least: str | None = None
    most: str | None = None
    unit: str | None = None
    held_as_text: bool = False
    top_values: list[tuple[str, int]] = field(default_factory=list)


@dataclass
class Relationship:
    child_table: str
    child_column: str
    parent_table: str
    parent_column: str
    coverage: float


@dataclass
class Card:
    """What is known about a table besides its data: its day, grain, validity columns, caveats."""

    purpose: str = ""
    as_of: str | None = None
    entity_key: list[str] = field(default_factory=list)
    validity: tuple[str, str] | None = None
    measures: list[str] = field(default_factory=list)
    caveats: list[str] = field(default_factory=list)
    schema: str = ""  # of the columns that the card was made for


def unit_of(name: str) -> str | None:
    """The currency that is a word or the end of a column's name, else a percentage if it is named."""
    text = plain(name)
    for unit in UNITS:
        if unit in text.split() or text.endswith(unit):
            return unit.upper()
    return "%" if "%" in name or any(w in text for w in PERCENT) else None


def role_of(row, kind: str) -> str:
    """The part a column plays, from its profile alone."""
    name = row["column"].lower()
    if row["distinct"] == 0:
        return "empty"
    if kind == "date":
        return "date"
    if kind == "bool":
        return "dimension"
    named_year = any(w in ("year", "yr", "έτος") for w in name.replace("_", " ").split())
    if kind == "number":
        if row["distinct"] <= 150 and (named_year or (row["year_share"] or 0) >= 0.8):
            return "year"
        unique = row["unique_ratio"] >= UNIQUE and row["distinct"] >= UNIQUE_LEAST
        return "identifier" if unique and name.endswith(("id", "key", "code", "no", "number")) else "measure"
    if row["unique_ratio"] >= UNIQUE and row["distinct"] >= UNIQUE_LEAST:
        return "identifier"
    if row["distinct"] <= DIMENSION_VALUES or row["unique_ratio"] <= DIMENSION_RATIO:
        return "dimension"
    return "text"


@dataclass
class Table:
    name: str
    df: DataFrame
    card: Card = field(default_factory=Card)
    long_of: str | None = None
    raw: DataFrame | None = None  # as it was read

    def frame(self, filters: Sequence[BoundFilter] = ()) -> DataFrame:
        """The rows that pass the filters, which come before anything else, so that they reach the scan."""
        if not filters:
            return self.df
        if self.raw is None:
            return apply(self.df, filters)
        rows = self.raw
        for f in filters:
            rows = f.on(rows)
        return prepared(rows)

    @cached_property
    def has_totals(self) -> bool:
        """Whether any row is marked as a total; looked up once, so that plans over tables without leave the mark out."""
        return not self.df.where(F.col(IS_SUMMARY)).select(F.lit(1)).isEmpty()

    @cached_property
    def rows(self) -> int:
        """The number of rows, total rows included; of Parquet files their footers tell it."""
        return (self.df if self.raw is None else self.raw).count()

    @cached_property
    def profile(self) -> dict[str, ColumnProfile]:
        """Profiles by column, computed once by one aggregate over the table, distinct counts sketched."""
        out = {}
        for row in profile_columns(self.df.select(*[qcol(c) for c in self.columns]), exact=False).collect():
            held = row["kind"] == "text" and row["distinct"] > 0 and (row["numeric_rate"] or 0) >= NUMERIC_TEXT
            kind = "empty" if row["distinct"] == 0 else "number" if held else row["kind"]
            out[row["column"]] = ColumnProfile(
                row["column"], kind, "measure" if held else role_of(row, kind), row["distinct"], row["null_rate"] or 0.0, row["unique_ratio"] or 0.0,
                row["numeric_rate"] or 0.0, row["least"], row["most"], unit_of(row["column"]), held,
            )
        return out

    @property
    def columns(self) -> list[str]:
        return visible(self.df)


def prepared(df: DataFrame) -> DataFrame:
    """A table as plans see it: missing values null, rows numbered, totals marked. What was
    stored by an engine is all that already."""
    if IS_SUMMARY in df.columns and ROW_ID in df.columns:
        return df
    clean = with_row_id(nan_to_null(df))
    if IS_SUMMARY not in clean.columns:
        clean = clean.withColumn(IS_SUMMARY, is_summary_row(clean.select(*[qcol(c) for c in visible(clean)])))
    return clean


class Catalog:
    """Tables by name. Names are kept as given, whatever marks they have."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.links: list[Relationship] = []
        self.chunk_count = 0  # of the documents beside the tables
        self._domains: dict[tuple[str, str], dict[str, list[str]]] = {}
        self._values: dict[str, DataFrame] = {}
        self._tokens: dict[str, DataFrame] = {}

    def add(self, name: str, df: DataFrame, card: Card | None = None) -> Table:
        """Register a table. A table with years in its column names also gets its long view ``name#long``."""
        clean = prepared(df)
        self.tables.pop(f"{name}#long", None)
        self.tables[name] = Table(name, clean, card or Card(), raw=df)
        if year_columns(visible(clean)):
            self.tables[f"{name}#long"] = Table(f"{name}#long", self._long(clean), card or Card(), long_of=name)
        self._forget(name)
        return self.tables[name]

    def _forget(self, name: str) -> None:
        self._domains = {k: v for k, v in self._domains.items() if k[0] != name}
        self._values.pop(name, None)
        self._tokens.pop(name, None)

    @staticmethod
    def _long(df: DataFrame) -> DataFrame:
        marked = df.select(*[qcol(c) for c in visible(df)], F.col(IS_SUMMARY).alias("__total"), F.col(ROW_ID).alias("__row"))
        return unpivot_years(marked).withColumnsRenamed({"__total": IS_SUMMARY, "__row": ROW_ID})

    def remove(self, name: str) -> None:
        for key in (name, f"{name}#long"):
            self.tables.pop(key, None)
        self._forget(name)

    def resolve_table(self, name: str) -> str | None:
        """A table by its name, its plain name, or the part behind its last colon."""
        if name in self.tables:
            return name
        wanted = plain_name(name)
        for key in self.tables:
            if plain_name(key) == wanted:
                return key
        tails = [key for key in self.tables if plain_name(key.rsplit(":", 1)[-1]) == wanted or plain_name(key.split(":", 1)[0]) == wanted]
        return tails[0] if len(tails) == 1 else None

    def domain(self, table: str, column: str, most: int = V.CARDINALITY) -> dict[str, list[str]]:
        """Normal form -> stored spellings of a text column, kept once asked for.

        A column of more than ``most`` values is not fetched; filters on it fall back to
        the literal text.
        """
        key = (table, column)
        if key not in self._domains:
            rows = V.column_domain(self.tables[table].df, column).limit(most + 1).collect()
            self._domains[key] = {r["norm"]: list(r["spellings"]) for r in rows} if len(rows) <= most else {}
        return self._domains[key]

    def index(self) -> DataFrame:
        """The value index of all tables. A table's part is counted once and written to the
        checkpoint folder; it is counted again only when the table is replaced."""
        for name, t in self.tables.items():
            if name not in self._values and t.long_of is None and any(is_text(f.dataType) for f in t.df.schema):
                # the labels of total rows are no values that a question could mean
                self._values[name] = stored(V.value_index({name: t.df.where(~F.col(IS_SUMMARY)).select(*[qcol(c) for c in t.columns])}))
        if not self._values:
            return self.spark.createDataFrame([], V.INDEX_SCHEMA)
        return reduce(DataFrame.unionByName, self._values.values())

    def take_index(self, index: DataFrame) -> None:
        """Take up a saved value index for the tables that it has, replaced when these are."""
        names = [r["table"] for r in index.select("table").distinct().collect()]
        self._values |= {n: index.where(F.col("table") == n) for n in names if n in self.tables}

    def values_of(self, name: str) -> DataFrame | None:
        """A table's part of the value index, if it has text columns; counted if it is not there yet."""
        self.index()
        return self._values.get(name)

    def take_values(self, name: str, values: DataFrame, tokens: DataFrame | None = None) -> None:
        self._values[name] = values
        if tokens is not None:
            self._tokens[name] = tokens

    def tokens_of(self, name: str) -> DataFrame | None:
        """A table's part of the index for misspelt words, written once like the value index."""
        values = self.values_of(name)
        if values is not None and name not in self._tokens:
            self._tokens[name] = stored(V.token_table(values).orderBy("initial", "size", "token"))
        return self._tokens.get(name)

    def tokens(self, roles: Sequence[str]) -> DataFrame | None:
        """The index for misspelt words over all text columns that play one of the roles."""
        parts = []
        for name, t in self.tables.items():
            columns = [c for c, p in t.profile.items() if p.kind == "text" and p.role in roles] if t.long_of is None else []
            rows = self.tokens_of(name) if columns else None
            if rows is not None:
                parts.append(rows.where(F.col("column").isin(columns)))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def columns_holding(self, table: str, value: str) -> list[tuple[str, int]]:
        return [(r["column"], r["count"]) for r in V.value_rebind(self.index(), table, plain(value)).collect()]

    def discover_links(self, columns: dict[str, list[str]] | None = None) -> list[Relationship]:
        """Verify key relationships between the tables' identifier-like columns, of any number of values, and keep them."""
        if columns is None:
            columns = {n: [c for c, p in t.profile.items() if p.role in ("identifier", "dimension") or c.lower().endswith(("key", "id", "code"))] for n, t in self.tables.items() if t.long_of is None}
            columns = {n: cs for n, cs in columns.items() if cs}
        if len(columns) > 1:
            found = relationships({n: self.tables[n].df for n in columns}, columns, most=None)
            self.links = [Relationship(*r) for r in found.collect()]
        return self.links

    def linked(self, left: str, left_column: str, right: str, right_column: str) -> bool:
        forward, back = (left, left_column, right, right_column), (right, right_column, left, left_column)
        return any((k.child_table, k.child_column, k.parent_table, k.parent_column) in (forward, back) for k in self.links)

    def version(self) -> str:
        """Changes when a table, its rows' number, its columns or their types do, or the number of chunks."""
        shapes = [[n, t.rows, t.df.select(*[qcol(c) for c in t.columns]).schema.simpleString()] for n, t in sorted(self.tables.items()) if t.long_of is None]
        return hashlib.sha1(json.dumps([shapes, self.chunk_count]).encode()).hexdigest()

    def metadata(self, name: str) -> dict:
        """What is known of a table besides its rows, ready for JSON."""
        t = self.tables[name]
        known = t.__dict__
        return {
            "card": asdict(t.card), "profile": {c: asdict(p) for c, p in t.profile.items()} if "profile" in known else None,
            "totals": t.has_totals if "has_totals" in known else None, "rows": t.rows,
        }

    def take_metadata(self, name: str, body: dict) -> None:
        """Take up what ``metadata`` gave; what does not fit the table's columns is left."""
        t = self.tables[name]
        card = body.get("card")
        if card:
            t.card = Card(**{**card, "validity": tuple(card["validity"]) if card["validity"] else None})
        if body.get("profile") and set(body["profile"]) == set(t.columns):
            t.__dict__["profile"] = {c: ColumnProfile(**p) for c, p in body["profile"].items()}
        for key, kept in (("totals", "has_totals"), ("rows", "rows")):
            if body.get(key) is not None:
                t.__dict__[kept] = body[key]

    def load_metadata(self, path: str) -> bool:
        """Take up the metadata of a store without versions; a missing or damaged file is a plain miss."""
        try:
            body = json.loads(Path(path).read_text(encoding="utf-8"))
            for n, columns in body["profiles"].items():
                if n in self.tables and set(columns) == set(self.tables[n].columns):
                    self.tables[n].__dict__["profile"] = {c: ColumnProfile(**p) for c, p in columns.items()}
            for n, card in body["cards"].items():
                if n in self.tables:
                    self.tables[n].card = Card(**{**card, "validity": tuple(card["validity"]) if card["validity"] else None})
            for n, totals in body.get("totals", {}).items():
                if n in self.tables:
                    self.tables[n].__dict__["has_totals"] = totals
            self.links = [Relationship(**k) for k in body["links"]]
        except (OSError, ValueError, KeyError, TypeError):
            return False
        return True
