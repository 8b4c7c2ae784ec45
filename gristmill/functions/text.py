"""Text functions: normal form, tokens, similarity, chunks, codes, JSON."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.columns import stripped

CHUNK_SIZE, CHUNK_OVERLAP = 1000, 150
# Shape of a company code; the same within a question; words for currencies, the
# first found wins; words for kinds of funds, likewise.
CODE_SHAPE = r"[A-Za-z]{1,4}\d{1,5}[A-Za-z]?"
QUESTION_CODE = r"\b([A-Z]{1,3}\d{2,3})\b"
CURRENCY_WORDS = {"euro": "EUR", "eur": "EUR", "€": "EUR", "dollar": "USD", "usd": "USD", "$": "USD", "pound": "GBP", "gbp": "GBP", "franc": "CHF", "chf": "CHF", "krona": "SEK", "krone": "DKK"}
FUND_WORDS = ("equity", "bond", "fixed income", "money market", "fund")


def plain(text: str) -> str:
    """Without accents and case, one sigma, single spaces."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold().replace("ς", "σ")
    return " ".join(folded.split())


def tokens_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", plain(text))


@F.pandas_udf(T.StringType())
def norm_text(values: pd.Series) -> pd.Series:
    """``plain`` of each value, computed once per distinct value of a batch; null stays null."""
    known = {v: plain(v) for v in values.dropna().unique()}
    return values.map(known).astype(object).where(values.notna(), None)


@F.pandas_udf(T.DoubleType())
def similarity_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Twice the matched characters over all, by longest matching blocks; null if either is."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def chunks_of(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Paragraphs packed, a line break between them, up to ``size`` characters; a longer one is
    cut in steps of ``size - overlap``. Each piece but the first begins with the end of the
    one before it. Null and blank texts have none."""
    pieces: list[str] = []
    held = ""
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text or ""))):
        if len(held) + 1 + len(paragraph) <= size:
            held = f"{held}\n{paragraph}" if held else paragraph
            continue
        if held:
            pieces.append(held)
        held = paragraph if len(paragraph) <= size else ""
        if not held:
            pieces += [paragraph[i : i + size] for i in range(0, len(paragraph), max(1, size - overlap))]
    pieces += [held] if held else []
    if overlap <= 0:
        return pieces
    return pieces[:1] + [f"{before[-overlap:]}\n{piece}".strip() for before, piece in zip(pieces, pieces[1:])]


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunk_text(values: pd.Series) -> pd.Series:
    return values.map(chunks_of)


@F.pandas_udf(T.StringType())
def json_extract(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The first JSON object within each text, compact; null if there is none."""
    for batch in values:
        yield batch.map(lambda t: None if (found := first_object(t)) is None else json.dumps(found, ensure_ascii=False, separators=(",", ":")))


def first_object(text: str | None) -> dict | None:
    """The first balanced JSON object of a reply, past reasoning blocks and code fences."""
    text = re.sub(r"<think>.*?</think>", "", text or "", flags=re.S)
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
        except ValueError:
            pass
        else:
            if isinstance(found, dict):
                return found
        at = text.find("{", at + 1)
    return None


def tokenize(column: Column) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def strip_upper(column: Column) -> Column:
    return F.upper(F.regexp_replace(stripped(column), r"\s+", " "))


def looks_like_code(column: Column) -> Column:
    return F.coalesce(column.rlike(rf"^{CODE_SHAPE}$"), F.lit(False))


def acronym(column: Column, letters: int) -> Column:
    """Initials of the first tokens."""
    return F.array_join(F.transform(F.slice(tokenize(column), 1, letters), lambda t: F.substring(t, 1, 1)), "")


def first_code(column: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(column), QUESTION_CODE, 1), F.lit(""))


def first_iso_date(column: Column) -> Column:
    """The first ``d.m.yyyy`` (dots, slashes or dashes) as ``yyyy-mm-dd``; null for none."""
    parts = r"(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})"
    part = lambda k: F.lpad(F.regexp_extract(column, parts, k), 2, "0")
    return F.when(column.rlike(parts), F.concat_ws("-", F.regexp_extract(column, parts, 3), part(2), part(1)))


def first_currency(column: Column, default: str = "EUR") -> Column:
    low, out = F.lower(column), F.lit(default)
    for word, code in reversed(CURRENCY_WORDS.items()):
        out = F.when(F.contains(low, F.lit(word)), code).otherwise(out)
    return out


def first_fund_type(column: Column) -> Column:
    low, out = F.lower(column), F.lit(None).cast("string")
    for word in reversed(FUND_WORDS):
        out = F.when(F.contains(low, F.lit(word)), word.upper()).otherwise(out)
    return out


def cosine(left: Column, right: Column) -> Column:
    """Inner product over the norms, in doubles; null for a zero or missing vector."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(left, right), F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))


def register(spark: SparkSession) -> None:
    """Make the functions that SQL lacks available to the SQL tier."""
    spark.udf.register("norm_text", norm_text)
    spark.udf.register("similarity_ratio", similarity_ratio)
    spark.udf.register("chunk_text", chunk_text)
