"""Tables within text: markdown tables, separated lines, ``label: value`` lists."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.columns import qcol

ITEM = r"(?m)^[ \t]*(?:[-*•][ \t]*|\d+[.)][ \t]*)?([^:\n]{1,80}):[ \t]*[$€£]?[ \t]*(-?[\d,]+(?:\.\d+)?)[ \t]*%?[ \t]*$"
SEPARATED_LINES = 20


def list_pairs(rows: DataFrame, text: str) -> DataFrame:
    """The other columns with ``label`` and ``value`` of every ``label: number`` line of the text."""
    keep = [c for c in rows.columns if c != text]
    found = F.regexp_extract_all(qcol(text), F.lit(ITEM), F.lit(0))
    lines = rows.select(*[qcol(c) for c in keep], F.explode(found).alias("_line"))
    label, value = F.regexp_extract("_line", ITEM, 1), F.regexp_extract("_line", ITEM, 2)
    return lines.select(*[qcol(c) for c in keep], F.trim(label).alias("label"), F.translate(value, ",", "").try_cast("double").alias("value"))


def table_in(text: str) -> tuple[list[str], list[list[str]]] | None:
    """Header and rows of the first table in a short text, or None.

    A markdown table goes before separated lines, these before a list; each needs a
    header or two rows of a number at least.
    """
    lines = [line.strip() for line in text.splitlines()]
    for i, line in enumerate(lines[1:], start=1):
        if re.fullmatch(r"\|?[\s:|-]*-[\s:|-]*\|?", line) and "|" in line and "|" in lines[i - 1]:
            cells = lambda s: [c.strip() for c in s.strip("|").split("|")]
            body = []
            for row in lines[i + 1 :]:
                if "|" not in row:
                    break
                body.append(cells(row))
            return cells(lines[i - 1]), body
    filled = [line for line in lines if line][:SEPARATED_LINES]
    for mark in ("\t", ";", ","):
        rows = list(csv.reader(io.StringIO("\n".join(filled)), delimiter=mark))
        if len(rows) >= 2 and len(rows[0]) >= 2 and len({len(r) for r in rows}) == 1:
            return rows[0], rows[1:]
    items = [(m[1].strip(), m[2]) for m in re.finditer(ITEM, text)]
    return (["label", "value"], [list(x) for x in items]) if len(items) >= 2 else None


def code_name_list(df: DataFrame) -> DataFrame | None:
    """Distinct (code, name) rows of a result of two columns of which one is codes for the most part; else None."""
    from gristmill.functions.text import looks_like_code

    if len(df.columns) != 2:
        return None
    shares = df.agg(*[F.avg(looks_like_code(qcol(c).cast("string")).cast("int")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    best = max((0, 1), key=lambda i: shares[i] or 0.0)
    if (shares[best] or 0.0) < 0.5:
        return None
    return df.select(qcol(df.columns[best]).alias("code"), qcol(df.columns[1 - best]).alias("name")).distinct()


def badge(name: str) -> str | None:
    """The short code that a table's name begins with, such as CY05."""
    found = re.search(r"\b([A-Z]{2,4}\d{1,3})\b", name)
    return found[1] if found else None


def chartable(df: DataFrame) -> bool:
    """Whether a result has a number column and two rows at least."""
    from gristmill.columns import is_number

    return any(is_number(f.dataType) for f in df.schema) and len(df.limit(2).collect()) == 2
