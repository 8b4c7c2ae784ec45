"""What a question names: values, columns, years, days, tables."""

from __future__ import annotations

import calendar
import re
from collections.abc import Collection
from dataclasses import dataclass, field
from datetime import date
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from gristmill.catalog import Catalog
from gristmill.functions.text import plain, tokens_of
from gristmill.operators import values as V

# Month names, words that ask for a state on a day, words of no content.
MONTHS = {m.lower(): i for i, m in enumerate(calendar.month_name) if m}
CUES = re.compile(r"\b(as at|as of|at the end of|end of|by the end of|on)\b")
STOP = frozenset("a an and are as at by each for from give how i in is it list many me much of on or per please show tell that the their there this to was were what when where which who with".split())
NAME_SCORE, VALUE_SCORE, CAPABILITY = 4, 3, 12
#: Likeness of a typed word and a stored one that it may stand for.
MEANT = 0.75


@dataclass
class Hit:
    table: str
    column: str
    norm: str
    display: str
    count: int
    score: float
    kind: str = "whole"


@dataclass
class Evidence:
    question: str
    hits: list[Hit] = field(default_factory=list)
    columns: list[tuple[str, str, float]] = field(default_factory=list)  # table, column, likeness
    years: list[int] = field(default_factory=list)
    day: date | None = None
    ranking: list[tuple[str, float]] = field(default_factory=list)


def as_at_day(question: str) -> date | None:
    """The day of "as at 31.12.2023" or "at the end of december 2023"; a bare date needs a cue word."""
    text = plain(question)
    if not CUES.search(text):
        return None
    m = re.search(r"(?<!\d)(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?!\d)", text)
    try:
        if m:
            return date(int(m[3]), int(m[2]), int(m[1]))
        m = re.search(r"(?<!\d)(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)", text)
        if m:
            return date(int(m[1]), int(m[2]), int(m[3]))
    except ValueError:
        return None
    m = re.search(rf"\b({'|'.join(MONTHS)})\s+((?:19|20)\d{{2}})\b", text)
    if m:
        year, month = int(m[2]), MONTHS[m[1]]
        return date(year, month, calendar.monthrange(year, month)[1])
    return None


def likeness(word: str, column: str) -> float:
    """How well a question's word names a column: a whole token 1, a part of one less."""
    best = 0.0
    for token in tokens_of(re.sub(r"[_\W]+", " ", column)):
        if token == word or token.rstrip("s") == word.rstrip("s"):
            return 1.0
        if min(len(token), len(word)) >= 4:
            ratio = SequenceMatcher(None, token, word).ratio()
            if ratio >= 0.84:
                best = max(best, ratio * 0.9)
    return best


def ground(question: str, catalog: Catalog) -> Evidence:
    out = Evidence(question, day=as_at_day(question))
    out.years = sorted({int(y) for y in re.findall(r"(?<![\d.])((?:19|20)\d{2})(?!\d)", question)})
    out.hits = [Hit(*(r[c] for c in ("table", "column", "norm", "display", "count", "score", "kind"))) for r in V.value_hits(catalog.index(), question).collect()]
    words = [w for w in tokens_of(question) if w not in STOP and len(w) >= 3]
    if len(out.hits) > 1:
        out.hits = without_noise(out.hits, words, word_spread(out.hits, words, catalog))
    scores = dict.fromkeys(catalog.tables, 0.0)
    for name, table in catalog.tables.items():
        capability = 0.0
        for column in table.columns:
            near = max((likeness(w, column) for w in words), default=0.0)
            if near:
                out.columns.append((name, column, near))
                capability += 3 * near
        named = set(tokens_of(re.sub(r"[_\W]+", " ", name)))
        scores[name] = min(CAPABILITY, capability) + NAME_SCORE * bool(named & set(words)) + min(VALUE_SCORE, sum(1 for h in out.hits if h.table == name))
    out.columns.sort(key=lambda c: (-c[2], c[0], c[1]))
    out.ranking = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    return out


def word_spread(hits: list[Hit], words: list[str], catalog: Catalog) -> dict[tuple[str, str, str], int]:
    """(table, column, word) -> how many stored values of the column have the word as a token."""
    places = {(h.table, h.column) for h in hits if h.kind != "whole"}
    out: dict[tuple[str, str, str], int] = {}
    for table in {t for t, _ in places}:
        rows = catalog.tokens_of(table)
        some = rows.where(F.col("token").isin(words) & F.col("column").isin([c for t, c in places if t == table])) if rows is not None and words else None
        if some is not None:
            out |= {(table, r["column"], r["token"]): r["n"] for r in some.groupBy("column", "token").agg(F.count_distinct("norm").alias("n")).collect()}
    return out


def without_noise(hits: list[Hit], words: list[str], spread: dict[tuple[str, str, str], int]) -> list[Hit]:
    """Hits without words that merely describe.

    A name is a value of several words that the question names by itself, or by a word that
    no other value of its column has. Beside a name, a word that several values of another
    column have says what kind of thing is meant, not which.
    """

    def met(h: Hit) -> list[str]:
        tokens = tokens_of(h.norm)
        return [w for w in words if w in tokens]

    def is_name(h: Hit) -> bool:
        if len(tokens_of(h.norm)) < 2:
            return False
        return h.kind == "whole" or any(len(w) >= 4 and spread.get((h.table, h.column, w), 1) <= 1 for w in met(h))

    named = {(h.table, h.column) for h in hits if is_name(h)}
    if not named:
        return hits
    kept = [h for h in hits if (h.table, h.column) in named or h.kind == "whole" or not met(h) or max(spread.get((h.table, h.column, w), 1) for w in met(h)) < 2]
    return kept or hits


def missing_conditions(evidence: Evidence, filters: list) -> list[str]:
    """Values named whole in the question that no filter of a plan has."""
    used = {plain(str(v)) for f in filters for v in (f.value if isinstance(f.value, list) else [f.value])}
    return [h.display for h in evidence.hits if h.score >= 10 and h.norm not in used]


def did_you_mean(question: str, catalog: Catalog, most: int = 3, ignored: Collection[str] = ()) -> list[tuple[str, str]]:
    """(typed word, stored value) for words of no column or value that resemble a value.

    Looked up in the index for misspelt words: a column that has the word itself knows it;
    of the others come the values whose tokens are most like the word.
    """
    known = {t for table in catalog.tables.values() for c in table.columns for t in tokens_of(c)}
    words = [w for w in dict.fromkeys(tokens_of(question)) if len(w) >= 4 and w not in known and w not in STOP and w not in ignored]
    tokens = catalog.tokens(("dimension", "identifier")) if words else None
    if tokens is None:
        return []
    near = V.like(tokens, words, MEANT)
    met = tokens.join(near, "token").select("table", "column", "display", "count", "token", "word", "ratio")
    here = met.where(F.col("token") == F.col("word")).select("table", "column", "word").distinct()
    others = met.where(F.col("token") != F.col("word")).join(here, ["table", "column", "word"], "left_anti")
    best = others.groupBy("word", "display").agg(F.max("ratio").alias("ratio"), F.sum("count").alias("count")).orderBy(F.desc("ratio"), F.desc("count"), "word", "display")
    return [(r["word"], r["display"]) for r in best.limit(most).collect()]


def readings(evidence: Evidence, catalog: Catalog) -> list[dict]:
    """Ways to read a value that is also a word of a measure's name: a filter on the value, or
    the measure over all rows. Empty if there is one way only, or the question names the measure."""
    asked = f" {plain(evidence.question)} "
    out = []
    for hit in evidence.hits:
        if hit.score < 10:
            continue
        table = catalog.tables[hit.table]
        for column, p in table.profile.items():
            name = tokens_of(re.sub(r"[_\W]+", " ", column))
            if p.role == "measure" and any(t.startswith(hit.norm) or hit.norm.startswith(t) and len(t) >= 3 for t in name) and f" {' '.join(name)} " not in asked:
                if re.search(r"\b(equivalent|converted|in total in)\b", asked):
                    return [{"kind": "measure", "column": column, "value": hit.display}]
                out = [{"kind": "filter", "column": hit.column, "value": hit.display}, {"kind": "measure", "column": column, "value": hit.display}]
    return out


def places_of(evidence: Evidence) -> list[dict]:
    """Columns to choose from where a value that is named whole stands in several and the question names none of them."""
    whole = [h for h in evidence.hits if h.score >= 10]
    norms = {h.norm for h in whole}
    named = {(t, c) for t, c, like in evidence.columns if like == 1.0}
    if len(norms) != 1 or len(whole) < 2 or named & {(h.table, h.column) for h in whole}:
        return []
    return [{"kind": "place", "table": h.table, "column": h.column, "value": h.display, "label": f"{h.display} as {h.column} of {h.table}"} for h in sorted(whole, key=lambda h: (-h.count, h.table, h.column))]


# Words of a currency's column; words that ask for amounts converted.
CURRENCY, CONVERTED = ("currency", "ccy", "νομισμα"), re.compile(r"\b(equivalent|converted|in total in)\b")


def own_or_converted(evidence: Evidence, catalog: Catalog, group: str | None) -> list[dict]:
    """Ways to add up by a column of currencies: each one's own amounts, or those of the measure that
    is named after one of its values. One way only if the question says that amounts are converted."""
    out = []
    for name, table in catalog.tables.items():
        p = table.profile.get(group or "")
        if p is None or p.role != "dimension" or not any(w in group.lower() for w in CURRENCY):
            continue
        domain = catalog.domain(name, group)
        measures = [c for c, q in table.profile.items() if q.role == "measure"]
        tokens = {c: tokens_of(re.sub(r"[_\W]+", " ", c)) for c in measures}
        converted = [c for c in measures if any(len(v) >= 3 and any(t == v or t.startswith(v) for t in tokens[c]) for v in domain)]
        own = [c for c in measures if c not in converted]
        if 2 <= len(domain) <= 200 and converted and own:
            both = {"kind": "by", "table": name, "group": group}
            whole = both | {"column": converted[0], "label": f"{converted[0]}, converted, for each {group}"}
            if CONVERTED.search(plain(evidence.question)):
                return [whole]
            out = [both | {"column": own[0], "label": f"each {group}'s own amounts ({own[0]})"}, whole]
    return out
