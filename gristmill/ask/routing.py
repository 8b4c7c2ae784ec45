"""Which tables and which kind of answer a question is for, and hints where an answer is empty."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from gristmill.ask.grounding import MONTHS, Evidence
from gristmill.catalog import Card, Catalog, Table
from gristmill.columns import qcol
from gristmill.functions.text import CODE_SHAPE, acronym, plain, similarity_ratio, tokenize, tokens_of
from gristmill.operators import values as V
from gristmill.operators.profiling import key_uniqueness
from gristmill.plans.ir import Plan

NAME, YEAR, MONTH, VALUE = 2, 3, 3, 4
ALL_TABLES, KEY_UNIQUE = 6, 0.9
# Beginnings of words that ask for a chart.
PLOT_HINTS = ("plot", "chart", "graph", "visuali", "histogram", "bar ", "scatter", "trend", "distribution", "pie", "line chart", "boxplot")
PLOT = re.compile(rf"\b(?:{'|'.join(PLOT_HINTS)})", re.I)
#: What of it is struck from a question before it is planned: the chart and its kind, not what it is of.
CHART_WORDS = re.compile(r"\b(?:(?:bar|line|pie|area|scatter)\s+)?(?:chart|plot|graph|histogram|boxplot)(?:s|ted|ting)?\b|\bvisuali\w*|\b(?:pie|scatter)\b|\bbar\b(?=\s+(?:of|for)\b)|\b(?:trend|distribution)s?\b(?:\s+(?:of|in)\b)?", re.I)
# Words that ask for a document's words, and small talk.
PROSE = frozenset("document documents policy contract clause agreement paragraph explain describe summarise summarize".split())
CHAT = frozenset("hello hi thanks thank hey goodbye bye".split())
#: Likeness from which a name is taken for another's, what a name within another counts, and how near the second may come.
SAME_NAME, WITHIN_NAME, TOO_CLOSE = 0.86, 0.9, 0.05


def route(question: str, catalog: Catalog, documents: bool) -> str:
    """One of plot, docs, chat, analyze, by the question's words alone."""
    words = set(tokens_of(question))
    if PLOT.search(question):
        return "plot"
    if words and words <= CHAT | {"you", "there"}:
        return "chat"
    named = {t for table in catalog.tables.values() for c in table.columns for t in tokens_of(re.sub(r"[_\W]+", " ", c))}
    if documents and words & PROSE and not words & named:
        return "docs"
    return "analyze"


def without_chart_words(question: str) -> str:
    return " ".join(CHART_WORDS.sub(" ", question).split())


def snapshot_day(table: Table) -> str | None:
    return table.card.as_of


def tables_for(question: str, evidence: Evidence, catalog: Catalog, most: int = ALL_TABLES) -> list[str]:
    """The tables that a question should be planned over.

    Tables whose snapshot is the very day asked for, if there are any; else the best by words
    of their names, years and months within their dates, and values named; else all of few,
    or the best ranked of many. One that alone has a column asked for is added.
    """
    names = [n for n, t in catalog.tables.items() if t.long_of is None]
    days = {f"{int(y):04}-{int(m):02}-{int(d):02}" for d, m, y in re.findall(r"(?<!\d)(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?!\d)", question)}
    exact = [n for n in names if snapshot_day(catalog.tables[n]) in days]
    if exact:
        return exact
    words = set(tokens_of(question))
    months = [MONTHS[w] for w in words if w in MONTHS]
    score = dict.fromkeys(names, 0)
    for n in names:
        t = catalog.tables[n]
        score[n] += NAME * len(words & set(tokens_of(re.sub(r"[_\W]+", " ", n))))
        spans = [(p.least or "", p.most or "") for p in t.profile.values() if p.role in ("date", "year")]
        for year in evidence.years:
            score[n] += YEAR * any(lo[:4] <= str(year) <= hi[:4] for lo, hi in spans)
            for m in months:
                score[n] += MONTH * any(lo[:7] <= f"{year}-{m:02}" <= hi[:7] for lo, hi in spans if len(lo) > 4)
        score[n] += VALUE * sum(h.table == n for h in evidence.hits if h.score >= 10)
    best = [n for n in names if score[n]]
    chosen = sorted(best, key=lambda n: -score[n])[:most] if best else names if len(names) <= most else [n for n, _ in evidence.ranking if n in names][:most]
    asked = [(t, c) for t, c, like in evidence.columns if like == 1.0 and t in names]
    if asked and not any(t in chosen for t, _ in asked):
        chosen.append(asked[0][0])
    return chosen


def without_column(plan: Plan, column: str) -> Plan:
    """The plan without filters, groups and measures on a column that a reading forbids."""
    same = lambda name: plain(name) == plain(column)
    return replace(
        plan,
        filters=[f for f in plan.filters if not same(f.column)],
        group_by=[g for g in plan.group_by if not same(g)],
        aggregations=[a for a in plan.aggregations if not (a.column and same(a.column))],
        select=[s for s in plan.select if not same(s)],
    )


def code_and_name(table: Table) -> tuple[str, str] | None:
    """A table's columns of company codes and of their names, by the columns' names."""
    low = {c.lower(): c for c in table.columns}
    code = next((c for k, c in low.items() if "code" in k and ("company" in k or "entity" in k)), None)
    name = next((c for k, c in low.items() if "name" in k and ("company" in k or "entity" in k)), None)
    return (code, name) if code and name else None


def name_column(table: Table) -> str | None:
    """A table's column of companies' names: called COMPANY, or with name or company in its name and no code."""
    return next((c for c in table.columns if c.strip().upper() == "COMPANY" or ("NAME" in c.upper() or "COMPANY" in c.upper()) and "CODE" not in c.upper()), None)


def like_names(name: str, catalog: Catalog, besides: str) -> tuple[bool, list[tuple[float, str]]]:
    """Whether a table other than ``besides`` has a company's name, and else its names that are like it, best first.

    Likeness is the similarity, or WITHIN_NAME where one name's words are all among the other's.
    """
    norm = plain(name)
    words = tokens_of(norm)
    found: dict[str, float] = {}
    for other, table in catalog.tables.items():
        column = name_column(table) if table.long_of is None and other != besides else None
        values = catalog.values_of(other) if column else None
        if values is None:
            continue
        names = values.where(F.col("column") == column).groupBy("norm").agg(F.min("display").alias("display"))
        if not names.where(F.col("norm") == norm).isEmpty():
            return True, []
        tokens, asked = tokenize(F.col("norm")), F.array(*[F.lit(w) for w in words]).cast("array<string>")
        inside = (F.size(F.array_except(asked, tokens)) == 0) | (F.size(F.array_except(tokens, asked)) == 0)
        within = inside & (F.size(F.array_distinct(tokens)) >= 2) & F.lit(len(set(words)) >= 2)
        some = names.where(V.may_be_like(F.col("norm"), norm, SAME_NAME) | within)
        score = F.greatest(similarity_ratio(F.col("norm"), F.lit(norm)), F.when(within, WITHIN_NAME).otherwise(0.0))
        for r in some.withColumn("score", score).where(F.col("score") >= SAME_NAME).orderBy(F.desc("score"), "display").limit(3).collect():
            found[r["display"]] = max(r["score"], found.get(r["display"], 0.0))
    return False, sorted(((s, d) for d, s in found.items()), key=lambda x: (-x[0], x[1]))


def names_for_codes(question: str, catalog: Catalog) -> tuple[str, list[dict]]:
    """The question with company codes replaced by the names that a table gives them, and ways to
    choose from where the data have a name that is only like one of these.

    A name that other tables have, or that none of theirs is like, is taken silently.
    """
    for code in dict.fromkeys(re.findall(rf"\b{CODE_SHAPE}\b", question)):
        for table_name, table in catalog.tables.items():
            pair = code_and_name(table)
            found = table.df.where(qcol(pair[0]) == code.upper()).select(qcol(pair[1])).limit(1).collect() if pair else []
            if found and found[0][0]:
                name = found[0][0]
                same, near = like_names(name, catalog, table_name)
                if not same and near:
                    close = [d for s, d in near if near[0][0] - s < TOO_CLOSE]
                    put = lambda shown: re.sub(rf"\b{code}\b", lambda _: shown, question)  # noqa: B023, E731
                    return question, [{"kind": "question", "question": put(d), "label": f"{d} (code {code} is {name})", "value": d} for d in close]
                question = re.sub(rf"\b{code}\b", lambda _: name, question)  # noqa: B023
                break
    return question, []


def acronyms(question: str, catalog: Catalog, most: int = 3) -> list[tuple[str, str]]:
    """(letters, stored value) where a short word of the question is the initials of a value's first words."""
    words = [w for w in dict.fromkeys(tokens_of(question)) if 2 <= len(w) <= 5]
    tokens = catalog.tokens(("dimension", "identifier")) if words else None
    if tokens is None:
        return []
    names = tokens.select("norm", "display", "count").distinct()
    spelled = F.array_compact(F.array(*[F.when(acronym(F.col("norm"), len(w)) == w, F.lit(w)) for w in words]))
    found = names.select(F.explode(spelled).alias("word"), "display", "count").groupBy("word", "display").agg(F.sum("count").alias("count"))
    return [(r["word"], r["display"]) for r in found.orderBy(F.desc("count"), "word", "display").limit(most).collect()]


def empty_hint(plan: Plan, catalog: Catalog) -> str:
    """Why a plan may have found nothing: values that stand in other columns or tables."""
    lines = []
    for f in plan.filters:
        for value in f.value if isinstance(f.value, list) else [f.value]:
            if isinstance(value, str):
                places = [f"{n}.{c}" for n in catalog.tables if catalog.tables[n].long_of is None for c, _ in catalog.columns_holding(n, value)]
                if places and not any(p.endswith(f".{f.column}") for p in places):
                    lines.append(f"{value!r} is a value of {', '.join(places)}")
    return "; ".join(lines)


def checked_card(card: Card, table: Table) -> Card:
    """A card without claims that the data do not bear out: columns that are not there, a key
    that is not unique to KEY_UNIQUE, validity columns that hold no dates."""
    columns = set(table.columns)
    key = [c for c in card.entity_key if c in columns]
    if key:
        ratio = key_uniqueness(table.df, [key]).first()["ratio"]
        key = key if (ratio or 0) >= KEY_UNIQUE else []
    pair = card.validity if card.validity and all(c in columns and table.profile[c].role in ("date", "empty") for c in card.validity) else None
    try:
        as_of = card.as_of and str(datetime.fromisoformat(card.as_of).date())
    except ValueError:
        as_of = None
    return replace(card, entity_key=key, validity=pair, as_of=as_of, measures=[m for m in card.measures if m in columns and table.profile[m].role == "measure"])
