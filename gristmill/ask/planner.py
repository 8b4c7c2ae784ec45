"""Plans from words, without a model where the question is plain, else through one that is given."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from gristmill.ask.continuity import carries_over, edits_by_place, in_doubt, subject_of, with_subject
from gristmill.ask.grounding import STOP, Evidence, did_you_mean, ground, likeness, missing_conditions, own_or_converted, places_of, readings
from gristmill.ask.routing import acronyms, names_for_codes, tables_for, without_column
from gristmill.catalog import Catalog
from gristmill.functions.text import first_object, plain, tokens_of
from gristmill.plans.compiler import Compiled, compile_plan
from gristmill.plans.ir import Aggregation, Filter, Plan, PlanError
from gristmill.plans.sqltier import run_sql, tables_of
from gristmill.sources.files import HouseRules
from gristmill.timing import stage

# A model: from chat messages to its reply.
Model = Callable[[list[dict]], str]

# Words for aggregations; words of questions that need more than one step;
# words that make a follow-up of a short question.
AGGREGATIONS = {"total": "sum", "sum": "sum", "average": "mean", "mean": "mean", "median": "median", "minimum": "min", "lowest": "min", "smallest": "min", "maximum": "max", "highest": "max", "largest": "max", "count": "count", "number": "count", "many": "count"}
COMPLEX = frozenset("share compare versus vs percent percentage ratio difference between change growth as at except without excluding top trend rank over under above below more less than".split())
MARKERS = ("and", "what about", "how about", "same", "now", "only", "instead", "also")
GROUP_WORD = re.compile(r"\b(?:per|by|for each|grouped by)\s+([\w ]+)$")
CLOSE_SECOND, SURE = 0.8, 6.0


def simple_plan(evidence: Evidence, catalog: Catalog) -> Plan | None:
    """A plan of one aggregation of one measure, with at most one value and one group, or None.

    Any doubt is a None: two measures about as likely, a value in several columns, a word
    of four letters or more that nothing explains.
    """
    text = plain(evidence.question)
    on_day = [n for n, t in catalog.tables.items() if evidence.day and t.card.as_of == str(evidence.day) and t.long_of is None]
    if on_day:  # the day says which snapshot is meant, and nothing else
        text = plain(re.sub(r"\b(as at|as of)\b|\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d{2}-\d{2}", " ", text))
    words = tokens_of(text)
    if set(words) & COMPLEX or evidence.day and not on_day:
        return None
    fns = {AGGREGATIONS[w] for w in words if w in AGGREGATIONS}
    if len(fns) != 1:
        return None
    fn, explained = fns.pop(), {w for w in words if w in AGGREGATIONS or w in STOP}
    whole = [h for h in evidence.hits if h.score >= 10 and (not on_day or h.table in on_day)]
    if len({(h.table, h.column) for h in whole}) > 1 or len({h.norm for h in whole}) > 1:
        return None
    ranking = [(n, s) for n, s in evidence.ranking if s > 0 and (not on_day or n in on_day)]
    tables = [whole[0].table] if whole else [n for n, s in ranking if s == ranking[0][1]]
    if len(tables) != 1:
        return None
    name = tables[0]
    table = catalog.tables[name]
    explained |= set(tokens_of(whole[0].norm)) if whole else set()
    group = None
    m = GROUP_WORD.search(text)
    if m:
        asked = tokens_of(m[1])
        best = max(table.columns, key=lambda c: sum(likeness(w, c) for w in asked))
        if not sum(likeness(w, best) for w in asked):
            return None
        group = best
        explained |= set(asked)
    measure = None
    if fn != "count":
        rest = [w for w in words if w not in explained]
        scored = sorted(((sum(likeness(w, c) for w in rest) * 3, c) for c, p in table.profile.items() if p.role == "measure" and c != group), reverse=True)
        if not scored or scored[0][0] == 0:
            return None
        if len(scored) > 1 and scored[1][0] >= CLOSE_SECOND * scored[0][0] and scored[0][0] < SURE:
            return None
        measure = scored[0][1]
    for w in words:
        if w not in explained and any(likeness(w, c) for c in [*table.columns, re.sub(r"[_\W]+", " ", name)]):
            explained.add(w)
    if any(len(w) >= 4 and w not in explained and not w.isdigit() for w in words):
        return None
    filters = [Filter(whole[0].column, "match", whole[0].display)] if whole else []
    if evidence.years and not on_day:
        years = [c for c, p in table.profile.items() if p.role in ("year", "date")]
        if len(years) != 1 or len(evidence.years) != 1:
            return None
        filters.append(Filter(years[0], "eq", evidence.years[0]))
    return Plan(table=name, filters=filters, group_by=[group] if group else [], aggregations=[Aggregation(fn, measure)])


def follow_up(question: str, last: Plan | None, catalog: Catalog) -> Plan | None:
    """The last plan changed as a short question asks: another year, value or group; else None."""
    text = plain(question)
    words = tokens_of(text)
    bare_year = re.fullmatch(r"(and |for |in )*((19|20)\d{2})", " ".join(words))
    group = GROUP_WORD.search(text)
    if last is None or len(words) > 9 or not (bare_year or group or any(text.startswith(m) for m in MARKERS)):
        return None
    named = {AGGREGATIONS[w] for w in words if w in AGGREGATIONS}
    if named and named != {a.fn for a in last.aggregations}:
        return None
    table = catalog.resolve_table(last.table)
    if table is None:
        return None
    t, plan, changed = catalog.tables[table], replace(last, filters=list(last.filters)), False
    years = [w for w in words if re.fullmatch(r"(19|20)\d{2}", w)]
    if years:
        columns = [c for c, p in t.profile.items() if p.role in ("year", "date")]
        at = next((i for i, f in enumerate(plan.filters) if f.column in columns), None)
        if at is not None:
            plan.filters[at] = replace(plan.filters[at], value=int(years[0]))
            changed = True
        elif columns:
            plan.filters.append(Filter(columns[0], "eq", int(years[0])))
            changed = True
    for hit in ground(question, catalog).hits:
        if hit.table == table and hit.score >= 10:
            plan.filters = [f for f in plan.filters if f.column != hit.column] + [Filter(hit.column, "match", hit.display)]
            changed = True
            break
    if group:
        asked = tokens_of(group[1])
        best = max(t.columns, key=lambda c: sum(likeness(w, c) for w in asked))
        if sum(likeness(w, best) for w in asked):
            plan.group_by, plan.sort, plan.limit, changed = [best], None, None, True
    return plan if changed else None


def siblings(catalog: Catalog, names: list[str]) -> list[list[str]]:
    """Tables of the same columns, together."""
    groups: dict[tuple, list[str]] = {}
    for n in names:
        groups.setdefault(tuple(sorted(catalog.tables[n].columns)), []).append(n)
    return [g for g in groups.values() if len(g) > 1]


def told_apart(catalog: Catalog, name: str) -> str:
    """What tells a table from others of the same columns: its rows, its span of dates, and two dimensions' values."""
    t = catalog.tables[name]
    spans = [f"{c} {p.least}..{p.most}" for c, p in t.profile.items() if p.role in ("date", "year") and p.least]
    few = [c for c, p in t.profile.items() if p.role == "dimension" and p.kind == "text" and p.distinct <= 12][:2]
    shown = [f"{c}: " + ", ".join(s[0] for s in list(catalog.domain(name, c).values())[:4]) for c in few]
    return "; ".join([f"{t.rows} rows", *spans[:1], *shown])


def schema_text(catalog: Catalog, tables: list[str], values: int = 8, detail: bool = False) -> str:
    """Tables and columns as a model reads them. ``detail``: ranges of numbers and dates, and
    all values of a column with at most 200."""
    lines, alike = [], {n for g in siblings(catalog, tables) for n in g}
    for name in tables:
        t = catalog.tables[name]
        lines.append(f"TABLE {name}" + (f" (as of {t.card.as_of})" if t.card.as_of else "") + (f": {t.card.purpose}" if t.card.purpose else ""))
        if name in alike:
            lines.append(f"  differs by: {told_apart(catalog, name)}")
        lines += [f"  note: {c}" for c in t.card.caveats]
        for c, p in t.profile.items():
            shown = ""
            if p.role == "dimension" and p.kind == "text":
                domain = list(catalog.domain(name, c).values())
                shown = " values: " + ", ".join(s[0] for s in domain[: 200 if detail and len(domain) <= 200 else values])
            elif detail and p.kind in ("number", "date") and p.least is not None:
                shown = f" from {p.least} to {p.most}"
            lines.append(f"  {c}: {p.kind}, {p.role}{shown}" + (f", {p.unit}" if p.unit else ""))
    return "\n".join(lines)


GRAMMAR = (
    "Answer with one JSON object: {table, join?: {right_table, left_column, right_column}, filters: [{column, op, value, or_null?}], group_by: [], "
    "aggregations: [{fn, column?, alias?}], having: [], derived: [{alias, kind: pct_of_total|ratio, num, den?}], union: [], compare?: {left_table, right_table, key, measures}, "
    "select: [], sort?: {by, desc}, limit?, clarification?}. op is one of match eq ne in contains gt ge lt le between isnull notnull; fn of sum mean median min max count nunique."
)


SQL_ASKED = "Answer with one SQL query over these tables and nothing else; write table and column names in backticks."
PROPOSAL = 'The question cannot be answered as asked. Answer with one JSON object {"proposal": a yes/no question that offers a near alternative, "question": that alternative as a question}; both empty if there is none.'


def instructions(text: str, rules: list[str]) -> dict:
    """A system message, with the rules of the house if there are any."""
    return {"role": "system", "content": "\n".join([text, *(["Rules of the house:", *rules] if rules else [])])}


def model_plan(question: str, evidence: Evidence, catalog: Catalog, model: Model, day: date | None, rules: list[str] | None = None) -> tuple[Plan, Compiled | None]:
    """A plan from the model, compiled; told of its errors once, it may mend them. PlanError beyond that."""
    tables = tables_for(question, evidence, catalog)
    found = ", ".join(f"{h.table}.{h.column} = {h.display!r}" for h in evidence.hits)
    messages = [instructions(GRAMMAR, rules or []), {"role": "user", "content": f"{schema_text(catalog, tables)}\nVerified values: {found or 'none'}\nQuestion: {question}"}]
    for attempt in range(2):
        reply = model(messages)
        body = first_object(reply)
        try:
            if body is None:
                raise PlanError([("empty", "the reply holds no JSON object")])
            plan = Plan.from_dict(body)
            if plan.clarification:
                return plan, None
            compiled = compile_plan(plan, catalog, day)
            left_out = missing_conditions(evidence, plan.filters)
            if left_out and not attempt:
                raise PlanError([("coverage", f"the question also names {', '.join(left_out)}")])
            return plan, compiled
        except PlanError as e:
            if attempt:
                raise
            messages += [{"role": "assistant", "content": reply}, {"role": "user", "content": "Mend the plan: " + json.dumps(e.issues, ensure_ascii=False)}]
    raise AssertionError("unreachable")


def model_sql(question: str, evidence: Evidence, catalog: Catalog, model: Model, rules: list[str] | None = None, attempts: int = 3) -> Compiled:
    """A guarded query that the model writes where no plan was found; it is told of each error."""
    tables = tables_for(question, evidence, catalog)
    messages = [instructions(SQL_ASKED, rules or []), {"role": "user", "content": f"{schema_text(catalog, tables, detail=True)}\nQuestion: {question}"}]
    for attempt in range(attempts):
        reply = model(messages)
        text = re.sub(r"^\s*```\w*\n|```\s*$", "", reply).strip().rstrip(";")
        try:
            df, notes = run_sql(catalog, text), []
            return Compiled(df, [text], tables_of(catalog, text), notes, [("result", df)])
        except (PlanError, AnalysisException) as e:
            if attempt == attempts - 1:
                raise PlanError([("sql", str(e).splitlines()[0])]) from e
            messages += [{"role": "assistant", "content": reply}, {"role": "user", "content": f"Mend the query: {str(e).splitlines()[0]}"}]
    raise AssertionError("unreachable")


def proposed(question: str, catalog: Catalog, model: Model, why: str) -> dict | None:
    """A nearby question that the model offers instead, with how it asks for consent."""
    body = first_object(model([{"role": "system", "content": PROPOSAL}, {"role": "user", "content": f"{schema_text(catalog, [n for n, t in catalog.tables.items() if t.long_of is None])}\nQuestion: {question}\nWhy not: {why}"}]))
    if not body or not body.get("proposal") or not body.get("question"):
        return None
    return {"kind": "question", "question": str(body["question"]), "label": "Yes", "asks": str(body["proposal"])}


@dataclass
class Answer:
    """A question's outcome: rows and how they came about, or options to choose from, or why there is none."""

    kind: str  # rows, clarify, chart, docs, chat, none
    compiled: Compiled | None = None
    plan: Plan | None = None
    tier: str = ""
    options: list[str] | None = None
    text: str = ""
    hint: str = ""
    chart: dict | None = None
    docs: DataFrame | None = None
    confidence: float | None = None
    seconds: dict[str, float] = field(default_factory=dict)


class Conversation:
    """Questions in a row over one catalogue: follow-ups, choices, cached plans.

    ``rules`` are read anew for every question. Plans are kept in memory, and in a JSON file
    if ``cache`` names one, for the last CACHED_VERSIONS states of the tables.
    """

    CACHED_VERSIONS = 3

    def __init__(self, catalog: Catalog, model: Model | None = None, rules: HouseRules | None = None, cache: str | None = None):
        self.catalog, self.model, self.rules = catalog, model, rules
        self.last: Plan | None = None
        self.last_question = ""
        self.last_answer: Answer | None = None
        self.pending: list[dict] = []
        self.pending_question = ""
        self.plans: dict[str, dict[str, dict]] = {}
        self.cache: str | None = None
        if cache:
            self.keep_in(cache)

    def keep_in(self, path: str) -> None:
        """Keep plans in a file from now on; what it holds is taken up, a damaged one is a plain miss."""
        self.cache = path
        try:
            with open(path, encoding="utf-8") as file:
                held = json.load(file)
            self.plans = {v: {q: p for q, p in plans.items() if isinstance(p, dict)} for v, plans in held.items()} | self.plans
        except (OSError, ValueError, AttributeError):
            pass

    def clear(self) -> None:
        """Forget the conversation; plans that were made stay."""
        self.last, self.last_question, self.last_answer = None, "", None
        self.pending, self.pending_question = [], ""

    def ask(self, question: str) -> Answer:
        answer = self._ask(question)
        if answer.kind == "rows":
            self.last_question, self.last_answer = question, answer
        return answer

    def _ask(self, question: str) -> Answer:
        chosen = self._choice(question)
        if chosen is not None:
            return chosen
        if edits_by_place(question):
            return Answer("none", text="Rows of an answer cannot be taken out by position; name what to leave out.")
        if in_doubt(question) and self.last_answer is not None:
            return self._explained()
        subject = subject_of(self.last)
        if carries_over(question, subject):
            question = with_subject(question, self.last_question, subject)
        with stage("follow-up"):
            plan = follow_up(question, self.last, self.catalog)
        if plan is not None:
            return self._run(plan, "follow-up", None, question)
        with stage("grounding"):
            question, names = names_for_codes(question, self.catalog)
            if names:
                return self._offer(names, question, "The data have no company of exactly this name. Is this one meant?" if len(names) == 1 else "The data have several companies of nearly this name. Which is meant?")
            evidence = ground(question, self.catalog)
        cached = self.plans.get(self.catalog.version(), {}).get(plain(question))
        if cached:
            answer = self._run(Plan.from_dict(cached), "cache", evidence.day, question)
            if answer.kind == "rows":
                return answer
            # a plan that does not bind any more is made anew
            self.plans[self.catalog.version()].pop(plain(question), None)
        with stage("ambiguity"):
            ways = self._ways(evidence)
        if len(ways) > 1:
            return self._offer(ways, question, "This can be read in several ways." if len(ways) > 2 else "This can be read in two ways.")
        if ways and ways[0]["kind"] == "by":
            return self._pick(ways[0], ways, question)
        with stage("planning"):
            plan = simple_plan(evidence, self.catalog)
        if plan is not None:
            return self._run(plan, "plain", evidence.day, question)
        with stage("spelling"):
            meant = self._meant(question, evidence)
        if meant:
            return self._offer(meant, question, f"{meant[0]['word']!r} is no value that the tables have. Is one of these meant?")
        if self.model is None:
            return Answer("none", text="The question is not plain enough to plan without a model.")
        return self._by_model(question, evidence)

    def _by_model(self, question: str, evidence: Evidence) -> Answer:
        """A plan, else a query, else another question that the model offers."""
        rules = self.rules.rules() if self.rules else []
        try:
            with stage("model plan"):
                plan, compiled = model_plan(question, evidence, self.catalog, self.model, evidence.day, rules)
        except PlanError as refused:
            try:
                with stage("model query"):
                    return Answer("rows", model_sql(question, evidence, self.catalog, self.model, rules), None, "query")
            except PlanError:
                with stage("proposal"):
                    offer = proposed(question, self.catalog, self.model, str(refused))
                return self._offer([offer], question, offer["asks"]) if offer else Answer("none", text=str(refused))
        if compiled is None:
            return Answer("clarify", plan=plan, options=[], text=plan.clarification or "")
        self._keep(question, plan)
        return Answer("rows", compiled, plan, "model")

    def _ways(self, evidence: Evidence) -> list[dict]:
        """Readings to choose from: a value or a measure, own or converted amounts, columns of a value, snapshots."""
        ways = readings(evidence, self.catalog)
        for w in ways:
            w["label"] = f"only rows where {w['column']} is {w['value']}" if w["kind"] == "filter" else f"{w['column']} over all rows"
        m = GROUP_WORD.search(plain(evidence.question))
        group = next((c for t in self.catalog.tables.values() for c in t.columns if m and plain(c) == plain(m[1])), None)
        if len(ways) < 2 and group and set(tokens_of(evidence.question)) & set(AGGREGATIONS):
            ways = own_or_converted(evidence, self.catalog, group) or ways
        if len(ways) < 2 and not (ways and ways[0]["kind"] == "by"):
            ways = places_of(evidence) or ways
        return ways if len(ways) > 1 or ways and ways[0]["kind"] == "by" else self._snapshots(evidence) or ways

    def _snapshots(self, evidence: Evidence) -> list[dict]:
        """The days of tables that differ by their day only and fit the question best, if it names no day."""
        if evidence.day or evidence.years or not evidence.ranking or not set(tokens_of(evidence.question)) & set(AGGREGATIONS):
            return []
        top = [n for n, s in evidence.ranking if s > 0 and s == evidence.ranking[0][1]]
        days = sorted({self.catalog.tables[n].card.as_of for n in top} - {None})
        if len(top) < 2 or len(days) != len(top) or len(siblings(self.catalog, top)) != 1 or len(siblings(self.catalog, top)[0]) != len(top):
            return []
        shown = [".".join(reversed(d.split("-"))) for d in days]
        asked = evidence.question.rstrip("? ")
        return [{"kind": "question", "question": f"{asked} as at {d}", "label": f"the state on {d}"} for d in shown]

    def _meant(self, question: str, evidence: Evidence) -> list[dict]:
        """Stored values that a misspelt word or initials may mean, as questions with the value in its place."""
        explained = {w for h in evidence.hits if h.kind in ("whole", "contained") for w in tokens_of(h.norm)} | set(AGGREGATIONS)
        found = did_you_mean(question, self.catalog, ignored=explained) or [p for p in acronyms(question, self.catalog) if p[0] not in STOP | explained]
        first = [p for p in found if p[0] == found[0][0]]
        return [{"kind": "question", "word": w, "question": re.sub(rf"\b{re.escape(w)}\b", lambda _, v=v: v, question, count=1, flags=re.I), "label": v} for w, v in first]

    def _offer(self, ways: list[dict], question: str, text: str) -> Answer:
        self.pending, self.pending_question = ways, question
        return Answer("clarify", options=[w["label"] for w in ways], text=text)

    def _explained(self) -> Answer:
        """How the last answer came about, with no figure computed anew."""
        last = self.last_answer
        lines = [f"The last answer is to: {self.last_question}", "It was reached by these steps: " + "; ".join(last.compiled.explain), "Tables read: " + ", ".join(last.compiled.tables_used), *last.compiled.notes]
        return Answer("rows", last.compiled, last.plan, "explained", text="\n".join(lines))

    def _choice(self, reply: str) -> Answer | None:
        if not self.pending:
            return None
        ways, question = self.pending, self.pending_question
        m = re.fullmatch(r"\s*(\d+)\s*", reply)
        bare = lambda s: re.sub(r"\W+", "", plain(s))
        picked = ways[int(m[1]) - 1] if m and 1 <= int(m[1]) <= len(ways) else next((w for w in ways if bare(reply) and bare(reply) in (bare(w["label"]), bare(w.get("column", "")), bare(w.get("value", "")))), None)
        if picked is None and len(tokens_of(reply)) > 3 and not m:
            self.pending = []  # another question
            return None
        if picked is None and len(ways) == 1:  # a proposal that is not accepted
            self.pending = []
            return Answer("none", text="Then there is no answer to this question.")
        if picked is None:
            return Answer("clarify", options=[w["label"] for w in ways], text="Please choose one of these, by its number or its words.")
        self.pending = []
        return self._pick(picked, ways, question)

    def _pick(self, picked: dict, ways: list[dict], question: str) -> Answer:
        """The answer to a question in the reading that was chosen."""
        if picked["kind"] == "question":
            return self._ask(picked["question"])
        evidence = ground(question, self.catalog)
        fns = {AGGREGATIONS[w] for w in tokens_of(question) if w in AGGREGATIONS} or {"sum"}
        if picked["kind"] == "by":
            return self._run(Plan(table=picked["table"], group_by=[picked["group"]], aggregations=[Aggregation(sorted(fns)[0], picked["column"])]), "choice", evidence.day, question)
        if picked["kind"] == "measure":
            evidence.hits = [h for h in evidence.hits if h.display != picked["value"]]
            table = next(n for n, t in self.catalog.tables.items() if picked["column"] in t.columns)
            plan = Plan(table=table, aggregations=[Aggregation(sorted(fns)[0], picked["column"])])
            forbidden = next((w["column"] for w in ways if w["kind"] == "filter"), "")
            return self._run(without_column(plan, forbidden), "choice", evidence.day, question)
        if picked["kind"] == "place":
            evidence.hits = [h for h in evidence.hits if (h.table, h.column) == (picked["table"], picked["column"]) or h.display != picked["value"]]
        plan = simple_plan(evidence, self.catalog)
        if plan is None and self.model is not None:
            return self._by_model(question, evidence)
        return self._run(plan, "choice", evidence.day, question) if plan else Answer("none", text="The question is not plain enough to plan without a model.")

    def _run(self, plan: Plan, tier: str, day: date | None, question: str) -> Answer:
        try:
            with stage("binding"):
                compiled = compile_plan(plan, self.catalog, day)
        except PlanError as e:
            return Answer("none", plan=plan, tier=tier, text=str(e))
        self._keep(question, plan)
        return Answer("rows", compiled, plan, tier)

    def _keep(self, question: str, plan: Plan) -> None:
        self.last = plan
        version = self.catalog.version()
        self.plans.setdefault(version, {})[plain(question)] = plan.to_dict()
        for old in list(self.plans)[: -self.CACHED_VERSIONS]:
            del self.plans[old]
        if self.cache:
            with open(self.cache, "w", encoding="utf-8") as file:
                json.dump(self.plans, file, ensure_ascii=False, default=str)
