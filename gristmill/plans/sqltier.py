"""Guarded SQL for what the plan grammar cannot say: windows, cubes, set operations, subqueries.

The text is parsed, not run, and only query nodes over registered tables pass. Nothing
that writes, defines, loads, reads a path or calls into the JVM is let through.
"""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.catalog import Catalog
from gristmill.columns import qcol
from gristmill.functions.text import plain
from gristmill.plans.binder import Binder
from gristmill.plans.ir import PlanError

# Logical plan nodes of a query, as the parser names them.
NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Join Window SubqueryAlias UnresolvedRelation UnresolvedWith CTERelationRef "
    "UnresolvedSubqueryColumnAliases OneRowRelation UnresolvedInlineTable InlineTable LocalRelation Generate Unpivot Pivot UnresolvedHaving WithWindowDefinition LateralJoin "
    "Sample Tail UnresolvedUnpivot UnresolvedOrderBy AsOfJoin".split()
)
# Functions that reach outside the query's tables.
FUNCTIONS = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length read_files raise_error assert_true current_user user session_user current_database current_catalog".split())


class SqlRefused(PlanError):
    def __init__(self, message: str):
        super().__init__([("sql", message)])


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _check(plan, names: set[str], defined: set[str]) -> None:
    kind = plan.getClass().getSimpleName()
    if kind not in NODES:
        raise SqlRefused(f"{kind} is not part of a query")
    if kind == "UnresolvedWith":
        pairs = _items(plan.cteRelations())
        inner = defined | {p._1() for p in pairs}
        for p in pairs:
            _check(p._2(), names, inner)
        defined = inner
    if kind == "UnresolvedRelation":
        parts = _items(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0] not in names | defined:
            raise SqlRefused(f"there is no table {'.'.join(parts)}")
    for e in _items(plan.expressions()):
        _check_expression(e, names, defined)
    for child in _items(plan.children()):
        _check(child, names, defined)


def _check_expression(e, names: set[str], defined: set[str]) -> None:
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        called = [p.lower() for p in _items(e.nameParts())]
        if len(called) != 1 or called[0] in FUNCTIONS:
            raise SqlRefused(f"the function {'.'.join(called)} is not allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression", "InSubquery") and hasattr(e, "plan"):
        try:
            inner = e.plan()
        except Exception:  # noqa: BLE001  an expression without a plan of its own
            inner = None
        if inner is not None:
            _check(inner, names, defined)
    for child in _items(e.children()):
        _check_expression(child, names, defined)


def spell_literals(catalog: Catalog, text: str) -> tuple[str, list[str]]:
    """The query with its text literals in the spelling that the tables have, and what was changed.

    A literal changes only if it is a stored value in another spelling, and only into the
    one such value; literals of no value stay, for they may be patterns.
    """
    wanted = {plain(m) for m in re.findall(r"'([^']+)'", text)}
    if not wanted:
        return text, []
    stored: dict[str, set[str]] = {}
    for r in catalog.index().where(F.col("norm").isin(*sorted(wanted))).select("norm", "display").distinct().collect():
        stored.setdefault(r["norm"], set()).add(r["display"])
    notes: list[str] = []

    def spell(m: re.Match) -> str:
        known = stored.get(plain(m[1]), set())
        if len(known) != 1 or m[1] in known:
            return m[0]
        (value,) = known
        notes.append(f"{m[1]!r} was read as {value!r}")
        return "'" + value.replace("'", "''") + "'"

    return re.sub(r"'([^']+)'", spell, text), notes


def view_name(table: str) -> str:
    """A name that needs no quotes: letters, digits and underscores."""
    plain = re.sub(r"\W+", "_", table).strip("_")
    return f"t_{plain}" if not plain or plain[0].isdigit() else plain


ATTEMPTS = 3


def run_sql(catalog: Catalog, text: str, notes: list[str] | None = None) -> DataFrame:
    """The rows of a query over the catalogue's tables, by their names or ``view_name``.

    SqlRefused for anything but one query. A column that the query misspells is read as the
    one column of its tables that it resembles, which is noted; Spark's own error, with the
    nearest names, stands where there is none.
    """
    spark = catalog.spark
    views = {}
    for name, table in catalog.tables.items():
        views[name] = views[view_name(name)] = table
    for attempt in range(ATTEMPTS):
        try:
            parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        except Exception as e:  # noqa: BLE001
            raise SqlRefused(f"not readable as SQL: {str(e).splitlines()[0]}") from e
        _check(parsed, set(views), set())
        used = _mentioned(parsed) & set(views)
        for name in used:
            table = views[name]
            table.df.select(*[qcol(c) for c in table.columns]).createOrReplaceTempView("`" + name.replace("`", "``") + "`")
        try:
            return spark.sql(text)
        except AnalysisException as e:
            wanted = (e.getMessageParameters() or {}).get("objectName", "") if "UNRESOLVED_COLUMN" in (e.getCondition() or "") else ""
            asked = wanted.strip("`").split("`.`")[-1]
            columns = list(dict.fromkeys(c for name in used for c in views[name].columns))
            meant = Binder(catalog).column(columns, asked) if asked else None
            if meant is None or meant == asked or attempt == ATTEMPTS - 1:
                raise
            text = re.sub(rf"`{re.escape(asked)}`|(?<![\w`']){re.escape(asked)}(?![\w`'])", lambda _: "`" + meant.replace("`", "``") + "`", text)
            if notes is not None:
                notes.append(f"{asked!r} was read as {meant!r}")
    raise AssertionError("unreachable")


def tables_of(catalog: Catalog, text: str) -> list[str]:
    """The tables that a query reads, by their own names."""
    names = _mentioned(catalog.spark._jsparkSession.sessionState().sqlParser().parsePlan(text))
    return [n for n in catalog.tables if n in names or view_name(n) in names]


def _mentioned(plan) -> set[str]:
    return set(re.findall(r"UnresolvedRelation \[([^\]]+)\]", plan.toString()))


class TimeLimit:
    """Cancels the jobs started inside after ``seconds``, and every later one, until it is left; other threads' jobs go on.

    ``expired`` tells whether that happened.
    """

    AGAIN = 0.2  # seconds after which jobs that began since are cancelled too

    def __init__(self, catalog: Catalog, seconds: float):
        self.context, self.seconds, self.tag = catalog.spark.sparkContext, seconds, f"gristmill-{uuid.uuid4().hex}"
        self.expired = False
        self.left = threading.Event()

    def __enter__(self) -> TimeLimit:
        self.context.addJobTag(self.tag)
        self.watch = threading.Thread(target=self._watch, daemon=True)
        self.watch.start()
        return self

    def _watch(self) -> None:
        wait = self.seconds
        while not self.left.wait(wait):
            self.expired, wait = True, self.AGAIN
            self.context.cancelJobsWithTag(self.tag)

    def __exit__(self, *_) -> None:
        self.left.set()
        self.watch.join()
        self.context.removeJobTag(self.tag)
