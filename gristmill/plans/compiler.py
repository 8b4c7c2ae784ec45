"""From a bound plan to a DataFrame. Literals stay literals: no text is ever executed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gristmill.catalog import Catalog
from gristmill.columns import IS_SUMMARY, ROW_ID, qcol, visible
from gristmill.operators import aggregates as A
from gristmill.operators import filters as P
from gristmill.operators import joins as J
from gristmill.operators import ordering as O
from gristmill.plans.binder import Binder, Bound
from gristmill.plans.ir import Compare, Plan, PlanError


@dataclass
class Compiled:
    """The lazy result with how it came about: ``steps`` are the frames after each step, in order."""

    df: DataFrame
    explain: list[str] = field(default_factory=list)
    tables_used: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    steps: list[tuple[str, DataFrame]] = field(default_factory=list)
    watches: list[tuple[str, Observation]] | None = None  # of each step, if they are watched
    again: Callable[[], Compiled] | None = None  # the same, watched

    def provenance(self) -> list[tuple[str, int]]:
        """Rows after every step, counted as the plan runs once: each step is watched where its rows pass.

        A watched plan is compiled apart, for what watches rows also keeps filters from the scan.
        """
        if self.again is None:
            return [(name, df.count()) for name, df in self.steps]
        watched = self.again()
        watched.df.write.format("noop").mode("overwrite").save()
        return [(name, o.get["n"]) for name, o in watched.watches or ()]


def compile_plan(plan: Plan | dict, catalog: Catalog, as_at: date | None = None, watched: bool = False) -> Compiled:
    """Bind and compile a plan; PlanError if it cannot be."""
    plan = Plan.from_dict(plan) if isinstance(plan, dict) else plan
    binder = Binder(catalog, as_at)
    if plan.compare is not None:
        return _compare(plan.compare, catalog, binder)
    bound = binder.bind(plan)
    out = Compiled(catalog.spark.range(0), tables_used=[bound.table], notes=list(bound.notes), watches=[] if watched else None)
    out.again = None if watched else lambda: compile_plan(plan, catalog, as_at, True)
    df = _step(out, "source", _source(bound, catalog, out))
    tables = [catalog.tables[n] for n in (bound.table, *bound.union)]
    totals = bool(bound.measures) and any(t.has_totals for t in tables)
    kept = lambda rows: rows.where(~F.col(IS_SUMMARY)) if totals else rows
    if totals:
        df = _step(out, "without totals", kept(df))
    # filters on the table's own columns come before the join, at the scan
    own = [f for f in bound.filters if not bound.union and f.column in tables[0].columns]
    for i, f in enumerate(own):
        # what is watched must pass step by step
        df = _step(out, _name(f), df.where(f.condition()) if watched else kept(tables[0].frame(own[: i + 1])))
    if bound.join:
        right, left_key, right_key = bound.join
        out.tables_used.append(right)
        df = _step(out, f"joined {right}", J.left_join(df, catalog.tables[right].df, left_key, right_key))
    for f in bound.filters:
        if f not in own:
            df = _step(out, _name(f), df.where(f.condition()))
    out.df = _step(out, "result", _summarise(df, bound) if bound.measures else _list(df, bound))
    return out


def _name(f: P.BoundFilter) -> str:
    return f"{f.column} {f.op if f.kind in ('number', 'date') else f.kind} {f.values}"


def _step(out: Compiled, name: str, df: DataFrame) -> DataFrame:
    if out.watches is not None:
        watch = Observation()
        df = df.observe(watch, F.count(F.lit(1)).alias("n"))
        out.watches.append((name, watch))
    out.explain.append(name)
    out.steps.append((name, df))
    return df


def _source(bound: Bound, catalog: Catalog, out: Compiled) -> DataFrame:
    base = catalog.tables[bound.table].df
    if not bound.union:
        return base
    tables = {n: catalog.tables[n].df for n in (bound.table, *bound.union)}
    out.tables_used += bound.union
    try:
        named = O.union_tagged({n: df.select(*[qcol(c) for c in visible(df)], F.col(ROW_ID).alias("rowid marker"), F.col(IS_SUMMARY).alias("summary marker")) for n, df in tables.items()})
    except ValueError as e:
        raise PlanError([("bad_union", str(e))]) from e
    order = F.struct(F.array_position(F.array(*[F.lit(n) for n in tables]), qcol("SOURCE")).alias("t"), qcol("rowid marker").alias("r"))
    return named.withColumns({ROW_ID: order, IS_SUMMARY: qcol("summary marker")}).drop("rowid marker", "summary marker")


def _summarise(df: DataFrame, bound: Bound) -> DataFrame:
    plan = bound.plan
    out = A.aggregate(df, bound.group_by, bound.measures)
    derived = {d.alias for d in plan.derived}
    out = A.having(out, [h for h in bound.having if h[0] not in derived])
    for d in plan.derived:
        if d.kind == "pct_of_total" and d.num in out.columns:
            out = A.pct_of_total(out, d.num, d.alias)
        elif d.kind == "ratio" and d.num in out.columns and d.den in out.columns:
            out = A.ratio(out, d.num, d.den, d.alias)
        else:
            bound.notes.append(f"the derived column {d.alias!r} was dropped")
    out = A.having(out, [h for h in bound.having if h[0] in derived and h[0] in out.columns])
    if bound.sort_by in out.columns:
        ties = [qcol(c).asc_nulls_last() for c in bound.group_by if c != bound.sort_by]
        key = qcol(bound.sort_by)
        out = out.orderBy(key.desc_nulls_last() if plan.sort.desc else key.asc_nulls_last(), *ties)
    elif plan.limit and bound.group_by:
        out = out.orderBy(*[qcol(c).asc_nulls_last() for c in bound.group_by])
    return out.limit(plan.limit) if plan.limit else out


def _list(df: DataFrame, bound: Bound) -> DataFrame:
    plan = bound.plan
    columns = bound.select or visible(df)
    out = O.distinct_listing(df, columns, bound.sort_by, plan.sort.desc if plan.sort else True)
    return out.limit(plan.limit) if plan.limit else out


def _compare(c: Compare, catalog: Catalog, binder: Binder) -> Compiled:
    sides = []
    for name, filters in ((c.left_table, c.left_filters), (c.right_table, c.right_filters)):
        table = catalog.resolve_table(name)
        if table is None:
            raise PlanError([("bad_table", f"there is no table {name!r}")])
        t = catalog.tables[table]
        key = binder.column(t.columns, c.key)
        measures = [binder.column(t.columns, m) for m in c.measures]
        if key is None or not measures or None in measures:
            raise PlanError([("bad_column", f"{table!r} lacks the key or a measure")])
        bound = [binder.filter(table, t.profile, f) for f in filters]
        if binder.issues:
            raise PlanError(binder.issues)
        rows = t.frame(bound)
        rows = rows.where(~F.col(IS_SUMMARY)) if t.has_totals else rows
        sides.append((table, rows.select(qcol(key).alias(c.key), *[qcol(m).alias(w) for m, w in zip(measures, c.measures)])))
    (left, a), (right, b) = sides
    labels = (c.left_label, c.right_label) if c.left_label != c.right_label else (f"{c.left_label}_1", f"{c.right_label}_2")
    df = J.compare_snapshots(a, b, c.key, c.measures, *labels)
    return Compiled(df, [f"compare {left} with {right}"], [left, right], list(binder.notes), [("result", df)])
