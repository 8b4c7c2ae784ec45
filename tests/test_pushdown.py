"""What plans read: filters reach the scan, columns nobody asked for do not, and missing numbers stay missing."""

from __future__ import annotations

import re

import pytest

from gristmill.catalog import Catalog
from gristmill.columns import IS_SUMMARY, ROW_ID
from gristmill.engine import Engine
from gristmill.plans.compiler import compile_plan


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("wide"))
    nan = float("nan")
    rows = [(i, float(i % 50) if i % 7 else nan, f"name {i % 5}", "O" if i % 2 else "F", i * 1.5) for i in range(400)]
    spark.createDataFrame(rows, "key long, quantity double, name string, status string, price double").coalesce(2).write.parquet(f"{where}/wide")
    out = Catalog(spark)
    out.add("wide", spark.read.parquet(f"{where}/wide"))
    return out


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pushed(df):
    return " ".join(re.findall(r"PushedFilters: \[([^\]]*)\]", plan_of(df)))


def read(df):
    return set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(df)))))


def test_a_listings_filter_reaches_the_scan(catalog):
    compiled = compile_plan({"table": "wide", "filters": [{"column": "key", "op": "eq", "value": 7}], "select": ["name"]}, catalog)
    assert "EqualTo(key,7)" in pushed(compiled.df) and read(compiled.df) == {"key", "name"}
    assert [tuple(r) for r in compiled.df.collect()] == [("name 2",)]


@pytest.mark.parametrize(
    ("op", "value", "found"),
    [("gt", 45, lambda q: q is not None and q > 45), ("ge", 45, lambda q: q is not None and q >= 45), ("le", 3, lambda q: q is not None and q <= 3), ("lt", 3, lambda q: q is not None and q < 3),
     ("eq", 9, lambda q: q == 9), ("ne", 9, lambda q: q != 9), ("between", [47, 49], lambda q: q is not None and 47 <= q <= 49), ("in", [1, 2], lambda q: q in (1, 2)), ("isnull", None, lambda q: q is None), ("notnull", None, lambda q: q is not None)],
)
def test_filters_on_doubles(catalog, op, value, found):
    """Each operation by its definition, a NaN being a missing value; comparisons reach the scan."""
    compiled = compile_plan({"table": "wide", "filters": [{"column": "quantity", "op": op, "value": value}], "aggregations": [{"fn": "count", "alias": "n"}, {"fn": "sum", "column": "price", "alias": "s"}]}, catalog)
    quantities = {i: float(i % 50) if i % 7 else None for i in range(400)}
    keys = [i for i, q in quantities.items() if found(q)]
    assert tuple(compiled.df.first()) == (len(keys), sum(keys) * 1.5)
    if op not in ("isnull", "notnull", "ne"):
        assert "(quantity," in pushed(compiled.df)
    assert read(compiled.df) == {"quantity", "price"}  # no text column is read for totals that are not there


def test_provenance_with_filters_before_a_join(spark):
    out = Catalog(spark)
    out.add("a", spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "k long, v double"))
    out.add("b", spark.createDataFrame([(i, f"n{i}") for i in range(1, 8)], "k long, n string"))
    out.discover_links({"a": ["k"], "b": ["k"]})
    plan = {"table": "a", "join": {"right_table": "b", "left_column": "k", "right_column": "k"}, "filters": [{"column": "n", "op": "in", "value": ["n2", "n3"]}, {"column": "v", "op": "gt", "value": 5}], "select": ["n"]}
    compiled = compile_plan(plan, out)
    assert [n for _, n in compiled.provenance()] == [3, 3, 3, 2, 2] and sorted(r[0] for r in compiled.df.collect()) == ["n2", "n3"]


def test_stored_tables_keep_row_numbers_totals_and_values(spark, tmp_path):
    engine = Engine(spark)
    engine.add("t", spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("Total", 1.0)], "name string, v double").coalesce(1))
    engine.save(str(tmp_path / "s"))
    again = Engine(spark)
    again.open(str(tmp_path / "s"))
    table = again.catalog.tables["t"]
    assert {ROW_ID, IS_SUMMARY} <= set(table.raw.columns) and table.columns == ["name", "v"] and table.has_totals
    total = compile_plan({"table": "t", "aggregations": [{"fn": "sum", "column": "v", "alias": "s"}]}, again.catalog)
    assert total.df.first()["s"] == 1.0 and read(total.df) == {"v", IS_SUMMARY}  # the mark is read, not matched anew
    assert {r["norm"] for r in again.catalog.index().collect()} == {"a", "b"}
    assert "Scan parquet" in plan_of(again.catalog.index())


def test_the_value_index_is_counted_once(spark):
    out = Catalog(spark)
    out.add("t", spark.createDataFrame([("x y",), ("z",)], "name string"))
    first = out.index()
    assert out.index()._jdf.queryExecution().logical().toString() == first._jdf.queryExecution().logical().toString()
    assert "Exchange" not in plan_of(first)
    out.add("u", spark.createDataFrame([("w",)], "name string"))
    assert {(r["table"], r["norm"]) for r in out.index().collect()} == {("t", "x y"), ("t", "z"), ("u", "w")}
    out.add("t", spark.createDataFrame([("new",)], "name string"))
    assert {r["norm"] for r in out.index().collect()} == {"new", "w"}
