"""Null rules of filters, joins, sorts and listings on small frames with gaps."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gristmill.columns import ROW_ID, nan_to_null, qcol
from gristmill.operators import aggregates as A
from gristmill.operators import filters as P
from gristmill.operators import joins as J
from gristmill.operators import ordering as O


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, " EUR ", 10.0, "12"), (2, "USD", None, "x"), (3, None, 30.0, None), (4, "eur", -5.0, "7.5")]
    return spark.createDataFrame(data, "id int, cur string, amount double, txt string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        (lambda: P.text_in(qcol("cur"), ["EUR"]), [1]),
        (lambda: P.text_not_in(qcol("cur"), ["EUR"]), [2, 3, 4]),
        (lambda: P.contains(qcol("cur"), "eU"), [1, 4]),
        (lambda: P.compare_number(qcol("amount"), "ne", 10), [2, 3, 4]),
        (lambda: P.compare_number(qcol("amount"), "gt", -6), [1, 3, 4]),
        (lambda: P.compare_number(qcol("txt"), "le", 12), [1, 4]),
        (lambda: P.number_in(qcol("txt"), [7.5, 12]), [1, 4]),
        (lambda: P.number_between(qcol("amount"), -5, 10), [1, 4]),
    ],
)
def test_null_rules(rows, condition, want):
    assert ids(rows.where(condition())) == want


def test_interval_keeps_open_ends(spark):
    d = datetime
    data = [(1, d(2020, 1, 1), None), (2, d(2020, 1, 1), d(2021, 1, 1)), (3, d(2022, 1, 1), None), (4, None, None)]
    df = spark.createDataFrame(data, "id int, Start_date timestamp_ntz, End_date timestamp_ntz")
    assert ids(P.filter_as_at(df, "2020-06-30")) == [1, 2]
    assert ids(P.filter_as_at(df, "2021-06-30")) == [1]
    assert P.filter_as_at(df.drop("End_date"), "2020-01-01").count() == 4


def test_year_is_a_range_that_a_scan_can_use(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT id, timestamp_ntz'1996-12-31 23:59:59' + make_dt_interval(0, 0, 0, id) AS at FROM range(3)").write.parquet(path)
    found = spark.read.parquet(path).where(P.in_year(qcol("at"), 1997))
    assert ids(found) == [1, 2]
    text = spark.sql("SELECT string(id) AS t, id AS n FROM range(3)")
    text.write.parquet(path + "2")
    pushed = spark.read.parquet(path + "2").where(P.text_in(qcol("t"), ["1"], exact=True) & P.compare_number(qcol("n"), "ge", 1, text=False))
    shown = pushed._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(t,1)" in shown and "GreaterThanOrEqual(n,1)" in shown
    assert "GreaterThanOrEqual(at" in found._jdf.queryExecution().executedPlan().toString()


def test_totals_in_two_languages(spark):
    data = [(1, "Total"), (2, "Γενικό Σύνολο"), (3, "Sub total of a"), (4, "totally"), (5, "A  total"), (6, None), (7, "sum " + "x" * 50)]
    df = spark.createDataFrame(data, "id int, name string")
    assert ids(df.where(P.is_summary_row(df))) == [1, 2, 5]


def test_missing_keys_match_in_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, id int")
    got = sorted(map(tuple, J.left_join(left, right, "k", "k").collect()))
    assert got == [(1, "a", 10), (2, None, 20), (3, "z", None)]
    assert J.left_join(left, right, "k", "k").columns == ["id", "k", "id__right"]
    assert J.inner_join(left, right, "k", "k").count() == 2


def test_compare_sums_text_and_marks_sides(spark):
    a = spark.createDataFrame([("x", "1"), ("x", "2"), (None, "5"), ("gone", "0")], "k string, m string")
    b = spark.createDataFrame([("x", "6"), (None, "4"), ("new", "9")], "k string, m string")
    got = {r["k"]: tuple(r)[1:] for r in J.compare_snapshots(a, b, "k", ["m"], "old", "now").collect()}
    assert got == {"x": (3.0, 6.0, 3.0, 100.0, "both"), None: (5.0, 4.0, -1.0, -20.0, "both"), "gone": (0.0, 0.0, 0.0, None, "gone"), "new": (0.0, 9.0, 9.0, None, "new")}


def test_upsert_replaces_whole_sources(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "source string, v int")
    new = spark.createDataFrame([("a", 9)], "source string, v int")
    assert sorted(r["v"] for r in J.upsert_by_source(old, new).collect()) == [2, 3, 9]


def test_listing_is_distinct_in_order_of_an_unselected_key(spark):
    data = [("b", 1.0, 0), ("a", 5.0, 1), ("b", 9.0, 2), ("c", None, 3), ("d", 5.0, 4)]
    df = spark.createDataFrame(data, f"name string, v double, {ROW_ID} long").repartition(3)
    assert [r[0] for r in O.distinct_listing(df, ["name"], "v").collect()] == ["b", "a", "d", "c"]
    assert [r[0] for r in O.distinct_listing(df, ["name"], "v", descending=False).collect()] == ["b", "a", "d", "c"]
    assert [r[0] for r in O.distinct_listing(df, ["name"]).collect()] == ["b", "a", "c", "d"]
    assert [r["name"] for r in O.sort_rows(df, "v", descending=False).collect()][-1] == "c"


def test_sum_of_nothing_is_zero_and_division_by_zero_is_null(spark):
    df = spark.createDataFrame([("a", None), ("b", 0.0), ("b", 4.0)], "k string, v double")
    out = {r["k"]: r["s"] for r in A.aggregate(df, ["k"], [A.Measure("sum", "v", "s")]).collect()}
    assert out == {"a": 0.0, "b": 4.0}
    shares = A.pct_of_total(A.aggregate(df.where("k = 'a'"), ["k"], [A.Measure("sum", "v", "s")]), "s", "p").first()
    assert shares["p"] is None


def test_nan_is_missing(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "v double"))
    assert df.agg(F.sum("v")).first()[0] == 1.0


def test_union_needs_common_columns(spark):
    a = spark.createDataFrame([(1, 2, 3)], "`Net Amount` int, code int, x int")
    b = spark.createDataFrame([(5, 6)], "NET_AMOUNT int, CODE int")
    got = O.union_tagged({"a": a, "b": b})
    assert got.columns == ["Net Amount", "code", "x", "SOURCE"] and got.count() == 2
    with pytest.raises(ValueError, match="too few"):
        O.union_tagged({"a": a, "c": spark.createDataFrame([(1,)], "other int")})


def test_years_unpivot_and_back(spark):
    wide = spark.createDataFrame([("x", "1", None), ("y", "2", "3")], "name string, `2022 Rev` string, `Rev 2023` string")
    long = O.unpivot_years(wide)
    assert sorted(map(tuple, long.collect()), key=str) == [("x", 2022, "Rev", 1.0), ("x", 2023, "Rev", None), ("y", 2022, "Rev", 2.0), ("y", 2023, "Rev", 3.0)]
    back = A.pivot_sum(long, "name", "YEAR", "VALUE", [2022, 2023])
    assert sorted(map(tuple, back.collect())) == [("x", 1.0, 0.0), ("y", 2.0, 3.0)]
