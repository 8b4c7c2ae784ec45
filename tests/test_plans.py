"""Plans: binding, values, joins over verified keys, SQL, questions."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gristmill.ask.grounding import as_at_day
from gristmill.ask.planner import Conversation
from gristmill.catalog import Card, Catalog, Relationship, unit_of
from gristmill.engine import Engine, as_html, as_text, condensed
from gristmill.plans.compiler import compile_plan
from gristmill.plans.ir import Plan, PlanError
from gristmill.operators.retrieval import embed
from gristmill.plans.sqltier import SqlRefused, run_sql, spell_literals, view_name


@pytest.fixture(scope="module")
def catalog(spark):
    out = Catalog(spark)
    money = [("NORDIC TRADE", "EUR", 100.0, "1,5"), ("NORDIC TRADE", "USD", 50.0, "2"), ("SOUTHERN FOODS", "EUR", 25.0, None), ("Total", None, 175.0, None)]
    out.add("book.xlsx:MATRIX", spark.createDataFrame(money, "COMPANY string, CURRENCY string, `AMOUNT EURO` double, NOTE string").coalesce(1))
    people = [("Smith,Anna", "NORDIC TRADE", "CY01", datetime(2020, 1, 1), None), ("Jones,Bo", "SOUTHERN FOODS", "CY02", datetime(2019, 1, 1), datetime(2021, 6, 30)), ("Smith,Anna", "SOUTHERN FOODS", "CY02", datetime(2022, 1, 1), None)]
    out.add("book.xlsx:CY05", spark.createDataFrame(people, "DIRECTOR_NAME string, COMPANY_NAME string, COMPANY_CODE string, Start_date timestamp_ntz, End_date timestamp_ntz").coalesce(1))
    out.add("book.xlsx:YEARS", spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, None)], "UNIT string, `2022 SALES` double, `2023 SALES` double").coalesce(1))
    return out


def rows(plan, catalog, **more):
    return [tuple(r) for r in compile_plan(plan, catalog, **more).df.collect()]


def test_totals_stay_out_of_sums_but_not_of_listings(catalog):
    plan = {"table": "MATRIX", "group_by": ["company"], "aggregations": [{"fn": "sum", "column": "AMOUNT EURO", "alias": "s"}], "sort": {"by": "s"}}
    assert rows(plan, catalog) == [("NORDIC TRADE", 150.0), ("SOUTHERN FOODS", 25.0)]
    assert len(rows({"table": "MATRIX", "select": ["COMPANY"]}, catalog)) == 3


def test_values_are_found_in_any_spelling(catalog):
    count = lambda f: rows({"table": "CY05", "filters": [f], "aggregations": [{"fn": "count"}]}, catalog)
    assert count({"column": "DIRECTOR_NAME", "op": "match", "value": "anna smith"}) == [(2,)]
    assert count({"column": "DIRECTOR_NAME", "op": "match", "value": "Ana Smth"}) == [(2,)]
    assert count({"column": "DIRECTOR_NAME", "op": "eq", "value": "Nordic Trade"}) == [(1,)]  # rebound to its own column
    assert count({"column": "COMPANY_NAME", "op": "in", "value": ["southern foods", "nobody"]}) == [(2,)]
    with pytest.raises(PlanError, match="no value"):
        count({"column": "DIRECTOR_NAME", "op": "match", "value": "qqqq zzzz"})


def test_code_comes_with_the_name(catalog):
    assert compile_plan({"table": "CY05", "select": ["COMPANY_NAME"]}, catalog).df.columns == ["COMPANY_CODE", "COMPANY_NAME"]


def test_literals_are_never_code(catalog):
    plan = {"table": "MATRIX", "filters": [{"column": "COMPANY", "op": "contains", "value": "'); DROP TABLE x; --"}], "select": ["COMPANY"]}
    assert rows(plan, catalog) == []


@pytest.mark.parametrize(
    ("plan", "kind"),
    [
        ({"table": "nothing", "select": ["a"]}, "bad_table"),
        ({"table": "MATRIX"}, "empty"),
        ({"table": "MATRIX", "select": ["no such column"]}, "bad_column"),
        ({"table": "MATRIX", "aggregations": [{"fn": "wish", "column": "AMOUNT EURO"}]}, "bad_agg"),
        ({"table": "MATRIX", "aggregations": [{"fn": "sum", "column": "COMPANY"}]}, "bad_agg"),
        ({"table": "MATRIX", "filters": [{"column": "COMPANY", "op": "gt", "value": 3}], "select": ["COMPANY"]}, "bad_op"),
    ],
)
def test_refused_plans_say_why(catalog, plan, kind):
    with pytest.raises(PlanError) as e:
        compile_plan(plan, catalog)
    assert kind in [k for k, _ in e.value.issues]


def test_validity_is_mended(catalog):
    plan = {"table": "CY05", "filters": [{"column": "End_date", "op": "le", "value": "2020-12-31"}], "aggregations": [{"fn": "count"}]}
    assert rows(plan, catalog) == [(2,)]
    assert rows({"table": "CY05", "aggregations": [{"fn": "count"}], "filters": [{"column": "COMPANY_CODE", "op": "notnull"}]}, catalog, as_at=datetime(2022, 5, 1)) == [(2,)]


def test_years_have_a_long_view(catalog):
    plan = {"table": "book.xlsx:YEARS#long", "group_by": ["YEAR"], "aggregations": [{"fn": "sum", "column": "VALUE", "alias": "v"}], "sort": {"by": "YEAR", "desc": False}}
    assert rows(plan, catalog) == [(2022, 4.0), (2023, 2.0)]


def test_joins_need_a_verified_key(catalog):
    plan = {"table": "MATRIX", "join": {"right_table": "CY05", "left_column": "COMPANY", "right_column": "COMPANY_NAME"}, "select": ["COMPANY"]}
    compiled = compile_plan(plan, catalog)
    assert compiled.tables_used == ["book.xlsx:MATRIX"] and any("dropped" in n for n in compiled.notes)


def test_having_applies_without_groups(catalog):
    plan = {"table": "MATRIX", "aggregations": [{"fn": "sum", "column": "AMOUNT EURO", "alias": "s"}], "having": [{"column": "s", "op": "gt", "value": 1000}]}
    assert rows(plan, catalog) == []


def test_union_leaves_out_totals_of_all_tables(catalog, spark):
    more = spark.createDataFrame([("X", "EUR", 1.0, None), ("Grand Total", None, 1.0, None)], "COMPANY string, CURRENCY string, `Amount Euro` double, NOTE string")
    catalog.add("next.xlsx:MATRIX2", more)
    plan = {"table": "book.xlsx:MATRIX", "union": ["MATRIX2"], "group_by": ["SOURCE"], "aggregations": [{"fn": "sum", "column": "AMOUNT EURO", "alias": "s"}]}
    assert sorted(rows(plan, catalog)) == [("book.xlsx:MATRIX", 175.0), ("next.xlsx:MATRIX2", 1.0)]
    catalog.remove("next.xlsx:MATRIX2")


def test_plans_survive_bad_shapes():
    plan = Plan.from_dict({"table": 3, "filters": "x", "sort": ["v"], "limit": "many", "join": {}, "group_by": "a", "having": [1]})
    assert (plan.filters, plan.limit, plan.join, plan.group_by, plan.sort.by) == ([], None, None, ["a"], "v")


def test_provenance_counts_every_step(catalog):
    plan = {"table": "MATRIX", "filters": [{"column": "CURRENCY", "op": "eq", "value": "EUR"}], "aggregations": [{"fn": "count"}]}
    assert [n for _, n in compile_plan(plan, catalog).provenance()] == [4, 3, 2, 1]


GOOD_SQL = [
    "SELECT CURRENCY, sum(`AMOUNT EURO`) OVER (PARTITION BY CURRENCY) AS s FROM book_xlsx_MATRIX",
    "WITH a AS (SELECT COMPANY FROM book_xlsx_MATRIX) SELECT * FROM a WHERE COMPANY IN (SELECT COMPANY_NAME FROM book_xlsx_CY05)",
    "SELECT COMPANY FROM `book.xlsx:MATRIX` EXCEPT SELECT COMPANY_NAME FROM book_xlsx_CY05",
    "SELECT COMPANY, CURRENCY, count(*) FROM book_xlsx_MATRIX GROUP BY CUBE (COMPANY, CURRENCY) ORDER BY 1 LIMIT 3",
]
BAD_SQL = [
    "DROP TABLE book_xlsx_MATRIX", "CREATE TABLE x AS SELECT 1", "INSERT INTO book_xlsx_MATRIX SELECT * FROM book_xlsx_MATRIX", "SELECT * FROM parquet.`/etc`", "SELECT reflect('java.lang.System', 'exit', 0)",
    "SELECT * FROM unknown_table", "SELECT 1 WHERE EXISTS (SELECT java_method('java.lang.Runtime', 'x'))", "SET a = b", "SELECT (SELECT count(*) FROM csv.`/tmp/x`)", "not sql at all",
]


@pytest.mark.parametrize("text", GOOD_SQL)
def test_queries_pass_the_guard(catalog, text):
    assert run_sql(catalog, text).count() > 0


@pytest.mark.parametrize("text", BAD_SQL)
def test_other_statements_do_not(catalog, text):
    with pytest.raises(SqlRefused):
        run_sql(catalog, text)


def test_units_of_column_names():
    units = {f"AMOUNT {u}": u for u in ("EUR", "USD", "GBP", "CHF", "RON", "HUF", "PLN", "CZK", "BGN")}
    units |= {"AMOUNTEUR": "EUR", "total_usd": "USD", "Percent paid": "%", "RATE %": "%", "Ποσοστό": "%", "EUR total": "EUR", "AMOUNT JPY": None, "NAME": None, "European": None}
    assert {name: unit_of(name) for name in units} == units


def test_view_names():
    assert view_name("a b.xlsx:S#2") == "a_b_xlsx_S_2" and view_name("2023") == "t_2023"


def test_days_in_questions():
    assert str(as_at_day("loans as at 31.12.2023")) == "2023-12-31"
    assert str(as_at_day("balance at the end of february 2024")) == "2024-02-29"
    assert as_at_day("sales of 2023") is None and as_at_day("as at 45.99.2023") is None


def test_plain_questions_and_follow_ups(catalog):
    talk = Conversation(catalog)
    first = talk.ask("total amount euro for usd")
    assert first.kind == "rows" and first.tier == "plain" and first.compiled.df.first()[0] == 50.0
    then = talk.ask("and eur")
    assert then.tier == "follow-up" and then.compiled.df.first()[0] == 125.0
    by = talk.ask("now by company")
    assert by.tier == "follow-up" and by.compiled.df.columns[0] == "COMPANY"
    assert talk.ask("total amount euro for usd").tier == "cache"
    both = talk.ask("total amount euro for nordic trade")  # the value stands in two tables
    assert both.kind == "clarify" and len(both.options) == 2
    assert talk.ask(next(o for o in both.options if "MATRIX" in o)).compiled.df.first()[0] == 150.0
    assert talk.ask("compare the fortunes of nations").kind == "none"


def test_a_value_in_a_measures_name_is_asked_about(catalog):
    talk = Conversation(catalog)
    asked = talk.ask("total amount in EUR")
    assert asked.kind == "clarify" and len(asked.options) == 2
    assert talk.ask("2").compiled.df.first()[0] == 175.0


def test_a_model_mends_its_plan_once(catalog):
    replies = iter(['{"table": "MATRIX", "select": ["nope"]}', 'so: ```json\n{"table": "MATRIX", "aggregations": [{"fn": "max", "column": "AMOUNT EURO", "alias": "m"}]}\n```'])
    seen = []

    def model(messages):
        seen.append(messages[-1]["content"])
        return next(replies)

    answer = Conversation(catalog, model).ask("what is the share of the very greatest one")
    assert answer.tier == "model" and answer.compiled.df.first()["m"] == 100.0 and "nope" in seen[1]


def test_engine_saves_and_opens(spark, catalog, tmp_path):
    engine = Engine(spark)
    engine.add("b:M", catalog.tables["book.xlsx:MATRIX"].df.drop("__row_id", "__is_summary"))
    assert engine.catalog.tables["b:M"].profile["AMOUNT EURO"].role == "measure"
    engine.save(str(tmp_path / "store"))
    again = Engine(spark)
    assert again.open(str(tmp_path / "store")) == ["b:M"] and "profile" in again.catalog.tables["b:M"].__dict__
    assert {"inventory", "b:M: overview", "b:M: figures", "b:M: by category"} <= set(again.reports())
    assert again.reports()["b:M: by category"]().count() > 0
    assert not Catalog(spark).load_metadata(str(tmp_path / "missing.json"))
    assert "COMPANY" in as_text(again.sql("SELECT * FROM b_M")) and "<td>EUR</td>" in as_html(again.sql("SELECT CURRENCY FROM b_M"))


def test_results_are_condensed(spark):
    df = spark.createDataFrame([("a", 1, "EUR")] * 15 + [("b", 2, "EUR")] * 15, "x string, y int, unit string")
    shown, constants = condensed(df)
    assert constants == {"unit": "EUR", "count": "15"} or constants == {"unit": "EUR"}
    assert shown.count() == 2


def test_snapshots_need_no_filter_on_their_day(spark):
    tables = Catalog(spark)
    rows_ = spark.createDataFrame([("a", datetime(2023, 12, 31)), ("b", datetime(2023, 12, 31))], "NAME string, CALC_DATE timestamp_ntz")
    tables.add("s", rows_, Card(as_of="2023-12-31"))
    plan = {"table": "s", "filters": [{"column": "CALC_DATE", "op": "eq", "value": "31.12.2023"}], "select": ["NAME"]}
    compiled = compile_plan(plan, tables)
    assert compiled.df.count() == 2 and any("dropped" in n for n in compiled.notes)
    other = compile_plan(plan, tables, datetime(2022, 12, 31))
    assert any("not on 2022-12-31" in n for n in other.notes)


def test_codes_join_groups_only_one_to_one(catalog):
    grouped = compile_plan({"table": "CY05", "group_by": ["COMPANY_NAME"], "aggregations": [{"fn": "count"}]}, catalog)
    assert grouped.df.columns[:2] == ["COMPANY_CODE", "COMPANY_NAME"]


def test_sql_literals_are_spelled_as_stored(catalog):
    text, notes = spell_literals(catalog, "SELECT * FROM book_xlsx_MATRIX WHERE COMPANY = 'nordic trade' AND CURRENCY LIKE 'e%'")
    assert "'NORDIC TRADE'" in text and "'e%'" in text and len(notes) == 1
    assert run_sql(catalog, text.replace("LIKE 'e%'", "IS NOT NULL")).count() == 2


def test_charts_and_embeddings(spark, catalog):
    engine = Engine(spark)
    engine.catalog = catalog
    made = engine.chart({"table": "MATRIX", "group_by": ["COMPANY"], "aggregations": [{"fn": "sum", "column": "AMOUNT EURO", "alias": "s"}]}, most=1)
    assert sorted(map(tuple, made["data"].collect())) == [("NORDIC TRADE", 150.0), ("Other", 25.0)] and made["kind"] == "bar"
    chunks = spark.createDataFrame([("f", "abc"), ("g", None)], "source string, chunk string")
    got = embed(chunks, lambda texts: [[3.0, 4.0 * len(t)] for t in texts], batch=1).collect()
    assert got[0]["embedding"][0] == pytest.approx(3 / (9 + 28**2) ** 0.5)


def test_provenance_is_counted_in_one_run(spark, monkeypatch):
    """The counts of a watched run are those of counting each step by itself, with joins, totals, medians and limits."""
    from pyspark.sql import DataFrame

    catalog = Catalog(spark)
    catalog.add("a", spark.createDataFrame([(i % 7, i, float(i % 5), "Total" if i == 3 else "x") for i in range(50)], "K int, N int, V double, LABEL string"))
    catalog.add("b", spark.createDataFrame([(i, f"n{i}") for i in range(5)], "K int, NAME string"))
    catalog.links = [Relationship("a", "K", "b", "K", 1.0)]
    plans = [
        {"table": "a", "filters": [{"column": "V", "op": "ge", "value": 2}, {"column": "N", "op": "lt", "value": 40}], "select": ["K"], "limit": 3},
        {"table": "a", "join": {"right_table": "b", "left_column": "K", "right_column": "K"}, "filters": [{"column": "NAME", "op": "ne", "value": "n1"}], "group_by": ["NAME"], "aggregations": [{"fn": "median", "column": "V", "alias": "m"}]},
        {"table": "a", "filters": [{"column": "N", "op": "gt", "value": 1000}], "aggregations": [{"fn": "sum", "column": "V", "alias": "t"}]},
    ]
    for plan in plans:
        compiled = compile_plan(plan, catalog)
        want = [(name, df.count()) for name, df in compiled.steps]
        with monkeypatch.context() as m:
            m.setattr(DataFrame, "count", lambda self: pytest.fail("no step is counted by itself"))
            got = compiled.provenance()
        assert got == want


def test_keys_of_many_values_are_verified_too(spark):
    """Links of named columns do not end at the number of values up to which keys are looked for in a report."""
    from gristmill.operators.profiling import MOST_DISTINCT

    n = MOST_DISTINCT + 1000
    tables = Catalog(spark)
    tables.add("people", spark.range(n).select(F.col("id").alias("person"), (F.col("id") % 2).cast("string").alias("side")))
    tables.add("sales", spark.range(2 * n).select((F.col("id") % n).alias("buyer"), F.lit(1.0).alias("paid")))
    tables.discover_links({"people": ["person"], "sales": ["buyer"]})
    assert tables.linked("sales", "buyer", "people", "person")
    plan = {"table": "sales", "join": {"right_table": "people", "left_column": "buyer", "right_column": "person"}, "group_by": ["side"], "aggregations": [{"fn": "sum", "column": "paid", "alias": "s"}], "sort": {"by": "side", "desc": False}}
    assert rows(plan, tables) == [("0", float(n)), ("1", float(n))]
