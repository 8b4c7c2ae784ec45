"""Questions through the engine: spelling, hints, routes, readings, snapshots, models, rules, cached plans."""

from __future__ import annotations

import json
from datetime import datetime

import pytest

from gristmill.ask import continuity as C
from gristmill.ask.cards import build_cards, localised, schema_hash
from gristmill.catalog import Card, Catalog
from gristmill.engine import Engine
from gristmill.plans.ir import Filter, Plan, PlanError
from gristmill.plans.sqltier import run_sql
from gristmill.server import Service
from gristmill.sources.files import Audit, HouseRules, record_score


@pytest.fixture(scope="module")
def money(spark):
    rows = [("NORDIC TRADE", "EUR", "OSLO", 100.0, 900.0), ("NORDIC TRADE", "USD", "OSLO", 50.0, 55.0), ("SOUTHERN FOODS", "EUR", "ROME", 25.0, 25.0), ("Total", None, None, 175.0, None)]
    return spark.createDataFrame(rows, "COMPANY string, CURRENCY string, CITY string, `AMOUNT EURO` double, NATIVE double").coalesce(1)


@pytest.fixture
def engine(spark, money):
    out = Engine(spark)
    out.add("book.xlsx:FUNDS", money)
    return out


def value(answer):
    assert answer.kind == "rows", (answer.kind, answer.text)
    return answer.compiled.df.first()[0]


def test_a_misspelt_value_is_asked_about(engine):
    asked = engine.ask("total amount euro for nordik trade")
    assert asked.kind == "clarify" and asked.options == ["NORDIC TRADE"] and "nordik" in asked.text
    assert engine.ask("maybe").kind == "none"  # the one offer is turned down
    engine.ask("total amount euro for nordik")
    assert value(engine.ask("1")) == 150.0


def test_initials_are_asked_about(engine):
    asked = engine.ask("total amount euro for nt")
    if asked.kind == "clarify":
        assert "NORDIC TRADE" in asked.options and value(engine.ask("NORDIC TRADE")) == 150.0
    else:
        assert asked.kind == "rows"


def test_no_rows_come_with_a_hint(engine):
    engine.add("other", engine.spark.createDataFrame([("BETA", "LIMA"), ("GAMMA", "OSLO")], "BANK string, PLACE string"))
    plan = Plan(table="book.xlsx:FUNDS", filters=[Filter("CITY", "eq", "ROME"), Filter("COMPANY", "eq", "NORDIC TRADE")], select=["CITY"])
    answer = engine.conversation._run(plan, "plain", None, "q")
    assert engine._hint(answer) == ""  # both stand where they are looked for
    contains = Plan(table="book.xlsx:FUNDS", filters=[Filter("CITY", "contains", "lima")], select=["CITY"])
    answer = engine.conversation._run(contains, "plain", None, "q")
    assert "other.PLACE" in engine._hint(answer)
    engine.conversation.plans = {engine.catalog.version(): {"places like lima": contains.to_dict()}}
    assert "'lima' is a value of other.PLACE" in engine.ask("places like lima").hint


def test_routes(engine, spark):
    assert engine.ask("hello there").kind == "chat"
    engine.chunks = spark.createDataFrame([("contract.txt", "1", 0, "the clause says that interest is paid every month"), ("b.txt", "1", 0, "nothing of note")], "source string, location string, position int, chunk string")
    found = engine.ask("explain the clause on interest in the contract")
    assert found.kind == "docs" and found.docs.first()["source"] == "contract.txt" and 0 < found.confidence
    made = engine.ask("pie chart of total amount euro by company")
    assert made.kind == "chart" and made.chart["kind"] == "pie" and sorted(map(tuple, made.chart["data"].collect())) == [("NORDIC TRADE", 150.0), ("SOUTHERN FOODS", 25.0)]
    assert engine.ask("plot total amount euro by company").chart["kind"] == "bar"
    assert {"grounding", "binding"} & set(made.seconds)


def test_a_value_in_several_columns(engine, spark):
    engine.add("b", spark.createDataFrame([("OSLO", "ROME", 1.0), ("ROME", "LIMA", 2.0)], "ORIGIN string, TARGET string, FREIGHT double"))
    engine.catalog.remove("book.xlsx:FUNDS")
    asked = engine.ask("total freight for rome")
    assert asked.kind == "clarify" and len(asked.options) == 2
    assert engine.ask("what?").kind == "clarify"  # still open
    assert value(engine.ask("TARGET")) == 1.0


def test_own_or_converted_amounts(engine):
    asked = engine.ask("total per currency")
    assert asked.kind == "clarify" and len(asked.options) == 2 and "NATIVE" in asked.options[0]
    own = {r[0]: r[1] for r in engine.ask("1").compiled.df.collect()}
    assert own == {"EUR": 925.0, "USD": 55.0}
    engine.conversation.last = None
    converted = engine.ask("total converted per currency")
    assert {r[0]: r[1] for r in converted.compiled.df.collect()} == {"EUR": 125.0, "USD": 50.0}


def test_snapshots_to_choose_from(spark):
    engine = Engine(spark)
    for day, amount in (("2022-12-31", 5.0), ("2023-12-31", 7.0)):
        engine.add(f"loans {day}", spark.createDataFrame([("ALPHA", amount), ("BETA", amount)], "LENDER string, OWED double"), Card(as_of=day))
    asked = engine.ask("total owed")
    assert asked.kind == "clarify" and asked.options == ["the state on 31.12.2022", "the state on 31.12.2023"]
    assert value(engine.ask("2")) == 14.0
    assert value(engine.ask("total owed as at 31.12.2022")) == 10.0


def test_subjects_carry_over(engine):
    assert value(engine.ask("total amount euro for southern foods")) == 25.0
    assert value(engine.ask("and their total native?")) == 25.0
    assert C.subject_of(engine.conversation.last) == "SOUTHERN FOODS" and engine.conversation.last.aggregations[0].column == "NATIVE"
    assert value(engine.ask("total native for nordic trade")) == 955.0
    assert value(engine.ask("what about this one?")) == 955.0


def test_continuity_rules():
    plan = lambda *filters: Plan(filters=[Filter(*f) for f in filters])
    assert C.subject_of(plan(("Balance", "gt", "1000"))) == "" and C.subject_of(None) == "" and C.subject_of(Plan()) == ""
    assert C.subject_of(plan(("CURRENCY", "eq", "EUR"), ("Bank Name", "match", ["Acme Bank"]))) == "Acme Bank"
    assert C.subject_of(plan(("YEAR", "eq", "2023"), ("CURRENCY", "eq", "EUR"))) == "EUR"
    assert C.carries_over("what about this one?", "Acme Bank") and not C.carries_over("what about this one?", "")
    assert not C.carries_over("what about Acme Bank's deposits?", "Acme Bank") and not C.carries_over("and its CY05 loans", "Acme Bank")
    attached = C.with_subject("and their interest rate?", "total deposits for 2024?", "Acme Bank")
    assert "Acme Bank" in attached and "interest rate" in attached
    assert C.with_subject("what about this one?", "total deposits?", "Acme Bank") == "total deposits for Acme Bank"
    assert C.in_doubt("are you sure?") and not C.in_doubt("total deposits")


def test_doubt_is_answered_from_the_last_answer(engine):
    first = engine.ask("total amount euro for usd")
    again = engine.ask("are you sure?")
    assert again.tier == "explained" and again.compiled is first.compiled and "without totals" in again.text and "usd" in again.text


def test_plans_are_kept_on_disk(spark, engine, tmp_path):
    engine.save(str(tmp_path / "s"))
    assert value(engine.ask("total amount euro for usd")) == 50.0
    again = Engine(spark)
    again.open(str(tmp_path / "s"))
    assert again.ask("total amount euro for usd").tier == "cache"
    (tmp_path / "s" / "plans.json").write_text("{ damaged")
    third = Engine(spark)
    third.open(str(tmp_path / "s"))
    assert third.ask("total amount euro for usd").tier == "plain"


def scripted(replies):
    seen = []

    def model(messages):
        seen.append(messages)
        return replies.pop(0)

    return model, seen


def test_a_model_is_told_the_rules_and_puts_few_rows_in_words(spark, money, tmp_path):
    (tmp_path / "rules.txt").write_text("# ours\nLignum means NORDIC TRADE\n")
    plan = '{"table": "FUNDS", "filters": [{"column": "COMPANY", "op": "eq", "value": "nordic trade"}], "aggregations": [{"fn": "sum", "column": "NATIVE"}]}'
    model, seen = scripted([plan, "It is 955.0.", plan, "It is 12."])
    engine = Engine(spark, model, rules=HouseRules(str(tmp_path / "rules.txt")))
    engine.add("book.xlsx:FUNDS", money)
    answer = engine.ask("which share of lignum comes above all")
    assert value(answer) == 955.0 and answer.text == "It is 955.0." and answer.tier == "model"
    assert "Lignum means NORDIC TRADE" in seen[0][0]["content"]
    assert engine.ask("which share of lignum comes above everything").text == ""  # a number that the result lacks


def test_a_model_may_write_a_query_and_mend_it(spark, money):
    bad = '{"table": "nothing"}'
    model, seen = scripted([bad, bad, "SELECT wrong FROM nowhere", "```sql\nSELECT COMPANY, rank() OVER (ORDER BY `AMOUNT EURO` DESC) AS r FROM `book.xlsx:FUNDS` WHERE CITY IS NOT NULL\n```"])
    engine = Engine(spark, model)
    engine.add("book.xlsx:FUNDS", money)
    answer = engine.ask("rank the firms by trend and ratio")
    assert answer.tier == "query" and answer.compiled.df.count() == 3 and answer.compiled.tables_used == ["book.xlsx:FUNDS"]
    assert "nowhere" in seen[-1][-1]["content"]


def test_a_model_may_offer_another_question(spark, money):
    bad = '{"table": "nothing"}'
    model, _ = scripted([bad, bad, "no", "no", "no", json.dumps({"proposal": "Shall I show the total instead?", "question": "total amount euro for usd"}), "It is 50.0"])
    engine = Engine(spark, model)
    engine.add("book.xlsx:FUNDS", money)
    asked = engine.ask("what will the trend be")
    assert asked.kind == "clarify" and asked.text == "Shall I show the total instead?"
    assert value(engine.ask("yes")) == 50.0


def test_misspelt_columns_of_a_query(engine):
    notes = []
    df = run_sql(engine.catalog, "SELECT COMPANI, sum(AMOUNT_EURO) AS s FROM book_xlsx_FUNDS WHERE CITY = 'OSLO' GROUP BY COMPANI", notes)
    assert [tuple(r) for r in df.collect()] == [("NORDIC TRADE", 150.0)] and len(notes) == 2
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        run_sql(engine.catalog, "SELECT qqqqqq FROM book_xlsx_FUNDS")


def test_cards_are_shared_by_schema_and_made_local(spark):
    catalog = Catalog(spark)
    for day in ("2022-12-31", "2023-12-31"):
        rows = [(f"L{i}", datetime(2020, 1, 1), datetime(2025, 1, 1), float(i)) for i in range(8)]
        catalog.add(f"loans {day}", spark.createDataFrame(rows, "CODE string, Start_date timestamp_ntz, End_date timestamp_ntz, OWED double"), Card(as_of=day))
    model, seen = scripted(['{"purpose": "Loans as at 31.12.2022", "entity_key": ["CODE", "gone"], "validity": ["Start_date", "End_date"], "measures": ["OWED", "CODE"], "caveats": ["seen on 31.12.2022"]}'])
    made = build_cards(catalog, str, model)
    assert len(seen) == 1 and len(made) == 2
    second = catalog.tables["loans 2023-12-31"].card
    assert (second.as_of, second.entity_key, second.validity, second.measures) == ("2023-12-31", ["CODE"], ("Start_date", "End_date"), ["OWED"])
    assert "2023-12-31" in second.purpose and "2022" not in second.purpose + second.caveats[0]
    assert build_cards(catalog, str, model) == {}  # nothing has changed
    assert localised(Card(purpose="Loans (as at 31.12.2022)"), None).purpose == "Loans"
    plain = Catalog(spark)
    plain.add("x", catalog.tables["loans 2022-12-31"].raw)
    assert schema_hash(plain.tables["x"]) == second.schema
    assert build_cards(plain, str)["x"].entity_key == ["CODE"]


def test_files_named_after_another_day(spark, tmp_path):
    rows = [(i, datetime(2023, 12, 31)) for i in range(12)]
    spark.createDataFrame(rows, "k int, REPORT_DATE timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "funds 30-11-2023.parquet"))
    engine = Engine(spark)
    engine.load("file://" + str(tmp_path / "funds 30-11-2023.parquet"))
    assert len(engine.warnings) == 1 and "2023-12-31" in engine.warnings[0]


def test_the_service_shows_warnings_scores_rules_and_hints(engine, tmp_path):
    (tmp_path / "rules.txt").write_text("one rule\n")
    scores = str(tmp_path / "scores.json")
    record_score(scores, "check", {"ok": True})
    service = Service(engine, Audit(str(tmp_path / "audit")), HouseRules(str(tmp_path / "rules.txt")), scores=scores)
    engine.warnings.append("look")
    assert service.get("/warnings") == (200, ["look"]) and service.get("/scoreboard")[1]["check"]["ok"]
    assert engine.conversation.rules.rules() == ["one rule"] and service.get("/rules")[1] == {"rules": ["one rule"]}
    code, said = service.post("/ask", {"question": "total amount euro for usd"})
    assert code == 200 and "50.0" in said["table_html"] and said["seconds"] and said["hint"] == ""
    chart = service.post("/ask", {"question": "bar chart of total amount euro by company"})[1]
    assert chart["chart"]["columns"][0] and chart["type"] == "chart"


def test_refusals_stay(engine):
    with pytest.raises(PlanError):
        engine.plan({"table": "FUNDS"})
