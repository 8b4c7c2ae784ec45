"""Routing, codes, hints, cards, timing, result shapes."""

from __future__ import annotations

import pytest

from gristmill import timing
from gristmill.ask import routing as R
from gristmill.ask.grounding import ground
from gristmill.catalog import Card, Catalog
from gristmill.plans.ir import Aggregation, Filter, Plan
from gristmill.sources.extract import badge, chartable, code_name_list


@pytest.fixture(scope="module")
def catalog(spark):
    out = Catalog(spark)
    loans = "LENDER string, CALC_DATE timestamp_ntz, AMOUNT double"
    out.add("loans 31-12-2022.xlsx:L", spark.sql("SELECT 'ALPHA BANK' AS LENDER, timestamp_ntz'2022-06-01' AS CALC_DATE, 5.0D AS AMOUNT").coalesce(1), Card(as_of="2022-12-31"))
    out.add("loans 31-12-2023.xlsx:L", spark.createDataFrame([], loans).unionByName(spark.sql("SELECT 'BETA BANK' AS LENDER, timestamp_ntz'2023-06-01' AS CALC_DATE, 7.0D AS AMOUNT")), Card(as_of="2023-12-31"))
    out.add("firms.xlsx:F", spark.createDataFrame([("CY01", "North Sea Traders"), ("CY02", "Blue Lake Foods")], "COMPANY_CODE string, COMPANY_NAME string"))
    return out


def routed(question, catalog):
    return R.tables_for(question, ground(question, catalog), catalog)


def test_tables_by_day_year_and_value(catalog):
    assert routed("amount at 31.12.2022", catalog) == ["loans 31-12-2022.xlsx:L"]
    assert routed("amount in june 2023", catalog)[0] == "loans 31-12-2023.xlsx:L"
    assert routed("amount of beta bank", catalog)[0] == "loans 31-12-2023.xlsx:L"
    assert set(routed("something else", catalog)) == set(catalog.tables)


def test_kinds_of_questions(catalog):
    kinds = [R.route(q, catalog, True) for q in ("plot amounts", "hello there", "explain the clause", "amount of the clause lender", "total amount")]
    assert kinds == ["plot", "chat", "docs", "analyze", "analyze"]


def test_codes_acronyms_and_hints(catalog):
    assert R.names_for_codes("funds of CY02 and CY99", catalog) == ("funds of Blue Lake Foods and CY99", [])
    assert ("nst", "North Sea Traders") in R.acronyms("loans of nst", catalog)
    plan = Plan(table="firms.xlsx:F", filters=[Filter("COMPANY_CODE", "eq", "alpha bank")])
    assert "loans 31-12-2022.xlsx:L.LENDER" in R.empty_hint(plan, catalog)


def test_forbidden_columns_leave_the_plan():
    plan = Plan(filters=[Filter("CURRENCY", "eq", "EUR"), Filter("B", "eq", 1)], group_by=["currency"], aggregations=[Aggregation("sum", "X")])
    kept = R.without_column(plan, "Currency")
    assert [f.column for f in kept.filters] == ["B"] and kept.group_by == [] and len(kept.aggregations) == 1


def test_cards_claim_only_what_holds(catalog):
    card = Card(as_of="yesterday", entity_key=["COMPANY_CODE", "gone"], validity=("COMPANY_CODE", "COMPANY_NAME"), measures=["COMPANY_NAME"])
    checked = R.checked_card(card, catalog.tables["firms.xlsx:F"])
    assert (checked.as_of, checked.entity_key, checked.validity, checked.measures) == (None, ["COMPANY_CODE"], None, [])


def test_result_shapes(spark):
    df = spark.createDataFrame([("North", "CY01"), ("North", "CY01"), ("Blue", "CY02")], "n string, c string")
    assert sorted(map(tuple, code_name_list(df).collect())) == [("CY01", "North"), ("CY02", "Blue")]
    assert code_name_list(df.select("n")) is None and badge("CY05-Query.xlsx:S") == "CY05" and badge("plain") is None
    assert chartable(spark.range(2)) and not chartable(spark.range(1)) and not chartable(df)


def test_stages_are_timed():
    timing.snapshot(clear=True)
    with timing.stage("a"):
        pass
    with timing.stage("a"):
        pass
    assert list(timing.snapshot(clear=True)) == ["a"] and timing.snapshot() == {}
