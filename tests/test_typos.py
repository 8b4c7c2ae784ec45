"""Misspelt words: the index gives what brute force gives and scores few pairs; suggestions, names by likeness, noise."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from gristmill.ask.continuity import edits_by_place
from gristmill.ask.grounding import Hit, did_you_mean, ground, without_noise
from gristmill.ask.routing import acronyms, like_names, names_for_codes, route, without_chart_words
from gristmill.engine import Engine
from gristmill.operators import values as V
from gristmill.plans.ir import Filter, Plan
from gristmill.queries.values import MISSPELT
from gristmill.server import Service
from gristmill.sources.files import Audit

SF = "/root/testdata/sf0.01"


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def test_bound_is_one():
    rng = random.Random(1)
    pairs = [("".join(rng.choices("abcdeé", k=rng.randrange(1, 12))), "".join(rng.choices("abcdeé", k=rng.randrange(1, 12)))) for _ in range(3000)]
    for a, b in pairs:
        shared = sum(min(a.count(c), b.count(c)) for c in set(b))
        assert 2 * shared / (len(a) + len(b)) >= ratio(a, b) - 1e-12


@pytest.mark.parametrize("initial", [True, False])
def test_like_words_are_those_of_brute_force(spark, initial):
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abcdefgh", weights=[5, 4, 3, 2, 2, 1, 1, 1], k=rng.randrange(1, 10))) for _ in range(2000)})
    asked = [rng.choice(words) for _ in range(5)] + ["abcabc", "hhhhhh"]
    frame = spark.createDataFrame([(w,) for w in words], "token string")
    for cut in (0.6, 0.75, 0.86, 1.0):
        got = {(r["token"], r["word"], r["ratio"]) for r in V.like(frame, asked, cut, initial).collect()}
        want = {(t, w, ratio(t, w)) for t in words for w in asked if (t[0] == w[0] or not initial) and ratio(t, w) >= cut}
        assert got == want


def test_few_pairs_are_scored(spark):
    words = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("token")).distinct()
    all_ = [r[0] for r in words.collect()]
    got = {(r["token"], r["word"]) for r in V.like(words, MISSPELT, 0.75).select("token", "word").collect()}
    assert got == {(t, w) for t in all_ for w in MISSPELT if t[0] == w[0] and ratio(t, w) >= 0.75}
    assert V.like_candidates(words, MISSPELT, 0.75).count() < 0.01 * len(all_) * len(MISSPELT)


@pytest.fixture
def engine(spark, tmp_path):
    out = Engine(spark)
    firms = [("CY01", "North Sea Traders"), ("CY02", "Blue Lake Foods"), ("CY03", "Acme Holdings Ltd"), ("CY04", "Zenith Metals")]
    out.add("firms", spark.createDataFrame(firms, "COMPANY_CODE string, COMPANY_NAME string"))
    loans = [("North Sea Traders", "EUR", 5.0), ("Blue Lake Food", "USD", 7.0), ("Acme Holdngs Ltd", "EUR", 1.0), ("Acme Holding Ltd", "EUR", 2.0), ("Other Firm", "USD", 3.0), ("Total Assets Co", "USD", 4.0)]
    out.add("loans", spark.createDataFrame(loans, "COMPANY string, CURRENCY string, AMOUNT double").coalesce(1))
    return out


def test_names_by_likeness(engine):
    assert like_names("North Sea Traders", engine.catalog, "firms") == (True, [])
    assert [d for _, d in like_names("Blue Lake Foods", engine.catalog, "firms")[1]] == ["Blue Lake Food"]
    assert names_for_codes("amount of CY01", engine.catalog) == ("amount of North Sea Traders", [])
    assert names_for_codes("amount of CY04", engine.catalog) == ("amount of Zenith Metals", [])  # nothing is like it
    question, ways = names_for_codes("total amount of CY02", engine.catalog)
    assert question == "total amount of CY02" and [w["value"] for w in ways] == ["Blue Lake Food"]
    assert {w["value"] for w in names_for_codes("CY03", engine.catalog)[1]} == {"Acme Holdngs Ltd", "Acme Holding Ltd"}


def test_a_likely_name_is_asked_for(engine):
    asked = engine.ask("total amount for CY02")
    assert asked.kind == "clarify" and "Blue Lake Food" in asked.options[0]
    got = engine.ask("1")
    assert got.kind == "rows" and got.compiled.df.collect()[0][-1] == 7.0


def test_suggestions_come_from_the_index(engine, monkeypatch):
    monkeypatch.setattr(type(engine.catalog), "domain", lambda *a, **k: pytest.fail("no domain is fetched"))
    assert did_you_mean("amount of zenit metalls", engine.catalog)[0][1] in ("Zenith Metals",)
    assert did_you_mean("amount of zenith metals", engine.catalog) == []
    assert ("nst", "North Sea Traders") in acronyms("loans of nst", engine.catalog)


def test_words_that_describe_give_way_to_a_name():
    hits = [Hit("t", "NAME", "koutouvas, athanasios", "Koutouvas, Athanasios", 2, 6.5, "token"), Hit("t", "REMARK", "managing director", "Managing Director", 9, 5.0, "token"), Hit("t", "CITY", "director street", "Director Street", 1, 5.0, "token")]
    words = ["directorships", "director", "koutouvas"]
    spread = {("t", "NAME", "koutouvas"): 1, ("t", "REMARK", "director"): 3, ("t", "CITY", "director"): 1}
    assert [h.column for h in without_noise(hits, words, spread)] == ["NAME", "CITY"]
    assert without_noise(hits[1:], words, {**spread, ("t", "CITY", "director"): 2}) == hits[1:]


def test_noise_in_a_question(spark):
    engine = Engine(spark)
    rows = [("Koutouvas Athanasios", "Director"), ("Spyrou Maria", "Managing Director"), ("Lang Peter", "Non Executive Director"), ("Muster Eva", "Secretary of Board")]
    engine.add("people", spark.createDataFrame(rows, "NAME string, REMARK string"))
    assert {h.column for h in ground("director posts of koutouvas", engine.catalog).hits} == {"NAME", "REMARK"} or {h.column for h in ground("director posts of koutouvas", engine.catalog).hits} == {"NAME"}


def test_charts_by_the_words(engine):
    assert route("total amount by product line", engine.catalog, False) == "analyze" and route("copies of all", engine.catalog, False) == "analyze"
    for q in ("line chart of total amount by currency", "pie of amount", "bar chart of amount", "plot the amount", "visualise amount", "trend of amount"):
        assert route(q, engine.catalog, False) == "plot"
    assert without_chart_words("line chart of total amount by product line") == "of total amount by product line"
    made = engine.ask("bar chart of total amount by currency")
    assert made.kind == "chart" and made.chart["kind"] == "bar"


def test_edits_by_place_and_by_value(engine):
    assert edits_by_place("remove the last row") and edits_by_place("hide the first two lines") and edits_by_place("delete row 3")
    assert not edits_by_place("remove the total row") and not edits_by_place("show the last row")
    assert "by position" in engine.ask("drop the last row").text and "by position" not in engine.ask("remove the total row").text


def test_clearing_forgets_the_whole_conversation(engine, tmp_path):
    service = Service(engine, Audit(str(tmp_path)))
    engine.ask("total amount for eur")
    assert engine.ask("are you sure?").tier == "explained"
    assert service.post("/clear_history", {}) == (200, {"ok": True})
    assert engine.conversation.last_answer is None and engine.ask("are you sure?").tier != "explained"


def test_stale_plans_are_made_anew_and_versions_see_rows(engine, spark):
    question = "total amount for eur"
    stale = Plan(table="loans", filters=[Filter("GONE", "eq", "x")], select=["GONE"])
    engine.conversation.plans = {engine.catalog.version(): {question: stale.to_dict()}}
    assert engine.ask(question).tier == "plain" and engine.ask(question).tier == "cache"
    before = engine.catalog.version()
    engine.add("loans", spark.createDataFrame([("A", "EUR", 1.0)], "COMPANY string, CURRENCY string, AMOUNT double"))
    assert engine.catalog.version() != before and engine.ask(question).tier == "plain"
    before = engine.catalog.version()
    engine.chunks = spark.createDataFrame([("a.txt", "1", 0, "text")], "source string, location string, position int, chunk string")
    assert engine.catalog.version() != before and re.fullmatch("[0-9a-f]{40}", before)
