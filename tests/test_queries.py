"""Queries that have no SQL, against plain Python over the same tables."""

from __future__ import annotations

import hashlib
from difflib import SequenceMatcher

import __spark_entry__
from gristmill.functions.text import chunks_of, plain, tokens_of
from gristmill.operators import values as V

SF = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()


def names(spark):
    return [r["p_name"] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").distinct().collect()]


def test_similarity_of_all_parts(spark):
    rows = spark.read.parquet(f"{SF}/part.parquet").collect()
    want = {r["p_partkey"]: round(SequenceMatcher(None, r["p_name"].lower(), r["p_type"].lower()).ratio(), 6) for r in rows}
    assert {r["p_partkey"]: r["ratio"] for r in QUERIES["similarity_ratio"](spark, SF).collect()} == want


def test_chunks_of_all_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {(r["doc_id"], r["source"], i, len(c), hashlib.md5(c.encode()).hexdigest()) for r in rows for i, c in enumerate(chunks_of(r["text"]))}
    got = [tuple(r) for r in QUERIES["chunk_text"](spark, SF).collect()]
    assert set(got) == want and len(got) == len(want)


def test_chunks_word_for_word():
    """Cases worked out by hand: packing, a long paragraph in steps, overlap, blanks."""
    assert chunks_of(None) == [] and chunks_of(" \n\n \t") == [] and chunks_of("one") == ["one"]
    assert chunks_of("aa\n\nbb\n\ncc", 5, 0) == ["aa\nbb", "cc"]
    assert chunks_of("aa\n \nbb", 4, 0) == ["aa", "bb"]
    assert chunks_of("abcdefghij", 4, 1) == ["abcd", "d\ndefg", "g\nghij", "j\nj"]
    assert chunks_of("aaaa\n\nbbbb\n\ncc", 7, 2) == ["aaaa", "aa\nbbbb\ncc"]
    long = "\n\n".join("x" * 400 for _ in range(5))
    got = chunks_of(long, 1000, 0)
    assert [len(c) for c in got] == [801, 801, 400] and "".join(got).replace("\n", "") == "x" * 2000


def test_close_matches_of_a_misspelling(spark):
    types = {plain(r[0]) for r in spark.read.parquet(f"{SF}/part.parquet").select("p_type").distinct().collect()}
    scored = sorted(((SequenceMatcher(None, t, "standart").ratio(), t) for t in types), reverse=True)
    want = [(t, s) for s, t in scored if s >= 0.6][:3]
    assert [(r["norm"], r["ratio"]) for r in QUERIES["close_matches"](spark, SF).collect()] == want


def test_fuzzy_names(spark):
    all_ = names(spark)
    asked = [w[:-1] + "x" for w in min(n.lower() for n in all_).split()]
    near = lambda w, t: w == t or w[0] == t[0] and SequenceMatcher(None, t, w).ratio() >= 0.6
    want = {plain(n) for n in all_ if all(any(near(w, t) for t in tokens_of(n)) for w in asked)}
    assert {r["norm"] for r in QUERIES["resolve_fuzzy"](spark, SF).collect()} == want


def test_value_hits_by_definition(spark):
    """Every kind of hit over a small index, worked out value by value."""
    stored = [("t", "country", "Croatia", 5), ("t", "name", "Karanikolaos,Panagiotis", 2), ("t", "name", "Spyrou,Spiros", 3), ("t", "bank", "Alpha Bank", 9), ("u", "bank", "Beta Bank", 4), ("t", "ccy", "EUR", 7), ("t", "ccy", "US", 1)]
    index = spark.createDataFrame([(t, c, plain(v), v, n) for t, c, v, n in stored], V.INDEX_SCHEMA)

    def want(question):
        asked, words, best = f" {plain(question)} ", [w for w in tokens_of(question) if len(w) >= 3], {}
        for t, c, v, n in stored:
            norm, tokens, scores = plain(v), [x for x in tokens_of(v) if len(x) >= 4], []
            if len(norm) >= 3:
                shares = [min(len(w), len(norm)) / max(len(w), len(norm)) for w in words if w in norm or norm in w]
                if f" {norm} " in asked:
                    scores.append((10 + min(len(norm), 30) / 10, "whole"))
                elif [s for s in shares if s >= 0.6]:
                    scores.append((5 + next(s for s in shares if s >= 0.6), "contained"))
            if len(tokens) >= 2:
                scores += [(4 + min(len(w), 20) / 20, "token") for w in words if len(w) >= 4 and w in tokens]
                ratios = [SequenceMatcher(None, x, w).ratio() for w in words for x in tokens if x[0] == w[0]]
                scores += [(6 + r, "typo") for r in ratios if r >= 0.6]
            if scores:
                best[t, c, norm] = max((round(s, 4), k) for s, k in scores)
        return best

    for question in ("loans of Alpha Bank", "croatian firms", "directorships of karanikolaos", "shares of Spuros Spirou in eur", "bank", "what is it", ""):
        got = {(r["table"], r["column"], r["norm"]): (r["score"], r["kind"]) for r in V.value_hits(index, question).collect()}
        assert got == want(question), question
    one = spark.createDataFrame([("t", "c", f"value {i:02}", f"Value {i:02}", 100 - i) for i in range(9)], V.INDEX_SCHEMA)
    assert V.value_hits(one, "value 00 value 01 value 02 value 03").count() == 3  # no more of one column
