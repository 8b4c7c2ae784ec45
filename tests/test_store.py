"""The store: versions, what a save keeps, what a killed save leaves, index and vectors of documents."""

from __future__ import annotations

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill import cli
from gristmill.catalog import Relationship
from gristmill.documents import Documents
from gristmill.engine import Engine
from gristmill.functions.text import tokens_of
from gristmill.operators import cells as C
from gristmill.operators import postings as P
from gristmill.operators import retrieval as H
from gristmill.sources.store import Store, StoreConflict


@pytest.fixture
def inputs(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "t.csv").write_text("code,name,amount\nA1,Alpha,10\nB2,Beta,20\nC3,Gamma,30\n")
    (at / "u.csv").write_text("code,paid\nA1,1\nA1,2\nB2,3\n")
    (at / "v.csv").write_text("code,town\n" + "".join(f"K{i},Town {i}\n" for i in range(40)))
    (at / "w.csv").write_text("code,paid\n" + "".join(f"K{i % 35},{i}.5\n" for i in range(120)))
    (at / "a b+c.txt").write_text("the lease of the alpha building runs to june")
    (at / "b.txt").write_text("beta pays interest every month")
    return at


def sources(engine):
    return sorted({r["source"] for r in engine.chunks.collect()})


def test_save_in_place(spark, inputs, tmp_path):
    folder = str(tmp_path / "s")
    engine = Engine(spark)
    engine.load([str(inputs / "t.csv"), str(inputs / "a b+c.txt")])
    assert engine.save(folder) == 1
    again = Engine(spark)
    again.open(folder)
    again.load(str(inputs / "b.txt"))
    assert again.save(folder) == 2 and again.save(folder) == 3
    third = Engine(spark)
    assert third.open(folder) == ["t.csv"] and third.plan({"table": "t.csv", "select": ["code"]}).count() == 3
    assert sources(third) == ["a b+c.txt", "b.txt"] and third.retrieve("lease").first()["source"] == "a b+c.txt"
    parts = {p.name for p in (Path(folder) / "parts").iterdir()}
    assert sum(p.startswith("table-") for p in parts) == 1 and sum(p.startswith("chunks-") for p in parts) == 2  # nothing is written twice


def test_second_index_run_keeps_the_first(spark, inputs, tmp_path, capsys):
    folder = str(tmp_path / "s")
    assert cli.main(["--store", folder, "index", str(inputs / "v.csv"), str(inputs / "w.csv"), str(inputs / "a b+c.txt")]) == 0
    first = Engine(spark)
    first.open(folder)
    links, cards = len(first.catalog.links), {n: t.card.schema for n, t in first.catalog.tables.items()}
    assert links and all(cards.values())
    assert cli.main(["--store", folder, "index", str(inputs / "b.txt")]) == 0
    second = Engine(spark)
    assert sorted(second.open(folder)) == ["v.csv", "w.csv"] and len(second.catalog.links) == links
    assert {n: t.card.schema for n, t in second.catalog.tables.items()} == cards and sources(second) == ["a b+c.txt", "b.txt"]
    assert second.catalog.columns_holding("v.csv", "town 7") == [("town", 1)]


def test_saving_without_opening_keeps_what_is_there(spark, inputs, tmp_path):
    folder = str(tmp_path / "s")
    one, two = Engine(spark), Engine(spark)
    one.load([str(inputs / "t.csv"), str(inputs / "a b+c.txt")])
    one.catalog.links = [Relationship("t.csv", "code", "t.csv", "code", 1.0)]
    one.save(folder)
    (inputs / "a b+c.txt").write_text("now of something else")
    two.load([str(inputs / "u.csv"), str(inputs / "a b+c.txt")])
    two.save(folder)
    three = Engine(spark)
    assert sorted(three.open(folder)) == ["t.csv", "u.csv"] and len(three.catalog.links) == 1
    assert [r["chunk"] for r in three.chunks.collect()] == ["now of something else"]
    two.save(folder, replace=True)
    three = Engine(spark)
    assert three.open(folder) == ["u.csv"]


@pytest.mark.parametrize("at", ["write", "commit"])
def test_killed_save_changes_nothing(spark, inputs, tmp_path, monkeypatch, at):
    folder = str(tmp_path / "s")
    engine = Engine(spark)
    engine.load([str(inputs / "t.csv"), str(inputs / "b.txt")])
    engine.save(folder)
    engine.load([str(inputs / "u.csv"), str(inputs / "a b+c.txt")])
    calls, real = [], getattr(Store, at)

    def dies(self, *args):
        calls.append(args)
        if at == "commit" or len(calls) == 3:
            raise KeyboardInterrupt
        return real(self, *args)

    monkeypatch.setattr(Store, at, dies)
    with pytest.raises(KeyboardInterrupt):
        engine.save(folder)
    monkeypatch.undo()
    again = Engine(spark)
    assert again.open(folder) == ["t.csv"] and sources(again) == ["b.txt"] and again.plan({"table": "t.csv", "select": ["code"]}).count() == 3
    store = Store(spark, folder)
    left = {p.name for p in (Path(folder) / "parts").iterdir()}
    assert store.vacuum() == [] and len(store.vacuum(grace=-1)) > 0 and {p.name for p in (Path(folder) / "parts").iterdir()} < left
    assert again.plan({"table": "t.csv", "select": ["code"]}).count() == 3


def test_readers_hold_their_version_and_saves_do_not_pass_over_each_other(spark, inputs, tmp_path):
    folder = str(tmp_path / "s")
    engine = Engine(spark)
    engine.load(str(inputs / "t.csv"))
    engine.save(folder)
    reader = Engine(spark)
    reader.open(folder)
    (inputs / "t.csv").write_text("code,name,amount\nZ9,Zeta,1\n")
    engine.load(str(inputs / "t.csv"))
    engine.save(folder)
    assert reader.plan({"table": "t.csv", "select": ["code"]}).count() == 3
    old, new = Engine(spark), Engine(spark)
    old.open(folder, version=1)
    new.open(folder)
    assert old.plan({"table": "t.csv", "select": ["code"]}).count() == 3 and [r["code"] for r in new.plan({"table": "t.csv", "select": ["code"]}).collect()] == ["Z9"]
    store = Store(spark, folder)
    base = store.read()
    store.commit(base.copy(), base)
    with pytest.raises(StoreConflict):
        store.commit(base.copy(), base)
    with pytest.raises(ValueError):
        store.read(99)
    (Path(folder) / "manifests" / f"{9:012}.json").write_text("{")
    assert store.read().number == 3  # one that is cut short is none


def test_tables_of_a_file_that_lost_them(spark, inputs, tmp_path, monkeypatch):
    from gristmill.sources import files

    folder, real = str(tmp_path / "s"), files.read_file
    two = lambda s, p, split=False: {f"{n}:{k}": df for n, df in real(s, p).items() for k in "xy"}
    engine = Engine(spark)
    with monkeypatch.context() as m:
        m.setattr(files, "read_file", two)
        engine.load(str(inputs / "t.csv"))
    engine.save(folder)
    with monkeypatch.context() as m:
        m.setattr(files, "read_file", lambda s, p, split=False: {k: v for k, v in two(s, p).items() if k.endswith("x")})
        for fresh in (False, True):
            other = Engine(spark)
            if not fresh:
                other.open(folder)
            other.load(str(inputs / "t.csv"))
            other.save(folder)
            last = Engine(spark)
            assert last.open(folder) == ["t.csv:x"]


def plain_bm25(rows, query, k):
    cut = [(i, Counter(tokens_of(t or ""))) for i, t in rows]
    n, mean = len(cut), sum(c.total() for _, c in cut) / len(cut)
    out = []
    for i, c in cut:
        s = 0.0
        for w in tokens_of(query):
            df = sum(1 for _, x in cut if w in x)
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / mean)) if c[w] else 0.0
        if s > 0:
            out.append((i, s))
    return sorted(out, key=lambda x: (-round(x[1], 6), x[0]))[:k]


def rows_of(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randrange(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("named", [1000, 0])
def test_index_gives_the_full_scan(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(P, "SPAN", 16)
    monkeypatch.setattr(P, "NAMED", named)
    rows = [*rows_of(1, 600), (900, None), (901, "w1 w1 w50 rare")]
    frame = spark.createDataFrame(rows, "chunk_id long, chunk string").coalesce(1).withColumn("n", F.monotonically_increasing_id())
    P.write(P.postings(frame), str(tmp_path / "p"))
    part = P.Part(spark.read.parquet(str(tmp_path / "p")), *P.sizes(frame))
    for query in ("w50 w3", "w0 w0 w1", "rare", "nowhere", "", "w59 w58 w57 w1 rare"):
        got = [tuple(r) for r in P.bm25_topk([part], query, 7).collect()]
        want = plain_bm25(rows, query, 7)
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=2e-6), query


def test_index_of_parts_with_rows_that_went(spark, monkeypatch):
    monkeypatch.setattr(P, "SPAN", 16)
    rows = rows_of(2, 300)
    frames = [spark.createDataFrame(x, "chunk_id long, chunk string").coalesce(1).withColumn("n", F.monotonically_increasing_id()) for x in (rows[:200], rows[200:])]
    gone = [i for i, _ in rows[:200] if i % 3 == 0]
    lost = frames[0].where(F.col("chunk_id").isin(gone))
    parts = [P.Part(P.postings(frames[0]), *P.sizes(frames[0]), lost.select(F.col("chunk_id").alias("id")), *P.sizes(lost)), P.Part(P.postings(frames[1]), *P.sizes(frames[1]))]
    live = [r for r in rows if r[0] not in gone]
    for query in ("w50 w3", "w0 w1 w2", "w40"):
        got, want = [tuple(r) for r in P.bm25_topk(parts, query, 9).collect()], plain_bm25(live, query, 9)
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=2e-6)


def test_question_reads_its_terms_only(spark, tmp_path):
    frame = spark.createDataFrame(rows_of(3, 2000), "chunk_id long, chunk string").withColumn("n", F.col("chunk_id"))
    P.write(P.postings(frame), str(tmp_path / "p"))
    index = spark.read.parquet(str(tmp_path / "p"))
    plan = index.where(F.col("term").isin("w50")).select("term", "span", "n", "most", "least")._jdf.queryExecution().executedPlan().toString()
    assert "docs" not in plan.split("ReadSchema")[1] and "PushedFilters: [In(term, [w50])]" in plan.replace("IsNotNull(term), ", "").replace("EqualTo(term,w50)", "In(term, [w50])")


def clustered(seed, n, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    return [(i, (centres[i % 12] + 0.2 * rng.normal(size=width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("vectors", [clustered(1, 3000), [(i, np.random.default_rng(i).normal(size=6).tolist()) for i in range(700)]])
def test_cells_give_the_full_scan(spark, tmp_path, monkeypatch, vectors):
    monkeypatch.setattr(C, "CELL", 64)
    odd = [(90_000, None), (90_001, [0.0] * len(vectors[0][1])), (90_002, vectors[5][1]), (90_003, vectors[5][1])]
    frame = spark.createDataFrame([*vectors, *odd], "vec_id long, embedding array<double>")
    centres = C.fit(frame)
    C.write(C.placed(frame, centres), str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    cells = [tuple(r) for r in C.summary(stored).collect()]
    assert len(cells) > 5
    for q in (vectors[5][1], vectors[77][1], (np.array(vectors[5][1]) + 0.05).tolist(), [0.0] * len(vectors[0][1])):
        got = [tuple(r) for r in C.exact_topk(stored, centres, cells, q, 10).collect()]
        assert got == [tuple(r) for r in H.dense_topk(frame, q, 10).collect()] or not any(q) and got == []


def test_cells_leave_most_vectors_unread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "CELL", 64)
    vectors = clustered(2, 3000)
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    centres = C.fit(frame)
    placed = C.placed(frame, centres)
    cells = [tuple(r) for r in C.summary(placed).collect()]
    q = np.array(vectors[5][1])
    top = H.dense_topk(frame, vectors[5][1], 10).collect()[-1]["score"]
    reach = math.sqrt(2 - 2 * top) + C.SLACK
    assert C.within(placed, C.bands(cells, centres, q / np.linalg.norm(q), reach)).count() < 1500


def letters(texts):
    """A stand-in for a model: counts of letters."""
    return [[float(t.lower().count(c)) + 0.01 for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


def test_engine_embeds_and_fuses(spark, inputs, tmp_path):
    folder = str(tmp_path / "s")
    engine = Engine(spark, embedder=letters, embedding="letters")
    engine.load([str(inputs / "a b+c.txt"), str(inputs / "b.txt")])
    found = engine.retrieve("zzz lease alpha").collect()
    assert found[0]["source"] == "a b+c.txt" and all(r["dense"] is not None for r in found) and {r["sparse"] is None for r in found} == {True, False}
    engine.save(folder)
    called = []

    def counting(texts):
        called.append(texts)
        return letters(texts)

    again = Engine(spark, embedder=counting, embedding="letters")
    again.open(folder)
    assert [r["chunk"] for r in again.retrieve("zzz lease alpha").collect()] == [r["chunk"] for r in found] and len(called) == 1
    sure = [again.ask(f"what does the document say on {w}").confidence for w in ("interest", "lease of the alpha building")]
    assert 0 < min(sure) and max(sure) <= 1 and sure[0] != sure[1]
    (inputs / "c.txt").write_text("beta pays interest every month")  # a text that is new under this name
    again.load(str(inputs / "c.txt"))
    again.save(folder)
    assert again.documents.cache and again.documents.count == 3
    plain = Engine(spark)
    plain.open(folder)
    assert plain.retrieve("interest").select("dense").distinct().collect()[0][0] is None


def test_confidence_follows_the_scores(spark, inputs):
    engine = Engine(spark)
    engine.load([str(inputs / "a b+c.txt"), str(inputs / "b.txt")])
    a, b = engine.ask("document on interest every month"), engine.ask("document on the")
    assert a.kind == b.kind == "docs" and 0 < b.confidence < a.confidence <= 1


def test_parts_are_written_together(spark, monkeypatch, tmp_path):
    from gristmill import documents

    monkeypatch.setattr(documents, "MOST_PARTS", 2)
    engine = Engine(spark)
    schema = "source string, location string, position int, chunk string"
    for i in range(4):
        engine.chunks = spark.createDataFrame([(f"s{i % 3}", "1", 0, f"text number {i} of all")], schema)
    assert engine.documents.count == 3 and len(engine.documents.parts) == 4
    engine.save(str(tmp_path / "s"))
    assert len(engine.documents.parts) == 1
    again = Engine(spark)
    again.open(str(tmp_path / "s"))
    assert sorted(r["chunk"] for r in again.chunks.collect()) == ["text number 1 of all", "text number 2 of all", "text number 3 of all"]
    assert [r["source"] for r in again.retrieve("number 3").limit(1).collect()] == ["s0"] and isinstance(again.documents, Documents)
    again.documents.remove(spark.createDataFrame([("s0",)], "source string"))
    assert again.documents.count == 2
    again.save(str(tmp_path / "s"))
    last = Engine(spark)
    last.open(str(tmp_path / "s"))
    assert sources(last) == ["s1", "s2"] and last.documents.count == 2


def test_the_limit_holds_for_a_whole_question(spark, monkeypatch):
    """A slow step of any kind is cut off, and so is what is begun after that."""
    import time

    from gristmill import engine as E
    from gristmill.server import Service
    from gristmill.sources.files import Audit

    engine = Engine(spark, seconds=1.0)
    engine.add("t", spark.createDataFrame([("ALPHA", 1.0)], "NAME string, AMOUNT double"))

    def slow(*args, **kwargs):
        for _ in range(3):
            try:
                spark.range(0, 1 << 40, 1, 4).selectExpr("sum(hash(id))").collect()
            except Exception:  # noqa: BLE001, S112
                continue
        return spark.range(5).count()

    for name in ("route",):
        with monkeypatch.context() as m:
            m.setattr(E, name, slow)
            began = time.time()
            answer = engine.ask("total amount")
            assert answer.kind == "none" and answer.tier == "stopped" and time.time() - began < 20
    with monkeypatch.context() as m:
        m.setattr(Engine, "charts", slow)
        assert Service(engine, Audit("unused")).get("/charts")[0] == 503
    engine.seconds = 60.0
    assert engine.ask("total amount").kind == "rows"


def test_terms_travel_counted_and_once(spark):
    """One exchange builds the index, and its counts tell the tokens."""
    rows = [*rows_of(4, 500), (900, None), (901, "w1 w1 W1 é")]
    frame = spark.createDataFrame(rows, "chunk_id long, chunk string").withColumn("n", F.col("chunk_id"))
    index = P.postings(frame)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert (len(rows), P.tokens_in(index)) == P.sizes(frame)
    got = {(r["term"], d["id"], d["tf"], d["size"]) for r in index.collect() for d in r["docs"]}
    assert ("w1", 901, 3, 4) in got and ("é", 901, 1, 4) in got and not [g for g in got if g[1] == 900]
    assert P.tokens_in(P.postings(frame.limit(0))) == 0
