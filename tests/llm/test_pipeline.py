"""The pipeline's stages, each against its own definition, and without the subpackage."""

from __future__ import annotations

import random
from collections import Counter

import public_tokenizers as P
import pytest

import corpus_pipeline
from gristmill.llm import langid, secrets

from tests.llm.conftest import WORDS, prose
from tests.llm.test_groups import copies_of, plain_similar
from tests.llm.test_texts import junk


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(20)
    rows = []
    for i in range(240):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, junk(rng) if i % 6 == 0 else prose(rng, lang, 120), lang, f"src{i % 3}"))
    rows += [(300 + k, rows[1][1], rows[1][2], "src0") for k in range(30)]
    rows += [(400, rows[2][1] + " password=hunter2hunter2 end", "en", "src1"), (401, None, None, None), (402, "12 34", "en", "src1"), (None, prose(rng, "de", 90), "de", None)]
    rows += [(500 + k, t, "en", "src2") for k, t in enumerate(copies_of(rng, prose(rng, "en", 250), 40, 2))]
    rows += [(600, prose(rng, "de", 40_000), "de", "src0")]  # a very long text
    where = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{where}/documents.parquet")
    marks = [(i, int(i % 6 != 0), 0) for i in range(0, 240)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{where}/labels.parquet")
    return where


def test_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == names, name
        kept.append(docs.collect())
    language, good, single, masked = kept
    assert {401, 402} & {r["doc_id"] for r in language} == set() and len(language) > 260
    assert len({r["doc_id"] for r in good} & set(range(0, 240, 6))) <= 4 and len(good) > 200
    pairs = [(r["doc_id"], r["text"]) for r in good]
    groups, alike = plain_similar(pairs)
    groups = dict(groups)
    kept = {r["doc_id"] for r in single}
    # one of each group stays, the first; a text that is alike to no other is never dropped
    assert {groups[d] for d in kept} == set(groups.values()) and set(groups.values()) <= kept
    assert len(kept) <= len(set(groups.values())) + 1 and len({groups[d] for d in groups if 500 <= (d or 0) < 540}) <= 2
    assert len(masked) == len(single) and {600} <= {r["doc_id"] for r in masked}
    tokens = secrets.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for r in masked:
        want = secrets.mask(texts[r["doc_id"]], secrets.scan(texts[r["doc_id"]], tokens)[1])
        assert r["text"] == want and r["n_chars"] == len(want)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).groupBy("doc_id").sum("length").count()
    assert packed == len(masked)
    assert langid.UNDETERMINED == "und"


def test_run_equals_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, docs.collect()))


def test_stages_bear_extra_columns_and_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = docs.selectExpr("*", "1 AS _row", "2 AS _score", "3 AS _pred", "4 AS fp", "5 AS _masked", "6 AS key", "7 AS `a.b`")
    for rows in (more, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, folder)
            assert out.columns == rows.columns, name
            assert (out.count() > 0) == (rows is more), name
        assert (corpus_pipeline.STAGES[-1][1](spark, rows, folder).count() > 0) == (rows is more)
