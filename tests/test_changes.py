"""The source of changed files: replaced, gone and new ones, restarts, failures."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql.streaming import StreamingQuery

from gristmill.engine import Engine
from gristmill.streaming.changes import ChangedFilesReader, follow_changes


def run(query: StreamingQuery) -> None:
    assert query.awaitTermination(120)


def names(paths):
    return sorted(p.rsplit("/", 1)[-1] for p in paths)


def test_a_replaced_file_comes_once(spark, tmp_path):
    folder, checkpoint, seen = tmp_path / "in", str(tmp_path / "c"), []
    folder.mkdir()
    (folder / "a.csv").write_text("k,v\nx,1\n")
    (folder / "b.csv").write_text("k,v\ny,2\n")
    (folder / "~$a.csv").write_text("lock")
    take = lambda changed, gone: seen.append((names(changed), names(gone)))
    go = lambda: run(follow_changes(spark, str(folder), checkpoint, take, "*.csv", once=True))
    go()
    assert seen == [(["a.csv", "b.csv"], [])]
    go()  # a restart with nothing new
    assert len(seen) == 1
    (folder / "a.csv").write_text("k,v\nx,10\n")
    os.utime(folder / "a.csv", (time.time() + 5, time.time() + 5))
    go()
    assert seen[1:] == [(["a.csv"], [])]
    (folder / "b.csv").unlink()
    (folder / "c.csv").write_text("k,v\nz,3\n")
    go()
    assert seen[2:] == [(["c.csv"], ["b.csv"])]
    go()
    assert len(seen) == 3


def test_a_failed_batch_comes_again(spark, tmp_path):
    folder, checkpoint, seen = tmp_path / "in", str(tmp_path / "c"), []
    folder.mkdir()
    (folder / "a.csv").write_text("1")

    def fails(changed, gone):
        raise RuntimeError("no")

    query = follow_changes(spark, str(folder), checkpoint, fails, once=True)
    with pytest.raises(Exception):  # noqa: B017, PT011
        query.awaitTermination(120)
    (folder / "b.csv").write_text("2")  # came after the failed batch was planned
    for _ in range(3):
        run(follow_changes(spark, str(folder), checkpoint, lambda changed, gone: seen.append(names(changed)), once=True))
    assert seen == [["a.csv"], ["b.csv"]]


def test_a_store_follows_a_folder(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "s")
    folder.mkdir()
    (folder / "t.csv").write_text("code,amount\nA,1\nB,2\n")

    def ingest(changed, gone):
        engine = Engine(spark)
        engine.open(store)
        engine.load(changed)
        for name in [n for n, f in engine.origin.items() if f in names(gone)]:
            engine.remove(name)
        engine.save(store)

    go = lambda: run(follow_changes(spark, str(folder), str(tmp_path / "c"), ingest, once=True))
    total = lambda: (e := Engine(spark)).open(store) and e.sql("SELECT sum(amount) AS s FROM t_csv").first()["s"]
    go()
    assert total() == 3
    (folder / "t.csv").write_text("code,amount\nA,10\nB,20\nC,30\n")
    go()
    assert total() == 60
    (folder / "t.csv").unlink()
    (folder / "u.csv").write_text("code,amount\nA,1\n")
    go()
    last = Engine(spark)
    assert last.open(store) == ["u.csv"]


def test_manifests_number_the_states(tmp_path):
    reader = ChangedFilesReader({"folder": str(tmp_path / "none"), "manifests": str(tmp_path / "m")})
    assert reader.latestOffset() == {"manifest": 0} and reader.initialOffset() == {"manifest": 0}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x").write_text("1")
    assert reader.latestOffset() == {"manifest": 1} and reader.latestOffset() == {"manifest": 1}
    parts = reader.partitions({"manifest": 0}, {"manifest": 1})
    assert [r[2] for p in parts for r in reader.read(p)] == [False] and reader.partitions({"manifest": 1}, {"manifest": 1})[0].rows == []
