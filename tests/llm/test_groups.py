"""Near-duplicates, nearest neighbours, sharding, packing, fingerprints, licences."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
import xxhash
from tokenizers import Tokenizer

from gristmill.llm import ann, iblt, licenses, packing, sharding, simhash

from tests.llm.conftest import prose


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)] += [d] if d is not None else []
    return [(rows[i][0], prints[i], min(least[find(i)], default=None)) for i in range(len(rows))]


def test_near_duplicates_equal_all_pairs(tables, corpus, odd):
    rows = [(d, t) for d, t, _ in corpus] + [(None if d is None else d + 1000, t) for d, t in odd if len(t or "") < 1000]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = simhash.near_duplicates(tables(rows)).collect()
    assert sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in got), key=key) == sorted(plain_components(rows), key=key)
    assert simhash.near_duplicates(tables([])).count() == 0
    long = dict(odd)[5]
    assert simhash.fingerprint(long) == plain_fingerprint(long[:1800])  # every shingle of the loop, in even shares


def plain_similar(rows, words=5, similarity=0.8):
    """(key, component) by comparing the shingle sets of all pairs of texts, and the pairs that are alike."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    parent, alike = list(range(len(rows))), []

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                alike.append((i, j))
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)] += [d] if d is not None else []
    return [(rows[i][0], min(least[find(i)], default=None)) for i in range(len(rows))], alike


def copies_of(rng, text, count, edits):
    """Copies with so many words changed, and some with a block taken out."""
    out = []
    for k in range(count):
        words = text.split()
        for _ in range(edits):
            words[rng.randrange(len(words))] = "w" + str(rng.randrange(10_000))
        at = rng.randrange(len(words))
        out.append(" ".join(words if k % 3 else words[:at] + words[at + len(words) // 20 :]))
    return out


def test_similar_texts_seek_components_of_new_links_only(tables, monkeypatch):
    """Components are found anew only when a round has linked something: each search is many jobs of the driver."""
    asked = []
    plain = simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges, *ends: asked.append(1) or plain(edges, *ends))
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " end"), (3, "something else entirely")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(tables(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and len(asked) == 1


def test_similar_texts_against_all_pairs(tables, corpus, odd):
    rng = random.Random(41)
    rows = [(d, t) for d, t, _ in corpus if d < 60] + [(None if d is None else d + 1000, t) for d, t in odd if len(t or "") < 1000]
    for g in range(8):
        base = prose(rng, "en", 300)
        rows += [(2000 + 100 * g + k, t) for k, t in enumerate(copies_of(rng, base, 24, 3))] + [(2090 + 100 * g, base), (2091 + 100 * g, base)]
    rng.shuffle(rows)
    want, alike = plain_similar(rows)
    got = simhash.similar_texts(tables(rows).repartition(3)).collect()
    assert len(got) == len(rows)
    # no text joins a group that it is not alike, equal texts are together, and next to no pair that is alike is apart
    exact, seen, text_of = dict(want), {r["doc_id"]: r["component_id"] for r in got}, dict(rows)
    assert all(exact[d] == exact[c] for d, c in seen.items() if d is not None)
    assert all(seen[rows[i][0]] == seen[rows[j][0]] for i, j in alike if rows[i][1] == rows[j][1] and None not in (rows[i][0], rows[j][0]))
    linked = [seen[rows[i][0]] == seen[rows[j][0]] for i, j in alike if None not in (rows[i][0], rows[j][0])]
    assert np.mean(linked) > 0.99 and len({c for c in seen.values()}) < len(set(text_of.values()))
    assert len(alike) > 500 and simhash.similar_texts(tables([])).count() == 0


def test_variants_meet_where_a_segment_is_one_letter_apart():
    a = np.arange(20, dtype=np.uint64) + np.uint64(1000)
    for changed in ([7], [3, 11], [0, 5, 10, 15], [0, 1, 5, 6, 10, 11, 15], [0, 1, 5, 6, 10, 11, 15, 16]):
        b = a.copy()
        b[changed] += np.uint64(50)
        apart = np.bincount(np.array(changed) // 5, minlength=4)
        assert bool(set(simhash.variants(a).tolist()) & set(simhash.variants(b).tolist())) == bool((apart <= 1).any())


@pytest.mark.parametrize("edit", ["words", "block", "behind", "before"])
def test_edits_of_every_kind_are_found(tables, edit):
    """Pairs at a Jaccard coefficient of 0.8 or a little more, by scattered words, one exchanged block, or words put on."""
    rng = random.Random(edit)
    word = lambda: "v" + str(rng.randrange(100_000))
    rows, pairs = [], 0
    for i in range(150):
        words = [word() for _ in range(250)]
        other = list(words)
        if edit == "words":
            for at in rng.sample(range(5, 245), 5):
                other[at] = word()
        elif edit == "block":
            at = rng.randrange(230)
            other[at : at + 20] = [word() for _ in range(20)]
        else:
            more = [word() for _ in range(55)]
            other = other + more if edit == "behind" else more + other
        a, b = simhash.shingles(" ".join(words)), simhash.shingles(" ".join(other))
        pairs += 0.8 <= simhash.jaccard(a, b) <= 0.85
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(tables(rows)).collect()}
    assert pairs > 140 and np.mean([got[2 * i + 1] == 2 * i for i in range(150)]) > 0.95


def test_hubs_are_spread(spark, monkeypatch):
    """A star of many links, a chain and a clique, with every node a hub and with none."""
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(30)] + [(a, b) for a in range(2000, 2012) for b in range(2000, a)]
    want = {i: 0 for i in range(300)} | {1000 + i: 1000 for i in range(31)} | {a: 2000 for a in range(2000, 2012)}
    monkeypatch.setattr(simhash, "HUBS", 1 << 40)
    monkeypatch.setattr(simhash.spread, "__defaults__", (1,))
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


@pytest.mark.parametrize("distance", [1, 3, 5])
def test_links_equal_all_pairs(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = set(base)
    for b in base:
        for _ in range(25):
            prints.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 7))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), distance).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("at_once", [0, 150, 1000])
def test_components_in_one_task_and_in_rounds_agree(spark, monkeypatch, at_once):
    """Rounds to the end, rounds until so many links are left, and one task at once."""
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(-i, -i - 1) for i in range(1, 40)] + [(1 << 40, 399)] + [(500, 501 + i) for i in range(90)]
    want = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    monkeypatch.setattr(simhash, "LINKS_AT_ONCE", at_once)
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


def test_components_of_few_links_take_few_jobs(spark):
    """Each round of stars is a dozen jobs, which the driver keeps in memory; a chain took six rounds."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    spark.sparkContext.setJobGroup("components", "")
    try:
        simhash.components(edges).collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 8
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_similar_texts_broadcast_nothing(tables):
    """Small sides of joins are not collected to be sent about: each such table passes through the driver."""
    text = " ".join(f"w{i}" for i in range(60))
    found = simhash.similar_texts(tables([(1, text), (2, text + " end"), (3, "something else entirely")]))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_links_broadcast_nothing(spark):
    """Each fingerprint has 64 keys, which the join took for as small as the fingerprints and sent through the driver."""
    base = [b << 20 for b in range(1, 200)]
    found = simhash.links(spark.createDataFrame([(b ^ x,) for b in base for x in (0, 1)], "fp long").distinct())
    assert {(b, b ^ 1) for b in base} <= {tuple(r) for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(10, 24))
    x = (centre[rng.integers(10, size=1500)] + 0.6 * rng.normal(size=(1500, 24))).astype(np.float32)
    x[200:700] = x[200]  # a third of the rows alike
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [1.0] * 3), (None, [1.0] * 24), (5005, [None] * 24)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    wide, hit = x.astype(np.float64), 0
    assert set(got) == set(range(0, 1500, 20))
    for q, found in got.items():
        exact = (wide * wide[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(1500), -exact)) if i != q][:20]
        hit += len(set(best) & {v for v, _ in found})
        assert all(s == pytest.approx(exact[v], abs=1e-9) for v, s in found)
        if exact[best[0]] == exact[best[-1]]:
            assert [v for v, _ in found] == best  # ties go to the smaller ids
    assert hit >= 0.95 * 20 * len(got)


def test_neighbours_of_few_and_none(spark):
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    got = ann.nearest_neighbours(few, few.where("vec_id = 0")).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3, 4} and [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    assert ann.nearest_neighbours(few.limit(0), few.limit(0)).count() == 0


def test_ring_bounds_and_movement(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    a = sharding.assign(ids, shards=24, cell_rows=500).collect()
    counts = Counter(r["shard"] for r in a)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 24
    slots = defaultdict(set)
    for r in a:
        slots[r["shard"]].add(r["slot"])
    assert all(s == set(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 20_000
    ring = sharding.Ring.of(24)
    home = {r["doc_id"]: r["shard"] for r in a}
    place = {r["doc_id"]: r["p"] for r in ids.select("doc_id", sharding.key_position("doc_id").alias("p")).collect()}
    at_home = np.mean([ring.owner[ring.node[place[d] >> (32 - sharding.GRID_BITS)]] == s for d, s in home.items()])
    assert at_home > 0.85  # only overflow leaves its arc
    b = {r["doc_id"]: r["shard"] for r in sharding.assign(ids, shards=25, cell_rows=500).collect()}
    assert np.mean([b[d] != s for d, s in home.items()]) < 0.15  # dealing anew by remainder moves 96 %


def plain_walk(positions, shards):
    """Key by key: first every row its own arc's shard while there is room, clockwise; then the overflow on to the next node with room."""
    ring = sharding.Ring.of(shards)
    room, out, over = sharding.bounds(len(positions), shards), {}, []
    for at, row in sorted((p, d) for d, p in positions.items()):
        node = ring.node[at >> (32 - sharding.GRID_BITS)]
        if room[ring.owner[node]]:
            out[row] = ring.owner[node]
            room[ring.owner[node]] -= 1
        else:
            over.append((row, node))
    for row, node in over:
        node = (node + 1) % len(ring.owner)
        while not room[ring.owner[node]]:
            node = (node + 1) % len(ring.owner)
        out[row] = ring.owner[node]
        room[ring.owner[node]] -= 1
    return out


@pytest.mark.parametrize(("shards", "cell_rows"), [(24, 40), (5, 100_000)])
def test_sharding_equals_a_walk_round_the_ring(spark, shards, cell_rows):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    place = {r["doc_id"]: r["p"] for r in ids.select("doc_id", sharding.key_position("doc_id").alias("p")).collect()}
    got = {r["doc_id"]: r["shard"] for r in sharding.assign(ids.repartition(5), shards=shards, cell_rows=cell_rows).collect()}
    assert got == plain_walk(place, shards)


def test_sharding_of_a_hot_key(tables):
    """A third of the rows have one key, some none: bounds and slots hold, and the hot cell is ranked in parts."""
    rows = [(7, "same")] * 1000 + [(None, "x")] * 500 + [(i, "y") for i in range(1500)]
    out = sharding.assign(tables(rows).repartition(4), shards=6, cell_rows=50, order=("text",))
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(500)) for s in slots.values()) and len(slots) == 6


def test_overflow_fills_every_shard():
    """The settled ranges cover every row once and give each shard its bound, slots without gaps."""
    ring = sharding.Ring.of(5, 8)
    rng = random.Random(9)
    cells = [(n, n, rng.choice([0, 1, 5, 200])) for n in range(len(ring.owner))]
    limit = sharding.bounds(sum(c for _, _, c in cells), 5)
    used, covered = [0] * 5, Counter()
    for cell, first, end, shard, slot in sharding.settle_overflow(ring, cells, limit):
        assert slot == used[shard] and end > first == covered[cell]
        used[shard] += end - first
        covered[cell] += end - first
    assert used == limit and all(covered[c] == n for c, _, n in cells)


def test_sharding_of_odd_rows(tables, odd):
    got = sharding.assign(tables(odd), shards=4, order=("text",)).collect()
    assert len(got) == len(odd) and sorted(Counter(r["shard"] for r in got).values()) == [2, 3, 3, 3]
    assert sharding.assign(tables([])).count() == 0
    clash = tables(odd).selectExpr("doc_id", "text AS slot", "1 AS _cell", "2 AS c0", "3 AS `a.b`")
    assert sharding.assign(clash).columns == ["doc_id", "_cell", "c0", "a.b", "shard", "slot"] and sharding.assign(clash).count() == len(odd)


def test_nearest_search_is_exact_among_near_copies():
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.normal(size=(3000, 64)), rng.normal(size=64) + 0.05 * rng.normal(size=(600, 64))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = ann.fit(x, len(x))  # all cells are probed
    ids, cells, asked = np.arange(len(x)), found.cells(x), np.arange(3000, 3600, 20)
    q, v, s = ann.search(found, ids, cells, found.codes(x, cells), x, asked, x[asked], 20)
    want = np.argsort(-(x[asked] @ x.T), axis=1)[:, :20]
    assert all(set(v[q == k]) == set(w.tolist()) for k, w in zip(asked.tolist(), want))


@pytest.mark.parametrize("spread", [0.3, 9.0])
def test_codes_decide_which_products_are_taken(monkeypatch, spread):
    """Fitted codes find the true neighbours with few exact products; random codes in their place lose them."""
    rng = np.random.default_rng(24)
    x = rng.normal(size=(80, 32))[rng.integers(80, size=6000)] + spread * rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index, asked = ann.fit(x, len(x)), np.arange(0, 6000, 20)
    cells, exact = index.cells(x), x[asked] @ x.T
    codes, true = index.codes(x, cells), np.argsort(-exact, axis=1)[:, :20]
    index.probes = ann.probes_for(index, x[asked], [cells[t] for t in true])
    index.reach = ann.reach_for(index, x[asked], [(cells[t], codes[t], exact[i, t]) for i, t in enumerate(true)])

    def recall(codes):
        q, v, s = ann.search(index, np.arange(len(x)), cells, codes, x, asked, x[asked], 20)
        assert np.allclose(s, (x[q] * x[v]).sum(axis=1))
        return np.mean([len(set(v[q == k].tolist()) & set(t.tolist())) / 20 for k, t in zip(asked.tolist(), true)])

    assert recall(codes) >= 0.93 and recall(rng.integers(0, 256, codes.shape).astype(np.uint8)) < recall(codes) - 0.005
    near = index.products(x[asked], cells, codes)
    mark = np.sort(exact, axis=1)[:, -20] - index.reach
    assert np.mean(near >= mark[:, None]) < 0.2  # of all vectors, the share whose products are taken


def test_cells_of_two_centroids_are_ordered_like_all_sums(monkeypatch):
    monkeypatch.setattr(ann, "MOST_COARSE", 8)
    rng = np.random.default_rng(22)
    x = rng.normal(size=(6000, 16))
    found = ann.fit(x, 40_000)
    assert len(found.coarse) == 8 and len(found.fine) == 12 and found.size == 96
    sums = (found.coarse[:, None] + found.fine[None]).reshape(96, 16)
    assert np.allclose(found.centroids(np.arange(96)), sums)
    for most in (1, 7, 40, 96):
        for q, got in zip(x[:30], found.order(x[:30], most)):
            assert got.tolist() == sorted(np.argsort(-(sums @ q), kind="stable")[:most].tolist())
    score = sums @ x[0]
    assert found.places(x[0], np.arange(96)).tolist() == [int((score > s + 1e-9).sum()) for s in score]


@pytest.mark.parametrize("spread", [0.4, 5.0])
def test_neighbours_with_fine_cells_and_crowded_shards(spark, monkeypatch, spread):
    """Recall over clusters and without any, with two kinds of centroids, small shards and split queries."""
    for name, value in (("MOST_COARSE", 12), ("CELL_ROWS", 40), ("SHARD_ROWS", 200), ("TASK_QUERIES", 30), ("BLOCK", 16)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(23)
    x = (rng.normal(size=(20, 16))[rng.integers(20, size=3000)] + spread * rng.normal(size=(3000, 16))).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    exact = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(exact, -np.inf)
    hits = [len(got[q] & set(np.argsort(-exact[q])[:20].tolist())) for q in range(0, 3000, 20)]
    assert all(len(v) == 20 for v in got.values()) and np.mean(hits) >= 0.93 * 20


def test_neighbours_of_repeated_keys(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0]), (2, [2.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS `a.b`")
    got = ann.nearest_neighbours(vectors, vectors.where("vec_id = 0"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 1, 2.0), (0, 1, 2, 3.0), (0, 2, 1, 1.0), (0, 2, 2, 2.0), (0, 3, 2, 1.0), (0, 3, 2, 1.0)]


def test_packing_covers_every_id(tables, corpus, odd):
    path = P.path("byte_bpe_50k.json")
    hf = Tokenizer.from_file(path)
    special = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y \n", "<|endoftext |> <|endoftex"]
    rows = [(d, t) for d, t, _ in corpus if d >= 10] + odd + [(9000 + k, t) for k, t in enumerate(special)]
    ids = [np.array([*hf.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for _, t in rows]
    got = packing.pack_documents(tables(rows), path, P.PATTERN, shard_bytes=60_000).collect()
    pieces, sequences, copies = defaultdict(list), defaultdict(list), Counter(d for d, _ in rows)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, i in ((d, i) for (d, _), i in zip(rows, ids) if copies[d] == 1):
        at = 0
        for start, length, crc, tokens in sorted(pieces[d]):
            assert (start, tokens) == (at, len(i)) and crc == zlib.crc32(i[start : start + length].tobytes())
            at += length
        assert at == len(i)
    assert sum(n for p in pieces.values() for _, n, _, _ in p) == sum(map(len, ids))
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        short += at < packing.WINDOW
    shards = len({r["sequence_id"] >> 32 for r in got})
    assert shards > 1 and short <= shards
    assert packing.pack_documents(tables([]), path, P.PATTERN).count() == 0


def test_repeated_rows_are_packed_in_many_shards(tables):
    """A third of the table is one document; its copies fill as many shards as their bytes ask for."""
    rows = [(7, "the same text over and over again")] * 400 + [(i, prose(random.Random(i), "en", 40)) for i in range(1000, 1300)] + [(None, None)] * 100
    got = packing.pack_documents(tables(rows).repartition(3), P.path("byte_bpe_50k.json"), P.PATTERN, shard_bytes=60_000).collect()
    copies = Counter(r["sequence_id"] >> 32 for r in got if r["doc_id"] == 7 and r["start"] == 0)
    assert sum(copies.values()) == 400 and len(copies) >= 5 and max(copies.values()) < 120
    assert sum(r["start"] == 0 for r in got) == 800
    with pytest.raises(ValueError, match="cannot be called"):
        packing.pack_documents(tables([(1, "a")], "start long, text string"), P.path("byte_bpe_50k.json"), P.PATTERN, key="start")


def plain_pack(parts, window):
    """The greedy fill word for word: seeds by size, then the best-scored unused part, cut where it overflows."""
    pieces, sequence = [], 0
    for d, p in enumerate(parts):
        for start in range(0, len(p) - window + 1, window):
            pieces.append((d, start, window, sequence, 0))
            sequence += 1
    left = {d: len(p) % window for d, p in enumerate(parts) if len(p) % window}
    pool, size = sorted(left), dict(left)
    index = packing.Index([packing.remainder(parts[d], window) for d in pool])
    for seed in sorted(pool, key=lambda d: (-size[d], d)):
        while left[seed]:
            scores, filled, turn = index.scores(pool.index(seed)), 0, [seed]
            turn += sorted((d for d in pool if left[d] and d != seed), key=lambda d: (-scores[pool.index(d)], d))
            for d in turn:
                n = min(left[d], window - filled)
                if n:
                    pieces.append((d, len(parts[d]) - left[d], n, sequence, filled))
                    left[d] -= n
                    filled += n
            sequence += 1
    return pieces


def test_packing_fills_greedily_by_score():
    rng = np.random.default_rng(30)
    parts = [rng.integers(0, 90, size=n).astype("<u4") for n in rng.integers(1, 150, size=60)]
    assert packing.pack(parts, 64) == plain_pack(parts, 64)


def test_bm25_index_equals_formula():
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 60, size=n).astype("<u4") for n in (5, 40, 80, 1, 30, 22, 9)]
    index = packing.Index(parts)
    mean = np.mean([len(p) for p in parts])
    for seed in range(len(parts)):
        want = np.zeros(len(parts))
        for term in set(parts[seed].tolist()):
            df = sum(term in p for p in parts)
            idf = np.log((len(parts) - df + 0.5) / (df + 0.5))
            for d, p in enumerate(parts):
                tf = int((p == term).sum())
                if tf and idf > 0:
                    want[d] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(p) / mean))
        assert np.allclose(index.scores(seed), want)


def test_packing_puts_related_texts_together():
    rng = np.random.default_rng(5)
    topic = [rng.integers(100 * t, 100 * t + 80, size=700).astype("<u4") for t in range(8) for _ in range(2)]
    order = rng.permutation(16)
    seen = defaultdict(set)
    for doc, _, length, sequence, _ in packing.pack([topic[i] for i in order], 1400):
        if length > 300:
            seen[sequence].add(order[doc] // 2)
    assert sum(len(s) == 1 for s in seen.values()) >= 7


def test_packing_finds_related_texts_across_the_table(tables):
    rng = random.Random(9)
    words = [[f"{t}{w}" for w in rng.sample(["stone", "river", "cloud", "engine", "violin", "harvest", "lantern", "copper", "meadow", "signal"], 10)] for t in "bcdfghjklm"]
    rows = [(i, " ".join(rng.choice(words[i % 10]) for _ in range(120))) for i in range(400)]
    got = packing.pack_documents(tables(rows), P.path("byte_bpe_50k.json"), P.PATTERN, shard_bytes=60_000).collect()
    shards, whole = defaultdict(Counter), len({r["sequence_id"] >> 32 for r in got})
    for r in got:
        if r["start"] == 0:
            shards[r["sequence_id"] >> 32][r["doc_id"] % 10] += 1
    # dealt by hash, a shard would hold all ten topics
    assert whole > 5 and np.mean([len(c) for c in shards.values()]) < 4


def test_packing_counts_over_the_whole_table(tables):
    rng = np.random.default_rng(14)
    parts = [rng.integers(0, 60, size=n).astype("<u4") for n in (5, 40, 80, 1, 30, 22, 9, 16)]
    rows = [(str(i), bytearray(p.tobytes())) for i, p in enumerate(parts)]
    corpus = packing.count_corpus(tables(rows, "key string, ids binary").repartition(3), 16)
    left = [p[len(p) // 16 * 16 :] for p in parts if len(p) % 16]
    assert corpus.size == len(left) and np.isclose(corpus.mean, np.mean([len(p) for p in left]))
    assert all(corpus.have[t] == sum(t in p for p in left) for t in range(len(corpus.have)))
    index, idf = packing.Index(left[:3], corpus), corpus.idf()
    for d, p in enumerate(left[:3]):
        tf = Counter(p.tolist())
        want = sum(idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(p) / corpus.mean)) for t, n in tf.items() if idf[t] > 0)
        assert np.isclose(index.scores(d)[d], want)


def test_peeling_recovers_the_difference():
    rng = random.Random(10)
    a = prose(rng, "en", 900)
    b = iblt.edited(a, prose(rng, "fr", 900))
    mine, theirs = set(iblt.digests(a).tolist()), set(iblt.digests(b).tolist())
    assert iblt.recover(a, b) == (mine - theirs, theirs - mine)
    assert iblt.recover(a, a) == (set(), set()) and iblt.recover("", a)[1] == mine


def test_differences_retry_until_they_are_whole():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, size=n, dtype=np.uint64)) for n in (0, 1, 10, 300, 5000)]
    other = [np.unique(np.concatenate([s[::2], rng.integers(0, 1 << 63, size=7, dtype=np.uint64)])) for s in sets]
    assert iblt.differences(sets, other) == [len(np.setxor1d(a, b)) for a, b in zip(sets, other)]


def test_fingerprints_follow_the_next_document(tables, odd):
    rows = [(d, t) for d, t in odd if d is not None and d != 4] + [(i, prose(random.Random(i), "de", 90)) for i in range(10, 60)]
    order = sorted(rows)
    random.Random(11).shuffle(rows)
    for size in (1000, 7):
        got = {r["doc_id"]: r for r in iblt.fingerprint_pairs(tables(rows).repartition(3), range_rows=size).collect()}
        assert len(got) == len(rows)
        for k, (d, t) in enumerate(order):
            t, n = t or "", order[(k + 1) % len(order)][1] or ""
            e, r = iblt.edited(t, n), got[d]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
            for other, name in ((e, "near_edited"), (n, "near_next")):
                a, b = set(iblt.digests(t).tolist()), set(iblt.digests(other).tolist())
                assert r[name] == pytest.approx(1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b)))


def test_differences_split_where_a_table_would_be_too_large(monkeypatch):
    monkeypatch.setattr(iblt, "MOST_CELLS", 96)
    rng = np.random.default_rng(16)
    left = [np.unique(rng.integers(0, 1 << 63, size=n, dtype=np.uint64)) for n in (3, 700, 4000)]
    right = [np.unique(np.concatenate([s[: len(s) // 3], rng.integers(0, 1 << 63, size=40, dtype=np.uint64)])) for s in left]
    assert iblt.differences(left, right) == [len(np.setxor1d(a, b)) for a, b in zip(left, right)]


def test_fingerprints_of_crowded_keys(tables):
    """Many rows without a key and many copies of one row; each is followed as in one sorted list, ties aside."""
    rng = random.Random(17)
    rows = [(None, prose(rng, "en", 12)) for _ in range(150)] + [(5, "one text again and again")] * 140 + [(None, "b c")] * 90 + [(i, prose(rng, "fr", 12)) for i in range(4, 60)]
    rng.shuffle(rows)
    got = iblt.fingerprint_pairs(tables(rows).repartition(4), range_rows=20).collect()
    assert len(got) == len(rows) and Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    sha = lambda a, b: hashlib.sha256(iblt.edited(a, b).encode()).hexdigest()
    followed = Counter(r["edited_sha256"] for r in got)
    # of equal rows, all but one are followed by their own text
    assert followed[sha("one text again and again", "one text again and again")] >= 139 and followed[sha("b c", "b c")] >= 89
    texts = {d: [t for e, t in rows if e == d] for d, _ in rows}
    for r in got:
        assert any(r["edited_sha256"] == sha(t, n) for t in set(texts[r["doc_id"]]) for e in texts for n in set(texts[e])) or r["doc_id"] is None
    one = {r["doc_id"]: r for r in got}
    for d in range(6, 59):
        assert one[d]["edited_sha256"] == sha(texts[d][0], texts[d + 1][0])
    assert one[59]["edited_sha256"] in {sha(texts[59][0], t) for t in texts[None]}
    with pytest.raises(ValueError, match="cannot be called"):
        iblt.fingerprint_pairs(tables([(1, "a")], "n_chars long, text string"), key="n_chars")


def test_likeness_of_every_length():
    """The recovered difference gives the Dice coefficient of the paragraphs at each length of a text."""
    rng = random.Random(18)
    text = prose(rng, "en", 400)
    for size in [*range(1, 60, 7), *range(380, 430, 3), 900, 1500, 2000]:
        a, b = text[:size], iblt.edited(text[:size], prose(rng, "fr", 40))
        x, y = iblt.digests(a), iblt.digests(b)
        (differing,) = iblt.differences([x], [y])
        plain_a, plain_b = Counter(iblt.paragraphs(a)), Counter(iblt.paragraphs(b))
        both, all_ = sum((plain_a & plain_b).values()), sum(plain_a.values()) + sum(plain_b.values())
        assert iblt.likeness(len(x), len(y), differing) == pytest.approx(2 * both / all_)


def test_fingerprints_of_odd_rows(tables):
    same = tables([(1, "one text here"), (2, "one text here"), (2, None), (None, "x")])
    got = iblt.fingerprint_pairs(same)
    assert got.where("n_chars = 13").select("fingerprint").distinct().count() == 1 and got.count() == 4
    assert iblt.fingerprint_pairs(tables([(1, "alone with itself")])).first()["near_next"] == 1.0
    assert iblt.fingerprint_pairs(tables([])).count() == 0


LINES = ["plain prose of no licence at all", "Released under the MIT License.", "and so it was  released  under the MIT\nlicense! as all else", "Licensed under CC BY-NC-4.0", "All rights reserved", "Licensed under the Apache License, Version 2.0", licenses.TEMPLATES["mit"], licenses.TEMPLATES["isc"].replace("fee", "payment"), "under the license", "// SPDX-License-Identifier: BSD-3-Clause"]
MIT = licenses.TEMPLATES["mit"]
CODE = "def area(r):\n    return 3.14159 * r * r\n\n\nclass Shape:\n    pass\n" * 20


def in_paragraphs(mark=""):
    """The MIT text as published: a title, a copyright line and three paragraphs of short lines."""
    parts, lines = re.split(r"(?<=conditions: )|(?<=Software\. )(?=THE)", MIT), []
    for part in ["MIT License", "Copyright (c) 2020 A. Writer", *parts]:
        words = part.split()
        lines += [" ".join(words[i : i + 11]) for i in range(0, len(words), 11)] + [""]
    return "\n".join(f"{mark} {line}".strip() for line in lines) + "\n"


def scan_with_sql(rows):
    con = duckdb.connect(config={"memory_limit": "3GB"})
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return con.execute(licenses.oracle() + " ORDER BY doc_id").fetchall()


def test_licences_equal_all_comparisons(tables, odd):
    rng = random.Random(12)
    rows = [(i, "\n".join(rng.choice(LINES) for _ in range(rng.randrange(1, 4)))) for i in range(60)] + [(100, MIT.replace(". ", ".\n").replace("any person", "anyone"))]
    odds = list(dict.fromkeys(t for _, t in odd))
    rows += [(1000 + k, t) for k, t in enumerate(odds)]
    got = licenses.find_licenses(tables(rows).repartition(2)).drop("text").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == scan_with_sql(rows)
    assert sum(r["n_licenses"] > 0 for r in got) > 30 and got[60]["license"] == "mit"
    assert licenses.find_licenses(tables([])).count() == 0
    clash = tables(rows).selectExpr("doc_id AS license", "text", "1 AS _pairs", "2 AS `x.y`")
    assert licenses.find_licenses(clash).where("license IS NOT NULL").count() == sum(r["license"] is not None for r in got)
    assert licenses.find_licenses(tables([(1, MIT), (1, MIT), (None, MIT)])).where("license = 'mit'").count() == 3


def test_licences_within_other_text(tables):
    """Headers above code, commented or not, published in paragraphs, and lines within prose or broken over two."""
    cases = {
        1: (in_paragraphs() + CODE, "mit"),
        2: (in_paragraphs("#") + CODE, "mit"),
        3: (CODE + in_paragraphs(" *") + CODE, "mit"),
        4: ("Words before it. Released under the MIT License. Words behind it.", "mit-line"),
        5: ("some words, released under\nthe MIT License, some more", "mit-line"),
        6: (f"/* {licenses.TEMPLATES['gpl-3.0-notice'].replace('. See', '.\n\n * See')} */\n{CODE}", "gpl-3.0-notice"),
        7: (f"{CODE}{licenses.TEMPLATES['bsd-3-clause']}", "bsd-3-clause"),
        8: ("# SPDX-License-Identifier: MPL-2.0\n" + CODE, "spdx-mpl-2.0"),
        9: (CODE * 30, None),
        10: ("The license of the software is granted to any person who has a copy of this notice. " * 50, None),
    }
    rows = [(d, t) for d, (t, _) in cases.items()]
    got = licenses.find_licenses(tables(rows)).drop("text").orderBy("doc_id").collect()
    assert {r["doc_id"]: r["license"] for r in got} == {d: name for d, (_, name) in cases.items()}
    assert [tuple(r) for r in got] == scan_with_sql(rows)
    assert got[1]["licenses"].startswith("mit:") and got[0]["license_dice"] > 0.95


def test_licence_anchors_lose_no_match():
    for body in licenses.TEMPLATES.values():
        pairs = licenses.bigrams(body)
        words = licenses.anchors(pairs, licenses.THRESHOLD)
        rest = [p for p in pairs if not set(p.split()) & set(words)]
        assert not rest or 2 * len(rest) / (len(pairs) + len(rest)) < licenses.THRESHOLD


def test_no_python_in_the_licence_scan(tables, corpus):
    plan = licenses.find_licenses(tables([(d, t) for d, t, _ in corpus]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_likeness_does_not_jump_with_the_length_of_a_text():
    rng = random.Random(31)
    words = prose(rng, "en", 200).split()
    while len(" ".join(words)) > 408:
        words.pop()
    text, less = " ".join(words), " ".join(words[:-2])
    cyrillic = " ".join("".join(rng.choice("абвгдежзиклмнопрстуя") for _ in range(6)) for _ in range(50))
    for a, b in ((text, less), (cyrillic, "ещё одно " + cyrillic)):
        mine, theirs = iblt.digests(a), iblt.digests(b)
        assert iblt.likeness(len(mine), len(theirs), len(np.setxor1d(mine, theirs))) > 0.8


def test_no_link_of_a_crowded_bucket_is_lost(tables):
    """Sixty pairs in shared buckets, alike within the pair only: every alike pair that shares a variant is linked."""
    rng = random.Random(77)
    base = ["b" + str(i) for i in range(160)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(5, 155), 4):
            words[at] = f"x{i}.{at}"
        other = list(words)
        other[rng.randrange(5, 155)] = f"y{i}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets = [simhash.shingles(t) for _, t in rows]
    keys = [set(simhash.variants(simhash.least(s)).tolist()) for s in sets]
    root = list(range(len(rows)))
    crowded = 0
    for i in range(len(rows)):
        for j in range(i):
            if keys[i] & keys[j]:
                crowded += 1
                if simhash.jaccard(sets[i], sets[j]) >= 0.8:
                    root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(tables(rows)).collect()}
    assert crowded > 500 and len(set(root)) > 20
    assert got == dict(enumerate(root))


def test_the_bound_leaves_out_no_alike_pair(spark):
    rng = random.Random(5)
    rows, want = [], []
    for i in range(200):
        words = ["v" + str(rng.randrange(100_000)) for _ in range(rng.choice((4, 30, 300, 3000)))]
        other = [w if rng.random() > 0.03 * (i % 8) else "z" for w in words]
        a, b = (simhash.shingles(" ".join(x)) for x in (words, other))
        rows.append((i, len(a), simhash.shingle_map(a).tolist(), len(b), simhash.shingle_map(b).tolist()))
        want.append(simhash.jaccard(a, b))
    df = spark.createDataFrame(rows, "i long, n long, p array<long>, m long, q array<long>")
    side = lambda n, p: F.struct(F.col(n).alias("size"), *[F.col(p)[j].alias(f"m{j}") for j in range(simhash.MAP_LONGS)])
    kept = {r["i"] for r in df.select("i", side("n", "p").alias("a"), side("m", "q").alias("b")).where(simhash._may_be_alike("a", "b", 0.8)).collect()}
    assert {i for i, w in enumerate(want) if w >= 0.8} <= kept and len(kept) < 160
