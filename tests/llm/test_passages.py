"""Repeated passages, ranked search and collocations against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__
from gristmill.llm import lexical, phrases, rlz

from tests.llm.conftest import WORDS, prose

LAST = rlz.LAST


def plain_repeats(rows, window):
    """By definition: all windows of all texts, the first place of each."""
    split = [(LAST if k is None else k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    first = {}
    for k, ws in split:
        for i in range(len(ws) - window + 1):
            w = tuple(ws[i : i + window])
            first[w] = min(first.get(w, (k, i)), (k, i))
    out = []
    for k, ws in split:
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < (k, i):
                gone.update(range(i, i + window))
        out.append((None if k == LAST else k, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return Counter(out)


def copies(seed):
    """Texts made of passages of others, with edits, repeats within a text, and passages of nearly a window."""
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([10, 19, 20, 21, 45, 150]))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.choice([0, 1, 2, 4])):
            part = list(rng.choice(pool))
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = f"x{rng.randrange(5)}"
            words += part + [f"y{rng.randrange(3000)}" for _ in range(rng.choice([0, 1, 15]))]
        rows.append((rng.randrange(100), rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(500, "a b " * 100), (501, "a b " * 90), (502, "lorem ipsum dolor sit " * 400)]
    return rows


@pytest.mark.parametrize("seed, small", [(1, False), (2, True), (3, True)])
def test_repeats_are_those_of_all_windows(spark, tables, monkeypatch, seed, small):
    if small:  # many volumes, shards, blocks and shares
        for name, value in (("VOLUME_BYTES", 2000), ("SHARD_SEEDS", 20), ("BLOCK_WORDS", 16), ("SHARE", 3), ("SUSPECT_WINDOWS", 7)):
            monkeypatch.setattr(rlz, name, value)
    rows = copies(seed)
    got = rlz.remove_repeats(tables(rows).repartition(5)).collect()
    assert Counter(map(tuple, got)) == plain_repeats(rows, 20)
    assert sum(r["n_removed"] for r in got) > 1000


def test_repeats_of_odd_rows(tables, odd, monkeypatch):
    rows = odd + [(None, "u v w x y z " * 9), (None, "u v w x y z " * 9), (3, "u v w x y z " * 9), (77, odd[6][1])]
    assert Counter(map(tuple, rlz.remove_repeats(tables(rows)).collect())) == plain_repeats(rows, 20)
    assert rlz.remove_repeats(tables([])).collect() == []
    with pytest.raises(TypeError):
        rlz.remove_repeats(tables([("a", "b")], "doc_id string, text string"))
    with pytest.raises(ValueError):
        rlz.remove_repeats(tables([(1, "b")], "kept long, text string"), key="kept")


def test_other_columns_and_names(tables):
    rows = [(1, "p q r s " * 10, 5), (2, "p q r s " * 10, 6)]
    got = rlz.remove_repeats(tables(rows, "id int, body string, kept int"), key="id", text="body", window=12)
    assert Counter(map(tuple, got.collect())) == plain_repeats([r[:2] for r in rows], 12) and got.schema["id"].dataType.simpleString() == "int"


def test_factors_are_greedy_and_longest():
    block = rlz.Reference([*b"abcdefghijklmnopqrstuvwxyzabcdefgXYZ"], 0, 0)
    phrase = [block.number.get(w, -1) for w in b"abcdefgXYZ.mnopqrstu"]
    assert block.factors(phrase, 1, 0) == [(0, 10), (11, 9)]
    own = [block.number[w] for w in b"abcdefgXYZ"]
    assert block.factors(own, 0, 26) == [(0, 7)]  # at its own place only the earlier match counts


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(rows, items, top):
    cut = [(k, Counter(plain_terms(t))) for k, t in rows]
    cut = [(k, c) for k, c in cut if c]
    size, length = len(cut), sum(c.total() for _, c in cut)
    have = Counter(t for _, c in cut for t in c)
    out = []
    for item, text in items:
        scored = []
        for k, c in cut:
            m = 100 - 75 + (75 * c.total() * size) // length
            s = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * have[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if c[t])
            if s > 0:
                scored.append((-s, k is None, k or 0, k))
        out += [(item, i + 1, k, -s) for i, (s, _, _, k) in enumerate(sorted(scored)[:top])]
    return Counter(out)


@pytest.mark.parametrize("top", [1, 10, 1000])
def test_search_against_the_formulas(tables, odd, corpus, top, monkeypatch):
    monkeypatch.setattr(lexical, "RANGE", 16)
    rows = odd + [(k, t) for k, t, _ in corpus]
    items = [(1, "the of the über"), (1, "the of the über"), (2, None), (3, ""), (None, "Größe schön K\x1cEND 😀"), (4, "nowhere zzz"), (5, " ".join(t or "" for _, t, _ in corpus[:5]))]
    found = lexical.search(tables(rows).repartition(3), tables(items, "item_id long, text string"), top=top)
    assert Counter(map(tuple, found.collect())) == plain_search(rows, items, top)


def test_search_in_blocks_of_items(tables, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 2)
    rows, items = [(k, t) for k, t, _ in corpus], [(i, corpus[i][1]) for i in range(5)]
    found = lexical.search(tables(rows), tables(items, "item_id int, text string"), top=3)
    assert Counter(map(tuple, found.collect())) == plain_search(rows, items, 3) and found.schema["item_id"].dataType.simpleString() == "int"


def test_search_of_nothing(tables):
    none, items = tables([]), tables([(1, "a")], "item_id long, text string")
    assert lexical.search(none, items).collect() == [] and lexical.search(tables([(1, "a")]), items.limit(0)).collect() == []
    assert lexical.search(tables([(1, ""), (2, None)]), items).collect() == []
    with pytest.raises(TypeError):
        lexical.search(tables([("a", "b")], "doc_id string, text string"), items)


def test_radix_order_sorts():
    keys = np.random.default_rng(0).integers(0, 1 << 40, size=5000)
    assert np.array_equal(lexical.radix_order(keys, 3), np.argsort(keys, kind="stable"))


def plain_phrases(rows, least, most, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, most + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    often = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = {(lang, ws[i:j]) for (lang, ws), a in often.items() for i in range(len(ws)) for j in range(i + 1, len(ws) + 1) if j - i < len(ws) and 100 * a >= 100 * f[lang, ws[i:j]]}
    by = defaultdict(list)
    for (lang, ws), a in often.items():
        if (lang, ws) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            by[lang].append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in by.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}


@pytest.fixture(scope="module")
def sayings():
    rng = random.Random(9)
    fixed = ["as a matter of fact", "New York City", "once upon a time", "kick the bucket", "à la carte"]
    out = []
    for i in range(150):
        lang = rng.choice(["en", "de", None])
        parts = []
        for _ in range(rng.randrange(12)):
            parts.append(rng.choice(fixed) if rng.random() < 0.4 else prose(rng, "en", rng.randrange(1, 6)))
            parts.append(rng.choice([" ", "  ", ". ", "\t", ", ", "\n", " ; "]))
        out.append(("".join(parts), lang))
    return out + [(None, "en"), ("", None), ("a b " * 300, "en"), ("a b " * 300, "xx"), ("K\x1cend \x0b K\x1cend", "xx")]


@pytest.mark.parametrize("least, most, shard", [(4, 5, 150_000), (4, 5, 300), (2, 3, 40), (10, 4, 500)])
def test_phrases_by_definition(tables, sayings, monkeypatch, least, most, shard):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    rows = tables([(*r, 1) for r in sayings], "text string, lang string, n long").repartition(4)
    got = phrases.collocations(rows, least=least, most=most, top=2000)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = set(map(tuple, got.collect()))
    assert found == plain_phrases(sayings, least, most, 2000) and len(found) > 20


def test_phrases_of_nothing_and_ranks(tables, sayings):
    schema = "text string, lang string"
    assert phrases.collocations(tables([], schema)).collect() == [] and phrases.collocations(tables(sayings[:3], schema)).collect() == []
    top = phrases.collocations(tables(sayings, schema), least=4, top=3)
    assert set(map(tuple, top.collect())) == plain_phrases(sayings, 4, 5, 3)
    with pytest.raises(ValueError):
        phrases.collocations(tables([("a", "b")], "text string, phrase string"), lang="phrase")


def test_automaton_counts_all_substrings():
    rng = random.Random(3)
    runs = [[rng.randrange(4) for _ in range(rng.randrange(1, 40))] for _ in range(30)]
    automaton = phrases.Automaton()
    for run in runs:
        automaton.add(run)
    count, before, behind = Counter(), defaultdict(set), defaultdict(set)
    for run in runs:
        for k in range(2, 6):
            for i in range(len(run) - k + 1):
                w = tuple(run[i : i + k])
                count[w] += 1
                before[w].add(run[i - 1] if i else -1)
                behind[w].add(run[i + k] if i + k < len(run) else -1)
    one = lambda s: next(iter(s)) if len(s) == 1 else -1
    assert {w: (n, b, e) for w, n, b, e in automaton.substrings(5)} == {w: (n, one(before[w]), one(behind[w])) for w, n in count.items()}
    direct = [x for run in runs for x in phrases.direct(run, 0, len(run), 5)]
    assert Counter({w: n for w, n in count.items()}) == sum((Counter({w: n}) for w, n, *_ in direct), Counter())


def test_registered(spark, corpus, sayings, tmp_path):
    docs = [(k, t, lang) for k, t, lang in corpus] + [(1000 + i, t, lang) for i, (t, lang) in enumerate(sayings)]
    docs = [(k, f"{t or ''} once more and again", lang) for k, t, lang in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(i, corpus[i][1]) for i in range(6)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, run = [d[:2] for d in docs], lambda name: [tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()]
    assert Counter(run("op11_substring_dedup")) == Counter({(k, n, m, hashlib.sha256(kept.encode()).hexdigest()): c for (k, n, m, kept), c in plain_repeats(rows, 20).items()})
    assert Counter(run("op12_lexical_search")) == plain_search(rows, items, 10)
    assert set(run("op13_phrase_collocations")) == plain_phrases([d[1:] for d in docs], 100, 5, 2000)
