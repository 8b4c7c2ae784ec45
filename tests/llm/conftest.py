from __future__ import annotations

import random

import pytest

WORDS = {
    "en": "the of and to in is that it was for on with as his they at be this from have by one had not but what all were when we there can an your which their said if".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer über größe schön".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont elle été comme été très où déjà français être".split(),
}


def prose(rng: random.Random, lang: str, words: int) -> str:
    out = []
    for _ in range(words):
        w = rng.choice(WORDS[lang]) + (rng.choice(WORDS[lang]) if rng.random() < 0.4 else "")
        out.append(w + (". " if rng.random() < 0.1 else "\n" if rng.random() < 0.04 else " "))
    return "".join(out).strip()


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang): prose with exact and near copies."""
    rng = random.Random(5)
    rows = []
    for i in range(140):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, prose(rng, lang, rng.choice([5, 60, 300])), lang))
    text = rows[3][1] + " " + rows[4][1]
    for k in range(20):
        words = text.split()
        words[k % len(words)] += "x"
        rows.append((200 + k, text if k % 2 else " ".join(words), "en"))
    return rows


@pytest.fixture(scope="session")
def odd():
    """Nulls in both columns, empty, blank and letterless texts, repeats, a very long text, and odd characters."""
    long = "lorem ipsum dolor " * 20_000
    return [(None, None), (1, ""), (2, " \n\t "), (3, "12345 67"), (4, "same words here again"), (4, "same words here again"), (5, long), (6, "ß ü 😀 İ ſ K\x1cend"), (7, None), (None, "no id"), (1 << 60, "large id")]


@pytest.fixture
def tables(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make
