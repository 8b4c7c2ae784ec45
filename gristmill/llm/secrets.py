"""Secret scans: three fixed patterns, and a token-efficiency test for random strings.

Ordinary words and identifiers cost few tokens under a vocabulary learnt from text;
random strings cost nearly one token for two characters. A run of key characters
with a low number of characters per token is reported, or, if words around them hide
it in the run's ratio, those neighbouring parts of it that each have a low number.
Known digests (hexadecimal of a usual digest length), UUIDs and plain numbers are
excluded, and what a fixed pattern has found already.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.bpe import read_ranks
from gristmill.llm.common import fresh, map_columns

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LENGTH = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Runs that the token test looks at, and the characters per token below which one is random.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
CHARS_PER_TOKEN = 2.0
#: Lengths in hexadecimal digits of CRC-64/MD5/SHA-1/SHA-224/SHA-256/SHA-384/SHA-512.
DIGEST_LENGTHS = (16, 32, 40, 56, 64, 96, 128)
_HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Parts of a run, UUIDs whole; parts and groups of them are tested from these lengths on.
PART = re.compile(rf"(?<![A-Za-z0-9]){_UUID.pattern}(?![A-Za-z0-9])|[A-Za-z0-9]+")
LEAST_PART, LEAST_RUN = 4, 16
PIECE = 1 << 12


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LENGTH]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def known(run: str) -> bool:
    """Digests, UUIDs and numbers: not secrets by themselves."""
    if _UUID.fullmatch(run) or len(run) in DIGEST_LENGTHS and _HEXADECIMAL.fullmatch(run):
        return True
    return not any(c.isalpha() for c in run)


def plain_case(run: str) -> bool:
    """Letters only, each part in one case or capitalised: short parts say nothing, so its whole ratio does not count."""
    parts = re.split(r"[-_/+=]+", run)
    return not any(c.isdigit() for c in run) and all(not p or p.islower() or p.isupper() or p[0].isupper() and p[1:].islower() for p in parts)


def dense(run: str, tokens: tiktoken.Encoding) -> bool:
    """Few characters per token, and nothing known."""
    return not known(run) and len(run) < CHARS_PER_TOKEN * sum(len(tokens.encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def dense_groups(run: str, tokens: tiktoken.Encoding) -> list[tuple[int, int]]:
    """(start, end) of the longest groups of neighbouring dense parts."""
    groups: list[tuple[int, int]] = []
    joined = False
    for m in PART.finditer(run):
        if m.end() - m.start() >= LEAST_PART and dense(m.group(), tokens):
            groups[-1:] = [(groups[-1][0], m.end())] if joined else groups[-1:] + [m.span()]
            joined = True
        else:
            joined = False
    return [(a, b) for a, b in groups if b - a >= LEAST_RUN and not known(run[a:b])]


def random_spans(text: str, tokens: tiktoken.Encoding) -> list[tuple[int, int, int]]:
    found = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if known(run):
            continue
        if not plain_case(run) and dense(run, tokens):
            found.append((m.start(), 3, m.end()))
        else:
            found += [(m.start() + a, 3, m.start() + b) for a, b in dense_groups(run, tokens)]
    return found


def scan(text: str | None, tokens: tiktoken.Encoding) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a whole text; added spans overlap no base span."""
    if not text:
        return [], []
    base = base_spans(text)
    added, at = [], 0
    for span in random_spans(text, tokens):
        while at < len(base) and base[at][2] <= span[0]:
            at += 1
        if not any(b[0] < span[2] and span[0] < b[2] for b in base[at : at + 8]):
            added.append(span)
    return base, sorted(base + added)


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def mask(text: str, spans: list[tuple[int, int, int]], with_: str = "[SECRET]") -> str:
    """The text with each maximal run of overlapping spans replaced."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], with_]
        at = end
    return "".join(out) + text[at:]


def find_secrets(rows: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with counts and spans of each whole text.

    Null and empty texts have none. Texts of any length are scanned whole, their runs piece
    by piece. Repeated rows are scanned each. A kept column called like a column of the
    result gives way. An empty table gives none. No shuffle.
    """

    def start():
        tokens = encoding(path, pattern)

        def work(texts):
            found = [scan(t, tokens) for t in texts]
            counts = {f"n_{KINDS[kind]}": [sum(s[1] == kind for s in base) for base, _ in found] for kind in range(3)}
            return counts | {"base_sha256": [hashlib.sha256(render(base).encode()).hexdigest() for base, _ in found], "spans": [render(spans) for _, spans in found]}

        return work

    added = {f"n_{k}": pa.int64() for k in KINDS[:3]} | {"base_sha256": pa.string(), "spans": pa.string()}
    return map_columns(rows, [text], keep, added, start)


def mask_secrets(rows: DataFrame, path: str, pattern: str, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``rows`` with every span of ``text`` masked; ``length``, if such a column is there,
    becomes the new number of code points of each changed text. Nulls stay null, empty texts
    empty; texts of any length are masked whole, repeated rows alike. All columns stay."""
    sized = length in rows.columns
    masked, size = fresh("_masked", rows.columns), fresh("_size", rows.columns)

    def start():
        tokens = encoding(path, pattern)

        def work(texts, sizes=None):
            spans = [scan(t, tokens)[1] for t in texts]
            new = [mask(t, s) if s else t for t, s in zip(texts, spans)]
            out = {masked: new}
            if sized:
                out[size] = [len(t) if s else n for t, s, n in zip(new, spans, sizes)]
            return out

        return work

    added = {masked: pa.string()} | ({size: pa.int64()} if sized else {})
    done = map_columns(rows, [text, length] if sized else [text], rows.columns, added, start)
    kind = {text: F.col(masked)} | ({length: F.col(size).cast(rows.schema[length].dataType)} if sized else {})
    return done.select(*[kind.get(c, F.col(f"`{c}`")).alias(c) for c in rows.columns])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
