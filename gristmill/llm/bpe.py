"""Byte-level BPE as a lazily determinised finite-state transducer, and its inverse.

Every prefix of a byte string has one last token in its BPE encoding, and a token
follows another exactly if the two are the encoding of their joint bytes. So the
encoding is a path through a non-deterministic transducer that either extends a
partial token along the vocabulary's trie or ends it behind a compatible one. Its
subset construction is done on demand: a state holds the unfinished partial tokens,
each with the tokens not yet agreed upon, and a transition emits what all of them
share. No token waits longer than the longest vocabulary entry. States are kept in a
table of bounded size, which is simply begun anew when full.

Decoding goes through an incremental UTF-8 machine that keeps an unfinished character
until its remaining bytes arrive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from gristmill.llm.common import map_columns

MAX_STATES = 400_000
MAX_MEMO = 300_000
MAX_PAIRS = 500_000
#: Pretokens of one text that are handled at once, so that a text of any length needs bounded memory.
SLICE = 200_000
# Characters that ``regex`` takes for letters or digits and the splitter of
# tiktoken 0.14 does not, for it follows an earlier version of Unicode.
NEWER = regex.compile(
    "[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    "\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    "\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    "\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
#: Quick test for whether a text can have any of them, and a character of neither kind to stand in.
MAYBE_NEWER = re.compile("[\u0558-\U0003fc3f]")
NEITHER = "\ue000"
#: White space of the pattern, as Unicode's White_Space property has it.
SPACE = r"\p{White_Space}"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def compile_pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"\s", SPACE).replace(r"\S", rf"\P{{White_Space}}"))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE by definition: join the adjacent pair of least rank, the leftmost first, while there is one."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class _State(dict):
    """byte -> (next state, emitted tokens), filled in when first taken."""

    __slots__ = ("configs", "owner")

    def __missing__(self, byte: int) -> tuple[_State, tuple[int, ...]]:
        step = self[byte] = self.owner.move(self.configs, byte)
        return step


class Transducer:
    """Encoder of single pretokens for a vocabulary ``ranks`` that has all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.inner: list[bool] = [False]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                after = self.child.get(key)
                if after is None:
                    after = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = after
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self.state((((), -1, 0),))

    def state(self, configs: tuple) -> _State:
        known = self.states.get(configs)
        if known is None:
            known = self.states[configs] = _State()
            known.configs, known.owner = configs, self
        return known

    def compatible(self, left: int, right: int, key: int) -> bool:
        """Whether the encoding of the two tokens' joint bytes is these two tokens."""
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        known = self.pairs[key] = merge(self.bytes_of[left] + self.bytes_of[right], self.ranks) == [left, right]
        return known

    def move(self, configs: tuple, byte: int) -> tuple[_State, tuple[int, ...]]:
        """Determinise one transition: the state it leads to and the tokens it emits.

        A configuration is (tokens not yet emitted, last token, trie node of the partial
        token); the last one of a state is the path whose tokens end right here.
        """
        child, token_at, inner, pairs = self.child, self.token_at, self.inner, self.pairs
        target, ended = [], None
        for config in configs:
            waiting, last, node = config
            after = child.get(node << 8 | byte)
            if after is None:
                continue
            if ended is None and (token := token_at[after]) >= 0:
                if last < 0:
                    ended = (token,)
                elif (fits := pairs.get(key := last << 32 | token)) or fits is None and self.compatible(last, token, key):
                    ended = (*waiting, token)
            if inner[after]:
                target.append((waiting, last, after))
        if ended is None:
            raise ValueError("the vocabulary has no token for a byte")
        shared = len(ended)
        for waiting, _, _ in target:
            if not waiting:
                shared = 0
                break
            while shared and waiting[:shared] != ended[:shared]:
                shared -= 1
        if shared:
            target = [(waiting[shared:], last, node) for waiting, last, node in target]
        target.append((ended[shared:], ended[-1], 0))
        return self.state(tuple(target)), ended[:shared]

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > self.max_states:
            self.reset()
        state, out = self.start, []
        for byte in piece:
            state, emitted = state[byte]
            if emitted:
                out += emitted
        out += state.configs[-1][0]
        return out


class _Memo(dict):
    """Ids of recent pretokens, as text. Two generations bound its size: when the young one
    is full it becomes the old one, from which what is still in use moves back."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.old: dict[str, str] = {}

    def __missing__(self, piece: str) -> str:
        if len(self) >= MAX_MEMO:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            ids = " ".join(map(str, self.transducer.encode(piece.encode("utf-8", "replace"))))
        self[piece] = ids
        return ids


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = compile_pattern(pattern)
        self.transducer = Transducer(ranks)
        self.memo = _Memo(self.transducer)
        self.bytes_of_text = {str(rank): token for token, rank in ranks.items()}

    def pieces(self, text: str) -> Iterator[str]:
        """Pretokens of a text, split as the tiktoken library does."""
        shown = text
        if not text.isascii() and MAYBE_NEWER.search(text):
            shown = NEWER.sub(NEITHER, text)
        return (text[m.start() : m.end()] for m in self.pattern.finditer(shown))

    def encode_text(self, text: str) -> Iterator[str]:
        """Decimal ids joined by single spaces, in slices of the text's pretokens."""
        lookup = self.memo.__getitem__
        if len(text) <= SLICE and (text.isascii() or not MAYBE_NEWER.search(text)):
            pieces = self.pattern.findall(text)
            if pieces:
                yield " ".join(map(lookup, pieces))
            return
        found = self.pieces(text)
        while pieces := list(islice(found, SLICE)):
            yield " ".join(map(lookup, pieces))

    def encode(self, text: str) -> list[int]:
        return [int(x) for part in self.encode_text(text) for x in part.split(" ")]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.transducer.bytes_of.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its characters are complete."""
        machine = Utf8Machine()
        for token in ids:
            text = machine.feed(self.transducer.bytes_of[token])
            if text:
                yield text
        rest = machine.finish()
        if rest:
            yield rest

    def round_trip(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids as text, sha256 of what they decode to."""
        ids_hash, back_hash, count = hashlib.sha256(), hashlib.sha256(), 0
        machine = Utf8Machine()
        for part in self.encode_text(text or ""):
            ids = part.split(" ")
            ids_hash.update((b" " if count else b"") + part.encode())
            count += len(ids)
            back_hash.update(machine.feed(b"".join(map(self.bytes_of_text.__getitem__, ids))).encode())
        back_hash.update(machine.finish().encode())
        return count, ids_hash.hexdigest(), back_hash.hexdigest()


class Utf8Machine:
    """Incremental UTF-8 decoding: bytes of an unfinished character wait for the rest."""

    def __init__(self):
        self.waiting = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Number of bytes at the end that begin a character without ending it."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        keep = self.unfinished(data)
        self.waiting = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.waiting = self.waiting.decode("utf-8", "replace"), b""
        return rest


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a process; its tables are rebuilt wherever a task runs."""
    return Codec(read_ranks(path), pattern)


def encode_and_decode(rows: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each whole text.

    Null and empty texts have no ids and hashes of nothing. Texts of any length are encoded
    whole, slice by slice. No shuffle; repeated rows each get a row; a kept column called
    like a column of the result gives way; other columns are not read.
    """

    def start():
        tool = codec(path, pattern)

        def work(texts):
            results = [tool.round_trip(t) for t in texts]
            return {name: [r[k] for r in results] for k, name in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}

        return work

    return map_columns(rows, [text], keep, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, start)


def token_ids(rows: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` with the ids themselves as an array of int; null counts as empty."""

    def start():
        tool = codec(path, pattern)
        return lambda texts: {ids: [tool.encode(t or "") for t in texts]}

    return map_columns(rows, [text], keep, {ids: pa.list_(pa.int32())}, start)


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document under a 50k byte-level vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
