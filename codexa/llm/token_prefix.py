"""Exact token counts at every prefix, by dynamic programming over a byte-pair vocabulary.

For every document one array holds, for each number of characters p, how far the token count of the first p characters is above that of the first p - 1. It answers how many tokens any prefix has, where a text must be cut to fit a budget, and how many tokens lie between two cuts, without encoding again.

Within a pre-token, the encoding of a prefix of i bytes ends in the one vocabulary token t for which the encoding of the first i - len(t) bytes ends in a token that may stand before t, that is, for which the pair encodes to itself. So one pass gives the count of every prefix; an automaton over the vocabulary names the tokens that end at each byte, so no other stretch of it is looked up. Pre-tokens never cross from a non-space into a space, so a text is a row of units (white space and the non-space run after it) whose counts add up; each distinct unit is worked out once and kept.

Defined cases. Null text: all results null. Empty text: 0 tokens, an empty array. Texts and units of any length are covered whole. Special tokens' strings are ordinary text. Rows are never merged; nulls and repeats in doc_id, and other columns, don't matter. An array's items have 1 byte, or 8 where a step in the document doesn't fit one (`wide`).
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from operator import sub
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from codexa.llm._base import prepare

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUDGETS = (512, 2048, 8192)
_SPACE = "\t-\r\x85\xa0  -     　 "
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+$")
_KEPT = 200_000
_CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")


class State(dict):
    """The longest tail of the bytes read that begins a token (`tail`), and the tokens that end with it, longest first (`ends`: rank and length); byte -> the state after it, worked out at first use."""

    __slots__ = ("counter", "ends", "tail")

    def __init__(self, counter: Counter, tail: bytes):
        self.counter, self.tail = counter, tail
        self.ends = [(counter.ranks[t], len(t)) for k in range(len(tail)) if (t := tail[k:]) in counter.ranks]

    def __missing__(self, byte: int) -> State:
        c, tail = self.counter, self.tail + bytes((byte,))
        while tail not in c.begins:
            tail = tail[1:]
        if tail not in c.states:
            c.states[tail] = State(c, tail)
        c.moves += 1
        found = self[byte] = c.states[tail]
        return found


class Counter(dict):
    """Unit -> its steps, one byte a character (None if one doesn't fit); worked out at first use, forgotten when there are too many."""

    def __init__(self, vocabulary: str | bytes):
        lines = (Path(vocabulary).read_bytes() if isinstance(vocabulary, str) else vocabulary).splitlines()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.begins = {t[:k] for t in self.ranks for k in range(len(t) + 1)}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.pretokens = regex.compile(PATTERN)
        self.restart()

    def restart(self) -> None:
        """Forgets the states, and the beginnings of words that end in them."""
        self.states: dict[bytes, State] = {}
        self.moves = 0
        self.start = State(self, b"")
        self.heads: dict[bytes, tuple[list[int], list[int], State]] = {}

    def follows(self, a: int, b: int) -> bool:
        """Whether the tokens a and b, put together, encode to themselves."""
        if len(self.pairs) > 2 * _KEPT:
            self.pairs.clear()
        known = self.pairs[a << 32 | b] = self.encoding._encode_single_piece(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def read(self, data: bytes, last: list[int], count: list[int], state: State) -> State:
        """Goes on by data: last and count have the last token and the number of tokens of each prefix so far, state is that of the longest."""
        pairs = self.pairs
        for i, byte in enumerate(data, len(last)):
            state = state[byte]
            for t, size in state.ends:
                j = i - size
                if j:
                    ok = pairs.get(last[j] << 32 | t)
                    if ok is None:
                        ok = self.follows(last[j], t)
                    if not ok:
                        continue
                last.append(t)
                count.append(count[j] + 1)
                break
        return state

    def word(self, text: str) -> list[int]:
        """Counts at each character's end within one pre-token that is no contraction."""
        data = text.encode()
        n, head = len(data), data[:6]
        known = self.heads.get(head)
        if known is None:  # words share their beginnings, and so the work for them
            if self.moves > 2 * _KEPT or 2 * len(self.heads) > _KEPT:
                self.restart()
            last, count = [0], [0]
            known = self.heads[head] = last, count, self.read(head, last, count, self.start)
        count = known[1]
        if n > 6:
            count = count.copy()
            self.read(data[6:], known[0].copy(), count, known[2])
        if n == len(text):
            return count[1:]
        return [count[i] for i in range(1, n + 1) if i == n or data[i] & 0xC0 != 0x80]

    def piece(self, text: str) -> list[int]:
        """Counts at each character's end within one pre-token."""
        if text[-1].isalpha() and text[0] != "'":  # words are kept as units
            return self.word(text)
        if (known := self.pieces.get(text)) is not None:
            return known
        if _CONTRACTION.fullmatch(text):
            counts = [len(self.encoding.encode_ordinary(text[: k + 1])) for k in range(len(text))]
        else:
            counts = self.word(text)
        if len(text) < 200:
            if len(self.pieces) > _KEPT:
                self.pieces.clear()
            self.pieces[text] = counts
        return counts

    def counts(self, unit: str) -> list[int]:
        """Counts at each character's end within one unit."""
        word = unit[1:] if unit[0] == " " else unit
        if word.isalpha():  # by far the most: one pre-token, with the space before it
            return self.word(unit)
        if word[:-1].isalpha() and word[-1] in ".,;:":
            here = self.word(unit[:-1])
            return [*here, here[-1] + 1]
        m = len(unit) - len(unit.lstrip(_SPACES))
        if m == len(unit):
            return self.piece(unit)
        out = list(self.piece(unit[:m])) if m else []
        done, at = 0, 0
        for p in self.pretokens.findall(unit):
            here = self.piece(p)
            for k in range(len(p)):
                if at + k >= m:
                    out.append(done + here[k])
            done, at = done + here[-1], at + len(p)
        return out

    def __missing__(self, unit: str) -> bytes | None:
        if unit[-1] in ".,;:" and unit[-2:-1].isalpha() and (known := self.get(unit[:-1])):
            found = known + b"\1"  # one token more, whatever stands before the letter
        else:
            c = self.counts(unit)
            try:
                found = array("b", map(sub, c, [0, *c])).tobytes()
            except OverflowError:
                found = None
        if len(unit) < 200:
            if len(self) > 2 * _KEPT:
                self.clear()
            self[unit] = found
        return found

    def steps(self, text: str) -> tuple[np.ndarray, bool]:
        """The steps of a text's counts, and whether any doesn't fit a byte."""
        units = _UNIT.findall(text)
        parts = [self[u] for u in units]
        try:
            return np.frombuffer(b"".join(parts), np.int8), False
        except TypeError:
            return np.concatenate([np.diff(np.array(self.counts(u), np.int64), prepend=0) for u in units]), True


_SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_COUNTERS: dict[str, Counter] = {}


def counter(vocabulary: str, data: bytes | None = None) -> Counter:
    """The vocabulary's counter, kept between a worker's tasks; from its data, or else from its file."""
    if vocabulary not in _COUNTERS:
        _COUNTERS[vocabulary] = Counter(vocabulary if data is None else data)
    return _COUNTERS[vocabulary]


def counts_of(steps: bytes, wide: bool = False) -> np.ndarray:
    """Tokens of the first p characters, p from 0."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int64 if wide else np.int8), dtype=np.int64)])


def tokens_in(steps: bytes, p: int, wide: bool = False) -> int:
    """Tokens of the first p characters."""
    return int(np.frombuffer(steps, np.int64 if wide else np.int8)[: max(p, 0)].sum(dtype=np.int64))


def chars_within(steps: bytes, budget: int, wide: bool = False) -> int:
    """The most leading characters whose encoding has `budget` tokens or fewer."""
    return int(np.flatnonzero(counts_of(steps, wide) <= budget)[-1]) if budget >= 0 else 0


def _counted(vocabulary: str, shared, budgets: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary, shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows: list[tuple] = []
                for text in part.column(1).to_pylist():
                    if text is None:
                        rows.append((None,) * (4 + len(budgets)))
                        continue
                    steps, wide = c.steps(text)
                    total = np.cumsum(steps, dtype=np.int64)
                    n = int(total[-1]) if len(total) else 0
                    fits = [int(x[-1]) + 1 if len(x := np.flatnonzero(total <= b)) else 0 for b in budgets]
                    rows.append((len(text), n, *fits, steps.tobytes(), wide))
                types = [pa.int64(), pa.int64(), *[pa.int64()] * len(budgets), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]], names=["doc_id", "chars", "tokens", *[f"chars_in_{b}" for b in budgets], "steps", "wide"])

    return run


def prefix_counts(docs: DataFrame, vocabulary: str = VOCABULARY, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """(doc_id, chars, tokens, chars_in_<budget>..., steps, wide) of every row."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, chars long, tokens long, " + "".join(f"chars_in_{b} long, " for b in budgets) + "steps binary, wide boolean"
    # read on the driver and sent along: executors need no file of their own
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(_counted(vocabulary, shared, tuple(budgets)), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
