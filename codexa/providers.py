"""Pluggable models. Each is a picklable object that workers call on batches; the defaults are deterministic and need no network."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Words hashed to signed places, normalised to length 1: equal texts have equal vectors, shared words bring them closer."""

    dim: int = 64
    instruction: str = ""

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for w in (self.instruction + text).lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


class Overloaded(Exception):
    """The service refuses a batch for its size."""


@dataclass(frozen=True)
class Patient:
    """Calls another embedder with retries, and with halved batches where it is overloaded."""

    inner: Embedder
    pauses: tuple[float, ...] = (1, 2, 4)

    @property
    def dim(self) -> int:
        return self.inner.dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        for pause in (*self.pauses, None):
            try:
                return self.inner.embed(texts)
            except Overloaded:
                if len(texts) > 1:
                    half = len(texts) // 2
                    return self.embed(texts[:half]) + self.embed(texts[half:])
                if pause is None:
                    raise
            except OSError:
                if pause is None:
                    raise
            time.sleep(pause)
        raise AssertionError


def embedded(embedder: Embedder, batch: int = 32) -> Callable[[Column], Column]:
    """A column function that embeds texts in batches, in their order; null stays null."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            real = s.dropna()
            out: dict[int, list[float]] = {}
            for i in range(0, len(real), batch):
                part = real.iloc[i : i + batch]
                out.update(zip(part.index, embedder.embed(part.tolist()), strict=True))
            yield pd.Series([out.get(i) for i in s.index], index=s.index, dtype=object)

    return run


_HEAD = re.compile(r"^\s*(?:(?P<dotted>\d+(?:\.\d+)*)[.)]?|(?P<letter>[^\W\d_])\))\s+", re.UNICODE)


class Markup(Protocol):
    """What reads the structure of logical parts: of each (type, numbering, relation, block, tags); and whether a part goes on from the one before."""

    def tag(self, texts: list[str]) -> list[tuple[str, str, str, str, list[str]]]: ...

    def continues(self, before: str, text: str) -> bool: ...


@dataclass(frozen=True)
class RuleMarkup:
    """Reads structure from leading numbers: 1 is a chapter, 1.1 a section, deeper ones clauses, a) a list item; amendments by their first word."""

    amendment: str = r"(?i)^\s*(?:измен|поправк|amend)"

    def tag(self, texts: list[str]) -> list[tuple[str, str, str, str, list[str]]]:
        out, before = [], 0
        for text in texts:
            m = _HEAD.match(text)
            number = (m["dotted"] or m["letter"] + ")") if m else ""
            depth = number.count(".") + 1 if m and m["dotted"] else 0
            kind = ("chapter", "section", "clause")[min(depth, 3) - 1] if depth else "list_item" if m else "paragraph"
            relation = "top" if depth == 1 else "deeper" if not depth or depth > before else "same" if depth == before else "shallower"
            before = depth or before
            out.append((kind, number, relation, "amendment" if re.match(self.amendment, text) else "main", []))
        return out

    def continues(self, before: str, text: str) -> bool:
        return False
