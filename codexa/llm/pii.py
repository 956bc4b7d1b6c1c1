"""Personal data by weak supervision.

Candidate spans (an e-mail address, an account number, a run of digits as in telephone, card, IP and social security numbers, a long token with digits as in keys) get votes, for, against or none, from six labelers: a strict pattern, a gazetteer (top-level domains, reserved address ranges, card issuers, key prefixes), the words before the span, a checksum or spread of characters, the span's edges, and look-alikes (dates, versions, decimals). Expectation-maximisation over the counts of vote patterns in the whole corpus estimates each labeler's reliability by kind of span; its posteriors are the soft labels on which a logistic regression is fitted, which then decides every span by its votes and shape, its own characters and the words around it, so that it can overrule labelers in surroundings they know nothing of. EM reads the corpus through counts of distinct patterns, whose number is bounded by the votes and shape buckets; the regression is fitted on FIT spans at most, drawn by a hash.

Defined cases. Null or empty text: no span. doc_id is an integer. Null doc_id: its spans count and are returned with a null doc_id. Repeated rows are each searched. Texts of any length are searched whole; a span is given in characters. Overlapping candidates: the leftmost, and there the first kind in the order account, e-mail, secret, number, is taken. Patterns start at the start of a run of their characters only, so a run of any length is read once. Other columns are ignored; without any candidate the result is empty.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.llm._base import buffers, prepare, stored

KINDS = ("email", "ip", "phone", "card", "secret", "number", "iban", "ssn")
LABELERS = ("pattern", "gazetteer", "context", "checksum", "edges", "lookalike")
SURE = 0.5
#: Share of true spans assumed before any vote, by kind; EM moves it.
PRIOR = {"email": 0.7, "ip": 0.6, "phone": 0.6, "card": 0.6, "secret": 0.6, "number": 0.1, "iban": 0.7, "ssn": 0.5}
#: The final classifier: places its features are hashed to, features a span, and spans it is fitted on.
PLACES, MARKS, FIT = 1 << 12, 16, 20_000

_FIND = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<email>(?<![\w.+\-])[\w.+\-]++@[\w\-]++(?:\.[\w\-]++)*+)"
    r"|(?P<secret>(?<![A-Za-z0-9_\-])(?=[A-Za-z_\-]*+\d)(?=[\d_\-]*+[A-Za-z])[A-Za-z0-9_\-]{20,})"
    r"|(?P<number>\+?\d{1,3}[ .\-]?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}(?!\d)"  # with the area code in brackets
    r"|\d{1,3}(?:\.\d{1,3}){3}(?![\d.])"  # four octets
    r"|\d{4}(?:[ \-]\d{4}){3}(?!\d)"  # a card in groups of four
    r"|\+?\(?\d{1,4}\)?(?:[ .\-]\d{2,5}){2,5}(?!\d)"  # groups
    r"|\+?\d[\d./:\-]{4,}\d)"  # one run
)
_EMAIL = re.compile(r"[A-Za-z0-9_][\w.+\-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")
_IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .\-]\d{3,4}(?:[ .\-]\d{3,4}){1,2}|\+\d{8,14}|\+\d{1,3} \(\d{3}\) \d{3}-\d{4}")
_CARD = re.compile(r"\d{13,19}|\d{4}(?:[ \-]\d{4}){3}")
_DATE = re.compile(r"(?:19|20)\d\d[./\-]\d{1,2}[./\-]\d{1,2}.*|\d{1,2}[./]\d{1,2}[./](?:19|20)?\d\d.*|\d{1,2}:\d\d(?::\d\d)?")
_DOMAINS = set("com org net edu gov mil int info biz io dev app co uk de fr es it nl be at ch se no dk fi pl pt ru ua cz gr ie us ca mx br ar cl jp cn kr in au nz za eu me tv ai".split())
_RESERVED = re.compile(r"(?:0|127|22[4-9]|23\d|24\d|25[0-5])\.|169\.254\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.")
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[68]|6011|64[4-9]|65|35")
_KEYS = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|sk-|xox[bp]-|eyJ|pk_|AIza)")
_FOR = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|kontakt|contacto|correo|courriel|adresse|write|to)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|client|address|adresse|from|login)\b"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|fon|telefon|telephone|tél|teléfono|call|fax|mobile|handy|sms)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta|account|konto|iban)\b"),
    "secret": re.compile(r"(?i)(?:token|secret|key|password|passwd|pwd|auth|bearer|credential)"),
    "number": re.compile(r"(?i)\b(?:ssn|passport|account|konto|tel|phone)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta|bank|transfer)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security|sozialversicherung|number|id)\b"),
}
_IBAN = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}")
#: Length of an account number by country.
_COUNTRIES = dict(x.split(":") for x in "AD:24 AE:23 AT:20 BE:16 BG:22 CH:21 CY:28 CZ:24 DE:22 DK:18 EE:20 ES:24 FI:18 FR:27 GB:22 GI:23 GR:27 HR:21 HU:28 IE:22 IL:23 IS:26 IT:27 LI:21 LT:20 LU:20 LV:21 MC:27 MT:31 NL:18 NO:15 PL:28 PT:25 RO:24 SA:24 SE:24 SI:19 SK:24 SM:27 TR:26 UA:29".split())
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
_AGAINST = re.compile(r"(?i)\b(?:version|isbn|issn|page|seite|total|figure|table|chapter|doi|commit|sha|md5|uuid|v)\W*$")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def kind_of(group: str, span: str) -> str:
    if group == "iban" and str(len(plain := span.replace(" ", ""))) != _COUNTRIES.get(span[:2]):
        return "secret" if len(plain) == len(span) >= 20 and re.search("[A-Z]", span[4:]) else "number"
    if group != "number":
        return group
    if _SSN.fullmatch(span):
        return "ssn"
    if _IP.fullmatch(span):
        return "ip"
    digits = sum(c.isdigit() for c in span)
    if _CARD.fullmatch(span) and 13 <= digits <= 19:
        return "card"
    if 7 <= digits <= 15 and (span[0] in "+(" or any(c in " -()." for c in span)):
        return "phone"
    return "number"


def votes(kind: str, span: str, before: str, prev: str, nxt: str) -> tuple[int, ...]:
    """For 1, against -1, none 0, of each labeler."""
    digits = re.sub(r"\D", "", span)
    context = 1 if _FOR[kind].search(before[-40:]) else -1 if _AGAINST.search(before[-24:]) else 0
    edges = 1 if (not prev or prev.isspace() or prev in "\"'(<[|,:=;") and (not nxt or nxt.isspace() or nxt in "\"')>]|,.;!?%$#&*:") else -1
    date = -1 if _DATE.fullmatch(span) else 0
    if kind == "email":
        return (1 if _EMAIL.fullmatch(span) else -1, 1 if span.rpartition(".")[2].lower() in _DOMAINS else -1, context, 0, edges, 0)
    if kind == "ip":
        octets = [int(x) for x in span.split(".")]
        return (1 if all(x < 256 for x in octets) else -1, -1 if _RESERVED.match(span) else 1, context, 1 if any(x > 31 for x in octets) else -1, edges, -1 if max(octets) < 10 else 0)
    if kind == "card":
        return (1 if len(digits) in (13, 14, 15, 16, 19) else -1, 1 if _ISSUERS.match(digits) else 0, context, 1 if _luhn(digits) else 0, edges, -1 if len(set(digits)) < 4 else 0)
    if kind == "phone":
        return (1 if _PHONE.fullmatch(span) else -1, 1 if span[0] == "+" or "(" in span else 0, context, 1 if 9 <= len(digits) <= 13 else -1, edges, date)
    if kind == "secret":
        share = Counter(span)
        spread = -sum(n / len(span) * math.log2(n / len(span)) for n in share.values())
        hexes = re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", span)
        return (1 if hexes or re.search(r"[A-Z]", span) and re.search(r"[a-z]", span) and re.search(r"\d", span) else -1, 1 if _KEYS.match(span) else 0, context, 1 if spread > 3 else -1, edges, -1 if re.fullmatch(r"(?:[A-Za-z]+[-_])+\d{1,4}", span) else 0)
    if kind == "iban":
        plain = span.replace(" ", "")
        value = int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97
        return (1 if _IBAN.fullmatch(plain) else -1, 1, context, 1 if value == 1 else -1, edges, 0)
    if kind == "ssn":
        sound = digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
        return (1 if sound else -1, 0, context, 0, edges, -1 if len(set(digits)) < 3 else 0)
    return (-1, 0, context, 0, edges, date or (-1 if len(digits) < 7 else 0))


def shape(kind: str, span: str) -> tuple[int, int, int]:
    """Buckets of length, share of digits, and separators."""
    n = len(span)
    return min(n.bit_length(), 7), min(4, 5 * sum(c.isdigit() for c in span) // n), min(3, sum(not c.isalnum() for c in span))


_WORD = re.compile(r"\w{1,30}")


def marks(kind: str, parts: tuple[int, ...], span: str, before: str, after: str) -> list[int]:
    """The MARKS features of a span, hashed: kind, votes, shape, the words around it, and its own make-up and ends."""
    words = ["", "", *_WORD.findall(before.lower())][-2:]
    after_ = _WORD.search(after.lower())
    make = re.sub(r"9+", "9", re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d+", "9", span[:200]))))[:24]
    own = [f"{n}{v}" for n, v in zip((*LABELERS, "length", "digits", "marks"), parts, strict=True)]
    own += [f"before {words[1]}", f"before that {words[0]}", f"after {after_.group() if after_ else ''}", f"make {make}", f"starts {span[:3].lower()}", f"ends {span[-3:].lower()}"]
    return [zlib.crc32(x.encode()) % PLACES for x in (kind, *[f"{kind} {x}" for x in own])]


def spans(text: str) -> Iterator[tuple[int, int, int, tuple[int, ...], list[int]]]:
    """Start, end, kind's number, the code's parts (votes and shape), and the classifier's features."""
    for m in _FIND.finditer(text):
        a, b, span = m.start(), m.end(), m.group()
        kept = span.rstrip(".-")
        b -= len(span) - len(kept)
        if kept.count("(") > kept.count(")") and kept[0] == "(":
            a, kept = a + 1, kept[1:]
        kind = kind_of(m.lastgroup, kept)
        if kind == "number" and sum(c.isdigit() for c in kept) < 6:
            continue
        before = text[max(0, a - 40) : a]
        parts = (*votes(kind, kept, before, text[a - 1 : a] if a else "", text[b : b + 1]), *shape(kind, kept))
        yield a, b, KINDS.index(kind), parts, marks(kind, parts, kept, before, text[b : b + 20])


def code_of(kind: int, parts: tuple[int, ...]) -> int:
    out = kind
    for v in parts[:6]:
        out = out * 3 + v + 1
    for v in parts[6:]:
        out = out * 8 + v
    return out


def parts_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes (n x 6) and shapes (n x 3) of codes."""
    code, shapes, vote = code.copy(), [], []
    for _ in range(3):
        shapes.append(code % 8)
        code //= 8
    for _ in range(6):
        vote.append(code % 3 - 1)
        code //= 3
    return code, np.stack(vote[::-1], 1) if len(code) else np.zeros((0, 6), int), np.stack(shapes[::-1], 1) if len(code) else np.zeros((0, 3), int)


def estimate(kind: np.ndarray, vote: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, dict[str, dict[str, tuple[float, float]]]]:
    """Posterior that each pattern is personal data, and by kind and labeler its reliabilities (share of votes for on true spans, against on false ones). Dawid and Skene's model with a class for each of true and false, smoothed towards labelers that are mostly right."""
    p = np.zeros(len(kind))
    learned: dict[str, dict[str, tuple[float, float]]] = {}
    # pseudo-counts of votes (against, none, for) for true and false spans
    base = np.array([[0.5, 1.0, 3.0], [3.0, 1.0, 0.5]]) * 4
    for k, name in enumerate(KINDS):
        own = np.flatnonzero(kind == k)
        if not len(own):
            continue
        v, n = vote[own] + 1, count[own].astype(float)
        q = 1 / (1 + np.exp(-(vote[own].sum(axis=1) + math.log(PRIOR[name] / (1 - PRIOR[name])))))
        for _ in range(rounds):
            share = (n @ q + 20 * PRIOR[name]) / (n.sum() + 20)
            table = np.empty((vote.shape[1], 2, 3))
            for f in range(vote.shape[1]):
                for c, w in enumerate((q, 1 - q)):
                    total = base[c] + np.bincount(v[:, f], n * w, 3)
                    table[f, c] = total / total.sum()
            logs = np.log(table)
            like = np.stack([sum(logs[f, c, v[:, f]] for f in range(vote.shape[1])) for c in (0, 1)], 1) + np.log([share, 1 - share])
            new = 1 / (1 + np.exp(np.clip(like[:, 1] - like[:, 0], -50, 50)))
            if np.abs(new - q).max() < 1e-7:
                break
            q = new
        p[own] = q
        learned[name] = {label: (float(table[f, 0, 2]), float(table[f, 1, 0])) for f, label in enumerate(LABELERS)}
    return p, learned


def fit(x: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Weights (PLACES) of a logistic regression on soft targets, of rows of places of features, by gradient descent with a step for each weight."""
    w, seen = np.zeros(PLACES), np.full(PLACES, 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
        g = np.bincount(x.ravel(), np.repeat((p - target) / len(x), x.shape[1]), PLACES) + ridge * w / len(x)
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        # only texts with a digit or an at sign can hold a candidate
        hint = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])
        for i in np.flatnonzero(hint[offsets[1:]] > hint[offsets[:-1]]):
            found = list(spans(data[offsets[i] : offsets[i + 1]].tobytes().decode()))
            if found:
                a, b, k, parts, made = zip(*found, strict=True)
                ids = pa.array([batch.column(0)[int(i)].as_py()] * len(a), pa.int64())
                yield pa.record_batch([ids, pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array([KINDS[x] for x in k]), pa.array([code_of(x, y) for x, y in zip(k, parts, strict=True)], pa.int64()), pa.array(made, pa.list_(pa.int32()))], names=["doc_id", "start", "end", "kind", "code", "marks"])


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, code, marks) of the candidate spans."""
    prepare(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(_extract, "doc_id long, start int, end int, kind string, code long, marks array<int>")


def labels(patterns: DataFrame) -> tuple[np.ndarray, np.ndarray, dict]:
    """From (code, n): the codes in order, their soft labels, and the labelers' reliabilities."""
    t = patterns.toArrow()  # a row for each distinct pattern: thousands at most, by construction
    code, n = t.column(0).to_numpy(), t.column(1).to_numpy()
    order = np.argsort(code)
    code, n = code[order], n[order]
    kind, vote, _ = parts_of(code)
    return (code, *estimate(kind, vote, n)) if len(code) else (code, np.zeros(0), {})


def _rated(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            x = batch.column(4).flatten().to_numpy().reshape(-1, MARKS)
            p = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(p)], names=["doc_id", "start", "end", "kind", "probability"])

    return run


def personal_data(docs: DataFrame, sure: float = SURE, sample: int = FIT) -> DataFrame:
    """(doc_id, start, end, kind, probability) of the spans with probability `sure` or more, in characters."""
    spark = docs.sparkSession
    found = stored(candidates(docs), "spans")
    code, soft, _ = labels(found.groupBy("code").agg(F.count("*").alias("n")))
    drawn = found.orderBy(F.xxhash64("doc_id", "start", "end"), "code").limit(sample).select("code", "marks").toArrow()
    x = drawn.column(1).combine_chunks().flatten().to_numpy().reshape(-1, MARKS) if drawn.num_rows else np.zeros((0, MARKS), np.int32)
    # the rows' order must not matter to the last digit
    target = soft[np.searchsorted(code, drawn.column(0).to_numpy())]
    order = np.lexsort((*x.T, target))
    w = fit(x[order], target[order]) if len(x) else np.zeros(PLACES)
    rated = found.select("doc_id", "start", "end", "kind", "marks").mapInArrow(_rated(spark.sparkContext.broadcast(w)), "doc_id long, start int, end int, kind string, probability double")
    return rated.where(F.col("probability") >= sure)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("probability", F.round("probability", 4))
