"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time, on pieces of PIECE characters from at most `samples` labelled documents of each language (a bound on the sample, chosen by a hash of doc_id). Every text is labelled whole, in stretches of STRETCH bytes that run together: the forward state starts AROUND bytes before a stretch and the backward state AROUND bytes after it (or at the text's ends), so every byte is read in context and the result does not depend on where a stretch is cut but for what lies further away. Every byte gets a probability of each language; the positions' labels are returned as spans, and a document's probabilities are the means over all its bytes.

Defined cases. Null or empty text: language, probabilities and spans null, 0 bytes. No column lang: as with null labels. Null labels are not learnt from; null doc_id is (its hash is one value). Without any labelled text, every language is null. Equal probabilities: the first language by name. Rows are never merged; other columns are ignored. Texts of any length are labelled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.llm._base import buffers, pieces, prepare

HIDDEN, SPAN, PIECE = 8, 64, 256
STRETCH, AROUND = 128, 32
SAMPLES, STEPS, BATCH, RATE = 600, 250, 128, 0.02


def start(languages: int, hidden: int = HIDDEN, seed: int = 5) -> dict[str, np.ndarray]:
    """Random weights: for each direction d the byte tables w and the recurrent matrices u of gates z, r and candidate n, and the output matrix v; c is the output's bias."""
    g = np.random.default_rng(seed)
    out = {"c": np.zeros(languages, np.float32)}
    for d in "fb":
        for gate in "zrn":
            out[f"w{gate}{d}"] = (g.standard_normal((256, hidden)) * 0.3).astype(np.float32)
            out[f"u{gate}{d}"] = (g.standard_normal((hidden, hidden)) * 0.5 / np.sqrt(hidden)).astype(np.float32)
        out[f"v{d}"] = (g.standard_normal((hidden, languages)) * 0.3).astype(np.float32)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def run_one(w: dict[str, np.ndarray], d: str, data: np.ndarray, real: np.ndarray | None, kept: list | None = None) -> np.ndarray:
    """Hidden states, SPAN x segments x hidden, of one direction. data: SPAN x segments bytes; real: which of them belong to the text. kept takes what the backward pass needs."""
    steps, n = data.shape
    hidden = w[f"uz{d}"].shape[0]
    h = np.zeros((n, hidden), np.float32)
    out = np.empty((steps, n, hidden), np.float32)
    wz, wr, wn, uz, ur, un = (w[f"{a}{g}{d}"] for a in "wu" for g in "zrn")
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        x = data[t]
        z = _sigmoid(np.take(wz, x, axis=0, mode="clip") + h @ uz)
        r = _sigmoid(np.take(wr, x, axis=0, mode="clip") + h @ ur)
        a = h @ un
        c = np.tanh(np.take(wn, x, axis=0, mode="clip") + r * a)
        new = c + z * (h - c)
        if real is not None:
            new = np.where(real[t][:, None], new, h)
        if kept is not None:
            kept.append((t, h, z, r, a, c))
        h = out[t] = new
    return out


def probabilities(w: dict[str, np.ndarray], data: np.ndarray, real: np.ndarray | None, around: int = 0) -> np.ndarray:
    """Of each language at each byte but the first and last `around` ones, which are context: bytes x segments x languages."""
    n = len(data)
    s = run_one(w, "f", data[: n - around], None if real is None else real[: n - around])[around:] @ w["vf"]
    s += run_one(w, "b", data[around:], None if real is None else real[around:])[: n - 2 * around] @ w["vb"]
    s += w["c"]
    s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=2, keepdims=True)
    return s


def gradients(w: dict[str, np.ndarray], data: np.ndarray, real: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the real bytes, and its derivatives by every weight, through time."""
    kept: dict[str, list] = {"f": [], "b": []}
    h = {d: run_one(w, d, data, real, kept[d]) for d in "fb"}
    s = h["f"] @ w["vf"] + h["b"] @ w["vb"] + w["c"]
    s -= s.max(axis=2, keepdims=True)
    p = np.exp(s)
    p /= p.sum(axis=2, keepdims=True)
    total = max(int(real.sum()), 1)
    own = np.take_along_axis(p, np.broadcast_to(label[None, :, None], (*data.shape, 1)), axis=2)[:, :, 0]
    loss = float(-(np.log(np.maximum(own, 1e-12)) * real).sum() / total)
    ds = p.copy()
    ds[:, np.arange(len(label)), label] -= 1
    ds *= (real / total)[:, :, None].astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["c"] = ds.sum(axis=(0, 1))
    for d in "fb":
        hidden, langs = w[f"v{d}"].shape
        g[f"v{d}"] = h[d].reshape(-1, hidden).T @ ds.reshape(-1, langs)
        down = ds @ w[f"v{d}"].T
        dh = np.zeros_like(h[d][0])
        byte, parts = [], []
        for t, before, z, r, a, c in reversed(kept[d]):
            dh = dh + down[t]
            live = real[t][:, None]
            dnew = dh * live
            dz, dc = dnew * (before - c) * z * (1 - z), dnew * (1 - z) * (1 - c * c)
            dr, da = dc * a * r * (1 - r), dc * r
            g[f"uz{d}"] += before.T @ dz
            g[f"ur{d}"] += before.T @ dr
            g[f"un{d}"] += before.T @ da
            dh = dnew * z + dz @ w[f"uz{d}"].T + dr @ w[f"ur{d}"].T + da @ w[f"un{d}"].T + dh * ~live
            byte.append(data[t])
            parts.append(np.concatenate([dz, dr, dc], axis=1))
        each, flat = np.concatenate(byte), np.concatenate(parts)
        table = np.stack([np.bincount(each, flat[:, k], 256) for k in range(3 * hidden)], axis=1).astype(np.float32)
        for k, gate in enumerate("zrn"):
            g[f"w{gate}{d}"] = table[:, k * hidden : (k + 1) * hidden]
    return loss, g


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SPAN x segments bytes, which of them are real, and each segment's row."""
    count = -(-np.diff(offsets) // SPAN)
    row = np.repeat(np.arange(len(count)), count)
    first = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * SPAN
    size = np.minimum(offsets[1:][row] - first, SPAN)
    at = np.arange(SPAN)[:, None]
    real = at < size
    return data[np.minimum(first + at, max(len(data) - 1, 0))] if len(data) else np.zeros((SPAN, 0), np.uint8), real, row


def train(texts: list[str], labels: np.ndarray, languages: int, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam over shuffled segments."""
    data = [x.encode() for x in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    x, real, row = segments(np.frombuffer(b"".join(data), np.uint8), offsets)
    y = labels[row]
    w, g = start(languages, seed=seed), np.random.default_rng(seed)
    if not len(row):
        return w
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    # every language is drawn equally often
    each = [np.flatnonzero(y == k) for k in range(languages)]
    each = [e for e in each if len(e)]
    for step in range(1, steps + 1):
        own = np.concatenate([g.choice(e, max(1, batch // len(each))) for e in each])
        _, grad = gradients(w, x[:, own], real[:, own], y[own])
        norm = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
        now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for k in w:
            v = grad[k] * min(1.0, 1 / max(norm, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            w[k] = (w[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return w


def labelled(w: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows' mean probabilities over their bytes, and every byte's first choice."""
    size = np.diff(offsets)
    count = -(-size // STRETCH)
    row = np.repeat(np.arange(len(count)), count)
    first = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * STRETCH
    langs = len(w["c"])
    total, best = np.zeros((len(size), langs)), np.zeros(len(data), np.uint8)
    whole = (first - AROUND >= offsets[:-1][row]) & (first + STRETCH + AROUND <= offsets[1:][row])
    at = np.arange(-AROUND, STRETCH + AROUND)[:, None]
    for own, mask in ((np.flatnonzero(whole), False), (np.flatnonzero(~whole), True)):
        for lo in range(0, len(own), 2048):
            k = own[lo : lo + 2048]
            spot = first[k] + at
            real = (spot >= offsets[:-1][row[k]]) & (spot < offsets[1:][row[k]]) if mask else None
            x = data[np.clip(spot, 0, len(data) - 1)] if mask else data[spot]
            p = probabilities(w, x, real, AROUND)
            spot, chosen = spot[AROUND:-AROUND], p.argmax(axis=2).astype(np.uint8)
            if mask:
                inner = real[AROUND:-AROUND]
                best[spot[inner]] = chosen[inner]
            else:
                best[spot] = chosen
            for c in range(langs):
                total[:, c] += np.bincount(row[k], (p[:, :, c] * inner if mask else p[:, :, c]).sum(axis=0), len(total))
    return total / np.maximum(size, 1)[:, None], best


def pooled(w: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows' mean probabilities over their bytes, and the share of bytes whose own first choice is the row's."""
    p, best = labelled(w, data, offsets)
    return p, _agreeing(p, best, offsets)


def _agreeing(p: np.ndarray, best: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    size = np.diff(offsets)
    same = np.concatenate([[0], np.cumsum(best == np.repeat(p.argmax(axis=1), size))])
    return (same[offsets[1:]] - same[offsets[:-1]]) / np.maximum(size, 1)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("language", pa.string())])


def runs(best: np.ndarray, offsets: np.ndarray, languages: list[str]) -> pa.ListArray:
    """Each row's labels as spans of bytes [start, end) of one language; null for a row without bytes."""
    new = np.ones(len(best), bool)
    new[1:] = best[1:] != best[:-1]
    some = offsets[:-1][np.diff(offsets) > 0]
    new[some] = True
    start = np.flatnonzero(new)
    row = np.searchsorted(offsets, start, side="right") - 1
    end = np.concatenate([start[1:], [len(best)]])
    names = pa.array(languages, pa.string()).take(pa.array(best[start].astype(np.int32)))
    spans = pa.StructArray.from_arrays([pa.array((start - offsets[row]).astype(np.int32)), pa.array((end - offsets[row]).astype(np.int32)), names], fields=list(_SPAN))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, offsets).astype(np.int32)), spans, mask=pa.array(np.diff(offsets) == 0))


def _label(model, languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in pieces(offsets, 1 << 20):
                own = offsets[i : j + 1] - offsets[i]
                p, best = labelled(w, data[offsets[i] : offsets[j]], own)
                size = np.diff(own)
                none = size == 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(languages)), pa.array(p.ravel()), mask=pa.array(none))
                names = pa.array(languages, pa.string()).take(pa.array(p.argmax(axis=1).astype(np.int32), mask=none))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), names, pa.array(p.max(axis=1), mask=none), lists, pa.array(_agreeing(p, best, own), mask=none), pa.array(size), runs(best, own, languages)],
                    names=["doc_id", "language", "probability", "probabilities", "agreeing", "bytes", "spans"])

    return run


def learn(docs: DataFrame, samples: int = SAMPLES, steps: int = STEPS) -> tuple[dict[str, np.ndarray] | None, list[str]]:
    """Weights and languages, from the column lang; None without labelled text."""
    if "lang" not in docs.columns:
        return None, []
    named = docs.where("lang is not null and text is not null and text <> ''").selectExpr("cast(lang as string) as lang", "text", "xxhash64(doc_id) as h")
    counts = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}
    if not counts:
        return None, []
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, samples / n))])
    drawn = named.where(F.pmod("h", F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20))
    some = drawn.selectExpr("lang", "h as place", f"substring(text, 1 + cast(pmod(shiftrightunsigned(h, 20), greatest(1, length(text) - {PIECE})) as int), {PIECE}) as text").orderBy("place", "lang", "text").limit(2 * samples * len(languages)).toArrow()
    texts, labels = some.column("text").to_pylist(), np.array([languages.index(x) for x in some.column("lang").to_pylist()], np.int64)
    order = np.argsort(np.array(texts, object), kind="stable") if texts else np.zeros(0, int)  # the rows' order must not matter
    return train([texts[k] for k in order], labels[order], len(languages), steps), languages


def identified(docs: DataFrame, samples: int = SAMPLES, steps: int = STEPS) -> DataFrame:
    """(doc_id, language, probability, probabilities by language in the order of their names, agreeing: the share of bytes that say the same, bytes, spans: the positions' labels) of every row."""
    prepare(docs.sparkSession)
    w, languages = learn(docs, samples, steps)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, language string, probability double, probabilities array<double>, agreeing double, bytes long, spans array<struct<start:int,end:int,language:string>>"
    if w is None:
        return docs.selectExpr("doc_id", "cast(null as string) language", "cast(null as double) probability", "cast(null as array<double>) probabilities", "cast(null as double) agreeing", "cast(coalesce(octet_length(text), 0) as long) bytes", "cast(null as array<struct<start:int,end:int,language:string>>) spans")
    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(_label(docs.sparkSession.sparkContext.broadcast(w), languages), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"))
