"""Language, personal data, audio, URL lists."""

import itertools
import math
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from codexa.llm import audio, langid, pii, url_lists
from tests.llm.helpers import awkward, none_of
from tests.oracle import DATA


def test_gradients_through_time():
    g = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in langid.start(3, hidden=4).items()}
    data, _, _ = langid.segments(g.integers(97, 110, 150).astype(np.uint8), np.array([0, 70, 150]))
    real, label = langid.segments(np.zeros(150, np.uint8), np.array([0, 70, 150]))[1], np.array([0, 1, 2, 1])
    _, grad = langid.gradients(w, data, real, label)
    for k in w:
        for at in list(zip(*np.nonzero(np.abs(grad[k]) > 1e-4), strict=True))[:4]:
            step, values = 1e-2, []
            for sign in (1, -1):
                moved = {n: v.copy() for n, v in w.items()}
                moved[k][at] += sign * step
                values.append(langid.gradients(moved, data, real, label)[0])
            assert (values[0] - values[1]) / (2 * step) == pytest.approx(grad[k][at], rel=0.05, abs=2e-4)


def test_held_out_languages(spark):
    """Trained on one half of the documents, right on nine tenths or more of the other half."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").selectExpr("doc_id", "text", "lang", "xxhash64(text) as h")
    w, languages = langid.learn(docs.where("h > 0"))
    held = docs.where("h <= 0 and length(text) > 100").toArrow()
    data = [x.encode() for x in held.column("text").to_pylist()]
    p, _ = langid.pooled(w, np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
    right = np.array([languages[k] for k in p.argmax(axis=1)]) == np.array(held.column("lang").to_pylist())
    assert right.mean() >= 0.9


def test_language_awkward_rows(spark):
    rows = langid.identified(awkward(spark), steps=3).collect()
    assert len(rows) == 13
    for r in rows:
        assert (r["language"] is None) == (r["bytes"] == 0) and (r["probabilities"] is None) == (r["bytes"] == 0)
    assert {r["language"] for r in langid.identified(awkward(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {None}
    assert langid.identified(none_of(spark)).count() == 0
    assert {r["language"] for r in langid.identified(awkward(spark).drop("lang")).collect()} == {None}


def test_labels_by_a_plain_loop():
    """Every byte's probabilities, one state at a time, from the context that its stretch has."""
    w = langid.start(3, hidden=4, seed=2)
    text = bytes(np.random.default_rng(3).integers(97, 123, 300).astype(np.uint8))
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, 290, 290, 300])
    p, best = langid.labelled(w, data, offsets)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def states(d, part):
        h, out = np.zeros(4), []
        for x in part:
            z, r = sig(w[f"wz{d}"][x] + h @ w[f"uz{d}"]), sig(w[f"wr{d}"][x] + h @ w[f"ur{d}"])
            c = np.tanh(w[f"wn{d}"][x] + r * (h @ w[f"un{d}"]))
            h = z * h + (1 - z) * c
            out.append(h)
        return out

    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        total = np.zeros(3)
        for first in range(a, b, langid.STRETCH):
            last = min(first + langid.STRETCH, b)
            lo, hi = max(a, first - langid.AROUND), min(b, last + langid.AROUND) if last == first + langid.STRETCH else b
            f, g = states("f", text[lo:last]), states("b", text[first:hi][::-1])[::-1]
            for k in range(first, last):
                s = f[k - lo] @ w["vf"] + g[k - first] @ w["vb"] + w["c"]
                q = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
                total += q
                assert best[k] == q.argmax() or abs(np.sort(q)[-1] - np.sort(q)[-2]) < 1e-5
        assert np.allclose(p[row], total / max(b - a, 1), atol=1e-5)
    spans = langid.runs(best, offsets, ["x", "y", "z"]).to_pylist()
    assert spans[1] is None
    for row in (0, 2):
        assert "".join(s["language"] * (s["end"] - s["start"]) for s in spans[row]) == "".join("xyz"[k] for k in best[offsets[row] : offsets[row + 1]])
        assert all(s["language"] != t["language"] for s, t in itertools.pairwise(spans[row]))


PLANTED = ["mail ada@example.com now", "call +1 (555) 123-4567 today", "from host 84.17.3.200 at", "card 4111 1111 1111 1111 ok", "konto DE89 3704 0044 0532 0130 00 bitte", "her ssn 219-09-9999 is"]


def test_personal_data(spark):
    texts = [f"{k} words before. {p}" for k in range(30) for p in PLANTED] + ["nothing here", "on 2024-01-02 at 10:20, version 1.2.3.4", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.personal_data(docs).collect()
    for k, t in enumerate(texts[:180]):
        kinds = {r["kind"] for r in found if r["doc_id"] == k}
        assert ["email", "phone", "ip", "card", "iban", "ssn"][k % 6] in kinds, t
    spans = {(texts[r["doc_id"]][r["start"] : r["end"]]) for r in found}
    assert {"ada@example.com", "+1 (555) 123-4567", "84.17.3.200", "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "219-09-9999"} <= spans
    assert not {r["doc_id"] for r in found} & set(range(180, 184))
    assert pii.personal_data(none_of(spark)).count() == 0 and pii.personal_data(awkward(spark)).count() == 0


def test_long_runs_are_read_once():
    """A megabyte without spaces takes seconds; the time limit is generous, since quadratic time would be hours."""
    for text in ("-" * 1_000_000 + "7", "漢字" * 300_000 + "8@", "a1-" * 300_000, "1." * 500_000, "x@" * 300_000, "A" * 1_000_000 + "1"):
        began = time.time()
        list(pii.spans(text))
        assert time.time() - began < 30


def test_estimation_by_a_plain_loop():
    """Two rounds of expectation and maximisation on a few patterns, by the definition."""
    g = np.random.default_rng(5)
    kind, vote, count = np.full(6, 2), g.integers(-1, 2, (6, 6)), g.integers(1, 50, 6)
    got, _ = pii.estimate(kind, vote, count, rounds=2)
    prior = pii.PRIOR["phone"]
    q = [1 / (1 + math.exp(-(sum(v) + math.log(prior / (1 - prior))))) for v in vote.tolist()]
    for _ in range(2):
        share = (sum(n * x for n, x in zip(count, q, strict=True)) + 20 * prior) / (count.sum() + 20)
        table = {}
        for f in range(6):
            for true in (True, False):
                cells = [4 * x for x in ((0.5, 1.0, 3.0) if true else (3.0, 1.0, 0.5))]
                for v, n, x in zip(vote.tolist(), count, q, strict=True):
                    cells[v[f] + 1] += n * (x if true else 1 - x)
                table[f, true] = [c / sum(cells) for c in cells]
        new = []
        for v in vote.tolist():
            a, b = share, 1 - share
            for f in range(6):
                a, b = a * table[f, True][v[f] + 1], b * table[f, False][v[f] + 1]
            new.append(a / (a + b))
        q = new
    assert np.allclose(got, q)


def test_the_classifier_learns_from_words_too():
    """Spans with the same votes are told apart by the word before, which no labeler knows."""
    parts = (0, 0, 0, 0, 0, 0, 3, 2, 1)
    x = np.array([pii.marks("number", parts, "123456", f"{'gut' if k % 2 else 'schlecht'} ", "") for k in range(200)])
    p = pii.fit(x, np.arange(200) % 2 * 0.98 + 0.01)[x].sum(axis=1)
    assert (p[1::2] > 1).all() and (p[::2] < -1).all()


def test_codes_round_trip():
    for kind in range(8):
        parts = (1, -1, 0, 1, 0, -1, 5, 3, 2)
        k, v, s = pii.parts_of(np.array([pii.code_of(kind, parts)]))
        assert (k[0], *v[0], *s[0]) == (kind, *parts)


@pytest.mark.parametrize("rate", [8000, 11025, 16000, 44100])
def test_resampled_tone(rate):
    n = rate // 4
    y = audio.resample(np.sin(2 * np.pi * 440 * np.arange(n) / rate).astype(np.float32), rate)
    assert len(y) == math.ceil(n * audio.RATE / rate)
    k = np.arange(300, len(y) - 300)
    assert np.abs(y[k] - np.sin(2 * np.pi * 440 * k / audio.RATE)).max() < 0.02


def test_hysteresis_by_definition():
    g = np.random.default_rng(2)
    for _ in range(50):
        e = g.uniform(-60, 0, 80).astype(np.float32)
        want, at = [], None
        for k, x in enumerate([*e, -1000]):
            if at is None and x >= e.max() - audio.OPEN:
                at = k
            elif at is not None and x < e.max() - audio.CLOSE:
                if k - at >= audio.SHORTEST:
                    want.append((at, k))
                at = None
        assert audio.speech(e) == want


def test_tensors_and_awkward_clips(spark):
    rows = [(1, audio.voice("Hello. World.")), (2, None), (3, b""), (4, b"\0"), (5, b"\0\0" * 9000), (5, b"\0\0" * 9000), (6, b"\1\2\3")]
    clips = spark.createDataFrame([(k, bytearray(p) if p is not None else None, 8000 if k != 6 else None) for k, p in rows], "id long, pcm binary, rate int")
    out = audio.features(clips, ["id"])
    t = out.where("tensor is not null").toArrow()
    shaped = audio.tensors(t).to_numpy_ndarray()
    assert shaped.shape == (t.num_rows, audio.FRAMES, audio.MELS)
    assert np.array_equal(shaped, np.stack([np.frombuffer(x, np.float32).reshape(audio.FRAMES, audio.MELS) for x in t.column("tensor").to_pylist()]))
    got = out.collect()
    assert all(r["frames"] == 0 and r["speech"] == [] for r in got if r["id"] in (2, 3, 4, 6))
    silent = [r for r in got if r["id"] == 5]
    assert len(silent) == 4 and all(r["speech"] == [] for r in silent) and np.allclose(np.frombuffer(silent[0]["tensor"], np.float32), audio.FLOOR, atol=1e-3)
    assert any(r["speech"] for r in got if r["id"] == 1)
    voiced = sorted((r["chunk"], r["start_s"], r["end_s"]) for r in got if r["id"] == 1)
    assert voiced[0][1] == 0 and voiced[-1][2] == pytest.approx(len(rows[0][1]) / 2 / 8000, abs=0.03)
    assert audio.features(clips.limit(0), ["id"]).count() == 0 and isinstance(audio.tensors(t.slice(0, 1)), pa.FixedShapeTensorArray)


def test_log_mel_by_definition():
    x = (np.sin(np.arange(3000) * 0.3) * np.linspace(0, 1, 3000)).astype(np.float32)
    mel, energy = audio.log_mel(x)
    n = 1 + math.ceil((len(x) - audio.WINDOW) / audio.HOP)
    assert mel.shape == (n, audio.MELS)
    to_mel, of_mel = lambda f: 2595 * math.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [of_mel(k * to_mel(audio.RATE / 2) / (audio.MELS + 1)) for k in range(audio.MELS + 2)]
    for k in (0, 7, n - 1):
        frame = [float(x[k * audio.HOP + i]) if k * audio.HOP + i < len(x) else 0.0 for i in range(audio.WINDOW)]
        assert energy[k] == pytest.approx(10 * math.log10(max(sum(v * v for v in frame) / audio.WINDOW, 1e-10)), abs=1e-2)
        windowed = np.array([v * (0.5 - 0.5 * math.cos(2 * math.pi * i / audio.WINDOW)) for i, v in enumerate(frame)])
        at = np.arange(audio.WINDOW)
        power = [abs(np.sum(windowed * np.exp(-2j * np.pi * b * at / audio.FFT))) ** 2 for b in range(audio.FFT // 2 + 1)]
        for m in (0, 11, audio.MELS - 1):
            lo, mid, hi = edges[m : m + 3]
            total = sum(p * max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) for p, f in ((p, b * audio.RATE / audio.FFT) for b, p in enumerate(power)))
            assert mel[k, m] == pytest.approx(math.log(max(total, 1e-10)), abs=2e-2)


def test_stored_tensors_and_clashing_keys(spark, tmp_path):
    rows = [(k, "a", audio.voice("Hello there. " * k)) for k in range(4)]
    clips = spark.createDataFrame([(k, c, bytearray(p), 8000) for k, c, p in rows], "pcm int, chunk string, sound binary, rate int")
    out = audio.features(clips, ["pcm", "chunk", "rate"], pcm="sound", rate="rate")
    assert out.columns == ["pcm", "chunk", "rate", "chunk_", "tensor", "frames", "start_s", "end_s", "speech"]
    want = {(r["pcm"], r["chunk_"]): (r["tensor"], r["start_s"], r["end_s"]) for r in out.where("tensor is not null").collect()}
    done = audio.saved(out, f"file://{tmp_path}/tensors")
    assert sum(r["rows"] for r in done.collect()) == len(want)
    t = pq.read_table(f"{tmp_path}/tensors")
    assert t.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), [audio.FRAMES, audio.MELS])
    values = t.column("tensor").combine_chunks().to_numpy_ndarray()
    got = {(a, b): (v.tobytes(), s, e) for a, b, v, s, e in zip(*(t.column(c).to_pylist() for c in ("pcm", "chunk_")), values, *(t.column(c).to_pylist() for c in ("start_s", "end_s")), strict=True)}
    assert got == {k: (bytes(x), s, e) for k, (x, s, e) in want.items()}


def test_url_awkward_rows(spark):
    log = spark.createDataFrame([("bad", "domain", "X.org", "add", "2024-01-02"), ("bad", "domain", "x.org", "remove", "2024-01-04"), ("bad", "domain", "x.org", "add", "2024-01-02"), ("allow", "prefix", "a.x.org/ok", "add", "2024-01-01"), (None, "domain", "x.org", "add", "2024-01-01"), ("bad", "what", "x.org", "add", "2024-01-01"), ("bad", "host", "y.org", "add", None), ("tie", "host", "x.org", "add", "2024-01-03"), ("tie", "host", "x.org", "remove", "2024-01-03")], "list string, kind string, value string, action string, at string").withColumn("at", url_lists.F.to_timestamp("at"))
    seen = [("http://u:p@x.ORG.:80/a?b#c", "2024-01-02"), ("http://x.org", "2024-01-01"), ("http://x.org", "2024-01-04"), ("https://a.x.org//ok/p", "2024-01-03"), ("http://x.org", "2024-01-03"), ("http://x.org", "2024-01-03"), (None, "2024-01-03"), ("x.org", "2024-01-03"), ("http://x.org", None), ("http://notx.org/", "2024-01-03"), ("", "2024-01-03")]
    captures = spark.createDataFrame([(u, t, 1, "v") for u, t in seen], "url string, t string, host int, verdict string")
    for rows in (0, 1000):  # shuffled and broadcast
        out = url_lists.evaluated(captures, log, "to_timestamp(t)", rows)
        assert out.columns == ["url", "t", "host", "verdict", "host_", "fetched_at", "lists", "verdict_"]
        got = sorted((str(r["url"]), str(r["t"]), r["lists"], r["verdict_"]) for r in out.collect())
        want = [("bad", "block"), ("", "none"), ("", "none"), ("allow,bad", "allow"), ("bad", "block"), ("bad", "block"), *[("", "none")] * 5]
        assert got == sorted((str(u), str(t), *w) for (u, t), w in zip(seen, want, strict=True))
    assert url_lists.evaluated(captures.limit(0), log, "to_timestamp(t)").count() == 0 and url_lists.evaluated(captures, log.limit(0), "to_timestamp(t)").count() == 11
