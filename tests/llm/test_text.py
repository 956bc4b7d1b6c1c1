"""Decontamination, quality, tokens, packing."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codexa.llm import decontaminate as dc
from codexa.llm import packing, quality_lm, token_prefix
from codexa.llm._base import U, buffers, words
from tests.llm.helpers import awkward, none_of, prose
from tests.oracle import DATA


def test_leaks_against_every_window_and_part(spark):
    """The candidate search keeps nine tenths or more of what verifying every window with every part finds, and adds nothing."""
    sf = f"{DATA}/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    _, idf = dc.latent(docs.select("text"))
    parts = [(r["item_id"], p) for r in bench.collect() for p in dc.parts_of(words(*buffers(pa.array([r["text"]])))[0])]
    want = set()
    for r in docs.collect():
        h = words(*buffers(pa.array([r["text"]])))[0]
        last = max(1, -(-len(h) // dc.BLOCK) - 1)
        text = np.zeros((last, 4 * dc.BLOCK), U)
        for k in range(last):
            own = h[max(0, k - 1) * dc.BLOCK : (k + 3) * dc.BLOCK]
            text[k, : len(own)] = own
        for item, p in parts:
            share, tail = dc._lcs(p, text) / len(p), p[-max(1, len(p) // 4) :]
            for k in np.flatnonzero(share >= dc.LIKELY):
                w = idf[(p >> U(50)).astype(np.int64)]
                if share[k] >= dc.SURE or dc._lcs(tail, text[k : k + 1])[0] / len(tail) >= dc.ANSWER and w[np.isin(p, text[k])].sum() >= dc.WEIGHT * w.sum():
                    want.add((r["doc_id"], item))
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, bench).collect()}
    assert want and got <= want and len(got) >= 0.9 * len(want)
    assert got == {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, bench, items_at_once=7).collect()}


def test_leaks_awkward_rows(spark):
    item = prose(20, 60)
    docs = awkward(spark).unionByName(awkward(spark).limit(1).selectExpr("99L as doc_id", f"'{prose(21, 300)} {item} {prose(22, 300)}' as text", *awkward(spark).columns[2:]))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item), (3, ""), (4, "?!")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, bench).collect()] == [(99, 1)]
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert dc.leaks(none_of(spark), bench).count() == 0 and dc.leaks(docs, bench.limit(0)).count() == 0


def kneser_ney(texts):
    """Log-probability of a text, by dictionaries, from the definition."""
    counts = {5: Counter(), **{k: Counter() for k in range(1, 5)}}
    for t in texts:
        p = bytes([quality_lm.PAD] * 4) + t
        for i in range(4, len(p)):
            counts[5][p[i - 4 : i + 1]] += 1
    for k in (4, 3, 2, 1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    d = {k: quality_lm.discounts(*[sum(v == i for v in counts[k].values()) for i in range(1, 5)]) for k in counts}
    by = {k: defaultdict(list) for k in counts}
    for k in counts:
        for g, v in counts[k].items():
            by[k][g[:-1]].append(v)

    def p_of(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        held = by[k][g[:-1]]
        if not held:
            return p_of(g[1:])
        total, cut = sum(held), sum(d[k][min(v, 3) - 1] for v in held)
        v = counts[k][g]
        return ((v - d[k][min(v, 3) - 1]) / total if v else 0) + cut / total * p_of(g[1:])

    def log_p(t):
        p = bytes([quality_lm.PAD] * 4) + t
        return sum(math.log(p_of(p[i - 4 : i + 1])) for i in range(4, len(p)))

    return log_p


def test_kneser_ney_from_the_definition(spark):
    trusted = [prose(k, 60) for k in range(8)]
    log_p = kneser_ney([t.encode() for t in trusted])
    probe = [prose(3, 20), prose(50, 30), "Zürich ~ 7\n", "q"]
    df = spark.createDataFrame([(t,) for t in probe], "text string")
    for rows in (10**9, 500):  # one shard, and many
        model = quality_lm.Model(spark.createDataFrame([(t,) for t in trusted], "text string"), rows)
        got = {r["text"]: r["_log_p"] for r in model.scored(df, ["text"]).collect()}
        for t in probe:
            assert abs(got[t] - log_p(t.encode())) < 1e-3 * len(t)


def test_quality_separates_and_keeps_awkward_rows(spark):
    r = random.Random(9)
    lexicon = prose(0, 3000).split()
    good = [(k, " ".join(r.choice(lexicon) for _ in range(90)), "en") for k in range(200)]
    junk = [(1000 + k, "".join(chr(r.randint(33, 126)) for _ in range(400)), "en") for k in range(50)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(150)] + [(151, 1, 0), (151, 0, 0), (152, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {x["doc_id"] for x in quality_lm.accepted(docs, labels).collect()}
    assert not kept & {k for k, *_ in junk} and len(kept) >= 195
    out = quality_lm.scores(awkward(spark), labels)
    assert out.columns == [*awkward(spark).columns, "perplexity_", "threshold", "accepted"] and out.count() == 13
    assert all(not x["accepted"] and x["perplexity_"] is None for x in out.collect() if not x["text"])
    assert all(x["accepted"] for x in out.collect() if x["text"] and x["threshold"] is None)
    assert quality_lm.scores(none_of(spark), labels).count() == 0 and quality_lm.accepted(awkward(spark), labels.limit(0)).count() == 10


def test_quality_rejects_held_out_labelled_rows(spark):
    """A fifth of the labels is kept from the classifier; toxic documents in good prose and repeated words must go, clean ones stay."""
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(5)) == 1
    out = quality_lm.scores(docs, labels.where(~held)).where(F.octet_length("text") > 0).join(labels.where(held), "doc_id")
    gone = lambda rows: rows.agg(F.avg((~F.col("accepted")).cast("int"))).first()[0]
    assert gone(out.where("lang = 'en' and quality = 1 and toxic = 1")) > 0.6
    assert gone(out.where("quality = 0 and toxic = 0")) > 0.99
    assert gone(out.where("quality = 1 and toxic = 0")) < 0.04


def test_every_prefix_as_encoded():
    c = token_prefix.counter(token_prefix.VOCABULARY)
    r = random.Random(4)
    texts = ["I'll say it's  done.\n\n 12,345 a_b -- naïve café 東京 🙂🙂 !!!", "  \t\n x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "don't'stop", "a\xa0b　c d", " ", "'", *["".join(r.choice("ab 'stle.,1\n é　界") for _ in range(60)) for _ in range(60)]]
    for t in texts:
        steps, wide = c.steps(t)
        got = token_prefix.counts_of(steps.tobytes(), wide)
        assert got.tolist() == [len(c.encoding.encode_ordinary(t[:p])) for p in range(len(t) + 1)], t
        for budget in (0, 1, 5, 10**6):
            assert token_prefix.chars_within(steps.tobytes(), budget, wide) == max(p for p in range(len(t) + 1) if got[p] <= budget)


def test_new_words_need_few_look_ups():
    """Words not met before, every prefix of each, need less than one look-up in the vocabulary a byte."""

    class Watched(dict):
        seen = 0

        def __contains__(self, key):
            self.seen += 1
            return super().__contains__(key)

    r = random.Random(6)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "tion", "ing", "ble", "ly", "ou"]
    fresh = list(dict.fromkeys(" " + "".join(r.choice(syllables) for _ in range(r.randint(3, 6))) for _ in range(30_000)))
    c = token_prefix.Counter(token_prefix.VOCABULARY)
    c.steps("".join(fresh[:20_000]))
    c.ranks = Watched(c.ranks)
    rest = "".join(fresh[20_000:])
    c.steps(rest)
    assert len(rest) > 50_000 and c.ranks.seen < len(rest)


def test_long_tokens_and_forgetting(monkeypatch):
    """Tokens of any length, broken off and put together, with caches so small that all is forgotten again and again."""
    monkeypatch.setattr(token_prefix, "_KEPT", 40)
    c = token_prefix.Counter(token_prefix.VOCABULARY)
    r = random.Random(7)
    tokens = [t.decode(errors="ignore") for t in sorted(c.ranks, key=len)]
    texts = [*tokens[-40:], *["".join(x[: r.randint(1, len(x))] for x in r.choices(tokens[256:], k=4) if x) for _ in range(300)], *[w + e for w in ("don't", " naïve", "'s", "\nword", "  x") for e in ".,;:"]]
    for t in texts:
        steps, wide = c.steps(t)
        assert token_prefix.counts_of(steps.tobytes(), wide).tolist() == [len(c.encoding.encode_ordinary(t[:p])) for p in range(len(t) + 1)], t
        assert c.steps(t)[0].tobytes() == steps.tobytes()


def test_token_counts_awkward_rows(spark):
    c = token_prefix.counter(token_prefix.VOCABULARY)
    out = token_prefix.prefix_counts(awkward(spark)).collect()
    texts = awkward(spark).select("text").collect()
    assert sorted(str(r["tokens"]) for r in out) == sorted(str(None if t is None else len(c.encoding.encode_ordinary(t))) for (t,) in texts)
    assert all(r["steps"] is None for r in out if r["chars"] is None) and token_prefix.prefix_counts(none_of(spark)).count() == 0


def by_definition(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        best = None
        for k in [None, *range(len(bins))]:
            gaps = [capacity - b for b in bins]
            if k is None:
                gaps.append(capacity - s)
            elif gaps[k] < s or gaps[k] == 0:
                continue
            else:
                gaps[k] -= s
            cost = sum(n * n for g, n in Counter(gaps).items() if g)
            rank = (cost, k is None, 0 if k is None else capacity - bins[k])
            if best is None or rank < best[0]:
                best = (rank, k)
        if best[1] is None:
            bins.append(s)
            out.append((len(bins) - 1, 0))
        else:
            out.append((best[1], bins[best[1]]))
            bins[best[1]] += s
    return bins, out


def test_sum_of_squares_by_definition():
    for seed in range(30):
        r = random.Random(seed)
        sizes = [r.randint(1, 12) for _ in range(80)]
        which, start = packing.place(np.array(sizes), 12)
        fill = Counter()
        cost = []
        for s, b, at in zip(sizes, which, start, strict=True):
            assert fill[b] == at and at + s <= 12
            fill[b] += s
            cost.append(sum(n * n for g, n in Counter(12 - f for f in fill.values()).items() if g))
        bins, _ = by_definition(sizes, 12)
        assert sorted(fill.values()) == sorted(bins)


def test_packing_awkward_rows(spark):
    rows = packing.packed(awkward(spark), capacity=1000).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["doc_id"]] += r["size"]
    want = Counter()
    for i, t in awkward(spark).select("doc_id", "text").collect():
        want[i] += len((t or "").encode())
    assert sizes == Counter({k: v for k, v in want.items() if v})
    spans = defaultdict(list)
    for r in rows:
        spans[r["bin"]].append((r["bin_start"], r["bin_start"] + r["size"]))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= 1000 and all(a[1] == b[0] for a, b in zip(s, s[1:]))  # noqa: B905
    again = packing.packed(awkward(spark).repartition(5), capacity=1000).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and packing.packed(none_of(spark)).count() == 0


def test_rows_without_ids_are_spread_over_shards(spark):
    docs = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")), F.col("id").cast("string")).alias("text"))
    out = packing.packed(docs, capacity=256, shard_rows=1000)
    shards = out.groupBy((F.col("bin").bitwiseAND(~((1 << 32) - 1))).alias("shard")).count().collect()
    assert len(shards) == 30 and max(r["count"] for r in shards) < 1500
    assert out.groupBy("bin").agg(F.sum("size").alias("n"), F.count_distinct("bin_start").alias("k"), F.count("*").alias("m")).where("n > 256 or k <> m").isEmpty()


def test_limits_by_definition(spark):
    """The limit of each language is the quantile that parts good from other rows best, by the definition."""
    r = random.Random(9)
    rows = [(lang, good, r.gauss(3 if good else shift, 1)) for lang, shift in (("en", 5), ("de", 3.5), ("fr", 8)) for good in (True, False) for _ in range(60 if good else 30)] + [("es", True, 2.0), ("es", False, 9.0)]
    own, whole = quality_lm.limits(spark.createDataFrame(rows, "lang string, _good boolean, p double"), "p")

    def best(some):
        good, other = [v for _, g, v in some if g], [v for _, g, v in some if not g]
        tries = [float(np.quantile(good, q)) for q in quality_lm.QUANTILES]
        return max((sum(v > t for v in other) / len(other) - quality_lm.COST * sum(v > t for v in good) / len(good), t) for t in tries)[1]

    assert set(own) == {"en", "de", "fr"}
    for lang, limit in own.items():
        assert limit == pytest.approx(best([x for x in rows if x[0] == lang]))
    assert whole == pytest.approx(best(rows))
    assert quality_lm.limits(spark.createDataFrame(rows[:0], "lang string, _good boolean, p double"), "p") == ({}, None)
