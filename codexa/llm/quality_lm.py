"""Quality classifier: an interpolated modified Kneser-Ney model over byte 5-grams of trusted text.

Trusted documents are those labelled quality 1 and not toxic. A fifth of them (by a hash of doc_id) calibrates, the others are counted. The threshold of a language is one of QUANTILES of its calibrating documents' perplexities: the one for which the share of the language's documents labelled otherwise that lies above it, less COST times the share of the calibrating ones above it, is greatest (the higher one of equals). A language with fewer than ENOUGH of either kind takes the choice over all languages, and with fewer than ENOUGH labelled otherwise in all, the threshold is the quantile `quantile`.

Text that says the same word over and over has the perplexity of that word, which is an ordinary one. So the share of words that equal the word before, over the number of words plus FEW, has a limit that is chosen in the same way; without ENOUGH documents labelled otherwise there is none. A document is accepted if its perplexity is at most its language's threshold and its repeats are within their limit.

Counts are whole: every 5-gram of every counted document goes into a shuffled sum, and the lower orders' continuation counts, context totals and discounts come from those. Scoring joins the counts shard by shard: an n-gram, its suffixes and their contexts all meet in the shard of the byte before the last, each shard holds `shard_rows` rows or fewer where a single such byte allows it, is sorted and broadcast, and each document's log-probabilities are added up. A corpus whose model fits one shard is scored in one pass.

Perplexity is per byte, shrunk: sum of -log p over n bytes, plus PRIOR times the calibrating bytes' mean of the language, over n + PRIOR, so that a very short text is not judged on a few bytes.

Defined cases. Null or empty text: perplexity null, not accepted. Null doc_id: scored, but neither counted nor calibrating. A null language is a language of its own. A doc_id with several labels is trusted if every one of them says so; labels null in any of the three columns are ignored. No trusted document: every threshold is null and all documents with text are accepted. Rows are never merged; other columns of the input stay, and a score column whose name is taken gets underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexa.llm._base import U, buffers, fresh, pieces, prepare, small, stored

ORDER, PAD = 5, 10
PRIOR = 64
QUANTILE, QUANTILES, COST, ENOUGH = 0.995, (0.9, 0.95, 0.97, 0.98, 0.985, 0.99, 0.995, 1.0), 5, 20
FEW = 10
SHARD_ROWS, BROADCAST_ROWS = 6_000_000, 5_000_000
_MASK = [0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF, 0xFFFFFFFFFF]


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the 40-bit code of it and the four before it in its row; before the row's start come line ends."""
    code = data.astype(U)
    n = len(data)
    starts, ends = offsets[:-1], offsets[1:]
    for k in range(1, ORDER):
        back = np.full(n, PAD, np.uint8)
        back[k:] = data[:-k] if k < n else data[:0]
        for j in range(k):
            at = (starts + j)[starts + j < ends]
            back[at] = PAD
        code |= back.astype(U) << U(8 * k)
    return code


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(codes)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[at], np.diff(np.concatenate([at, [len(s)]]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes and counts, merged over a task's batches while they stay below some millions."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        o = np.argsort(code)
        code, n = code[o], n[o]
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        return code[at], np.add.reduceat(n, at)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        for i, j in pieces(offsets, 1 << 21):
            codes = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if len(codes):
                held.append(counted(codes))
                size += len(held[-1][0])
        if size > 2_000_000:
            held = [merged(held)]
            size = len(held[0][0])
            if size > 1_000_000:
                yield pa.record_batch([pa.array(held[0][0].astype(np.int64)), pa.array(held[0][1].astype(np.int64))], names=["code", "n"])
                held, size = [], 0
    if held:
        code, n = merged(held)
        yield pa.record_batch([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])


class Shard:
    """Sorted n-gram tables of one shard and the log-probability of 5-gram codes whose byte before the last is the shard's."""

    def __init__(self, order: np.ndarray, code: np.ndarray, n: np.ndarray, discounts: dict[int, tuple[float, float, float]], last: np.ndarray):
        self.tables, self.first = {}, last
        for k in range(2, ORDER + 1):
            own = order == k
            c, v = code[own].astype(U), n[own].astype(np.float64)
            o = np.argsort(c)
            c, v = c[o], v[o]
            d = np.array([0.0, *discounts[k]])
            cut = d[np.minimum(v, 3).astype(np.int64)]
            context = c >> U(8)
            at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(c) else np.zeros(0, np.int64)
            total = np.add.reduceat(v, at) if len(c) else v
            lost = np.add.reduceat(cut, at) if len(c) else v
            where = np.repeat(np.arange(len(at)), np.diff(np.concatenate([at, [len(c)]])))
            self.tables[k] = (c, ((v - cut) / total[where] if len(c) else v).astype(np.float32), context[at], (lost / total if len(c) else v).astype(np.float32))

    def log_p(self, code: np.ndarray) -> np.ndarray:
        p = self.first[(code & U(0xFF)).astype(np.int64)].astype(np.float64)
        for k in range(2, ORDER + 1):
            c, share, context, rest = self.tables[k]
            if not len(c):
                continue
            own = code & U(_MASK[k])
            h = own >> U(8)
            i = np.minimum(np.searchsorted(context, h), len(context) - 1)
            known = context[i] == h
            j = np.minimum(np.searchsorted(c, own), len(c) - 1)
            p = np.where(known, np.where(c[j] == own, share[j], 0) + rest[i] * p, p)
        return np.log(p)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from the counts of counts; where those are too few to say, 0.5, 1 and 1.5."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(float(np.clip(k - (k + 1) * y * b / a, 0.05, k - 0.05)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _scored(shard: Broadcast, members: np.ndarray, at: int, added: tuple[str, str]):
    """Adds (sum of log p, bytes) of the shard's positions to each row, under the names `added`; column `at` is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Shard = shard.value
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            total = np.zeros(batch.num_rows)
            for i, j in pieces(offsets, 1 << 21):
                codes = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if not len(codes):
                    continue
                logs = np.zeros(len(codes))
                for lo in range(0, len(codes), 1 << 23):
                    part = codes[lo : lo + (1 << 23)]
                    s = np.sort((part << U(23)) | np.arange(len(part), dtype=U))
                    code, pos = s >> U(23), (s & U((1 << 23) - 1)).astype(np.int64)
                    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                    each = code[first]
                    mine = members[((each >> U(8)) & U(0xFF)).astype(np.int64)]
                    log = np.zeros(len(each))
                    log[mine] = model.log_p(each[mine])
                    logs[lo + pos] = np.repeat(log, np.diff(np.concatenate([first, [len(code)]])))
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                total[i:j] = sums[offsets[i + 1 : j + 1] - offsets[i]] - sums[offsets[i:j] - offsets[i]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total), pa.array(np.diff(offsets))], names=[*batch.schema.names, *added])

    return run


class Model:
    """Counts of all orders in the shared folder, with discounts and the shards to score by."""

    def __init__(self, text: DataFrame, shard_rows: int = SHARD_ROWS):
        self.spark, self.shard_rows = text.sparkSession, shard_rows
        prepare(self.spark)
        top = text.mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        levels = [stored(top, "grams")]
        for k in range(ORDER - 1, 0, -1):
            levels.append(stored(levels[-1].groupBy(F.col("code").bitwiseAND(F.lit(_MASK[k]).cast("long")).alias("code")).agg(F.count("*").alias("n")), "grams"))
        self.levels = dict(zip(range(ORDER, 0, -1), levels, strict=True))
        self.discounts = {}
        for k, level in self.levels.items():
            self.discounts[k] = discounts(*level.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]).first())
        v = np.zeros(256)
        for code, n in self.levels[1].collect():  # 256 rows at most
            v[code] = n
        d = np.array([0.0, *self.discounts[1]])[np.minimum(v, 3).astype(np.int64)]
        self.first = (v - d) / max(v.sum(), 1) + (d.sum() if v.sum() else 1) / max(v.sum(), 1) / 256
        self.first /= self.first.sum()
        self.counts = {k: level for k, level in self.levels.items() if k > 1}

    def shards(self) -> Iterator[tuple[Broadcast, np.ndarray]]:
        """One by one: the shard, broadcast, and which bytes before the last are its own."""
        rows = None
        for k, level in self.counts.items():
            tagged = level.select(F.lit(k).alias("k"), "code", "n", F.shiftrightunsigned("code", 8).bitwiseAND(255).cast("int").alias("byte"))
            rows = tagged if rows is None else rows.unionAll(tagged)
        sizes = {r["byte"]: r["count"] for r in rows.groupBy("byte").count().collect()}  # 256 rows at most
        parts: list[tuple[int, list[int]]] = []
        for byte in sorted(sizes):
            if parts and parts[-1][0] + sizes[byte] <= self.shard_rows:
                parts[-1] = (parts[-1][0] + sizes[byte], [*parts[-1][1], byte])
            else:
                parts.append((sizes[byte], [byte]))
        for k, (_, own) in enumerate(parts or [(0, [])]):
            members = np.zeros(256, bool)
            members[own] = True
            if k == 0:  # bytes never seen before another are scored by the first shard
                members[[b for b in range(256) if b not in sizes]] = True
            got = rows.where(F.col("byte").isin(own)).select("k", "code", "n").toArrow() if own else None
            a = [got.column(i).to_numpy() for i in range(3)] if got is not None else [np.zeros(0, np.int64)] * 3
            yield self.spark.sparkContext.broadcast(Shard(*a, self.discounts, self.first)), members

    def scored(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """docs' columns `keep`, one of them text, and last the sum of log p and the bytes: _log_p and _bytes, with underscores where these names are taken."""
        at, shards = keep.index("text"), list(self.shards())
        added = fresh(keep, "_log_p"), fresh(keep, "_bytes")
        new = [T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.LongType())]
        out = docs.select(*keep)
        if len(shards) == 1:
            return out.mapInArrow(_scored(*shards[0], at, added), T.StructType([*out.schema, *new]))
        # several shards: a pass for each adds its part, and the last sum is the whole
        before = fresh([*keep, *added], "_before")
        for k, (shard, members) in enumerate(shards):
            if k:
                out = out.withColumnsRenamed({added[0]: before}).drop(added[1])
            out = out.mapInArrow(_scored(shard, members, at, added), T.StructType([*out.schema, *new]))
            if k:
                out = out.withColumn(added[0], F.col(added[0]) + F.col(before)).drop(before)
        return out.select(*keep, *added)


def labelled_ids(labels: DataFrame) -> DataFrame:
    """(_id, _good, _calibrates) of the labelled documents; good are those that every label calls good and harmless."""
    of = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id"))
    return of.agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("_good")).withColumn("_calibrates", F.pmod(F.xxhash64("_id"), F.lit(5)) == 0)


def repeats(text: str) -> F.Column:
    """The share of words that the same word follows."""
    return F.regexp_count(text, F.lit(r"(?<!\S)(\S+)\s+(?=\1(?!\S))")) / (F.regexp_count(text, F.lit(r"\S+")) + FEW)


def limits(rated: DataFrame, value: str) -> tuple[dict[str, float], float | None]:
    """By language, and over all, the limit of `value` that parts good from other rows of `rated` best; None without enough of both."""
    each = rated.select("_good", F.col(value).alias("v"), F.explode(F.array(F.struct(F.lit(False).alias("all"), "lang"), F.struct(F.lit(True).alias("all"), F.lit("").alias("lang")))).alias("of"))
    tried = each.where("_good").groupBy("of").agg(F.percentile("v", F.array(*map(F.lit, QUANTILES))).alias("tried"))
    above = [F.count_if((F.col("v") > F.col("tried")[k]) & (F.col("_good") == good)) for k in range(len(QUANTILES)) for good in (True, False)]
    own, whole = {}, None
    for r in each.join(F.broadcast(tried), "of").groupBy("of").agg(F.first("tried").alias("tried"), F.count_if("_good").alias("n"), F.count_if(~F.col("_good")).alias("others"), F.array(*above).alias("above")).collect():  # a row a language
        if min(r["n"], r["others"]) >= ENOUGH:
            best = max((r["above"][2 * k + 1] / r["others"] - COST * r["above"][2 * k] / r["n"], limit) for k, limit in enumerate(r["tried"]))[1]
            if r["of"]["all"]:
                whole = best
            else:
                own[r["of"]["lang"]] = best
    return own, whole


def scores(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs with perplexity, threshold and accepted."""
    prepare(docs.sparkSession)
    ids = small(stored(labelled_ids(labels), "labelled"), BROADCAST_ROWS)
    slim = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    labelled = slim.join(ids, "_id")
    model = Model(labelled.where("_good and not _calibrates").select("text"), shard_rows)
    judged = stored(model.scored(labelled.where("_calibrates or not _good"), ["text", "lang", "_good"]).where("_bytes > 0").select("lang", "_good", "_log_p", "_bytes", repeats("text").alias("r")), "judged")
    calibrating = judged.where("_good")
    means = {r["lang"]: (r["m"], r["n"]) for r in calibrating.groupBy("lang").agg((-F.sum("_log_p") / F.sum("_bytes")).alias("m"), F.count("*").alias("n")).collect()}
    overall = calibrating.agg((-F.sum("_log_p") / F.sum("_bytes")).alias("m")).first()["m"]
    mean = {k: m for k, (m, n) in means.items() if n >= ENOUGH}

    def by_language(lang, values: dict, other) -> F.Column:
        """A literal map over the languages, whose number does not grow with the corpus."""
        if not values:
            return F.lit(other).cast("double")
        table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
        return F.coalesce(F.try_element_at(table, lang), F.lit(other).cast("double"))

    def perplexity(lang, log_p: str, size: str) -> F.Column:
        shrunk = (-F.col(log_p) + PRIOR * by_language(lang, mean, 0.0 if overall is None else overall)) / (F.col(size) + PRIOR)
        return F.when(F.col(size) > 0, F.exp(shrunk))

    rated = judged.select("lang", "_good", perplexity(F.col("lang"), "_log_p", "_bytes").alias("p"), "r")
    highest, whole = limits(rated, "p")
    if whole is None:  # too few labelled otherwise to choose by
        q = rated.where("_good").groupBy("lang").agg(F.percentile("p", quantile).alias("q"), F.count("*").alias("n"))
        highest = {r["lang"]: r["q"] for r in q.where(F.col("n") >= ENOUGH).collect()}
        whole = rated.where("_good").agg(F.percentile("p", quantile).alias("q")).first()["q"]
    most, most_whole = limits(rated, "r")

    names = docs.columns
    text = docs.withColumn("text", F.col("text").cast("string"))
    scored = model.scored(text, names)
    log_p, size = scored.columns[-2:]
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    p, t, a = (fresh(names, x) for x in ("perplexity", "threshold", "accepted"))
    out = scored.withColumn(p, perplexity(lang, log_p, size)).withColumn(t, by_language(lang, highest, whole))
    within = F.lit(True) if most_whole is None else repeats("text") <= by_language(lang, most, most_whole)
    return out.withColumn(a, F.when(F.col(size) == 0, F.lit(False)).otherwise((F.col(t).isNull() | (F.col(p) <= F.col(t))) & within)).select(*names, p, t, a)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their own columns only."""
    out = scores(docs, labels)
    return out.where(F.col(out.columns[-1])).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "lang", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "accepted")
