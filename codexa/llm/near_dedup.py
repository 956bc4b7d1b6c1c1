"""Near-duplicate documents by MinHash: a signature-coordinate inverted join.

Every document is posted under its coordinate-value pairs. Two documents are near copies when at least `matches` of their `coordinates` values agree. Documents with equal signatures are one class, which is joined as one. A pair of values that one class alone holds can't agree with another's, so a class with fewer than `matches` shared values leaves at once; of the others only the prefix (the rarest shared values, all but `matches` - 2 of them) is posted, since two classes that agree often enough must collide there twice. A posting list of two classes gives their pair, whose collisions are counted; pairs that collide twice are compared. Longer lists are merged, comparing signatures and skipping classes already known to be of one group, so a group of n copies costs about n comparisons a list, not n * n. Every two classes that meet in a longer list or collide twice are compared or known to be of one group, hence the groups are complete.

Values held by one document in HOT or more (a boilerplate passage, a text copied a million times) are counted by chunks without a shuffle; they are 64 * HOT at most, so their table is broadcast, and no value of a larger share goes through the shuffle that counts the others.

Agreement is counted on 16-bit marks of the values: two different values have the same mark once in 65536, so a pair one short of the bar is taken for one at the bar once in some 2000 times. No pair at the bar is missed.

Defined cases. doc_id is an integer (other types are an error of the cast). Null or empty text, or text without a word: no signature, never a near copy. One word: that word is the only shingle. Null doc_id: can't be named, so it is left out. Rows with the same doc_id are one document, which can't be its own copy; if their texts differ, each is compared, and a row goes only for its own text, so the doc_id can be a copy by one text and be kept by another. Other columns are ignored. An empty table gives an empty result. Of each group the least doc_id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexa.llm._base import U, buffers, fresh, grouped, mix, pieces, prepare, stored, words

COORDINATES, MATCHES, HOT = 64, 32, 1000


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the two-word shingles, aligned with the words (the last of a row repeats the one before), and their offsets by row."""
    h, _, _, at = words(data, offsets)
    if not len(h):
        return h, at
    with np.errstate(over="ignore"):
        pair = h * U(0x9E3779B97F4A7C15)
        pair[:-1] += h[1:]
    some = at[1:] > at[:-1]
    last, single = at[1:][some] - 1, (at[1:] - at[:-1])[some] == 1
    with np.errstate(over="ignore"):
        pair[last] = np.where(single, h[last] * U(0x9E3779B97F4A7C15), pair[np.maximum(last - 1, 0)])
    return mix(pair), at


def signatures(data: np.ndarray, offsets: np.ndarray, coordinates: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have any word, their signatures as uint64, rows x coordinates)."""
    x, at = shingles(data, offsets)
    rows = np.flatnonzero(at[1:] > at[:-1])
    out = np.empty((len(rows), coordinates), U)
    if len(rows):
        starts, t = at[rows], np.empty_like(x)
        factors = mix(np.arange(1, coordinates + 1, dtype=U) * U(77)) | U(1)
        for k in range(coordinates):
            np.multiply(x, factors[k], out=t)
            out[:, k] = np.minimum.reduceat(t, starts)
    return rows, out


def _sign(coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, offsets) = batch.column(0).to_numpy(zero_copy_only=False), buffers(batch.column(1))
            for i, j in pieces(offsets):
                rows, sig = signatures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], coordinates)
                if not len(rows):
                    continue
                k = np.arange(coordinates, dtype=U)
                tokens = (mix(sig ^ mix(k + U(1))) & ~U(63)) | (k & U(63))
                with np.errstate(over="ignore"):
                    same = mix((tokens * mix(k + U(1000))).sum(axis=1, dtype=U))
                flat = pa.array(tokens.view(np.int64).ravel())
                yield pa.record_batch([pa.array(ids[i + rows].astype(np.int64)), batch.column(2).take(pa.array(i + rows)), pa.array(same.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) + 1, dtype=np.int32) * coordinates), flat)], names=["doc_id", "text_hash", "same", "tokens"])

    return run


class _Sets:
    """Disjoint sets over row numbers."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _hot(hot: int):
    """tokens -> (token, n) of those that n documents of a chunk hold, at least 8 and one in `hot`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list[np.ndarray], docs: int) -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(parts), return_counts=True)
            many = n >= max(8, docs / hot)
            return pa.record_batch([pa.array(token[many]), pa.array(n[many])], names=["token", "n"])

        held: list[np.ndarray] = []
        docs = 0
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            docs += batch.num_rows
            if docs >= 50_000:
                yield counted(held, docs)
                held, docs = [], 0
        if docs:
            yield counted(held, docs)

    return run


def _ranked(hot):
    """(same, tokens) -> (same, the hot ones among the tokens as prefix keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, key = hot.value
        for batch in batches:
            lists = batch.column(1)
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            k = np.minimum(np.searchsorted(token, flat), len(token) - 1)
            hit = token[k] == flat
            ends = np.concatenate([[0], np.cumsum(hit)])[at - at[0]]
            some = np.flatnonzero(ends[1:] > ends[:-1])
            offsets = np.concatenate([[0], ends[1:][some]]).astype(np.int32)
            yield pa.record_batch([batch.column(0).take(pa.array(some)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[k[hit]]))], names=["same", "hot"])

    return run


def _merge(matches: int):
    """Postings (token, class, 16-bit marks) sorted by token, of lists of three classes or more -> pairs that agree in `matches` values or more; enough of them to connect all that do."""
    short = 8

    def link(a: int, b: int, agree: int, sets: _Sets, out: list) -> bool:
        if sets.root(a) == sets.root(b):
            return False
        sets.join(a, b)
        out.append((a, b, agree))
        return True

    def together(ids: np.ndarray, sigs: np.ndarray, sets: _Sets, out: list) -> None:
        """Lists of one length, lists x members: every two members are compared at once."""
        found = []
        for i in range(ids.shape[1]):
            for j in range(i + 1, ids.shape[1]):
                for lo in range(0, len(ids), 8192):
                    agree = (sigs[lo : lo + 8192, i] == sigs[lo : lo + 8192, j]).sum(axis=1)
                    near = np.flatnonzero(agree >= matches)
                    found.append(np.stack([ids[lo + near, i], ids[lo + near, j], agree[near]], 1))
        for a, b, agree in np.unique(np.concatenate(found), axis=0).tolist():
            link(a, b, agree, sets, out)

    def one(ids: np.ndarray, sigs: np.ndarray, sets: _Sets, out: list) -> None:
        """A long list: each member against those after it that are not known to be of its group."""
        roots = np.array([sets.root(x) for x in ids.tolist()])
        for r in range(len(ids) - 1):
            others = r + 1 + np.flatnonzero(roots[r + 1 :] != roots[r])
            if not len(others):
                if (roots == roots[r]).all():
                    return
                continue
            for lo in range(0, len(others), 65536):
                part = others[lo : lo + 65536]
                agree = (sigs[part] == sigs[r]).sum(axis=1)
                for k in np.flatnonzero(agree >= matches).tolist():
                    gone = roots[part[k]]
                    if link(int(ids[r]), int(ids[part[k]]), int(agree[k]), sets, out):
                        roots[(roots == gone) | (roots == roots[r])] = sets.root(int(ids[r]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, out = _Sets(), []
        rest: list[tuple] = []
        width = 0

        def lists(tok: np.ndarray, ids: np.ndarray, sig: np.ndarray) -> None:
            at = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            size = np.diff(np.concatenate([at, [len(tok)]]))
            for n in range(2, short + 1):
                if len(own := at[size == n]):
                    members = own[:, None] + np.arange(n)
                    together(ids[members], sig[members], sets, out)
            for a, n in zip(at[size > short].tolist(), size[size > short].tolist(), strict=True):
                one(ids[a : a + n], sig[a : a + n], sets, out)

        for batch in batches:
            if not batch.num_rows:
                continue
            tok, ids, column = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            width = width or len(column[0].as_py()) // 2
            sig = np.frombuffer(buffers(column)[0], np.uint16).reshape(-1, width)
            cut = int(np.searchsorted(tok, tok[-1]))
            if cut:
                lists(*[np.concatenate(x) for x in zip(*rest, (tok[:cut], ids[:cut], sig[:cut]), strict=True)])
                rest = []
            elif rest and rest[-1][0][0] != tok[0]:
                lists(*[np.concatenate(x) for x in zip(*rest, strict=True)])
                rest = []
            rest.append((tok[cut:], ids[cut:], sig[cut:]))
            if len(out) > 50_000:
                yield _pairs(out)
                out.clear()
        if rest:
            lists(*[np.concatenate(x) for x in zip(*rest, strict=True)])
        yield _pairs(out)

    return run


def _compare(matches: int):
    """(class_a, class_b, marks of both) -> the pairs that agree in `matches` values or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(buffers(batch.column(k))[0], np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
                agree = (a == b).sum(axis=1).astype(np.int32)
                near = pa.array(agree >= matches)
                yield pa.record_batch([batch.column(0).filter(near), batch.column(1).filter(near), pa.array(agree).filter(near)], names=["class_a", "class_b", "agree"])

    return run


def _pairs(out: list) -> pa.RecordBatch:
    a = np.array(out, np.int64).reshape(-1, 3)
    return pa.record_batch([pa.array(np.minimum(a[:, 0], a[:, 1])), pa.array(np.maximum(a[:, 0], a[:, 1])), pa.array(a[:, 2].astype(np.int32))], names=["class_a", "class_b", "agree"])


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted tokens -> the signature as 16-bit values by coordinate; a value no other class holds gets a mark from the class's own number."""
    for batch in batches:
        reps, lists = batch.column(0).to_numpy(), batch.column(1)
        flat, at = lists.flatten().to_numpy().view(U), lists.offsets.to_numpy()
        at = at - at[0]
        row = np.repeat(np.arange(len(reps)), np.diff(at))
        width = COORDINATES
        with np.errstate(over="ignore"):
            full = (mix(reps.astype(U)[:, None] * U(width) + np.arange(width, dtype=U)) >> U(40)).astype(np.uint16)
        full[row, (flat & U(63)).astype(np.int64)] = (flat >> U(20)).astype(np.uint16)
        ends = pa.py_buffer(np.arange(len(reps) + 1, dtype=np.int32) * (2 * width))
        yield pa.record_batch([batch.column(0), pa.Array.from_buffers(pa.binary(), len(reps), [None, ends, pa.py_buffer(full)]), batch.column(2)], names=["same", "sig", "prefix"])


def signed(docs: DataFrame, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, text_hash, same: the class of equal signatures, tokens: the posted coordinate-value pairs), written to the shared folder."""
    assert 1 <= coordinates <= COORDINATES
    prepare(docs.sparkSession)
    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return stored(named.mapInArrow(_sign(coordinates), "doc_id long, text_hash long, same long, tokens array<long>"), "signed")


#: The order of a prefix: the number of postings (its magnitude) first; then the value's own bits, and the coordinate, so that a posting is two longs.
_KEY = "(cast(floor(log2(n)) as bigint) << 58) | (shiftrightunsigned(token, 12) << 6) | (token & 63)"


def hot_tokens(signed_docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(token, key) of the values that one document in `hot` holds, and 64 documents at least."""
    least = max(64, signed_docs.count() / hot)
    found = signed_docs.select("tokens").mapInArrow(_hot(2 * hot), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return stored(found.select("token", F.expr(_KEY).alias("key")), "hot")


def slim_classes(signed_docs: DataFrame, matches: int = MATCHES, hot: int = HOT) -> DataFrame:
    """(same, sig: marks by coordinate, prefix) of the classes with `matches` shared values or more, written to the shared folder."""
    spark = signed_docs.sparkSession
    hots = hot_tokens(signed_docs, hot)
    table = hots.toArrow()  # 64 * hot rows at most
    order = np.argsort(table.column(0).to_numpy())
    token, key = (table.column(k).to_numpy()[order] for k in (0, 1))
    posted = signed_docs.select("same", F.explode("tokens").alias("token"))
    if len(token):
        posted = posted.join(F.broadcast(hots.select(F.col("token").alias("hot_token"))), F.col("token") == F.col("hot_token"), "left_anti")
    w = Window.partitionBy("token").orderBy("same")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a value is shared if two classes hold it; of the copies of one class the first stands for all; the number of postings only orders the prefix
    shared = posted.withColumns({"n": F.count("*").over(every), "lo": F.first("same").over(every), "hi": F.last("same").over(every), "before": F.lag("same").over(w)}).where("lo <> hi and (before is null or before <> same)")
    lists = shared.select("same", F.expr(_KEY).alias("key")).repartition("same").groupBy("same").agg(F.collect_list("key").alias("keys"))
    if len(token):
        ranked = signed_docs.select("same", "tokens").mapInArrow(_ranked(spark.sparkContext.broadcast((token, key))), "same long, hot array<long>")
        warm = ranked.groupBy(F.col("same").alias("own")).agg(F.first("hot").alias("hot"))
        none = F.array().cast("array<long>")
        lists = lists.join(warm, F.col("same") == F.col("own"), "full").select(F.coalesce("same", "own").alias("same"), F.concat(F.coalesce("keys", none), F.coalesce("hot", none)).alias("keys"))
    kept = lists.where(F.size("keys") >= matches).select("same", F.array_sort("keys").alias("keys"))
    return stored(kept.select("same", "keys", F.expr(f"slice(keys, 1, size(keys) - {matches - 2})").alias("prefix")).mapInArrow(_narrow, "same long, sig binary, prefix array<long>"), "classes")


def near_classes(signed_docs: DataFrame, matches: int = MATCHES, hot: int = HOT) -> DataFrame:
    """(class_a, class_b, agree) of classes that agree in `matches` coordinates or more; the pairs connect every two classes that do so, each pair compared and above the threshold itself."""
    assert matches >= 2
    slim = slim_classes(signed_docs, matches, hot)
    w = Window.partitionBy("token")
    postings = slim.select(F.explode("prefix").alias("token"), "same")
    lists = postings.withColumns({"n": F.count("*").over(w), "lo": F.min("same").over(w), "hi": F.max("same").over(w)}).where("n > 1")
    lists = stored(lists.where("n > 2 or same = lo").select("token", "same", F.when(F.col("n") == 2, F.col("hi")).alias("other")), "lists")
    twice = lists.where("other is not null").groupBy(F.col("same").alias("class_a"), F.col("other").alias("class_b")).count().where("count > 1").drop("count")
    own = slim.select("same", "sig")
    pairs = twice.join(own, F.col("class_a") == F.col("same")).select("class_a", "class_b", F.col("sig").alias("sig_a")).join(own, F.col("class_b") == F.col("same")).select("class_a", "class_b", "sig_a", "sig")
    longer = lists.where("other is null").select("token", F.col("same").alias("class")).join(own, F.col("class") == F.col("same")).select("token", "same", "sig")
    merged = longer.repartition("token").sortWithinPartitions("token", "same").mapInArrow(_merge(matches), "class_a long, class_b long, agree int")
    found = pairs.mapInArrow(_compare(matches), "class_a long, class_b long, agree int").unionAll(merged)
    return found.groupBy("class_a", "class_b").agg(F.max("agree").alias("agree"))


def _rows(docs: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(doc_id, text_hash, kept_id) of the texts that are near copies, directly or through others, of one with a lesser doc_id."""
    s = signed(docs, coordinates)
    roots = grouped(near_classes(s, matches), "class_a", "class_b")
    placed = s.select("doc_id", "text_hash", "same").join(roots, F.col("same") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("root", "same").alias("root"))
    least = placed.groupBy(F.col("root").alias("group")).agg(F.min("doc_id").alias("kept_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return placed.join(least, F.col("root") == F.col("group")).where("doc_id <> kept_id").select("doc_id", "text_hash", "kept_id").distinct()


def near_copies(docs: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """(doc_id, kept_id) of every document that is a near copy, directly or through others, of one with a lesser doc_id; kept_id is the least of its group."""
    return _rows(docs, coordinates, matches).groupBy("doc_id").agg(F.min("kept_id").alias("kept_id"))


def deduplicate(docs: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """The documents without near copies: of each group the one with the least doc_id stays. A row goes for its own text only. Exactly repeated rows become one; rows without doc_id or words stay."""
    gone, text = fresh(docs.columns, "gone_id"), fresh(docs.columns, "gone_text")
    copies = _rows(docs, coordinates, matches).select(F.col("doc_id").alias(gone), F.col("text_hash").alias(text))
    left = docs.join(copies, (docs["doc_id"] == F.col(gone)) & (F.xxhash64(docs["text"].cast("string")) == F.col(text)), "left_anti")
    twice = fresh(docs.columns, "twice_id")
    repeated = stored(docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(twice)).count().where("count > 1").select(twice), "repeated")
    if repeated.isEmpty():
        return left
    return left.join(repeated, left["doc_id"] == F.col(twice), "left_anti").unionByName(left.join(repeated, left["doc_id"] == F.col(twice), "left_semi").dropDuplicates())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
