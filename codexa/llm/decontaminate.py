"""Benchmark decontamination by latent semantic retrieval.

The corpus is cut into passages of BLOCK words. Their TF-IDF matrix A (terms hashed to TERMS columns) is factorised by a randomised SVD: every task adds up its rows' share of A'A times a random TERMS x RANK matrix, the shares are summed by term in a shuffle, and the small factorisation of the sketch (Nystrom's) gives the right singular vectors and values. A passage's latent vector is its row times those vectors, over the values. Benchmark items are cut into parts of at most PART words, each a query; every window of two adjoining blocks (64 words, a step of 32) is compared with every part by cosine, the bar being half of what a window that holds the part word for word would reach. A candidate of which more distinct words are missing around the window than a paraphrase may lack is dropped by bitmaps. The others are verified on words: the longest common subsequence of the part and the window with half a window around it. A share of SURE of the part's words in order is a leak; a share from LIKELY up is a paraphrase, and a leak if the answer, taken to be the last quarter of the part (the tables have no column of answers), is there too (a share of ANSWER of its words in order) and the words found are not only common ones (they have a share of WEIGHT of the part's inverse document frequencies).

Defined cases. Null or empty text, or text without words: no passage, so never a leak. doc_id and item_id are integers. Null doc_id or item_id, or item without words: ignored. Rows with the same doc_id are one document, items with the same item_id one item: the best match counts. An empty benchmark or corpus gives an empty result. Whole texts are searched, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.llm._base import U, buffers, fresh, pieces, prepare, stored, words

BLOCK, PART, TERMS, RANK, BITS = 32, 64, 1 << 14, 64, 2048
SURE, LIKELY, ANSWER, WEIGHT, BAR = 0.8, 0.6, 0.5, 0.5, 0.5
ITEMS_AT_ONCE = 20_000


def _cut(data: np.ndarray, offsets: np.ndarray):
    """Words' hashes, the term of each, the block of each, blocks' first words and rows."""
    h, _, _, at = words(data, offsets)
    n = np.diff(at)
    blocks = -(-n // BLOCK)
    row = np.repeat(np.arange(len(n)), blocks)
    number = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = at[:-1][row] + number * BLOCK
    size = np.diff(np.concatenate([first, [len(h)]]))
    return h, (h >> U(50)).astype(np.uint16), np.repeat(np.arange(len(first)), size), first, row


def _texts(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20):
    for batch in batches:
        data, offsets = buffers(batch.column(column))
        for i, j in pieces(offsets, most):
            if offsets[j] > offsets[i]:
                yield batch, i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, passages that hold it); term -1 has the passages."""
    total, passages = np.zeros(TERMS, np.int64), 0
    for _, _, data, offsets in _texts(batches, 0):
        _, term, block, first, _ = _cut(data, offsets)
        if len(first):
            pair = np.sort((block.astype(np.int64) << 14) | term)
            total += np.bincount(pair[np.concatenate([[True], pair[1:] != pair[:-1]])] & (TERMS - 1), minlength=TERMS)
            passages += len(first)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(np.concatenate([[-1], some]).astype(np.int32)), pa.array(np.concatenate([[passages], total[some]]))], names=["term", "n"])


def _sums(table: np.ndarray, term: np.ndarray, block: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over each block's words, a place in all blocks at a time; the table's last row is 0."""
    place = np.full((len(first), BLOCK), TERMS, np.int64)
    place[block, np.arange(len(term)) - first[block]] = term
    out = np.take(table, place[:, 0], axis=0, mode="clip")
    for k in range(1, BLOCK):
        out += np.take(table, place[:, k], axis=0, mode="clip")
    return out


def _spread(total: np.ndarray, term: np.ndarray, block: np.ndarray, y: np.ndarray, often: int = 24) -> None:
    """Adds to each term's row those of the blocks that its words are in: frequent terms by one product, the others an occurrence at a time."""
    o = np.argsort(term, kind="stable")
    t, b = term[o].astype(np.int64), block[o]
    start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    count = np.diff(np.concatenate([start, [len(t)]]))
    for k in range(often):
        own = start[(count > k) & (count <= often)] + k
        if not len(own):
            break
        total[t[own]] += np.take(y, b[own], axis=0, mode="clip")
    many = np.flatnonzero(count > often)
    if len(many):
        which = np.repeat(np.arange(len(many)), count[many])
        at = np.repeat(start[many] - np.concatenate([[0], np.cumsum(count[many])[:-1]]), count[many]) + np.arange(len(which))
        times = np.bincount(which * len(y) + b[at], minlength=len(many) * len(y)).astype(np.float32).reshape(len(many), len(y))
        total[t[start[many]]] += times @ y


def _padded(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])


def _sketch(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random, idf = shared.value
        total = np.zeros((TERMS, random.shape[1]), np.float64)
        for _, _, data, offsets in _texts(batches, 0):
            _, term, block, first, _ = _cut(data, offsets)
            if not len(first):
                continue
            y = _sums(random, term, block, first)
            y /= np.maximum(np.sqrt((y * y).mean(axis=1, keepdims=True)), 1e-9)  # passages of one weight, whatever their length
            _spread(total, term, block, y)
        total *= idf[:, None]
        some = np.flatnonzero(total.any(axis=1))
        out = total[some].astype(np.float32)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array([x.tobytes() for x in out], pa.binary())], names=["term", "row"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for term, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(row, np.float32).astype(np.float64)
            total[term] = total[term] + x if term in total else x
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], names=["term", "row"])


def latent(texts: DataFrame, rank: int = RANK) -> tuple[np.ndarray, np.ndarray] | None:
    """The TERMS x rank table of words' latent vectors, from the column text, and the inverse document frequencies; None without passages."""
    spark = texts.sparkSession
    counts = texts.mapInArrow(_document_counts, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # TERMS + 1 rows at most
    term, n = counts.column(0).to_numpy(), counts.column(1).to_numpy()
    passages = int(n[term == -1].sum())
    if not passages:
        return None
    df = np.zeros(TERMS)
    df[term[term >= 0]] = n[term >= 0]
    idf = np.log((1 + passages) / (1 + df)).astype(np.float32)
    random = np.random.default_rng(7).standard_normal((TERMS, rank)).astype(np.float32)
    shared = spark.sparkContext.broadcast((_padded(random * idf[:, None]), idf))
    rows = texts.mapInArrow(_sketch(shared), "term int, row binary").repartition("term").mapInArrow(_added, "term int, row binary").toArrow()  # TERMS rows at most
    y = np.zeros((TERMS, rank))
    y[rows.column(0).to_numpy()] = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.float32).reshape(-1, rank)
    core = random.T.astype(np.float64) @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > value.max() * 1e-6
    f = y @ (vector[:, keep] / np.sqrt(value[keep]))
    left, sigma, _ = np.linalg.svd(f, full_matrices=False)
    return (idf[:, None] * left / sigma).astype(np.float32), idf


def _lcs(part: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Bit-parallel longest common subsequences of one part (64 words at most) with each row of texts."""
    n = len(part)
    bit = U(1) << np.arange(n, dtype=U)
    order = np.argsort(part, kind="stable")
    each, at = np.unique(part[order], return_index=True)
    masks = np.concatenate([np.bitwise_or.reduceat(bit[order], at), np.zeros(1, U)])
    where = np.minimum(np.searchsorted(each, texts), len(each) - 1)
    m = masks[np.where(each[where] == texts, where, len(each))]
    v = np.full(len(texts), ~U(0), U)
    with np.errstate(over="ignore"):
        for k in range(texts.shape[1]):
            u = v & m[:, k]
            v = (v + u) | (v - u)
    full = U((1 << n) - 1)
    return np.bitwise_count(~v & full).astype(np.int64)


def _bits(h: np.ndarray, block: np.ndarray, blocks: int) -> np.ndarray:
    """A bitmap of BITS places for the words of each block, as 64-bit words."""
    held = np.zeros((blocks, BITS), bool)
    held[block, (h & U(BITS - 1)).astype(np.int64)] = True
    return np.packbits(held, axis=1).view(U)


def parts_of(item: np.ndarray) -> list[np.ndarray]:
    k = -(-len(item) // PART)
    return np.array_split(item, k) if k else []


def _search(shared):
    """(doc_id, item_id, share, answer, cosine) of the verified matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, parts, idf, items, queries, bars, part_bits, lacking = shared.value
        for batch, i, data, offsets in _texts(batches, 1):
            h, term, block, first, row = _cut(data, offsets)
            if not len(first):
                continue
            z = _sums(table, term, block, first)
            end = np.concatenate([first[1:], [len(h)]])
            follows = np.concatenate([row[1:] == row[:-1], [False]])
            before = np.concatenate([[False], follows[:-1]])
            w = z.copy()
            w[follows] += z[1:][follows[:-1]]
            # a row's last block alone is a window only if the row has no other
            k = np.flatnonzero(follows | ~before)
            w = w[k]
            w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
            near = []
            for lo in range(0, len(w), 2048):  # windows by parts a block at a time, however long the text and the benchmark
                for at in range(0, queries.shape[1], 4096):
                    cosine = w[lo : lo + 2048] @ queries[:, at : at + 4096]
                    x, y = np.nonzero(cosine >= bars[at : at + 4096])
                    near.append((lo + x, at + y, cosine[x, y]))
            win, part, cosine = (np.concatenate(x) for x in zip(*near, strict=True))
            if not len(win):
                continue
            # the window, and a block on either side of it where the row has one
            left = np.where(before[k], k - 1, k)
            right = np.where(follows[k], k + 1, k)
            right = np.where(follows[right], right + 1, right)
            bits = _bits(h, block, len(first))
            around = bits[left] | bits[k] | bits[np.minimum(k + 1, right)] | bits[right]
            lacks = np.concatenate([np.bitwise_count(part_bits[part[a : a + 65536]] & ~around[win[a : a + 65536]]).sum(axis=1, dtype=np.int64) for a in range(0, len(win), 65536)])
            ok = lacks <= lacking[part]
            win, part, cosine = win[ok], part[ok], cosine[ok]
            if not len(win):
                continue
            lo, hi = first[left], end[right]
            o = np.argsort(part, kind="stable")
            win, part, cosine = win[o], part[o], cosine[o]
            bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), [len(part)]])
            found: list[tuple] = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                p, ws = parts[part[a]], win[a:b]
                span = np.arange(4 * BLOCK)
                pos = lo[ws][:, None] + span
                text = np.where(pos < hi[ws][:, None], h[np.minimum(pos, len(h) - 1)], U(0))
                share = _lcs(p, text) / len(p)
                good = np.flatnonzero(share >= LIKELY)
                if len(good):
                    tail = p[-max(1, len(p) // 4) :]
                    answer = _lcs(tail, text[good]) / len(tail)
                    weight = np.array([idf[part[a]][np.isin(p, text[g])].sum() for g in good]) / max(idf[part[a]].sum(), 1e-9)
                    leak = (share[good] >= SURE) | (answer >= ANSWER) & (weight >= WEIGHT)
                    for g, ans in zip(good[leak], answer[leak], strict=True):
                        found.append((int(row[k[ws[g]]]) + i, int(items[part[a]]), float(share[g]), float(ans), float(cosine[a + g])))
            if found:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                r, item, share, answer, cos = zip(*found, strict=True)
                yield pa.record_batch([pa.array(ids[list(r)].astype(np.int64)), pa.array(item, pa.int64()), pa.array(share), pa.array(answer), pa.array(cos)], names=["doc_id", "item_id", "share", "answer", "cosine"])

    return run


_FOUND = "doc_id long, item_id long, share double, answer double, cosine double"


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, share, answer, cosine) of every benchmark item that a document holds; a pair's best match."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    model, out = latent(named.select("text"), rank), None
    if model is not None:
        table, idf = model
        # the benchmark is read a bounded piece at a time; each piece is one more search of the corpus
        held, lots = items.toLocalIterator(), []
        while True:
            lot = [r for _, r in zip(range(items_at_once), held, strict=False)]
            if not lot:
                break
            parts, ids = [], []
            for r in lot:
                data = np.frombuffer(r["text"].encode(), np.uint8)
                for p in parts_of(words(data, np.array([0, len(data)]))[0]):
                    parts.append(p)
                    ids.append(r["item_id"])
            if parts:
                q = np.stack([table[(p >> U(50)).astype(np.int64)].sum(axis=0) for p in parts])
                q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
                bars = BAR * np.sqrt(np.array([len(p) for p in parts]) / PART)
                weights = [idf[(p >> U(50)).astype(np.int64)] for p in parts]
                part_bits = np.concatenate([_bits(p, np.zeros(len(p), np.int64), 1) for p in parts])
                # what a part of n words may lack: a share LIKELY of them must be there
                lacking = np.array([len(p) - int(np.ceil(LIKELY * len(p) - 1e-9)) for p in parts])
                shared = spark.sparkContext.broadcast((_padded(table), parts, weights, np.array(ids), np.ascontiguousarray(q.T), bars.astype(np.float32), part_bits, lacking))
                lots.append(named.mapInArrow(_search(shared), _FOUND))
        for found in lots:
            out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], _FOUND)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "answer", "cosine")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; those without doc_id stay."""
    gone = fresh(docs.columns, "leak_id")
    bad = stored(leaks(docs, benchmark).select(F.col("doc_id").alias(gone)).distinct(), "leaks")
    return docs.join(bad, docs["doc_id"] == F.col(gone), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.round("share", 6).alias("share"), F.round("answer", 6).alias("answer"), F.round("cosine", 3).alias("cosine"))
