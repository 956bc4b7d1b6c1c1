"""Line deduplication by a segment-partition edit join.

Lines of `shortest` UTF-8 bytes or more that are not blank take part, across and within documents, and all of `least` bytes or more. Equal lines are one class. Only classes of `least` bytes or more are joined by edits: each one's line is split into `edits` + 1 segments, posted under (length, segment number, segment); each line also probes the segments of lines up to `edits` bytes shorter at the start positions that the multi-match-aware windows allow, since two lines within `edits` edits agree in at least one segment there. Lines that meet are verified by banded bit-parallel edit distance over bytes, many pairs at once (above LONG bytes, by diagonals). Equal lines and lines within `edits` edits, directly or through others, form a group; of its occurrences the one with the least (doc_id, line number) is kept.

Defined cases. Null or empty text: no line, left as it is. Blank lines (spaces, tabs, form feeds, carriage returns) below `least` bytes: left. Null doc_id: can't be named, so its lines neither count nor go. doc_id is an integer. Rows with the same doc_id are one document: their line k is one occurrence, but a row loses only lines of its own text. A document of which nothing but white space is left goes as a whole. An empty table gives an empty result. Texts may have any length; lines are numbered from 0 and end at line feeds only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.llm._base import _BYTE, U, buffers, fresh, grouped, mix, pieces, powers, prepare, stored

LEAST, EDITS = 40, 2
SHORTEST = 1
WANTED_ROWS = 4_000_000


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, start and end of each line."""
    ends = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], ends + 1]), kind="stable")
    # a row's first line starts where the row does; a line feed at a row's last byte starts an empty line there
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, ends, side="right") - 1])
    at = np.concatenate([offsets[:-1], ends + 1])
    o = np.lexsort((at, row))
    row, start = row[o], at[o]
    end = np.concatenate([start[1:] - 1, [0]])
    last = np.concatenate([row[1:] != row[:-1], [True]])
    end[last] = offsets[row[last] + 1]
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    return row, np.arange(len(row)) - first[row], start, end


class _Hashes:
    """Hashes of any substrings of a buffer."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            self.total = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[data] * up[: len(data)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(((self.total[end] - self.total[start]) * self.down[start]) ^ mix((end - start).astype(U)))


def segments(length: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the edits + 1 segments, lines x segments; the last ones are a byte longer where it doesn't come out even."""
    base, over = length // (edits + 1), length % (edits + 1)
    size = base[:, None] + (np.arange(edits + 1) >= (edits + 1 - over)[:, None])
    return np.cumsum(size, axis=1) - size, size


def keys(h: _Hashes, start: np.ndarray, end: np.ndarray, edits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which line, key, kind): kind 1 is posted, 2 probes, 3 does both."""
    length = end - start
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for less in range(edits + 1):
        other = length - less
        at, size = segments(other, edits)
        for i in range(edits + 1):
            lo, hi = max(-i, less - (edits - i)), min(i, less + (edits - i))
            for shift in range(lo, hi + 1):
                s = start + at[:, i] + shift
                e = s + size[:, i]
                ok = np.flatnonzero((s >= start) & (e <= end) & (other >= least))
                key = mix(h.of(s[ok], e[ok]) ^ mix((other[ok] * (edits + 1) + i).astype(U)))
                out.append((ok, key, np.full(len(ok), 3 if less == shift == 0 else 2, np.int8)))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _each(batches: Iterator[pa.RecordBatch], least: int, shortest: int | None = None):
    """Lines of `least` bytes or more, and from `shortest` on those that are not blank."""
    for batch in batches:
        ids, (data, offsets) = batch.column(0).to_numpy(zero_copy_only=False), buffers(batch.column(1))
        for i, j in pieces(offsets, 1 << 21):
            part = data[offsets[i] : offsets[j]]
            row, number, start, end = lines(part, offsets[i : j + 1] - offsets[i])
            texts = batch.column(2).to_numpy()[i + row] if batch.num_columns > 2 else row
            taken = end - start >= least
            if shortest is not None and shortest < least:
                inked = np.concatenate([[0], np.cumsum(~np.isin(part, (9, 12, 13, 32)))])
                taken |= (end - start >= shortest) & (inked[end] > inked[start])
            own = np.flatnonzero(taken)
            if len(own):
                yield part, ids[i + row[own]].astype(np.int64), texts[own], number[own], start[own], end[own], _Hashes(part)


def _occurrences(least: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts, number, start, end, h in _each(batches, least, shortest):
            yield pa.record_batch([pa.array(ids), pa.array(texts), pa.array(number.astype(np.int32)), pa.array(h.of(start, end).view(np.int64))], names=["doc_id", "text_hash", "line_no", "line"])

    return run


def _keys(edits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, _, start, end, h in _each(batches, least):
            line, once = np.unique(h.of(start, end), return_index=True)
            which, key, kind = keys(h, start[once], end[once], edits, least)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(line[which].view(np.int64)), pa.array(kind)], names=["key", "line", "kind"])

    return run


def _texts(least: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, _, _, _, start, end, h in _each(batches, least):
            line, once = np.unique(h.of(start, end).view(np.int64), return_index=True)
            if wanted is not None:
                w = wanted.value
                at = np.minimum(np.searchsorted(w, line), len(w) - 1)
                hit = w[at] == line
                line, once = line[hit], once[hit]
            yield pa.record_batch([pa.array(line), pa.array([data[a:b].tobytes() for a, b in zip(start[once], end[once], strict=True)], pa.binary())], names=["line", "text"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, line) -> pairs of different lines of which one is posted and the other probes."""

    def pairs(key: np.ndarray, line: np.ndarray, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
        def batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["line_a", "line_b"])

        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])]))
        kind = np.bitwise_or.reduceat(kind, at)
        key, line = key[at], line[at]
        bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), [len(key)]])
        size = np.diff(bounds)
        two = bounds[:-1][size == 2]
        ok = (kind[two] & 1 > 0) & (kind[two + 1] & 2 > 0) | (kind[two] & 2 > 0) & (kind[two + 1] & 1 > 0)
        held, many = [(line[two[ok]], line[two[ok] + 1])], 0
        for k in np.flatnonzero(size > 2):
            s = slice(bounds[k], bounds[k + 1])
            post, probe = line[s][kind[s] & 1 > 0], line[s][kind[s] & 2 > 0]
            step = max(1, 1_000_000 // max(1, len(probe)))  # a long list leaves in blocks
            for lo in range(0, len(post), step):
                x, y = np.repeat(post[lo : lo + step], len(probe)), np.tile(probe, len(post[lo : lo + step]))
                held.append((x[x != y], y[x != y]))
                many += len(x)
                if many > 1_000_000:
                    yield batch(*(np.concatenate(z) for z in zip(*held, strict=True)))
                    held, many = [], 0
        if held:
            yield batch(*(np.concatenate(z) for z in zip(*held, strict=True)))

    rest: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(batch.column(k).to_numpy() for k in range(3))
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut or rest and rest[-1][0][0] != now[0][0]:
            yield from pairs(*(np.concatenate(x) for x in zip(*rest, tuple(x[:cut] for x in now), strict=True)))
            rest = []
        rest.append(tuple(x[cut:] for x in now))
    if rest:
        yield from pairs(*(np.concatenate(x) for x in zip(*rest, strict=True)))


LONG = 4096


def diagonal_distance(a: bytes, b: bytes, most: int) -> int:
    """The edit distance of two long strings if it is `most` or less, else most + 1: the furthest row that each number of edits reaches on each diagonal."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n, m = len(x), len(y)
    if abs(n - m) > most:
        return most + 1

    def slide(i: int, j: int) -> int:
        """How far both are equal from i and j on."""
        step, from_ = 256, i
        while i < n and j < m:
            w = min(step, n - i, m - j)
            differ = np.flatnonzero(x[i : i + w] != y[j : j + w])
            if len(differ):
                return i + int(differ[0]) - from_
            i, j, step = i + w, j + w, min(step * 2, 1 << 20)
        return i - from_

    reach = {0: slide(0, 0)}  # by diagonal (row of b less row of a): the row of a
    for e in range(most + 1):
        if reach.get(m - n, -1) >= n:
            return e
        new = {}
        for d in range(-e - 1, e + 2):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i >= max(0, -d):
                new[d] = i + slide(i, i + d)
        reach = new
    return most + 1


def edit_distances(patterns: list[bytes], texts: list[bytes], most: int) -> np.ndarray:
    """Banded bit-parallel edit distances of pairs; exact up to `most`, above it only some number above. Both sides have more than 2 * most bytes, and `most` is below 31."""
    out = np.full(len(patterns), most + 1, np.int64)
    m, n = np.array([len(x) for x in patterns], np.int64), np.array([len(x) for x in texts], np.int64)
    todo = np.flatnonzero(np.abs(m - n) <= most)
    long = todo[n[todo] > LONG]
    for k in long:  # a column a byte would be slow here, and as wide as the longest
        out[k] = diagonal_distance(patterns[k], texts[k], most)
    todo = todo[n[todo] <= LONG]
    todo = todo[np.argsort(n[todo], kind="stable")]
    for lo in range(0, len(todo), 2048):
        own = todo[lo : lo + 2048]
        mo, no = m[own], n[own]
        width = int(max(no.max(), mo.max())) + 2 * most + 2
        p, t = np.zeros((width, len(own)), np.int16), np.full((width, len(own)), -1, np.int16)
        p -= 2
        for k, x in enumerate(own):  # row r of p holds byte r - most
            p[most : most + mo[k], k] = np.frombuffer(patterns[x], np.uint8)
            t[: no[k], k] = np.frombuffer(texts[x], np.uint8)
        vp = np.full(len(own), ((1 << (most + 1)) - 1) << (63 - most), U)
        vn = np.zeros(len(own), U)
        dist = np.full(len(own), most, np.int64)
        turn = mo - most
        for j in range(int(no.max())):
            pm = np.zeros(len(own), U)
            for d in range(2 * most + 1):
                pm |= (p[j + 2 * most - d] == t[j]).astype(U) << U(63 - d)
            with np.errstate(over="ignore"):
                d0 = (((pm & vp) + vp) ^ vp) | pm | vn
            hp, hn = vn | ~(d0 | vp), d0 & vp
            on = j < no
            down = on & (j < turn)
            dist += down & ((d0 >> U(63)) == 0)
            bit = (62 - np.clip(j - turn, 0, 62)).astype(U)
            across = on & (j >= turn)
            dist += np.where(across, ((hp >> bit) & U(1)).astype(np.int64) - ((hn >> bit) & U(1)).astype(np.int64), 0)
            shifted = d0 >> U(1)
            vp, vn = hn | ~(shifted | hp), shifted & hp
        out[own] = dist
    return out


def _verify(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = edit_distances(batch.column(2).to_pylist(), batch.column(3).to_pylist(), edits)
            near = pa.array(d <= edits)
            yield pa.record_batch([batch.column(0).filter(near), batch.column(1).filter(near), pa.array(d[d <= edits].astype(np.int32))], names=["line_a", "line_b", "edits"])

    return run


def near_lines(docs: DataFrame, least: int = LEAST, edits: int = EDITS, wanted_rows: int = WANTED_ROWS) -> DataFrame:
    """(line_a, line_b, edits) of the different lines, by hash, that are within `edits` edits."""
    assert 1 <= edits <= 30 and least > 2 * edits
    spark = docs.sparkSession
    met = docs.mapInArrow(_keys(edits, least), "key long, line long, kind byte").repartition("key").sortWithinPartitions("key", "line").mapInArrow(_meet, "line_a long, line_b long")
    met = stored(met.distinct(), "met")
    sides = stored(met.select(F.explode(F.array("line_a", "line_b")).alias("wanted")).distinct(), "wanted")
    # the few lines that meet another are found again in the texts: by a broadcast list of their hashes if it is short, else by a shuffled semi-join
    if sides.limit(wanted_rows + 1).count() <= wanted_rows:
        wanted = spark.sparkContext.broadcast(np.sort(sides.toArrow().column(0).to_numpy()))
        if not len(wanted.value):
            return spark.createDataFrame([], "line_a long, line_b long, edits int")
        texts = docs.mapInArrow(_texts(least, wanted), "line long, text binary")
    else:
        every = docs.mapInArrow(_texts(least, None), "line long, text binary")
        texts = every.join(sides, every["line"] == sides["wanted"], "left_semi")
    texts = stored(texts.dropDuplicates(["line"]), "line-texts")
    a = texts.select(F.col("line").alias("line_a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("line").alias("line_b"), F.col("text").alias("text_b"))
    both = met.join(a, "line_a").join(b, "line_b").select("line_a", "line_b", "text_a", "text_b")
    return both.mapInArrow(_verify(edits), "line_a long, line_b long, edits int")


def repeated_lines(docs: DataFrame, least: int = LEAST, edits: int = EDITS, wanted_rows: int = WANTED_ROWS, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no) of every line that repeats, exactly or nearly, one that is kept."""
    prepare(docs.sparkSession)
    return _repeated(docs, least, edits, wanted_rows, shortest).select("doc_id", "line_no", "kept_doc_id", "kept_line_no").distinct()


def _repeated(docs: DataFrame, least: int, edits: int, wanted_rows: int = WANTED_ROWS, shortest: int = SHORTEST) -> DataFrame:
    """repeated_lines with text_hash, which names the row of a doc_id that has several."""
    text = F.col("text").cast("string")
    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    hashed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    occ = stored(hashed.mapInArrow(_occurrences(least, shortest), "doc_id long, text_hash long, line_no int, line long"), "lines")
    groups = grouped(near_lines(named, least, edits, wanted_rows).select("line_a", "line_b"), "line_a", "line_b")
    first = occ.groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    classes = first.join(groups, F.col("line") == F.col("node"), "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "line"))
    kept = classes.groupBy("root").agg(F.min("first").alias("kept")).withColumnRenamed("root", "kept_root")
    marks = classes.join(kept, F.col("root") == F.col("kept_root")).select(F.col("line").alias("class"), "kept")
    found = occ.join(marks, F.col("line") == F.col("class")).where(F.struct("doc_id", "line_no") != F.col("kept"))
    return found.select("doc_id", "text_hash", "line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"))


def without_repeats(docs: DataFrame, least: int = LEAST, edits: int = EDITS) -> DataFrame:
    """The documents without their repeated lines; n_chars, where there is one, follows the text."""
    prepare(docs.sparkSession)
    who, row, which = fresh(docs.columns, "gone_doc"), fresh(docs.columns, "gone_text"), fresh(docs.columns, "gone_lines")
    gone = _repeated(docs, least, edits).groupBy(F.col("doc_id").alias(who), F.col("text_hash").alias(row)).agg(F.collect_set("line_no").alias(which))
    joined = docs.join(gone, (docs["doc_id"] == F.col(who)) & (F.xxhash64(docs["text"].cast("string")) == F.col(row)), "left")
    left = F.array_join(F.filter(F.split(F.col("text").cast("string"), "\n"), lambda _, i: ~F.array_contains(F.col(which), i)), "\n")
    out = joined.withColumn("text", F.when(F.col(which).isNull(), F.col("text")).otherwise(left)).where(F.col(which).isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(which).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As its SQL, which has only lines of LEAST bytes or more; `query_all_lengths` has the others too, and so has the pipeline."""
    return repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), shortest=LEAST)


def query_all_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Lines within edits of each other, closed over chains, for DuckDB; its levenshtein counts bytes.
SQL = f"""
WITH RECURSIVE occ AS (
  SELECT doc_id, CAST(k - 1 AS INTEGER) AS line_no, parts[k] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(generate_series(1, len(string_split(text, chr(10))))) AS k FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
  WHERE strlen(parts[k]) >= {LEAST}),
first AS (SELECT line, strlen(line) AS n, min(struct_pack(d := doc_id, l := line_no)) AS f FROM occ GROUP BY line),
near AS (
  SELECT a.f AS fa, b.f AS fb FROM first a JOIN first b ON b.n BETWEEN a.n AND a.n + {EDITS} AND a.line <> b.line
  WHERE levenshtein(a.line, b.line) <= {EDITS}),
sides AS (SELECT fa, fb FROM near UNION SELECT fb, fa FROM near),
reach AS (SELECT f AS spot, f AS root FROM first WHERE f IN (SELECT fa FROM sides) UNION SELECT sides.fb, reach.root FROM reach JOIN sides ON sides.fa = reach.spot),
root AS (SELECT spot, min(root) AS root FROM reach GROUP BY spot)
SELECT DISTINCT occ.doc_id, occ.line_no, coalesce(root.root, first.f).d AS kept_doc_id, coalesce(root.root, first.f).l AS kept_line_no
FROM occ JOIN first USING (line) LEFT JOIN root ON root.spot = first.f
WHERE struct_pack(d := occ.doc_id, l := occ.line_no) <> coalesce(root.root, first.f)
"""

#: The same with every line that is not blank; only those of LEAST bytes or more are joined by edits.
SQL_ALL_LENGTHS = SQL.replace(f"WHERE strlen(parts[k]) >= {LEAST})", f"WHERE strlen(parts[k]) >= {LEAST} OR regexp_matches(parts[k], '[^ \\t\\f\\r]'))").replace("AND a.line <> b.line\n", f"AND a.line <> b.line AND a.n >= {LEAST}\n")
