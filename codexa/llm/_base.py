"""What the training-data operators share: scratch tables, text buffers, word hashes, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
U = np.uint64


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package, and keeps Arrow batches small beside long texts."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def scratch(spark: SparkSession) -> str:
    """The shared folder for written intermediates: spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder; a cluster gets an error, since a machine-local folder would not be shared."""
    if kept := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return kept.rstrip("/")
    if set_by_code := spark.sparkContext.getCheckpointDir():
        return set_by_code.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codexa-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int) -> DataFrame:
    """df, marked for broadcast if it has `most` rows or fewer; beyond that a shuffled join is left to the optimizer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fresh(taken: list[str], name: str) -> str:
    """A column name that none of the taken ones equals, whatever the case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (UTF-8 of a string) and offsets (one more than rows) of a string or binary column; a null counts as empty."""
    column = pc.fill_null(column, pa.scalar("", column.type)) if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int64 if wide else np.int32
    else:
        return buffers(column.cast(pa.string()))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text is alone in its range."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_MUL = 0x9E3779B97F4A7C15
_P = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2 ** 64
_PINV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        with np.errstate(over="ignore"):
            for k, base in enumerate((_P, _PINV)):
                steps = np.full(size, base, U)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BYTE = np.arange(256, dtype=U) + U(1)


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, in UTF-8."""
    out = data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    if len(at):
        high = out[at]
        out[at] = np.where((high >= 0x80) & (high <= 0x9E) & (high != 0x97), high + 0x20, high)
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word, and the words' offsets by row. A word is a run of ASCII letters, digits and non-ASCII bytes, in lower case, within one row."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    low = lowered(data)
    word = (low - np.uint8(97) < 26) | (low - np.uint8(48) < 10) | (low >= 128)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    up, down = powers(n)
    with np.errstate(over="ignore"):
        own = (low.astype(U) + U(1)) * up
        total = np.cumsum(own)
        hashes = mix((total[end] - total[start] + own[start]) * down[start])
    return hashes, start, end + 1, np.searchsorted(start, offsets)


def grouped(df: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph: its edges (a, b), long and without nulls; returns (node, root), root being the component's least node, for every node that has an edge to another.

    Large-star and small-star steps by turns until every node points at a root; each round is written to the shared folder.
    """
    edges = df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = stored(edges, "edges")

    def with_least(e: DataFrame) -> DataFrame:
        m = e.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        return e.join(m, F.col("u") == F.col("w")).select("u", "v", "m")

    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # aggregate and join rather than a window: a node with very many edges is summed up before the shuffle, and the join can be split
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = with_least(large)
        small_star = low.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = stored(small_star, "edges")
        if edges.join(edges.select(F.col("u").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi").isEmpty():
            break
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
