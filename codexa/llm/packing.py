"""Packing documents into sequences by the sum-of-squares rule.

A document of more than `capacity` units is cut into full sequences and a rest. Each piece goes where the sum, over the gaps, of the squared number of open bins with that gap becomes smallest: into an open bin that has room, or a new one. Of equal choices an open bin comes before a new one, the smallest gap first, and among bins of one gap the one that got it first. Full bins are closed. The default unit is the UTF-8 byte (a byte-level model's token); any column of counts may be given instead.

The rule is sequential, so documents are spread by a hash of (doc_id, size, text) over as many shards as `shard_rows` documents each make, and each shard is packed on its own in the order of (doc_id, size); a shard's bins are numbered from shard * 2 ** 32. The result depends on the rows alone, not on their order or partitions.

Defined cases. Null or empty text (or a count that is null, 0 or less): takes no room, no piece. doc_id is an integer. Null doc_id: packed like any, before the others of its shard. Repeated rows are packed each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.llm._base import prepare

CAPACITY, SHARD_ROWS = 8192, 20_000
_PACKED = "doc_id long, piece int, start long, size int, bin long, bin_start int"


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and start within it of each piece, in order; sizes are from 1 to capacity."""
    many = np.zeros(capacity + 1, np.int64)  # open bins by gap; gap 0 is closed and stays 0
    bins: dict[int, deque[int]] = {}
    which, start = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    opened = 0
    for k, s in enumerate(sizes.tolist()):
        gap, least = 0, 2 * int(many[capacity - s]) + 1 if s < capacity else 0
        held = many[s:capacity]
        at = np.flatnonzero(held)
        if len(at):
            change = 2 - 2 * held[at] + 2 * many[at]
            if at[0] == 0:
                change[0] -= 1
            i = int(change.argmin())
            if change[i] <= least:
                gap = s + int(at[i])
        if gap:
            own = bins[gap].popleft()
            many[gap] -= 1
        else:
            own, gap = opened, capacity
            opened += 1
        which[k], start[k] = own, capacity - gap
        if left := gap - s:
            bins.setdefault(left, deque()).append(own)
            many[left] += 1
    return which, start


def _shard(capacity: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("size", "ascending")])
        # nulls sort last in Arrow; they are put first, as the docstring says
        null = table.column("doc_id").is_null()
        table = pa.concat_tables([table.filter(null), table.filter(pa.compute.invert(null))])
        size = table.column("size").to_numpy()
        pieces = -(-size // capacity)
        row = np.repeat(np.arange(len(size)), pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(size[row] - number * capacity, capacity)
        which, start = place(length, capacity)
        return pa.table({"doc_id": table.column("doc_id").take(pa.array(row)), "piece": pa.array(number, pa.int32()), "start": pa.array(number * capacity, pa.int64()), "size": pa.array(length, pa.int32()), "bin": pa.array((shard << 32) + which, pa.int64()), "bin_start": pa.array(start, pa.int32())})

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, size: str | None = None) -> DataFrame:
    """(doc_id, piece, start, size, bin, bin_start): units start to start + size of the document lie in the bin from bin_start on. size: a column of counts to use instead of the text's bytes."""
    prepare(docs.sparkSession)
    shards = max(1, -(-docs.count() // shard_rows))
    units = F.octet_length(F.col("text").cast("string")) if size is None else F.col(size)
    salt = F.xxhash64(F.col("text").cast("string")) if size is None else F.lit(0)  # so that rows without doc_id don't all meet
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), units.cast("long").alias("size"), F.pmod(F.xxhash64("doc_id", units.cast("long"), salt), F.lit(shards)).alias("shard")).where("size > 0")
    return sized.groupBy("shard").applyInArrow(_shard(capacity), _PACKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
