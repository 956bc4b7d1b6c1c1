"""Searches by many queries."""

from pyspark.sql import functions as F

from codexa.operators import search
from tests.oracle import DATA


def test_every_row_searches_and_lsh_recalls(spark):
    v = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").withColumn("id", F.col("vec_id"))
    exact = {}
    for r in search.topk_each(v, v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))).collect():
        exact.setdefault(r["query_id"], set()).add(r["id"])
    assert len(exact) == v.count() and all(len(x) == 10 for x in exact.values())
    asked = v.where("vec_id % 100 = 7").collect()
    found = [len(exact[r["vec_id"]] & {x["id"] for x in search.topk_lsh(v, list(r["embedding"])).collect()}) for r in asked]
    assert sum(found) >= 0.9 * 10 * len(asked), found


def test_best_of_many_queries_holds_few_scores():
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    q, x = r.integers(-2, 3, (2000, 4)).astype(float), r.integers(-2, 3, (4000, 4)).astype(float)  # with ties
    q = q[(q != 0).any(axis=1)]
    q /= np.sqrt((q * q).sum(axis=1, keepdims=True))
    batches = [pa.record_batch([pa.array(np.arange(lo, lo + 2000)[::-1]), pa.array(list(x[lo : lo + 2000][::-1]), pa.list_(pa.float64()))], names=["id", "embedding"]) for lo in (0, 2000)]
    tracemalloc.start()
    found = list(search._best(SimpleNamespace(value=(pa.array(np.arange(len(q))), q)), 3)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6, peak
    got: dict[int, list] = {}
    for b in found:
        for k, i in zip(*b.columns[:2], strict=True):
            got.setdefault(k.as_py(), []).append(i.as_py())
    norm = np.sqrt((x * x).sum(axis=1))
    some = np.flatnonzero(norm > 0)
    for k in range(0, len(q), 50):
        score = np.round((x[some] / norm[some, None]) @ q[k], 12)
        assert got[k] == some[np.lexsort((some, -score))][:3].tolist()
