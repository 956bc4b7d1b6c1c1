"""Filtered vector search: payload predicates, exact cosine top-k, context along the reading order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.schema import default_of
from codexa.session import ready

LIMIT, HEIGHT = 10, 6


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(True)


def has_version(version: str) -> Column:
    return F.array_contains("versions", version) | (F.col("version") == version)


def shared_only() -> Column:
    return F.coalesce(F.col("user_id"), F.lit("")) == ""


def of_user(user_id: str, project_ids: Sequence[str]) -> Column:
    return (F.col("user_id") == user_id) & F.col("project_id").isin(list(project_ids))


def in_territories(ids: Sequence[int], ancestors: Sequence[int] = ()) -> Column:
    """In force in one of the territories: below or at one, or set for one of the ancestors."""
    within = F.arrays_overlap("territory_path", F.array(*[F.lit(int(x)) for x in ids]))
    return within | F.col("territory_id").isin([int(x) for x in ancestors]) if ancestors else within


def predicate(
    *, kind: str | None = None, name: str | None = None, document_names: Sequence[str] = (), version: str | None = None, block: str | None = None, types: Sequence[str] = (), tags: Sequence[str] = (),
    doc_id: str | None = None, parent_id: str | None = None, doc_type: str | None = None, corpus: str | None = None, lang: str | None = None, document_level: str | None = None, territory_ids: Sequence[int] = (),
    ancestors: Sequence[int] = (), tagging_status: str | None = None, user_id: str | None = None, project_ids: Sequence[str] = (), include_shared: bool = True,
) -> Column:
    """Everything given must hold. Without a user only the shared corpus is seen; with one, the user's projects, and the shared corpus too unless it is left out."""
    if user_id is not None and not project_ids:
        raise ValueError("a user's documents are searched by project")
    equal = {"kind": kind, "name": name, "block": block, "doc_id": doc_id, "parent_id": parent_id, "doc_type": doc_type, "corpus": corpus, "lang": lang, "document_level": document_level, "tagging_status": tagging_status}
    must = [F.col(k) == v for k, v in equal.items() if v is not None]
    if document_names:
        must.append(F.col("name").isin(list(document_names)))
    if version is not None:
        must.append(has_version(version))
    if types:
        must.append(F.col("type").isin(list(types)))
    if tags:
        must.append(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if territory_ids:
        must.append(in_territories(territory_ids, ancestors))
    scope = shared_only() if user_id is None else any_of([of_user(user_id, project_ids), *([shared_only()] if include_shared else [])])
    return all_of([*must, scope])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(c: Column, query: Sequence[float]) -> Column:
    """Null where either vector is 0."""
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    q = F.array(*[F.lit(float(x)) for x in query])
    return dot(c, q) / F.nullif(F.sqrt(dot(c, c)) * norm, F.lit(0.0))


def topk(nodes: DataFrame, query: Sequence[float], limit: int | None = None, where: Column | None = None) -> DataFrame:
    """The nodes nearest to the query by cosine, exactly: score first, then id. The filter is applied before; only `limit` rows (10 if 0 or None) of each partition are ever sorted. Nodes without a vector, or with one of another length, are left out."""
    found = nodes.where(where) if where is not None else nodes
    scored = found.where(F.size("embedding") == len(query)).withColumn("score", cosine(F.col("embedding"), query)).where("score is not null")
    return scored.orderBy(F.desc("score"), "id").limit(limit or LIMIT)


#: Queries that are broadcast at a time; scores, and nodes that may be among the best, that a worker holds at a time.
BLOCK, SCORES = 2048, 1 << 18


def _best(shared, limit: int):
    """(id, embedding) -> (query_id, id, score): each query's best of a partition. A worker holds SCORES scores at a time, of which only those not below a query's last best are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, score, id of the best so far, and of those that came since
        floor, since, kind = np.full(len(q), -np.inf), 0, None
        rows = max(1, SCORES // len(q))

        def merge() -> None:
            new = tuple(np.concatenate(z) for z in zip(*held, strict=True))
            order = np.lexsort((new[2], -new[1], new[0]))
            query = new[0][order]
            place = np.arange(len(order)) - np.searchsorted(query, query)
            last = order[place == limit - 1]
            floor[new[0][last]] = new[1][last]
            order = order[place < limit]
            held[:] = [tuple(z[order] for z in new)]

        for batch in batches:
            kind = batch.schema.field(0).type
            fits = np.flatnonzero(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == q.shape[1])
            for lo in range(0, len(fits), rows):
                part = batch.take(pa.array(fits[lo : lo + rows]))
                x = part.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
                own = part.column(0).to_numpy(zero_copy_only=False)
                own = own.astype(str) if own.dtype == object else own
                norm = np.sqrt((x * x).sum(axis=1))
                some = np.flatnonzero((norm > 0) & np.isfinite(norm))
                score = np.round((x[some] / norm[some, None]) @ q.T, 12)  # nodes x queries
                node, query = np.nonzero(~(score < floor))
                held.append((query, score[node, query], own[some[node]]))
                since += len(node)
                if since >= SCORES:
                    merge()
                    since = 0
        if held:
            merge()
            query, score, own = held[0]
            for lo in range(0, len(query), SCORES):
                at = slice(lo, lo + SCORES)
                yield pa.record_batch([ids.take(pa.array(query[at])), pa.array(own[at], kind), pa.array(score[at])], names=["query_id", "id", "score"])

    return run


def topk_each(nodes: DataFrame, queries: DataFrame, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """For every row (query_id, query) of queries the nodes nearest to its vector by cosine, exactly, as (query_id, id, score): score first, then id. Vectors of another length, or 0, are left out.

    The queries are a stated set: they are read a block of BLOCK at a time, each block is broadcast, and every partition keeps its `limit` best of each query, so that no more than that is shuffled.
    """
    spark, most = ready(nodes.sparkSession), limit or LIMIT
    n = (nodes.where(where) if where is not None else nodes).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {n.schema['id'].dataType.simpleString()}, score double"
    found = spark.createDataFrame([], schema)
    rows = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).where("query is not null").toLocalIterator()
    while block := list(islice(rows, BLOCK)):
        for size in sorted({len(r["query"]) for r in block}):
            own = [r for r in block if len(r["query"]) == size and any(r["query"])]
            if own:
                q = np.array([r["query"] for r in own])
                q /= np.sqrt((q * q).sum(axis=1, keepdims=True))
                found = found.unionAll(n.mapInArrow(_best(spark.sparkContext.broadcast((pa.array([r["query_id"] for r in own]), q)), most), schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def points(nodes: DataFrame, ids: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """The nodes of (id), with their vectors. Vectors by name are not supported."""
    if names:
        raise ValueError("nodes have one vector without a name")
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def search(nodes: DataFrame, queries: DataFrame, embed: Callable[[Column], Column] | None = None, limit: int | None = None, height: int = 0, where: Column | None = None) -> DataFrame:
    """The whole of a search: queries (query_id, text) are embedded, or bring their vectors (query_id, query); the filter comes first, then each query's nearest nodes, with the context along the reading order if a height is given; as hits, score first."""
    asked = queries.select("query_id", embed(F.col("text")).alias("query")) if embed is not None else queries
    best = topk_each(nodes, asked, limit, where).select("query_id", F.col("id").alias("_id"), "score")
    found = nodes.join(best, F.col("id") == F.col("_id")).drop("_id")
    if height:
        found = context(nodes, found, height)
    return hits(found, ("query_id",)).orderBy("query_id", F.desc("score"), "id")


def topk_lsh(nodes: DataFrame, query: Sequence[float], limit: int | None = None, bucket: float = 0.5, tables: int = 8) -> DataFrame:
    """Approximate nearest nodes by random projections of the normalised vectors; scores are exact."""
    q = [float(x) / sum(float(y) ** 2 for y in query) ** 0.5 for x in query]
    unit = nodes.withColumn("_n", F.sqrt(dot(F.col("embedding"), F.col("embedding")))).where("_n > 0").withColumn("_v", array_to_vector(F.expr("transform(embedding, x -> cast(x as double) / _n)")))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket, numHashTables=tables, seed=11).fit(unit)
    from pyspark.ml.linalg import Vectors

    near = model.approxNearestNeighbors(unit, Vectors.dense(q), 4 * (limit or LIMIT), distCol="_d").drop("_v", "_h", "_n", "_d")
    return topk(near, query, limit)


def context(nodes: DataFrame, hits: DataFrame, height: int, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """hits with context: the texts of up to `height` (6 at most) nodes before and after, in reading order, joined by spaces.

    The chain is walked by joins on prev_id and next_id, so a broken link ends it; after an update the order of a document and its chain may differ.
    """
    h = max(0, min(HEIGHT, height))
    out = hits.withColumns({"_p": F.col("prev_id"), "_n": F.col("next_id"), "_before": F.array().cast("array<string>"), "_after": F.array().cast("array<string>")})
    # the chain stays within a document, so only the hits' documents are walked
    own = nodes.join(hits.select(*by).distinct(), list(by), "left_semi")
    links = own.select(F.col("id").alias("_id"), F.col("text").alias("_text"), F.col("prev_id").alias("_pp"), F.col("next_id").alias("_nn"))
    # a step also takes in where it comes from, so a chain that loops back ends after `height` steps
    for _ in range(h):
        out = out.join(links, F.col("_p") == F.col("_id"), "left").withColumns({"_before": F.when(F.col("_id").isNotNull(), F.concat(F.array("_text"), F.col("_before"))).otherwise(F.col("_before")), "_p": F.col("_pp")}).drop(*links.columns)
        out = out.join(links, F.col("_n") == F.col("_id"), "left").withColumns({"_after": F.when(F.col("_id").isNotNull(), F.concat(F.col("_after"), F.array("_text"))).otherwise(F.col("_after")), "_n": F.col("_nn")}).drop(*links.columns)
    text = F.filter(F.concat("_before", F.array("text"), "_after"), lambda x: F.coalesce(x, F.lit("")) != "")
    return out.withColumn("context", F.array_join(text, " ")).drop("_p", "_n", "_before", "_after")


def window_context(nodes: DataFrame, height: int, by: Sequence[str] = ("doc_id",), order: str = "order") -> DataFrame:
    """Every node's context where reading order is the stored order: one window, no join."""
    from pyspark.sql import Window

    h = max(0, min(HEIGHT, height))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-h, h)
    return nodes.withColumn("context", F.array_join(F.filter(F.collect_list("text").over(w), lambda x: x != ""), " "))


def hits(found: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """A search result's columns, after those of `more`, with defaults for what a node lacks."""
    kept = ("id", "score", "context", "doc_id", "name", "version", "kind", "type", "numbering", "block", "breadcrumb", "tags", "parent_id", "prev_id", "next_id", "document_level", "territory_id", "territory_name", "territory_path", "table_html", "metadata", "references", "text")
    return found.select(*more, *[F.coalesce(F.col(c), default_of(c)).alias(c) if c not in ("score", "context") else F.col(c) for c in kept if c in found.columns])
