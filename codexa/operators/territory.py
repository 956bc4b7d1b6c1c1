"""The territory tree: paths, descendants, names, and the administrative scope of documents."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexa.functions.identity import level_of, normalize_territory
from codexa.operators.scopes import chains

LEAST_SCORE, LEAST_MARGIN, DEEPEST = 0.72, 0.08, 12


def paths(territories: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(territory_id, path): ids from the root down. `deepest` steps at most, and none to a territory met before, so a cycle ends."""
    up = chains(territories.select(F.col("territory_id").alias("id"), F.col("parent_id")), deepest)
    return up.select(F.col("id").alias("territory_id"), F.reverse("chain").alias("path"))


def closure(paths_: DataFrame) -> DataFrame:
    """(territory_id, ancestor_id, distance), itself at 0."""
    return paths_.select("territory_id", F.posexplode(F.reverse("path")).alias("distance", "ancestor_id"))


def descendants(closure_: DataFrame, root: int, all_levels: bool = True) -> DataFrame:
    found = closure_.where((F.col("ancestor_id") == root) & (F.col("distance") > 0))
    return (found if all_levels else found.where("distance = 1")).select("territory_id")


def find_by_name(territories: DataFrame, closure_: DataFrame, query: str, root: int, limit: int = 0) -> DataFrame:
    """Territories below root whose name holds the query, whatever the case; a blank one finds none. limit 0: all."""
    if not query.strip():
        return territories.limit(0)
    below = descendants(closure_, root)
    found = territories.where(F.contains(F.lower("name"), F.lit(query.strip().lower()))).join(below, "territory_id", "left_semi").orderBy("territory_id")
    return found.limit(limit) if limit else found


def ancestors_of(closure_: DataFrame, ids: list[int]) -> list[int]:
    """The ids a scope filter takes in above the requested ones, themselves too; an unknown id stays as it is."""
    known = [r["ancestor_id"] for r in closure_.where(F.col("territory_id").isin(ids)).select("ancestor_id").distinct().collect()]
    return sorted({*known, *ids})


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def similarity(query: Column, candidate: Column) -> Column:
    """How alike two names are, 0 to 1: equal, one inside the other, all words of the query in the candidate, else the better of matching blocks and shared words."""
    a, b = normalize_territory(query), normalize_territory(candidate)
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    share = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.contains(b, a) | F.contains(a, b), 0.95).when(F.size(F.array_except(x, y)) == 0, 0.9).otherwise(F.greatest(_ratio(a, b), share))


def best_match(queries: DataFrame, candidates: DataFrame, least: float = LEAST_SCORE, margin: float = LEAST_MARGIN) -> DataFrame:
    """queries (query_id, query) x candidates (territory_id, name): (query_id, query, territory_id, score); territory_id is null unless the best is good enough and clear of the next."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "territory_id")
    # each distinct query once, against the whole list of candidates: a table of regions, hence small
    scored = queries.select("query").distinct().crossJoin(candidates.select("territory_id", "name")).withColumn("score", similarity(F.col("query"), F.col("name")))
    top = scored.withColumns({"_r": F.row_number().over(w), "_next": F.lead("score").over(w)}).where("_r = 1")
    sure = (F.col("score") >= least) & (F.col("_next").isNull() | (F.col("score") - F.col("_next") >= margin))
    return queries.join(top.select(F.col("query").alias("_q"), F.when(sure, F.col("territory_id")).alias("territory_id"), "score"), F.col("query") == F.col("_q"), "left").drop("_q").withColumn("score", F.coalesce("score", F.lit(0.0)))


def scope_columns(territories: DataFrame, paths_: DataFrame, source: str = "auto") -> DataFrame:
    """Each territory's slice of a node."""
    return territories.join(paths_, "territory_id").select("territory_id", level_of(F.col("level")).alias("document_level"), F.col("name").alias("territory_name"), F.col("type_id").alias("territory_type_id"), F.col("type_name").alias("territory_type_name"), F.col("path").alias("territory_path"), F.lit(source).alias("level_source"), F.lit(source).alias("territory_source"))


REASONS = {"level": "the document's level is not known", "name": "no territory is named", "region": "the region is not recognised", "none": "no such territory", "tie": "the territory's name is ambiguous"}


def scope_of_heads(heads: DataFrame, territories: DataFrame, root: int) -> DataFrame:
    """heads (doc_id, level_hint, territory_hint, region_hint) -> (doc_id, territory_id, territory_confidence, tagging_status, tagging_error).

    Federal documents belong to the root; regional ones to the best match among the regions; municipal ones to the best among the names that hold the hint at level 3 or below, narrowed to the hinted region where that leaves any. What is not clear stays pending, with the reason.
    """
    links = closure(paths(territories))
    h = heads.select("doc_id", F.lower(F.coalesce("level_hint", F.lit("unknown"))).alias("level"), F.coalesce("territory_hint", F.lit("")).alias("hint"), F.coalesce("region_hint", F.lit("")).alias("region"))
    regions = territories.where(F.col("parent_id") == root)
    by_region = best_match(h.where("level = 'regional' and hint <> ''").select(F.col("doc_id").alias("query_id"), F.col("hint").alias("query")), regions).select(F.col("query_id").alias("doc_id"), "territory_id", "score", F.lit("region").alias("why"))
    towns = territories.where("level >= 3").select(F.col("territory_id").alias("town"), F.col("name").alias("town_name"))
    m = h.where("level = 'municipal' and hint <> ''")
    hints = m.select("hint").distinct().join(towns, F.contains(F.lower("town_name"), F.lower("hint"))).withColumn("score", similarity(F.col("hint"), F.col("town_name")))
    near = m.join(hints.select(F.col("hint").alias("_h"), "town", "town_name", "score"), F.col("hint") == F.col("_h")).drop("_h")
    hinted = best_match(m.where("region <> ''").select(F.col("doc_id").alias("query_id"), F.col("region").alias("query")), regions).select(F.col("query_id").alias("rd"), F.col("territory_id").alias("rid")).distinct()
    inside = links.select(F.col("territory_id").alias("it"), F.col("ancestor_id").alias("ia"))
    near = near.join(hinted, F.col("doc_id") == F.col("rd"), "left").join(inside, (F.col("town") == F.col("it")) & (F.col("rid") == F.col("ia")), "left")
    w = Window.partitionBy("doc_id")
    near = near.withColumn("_any", F.max(F.col("it").isNotNull()).over(w)).where("not _any or it is not null")
    r = Window.partitionBy("doc_id").orderBy(F.desc("score"), "town")
    top = near.withColumns({"_r": F.row_number().over(r), "_next": F.lead("score").over(r)}).where("_r = 1")
    sure = (F.col("score") >= LEAST_SCORE) & (F.col("_next").isNull() | (F.col("score") - F.col("_next") >= LEAST_MARGIN))
    by_town = m.select("doc_id").join(top.select("doc_id", F.when(sure, F.col("town")).alias("territory_id"), "score"), "doc_id", "left").select("doc_id", "territory_id", "score", F.when(F.col("score").isNull(), "none").otherwise("tie").alias("why"))
    rest = h.where("level not in ('regional', 'municipal') or hint = ''").select("doc_id", F.when(F.col("level") == "federal", root).cast("int").alias("territory_id"), F.when(F.col("level") == "federal", 1.0).alias("score"), F.when(F.col("level").isin("regional", "municipal"), "name").otherwise("level").alias("why"))
    reasons = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    ok = F.col("territory_id").isNotNull()
    return by_region.unionByName(by_town).unionByName(rest).select("doc_id", "territory_id", F.when(ok, F.round("score", 3)).alias("territory_confidence"), F.when(ok, "ok").otherwise("pending").alias("tagging_status"), F.when(~ok, reasons[F.col("why")]).alias("tagging_error"))


def sweep(nodes: DataFrame, heads: DataFrame, territories: DataFrame, root: int, now_attempts: int = 1, limit: int | None = None, dry_run: bool = False, attempts: int = 5) -> tuple[DataFrame, DataFrame]:
    """(nodes after another attempt at the open scopes, the outcome of each document tried). What is found is filled in, what is not counts one more attempt; run again, it changes nothing that was found. Only documents still pending that were not tried too often are tried, the `limit` first by doc_id if one is given; a dry run leaves the nodes as they are."""
    open_docs = nodes.where((F.col("tagging_status") == "pending") & (F.coalesce("tagging_attempts", F.lit(0)) < attempts)).select("doc_id").distinct()
    if limit is not None:
        open_docs = open_docs.orderBy("doc_id").limit(limit)
    found = scope_of_heads(heads.join(open_docs, "doc_id", "left_semi"), territories, root)
    if dry_run:
        return nodes, found
    scope = scope_columns(territories, paths(territories)).withColumnRenamed("territory_id", "_t")
    f = found.join(scope, F.col("territory_id") == F.col("_t"), "left").select(F.col("doc_id").alias("_d"), *[F.col(c).alias(f"_{c}") for c in ("territory_id", "territory_confidence", "tagging_status", "tagging_error", "document_level", "territory_name", "territory_type_id", "territory_type_name", "territory_path", "level_source", "territory_source")])
    j = nodes.join(f, F.col("doc_id") == F.col("_d"), "left")
    open_ = (F.col("tagging_status") == "pending") & F.col("_d").isNotNull()
    done = open_ & (F.col("_tagging_status") == "ok")
    changed = {c[1:]: F.when(done, F.col(c)).otherwise(F.col(c[1:])) for c in f.columns if c not in ("_d", "_tagging_error")}
    changed["tagging_error"] = F.when(open_, F.col("_tagging_error")).otherwise(F.col("tagging_error"))
    changed["tagging_attempts"] = F.when(open_ & ~done, F.col("tagging_attempts") + now_attempts).otherwise(F.col("tagging_attempts"))
    return j.select(*[changed.get(c, F.col(c)).alias(c) for c in nodes.columns]), found
