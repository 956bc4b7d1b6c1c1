"""Whole loads and updates in one call each: raw blocks in, the next snapshot of the nodes out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa import schema
from codexa.functions.identity import aliases, lookup_keys, version_id
from codexa.operators import references, structure, versions
from codexa.operators.library import resolved_head
from codexa.providers import Markup
from codexa.session import cut


def load(blocks: DataFrame, documents: DataFrame, now: str, markup: Markup | None = None, embed: Callable[[Column], Column] | None = None, title: str = "document") -> DataFrame:
    """Nodes of new documents. blocks: (doc_id, block_idx, text, category, html); documents: (doc_id, name, version, and any other field of a node that is the document's). Segments, parts, markup, tree, grounding, keys and hashes follow from these; links are read and left open."""
    raw = structure.raw_blocks(blocks)
    parts = structure.parts_of(structure.split_segments(raw))
    nodes = structure.hierarchy(structure.tagged(parts, markup))
    nodes = structure.grounded(nodes, structure.source_spans(raw))
    hints = {"name_override": F.col("name"), "version_override": F.col("version"), "hint_name": F.lit(None).cast("string"), "hint_version": F.lit(None).cast("string")}
    d = resolved_head(documents.withColumns(hints)).drop(*hints, "asks")
    if "external_ids" not in d.columns:
        d = d.withColumn("external_ids", F.lit(None).cast("map<string,string>"))
    d = d.join(versions.content_hashes(raw, order="block_idx"), "doc_id").withColumns({"version_id": version_id(F.col("name"), F.col("content_hash")), "aliases": aliases(F.col("name"), F.col("external_ids")), "lookup_keys": lookup_keys(F.col("name"), F.col("external_ids")), "versions": F.array("version"), "uploaded_at": F.lit(now), "parser_version": F.lit(schema.PARSER_VERSION)})
    out = nodes.join(d, "doc_id").withColumns({"src_block_ids": F.col("src_ids"), "text": F.when(F.col("type") == "document", F.col("name")).otherwise(F.col("text"))})
    found = references.extract(out).groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("raw", "target_name", "target_numbering"))).alias("_refs"))
    link = lambda r: F.struct(r["raw"].alias("raw"), r["target_name"].alias("target_name"), r["target_numbering"].alias("target_numbering"), *[F.lit(None).cast("string").alias(c) for c in ("scope", "target_doc_id", "target_version", "target_node_id")], F.lit(False).alias("resolved"))
    out = out.join(found, F.col("id") == F.col("_id"), "left").withColumn("references", F.transform("_refs", link))
    if embed is not None:
        out = out.withColumn("embedding", embed(F.col("text")))
    return schema.conform(out)


def block_editions(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(name, hashes): the block hashes of the documents' editions, as updates need them."""
    raw = structure.raw_blocks(blocks).join(documents.select("doc_id", "name"), "doc_id")
    return versions.editions(versions.block_hashes(raw), order="block_idx")


def update(nodes: DataFrame, editions: DataFrame, blocks: DataFrame, documents: DataFrame, now: str, markup: Markup | None = None, embed: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, editions, actions) after new editions of stored documents, one a name: what the new edition has unchanged only gets its version, the rest comes in, linked to the stored nodes around it. editions: (name, hashes) of what is stored; a name without one comes in whole. A new edition has one version for all its nodes."""
    new = cut(load(blocks, documents, now, markup, embed))
    fresh = block_editions(blocks, documents)
    stored = nodes.join(new.select("name").distinct(), "name", "left_semi")
    actions = cut(versions.delta(stored, new, editions.join(fresh.select("name"), "name", "left_semi"), fresh))
    tagged = None
    for version in [r["version"] for r in new.select("version").distinct().collect()]:  # the versions of one upload
        own = new.where(F.col("version") == version).select("name").distinct()
        mine = actions.join(own, "name", "left_semi")
        tagged = versions.updated(nodes if tagged is None else tagged, new.where(F.col("version") == version), version, mine)
    after = editions.join(fresh.select("name"), "name", "left_anti").unionByName(fresh)
    return (nodes if tagged is None else tagged), after, actions
