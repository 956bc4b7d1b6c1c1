"""Links between documents: extraction, resolution, what waits for its target, and back-fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexa.functions.identity import clause, designations, normalize_designation, normalize_numbering


def extract(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, raw, target_name, target_numbering): the designations a text names, each with the clause named in the stretch before it, after the designation before."""
    each = nodes.select("doc_id", "id", "text", designations(F.col("text")).alias("_all")).select("*", F.posexplode("_all").alias("_k", "target_name"))
    upto = F.expr("substring_index(text, target_name, 1)")
    before = F.when(F.col("_k") > 0, F.expr("substring_index(substring_index(text, target_name, 1), try_element_at(_all, _k), -1)")).otherwise(upto)
    num = clause(F.expr("right(_before, 40)"))
    each = each.withColumn("_before", before)
    return each.select("doc_id", "id", F.concat_ws(" ", num, F.col("target_name")).alias("raw"), "target_name", F.coalesce(num, F.lit("")).alias("target_numbering"))


def local_index(nodes: DataFrame) -> DataFrame:
    """(doc_id, numbering, node_id): a number's first node within a document."""
    n = F.trim("numbering")
    return nodes.where(n != "").groupBy("doc_id", n.alias("numbering")).agg(F.min_by("id", F.struct("order", "id")).alias("node_id"))


def find_node(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each name, and of each (name, numbering), the node of the greatest version; the least id on a tie."""
    def top(df: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.desc("version"), "order", "id")
        return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, F.col("doc_id").alias("hit_doc_id"), F.col("version").alias("hit_version"), F.col("id").alias("hit_node_id"))

    return top(nodes, ["name"]), top(nodes.where(F.coalesce("numbering", F.lit("")) != ""), ["name", "numbering"])


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs (doc_id, id, name, raw, target_name, target_numbering) with scope, target_doc_id, target_version, target_node_id, resolved and pending.

    A link without a name or to its own document is internal: resolved as a whole, or to the first node with its number. Others are matched by normalised designation: to the clause of the greatest version that has it, else to the document; a name nobody has is pending.
    """
    names = nodes.select("name").distinct().groupBy(normalize_designation(F.col("name")).alias("known_norm")).agg(F.max("name").alias("known_name"))
    whole, clauses = find_node(nodes)
    r = refs.withColumns({"norm": normalize_designation(F.col("target_name")), "num": normalize_numbering(F.col("target_numbering"))})
    r = r.withColumn("scope", F.when((F.col("norm") == "") | (F.col("norm") == normalize_designation(F.col("name"))), "internal").otherwise("external"))
    own = local_index(nodes).select(F.col("doc_id").alias("own_doc"), F.col("numbering").alias("own_num"), F.col("node_id").alias("own_node"))
    r = r.join(own, (F.col("scope") == "internal") & (F.col("doc_id") == F.col("own_doc")) & (F.col("num") == F.col("own_num")), "left")
    r = r.join(names, (F.col("scope") == "external") & (F.col("norm") == F.col("known_norm")), "left")
    w = whole.select(F.col("name").alias("w_name"), F.col("hit_doc_id").alias("w_doc"), F.col("hit_version").alias("w_version"))
    c = clauses.select(F.col("name").alias("c_name"), F.col("numbering").alias("c_num"), F.col("hit_doc_id").alias("c_doc"), F.col("hit_version").alias("c_version"), F.col("hit_node_id").alias("c_node"))
    r = r.join(w, F.col("known_name") == F.col("w_name"), "left").join(c, (F.col("known_name") == F.col("c_name")) & (F.col("num") == F.col("c_num")), "left")
    internal = F.col("scope") == "internal"
    return r.select(
        *refs.columns, "scope", F.when(internal, F.col("doc_id")).otherwise(F.coalesce("c_doc", "w_doc")).alias("target_doc_id"), F.when(~internal, F.coalesce("c_version", "w_version")).alias("target_version"), F.when(internal, F.col("own_node")).otherwise(F.col("c_node")).alias("target_node_id"),
        F.when(internal, F.col("own_node").isNotNull() | (F.col("num") == "")).otherwise(F.col("w_doc").isNotNull()).alias("resolved"), (~internal & F.col("known_name").isNull()).alias("pending"))


def pending(resolved: DataFrame) -> DataFrame:
    """What waits: (target_key, source_doc_id, source_node_id, raw, target_numbering, seq). seq is the order in which the links came: the column of that name, or else the order of the rows."""
    seq = F.col("seq") if "seq" in resolved.columns else F.monotonically_increasing_id()
    return resolved.where("pending").select(normalize_designation(F.col("target_name")).alias("target_key"), F.col("doc_id").alias("source_doc_id"), F.col("id").alias("source_node_id"), "raw", normalize_numbering(F.col("target_numbering")).alias("target_numbering"), seq.alias("seq"))


def backfill(nodes: DataFrame, waiting: DataFrame, name: str, doc_id: str, version: str, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with the links to a document that has arrived filled in, what still waits). Of a node's waiting links with the same text the last one counts, with its number or its lack of one; resolved links stay. arrived: (numbering, node_id) of the document."""
    key = normalize_designation(F.lit(name))
    mine, rest = waiting.where(F.col("target_key") == key), waiting.where(F.col("target_key") != key)
    num = arrived.select(F.col("numbering").alias("_n"), F.col("node_id").alias("_node"))
    found = mine.join(num, F.col("target_numbering") == F.col("_n"), "left").groupBy("source_node_id", "raw").agg(F.max_by("_node", "seq").alias("node"))
    table = found.groupBy(F.col("source_node_id").alias("_src")).agg(F.map_from_entries(F.collect_list(F.struct("raw", F.struct("node").alias("to")))).alias("_to"))
    joined = nodes.join(table, F.col("id") == F.col("_src"), "left")

    def fill(ref):
        to = F.try_element_at("_to", ref["raw"])
        return F.when(to.isNotNull() & ~F.coalesce(ref["resolved"], F.lit(False)), ref.withField("target_doc_id", F.lit(doc_id)).withField("target_version", F.lit(version)).withField("target_node_id", F.coalesce(to["node"], ref["target_node_id"])).withField("resolved", F.lit(True))).otherwise(ref)

    return joined.withColumn("references", F.when(F.col("_to").isNotNull(), F.transform("references", fill)).otherwise(F.col("references"))).drop("_src", "_to"), rest
