"""Listing, assembling and reading documents; tags, scopes, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.functions.identity import stripped, version_of_name
from codexa.operators.search import has_version


def version_tags() -> Column:
    """Every version a node belongs to."""
    return F.when(F.size(F.coalesce("versions", F.array())) > 0, F.col("versions")).when(F.col("version").isNotNull(), F.array("version")).otherwise(F.array().cast("array<string>"))


def flat_tags(c: str = "tags") -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))


def list_documents(nodes: DataFrame, version: str | None = None, uploaded_from: str | None = None, uploaded_to: str | None = None) -> DataFrame:
    """One row for each (name, version): node_count, blocks, tags, uploaded_at, source_object_key (a node of that very version first), doc_id and other_versions of the first node. A range of uploaded_at is inclusive, compares as text, and drops documents without it."""
    each = nodes.withColumn("v", F.explode(version_tags()))
    if version is not None:
        each = each.where(F.col("v") == version)
    first = F.struct("order", "id")
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    ordered = lambda c, cond=None: F.min_by(filled(c), F.when(filled(c).isNotNull() & (F.lit(True) if cond is None else cond), first))
    out = each.groupBy("name", F.col("v").alias("version_")).agg(
        F.count("*").alias("node_count"), F.array_sort(F.collect_set("block")).alias("blocks"), flat_tags().alias("tags"), ordered("uploaded_at").alias("uploaded_at"),
        F.coalesce(ordered("source_object_key", F.col("version") == F.col("v")), ordered("source_object_key")).alias("source_object_key"), F.min_by("doc_id", first).alias("doc_id"), F.min_by("other_versions", first).alias("other_versions"),
    ).withColumnRenamed("version_", "version")
    if uploaded_from is not None:
        out = out.where(F.col("uploaded_at") >= uploaded_from)
    if uploaded_to is not None:
        out = out.where(F.col("uploaded_at") <= uploaded_to)
    return out.orderBy("name", "version")


def library(nodes: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """One row for each doc_id: the number of nodes and the first one's name, version and scope. Where the registry (doc_id and any of these) has a document, its record counts."""
    first, fields = F.struct("order", "id"), ("name", "version", "document_level", "territory_id")
    out = nodes.groupBy("doc_id").agg(F.count("*").alias("node_count"), *[F.min_by(c, first).alias(c) for c in fields], flat_tags().alias("tags"))
    if registry is not None:
        known = [c for c in fields if c in registry.columns]
        r = registry.select(F.col("doc_id").alias("_d"), F.lit(True).alias("_has"), *[F.col(c).alias(f"_{c}") for c in known])
        out = out.join(r, F.col("doc_id") == F.col("_d"), "left").select(*[F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in known else F.col(c) for c in out.columns])
    return out.orderBy("name", "version")


def lookup(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, doc_id): the documents that have each lookup key of the table (key)."""
    return nodes.select("doc_id", F.explode("lookup_keys").alias("key")).join(keys.select("key").distinct(), "key", "left_semi").distinct()


def prefixed(entries: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """The entries whose key starts with the prefix."""
    return entries.where(F.col(key).startswith(prefix))


def grid(documents: DataFrame, query: str = "", tag: str | None = None, level: str | None = None, territory: int | None = None, pending: bool = False) -> DataFrame:
    """The listing narrowed as one types: the query anywhere in name, version, tags or territory, whatever the case; a tag, a level, a territory anywhere above, open scopes only."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("version", F.lit("")), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "), F.coalesce("territory_name", F.lit(""))))
    out = documents.where(F.contains(hay, F.lit(query.strip().lower()))) if query.strip() else documents
    if tag:
        out = out.where(F.array_contains("tags", tag))
    if level:
        out = out.where(F.col("document_level") == level)
    if territory is not None:
        out = out.where(F.array_contains("territory_path", territory))
    return out.where(F.col("tagging_status") == "pending") if pending else out


def recent(documents: DataFrame, limit: int = 5) -> DataFrame:
    """The documents that came last."""
    return documents.orderBy(F.desc(F.coalesce("uploaded_at", F.lit(""))), "doc_id").limit(limit)


def resolved_head(documents: DataFrame) -> DataFrame:
    """documents (name_override, version_override, and the head pass's hint_name, hint_version) with name, version and asks: what was given wins, then the name's last group of four digits, then the hint; without any the version is `unknown`. asks: whether the head pass is needed for name or version at all."""
    given = lambda c: F.nullif(stripped(F.col(c)), F.lit(""))
    own, version = given("name_override"), F.coalesce(given("version_override"), version_of_name(given("name_override")))
    name = F.coalesce(own, given("hint_name"), F.lit(""))
    return documents.withColumns({"name": name, "version": F.coalesce(version, version_of_name(name), given("hint_version"), F.lit("unknown")), "asks": own.isNull() | version.isNull()})


def assembled(nodes: DataFrame) -> DataFrame:
    """Each document's text: its non-empty texts in order, one a line."""
    parts = F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("order", "id", "text"))))
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("node_count"))


def relatives(nodes: DataFrame) -> DataFrame:
    """Every node with the texts of its parent, neighbours and children (by order); ids that lead nowhere give null or nothing."""
    def side(alias: str) -> DataFrame:
        return nodes.select(F.col("id").alias(f"{alias}_key"), F.col("text").alias(f"{alias}_text"))

    kids = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("kids_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "id", "text"))), lambda x: x["text"]), "\n").alias("children_text"), F.count("*").alias("children"))
    out = nodes
    for a in ("parent", "prev", "next"):
        out = out.join(side(a), F.col(f"{a}_id") == F.col(f"{a}_key"), "left").drop(f"{a}_key")
    return out.join(kids, F.col("id") == F.col("kids_key"), "left").drop("kids_key").withColumn("children", F.coalesce("children", F.lit(0)))


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    """One node with its relatives: the id is pushed to the scan, and the relatives are looked up by the few ids it names."""
    one = nodes.where(F.col("id") == node_id)
    wanted = one.select(F.explode(F.array_compact(F.concat(F.array("parent_id", "prev_id", "next_id"), F.coalesce("child_ids", F.array())))).alias("wanted")).distinct()
    return one, nodes.join(wanted, F.col("id") == F.col("wanted"), "left_semi").orderBy("order", "id")


def numbered_links(nodes: DataFrame, order: str = "order") -> DataFrame:
    """prev_id and next_id by reading order within each document."""
    w = Window.partitionBy("doc_id").orderBy(order, "id")
    return nodes.withColumns({"prev_id": F.lag("id").over(w), "next_id": F.lead("id").over(w), "order": F.row_number().over(w) - 1})


def tags(nodes: DataFrame, shared: Column) -> DataFrame:
    return nodes.where(shared).select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def scopes(nodes: DataFrame, shared: Column) -> DataFrame:
    """For each territory its level and number of documents."""
    return nodes.where(shared & F.col("territory_id").isNotNull()).groupBy("territory_id").agg(F.min("territory_name").alias("territory_name"), F.min("document_level").alias("document_level"), F.count_distinct("doc_id").alias("documents")).orderBy(F.coalesce("document_level", F.lit("")), F.coalesce("territory_name", F.lit("")))


def scopes_summary(nodes: DataFrame, shared: Column) -> DataFrame:
    """One row: the levels in use, sorted, and the number of documents whose scope is open."""
    level = F.nullif(F.coalesce("document_level", F.lit("")), F.lit(""))
    return nodes.where(shared).agg(F.array_sort(F.collect_set(level)).alias("levels"), F.count_distinct(F.when(F.col("tagging_status") == "pending", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("pending_documents"))


def pending_heads(nodes: DataFrame, texts: int = 14, attempts: int = 5) -> DataFrame:
    """Documents whose scope is still open: their first texts by order; those tried too often are left out."""
    w = Window.partitionBy("doc_id").orderBy("order", "id")
    head = nodes.where((F.col("tagging_status") == "pending") & (F.coalesce("tagging_attempts", F.lit(0)) < attempts)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= texts)
    return head.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "text"))), lambda x: x["text"]), "\n").alias("head"), F.count("*").alias("texts"))


def source_point(nodes: DataFrame, version: str | None = None) -> DataFrame:
    """For each name the stored file of the greatest version, of those that hold `version` if one is given."""
    found = nodes.where(F.col("source_object_key").isNotNull())
    found = found.where(has_version(version)) if version is not None else found
    return found.groupBy("name").agg(F.max_by(F.struct("version", "source_object_key"), F.struct("version", "id")).alias("s")).select("name", "s.*")


def latest(df: DataFrame, key: str, version: str = "version", natural: bool = False) -> DataFrame:
    """The rows of the greatest version of each key, compared as text or, if natural, number by number."""
    rank = F.transform(F.regexp_extract_all(version, F.lit("[0-9]+|[^0-9]+"), 0), lambda x: F.when(x.rlike("^[0-9]+$"), F.lpad(x, 20, "0")).otherwise(x)) if natural else F.col(version)
    return df.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.desc(rank)))).where("_r = 1").drop("_r")


def jobs_active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("queued", "processing")).orderBy(F.desc("created_at"), F.desc("job_id"))


def jobs_recent(jobs: DataFrame, limit: int = 20) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(max(1, limit))


def abort_orphans(jobs: DataFrame) -> DataFrame:
    """jobs after a restart: what was queued or processing has failed, since nothing goes on with it."""
    lost = F.col("status").isin("queued", "processing")
    return jobs.withColumns({"error": F.when(lost, "interrupted by a restart: upload the document again").otherwise(F.col("error") if "error" in jobs.columns else F.lit(None).cast("string")), "status": F.when(lost, "error").otherwise(F.col("status"))})


def job_state(log: DataFrame, ttl_seconds: int = 86_400, now: Column | None = None) -> DataFrame:
    """The last state of each job in its log; those untouched for the time to live are gone."""
    last = log.groupBy("job_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "status")).alias("s"), F.min("ts").alias("created_at")).select("job_id", "s.status", F.col("s.ts").alias("updated_at"), "created_at")
    return last if now is None else last.where(F.unix_timestamp("updated_at") > F.unix_timestamp(now) - ttl_seconds)


def progress(steps: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(job_id, seq, stage, done, total) -> task_progress and an overall_progress that never falls, of stages with weights in the order they come; halves round to even."""
    w = Window.partitionBy("job_id").orderBy("seq")
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]), F.col("stage")), F.lit(1.0))
    task = F.when(F.col("total") > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.bround(F.col("done") / F.col("total") * 100)))).otherwise(0)
    staged = steps.withColumns({"_w": weight, "task_progress": task.cast("int")}).withColumn("_new", F.when(F.lag("stage").over(w).isNull() | (F.lag("stage").over(w) != F.col("stage")), F.lag("_w", 1, 0.0).over(w)).otherwise(0.0))
    whole = float(sum(weights.values()))
    now = F.bround((F.sum("_new").over(w) + F.col("_w") * F.col("task_progress") / 100) * 100 / whole)
    return staged.withColumn("_o", now).withColumn("overall_progress", F.least(F.lit(100), F.max("_o").over(w)).cast("int")).drop("_w", "_new", "_o")
