"""The driver's tables as a corpus: a line of a document is a node, a source is a document's name, a doc_id one of its versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.session import ready


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root -1, regions at 1000 and up, nations below them."""
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("territory_id"), F.col("r_name").alias("name"), F.lit(2).alias("level"), F.lit(2).alias("type_id"), F.lit("region").alias("type_name"), F.lit(-1).alias("parent_id"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("territory_id"), F.col("n_name").alias("name"), F.lit(3).alias("level"), F.lit(3).alias("type_id"), F.lit("nation").alias("type_name"), (F.col("n_regionkey") + 1000).alias("parent_id"))
    root = spark.range(1).select(F.lit(-1).alias("territory_id"), F.lit("WORLD").alias("name"), F.lit(1).alias("level"), F.lit(1).alias("type_id"), F.lit("root").alias("type_name"), F.lit(None).cast("int").alias("parent_id"))
    return root.unionByName(r).unionByName(n)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: identity, scope and territory."""
    d = table(spark, sf_dir, "documents")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("territory_id"), F.col("n_name").alias("territory_name"), (F.col("n_regionkey") + 1000).alias("_region"))
    own = F.col("doc_id") % 10 == 0
    e = d.select(
        "doc_id", "text", "lang", F.col("source").alias("name"), F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("version"), F.col("source").alias("corpus"), F.when(own, F.concat(F.lit("u"), F.col("doc_id") % 3)).alias("user_id"), F.when(own, F.concat(F.lit("p"), F.col("doc_id") % 5)).alias("project_id"),
        (F.col("doc_id") % 25).cast("int").alias("territory_id"), F.date_format(F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int))"), "yyyy-MM-dd'T'HH:mm:ss").alias("uploaded_at"))
    e = e.join(F.broadcast(n), "territory_id", "left")  # 25 nations
    return e.withColumns({"document_level": F.lit("municipal"), "territory_path": F.array(F.lit(-1), "_region", "territory_id"), "tags": F.array("lang", "name")}).drop("_region")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line. Every third line also belongs to the version twenty documents on, which has the same name; the first line is the parent of the others."""
    e = documents(spark, sf_dir).select("*", F.posexplode(F.split("text", "\n")).alias("order", "line")).drop("text").withColumnRenamed("line", "text")
    ident = lambda k: F.concat(F.col("doc_id").cast("string"), F.lit(":"), k.cast("string"))
    first = F.col("order") == 0
    return e.withColumns({
        "id": ident(F.col("order")), "kind": F.lit("text"), "type": F.when(first, "chapter").otherwise("paragraph"), "block": F.when(F.col("order") % 7 == 6, "amendment").otherwise("main"), "numbering": F.when(first, "1").otherwise(F.concat(F.lit("1."), F.col("order"))),
        "versions": F.when(F.col("order") % 3 == 2, F.array("version", F.lpad((F.col("doc_id") + 20).cast("string"), 6, "0"))).otherwise(F.array("version")), "other_versions": F.array().cast("array<string>"),
        "parent_id": F.when(~first, ident(F.lit(0))), "source_object_key": F.when(first, F.concat(F.lit("objects/"), F.col("version"))), "tagging_status": F.when(F.col("doc_id") % 4 == 1, "pending").otherwise("ok"), "tagging_attempts": (F.col("doc_id") % 8).cast("int"), "embedding": F.lit(None).cast("array<float>"),
    })


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have a vector, as nodes."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return documents(spark, sf_dir).join(v, F.col("doc_id") == F.col("vec_id")).withColumn("id", F.col("doc_id"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as nodes in a chain."""
    t = table(spark, sf_dir, "conversations")
    ident = lambda k: F.concat(F.col("conv_id").cast("string"), F.lit(":"), k.cast("string"))
    return t.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("order"), "text", "role", ident(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, ident(F.col("turn") - 1)).alias("prev_id"), ident(F.col("turn") + 1).alias("next_id"))


_OWN = "doc_id % 10 = 0"
#: The same relations for DuckDB, as common table expressions.
DOCS_SQL = f"""docs AS (
  SELECT doc_id, text, lang, source AS name, lpad(CAST(doc_id AS VARCHAR), 6, '0') AS version, source AS corpus,
    CASE WHEN {_OWN} THEN 'u' || (doc_id % 3) END AS user_id, CASE WHEN {_OWN} THEN 'p' || (doc_id % 5) END AS project_id, CAST(doc_id % 25 AS INTEGER) AS territory_id,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%S') AS uploaded_at, n_name AS territory_name, 'municipal' AS document_level, [-1, n_regionkey + 1000, CAST(doc_id % 25 AS INTEGER)] AS territory_path, [lang, source] AS tags
  FROM documents LEFT JOIN nation ON n_nationkey = doc_id % 25)"""
NODES_SQL = (
    DOCS_SQL
    + """,
nodes AS (
  SELECT * EXCLUDE (text, line, parts), line AS text, doc_id || ':' || ord AS id, CASE WHEN ord = 0 THEN 'chapter' ELSE 'paragraph' END AS type, CASE WHEN ord % 7 = 6 THEN 'amendment' ELSE 'main' END AS block,
    CASE WHEN ord = 0 THEN '1' ELSE '1.' || ord END AS numbering, CASE WHEN ord % 3 = 2 THEN [version, lpad(CAST(doc_id + 20 AS VARCHAR), 6, '0')] ELSE [version] END AS versions,
    CASE WHEN ord > 0 THEN doc_id || ':0' END AS parent_id, CASE WHEN ord = 0 THEN 'objects/' || version END AS source_object_key, CASE WHEN doc_id % 4 = 1 THEN 'pending' ELSE 'ok' END AS tagging_status, CAST(doc_id % 8 AS INTEGER) AS tagging_attempts
  FROM (SELECT *, parts[ord + 1] AS line FROM (SELECT *, string_split(text, chr(10)) AS parts, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS ord FROM docs)))"""
)
TERRITORIES_SQL = """territories AS (
  SELECT -1 AS territory_id, 'WORLD' AS name, CAST(NULL AS INTEGER) AS parent_id, 1 AS level
  UNION ALL SELECT r_regionkey + 1000, r_name, -1, 2 FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey + 1000, 3 FROM nation)"""
TURNS_SQL = """turns AS (
  SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS ord, text, role, conv_id || ':' || turn AS id, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS prev_id, conv_id || ':' || (turn + 1) AS next_id FROM conversations)"""
