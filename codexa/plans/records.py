"""More of the catalogue: registries, scopes, requests, events, keys and texts, over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexa import schema
from codexa.functions import identity as fi
from codexa.operators import library, references, scopes, search, structure, versions
from codexa.plans import corpus
from codexa.plans.catalogue import joined, query
from codexa.plans.corpus import DOCS_SQL, NODES_SQL
from codexa.sources import files
from codexa.streaming import outbox

_SHARED = "coalesce(user_id, '') = ''"


def _strings(df: DataFrame) -> DataFrame:
    """Arrays of strings as text, so that results compare."""
    return df.select(*[joined(c, "|").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes])


# --- keys and lookups --------------------------------------------------------------------------


@query("SELECT DISTINCT source AS key, doc_id FROM documents UNION SELECT 'No. ' || doc_id, doc_id FROM documents")
def lookup_key_scan(spark, sf_dir):
    """Every key of every document asks."""
    d = corpus.table(spark, sf_dir, "documents")
    n = d.select("doc_id", fi.lookup_keys(F.col("source"), F.create_map(F.lit("code"), F.concat(F.lit("No. "), F.col("doc_id")))).alias("lookup_keys"))
    asked = d.select(F.col("source").alias("key")).union(d.select(F.concat(F.lit("No. "), F.col("doc_id"))))
    return library.lookup(n, asked)


@query("SELECT 'doc:' || source || ':' || doc_id AS key FROM documents WHERE starts_with('doc:' || source || ':' || doc_id, 'doc:src1:')")
def prefix_scan(spark, sf_dir):
    return library.prefixed(corpus.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "source", F.lit(":"), "doc_id").alias("key")), "doc:src1:")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct([source, 'No. ' || doc_id])), '|') AS aliases FROM documents")
def alias_lists(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    return _strings(d.select("doc_id", fi.aliases(F.col("source"), F.create_map(F.lit("code"), F.concat(F.lit(" No. "), F.col("doc_id"), F.lit(" ")), F.lit("none"), F.lit("  "))).alias("aliases")))


@query(f"WITH {NODES_SQL} SELECT id, text AS stripped FROM nodes WHERE regexp_matches(text, '^[A-Za-z]') AND ord > 0")
def stripped_numbers(spark, sf_dir):
    """Lines with their number and a bracket in front lose both again."""
    n = corpus.nodes(spark, sf_dir).where(F.col("text").rlike("^[A-Za-z]") & (F.col("order") > 0))
    return n.select("id", fi.strip_numbering(F.concat("numbering", F.lit(") "), "text"), F.col("numbering")).alias("stripped"))


@query(f"WITH {NODES_SQL} SELECT id, lower(lang) || '|' || lower(name) || '|' || lower(lang) AS tags FROM nodes")
def cleaned_tags(spark, sf_dir):
    n = corpus.nodes(spark, sf_dir)
    return _strings(n.select("id", fi.clean_tags(F.array(F.upper("lang"), F.concat(F.lit("  "), F.upper("name"), F.lit("\t")), F.lit(" "), F.col("lang"))).alias("tags")))


@query("SELECT n_nationkey AS id, trim(regexp_replace(lower(n_name), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS name FROM nation UNION ALL SELECT 100, 'санкт-петербург' UNION ALL SELECT 101, 'московская область' UNION ALL SELECT 102, 'город о'")
def territory_names(spark, sf_dir):
    n = corpus.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.concat(F.lit(" \""), "n_name", F.lit("\" ")).alias("name"))
    more = spark.createDataFrame([(100, "СПб."), (101, " Подмосковье"), (102, "Город   (О)!")], "id int, name string")
    return n.unionByName(more).select("id", fi.normalize_territory(F.col("name")).alias("name"))


@query("SELECT doc_id, 'corpus__' || trim(regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9]+', '_', 'g'), '_') || '_' || n_chars AS collection FROM documents")
def collections(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", fi.collection("corpus", F.concat("source", F.lit(" / "), "lang"), F.col("n_chars")).alias("collection"))


@query("WITH v AS (SELECT doc_id, source, text, CAST(n_chars % 3 AS VARCHAR) AS version FROM documents), seen AS (SELECT *, list(version) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS existing FROM v) SELECT doc_id, CASE WHEN list_contains(existing, version) THEN version || ' (ред. ' || substr(sha256(text), 1, 6) || ')' ELSE version END AS version FROM seen")
def disambiguated_versions(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = corpus.table(spark, sf_dir, "documents").withColumn("v", (F.col("n_chars") % 3).cast("string")).withColumn("existing", F.collect_set("v").over(w))
    return d.select("doc_id", fi.disambiguated(F.col("v"), F.col("existing"), F.sha2("text", 256)).alias("version"))


@query(f"WITH {NODES_SQL} SELECT id, left(trim(numbering || ' ' || text, ' ' || chr(9) || chr(13) || chr(12)), 60) AS label FROM nodes")
def breadcrumb_labels(spark, sf_dir):
    return corpus.nodes(spark, sf_dir).select("id", fi.label(F.col("numbering"), F.col("text")).alias("label"))


_PREFIX = "['ГОСТ Р', 'СНиП', 'СП', 'ТР ТС', 'ФЗ'][1 + CAST(doc_id % 5 AS INTEGER)]"


@query(f"SELECT doc_id, {_PREFIX} || ' ' || doc_id || '.13330.2016' AS target_name, '4.' || (doc_id % 9) AS target_numbering FROM documents UNION ALL SELECT doc_id, 'ГОСТ ' || (doc_id + 1) || '-2001', '' FROM documents")
def extracted_references(spark, sf_dir):
    """Two designations in every text, the first with a clause."""
    d = corpus.table(spark, sf_dir, "documents")
    prefix = F.element_at(F.array(*map(F.lit, ("ГОСТ Р", "СНиП", "СП", "ТР ТС", "ФЗ"))), (1 + F.col("doc_id") % 5).cast("int"))
    text = F.concat(F.lit("см. пункт 4."), F.col("doc_id") % 9, F.lit(" "), prefix, F.lit(" "), "doc_id", F.lit(".13330.2016, а также всё то, о чём сказано далее в других документах: ГОСТ "), F.col("doc_id") + 1, F.lit("-2001"))
    n = d.select("doc_id", F.col("doc_id").cast("string").alias("id"), text.alias("text"))
    return references.extract(n).select("doc_id", "target_name", "target_numbering")


# --- schema, versions, registry ----------------------------------------------------------------


@query("SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN 'name is missing; ' ELSE '' END || 'embedding is not of dimension 3' AS reason FROM embeddings")
def schema_violations(spark, sf_dir):
    v = corpus.table(spark, sf_dir, "embeddings")
    n = schema.conform(v.select(F.col("vec_id").alias("id"), *[F.lit("x").alias(c) for c in ("doc_id", "version", "content_hash", "type", "text")], F.when(F.col("vec_id") % 7 != 0, "x").alias("name"), "embedding"))
    return schema.check(n, 3).select(F.col("id").cast("bigint").alias("id"), "reason")


@query(f"WITH {NODES_SQL} SELECT id, CASE WHEN ord = 0 THEN version || '|new' ELSE array_to_string(versions, '|') END AS versions FROM nodes")
def versions_set(spark, sf_dir):
    """The first line of every document gets other versions."""
    n = corpus.nodes(spark, sf_dir).drop("embedding")
    v = n.where("order = 0").select("id", F.array("version", F.lit("new")).alias("versions"))
    return _strings(versions.set_versions(n, v).select("id", "versions"))


@query("SELECT *, registered <> stored AS diverges FROM (SELECT count(DISTINCT 'src' || (doc_id % 25)) AS registered, count(DISTINCT source) AS stored FROM documents)")
def registry_divergence(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    return versions.diverges(d.select(F.concat(F.lit("src"), F.col("doc_id") % 25).alias("name")).distinct(), d)


_REGISTRY = f"{DOCS_SQL}, last AS (SELECT sha256(text) AS content_hash, arg_max(name, struct_pack(v := version, d := doc_id)) AS name, arg_max(version, struct_pack(v := version, d := doc_id)) AS version FROM docs GROUP BY sha256(text)), kept AS (SELECT * FROM last WHERE name NOT IN ('src1', 'src2') AND version <> '000041')"


@query(f"WITH {_REGISTRY} SELECT name, content_hash, version FROM kept")
def registry_writes(spark, sf_dir):
    """All documents are registered, those of two names and one version are forgotten, and another scope is wiped."""
    d = corpus.documents(spark, sf_dir).select(F.lit("shared").alias("scope_key"), F.sha2("text", 256).alias("content_hash"), "name", "version", "doc_id")
    other = d.withColumn("scope_key", F.lit("user:u1:project:p1"))
    r = versions.register(versions.register(d.limit(0), d), other)
    known = r.select("name", "version").where("version = '000041'").distinct()
    gone = spark.createDataFrame([("src1", None), ("src2", None)], "name string, version string").unionByName(known)
    return versions.wipe(versions.unregister(r, gone), "user:u1:project:p1").select("name", "content_hash", "version")


@query(f"WITH {NODES_SQL} SELECT doc_id, count(*) AS node_count, CASE WHEN doc_id % 3 = 0 THEN 'registered' ELSE min(name) END AS name, min(version) AS version FROM nodes GROUP BY doc_id")
def library_with_registry(spark, sf_dir):
    """A registered document's record comes before its nodes."""
    d = corpus.documents(spark, sf_dir).where("doc_id % 3 = 0").select("doc_id", F.lit("registered").alias("name"))
    return library.library(corpus.nodes(spark, sf_dir), d).select("doc_id", "node_count", "name", "version")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'СП ' || doc_id || '.2099' WHEN 1 THEN source ELSE 'hint 1998' END AS name, CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'given' ELSE '2099' END WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'given' ELSE 'unknown' END ELSE CASE WHEN doc_id % 2 = 0 THEN 'given' ELSE '1998' END END AS version, doc_id % 3 = 2 OR doc_id % 2 = 1 AND doc_id % 3 = 1 AS asks FROM documents")
def resolved_heads(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 3
    heads = d.select("doc_id", F.when(k == 0, F.concat(F.lit(" СП "), "doc_id", F.lit(".2099"))).when(k == 1, F.col("source")).otherwise(" ").alias("name_override"), F.when(F.col("doc_id") % 2 == 0, " given ").alias("version_override"), F.when(k == 2, "hint 1998").alias("hint_name"), F.lit(None).cast("string").alias("hint_version"))
    return library.resolved_head(heads).select("doc_id", "name", "version", "asks")


# --- scopes, users, requests -------------------------------------------------------------------


@query(f"WITH {NODES_SQL} SELECT array_to_string(list_sort(list(DISTINCT document_level)), '|') AS levels, count(DISTINCT doc_id) FILTER (WHERE tagging_status = 'pending') AS pending_documents FROM nodes WHERE {_SHARED}")
def scopes_overview(spark, sf_dir):
    return _strings(library.scopes_summary(corpus.nodes(spark, sf_dir), search.shared_only()))


_MINE = "coalesce(user_id = 'u1' AND project_id = 'p1', false)"


@query(f"WITH {NODES_SQL} SELECT id, text, {_MINE} AS mine FROM nodes WHERE NOT ({_MINE} AND block = 'main') UNION ALL SELECT 'new:' || id, upper(lang), true FROM nodes WHERE {_SHARED} AND ord = 0")
def scoped_writes(spark, sf_dir):
    """One user's project deletes all of block main, which reaches its own nodes only, and writes a heading for every shared document, which are stamped as its own."""
    n = corpus.nodes(spark, sf_dir).select("id", "text", "user_id", "project_id", "block", "order", "lang")
    left = scopes.Scoped(n, "u1", "p1").delete(F.col("block") == "main")
    new = n.where(search.shared_only() & (F.col("order") == 0)).withColumns({"id": F.concat(F.lit("new:"), "id"), "text": F.upper("lang")})
    out = scopes.Scoped(left, "u1", "p1").upsert(new)
    mine = scopes.Scoped(out, "u1", "p1")
    return out.select("id", "text", mine.mine.alias("mine"))


_ASKED = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'u' || (event_id % 3) END AS user_id, CASE WHEN event_id % 4 = 1 THEN CAST(event_id % 11 AS VARCHAR) END AS project_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id % 13 AS VARCHAR) WHEN 1 THEN 'x1' WHEN 2 THEN CAST(1000000 + event_id AS VARCHAR) WHEN 3 THEN CAST(1 + event_id % 10 AS VARCHAR) END AS scenario_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'u' || (event_id % 3 + CASE WHEN event_id % 8 = 0 THEN 1 ELSE 0 END) END AS caller FROM events"
_FOUND = f"WITH r AS ({_ASKED}), s AS (SELECT range AS scenario_id, CASE WHEN range <> 5 THEN CAST(range % 11 AS VARCHAR) END AS project_id FROM range(1, 100)), f AS (SELECT r.*, s.project_id AS found, CASE WHEN r.scenario_id IS NULL THEN NULL WHEN NOT regexp_full_match(r.scenario_id, '[0-9]+') OR CAST(r.scenario_id AS BIGINT) <= 0 THEN 'scenario_id must be a positive integer' WHEN s.scenario_id IS NULL THEN 'no such scenario' WHEN s.project_id IS NULL THEN 'the scenario has no project' END AS wrong FROM r LEFT JOIN s ON s.scenario_id = TRY_CAST(r.scenario_id AS BIGINT))"


def _asked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = corpus.table(spark, sf_dir, "events")
    scenarios = spark.range(1, 100).select(F.col("id").alias("scenario_id"), F.when(F.col("id") != 5, F.col("id") % 11).alias("project_id"))
    return e.selectExpr(*_ASKED.replace("VARCHAR", "STRING").removeprefix("SELECT ").removesuffix(" FROM events").replace(", CASE", "\x01CASE").split("\x01")), scenarios


@query(_FOUND + " SELECT event_id, found AS found_project, wrong AS scenario_error FROM f")
def scenario_projects(spark, sf_dir):
    return scopes.project_of_scenarios(*_asked(spark, sf_dir)).select("event_id", "found_project", "scenario_error")


@query(_FOUND + """, e AS (SELECT *, CASE WHEN user_id IS NULL AND project_id IS NULL AND scenario_id IS NULL THEN NULL WHEN caller IS NULL THEN 'user data needs an authenticated user' WHEN user_id <> caller THEN 'another user''s data can''t be searched' WHEN project_id IS NULL AND scenario_id IS NULL THEN 'a user''s documents are searched by project or scenario' WHEN wrong IS NOT NULL THEN wrong WHEN project_id <> found THEN 'project_id is not the scenario''s project' END AS error FROM f)
SELECT event_id, CASE WHEN error IS NULL AND (user_id IS NOT NULL OR project_id IS NOT NULL OR scenario_id IS NOT NULL) THEN caller END AS owner, CASE WHEN error IS NULL AND (user_id IS NOT NULL OR project_id IS NOT NULL OR scenario_id IS NOT NULL) THEN coalesce(found, project_id) END AS project, error FROM e""")
def validated_requests(spark, sf_dir):
    return scopes.validated(*_asked(spark, sf_dir)).select("event_id", "owner", "project", "error")


@query("SELECT c_custkey AS id, c_custkey % 2 = 0 AS legacy FROM customer UNION ALL SELECT o_custkey + 1000000, true FROM orders GROUP BY o_custkey")
def legacy_merge(spark, sf_dir):
    c, o = corpus.table(spark, sf_dir, "customer"), corpus.table(spark, sf_dir, "orders")
    registry = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 2 == 0).alias("legacy"))
    old = o.select((F.col("o_custkey") + 1_000_000).alias("id"), F.lit(True).alias("legacy")).union(c.select(F.col("c_custkey").alias("id"), F.lit(True)))
    once = scopes.merge_legacy(registry, old, ["id"])
    return scopes.merge_legacy(once, old, ["id"])


_GRID = f"{NODES_SQL}, d AS (SELECT doc_id, any_value(name) AS name, any_value(version) AS version, any_value(territory_name) AS territory_name, any_value(uploaded_at) AS uploaded_at, any_value(tags) AS tags, any_value(territory_path) AS territory_path, any_value(tagging_status) AS tagging_status FROM nodes GROUP BY doc_id)"


def _grid(spark, sf_dir) -> DataFrame:
    d = corpus.documents(spark, sf_dir).withColumn("tagging_status", F.when(F.col("doc_id") % 4 == 1, "pending").otherwise("ok"))
    return d.select("doc_id", "name", "version", "territory_name", "uploaded_at", "tags", "territory_path", "document_level", "tagging_status")


@query(f"WITH {_GRID} SELECT doc_id FROM d WHERE contains(lower(name || ' ' || version || ' ' || array_to_string(tags, ' ') || ' ' || coalesce(territory_name, '')), 'n_1') AND list_contains(tags, 'en') AND list_contains(territory_path, 1001) AND tagging_status = 'pending'")
def grid_filter(spark, sf_dir):
    return library.grid(_grid(spark, sf_dir), " N_1", "en", "municipal", 1001, True).select("doc_id")


@query(f"WITH {DOCS_SQL} SELECT doc_id, uploaded_at FROM docs ORDER BY uploaded_at DESC, doc_id LIMIT 5")
def grid_recent(spark, sf_dir):
    return library.recent(_grid(spark, sf_dir)).select("doc_id", "uploaded_at")


# --- events, jobs, logs ------------------------------------------------------------------------

_PAYLOAD = "'{{\"doc_id\":' || event_id || ',\"name\":\"' || event_type || '\",\"version\":\"1\"' || {} || '}}'"


def _changes(spark, sf_dir) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events")
    action = F.element_at(F.array(*map(F.lit, ("processed", "updated", "deleted", "read"))), (1 + F.col("event_id") % 4).cast("int"))
    return e.select(F.col("event_id").alias("seq"), action.alias("action"), (F.col("event_id") % 8 < 4).alias("direct"), F.col("event_id").alias("doc_id"), F.col("event_type").alias("name"), F.lit("1").alias("version"))


_MODEL = "CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 8 < 4 THEN 'DirectDocumentProcessed' ELSE 'DocumentProcessed' END WHEN 1 THEN CASE WHEN event_id % 8 < 4 THEN 'DirectDocumentUpdated' ELSE 'DocumentUpdated' END ELSE 'DocumentDeleted' END"


@query(f"SELECT event_id AS seq, {_MODEL} AS model, CASE WHEN event_id % 4 = 2 THEN '{{\"name\":\"' || event_type || '\",\"version\":\"1\"}}' ELSE {_PAYLOAD.format(chr(39) * 2)} END AS payload, '2024-05-05T00:00:00' AS enqueued_at, 0 AS attempts FROM events WHERE event_id % 4 <> 3")
def emitted_events(spark, sf_dir):
    return outbox.emitted(_changes(spark, sf_dir), F.lit("2024-05-05").cast("timestamp"))


@query(f"SELECT event_id AS seq, CASE WHEN event_id % 4 = 2 THEN '{{\"name\":\"' || event_type || '\",\"version\":\"1\",\"user_id\":\"u7\",\"scenario_id\":\"12\"}}' ELSE {_PAYLOAD.format(chr(39) + ',' + chr(34) + 'user_id' + chr(34) + ':' + chr(34) + 'u7' + chr(34) + ',' + chr(34) + 'scenario_id' + chr(34) + ':' + chr(34) + '12' + chr(34) + chr(39))} END AS payload FROM events WHERE event_id % 4 <> 3")
def scoped_events(spark, sf_dir):
    changes = _changes(spark, sf_dir).withColumns({"user_id": F.lit("someone"), "project_id": F.lit("p")})
    return outbox.emitted(outbox.scoped(changes, "u7", "12")).select("seq", "payload")


@query("SELECT event_id AS job_id, CASE WHEN event_type IN ('signup', 'view', 'error') THEN 'error' ELSE 'done' END AS status, CASE WHEN event_type IN ('signup', 'view') THEN 'interrupted by a restart: upload the document again' END AS error FROM events")
def orphaned_jobs(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events")
    status = F.expr("CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'error' ELSE 'done' END")
    return library.abort_orphans(e.select(F.col("event_id").alias("job_id"), status.alias("status"))).select("job_id", "status", "error")


@query("SELECT user_id AS job_id, max(ts) AS updated_at FROM events GROUP BY user_id HAVING epoch(max(ts)) > (SELECT epoch(max(ts)) FROM events) - 3600")
def jobs_alive(spark, sf_dir):
    """States an hour old or more have expired, as of the last event."""
    e = corpus.table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    return library.job_state(e.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts"), 3600, F.lit(now)).select("job_id", "updated_at")


@query("SELECT event_id, CASE WHEN event_id % 10 = 9 THEN 'no json ' || event_id ELSE '2024-01-01T00:00:00 [INFO] app: ' || event_type END AS formatted FROM events")
def log_format(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 10 == 9, F.concat(F.lit("no json "), "event_id")).otherwise(F.to_json(F.struct(F.lit("2024-01-01T00:00:00").alias("timestamp"), F.lit("info").alias("level"), F.lit("app").alias("logger"), F.col("event_type").alias("event"), (F.col("event_id") % 3).cast("string").alias("request_id"))))
    each = e.select("event_id", line.alias("line"))
    return files.log_text(files.log_lines(each)).select("event_id", "formatted")


@query("SELECT CAST(event_id AS VARCHAR) AS event FROM events WHERE event_id % 10 <> 9 AND event_id % 3 = 1")
def log_filter(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 10 == 9, F.lit("no json")).otherwise(F.to_json(F.struct(F.lit("2024-01-01T00:00:00").alias("timestamp"), F.col("event_id").cast("string").alias("event"), (F.col("event_id") % 3).cast("string").alias("request_id"))))
    return files.log_lines(e.select(line.alias("line")), "2024-01-01", "1").select("event")


# --- texts and structure -----------------------------------------------------------------------


@query(f"WITH {NODES_SQL}, f AS (SELECT doc_id, list(text ORDER BY ord) AS ts FROM nodes GROUP BY doc_id), ok AS (SELECT doc_id, ts, sha256(array_to_string(ts, chr(10))) AS h FROM f WHERE len(list_filter(ts, lambda x: NOT regexp_matches(x, '\\S'))) = 0) SELECT CAST(doc_id AS VARCHAR) AS name, CAST(unnest(range(len(ts))) AS INTEGER) AS \"order\", unnest(ts) AS text, h AS content_hash, 'paragraph' AS type FROM ok")
def direct_documents(spark, sf_dir):
    """Every document as a direct one, its lines the fragments; one with a blank line is rejected whole."""
    none = F.lit(None).cast("string")
    strings = F.array().cast("array<string>")
    maps = F.lit(None).cast("map<string,string>")
    fragment = lambda x: F.struct(x.alias("text"), none.alias("type"), none.alias("kind"), none.alias("numbering"), none.alias("block"), strings.alias("tags"), maps.alias("metadata"), none.alias("table_html"), none.alias("parent_id"))
    d = corpus.table(spark, sf_dir, "documents")
    docs = d.select(F.col("doc_id").cast("string").alias("name"), F.lit("1").alias("version"), maps.alias("external_ids"), maps.alias("metadata"), F.transform(F.split("text", "\n"), fragment).alias("fragments"))
    accepted, _ = files.direct_fragments(docs)
    return accepted.select("name", "order", "text", "content_hash", "type")


@query("SELECT vec_id, list_min(list_transform(range(1, len(embedding), 2), lambda k: CAST(embedding[k] AS DOUBLE))) AS x0, list_max(list_transform(range(1, len(embedding), 2), lambda k: CAST(embedding[k + 1] AS DOUBLE))) AS y1 FROM embeddings")
def bounding_boxes(spark, sf_dir):
    """Each vector's numbers by twos as points."""
    v = corpus.table(spark, sf_dir, "embeddings").withColumn("points", F.expr("transform(sequence(1, size(embedding) - 1, 2), k -> array(cast(element_at(embedding, k) as double), cast(element_at(embedding, k + 1) as double)))"))
    return v.withColumn("box", structure.bounding_box(F.col("points"))).select("vec_id", F.col("box")[0].alias("x0"), F.col("box")[3].alias("y1"))


@query(f"WITH {NODES_SQL}, j AS (SELECT *, CASE WHEN ord = 0 OR length(text) % 3 <> 0 OR regexp_matches(trim(text, ' ' || chr(9) || chr(13) || chr(12)), '(?i)^\\s*(?:[0-9]+(?:\\.[0-9]+)+[.)]?|[0-9]+[.)]|[IVXLCDM]+[.)]|[а-яёa-z][.)])\\s+\\S') THEN 1 ELSE 0 END AS starts FROM nodes), r AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS part FROM j) SELECT doc_id, part, string_agg(text, ' ' ORDER BY ord) AS text, count(*) AS blocks FROM r GROUP BY doc_id, part")
def semantic_merges(spark, sf_dir):
    """A line of a length divisible by three goes on from the one before, by a table of decisions, unless it has a number."""
    n = corpus.nodes(spark, sf_dir).select("doc_id", F.col("order").alias("part"), "text", F.lit("NarrativeText").alias("category"), F.lit(None).cast("string").alias("html"), F.array("order").alias("src_ids"))
    decisions = n.select("doc_id", "part", F.when(F.length("text") % 3 == 0, "continuation").otherwise("new").alias("decision"))
    out = structure.semantic_merge(n, decisions)
    return out.select("doc_id", "part", "text", F.size("src_ids").cast("bigint").alias("blocks"))


@query(f"WITH {DOCS_SQL}, o AS (SELECT DISTINCT sha256(text) AS h FROM docs) SELECT h || '.txt' AS key FROM o")
def stored_objects(spark, sf_dir):
    """Originals by content: equal files are one object."""
    d = corpus.table(spark, sf_dir, "documents").select(F.lit("txt").alias("ext"), F.col("text").cast("binary").alias("content"))
    return files.objects(d).select("key")
