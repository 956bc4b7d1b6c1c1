"""URL filters by a temporal list join.

A list is a log of dated entries: (list, kind, value, action, at). kind `domain` covers a host and all below it, `host` one host, `prefix` a host and leading path segments (`host/a/b`). Each `add` is valid from its time up to, not including, the next entry of the same list, kind and value, whichever its action. A capture is joined as of its fetch time with every interval that one of its keys falls into; an active entry of a list called `allow...` wins over all others.

The equi-join is on (kind, value). The intervals are broadcast if they are `broadcast_rows` or fewer, else shuffled; keys with fewer labels than any entry of their kind has (`com`, which every capture would bring) are dropped before. Only captures with a hit take part in the aggregation, whose rows are written to the shared folder and broadcast in their turn if they are a quarter as many or fewer, so that the captures themselves move only if neither bound holds.

Defined cases. Null or malformed URL (no scheme or host): no host, never listed. Null fetch time: no entry is active. Entries null in any column, or of another action or kind: ignored. Entries of one instant: `remove` follows `add`, so the value is off. Repeated entries change nothing; repeated captures are each returned. Schemes and hosts are matched in lower case, paths as they are, empty path segments don't count; user names, ports, queries and fragments are left out, as is a dot at the host's end. Other columns of the captures stay, and a result column whose name is taken gets underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexa.llm._base import fresh, prepare, small, stored

#: Intervals that are broadcast at most, some 150 bytes each; of captures with a hit, whose URLs are longer, a quarter as many.
BROADCAST_ROWS = 400_000
#: The tables hold no fetch time: captures are spread over the minutes of a year by their number.
FETCHED = "timestamp_seconds(1704067200 + pmod(page_id * 7919, 525600) * 60)"


def log_of(captures: DataFrame) -> DataFrame:
    """A dated log made from the captures' own hosts and paths, a part of each kind by the least page_id that has them: the tables bring no list, and one written down here would hardly meet them."""
    seen = captures.select("page_id", host_of(F.col("url")).alias("host"), F.filter(F.split(path_of(F.col("url")), "/"), lambda x: x != "").alias("path")).where("host <> ''")
    hosts = seen.groupBy("host").agg(F.min("page_id").alias("m"))
    sites = seen.where("size(path) > 0").groupBy(F.concat("host", F.lit("/"), F.col("path")[0]).alias("site")).agg(F.min("page_id").alias("m"))
    parts = [
        (hosts, "m % 5 = 0", "spam", "domain", "host", "add", 0), (hosts, "m % 10 = 0", "spam", "domain", "host", "remove", 120), (hosts, "m % 20 = 0", "spam", "domain", "host", "add", 200),
        (hosts, "m % 5 = 1", "adult", "host", "host", "add", 30), (hosts, "m % 10 = 6", "adult", "host", "host", "remove", 300), (hosts, "m % 25 = 5", "allow-partners", "host", "host", "add", 10),
        (hosts, "m % 50 = 3", "network", "domain", "substr(host, length(split_part(host, '.', 1)) + 2)", "add", 60),
        (sites, "m % 4 = 0", "mirrors", "prefix", "site", "add", 0), (sites, "m % 8 = 4", "mirrors", "prefix", "site", "remove", 90), (sites, "m % 16 = 2", "allow-partners", "prefix", "site", "add", 45),
    ]
    log = None
    for df, where, name, kind, value, action, days in parts:
        at = F.expr(f"timestamp'2023-12-01 00:00:00' + make_dt_interval(cast(m * 37 % 300 + {days} as int))")
        rows = df.where(where).select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), F.expr(value).alias("value"), F.lit(action).alias("action"), at.alias("at"))
        log = rows if log is None else log.unionAll(rows)
    return log.where("value like '%.%'")


def intervals(log: DataFrame) -> DataFrame:
    """(list, kind, value, valid_from, valid_to) of the additions; valid_to is null while an addition stands."""
    known = log.where("list is not null and value is not null and at is not null and kind in ('domain', 'host', 'prefix') and action in ('add', 'remove')").select("list", "kind", F.lower("value").alias("lower"), "value", "action", "at").distinct()
    known = known.withColumn("value", F.when(F.col("kind") == "prefix", F.concat(F.lower(F.substring_index("value", "/", 1)), F.expr("substr(value, length(substring_index(value, '/', 1)) + 1)"))).otherwise(F.col("lower"))).drop("lower")
    nxt = F.lead("at").over(Window.partitionBy("list", "kind", "value").orderBy("at", "action"))
    return known.withColumn("valid_to", nxt).where("action = 'add' and (valid_to is null or valid_to > at)").select("list", "kind", "value", F.col("at").alias("valid_from"), "valid_to")


def host_of(url) -> F.Column:
    return F.lower(F.rtrim(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1), F.lit(".")))


def path_of(url) -> F.Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def evaluated(captures: DataFrame, log: DataFrame, fetched_at: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """captures with host, lists (the active ones, sorted, joined by commas) and verdict: allow, block or none. fetched_at: SQL for the fetch time."""
    prepare(captures.sparkSession)
    names = captures.columns
    host, when, lists, verdict = (fresh(names, x) for x in ("host", "fetched_at", "lists", "verdict"))
    seen = captures.withColumns({host: host_of(F.col("url")), when: F.expr(fetched_at)})
    at = seen.select("url", F.col(host).alias("h"), F.col(when).alias("t")).where("h <> '' and t is not null")
    labels, path = F.split("h", r"\."), F.filter(F.split(path_of(F.col("url")), "/"), lambda x: x != "")
    keyed = at.select("url", "h", "t", labels.alias("labels"), path.alias("path")).select(
        "url", "t",
        F.explode(F.expr("""concat(
            array(struct('host' AS kind, h AS value)),
            transform(sequence(1, size(labels)), k -> struct('domain' AS kind, array_join(slice(labels, k, size(labels)), '.') AS value)),
            transform(sequence(0, size(path)), k -> struct('prefix' AS kind, array_join(concat(array(h), slice(path, 1, k)), '/') AS value)))""")).alias("key"))  # fmt: skip
    every = stored(intervals(log), "intervals")
    least = {r["kind"]: r["n"] for r in every.groupBy("kind").agg(F.min(F.size(F.split(F.substring_index("value", "/", 1), r"\."))).alias("n")).collect()}  # three kinds
    spans = small(every, broadcast_rows)
    enough = F.lit(False)
    for kind, n in least.items():
        enough = enough | (F.col("kind") == kind) & (F.size(F.split(F.substring_index("value", "/", 1), r"\.")) >= n)
    hit = keyed.select("url", "t", "key.*").where(enough).join(spans, ["kind", "value"]).where("t >= valid_from and (valid_to is null or t < valid_to)")
    u, t = fresh([*names, host, when], "hit_url"), fresh([*names, host, when], "hit_time")
    found = hit.groupBy(F.col("url").alias(u), F.col("t").alias(t)).agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias(lists), F.when(F.bool_or(F.col("list").startswith("allow")), "allow").otherwise("block").alias(verdict))
    found = small(stored(found, "hits"), broadcast_rows // 4)
    out = seen.join(found, (seen["url"] == found[u]) & (seen[when] == found[t]), "left")
    return out.select(*names, host, when, F.coalesce(lists, F.lit("")).alias(lists), F.coalesce(verdict, F.lit("none")).alias(verdict))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return evaluated(pages, log_of(pages), FETCHED).select("page_id", "host", "fetched_at", "lists", "verdict")


SQL = r"""
WITH seen AS (
  SELECT page_id, url, lower(rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '.')) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS path,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((page_id * 7919) % 525600 AS BIGINT)) AS fetched_at
  FROM pages),
hosts AS (SELECT host AS value, min(page_id) AS m FROM seen WHERE host <> '' GROUP BY host),
sites AS (SELECT host || '/' || path[1] AS value, min(page_id) AS m FROM seen WHERE host <> '' AND len(path) > 0 GROUP BY 1),
log AS (SELECT list, kind, value, action, TIMESTAMP '2023-12-01 00:00:00' + to_days(CAST(m * 37 % 300 + days AS INTEGER)) AS at_time FROM (
  SELECT 'spam' AS list, 'domain' AS kind, value, 'add' AS action, m, 0 AS days FROM hosts WHERE m % 5 = 0
  UNION ALL SELECT 'spam', 'domain', value, 'remove', m, 120 FROM hosts WHERE m % 10 = 0
  UNION ALL SELECT 'spam', 'domain', value, 'add', m, 200 FROM hosts WHERE m % 20 = 0
  UNION ALL SELECT 'adult', 'host', value, 'add', m, 30 FROM hosts WHERE m % 5 = 1
  UNION ALL SELECT 'adult', 'host', value, 'remove', m, 300 FROM hosts WHERE m % 10 = 6
  UNION ALL SELECT 'allow-partners', 'host', value, 'add', m, 10 FROM hosts WHERE m % 25 = 5
  UNION ALL SELECT 'network', 'domain', substr(value, strpos(value, '.') + 1), 'add', m, 60 FROM hosts WHERE m % 50 = 3
  UNION ALL SELECT 'mirrors', 'prefix', value, 'add', m, 0 FROM sites WHERE m % 4 = 0
  UNION ALL SELECT 'mirrors', 'prefix', value, 'remove', m, 90 FROM sites WHERE m % 8 = 4
  UNION ALL SELECT 'allow-partners', 'prefix', value, 'add', m, 45 FROM sites WHERE m % 16 = 2) WHERE contains(value, '.')),
spans AS (
  SELECT list, kind, value, at_time AS valid_from, valid_to FROM (
    SELECT *, lead(at_time) OVER (PARTITION BY list, kind, value ORDER BY at_time, action) AS valid_to FROM (SELECT DISTINCT * FROM log))
  WHERE action = 'add' AND (valid_to IS NULL OR valid_to > at_time)),
keyed AS (
  SELECT page_id, url, fetched_at, 'host' AS kind, host AS value FROM seen
  UNION ALL SELECT page_id, url, fetched_at, 'domain', unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda k: array_to_string(string_split(host, '.')[k:], '.'))) FROM seen
  UNION ALL SELECT page_id, url, fetched_at, 'prefix', unnest(list_transform(range(0, len(path) + 1), lambda k: array_to_string(list_concat([host], path[1:k]), '/'))) FROM seen),
hits AS (
  SELECT page_id, url, fetched_at, list_sort(list(DISTINCT list)) AS ls
  FROM keyed JOIN spans USING (kind, value)
  WHERE fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to) GROUP BY ALL)
SELECT seen.page_id, seen.host, seen.fetched_at, coalesce(array_to_string(ls, ','), '') AS lists,
  CASE WHEN ls IS NULL THEN 'none' WHEN len(list_filter(ls, lambda x: starts_with(x, 'allow'))) > 0 THEN 'allow' ELSE 'block' END AS verdict
FROM seen LEFT JOIN hits ON hits.page_id = seen.page_id AND hits.url = seen.url
"""
