"""Continuous processes: event delivery with dead letters, links that wait for their documents, job states."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ENTRY = "seq long, model string, payload string, enqueued_at string, attempts int"
MODELS = ("DirectDocumentProcessed", "DirectDocumentUpdated", "DocumentDeleted", "DocumentProcessed", "DocumentUpdated")
ATTEMPTS = 10


def event(df: DataFrame, model: str, fields: list[str], key: str = "seq", now: Column | None = None) -> DataFrame:
    """Rows as outbox entries of one model, the fields as a JSON object. now: the run's one clock, the session's if left out."""
    clock = F.current_timestamp() if now is None else now
    return df.select(F.col(key).cast("long").alias("seq"), F.lit(model).alias("model"), F.to_json(F.struct(*fields)).alias("payload"), F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss").alias("enqueued_at"), F.lit(0).alias("attempts"))


#: What each model tells, and which of them say whose project a document is.
FIELDS = {
    "DocumentProcessed": ("doc_id", "name", "version", "user_id", "scenario_id", "node_count"),
    "DocumentUpdated": ("doc_id", "name", "version", "user_id", "scenario_id", "inserted", "reused"),
    "DocumentDeleted": ("name", "version", "user_id", "scenario_id", "deleted"),
    "DirectDocumentProcessed": ("doc_id", "name", "version", "user_id", "scenario_id", "node_count"),
    "DirectDocumentUpdated": ("doc_id", "name", "version", "user_id", "scenario_id", "node_count"),
}


def emitted(changes: DataFrame, now: Column | None = None) -> DataFrame:
    """changes (seq, action, direct, and the models' fields) as entries: one event for each document that was loaded (processed), replaced or updated (updated), or removed (deleted), direct ones under their own model. A reload is one change, hence one event."""
    direct = F.coalesce("direct", F.lit(False))
    model = F.when(F.col("action") == "deleted", "DocumentDeleted").when(F.col("action") == "processed", F.when(direct, "DirectDocumentProcessed").otherwise("DocumentProcessed")).when(F.col("action") == "updated", F.when(direct, "DirectDocumentUpdated").otherwise("DocumentUpdated"))
    payload = None
    for name, fields in FIELDS.items():
        own = F.to_json(F.struct(*[F.col(f) for f in fields if f in changes.columns]))
        payload = F.when(F.col("model") == name, own) if payload is None else payload.when(F.col("model") == name, own)
    clock = F.current_timestamp() if now is None else now
    return changes.withColumn("model", model).where("model is not null").select(F.col("seq").cast("long").alias("seq"), "model", payload.alias("payload"), F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss").alias("enqueued_at"), F.lit(0).alias("attempts"))


def scoped(changes: DataFrame, user_id: str, scenario_id: str | None = None) -> DataFrame:
    """changes stamped with their owner, whatever they say themselves. No model has a field for the project, so none is told."""
    return changes.withColumns({"user_id": F.lit(user_id), "scenario_id": F.lit(scenario_id).cast("string")})


def outcome(entries: DataFrame, failed, attempts: int = ATTEMPTS) -> DataFrame:
    """entries with status: sent, retry or dead. One of an unknown model is dead at once, one that fails for the last time too. In order: what comes after a retry waits."""
    bad = ~F.col("model").isin(*MODELS)
    tries = F.col("attempts") + F.when(failed, 1).otherwise(0)
    state = F.when(bad, "dead").when(failed & (tries >= attempts), "dead").when(failed, "retry").otherwise("sent")
    stated = entries.withColumn("_s", state)
    # the first retry blocks what comes after it: one number, so no order of all entries is needed
    first = stated.where("_s = 'retry'").agg(F.min("seq").alias("_first"))
    out = stated.crossJoin(F.broadcast(first)).withColumn("status", F.when(F.col("seq") > F.col("_first"), "waiting").otherwise(F.col("_s")))
    return out.withColumn("attempts", F.when(F.col("status").isin("retry", "dead") & ~bad, tries).otherwise(F.col("attempts"))).drop("_s", "_first")


def heads(entries: DataFrame, by: str) -> DataFrame:
    """The entry of each queue that is next: the one with the least seq."""
    return entries.groupBy(by).agg(F.min_by(F.struct(*[c for c in entries.columns if c != by]), "seq").alias("_e")).select(by, "_e.*")


def deliver(spark: SparkSession, source: str, sink: str, dead: str, checkpoint: str, publish: Callable[[dict], bool] | None = None, attempts: int = ATTEMPTS, pause: float = 5.0, poll: str | None = None, files: int = 1000) -> StreamingQuery:
    """Everything that is in the outbox folder goes to the topic folder in order, at least once; what fails `attempts` times, or is of an unknown model, to the dead letters. After a failure there is a pause of so many seconds. Without poll what is there is delivered and the query ends; with it ('1 second') the folder is watched. A batch takes `files` files at most, is delivered entry by entry, since strict order is the outbox's contract, and rewrites its own files if it is repeated after a failure."""

    def batch(df: DataFrame, number: int) -> None:
        def sending(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                lost, tries = [], []
                for e in pdf.to_dict("records"):
                    n = int(e["attempts"])
                    while e["model"] in MODELS and n < attempts and not (publish is None or publish(e)):
                        n += 1
                        if n < attempts:
                            time.sleep(pause)
                    lost.append(e["model"] not in MODELS or n >= attempts)
                    tries.append(n)
                yield pdf.assign(attempts=tries, lost=lost)

        # one task by contract: an entry may not overtake another; rows stream through it and none are held
        done = df.repartition(1).sortWithinPartitions("seq").mapInPandas(sending, f"{ENTRY}, lost boolean").persist()
        for lost, path in ((False, sink), (True, dead)):
            some = done.where(F.col("lost") == lost).drop("lost")
            if not some.isEmpty():
                some.write.mode("overwrite").json(f"{path}/batch={number}")
        done.unpersist()

    stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files).json(source)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()
    if not poll:
        query.awaitTermination()
    return query


class Waiting(StatefulProcessor):
    """By normalised name: links come in and are kept until a document of the name arrives, which drains them in order; later links to it wait for the next arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "raw string, source_node_id string, target_numbering string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.sort_values("seq").itertuples():
                if r.kind == "reference":
                    self.held.appendValue((r.raw, r.source_node_id, r.target_numbering))
                    continue
                found = [(key[0], r.doc_id, *x) for x in self.held.get()] if self.held.exists() else []
                self.held.clear()
                if found:
                    yield pd.DataFrame(found, columns=["target_key", "target_doc_id", "raw", "source_node_id", "target_numbering"])

    def close(self) -> None:
        pass


def linked(events: DataFrame) -> DataFrame:
    """A stream of (target_key, seq, kind, raw, source_node_id, target_numbering, doc_id) as links that found their document. Needs the RocksDB state store."""
    return events.groupBy("target_key").transformWithStateInPandas(Waiting(), "target_key string, target_doc_id string, raw string, source_node_id string, target_numbering string", "Append", "None")


def job_states(spark: SparkSession, source: str, schema: str, late: str = "1 day") -> DataFrame:
    """A stream of job events (job_id, status, ts) as each job's last state within the time to live."""
    return spark.readStream.schema(schema).parquet(source).withWatermark("ts", late).groupBy("job_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("updated_at"))
