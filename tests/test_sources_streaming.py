"""Readers of files, and the continuous processes."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from codexa.sources import files
from codexa.streaming import outbox


def docx() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:p/><w:p><w:pPr><w:pStyle w:val="ListBullet"/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files_as_blocks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "My_rules 2016.txt").write_text("one\ntwo\n\n three ")
    (tmp_path / "a.MD").write_text("# Head\ntext goes\non\n\n- item\n\n| a | b |\n|---|---|\n| 1 | 2 |")
    (tmp_path / "sub" / "p.html").write_text("<html><head><title>t</title></head><body><h1>Big</h1><p>some <b>bold</b></p><script>x</script><ul><li>li</li></ul><table><tr><td>1</td><td>2</td></tr></table></body></html>")
    (tmp_path / "d.docx").write_bytes(docx())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "x.exe").write_bytes(b"no")
    f = files.files(spark, str(tmp_path))
    names = {(r["name"], r["ext"], r["version"]) for r in f.collect()}
    assert names == {("My rules 2016", "txt", "2016"), ("a", "md", None), ("p", "html", None), ("d", "docx", None), ("bad", "docx", None)}
    got = {}
    for r in files.blocks(f).orderBy("block_idx").collect():
        got.setdefault(r["doc_id"].rpartition("/")[2].replace("%20", " "), []).append((r["text"], r["category"]))
    assert got["My_rules 2016.txt"] == [("one two", "NarrativeText"), ("three", "NarrativeText")]
    assert got["a.MD"] == [("Head", "Title"), ("text goes on", "NarrativeText"), ("item", "ListItem"), ("a b 1 2", "Table")]
    assert got["p.html"] == [("Big", "Title"), ("some bold", "NarrativeText"), ("li", "ListItem"), ("1 2", "Table")]
    assert got["d.docx"] == [("Title", "Title"), ("Some text", "NarrativeText"), ("item", "ListItem"), ("a b", "Table")] and got["bad.docx"] == [("", "Unreadable")]
    assert files.objects(f.unionAll(f)).count() == 5


def test_direct_documents_and_logs(spark, tmp_path):
    docs = [{"name": "ok", "version": "1", "metadata": {"a": "1"}, "fragments": [{"text": "x", "metadata": {"b": "2"}}, {"text": "y", "type": "clause"}]}, {"name": " ", "fragments": [{"text": "x"}]}, {"name": "none", "fragments": []}, {"name": "blank", "fragments": [{"text": " "}]}]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, docs)))
    good, bad = files.direct(spark, str(tmp_path / "d.json"))
    rows = good.orderBy("order").collect()
    assert [(r["name"], r["text"], r["type"], r["kind"], r["metadata"]) for r in rows] == [("ok", "x", "paragraph", "text", {"a": "1", "b": "2"}), ("ok", "y", "clause", "text", {"a": "1"})]
    assert {r["name"] for r in bad.collect()} == {" ", "none", "blank"}
    lines = [json.dumps({"timestamp": "2024-01-02T03:04:05", "level": "info", "logger": "app", "event": "hello", "request_id": "r1"}), "plain", json.dumps({"timestamp": "2024-01-03T00:00:00", "level": "error", "logger": "app", "event": "bad"})]
    (tmp_path / "log.txt").write_text("\n".join(lines))
    path = str(tmp_path / "log.txt")
    assert sorted(r["formatted"] for r in files.log_text(files.logs(spark, path)).collect()) == ["2024-01-02T03:04:05 [INFO] app: hello", "2024-01-03T00:00:00 [ERROR] app: bad", "plain"]
    assert files.logs(spark, path, day="2024-01-03").count() == 1 and files.logs(spark, path, request_id="r1").count() == 1


def entries(spark, rows, folder):
    spark.createDataFrame(rows, outbox.ENTRY).write.mode("append").json(str(folder))


def test_delivery(spark, tmp_path):
    source, sink, dead, mark = (str(tmp_path / x) for x in ("in", "out", "dead", "check"))
    entries(spark, [(2, "DocumentDeleted", "{}", "t", 0), (1, "DocumentProcessed", "{}", "t", 0), (3, "Unknown", "{}", "t", 0), (4, "DocumentUpdated", "fails", "t", 8)], source)
    for _ in range(2):  # delivered once, though started again
        outbox.deliver(spark, source, sink, dead, mark, publish=lambda e: e["payload"] != "fails", pause=0)
    sent = [r["seq"] for r in spark.read.schema(outbox.ENTRY).json(sink).collect()]
    lost = {r["seq"]: r["attempts"] for r in spark.read.schema(outbox.ENTRY).json(dead).collect()}
    assert sent == [1, 2] and lost == {3: 0, 4: 10}
    entries(spark, [(5, "DocumentUpdated", "{}", "t", 0)], source)
    outbox.deliver(spark, source, sink, dead, mark, pause=0)
    assert sorted(r["seq"] for r in spark.read.schema(outbox.ENTRY).json(sink).collect()) == [1, 2, 5]


def test_outcome_in_order(spark):
    e = spark.createDataFrame([(1, "DocumentProcessed", 0), (2, "Unknown", 0), (3, "DocumentUpdated", 0), (4, "DocumentDeleted", 0), (5, "DocumentDeleted", 9)], "seq long, model string, attempts int")
    got = {r["seq"]: (r["status"], r["attempts"]) for r in outbox.outcome(e, F.col("seq").isin(3, 5)).collect()}
    assert got == {1: ("sent", 0), 2: ("dead", 0), 3: ("retry", 1), 4: ("waiting", 0), 5: ("waiting", 9)}
    assert {r["status"] for r in outbox.outcome(e.where("seq = 5"), F.lit(True)).collect()} == {"dead"}


def test_links_wait_for_their_documents(spark, tmp_path):
    schema = "target_key string, seq long, kind string, raw string, source_node_id string, target_numbering string, doc_id string"
    rows = [("A", 1, "reference", "see A", "n1", "1", None), ("A", 2, "reference", "A too", "n2", "", None), ("B", 3, "reference", "B", "n3", "", None), ("A", 4, "document", None, None, None, "docA"), ("A", 5, "reference", "late", "n4", "", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = outbox.linked(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted((r["target_key"], r["target_doc_id"], r["raw"], r["source_node_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("A", "docA", "A too", "n2"), ("A", "docA", "see A", "n1")]


def test_job_states(spark, tmp_path):
    spark.createDataFrame([("j", "queued", "2024-01-01 00:00:00"), ("j", "done", "2024-01-01 00:05:00"), ("k", "queued", "2024-01-01 00:01:00")], "job_id string, status string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    q = outbox.job_states(spark, str(tmp_path / "in"), "job_id string, status string, ts timestamp").writeStream.format("memory").queryName("job_states_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["job_id"], r["status"]) for r in spark.table("job_states_test").collect()} == {("j", "done"), ("k", "queued")}
