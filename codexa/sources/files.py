"""Files as raw blocks: text, markdown, html and docx, by Spark's binary reader and standard parsers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOWED = ("docx", "htm", "html", "md", "txt")
BLOCKS = "doc_id string, block_idx int, text string, category string, html string"


class _Html(HTMLParser):
    """Headings, paragraphs and list items as blocks, a table as one block with its markup; scripts and styles are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, str | None]] = []
        self.text: list[str] = []
        self.kind, self.muted, self.table, self.markup = "NarrativeText", 0, 0, []

    def flush(self, kind: str = "NarrativeText") -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((text, self.kind, None))
        self.text, self.kind = [], kind

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style", "head"):
            self.muted += 1
        elif tag == "table":
            if not self.table:
                self.flush()
            self.table += 1
        elif not self.table and tag in ("p", "div", "li", "br", "article", "section", "nav", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.flush("Title" if tag[0] == "h" and tag[1:].isdigit() else "ListItem" if tag == "li" else "NarrativeText")
        if self.table:
            self.markup.append(f"<{tag}>")
            if tag in ("td", "th", "tr"):
                self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head"):
            self.muted = max(0, self.muted - 1)
        if self.table:
            self.markup.append(f"</{tag}>")
            if tag == "table":
                self.table -= 1
                if not self.table:
                    text = " ".join("".join(self.text).split())
                    if text:
                        self.blocks.append((text, "Table", "".join(self.markup)))
                    self.text, self.markup = [], []
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.muted:
            self.text.append(data)
            if self.table:
                self.markup.append(data)


def html_blocks(text: str) -> list[tuple[str, str, str | None]]:
    p = _Html()
    p.feed(text)
    p.close()
    p.flush()
    return p.blocks


def text_blocks(text: str) -> list[tuple[str, str, str | None]]:
    """A block for each run of lines between blank ones."""
    return [(" ".join(x.split()), "NarrativeText", None) for x in re.split(r"\n\s*\n", text) if x.strip()]


def markdown_blocks(text: str) -> list[tuple[str, str, str | None]]:
    out: list[tuple[str, str, str | None]] = []
    for part in re.split(r"\n\s*\n|(?=^#{1,6}\s)|(?<=\n)(?=[-*+]\s)", text, flags=re.M):
        x = part.strip()
        if not x:
            continue
        if m := re.match(r"#{1,6}\s+([^\n]*)", x):
            out.append((m[1].strip(), "Title", None))
            x = x[m.end() :].strip()
        if x.startswith("|"):
            rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in x.split("\n") if not re.fullmatch(r"[|\s:\-]+", line)]
            out.append((" ".join(" ".join(r) for r in rows), "Table", "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"))
        elif x:
            out.append((" ".join(re.sub(r"^[-*+]\s+", "", x).split()), "ListItem" if re.match(r"[-*+]\s", x) else "NarrativeText", None))
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(data: bytes) -> list[tuple[str, str, str | None]]:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    body, out = root.find(f"{_W}body"), []
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    for e in body if body is not None else []:
        if e.tag == f"{_W}p" and (text := words(e).strip()):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "").lower() if style is not None else ""
            out.append((text, "Title" if name.startswith(("heading", "title")) else "ListItem" if name.startswith("list") else "NarrativeText", None))
        elif e.tag == f"{_W}tbl":
            rows = [[words(c).strip() for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            if text := " ".join(" ".join(r) for r in rows).strip():
                out.append((text, "Table", "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"))
    return out


def parse(ext: str, data: bytes) -> list[tuple[str, str, str | None]]:
    if ext == "docx":
        return docx_blocks(data)
    text = data.decode("utf-8", errors="replace")
    return {"htm": html_blocks, "html": html_blocks, "md": markdown_blocks}.get(ext, text_blocks)(text)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, data in zip(pdf["path"], pdf["content"], strict=True):
            try:
                found = parse(path.rpartition(".")[2].lower(), bytes(data))
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                found = [("", "Unreadable", None)]
            rows += [(path, k, *b) for k, b in enumerate(found)]
        yield pd.DataFrame(rows, columns=["doc_id", "block_idx", "text", "category", "html"])


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, ext, name, version, content) of the files of the allowed kinds below a folder; the name is the stem with spaces, the version its first year."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*?)\.[^./]*$", 1), "_", " ")
    return found.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))).where(F.col("ext").isin(*ALLOWED)).select("path", "ext", stem.alias("name"), F.nullif(F.regexp_extract(stem, "(?:19|20)[0-9]{2}", 0), F.lit("")).alias("version"), "content")


def blocks(files_: DataFrame) -> DataFrame:
    return files_.select("path", "content").mapInPandas(_parsed, BLOCKS)


def objects(files_: DataFrame) -> DataFrame:
    """Originals by content: (key, content), the key being the hash and the extension."""
    return files_.select(F.concat(F.sha2("content", 256), F.lit("."), "ext").alias("key"), "content").dropDuplicates(["key"])


def html_text(html) -> F.Column:
    """A page's text by expressions alone: scripts, styles and comments out, tags as spaces, common entities decoded."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.btrim(F.regexp_replace(x, r"[ \t\n\r\f]+", " "))


def html_title(html) -> F.Column:
    return F.btrim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def direct(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(fragments, rejected) of JSON documents: name, version, external_ids, metadata and fragments; blank names, documents without fragments, and those with a blank one are rejected whole."""
    schema = "name string, version string, external_ids map<string,string>, metadata map<string,string>, fragments array<struct<text:string,type:string,kind:string,numbering:string,block:string,tags:array<string>,metadata:map<string,string>,table_html:string,parent_id:string>>"
    return direct_fragments(spark.read.schema(schema).json(path))


def direct_fragments(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    from codexa.functions.identity import merged, stripped

    good = (stripped(F.col("name")) != "") & (F.coalesce(F.size("fragments"), F.lit(0)) > 0) & F.forall(F.coalesce("fragments", F.array()), lambda f: stripped(f["text"]) != "")
    flagged = docs.withColumn("_ok", F.coalesce(good, F.lit(False)))
    hashed = F.sha2(F.array_join(F.transform("fragments", lambda f: f["text"]), "\n"), 256)
    out = flagged.where("_ok").withColumn("content_hash", hashed).select("name", "version", "external_ids", "content_hash", F.col("metadata").alias("_m"), F.posexplode("fragments").alias("order", "f"))
    out = out.select("name", "version", "external_ids", "content_hash", "order", F.sha2(F.concat_ws("|", "content_hash", "order"), 256).alias("id"), "f.text", F.coalesce("f.type", F.lit("paragraph")).alias("type"), F.coalesce("f.kind", F.lit("text")).alias("kind"), F.coalesce("f.numbering", F.lit("")).alias("numbering"), F.coalesce("f.block", F.lit("main")).alias("block"), F.coalesce("f.tags", F.array().cast("array<string>")).alias("tags"), "f.table_html", "f.parent_id", merged(F.col("_m"), F.col("f.metadata")).alias("metadata"))
    return out, flagged.where("not _ok").drop("_ok")


def logs(spark: SparkSession, path: str, day: str | None = None, request_id: str | None = None) -> DataFrame:
    """Log lines (timestamp, level, logger, event, request_id, line); lines that aren't JSON pass only if nothing is filtered."""
    return log_lines(spark.read.text(path).withColumnRenamed("value", "line"), day, request_id)


def log_lines(lines: DataFrame, day: str | None = None, request_id: str | None = None) -> DataFrame:
    """The same from a table (line); its other columns stay."""
    out = lines.select(F.from_json("line", "timestamp string, level string, logger string, event string, request_id string").alias("j"), "*").select("j.*", *lines.columns)
    if day is not None:
        out = out.where(F.col("timestamp").startswith(day))
    if request_id is not None:
        out = out.where(F.col("request_id") == request_id)
    return out


def log_text(entries: DataFrame) -> DataFrame:
    return entries.withColumn("formatted", F.when(F.col("timestamp").isNull(), F.col("line")).otherwise(F.concat_ws(" ", "timestamp", F.concat(F.lit("["), F.upper("level"), F.lit("]")), F.concat(F.col("logger"), F.lit(":")), "event")))
