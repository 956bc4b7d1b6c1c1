"""From raw blocks to a tree of nodes: segments, stitched parts, markup windows, hierarchy, grounding."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.functions.identity import numbering_rank, span_id, stripped
from codexa.functions.text import boundary_of, inline_split, numbered_head, segments
from codexa.providers import Markup, RuleMarkup

SKIPPED = ("Footer", "Header", "PageBreak")
WINDOW_CHARS, WINDOW_ITEMS, OVERLAP = 6000, 22, 3
AMENDMENTS = "Изменения к документу"


def raw_blocks(blocks: DataFrame, some: str = r"\S") -> DataFrame:
    """Extracted elements without page furniture and blank texts (without a match of `some`), renumbered."""
    kept = blocks.where(~F.col("category").isin(*SKIPPED) & F.col("text").rlike(some))
    return kept.withColumn("block_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_idx")) - 1)


def bounding_box(points: Column) -> Column:
    """[x0, y0, x1, y1] around an array of points."""
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.when(F.size(points) > 0, F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)))


def split_segments(blocks: DataFrame, sentences: bool = True, split: Callable[[Column], Column] = inline_split) -> DataFrame:
    """(doc_id, seg, src, text, category, html): a document's segments in order."""
    each = blocks.select("doc_id", "block_idx", "category", "html", F.posexplode(segments(F.col("text"), F.col("category"), sentences, split=split)).alias("_k", "text"))
    seg = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_idx", "_k")) - 1
    return each.select("doc_id", seg.alias("seg"), F.col("block_idx").alias("src"), "text", "category", F.when(F.col("category") == "Table", F.col("html")).alias("html"))


def boundaries(segs: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """segs with boundary: new or continuation; what the rule leaves open is decided by (doc_id, seg, decision), new by default."""
    w = Window.partitionBy("doc_id").orderBy("seg")
    own = segs.withColumn("_c", stripped(F.col("text")))
    before = own.withColumns({"_s": F.lag("seg").over(w), "_p": F.coalesce(F.lag("_c").over(w), F.lit("")), "_k": F.lag("category").over(w)})
    rule = F.when(F.col("_s").isNull(), "new").otherwise(boundary_of(F.col("_p"), F.col("_c"), F.col("_k"), F.col("category")))
    out = before.withColumn("boundary", rule).drop("_c", "_s", "_p", "_k")
    if decisions is None:
        return out.withColumn("boundary", F.when(F.col("boundary") == "uncertain", "new").otherwise(F.col("boundary")))
    d = decisions.select(F.col("doc_id").alias("_d"), F.col("seg").alias("_s"), "decision")
    out = out.join(d, (F.col("doc_id") == F.col("_d")) & (F.col("seg") == F.col("_s")), "left")
    return out.withColumn("boundary", F.when(F.col("boundary") == "uncertain", F.coalesce("decision", F.lit("new"))).otherwise(F.col("boundary"))).drop("_d", "_s", "decision")


def merge(segs: DataFrame, goes_on: Column) -> DataFrame:
    """(doc_id, part, text, category, html, src_ids): runs of segments of which the later ones go on from the one before."""
    w = Window.partitionBy("doc_id").orderBy("seg")
    run = F.sum(F.when(goes_on, 0).otherwise(1)).over(w)
    items = F.array_sort(F.collect_list(F.struct("seg", "text", "src", "category", "html")))
    out = segs.withColumn("_g", goes_on).withColumn("part", run - 1).groupBy("doc_id", "part").agg(items.alias("s"))
    return out.select("doc_id", F.col("part").cast("int").alias("part"), F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"), F.col("s")[0]["category"].alias("category"), F.col("s")[0]["html"].alias("html"), F.transform("s", lambda x: x["src"]).alias("src_ids"))


def parts_of(segs: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    return merge(boundaries(segs, decisions), F.col("boundary") == "continuation")


def semantic_merge(parts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Another pass over parts: one joins the part before by decision (doc_id, part, decision), never a table, after a table, or a part with its own number."""
    w = Window.partitionBy("doc_id").orderBy("part")
    d = decisions.select(F.col("doc_id").alias("_d"), F.col("part").alias("_p"), "decision")
    j = parts.join(d, (F.col("doc_id") == F.col("_d")) & (F.col("part") == F.col("_p")), "left").drop("_d", "_p")
    joins = (F.col("decision") == "continuation") & (F.col("category") != "Table") & (F.lag("category").over(w) != "Table") & ~numbered_head(F.col("text"))
    run = F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w)
    items = F.array_sort(F.collect_list(F.struct("part", "text", "category", "html", "src_ids")))
    out = j.withColumn("_run", run).groupBy("doc_id", "_run").agg(items.alias("s"))
    return out.select("doc_id", (F.col("_run") - 1).cast("int").alias("part"), F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"), F.col("s")[0]["category"].alias("category"), F.col("s")[0]["html"].alias("html"), F.flatten(F.transform("s", lambda x: x["src_ids"])).alias("src_ids"))


def windows_of(lengths: Sequence[int], most: int = WINDOW_CHARS, overlap: int = OVERLAP, items: int = 10**9) -> list[tuple[int, int]]:
    """Ranges of items that fit `most` characters (one item always does), each starting `overlap` items before the last one's end."""
    out, a, n = [], 0, len(lengths)
    while a < n:
        b, left = a + 1, most - lengths[a] - 1
        while b < n and b - a < items and lengths[b] <= left:
            left -= lengths[b] + 1
            b += 1
        out.append((a, b))
        if b == n:
            break
        a = max(b - overlap, a + 1)
    return out


def windows(parts: DataFrame, most: int = WINDOW_CHARS, overlap: int = OVERLAP, items: int = WINDOW_ITEMS, order: str = "part") -> DataFrame:
    """(doc_id, window, first, last): each document's windows over its parts, last excluded."""

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda xs: [{"first": a, "last": b} for a, b in windows_of([int(x) for x in xs], most, overlap, items)])

    lengths = F.transform(F.array_sort(F.collect_list(F.struct(order, F.length("text").alias("n")))), lambda x: x["n"])
    return parts.groupBy("doc_id").agg(lengths.alias("n")).select("doc_id", F.posexplode(cut("n")).alias("window", "w")).select("doc_id", "window", "w.*")


def reconcile(decisions: DataFrame) -> DataFrame:
    """(doc_id, window, first, pos, value) -> (doc_id, item, value): of an item's decisions that with most context before it, the earlier window's on a tie."""
    return decisions.groupBy("doc_id", (F.col("first") + F.col("pos")).alias("item")).agg(F.max_by("value", F.struct("pos", -F.col("window"))).alias("value"))


def tagged(parts: DataFrame, markup: Markup | None = None) -> DataFrame:
    """parts with type, numbering, relation, block and tags by a markup provider, a document at a time in windows; a part that the provider says nothing of is a paragraph deeper than the one before."""
    model = markup or RuleMarkup()

    def read(texts: list[str]) -> list[tuple]:
        best: dict[int, tuple] = {}
        for a, b in windows_of([len(t) for t in texts], items=WINDOW_ITEMS):
            try:
                found = model.tag(texts[a:b])
            except Exception:  # noqa: BLE001 - a window whose model fails is skipped, the others stand
                continue
            for pos, x in enumerate(found):
                if a + pos not in best or pos > best[a + pos][0]:
                    best[a + pos] = (pos, x)
        return [best[k][1] if k in best else ("paragraph", "", "deeper", "main", []) for k in range(len(texts))]

    @F.arrow_udf("array<struct<type:string,numbering:string,relation:string,block:string,tags:array<string>>>")
    def run(s: pa.Array) -> pa.Array:
        at, found = [0], ([], [], [], [], [])
        for xs in s:
            for x in read(xs.as_py()):
                for column, value in zip(found, x, strict=True):
                    column.append(value)
            at.append(len(found[0]))
        kinds = [pa.string()] * 4 + [pa.list_(pa.string())]
        each = pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(found, kinds, strict=True)], ["type", "numbering", "relation", "block", "tags"])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), each)

    base = ("part", "text", "category", "html", "src_ids")
    docs = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*base))).alias("ps"))
    each = docs.select("doc_id", F.explode(F.arrays_zip("ps", run(F.transform("ps", lambda x: F.coalesce(x["text"], F.lit("")))).alias("found"))).alias("z"))
    return each.select("doc_id", "z.ps.*", "z.found.*")


def depths(ranks: Sequence[int | None], relations: Sequence[str]) -> tuple[list[int], list[int]]:
    """(parent, depth) of each part, parent 0 being the root and part k being k + 1. A rank, or else the relation to the part before, names a level; the part goes below the nearest open part of a lower level, and its depth is that one's and 1."""
    open_, level = [0], {0: 0}
    parent, depth = [], [0]
    for k, (rank, relation) in enumerate(zip(ranks, relations, strict=True), 1):
        top = level[open_[-1]]
        want = max(1, rank if rank is not None else {"top": 1, "deeper": top + 1, "shallower": top - 1}.get(relation, top))
        while len(open_) > 1 and level[open_[-1]] >= want:
            open_.pop()
        parent.append(open_[-1])
        level[k] = level[open_[-1]] + 1
        depth.append(level[k])
        open_.append(k)
    return parent, depth[1:]


def flattened(children: dict[int, list[int]], root: int = 0) -> list[tuple[int, int | None, int]]:
    """(node, parent, depth) in reading order."""
    out, todo = [], [(root, None, 0)]
    while todo:
        node, parent, depth = todo.pop()
        out.append((node, parent, depth))
        todo += [(c, node, depth + 1) for c in reversed(children.get(node, []))]
    return out


def flatten_unnumbered(children: dict[int, list[int]], ranked: Sequence[bool], most: int = 1) -> dict[int, list[int]]:
    """Unnumbered nodes below `most` unnumbered ones move up with all that is below them, after their numbered siblings and in reading order."""
    new = {k: list(v) for k, v in children.items()}
    todo = [(0, 0)]
    while todo:
        node, run = todo.pop()
        stay, moved = [], []
        for c in new.get(node, []):
            if ranked[c] or run < most:
                stay.append(c)
                todo.append((c, 0 if ranked[c] else run + 1))
            else:
                moved += [x for x, _, _ in flattened(new, c)]
        for x in moved:
            new[x] = []
        new[node] = stay + moved
    return new


def shape(ranks: Sequence[int | None], relations: Sequence[str], blocks: Sequence[str], most: int = 1) -> tuple[list[tuple[int, int | None, int]], dict[int, list[int]]]:
    """(node, parent, depth) in reading order, and the children: 0 is the root, k + 1 part k, what is beyond the parts a container of amendments."""
    parent, _ = depths(ranks, relations)
    children: dict[int, list[int]] = {}
    for k, p in enumerate(parent, 1):
        children.setdefault(p, []).append(k)
    children = flatten_unnumbered(children, [True, *[r is not None for r in ranks]], most)
    # runs of two or more amendments at the top go into a container
    top, grouped, k = children.get(0, []), [], 0
    extra = len(blocks) + 1
    while k < len(top):
        j = k
        while j < len(top) and blocks[top[j] - 1] == "amendment":
            j += 1
        if j - k >= 2:
            children[extra] = top[k:j]
            grouped.append(extra)
            extra += 1
        else:
            grouped += top[k : max(j, k + 1)]
        k = max(j, k + 1)
    children[0] = grouped
    return flattened(children), children


LINKS = ("order", "id", "depth", "parent_id", "parent_text", "breadcrumb", "child_ids", "prev_id", "next_id")


def links(doc, order: list[tuple[int, int | None, int]], children: dict[int, list[int]], numberings: Sequence[str | None], text: Callable[[int], str], title: str = "document") -> tuple[list, ...]:
    """The columns LINKS of a document's nodes. text: a part's text, or enough of it for its first 300 characters and its label."""
    n, total = len(numberings), len(order)
    ident = [hashlib.sha256(f"{doc}|{i}".encode()).hexdigest()[:32] for i in range(total)]
    of = {node: ident[i] for i, (node, _, _) in enumerate(order)}
    # a crumb is a link to the one above, so that a chain of thousands doesn't make a quadratic number of labels before they are cut
    trail: dict[int, str] = {0: ""}
    below: dict[int, tuple[str, str]] = {}  # of a node with children the text and the breadcrumb that they show
    texts, crumbs = [], []
    for node, p, _ in order:
        if p is None:
            texts.append(None)
        else:
            if p not in below:
                t = title if p == 0 else AMENDMENTS if p > n else text(p - 1)
                label = f"{(numberings[p - 1] if 0 < p <= n else '') or ''} {t}".strip()[:60]
                below[p] = t[:300], f"{trail[p]} / {label}" if trail[p] else label
            t, trail[node] = below[p]
            texts.append(t)
        crumbs.append(trail[node])
    parents = [None if p is None else of[p] for _, p, _ in order]
    return list(range(total)), ident, [d for _, _, d in order], parents, texts, crumbs, [[of[c] for c in children.get(node, [])] for node, _, _ in order], [None, *ident[:-1]], [*ident[1:], None]


def tree(doc, parts: list[dict], title: str = "document", most: int = 1) -> list[dict]:
    """A document's parts (text, numbering, rank, relation, block, type, category, html, src_ids, tags, in order) as nodes in reading order, root first."""
    order, children = shape([p["rank"] for p in parts], [p["relation"] for p in parts], [p["block"] for p in parts], most)
    found = links(doc, order, children, [p["numbering"] for p in parts], lambda k: parts[k]["text"], title)
    rows = []
    for (n, _, _), link in zip(order, zip(*found, strict=True), strict=True):
        own = {"text": title, "type": "document", "block": "main"} if n == 0 else {"text": AMENDMENTS, "type": "amendment", "block": "amendment"} if n > len(parts) else parts[n - 1]
        table = own.get("category") == "Table"
        rows.append({"doc_id": doc, "text": own["text"], "type": own["type"], "kind": "table" if table else "text", "table_html": own["html"] if table else None, "numbering": own.get("numbering") or "", "block": own["block"], "src_ids": own.get("src_ids") or [], "tags": own.get("tags") or []} | dict(zip(LINKS, link, strict=True)))
    return rows


def _nodes(docs: pa.RecordBatch, most: int) -> pa.RecordBatch:
    """(doc, parts) -> the nodes of all its documents. What a part brings is taken over without leaving Arrow."""
    values, at = docs.column(1).flatten(), [0, *np.cumsum(docs.column(1).value_lengths().to_numpy(zero_copy_only=False)).tolist()]
    part = {c: pc.struct_field(values, c) for c in ("text", "category", "html", "src_ids", "type", "numbering", "relation", "block", "tags", "rank")}
    rank, relation, block, numbering = (part[c].to_pylist() for c in ("rank", "relation", "block", "numbering"))
    heads = pc.utf8_slice_codeunits(part["text"], 0, 300).to_pylist()
    doc, taken, found = [], [], tuple([] for _ in LINKS)
    for k, name in enumerate(docs.column(0).to_pylist()):
        lo, hi = at[k], at[k + 1]

        def text(i: int, lo: int = lo) -> str:
            head = heads[lo + i]
            return head if len(head) < 300 or len(head.strip()) >= 60 else part["text"][lo + i].as_py()

        order, children = shape(rank[lo:hi], relation[lo:hi], block[lo:hi], most)
        for column, new in zip(found, links(name, order, children, numbering[lo:hi], text), strict=True):
            column += new
        doc += [k] * len(order)
        # the root and the containers come after all parts
        taken += [at[-1] if n == 0 else lo + n - 1 if n <= hi - lo else at[-1] + 1 for n, _, _ in order]
    taken = pa.array(taken, pa.int64())
    kinds = dict(_NODE)

    def own(c: str, root, container) -> pa.Array:
        kind = kinds.get(c, pa.string())
        return pa.concat_arrays([part[c].cast(kind), pa.array([root, container], kind)]).take(taken)

    def listed(c: str) -> pa.Array:
        x = own(c, [], [])
        return pa.array([y or [] for y in x.to_pylist()], kinds[c]) if x.null_count else x

    table = pc.fill_null(pc.equal(own("category", None, None), "Table"), False)
    out = dict(zip(LINKS, found, strict=True)) | {
        "text": own("text", "document", AMENDMENTS), "type": own("type", "document", "amendment"), "kind": pc.if_else(table, "table", "text"), "table_html": pc.if_else(table, own("html", None, None), pa.scalar(None, pa.string())) if len(taken) else pa.array([], pa.string()),
        "numbering": pc.fill_null(own("numbering", "", ""), ""), "block": own("block", "main", "amendment"), "src_ids": listed("src_ids"), "tags": listed("tags"),
    }
    schema = pa.schema([docs.schema.field(0), *_NODE])
    return pa.RecordBatch.from_arrays([docs.column(0).take(pa.array(doc, pa.int64())), *[x if isinstance(x := out[c], pa.Array) else pa.array(x, kind) for c, kind in _NODE]], schema=schema)


_STRINGS, _INTS = pa.list_(pa.string()), pa.list_(pa.int32())
_NODE = [("order", pa.int32()), ("id", pa.string()), ("text", pa.string()), ("type", pa.string()), ("kind", pa.string()), ("table_html", pa.string()), ("numbering", pa.string()), ("block", pa.string()), ("depth", pa.int32()), ("src_ids", _INTS), ("tags", _STRINGS), ("parent_id", pa.string()), ("parent_text", pa.string()), ("breadcrumb", pa.string()), ("child_ids", _STRINGS), ("prev_id", pa.string()), ("next_id", pa.string())]
NODES = "doc_id {id}, order int, id string, text string, type string, kind string, table_html string, numbering string, block string, depth int, src_ids array<int>, tags array<string>, parent_id string, parent_text string, breadcrumb string, child_ids array<string>, prev_id string, next_id string"


def hierarchy(parts: DataFrame, most: int = 1) -> DataFrame:
    """Tagged parts -> flat nodes. The rank is that of the part's number. A document is one row of the input to Python, and a batch holds many."""
    fields = ("part", "text", "category", "html", "src_ids", "type", "numbering", "relation", "block", "tags", "rank")
    ranked = parts.withColumn("rank", numbering_rank(F.col("numbering"))).withColumn("text", F.coalesce("text", F.lit("")))
    docs = ranked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                yield _nodes(batch.slice(lo, 64), most)

    return docs.mapInArrow(run, NODES.format(id=dict(ranked.dtypes)["doc_id"]))


def depths_sql(ranks: Column) -> Column:
    """Depths from an array of ranks, without Python: the open levels are carried as an array, and those at or above the rank drop out."""
    state = "struct<open:array<int>,depths:array<int>>"
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<int>").alias("depths")).cast(state)

    def step(acc: Column, rank: Column) -> Column:
        left = F.filter(acc["open"], lambda z: z < F.greatest(F.lit(1), rank))
        d = (F.size(left) + 1).cast("int")
        return F.struct(F.concat(left, F.array(d)).alias("open"), F.concat(acc["depths"], F.array(d)).alias("depths")).cast(state)

    return F.aggregate(ranks, start, step, lambda acc: acc["depths"])


def source_spans(blocks: DataFrame, order: str = "block_idx") -> DataFrame:
    """blocks with the characters [start, end) they take in the document's text, one a line."""
    w = Window.partitionBy("doc_id").orderBy(order)
    end = F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return blocks.withColumns({"start": (end - F.length("text")).cast("int"), "end": end.cast("int")})


def grounded(nodes: DataFrame, spans: DataFrame, src: str = "src_ids") -> DataFrame:
    """nodes with char_start, char_end, page_start, page_end, bbox and span_id, over the blocks they come from; unknown blocks don't count."""
    s = spans.select(F.col("doc_id").alias("_d"), F.col("block_idx").alias("_b"), "start", "end", *[F.col(c) if c in spans.columns else F.lit(None).cast(t).alias(c) for c, t in (("page", "int"), ("bbox", "array<double>"))])
    each = nodes.select("doc_id", "id", F.posexplode(src).alias("_k", "_src")).join(s, (F.col("doc_id") == F.col("_d")) & (F.col("_src") == F.col("_b")))
    found = each.groupBy(F.col("id").alias("_id")).agg(F.min("start").alias("char_start"), F.max("end").alias("char_end"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.min_by("bbox", F.when(F.col("bbox").isNotNull(), F.col("_k"))).alias("bbox"))
    return nodes.drop("char_start", "char_end", "page_start", "page_end", "bbox", "span_id").join(found, F.col("id") == F.col("_id"), "left").drop("_id").withColumn("span_id", span_id(F.col("doc_id").cast("string"), F.col("char_start"), F.col("char_end")))
