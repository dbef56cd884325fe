"""Served HTML as nested element rows.

Spark partitions the pages; inside a task a page's markup becomes one array of
element structs.  Everything after that is DataFrame work on the array (or on
its explosion), so per-page rules need no shuffle.  The definition is the served
HTML: layout is not computed, and *visible* means not hidden by markup.
"""

from __future__ import annotations

import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructField, StructType

# the parser travels inside the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pages, and bytes of markup, that a task holds as parsed elements.
PAGES_AT_ONCE, MARKUP_AT_ONCE = 200, 1 << 20

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset("script style template noscript".split())
_FRAME = frozenset("html head body".split())
_BLOCK = frozenset(
    "address article aside blockquote body br dd details dialog div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li legend main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
# a start tag closes the open element of the second set unless one of the third lies between
_ROW = frozenset("tr td th".split())
_IMPLIED = {
    "a": (frozenset({"a"}), frozenset({"table", "td", "th", "button"})),
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (_ROW, frozenset({"table", "tbody", "thead", "tfoot"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot"}) | _ROW, frozenset({"table"})),
}
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
_P = (frozenset({"p"}), frozenset({"table", "td", "th", "button", "body"}))

_ANC = StructType([
    StructField("pos", IntegerType()), StructField("end", IntegerType()),
    StructField("tag", StringType()), StructField("role", StringType()),
])
NODE = StructType([
    StructField("pos", IntegerType()), StructField("parent", IntegerType()), StructField("end", IntegerType()),
    StructField("tag", StringType()), StructField("role", StringType()), StructField("nth", IntegerType()),
    StructField("same", IntegerType()), StructField("child", IntegerType()), StructField("visible", BooleanType()),
    StructField("attrs", MapType(StringType(), StringType())), StructField("anc", ArrayType(_ANC)),
    StructField("parts", ArrayType(StringType())), StructField("text", StringType()),
])
_ANC_ARROW = pa.struct([("pos", pa.int32()), ("end", pa.int32()), ("tag", pa.string()), ("role", pa.string())])
_NODE_ARROW = pa.struct([
    ("pos", pa.int32()), ("parent", pa.int32()), ("end", pa.int32()), ("tag", pa.string()), ("role", pa.string()),
    ("nth", pa.int32()), ("same", pa.int32()), ("child", pa.int32()), ("visible", pa.bool_()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("anc", pa.list_(_ANC_ARROW)), ("parts", pa.list_(pa.string())),
    ("text", pa.string()),
])


class _Tree(HTMLParser):
    """Element list of one document, with the span of text pieces under each element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.pieces: list[str] = []
        self.counts: dict = {}
        self.kids: dict = {}

    def _imply(self, closing, barrier) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.nodes[self.open[depth]]["tag"]
            if tag in closing:
                while len(self.open) > depth:
                    self._pop()
                return
            if tag in barrier:
                return

    def _pop(self) -> None:
        n = self.nodes[self.open.pop()]
        n["end"] = len(self.nodes) - 1
        if n["tag"] in _BLOCK:
            self.pieces.append(" ")
        n["t1"] = len(self.pieces)

    def handle_starttag(self, tag, attrs) -> None:
        if tag in _IMPLIED:
            closing, barrier = _IMPLIED[tag]
            while True:
                before = len(self.open)
                self._imply(closing, barrier)
                if len(self.open) == before:
                    break
        if tag in _CLOSES_P:
            self._imply(*_P)
        pos = len(self.nodes)
        parent = self.open[-1] if self.open else -1
        self.counts[parent, tag] = self.counts.get((parent, tag), 0) + 1
        self.kids[parent] = self.kids.get(parent, 0) + 1
        a = {k: (v if v is not None else "") for k, v in attrs}
        up = self.nodes[parent] if parent >= 0 else None
        shown = (up is None or up["visible"]) and "hidden" not in a and not (
            tag == "input" and a.get("type", "").lower() == "hidden"
        ) and "display:none" not in a.get("style", "").replace(" ", "").lower() and tag not in _SILENT
        if tag in _BLOCK:
            self.pieces.append(" ")
        self.nodes.append({
            "pos": pos, "parent": parent, "end": pos, "tag": tag, "role": a.get("role", "").lower(),
            "nth": self.counts[parent, tag], "child": self.kids[parent], "visible": shown, "attrs": a,
            "t0": len(self.pieces), "t1": len(self.pieces),
        })
        if tag not in _VOID:
            self.open.append(pos)

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._pop()

    def handle_endtag(self, tag) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[depth]]["tag"] == tag:
                while len(self.open) > depth:
                    self._pop()
                return

    def handle_data(self, data) -> None:
        if self.open and not self.nodes[self.open[-1]]["visible"] and self.nodes[self.open[-1]]["tag"] != "title":
            return
        self.pieces.append(data)

    def finish(self) -> None:
        self.close()
        while self.open:
            self._pop()


def parse_document(html: str, keep=None, texts=None) -> list[dict]:
    """Element structs of one page; ``keep`` and ``texts`` are sets of tags (None: all).

    An element with a role or an ``ondrop``, ``onclick`` or ``aria-`` attribute
    is kept whatever its tag.
    """
    t = _Tree()
    t.feed(html or "")
    t.finish()
    out = []
    for n in t.nodes:
        up = t.nodes[n["parent"]] if n["parent"] >= 0 else None
        same = t.counts[n["parent"], n["tag"]]
        part = n["tag"] if same == 1 or up is None else "%s:nth-of-type(%d)" % (n["tag"], n["nth"])
        n["same"] = same
        n["anc"] = up["anc"] + [{k: up[k] for k in ("pos", "end", "tag", "role")}] if up else []
        n["parts"] = (up["parts"] if up else []) + ([part] if n["tag"] not in _FRAME else [])
        marked = bool(n["role"]) or any(k in ("ondrop", "onclick") or k.startswith("aria-") for k in n["attrs"])
        if keep is not None and n["tag"] not in keep and not marked:
            continue
        want = n["tag"] not in _FRAME if texts is None else (n["tag"] in texts or marked)
        text = " ".join("".join(t.pieces[n["t0"]:n["t1"]]).split()) if want else ""
        out.append({k: n[k] for k in ("pos", "parent", "end", "tag", "role", "nth", "same", "child", "visible", "anc", "parts")}
                   | {"attrs": list(n["attrs"].items()), "text": text})
    return out


def parse_pages(pages: DataFrame, keep=None, texts=None) -> DataFrame:
    """(page_id, url, nodes): one row per page, elements nested in document order."""
    keep = frozenset(keep) if keep is not None else None
    texts = frozenset(texts) if texts is not None else None

    def run(batches):
        for batch in batches:
            html = batch.column("html")
            size = html.nbytes // max(len(html), 1) + 1
            # a parsed page is many times its markup: a few pages at a time, whatever an Arrow batch holds
            step = max(1, min(PAGES_AT_ONCE, MARKUP_AT_ONCE // size))
            for i in range(0, len(html), step):
                some = batch.slice(i, step)
                nodes = [parse_document(h, keep, texts) for h in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column("page_id"), some.column("url"), pa.array(nodes, type=pa.list_(_NODE_ARROW))],
                    names=["page_id", "url", "nodes"],
                )

    src = pages.select("page_id", "url", "html")
    fields = {f.name: f.dataType for f in src.schema.fields}
    out = StructType([
        StructField("page_id", fields["page_id"]), StructField("url", fields["url"]), StructField("nodes", ArrayType(NODE)),
    ])
    return src.mapInArrow(run, out)


def elements(dom: DataFrame) -> DataFrame:
    """One row per element."""
    return dom.select("page_id", "url", F.explode("nodes").alias("n")).select("page_id", "url", "n.*")


def has_ancestor(tags=(), roles=(), own: bool = True):
    """The element (or an ancestor) has one of the tags or roles."""
    test = F.exists("anc", lambda a: a["tag"].isin(list(tags)) | a["role"].isin(list(roles)))
    if own:
        test = test | F.col("tag").isin(list(tags)) | F.col("role").isin(list(roles))
    return test


def attr(name: str, col: str = "attrs"):
    return F.col(col)[name]


def has_attr(name: str):
    return F.map_contains_key("attrs", F.lit(name))
