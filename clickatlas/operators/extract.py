"""Links, controls, forms and content collections of parsed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import labels, urls
from ..session import cut
from .dom import attr, elements, has_ancestor, has_attr, parse_pages
from .rows import first_by, top_n

#: What comes out of the parser is many times the scan that Spark judges sizes by: joins of it are sorted, never broadcast.
_SORTED = "merge"

_LINK = r"(?is)<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)')([^>]*)>(.*?)</a\s*>"


def _entities(c: Column) -> Column:
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


_HIDES = r"(?is)<(script|style|textarea|title|template|noscript|xmp|iframe)\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)"
_INLINE = r"(?i)<(?!/?(?:a|b|i|u|em|strong|span|small)[\s>])"


def _plain_markup(matches: Column) -> Column:
    """Whether the pattern finds all links of a page just as a parser does.

    That is so if every ``<a`` of the page is part of a match, none stands in a
    comment or raw text, and the matches hold inline tags and the six entities
    only, and no second ``<a``.
    """
    opens = lambda c: F.regexp_count(c, F.lit(r"(?i)<a(?=[\s/>])"))
    bare = F.regexp_replace("html", _HIDES, "")
    odd = F.exists(
        matches,
        lambda m: (opens(m) > 1) | m.rlike(r"&(?!(?:lt|gt|quot|nbsp|amp|#39);)[#a-zA-Z]") | F.regexp_replace(m, r"^<[^>]*>", "").rlike(_INLINE),
    )
    return (opens(F.col("html")) == F.size(matches)) & (opens(bare) == F.size(matches)) & ~odd


def extract_links(pages: DataFrame) -> DataFrame:
    """Links of each page, first per absolute href.

    Pages whose links are plain markup are read by pattern, without Python; all
    others by the parser.  Both give the same links.
    """
    matches = F.regexp_extract_all("html", F.lit(_LINK), F.lit(0))
    found = pages.select("page_id", "url", "html", matches.alias("ms")).withColumn("plain", _plain_markup(F.col("ms")))
    parsed = extract_links_dom(parse_pages(found.where(~F.coalesce("plain", F.lit(True))).select("page_id", "url", "html"), keep=["a"], texts=["a"]))
    return _links_by_pattern(found.where("plain")).unionByName(parsed)


def _links_by_pattern(found: DataFrame) -> DataFrame:
    raw = found.select("page_id", "url", F.posexplode("ms").alias("link_seq", "m"))
    part = lambda i: F.regexp_extract("m", _LINK, i)
    href = urls.resolve("url", _entities(F.concat(part(1), part(2))))
    text = labels.collapse(_entities(F.regexp_replace(part(4), r"<[^>]*>", "")))
    rows = raw.select(
        "page_id", F.col("url").alias("page_url"), "link_seq", href.alias("href"),
        F.substring(text, 1, K.LINK_TEXT).alias("text"),
        F.regexp_extract("m", r"(?is)^<a\b([^>]*)>", 1).rlike(r"(?i)\sdownload(\s|=|$)").alias("marked"),
    ).where(F.col("href") != "")
    return _link_rows(rows)


def extract_links_dom(dom: DataFrame) -> DataFrame:
    n = elements(dom).where((F.col("tag") == "a") & has_attr("href"))
    text = _control_text("a")
    rows = n.select(
        "page_id", F.col("url").alias("page_url"), F.col("pos").alias("link_seq"),
        urls.resolve("url", attr("href")).alias("href"), F.substring(text, 1, K.LINK_TEXT).alias("text"),
        has_attr("download").alias("marked"),
    ).where(F.col("href") != "")
    return _link_rows(rows)


def _link_rows(rows: DataFrame) -> DataFrame:
    first = first_by(rows, ["page_id", "href"], ["link_seq"], ["page_url", "link_seq", "text", "marked"])
    down = F.col("marked") | urls.is_direct_download("href")
    return first.select(
        "page_id", "page_url", "link_seq", "href", "text", down.alias("download"),
        F.when(down, "direct").alias("dl_kind"),
    )


def _css_escape(c: Column) -> Column:
    c = F.regexp_replace(c, r"([^a-zA-Z0-9_\-\x{0080}-\x{10FFFF}])", r"\\$1")
    return F.regexp_replace(c, r"^([0-9])", r"\\3$1 ")


def stable_selector(levels: int = 10, only_stable_ids: bool = True) -> Column:
    """``#id`` unless a framework minted it, else the nth-of-type path of the last levels."""
    el_id = F.coalesce(attr("id"), F.lit(""))
    usable = el_id != ""
    if only_stable_ids:
        usable = usable & ~el_id.contains(":") & ~el_id.rlike(K.GENERATED_ID)
    escaped = _css_escape(el_id)
    path = F.when(F.size("parts") > levels, F.slice("parts", -levels, levels)).otherwise(F.col("parts"))
    return F.when(usable, F.concat(F.lit("#"), escaped)).otherwise(F.array_join(path, ">"))


def _control_text(kind: str) -> Column:
    opts = [F.nullif(F.col("text"), F.lit(""))]
    if kind in ("a", "action"):
        opts += [F.nullif(attr("value"), F.lit("")), F.nullif(attr("aria-label"), F.lit("")),
                 F.nullif(attr("title"), F.lit("")), F.nullif(attr("alt"), F.lit(""))]
    elif kind == "query":
        opts += [F.nullif(attr("aria-label"), F.lit("")), F.nullif(attr("value"), F.lit(""))]
    else:
        opts += [F.nullif(attr("aria-label"), F.lit(""))]
    return labels.collapse(F.coalesce(*opts, F.lit("")))


_CONTROL_TAGS = ("a", "button", "summary", "input", "label")


def controls_dom(pages: DataFrame) -> DataFrame:
    """Pages parsed for their controls only: other elements leave the parser as ancestry."""
    return parse_pages(pages, keep=_CONTROL_TAGS, texts=_CONTROL_TAGS)


def extract_controls(dom: DataFrame, limit: int = K.CONTROLS_PER_PAGE) -> DataFrame:
    """Links, buttons, tabs and menu items outside tables, at most ``limit`` per page."""
    roles = ["button", "tab", "menuitem", "link"]
    n = elements(dom).where(
        ((F.col("tag") == "a") & has_attr("href")) | F.col("tag").isin("button", "summary") | F.col("role").isin(roles)
    )
    n = n.where(F.col("visible") & ~has_attr("disabled") & ~has_ancestor(K.CONTROL_BULK_TAGS, K.CONTROL_BULK_ROLES))
    nav = (
        F.col("role").isin("tab", "menuitem", "link") | has_attr("aria-haspopup") | has_attr("aria-controls")
        | has_ancestor(K.NAV_CONTAINER_TAGS, K.NAV_CONTAINER_ROLES)
    )
    rows = n.select(
        "page_id", "pos", stable_selector(10).alias("selector"),
        F.substring(_control_text("control"), 1, K.CONTROL_TEXT).alias("text"), "tag", "role",
        F.when((F.col("tag") == "a") & has_attr("href"), urls.resolve("url", attr("href"))).alias("href"), nav.alias("nav"),
    )
    # the first element of a selector speaks for it, even when it has no text
    rows = first_by(rows, ["page_id", "selector"], ["pos"]).where(F.col("text") != "")
    return top_n(rows, ["page_id"], ["pos"], limit, rank="ctrl_seq").withColumn("bulk", F.lit(False))


def extract_actions(dom: DataFrame) -> DataFrame:
    """Click targets with bulk ones kept and flagged, uploads and downloads marked."""
    roles = ["button", "tab", "menuitem"]
    kind = F.lower(F.coalesce(attr("type"), F.lit("")))
    is_file = (F.col("tag") == "input") & (kind == "file")
    is_action = (
        F.col("tag").isin("button", "summary") | F.col("role").isin(roles)
        | ((F.col("tag") == "input") & kind.isin("submit", "button", "file"))
        | has_attr("onclick") | has_attr("ondrop")
    )
    # file inputs and file links under each element, found inside the page's own array
    nested = (
        lambda n: (n["tag"] == "input")
        & (F.lower(F.coalesce(n["attrs"]["type"], F.lit(""))) == "file")
    )
    page = dom.select(
        "page_id", "url", "nodes", F.filter("nodes", nested).alias("files"),
        F.filter("nodes", lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], F.lit("href"))).alias("anchors"),
    )
    n = page.select("page_id", "url", "files", "anchors", F.explode("nodes").alias("n")).select(
        "page_id", "url", "files", "anchors", "n.*"
    ).where(is_action & F.col("visible") & ~has_attr("disabled"))
    under = lambda x: (x["pos"] > F.col("pos")) & (x["pos"] <= F.col("end"))
    file_in = F.try_element_at(F.filter("files", under), F.lit(1))
    link_in = F.try_element_at(F.filter("anchors", under), F.lit(1))
    n = n.withColumn("file_in", file_in).withColumn("link_in", link_in)
    anchor_href = F.when((F.col("tag") == "a") & has_attr("href"), attr("href")).otherwise(F.col("link_in")["attrs"]["href"])
    anchor_marked = F.when(F.col("tag") == "a", has_attr("download")).otherwise(
        F.map_contains_key(F.col("link_in")["attrs"], F.lit("download"))
    )
    abs_href = urls.resolve("url", anchor_href)
    direct = F.coalesce(anchor_marked, F.lit(False)) | (anchor_href.isNotNull() & urls.is_direct_download(abs_href))
    text = F.substring(_control_text("action"), 1, K.LINK_TEXT)
    upload = is_file | has_attr("ondrop") | F.col("file_in").isNotNull()
    verb = ~upload & text.rlike(K.DOWNLOAD_LABEL)
    nav = (
        F.col("role").isin("tab", "menuitem") | has_attr("aria-haspopup") | has_attr("aria-controls")
        | has_attr("aria-expanded") | has_ancestor(K.NAV_CONTAINER_TAGS, K.NAV_CONTAINER_ROLES)
    )
    accept = F.when(is_file, F.nullif(attr("accept"), F.lit(""))).otherwise(F.nullif(F.col("file_in")["attrs"]["accept"], F.lit("")))
    rows = n.select(
        "page_id", "pos", stable_selector(9, only_stable_ids=False).alias("selector"),
        F.when((text == "") & upload, "Upload file").otherwise(text).alias("text"), "tag", nav.alias("nav"),
        has_ancestor(K.ACTION_BULK_TAGS, K.ACTION_BULK_ROLES).alias("bulk"), upload.alias("upload"), accept.alias("accept"),
        (direct | verb).alias("download"), F.when(direct, "direct").when(verb, "js").alias("dl_kind"),
        F.when(direct & anchor_href.isNotNull(), abs_href).alias("dl_href"),
    )
    return first_by(rows, ["page_id", "selector"], ["pos"])


def upload_affordances(dom: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions completed by the file inputs they did not show.

    A hidden file input belongs to its nearest label, button or drop zone (else
    to itself).  An action already listed under that selector is upgraded in
    place; otherwise the affordance is added after the listed ones.
    """
    kind = F.lower(F.coalesce(attr("type"), F.lit("")))
    page = dom.select("page_id", "url", "nodes", F.explode("nodes").alias("n")).select("page_id", "url", "nodes", "n.*")
    files = page.where((F.col("tag") == "input") & (kind == "file"))
    near = F.filter(
        "nodes",
        lambda x: (x["pos"] < F.col("pos")) & (x["end"] >= F.col("pos"))
        & (x["tag"].isin("label", "button") | (x["role"] == "button") | F.map_contains_key(x["attrs"], F.lit("ondrop")))
        & x["visible"],
    )
    holder = F.when(F.size(near) > 0, F.try_element_at(near, F.lit(-1)))
    files = files.select(
        "page_id", "url", F.col("pos").alias("in_pos"), F.nullif(attr("accept"), F.lit("")).alias("in_accept"),
        stable_selector(9, only_stable_ids=False).alias("in_selector"),
        F.coalesce(holder, F.struct(*[F.col(c) for c in _node_fields()])).alias("h"),
    )
    files = files.select("page_id", "in_pos", "in_accept", "in_selector", "h.*")
    cand = files.select(
        "page_id", "in_pos", "in_accept", "in_selector", F.col("pos"),
        stable_selector(9, only_stable_ids=False).alias("selector"),
        F.substring(_control_text("action"), 1, K.LINK_TEXT).alias("text"), "tag",
        has_ancestor(K.ACTION_BULK_TAGS, K.ACTION_BULK_ROLES).alias("bulk"),
    )
    listed = actions.select("page_id", F.col("selector").alias("in_selector"), F.lit(True).alias("seen"))
    cand = cand.join(listed.hint(_SORTED), ["page_id", "in_selector"], "left")
    target = cand.select(
        "page_id", "in_pos", "in_accept", F.when(F.col("seen"), F.col("in_selector")).otherwise(F.col("selector")).alias("selector"),
        "pos", "text", "tag", "bulk",
    )
    per = first_by(target, ["page_id", "selector"], ["in_pos"], ["in_pos", "in_accept", "pos", "text", "tag", "bulk"])
    a, p = actions.alias("a"), per.alias("p")
    both = a.join(p.hint(_SORTED), ["page_id", "selector"], "full")
    new = F.col("a.pos").isNull()
    return both.select(
        "page_id", F.coalesce("a.pos", F.col("p.in_pos") + 1_000_000_000).alias("pos"), "selector",
        F.when(new, F.when(F.col("p.text") == "", "Upload file").otherwise(F.col("p.text"))).otherwise(F.col("a.text")).alias("text"),
        F.coalesce("a.tag", "p.tag").alias("tag"), F.coalesce("a.nav", F.lit(False)).alias("nav"),
        F.coalesce("a.bulk", "p.bulk").alias("bulk"),
        (F.coalesce("a.upload", F.lit(False)) | F.col("p.in_pos").isNotNull()).alias("upload"),
        F.coalesce("a.accept", "p.in_accept").alias("accept"),
        F.coalesce("a.download", F.lit(False)).alias("download"), "a.dl_kind", "a.dl_href",
    )


def _node_fields() -> list[str]:
    return ["pos", "parent", "end", "tag", "role", "nth", "same", "child", "visible", "attrs", "anc", "parts", "text"]


def query_controls(
    dom: DataFrame, kind: str | None = None, label: str | None = None, root: str | None = None, limit: int = K.QUERY_LIMIT
) -> DataFrame:
    """Controls filtered by structural kind, label pattern and a root ``#id`` or tag."""
    typ = F.lower(F.coalesce(attr("type"), F.lit("")))
    page = dom.withColumn("anchors", F.filter("nodes", lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], F.lit("href"))))
    if root:
        hit = (
            (lambda n: n["attrs"]["id"] == root[1:]) if root.startswith("#") else (lambda n: n["tag"] == root)
        )
        page = page.withColumn("root", F.try_element_at(F.filter("nodes", hit), F.lit(1))).where(F.col("root").isNotNull())
    else:
        page = page.withColumn("root", F.lit(None).cast("struct<pos:int,end:int>"))
    n = page.select("page_id", "url", "anchors", "root", F.explode("nodes").alias("n")).select(
        "page_id", "url", "anchors", "root", "n.*"
    )
    n = n.where(
        ((F.col("tag") == "a") & has_attr("href")) | F.col("tag").isin("button", "summary")
        | F.col("role").isin("button", "link", "menuitem") | ((F.col("tag") == "input") & typ.isin("submit", "button"))
    )
    n = n.where(F.col("visible") & ~has_attr("disabled") & (F.coalesce(attr("aria-disabled"), F.lit("")) != "true"))
    if root:
        n = n.where((F.col("pos") > F.col("root.pos")) & (F.col("pos") <= F.col("root.end")))
    around = F.filter("anchors", lambda x: (x["pos"] < F.col("pos")) & (x["end"] >= F.col("pos")))
    inside = F.filter("anchors", lambda x: (x["pos"] > F.col("pos")) & (x["pos"] <= F.col("end")))
    anchor = F.when(
        (F.col("tag") == "a"), F.struct(F.col("attrs").alias("attrs"))
    ).when(F.size(around) > 0, F.struct(F.try_element_at(around, F.lit(-1))["attrs"].alias("attrs"))).otherwise(
        F.when(F.size(inside) > 0, F.struct(F.try_element_at(inside, F.lit(1))["attrs"].alias("attrs")))
    )
    n = n.withColumn("anchor", anchor)
    href = urls.resolve("url", F.col("anchor")["attrs"]["href"])
    text = F.substring(_control_text("query"), 1, K.QUERY_TEXT)
    direct = F.coalesce(
        F.map_contains_key(F.col("anchor")["attrs"], F.lit("download")) | urls.is_direct_download(href), F.lit(False)
    ) & F.col("anchor").isNotNull()
    is_dl = direct | text.rlike(K.DOWNLOAD_LABEL)
    k = F.when(is_dl, "download").when(F.col("anchor").isNotNull(), "link").otherwise("button")
    rows = n.select(
        "page_id", "pos", stable_selector(10).alias("selector"), text.alias("text"), k.alias("kind"),
        F.when(direct, href).alias("href"), F.when(direct, "direct").when(is_dl, "js").alias("dl_kind"),
    )
    if kind:
        rows = rows.where(F.col("kind") == kind.lower())
    if label:
        rows = rows.where(F.col("text").rlike("(?iuU)" + label))
    return top_n(first_by(rows, ["page_id", "selector"], ["pos"]), ["page_id"], ["pos"], limit, rank="ctrl_seq")


# --- forms ---------------------------------------------------------------------------

def _clean(c: Column) -> Column:
    return labels.collapse(c)


def _type_of(f: Column) -> Column:
    role, pop = f["role"], F.lower(F.coalesce(f["attrs"]["aria-haspopup"], F.lit("")))
    return (
        F.when(f["tag"] == "input", F.coalesce(F.nullif(f["attrs"]["type"], F.lit("")), F.lit("text")))
        .when(f["tag"] == "select", "select")
        .when(f["tag"] == "textarea", "textarea")
        .when(role.isin("combobox", "listbox") | (pop == "listbox"), "dropdown")
        .when(role == "radiogroup", "radiogroup")
        .when(role == "switch", "toggle")
        .when(role == "checkbox", "checkbox")
        .when(role == "radio", "radio")
        .when(f["attrs"]["contenteditable"] == "true", "text")
        .otherwise("control")
    )


def _inside(x: Column, span: Column) -> Column:
    return (x["pos"] > span["pos"]) & (x["pos"] <= span["end"])


def _label_of_field(f: Column) -> Column:
    """The first label rule that gives text, in the order a reader would look."""
    blank = F.lit("")
    by_for = F.try_element_at(
        F.filter("label_nodes", lambda x: (x["tag"] == "label") & (x["attrs"]["for"] == f["attrs"]["id"])), F.lit(1)
    )
    around = F.filter("label_nodes", lambda x: (x["tag"] == "label") & (x["pos"] < f["pos"]) & (x["end"] >= f["pos"]))
    by_ref = F.try_element_at(
        F.filter("id_nodes", lambda x: x["attrs"]["id"] == f["attrs"]["aria-labelledby"]), F.lit(1)
    )
    # nearest group container, then its next three parents
    groups = F.transform(f["anc"], lambda a, i: F.struct(a.alias("a"), i.alias("i")))
    at = F.aggregate(
        groups, F.lit(-1),
        lambda acc, g: F.when(g["a"]["tag"].isin("div", "fieldset", "section"), g["i"]).otherwise(acc),
    )
    chain = F.when(
        at >= 0, F.reverse(F.slice(f["anc"], F.greatest(at - 2, F.lit(1)), F.least(at + 1, F.lit(4))))
    ).otherwise(F.slice(f["anc"], 1, 0))
    group_text = F.transform(
        chain,
        lambda g: F.transform(
            F.slice(F.filter("label_nodes", lambda x: _inside(x, g)), 1, 1),
            lambda x: F.when(~((x["pos"] < f["pos"]) & (x["end"] >= f["pos"])), F.nullif(F.trim(x["text"]), blank)),
        ),
    )
    by_group = F.try_element_at(F.filter(F.flatten(group_text), lambda t: t.isNotNull()), F.lit(1))
    before = F.filter(
        "nodes",
        lambda x: (x["parent"] == f["parent"]) & (x["pos"] < f["pos"]) & (F.trim(x["text"]) != "") & (F.length(F.trim(x["text"])) < 40),
    )
    by_before = F.when(F.size(before) > 0, F.trim(F.try_element_at(before, F.lit(-1))["text"]))
    return F.coalesce(
        F.nullif(f["attrs"]["aria-label"], blank),
        F.when(F.coalesce(f["attrs"]["id"], blank) != "", by_for["text"]),
        F.when(F.size(around) > 0, F.try_element_at(around, F.lit(-1))["text"]),
        by_ref["text"],
        by_group,
        by_before,
        F.nullif(f["attrs"]["placeholder"], blank),
        f["attrs"]["name"],
        blank,
    )


def _selector_of(x: Column) -> Column:
    el_id = F.coalesce(x["attrs"]["id"], F.lit(""))
    p = x["parts"]
    path = F.when(F.size(p) > 9, F.slice(p, -9, 9)).otherwise(p)
    return F.when(el_id != "", F.concat(F.lit("#"), _css_escape(el_id))).otherwise(F.array_join(path, ">"))


def with_form_fields(pages: DataFrame) -> DataFrame:
    """Pages whose markup can hold a form field; the test runs on the scan, before parsing."""
    return pages.where(F.col("html").rlike(r"(?i)<(input|select|textarea)\b|role\s*=|aria-haspopup|contenteditable"))


def extract_forms(dom: DataFrame) -> DataFrame:
    """(page_id, form): the last open dialog's form, else the first form, else the page.

    All rules look at one page, so they are higher-order functions over the
    page's element array and no row leaves its task.
    """
    is_field = (
        lambda n: n["tag"].isin("input", "select", "textarea") | n["role"].isin(list(K.FIELD_ROLES))
        | F.coalesce(F.lower(n["attrs"]["aria-haspopup"]).isin("listbox", "menu"), F.lit(False))
        | F.coalesce(n["attrs"]["contenteditable"] == "true", F.lit(False))
    )
    dialog = (
        lambda n: n["visible"] & ((n["role"] == "dialog") | F.coalesce(n["attrs"]["aria-modal"] == "true", F.lit(False))
                                  | ((n["tag"] == "dialog") & F.map_contains_key(n["attrs"], F.lit("open"))))
    )
    span = "struct<pos:int,end:int>"
    p = dom.withColumn("dialogs", F.filter("nodes", dialog)).withColumn(
        "form_nodes", F.filter("nodes", lambda n: n["tag"] == "form")
    )
    p = p.withColumn("is_dialog", F.size("dialogs") > 0)
    pick = (
        F.when(F.col("is_dialog"), F.struct(F.try_element_at("dialogs", F.lit(-1))["pos"].alias("pos"), F.try_element_at("dialogs", F.lit(-1))["end"].alias("end")))
        .when(F.size("form_nodes") > 0, F.struct(F.try_element_at("form_nodes", F.lit(1))["pos"].alias("pos"), F.try_element_at("form_nodes", F.lit(1))["end"].alias("end")))
        .otherwise(F.struct(F.lit(-1).alias("pos"), F.lit(2147483647).alias("end")).cast(span))
    )
    p = (
        p.withColumn("scope", pick)
        .withColumn("label_nodes", F.filter("nodes", lambda n: n["tag"].isin("label", "legend")))
        .withColumn("id_nodes", F.filter("nodes", lambda n: F.map_contains_key(n["attrs"], F.lit("id"))))
    )
    raw = F.filter("nodes", lambda n: is_field(n) & n["visible"] & _inside(n, F.col("scope")) & ~_type_of(n).isin(list(K.NON_FIELD_TYPES)))
    p = p.withColumn(
        "raw", F.transform(raw, lambda f: F.struct(f.alias("f"), _type_of(f).alias("type"), _label_of_field(f).alias("lab")))
    )
    noise = lambda r: F.concat(r["lab"], F.lit(" "), F.coalesce(r["f"]["attrs"]["placeholder"], F.lit(""))).rlike(K.FORM_NOISE)
    p = p.withColumn("raw", F.filter("raw", lambda r: ~noise(r)))
    tidy = lambda r: _clean(r["lab"])
    trimmed = lambda r: F.substring(F.trim(F.regexp_replace(tidy(r), r"\s*\*\s*", " ")), 1, 80)
    p = p.withColumn(
        "fields",
        F.transform(
            "raw",
            lambda r: F.struct(
                trimmed(r).alias("label"), r["type"].alias("type"),
                (F.map_contains_key(r["f"]["attrs"], F.lit("required"))
                 | F.coalesce(r["f"]["attrs"]["aria-required"] == "true", F.lit(False)) | tidy(r).contains("*")).alias("required"),
                F.when(
                    r["f"]["tag"] == "select",
                    F.slice(
                        F.filter(
                            F.transform(F.filter("nodes", lambda x: (x["tag"] == "option") & _inside(x, r["f"])), lambda x: F.trim(x["text"])),
                            lambda t: t != "",
                        ), 1, K.FORM_OPTIONS,
                    ),
                ).alias("options"),
                F.when(r["type"].isin("dropdown", "toggle", "radiogroup"), F.substring(_clean(r["f"]["text"]), 1, 40)).alias("value"),
                F.when((r["f"]["tag"] == "input") & (F.lower(r["type"]) == "file"), F.nullif(r["f"]["attrs"]["accept"], F.lit(""))).alias("accept"),
                _selector_of(r["f"]).alias("selector"),
                F.substring(F.coalesce(r["f"]["attrs"]["placeholder"], F.lit("")), 1, 60).alias("placeholder"),
            ),
        ),
    )
    # first per (label, type); a form has few fields, so the scan of the earlier ones is short
    p = p.withColumn(
        "fields",
        F.filter(
            F.col("fields"),
            lambda f, i: ~F.exists(F.slice(F.col("fields"), F.lit(1), i), lambda g: (g["label"] == f["label"]) & (g["type"] == f["type"])),
        ),
    )
    # the form's own span; without dialog or form, the smallest element around all fields
    first_f, last_f = F.col("raw")[0]["f"]["pos"], F.try_element_at("raw", F.lit(-1))["f"]["pos"]
    common = F.filter("nodes", lambda n: (n["pos"] <= first_f) & (n["end"] >= last_f))
    whole = F.struct(F.lit(-1).alias("pos"), F.lit(2147483647).alias("end"))
    root = F.when(F.col("scope.pos") >= 0, F.col("scope")).when(
        (F.size("raw") > 0) & (F.size(common) > 0),
        F.struct(F.try_element_at(common, F.lit(-1))["pos"].alias("pos"), F.try_element_at(common, F.lit(-1))["end"].alias("end")),
    ).otherwise(whole)
    p = p.withColumn("root", root)
    p = p.withColumn(
        "buttons",
        F.transform(
            F.filter(
                "nodes",
                lambda n: _inside(n, F.col("root"))
                & ((n["tag"] == "button") | F.coalesce(F.lower(n["attrs"]["type"]) == "submit", F.lit(False)) | (n["role"] == "button")),
            ),
            lambda n: F.struct(
                _clean(F.coalesce(F.nullif(n["text"], F.lit("")), n["attrs"]["value"], F.lit(""))).alias("t"), _selector_of(n).alias("s")
            ),
        ),
    )
    p = p.withColumn("buttons", F.filter("buttons", lambda b: (b["t"] != "") & ~b["t"].rlike(K.FORM_NOISE)))
    saves = F.filter("buttons", lambda b: b["t"].rlike(K.FORM_SAVE))
    p = p.withColumn("buttons", F.when(F.size(saves) > 0, saves).otherwise(F.col("buttons")))
    heading = F.try_element_at(
        F.filter("nodes", lambda n: _inside(n, F.col("root")) & (n["tag"].isin("h1", "h2", "h3") | (n["role"] == "heading"))), F.lit(1)
    )
    doc_title = F.try_element_at(F.filter("nodes", lambda n: n["tag"] == "title"), F.lit(1))
    title = F.coalesce(F.nullif(heading["text"], F.lit("")), doc_title["text"], F.lit(""))
    return p.select(
        "page_id", "url",
        F.struct(
            F.substring(_clean(title), 1, 120).alias("title"),
            F.col("is_dialog").alias("isDialog"),
            "fields",
            F.slice(F.array_distinct(F.transform("buttons", lambda b: b["t"])), 1, K.FORM_SUBMITS).alias("submitButtons"),
            F.try_element_at(F.transform("buttons", lambda b: b["s"]), F.lit(1)).alias("submitSelector"),
            F.size("fields").alias("fieldCount"),
        ).alias("form"),
    )


def form_bearing(dom: DataFrame) -> DataFrame:
    """Field count, password flag and submit flag of each page, and whether it is a form state."""
    kind = lambda n: F.lower(F.coalesce(F.nullif(n["attrs"]["type"], F.lit("")), F.lit("text")))
    inputs = F.filter(
        "nodes",
        lambda n: n["tag"].isin("input", "select", "textarea") & n["visible"] & ~kind(n).isin(list(K.NON_BEARING_TYPES)),
    )
    submit = F.exists(
        "nodes",
        lambda n: n["visible"] & ((n["tag"] == "button") | F.coalesce(F.lower(n["attrs"]["type"]) == "submit", F.lit(False)) | (n["role"] == "button")),
    )
    out = dom.select(
        "page_id", "url", F.size(inputs).alias("fields"),
        F.exists(inputs, lambda n: F.lower(F.coalesce(n["attrs"]["type"], F.lit(""))) == "password").alias("has_password"),
        submit.alias("submit"),
    )
    ok = F.col("submit") & ((F.col("fields") >= 2) | ((F.col("fields") >= 1) & F.col("has_password")))
    return out.withColumn("is_form_state", ok)


# --- content collections -----------------------------------------------------------------

_COLL_TAGS = ("table", "ul", "ol")


def _coll_role(x: Column) -> Column:
    return (
        F.when(x["role"] != "", x["role"]).when(x["tag"] == "table", "table").when(x["tag"].isin("ul", "ol"), "list").otherwise("")
    )


def _is_close(a: Column) -> Column:
    return a["tag"].isin(list(_COLL_TAGS)) | a["role"].isin(list(K.COLLECTION_ROLES))


def aria_collections(dom: DataFrame) -> DataFrame:
    """Tables, trees, lists and feeds with the items that belong to each.

    An item belongs to its nearest container.  The container is known from the
    item's own ancestry, so grouping items needs no join; items are kept before
    grouping only up to the 500 a collection shows, and counted apart.
    """
    holder = F.try_element_at(F.filter("anc", _is_close), F.lit(-1))
    role = _coll_role(F.col("c"))
    cells = F.transform(F.col("cells"), lambda x: x["text"])
    # cells of an item come from the page's own array
    page_cells = dom.select(
        "page_id",
        F.filter("nodes", lambda x: (x["tag"] == "td") | x["role"].isin("gridcell", "cell")).alias("cell_nodes"),
        F.explode(F.filter("nodes", lambda x: x["tag"].isin(list(K.ITEM_TAGS)) | x["role"].isin(list(K.ITEM_ROLES)))).alias("n"),
    ).select("page_id", "cell_nodes", "n.*")
    items = page_cells.where(F.exists("anc", _is_close)).withColumn("c", holder).withColumn("role_c", role)
    items = items.where(F.col("role_c").isin(list(K.COLLECTION_ROLES)))
    level = F.when(attr("aria-level").rlike(r"^\d+$"), attr("aria-level").cast("int"))
    t = F.substring(labels.collapse(F.coalesce(F.nullif(attr("aria-label"), F.lit("")), F.col("text"))), 1, K.ITEM_TEXT)
    items = items.select(
        "page_id", F.col("c.pos").alias("coll_pos"), F.concat(F.lit("aria:"), F.col("role_c")).alias("kind"), "pos", t.alias("t"),
        F.filter("cell_nodes", lambda x: (x["pos"] > F.col("pos")) & (x["pos"] <= F.col("end")) & (x["text"] != "")).alias("cells"),
        level.alias("level"),
    ).withColumn("cells", F.slice(cells, 1, K.CELLS_PER_ITEM))
    counts = items.groupBy("page_id", "coll_pos", "kind").agg(F.count("*").alias("count")).where("count >= 2")
    counts = top_n(counts, ["page_id"], ["coll_pos"], K.ARIA_COLLECTIONS_PER_PAGE)
    shown = top_n(items, ["page_id", "coll_pos"], ["pos"], K.ITEMS_PER_COLLECTION, rank="item_idx")
    return shown.drop("pos").join(counts.hint(_SORTED), ["page_id", "coll_pos", "kind"])


def sibling_collections(dom: DataFrame) -> DataFrame:
    """Repeated siblings that form a list without saying so.

    The most frequent child tag of a container (the tag seen first wins a tie)
    with five or more children that have text, outside any declared collection.
    """
    n = elements(dom)
    kids = n.where(F.size("anc") > 0).withColumn("p", F.try_element_at("anc", F.lit(-1)))
    kids = kids.where(F.col("p.tag").isin(list(K.SIBLING_PARENT_TAGS)))
    declared = F.exists(
        "anc", lambda a: _is_close(a) & ((a["tag"].isin(list(_COLL_TAGS)) & (a["role"] == "")) | a["role"].isin(list(K.COLLECTION_ROLES)))
    )
    per_tag = kids.groupBy("page_id", F.col("p.pos").alias("coll_pos"), "tag").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos")
    )
    top = (
        per_tag.groupBy("page_id", "coll_pos")
        .agg(F.max_by(F.struct("tag", "n"), F.struct("n", -F.col("first_pos"))).alias("t"))
        .where(F.col("t.n") >= K.SIBLINGS_MIN)
        .select("page_id", "coll_pos", F.col("t.tag").alias("tag"))
    )
    named = _is_close_self()
    grp = kids.where((F.col("text") != "") & ~declared & ~named).select(
        "page_id", F.col("p.pos").alias("coll_pos"), "tag", "pos", F.substring("text", 1, K.ITEM_TEXT).alias("t")
    )
    grp = grp.join(top.hint(_SORTED), ["page_id", "coll_pos", "tag"])
    counts = grp.groupBy("page_id", "coll_pos", "tag").agg(F.count("*").alias("count")).where(F.col("count") >= K.SIBLINGS_MIN)
    shown = top_n(grp, ["page_id", "coll_pos", "tag"], ["pos"], K.ITEMS_PER_COLLECTION, rank="item_idx")
    return shown.join(counts.hint(_SORTED), ["page_id", "coll_pos", "tag"]).select(
        "page_id", "coll_pos", F.concat(F.lit("repeated:"), "tag").alias("kind"), "item_idx", "t",
        F.lit(None).cast("array<string>").alias("cells"), F.lit(None).cast("int").alias("level"), "count",
    )


def _is_close_self() -> Column:
    # the first sibling's own container test includes the sibling itself
    role = F.when(F.col("role") != "", F.col("role")).when(F.col("tag") == "table", "table").when(
        F.col("tag").isin("ul", "ol"), "list"
    ).otherwise("")
    return role.isin(list(K.COLLECTION_ROLES))


def extract_collections(dom: DataFrame) -> DataFrame:
    """Declared collections first, then repeated siblings, at most 80 per page."""
    dom = cut(dom)  # both kinds count and list: the pages would otherwise be parsed for each
    aria = aria_collections(dom).withColumn("pass", F.lit(0))
    sib = sibling_collections(dom).withColumn("pass", F.lit(1))
    cols = ["page_id", "pass", "coll_pos", "kind", "count", "item_idx", "t", "cells", "level"]
    # written once: the heads and the items would otherwise parse the pages again
    both = cut(aria.select(*cols).unionByName(sib.select(*cols)))
    heads = both.where("item_idx = 1").select("page_id", "pass", "coll_pos")
    kept = top_n(heads, ["page_id"], ["pass", "coll_pos"], K.COLLECTIONS_PER_PAGE, rank="coll_idx")
    return both.join(kept.hint(_SORTED), ["page_id", "pass", "coll_pos"])


# --- paging ----------------------------------------------------------------------------------

def next_page_link(dom: DataFrame) -> DataFrame:
    """The control that leads to the next page, and whether it is exhausted.

    ``rel=next`` first, then an aria-label, then exact text inside the first
    pagination container that has it (the whole page without any container).
    """
    rel = lambda n: F.array_contains(F.split(F.lower(F.coalesce(n["attrs"]["rel"], F.lit(""))), r"\s+"), "next")
    clickable = lambda n: n["tag"].isin("a", "button") | n["role"].isin("button", "link")
    by_rel = F.try_element_at(F.filter("nodes", rel), F.lit(1))
    by_label = F.try_element_at(
        F.filter("nodes", lambda n: clickable(n) & F.coalesce(n["attrs"]["aria-label"], F.lit("")).rlike(K.NEXT_LABEL)), F.lit(1)
    )
    scope = (
        lambda n: (n["role"] == "navigation") | (n["tag"] == "nav")
        | F.coalesce(n["attrs"]["class"], F.lit("")).contains("pagin") | F.coalesce(n["attrs"]["class"], F.lit("")).contains("Pagin")
    )
    texts = F.filter("nodes", lambda n: clickable(n) & labels.collapse(n["text"]).rlike(K.NEXT_TEXT))
    scopes = F.filter("nodes", scope)
    # containers come in document order; the first one that holds a hit gives it
    scoped = F.flatten(
        F.transform(F.col("scopes"), lambda s: F.filter("texts", lambda n: _inside(n, s)))
    )
    p = dom.withColumn("texts", texts).withColumn("scopes", scopes)
    by_text = F.try_element_at(F.when(F.size("scopes") > 0, scoped).otherwise(F.col("texts")), F.lit(1))
    p = p.select("page_id", "nodes", F.coalesce(by_rel, by_label, by_text).alias("el"))
    disabled_class = lambda x: F.array_contains(F.split(F.coalesce(x["attrs"]["class"], F.lit("")), r"\s+"), "disabled")
    item = F.filter(
        "nodes",
        lambda x: ((x["tag"] == "li") | (x["role"] == "none")) & (x["pos"] <= F.col("el.pos")) & (x["end"] >= F.col("el.pos")),
    )
    off = (
        F.map_contains_key(F.col("el")["attrs"], F.lit("disabled")) | F.coalesce(F.col("el")["attrs"]["aria-disabled"] == "true", F.lit(False))
        | disabled_class(F.col("el")) | F.coalesce(F.when(F.size(item) > 0, disabled_class(F.try_element_at(item, F.lit(-1)))), F.lit(False))
        | ~F.col("el.visible") | (F.col("el.tag") == "link")
    )
    found = F.col("el").isNotNull()
    text = F.substring(
        labels.collapse(F.coalesce(F.nullif(F.col("el.text"), F.lit("")), F.col("el")["attrs"]["aria-label"], F.lit(""))), 1, 60
    )
    return p.select(
        "page_id", found.alias("found"), F.when(found, off).otherwise(True).alias("exhausted"),
        F.when(found, _selector_of(F.col("el"))).alias("selector"), F.when(found, text).alias("text"),
    )


def page_signature(dom: DataFrame) -> DataFrame:
    """Identity of a page's content: location, item count and the first items' text."""
    items = F.slice(
        F.filter("nodes", lambda n: n["role"].isin("row", "listitem", "treeitem", "option") | n["tag"].isin("tr", "li")),
        1, K.PAGE_SIG_ITEMS,
    )
    body = F.array_join(F.transform(items, lambda n: F.substring(labels.collapse(n["text"]), 1, 80)), "§")
    return dom.select(
        "page_id", F.concat(F.col("url"), F.lit("|"), F.size(items), F.lit("|"), F.substring(body, 1, 2000)).alias("sig")
    )


def iframe_sources(dom: DataFrame) -> DataFrame:
    return elements(dom).where((F.col("tag") == "iframe") & attr("src").isNotNull()).select(
        "page_id", "pos", urls.resolve("url", attr("src")).alias("src")
    ).where(F.col("src").rlike(r"^https?:"))
