"""Link graphs and trigger tables built from page corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import labels, urls
from ..operators.frontier import cap_actions, nav_only as keep_nav, rank_triggers
from ..operators.rows import first_by
from ..operators.sets import LINK_EDGE_KEY, dedupe_edges


def route_affordances(
    links: DataFrame,
    actions: DataFrame | None,
    skip_writes: bool = False,
    allow_destructive: bool = False,
    subdomains: bool = False,
    only_nav: bool = False,
    max_actions: int = K.ACTIONS_PER_STATE,
) -> DataFrame:
    """What each link and control of a page becomes in the graph.

    Links: a download node, a page, or nothing.  Controls, tested in this order:
    upload, download, destructive, write; the rest would be clicked and leaves no
    row (``route`` = ``probe``).  Answers (host, page_id, ord, route, kind, id, label,
    url, title, reason, accept, dl_href, dl_kind, selector) with ``ord`` the
    position within the page.

    ``links`` is (host, page_id, sid, link_seq, href, text, download, dl_kind).
    """
    none = F.lit(None).cast("string")
    text = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.lit(""))
    dl_label = F.when(text == "", "Download").otherwise(text)
    crawlable = urls.is_crawlable("href", "host", subdomains)
    route = F.when(F.col("download"), "download").when(crawlable, "page")
    linked = links.withColumn("route", route).where(F.col("route").isNotNull())
    is_dl = F.col("route") == "download"
    out = linked.select(
        "host", "page_id", "sid", F.col("link_seq").cast("bigint").alias("ord"), "route", F.lit("link").alias("kind"),
        F.when(is_dl, labels.mint_node_id("sid", "download", F.col("href"), dl_label)).otherwise(urls.normalize_url("href")).alias("id"),
        F.when(is_dl, dl_label).when(text == "", "(link)").otherwise(text).alias("label"),
        F.when(is_dl, "").otherwise(F.col("href")).alias("url"),
        F.when(is_dl, F.concat(F.lit("⬇ "), dl_label)).when(text == "", F.col("href")).otherwise(text).alias("title"),
        F.when(is_dl, "download").alias("reason"), none.alias("accept"),
        F.when(is_dl, F.col("href")).alias("dl_href"), F.when(is_dl, F.coalesce("dl_kind", F.lit("direct"))).alias("dl_kind"),
        none.alias("selector"),
    )
    if actions is None:
        return out
    a = cap_actions(keep_nav(actions) if only_nav else actions, max_actions)
    atext = F.coalesce(F.col("text"), F.lit(""))
    lab = F.when(atext == "", F.concat(F.lit("("), F.col("tag"), F.lit(")"))).otherwise(atext)
    destructive = F.lit(False) if allow_destructive else atext.rlike(K.DESTRUCTIVE)
    write = atext.rlike(K.WRITE) if skip_writes else F.lit(False)
    a = a.withColumn("lab", lab).withColumn(
        "route",
        F.when(F.col("upload"), "upload").when(F.col("download"), "download").when(destructive | write, "skipped").otherwise("probe"),
    )
    dlk = F.coalesce("dl_kind", F.when(F.coalesce("dl_href", F.lit("")) != "", "direct").otherwise("js"))
    acc = F.coalesce("accept", F.lit(""))
    title = (
        F.when(F.col("route") == "upload", F.concat(F.lit("⬆ "), F.col("lab"), F.when(acc != "", F.concat(F.lit(" ["), acc, F.lit("]"))).otherwise("")))
        .when(F.col("route") == "download", F.concat(F.lit("⬇ "), F.col("lab"), F.lit(" ["), dlk, F.lit("]")))
        .otherwise(F.concat(F.lit("⚠ "), F.col("lab")))
    )
    node_id = F.when(F.col("route") == "upload", labels.mint_node_id("sid", "upload", F.col("selector"), F.col("lab"))).when(
        F.col("route") == "download", labels.mint_node_id("sid", "download", F.col("selector"), F.col("lab"))
    ).otherwise(labels.mint_node_id("sid", "skipped", F.col("selector"), F.col("lab")))
    reason = F.when(F.col("route") == "skipped", F.when(destructive, "destructive").otherwise("write")).otherwise(F.col("route"))
    acted = a.select(
        "host", "page_id", "sid", (F.lit(1_000_000_000) + F.col("pos")).cast("bigint").alias("ord"), "route",
        F.lit("action").alias("kind"), node_id.alias("id"), F.col("lab").alias("label"), F.lit("").alias("url"), title.alias("title"),
        reason.alias("reason"), F.when(F.col("route") == "upload", acc).alias("accept"),
        F.when(F.col("route") == "download", F.coalesce("dl_href", F.lit(""))).alias("dl_href"),
        F.when(F.col("route") == "download", dlk).alias("dl_kind"),
        F.when(F.col("route") == "download", F.col("selector")).alias("selector"),
    )
    return out.unionByName(acted)


_NODE_ATTRS = ["url", "title", "type", "reason", "accept", "dl_href", "dl_kind", "selector"]


def build_link_graph(
    pages: DataFrame, links: DataFrame, actions: DataFrame | None = None, subdomains: bool = False, **options
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every host in a page corpus.

    ``pages`` is (page_id, url, title), ``links`` and ``actions`` as extracted.
    Pages are taken in id order, the first of each normalised url; a node keeps
    the last non-empty value written to each attribute, and the first edge of a
    key stays.  Both rules are aggregates over (page, position), so a page that
    everything links to is combined map-side.
    """
    p = pages.withColumn("sid", urls.normalize_url("url")).withColumn("host", urls.host_key("url", subdomains))
    p = first_by(p.select("host", "sid", "page_id", "url", "title"), ["host", "sid"], ["page_id"], ["page_id", "url", "title"])
    where = p.select("page_id", "host", "sid")
    l = links.join(where, "page_id")
    a = actions.join(where, "page_id") if actions is not None else None
    routed = route_affordances(l, a, subdomains=subdomains, **options).where(F.col("route") != "probe")
    none = F.lit(None).cast("string")
    own = p.select(
        "host", F.col("sid").alias("id"), F.struct("page_id", F.lit(-1).cast("bigint").alias("ord")).alias("at"), "url",
        F.when(F.coalesce("title", F.lit("")) == "", F.col("url")).otherwise(F.col("title")).alias("title"), F.lit("page").alias("type"),
        *[none.alias(c) for c in _NODE_ATTRS[3:]],
    )
    made = routed.select(
        "host", "id", F.struct("page_id", "ord").alias("at"), "url", "title",
        F.when(F.col("route") == "page", "page").otherwise(F.col("route")).alias("type"), *_NODE_ATTRS[3:],
    )
    writes = own.unionByName(made)
    last = lambda c: F.max_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("at"))).alias(c)
    nodes = writes.groupBy("host", "id").agg(
        F.min("at").alias("first_at"), *[F.coalesce(last(c), F.lit("")).alias(c) for c in _NODE_ATTRS]
    )
    raw = routed.select(
        "host", F.col("sid").alias("src"), F.col("id").alias("dst"), "label", "kind", F.struct("page_id", "ord").alias("edge_seq"),
        (F.col("route") != "page").alias("skipped"),
    )
    edges = dedupe_edges(raw, LINK_EDGE_KEY)
    return nodes, edges


def trigger_table(visits: DataFrame, controls: DataFrame, reads: DataFrame, bearing: DataFrame) -> DataFrame:
    """Every recorded trigger of a crawl.

    ``visits``   (host, visit_seq, page_id, url, state_id, parent_id, via_label, via_selector, path)
    ``controls`` (page_id, pos, text, tag, role, selector, href, bulk)
    ``reads``    (page_id, key, form, opens_at): what opening a label on a page showed
    ``bearing``  (page_id, is_form_state, form)

    A state that is itself a form gives its parent a trigger (once per url, and
    not when a create trigger already opens that url); create controls follow,
    one per label and with the form of the label's first read on the host; then
    download controls whose label was not taken.
    """
    page = visits.select("host", "visit_seq", "page_id", "state_id", "path")
    created = rank_triggers(controls).join(page, "page_id")
    opened = created.join(reads, ["page_id", "key"], "left")
    first_read = opened.groupBy("host", "key").agg(F.min_by(F.struct("form", "opens_at"), F.struct("visit_seq", "rank")).alias("f"))
    none = F.lit(None).cast("string")
    creates = created.join(first_read, ["host", "key"]).select(
        "host", "visit_seq", F.lit(1).alias("class"), F.col("rank").cast("bigint").alias("ord"), F.trim("text").alias("label"), "state_id", "path",
        F.col("f.form").alias("form"), F.col("f.opens_at").alias("opens_at"), F.lit("form").alias("kind"), "selector", none.alias("href"),
    )
    direct = urls.is_direct_download("href")
    text = F.trim(F.coalesce("text", F.lit("")))
    dl = controls.where((text != "") & ~F.col("bulk") & (direct | text.rlike(K.DOWNLOAD_LABEL))).withColumn("key", F.lower(text))
    dl = dl.join(created.select("page_id", "key").distinct(), ["page_id", "key"], "left_anti")
    dl = first_by(dl.select("page_id", "key", "pos", "text", "selector", "href"), ["page_id", "key"], ["pos"]).join(page, "page_id")
    downloads = dl.select(
        "host", "visit_seq", F.lit(2).alias("class"), F.col("pos").cast("bigint").alias("ord"), F.trim("text").alias("label"), "state_id", "path",
        F.lit(None).cast(creates.schema["form"].dataType).alias("form"), none.alias("opens_at"), F.lit("download").alias("kind"),
        "selector", F.when(urls.is_direct_download("href"), F.col("href")).alias("href"),
    )
    forms = visits.join(bearing.where("is_form_state").select("page_id", F.col("form").alias("own_form")), "page_id")
    lab = F.coalesce(
        F.nullif(F.trim(F.coalesce("via_label", F.lit(""))), F.lit("")), F.nullif(F.trim("own_form.title"), F.lit("")),
        F.nullif(F.trim(F.try_element_at(F.col("own_form.submitButtons"), F.lit(1))), F.lit("")),
    )
    forms = forms.where(F.col("parent_id").isNotNull() & lab.isNotNull()).withColumn("label", lab).withColumn("nurl", urls.norm_state_url("url"))
    firsts = first_by(
        forms.select("host", "nurl", "visit_seq", "label", "parent_id", "path", "own_form", "url", "via_selector"), ["host", "nurl"], ["visit_seq"]
    )
    # a create trigger recorded by then already opens this url
    opens = creates.where(F.coalesce("opens_at", F.lit("")) != "").groupBy("host", urls.norm_state_url("opens_at").alias("nurl")).agg(
        F.min("visit_seq").alias("opened_by")
    )
    firsts = firsts.join(opens, ["host", "nurl"], "left").where(F.col("opened_by").isNull() | (F.col("opened_by") >= F.col("visit_seq")))
    states = firsts.select(
        "host", "visit_seq", F.lit(0).alias("class"), F.lit(0).cast("bigint").alias("ord"), "label", F.col("parent_id").alias("state_id"),
        F.when(F.size("path") > 1, F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(1)))).otherwise(F.slice("path", 1, 0)).alias("path"),
        F.col("own_form").alias("form"), F.col("url").alias("opens_at"), F.lit("form").alias("kind"), F.col("via_selector").alias("selector"), none.alias("href"),
    )
    return states.unionByName(creates).unionByName(downloads)


def routing_mode(snapshots: DataFrame) -> DataFrame:
    """(host, single_url): does a site swap views without changing its url?

    ``snapshots`` is (host, probe_seq, url, controls, view) with probe 0 the first
    view.  The first of at most three probes that changes something decides.
    """
    from ..operators.sets import control_labels, sets_differ

    base = snapshots.where("probe_seq = 0").select(
        "host", urls.norm_state_url("url").alias("u0"), control_labels("controls").alias("c0"), F.col("view").alias("v0"),
        F.size("controls").alias("n0"),
    )
    probes = snapshots.where((F.col("probe_seq") > 0) & (F.col("probe_seq") <= K.DETECT_MAX_PROBES)).select(
        "host", "probe_seq", urls.norm_state_url("url").alias("u"), control_labels("controls").alias("c"), "view"
    )
    moved = F.col("u") != F.col("u0")
    swapped = sets_differ(F.col("c"), F.col("c0")) | sets_differ(F.col("view"), F.col("v0"))
    judged = base.join(probes, "host", "left").withColumn("verdict", F.when(moved, False).when(swapped, True))
    first = judged.groupBy("host").agg(
        F.min_by("verdict", F.when(F.col("verdict").isNotNull(), F.col("probe_seq"))).alias("v"), F.max("n0").alias("n0")
    )
    return first.select(
        "host", F.when(F.col("n0") < K.DETECT_MIN_CONTROLS, False).otherwise(F.coalesce("v", F.lit(False))).alias("single_url")
    )
