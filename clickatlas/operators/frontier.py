"""Which pages a bounded crawl takes, and in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import labels, urls
from ..session import cut
from .rows import first_by, top_n


def cap_per_section(children: DataFrame, n: int = K.MAX_PER_SECTION, order: list | None = None) -> DataFrame:
    """First ``n`` children of each section over the whole crawl."""
    keyed = children.withColumn("section", urls.section_key("href"))
    return top_n(keyed, ["host", "section"], order or ["found_seq"], n)


def representative_rows(children: DataFrame, n: int = K.ROWS_PER_LIST) -> DataFrame:
    """First ``n`` links of each data list of a page."""
    return top_n(children, ["page_id", "section"], ["link_seq"], n)


def cap_actions(actions: DataFrame, n: int = K.ACTIONS_PER_STATE) -> DataFrame:
    return top_n(actions, ["page_id"], ["pos"], n)


def nav_only(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("nav") & ~F.col("bulk"))


def rank_triggers(controls: DataFrame) -> DataFrame:
    """Create controls of each page, best first, one per label.

    Real buttons come before other buttons and inputs, those before the rest;
    short labels before long ones.
    """
    c = controls.where((F.col("text") != "") & ~F.col("bulk") & labels.is_create_label("text"))
    base = F.when(F.col("tag") == "button", 3).when((F.col("role") == "button") | (F.col("tag") == "input"), 2).otherwise(1)
    scored = c.withColumn("key", F.lower(F.trim("text"))).withColumn("base", base).withColumn("len", F.length("text"))
    best = first_by(scored, ["page_id", "key"], [-F.col("base"), F.col("len"), F.col("pos")])
    w = Window.partitionBy("page_id").orderBy(F.col("base").desc(), "len", "pos")
    return best.withColumn("rank", F.row_number().over(w)).drop("base", "len")


def reuse_forms(triggers: DataFrame) -> DataFrame:
    """One form per trigger label of a host: the one read at the first visit, even when it failed."""
    key = F.lower("label")
    first = triggers.groupBy("host", key.alias("key")).agg(F.min_by(F.struct("form", "opens_at"), "trig_seq").alias("f"))
    return (
        triggers.drop("form", "opens_at").withColumn("key", key).join(first, ["host", "key"])
        .withColumn("form", F.col("f.form")).withColumn("opens_at", F.col("f.opens_at")).drop("f", "key")
    )


def explorable(controls: DataFrame, current_url: str = "page_url") -> DataFrame:
    """Links worth a visit: not bulk, no create or destructive label, http, not the page itself; first per url."""
    u = urls.drop_fragment("href")
    own = urls.rtrim_slash(u) == urls.rtrim_slash(urls.drop_fragment(F.col(current_url)))
    kept = controls.where(
        ~F.col("bulk") & ~F.coalesce("text", F.lit("")).rlike(K.SKIP_NAV) & F.col("href").isNotNull() & u.startswith("http") & ~own
    ).withColumn("target", u)
    return first_by(kept, ["page_id", "target"], ["link_seq"])


def page_children(controls: DataFrame, data_list_min: int = K.DATA_LIST_MIN, rows_per_list: int = K.ROWS_PER_LIST) -> DataFrame:
    """Children of each page in page order, data lists cut to their representative rows.

    ``controls`` is (page_id, page_url, link_seq, href, text, bulk).
    """
    u = urls.drop_fragment("href")
    same = urls.same_host("href", "page_url")
    counted = controls.where(F.col("href").startswith("http") & same).groupBy(
        "page_id", urls.section_key(u).alias("section")
    ).agg(F.count("*").alias("n")).where(F.col("n") >= data_list_min).select("page_id", "section", F.lit(True).alias("is_list"))
    kids = explorable(controls).withColumn("cross", ~urls.same_host("target", "page_url")).withColumn("section", urls.section_key("target"))
    kids = kids.join(counted, ["page_id", "section"], "left").withColumn("is_list", F.coalesce("is_list", F.lit(False)) & ~F.col("cross"))
    plain = kids.where(~F.col("is_list"))
    rows = top_n(kids.where("is_list"), ["page_id", "section"], ["link_seq"], rows_per_list)
    kind = F.when(F.col("cross"), "external").when(F.col("is_list"), "row").otherwise("link")
    return plain.unionByName(rows).withColumn("kind", kind)


def frontier_order(frontier: DataFrame) -> DataFrame:
    """``frontier`` with ``place`` from 1: the order in which each host's entries are taken."""
    w = Window.partitionBy("host").orderBy("depth", "tier", "found_seq")
    return frontier.withColumn("place", F.row_number().over(w))


def stop_reason(states, queued, max_states: int = K.MAX_STATES, visits=None, max_visits: int = K.MAX_VISITS):
    """Why a crawl ended; only a drained frontier is complete coverage."""
    v = visits if visits is not None else states
    return (
        F.when(queued == 0, "frontier-exhausted")
        .when(states >= max_states, F.lit(f"hit-max-states({max_states})"))
        .when(v >= max_visits, F.lit(f"hit-max-visits({max_visits})"))
        .otherwise("stopped")
    )


def crawl_links(controls: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Links and frames of stored pages as a crawl meets them, before any choice.

    ``controls`` is (page_id, page_url, link_seq, href, text, bulk), ``frames``
    (page_id, page_url, link_seq, src); frames come after all controls of their
    page.  Of the pages stored under one identity the first answers.
    """
    u = urls.drop_fragment("href")
    skip = F.col("bulk") | F.coalesce("text", F.lit("")).rlike(K.SKIP_NAV)
    links = controls.select("page_id", "page_url", F.lit(0).alias("frame"), F.col("link_seq").cast("bigint").alias("seq"), u.alias("url"), F.coalesce(F.nullif(F.col("text"), F.lit("")), u).alias("label"), skip.alias("skip"))
    if frames is not None:
        v = urls.drop_fragment("src")
        links = links.unionByName(frames.select(
            "page_id", "page_url", F.lit(1).alias("frame"), F.col("link_seq").cast("bigint").alias("seq"), v.alias("url"), urls.host_key(v).alias("label"), F.lit(False).alias("skip")))
    links = links.where(F.col("url").startswith("http")).select(
        urls.norm_state_url("page_url").alias("from_key"), "page_id", "frame", "seq", "url", "label", F.coalesce("skip", F.lit(False)).alias("skip"),
        urls.norm_state_url("url").alias("key"), urls.host_key("url").alias("to_host"), urls.section_key("url").alias("section"),
        (urls.rtrim_slash(F.col("url")) == urls.rtrim_slash(urls.drop_fragment("page_url"))).alias("own"),
    )
    owner = links.groupBy("from_key").agg(F.min("page_id").alias("page_id"))
    return links.join(owner, ["from_key", "page_id"]).drop("page_id")


def level_children(found: DataFrame, data_list_min: int, rows_per_list: int, used: DataFrame | None = None, max_cross_host: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """Children of a level's states, and the cross-host links spent by now.

    ``found`` has the :func:`crawl_links` of each state with (host, parent_seq,
    start_host).  A link leaves the crawl's site if its host is not the start's;
    such links cost one of ``max_cross_host`` each time one is met, in order, even
    where it then turns out to be the page itself or a repeat.  A frame that
    repeats a link of its page costs nothing.  ``used`` (host, used) is None where
    the crawl keeps to its site.
    """
    found = found.withColumn("cross", F.col("to_host") != F.col("start_host"))
    at = ["host", "parent_seq"]
    lists = found.where((F.col("frame") == 0) & ~F.col("cross")).groupBy(*at, "section").agg(F.count("*").alias("n")).where(F.col("n") >= data_list_min).select(*at, "section", F.lit(True).alias("listed"))
    cand = found.where(~F.col("skip"))
    links, frames = cand.where("frame = 0"), cand.where("frame = 1")
    frames = first_by(frames, [*at, "url"], ["seq"])
    home = frames.where(~F.col("cross"))
    if used is None:
        links, frames = links.where(~F.col("cross")), home
    else:
        away = links.where("cross")
        new = frames.where("cross").join(away.where(~F.col("own")).select(*at, "url").distinct(), [*at, "url"], "left_anti")
        w = Window.partitionBy("host").orderBy("parent_seq", "frame", "seq")
        met = away.unionByName(new.select(*away.columns)).withColumn("rn", F.row_number().over(w)).join(used, "host", "left")
        met = cut(met.withColumn("ok", F.col("rn") + F.coalesce("used", F.lit(0)) <= max_cross_host))
        spent = met.groupBy("host").agg(F.count_if("ok").alias("n"))
        used = cut(used.join(spent, "host", "left").select("host", (F.col("used") + F.coalesce("n", F.lit(0))).alias("used")))
        allowed = met.where("ok").drop("rn", "used", "ok")
        links = links.where(~F.col("cross")).unionByName(allowed.where("frame = 0"))
        frames = home.select(*away.columns).unionByName(allowed.where("frame = 1").select(*away.columns))
    links = first_by(links.where(~F.col("own")), [*at, "url"], ["seq"]).join(lists, [*at, "section"], "left")
    listed = F.coalesce("listed", F.lit(False)) & ~F.col("cross")
    rows = top_n(links.where(listed), [*at, "section"], ["seq"], rows_per_list).withColumn("kind", F.lit("row"))
    plain = links.where(~listed).withColumn("kind", F.when(F.col("cross"), "external").otherwise("link"))
    links = rows.unionByName(plain).drop("listed")
    frames = frames.join(links.select(*at, "url"), [*at, "url"], "left_anti").withColumn("kind", F.lit("iframe"))
    return links.unionByName(frames.select(*links.columns)), used


def frontier_expand(
    seeds: DataFrame,
    controls: DataFrame,
    max_states: int = K.MAX_STATES,
    max_visits: int = K.MAX_VISITS,
    max_depth: int = K.MAX_DEPTH,
    max_per_section: int = K.MAX_PER_SECTION,
    data_list_min: int = K.DATA_LIST_MIN,
    rows_per_list: int = K.ROWS_PER_LIST,
    cross_host: bool = False,
    max_cross_host: int = K.MAX_CROSS_HOST,
    frames: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bounded breadth-first crawl of a stored link table, for all hosts at once.

    ``seeds`` is (host, url) with one start per host; ``controls`` and ``frames``
    the links of every stored page, as for :func:`crawl_links`.  Answers (states,
    edges, reasons).  The children of a level's states are ordered by (parent,
    position), claimed once per url, cut per section and numbered.  No group of a
    level exceeds max_states times the controls of a page, because a crawl holds
    at most ``max_states`` states.  In a stored table every visit is a state of
    its own, so the smaller of the two bounds ends the crawl.
    """
    kids = cut(crawl_links(controls, frames))
    cap = min(max_states, max_visits)
    place = lambda p, f, q: F.struct(p.cast("bigint").alias("parent"), f.cast("int").alias("frame"), q.cast("bigint").alias("seq"))
    zero = F.lit(0)
    start = seeds.select("host", urls.host_key("url").alias("start_host"))
    queue = seeds.select(
        "host", urls.norm_state_url("url").alias("key"), urls.drop_fragment("url").alias("url"), F.lit(0).alias("depth"),
        F.lit(0).alias("tier"), place(zero, zero, zero).alias("found_seq"), F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("string").alias("from_key"), F.lit(None).cast("string").alias("kind"),
    )
    none = F.lit(0).cast("bigint")
    states = edges = claimed = sections = leftovers = None
    used = seeds.select("host", none.alias("used")) if cross_host else None
    depth = 0
    while True:
        done = states.groupBy("host").agg(F.count("*").alias("done")) if states is not None else seeds.select("host", none.alias("done"))
        ranked = frontier_order(queue).join(done, "host", "left").withColumn(
            "state_seq", F.col("place") - 1 + F.coalesce("done", F.lit(0))
        ).drop("place", "done")
        ranked = cut(ranked)
        level = ranked.where(F.col("state_seq") < cap)
        rest = ranked.where(F.col("state_seq") >= cap).select("host", "key")
        leftovers = rest if leftovers is None else leftovers.unionByName(rest)
        states = level if states is None else states.unionByName(level)
        into = level.where(F.col("from_key").isNotNull()).select("host", "from_key", F.col("key").alias("to_key"), "label", "kind")
        edges = into if edges is None else edges.unionByName(into)
        if depth >= max_depth or level.isEmpty():
            break
        found = level.select("host", F.col("key").alias("from_key"), F.col("state_seq").alias("parent_seq")).join(start, "host").join(kids, "from_key")
        children, used = level_children(found, data_list_min, rows_per_list, used, max_cross_host)
        # links to a state recorded by now become edges
        known = states.select("host", "key", F.col("state_seq").alias("known_seq"))
        seen = cut(children.join(known, ["host", "key"], "left").withColumn("found_seq", place(F.col("parent_seq"), F.col("frame"), F.col("seq"))))
        back = seen.where(F.col("known_seq") <= F.col("parent_seq")).select("host", "from_key", F.col("key").alias("to_key"), "label", "kind")
        edges = edges.unionByName(back)
        # everything else is claimed by its first finder, before the section cap is tested
        fresh = first_by(seen.where(F.col("known_seq").isNull()), ["host", "key"], ["found_seq"], ["found_seq", "url", "label", "kind", "section", "from_key"])
        if claimed is not None:
            fresh = fresh.join(claimed, ["host", "key"], "left_anti")
        fresh = cut(fresh)
        mine = fresh.select("host", "key")
        claimed = mine if claimed is None else claimed.unionByName(mine)
        ws = Window.partitionBy("host", "section").orderBy("found_seq")
        counted = fresh.withColumn("rn", F.row_number().over(ws))
        counted = counted.join(sections, ["host", "section"], "left") if sections is not None else counted.withColumn("taken", none)
        taken = cut(counted.where(F.col("rn") + F.coalesce("taken", F.lit(0)) <= max_per_section).drop("rn", "taken"))
        now = taken.groupBy("host", "section").agg(F.count("*").alias("k"))
        sections = cut(
            now.withColumnRenamed("k", "taken") if sections is None
            else sections.join(now, ["host", "section"], "full").select(
                "host", "section", (F.coalesce("taken", F.lit(0)) + F.coalesce("k", F.lit(0))).alias("taken")
            )
        )
        depth += 1
        queue = taken.select("host", "key", "url", F.lit(depth).alias("depth"), labels.tier("kind").alias("tier"), "found_seq", "label", "from_key", "kind")
    # children past the depth limit are not queued, so only states cut by the cap remain
    counts = states.groupBy("host").agg(F.count("*").alias("states")).join(
        leftovers.groupBy("host").agg(F.count("*").alias("queued")), "host", "left"
    )
    counts = counts.withColumn("queued", F.coalesce("queued", F.lit(0)))
    reason = stop_reason(F.col("states"), F.col("queued"), max_states, None, max_visits)
    reasons = counts.select("host", "states", "queued", reason.alias("stopped"), (reason == "frontier-exhausted").alias("complete"))
    return states, edges, reasons
