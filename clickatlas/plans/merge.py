"""Merging live results into stored graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.rows import first_by
from ..operators.sets import MERGE_EDGE_KEY, trigger_signature
from ..operators.transcripts import allocate_ids
from ..session import cut
from ..sources.graphs import Graphs


def lookup_states(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First state per (host, url) and per (host, url, label)."""
    s = states.select(
        "host", urls.norm_light("url").alias("u"), F.lower(F.coalesce("label", F.lit(""))).alias("l"), "state_seq", "id", "depth"
    )
    by_url = first_by(s, ["host", "u"], ["state_seq"], ["id", "depth"])
    by_label = first_by(s, ["host", "u", "l"], ["state_seq"], ["id"])
    return by_url, by_label


def _url_path(u):
    p = urls.path(u)
    return F.when(p == "", F.lit("/")).otherwise(p)


def stitch(live: DataFrame, graphs: Graphs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new_states, new_edges, ends) for a batch of live records.

    Each record becomes a chain from its start page, one distinct state per
    step.  All records of the batch advance one step per round, so the number of
    jobs follows the longest recorded path and not the number of records.  A
    step takes the stored state of its url (of its url and label for a click
    without href) unless its chain already holds it; otherwise it makes a state,
    shared by the records of the batch that need the same one.  A chain that
    visits a url again, and a last click whose state takes over the trigger page's
    url, make states of their own.

    ``live`` is (host, rec_seq, start, steps, trigger_page, trigger, selector).
    """
    by_url, by_label = lookup_states(graphs.states)
    by_url, by_label = cut(by_url), cut(by_label)
    n_steps = F.coalesce(F.size("steps"), F.lit(0))
    chain = live.select(
        "host", "rec_seq", "steps", F.greatest(n_steps, F.lit(0)).alias("n"), urls.norm_light("start").alias("u"), _url_path("start").alias("plabel"),
        F.when(F.coalesce("trigger_page", F.lit("")) != "", urls.norm_light("trigger_page")).alias("tp"), _url_path("trigger_page").alias("tp_label"),
        "selector",
    )
    start = chain.join(by_url, ["host", "u"], "left")
    made_key = lambda *parts: F.concat_ws("\x1f", *parts)
    # a start page that is not stored and has no step moves to the trigger page itself
    alone = F.col("id").isNull() & (F.col("n") == 0) & F.col("tp").isNotNull() & (F.col("tp") != F.col("u"))
    state = start.select(
        "host", "rec_seq", "steps", "n", "tp", "tp_label", "selector", F.when(alone, F.col("tp")).otherwise(F.col("u")).alias("u"),
        F.coalesce("id", F.when(alone, made_key(F.lit("+p"), F.col("rec_seq").cast("string"), F.lit("0"))), made_key(F.lit("+u"), F.col("u"))).alias("cur"),
        F.coalesce("depth", F.lit(0)).alias("depth"), "plabel",
    )
    state = cut(state.withColumn("used", F.array("cur")))
    new_states = state.where(F.col("cur").startswith("+")).select(
        "host", F.col("cur").alias("key"), "u", F.col("plabel").alias("label"), F.lit(0).alias("depth"), "rec_seq", F.lit(0).alias("step")
    )
    new_edges = None
    longest = state.agg(F.max("n")).first()[0] or 0
    for k in range(1, int(longest) + 1):
        act = state.where(F.col("n") >= k).withColumn("s", F.col("steps")[k - 1])
        href = F.coalesce(F.col("s.href"), F.lit(""))
        label = F.col("s.label")
        act = act.withColumn("href", href).withColumn("su", F.when(href != "", urls.norm_light(F.col("href"))).otherwise(F.col("u"))).withColumn(
            "sl", F.lower(F.coalesce(label, F.lit("")))
        )
        found = (
            act.join(by_url.select("host", F.col("u").alias("su"), F.col("id").alias("link_id")), ["host", "su"], "left")
            .join(by_label.select("host", F.col("u").alias("su"), F.col("l").alias("sl"), F.col("id").alias("click_id")), ["host", "su", "sl"], "left")
        )
        cand = F.when(F.col("href") != "", F.col("link_id")).otherwise(F.col("click_id"))
        shared = F.when(F.col("href") != "", made_key(F.lit("+u"), F.col("su"))).otherwise(made_key(F.lit("+c"), F.col("su"), F.col("sl")))
        private = made_key(F.lit("+p"), F.col("rec_seq").cast("string"), F.lit(str(k)))
        usable = cand.isNotNull() & ~F.array_contains("used", cand)
        # the last state of a chain moves to the trigger page when it ends elsewhere
        moves = (F.col("n") == k) & F.col("tp").isNotNull() & (F.col("tp") != F.col("su"))
        nxt = F.when(usable, cand).when(moves | F.array_contains("used", shared) | cand.isNotNull(), private).otherwise(shared)
        found = found.withColumn("cand", cand).withColumn("nxt", nxt).withColumn("moved", moves & F.col("nxt").startswith("+"))
        found = cut(found)
        made = found.where(F.col("nxt").startswith("+")).select(
            "host", F.col("nxt").alias("key"), F.when(F.col("moved"), F.col("tp")).otherwise(F.col("su")).alias("u"), F.col("s.label").alias("label"),
            (F.col("depth") + k).alias("depth"), "rec_seq", F.lit(k).alias("step"),
        )
        new_states = new_states.unionByName(made)
        link = found.select(
            "host", F.col("cur").alias("src"), F.col("nxt").alias("dst"), F.col("s.label").alias("label"), F.col("s.selector").alias("selector"),
            F.when(F.col("href") != "", "link").otherwise("click").alias("kind"), "rec_seq", F.lit(k).alias("step"),
        )
        new_edges = link if new_edges is None else new_edges.unionByName(link)
        moved_on = found.select(
            "host", "rec_seq", "steps", "n", "tp", "tp_label", "selector", F.when(F.col("moved"), F.col("tp")).otherwise(F.col("su")).alias("u"),
            F.col("nxt").alias("cur"), "depth", "plabel", F.concat("used", F.array("nxt")).alias("used"),
        )
        state = cut(moved_on.unionByName(state.where(F.col("n") < k)))
    # a chain that ends on a stored state elsewhere gets one more state for the trigger page
    off = F.col("tp").isNotNull() & (F.col("tp") != F.col("u"))
    tail = state.where(off).withColumn("key", made_key(F.lit("+t"), F.col("rec_seq").cast("string")))
    added = tail
    new_states = new_states.unionByName(
        added.select("host", "key", F.col("tp").alias("u"), F.col("tp_label").alias("label"), (F.col("depth") + F.col("n") + 1).alias("depth"), "rec_seq", (F.col("n") + 1).alias("step"))
    )
    closing = added.select(
        "host", F.col("cur").alias("src"), F.col("key").alias("dst"), F.col("tp_label").alias("label"), "selector", F.lit("link").alias("kind"), "rec_seq", (F.col("n") + 1).alias("step"),
    )
    new_edges = closing if new_edges is None else new_edges.unionByName(closing)
    ends = state.join(added.select("host", "rec_seq", "key"), ["host", "rec_seq"], "left").select(
        "host", "rec_seq", F.coalesce("key", "cur").alias("end")
    )
    return new_states, new_edges, ends


def merge_live(graphs: Graphs, live: DataFrame, now: str) -> Graphs:
    """Graphs after a batch of live records.

    A record whose label and clicked labels are already stored refreshes that
    trigger in place (the last record of a signature wins).  Every other
    signature is stitched in once.  Meta counts every record as a live hit.
    """
    sig = cut(live.withColumn("sig", trigger_signature("trigger", "steps")))
    fields = ["steps", "form", "opens_at", "kind", "selector", "href", "accept", "trigger"]
    per = sig.groupBy("host", "sig").agg(
        F.min("rec_seq").alias("first_rec"), F.max_by(F.struct(*fields), "rec_seq").alias("last"), F.count("*").alias("hits")
    )
    per = cut(per)
    stamp = F.lit(now).cast("timestamp")
    old = graphs.triggers.withColumn("sig", trigger_signature("label", "path"))
    # only the first trigger of a signature is refreshed
    lead = old.groupBy("host", "sig").agg(F.min("trig_seq").alias("trig_seq"))
    target = lead.join(per.select("host", "sig", "last"), ["host", "sig"]).select("host", "trig_seq", "last")
    kept = old.drop("sig").join(target, ["host", "trig_seq"], "left")
    hit = F.col("last").isNotNull()
    new_val = {
        "path": "steps", "form": "form", "opens_at": "opens_at", "selector": "selector", "href": "href", "accept": "accept",
    }
    for c, src in new_val.items():
        kept = kept.withColumn(c, F.when(hit, F.col("last")[src]).otherwise(F.col(c)))
    kept = (
        kept.withColumn("kind", F.when(hit, F.coalesce(F.nullif(F.col("last.kind"), F.lit("")), F.lit("form"))).otherwise(F.col("kind")))
        .withColumn("cached_at", F.when(hit, stamp).otherwise(F.col("cached_at")))
        .withColumn("cache_source", F.when(hit, F.lit("live")).otherwise(F.col("cache_source")))
        .withColumn("stale", F.when(hit, F.lit(False)).otherwise(F.col("stale")))
        .drop("last")
    )
    fresh = per.join(lead.select("host", "sig"), ["host", "sig"], "left_anti")
    records = sig.join(fresh.select("host", "sig", F.col("first_rec").alias("rec_seq")), ["host", "sig", "rec_seq"], "left_semi")
    made, linked, ends = stitch(records, graphs)

    # ids are given in the order states were first needed
    uniq = first_by(made, ["host", "key"], ["rec_seq", "step"], ["rec_seq", "step", "u", "label", "depth"])
    ided = cut(allocate_ids(uniq, graphs.states, ["rec_seq", "step"]))
    base_seq = graphs.states.groupBy("host").agg(F.max("state_seq").alias("m"))
    num = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    none = lambda t: F.lit(None).cast(t)
    s_schema = {f.name: f.dataType for f in graphs.states.schema}
    add_states = ided.join(base_seq, "host", "left").select(
        "host", (F.coalesce("m", F.lit(-1)) + num).alias("state_seq"), "id", F.col("u").alias("url"), "label", F.col("depth").cast("int").alias("depth"),
        *[none(s_schema[c]).alias(c) for c in ("controls", "collections")],
    )
    names = ided.select("host", "key", F.col("id").alias("real"))

    def real(df, col):
        n = names.select("host", F.col("key").alias(col), F.col("real").alias("_r"))
        return df.join(n, ["host", col], "left").withColumn(col, F.coalesce("_r", col)).drop("_r")

    linked = real(real(linked, "src"), "dst")
    e_key = MERGE_EDGE_KEY
    new_edges = first_by(
        linked.withColumn("sel", F.coalesce("selector", F.lit("\0"))), ["host", "src", "dst", "sel"], ["rec_seq", "step"],
        ["rec_seq", "step", "label", "selector", "kind"],
    )
    have = graphs.edges.select("host", *e_key).withColumn("sel", F.coalesce("selector", F.lit("\0"))).drop("selector").distinct()
    new_edges = new_edges.join(have, ["host", "src", "dst", "sel"], "left_anti").drop("sel")
    top_edge = graphs.edges.groupBy("host").agg(F.max("edge_seq").alias("m"))
    from ..operators.rows import ordinal

    add_edges = ordinal(new_edges, ["host"], ["rec_seq", "step"], "n").join(top_edge, "host", "left").select(
        "host", (F.coalesce("m", F.lit(-1)) + F.col("n")).alias("edge_seq"), "src", "dst", "label", "selector", "kind"
    )
    ends = real(ends, "end")
    top_trig = graphs.triggers.groupBy("host").agg(F.max("trig_seq").alias("m"))
    add_triggers = fresh.withColumn("rec_seq", F.col("first_rec")).join(ends, ["host", "rec_seq"])
    add_triggers = ordinal(add_triggers, ["host"], ["rec_seq"], "n").join(top_trig, "host", "left").select(
        "host", (F.coalesce("m", F.lit(-1)) + F.col("n")).alias("trig_seq"), F.col("last.trigger").alias("label"), F.col("end").alias("state_id"),
        F.col("last.steps").alias("path"), F.col("last.form").alias("form"), F.col("last.opens_at").alias("opens_at"),
        F.coalesce(F.nullif(F.col("last.kind"), F.lit("")), F.lit("form")).alias("kind"), F.col("last.selector").alias("selector"),
        F.col("last.href").alias("href"), F.col("last.accept").alias("accept"), stamp.alias("cached_at"), F.lit("live").alias("cache_source"),
        F.lit(False).alias("stale"),
    )
    hits = per.groupBy("host").agg(F.sum("hits").cast("int").alias("hits"))
    meta = graphs.meta.join(hits, "host", "full").select(
        "host", F.coalesce("graph_kind", F.lit("interaction")).alias("graph_kind"), "start", "pages", "complete", "stopped",
        F.when(F.col("hits").isNotNull(), stamp).otherwise(F.col("last_live_update")).alias("last_live_update"),
        (F.coalesce("live_hits", F.lit(0)) + F.coalesce("hits", F.lit(0))).alias("live_hits"),
    )
    return Graphs(
        graphs.states.unionByName(add_states), graphs.edges.unionByName(add_edges), kept.unionByName(add_triggers), meta, graphs.errors
    )
