"""Counts, inventories and quality figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import labels, urls
from ..sources.graphs import Graphs
from .rows import last_by_id


def graph_summary(graphs: Graphs) -> DataFrame:
    """Kind and element counts per host.

    The element tables are reduced to their host column and counted in one
    aggregate, which every task combines before the shuffle.
    """
    def tagged(df, name):
        return df.select("host", F.lit(name).alias("what"))

    rows = tagged(graphs.states, "states").unionAll(tagged(graphs.edges, "edges")).unionAll(tagged(graphs.triggers, "triggers"))
    counts = rows.groupBy("host").agg(
        *[F.count_if(F.col("what") == n).alias(n) for n in ("states", "edges", "triggers")]
    )
    return (
        graphs.meta.select("host", "graph_kind").distinct().join(counts, "host", "left")
        .na.fill(0, ["states", "edges", "triggers"])
    )


def link_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = nodes.select("host", F.lit("nodes").alias("what")).unionAll(edges.select("host", F.lit("edges").alias("what")))
    return rows.groupBy("host").agg(
        F.lit("link").alias("graph_kind"), *[F.count_if(F.col("what") == n).alias(n) for n in ("nodes", "edges")]
    )


def hosts_index(summary: DataFrame, errors: DataFrame) -> DataFrame:
    """Summary of every host; a host that cannot be read is one row with its error."""
    return summary.withColumn("status", F.lit("ok")).unionByName(
        errors.select("host", "status", "error"), allowMissingColumns=True
    ).orderBy("host")


def crawl_meta(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node counts by type and the edge count per host."""
    rows = nodes.select("host", "type").unionAll(edges.select("host", F.lit("\0edge").alias("type")))
    named = {"pages": "page", "states": "state", "skipped": "skipped", "uploads": "upload", "downloads": "download"}
    return rows.groupBy("host").agg(
        *[F.count_if(F.col("type") == v).alias(k) for k, v in named.items()],
        F.count_if(F.col("type") == "\0edge").alias("edges"),
    )


def list_content(states: DataFrame) -> DataFrame:
    """Collections of each view, largest first, with a sample; row-local work."""
    ranked = F.array_sort(
        F.transform(
            "collections",
            lambda c, i: F.struct(
                (-F.coalesce(c["count"], F.lit(0))).alias("neg"), i.alias("i"), c["kind"].alias("kind"),
                F.coalesce(c["count"], F.lit(0)).alias("count"),
                F.coalesce(
                    F.when(F.size(c["items"]) > 0, labels.item_text(F.try_element_at(c["items"], F.lit(1))["t"], F.try_element_at(c["items"], F.lit(1))["cells"])),
                    F.lit(""),
                ).alias("sample"),
            ),
        )
    )
    return (
        states.where(F.size("collections") > 0)
        .select("host", "state_seq", _view_label().alias("view_label"), F.col("url").alias("view_url"), F.posexplode(ranked).alias("coll_rank", "c"))
        .select("host", "state_seq", "view_label", "view_url", "coll_rank", "c.kind", "c.count", "c.sample")
    )


def _view_label():
    return F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("(root)"))


def list_content_hosts(states: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Views and collections with content per host; ``empty`` hosts and errors keep a row."""
    has = F.coalesce(F.size("collections"), F.lit(0))
    out = states.groupBy("host").agg(
        F.count_if(has > 0).alias("views"), F.sum(F.greatest(has, F.lit(0))).cast("bigint").alias("collections")
    ).withColumn("status", F.when(F.col("views") > 0, "ok").otherwise("empty"))
    if errors is not None:
        out = out.unionByName(errors.select("host", "status"), allowMissingColumns=True)
    return out.orderBy("host")


def trigger_states(triggers: DataFrame, states: DataFrame) -> DataFrame:
    """Triggers with the url of their state; an unknown state keeps the row without one."""
    s = last_by_id(states, triggers.select("host", F.col("state_id").alias("id")), ["url"])
    s = s.select("host", F.col("id").alias("state_id"), F.col("url").alias("state_url"))
    return triggers.join(s, ["host", "state_id"], "left")


def list_forms(triggers: DataFrame, states: DataFrame) -> DataFrame:
    """Every trigger with its page, recorded click depth and field count."""
    return sort_forms(
        trigger_states(triggers, states).select(
            "host", "trig_seq", "label", "state_url",
            (F.greatest(F.coalesce(F.size("path"), F.lit(0)), F.lit(0)) + 1).alias("clicks"),
            F.col("form.fieldCount").alias("field_count"),
        )
    )


def sort_forms(forms: DataFrame) -> DataFrame:
    return forms.orderBy("host", F.coalesce("state_url", F.lit("")), F.lower("label"), "trig_seq")


def drop_dangling_triggers(triggers: DataFrame, states: DataFrame) -> DataFrame:
    return triggers.join(states.select("host", F.col("id").alias("state_id")).distinct(), ["host", "state_id"], "left_semi")


def drop_dangling_edges(edges: DataFrame, states: DataFrame) -> DataFrame:
    """Edges from a known state; an unknown end becomes null."""
    ids = states.select("host", "id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "src"), ["host", "src"], "left_semi")
    known = ids.withColumnRenamed("id", "dst").withColumn("_known", F.lit(True))
    return kept.join(known, ["host", "dst"], "left").withColumn("dst", F.when(F.col("_known"), F.col("dst"))).drop("_known")


def label_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the label of the node they lead to."""
    n = last_by_id(nodes.withColumn("to_label", labels.label_of("url", "title", "id")), edges.select("host", F.col("dst").alias("id")), ["to_label"], "node_seq")
    n = n.withColumnRenamed("id", "dst")
    return edges.join(n, ["host", "dst"], "left").withColumn("to_label", F.coalesce("to_label", "dst"))


def data_list_sections(links: DataFrame, minimum: int = K.DATA_LIST_MIN) -> DataFrame:
    """Sections to which a page has ``minimum`` or more same-host links."""
    href = urls.drop_fragment("href")
    own = links.where(href.startswith("http") & urls.same_host("href", "page_url"))
    return own.groupBy("page_id", urls.section_key(href).alias("section")).agg(F.count("*").alias("links")).where(
        F.col("links") >= minimum
    )


def dup_ratio(states: DataFrame) -> DataFrame:
    """States beyond one per normalised url.

    Distinct urls are found by a plain two-column aggregate first: unlike a
    ``count(distinct)`` grouped by host, its shuffle key includes the url, so a
    host with a third of all states spreads over all tasks.
    """
    per_url = states.groupBy("host", urls.norm_state_url("url").alias("u")).agg(F.count("*").alias("n"))
    return per_url.groupBy("host").agg(
        F.sum("n").cast("bigint").alias("states"), F.count("*").alias("urls"),
        (F.sum("n") - F.count("*")).cast("bigint").alias("dup"),
    )


def base_path_spread(states: DataFrame) -> DataFrame:
    base = F.split_part("url", F.lit("?"), F.lit(1))
    return states.groupBy("host", base.alias("b")).agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("spread"))


def verdict_totals(scenarios: DataFrame) -> DataFrame:
    v = F.coalesce("verdict", F.lit("unrated"))
    return scenarios.groupBy("host").agg(
        F.count("*").alias("total"), *[F.count_if(v == x).alias(f"n_{x}") for x in ("pass", "fail", "unrated")]
    )


def ledger_stats(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("scope").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes")
    )


def run_summary(run_events: DataFrame) -> DataFrame:
    """Status and counts of each run: an abort outranks an error, an error outranks ok."""
    return run_events.groupBy("run_id").agg(
        F.when(F.bool_or(F.col("status") == "aborted"), "aborted")
        .when(F.bool_or(F.col("status") == "error"), "error")
        .otherwise("ok")
        .alias("status"),
        F.count("*").alias("steps"),
        F.count_if((F.col("op") == "download") & (F.col("status") == "new")).alias("artifacts_new"),
        F.count_if((F.col("op") == "download") & (F.col("status") == "dupe")).alias("artifacts_dupe"),
    )


def section_counts(nodes: DataFrame) -> DataFrame:
    """Nodes per section; nodes without a url group by their type."""
    group = F.when(F.coalesce("url", F.lit("")) != "", urls.section_of("url")).otherwise(
        F.when(F.col("type") == "state", "states").when(F.col("type") == "upload", "uploads")
        .when(F.col("type") == "download", "downloads").otherwise("skipped")
    )
    return nodes.groupBy("host", group.alias("section")).agg(F.count("*").alias("nodes"))


def call_counts(call_log: DataFrame) -> DataFrame:
    """Calls, clicks and result per scenario of a call log."""
    return call_log.groupBy("scenario").agg(
        F.count("*").alias("calls"), F.count_if(F.col("call") == "click").alias("clicks"),
        F.coalesce(F.bool_or(F.col("found")), F.lit(False)).alias("found"),
    )


def dominant_collection(collections: DataFrame) -> DataFrame:
    """Kind of the largest collection of a view, the first of equals."""
    return collections.groupBy("page_id").agg(
        F.max_by("kind", F.struct("count", -F.col("coll_idx"))).alias("kind"), F.max("count").alias("count")
    )


def search_nodes(nodes: DataFrame, q: str) -> DataFrame:
    """Nodes whose url or label contains the text, whatever its case."""
    needle = q.lower().strip()
    label = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("url"), F.lit("")), F.col("id"))
    return nodes.where(
        F.lower(F.coalesce("url", F.lit(""))).contains(needle) | F.lower(label).contains(needle)
    )


def filter_types(nodes: DataFrame, hidden: list[str]) -> DataFrame:
    """Hide node types (``__state``, ``__skip``, ``__upload``, ``__download``) or sections."""
    key = (
        F.when(F.col("type") == "state", "__state").when(F.col("type") == "skipped", "__skip")
        .when(F.col("type") == "upload", "__upload").when(F.col("type") == "download", "__download")
        .otherwise(urls.section_of("url"))
    )
    return nodes.where(~key.isin(list(hidden))) if hidden else nodes


def by_mode(sessions: DataFrame, mode: str | None = None) -> DataFrame:
    if mode is None:
        return sessions
    return sessions.where(F.coalesce("mode", F.lit("workspace")) == mode)


def collect_items(items: DataFrame, kind: str | None = None) -> DataFrame:
    """Items of the captured collections, optionally of one kind, in captured order."""
    return items if kind is None else items.where(F.col("kind") == kind)


def newest_first(df: DataFrame, ts: str, *ties: str) -> DataFrame:
    """A newest-first listing; a range-partitioned sort, never a single task."""
    return df.orderBy(F.coalesce(F.col(ts).cast("string"), F.lit("")).desc(), *ties)
