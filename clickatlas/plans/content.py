"""Where a piece of content lives, over one host or all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import labels
from ..operators.graph import search, shown_paths, start_state
from ..operators.rows import last_by_id, top_n
from ..session import cut, few
from ..sources.graphs import Graphs


def items_table(states: DataFrame) -> DataFrame:
    """One row per captured item, in capture order."""
    c = states.where(F.size("collections") > 0).select(
        "host", F.col("id").alias("state_id"), "state_seq", F.posexplode("collections").alias("coll_idx", "c")
    )
    return c.select("host", "state_id", "state_seq", "coll_idx", "c.kind", F.posexplode("c.items").alias("item_idx", "i")).select(
        "host", "state_id", "state_seq", "coll_idx", "item_idx", "kind", labels.item_text(F.col("i.t"), F.col("i.cells")).alias("text"),
        "i.t", "i.cells", "i.level",
    )


def matching_items(states: DataFrame, text: str) -> DataFrame:
    return items_table(states).where(F.lower("text").contains(text.lower())).select(
        "host", "state_id", "state_seq", "coll_idx", "item_idx", "kind", "text"
    )


def rank_views(views: DataFrame) -> DataFrame:
    """Nearest view first, unreachable ones last; equal distances in capture order."""
    return views.withColumn("sort_distance", F.coalesce("distance", F.lit(K.UNREACHABLE)))


def find_content(
    graphs: Graphs, text: str, starts: DataFrame | None = None, limit: int = K.CONTENT_LIMIT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hosts, views, items) for a text, host by host.

    Items are scanned once for all hosts.  A host shows at most ``limit`` items,
    nearest view first; every view holds at least one, so only ``limit`` views of
    a host are ever ranked and the running budget is a window over those few.
    """
    hits = cut(matching_items(graphs.states, text))
    if starts is None:
        roots = start_state(graphs.states)
    else:
        roots = start_state(graphs.states, starts, "first").select("host", "state_id")
    roots = cut(roots.select("host", F.col("state_id").alias("root")))
    per_view = hits.groupBy("host", "state_id", "state_seq").agg(F.count("*").alias("matches"))
    per_view = per_view.join(roots, "host")
    wanted = per_view.select("host", "root", F.col("state_id").alias("node"))
    reached = search(graphs.edges, wanted.select("host", "root"), targets=wanted, paths=False)
    far = reached.rows.select("host", "root", F.col("node").alias("state_id"), F.col("depth").alias("distance"))
    per_view = rank_views(per_view.join(far, ["host", "root", "state_id"], "left"))
    totals = per_view.groupBy("host").agg(
        F.sum("matches").cast("bigint").alias("total_matches"), F.count("*").alias("views_matched")
    )
    best = top_n(per_view, ["host"], ["sort_distance", "state_seq"], max(limit, 1), rank="view_rank")
    run = Window.partitionBy("host").orderBy("view_rank").rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("before", F.coalesce(F.sum("matches").over(run), F.lit(0))).where(
        (F.col("before") < limit) | (F.col("view_rank") == 1)
    )
    best = best.withColumn("shown", F.least("matches", F.greatest(F.lit(limit) - F.col("before"), F.lit(0))))
    best = few(best)
    # whole paths of the shown views only
    paths = shown_paths(graphs.edges, reached, best.select("host", "root", F.col("state_id").alias("node")))
    best = few(best.join(few(paths).withColumnRenamed("node", "state_id"), ["host", "root", "state_id"], "left"))
    st = last_by_id(graphs.states, best.select("host", F.col("state_id").alias("id")), ["url", "label"]).withColumnRenamed("id", "state_id")
    views = best.join(st, ["host", "state_id"]).select(
        "host", "state_id", "view_rank", F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("(root)")).alias("view_label"),
        F.col("url").alias("view_url"), F.col("distance").isNotNull().alias("reachable"), F.col("distance").alias("distance_clicks"),
        "matches", "shown", (F.col("shown") < F.col("matches")).alias("truncated"), "root", "path",
    )
    views = cut(views)
    ranked = top_n(hits, ["host", "state_id"], ["coll_idx", "item_idx"], max(limit, 1), rank="item_rank")
    items = ranked.join(views.select("host", "state_id", "view_rank", "shown"), ["host", "state_id"]).where(
        F.col("item_rank") <= F.col("shown")
    ).select("host", "view_rank", "state_id", "item_rank", "kind", "text")
    hosts = graphs.states.select("host").distinct().join(totals, "host", "left").select(
        "host", F.when(F.col("total_matches").isNull(), "no_match").otherwise("ok").alias("status"),
        F.coalesce("total_matches", F.lit(0)).alias("total_matches"), F.coalesce("views_matched", F.lit(0)).alias("views_matched"),
    )
    return hosts, views, items


def find_content_hosts(
    graphs: Graphs, text: str, limit: int = K.CONTENT_LIMIT
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(summary, per_host, views, items) over all hosts, budgeted once more across them."""
    hosts, views, items = find_content(graphs, text, None, limit)
    per_host = hosts.select("host", "status", F.col("total_matches").alias("matches")).unionByName(
        graphs.errors.select("host", "status"), allowMissingColumns=True
    )
    merged = rank_views_hosts(views)
    # at most `limit` views can be shown: a top-k, then a window over those rows
    best = merged.limit(max(limit, 1)) if limit > 0 else merged.limit(0)
    keyed = Window.orderBy(*_MERGED_ORDER)
    best = best.withColumn("rank", F.row_number().over(keyed)).withColumn(
        "before", F.coalesce(F.sum("shown").over(keyed.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).where(F.col("before") < limit)
    best = best.withColumn("take", F.least("shown", F.lit(limit) - F.col("before")))
    best = cut(best.withColumn("truncated", F.col("truncated") | (F.col("take") < F.col("shown"))))
    out_items = items.join(best.select("host", "state_id", "rank", "take"), ["host", "state_id"]).where(
        F.col("item_rank") <= F.col("take")
    ).select("rank", "host", "state_id", "item_rank", "kind", "text")
    # one row of totals: the three sources are stacked and summed together
    def tally(df, **cols):
        names = ("hosts_searched", "hosts_matched", "hosts_errored", "total_matches", "views_matched", "views_shown", "shown")
        return df.select(*[cols.get(n, F.lit(0)).cast("bigint").alias(n) for n in names])

    is_ = lambda s: F.when(F.col("status") == s, 1).otherwise(0)
    rows = (
        tally(per_host, hosts_searched=F.lit(1), hosts_matched=is_("ok"), hosts_errored=is_("error"),
              total_matches=F.coalesce("matches", F.lit(0)))
        .unionAll(tally(views, views_matched=F.lit(1)))
        .unionAll(tally(best, views_shown=F.lit(1), shown=F.col("take")))
    )
    summary = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in rows.columns])
    summary = summary.withColumn("views_omitted", F.col("views_matched") - F.col("views_shown")).withColumn(
        "status", F.when(F.col("hosts_matched") > 0, "ok").otherwise("no_match")
    )
    return summary, per_host, best.drop("before"), out_items


_MERGED_ORDER = ["unreachable", "sort_distance", "host", "sort_url", "view_rank"]


def rank_views_hosts(views: DataFrame) -> DataFrame:
    """Views of many hosts: reachable first, then by distance, host and url."""
    return (
        views.withColumn("unreachable", F.when(F.col("reachable"), 0).otherwise(1))
        .withColumn("sort_distance", F.coalesce("distance_clicks", F.lit(K.UNREACHABLE)))
        .withColumn("sort_url", F.coalesce("view_url", F.lit("")))
        .orderBy(*_MERGED_ORDER)
    )
