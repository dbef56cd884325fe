"""Click paths between two pages of a link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import labels, urls
from ..operators.graph import all_simple_paths, path_steps, resolve_nodes, shortest_link_path, structural
from ..operators.rows import first_by, last_by_id
from ..operators.substring import containing
from ..session import cut


def link_paths(
    nodes: DataFrame, edges: DataFrame, pages: DataFrame, queries: DataFrame, only_structural: bool = False,
) -> DataFrame:
    """(q_id, host, frm, to) to one row each with status, click count and path."""
    needles = queries.select("host", F.explode(F.array("frm", "to")).alias("needle"))
    found = cut(resolve_nodes(needles, nodes))
    a = found.select("host", F.col("needle").alias("frm"), F.col("id").alias("src"), F.col("status").alias("s1"))
    b = found.select("host", F.col("needle").alias("to"), F.col("id").alias("dst"), F.col("status").alias("s2"))
    q = cut(queries.select("q_id", "host", "frm", "to").join(a, ["host", "frm"]).join(b, ["host", "to"]))
    e = structural(edges, pages) if only_structural else edges
    pairs = q.where("s1 = 'ok' and s2 = 'ok'").select("host", "src", "dst").distinct()
    best = shortest_link_path(e, pairs)
    out = q.join(best, ["host", "src", "dst"], "left")
    status = (
        F.when(F.col("s1") != "ok", F.concat(F.col("s1"), F.lit("_from")))
        .when(F.col("s2") != "ok", F.concat(F.col("s2"), F.lit("_to")))
        .when(F.col("clicks").isNull(), "no_path")
        .otherwise("ok")
    )
    return out.select("q_id", "host", "frm", "to", "src", "dst", status.alias("status"), "clicks", "path")


def link_path_steps(answers: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each step of the shortest paths with its label, kind and target."""
    n = nodes.withColumn("to_url", labels.label_of("url", "title", "id"))
    steps = path_steps(
        answers.where("status = 'ok'").select("q_id", "host", "path"),
        edges.select("host", "edge_seq", "dst", "label", "kind"), ["q_id", "host"],
    )
    n = last_by_id(n, steps.select("host", F.col("dst").alias("id")), ["to_url"], "node_seq").withColumnRenamed("id", "dst")
    return steps.join(n, ["host", "dst"], "left").select(
        "q_id", "host", "step", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("kind", F.lit("link")).alias("kind"),
        F.coalesce("to_url", "dst").alias("to_url"),
    )


def link_all_paths(answers: DataFrame, edges: DataFrame, max_len: int = K.MAX_PATH_LEN, max_paths: int = K.MAX_PATHS) -> DataFrame:
    pairs = answers.where("status = 'ok'").select("host", "src", "dst").distinct()
    return all_simple_paths(edges, pairs, max_len, max_paths)


def by_url(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(host, start_url, page_url) pairs to node ids: the last node of a url wins."""
    ids = nodes.groupBy("host", urls.norm_light("id").alias("k")).agg(F.max_by("id", "node_seq").alias("id"))
    keyed = pairs.withColumn("k1", urls.norm_light("start_url")).withColumn("k2", urls.norm_light("page_url"))
    return keyed.join(ids.select("host", F.col("k").alias("k1"), F.col("id").alias("src")), ["host", "k1"]).join(
        ids.select("host", F.col("k").alias("k2"), F.col("id").alias("dst")), ["host", "k2"]
    ).drop("k1", "k2")


def shortest_path(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shortest path between two urls; no row when an end is unknown or out of reach."""
    found = cut(by_url(nodes, pairs))
    return found.join(shortest_link_path(edges, found.select("host", "src", "dst").distinct()), ["host", "src", "dst"])


def resolve_inputs(nodes: DataFrame, inputs: DataFrame) -> DataFrame:
    """(host, text) to a node: exact url or label first, else the first that contains the text."""
    n = nodes.select(
        "host", "id", "node_seq", F.lower(F.coalesce("url", F.lit(""))).alias("u"),
        F.lower(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("url"), F.lit("")), F.col("id"))).alias("l"),
    )
    q = inputs.select("host", "text").distinct().withColumn("v", F.lower(F.trim("text"))).where(F.col("v") != "")
    exact = (F.col("u") == F.col("v")) | (F.col("l") == F.col("v"))
    # whatever is equal is contained too
    hits = containing(q, n.withColumn("both", F.concat_ws(" ", "u", "l")), "v", ["both"])
    both = hits.join(q, ["host", "v"]).select("host", "text", "id", "node_seq", F.when(exact, 0).otherwise(1).alias("p"))
    return first_by(both, ["host", "text"], ["p", "node_seq"], ["id"])


def path_between(nodes: DataFrame, edges: DataFrame, pages: DataFrame, asks: DataFrame, use_global: bool = False) -> DataFrame:
    """(host, a, b) to the shortest path, without global navigation unless asked."""
    found = cut(resolve_inputs(nodes, asks.select("host", F.explode(F.array("a", "b")).alias("text"))))
    p = asks.join(found.select("host", F.col("text").alias("a"), F.col("id").alias("src")), ["host", "a"]).join(
        found.select("host", F.col("text").alias("b"), F.col("id").alias("dst")), ["host", "b"]
    )
    e = edges if use_global else structural(edges, pages)
    return p.join(shortest_link_path(e, p.select("host", "src", "dst").distinct()), ["host", "src", "dst"], "left")
