"""Graph tables, searches and inventories over the derived site graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import graph as G
from ..operators.sets import merge_tables
from ..plans import linkpaths as P
from ..sources import graphs as S
from ..session import cut, work_dir
from . import derive as D
from . import graph_sql as Q
from .registry import query

big = lambda c: F.col(c).cast("bigint").alias(c)

_SUMMARY = f"""WITH {Q.EDGES}, {Q.STATES}, {Q.TRIGGERS}
SELECT host, 'interaction' AS graph_kind, (SELECT count(*) FROM states s WHERE s.host = h.host) AS states, (SELECT count(*) FROM edges e WHERE e.host = h.host) AS edges,
  (SELECT count(*) FROM triggers t WHERE t.host = h.host) AS triggers FROM (SELECT 'shop' || n_nationkey || '.example.com' AS host FROM nation) h"""


@query("graph_summary", _SUMMARY)
def graph_summary(spark, sf):
    return A.graph_summary(D.graphs(spark, sf, with_items=False))


@query("link_summary", f"""WITH {Q.EDGES}, {Q.STATES} SELECT host, 'link' AS graph_kind, n AS nodes, e AS edges FROM
 (SELECT host, count(*) AS n FROM states GROUP BY 1) JOIN (SELECT host, count(*) AS e FROM edges GROUP BY 1) USING (host)""")
def link_summary(spark, sf):
    nodes, edges, _ = D.link_graph(spark, sf)
    return A.link_summary(nodes, edges)


@query("hosts_index", f"""WITH x AS ({_SUMMARY}) SELECT host, CASE WHEN c THEN NULL ELSE graph_kind END AS graph_kind, CASE WHEN c THEN -1 ELSE states END AS states,
  CASE WHEN c THEN 'error' ELSE 'ok' END AS status FROM (SELECT *, host LIKE '%3.example.com' AS c FROM x)""")
def hosts_index(spark, sf):
    g = D.graphs(spark, sf, with_items=False)
    bad = F.col("host").like("%3.example.com")
    errors = g.meta.where(bad).select("host", F.lit("error").alias("status"), F.lit("unreadable document").alias("error"))
    index = A.hosts_index(A.graph_summary(g).where(~bad), errors)
    return index.select("host", "graph_kind", F.coalesce("states", F.lit(-1)).alias("states"), "status")


def _torn(docs, broken, n):
    """Documents in pieces, of which the ``broken`` ones lose their last ``n`` characters."""
    sizes = docs.where(broken).select("host", "piece", F.length("document").alias("size"))
    later = Window.partitionBy("host").orderBy(F.col("piece").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lost = sizes.withColumn("lost", F.lit(n) - F.coalesce(F.sum("size").over(later), F.lit(0))).where("lost > 0").select("host", "piece", "lost")
    kept = F.substring("document", F.lit(1), F.greatest(F.length("document") - F.coalesce("lost", F.lit(0)), F.lit(0)).cast("int"))
    return docs.join(F.broadcast(lost), ["host", "piece"], "left").select("host", "piece", F.when(F.col("lost").isNull(), F.col("document")).otherwise(kept).alias("document"))


def _documents(spark, sf):
    g = D.graphs(spark, sf, False, D.stored_lines(spark, sf))
    # every document whose host number ends in 7 is cut off in the middle
    return _torn(S.to_documents(g), F.col("host").like("%7.example.com"), 9)


@query("read_graph_documents", f"""WITH x AS ({_SUMMARY}) SELECT host, states, edges, triggers FROM x WHERE host NOT LIKE '%7.example.com'""")
def read_graph_documents(spark, sf):
    g = S.graphs_from_documents(_documents(spark, sf))
    return A.graph_summary(g).select("host", "states", "edges", "triggers")


# the same documents as files, some cut off in the middle
@query("document_files", f"""WITH x AS ({_SUMMARY}) SELECT host, CASE WHEN c THEN -1 ELSE states END AS states, CASE WHEN c THEN -1 ELSE edges END AS edges, CASE WHEN c THEN -1 ELSE triggers END AS triggers,
  CASE WHEN c THEN 'unreadable document' ELSE '' END AS error FROM (SELECT *, host LIKE '%7.example.com' AS c FROM x)""")
def document_files(spark, sf):
    path = work_dir(spark)
    S.write_documents(_documents(spark, sf), path)
    g = S.read_graphs(spark, path)
    none = F.lit(-1).cast("bigint")
    good = A.graph_summary(g).select("host", "states", "edges", "triggers", F.lit("").alias("error"))
    return good.unionByName(g.errors.select("host", none.alias("states"), none.alias("edges"), none.alias("triggers"), "error"))


def _link_documents(g):
    nodes, edges, pages = D.links(g)
    start = pages.withColumn("start", F.concat(F.lit("https://"), F.col("host"), F.lit("/")))
    return S.link_documents(nodes, edges, cut(start))


@query("link_document_files", f"""WITH {Q.EDGES}, {Q.STATES}, n AS (SELECT host, count(*) AS nodes, arg_max(id, state_seq) AS last_id FROM states GROUP BY 1), e AS (SELECT host, count(*) AS edges, arg_max(dst, edge_seq) AS last_dst FROM edges GROUP BY 1),
x AS (SELECT *, host LIKE '%4.example.com' AS c FROM n JOIN e USING (host))
SELECT host, CASE WHEN c THEN -1 ELSE nodes END AS nodes, CASE WHEN c THEN -1 ELSE edges END AS edges, CASE WHEN c THEN -1 ELSE nodes END AS pages, CASE WHEN NOT c THEN last_id END AS last_id, CASE WHEN NOT c THEN last_dst END AS last_dst,
  CASE WHEN c THEN 'unreadable document' ELSE '' END AS error FROM x""")
def link_document_files(spark, sf):
    path = work_dir(spark)
    S.write_documents(_torn(_link_documents(D.stored_graphs(spark, sf)), F.col("host").like("%4.example.com"), 5), path)
    g = S.read_link_graphs(spark, path)
    n = g.nodes.groupBy("host").agg(F.count("*").alias("nodes"), F.max_by("id", "node_seq").alias("last_id"))
    e = g.edges.groupBy("host").agg(F.count("*").alias("edges"), F.max_by("dst", "edge_seq").alias("last_dst"))
    both = n.join(e, "host").join(g.meta.select("host", "pages"), "host").join(g.errors.select("host", "error"), "host", "full")
    count = lambda c: F.coalesce(c, F.lit(-1)).cast("bigint").alias(c)
    return both.select("host", count("nodes"), count("edges"), count("pages"), "last_id", "last_dst", F.coalesce("error", F.lit("")).alias("error"))


# even nations store an interaction graph, odd ones a link graph, in one folder
@query("document_kinds", f"""WITH x AS ({_SUMMARY}) SELECT host, CASE WHEN odd THEN 'link' ELSE 'interaction' END AS graph_kind, CASE WHEN odd THEN 0 ELSE states END AS states, edges, CASE WHEN odd THEN 0 ELSE triggers END AS triggers,
  CASE WHEN odd THEN states ELSE 0 END AS nodes FROM (SELECT *, regexp_extract(host, '[0-9]+')::INT % 2 = 1 AS odd FROM x)""")
def document_kinds(spark, sf):
    path = work_dir(spark)
    odd = F.regexp_extract("host", "[0-9]+", 0).cast("int") % 2 == 1
    g = D.stored_graphs(spark, sf)
    even, odds = (g._replace(**{t: getattr(g, t).where(c) for t in ("states", "edges", "triggers", "meta")}) for c in (~odd, odd))
    S.write_documents(S.to_documents(even).unionByName(_link_documents(odds)), path)
    return S.summarize_documents(spark, path)


@query("corrupt_documents", """SELECT 'shop' || n_nationkey || '.example.com' AS host, 'error' AS status FROM nation WHERE n_nationkey % 10 = 7""")
def corrupt_documents(spark, sf):
    return S.graphs_from_documents(_documents(spark, sf)).errors.select("host", "status")


@query("stored_graph_tables", _SUMMARY)
def stored_graph_tables(spark, sf):
    path = work_dir(spark)
    S.write_graphs(D.graphs(spark, sf, with_items=False), path)
    return A.graph_summary(S.read_tables(spark, path))


# nations with an odd key are written again with their root page alone; all their other rows must go.  The first try of either write dies before its commit
@query("replaced_graphs", f"""WITH x AS ({_SUMMARY}), k AS (SELECT *, regexp_extract(host, '[0-9]+')::INT % 2 = 1 AS odd FROM x)
SELECT host, CASE WHEN odd THEN 1 ELSE states END AS states, CASE WHEN odd THEN 0 ELSE edges END AS edges, CASE WHEN odd THEN 0 ELSE triggers END AS triggers FROM k""")
def replaced_graphs(spark, sf):
    path = work_dir(spark)
    full = D.stored_graphs(spark, sf)
    S.stage_graphs(full, path)
    S.write_graphs(full, path)
    g = S.read_tables(spark, path)
    odd = F.regexp_extract("host", "[0-9]+", 0).cast("int") % 2 == 1
    less = g._replace(states=g.states.where(odd & (F.col("id") == "root")), edges=g.edges.where("false"), triggers=g.triggers.where("false"), meta=g.meta.where(odd))
    S.stage_graphs(less, path)
    S.write_graphs(less, path)
    S.drop_old_versions(spark, path)
    return A.graph_summary(S.read_tables(spark, path)).select("host", "states", "edges", "triggers")


@query("document_round_trip", f"""WITH {Q.LN}, {Q.STATES}, {Q.TRIGGERS}
SELECT h.host, (SELECT count(*) FROM states s WHERE s.host = h.host AND s.state_seq % 2 = 0) AS controls, 7::BIGINT AS live_hits, 3::BIGINT AS pages, '2026-01-02 03:04:05.000006' AS last_live_update,
  (SELECT count(*) FROM triggers t WHERE t.host = h.host AND t.trig_seq % 3 = 0) AS cached, (SELECT count(*) FROM triggers t WHERE t.host = h.host AND t.trig_seq % 3 = 1) AS stale,
  (SELECT sum(length(label) + trig_seq) FROM triggers t WHERE t.host = h.host)::BIGINT AS digest FROM (SELECT 'shop' || n_nationkey || '.example.com' AS host FROM nation) h""")
def document_round_trip(spark, sf):
    g = D.graphs(spark, sf, False, D.stored_lines(spark, sf))
    stamp = F.lit("2026-01-02 03:04:05.000006").cast("timestamp")
    control = F.expr("array(named_struct('selector', '#a', 'text', id, 'tag', 'a', 'role', '', 'href', '', 'nav', true, 'bulk', false))")
    k = F.col("trig_seq") % 3
    g = g._replace(
        states=g.states.withColumn("controls", F.when(F.col("state_seq") % 2 == 0, control)),
        triggers=g.triggers.withColumns({"cached_at": F.when(k == 0, stamp), "cache_source": F.when(k == 0, "live"), "stale": k == 1}),
        meta=g.meta.withColumns({"last_live_update": stamp, "live_hits": F.lit(7), "pages": F.lit(3), "complete": F.lit(False), "stopped": F.lit("budget")}),
    )
    b = S.graphs_from_documents(S.to_documents(g))
    n = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    st = b.states.groupBy("host").agg(n(F.get("controls", F.lit(0))["text"] == F.col("id"), "controls"))
    # documents number triggers anew; their own numbers are the part keys of their states
    tr = b.triggers.withColumn("trig_seq", F.substring("state_id", 3, 20).cast("bigint")).groupBy("host").agg(
        n((F.col("cached_at") == stamp) & (F.col("cache_source") == "live"), "cached"), n(F.col("stale"), "stale"), F.sum(F.length("label") + F.col("trig_seq")).alias("digest"))
    m = b.meta.where("complete = false AND stopped = 'budget'").select("host", big("live_hits"), big("pages"), F.date_format("last_live_update", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_live_update"))
    return m.join(st, "host", "left").join(tr, "host", "left").fillna(0, ["controls", "cached", "stale"])


@query("host_list", "SELECT DISTINCT 'shop' || n_nationkey || '.example.com' AS host FROM nation")
def host_list(spark, sf):
    return S.hosts(D.graphs(spark, sf, with_items=False).meta)


@query("list_content", f"""WITH {Q.LN}, {Q.ITEMS}, c AS (SELECT host, state_id, coll_idx, kind, count(*) AS n, arg_min(text, item_idx) AS sample FROM items GROUP BY 1, 2, 3, 4)
SELECT host, 'Supplier ' || substr(state_id, 3) AS view_label, row_number() OVER (PARTITION BY host, state_id ORDER BY n DESC, coll_idx) - 1 AS coll_rank, kind, n AS count, sample FROM c""")
def list_content(spark, sf):
    return A.list_content(D.graphs(spark, sf).states).select("host", "view_label", big("coll_rank"), "kind", big("count"), "sample")


@query("list_content_hosts", f"""WITH {Q.LN}, {Q.ITEMS} SELECT host, count(DISTINCT state_id) AS views, count(DISTINCT (state_id, coll_idx)) AS collections, 'ok' AS status FROM items GROUP BY 1
UNION ALL SELECT 'zz.example.com', -1, -1, 'error'""")
def list_content_hosts(spark, sf):
    g = D.graphs(spark, sf)
    errors = g.meta.limit(1).select(F.lit("zz.example.com").alias("host"), F.lit("error").alias("status"))
    out = A.list_content_hosts(g.states, errors)
    return out.select("host", *[F.coalesce(c, F.lit(-1)).cast("bigint").alias(c) for c in ("views", "collections")], "status")


_FORMS = f"""WITH {Q.LN}, {Q.TRIGGERS} SELECT host, trig_seq, label, 'https://' || host || '/p/' || trig_seq || '/' AS state_url, (npath + 1)::BIGINT AS clicks, CASE WHEN fc < 0 THEN -1 ELSE fc END::BIGINT AS field_count FROM triggers"""


@query("list_forms", _FORMS)
def list_forms(spark, sf):
    g = D.graphs(spark, sf, with_items=False)
    return A.list_forms(g.triggers, g.states).select(
        "host", "trig_seq", "label", "state_url", big("clicks"), F.coalesce("field_count", F.lit(-1)).cast("bigint").alias("field_count")
    )


@query("dangling_triggers", f"WITH {Q.LN}, {Q.TRIGGERS} SELECT host, trig_seq FROM triggers WHERE trig_seq % 2 = 1")
def dangling_triggers(spark, sf):
    g = D.graphs(spark, sf, with_items=False)
    known = g.states.where(F.col("id").startswith("p:") & (F.substring("id", 3, 20).cast("bigint") % 2 == 1))
    return A.drop_dangling_triggers(g.triggers, known).select("host", "trig_seq")


@query("dangling_edges", f"WITH {Q.EDGES} SELECT host, src, CASE WHEN dst LIKE 's:%' THEN NULL ELSE dst END AS dst, edge_seq FROM edges WHERE src NOT LIKE 's:%'")
def dangling_edges(spark, sf):
    g = D.graphs(spark, sf, with_items=False)
    return A.drop_dangling_edges(g.edges, g.states.where(~F.col("id").startswith("s:"))).select("host", "src", "dst", "edge_seq")


@query("labelled_edges", f"WITH {Q.EDGES}, {Q.STATES} SELECT e.host, e.edge_seq, e.label, e.kind, CASE WHEN s.id LIKE 's:%' THEN s.label ELSE s.url END AS to_label FROM edges e JOIN states s ON s.host = e.host AND s.id = e.dst")
def labelled_edges(spark, sf):
    nodes, edges, _ = D.link_graph(spark, sf)
    return A.label_edges(edges, nodes).select("host", "edge_seq", "label", "kind", "to_label")


@query("node_degrees", f"""WITH {Q.EDGES}, {Q.STATES}, d AS (SELECT host, id, sum(i) AS i, sum(o) AS o FROM (SELECT host, dst AS id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT host, src, 0, 1 FROM edges) GROUP BY 1, 2)
SELECT s.host, s.id, coalesce(i, 0)::BIGINT AS in_degree, coalesce(o, 0)::BIGINT AS out_degree, coalesce(i + o, 0)::BIGINT AS degree,
  floor(16 + least(34, sqrt(greatest(coalesce(i + o, 0), 1)) * 5))::BIGINT AS node_size FROM states s LEFT JOIN d USING (host, id)""")
def node_degrees(spark, sf):
    nodes, edges, _ = D.link_graph(spark, sf)
    return G.degrees(edges, nodes).withColumn("node_size", F.floor(G.node_size("degree")).cast("bigint"))


_HUB = f"""{Q.EDGES}, {Q.STATES}, pg AS (SELECT host, count(*) // 100 AS pages FROM states GROUP BY 1),
hub AS (SELECT host, dst FROM edges GROUP BY 1, 2 HAVING count(*) >= greatest(8, 0.4 * (SELECT pages FROM pg WHERE pg.host = edges.host)))"""


def _hub_pages(pages):
    # a hundredth of the page count puts the suppliers above the bound
    return pages.select("host", F.floor(F.col("pages") / 100).alias("pages"))


@query("hub_edges", f"WITH {_HUB} SELECT e.host, edge_seq, h.dst IS NOT NULL AS glob FROM edges e LEFT JOIN hub h ON h.host = e.host AND h.dst = e.dst")
def hub_edges(spark, sf):
    _, edges, pages = D.link_graph(spark, sf)
    return G.hub_edges(edges, _hub_pages(pages)).select("host", "edge_seq", "glob")


@query("structural_edges", f"WITH {_HUB} SELECT e.host, count(*) AS edges FROM edges e WHERE (e.host, e.dst) NOT IN (SELECT host, dst FROM hub) GROUP BY 1")
def structural_edges(spark, sf):
    _, edges, pages = D.link_graph(spark, sf)
    return G.structural(edges, _hub_pages(pages)).groupBy("host").agg(F.count("*").alias("edges"))


@query("neighbourhoods", f"""WITH {Q.EDGES}, {Q.STATES}, b AS (SELECT host, src AS id, dst AS other, 'out' AS direction, edge_seq, kind FROM edges UNION ALL SELECT host, dst, src, 'in', edge_seq, kind FROM edges),
f AS (SELECT host, id, other, direction, arg_min(kind, edge_seq) AS kind FROM b GROUP BY 1, 2, 3, 4)
SELECT f.*, s.label AS other_title FROM f LEFT JOIN states s ON s.host = f.host AND s.id = f.other""")
def neighbourhoods(spark, sf):
    nodes, edges, _ = D.link_graph(spark, sf)
    return G.neighbourhood(edges, nodes).select("host", "id", "other", "direction", "kind", "other_title")


# --- searches ----------------------------------------------------------------------------

_ROOTS = "roots AS (SELECT DISTINCT host, 'root' AS root FROM edges)"


@query("bfs_paths", f"WITH {Q.EDGES}, {_ROOTS}, {Q.bfs('roots')} SELECT host, node, depth::BIGINT AS depth, array_to_string(path, ',') AS path FROM reached")
def bfs_paths(spark, sf):
    e = cut(D.graphs(spark, sf, with_items=False).edges)
    roots = e.select("host", F.lit("root").alias("root")).distinct()
    return G.bfs(e, roots).select("host", "node", big("depth"), F.array_join("path", ",").alias("path"))


@query("bfs_bounded", f"WITH {Q.EDGES}, {_ROOTS}, {Q.bfs('roots', levels=3)} SELECT host, depth::BIGINT AS depth, count(*) AS nodes FROM reached GROUP BY 1, 2")
def bfs_bounded(spark, sf):
    e = cut(D.graphs(spark, sf, with_items=False).edges)
    roots = e.select("host", F.lit("root").alias("root")).distinct()
    # a low bound spreads the root's edges as those of a hub node
    return G.bfs(e, roots, max_depth=3, hot_degree=20).groupBy("host", big("depth")).agg(F.count("*").alias("nodes"))


@query("frontier_step", f"WITH {Q.EDGES} SELECT host, dst AS node, min(edge_seq) AS via FROM edges WHERE src LIKE 'c:%' AND dst <> 'p:1' GROUP BY 1, 2")
def frontier_step(spark, sf):
    e = D.graphs(spark, sf, with_items=False).edges
    frontier = e.where("src = 'root'").select(
        "host", F.lit("root").alias("root"), F.col("dst").alias("node"), F.expr("cast(array() as array<bigint>)").alias("path")
    )
    visited = e.select("host", F.lit("root").alias("root"), F.lit("p:1").alias("node")).distinct()
    return G.expand_frontier(frontier, e, visited).select("host", "node", F.col("path")[0].alias("via"))


@query("discovery_ranks", f"""WITH {Q.EDGES}, {_ROOTS}, {Q.bfs('roots')} SELECT host, node, row_number() OVER (PARTITION BY host ORDER BY depth, path) AS rank FROM reached""")
def discovery_ranks(spark, sf):
    from ..operators.rows import ordinal

    e = cut(D.graphs(spark, sf, with_items=False).edges)
    reached = G.bfs(e, e.select("host", F.lit("root").alias("root")).distinct())
    return ordinal(reached, ["host"], ["depth", "path"], "rank").select("host", "node", big("rank"))


@query("start_states", f"""WITH {Q.LN}, {Q.STATES}, f AS (SELECT host, min(c) AS c FROM cust GROUP BY 1), s AS (SELECT host, c, unnest([1, 2, 3, 4, 5]) AS k FROM f)
SELECT host, k::BIGINT AS k, CASE k WHEN 1 THEN 'root' WHEN 2 THEN 'c:' || c WHEN 3 THEN 'c:' || c WHEN 4 THEN 'root' ELSE 'root' END AS state_id FROM s""")
def start_states(spark, sf):
    g = D.graphs(spark, sf, with_items=False)
    c = D.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c")).select(D.host_of("c_nationkey").alias("host"), "c")
    url = F.concat(F.lit("https://"), F.col("host"), F.lit("/c/"), F.col("c").cast("string"))
    asks = c.select("host", F.posexplode(F.array(
        F.lit(""), F.concat(url, F.lit("?ref=x")), F.concat(url, F.lit("?other=1")), F.lit("https://nowhere.example.org/none"),
        F.concat(F.lit("https://"), F.col("host"), F.lit("//#top")))).alias("k", "start"))
    out = G.start_state(g.states, asks)
    return out.join(asks, ["host", "start"]).select("host", (F.col("k") + 1).cast("bigint").alias("k"), "state_id")


# every host: shortest and simple paths from the root to its lowest and highest ordered part
_PAIRS = """pairs AS (SELECT host, 'root' AS src, unnest(['p:' || min(p), 'p:' || max(p), 'root']) AS dst FROM ln GROUP BY 1)"""


def _pairs(ln):
    ln = ln.groupBy("host").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    part = lambda c: F.concat(F.lit("p:"), F.col(c).cast("string"))
    return ln.select("host", F.lit("root").alias("src"), F.explode(F.array(part("a"), part("b"), F.lit("root"))).alias("dst"))


@query("shortest_paths", f"WITH {Q.EDGES}, {_PAIRS}, {_ROOTS}, {Q.bfs('roots')} SELECT p.host, p.dst, depth::BIGINT AS clicks, array_to_string(path, ',') AS path FROM pairs p JOIN reached r ON r.host = p.host AND r.node = p.dst")
def shortest_paths(spark, sf):
    ln = cut(D.lines(spark, sf))
    return G.shortest_link_path(D.graphs(spark, sf, with_items=False, ln=ln).edges, _pairs(ln)).select("host", "dst", big("clicks"), F.array_join("path", ",").alias("path"))


@query("structural_paths", f"""WITH {_HUB}, keep AS MATERIALIZED (SELECT * FROM edges e WHERE (e.host, e.dst) NOT IN (SELECT host, dst FROM hub)), {_PAIRS}, {_ROOTS}, {Q.bfs('roots', 'keep')}
SELECT p.host, p.dst, depth::BIGINT AS clicks, array_to_string(path, ',') AS path FROM pairs p JOIN reached r ON r.host = p.host AND r.node = p.dst""")
def structural_paths(spark, sf):
    ln = cut(D.lines(spark, sf))
    _, edges, pages = D.link_graph(spark, sf, ln)
    e = G.structural(cut(edges.select("host", "src", "dst", "edge_seq")), _hub_pages(pages))
    return G.shortest_link_path(e, _pairs(ln)).select("host", "dst", big("clicks"), F.array_join("path", ",").alias("path"))


_WALK_STEPS = """w1 AS (SELECT p.host, p.dst AS goal, e.dst AS node, [p.src, e.dst] AS nodes, [e.edge_seq] AS path FROM pairs p JOIN edges e ON e.host = p.host AND e.src = p.src WHERE p.src <> p.dst),
w2 AS (SELECT w.host, goal, e.dst AS node, list_append(nodes, e.dst) AS nodes, list_append(path, e.edge_seq) AS path FROM w1 w JOIN edges e ON e.host = w.host AND e.src = w.node WHERE NOT list_contains(nodes, e.dst) AND w.node <> goal),
w3 AS (SELECT w.host, goal, e.dst AS node, list_append(nodes, e.dst) AS nodes, list_append(path, e.edge_seq) AS path FROM w2 w JOIN edges e ON e.host = w.host AND e.src = w.node WHERE NOT list_contains(nodes, e.dst) AND w.node <> goal),
w4 AS (SELECT w.host, goal, e.dst AS node, list_append(nodes, e.dst) AS nodes, list_append(path, e.edge_seq) AS path FROM w3 w JOIN edges e ON e.host = w.host AND e.src = w.node WHERE NOT list_contains(nodes, e.dst) AND w.node <> goal),
walks AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3 UNION ALL SELECT * FROM w4)"""
_WALKS = f"{Q.EDGES}, {_PAIRS}, {_WALK_STEPS}"


@query("simple_paths", f"""WITH {_WALKS} SELECT host, goal AS dst, len(path)::BIGINT AS clicks, array_to_string(nodes, '>') AS nodes, row_number() OVER (PARTITION BY host, goal ORDER BY path DESC) AS walk_rank
FROM walks WHERE node = goal QUALIFY row_number() OVER (PARTITION BY host, goal ORDER BY path DESC) <= 7""")
def simple_paths(spark, sf):
    ln = cut(D.lines(spark, sf))
    e = cut(D.graphs(spark, sf, with_items=False, ln=ln).edges)
    out = G.all_simple_paths(e, _pairs(ln), max_len=4, max_paths=7)
    return out.select("host", "dst", big("clicks"), F.array_join("nodes", ">").alias("nodes"), big("walk_rank"))


_NEEDLES = ("p:7", "Supplier 1", "/c/1", "zzz", "root", "gear")
_RESOLVED = f"""{Q.EDGES}, {Q.STATES}, nodes AS (SELECT host, id, state_seq AS node_seq, CASE WHEN id LIKE 's:%' THEN '' ELSE url END AS url, label AS title FROM states),
ask AS (SELECT host, unnest([{', '.join(f"'{n}'" for n in _NEEDLES)}]) AS needle FROM (SELECT DISTINCT host FROM cust)),
hits AS (SELECT a.host, a.needle, n.id, n.node_seq, n.id = a.needle AS exact, contains(lower(CASE WHEN url = '' THEN id ELSE url END), lower(needle)) OR contains(lower(title), lower(needle)) AS hit,
  ends_with(rtrim(CASE WHEN url = '' THEN id ELSE url END, '/'), rtrim(needle, '/')) AS sfx FROM ask a JOIN nodes n USING (host)),
res AS (SELECT host, needle, max(id) FILTER (WHERE exact) AS x, count(*) FILTER (WHERE hit) AS n, max(id) FILTER (WHERE hit) AS h, count(*) FILTER (WHERE hit AND sfx) AS sn, max(id) FILTER (WHERE hit AND sfx) AS s
  FROM hits GROUP BY 1, 2),
resolved AS (SELECT host, needle, CASE WHEN x IS NOT NULL THEN x WHEN n = 1 THEN h WHEN n > 1 AND sn = 1 THEN s END AS id,
  CASE WHEN x IS NOT NULL OR n = 1 OR (n > 1 AND sn = 1) THEN 'ok' WHEN n = 0 THEN 'not_found' ELSE 'ambiguous' END AS status, n AS candidates FROM res)"""


def _needles(nodes):
    return nodes.select("host").distinct().select("host", F.explode(F.array(*[F.lit(n) for n in _NEEDLES])).alias("needle"))


@query("resolved_nodes", f"WITH {_RESOLVED} SELECT * FROM resolved")
def resolved_nodes(spark, sf):
    nodes, _, _ = D.link_graph(spark, sf)
    nodes = cut(nodes)
    out = G.resolve_nodes(_needles(nodes), nodes)
    hits = F.col("candidates")
    return out.select("host", "needle", "id", "status", hits.alias("candidates"))


@query("resolver_candidates", f"""WITH {_RESOLVED}, named AS MATERIALIZED (SELECT host, id, CASE WHEN url <> '' THEN url WHEN title <> '' THEN title ELSE id END AS label FROM nodes),
amb AS MATERIALIZED (SELECT host, needle FROM resolved WHERE status = 'ambiguous'),
found AS MATERIALIZED (SELECT h.host, h.needle, h.id FROM hits h JOIN amb USING (host, needle) WHERE h.hit)
SELECT f.host, f.needle, count(*) AS n, md5(string_agg(label, chr(10) ORDER BY label)) AS labels FROM found f JOIN named USING (host, id) GROUP BY 1, 2""")
def resolver_candidates(spark, sf):
    nodes, _, _ = D.link_graph(spark, sf, cut(D.lines(spark, sf)))
    nodes = cut(nodes)
    found = G.resolver_candidates(G.resolve_nodes(_needles(nodes), nodes), nodes)
    return found.groupBy("host", "needle").agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("label")), "\n")).alias("labels"))


_LP = f"""{_RESOLVED}, lq AS (SELECT host, unnest(range(4)) AS k, unnest(['root', 'root', 'zzz', '/c/']) AS frm, unnest(['p:7', 'gear', 'root', 'root']) AS "to" FROM (SELECT DISTINCT host FROM cust)),
n2 AS (SELECT a.host, a.needle, n.id, n.id = a.needle AS exact, contains(lower(CASE WHEN url = '' THEN id ELSE url END), lower(needle)) OR contains(lower(title), lower(needle)) AS hit,
  ends_with(rtrim(CASE WHEN url = '' THEN id ELSE url END, '/'), rtrim(needle, '/')) AS sfx FROM (SELECT host, unnest(['root', 'p:7', 'gear', 'zzz', '/c/']) AS needle FROM (SELECT DISTINCT host FROM cust)) a JOIN nodes n USING (host)),
r2 AS (SELECT host, needle, max(id) FILTER (WHERE exact) AS x, count(*) FILTER (WHERE hit) AS n, max(id) FILTER (WHERE hit) AS h, count(*) FILTER (WHERE hit AND sfx) AS sn, max(id) FILTER (WHERE hit AND sfx) AS s FROM n2 GROUP BY 1, 2),
rr AS (SELECT host, needle, CASE WHEN x IS NOT NULL THEN x WHEN n = 1 THEN h WHEN n > 1 AND sn = 1 THEN s END AS id, CASE WHEN x IS NOT NULL OR n = 1 OR (n > 1 AND sn = 1) THEN 'ok' WHEN n = 0 THEN 'not_found' ELSE 'ambiguous' END AS st FROM r2),
{_ROOTS}, {Q.bfs('roots')},
lp AS (SELECT q.host, q.k, a.id AS src, b.id AS dst, CASE WHEN a.st <> 'ok' THEN a.st || '_from' WHEN b.st <> 'ok' THEN b.st || '_to' WHEN r.depth IS NULL THEN 'no_path' ELSE 'ok' END AS status, r.depth, r.path
  FROM lq q JOIN rr a ON a.host = q.host AND a.needle = q.frm JOIN rr b ON b.host = q.host AND b.needle = q."to" LEFT JOIN reached r ON r.host = q.host AND r.root = a.id AND r.node = b.id)"""


def _link_answers(spark, sf):
    nodes, edges, pages = D.link_graph(spark, sf)
    nodes, edges = cut(nodes), cut(edges)
    asks = nodes.select("host").distinct().select("host", F.posexplode(F.array(
        *[F.struct(F.lit(a).alias("frm"), F.lit(b).alias("to")) for a, b in (("root", "p:7"), ("root", "gear"), ("zzz", "root"), ("/c/", "root"))])).alias("k", "x"))
    asks = asks.select(F.concat_ws("|", "host", F.col("k").cast("string")).alias("q_id"), "host", "k", "x.frm", "x.to")
    return P.link_paths(nodes, edges, pages, asks).join(asks.select("q_id", "k"), "q_id"), nodes, edges


@query("link_paths", f"WITH {_LP} SELECT host, k::BIGINT AS k, status, coalesce(depth, -1)::BIGINT AS clicks FROM lp")
def link_paths(spark, sf):
    a, _, _ = _link_answers(spark, sf)
    return a.select("host", big("k"), "status", F.coalesce("clicks", F.lit(-1)).cast("bigint").alias("clicks"))


@query("link_path_steps", f"""WITH {_LP}, st AS (SELECT host, k, unnest(path) AS edge_seq, unnest(range(len(path))) AS step FROM lp WHERE status = 'ok')
SELECT st.host, st.k::BIGINT AS k, st.step::BIGINT AS step, e.label, e.kind, CASE WHEN n.url <> '' THEN n.url WHEN n.title <> '' THEN n.title ELSE n.id END AS to_url
FROM st JOIN edges e USING (host, edge_seq) JOIN nodes n ON n.host = e.host AND n.id = e.dst""")
def link_path_steps(spark, sf):
    a, nodes, edges = _link_answers(spark, sf)
    a = cut(a)
    return P.link_path_steps(a, nodes, edges).join(a.select("q_id", "k"), "q_id").select("host", big("k"), big("step"), "label", "kind", "to_url")


# from the root of every host to its first customer, lowest part and highest supplier, and to a page there is none of
_ENDS = f"""{Q.EDGES}, ends AS (SELECT host, unnest(range(4)) AS k, unnest(['c:' || min(c), 'p:' || min(p), 's:' || max(s), 'zzz']) AS dst FROM ln GROUP BY 1)"""


def _end_answers(spark, sf, only_structural):
    ln = cut(D.lines(spark, sf))
    nodes, edges, pages = D.link_graph(spark, sf, ln)
    nodes, edges = cut(nodes), cut(edges)
    ends = ln.groupBy("host").agg(F.min("c").alias("c"), F.min("p").alias("p"), F.max("s").alias("s"))
    name = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    asks = ends.select("host", F.posexplode(F.array(name("c:", "c"), name("p:", "p"), name("s:", "s"), F.lit("zzz"))).alias("k", "to"))
    asks = cut(asks.select(F.concat_ws("|", "host", F.col("k").cast("string")).alias("q_id"), "host", "k", F.lit("root").alias("frm"), "to"))
    return P.link_paths(nodes, edges, _hub_pages(pages), asks, only_structural).join(asks.select("q_id", "k"), "q_id"), edges


@query("link_all_paths", f"""WITH {_ENDS}, pairs AS (SELECT host, 'root' AS src, dst FROM ends WHERE dst <> 'zzz'), {_WALK_STEPS}
SELECT host, goal AS dst, len(path)::BIGINT AS clicks, array_to_string(nodes, '>') AS nodes, row_number() OVER (PARTITION BY host, goal ORDER BY path DESC) AS walk_rank
FROM walks WHERE node = goal QUALIFY row_number() OVER (PARTITION BY host, goal ORDER BY path DESC) <= 50""")
def link_all_paths(spark, sf):
    a, edges = _end_answers(spark, sf, False)
    out = P.link_all_paths(cut(a), edges, max_len=4)
    return out.select("host", "dst", big("clicks"), F.array_join("nodes", ">").alias("nodes"), big("walk_rank"))


@query("structural_link_paths", f"""WITH {_HUB}, keep AS MATERIALIZED (SELECT * FROM edges e WHERE (e.host, e.dst) NOT IN (SELECT host, dst FROM hub)), {_ROOTS}, {Q.bfs('roots', 'keep')},
{_ENDS[len(Q.EDGES) + 2:]}
SELECT e.host, e.k::BIGINT AS k, CASE WHEN e.dst = 'zzz' THEN 'not_found_to' WHEN r.depth IS NULL THEN 'no_path' ELSE 'ok' END AS status, coalesce(r.depth, -1)::BIGINT AS clicks, coalesce(array_to_string(r.path, ','), '') AS path
FROM ends e LEFT JOIN reached r ON r.host = e.host AND r.node = e.dst""")
def structural_link_paths(spark, sf):
    a, _ = _end_answers(spark, sf, True)
    return a.select("host", big("k"), "status", F.coalesce("clicks", F.lit(-1)).cast("bigint").alias("clicks"), F.coalesce(F.array_join("path", ","), F.lit("")).alias("path"))


@query("paths_by_url", f"WITH {Q.EDGES}, {_PAIRS}, {_ROOTS}, {Q.bfs('roots')} SELECT p.host, r.node AS dst, depth::BIGINT AS clicks FROM pairs p JOIN reached r ON r.host = p.host AND r.node = p.dst")
def paths_by_url(spark, sf):
    ln = cut(D.lines(spark, sf))
    nodes, edges, _ = D.link_graph(spark, sf, ln)
    pairs = _pairs(ln).select("host", F.concat("src", F.lit("/")).alias("start_url"), F.concat("dst", F.lit("#x")).alias("page_url"))
    return P.shortest_path(cut(nodes), cut(edges), pairs).select("host", "dst", big("clicks"))


@query("paths_between", f"WITH {Q.EDGES}, {_ROOTS}, {Q.bfs('roots')} SELECT h.host, coalesce(r.depth, -1)::BIGINT AS clicks FROM (SELECT DISTINCT host FROM cust) h LEFT JOIN reached r ON r.host = h.host AND r.node = (SELECT 's:' || min(s) FROM ln WHERE ln.host = h.host)")
def paths_between(spark, sf):
    ln = cut(D.lines(spark, sf))
    nodes, edges, pages = D.link_graph(spark, sf, ln)
    low = ln.groupBy("host").agg(F.min("s").alias("s"))
    asks = low.select("host", F.concat(F.lit("HTTPS://"), "host", F.lit("/")).alias("a"), F.concat(F.lit("supplier "), F.col("s").cast("string")).alias("b"))
    return P.path_between(cut(nodes), cut(edges), pages, asks, use_global=True).select("host", F.coalesce("clicks", F.lit(-1)).cast("bigint").alias("clicks"))


@query("paths_between_pages", f"WITH {_HUB}, keep AS MATERIALIZED (SELECT * FROM edges e WHERE (e.host, e.dst) NOT IN (SELECT host, dst FROM hub)), {_ROOTS}, {Q.bfs('roots', 'keep')} SELECT h.host, coalesce(r.depth, -1)::BIGINT AS clicks FROM (SELECT DISTINCT host FROM cust) h LEFT JOIN reached r ON r.host = h.host AND r.node = (SELECT 's:' || max(s) FROM ln WHERE ln.host = h.host)")
def paths_between_pages(spark, sf):
    # without links to hubs, which is how paths are asked for by default
    ln = cut(D.lines(spark, sf))
    nodes, edges, pages = D.link_graph(spark, sf, ln)
    high = ln.groupBy("host").agg(F.max("s").alias("s"))
    asks = high.select("host", F.concat(F.lit("https://"), "host", F.lit("/")).alias("a"), F.concat(F.lit("Supplier "), F.col("s").cast("string")).alias("b"))
    return P.path_between(cut(nodes), cut(edges), _hub_pages(pages), asks).select("host", F.coalesce("clicks", F.lit(-1)).cast("bigint").alias("clicks"))


@query("merged_states", f"WITH {Q.LN}, {Q.STATES} SELECT host, id, CASE WHEN id LIKE 'c:%' THEN 'new' ELSE label END AS label FROM states")
def merged_states(spark, sf):
    s = D.graphs(spark, sf, with_items=False).states.select("host", "id", "label", "depth")
    new = s.where(F.col("id").startswith("c:")).withColumn("label", F.lit("new"))
    return merge_tables(s, new, ["host", "id"]).select("host", "id", "label")
