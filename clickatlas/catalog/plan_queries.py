"""How-to questions, content search, audits and merges over the derived site graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match as M
from ..operators.sets import mark_stale, split_hits
from ..plans import audit as U
from ..plans import content as C
from ..plans import howto as H
from ..plans import merge as MG
from ..session import cut
from . import derive as D
from . import graph_sql as Q
from .registry import query

big = lambda c: F.col(c).cast("bigint").alias(c)


def _graphs(spark, sf):
    return D.stored_graphs(spark, sf)


@query("matched_triggers", f"WITH {Q.LN}, {Q.TRIGGERS}, {Q.QUESTIONS}, {Q.MATCHES} SELECT q_id, trig_seq, needle_hit FROM matches")
def matched_triggers(spark, sf):
    g = D.graphs(spark, sf, with_items=False)
    return M.match_goals(D.questions(spark, sf), g.triggers).select("q_id", "trig_seq", "needle_hit")


@query("pattern_triggers", f"""WITH {Q.LN}, {Q.TRIGGERS} SELECT h.k::BIGINT AS q_id, t.trig_seq FROM (SELECT n_nationkey AS k, 'shop' || n_nationkey || '.example.com' AS host FROM nation) h
JOIN triggers t USING (host) WHERE regexp_matches(t.label, '(?i)^(edit|show) .*(bolt|rods)$') OR regexp_matches(t.label, '(?i)\\banvil(s|es)?\\b')""")
def pattern_triggers(spark, sf):
    g = D.graphs(spark, sf, with_items=False)
    q = D.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("q_id"), D.host_of("n_nationkey").alias("host"), F.lit("an anvil").alias("goal"),
        F.lit("^(edit|show) .*(bolt|rods)$").alias("match"),
    )
    return M.match_goals(q, g.triggers).select("q_id", "trig_seq")


@query("trigger_pages", f"WITH {Q.EDGES}, {Q.STATES} SELECT e.host, e.edge_seq, e.label, CASE WHEN s.id LIKE 's:%' THEN s.id ELSE s.url END AS url FROM edges e JOIN states s ON s.host = e.host AND s.id = e.src WHERE regexp_matches(e.label, '(?i)open p:[0-9]$')")
def trigger_pages(spark, sf):
    nodes, edges, _ = D.link_graph(spark, sf)
    return M.find_trigger_pages(edges, nodes, "open P:[0-9]$")


_BEST_STEPS = """steps AS (SELECT b.q_id, string_agg('Click “' || e.label || '”', ' / ' ORDER BY i) AS clicks FROM (SELECT q_id, host, unnest(path) AS edge_seq, generate_subscripts(path, 1) AS i FROM best) b JOIN edges e USING (host, edge_seq) GROUP BY 1)"""


@query("howto", f"""WITH {Q.ROUTES}, {_BEST_STEPS}
SELECT s.q_id, s.status, s.matched, s.routed, s.high, CASE WHEN s.matched > 0 THEN s.start_url END AS start_url, b.label AS trigger_label, b.state_url, coalesce(b.depth + 1, -1)::BIGINT AS clicks,
  CASE WHEN b.q_id IS NOT NULL THEN 'Go to ' || s.start_url || coalesce(' / ' || st.clicks, '') || ' / ' || (CASE WHEN b.kind = 'download' THEN 'Download via “' || b.label || '”' ELSE 'Click the “' || b.label || '” button' END) END AS steps,
  b.opens_at, b.kind AS action_kind, CASE WHEN b.kind = 'download' THEN b.href END AS download_url, greatest(coalesce(b.fc, -1), -1)::BIGINT AS field_count
FROM status s LEFT JOIN best b USING (q_id) LEFT JOIN steps st USING (q_id)""")
def howto(spark, sf):
    out = H.howto(_graphs(spark, sf), D.questions(spark, sf))
    fields = F.when((F.col("action_kind") == "download") | F.col("action_kind").isNull(), -1).otherwise(F.col("field_count"))
    return out.select(
        "q_id", "status", "matched", "routed", "high", "start_url", "trigger_label", "state_url", F.coalesce("clicks", F.lit(-1)).cast("bigint").alias("clicks"),
        F.array_join("steps", " / ").alias("steps"), "opens_at", "action_kind", "download_url", fields.cast("bigint").alias("field_count"),
    )


@query("howto_all_routes", f"WITH {Q.ROUTES} SELECT q_id, trig_seq, (depth + 1)::BIGINT AS clicks, confidence FROM routed WHERE depth IS NOT NULL AND confidence = 'high'")
def howto_all_routes(spark, sf):
    m, _ = H.routes(_graphs(spark, sf), D.questions(spark, sf))
    return H.pick_triggers(m, show_all=True).select("q_id", "trig_seq", (F.col("depth") + 1).cast("bigint").alias("clicks"), "confidence")


@query("low_confidence_routes", f"WITH {Q.ROUTES} SELECT q_id, trig_seq, depth::BIGINT AS depth FROM routed WHERE depth IS NOT NULL AND confidence = 'low'")
def low_confidence_routes(spark, sf):
    m, _ = H.routes(_graphs(spark, sf), D.questions(spark, sf))
    return H.low_confidence(m).select("q_id", "trig_seq", big("depth"))


_INDEXED = f"""{Q.ROUTES}, pool AS (SELECT r.*, row_number() OVER (PARTITION BY r.q_id ORDER BY r.rn) AS k, count(*) OVER (PARTITION BY r.q_id) AS n
  FROM routed r JOIN status s USING (q_id) WHERE r.depth IS NOT NULL AND (s.high = 0 OR r.confidence = 'high')),
chosen AS (SELECT * FROM pool WHERE k = (q_id % 4) * (q_id % 4) * (q_id % 4) * 40 + 1)"""


@query("resolve_action", f"""WITH {_INDEXED} SELECT s.q_id, CASE WHEN s.matched = 0 THEN 'no_match' WHEN s.routed = 0 THEN 'unreachable' WHEN c.q_id IS NULL THEN 'no_match' ELSE 'ok' END AS status,
  c.label AS trigger_label, coalesce((SELECT max(n) FROM pool p WHERE p.q_id = s.q_id), -1)::BIGINT AS match_count, coalesce(len(c.path), -1)::BIGINT AS steps,
  CASE WHEN s.routed > 0 AND c.q_id IS NULL THEN 'index ' || (s.q_id % 4) * (s.q_id % 4) * (s.q_id % 4) * 40 || ' out of range (' || (SELECT max(n) FROM pool p WHERE p.q_id = s.q_id) || ' match(es))' END AS detail
FROM status s LEFT JOIN chosen c USING (q_id)""")
def resolve_action(spark, sf):
    m = F.col("q_id") % 4
    q = D.questions(spark, sf).withColumn("index", (m * m * m * 40).cast("int"))
    r = H.resolve_action(_graphs(spark, sf), q)
    return r.select(
        "q_id", "status", "trigger_label", F.coalesce("match_count", F.lit(-1)).cast("bigint").alias("match_count"),
        F.coalesce(F.when(F.col("path_steps").isNotNull(), F.size("path_steps")), F.lit(-1)).cast("bigint").alias("steps"), "detail",
    )


def _resolved(spark, sf):
    return cut(H.resolve_action(_graphs(spark, sf), D.questions(spark, sf)))


# with index 0 the chosen route is the best one, or the nearest of the low ones
_CHOSEN = f"""{Q.ROUTES}, pick AS MATERIALIZED (SELECT r.*, s.high FROM routed r JOIN status s USING (q_id) WHERE r.depth IS NOT NULL AND (s.high = 0 OR r.confidence = 'high') QUALIFY row_number() OVER (PARTITION BY r.q_id ORDER BY r.rn) = 1),
pstep AS (SELECT p.q_id, i, e.kind, e.label, e.selector, s.url FROM (SELECT q_id, host, unnest(path) AS edge_seq, generate_subscripts(path, 1) AS i FROM pick) p JOIN edges e USING (host, edge_seq) JOIN states s ON s.host = e.host AND s.id = e.dst)"""


@query("action_plan", f"""WITH {_CHOSEN}, rows AS (
  SELECT q_id, 0 AS o, 'nav' AS role, start_url AS target, NULL AS value, NULL AS comment, false AS needs_input, false AS disabled FROM pick
  UNION ALL SELECT q_id, i, CASE WHEN kind = 'link' THEN 'nav' ELSE 'click' END, CASE WHEN kind = 'link' THEN url ELSE selector END, NULL, label, false, false FROM pstep
  UNION ALL SELECT q_id, 100, 'note', NULL, NULL, CASE WHEN kind = 'download' THEN 'section download' ELSE 'section form' END, false, true FROM pick
  UNION ALL SELECT q_id, 101, 'download', href, trig_seq || '.pdf', NULL, false, false FROM pick WHERE kind = 'download' AND href IS NOT NULL
  UNION ALL SELECT q_id, 101, 'download', '#t-' || trig_seq, NULL, 'no_url', false, false FROM pick WHERE kind = 'download' AND href IS NULL
  UNION ALL SELECT q_id, 101, CASE WHEN opens_at IS NULL THEN 'click' ELSE 'nav' END, coalesce(opens_at, '#t-' || trig_seq), NULL, 'open_form', false, false FROM pick WHERE kind = 'form'
  UNION ALL SELECT q_id, 102, 'fill', '#name', '<name>', 'Name *', true, false FROM pick WHERE kind = 'form' AND fc >= 1
  UNION ALL SELECT q_id, 103, 'select', '#type', p_type, 'Type', true, false FROM pick WHERE kind = 'form' AND fc >= 2
  UNION ALL SELECT q_id, 104, 'submit', '#save', NULL, 'submit', false, true FROM pick WHERE kind = 'form')
SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY o) - 1 AS step, role, target, value, comment, needs_input, disabled FROM rows""")
def action_plan(spark, sf):
    return H.action_plan(_resolved(spark, sf)).select("q_id", big("step"), "role", "target", "value", "comment", "needs_input", "disabled")


@query("tour_steps", f"""WITH {_CHOSEN}, rows AS (SELECT q_id, i AS o, 'nav' AS kind, label, selector FROM pstep UNION ALL SELECT q_id, 100, 'trigger', label, NULL FROM pick UNION ALL SELECT q_id, 101, 'form', NULL, NULL FROM pick)
SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY o) - 1 AS step, kind, label, selector FROM rows""")
def tour_steps(spark, sf):
    return H.tour_steps(_resolved(spark, sf)).select("q_id", big("step"), "kind", "label", "selector")


@query("scenario_report", f"""WITH {Q.ROUTES} SELECT s.q_id, s.status, s.goal, coalesce(b.depth + 1, -1)::BIGINT AS clicks, b.label AS trigger, CASE WHEN s.status = 'unreachable' THEN s.matched ELSE 0 END::BIGINT AS candidates, b.q_id IS NOT NULL AS found
FROM status s LEFT JOIN best b USING (q_id)""")
def scenario_report(spark, sf):
    r = H.scenario_report(_graphs(spark, sf), D.questions(spark, sf))
    return r.select("q_id", "status", "goal", F.coalesce("clicks", F.lit(-1)).cast("bigint").alias("clicks"), "trigger", big("candidates"), "found")


# nations with an odd key lose all links to parts, so what they ask lies out of reach; one question a nation asks nothing
_LOST = Q.ROUTES.replace("AS selector FROM edges0)", "AS selector FROM edges0 WHERE NOT (regexp_extract(host, '[0-9]+')::INT % 2 = 1 AND dst LIKE 'p:%'))")


def _lost(spark, sf):
    g, q = _graphs(spark, sf), D.questions(spark, sf)
    odd = F.regexp_extract("host", "[0-9]+", 0).cast("int") % 2 == 1
    blank = q.where("q_id % 100 = 0").withColumns({"q_id": F.col("q_id") + 50, "goal": F.lit(""), "match": F.lit(None).cast("string")})
    return g._replace(edges=g.edges.where(~(odd & F.col("dst").startswith("p:")))), q.unionByName(blank)


@query("unanswered_candidates", f"WITH {_LOST} SELECT r.q_id, r.trig_seq, r.label FROM routed r JOIN status s USING (q_id) WHERE s.status = 'unreachable'")
def unanswered_candidates(spark, sf):
    g, q = _lost(spark, sf)
    m, _ = H.routes(g, q)
    m = cut(m)
    return H.candidates(m, H.question_status(q, m, g), g).select("q_id", "trig_seq", "label")


@query("howto_statuses", f"""WITH {_LOST} SELECT s.q_id, s.status, coalesce(b.depth + 1, -1)::BIGINT AS clicks FROM status s LEFT JOIN best b USING (q_id)
UNION ALL SELECT n_nationkey * 100 + 50, 'invalid_args', -1 FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)""")
def howto_statuses(spark, sf):
    g, q = _lost(spark, sf)
    return H.howto(g, q).select("q_id", "status", F.coalesce("clicks", F.lit(-1)).cast("bigint").alias("clicks"))


@query("cache_misses", f"WITH {Q.ROUTES} SELECT q_id, goal FROM status WHERE status <> 'ok'")
def cache_misses(spark, sf):
    q = D.questions(spark, sf)
    _, misses = split_hits(q, H.howto(_graphs(spark, sf), q))
    return misses.select("q_id", "goal")


@query("stale_triggers", f"WITH {Q.LN}, {Q.TRIGGERS} SELECT host, trig_seq, contains(lower(label), 'gear') OR contains(lower(label), 'old') AS stale FROM triggers")
def stale_triggers(spark, sf):
    g = D.graphs(spark, sf, with_items=False)
    goals = g.meta.select("host", F.explode(F.array(F.lit("create a GEAR"), F.lit("add old"))).alias("goal"))
    return mark_stale(g.triggers, goals).select("host", "trig_seq", "stale")


# --- content -----------------------------------------------------------------------------

_CONTENT = f"""{Q.EDGES}, {Q.STATES}, {Q.ITEMS}, hit AS MATERIALIZED (SELECT * FROM items WHERE contains(lower(text), 'red gear') AND item_idx < 500),
roots AS (SELECT DISTINCT host, 'root' AS root FROM edges), {Q.bfs('roots')},
v AS (SELECT h.host, h.state_id, h.state_seq, h.n, r.depth, row_number() OVER (PARTITION BY h.host ORDER BY coalesce(r.depth, 1000000), h.state_seq) AS view_rank
  FROM (SELECT host, state_id, state_seq, count(*) AS n FROM hit GROUP BY 1, 2, 3) h LEFT JOIN reached r ON r.host = h.host AND r.node = h.state_id),
v2 AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY host ORDER BY view_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v),
views AS MATERIALIZED (SELECT v2.*, least(n, 5 - before)::BIGINT AS shown, s.url FROM v2 JOIN states s ON s.host = v2.host AND s.id = v2.state_id WHERE before < 5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY host, state_id ORDER BY coll_idx, item_idx) AS item_rank FROM hit)"""


def _content(spark, sf):
    return C.find_content(D.stored_graphs(spark, sf, with_items=True), "Red Gear", limit=5)


@query("find_content_views", f"WITH {_CONTENT} SELECT host, view_rank, state_id, url AS view_url, depth IS NOT NULL AS reachable, coalesce(depth, -1)::BIGINT AS distance, shown, shown < n AS truncated FROM views")
def find_content_views(spark, sf):
    _, views, _ = _content(spark, sf)
    return views.select(
        "host", big("view_rank"), "state_id", "view_url", "reachable", F.coalesce("distance_clicks", F.lit(-1)).cast("bigint").alias("distance"), big("shown"), "truncated"
    )


@query("find_content_items", f"WITH {_CONTENT} SELECT r.host, v.view_rank, r.item_rank, r.kind, r.text FROM ranked r JOIN views v USING (host, state_id) WHERE r.item_rank <= v.shown")
def find_content_items(spark, sf):
    _, _, items = _content(spark, sf)
    return items.select("host", big("view_rank"), big("item_rank"), "kind", "text")


@query("find_content_totals", f"WITH {_CONTENT} SELECT h.host, CASE WHEN max(v.n) IS NULL THEN 'no_match' ELSE 'ok' END AS status, coalesce(sum(v.n), 0)::BIGINT AS total_matches, count(v.n) AS views_matched FROM (SELECT DISTINCT host FROM states) h LEFT JOIN v USING (host) GROUP BY 1")
def find_content_totals(spark, sf):
    hosts, _, _ = _content(spark, sf)
    return hosts.select("host", "status", "total_matches", "views_matched")


_ACROSS = f"""{_CONTENT}, m AS (SELECT *, row_number() OVER (ORDER BY depth IS NULL, coalesce(depth, 1000000), host, url, view_rank) AS rank FROM views),
m2 AS (SELECT *, coalesce(sum(shown) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM m),
best AS (SELECT *, least(shown, 5 - b)::BIGINT AS take FROM m2 WHERE b < 5)"""


@query("find_content_hosts_views", f"WITH {_ACROSS} SELECT rank, host, url AS view_url, take, shown < n OR take < shown AS truncated FROM best")
def find_content_hosts_views(spark, sf):
    _, _, views, _ = C.find_content_hosts(D.stored_graphs(spark, sf, with_items=True), "Red Gear", limit=5)
    return views.select(big("rank"), "host", "view_url", big("take"), "truncated")


@query("find_content_hosts_summary", f"""WITH {_ACROSS} SELECT 'ok' AS status, (SELECT count(*) FROM nation) AS hosts_searched, (SELECT count(DISTINCT host) FROM hit) AS hosts_matched, 0::BIGINT AS hosts_errored, (SELECT count(*) FROM hit) AS total_matches,
  (SELECT count(*) FROM views) AS views_matched, (SELECT count(*) FROM best) AS views_shown, (SELECT sum(take) FROM best)::BIGINT AS shown, ((SELECT count(*) FROM views) - (SELECT count(*) FROM best))::BIGINT AS views_omitted""")
def find_content_hosts_summary(spark, sf):
    return C.find_content_hosts(D.stored_graphs(spark, sf, with_items=True), "Red Gear", limit=5)[0]


@query("content_items", f"WITH {Q.LN}, {Q.ITEMS} SELECT host, state_id, coll_idx::BIGINT AS coll_idx, item_idx::BIGINT AS item_idx, text FROM items WHERE item_idx < 500")
def content_items(spark, sf):
    return C.items_table(D.graphs(spark, sf).states).select("host", "state_id", big("coll_idx"), big("item_idx"), "text")


# --- audits and flows ----------------------------------------------------------------------

def _goals(spark, sf):
    q = D.questions(spark, sf)
    g = F.col("q_id") % 100
    return q.select(
        "q_id", F.concat(F.lit("site"), F.floor(F.col("q_id") / 100).cast("string")).alias("site"), "host", "goal", "start",
        F.when(g == 3, "no_match").otherwise("ok").alias("want"), F.when(g == 0, "/p/1").when(g == 2, "/new").alias("url_contains"),
        F.when(g == 4, 2).alias("min_fields"),
    )


_SCORES = f"""{Q.ROUTES}, sc AS (SELECT s.q_id, 'site' || s.q_id // 100 AS site, s.host, s.goal, CASE WHEN s.q_id % 100 = 3 THEN s.status IN ('no_match', 'unreachable') ELSE s.status = 'ok' AND (CASE s.q_id % 100
    WHEN 0 THEN contains(b.state_url, '/p/1') OR contains(coalesce(b.opens_at, ''), '/p/1') WHEN 2 THEN contains(b.state_url, '/new') OR contains(coalesce(b.opens_at, ''), '/new') WHEN 4 THEN b.fc >= 2 ELSE true END) END AS passed
  FROM status s LEFT JOIN best b USING (q_id))"""


@query("goal_scores", f"WITH {_SCORES} SELECT q_id, site, goal, passed FROM sc")
def goal_scores(spark, sf):
    scores, _ = U.audit(_graphs(spark, sf), _goals(spark, sf))
    return scores.select("q_id", "site", "goal", "passed")


@query("audit_scoreboard", f"""WITH {_SCORES}, su AS (SELECT host, replace(replace(url, '?ref=x', ''), '/p/', '/p/') AS u, split_part(url, '?', 1) AS b FROM states),
qy AS (SELECT host, count(*) AS states, count(*) - count(DISTINCT rtrim(u, '/')) AS dup, count(DISTINCT b) AS spread FROM su GROUP BY 1),
per AS (SELECT site, host, count(*) AS goals, count(*) FILTER (WHERE passed) AS passed FROM sc GROUP BY 1, 2)
SELECT coalesce(site, 'AGGREGATE') AS site, sum(goals)::BIGINT AS goals, sum(passed)::BIGINT AS passed, sum(states)::BIGINT AS states, sum(dup)::BIGINT AS dup, sum(spread)::BIGINT AS spread, sum(dup) = 0 AS dup_ok FROM per JOIN qy USING (host) GROUP BY ROLLUP (site)""")
def audit_scoreboard(spark, sf):
    return U.audit(_graphs(spark, sf), _goals(spark, sf))[1]


@query("audit_gate", f"WITH {_SCORES} SELECT count(*) AS goals, count(*) FILTER (WHERE passed) AS passed, 0::BIGINT AS dup, count(*) FILTER (WHERE passed) >= 10 AS ok FROM sc")
def audit_gate(spark, sf):
    return U.gate(U.audit(_graphs(spark, sf), _goals(spark, sf))[1], "full", 10)


@query("verdict_totals", f"WITH {Q.QUESTIONS} SELECT host, count(*) AS total, count(*) FILTER (WHERE m = 0) AS n_pass, count(*) FILTER (WHERE m = 1) AS n_fail, count(*) FILTER (WHERE m = 2) AS n_unrated FROM questions GROUP BY 1")
def verdict_totals(spark, sf):
    from ..operators.aggregates import verdict_totals as vt

    m = F.col("q_id") % 100 % 3
    return vt(D.questions(spark, sf).withColumn("verdict", F.when(m == 0, "pass").when(m == 1, "fail")))


def _flows(spark, sf):
    s = D.table(spark, sf, "supplier")
    word = F.element_at(F.array(*[F.lit(w) for w in ("red gear", "zzz thing", "gearz", "blue rods", "bolts")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    doc = F.concat(
        F.lit('{"name":"f","steps":[{"op":"goto","goal":"create '), word, F.lit('"},{"op":"goto","url":"https://x.test/"},{"op":"for_each","match":"a","body":['),
        F.lit('{"op":"do","goal":"create ${row.name}"},{"op":"paginate","body":[{"op":"do","match":"^'), word, F.lit('","index":1}]}]},{"op":"log","message":"m"}]}'),
    )
    return s.select(F.col("s_suppkey").alias("flow_id"), D.host_of("s_nationkey").alias("host"), doc.alias("doc"))


_WORD = "(['red gear', 'zzz thing', 'gearz', 'blue rods', 'bolts'])[s_suppkey % 5 + 1]"


@query("flow_targets", f"""SELECT s_suppkey AS flow_id, 'steps[0]' AS path, 'create ' || {_WORD} AS goal, NULL AS match, 0::BIGINT AS "index" FROM supplier
UNION ALL SELECT s_suppkey, 'steps[2].body[1].body[0]', NULL, '^' || {_WORD}, 1 FROM supplier""")
def flow_targets(spark, sf):
    return U.goal_targets(U.flow_steps(_flows(spark, sf))).select("flow_id", "path", "goal", "match", big("index"))


@query("flow_steps", """WITH a AS (SELECT s_suppkey AS flow_id, unnest(['steps[0]', 'steps[1]', 'steps[2]', 'steps[2].body[0]', 'steps[2].body[1]', 'steps[2].body[1].body[0]', 'steps[3]']) AS path, unnest(['goto', 'goto', 'for_each', 'do', 'paginate', 'do', 'log']) AS op FROM supplier),
d AS (SELECT s_suppkey AS flow_id, unnest(range(0, 1 + s_suppkey % 9)) AS k, s_suppkey % 9 AS depth FROM supplier)
SELECT * FROM a UNION ALL SELECT -1 - flow_id, 'steps[0]' || repeat('.body[0]', k::INT), CASE WHEN k = depth THEN 'do' ELSE 'for_each' END FROM d""")
def flow_steps(spark, sf):
    # besides, a flow of one step inside loops, up to nine levels
    s = D.table(spark, sf, "supplier")
    depth = (F.col("s_suppkey") % 9).cast("int")
    deep = F.concat(F.lit('{"steps":['), F.repeat(F.lit('{"op":"for_each","match":"a","body":['), depth), F.lit('{"op":"do","match":"b"}'), F.repeat(F.lit("]}"), depth), F.lit("]}"))
    nested = s.select((-1 - F.col("s_suppkey")).alias("flow_id"), D.host_of("s_nationkey").alias("host"), deep.alias("doc"))
    return U.flow_steps(_flows(spark, sf).unionByName(nested)).select("flow_id", "path", "op")


# the goal steps of all flows as questions from the root page; the pattern steps are tested on the labels
_FLOW_Q = f"questions AS MATERIALIZED (SELECT s_suppkey AS q_id, 'shop' || s_nationkey || '.example.com' AS host, 'create ' || {_WORD} AS goal, '^' || {_WORD} AS rx, 0 AS m, 0 AS c, 'root' AS root, '' AS start_url FROM supplier)"
_STEMS = "list_distinct(list_transform(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda w: lower(w)), lambda w: length(w) > 2 AND w NOT IN ('the', 'a', 'an', 'and', 'for', 'new', 'add', 'all', 'any', 'with', 'from')), lambda x: CASE WHEN length(x) > 3 AND ends_with(x, 's') THEN x[:-2] ELSE x END))"
_WARN = f"""{Q.ROUTES.replace(Q.QUESTIONS, _FLOW_Q)},
d AS MATERIALIZED (SELECT host, label, min(trig_seq) AS ts FROM triggers GROUP BY 1, 2),
rxn AS (SELECT q.q_id, count(*) AS n FROM questions q JOIN d ON d.host = q.host AND regexp_matches(d.label, '(?i)' || q.rx) GROUP BY 1),
bad AS MATERIALIZED (
  SELECT q_id, host, goal AS needle, 'steps[0]' AS path, CASE WHEN matched = 0 THEN 'no_match' ELSE 'unreachable' END AS status FROM status WHERE routed = 0
  UNION ALL SELECT q.q_id, q.host, q.rx, 'steps[2].body[1].body[0]', 'no_match' FROM questions q LEFT JOIN rxn USING (q_id) WHERE coalesce(rxn.n, 0) = 0),
nd AS MATERIALIZED (SELECT DISTINCT host, needle, {_STEMS.format('needle')} AS w FROM bad),
dl AS MATERIALIZED (SELECT *, {_STEMS.format('label')} AS w FROM d),
byword AS MATERIALIZED (SELECT nd.host, nd.needle, label, row_number() OVER (PARTITION BY nd.host, nd.needle ORDER BY ts) AS rank FROM nd JOIN dl ON dl.host = nd.host AND list_has_any(dl.w, nd.w)
  QUALIFY row_number() OVER (PARTITION BY nd.host, nd.needle ORDER BY ts) <= 5),
low AS (SELECT host, lower(label) AS low, arg_max(label, ts) AS label FROM d GROUP BY 1, 2),
close AS (SELECT nd.host, nd.needle, label, low, 1 - levenshtein(low, lower(needle)) / greatest(length(low), length(needle))::DOUBLE AS ratio FROM nd JOIN low USING (host) WHERE (nd.host, nd.needle) NOT IN (SELECT host, needle FROM byword)),
near AS (SELECT host, needle, label, row_number() OVER (PARTITION BY host, needle ORDER BY ratio DESC, low DESC) AS rank FROM close WHERE ratio >= 0.6 QUALIFY row_number() OVER (PARTITION BY host, needle ORDER BY ratio DESC, low DESC) <= 5),
tips AS (SELECT host, needle, string_agg(label, ' | ' ORDER BY rank) AS candidates FROM (SELECT * FROM byword UNION ALL SELECT * FROM near) GROUP BY 1, 2)"""


@query("goal_warnings", f"""WITH {_WARN} SELECT q_id AS flow_id, path, status,
  CASE status WHEN 'unreachable' THEN '“' || needle || '” matches a trigger, but no click-path in the ' || host || ' graph reaches it' ELSE 'no trigger matches “' || needle || '” in the ' || host || ' graph' END AS message,
  coalesce(candidates, '') AS candidates FROM bad LEFT JOIN tips USING (host, needle)""")
def goal_warnings(spark, sf):
    w = U.goal_warnings(U.flow_steps(_flows(spark, sf)), _graphs(spark, sf))
    return w.select("flow_id", "path", "status", "message", F.array_join("candidates", " | ").alias("candidates"))


# two needles that share a word with labels, one that is only close to some, and one close to none
_TIPS = f"""{Q.LN}, {Q.TRIGGERS}, d AS (SELECT host, label, min(trig_seq) AS ts FROM triggers GROUP BY 1, 2),
t AS (SELECT host, label, ts, list_transform(list_filter(list_transform(regexp_extract_all(label, '[A-Za-z0-9]+'), lambda w: lower(w)), lambda w: length(w) > 2 AND w NOT IN ('the', 'a', 'an', 'and', 'for', 'new', 'add', 'all', 'any', 'with', 'from')), lambda x: CASE WHEN length(x) > 3 AND ends_with(x, 's') THEN x[:-2] ELSE x END) AS w FROM d),
byword AS (SELECT host, n AS needle, label, row_number() OVER (PARTITION BY host, n ORDER BY ts) AS rank, 'word' AS found_by FROM t, (SELECT unnest(['red gears', 'anvil']) AS n) WHERE list_has_any(w, CASE n WHEN 'anvil' THEN ['anvil'] ELSE ['red', 'gear'] END)
  QUALIFY row_number() OVER (PARTITION BY host, n ORDER BY ts) <= 5),
low AS (SELECT host, lower(label) AS low, arg_max(label, ts) AS label FROM d GROUP BY 1, 2),
close AS (SELECT host, n AS needle, label, low, 1 - levenshtein(low, n) / greatest(length(low), length(n))::DOUBLE AS ratio FROM low, (SELECT unnest(['crate smal rodd', 'qqq']) AS n)),
near AS (SELECT host, needle, label, row_number() OVER (PARTITION BY host, needle ORDER BY ratio DESC, low DESC) AS rank, 'closeness' AS found_by FROM close WHERE ratio >= 0.6
  QUALIFY row_number() OVER (PARTITION BY host, needle ORDER BY ratio DESC, low DESC) <= 5)"""


@query("suggested_labels", f"WITH {_TIPS} SELECT * FROM byword UNION ALL SELECT * FROM near")
def suggested_labels(spark, sf):
    g = D.graphs(spark, sf, with_items=False)
    needles = g.meta.select("host", F.explode(F.array(*[F.lit(x) for x in ("red gears", "anvil", "crate smal rodd", "qqq")])).alias("needle"))
    return M.suggest_labels(needles, g.triggers).select("host", "needle", "label", big("rank"), "found_by")


# --- merges ------------------------------------------------------------------------------------

def _live(spark, sf):
    """One live result per customer and one repeat of each.

    A known page, then a new tab.  Every fourth result ends on a page of its own
    and every fourth has no steps at all.
    """
    c = D.table(spark, sf, "customer").select(D.host_of("c_nationkey").alias("host"), F.col("c_custkey").alias("c"))
    k = F.col("c").cast("string")
    root = F.concat(F.lit("https://"), F.col("host"), F.lit("/"))
    step = lambda lab, sel, href: F.struct(lab.alias("label"), sel.alias("selector"), href.alias("href"))
    none = F.lit(None).cast("string")
    page = F.concat(root, F.lit("c/"), k, F.lit("?ref=x"))
    steps = F.array(step(F.concat(F.lit("Open c:"), k), F.concat(F.lit("#c-"), k), page), step(F.lit("Tab"), F.lit("#tab"), none))
    m = F.col("c") % 4
    rec = c.select(
        "host", F.col("c").alias("rec_seq"), F.when(m == 1, page).otherwise(root).alias("start"), F.concat(F.lit("Create note "), k).alias("trigger"),
        F.when(m == 1, F.slice(steps, 1, 0)).otherwise(steps).alias("steps"),
        F.when(m == 0, F.concat(root, F.lit("notes/"), k)).otherwise(none).alias("trigger_page"),
        F.lit(None).cast(D.X.FORM).alias("form"), none.alias("opens_at"), F.lit("form").alias("kind"), F.lit("#new").alias("selector"), none.alias("href"), none.alias("accept"),
    )
    again = rec.withColumn("rec_seq", F.col("rec_seq") + 1_000_000_000).withColumn("opens_at", F.lit("https://again.test/"))
    return rec.unionByName(again)


_MERGED = f"""{Q.EDGES}, {Q.STATES}, mx AS (SELECT host, max(coalesce(nullif(regexp_extract(id, '([0-9]+)$', 1), ''), '0')::BIGINT) AS m FROM states GROUP BY 1),
rec AS (SELECT host, c, c % 4 AS m FROM cust),
made AS MATERIALIZED (SELECT r.host, r.c, r.m, 'sl' || (mx.m + row_number() OVER (PARTITION BY r.host ORDER BY r.c)) AS id FROM rec r JOIN mx USING (host) WHERE r.m <> 1)"""


@query("merge_live_states", f"""WITH {_MERGED} SELECT host, id, CASE WHEN m = 0 THEN 'https://' || host || '/notes/' || c ELSE 'https://' || host || '/c/' || c || '?ref=x' END AS url, 'Tab' AS label, 2::BIGINT AS depth FROM made""")
def merge_live_states(spark, sf):
    g = _graphs(spark, sf)
    s = MG.merge_live(g, _live(spark, sf), "2026-01-01 00:00:00").states
    return s.where(F.col("id").startswith("sl")).select("host", "id", "url", "label", big("depth"))


@query("merge_live_edges", f"""WITH {_MERGED} SELECT host, src, dst, label, selector, kind FROM edges UNION ALL SELECT host, 'c:' || c, id, 'Tab', '#tab', 'click' FROM made""")
def merge_live_edges(spark, sf):
    return MG.merge_live(_graphs(spark, sf), _live(spark, sf), "2026-01-01 00:00:00").edges.select("host", "src", "dst", "label", "selector", "kind")


@query("merge_live_triggers", f"""WITH {_MERGED}, {Q.TRIGGERS} SELECT host, label, state_id, NULL AS cache_source FROM triggers
UNION ALL SELECT r.host, 'Create note ' || r.c, coalesce(d.id, 'c:' || r.c), 'live' FROM rec r LEFT JOIN made d ON d.host = r.host AND d.c = r.c""")
def merge_live_triggers(spark, sf):
    return MG.merge_live(_graphs(spark, sf), _live(spark, sf), "2026-01-01 00:00:00").triggers.select("host", "label", "state_id", "cache_source")


@query("merge_live_refresh", f"""WITH {Q.LN}, {Q.TRIGGERS} SELECT host, trig_seq, 'https://new.test/' || trig_seq AS opens_at, 'live' AS cache_source FROM triggers WHERE npath = 0
  AND trig_seq IN (SELECT min(trig_seq) FROM triggers t2 WHERE t2.host = triggers.host AND t2.npath = 0 GROUP BY lower(label))""")
def merge_live_refresh(spark, sf):
    g = _graphs(spark, sf)
    again = g.triggers.where(F.size("path") == 0).select(
        "host", F.col("trig_seq").alias("rec_seq"), F.lit("https://x.test/").alias("start"), F.upper("label").alias("trigger"), F.col("path").alias("steps"),
        F.lit(None).cast("string").alias("trigger_page"), "form", F.concat(F.lit("https://new.test/"), F.col("trig_seq").cast("string")).alias("opens_at"), "kind", "selector", "href", "accept",
    )
    # of the triggers that share a label only the first is refreshed, by the last record
    first = again.groupBy("host", F.lower("trigger").alias("k")).agg(F.min("rec_seq").alias("rec_seq"))
    again = again.join(first.select("host", "rec_seq"), ["host", "rec_seq"], "left_semi")
    t = MG.merge_live(g, again, "2026-01-01 00:00:00").triggers
    return t.where(F.col("cache_source") == "live").select("host", "trig_seq", "opens_at", "cache_source")


@query("merge_live_meta", "SELECT 'shop' || n_nationkey || '.example.com' AS host, 2 * count(c_custkey) AS live_hits FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def merge_live_meta(spark, sf):
    return MG.merge_live(_graphs(spark, sf), _live(spark, sf), "2026-01-01 00:00:00").meta.select("host", big("live_hits"))


@query("stitch_lookups", f"WITH {Q.LN}, {Q.STATES} SELECT host, split_part(rtrim(url, '/'), '#', 1) AS u, arg_min(id, state_seq) AS id FROM states GROUP BY 1, 2")
def stitch_lookups(spark, sf):
    by_url, _ = MG.lookup_states(D.graphs(spark, sf, with_items=False).states)
    return by_url.select("host", "u", "id")
