"""SQL of the derived site graphs, clause by clause."""

LN = """
ln AS (SELECT 'shop' || c_nationkey || '.example.com' AS host, o_custkey AS c, l_partkey AS p, l_suppkey AS s, l_linenumber % 3 AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
cust AS (SELECT 'shop' || c_nationkey || '.example.com' AS host, c_custkey AS c, c_name FROM customer)"""

EDGES = LN + """,
edges0 AS (
  SELECT host, 'root' AS src, 'c:' || c AS dst, (0 * 2147483648 + c) * 4 AS edge_seq, 'tab' AS kind FROM cust
  UNION ALL SELECT host, 'c:' || c, 'root', (c * 2147483648 + 2147483647) * 4, 'link' FROM cust
  UNION ALL
  SELECT DISTINCT host, CASE r WHEN 1 THEN 'c:' || c WHEN 2 THEN 'p:' || p ELSE 's:' || s END,
    CASE r WHEN 1 THEN 'p:' || p WHEN 2 THEN 's:' || s ELSE 'p:' || p END,
    CASE r WHEN 1 THEN (c * 2147483648 + p) * 4 + 1 WHEN 2 THEN (p * 2147483648 + s) * 4 + 2 ELSE (s * 2147483648 + p) * 4 + 3 END,
    CASE r WHEN 1 THEN 'link' WHEN 2 THEN 'menu' ELSE 'row' END FROM ln),
edges AS MATERIALIZED (SELECT host, src, dst, edge_seq::BIGINT AS edge_seq, kind, 'Open ' || dst AS label, '#' || replace(dst, ':', '-') AS selector FROM edges0)"""

STATES = """
states AS MATERIALIZED (
  SELECT 'shop' || n_nationkey || '.example.com' AS host, 0 AS state_seq, 'root' AS id, 'https://shop' || n_nationkey || '.example.com/' AS url, n_name AS label, 0 AS depth FROM nation
  UNION ALL SELECT host, 1 + c, 'c:' || c, 'https://' || host || '/c/' || c || '?ref=x', c_name, 1 FROM cust
  UNION ALL SELECT host, 1000000000000 + p, 'p:' || p, 'https://' || host || '/p/' || p || '/', coalesce(p_name, ''), 2
    FROM (SELECT DISTINCT host, p FROM ln) LEFT JOIN part ON p_partkey = p
  UNION ALL SELECT host, 2000000000000 + s, 's:' || s, 'https://' || host || '/s/' || s || '?page=2', 'Supplier ' || s, 3 FROM (SELECT DISTINCT host, s FROM ln))"""

TRIGGERS = """
triggers AS MATERIALIZED (
  SELECT host, p AS trig_seq, (CASE WHEN n % 5 = 0 THEN 'Download' ELSE verb END) || ' ' || p_name || (CASE WHEN n % 7 = 0 THEN 's' ELSE '' END) AS label,
    'p:' || p AS state_id, CASE WHEN n % 5 = 0 THEN 'download' ELSE 'form' END AS kind, CASE WHEN n % 5 = 0 THEN -1 ELSE n % 3 END AS fc, n % 2 AS npath,
    CASE WHEN n % 5 <> 0 AND n % 3 = 2 THEN 'https://' || host || '/p/' || p || '/new' END AS opens_at,
    CASE WHEN n % 5 = 0 AND n % 2 = 0 THEN 'https://' || host || '/files/' || p || '.pdf' END AS href, p_type, n,
    CASE WHEN n % 5 = 0 OR n % 3 > 0 THEN 'high' ELSE 'low' END AS confidence
  FROM (SELECT DISTINCT host, p, p_name, p_type, p_size AS n,
      CASE p_size % 4 WHEN 0 THEN 'Create' WHEN 1 THEN 'Add new' WHEN 2 THEN 'Edit' ELSE 'Show' END AS verb FROM ln JOIN part ON p_partkey = p))"""

ITEMS = """
items AS MATERIALIZED (
  SELECT host, 's:' || s AS state_id, 2000000000000 + s AS state_seq, dense_rank() OVER (PARTITION BY host, s ORDER BY p_size % 2) - 1 AS coll_idx, CASE p_size % 2 WHEN 0 THEN 'aria:table' ELSE 'aria:list' END AS kind,
    p AS pk, CASE p_size % 2 WHEN 0 THEN p_name || ' ' || p_brand || ' ' || p ELSE p_name END AS text,
    row_number() OVER (PARTITION BY host, s, p_size % 2 ORDER BY p) - 1 AS item_idx
  FROM (SELECT DISTINCT host, s, p FROM ln) JOIN part ON p_partkey = p)"""


def bfs(roots: str, edges: str = "edges", name: str = "reached", levels: int = 9) -> str:
    """Level-by-level search from ``roots`` (host, root); smallest edge list among the shortest."""
    out = [f"{name}_0 AS MATERIALIZED (SELECT host, root, root AS node, []::BIGINT[] AS path FROM {roots})"]
    seen = f"SELECT host, root, node FROM {name}_0"
    for k in range(1, levels + 1):
        out.append(
            f"{name}_{k} AS MATERIALIZED (SELECT f.host, f.root, e.dst AS node, min(list_append(f.path, e.edge_seq)) AS path "
            f"FROM {name}_{k - 1} f JOIN {edges} e ON e.host = f.host AND e.src = f.node "
            f"WHERE (f.host, f.root, e.dst) NOT IN ({seen}) GROUP BY 1, 2, 3)"
        )
        seen += f" UNION ALL SELECT host, root, node FROM {name}_{k}"
    alls = " UNION ALL ".join(f"SELECT *, {k} AS depth FROM {name}_{k}" for k in range(levels + 1))
    out.append(f"{name} AS MATERIALIZED ({alls})")
    return ",\n".join(out)


GOALS = ("create red gear", "download small plates", "new bolt", "sign in", "show the cold rod", "export")
QUESTIONS = """
firsts AS (SELECT c_nationkey, min(c_custkey) AS c FROM customer GROUP BY 1),
questions AS MATERIALIZED (
  SELECT n_nationkey::BIGINT * 100 + g AS q_id, 'shop' || n_nationkey || '.example.com' AS host, goal, g % 3 AS m, f.c,
    CASE WHEN g % 3 = 1 THEN 'c:' || f.c ELSE 'root' END AS root,
    CASE WHEN g % 3 = 1 THEN 'https://shop' || n_nationkey || '.example.com/c/' || f.c || '?ref=x'
         ELSE 'https://shop' || n_nationkey || '.example.com/' END AS start_url
  FROM nation JOIN firsts f ON f.c_nationkey = n_nationkey, (SELECT unnest(range(6)) AS g, unnest([GOAL_LIST]) AS goal))""".replace("GOAL_LIST", ", ".join(f"'{g}'" for g in GOALS))

_STOP = (
    "['a','an','the','to','of','for','in','on','at','by','with','and','or','my','me','i','do','how','some','this','that','create','add','new','make','start',"
    "'generate','crear','nuevo','nueva','añadir','anadir','agregar','generar','download','export','descargar','exportar','un','una','el','la','los','las','de','para']"
)
_VERBS = "create|add|new|start|crear|nuevo|nueva|añadir|anadir|agregar|generar|download|export|descargar|exportar"
MATCHES = f"""
nouns AS (SELECT q_id, host, goal, list_filter(regexp_extract_all(lower(goal), '\\w+'), lambda w: NOT list_contains({_STOP}, w) AND length(w) > 2) AS n FROM questions),
matches AS MATERIALIZED (
  SELECT q.q_id, q.host, t.trig_seq,
    CASE WHEN len(q.n) = 0 THEN regexp_matches(t.label, '(?i)\\b(?:{_VERBS})\\b')
      ELSE regexp_matches(t.label, '(?i)(?:{_VERBS})\\b.{{0,30}}\\b(?:' || array_to_string(q.n, '|') || ')(?:es|s)?\\b|\\b(?:' || array_to_string(q.n, '|') || ')(?:es|s)?\\b.{{0,30}}\\b(?:{_VERBS})') END AS needle_hit
  FROM nouns q JOIN triggers t ON t.host = q.host
  WHERE CASE WHEN len(q.n) = 0 THEN regexp_matches(t.label, '(?i)\\b(?:{_VERBS})\\b') ELSE regexp_matches(t.label, '(?i)\\b(?:' || array_to_string(q.n, '|') || ')(?:es|s)?\\b') END)"""

ROUTES = f"""{EDGES}, {STATES}, {TRIGGERS}, {QUESTIONS}, {MATCHES},
roots AS (SELECT DISTINCT host, root FROM questions),
{bfs('roots')},
routed AS MATERIALIZED (
  SELECT m.q_id, m.host, m.trig_seq, m.needle_hit, q.root, q.start_url, q.goal, t.label, t.state_id, t.kind, t.fc, t.opens_at, t.href, t.confidence, t.p_type, t.npath, r.depth, r.path, s.url AS state_url,
    row_number() OVER (PARTITION BY m.q_id ORDER BY r.depth IS NULL, r.depth, m.needle_hit DESC, m.trig_seq) AS rn
  FROM matches m JOIN questions q USING (q_id, host) JOIN triggers t USING (host, trig_seq)
  LEFT JOIN reached r ON r.host = m.host AND r.root = q.root AND r.node = t.state_id
  LEFT JOIN states s ON s.host = m.host AND s.id = t.state_id),
counts AS (SELECT q_id, count(*) AS matched, count(depth) AS routed, count(*) FILTER (WHERE depth IS NOT NULL AND confidence = 'high') AS high FROM routed GROUP BY 1),
status AS MATERIALIZED (SELECT q.*, coalesce(matched, 0) AS matched, coalesce(routed, 0) AS routed, coalesce(high, 0) AS high,
  CASE WHEN coalesce(matched, 0) = 0 THEN 'no_match' WHEN routed = 0 THEN 'unreachable' WHEN high = 0 THEN 'no_match' ELSE 'ok' END AS status
  FROM questions q LEFT JOIN counts USING (q_id)),
best AS MATERIALIZED (SELECT * FROM routed WHERE depth IS NOT NULL AND confidence = 'high' QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY rn) = 1)"""
