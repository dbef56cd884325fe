"""Page extraction over the page table and over pages rendered from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import aggregates as A
from ..operators import extract as X
from ..operators import frontier as R
from ..operators import graph as G
from ..operators.dom import elements, parse_pages
from ..operators.sets import LINK_EDGE_KEY, dedupe_edges, union_items, view_swapped
from ..plans.linkgraph import build_link_graph, route_affordances, routing_mode, trigger_table
from ..session import cut
from .column_queries import LINKS, NORM_LINK, NORM_STATE, PARTS
from .derive import shop_pages, table
from .registry import query

big = lambda c: F.col(c).cast("bigint").alias(c)


def _pages(spark, sf):
    return table(spark, sf, "pages")


def _links(spark, sf):
    return X.extract_links(_pages(spark, sf))


# --- the page table ------------------------------------------------------------------------

@query("read_pages", "SELECT page_id, url, length(html)::BIGINT AS html_chars FROM pages")
def read_pages(spark, sf):
    from ..sources.records import read_pages as rp

    return rp(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").cast("bigint").alias("html_chars"))


_LINK_SQL = f"WITH {LINKS} SELECT page_id, i AS link_seq, href, left(text, 90) AS text, false AS download FROM links"


@query("page_links", _LINK_SQL)
def page_links(spark, sf):
    return _links(spark, sf).select("page_id", big("link_seq"), "href", "text", "download")


@query("page_links_parsed", f"WITH {LINKS} SELECT page_id, href, left(text, 90) AS text FROM links")
def page_links_parsed(spark, sf):
    dom = parse_pages(_pages(spark, sf), keep=["a"], texts=["a"])
    return X.extract_links_dom(dom).select("page_id", "href", "text")


# targets and sources of the page corpus as a link graph, host by host
GRAPH = f"""{PARTS}, {LINKS},
page AS (SELECT regexp_replace(lower(net), '^www\\.', '') AS host, {NORM_LINK} AS sid, arg_min(page_id, page_id) AS page_id,
    arg_min(url, page_id) AS url FROM parts GROUP BY 1, 2),
own AS (SELECT p.host, p.sid, p.page_id, l.i, l.href, l.text FROM page p JOIN links l ON l.page_id = p.page_id),
target AS (SELECT *, CASE WHEN length(regexp_extract(href, '^[a-z]+://[^/?#]*(.*)$', 1)) > 1 THEN rtrim(href, '/') ELSE href END AS dst0 FROM own),
edges AS (SELECT host, sid AS src, dst0 AS dst, CASE WHEN text = '' THEN '(link)' ELSE left(text, 90) END AS label, min((page_id, i)) AS at
  FROM target GROUP BY 1, 2, 3, 4)"""


def _corpus_graph(spark, sf):
    pages = _pages(spark, sf)
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return build_link_graph(pages.select("page_id", "url", title.alias("title")), _links(spark, sf))


# links without quotes, left open, with named and numbered entities, and one inside a comment
@query("odd_links", """SELECT p_partkey AS page_id, 'https://parts.example.com/' || unnest(['x/', 'y/', 'z/', 'w/']) || p_partkey AS href, unnest(['Café ' || p_partkey, 'One', 'Two & three', p_name || '…']) AS text FROM part""")
def odd_links(spark, sf):
    # a single small file: spread the rows before the text is built, as in shop_pages
    p = table(spark, sf, "part").select("p_partkey", "p_name").repartition(2 * spark.sparkContext.defaultParallelism)
    k = F.col("p_partkey").cast("string")
    html = F.concat(
        F.lit("<!DOCTYPE html><html><body><!-- <a href='/no'>hidden</a> --><a href=/x/"), k, F.lit(">Caf&eacute; "), k, F.lit("</a><a href='/y/"), k, F.lit("'>One<a href=\"/z/"), k,
        F.lit("\">Two &#38; three</a><p>text</p><a\nhref = '/w/"), k, F.lit("' >"), F.col("p_name"), F.lit("&hellip;</a></body></html>"),
    )
    pages = p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://parts.example.com/p/"), k).alias("url"), html.alias("html"))
    return X.extract_links(pages).select("page_id", "href", "text")


@query("build_link_graph_edges", f"WITH {GRAPH} SELECT host, src, dst, label, 'link' AS kind, false AS skipped FROM edges")
def build_link_graph_edges(spark, sf):
    return _corpus_graph(spark, sf)[1].select("host", "src", "dst", "label", "kind", "skipped")


@query("build_link_graph_nodes", f"""WITH {GRAPH}, titled AS (SELECT p.*, regexp_extract(g.html, '(?s)<title>(.*?)</title>', 1) AS title FROM page p JOIN pages g ON g.page_id = p.page_id),
writes AS (SELECT host, sid AS id, page_id, -1 AS i, url, CASE WHEN title = '' THEN url ELSE title END AS title FROM titled
  UNION ALL SELECT host, dst0, page_id, i, href, CASE WHEN text = '' THEN href ELSE left(text, 90) END FROM target)
SELECT host, id, arg_max(url, (page_id, i)) AS url, arg_max(title, (page_id, i)) AS title, 'page' AS type FROM writes GROUP BY 1, 2""")
def build_link_graph_nodes(spark, sf):
    return _corpus_graph(spark, sf)[0].select("host", "id", "url", "title", "type")


@query("link_degrees", f"""WITH {GRAPH}, n AS (SELECT host, count(*) AS pages FROM (SELECT host, sid FROM page UNION SELECT host, dst FROM edges) GROUP BY 1),
d AS (SELECT host, id, count(*) FILTER (WHERE k = 'i') AS in_degree, count(*) FILTER (WHERE k = 'o') AS out_degree
  FROM (SELECT host, dst AS id, 'i' AS k FROM edges UNION ALL SELECT host, src, 'o' FROM edges) GROUP BY 1, 2)
SELECT d.*, in_degree + out_degree AS degree, in_degree >= greatest(8, 0.4 * pages) AS is_hub FROM d JOIN n USING (host)""")
def link_degrees(spark, sf):
    nodes, edges = _corpus_graph(spark, sf)
    pages = nodes.groupBy("host").agg(F.count("*").alias("pages"))
    limit = F.greatest(F.lit(8.0), F.col("pages") * 0.4)
    return G.degrees(edges).join(pages, "host").select(
        "host", "id", "in_degree", "out_degree", "degree", (F.col("in_degree") >= limit).alias("is_hub")
    )


@query("crawl_meta", f"""WITH {GRAPH} SELECT host, pages, 0::BIGINT AS states, 0::BIGINT AS skipped, 0::BIGINT AS uploads, 0::BIGINT AS downloads, edges FROM
  (SELECT host, count(*) AS pages FROM (SELECT host, sid FROM page UNION SELECT host, dst FROM edges) GROUP BY 1)
  JOIN (SELECT host, count(*) AS edges FROM edges GROUP BY 1) USING (host)""")
def crawl_meta(spark, sf):
    nodes, edges = _corpus_graph(spark, sf)
    return A.crawl_meta(nodes, edges)


_SEC = "coalesce(list_filter(string_split(regexp_extract(split_part(u, '#', 1), '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')[1], 'home')"


@query("section_counts", f"""WITH {GRAPH}, w AS (SELECT host, sid AS id, url AS u, page_id, -1 AS i FROM page UNION ALL SELECT host, dst0, href, page_id, i FROM target),
n AS (SELECT host, id, arg_max(u, (page_id, i)) AS u FROM w GROUP BY 1, 2)
SELECT host, {_SEC} AS section, count(*) AS nodes FROM n GROUP BY 1, 2""")
def section_counts(spark, sf):
    return A.section_counts(_corpus_graph(spark, sf)[0])


@query("node_search", f"""WITH {GRAPH}, w AS (SELECT host, sid AS id, url AS u, page_id, -1 AS i, '' AS t FROM page UNION ALL SELECT host, dst0, href, page_id, i, text FROM target),
n AS (SELECT host, id, arg_max(u, (page_id, i)) AS u, arg_max(t, (page_id, i)) AS t FROM w GROUP BY 1, 2)
SELECT host, id FROM n WHERE contains(lower(u), 'the') AND {_SEC} <> 'en'""")
def node_search(spark, sf):
    nodes = _corpus_graph(spark, sf)[0].withColumn("title", F.col("url"))
    return A.filter_types(A.search_nodes(nodes, "THE"), ["en"]).select("host", "id")


@query("page_url_duplicates", f"""WITH {PARTS}, s AS (SELECT regexp_replace(lower(net), '^www\\.', '') AS host, {NORM_STATE} AS u, split_part(url, '?', 1) AS b FROM parts)
SELECT host, count(*) AS states, count(DISTINCT u) AS urls, count(*) - count(DISTINCT u) AS dup, count(DISTINCT b) AS spread FROM s GROUP BY 1""")
def page_url_duplicates(spark, sf):
    states = _pages(spark, sf).select(urls.host_key("url").alias("host"), "url")
    return A.dup_ratio(states).join(A.base_path_spread(states), "host")


@query("page_collections", """WITH li AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<ul>(.*?)</ul>', 1), '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages),
x AS (SELECT page_id, len(t) AS n, unnest(t) AS t, generate_subscripts(t, 1) AS item_idx FROM li)
SELECT page_id, 'aria:list' AS kind, n::BIGINT AS count, item_idx::BIGINT AS item_idx, left(t, 140) AS t FROM x WHERE n >= 2""")
def page_collections(spark, sf):
    dom = parse_pages(_pages(spark, sf), keep=["table", "ul", "ol", "li", "tr", "td"], texts=["li", "tr", "td"])
    return X.aria_collections(dom).select("page_id", "kind", big("count"), big("item_idx"), "t")


@query("page_signatures", """WITH li AS (SELECT page_id, url, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)[1:40] AS t FROM pages)
SELECT page_id, url || '|' || len(t) || '|' || left(array_to_string(list_transform(t, lambda s: left(s, 80)), '§'), 2000) AS sig FROM li""")
def page_signatures(spark, sf):
    dom = parse_pages(_pages(spark, sf), keep=["li", "tr"], texts=["li", "tr"])
    return X.page_signature(dom)


@query("data_list_sections", f"""WITH {LINKS} SELECT page_id, split_part(href, '/', 4) AS section, count(*) AS links FROM links GROUP BY 1, 2 HAVING count(*) >= 1""")
def data_list_sections(spark, sf):
    return A.data_list_sections(_links(spark, sf), 1)


@query("explorable_links", f"""WITH {LINKS} SELECT page_id, href FROM links
WHERE NOT regexp_matches(text, '(?i)\\b(create|add|new|save|delete|remove|cancel|upload|import)\\b') AND rtrim(href, '/') <> rtrim(split_part(url, '#', 1), '/')""")
def explorable_links(spark, sf):
    return R.explorable(_links(spark, sf).withColumn("bulk", F.lit(False))).select("page_id", "href")


@query("section_cap", f"""WITH {LINKS}, c AS (SELECT regexp_extract(url, '^([a-z]+)', 1) AS host, page_id * 1000 + i AS found_seq, href, split_part(href, '/', 4) AS section FROM links)
SELECT host, found_seq, section FROM c QUALIFY row_number() OVER (PARTITION BY host, section ORDER BY found_seq) <= 2""")
def section_cap(spark, sf):
    c = _links(spark, sf).select(
        urls.scheme("page_url").alias("host"), (F.col("page_id") * 1000 + F.col("link_seq")).cast("bigint").alias("found_seq"), "href"
    )
    return R.cap_per_section(c, 2).select("host", "found_seq", "section")


@query("representative_rows", f"""WITH {LINKS}, c AS (SELECT page_id, i AS link_seq, left(split_part(href, '/', 4), 1) AS section FROM links)
SELECT page_id, section, link_seq FROM c QUALIFY row_number() OVER (PARTITION BY page_id, section ORDER BY link_seq) <= 1""")
def representative_rows(spark, sf):
    c = _links(spark, sf).select("page_id", big("link_seq"), F.substring(urls.section_key("href"), 1, 1).alias("section"))
    return R.representative_rows(c, 1).select("page_id", "section", "link_seq")


# --- crawls: every page links to the pages of five other ids; a site per language, or one site ---------

def _crawl_controls(spark, sf, one_site=True):
    p = _pages(spark, sf)
    n = p.count()
    lang = F.try_element_at(urls.segments("url"), F.lit(1))
    where = F.lit("https://one.example.com/") if one_site else F.concat(F.lit("https://"), lang, F.lit(".example.com/"))
    section = lang if one_site else F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string"))
    one = p.select("page_id", F.concat(where, section, F.lit("/"), F.col("page_id").cast("string")).alias("u"))
    out = one.select("page_id", F.col("u").alias("page_url"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("link_seq"))
    out = out.withColumn("to_id", (F.col("page_id") * 3 + F.col("link_seq")) % F.lit(n))
    to = one.select(F.col("page_id").alias("to_id"), F.col("u").alias("href"))
    controls = out.join(to, "to_id").select(
        "page_id", "page_url", "link_seq", "href", F.lit("go").alias("text"), F.lit(False).alias("bulk")
    )
    host = urls.host_key("u")
    seeds = one.withColumn("host", host).groupBy("host").agg(F.min_by("u", "page_id").alias("url"))
    if one_site:
        return seeds, controls, None
    # every fourth page embeds the page after the next
    frames = one.where("page_id % 4 = 0").select("page_id", F.col("u").alias("page_url"), F.lit(1).alias("link_seq"), ((F.col("page_id") + 2) % n).alias("to_id")).join(to, "to_id")
    return seeds, controls, frames.select("page_id", "page_url", "link_seq", F.col("href").alias("src"))


def _crawl_sql(one_site, max_states, depth, per_section, list_min, budget):
    """The crawl unrolled, a set of clauses a level: found, chosen, known, claimed, cut, numbered."""
    lang = "split_part(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '/', 1)"
    u = f"'https://one.example.com/' || {lang} || '/' || page_id" if one_site else f"'https://' || {lang} || '.example.com/s' || page_id % 3 || '/' || page_id"
    frames = "" if one_site else " UNION ALL SELECT a.u, b.u, 1, 1 FROM cp a JOIN cp b ON b.page_id = (a.page_id + 2) % a.n WHERE a.page_id % 4 = 0"
    out = [f"""cp AS MATERIALIZED (SELECT page_id, {u} AS u, (SELECT count(*) FROM pages) AS n FROM pages),
cl AS MATERIALIZED (SELECT *, split_part(b, '/', 3) AS to_host, split_part(b, '/', 4) AS section FROM (
  SELECT a.u AS a, b.u AS b, 0 AS fr, k AS seq FROM cp a, (SELECT unnest([1, 2, 3, 4, 5]) AS k) JOIN cp b ON b.page_id = (a.page_id * 3 + k) % a.n{frames})),
l0 AS (SELECT split_part(u, '/', 3) AS host, arg_min(u, page_id) AS key, 0 AS depth, NULL AS kind, NULL AS via, 0 AS nr FROM cp GROUP BY 1)"""]
    for k in range(depth):
        states = " UNION ALL ".join(f"SELECT host, key, nr FROM l{i}" for i in range(k + 1))
        claimed = "".join(f" AND NOT EXISTS (SELECT 1 FROM f{i} o WHERE o.host = x.host AND o.b = x.b)" for i in range(k))
        spent = " + ".join(["0", *[f"coalesce((SELECT count(*) FROM ev{i} e WHERE e.host = m.host), 0)" for i in range(k)]])
        before = " + ".join(["0", *[f"(SELECT count(*) FROM t{i} o WHERE o.host = x.host AND o.section = x.section)" for i in range(k)]])
        out.append(f"""s{k} AS MATERIALIZED ({states}),
m{k} AS MATERIALIZED (SELECT l.host, l.nr AS p, cl.*, cl.to_host <> l.host AS away FROM l{k} l JOIN cl ON cl.a = l.key),
li{k} AS (SELECT host, p, section FROM m{k} WHERE fr = 0 AND NOT away GROUP BY ALL HAVING count(*) >= {list_min}),
cv{k} AS MATERIALIZED (SELECT * FROM m{k} m WHERE away AND (fr = 0 OR NOT EXISTS (SELECT 1 FROM m{k} o WHERE o.host = m.host AND o.p = m.p AND o.fr = 0 AND o.b = m.b AND o.b <> o.a))),
ev{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY p, fr, seq) AS rn FROM cv{k}) m WHERE rn + {spent} <= {budget}),
c{k} AS (SELECT host, p, a, b, fr, seq, section, away FROM m{k} WHERE NOT away UNION ALL SELECT host, p, a, b, fr, seq, section, away FROM ev{k}),
d{k} AS MATERIALIZED (SELECT c.*, li.section IS NOT NULL AND NOT away AS listed FROM c{k} c LEFT JOIN li{k} li USING (host, p, section) WHERE fr = 0 AND a <> b QUALIFY row_number() OVER (PARTITION BY host, p, b ORDER BY seq) = 1),
w{k} AS MATERIALIZED (SELECT host, p, a, b, fr, seq, section, CASE WHEN away THEN 'external' WHEN listed THEN 'row' ELSE 'link' END AS kind FROM d{k} QUALIFY NOT listed OR row_number() OVER (PARTITION BY host, p, section, listed ORDER BY seq) <= 1),
n{k} AS MATERIALIZED (SELECT * FROM w{k} UNION ALL SELECT host, p, a, b, fr, seq, section, 'iframe' FROM c{k} c WHERE fr = 1 AND NOT EXISTS (SELECT 1 FROM w{k} o WHERE o.host = c.host AND o.p = c.p AND o.b = c.b)),
e{k} AS (SELECT n.host, n.a, n.b, n.kind FROM n{k} n JOIN s{k} s ON s.host = n.host AND s.key = n.b AND s.nr <= n.p),
f{k} AS MATERIALIZED (SELECT * FROM n{k} x WHERE NOT EXISTS (SELECT 1 FROM s{k} s WHERE s.host = x.host AND s.key = x.b){claimed} QUALIFY row_number() OVER (PARTITION BY host, b ORDER BY p, fr, seq) = 1),
t{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, section ORDER BY p, fr, seq) AS rn FROM f{k}) x WHERE rn + {before} <= {per_section}),
q{k} AS MATERIALIZED (SELECT host, b AS key, {k + 1} AS depth, kind, a AS via, (SELECT count(*) FROM s{k} s WHERE s.host = t.host) + row_number() OVER (PARTITION BY host ORDER BY CASE kind WHEN 'row' THEN 2 ELSE 1 END, p, fr, seq) - 1 AS nr FROM t{k} t),
l{k + 1} AS MATERIALIZED (SELECT * FROM q{k} WHERE nr < {max_states})""")
    every = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(depth + 1))
    back = " UNION ALL ".join(f"SELECT * FROM e{i}" for i in range(depth))
    left = " + ".join(f"(SELECT count(*) FROM q{i} q WHERE q.host = l0.host AND nr >= {max_states})" for i in range(depth))
    head = "WITH " + ",\n".join(out)
    return {
        "states": f"{head} SELECT host, nr::BIGINT AS state_seq, key, depth::BIGINT AS depth, kind FROM ({every})",
        "edges": f"{head} SELECT host, via AS from_key, key AS to_key, kind FROM ({every}) WHERE via IS NOT NULL UNION ALL SELECT * FROM ({back})",
        "stop": f"{head}, z AS (SELECT host, (SELECT count(*) FROM ({every}) x WHERE x.host = l0.host) AS states, ({left})::BIGINT AS queued FROM l0) "
                f"SELECT host, states, queued, CASE WHEN queued = 0 THEN 'frontier-exhausted' ELSE 'hit-max-states({max_states})' END AS stopped FROM z",
    }


_ONE = dict(max_states=500, max_depth=6, max_per_section=40, data_list_min=4)
_ONE_SQL = _crawl_sql(True, 500, 6, 40, 4, 0)
_SITES = dict(max_states=40, max_depth=5, max_per_section=12, data_list_min=3, cross_host=True, max_cross_host=25)
_SITES_SQL = _crawl_sql(False, 40, 5, 12, 3, 25)


@query("frontier_crawl_states", _ONE_SQL["states"])
def frontier_crawl_states(spark, sf):
    seeds, controls, _ = _crawl_controls(spark, sf)
    states, _, _ = R.frontier_expand(seeds, controls, **_ONE)
    return states.select("host", big("state_seq"), "key", big("depth"), "kind")


@query("frontier_crawl_edges", _ONE_SQL["edges"])
def frontier_crawl_edges(spark, sf):
    seeds, controls, _ = _crawl_controls(spark, sf)
    _, edges, _ = R.frontier_expand(seeds, controls, **_ONE)
    return edges.select("host", "from_key", "to_key", "kind")


@query("frontier_crawl_sites", _SITES_SQL["states"])
def frontier_crawl_sites(spark, sf):
    seeds, controls, frames = _crawl_controls(spark, sf, one_site=False)
    states, _, _ = R.frontier_expand(seeds, controls, frames=frames, **_SITES)
    return states.select("host", big("state_seq"), "key", big("depth"), "kind")


@query("frontier_crawl_stop", _SITES_SQL["stop"])
def frontier_crawl_stop(spark, sf):
    seeds, controls, frames = _crawl_controls(spark, sf, one_site=False)
    _, _, reasons = R.frontier_expand(seeds, controls, frames=frames, **_SITES)
    return reasons.select("host", "states", "queued", "stopped")


# --- pages rendered from the part table ------------------------------------------------------

def _controls_dom(spark, sf):
    return X.controls_dom(shop_pages(spark, sf))


# one row per control of a rendered page: (page_id, grp, j, text, tag, role, nav, selector)
_P = "SELECT p_partkey AS page_id, p_name, p_brand, p_size AS n FROM part"
SHOP_CONTROLS = f"""p AS ({_P}), c AS (
  SELECT page_id, 1 AS g, 0 AS j, 'All parts' AS text, 'a' AS tag, '' AS role, true AS nav, 'https://parts.example.com/parts/' || page_id || '?utm_source=nav' AS href FROM p
  UNION ALL SELECT page_id, 2, 0, 'Brand sheet', 'a', '', true, 'https://parts.example.com/b/' || replace(p_brand, '#', '') || '.pdf' FROM p
  UNION ALL SELECT page_id, 3, 0, 'Create ' || p_name, 'button', '', false, NULL FROM p
  UNION ALL SELECT page_id, 4, 0, 'Delete', 'button', '', false, NULL FROM p
  UNION ALL SELECT page_id, 5, unnest(range(n % 4)), 'Tab', 'button', 'tab', true, NULL FROM p
  UNION ALL SELECT page_id, 6, 0, 'Export data', 'button', '', false, NULL FROM p WHERE n % 6 = 0
  UNION ALL SELECT page_id, 7, 0, 'Save order', 'button', '', false, NULL FROM p WHERE n % 3 <> 0
  UNION ALL SELECT page_id, 8, 0, 'Search', 'button', '', false, NULL FROM p WHERE n % 3 <> 0
  UNION ALL SELECT page_id, 9, 0, 'More', 'a', '', false, 'https://parts.example.com/p/' || page_id || '?page=' || n FROM p WHERE n % 4 = 0
  UNION ALL SELECT page_id, 10, 0, 'Next', 'a', '', false, 'https://parts.example.com/p/' || page_id || '#' FROM p WHERE n % 4 = 1
  UNION ALL SELECT page_id, 11, 0, 'End', 'a', '', false, 'https://parts.example.com/p/' || page_id || '#e' FROM p WHERE n % 4 = 1
  UNION ALL SELECT page_id, 12, 0, '>>', 'button', '', false, NULL FROM p WHERE n % 4 = 2),
controls AS (SELECT *, CASE WHEN role = 'tab' THEN 'Tab ' || (j + 1) ELSE text END AS label, row_number() OVER (PARTITION BY page_id ORDER BY g, j) AS ctrl_seq FROM c)"""


@query("page_controls", f"WITH {SHOP_CONTROLS} SELECT page_id, ctrl_seq, label AS text, tag, role, nav, href FROM controls")
def page_controls(spark, sf):
    return X.extract_controls(_controls_dom(spark, sf)).select("page_id", big("ctrl_seq"), "text", "tag", "role", "nav", "href")


@query("page_selectors", f"""WITH {SHOP_CONTROLS}, b AS (SELECT c.*, p.n FROM controls c JOIN (SELECT page_id AS pid, n FROM p) p ON p.pid = c.page_id)
SELECT page_id, ctrl_seq, CASE g WHEN 1 THEN 'nav>ul>li:nth-of-type(1)>a' WHEN 2 THEN 'nav>ul>li:nth-of-type(2)>a' WHEN 3 THEN 'button:nth-of-type(1)'
  WHEN 4 THEN '#del' || page_id WHEN 5 THEN 'div:nth-of-type(1)>button' || (CASE WHEN n % 4 > 1 THEN ':nth-of-type(' || (j + 1) || ')' ELSE '' END)
  WHEN 6 THEN '#exp' WHEN 7 THEN 'form>button:nth-of-type(1)' WHEN 8 THEN 'form>button:nth-of-type(2)' WHEN 9 THEN 'a' WHEN 10 THEN '#nx'
  WHEN 11 THEN 'ul>li:nth-of-type(2)>a' ELSE '#nb' END AS selector FROM b""")
def page_selectors(spark, sf):
    return X.extract_controls(_controls_dom(spark, sf)).select("page_id", big("ctrl_seq"), "selector")


# actions: buttons, tabs, file inputs; table buttons are bulk
SHOP_ACTIONS = f"""p AS ({_P}), act AS (
  SELECT page_id, 'Create ' || p_name AS text, 'button' AS tag, false AS nav, false AS bulk, false AS upload, NULL AS accept, false AS download, 3 AS g, 0 AS j FROM p
  UNION ALL SELECT page_id, 'Delete', 'button', false, false, false, NULL, false, 4, 0 FROM p
  UNION ALL SELECT page_id, 'Tab ' || (unnest(range(n % 4)) + 1), 'button', true, false, false, NULL, false, 5, unnest(range(n % 4)) FROM p
  UNION ALL SELECT page_id, 'Export data', 'button', false, false, false, NULL, true, 6, 0 FROM p WHERE n % 6 = 0
  UNION ALL SELECT page_id, 'Row', 'button', false, true, false, NULL, false, 7, unnest(range(n % 5)) FROM p
  UNION ALL SELECT page_id, 'Document', 'input', false, false, true, '.pdf', false, 8, 0 FROM p WHERE n % 3 <> 0
  UNION ALL SELECT page_id, 'Save order', 'button', false, false, false, NULL, false, 9, 0 FROM p WHERE n % 3 <> 0
  UNION ALL SELECT page_id, 'Search', 'button', false, false, false, NULL, false, 10, 0 FROM p WHERE n % 3 <> 0
  UNION ALL SELECT page_id, '>>', 'button', false, false, false, NULL, false, 11, 0 FROM p WHERE n % 4 = 2)"""


@query("page_actions", f"WITH {SHOP_ACTIONS} SELECT page_id, text, tag, nav, bulk, upload, accept, download FROM act")
def page_actions(spark, sf):
    return X.extract_actions(_controls_dom(spark, sf)).select("page_id", "text", "tag", "nav", "bulk", "upload", "accept", "download")


@query("page_uploads", f"""WITH {SHOP_ACTIONS} SELECT page_id, text, tag, accept, '#doc' AS selector FROM act WHERE upload
UNION ALL SELECT page_id, 'Attach', 'label', 'image/*', '#up' FROM p WHERE n % 8 = 0""")
def page_uploads(spark, sf):
    dom = cut(_controls_dom(spark, sf))
    up = X.upload_affordances(dom, X.extract_actions(dom))
    return up.where("upload").select("page_id", "text", "tag", "accept", "selector")


@query("capped_actions", f"WITH {SHOP_ACTIONS} SELECT page_id, text FROM act QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY g, j) <= 4")
def capped_actions(spark, sf):
    return R.cap_actions(X.extract_actions(_controls_dom(spark, sf)), 4).select("page_id", "text")


@query("nav_actions", f"WITH {SHOP_ACTIONS} SELECT page_id, text FROM act WHERE nav AND NOT bulk")
def nav_actions(spark, sf):
    return R.nav_only(X.extract_actions(_controls_dom(spark, sf))).select("page_id", "text")


@query("controls_by_spec", """SELECT p_partkey AS page_id, 'Brand sheet' AS text, 'download' AS kind, 'direct' AS dl_kind FROM part
UNION ALL SELECT p_partkey, 'Export data', 'download', 'js' FROM part WHERE p_size % 6 = 0""")
def controls_by_spec(spark, sf):
    return X.query_controls(_controls_dom(spark, sf), kind="download", label="sheet|export").select("page_id", "text", "kind", "dl_kind")


@query("controls_in_root", "SELECT p_partkey AS page_id, unnest(['Save order', 'Search']) AS text, 'button' AS kind FROM part WHERE p_size % 3 <> 0")
def controls_in_root(spark, sf):
    dom = parse_pages(shop_pages(spark, sf), keep=["a", "button", "summary", "input", "form"], texts=["a", "button", "summary"])
    return X.query_controls(dom, kind="button", root="form").select("page_id", "text", "kind")


@query("page_forms", """SELECT p_partkey AS page_id, 'Order ' || p_name AS title, '#qty' AS first_selector, true AS first_required,
  'Quantity:text' || (CASE WHEN p_size % 7 = 0 THEN ',Password:password' ELSE '' END) || (CASE WHEN p_size % 3 = 2 THEN ',Kind:select' ELSE '' END) || ',Document:file' AS fields,
  (2 + (CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_size % 3 = 2 THEN 1 ELSE 0 END))::BIGINT AS field_count,
  CASE WHEN p_size % 3 = 2 THEN p_type || '|OTHER' ELSE '' END AS options, 'Save order' AS submit, 'form>button:nth-of-type(1)' AS submit_selector
FROM part WHERE p_size % 3 <> 0""")
def page_forms(spark, sf):
    dom = parse_pages(X.with_form_fields(shop_pages(spark, sf).where(F.col("html").contains("<form"))))
    f = X.extract_forms(dom)
    opts = F.filter(F.col("form.fields"), lambda x: x["options"].isNotNull())
    return f.select(
        "page_id", "form.title", F.try_element_at("form.fields", F.lit(1))["selector"].alias("first_selector"),
        F.try_element_at("form.fields", F.lit(1))["required"].alias("first_required"),
        F.array_join(F.transform("form.fields", lambda x: F.concat(x["label"], F.lit(":"), x["type"])), ",").alias("fields"),
        F.col("form.fieldCount").cast("bigint").alias("field_count"),
        F.coalesce(F.array_join(F.try_element_at(opts, F.lit(1))["options"], "|"), F.lit("")).alias("options"),
        F.array_join("form.submitButtons", "|").alias("submit"), F.col("form.submitSelector").alias("submit_selector"),
    )


@query("form_states", """SELECT p_partkey AS page_id, ((CASE WHEN p_size % 3 <> 0 THEN 2 + (CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_size % 3 = 2 THEN 1 ELSE 0 END) ELSE 0 END))::BIGINT AS fields,
  p_size % 3 <> 0 AND p_size % 7 = 0 AS has_password, p_size % 3 <> 0 AS is_form_state FROM part""")
def form_states(spark, sf):
    dom = parse_pages(shop_pages(spark, sf), keep=["input", "select", "textarea", "button"], texts=[])
    return X.form_bearing(dom).select("page_id", big("fields"), "has_password", "is_form_state")


SHOP_COLLECTIONS = f"""p AS ({_P}), it AS (
  SELECT page_id, 1 AS k, 'aria:list' AS kind, 2 AS cnt, 1 AS item_idx, 'All parts' AS t, '' AS cells FROM p
  UNION ALL SELECT page_id, 1, 'aria:list', 2, 2, 'Brand sheet', '' FROM p
  UNION ALL SELECT page_id, 2, 'aria:table', n % 5, x, p_name || ' ' || x || ' ' || (x * n) || ' Row', p_name || ' ' || x || '|' || (x * n) || '|Row'
    FROM (SELECT *, unnest(range(1, (n % 5 + 1)::BIGINT)) AS x FROM p WHERE n % 5 >= 2)
  UNION ALL SELECT page_id, 4, 'repeated:div', n % 9, x, 'Card ' || x || ' of ' || p_name, '' FROM (SELECT *, unnest(range(1, (n % 9 + 1)::BIGINT)) AS x FROM p WHERE n % 9 >= 5)
  UNION ALL SELECT page_id, 3, 'aria:list', 2, 1, 'Next', '' FROM p WHERE n % 4 = 1
  UNION ALL SELECT page_id, 3, 'aria:list', 2, 2, 'End', '' FROM p WHERE n % 4 = 1)"""


@query("shop_collections", f"""WITH {SHOP_COLLECTIONS} SELECT page_id, kind, cnt::BIGINT AS count, item_idx::BIGINT AS item_idx, t, cells,
  dense_rank() OVER (PARTITION BY page_id ORDER BY k) AS coll_idx FROM it""")
def shop_collections(spark, sf):
    dom = parse_pages(shop_pages(spark, sf), keep=["table", "ul", "ol", "li", "tr", "td", "div"], texts=["li", "tr", "td", "div"])
    return X.extract_collections(dom).select(
        "page_id", "kind", big("count"), big("item_idx"), "t", F.coalesce(F.array_join("cells", "|"), F.lit("")).alias("cells"), big("coll_idx")
    )


@query("repeated_siblings", f"WITH {SHOP_COLLECTIONS} SELECT page_id, item_idx::BIGINT AS item_idx, t FROM it WHERE k = 4")
def repeated_siblings(spark, sf):
    dom = parse_pages(shop_pages(spark, sf), keep=["div"], texts=["div"])
    return X.sibling_collections(dom).select("page_id", big("item_idx"), "t")


@query("dominant_collections", f"""WITH {SHOP_COLLECTIONS}, c AS (SELECT page_id, k, kind, max(cnt) AS cnt FROM it GROUP BY ALL)
SELECT page_id, arg_max(kind, cnt * 10 - k) AS kind, max(cnt)::BIGINT AS count FROM c GROUP BY 1""")
def dominant_collections(spark, sf):
    c = shop_collections(spark, sf).where("item_idx = 1")
    return A.dominant_collection(c).select("page_id", "kind", big("count"))


@query("collected_items", f"WITH {SHOP_COLLECTIONS} SELECT page_id, item_idx::BIGINT AS item_idx, t FROM it WHERE kind = 'aria:table'")
def collected_items(spark, sf):
    return A.collect_items(shop_collections(spark, sf), "aria:table").select("page_id", "item_idx", "t")


@query("item_union", f"""WITH {SHOP_COLLECTIONS}, r AS (SELECT page_id, 0 AS round, item_idx, t FROM it WHERE k = 2 UNION ALL SELECT page_id, 1, item_idx + 1, t FROM it WHERE k = 2
  UNION ALL SELECT page_id, 1, 1, 'new' FROM it WHERE k = 2 AND item_idx = 1)
SELECT page_id, t, min(round * 1000 + item_idx)::BIGINT AS at FROM r GROUP BY 1, 2""")
def item_union(spark, sf):
    one = shop_collections(spark, sf).where("kind = 'aria:table'").select(
        "page_id", "kind", "item_idx", "t", F.split("cells", r"\|").alias("cells"), F.lit(None).cast("int").alias("level")
    )
    again = one.withColumn("item_idx", F.col("item_idx") + 1).unionByName(
        one.where("item_idx = 1").withColumn("t", F.lit("new")).withColumn("cells", F.array().cast("array<string>"))
    )
    both = one.withColumn("round", F.lit(0)).unionByName(again.withColumn("round", F.lit(1)))
    return union_items(both).select("page_id", "t", (F.col("round") * 1000 + F.col("item_idx")).cast("bigint").alias("at"))


@query("next_pages", """SELECT p_partkey AS page_id, p_size % 4 <> 3 AS found, p_size % 4 IN (1, 3) AS exhausted,
  CASE p_size % 4 WHEN 0 THEN 'a' WHEN 1 THEN '#nx' WHEN 2 THEN '#nb' END AS selector, CASE p_size % 4 WHEN 0 THEN 'More' WHEN 1 THEN 'Next' WHEN 2 THEN '>>' END AS text FROM part""")
def next_pages(spark, sf):
    dom = parse_pages(shop_pages(spark, sf), keep=["a", "button", "nav", "ul", "li", "link"], texts=["a", "button"])
    return X.next_page_link(dom)


@query("iframes", "SELECT p_partkey AS page_id, 'https://embed.example.org/' || p_partkey AS src FROM part WHERE p_size % 5 = 0")
def iframes(spark, sf):
    return X.iframe_sources(parse_pages(shop_pages(spark, sf), keep=["iframe"], texts=[])).select("page_id", "src")


def _routed(spark, sf, skip_writes):
    pages = cut(shop_pages(spark, sf))
    dom = X.controls_dom(pages)
    at = pages.select("page_id", F.lit("parts.example.com").alias("host"), urls.normalize_url("url").alias("sid"))
    return route_affordances(X.extract_links(pages).join(at, "page_id"), X.extract_actions(dom).join(at, "page_id"), skip_writes=skip_writes)


@query("routed_affordances", f"""WITH {SHOP_ACTIONS}, a AS (SELECT page_id, CASE WHEN upload THEN 'upload' WHEN download THEN 'download'
    WHEN regexp_matches(text, '(?i)\\b(delete|order)\\b') THEN 'destructive' WHEN regexp_matches(text, '(?i)\\b(create|new|save|export)\\b') THEN 'write' ELSE 'probe' END AS route FROM act)
SELECT route, count(*) AS n FROM a GROUP BY 1
UNION ALL SELECT 'link download', count(*) FROM part
UNION ALL SELECT 'link page', count(*) + count(*) FILTER (WHERE p_size % 4 = 0) + 2 * count(*) FILTER (WHERE p_size % 4 = 1) FROM part""")
def routed_affordances(spark, sf):
    r = _routed(spark, sf, True)
    name = F.when(F.col("kind") == "link", F.concat(F.lit("link "), F.col("route"))).when(F.col("route") == "skipped", F.col("reason")).otherwise(F.col("route"))
    return r.groupBy(name.alias("route")).agg(F.count("*").alias("n"))


@query("affordance_nodes", f"""WITH {SHOP_ACTIONS}
SELECT 'https://parts.example.com/p/' || page_id || '##upload:' || left(sha1('#docDocument'), 6) AS id, '⬆ Document [.pdf]' AS title, 'upload' AS route FROM act WHERE upload
UNION ALL SELECT 'https://parts.example.com/p/' || page_id || '##download:' || left(sha1('#expExport data'), 6), '⬇ Export data [js]', 'download' FROM act WHERE download
UNION ALL SELECT 'https://parts.example.com/p/' || page_id || '##skipped:' || left(sha1('#del' || page_id || 'Delete'), 6), '⚠ Delete', 'skipped' FROM p""")
def affordance_nodes(spark, sf):
    r = _routed(spark, sf, False).where("kind = 'action' and route <> 'probe'")
    return r.where(F.col("label").isin("Document", "Export data", "Delete")).select("id", "title", "route")


@query("ranked_triggers", f"""WITH {SHOP_CONTROLS} SELECT page_id, label AS text, 1::BIGINT AS rank FROM controls WHERE g = 3""")
def ranked_triggers(spark, sf):
    c = X.extract_controls(_controls_dom(spark, sf))
    return R.rank_triggers(c).select("page_id", "text", big("rank"))


def _trigger_inputs(spark, sf):
    pages = cut(shop_pages(spark, sf))
    controls = X.extract_controls(X.controls_dom(pages))
    forms = X.extract_forms(parse_pages(pages.where(F.col("html").contains("<form"))))
    bearing = X.form_bearing(parse_pages(pages, keep=["input", "select", "textarea", "button"], texts=[])).join(
        forms.select("page_id", "form"), "page_id", "left"
    )
    k = F.col("page_id").cast("string")
    visits = pages.select(
        F.lit("parts.example.com").alias("host"), F.col("page_id").alias("visit_seq"), "page_id", "url", F.concat(F.lit("s"), k).alias("state_id"),
        F.when(F.col("page_id") > 0, F.lit("s0")).alias("parent_id"), F.concat(F.lit("Part "), k).alias("via_label"), F.lit("#p").alias("via_selector"),
        F.array(F.struct(F.concat(F.lit("Part "), k).alias("label"), F.lit("#p").alias("selector"), F.col("url").alias("href"))).alias("path"),
    )
    creates = R.rank_triggers(controls).select("page_id", "key")
    form = F.col("form")
    reads = creates.join(forms.select("page_id", form), "page_id", "left").withColumn("opens_at", F.lit(None).cast("string"))
    return visits, controls, reads, bearing


@query("crawl_triggers", """WITH p AS (SELECT p_partkey, p_name, p_size AS n FROM part),
f AS (SELECT p_name, arg_min(CASE WHEN n % 3 = 0 THEN -1 ELSE 2 + (CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END) + (CASE WHEN n % 3 = 2 THEN 1 ELSE 0 END) END, p_partkey) AS fc FROM p GROUP BY 1)
SELECT p_partkey AS visit_seq, 'Create ' || p_name AS label, 's' || p_partkey AS state_id, 'form' AS kind, fc::BIGINT AS fields FROM p JOIN f USING (p_name)
UNION ALL SELECT p_partkey, 'Brand sheet', 's' || p_partkey, 'download', -1 FROM p
UNION ALL SELECT p_partkey, 'Export data', 's' || p_partkey, 'download', -1 FROM p WHERE n % 6 = 0
UNION ALL SELECT p_partkey, 'Part ' || p_partkey, 's0', 'form', 2 + (CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END) + (CASE WHEN n % 3 = 2 THEN 1 ELSE 0 END) FROM p WHERE n % 3 <> 0 AND p_partkey > 0""")
def crawl_triggers(spark, sf):
    t = trigger_table(*_trigger_inputs(spark, sf))
    return t.select("visit_seq", "label", "state_id", "kind", F.coalesce(F.col("form.fieldCount"), F.lit(-1)).cast("bigint").alias("fields"))


@query("reused_forms", """WITH p AS (SELECT p_partkey, lower(p_name) AS key, p_size % 3 AS f FROM part)
SELECT p_partkey AS trig_seq, (SELECT arg_min(f, q.p_partkey) FROM p q WHERE q.key = p.key)::BIGINT AS fields FROM p""")
def reused_forms(spark, sf):
    t = table(spark, sf, "part").select(
        F.lit("h").alias("host"), F.col("p_partkey").alias("trig_seq"), F.col("p_name").alias("label"),
        F.struct((F.col("p_size") % 3).alias("fieldCount")).alias("form"), F.lit("").alias("opens_at"),
    )
    return R.reuse_forms(t).select("trig_seq", F.col("form.fieldCount").cast("bigint").alias("fields"))


@query("swapped_views", """SELECT p_partkey AS page_id, p_size % 4 <> 0 AS swapped FROM part""")
def swapped_views(spark, sf):
    n = F.col("p_size") % 4
    ctl = lambda t: F.struct(t.alias("text"), F.lit(False).alias("bulk"))
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("page_id"), F.array(ctl(F.col("p_name")), ctl(F.lit("Home"))).alias("b"),
        F.array(ctl(F.lit("Home")), ctl(F.when((n == 0) | (n == 1), F.col("p_name")).otherwise("Other"))).alias("a"), F.array(F.lit("x")).alias("bv"),
        F.array(F.when(n == 1, "y").otherwise("x")).alias("av"),
    )
    return p.select("page_id", view_swapped("b", "a", "bv", "av").alias("swapped"))


@query("routing_modes", """SELECT 'h' || s_suppkey AS host, s_nationkey % 4 = 2 OR s_nationkey % 4 = 3 AS single_url FROM supplier""")
def routing_modes(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("h"), F.col("s_suppkey").cast("string")).alias("host"), (F.col("s_nationkey") % 4).alias("m"))
    snap = s.select("host", "m", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("probe_seq"))
    # m=0: nothing moves; m=1: probe 2 changes the url; m=2: probe 1 swaps the view; m=3: the third probe swaps, after fragment-only changes
    url = F.when((F.col("m") == 1) & (F.col("probe_seq") >= 2), "https://x.test/b").otherwise(
        F.concat(F.lit("https://x.test/a#"), F.col("probe_seq").cast("string"))
    )
    at = F.when(F.col("m") == 2, 1).when(F.col("m") == 3, 3).otherwise(99)
    labels_ = F.transform(
        F.sequence(F.lit(1), F.lit(9)),
        lambda i: F.struct(F.concat(F.when(F.col("probe_seq") >= at, "B").otherwise("A"), i.cast("string")).alias("text"), F.lit(False).alias("bulk")),
    )
    return routing_mode(snap.select("host", "probe_seq", url.alias("url"), labels_.alias("controls"), F.array().cast("array<string>").alias("view")))


@query("link_edge_dedupe", """WITH e AS (SELECT l_orderkey AS src, l_partkey % 50 AS dst, l_returnflag AS label, l_linestatus AS kind, min(l_linenumber) AS seq FROM lineitem GROUP BY 1, 2, 3, 4)
SELECT src, dst, label, kind, seq::BIGINT AS edge_seq FROM e""")
def link_edge_dedupe(spark, sf):
    e = table(spark, sf, "lineitem").select(
        F.lit("h").alias("host"), F.col("l_orderkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"), F.col("l_returnflag").alias("label"),
        F.col("l_linestatus").alias("kind"), F.col("l_linenumber").cast("bigint").alias("edge_seq"),
    )
    return dedupe_edges(e, LINK_EDGE_KEY).select("src", "dst", "label", "kind", "edge_seq")


@query("parsed_elements", """SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS items, len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs FROM pages""")
def parsed_elements(spark, sf):
    n = elements(parse_pages(_pages(spark, sf), keep=["li", "p"], texts=[]))
    return n.groupBy("page_id").agg(F.count_if(F.col("tag") == "li").alias("items"), F.count_if(F.col("tag") == "p").alias("paragraphs"))
