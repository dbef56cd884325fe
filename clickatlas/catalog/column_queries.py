"""URL, label and text functions over the page, part, document and conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import labels, urls
from ..operators.extract import extract_links
from .derive import table
from .registry import query

# --- SQL pieces ------------------------------------------------------------------------

# url parts of the page table
PARTS = """
parts AS (
  SELECT page_id, url, split_part(url, '#', 1) AS nofrag,
         regexp_extract(url, '^([a-z]+):', 1) AS sch, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS net,
         regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS pth,
         regexp_extract(split_part(url, '#', 1), '\\?(.*)$', 1) AS qry
  FROM pages)"""


def _kept(pattern: str) -> str:
    return (
        "list_sort(list_filter(string_split(qry, '&'), "
        f"lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '{pattern}')))"
    )


LINK_Q = "array_to_string(" + _kept("(?i)^(utm_|gclid$|fbclid$|mc_|ref$|ref_src$|_ga$)") + ", '&')"
STATE_Q = "array_to_string(" + _kept("(?i)^(utm_.*|mc_.*|gclid|fbclid|_ga|igshid|ref|ref_src|yclid|msclkid)$") + ", '&')"
RTRIM_PATH = "regexp_replace(pth, '/+$', '')"
NORM_LINK = (
    f"sch || '://' || lower(net) || (CASE WHEN length(pth) > 1 THEN {RTRIM_PATH} WHEN pth = '' THEN '/' ELSE pth END)"
    f" || (CASE WHEN {LINK_Q} <> '' THEN '?' || {LINK_Q} ELSE '' END)"
)
NORM_STATE = f"sch || '://' || net || {RTRIM_PATH} || (CASE WHEN {STATE_Q} <> '' THEN '?' || {STATE_Q} ELSE '' END)"

# links of the page table: all are root-relative
LINKS = """
raw_links AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS h,
         unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS t,
         unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')))) AS i
  FROM pages),
links AS (
  SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h AS href, arg_min(t, i) AS text, min(i) AS i
  FROM raw_links GROUP BY ALL)"""


def _pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url")


@query("url_normalize", f"WITH {PARTS} SELECT page_id, {NORM_LINK} AS norm, sch || '://' || lower(net) || (CASE WHEN length(pth) > 1 THEN {RTRIM_PATH} ELSE pth END) || (CASE WHEN qry <> '' THEN '?' || array_to_string(list_sort(string_split(qry, '&')), '&') ELSE '' END) AS norm_keep FROM parts")
def url_normalize(spark, sf):
    return _pages(spark, sf).select(
        "page_id", urls.normalize_url("url").alias("norm"), urls.normalize_url("url", strip=False).alias("norm_keep")
    )


@query("url_norm_state", f"WITH {PARTS} SELECT page_id, {NORM_STATE} AS norm, 'u::' || {NORM_STATE} AS state_key FROM parts")
def url_norm_state(spark, sf):
    return _pages(spark, sf).select(
        "page_id", urls.norm_state_url("url").alias("norm"), urls.nav_state_key("url").alias("state_key")
    )


@query("url_norm_light", "SELECT page_id, split_part(rtrim(url, '/'), '#', 1) AS light FROM pages")
def url_norm_light(spark, sf):
    return _pages(spark, sf).select("page_id", urls.norm_light("url").alias("light"))


@query("url_host_key", f"""WITH {PARTS} SELECT page_id, regexp_replace(lower(net), '^www\\.', '') AS host,
  array_to_string(list_reverse(list_reverse(string_split(regexp_replace(lower(net), '^www\\.', ''), '.'))[1:2]), '.') AS site,
  regexp_replace(lower(net), '^www\\.', '') = 'blog.ththan.example.net' AS same FROM parts""")
def url_host_key(spark, sf):
    return _pages(spark, sf).select(
        "page_id", urls.host_key("url").alias("host"), urls.host_key("url", subdomains=True).alias("site"),
        urls.same_host("url", F.lit("http://www.blog.ththan.example.net/x")).alias("same"),
    )


@query("url_section_key", f"""WITH {PARTS} SELECT page_id,
  coalesce(list_filter(string_split(pth, '/'), lambda s: s <> '')[1], 'root') || (CASE WHEN qry <> '' THEN '?' || qry ELSE '' END) AS section_key,
  coalesce(list_filter(string_split(pth, '/'), lambda s: s <> '')[1], 'home') AS section FROM parts""")
def url_section_key(spark, sf):
    return _pages(spark, sf).select(
        "page_id", urls.section_key("url").alias("section_key"), urls.section_of("url").alias("section")
    )


@query("url_short_label", f"""WITH {PARTS}, s AS (SELECT page_id, list_filter(string_split(pth, '/'), lambda s: s <> '') AS g FROM parts)
SELECT page_id, '/' || array_to_string(CASE WHEN len(g) > 2 THEN g[-2:] ELSE g END, '/') AS short,
  '/' || array_to_string(CASE WHEN len(g) > 2 THEN g[-2:] ELSE g END, '/') AS path2 FROM s""")
def url_short_label(spark, sf):
    return _pages(spark, sf).select(
        "page_id", urls.short_label("url", F.lit("t")).alias("short"), urls.url_path("url").alias("path2")
    )


_FILE = "('https://f.example.com/' || replace(p_type, ' ', '') || '/' || p_partkey || (CASE p_size % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PARQUET?x=1' WHEN 2 THEN '.html' WHEN 3 THEN '.jpeg#a' WHEN 4 THEN '/zip' ELSE '.zip;v=1' END))"


def _file_url():
    n = F.col("p_size") % 6
    tail = F.when(n == 0, ".pdf").when(n == 1, ".PARQUET?x=1").when(n == 2, ".html").when(n == 3, ".jpeg#a").when(n == 4, "/zip").otherwise(".zip;v=1")
    return F.concat(F.lit("https://f.example.com/"), F.replace("p_type", F.lit(" "), F.lit("")), F.lit("/"), F.col("p_partkey").cast("string"), tail)


@query("url_direct_download", "SELECT p_partkey, p_size % 6 IN (0, 1, 3, 5) AS direct, p_size % 2 = 0 AS blob FROM part")
def url_direct_download(spark, sf):
    blob = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("BLOB:"), F.col("p_name"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(
        "p_partkey", urls.is_direct_download(_file_url()).alias("direct"), urls.is_direct_download(blob).alias("blob")
    )


@query("url_crawlable", f"""WITH {LINKS}, x AS (SELECT page_id, i, CASE WHEN i % 4 = 0 THEN 'mailto:a@b' WHEN i % 4 = 1 THEN 'https://other.example.org/z' ELSE href END AS href, url FROM links)
SELECT page_id, i AS link_seq, i % 4 >= 2 AS crawlable FROM x""")
def url_crawlable(spark, sf):
    li = extract_links(table(spark, sf, "pages"))
    i = F.col("link_seq") % 4
    href = F.when(i == 0, "mailto:a@b").when(i == 1, "https://other.example.org/z").otherwise(F.col("href"))
    return li.select(
        "page_id", F.col("link_seq").cast("bigint").alias("link_seq"), urls.is_crawlable(href, urls.host_key("page_url")).alias("crawlable")
    )


@query("url_changed", "SELECT page_id, rtrim(split_part(url, '#', 1), '/') <> rtrim(url, '/') AS changed FROM pages")
def url_changed(spark, sf):
    return _pages(spark, sf).select("page_id", urls.url_changed(urls.drop_fragment("url"), "url").alias("changed"))


@query("page_state_sig", f"""WITH {PARTS}, {LINKS}, h AS (SELECT page_id, array_to_string(list_sort(list(href)), '|') AS hrefs,
  array_to_string(list_sort(list('a>' || left(text, 90))), '|') AS keys FROM links GROUP BY 1)
SELECT page_id, left(sha1({NORM_LINK} || '|' || hrefs || '||' || keys), 10) AS sig FROM parts JOIN h USING (page_id)""")
def page_state_sig(spark, sf):
    li = extract_links(table(spark, sf, "pages"))
    per = li.groupBy("page_id", "page_url").agg(
        F.collect_list("href").alias("hrefs"), F.collect_list(F.concat(F.lit("a>"), F.col("text"))).alias("keys")
    )
    return per.select("page_id", labels.page_state_sig("page_url", "hrefs", "keys").alias("sig"))


@query("shell_state_sig", f"""WITH {LINKS}, l AS (SELECT page_id, url, list_sort(list_distinct(list(left(text, 30)) FILTER (WHERE i % 2 = 0))) AS t FROM links GROUP BY 1, 2)
SELECT page_id, split_part(url, '#', 1) || '||' || left(array_to_string(t, '|'), 2000) || '||view=' || left(array_to_string(list_sort(['x', 'home']), '|'), 300) AS sig FROM l""")
def shell_state_sig(spark, sf):
    li = extract_links(table(spark, sf, "pages"))
    per = li.groupBy("page_id", "page_url").agg(
        F.collect_list(F.struct("text", (F.col("link_seq") % 2 == 0).alias("nav"), F.lit(False).alias("bulk"))).alias("controls")
    )
    return per.select(
        "page_id", labels.shell_state_sig(F.col("page_url"), "controls", F.array(F.lit("x"), F.lit("home"), F.lit("x"))).alias("sig")
    )


# --- labels ----------------------------------------------------------------------------

LABEL = "((CASE p_size % 8 WHEN 0 THEN 'Create ' WHEN 1 THEN 'Delete ' WHEN 2 THEN 'Export ' WHEN 3 THEN 'Sign out ' WHEN 4 THEN 'Archive ' WHEN 5 THEN 'Start ' WHEN 6 THEN 'Created ' ELSE '' END) || p_name)"


def part_label():
    n = F.col("p_size") % 8
    verb = (
        F.when(n == 0, "Create ").when(n == 1, "Delete ").when(n == 2, "Export ").when(n == 3, "Sign out ").when(n == 4, "Archive ")
        .when(n == 5, "Start ").when(n == 6, "Created ").otherwise("")
    )
    return F.concat(verb, F.col("p_name"))


def _rx(pattern: str) -> str:
    return pattern.replace("(?iu)", "(?i)").replace("(?iuU)", "(?i)").replace("'", "''")


@query("label_classes", f"""SELECT p_partkey, regexp_matches({LABEL}, '{_rx(K.DESTRUCTIVE)}') AS destructive, regexp_matches({LABEL}, '{_rx(K.WRITE)}') AS is_write,
  regexp_matches({LABEL}, '{_rx(K.DOWNLOAD_LABEL)}') AS download, regexp_matches({LABEL}, '{_rx(K.SKIP_NAV)}') AS skip_nav,
  regexp_matches({LABEL}, '{_rx(labels.CREATE_PATTERN)}') AS is_create FROM part""")
def label_classes(spark, sf):
    c = labels.classify_label(part_label())
    return table(spark, sf, "part").select("p_partkey", c.alias("c")).select(
        "p_partkey", "c.destructive", F.col("c.write").alias("is_write"), "c.download", "c.skip_nav", F.col("c.trigger").alias("is_create")
    )


_STOP = "[" + ", ".join(f"'{w}'" for w in K.GOAL_STOPWORDS) + "]"


@query("goal_nouns", f"""SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(lower('How do I ' || {LABEL} || ' for my team'), '\\w+'),
  lambda w: NOT list_contains({_STOP}, w) AND length(w) > 2), ' ') AS nouns FROM part""")
def goal_nouns(spark, sf):
    goal = F.concat(F.lit("How do I "), part_label(), F.lit(" for my team"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(labels.goal_nouns(goal), " ").alias("nouns"))


_VERBS = "|".join(K.GOAL_VERBS)


@query("goal_needle", f"""WITH x AS (SELECT p_partkey, {LABEL} AS label, string_split(p_name, ' ') AS w FROM part),
n AS (SELECT p_partkey, label, list_filter(w, lambda a: NOT list_contains({_STOP}, a) AND length(a) > 2) AS nouns FROM x)
SELECT p_partkey, regexp_matches(label, '(?i)(?:{_VERBS})\\b.{{0,30}}\\b(?:' || array_to_string(nouns, '|') || ')(?:es|s)?\\b|\\b(?:' || array_to_string(nouns, '|') || ')(?:es|s)?\\b.{{0,30}}\\b(?:{_VERBS})') AS hit FROM n""")
def goal_needle(spark, sf):
    return table(spark, sf, "part").select("p_partkey", part_label().alias("label"), labels.goal_nouns("p_name").alias("n")).select(
        "p_partkey", F.rlike("label", labels.goal_needle(F.col("n"))).alias("hit")
    )


@query("form_confidence", "SELECT p_partkey, (CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size % 3 END)::BIGINT AS fields, CASE WHEN p_size % 5 = 0 OR (p_size % 4 <> 0 AND p_size % 3 > 0) THEN 'high' ELSE 'low' END AS confidence FROM part")
def form_confidence(spark, sf):
    n = F.col("p_size")
    form = F.when(n % 4 != 0, F.struct(
        F.when(n % 2 == 0, (n % 3).cast("int")).alias("fieldCount"), F.array_repeat(F.lit("f"), (n % 3).cast("int")).alias("fields")))
    p = table(spark, sf, "part").select("p_partkey", form.alias("form"), F.when(n % 5 == 0, "Download").otherwise("form").alias("kind"))
    return p.select(
        "p_partkey", labels.form_field_count("form").cast("bigint").alias("fields"), labels.form_confidence("kind", "form").alias("confidence")
    )


@query("item_text", "SELECT p_partkey, trim(p_name || ' ' || p_brand || ' ' || p_type) AS txt, p_name AS no_cells FROM part")
def item_text(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", labels.item_text("p_name", F.array("p_brand", "p_type")).alias("txt"),
        labels.item_text("p_name", F.lit(None).cast("array<string>")).alias("no_cells"),
    )


@query("label_of", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_name ELSE 'n' || p_partkey END AS label FROM part")
def label_of(spark, sf):
    n = F.col("p_size") % 3
    return table(spark, sf, "part").select(
        "p_partkey",
        labels.label_of(F.when(n == 0, F.col("p_brand")).otherwise(""), F.when(n <= 1, F.col("p_name")), F.concat(F.lit("n"), F.col("p_partkey").cast("string"))).alias("label"),
    )


@query("slug_and_filename", f"""WITH s AS (SELECT *, left(regexp_replace(regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name || '!'), '[^a-z0-9]', '-', 'g'), '^-+|-+$', '', 'g'), '-{{2,}}', '-', 'g'), 40) AS slug FROM part)
SELECT p_partkey, slug, CASE p_size % 6 WHEN 0 THEN p_partkey || '.pdf' WHEN 1 THEN p_partkey || '.PARQUET' WHEN 2 THEN p_partkey || '.html' WHEN 3 THEN p_partkey || '.jpeg' WHEN 4 THEN slug || '.csv' ELSE p_partkey || '.zip;v=1' END AS filename,
  slug || '.png' AS by_accept FROM s""")
def slug_and_filename(spark, sf):
    lab = F.concat("p_brand", F.lit(" "), "p_name", F.lit("!"))
    return table(spark, sf, "part").select(
        "p_partkey", labels.slug(lab).alias("slug"), labels.suggest_filename(_file_url(), F.lit(".csv, .txt"), lab).alias("filename"),
        labels.suggest_filename(F.lit(None).cast("string"), F.lit("image/png"), lab).alias("by_accept"),
    )


@query("field_placeholder", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN p_name ELSE '<' || replace(lower(p_brand), '#', ' ') || '>' END AS value,
  p_size % 4 IN (0, 1) AS truthy FROM part""")
def field_placeholder(spark, sf):
    n = F.col("p_size") % 3
    f = F.struct(
        F.when(n == 0, F.array("p_type", "p_name")).alias("options"), F.when(n == 1, F.col("p_name")).alias("value"), F.col("p_brand").alias("label")
    )
    m = F.col("p_size") % 4
    word = F.when(m == 0, F.col("p_name")).when(m == 1, " 1").when(m == 2, " OFF ").otherwise("")
    return table(spark, sf, "part").select("p_partkey", f.alias("f"), word.alias("word")).select(
        "p_partkey", labels.field_placeholder("f").alias("value"), labels.is_truthy("word").alias("truthy")
    )


_SSTOP = "[" + ", ".join(f"'{w}'" for w in K.SUGGEST_STOPWORDS) + "]"


@query("stem_tokens", f"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w)), lambda w: length(w) > 2 AND NOT list_contains({_SSTOP}, w)) AS w FROM documents)
SELECT doc_id, len(list_distinct(list_transform(w, lambda x: CASE WHEN length(x) > 3 AND ends_with(x, 's') THEN x[:-2] ELSE x END)))::BIGINT AS n,
  md5(array_to_string(list_sort(list_distinct(list_transform(w, lambda x: CASE WHEN length(x) > 3 AND ends_with(x, 's') THEN x[:-2] ELSE x END))), ' ')) AS digest FROM t""")
def stem_tokens(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", labels.stem_tokens("text").alias("s"))
    return t.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort("s"), " ").cast("binary")).alias("digest"))


@query("id_num", "SELECT c_custkey, coalesce(nullif(regexp_extract(c_name, '([0-9]+)$', 1), ''), '0')::BIGINT AS num, 0::BIGINT AS none FROM customer")
def id_num(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", labels.id_num("c_name").alias("num"), labels.id_num("c_mktsegment").cast("bigint").alias("none"))


@query("valid_names", "SELECT s_suppkey, regexp_matches(s_name, '^[A-Za-z0-9._-]+$') AS host_ok, true AS scope_ok, false AS dots_ok FROM supplier")
def valid_names(spark, sf):
    return table(spark, sf, "supplier").select(
        "s_suppkey", labels.valid_host("s_name").alias("host_ok"), labels.valid_scope(F.concat(F.lit(" s"), F.col("s_suppkey").cast("string"))).alias("scope_ok"),
        labels.valid_host(F.repeat(F.lit("."), F.lit(2))).alias("dots_ok"),
    )


@query("titles_and_cuts", """SELECT conv_id, turn, left(trim(regexp_replace(text, '[\\s]+', ' ', 'g')), 60) AS title,
  CASE WHEN length(text) > 100 THEN left(text, 100) || '…[truncated]' ELSE text END AS cut FROM conversations""")
def titles_and_cuts(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", labels.derive_title("text").alias("title"), labels.truncate("text", 100).alias("cut")
    )


@query("mint_node_ids", f"""WITH {PARTS}, {LINKS} SELECT page_id, i AS link_seq, {NORM_LINK} || '##download:' || left(sha1(href || text), 6) AS node_id FROM parts JOIN (SELECT page_id, i, href, text FROM links) USING (page_id)""")
def mint_node_ids(spark, sf):
    li = extract_links(table(spark, sf, "pages"))
    return li.select(
        "page_id", F.col("link_seq").cast("bigint").alias("link_seq"),
        labels.mint_node_id(urls.normalize_url("page_url"), "download", "href", "text").alias("node_id"),
    )


@query("frontier_tiers", "SELECT p_partkey, (CASE p_size % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END)::BIGINT AS tier, (CASE p_size % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END)::BIGINT AS shell_tier FROM part")
def frontier_tiers(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("link", "tab", "row", "menu", "external", "iframe")]), (F.col("p_size") % 6 + 1).cast("int"))
    p = table(spark, sf, "part").select("p_partkey", kind.alias("kind"))
    return p.select("p_partkey", labels.tier("kind").cast("bigint").alias("tier"), labels.tier("kind", True).cast("bigint").alias("shell_tier"))
