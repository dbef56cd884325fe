"""Site graphs derived from the relational test tables.

Orders and their lines become click graphs, one per customer nation:

* a root page per nation, a page per customer, and a page per part and supplier
  that the nation's order lines mention;
* root -> customer (tab) and back (link); each order line is one edge, by its line number:
  customer -> part (link), part -> supplier (menu), supplier -> part (row);
* each part page of a nation has one trigger, each supplier page lists its parts.

Every line, order, customer and part takes part; nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import schema as X
from ..operators.rows import top_n
from ..session import at_once, cut
from ..sources.graphs import Graphs

HOST = "concat('shop', cast({n} as string), '.example.com')"
GOALS = ("create red gear", "download small plates", "new bolt", "sign in", "show the cold rod", "export")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def host_of(n: str):
    return F.expr(HOST.format(n=n))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """(host, c, p, s, ln) of every order line."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return li.join(o, "l_orderkey").join(c, "o_custkey").select(
        host_of("c_nationkey").alias("host"), F.col("o_custkey").alias("c"), F.col("l_partkey").alias("p"),
        F.col("l_suppkey").alias("s"), (F.col("l_linenumber") % 3).alias("r"),
    )


def page_url(kind: str, key) -> "F.Column":
    return F.concat(F.lit("https://"), F.col("host"), F.lit(f"/{kind}/"), key.cast("string"))


def _seq(src, dst, kind):
    # unique per host: source and target keys and the edge kind
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return ((src.cast("bigint") * F.lit(2147483648) + dst.cast("bigint")) * 4 + kind).cast("bigint")


def graphs(spark: SparkSession, sf: str, with_items: bool = True, ln: DataFrame | None = None, keep: Callable = lambda *dfs: dfs) -> Graphs:
    """The tables; ``keep`` may write the keys and names they are built from, so what reads the tables only puts texts together."""
    ln = lines(spark, sf) if ln is None else ln
    cust = table(spark, sf, "customer").select(host_of("c_nationkey").alias("host"), F.col("c_custkey").alias("c"), "c_name")
    cp = lambda a, k: F.concat(F.lit(a + ":"), k.cast("string"))
    c, p, s, r = F.col("c"), F.col("p"), F.col("s"), F.col("r")
    # an edge is its class and its two keys
    way = F.when(r == 1, 1).when(r == 2, 2).otherwise(3)
    ends = ln.select("host", way.alias("way"), F.when(r == 1, c).when(r == 2, p).otherwise(s).alias("a"), F.when(r == 2, s).otherwise(p).alias("b")).distinct()
    hs = ln.select("host", s.alias("k")).distinct()
    if with_items:
        hs = hs.join(collection_arrays(view_items(spark, sf, ln)), ["host", "k"], "left")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_size", "p_type", F.lit(True).alias("known"))
    hp = ln.select("host", p.alias("k")).distinct().join(part, "k", "left")
    ends, hp, hs = keep(ends, hp, hs)
    way, a, b = F.col("way"), F.col("a"), F.col("b")
    src = F.when(way == 1, cp("c", a)).when(way == 2, cp("p", a)).otherwise(cp("s", a))
    dst = F.when(way == 2, cp("s", b)).otherwise(cp("p", b))
    kind = F.when(way == 1, "link").when(way == 2, "menu").otherwise("row")
    ends = ends.select("host", src.alias("src"), dst.alias("dst"), _seq(a, b, way).alias("edge_seq"), kind.alias("kind"))
    roots = cust.select(
        "host", F.lit("root").alias("src"), cp("c", c).alias("dst"), _seq(F.lit(0), c, 0).alias("edge_seq"), F.lit("tab").alias("kind")
    )
    home = cust.select(
        "host", cp("c", c).alias("src"), F.lit("root").alias("dst"), _seq(c, F.lit(2147483647), 0).alias("edge_seq"), F.lit("link").alias("kind")
    )
    edges = roots.unionByName(home).unionByName(ends).select(
        "host", "edge_seq", "src", "dst", F.concat(F.lit("Open "), F.col("dst")).alias("label"),
        F.concat(F.lit("#"), F.translate("dst", ":", "-")).alias("selector"), "kind",
    )
    none = lambda t: F.lit(None).cast(t)
    coll_type = X.ArrayType(X.COLLECTION)

    def state(df, seq_base, k, tag, url, label, depth, colls):
        return df.select(
            "host", seq_base.cast("bigint").alias("state_seq"), tag.alias("id"), url.alias("url"), label.alias("label"),
            F.lit(depth).alias("depth"), none(X.ArrayType(X.CONTROL)).alias("controls"), colls.cast(coll_type).alias("collections"),
        )

    k = F.col("k")
    root_states = state(
        table(spark, sf, "nation").select(host_of("n_nationkey").alias("host"), "n_name"), F.lit(0), None, F.lit("root"),
        F.concat(F.lit("https://"), F.col("host"), F.lit("/")), F.col("n_name"), 0, none(coll_type),
    )
    cust_states = state(cust, F.lit(1) + c, c, cp("c", c), F.concat(page_url("c", c), F.lit("?ref=x")), F.col("c_name"), 1, none(coll_type))
    part_states = state(
        hp, F.lit(1_000_000_000_000) + k, k, cp("p", k), F.concat(page_url("p", k), F.lit("/")),
        F.coalesce("p_name", F.lit("")), 2, none(coll_type),
    )
    coll_col = F.col("collections") if with_items else none(coll_type)
    sup_states = state(
        hs, F.lit(2_000_000_000_000) + k, k, cp("s", k), F.concat(page_url("s", k), F.lit("?page=2")),
        F.concat(F.lit("Supplier "), k.cast("string")), 3, coll_col,
    )
    states = root_states.unionByName(cust_states).unionByName(part_states).unionByName(sup_states)
    triggers = part_triggers(hp.where("known"))
    meta = table(spark, sf, "nation").select(
        host_of("n_nationkey").alias("host"), F.lit("interaction").alias("graph_kind"),
        F.concat(F.lit("https://"), host_of("n_nationkey"), F.lit("/")).alias("start"), none("int").alias("pages"),
        F.lit(True).alias("complete"), none("string").alias("stopped"), none("timestamp").alias("last_live_update"), F.lit(0).alias("live_hits"),
    )
    errors = spark.createDataFrame([], X.struct(host=X.S, status=X.S, error=X.S))
    return Graphs(states, edges, triggers, meta, errors)


def part_triggers(t: DataFrame) -> DataFrame:
    """One trigger per (host, part), from (host, k, p_name, p_size, p_type): verb by size, a download for every fifth size."""
    none = lambda t: F.lit(None).cast(t)
    n = F.col("p_size")
    verb = F.when(n % 4 == 0, "Create").when(n % 4 == 1, "Add new").when(n % 4 == 2, "Edit").otherwise("Show")
    is_dl = n % 5 == 0
    label = F.concat(F.when(is_dl, "Download").otherwise(verb), F.lit(" "), F.col("p_name"), F.when(n % 7 == 0, "s").otherwise(""))
    field = lambda lab, typ, req, opts: F.struct(
        F.lit(lab).alias("label"), F.lit(typ).alias("type"), F.lit(req).alias("required"), opts.alias("options"), none("string").alias("value"),
        none("string").alias("accept"), F.lit("#" + lab.lower()).alias("selector"), F.lit("").alias("placeholder"),
    )
    all_fields = F.array(
        field("Name", "text", True, none("array<string>")), field("Type", "select", False, F.array(F.col("p_type"), F.lit("OTHER"))),
    )
    form = F.struct(
        F.col("p_name").alias("title"), F.lit(False).alias("isDialog"), F.slice(all_fields, F.lit(1), (n % 3).cast("int")).alias("fields"),
        F.array(F.lit("Save")).alias("submitButtons"), F.lit("#save").alias("submitSelector"), (n % 3).cast("int").alias("fieldCount"),
    )
    key = F.col("k").cast("string")
    return t.select(
        "host", F.col("k").alias("trig_seq"), label.alias("label"), F.concat(F.lit("p:"), key).alias("state_id"),
        F.slice(F.array(F.struct(F.lit("Parts").alias("label"), F.lit("#parts").alias("selector"), none("string").alias("href"))), F.lit(1), (n % 2).cast("int")).alias("path"),
        F.when(~is_dl, form).alias("form"),
        F.when(~is_dl & (n % 3 == 2), F.concat(F.lit("https://"), F.col("host"), F.lit("/p/"), key, F.lit("/new"))).alias("opens_at"),
        F.when(is_dl, "download").otherwise("form").alias("kind"), F.concat(F.lit("#t-"), key).alias("selector"),
        F.when(is_dl & (n % 2 == 0), F.concat(F.lit("https://"), F.col("host"), F.lit("/files/"), key, F.lit(".pdf"))).alias("href"),
        none("string").alias("accept"), none("timestamp").alias("cached_at"), none("string").alias("cache_source"), F.lit(False).alias("stale"),
    )


def view_items(spark: SparkSession, sf: str, ln: DataFrame) -> DataFrame:
    """(host, k, coll_idx, kind, pk, t, cells, level): the parts a supplier page lists."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("p"), "p_name", "p_brand", "p_size")
    hps = ln.select("host", F.col("s").alias("k"), "p").distinct().join(part, "p")
    return hps.select(
        "host", "k", (F.col("p_size") % 2).cast("int").alias("coll_idx"),
        F.when(F.col("p_size") % 2 == 0, "aria:table").otherwise("aria:list").alias("kind"), F.col("p").alias("pk"), F.col("p_name").alias("t"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_brand"), F.col("p").cast("string"))).otherwise(F.expr("cast(array() as array<string>)")).alias("cells"),
        F.lit(None).cast("int").alias("level"),
    )


def collection_arrays(items: DataFrame) -> DataFrame:
    """Stored collections hold the first 500 items and count them all."""
    counts = items.groupBy("host", "k", "coll_idx", "kind").agg(F.count("*").cast("int").alias("count"))
    shown = top_n(items, ["host", "k", "coll_idx"], ["pk"], K.ITEMS_PER_COLLECTION, rank="ix")
    listed = shown.groupBy("host", "k", "coll_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ix", "t", "cells", "level"))), lambda x: F.struct(x["t"].alias("t"), x["cells"].alias("cells"), x["level"].alias("level"))).alias("items")
    )
    both = listed.join(counts, ["host", "k", "coll_idx"])
    return both.groupBy("host", "k").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("coll_idx", "kind", "count", "items"))), lambda x: F.struct(x["kind"].alias("kind"), x["count"].alias("count"), x["items"].alias("items"))).alias("collections")
    )


def stored_graphs(spark: SparkSession, sf: str, with_items: bool = False) -> Graphs:
    """The same graphs over written keys and names, so a query's searches read those and not the joins."""
    return graphs(spark, sf, with_items, stored_lines(spark, sf), lambda *dfs: at_once(*[partial(cut, df, codec="zstd") for df in dfs]))


def stored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines, joined and written once for all that is made of them."""
    return cut(lines(spark, sf), codec="zstd")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation asks each goal, from its root, from a customer page and from an unknown page."""
    n = table(spark, sf, "nation").select("n_nationkey", host_of("n_nationkey").alias("host"))
    firsts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").alias("c"))
    goal = F.array(*[F.lit(g) for g in GOALS])
    q = n.join(firsts, "n_nationkey").select("n_nationkey", "host", "c", F.posexplode(goal).alias("g", "goal"))
    start = F.when(F.col("g") % 3 == 1, F.concat(page_url("c", F.col("c")), F.lit("?ref=x"))).when(
        F.col("g") % 3 == 2, F.lit("https://nowhere.example.org/none")
    )
    return q.select(
        (F.col("n_nationkey").cast("bigint") * 100 + F.col("g")).alias("q_id"), "host", "goal", F.lit(None).cast("string").alias("match"), start.alias("start")
    )


def link_graph(spark: SparkSession, sf: str, ln: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, pages) of the same graphs as link graphs; hubs are the suppliers."""
    return links(graphs(spark, sf, with_items=False, ln=ln))


def links(g: Graphs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, pages) of graphs as link graphs."""
    nodes = g.states.select(
        "host", F.col("state_seq").alias("node_seq"), "id", F.when(~F.col("id").startswith("s:"), F.col("url")).otherwise("").alias("url"),
        F.col("label").alias("title"), F.lit("page").alias("type"),
    )
    edges = g.edges.select("host", "edge_seq", "src", "dst", "label", F.col("kind"), F.lit(False).alias("skipped"))
    pages = nodes.groupBy("host").agg(F.count("*").alias("pages"))
    return nodes, edges, pages


# --- html ---------------------------------------------------------------------------

def shop_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One served page per part, built from its own row only.

    What a page holds follows from the part's size: see the pieces below.
    """
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    # a page costs far more to render and parse than its five columns to move, and the
    # table is a single small file: spread the rows before the text is built
    p = p.repartition(2 * spark.sparkContext.defaultParallelism)
    n = F.col("p_size")
    key = F.col("p_partkey").cast("string")
    L = F.lit

    def many(count, piece):
        return F.when(count > 0, F.array_join(F.transform(F.sequence(L(1), F.greatest(count, L(1))), piece), "")).otherwise("")

    i = lambda x: x.cast("string")
    nav = F.concat(
        L('<nav><ul><li><a href="/parts/'), key, L('?utm_source=nav">All parts</a><li><a href="/b/'), F.regexp_replace("p_brand", "#", ""),
        L('.pdf" download>Brand sheet</a></ul></nav>'),
    )
    buttons = F.concat(
        L('<button id="radix-:r1:">Create '), F.col("p_name"), L('</button><button id="del'), key, L('">Delete</button>'),
        F.when(n % 2 == 0, L("<button disabled>Frozen</button>")).otherwise(""),
        L('<div role="tablist">'), many(n % 4, lambda x: F.concat(L('<button role="tab">Tab '), i(x), L("</button>"))), L("</div>"),
        F.when(n % 6 == 0, L('<button id="exp">Export data</button>')).otherwise(""),
    )
    tbl = F.concat(
        L("<table>"),
        many(n % 5, lambda x: F.concat(L("<tr><td>"), F.col("p_name"), L(" "), i(x), L("</td><td>"), i(x * n), L("</td><td><button>Row</button></td></tr>"))),
        L("</table>"),
    )
    form = F.when(
        n % 3 != 0,
        F.concat(
            L('<form><h2>Order '), F.col("p_name"), L('</h2><label for="qty">Quantity *</label><input id="qty" name="qty">'),
            F.when(n % 7 == 0, L('<label>Password <input type="password" name="pw"></label>')).otherwise(""),
            F.when(n % 3 == 2, F.concat(L('<select id="kind" aria-label="Kind"><option>'), F.col("p_type"), L("<option>OTHER</select>"))).otherwise(""),
            L('<input type="hidden" name="h"><input type="file" id="doc" accept=".pdf" aria-label="Document"><button type="submit">Save order</button><button>Search</button></form>'),
        ),
    ).otherwise("")
    cards = F.concat(
        L('<div class="cards">'), many(n % 9, lambda x: F.concat(L("<div>Card "), i(x), L(" of "), F.col("p_name"), L("</div>"))), L("</div>")
    )
    paging = F.when(n % 4 == 0, F.concat(L('<a rel="next" href="?page='), i(n), L('">More</a>'))).when(
        n % 4 == 1, L('<ul class="pagination"><li class="disabled"><a id="nx" href="#">Next</a></li><li><a href="#e">End</a></li></ul>')
    ).when(n % 4 == 2, L('<button id="nb" aria-label="Go to next page">&gt;&gt;</button>')).otherwise("")
    frame = F.when(n % 5 == 0, F.concat(L('<iframe src="https://embed.example.org/'), key, L('"></iframe><iframe src="about:blank"></iframe>'))).otherwise("")
    drop = F.when(n % 8 == 0, L('<label id="up">Attach<input type="file" hidden accept="image/*"></label>')).otherwise("")
    html = F.concat(
        L("<!DOCTYPE html><html><head><title>Part "), key, L("</title></head><body>"), nav, buttons, tbl, form, cards, paging, drop, frame, L("</body></html>")
    )
    return p.select(
        F.col("p_partkey").alias("page_id"), F.concat(L("https://parts.example.com/p/"), key).alias("url"), html.alias("html")
    )
