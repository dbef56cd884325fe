import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from clickatlas.operators import graph as G
from clickatlas.operators.rows import neighbour, ordinal, prefix_sum, top_n

E = "host string, src string, dst string, edge_seq long"


def random_graphs(n, seed):
    rnd = random.Random(seed)
    out = {}
    for g in range(n):
        k = rnd.randint(2, 7)
        out[f"g{g}"] = [(f"n{rnd.randrange(k)}", f"n{rnd.randrange(k)}") for _ in range(rnd.randint(1, 16))]
    return out


def frame(spark, graphs):
    rows = [(h, a, b, i) for h, es in graphs.items() for i, (a, b) in enumerate(es)]
    return spark.createDataFrame(rows, E)


def walk(edges, start):
    adj = {}
    for i, (a, b) in enumerate(edges):
        adj.setdefault(a, []).append((b, i))
    path, q = {start: []}, deque([start])
    while q:
        u = q.popleft()
        for v, i in adj.get(u, []):
            if v not in path:
                path[v] = path[u] + [i]
                q.append(v)
    return path


@pytest.mark.parametrize("hot, bucket", [(1_000_000, 1_000_000), (1, 1_000_000), (1, 100), (1_000_000, 100)])
def test_bfs_is_first_in_first_out(spark, hot, bucket):
    graphs = random_graphs(60, 7)
    e = frame(spark, graphs)
    roots = e.select("host", F.lit("n0").alias("root")).distinct()
    got = {(r["host"], r["node"]): r["path"] for r in G.bfs(e, roots, hot_degree=hot, bucket_rows=bucket).collect()}
    want = {(h, n): p for h, es in graphs.items() for n, p in walk(es, "n0").items()}
    assert got == want


@pytest.mark.parametrize("many", [False, True])
def test_paths_of_shown_rows_from_distances(spark, monkeypatch, many):
    """A search that keeps no paths carries narrow rows; the smallest paths are found for the rows that are shown."""
    graphs = random_graphs(60, 11)
    # two ways of a length, parallel edges, and nodes that nothing leads to
    graphs["ways"] = [("n0", "b"), ("n0", "a"), ("a", "t"), ("b", "t"), ("b", "t"), ("t", "n0"), ("x", "t")]
    e = frame(spark, graphs)
    roots = e.select("host", F.lit("n0").alias("root")).distinct()
    if many:
        monkeypatch.setattr(G, "FEW_ROWS", 0)
        monkeypatch.setattr("clickatlas.session.FEW_ROWS", 0)
    nodes = e.select("host", F.lit("n0").alias("root"), F.explode(F.array("src", "dst")).alias("node"))
    reached = G.search(G.lay_out(e, parallel=True), roots, targets=nodes, paths=False)
    assert reached.rows.columns == ["host", "root", "node", "depth"]
    want = {(h, n): p for h, es in graphs.items() for n, p in walk(es, "n0").items()}
    assert {(r["host"], r["node"]): r["depth"] for r in reached.rows.collect()} == {k: len(p) for k, p in want.items()}
    shown = nodes.unionByName(roots.withColumn("node", F.col("root"))).distinct()
    assert {(r["host"], r["node"]): r["path"] for r in G.shown_paths(e, reached, shown).collect()} == want
    one = shown.where("host = 'ways' AND node IN ('t', 'x')")
    assert [tuple(r) for r in G.shown_paths(e, reached, one).collect()] == [("ways", "n0", "t", [0, 3])]


@pytest.mark.parametrize("segment, bucket, two", [(1, 1_000_000, 0), (2, 1_000_000, 1_000_000), (3, 10, 1_000_000), (3, 10, 0)])
def test_paths_of_several_segments(spark, monkeypatch, segment, bucket, two):
    """Anchors in the order of their paths decide as whole paths would, also where several equal ways lead on."""
    monkeypatch.setattr(G, "TWO_STEPS", two)
    rnd = random.Random(segment)
    graphs = random_graphs(20, segment)
    # layers of three nodes, joined at random: many shortest paths of the same length
    for g in range(6):
        es = [(f"l{i}x{a}" if i else "n0", f"l{i + 1}x{b}") for i in range(9) for a in range(3 if i else 1) for b in range(3) if rnd.random() < 0.8]
        rnd.shuffle(es)
        graphs[f"layers{g}"] = es + [(f"l9x{a}", f"t{i}") for i in range(10, 12) for a in range(3)]
    e = frame(spark, graphs)
    roots = spark.createDataFrame([(h, "n0") for h in graphs], "host string, root string")
    got = {(r["host"], r["node"]): r["path"] for r in G.bfs(e, roots, segment=segment, bucket_rows=bucket).collect()}
    assert got == {(h, n): p for h, es in graphs.items() for n, p in walk(es, "n0").items()}


def test_visited_set_is_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shape = spark.createDataFrame([], "host string, root string, node string, depth int, path array<bigint>").schema
        levels = G._Levels(spark, shape, True)
        for d in range(2):
            levels.add(spark.createDataFrame([("g0", "n0", f"n{d}", d, [])], shape), d)
        new = G.expand_frontier(levels.last(1).drop("depth"), frame(spark, random_graphs(40, 2)), levels.read().select("host", "root", "node"))
        plan = new._jdf.queryExecution().executedPlan().toString()
        seen = plan[plan.index("LeftAnti"):]
        assert "Bucketed: true" in seen and "hashpartitioning(host" not in seen[seen.index("Bucketed: true") - 600:seen.index("Bucketed: true")]
        assert new.count() >= 0
        levels.close()
        assert levels.read().count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_edges_are_not_shuffled(spark, tmp_path):
    from clickatlas.session import bucketed

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = bucketed(frame(spark, random_graphs(40, 2)), ["host", "src"], 4, str(tmp_path / "e"))
        f = spark.createDataFrame([("g0", "n0", "n0", []), ("g1", "n0", "n1", [])], "host string, root string, node string, path array<bigint>")
        plan = G.expand_frontier(f, e, None)._jdf.queryExecution().executedPlan().toString()
        side = plan[:plan.index("FileScan")].rsplit("SortMergeJoin", 1)[1]
        src = [x for x in plan.splitlines() if "hashpartitioning" in x]
        # one exchange for the frontier, one for the aggregate; none for the edges
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan and len(src) == 2, (src, side)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bfs_stops_at_targets(spark):
    graphs = {"a": [(f"n{i}", f"n{i + 1}") for i in range(12)]}
    e = frame(spark, graphs)
    t = spark.createDataFrame([("a", "n0", "n3")], "host string, root string, node string")
    got = G.bfs(e, t.select("host", "root"), targets=t)
    assert got.agg(F.max("depth")).first()[0] == 3


def test_all_simple_paths(spark):
    graphs = random_graphs(40, 3)
    e = frame(spark, graphs)
    pairs = e.select("host", F.lit("n0").alias("src"), F.lit("n1").alias("dst")).distinct()
    got = {}
    for r in G.all_simple_paths(e, pairs, max_len=4, max_paths=5).collect():
        got.setdefault(r["host"], []).append((r["walk_rank"], r["nodes"]))
    for h, es in graphs.items():
        adj = {}
        for a, b in es:
            adj.setdefault(a, []).append(b)
        out, stack = [], [["n0"]]
        while stack and len(out) < 5:
            p = stack.pop()
            if p[-1] == "n1":
                out.append(p)
                continue
            if len(p) - 1 < 4:
                stack += [p + [b] for b in adj.get(p[-1], []) if b not in p]
        assert [p for _, p in sorted(got.get(h, []))] == out, h


def first_walks(es, src, dst, max_len, k):
    adj = {}
    for i, (a, b) in enumerate(es):
        adj.setdefault(a, []).append((b, i))
    out, stack = [], [([src], [])]
    while stack and len(out) < k:
        nodes, path = stack.pop()
        if nodes[-1] == dst:
            out.append(path)
        elif len(path) < max_len:
            stack += [(nodes + [b], path + [i]) for b, i in adj.get(nodes[-1], []) if b not in nodes]
    return out


@pytest.mark.parametrize("room", [3, 5, 200])
def test_first_walks_with_little_room(spark, room):
    """Dead ends use the room up; later passes with more of it find the same walks."""
    graphs = random_graphs(25, 11)
    # every walk that goes on to m comes to nothing: the goal can only be reached through a
    graphs["dead"] = [("n0", "a"), ("a", "n1"), ("a", "b")] + [("n0", f"x{i}") for i in range(12)] + [(f"x{i}", "m") for i in range(12)] + [("m", "a"), ("a", "m")]
    graphs["loop"] = [("n0", "a"), ("a", "n1")] + [(f"y{i}", "n0") for i in range(9)] + [("n0", f"y{i}") for i in range(9)]
    e = frame(spark, graphs)
    pairs = spark.createDataFrame([(h, "n0", "n1") for h in graphs], "host string, src string, dst string")
    got = {}
    for r in G.all_simple_paths(e, pairs, max_len=4, max_paths=3, room=room).collect():
        got.setdefault(r["host"], []).append((r["walk_rank"], r["path"]))
    assert {h: [p for _, p in sorted(v)] for h, v in got.items()} == {h: w for h, es in graphs.items() if (w := first_walks(es, "n0", "n1", 4, 3))}


def test_millions_of_walks_in_few_rows(spark, monkeypatch):
    """Five layers of twenty nodes: 3,200,000 walks, of which 50 are asked for."""
    layer = lambda i: [f"l{i}x{a}" for a in range(20)]
    es = [("n0", b) for b in layer(1)] + [(a, b) for i in range(1, 5) for a in layer(i) for b in layer(i + 1)] + [(a, "n1") for a in layer(5)]
    rows, counted = [], G.cut_counted

    def count(df, path, **sums):
        out, seen = counted(df, path, **sums)
        rows.append(seen["rows"])
        return out, seen

    monkeypatch.setattr(G, "cut_counted", count)
    pairs = spark.createDataFrame([("h", "n0", "n1")], "host string, src string, dst string")
    got = G.all_simple_paths(frame(spark, {"h": es}), pairs, max_len=6).orderBy("walk_rank").collect()
    assert [r["path"] for r in got] == first_walks(es, "n0", "n1", 6, 50) and max(rows) <= len(es)


def test_hub_edges_and_degrees(spark):
    es = [("home", "docs"), ("docs", "guide"), ("home", "guide")] + [(x, "dashboard") for x in "home docs guide reports billing help faq import".split()]
    e = frame(spark, {"s": es + [("faq", "faq")]})
    pages = spark.createDataFrame([("s", 9)], "host string, pages int")
    assert {r["dst"] for r in G.hub_edges(e, pages).where("glob").collect()} == {"dashboard"}
    d = {r["id"]: (r["in_degree"], r["out_degree"], r["degree"]) for r in G.degrees(e).collect()}
    assert d["faq"] == (1, 2, 3) and d["dashboard"] == (8, 0, 8)
    pairs = spark.createDataFrame([("s", "home", "dashboard"), ("s", "home", "guide"), ("s", "home", "home")], "host string, src string, dst string")
    full = {r["dst"]: r["clicks"] for r in G.shortest_link_path(e, pairs).collect()}
    assert full == {"dashboard": 1, "guide": 1, "home": 0}
    kept = {r["dst"]: r["clicks"] for r in G.shortest_link_path(G.structural(e, pages), pairs).collect()}
    assert kept == {"guide": 1, "home": 0}


def test_start_state_rules(spark):
    st = spark.createDataFrame(
        [("h", 0, "s9", "https://h.test/deep", 2), ("h", 1, "s0", "https://h.test/", 0), ("h", 2, "s1", "https://h.test/a?x=1", 1), ("k", 0, "t0", "https://k.test/z", 3)],
        "host string, state_seq long, id string, url string, depth int",
    )
    asks = spark.createDataFrame([("h", None), ("h", "https://h.test/a/?y=2"), ("h", "https://h.test/a?x=1#f"), ("h", "https://o.test/none"), ("k", "")], "host string, start string")
    for rule, other in (("root", "s0"), ("first", "s9"), ("none", None)):
        got = {(r["host"], r["start"]): r["state_id"] for r in G.start_state(st, asks, rule).collect()}
        assert got[("h", None)] == "s0" and got[("h", "https://h.test/a/?y=2")] == "s1" and got[("k", "")] == "t0"
        assert got[("h", "https://o.test/none")] == other
    assert {r["host"]: r["state_id"] for r in G.start_state(st).collect()} == {"h": "s0", "k": "t0"}


def test_chunked_windows(spark):
    rnd = random.Random(1)
    data = [(g, s, rnd.randint(0, 3)) for g in "ab" for s in sorted(rnd.sample(range(200), 60))]
    df = spark.createDataFrame(data, "g string, s long, v int")
    run = {(r["g"], r["s"]): r["t"] for r in prefix_sum(df, ["g"], "s", F.col("v"), "t", chunk=7).collect()}
    prev = {(r["g"], r["s"]): r["p"] for r in neighbour(df, ["g"], "s", F.col("v"), "p", chunk=7).collect()}
    nxt = {(r["g"], r["s"]): r["p"] for r in neighbour(df, ["g"], "s", F.col("v"), "p", after=True, chunk=7).collect()}
    num = {(r["g"], r["s"]): r["n"] for r in ordinal(df, ["g"], ["s"], "n").collect()}
    for g in "ab":
        mine = [(s, v) for x, s, v in data if x == g]
        for i, (s, v) in enumerate(mine):
            assert run[g, s] == sum(x for _, x in mine[: i + 1])
            assert prev[g, s] == (mine[i - 1][1] if i else None)
            assert nxt[g, s] == (mine[i + 1][1] if i + 1 < len(mine) else None)
            assert num[g, s] == i + 1


def test_top_n_above_the_pruned_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    got = top_n(df, ["g"], [F.col("id").desc()], 1200)
    assert got.count() == 2400 and got.agg(F.min("id")).first()[0] == 5000 - 2400


@pytest.mark.parametrize("segment, few, bucket", [(2, 0, 10), (3, 1_000_000, 1_000_000)])
def test_searches_that_meet(spark, monkeypatch, segment, few, bucket):
    """Clicks and paths of pairs are those of a plain walk, whichever side advances and however long the way."""
    monkeypatch.setattr(G, "FEW_NODES", few)
    monkeypatch.setattr(G, "BUCKET_ROWS", bucket)
    rnd = random.Random(segment)
    graphs = random_graphs(20, segment)
    for g in range(4):
        es = [(f"l{i}x{a}" if i else "n0", f"l{i + 1}x{b}") for i in range(5) for a in range(3 if i else 1) for b in range(3) if rnd.random() < 0.8]
        rnd.shuffle(es)
        graphs[f"layers{g}"] = es + [(f"l5x{a}", f"t{i}") for i in range(2) for a in range(3)]
    rows = {(h, "n0", x) for h, es in graphs.items() for x in ("n0", "n1", "n3", "t0", "t1", "nowhere")} | {(h, "n2", "n1") for h in graphs}
    pairs = spark.createDataFrame([*rows, ("g0", "n0", "n1"), ("g0", None, "n1"), ("g0", "n0", None)], "host string, src string, dst string")
    got = sorted((r["host"], r["src"], r["dst"], r["clicks"], r["path"]) for r in G.shortest_link_path(frame(spark, graphs), pairs, segment=segment).collect())
    want = []
    for h, a, b in [*rows, ("g0", "n0", "n1")]:
        p = walk(graphs[h], a).get(b)
        want += [] if p is None else [(h, a, b, len(p), p)]
    assert got == sorted(want)
    near = {(r["src"], r["dst"]) for r in G.shortest_link_path(frame(spark, {"g": [("a", "b"), ("b", "c"), ("c", "d")]}), spark.createDataFrame([("g", "a", x) for x in "abcd"], "host string, src string, dst string"), max_depth=2).collect()}
    assert near == {("a", "a"), ("a", "b"), ("a", "c")}


def test_pairs_do_not_search_the_whole_graph(spark, monkeypatch):
    """A target with one way in is found from there; one without is given up at once."""
    written, add = [], G._Levels.add
    monkeypatch.setattr(G._Levels, "add", lambda self, *a, **k: written.append(add(self, *a, **k)) or written[-1])
    # a tree that doubles at each level, and a way of five clicks beside it
    tree = [(f"t{i}" if i > 1 else "root", f"t{j}") for i in range(1, 1024) for j in (2 * i, 2 * i + 1)]
    way = [("root", "w1"), *[(f"w{i}", f"w{i + 1}") for i in range(1, 5)]]
    pairs = spark.createDataFrame([("g", "root", "w5"), ("g", "root", "alone")], "host string, src string, dst string")
    got = G.shortest_link_path(frame(spark, {"g": tree + way}), pairs).collect()
    assert [(r["dst"], r["clicks"], r["path"]) for r in got] == [("w5", 5, [len(tree) + i for i in range(5)])]
    assert sum(w["rows"] for w in written) < 30
