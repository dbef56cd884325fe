"""What a job holds at a time, whatever the size of its input."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickatlas.catalog import QUERIES
from clickatlas.catalog import derive as D
from clickatlas.operators import dom as DOM
from clickatlas.operators import extract as X
from clickatlas.plans import audit as U
from clickatlas.sources import graphs as S

PAGE = "<ul><li>a</li><li>b</li></ul><div>" + "<div>c</div>" * 6 + "</div><label id=up>Up<input type=file hidden></label><button>Go</button>"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_a_task_holds_a_few_parsed_pages():
    class Pages:
        schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType())])
        select = lambda self, *a: self
        mapInArrow = lambda self, run, out: run

    run = DOM.parse_pages(Pages())
    page = lambda n, html: pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(["u"] * n), pa.array([html] * n)], names=["page_id", "url", "html"])
    sizes = [b.num_rows for b in run(iter([page(1000, PAGE)]))]
    assert sum(sizes) == 1000 and max(sizes) <= DOM.PAGES_AT_ONCE
    assert [b.num_rows for b in run(iter([page(3, "x" * (1 << 20))]))] == [1, 1, 1]
    assert [b.num_rows for b in run(iter([page(2, None)]))] == [2] and not list(run(iter([])))


def test_parsed_pages_are_not_broadcast(spark):
    pages = spark.createDataFrame([(i, f"https://h.test/{i}", PAGE) for i in range(4)], "page_id long, url string, html string")
    dom = DOM.parse_pages(pages)
    found = X.extract_collections(dom)
    assert "BroadcastHashJoin" not in plan(found) and {(r["kind"], r["count"]) for r in found.collect()} == {("aria:list", 2), ("repeated:div", 6)}
    up = X.upload_affordances(dom, X.extract_actions(dom))
    assert "BroadcastHashJoin" not in plan(up) and up.where("upload").count() == 4


def test_rows_of_a_single_file_are_spread(spark, tmp_path):
    spark.createDataFrame([(i, f"n{i}") for i in range(8)], "p_partkey long, p_name string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    links = QUERIES["odd_links"](spark, str(tmp_path))
    assert "RoundRobinPartitioning" in plan(links) and links.count() == 32


def test_equal_questions_of_flows_are_asked_once(spark, monkeypatch):
    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    g = S.graphs_from_documents(rows("host string, document string", (
        "h", '{"states": [{"id": "root", "url": "https://h/"}], "edges": [], "triggers": [{"label": "Create bed", "state": "root", "kind": "form"}]}')))
    flows = rows("flow_id long, host string, doc string", *[(i, "h", '{"steps": [{"op": "do", "goal": "create %s"}]}' % w) for i, w in enumerate(("lamp", "lamp", "beds", "lamp"))])
    asked, ask = [], U.resolve_action
    monkeypatch.setattr(U, "resolve_action", lambda g, q: asked.append(q.count()) or ask(g, q))
    got = {(r["flow_id"], r["status"]) for r in U.goal_warnings(U.flow_steps(flows), g).collect()}
    assert asked == [2] and {x for x in got if x[0] != 2} == {(0, "no_match"), (1, "no_match"), (3, "no_match")}


def test_stored_graphs_are_read_without_joins(spark, tmp_path):
    """Keys and names are written once; the texts of states, edges and triggers are put together by whoever reads them."""
    rows = {
        "nation": ("n_nationkey long, n_name string", (1, "A"), (2, "B")), "customer": ("c_custkey long, c_name string, c_nationkey long", (1, "c1", 1), (2, "c2", 2), (3, "c3", None)),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int", (1, "red gear", "b", "t", 3), (1, "red gear", "b", "t", 5), (2, None, "b", "t", 10)),
        "orders": ("o_orderkey long, o_custkey long", (1, 1), (2, 2), (3, 3)),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int", (1, 1, 1, 1), (1, 1, 1, 1), (1, 2, 1, 2), (2, 1, 2, 3), (2, 9, 2, 1), (2, None, 1, None), (2, 2, None, 2), (3, 1, 1, 1)),
    }
    for name, (schema, *r) in rows.items():
        spark.createDataFrame(r, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    for items in (False, True):
        a, b = D.graphs(spark, str(tmp_path), items), D.stored_graphs(spark, str(tmp_path), items)
        for table in ("states", "edges", "triggers", "meta"):
            x, y = getattr(a, table), getattr(b, table)
            assert sorted(map(str, x.collect())) == sorted(map(str, y.collect())), table
            assert "Exchange" not in plan(y) and "Join" not in plan(y)
    lines = D.lines(spark, str(tmp_path))
    assert b.edges.where("src LIKE 's:%' OR dst LIKE 's:%' OR dst LIKE 'p:%' OR dst IS NULL").count() == lines.select("host", "r", F.when(F.col("r") == 1, F.col("c")).otherwise(F.col("s")).alias("x"), "p").distinct().count()
    assert {(r["host"], r["trig_seq"], r["label"]) for r in b.triggers.collect()} >= {("shop1.example.com", 1, "Show red gear"), ("shop1.example.com", 1, "Download red gear")}
    narrow = {f.split("/")[-1] for f in b.edges.inputFiles()}
    assert narrow and "src" not in spark.read.parquet(*[f for f in b.edges.inputFiles() if "customer.parquet" not in f]).columns
