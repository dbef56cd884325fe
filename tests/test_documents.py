import json

import graphs as fixtures
import pytest

from clickatlas.operators import aggregates as A
from clickatlas.sources import documents as D
from clickatlas.sources import graphs as S

SECTIONS = frozenset({"states", "edges", "triggers", "nodes"})


def texts(docs):
    out = {}
    for r in sorted(docs.collect(), key=lambda r: (r["host"], r["piece"])):
        out[r["host"]] = out.get(r["host"], "") + r["document"] + "\n"
    return out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    return S.read_graphs(spark, fixtures.write(tmp_path_factory.mktemp("g")))


def test_documents_in_pieces(spark, stored, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 64)
    docs = S.to_documents(stored)
    # no host lies in one cell, and what the pieces say is one document
    assert docs.groupBy("host").count().where("count > 3").count() == 3
    assert max(len(r["document"]) for r in docs.collect()) < 3000
    got = {h: json.loads(t) for h, t in texts(docs).items()}
    assert [s["id"] for s in got["clinic.test"]["states"]] == [s["id"] for s in fixtures.CLINIC["states"]]
    assert got["garden.test"]["triggers"] == [] and len(got["press.test"]["edges"]) == 3
    S.write_documents(docs, str(tmp_path))
    assert sorted(f.name for f in tmp_path.glob("*.json")) == ["clinic.test.json", "garden.test.json", "press.test.json"]
    back = S.read_graphs(spark, str(tmp_path))
    assert sorted(map(str, back.triggers.collect())) == sorted(map(str, stored.triggers.collect()))
    assert sorted(map(str, back.meta.collect())) == sorted(map(str, stored.meta.collect()))


def test_torn_and_odd_documents(spark):
    whole = json.dumps(fixtures.CLINIC)
    rows = [("whole", whole), ("torn", whole[:-3]), ("type", '{"states": [{"id": "a", "depth": "x"}]}'), ("none", '{"meta": {}}'), ("null", None),
            ("list", '{"states": {"id": 1}}'), ("gap", '{"states": [1 2]}'), ("empty", '{"states": [], "else": {"a": [{"b": "]}"}]}}')]
    g = S.graphs_from_documents(spark.createDataFrame(rows, "host string, document string"))
    assert {r["host"]: r["error"] for r in g.errors.collect()} == {
        "torn": "unreadable document", "type": "unreadable document", "list": "unreadable document", "gap": "unreadable document", "none": "missing states", "null": "missing states"}
    # a document that cannot be read gives no rows at all
    assert {r["host"]: r["states"] for r in A.graph_summary(g).collect()} == {"whole": 6, "empty": 0}
    pieces = spark.createDataFrame([("torn", i, whole[i:i + 40].rstrip("}") if i + 40 >= len(whole) else whole[i:i + 40]) for i in range(0, len(whole), 40)], "host string, piece int, document string")
    pieces = pieces.unionByName(pieces.selectExpr("'cut' AS host", "piece", "document").where("piece < 200"))
    assert S.graphs_from_documents(pieces).states.count() == 0


@pytest.mark.parametrize("step", [1, 7, 10_000])
def test_reader_takes_any_chunks(step):
    doc = {"meta": {"start": "x"}, "state_index": {"k": "v"}, "states": [{"id": "a\"]", "n": 12.5}, None, 7], "edges": [], "other": [1, [2]]}
    text = json.dumps(doc, indent=1) + "\n"
    got = list(D.read_document((text[i:i + step] for i in range(0, len(text), step)), SECTIONS))
    assert [(k, n) for k, n, _ in got] == [("meta", 0), ("states", -1), ("states", 0), ("states", 1), ("states", 2), ("edges", -1)]
    assert [json.loads(t) for k, n, t in got if k == "states" and n >= 0] == doc["states"]
    for cut in range(1, len(text) - 2):
        with pytest.raises(ValueError):
            list(D.read_document([text[:cut]], SECTIONS))


def test_links_of_a_host_without_edges(spark):
    nodes = spark.createDataFrame([("a", 1, "x", "u", "t", "page"), ("b", 1, "y", "u", "t", "page")], "host string, node_seq long, id string, url string, title string, type string")
    edges = spark.createDataFrame([("a", 2, "x", "y", "l", "link", False), ("a", 1, "y", "x", "l", "link", True)], "host string, edge_seq long, src string, dst string, label string, kind string, skipped boolean")
    meta = spark.createDataFrame([(h, f"https://{h}/", 1) for h in "abc"], "host string, start string, pages int")
    got = {h: json.loads(t) for h, t in texts(S.link_documents(nodes, edges, meta)).items()}
    assert [e["source"] for e in got["a"]["edges"]] == ["y", "x"] and "edges" not in got["b"] and got["c"] == {"meta": {"start": "https://c/", "pages": 1}}


def test_files_are_written_and_renamed_by_tasks(spark, tmp_path, monkeypatch):
    rows = [("a:b%", 0, "x"), ("a:b%", 1, None), ("é ^", 0, "y"), (None, 0, "z"), *[(f"n{i}", 0, "é") for i in range(300)]]
    docs = spark.createDataFrame(rows, "host string, piece long, document string")
    with monkeypatch.context() as m:
        # as on any other file system
        m.setattr(S.manifest, "file_system", lambda *a, real=S.manifest.file_system: (type("Other", (), {
            "getUri": lambda s: type("U", (), {"getScheme": lambda s: "other"})(), "delete": lambda s, p, r: real(*a)[0].delete(p, r)})(), real(*a)[1]))
        m.setattr(S.manifest, "mover", lambda spark, path: lambda a, b: __import__("os").replace(a.removeprefix("file:"), b))
        S.write_documents(docs, str(tmp_path / "a"))
    monkeypatch.setattr(S.manifest, "mover", lambda *a: pytest.fail("the driver renames"))
    (tmp_path / "b").mkdir()
    # an older file and its check sum, which does not hold for the new one
    spark.createDataFrame([("old " * 9,)], "t string").coalesce(1).write.text(str(tmp_path / "old"))
    part = next((tmp_path / "old").glob("part-*"))
    part.with_name(f".{part.name}.crc").rename(tmp_path / "b" / ".n0.json.crc")
    part.rename(tmp_path / "b" / "n0.json")
    S.write_documents(docs, str(tmp_path / "b"))
    read = lambda d: {f.name: f.read_bytes() for f in d.iterdir() if not f.name.endswith(".crc")}
    got = read(tmp_path / "b")
    assert got == read(tmp_path / "a") and len(got) == 303 and got["a%3Ab%25.json"] == b"x\n\n" and got["__HIVE_DEFAULT_PARTITION__.json"] == b"z\n"
    assert spark.read.text(str(tmp_path / "b" / "n0.json")).collect()[0][0] == "é"
    with pytest.raises(ValueError, match="several documents of __HIVE_DEFAULT_PARTITION__"):
        S.write_documents(docs.withColumn("host", D.F.when(docs.host == "n1", "").otherwise(docs.host)), str(tmp_path / "b"))
    assert read(tmp_path / "b") == got
    S.write_documents(docs.where("false"), str(tmp_path / "c"))
    assert list((tmp_path / "c").iterdir()) == []


def test_a_part_goes_on_in_the_next_task(spark, monkeypatch):
    written = []
    # Spark reads 4,096 rows of a written table at a time
    assert D.PIECE * 4096 <= 1 << 27
    monkeypatch.setattr(D, "PIECE", 512)
    monkeypatch.setattr(D, "cut", lambda df, *a, cut=D.cut, **k: written.append((df.columns, k.get("codec"))) or cut(df, *a, **k))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 400
        nodes = spark.createDataFrame([(h, i, f"{h}{i}", "u", "t", "page") for i in range(n) for h in "ab"], "host string, node_seq long, id string, url string, title string, type string")
        edges = spark.createDataFrame([("b", i, f"b{i}", "b0", "l", "link", False) for i in range(n)], "host string, edge_seq long, src string, dst string, label string, kind string, skipped boolean")
        docs = S.link_documents(nodes, edges, spark.createDataFrame([(h, "s", n) for h in "abc"], "host string, start string, pages int"))
        rows = docs.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # the rows are written as pieces only, by several tasks a host
    assert written == [(["host", "part", "n", "document"], "zstd")]
    assert max(len(r["document"]) for r in rows) < 2 * D.PIECE and len(rows) > 60
    assert len({r["piece"]["n"] >> 32 for r in rows if r["host"] == "b" and r["piece"]["n"] >= 0}) > 1
    got = {h: json.loads(t) for h, t in texts(docs).items()}
    assert [x["id"] for x in got["a"]["nodes"]] == [f"a{i}" for i in range(n)] and "edges" not in got["a"] and list(got["c"]) == ["meta"]
    assert [x["source"] for x in got["b"]["edges"]] == [f"b{i}" for i in range(n)] and len(got["b"]["nodes"]) == n


def test_texts_are_sent_packed(spark):
    long = json.dumps({"states": [{"id": f"s{i}", "url": "https://h.test/"} for i in range(5_000)], "triggers": [{"label": None}] * 3}, indent=1)
    docs = spark.createDataFrame([("h", 1, long[100_000:]), ("h", 0, long[:100_000]), ("none", 0, None), ("short", 0, "{}")], "host string, piece int, document string")
    sent = {(r["host"], r["piece"]): r["document"] for r in D.pack(docs).collect()}
    assert sum(len(x) for x in sent.values() if x) < len(long) / 10 and D.unpack(sent["h", 0]).decode() == long[:100_000]
    assert sent["none", 0] is None and D.unpack(None) == b"" and D.unpack(sent["short", 0]) == b"{}"
    g = S.graphs_from_documents(docs)
    assert g.states.where("id = concat('s', state_seq) AND url IS NOT NULL").count() == 5_000 and g.triggers.count() == 3
    # what does not fit makes the whole document unreadable, wherever it stands in a list
    odd = '{"states": [%s{"id": "b", "depth": "x"}]}' % ('{"id": "a", "depth": 1},' * 200)
    g = S.graphs_from_documents(spark.createDataFrame([("odd", odd), ("h", '{"states": [null,{"id":"a"},null]}')], "host string, document string"))
    assert [(r["host"], r["error"]) for r in g.errors.collect()] == [("odd", "unreadable document")]
    assert sorted((r["state_seq"], r["id"]) for r in g.states.collect()) == [(0, None), (1, "a"), (2, None)]
