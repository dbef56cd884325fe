import json

import pytest
from pyspark.sql import functions as F

from clickatlas.operators import transcripts as T
from clickatlas.plans.artifacts import accept_artifacts
from clickatlas.sources import frames as FR
from clickatlas.sources import ledger as LG
from clickatlas.sources import manifest
from clickatlas.sources import records as R
from clickatlas.streaming import store as KS
from clickatlas.streaming import streams as ST

FILES = "scope string, file_seq long, sha256 string, name string, size long, source string"


def test_ledger(spark, tmp_path):
    d = tmp_path / "led" / "scope=a"
    d.mkdir(parents=True)
    lines = [{"sha256": "x", "name": "1", "path": "/1", "size": 3, "seen_at": "2026-01-01T00:00:00Z"}, {"sha256": "x", "name": "2", "path": "/2", "size": 4, "seen_at": "2026-01-02T00:00:00Z"}]
    (d / "l.json").write_text("\n".join(map(json.dumps, lines)) + '\n\n{"name": "no hash"}\n{"sha256": "torn')
    led = LG.read_ledger(spark, str(tmp_path / "led"))
    assert [(r["scope"], r["sha256"], r["path"]) for r in led.collect()] == [("a", "x", "/2")]
    files = spark.createDataFrame(
        [("a", 1, "x", "f.pdf", 4, "s"), ("a", 2, "y", "g.tar.gz", 5, "s"), ("a", 3, "y", "h", 5, "s"), ("b", 4, "x", ".bashrc", 4, "s"), ("b", 5, "z", "n.averyveryverylong", 1, "s")], FILES)
    got = {r["file_seq"]: (r["status"], r["path"], r["first_seen"]) for r in accept_artifacts(files, led, "/st", "NOW").collect()}
    assert got == {1: ("dupe", "/2", "2026-01-02T00:00:00Z"), 2: ("new", "/st/y.gz", None), 3: ("dupe", "/st/y.gz", "NOW"), 4: ("new", "/st/x", None), 5: ("new", "/st/z.averyveryve", None)}
    assert accept_artifacts(files, led, "/st", "NOW", dedupe=False).where("status = 'new'").count() == 5
    LG.append_ledger(accept_artifacts(files, led, "/st", "2026-02-01T00:00:00Z"), str(tmp_path / "led"))
    assert LG.read_ledger(spark, str(tmp_path / "led")).count() == 4


def test_hash_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.TXT").write_bytes(b"hello")
    r = LG.hash_files(spark, str(tmp_path)).first()
    assert (r["name"], r["sha256"], r["size"], r["ext"]) == ("a.TXT", hashlib.sha256(b"hello").hexdigest(), 5, ".TXT")


def test_fold(spark):
    f = [("c", 0, "user", " Hi  there "), ("c", 1, "text", "a"), ("c", 2, "text", ""), ("c", 3, "text", "b"), ("c", 4, "done", None), ("c", 5, "text", "c"),
         ("c", 6, "tool_use", None), ("c", 7, "text", "d"), ("c", 8, "weird", "x"), ("c", 9, "text", "e"), ("c", 10, "user", "bye")]
    df = spark.createDataFrame([(*x, "t") for x in f], "conv_id string, seq long, type string, text string, ts string")
    for chunk in (2, 3, 1000):
        got = [(r["type"], r["role"], r["text"]) for r in T.fold_transcript(df, chunk=chunk).orderBy("entry").collect()]
        assert got == [("user", "user", " Hi  there "), ("text", "assistant", "abc"), ("tool_use", "assistant", ""), ("text", "assistant", "de"), ("user", "user", "bye")]
    assert T.auto_title(df).first()["title"] == "Hi there"


def test_trimming(spark):
    m = [("c", i, "user" if i % 2 == 0 else "assistant", i != 4, "x" * i) for i in range(9)]
    df = spark.createDataFrame(m, "conv_id string, seq long, role string, plain boolean, text string")
    assert sorted(r["seq"] for r in T.last_user_turns(df, 2).collect()) == [6, 7, 8]
    assert T.last_user_turns(df, 4).count() == 9
    assert T.drop_dangling_turn(df).agg(F.max("seq")).first()[0] == 7
    assert sorted(r["seq"] for r in T.wire_messages(df, 1).collect()) == [6, 7]
    sig = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("r", 3, "a"), ("r", 4, "c"), ("s", 1, "a")], "run_id string, page long, sig string")
    assert sorted((r["run_id"], r["page"]) for r in T.stop_on_repeat(sig).collect()) == [("r", 1), ("r", 2), ("r", 3), ("s", 1)]


def test_frames(spark):
    lines = ['{"type":"step","op":"goto","status":"ok"}', "Traceback", "[1]", '{"a":1}', "x" * 600, '  {"type":"result","status":"error"}  ']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq long, line string")
    got = {r["seq"]: (r["type"], r["status"], len(r["payload"])) for r in FR.parse_frames(df).collect()}
    assert got[0][:2] == ("step", "ok") and got[1] == ("log", None, 9) and got[2][0] == got[3][0] == "log" and got[4][2] == 500 and got[5][:2] == ("result", "error")
    p = spark.createDataFrame([("· [12 states / 40 visits] depth 3 · https://x/(a) (7 controls, 3 items)",), ("Wrote out",)], "line string")
    r = FR.parse_progress(p).collect()
    assert tuple(r[0])[:6] == ("progress", 12, 40, 3, "https://x/(a)", 7) and r[1]["log_line"] == "Wrote out"


def test_records(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"r{i}.json").write_text(json.dumps({"id": f"r{i}", "status": "ok", "started_at": f"2026-01-0{i + 1}"}, indent=1))
    (tmp_path / "bad.json").write_text("{")
    assert [r["id"] for r in R.read_runs(spark, str(tmp_path)).collect()] == ["r2", "r1", "r0"]
    g = tmp_path / "goals" / "g.json"
    g.parent.mkdir()
    g.write_text(json.dumps({"sites": [{"name": "s", "host": "h", "start_url": "https://h/", "goals": [{"goal": "a", "expect": {"min_fields": 2}}, {"goal": "b", "start": "https://z/", "expect": {"status": "no_match"}}]}]}))
    assert [(r["goal"], r["start"], r["want"], r["min_fields"]) for r in R.read_goals(spark, str(g.parent)).collect()] == [("a", "https://h/", "ok", 2), ("b", "https://z/", "no_match", None)]


def test_run_stream_survives_restart(spark, tmp_path):
    schema = "run_id string, seq long, type string, status string"
    src, store, ckpt = (str(tmp_path / x) for x in ("in", "runs", "ck"))

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ST.run_stream(spark.readStream.schema(schema).parquet(src), store, ckpt)
        return {r["run_id"]: (r["status"], r["frames"]) for r in ST.latest_runs(spark, store).collect()}

    assert feed([("a", 1, "step", "ok"), ("b", 1, "step", "ok"), ("c", 1, "result", "ok")]) == {"a": ("running", 1), "b": ("running", 1), "c": ("ok", 1)}
    assert feed([("a", 2, "exit", None), ("b", 2, "result", "aborted")]) == {"a": ("error", 2), "b": ("aborted", 2), "c": ("ok", 1)}


def test_a_new_stream_extends_the_store(spark, tmp_path):
    schema = "run_id string, seq long, type string, status string"
    store = str(tmp_path / "runs")
    for i, rows in enumerate([[("a", 1, "step", "ok"), ("b", 1, "step", "ok")], [("b", 2, "result", "ok"), ("c", 1, "step", "ok")]]):
        src = str(tmp_path / f"in{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
        ST.run_stream(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / f"ck{i}"))
    assert {r["run_id"]: (r["status"], r["frames"]) for r in ST.latest_runs(spark, store).collect()} == {"a": ("running", 1), "b": ("ok", 2), "c": ("running", 1)}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    store, shape = str(tmp_path / "s"), "k string, n bigint"
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))
    batch = lambda *rows: spark.createDataFrame(rows, shape)
    read = lambda: {r["k"]: r["n"] for r in ST.read_store(spark, store, shape).collect()}
    ST.fold_into_store(batch(("a", 1), ("b", 1)), "x-0", store, shape, "k", add)
    for _ in range(2):
        ST.fold_into_store(batch(("a", 5), ("c", 1)), "x-1", store, shape, "k", add)
        assert read() == {"a": 6, "b": 1, "c": 1}
    for i in range(2, 6):
        ST.fold_into_store(batch(("a", 1)), f"x-{i}", store, shape, "k", add)
    ST.fold_into_store(batch(("a", 100)), "x-3", store, shape, "k", add)
    assert read() == {"a": 10, "b": 1, "c": 1}
    ST.fold_into_store(batch(("a", 1)), "y-0", store, shape, "k", add)
    assert read()["a"] == 11


def _layers(spark, store):
    return KS._layers(manifest.newest(spark, store, KS._MANIFEST)[0])[0]


def test_a_batch_of_one_key_writes_one_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(KS, "PART_ROWS", 100)
    monkeypatch.setattr(manifest, "KEEP", 3)
    store, shape = str(tmp_path / "s"), "k string, n bigint"
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))
    ST.fold_into_store(spark.range(1000).selectExpr("'k' || id AS k", "id AS n"), "x-0", store, shape, "k", add)
    assert [(at.rows, at.parts) for at in _layers(spark, store)] == [(1000, 10)]
    before, then = ST.read_store(spark, store, shape), _layers(spark, store)[0].name
    ST.fold_into_store(spark.createDataFrame([("k7", 1)], shape), "x-1", store, shape, "k", add)
    assert [at.rows for at in _layers(spark, store)] == [1000, 1]
    # a look-up opens the parts that can hold the key
    keys = spark.createDataFrame([("k7",)], "k string")
    found = KS._look_up(spark, store, shape, _layers(spark, store), keys, True)
    assert [tuple(r) for r in found.collect()] == [("k7", 8)] and len(found.inputFiles()) == 2
    for i in range(2, 14):
        ST.fold_into_store(spark.createDataFrame([(f"k{i}", 1), ("new", 1)], shape), f"x-{i}", store, shape, "k", add)
    got = {r["k"]: r["n"] for r in ST.read_store(spark, store, shape).collect()}
    assert len(got) == 1001 and got["new"] == 12 and got["k7"] == 9 and got["k13"] == 14 and got["k500"] == 500
    # many batches are few layers; the large one was never written again, and a reader of the first store still has it
    assert _layers(spark, store)[0].name == then and len(_layers(spark, store)) <= 5
    assert before.where("k = 'k7'").first()["n"] == 7
    assert len(manifest.numbers(spark, store)) == 3 and len(list((tmp_path / "s" / "layers").iterdir())) <= 8


def test_a_dead_writer_leaves_nothing(spark, tmp_path, monkeypatch):
    store, shape = str(tmp_path / "s"), "k string, n bigint"
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))
    one = spark.createDataFrame([("a", 1)], shape)
    ST.fold_into_store(one, "x-0", store, shape, "k", add)
    with monkeypatch.context() as m:
        m.setattr(manifest, "_move_new", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ST.fold_into_store(one, "x-1", store, shape, "k", add)
    assert ST.read_store(spark, store, shape).first()["n"] == 1
    # another stream comes first while this one writes: its rows are folded again
    moved, others = manifest._move_new, [lambda: ST.fold_into_store(one, "y-0", store, shape, "k", add)]
    monkeypatch.setattr(manifest, "_move_new", lambda *a: (others and others.pop()(), moved(*a))[1])
    ST.fold_into_store(one, "x-1", store, shape, "k", add)
    assert ST.read_store(spark, store, shape).first()["n"] == 3


def test_ledger_outlives_its_streams(spark, tmp_path):
    base = str(tmp_path)
    for i, (sha, name) in enumerate([("x", "1"), ("y", "2"), ("x", "3"), ("z", "4")]):
        stream = "a" if i < 2 else "b"
        spark.createDataFrame([("s", i, sha, name, 1, "t")], FILES).coalesce(1).write.mode("append").parquet(f"{base}/in_{stream}")
        ST.ledger_stream(spark.readStream.schema(FILES).parquet(f"{base}/in_{stream}"), f"{base}/ledger", "/st", "NOW", f"{base}/ck_{stream}")
    assert sorted((r["sha256"], r["name"]) for r in ST.stored_ledger(spark, f"{base}/ledger").collect()) == [("x", "1"), ("y", "2"), ("z", "4")]
