import pytest
from pyspark.sql import functions as F

import graphs as fixtures
from clickatlas.operators import aggregates as A
from clickatlas.operators.match import match_goals, suggest_labels
from clickatlas.operators.sets import mark_stale, split_hits
from clickatlas.plans import audit as U
from clickatlas.plans import content as C
from clickatlas.plans import howto as H
from clickatlas.sources import graphs as S

Q = "q_id long, host string, goal string, match string, start string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("graphs")
    fixtures.write(d)
    (d / "bad.test.json").write_text('{"states": [')
    (d / "half.test.json.tmp").write_text("{}")
    return S.read_graphs(spark, str(d))


def asks(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], Q)


def answers(df):
    return {r["q_id"]: r for r in df.collect()}


def test_reading(spark, stored, tmp_path):
    got = {r["host"]: (r["states"], r["edges"], r["triggers"]) for r in A.graph_summary(stored).collect()}
    assert got == {"clinic.test": (6, 5, 3), "garden.test": (3, 2, 0), "press.test": (4, 3, 4)}
    assert [(r["host"], r["status"]) for r in stored.errors.collect()] == [("bad.test", "error")]
    idx = [(r["host"], r["status"]) for r in A.hosts_index(A.graph_summary(stored), stored.errors).collect()]
    assert idx == [("bad.test", "error"), ("clinic.test", "ok"), ("garden.test", "ok"), ("press.test", "ok")]
    assert {r["kind"] for r in stored.triggers.where("host = 'clinic.test'").collect()} == {"form"}
    path = str(tmp_path / "t")
    S.write_graphs(stored, path)
    back = S.read_tables(spark, path)
    assert A.graph_summary(back).count() == 3
    assert sorted(map(str, back.triggers.collect())) == sorted(map(str, stored.triggers.select(*back.triggers.columns).collect()))
    docs = S.graphs_from_documents(S.to_documents(stored))
    for table in ("states", "edges", "triggers", "meta"):
        assert sorted(map(str, getattr(docs, table).collect())) == sorted(map(str, getattr(stored, table).collect())), table


def test_a_host_is_replaced_as_a_whole(spark, stored, tmp_path):
    path = str(tmp_path / "t")
    S.write_graphs(stored, path)
    before = S.read_tables(spark, path)
    clinic = lambda d: d.where("host = 'clinic.test'")
    S.write_graphs(before._replace(states=clinic(before.states).where("id = 'k0'"), edges=before.edges.where("false"), triggers=before.triggers.where("false"), meta=clinic(before.meta)), path)
    # a reader that began earlier still has the old tables, all of them
    assert before.triggers.count() == 7 and before.states.count() == 13
    now = S.read_tables(spark, path)
    assert {r["host"]: (r["states"], r["edges"], r["triggers"]) for r in A.graph_summary(now).collect()} == {"clinic.test": (1, 0, 0), "garden.test": (3, 2, 0), "press.test": (4, 3, 4)}
    S.drop_old_versions(spark, path)
    assert S.read_tables(spark, path).states.count() == 8


def test_a_write_that_dies_and_runs_again(spark, stored, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    counts = lambda: {r["host"]: (r["states"], r["edges"], r["triggers"]) for r in A.graph_summary(S.read_tables(spark, path)).collect()}
    with monkeypatch.context() as m:
        m.setattr(S.manifest, "_move_new", lambda *a: 1 / 0)
        for _ in range(2):
            with pytest.raises(ZeroDivisionError):
                S.write_graphs(stored, path, version="s-0")
    assert counts() == {} and not S.applied(spark, path, "s-0")
    S.write_graphs(stored, path, version="s-0")
    full = counts()
    assert sum(x[0] for x in full.values()) == 13 and S.applied(spark, path, "s-0")
    S.drop_old_versions(spark, path)
    assert counts() == full and len([f for f in (tmp_path / "t" / "states").iterdir() if f.name.startswith("version=")]) == 1


def test_two_writers(spark, stored, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    of = lambda host: S.Graphs(*(d.where(f"host = '{host}'") for d in stored[:4]), stored.errors)
    held = S.current_versions(spark, path)
    moved, others = S.manifest._move_new, [lambda: S.write_graphs(of("garden.test"), path)]
    monkeypatch.setattr(S.manifest, "_move_new", lambda *a: (others and others.pop()(), moved(*a))[1])
    S.write_graphs(of("press.test"), path, read=held)
    assert {r["host"] for r in S.current_versions(spark, path).collect()} == {"garden.test", "press.test"}
    # the same host: who read it before the other wrote it has to read again
    held = S.current_versions(spark, path)
    others.append(lambda: S.write_graphs(of("press.test"), path))
    with pytest.raises(S.StaleGraphs):
        S.write_graphs(of("press.test"), path, read=held)
    assert S.read_tables(spark, path).states.count() == 7


def test_summaries_by_kind(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"nodes": [{"id": "a", "url": "u"}], "edges": [], "meta": {}}')
    (tmp_path / "u.json").write_text('{"meta": {}}')
    fixtures.write(tmp_path, {"garden.test": fixtures.GARDEN})
    got = {r["host"]: (r["graph_kind"], r["states"], r["nodes"]) for r in S.summarize_documents(spark, str(tmp_path)).collect()}
    assert got == {"l": ("link", 0, 1), "u": ("unknown", 0, 0), "garden.test": ("interaction", 3, 0)}
    link = S.read_link_graphs(spark, str(tmp_path))
    assert {r["host"]: r["pages"] for r in link.meta.collect()} == {"l": 1}


def test_howto(spark, stored):
    q = asks(
        spark, ("clinic.test", "create bed", None, None), ("clinic.test", "add a sample", None, None), ("clinic.test", "new incident", None, None),
        ("clinic.test", "zebra", None, None), ("clinic.test", None, None, None), ("clinic.test", None, "^add s", "https://clinic.test/lab/samples"),
        ("press.test", "sign in", None, None), ("press.test", "download the atlas", None, None), ("press.test", "post a desk", None, None), ("press.test", "export", None, None),
    )
    a = answers(H.howto(stored, q))
    assert [a[i]["status"] for i in range(10)] == ["ok", "ok", "unreachable", "no_match", "invalid_args", "ok", "no_match", "ok", "no_match", "ok"]
    assert a[0]["clicks"] == 3 and a[0]["steps"] == ["Go to https://clinic.test/desk", "Click “Ward”", "Click “Beds tab”", "Click the “Create Bed” button"]
    assert a[1]["opens_at"] == "https://clinic.test/lab/samples/new" and a[1]["field_count"] == 1
    assert a[5]["clicks"] == 1 and a[5]["start_url"] == "https://clinic.test/lab/samples"
    assert a[7]["trigger_label"] == "Download the May atlas" and a[7]["download_url"].endswith("may-atlas.pdf")
    m, _ = H.routes(stored, q)
    low = {(r["q_id"], r["label"]) for r in H.with_trigger(H.low_confidence(m), stored).collect()}
    assert low == {(8, "Open a new desk"), (9, "Open a new desk")}
    assert [r["label"] for r in H.candidates(m, H.question_status(q, m, stored), stored).collect()] == ["New Incident"]
    hits, misses = split_hits(q, H.howto(stored, q))
    assert hits.count() == 5 and misses.count() == 5
    rep = answers(H.scenario_report(stored, q))
    assert rep[0]["found"] and rep[0]["form_field_count"] == 2 and rep[2]["candidates"] == 1


def test_few_questions_are_sent_to_the_triggers(spark, stored, monkeypatch):
    q = asks(spark, *[("clinic.test", g, m, None) for g, m in (("create a bed", None), ("add samples", ""), ("", None), ("create", None), ("bed", "^new"), (None, "(sample|BED)$"))],
             *[("press.test", g, None, None) for g in ("download", "new page", "zzz")], ("nowhere.test", "bed", None, None))
    t = stored.triggers.unionByName(stored.triggers.where("label = 'Add Sample'"))
    found = lambda: match_goals(q, t)
    plan = found()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    few = sorted(map(tuple, found().collect()))
    monkeypatch.setattr("clickatlas.operators.match.FEW_QUESTIONS", 0)
    assert few == sorted(map(tuple, found().collect())) and len(few) > 6
    # questions that share an id are merged, however few they are
    monkeypatch.setattr("clickatlas.operators.match.FEW_QUESTIONS", 8)
    twice = q.unionByName(q.where("goal = 'create a bed'"))
    assert sorted(map(tuple, match_goals(twice, t).collect())) == few


def test_rows_of_few_hosts_are_not_shuffled_to_be_stored(spark, stored, tmp_path, monkeypatch):
    calls, ranged = [], type(stored.states).repartitionByRange
    monkeypatch.setattr(type(stored.states), "repartitionByRange", lambda df, *a: calls.append(a) or ranged(df, *a))
    S.write_graphs(stored, str(tmp_path / "few"))
    assert not calls
    monkeypatch.setattr(S, "FEW_HOSTS", 2)
    S.write_graphs(stored, str(tmp_path / "many"))
    assert len(calls) == 4
    a, b = (S.read_tables(spark, str(tmp_path / x)) for x in ("few", "many"))
    for table in ("states", "edges", "triggers", "meta"):
        assert sorted(map(str, getattr(a, table).collect())) == sorted(map(str, getattr(b, table).collect())), table


def test_resolve_and_plan(spark, stored):
    q = asks(
        spark, ("clinic.test", "create bed", None, None), ("press.test", "download the atlas", None, None), ("press.test", "download floor plan", None, None),
        ("press.test", "post a desk", None, None), ("clinic.test", "sample", None, None),
    ).withColumn("index", F.when(F.col("q_id") == 4, 5).otherwise(0))
    r = H.resolve_action(stored, q)
    a = answers(r)
    assert [a[i]["status"] for i in range(5)] == ["ok", "ok", "ok", "ok", "no_match"]
    assert a[4]["detail"] == "index 5 out of range (1 match(es))" and a[3]["confidence"] == "low"
    plan = {}
    for s in H.action_plan(r).orderBy("q_id", "step").collect():
        plan.setdefault(s["q_id"], []).append((s["role"], s["target"], s["value"], s["disabled"]))
    assert plan[0] == [
        ("nav", "https://clinic.test/desk", None, False), ("nav", "https://clinic.test/ward", None, False), ("click", "#beds", None, False),
        ("note", None, None, True), ("fill", "#bed-number", "<bed number>", False), ("select", "#side", "left", False), ("submit", "#keep", None, True)]
    assert plan[1][-1] == ("download", "http://press.test/out/may-atlas.pdf", "may-atlas.pdf", False)
    assert plan[2][-1] == ("download", "#plan", None, False)
    assert plan[3][1][0] == "note"  # the frame hop has no selector
    assert not H.action_plan(r, allow_submit=True).where("role = 'submit'").first()["disabled"]
    tour = [(s["kind"], s["label"]) for s in H.tour_steps(r).where("q_id = 0").orderBy("step").collect()]
    assert tour == [("nav", "Ward"), ("nav", "Beds tab"), ("trigger", "Create Bed"), ("form", None)]


def test_content(spark, stored):
    hosts, views, items = C.find_content(stored, "nadia")
    assert {r["host"]: (r["status"], r["total_matches"]) for r in hosts.collect()} == {"clinic.test": ("ok", 1), "garden.test": ("ok", 2), "press.test": ("no_match", 0)}
    summary, per_host, v, it = C.find_content_hosts(stored, "nadia", limit=2)
    s = summary.first()
    assert (s["hosts_searched"], s["hosts_matched"], s["hosts_errored"], s["total_matches"], s["views_matched"], s["shown"]) == (4, 2, 1, 3, 2, 2)
    got = [(r["host"], r["take"], r["truncated"]) for r in v.orderBy("rank").collect()]
    assert got == [("clinic.test", 1, False), ("garden.test", 1, True)]
    assert [r["text"] for r in it.orderBy("rank").collect()] == ["Nadia Okafor", "Nadia Berg"]
    _, v0, i0 = C.find_content(stored, "batch 8", limit=0)
    assert [(r["shown"], r["truncated"]) for r in v0.collect()] == [(0, True)] and i0.count() == 0
    assert C.find_content_hosts(stored, "nadia", limit=0)[2].count() == 0
    assert {r["status"] for r in per_host.collect()} == {"ok", "no_match", "error"}
    lc = [(r["view_label"], r["kind"], r["count"], r["sample"]) for r in A.list_content(stored.states).where("host = 'clinic.test'").orderBy("state_seq").collect()]
    assert lc == [("Ward", "list", 2, "Nadia Okafor"), ("Samples", "table", 3, "Batch 7 2031-03-02")]
    st = {r["host"]: r["status"] for r in A.list_content_hosts(stored.states, stored.errors).collect()}
    assert st == {"press.test": "empty", "bad.test": "error", "clinic.test": "ok", "garden.test": "ok"}


def test_forms_and_stale(spark, stored):
    f = A.list_forms(stored.triggers, stored.states).where("host = 'clinic.test'").collect()
    assert [(r["label"], r["clicks"], r["field_count"]) for r in f] == [("New Incident", 2, 3), ("Add Sample", 3, 1), ("Create Bed", 3, 2)]
    goals = spark.createDataFrame([("clinic.test", "add a sample"), ("press.test", "the")], "host string, goal string")
    assert [r["label"] for r in mark_stale(stored.triggers, goals).where("stale").collect()] == ["Add Sample"]


def test_suggestions_and_warnings(spark, stored):
    needles = spark.createDataFrame([("clinic.test", "samples"), ("clinic.test", "creat bad"), ("clinic.test", "zzz")], "host string, needle string")
    got = {}
    for r in suggest_labels(needles, stored.triggers).orderBy("rank").collect():
        got.setdefault(r["needle"], []).append(r["label"])
    assert got == {"samples": ["Add Sample"], "creat bad": ["Create Bed"]}
    doc = ('{"steps":[{"op":"goto","goal":"create badge"},{"op":"goto","url":"x","goal":"zzz"},{"op":"for_each","body":[{"op":"do","match":"^New I"},'
           '{"op":"do","goal":"${a.b} x"},{"op":"do","goal":"create bed","index":3}]}]}')
    flows = spark.createDataFrame([("f", "clinic.test", doc), ("g", "unknown.test", doc)], "flow_id string, host string, doc string")
    w = {r["path"]: (r["status"], r["message"]) for r in U.goal_warnings(U.flow_steps(flows), stored).collect()}
    assert w == {
        "steps[0]": ("no_match", "no trigger matches “create badge” in the clinic.test graph"),
        "steps[2].body[0]": ("unreachable", "“^New I” matches a trigger, but no click-path in the clinic.test graph reaches it"),
        "steps[2].body[2]": ("no_match", "index 3 out of range (1 match(es)) (the clinic.test graph)"),
    }


def test_flows_of_any_depth(spark):
    doc = '{"steps":[' + '{"op":"for_each","body":[' * 12 + '{"op":"do","goal":"x"}' + "]}" * 12 + "]}"
    steps = U.flow_steps(spark.createDataFrame([("f", "h", doc), ("g", "h", None)], "flow_id string, host string, doc string")).collect()
    assert len(steps) == 13 and max(len(r["path"]) for r in steps) == len("steps[0]" + ".body[0]" * 12)


def test_audit(spark, stored):
    goals = spark.createDataFrame(
        [(1, "cl", "clinic.test", "create bed", None, "ok", "beds", 1), (2, "cl", "clinic.test", "add sample", None, "ok", "samples/new", 4),
         (3, "pr", "press.test", "sign in", None, "no_match", None, None), (4, "cl", "clinic.test", "new incident", None, "ok", None, None), (5, "no", "none.test", "x", None, "ok", None, None)],
        "q_id long, site string, host string, goal string, start string, want string, url_contains string, min_fields int",
    )
    scores, board = U.audit(stored, goals)
    assert {r["q_id"]: r["passed"] for r in scores.collect()} == {1: True, 2: False, 3: True, 4: False}
    assert {r["site"]: (r["passed"], r["goals"], r["dup"]) for r in board.collect()} == {"pr": (1, 1, 0), "cl": (1, 3, 0), "AGGREGATE": (2, 4, 0)}
    assert U.gate(board).first()["ok"] and not U.gate(board, "full", 3).first()["ok"]
    dup = spark.createDataFrame([("h", "https://x/a"), ("h", "https://x/a/?utm_source=1"), ("h", "https://x/b?page=2")], "host string, url string")
    assert A.dup_ratio(dup).first()["dup"] == 1 and A.base_path_spread(dup).first()["spread"] == 3
