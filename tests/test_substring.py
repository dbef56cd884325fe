import random

from clickatlas.operators.substring import containing


def test_every_needle_against_every_text(spark):
    rnd = random.Random(4)
    word = lambda a, b: "".join(rnd.choice("abcü ") for _ in range(rnd.randint(a, b)))
    rows = [(f"h{i % 3}", i, rnd.choice([None, "", word(0, 3), word(0, 30)]), word(0, 12)) for i in range(120)]
    needles = [(f"h{rnd.randrange(4)}", rnd.choice([None, "", word(1, 1), word(2, 2), word(3, 3), word(4, 7), "nowhere"])) for _ in range(60)]
    got = containing(spark.createDataFrame(needles, "host string, v string"), spark.createDataFrame(rows, "host string, k long, a string, b string"), "v", ["a", "b"])
    want = {(h, v, k) for h, v in needles if v is not None for g, k, a, b in rows if g == h and (v in (a or "") and a is not None or v in b)}
    found = [(r["host"], r["v"], r["k"]) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_gram" in plan and got.columns == ["host", "v", "k", "a", "b"]


def test_only_long_needles_and_none(spark):
    rows = spark.createDataFrame([("h", 1, "create bolt"), ("h", 2, "edit nut"), ("g", 3, "create bolt")], "host string, k long, t string")
    ask = lambda *v: sorted(r["k"] for r in containing(spark.createDataFrame([("h", x) for x in v], "host string, v string"), rows, "v", ["t"]).collect())
    assert ask("bolt") == [1] and ask("bolt", "nut", "e") == [1, 1, 2, 2] and ask("bolts") == [] and ask(None) == []


def test_few_needles_read_each_text_once(spark):
    """A host's few needles are asked of its texts; no text is taken apart, and the rows are those of the grams."""
    rows = spark.createDataFrame([("h", 1, "create bolt", None), ("h", 2, "edit nut", "bolt"), ("g", 3, "bolt", ""), (None, 4, "bolt", "")], "host string, k long, t string, u string")
    few = [("h", "bolt"), ("h", "bolt"), ("h", "t"), ("h", ""), ("h", None), ("g", "nut"), ("g", "")]
    many = few + [("x", f"none {i}") for i in range(20)]
    ask = lambda v: containing(spark.createDataFrame(v, "host string, v string"), rows, "v", ["t", "u"])
    got = ask(few)
    assert "_gram" not in got._jdf.queryExecution().optimizedPlan().toString() and "_gram" in ask(many)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.select("host", "v", "k").collect())) == [("g", "", 3), ("h", "", 1), ("h", "", 2), ("h", "bolt", 1), ("h", "bolt", 2), ("h", "t", 1), ("h", "t", 2)]
    assert sorted(map(str, got.collect())) == sorted(map(str, ask(many).collect()))
