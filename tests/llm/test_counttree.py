"""The count-vector tree against all pairs; small pages make every level run."""

import random

import check
import pytest
from test_neardup import brute, sample

import __spark_entry__ as entry
from clickatlas.llm import counttree


def want(data, size, percent):
    return sorted([r[:3] for r in brute(data, size, percent)], key=str)


def chained(seed):
    """Copies that drift: neighbours link, far ones do not; and texts put together from shared passages."""
    rnd = random.Random(seed)
    passages = [[f"p{i}w{k}" for k in range(12)] for i in range(8)]
    rows, w = [], [f"w{i}" for i in range(80)]
    for i in range(40):
        w = list(w)
        w[rnd.randrange(80)] = f"new{seed}x{i}"
        rows.append((1000 + i, " ".join(w)))
    for i in range(80):
        rows.append((2000 + i, " ".join(x for p in rnd.sample(passages, 5) for x in p)))
    return rows


@pytest.mark.parametrize(("seed", "page", "size", "percent"), [(1, 32, 5, 80), (2, 4, 5, 80), (3, 2, 3, 70), (4, 3, 2, 50)])
def test_against_all_pairs(docs, rows, monkeypatch, seed, page, size, percent):
    monkeypatch.setattr(counttree, "PAGE", page)
    monkeypatch.setattr(counttree, "CROWD", 2 * page)
    monkeypatch.setattr(counttree, "SAMPLE", page % 3 + 1)
    data = sample(seed) + chained(seed)
    assert rows(counttree.linked(docs(data), size, percent)) == want(data, size, percent)


def test_short_texts(docs, rows):
    rnd = random.Random(7)
    data = [(i, " ".join(rnd.choice("ABcde") for _ in range(rnd.randint(0, 12)))) for i in range(300)]
    assert rows(counttree.linked(docs(data))) == want(data, 5, 80)


def test_odd_tables(spark, docs):
    assert counttree.linked(docs([])).count() == 0
    assert sorted(map(tuple, counttree.linked(docs([(1, None), (2, ""), (3, " \n")])).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    long = " ".join(f"w{i}" for i in range(200_000))
    names = "doc_id int, text string, node string, cell int, label int, counts string, n int, a int, component_id int, text_key int"
    data = [(2, long, *["x", 1, 1, "x", 1, 1, 1, 1]), (1, long + " more", *["y", 2, 2, "y", 2, 2, 2, 2]), (None, long, *["x", 1, 1, "x", 1, 1, 1, 1])]
    assert sorted(map(tuple, counttree.linked(spark.createDataFrame(data, names)).collect()), key=str) == [(1, 199_997, 1), (2, 199_996, 1), (None, 199_996, 1)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    ok, note = check.compare(entry.queries()["op11_jaccard_join"](spark, sf), check.connect(sf), entry.oracle_sql()["op11_jaccard_join"])
    assert ok, note
