"""Ranked search against scoring every pair, and what the bounds leave."""

import math
import random
import re

import check
import numpy as np
import pytest

import __spark_entry__ as entry
from clickatlas.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def terms(text):
    return [t for t in TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def plain(docs, items, k):
    bags = [(d, terms(t)) for d, t in docs]
    n_docs, n_words = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in set(items):
        scored = []
        for d, b in bags:
            m = 50 + 50 * len(b) * n_docs // n_words if b else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b.count(t) // (1000 * b.count(t) + 20 * m)) for t in set(terms(text)) & set(b))
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def sample(seed, n=150):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(300)] + ["É", "ab", "AB", "x9"]
    text = lambda size: "".join(rnd.choice(words) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(size))
    docs = [(i, text(rnd.randint(0, 40))) for i in range(n)] + [(3, None), (None, "w1 w2 x9"), (None, "w1 w2 x9"), (-5, "w1 w2 x9"), (900, ""), (901, "...")]
    docs += rnd.sample(docs, 20) + [(902, "w1 " * 50_000 + "w7")]
    items = [(i, text(rnd.randint(0, 12))) for i in range(30)] + [(4, "w1"), (None, "w2 W2 w3"), (77, None), (78, ""), (79, "nowhere")]
    return docs, items + items[:2]


@pytest.mark.parametrize(("seed", "group", "node", "k", "bound"), [(1, 256, 16, 50, 4 << 20), (2, 8, 2, 3, 4 << 20), (3, 16, 4, 5, 200)])
def test_against_all_pairs(spark, docs, rows, monkeypatch, seed, group, node, k, bound):
    monkeypatch.setattr(ranked, "GROUP", group)
    monkeypatch.setattr(ranked, "NODE", node)
    data, items = sample(seed)
    got = ranked.rank(docs(data), spark.createDataFrame(items, ITEMS), k, bound)
    assert rows(got) == plain(data, items, k)


def test_nothing_to_find(spark, docs):
    items = spark.createDataFrame([(1, "a b"), (2, None)], ITEMS)
    assert ranked.rank(docs([]), items).count() == 0
    assert ranked.rank(docs([(1, None), (2, " . ")]), items).count() == 0
    assert ranked.rank(docs([(1, "a")]), items.where("false")).count() == 0
    assert ranked.rank(docs([(1, "a")]), items.where("item_id = 2")).count() == 0


def test_other_columns(spark):
    d = spark.createDataFrame([(1, "a b", 5, "r", 2, 3)], "doc_id int, text string, score int, rank string, item long, n int")
    i = spark.createDataFrame([("q", "b", 1.0)], "item_id string, text string, score double")
    assert [(r.item_id, r["rank"], r.doc_id) for r in ranked.rank(d, i).collect()] == [("q", 1, 1)]


def test_bounds_prune_and_lose_nothing():
    rnd = np.random.default_rng(5)
    # four subjects with words of their own, and some that all share
    own = (np.arange(64)[:, None] // 16 == np.arange(200) // 40) | (np.arange(200) >= 160)
    weights, impacts = (np.where(own & (rnd.random((64, 200)) < 0.1), rnd.integers(1, 1000, (64, 200)), 0).astype(np.float64) for _ in range(2))
    full = weights @ impacts.T
    least = np.sort(full, 1)[:, -5].astype(np.int64)
    seen = np.zeros_like(full)
    for items, docs, score in ranked.node_pairs(weights, impacts, least):
        assert (score == full[np.ix_(items, docs)]).all()
        seen[np.ix_(items, docs)] = 1
    assert seen[(full > 0) & (full >= least[:, None])].all() and seen.mean() < 0.5


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    ok, note = check.compare(entry.queries()["op13_ranked_search"](spark, sf), check.connect(sf), entry.oracle_sql()["op13_ranked_search"])
    assert ok, note
