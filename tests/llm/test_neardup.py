"""Near copies against brute force; small lists make every path run."""

import random
import re

import pytest

from clickatlas.llm import neardup
from clickatlas.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted([(d, len(sets[i]), low.get(find(i)), d == low.get(find(i))) for i, (d, _) in enumerate(rows)], key=str)


def sample(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["The", "é"]
    rows = [(None, None), (5, ""), (6, "a"), (7, None), (8, "a b"), (9, "A  b"), (10, "a b c"), (None, "a b C")]
    passage = [rnd.choice(words) for _ in range(60)]
    for _ in range(10):
        base = [rnd.choice(words) for _ in range(rnd.randint(30, 120))]
        if rnd.random() < 0.5:
            base[5:5] = passage
        for _ in range(rnd.choice([1, 3, 40])):
            w = list(base)
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(len(w))] = rnd.choice([*words, f"zz{rnd.randint(0, 10**6)}"])
            rows.append((len(rows) + 20 if rnd.random() < 0.95 else None, rnd.choice(" \n").join(w)))
    rows += rows[:3] + rows[20:24]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "limit", "size", "percent"), [(1, 32, 3, 85), (3, 3, 3, 85), (2, 4, 5, 80)])
def test_against_all_pairs(docs, rows, monkeypatch, seed, limit, size, percent):
    monkeypatch.setattr(neardup, "LIST", limit)
    data = sample(seed)
    assert rows(neardup.near_duplicates(docs(data), size, percent)) == brute(data, size, percent)


def test_short_texts_in_long_lists(docs, rows):
    data = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(8)]
        data += [(100 * g, " ".join(base))] + [(100 * g + i + 1, " ".join([*base, f"x{i}"])) for i in range(40)]
    want = brute(data, 5, 80)
    assert sum(kept for *_, kept in want) == 6
    assert rows(neardup.near_duplicates(docs(data), 5, 80)) == want
    assert neardup.keep_one(docs(data)).count() == 6


@pytest.mark.parametrize(("limit", "size", "percent"), [(32, 5, 50), (3, 3, 50), (3, 2, 40), (2, 1, 60)])
def test_low_similarities(docs, rows, monkeypatch, limit, size, percent):
    monkeypatch.setattr(neardup, "LIST", limit)
    rnd = random.Random(size)
    data = sample(4) + [(1000 + i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(size, size + 4)))) for i in range(60)]
    assert rows(neardup.near_duplicates(docs(data), size, percent)) == brute(data, size, percent)


def test_keep_one(docs):
    text = " ".join(f"w{i}" for i in range(60))
    data = [(3, text), (2, text + " x"), (2, text + " x"), (None, text), (9, ""), (9, ""), (None, None), (4, "other words here")]
    got = sorted(map(tuple, neardup.keep_one(docs(data)).collect()), key=str)
    assert got == sorted([(2, text + " x"), (9, ""), (9, ""), (None, None), (4, "other words here")], key=str)


def test_keep_one_under_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    names = ["gone_id", "text", "_same", "doc_id", "gone_text", "_extra0", "node", "text_key", "component"]
    rows = [(7, text, 1, 3, "a", 2, "b", 4, 5), (8, text + " x", 2, 2, "a", 2, "b", 4, 5), (8, text + " x", 2, 2, "a", 2, "b", 4, 5), (9, "", 3, 9, "a", 2, "b", 4, 5)]
    got = neardup.keep_one(spark.createDataFrame(rows, names))
    assert got.columns == names and sorted(map(tuple, got.collect())) == [rows[1], rows[3]]


def test_empty(docs):
    assert neardup.near_duplicates(docs([])).count() == 0 and neardup.keep_one(docs([])).count() == 0


def test_components_of_a_long_chain(spark, rows):
    links = spark.range(200).selectExpr("CAST(lpad(id, 4, '0') AS BINARY) a", "CAST(lpad(id + 1, 4, '0') AS BINARY) b")
    assert {bytes(label) for _, label in rows(components(links))} == {b"0000"}
