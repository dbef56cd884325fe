"""Repeated passages and byte strings against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from clickatlas.llm import passages, suffixes
from clickatlas.llm.words import Words, rolling_words, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, None), (5, ""), (5, "a"), (7, None), (8, " \n "), (None, "x y")]


def order(doc_id):
    return -(2**63) if doc_id is None else doc_id


def first_places(sequences, length):
    first = {}
    for doc_id, s in sequences:
        for p in range(len(s) - length + 1):
            key = tuple(s[p : p + length]) if isinstance(s, list) else s[p : p + length]
            first[key] = min(first.get(key, (order(doc_id), p)), (order(doc_id), p))
    return first


def covered(doc_id, s, length, first):
    out = set()
    for p in range(len(s) - length + 1):
        key = tuple(s[p : p + length]) if isinstance(s, list) else s[p : p + length]
        if first[key] < (order(doc_id), p):
            out.update(range(p, p + length))
    return out


def by_words(rows, length=20):
    seq = [(i, WORD.findall(t or "")) for i, t in rows]
    first, out = first_places(seq, length), []
    for i, w in seq:
        gone = covered(i, w, length, first)
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def by_bytes(rows, length=100):
    seq = [(i, (t or "").encode()) for i, t in rows]
    first, out = first_places(seq, length), []
    for i, b in seq:
        gone = covered(i, b, length, first)
        spans = sum(p - 1 not in gone for p in gone)
        out.append((i, len(b), len(gone), spans, hashlib.sha256(bytes(x for n, x in enumerate(b) if n not in gone)).hexdigest()))
    return sorted(out, key=str)


def word_rows(seed):
    rnd = random.Random(seed)
    shared = [" ".join(rnd.choice("abcé") for _ in range(rnd.randint(15, 60))) for _ in range(8)]
    rows = list(ODD)
    for _ in range(60):
        parts = [rnd.choice(shared) if rnd.random() < 0.6 else " ".join(rnd.choice("abcdefgh漢") for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 5))]
        rows.append((rnd.randint(0, 40) if rnd.random() < 0.9 else None, rnd.choice([" ", "\n", "\t "]).join(parts)))
    return rows + rows[:9]


def byte_rows(seed):
    rnd = random.Random(seed)
    shared = ["".join(rnd.choice("abcé ") for _ in range(rnd.randint(70, 250))) for _ in range(8)]
    rows = [*ODD, (300, "ab" * 300), (301, "x" * 400)]
    for _ in range(80):
        parts = [rnd.choice(shared) if rnd.random() < 0.6 else "".join(rnd.choice("abcdefgh漢") for _ in range(rnd.randint(1, 90))) for _ in range(rnd.randint(1, 6))]
        rows.append((rnd.randint(0, 60) if rnd.random() < 0.9 else None, "".join(parts)))
    return rows + rows[:9]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(docs, rows, seed):
    data = word_rows(seed)
    assert rows(passages.passage_digests(docs(data))) == by_words(data)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(docs, rows, seed):
    data = byte_rows(seed)
    assert rows(suffixes.byte_digests(docs(data))) == by_bytes(data)


def test_spans_and_texts(docs):
    line = " ".join(f"w{i}" for i in range(25))
    got = {r.doc_id: r for r in passages.without_repeats(docs([(1, "a b " + line), (2, "c " + line + " d e"), (3, line)])).collect()}
    assert got[1].kept == "a b " + line and got[1].spans == []
    assert got[2].kept == "c d e" and [(s.start, s.end) for s in got[2].spans] == [(1, 26)]
    assert got[3].kept == "" and got[3].n_removed == 25


def test_a_long_text_over_many_slices(docs, rows):
    rnd = random.Random(5)
    long = " ".join(rnd.choice(["alpha", "beta", "gamma", f"n{rnd.randint(0, 10**6)}"]) for _ in range(200_000))
    data = [(1, long), (2, long[1000:9000]), (3, "z " + long[50_000:50_400])]
    assert {r[0]: r[1:3] for r in rows(suffixes.byte_digests(docs(data)))}[2] == (8000, 8000)
    assert rows(passages.passage_digests(docs(data))) == by_words(data)


def test_empty_table_and_clashing_columns(spark, docs):
    assert passages.passage_digests(docs([])).count() == 0 and suffixes.byte_digests(docs([])).count() == 0
    odd = spark.createDataFrame([(1, "a", "b", 2)], "doc_id bigint, text string, block string, part int")
    assert passages.passage_digests(odd).count() == 1 and suffixes.byte_digests(odd).count() == 1


def test_word_hashes_follow_words():
    rnd = random.Random(1)
    texts = [None, ""] + ["".join(rnd.choice(["a", "b", "é", " ", "\n", "\x0b", "漢", "\x1c", "\xa0"]) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    words = [WORD.findall(t or "") for t in texts]
    w = Words(pa.array(texts))
    assert w.count.tolist() == [len(x) for x in words]
    flat = [x for y in words for x in y]
    assert len(set(zip(flat, w.hash.tolist(), strict=True))) == len(set(flat)) == len(set(w.hash.tolist()))
    at = w.starts(3)
    three = {tuple(flat[a : a + 3]) for a in at}
    assert len(set(rolling_words(w.hash).of(at, at + 3).tolist())) == len(three)


def test_runs():
    row, start, end = (np.array(x) for x in ([1, 0, 1, 1], [5, 0, 0, 7], [8, 2, 3, 20]))
    assert [x.tolist() for x in runs(row, start, end)] == [[0, 1, 1], [0, 0, 5], [2, 3, 20]]
