"""Repair of conversations against a search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import check
import pytest

import __spark_entry__ as entry
from clickatlas.llm import turnrepair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
GOOD = re.compile("(s?(ua)+)?")


def plain(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, digest) of rows in order, by trying everything."""
    seen, faults = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None)
        seen.add((role, text))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    inserts = [[]] + [[r] for r in ("user", "assistant")] + [list(p) for p in itertools.product(("user", "assistant"), repeat=2)]
    best = None
    options = []
    for (role, text), fault in zip(rows, faults, strict=True):
        late = 5 if fault == "truncated" else 0
        row = [(2, "D", None)]
        if fault not in ("blank", "duplicate"):
            row += [(late, "K", (role, text)), (1 + late, "R", ("user", text)), (1 + late, "R", ("assistant", text))]
        options.append(row)
    # prefixes that no grammar sentence begins with are left at once, else all choices would be too many
    states = [(0, "", [])]
    for row in [*options, [(0, "", None)]]:
        grown = []
        for cost, audit, out in states:
            for ins in inserts:
                for c, e, piece in row:
                    new = out + [(r, "") for r in ins] + ([piece] if piece else [])
                    letters = "".join(r[:1] or "?" for r, _ in new)
                    if any(GOOD.fullmatch(letters + t) for t in ("", "a", "ua")):
                        grown.append((cost + 5 * len(ins) + c, audit + "I" * len(ins) + e, new))
        states = sorted(grown, key=lambda x: (x[0], x[1]))[:4000]
    for cost, audit, out in states:
        if GOOD.fullmatch("".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return (*counts, illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


def sample(seed, n=30):
    rnd = random.Random(seed)
    out = {}
    for conv in range(n):
        kinds = rnd.choice([["system", "user", "assistant"], ["user", "assistant"], ["user"], ["tool", "user", "", "assistant", "u"]])
        out[conv] = [(rnd.choice(kinds), rnd.choice(["Yes.", "No!", "cut off", " \t\n", "", f"t{rnd.random()}?", f"x{rnd.random()} ", "Ok. \n"])) for _ in range(rnd.randint(1, 6))]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_edits(spark, seed):
    data = sample(seed)
    rows = [(c, i + (3 if i > 2 else 0), r, t) for c, conv in data.items() for i, (r, t) in enumerate(conv)]
    random.Random(seed).shuffle(rows)
    got = {r[0]: tuple(r)[1:] for r in turnrepair.repaired(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == {c: (3 if len(conv) > 3 else 0, *plain(conv)) for c, conv in data.items()}


def test_odd_rows(spark):
    empty = hashlib.sha256(b"").hexdigest()
    rows = [
        (None, None, "user", "A."), (None, 1, "assistant", "B."),
        (1, None, None, None), (1, None, None, None),
        (2, 5, "user", "Q?"), (2, 5, "user", "Q?"), (2, 9, "assistant", "A."),
        (3, -2, "assistant", "only"),
        (4, 0, "user", "é" * 300_000 + ". "), (4, 1, "assistant", " " * 200_000 + "."),
    ]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", fault int, cost string")
    got = {r[0]: tuple(r)[1:] for r in turnrepair.repaired(df).collect()}
    assert got[None] == (0, *plain([("user", "A."), ("assistant", "B.")])) and got[None][5:7] == (0, "KK")
    assert got[1] == (0, 2, 0, 0, 1, 4, "DD", empty)
    assert got[2] == (3, *plain([("user", "Q?"), ("user", "Q?"), ("assistant", "A.")])) and got[2][6] == "KDK"
    assert got[3] == (0, 0, 0, 1, 0, 2, "D", empty)
    assert got[4][:7] == (0, 0, 0, 0, 0, 0, "KK")
    assert turnrepair.repair_digests(df.where("false")).count() == 0


def test_conversation_that_loses_all_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = turnrepair.repair_digests(spark.createDataFrame([(gone, 0, "user", "A.")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversation():
    """Parity stays open to the last row; work and memory stay linear."""
    r = turnrepair.Repair()
    for i in range(20_001):
        r.add("u", "user", f"{i}.")
    cost, audit, _ = r.end()
    assert cost == 10_002 and audit == "D" + "KR" * 10_000


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    ok, note = check.compare(entry.queries()["op12_conversation_repair"](spark, sf), check.connect(sf), entry.oracle_sql()["op12_conversation_repair"])
    assert ok, note
