"""The whole pipeline on the small table against plain code, stage by stage."""

import collections
import itertools
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_neardup import brute
from test_texts import PATTERNS, WORD, hits
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
GITHUB = re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}")


def plain_quality(docs):
    """Rows that the rules keep, with quartiles of sorted lists; values of 64 and more are cut to their six leading bits."""
    def cut(v):
        shift = max(v.bit_length() - 6, 0)
        return v >> shift << shift

    measured, base = {}, set()
    for d, text, *_ in docs:
        t = text or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        at, covered = collections.defaultdict(list), set()
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        for places in at.values():
            if len(places) > 1:
                covered.update(i + k for i in places for k in range(5))
        if len(w) >= 10 and 100 * len(covered) <= 20 * len(w):
            base.add(d)
        if w:
            measured[d] = (sum(map(len, w)) * 100 // len(w), sum(t.count(c) for c in "#*$%&|<>") * 1000 // len(w), (len(lines) - len(set(lines))) * 1000 // len(lines))
    groups = collections.defaultdict(list)
    for d, _, lang, source in docs:
        if d in measured:
            for key in ((lang, source), (lang,), ()):
                groups[key].append(measured[d])

    def passes(d, lang, source):
        rows = next(groups[k] for k in ((lang, source), (lang,), ()) if len(groups[k]) >= 200 or not k)
        for i, (reach, step) in enumerate(((10, 100), (6, 100), (6, 400))):
            values = sorted(cut(r[i]) for r in rows)
            q1, q3 = (values[-(-len(values) * share // 4) - 1] for share in (1, 3))
            far = max((q3 - q1) * reach, step)
            if measured[d][i] > q3 + far or i == 0 and measured[d][i] < q1 - far:
                return False
        return True

    return [r for r in docs if r[0] in base and passes(r[0], r[2], r[3])]


def plain_redact(text):
    spans = sorted((m.start(), m.end()) for p, least in zip(PATTERNS, (12, 18, 16), strict=True) for m in p.finditer(text) if len(m[1]) >= least)
    out, at = "", 0
    for a, z in spans:
        out += text[at:a] + "<secret>" if a >= at else ""
        at = max(at, z)
    return out + text[at:]


def test_run_equals_plain_code(spark, monkeypatch):
    stages, cut = [], corpus_pipeline.cut

    def keep(df):
        out = cut(df)
        stages.append({r.doc_id: r.text for r in out.collect()})
        assert len(stages[-1]) == out.count()
        return out

    monkeypatch.setattr(corpus_pipeline, "cut", keep)
    pieces = corpus_pipeline.run(spark, SF).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert len({d for d, *_ in docs}) == len(docs)

    want = {d: t for d, t, *_ in plain_quality(docs)}
    assert 0 < len(want) < len(docs) and stages[0] == want
    kept = {d for d, _, _, first in brute(list(want.items()), 5, 80) if first}
    want = {d: t for d, t in want.items() if d in kept}
    assert stages[1] == want
    want = {d: t for d, t in want.items() if not hits(t, bench)[4]}
    assert stages[2] == want
    # tokens with a checksum are tested by themselves
    assert not any(GITHUB.search(t) for t in want.values())
    want = {d: plain_redact(t) for d, t in want.items()}
    assert stages[3] == want and len(stages) == 4

    plain, held = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), collections.defaultdict(list)
    for r in pieces:
        held[r.doc_id].append(r)
    assert held.keys() == want.keys()
    for d, t in want.items():
        ids, at = [*plain.encode(t, add_special_tokens=False).ids, 1], 0
        for r in sorted(held[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for _, parts in itertools.groupby(sorted((r.sequence_id, r.offset, r.length) for r in pieces), key=lambda x: x[0]):
        at = 0
        for _, offset, length in parts:
            assert offset == at
            at += length
        assert at <= 2048
