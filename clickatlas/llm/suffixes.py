"""Repeated byte strings by bucket-pointer refinement of sampled suffixes.

A suffix is known by its bucket.  The first buckets are those of the ``GRAM``
bytes a suffix begins with; refined buckets sort suffixes on the bucket
identifiers of later offsets.  With ``b`` the identifier of the first bucket,

- ``b2[i]`` names ``(b[i], b[i + GRAM])``, the bucket of ``2 * GRAM`` bytes,
- ``b3[i]`` names ``(b2[i], b[i + length - GRAM])``, the bucket of ``length`` bytes,
- ``b4[i]`` names ``(b3[i], b3[j], j - i)`` with ``j`` at most ``length`` further,
  the bucket of the ``length + j - i`` bytes that both cover.

Each step reuses the identifiers of the step before, and goes on only in buckets
that still hold more than one string:

1. Of each string of ``length`` bytes, the suffix at its smallest GRAM hash is
   sampled (its leftmost one), so equal strings sample equal suffixes.  A run of
   strings that share a sample is one entry with buckets ``b`` and ``b4``.
2. Blocks send entries to shards by ``b``.  Entries of one ``b4`` are whole copies
   of each other: all but the first are covered.  A bucket ``b`` with one ``b4``
   is then settled, however many members it has.
3. In buckets with several ``b4``, the first entry of each sends its strings'
   ``b3``; a shard finds the first place of each, and the later ones are covered.

Identifiers are 64-bit hashes, not ranks: ranks would need a global sort of every
byte.  Two equal identifiers are taken as equal strings; each comparison also
agrees on an independent hash that chose the shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import answer_arrays, answered, doc_ids, each_block, flat, lists, load, shard_of, to_blocks
from .words import SLICE_BYTES, U64, mix, rolling_bytes, runs, slices, utf8

LENGTH, GRAM = 100, 36
_SPAN = "block bigint, line array<int>, start array<int>, end array<int>"
_OPEN = "open_line array<int>, open_start array<int>, open_end array<int>"
_ENTRIES = (
    "shard int, block bigint, b array<int>, b4 array<bigint>, line array<int>, start array<int>, last array<int>, "
    "ids_line array<int>, ids array<bigint>, done_line array<int>, done_start array<int>, done_end array<int>"
)
_STRINGS = "shard int, block bigint, hash array<bigint>, line array<int>, start array<int>, doc array<bigint>, done_line array<int>, done_start array<int>, done_end array<int>"


class Buckets:
    """Bucket identifiers of the positions of one slice of texts."""

    def __init__(self, data: np.ndarray, length: int, gram: int, which: int = 0):
        self.length, self.gram = length, gram
        n = max(0, len(data) - gram + 1)
        at = np.arange(n)
        self.b = rolling_bytes(data, which).of(at, at + gram) if n else np.zeros(0, U64)

    def b3(self, at: np.ndarray) -> np.ndarray:
        """Identifier of the ``length`` bytes from each position."""
        name, covered = self.b[at], self.gram
        while covered < self.length:
            step = min(covered, self.length - self.gram)
            name = mix(name * U64(0x9FB21C651E98DF25) + self.b[at + step])
            covered = step + self.gram
        return name

    def b4(self, start: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Identifier of the bytes from ``start`` to the end of the string at ``last``."""
        return mix(self.b3(start) * U64(0xD1B54A32D192ED03) + self.b3(last) + (last - start).astype(U64))


def sampled(b: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sample, first, last): each sampled position and the run of string starts that sample it."""
    n = int(off[-1]) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    width = length - gram + 1
    # the hash decides, and the place among equal hashes: the smallest key is the leftmost smallest hash
    key = (b & ~U64(0xFFFFFFFF)) | np.arange(len(b), dtype=U64)
    low, size = key, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[width - size : width - size + n])
    sample = (low & U64(0xFFFFFFFF)).astype(np.int64)
    begin = np.arange(n)
    end = np.repeat(off[1:], np.diff(off))[:n]
    inside = begin + length <= end
    begin, sample, end = begin[inside], sample[inside], end[inside]
    if not len(begin):
        return (np.zeros(0, np.int64),) * 3
    new = np.append(True, (sample[1:] != sample[:-1]) | (begin[1:] != begin[:-1] + 1))
    first = np.flatnonzero(new)
    return sample[first], begin[first], begin[np.append(first[1:], len(begin)) - 1]


def _later(doc: np.ndarray, start: np.ndarray, *names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by names, document and start; which begin a group of equal names; which come after the first of theirs."""
    o = np.lexsort((start, doc, *names[::-1]))
    doc, start = doc[o], start[o]
    new = np.zeros(len(o), bool)
    for x in names:
        x = x[o]
        new |= np.append(True, x[1:] != x[:-1]) if len(o) else new
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(o) else o
    return o, new, (doc > doc[first]) | (start > start[first])


def _entries(length: int, gram: int, n: int):
    def make(row):
        table = load(row["payload"].as_py())
        ids = doc_ids(table)
        data, off = utf8(table["text"])
        parts = []
        for a, z in slices(off, SLICE_BYTES):
            part, edge = data[off[a] : off[z]], off[a : z + 1] - off[a]
            k = Buckets(part, length, gram)
            at, first, last = sampled(k.b, edge, length, gram)
            line = np.searchsorted(edge, first, "right") - 1
            parts.append((k.b[at], k.b4(first, last), line + a, first - edge[line], last - edge[line]))
        b, b4, line, start, last = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, U64), np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3)
        o, _, late = _later(ids[line], start, b4, b)
        gone = o[late]
        done = runs(line[gone], start[gone], last[gone] + length)
        o = o[~late]
        shard = shard_of(b[o], n)
        by = np.lexsort((start[o], line[o], shard))
        o, shard = o[by], shard[by]
        pair = np.append(True, (shard[1:] != shard[:-1]) | (line[o][1:] != line[o][:-1])) if len(o) else np.zeros(0, bool)
        own = np.zeros(len(done[0]), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, row["block"].as_py()), pa.int64()),
             lists(b[o].astype(np.uint32).view(np.int32), shard, n, pa.int32()), lists(b4[o].view(np.int64), shard, n, pa.int64()),
             lists(line[o], shard, n, pa.int32()), lists(start[o], shard, n, pa.int32()), lists(last[o], shard, n, pa.int32()),
             lists(line[o][pair], shard[pair], n, pa.int32()), lists(ids[line[o][pair]], shard[pair], n, pa.int64()),
             *[lists(x, own, n, pa.int32()) for x in done]],
            ["shard", "block", "b", "b4", "line", "start", "last", "ids_line", "ids", "done_line", "done_start", "done_end"],
        )

    return make


def _merged(table: pa.Table, at, line, start, end) -> dict:
    width = int(line.max()) + 1 if len(line) else 1
    key, start, end = runs(at * width + line, start, end)
    at, n = key // width, len(table)
    return {"line": lists(key % width, at, n, pa.int32()), "start": lists(start, at, n, pa.int32()), "end": lists(end, at, n, pa.int32())}


def _done(table: pa.Table, at, line, start, end) -> dict:
    """Intervals found by the shard and those the block had found itself."""
    more, where = flat(table["done_line"])
    cat = lambda x, y: np.concatenate([x, y]).astype(np.int64)
    return _merged(table, cat(at, where), cat(line, more), cat(start, flat(table["done_start"])[0]), cat(end, flat(table["done_end"])[0]))


def _settle(length: int):
    def find(table: pa.Table) -> pa.Table:
        b, at = flat(table["b"])
        b4, line, start, last = (flat(table[c])[0] for c in ("b4", "line", "start", "last"))
        # the documents of a row are given once a line; lines rise within a row
        id_line, id_at = flat(table["ids_line"])
        ids = flat(table["ids"])[0]
        width = max(int(x.max()) + 1 if len(x) else 1 for x in (line, id_line))
        doc = ids[np.searchsorted(id_at * width + id_line, at * width + line)] if len(b) else np.zeros(0, np.int64)
        o, new, late = _later(doc, start, b, b4)
        gone = o[late]
        got = _done(table, at[gone], line[gone], start[gone], last[gone].astype(np.int64) + length)
        # buckets b that hold several strings b4: the first entry of each goes on, and those that tie with it
        begins = np.append(True, b[o][1:] != b[o][:-1]) if len(o) else new
        group = np.cumsum(begins) - 1
        several = np.bincount(group, weights=new, minlength=1)[group] > 1 if len(o) else new
        go = o[several & ~late]
        go = go[np.argsort(at[go], kind="stable")]
        n = len(table)
        return pa.table({"block": table["block"].combine_chunks(), **got, **{f"open_{k}": lists(v[go], at[go], n, pa.int32()) for k, v in (("line", line), ("start", start), ("end", last))}})

    return find


def _strings(length: int, gram: int, n: int):
    def make(row):
        line, start, last = (x.astype(np.int64) for x in answer_arrays(row["answers"], ["open_line", "open_start", "open_end"]))
        if not len(line):
            return
        table = load(row["payload"].as_py())
        ids = doc_ids(table)
        data, off = utf8(table["text"])
        o = np.lexsort((start, line))
        line, start, last = line[o], start[o], last[o]
        parts = []
        for a, z in slices(off, SLICE_BYTES):
            lo, hi = np.searchsorted(line, [a, z])
            if lo == hi:
                continue
            part, edge = data[off[a] : off[z]], off[a : z + 1] - off[a]
            count = last[lo:hi] - start[lo:hi] + 1
            of = np.repeat(np.arange(lo, hi), count)
            s = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            pos = s + edge[line[of] - a]
            parts.append((Buckets(part, length, gram).b3(pos), Buckets(part, length, gram, 1).b3(pos), line[of], s))
        h, h2, line, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        o, _, late = _later(ids[line], s, h, h2)
        gone = o[late]
        done = runs(line[gone], s[gone], s[gone] + length)
        o = o[~late]
        shard = shard_of(h2[o], n)
        by = np.lexsort((s[o], line[o], shard))
        o, shard = o[by], shard[by]
        own = np.zeros(len(done[0]), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, row["block"].as_py()), pa.int64()), lists(h[o].view(np.int64), shard, n, pa.int64()),
             lists(line[o], shard, n, pa.int32()), lists(s[o], shard, n, pa.int32()), lists(ids[line[o]], shard, n, pa.int64()), *[lists(x, own, n, pa.int32()) for x in done]],
            ["shard", "block", "hash", "line", "start", "doc", "done_line", "done_start", "done_end"],
        )

    return make


def _firsts(length: int):
    def find(table: pa.Table) -> pa.Table:
        h, at = flat(table["hash"])
        line, start, doc = (flat(table[c])[0] for c in ("line", "start", "doc"))
        o, _, late = _later(doc, start, h)
        gone = o[late]
        return pa.table({"block": table["block"].combine_chunks(), **_done(table, at[gone], line[gone], start[gone], start[gone].astype(np.int64) + length)})

    return find


def covered_bytes(blocks: DataFrame, shards: int, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Byte intervals covered by strings that occur earlier: rows of lists by block; they may overlap."""
    if not gram <= length <= gram * 8:
        raise ValueError("a gram is at most as long as the string, and at least an eighth")
    sent = each_block(blocks.select("block", "payload"), _entries(length, gram, shards), _ENTRIES)
    settled = cut(sent.where((F.size("b") > 0) | (F.size("done_line") > 0)).groupBy("shard").applyInArrow(_settle(length), f"{_SPAN}, {_OPEN}"))
    still = settled.where(F.size("open_line") > 0).select("block", "open_line", "open_start", "open_end")
    again = each_block(answered(blocks.select("block", "payload"), still), _strings(length, gram, shards), _STRINGS)
    last = again.where((F.size("hash") > 0) | (F.size("done_line") > 0)).groupBy("shard").applyInArrow(_firsts(length), _SPAN)
    return settled.select("block", "line", "start", "end").unionByName(last).where(F.size("line") > 0)


def without_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Documents less the bytes of ``length``-byte strings that start earlier in the corpus.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  Returns one
    row a document: doc_id, n_bytes, n_removed, spans (byte intervals taken out,
    maximal), kept (the bytes that remain, binary: a cut may split a character).

    *Earlier* is a smaller doc_id, or the same doc_id and an earlier byte; a null
    doc_id comes before all others.  Rows that share a doc_id hold the same
    places, so a repeated row takes nothing out of its twin.  A null text is
    empty.  An empty table gives an empty table.
    """
    blocks, shards = to_blocks(docs)
    spans = cut(covered_bytes(blocks, shards, length, gram))

    def make(row):
        table = load(row["payload"].as_py())
        line, start, end = (x.astype(np.int64) for x in answer_arrays(row["answers"], ["line", "start", "end"]))
        line, start, end = runs(line, start, end)
        edge = np.searchsorted(line, np.arange(len(table) + 1))
        out: list[tuple] = []
        for i, text in enumerate(table["text"].combine_chunks().cast(pa.large_binary()).fill_null(b"").to_pylist()):
            kept, took, at = [], [], 0
            for s, e in zip(start[edge[i] : edge[i + 1]].tolist(), end[edge[i] : edge[i + 1]].tolist(), strict=True):
                kept.append(text[at:s])
                took.append({"start": s, "end": e})
                at = e
            kept.append(text[at:])
            rest = b"".join(kept)
            out.append((len(text), len(text) - len(rest), took, rest))
        yield pa.RecordBatch.from_arrays(
            [table["doc_id"].combine_chunks(), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
             pa.array([x[2] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([x[3] for x in out], pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
        )

    return each_block(answered(blocks.select("block", "payload"), spans), make, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def byte_digests(docs: DataFrame) -> DataFrame:
    """Contract columns of :func:`without_repeated_bytes`."""
    return without_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
