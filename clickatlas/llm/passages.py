"""Repeated passages of words, found at the positions of a difference cover.

Every document is read at word positions whose number modulo ``PERIOD`` is in
``COVER``.  The cover holds every difference modulo the period, so for two equal
stretches that begin anywhere there is an offset below the period at which both
are at a cover position.  A window of ``window`` words therefore shares, with any
equal window, an anchor of ``window - PERIOD + 1`` words that both documents hash.

1. Each block sends the hashes of its anchors to shards; a shard answers with
   those that occur twice.  An anchor's hash only chooses where to look.
2. Windows around such anchors are extended to their full length and sent; a
   shard finds the first place of each and answers which ones are later.
3. Blocks take out the words that later windows cover.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import answer_arrays, answered, doc_ids, each_block, flat, lists, load, shard_of, to_blocks
from .words import U64, Words, rolling_words, runs

PERIOD, COVER = 13, (0, 1, 3, 9)
WINDOW = 20

_ANCHORS = "shard int, block bigint, hash array<int>"
_WINDOWS = "shard int, block bigint, hash array<bigint>, line array<int>, start array<int>, doc array<bigint>, done_line array<int>, done_start array<int>, done_end array<int>"
_SPANS = "block bigint, line array<int>, start array<int>, end array<int>"


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    size = window - PERIOD + 1
    at = w.starts(size)
    at = at[np.isin(w.position(at) % PERIOD, COVER)]
    return at, rolling_words(w.hash).of(at, at + size)


def _anchor_rows(window: int, n: int):
    def make(row):
        w = Words(load(row["payload"].as_py())["text"])
        _, h = _anchors(w, window)
        # twice at most: that tells a shard as much as any higher count
        h = np.sort(h)
        h = h[np.append(True, np.append(True, h[2:] != h[:-2])[: len(h) - 1])] if len(h) > 1 else h
        shard = shard_of(h, n)
        o = np.argsort(shard, kind="stable")
        found = lists(h[o].astype(np.uint32).view(np.int32), shard[o], n, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, row["block"].as_py()), pa.int64()), found], ["shard", "block", "hash"])

    return make


def _repeated(table: pa.Table) -> pa.Table:
    """The anchors of a shard that occur twice, for each block that has them."""
    h, at = flat(table["hash"])
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    keep = count[inverse] > 1
    found = lists(h[keep], at[keep], len(table), pa.int32())
    return pa.table({"block": table["block"].combine_chunks(), "shard": table["shard"].combine_chunks(), "hash": found})


def _later(doc: np.ndarray, start: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (hash, document, start); whether each comes after the first of its hash."""
    o = np.lexsort((start, doc, h))
    h, doc, start = h[o], doc[o], start[o]
    new = np.append(True, h[1:] != h[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return o, (doc > doc[first]) | (start > start[first])


def _window_rows(window: int, n: int):
    def make(row):
        table = load(row["payload"].as_py())
        w, ids = Words(table["text"]), doc_ids(table)
        at, h = _anchors(w, window)
        value = row["answers"]
        twice = np.zeros(0, U64)
        if value.is_valid and len(value.values):
            parts = value.values.flatten()
            t = value.values.type
            lists_, shards = parts[t.get_field_index("hash")], parts[t.get_field_index("shard")].to_numpy()
            got, of = flat(lists_)
            twice = (shards[of].astype(U64) << U64(32)) | got.view(np.uint32).astype(U64)
        mine = (shard_of(h, n).astype(U64) << U64(32)) | (h & U64(0xFFFFFFFF))
        flagged = np.zeros(len(w.hash) + 1, np.int64)
        flagged[at[np.isin(mine, twice)] + 1] = 1
        seen = np.cumsum(flagged)
        p = w.starts(window)
        p = p[seen[p + PERIOD] > seen[p]]  # anchors that lie inside the window begin within a period of its start
        hash_ = rolling_words(w.hash).of(p, p + window)
        line, start = w.row[p], w.position(p)
        o, late = _later(ids[line], start, hash_) if len(p) else (np.zeros(0, np.int64), np.zeros(0, bool))
        p, hash_, line, start = p[o], hash_[o], line[o], start[o]
        done = runs(line[late], start[late], start[late] + window)
        # rows that share a doc_id can both be first
        p, hash_, line, start = p[~late], hash_[~late], line[~late], start[~late]
        shard = shard_of(rolling_words(w.hash, 1).of(p, p + window), n)
        o = np.lexsort((start, line, shard))
        shard, hash_, line, start = shard[o], hash_[o], line[o], start[o]
        # what this block decided by itself travels with its first row
        done_at = np.zeros(len(done[0]), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, row["block"].as_py()), pa.int64()), lists(hash_.view(np.int64), shard, n, pa.int64()),
             lists(line, shard, n, pa.int32()), lists(start, shard, n, pa.int32()), lists(ids[line], shard, n, pa.int64()),
             *[lists(x, done_at, n, pa.int32()) for x in done]],
            ["shard", "block", "hash", "line", "start", "doc", "done_line", "done_start", "done_end"],
        )

    return make


def _spans(window: int):
    def find(table: pa.Table) -> pa.Table:
        """Intervals covered by windows of a shard that occur earlier, for each block."""
        h, at = flat(table["hash"])
        (line, _), (start, _), (doc, _) = flat(table["line"]), flat(table["start"]), flat(table["doc"])
        o, late = _later(doc, start, h) if len(h) else (np.zeros(0, np.int64), np.zeros(0, bool))
        o = o[late]
        done, done_at = flat(table["done_line"])
        line = np.concatenate([line[o], done]).astype(np.int64)
        begin = np.concatenate([start[o], flat(table["done_start"])[0]]).astype(np.int64)
        end = np.concatenate([start[o] + window, flat(table["done_end"])[0]]).astype(np.int64)
        at = np.concatenate([at[o], done_at])
        width = line.max() + 1 if len(line) else 1
        key, begin, end = runs(at * width + line, begin, end)
        at = key // width
        return pa.table({
            "block": table["block"].combine_chunks(), "line": lists(key % width, at, len(table), pa.int32()),
            "start": lists(begin, at, len(table), pa.int32()), "end": lists(end, at, len(table), pa.int32()),
        })

    return find


def repeated_spans(blocks: DataFrame, shards: int, window: int = WINDOW) -> DataFrame:
    """Word intervals covered by windows that occur earlier: one row of lists a block and shard.

    ``line`` is the row within the block.  Intervals of different shards may
    overlap.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window needs more than {PERIOD} words")
    sent = each_block(blocks.select("block", "payload"), _anchor_rows(window, shards), _ANCHORS)
    twice = sent.groupBy("shard").applyInArrow(_repeated, "block bigint, shard int, hash array<int>").where(F.size("hash") > 0)
    near = each_block(answered(blocks.select("block", "payload"), twice), _window_rows(window, shards), _WINDOWS)
    return near.where((F.size("hash") > 0) | (F.size("done_line") > 0)).groupBy("shard").applyInArrow(_spans(window), _SPANS).where(F.size("line") > 0)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents less the words of windows that start earlier in the corpus.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  Returns one
    row a document: doc_id, n_words, n_removed, kept (words joined by one space),
    spans (word intervals taken out).

    *Earlier* is a smaller doc_id, or the same doc_id and an earlier word; a null
    doc_id comes before all others.  Rows that share a doc_id hold the same
    places, so a repeated row takes nothing out of its twin.  A null or empty
    text has no words.  An empty table gives an empty table.
    """
    blocks, shards = to_blocks(docs)
    spans = cut(repeated_spans(blocks, shards, window))

    def make(row):
        table = load(row["payload"].as_py())
        line, start, end = (x.astype(np.int64) for x in answer_arrays(row["answers"], ["line", "start", "end"]))
        line, start, end = runs(line, start, end)
        edge = np.searchsorted(line, np.arange(len(table) + 1))
        out: list[tuple] = []
        for i, text in enumerate(table["text"].combine_chunks().cast(pa.large_binary()).fill_null(b"").to_pylist()):
            words, kept, took, at = text.split(), [], [], 0
            for s, e in zip(start[edge[i] : edge[i + 1]].tolist(), end[edge[i] : edge[i + 1]].tolist(), strict=True):
                kept += words[at:s]
                took.append({"start": s, "end": e})
                at = e
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode(), took))
        yield pa.RecordBatch.from_arrays(
            [table["doc_id"].combine_chunks(), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
             pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["doc_id", "n_words", "n_removed", "kept", "spans"],
        )

    return each_block(answered(blocks.select("block", "payload"), spans), make, "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,end:bigint>>")


def passage_digests(docs: DataFrame) -> DataFrame:
    """Contract columns of :func:`without_repeats`."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


__all__ = ["WINDOW", "passage_digests", "repeated_spans", "without_repeats"]
