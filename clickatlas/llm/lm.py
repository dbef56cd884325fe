"""Bigram language model by deleted interpolation.

``p(w | h) = l2[b] * c(h, w) / c(h) + l1[b] * c(w) / N + l0[b] / (V + 1)``

with ``b`` the bucket of the context's frequency, ``floor(log2(c(h)))``.  The
weights of each bucket are learned by expectation-maximisation on counts of a
deleted part of the training documents, against counts of the other part; the
final counts are those of both parts.  A text is its lower-cased words and one
end token, which is also the context of the first word.

Counting is spread over shards: each block sends its distinct tokens and pairs
with their counts, a shard adds them up over all blocks and answers each block
with the sums it asked for.  No vocabulary is ever held in one place.  Tokens are
told apart by 64 bits (and the bits that chose the shard), pairs by 40 bits and
the same: of the pairs of a shard, some in a million then share their counts with
another pair, at any size, as a shard holds so many and not more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import answered, doc_ids, each_block, flat, lists, load, shard_of, to_blocks
from .words import U64, Words, mix

#: Documents whose checksum modulo ``FOLDS`` is 0 are held out; those with 1 are the deleted part.
FOLDS = 10
RETAINED, DELETED, HELD_OUT = 0, 1, 2
#: Larger blocks hold a pair less often twice.
BLOCK_BYTES = 3 << 20
#: Ratios of probabilities are gathered for EM in steps of 1 / STEPS octave.
STEPS = 8
MAX_BUCKET = 40
ITERATIONS = 60
#: Each weight stays above this, so that every text has a probability.
LEAST = 1e-6

_END = mix(np.array([0x5EED], U64))[0]
_SENT = "shard int, block bigint, part int, word array<bigint>, word_n array<int>, low array<int>, high array<tinyint>, pair_n array<int>"
_SUMS = "block bigint, shard int, word_all array<bigint>, word_kept array<bigint>, pair_all array<int>, pair_kept array<int>, v bigint, n bigint, v_kept bigint, n_kept bigint"


class Tokens:
    """Token and pair identifiers of a block, with the order in which they are sent."""

    def __init__(self, table: pa.Table, n: int):
        w = Words(table["text"], lower=True)
        docs = len(w.count)
        self.count = w.count + 1
        first = np.zeros(docs + 1, np.int64)
        np.cumsum(self.count, out=first[1:])
        self.first, self.ids = first, doc_ids(table)
        token = np.full(int(first[-1]), _END, U64)
        token[np.arange(len(w.hash)) + w.row] = w.hash
        before = np.full(len(token), _END, U64)
        before[1:] = token[:-1]  # at the first word this is the end of the text before
        if docs:
            before[0] = _END
        self.word, at, self.word_n = np.unique(token, return_inverse=True, return_counts=True)
        ctx = np.searchsorted(self.word, before)
        pair, self.pair, self.pair_n = np.unique(mix(before * U64(0xA24BAED4963EE407) + token), return_inverse=True, return_counts=True)
        self.token, self.context, self.pair_id = at, np.minimum(ctx, max(len(self.word) - 1, 0)), pair
        # a block always holds the end token, so its count is known even where no other context is
        self.word_shard, self.pair_shard = shard_of(mix(self.word), n), shard_of(mix(pair), n)
        self.word_order = np.argsort(self.word_shard, kind="stable")
        self.pair_order = np.argsort(self.pair_shard, kind="stable")

    def per_word(self, sums: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.word), np.int64)
        out[self.word_order] = sums
        return out

    def per_pair(self, sums: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.pair_id), np.int64)
        out[self.pair_order] = sums
        return out


def _send(n: int):
    def make(row):
        t = Tokens(load(row["payload"].as_py()), n)
        w, p = t.word_order, t.pair_order
        ws, ps, pair = t.word_shard[w], t.pair_shard[p], t.pair_id[p]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, row["block"].as_py()), pa.int64()), pa.array(np.full(n, row["part"].as_py()), pa.int32()),
             lists(t.word[w].view(np.int64), ws, n, pa.int64()), lists(t.word_n[w], ws, n, pa.int32()),
             lists(pair.astype(np.uint32).view(np.int32), ps, n, pa.int32()), lists((pair >> U64(56)).astype(np.uint8).view(np.int8), ps, n, pa.int8()),
             lists(t.pair_n[p], ps, n, pa.int32())],
            ["shard", "block", "part", "word", "word_n", "low", "high", "pair_n"],
        )

    return make


def _added(key: np.ndarray, count: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: the sum over training parts and over the retained part of its key; and the sums by key."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
    o = np.argsort(key)
    key = key[o]
    new = np.append(True, key[1:] != key[:-1])
    first, group = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1
    del key, new
    count, part = count[o], part[o]
    sums = np.stack([np.add.reduceat(np.where(keep, count, 0), first, dtype=np.int64) for keep in (part != HELD_OUT, part == RETAINED)])
    out = []
    for s in sums:
        back = np.empty(len(o), np.int64)
        back[o] = s[group]
        out.append(back)
    return *out, sums


def _sum(table: pa.Table) -> pa.Table:
    n, part = len(table), table["part"].to_numpy()
    word, word_at = flat(table["word"])
    word_all, word_kept, sums = _added(word, flat(table["word_n"])[0], part[word_at])
    low, pair_at = flat(table["low"])
    pair = (flat(table["high"])[0].view(np.uint8).astype(U64) << U64(32)) | low.view(np.uint32).astype(U64)
    pair_all, pair_kept, _ = _added(pair, flat(table["pair_n"])[0], part[pair_at])
    # only the deleted part asks what the rest holds
    deleted = part == DELETED
    zero = np.zeros(n, np.int64)
    stats = [zero.copy() for _ in range(4)]
    if n:
        stats[0][0], stats[1][0] = np.count_nonzero(sums[0]), sums[0].sum()
        stats[2][0], stats[3][0] = np.count_nonzero(sums[1]), sums[1].sum()

    def some(values, at, keep, kind):
        keep = keep[at]
        return lists(values[keep], at[keep], n, kind)

    every = np.ones(n, bool)
    return pa.table({
        "block": table["block"].combine_chunks(), "shard": table["shard"].combine_chunks(),
        "word_all": some(word_all, word_at, every, pa.int64()), "word_kept": some(word_kept, word_at, deleted, pa.int64()),
        "pair_all": some(np.minimum(pair_all, 2**31 - 1), pair_at, every, pa.int32()), "pair_kept": some(np.minimum(pair_kept, 2**31 - 1), pair_at, deleted, pa.int32()),
        **dict(zip(("v", "n", "v_kept", "n_kept"), (pa.array(x, pa.int64()) for x in stats), strict=True)),
    })


def _answers(value, names: list[str]) -> list[np.ndarray]:
    """The named lists of a block's answers, in order of shards."""
    s = value.values
    fields, t = s.flatten(), s.type
    order = pa.array(np.argsort(fields[t.get_field_index("shard")].to_numpy(), kind="stable"))
    return [fields[t.get_field_index(x)].take(order).flatten().to_numpy(zero_copy_only=False) for x in names]


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, MAX_BUCKET), 0)


def _probabilities(t: Tokens, words: np.ndarray, pairs: np.ndarray, total: int, distinct: int):
    """(bucket, pair, token and uniform probability) of each token."""
    one, two = t.per_word(words), t.per_pair(pairs)
    ctx = one[t.context]
    p2 = np.divide(two[t.pair], ctx, out=np.zeros(len(ctx)), where=ctx > 0)
    p1 = one[t.token] / total if total else np.zeros(len(ctx))
    return _bucket(ctx), p2, p1, 1.0 / (distinct + 1)


def _cells(n: int, total: int, distinct: int):
    """Counts of (bucket, ratio of p2, ratio of p1) over the tokens of a deleted block; a ratio of -1 stands for none."""
    def make(row):
        t = Tokens(load(row["payload"].as_py()), n)
        words, pairs = _answers(row["answers"], ["word_kept", "pair_kept"])
        b, p2, p1, p0 = _probabilities(t, words, pairs, total, distinct)
        with np.errstate(divide="ignore"):
            # p1 and p2 are never below p0 / (corpus size): the shift keeps all steps positive
            q2, q1 = (np.where(p > 0, np.rint(np.log2(np.maximum(p, 1e-30) / p0) * STEPS) + 100 * STEPS, -1).astype(np.int64) for p in (p2, p1))
        cell, count = np.unique(np.stack([b, q2, q1]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cell), pa.array(count, pa.int64())], ["bucket", "q2", "q1", "n"])

    return make


def learn(cells: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Weights (l2, l1, l0) of every bucket by expectation-maximisation.

    ``cells`` has rows (bucket, q2, q1, n).  A bucket without counts keeps a
    uniform mix of the two lower orders.
    """
    ratio = lambda q: np.where(q >= 0, 2.0 ** (q / STEPS - 100), 0.0)
    out = np.tile([0.0, 0.5, 0.5], (MAX_BUCKET + 1, 1))
    for b in np.unique(cells[:, 0]) if len(cells) else []:
        mine = cells[cells[:, 0] == b]
        p = np.stack([ratio(mine[:, 1]), ratio(mine[:, 2]), np.ones(len(mine))], axis=1)
        weight = np.full(3, 1 / 3)
        for _ in range(iterations):
            part = p * weight
            part /= part.sum(axis=1, keepdims=True)
            weight = np.maximum((part * mine[:, 3:4]).sum(axis=0) / mine[:, 3].sum(), LEAST)
            weight /= weight.sum()
        out[int(b)] = weight
    out[:, 1:] = np.maximum(out[:, 1:], LEAST)
    return out / out.sum(axis=1, keepdims=True)


def scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """log10 probability of every document under a model of the training ones.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  Returns one
    row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-0.1 unigrams), score.

    A document is held out if crc32 of its id as text is a multiple of
    ``FOLDS``; a null id counts as empty text, so it is held out.  A null or empty
    text is the end token alone.  Without training documents both scores are
    those of tokens never seen: the base is 0.  Repeated rows count each time.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    part = F.when(fold == 0, HELD_OUT).when(fold == 1, DELETED).otherwise(RETAINED)
    blocks, shards = to_blocks(docs, part, block_bytes)
    shards *= 4  # tokens and pairs make more hashes than other operators send
    sums = cut(each_block(blocks.select("block", "part", "payload"), _send(shards), _SENT).groupBy("shard").applyInArrow(_sum, _SUMS))
    got = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v", "n", "v_kept", "n_kept")]).first()
    kept = ("word_kept", "pair_kept")
    cells = each_block(answered(blocks.where(F.col("part") == DELETED).select("block", "payload"), sums.where((F.size("word_kept") > 0) | (F.size("pair_kept") > 0)).select("block", "shard", *kept)),
                       _cells(shards, got["n_kept"], got["v_kept"]), "bucket bigint, q2 bigint, q1 bigint, n bigint")
    # bounded by the steps of a ratio of doubles, whatever the corpus
    table = cells.groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).toPandas().to_numpy()
    weights = learn(table)
    total, distinct = got["n"], got["v"]

    def make(row):
        table = load(row["payload"].as_py())
        t = Tokens(table, shards)
        words, pairs = _answers(row["answers"], ["word_all", "pair_all"])
        b, p2, p1, p0 = _probabilities(t, words, pairs, total, distinct)
        w = weights[b]
        seen = t.per_word(words)[t.token]
        logs = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
        base = np.log10((seen + 0.1) / (total + 0.1 * (distinct + 1)))
        add = lambda x: np.add.reduceat(x, t.first[:-1])
        n = len(t.count)
        yield pa.RecordBatch.from_arrays(
            [table["doc_id"].combine_chunks(), pa.array([row["part"].as_py() == HELD_OUT] * n, pa.bool_()), pa.array(t.count, pa.int64()),
             pa.array(add((seen > 0).astype(np.int64)), pa.int64()), pa.array(np.full(n, total), pa.int64()), pa.array(add(base), pa.float64()), pa.array(add(logs), pa.float64())],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    asked = answered(blocks.select("block", "part", "payload"), sums.select("block", "shard", "word_all", "pair_all"))
    return each_block(asked, make, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token of the held-out documents, by the model and by the base."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.where("held_out").agg(per("score").alias("model"), per("base_score").alias("base"))


__all__ = ["learn", "perplexity", "scores"]
