"""The best documents for every item, by a dual-tree search.

Items and documents are vectors over the items' terms: a term's weight in an item,
its impact in a document; a score is their product.  Both sides are hierarchies
whose nodes hold coordinate maxima: items in groups of ``GROUP``, nodes of ``NODE``
and single; documents in batches of ``GROUP``, nodes of ``NODE`` and single,
neighbours sharing their commonest and weightiest terms.  The product of two nodes'
maxima bounds every score between them, so a pair of nodes below the weakest kth
score of its items is left with all that is under it.  What remains is scored.

1. Documents become rows of term numbers and counts of the items' terms, a row an
   Arrow batch; counts over all documents give the weights.
2. A few files of rows are searched first: their kth scores are lower bounds that every task
   starts with.
3. Every task searches its rows, raising its own kth scores, and hands out ``k``
   rows an item at most; a window takes the best of all.

All scores are whole numbers, and ties at the kth score are never pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .blocks import small_batches
from .words import PLAIN, Words

K = 50
GROUP, NODE = 256, 4
#: Item text that every executor holds at once; more items are searched in several passes.
ITEM_BYTES = 4 << 20
#: Files of rows whose scores give the first lower bounds; a file is what one task wrote.
SEED_FILES = 4

_BLOCKS = "doc_id array<bigint>, n array<bigint>, first array<int>, term array<int>, tf array<bigint>, docs bigint, words bigint, df_term array<int>, df array<bigint>"


def _term_rows(vocabulary):
    """Arrow batches of documents as one row each: per document its length, and its terms in ``vocabulary`` with counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        for batch in batches:
            if not batch.num_rows:
                continue
            w = Words(batch.column("text"), PLAIN, lower=True)
            at = np.minimum(np.searchsorted(vocab, w.hash), len(vocab) - 1)
            known = np.flatnonzero(vocab[at] == w.hash)
            key, tf = np.unique(w.row[known] * len(vocab) + at[known], return_counts=True)
            row, term = key // len(vocab), key % len(vocab)
            df = np.bincount(term, minlength=len(vocab))
            some = np.flatnonzero(df)
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([
                one(batch.column("doc_id"), pa.int64()), one(w.count, pa.int64()), one(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32()), one(term, pa.int32()), one(tf, pa.int64()),
                pa.array([np.count_nonzero(w.count)], pa.int64()), pa.array([len(w.hash)], pa.int64()), one(some, pa.int32()), one(df[some], pa.int64())], [c.split()[0] for c in _BLOCKS.split(", ")])

    return run


def _order(first: np.ndarray, term: np.ndarray, weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Rows sorted by their commonest term, then by the term of most value; rows without terms come last."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    common, top = np.full(n, 1 << 40), np.full(n, 1 << 40)
    for out, by in ((common, weight), (top, -value)):
        o = np.lexsort((term, by, row))
        lead = o[np.flatnonzero(np.diff(row[o], prepend=-1))]
        out[row[lead]] = term[lead]
    return np.lexsort((top, common))


class Items:
    """Items as vectors, sorted so that neighbours are alike."""

    def __init__(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.weight = weight
        self.number = _order(first, term, weight[term], weight[term])
        self.terms = [term[first[i] : first[i + 1]] for i in self.number]
        # whole numbers below 2**53 add up exactly as doubles, whatever the order
        most = max((int(weight[t].sum()) for t in self.terms), default=0)
        self.kind = np.float64 if most * 1_000_000 < 1 << 53 else np.int64

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions, their terms in order, weights as a matrix) of each group."""
        for a in range(0, len(self.terms), GROUP):
            members = self.terms[a : a + GROUP]
            terms = np.unique(np.concatenate(members)) if members else np.zeros(0, np.int64)
            m = np.zeros((len(members), len(terms)), self.kind)
            for i, t in enumerate(members):
                m[i, np.searchsorted(terms, t)] = self.weight[t]
            yield np.arange(a, a + len(members)), terms, m


def _maxima(m: np.ndarray) -> np.ndarray:
    """Coordinate maxima of each ``NODE`` rows."""
    return np.maximum.reduceat(m, np.arange(0, len(m), NODE), axis=0)


def node_pairs(weights: np.ndarray, impacts: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(items, documents, scores) of what the bounds leave of a group of items and a batch of documents.

    ``least`` is each item's kth score so far.  A pair is left out only if a bound
    over it is smaller.
    """
    used = np.flatnonzero(impacts.any(0))
    weights, impacts = weights[:, used], impacts[:, used]
    if not len(used) or weights.max(0) @ impacts.max(0) < least.min():
        return
    up, down = _maxima(weights), _maxima(impacts)
    weakest = np.minimum.reduceat(least, np.arange(0, len(least), NODE))
    near = up @ down.T >= weakest[:, None]
    items = np.flatnonzero(np.repeat(near.any(1), NODE)[: len(weights)])
    if not len(items):
        return
    bound = weights[items] @ down.T
    near = near[items // NODE] & (bound > 0) & (bound >= least[items][:, None])
    for d in np.flatnonzero(near.any(0)):
        mine = items[near[:, d]]
        docs = np.arange(d * NODE, min(len(impacts), (d + 1) * NODE))
        some = np.flatnonzero(down[d])
        yield mine, docs, weights[np.ix_(mine, some)] @ impacts[np.ix_(docs, some)].T


class Best:
    """The ``k`` best documents of each item so far: smallest (-score, missing id, id)."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.kept = [np.zeros(0, np.int64) for _ in range(4)]
        self.new: list[list[np.ndarray]] = []

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        self.new.append([item, score, doc, none])

    def settle(self) -> None:
        """Keep the best and raise the kth scores."""
        if not self.new:
            return
        item, score, doc, none = (np.concatenate([x, *y]) for x, y in zip(self.kept, zip(*self.new, strict=True), strict=True))
        self.new = []
        o = np.lexsort((doc, none, -score, item))
        item, score, doc, none = item[o], score[o], doc[o], none[o]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        full = place == self.k - 1
        self.least[item[full]] = np.maximum(self.least[item[full]], score[full])
        self.kept = [x[place < self.k] for x in (item, score, doc, none)]


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, n_docs, n_words, least = shared.value
        groups = list(items.groups())
        best = Best(k, least)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n, first, term, tf = (batch.column(c)[i].values for c in ("doc_id", "n", "first", "term", "tf"))
                none = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = ids.fill_null(0).to_numpy()
                n, first, term, tf = (x.to_numpy() for x in (n, first, term, tf))
                size = 50 + (50 * n * n_docs) // max(n_words, 1)
                row = np.repeat(np.arange(len(ids)), np.diff(first))
                impact = (1_000_000_000 * tf) // (1000 * tf + 20 * size[row])
                order = _order(first, term, items.weight[term], items.weight[term] * impact)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                spot = place[row]
                for a in range(0, len(ids), GROUP):
                    mine = np.flatnonzero((spot >= a) & (spot < a + GROUP))
                    who = order[a : a + GROUP]
                    for at, terms, weights in groups:
                        column = np.minimum(np.searchsorted(terms, term[mine]), max(len(terms) - 1, 0))
                        here = np.flatnonzero(terms[column] == term[mine]) if len(terms) else column[:0]
                        if not len(here):
                            continue
                        m = np.zeros((len(who), len(terms)), items.kind)
                        m[spot[mine[here]] - a, column[here]] = impact[mine[here]]
                        for x, y, score in node_pairs(weights, m, best.least[at]):
                            keep = (score > 0) & (score >= best.least[at][x][:, None])
                            p, q = np.nonzero(keep)
                            doc = who[y[q]]
                            best.add(at[x[p]], score[keep].astype(np.int64), ids[doc], none[doc])
                    best.settle()
        item, score, doc, none = best.kept
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(items.number[item], pa.int64()), pa.array(doc, pa.int64(), mask=none == 1), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return run


def _one_pass(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """(item, doc_id, score) of the best of every task, item being a place in ``rows``."""
    spark = docs.sparkSession
    w = Words(pa.array([t or "" for _, t in rows], pa.string()), PLAIN, lower=True)
    vocab = np.unique(w.hash)
    own = [np.unique(np.searchsorted(vocab, w.hash[w.first[i] : w.first[i + 1]])) for i in range(len(rows))]
    if not len(vocab):
        return spark.createDataFrame([], "item bigint, doc_id bigint, score bigint")
    blocks = cut(docs.mapInArrow(_term_rows(spark.sparkContext.broadcast(vocab)), _BLOCKS))
    n_docs, n_words = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    df = np.zeros(len(vocab), np.int64)
    # a row a term of the items at most
    for t, n in blocks.select(F.explode(F.arrays_zip("df_term", "df")).alias("x")).groupBy("x.df_term").agg(F.sum("x.df")).collect():
        df[t] = n
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    items = Items(np.cumsum([0] + [len(t) for t in own]), np.concatenate(own), weight)
    cols = ["doc_id", "n", "first", "term", "tf"]

    def found(part: DataFrame, least: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((items, int(n_docs), int(n_words), least))
        return part.select(*cols).mapInArrow(_search(shared, k), "item bigint, doc_id bigint, score bigint")

    least = np.zeros(len(rows), np.int64)
    place = np.empty(len(rows), np.int64)
    place[items.number] = np.arange(len(rows))
    seed = spark.read.schema(blocks.schema).parquet(*sorted(blocks.inputFiles())[:SEED_FILES])
    for i, score in _first(found(seed, least), k).where(F.col("rank") == k).select("item", "score").collect():
        least[place[i]] = score
    return found(blocks, least)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each item with their ``rank``; Spark prunes to ``k`` an item before the shuffle."""
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = K, bound: int = ITEM_BYTES) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: item_id, rank, doc_id, score.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are
    ignored.  Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` after
    A-Z became a-z.  With N documents that have a term, L terms in all, n in a
    document, df documents with a term and tf of it in one, a term weighs
    floor(1000 ln((2N + 2) / (2 df + 1))) and adds weight * (1e9 tf div (1000 tf +
    20 (50 + 50 n N div L))), once an item.

    Equal scores go by ascending doc_id, a missing one last; rows that share a
    doc_id are ranked each.  Null and empty texts have no terms.  Every row of
    ``items`` is an item; rows of the same id and text are one.

    Items go to the executors in passes of at most ``bound`` bytes of text (a longer
    item by itself), and each pass reads the documents again.  Terms are compared by
    64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // bound))
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for p in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p)
        # at most about ``bound`` bytes of items
        rows = [tuple(r) for r in part.collect()]
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item bigint, item_id {kind}")
        got = _first(_one_pass(texts, rows, k), k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = got if out is None else out.unionByName(got)
    return out
