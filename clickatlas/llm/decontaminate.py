"""Benchmark passages in documents, by suffix arrays over the documents.

Each Arrow batch of documents is a shard.  Its suffix array lists word positions
in the order of the ``window`` words that follow, and every suffix of the
benchmark is looked up in it by binary search.  Suffixes of documents that cannot
match (no benchmark suffix begins with their first words) are left out of the
array.  Neighbouring hits on one diagonal join into the longest verbatim matches.

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import small_batches
from .words import PLAIN, U64, Words, rolling_words

WINDOW = 13
#: Benchmark text held by every executor at once; a larger benchmark is read in several passes.
BENCHMARK_BYTES = 16 << 20
#: Words that a suffix must share with a benchmark suffix to enter the array.
HEAD = 3

_SPANS = "array<struct<item_id:string,item_start:int,start:int,length:int>>"


class Suffixes:
    """The benchmark's windows: the word hashes that each begins with, by length."""

    def __init__(self, item_ids: list, texts: list, window: int):
        w = Words(pa.array(texts, pa.string()), PLAIN, lower=True)
        self.ids = item_ids
        self.hash = w.hash
        self.by_size: list[tuple[int, np.ndarray, np.ndarray]] = []
        at = w.starts(window)
        whole = np.flatnonzero((w.count > 0) & (w.count < window))
        for size, start in [(window, at), *[(k, w.first[whole[w.count[whole] == k]]) for k in np.unique(w.count[whole]).tolist()]]:
            if len(start):
                self.by_size.append((size, start, w.row[start]))
        self.position = w.position(np.arange(len(w.hash)))


def _rows(hash_: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` words from each position as one sortable value."""
    words = hash_[at[:, None] + np.arange(size)].astype(">u8")
    # a byte string that ends in zeros would lose them
    return np.ascontiguousarray(words | U64(1)).view(f"S{8 * size}").ravel()


def _matches(w: Words, bench: Suffixes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(document words, benchmark words, items, size) where windows occur."""
    roll, other = rolling_words(w.hash), rolling_words(bench.hash)
    for size, start, item in bench.by_size:
        head = min(HEAD, size)
        at = w.starts(size)
        at = at[np.isin(roll.of(at, at + head), other.of(start, start + head))]
        if not len(at):
            continue
        suffix = _rows(w.hash, at, size)
        array = np.argsort(suffix, kind="stable")
        at, suffix = at[array], suffix[array]
        query = _rows(bench.hash, start, size)
        low, high = np.searchsorted(suffix, query, "left"), np.searchsorted(suffix, query, "right")
        found = high - low
        if not found.any():
            continue
        which = np.repeat(np.arange(len(query)), found)
        place = at[np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + low[which]]
        yield place, start[which], item[which], size


def _joined(w: Words, bench: Suffixes) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches: (document, item, item word, document word, length), in order of documents."""
    parts = []
    for place, at, item, size in _matches(w, bench):
        diagonal = place - at
        o = np.lexsort((place, diagonal, item, w.row[place]))
        place, at, item, diagonal = place[o], at[o], item[o], diagonal[o]
        row = w.row[place]
        new = np.ones(len(place), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        parts.append((row[first], item[first], bench.position[at[first]], w.position(place[first]), place[last] - place[first] + size))
    if not parts:
        return (np.zeros(0, np.int64),) * 5
    got = [np.concatenate(x) for x in zip(*parts, strict=True)]
    o = np.lexsort((got[3], got[1], got[0]))
    return tuple(x[o] for x in got)


def _scan(window: int, shared):
    cache: dict[int, Suffixes] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if 0 not in cache:
            cache[0] = Suffixes(*shared.value, window)
        bench = cache[0]
        for batch in batches:
            w = Words(batch.column("text"), PLAIN, lower=True)
            row, item, item_start, start, length = _joined(w, bench)
            off = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays(
                [pa.array([bench.ids[i] for i in item], pa.string()), pa.array(item_start, pa.int32()), pa.array(start, pa.int32()), pa.array(length, pa.int32())],
                ["item_id", "item_start", "start", "length"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w.count, pa.int64()), pa.ListArray.from_arrays(pa.array(off), spans)], [*batch.schema.names, "n_words", "spans"])

    return run


def verbatim(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, bound: int = BENCHMARK_BYTES) -> DataFrame:
    """``docs`` with n_words (int words of the rules below) and spans, the longest verbatim matches with items.

    A span is (item_id, item_start, start, length) in words.  Words are
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z; a match has
    ``window`` words at least, or is a whole item of fewer, but not none.

    Needs ``text`` in ``docs`` and ``item_id`` and ``text`` in ``benchmark``;
    columns of ``docs`` named n_words or spans are replaced.  Null texts have no
    words.  A null item_id is searched and named by an empty string.  Repeated
    items give repeated spans; repeated documents each have theirs.

    The benchmark is sent to the executors in passes of at most ``bound`` bytes
    (a longer item by itself).  Between passes the documents are written, so no
    executor holds two.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // bound))
    out = docs.drop("n_words", "spans").withColumn("spans_before", F.lit(None).cast(_SPANS))
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        # at most about ``bound`` bytes of the benchmark
        rows = part.collect()
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
        out = out.mapInArrow(_scan(window, shared), f"{fields}, n_words bigint, spans {_SPANS}")
        out = out.withColumn("spans", F.concat(F.coalesce("spans_before", F.array().cast(_SPANS)), "spans"))
        if k + 1 < passes:
            out = cut(out.drop("n_words", "spans_before").withColumnRenamed("spans", "spans_before"))
    return out.drop("spans_before")


def hit_words(spans) -> F.Column:
    """Words inside any of the spans, each once."""
    ends = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (s["start"] + s["length"]).alias("b"))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto"))
    add = lambda acc, s: F.struct((acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["upto"]), F.lit(0))).alias("n"), F.greatest(acc["upto"], s["b"]).alias("upto"))
    return F.aggregate(ends, start, add, lambda acc: acc["n"])


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """:func:`verbatim` with n_hit (words inside a match), items (distinct, sorted) and contaminated.

    A document is contaminated if a twentieth of its words or more are hit.
    """
    got = verbatim(docs, benchmark, window).withColumn("n_hit", hit_words(F.col("spans")))
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"])))
    return got.withColumn("items", items).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def hit_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contract columns of :func:`judge`."""
    got = judge(docs.select("doc_id", "text"), benchmark)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")

