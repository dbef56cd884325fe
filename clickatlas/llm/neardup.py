"""Near-duplicate documents by bottom-k sketches.

One hash function orders the word shingles of every document; a document's sketch
is its ``SKETCH`` smallest values.

1. Documents with the same set of shingles are one class; only classes go on.
2. Inverted lists of the ``INDEX`` smallest values give pairs of classes.  Two sets
   of similarity 0.85 share none of 16 with probability 0.15 ** 16; below 0.8 there
   are more values to keep the odds.
3. A list longer than ``LIST`` gives no pairs.  Classes in such lists are listed
   again by each three consecutive values of their whole sketch (fewer at low
   similarities), which separates texts that merely share a passage.  Lists of those
   that are still long hold one large group of copies: each member is paired with
   the list's most typical one.  Sets that are no larger than a sketch may share no
   three: their long first lists are treated like these.
4. The sketch of the union estimates the similarity; a pair stays unless that is
   five standard deviations short.  Full sets decide.
5. Members of long lists that are not in the component of their typical member may
   still be linked with any other member.  For them, an exact filter on the full
   sets (rarest shingles first, and how much can still overlap behind them) finds
   every partner, whatever the length of the lists.
6. Links make components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_counted, work_dir
from .blocks import small_batches
from .graph import components
from .words import U64, Words, mix, rolling_words

SKETCH, INDEX, LIST = 64, 16, 32
#: Keys of documents whose texts are fetched are broadcast up to this many rows, about 50 MB; else they are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def _index(percent: int) -> int:
    """How many values are listed: sets of the similarity share none of them once in 1e11 pairs."""
    miss = 1 - percent / 100
    return INDEX if miss <= 0 else min(SKETCH, max(INDEX, math.ceil(math.log(1e-11) / math.log(miss))))


def _run(percent: int) -> int:
    """How many consecutive values are listed: at most three, and sketches of the similarity lack such a run once in 1e5 pairs."""
    p = percent / 100
    for run in (3, 2):
        # chances of ending in 0, 1 .. shared values without a run so far
        ends = [1.0] + [0.0] * (run - 1)
        for _ in range(SKETCH):
            ends = [(1 - p) * sum(ends), *(p * x for x in ends[:-1])]
        if sum(ends) <= 1e-5:
            return run
    return 1


def shingles(column, size: int) -> Iterator[np.ndarray]:
    """The set of distinct shingles of each text as sorted 63-bit hashes; fewer words than ``size`` are one shingle."""
    w = Words(column, lower=True)
    roll = rolling_words(w.hash)
    at = w.starts(size)
    h = roll.of(at, at + size) >> U64(1)
    edge = np.searchsorted(at, w.first)
    short = roll.of(w.first[:-1], w.first[1:])
    short = mix(short + w.count.astype(U64)) >> U64(1)
    for i in range(len(w.count)):
        yield np.unique(h[edge[i] : edge[i + 1]]).view(np.int64) if w.count[i] >= size else short[i : i + 1].view(np.int64) if w.count[i] else np.zeros(0, np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """One row a document: doc_id, text_key, n_shingles, node (identifier of its set; null if empty), sketch."""
    def make(batches):
        for batch in batches:
            n, node, sketch = [], [], []
            for s in shingles(batch.column("text"), size):
                n.append(len(s))
                u = s.view(U64)
                node.append(mix(u).sum(dtype=U64).tobytes() + mix(u ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).tobytes() + len(s).to_bytes(4, "big") if len(s) else None)
                sketch.append(s[:SKETCH])
            off = np.cumsum([0] + [len(s) for s in sketch]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(sketch) if sketch else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), values], ["doc_id", "text_key", "n_shingles", "node", "sketch"])

    return docs.mapInArrow(make, "doc_id bigint, text_key bigint, n_shingles bigint, node binary, sketch array<bigint>")


def _listed(entries: DataFrame, limit: int) -> DataFrame:
    """Entries (key, node) with the length ``n`` of their list; lists of one are left out."""
    n = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return entries.join(n, "key").withColumn("long", F.col("n") > limit)


def _pairs(short: DataFrame, percent: int) -> DataFrame:
    """Pairs of each list whose sizes allow the similarity; a list here is no longer than its limit."""
    near = lambda x: F.filter(F.col("rest"), lambda y: 100 * x["n_shingles"] >= percent * y["n_shingles"])
    lists = short.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("n_shingles", "node"))).alias("nodes")).where(F.size("nodes") > 1)
    # sizes rise within a list, so each entry is paired with later ones only
    each = lists.select("nodes", F.posexplode("nodes").alias("i", "x")).withColumn("rest", F.slice("nodes", F.col("i") + 2, F.size("nodes")))
    pairs = each.select("x", F.explode(near(F.col("x"))).alias("y"))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and union sketch allow the similarity."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    j = pairs.join(side("a"), "a").where("na is not null").join(side("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    j = j.withColumn("u", union).withColumn("both", F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u")))).withColumn("of", F.size("u"))
    p = percent / 100
    return j.where(F.col("both") >= p * F.col("of") - 5 * math.sqrt(p * (1 - p)) * F.sqrt("of")).select("a", "b")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Full sets of the classes in ``wanted`` (node, doc_id, text_key), read from one document of each."""
    keys, seen = cut_counted(wanted.withColumnsRenamed({"doc_id": "k_doc", "text_key": "k_text"}), work_dir(docs.sparkSession), n=F.lit(1))
    side = F.broadcast(keys) if seen["n"] <= BROADCAST_KEYS else keys
    texts = docs.join(side, (F.col("text_key") == F.col("k_text")) & F.col("doc_id").eqNullSafe(F.col("k_doc"))).groupBy("node").agg(F.min("text").alias("text"))

    def make(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in shingles(batch.column("text"), size)], pa.binary())], ["node", "tokens"])

    return cut(texts.mapInArrow(make, "node binary, tokens binary"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have the similarity."""
    def make(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    j = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return j.select("a", "b", "x", "y").mapInArrow(make, "a binary, b binary")


def _rest(long: DataFrame, hubs: DataFrame, sets: DataFrame, label: DataFrame, percent: int) -> DataFrame | None:
    """Pairs that star links may have missed; None if there can be none.

    Those are members of long lists that are in another component than the hub of
    a list of theirs.  Tokens are ordered by how many members have them; sets of
    the similarity share a token among the first ``n - ceil(percent * n) + 1`` of
    each, and behind their first shared token at most what is left of the shorter
    one.
    """
    at = lambda d, c, to: d.join(label.select(F.col("node").alias(c), F.col("label").alias(to)), c, "left").withColumn(to, F.coalesce(to, c))
    members = at(long.select("node").distinct(), "node", "label")
    hub = at(hubs.select("key", "hub"), "hub", "hub_label")
    apart = at(long, "node", "label").join(hub, "key").where("label <> hub_label").select("node").distinct()
    apart, seen = cut_counted(apart, work_dir(sets.sparkSession), n=F.lit(1))
    if not seen["n"]:
        return None

    def spell(batches):
        for batch in batches:
            tokens = [np.frombuffer(x, np.int64) for x in batch.column("tokens").to_pylist()]
            off = np.cumsum([0] + [len(t) for t in tokens]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("label"), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)))], ["node", "label", "tokens"])

    rows = sets.join(members, "node").select("node", "label", "tokens").mapInArrow(spell, "node binary, label binary, tokens array<bigint>")
    rows = cut(rows.select("node", "label", F.explode("tokens").alias("token")))
    df = rows.groupBy("token").agg(F.count("*").alias("df"))
    # one array of a set's tokens in order; the sets are those of single documents
    ordered = rows.join(df, "token").groupBy("node", "label").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).withColumn("size", F.size("t"))
    prefix = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    head = ordered.select("node", "label", "size", F.posexplode(F.slice("t", 1, prefix.cast("int"))).alias("place", "t")).where("t.df > 1")
    head = cut(head.select("node", "label", "size", "place", F.col("t.token").alias("token")))
    x = head.join(apart, "node", "left_semi")
    x, y = (d.select("token", *[F.col(c).alias(f"{p}_{c}") for c in ("node", "label", "size", "place")]) for p, d in (("x", x), ("y", head)))
    left = F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place"))
    fits = (100 + percent) * left >= percent * (F.col("x_size") + F.col("y_size"))
    sizes = 100 * F.least("x_size", "y_size") >= percent * F.greatest("x_size", "y_size")
    j = x.join(y, (x["token"] == y["token"]) & (F.col("x_label") != F.col("y_label")) & sizes & fits)
    return j.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def linked(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  Words are
    ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z; shingles have ``size`` words,
    and a text of fewer words is one shingle.  Returns one row a document: doc_id,
    text_key (a hash of the text), n_shingles, component (an identifier; null
    without shingles), component_id (smallest doc_id reachable, itself included).

    A null, empty or blank text has no shingles and no links.  A null doc_id is
    passed over when the smallest is chosen.  Repeated rows are copies of each
    other and share their answer.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    small_batches(docs.sparkSession)
    all_ = cut(sketches(rows, size))
    one = F.min(F.struct("doc_id", "text_key", "sketch", "n_shingles"))
    classes = cut(all_.where("node is not null").groupBy("node").agg(one.alias("r"), F.min("doc_id").alias("low")).select("node", "low", "r.*"))

    # no other set is similar to one that a single further shingle puts too far away
    index = classes.where(100 * F.col("n_shingles") >= percent * (F.col("n_shingles") + 1)).select("node", "n_shingles", F.explode(F.slice("sketch", 1, _index(percent))).alias("key"))
    first = cut(_listed(index, LIST))
    again = classes.join(first.where("long").select("node").distinct(), "node", "left_semi")
    n = _run(percent)
    runs = F.transform(F.sequence(F.lit(0), F.size("sketch") - n), lambda i: F.xxhash64(*[F.get("sketch", i + k) for k in range(n)]))
    second = cut(_listed(again.where(F.size("sketch") >= n).select("node", "n_shingles", F.explode(runs).alias("key")).distinct(), LIST))
    # sets of few shingles may have no run in common, so their long first lists count too
    few = first.where(F.col("long") & (F.col("n_shingles") <= SKETCH)).select("key", "node")
    long = second.where("long").select("key", "node").unionByName(few)
    # the typical member of a list is in most long lists: it has the fewest values of its own
    typical = long.groupBy("node").agg(F.count("*").alias("in"))
    hubs = cut(long.join(typical, "node").groupBy("key").agg(F.max(F.struct("in", "node")).alias("h")).select("key", F.col("h.node").alias("hub")))
    star = long.join(hubs, "key").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    pairs = _pairs(first.where("not long"), percent).unionByName(_pairs(second.where("not long"), percent)).unionByName(star).distinct()
    pairs = cut(_likely(pairs, classes, percent))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(long.select("node")).distinct()
    sets = _sets(rows, classes.select("node", "doc_id", "text_key").join(wanted, "node", "left_semi"), size)
    label = cut(components(_verified(pairs, sets, percent)))
    more = _rest(long, hubs, sets, label, percent)
    if more is not None:
        # links between components join whole components: only those are searched again
        ends = _verified(_likely(more, classes, percent), sets, percent)
        for end in "ab":
            to = label.select(F.col("node").alias(end), F.col("label").alias("to"))
            ends = ends.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        wider = components(ends).select(F.col("node").alias("label"), F.col("label").alias("wider"))
        alone = wider.join(label.select("label"), "label", "left_anti").select(F.col("label").alias("node"), F.col("wider").alias("label"))
        label = label.join(wider, "label", "left").select("node", F.coalesce("wider", "label").alias("label")).unionByName(alone)
        label = cut(label)
    named = classes.select("node", "low").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    answer = named.join(lowest, "label").select("node", "component_id", F.col("label").alias("component"))
    out = all_.join(answer, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", "component", own.alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """:func:`linked` as doc_id, n_shingles, component_id, kept (doc_id = component_id).

    A row without doc_id is kept if its whole component has none.
    """
    return linked(docs, size, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest doc_id (nulls last), then text hash.

    Documents without words are no copies of each other and all stay.  Of rows
    that repeat the chosen document, one stays.  Keeps all columns, whatever their
    names.
    """
    # other columns are set aside under names that nothing here uses
    names = docs.columns
    docs = docs.toDF(*[c if c in ("doc_id", "text") else f"_extra{i}" for i, c in enumerate(names)])
    found = cut(linked(docs, size, percent))
    # an order in which a missing id comes last
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    grouped = found.where("component is not null")
    chosen = grouped.groupBy("component").agg(F.min(rank).alias("best"))
    keys = grouped.select("component", rank.alias("rank")).join(chosen, "component")
    gone = keys.where("rank <> best").select(F.col("rank.doc_id").alias("gone_id"), F.col("rank.text_key").alias("gone_text")).distinct()
    gone, seen = cut_counted(gone, work_dir(docs.sparkSession), n=F.lit(1))
    twice = keys.where("rank = best").groupBy("component").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    text_key = F.xxhash64(F.col("text").cast("string"))
    side = F.broadcast(gone) if seen["n"] <= BROADCAST_KEYS else gone
    out = docs.join(side, (text_key == F.col("gone_text")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("gone_id")), "left_anti")
    if twice:
        # rows without words differ from each other by a number, so that none of them goes
        key = F.struct("doc_id", F.col("text"), F.when(has_words(F.col("text")), F.lit(None)).otherwise(F.monotonically_increasing_id()))
        out = out.withColumn("_same", key).dropDuplicates(["_same"]).drop("_same")
    return out.toDF(*names)


def has_words(text) -> F.Column:
    """Whether a text has a word."""
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
