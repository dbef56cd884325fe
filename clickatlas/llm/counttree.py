"""Documents of similar shingle sets, by an R-tree over count vectors.

A set's shingles are hashed into ``GROUPS`` groups; the counts of the groups are a
point.  Two sets share at most the sum of the smaller counts, and a box that holds
points shares at most the sum of the smaller of its upper corner and a point.

1. Documents of equal sets are one class, the points of the tree.
2. The tree's first level is made of cells, one for a shingle: a set of ``n`` goes
   into the cells of its first ``n - ceil(n * percent) + 1`` shingles in an order
   that is the same for all sets, so two sets of the similarity share one of theirs.
   (Without cells nothing would be pruned: counts of unrelated sets of a few hundred
   shingles are closer than the similarity allows.)  The order is by hash, but
   shingles found ``OFTEN`` times in a sample of texts come last; the sample decides
   only how large cells get.  Sizes and places in the order are compared in a cell.
3. Sets that lie in a cell of more than ``CROWD`` are dealt again, among themselves,
   by rarest shingle first; what two such sets share is looked for in these cells,
   everything else in the small ones.
4. In a cell that is still larger each point is first compared with the cell's most
   central one; verified links make components.  Cells of one centre are then one
   tree: pages of ``PAGE`` points, nodes of ``PAGE`` pages and so on, each with its
   upper corner and the most that a point of it can share with any other (shingles
   that nobody else has are known by now).  The tree is joined with itself from the
   root down, pairs of nodes at a time: a pair goes on if its boxes can share enough
   and do not lie in one component.
5. Pairs whose points can share enough are verified on their full sets.

Links inside a component are not looked for twice, so a group of copies of any size
costs about as much as its points; no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rows import ordinal
from ..session import cut, cut_counted, work_dir
from .blocks import small_batches
from .graph import components
from .words import U64, Words, mix, rolling_words

GROUPS, PAGE, CROWD = 64, 32, 64
#: One text in ``SAMPLE`` is looked through for frequent shingles; those found ``OFTEN`` times come last, ``HOT`` of them (8 MB) at most.
SAMPLE, OFTEN, HOT = 16, 3, 1 << 20
#: Keys of documents whose texts are fetched are broadcast up to this many rows, about 50 MB; else they are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def shingle_sets(column, size: int) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; fewer words than ``size`` are one shingle, none are none."""
    w = Words(column, lower=True)
    roll = rolling_words(w.hash)
    at = w.starts(size)
    h, edge = roll.of(at, at + size) >> U64(1), np.searchsorted(at, w.first)
    whole = mix(roll.of(w.first[:-1], w.first[1:]) ^ w.count.astype(U64)) >> U64(1)
    for i, n in enumerate(w.count):
        yield (np.unique(h[edge[i] : edge[i + 1]]) if n >= size else whole[i : i + 1] if n else h[:0]).view(np.int64)


def _least(n, percent: int):
    """How many shingles a set of ``n`` must share with any partner."""
    return -(-n * percent // 100)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    off = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _hot(rows: DataFrame, size: int) -> np.ndarray:
    """Frequent shingles of a sample of texts, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), _lists(list(shingle_sets(batch.column("text"), size)), pa.int64())], ["text_key", "tokens"])

    some = rows.where(F.pmod("text_key", F.lit(SAMPLE)) == 0).select("text_key", "text").mapInArrow(run, "text_key bigint, tokens array<bigint>")
    often = some.dropDuplicates(["text_key"]).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    return np.sort(often.orderBy(F.col("n").desc(), "token").limit(HOT).select("token").toArrow()["token"].to_numpy())


def _points(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """uid, doc_id, text_key, n, set (128 bits and the size; null if empty), head (leading shingles), counts."""
    shared = rows.sparkSession.sparkContext.broadcast(_hot(rows, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            n, name, head, counts = [], [], [], []
            for s in shingle_sets(batch.column("text"), size):
                u = s.view(U64)
                n.append(len(s))
                name.append(b"".join(mix(u ^ U64(salt)).sum(dtype=U64).tobytes() for salt in (0, 0x5851F42D4C957F2D)) + len(s).to_bytes(4, "big") if len(s) else None)
                counts.append(np.bincount((mix(u) % U64(GROUPS)).astype(np.int64), minlength=GROUPS))
                if len(hot) and len(s):
                    late = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
                    s = np.concatenate([s[~late], s[late]])
                head.append(s[: len(s) - _least(len(s), percent) + 1] if len(s) else s)
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["uid", "doc_id", "text_key"]).columns, pa.array(n, pa.int64()), pa.array(name, pa.binary()), _lists(head, pa.int64()), _lists(counts, pa.int32())],
                ["uid", "doc_id", "text_key", "n", "set", "head", "counts"])

    # numbers are fixed once written
    numbered = rows.withColumn("uid", F.monotonically_increasing_id())
    return cut(numbered.mapInArrow(run, "uid bigint, doc_id bigint, text_key bigint, n bigint, set binary, head array<bigint>, counts array<int>"))


def _few(df: DataFrame) -> DataFrame:
    """``df`` written, and broadcast where its rows are counted to be few."""
    out, seen = cut_counted(df, work_dir(df.sparkSession))
    return F.broadcast(out) if seen["rows"] <= BROADCAST_KEYS else out


def _sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, tokens) of the classes in ``wanted`` (node, doc_id, text_key); rows that repeat a document repeat its set."""
    keys = _few(wanted.select("node", F.col("doc_id").alias("k_doc"), F.col("text_key").alias("k_text")))
    texts = rows.join(keys, (F.col("text_key") == F.col("k_text")) & F.col("doc_id").eqNullSafe(F.col("k_doc"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(list(shingle_sets(batch.column("text"), size)), pa.int64())], ["node", "tokens"])

    return cut(texts.mapInArrow(run, "node bigint, tokens array<bigint>"))


def _enough(shared: Column, x: Column, y: Column, percent: int) -> Column:
    """Whether sets of sizes ``x`` and ``y`` that share ``shared`` have the similarity."""
    return (100 + percent) * shared >= percent * (x + y)


def _cells(entries: DataFrame) -> DataFrame:
    """Entries (cell, node, n, place) with ``members`` of their cell; cells of one are left out."""
    members = entries.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1")
    return entries.join(members, "cell")


def _side(d: DataFrame, p: str, *cols: str) -> DataFrame:
    return d.select("cell", *[F.col(c).alias(f"{p}_{c}") for c in cols])


def _near(small: DataFrame, percent: int) -> DataFrame:
    """Pairs within cells of a page or less whose sizes and places allow the similarity."""
    x, y = (_side(small, p, "node", "n", "place") for p in "xy")
    left = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    j = x.join(y, "cell").where((F.col("x_node") < F.col("y_node")) & _enough(left, F.col("x_n"), F.col("y_n"), percent))
    return j.where(100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")).select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()


def _shared(x: str, y: str) -> Column:
    """Sum of the smaller coordinates."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.least(p, q)), F.lit(0), lambda s, c: s + c)


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose points allow the similarity."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("counts").alias(f"c{c}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    return j.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).where(_enough(_shared("ca", "cb"), F.col("na"), F.col("nb"), percent)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                s, t = x[i].values.to_numpy(), y[i].values.to_numpy()
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(s) + len(t) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    j = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return j.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _again(sets: DataFrame, percent: int) -> DataFrame:
    """Entries of the sets by rarest shingle first; a shingle that only one of them has takes no cell but its place."""
    rows = sets.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("cell")).distinct()
    df = rows.groupBy("cell").agg(F.count("*").alias("df")).where("df > 1")
    # the shingles that others have too, in order: one array a set
    known = rows.join(df, "cell").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "cell"))).alias("t"))
    alone = F.col("n") - F.size("t")
    head = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    out = known.where(head > 0).select("node", F.col("n").cast("bigint").alias("n"), alone.alias("alone"), F.posexplode(F.slice("t", 1, head.cast("int"))).alias("i", "t"))
    return out.select(F.col("t.cell").alias("cell"), "node", "n", (F.col("i") + F.col("alone")).alias("place"), (F.col("n") - F.col("alone")).alias("room"))


def _at(d: DataFrame, label: DataFrame, c: str = "node", out: str = "label") -> DataFrame:
    """``d`` with the component of ``c``; a node without links is its own."""
    return d.join(label.select(F.col("node").alias(c), F.col("label").alias(out)), c, "left").withColumn(out, F.coalesce(out, c))


_BOX = ("n_low", "n_high", "l_low", "l_high", "room", "corner")


def _tree(points: DataFrame) -> list[DataFrame]:
    """Levels of the trees of all cells, points first: cell, id, parent and the box of each node.

    ``points`` is (cell, node, n, room, label, counts).  Points are in order of
    component, share of what others have too, and size, so pages hold what belongs
    together.
    """
    flat = ordinal(points.withColumn("share", F.floor(100 * F.col("room") / F.col("n"))), ["cell"], ["label", "share", "n", "node"], "rn")
    level = flat.select("cell", F.col("node").alias("id"), F.floor((F.col("rn") - 1) / PAGE).alias("parent"), F.col("n").alias("n_low"), F.col("n").alias("n_high"),
                        F.col("label").alias("l_low"), F.col("label").alias("l_high"), "room", F.col("counts").alias("corner"))
    levels = []
    while True:
        path = work_dir(points.sparkSession)
        level, seen = cut_counted(level, path, wide=(F.col("parent") > 0).cast("int"))
        levels.append(level)
        corner = F.array(*[F.max(F.get("corner", F.lit(i))) for i in range(GROUPS)])
        up = level.groupBy("cell", F.col("parent").alias("id")).agg(
            F.min("n_low").alias("n_low"), F.max("n_high").alias("n_high"), F.min("l_low").alias("l_low"), F.max("l_high").alias("l_high"), F.max("room").alias("room"), corner.alias("corner"))
        level = up.select("cell", "id", F.floor(F.col("id") / PAGE).alias("parent"), *_BOX)
        if not seen["wide"]:
            levels.append(cut(level))
            return levels


def _descend(levels: list[DataFrame], percent: int) -> DataFrame:
    """Pairs of points of different components whose boxes allow the similarity, all the way down."""
    now = levels[-1].select("cell", F.col("id").alias("x"), F.col("id").alias("y"))
    for level in reversed(levels[:-1]):
        child = lambda p: _side(level, p, "id", "parent", *_BOX)  # noqa: B023, E731
        j = now.join(child("p").withColumnRenamed("p_parent", "x"), ["cell", "x"]).join(child("q").withColumnRenamed("q_parent", "y"), ["cell", "y"])
        # below a node paired with itself each pair of children is met once
        j = j.where((F.col("x") < F.col("y")) | (F.col("p_id") <= F.col("q_id")))
        j = j.where(~((F.col("p_l_low") == F.col("p_l_high")) & (F.col("p_l_low") == F.col("q_l_low")) & (F.col("q_l_low") == F.col("q_l_high"))))
        # sizes that overlap, or the nearest sizes of the two
        near = (100 * F.col("p_n_high") >= percent * F.col("q_n_low")) & (100 * F.col("q_n_high") >= percent * F.col("p_n_low"))
        room = F.least("p_room", "q_room")
        near = near & _enough(room, F.col("p_n_low"), F.col("q_n_low"), percent)
        now = cut(j.where(near).where(_enough(_shared("p_corner", "q_corner"), F.col("p_n_low"), F.col("q_n_low"), percent)).select("cell", F.col("p_id").alias("x"), F.col("q_id").alias("y")))
    return now.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def linked(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  Words are
    ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z.  A document's set are its distinct
    shingles of ``size`` words, or the whole text as one if it has fewer.  Documents
    link when 100 times what their sets share is ``percent`` times their union or
    more; component_id is the smallest doc_id that links lead to, itself included.

    A null, empty or blank text has an empty set and no links.  A null doc_id is
    passed over when the smallest is chosen.  Repeated rows are copies of each other.
    Shingles and sets are compared by 63 and 128 bits of hash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    points = _points(rows, size, percent)
    keyed = points.where("set is not null").groupBy("set", "n").agg(
        F.min("uid").alias("node"), F.min("doc_id").alias("low"), F.min_by(F.struct("doc_id", "text_key", "counts"), "uid").alias("r"))
    classes = cut(keyed.select("node", "set", "n", "low", "r.*"))

    # a set to which one more shingle is already too far has no partner
    alone = 100 * F.col("n") < percent * (F.col("n") + 1)
    heads = points.join(_few(classes.where(~alone).select(F.col("node").alias("uid"))), "uid", "left_semi")
    first = cut(_cells(heads.select(F.col("uid").alias("node"), "n", F.posexplode("head").alias("place", "cell"))))
    large = F.col("members") > CROWD
    crowded = _few(first.where(large).select("node").distinct())
    pairs = _near(first.where(~large), percent)
    crowded_sets = _sets(rows, classes.select("node", "doc_id", "text_key").join(crowded, "node", "left_semi"), size)
    second = cut(_cells(_again(crowded_sets, percent)))
    pairs = pairs.unionByName(_near(second.where(~large), percent))
    trees = second.where(large).select("cell", "node", "n", "room")
    # the most central point lies in most trees
    often = trees.groupBy("node").agg(F.count("*").alias("often"))
    centre = trees.join(often, "node").groupBy("cell").agg(F.max_by("node", F.struct("often", "node")).alias("centre"))
    # a pair that shares a cell shares its centre, so one tree a centre does
    trees = cut(trees.join(centre, "cell").select(F.col("centre").alias("cell"), "node", "n", "room").distinct())
    star = trees.where("node <> cell").select(F.least("node", "cell").alias("a"), F.greatest("node", "cell").alias("b"))
    pairs = cut(_bounded(pairs.unionByName(star).distinct(), classes, percent))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(crowded, "node", "left_anti")
    sets = crowded_sets.unionByName(_sets(rows, classes.select("node", "doc_id", "text_key").join(ends, "node", "left_semi"), size))
    label = cut(components(_verified(pairs, sets, percent)))

    # trees that lie in one component are done
    labelled = cut(_at(trees, label))
    mixed = labelled.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("cell")
    rest = labelled.join(mixed, "cell", "left_semi").join(classes.select("node", "counts"), "node")
    rest, seen = cut_counted(rest, work_dir(spark))
    if seen["rows"]:
        found = _verified(_descend(_tree(rest), percent), sets, percent)
        for end in "ab":
            found = _at(found, label, end, "to").drop(end).withColumnRenamed("to", end)
        wider = components(found).select(F.col("node").alias("label"), F.col("label").alias("wider"))
        alone = wider.join(label.select("label"), "label", "left_anti").select(F.col("label").alias("node"), F.col("wider").alias("label"))
        label = cut(label.join(wider, "label", "left").select("node", F.coalesce("wider", "label").alias("label")).unionByName(alone))

    named = _at(classes.select("set", "low", "node"), label)
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    out = points.join(named.join(lowest, "label").select("set", "component_id"), "set", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
