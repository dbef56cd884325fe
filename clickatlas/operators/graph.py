"""Shortest and simple paths over many graphs at once.

Edges are ``(host, src, dst, edge_seq, ...)``; ``edge_seq`` is unique within a
host and gives the order in which a node's edges are tried.  A search is keyed
``(host, root)``, so one job answers every start on every host.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import urls
from ..functions.labels import label_of
from ..session import FEW_ROWS, bucketed, cut, cut_counted, few, work_dir
from .rows import first_by, ordinal, top_n
from .substring import containing

# Out-degree above which the edges of a node are spread over several tasks.
HOT_DEGREE = 1_000_000
# Edges per bucket when an edge table is large enough to be laid out by source.
BUCKET_ROWS = 4_000_000
# Levels between two anchors of a path.
SEGMENT = 16
# Rows of a level up to which the next two are done in one job.
TWO_STEPS = 250_000
# Rows of a level, paths and all, up to which it is broadcast to the edges.
FEW_NODES = 200_000

_NODE = ["host", "root", "node"]


class Laid(NamedTuple):
    """Edges written once for searches: by source, hubs dealt over salts; ``hot`` are the hubs with their number of salts."""

    edges: DataFrame
    hot: DataFrame | None
    bucketed: bool


def lay_out(edges: DataFrame, parallel: bool = False, hot_degree: int = HOT_DEGREE, bucket_rows: int = BUCKET_ROWS) -> Laid:
    """Write ``edges`` for any number of searches over them.

    Of parallel edges only the first can lie on a first-found shortest path, so the
    others are left out unless ``parallel``.  Beyond ``bucket_rows`` the edges lie in
    buckets of their source, so no level of a search shuffles them; the edges of a
    source with more than ``hot_degree`` are dealt over salts.
    """
    base = work_dir(edges.sparkSession)
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    e = e.select("host", "src", "dst", "edge_seq") if parallel else e.groupBy("host", "src", "dst").agg(F.min("edge_seq").alias("edge_seq"))
    e, n = cut_counted(e, f"{base}/edges")
    hot, keys = None, ["host", "src"]
    if n["rows"] > hot_degree:
        many = e.groupBy("host", "src").agg(F.count("*").alias("n")).where(F.col("n") > hot_degree)
        hot, hubs = cut_counted(many.select("host", "src", F.ceil(F.col("n") / hot_degree).cast("int").alias("salts")), f"{base}/hot")
        hot = hot if hubs["rows"] else None
    if hot is not None:
        e = e.join(hot, ["host", "src"], "left").withColumn("salt", F.pmod(F.xxhash64("dst", "edge_seq"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        keys.append("salt")
    if n["rows"] > bucket_rows:
        return Laid(bucketed(e, keys, n["rows"] // bucket_rows + 1, f"{base}/by_source"), hot, True)
    return Laid(e if hot is None else cut(e, f"{base}/salted"), hot, False)


def follow(frontier: DataFrame, laid: Laid) -> DataFrame:
    """``frontier`` (host, node, ...) joined with the edges that leave its nodes: adds dst and edge_seq."""
    on = [F.col("f.host") == F.col("e.host"), F.col("f.node") == F.col("e.src")]
    cols = frontier.columns
    if laid.hot is not None:
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
        frontier = frontier.join(laid.hot.withColumnRenamed("src", "node"), ["host", "node"], "left").withColumn("salt", salts)
        on.append(F.col("f.salt") == F.col("e.salt"))
    return frontier.alias("f").join(laid.edges.alias("e"), on).select(*[F.col(f"f.{c}") for c in cols], "e.dst", "e.edge_seq")


def expand_frontier(frontier: DataFrame, edges: DataFrame | Laid, *visited: DataFrame | None) -> DataFrame:
    """One search level: nodes newly reached from ``frontier``.

    ``frontier`` has (host, root, node, path) and may have ``rank`` and ``anchor``,
    which come before the path, or none of the three.  Among the edges that reach a node the smallest path
    of edge numbers is kept, which is the path a first-in first-out search finds.
    That choice is a ``min``, so it is combined map-side and a hub target costs one
    row per task.
    """
    laid = edges if isinstance(edges, Laid) else Laid(edges, None, False)
    step = follow(frontier, laid)
    order = [c for c in ("rank", "path", "anchor") if c in frontier.columns]
    key = F.struct(*[F.concat("path", F.array("edge_seq")).alias(c) if c == "path" else F.col(c) for c in order]) if order else F.lit(1)
    level = step.groupBy("host", "root", F.col("dst").alias("node")).agg(F.min(key).alias("k"))
    for seen in visited:
        level = level if seen is None else level.join(seen, _NODE, "left_anti")
    return level.select(*_NODE, *[F.col("k")[c].alias(c) for c in order])


class Reached(NamedTuple):
    """What a search found: (host, root, node, depth, anchor, rank, path), the last three only if it kept paths, and the greatest depth."""

    rows: DataFrame
    deepest: int
    segment: int


class _Levels:
    """The visited set of a search: each level is appended, none is written again.

    A large set lies in buckets of (host, root, node), as many as a shuffle has
    parts, so new nodes are held against it where they are: it is not shuffled.
    """

    def __init__(self, spark: SparkSession, shape, large: bool):
        self.spark, self.shape, self.path, self.upto = spark, shape, work_dir(spark), -1
        self.table = f"visited_{uuid.uuid4().hex}" if large else None
        self.files: list[str] = []

    def add(self, rows: DataFrame, upto: int, **sums) -> dict:
        """Append rows of depths above the last, up to ``upto``; returns their number and ``sums``."""
        obs = Observation()
        rows = rows.observe(obs, F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(k) for k, c in sums.items()]).select(*self.shape.fieldNames())
        if self.table:
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            w = rows.write.mode("append").option("path", self.path).partitionBy("depth").bucketBy(n, *_NODE)
            w.saveAsTable(self.table)
        else:
            self.files.append(f"{self.path}/{len(self.files)}")
            rows.write.mode("overwrite").parquet(self.files[-1])
        self.upto = upto
        return {k: v or 0 for k, v in obs.get.items()}

    def read(self) -> DataFrame:
        if self.table:
            return self.spark.table(self.table).select(*self.shape.fieldNames())
        return self.spark.read.schema(self.shape).parquet(*self.files).select(*self.shape.fieldNames())

    def last(self, depth: int) -> DataFrame:
        """The rows of the last written depth."""
        rows = self.read() if self.table else self.spark.read.schema(self.shape).parquet(self.files[-1])
        return rows.where(F.col("depth") == depth)

    def close(self) -> None:
        """Forget the table's name; its files are read as they are."""
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
            self.files, self.table = [self.path], None


def search(
    edges: DataFrame | Laid,
    sources: DataFrame,
    targets: DataFrame | None = None,
    max_depth: int | None = None,
    hot_degree: int = HOT_DEGREE,
    bucket_rows: int = BUCKET_ROWS,
    segment: int = SEGMENT,
    paths: bool = True,
) -> Reached:
    """Nodes reached from each source.

    ``path`` holds the edge numbers walked since ``anchor``, the node on the way
    whose depth is the last multiple of ``segment``; ``rank`` orders the anchors of a
    depth by their own paths.  So a row stays short however deep a search goes, and
    (rank, path) compares as whole paths would.  :func:`with_paths` puts paths
    together.

    Every level is appended to the visited set; what is new is held against it by
    key.  Once levels shrink two are done in one job.  The search ends when a level is
    empty, at ``max_depth``, or when every (host, root, node) of ``targets``
    has been reached.

    Without ``paths`` rows carry distances alone and no order is kept among nodes;
    :func:`shown_paths` finds the paths of those that are shown.  Targets are then
    ticked off only while they are few enough to be broadcast: else each level would
    be shuffled to meet them, and the search goes on to its end.
    """
    spark = edges.edges.sparkSession if isinstance(edges, Laid) else edges.sparkSession
    laid = edges if isinstance(edges, Laid) else lay_out(edges, False, hot_degree, bucket_rows)
    seq = laid.edges.schema["edge_seq"].dataType.simpleString()
    none = F.expr(f"cast(array() as array<{seq}>)")
    start = sources.select("host", "root").distinct().select(
        "host", "root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.col("root").alias("anchor"), F.lit(0).cast("bigint").alias("rank"), none.alias("path"))
    if not paths:
        start = start.drop("anchor", "rank", "path")
    levels = _Levels(spark, start.schema, laid.bucketed)
    wanted, missing = None, -1
    if targets is not None:
        wanted, seen = cut_counted(targets.select(*_NODE).distinct().withColumn("hit", F.lit(1)), work_dir(spark))
        missing = seen["rows"]
        if not paths and missing > FEW_ROWS:
            wanted, missing = None, -1

    def write(rows: DataFrame, depths: list[int]) -> list[int]:
        """Append the rows; the number of each depth's."""
        nonlocal missing, depth
        sums = {f"n{d}": (F.col("depth") == d).cast("int") for d in depths}
        if wanted is not None:
            rows = rows.join(wanted, _NODE, "left")
            sums |= {f"hit{d}": F.when(F.col("depth") == d, F.col("hit")) for d in depths}
        got = levels.add(rows, depths[-1], **sums)
        for d in depths:
            depth = d
            missing -= got.get(f"hit{d}", 0)
            # what lies behind the last target or an empty level is not asked for
            if not got[f"n{d}"] or missing == 0:
                break
        return [got[f"n{d}"] for d in depths]

    depth, counts, shrinks = 0, [], False
    counts = write(start, [0])
    while counts[depth - levels.upto - 1] and missing != 0 and depth != max_depth:
        front = levels.last(depth).drop("depth")
        if paths and depth and depth % segment == 0:
            # the level's nodes become anchors, in the order of their paths
            front = ordinal(front, ["host", "root"], ["rank", "path"], "place").select(*_NODE, F.col("node").alias("anchor"), F.col("place").cast("bigint").alias("rank"), none.alias("path"))
        seen = levels.read().select(*_NODE)
        # few nodes are sent to the edges, so those are read where they lie
        one = expand_frontier(F.broadcast(front) if counts[depth - levels.upto - 1] <= FEW_NODES else front, laid, seen)
        rows, depths = one.withColumn("depth", F.lit(depth + 1)), [depth + 1]
        if shrinks and counts[-1] <= TWO_STEPS and depth + 1 != max_depth and not (paths and (depth + 1) % segment == 0):
            two = expand_frontier(one, laid, seen, one.select(*_NODE))
            rows, depths = rows.unionByName(two.withColumn("depth", F.lit(depth + 2))), [depth + 1, depth + 2]
        last, counts = counts[-1], write(rows, depths)
        # levels that grow are done one by one: the second of two would be computed from all of the first
        shrinks = counts[-1] < (counts[-2] if len(counts) > 1 else last)
    levels.close()
    return Reached(levels.read().where(F.col("depth") <= depth), depth, segment)


def with_paths(found: DataFrame, reached: Reached, back: bool = False) -> DataFrame:
    """``found``, rows of ``reached`` with any other columns, with whole paths in place of anchor, rank and path.

    A path is put together from its end, a segment a step; only the rows asked for
    take part.  The paths of a search ``back`` lead to its root.
    """
    out = found.drop("rank")
    before = reached.rows.where((F.col("depth") > 0) & (F.col("depth") % reached.segment == 0)).select(
        "host", "root", F.col("node").alias("anchor"), F.col("anchor").alias("_anchor"), F.col("path").alias("_path"))
    for step in range(max(reached.deepest - 1, 0) // reached.segment):
        out = out.join(before, ["host", "root", "anchor"], "left")
        whole = F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat(*(("path", "_path") if back else ("_path", "path"))))
        out = out.withColumn("path", whole).withColumn("anchor", F.coalesce("_anchor", "anchor")).drop("_anchor", "_path")
        if step % 4 == 3:
            out = cut(out)
    return out.drop("anchor")


def shown_paths(edges: DataFrame, reached: Reached, shown: DataFrame) -> DataFrame:
    """(host, root, node, path) of the ``shown`` (host, root, node) that a search reached, which need not have kept paths.

    From the farthest level back, the edges that lead from the level before to what
    is shown, or to what leads there, are looked up; the smallest path of edge
    numbers is then found among those alone, level by level.  While they are few the
    edges and the levels are read where they lie.
    """
    spark = edges.sparkSession
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("host", "src", "dst", "edge_seq")
    found, base = reached.rows.select(*_NODE, "depth"), work_dir(spark)
    ends = cut(few(shown.select(*_NODE).distinct()).join(found, _NODE), f"{base}/ends")
    far = ends.agg(F.max("depth")).first()[0] or 0
    level, ways = ends.where(F.col("depth") == far).select(*_NODE), []
    for d in range(far, 0, -1):
        into = few(level).withColumnRenamed("node", "dst").join(e, ["host", "dst"])
        into = few(into.groupBy("host", "root", "src", "dst").agg(F.min("edge_seq").alias("edge_seq")))
        before = found.where(F.col("depth") == d - 1).select("host", "root", F.col("node").alias("src"))
        ways.append(cut(into.join(before, ["host", "root", "src"]), f"{base}/{d}"))
        level = ways[-1].select("host", "root", F.col("src").alias("node")).unionByName(ends.where(F.col("depth") == d - 1).select(*_NODE)).distinct()
    none = F.expr(f"cast(array() as array<{edges.schema['edge_seq'].dataType.simpleString()}>)")
    front = level.select(*_NODE, none.alias("path")) if far else ends.select(*_NODE, none.alias("path"))
    out = ends.where("depth = 0").select(*_NODE, none.alias("path"))
    for d, way in enumerate(reversed(ways), 1):
        step = front.withColumnRenamed("node", "src").join(way, ["host", "root", "src"])
        front = cut(step.groupBy("host", "root", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("edge_seq"))).alias("path")))
        out = out.unionByName(front.join(ends.where(F.col("depth") == d).select(*_NODE), _NODE, "left_semi"))
    return out


def bfs(
    edges: DataFrame | Laid,
    sources: DataFrame,
    targets: DataFrame | None = None,
    max_depth: int | None = None,
    hot_degree: int = HOT_DEGREE,
    bucket_rows: int = BUCKET_ROWS,
    segment: int = SEGMENT,
) -> DataFrame:
    """Fewest-edge paths from each source: (host, root, node, depth, path) of every node that :func:`search` reaches."""
    reached = search(edges, sources, targets, max_depth, hot_degree, bucket_rows, segment)
    return with_paths(reached.rows, reached).select(*_NODE, "depth", "path")


def path_steps(paths: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Each step of each path with the edge that makes it.

    ``paths`` has the ``keys`` (with ``host`` among them) and ``path``.
    """
    exploded = few(paths.select(*keys, F.posexplode("path").alias("step", "edge_seq")))
    return exploded.join(edges, ["host", "edge_seq"])


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """In, out and total degree; a self loop counts twice in the total."""
    ends = edges.select(
        "host",
        F.explode(
            F.array(
                F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ).alias("x"),
    ).select("host", "x.*")
    d = ends.groupBy("host", "id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    if nodes is not None:
        d = nodes.select("host", "id").distinct().join(d, ["host", "id"], "left").na.fill(0)
    return d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def node_size(degree) -> Column:
    """Drawing size of a node."""
    d = F.greatest(F.col(degree) if isinstance(degree, str) else degree, F.lit(1))
    return F.lit(16) + F.least(F.lit(34), F.sqrt(d) * 5)


def hub_targets(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets that most pages link to; ``pages`` is (host, pages)."""
    indeg = edges.groupBy("host", F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    limit = F.greatest(F.lit(float(K.HUB_FLOOR)), F.col("pages") * F.lit(K.HUB_SHARE))
    return indeg.join(pages.select("host", "pages"), "host").withColumn("is_hub", F.col("in_degree") >= limit)


def hub_edges(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges flagged ``glob`` where they lead to a hub.

    Hubs have a third or more of a host's links, so the flag joins on the few
    hub targets only; every other target has no partner and needs no shuffle of
    its own once the hub list is small enough to broadcast (Spark checks its
    size at run time).
    """
    hubs = hub_targets(edges, pages).where("is_hub").select("host", F.col("id").alias("dst"), F.lit(True).alias("glob"))
    return edges.join(hubs, ["host", "dst"], "left").withColumn("glob", F.coalesce("glob", F.lit(False)))


def structural(edges: DataFrame, pages: DataFrame) -> DataFrame:
    return hub_edges(edges, pages).where(~F.col("glob")).drop("glob")


class _Side:
    """One of two searches that meet, keyed (host, root, node): from the sources along the edges, or ``back`` from the targets against them.

    Rows are those of :func:`search`.  A way back begins with its newest edge, so it
    is compared by ``path`` first and then by the rank of its anchor.
    """

    def __init__(self, edges: DataFrame, starts: DataFrame, back: bool, segment: int):
        self.edges = edges.select("host", F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_seq") if back else edges
        self.back, self.segment, self.laid = back, segment, None
        self.order = ["path", "rank"] if back else ["rank", "path"]
        self.none = F.expr(f"cast(array() as array<{edges.schema['edge_seq'].dataType.simpleString()}>)")
        start = starts.select("host", "root").distinct().select(
            "host", "root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.col("root").alias("anchor"), F.lit(0).cast("bigint").alias("rank"), self.none.alias("path"))
        self.levels = _Levels(edges.sparkSession, start.schema, False)
        self.depth, self.count = 0, self.levels.add(start, 0)["rows"]
        self.total = self.count

    def last(self) -> DataFrame:
        """The rows of the last level, for a broadcast if they are few."""
        rows = self.levels.last(self.depth).drop("depth")
        return F.broadcast(rows) if self.count <= FEW_NODES else rows

    def advance(self, wanted: DataFrame) -> None:
        """The next level, of the roots in ``wanted`` alone."""
        front = self.levels.last(self.depth).drop("depth").join(wanted.select("host", "root").distinct(), ["host", "root"], "left_semi")
        if self.depth and self.depth % self.segment == 0:
            front = ordinal(front, ["host", "root"], self.order, "place").select(*_NODE, F.col("node").alias("anchor"), F.col("place").cast("bigint").alias("rank"), self.none.alias("path"))
        if self.count <= FEW_NODES:
            # the edges are read where they lie
            step = follow(F.broadcast(front), Laid(self.edges, None, False))
        else:
            self.laid = self.laid or lay_out(self.edges)
            step = follow(front, self.laid)
        if self.total > BUCKET_ROWS and not self.levels.table:
            large = _Levels(step.sparkSession, self.levels.shape, True)
            large.add(self.levels.read(), self.depth)
            self.levels = large
        path = F.concat(F.array("edge_seq"), "path") if self.back else F.concat("path", F.array("edge_seq"))
        key = F.struct(*[path.alias(c) if c == "path" else F.col(c) for c in [*self.order, "anchor"]])
        level = step.groupBy("host", "root", F.col("dst").alias("node")).agg(F.min(key).alias("k"))
        seen = self.levels.read().select(*_NODE)
        level = level.join(F.broadcast(seen) if self.total <= FEW_NODES else seen, _NODE, "left_anti")
        self.depth += 1
        self.count = self.levels.add(level.select(*_NODE, F.lit(self.depth).alias("depth"), *[F.col("k")[c].alias(c) for c in ("anchor", "rank", "path")]), self.depth)["rows"]
        self.total += self.count

    def whole(self, found: DataFrame) -> DataFrame:
        """``found`` (host, root, anchor, path, ...) with whole paths."""
        return with_paths(found.withColumn("rank", F.lit(0)), Reached(self.levels.read(), self.depth, self.segment), self.back)


def shortest_link_path(edges: DataFrame | Laid, pairs: DataFrame, max_depth: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """Shortest path per (host, src, dst); no row where there is none.

    Two searches advance in turns, one from the sources and one back from the
    targets, whichever has the smaller last level.  All paths of a pair's
    distance cross where its searches first meet, and the smallest is the
    smallest way there with the smallest way on.  A pair is left once it has met
    or one of its ends leads no further, so few pairs read little beside the edges.
    """
    pairs = cut(pairs)
    given = edges.edges if isinstance(edges, Laid) else edges
    e = given.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("host", "src", "dst", "edge_seq")
    e = e if isinstance(edges, Laid) else cut(e)
    open_, n = cut_counted(pairs.select("host", F.col("src").alias("root"), F.col("dst").alias("goal")).where("host is not null and src is not null and dst is not null").distinct(), work_dir(e.sparkSession))
    to_goal = lambda df: df.select("host", F.col("goal").alias("root"))
    ahead, back = _Side(e, open_, False, segment), _Side(e, to_goal(open_), True, segment)
    spark, shape, met_in = e.sparkSession, None, []
    while n["rows"]:
        there, on = ahead.last(), back.last().select("host", F.col("root").alias("goal"), "node", *[F.col(c).alias(f"b_{c}") for c in ("anchor", "rank", "path")])
        order = ["rank", "path", "b_path", "b_rank", "anchor", "b_anchor"]
        met = few(open_).join(there, ["host", "root"]).join(on, ["host", "goal", "node"])
        met = met.groupBy("host", "root", "goal").agg(F.min(F.struct(*order)).alias("k"))
        met = met.select("host", "root", "goal", F.lit(ahead.depth + back.depth).alias("clicks"), *[F.col("k")[c].alias(c) for c in ("path", "anchor", "b_path", "b_anchor")])
        met_in.append(work_dir(spark))
        met = cut(met, met_in[-1])
        shape = met.schema
        if ahead.depth + back.depth == max_depth:
            break
        # a pair lasts as long as both of its ends lead on
        open_ = open_.join(met, ["host", "root", "goal"], "left_anti").join(ahead.last().select("host", "root").distinct(), ["host", "root"], "left_semi")
        open_ = open_.join(back.last().select("host", F.col("root").alias("goal")).distinct(), ["host", "goal"], "left_semi")
        open_, n = cut_counted(open_.select("host", "root", "goal"), work_dir(spark))
        if n["rows"]:
            ahead.advance(open_) if ahead.count <= back.count else back.advance(to_goal(open_))
    ahead.levels.close()
    back.levels.close()
    if shape is None:
        return pairs.select("*", F.lit(0).alias("clicks"), ahead.none.alias("path")).where("false")
    found = spark.read.schema(shape).parquet(*met_in)
    first = ahead.whole(found)
    second = back.whole(first.select("host", F.col("goal").alias("root"), F.col("root").alias("src"), "clicks", F.col("path").alias("way"), F.col("b_path").alias("path"), F.col("b_anchor").alias("anchor")))
    out = second.select("host", "src", F.col("root").alias("dst"), "clicks", F.concat("way", "path").alias("path"))
    return pairs.join(out, ["host", "src", "dst"])


_PAIR = ["host", "src", "goal"]


def _first_walks(laid: Callable, remaining: DataFrame, pairs: DataFrame, count: int, max_len: int, max_paths: int, room: int) -> tuple[DataFrame, DataFrame]:
    """(finished walks, where a pair was cut) of one pass that holds ``room`` rows a pair and level.

    Walks of a pair are kept in walk order.  What comes after ``max_paths`` finished
    ones cannot enter the answer; what comes after ``room`` rows is left for a wider
    pass, and the place (its first path) is noted.  ``laid`` gives the edges for a
    number of walks, ``count`` is that of the pairs.
    """
    seq = laid(0).edges.schema["edge_seq"].dataType.simpleString()
    held = pairs.select(*_PAIR, F.col("src").alias("node"), F.array("src").alias("nodes"), F.expr(f"cast(array() as array<{seq}>)").alias("path"), F.lit(False).alias("finished"))
    w = Window.partitionBy(*_PAIR).orderBy(F.col("path").desc())
    cuts = []
    for n in range(1, max_len + 1):
        going = held.where(~F.col("finished")).drop("finished")
        grown = follow(F.broadcast(going) if count <= FEW_NODES else going, laid(count)).where(~F.array_contains("nodes", F.col("dst")))
        grown = grown.select(*_PAIR, F.col("dst").alias("node"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("path", F.array("edge_seq")).alias("path"))
        grown = grown.join(remaining, ["host", "goal", "node"]).where(F.col("left") <= max_len - n).withColumn("finished", F.col("node") == F.col("goal"))
        both = held.where("finished").unionByName(grown.drop("left")) if n > 1 else grown.drop("left")
        ranked = top_n(both, _PAIR, [F.col("path").desc()], room + 1, rank="place")
        before = F.coalesce(F.sum(F.col("finished").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = ranked.withColumn("before", before).where(F.col("before") < max_paths).drop("before")
        ranked, seen = cut_counted(ranked, work_dir(pairs.sparkSession), over=(F.col("place") > room).cast("int"), going=(~F.col("finished")).cast("int"))
        if seen["over"]:
            cuts.append(ranked.where(F.col("place") > room).select(*_PAIR, "path"))
        held = ranked.where(F.col("place") <= room).drop("place")
        count = seen["going"]
        if not count:
            break
    none = held.where("false").select(*_PAIR, "path")
    for c in cuts:
        none = none.unionByName(c)
    return held.where("finished").drop("finished", "node"), none.groupBy(*_PAIR).agg(F.max("path").alias("cut"))


def all_simple_paths(
    edges: DataFrame | Laid, pairs: DataFrame, max_len: int = K.MAX_PATH_LEN, max_paths: int = K.MAX_PATHS, room: int | None = None,
) -> DataFrame:
    """Simple paths per (host, src, dst), first ``max_paths`` in walk order.

    The walk takes the last edge first, so walk order is descending order of the
    edge numbers.  A reverse search from each target bounds every partial path:
    only nodes that can still reach the target in the hops left are expanded.

    Levels hold the first ``room`` partial walks of a pair (four times ``max_paths`` and
    500 at least, unless given) and no more, however many walks there are.  Partial walks that
    come to nothing may use the room up: pairs whose answer lies behind the place
    where they were cut go through another pass with eight times the room.
    """
    p = pairs.select("host", "src", F.col("dst").alias("goal")).where(F.col("src") != F.col("dst")).distinct()
    given = edges.edges if isinstance(edges, Laid) else edges
    narrow = given.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("host", "src", "dst", "edge_seq")
    plain = Laid(narrow if isinstance(edges, Laid) else cut(narrow), None, False)
    spread = [edges] if isinstance(edges, Laid) else []

    def laid(rows: int) -> Laid:
        # the edges are laid out only for walks that are too many to be broadcast
        if rows <= FEW_NODES:
            return plain
        if not spread:
            spread.append(lay_out(plain.edges, parallel=True))
        return spread[0]

    open_, n = cut_counted(p, work_dir(p.sparkSession))
    back = _Side(plain.edges, open_.select("host", F.col("goal").alias("root")), True, SEGMENT)
    goals = open_.select("host", F.col("goal").alias("root"))
    # a walk's first click is made from its source, which no bound is asked of
    while back.count and back.depth < max_len - 1:
        back.advance(goals)
    back.levels.close()
    remaining = back.levels.read().select("host", F.col("root").alias("goal"), "node", F.col("depth").alias("left"))
    remaining = F.broadcast(remaining) if back.total <= FEW_NODES else remaining
    room, answers = room or max(4 * max_paths, 500), None
    while n["rows"]:
        done, cuts = _first_walks(laid, remaining, open_, n["rows"], max_len, max_paths, room)
        ranked = top_n(done, _PAIR, [F.col("path").desc()], max_paths, rank="walk_rank").join(cuts, _PAIR, "left")
        ranked = cut(ranked)
        # walks before the cut are the first ones for certain
        sure = ranked.where(F.col("cut").isNull() | (F.col("path") > F.col("cut")))
        settled = sure.groupBy(*_PAIR).agg(F.count("*").alias("n")).where(F.col("n") >= max_paths).select(*_PAIR)
        left = cuts.select(*_PAIR).join(settled, _PAIR, "left_anti")
        open_, n = cut_counted(left, work_dir(p.sparkSession))
        got = ranked.drop("cut")
        got = got.join(open_, _PAIR, "left_anti") if n["rows"] else got
        answers = got if answers is None else answers.unionByName(got)
        room *= 8
    if answers is None:
        seq = given.schema["edge_seq"].dataType.simpleString()
        answers = p.select(*_PAIR, F.array("src").alias("nodes"), F.expr(f"cast(array() as array<{seq}>)").alias("path"), F.lit(1).alias("walk_rank"))
    return cap_paths(answers.select("host", "src", F.col("goal").alias("dst"), "nodes", "path", F.size("path").alias("clicks"), "walk_rank"))


def cap_paths(paths: DataFrame) -> DataFrame:
    """Order the kept paths by length, equal lengths in walk order."""
    return paths.orderBy("host", "src", "dst", "clicks", "walk_rank")


def start_state(states: DataFrame, starts: DataFrame | None = None, fallback: str = "root") -> DataFrame:
    """(host [, start], state_id) where a search begins.

    Without ``starts`` the first state of depth 0, else the first state.  With
    ``starts`` (host, start) the first state with that url, else the first with
    its path; where neither exists the root rule applies (``fallback="root"``),
    the first state is taken (``"first"``), or the row stays null (``"none"``).
    """
    seq = F.col("state_seq")
    root_rule = F.struct(F.when(F.col("depth") == 0, 0).otherwise(1), seq)
    roots = states.groupBy("host").agg(
        F.min_by("id", root_rule).alias("root_id"), F.min_by("id", seq).alias("first_id")
    )
    if starts is None:
        return roots.select("host", F.col("root_id").alias("state_id"))
    want = urls.norm_light("start")
    given = F.coalesce("start", F.lit("")) != ""
    asked = starts.select("host", "start").distinct()
    # the same url implies the same path, so one join on the path finds both kinds;
    # the few starts meet the states before anything is aggregated
    keyed = asked.where(given).select("host", "start", want.alias("k"), _path_key(want).alias("pk"))
    light = states.select("host", "state_seq", "id", urls.norm_light("url").alias("u")).withColumn("pk", _path_key(F.col("u")))
    rank = F.struct(F.when(F.col("u") == F.col("k"), 0).otherwise(1), F.col("state_seq"))
    found = keyed.join(light, ["host", "pk"]).groupBy("host", "start").agg(F.min_by("id", rank).alias("found_id"))
    out = asked.join(found, ["host", "start"], "left")
    out = out.join(roots, "host", "left")
    other = {"root": F.col("root_id"), "first": F.col("first_id"), "none": F.lit(None)}[fallback]
    state = F.when(F.coalesce("start", F.lit("")) == "", F.col("root_id")).otherwise(F.coalesce("found_id", other))
    return out.select("host", "start", state.alias("state_id"))


def _path_key(u: Column) -> Column:
    return urls.rtrim_slash(F.regexp_replace(urls.path(u), r";[^/]*$", ""))


def neighbourhood(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links-to and linked-from lists, one row per other end (the first edge wins)."""
    out = edges.select("host", F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("out").alias("direction"), "edge_seq", "kind")
    inc = edges.select("host", F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("in").alias("direction"), "edge_seq", "kind")
    first = first_by(out.unionByName(inc), ["host", "id", "direction", "other"], ["edge_seq"], ["edge_seq", "kind"])
    titles = nodes.select(
        "host", F.col("id").alias("other"), urls._col("url").alias("other_url"), F.col("title").alias("other_title")
    )
    return first.join(titles, ["host", "other"], "left")


def _named(nodes: DataFrame) -> DataFrame:
    """(host, id, node_seq, place, low_place, low_title, label) of nodes, as needles see them."""
    place = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("id"))
    return nodes.select("host", "id", "node_seq", place.alias("place"), F.lower(place).alias("low_place"), F.lower(F.coalesce("title", F.lit(""))).alias("low_title"),
                        label_of("url", "title", "id").alias("label"))


def resolve_nodes(needles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node for each (host, needle): exact id, else substring of url, id or title.

    More than one substring hit is settled by a unique url suffix, else the
    needle is ``ambiguous``.  Substrings are found by :func:`containing`, exact ids
    by an equi-join, and only the aggregate per needle leaves the joins.
    """
    asked = few(needles.select("host", "needle").distinct())
    named, low = _named(nodes), asked.withColumn("low", F.lower("needle"))
    hits = containing(low, named, "low", ["low_place", "low_title"]).join(low, ["host", "low"])
    suffix = urls.rtrim_slash(F.col("place")).endswith(urls.rtrim_slash(F.col("needle")))
    found = hits.select("host", "needle", "id", (F.col("id") == F.col("needle")).alias("exact"), F.lit(True).alias("hit"), suffix.alias("suffix"))
    # an id may be none of the texts that are searched
    no = F.lit(False)
    same = asked.join(nodes.select("host", "id").distinct().withColumn("needle", F.col("id")), ["host", "needle"]).select(
        "host", "needle", "id", F.lit(True).alias("exact"), no.alias("hit"), no.alias("suffix"))
    joined = found.unionByName(same)
    agg = joined.groupBy("host", "needle").agg(
        F.max(F.when(F.col("exact"), F.col("id"))).alias("exact_id"),
        F.count_if("hit").alias("hits"),
        F.max(F.when(F.col("hit"), F.col("id"))).alias("hit_id"),
        F.count_if("suffix").alias("suffixes"),
        F.max(F.when(F.col("suffix"), F.col("id"))).alias("suffix_id"),
    )
    out = asked.join(agg, ["host", "needle"], "left")
    node = (
        F.when(F.col("exact_id").isNotNull(), F.col("exact_id"))
        .when(F.col("hits") == 1, F.col("hit_id"))
        .when((F.col("hits") > 1) & (F.col("suffixes") == 1), F.col("suffix_id"))
    )
    status = (
        F.when(node.isNotNull(), "ok").when(F.coalesce("hits", F.lit(0)) == 0, "not_found").otherwise("ambiguous")
    )
    return out.select("host", "needle", node.alias("id"), status.alias("status"), F.coalesce("hits", F.lit(0)).alias("candidates"))


def resolver_candidates(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """Labels of the substring hits behind each ambiguous needle."""
    asked = few(resolved.where("status = 'ambiguous'").select("host", "needle").distinct()).withColumn("low", F.lower("needle"))
    hits = containing(asked, _named(nodes), "low", ["low_place", "low_title"])
    return hits.join(asked, ["host", "low"]).select("host", "needle", "node_seq", "label")
