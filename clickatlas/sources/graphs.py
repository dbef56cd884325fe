"""Reading and writing stored graphs."""

from __future__ import annotations

import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from itertools import islice, pairwise
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as X
from ..functions import labels
from ..session import at_once, cut
from . import manifest
from .documents import assemble, elements, in_order, move_files, of_documents, summaries, write_files

#: Hosts up to which a task writes its rows where they are, a file for each of its hosts.
FEW_HOSTS = 64
#: Files that are renamed at the same time.
_MOVERS = 32


class Graphs(NamedTuple):
    """Interaction graphs of many hosts, one table per element kind."""

    states: DataFrame
    edges: DataFrame
    triggers: DataFrame
    meta: DataFrame
    errors: DataFrame


class LinkGraphs(NamedTuple):
    """Link graphs of many hosts."""

    nodes: DataFrame
    edges: DataFrame
    meta: DataFrame
    errors: DataFrame


def _documents(spark: SparkSession, path: str) -> DataFrame:
    # One whole document per file, read by its lines; the host is the file's base name.
    # In-flight '*.json.tmp' files do not match the glob.
    return spark.read.option("pathGlobFilter", "*.json").text(path).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("host"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("piece"),
        F.col("value").alias("document"),
    )


def split_corrupt(docs: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Documents that answer, and one error row for each that cannot."""
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    errors = docs.where(F.col("bad") | missing).select(
        "host",
        F.lit("error").alias("status"),
        F.when(F.col("bad"), F.lit("unreadable document")).otherwise(F.lit("missing " + " or ".join(required))).alias("error"),
    )
    return docs.where(~(F.col("bad") | missing)), errors


def explode_interaction(rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Elements of documents to states, edges, triggers and meta; list order becomes a sequence column."""
    states = of_documents(rows, "states", "state_seq", docs).select(
        "host", "state_seq", "e.id", "e.url", "e.label", "e.depth", "e.controls", "e.collections",
    )
    edges = of_documents(rows, "edges", "edge_seq", docs).select(
        "host", "edge_seq", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.label", "e.selector", "e.kind",
    )
    triggers = of_documents(rows, "triggers", "trig_seq", docs).select(
        "host", "trig_seq", "e.label", F.col("e.state").alias("state_id"),
        "e.path", "e.form", F.col("e.opensAt").alias("opens_at"),
        F.coalesce(F.nullif(F.col("e.kind"), F.lit("")), F.lit("form")).alias("kind"),
        "e.selector", "e.href", "e.accept", F.try_to_timestamp("e.cachedAt").alias("cached_at"),
        F.col("e.cacheSource").alias("cache_source"),
        F.coalesce(F.col("e.staleWarning"), F.lit(False)).alias("stale"),
    )
    meta = docs.select(
        "host", _kind().alias("graph_kind"), "meta.start", "meta.pages", "meta.complete", "meta.stopped",
        F.try_to_timestamp("meta.lastLiveUpdate").alias("last_live_update"),
        F.coalesce(F.col("meta.liveHits"), F.lit(0)).alias("live_hits"),
    )
    return states, edges, triggers, meta


def _kind() -> Column:
    return (
        F.when(F.col("states").isNotNull() | F.col("triggers").isNotNull(), "interaction")
        .when(F.col("nodes").isNotNull(), "link")
        .otherwise("unknown")
    )


def summarize_documents(spark: SparkSession, path: str) -> DataFrame:
    """Kind and element counts of every stored document, whatever its kind."""
    docs = summaries(elements(_documents(spark, path), X.INTERACTION_DOC))

    def n(c):
        return F.when(F.col("bad"), 0).otherwise(F.coalesce(c, F.lit(0))).cast("bigint").alias(c)

    return docs.select("host", F.when(F.col("bad"), "error").otherwise(_kind()).alias("graph_kind"), n("states"), n("edges"), n("triggers"), n("nodes"))


def graphs_from_documents(docs: DataFrame) -> Graphs:
    """The same from a table (host, document) of JSON texts, or (host, piece, document) of their pieces."""
    rows = elements(docs, X.INTERACTION_DOC)
    good, errors = split_corrupt(cut(summaries(rows)), ["states"])
    return Graphs(*explode_interaction(rows, good), errors)


def read_graphs(spark: SparkSession, path: str) -> Graphs:
    return graphs_from_documents(_documents(spark, path))


def read_link_graphs(spark: SparkSession, path: str) -> LinkGraphs:
    rows = elements(_documents(spark, path), X.LINK_DOC)
    good, errors = split_corrupt(cut(summaries(rows)), ["nodes"])
    nodes = of_documents(rows, "nodes", "node_seq", good).select(
        "host", "node_seq", "e.id", "e.url", "e.title", "e.type", "e.reason",
        "e.accept", F.col("e.dlHref").alias("dl_href"), F.col("e.dlKind").alias("dl_kind"), "e.selector", "e.error",
    )
    edges = of_documents(rows, "edges", "edge_seq", good).select(
        "host", "edge_seq", F.col("e.source").alias("src"),
        F.col("e.target").alias("dst"), "e.label", F.coalesce("e.kind", F.lit("link")).alias("kind"),
        F.coalesce("e.skipped", F.lit(False)).alias("skipped"),
    )
    meta = good.select("host", "meta.start", F.coalesce("meta.pages", "nodes").cast("bigint").alias("pages"))
    return LinkGraphs(nodes, edges, meta, errors)


_TABLES = {"states": X.STATES, "edges": X.EDGES, "triggers": X.TRIGGERS, "meta": X.META}
#: A host's rows lie in the folders of ``version``.  A row without host and version notes the last ``tag`` of a stream.
_POINTER = X.struct(host=X.S, version=X.S, tag=X.S)


class StaleGraphs(RuntimeError):
    """A host was replaced by another writer since it was read."""


def current_versions(spark: SparkSession, path: str) -> DataFrame:
    """(host, version) of every stored host."""
    now, _ = manifest.newest(spark, path, _POINTER)
    return (spark.createDataFrame([], _POINTER) if now is None else now).where("version IS NOT NULL").select("host", "version")


def applied(spark: SparkSession, path: str, tag: str) -> bool:
    """Whether the write ``tag``, ``<stream>-<number>``, is in force or was replaced since."""
    now, _ = manifest.newest(spark, path, _POINTER)
    return now is not None and now.where(F.col("version").isNull() & (F.col("tag") == tag)).limit(1).count() > 0


def read_tables(spark: SparkSession, path: str, versions: DataFrame | None = None) -> Graphs:
    """The columnar layout of :func:`write_graphs`, as its manifest (or ``versions``, one read before) has it.

    Version and host are folders; the join with the manifest prunes those that are
    not in force.
    """
    now = current_versions(spark, path) if versions is None else versions

    def table(name, schema):
        if not manifest.exists(spark, f"{path}/{name}"):
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(X.StructType([*schema.fields, X.StructField("version", X.S)])).parquet(f"{path}/{name}")
        return rows.join(now, ["host", "version"], "left_semi").select(*schema.names)

    errors = spark.createDataFrame([], X.struct(host=X.S, status=X.S, error=X.S))
    return Graphs(*(table(n, _TABLES[n]) for n in ("states", "edges", "triggers", "meta")), errors)


def stage_graphs(graphs: Graphs, path: str, rows_per_file: int = 1_000_000) -> DataFrame | None:
    """Write the tables into folders of this call alone, which no reader sees; their (host, version), None without rows.

    The rows of many hosts meet in one file a host until it holds ``rows_per_file``;
    those of few are not shuffled for that.
    """
    spark = graphs.meta.sparkSession
    folder, mine = uuid.uuid4().hex, None
    few = graphs.meta.select("host").distinct().limit(FEW_HOSTS + 1).count() <= FEW_HOSTS

    def write(name: str) -> None:
        df = getattr(graphs, name)
        rows = df.withColumn("version", F.lit(folder))
        if not few:
            # ranges of (host, sequence): a host of any size is spread over as many writers as it needs
            rows = rows.repartitionByRange("host", *[c for c in df.columns if c.endswith("_seq")])
        rows.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("version", "host").parquet(f"{path}/{name}")

    at_once(*[partial(write, name) for name in _TABLES])
    for name in _TABLES:
        # the folders name the hosts
        place = f"{path}/{name}/version={folder}"
        if manifest.exists(spark, place):
            found = spark.read.schema("host string").option("basePath", place).parquet(place).select("host")
            mine = found if mine is None else mine.unionByName(found)
    return None if mine is None else mine.distinct().withColumn("version", F.lit(folder))


def write_graphs(graphs: Graphs, path: str, rows_per_file: int = 1_000_000, version: str | None = None, read: DataFrame | None = None) -> None:
    """Replace the graphs of the hosts present, as a whole, and of no other host.

    The tables are written next to the old ones, in folders of this try alone; then
    a manifest (host, folder) is put in force.  A reader sees all tables of a host
    before or after it, never between, and a table without a row for a host is empty
    for it.  The tables may be made from what is stored at ``path``.  A try that
    dies leaves nothing that a reader sees, so it can simply be run again; writers
    of different hosts both come into force.

    ``version``, ``<stream>-<number>``, is noted as the stream's last write, for
    :func:`applied`.  With ``read``, the versions that the tables were made from,
    :class:`StaleGraphs` is raised if another writer replaced one of the hosts
    meanwhile; without it the last writer of a host wins.
    """
    spark = graphs.meta.sparkSession
    mine = stage_graphs(graphs, path, rows_per_file)
    if mine is None:
        return
    none = F.lit(None).cast("string")
    mine = mine.withColumn("tag", none)
    note = spark.createDataFrame([(None, None, version)] if version else [], _POINTER)
    stream = (version or "").rpartition("-")[0]

    def replace(now: DataFrame | None) -> DataFrame:
        if read is not None:
            then = read.select("host", F.col("version").alias("then"))
            held = (spark.createDataFrame([], _POINTER) if now is None else now).where("version IS NOT NULL").select("host", "version")
            moved = mine.select("host").join(held, "host", "left").join(then, "host", "left").where(~F.col("version").eqNullSafe(F.col("then")))
            if moved.limit(1).count():
                raise StaleGraphs(f"hosts of {path} were replaced by another writer")
        if now is None:
            return mine.unionByName(note)
        other = F.col("version").isNotNull() | (F.regexp_replace("tag", "-[^-]*$", "") != stream)
        return now.where(other).join(mine.select("host"), "host", "left_anti").unionByName(mine).unionByName(note)

    manifest.commit(spark, path, _POINTER, replace)


def drop_old_versions(spark: SparkSession, path: str) -> None:
    """Delete tables that no host points at any more, and old manifests; for a time without readers or writers.

    The driver sees version names only, as many as there were writes since the
    last call.
    """
    now, _ = manifest.newest(spark, path, _POINTER)
    if now is None:
        return
    used = {r[0] for r in now.select("version").where("version IS NOT NULL").distinct().collect()}
    for name in _TABLES:
        fs, p = manifest.file_system(spark, f"{path}/{name}")
        for f in fs.listStatus(p) if fs.exists(p) else ():
            folder = f.getPath().getName()
            if folder.startswith("version=") and folder.removeprefix("version=") not in used:
                fs.delete(f.getPath(), True)
    manifest.forget(spark, path, 1)


def _elements_of(df: DataFrame, part: int, seq: str, body: Column) -> DataFrame:
    return df.select("host", F.lit(part).alias("part"), F.col(seq).cast("bigint").alias("seq"), F.to_json(body).alias("text"))


def _documents_of(meta: DataFrame, rows: DataFrame, names: list[str], empty: bool) -> DataFrame:
    """Documents (host, piece, document) of the elements ``rows`` of the parts ``names``; a part without elements is left out unless ``empty``.

    ``meta`` is (host, meta); the documents are those of its hosts and of the hosts of ``rows``.
    """
    pieces = assemble(rows)
    none = lambda t: F.lit(None).cast(t)
    every = meta.select("host", "meta", none("int").alias("part")).unionByName(pieces.select("host", none("string").alias("meta"), "part").distinct())
    there = lambda i: F.max(F.col("part") == i)
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(n).alias("name"), F.coalesce(there(i), F.lit(False)).alias("there")) for i, n in enumerate(names)])
    doc = every.groupBy("host").agg(F.any_value("meta", True).alias("meta"), parts.alias("parts"))
    doc = doc.withColumn("parts", F.filter("parts", lambda x: F.lit(empty) | x["there"]))
    head = F.concat(F.lit("{"), F.coalesce(F.concat(F.lit('"meta":'), "meta"), F.lit("")))
    opened = F.transform("parts", lambda x, i: F.struct(x["part"].alias("part"), F.concat(
        F.when(i == 0, head).otherwise("]"), F.when((i > 0) | F.col("meta").isNotNull(), ",").otherwise(""), F.lit('"'), x["name"], F.lit('":[')).alias("document")))
    closed = F.struct(F.lit(len(names)).alias("part"), F.when(F.size("parts") == 0, F.concat(head, F.lit("}"))).otherwise("]}").alias("document"))
    heads = doc.select("host", F.explode(F.concat(opened, F.array(closed))).alias("x")).select("host", "x.*")
    # what stands before the elements of a part comes before its pieces
    piece = lambda n: F.struct("part", F.coalesce(n, F.lit(-1)).cast("bigint").alias("n")).alias("piece")
    return pieces.select("host", piece(F.col("n")), "document").unionByName(heads.select("host", piece(F.lit(-1)), "document"))


def to_documents(graphs: Graphs) -> DataFrame:
    """One JSON document per host, lists in sequence order, with all that the tables hold, as rows (host, piece, document).

    The text of a document is that of its pieces in order, so a host of any size is
    spread over many rows (:mod:`.documents`).
    """
    def stamp(c):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")

    c = F.col
    states = _elements_of(graphs.states, 0, "state_seq", F.struct("id", "url", "label", "depth", "controls", "collections"))
    edges = _elements_of(graphs.edges, 1, "edge_seq", F.struct(c("src").alias("from"), c("dst").alias("to"), "label", "selector", "kind"))
    triggers = _elements_of(graphs.triggers, 2, "trig_seq", F.struct(
        "label", c("state_id").alias("state"), "path", "form", c("opens_at").alias("opensAt"),
        "kind", "selector", "href", "accept", stamp("cached_at").alias("cachedAt"),
        c("cache_source").alias("cacheSource"), c("stale").alias("staleWarning")))
    meta = graphs.meta.select("host", F.to_json(F.struct(
        "host", "start", "pages", "complete", "stopped", stamp("last_live_update").alias("lastLiveUpdate"), c("live_hits").alias("liveHits"))).alias("meta"))
    return _documents_of(meta, states.unionByName(edges).unionByName(triggers), ["states", "edges", "triggers"], True)


def write_documents(docs: DataFrame, path: str, key: str = "host") -> None:
    """Write (host, document), or its pieces, as one file ``<host>.json`` a document, which replaces an older one.

    Files are written elsewhere and moved, so a reader never meets half of one.
    Hosts should be valid names; a host of several files is refused.  A piece ends with
    the end of a line.
    """
    spark = docs.sparkSession
    staged = f"{path}/.{uuid.uuid4().hex}"
    # a name that is never null keeps the order of the pieces through the writer
    name = F.coalesce(F.col(key), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("name")
    docs = docs.select(name, "document", *[c for c in docs.columns if c == "piece"])
    fs, p = manifest.file_system(spark, staged)
    try:
        if fs.getUri().getScheme() != "file":
            return _write_elsewhere(docs, path, staged)
        fs.mkdirs(p)
        folder = fs.makeQualified(p).toUri().getPath()
        # tasks write and rename their files themselves, without a folder, a listing or a driver's call a file
        files = cut(write_files(docs, folder), f"{staged}/files")
        twice = files.groupBy("name").count().where("count > 1").first()
        if twice:
            raise ValueError(f"several documents of {twice['name']}")
        move_files(files, os.path.dirname(folder))
    finally:
        fs.delete(p, True)


def _write_elsewhere(docs: DataFrame, path: str, staged: str) -> None:
    """The same on file systems that only Spark can write to: its writer, and renames by the driver."""
    spark = docs.sparkSession
    # tasks commit their own files: the driver would move them one after the other
    in_order(docs).select("name", "document").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("name").text(staged)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(staged)
    found = found.select(F.regexp_extract("path", "/name=([^/]*)/[^/]*$", 1).alias("name"), "path").orderBy("name").toLocalIterator()
    move, last = manifest.mover(spark, path), None
    with ThreadPoolExecutor(_MOVERS) as pool:
        while some := list(islice(found, 2_000)):
            names = [last, *[r["name"] for r in some]]
            twice = [a for a, b in pairwise(names) if a == b]
            if twice:
                raise ValueError(f"several documents of {twice[0]}")
            list(pool.map(lambda r: move(r["path"], f"{path}/{r['name']}.json"), some))
            last = names[-1]


def link_documents(nodes: DataFrame, edges: DataFrame, meta: DataFrame) -> DataFrame:
    """One JSON document per link graph, in rows (host, piece, document), lists in sequence order; ``meta`` is (host, start, pages)."""
    c = F.col
    rows = _elements_of(nodes, 0, "node_seq", F.struct("id", "url", "title", "type")).unionByName(_elements_of(
        edges, 1, "edge_seq", F.struct(c("src").alias("source"), c("dst").alias("target"), "label", "kind", "skipped")))
    rows = rows.join(meta.select("host").distinct(), "host", "left_semi")
    head = meta.select("host", F.to_json(F.struct("start", c("pages").cast("int").alias("pages"))).alias("meta"))
    return _documents_of(head, rows, ["nodes", "edges"], False)


def hosts(meta: DataFrame) -> DataFrame:
    """Valid host names, sorted."""
    return meta.where(labels.valid_host("host")).select("host").distinct().orderBy("host")
