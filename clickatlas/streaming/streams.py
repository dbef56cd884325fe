"""Structured Streaming jobs over run logs, crawl logs and live results.

The stores are the state: each micro-batch is folded into them by one commit, so a
restart continues from the stream's checkpoint, a batch that runs again changes
nothing, and a stream with a new checkpoint extends what others wrote.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.artifacts import accept_artifacts
from ..plans.merge import merge_live
from ..sources import manifest
from ..sources.frames import parse_frames, parse_progress
from ..sources.graphs import StaleGraphs, applied, current_versions, read_tables, write_graphs
from .store import BROADCAST_KEYS, empty, fold_into_store, read_store

def checkpointed(writer, path: str):
    """Progress survives a kill: offsets and commits go to ``path``."""
    return writer.option("checkpointLocation", path).trigger(availableNow=True)


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()


def _run(stream: DataFrame, checkpoint: str, step) -> None:
    """Run ``step(batch, tag)`` on each batch; the tag names stream and batch."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            step(batch, f"{stream_id(batch.sparkSession, checkpoint)}-{batch_id}")
        finally:
            batch.unpersist()

    run_to_end(checkpointed(stream.writeStream.foreachBatch(each), checkpoint).start())


_PROGRESS = "crawl_id string, lines bigint, seq bigint, states bigint, visits bigint, depth bigint, url string, controls bigint"


def progress_stream(lines: DataFrame, store: str, checkpoint: str) -> None:
    """Keep the latest counters of each crawl, from (crawl_id, seq, line)."""
    last = ["seq", "states", "visits", "depth", "url", "controls"]

    def fold(old: DataFrame, batch: DataFrame) -> DataFrame:
        p = parse_progress(batch).where("type = 'progress'").select(
            F.col("crawl_id").cast("string").alias("crawl_id"), F.lit(1).cast("bigint").alias("lines"), *[F.col(c).cast("string" if c == "url" else "bigint").alias(c) for c in last])
        both = old.unionByName(p)
        return both.groupBy("crawl_id").agg(F.sum("lines").alias("lines"), F.max_by(F.struct(*last), "seq").alias("p")).select("crawl_id", "lines", "p.*")

    _run(lines, checkpoint, lambda batch, tag: fold_into_store(batch, tag, store, _PROGRESS, "crawl_id", fold))


def latest_progress(spark: SparkSession, store: str) -> DataFrame:
    return read_store(spark, store, _PROGRESS)


_FRAMES = "run_id string, frames bigint, logs bigint, result_seq bigint, result_status string"


def frame_stream(lines: DataFrame, store: str, checkpoint: str) -> None:
    """Keep every frame of every run, and each run's counts and last result, from (run_id, seq, line).

    Frames lie in a folder by stream and batch, which a batch that runs again
    overwrites.
    """
    def fold(old: DataFrame, batch: DataFrame) -> DataFrame:
        result = F.col("type") == "result"
        new = batch.select(
            F.col("run_id").cast("string").alias("run_id"), F.lit(1).cast("bigint").alias("frames"), F.when(F.col("type") == "log", 1).otherwise(0).cast("bigint").alias("logs"),
            F.when(result, F.col("seq")).cast("bigint").alias("result_seq"), F.when(result, F.col("status")).alias("result_status"))
        both = old.unionByName(new)
        return both.groupBy("run_id").agg(
            F.sum("frames").alias("frames"), F.sum("logs").alias("logs"), F.max("result_seq").alias("result_seq"), F.max_by("result_status", "result_seq").alias("result_status"))

    def step(batch: DataFrame, tag: str) -> None:
        frames = parse_frames(batch)
        frames.withColumn("part", F.lit(tag)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{store}/frames")
        fold_into_store(frames, tag, f"{store}/runs", _FRAMES, "run_id", fold)

    _run(lines, checkpoint, step)


def frame_totals(spark: SparkSession, store: str) -> DataFrame:
    return read_store(spark, f"{store}/runs", _FRAMES)


def stored_frames(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/frames").drop("part")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """Name of a stream that its restarts share: Spark keeps it in the checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


_LEDGER = "scope string, sha256 string, name string, path string, size bigint, source string, seen_at string, stream string, batch bigint"


def stored_ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    """Rows of all streams that ever wrote the ledger."""
    return spark.read.schema(_LEDGER).parquet(ledger_path) if manifest.exists(spark, ledger_path) else empty(spark, _LEDGER)


def ledger_stream(files: DataFrame, ledger_path: str, files_dir: str, now: str, checkpoint: str) -> None:
    """Admit a stream of files against the stored ledger, which lasts over streams.

    Rows lie in a folder by stream and batch.  A batch that runs again overwrites
    its own folder and passes it over on reading, so it is admitted once; another
    stream, with a checkpoint of its own, has folders of its own.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mine = stream_id(spark, checkpoint)
        ledger = stored_ledger(spark, ledger_path).where((F.col("stream") != mine) | (F.col("batch") != batch_id))
        batch = batch.persist()
        try:
            # only the ledger rows of the batch's own files are shuffled
            keys = batch.select("scope", "sha256").distinct()
            few = keys.count() <= BROADCAST_KEYS
            got = accept_artifacts(batch, ledger.join(F.broadcast(keys) if few else keys, ["scope", "sha256"], "left_semi"), files_dir, now)
            (
                got.where("status = 'new'")
                .select("scope", "sha256", "name", "path", "size", "source", "seen_at", F.lit(mine).alias("stream"), F.lit(batch_id).cast("bigint").alias("batch"))
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "batch").parquet(ledger_path)
            )
        finally:
            batch.unpersist()

    run_to_end(checkpointed(files.writeStream.foreachBatch(step), checkpoint).start())


def merge_stream(live: DataFrame, graphs_path: str, now: str, checkpoint: str) -> None:
    """Fold a stream of live results into stored graphs; each batch comes into force at once.

    The commit that puts a batch's hosts in force also notes the batch, so one that
    runs again is passed over, and one that died before it is done as if it were
    new.  If another writer replaced one of the hosts meanwhile, the batch is merged
    again, into what that writer left.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tag = f"{stream_id(spark, checkpoint)}-{batch_id}"
        batch = batch.persist()
        try:
            # the hosts of the batch prune the stored partitions
            hosts = batch.select("host").distinct()
            few = hosts.count() <= BROADCAST_KEYS
            while not applied(spark, graphs_path, tag):
                held = current_versions(spark, graphs_path)
                g = read_tables(spark, graphs_path, held)
                part = g._replace(**{n: getattr(g, n).join(F.broadcast(hosts) if few else hosts, "host", "left_semi")
                                     for n in ("states", "edges", "triggers", "meta")})
                try:
                    write_graphs(merge_live(part, batch, now), graphs_path, version=tag, read=held)
                except StaleGraphs:
                    continue
                break
        finally:
            batch.unpersist()

    run_to_end(checkpointed(live.writeStream.foreachBatch(step), checkpoint).start())


_RUNS = "run_id string, status string, first_seq bigint, last_seq bigint, frames bigint, done boolean"


def fold_runs(old: DataFrame, frames: DataFrame) -> DataFrame:
    """Run records after more frames: ``running`` until a result, ``error`` when it ended without one.

    ``frames`` is (run_id, seq, type, status); an ``exit`` frame ends a run.
    """
    new = frames.groupBy("run_id").agg(
        F.max_by("status", F.when(F.col("type") == "result", F.col("seq"))).alias("result"),
        F.bool_or(F.col("type") == "result").alias("has_result"), F.bool_or(F.col("type") == "exit").alias("ended"),
        F.min("seq").alias("a"), F.max("seq").alias("b"), F.count("*").alias("n"),
    )
    status = (
        F.when(F.col("has_result"), F.coalesce("result", F.lit("error")))
        .when(F.coalesce("done", F.lit(False)), F.col("status"))
        .when(F.col("ended"), "error")
        .otherwise("running")
    )
    j = old.join(new, "run_id", "full")
    return j.select(
        "run_id", F.when(F.col("n").isNull(), F.col("status")).otherwise(status).alias("status"),
        F.least("first_seq", "a").alias("first_seq"), F.greatest("last_seq", "b").alias("last_seq"),
        (F.coalesce("frames", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("frames"),
        (F.coalesce("done", F.lit(False)) | F.coalesce("has_result", F.lit(False)) | F.coalesce("ended", F.lit(False))).alias("done"),
    )


def run_stream(frames: DataFrame, store: str, checkpoint: str) -> None:
    """Keep one record per run up to date: ``running`` until a result, ``error`` when it ended without one."""
    def step(batch: DataFrame, tag: str) -> None:
        batch = batch.withColumn("run_id", F.col("run_id").cast("string"))
        fold_into_store(batch, tag, store, _RUNS, "run_id", fold_runs)

    _run(frames, checkpoint, step)


def latest_runs(spark: SparkSession, store: str) -> DataFrame:
    """The run table as it stands."""
    return read_store(spark, store, _RUNS)
