"""Artifact ledgers and file hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as X


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Last record per (scope, sha256); blank and torn lines are skipped.

    ``path`` holds ``scope=<name>/`` folders of JSON lines.  Files follow each
    other by the time they were written, then by name; within a file the line
    decides.
    """
    raw = (
        spark.read.schema(X.LEDGER)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("basePath", path)
        .json(f"{path}/scope=*")
        .withColumn("pos", F.struct(
            F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ))
    )
    return latest(raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record"))


def latest(records: DataFrame) -> DataFrame:
    """One record per (scope, sha256), the one written last: the greatest ``pos``.

    A partial aggregate runs before the shuffle, so a hash that fills a third of
    the ledger leaves each task as a single row.
    """
    rec = F.struct("name", "path", "size", "source", "seen_at")
    return (
        records.where(F.coalesce("sha256", F.lit("")) != "")
        .groupBy("scope", "sha256")
        .agg(F.max_by(rec, "pos").alias("r"))
        .select("scope", "sha256", "r.*")
    )


def append_ledger(accepted: DataFrame, path: str) -> None:
    """Append the rows admitted as new."""
    (
        accepted.where(F.col("status") == "new")
        .select("scope", "sha256", "name", "path", "size", "source", "seen_at")
        .write.mode("append")
        .partitionBy("scope")
        .json(path)
    )


def extension(name, chars: int | None = 12) -> "F.Column":
    """Last extension of a file name with its dot, of at most ``chars`` characters."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)$", 1)
    ext = F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1)
    return F.substring(ext, 1, chars) if chars else ext


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select(
            "path",
            F.col("_metadata.file_name").alias("name"),
            F.sha2("content", 256).alias("sha256"),
            F.col("length").alias("size"),
        )
        .withColumn("ext", extension(F.col("name")))
    )


def hash_column(df: DataFrame, content: str) -> DataFrame:
    """The same over a table column that holds the bytes or text."""
    raw = F.col(content).cast("binary")
    return df.withColumn("sha256", F.sha2(raw, 256)).withColumn("size", F.octet_length(raw).cast("bigint"))
