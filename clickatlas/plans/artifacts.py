"""Content-addressed admission of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sets import flag_dupes
from ..operators.transcripts import first_seen
from ..sources.ledger import extension


def accept_artifacts(files: DataFrame, ledger: DataFrame, files_dir: str, now: str, dedupe: bool = True) -> DataFrame:
    """Admit each file as ``new`` or recognise it as a ``dupe``.

    ``files`` is (scope, file_seq, sha256, name, size, source).  A dupe points at
    the bytes already stored, whether by the ledger or by an earlier file of the
    batch.  The first file of a hash is found by an aggregate, so a group of
    copies that fills a third of the batch is combined in every task.
    """
    own = F.concat(F.lit(files_dir.rstrip("/") + "/"), F.col("sha256"), extension(F.col("name")))
    f = files.withColumn("own_path", own)
    if not dedupe:
        return f.select(
            "scope", "file_seq", "sha256", "name", "size", "source", F.lit("new").alias("status"), F.col("own_path").alias("path"),
            F.lit(now).alias("seen_at"), F.lit(None).cast("string").alias("first_seen"),
        )
    flagged = flag_dupes(first_seen(f, ["file_seq"]), ledger)
    lead = f.groupBy("scope", "sha256").agg(F.min_by("own_path", "file_seq").alias("lead_path"))
    flagged = flagged.join(lead, ["scope", "sha256"])
    new = ~F.col("in_ledger") & (F.col("status") == "new")
    return flagged.select(
        "scope", "file_seq", "sha256", "name", "size", "source", F.when(new, "new").otherwise("dupe").alias("status"),
        F.when(F.col("in_ledger"), F.col("seen_path")).otherwise(F.col("lead_path")).alias("path"),
        F.when(new, F.lit(now)).alias("seen_at"),
        F.when(F.col("in_ledger"), F.col("first_seen")).when(~new, F.lit(now)).alias("first_seen"),
    )
