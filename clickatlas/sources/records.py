"""Run records, audit goals and page corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as X


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records without the corrupt ones, newest first, heavy payloads left out."""
    raw = (
        spark.read.schema(X.RUN)
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    return _listed(raw)


def runs_from_documents(docs: DataFrame) -> DataFrame:
    """The same from a table (document) of JSON texts."""
    parsed = F.from_json("document", X.RUN, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return _listed(docs.select(parsed.alias("d")).select("d.*"))


def _listed(raw: DataFrame) -> DataFrame:
    good = raw.where(F.col("_corrupt_record").isNull() & F.col("id").isNotNull())
    return good.drop("_corrupt_record", "steps", "artifacts", "collected").orderBy(
        F.coalesce("started_at", F.lit("")).desc(), "id"
    )


def read_goals(spark: SparkSession, path: str) -> DataFrame:
    """(site, goal) expectations of an audit file."""
    return _goals(spark.read.schema(X.GOALS_DOC).option("multiLine", True).json(path))


def goals_from_documents(docs: DataFrame) -> DataFrame:
    """The same from a table (document) of JSON texts."""
    return _goals(docs.select(F.from_json("document", X.GOALS_DOC).alias("d")).select("d.*"))


def _goals(doc: DataFrame) -> DataFrame:
    return (
        doc.select(F.explode("sites").alias("s"))
        .select("s.name", "s.host", "s.start_url", F.posexplode("s.goals").alias("goal_seq", "g"))
        .select(
            F.col("name").alias("site"),
            "host",
            "goal_seq",
            "g.goal",
            F.coalesce("g.start", "start_url").alias("start"),
            F.coalesce("g.expect.status", F.lit("ok")).alias("want"),
            "g.expect.url_contains",
            "g.expect.min_fields",
        )
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")
