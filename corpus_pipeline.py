"""Documents to packed training sequences, in five stages that each work on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickatlas.llm import decontaminate, neardup, packing, quality, secrets
from clickatlas.llm.queries import table
from clickatlas.session import cut

_OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Extra columns under names that no operator uses, and all names as they were."""
    return docs.toDF(*[c if c in _OWN else f"_extra{i}" for i, c in enumerate(docs.columns)]), docs.columns


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words and go.  Null languages and sources are
    groups of their own.  Repeated rows count each and share their verdict; other
    columns stay, whatever their names; an empty table stays empty.
    """
    rows, names = _aside(docs)
    return quality.judge(rows, keep_text=True).where("kept").select(*rows.columns).toDF(*names)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8.

    The smallest doc_id stays (nulls last, equal ones by a hash of the text), and
    one of its repeated rows.  Texts without words are copies of nothing and stay.
    Other columns stay, whatever their names; an empty table stays empty.
    """
    return neardup.keep_one(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages in a twentieth of their words.

    Null and empty texts have no words and stay, as all do if the benchmark is
    empty.  Repeated rows share their verdict; other columns stay, whatever their
    names; an empty table stays empty.
    """
    rows, names = _aside(docs)
    judged = decontaminate.judge(rows, table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col("contaminated")).select(*rows.columns).toDF(*names)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets taken out of their texts and n_chars counted again.

    A null text stays null, with null n_chars; repeated rows and other columns stay;
    an empty table stays empty.
    """
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens.

    A null or empty text is its end id alone.  Repeated rows and rows that share a
    doc_id are packed each; other columns are left out; an empty table has no piece.
    """
    return packing.piece_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("minhash_neardup", minhash_neardup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

# packing places document after document, which SQL cannot say; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.

    Odd rows are handled by the stages as they say.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
