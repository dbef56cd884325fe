"""Unions, differences and merges of graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from .rows import first_by
from .substring import containing


def union_items(rounds: DataFrame) -> DataFrame:
    """Items of repeated reads of a view: each (text, cells, level) once, in first-seen order."""
    key = F.array_join(F.coalesce("cells", F.expr("cast(array() as array<string>)")), " | ")
    keyed = rounds.withColumn("_k", key).withColumn("_lvl", F.coalesce("level", F.lit(-2147483648)))
    return first_by(
        keyed, ["page_id", "kind", "t", "_k", "_lvl"], ["round", "item_idx"], ["round", "item_idx", "cells", "level"]
    ).drop("_k", "_lvl")


def dedupe_edges(edges: DataFrame, key: list[str], seq: str = "edge_seq") -> DataFrame:
    """First edge per key."""
    keys = ["host", *key]
    return first_by(edges, keys, [seq], [c for c in edges.columns if c not in keys])


LINK_EDGE_KEY = ["src", "dst", "label", "kind"]
MERGE_EDGE_KEY = ["src", "dst", "selector"]


def control_labels(controls) -> Column:
    """Label set of a view: first 30 characters of its non-bulk controls."""
    c = F.col(controls) if isinstance(controls, str) else controls
    kept = F.filter(c, lambda x: ~F.coalesce(x["bulk"], F.lit(False)))
    return F.array_distinct(F.transform(kept, lambda x: F.substring(F.coalesce(x["text"], F.lit("")), 1, 30)))


def sets_differ(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)


def view_swapped(before_controls, after_controls, before_view, after_view) -> Column:
    """The control labels or the active view marks changed."""
    return sets_differ(control_labels(before_controls), control_labels(after_controls)) | sets_differ(
        F.col(before_view), F.col(after_view)
    )


def merge_tables(old: DataFrame, new: DataFrame, key: list[str], prefer: str = "new") -> DataFrame:
    """Union of two versions of a table with one row per key."""
    rank = {"new": (0, 1), "old": (1, 0)}[prefer]
    both = old.withColumn("_p", F.lit(rank[0])).unionByName(new.withColumn("_p", F.lit(rank[1])), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in key and c != "_p"]
    return (
        both.groupBy(*key).agg(F.max_by(F.struct(*cols), "_p").alias("_r"))
        .select(*key, *[F.col("_r")[c].alias(c) for c in cols])
    )


def trigger_signature(label, path) -> Column:
    """Identity of a cached answer: its label and the labels clicked on the way."""
    p = F.col(path) if isinstance(path, str) else path
    steps = F.transform(p, lambda s: F.lower(F.coalesce(s["label"], F.lit(""))))
    steps = F.coalesce(steps, F.expr("cast(array() as array<string>)"))
    return F.concat_ws("\x1f", F.lower(F.coalesce(label if isinstance(label, Column) else F.col(label), F.lit(""))), steps)


def mark_stale(triggers: DataFrame, goals: DataFrame) -> DataFrame:
    """Flag triggers whose label contains any word of a goal asked on their host.

    ``goals`` is (host, goal).  Containment is a plain substring test, found by
    :func:`containing`; only the keys of the hits come out.
    """
    words = goals.select("host", F.explode(labels.stale_nouns("goal")).alias("w"))
    t = triggers.select("host", "trig_seq", F.lower(F.coalesce("label", F.lit(""))).alias("low"))
    hits = containing(words, t, "w", ["low"]).select("host", "trig_seq").distinct().withColumn("_hit", F.lit(True))
    return triggers.join(hits, ["host", "trig_seq"], "left").withColumn(
        "stale", F.coalesce("stale", F.lit(False)) | F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def flag_dupes(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files with the ledger record that already holds their content."""
    seen = ledger.select(
        "scope", "sha256", F.col("path").alias("seen_path"), F.col("seen_at").alias("first_seen"), F.lit(True).alias("in_ledger")
    )
    return files.join(seen, ["scope", "sha256"], "left").withColumn("in_ledger", F.coalesce("in_ledger", F.lit(False)))


def split_hits(questions: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions a stored answer covers, and those left for live discovery."""
    ok = answers.where(F.col("status") == "ok").select("q_id").distinct()
    return questions.join(ok, "q_id", "left_semi"), questions.join(ok, "q_id", "left_anti")
