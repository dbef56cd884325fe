"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_counted, work_dir


def _star(links: DataFrame, key: str, other: str) -> DataFrame:
    """Smallest end known to each node, joined to the node's links; the minimum is combined before it is shuffled."""
    low = links.groupBy(key).agg(F.min(other).alias("low")).withColumn("low", F.least(key, "low"))
    return links.join(low, key)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): the label is the smallest node it reaches.

    Alternates the two star steps (links to larger neighbours, then to smaller
    ones, move to the smallest neighbour) until nothing moves, a number of rounds
    that grows with the logarithm of the nodes.  Links stay a table; the driver
    sees their count and a checksum.
    """
    spark = links.sparkSession
    size = {"n": F.lit(1), "sum": F.xxhash64("a", "b").cast("decimal(38,0)")}
    now, seen = cut_counted(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), work_dir(spark), **size)
    while seen["n"]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        j = _star(large, "a", "b")
        small = j.select("a", F.col("low").alias("b")).unionByName(j.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))).distinct()
        then, new = cut_counted(small, work_dir(spark), **size)
        if new == seen:
            break
        now, seen = then, new
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
