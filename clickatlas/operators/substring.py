"""Which texts of a host hold which needles, by posting lists of short substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import FEW_ROWS, few

#: Characters of a gram; a shorter needle is looked up by grams of its own length.
GRAM = 3
#: Needles of a host up to which each of its texts is asked for every one of them.
FEW_NEEDLES = 8


def grams(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters; none of a null or shorter text."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    none = F.expr("cast(array() as array<string>)")
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(size))))).otherwise(none)


def containing(needles: DataFrame, rows: DataFrame, needle: str, texts: list[str]) -> DataFrame:
    """``rows`` beside each needle of their host that one of their ``texts`` holds.

    ``needles`` is (host, ``needle``), ``rows`` any table with ``host`` and the
    ``texts``, none of whose columns is named as the needle; both are compared as
    they are.  The needles of hosts that ask for few are sent to the texts, which are
    read once.  Others are looked up by their rarest gram: an equi-join on (host,
    gram), so a text meets the needles that share that gram with it and no others.
    An empty needle is in every text that is not null.
    """
    asked = needles.select("host", needle).where(F.col(needle).isNotNull()).distinct().withColumn("_size", F.least(F.length(needle), F.lit(GRAM)))
    asked = few(asked)
    holds = F.lit(False)
    for t in texts:
        holds = holds | F.coalesce(F.contains(F.col(t), F.col(needle)), F.lit(False))
    most = asked.groupBy("host").count().agg(F.max("count"), F.sum("count")).first()
    if (most[0] or 0) <= FEW_NEEDLES and (most[1] or 0) <= FEW_ROWS:
        return asked.drop("_size").join(rows, "host").where(holds)
    # at most GRAM + 1 numbers
    sizes = sorted(r[0] for r in asked.select("_size").distinct().collect())
    out = asked.where("_size = 0").drop("_size").join(rows, "host").where(holds)
    listed = [n for n in sizes if n]
    if not listed:
        return out
    of = lambda col, sizes: F.array_distinct(F.flatten(F.array(*[grams(col, n) for n in sizes])))
    own = F.lit(None).cast("array<string>")
    for n in listed:
        own = F.when(F.col("_size") == n, grams(F.col(needle), n)).otherwise(own)
    spelled = asked.where("_size > 0").select("host", needle, F.explode(own).alias("_gram"))
    wanted = few(spelled.select("host", "_gram").distinct())
    all_grams = F.array_distinct(F.concat(*[of(F.coalesce(F.col(t), F.lit("")), listed) for t in texts]))
    posted = rows.withColumn("_gram", F.explode(all_grams)).join(wanted, ["host", "_gram"], "left_semi")
    lengths = posted.groupBy("host", "_gram").agg(F.count("*").alias("_n"))
    # a gram that no text has makes its needle's list empty
    rarest = spelled.join(lengths, ["host", "_gram"], "left").groupBy("host", needle).agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    return out.unionByName(posted.join(few(rarest), ["host", "_gram"]).where(holds).select(*out.columns))
