"""Row selection helpers that stay parallel when one group holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# Spark prunes `row_number() <= n` before the shuffle up to this n.
_PRUNED_LIMIT = 1000
_SALTS = 64


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each group in ``order``.

    Up to 1000 rows Spark's window group limit drops all but ``n`` rows of a
    group in every map task, so a hot group shuffles ``n`` rows per task.  Above
    that the group is first cut per salt, which bounds what one task sorts.
    """
    order = _cols(order)
    name = rank or "_rn"
    if n > _PRUNED_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns[:8]), F.lit(_SALTS))
        df = df.withColumn("_salt", salt)
        pre = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_pre", F.row_number().over(pre)).where(F.col("_pre") <= n).drop("_pre", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_by(df: DataFrame, keys: list[str], order: list, cols: list[str] | None = None) -> DataFrame:
    """The first row of each group: an aggregate, so every task ships one row per group."""
    cols = cols or [c for c in df.columns if c not in keys]
    order = _cols(order)
    by = order[0] if len(order) == 1 else F.struct(*order)
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*cols), by).alias("_r"))
        .select(*keys, *[F.col("_r")[c].alias(c) for c in cols])
    )


def last_by_id(table: DataFrame, wanted: DataFrame | None, cols: list[str], seq: str = "state_seq", key: str = "id") -> DataFrame:
    """(host, key, cols) of the last row of each id: a stored id that occurs twice means its later row.

    With ``wanted`` (host, key) only those rows enter the aggregate, so a few shown
    rows never cost a pass over the whole table's ids.
    """
    if wanted is not None:
        table = table.join(wanted.select("host", key).distinct(), ["host", key], "left_semi")
    one = F.max_by(F.struct(*cols), seq)
    return table.groupBy("host", key).agg(one.alias("_r")).select("host", key, *[F.col("_r")[c].alias(c) for c in cols])


def spread(needles: DataFrame, rows: DataFrame, key: list[str], n: int = 16) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``_salt`` to join on besides the host, for tests that no equality can narrow.

    The rows of a host are dealt over ``n`` salts by ``key`` and each needle is
    repeated for every salt, so a site that holds much of the data is compared in
    ``n`` tasks at least.  Every pair still meets exactly once.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return needles.withColumn("_salt", salts), rows.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(n)).cast("int"))


def ordinal(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """Row number from 1 within each group, for groups of any size.

    Rows are range-partitioned by group and order, so a group spreads over as
    many tasks as it needs.  Each range numbers its own rows and adds the count
    of the group's rows in the ranges before it.
    """
    order = _cols(order)
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_pid", F.spark_partition_id())
    ranged = cut(ranged)  # the range numbers are fixed once written
    w = Window.partitionBy("_pid", *keys).orderBy(*order)
    sizes = ranged.groupBy(*keys, "_pid").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        ranged.withColumn("_rn", F.row_number().over(w))
        .join(offsets, [*keys, "_pid"])
        .withColumn(out, F.col("_rn") + F.col("_off"))
        .drop("_pid", "_rn", "_off")
    )


def prefix_sum(df: DataFrame, keys: list[str], seq: str, value: Column, out: str, chunk: int = 100_000) -> DataFrame:
    """Running sum of ``value`` in ``seq`` order within a group of any size.

    A group is cut into chunks of ``chunk`` sequence numbers.  Chunk totals are
    summed first (an aggregate), their running sum is taken over the totals
    only, and each chunk adds its offset to a window over itself.  No task sees
    more than one chunk of a group.
    """
    c = F.floor(F.col(seq) / F.lit(chunk)).cast("bigint")
    df = df.withColumn("_chunk", c).withColumn("_v", value.cast("bigint"))
    totals = df.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_in", F.sum("_v").over(inner))
        .join(offsets, keys + ["_chunk"])
        .withColumn(out, F.col("_in") + F.col("_off"))
        .drop("_chunk", "_v", "_in", "_off")
    )


def neighbour(df: DataFrame, keys: list[str], seq: str, value: Column, out: str, after: bool = False,
              chunk: int = 100_000) -> DataFrame:
    """``value`` of the row before (or after) in ``seq`` order, for groups of any size.

    Inside a chunk this is a plain ``lag``; the first row of a chunk takes the
    edge value of the nearest chunk before it.
    """
    c = F.floor(F.col(seq) / F.lit(chunk)).cast("bigint")
    df = df.withColumn("_chunk", c).withColumn("_v", F.struct(value.alias("v")))
    w = Window.partitionBy(*keys, "_chunk").orderBy(F.col(seq).desc() if after else F.col(seq))
    edge = (F.min_by if after else F.max_by)("_v", seq)
    edges = df.groupBy(*keys, "_chunk").agg(edge.alias("_e"))
    across = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc() if after else F.col("_chunk"))
    carried = edges.select(*keys, "_chunk", F.lag("_e").over(across).alias("_carry"))
    return (
        df.withColumn("_lag", F.lag("_v").over(w))
        .join(carried, keys + ["_chunk"])
        .withColumn(out, F.coalesce("_lag", "_carry")["v"])
        .drop("_chunk", "_v", "_lag", "_carry")
    )
