"""Stores with one row a key, extended batch by batch.

A store is a few layers; the newest row of a key counts.  A batch reads the rows of
its keys and writes their new rows as a layer, so a batch of one key writes one row.
Layers that are no larger than what follows them are merged into it on the way: their
number stays near the logarithm of the rows, and each row is written as often.  A
layer has parts by hash of the key, as many as its rows need, sorted by key; a look-up
opens the parts that can hold its keys.

The manifest names layers, and each stream's last batch: a batch that runs again is
passed over, and one that died is simply done.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import manifest

#: Keys of a batch are broadcast up to this many, some 50 MB; beyond that they are joined by shuffle.
BROADCAST_KEYS = 500_000
#: Rows of one part of a layer.
PART_ROWS = 1_000_000

_MANIFEST = "kind string, name string, number bigint, rows bigint, parts int"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _key(schema: str) -> str:
    """A store's key is its first column."""
    return schema.split()[0]


def _part(key: str, parts: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")


def _layers(now: DataFrame | None) -> tuple[list, dict[str, int]]:
    """Layers, oldest first, and the last batch of each stream; a row a layer and stream."""
    rows = [] if now is None else now.collect()
    return sorted((r for r in rows if r.kind == "layer"), key=lambda r: r.number), {r.name: r.number for r in rows if r.kind == "stream"}


def _newest(spark: SparkSession, store: str, schema: str, layers: list, parts: dict | None = None) -> DataFrame:
    """The newest row of each key of some layers, or of some parts of them."""
    out = None
    for at in layers:
        places = [f"{store}/layers/{at.name}"] if parts is None else [f"{store}/layers/{at.name}/part={p}" for p in parts[at.name]]
        places = [p for p in places if manifest.exists(spark, p)]
        if places:
            rows = spark.read.schema(schema).parquet(*places).drop("part").withColumn("_layer", F.lit(at.number))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        return empty(spark, schema)
    if len(layers) == 1:
        return out.drop("_layer")
    cols = [c for c in out.columns if c != "_layer"]
    return out.groupBy(_key(schema)).agg(F.max_by(F.struct(*cols), "_layer").alias("r")).select(*[F.col("r")[c].alias(c) for c in cols])


def read_store(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """All rows in force."""
    layers, _ = _layers(manifest.newest(spark, store, _MANIFEST)[0])
    return _newest(spark, store, schema, layers)


def _look_up(spark: SparkSession, store: str, schema: str, layers: list, keys: DataFrame, few: bool) -> DataFrame:
    """The rows of ``keys``; layers of several parts are opened where the keys can lie."""
    key = _key(schema)
    parts = {at.name: [0] for at in layers}
    wide = [at for at in layers if at.parts > 1]
    if wide:
        where = F.explode(F.array(*[F.struct(F.lit(at.name).alias("layer"), _part(key, at.parts).alias("part")) for at in wide]))
        # at most a number a part
        for name, part in keys.select(where.alias("x")).select("x.*").distinct().groupBy("layer").agg(F.collect_list("part")).collect():
            parts[name] = part
    return _newest(spark, store, schema, layers, parts).join(F.broadcast(keys) if few else keys, key, "left_semi")


def fold_into_store(batch: DataFrame, tag: str, store: str, schema: str, key: str, fold) -> None:
    """Fold a batch into a store.

    ``fold(old, batch)`` gives the new rows of the batch's keys from their old ones.
    ``tag`` is ``<stream>-<batch number>``; a batch that is in the store is passed
    over.  Of two writers at once the later one folds again, into what the other
    has written.
    """
    spark = batch.sparkSession
    stream, _, number = tag.rpartition("-")
    keys = batch.select(F.col(key).cast("string").alias(key)).distinct().persist()
    try:
        n = keys.count()
        if n:
            manifest.commit(spark, store, _MANIFEST, lambda now: _extended(batch, keys, n, stream, int(number), store, schema, fold, now))
    finally:
        keys.unpersist()
    _clean(spark, store)


def _extended(batch: DataFrame, keys: DataFrame, n: int, stream: str, number: int, store: str, schema: str, fold, now: DataFrame | None) -> DataFrame | None:
    spark, key = batch.sparkSession, _key(schema)
    layers, done = _layers(now)
    if done.get(stream, -1) >= number:
        return None
    few = n <= BROADCAST_KEYS
    rows = fold(_look_up(spark, store, schema, layers, keys, few), batch)
    total, merged = n, []
    while layers and layers[-1].rows <= 2 * total:
        merged.insert(0, layers.pop())
        total += merged[0].rows
    if merged:
        kept = _newest(spark, store, schema, merged).join(F.broadcast(keys) if few else keys, key, "left_anti")
        rows = rows.select(*kept.columns).unionByName(kept)
    parts, name, seen = -(-total // PART_ROWS), uuid.uuid4().hex, Observation()
    laid = rows.withColumn("part", _part(key, parts)).repartition(parts, "part").sortWithinPartitions("part", key)
    laid.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy("part").parquet(f"{store}/layers/{name}")
    last = merged[-1].number if merged else layers[-1].number if layers else 0
    entries = [("layer", at.name, at.number, at.rows, at.parts) for at in layers] + [("layer", name, last + 1, seen.get["rows"], parts)]
    return spark.createDataFrame(entries + [("stream", s, b, None, None) for s, b in ({**done, stream: number}).items()], _MANIFEST)


def _clean(spark: SparkSession, store: str) -> None:
    """Delete manifests before the last ``manifest.KEEP``, and the layers that only they name."""
    there = manifest.numbers(spark, store)
    old, kept = there[: -manifest.KEEP], there[-manifest.KEEP :]
    if not old:
        return
    names = lambda some: {at.name for n in some for at in _layers(manifest.read(spark, store, n, _MANIFEST))[0]}
    fs, _ = manifest.file_system(spark, store)
    for name in names(old) - names(kept):
        fs.delete(manifest.file_system(spark, f"{store}/layers/{name}")[1], True)
    manifest.forget(spark, store, manifest.KEEP)
