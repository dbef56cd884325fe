"""Session set-up and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_dir: list[str] = []

#: Counted rows up to which a narrow table is broadcast, some 50 MB.
FEW_ROWS = 500_000


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(master)
        .appName("clickatlas")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.log.level", "ERROR")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """A new folder under the shared folder named by ``spark.checkpoint.dir``.

    Without that setting only a local session gets a folder of its own: a
    cluster needs one every executor can see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if not _local_dir:
            _local_dir.append(tempfile.mkdtemp(prefix="clickatlas-"))
            atexit.register(shutil.rmtree, _local_dir[0], ignore_errors=True)
        base = _local_dir[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut_counted(df: DataFrame, path: str, **sums) -> tuple[DataFrame, dict]:
    """:func:`cut`, with row count and sums gathered while the rows are written."""
    obs = Observation()
    seen = df.observe(obs, F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(k) for k, c in sums.items()])
    out = cut(seen, path)
    return out, {k: v or 0 for k, v in obs.get.items()}


def bucketed(df: DataFrame, keys: list[str], n: int, path: str) -> DataFrame:
    """Write ``df`` in ``n`` buckets of ``keys``, one file each; joins on the keys then need no shuffle of it."""
    name = "bucketed_" + uuid.uuid4().hex
    df.repartition(n, *keys).write.option("path", path).bucketBy(n, *keys).saveAsTable(name)
    return df.sparkSession.table(name)


def cut(df: DataFrame, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the work folder and read it back.

    The written table replaces the lineage, so an iterative job neither
    recomputes earlier levels nor grows its plan, and a lost executor costs
    nothing: unlike cached blocks the table lives in shared storage.  ``codec``
    compresses large tables closer than the session does.
    """
    spark = df.sparkSession
    path = path or work_dir(spark)
    df.write.mode("overwrite").parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """``df`` written, and broadcast if its rows turn out to be at most ``FEW_ROWS``."""
    out, seen = cut_counted(df, work_dir(df.sparkSession))
    return F.broadcast(out) if seen["rows"] <= FEW_ROWS else out


def at_once(*jobs: Callable) -> list:
    """Results of calls that do not need each other's tables, made at the same time: small ones fill what large ones leave idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]
