"""Line-oriented run and crawl logs; the same columns serve batch and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

_PROGRESS = (
    r"^· \[(\d+) states / (\d+) visits\] depth (\d+) · (.*?) \((\d+) controls"
)
_SHORT_PROGRESS = r"\[(\d+) states / (\d+) visits\]"


def parse_frames(lines: DataFrame, line: str = "line") -> DataFrame:
    """Every line becomes a frame; text that is not one becomes a ``log`` frame."""
    text = F.col(line)
    obj = F.from_json(F.trim(text), "map<string,string>")
    ok = F.trim(text).startswith("{") & obj.isNotNull() & F.map_contains_key(F.coalesce(obj, F.create_map()), F.lit("type"))
    return lines.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("_o", obj).select(
        *[c for c in lines.columns if c != line],
        F.when(F.col("_ok"), F.col("_o")["type"]).otherwise(F.lit("log")).alias("type"),
        F.when(F.col("_ok"), F.col("_o")["op"]).alias("op"),
        F.when(F.col("_ok"), F.col("_o")["status"]).alias("status"),
        F.when(F.col("_ok"), F.trim(text)).otherwise(F.substring(text, 1, K.LOG_CHARS)).alias("payload"),
    )


def _grab(text: Column, n: int) -> Column:
    return F.regexp_extract(text, _PROGRESS, n)


def parse_progress(lines: DataFrame, line: str = "line") -> DataFrame:
    """Crawl progress counters; other lines are kept as log rows."""
    t = F.coalesce(F.col(line), F.lit(""))
    hit = t.rlike(_PROGRESS)

    def num(n):
        return F.when(hit, F.nullif(_grab(t, n), F.lit("")).cast("bigint"))

    return lines.select(
        *[c for c in lines.columns if c != line],
        F.when(hit, "progress").otherwise("log").alias("type"),
        num(1).alias("states"),
        num(2).alias("visits"),
        num(3).alias("depth"),
        F.when(hit, _grab(t, 4)).alias("url"),
        num(5).alias("controls"),
        F.when(~hit, F.substring(t, 1, K.LOG_CHARS)).alias("log_line"),
    )


def short_progress(line) -> tuple[Column, Column]:
    """(states, visits) found anywhere in a line."""
    t = F.coalesce(F.col(line) if isinstance(line, str) else line, F.lit(""))
    return tuple(
        F.nullif(F.regexp_extract(t, _SHORT_PROGRESS, i), F.lit("")).cast("bigint") for i in (1, 2)
    )
