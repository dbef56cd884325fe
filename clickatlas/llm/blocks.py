"""Blocks of documents, and questions that all blocks ask of all others.

A block is a few megabytes of documents in one row.  Operators that compare every
part of every text send hashes, not texts: each block sends the hashes it holds
to shards by hash, once each however often it holds them, so that a hash which a
third of the documents share reaches its shard once a block.  A shard sees all
blocks that hold a hash and answers each of them.  Blocks are written once to the
shared folder, so their numbers stay the same for all later passes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_counted, work_dir

#: Text of one block; a longer document is a block by itself.
BLOCK_BYTES = 2 << 20
#: Text whose hashes one shard takes.
SHARD_BYTES = 32 << 20
#: Stands for a null doc_id: it comes before all others.
NO_ID = np.iinfo(np.int64).min

#: An Arrow batch is held several times over, in the JVM, in Python and as arrays of hashes; the default is 64 MB.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

BLOCK_SCHEMA = "block bigint, part int, n bigint, bytes bigint, payload binary"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_BYTES`` where they are larger: a task then holds little text at once."""
    if spark.conf.get(_BATCH_CONF) != str(BATCH_BYTES):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def _dump(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def load(payload: bytes) -> pa.Table:
    """The documents of a block: doc_id and text."""
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def doc_ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def to_blocks(docs: DataFrame, part=None, size: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Write ``doc_id`` and ``text`` as blocks; documents of different ``part`` never share one.

    Returns the table and the number of shards for its size.  Lowers the session's
    Arrow batches to ``BATCH_BYTES`` where they are larger.
    """
    small_batches(docs.sparkSession)
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: dict[int, list[pa.Table]] = {}
        filled: dict[int, int] = {}

        def out(p: int) -> pa.RecordBatch:
            nonlocal number
            rows = pa.concat_tables(held.pop(p))
            got = pa.RecordBatch.from_pydict({
                "block": pa.array([(task << 32) | number], pa.int64()), "part": pa.array([p], pa.int32()), "n": pa.array([len(rows)], pa.int64()),
                "bytes": pa.array([filled.pop(p)], pa.int64()), "payload": pa.array([_dump(rows)], pa.binary()),
            })
            number += 1
            return got

        for batch in batches:
            table = pa.Table.from_batches([batch])
            parts = table["part"].to_numpy()
            for p in np.unique(parts):
                mine = table.filter(pa.array(parts == p)) if len(np.unique(parts)) > 1 else table
                mine = mine.select(["doc_id", "text"])
                lengths = mine["text"].combine_chunks().cast(pa.large_binary()).fill_null(b"")
                ends = np.cumsum(pc.binary_length(lengths).to_numpy(zero_copy_only=False)) if len(mine) else np.zeros(0, np.int64)
                a = 0
                while a < len(mine):
                    done = ends[a - 1] if a else 0
                    room = size - filled.get(int(p), 0)
                    b = min(len(mine), max(a + 1, int(np.searchsorted(ends, done + room, "right"))))
                    held.setdefault(int(p), []).append(mine.slice(a, b - a))
                    filled[int(p)] = filled.get(int(p), 0) + int(ends[b - 1] - done)
                    a = b
                    if filled[int(p)] >= size or a < len(mine):
                        yield out(int(p))
        for p in sorted(held):
            yield out(p)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(0) if part is None else part).cast("int").alias("part"))
    table, seen = cut_counted(rows.mapInArrow(pack, BLOCK_SCHEMA), work_dir(docs.sparkSession), size=F.col("bytes"))
    return table, max(8, math.ceil(seen["size"] / SHARD_BYTES))


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    """Shard by the high bits, so that the low ones still tell hashes of a shard apart."""
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def lists(values: np.ndarray, shard: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """One list for each of ``n`` shards from values in shard order."""
    off = np.searchsorted(shard, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the row each comes from."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return c.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(c)), n)


def each_block(blocks: DataFrame, make: Callable[[dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``make`` to every row of ``blocks``, as a dict of Arrow scalars' values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from make({name: batch.column(name)[i] for name in batch.schema.names})

    return blocks.mapInArrow(run, schema)


def answered(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with the list of answers (structs) that shards gave them; null where none did."""
    cols = [c for c in answers.columns if c != "block"]
    per_block = answers.groupBy("block").agg(F.collect_list(F.struct(*cols)).alias("answers"))
    return blocks.join(per_block, "block", "left")


def answer_arrays(value, names: list[str]) -> list[np.ndarray]:
    """The named list fields of all answers of a block, each as one array."""
    if value is None or not value.is_valid or not len(value.values):
        return [np.zeros(0, np.int64) for _ in names]
    s = value.values
    fields = s.flatten()
    return [fields[s.type.get_field_index(n)].flatten().to_numpy(zero_copy_only=False) for n in names]
