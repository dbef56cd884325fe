"""Folding and trimming of transcripts and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import labels
from .rows import first_by, neighbour, prefix_sum, top_n

_ENTRY_TYPES = ("user", "text", "tool_use", "tool_result", "tour", "flow_draft", "error")


def fold_transcript(frames: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Frames to entries: consecutive text deltas become one entry.

    ``frames`` is (conv_id, seq, type, text, ts).  Frames that leave no entry
    (``done`` and unknown ones) do not break a run of text.  The run numbers are
    a running sum taken chunk by chunk, so one endless conversation is folded by
    many tasks; text is joined per chunk first and then across chunks.
    """
    text = F.coalesce("text", F.lit(""))
    kept = frames.where(F.col("type").isin(list(_ENTRY_TYPES)) & ~((F.col("type") == "text") & (text == "")))
    kept = neighbour(kept, ["conv_id"], "seq", F.col("type"), "prev_type", chunk=chunk)
    starts = F.when((F.col("type") == "text") & (F.coalesce("prev_type", F.lit("")) == "text"), 0).otherwise(1)
    runs = prefix_sum(kept, ["conv_id"], "seq", starts, "entry", chunk=chunk)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]), "")
    part = runs.groupBy("conv_id", "entry", F.floor(F.col("seq") / chunk).alias("_c")).agg(
        F.min_by(F.struct("type", "ts"), "seq").alias("h"), F.count("*").alias("n"), joined("text").alias("text"), F.min("seq").alias("seq")
    )
    out = part.groupBy("conv_id", "entry").agg(
        F.min_by("h", "seq").alias("h"), F.sum("n").cast("bigint").alias("frames"), joined("text").alias("text"), F.min("seq").alias("first_seq")
    )
    role = F.when(F.col("h.type") == "user", "user").otherwise("assistant")
    return out.select("conv_id", "entry", role.alias("role"), F.col("h.type").alias("type"), "text", "frames", "first_seq", F.col("h.ts").alias("ts"))


def auto_title(frames: DataFrame) -> DataFrame:
    """Title of each conversation: its first user text that is not blank."""
    t = frames.where(F.col("type") == "user").withColumn("title", labels.derive_title("text")).where(F.col("title").isNotNull())
    return t.groupBy("conv_id").agg(F.min_by("title", "seq").alias("title"))


def keep_trailing(rows: DataFrame, keys: list[str], seq: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group."""
    return top_n(rows, keys, [F.col(seq).desc()], n)


def last_user_turns(messages: DataFrame, n: int = K.USER_TURNS) -> DataFrame:
    """From the n-th last genuine user turn on; shorter histories stay whole.

    ``messages`` is (conv_id, seq, role, plain); a tool result has ``plain``
    false and opens no turn.  Only user rows are ranked, and the cut comes back
    as one row per conversation.
    """
    turns = messages.where((F.col("role") == "user") & F.col("plain")).select("conv_id", "seq")
    last = top_n(turns, ["conv_id"], [F.col("seq").desc()], n + 1, rank="rn")
    cuts = last.groupBy("conv_id").agg(
        F.max("rn").alias("turns"), F.min(F.when(F.col("rn") <= n, F.col("seq"))).alias("cut")
    ).where(F.col("turns") > n)
    return messages.join(cuts.select("conv_id", "cut"), "conv_id", "left").where(
        F.col("cut").isNull() | (F.col("seq") >= F.col("cut"))
    ).drop("cut")


def drop_dangling_turn(messages: DataFrame) -> DataFrame:
    """Remove a genuine user message that ends its conversation."""
    last = messages.groupBy("conv_id").agg(F.max("seq").alias("last"))
    return messages.join(last, "conv_id").where(
        ~((F.col("seq") == F.col("last")) & (F.col("role") == "user") & F.col("plain"))
    ).drop("last")


def wire_messages(messages: DataFrame, n: int = K.USER_TURNS) -> DataFrame:
    """Messages as stored: long text cut with a mark, trailing user turn dropped, old turns trimmed."""
    return last_user_turns(drop_dangling_turn(messages.withColumn("text", labels.truncate("text"))), n)


def keep_newest_runs(runs: DataFrame, n: int = K.RUNS_PER_FLOW) -> DataFrame:
    """Newest ``n`` runs per flow; unreadable ones (no start) go first."""
    return top_n(runs, ["flow_id"], [F.coalesce("started_at", F.lit("")).desc(), F.col("run_id").desc()], n)


def stop_on_repeat(page_sigs: DataFrame) -> DataFrame:
    """Pages of a paging run up to the first one whose content was seen before."""
    first = page_sigs.groupBy("run_id", "sig").agg(F.min("page").alias("first"))
    stop = page_sigs.join(first, ["run_id", "sig"]).where(F.col("page") > F.col("first")).groupBy("run_id").agg(
        F.min("page").alias("stop")
    )
    return page_sigs.join(stop, "run_id", "left").where(F.col("stop").isNull() | (F.col("page") <= F.col("stop"))).drop("stop")


def chain_edges(steps: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Each step of a trace with the state before it."""
    return neighbour(steps, ["trace_id"], "step", F.col("state_id"), "prev_state", chunk=chunk)


def allocate_ids(new_states: DataFrame, states: DataFrame, order: list) -> DataFrame:
    """Ids ``sl<n>`` for new states, counted on from the largest numeric suffix of the host."""
    from .rows import ordinal

    top = states.groupBy("host").agg(F.max(labels.id_num("id")).alias("top"))
    numbered = ordinal(new_states, ["host"], order, "n")
    return numbered.join(top, "host", "left").withColumn(
        "id", F.concat(F.lit("sl"), (F.coalesce("top", F.lit(0)) + F.col("n")).cast("string"))
    ).drop("top", "n")


def first_seen(files: DataFrame, order: list) -> DataFrame:
    """Files of a batch flagged ``new`` for the first of a content hash, else ``dupe``."""
    first = first_by(files.select("scope", "sha256", "file_seq"), ["scope", "sha256"], order, ["file_seq"])
    flag = first.select("scope", "sha256", F.col("file_seq").alias("first_file"))
    return files.join(flag, ["scope", "sha256"]).withColumn(
        "status", F.when(F.col("file_seq") == F.col("first_file"), "new").otherwise("dupe")
    )
