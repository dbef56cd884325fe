"""Chat records of any layout, to canonical turns, to marked text and back.

The layout of a record is known by its fingerprint: a hash of the sorted paths of
its nested fields (a list adds ``[]`` to the path; values and order do not
count).  A mapping registered under the fingerprint says, as data, where the turns
are and which of their fields hold role and text.  Records of an unknown
fingerprint are returned as such, with it, and never guessed at.

The template marks each turn; control strings inside texts are escaped so that
reading the marked text back gives the same turns.  A turn is one row, so a
conversation of any length never has to fit into one cell.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
_TURNS = "array<struct<role:string,text:string>>"


class Part(NamedTuple):
    """Turns taken from one place of a record.

    ``path`` leads to an object, or with a last ``[]`` to each object of a list.
    The role is ``role``, or the value of field ``role_field`` after ``roles``
    (others stay as they are).  ``texts`` are joined by a blank line; empty and
    missing ones are left out, and ``optional`` parts without any text make no turn.
    """

    path: tuple[str, ...] = ()
    role: str | None = None
    role_field: str | None = None
    texts: tuple[str, ...] = ("content",)
    optional: bool = False


class Mapping(NamedTuple):
    """A layout: the paths it has, the parts that make its turns in order, and other names of roles."""

    name: str
    paths: tuple[str, ...]
    parts: tuple[Part, ...]
    roles: tuple[tuple[str, str], ...] = ()


_ALIASES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


def _layouts() -> tuple[Mapping, ...]:
    """The layouts known from the start; optional fields make a layout each."""
    user, reply = Part(role="user", texts=("prompt",)), Part(role="assistant", texts=("completion",))
    system = Part(role="system", texts=("system",), optional=True)
    out = [
        Mapping("turn_row", ("role", "text"), (Part(role_field="role", texts=("text",)),)),
        Mapping("prompt_completion", ("completion", "prompt"), (user, reply)),
        Mapping("prompt_response", ("prompt", "response"), (user, Part(role="assistant", texts=("response",)))),
        Mapping("question_answer", ("answer", "question"), (Part(role="user", texts=("question",)), Part(role="assistant", texts=("answer",)))),
    ]
    for extra in ((), ("system",)):
        lead = (system,) if extra else ()
        for given in (("instruction", "output"), ("input", "instruction", "output")):
            ask = Part(role="user", texts=tuple(x for x in ("instruction", "input") if x in given))
            out.append(Mapping("instruction", tuple(sorted((*given, *extra))), (*lead, ask, Part(role="assistant", texts=("output",)))))
        for field in ("messages", "turns", "conversation"):
            out.append(Mapping("messages", tuple(sorted((f"{field}[].content", f"{field}[].role", *extra))), (*lead, Part((field, "[]"), role_field="role"))))
        out.append(Mapping("exchanges", tuple(sorted(("conversations[].from", "conversations[].value", *extra))), (*lead, Part(("conversations", "[]"), role_field="from", texts=("value",))), _ALIASES))
    return tuple(out)


def _key(name: str) -> str:
    """A key as a step of a path: dots, brackets and backslashes are escaped, so no key looks like several."""
    return re.sub(r"[\\.\[\]]", r"\\\g<0>", name) or "\\e"


def paths(value) -> set[str]:
    """Paths of the leaves of a parsed record; an empty object or list is a leaf."""
    found, todo = set(), [("", value)]
    while todo:
        at, value = todo.pop()
        if isinstance(value, dict) and value:
            todo += [(f"{at}.{_key(k)}" if at else _key(k), v) for k, v in value.items()]
        elif isinstance(value, list) and value:
            todo += [(f"{at}[]", v) for v in value]
        else:
            found.add(at)
    return found


def fingerprint(names) -> str:
    """Hash of a set of paths."""
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()[:16]


MAPPINGS: dict[str, Mapping] = {fingerprint(m.paths): m for m in _layouts()}


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) of each turn of a record."""
    roles, out = dict(mapping.roles), []
    for part in mapping.parts:
        found = [record]
        for step in part.path:
            found = [y for x in found for y in (x if step == "[]" else [x.get(step)])]
        for x in found:
            role = part.role if part.role_field is None else _text(x.get(part.role_field))
            if len(part.texts) == 1:
                text = _text(x.get(part.texts[0]))
            else:
                text = "\n\n".join(t for t in (_text(x.get(f)) for f in part.texts) if t)
            if text or not part.optional:
                out.append((roles.get(role, role), text))
    return out


def turns(records: DataFrame, mappings: dict[str, Mapping] | None = None) -> DataFrame:
    """``records`` with fingerprint, layout (null if unknown) and turns (role, text) in order.

    Needs ``record``, a JSON object as text; other columns stay, but any named
    fingerprint, layout or turns are replaced.  A null record, broken JSON, JSON
    nested deeper than the parser goes or an unknown layout has null layout and no
    turns.  Missing and null texts are
    empty, null roles are empty.
    """
    known = MAPPINGS if mappings is None else mappings
    rows = records.drop("fingerprint", "layout", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, layouts, found = [], [], []
            for text in batch.column("record").to_pylist():
                try:
                    record = json.loads(text) if text is not None else None
                except (ValueError, RecursionError):
                    record = None
                mark = fingerprint(paths(record)) if isinstance(record, dict) else None
                mapping = known.get(mark)
                prints.append(mark)
                layouts.append(mapping and mapping.name)
                found.append([{"role": r, "text": t} for r, t in canonical(record, mapping)] if mapping else [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(prints, pa.string()), pa.array(layouts, pa.string()), pa.array(found, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))],
                [*batch.schema.names, "fingerprint", "layout", "turns"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, fingerprint string, layout string, turns {_TURNS}")


def escape(text: Column) -> Column:
    """One more backslash between ``<`` and ``|`` wherever only backslashes stand between them: no control string remains."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    """A role on one line: backslashes and line feeds are spelled out."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    # a spelled backslash is set aside before the line feeds are read
    parts = F.transform(F.split(role, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def marked(role: Column, text: Column) -> Column:
    """One turn of the template."""
    return F.concat(F.lit(START), _role(role), F.lit("\n"), escape(text), F.lit(STOP), F.lit("\n"))


def format_turns(turn_rows: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``turn_rows`` with ``formatted`` and the loss mask as [loss_start, loss_end) in code points.

    Needs ``role`` and ``text``; nulls count as empty.  The formatted conversation
    is the concatenation of its rows in order.  Only the text of roles in
    ``learn`` is under the mask; other rows have an empty one.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    out = turn_rows.withColumn("formatted", marked(role, text))
    start = F.lit(len(START) + 1) + F.length(_role(role))
    under = role.isin(list(learn))
    return out.withColumn("loss_start", F.when(under, start).otherwise(0)).withColumn("loss_end", F.when(under, start + F.length(escape(text))).otherwise(0))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with role, text and loss_text taken from the formatted pieces alone."""
    body = F.regexp_extract("formatted", r"(?s)^<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n$", 2)
    role = F.regexp_extract("formatted", r"(?s)^<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n$", 1)
    loss = F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    return formatted.withColumn("role", _unrole(role)).withColumn("text", unescape(body)).withColumn("loss_text", unescape(loss))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose rows follow each other in order; holds one conversation's counters, never its texts."""
    names, kinds = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, state, out = None, None, []

    def end() -> None:
        n, turns_, loss, digest, chars = state
        out.append((now, n, turns_.hexdigest(), loss, digest.hexdigest(), chars))

    def rows() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        out.clear()
        return got

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss_text", "n_chars")]
        for conv, role, text, loss, chars in zip(*columns, strict=True):
            if state is None or conv != now:
                if state is not None:
                    end()
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += chars
        if len(out) > 1000:
            yield rows()
    if state is not None:
        end()
    if out:
        yield rows()


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Contract columns: every conversation formatted, read back and digested.

    ``conversations`` has conv_id, turn, role, text; other columns are ignored.
    Rows are JSON records of the ``turn_row`` layout.  Turns of a conversation go
    by turn number (nulls first); rows with the same number by role, then text.  A
    null conv_id is a conversation of its own.  A digest runs over one
    conversation in order, so a conversation is read by one task, row by row;
    nothing of it is held but its counters.
    """
    spark = conversations.sparkSession
    probe = spark.sql(f"SELECT -1L AS conv_id, n AS turn, IF(n = 0, 'user', 'assistant') AS role, '{STOP}{START}assistant ok' AS text FROM VALUES (0L), (1L) AS t(n)")
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.unionByName(probe)
    record = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    canon = turns(rows.select("conv_id", "turn", record.alias("record"))).select("conv_id", "turn", F.posexplode("turns").alias("within", "t")).select("conv_id", "turn", "within", "t.role", "t.text")
    back = read_back(format_turns(canon).drop("role", "text")).withColumn("n_chars", F.length("formatted").cast("bigint"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = back.select("conv_id", "turn", "within", "role", "text", "loss_text", "n_chars").repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "within")
    return ordered.mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
