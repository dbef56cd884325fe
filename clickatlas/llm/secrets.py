"""Secrets in texts: a keyword automaton, patterns anchored at its hits, checksums.

One Aho-Corasick pass over each text finds every place a secret may start; the
pattern of the keyword is then matched at that place only.  Runs of hex digits
have no keyword: a look at every eighth character finds the places where a run of
sixteen can be.  Kinds whose format carries a checksum are kept only if it holds.

Offsets are code points.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEX_LEAST, ASSIGN_LEAST, ACCESS_LEAST = 16, 12, 18
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_SPANS = "array<struct<kind:string,start:int,end:int>>"


class Kind(NamedTuple):
    """Keywords (lower case) that may start it, the pattern anchored there, and whether a match counts."""

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: object


def checksum62(token: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of the thirty before them."""
    body, check = token[-36:-6], token[-6:]
    crc, digits = zlib.crc32(body.encode()), ""
    while crc:
        crc, d = divmod(crc, 62)
        digits = _BASE62[d] + digits
    return check == digits.rjust(6, "0")


ASSIGN = Kind(
    "assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    lambda m: m.end(2) - m.start(2) >= ASSIGN_LEAST,
)
ACCESS = Kind("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= ACCESS_LEAST)
HEX = Kind("hex", (), re.compile(r"[0-9a-f]+"), lambda m: m.end() - m.start() >= HEX_LEAST)
#: Tokens of code hosts and package registries that end in a checksum.
GITHUB = Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: checksum62(m.group()))
NPM = Kind("npm", ("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: checksum62(m.group()))

BASE = (ASSIGN, ACCESS, HEX)
KINDS = (*BASE, GITHUB, NPM)


def _automaton(kinds: tuple[Kind, ...]) -> ahocorasick.Automaton:
    found: dict[str, list[int]] = {}
    for i, k in enumerate(kinds):
        for word in k.keywords:
            found.setdefault(word, []).append(i)
    a = ahocorasick.Automaton()
    for word, of in found.items():
        a.add_word(word, (len(word), of))
    a.make_automaton()
    return a


def _hex_places(text: str) -> Iterator[int]:
    """Starts of runs of hex digits that may hold ``HEX_LEAST``: two neighbouring looks hit each of those."""
    step = HEX_LEAST // 2
    probe = np.frombuffer(text[::step].encode("utf-32-le", "surrogatepass"), np.uint32)
    digit = ((probe >= 48) & (probe <= 57)) | ((probe >= 97) & (probe <= 102))
    done = 0
    for i in (np.flatnonzero(digit[:-1] & digit[1:]) * step).tolist():
        if i < done:
            continue
        start = i
        while start > done and text[start - 1] in "0123456789abcdef":
            start -= 1
        yield start
        done = HEX.pattern.match(text, start).end()


def scan(text: str, automaton: ahocorasick.Automaton | None = None, kinds: tuple[Kind, ...] = KINDS) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each secret, in order.

    Within a kind, matches are leftmost and do not overlap; one that does not
    count still takes its place.
    """
    automaton = automaton or _automaton(kinds)
    # the only letter whose lower case is two characters; it is in no keyword
    low = text.replace("İ", "i").lower() if not text.isascii() else text.lower()
    upto, out = [0] * len(kinds), []
    for end, (size, of) in automaton.iter(low):
        start = end - size + 1
        for k in of:
            if start >= upto[k] and (m := kinds[k].pattern.match(text, start)):
                upto[k] = m.end()
                if kinds[k].valid(m):
                    out.append((start, k, m.end()))
    if HEX in kinds:
        k = kinds.index(HEX)
        for start in _hex_places(text):
            m = HEX.pattern.match(text, start)
            if HEX.valid(m):
                out.append((start, k, m.end()))
    out.sort()
    return out


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton(KINDS)
    names = np.array([k.name for k in KINDS], object)
    for batch in batches:
        column, count, found = batch.column("text"), [], []
        for text in column:
            text = text.as_py()
            got = scan(text, automaton) if text else []
            count.append(len(got))
            found += got
        off = np.append(0, np.cumsum(count)).astype(np.int32)
        start, kind, end = (np.array(x, np.int32) for x in (zip(*found, strict=True) if found else ([], [], [])))
        spans = pa.StructArray.from_arrays([pa.array(names[kind], pa.string()), pa.array(start), pa.array(end)], ["kind", "start", "end"])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(off), spans)], [*batch.schema.names, "secrets"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with ``secrets``: (kind, start, end) by start, then kind in the order of ``KINDS``.

    Needs ``text``; a column named secrets is replaced, others stay.  Null and
    empty texts have none.  Rows are independent of each other, so repeated rows
    get equal answers.
    """
    rows = docs.drop("secrets")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_scan_batches, f"{fields}, secrets {_SPANS}")


def without(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with every stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by ``mark``; overlapping secrets become one mark.

    All other columns and the rows stay as they are; null texts stay null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(KINDS)
        for batch in batches:
            at = batch.schema.names.index("text")
            texts = [without(t, scan(t, automaton), mark) if t else t for t in (x.as_py() for x in batch.column(at))]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def secret_digests(docs: DataFrame) -> DataFrame:
    """Contract columns of :func:`find_secrets`."""
    got = find_secrets(docs.select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin([k.name for k in BASE]))
    count = lambda name: F.size(F.filter("secrets", lambda s: s["kind"] == name)).cast("bigint").alias(f"n_{name}")
    spell = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return got.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.encode(spell(base), "UTF-8"), 256).alias("base_sha256"), spell(F.col("secrets")).alias("spans"))
