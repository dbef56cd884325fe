"""Packing of tokenized documents into windows by the sum of squares.

``level[f]`` counts the open windows that hold ``f`` tokens.  A document goes into
the fill level whose choice makes the sum of the squared counts smallest (an empty
window is a choice too); among equals into the fullest.  Levels then stay evenly
used, so later documents find the gap they need.  A document longer than a window
fills whole windows first, and its rest is packed.

Each task packs the rows of its partition, so nothing is shuffled.  It holds at
most ``MAX_OPEN`` windows: beyond that, and at the end, gaps are filled by cutting
pieces out of the emptiest windows.  The last window of a task is cut at powers of
two, which need no padding.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SIZE, END = 2048, 1
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
MAX_OPEN = 1024
_OUT_BYTES = 4 << 20
#: tiktoken's pattern fails on runs of white space of half a million and more.
_LONG_SPACE = re.compile(r"(?<!\s)\s{10000}")

_SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


class Encoder:
    """Token ids of texts, as little-endian 32-bit bytes, of a tokenizers file.

    With ``ranks``, the same vocabulary as ranks, tiktoken makes the ids: they are
    the same and take a third of the time.  It knows no special tokens and fails on
    very long white space, so a text with either goes through the tokenizers file.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks:
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, texts: list[str]) -> list[bytes]:
        slow = [i for i, t in enumerate(texts) if self.fast is None or any(x in t for x in self.special) or _LONG_SPACE.search(t)]
        out = [b""] * len(texts)
        for i, e in zip(slow, self.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        for i in range(len(texts)) if len(slow) < len(texts) else ():
            if not out[i] and texts[i]:
                out[i] = np.array(self.fast.encode_ordinary(texts[i]), "<u4").tobytes()
        return out


class Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, start: int, ids: bytes, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.total), Piece(self.doc, self.start + n, self.ids[4 * n :], self.total)


class Packer:
    """Packs pieces; hands every finished sequence, a list of pieces, to ``emit``."""

    def __init__(self, size: int, emit: Callable[[list[Piece]], None], max_open: int = MAX_OPEN):
        self.size, self.emit, self.max_open = size, emit, max_open
        # a full window leaves the count: at ``size`` the square grows by nothing, 2 * -0.5 + 1
        self.level = np.zeros(size + 1)
        self.level[size] = -0.5
        self.windows: list[list[list[Piece]]] = [[] for _ in range(size)]
        self.open = 0

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total // self.size * self.size
        for at in range(0, whole, self.size):
            self.emit([Piece(doc, at, ids[4 * at : 4 * (at + self.size)], total)])
        if whole < total:
            self.place(Piece(doc, whole, ids[4 * whole :], total))

    def place(self, piece: Piece) -> None:
        n = len(piece)
        fill = self.best(n)
        window = []
        if fill:
            window = self.windows[fill].pop()
            self.level[fill] -= 1
            self.open -= 1
        window.append(piece)
        if fill + n == self.size:
            self.emit(window)
            return
        self.windows[fill + n].append(window)
        self.level[fill + n] += 1
        self.open += 1
        if self.open > self.max_open:
            rest = self.fill_gaps()
            if rest:
                fill = sum(map(len, rest))
                self.windows[fill].append(rest)
                self.level[fill] += 1
                self.open = 1

    def best(self, n: int) -> int:
        """Fill level for ``n`` tokens with the smallest sum of squares afterwards; 0 opens a window."""
        here = self.level[1 : self.size - n + 1]
        # from h to h + n: (L[h] - 1)^2 - L[h]^2 + (L[h + n] + 1)^2 - L[h + n]^2
        change = np.where(here > 0, 2 * (self.level[1 + n :] - here) + 2, np.inf)[::-1]
        if len(change):
            at = int(change.argmin())
            if change[at] <= 2 * self.level[n] + 1:
                return self.size - n - at
        return 0

    def fill_gaps(self) -> list[Piece]:
        """Close all windows but one: the fullest take pieces, cut to fit, of the emptiest.  Returns that one."""
        todo = [w for f in range(self.size - 1, 0, -1) for w in self.windows[f]]
        self.windows = [[] for _ in range(self.size)]
        self.level[: self.size] = 0
        self.open = 0
        a, z = 0, len(todo) - 1
        while a < z:
            gap = self.size - sum(map(len, todo[a]))
            while gap and a < z:
                piece = todo[z].pop()
                if len(piece) > gap:
                    keep, piece = piece.cut(len(piece) - gap)
                    todo[z].append(keep)
                todo[a].append(piece)
                gap -= len(piece)
                if not todo[z]:
                    z -= 1
            if not gap:
                self.emit(todo[a])
                a += 1
        return todo[a] if a <= z else []

    def close(self) -> None:
        rest = self.fill_gaps()
        while rest:
            power = 1 << (sum(map(len, rest)).bit_length() - 1)
            out, left, room = [], [], power
            for piece in rest:
                if not room:
                    left.append(piece)
                elif len(piece) <= room:
                    out.append(piece)
                    room -= len(piece)
                else:
                    head, tail = piece.cut(room)
                    out.append(head)
                    left.append(tail)
                    room = 0
            self.emit(out)
            rest = left


_encoders: dict[tuple, Encoder] = {}


def pack(docs: DataFrame, path: str | None = None, ranks: str | None = None, size: int = SIZE, end: int = END, max_open: int = MAX_OPEN) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  Returns one
    row a piece: doc_id, start (ids of its document before it), length, doc_tokens
    (with the end id), sequence_id, offset (in the sequence, gapless from 0), ids
    (little-endian 32-bit).

    ``path`` is a vocabulary file of the tokenizers library and ``ranks`` the same
    vocabulary as ranks, which may be left out; by default they are ``VOCABULARY``
    and ``RANKS`` as public_tokenizers finds them on each executor.  A null or
    empty text is the end id alone.  Repeated rows and rows that share a doc_id
    are packed each.  Sequence ids carry the partition, so they are unique in the
    result and the same when a task runs again on the same rows.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (path, ranks) if path else (public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS))
        if files not in _encoders:
            _encoders[files] = Encoder(*files)
        encode = _encoders[files]
        task, done, rows, held = TaskContext.get().partitionId() << 33, 0, [], 0

        def emit(sequence: list[Piece]) -> None:
            nonlocal done, held
            offset = 0
            for p in sequence:
                rows.append((p.doc, p.start, len(p), p.total, task | done, offset, p.ids))
                offset += len(p)
                held += len(p.ids)
            done += 1

        def out() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 6 + [pa.binary()]
            got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            rows.clear()
            held = 0
            return got

        packer = Packer(size, emit, max_open)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(texts), strict=True):
                    packer.add(doc, ids + last)
                    if held > _OUT_BYTES:
                        yield out()
        packer.close()
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def piece_digests(docs: DataFrame) -> DataFrame:
    """Contract columns of :func:`pack`."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
