"""Conversations whose turns break the role grammar, mended by generalised LR parsing.

The grammar of role initials, ``(s?(ua)+)?``, is a list of productions; its LR
automaton is built from them.  Stacks of the parser share their tails (a top is a
state and the rest of its stack), and every row moves every stack by the edits it
allows: keep, rerole, delete, and insertions before it.  Tops that are equal merge,
and the smallest (cost, audit) stays.  Reductions on the next symbol are looked up
once per top, so a row costs a few table look-ups.

All stacks alive have read the same rows, and insertions belong to the row that
follows them, so no audit is the beginning of another: they keep their order
whatever is appended.  A rank therefore stands for an audit, and the edits
themselves are kept as one shared back-pointer tuple a row.  Each stack carries the
running hash of what it has repaired; texts are never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END = "$"
#: (left, right) of each production; the first one is the start.
GRAMMAR = (("S", ("C",)), ("S", ()), ("C", ("H", "P")), ("H", ("s",)), ("H", ()), ("P", ("P", "T")), ("P", ("T",)), ("T", ("u", "a")))
#: Roles that an edit may give a row, by their terminal.
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5


class Automaton:
    """SLR actions of a grammar; several actions for one symbol are all followed."""

    def __init__(self, grammar=GRAMMAR):
        self.rules = (("S'", (grammar[0][0],)), *grammar)
        self.names = {left for left, _ in self.rules}
        self.terminals = {x for _, right in grammar for x in right} - self.names
        first, empty = {n: set() for n in self.names}, set()
        follow = {n: set() for n in self.names}
        follow["S'"].add(END)
        before = None
        while before != (now := (sum(map(len, first.values())), len(empty), sum(map(len, follow.values())))):
            before = now
            for left, right in self.rules:
                if all(x in empty for x in right):
                    empty.add(left)
                for i, x in enumerate(right):
                    if all(y in empty for y in right[:i]):
                        first[left] |= first.get(x, {x})
                    if x in self.names:
                        rest = right[i + 1 :]
                        for k, y in enumerate(rest):
                            if all(z in empty for z in rest[:k]):
                                follow[x] |= first.get(y, {y})
                        if all(y in empty for y in rest):
                            follow[x] |= follow[left]
        self.states = [self._closure({(0, 0)})]
        self.goto: list[dict[str, int]] = []
        while len(self.goto) < len(self.states):
            items, moves = self.states[len(self.goto)], {}
            for x in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                to = self._closure({(r, d + 1) for r, d in items if d < len(self.rules[r][1]) and self.rules[r][1][d] == x})
                if to not in self.states:
                    self.states.append(to)
                moves[x] = self.states.index(to)
            self.goto.append(moves)
        done = [sorted(r for r, d in items if d == len(self.rules[r][1])) for items in self.states]
        self.reduce = [{t: [r for r in rules if r and t in follow[self.rules[r][0]]] for t in (*self.terminals, END)} for rules in done]
        self.accepting = [0 in rules for rules in done]

    def _closure(self, items: set) -> frozenset:
        todo = list(items)
        while todo:
            r, d = todo.pop()
            right = self.rules[r][1]
            if d < len(right):
                new = {(k, 0) for k, (left, _) in enumerate(self.rules) if left == right[d]} - items
                items |= new
                todo += new
        return frozenset(items)

    def tops(self, stack: tuple, symbol: str) -> list[tuple]:
        """Stacks that shift ``symbol`` (or accept, at the end) after all reductions it allows; a stack is (state, rest)."""
        out, todo = [], [stack]
        while todo:
            now = todo.pop()
            state = now[0]
            if symbol == END:
                if self.accepting[state]:
                    out.append(now)
            elif symbol in self.goto[state]:
                out.append((self.goto[state][symbol], now))
            for rule in self.reduce[state][symbol]:
                left, right = self.rules[rule]
                base = now
                for _ in right:
                    base = base[1]
                todo.append((self.goto[base[0]][left], base))
        return out


class Repair:
    """The cheapest edits of one conversation, row by row.

    A row is given by its mark: ``x`` must go; else the terminal of its role (any
    other letter for a role outside the grammar), in upper case if truncated.
    """

    START = (0, None)
    machine = Automaton()
    _moves: dict = {}
    _ends: dict = {}
    _same: dict = {}

    def __init__(self):
        # stack -> (cost, rank of its audit, place in the last back-pointer tuple, hash)
        self.alive = {self.START: (0, 0, 0, None)}
        self.back: list[tuple] = []

    @classmethod
    def _inserted(cls, stack: tuple) -> dict[tuple, tuple[str, ...]]:
        """Stacks reached by insertions alone, with the fewest."""
        found, todo = {stack: ()}, [stack]
        for top in todo:
            for t in sorted(ROLES):
                for to in cls.machine.tops(top, t):
                    if to not in found:
                        found[to] = (*found[top], t)
                        todo.append(to)
        return found

    @classmethod
    def moves(cls, stack: tuple, mark: str) -> list[tuple]:
        """(cost, appended audit, stack, inserted terminals, terminal of the row or None, kept) for a row."""
        got = cls._moves.get((stack, mark))
        if got is None:
            got = []
            own, late = mark.lower(), TRUNCATED if mark.isupper() else 0
            for top, ins in cls._inserted(stack).items():
                lead, cost = "I" * len(ins), INSERT * len(ins)
                got.append((cost + DELETE, lead + "D", top, ins, None, False))
                if mark == "x":
                    continue
                if own in cls.machine.terminals:
                    got += [(cost + KEEP + late, lead + "K", to, ins, own, True) for to in cls.machine.tops(top, own)]
                got += [(cost + REROLE + late, lead + "R", to, ins, t, False) for t in sorted(ROLES) for to in cls.machine.tops(top, t)]
            cls._moves[stack, mark] = got
        return got

    def add(self, mark: str, role: str, text: str) -> None:
        """Read one row."""
        best: dict[tuple, tuple] = {}
        for stack, (cost, rank, place, _) in self.alive.items():
            for more, appended, to, *_ in self.moves(stack, mark):
                key = (cost + more, rank, appended, place)
                if to not in best or key < best[to][0]:
                    best[to] = (key, stack)
        ranks = {k: i for i, k in enumerate(sorted({(key[1], key[2]) for key, _ in best.values()}))}
        alive, pointers = {}, []
        for to, ((cost, rank, appended, place), stack) in best.items():
            move = next(m for m in self.moves(stack, mark) if m[2] == to and m[1] == appended)
            alive[to] = (cost, ranks[rank, appended], len(pointers), self._hashed(self.alive[stack][3], move[3], move[4] and (role if move[5] else ROLES[move[4]]), text))
            pointers.append((place, appended))
        self.alive = alive
        pointers = tuple(pointers)
        self.back.append(self._same.setdefault(pointers, pointers))

    @staticmethod
    def _hashed(digest, inserted: tuple[str, ...], role: str | None, text: str):
        """The hash after inserted roles and the row, joined by line feeds; copied only where something is added."""
        pieces = [f"{ROLES[t]}:" for t in inserted] + ([] if role is None else [f"{role}:{text}"])
        if not pieces:
            return digest
        new = hashlib.sha256() if digest is None else digest.copy()
        new.update(("" if digest is None else "\n").encode() + "\n".join(pieces).encode())
        return new

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, digest of the repaired rows)."""
        best = None
        for stack, (cost, rank, place, digest) in self.alive.items():
            ends = self._ends.get(stack)
            if ends is None:
                ends = self._ends[stack] = [ins for top, ins in self._inserted(stack).items() if self.machine.tops(top, END)]
            for ins in ends:
                key = (cost + INSERT * len(ins), rank, "I" * len(ins))
                if best is None or key < best[0]:
                    best = (key, ins, place, digest)
        (cost, _, appended), inserted, place, digest = best
        parts = [appended]
        for pointers in reversed(self.back):
            place, appended = pointers[place]
            parts.append(appended)
        digest = self._hashed(digest, inserted, None, "") or hashlib.sha256()
        return cost, "".join(reversed(parts)), digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` damaged by a hash of conversation and turn; dropped rows stay, marked ``gone``.

    Of every twenty hash values 0 drops the row, 1 empties its text, 2 takes out
    ``.!?``, 3 repeats it, 4 makes it the user's.  Null roles and texts, and nulls
    in the hashed key, are one space.  Needs conv_id, turn, role, text.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text = F.coalesce(F.col("text").cast("string"), blank)
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), kind.alias("kind"),
                                F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), blank)).alias("role"),
                                F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``: blank, duplicate, truncated, or null; rows of a conversation stay in one partition.

    Needs conv_id, turn, role, text, gone and copy.  A row is a duplicate if an
    earlier row of its conversation that is not gone has its role and text.
    """
    rows = rows.withColumn("same", F.md5(F.encode("text", "UTF-8"))).repartition("conv_id")
    # the hash partitioning by conversation serves the window too
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "same", "gone").orderBy(F.col("turn").asc_nulls_first(), "copy")) > 1
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(again, "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    return rows.withColumn("fault", fault).drop("same")


_OUT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_PAIRS = {"su", "ua", "au"}
_COUNTED = ("blank", "duplicate", "truncated")


class _Conversation:
    def __init__(self, conv):
        self.conv, self.repair, self.counts, self.illegal = conv, Repair(), dict.fromkeys(_COUNTED, 0), 0
        self.low = self.high = self.turn = self.last = None
        self.turns = 0

    def add(self, turn, role: str, text: str, fault) -> None:
        if turn is not None:
            # rows come in order of their turns
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.high = self.turn = turn
        initial = role[:1]
        if self.last is not None and self.last + initial not in _PAIRS:
            self.illegal += 1
        self.last = initial
        if fault:
            self.counts[fault] += 1
        mark = "x" if fault in ("blank", "duplicate") else initial if initial in Repair.machine.terminals else "o"
        self.repair.add(mark.upper() if fault == "truncated" else mark, role, text)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.counts.values(), self.illegal, *self.repair.end())


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from rows in order."""
    now, out = None, []
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def done() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _OUT.split(", ")])
        out.clear()
        return got

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault")]
        for conv, turn, role, text, gone, fault in zip(*columns, strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.row())
                now = _Conversation(conv)
            if not gone:
                now.add(turn, role, text, fault)
        if len(out) > 1000:
            yield done()
    if now is not None:
        out.append(now.row())
    if out:
        yield done()


def repaired(rows: DataFrame) -> DataFrame:
    """Gaps, faults and the cheapest repair of every conversation.

    ``rows`` has conv_id, turn, role, text (null: one space) and may have ``gone``
    (a row that only says its conversation exists) and ``copy`` (its place among
    equal rows); other columns are ignored.  Rows of a conversation go by turn
    (nulls first), then role, text and copy.  Each row's first fault counts: blank
    (no character but white space), duplicate (role and text seen earlier),
    truncated (the last such character is none of ``.!?``).

    Edits: keep 0, rerole to user or assistant 1, delete 2 (blank and duplicate
    rows must go), insert an empty user or assistant row 5; a truncated row that
    stays costs 5 more.  ``audit`` spells the edits by initials; among equal costs
    the ASCII-least is chosen.  ``repaired_sha256`` digests ``role:text`` of the
    repaired rows, joined by line feeds.  ``illegal`` counts neighbours before the
    repair whose initials are not su, ua or au; ``gaps`` the turn numbers missing
    between the smallest and the largest.  A null conv_id is a conversation of its
    own; one without rows has zeros and an empty audit; an empty table gives none.

    A conversation is read by one task, as its digest runs in order.  That task
    holds a pointer a row and five hashes, never texts.
    """
    extra = {"gone": F.lit(False), "copy": F.lit(0)}
    blank = F.lit(" ")
    base = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"), *[(F.col(c) if c in rows.columns else v).alias(c) for c, v in extra.items()])
    ordered = faults(base).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "copy")
    return ordered.mapInArrow(_repair, _OUT)


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Contract columns: ``conversations`` damaged, then repaired."""
    return repaired(damaged(conversations))
