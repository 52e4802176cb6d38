"""Repair of conversation structure by an automaton of suffixes.

A row's signature is its role and fault. Signatures are read from the end of a
conversation, so conversations that end alike share nodes of one automaton. A
node holds, for each state of the grammar of roles, the least cost of what
follows and the best audit of it; both are computed once a node, whatever the
number of conversations that pass it. Rows of a conversation stream through
its task in order, twice: first the signatures from the end, in which blocks of
them are cut and what follows a block is reduced to four costs, then the texts
from the start. So memory doesn't depend on how long a conversation is; a digest
of its rows in order is sequential by nature.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices

WHITE = " \t\n\x0b\f\r"
STOPS = ".!?"
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: The role that an inserted row, or a row with a new role, has in each state.
WANTED = "uuau"
ROLES = {"u": "user", "a": "assistant"}
FAULTS = ("", "blank", "duplicate", "truncated")
LEGAL = {"su", "ua", "au"}
BLOCK, PIECE = 1 << 16, 32


class Suffixes:
    """The shared automaton. A node is what follows a place: a signature and the node after it.

    Below a root, which stands for all that comes after a piece of a
    conversation, hang the suffixes of that piece. A root is known by the costs
    of the four states relative to the least of them, of which there are few;
    the root of a conversation's end is ``None``. The automaton is emptied when
    it has ``limit`` nodes.
    """

    def __init__(self, limit: int = 200_000):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.after: dict[tuple[int, str], int] = {}
        self.roots: dict[tuple[int, ...] | None, int] = {}
        self.ahead: list[tuple[int, ...]] = []  # cost-to-go of each state, with what follows the piece
        self.audit: list[tuple[str, ...]] = []  # best audit of the rest of the piece
        self.spent: list[tuple[int, ...]] = []  # its cost
        self.final: list[tuple[int, ...]] = []  # the state after it

    def _add(self, ahead: list[int], audit: list[str], spent: list[int], final: list[int]) -> int:
        self.ahead.append(tuple(ahead))
        self.audit.append(tuple(audit))
        self.spent.append(tuple(spent))
        self.final.append(tuple(final))
        return len(self.ahead) - 1

    def root(self, costs: tuple[int, ...] | None) -> int:
        if costs not in self.roots:
            if costs is None:
                node = self._add([0, 2 * INSERT, INSERT, 0], ["", "II", "I", ""], [0, 2 * INSERT, INSERT, 0], [0, 3, 3, 3])
            else:
                node = self._add(list(costs), [""] * 4, [0] * 4, [0, 1, 2, 3])
            self.roots[costs] = node
        return self.roots[costs]

    def node(self, sign: str, after: int) -> int:
        found = self.after.get((after, sign))
        if found is None:
            found = self.after[after, sign] = self._step(sign, after)
        return found

    def _step(self, sign: str, after: int) -> int:
        """The node of a row before ``after``: of the cheapest edits the one whose letter comes first.

        The letters of the edits differ, so the first one decides which audit
        is less.
        """
        role, fault = signature(sign)
        ahead, extra = self.ahead[after], TRUNCATED if fault == "truncated" else 0
        options: list[list[tuple[int, str, int]]] = []
        for q in range(4):
            some = [(DELETE + ahead[q], "D", q)]
            if fault in ("", "truncated"):
                if role in NEXT[q]:
                    some.append((extra + ahead[NEXT[q][role]], "K", NEXT[q][role]))
                to = NEXT[q][WANTED[q]]
                some.append((REROLE + extra + ahead[to], "R", to))
            options.append(some)
        cost = [min(x[0] for x in some) for some in options]
        for _ in range(2):  # more than two rows are never inserted at one place
            cost = [min(cost[q], INSERT + cost[NEXT[q][WANTED[q]]]) for q in range(4)]
        chosen: list[tuple[str, int]] = []
        for q in range(4):
            some = options[q] + [(INSERT + cost[NEXT[q][WANTED[q]]], "I", NEXT[q][WANTED[q]])]
            chosen.append(min((letter, to) for c, letter, to in some if c == cost[q]))
        audit, spent, final = [], [], []
        for q in range(4):
            letters, at, own = "", q, 0
            while chosen[at][0] == "I":
                letters, at, own = letters + "I", chosen[at][1], own + INSERT
            letter, to = chosen[at]
            own += DELETE if letter == "D" else extra + (REROLE if letter == "R" else 0)
            audit.append(letters + letter + self.audit[after][to])
            spent.append(own + self.spent[after][to])
            final.append(self.final[after][to])
        return self._add([c - min(cost) for c in cost], audit, spent, final)

    def nodes(self, signs: str, costs: tuple[int, ...] | None) -> tuple[list[int], tuple[int, ...]]:
        """The nodes of the pieces of a block, in order, and the relative costs before it, from those after it."""
        if len(self.ahead) > self.limit:
            self.forget()
        out = []
        for start in range((len(signs) - 1) // PIECE * PIECE, -1, -PIECE):
            at = self.root(costs)
            for sign in reversed(signs[start : start + PIECE]):
                at = self.node(sign, at)
            out.append(at)
            costs = self.ahead[at]
        return out[::-1], costs


def signature(sign: str) -> tuple[str, str]:
    """(role initial, empty if not s, u or a; fault) of a sign."""
    n = ord(sign) - 65
    return "sua"[n % 4 : n % 4 + 1] if n % 4 < 3 else "", FAULTS[n // 4]


def _sign(role: Column, fault: Column) -> Column:
    initial = F.substring(role, 1, 1)
    return F.chr(65 + 4 * fault + F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of ``turns`` after damage by crc32 of ``conv_id:turn``, a null being one space in all four.

    By its remainder by 20: 0 drops a row, 1 empties its text, 2 removes its
    stops, 3 repeats it, 4 gives it the role user. ``conv_id`` and ``turn``
    themselves stay null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    rows = rows.withColumn("_d", F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("_n", F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of signatures, from rows of each conversation in falling order: what follows a block is known before it."""
    suffixes = Suffixes()
    names = ["conv_id", "turn", "role", "h", "block", "signs", "costs"]
    out: list[tuple] = []
    begun, conv, costs, block, signs, first = False, None, None, 0, [], ()

    def cut() -> None:
        nonlocal costs, block, signs
        ordered = "".join(reversed(signs))
        out.append((*first, block, ordered, None if costs is None else list(costs)))
        costs, block, signs = suffixes.nodes(ordered, costs)[1], block + 1, []

    def ready() -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if signs and (row[0] != conv or len(signs) == BLOCK):
                cut()
            if not begun or row[0] != conv:
                begun, conv, costs, block = True, row[0], None, 0
            first = row[:4]
            signs.append(row[4])
            if len(out) >= 5000 or sum(len(x[5]) for x in out[-64:]) >= 16 * BLOCK:
                yield ready()
                out.clear()
    if signs:
        cut()
    if out:
        yield ready()


def _forward(batches: Iterator[pa.RecordBatch], each_row: bool) -> Iterator[pa.RecordBatch]:
    """One report a conversation, or its repaired rows, from its rows in order with each block of signatures before its first row.

    Columns in: conv_id, kind (0: the conversation is there, 1: block, 2:
    row), turn, role, text, signs, costs.
    """
    suffixes = Suffixes()
    out: list[tuple] = []
    conv, begun = None, False

    def start() -> None:
        nonlocal begun, state, edits, inserts, queue, audit, cost, sha, position, counts, illegal, initial, low, high, distinct
        begun, state, edits, inserts, queue, audit, cost = True, 0, iter(()), 0, deque(), [], 0
        sha, position, counts, illegal, initial = hashlib.sha256(), 0, [0, 0, 0, 0], 0, None
        low, high, distinct = None, None, 0

    state, edits, inserts, queue, audit, cost, sha, position, counts, illegal, initial, low, high, distinct = 0, iter(()), 0, deque(), [], 0, hashlib.sha256(), 0, [0] * 4, 0, None, None, None, 0

    def write(turn: int | None, role: str, text: str, letter: str) -> None:
        nonlocal position
        sha.update((("\n" if position else "") + role + ":" + text).encode())
        position += 1
        if each_row:
            out.append((conv, position, turn, role, text, letter))

    def insert() -> None:
        nonlocal state
        write(None, ROLES[WANTED[state]], "", "I")
        state = NEXT[state][WANTED[state]]

    def letters_of(signs: str, costs: list[int] | None) -> Iterator[tuple[str, str]]:
        """(letter, signature) of each edit, from the state that rows have led to."""
        nonlocal cost
        for n, at in enumerate(suffixes.nodes(signs, None if costs is None else tuple(costs))[0]):
            text, own = suffixes.audit[at][state], iter(signs[n * PIECE : (n + 1) * PIECE])
            cost += suffixes.spent[at][state]
            if not each_row:
                audit.append(text)
            for letter in text:
                yield letter, "" if letter == "I" else next(own)

    def finish() -> None:
        for letter, _ in edits:  # rows are inserted at the end too
            insert()
        if not each_row:
            gaps = high - low + 1 - distinct if distinct else 0
            out.append((conv, gaps, counts[1], counts[2], counts[3], illegal, cost, "".join(audit), sha.hexdigest()))

    def ready() -> pa.RecordBatch:
        fields = _schema(each_row)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], names=[n for n, _ in fields])

    for batch in slices(batches, 4):
        for c, kind, turn, role, text, signs, costs in zip(*(x.to_pylist() for x in batch.columns)):
            if not begun or c != conv:
                if begun:
                    finish()
                conv = c
                start()
            if kind == 1:
                queue.append((signs, costs))
                continue
            if kind == 0:
                continue
            step = next(edits, None)
            while step is None:
                edits = letters_of(*queue.popleft())
                step = next(edits, None)
            while step[0] == "I":
                insert()
                step = next(edits)
            letter, sign = step
            counts[(ord(sign) - 65) // 4] += 1
            if turn is not None:
                distinct += turn != high
                low, high = turn if low is None else low, turn
            if initial is not None and initial + role[:1] not in LEGAL:
                illegal += 1
            initial = role[:1]
            if letter == "K":
                state = NEXT[state][initial]
                write(turn, role, text, "K")
            elif letter == "R":
                new = WANTED[state]
                state = NEXT[state][new]
                write(turn, ROLES[new], text, "R")
        if out:
            yield ready()
            out.clear()
    if begun:
        finish()
    if out:
        yield ready()


def _schema(each_row: bool) -> list[tuple[str, pa.DataType]]:
    if each_row:
        return [("conv_id", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]
    return [("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def _in_order(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Rows, blocks of signatures and conversations, all of one conversation in one partition, in order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
    rows = rows.withColumn("h", F.sha2("text", 256))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    own = F.when(bare == "", 1).when(~F.substring(bare, -1, 1).isin(*STOPS), 3).otherwise(0)
    again = F.row_number().over(W.partitionBy("conv_id", "role", "h").orderBy(F.col("turn").asc_nulls_first())) > 1
    signed = rows.select("conv_id", "turn", "role", "h", own.alias("_own")).repartition("conv_id")
    signed = signed.withColumn("_again", again).withColumn("sign", _sign(F.col("role"), F.when((F.col("_own") != 1) & F.col("_again"), 2).otherwise(F.col("_own"))))
    # of equal rows the one that is no duplicate is the first
    falling = [F.desc_nulls_first("conv_id"), F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("h"), F.desc("_again")]
    blocks = signed.sortWithinPartitions(*falling).select("conv_id", "turn", "role", "h", "sign").mapInArrow(_backward, "conv_id long, turn long, role string, h string, block long, signs string, costs array<long>")
    there = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("kind", F.lit(0))
    every = there.unionByName(blocks.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(rows.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    rising = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("h"), "kind", F.desc("block")]
    return every.repartition("conv_id").sortWithinPartitions(*rising).select("conv_id", "kind", "turn", "role", "text", "signs", "costs")


def repair_report(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: faults, the cheapest edits and a digest of the repaired rows.

    ``turns`` has conv_id, turn, role and text; rows of one turn are in order
    of role and of the SHA-256 of their text. A null role or text is one space,
    null turns come first and count for no gap, a null conv_id is a
    conversation of its own, repeated rows are duplicates. Columns: conv_id,
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    ``conversations`` (conv_id) names conversations that may have no rows: they
    get zeros, an empty audit and the digest of an empty string. An empty table
    gives an empty result; further columns are not read.
    """
    fields = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in _schema(False))
    return _in_order(turns, turns if conversations is None else conversations).mapInArrow(lambda b: _forward(b, False), fields)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, text, edit): the rows of each conversation after the cheapest edits.

    Positions count from 1; ``edit`` is K (kept), R (role changed) or I
    (inserted: no turn, an empty text). Odd rows as in ``repair_report``.
    """
    fields = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in _schema(True))
    return _in_order(turns, turns).mapInArrow(lambda b: _forward(b, True), fields)
