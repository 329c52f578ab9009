"""Conversation repair: survivor-coalescence Viterbi over keep, rerole, delete and insert.

Every conversation is read once, in turn order. Four states say which role came last in the
repaired conversation (none, system, user, assistant); each state keeps its cheapest edits,
ties going to the ASCII-least string of edit initials. The strings of the states form a tree
of back pointers. A node counts its children and the states that stand on it: nodes nobody
stands on any more go, and the edits from the root to the first branch are emitted, as all
survivors share them. So memory holds the unresolved edits only; texts are not held, each
survivor carries the running digest of its own repaired lines.

Two survivors never are prefixes of each other (an edit string up to a row ends with the edit
of that row), so the order of their complete unresolved strings stays what it was when they
parted. It is carried along as ranks, and a tie compares these.

Survivors that cannot win are dropped: ``AHEAD`` bounds how much more the rest can cost from
one state than from another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from fillsight.llm.common import crc_bucket

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK = " \t\n\x0b\x0c\r"
# AHEAD[y][x]: the rest from state y costs at most this more than the rest from state x.
AHEAD = {
    START: {SYSTEM: 0, USER: 5, ASSISTANT: 0},
    SYSTEM: {START: 12, USER: 5, ASSISTANT: 10},
    USER: {START: 7, SYSTEM: 5, ASSISTANT: 5},
    ASSISTANT: {START: 2, SYSTEM: 0, USER: 5},
}
# Rows after which shared edits are emitted at the earliest.
EMIT_ROWS = 64

REPORT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint,"
    " audit string, repaired_sha256 string"
)


def _steps(state: int, initial: str, must_go: bool, truncated: bool) -> list[tuple]:
    """(next state, cost, edits, roles of the inserted lines, role of the row: None if deleted,
    "" if kept) of the best way over one row into every state it leads to."""
    best: dict[int, tuple] = {}
    inserted, at, extra = [], state, TRUNCATED if truncated else 0
    while True:
        paid, edits = INSERT * len(inserted), "I" * len(inserted)
        ways = [(at, paid + DELETE, edits + "D", tuple(inserted), None)]
        if not must_go:
            kept = INITIALS.get(initial)
            if kept == FOLLOWS[at] or (kept == SYSTEM and at == START):
                ways.append((kept, paid + extra, edits + "K", tuple(inserted), ""))
            ways.append((FOLLOWS[at], paid + REROLE + extra, edits + "R", tuple(inserted), NAMES[FOLLOWS[at]]))
        for way in ways:
            if way[0] not in best or way[1:3] < best[way[0]][1:3]:
                best[way[0]] = way
        at = FOLLOWS[at]
        inserted.append(NAMES[at])
        if at == state or len(inserted) > 2:
            return list(best.values())


STEPS = {
    (s, i, m, t): _steps(s, i, m, t) for s in range(4) for i in ("s", "u", "a", "") for m in (False, True) for t in (False, True)
}


class _Node:
    """Edits of one survivor over one row; ``used`` counts children and survivors on it."""

    __slots__ = ("edits", "parent", "used")

    def __init__(self, parent, edits):
        self.parent, self.edits, self.used = parent, edits, 0
        if parent is not None:
            parent.used += 1


class Repair:
    """Streaming repair of one conversation: ``row`` for each row in order, then ``close``."""

    def __init__(self):
        self.root = _Node(None, "")
        self.root.used = 1
        self.alive = {START: (0, 0, self.root, hashlib.sha256())}  # state: cost, rank, node, digest
        self.emitted, self.waiting, self.pause = [], 0, EMIT_ROWS

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        initial = role[:1] if role[:1] in INITIALS else ""
        best: dict[int, tuple] = {}
        for state, (cost, rank, _, _) in self.alive.items():
            for way in STEPS[state, initial, must_go, truncated]:
                key = (cost + way[1], rank, way[2])
                if way[0] not in best or key < best[way[0]][0]:
                    best[way[0]] = (key, state, way)
        costs = {s: b[0][0] for s, b in best.items()}
        best = {s: b for s, b in best.items() if not any(costs[y] + AHEAD[y][s] < costs[s] for y in costs if y != s)}
        order = {s: n for n, s in enumerate(sorted(best, key=lambda s: best[s][0][1:]))}
        after = {}
        for state, (key, before, way) in best.items():
            _, _, node, digest = self.alive[before]
            lines = [f"{name}:" for name in way[3]]
            if way[4] is not None:
                lines.append(f"{way[4] or role}:{text}")
            if lines:
                digest = digest.copy()
                digest.update(("\n" if before != START else "").encode() + "\n".join(lines).encode())
            after[state] = (key[0], order[state], _Node(node, way[2]), digest)
        gone = [kept[2] for kept in self.alive.values()]
        self.alive = after
        for kept in after.values():
            kept[2].used += 1
        for node in gone:
            while node is not None:
                node.used -= 1
                if node.used:
                    break
                node = node.parent
        self.waiting += 1
        if self.waiting >= self.pause:
            self._emit()

    def _emit(self) -> None:
        """Emit the edits that all survivors share."""
        node, path = next(iter(self.alive.values()))[2], []
        while node is not self.root:
            path.append(node)
            node = node.parent
        while path and self.root.used == 1:
            self.root = path.pop()
            self.root.parent = None
            self.emitted.append(self.root.edits)
        self.waiting = len(path)
        self.pause = max(EMIT_ROWS, 2 * len(path))  # unresolved edits are walked again once they have doubled

    def close(self) -> tuple[int, str, str]:
        """Cost, audit string and SHA-256 of the repaired lines."""
        ends = []
        for state, (cost, rank, _, _) in self.alive.items():
            lines, at = [], state
            while at not in (START, ASSISTANT):
                at = FOLLOWS[at]
                lines.append(f"{NAMES[at]}:")
            ends.append((cost + INSERT * len(lines), rank, "I" * len(lines), state, lines))
        cost, _, edits, state, lines = min(ends)
        _, _, node, digest = self.alive[state]
        if lines:
            digest.update(("\n" + "\n".join(lines)).encode())
        tail = [edits]
        while node is not self.root:
            tail.append(node.edits)
            node = node.parent
        return cost, "".join(self.emitted) + "".join(reversed(tail)), digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after damage by crc32 of ``conv_id:turn``.

    ``copies`` is 0 for a dropped row (kept as a mark of its conversation), 2 for a repeated one.
    A NULL role or text is one space, as is a NULL in the key of the damage.
    """
    c = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    kind = crc_bucket(
        F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))), 20
    )
    return c.withColumn("kind", kind).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of each conversation together, in turn order, with ``seen``: role and text stood earlier.

    One exchange by conversation serves the window, the sort and the repair.
    """
    order = F.asc_nulls_first("turn")
    seen = F.row_number().over(
        W.partitionBy("conv_id", "role", F.xxhash64("text"), "text", F.col("copies") == 0).orderBy(order)
    ) > 1
    return (
        rows.repartition("conv_id").withColumn("seen", seen)
        .sortWithinPartitions(F.asc_nulls_first("conv_id"), order, "role", "text", "seen")
    )


def _blank_or_cut(text: str) -> tuple[bool, bool]:
    t = text.strip(BLANK)
    return not t, bool(t) and t[-1] not in ".!?"


class _Report:
    """Counts and repair of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.repair, self.counts = conv_id, Repair(), [0, 0, 0]
        self.illegal, self.last, self.turns, self.low, self.high = 0, None, 0, None, None

    def add(self, turn, role, text, copies, seen):
        if copies and turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        blank, cut = _blank_or_cut(text)
        for again in range(copies):
            fault = 0 if blank else 1 if seen or again else 2 if cut else None
            if fault is not None:
                self.counts[fault] += 1
            if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.last = role[:1]
            self.repair.row(role, text, fault in (0, 1), fault == 2)

    def values(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.counts, self.illegal, *self.repair.close())


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``damaged`` rows (see REPORT): faults, cost, audit and digest.

    Rows of one turn go by role and text. NULL conversation ids form one conversation. A
    conversation whose rows are all dropped gives zeros, an empty audit and the digest of the
    empty text; an empty table gives no rows. Repeated rows count as duplicates. Roles other
    than s..., u... and a... are only reroled or deleted.
    """
    names = [c.split()[0] for c in REPORT.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, out, size = None, [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=names)

        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                for row in zip(*(part.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "copies", "seen"))):
                    if report is None or report.conv_id != row[0]:
                        if report is not None:
                            out.append(report.values())
                            size += 200 + len(out[-1][-2])
                        report = _Report(row[0])
                    report.add(*row[1:])
                if size > 1_000_000:
                    yield batch()
                    out, size = [], 0
        if report is not None:
            out.append(report.values())
        if out:
            yield batch()

    return _ordered(rows).mapInArrow(run, REPORT)


def messages(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text, edit (K, R or I): the repaired conversations.

    The audit of a conversation precedes its rows in one sorted stream, so its edits are
    replayed row by row.
    """
    order = [F.asc_nulls_first("conv_id"), F.desc("audit"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("seen")]
    audits = reports.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
                            F.lit(1).alias("copies"), F.lit(False).alias("seen"), "audit")
    both = _ordered(rows).withColumn("audit", F.lit(None).cast("string")).unionByName(audits)
    schema = "conv_id bigint, position bigint, role string, text string, edit string"

    def replay(batches):
        audit, at, position, last = "", 0, 0, ""
        for b in batches:
            out = []
            for conv, role, text, copies, edits in zip(*(b.column(n).to_pylist() for n in ("conv_id", "role", "text", "copies", "audit"))):
                if edits is not None:
                    audit, at, position, last = edits, 0, 0, ""
                    copies = 0
                for _ in range(copies):
                    while audit[at] == "I":
                        last, at = "assistant" if last == "u" else "user", at + 1
                        out.append((conv, position, last, "", "I"))
                        last, position = last[0], position + 1
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        name = role if edit == "K" else "assistant" if last == "u" else "user"
                        out.append((conv, position, name, text, edit))
                        last, position = name[0], position + 1
                if at < len(audit) and not audit[at:].strip("I"):  # inserts after the last row
                    while at < len(audit):
                        last, at = "assistant" if last == "u" else "user", at + 1
                        out.append((conv, position, last, "", "I"))
                        last, position = last[0], position + 1
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=["conv_id", "position", "role", "text", "edit"])

    return both.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(replay, schema)
