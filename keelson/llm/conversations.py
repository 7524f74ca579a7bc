"""Conversation structure repair: the cheapest edits that make the roles ``(s?(ua)+)?``.

A conversation is its rows by turn (nulls first; ties by role, then by the
SHA-256 of the text, so the order never depends on partitions).  Null roles
and texts are one space.  Faults, the first one of a row counts: blank (no
``[^\\x20\\x09-\\x0D]``), duplicate (role and text stand earlier in the
conversation), truncated (its last such character is none of ``.!?``).

Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (a must for blank and
duplicate rows), Insert an empty user or assistant row anywhere 3; a truncated
row that stays costs 3 more.  The edits form an acyclic graph over (row, state
of the role pattern).  Every edge weighs one integer: its cost in the high
digits, and the letter of the edit (its ASCII byte) in the digit of its place
in the audit; the digits after an audit's end are zero.  The least sum is then
the least cost and, of those, the ASCII-least audit, which says all decisions:
which role a Rerole or Insert gives follows from the state.  Two equally cheap
ways to a node are never a prefix of each other (the longer would hold one
more Insert), so what follows can't turn their order.

How it runs: rows are reduced to small facts (no texts), equal ones are
counted together, and the first of each role and text is found by a
pre-aggregated minimum.  Facts are range partitioned, so a conversation of any
length lies in several tasks; each run of at most ``BLOCK`` rows gives its
least weights from every state to every state, and these small blocks are
joined in a tree.  Only the last step reads texts, in order, as a stream: the
digest is a chain over the repaired rows, so it visits a conversation's rows
in one task, without holding them.

Defined results: repeated rows are duplicates; an empty role starts no pattern
letter, so its row is reroled or deleted; a null conversation id is an id of
its own; ``copies`` 0 only names the conversation (no rows: zeros and an empty
audit); gaps beyond a long are its largest value; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a conversation that one block holds.
BLOCK = 256
#: States of the role pattern: nothing yet, after s, after u, after a.
START, S, U, A = range(4)
ACCEPT = (START, A)
KEEP = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
#: The state that a Rerole or an Insert leads to, and the role it gives.
TURN = {START: U, S: U, A: U, U: A}
GIVES = {U: "user", A: "assistant"}
LEGAL = {"su", "ua", "au"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
DIGIT = 8
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
LONG_MAX = (1 << 63) - 1


def shown(col: str) -> Column:
    """The column as text, a null as one space."""
    return F.coalesce(F.col(col).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row (``copies`` 0), 1 empties its text, 2 removes its ``.!?``,
    3 repeats it, 4 sets its role to user.
    """
    spot = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    return rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), spot.alias("spot")).select(
        "conv_id", "turn", F.when(F.col("spot") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("spot") == 1, "").when(F.col("spot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("spot") == 0, 0).when(F.col("spot") == 3, 2).otherwise(1).cast("long").alias("copies"))


# ------------------------------------------------------------------ weights
def scalar(cost: int, letters: int, n: int, width: int) -> int:
    """One integer of a way: its cost above ``width`` digits, its ``n`` letters at their left end."""
    return (cost << DIGIT * width) | (letters << DIGIT * (width - n))


def least_ways(rows: list[tuple[str, int]], start: int) -> list[tuple[int, bytes] | None]:
    """Cost and audit of the least way from ``start`` through ``rows`` (role initial, fault) to each state."""
    width = 3 * len(rows) + 2
    unit = 1 << DIGIT * width
    ways: list[tuple[int, int] | None] = [None] * 4  # weight, letters so far
    ways[start] = (0, 0)

    def edge(to: list, state: int, way: tuple[int, int], cost: int, letter: int) -> None:
        weight, n = way
        new = (weight + cost * unit + (letter << DIGIT * (width - 1 - n)), n + 1)
        if to[state] is None or new < to[state]:
            to[state] = new

    def inserts() -> None:
        for state in (START, S, A, U):
            if ways[state] is not None:
                edge(ways, TURN[state], ways[state], 3, ord("I"))

    inserts()
    for initial, fault in rows:
        after: list[tuple[int, int] | None] = [None] * 4
        for state in range(4):
            way = ways[state]
            if way is None:
                continue
            edge(after, state, way, 4, ord("D"))
            if fault in (BLANK, DUPLICATE):
                continue
            more = 3 if fault == TRUNCATED else 0
            kept = KEEP.get((state, initial))
            if kept is not None:
                edge(after, kept, way, more, ord("K"))
            edge(after, TURN[state], way, 3 + more, ord("R"))
        ways = after
        inserts()
    return [None if w is None else (w[0] >> DIGIT * width, (w[0] & (unit - 1)).to_bytes(width, "big")[:w[1]]) for w in ways]


def least(ways: Iterable[tuple[int, bytes] | None]) -> tuple[int, bytes] | None:
    """The way of the least weight."""
    some = [w for w in ways if w is not None]
    if len(some) < 2:
        return some[0] if some else None
    width = max(len(audit) for _, audit in some)
    return min(some, key=lambda w: scalar(w[0], int.from_bytes(w[1], "big"), len(w[1]), width))


def joined(first: dict, second: dict) -> dict:
    """Least ways through two neighbouring blocks, ``{(from, to): way}``."""
    out = {}
    for a in {a for a, _ in first}:
        for c in {c for _, c in second}:
            way = least((first[a, b][0] + second[b, c][0], first[a, b][1] + second[b, c][1])
                        for b in range(4) if (a, b) in first and (b, c) in second)
            if way is not None:
                out[a, c] = way
    return out


# ------------------------------------------------------------------- blocks
class Block:
    """What a run of rows adds to its conversation."""

    FIELDS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns"]

    def __init__(self, known_start: bool):
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.head = self.tail = None
        self.steps: list[tuple[str, int]] = []
        self.known_start = known_start
        self.ways: dict = {}

    def add(self, turn, initial: str, fault: int) -> None:
        self.rows += 1
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED
        if self.tail is not None:
            self.illegal += self.tail + initial not in LEGAL
        else:
            self.head = initial
        self.tail = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        self.steps.append((initial, fault))

    def close(self) -> Block:
        starts = [START] if self.known_start else range(4)
        self.ways = {(a, b): w for a in starts for b, w in enumerate(least_ways(self.steps, a)) if w is not None}
        return self

    def then(self, other: Block) -> Block:
        out = Block(self.known_start)
        for f in self.FIELDS:
            setattr(out, f, getattr(self, f) + getattr(other, f))
        if self.tail is not None and other.head is not None:
            out.illegal += self.tail + other.head not in LEGAL
        out.head = other.head if self.head is None else self.head
        out.tail = self.tail if other.tail is None else other.tail
        out.turns -= self.high is not None and self.high == other.low
        out.low = other.low if self.low is None else self.low
        out.high = self.high if other.high is None else other.high
        out.ways = joined(self.ways, other.ways)
        return out


WAY = pa.struct([("a", pa.int8()), ("b", pa.int8()), ("cost", pa.int64()), ("audit", pa.binary())])
BLOCK_DDL = ("part long, nth long, known_start boolean, rows long, blank long, duplicate long, truncated long, illegal long, "
             "turns long, low long, high long, head string, tail string, "
             "ways array<struct<a: tinyint, b: tinyint, cost: bigint, audit: binary>>")


def faults(copies: int, fault: int, first: bool) -> Iterator[int]:
    """The fault of each of a fact's rows."""
    if fault == BLANK:
        return (BLANK for _ in range(copies))
    return (fault if first and i == 0 else DUPLICATE for i in range(copies))


def cut_blocks(batches: Iterable[pa.RecordBatch], kind: pa.DataType, size: int) -> Iterator[pa.RecordBatch]:
    """The blocks of one task's facts, which are sorted by conversation and turn."""
    part, nth = TaskContext.get().partitionId(), 0
    conv, block, done = None, None, []

    def flush():
        return pa.record_batch({
            "conv_id": pa.array([c for c, _, _ in done], kind), "part": pa.array([part] * len(done), pa.int64()),
            "nth": pa.array([n for _, n, _ in done], pa.int64()), "known_start": pa.array([b.known_start for *_, b in done]),
            **{f: pa.array([getattr(b, f) for *_, b in done], pa.int64()) for f in [*Block.FIELDS, "low", "high"]},
            **{f: pa.array([getattr(b, f) for *_, b in done], pa.string()) for f in ("head", "tail")},
            "ways": pa.array([[{"a": x, "b": y, "cost": c, "audit": w} for (x, y), (c, w) in b.ways.items()] for *_, b in done],
                             pa.list_(WAY))})

    for batch in batches:
        for c, turn, initial, fault, copies, first in zip(*(batch.column(n).to_pylist() for n in
                                                            ("conv_id", "turn", "initial", "fault", "copies", "first"))):
            if block is None or c != conv:
                if block is not None:
                    done.append((conv, nth, block.close()))
                    nth += 1
                # A task's first rows may go on with a conversation of the task before it.
                conv, block = c, Block(known_start=block is not None)
            for f in faults(copies, fault, first):
                if block.rows == size:
                    done.append((conv, nth, block.close()))
                    nth += 1
                    block = Block(known_start=False)
                    if len(done) >= 1000:
                        yield flush()
                        done.clear()
                block.add(turn, initial, f)
        if done:
            yield flush()
            done.clear()
    if block is not None:
        done.append((conv, nth, block.close()))
        yield flush()


def fold_blocks(batches: Iterable[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Each conversation's counts, cost and audit from its blocks, which come in order."""
    conv, stack, done = None, [], []

    def push(block: Block) -> None:
        """A binary counter: neighbours of equal height are joined, so an audit is copied a logarithmic number of times."""
        height = 0
        while stack and stack[-1][0] == height:
            block = stack.pop()[1].then(block)
            height += 1
        stack.append((height, block))

    def finish() -> None:
        total = stack.pop()[1]
        while stack:
            total = stack.pop()[1].then(total)
        cost, audit = least(total.ways.get((START, s)) for s in ACCEPT)
        gaps = 0 if total.low is None else min(total.high - total.low + 1 - total.turns, LONG_MAX)
        done.append((conv, gaps, total.blank, total.duplicate, total.truncated, total.illegal, cost, audit.decode()))

    def flush():
        columns = list(zip(*done))
        return pa.record_batch({"conv_id": pa.array(columns[0], kind),
                                **{n: pa.array(c, pa.int64()) for n, c in zip(COUNTS, columns[1:])},
                                "audit": pa.array(columns[-1], pa.string())})

    for batch in batches:
        for row in batch.to_pylist():
            if stack and row["conv_id"] != conv:
                finish()
            conv = row["conv_id"]
            block = Block(row["known_start"])
            for f in [*Block.FIELDS, "low", "high", "head", "tail"]:
                setattr(block, f, row[f])
            block.ways = {(w["a"], w["b"]): (w["cost"], w["audit"]) for w in row["ways"]}
            push(block)
        if done:
            yield flush()
            done.clear()
    if stack:
        finish()
        yield flush()


# ------------------------------------------------------------------- repair
def facts(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, digest, copies, initial, fault, first)``, equal rows counted together."""
    same = ["conv_id", "role", "digest"]
    ended = F.substring(F.rtrim(F.col("text"), F.lit("\t\n\x0b\x0c\r ")), -1, 1).isin(".", "!", "?")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~ended, TRUNCATED).otherwise(FINE)
    found = (rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "copies", fault.alias("fault"))
             .groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.min("fault").alias("fault")))
    earliest = F.min(F.struct(F.col("turn").isNotNull().alias("k"), F.col("turn").alias("t"))).alias("e")
    firsts = found.where("copies > 0").groupBy(*same).agg(earliest).select(*[F.col(c).alias(f"_{c}") for c in same], "e")
    match = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same])
    return found.join(firsts, match, "left").select(
        *found.columns, F.substring("role", 1, 1).alias("initial"),
        (F.col("e").isNotNull() & F.col("e.t").eqNullSafe(F.col("turn"))).alias("first"))


def arrow_type(df: DataFrame, col: str) -> pa.DataType:
    return to_arrow_type(df.schema[col].dataType)


def standing(rows: DataFrame) -> DataFrame:
    """The rows with nulls shown, and ``copies`` 1 where that column is not given."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"),
                       copies.alias("copies"))


def plan_repairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)``, one row a conversation."""
    rows = standing(rows)
    kind, ddl = arrow_type(rows, "conv_id"), rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "digest"]
    sorted_facts = facts(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = sorted_facts.select("conv_id", "turn", "initial", "fault", "copies", "first").mapInArrow(
        lambda batches: cut_blocks(batches, kind, block), f"conv_id {ddl}, {BLOCK_DDL}")
    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth")
    return ordered.mapInArrow(lambda batches: fold_blocks(batches, kind),
                              f"conv_id {ddl}, {', '.join(f'{c} long' for c in COUNTS)}, audit string")


class Walk:
    """Follows an audit through a conversation's rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.last = len(audit.rstrip("I"))  # Inserts at the end come with the last row

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = TURN[self.state]
            yield GIVES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEEP[self.state, role[:1]]
            yield role, text
        elif letter == "R":
            self.state = TURN[self.state]
            yield GIVES[self.state], text
        if self.at == self.last:
            yield from self.inserted()


def with_texts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each conversation's plan row, then its rows in order; a conversation lies in one task, streamed."""
    rows = standing(rows)
    line = rows.where("copies > 0").withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("planned", F.lit(False))
    both = plan.withColumn("planned", F.lit(True)).unionByName(line, allowMissingColumns=True)
    return (both.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("planned"), "turn", "role", "digest")
            .select(*plan.columns, "planned", "role", "text", "copies"))


def walked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict | None, Iterable[tuple[str, str]]]]:
    """A new conversation's plan (else None) and the repaired rows that come next."""
    walk = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["planned"]:
                walk = Walk(row["audit"])
                yield row, ()
                continue
            for _ in range(row["copies"]):
                yield None, walk.row(row["role"], row["text"])


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The plan of each conversation of ``rows(conv_id, turn, role, text[, copies])`` with ``repaired_sha256``.

    The digest is that of the repaired ``role:text`` lines, joined by newlines.
    """
    plan = plan_repairs(rows, block)
    kind, names = arrow_type(plan, "conv_id"), plan.columns

    def run(batches):
        current, digest, lines, done = None, None, 0, []

        def flush():
            return pa.record_batch({n: pa.array([r[n] for r, _ in done], kind if n == "conv_id" else
                                                pa.string() if n == "audit" else pa.int64()) for n in names}
                                   | {"repaired_sha256": pa.array([d for _, d in done], pa.string())})

        for new, repaired in walked(batches):
            if new is not None:
                if current is not None:
                    done.append((current, digest.hexdigest()))
                    if len(done) >= 1000:
                        yield flush()
                        done = []
                current, digest, lines = new, hashlib.sha256(), 0
            for role, text in repaired:
                digest.update(f"{'' if lines == 0 else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                lines += 1
        if current is not None:
            done.append((current, digest.hexdigest()))
            yield flush()

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plan.schema)
    return with_texts(rows, plan).mapInArrow(run, f"{ddl}, repaired_sha256 string")


def repaired_rows(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv_id, place, role, text)``: the repaired conversations, places from 0."""
    plan = plan_repairs(rows, block)
    kind, ddl = arrow_type(plan, "conv_id"), plan.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv, place, out = None, 0, []
        for new, repaired in walked(batches):
            if new is not None:
                conv, place = new["conv_id"], 0
            for role, text in repaired:
                out.append((conv, place, role, text))
                place += 1
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out):
        c, p, r, t = zip(*out)
        return pa.record_batch({"conv_id": pa.array(c, kind), "place": pa.array(p, pa.int64()), "role": pa.array(r, pa.string()),
                                "text": pa.array(t, pa.string())})

    return with_texts(rows, plan).mapInArrow(run, f"conv_id {ddl}, place long, role string, text string")
