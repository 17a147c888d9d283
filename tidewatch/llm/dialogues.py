"""Repair of damaged conversations: the cheapest edits that give a lawful order of roles, by depth-first branch-and-bound."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

#: fixed values: white space, ends of sentences, faults in the order in which they count, and what edits cost
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, STAYS_TRUNCATED = 1, 2, 5, 5
#: fixed values: what has been written so far (nothing, system, user, assistant last), and where a role's initial leads from there
START, SYSTEM, USER, ASSISTANT = range(4)
LEADS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: the role that may come next
NEXT = ("user", "user", "assistant", "user")
LAWFUL = ("su", "ua", "au")
_NEVER = 1 << 60

VERDICT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped. By crc32("conv_id:turn") % 20: 0 drops a row (it is only marked), 1 empties its text, 2
    removes the ends of its sentences, 3 repeats it, 4 makes it the user's. A null is one space wherever it is read as text."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(word("text"), ENDS, "")).otherwise(word("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out.drop("copy")


def _digest() -> Column:
    """What tells two rows of a conversation apart: role and text."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _step(state: int, initial: str) -> int | None:
    return LEADS[state].get(initial) if initial else state


def bounds(initials: list[str], faults: bytes) -> list[array]:
    """For each state, the least that a suffix of the rows can cost from there on, by one scan from the end. A row is judged by what it
    allows and costs, and insertions bridge what is missing."""

    def bridged(h: list[int]) -> list[int]:
        user, assistant = min(h[USER], INSERT + h[ASSISTANT]), min(h[ASSISTANT], INSERT + h[USER])
        return [min(h[START], INSERT + user), min(h[SYSTEM], INSERT + user), user, assistant]

    out = [array("q", bytes(8 * (len(initials) + 1))) for _ in range(4)]
    after = bridged([0, _NEVER, _NEVER, 0])
    for i in range(len(initials), -1, -1):
        if i < len(initials):
            here = [DELETE + h for h in after]
            if faults[i] not in (BLANK, DUPLICATE):
                more = STAYS_TRUNCATED if faults[i] == TRUNCATED else 0
                for state in range(4):
                    kept = _step(state, initials[i])
                    here[state] = min(here[state], more + REROLE + after[LEADS[state][NEXT[state][0]]], _NEVER if kept is None else more + after[kept])
            after = bridged(here)
        for state in range(4):
            out[state][i] = after[state]
    return out


def cheapest(initials: list[str], faults: bytes) -> tuple[int, str]:
    """The least cost, and the ASCII-least initials of edits (Delete, Insert, Keep, Rerole) that cost no more and give role initials
    (s?(ua)+)?.

    Depth first with an explicit stack: of a node's branches the one of the least bound is taken first, ties by initial, so
    whatever completes later at the same cost is greater in ASCII. A branch goes when its cost and the bound of its suffix
    don't beat the incumbent, or when its node was reached before at no more: nodes are (row, state), and two prefixes of one
    node and cost always differ before either ends. The bounds hold with equality, so that the first dive ends at the
    optimum and the rest of the stack proves it: steps are in proportion to rows. It needs some hundred bytes for each row.
    """
    n, rest = len(initials), bounds(initials, faults)
    reached = [array("q", [_NEVER]) * (n + 1) for _ in range(4)]
    incumbent: tuple[int, str] | None = None
    stack, path = [(0, START, 0, 0, "")], []
    while stack:
        i, state, cost, depth, letter = stack.pop()
        if cost >= reached[state][i] or incumbent and cost + rest[state][i] >= incumbent[0]:
            continue
        reached[state][i] = cost
        del path[max(0, depth - 1) :]
        if letter:
            path.append(letter)
        if i == n and state in (START, ASSISTANT):
            incumbent = cost, "".join(path)
            continue
        to = LEADS[state][NEXT[state][0]]
        branches = [("I", i, to, cost + INSERT)]
        if i < n:
            branches.append(("D", i + 1, state, cost + DELETE))
            if faults[i] not in (BLANK, DUPLICATE):
                more = cost + (STAYS_TRUNCATED if faults[i] == TRUNCATED else 0)
                branches.append(("R", i + 1, to, more + REROLE))
                if (kept := _step(state, initials[i])) is not None:
                    branches.append(("K", i + 1, kept, more))
        branches.sort(key=lambda b: (b[3] + rest[b[2]][b[1]], b[0]), reverse=True)
        stack += [(at, to, spent, depth + 1, letter) for letter, at, to, spent in branches]
    return incumbent


class _Conversation:
    """What is kept of a conversation while its rows pass: two bytes a row, and its turns' ends."""

    def __init__(self):
        self.initials, self.faults = [], bytearray()
        self.least = self.most = self.last = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if self.initials and self.initials[-1] + initial not in LAWFUL:
            self.illegal += 1
        self.initials.append(initial)
        self.faults.append(fault)
        if turn is not None and turn != self.last:  # turns come in order
            self.least = turn if self.least is None else self.least
            self.most = self.last = turn
            self.turns += 1

    def verdict(self) -> tuple:
        cost, audit = cheapest(self.initials, bytes(self.faults))
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return gaps, *(self.faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), self.illegal, cost, audit


def _together(rows: DataFrame, *order: str) -> DataFrame:
    """Each conversation's rows one after the other within a partition. One may be long: it is sorted by Spark, which spills, and
    passes through its task in batches."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def verdicts(damaged: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation. Rows travel without their texts."""
    left = F.rtrim("text", F.lit(BLANKS))
    slim = damaged.select("conv_id", "turn", "dropped", "role", _digest().alias("digest"), F.when(left == "", BLANK).when(F.instr(F.lit(ENDS), F.substring(left, -1, 1)) == 0, TRUNCATED).otherwise(FINE).alias("fault"))
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "digest").orderBy("turn")) > 1
    slim = slim.withColumn("fault", F.when((F.col("fault") != BLANK) & again, DUPLICATE).otherwise(F.col("fault")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, started = _Conversation(), None, False
        for batch in batches:
            out = []
            for conv, turn, dropped, role, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "dropped", "role", "fault"))):
                if not started or conv != at:
                    if started:
                        out.append((at, *now.verdict()))
                    now, at, started = _Conversation(), conv, True
                if not dropped:
                    now.add(turn, role[:1], fault)
            yield from told(out, batch.schema.field("conv_id").type)
        if started:
            yield from told([(at, *now.verdict())], batch.schema.field("conv_id").type)

    def told(rows: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        if rows:
            types = [kind, *[pa.int64()] * len(COUNTS), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["conv_id", *COUNTS, "audit"])

    return _together(slim, "turn", "role", "digest").mapInArrow(judge, VERDICT.format(id=damaged.schema["conv_id"].dataType.simpleString()))


def repaired(damaged: DataFrame, judged: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role, text: the conversations after their edits, each in order within one partition."""
    head = judged.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"))
    rows = damaged.filter("NOT dropped").select("conv_id", F.lit(1).alias("part"), F.col("turn").cast("long").alias("turn"), "role", "text", _digest().alias("digest"))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, k, state, place = "", 0, START, 0
        for batch in batches:
            out, kind = [], batch.schema.field("conv_id").type

            def insert(conv) -> None:
                nonlocal k, state, place
                while k < len(audit) and audit[k] == "I":
                    out.append((conv, place, "I", NEXT[state], ""))
                    state, place, k = LEADS[state][NEXT[state][0]], place + 1, k + 1

            for conv, part, role, text in zip(*(batch.column(c) for c in ("conv_id", "part", "role", "text"))):
                conv = conv.as_py()
                if not part.as_py():
                    audit, k, state, place = text.as_py(), 0, START, 0
                else:
                    letter = audit[k]
                    k += 1
                    if letter != "D":
                        role = role.as_py() if letter == "K" else NEXT[state]
                        out.append((conv, place, letter, role, text.as_py()))
                        state, place = _step(state, role[:1]), place + 1
                insert(conv)
            if out:
                types = [kind, pa.int64(), *[pa.string()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv_id", "place", "edit", "role", "text"])

    shape = f"conv_id {damaged.schema['conv_id'].dataType.simpleString()}, place long, edit string, role string, text string"
    return _together(head.union(rows), "part", "turn", "role", "digest").mapInArrow(edit, shape)


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of the role:text of each conversation's rows, joined by line ends, as the rows of repaired() pass by."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, which = None, None, None
        for batch in batches:
            done, which = [], batch.schema.field("conv_id").type
            for conv, place, role, text in zip(*(batch.column(c) for c in ("conv_id", "place", "role", "text"))):
                if place.as_py() == 0:
                    if now:
                        done.append((at, now.hexdigest()))
                    now, at = hashlib.sha256(), conv.as_py()
                else:
                    now.update(b"\n")
                now.update(f"{role.as_py()}:".encode())
                now.update(text.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (which, pa.string()))], names=["conv_id", "repaired_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([at], which), pa.array([now.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return conversations.mapInArrow(add, f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The verdicts of damaged rows (conv_id, turn, role, text, dropped), and the repaired conversations.

    A conversation's rows are taken by turn, nulls first; rows of one turn by role, then by the digest of role and text. Rows
    with a null conv_id are one conversation. Equal rows are duplicates of the first. A role is told by its first character;
    one without any, if it is kept, changes nothing in the order of roles. A conversation whose rows are all dropped has
    zeros, an empty audit and no repaired rows. An empty table gives empty ones; other columns are ignored. What a task
    keeps of a conversation is some bytes for each of its rows, since the audit and the digest are one value each.
    """
    judged = stash(verdicts(damaged := rows), "verdicts")
    return judged, repaired(damaged, judged)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, after = repair(damage(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))
    sums = digests(after).withColumnRenamed("conv_id", "_conv")
    out = judged.join(sums, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
