"""Conversation structure repair by a secondary-sorted stream.

Rows are repartitioned by conversation and sorted by turn, and one pass over the Arrow batches finds the
cheapest edits that make the roles read `(s?(ua)+)?` (initials): Keep 0, Rerole to user or assistant 2,
Delete 3 (the only edit of a blank or duplicate row), Insert an empty user or assistant turn 2; a truncated
row that is not deleted adds 1. Of equally cheap edits, the one whose letters are least in ASCII wins.

The dynamic program has four states (nothing, s, u, a). From each, only one of user and assistant may
follow, so the letters of an audit decide the roles, and two audits that end in one state differ before
either ends: an order of the four survivors is all that ties need. Per state the pass carries the cost,
that order and a running digest of the repaired text; per row it writes one byte of backpointer and state.
Backpointers beyond `held` bytes spill to a file in the shared folder, are read from the end when the
conversation is over, and removed. Memory is that bound, one batch, and the audit of one conversation.

A conversation is read by one task, as a stream: its digest is one SHA-256 over its text in order.

Defined results: a null conversation id is a conversation; null turns stand first; a null role or text is
one space, so blank; equal turns stand by role, then text; a role of another initial can only be
rerolled or deleted (an empty one has none); repeated rows are duplicates but for the first; a
conversation whose rows are all marked gone has zeros, an empty audit and the digest of nothing; no rows
-> no rows. Other columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.llm.storage import shared_folder
from shelfscope.llm.token_files import file_system, normal

WHITE = " \t\n\x0b\x0c\r"
#: Bytes of backpointers that a task holds in memory.
HELD = 4 << 20
LEGAL = {"su", "ua", "au"}
#: Per state (nothing, s, u, a): the state and the role that an inserted or rerolled turn leads to.
NEXT = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
#: Per state: how many turns to insert, and the state after them. More would come back to the same state.
INSERTS = (((0, 0), (1, 2), (2, 3)), ((0, 1), (1, 2), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2)))
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
LETTERS = "DKR"
NEVER = 1 << 60
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Backpointers:
    """Four bytes a row (one per state), appended; the oldest go to a file once `held` bytes are in memory."""

    def __init__(self, folder: str, held: int) -> None:
        self.folder, self.held, self.recent = folder, held, bytearray()
        self.stream = self.fs = self.path = None
        self.spilled = 0

    def add(self, row: bytes) -> None:
        self.recent += row
        if len(self.recent) >= self.held:
            if self.stream is None:
                self.fs, root = file_system(self.folder)
                self.fs.create_dir(root, recursive=True)
                self.path = f"{root}/{uuid.uuid4().hex}"
                self.stream = self.fs.open_output_stream(self.path)
            self.stream.write(bytes(self.recent))
            self.spilled += len(self.recent)
            self.recent = bytearray()

    def backwards(self) -> Iterator[bytes]:
        """Blocks of rows from the last to the first."""
        yield bytes(self.recent)
        if self.stream is not None:
            self.stream.close()
            with self.fs.open_input_file(self.path) as file:
                end = self.spilled
                while end:
                    begin = max(0, end - max(4, self.held // 4 * 4))
                    yield file.read_at(end - begin, begin)
                    end = begin

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.fs.delete_file(self.path)


class Conversation:
    """The state carried from row to row of one conversation."""

    def __init__(self, folder: str, held: int) -> None:
        self.cost = [0, NEVER, NEVER, NEVER]
        self.rank = [0, 0, 0, 0]
        self.digest = [hashlib.sha256(), None, None, None]
        self.begun = [False] * 4
        self.back = Backpointers(folder, held)
        self.turns, self.least, self.last = 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.last, self.turns = turn, self.turns + 1
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.before = initial
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.step(role, text, initial, fault)

    def step(self, role: str, text: str, initial: str, fault: str) -> None:
        extra = int(fault == "truncated")
        best: list[tuple | None] = [None] * 4
        for state in range(4):
            if self.cost[state] >= NEVER:
                continue
            for inserted, at in INSERTS[state]:
                paid = self.cost[state] + 2 * inserted
                options = [(paid + 3, "D", at)]
                if fault not in ("blank", "duplicate"):
                    if (at, initial) in KEEPS:
                        options.append((paid + extra, "K", KEEPS[at, initial]))
                    options.append((paid + extra + 2, "R", NEXT[at][0]))
                for cost, letter, to in options:
                    found = (cost, self.rank[state], "I" * inserted + letter, state, inserted, at)
                    if best[to] is None or found < best[to]:
                        best[to] = found
        said = text.encode("utf-8", "surrogatepass")
        digest, begun, pointers = [None] * 4, [False] * 4, bytearray(b"\xff" * 4)
        for to, found in enumerate(best):
            if found is None:
                self.cost[to] = NEVER
                continue
            cost, _, letters, state, inserted, at = found
            digest[to], begun[to] = self.digest[state].copy(), self.begun[state]
            for place in range(inserted):
                self.write(digest, begun, to, NEXT[INSERTS[state][place][1]][1], b"")
            if letters[-1] != "D":
                self.write(digest, begun, to, role if letters[-1] == "K" else NEXT[at][1], said)
            pointers[to] = state | inserted << 2 | LETTERS.index(letters[-1]) << 4
        order = sorted((found[1], found[2], to) for to, found in enumerate(best) if found)
        for rank, (_, _, to) in enumerate(order):
            self.rank[to], self.cost[to] = rank, best[to][0]
        self.digest, self.begun = digest, begun
        self.back.add(bytes(pointers))

    @staticmethod
    def write(digest: list, begun: list[bool], to: int, role: str, said: bytes) -> None:
        digest[to].update((b"\n" if begun[to] else b"") + role.encode("utf-8", "surrogatepass") + b":")
        digest[to].update(said)
        begun[to] = True

    def summary(self) -> tuple:
        ends = [
            (self.cost[state] + 2 * inserted, self.rank[state], "I" * inserted, state)
            for state in range(4) if self.cost[state] < NEVER
            for inserted, at in INSERTS[state] if at in ACCEPTED
        ]
        cost, _, letters, state = min(ends)
        digest, begun = list(self.digest), list(self.begun)
        for place in range(len(letters)):
            self.write(digest, begun, state, NEXT[INSERTS[state][place][1]][1], b"")
        sha, told = digest[state].hexdigest(), bytearray(letters.encode())
        for block in self.back.backwards():
            for row in range(len(block) - 4, -1, -4):
                pointer = block[row + state]
                told += LETTERS[pointer >> 4].encode() + b"I" * (pointer >> 2 & 3)
                state = pointer & 3
        told.reverse()
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, told.decode(), sha


def is_blank(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE)) == ""


def first_fault(text: Column, seen: Column) -> Column:
    """The first of blank, duplicate and truncated that holds, else an empty text."""
    end = F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))
    return (
        F.when(is_blank(text), "blank").when(seen, "duplicate")
        .when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    )


def plain(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): nulls of role and text as one space; `gone` rows are no rows."""
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text_of("role"), text_of("text"), gone.alias("gone"))


def repair(turns: DataFrame, held: int = HELD) -> DataFrame:
    """A row per conversation of `turns` (conv_id, turn, role, text and, if wanted, gone): its faults and cheapest edits."""
    folder = normal(shared_folder(turns.sparkSession, "repair"))
    same = W.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")
    rows = (
        plain(turns).repartition("conv_id")
        .withColumn("seen", F.row_number().over(same))
        .withColumn("fault", first_fault(F.col("text"), F.col("seen") > 1))
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "seen")
        .select(
            F.col("conv_id").cast("string").alias("conv"), F.col("turn").isNotNull().alias("placed"),
            F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "fault", "gone",
        )
    )
    names = ["conv", *[f.split()[0] for f in SUMMARY.split(", ")]]

    def repaired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, conversation, done = None, None, []
        try:
            for frame in frames:
                for conv, placed, turn, role, text, fault, gone in frame.itertuples(index=False, name=None):
                    conv = conv if isinstance(conv, str) else None
                    if conversation is None or conv != key:
                        if conversation is not None:
                            done.append((key, *conversation.summary()))
                            conversation.back.close()
                        key, conversation = conv, Conversation(folder, held)
                    if not gone:
                        conversation.add(int(turn) if placed else None, role, text, fault)
                if len(done) >= 1000 or sum(len(row[7]) for row in done) > HELD:
                    yield pd.DataFrame(done, columns=names)
                    done = []
            if conversation is not None:
                done.append((key, *conversation.summary()))
        finally:
            if conversation is not None:
                conversation.back.close()
        if done:
            yield pd.DataFrame(done, columns=names)

    found = rows.mapInPandas(repaired, f"conv string, {SUMMARY}")
    kind = turns.schema["conv_id"].dataType
    return found.select(F.col("conv").cast(kind).alias("conv_id"), *names[1:])


def repaired_turns(turns: DataFrame, summaries: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place (0, 1, ...), edit (K, R or I), role, text."""
    by = W.partitionBy("conv_id")
    in_order = by.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = plain(turns).filter(~F.col("gone")).withColumn("n", F.row_number().over(in_order))
    letters = summaries.select("conv_id", F.posexplode(F.regexp_extract_all("audit", F.lit("."), F.lit(0))).alias("at", "edit"))
    numbered = letters.withColumn("n", F.when(F.col("edit") != "I", F.count(F.when(F.col("edit") != "I", 1)).over(by.orderBy("at"))))
    same = numbered["conv_id"].eqNullSafe(rows["conv_id"]) & (numbered["n"] == rows["n"])
    joined = numbered.join(rows, same, "left").select(
        numbered["conv_id"], "at", "edit", rows["role"], F.coalesce(rows["text"], F.lit("")).alias("text")
    ).filter(F.col("edit") != "D")
    placed = joined.withColumn("place", F.row_number().over(by.orderBy("at")) - 1)
    opened = F.max(F.when((F.col("place") == 0) & (F.col("edit") == "K") & F.col("role").startswith("s"), 1).otherwise(0)).over(by)
    expected = F.when((F.col("place") - opened) % 2 == 0, "user").otherwise("assistant")
    return placed.select(
        "conv_id", "place", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(expected).alias("role"), "text"
    )
