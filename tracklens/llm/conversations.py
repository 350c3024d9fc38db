"""Conversation structure repair: the cheapest edits that give `(s?(ua)+)?`, by a forward Viterbi pass.

A conversation's rows are taken by turn (nulls first), then role and text. A path through them is in one of four
grammar states: nothing said yet, after the system's, after a user's, after an assistant's turn. Each row is kept,
given the other role, or deleted; blank and duplicate rows are always deleted. A state holds its least (cost, audit
string); a row's layer is closed by at most two inserted turns, as a third would lead back to a state at more cost. What the
four states' audit strings have in common is final: its rows go out and are forgotten, so a long conversation streams
through its task with the undecided rows alone in memory. States that can't win any more are dropped, or "everything
was deleted so far" would keep every row undecided.

Duplicates are found beforehand by a window over (conversation, role, text), which deals one conversation over many
tasks; then rows are exchanged by conversation. The hash of a conversation's repaired text runs over it in order, so
one conversation is one task's from there on, read row by row.

Odd rows. A null in role or text counts as one space, so a row without text is blank and one without role can't be
kept as it is. Null keys are one conversation. Rows repeated with their turn are duplicates. An empty table gives no rows.
Other columns are ignored. The text's own length has no bound other than that of a row.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator
from os.path import commonprefix
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Costs of the edits, and what a truncated row costs on top unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The role that must follow in each state, and the initials that may be kept.
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
#: White space, as these texts define it.
BLANK = "\\x20\\x09-\\x0D"
#: Undecided rows from which on it is tried whether some are final.
UNDECIDED = 64
#: Rows that go out at a time, and characters.
BATCH, CHARS = 2048, 4_000_000


class Paths:
    """The least (cost, edits) of each state for the rows so far, without the edits that are final already."""

    def __init__(self) -> None:
        self.best: dict[str, tuple[int, str]] = {"": (0, "")}
        self.close()

    def row(self, initial: str, gone: bool, truncated: bool) -> None:
        out: dict[str, tuple[int, str]] = {}
        more = TRUNCATED if truncated else 0
        for state, (cost, path) in self.best.items():
            self.offer(out, state, cost + DELETE, path + "D")
            if not gone:
                if initial and initial in FOLLOWS[state]:
                    self.offer(out, initial, cost + more, path + "K")
                self.offer(out, NEXT[state], cost + more + REROLE, path + "R")
        self.best = out
        self.close()

    @staticmethod
    def offer(into: dict[str, tuple[int, str]], state: str, cost: int, path: str) -> None:
        if state not in into or (cost, path) < into[state]:
            into[state] = cost, path

    def close(self) -> None:
        """At most two inserted turns, then without the states that can't win: after an assistant's turn all goes on that does
        from "nothing yet", with one system row deleted, and all that does after the system's."""
        best = self.best
        for _ in range(2):
            for state, (cost, path) in list(best.items()):
                self.offer(best, NEXT[state], cost + INSERT, path + "I")
        answered = best["a"][0]
        if "" in best and best[""][0] > answered + DELETE:
            del best[""]
        if "s" in best and best["s"][0] > answered:
            del best["s"]

    def final(self) -> str:
        """The edits that all states share, which are taken off."""
        shared = commonprefix([p for _, p in self.best.values()])
        if shared:
            self.best = {s: (c, p[len(shared) :]) for s, (c, p) in self.best.items()}
        return shared

    def end(self) -> tuple[int, str]:
        return min(self.best[s] for s in ("", "a") if s in self.best)


class Conversation:
    """One conversation as its rows come in: counts of faults, cost, audit and the repaired turns that are final."""

    def __init__(self) -> None:
        self.paths, self.state, self.audit = Paths(), "", []
        self.waiting: deque[tuple[Any, str, str]] = deque()
        self.last: str | None = None
        self.turns: list[int] = []  # the smallest and the largest
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.look_at = UNDECIDED

    def add(self, turn: Any, role: str, text: str, fault: str) -> Iterator[tuple[str, Any, str, str]]:
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None:
            if not self.turns or turn != self.turns[1]:
                self.distinct += 1
            self.turns = [self.turns[0] if self.turns else turn, turn]
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.waiting.append((turn, role, text))
        self.paths.row(initial, fault in ("blank", "duplicate"), fault == "truncated")
        if len(self.waiting) >= self.look_at:
            yield from self.out(self.paths.final())
            self.look_at = max(UNDECIDED, 2 * len(self.waiting))

    def finish(self) -> Iterator[tuple[str, Any, str, str]]:
        cost, rest = self.paths.end()
        self.cost = cost
        yield from self.out(rest)

    def out(self, edits: str) -> Iterator[tuple[str, Any, str, str]]:
        """(edit, turn, role, text) of each edit; the roles follow from the state."""
        self.audit.append(edits)
        for e in edits:
            turn, role, text = (None, "", "") if e == "I" else self.waiting.popleft()
            if e != "D":
                role = role if e == "K" else ROLES[NEXT[self.state]]
                self.state = role[:1]
            yield e, turn, role, text

    @property
    def gaps(self) -> int:
        return self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0


def faults(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """conv, turn, role, text, fault of each row and whether it is there, sorted in partitions that hold whole conversations."""
    filled = rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(True))).alias("present"),
    )
    same = F.when(F.col("present"), F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))
    before = F.row_number().over(Window.partitionBy("conv", "same").orderBy(F.col("turn").asc_nulls_first())) > 1
    ends = F.regexp_extract("text", f"([^{BLANK}])[{BLANK}]*\\z", 1)
    fault = F.when(~F.col("text").rlike(f"[^{BLANK}]"), "blank").when(F.col("again"), "duplicate").when(~ends.isin(".", "!", "?"), "truncated")
    # the rows that aren't there are dealt by turn: they are all alike, and may be many
    keyed = filled.withColumn("same", F.coalesce(same, F.concat(F.lit("none "), F.xxhash64("turn").cast("string"))))
    judged = keyed.withColumn("again", before).select("conv", "turn", "role", "text", "present", fault.alias("fault"))
    # of equal rows in one turn the first is the one that isn't a duplicate, whose fault sorts before or is null
    first = F.col("fault").eqNullSafe("duplicate")
    return judged.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", first)


def conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Any, Conversation, Iterator[tuple[str, Any, str, str]]]]:
    """(key, conversation, its edits in order) for each in turn; the edits must be read before the next is asked for."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    ahead = next(rows, None)
    while ahead is not None:
        key, one = ahead[0], Conversation()

        def edits(key: Any = key, one: Conversation = one) -> Iterator[tuple[str, Any, str, str]]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                _, turn, role, text, present, fault = ahead
                if present:
                    yield from one.add(turn, role, text, fault)
                ahead = next(rows, None)
            yield from one.finish()

        yield key, one, edits()


def written(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    chars = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for r in rows:
        held.append(r)
        chars += len(r[-1])
        if len(held) >= BATCH or chars >= CHARS:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """The repaired turns: conv, position (from 0 among all edits), edit (K, R, I or D), turn, role, text.

    Deleted turns are there with edit D; `where edit != 'D'` leaves the repaired conversation. Rows for which present is
    false are no turns. Null, repeated and odd rows: see the head of this module.
    """
    schema = T.StructType([T.StructField(conv, rows.schema[conv].dataType), T.StructField("position", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("turn", rows.schema[turn].dataType), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from written(((key, k, *e) for key, _, edits in conversations(batches) for k, e in enumerate(edits)), arrow)

    return faults(rows, conv, turn, role, text, present).mapInArrow(run, schema)


def report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, and the hash of its repaired turns.

    Conversations of which no row is present have zeros, an empty audit and the hash of nothing. The hash is that of
    `role:text` of the turns that are not deleted, joined by newlines.
    """
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([T.StructField(conv, rows.schema[conv].dataType), *(T.StructField(c, T.LongType()) for c in counts), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def one(key: Any, c: Conversation, edits: Iterator[tuple[str, Any, str, str]]) -> tuple:
        sha, first = hashlib.sha256(), True
        for edit, _, role, text in edits:
            if edit != "D":
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        return key, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, c.cost, "".join(c.audit), sha.hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from written((one(*c) for c in conversations(batches)), arrow)

    return faults(rows, conv, turn, role, text, present).mapInArrow(run, schema)


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """conversations with the faults that crc32(`conv_id:turn`) % 20 names, and which rows are present: 0 drops the row, 1 empties
    its text, 2 removes its `[.!?]`, 3 repeats it, 4 makes it the user's. Dropped rows stay as rows that are not present."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(filled[0], F.lit(":"), filled[1])) % 20
    out = rows.select(
        "conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(filled[2]).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled[3], "[.!?]", "")).otherwise(filled[3]).alias("text"),
    )
    out = out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.sequence(F.lit(1), F.lit(1)))))
    return out, F.col("kind") != 0
