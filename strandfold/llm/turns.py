"""Repair of conversation structure: the cheapest edits, and of those the ones that read first, by one integer minimum.

A conversation is repaired row by row with the edits Keep, Rerole, Delete and Insert so that the initials of its roles
are empty or an optional s followed by (ua)+. The edits are paths in an acyclic graph whose nodes are (rows done, last initial). The weight of an edge is one integer: its cost in
the high digits, and in the low digits the rank of the edit's letter at the place where the letter stands. Digits have a
fixed width, letters rank from 1, and places behind the end hold 0, so integers compare as (cost, letters) do and a shorter
text of letters comes before a longer one that begins with it. The least sum of weights over all paths is the answer;
nothing else breaks ties.

A node keeps its least integer only. That is enough although paths differ in length: two paths to a node have as many
letters other than I, so if they cost the same, none begins with the other, and their first difference decides whatever
follows. Nodes too far behind the cheapest to catch up are dropped. Letters that all nodes share are written out and taken from the weights, so weights stay short however long a
conversation is.

Rows are sorted within the partitions of their conversation and streamed: a task holds a batch of rows, and of a
conversation its edits, one letter a row. A digest of a whole conversation is a sequential sum, so a conversation is
one task's work but never one task's memory.

Defined cases: a null role or text is a space; a null conversation id is an id; null turns come first and count in no gap;
rows of equal turn are taken by role and text; repeated rows are duplicates; a text of white space alone is blank;
a role's initial is its first character, '' for an empty role, which cannot be kept; conversations without rows
have an empty repair; an empty table gives no rows. Columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .words import slices

#: Edits by rank; a digit of 0 stands behind the end.
LETTERS = "DIKR"
BASE = len(LETTERS) + 1
RANK = {x: i + 1 for i, x in enumerate(LETTERS)}
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED_COST = 3
#: Which initials may follow the one before; '' is the beginning. A conversation may end after '' and 'a'.
NEXT = {"": {"s", "u"}, "s": {"u"}, "u": {"a"}, "a": {"u"}}
ENDS = ("", "a")
#: What Rerole and Insert can give.
ROLES = {"u": "user", "a": "assistant"}
#: From any node all that can follow another can be had for so much more: two Inserts lead behind an a, where only Keep of
#: an s is not possible, which Delete replaces once. A node that costs more than that beyond the cheapest leads nowhere.
BEHIND = 2 * COST["I"] + COST["D"]
ADJACENT = {"su", "ua", "au"}
#: Letters that weights have room for at first.
WIDTH = 64
SPACES = " \t\n\x0b\x0c\r"


class Frontier:
    """The nodes after some rows: ``live[initial] = weight, letters``; ``written`` holds the letters that all paths share."""

    def __init__(self) -> None:
        self.width, self.unit, self.cost, self.written = WIDTH, BASE**WIDTH, 0, []
        self.live = {"": (0, 0)}
        self._insert()

    def _edge(self, node: tuple[int, int], cost: int, letter: str) -> tuple[int, int]:
        weight, place = node
        return weight + cost * self.unit + RANK[letter] * BASE ** (self.width - 1 - place), place + 1

    def _insert(self) -> None:
        """Follow Insert as long as it leads to a lesser weight."""
        fresh = list(self.live)
        while fresh:
            g = fresh.pop()
            for x in NEXT[g] & ROLES.keys():
                node = self._edge(self.live[g], COST["I"], "I")
                if x not in self.live or node < self.live[x]:
                    self.live[x] = node
                    fresh.append(x)

    def row(self, initial: str, unfit: bool, truncated: bool) -> None:
        """All edits of the next row; an ``unfit`` one can only be deleted."""
        if max(t for _, t in self.live.values()) + len(NEXT) + 1 >= self.width:
            self._shorten()
        more, after = TRUNCATED_COST * truncated, {}
        for g, node in self.live.items():
            edits = [(g, COST["D"], "D")]
            if not unfit:
                edits += [(x, COST["R"] + more, "R") for x in NEXT[g] & ROLES.keys()]
                edits += [(initial, COST["K"] + more, "K")] * (initial in NEXT[g])
            for x, cost, letter in edits:
                found = self._edge(node, cost, letter)
                after[x] = min(found, after.get(x, found))
        self.live = after
        self._insert()
        least = min(self.live.values())[0] // self.unit
        self.live = {g: node for g, node in self.live.items() if node[0] // self.unit <= least + BEHIND}

    def _letters(self, weight: int, count: int) -> str:
        low, out = weight % self.unit // BASE ** (self.width - count), []
        for _ in range(count):
            low, digit = divmod(low, BASE)
            out.append(LETTERS[digit - 1])
        return "".join(reversed(out))

    def _shorten(self) -> None:
        """Write out the letters that all paths share, and widen the weights if that makes too little room."""
        texts = {g: self._letters(*node) for g, node in self.live.items()}
        low, high = min(texts.values()), max(texts.values())
        shared = next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(map(len, texts.values())))
        least = min(w // self.unit for w, _ in self.live.values())
        self.written.append(low[:shared])
        self.cost += least
        width = self.width if 2 * (max(map(len, texts.values())) - shared) < self.width else 2 * self.width
        unit, costs = BASE**width, {g: w // self.unit - least for g, (w, _) in self.live.items()}
        self.live = {g: (costs[g] * unit + sum(RANK[x] * BASE ** (width - 1 - i) for i, x in enumerate(text[shared:])), len(text) - shared) for g, text in texts.items()}
        self.width, self.unit = width, unit

    def answer(self) -> tuple[int, str]:
        """The least cost, and of the cheapest edits the letters that read first."""
        weight, count = min(node for g, node in self.live.items() if g in ENDS)
        return self.cost + weight // self.unit, "".join(self.written) + self._letters(weight, count)


def cheapest_repair(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and letters for rows of (initial, unfit, truncated)."""
    found = Frontier()
    for row in rows:
        found.row(*row)
    return found.answer()


def plain(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` with a space for a null role or text."""
    space = F.lit(" ")
    return conversations.select(
        F.col(f"`{conv}`").cast("bigint").alias("conv_id"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), space).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), space).alias("text"),
    )


def damage(rows: DataFrame) -> DataFrame:
    """Plain rows, some of them damaged as the CRC-32 of their conversation and turn says."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    left = rows.withColumn("fate", fate).filter("fate != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.expr("explode(array_repeat(0, IF(fate = 3, 2, 1)))"))
    return left.drop("col")


def faulty(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``initial`` and ``fault``, the first that holds: blank, duplicate, truncated, or ''."""
    seen = F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    end: Column = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(end == "", "blank").when(seen > 1, "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    return rows.select("*", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), seen.alias("seen"))


def _streamed(heads: DataFrame, rows: DataFrame, *then: str) -> DataFrame:
    """Heads (a row per conversation) and rows together: in one partition per conversation, its head first, then its rows
    by turn, role, text and what ``then`` names."""
    both = heads.withColumn("head", F.lit(True)).unionByName(rows.withColumn("head", F.lit(False)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), F.col("turn").asc_nulls_first(), "role", "text", *then)


DIAGNOSIS = T.StructType([T.StructField("conv_id", T.LongType()), *[T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], T.StructField("audit", T.StringType())])


class _Open:
    """What a conversation has shown so far."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.faults, self.illegal, self.before = conv, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None
        self.first, self.last, self.turns, self.path = None, None, 0, Frontier()

    def row(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if fault:
            self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in ADJACENT
        self.before = initial
        self.path.row(initial, fault in ("blank", "duplicate"), fault == "truncated")

    def found(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults.values(), self.illegal, *self.path.answer())


def diagnose(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Faults and the cheapest edits of every conversation in ``ids`` (conv_id, distinct), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for conv, head, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if head:
                    done += [now.found()] if now else []
                    now = _Open(conv)
                else:
                    now.row(turn, initial, fault)
            if done:
                yield _table(done, DIAGNOSIS)
        if now:
            yield _table([now.found()], DIAGNOSIS)

    # Of equal rows the first seen is the one that stays.
    ordered = _streamed(ids, faulty(rows), "seen").select("conv_id", "head", "turn", "initial", "fault")
    return materialise(ordered.mapInArrow(run, DIAGNOSIS), "diagnosed")


_ARROW = {T.LongType(): pa.int64(), T.StringType(): pa.string()}


def _table(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[f.dataType]) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=schema.names)


class _Replay:
    """Edits of one conversation, applied to its rows as they come. Rerole and Insert give the role that must follow."""

    def __init__(self, conv: int | None, audit: str) -> None:
        self.conv, self.edits, self.after = conv, iter(audit), ""

    def _role(self) -> str:
        self.after = "a" if self.after == "u" else "u"
        return ROLES[self.after]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The repaired rows up to this one: role, text, letter."""
        while (edit := next(self.edits)) == "I":
            yield self._role(), "", edit
        if edit == "K":
            self.after = role[:1]
            yield role, text, edit
        elif edit == "R":
            yield self._role(), text, edit

    def rest(self) -> Iterator[tuple[str, str, str]]:
        for edit in self.edits:
            yield self._role(), "", edit


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str, str]], bool]]:
    """Per row of the stream (conversation, repaired rows, whether it is the last of its conversation)."""
    now = None
    for whole in batches:
        for batch in slices(whole, "text"):
            for conv, head, audit, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if head:
                    if now:
                        yield now.conv, now.rest(), True
                    now = _Replay(conv, audit)
                else:
                    yield conv, now.row(role, text), False
    if now:
        yield now.conv, now.rest(), True


def _with_edits(diagnosed: DataFrame, rows: DataFrame) -> DataFrame:
    return _streamed(diagnosed.select("conv_id", "audit"), rows).select("conv_id", "head", "audit", "role", "text")


REPAIRED = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("edit", T.StringType())])


def repaired(diagnosed: DataFrame, rows: DataFrame) -> DataFrame:
    """``conv_id, position, role, text, edit`` of the conversations after repair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, position = [], 0, 0
        for conv, found, last in _replayed(batches):
            for role, text, edit in found:
                out.append((conv, position, role, text, edit))
                position, size = position + 1, size + len(text)
            position *= not last
            if len(out) >= 4096 or size >= 1 << 20:
                yield _table(out, REPAIRED)
                out, size = [], 0
        if out:
            yield _table(out, REPAIRED)

    return _with_edits(diagnosed, rows).mapInArrow(run, REPAIRED)


DIGEST = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("repaired_sha256", T.StringType())])


def digests(diagnosed: DataFrame, rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: of the repaired rows as role:text, with newlines between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sum_, between = [], hashlib.sha256(), b""
        for conv, found, last in _replayed(batches):
            for role, text, _ in found:
                sum_.update(between + f"{role}:{text}".encode())
                between = b"\n"
            if last:
                out.append((conv, sum_.hexdigest()))
                sum_, between = hashlib.sha256(), b""
            if len(out) >= 4096:
                yield _table(out, DIGEST)
                out = []
        if out:
            yield _table(out, DIGEST)

    return _with_edits(diagnosed, rows).mapInArrow(run, DIGEST)


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired rows of whole conversations."""
    rows = plain(conversations, conv, turn, role, text)
    return repaired(diagnose(rows.select("conv_id").distinct(), rows), rows)
