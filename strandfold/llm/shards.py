"""Sharding ordered atomic groups into contiguous shards whose largest size is as small as possible.

Groups are ordered by a hash of their key, and a capacity is feasible if filling shards greedily, group by group, needs
no more than the wanted number. The smallest feasible capacity is found by binary search. The driver never sees all
groups: it works on sums of key ranges, and refines only the ranges in which a cut can still fall. A range counts as
divisible for the lower bound of a cut's place and as indivisible for the upper one; when no range of several groups is
left in between, the cuts are those of the search over all groups.

Defined cases: null and empty texts are one group of size 1 a row; an empty table gives no rows; equal groups stay whole
even if one is larger than a fair share (then that is the capacity); repeated rows each get a slot of their own.
Columns of the input with the names of added columns are replaced; others, whatever their names, are kept.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise
from .common import without

#: Keys have this many bits; the first look takes FIRST_BITS of them, each next one STEP_BITS more.
KEY_BITS, FIRST_BITS, STEP_BITS = 62, 12, 5


@dataclass(frozen=True)
class Atom:
    """Groups with keys from ``low`` on that agree in ``bits`` leading bits; ``one`` if it is a single group."""

    low: int
    bits: int
    size: int
    one: bool


def group_key(value: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 64 - KEY_BITS)


def _fill(atoms: list[Atom], sums: list[int], shards: int, capacity: int, divisible: bool) -> list[int] | None:
    """Places of the cuts (total size before them) when shards are filled greedily; None if too many are needed."""
    at, cuts = 0, []
    for _ in range(shards):
        i = bisect_right(sums, at + capacity) - 1
        if i < len(atoms):
            at = at + capacity if divisible and not atoms[i].one else max(sums[i], at)
            if divisible and not atoms[i].one:
                at = min(at, sums[i + 1])
        else:
            at = sums[-1]
        cuts.append(at)
    return cuts if at >= sums[-1] else None


def _smallest(atoms: list[Atom], sums: list[int], shards: int, divisible: bool) -> int:
    """Binary search for the smallest feasible capacity."""
    low, high = -(-sums[-1] // shards), sums[-1]
    while low < high:
        middle = (low + high) // 2
        if _fill(atoms, sums, shards, middle, divisible) is None:
            low = middle + 1
        else:
            high = middle
    return low


def plan_cuts(groups: DataFrame, shards: int) -> list[int]:
    """First keys of shards 1, 2, ...: ``groups`` has one row per key with its ``size``."""
    def look(df: DataFrame, bits: int) -> list[Atom]:
        low = F.shiftleft(F.shiftright("key", KEY_BITS - bits), KEY_BITS - bits)
        rows = df.groupBy(low.alias("low")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).collect()
        return [Atom(r["first"] if r["n"] == 1 else r["low"], bits, r["size"], r["n"] == 1) for r in rows]

    atoms = sorted(look(groups, FIRST_BITS), key=lambda a: a.low)
    if not atoms:
        return []
    while True:
        sums = [0, *accumulate(a.size for a in atoms)]
        best, worst = _smallest(atoms, sums, shards, True), _smallest(atoms, sums, shards, False)
        first, last = _fill(atoms, sums, shards, best, False), _fill(atoms, sums, shards, worst, True)
        first = first or _open_fill(atoms, sums, shards, best)
        open_ = {
            i for a, b in zip(first[:-1], last[:-1], strict=True)
            for i in range(max(0, bisect_right(sums, a) - 1), min(len(atoms), bisect_right(sums, b))) if not atoms[i].one
        }
        if not open_:
            capacity = _smallest(atoms, sums, shards, False)
            cuts = _fill(atoms, sums, shards, capacity, False)
            return [atoms[i].low if (i := bisect_right(sums, c) - 1) < len(atoms) else 1 << KEY_BITS for c in cuts[:-1]]
        fresh: list[Atom] = []
        for bits in sorted({atoms[i].bits for i in open_}):
            lows = [atoms[i].low for i in open_ if atoms[i].bits == bits]
            inside = groups.filter(F.shiftleft(F.shiftright("key", KEY_BITS - bits), KEY_BITS - bits).isin(lows))
            fresh += look(inside, min(KEY_BITS, bits + STEP_BITS))
        atoms = sorted([*(a for i, a in enumerate(atoms) if i not in open_), *fresh], key=lambda a: a.low)


def _open_fill(atoms: list[Atom], sums: list[int], shards: int, capacity: int) -> list[int]:
    """Lower bounds of the cuts where whole ranges do not fit the capacity."""
    at, cuts = 0, []
    for _ in range(shards):
        at = max(at, sums[min(bisect_right(sums, at + capacity) - 1, len(atoms))])
        cuts.append(at)
    return cuts


def assign_shards(docs: DataFrame, shards: int = 16, text: str = "text") -> DataFrame:
    """``docs`` plus ``size`` and ``shard``."""
    base = without(docs, "size", "shard")
    size, key = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1, group_key(F.coalesce(F.col(text), F.lit("")))
    groups = materialise(base.select(key.alias("key"), size.alias("size")).groupBy("key").agg(F.sum("size").alias("size")), "shard_groups")
    cuts = plan_cuts(groups, shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (key >= F.lit(cut)).cast("int")
    return base.select("*", size.alias("size"), shard.cast("int").alias("shard"))


def number_slots(assigned: DataFrame) -> DataFrame:
    """Store the rows sorted by shard inside each partition, and add ``slot``, gapless from 0 in every shard.

    Rows stay where they are: each written file is sorted by shard, so a slot is the row's place in its file plus the
    rows of that shard in earlier files.
    """
    base = without(assigned, "slot")
    held = base.sortWithinPartitions("shard").select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("given"), F.col("shard"))
    stored = materialise(held, "sharded")
    placed = stored.select("given", "shard", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    runs = placed.groupBy("file", "shard").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    joined = placed.join(runs.drop("n"), ["file", "shard"])
    return joined.select("given.*", (F.col("offset") + F.col("at") - F.col("first")).cast("bigint").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, text: str = "text") -> None:
    """One folder ``shard=<n>`` per shard, rows of a shard in as many files as there were tasks."""
    assign_shards(docs, shards, text).write.partitionBy("shard").parquet(path)
