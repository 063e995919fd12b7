"""Sharding: minimax contiguous partition of ordered atomic groups.

Equal texts form a group that no cut may split. Groups are ordered by a digest of their text and
counted by its first digits, into at most 16^``DIGITS`` ordered pieces; so what the driver sees has a
bounded size whatever the corpus has. A binary search over the capacity, each step of which walks the
pieces greedily, finds the smallest capacity under which they fit into the shards. A piece of several
groups in which some cut might lie, at any capacity between that one and the least one conceivable, is
counted again by one digit more, until no such piece is left or both capacities are one; then it is
the smallest feasible capacity over the groups themselves. Of all cuts between pieces within that
capacity those are taken whose shards have the least sum of squared sizes, so one large group doesn't
leave other shards empty.

Defined cases: a null text is a group of its own and counts one byte; an empty table gives an empty
result; repeated rows are kept, each with a slot of its own; ids may be null or repeat (ties in the
order of slots are then open, slots still have no gaps); other columns stay as they are, whatever
their names, but size, shard and slot, which are replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, row_key, rows_with

#: Hexadecimal digits that name a piece at first, and parts that the rows of a text are spread over.
DIGITS, SPREAD = 3, 1024


class Piece(NamedTuple):
    """Groups whose digests begin alike: the bytes of all and of the largest, and how many they are."""

    prefix: str
    size: int
    largest: int
    groups: int


def greedy_cuts(sizes: list[int], capacity: int) -> list[int]:
    """Where a walk closes a shard: positions of the first atom of each shard but the first."""
    cuts, held = [], 0
    for i, size in enumerate(sizes):
        if held + size > capacity and held:
            cuts.append(i)
            held = 0
        held += size
    return cuts


def least_feasible(low: int, high: int, fits: Callable[[int], bool]) -> int:
    """The smallest capacity that fits, by binary search; high does."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def minimax(sizes: list[int], n_shards: int) -> int:
    """The smallest capacity within which a contiguous partition into at most n_shards can stay."""
    return least_feasible(max(sizes, default=0), sum(sizes), lambda c: len(greedy_cuts(sizes, c)) < n_shards)


def minimax_cuts(sizes: list[int], n_shards: int) -> list[int]:
    """Cuts of a contiguous partition into at most n_shards whose largest shard is smallest."""
    return even_cuts(sizes, n_shards, minimax(sizes, n_shards))


def furthest(pieces: list[Piece], ends: list[int], capacity: int, n_shards: int) -> list[int]:
    """Where each shard of a greedy walk would end, in bytes, if pieces of several groups could be cut anywhere."""
    at, out = 0, []
    for _ in range(n_shards):
        at = min(at + capacity, ends[-1])
        i = bisect_right(ends, at) - 1
        if at < ends[-1] and pieces[i].groups == 1:
            at = ends[i]
        out.append(at)
    return out


def undecided(pieces: list[Piece], n_shards: int) -> list[int]:
    """Which pieces of several groups must be looked into for the smallest capacity; none if it is that of the pieces."""
    sizes = [p.size for p in pieces]
    ends = [0, *accumulate(sizes)]
    high = minimax(sizes, n_shards)
    low = least_feasible(max((p.largest for p in pieces), default=0), high, lambda c: furthest(pieces, ends, c, n_shards)[-1] == ends[-1])
    if low == high:
        return []
    too_large = [i for i, p in enumerate(pieces) if p.groups > 1 and p.size > low]
    if too_large:
        return too_large
    # a cut of a walk over the groups lies no earlier than that of the pieces at the least capacity, no later than that of divisible pieces at the greatest
    earliest = [ends[c] for c in greedy_cuts(sizes, low)[: n_shards - 1]]
    latest = furthest(pieces, ends, high, n_shards)
    return [i for i, p in enumerate(pieces) if p.groups > 1 and any(ends[i + 1] > a and ends[i] < b for a, b in zip(earliest, latest, strict=False))]


def even_cuts(sizes: list[int], n_shards: int, capacity: int) -> list[int]:
    """Of the cuts into shards within a capacity that can be met those with the least sum of squared sizes.

    Shard by shard, the best last cut before each atom; it never moves back from an atom to the next,
    so each step halves the atoms and what is left to search for them.
    """
    n = len(sizes)
    n_shards = min(n_shards, n)
    ends, whole = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]) if n else np.zeros(1, np.int64), max(1, sum(sizes))
    best, lasts = np.where(np.arange(n + 1) == 0, 0.0, np.inf), []
    for k in range(1, n_shards + 1):
        now, last = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        todo = [(k, n, k - 1, n - 1)]
        while todo:
            first, final, low, high = todo.pop()
            if first > final:
                continue
            middle = (first + final) // 2
            top = min(high, middle - 1)
            held = ends[middle] - ends[low : top + 1]
            cost = np.where(held <= capacity, best[low : top + 1] + (held / whole) ** 2, np.inf)
            at = int(cost.argmin())
            if np.isinf(cost[at]):  # nor do more atoms fit into so few shards
                todo.append((first, middle - 1, low, high))
                continue
            now[middle], last[middle] = cost[at], low + at
            todo += [(first, middle - 1, low, low + at), (middle + 1, final, low + at, high)]
        best = now
        lasts.append(last)
    cuts, end = [], n
    for last in reversed(lasts[1:]):
        end = int(last[end])
        cuts.append(end)
    return cuts[::-1]


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def digest_of(text: Column) -> Column:
    """What orders groups; that of the null text comes first."""
    return F.coalesce(F.md5(text), F.lit(""))


def boundaries(groups: DataFrame, n_shards: int, digits: int = DIGITS) -> list[str]:
    """Groups (digest, size), written, to the digests from which each shard but the first begins."""

    def counted(rows: DataFrame, digits: int) -> list[Piece]:
        prefix = F.substring("digest", 1, digits).alias("prefix")
        return [Piece(*r) for r in rows.groupBy(prefix).agg(F.sum("size"), F.max("size"), F.count(F.lit(1))).collect()]

    pieces = sorted(counted(groups, digits))  # at most 16^digits
    while found := undecided(pieces, n_shards):
        inside, gone = [], {pieces[i].prefix for i in found}
        for n in {len(p) for p in gone}:
            inside += counted(groups.where(F.substring("digest", 1, n).isin([p for p in gone if len(p) == n])), n + 1)
        pieces = sorted([p for p in pieces if p.prefix not in gone] + inside)
    return [pieces[i].prefix for i in minimax_cuts([p.size for p in pieces], n_shards)]


def _placed(rows: DataFrame, n_shards: int, digits: int) -> DataFrame:
    """Rows (k1, k2, id, size, digest and others) to kinds of rows, with many, shard and at: how many rows of the shard stand before.

    Slots follow the digest's first digits, then a spread of ids, so that a group of copies that holds
    much of the corpus is never sorted in one task; rows alike in all columns are one row with a number.
    """
    kinds = cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("many")))
    groups = cut(kinds.groupBy("digest").agg(F.sum(F.col("size") * F.col("many")).alias("size")))
    starts = boundaries(groups, n_shards, digits)
    shard_no = sum((F.when(F.col("digest") >= b, 1).otherwise(0) for b in starts), F.lit(0)).cast("int")
    key = F.when(F.col("id").isNull(), F.col("k1")).otherwise(F.xxhash64("id"))
    cell = ["shard", "piece", "spread"]
    kinds = kinds.withColumns({"shard": shard_no, "piece": F.substring("digest", 1, digits), "spread": F.pmod(key, F.lit(SPREAD)).cast("int")})
    before = Window.partitionBy("shard").orderBy("piece", "spread").rowsBetween(Window.unboundedPreceding, -1)
    cells = kinds.groupBy(*cell).agg(F.sum("many").alias("n"))  # at most 16^digits * SPREAD
    cells = cells.select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(*cell).orderBy("digest", "id", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("many").over(within), F.lit(0))
    return kinds.withColumn("ahead", ahead).join(cells, cell).withColumn("at", F.col("before") + F.col("ahead"))


def _slots(kinds: DataFrame) -> DataFrame:
    """A row for each row of a kind, with its slot."""
    return kinds.withColumn("slot", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("many") - 1)))


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", digits: int = DIGITS) -> DataFrame:
    """docs with size (long), shard (int) and slot (long, gapless from 0 within the shard); texts move once."""
    docs = docs.drop("size", "shard", "slot")
    narrow = docs.select(*row_key(docs), F.col(id_col).alias("id"), size_of(F.col(text_col)).alias("size"), digest_of(F.col(text_col)).alias("digest"))
    kinds = _placed(narrow, n_shards, digits).select("k1", "k2", "many", F.struct("many", "at", "size", "shard").alias("found"))
    rows = _slots(rows_with(docs, cut(kinds), "found").select("doc", "found.*"))
    return rows.select("doc.*", "size", "shard", "slot")


def digest(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """The rows of op3: what each document is, and where it went."""
    text = F.col("text")
    narrow = docs.select(F.col("doc_id").alias("id"), size_of(text).alias("size"), F.crc32(text).cast("long").alias("text_crc32"), digest_of(text).alias("digest"))
    placed = _slots(_placed(narrow.select("*", *row_key(narrow)), n_shards, DIGITS))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
