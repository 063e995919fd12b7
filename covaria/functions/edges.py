"""Which signals are connected with which: edge lists as small DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Link(NamedTuple):
    """What is connected with what: channels, counted from 0 where their number is known."""

    seeds: tuple[int, ...]
    targets: tuple[int, ...]


def _side(named, sets: bool, n_channels: int | None = None) -> tuple[int, ...]:
    """The channels that one side of a link names: a set of them, or a single one."""
    if isinstance(named, (list, tuple, np.ndarray)) != sets:
        raise TypeError(f"expected {'a sequence of channels' if sets else 'a single channel'}, not {named!r}")
    channels = [int(c) for c in (named if sets else [named])]
    if n_channels is not None:
        unknown = sorted(set(channels) - set(range(1 - n_channels, n_channels)))
        if unknown:
            raise ValueError(f"there are {n_channels} channels, none numbered {unknown}")
        channels = [c % n_channels for c in channels]
    if len(set(channels)) < len(channels):
        raise ValueError(f"{named!r} names a channel twice")
    return tuple(channels)


def links(indices, sets: bool = False, n_channels: int | None = None) -> list[Link]:
    """A tuple of seeds and targets as links, in order: of sets of channels, or of single ones.

    Of another shape they raise ValueError; so do channels that don't exist or are named twice in a
    set. Sets instead of single channels, or the other way round, raise TypeError.
    """
    if not (isinstance(indices, tuple) and len(indices) == 2):
        raise ValueError("indices must be a tuple of seeds and of targets")
    return [Link(*(_side(named, sets, n_channels) for named in pair)) for pair in zip(*indices, strict=True)]


def check_indices(indices) -> tuple[list[int], list[int]]:
    """Single channels as two equally long lists; see links."""
    found = links(indices)
    return [s for (s,), _ in found], [t for _, (t,) in found]


def check_multivariate_indices(indices, n_channels: int) -> list[tuple[list[int], list[int]]]:
    """Connections of channel sets, negative channels counted from the end; see links."""
    return [(list(s), list(t)) for s, t in links(indices, True, n_channels)]


def padded_indices(indices, n_channels: int, filler: int = -1) -> np.ndarray:
    """Connections of channel sets as an array (side, connection, channel), filled up to the largest set."""
    found = links(indices, True, n_channels)
    out = np.full((2, len(found), max((len(side) for link in found for side in link), default=0)), filler)
    for con, link in enumerate(found):
        for side, channels in enumerate(link):
            out[side, con, : len(channels)] = channels
    return out


def seed_target_indices(seeds: Sequence[int] | int, targets: Sequence[int] | int) -> tuple[list[int], list[int]]:
    """Every seed with every target, seeds slowest."""
    seeds, targets = ([x] if isinstance(x, int) else list(x) for x in (seeds, targets))
    return [s for s in seeds for _ in targets], targets * len(seeds)


def seed_target_multivariate_indices(seeds: Sequence[Sequence[int]], targets: Sequence[Sequence[int]]) -> tuple[list[list[int]], list[list[int]]]:
    """Every set of seeds with every set of targets."""
    if not all(isinstance(group, (list, tuple, np.ndarray)) for group in (seeds, targets)):
        raise TypeError("seeds and targets must be sequences of sets")
    pairs = [(_side(s, True), _side(t, True)) for s, t in product(seeds, targets)]
    return [list(s) for s, _ in pairs], [list(t) for _, t in pairs]


def multivariate_grid(seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """(con, side, place, ch): every set of seeds with every set of targets, from tables (set, ch) with a row for each channel of a set.

    Sets are numbered in order, seeds slowest; places count a set's channels in order. Both tables are lists of channels.
    """
    from pyspark.sql.window import Window

    def sized(rows: DataFrame, k: str) -> DataFrame:
        found = rows.distinct().groupBy("set").agg(F.array_sort(F.collect_list("ch")).alias(f"{k}_chs"))
        return found.withColumn(k, F.row_number().over(Window.orderBy("set")) - 1).drop("set")

    s, t = sized(seeds, "s"), sized(targets, "t")
    n = t.agg(F.count(F.lit(1)).alias("n"))
    pairs = s.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(n)).withColumn("con", (F.col("s") * F.col("n") + F.col("t")).cast("int"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("s_chs").alias("chs")), F.struct(F.lit(1).alias("side"), F.col("t_chs").alias("chs")))
    return pairs.select("con", F.inline(sides)).select("con", "side", F.posexplode("chs").alias("place", "ch"))


def connections_of(grid: DataFrame) -> tuple[list[list[int]], list[list[int]]]:
    """Indices of sets, for estimators, from a table as multivariate_grid gives it."""
    found = {(r.con, r.side): [c.ch for c in r.chs] for r in grid.groupBy("con", "side").agg(F.array_sort(F.collect_list(F.struct("place", "ch"))).alias("chs")).collect()}
    cons = sorted({con for con, _ in found})
    return [found[c, 0] for c in cons], [found[c, 1] for c in cons]


def edge_list(spark: SparkSession, indices: tuple) -> DataFrame:
    """(con, seed, target) in the order given."""
    seeds, targets = check_indices(indices)
    return spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(zip(seeds, targets, strict=True))], "con int, seed int, target int")


def lower_triangle(channels: DataFrame, ch: str = "ch") -> DataFrame:
    """(seed, target) with seed > target, of a DataFrame of channels."""
    a, b = channels.select(F.col(ch).alias("seed")), channels.select(F.col(ch).alias("target"))
    return a.join(b, F.col("seed") > F.col("target"))


def grid(seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """(con, seed, target): the product of two channel tables in seed-major order; both tables are channel lists."""
    from pyspark.sql.window import Window

    n = targets.select(F.count(F.lit(1)).alias("n"))
    s = seeds.select(F.col("ch").alias("seed"), (F.row_number().over(Window.orderBy("ch")) - 1).alias("i"))
    t = targets.select(F.col("ch").alias("target"), (F.row_number().over(Window.orderBy("ch")) - 1).alias("j"))
    return s.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(n)).select((F.col("i") * F.col("n") + F.col("j")).cast("int").alias("con"), "seed", "target")
