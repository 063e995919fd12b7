"""Weighted symbolic mutual information of ordinal patterns."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covaria.functions import windows

from . import numbering


def alphabet(kernel: int) -> list[tuple[int, ...]]:
    """Orders of kernel samples, numbered so that a reversed one has the number counted from the end."""
    half: list[tuple[int, ...]] = []
    for p in permutations(range(kernel)):
        if p[::-1] not in half:
            half.append(p)
    return half + [p[::-1] for p in reversed(half)]


def symbolised(vectors: DataFrame, kernel: int = 3, tau: int = 1) -> DataFrame:
    """(epoch, ch, s): at each sample the order of kernel samples tau apart, equal ones by position."""
    shortest = vectors.agg(F.min(F.size("x"))).first()[0]
    if shortest is not None and shortest < tau * (kernel - 1) + 1:
        raise ValueError(f"{shortest} samples are too few for {kernel} samples {tau} apart")
    numbers = F.create_map(*[F.lit(x) for i, p in enumerate(alphabet(kernel)) for x in (",".join(map(str, p)), i)])
    ranked = f"transform(array_sort(transform(sequence(0, {kernel - 1}), j -> struct(element_at(x, i + 1 + j * {tau}) as v, j))), o -> cast(o.j as string))"
    orders = F.expr(f"transform(sequence(0, size(x) - {tau * (kernel - 1)} - 1), i -> array_join({ranked}, ','))")
    return vectors.select("epoch", "ch", F.transform(orders, lambda o: F.element_at(numbers, o)).alias("s"))


def bitmaps(found: DataFrame, n: int) -> DataFrame:
    """(epoch, ch, maps, many, size): for each of n symbols where it stands, a bit for each sample in words of 64, and how often."""
    words = F.sequence(F.lit(0), F.floor((F.size("s") - 1) / 64).cast("int"))

    def word(symbol: Column, at: Column) -> Column:
        def mark(state: Column, s: Column) -> Column:
            return F.struct(state["m"].bitwiseOR(F.when(s == symbol, state["bit"]).otherwise(F.lit(0).cast("long"))).alias("m"), F.shiftleft(state["bit"], 1).alias("bit"))

        start = F.struct(F.lit(0).cast("long").alias("m"), F.lit(1).cast("long").alias("bit"))
        return F.aggregate(F.slice("s", at * 64 + 1, 64), start, mark, lambda state: state["m"])

    maps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.transform(words, lambda w: word(k, w)))
    rows = found.select("epoch", "ch", maps.alias("maps"), F.size("s").alias("size"))
    return rows.withColumn("many", F.transform("maps", lambda m: F.aggregate(m, F.lit(0), lambda s, w: s + F.bit_count(w))))


def wsmi(vectors: DataFrame, kernel: int = 3, tau: int = 1, weighted: bool = True) -> DataFrame:
    """(epoch, seed, target, value) for seed > target.

    A channel's symbols become bitmaps once; a joint count is the number of bits that two of them
    share, so what is joined on the epoch is a bit for each symbol and sample, and pairs never leave the JVM.
    """
    n = math.factorial(kernel)
    found = bitmaps(symbolised(vectors, kernel, tau), n)
    side = lambda ch, x: found.select("epoch", F.col("ch").alias(ch), F.struct("maps", "many", "size").alias(x))
    pairs = side("seed", "a").join(side("target", "b"), "epoch").where("seed > target")
    # pairs of symbols that count, those alike and those reversed left out if weighted
    met = [(i, j) for i in range(n) for j in range(n) if not weighted or (i != j and i + j != n - 1)]
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in met]) if n <= 6 else F.filter(F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.struct(F.floor(k / n).cast("int").alias("i"), (k % n).alias("j"))), lambda p: F.lit(not weighted) | ((p["i"] != p["j"]) & (p["i"] + p["j"] != n - 1)))

    def term(p: Column) -> Column:
        shared = F.zip_with(F.get("a.maps", p["i"]), F.get("b.maps", p["j"]), lambda x, y: F.bit_count(x.bitwiseAND(y)))
        return F.struct(F.aggregate(shared, F.lit(0), lambda s, v: s + v).alias("n"), F.get("a.many", p["i"]).alias("a"), F.get("b.many", p["j"]).alias("b"))

    part = lambda s, c: s + F.when(c["n"] > 0, c["n"] / F.col("a.size") * F.log(c["n"].cast("double") * F.col("a.size") / (c["a"].cast("double") * c["b"]))).otherwise(0.0)
    value = F.aggregate(F.transform(table, term), F.lit(0.0), part) / math.log(n)
    return pairs.select("epoch", "seed", "target", value.alias("value"))


#: Samples of a channel that are filtered together, besides those around them.
TOGETHER = 1 << 16


def antialiased(vectors: DataFrame, sfreq: float, kernel: int = 3, tau: int = 1, lowpass: float | None = None, together: int = TOGETHER) -> DataFrame:
    """Vectors below sfreq / kernel / tau: sixth-order Butterworth, both ways, epochs of a channel end to end.

    Skipped where the cut-off is near Nyquist or the signals are known to lie below it. Epochs are
    numbered by channel, which sorts their numbers alone and in stretches, and dealt out in blocks; each block also gets
    the epochs around it until what lies beyond no longer matters. Epochs are equally long.
    """
    cutoff = sfreq / kernel / tau
    if cutoff >= 0.99 * sfreq / 2 or (lowpass is not None and lowpass <= cutoff):
        return vectors
    sections = windows.butterworth(6, cutoff / (sfreq / 2))
    margin = windows.settled_after(sections)

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        x = np.stack(rows["x"].to_numpy())
        y = windows.zero_phase_long(x.ravel(), sections).reshape(x.shape)
        own = (rows["at"] // rows["per"] == rows["block"]).to_numpy()
        out = rows.loc[own, ["epoch", "ch"]]
        return out.assign(x=pd.Series(list(y[own]), index=out.index, dtype=object))

    keys = vectors.select("epoch", "ch")
    placed = numbering.numbered(keys, ["ch"], ["epoch"], numbering.by_value(keys, "epoch")[1], "at")
    rows = vectors.select("epoch", "ch", "x").join(placed, ["epoch", "ch"])
    around, per = F.ceil(F.lit(margin) / F.size("x")).cast("long"), F.ceil(F.lit(together) / F.size("x")).cast("long")
    rows = rows.withColumns({"per": per, "block": F.explode(F.sequence(F.floor(F.greatest(F.col("at") - around, F.lit(0)) / per), F.floor((F.col("at") + around) / per)))})
    return rows.groupBy("ch", "block").applyInPandas(of, "epoch long, ch int, x array<double>")
