"""Surrogate signals by hash-seeded shuffling, and simulated ones."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.functions import windows

from . import numbering


def _shuffled(vectors: DataFrame, n_shuffles: int) -> DataFrame:
    return vectors.select("epoch", "ch", "x", F.explode(F.sequence(F.lit(0), F.lit(n_shuffles - 1))).alias("shuffle"))


def _draw(seed: int, *columns: str):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def resting(vectors: DataFrame, n_shuffles: int = 1000, seed: int = 0) -> DataFrame:
    """(shuffle, epoch, ch, x): in each shuffle every channel's epochs in an order of its own.

    Epochs of a channel are numbered in order and by hash; a row of the one numbering takes the samples
    of the other. Only numbers are sorted, in stretches, so a channel may have any number of epochs;
    samples move once, in the join.
    """
    keys = vectors.select("epoch", "ch")
    n, stretch = numbering.by_value(keys, "epoch")
    ranked = numbering.numbered(keys, ["ch"], ["epoch"], stretch)
    drawn = ranked.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_shuffles - 1))).alias("shuffle"))
    drawn = drawn.withColumn("draw", _draw(seed, "shuffle", "ch", "epoch"))
    drawn = numbering.numbered(drawn, ["shuffle", "ch"], ["draw", "epoch"], numbering.by_hash("draw", n), "to")
    target = drawn.select("shuffle", "ch", F.col("to").alias("place"), F.col("epoch").alias("taken"))
    moved = drawn.select("shuffle", "ch", "place", "epoch").join(target, ["shuffle", "ch", "place"])
    return moved.join(vectors.select(F.col("epoch").alias("taken"), "ch", "x"), ["taken", "ch"]).select("shuffle", "epoch", "ch", "x")


def evoked(vectors: DataFrame, n_shuffles: int = 1000, seed: int = 0) -> DataFrame:
    """(shuffle, epoch, ch, x): each signal cut at a drawn sample and its two parts swapped; map-only."""
    rows = _shuffled(vectors, n_shuffles).withColumn("n", F.size("x"))
    number = F.conv(F.substring(_draw(seed, "shuffle", "ch", "epoch"), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("cut", (number % (F.col("n") - 1) + 1).cast("int"))
    return rows.select("shuffle", "epoch", "ch", F.concat(F.expr("slice(x, cut + 1, n - cut)"), F.expr("slice(x, 1, cut)")).alias("x"))


def check_resting(vectors: DataFrame) -> None:
    epochs, channels = vectors.agg(F.count_distinct("epoch"), F.count_distinct("ch")).first()
    if epochs < 2 or channels < 2:
        raise ValueError("shuffling epochs takes two epochs and two channels at least")


def surrogate_data(vectors: DataFrame, n_shuffles: int = 1000, seed: int = 0) -> DataFrame:
    """Old name of resting."""
    warnings.warn("surrogate_data is called resting now", FutureWarning, stacklevel=2)
    return resting(vectors, n_shuffles, seed)


def p_values(real: DataFrame, surrogate: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Share of shuffles whose value is at least the real one, by keys."""
    joined = surrogate.select(*keys, F.col(value).alias("_s")).join(real.select(*keys, F.col(value).alias("_r")), keys)
    return joined.groupBy(*keys).agg(F.avg((F.col("_r") <= F.col("_s")).cast("int")).alias("p"))


def signals_in_band(spark: SparkSession, n_seeds: int, n_targets: int, freq_band: tuple[float, float], n_epochs: int = 10, n_times: int | None = None, sfreq: float = 100.0, duration: float | None = None, trans_bandwidth: float = 1.0, snr: float = 0.7, connection_delay: float = 0, connection_time: tuple[float, float] | None = None, window_alpha: float = 0.5, seed: int = 0) -> DataFrame:
    """Vectors whose targets follow their seeds in a band: one epoch a row of spark.range, drawn by its own generator.

    connection_delay in samples if n_times is given, in seconds if duration is; negative: seeds follow.
    """
    if (n_times is None) == (duration is None):
        raise ValueError("give n_times or duration")
    delay = int(connection_delay if duration is None else connection_delay * sfreq)
    n = n_times if duration is None else int(duration * sfreq)
    if not 0 <= snr <= 1 or n_seeds < 1 or n_targets < 1:
        raise ValueError("snr lies between 0 and 1, and there are seeds and targets")
    taps = windows.band_pass(min(2 * (n // 4) + 1, 2 * int(3.3 * sfreq / trans_bandwidth / 2) + 1), *freq_band, trans_bandwidth, sfreq)
    total = n + abs(delay)
    burst = np.ones(total)
    if connection_time is not None:
        first, last = (int(t * sfreq) for t in connection_time)
        burst = np.zeros(total)
        burst[first : last + abs(delay)] = windows.tukey(last + abs(delay) - first, window_alpha)

    def of(batches):
        for rows in batches:
            out = []
            for epoch in rows["id"]:
                rng = np.random.default_rng([seed, int(epoch)])
                source = np.convolve(rng.standard_normal(total + len(taps) - 1), taps, "valid")
                source = source / source.std() * burst
                late, prompt = source[:n], source[abs(delay) :]
                for ch in range(n_seeds + n_targets):
                    own = (late if ch >= n_seeds else prompt) if delay >= 0 else (late if ch < n_seeds else prompt)
                    out.append((epoch, ch, snr * own + (1 - snr) * rng.standard_normal(n)))
            yield pd.DataFrame(out, columns=["epoch", "ch", "x"])

    return spark.range(n_epochs).mapInPandas(of, "epoch long, ch int, x array<double>")


def band_passed(vectors: DataFrame, freq_band: tuple[float, float], sfreq: float, trans_bandwidth: float = 1.0, n_taps: int | None = None) -> DataFrame:
    """(epoch, ch, x): each signal through the linear-phase band-pass, without its delay; map-only.

    Samples before and after an epoch count as zero. n_taps, an odd number, is what the transition takes unless given.
    """
    n_taps = n_taps or 2 * int(3.3 * sfreq / trans_bandwidth / 2) + 1
    if n_taps % 2 == 0:
        raise ValueError("n_taps must be odd, so that the delay is a whole number of samples")
    taps = windows.band_pass(n_taps, *freq_band, trans_bandwidth, sfreq)

    def of(batches):
        for rows in batches:
            found = [np.convolve(x, taps)[n_taps // 2 : n_taps // 2 + len(x)] if len(x) else x for x in rows["x"]]
            yield rows.assign(x=pd.Series(found, index=rows.index, dtype=object))

    return vectors.select("epoch", "ch", F.col("x").cast("array<double>").alias("x")).mapInPandas(of, "epoch long, ch int, x array<double>")


def coupled(vectors: DataFrame, source: int, seeds: list[int], targets: list[int], freq_band: tuple[float, float], sfreq: float, snr: float = 0.7, connection_delay: int = 0, trans_bandwidth: float = 1.0, n_taps: int | None = None) -> DataFrame:
    """Recorded signals in which targets follow seeds in a band: (epoch, ch, x) of the channels named.

    Each gets snr of the source channel's band and keeps the rest of its own signal, both of unit deviation;
    in targets the source comes connection_delay samples later than in seeds, or in seeds if that is negative.
    An epoch without the source, and a signal that doesn't vary, add nothing. One join on the epoch.
    """
    if not 0 <= snr <= 1 or not seeds or not targets or set(seeds) & set(targets):
        raise ValueError("snr lies between 0 and 1, and there are seeds and targets, none of them both")

    def scaled(x):
        total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
        n = F.nullif(F.size(x), F.lit(0))
        level = total(x) / n
        deviation = F.sqrt(total(F.transform(x, lambda e: (e - level) * (e - level))) / n)
        return F.when(deviation > 0, F.transform(x, lambda e: e / deviation)).otherwise(F.transform(x, lambda e: F.lit(0.0)))

    driving = band_passed(vectors.where(F.col("ch") == source), freq_band, sfreq, trans_bandwidth, n_taps).select("epoch", scaled(F.col("x")).alias("s"))
    own = vectors.where(F.col("ch").isin([*seeds, *targets])).select("epoch", "ch", scaled(F.col("x").cast("array<double>")).alias("x"))
    late = F.when(F.col("ch").isin(targets if connection_delay >= 0 else seeds), abs(connection_delay)).otherwise(0)
    # before its first sample the source is zero
    heard = lambda i: F.when(i >= late, F.coalesce(F.get("s", i - late), F.lit(0.0))).otherwise(0.0)
    mixed = F.transform("x", lambda e, i: snr * heard(i) + (1 - snr) * e)
    return own.join(driving, "epoch", "left").select("epoch", "ch", mixed.alias("x"))
