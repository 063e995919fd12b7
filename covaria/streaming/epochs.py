"""Measures over an unbounded stream of epochs: their states are sums, so batches merge."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.operators import bivariate

SCHEMA = "epoch long, x array<array<double>>"


def source(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Files of whole epochs (epoch, x: an array for each channel) as a stream."""
    return spark.readStream.schema(SCHEMA).options(**options).parquet(path)


def whole_epochs(vectors: DataFrame) -> DataFrame:
    """Vectors to the form that a stream has: one row an epoch."""
    return vectors.groupBy("epoch").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "x"))), lambda c: c["x"]).alias("x"))


def cross_spectra(epochs: DataFrame, sfreq: float, bins: np.ndarray) -> DataFrame:
    """Cross-spectra (epoch, seed, target, f, freq, re, im, pxx, pyy) from whole epochs, within the row."""
    bins = np.asarray(bins)

    def of(batches):
        for rows in batches:
            out = []
            for epoch, x in zip(rows["epoch"], rows["x"], strict=True):
                x = np.stack(list(x))
                s = np.fft.rfft((x - x.mean(1, keepdims=True)) * np.hanning(x.shape[1]), axis=1)[:, bins]
                i, j = np.tril_indices(len(x), -1)
                c = 2 * s[i] * s[j].conj()
                n = len(i)
                out.append(pd.DataFrame({"epoch": epoch, "seed": np.repeat(i, len(bins)), "target": np.repeat(j, len(bins)), "f": np.tile(bins, n), "freq": np.tile(bins * sfreq / x.shape[1], n), "re": c.real.ravel(), "im": c.imag.ravel(), "pxx": (2 * np.abs(s[i]) ** 2).ravel(), "pyy": (2 * np.abs(s[j]) ** 2).ravel()}))
            if out:
                yield pd.concat(out)

    return epochs.mapInPandas(of, "epoch long, seed int, target int, f int, freq double, re double, im double, pxx double, pyy double")


def measures(epochs: DataFrame, sfreq: float, bins: np.ndarray, methods: list[str]) -> DataFrame:
    """Values so far; a streaming DataFrame if epochs is one (output mode complete or update)."""
    return bivariate.over_epochs(cross_spectra(epochs, sfreq, bins), methods)
