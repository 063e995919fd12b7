"""Coherency decomposition: filters that maximise coherency in one band, and signals seen through them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import multivariate, spectra


class CoherencyDecomposition:
    """Estimator with fit, transform, fit_transform and get_transformed_indices.

    fit averages the band's cross-spectra over epochs and bins in Spark and keeps the filters of one
    small matrix; transform joins weights with channels and sums, so signals never leave the executors.
    """

    def __init__(self, sfreq: float, indices: tuple[list[int], list[int]], fmin: float, fmax: float, method: str = "cacoh", mode: str = "multitaper", n_components: int | None = None, rank: tuple[int, int] | None = None, freqs=None):
        if method not in ("cacoh", "mic"):
            raise ValueError("method must be 'cacoh' or 'mic'")
        if mode not in ("multitaper", "fourier", "cwt_morlet"):
            raise ValueError("mode must be 'multitaper', 'fourier' or 'cwt_morlet'")
        self.sfreq, self.indices, self.band, self.method, self.mode, self.n_components, self.rank, self.freqs = sfreq, indices, (fmin, fmax), method, mode, n_components, rank, freqs

    def fit(self, vectors: DataFrame) -> CoherencyDecomposition:
        n_times = vectors.select(F.size("x")).first()[0]
        if self.mode == "cwt_morlet":
            freqs = [f for f in self.freqs if self.band[0] <= f <= self.band[1]]
            found = spectra.wavelet(vectors, self.sfreq, freqs, zero_mean=True)
        else:
            bins = spectra.chosen_bins(n_times, self.sfreq, [self.band])
            found = getattr(spectra, self.mode)(vectors, n_times, self.sfreq, bins)
        cross = spectra.csd(found, diagonal=True)
        whole = cross.withColumn("f", F.lit(0)).withColumn("freq", F.lit(sum(self.band) / 2))
        connections = [tuple(list(i) for i in self.indices)]
        rank = self.rank or multivariate.ranks(vectors, connections)[0]
        matrix = multivariate.packed(whole, connections)
        rows = multivariate.coherency(matrix, connections, [self.method], [rank], self.n_components or min(rank)).orderBy("component").collect()  # one small matrix
        self.rank_ = rank
        self.filters_ = tuple(np.array([r[f"{side}_filter"] for r in rows]) for side in ("seed", "target"))
        self.patterns_ = tuple(np.array([r[f"{side}_pattern"] for r in rows]) for side in ("seed", "target"))
        return self

    def transform(self, vectors: DataFrame) -> DataFrame:
        """(epoch, ch, x): components of the seeds, then of the targets."""
        if not hasattr(self, "filters_"):
            raise RuntimeError("fit comes first")
        k = len(self.filters_[0])
        weights = [(side * k + i, ch, float(self.filters_[side][i][j])) for side in (0, 1) for i in range(k) for j, ch in enumerate(self.indices[side])]
        table = F.broadcast(vectors.sparkSession.createDataFrame(weights, "out int, ch int, w double"))  # components * channels rows
        long = vectors.join(table, "ch").select("epoch", "out", F.posexplode("x").alias("t", "v"), "w")
        summed = long.groupBy("epoch", F.col("out").alias("ch"), "t").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
        return summed.groupBy("epoch", "ch").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"]).alias("x"))

    def fit_transform(self, vectors: DataFrame) -> DataFrame:
        return self.fit(vectors).transform(vectors)

    def get_transformed_indices(self) -> tuple[list[int], list[int]]:
        k = len(self.filters_[0])
        return list(range(k)), list(range(k, 2 * k))
