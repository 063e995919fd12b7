"""The library's operators as registered queries over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import covaria
from covaria.functions import edges, windows
from covaria.operators import autoregression, bivariate, envelope, multivariate, spectra, surrogates, symbols
from covaria.plans.frame import ConnFrame, Meta, degree, read_connectivity
from covaria.sources import signals
from covaria.streaming import epochs as streaming
from covaria.streaming import samples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SFREQ, N = 24.0, 24
#: Channels and samples of days().
SHAPE = (5, N)
BINS = list(range(1, 12))
FREQS, CYCLES = [4.0, 6.0, 8.0], 2.0
BANDS = [(2.0, 6.0), (5.0, 11.0)]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(c), places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one that the cluster names, and only where there is none but this machine the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    return warehouse.rstrip("/")


def days(spark: SparkSession, sf: str) -> DataFrame:
    return signals.events(table(spark, sf, "events"))


def _fourier(vectors: DataFrame) -> DataFrame:
    return spectra.fourier(vectors, N, SFREQ, BINS)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Coherence, imaginary coherence and phase lag index between all event types by daily cycle."""
    return rounded(bivariate.over_epochs(spectra.csd(_fourier(days(spark, sf))), ["coh", "imcoh", "pli"]))


# signals, edges, frequencies


@query
def signals_dense(spark, sf):
    return rounded(signals.to_long(days(spark, sf)))


@query
def signals_time_window(spark, sf):
    return rounded(signals.to_long(signals.window(days(spark, sf), SFREQ, 6 / 24, 18 / 24)))


@query
def signals_drop_bads(spark, sf):
    return rounded(signals.to_long(signals.without(days(spark, sf), [1, 3])))


@query
def signals_orders(spark, sf):
    return rounded(signals.to_long(signals.orders(table(spark, sf, "orders"))), 2)


@query
def signals_embeddings(spark, sf):
    return rounded(signals.to_long(signals.embeddings(table(spark, sf, "embeddings"))))


@query
def signals_stacked(spark, sf):
    x = days(spark, sf)
    return rounded(signals.to_long(signals.stacked(signals.without(x, [2, 3, 4]), x.where("ch = 2"))))


@query
def signals_selected(spark, sf):
    """Epochs of chosen events: here the day of the week is an epoch's code."""
    x = days(spark, sf)
    codes = x.select("epoch").distinct().select("epoch", (F.col("epoch") % 7).cast("int").alias("code"))
    return rounded(signals.to_long(signals.selected(x, codes, [2, 3])))


@query
def edges_lower_tri(spark, sf):
    return edges.lower_triangle(signals.channels_of(table(spark, sf, "events"), "event_type"))


@query
def edges_seed_target(spark, sf):
    channels = signals.channels_of(table(spark, sf, "events"), "event_type")
    return edges.grid(channels.where("ch < 2"), channels.where("ch >= 2"))


@query
def edges_prune_channels(spark, sf):
    named = edges.edge_list(spark, ([0, 4], [2, 2]))
    return rounded(signals.to_long(signals.only(days(spark, sf), named)))


def _samples(spark, sf) -> int:
    """How many samples the longest day of the events has."""
    return days(spark, sf).agg(F.max(F.size("x"))).first()[0] or 0


@query
def freq_grid(spark, sf):
    """The frequencies that days of so many samples have."""
    n = days(spark, sf).agg(F.max(F.size("x")).alias("n"))
    return n.select("n", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 2).cast("int"))).alias("f")).select("f", (F.col("f") * SFREQ / F.col("n")).alias("freq"))


@query
def freq_mask_bands(spark, sf):
    bins = spectra.chosen_bins(_samples(spark, sf), SFREQ, BANDS)
    return spark.createDataFrame([(int(b), float(b)) for b in bins], "f int, freq double")


@query
def freq_decimate(spark, sf):
    return spark.createDataFrame([(int(b),) for b in spectra.chosen_bins(_samples(spark, sf), SFREQ, BANDS, 3)], "f int")


@query
def band_nearest(spark, sf):
    grid = freq_grid(spark, sf)
    asked = spark.createDataFrame([(0, 2.2), (1, 6.7), (2, 11.6)], "band int, edge double")
    return grid.crossJoin(F.broadcast(asked)).groupBy("band").agg(F.min_by("f", F.struct(F.abs(F.col("freq") - F.col("edge")), "f")).alias("f"))  # three edges


@query
def edges_multivariate(spark, sf):
    """Every set of seeds with every set of targets: a row for each channel of a side."""
    first, *_, last = sorted(r.ch for r in signals.channels_of(table(spark, sf, "events"), "event_type").collect())
    found = edges.seed_target_multivariate_indices([[first, first + 1], [first + 2]], [[last - 1], [last, first]])
    rows = [(con, side, at, ch) for side, sets in enumerate(found) for con, channels in enumerate(sets) for at, ch in enumerate(channels)]
    return spark.createDataFrame(rows, "con int, side int, place int, ch int")


@query
def edges_padded(spark, sf):
    """Sets of different sizes, negative channels counted from the end, filled up with -1."""
    n = signals.channels_of(table(spark, sf, "events"), "event_type").count()
    found = edges.padded_indices(([[0, 1, 2], [3]], [[-1], [0, -3]]), n)
    rows = [(side, con, at, int(ch)) for side, sets in enumerate(found) for con, channels in enumerate(sets) for at, ch in enumerate(channels)]
    return spark.createDataFrame(rows, "side int, con int, place int, ch int")


def _channel_sets(spark, sf) -> DataFrame:
    """Sets from the events: the channels above and those not above the mean number of events as seeds and targets, one or two a set."""
    events = table(spark, sf, "events")
    counted = signals.channels_of(events, "event_type").join(events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), F.col("name") == F.col("event_type"))
    mean = events.agg((F.count(F.lit(1)) / F.count_distinct("event_type")).alias("mean"))
    rows = counted.crossJoin(F.broadcast(mean)).select("ch", (F.col("n") > F.col("mean")).alias("often"))  # one row
    sets = lambda often: rows.where("often" if often else "NOT often").select(F.floor(F.col("ch") / 2).cast("int").alias("set"), "ch")
    return edges.multivariate_grid(sets(True), sets(False))


@query
def edges_sets_of_events(spark, sf):
    """Every set of frequent event types with every set of rare ones."""
    return _channel_sets(spark, sf)


@query
def spectra_decimated(spark, sf):
    """Spectra at every third bin of two bands."""
    found = spectra.fourier(days(spark, sf), N, SFREQ, spectra.chosen_bins(N, SFREQ, BANDS, 3))
    return rounded(found.select("epoch", "ch", "f", "re", "im"), 4)


@query
def mim_every_set(spark, sf):
    """Every seed with every target as sets of one channel, numbered seeds slowest."""
    channels = signals.channels_of(table(spark, sf, "events"), "event_type").select(F.col("ch").alias("set"), "ch")
    grid = edges.multivariate_grid(channels.where("ch < 2"), channels.where("ch >= 2"))
    frame = covaria.spectral_connectivity_epochs(days(spark, sf), "mim", indices=edges.connections_of(grid), sfreq=SFREQ, mode="fourier", fmin=1, fmax=11, rank=([1] * 6, [1] * 6), shape=SHAPE)
    return rounded(frame.df.select("con", "f", "value"))


@query
def plv_time_multitaper(spark, sf):
    frame = covaria.spectral_connectivity_time(days(spark, sf), FREQS, "plv", sfreq=SFREQ, mode="multitaper", n_cycles=CYCLES, shape=SHAPE)
    return rounded(frame.df.select("epoch", "seed", "target", "f", "value"), 5)


@query
def refused(spark, sf):
    """What estimators say to input that makes no sense, by the kind of error."""
    x, coh = days(spark, sf), {"method": "coh", "sfreq": SFREQ, "shape": SHAPE}
    frame = lambda: ConnFrame(x.selectExpr("epoch", "ch AS seed", "ch AS target", "0D AS value"), Meta("coh", 5))
    calls = {
        "band without a bin": lambda: covaria.spectral_connectivity_epochs(x, mode="fourier", fmin=4.2, fmax=4.8, **coh),
        "band upside down": lambda: covaria.spectral_connectivity_epochs(x, mode="fourier", fmin=8, fmax=4, **coh),
        "unknown mode": lambda: covaria.spectral_connectivity_epochs(x, mode="none", fmin=1, **coh),
        "unknown measure": lambda: covaria.spectral_connectivity_epochs(x, "none", sfreq=SFREQ, mode="fourier", fmin=1, shape=SHAPE),
        "sets and pairs mixed": lambda: covaria.spectral_connectivity_epochs(x, ["coh", "mim"], sfreq=SFREQ, mode="fourier", fmin=1, shape=SHAPE),
        "causality without indices": lambda: covaria.spectral_connectivity_epochs(x, "gc", sfreq=SFREQ, mode="fourier", fmin=1, shape=SHAPE),
        "causality of a channel with itself": lambda: covaria.spectral_connectivity_epochs(x, "gc", ([[0]], [[0, 1]]), SFREQ, "fourier", fmin=1, shape=SHAPE),
        "falling freqs": lambda: covaria.spectral_connectivity_time(x, [8, 4], **coh),
        "freqs above Nyquist": lambda: covaria.spectral_connectivity_time(x, [8, 13], **coh),
        "padding that leaves nothing": lambda: covaria.spectral_connectivity_time(x, FREQS, padding=0.5, **coh),
        "smoothing times for other freqs": lambda: covaria.spectral_connectivity_time(x, FREQS, sm_times=[0.1], **coh),
        "sets where channels are due": lambda: edges.check_indices(([[0]], [1])),
        "seeds and targets of different number": lambda: edges.check_indices(([0, 1], [1])),
        "no such channel": lambda: edges.check_multivariate_indices(([[5]], [[0]]), 5),
        "a channel twice": lambda: edges.check_multivariate_indices(([[1, 1]], [[0]]), 5),
        "prediction without a model": lambda: frame().predict(x),
        "orthogonalisation of no kind": lambda: covaria.envelope_correlation(x, "other", shape=SHAPE),
        "singular cross-spectrum": lambda: multivariate.imaginary(np.ones((4, 4), complex), 2, None, False, 1),
        "singular autocovariance": lambda: multivariate.granger(np.ones((9, 2, 2), complex), 1, 2),
        "more lags than frequencies": lambda: multivariate.granger(np.ones((3, 2, 2), complex), 1, 4),
    }
    rows = []
    for case, call in calls.items():
        try:
            call()
            rows.append((case, None))
        except Exception as error:
            rows.append((case, type(error).__name__))
    return spark.createDataFrame(rows, "what string, error string")


# spectra


@query
def spectra_fourier(spark, sf):
    return rounded(_fourier(days(spark, sf)).select("epoch", "ch", "f", "re", "im"), 4)


@query
def spectra_multitaper(spark, sf):
    found = spectra.multitaper(days(spark, sf), N, SFREQ, BINS)
    return rounded(found.select("epoch", "ch", "taper", "f", "re", "im"), 4)


@query
def psd_fourier(spark, sf):
    return rounded(spectra.psd(_fourier(days(spark, sf))).select("epoch", "ch", "f", "power"), 3)


@query
def csd_fourier(spark, sf):
    return rounded(spectra.csd(_fourier(days(spark, sf))).select("epoch", "seed", "target", "f", "re", "im"), 3)


@query
def spectra_adaptive(spark, sf):
    found = spectra.multitaper_adaptive(days(spark, sf), N, SFREQ, BINS)
    return rounded(bivariate.over_epochs(spectra.csd(found), ["coh"]))


# measures over epochs


def _measure(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        values = bivariate.over_epochs(spectra.csd(_fourier(days(spark, sf))), [name])
        return rounded(values.drop("freq"))

    return run


for _name in bivariate.EPOCHS:
    QUERIES[_name] = _measure(_name)


@query
def all_measures(spark, sf):
    return rounded(bivariate.over_epochs(spectra.csd(_fourier(days(spark, sf))), [m for m in bivariate.EPOCHS if m != "cohy"]).drop("freq"))


@query
def custom_measure(spark, sf):
    """A measure of one's own: the mean phase difference's cosine, in states and a value."""
    own = bivariate.Measure(("ure", "uim"), "CASE WHEN ure = 0 AND uim = 0 THEN 0d ELSE ure / sqrt(ure * ure + uim * uim) END")
    registry = {"phase_cosine": own}
    return rounded(bivariate._aggregated(spectra.csd(_fourier(days(spark, sf))), ["seed", "target", "f"], ["phase_cosine"], registry))


@query
def coh_faverage(spark, sf):
    values = bivariate.over_epochs(spectra.csd(_fourier(days(spark, sf))), ["coh"])
    return rounded(bivariate.banded(values, BANDS))


@query
def coh_indices(spark, sf):
    pairs = edges.edge_list(spark, ([0, 3, 0], [1, 2, 1]))
    return rounded(bivariate.over_epochs(spectra.csd(_fourier(days(spark, sf)), pairs), ["coh"]).drop("freq"))


@query
def coh_five_cycles(spark, sf):
    """Without a lower edge: from where an epoch holds five cycles."""
    frame = covaria.spectral_connectivity_epochs(days(spark, sf), "coh", sfreq=SFREQ, mode="fourier", fmax=11, shape=SHAPE)
    return rounded(frame.df.select("seed", "target", "f", "value"))


@query
def coh_all_to_all_dense(spark, sf):
    frame = covaria.spectral_connectivity_epochs(days(spark, sf), "coh", sfreq=SFREQ, mode="fourier", fmin=1, fmax=11, shape=SHAPE)
    return rounded(frame.get_data("dense").select("seed", "target", "f", "value"))


@query
def coh_multitaper(spark, sf):
    values = bivariate.over_epochs(spectra.csd(spectra.multitaper(days(spark, sf), N, SFREQ, BINS)), ["coh", "wpli"])
    return rounded(values.drop("freq"))


@query
def coh_embeddings(spark, sf):
    found = spectra.fourier(signals.embeddings(table(spark, sf, "embeddings")), 64, 64.0, range(1, 32))
    return rounded(bivariate.over_epochs(spectra.csd(found), ["coh", "imcoh", "plv"]).drop("freq"))


@query
def coh_from_spectra(spark, sf):
    frame = covaria.spectral_connectivity_epochs(_fourier(days(spark, sf)), "coh", fmin=2, fmax=6, shape=SHAPE)
    return rounded(frame.df.select("seed", "target", "f", "value"))


@query
def psi_fourier(spark, sf):
    cohy = bivariate.over_epochs(spectra.csd(_fourier(days(spark, sf))), ["cohy"])
    return rounded(bivariate.phase_slope(cohy, [(-1e9, 1e9)]))


@query
def psi_bands(spark, sf):
    cohy = bivariate.over_epochs(spectra.csd(_fourier(days(spark, sf))), ["cohy"])
    return rounded(bivariate.phase_slope(cohy, BANDS))


# wavelets and measures over time


def _tfr(spark: SparkSession, sf: str, **options) -> DataFrame:
    return spectra.wavelet(days(spark, sf), SFREQ, FREQS, CYCLES, **options)


@query
def tfr_wavelet(spark, sf):
    return rounded(_tfr(spark, sf).select("epoch", "ch", "f", "t", "re", "im"), 4)


@query
def tfr_multitaper(spark, sf):
    return rounded(spectra.psd(spectra.tapered_tfr(days(spark, sf), SFREQ, FREQS, CYCLES)), 3)


@query
def coh_cwt_epochs(spark, sf):
    return rounded(bivariate.over_epochs(spectra.csd(_tfr(spark, sf, zero_mean=True, whole=True)), ["coh"]).drop("freq"))


def _in_time(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(bivariate.over_time(spectra.csd(_tfr(spark, sf, whole=True), whole=True), [name]).drop("freq"))

    return run


for _name in bivariate.TIME:
    QUERIES[f"{_name}_time"] = _in_time(_name)


@query
def time_average(spark, sf):
    return rounded(bivariate.over_time(spectra.csd(_tfr(spark, sf, whole=True), whole=True), ["coh"], average=True).drop("freq"))


@query
def coh_from_tfr(spark, sf):
    frame = covaria.spectral_connectivity_time(_tfr(spark, sf), FREQS, "coh", sfreq=SFREQ, shape=SHAPE)
    return rounded(frame.df.select("epoch", "seed", "target", "f", "value"))


@query
def time_faverage(spark, sf):
    values = bivariate.over_time(spectra.csd(_tfr(spark, sf, whole=True), whole=True), ["coh"])
    return rounded(bivariate.foi_banded(values, FREQS, [(4, 6), (6, 8), (8, 8)]).drop("freq"))


@query
def time_smoothed_square(spark, sf):
    cross = spectra.smoothed_csd(_tfr(spark, sf, whole=True), windows.smoothing_kernel(3, 1, "square"))
    return rounded(bivariate.over_time(cross, ["coh"]).drop("freq"))


@query
def time_smoothed_hanning(spark, sf):
    cross = spectra.smoothed_csd(_tfr(spark, sf, whole=True), windows.smoothing_kernel(5, 3, "hanning"))
    return rounded(bivariate.over_time(cross, ["coh"]).drop("freq"))


@query
def time_smoothed_by_freq(spark, sf):
    """A kernel of its own for each frequency: five, three and one samples long."""
    frame = covaria.spectral_connectivity_time(days(spark, sf), FREQS, "coh", sfreq=SFREQ, n_cycles=CYCLES, sm_times=[5 / SFREQ, 3 / SFREQ, 1 / SFREQ], sm_kernel="square", shape=SHAPE)
    return rounded(frame.df.select("epoch", "seed", "target", "f", "value"))


@query
def time_padding(spark, sf):
    return rounded(bivariate.over_time(spectra.csd(_tfr(spark, sf, padding=4, whole=True), whole=True), ["wpli"]).drop("freq"))


@query
def time_decimated(spark, sf):
    return rounded(bivariate.over_time(spectra.csd(_tfr(spark, sf, decim=2, whole=True), whole=True), ["plv"]).drop("freq"))


@query
def psi_time(spark, sf):
    cohy = bivariate.over_time(spectra.csd(_tfr(spark, sf, whole=True), whole=True), ["cohy"])
    return rounded(bivariate.phase_slope(cohy, [(3, 9)]))


# envelopes


@query
def analytic_signal(spark, sf):
    found = envelope.analytic(days(spark, sf)).select("epoch", "ch", F.posexplode(F.arrays_zip("re", "im")).alias("t", "z"))
    return rounded(found.select("epoch", "ch", "t", "z.re", "z.im"), 4)


def _envelope(spark: SparkSession, sf: str, **options) -> ConnFrame:
    return covaria.envelope_correlation(days(spark, sf), shape=SHAPE, **options)


@query
def envcorr_plain(spark, sf):
    return rounded(_envelope(spark, sf, orthogonalize=False).df)


@query
def envcorr_pairwise(spark, sf):
    return rounded(_envelope(spark, sf).df)


@query
def envcorr_log(spark, sf):
    """Over embeddings: days have envelopes of zero, of which there is no logarithm."""
    return rounded(covaria.envelope_correlation(signals.embeddings(table(spark, sf, "embeddings")), log=True).df)


@query
def envcorr_combine_mean(spark, sf):
    return rounded(_envelope(spark, sf).combine("mean").df)


@query
def envcorr_combine_median(spark, sf):
    return rounded(_envelope(spark, sf).combine("median").df)


@query
def envcorr_combine_custom(spark, sf):
    return rounded(_envelope(spark, sf).combine(lambda v: v.max() - v.min()).df)


@query
def analytic_signal_padded(spark, sf):
    """Of days without their first hour, whose 23 samples are padded to transform fast."""
    x = envelope.analytic(signals.window(days(spark, sf), SFREQ, 1 / 24))
    x = x.select("epoch", "ch", F.posexplode(F.arrays_zip("re", "im")).alias("t", "z"))
    return rounded(x.select("epoch", "ch", "t", "z.re", "z.im"), 4)


@query
def symmetric_orth(spark, sf):
    """Products of the orthogonalised signals: nothing off the diagonal."""
    x = signals.to_long(covaria.symmetric_orth(days(spark, sf)))
    a, b = x.select("epoch", "t", F.col("ch").alias("i"), F.col("value").alias("v")), x.select("epoch", "t", F.col("ch").alias("j"), F.col("value").alias("w"))
    return rounded(a.join(b, ["epoch", "t"]).where("i >= j").groupBy("epoch", "i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("product")), 3)


def _pairs(vectors: DataFrame) -> DataFrame:
    """Every pair of channels as two channels, 0 and 1, of an epoch of its own: (epoch * 100 + pair)."""
    number = F.col("a") * 10 + F.col("b")  # of five channels
    a, b = vectors.select("epoch", F.col("ch").alias("a"), F.col("x").alias("xa")), vectors.select("epoch", F.col("ch").alias("b"), F.col("x").alias("xb"))
    return a.join(b, "epoch").where("a < b").select((F.col("epoch") * 100 + number).alias("epoch"), F.posexplode(F.array("xa", "xb")).alias("ch", "x"))


@query
def symmetric_orth_pairs(spark, sf):
    """Products of the signals of each pair, orthogonalised, with those that they come from."""
    pairs = _pairs(days(spark, sf))
    near, x = signals.to_long(covaria.symmetric_orth(pairs)), signals.to_long(pairs)
    joined = near.select("epoch", "t", F.col("ch").alias("i"), F.col("value").alias("v")).join(x.select("epoch", "t", F.col("ch").alias("j"), F.col("value").alias("w")), ["epoch", "t"])
    return rounded(joined.groupBy("epoch", "i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("product")), 2)


# symbols


@query
def wsmi_k3(spark, sf):
    return rounded(symbols.wsmi(days(spark, sf)))


@query
def smi_k3(spark, sf):
    return rounded(symbols.wsmi(days(spark, sf), weighted=False))


@query
def wsmi_tau2(spark, sf):
    return rounded(symbols.wsmi(days(spark, sf), tau=2))


@query
def wsmi_avg(spark, sf):
    return rounded(covaria.wsmi(days(spark, sf), sfreq=SFREQ, anti_aliasing=False, average=True, shape=SHAPE).df)


@query
def wsmi_window(spark, sf):
    """Only samples of a window, cut after any filter."""
    return rounded(covaria.wsmi(days(spark, sf), sfreq=SFREQ, anti_aliasing=False, tmin=6 / 24, tmax=18 / 24, shape=SHAPE).df)


@query
def wsmi_antialias(spark, sf):
    return rounded(covaria.wsmi(days(spark, sf), sfreq=SFREQ, tau=2, shape=SHAPE).df)


# autoregression


@query
def var1_dynamic(spark, sf):
    return rounded(autoregression.fit(days(spark, sf)))


@query
def var1_pooled(spark, sf):
    return rounded(autoregression.fit(days(spark, sf), model="avg-epochs").drop("epoch"))


@query
def var_ridge(spark, sf):
    return rounded(autoregression.fit(days(spark, sf), l2_reg=100.0))


@query
def var_ridge_pooled(spark, sf):
    return rounded(autoregression.fit(days(spark, sf), l2_reg=100.0, model="avg-epochs").drop("epoch"))


@query
def var_predict(spark, sf):
    x = days(spark, sf)
    return rounded(autoregression.predicted(x, autoregression.fit(x)), 4)


@query
def var_residual(spark, sf):
    x = days(spark, sf)
    seen = autoregression.predicted(x, autoregression.fit(x)).where("t > 0")
    return rounded(seen.select("epoch", "ch", "t", (F.col("value") - F.col("predicted")).alias("residual")), 4)


@query
def var_residual_cov(spark, sf):
    return rounded(autoregression.residual_covariance(days(spark, sf)), 2)


@query
def var_p_dynamic(spark, sf):
    return rounded(autoregression.fit(days(spark, sf), 2))


@query
def var_companion(spark, sf):
    return rounded(autoregression.companion(autoregression.fit(days(spark, sf), 2)))


@query
def var_eigvals(spark, sf):
    return rounded(autoregression.eigenvalues(autoregression.fit(days(spark, sf))))


@query
def var_simulate(spark, sf):
    model = autoregression.fit(days(spark, sf), model="avg-epochs")
    return rounded(autoregression.simulated(model, 100).select("ch", F.posexplode("x").alias("t", "value")))


@query
def var_simulate_noise(spark, sf):
    """A model driven by noise of one's own, here always the same."""
    model = autoregression.fit(days(spark, sf), model="avg-epochs")
    driven = autoregression.simulated(model, 20, noise=lambda rng, k: np.arange(1.0, k + 1))
    return rounded(driven.select("ch", F.posexplode("x").alias("t", "value")), 4)


@query
def var_fb(spark, sf):
    return rounded(autoregression.fit(days(spark, sf), forward_backward=True), 4)


@query
def var_fb_pairs(spark, sf):
    """Forward-backward operators of every pair of channels."""
    return rounded(autoregression.fit(_pairs(days(spark, sf)), forward_backward=True), 4)


@query
def select_order(spark, sf):
    """Of all channels: a day's 24 samples bear three lags of five."""
    return autoregression.best_order(autoregression.select_order(days(spark, sf), 3))


@query
def select_order_pooled(spark, sf):
    """Of one model for all days, from the sum of their Gram matrices."""
    return rounded(autoregression.select_order(days(spark, sf), 3, "avg-epochs").drop("epoch"), 5)


@query
def select_order_criteria(spark, sf):
    """Over every day of a quarter, as many as it has."""
    first = lambda q: F.make_date(F.floor(q / 4).cast("int"), (q % 4 * 3 + 1).cast("int"), F.lit(1))
    quarter = F.col("epoch") - 1
    x = signals.orders(table(spark, sf, "orders")).withColumn("x", F.slice("x", F.lit(1), F.datediff(first(quarter + 1), first(quarter))))
    return rounded(autoregression.select_order(x, 5), 4)


# containers


@query
def conn_dense_symmetric(spark, sf):
    return rounded(_envelope(spark, sf).combine("mean").get_data("dense").select("seed", "target", "value"))


@query
def conn_append(spark, sf):
    frame = _envelope(spark, sf, orthogonalize=False)
    first, rest = frame.df.where("epoch % 2 = 0"), frame.df.where("epoch % 2 = 1")
    return rounded(ConnFrame(first, frame.meta).append(ConnFrame(rest, frame.meta)).df)


@query
def conn_degree(spark, sf):
    frame = covaria.spectral_connectivity_epochs(days(spark, sf), "coh", sfreq=SFREQ, mode="fourier", fmin=3.5, fmax=4.5, shape=SHAPE)
    meta = Meta("coh", 5, "symmetric")
    return degree(ConnFrame(frame.df.drop("f", "freq"), meta).get_data("dense").fillna(0.0, ["value"]), 5, 0.4, symmetric=True)


@query
def conn_topn(spark, sf):
    frame = _envelope(spark, sf).combine("mean")
    return rounded(frame.strongest(4))


@query
def conn_topn_distance(spark, sf):
    """By size whatever the sign, without neighbours on a line."""
    frame = _envelope(spark, sf, orthogonalize=False).combine("mean")
    return rounded(frame.strongest(6, absolute=True, positions=[(float(i), 0.0, 0.0) for i in range(5)], min_distance=1.5))


@query
def conn_rename(spark, sf):
    frame = _envelope(spark, sf).combine("mean").rename_nodes(lambda n: f"channel {n}")
    return rounded(frame.named().select("seed_name", "target_name", "value"))


@query
def conn_accessors(spark, sf):
    """What a container says of itself."""
    frame = _envelope(spark, sf)
    said = {"kind": frame.kind, "dims": ",".join(frame.dims), "n_epochs": frame.n_epochs, "n_seeds": frame.shape[1], "n_targets": frame.shape[2], "names": ",".join(frame.names), "combined kind": frame.combine("mean").kind, "nodes": frame.meta.n_nodes, "method": frame.meta.method}
    return spark.createDataFrame([(k, str(v)) for k, v in said.items()], "what string, value string")


@query
def conn_roundtrip(spark, sf):
    path = f"{_folder(spark)}/conn-{uuid.uuid4().hex}"
    _envelope(spark, sf).combine("mean").save(path)
    return rounded(read_connectivity(spark, path).df)


# surrogates


@query
def surrogate_resting(spark, sf):
    moved = surrogates.resting(days(spark, sf), 3, seed=7)
    return rounded(moved.select("shuffle", "epoch", "ch", F.posexplode("x").alias("t", "value")))


@query
def surrogate_alias(spark, sf):
    """The old name of resting surrogates."""
    moved = covaria.make_surrogate_data(days(spark, sf), 3, seed=7)
    return rounded(moved.select("shuffle", "epoch", "ch", F.posexplode("x").alias("t", "value")))


@query
def surrogate_evoked(spark, sf):
    moved = surrogates.evoked(days(spark, sf), 3, seed=7)
    return rounded(moved.select("shuffle", "epoch", "ch", F.posexplode("x").alias("t", "value")))


@query
def surrogate_pvalue(spark, sf):
    x = days(spark, sf)
    coh = lambda v: bivariate.over_epochs(spectra.csd(_fourier(v)), ["coh"])
    moved = surrogates.resting(x, 10, seed=7).withColumn("epoch", F.col("epoch") * 10 + F.col("shuffle"))
    cross = spectra.csd(_fourier(moved)).withColumn("con", (F.col("epoch") % 10).cast("int"))
    found = bivariate.over_epochs(cross, ["coh"]).drop("con")
    return rounded(surrogates.p_values(coh(x), found, ["seed", "target", "f"], "coh"))


@query
def simulate_band(spark, sf):
    """As many epochs as the events have days, of one signal that drives another."""
    n = days(spark, sf).select("epoch").distinct().count()
    x = covaria.make_signals_in_freq_bands(spark, 1, 1, (5, 8), n_epochs=n, n_times=N, sfreq=SFREQ, connection_delay=1, seed=1)
    return rounded(bivariate.over_epochs(spectra.csd(_fourier(x)), ["coh", "dpli"]).drop("freq"))


@query
def events_band_passed(spark, sf):
    """Each day of the events between two frequencies."""
    return rounded(signals.to_long(surrogates.band_passed(days(spark, sf), (3, 6), SFREQ, 2, 11)), 4)


@query
def events_coupled(spark, sf):
    """The events, where some types follow the band of another."""
    return rounded(signals.to_long(surrogates.coupled(days(spark, sf), 0, [1, 2], [3, 4], (3, 6), SFREQ, 0.6, 2, 2, 11)))


@query
def events_coupled_coherence(spark, sf):
    found = surrogates.coupled(days(spark, sf), 0, [1, 2], [3, 4], (3, 6), SFREQ, 0.6, 2, 2, 11)
    return rounded(bivariate.over_epochs(spectra.csd(_fourier(found)), ["coh", "dpli"]).drop("freq"))


# sets of signals


def _matrices(spark: SparkSession, sf: str, connections, bins=BINS) -> DataFrame:
    cross = spectra.csd(spectra.fourier(days(spark, sf), N, SFREQ, bins), diagonal=True)
    return multivariate.packed(cross, connections)


def _sets(spark, sf, connections, methods, **options) -> DataFrame:
    return multivariate.coherency(_matrices(spark, sf, connections), connections, methods, **options)


@query
def mim_1x1(spark, sf):
    return rounded(_sets(spark, sf, [([2], [0]), ([4], [1])], ["mim"]).select("con", "f", "mim"))


@query
def mim_2x2(spark, sf):
    return rounded(_sets(spark, sf, [([0, 1], [2, 3])], ["mim"]).select("con", "f", "mim"))


@query
def mic_2x2_abs(spark, sf):
    return rounded(_sets(spark, sf, [([0, 1], [2, 3])], ["mic"]).select("con", "f", F.abs("mic").alias("mic")))


@query
def cacoh_1x1_abs(spark, sf):
    found = _sets(spark, sf, [([2], [0]), ([4], [1])], ["cacoh"])
    return rounded(found.select("con", "f", F.hypot("cacoh_re", "cacoh_im").alias("cacoh")), 5)


@query
def mim_all(spark, sf):
    everything = list(range(5))
    return rounded(_sets(spark, sf, [(everything, everything)], ["mim"]).select("con", "f", "mim"))


@query
def mic_patterns(spark, sf):
    found = _sets(spark, sf, [([0, 1], [2, 3])], ["mic"])
    sides = [found.select("f", F.lit(side).alias("side"), F.posexplode(F.transform(f"{side}_pattern", F.abs)).alias("ch", "value")) for side in ("seed", "target")]
    return rounded(sides[0].union(sides[1]), 2)


@query
def mic_patterns_padded(spark, sf):
    """Patterns of sets of two and of one channel, filled up with zeros to one length."""
    connections = [([0, 1], [2]), ([3], [4])]
    found = multivariate.padded_patterns(_sets(spark, sf, connections, ["mic"]))
    sides = [found.select("con", "f", F.lit(side).alias("side"), F.posexplode(F.transform(f"{side}_pattern", F.abs)).alias("place", "value")) for side in ("seed", "target")]
    return rounded(sides[0].union(sides[1]), 2)


@query
def cacoh_multi(spark, sf):
    found = _sets(spark, sf, [([0, 1], [2, 3])], ["cacoh"], n_components=2)
    return rounded(found.select("f", "component", F.hypot("cacoh_re", "cacoh_im").alias("cacoh")), 5)


@query
def mim_rank(spark, sf):
    """Interaction of the leading components of sets of two channels."""
    return rounded(_sets(spark, sf, [([0, 1], [2, 3]), ([4, 2], [1, 0])], ["mim"], ranks=[(1, 1), (1, 1)]).select("con", "f", "mim"))


#: A set of seeds whose middle channel is bad.
BAD = {"indices": ([[0, 1, 2]], [[3, 4]]), "bads": [1]}


def _with_bad(spark, sf, **options) -> ConnFrame:
    return covaria.spectral_connectivity_epochs(days(spark, sf), "mic", sfreq=SFREQ, mode="fourier", fmin=1, fmax=11, rank=([2], [2]), shape=SHAPE, **BAD, **options)


@query
def mic_patterns_bad(spark, sf):
    """Patterns of sets with a bad channel in the middle, as a container keeps them."""
    path = f"{_folder(spark)}/conn-{uuid.uuid4().hex}"
    _with_bad(spark, sf).save(path)
    found = read_connectivity(spark, path).patterns
    return rounded(found.select("con", "f", "side", "ch", F.abs("value").alias("value")), 2)


@query
def mic_filters_bad(spark, sf):
    found = _with_bad(spark, sf).filters
    return rounded(found.select("con", "f", "side", "ch", F.abs("value").alias("value")))


@query
def mim_faverage(spark, sf):
    frame = covaria.spectral_connectivity_epochs(days(spark, sf), "mim", indices=([[0, 1]], [[2, 3]]), sfreq=SFREQ, mode="fourier", fmin=[2, 5], fmax=[6, 11], faverage=True, rank=([2], [2]), shape=SHAPE)
    return rounded(frame.df.select("con", "band", "value"))


@query
def mim_from_spectra(spark, sf):
    """Sets of spectra made before; their ranks are those of their powers."""
    frame = covaria.spectral_connectivity_epochs(_fourier(days(spark, sf)), "mim", indices=([[0, 1]], [[2, 3]]), shape=(5, 0))
    return rounded(frame.df.select("con", "f", F.col("value").alias("mim")))


def _ranks(found: DataFrame) -> DataFrame:
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("rank")))
    return found.groupBy("con").agg(of(0).alias("seeds"), of(1).alias("targets"))


@query
def rank_estimate(spark, sf):
    return _ranks(multivariate.rank_table(days(spark, sf), [([0, 1], [2, 3, 4])]))


@query
def rank_from_spectra(spark, sf):
    return _ranks(multivariate.rank_table(_fourier(days(spark, sf)), [([0, 1], [2, 3, 4])]))


def _granger(spark, sf, methods) -> DataFrame:
    connections = [([0], [1]), ([1], [0]), ([0, 1], [2])]
    return multivariate.causality(_matrices(spark, sf, connections, range(13)), connections, 4, methods)


@query
def gc(spark, sf):
    return rounded(_granger(spark, sf, ["gc"]).select("con", "f", "gc"))


@query
def gc_tr(spark, sf):
    return rounded(_granger(spark, sf, ["gc_tr"]).select("con", "f", "gc_tr"))


@query
def trgc_net(spark, sf):
    found = _granger(spark, sf, ["gc", "gc_tr"]).where("con < 2").groupBy("f").pivot("con", [0, 1]).agg(F.first("gc").alias("g"), F.first("gc_tr").alias("r"))
    return rounded(found.select("f", ((F.col("0_g") - F.col("1_g")) - (F.col("0_r") - F.col("1_r"))).alias("net")))


@query
def gc_rank(spark, sf):
    """Causality between the leading components of sets of channels."""
    connections = [([0, 1], [2, 3, 4])]
    return rounded(multivariate.causality(_matrices(spark, sf, connections, range(13)), connections, 4, ["gc"], [(1, 2)]).select("con", "f", "gc"))


@query
def gc_rank_pairs(spark, sf):
    """Causality between the leading components of sets of two channels."""
    connections = [([0, 1], [2, 3]), ([4, 2], [1, 0])]
    return rounded(multivariate.causality(_matrices(spark, sf, connections, range(13)), connections, 4, ["gc"], [(1, 1), (1, 1)]).select("con", "f", "gc"))


@query
def gc_time(spark, sf):
    freqs = [float(f) for f in range(3, 12)]
    frame = covaria.spectral_connectivity_time(days(spark, sf), freqs, "gc", indices=([[0]], [[1]]), sfreq=SFREQ, n_cycles=1.5, gc_n_lags=3, rank=([1], [1]), average=False, shape=SHAPE)
    return rounded(frame.df.groupBy("con", "f").agg(F.avg("value").alias("value")))


@query
def mim_time(spark, sf):
    frame = covaria.spectral_connectivity_time(days(spark, sf), FREQS, "mim", indices=([[0, 1]], [[2, 3]]), sfreq=SFREQ, n_cycles=CYCLES, rank=([2], [2]), shape=SHAPE)
    return rounded(frame.df.select("epoch", "f", "value"))


def _decomposed(spark, sf):
    x = days(spark, sf)
    return covaria.CoherencyDecomposition(SFREQ, ([0, 1], [2, 3]), 3, 6, "mic", "fourier", 2, (2, 2)).fit(x), x


@query
def decomp_filters(spark, sf):
    model, _ = _decomposed(spark, sf)
    rows = [(side, i, ch, float(abs(v))) for side, f in enumerate(model.filters_) for i, row in enumerate(f) for ch, v in enumerate(row)]
    return rounded(spark.createDataFrame(rows, "side int, component int, ch int, weight double"))


@query
def decomp_transform(spark, sf):
    model, x = _decomposed(spark, sf)
    return rounded(signals.to_long(model.transform(x)))


# streaming


@query
def coh_stream(spark, sf):
    """Coherence over a stream of files of epochs: equal to the same query over all epochs at once."""
    folder = f"{_folder(spark)}/stream-{uuid.uuid4().hex}"
    name = f"coh_{uuid.uuid4().hex}"
    streaming.whole_epochs(days(spark, sf)).repartition(4, "epoch").write.parquet(f"{folder}/in")
    found = streaming.measures(streaming.source(spark, f"{folder}/in", maxFilesPerTrigger="2"), SFREQ, np.array(BINS), ["coh"])
    running = found.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return rounded(spark.table(name).drop("freq"))


@query
def coh_samples_stream(spark, sf):
    """Coherence over a stream of events by their own time, stopped and started again in between.

    Events arrive in two halves; some of the second are late by up to an hour, and some that the first
    had come again. It is the coherence of all days that the watermark has passed.
    """
    folder = f"{_folder(spark)}/samples-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    names = [r.name for r in signals.channels_of(events, "event_type").orderBy("ch").collect()]
    middle = F.lit(events.agg(F.expr("timestamp_micros(div(unix_micros(min(ts)) + unix_micros(max(ts)), 2))")).first()[0])
    late = (F.col("ts") > middle - F.expr("INTERVAL 1 HOUR")) & (F.col("event_id") % 5 == 0)
    for k, part in enumerate([(F.col("ts") <= middle) & ~late, (F.col("ts") > middle - F.expr("INTERVAL 1 HOUR"))]):
        events.where(part).write.parquet(f"{folder}/in/part={k}")
        arriving = spark.readStream.schema(events.schema).parquet(f"{folder}/in/part=*")
        closed = samples.closed_epochs(arriving, names, N, "1 day", "2 hours")
        samples.accumulate(closed, SFREQ, np.array(BINS), ["coh", "wpli2_debiased"], folder).awaitTermination()
    return rounded(samples.measured(spark, folder, ["coh", "wpli2_debiased"]).drop("freq"))
