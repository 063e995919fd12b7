"""Estimators: from vectors to a ConnFrame. Each call declares one plan and runs nothing but small look-ups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.functions import edges as edge
from covaria.functions import windows
from covaria.operators import autoregression, bivariate, envelope, multivariate, spectra, symbols
from covaria.plans.frame import ConnFrame, Meta
from covaria.sources.signals import without

MULTIVARIATE = ("mic", "mim", "cacoh", "gc", "gc_tr")


#: Channels and samples of an epoch, where the caller knows them; else one look-up counts them.
Shape = tuple[int, int]


def _shape(vectors: DataFrame, shape: Shape | None = None) -> Shape:
    if shape is not None:
        return shape
    if "x" not in vectors.columns:
        top = vectors.agg(F.max("ch")).first()[0]
        return (top if top is not None else -1) + 1, 0
    top, n_times = vectors.agg(F.max("ch"), F.max(F.size("x"))).first()
    return (top if top is not None else -1) + 1, n_times or 0


def _pruned(vectors: DataFrame, indices, n_nodes: int, sets: bool) -> DataFrame:
    """Only channels that the indices name, before anything is computed of them."""
    if indices is None:
        return vectors
    named = sorted({c for link in edge.links(indices, sets, n_nodes if sets else None) for side in link for c in side})
    return vectors.where(F.col("ch").isin(named))


def _bands(fmin, fmax, n_times: int, sfreq: float) -> list[tuple[float, float]]:
    low = [spectra.five_cycles(n_times, sfreq)] if fmin is None else np.atleast_1d(fmin).tolist()
    high = np.atleast_1d(np.inf if fmax is None else fmax).tolist()
    if len(low) != len(high) or any(a >= b for a, b in zip(low, high, strict=True)):
        raise ValueError("fmin and fmax must be as many, each fmin below its fmax")
    return list(zip(low, high, strict=True))


def _frames(values: DataFrame, methods: list[str], meta: Meta) -> list[ConnFrame]:
    from covaria.plans.frame import DIMS

    keys, out = [c for c in values.columns if c in DIMS], []
    for m in methods:
        own = [F.col(m).alias("value")] if m in values.columns else [F.col(f"{m}_re").alias("value_re"), F.col(f"{m}_im").alias("value_im")]
        out.append(ConnFrame(values.select(*keys, *own), Meta(**{**meta.__dict__, "method": m})))
    return out


def spectral_connectivity_epochs(vectors: DataFrame, method: str | Sequence[str] = "coh", indices=None, sfreq: float = 1.0, mode: str = "multitaper", fmin=None, fmax=None, fskip: int = 0, faverage: bool = False, mt_bandwidth: float | None = None, mt_adaptive: bool = False, mt_low_bias: bool = True, cwt_freqs=None, cwt_n_cycles=7.0, gc_n_lags: int = 40, rank=None, n_components: int | None = 1, shape: Shape | None = None, bads: Sequence[int] = ()) -> ConnFrame | list[ConnFrame]:
    """Connectivity over epochs; a list of frames for several methods.

    vectors are samples (epoch, ch, x), or spectra made before (epoch, ch, taper, f, freq, re, im, weight[, t]),
    which are used as they are between fmin and fmax; ranks of sets that aren't given are then those of
    all their powers. bads are channels that take no part: pairs with them are left out, sets go
    without them, and their filters and patterns are 0.
    """
    methods = [method] if isinstance(method, str) else list(method)
    multi = [m for m in methods if m in MULTIVARIATE]
    if multi and len(multi) != len(methods):
        raise ValueError("measures of pairs and of sets can't be mixed in a call")
    n_nodes, n_times = _shape(vectors, shape)
    vectors = without(_pruned(vectors, indices, n_nodes, bool(multi)), list(bads))
    given = "re" in vectors.columns
    bands = _bands(0.0 if given and fmin is None else fmin, fmax, n_times, sfreq)
    if given:
        inside = [(F.col("freq") >= a) & (F.col("freq") <= b) for a, b in bands]
        found, mode = vectors.where(reduce(or_, inside)), "given"
    elif mode == "cwt_morlet":
        if cwt_freqs is None:
            raise ValueError("cwt_morlet asks for cwt_freqs")
        freqs = [f for f in cwt_freqs if any(a <= f <= b for a, b in bands)]
        found = spectra.wavelet(vectors, sfreq, freqs, cwt_n_cycles, zero_mean=True, whole=True)
    elif mode in ("fourier", "multitaper"):
        bins = spectra.chosen_bins(n_times, sfreq, bands, fskip + 1)
        if mode == "fourier":
            found = spectra.fourier(vectors, n_times, sfreq, bins)
        elif mt_adaptive:
            found = spectra.multitaper_adaptive(vectors, n_times, sfreq, bins, 4.0 if mt_bandwidth is None else mt_bandwidth * n_times / (2 * sfreq))
        else:
            found = spectra.multitaper(vectors, n_times, sfreq, bins, mt_bandwidth, mt_low_bias)
    else:
        raise ValueError("mode must be 'multitaper', 'fourier' or 'cwt_morlet'")
    meta = Meta("", n_nodes, "all" if indices is None else "raveled", spec_method=mode)
    if multi:
        reduced = (lambda values, keys: bivariate.banded(values, bands, keys)) if faverage else (lambda values, _: values)
        return _unwrapped(_multivariate(vectors, spectra.csd(found, diagonal=True), methods, indices, n_nodes, meta, gc_n_lags, rank, n_components, bads, reduced=reduced))
    pairs = None if indices is None else edge.edge_list(vectors.sparkSession, indices)
    values = bivariate.over_epochs(spectra.csd(found, pairs), methods)
    if faverage:
        values = bivariate.banded(values, bands)
    return _unwrapped(_frames(values, methods, meta))


def _unwrapped(frames: list[ConnFrame]) -> ConnFrame | list[ConnFrame]:
    return frames[0] if len(frames) == 1 else frames


def _multivariate(vectors, cross, methods, indices, n_nodes, meta, lags, rank, n_components, bads=(), per_epoch=False, reduced=lambda values, keys: values) -> list[ConnFrame]:
    """Frames with maps where a method has them; reduced takes values with their keys to bands or means."""
    if indices is None:
        if {"gc", "gc_tr"} & set(methods):
            raise ValueError("Granger causality asks for indices")
        channels = [r.ch for r in vectors.select("ch").distinct().orderBy("ch").collect()]
        connections, whole = [(channels, channels)], [(list(range(n_nodes)),) * 2]  # those without a row are bad
    else:
        whole = edge.check_multivariate_indices(indices, n_nodes)
        connections = [tuple([c for c in side if c not in bads] for side in pair) for pair in whole]
        if not all(side for pair in connections for side in pair):
            raise ValueError("a set has bad channels only")
    multivariate.check(connections, methods)
    found_ranks = list(zip(*rank, strict=True)) if rank is not None else multivariate.ranks(vectors, connections)
    matrices = multivariate.packed(cross, connections, per_epoch)
    keys = ["con", *(["epoch"] if per_epoch else []), "f", "freq"]
    if {"gc", "gc_tr"} & set(methods):
        values = multivariate.causality(matrices, connections, lags, methods, found_ranks)
        return _frames(reduced(values.select(*keys, *methods), keys), methods, meta)
    of = lambda which: multivariate.coherency(matrices, connections, which, found_ranks, n_components)
    keys += [] if n_components == 1 else ["component"]
    values = of(methods).select(*keys, *[c for m in methods for c in ((f"{m}_re", f"{m}_im") if m == "cacoh" else (m,))])
    frames = _frames(reduced(values, keys), methods, meta)
    for i, m in enumerate(methods):
        if m != "mim":
            maps = multivariate.maps(of([m]), connections, whole).select(*keys, "side", "ch", "filter", "pattern")
            frames[i] = replace(frames[i], maps=reduced(maps, [*keys, "side", "ch"]))
    return frames


def spectral_connectivity_time(vectors: DataFrame, freqs, method: str | Sequence[str] = "coh", average: bool = False, indices=None, sfreq: float = 1.0, fmin=None, fmax=None, faverage: bool = False, sm_times: float | Sequence[float] = 0, sm_freqs: int = 1, sm_kernel: str = "hanning", padding: float = 0, mode: str = "cwt_morlet", mt_bandwidth: float | None = None, n_cycles=7.0, decim: int = 1, gc_n_lags: int = 40, rank=None, n_components: int | None = 1, strict_bands: bool = False, shape: Shape | None = None, bads: Sequence[int] = ()) -> ConnFrame | list[ConnFrame]:
    """Connectivity over time within each epoch, averaged over epochs on demand; bads as over epochs.

    vectors are samples, or time-frequency coefficients made before (with t), whose bins freqs lists.
    Of several sm_times each is a frequency's, and bins aren't smoothed over.
    """
    methods = [method] if isinstance(method, str) else list(method)
    freqs = [float(f) for f in freqs]
    if any(a >= b for a, b in zip(freqs, freqs[1:], strict=False)) or freqs[-1] > sfreq / 2:
        raise ValueError("freqs must rise and stay below Nyquist")
    multi = [m for m in methods if m in MULTIVARIATE]
    if multi and len(multi) != len(methods):
        raise ValueError("measures of pairs and of sets can't be mixed in a call")
    n_nodes, n_times = _shape(vectors, shape)
    vectors = without(_pruned(vectors, indices, n_nodes, bool(multi)), list(bads))
    given = "re" in vectors.columns
    if not given and not 0 <= padding < n_times / sfreq / 2:
        raise ValueError("padding must leave samples between")
    cropped = int(np.floor(padding * sfreq / decim))
    if given:
        found, mode = vectors.where(F.col("t") % decim == 0).withColumn("t", (F.col("t") / decim).cast("int")), "given"
    elif mode == "cwt_morlet":
        found = spectra.wavelet(vectors, sfreq, freqs, n_cycles, decim=decim, padding=cropped, whole=True)
    elif mode == "multitaper":
        found = spectra.tapered_tfr(vectors, sfreq, freqs, n_cycles, mt_bandwidth or 4.0, decim, cropped, whole=True)
    else:
        raise ValueError("mode must be 'cwt_morlet' or 'multitaper'")
    per_freq = np.ndim(sm_times) > 0
    if per_freq and len(sm_times) != len(freqs):
        raise ValueError("sm_times must be one number, or one for each frequency")
    widths = [max(int(round(t * sfreq / decim)), 1) for t in np.atleast_1d(sm_times)]
    kernel = (widths if per_freq else widths[0], int(round(max(sm_freqs, 1))))
    meta = Meta("", n_nodes, "all" if indices is None else "raveled", spec_method=mode)
    pairs = None if indices is None or multi else edge.edge_list(vectors.sparkSession, indices)
    whole, table = "t0" in found.columns, windows.smoothing_kernel(*kernel, sm_kernel) if kernel != (1, 1) else None
    if whole and table is not None:
        cross = spectra.smoothed_csd(found, table, per_freq, pairs, bool(multi))
    else:
        cross = spectra.csd(found, pairs, bool(multi), whole)
        cross = cross if table is None else spectra.smoothed(cross, table, per_freq)
    if faverage:
        bands = list(zip(np.atleast_1d(min(freqs) if fmin is None else fmin).tolist(), np.atleast_1d(max(freqs) if fmax is None else fmax).tolist(), strict=True))
    if multi:
        def reduced(values, keys):
            values = bivariate.foi_banded(values, freqs, bands, strict_bands, keys) if faverage else values
            return bivariate.averaged(values, [c for c in values.columns if c in {"band", *keys} - {"epoch"}]) if average else values

        return _unwrapped(_multivariate(vectors, cross, methods, indices, n_nodes, meta, gc_n_lags, rank, n_components, bads, True, reduced))
    values = bivariate.over_time(cross, methods)
    if faverage:
        values = bivariate.foi_banded(values, freqs, bands, strict_bands)
    if average:
        values = bivariate.averaged(values, [c for c in values.columns if c in ("con", "seed", "target", "f", "freq", "band")])
    return _unwrapped(_frames(values, methods, meta))


def phase_slope_index(vectors: DataFrame, indices=None, sfreq: float = 1.0, mode: str = "multitaper", fmin=None, fmax=None, **options) -> ConnFrame:
    """Phase slope index over epochs, for each band."""
    options["shape"] = n_nodes, _ = _shape(vectors, options.get("shape"))
    low = [-np.inf] if fmin is None else np.atleast_1d(fmin).tolist()
    high = np.atleast_1d(np.inf if fmax is None else fmax).tolist()
    cohy = spectral_connectivity_epochs(vectors, "cohy", indices, sfreq, mode, fmin=min(low) if fmin is not None else 0.0, fmax=max(high), **options).df
    found = bivariate.phase_slope(cohy.withColumnsRenamed({"value_re": "cohy_re", "value_im": "cohy_im"}), list(zip(low, high, strict=True)))
    return ConnFrame(found.withColumnRenamed("psi", "value"), Meta("phase-slope-index", n_nodes, "all" if indices is None else "raveled", spec_method=mode))


def phase_slope_index_time(vectors: DataFrame, freqs, indices=None, sfreq: float = 1.0, fmin=None, fmax=None, average: bool = False, **options) -> ConnFrame:
    """Phase slope index within each epoch, for each band."""
    options["shape"] = n_nodes, _ = _shape(vectors, options.get("shape"))
    low = [-np.inf] if fmin is None else np.atleast_1d(fmin).tolist()
    high = np.atleast_1d(np.inf if fmax is None else fmax).tolist()
    cohy = spectral_connectivity_time(vectors, freqs, "cohy", indices=indices, sfreq=sfreq, **options).df
    found = bivariate.phase_slope(cohy.withColumnsRenamed({"value_re": "cohy_re", "value_im": "cohy_im"}), list(zip(low, high, strict=True)))
    if average:
        found = bivariate.averaged(found, [c for c in ("con", "seed", "target", "band") if c in found.columns])
    return ConnFrame(found.withColumnRenamed("psi", "value"), Meta("phase-slope-index", n_nodes, "all" if indices is None else "raveled"))


def envelope_correlation(vectors: DataFrame, orthogonalize: str | bool = "pairwise", log: bool = False, absolute: bool = True, shape: Shape | None = None) -> ConnFrame:
    n_nodes, _ = _shape(vectors, shape)
    found = envelope.correlation(envelope.analytic(vectors), orthogonalize, log, absolute)
    return ConnFrame(found, Meta("envelope correlation", n_nodes, "symmetric"))


def wsmi(vectors: DataFrame, kernel: int = 3, tau: int = 1, sfreq: float = 1.0, anti_aliasing: bool | str = "auto", weighted: bool = True, average: bool = False, tmin: float | None = None, tmax: float | None = None, indices=None, shape: Shape | None = None) -> ConnFrame:
    """Symbolic mutual information; the time window is cut after filtering."""
    from covaria.sources.signals import window

    n_nodes, _ = _shape(vectors, shape)
    vectors = _pruned(vectors, indices, n_nodes, False)
    if anti_aliasing:
        vectors = symbols.antialiased(vectors, sfreq, kernel, tau)
    if tmin is not None or tmax is not None:
        vectors = window(vectors, sfreq, tmin, tmax)
    found = symbols.wsmi(vectors, kernel, tau, weighted)
    if indices is not None:  # whichever way a pair is given
        pairs = edge.edge_list(vectors.sparkSession, indices)
        found = found.withColumnsRenamed({"seed": "_a", "target": "_b"}).join(F.broadcast(pairs), (F.greatest("seed", "target") == F.col("_a")) & (F.least("seed", "target") == F.col("_b"))).select("epoch", "con", "seed", "target", "value")
    frame = ConnFrame(found, Meta("wsmi" if weighted else "smi", n_nodes, "all" if indices is None else "raveled"))
    return frame.combine("mean") if average else frame


def vector_auto_regression(vectors: DataFrame, lags: int = 1, l2_reg: float | None = 0.0, compute_fb_operator: bool = False, model: str = "dynamic", shape: Shape | None = None) -> ConnFrame:
    n_nodes, _ = _shape(vectors, shape)
    found = autoregression.fit(vectors, lags, l2_reg, model, compute_fb_operator)
    df = found.select(*(["epoch"] if model == "dynamic" else []), F.col("i").alias("seed"), F.col("j").alias("target"), "lag", "value")
    return ConnFrame(df, Meta(("Time-varying " if model == "dynamic" else "") + f"VAR({lags})", n_nodes, "all"))
