"""Spectra of vectors: (epoch, ch, taper, f, freq, re, im, weight[, t]).

A row's samples are one array, so every transform is map-only: batches of arrays go to NumPy by Arrow
and nothing is shuffled until pairs are formed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.functions import windows

SPECTRUM = "epoch long, ch int, taper int, f int, freq double, re double, im double, weight double"
#: Of one window, all times in one row: re and im are arrays from time t0 on.
WHOLE = "epoch long, ch int, f int, freq double, t0 int, re array<double>, im array<double>"


def frequencies(n_times: int, sfreq: float) -> np.ndarray:
    return np.fft.rfftfreq(n_times, 1 / sfreq)


def chosen_bins(n_times: int, sfreq: float, bands: list[tuple[float, float]], fdecim: int = 1) -> np.ndarray:
    """Bins inside any band, edges included, every fdecim-th counted from the first."""
    freqs = frequencies(n_times, sfreq)
    mask = np.zeros(len(freqs), bool)
    for low, high in bands:
        inside = (freqs >= low) & (freqs <= high)
        if not inside.any():
            raise ValueError(f"no frequency between {low} and {high}")
        mask |= inside
    bins = np.nonzero(mask)[0]
    return bins[(bins - bins[0]) % fdecim == 0]


def five_cycles(n_times: int, sfreq: float) -> float:
    """The lowest frequency with five cycles in an epoch."""
    return 5 * sfreq / n_times


def _flat(rows: pd.DataFrame, tapers, weights, bins, freqs) -> pd.DataFrame:
    x = np.stack(rows["x"].to_numpy())
    x = x - x.mean(1, keepdims=True)
    s = np.fft.rfft(x[:, None, :] * tapers[None], axis=2)[:, :, bins]
    n, k, b = s.shape
    return pd.DataFrame({"epoch": np.repeat(rows["epoch"].to_numpy(), k * b), "ch": np.repeat(rows["ch"].to_numpy(), k * b), "taper": np.tile(np.repeat(np.arange(k), b), n), "f": np.tile(bins, n * k), "freq": np.tile(freqs[bins], n * k), "re": s.real.ravel(), "im": s.imag.ravel(), "weight": np.tile(np.repeat(weights, b), n)})


def _spectra(vectors: DataFrame, tapers: np.ndarray, weights: np.ndarray, bins: np.ndarray, freqs: np.ndarray) -> DataFrame:
    def of(batches):
        for rows in batches:
            if len(rows):
                yield _flat(rows, tapers, weights, bins, freqs)

    return vectors.select("epoch", "ch", "x").mapInPandas(of, SPECTRUM)


def fourier(vectors: DataFrame, n_times: int, sfreq: float, bins: np.ndarray) -> DataFrame:
    """One Hann window, unit weight."""
    return _spectra(vectors, windows.hann(n_times)[None], np.ones(1), np.asarray(bins), frequencies(n_times, sfreq))


def multitaper(vectors: DataFrame, n_times: int, sfreq: float, bins: np.ndarray, bandwidth: float | None = None, low_bias: bool = True) -> DataFrame:
    """Slepian tapers weighted by the roots of their concentrations; bandwidth in the unit of sfreq."""
    half = 4.0 if bandwidth is None else bandwidth * n_times / (2 * sfreq)
    tapers, ratios = windows.dpss(n_times, half, low_bias=low_bias)
    return _spectra(vectors, tapers, np.sqrt(ratios), np.asarray(bins), frequencies(n_times, sfreq))


def adaptive_weights(spectra: np.ndarray, ratios: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Thomson's (1982) weights of tapered spectra (taper, bin) by iteration on the power spectrum."""
    power = np.abs(spectra) ** 2
    variance = power.sum(0).mean() / max(1, len(ratios))
    psd = power[:2].mean(0)
    for _ in range(rounds):
        d = np.sqrt(ratios)[:, None] * psd / (ratios[:, None] * psd + (1 - ratios[:, None]) * variance + 1e-300)
        new = (d**2 * power).sum(0) / (d**2).sum(0)
        if np.allclose(new, psd, rtol=1e-10, atol=0):
            break
        psd = new
    return d


def multitaper_adaptive(vectors: DataFrame, n_times: int, sfreq: float, bins: np.ndarray, half: float = 4.0) -> DataFrame:
    """As multitaper, with weights fitted for each channel and bin."""
    tapers, ratios = windows.dpss(n_times, half)
    bins, freqs = np.asarray(bins), frequencies(n_times, sfreq)

    def of(batches):
        for rows in batches:
            if len(rows):
                x = np.stack(rows["x"].to_numpy())
                full = np.fft.rfft((x - x.mean(1, keepdims=True))[:, None] * tapers[None], axis=2)
                weights = np.stack([adaptive_weights(s, ratios)[:, bins] for s in full])
                yield _flat(rows, tapers, np.ones(len(tapers)), bins, freqs).assign(weight=weights.ravel())

    return vectors.select("epoch", "ch", "x").mapInPandas(of, SPECTRUM)


def wavelet(vectors: DataFrame, sfreq: float, freqs, n_cycles=7.0, zero_mean: bool = False, decim: int = 1, padding: int = 0, whole: bool = False) -> DataFrame:
    """Morlet transform by convolution, as long as the signal: a row for each freq and time, or if whole for each freq (see WHOLE)."""
    freqs = np.asarray(freqs, float)
    waves = windows.morlet(sfreq, freqs, n_cycles, zero_mean)

    def of(batches):
        for rows in batches:
            if not len(rows):
                continue
            x = np.stack(rows["x"].to_numpy())
            n, size = x.shape[1], x.shape[1] + max(len(w) for w in waves) - 1
            spectrum, out = np.fft.fft(x, size), []
            for i, w in enumerate(waves):
                if len(w) > n:
                    raise ValueError(f"the wavelet at {freqs[i]} is longer than the signal")
                full = np.fft.ifft(spectrum * np.fft.fft(w, size))[:, (len(w) - 1) // 2 :][:, :n]
                kept = full[:, ::decim][:, padding : -(-n // decim) - padding]
                if whole:
                    out.append(rows[["epoch", "ch"]].assign(f=i, freq=freqs[i], t0=padding, re=list(kept.real), im=list(kept.imag)))
                    continue
                t = np.arange(kept.shape[1]) + padding
                out.append(pd.DataFrame({"epoch": np.repeat(rows["epoch"].to_numpy(), len(t)), "ch": np.repeat(rows["ch"].to_numpy(), len(t)), "taper": 0, "f": i, "freq": freqs[i], "re": kept.real.ravel(), "im": kept.imag.ravel(), "weight": 1.0, "t": np.tile(t, len(rows))}))
            yield pd.concat(out)

    return vectors.select("epoch", "ch", "x").mapInPandas(of, WHOLE if whole else SPECTRUM + ", t int")


def tapered_tfr(vectors: DataFrame, sfreq: float, freqs, n_cycles=7.0, time_bandwidth: float = 4.0, decim: int = 1, padding: int = 0, whole: bool = False) -> DataFrame:
    """Multitaper time-frequency transform: windows of n_cycles, Slepian tapers under each; a row for each taper, freq and time, or if whole for each taper and freq (WHOLE, with taper and weight)."""
    freqs = np.asarray(freqs, float)
    kernels = windows.tapered_waves(sfreq, freqs, n_cycles, time_bandwidth)

    def of(batches):
        for rows in batches:
            if not len(rows):
                continue
            x = np.stack(rows["x"].to_numpy())
            n, size, out = x.shape[1], windows.fast_length(x.shape[1] + max(len(w) for group in kernels for w, _ in group) - 1), []
            spectrum = np.fft.fft(x, size)
            for i, group in enumerate(kernels):
                for k, (w, weight) in enumerate(group):
                    y = np.fft.ifft(spectrum * np.fft.fft(w, size))[:, (len(w) - 1) // 2 :][:, :n]
                    y = y[:, ::decim][:, padding : -(-n // decim) - padding]
                    if whole:
                        out.append(rows[["epoch", "ch"]].assign(taper=k, f=i, freq=freqs[i], weight=weight, t0=padding, re=list(y.real), im=list(y.imag)))
                        continue
                    t = np.arange(y.shape[1]) + padding
                    out.append(pd.DataFrame({"epoch": np.repeat(rows["epoch"].to_numpy(), len(t)), "ch": np.repeat(rows["ch"].to_numpy(), len(t)), "taper": k, "f": i, "freq": freqs[i], "re": y.real.ravel(), "im": y.imag.ravel(), "weight": weight, "t": np.tile(t, len(rows))}))
            yield pd.concat(out)

    whole_rows = "epoch long, ch int, taper int, f int, freq double, weight double, t0 int, re array<double>, im array<double>"
    return vectors.select("epoch", "ch", "x").mapInPandas(of, whole_rows if whole else SPECTRUM + ", t int")


def psd(spectra: DataFrame) -> DataFrame:
    """Power of each epoch, channel and bin over tapers."""
    square = F.col("weight") * F.col("weight")
    keys = ["epoch", "ch", "f", "freq"] + (["t"] if "t" in spectra.columns else [])
    total = F.sum(square * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))) * 2 / F.sum(square)
    return spectra.groupBy(*keys).agg(total.alias("power"))


def _paired(rows: DataFrame, keys: list[str], edges: DataFrame | None, diagonal: bool) -> tuple[DataFrame, list[str]]:
    """Rows (keys, all: array<struct<ch,s>>) to a row for each pair: (con, ...) keys, seed, target, a and b, what s either has."""
    rows = rows.select(*keys, F.explode("all").alias("p"), "all")
    if edges is None:
        rows = rows.select(*keys, "p", F.explode(F.col("all") if diagonal else F.expr("filter(all, q -> q.ch < p.ch)")).alias("q"))
        return rows.select(*keys, F.col("p.ch").alias("seed"), F.col("q.ch").alias("target"), F.col("p.s").alias("a"), F.col("q.s").alias("b")), keys
    found = rows.withColumn("seed", F.col("p.ch")).join(F.broadcast(edges), "seed")
    found = found.withColumn("q", F.expr("filter(all, q -> q.ch = target)[0]")).where("q IS NOT NULL")
    keys = [c for c in edges.columns if c not in ("seed", "target")] + keys
    return found.select(*keys, "seed", "target", F.col("p.s").alias("a"), F.col("q.s").alias("b")), keys


#: What a pair has at one bin over all times, as entries of an array.
OVER_TIME = "array<struct<re:double,im:double,pxx:double,pyy:double>>"


def csd(spectra: DataFrame, edges: DataFrame | None = None, diagonal: bool = False, whole: bool = False) -> DataFrame:
    """Cross-spectra (epoch, seed, target, f, freq[, t], re, im, pxx, pyy) of pairs; whole: (..., t0, z), z being OVER_TIME.

    One shuffle: what an epoch has at a bin (and time) becomes one row with an entry for each channel,
    as long as there are channels and tapers, and pairs are made within the row. Without edges they are
    seed > target. edges, a list, are broadcast and joined by seed, and their targets looked up, so no
    pair is made but theirs; channels that none of them names are dropped before the shuffle.
    diagonal: all pairs, each way, and itself. Spectra that are WHOLE move as arrays over time, and are
    taken apart once they are pairs, unless they shall stay whole.
    """
    if edges is not None:
        named = edges.select(F.explode(F.array("seed", "target")).alias("ch")).distinct()
        spectra = spectra.join(F.broadcast(named), "ch", "left_semi")
    if "t0" in spectra.columns and "taper" in spectra.columns:
        found = smoothed_csd(spectra, np.ones((1, 1)), False, edges, diagonal)  # tapers are summed where pairs are made
        return found if whole else taken_apart(found)
    if "t0" in spectra.columns:
        keys = ["epoch", "f", "freq", "t0"]
        rows = spectra.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ch", F.struct("re", "im").alias("s")))).alias("all"))
        pairs, keys = _paired(rows, keys, edges, diagonal)
        if whole:
            entry = "struct(2 * (p.re * q.re + p.im * q.im) as re, 2 * (p.im * q.re - p.re * q.im) as im, 2 * (p.re * p.re + p.im * p.im) as pxx, 2 * (q.re * q.re + q.im * q.im) as pyy)"
            return pairs.select(*keys, "seed", "target", F.expr(f"zip_with(arrays_zip(a.re, a.im), arrays_zip(b.re, b.im), (p, q) -> {entry})").alias("z"))
        pairs = pairs.select(*keys, "seed", "target", F.posexplode(F.arrays_zip("a.re", "a.im", F.col("b.re").alias("ure"), F.col("b.im").alias("uim"))).alias("at", "z"))
        keys = [F.col("t0") + F.col("at") if k == "t0" else F.col(k) for k in keys]
        keys = [k.cast("int").alias("t") if i == len(keys) - 1 else k for i, k in enumerate(keys)]
        x, y, u, v = (F.col(f"z.{n}") for n in ("re", "im", "ure", "uim"))
        return pairs.select(*keys, "seed", "target", (2 * (x * u + y * v)).alias("re"), (2 * (y * u - x * v)).alias("im"), (2 * (x * x + y * y)).alias("pxx"), (2 * (u * u + v * v)).alias("pyy"))
    keys = ["epoch", "f", "freq"] + (["t"] if "t" in spectra.columns else [])
    entry = F.struct("ch", "taper", (F.col("re") * F.col("weight")).alias("re"), (F.col("im") * F.col("weight")).alias("im"), (F.col("weight") * F.col("weight")).alias("w2"))
    rows = spectra.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("s"))
    rows = rows.select(*keys, F.expr("transform(array_distinct(transform(s, e -> e.ch)), c -> struct(c as ch, filter(s, e -> e.ch = c) as s))").alias("all"))
    pairs, keys = _paired(rows, keys, edges, diagonal)
    total = lambda expr: F.expr(f"aggregate(zip_with(a, b, (x, y) -> {expr}), 0d, (s, v) -> s + v)")
    scale = F.sqrt(total("x.w2")) * F.sqrt(total("y.w2")) / 2
    own = lambda side: F.expr(f"aggregate({side}, 0d, (s, v) -> s + v.re * v.re + v.im * v.im) * 2 / aggregate({side}, 0d, (s, v) -> s + v.w2)")
    return pairs.select(*keys, "seed", "target", (total("x.re * y.re + x.im * y.im") / scale).alias("re"), (total("x.im * y.re - x.re * y.im") / scale).alias("im"), own("a").alias("pxx"), own("b").alias("pyy"))


#: Bins whose cross-spectra are smoothed together, besides those around them.
TOGETHER = 16


def smoothed_csd(spectra: DataFrame, kernel: np.ndarray, per_freq: bool = False, edges: DataFrame | None = None, diagonal: bool = False, together: int = TOGETHER) -> DataFrame:
    """Cross-spectra of WHOLE spectra convolved over bin and time with a kernel (freq, time), zero beyond the edges: (epoch, seed, target, f, freq, t0, z) as from csd.

    One shuffle: blocks of bins, each with as many around it as the kernel reaches, are one row for an
    epoch; its pairs are made, of tapers if there are any summed by weight, and smoothed there, as arrays. A
    channel's power is smoothed once, whatever its pairs. per_freq: a row of the kernel for each frequency, in order, over time alone. edges are a list.
    """
    # how far the kernel reaches to either side of a bin
    before, after = (0, 0) if per_freq else ((len(kernel) - 1) // 2, len(kernel) - 1 - (len(kernel) - 1) // 2)
    listed = None if edges is None else [(r.seed, r.target, r["con"] if "con" in edges.columns else None) for r in edges.collect()]
    if listed is not None:
        spectra = spectra.where(F.col("ch").isin(sorted({c for s, t, _ in listed for c in (s, t)})))
    per = together if before or after else 1
    reach = max(before, after)
    whole = lambda c: F.floor(c / per).cast("int")
    block = F.explode(F.sequence(F.greatest(F.lit(0), whole(F.col("f") - reach)), whole(F.col("f") + reach)))
    tapered = ["taper", "weight"] if "taper" in spectra.columns else []
    rows = spectra.withColumn("block", block).groupBy("epoch", "block", "t0").agg(F.collect_list(F.struct("ch", "f", "freq", *tapered, "re", "im")).alias("all"))

    def of(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                chs, fs = sorted({e["ch"] for e in r.all}), sorted({(e["f"], e["freq"]) for e in r.all})
                own = [k for k, (f, _) in enumerate(fs) if f // per == r.block]
                if not own:
                    continue
                low = fs[0][0]
                x = np.zeros((len(chs), max(e["taper"] for e in r.all) + 1 if tapered else 1, fs[-1][0] - low + 1, len(r.all[0]["re"])), complex)
                w2 = np.zeros((len(chs), x.shape[2], 1))
                for e in r.all:
                    i, k, weight = chs.index(e["ch"]), e["taper"] if tapered else 0, e["weight"] if tapered else 1.0
                    x[i, k, e["f"] - low] = weight * (np.asarray(e["re"]) + 1j * np.asarray(e["im"]))
                    w2[i, e["f"] - low] += weight**2
                x /= np.sqrt(np.where(w2 > 0, w2, 1.0))[:, None]
                at = [fs[k][0] - low for k in own]
                smooth = lambda grid: _convolved(grid, kernel[[fs[0][0]]] if per_freq else kernel, per_freq)[at]  # noqa: E731, B023
                power = [smooth(2 * (np.abs(v) ** 2).sum(0)) for v in x]
                pairs = listed or [(a, b, None) for a in chs for b in chs if diagonal or b < a]
                for a, b, con in pairs:
                    if a in chs and b in chs:
                        i, j = chs.index(a), chs.index(b)
                        c = 2 * (x[i] * x[j].conj()).sum(0)
                        values = np.stack([smooth(c.real), smooth(c.imag), power[i], power[j]], axis=-1)
                        for k, v in zip(own, values, strict=True):
                            out.append((con, r.epoch, a, b, *fs[k], r.t0, [dict(zip(("re", "im", "pxx", "pyy"), e, strict=True)) for e in v.tolist()]))
            yield pd.DataFrame(out, columns=["con", "epoch", "seed", "target", "f", "freq", "t0", "z"]).astype({"con": "Int64"})

    found = rows.mapInPandas(of, f"con int, epoch long, seed int, target int, f int, freq double, t0 int, z {OVER_TIME}")
    return found if edges is not None and "con" in edges.columns else found.drop("con")


def taken_apart(cross: DataFrame) -> DataFrame:
    """Cross-spectra that are arrays over time as a row for each time."""
    keys = [c for c in cross.columns if c not in ("t0", "z")]
    rows = cross.select(*keys, "t0", F.posexplode("z").alias("at", "z"))
    return rows.select(*keys, (F.col("t0") + F.col("at")).cast("int").alias("t"), "z.*")


def smoothed(cross: DataFrame, kernel: np.ndarray, per_freq: bool = False) -> DataFrame:
    """Cross-spectra convolved over bin and time with a kernel (freq, time), zero beyond the edges.

    per_freq: a row of the kernel for each frequency, in order, over time alone. For spectra that aren't
    WHOLE: what an epoch's pair has becomes one row of arrays over bins and times, and is convolved there.
    """
    keys = [c for c in ("con", "epoch", "seed", "target") if c in cross.columns]
    values, kinds = ("re", "im", "pxx", "pyy"), dict(cross.dtypes)
    listed = F.array_sort(F.collect_list(F.struct("f", "t", "freq", *values)))
    rows = cross.groupBy(*keys).agg(listed.alias("s"))
    rows = rows.select(*keys, *[F.col(f"s.{c}").alias(c) for c in ("f", "t", "freq", *values)])

    def of(batches):
        for batch in batches:
            for r in batch.itertuples():
                f, t = np.asarray(r.f), np.asarray(r.t)
                i, j = np.unique(f, return_inverse=True)[1], t - t.min()
                out = {k: getattr(r, k) for k in keys} | {"f": f, "t": t, "freq": r.freq}
                for c in values:
                    grid = np.zeros((i.max() + 1, j.max() + 1))
                    grid[i, j] = getattr(r, c)
                    out[c] = _convolved(grid, kernel, per_freq)[i, j]
                yield pd.DataFrame(out)

    columns = [*keys, "f", "t", "freq", *values]
    return rows.mapInPandas(of, ", ".join(f"{c} {kinds[c]}" for c in columns))


def _convolved(grid: np.ndarray, kernel: np.ndarray, per_freq: bool) -> np.ndarray:
    """Of the grid's shape, the kernel's middle at its centre."""
    if per_freq and len(kernel) != len(grid):
        raise ValueError(f"{len(kernel)} kernels for {len(grid)} frequencies")
    n, first = grid.shape[1], (kernel.shape[1] - 1) // 2
    size = windows.fast_length(n + kernel.shape[1] - 1)
    over_time = lambda rows, k: np.fft.irfft(np.fft.rfft(rows, size) * np.fft.rfft(k, size), size)[:, first : first + n]
    if per_freq:
        return over_time(grid, kernel)
    out, above = np.zeros(grid.shape), (len(kernel) - 1) // 2
    for at, row in enumerate(kernel):
        moved, by = over_time(grid, row), at - above
        low, high = max(0, by), len(grid) + min(0, by)
        out[low:high] += moved[low - by : high - by]
    return out
