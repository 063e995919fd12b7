"""Windows, tapers, wavelets and kernels: small NumPy constants made on the driver."""

from __future__ import annotations

import math

import numpy as np


def hann(n: int) -> np.ndarray:
    """Symmetric Hann window."""
    return np.hanning(n)


def _largest_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues of a symmetric tridiagonal matrix by bisection: signs of pivots count those above a value."""
    reach = np.abs(np.r_[e, 0]) + np.abs(np.r_[0, e])
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    tiny = np.finfo(float).tiny * 1e8
    while (high - low > 4 * np.finfo(float).eps * np.maximum(np.abs(low), np.abs(high))).any():
        middle = (low + high) / 2
        if ((middle == low) | (middle == high)).all():
            break
        above, pivot = np.zeros(k, int), np.ones(k)
        for i in range(len(d)):
            pivot = d[i] - middle - (e[i - 1] ** 2 / pivot if i else 0)
            pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
            above += pivot > 0
        enough = above > np.arange(k)
        low, high = np.where(enough, middle, low), np.where(enough, high, middle)
    return (low + high) / 2


def _solved(d: np.ndarray, e: np.ndarray, shifts: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows x of (T - shift) x = b by elimination with row exchanges, all shifts at once."""
    n, k = len(d), len(shifts)
    upper, y, tiny = np.zeros((n, 3, k)), np.zeros((n, k)), np.finfo(float).eps * max(1.0, np.abs(d).max())
    row, right = np.array([d[0] - shifts, np.full(k, e[0] if n > 1 else 0.0), np.zeros(k)]), b[:, 0]
    for i in range(n - 1):
        below, left = np.array([np.full(k, e[i]), d[i + 1] - shifts, np.full(k, e[i + 1] if i + 2 < n else 0.0)]), b[:, i + 1]
        swap = np.abs(below[0]) > np.abs(row[0])
        upper[i], y[i] = np.where(swap, below, row), np.where(swap, left, right)
        other, right = np.where(swap, row, below), np.where(swap, right, left)
        upper[i, 0] = np.where(upper[i, 0] == 0, tiny, upper[i, 0])
        m = other[0] / upper[i, 0]
        row, right = np.array([other[1] - m * upper[i, 1], other[2] - m * upper[i, 2], np.zeros(k)]), right - m * y[i]
    upper[n - 1, 0], y[n - 1] = np.where(np.abs(row[0]) < tiny, tiny, row[0]), right
    x = np.zeros((n + 2, k))
    for i in range(n - 1, -1, -1):
        x[i] = (y[i] - upper[i, 1] * x[i + 1] - upper[i, 2] * x[i + 2]) / upper[i, 0]
    return x[:n].T


def dpss(n: int, half_bandwidth: float = 4.0, n_tapers: int | None = None, low_bias: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Slepian tapers and their concentrations, from the commuting tridiagonal matrix (Slepian 1978).

    Only the leading eigenvectors are computed, by bisection and inverse iteration, and a
    concentration is the taper's autocorrelation summed under the kernel: time and memory go with n.
    """
    n_tapers = min(n, n_tapers or max(1, int(2 * half_bandwidth)))
    w, k = half_bandwidth / n, np.arange(n)
    diagonal, off = ((n - 1 - 2 * k) / 2.0) ** 2 * math.cos(2 * math.pi * w), k[1:] * (n - k[1:]) / 2.0
    values = _largest_eigenvalues(diagonal, off, n_tapers)
    tapers = np.cos(np.pi * (k + 0.5) * np.arange(n_tapers)[:, None] / n) + 0.01 * (k + 1) / n
    for _ in range(3):
        tapers = _solved(diagonal, off, values, tapers / np.linalg.norm(tapers, axis=1)[:, None])
    tapers /= np.linalg.norm(tapers, axis=1)[:, None]
    for i, taper in enumerate(tapers):
        lead = taper.sum() if i % 2 == 0 else ((n - 1) / 2.0 - k) @ taper
        tapers[i] *= -1 if lead < 0 else 1
    size = 2 ** math.ceil(math.log2(2 * n))
    with_itself = np.fft.irfft(np.abs(np.fft.rfft(tapers, size)) ** 2, size)[:, :n]
    kernel = np.r_[2 * w, 2 * np.sin(2 * math.pi * w * k[1:]) / (math.pi * np.maximum(1, k[1:]))]
    ratios = with_itself @ kernel
    if low_bias:
        keep = ratios > 0.9
        keep[np.argmax(ratios)] = True
        tapers, ratios = tapers[keep], ratios[keep]
    return tapers, ratios


def morlet(sfreq: float, freqs, n_cycles=7.0, zero_mean: bool = False) -> list[np.ndarray]:
    """Complex Morlet wavelets, five standard deviations to each side (Tallon-Baudry et al. 1997)."""
    freqs = np.atleast_1d(np.asarray(freqs, float))
    out = []
    for f, c in zip(freqs, np.broadcast_to(n_cycles, freqs.shape), strict=True):
        sigma = c / (2 * math.pi * f)
        half = np.arange(0, 5 * sigma, 1 / sfreq)
        t = np.concatenate([-half[:0:-1], half])
        wave = np.exp(2j * math.pi * f * t)
        if zero_mean:
            wave -= math.exp(-2 * (math.pi * f * sigma) ** 2)
        wave = wave * np.exp(-(t**2) / (2 * sigma**2))
        out.append(wave / (math.sqrt(0.5) * np.linalg.norm(wave)))
    return out


def tapered_waves(sfreq: float, freqs, n_cycles=7.0, time_bandwidth: float = 4.0) -> list[list[tuple[np.ndarray, float]]]:
    """For each frequency complex waves of n_cycles under Slepian tapers, and their weights."""
    freqs, out = np.atleast_1d(np.asarray(freqs, float)), []
    for f, c in zip(freqs, np.broadcast_to(np.asarray(n_cycles, float), freqs.shape), strict=True):
        t = np.arange(0, c / f, 1 / sfreq)
        tapers, ratios = dpss(len(t), time_bandwidth / 2, max(1, int(time_bandwidth - 1)), low_bias=False)
        waves = np.exp(2j * np.pi * f * (t - t[-1] / 2)) * tapers
        out.append([(w / (math.sqrt(0.5) * np.linalg.norm(w)), math.sqrt(r)) for w, r in zip(waves, ratios, strict=True)])
    return out


def tukey(n: int, alpha: float = 0.5) -> np.ndarray:
    """Tapered cosine window."""
    if alpha <= 0:
        return np.ones(n)
    if alpha >= 1:
        return hann(n)
    edge = int(alpha * (n - 1) / 2)
    window, k = np.ones(n), np.arange(edge + 1)
    window[: edge + 1] = 0.5 * (1 + np.cos(np.pi * (2 * k / alpha / (n - 1) - 1)))
    window[n - edge - 1 :] = window[: edge + 1][::-1]
    return window


def smoothing_kernel(n_times, n_freqs: int = 1, kind: str = "hanning") -> np.ndarray:
    """Weights (freq, time) that sum to one; for several n_times a row of its own for each frequency, each summing to one.

    Rows shorter than the longest have zeros around them, an odd one at the end.
    """
    shapes = {"square": np.ones, "hanning": np.hanning}
    if kind not in shapes:
        raise ValueError(f"kernel must be 'square' or 'hanning', not {kind!r}")
    several = np.ndim(n_times) > 0
    widths = [int(n) for n in np.atleast_1d(n_times)]
    if kind == "hanning" and 2 in (*widths, 1 if several else n_freqs):
        raise ValueError("a Hann kernel of width 2 is all zeros; take another width or the square kernel")
    rows = [shapes[kind](n) for n in widths]
    if not several:
        kernel = np.outer(shapes[kind](n_freqs), rows[0])
        return kernel / kernel.sum()
    out = np.zeros((len(rows), max(widths)))
    for kernel, row in zip(out, rows, strict=True):
        first = (len(kernel) - len(row)) // 2
        kernel[first : first + len(row)] = row / row.sum()
    return out


def butterworth(order: int, cutoff: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Low-pass second-order sections (b, a) by the bilinear transform; cutoff as a share of Nyquist."""
    warped = 2 * math.tan(math.pi * cutoff / 2)
    sections = []
    for k in range(order // 2):
        q = -2 * math.cos(math.pi * (2 * k + order + 1) / (2 * order))
        a = np.array([4 + 2 * q * warped + warped**2, 2 * warped**2 - 8, 4 - 2 * q * warped + warped**2])
        sections.append((np.array([1.0, 2.0, 1.0]) * warped**2 / a[0], a / a[0]))
    return sections


def zero_phase(x: np.ndarray, sections) -> np.ndarray:
    """Sections run forward and backward along the last axis over an odd extension at both ends."""
    pad = min(3 * (2 * len(sections) + 1), x.shape[-1] - 1)
    y = np.concatenate([2 * x[..., :1] - x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], axis=-1)
    for _ in range(2):
        for b, a in sections:
            # start as if the first value had been there for ever
            first = y[..., 0]
            z2 = (b[2] - a[2]) * first
            z1 = (b[1] - a[1]) * first + z2
            out = np.empty_like(y)
            for i in range(y.shape[-1]):
                v = y[..., i]
                out[..., i] = b[0] * v + z1
                z1 = b[1] * v - a[1] * out[..., i] + z2
                z2 = b[2] * v - a[2] * out[..., i]
            y = out
        y = y[..., ::-1]
    return y[..., pad : y.shape[-1] - pad]


def settled_after(sections, left: float = 1e-15) -> int:
    """Samples after which what came before matters less than that, of the sections' slowest pole."""
    slowest = max(np.abs(np.roots(a)).max() for _, a in sections)
    return math.ceil(math.log(left) / math.log(slowest)) + 3 * (2 * len(sections) + 1)


def zero_phase_long(x: np.ndarray, sections) -> np.ndarray:
    """As zero_phase of one long signal, in overlapping windows that are filtered side by side.

    A window reaches so far beyond what is kept of it that its ends no longer matter; the first and
    the last end where the signal does.
    """
    margin = settled_after(sections)
    kept = 4 * margin
    if len(x) <= kept + 2 * margin:
        return zero_phase(x, sections)
    starts = np.append(np.arange(0, len(x) - kept - 2 * margin, kept), len(x) - kept - 2 * margin)
    found = zero_phase(np.stack([x[s : s + kept + 2 * margin] for s in starts]), sections)
    out = np.empty_like(x)
    out[-margin:], out[:margin] = found[-1, -margin:], found[0, :margin]
    for s, y in zip(starts, found, strict=True):
        out[s + margin : s + margin + kept] = y[margin : margin + kept]
    return out


def band_pass(n_taps: int, low: float, high: float, trans: float, sfreq: float) -> np.ndarray:
    """Linear-phase FIR by frequency sampling under a Hamming window."""
    grid = np.linspace(0, sfreq / 2, 1025)
    gain = np.interp(grid, [0, max(low - trans, 0), low, high, min(high + trans, sfreq / 2), sfreq / 2], [0, 0, 1, 1, 0, 0])
    ideal = np.fft.irfft(gain * np.exp(-1j * np.pi * np.arange(1025) / 1024 * (n_taps - 1) / 2))[:n_taps]
    return ideal * np.hamming(n_taps)


def fast_length(n: int) -> int:
    """The smallest length from n on that transforms fast: one without prime factors above 5."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal along the last axis, from a transform of zeros appended up to a fast length."""
    size = fast_length(x.shape[-1])
    gain = np.zeros(size)
    gain[0] = 1
    gain[1 : (size + 1) // 2] = 2
    if size % 2 == 0:
        gain[size // 2] = 1
    return np.fft.ifft(np.fft.fft(x, size) * gain)[..., : x.shape[-1]]
