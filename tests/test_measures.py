"""Operators against direct NumPy formulas, known numbers and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import covaria
from covaria.functions import edges, windows
from covaria.operators import autoregression, bivariate, envelope, multivariate, spectra, surrogates, symbols
from covaria.plans.frame import ConnFrame, Meta, degree, read_connectivity
from covaria.sources import signals
from covaria.streaming import epochs as streaming

SFREQ = 50.0


def vectors(spark, data):
    return spark.createDataFrame([(e, c, [float(v) for v in x]) for e, epoch in enumerate(data) for c, x in enumerate(epoch)], "epoch long, ch int, x array<double>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.RandomState(0)
    x = rng.randn(8, 3, 64)
    x[:, 1] = 0.8 * np.roll(x[:, 0], 2, axis=1) + 0.3 * rng.randn(8, 64)
    return x


def cross(data):
    s = np.fft.rfft((data - data.mean(2, keepdims=True)) * np.hanning(data.shape[2]), axis=2)
    return lambda i, j: 2 * s[:, i] * s[:, j].conj()


def test_measures_over_epochs(spark, data):
    bins = spectra.chosen_bins(64, SFREQ, [(5, 20)])
    found = bivariate.over_epochs(spectra.csd(spectra.fourier(vectors(spark, data), 64, SFREQ, bins)), list(bivariate.EPOCHS)).collect()
    assert len(found) == 3 * len(bins)
    c, n = cross(data), len(data)
    for r in found:
        s, px, py = (c(i, j)[:, r.f] for i, j in ((r.seed, r.target), (r.seed, r.seed), (r.target, r.target)))
        root, u, im = np.sqrt(px.real.mean() * py.real.mean()), s / abs(s), s.imag
        want = {"coh": abs(s.mean()) / root, "cohy_re": s.mean().real / root, "cohy_im": s.mean().imag / root, "imcoh": im.mean() / root, "plv": abs(u.mean()), "ciplv": abs(u.mean().imag) / np.sqrt(1 - u.mean().real ** 2), "ppc": (abs(u.sum()) ** 2 - n) / (n * (n - 1)), "pli": abs(np.sign(im).mean()), "pli2_unbiased": (n * np.sign(im).mean() ** 2 - 1) / (n - 1), "dpli": np.heaviside(im, 0.5).mean(), "wpli": abs(im.sum()) / abs(im).sum(), "wpli2_debiased": (im.sum() ** 2 - (im**2).sum()) / (abs(im).sum() ** 2 - (im**2).sum())}
        assert {k: pytest.approx(v, abs=1e-9) for k, v in want.items()} == {k: r[k] for k in want}


def test_zero_denominators(spark):
    cross_ = spark.createDataFrame([(0, 1, 0, 3, 3.0, 0.0, 0.0, 0.0, 0.0), (1, 1, 0, 3, 3.0, 0.0, 0.0, 0.0, 0.0)], "epoch long, seed int, target int, f int, freq double, re double, im double, pxx double, pyy double")
    r = bivariate.over_epochs(cross_, list(bivariate.EPOCHS)).first()
    assert np.isnan(r.coh) and np.isnan(r.plv) and r.wpli == 0 and r.wpli2_debiased == 0 and r.pli == 0 and r.dpli == 0.5 and r.ppc == -1
    with pytest.raises(ValueError):
        bivariate.over_epochs(cross_, ["none"])


def test_multitaper_is_coherent_in_band(spark):
    rng = np.random.RandomState(0)
    x = rng.randn(8, 3, 256)
    taps = windows.band_pass(65, 5, 15, 2, SFREQ)
    x[:, 1] = [np.convolve(v, taps, "same") + 1e-2 * w for v, w in zip(x[:, 0], x[:, 1], strict=True)]
    frame = covaria.spectral_connectivity_epochs(vectors(spark, x), "coh", ([1, 2], [0, 0]), SFREQ, fmin=(7, 20), fmax=(13, 24), faverage=True)
    got = {(r.con, r.band): r.value for r in frame.df.collect()}
    assert got[0, 0] > 0.95 and got[1, 0] < 0.6 and got[1, 1] < 0.6
    dense = covaria.spectral_connectivity_epochs(vectors(spark, x), "coh", None, SFREQ, fmin=7, fmax=9).get_data("dense")
    assert {r.seed - r.target > 0: r.c for r in dense.groupBy("seed", "target").agg(F.max("value").alias("c")).collect() if r.seed <= r.target} == {False: 0.0}


def test_tapers():
    tapers, ratios = windows.dpss(64, 4.0)
    assert np.allclose(tapers @ tapers.T, np.eye(len(tapers)), atol=1e-10) and len(tapers) == 7 and ratios.min() > 0.9
    with pytest.raises(ValueError):
        windows.smoothing_kernel(2, 1)
    for b, a in windows.butterworth(6, 0.3):
        assert abs(b.sum() / a.sum() - 1) < 1e-9
    x = np.sin(np.linspace(0, 20, 400))
    assert np.abs(windows.zero_phase(x, windows.butterworth(6, 0.5)) - x).max() < 1e-2


def test_phase_locked_over_time(spark):
    rng, t = np.random.default_rng(0), np.arange(250) / 250
    x = np.array([[np.sin(2 * np.pi * 10 * t + p) for p in (0, 0.5, 1.5)] for _ in range(3)])
    locked = covaria.spectral_connectivity_time(vectors(spark, x), [8.0, 10.0, 12.0], ["coh", "plv", "wpli"], sfreq=250, n_cycles=3, average=True)
    for frame in locked:
        assert frame.df.agg(F.min("value")).first()[0] > 0.98
    noise = covaria.spectral_connectivity_time(vectors(spark, rng.uniform(size=(3, 3, 250))), [20.0, 40.0], "plv", sfreq=250, n_cycles=3, average=True)
    assert noise.df.agg(F.max("value")).first()[0] < 0.7


def test_foi_band_end_is_doubled(spark):
    rows = spark.createDataFrame([(0, 1, 0, f, float(f), float(f)) for f in range(8)], "epoch long, seed int, target int, f int, freq double, v double")
    got = {r.band: r.v for r in bivariate.foi_banded(rows, [float(f) for f in range(8)], [(1, 3), (2, 2)]).collect()}
    assert got == {0: 3.0, 1: 2.0}  # bins 1 to 5; bin 2
    assert bivariate.foi_banded(rows, [float(f) for f in range(8)], [(1, 3)], True).first().v == 2.0


def test_phase_slope(spark):
    rng = np.random.RandomState(42)
    x = rng.randn(10, 3, 500)
    x[:, 1] = np.roll(x[:, 0], 10, axis=1)
    x[:, 2] = np.roll(x[:, 0], -10, axis=1)
    got = {(r.seed, r.target): r.value for r in covaria.phase_slope_index(vectors(spark, x), ([0, 0, 1], [1, 2, 0]), SFREQ, "fourier").df.collect()}
    assert got[0, 1] > 0 > got[0, 2] and got[0, 1] == pytest.approx(-got[1, 0])


def test_envelopes(spark):
    x = np.random.RandomState(0).randn(2, 4, 64)
    z = windows.analytic(x)
    for orth in (False, "pairwise"):
        for r in covaria.envelope_correlation(vectors(spark, x), orth).df.collect():
            a, b = z[r.epoch, r.seed], z[r.epoch, r.target]
            corr = lambda p, q: np.corrcoef(p, q)[0, 1]
            if orth:
                want = (abs(corr(abs((a * (b.conj() / abs(b))).imag), abs(b))) + abs(corr(abs((b * (a.conj() / abs(a))).imag), abs(a)))) / 2
            else:
                want = corr(abs(a), abs(b))
            assert r.value == pytest.approx(want, abs=1e-10)
    with pytest.raises(ValueError):
        envelope.correlation(vectors(spark, x), "other")
    assert [windows.fast_length(n) for n in (1, 7, 24, 64, 65, 97, 1021)] == [1, 8, 24, 64, 72, 100, 1024]
    odd = np.random.RandomState(1).randn(3, 97)
    gain = np.r_[1, np.full(49, 2), 1, np.zeros(49)]
    assert np.allclose(windows.analytic(odd), np.fft.ifft(np.fft.fft(odd, 100) * gain)[:, :97])


def test_symmetric_orth(spark):
    x = np.random.RandomState(0).randn(5, 5) @ np.random.RandomState(1).randn(5, 1000)
    rows = covaria.symmetric_orth(vectors(spark, [x])).orderBy("ch").collect()
    p = np.array([r.x for r in rows])
    product = p @ p.T
    assert np.abs(product - np.diag(np.diag(product))).max() < 1e-6 * np.diag(product).max()
    with pytest.raises(ValueError):
        envelope.symmetric_orth_matrix(np.ones((5, 3)))


def test_wsmi(spark):
    t = np.arange(250) / 100
    sine = np.sin(2 * np.pi * 10 * t)
    x = np.array([[sine, sine, np.random.RandomState(e).randn(250)] for e in range(2)])
    got = {(r.epoch, r.seed, r.target): r.value for r in symbols.wsmi(vectors(spark, x)).collect()}
    plain = {(r.epoch, r.seed, r.target): r.value for r in symbols.wsmi(vectors(spark, x), weighted=False).collect()}
    assert got[0, 1, 0] == pytest.approx(0, abs=1e-12) and plain[0, 1, 0] > 0.5
    assert all(-1e-9 <= got[k] <= plain[k] + 1e-9 for k in got if k[1:] == (1, 0))
    assert symbols.alphabet(3) == [(0, 1, 2), (0, 2, 1), (1, 0, 2), (2, 0, 1), (1, 2, 0), (2, 1, 0)]
    assert all(p[::-1] == symbols.alphabet(4)[23 - i] for i, p in enumerate(symbols.alphabet(4)))
    with pytest.raises(ValueError):
        symbols.wsmi(vectors(spark, np.ones((1, 2, 3))), 4, 2)


def test_filters_in_blocks_equal_one_run(spark):
    sections, rng = windows.butterworth(6, 1 / 3), np.random.default_rng(3)
    for n in (50, 400, 5000, 20_001):
        x = rng.normal(size=n).cumsum()
        assert np.allclose(windows.zero_phase_long(x, sections), windows.zero_phase(x, sections), atol=1e-9 * np.abs(x).max())
    x = rng.normal(size=(60, 2, 40))
    want = [windows.zero_phase(x[:, c].ravel(), windows.butterworth(6, 2 / 3 / 2)).reshape(60, 40) for c in range(2)]
    for r in symbols.antialiased(vectors(spark, x), SFREQ, 3, 2, together=400).collect():  # six blocks a channel
        assert np.allclose(r.x, want[r.ch][r.epoch], atol=1e-9)


def test_smoothing_equals_a_slow_sum(spark):
    rng = np.random.default_rng(4)
    grid = rng.normal(size=(4, 9))
    cross_ = spark.createDataFrame([(0, 1, 0, f, f * 2.0, t + 3, *[float(v) for v in rng.normal(size=3)], float(grid[f, t])) for f in range(4) for t in range(9)], "epoch long, seed int, target int, f int, freq double, t int, re double, im double, pxx double, pyy double")
    for kernel, per_freq in ((rng.random((3, 5)), False), (rng.random((2, 4)), False), (rng.random((4, 3)), True), (windows.smoothing_kernel([5, 3, 1, 4], kind="square"), True)):
        got = {(r.f, r.t): r.pyy for r in spectra.smoothed(cross_, kernel, per_freq).collect()}
        for f in range(4):
            for t in range(9):
                rows = [(0, kernel[f])] if per_freq else [(i - (len(kernel) - 1) // 2, k) for i, k in enumerate(kernel)]
                want = sum(w * grid[f - i, t - j + (len(k) - 1) // 2] for i, k in rows for j, w in enumerate(k) if 0 <= f - i < 4 and 0 <= t - j + (len(k) - 1) // 2 < 9)
                assert got[f, t + 3] == pytest.approx(want, abs=1e-12)


def test_pruned_channels_are_never_computed(spark, data):
    x = vectors(spark, data)
    pairs = ([1, 0], [0, 1])
    some = covaria.spectral_connectivity_epochs(x, "coh", pairs, SFREQ, "fourier", fmin=5, fmax=20).df
    every = {(r.seed, r.target, r.f): r.value for r in covaria.spectral_connectivity_epochs(x, "coh", None, SFREQ, "fourier", fmin=5, fmax=20).df.collect()}
    rows = some.collect()
    assert {r.con for r in rows} == {0, 1} and all(r.value == pytest.approx(every[1, 0, r.f]) for r in rows) and len(rows) == 2 * len({f for *_, f in every})
    poisoned = x.unionByName(spark.createDataFrame([(0, 2, None)], "epoch long, ch int, x array<double>").where("ch = 2")).where("NOT (ch = 2 AND x IS NOT NULL)")
    found = covaria.spectral_connectivity_epochs(poisoned, "coh", pairs, SFREQ, "fourier", fmin=5, fmax=20, shape=(3, 64)).df.collect()
    assert {(r.con, r.f): r.value for r in found} == {(r.con, r.f): pytest.approx(r.value) for r in rows}


def test_largest_coherence_beats_a_fine_grid():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (2, 3), (4, 4)):
        for _ in range(20):
            c = rng.normal(size=(n, m)) + 1j * rng.normal(size=(n, m))
            best, phi, u, v = multivariate.largest_over_phases(c)
            grid = max(np.linalg.svd((np.exp(-1j * p) * c).real, compute_uv=False)[0] for p in np.linspace(0, np.pi, 2001))
            assert -np.pi / 2 < phi <= np.pi / 2 and best >= grid - 1e-12 and best <= grid * (1 + 1e-5)
            assert (u.T @ (np.exp(-1j * phi) * c).real @ v)[0, 0] == pytest.approx(best)


def test_autoregression(spark):
    rng, a = np.random.RandomState(12345), np.array([[1, 1], [-1, 2]]) / np.sqrt(3)
    x = np.zeros((2, 100))
    x[:, 0] = 0.5, 1
    for t in range(1, 100):
        x[:, t] = a @ x[:, t - 1] + 1e-4 * rng.randn(2)
    for model in ("dynamic", "avg-epochs"):
        rows = autoregression.fit(vectors(spark, [x]), model=model).collect()
        got = np.zeros((2, 2))
        for r in rows:
            got[r.i, r.j] = r.value
        assert np.allclose(got, a, atol=1e-3)
    y = np.random.RandomState(0).randn(3, 3, 64)
    model = autoregression.fit(vectors(spark, y), 2, 0.5)
    z = np.concatenate([y[1][:, 1:-1], y[1][:, :-2]])
    want = np.linalg.solve(z @ z.T + 0.5 * np.eye(6), z @ y[1][:, 2:].T).T
    for r in model.where("epoch = 1").collect():
        assert r.value == pytest.approx(want[r.i, r.j + 3 * (r.lag - 1)], abs=1e-9)
    seen = autoregression.predicted(vectors(spark, y), model).where("epoch = 1").collect()
    guess = np.concatenate([np.zeros((3, 2)), want @ z], axis=1)
    assert all(r.predicted == pytest.approx(guess[r.ch, r.t], abs=1e-9) for r in seen) and len(seen) == 192
    assert autoregression.companion(model).where("epoch = 1").count() == 18 + 3
    frame = covaria.vector_auto_regression(vectors(spark, y), 2)
    assert frame.kind == "EpochTemporalConnectivity" and frame.is_stable()
    assert frame.simulate(50).count() == 3


def test_order_selection(spark):
    rng = np.random.RandomState(12345)
    x = np.zeros((2, 400))
    for t in range(2, 400):
        x[:, t] = 0.3 * x[:, t - 1] - 0.5 * x[:, t - 2] + rng.randn(2)
    best = autoregression.best_order(autoregression.select_order(vectors(spark, [x]), 5)).first()
    assert best.bic == 2 and best.hqic == 2
    with pytest.raises(Exception, match="samples"):
        autoregression.select_order(vectors(spark, [x]), 200).collect()


def test_sets_of_signals(spark, data):
    bins = spectra.chosen_bins(64, SFREQ, [(5, 20)])
    full = spectra.csd(spectra.fourier(vectors(spark, data), 64, SFREQ, bins), diagonal=True)
    pair = bivariate.over_epochs(full, ["coh", "imcoh"]).where("seed = 1 AND target = 0").orderBy("f").collect()
    one = [([1], [0])]
    rows = multivariate.coherency(multivariate.packed(full, one), one, ["mic", "mim", "cacoh"]).orderBy("f").collect()
    for p, m in zip(pair, rows, strict=True):
        assert m.mim == pytest.approx(p.imcoh**2) and abs(m.mic) == pytest.approx(abs(p.imcoh)) and np.hypot(m.cacoh_re, m.cacoh_im) == pytest.approx(p.coh, abs=1e-6)
    sets = [([0, 1], [2])]
    many = multivariate.coherency(multivariate.packed(full, sets), sets, ["mic", "mim", "cacoh"], n_components=None).collect()
    assert all(0 <= r.mim <= 1 + 1e-9 and np.hypot(r.cacoh_re, r.cacoh_im) <= 1 + 1e-9 for r in many) and len(many) == len(bins)
    assert multivariate.ranks(vectors(spark, np.repeat(data[:, :1], 2, axis=1)), [([0, 1], [0])]) == [(1, 1)]


def test_granger_has_a_direction(spark):
    x = covaria.make_signals_in_freq_bands(spark, 1, 1, (10, 30), n_epochs=30, n_times=200, sfreq=100.0, connection_delay=3, snr=0.8, seed=3)
    bins = range(101)
    full = spectra.csd(spectra.fourier(x, 200, 100.0, bins), diagonal=True)
    both = [([0], [1]), ([1], [0])]
    found = multivariate.causality(multivariate.packed(full, both), both, 10, ["gc", "gc_tr"])
    mean = {r.con: (r.g, r.t) for r in found.where("freq BETWEEN 12 AND 28").groupBy("con").agg(F.avg("gc").alias("g"), F.avg("gc_tr").alias("t")).collect()}
    assert mean[0][0] > 2 * mean[1][0] and mean[0][0] - mean[1][0] > mean[0][1] - mean[1][1]
    with pytest.raises(ValueError):
        multivariate.check([([0], [0, 1])], ["gc"])


def test_causality_of_leading_components():
    """Two seeds that are one signal have one component, and cause what that signal causes; without ranks they are refused."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 2, 64))
    x[:, 1, 2:] += 0.9 * x[:, 0, :-2]
    s = np.fft.rfft((x - x.mean(2, keepdims=True)) * np.hanning(64), axis=2)
    c = np.einsum("eif,ejf->fij", s, s.conj()) / len(x)
    alone = multivariate.granger(c, 1, 4)
    twice = c[:, [0, 0, 1]][:, :, [0, 0, 1]]
    assert np.allclose(multivariate.granger(twice, 2, 4, (1, 1)), alone)
    with pytest.raises(RuntimeError):
        multivariate.granger(twice, 2, 4)


def test_simulated_signals_follow_the_model(spark):
    """Zero noise stays at zero; a step of noise decays as powers of the coefficients; draws don't depend on partitions."""
    a = np.array([[0.5, 0.2], [0.0, -0.3]])
    model = spark.createDataFrame([(None, i, j, 1, float(a[i, j])) for i in range(2) for j in range(2)], "epoch long, i int, j int, lag int, value double")
    still = autoregression.simulated(model, 6, noise=lambda rng, k: np.zeros(k)).collect()
    assert all(v == 0 for r in still for v in r.x)
    pushed = {r.ch: r.x for r in autoregression.simulated(model, 6, noise=lambda rng, k: np.ones(k)).collect()}
    x = np.zeros(2)
    for t in range(16):
        x = a @ x + 1
        if t >= 10:
            assert [pushed[0][t - 10], pushed[1][t - 10]] == pytest.approx(x)
    one, two = (sorted((r.ch, tuple(r.x)) for r in autoregression.simulated(m, 50, seed=4).collect()) for m in (model, model.repartition(3)))
    assert one == two and abs(np.std(one[0][1]) - 1) < 0.5


def test_decomposition_raises_coherency(spark):
    x = covaria.make_signals_in_freq_bands(spark, 2, 2, (10, 14), n_epochs=20, n_times=100, sfreq=100.0, connection_delay=2, snr=0.5, seed=1)
    model = covaria.CoherencyDecomposition(100.0, ([0, 1], [2, 3]), 10, 14, "mic", "fourier", 1).fit(x)
    through = covaria.spectral_connectivity_epochs(model.transform(x), "imcoh", ([0], [1]), 100.0, "fourier", fmin=10, fmax=14, faverage=True).df.first().value
    raw = covaria.spectral_connectivity_epochs(x, "imcoh", ([0], [2]), 100.0, "fourier", fmin=10, fmax=14, faverage=True).df.first().value
    assert abs(through) > abs(raw) and model.get_transformed_indices() == ([0], [1])


def test_surrogates(spark, data):
    x = vectors(spark, data)
    moved = surrogates.resting(x, 5, 1)
    assert moved.count() == 5 * x.count()
    same = moved.groupBy("shuffle", "ch").agg(F.array_sort(F.collect_list(F.element_at("x", 1))).alias("v")).groupBy("ch").agg(F.count_distinct("v").alias("n"))
    assert {r.n for r in same.collect()} == {1}
    cut = surrogates.evoked(x, 2, 1).where("shuffle = 0 AND epoch = 0 AND ch = 0").first().x
    assert sorted(cut) == pytest.approx(sorted(data[0, 0])) and any(np.allclose(np.roll(data[0, 0], k), cut) for k in range(1, 64))
    with pytest.raises(ValueError):
        surrogates.check_resting(vectors(spark, data[:1]))
    with pytest.warns(FutureWarning):
        surrogates.surrogate_data(x, 1)


def test_edges():
    assert edges.seed_target_indices([0, 1], [2, 3, 4]) == ([0, 0, 0, 1, 1, 1], [2, 3, 4, 2, 3, 4])
    assert edges.seed_target_multivariate_indices([[0, 1]], [[2], [3, 4]]) == ([[0, 1], [0, 1]], [[2], [3, 4]])
    assert edges.check_multivariate_indices(([[0, -1]], [[1]]), 4) == [([0, 3], [1])]
    for bad in ([[0], [1]], ([0], [1, 2]), [0, 1]):
        with pytest.raises(ValueError):
            edges.check_indices(bad)
    for bad in (([[0]], [1]), ([0], [(1, 2)]), ([0], [np.array([1])])):
        with pytest.raises(TypeError):
            edges.check_indices(bad)
    for bad in (([[-4]], [[1]]), ([[4]], [[1]]), ([[1, 1]], [[0]]), ([[1, -3]], [[0]]), ([[0]], [[1], [2]])):
        with pytest.raises(ValueError):
            edges.check_multivariate_indices(bad, 4)
    for call in (lambda: edges.seed_target_multivariate_indices([0], [[1]]), lambda: edges.seed_target_multivariate_indices(0, [[1]]), lambda: edges.check_multivariate_indices(([0], [1]), 4)):
        with pytest.raises(TypeError):
            call()
    assert edges.padded_indices(([[0, 1, 2], [3]], [[3], [0, -2]]), 4).tolist() == [[[0, 1, 2], [3, -1, -1]], [[3, -1, -1], [0, 2, -1]]]


def test_degree(spark):
    m = [[0.5, 0.7, 0.4], [0.1, 0.3, 0.6], [0.2, 0.8, 0.9]]
    dense = spark.createDataFrame([(i, j, m[i][j]) for i in range(3) for j in range(3)], "seed int, target int, value double")
    got = {p: [r.degree for r in degree(dense, 3, p).orderBy("node").collect()] for p in (0.33, 0.5, 0.66, 1)}
    assert got == {0.33: [0, 2, 0], 0.5: [0, 2, 1], 0.66: [0, 2, 2], 1: [2, 2, 2]}
    even = spark.createDataFrame([(i, j, (m[i][j] + m[j][i]) / 2) for i in range(3) for j in range(3)], "seed int, target int, value double")
    assert [r.degree for r in degree(even, 3, 0.33).orderBy("node").collect()] == [0, 1, 1]


def test_frames(spark, tmp_path):
    rows = spark.createDataFrame([(e, 1, 0, float(e)) for e in range(3)], "epoch long, seed int, target int, value double")
    frame = ConnFrame(rows, Meta("m", 2, "symmetric", event_id={"a": 1}))
    assert frame.kind == "EpochConnectivity" and frame.n_epochs == 3
    assert frame.combine("mean").df.first().value == 1.0 and frame.combine(lambda v: v.max()).df.first().value == 2.0
    both = frame.append(frame)
    assert both.n_epochs == 6
    dense = frame.combine("median").get_data("dense").collect()
    assert {(r.seed, r.target): r.value for r in dense} == {(0, 0): 0.0, (0, 1): 1.0, (1, 0): 1.0, (1, 1): 0.0}
    frame.save(str(tmp_path / "c"))
    again = read_connectivity(spark, str(tmp_path / "c"))
    assert again.meta == frame.meta and again.df.count() == 3 and again.kind == frame.kind
    assert frame.rename_nodes({"0": "x"}).names == ["x", "1"]
    for bad in ({"9": "x"}, {"0": "1"}):
        with pytest.raises(ValueError):
            frame.rename_nodes(bad)
    with pytest.raises(ValueError):
        frame.combine("mean").combine("mean")
    assert frame.strongest(1).first().epoch == 2


def test_sources(spark):
    cells = spark.createDataFrame([(0, 0, 1, 5.0), (1, 1, 0, 2.0)], "epoch long, ch int, t int, value double")
    dense = signals.densify(cells, cells.select("ch"), 2)
    assert {(r.epoch, r.ch): r.x for r in dense.collect()} == {(0, 0): [0.0, 5.0], (0, 1): [0.0, 0.0], (1, 0): [0.0, 0.0], (1, 1): [2.0, 0.0]}
    with pytest.raises(ValueError):
        signals.stacked(dense, signals.window(dense, 1.0, 0, 0))
    assert signals.from_long(signals.to_long(dense)).count() == 4


def test_stream_equals_batch(spark, data, tmp_path):
    x, bins = vectors(spark, data), np.arange(5, 12)
    streaming.whole_epochs(x).repartition(3, "epoch").write.parquet(str(tmp_path / "in"))
    running = streaming.measures(streaming.source(spark, str(tmp_path / "in"), maxFilesPerTrigger="1"), SFREQ, bins, ["coh", "wpli"])
    running.writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start().awaitTermination()
    batch = bivariate.over_epochs(spectra.csd(spectra.fourier(x, 64, SFREQ, bins)), ["coh", "wpli"])
    got, want = ({(r.seed, r.target, r.f): (r.coh, r.wpli) for r in df.collect()} for df in (spark.table("seen"), batch))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
