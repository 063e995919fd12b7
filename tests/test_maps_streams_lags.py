"""Filters and patterns with bad channels, streams of samples, ranks of spectra, numbering, bitmaps and the recursion over lags."""

import datetime as dt
import math
import time
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import covaria
from covaria.operators import bivariate, multivariate, numbering, spectra, surrogates, symbols
from covaria.plans.frame import read_connectivity
from covaria.sources import signals
from covaria.streaming import epochs, samples

SFREQ = 50.0
BINS = list(range(5, 21))


def vectors(spark, data, names=None):
    rows = [(e, (names or range(data.shape[1]))[c], [float(v) for v in x]) for e, epoch in enumerate(data) for c, x in enumerate(epoch)]
    return spark.createDataFrame(rows, "epoch long, ch int, x array<double>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.RandomState(0)
    x = rng.randn(12, 5, 64)
    x[:, 3] = 0.7 * np.roll(x[:, 0], 2, axis=1) + 0.4 * x[:, 3]
    return x


# filters and patterns


def of(df, *keys):
    return {tuple(r[k] for k in keys): r.value for r in df.collect()}


def test_a_bad_channel_in_the_middle_has_zeros_at_its_place(spark, data, tmp_path):
    x = vectors(spark, data)
    options = {"sfreq": SFREQ, "mode": "fourier", "fmin": 5, "fmax": 15, "shape": (5, 64)}
    frames = covaria.spectral_connectivity_epochs(x, ["mic", "mim", "cacoh"], indices=([[0, 1, 2]], [[3, 4]]), bads=[1], **options)
    without = covaria.spectral_connectivity_epochs(x, ["mic", "mim", "cacoh"], indices=([[0, 2]], [[3, 4]]), **options)
    assert frames[1].maps is None
    with pytest.raises(ValueError):
        frames[1].patterns.count()
    for frame, other in ((frames[0], without[0]), (frames[2], without[2])):
        for what in ("patterns", "filters"):
            got, want = of(getattr(frame, what), "f", "side", "ch"), of(getattr(other, what), "f", "side", "ch")
            bad = {k: v for k, v in got.items() if k[2] == 1}
            assert len(bad) == len(got) // 5 and set(bad.values()) == {0.0}
            assert {k: v for k, v in got.items() if k[2] != 1} == {k: pytest.approx(v, rel=1e-6, abs=1e-9) for k, v in want.items()}
    frames[0].save(str(tmp_path / "c"))
    again = read_connectivity(spark, str(tmp_path / "c"))
    assert of(again.patterns, "f", "side", "ch") == of(frames[0].patterns, "f", "side", "ch") and again.kind == frames[0].kind
    frames[1].save(str(tmp_path / "d"))
    assert read_connectivity(spark, str(tmp_path / "d")).maps is None
    with pytest.raises(ValueError):
        covaria.spectral_connectivity_epochs(x, "mic", indices=([[1]], [[3, 4]]), bads=[1], **options)


def test_patterns_are_those_of_the_filters(spark, data):
    """A pattern is the covariance with the component that the filter makes, up to the inverse root that both share."""
    x = vectors(spark, data)
    frame = covaria.spectral_connectivity_epochs(x, "cacoh", indices=([[0, 1]], [[3, 4]]), sfreq=SFREQ, mode="fourier", fmin=5, fmax=15, rank=([2], [2]), shape=(5, 64))
    s = np.fft.rfft((data - data.mean(2, keepdims=True)) * np.hanning(64), axis=2)
    patterns, filters = of(frame.patterns, "f", "side", "ch"), of(frame.filters, "f", "side", "ch")
    for f in {k[0] for k in patterns}:
        c = (2 * s[:, :, None, f] * s[:, None, :, f].conj()).mean(0).real
        for side, chs in (("seed", [0, 1]), ("target", [3, 4])):
            want = c[np.ix_(chs, chs)] @ [filters[f, side, ch] for ch in chs]
            assert [patterns[f, side, ch] for ch in chs] == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_maps_of_all_to_all_epochs_and_bands(spark, data):
    x = signals.without(vectors(spark, data), [2])
    frame = covaria.spectral_connectivity_epochs(x, "mic", sfreq=SFREQ, mode="fourier", fmin=(5, 8), fmax=(7, 15), faverage=True, shape=(5, 64))
    got = of(frame.patterns, "band", "side", "ch")
    assert set(got) == {(b, side, ch) for b in (0, 1) for side in ("seed", "target") for ch in range(5)}
    assert all((v == 0) == (k[2] == 2) for k, v in got.items())
    single = covaria.spectral_connectivity_epochs(x, "mic", sfreq=SFREQ, mode="fourier", fmin=5, fmax=15, shape=(5, 64)).patterns
    means = {(r.side, r.ch): r.value for r in single.where("freq BETWEEN 5 AND 7").groupBy("side", "ch").agg(F.avg("value").alias("value")).collect()}
    assert {k[1:]: pytest.approx(v) for k, v in got.items() if k[0] == 0} == means
    options = {"indices": ([[0, 1]], [[3, 4]]), "sfreq": SFREQ, "n_cycles": 3, "rank": ([2], [2]), "n_components": 2, "shape": (5, 64)}
    each = covaria.spectral_connectivity_time(vectors(spark, data[:3]), [10.0, 15.0], "mic", **options)
    assert each.filters.count() == 3 * 2 * 2 * 4 and each.append(each).filters.select("epoch").distinct().count() == 6
    mean = covaria.spectral_connectivity_time(vectors(spark, data[:3]), [10.0, 15.0], "mic", average=True, **options)
    want = of(each.combine("mean").filters, "f", "component", "side", "ch")
    assert of(mean.filters, "f", "component", "side", "ch") == {k: pytest.approx(v) for k, v in want.items()}
    assert of(mean.df, "f", "component") == {k: pytest.approx(v) for k, v in of(each.combine("mean").df, "f", "component").items()}


# ranks of spectra


def test_ranks_of_spectra_are_those_of_their_powers(spark, data):
    sets = [([0, 1], [2, 3, 4]), ([0, 5], [2])]
    x = np.concatenate([data, 2 * data[:, :1]], axis=1)  # channel 5 has the power of channel 0
    found = spectra.fourier(vectors(spark, x), 64, SFREQ, BINS)
    power = np.abs(np.fft.rfft((x - x.mean(2, keepdims=True)) * np.hanning(64), axis=2)[:, :, BINS]) ** 2
    want = [tuple(min(int((s >= s[0] * 1e-6).sum()) for s in np.linalg.svd(power[:, side], compute_uv=False)) for side in pair) for pair in sets]
    assert multivariate.ranks(found, sets) == want == [(2, 3), (1, 1)]
    tapered = spectra.multitaper(vectors(spark, x), 64, SFREQ, BINS)
    assert multivariate.ranks(tapered, sets) == [(2, 3), (1, 1)]
    for whole in (False, True):
        waves = spectra.wavelet(vectors(spark, x), SFREQ, [10.0, 15.0, 20.0], 3.0, whole=whole)
        assert multivariate.ranks(waves, sets) == [(2, 3), (1, 1)]
    frame = covaria.spectral_connectivity_epochs(found, "mim", indices=([[0, 5]], [[2]]), shape=(6, 0))
    given = covaria.spectral_connectivity_epochs(vectors(spark, x), "mim", indices=([[0, 5]], [[2]]), sfreq=SFREQ, mode="fourier", fmin=BINS[0] * SFREQ / 64, fmax=BINS[-1] * SFREQ / 64, rank=([1], [1]), shape=(6, 64))
    assert of(frame.df, "f") == {k: pytest.approx(v) for k, v in of(given.df, "f").items()}


# streams of samples

HOUR = dt.timedelta(hours=1)
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SCHEMA = "event_id long, ts timestamp, event_type string, value double"


def cells(days, seed=0):
    rng = np.random.RandomState(seed)
    return [(1000 * d + 100 * c + t, START + dt.timedelta(days=d, hours=t, minutes=int(rng.randint(60))), name, float(rng.randn())) for d in range(days) for c, name in enumerate("abc") for t in range(24)]


def streamed(spark, folder, batches):
    """The coherences after each batch, every batch by a query of its own on the same folder."""
    out = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part={k}")
        arriving = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in/part=*")
        samples.accumulate(samples.closed_epochs(arriving, ["a", "b", "c"], 24, "1 day", "3 hours"), 24.0, np.arange(1, 6), ["coh", "pli2_unbiased", "ppc"], folder).awaitTermination()
        out.append({(r.seed, r.target, r.f): (r.coh, r.pli2_unbiased, r.ppc) for r in samples.measured(spark, folder, ["coh", "pli2_unbiased", "ppc"]).collect()})
    return out


def batch(spark, rows, days):
    grid = np.zeros((days, 3, 24))
    for _, ts, name, value in rows:
        if (ts - START).days < days:
            grid[(ts - START).days, "abc".index(name), ts.hour] += value
    found = bivariate.over_epochs(spectra.csd(spectra.fourier(vectors(spark, grid), 24, 24.0, range(1, 6))), ["coh", "pli2_unbiased", "ppc"])
    return {(r.seed, r.target, r.f): pytest.approx((r.coh, r.pli2_unbiased, r.ppc), abs=1e-9) for r in found.collect()}


def test_samples_late_repeated_and_out_of_order_give_the_batch_result(spark, tmp_path):
    rows = cells(6)
    cut = START + dt.timedelta(days=3, hours=12)
    late = [r for r in rows if cut - 2 * HOUR < r[1] <= cut and r[0] % 2]  # within the delay
    first = [r for r in rows if r[1] <= cut and r not in late]
    again = [r for r in first if r[1] > cut - 2 * HOUR]
    rng = np.random.RandomState(1)
    second = [r for r in rows if r[1] > cut] + late + again + again[:5]
    odd = [(None, START, "a", 1.0), (1, None, "a", 1.0), (555, START, "zz", 1.0), (3, cut, "a", None)]
    shuffled = lambda part: [part[i] for i in rng.permutation(len(part))]
    after_first, after_second = streamed(spark, tmp_path, [shuffled(first + odd[:3]), shuffled(second + odd[3:])])
    assert after_first == batch(spark, rows, 3)
    assert after_second == batch(spark, rows, 5)  # the watermark hasn't passed the sixth day


def test_what_comes_too_late_is_left_out_and_a_batch_run_again_counts_once(spark, tmp_path):
    rows = cells(4, 2)
    lost = [r for r in rows if (r[1] - START).days == 0 and r[1].hour == 5]
    end = [(9999, START + dt.timedelta(days=4, hours=6), "a", 0.0)]
    _, found = streamed(spark, tmp_path, [[r for r in rows if r not in lost], lost + end])
    assert found == batch(spark, [r for r in rows if r not in lost], 4)
    # the last batch as after a failure: its snapshot unfinished, and it is run again
    snapshots = samples._snapshots(spark, f"{tmp_path}/sums")
    assert len(snapshots) == 2  # older ones are deleted
    last = max(snapshots)
    (tmp_path / "sums" / f"batch={last}" / "_SUCCESS").unlink()
    (tmp_path / "state" / "commits" / str(last)).unlink()
    crc = tmp_path / "state" / "commits" / f".{last}.crc"
    crc.unlink(missing_ok=True)
    time.sleep(0.1)
    arriving = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/part=*")
    samples.accumulate(samples.closed_epochs(arriving, ["a", "b", "c"], 24, "1 day", "3 hours"), 24.0, np.arange(1, 6), ["coh", "pli2_unbiased", "ppc"], str(tmp_path)).awaitTermination()
    again = {(r.seed, r.target, r.f): (r.coh, r.pli2_unbiased, r.ppc) for r in samples.measured(spark, str(tmp_path), ["coh", "pli2_unbiased", "ppc"]).collect()}
    assert again == batch(spark, [r for r in rows if r not in lost], 4)


def test_parts_of_epochs_merge_to_the_whole(spark, data):
    x, methods = vectors(spark, data), list(bivariate.EPOCHS)
    cross = spectra.csd(spectra.fourier(x, 64, SFREQ, BINS))
    parts = [bivariate.partial(cross.where(c), methods) for c in ("epoch < 2", "epoch BETWEEN 2 AND 6", "epoch > 6")]
    merged = bivariate.finished(bivariate.merged(bivariate.merged(parts[0].unionByName(parts[1])).unionByName(parts[2])), methods)
    got, want = ({(r.seed, r.target, r.f): [v for k, v in r.asDict().items() if k not in ("seed", "target")] for r in df.collect()} for df in (merged, bivariate.over_epochs(cross, methods)))
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    with pytest.raises(ValueError):
        samples.measured(spark, "/tmp/no-such-folder-of-sums", methods)


# numbering


def test_one_channel_with_many_epochs_is_numbered_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(numbering, "STRETCH", 100)
    rng = np.random.RandomState(3)
    own = np.unique(np.concatenate([rng.randint(-5000, 5000, 2500), [10**6]]))
    rows = spark.createDataFrame([(int(e), 0) for e in own] + [(7, 1), (8, 1)], "epoch long, ch int")
    n, stretch = numbering.by_value(rows, "epoch")
    assert n > 20 and stretch is not None
    got = {(r.ch, r.epoch): r.place for r in numbering.numbered(rows, ["ch"], ["epoch"], stretch, first=1).collect()}
    assert got == {(0, int(e)): i + 1 for i, e in enumerate(own)} | {(1, 7): 1, (1, 8): 2}
    drawn = rows.withColumn("draw", F.md5(F.col("epoch").cast("string")))
    numbers = numbering.numbered(drawn, ["ch"], ["draw", "epoch"], numbering.by_hash("draw", 30), "to")
    want = drawn.withColumn("want", F.row_number().over(Window.partitionBy("ch").orderBy("draw", "epoch")) - 1)
    assert numbers.join(want, ["ch", "epoch"]).where("to != want").isEmpty()
    x = rows.withColumn("x", F.array(F.col("epoch").cast("double")))
    moved = surrogates.resting(x, 2, 5)
    took = {}
    for r in moved.where("ch = 0").collect():
        took.setdefault(r.shuffle, []).append(r.x[0])
    assert all(sorted(v) == own.tolist() for v in took.values()) and took[0] != took[1]
    assert numbering.by_value(rows.limit(0), "epoch") == (1, None) and numbering.numbered(rows.limit(0), ["ch"], ["epoch"], None).count() == 0


def test_blocks_of_filtered_epochs_follow_their_numbers(spark, monkeypatch):
    x = np.random.RandomState(4).randn(30, 2, 16)
    whole = {(r.epoch, r.ch): r.x for r in symbols.antialiased(vectors(spark, x), 100.0, 3, 4).collect()}
    monkeypatch.setattr(numbering, "STRETCH", 7)
    parts = {(r.epoch, r.ch): r.x for r in symbols.antialiased(vectors(spark, x), 100.0, 3, 4, together=64).collect()}
    assert parts == {k: pytest.approx(v, abs=1e-9) for k, v in whole.items()}


# bitmaps


@pytest.mark.parametrize(("kernel", "tau", "n", "weighted"), [(3, 1, 24, True), (3, 1, 70, False), (3, 2, 200, True), (4, 1, 130, True), (2, 1, 64, False)])
def test_joint_symbols_by_bitmaps(spark, kernel, tau, n, weighted):
    x = np.random.RandomState(5).randint(0, 4, (3, 4, n)).astype(float)  # with ties
    found = symbols.wsmi(vectors(spark, x), kernel, tau, weighted)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    letters = symbols.alphabet(kernel)
    many = math.factorial(kernel)
    number = lambda v: letters.index(tuple(np.argsort(v, kind="stable").tolist()))
    words = [[[number(ch[i : i + tau * (kernel - 1) + 1 : tau]) for i in range(n - tau * (kernel - 1))] for ch in epoch] for epoch in x]
    for r in found.collect():
        a, b = words[r.epoch][r.seed], words[r.epoch][r.target]
        size, joint, ca, cb = len(a), Counter(zip(a, b, strict=True)), Counter(a), Counter(b)
        want = sum(c / size * math.log(c * size / (ca[i] * cb[j])) for (i, j), c in joint.items() if not weighted or (i != j and i + j != many - 1))
        assert r.value == pytest.approx(want / math.log(many), abs=1e-9)
    maps = symbols.bitmaps(symbols.symbolised(vectors(spark, x), kernel, tau), many).first()
    assert len(maps.maps) == many and {len(m) for m in maps.maps} == {-(-maps.size // 64)} and sum(maps.many) == maps.size


# the recursion over lags


def dense(g):
    """All lags at once, by one block system."""
    p, n = len(g) - 1, g.shape[1]
    lag = lambda k: g[k] if k >= 0 else g[-k].T
    system = np.block([[lag(i - j).T for j in range(p)] for i in range(p)])
    a = np.linalg.solve(system, np.concatenate([lag(i + 1).T for i in range(p)])).T.reshape(n, p, n).transpose(1, 0, 2)
    return a, g[0] - sum(a[k] @ lag(k + 1).T for k in range(p))


@pytest.mark.parametrize(("p", "n"), [(1, 1), (4, 3), (12, 5), (40, 20)])
def test_recursion_equals_the_block_system(p, n):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000 if n < 20 else 8000, n)).cumsum(1) * 0.2 + rng.normal(size=(4000 if n < 20 else 8000, n))
    for t in range(1, len(x)):
        x[t] += 0.4 * x[t - 1][::-1]
    padded = np.concatenate([x, np.zeros((p, n))])
    g = np.array([padded[k : k + len(x)].T @ x / len(x) for k in range(p + 1)])
    began = time.perf_counter()
    (a, v), (b, w) = multivariate.whittle(g)
    took = time.perf_counter() - began
    assert np.allclose(a, dense(g)[0], atol=1e-9) and np.allclose(v, dense(g)[1], atol=1e-9)
    turned = dense(g.transpose(0, 2, 1))  # reversed time
    assert np.allclose(b, turned[0], atol=1e-9) and np.allclose(w, turned[1], atol=1e-9)
    assert took < 1
    with pytest.raises(RuntimeError):
        multivariate.whittle(np.zeros((p + 1, n, n)))


def test_epochs_of_a_stream_are_as_before(spark, data):
    """Whole epochs, and the same from cells, have the same cross-spectra."""
    x = epochs.whole_epochs(vectors(spark, data))
    rows = epochs.cross_spectra(x, SFREQ, np.array(BINS)).orderBy("epoch", "f", "seed", "target").collect()
    assert all((a.epoch, a.f, a.seed, a.target) < (b.epoch, b.f, b.seed, b.target) for a, b in pairwise(rows))


# cross-spectra as arrays over time


def exchanges(df):
    df.count()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def values(df, *names):
    return {(r.epoch, r.seed, r.target, r.f): pytest.approx([r[n] for n in names], abs=1e-9, nan_ok=True) for r in df.collect()}


def plain(df, *names):
    return {(r.epoch, r.seed, r.target, r.f): [r[n] for n in names] for r in df.collect()}


def test_arrays_over_time_are_reduced_within_their_row(spark, data):
    waves = spectra.wavelet(vectors(spark, data[:3]), SFREQ, [10.0, 12.5, 15.0, 20.0], 3.0, whole=True)
    methods = [m for m in bivariate.TIME if m != "cohy"] + ["cohy"]
    names = [m for m in bivariate.TIME if m != "cohy"] + ["cohy_re", "cohy_im"]
    found = bivariate.over_time(spectra.csd(waves, whole=True), methods)
    assert plain(found, *names) == values(bivariate.over_time(spectra.csd(waves), methods), *names)
    assert exchanges(found) == 1
    own = bivariate.Measure(("most",), "most", extra={"most": "max(re)"})  # not a mean of entries
    bivariate.register("largest_re", own, bivariate.TIME)
    try:
        found = bivariate.over_time(spectra.csd(waves, whole=True), ["largest_re"])
        assert plain(found, "largest_re") == values(bivariate.over_time(spectra.csd(waves), ["largest_re"]), "largest_re")
        with pytest.raises(ValueError):
            bivariate.over_time(spectra.csd(waves, whole=True), ["none"])
    finally:
        del bivariate.TIME["largest_re"]


@pytest.mark.parametrize("kernel", [(3, 1), (5, 3), (4, 2), (3, 7)])
def test_smoothing_in_blocks_equals_smoothing_of_rows(spark, data, kernel):
    freqs = np.arange(8.0, 22.0).tolist()
    waves = spectra.wavelet(vectors(spark, data[:2, :3]), SFREQ, freqs, 2.0, whole=True)
    table = covaria.functions.windows.smoothing_kernel(*kernel, "square" if 2 in kernel else "hanning")
    want = values(bivariate.over_time(spectra.smoothed(spectra.csd(waves), table), ["coh", "imcoh"]), "coh", "imcoh")
    for together in (1, 4, 16):
        found = bivariate.over_time(spectra.smoothed_csd(waves, table, together=together), ["coh", "imcoh"])
        assert plain(found, "coh", "imcoh") == want
    assert exchanges(found) == 1
    pairs = spark.createDataFrame([(0, 2, 0), (1, 0, 1)], "con int, seed int, target int")
    listed = bivariate.over_time(spectra.smoothed_csd(waves, table, edges=pairs), ["coh"])
    rows = bivariate.over_time(spectra.smoothed(spectra.csd(waves, pairs), table), ["coh"])
    assert plain(listed, "con", "coh") == values(rows, "con", "coh")


def test_estimators_smooth_sets_and_pairs_in_arrays(spark, data):
    x, freqs = vectors(spark, data[:3]), [10.0, 15.0, 20.0]
    for options in ({"sm_times": 0.1, "sm_freqs": 3, "sm_kernel": "square"}, {"sm_times": [0.1, 0.06, 0.02], "sm_kernel": "square"}):
        got = covaria.spectral_connectivity_time(x, freqs, "coh", sfreq=SFREQ, n_cycles=3, shape=(5, 64), **options)
        given = covaria.spectral_connectivity_time(spectra.wavelet(x, SFREQ, freqs, 3.0), freqs, "coh", sfreq=SFREQ, shape=(5, 64), **options)
        assert plain(got.df, "value") == values(given.df, "value")
    sets = {"indices": ([[0, 1]], [[3, 4]]), "rank": ([2], [2]), "sfreq": SFREQ, "shape": (5, 64), "sm_times": 0.1, "sm_kernel": "square"}
    got = covaria.spectral_connectivity_time(x, freqs, "mim", n_cycles=3, **sets).df
    given = covaria.spectral_connectivity_time(spectra.wavelet(x, SFREQ, freqs, 3.0), freqs, "mim", **sets).df
    assert of(got, "epoch", "f") == {k: pytest.approx(v, abs=1e-9) for k, v in of(given, "epoch", "f").items()}


# orders, selection, roots


def slow_criteria(x, most):
    k, total = x.shape
    for p in range(1, most + 1):
        y = x[:, most:]
        z = np.concatenate([x[:, most - d : total - d] for d in range(1, p + 1)])
        left = y - np.linalg.lstsq(z.T, y.T, rcond=None)[0].T @ z
        seen = total - p
        ld = np.linalg.slogdet(left @ left.T / (y.shape[1] - k * p) * (seen - k * p) / seen)[1]
        yield ld + 2 * p * k * k / seen, ld + math.log(seen) * p * k * k / seen, ld + 2 * math.log(math.log(seen)) * p * k * k / seen, ((seen + k * p) / (seen - k * p)) ** k * math.exp(ld)


def test_all_orders_from_one_gram_matrix(spark, data):
    from covaria.operators import autoregression

    x = data + 100.0  # a large mean costs no digits
    got = {(r.epoch, r.lags): [r.aic, r.bic, r.hqic, r.fpe] for r in autoregression.select_order(vectors(spark, x), 4).collect()}
    assert got == {(e, p): pytest.approx(list(c), rel=1e-6) for e, epoch in enumerate(x) for p, c in enumerate(slow_criteria(epoch, 4), 1)}
    twice = np.concatenate([data[:1], data[:1, :1]], axis=1)  # lags that are no full set
    assert autoregression.select_order(vectors(spark, twice), 2).count() == 2
    pooled = {r.lags: (r.epoch, r.aic) for r in autoregression.select_order(vectors(spark, data), 3, "avg-epochs").collect()}
    for p, (epoch, aic) in pooled.items():
        y = np.concatenate([e[:, 3:] for e in data], axis=1)
        z = np.concatenate([np.concatenate([e[:, 3 - d : 64 - d] for d in range(1, p + 1)]) for e in data], axis=1)
        left, seen = y - np.linalg.lstsq(z.T, y.T, rcond=None)[0].T @ z, len(data) * (64 - p)
        want = np.linalg.slogdet(left @ left.T / (y.shape[1] - 5 * p) * (seen - 5 * p) / seen)[1] + 2 * p * 25 / seen
        assert epoch is None and aic == pytest.approx(want, rel=1e-9)
    assert set(pooled) == {1, 2, 3} and autoregression.select_order(vectors(spark, data), None, "avg-epochs").count() > 0
    with pytest.raises(Exception, match="ask for more than 64 samples"):
        autoregression.select_order(vectors(spark, data), 30).count()


def test_exact_selection_among_many_ties(spark):
    from covaria.operators import selection

    rng = np.random.RandomState(8)
    for draw in (rng.randint(0, 5, 3000).astype(float), rng.randn(3000), np.ones(3000), np.exp(rng.randn(3000) * 20)):
        rows = [(i, float(v)) for i, v in enumerate(draw)] + [(5000, float("nan")), (5001, None)]
        df = spark.createDataFrame(rows, "place long, v double").repartition(5).cache()
        order = [i for i, _ in sorted(rows[:3000], key=lambda r: (-r[1], r[0]))]
        for keep in (1, 700, 3000):
            got = selection.largest(df, "v", "place", keep, bins=16, small=20)
            assert sorted(r.place for r in got.collect()) == sorted(order[:keep])
    assert selection.largest(df.limit(0), "v", "place", 3).count() == 0 == selection.largest(df, "v", "place", 0).count()


def test_roots_of_matrices_without_a_full_set_of_eigenvectors():
    from covaria.operators.autoregression import _root

    rng = np.random.default_rng(9)
    defective = np.array([[4.0, 1.0, 0.0], [0.0, 4.0, 1.0], [0.0, 0.0, 4.0]])
    assert np.allclose(_root(defective), [[2, 0.25, -1 / 64], [0, 2, 0.25], [0, 0, 2]], atol=1e-9)
    for n in (1, 2, 5, 9):
        a = rng.normal(size=(n, n))
        square = a @ a.T + np.eye(n)
        assert np.allclose(_root(square) @ _root(square), square)
        values, v = np.linalg.eig(rng.normal(size=(n, n)))  # any signs: the principal root's real part
        b = (v * values @ np.linalg.inv(v)).real
        want = (v * np.sqrt(values.astype(complex)) @ np.linalg.inv(v)).real
        assert np.allclose(_root(b), want, atol=1e-6)
    assert np.allclose(_root(np.diag([4.0, 0.0])), np.diag([2.0, 0.0]))
    assert np.isnan(_root(np.array([[0.0, 1.0], [0.0, 0.0]]))).all()  # has no root
    assert np.allclose(_root(np.zeros((2, 2))), 0) and np.allclose(_root(1e-9 * np.eye(3)), 1e-9**0.5 * np.eye(3))


def test_tapered_coefficients_stay_arrays_until_pairs_are_made(spark, data):
    x, freqs = vectors(spark, data[:2, :3]), [10.0, 15.0, 20.0]
    rows, arrays = spectra.tapered_tfr(x, SFREQ, freqs, 3.0), spectra.tapered_tfr(x, SFREQ, freqs, 3.0, whole=True)
    for method in ("coh", "plv", "imcoh"):
        found = bivariate.over_time(spectra.csd(arrays, whole=True), [method])
        assert plain(found, method) == values(bivariate.over_time(spectra.csd(rows), [method]), method)
    assert exchanges(found) == 1
    power = {(r.epoch, r.seed, r.target, r.f, r.t): pytest.approx((r.re, r.im, r.pxx, r.pyy), abs=1e-9) for r in spectra.csd(arrays).collect()}
    assert power == {(r.epoch, r.seed, r.target, r.f, r.t): (r.re, r.im, r.pxx, r.pyy) for r in spectra.csd(rows).collect()}
    options = {"sfreq": SFREQ, "mode": "multitaper", "n_cycles": 3, "decim": 2, "padding": 0.1, "shape": (3, 64)}
    got = covaria.spectral_connectivity_time(x, freqs, "coh", sm_times=0.2, sm_kernel="square", **options)
    kept = rows.where("t % 2 = 0").withColumn("t", (F.col("t") / 2).cast("int")).where("t >= 2 AND t < 30")
    kernel = covaria.functions.windows.smoothing_kernel(5, 1, "square")
    assert plain(got.df, "value") == values(bivariate.over_time(spectra.smoothed(spectra.csd(kept), kernel), ["coh"]).withColumnRenamed("coh", "value"), "value")
    assert multivariate.ranks(arrays, [([0, 1], [2])]) == multivariate.ranks(rows, [([0, 1], [2])])


def test_orthogonalisation_says_its_rank_and_whether_it_converged(spark, data):
    twice = data[:2].copy()
    twice[1, 4] = twice[1, 0]
    found = {r.epoch: (r.converged, r.rank) for r in covaria.symmetric_orth(vectors(spark, twice), diagnostics=True).collect()}
    assert {e: rank for e, (_, rank) in found.items()} == {0: 5, 1: 4} and found[0][0]
    assert not any(r.converged for r in covaria.symmetric_orth(vectors(spark, data[:1]), n_iter=1, diagnostics=True).collect())
    assert covaria.symmetric_orth(vectors(spark, data[:1])).columns == ["epoch", "ch", "x"]


def test_sets_from_tables(spark):
    from covaria.functions import edges

    seeds = spark.createDataFrame([(3, 1), (3, 0), (5, 2), (3, 1)], "set int, ch int")
    targets = spark.createDataFrame([(1, 4), (0, 3)], "set int, ch int")
    grid = edges.multivariate_grid(seeds, targets)
    assert edges.connections_of(grid) == covaria.seed_target_multivariate_indices([[0, 1], [2]], [[3], [4]])
