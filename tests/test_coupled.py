"""Band-passed and coupled recordings."""

import numpy as np
import pytest

from covaria.functions import windows
from covaria.operators import bivariate, spectra, surrogates


def _frame(spark, rows):
    return spark.createDataFrame([(e, c, [float(v) for v in x]) for e, c, x in rows], "epoch long, ch int, x array<double>")


def test_band_passed_equals_a_slow_sum(spark):
    x = np.random.default_rng(3).standard_normal((2, 40))
    taps = windows.band_pass(9, 3, 6, 2, 24)
    got = {r.epoch: r.x for r in surrogates.band_passed(_frame(spark, [(0, 0, x[0]), (1, 0, x[1]), (2, 0, [])]), (3, 6), 24, 2, 9).collect()}
    for e in (0, 1):
        want = [sum(taps[4 + j] * x[e][t - j] for j in range(-4, 5) if 0 <= t - j < 40) for t in range(40)]
        assert got[e] == pytest.approx(want)
    assert got[2] == []
    with pytest.raises(ValueError, match="odd"):
        surrogates.band_passed(_frame(spark, []), (3, 6), 24, 2, 8)


def test_targets_follow_seeds_in_the_band_alone(spark):
    rng = np.random.default_rng(5)
    x = _frame(spark, [(e, c, rng.standard_normal(96)) for e in range(60) for c in range(3)])
    moved = surrogates.coupled(x, 0, [1], [2], (5, 8), 24, 0.8, 1, 2)
    found = bivariate.over_epochs(spectra.csd(spectra.fourier(moved, 96, 24, [8, 24, 28, 44])), ["coh", "dpli"])
    coh = {r.freq: r.coh for r in found.collect()}
    assert min(coh[6.0], coh[7.0]) > 0.9 > 0.5 > max(coh[2.0], coh[11.0])
    # a delay of the other sign turns the phase round
    phase = lambda delay: bivariate.over_epochs(spectra.csd(spectra.fourier(surrogates.coupled(x, 0, [1], [2], (5, 8), 24, 0.8, delay, 2), 96, 24, [24])), ["dpli"]).first().dpli
    assert {round(phase(1)), round(phase(-1))} == {0, 1}


def test_epochs_without_the_source_and_flat_signals_add_nothing(spark):
    x = _frame(spark, [(0, 1, [2, 2, 2]), (0, 2, [1, 3, 1]), (1, 0, [0, 5, 0]), (1, 1, [4, 4, 4]), (1, 2, []), (2, 0, [1, 1, 1])])
    got = {(r.epoch, r.ch): r.x for r in surrogates.coupled(x, 0, [1], [2], (3, 6), 24, 0.5, 1, 2, 3).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 1), (1, 2)}
    assert got[0, 1] == [0, 0, 0] and got[1, 2] == []
    assert got[0, 2] == pytest.approx(np.array([1, 3, 1]) / np.std([1, 3, 1]) / 2)
    for bad in ({"snr": 2}, {"seeds": []}, {"targets": [1]}):
        with pytest.raises(ValueError, match="snr"):
            surrogates.coupled(x, **{"source": 0, "seeds": [1], "targets": [2], "freq_band": (3, 6), "sfreq": 24, **bad})
