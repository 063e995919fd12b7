"""Connectivity analytics between signals, written as Spark plans."""

from covaria.functions.edges import check_indices, seed_target_indices, seed_target_multivariate_indices
from covaria.operators.autoregression import best_order, select_order
from covaria.operators.decomposition import CoherencyDecomposition
from covaria.operators.envelope import symmetric_orth
from covaria.operators.surrogates import evoked as make_surrogate_evoked_data
from covaria.operators.surrogates import resting as make_surrogate_resting_data
from covaria.operators.surrogates import signals_in_band as make_signals_in_freq_bands
from covaria.operators.surrogates import surrogate_data as make_surrogate_data
from covaria.plans.estimators import envelope_correlation, phase_slope_index, phase_slope_index_time, spectral_connectivity_epochs, spectral_connectivity_time, vector_auto_regression, wsmi
from covaria.plans.frame import ConnFrame, degree, read_connectivity

__all__ = [
    "CoherencyDecomposition", "ConnFrame", "best_order", "check_indices", "degree", "envelope_correlation", "make_signals_in_freq_bands", "make_surrogate_data", "make_surrogate_evoked_data", "make_surrogate_resting_data",
    "phase_slope_index", "phase_slope_index_time", "read_connectivity", "seed_target_indices", "seed_target_multivariate_indices", "select_order", "spectral_connectivity_epochs", "spectral_connectivity_time", "symmetric_orth", "vector_auto_regression", "wsmi",
]
