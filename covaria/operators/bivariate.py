"""Measures between two signals, as aggregate states and final expressions over cross-spectra.

A measure is data: which averages it needs, in SQL over the columns re, im, pxx, pyy of a
cross-spectrum, and how they make its value. All measures asked for share one two-phase aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spectra

_ABS = "sqrt(re * re + im * im)"
#: State columns by name; ANSI mode raises on division by zero, so each ratio says what zero gives.
STATES = {
    "sre": "avg(re)", "sim": "avg(im)", "spx": "avg(pxx)", "spy": "avg(pyy)", "n": "cast(count(*) as double)",
    "ure": f"avg(CASE WHEN re = 0 AND im = 0 THEN cast('NaN' as double) ELSE re / {_ABS} END)", "uim": f"avg(CASE WHEN re = 0 AND im = 0 THEN cast('NaN' as double) ELSE im / {_ABS} END)",
    "gre": f"avg(CASE WHEN re = 0 AND im = 0 THEN 0d ELSE re / {_ABS} END)", "gim": f"avg(CASE WHEN re = 0 AND im = 0 THEN 0d ELSE im / {_ABS} END)",
    "sgn": "avg(cast(sign(im) as double))", "hvs": "avg(CASE WHEN im > 0 THEN 1d WHEN im = 0 THEN 0.5d ELSE 0d END)", "aim": "avg(abs(im))", "im2": "avg(im * im)",
}


@dataclass(frozen=True)
class Measure:
    """States by name (those of STATES, or own ones in extra), and the value as SQL over them."""

    states: tuple[str, ...]
    value: str
    imaginary: str | None = None
    extra: dict[str, str] = field(default_factory=dict)


def _over(number: str, below: str, otherwise: str) -> str:
    return f"CASE WHEN ({below}) = 0 THEN {otherwise} ELSE ({number}) / ({below}) END"


_NAN = "cast('NaN' as double)"
_ROOT = "sqrt(spx * spy)"
EPOCHS = {
    "coh": Measure(("sre", "sim", "spx", "spy"), _over("sqrt(sre * sre + sim * sim)", _ROOT, _NAN)),
    "cohy": Measure(("sre", "sim", "spx", "spy"), _over("sre", _ROOT, _NAN), _over("sim", _ROOT, _NAN)),
    "imcoh": Measure(("sre", "sim", "spx", "spy"), _over("sim", _ROOT, _NAN)),
    "plv": Measure(("ure", "uim"), "sqrt(ure * ure + uim * uim)"),
    "ciplv": Measure(("ure", "uim"), "CASE WHEN abs(ure) >= 1 THEN abs(uim) ELSE abs(uim) / sqrt(1 - ure * ure) END"),
    "ppc": Measure(("gre", "gim", "n"), _over("(gre * gre + gim * gim) * n * n - n", "n * (n - 1)", _NAN)),
    "pli": Measure(("sgn",), "abs(sgn)"),
    "pli2_unbiased": Measure(("sgn", "n"), _over("n * sgn * sgn - 1", "n - 1", _NAN)),
    "dpli": Measure(("hvs",), "hvs"),
    "wpli": Measure(("sim", "aim"), _over("abs(sim)", "aim", "0d")),
    "wpli2_debiased": Measure(("sim", "aim", "im2", "n"), _over("n * n * sim * sim - n * im2", "n * n * aim * aim - n * im2", "0d")),
}
#: Over time there are seven, without the guards that those over epochs have.
TIME = {m: EPOCHS[m] for m in ("coh", "cohy", "imcoh", "plv", "pli")} | {
    "ciplv": Measure(("ure", "uim"), "CASE WHEN abs(ure) >= 1 THEN " + _NAN + " ELSE abs(uim) / sqrt(1 - ure * ure) END"),
    "wpli": Measure(("sim", "aim"), _over("abs(sim)", "aim", _NAN)),
}


def register(name: str, measure: Measure, registry: dict[str, Measure] = EPOCHS) -> None:
    """Adds a measure of one's own."""
    registry[name] = measure


def _states(cross: DataFrame, keys: list[str], methods: list[str], registry: dict[str, Measure], *more) -> DataFrame:
    unknown = [m for m in methods if m not in registry]
    if unknown:
        raise ValueError(f"no such method: {', '.join(unknown)}")
    states = STATES | {k: v for m in methods for k, v in registry[m].extra.items()}
    needed = dict.fromkeys(s for m in methods for s in registry[m].states)
    return cross.groupBy(*keys).agg(*[F.expr(states[s]).alias(s) for s in needed], *more)


def _values(rows: DataFrame, keys: list[str], methods: list[str], registry: dict[str, Measure]) -> DataFrame:
    values = [c for m in methods for c in ([F.expr(registry[m].value).alias(m)] if registry[m].imaginary is None else [F.expr(registry[m].value).alias(f"{m}_re"), F.expr(registry[m].imaginary).alias(f"{m}_im")])]
    return rows.select(*keys, *values)


def _aggregated(cross: DataFrame, keys: list[str], methods: list[str], registry: dict[str, Measure]) -> DataFrame:
    return _values(_states(cross, keys, methods, registry), keys, methods, registry)


PAIR = ("con", "seed", "target", "f", "freq", "t")


def partial(cross: DataFrame, methods: list[str]) -> DataFrame:
    """What a part of the epochs adds to measures: pair and bin, the states as means, and how many epochs."""
    return _states(cross, [c for c in PAIR if c in cross.columns], methods, EPOCHS, F.count(F.lit(1)).alias("many"))


def merged(parts: DataFrame) -> DataFrame:
    """Parts of disjoint epochs as one: means weigh as many epochs as they are of; n, itself a number, is added up."""
    keys = [c for c in PAIR if c in parts.columns]
    means = [F.sum("n").alias("n") if c == "n" else (F.sum(F.col(c) * F.col("many")) / F.sum("many")).alias(c) for c in parts.columns if c not in (*keys, "many")]
    return parts.groupBy(*keys).agg(*means, F.sum("many").alias("many"))


def finished(parts: DataFrame, methods: list[str]) -> DataFrame:
    """The values of merged parts."""
    return _values(parts, [c for c in PAIR if c in parts.columns], methods, EPOCHS)


def over_epochs(cross: DataFrame, methods: list[str]) -> DataFrame:
    """A value for each pair and bin (and time): a column for each method, two for complex ones."""
    return _aggregated(cross, [c for c in PAIR if c in cross.columns], methods, EPOCHS)


def _within(cross: DataFrame, keys: list[str], methods: list[str], registry: dict[str, Measure]) -> DataFrame | None:
    """Values from cross-spectra that are arrays over time, each made of its own row; None if a state isn't a mean of entries."""
    known = STATES | {k: v for m in methods if m in registry for k, v in registry[m].extra.items()}
    states = {s: known[s] for m in methods if m in registry for s in registry[m].states}
    means = {s: re.fullmatch(r"avg\((.*)\)", sql, re.DOTALL) for s, sql in states.items() if s != "n"}
    if not all(means.values()):
        return None
    entry = lambda sql: re.sub(r"\b(re|im|pxx|pyy)\b", r"v.\1", sql)
    columns = [F.expr(f"aggregate(z, 0d, (s, v) -> s + ({entry(found[1])})) / nullif(size(z), 0)").alias(s) for s, found in means.items()]
    columns += [F.size("z").cast("double").alias("n")] if "n" in states else []
    return _values(cross.select(*keys, *columns), keys, methods, registry)


def over_time(cross: DataFrame, methods: list[str], average: bool = False) -> DataFrame:
    """A value for each epoch, pair and bin from the mean over time; averaged over epochs on demand.

    Cross-spectra that are arrays over time (csd with whole, smoothed_csd) are reduced within their
    row, without a shuffle.
    """
    keys = [c for c in ("con", "seed", "target", "f", "freq") if c in cross.columns]
    found = None
    if "z" in cross.columns:
        found = _within(cross, ["epoch", *keys], methods, TIME) if all(m in TIME for m in methods) else None
        cross = cross if found is not None else spectra.taken_apart(cross)
    found = _aggregated(cross, ["epoch", *keys], methods, TIME) if found is None else found
    return averaged(found, keys) if average else found


def averaged(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in values.columns if c not in {*keys, "epoch"}])


def banded(values: DataFrame, bands: list[tuple[float, float]], keys: list[str] | None = None) -> DataFrame:
    """Means over the bins of each band, edges included; freq becomes the mean of the bins. Bands are a list; keys, with f and freq, are what isn't averaged."""
    spark = values.sparkSession
    table = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(bands)], "band int, fmin double, fmax double")
    keys = [c for c in values.columns if c in (keys or ("epoch", "con", "seed", "target", "t")) and c not in ("f", "freq")]
    joined = values.join(F.broadcast(table), (F.col("freq") >= F.col("fmin")) & (F.col("freq") <= F.col("fmax")))
    return joined.groupBy(*keys, "band").agg(*[F.avg(c).alias(c) for c in values.columns if c not in {*keys, "f"}])


def foi_banded(values: DataFrame, freqs: list[float], bands: list[tuple[float, float]], strict_bands: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Means over bands whose edges are the nearest freqs.

    The band's end index is doubled, unless both edges are one bin; strict_bands takes the bins in between.
    """
    spark, rows = values.sparkSession, []
    for i, (low, high) in enumerate(bands):
        start, end = (min(range(len(freqs)), key=lambda k, e=edge: abs(freqs[k] - e)) for edge in (low, high))
        rows.append((i, start, end + 1 if start == end or strict_bands else 2 * end))
    table = F.broadcast(spark.createDataFrame(rows, "band int, first int, past int"))  # a list of bands
    keys = [c for c in values.columns if c in (keys or ("epoch", "con", "seed", "target")) and c not in ("f", "freq")]
    joined = values.join(table, (F.col("f") >= F.col("first")) & (F.col("f") < F.col("past")))
    return joined.groupBy(*keys, "band").agg(*[F.avg(c).alias(c) for c in values.columns if c not in {*keys, "f"}])


def phase_slope(cohy: DataFrame, bands: list[tuple[float, float]]) -> DataFrame:
    """Phase slope index: Im of the sum over a band of conj(C_f) * C_next, band edges left out."""
    from pyspark.sql.window import Window

    table = F.broadcast(cohy.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(bands)], "band int, fmin double, fmax double"))
    keys = [c for c in ("epoch", "con", "seed", "target", "t") if c in cohy.columns]
    inside = cohy.join(table, (F.col("freq") > F.col("fmin")) & (F.col("freq") < F.col("fmax")))
    onward = Window.partitionBy(*keys, "band").orderBy("f")
    step = F.col("cohy_re") * F.lead("cohy_im").over(onward) - F.col("cohy_im") * F.lead("cohy_re").over(onward)
    stepped = inside.withColumn("step", step)
    return stepped.groupBy(*keys, "band").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("psi"), F.avg("freq").alias("freq"))


def custom(cross: DataFrame, keys: list[str], function: Callable) -> DataFrame:
    """A measure that no sum expresses: function(pandas.DataFrame of a pair's cross-spectra) -> float."""
    import pandas as pd

    def of(rows):
        return pd.DataFrame([[rows[k].iloc[0] for k in keys] + [float(function(rows))]], columns=[*keys, "value"])

    kinds = dict(cross.dtypes)
    return cross.groupBy(*keys).applyInPandas(of, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", value double")
