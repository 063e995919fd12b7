"""Envelope correlation and symmetric orthogonalisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.functions import windows


def analytic(vectors: DataFrame) -> DataFrame:
    """(epoch, ch, re, im): the analytic signal as two arrays, by batches of rows."""

    def of(batches):
        for rows in batches:
            if len(rows):
                z = windows.analytic(np.stack(rows["x"].to_numpy()))
                yield rows[["epoch", "ch"]].assign(re=list(z.real), im=list(z.imag))

    return vectors.select("epoch", "ch", "x").mapInPandas(of, "epoch long, ch int, re array<double>, im array<double>")


def correlation(signals: DataFrame, orthogonalize: str | bool = "pairwise", log: bool = False, absolute: bool = True) -> DataFrame:
    """(epoch, seed, target, value) for seed > target, from analytic signals.

    A channel's envelope, and its logarithm, are made before channels meet as pairs. A pair is one row of
    arrays, joined on the epoch, and each correlation is sums over them.
    Orthogonalised pairs are made absolute and averaged over the two directions; the plain one is
    symmetric and keeps its sign. An envelope that doesn't vary correlates 0.
    """
    if orthogonalize not in (False, "pairwise"):
        raise ValueError("orthogonalize must be False or 'pairwise'")
    logged = lambda x: f"transform({x}, v -> ln(v * v))" if log else x
    own = signals.withColumn("m", F.expr("zip_with(re, im, (r, i) -> sqrt(r * r + i * i))")).withColumn("l", F.expr(logged("m")))
    arrays = {"r": "re", "i": "im", "m": "m", "l": "l"} if orthogonalize else {"l": "l"}
    side = lambda ch, x: own.select("epoch", F.col("ch").alias(ch), *[F.col(c).alias(f"{x}{k}") for k, c in arrays.items()])
    pairs = side("seed", "a").join(side("target", "b"), "epoch").where("seed > target")
    if orthogonalize:
        # Im(a conj(b)) has one size in either direction
        cross = "zip_with(zip_with(ar, bi, (x, y) -> x * y), zip_with(ai, br, (x, y) -> x * y), (x, y) -> abs(y - x))"
        pairs = pairs.withColumn("cross", F.expr(cross))
        safe = lambda m: f"zip_with(cross, {m}, (c, m) -> CASE WHEN m = 0 THEN 0d ELSE c / m END)"
        pairs = pairs.withColumns({"oa": F.expr(logged(safe("bm"))), "ob": F.expr(logged(safe("am")))})

    def corr(x: str, y: str):
        # sums in one pass, about the first samples, so that large means cost no digits
        sums = f"""aggregate(zip_with({x}, {y}, (p, q) -> struct(p, q)),
            struct(0d as n, 0d as p0, 0d as q0, 0d as p, 0d as q, 0d as pq, 0d as pp, 0d as qq),
            (s, v) -> struct(s.n + 1 as n, if(s.n = 0, v.p, s.p0) as p0, if(s.n = 0, v.q, s.q0) as q0,
                if(s.n = 0, 0d, s.p + (v.p - s.p0)) as p, if(s.n = 0, 0d, s.q + (v.q - s.q0)) as q,
                if(s.n = 0, 0d, s.pq + (v.p - s.p0) * (v.q - s.q0)) as pq,
                if(s.n = 0, 0d, s.pp + (v.p - s.p0) * (v.p - s.p0)) as pp, if(s.n = 0, 0d, s.qq + (v.q - s.q0) * (v.q - s.q0)) as qq))"""
        centred = f"""transform(array({sums}), s -> struct(s.pq - s.p * s.q / nullif(s.n, 0) as pq,
            s.pp - s.p * s.p / nullif(s.n, 0) as pp, s.qq - s.q * s.q / nullif(s.n, 0) as qq, s.pp as pp0, s.qq as qq0))"""
        # what doesn't vary has no spread but rounding
        value = f"""transform({centred}, s -> CASE WHEN s.pp > 1e-14 * s.pp0 AND s.qq > 1e-14 * s.qq0 THEN s.pq / (sqrt(s.pp) * sqrt(s.qq)) ELSE 0d END)"""
        return F.expr(f"element_at({value}, 1)")

    if not orthogonalize:
        value = corr("al", "bl")
    else:
        first, second = corr("oa", "bl"), corr("ob", "al")
        value = (F.abs(first) + F.abs(second)) / 2 if absolute else (first + second) / 2
    return pairs.select("epoch", "seed", "target", value.alias("value"))


def symmetric_orth_matrix(data: np.ndarray, n_iter: int = 50, tol: float = 1e-6) -> tuple[np.ndarray, bool, int]:
    """Rows made orthogonal to each other and as near to the given ones as can be (Colclough et al. 2015); whether that converged; the rank of the rows.

    The squared distance converges when it falls by less than tol of itself. Of rows of a smaller rank, components beyond it are noise.
    """
    if data.shape[0] > data.shape[1]:
        raise ValueError(f"{data.shape[0]} signals of {data.shape[1]} samples can't be orthogonal")
    scale, last, rank, near = np.ones(len(data)), np.inf, None, data
    for _ in range(n_iter):
        u, s, vh = np.linalg.svd(scale[:, None] * data, full_matrices=False)
        rank = int((s >= s[0] * 1e-6).sum()) if rank is None else rank
        base = u @ vh
        scale = np.einsum("ij,ij->i", data, base)
        near = scale[:, None] * base
        error = np.linalg.norm(data - near) ** 2
        if error == 0 or (last - error) / error < tol:
            return near, True, rank
        last = error
    return near, False, rank or 0


def symmetric_orth(vectors: DataFrame, n_iter: int = 50, tol: float = 1e-6, diagnostics: bool = False) -> DataFrame:
    """Vectors of each epoch orthogonalised together; an epoch is one matrix, so one group.

    diagnostics adds converged and rank (of the epoch): what isn't converged, or has a rank below the number of channels, is
    returned all the same, for the caller to judge.
    """
    more = ", converged boolean, rank int" if diagnostics else ""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ch")
        found, converged, rank = symmetric_orth_matrix(np.stack(rows["x"].to_numpy()), n_iter, tol)
        out = rows[["epoch", "ch"]].assign(x=list(found))
        return out.assign(converged=converged, rank=rank) if diagnostics else out

    return vectors.select("epoch", "ch", "x").groupBy("epoch").applyInPandas(of, "epoch long, ch int, x array<double>" + more)
