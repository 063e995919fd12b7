"""Vector autoregression from Gram sums: the design matrix is never made.

An epoch's samples and their lags give a small matrix of sums of products; epochs are pooled by adding
those matrices, which Spark does like any sum. What is solved is as large as channels times lags.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COEFFICIENTS = "epoch long, i int, j int, lag int, value double"


def lagged(x: np.ndarray, lags: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(channels, samples) to what is predicted and the lags that predict it, lag by lag."""
    start = lags + skip
    z = np.concatenate([x[:, start - k : x.shape[1] - k] for k in range(1, lags + 1)])
    return x[:, start:], z


def gram(vectors: DataFrame, lags: int) -> DataFrame:
    """(epoch, n, k, g): of each epoch, sums of products of [lags, now] by itself, row by row."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.sort_values("ch")["x"].to_numpy())
        y, z = lagged(x, lags)
        both = np.concatenate([z, y])
        return pd.DataFrame({"epoch": [rows["epoch"].iloc[0]], "n": [y.shape[1]], "k": [len(x)], "g": [(both @ both.T).ravel()]})

    return vectors.select("epoch", "ch", "x").groupBy("epoch").applyInPandas(of, "epoch long, n long, k int, g array<double>")


def pooled_gram(grams: DataFrame) -> DataFrame:
    """One row: the sums over all epochs, element by element, in two phases."""
    cells = grams.select("n", "k", F.posexplode("g").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.max("k").alias("k"))
    # a row for each cell of a matrix of (channels * (lags + 1))^2
    return cells.agg(F.lit(None).cast("long").alias("epoch"), F.max("n").alias("n"), F.max("k").alias("k"), F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c["v"]).alias("g"))


def solved(g: np.ndarray, k: int, lags: int, ridge: float) -> np.ndarray:
    """Coefficients (to, lag-major from)."""
    m = k * lags
    g = np.asarray(g).reshape(m + k, m + k)
    zz, zy = g[:m, :m] + ridge * np.eye(m), g[:m, m:]
    try:
        return np.linalg.solve(zz, zy).T
    except np.linalg.LinAlgError:
        return (np.linalg.pinv(zz) @ zy).T


def fit(vectors: DataFrame, lags: int = 1, l2_reg: float | None = 0.0, model: str = "dynamic", forward_backward: bool = False) -> DataFrame:
    """Coefficients (epoch, i, j, lag, value): channel i from channel j, lag counted from 1.

    model "dynamic": a model for each epoch, penalty l2_reg. "avg-epochs": one for all (epoch null), and
    the penalty is l2_reg squared, as rows l2_reg * I under the design matrix give.
    forward_backward averages one lag's forward operator with the inverse of the backward one.
    """
    if model not in ("dynamic", "avg-epochs"):
        raise ValueError("model must be 'dynamic' or 'avg-epochs'")
    if forward_backward and (lags != 1 or model != "dynamic"):
        raise ValueError("the forward-backward operator is defined for one lag of dynamic models")
    ridge = (l2_reg or 0.0) ** (2 if model == "avg-epochs" else 1)
    backward = gram(vectors.withColumn("x", F.reverse("x")), 1).select("epoch", F.col("g").alias("back")) if forward_backward else None
    sums = gram(vectors, lags)
    sums = pooled_gram(sums) if model == "avg-epochs" else sums
    sums = sums.join(backward, "epoch") if forward_backward else sums

    def of(batches):
        for rows in batches:
            for r in rows.itertuples():
                a = solved(r.g, r.k, lags, ridge)
                if forward_backward:
                    a = _root(a @ np.linalg.pinv(solved(r.back, r.k, 1, ridge)))
                i, c = np.indices(a.shape)
                yield pd.DataFrame({"epoch": None if model == "avg-epochs" else r.epoch, "i": i.ravel(), "j": c.ravel() % r.k, "lag": c.ravel() // r.k + 1, "value": a.ravel()}).astype({"epoch": "Int64"})

    return sums.mapInPandas(of, COEFFICIENTS)


def _root(a: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The real part of the principal square root, by Newton's iteration on the root and its inverse (Denman and Beavers 1976), scaled by determinants (Higham 1997).

    It takes no eigenvectors, so matrices that lack some have a root like others. Eigenvalues on the negative axis, where
    roots of both signs are as good, are turned off it by less than any other eigenvalue lies from it. A singular
    matrix has the root that its eigenvectors make, if they make one; one without any root gives NaN.
    """
    values = np.linalg.eigvals(a.astype(complex))
    size = np.abs(values).max(initial=0)
    angles = np.angle(values)
    negative = np.pi - np.abs(angles) < 1e-12
    turn = 0.0
    if negative.any():
        turn = min(np.pi / 4, (angles[~negative] + np.pi).min(initial=np.pi) / 2)
    y = a * np.exp(-1j * turn) if turn else a
    z, n = np.eye(len(a), dtype=y.dtype), len(a)
    try:
        for k in range(rounds):
            with np.errstate(all="ignore"):
                scale = abs(np.linalg.det(y) * np.linalg.det(z)) ** (-0.5 / n) if k < 8 else 1.0
                y, z, last = (scale * y + np.linalg.inv(scale * z)) / 2, (scale * z + np.linalg.inv(scale * y)) / 2, y
            if not np.isfinite(y).all() or (k > 8 and np.linalg.norm(y - last) <= 1e-14 * np.linalg.norm(y) * n):
                break
        root = y * np.exp(0.5j * turn) if turn else y
        if np.isfinite(root).all() and np.linalg.norm(root @ root - a) <= 1e-6 * max(size, 1e-300) * n:
            return root.real
    except np.linalg.LinAlgError:
        pass
    values, vectors = np.linalg.eig(a.astype(complex))
    root = vectors * np.sqrt(values) @ np.linalg.pinv(vectors)
    return root.real if np.linalg.norm(root @ root - a) <= 1e-6 * max(size, 1e-300) * n else np.full(a.shape, np.nan)


def residual_covariance(vectors: DataFrame, lags: int = 1, l2_reg: float = 0.0) -> DataFrame:
    """(epoch, i, j, value): residual products over degrees of freedom, from the same sums."""

    def of(batches):
        for rows in batches:
            for r in rows.itertuples():
                m = r.k * lags
                g = np.asarray(r.g).reshape(m + r.k, m + r.k)
                a = solved(r.g, r.k, lags, l2_reg)
                left = g[m:, m:] - a @ g[:m, m:] - g[m:, :m] @ a.T + a @ g[:m, :m] @ a.T
                i, j = np.indices(left.shape)
                yield pd.DataFrame({"epoch": r.epoch, "i": i.ravel(), "j": j.ravel(), "value": (left / (r.n - m)).ravel()})

    return gram(vectors, lags).mapInPandas(of, "epoch long, i int, j int, value double")


def predicted(vectors: DataFrame, coefficients: DataFrame) -> DataFrame:
    """(epoch, ch, t, value, predicted): one step ahead; the first samples, which lack lags, get 0.

    Coefficients are joined with samples on epoch and channel, lags by moving t; pooled ones (epoch
    null) serve every epoch.
    """
    long = vectors.select("epoch", "ch", F.posexplode("x").alias("t", "value"), F.size("x").alias("n"))
    pooled = coefficients.where("epoch IS NULL").select("i", "j", "lag", F.col("value").alias("a"))
    own = coefficients.where("epoch IS NOT NULL").select("epoch", "i", "j", "lag", F.col("value").alias("a"))
    source = long.withColumnRenamed("ch", "j")
    moved = source.join(own, ["epoch", "j"]).unionByName(source.join(F.broadcast(pooled), "j"))  # channels^2 * lags rows
    lags = coefficients.agg(F.max("lag").alias("lags"))
    moved = moved.withColumn("t", F.col("t") + F.col("lag")).crossJoin(F.broadcast(lags)).where("t < n AND t >= lags")
    guess = moved.groupBy("epoch", F.col("i").alias("ch"), "t").agg(F.sum(F.col("a") * F.col("value")).alias("predicted"))
    return long.drop("n").join(guess, ["epoch", "ch", "t"], "left").withColumn("predicted", F.coalesce("predicted", F.lit(0.0)))


def companion(coefficients: DataFrame) -> DataFrame:
    """(epoch, row, col, value): the block companion matrix; for one lag the coefficients themselves."""
    size = coefficients.groupBy(F.col("epoch").alias("e")).agg((F.max("i") + 1).alias("k"), F.max("lag").alias("p"))
    top = coefficients.join(size, F.col("epoch").eqNullSafe(F.col("e"))).select("epoch", F.col("i").alias("row"), (F.col("j") + (F.col("lag") - 1) * F.col("k")).alias("col"), "value")
    below = size.where("p > 1").select(F.col("e").alias("epoch"), F.explode(F.expr("sequence(0, k * (p - 1) - 1)")).alias("c"), "k")
    return top.union(below.select("epoch", (F.col("c") + F.col("k")).cast("int"), F.col("c").cast("int"), F.lit(1.0)))


def eigenvalues(coefficients: DataFrame) -> DataFrame:
    """(epoch, largest): the largest modulus of the companion matrix's eigenvalues; stable below 1."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        k, p = rows["i"].max() + 1, rows["lag"].max()
        a = np.zeros((k, k * p))
        a[rows["i"], rows["j"] + (rows["lag"] - 1) * k] = rows["value"]
        whole = np.concatenate([a, np.eye(k * (p - 1), k * p)])
        return pd.DataFrame({"epoch": [rows["epoch"].iloc[0]], "largest": [np.abs(np.linalg.eigvals(whole)).max()]})

    return coefficients.groupBy("epoch").applyInPandas(of, "epoch long, largest double")


def simulated(coefficients: DataFrame, n: int, seed: int = 0, noise=None) -> DataFrame:
    """(epoch, ch, x): n samples of each model, driven by noise(rng, k) or standard normal noise, after 10 * lags samples."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        k, p, epoch = rows["i"].max() + 1, rows["lag"].max(), rows["epoch"].iloc[0]
        a = np.zeros((p, k, k))
        a[rows["lag"] - 1, rows["i"], rows["j"]] = rows["value"]
        rng = np.random.default_rng([seed, 0 if pd.isna(epoch) else int(epoch) + 1])
        x = np.zeros((n + 11 * p, k))
        for t in range(p, len(x)):
            x[t] = sum(a[lag] @ x[t - lag - 1] for lag in range(p)) + (rng.standard_normal(k) if noise is None else noise(rng, k))
        return pd.DataFrame({"epoch": epoch, "ch": range(k), "x": list(x[-n:].T)}).astype({"epoch": "Int64"})

    return coefficients.groupBy("epoch").applyInPandas(of, "epoch long, ch int, x array<double>")


def default_max_lags(n: int, k: int) -> int:
    return min(int(round(12 * (n / 100) ** 0.25)), (n - k) // (1 + k))


def criteria(g: np.ndarray, k: int, most: int, seen: int, epochs: int = 1) -> list[tuple]:
    """(lags, aic, bic, hqic, fpe) of every order up to most, from one Gram matrix of [most lags, now] over seen samples of so many epochs.

    Orders are nested: the first k * p rows belong to order p. With a Cholesky factor L of the lags'
    products, the rows of inv(L) @ (products of lags with now) say what each further row explains, so
    residuals of all orders come from one factor. Where lags are no full set, each order takes the pseudo-inverse of its block.
    """
    m = k * most
    g = np.asarray(g, float).reshape(m + k, m + k)
    size = np.sqrt(np.where(np.diag(g)[:m] > 0, np.diag(g)[:m], 1.0))
    zz, zy, yy = g[:m, :m] / np.outer(size, size), g[:m, m:] / size[:, None], g[m:, m:]
    try:
        factor = np.linalg.cholesky(zz)
        if np.diag(factor).min() < 1e-7:
            raise np.linalg.LinAlgError
        rows = np.linalg.solve(factor, zy)
        explained = lambda p: rows[: k * p].T @ rows[: k * p]
    except np.linalg.LinAlgError:
        explained = lambda p: zy[: k * p].T @ np.linalg.pinv(zz[: k * p, : k * p], 1e-13, hermitian=True) @ zy[: k * p]
    out = []
    for p in range(1, most + 1):
        total = seen + (most - p) * epochs  # samples that order p alone could predict
        free, down = k * p, total - k * p
        ld = np.linalg.slogdet((yy - explained(p)) / (seen - k * p) * down / total)[1]
        out.append((p, ld + 2 * p * k * k / total, ld + math.log(total) * p * k * k / total, ld + 2 * math.log(math.log(total)) * p * k * k / total, ((total + free) / down) ** k * math.exp(ld)))
    return out


def select_order(vectors: DataFrame, max_lags: int | None = None, model: str = "dynamic") -> DataFrame:
    """(epoch, lags, aic, bic, hqic, fpe) of each order up to max_lags, all on the same samples.

    model "dynamic": of each epoch. "avg-epochs": of one model for all (epoch null), whose Gram matrices
    are added up; without max_lags it takes what the shortest epoch bears.
    """
    if model not in ("dynamic", "avg-epochs"):
        raise ValueError("model must be 'dynamic' or 'avg-epochs'")
    columns = ["epoch", "lags", "aic", "bic", "hqic", "fpe"]
    schema = "epoch long, lags int, aic double, bic double, hqic double, fpe double"

    def most_of(total: int, k: int) -> int:
        most = default_max_lags(total, k) if max_lags is None else max_lags
        if most > (total - k) // (1 + k):
            raise ValueError(f"{most} lags of {k} signals ask for more than {total} samples")
        return most

    if model == "dynamic":

        def of(rows: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(rows.sort_values("ch")["x"].to_numpy())
            most = most_of(x.shape[1], len(x))
            y, z = lagged(x, most)
            both = np.concatenate([z, y])
            return pd.DataFrame([(rows["epoch"].iloc[0], *c) for c in criteria(both @ both.T, len(x), most, y.shape[1])], columns=columns)

        return vectors.select("epoch", "ch", "x").groupBy("epoch").applyInPandas(of, schema)
    if max_lags is None:
        shortest, top = vectors.agg(F.min(F.size("x")), F.count_distinct("ch")).first()
        max_lags = default_max_lags(shortest, top) if shortest else 1
    most, grams = max_lags, gram(vectors, max_lags)
    epochs = grams.agg(F.count(F.lit(1)).alias("epochs"))

    def pooled(batches):
        for rows in batches:
            for r in rows.itertuples():
                if r.epochs:
                    yield pd.DataFrame([(None, *c) for c in criteria(r.g, r.k, most, r.n, r.epochs)], columns=columns).astype({"epoch": "Int64"})

    return pooled_gram(grams).crossJoin(F.broadcast(epochs)).mapInPandas(pooled, schema)  # one row with one


def best_order(criteria: DataFrame) -> DataFrame:
    """(epoch, aic, bic, hqic, fpe): the order that each criterion likes best."""
    return criteria.groupBy("epoch").agg(*[F.min_by("lags", c).alias(c) for c in ("aic", "bic", "hqic", "fpe")])
