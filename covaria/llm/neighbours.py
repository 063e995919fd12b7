"""Approximate nearest neighbours by inner product: randomly rotated one-bit codes, error bounds, exact reranking.

A vector is stored as its distance from the mean of all, and a code: the difference is rotated at
random, the same way for all, into a space of at least ``BITS`` dimensions, and one bit keeps the sign of each
coordinate. The code stands for a unit vector; how well it agrees with the difference's own direction
(``fit``) corrects what is estimated by it. What a code misses of a direction points anywhere after a
random rotation, so what it adds to an inner product is about normal with a known deviation; ``SPREAD``
deviations above the estimate are its upper bound. Estimate and bound of a whole block are one product of
signs, scaled by the correction scalars, with the rotated queries.

Codes meet queries in blocks: ``BLOCK`` vectors against ``QUERIES`` queries. Of a block each query first
has the vectors with the highest bounds scored, ``FIRST`` times as many as it asks for, in double precision on the
original vectors; then only those whose bound reaches the k-th best score so far. The k
nearest of each block meet by query. All rows are indexed; the mean is that of all. Of vectors equal in
every component only the k + 1 smallest ids can ever be among k nearest (one may be the query's own),
so more of them aren't indexed, and no vector is hot.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; null ids
take no part; ids are integers, others raise TypeError; vectors of different lengths are never compared; rows that
repeat an id and a vector count once; of rows that share an id and no vector each is a candidate, and the
query's vector is the one that comes first component by component; a query without candidates has no rows; an
empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut

NEAREST, EVERY = 20, 20
#: Deviations of the estimate that bound an inner product, and bits of a code at least.
SPREAD, BITS = 4.0, 256
#: Vectors and queries of a block, pairs whose bounds are in memory at once, and how many are scored first, for each that is sought.
BLOCK, QUERIES, AT_ONCE, FIRST = 4096, 1024, 1 << 20, 4
FOUND = "query_id long, vec_id long, score double"


def rotation(dim: int, seed: int = 0) -> np.ndarray:
    """Orthonormal rows that turn vectors of dim components into max(dim, BITS), the same for all."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(max(dim, BITS), dim)))
    return (q * np.sign(np.diag(r))).T


class Codes:
    """One-bit codes of vectors about a centre, and what corrects them."""

    def __init__(self, bits: np.ndarray, norm: np.ndarray, fit: np.ndarray):
        self.bits, self.norm, self.fit = bits, norm, fit

    @classmethod
    def of(cls, x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Codes:
        off = (x - centre) @ turn
        norm = np.linalg.norm(off, axis=1)
        fit = np.abs(off).sum(1) / np.where(norm > 0, norm, 1) / np.sqrt(turn.shape[1])
        return cls(np.packbits(off > 0, axis=1), norm, np.where(norm > 0, fit, 1.0))

    def signs(self, length: int) -> np.ndarray:
        """A row for each code: its signs, scaled so that they multiply with a rotated query to the estimate, and what a query's norm adds to that in one deviation."""
        scale, n = self.norm / self.fit, max(1, length - 1)
        out = np.empty((len(self.bits), length + 1), np.float32)
        out[:, :-1] = np.unpackbits(self.bits, axis=1, count=length)
        out[:, :-1] *= (2 * scale / np.sqrt(length))[:, None]
        out[:, :-1] -= (scale / np.sqrt(length))[:, None]
        out[:, -1] = scale * (np.sqrt(np.maximum(0, 1 - self.fit**2) / n) + 1e-6)
        return out


def bounds(signs: np.ndarray, queries: np.ndarray, turn: np.ndarray, spread: float = SPREAD) -> np.ndarray:
    """What each code's inner product with each query exceeds that of the centre by, at most, spread deviations from the estimate; a row for each query."""
    asked = np.append(queries @ turn, spread * np.linalg.norm(queries, axis=1)[:, None], axis=1)
    return asked.astype(np.float32) @ signs.T


def products(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of x[i] and y[j], added up component by component, so that equal vectors have equal ones."""
    out = np.zeros(len(i))
    for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), strict=True):
        out += a[i] * b[j]
    return out


def _first(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, ties to smaller ids."""
    order = np.lexsort((ids, -score, query))
    start = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - start < k]


def _nearest(k: int, shared):
    """Of one block the k nearest of each query."""

    def of(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q = np.stack(rows["v"].to_numpy()).astype(float), np.stack(asked["v"].to_numpy()).astype(float)
        ids, names, (centre, seed) = rows["id"].to_numpy(np.int64), asked["id"].to_numpy(np.int64), shared.value
        turn, of_centre = rotation(x.shape[1], seed), q @ centre[x.shape[1]]
        bits = np.stack([np.frombuffer(c, np.uint8) for c in rows["code"]])
        signs = Codes(bits, rows["norm"].to_numpy(float), rows["fit"].to_numpy(float)).signs(turn.shape[1])
        found, step, first = [], max(1, AT_ONCE // len(x)), min(len(x), FIRST * k + 1)
        for at in range(0, len(q), step):
            part = slice(at, at + step)
            here = q[part]
            upper = bounds(signs, here, turn)
            j, i = np.arange(len(here)).repeat(first), np.argpartition(-upper, first - 1, axis=1)[:, :first].ravel()
            score = products(x, i, here, j)
            score[names[part][j] == ids[i]] = -np.inf
            least = np.partition(score.reshape(len(here), first), -k, axis=1)[:, -k] if k < first else np.full(len(here), -np.inf)
            # not below: bounds that aren't numbers, of products beyond what floats hold, leave nothing out
            j, i = np.nonzero(~(upper < (least - of_centre[part])[:, None]) & (names[part, None] != ids))
            score = products(x, i, here, j)
            few = ~(score < least[j])
            j, i, score = j[few], i[few], score[few]
            best = _first(j, score, ids[i], k)
            found.append(pd.DataFrame({"query_id": names[part][j[best]], "vec_id": ids[i[best]], "score": score[best]}))
        return pd.concat(found)

    return of


def sound(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v: array<double>, dim) of the vectors that take part, each once."""
    if not isinstance(vectors.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vector_col).alias("dim")).dropDuplicates(["id", "v", "dim"])


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    many: dict[int, int] = {}
    for rows in batches:
        for dim, group in rows.groupby("dim"):
            sums[dim] = sums.get(dim, 0) + np.stack(group["v"].to_numpy()).sum(0)
            many[dim] = many.get(dim, 0) + len(group)
    for dim, total in sums.items():
        yield pd.DataFrame({"dim": dim, "at": np.arange(dim), "total": total, "n": many[dim]})


def centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean of the vectors of each length; a task sends one row a component."""
    parts = rows.select("dim", "v").mapInPandas(_summed, "dim int, at int, total double, n long")
    means = parts.groupBy("dim", "at").agg((F.sum("total") / F.sum("n")).alias("mean")).collect()
    out: dict[int, np.ndarray] = {}
    for r in means:
        out.setdefault(r["dim"], np.zeros(r["dim"]))[r["at"]] = r["mean"]
    return out


def _coded(shared):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, seed = shared.value
        turns: dict[int, np.ndarray] = {}
        for rows in batches:
            for dim, group in rows.groupby("dim"):
                if dim not in turns:
                    turns[dim] = rotation(dim, seed)
                codes = Codes.of(np.stack(group["v"].to_numpy()), centre[dim], turns[dim])
                yield group.assign(code=[c.tobytes() for c in codes.bits], norm=codes.norm, fit=codes.fit)

    return of


def indexed(rows: DataFrame, shared) -> DataFrame:
    """The index: (id, v, dim) with code (packed bits), norm and fit."""
    return rows.select("id", "v", "dim").mapInPandas(_coded(shared), "id long, v array<double>, dim int, code binary, norm double, fit double")


def _blocks(n: Column, size: int, least: int) -> Column:
    """Blocks for n rows: of at most about size rows, and at least as many as keep all cores busy with a few hundred rows each."""
    return F.greatest(F.ceil(n / size), F.least(F.ceil(n / 256), F.lit(least))).cast("int")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, every: int = EVERY, block: int = BLOCK, queries: int = QUERIES, seed: int = 0) -> DataFrame:
    """The k vectors of largest inner product with each whose id is divisible by every: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = cut(sound(vectors, id_col, vector_col))
    shared = spark.sparkContext.broadcast((centres(rows), seed))  # a mean for each length of vectors
    of_equal = Window.partitionBy("dim", "v").orderBy("id")
    few = rows.withColumn("nth", F.row_number().over(of_equal)).where(F.col("nth") <= k + 1).drop("nth")
    index = cut(indexed(few, shared))
    asked = rows.where(F.col("id") % every == 0).groupBy("id", "dim").agg(F.min("v").alias("v"))
    asked = cut(asked.groupBy("id").agg(F.min(F.struct("v", "dim")).alias("q")).select("id", "q.v", "q.dim"))
    cores = spark.sparkContext.defaultParallelism
    sizes = index.groupBy("dim").agg(_blocks(F.count(F.lit(1)), block, cores).alias("n_block"))
    sizes = F.broadcast(cut(sizes.join(asked.groupBy("dim").agg(_blocks(F.count(F.lit(1)), queries, 1).alias("n_query")), "dim")))  # a row for each length
    here = index.join(sizes, "dim").select("id", "v", "code", "norm", "fit", "dim", F.pmod(F.xxhash64("id"), "n_block").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("n_query") - 1)).alias("q"))
    there = asked.join(sizes, "dim").select("id", "v", "dim", F.explode(F.sequence(F.lit(0), F.col("n_block") - 1)).alias("b"), F.pmod(F.xxhash64("id"), "n_query").cast("int").alias("q"))
    found = here.groupBy("dim", "b", "q").cogroup(there.groupBy("dim", "b", "q")).applyInPandas(_nearest(k, shared), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    """The rows of op13."""
    return nearest(vectors)


#: The same rows by DuckDB: every query against every vector.
ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {NEAREST}
"""
