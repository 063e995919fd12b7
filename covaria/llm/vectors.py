"""Embedding near-dedup: an exact metric range join over pivots.

Vectors are compared within their label, as unit vectors: cosine >= 0.98 is a distance of at most
``RANGE``. Some vectors of a cell (at first a label) serve as pivots, and every vector lives in the cell
of its nearest pivot. By the triangle inequality a neighbour of a vector in cell p is at most twice the
range farther from p than from its own nearest pivot q, and no farther than the range beyond the
plane that halves the way from q to p; every vector is replicated to the cells for which both hold,
and cells are joined independently. A pair is found in the home cell of either vector, so each home
counts all its links without meeting another cell.

Cells with more than ``PER`` homes are split again, by pivots of their own, as long as a sample of the
cell says that it saves moving and comparing rows; pivots and rows meet by cell, in parts, on executors.
Equal vectors are one row from the start. Cells hold at most ``BLOCK`` homes and as many visitors
at a time: larger ones are dealt out in blocks of homes against blocks of visitors. A block returns
a count for each home and a spanning forest of its links, never all pairs.

Defined cases: ids are integers, others raise TypeError; vectors that are null, zero, or hold null or non-finite components, and those whose
label is null, link with nothing; labels are compared as text, so any type will do; vectors of different
lengths are never compared; equal vectors of one label link with each other; null ids count as links of
others and get the component of their class; repeated rows are vectors of their own; an empty table gives
no rows; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .components import components

LEAST = 0.98
#: Slack for rounding in distances, never in the cosine that decides.
RANGE = math.sqrt(2 - 2 * LEAST) + 1e-7
#: Homes from which on a cell is split, pivots of a split and rows to judge it by, and rows of a block on either side.
PER, PIVOTS, SAMPLE, BLOCK = 2048, 64, 512, 2048
#: What a split may leave of the rows moved, at most.
SAVED = 0.7
CELL = "cell string, cls long, many long, is_home boolean, v array<double>"


def _reached(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector, and which pivots' cells each must be in."""
    square = np.maximum(0, 2 - 2 * x @ pivots.T)
    far, home = np.sqrt(square), square.argmin(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    nearest = np.arange(len(x)), home
    return home, (far <= far[nearest][:, None] + 2 * RANGE) & (square <= square[nearest][:, None] + 2 * RANGE * apart[home] + 1e-7)


def _pivots(n_pivots: int, block: int):
    """Of a sample of a cell's homes the first as pivots, if they split it well, else none."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        x, (homes, every) = np.stack(rows["v"].to_numpy()), rows[["homes", "rows"]].iloc[0]
        own = x[:n_pivots]
        home, inside = _reached(x, own)
        together = (np.bincount(home, minlength=len(own)) / len(x)) @ inside.mean(0)  # pairs that still meet
        before = 2 * homes / block
        good = len(own) > 1 and inside.sum(1).mean() + together * before < SAVED * before
        return rows[["cell", "v"]].iloc[: len(own) if good else 0]

    return of


def _split(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(pivots):
        return rows[["cell", "cls", "many", "is_home", "v"]]
    pivots = pivots.sort_values("n")
    home, inside = _reached(np.stack(rows["v"].to_numpy()), np.stack(pivots["v"].to_numpy()))
    i, at = np.nonzero(inside)
    names = np.array([f"/{n}" for n in pivots["n"]], object)
    out = rows.iloc[i]
    return pd.DataFrame({"cell": out["cell"].to_numpy() + names[at], "cls": out["cls"].to_numpy(), "many": out["many"].to_numpy(), "is_home": out["is_home"].to_numpy() & (home[i] == at), "v": out["v"].to_numpy()})


def cells(live: DataFrame, per: int = PER, n_pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """Unit vectors by cell, all at home, to cells that splitting makes no better."""
    done = []
    while True:
        crowd = live.groupBy("cell").agg(F.count_if("is_home").alias("homes"), F.count(F.lit(1)).alias("rows"))
        large = cut(crowd.where(F.col("homes") > per))
        if large.isEmpty():
            break
        share = F.pmod(F.xxhash64("cell", "cls"), F.lit(1 << 30)) < F.lit(float(SAMPLE)) / F.col("homes") * (1 << 30)
        sample = live.where("is_home").join(large, "cell").where(share)  # about SAMPLE of each cell
        found = cut(sample.select("cell", "v", "homes", "rows").groupBy("cell").applyInPandas(_pivots(n_pivots, block), "cell string, v array<double>").withColumn("n", F.monotonically_increasing_id()))
        split = found.select("cell").distinct().join(large, "cell").select("cell", F.ceil(F.col("rows") / block).cast("int").alias("parts"))
        split = cut(split)
        if split.isEmpty():
            break
        inside = live.join(split, "cell").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).drop("parts")
        beside = found.join(split, "cell").select("cell", "v", "n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        done.append(live.join(split, "cell", "left_anti"))
        live = cut(inside.groupBy("cell", "part").cogroup(beside.groupBy("cell", "part")).applyInPandas(_split, CELL))
    for other in done:
        live = live.unionByName(other)
    return live


def _linked(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one block: links of each home (weighted by copies), and a spanning forest of all links."""
    homes, others = rows[rows["side"] == "home"], rows[rows["side"] == "other"]
    if not len(homes) or not len(others):
        return pd.DataFrame({"cls": [], "links": [], "other": []})
    a, b = np.stack(homes["v"].to_numpy()), np.stack(others["v"].to_numpy())
    names, at = np.unique(np.concatenate([homes["cls"].to_numpy(), others["cls"].to_numpy()]), return_inverse=True)
    label, h, o = np.arange(len(names)), at[: len(a)], at[len(a) :]
    many, links = others["many"].to_numpy(np.int64), np.zeros(len(a), np.int64)
    for i in range(0, len(a), 256):
        near = a[i : i + 256] @ b.T >= LEAST
        near &= h[i : i + 256, None] != o[None, :]
        links[i : i + 256] = near @ many
        x, y = np.nonzero(near)
        x, y = h[i + x], o[y]
        while (label[x] != label[y]).any():
            least = np.minimum(label[x], label[y])
            np.minimum.at(label, label[x], least)
            np.minimum.at(label, label[y], least)
            label = label[label]
    tied = np.nonzero(label != np.arange(len(names)))[0]
    counted = pd.DataFrame({"cls": homes["cls"].to_numpy(), "links": links, "other": None})
    return pd.concat([counted[links > 0], pd.DataFrame({"cls": names[tied], "links": 0, "other": names[label[tied]]})]).astype({"cls": "int64", "links": "int64", "other": "Int64"})


def linked(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", per: int = PER, n_pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """The id of each vector with n_links (long), component_id (long) and kept (boolean)."""
    if not isinstance(vectors.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    value = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(value, F.lit(0.0), lambda s, x: s + x * x))
    sound = F.col(label_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (length > 0) & (length < float("inf"))
    keyed = cut(vectors.select(F.col(id_col).cast("long").alias("_id"), F.when(sound, F.col(label_col).cast("string")).alias("label"), F.when(sound, value).alias("v"), F.when(sound, length).alias("length")).withColumn("digest", F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), " "))))
    # a class: equal vectors of one label
    classes = keyed.where("v IS NOT NULL").groupBy("label", "digest").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("many"), F.first("v").alias("v"), F.first("length").alias("length"))
    classes = cut(classes.select("label", "digest", F.monotonically_increasing_id().alias("cls"), "least", "many", "v", "length", F.size("v").alias("dim")))

    whole = classes.select(F.concat_ws("/", F.md5("label"), "dim").alias("cell"), "cls", "many", F.lit(True).alias("is_home"), F.transform("v", lambda x: x / F.col("length")).alias("v"))
    dealt = cut(cells(cut(whole), per, n_pivots, block))
    crowd = dealt.groupBy("cell").agg(F.count_if("is_home").alias("homes"), F.count(F.lit(1)).alias("rows"))
    sized = dealt.join(crowd, "cell").where("homes > 0")
    hb, vb = F.ceil(F.col("homes") / block).cast("int"), F.ceil(F.col("rows") / block).cast("int")
    home = sized.where("is_home").select("cell", F.pmod(F.xxhash64("cls"), hb).cast("int").alias("hb"), F.explode(F.sequence(F.lit(0), vb - 1)).alias("vb"), "cls", "many", "v", F.lit("home").alias("side"))
    other = sized.select("cell", F.explode(F.sequence(F.lit(0), hb - 1)).alias("hb"), F.pmod(F.xxhash64("cls"), vb).cast("int").alias("vb"), "cls", "many", "v", F.lit("other").alias("side"))
    found = cut(home.unionByName(other).groupBy("cell", "hb", "vb").applyInPandas(_linked, "cls long, links long, other long"))

    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = components(found.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    least = joined.join(classes.select("cls", "least"), joined.node == F.col("cls")).groupBy("component").agg(F.min("least").alias("least"))
    reached = joined.join(least, "component").select(F.col("node").alias("cls"), F.col("least").alias("reached"))
    of_class = classes.select("label", "digest", "cls", "least", "many").join(links, "cls", "left").join(reached, "cls", "left")
    of_class = cut(of_class.select("label", "digest", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("reached", "least").alias("component_id")))
    out = keyed.select("_id", "label", "digest").join(of_class, ["label", "digest"], "left")
    component = F.coalesce("component_id", "_id")
    kept = F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept)


def digest(vectors: DataFrame) -> DataFrame:
    """The rows of op4."""
    return linked(vectors)


#: The rows of op4 by DuckDB: all pairs of a label, and what each vector reaches.
ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= {LEAST}),
r(n, m) AS (SELECT a, b FROM p UNION SELECT r.n, p.b FROM r JOIN p ON r.m = p.a),
c AS (SELECT n, min(m) AS least FROM r GROUP BY n), k AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT vec_id, coalesce(k.links, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id <= coalesce(c.least, vec_id) AS kept
FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN c ON c.n = vec_id
"""
