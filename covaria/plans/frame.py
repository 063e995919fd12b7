"""Connectivity as one long table with a metadata record; the class follows from the dimensions present."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.operators import autoregression, selection

#: Pairs of nodes up to which a grid of them is broadcast.
SMALL_GRID = 1_000_000
DIMS = ("epoch", "con", "seed", "target", "component", "f", "freq", "band", "t", "time", "lag")


@dataclass(frozen=True)
class Meta:
    method: str
    n_nodes: int
    indices: str = "raveled"  # "all", "symmetric" or "raveled": a list of pairs
    names: list[str] = field(default_factory=list)
    spec_method: str | None = None
    n_epochs_used: int | None = None
    event_id: dict[str, int] = field(default_factory=dict)
    extra: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class ConnFrame:
    """df has columns of DIMS and value (or value_re and value_im).

    maps, of connections between sets: (dimensions of df, side, ch, filter, pattern), for each channel of
    the recording that a set names, zeros where it is bad.
    """

    df: DataFrame
    meta: Meta
    maps: DataFrame | None = None

    @property
    def dims(self) -> tuple[str, ...]:
        return tuple(c for c in DIMS if c in self.df.columns)

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in DIMS]

    @property
    def kind(self) -> str:
        """Name of the container that these dimensions make."""
        has = set(self.dims)
        spectral, temporal = bool(has & {"f", "freq", "band"}), bool(has & {"t", "time", "lag"})
        middle = "SpectroTemporal" if spectral and temporal else "Spectral" if spectral else "Temporal" if temporal else ""
        return ("Epoch" if "epoch" in has else "") + middle + "Connectivity"

    @property
    def names(self) -> list[str]:
        return self.meta.names or [str(i) for i in range(self.meta.n_nodes)]

    @property
    def shape(self) -> tuple[int, ...]:
        """How many values each dimension has."""
        return tuple(self.df.agg(*[F.count_distinct(d) for d in self.dims]).first())

    def _map(self, what: str) -> DataFrame:
        if self.maps is None:
            raise ValueError(f"{self.meta.method} has no {what}s")
        return self.maps.select(*[c for c in self.maps.columns if c not in ("filter", "pattern")], F.col(what).alias("value"))

    @property
    def patterns(self) -> DataFrame:
        """Each channel's share of a component, by side."""
        return self._map("pattern")

    @property
    def filters(self) -> DataFrame:
        """The weights that make a component of channels, by side."""
        return self._map("filter")

    def coords(self, dim: str) -> DataFrame:
        """The values that a dimension has."""
        return self.df.select(dim).distinct()

    @property
    def n_epochs(self) -> int | None:
        return self.df.select("epoch").distinct().count() if "epoch" in self.dims else None

    def get_data(self, output: str = "compact") -> DataFrame:
        """raveled: as stored; dense: every pair of nodes, mirrored if symmetric, 0 off an all-to-all triangle, null off a list; compact: dense but for lists."""
        if output not in ("raveled", "dense", "compact"):
            raise ValueError("output must be 'raveled', 'dense' or 'compact'")
        if output == "raveled" or (output == "compact" and self.meta.indices == "raveled"):
            return self.df
        if "component" in self.dims or "seed" not in self.dims:
            raise ValueError("connections of several channels have no dense form")
        others = [c for c in self.dims if c not in ("con", "seed", "target")]
        spark = self.df.sparkSession
        n = self.meta.n_nodes
        small = F.broadcast if n * n <= SMALL_GRID else (lambda df: df)
        grid = spark.range(n * n).select((F.col("id") / n).cast("int").alias("seed"), (F.col("id") % n).cast("int").alias("target"))
        rows = self.df
        if self.meta.indices == "symmetric":
            mirror = rows.where("seed != target").withColumns({"seed": F.col("target"), "target": F.col("seed")})
            rows = rows.unionByName(mirror)
        if others:
            grid = rows.select(*others).distinct().crossJoin(small(grid))
        dense = grid.join(rows.select(*others, "seed", "target", *self.values), [*others, "seed", "target"], "left")
        return dense if self.meta.indices == "raveled" else dense.fillna(0.0, self.values)

    def combine(self, how: str | Callable = "mean") -> ConnFrame:
        """Reduces epochs by mean, median or a function of a pandas Series; maps by mean or median, or they are left out."""
        if "epoch" not in self.dims:
            raise ValueError("there are no epochs to combine")
        keys = [c for c in self.dims if c != "epoch"]
        if how in ("mean", "median"):
            reduce = F.avg if how == "mean" else F.median
            over = lambda df, values: df.groupBy(*[c for c in df.columns if c not in {"epoch", *values}]).agg(*[reduce(v).alias(v) for v in values])
            return replace(self, df=over(self.df, self.values), maps=None if self.maps is None else over(self.maps, ["filter", "pattern"]))
        if not callable(how):
            raise ValueError("how must be 'mean', 'median' or a function")
        kinds, values = dict(self.df.dtypes), self.values

        def of(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([[rows[k].iloc[0] for k in keys] + [float(how(rows[v])) for v in values]], columns=[*keys, *values])

        return replace(self, maps=None, df=self.df.groupBy(*keys).applyInPandas(of, ", ".join(f"{k} {kinds[k]}" for k in keys) + "".join(f", {v} double" for v in values)))

    def append(self, other: ConnFrame) -> ConnFrame:
        """Epochs of both, the other's numbered on; both must be alike."""
        if self.kind != other.kind or "epoch" not in self.dims or self.dims != other.dims:
            raise ValueError(f"{other.kind} can't be appended to {self.kind}")
        common = self.meta.event_id.keys() & other.meta.event_id.keys()
        if any(self.meta.event_id[k] != other.meta.event_id[k] for k in common):
            raise ValueError("event ids differ")
        offset = self.df.agg((F.max("epoch") + 1).alias("_offset"))
        moved = lambda df: df.crossJoin(F.broadcast(offset)).withColumn("epoch", F.col("epoch") + F.coalesce("_offset", F.lit(0))).drop("_offset")  # noqa: E731  one row
        maps = self.maps.unionByName(moved(other.maps)) if self.maps is not None and other.maps is not None else None
        return ConnFrame(self.df.unionByName(moved(other.df)), replace(self.meta, event_id=self.meta.event_id | other.meta.event_id), maps)

    def rename_nodes(self, mapping: dict[str, str] | Callable[[str], str]) -> ConnFrame:
        if not callable(mapping):
            missing = set(mapping) - set(self.names)
            if missing:
                raise ValueError(f"no nodes named {', '.join(sorted(missing))}")
        new = [mapping(n) if callable(mapping) else mapping.get(n, n) for n in self.names]
        if any(not isinstance(n, str) for n in new):
            raise ValueError("names must be strings")
        if len(set(new)) != len(new):
            raise ValueError("names must differ from each other")
        return replace(self, meta=replace(self.meta, names=new))

    def named(self) -> DataFrame:
        """df with the names of seeds and targets."""
        names = F.array(*[F.lit(n) for n in self.names])
        return self.df.withColumns({"seed_name": F.get(names, F.col("seed")), "target_name": F.get(names, F.col("target"))})

    def strongest(self, n: int, absolute: bool = False, positions: list[tuple[float, ...]] | None = None, min_distance: float = 0.0) -> DataFrame:
        """The n largest values and whatever equals the last of them; then without pairs of nodes nearer than min_distance."""
        size = F.abs(self.values[0]) if absolute else F.col(self.values[0])
        last = self.df.select(size.alias("v")).orderBy(F.desc("v")).limit(n).agg(F.min("v").alias("_least"))  # n rows of each partition meet
        top = self.df.crossJoin(F.broadcast(last)).where(size >= F.col("_least")).drop("_least")  # one row
        if positions is None:
            return top
        places = F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in positions])
        apart = F.aggregate(F.zip_with(F.get(places, F.col("seed")), F.get(places, F.col("target")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        return top.where(F.sqrt(apart) >= min_distance)

    def save(self, path: str) -> None:
        """A folder of two or three tables: values, maps if there are any, and one row of metadata."""
        self.df.write.mode("overwrite").parquet(f"{path}/values")
        if self.maps is not None:
            self.maps.write.mode("overwrite").parquet(f"{path}/maps")
        self.df.sparkSession.createDataFrame([(self.kind, json.dumps(asdict(self.meta)), self.maps is not None)], "kind string, meta string, has_maps boolean").write.mode("overwrite").parquet(f"{path}/meta")

    # autoregressive models

    def _model(self) -> DataFrame:
        if "lag" not in self.dims:
            raise ValueError(f"{self.meta.method} isn't an autoregressive model")
        df = self.df if "epoch" in self.dims else self.df.withColumn("epoch", F.lit(None).cast("long"))
        return df.select("epoch", F.col("seed").alias("i"), F.col("target").alias("j"), "lag", "value")

    def predict(self, vectors: DataFrame) -> DataFrame:
        return autoregression.predicted(vectors, self._model())

    def simulate(self, n: int, seed: int = 0, noise=None) -> DataFrame:
        model = self._model().groupBy("i", "j", "lag").agg(F.avg("value").alias("value")).withColumn("epoch", F.lit(None).cast("long"))
        return autoregression.simulated(model, n, seed, noise)

    def companion(self) -> DataFrame:
        return autoregression.companion(self._model())

    def eigvals(self) -> DataFrame:
        return autoregression.eigenvalues(self._model())

    def is_stable(self) -> bool:
        return bool(self.eigvals().agg(F.max("largest") < 1).first()[0])

    def __repr__(self) -> str:
        return f"<{self.kind} | {self.meta.method}, nodes: {self.meta.n_nodes}, dims: {', '.join(self.dims)}>"


def read_connectivity(spark: SparkSession, path: str) -> ConnFrame:
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    maps = spark.read.parquet(f"{path}/maps") if meta.get("has_maps") else None
    return ConnFrame(spark.read.parquet(f"{path}/values"), Meta(**json.loads(meta["meta"])), maps)


def degree(dense: DataFrame, n_nodes: int, threshold_prop: float = 0.2, value: str = "value", symmetric: bool | None = None) -> DataFrame:
    """(node, degree) over the strongest share of edges of a dense (seed, target, value).

    Symmetric values (looked for in the data unless said) are counted once and mirrored; edges of value 0 or less don't count; where the
    share rounds to no edge at all, all are kept. Ties go by seed and target; NaN is no edge.
    """
    if not 0 < threshold_prop <= 1:
        raise ValueError("threshold_prop lies between 0 and 1")
    off = dense.where("seed != target").select("seed", "target", F.col(value).alias("v"))
    if symmetric is None:
        other = off.select(F.col("seed").alias("target"), F.col("target").alias("seed"), F.col("v").alias("w"))
        symmetric = off.join(other, ["seed", "target"]).agg((F.max(F.abs(F.col("v") - F.col("w"))) <= 1e-8).alias("s")).first().s
    half = off.where("seed < target") if symmetric else off
    keep = int(np.round((n_nodes**2 - n_nodes) * threshold_prop / (2 if symmetric else 1)))
    if keep:  # exactly, without a sort of all edges
        half = selection.largest(half.withColumn("place", F.col("seed").cast("long") * n_nodes + F.col("target")), "v", "place", keep)
    edges = half.where("v > 0")
    ends = edges.select(F.col("target").alias("node"))
    ends = ends.unionByName(edges.select(F.col("seed").alias("node"))) if symmetric else ends
    nodes = dense.sparkSession.range(n_nodes).select(F.col("id").cast("int").alias("node"))
    counted = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(counted, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
