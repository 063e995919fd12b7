"""Signals from tables: one row for each epoch and channel, samples in an array.

``vectors`` is the working form: (epoch long, ch int, x array<double>). ``long`` form, one row a
sample (epoch, ch, t, value), serves queries that align samples.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A row of an epoch holds all its channels and pairs are made of them, so their number is bounded.
MOST_CHANNELS = 10_000


def densify(cells: DataFrame, channels: DataFrame, n_times: int) -> DataFrame:
    """Cells (epoch, ch, t, value) to vectors with zeros where there is no cell.

    One shuffle by epoch: an epoch's cells become a map that every channel is read from, so neither
    a product of dimensions nor a join of it with the cells is needed. The list of channels is read
    first, and refused if it has more than MOST_CHANNELS.
    """
    listed = [r.ch for r in channels.select("ch").distinct().orderBy("ch").limit(MOST_CHANNELS + 1).collect()]
    if len(listed) > MOST_CHANNELS:
        raise ValueError(f"more than {MOST_CHANNELS} channels")
    found = cells.where(F.col("ch").isNotNull()).groupBy("epoch").agg(F.map_from_entries(F.collect_list(F.struct(F.col("ch") * n_times + F.col("t"), F.col("value")))).alias("cells"))
    rows = found.select("epoch", "cells", F.explode(F.lit(listed) if listed else F.array().cast("array<int>")).alias("ch"))
    at = lambda t: F.coalesce(F.try_element_at("cells", (F.col("ch") * n_times + t).cast("int")), F.lit(0.0))
    return rows.select("epoch", F.col("ch").cast("int").alias("ch"), F.transform(F.sequence(F.lit(0), F.lit(n_times - 1)), at).alias("x"))


def from_long(samples: DataFrame) -> DataFrame:
    """(epoch, ch, t, value) without holes to vectors."""
    ordered = F.array_sort(F.collect_list(F.struct("t", "value")))
    return samples.groupBy("epoch", "ch").agg(F.transform(ordered, lambda s: s["value"]).alias("x"))


def to_long(vectors: DataFrame) -> DataFrame:
    return vectors.select("epoch", "ch", F.posexplode("x").alias("t", "value"))


def channels_of(table: DataFrame, name: str) -> DataFrame:
    """(name, ch): names numbered in order; a dimension, so one small partition."""
    from pyspark.sql.window import Window

    return table.select(F.col(name).alias("name")).distinct().select("name", (F.row_number().over(Window.orderBy("name")) - 1).cast("int").alias("ch"))


def events(table: DataFrame) -> DataFrame:
    """Days by event type by hour: the sum of values, 24 samples a day."""
    cells = table.groupBy(F.to_date("ts").alias("day"), "event_type", F.hour("ts").alias("t")).agg(F.sum("value").alias("value"))
    names = channels_of(table, "event_type")
    keyed = cells.join(names, F.col("event_type") == F.col("name"))
    return densify(keyed.select(F.unix_date("day").cast("long").alias("epoch"), "ch", "t", "value"), names, 24)


def embeddings(table: DataFrame) -> DataFrame:
    """Groups of four consecutive vectors as epochs of four channels."""
    return table.where("embedding IS NOT NULL").select(F.floor(F.col("vec_id") / 4).cast("long").alias("epoch"), (F.col("vec_id") % 4).cast("int").alias("ch"), F.col("embedding").cast("array<double>").alias("x"))


def orders(table: DataFrame, n_times: int = 92) -> DataFrame:
    """Quarters by priority by day in the quarter: the sum of prices; 92 days hold every quarter, 0 stands where one is shorter."""
    start = F.trunc("o_orderdate", "quarter")
    cells = table.select((F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("long").alias("epoch"), "o_orderpriority", F.datediff("o_orderdate", start).alias("t"), "o_totalprice")
    cells = cells.where(F.col("t") < n_times).groupBy("epoch", "o_orderpriority", "t").agg(F.sum("o_totalprice").alias("value"))
    names = channels_of(table, "o_orderpriority")
    return densify(cells.join(names, F.col("o_orderpriority") == F.col("name")).select("epoch", "ch", "t", "value"), names, n_times)


def stacked(*blocks: DataFrame) -> DataFrame:
    """Blocks of channels of the same epochs as one set of vectors; channels of a later block count on."""
    out, offset = [], 0
    lengths = set()
    for block in blocks:
        top, shortest, longest = block.agg(F.max("ch"), F.min(F.size("x")), F.max(F.size("x"))).first()
        lengths |= {shortest, longest}
        out.append(block.withColumn("ch", (F.col("ch") + offset).cast("int")))
        offset += (top if top is not None else -1) + 1
    if len(lengths - {None}) > 1:
        raise ValueError("all blocks must have the same number of samples")
    return reduce(DataFrame.unionByName, out)


def window(vectors: DataFrame, sfreq: float, tmin: float | None = None, tmax: float | None = None, t0: float = 0.0) -> DataFrame:
    """Samples between tmin and tmax, both included; the first sample is at t0."""
    first = 0 if tmin is None else max(0, -int(-(tmin - t0) * sfreq // 1) if (tmin - t0) * sfreq % 1 else int((tmin - t0) * sfreq))
    last = F.size("x") if tmax is None else F.least(F.size("x"), F.lit(int((tmax - t0) * sfreq + 1e-9) + 1))
    return vectors.withColumn("x", F.slice("x", F.lit(first + 1), F.greatest(last - first, F.lit(0))))


def without(vectors: DataFrame, bads: list[int]) -> DataFrame:
    return vectors.where(~F.col("ch").isin(bads)) if bads else vectors


def only(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """Channels that some edge names; edges are a list that is broadcast."""
    named = edges.select(F.explode(F.array("seed", "target")).alias("ch")).distinct()
    return vectors.join(F.broadcast(named), "ch", "left_semi")


def selected(vectors: DataFrame, epochs: DataFrame, codes: list[int]) -> DataFrame:
    """Epochs whose event code is one of codes."""
    return vectors.join(epochs.where(F.col("code").isin(codes)), "epoch", "left_semi")
