"""Measures over an unbounded stream of samples that carry the time they were taken at.

Samples are dealt to epochs by their own time, however they arrive: repeated ones count once, and an epoch
stays open until the watermark (the latest time seen less the delay) has passed its end. Then it leaves the state as one
row, its cross-spectra are added to the sums so far, and nothing of it is kept. State is the open epochs'
cells and the ids seen within the delay; the sums are pairs times bins, whatever the stream's length.

Sums are a table: each batch writes a snapshot, what the one before holds and its own epochs. A batch that is
run again after a failure starts from the same snapshot and overwrites its own, so every epoch counts once.

Defined cases: samples that come after the watermark has passed them are dropped, whatever their epoch; a
null id, time, channel or value is no sample; a time without a zone is in the session's; channels that aren't listed are left out; cells without a sample are 0;
epochs without any sample don't exist; an epoch that the watermark hasn't passed isn't counted yet.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from covaria.operators import bivariate
from covaria.streaming.epochs import cross_spectra


def _micros(duration: str) -> Column:
    return F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {duration}"))


def closed_epochs(samples: DataFrame, channels: list, n_times: int, length: str = "1 day", delay: str = "1 hour", id_col: str = "event_id", time_col: str = "ts", channel_col: str = "event_type", value_col: str = "value") -> DataFrame:
    """A stream of samples to a stream of whole epochs (epoch: multiples of length since 1970, x: an array for each of channels), each once.

    A cell, one channel at one of n_times steps of an epoch, is the sum of its samples.
    """
    listed = samples.sparkSession.createDataFrame([(c, i) for i, c in enumerate(channels)], f"_name {dict(samples.dtypes)[channel_col]}, ch int")
    rows = samples.select(F.col(id_col).alias("id"), F.col(time_col).cast("timestamp").alias("ts"), F.col(channel_col).alias("_name"), F.col(value_col).cast("double").alias("value")).dropna()
    rows = rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"]).join(F.broadcast(listed), "_name")
    within = F.unix_micros("ts") - F.unix_micros("w.start")
    step = F.floor(within * n_times / _micros(length)).cast("int")
    cells = rows.withColumn("w", F.window("ts", length)).withColumn("at", F.col("ch") * n_times + step)
    cells = cells.groupBy("w", "at").agg(F.sum("value").alias("value"))
    found = cells.groupBy(F.window(F.window_time("w"), length).alias("e")).agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("cells"))
    cell = lambda c: lambda t: F.coalesce(F.try_element_at("cells", c * n_times + t), F.lit(0.0))
    x = F.transform(F.sequence(F.lit(0), F.lit(len(channels) - 1)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(n_times - 1)), cell(c)))
    return found.select(F.floor(F.unix_micros("e.start") / _micros(length)).alias("epoch"), x.alias("x"))


def _snapshots(spark: SparkSession, folder: str) -> dict[int, str]:
    """Snapshots that were written to their end, by batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return {}
    found = [str(s.getPath().toString()) for s in files.listStatus(path)]
    return {int(p.rsplit("=", 1)[1]): p for p in found if "/batch=" in p and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))}


def accumulate(epochs: DataFrame, sfreq: float, bins: np.ndarray, methods: list[str], folder: str, **trigger) -> StreamingQuery:
    """Starts adding a stream of whole epochs to the sums in folder/sums; started again on the same folder it goes on where it was."""
    sums = f"{folder}/sums"

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = {n: p for n, p in _snapshots(spark, sums).items() if n < number}
        own = bivariate.partial(cross_spectra(batch, sfreq, bins), methods)
        if before:
            own = bivariate.merged(own.unionByName(spark.read.parquet(before[max(before)])))
        own.write.mode("overwrite").parquet(f"{sums}/batch={number}")
        for n in sorted(before)[:-1]:  # the last one before is what this batch would start from again
            old = spark._jvm.org.apache.hadoop.fs.Path(before[n])
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    writer = epochs.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def measured(spark: SparkSession, folder: str, methods: list[str]) -> DataFrame:
    """The values of all epochs that were closed so far."""
    found = _snapshots(spark, f"{folder}/sums")
    if not found:
        raise ValueError(f"nothing was accumulated in {folder}")
    return bivariate.finished(spark.read.parquet(found[max(found)]), methods)
