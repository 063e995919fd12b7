"""From raw documents to shards: five stages, each reading what the one before has written.

A stage's functions take any documents table: null ids and texts, empty and very long texts, repeated
rows, empty tables and further columns of any name, which stay. What each stage does with odd rows
stands in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.llm import decontamination, mixing, quality, sharding, simhash
from covaria.llm.common import cut, read, tidy, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this stage's labelled rows, doesn't reject.

    Null and empty texts score as the mean of all documents does; rows without an id are scored like
    others, and repeated rows alike; without labels of both kinds all rows score the share of good ones.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs.select(row, "doc_id", "text"), model).where("predicted = 1").select("doc.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of near-duplicates, that of the smallest id, null last.

    Groups are of rows and not of ids: rows that share an id but no text are apart, repeated rows are
    one group, and null, empty and blank texts form one.
    """
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts hold none, and repeated rows stay or go together."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as it is taken.

    Null is a source of its own; texts without words count nothing towards a target and are taken as
    often as others of their source, those of a source without any word never; repeated rows are drawn
    each for itself.
    """
    return mixing.taken(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there; null texts are one group, and equal texts share a shard.

    Columns named size, shard or slot are replaced.
    """
    return sharding.shard(docs, 16)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", shards),
]

#: The quality stage trains a network, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage wrote is deleted once the next one's rows are written."""
    docs, start = read(spark, sf_dir, "documents"), written()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
            tidy(spark, start, keep=docs)
    return docs
