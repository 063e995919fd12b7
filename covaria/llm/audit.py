"""Filter interaction audit: what each filter removes in every order of the filters, from a lattice of subsets.

What a filter removes from documents that others have passed doesn't depend on the order in which the
others came, only on which they were. So the orders of n filters are paths through the lattice of
subsets, whose edges are (filters already applied, next filter): 80 edges for five filters, against 120
orders of five steps. Documents are counted by part, set of failed filters and labels, at most 32 sets
each; a count contributes to every edge of its part; edges are joined to the steps of all orders, and a
filter's Shapley sum weighs its edges by the number of orders that lead through them.

Whether a text repeats that of a smaller id is a filter too, but knows more than its row. Texts are
compared by SHA-256. Rows are counted by text, part and labels first, each count with the smallest id
that it holds, so a text that a third of all rows share is a few rows where its smallest id is sought.

Defined cases: null texts are empty; a null part is that of the empty string; a null id is no smaller
than any other and has none smaller, and has no label; rows that share id and text are counted each, and
repeat no smaller id; several labels of one document count if any says so, null ones and those of absent
documents never; an empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD

MARKS = ("good", "toxic")


def conditions(text: Column) -> dict[str, Column]:
    """What makes a text fail filters A to D; texts aren't null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, fails, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, failed, good, toxic, n): documents by the bits of the filters they fail.

    fails makes of a text column the conditions of filters in order; the last bit, one more, says
    that a smaller id has the same text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails(text).values())), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), bits.cast("int").alias("failed"), F.unhex(F.sha2(text, 256)).alias("text"))
    rows = rows.groupBy("id", "part", "failed", "text").agg(F.count(F.lit(1)).alias("n"))
    said = labels.groupBy(F.col(id_col).alias("id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    known = rows.where("id IS NOT NULL").join(said, "id", "left").fillna(0, list(MARKS))
    every = known.unionByName(rows.where("id IS NULL").select("*", *[F.lit(0).alias(m) for m in MARKS]))
    # of each text by part and labels: the rows, and how many of them have the smallest id
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    counted = every.groupBy("text", "part", *MARKS, "failed").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("named"), least.alias("least"))
    first = F.min("least.id").over(Window.partitionBy("text"))
    again = F.when(F.col("least.id") == F.col("first"), F.col("named") - F.col("least.n")).otherwise(F.col("named"))
    split = counted.withColumn("first", first).select("part", "failed", *MARKS, "n", again.alias("again"))
    bit = len(fails(text))
    both = F.array(F.struct("failed", (F.col("n") - F.col("again")).alias("n")), F.struct(F.col("failed").bitwiseOR(1 << bit).alias("failed"), F.col("again").alias("n")))
    return split.select("part", *MARKS, F.inline(both)).where("n > 0").groupBy("part", "failed", *MARKS).agg(F.sum("n").alias("n"))


def edges(failed: DataFrame, n_filters: int) -> DataFrame:
    """(part, applied, filter, ...): for each part and edge of the lattice what filter does to documents that those applied have passed."""
    every = [(s, f) for s in range(1 << n_filters) for f in range(n_filters) if not s >> f & 1]
    edge = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter")) for s, f in every])
    rows = failed.select("*", F.inline(edge)).withColumn("bit", F.expr("shiftleft(1, `filter`)"))
    fails, passed = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("applied")) == 0
    count = lambda where, what=None: F.coalesce(F.sum(F.when(where, F.col("n") if what is None else F.col("n") * F.col(what))), F.lit(0)).cast("long")
    found = rows.groupBy("part", "applied", "filter").agg(
        count(passed & ~fails).alias("kept"),
        count(passed & fails).alias("removed"),
        count(~passed & fails).alias("redundant"),
        count(F.col("failed") == F.col("bit")).alias("unique_fails"),
        *[count(passed & fails, m).alias(f"{m}_lost") for m in MARKS],
    )
    orders = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n_filters - 1 - k)) for k in range(n_filters)]), F.bit_count("applied") + 1)
    return found.withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "filter")))


def steps(spark: SparkSession, names: str) -> DataFrame:
    """(filter_order, step, applied, filter): every step of every order of the filters, n * n! rows."""
    rows = []
    for order in itertools.permutations(range(len(names))):
        for k, f in enumerate(order):
            rows.append(("".join(names[i] for i in order), k + 1, sum(1 << i for i in order[:k]), f))
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def audit(docs: DataFrame, labels: DataFrame, fails=conditions, names: str = "ABCDE", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    names has one letter for each condition, and a last one for the filter of repeated texts.
    """
    lattice = edges(failures(docs, labels, fails, id_col, text_col, part_col), len(names))
    paths = F.broadcast(steps(docs.sparkSession, names))  # n * n! rows
    return lattice.join(paths, ["applied", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{m}_lost" for m in MARKS], "shapley")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of op11."""
    return audit(docs, labels)


#: The same rows by DuckDB, order by order.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
              100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
              coalesce(w.doc_id > least, false)] AS fails
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, k.i AS step, o[1 : k.i - 1] AS before, o[k.i] AS f FROM o, k),
e AS (SELECT part, good, toxic, n, filter_order, step, f, fails[f] AS fails, len(list_filter(before, lambda i: fails[i])) = 0 AS passed,
             fails[f] AND len(list_filter(fails, lambda x: x)) = 1 AS alone FROM g, s),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, f, CAST(coalesce(sum(n) FILTER (passed AND NOT fails), 0) AS BIGINT) AS kept,
             CAST(coalesce(sum(n) FILTER (passed AND fails), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (NOT passed AND fails), 0) AS BIGINT) AS redundant,
             CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n * good) FILTER (passed AND fails), 0) AS BIGINT) AS good_lost,
             CAST(coalesce(sum(n * toxic) FILTER (passed AND fails), 0) AS BIGINT) AS toxic_lost
      FROM e GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
