"""The k largest rows of a table by exact selection: histograms decide, nothing is sorted as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a histogram, and rows that one task may sort.
BINS, SMALL = 4096, 100_000


def _edge(rows: DataFrame, key: str, wanted: int, bins: int, small: int) -> tuple[Column, Column, int, bool]:
    """(surely among the wanted, still open, how many of the open are wanted, whether those are too many of one key), with the rows of the largest keys wanted.

    A histogram's bin of the last wanted row is cut into bins again, between its least and its largest
    key, until it holds few rows or one key. A histogram comes to the driver as a row for each bin.
    """
    sure, live = F.lit(False), F.lit(True)
    while True:
        n, least, most = rows.where(live).agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
        few = n <= small or n <= wanted
        if few or least == most:
            return sure, live, wanted, not few
        at = F.least(F.lit(bins - 1), F.floor((F.col(key) - F.lit(least)) / F.lit(most - least) * bins))
        counted = rows.where(live).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least"), F.max(key).alias("most")).collect()
        for b in sorted(counted, key=lambda r: -r.bin):
            if b.n >= wanted:
                break
            wanted -= b.n
        sure = sure | (live & (F.col(key) > b.most))
        live = live & (F.col(key) >= b.least) & (F.col(key) <= b.most)


def largest(rows: DataFrame, value: str, tie: str, keep: int, bins: int = BINS, small: int = SMALL) -> DataFrame:
    """The keep rows of the largest values, of equal ones those with the smallest tie (an integer that no two rows share).

    So few that a task may sort them are taken by a sort of each partition. Else rows are read once for each histogram. Values that are null or NaN are never among them.
    """
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    if keep <= 0:
        return rows.limit(0)
    if keep <= small:
        return rows.orderBy(F.desc(value), tie).limit(keep)
    rows = rows.withColumn("_last", -F.col(tie).cast("long"))
    sure, live, wanted, tied = _edge(rows, value, keep, bins, small)
    found, rows = rows.where(sure), rows.where(live)
    if tied:
        sure, live, wanted, _ = _edge(rows, "_last", wanted, bins, small)
        found, rows = found.unionByName(rows.where(sure)), rows.where(live)
    return found.unionByName(rows.orderBy(F.desc(value), F.desc("_last")).limit(wanted)).drop("_last")
