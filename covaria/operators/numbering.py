"""Numbers in order within a group, for groups that no single task should sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a stretch, about, and stretches at most.
STRETCH, MOST = 1 << 16, 1 << 12


def by_value(rows: DataFrame, column: str) -> tuple[int, Column | None]:
    """How many stretches a table is cut into, and that of an integer column's value: of equal width between its least and its largest; None where one is enough."""
    n, least, most = rows.agg(F.count(F.lit(1)), F.min(column), F.max(column)).first()
    n = max(1, min(MOST, math.ceil(n / STRETCH)))
    if n == 1 or least is None:
        return n, None
    width = -(-(most - least + 1) // n)
    return n, F.floor((F.col(column) - F.lit(least)) / F.lit(width)).cast("int")


def by_hash(column: str, n: int) -> Column | None:
    """The stretch of a hexadecimal digest in order: n of equal width."""
    if n == 1:
        return None
    return F.floor(F.conv(F.substring(column, 1, 8), 16, 10).cast("long") * n / 4294967296).cast("int")


def numbered(rows: DataFrame, group: list[str], order: list[str], stretch: Column | None, name: str = "place", first: int = 0) -> DataFrame:
    """rows with their number in the order of their group, from first on.

    stretch, which must not fall along the order, cuts a group into parts that are sorted apart, each
    in a task of its own; a part's numbers begin after those of the parts before, whose sizes are
    a row each. Neither depends on how rows are partitioned. Without one a group is a single part.
    """
    if stretch is None:
        return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1 + first).cast("long"))
    rows = rows.withColumn("_stretch", stretch)
    part = [*group, "_stretch"]
    sizes = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*part, F.coalesce(ahead, F.lit(0)).alias("_start"))  # at most MOST rows a group
    within = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return rows.withColumn("_within", within).join(starts, part).withColumn(name, (F.col("_start") + F.col("_within") - 1 + first).cast("long")).drop("_stretch", "_within", "_start")
