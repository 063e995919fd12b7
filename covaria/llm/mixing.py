"""Mixing sources to target weights by systematic sampling.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share out all words; a source
gives at most ``MOST`` times what it has, and what it can't give is shared again by weight. Within
a source every document expects target / size copies. The documents stand in order of size, the
expected copies are summed up along that order, one random offset is added, and a document is taken
once for each integer that its step of the running sum crosses. As neighbours in that order are of
nearly equal size, the words taken miss the target by less than about the largest document of the source.

A document of more than ``LARGE`` of its source's target would make that miss a large one, so the ``MANY``
largest of these are left out of the draw: in order of size, each is taken its expected copies rounded down or up,
whichever keeps what is taken so far nearer to what is due. What they leave of the target is drawn from the rest.

The running sum is a multiple of the document's position, so all that has to be summed are row
counts: by source, size class and spread, a small table; no task ever sorts a whole source. Rows alike
in every column are one row with a number, and take their places one after another.

Defined cases: a null text has size 0; sources of size 0 have target 0 and give nothing; null
source is a source of its own; null ids, repeated rows and ties are counted row by row (which of
several equal rows is taken is open, how many is not); an empty table gives an empty result; all
columns stay, whatever their names, but those that the columns added replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, row_key, rows_with, word_count

MOST = 3
SEED = "mix-1"
#: The share of its source's target from which on a document isn't drawn but rounded, and how many of a source at most.
LARGE, MANY = 0.02, 256


def _class_of(size: Column) -> Column:
    """Size classes in order: the number of bits, then the three bits after the first."""
    bits = F.length(F.bin(size)).cast("int")
    return (bits * 8 + F.when(bits > 3, F.shiftright(size, 0) / F.pow(F.lit(2.0), bits - 4) - 8).otherwise(size)).cast("int")


def targets(totals: DataFrame) -> DataFrame:
    """(source, source_size) to the words each source shall give, as ``target``, and its ``offset``.

    The reshared excess settles at a level: a source gets level * weight, or all it may give where
    that is less. In order of MOST * size / weight, the first source whose own level (what is left
    to share over the weights left) doesn't exceed its ratio sets the level of all.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rated = totals.select("source", "source_size", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).alias("weight"))
    rated = rated.withColumn("ratio", F.col("source_size") * MOST / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * MOST).over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rated = rated.withColumn("own", left / weights)
    rated = rated.withColumn("level", F.coalesce(F.min(F.when(F.col("own") <= F.col("ratio"), F.struct("ratio", "own"))).over(every)["own"], F.lit(0.0)))
    target = F.least(F.col("level") * F.col("weight"), (F.col("source_size") * MOST).cast("double"))
    digits = F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("source"), F.lit("")))), 1, 8)
    return rated.select("source", "source_size", target.alias("target"), (F.conv(digits, 16, 10).cast("long") / F.lit(4294967296.0)).alias("offset"))


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _rounded(kinds: DataFrame, wanted: DataFrame) -> DataFrame:
    """(src, large): of each source that has any, its largest kinds, the largest first, with copies: what all rows of the kind together are taken."""
    big = kinds.join(wanted.select("src", "target", "share"), "src").where(F.col("size") > F.col("target") * LARGE)
    by_size = Window.partitionBy("src").orderBy(F.col("size").desc(), "tie", "k1", "k2")
    big = big.withColumn("nth", F.row_number().over(by_size)).where(F.col("nth") <= MANY)  # so much a source
    columns = ["nth", "k1", "k2", "id", "source", "size", "many", "tie"]
    listed = big.groupBy("src", "share").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))

    def step(state: Column, row: Column) -> Column:
        due = row["many"] * F.col("share")
        over = lambda copies: state["over"] + row["size"] * (copies - due)
        copies = F.when(F.abs(over(F.floor(due))) <= F.abs(over(F.ceil(due))), F.floor(due)).otherwise(F.ceil(due))
        return F.struct(over(copies).alias("over"), F.concat(state["copies"], F.array(copies)).alias("copies"))

    start = F.struct(F.lit(0.0).alias("over"), F.array().cast("array<bigint>").alias("copies"))
    copies = F.aggregate("rows", start, step)["copies"]
    return listed.select("src", F.zip_with("rows", copies, lambda r, c: r.withField("copies", c)).alias("large"))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows (k1, k2, id, source, size), written, to kinds of rows, with many (rows of the kind), at (the places before it), share and offset, source_size and target."""
    tie = F.coalesce(F.md5(F.col("id").cast("string")), F.lit(""))
    part = ["src", "cls", "spread"]
    kinds = rows.groupBy("k1", "k2", "id", "source", "size").agg(F.count(F.lit(1)).alias("many"))
    # rows without an id are spread by what else they hold
    spread = F.when(F.col("id").isNull(), F.lpad(F.lower(F.hex(F.col("k1").bitwiseAND(F.lit(255)))), 2, "0")).otherwise(F.substring(tie, 1, 2))
    kinds = cut(kinds.withColumns({"src": _source_key(F.col("source")), "cls": _class_of(F.col("size")), "spread": spread, "tie": tie}))
    wanted = targets(kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).cast("long").alias("source_size")))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = cut(wanted.withColumns({"src": _source_key(F.col("source")), "share": share}).drop("source"))
    wanted = cut(wanted.join(_rounded(kinds, wanted), "src", "left"))
    # what the rest shall give, and where it begins in the order of size
    words = lambda what: F.coalesce(F.aggregate("large", F.lit(0).cast("long"), lambda s, r: s + r["size"] * what(r)), F.lit(0))
    left, size_left = F.col("target") - words(lambda r: r["copies"]), F.col("source_size") - words(lambda r: r["many"])
    rest_share = F.when(F.col("large").isNull(), F.col("share")).when(size_left > 0, F.least(F.greatest(left / size_left, F.lit(0.0)), F.lit(float(MOST)))).otherwise(F.col("share"))
    key = lambda r: F.struct(-r["size"], r["tie"], r["k1"], r["k2"])
    rest = wanted.select("src", rest_share.alias("share"), "offset", "source_size", "target", key(F.element_at("large", -1)).alias("last"))
    drawn = kinds.join(rest.select("src", "last"), "src")
    drawn = drawn.where(F.col("last.col1").isNull() | (F.struct(-F.col("size"), "tie", "k1", "k2") > F.col("last"))).drop("last")
    counts = cut(drawn.groupBy(*part).agg(F.sum("many").alias("rows")))
    # what comes before a part: classes of its source first, then spreads of its class; each a small table with a fixed largest number of rows a source
    classes = counts.groupBy("src", "cls").agg(F.sum("rows").alias("n"))
    to_class = Window.partitionBy("src").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    to_spread = Window.partitionBy("src", "cls").orderBy("spread").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("src", "cls", F.coalesce(F.sum("n").over(to_class), F.lit(0)).alias("in_source"))
    parts = counts.select(*part, F.coalesce(F.sum("rows").over(to_spread), F.lit(0)).alias("in_class"))
    parts = parts.join(classes, ["src", "cls"]).join(rest.drop("last"), "src")
    found = ["share", "offset", "source_size", "target"]
    parts = parts.select(*part, (F.col("in_source") + F.col("in_class")).alias("before"), *found)
    within = Window.partitionBy(*part).orderBy("size", "tie", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("many").over(within), F.lit(0))
    columns = ["k1", "k2", "id", "source", "size", "many"]
    drawn = drawn.withColumn("ahead", ahead).join(parts, part).select(*columns, (F.col("before") + F.col("ahead")).alias("at"), *found)
    # a rounded kind's copies are dealt evenly to its rows
    rounded = wanted.where("large IS NOT NULL").select(F.inline("large"), "source_size", "target")
    rounded = rounded.select(*columns, F.lit(0).cast("long").alias("at"), (F.col("copies") / F.col("many")).alias("share"), F.lit(0.5).alias("offset"), "source_size", "target")
    return drawn.unionByName(rounded)


def _crossed(first, last) -> Column:
    """Integers crossed from the place after first to last."""
    total = lambda place: F.floor(place * F.col("share") + F.col("offset"))
    return (total(last) - total(first)).cast("long")


def _one_by_one(kinds: DataFrame) -> DataFrame:
    """A row for each row of a kind, with copies."""
    each = kinds.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many"))))
    return each.withColumn("copies", _crossed(F.col("at") + F.col("nth") - 1, F.col("at") + F.col("nth")))


def _narrow(docs: DataFrame, id_col: str, source_col: str, size: Column) -> DataFrame:
    return cut(docs.select(*row_key(docs), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size") -> DataFrame:
    """docs with source_size (long), target (double) and copies (long: how often the mix takes it)."""
    docs = docs.drop("source_size", "target", "copies")
    kinds = _placed(_narrow(docs, id_col, source_col, F.col(size_col)))
    kinds = kinds.select("k1", "k2", "many", F.struct("many", "at", "share", "offset", "source_size", "target").alias("found"))
    rows = rows_with(docs, cut(kinds), "found").select("doc", "found.*")
    return _one_by_one(rows).select("doc.*", "source_size", "target", "copies")


def taken(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix: each of docs as often as it is taken, sized by the words of its text; words are counted once, and texts move once."""
    kinds = _placed(_narrow(docs, id_col, source_col, word_count(F.col(text_col))))
    kinds = cut(kinds.select("k1", "k2", "many", _crossed(F.col("at"), F.col("at") + F.col("many")).alias("copies")).where("copies > 0"))
    rows = rows_with(docs, kinds, "copies")
    return rows.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of op7."""
    narrow = docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size"))
    rows = cut(narrow).select("*", *row_key(narrow))  # kinds of rows are those alike in these three
    return _one_by_one(_placed(rows)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same rows by DuckDB.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                  coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS tie FROM documents),
k AS (SELECT *, length(bin(size)) * 8 + CASE WHEN length(bin(size)) > 3 THEN (size >> (length(bin(size)) - 4)) - 8 ELSE size END AS cls FROM d),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM t),
r AS (SELECT *, source_size * {MOST} / weight AS ratio FROM w),
o AS (SELECT *, ((SELECT sum(source_size) FROM t) - coalesce(sum(source_size * {MOST}) OVER b, 0))
              / ((SELECT sum(weight) FROM r) - coalesce(sum(weight) OVER b, 0)) AS own
      FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size,
             least(coalesce((SELECT own FROM o WHERE own <= ratio ORDER BY ratio, own LIMIT 1), 0.0) * weight, CAST(source_size * {MOST} AS DOUBLE)) AS target,
             CAST('0x' || substr(md5('{SEED}' || coalesce(source, '')), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM o),
h AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS share FROM g),
b AS (SELECT k.doc_id, k.source, k.size, h.share, row_number() OVER (PARTITION BY k.source ORDER BY k.size DESC, tie) AS nth
      FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source WHERE k.size > h.target * {LARGE} QUALIFY nth <= {MANY}),
z AS (SELECT b.*, CAST(0.0 AS DOUBLE) AS over_, CAST(0 AS BIGINT) AS copies FROM b WHERE false
      UNION ALL SELECT doc_id, source, size, share, nth, size * (c - share), c FROM (SELECT *, CAST(CASE WHEN abs(size * (floor(share) - share)) <= abs(size * (ceil(share) - share)) THEN floor(share) ELSE ceil(share) END AS BIGINT) AS c FROM b WHERE nth = 1)
      UNION ALL SELECT doc_id, source, size, share, nth, o + size * (c - share), c FROM (
        SELECT b.*, z.over_ AS o, CAST(CASE WHEN abs(z.over_ + b.size * (floor(b.share) - b.share)) <= abs(z.over_ + b.size * (ceil(b.share) - b.share)) THEN floor(b.share) ELSE ceil(b.share) END AS BIGINT) AS c
        FROM z JOIN b ON z.source IS NOT DISTINCT FROM b.source AND b.nth = z.nth + 1)),
y AS (SELECT source, sum(size) AS words, sum(size * copies) AS given FROM z GROUP BY source),
x AS (SELECT h.*, CASE WHEN y.words IS NULL OR source_size = y.words THEN share ELSE least(greatest((target - y.given) / (source_size - y.words), 0.0), {float(MOST)}) END AS rest
      FROM h LEFT JOIN y ON h.source IS NOT DISTINCT FROM y.source),
n AS (SELECT k.*, row_number() OVER (PARTITION BY source ORDER BY cls, substr(tie, 1, 2), size, tie) AS place FROM k WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.doc_id = k.doc_id))
SELECT doc_id, size, source_size, target, size * CAST(floor(place * rest + u) - floor((place - 1) * rest + u) AS BIGINT) AS taken FROM n JOIN x ON n.source IS NOT DISTINCT FROM x.source
UNION ALL SELECT doc_id, size, source_size, target, size * copies FROM z JOIN x ON z.source IS NOT DISTINCT FROM x.source
"""
