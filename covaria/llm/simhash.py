"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits. Two that differ in at most three bits differ in at most one bit of one
half. Each half's lower 31 bits are covered by the perfect Hamming code of that length: every word
is within one bit of exactly one code word, its home anchor. A fingerprint is replicated to every
anchor within covering radius plus threshold (1 + 1), of which there are at most 16 in a half, so
two fingerprints that differ in one bit of a half meet at the home anchor of either. Fingerprints
are compared per anchor, all 64 bits, and linked at three or fewer differing bits.

Texts with one fingerprint are one row from the start, so a group of copies costs one comparison.
Anchors with many homes are dealt out in blocks of homes against blocks of visitors; a block keeps
a spanning forest of its links instead of all of them.

Defined cases: null and empty texts and texts of blanks have fingerprint zero and link with each
other; a text of one or two words is one shingle; null ids take part in no component (component_id
null where a group has no other id); repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, rows_with
from .components import components

THRESHOLD = 3
SHINGLE = 3
#: Homes of an anchor from which on its comparisons are dealt out, and rows of a block.
MANY, BLOCK = 64, 1024


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # on bytes, both touch ASCII only
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[s:e], 42) for s, e in zip(starts[at : at + 8192], stops[at : at + 8192], strict=True)), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")


def fingerprint(text: Column) -> Column:
    return F.pandas_udf(_fingerprints, "long")(text)


def _syndrome(word: Column) -> Column:
    """Of the Hamming code: 0 for a code word, else the place of the bit to turn."""
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]
    return sum((F.bit_count(word.bitwiseAND(F.lit(m))) % 2 * (1 << j) for j, m in enumerate(masks)), F.lit(0))


def _bit(place: Column) -> Column:
    """The bit of a place from 1, none for place 0."""
    return F.when(place > 0, F.expr("1L") * F.pow(F.lit(2.0), place - 1).cast("long")).otherwise(F.lit(0).cast("long"))


def _anchored(prints: DataFrame) -> DataFrame:
    """(fp) to (half, word, syn): both halves' lower 31 bits."""
    low = F.lit(0x7FFFFFFF).cast("long")
    halves = F.array(F.struct(F.lit(0).alias("half"), F.col("fp").bitwiseAND(low).alias("word")), F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", 32).bitwiseAND(low).alias("word")))
    return prints.select("fp", F.inline(halves)).withColumn("syn", _syndrome(F.col("word")))


def _homes(anchored: DataFrame) -> DataFrame:
    return anchored.select("half", F.col("word").bitwiseXOR(_bit(F.col("syn"))).alias("anchor"), "fp")


def _visits(anchored: DataFrame) -> DataFrame:
    """Every anchor within two bits: the home, and where the home is one bit away, 15 others."""
    others = F.expr("filter(transform(sequence(1, 31), p -> named_struct('p', p, 'q', p ^ syn)), x -> syn > 0 AND x.p < x.q)")
    turned = F.transform(others, lambda x: F.col("word").bitwiseXOR(_bit(x["p"])).bitwiseXOR(_bit(x["q"])))
    home = F.array(F.col("word").bitwiseXOR(_bit(F.col("syn"))))
    return anchored.select("half", F.explode(F.concat(home, turned)).alias("anchor"), "fp")


def _forest_of(rows: pd.DataFrame) -> pd.DataFrame:
    """Links within threshold between a block's homes and visitors, as a spanning forest."""
    homes = rows.loc[rows["is_home"], "fp"].to_numpy(np.int64)
    others = rows.loc[~rows["is_home"], "fp"].to_numpy(np.int64)
    names, at = np.unique(np.concatenate([homes, others]), return_inverse=True)
    label, h, v = np.arange(len(names)), at[: len(homes)], at[len(homes) :]
    for i in range(0, len(homes), 256):
        x, y = np.nonzero(np.bitwise_count(homes[i : i + 256, None].view(np.uint64) ^ others[None, :].view(np.uint64)) <= THRESHOLD)
        a, b = h[i + x], v[y]
        while (label[a] != label[b]).any():
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], least)
            np.minimum.at(label, label[b], least)
            label = label[label]
    tied = np.nonzero(label != np.arange(len(names)))[0]
    return pd.DataFrame({"a": names[label[tied]], "b": names[tied]})


def links(prints: DataFrame, many: int = MANY, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp) to pairs (a, b) that connect whatever links connect."""
    anchored = cut(_anchored(prints))
    homes, visits = _homes(anchored), _visits(anchored)
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= THRESHOLD) & (F.col("fp") < F.col("other"))
    sizes = homes.groupBy("half", "anchor").agg(F.count(F.lit(1)).alias("n"))
    crowded = cut(sizes.where(F.col("n") > many))
    plain = homes.join(crowded, ["half", "anchor"], "left_anti").join(visits.withColumnRenamed("fp", "other"), ["half", "anchor"]).where(near)
    plain = plain.select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if crowded.isEmpty():
        return plain
    # either side is dealt by its own number
    blocks_of = lambda n: (F.floor(F.col(n) / block) + 1).cast("int")
    seen = visits.join(crowded, ["half", "anchor"]).groupBy("half", "anchor").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("visitors"))
    crowded = cut(seen.select("half", "anchor", blocks_of("n").alias("n_hb"), blocks_of("visitors").alias("n_vb")))

    def dealt(rows: DataFrame, own: str, opposite: str) -> DataFrame:
        spread = F.pmod(F.xxhash64("fp"), F.col(f"n_{own}")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"n_{opposite}") - 1))
        return rows.join(crowded, ["half", "anchor"]).select("half", "anchor", "fp", spread.alias(own), every.alias(opposite))

    at_home = dealt(homes, "hb", "vb").withColumn("is_home", F.lit(True))
    visiting = dealt(visits, "vb", "hb").withColumn("is_home", F.lit(False))
    blocks = at_home.unionByName(visiting).groupBy("half", "anchor", "hb", "vb")
    return plain.union(blocks.applyInPandas(_forest_of, "a long, b long"))


def _classes(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints with least, something to order them by, to (fp, least: that of their component)."""
    joined = components(links(prints.select("fp")))
    least = joined.join(prints, joined.node == prints.fp).groupBy("component").agg(F.min("least").alias("reached"))
    moved = joined.join(least, "component").select(F.col("node").alias("fp"), "reached")
    return prints.join(moved, "fp", "left").select("fp", F.coalesce("reached", "least").alias("least"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", fp_col: str = "fp") -> DataFrame:
    """(id, fp) with component_id: the smallest id that links reach, the document's own included."""
    prints = cut(docs.groupBy(fp_col).agg(F.min(id_col).alias("least")).withColumnRenamed(fp_col, "fp"))
    # written, so that the join below has an exchange of its own on either side and Spark can split a fingerprint that many documents have
    classes = cut(_classes(prints).select(F.col("fp").alias(fp_col), F.col("least").alias("component_id")))
    return docs.drop("component_id").join(classes, fp_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with exactly one row of each component: that of the smallest id, null last.

    Of several rows with that id the one with the smaller hash of all its columns stays; of rows alike
    in every column, one. Columns stay as they are.
    """
    prints = cut(docs.select(fingerprint(F.col(text_col)).alias("fp"), F.col(id_col).isNull().alias("late"), F.col(id_col).alias("id"), *row_key(docs)))
    rows = prints.groupBy("fp", "late", "id", "k1", "k2").agg(F.count(F.lit(1)).alias("many"))
    first = cut(rows.groupBy("fp").agg(F.min(F.struct("late", "id", "k1", "k2", "many")).alias("least")))
    kept = cut(_classes(first).select("least").distinct().select("least.k1", "least.k2", "least.many"))
    return rows_with(docs, kept, "many").select("doc.*")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of op5."""
    prints = cut(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")))
    return near_duplicates(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
