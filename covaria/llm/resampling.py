"""Target-distribution importance resampling: documents drawn by how much likelier a target makes their words.

Features are words and pairs of neighbours, hashed to ``BUCKETS`` buckets by CRC-32. Tasks count the
buckets of their rows into one array, Spark adds the arrays; what the target's share of a bucket gains
over the corpus's becomes an array of integers, by which every document is scored where it is read. The mean gain
and a Gumbel variable drawn from a hash of the id make a score whose largest values are a draw without
replacement, weighted by the exponential of the gain.

Which rows are drawn is decided by a radix selection on (score, id, row): histograms of one digit
after another, each only of the rows that share all digits before with the last row drawn, until a
digit's boundary is that of the draw. A histogram has at most ``1 << DIGIT`` rows. Only rows that are
drawn are sorted, by range, and numbered by their range's start and their place in it.

CRC-32 of a pair comes from those of its words: appending n bytes is linear in the bits of what is
before, so a table for each n moves the first word's value on, and no pair is ever spelled out.

Defined cases: null and empty texts have no words, no features and weight 0; a null id is hashed as empty
text and comes last among ties; ids are integers, others raise TypeError; rows of one id are each scored and drawn, ties
between them go to the row first written; a corpus or target without features gives gains from smoothing alone; an
empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Bits of a digit.
DIGIT = 14
#: Words longer than this are hashed by themselves, with what is before them.
LONG = 255
#: Words whose features are in memory at once.
AT_ONCE = 1 << 16
#: Capitals become small letters, ASCII characters but letters and digits blanks.
_SMALL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SMALL).split()


def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """For n up to LONG + 1: what n more bytes make of each byte of a CRC-32, (n, byte, value); and the CRC-32 of a blank moved on by n."""
    poly = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        poly = np.where(poly & 1, (poly >> 1) ^ np.uint32(0xEDB88320), poly >> 1)
    moved = [np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
    blank = [np.uint32(zlib.crc32(b" "))]
    for _ in range(LONG + 1):
        moved.append((moved[-1] >> 8) ^ poly[moved[-1] & 255])
        blank.append((blank[-1] >> 8) ^ poly[blank[-1] & 255])
    return np.array(moved), np.array(blank)


MOVED, BLANK = _shifts()


def buckets(words: list[bytes]) -> np.ndarray:
    """The bucket of each word, then that of each pair of neighbours."""
    if not words:
        return np.empty(0, np.int64)
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n, first = np.minimum(sizes[1:], LONG), own[:-1]
    pairs = own[1:] ^ BLANK[n]
    for byte in range(4):
        pairs ^= MOVED[n + 1, byte, (first >> np.uint32(8 * byte)) & np.uint32(255)]
    for i in np.nonzero(sizes[1:] > LONG)[0]:
        pairs[i] = zlib.crc32(words[i + 1], zlib.crc32(b" ", int(own[i])))
    return np.concatenate([own, pairs]).astype(np.int64) % BUCKETS


def _pieces(words: list[bytes]):
    """The buckets of a document, of at most AT_ONCE words at a time."""
    for at in range(0, len(words), AT_ONCE):
        found = buckets(words[at : at + AT_ONCE + 1])
        n = min(AT_ONCE, len(words) - at)
        more = at + AT_ONCE < len(words)  # one word beyond, for the last pair
        yield np.delete(found, n) if more else found


def _counted(batches):
    counts = np.zeros(BUCKETS, np.int64)
    for rows in batches:
        for text in rows["text"]:
            for found in _pieces(words_of(text)):
                counts += np.bincount(found, minlength=BUCKETS)
    at = np.nonzero(counts)[0]
    yield pd.DataFrame({"bucket": at, "n": counts[at]})


def counts(texts: DataFrame) -> np.ndarray:
    """Features by bucket, of all rows of (text)."""
    rows = texts.select("text").mapInPandas(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target to that in the corpus, rounded down."""
    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(shared):
    def of(texts: pd.Series) -> pd.DataFrame:
        gain, out = shared.value, []
        for text in texts:
            words, total = words_of(text), 0
            for found in _pieces(words):
                total += int(gain[found].sum())
            n = max(0, 2 * len(words) - 1)
            out.append((len(words), n, total // n if n else 0))
        return pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    return F.pandas_udf(of, "n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variable that the id decides, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _boundary(rows: DataFrame, key: Column, live: Column, wanted: int, falling: bool) -> tuple[int, int, bool]:
    """Of the live rows in order of key (long): the value of the last one wanted, how many rows of that value are wanted, and whether none need be told apart further.

    One histogram a digit, from the highest in which live rows differ. Where all rows that share the
    digits so far are wanted, the last value that has these digits bounds them as well.
    """
    least, most = rows.where(live).agg(F.min(key), F.max(key)).first()
    place = (F.lit(most) - key) if falling else (key - F.lit(least))
    at = lambda low: most - low if falling else least + low
    n_digits, low = -(-int(most - least).bit_length() // DIGIT), 0
    for shift in range((n_digits - 1) * DIGIT, -1, -DIGIT):
        here = live & place.between(low, low + (1 << (shift + DIGIT)) - 1)
        found = rows.where(here).groupBy(F.shiftright(place - F.lit(low), shift).alias("digit")).count().collect()
        for digit, n in sorted((r["digit"], r["count"]) for r in found):  # 1 << DIGIT at most
            if n >= wanted:
                low += digit << shift
                break
            wanted -= n
        if n == wanted:
            return at(min(low + (1 << shift) - 1, most - least)), wanted, True
    return at(low), wanted, not n_digits and rows.where(live).count() == wanted


def chosen(rows: DataFrame, wanted: int) -> Column:
    """Which of the eligible rows of (eligible, score, id, row) are the wanted ones: of the highest scores, ties to smaller ids, null last, then to smaller rows.

    There must be as many; the numbers in row differ.
    """
    if wanted <= 0:
        return F.lit(False)
    number = F.coalesce("id", F.lit(0))
    # an id in two keys, so that differences of 64 bits don't overflow
    keys = [(F.col("score"), True), (F.col("id").isNull().cast("long"), False), (F.shiftright(number, 1), False), (number.bitwiseAND(1), False), (F.col("row"), False)]
    before, live = F.lit(False), F.col("eligible")
    for key, falling in keys:
        edge, wanted, every = _boundary(rows, key, live, wanted, falling)
        beyond = key > edge if falling else key < edge
        if every:
            return before | (live & (beyond | (key == edge)))
        before, live = before | (live & beyond), live & (key == edge)
    raise ValueError("fewer rows than wanted")


def ranked(drawn: DataFrame) -> DataFrame:
    """Rows of (score, id, row, ...) with rank, from 1: sorted by range, and numbered by their range's start and their place in it."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    placed = cut(drawn.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("t", F.monotonically_increasing_id()))
    part = F.shiftright("t", 33).alias("part")
    sizes = sorted((r.part, r["count"]) for r in placed.groupBy(part).count().collect())  # a row for each partition
    starts, before = {}, 0
    for p, n in sizes:
        starts[p], before = before, before + n
    if not starts:
        return placed.select("*", F.lit(None).cast("long").alias("rank")).drop("t")
    start = F.broadcast(drawn.sparkSession.createDataFrame(list(starts.items()), "part int, start long"))
    found = placed.withColumn("part", part.cast("int")).join(start, "part")
    return found.withColumn("rank", F.col("start") + F.col("t").bitwiseAND((1 << 33) - 1) + 1).drop("part", "start", "t")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The id of each document with n_features, weight, score and rank (all long; rank null where not drawn).

    percent of the documents with at least least_words words are drawn, rounded down.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    text = F.col(text_col).alias("text")
    gain = gains(counts(docs.select(text)), counts(target.select(text)))
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers
    weighed = docs.select(F.col(id_col).cast("long").alias("id"), _weighed(shared)(text).alias("w"))
    rows = weighed.select("id", (F.col("w.n_words") >= least_words).alias("eligible"), "w.n_features", "w.weight", (F.col("w.weight") + gumbel(F.col("id"), seed)).alias("score"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    n = rows.where("eligible").count()
    drawn = chosen(rows, percent * n // 100)
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    rest = rows.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked(rows.where(drawn)).select(*columns, "rank").unionByName(rest)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of op12."""
    return resampled(docs, benchmark)
