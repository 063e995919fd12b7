"""Line dedup: a suffix array over line ids by distributed prefix doubling, and its LCP intervals.

Lines that occur once break documents into segments of lines that occur again. Round k of prefix
doubling names every position by the pair of its own name and the name 2^k lines on, in order of
the pairs, until no two positions share a name that reaches full length; names then order the
suffixes of all segments. The longest common prefix of neighbours in that order is found from the
names of all rounds, longest first. An LCP interval is a stretch of the order whose neighbours share
at least so many lines; a position in it that isn't the first in the corpus begins a later copy. The
longest such copy at each position is found by one scan of the order in each direction with a stack
of ever earlier positions; partitions of the order are scanned at once, each starting from what the
partitions before it leave open, which is at most one entry for each length of a common prefix. What
they leave open is put together in groups of partitions, then groups of groups, and dealt back the same
way, each partition receiving its own; the driver sees none of it.

Lines covered by a later copy of at least ``LEAST_WORDS`` words are deleted. Corpus order is by id,
then by a hash of the text. A row is known by both, so texts are neither written nor numbered; of rows
alike in both one takes part, the others are later copies as a whole.

Counts by line precede all else, so a line that is everywhere is one row a task; the order is cut by
ranges of (name, position), so its positions are dealt out too.

Defined cases: ids are integers, others raise a TypeError; null texts stay null and have no lines; empty
lines count like others but have no words; null ids come last; repeated rows are later copies; a text all
of whose lines go is empty; an empty table gives no rows; other columns stay, whatever their names, and
n_lines and n_deleted replace columns of the same name. A document is one window: its lines fit one task.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, forget, word_count

LEAST_WORDS = 5
#: A row, and a position in the corpus: null ids come last, and of one id the smaller hash of the text first.
ROW = ["late", "doc", "row"]
PLACE = [*ROW, "line"]
KINDS = "late int, doc long, row long, line int"
#: Partitions of the order whose summaries are put together in one group.
TOGETHER = 256


def _named(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """rows with a long that orders them as key does, equal where it is equal, and how many share it."""
    names = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("many"))
    ordered = names.repartitionByRange(*key).sortWithinPartitions(*key).withColumn(name, F.monotonically_increasing_id())
    return rows.join(cut(ordered), key)


def segments(lines: DataFrame) -> DataFrame:
    """(place, d1, d2) of all lines to the positions of repeated ones (stretch, at, left, r0, place)."""
    repeated = lines.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    ordered = repeated.repartitionByRange("d1", "d2").sortWithinPartitions("d1", "d2").withColumn("r0", F.monotonically_increasing_id())
    kept = lines.join(cut(ordered.select("d1", "d2", "r0")), ["d1", "d2"]).drop("d1", "d2")
    kept = kept.withColumn("stretch", F.col("line") - F.row_number().over(Window.partitionBy(*ROW).orderBy("line")))
    of_seg = Window.partitionBy(*ROW, "stretch")
    kept = kept.withColumns({"at": (F.row_number().over(of_seg.orderBy("line")) - 1).cast("int"), "left": F.count(F.lit(1)).over(of_seg).cast("int")})
    return kept.withColumn("left", F.col("left") - F.col("at"))


def suffix_ranks(kept: DataFrame) -> tuple[DataFrame, int]:
    """Positions with names r0..rK, and K: no two segments share 2^K lines unless both end there."""
    kept, k = cut(kept), 0
    of_seg = Window.partitionBy(*ROW, "stretch").orderBy("at")
    while True:
        step = 1 << k
        pairs = kept.drop("open").withColumn("next", F.coalesce(F.lead(f"r{k}", step).over(of_seg), F.lit(-1)))
        last, kept = kept, cut(_named(pairs, [f"r{k}", "next"], f"r{k + 1}").withColumn("open", (F.col("many") > 1) & (F.col("left") > 2 * step)).drop("next", "many"))
        forget(last)
        k += 1
        if kept.where("open").isEmpty():
            return kept.drop("open"), k


def neighbours(ranked: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """The suffix array with t, its order, and for each t the common prefix with the one before."""
    order = [f"r{top}", *PLACE]
    array = cut(ranked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("t", F.monotonically_increasing_id()))
    part = F.shiftright("t", 33)
    seen = [*ROW, "stretch", "at", "left", *[f"r{k}" for k in range(top + 1)]]
    before = Window.partitionBy("part").orderBy("t")
    pairs = array.withColumn("part", part).select("t", "part", *seen, *[F.lag(c).over(before).alias(f"p_{c}") for c in seen])
    lasts = array.withColumn("part", part).groupBy("part").agg(F.max_by(F.struct(*seen), "t").alias("last"))
    lasts = lasts.select(F.lead("part").over(Window.orderBy("part")).alias("part"), "last")  # a row for each partition
    pairs = pairs.join(F.broadcast(lasts.where("part IS NOT NULL")), "part", "left")
    pairs = pairs.select("t", *seen, *[F.coalesce(f"p_{c}", F.when(F.col("p_row").isNull(), F.col("last")[c])).alias(f"p_{c}") for c in seen])
    # the longest name they share says at least how much; equal at the top means equal to the end
    shared = F.when(F.col(f"r{top}") == F.col(f"p_r{top}"), F.col("left"))
    for k in range(top - 1, -1, -1):
        shared = shared.when(F.col(f"r{k}") == F.col(f"p_r{k}"), F.least(F.lit(1 << k), "left", "p_left"))
    small = ["t", *ROW, "stretch", "at", "left", *[f"p_{c}" for c in ROW], "p_stretch", "p_at", "p_left"]
    level = F.greatest(*[F.when((F.col(f"r{k}") == F.col(f"p_r{k}")), k).otherwise(-1) for k in range(top + 1)], F.lit(-1))
    pairs = cut(pairs.select(*small, F.coalesce(shared, F.lit(0)).cast("int").alias("lcp"), level.alias("level")))
    done = pairs.where((F.col("level") < 1) | (F.col("level") == top)).select("t", "lcp")
    going = pairs.where((F.col("level") >= 1) & (F.col("level") < top))
    for k in range(top - 2, -1, -1):
        if going.isEmpty():
            break
        mine = ranked.select(*ROW, "stretch", F.col("at").alias("here"), F.col(f"r{k}").alias("name"))
        theirs = ranked.select(*[F.col(c).alias(f"p_{c}") for c in (*ROW, "stretch")], F.col("at").alias("p_here"), F.col(f"r{k}").alias("p_name"))
        now = going.where(F.col("level") > k).withColumns({"here": F.col("at") + F.col("lcp"), "p_here": F.col("p_at") + F.col("lcp")})
        now = now.join(mine, [*ROW, "stretch", "here"], "left").join(theirs, [*[f"p_{c}" for c in (*ROW, "stretch")], "p_here"], "left")
        more = F.when(F.col("name") == F.col("p_name"), F.least(F.lit(1 << k), F.col("left") - F.col("lcp"), F.col("p_left") - F.col("lcp"))).otherwise(0)
        now = now.withColumn("lcp", (F.col("lcp") + more).cast("int")).select(*small, "lcp", "level")
        going = cut(now.unionByName(going.where(F.col("level") <= k)))
    return array, done.union(going.select("t", "lcp"))


def _push(stack: list, place: tuple, lcp: int) -> None:
    """stack: (place, length shared with what comes next), places and lengths both rising."""
    while stack and stack[-1][0] >= place:
        stack.pop()
    stack.append((place, lcp))


def _shorten(stack: list, lcp: int) -> None:
    """From here on no entry shares more than lcp; of those that share as much the earliest place is enough."""
    first = bisect_left(stack, lcp, key=lambda e: e[1])
    if first < len(stack):
        stack[first:] = [(stack[first][0], lcp)] if lcp else []


def _longest(stack: list, place: tuple) -> int:
    """What place shares at most with an earlier one."""
    i = bisect_left(stack, place, key=lambda e: e[0])
    return stack[i - 1][1] if i else 0


_FAR = 1 << 30


def _scan(places: list, lcps: list, stack: list) -> list[int]:
    """For each place the most it shares with an earlier one before it in the order; lcps: with the one before."""
    out = []
    for place, lcp in zip(places, lcps, strict=True):
        _shorten(stack, lcp)
        out.append(_longest(stack, place))
        _push(stack, place, _FAR)
    return out


def _ordered(rows: pd.DataFrame) -> tuple[list, list]:
    rows.sort_values("t", inplace=True)
    return list(zip(*[rows[c].tolist() for c in PLACE], strict=True)), rows["lcp"].tolist()


def _summary(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one partition: what it leaves open in either direction, and the least that it shares throughout."""
    places, lcps = _ordered(rows)
    forward, backward = [], []
    _scan(places, lcps, forward)
    _scan(places[::-1], [0, *lcps[:0:-1]], backward)
    within = min(lcps[1:], default=_FAR)
    left = [("forward", *p, n) for p, n in forward] + [("backward", *p, n) for p, n in backward]
    return pd.DataFrame(left, columns=["way", *PLACE, "lcp"]).assign(part=int(rows["part"].iloc[0]), head=lcps[0], within=within)


def _meet(stack: list, least: int, left: list) -> None:
    """What is open after a partition: of what was open before it as much as it lets through, then its own."""
    _shorten(stack, least)
    while stack and stack[-1][0] >= left[0][0]:
        stack.pop()
    stack += left


def _parts_of(rows: pd.DataFrame) -> dict[int, dict]:
    """Summaries by partition, in order; their stacks by way."""
    parts: dict[int, dict] = {}
    for part, rows_of in rows.groupby("part", sort=True):
        one = parts[part] = {"head": int(rows_of["head"].iloc[0]), "within": int(rows_of["within"].iloc[0]), "forward": [], "backward": []}
        for way, *place, lcp in zip(rows_of["way"], *[rows_of[c].tolist() for c in PLACE], rows_of["lcp"].tolist(), strict=True):
            one[way].append((tuple(place), lcp))
        one["forward"].sort()
        one["backward"].sort()
    return parts


def _passed(parts: dict[int, dict], forward: list, backward: list) -> dict[int, tuple[list, list]]:
    """By partition the stacks with which its scans begin; those given are open before the first and after the last, and hold in the end what is open beyond them."""
    before, after, head = {}, {}, None
    for p, one in parts.items():
        before[p] = list(forward)
        _meet(forward, min(one["head"], one["within"]), one["forward"])
    for p, one in reversed(parts.items()):
        if head is not None:
            _shorten(backward, head)
        after[p], head = list(backward), one["head"]
        _meet(backward, one["within"], one["backward"])
    return {p: (before[p], after[p]) for p in parts}


def _stacks(part: int, stacks: dict[str, list]) -> pd.DataFrame:
    return pd.DataFrame([(part, way, *place, n) for way, stack in stacks.items() for place, n in stack], columns=["part", "way", *PLACE, "lcp"])


def _group_summary(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a group of partitions what _summary says of one."""
    parts = _parts_of(rows)
    forward, backward, ones = [], [], list(parts.values())
    _passed(parts, forward, backward)
    within = min([one["within"] for one in ones] + [one["head"] for one in ones[1:]])
    return _stacks(int(rows["group"].iloc[0]), {"forward": forward, "backward": backward}).assign(head=ones[0]["head"], within=within)


def _given(rows: pd.DataFrame) -> tuple[list, list]:
    """The stacks that a partition or group begins with."""
    ways = {way: sorted((tuple(place), lcp) for *place, lcp in zip(*[part[c].tolist() for c in (*PLACE, "lcp")], strict=True)) for way, part in rows.groupby("way")}
    return ways.get("before", []), ways.get("after", [])


def _dealt(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
    parts = _parts_of(rows)
    found = [_stacks(p, {"before": a, "after": b}) for p, (a, b) in _passed(parts, *_given(given)).items()]
    return pd.concat(found) if found else _stacks(0, {})


def opened(summaries: DataFrame, together: int = TOGETHER) -> DataFrame:
    """Summaries of partitions, written, to the stacks (part, way: before or after, place, lcp) with which their scans begin."""
    grouped = summaries.withColumn("group", F.floor(F.col("part") / together).cast("long"))
    last = summaries.agg(F.max("part")).first()[0] or 0
    kinds = f"part long, way string, {KINDS}, lcp int"
    if last < together:
        above = grouped.sparkSession.createDataFrame([], kinds)
    else:
        above = opened(cut(grouped.groupBy("group").applyInPandas(_group_summary, f"{kinds}, head int, within int")), together)
    return grouped.groupBy("group").cogroup(above.groupBy("part")).applyInPandas(_dealt, kinds)


def _copied(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
    if not len(rows):
        return rows[PLACE].assign(copied=0)
    places, lcps = _ordered(rows)
    before, after = _given(given)
    ahead = _scan(places, lcps, before)
    behind = _scan(places[::-1], [_FAR, *lcps[:0:-1]], after)[::-1]
    return rows[PLACE].assign(copied=np.maximum(ahead, behind).astype(np.int32))


def _rest(least_words: int):
    """Texts without the lines that lie within some later copy of enough words, and how many lines those are."""

    def of(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for text, spots in zip(texts, found, strict=True):
            if spots is None:
                out.append((None, 0))
                continue
            said = text.split("\n")
            words = np.cumsum([0, *[len(line.encode().split()) for line in said]])  # on bytes, ASCII blanks only
            starts = np.array([s["line"] for s in spots])
            ends = starts + [s["copied"] for s in spots]
            long = words[ends] - words[starts] >= least_words
            marks = np.zeros(len(said) + 1, np.int64)
            np.add.at(marks, starts[long], 1)
            np.add.at(marks, ends[long], -1)
            rest = [line for line, n in zip(said, marks.cumsum()[:-1], strict=True) if not n]
            out.append(("\n".join(rest), len(said) - len(rest)))
        return pd.DataFrame(out, columns=["text", "n"]).astype({"text": object, "n": np.int32})

    return of


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs as (late, doc, row, text, whole: struct of what else they hold, copy: whether another row alike in id and text stands for this one)."""
    key = [F.col(id_col).isNull().cast("int").alias("late"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc"), F.xxhash64(text_col).alias("row")]
    again = cut(docs.select(*key).groupBy(*ROW).agg(F.count(F.lit(1)).alias("many")).where("many > 1").select(*ROW))
    every = docs.select(*key, F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("whole"))
    if again.isEmpty():
        return every.withColumn("copy", F.lit(False))
    some = cut(every.join(again, ROW).withColumn("n", F.monotonically_increasing_id()))
    first = some.groupBy(*ROW).agg(F.min("n").alias("n")).select("n", F.lit(False).alias("other"))
    some = some.join(first, "n", "left").select(*ROW, "text", "whole", F.coalesce("other", F.lit(True)).alias("copy"))
    return every.join(again, ROW, "left_anti").withColumn("copy", F.lit(False)).unionByName(some)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, together: int = TOGETHER) -> DataFrame:
    """docs with later copies of runs of lines cut from their texts, n_lines (int) and n_deleted (int)."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be integers")
    docs = docs.drop("n_lines", "n_deleted")
    marked = _marked(docs, id_col, text_col)
    lines = marked.where("NOT copy").select(*ROW, F.posexplode(F.split("text", "\n")).alias("line", "said"))
    hashes = [F.xxhash64("said").alias("d1"), F.xxhash64(F.lit(1), "said").alias("d2")]  # 128 bits name a line
    ranked, top = suffix_ranks(segments(lines.select(*PLACE, *hashes)))
    array, shared = neighbours(ranked, top)
    ordered = cut(array.select("t", F.shiftright("t", 33).alias("part"), *PLACE).join(shared, "t"))
    summaries = cut(ordered.groupBy("part").applyInPandas(_summary, f"way string, {KINDS}, lcp int, part long, head int, within int"))
    copies = ordered.groupBy("part").cogroup(opened(summaries, together).groupBy("part")).applyInPandas(_copied, f"{KINDS}, copied int")
    spots = copies.where("copied > 0").groupBy(*ROW).agg(F.collect_list(F.struct("line", "copied")).alias("spots"))  # of one document

    text = F.col("text")
    out = marked.join(spots, ROW, "left")
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")
    # the words of a copy are counted where the text is; texts without one don't go to Python
    has = F.col("spots").isNotNull() & ~F.col("copy")
    out = out.withColumn("rest", F.pandas_udf(_rest(least_words), "text string, n int")(F.when(has, text), F.when(has, F.col("spots"))))
    whole = F.col("copy") & text.isNotNull() & (word_count(text) >= least_words)
    # alike but too short to go: as the row that stands for it
    left = F.when(whole, "").when(has, F.col("rest.text")).otherwise(text)
    n_deleted = F.when(whole, n_lines).when(has, F.col("rest.n")).otherwise(0).cast("int")
    columns = [left.alias(c) if c == text_col else F.col(f"whole.`{c}`") for c in docs.columns]
    return out.select(*columns, n_lines.alias("n_lines"), n_deleted.alias("n_deleted"))


def digest(docs: DataFrame) -> DataFrame:
    """The rows of op10."""
    return deduplicated(docs.select("doc_id", "text"))
