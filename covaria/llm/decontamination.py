"""Benchmark decontamination: SimHash of item-sized windows, multi-index lookup, exact verification.

An item of n words is sought in every window of n words that shares a shingle of five words with it
(others have similarity 0; a shorter text is one window). A window's SimHash over 64 bits is looked
up in eight tables, one for each byte, from its value to the items that have it: fingerprints that
differ in at most ``RADIUS`` = 23 bits differ in at most two bits of one byte, so the entries of all
values within two bits of a window's give every item within the radius; others are never looked at. At similarity 0.8 the expected difference is below
10 bits of 64, so the radius is more than 4.5 standard deviations away. What is found is verified
by weighted Jaccard similarity of shingles, each weighted by how often it occurs.

The index of the benchmark is sent to all executors only in parts of about ``MAX_BYTES`` of text. Where
there are several, each is made, sent, used and dropped before the next is made, and documents are read
once for each. They are matched where they are read, without a shuffle, so a passage that many documents
hold costs each of them the same.

Item ids may be of any type and null; they are returned as they are.

Defined cases: null, empty and blank texts match nothing, on either side; items of fewer than five
words are one shingle; equal items are each reported; of several windows the most similar, then the
first, is reported; null ids and repeated rows are reported like others; empty tables give no rows;
other columns stay out of the matching.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key

SHINGLE, LEAST = 5, 0.8
RADIUS, BYTES, NEAR = 23, 8, 2
MAX_BYTES = 16 << 20
#: Windows times items that are looked up at once.
AT_ONCE = 1 << 21
#: For each byte those within NEAR bits of it.
BALL = [np.nonzero(np.bitwise_count(np.arange(256, dtype=np.uint8) ^ np.uint8(v)) <= NEAR)[0] for v in range(256)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], k: int) -> list[bytes]:
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def _bits(found: list[bytes]) -> np.ndarray:
    """A row of 64 signs for each shingle."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(s) for s in found), "<u8", len(found))
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits((sums > 0).astype(np.uint8), axis=1, bitorder="little")


class Items:
    """Items of one length: their bags, fingerprints, and by byte and value the items that have it."""

    def __init__(self, bags: list[Counter], prints: np.ndarray, ids: list[list[int]]):
        self.bags, self.prints, self.ids = bags, prints, ids
        self.tables = [[np.nonzero(prints[:, byte] == v)[0] for v in range(256)] for byte in range(BYTES)]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of the fingerprints and items within the radius of each other."""
        pairs = [np.empty(0, np.int64)]
        for byte, table in enumerate(self.tables):
            for value in np.unique(prints[:, byte]):
                items = np.concatenate([table[v] for v in BALL[value]])
                rows = np.nonzero(prints[:, byte] == value)[0]
                pairs.append((rows[:, None] * len(self.bags) + items).ravel())
        rows, items = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.bags)))
        close = np.bitwise_count(prints[rows] ^ self.prints[items]).sum(1) <= RADIUS
        return rows[close], items[close]


class Index:
    def __init__(self, items: list[tuple[int, str | None]]):
        texts = defaultdict(list)
        for item, text in items:
            texts[tuple(words_of(text))].append(item)
        texts.pop((), None)
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.lengths: dict[int, Items] = {}
        places = defaultdict(set)
        by_length = defaultdict(list)
        for words, ids in sorted(texts.items()):
            by_length[len(words)].append((list(words), ids))
        for n, group in by_length.items():
            k = min(SHINGLE, n)
            found = [shingles(words, k) for words, _ in group]
            self.lengths[n] = Items([Counter(f) for f in found], np.concatenate([_packed(_bits(f).sum(0)[None]) for f in found]), [ids for _, ids in group])
            for words, _ in group:
                for code in self._codes(np.array([self.vocabulary[w] for w in words], np.uint64), k).tolist():
                    places[k, code].add(n)
        self.places = dict(places)
        self.known = {k: np.array(sorted(c for kk, c in self.places if kk == k), np.uint64) for k in {k for k, _ in self.places}}

    @staticmethod
    def _codes(ids: np.ndarray, k: int) -> np.ndarray:
        code = np.zeros(len(ids) - k + 1, np.uint64)
        for i in range(k):
            code = code * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(code) + i]
        return code

    def _windows(self, words: list[bytes]) -> dict[int, np.ndarray]:
        """By item length, which windows share a shingle with some item of that length."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        wanted: dict[int, np.ndarray] = {}
        for k, known in self.known.items():
            if len(ids) < k:
                continue
            codes = self._codes(ids, k)
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            for p in np.nonzero(known[at] == codes)[0].tolist():
                for n in self.places[k, int(codes[p])]:
                    if n not in wanted:
                        wanted[n] = np.zeros(max(1, len(words) - n + 1), bool)
                    wanted[n][max(0, min(p - n + k, len(wanted[n]) - 1)) : p + 1] = True
        return wanted

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window for each item that text holds, in order of place."""
        words = words_of(text)
        out = []
        for n, wanted in self._windows(words).items():
            k, items, size, starts = min(SHINGLE, n), self.lengths[n], min(n, len(words)), np.nonzero(wanted)[0]
            best: dict[int, tuple[float, int]] = {}
            for run in np.split(starts, np.nonzero(np.diff(starts) > 1)[0] + 1):
                step = max(1, min(2048, AT_ONCE // len(items.bags)))
                for part in np.split(run, range(step, len(run), step)):
                    first = int(part[0])
                    here = shingles(words[first : int(part[-1]) + size], k)
                    sums = np.concatenate([np.zeros((1, 64), np.int32), _bits(here).cumsum(0)])
                    m = size - k + 1
                    for row, item in zip(*items.near(_packed(sums[m:] - sums[:-m])), strict=True):
                        same = similarity(Counter(here[row : row + m]), items.bags[item])
                        if same >= LEAST and same > best.get(item, (0.0, 0))[0]:
                            best[item] = (same, first + int(row))
            out += [(i, same, start, size) for item, (same, start) in best.items() for i in items.ids[item]]
        return sorted(out, key=lambda m: (m[2], m[3], -m[1]))  # ids may be null or of types without order


def parts(benchmark: DataFrame, max_bytes: int = MAX_BYTES) -> list[DataFrame]:
    """The benchmark in as many parts as its size asks for."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(-(-total // max_bytes)) or 1
    return [benchmark.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).select("item_id", "text") for i in range(n)]


def index_of(part: DataFrame) -> Index:
    return Index([(r.item_id, r.text) for r in part.toLocalIterator()])  # about max_bytes


def matches(shared, text: Column, item: str = "bigint") -> Column:
    """An array of the items of a broadcast index that the text holds."""

    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("item_id", "similarity", "start_word", "n_words"), m, strict=True)) for m in shared.value.matches(t)] for t in texts], dtype=object)

    return F.pandas_udf(found, f"array<struct<item_id:{item},similarity:double,start_word:int,n_words:int>>")(text)


def _of_parts(docs: DataFrame, benchmark: DataFrame, max_bytes: int, use) -> list[DataFrame]:
    """What use makes of each part's broadcast index; of several parts each result is written before the next index is made."""
    found, out = parts(benchmark, max_bytes), []
    for part in found:
        shared = docs.sparkSession.sparkContext.broadcast(index_of(part))
        if len(found) == 1:
            return [use(shared)]
        out.append(cut(use(shared)))
        shared.destroy()
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """A row for each document and item that it holds: id, item_id, similarity, start_word, n_words."""
    item = benchmark.schema["item_id"].dataType.simpleString()
    return reduce(DataFrame.unionAll, _of_parts(docs, benchmark, max_bytes, lambda shared: docs.select(id_col, F.inline(matches(shared, F.col(text_col), item)))))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents that hold no item."""
    item = benchmark.schema["item_id"].dataType.simpleString()
    holds = lambda shared: F.size(matches(shared, F.col(text_col), item)) > 0
    if len(parts(benchmark, max_bytes)) == 1:
        return _of_parts(docs, benchmark, max_bytes, lambda shared: docs.where(~holds(shared)))[0]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *row_key(docs))
    held = reduce(DataFrame.unionAll, _of_parts(docs, benchmark, max_bytes, lambda shared: docs.where(holds(shared)).select(*row_key(docs)).distinct()))
    return keyed.join(held, ["k1", "k2"], "left_anti").select("doc.*")
