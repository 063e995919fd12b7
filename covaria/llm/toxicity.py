"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned from labelled rows: words, and stems that many words share, whose contexts
(the word before and the word after; copies of a text add none) are in toxic documents so often
that chance doesn't explain it; a term weighs 1 if none are in others, and less with the share that
are. Terms stand in a trie. The Levenshtein automata
of all terms are run along the trie at once, as one automaton whose states are sets of (node,
edits), made when first reached; so a word costs a look-up for each letter and most words end at a
dead state early. Terms and stems of ``LONG`` letters and more may be off by one edit, a stem's words
anywhere, unless the misspelling is a word that occurs in documents that are not toxic. So the words that
a stem stands for are kept beside it: what begins with it needs no edit, and theirs are those of terms.

Each hit is weighed by its context window: misspelled less than exact, quoted much less, beside
other hits more. A logistic regression makes a probability of the sum and of its share of the text.

The model is fitted on at most ``MAX_ROWS`` labelled rows chosen by a hash of their ids and texts, none of
them held out. What the driver gathers are words and stems of those rows that pass the tests of chance,
clean words that look like them, and two numbers a row. Scoring is per document, where it is read.

A quotation is what stands between an opening mark and the next mark that closes it; where a mark is
the same on both sides, one with a letter or digit only after it opens, one with such only before it
closes, and any other does what is due. Quotations are found in one pass over the whole text.

Defined cases: null and empty texts have no hits; labels that are null or belong to no document
are ignored; without labels of both kinds every document scores the share of label 1 (0 without
any); null ids count as held out; repeated rows are scored alike; an empty table gives no rows;
other columns stay, and held_out, score and predicted replace columns of the same name.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out
from .quality import labelled

MAX_ROWS = 12000
STEMS, COMPLETIONS, LONG, LIFT = (4, 5, 6, 7), 4, 5, 4.0
MISSPELLED, QUOTED, BESIDE, WINDOW = 0.75, 0.25, 1.25, 6
HELD_OUT = (3, 1)
THRESHOLD = 0.7

WORD = re.compile(r"[^\W_]+")
#: Marks by the mark that closes them: "x", “x”, „x“ and «x».
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»"}
MARK = re.compile('["“”„«»]')


class Automaton:
    """All words within one edit of a term, or that begin with a stem; see the module.

    Unless ``every``, only terms of weight 1 may be off by an edit, and no stems.
    """

    DEAD = 0

    def __init__(self, terms: dict[str, float], stems: dict[str, float], exceptions: frozenset[str] = frozenset(), every: bool = False):
        self.children: list[dict[str, int]] = [{}]
        self.term, self.stem, self.fuzzy, self.long_end, self.near_stem = [0.0], [0.0], [False], [0.0], [0.0]
        for word, weight, stem in [(t, w, False) for t, w in terms.items()] + [(s, w, True) for s, w in stems.items()]:
            node, path = 0, [0]
            for ch in word:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    for values, none in ((self.term, 0.0), (self.stem, 0.0), (self.fuzzy, False), (self.long_end, 0.0), (self.near_stem, 0.0)):
                        values.append(none)
                node = self.children[node][ch]
                path.append(node)
            (self.stem if stem else self.term)[node] = weight
            if len(word) >= LONG and (every or not stem and weight == 1):
                (self.near_stem if stem else self.long_end)[node] = MISSPELLED * weight
                for n in path:
                    self.fuzzy[n] = True
        self.exact, self.stems, self.exceptions = terms, stems, exceptions
        self._reset()

    def _reset(self) -> None:
        self.number: dict[tuple[frozenset, float], int] = {}
        self.sets, self.steps, self.value, self.least = [frozenset()], [{}], [0.0], [0.0]
        self.known: dict[str, float] = {}
        self.start = self._state({(0, 0)})

    def _state(self, reached: set[tuple[int, int]], least: float = 0.0) -> int:
        for n, e in reached:
            if e == 0 and self.stem[n]:
                return -n  # whatever follows
        whole = set(reached)
        for n, e in reached:  # a letter left out
            if e == 0:
                whole |= {(c, 1) for c in self.children[n].values() if self.fuzzy[c]}
        whole = frozenset(x for x in whole if x[1] == 0 or (x[0], 0) not in whole)
        least = max([least, *[self.near_stem[n] for n, e in whole if e]])  # whatever follows, at least a misspelled stem
        if not whole and not least:
            return self.DEAD
        if (whole, least) not in self.number:
            self.number[whole, least] = len(self.sets)
            self.sets.append(whole)
            self.steps.append({})
            self.least.append(least)
            self.value.append(max([least, *[max(self.term[n] if e == 0 else 0.0, self.long_end[n]) for n, e in whole]]))
        return self.number[whole, least]

    def _step(self, state: int, ch: str) -> int:
        reached = set()
        for n, e in self.sets[state]:
            if ch in self.children[n] and (e == 0 or self.fuzzy[self.children[n][ch]]):
                reached.add((self.children[n][ch], e))
            if e == 0:
                if self.fuzzy[n]:
                    reached.add((n, 1))  # a letter too many
                reached |= {(c, 1) for c in self.children[n].values() if self.fuzzy[c]}  # another letter
        to = self._state(reached, self.least[state])
        self.steps[state][ch] = to
        return to

    def hit(self, word: str) -> float:
        """The weight of a term or a stem's word, MISSPELLED of it one edit away, else 0."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000 or len(self.sets) > 200_000:
                self._reset()
            state = self.start
            for ch in word:
                to = self.steps[state].get(ch)
                state = self._step(state, ch) if to is None else to
                if state <= self.DEAD:
                    break
            found = self.value[state] if state >= 0 else self.stem[-state]
            if state >= 0 and word in self.exceptions:
                found = self.exact.get(word, 0.0)
            self.known[word] = found
        return found

    def mistaken(self, word: str) -> bool:
        """Whether it is a misspelling, no stem's word and no term, that gives the word its weight."""
        return self.hit(word) > self.exact.get(word, 0.0) and not any(word[:k] in self.stems for k in STEMS)


def quotations(text: str) -> list[tuple[int, int]]:
    """Where each quotation of a text starts and ends, in order; none lies within another."""
    found, opened, closing = [], -1, ""
    for m in MARK.finditer(text):
        mark, at = m[0], m.start()
        if mark == '"':
            before, after = text[at - 1 : at].isalnum(), text[at + 1 : at + 2].isalnum()
            opens = after if before != after else opened < 0 and not (text[at + 1 : at + 2] or " ").isspace()
        else:
            opens = mark in QUOTES and mark != closing
        if opened >= 0 and mark == closing and not opens:
            found.append((opened, at))
            opened, closing = -1, ""
        elif opens and (opened < 0 or mark == '"' == closing):  # a mark that opens again: the one before was stray
            opened, closing = at, QUOTES[mark]
    return found


def evidence(automaton: Automaton, text: str | None) -> tuple[float, int]:
    """The sum of hits, each weighed by its context, and the number of words."""
    text = (text or "").lower()
    words = WORD.findall(text)
    hit = automaton.hit
    hits = [i for i, w in enumerate(words) if hit(w)]
    if not hits:
        return 0.0, len(words)
    starts, wanted, total = {}, set(hits), 0.0
    for i, m in enumerate(WORD.finditer(text)):
        if i in wanted:
            starts[i] = m.start()
    quoted = quotations(text)
    for k, i in enumerate(hits):
        weight = hit(words[i])
        if (k and i - hits[k - 1] <= WINDOW) or (k + 1 < len(hits) and hits[k + 1] - i <= WINDOW):
            weight *= BESIDE
        at = bisect_right(quoted, (starts[i],)) - 1
        total += weight * (QUOTED if at >= 0 and starts[i] < quoted[at][1] else 1.0)
    return total, len(words)


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    weights: np.ndarray | None = None
    constant: float = 0.0

    def scores(self, found: list[tuple[float, int]]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(found), self.constant)
        return 1 / (1 + np.exp(-np.clip(features(found) @ self.weights, -60, 60)))


def features(found: list[tuple[float, int]]) -> np.ndarray:
    x = np.array(found, float).reshape(-1, 2)
    return np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), np.minimum(10, 100 * x[:, 0] / np.maximum(x[:, 1], 20))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Newton's method; the intercept isn't penalised."""
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
    return w


def _candidates(batches):
    """Counts of documents by word or stem ("word" or "word~") and label."""
    for rows in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, label in zip(rows["text"], rows["label"], strict=True):
            words = set(WORD.findall((text or "").lower()))
            counts[label].update(words)
            counts[label].update({f"{w[:k]}~" for w in words for k in STEMS if len(w) > k})
        yield pd.DataFrame([(t, n if y else 0, 0 if y else n) for y in (0, 1) for t, n in counts[y].items()], columns=["term", "toxic", "clean"])


def _contexts(terms: frozenset[str]):
    def of(batches):
        for rows in batches:
            out = set()
            for text, label in zip(rows["text"], rows["label"], strict=True):
                words = WORD.findall((text or "").lower())
                for i, w in enumerate(words):
                    for t in (w, *[f"{w[:k]}~" for k in STEMS if len(w) > k]):
                        if t in terms:
                            out.add((t, f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}", w, int(label)))
            yield pd.DataFrame(list(out), columns=["term", "context", "word", "label"])

    return of


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    rows = cut(labelled(docs, labels.where("toxic IN (0, 1)"), "toxic", HELD_OUT, max_rows).withColumn("row", F.monotonically_increasing_id()))
    if rows.count() > max_rows:  # of repeated ids; numbers alone are ordered
        first = rows.select("turn", "row").orderBy("turn", "row").limit(max_rows).select("row")
        rows = rows.join(F.broadcast(cut(first)), "row")
    known, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if toxic in (0, known):
        return Model(constant=toxic / known if known else 0.0)
    share = toxic / known
    counts = rows.mapInPandas(_candidates, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = cut(counts)
    # so many in toxic documents that, were the share the same for every term, not one of all terms should be expected to have it by chance
    odds, n_terms = share / (1 - share), max(1, counts.count())
    support = max(3, math.ceil(math.log(0.05 / n_terms) / math.log(share)))
    likely = (F.col("toxic") >= support) & (F.col("toxic") >= LIFT * odds * F.col("clean")) & (F.col("toxic") * F.log(F.col("toxic") / ((F.col("toxic") + F.col("clean")) * share)) + F.col("clean") * F.log((F.col("clean") + 1e-9) / ((F.col("toxic") + F.col("clean")) * (1 - share))) >= math.log(n_terms / 0.05))
    wanted = frozenset(r.term for r in counts.where(likely).collect())
    contexts = rows.mapInPandas(_contexts(wanted), "term string, context string, word string, label int").groupBy("term").agg(
        F.count_distinct(F.when(F.col("label") == 1, F.col("context"))).alias("toxic"), F.count_distinct(F.when(F.col("label") == 0, F.col("context"))).alias("clean"), F.approx_count_distinct("word", 0.02).alias("words"))
    sound = {r.term: r for r in contexts.where(likely).collect()}
    weight = {t: (1.0 if r.clean <= 0.03 * r.toxic else 0.5 * r.toxic / (r.toxic + r.clean)) for t, r in sound.items()}
    lift = {t: r.toxic / (r.clean + 0.05 * r.toxic) for t, r in sound.items()}
    stems = {t[:-1] for t, r in sound.items() if t[-1] == "~" and r.words >= COMPLETIONS}
    # of stems that begin with each other the purest, and of those as pure the longest that loses no more than a twentieth
    better = lambda a, b: lift[f"{a}~"] > 1.5 * lift[f"{b}~"] or len(a) > len(b) and sound[f"{a}~"].toxic >= 0.95 * sound[f"{b}~"].toxic
    stems = {s for s in stems if not any(x != s and x.startswith(s) and better(x, s) for x in stems)}
    # and none that is mostly one word, itself purer
    stems = {s for s in stems if not any(t.startswith(s) and t[-1] != "~" and r.toxic >= 0.5 * sound[f"{s}~"].toxic and lift[t] > 1.5 * lift[f"{s}~"] for t, r in sound.items())}
    stems = {s: weight[f"{s}~"] for s in sorted(stems) if not any(x != s and s.startswith(x) for x in stems)}
    terms = {t: weight[t] for t in sorted(sound, key=lambda t: (-sound[t].toxic, t)) if t[-1] != "~" and not any(t.startswith(s) for s in stems)}
    if stems:
        stem = F.coalesce(*[F.when(F.substring("term", 1, k).isin([x for x in stems if len(x) == k]), F.substring("term", 1, k)) for k in STEMS])
        of_stem = counts.where("toxic > 0 AND term NOT LIKE '%~'").withColumn("stem", stem).where("stem IS NOT NULL")
        family = of_stem.collect()
        terms |= {r.term: stems[r.stem] for r in family}

    # words of clean documents that look like misspellings, then the weights
    first = Automaton(terms, stems, every=True)

    def mistaken(batches):
        for part in batches:
            clean = {w for text, label in zip(part["text"], part["label"], strict=True) if not label for w in WORD.findall((text or "").lower())}
            yield pd.DataFrame({"word": [w for w in clean if first.mistaken(w)]}, dtype=object)

    exceptions = frozenset(r.word for r in rows.mapInPandas(mistaken, "word string").distinct().collect())
    second = Automaton(terms, stems, exceptions, every=True)

    def weighed(batches):
        for part in batches:
            found = [evidence(second, t) for t in part["text"]]
            yield pd.DataFrame({"total": [f[0] for f in found], "words": [f[1] for f in found], "label": part["label"]})

    seen = rows.mapInPandas(weighed, "total double, words long, label int").collect()
    return Model(terms, stems, exceptions, logistic(features([(r.total, r.words) for r in seen]), np.array([r.label for r in seen], float)))


def _score(shared, text: Column) -> Column:
    made: list[Automaton] = []

    def scores(texts: pd.Series) -> pd.Series:
        model = shared.value
        if not made:
            made.append(Automaton(model.terms, model.stems, model.exceptions, every=True))
        return pd.Series(model.scores([evidence(made[0], t) for t in texts]))

    return F.pandas_udf(scores, "double")(text)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of at most MAX_ROWS rows
    out = docs.withColumn("held_out", held_out(F.col("doc_id"), *HELD_OUT)).withColumn("score", _score(shared, F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of op8."""
    return scored(docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", "held_out", "score", "predicted")
