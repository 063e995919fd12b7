"""Filter audit, importance resampling and nearest neighbours against brute force, and what is defined for odd input."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from covaria.llm import audit, neighbours, resampling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>, label int"
WORDS = "alpha beta gamma Delta epsilon ZETA eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon #x a|b é ß 漢字 l0ng".split()


def corpus(seed=0, n=200):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS[: rng.choice([5, 20, 28])]) for _ in range(n))
    rows = [(i, text(rng.randint(1, 120)), "en", rng.choice(["s0", "s0", "s1", "s2"]), 0) for i in range(n)]
    rows += [(n + i, rows[5][1], "en", rng.choice(["s0", "s1"]), 0) for i in range(60)]
    rows += [(-4, rows[7][1], "en", "s2", 0), (900, None, None, None, None), (901, "", "en", "", 0), (902, " \n\t", "en", "s1", 0)]
    rows += [(None, rows[5][1], "en", "s1", 0), (None, "no id here", "en", None, 0), (903, "x" * 200_000, "en", "s2", 0), (904, "Y " * 100_000, "en", "s2", 0)]
    return rows + [rows[7], rows[7], rows[5]]


def labels():
    rng = random.Random(1)
    return [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 230, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (77777, 1, 1), (8, None, None)]


# filter audit


def audited(docs, labels):
    fails, least = [], {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    marks = {i: (any(q == 1 for j, q, _ in labels if j == i), any(t == 1 for j, _, t in labels if j == i)) for i, *_ in labels if i is not None}
    for i, text, _, source, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > least[text]]
        fails.append((source or "", failed, marks.get(i, (False, False))))
    out = {}
    for part in {p for p, *_ in fails}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = [x for x in fails if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                at = "ABCDE".index(f)
                here = [x for x in left if x[1][at]]
                redundant = sum(x[1][at] for x in gone)
                left, gone = [x for x in left if not x[1][at]], gone + here
                only = sum(x[0] == part and x[1][at] and sum(x[1]) == 1 for x in fails)
                shapley[f] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), redundant, only, sum(x[2][0] for x in here), sum(x[2][1] for x in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_equals_every_order_applied(spark):
    docs, said = corpus(), labels()
    df = spark.createDataFrame(docs, DOCS).withColumns({"part": F.lit("clash"), "n": F.lit("clash"), "failed": F.lit(1), "id": F.lit("clash")})
    rows = audit.audit(df, spark.createDataFrame(said, LABELS).withColumn("good", F.lit("clash"))).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(rows) == len(got) == 4 * 600
    assert got == audited(docs, said)


def test_audit_of_nothing_and_of_other_filters(spark):
    assert audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    docs = spark.createDataFrame([(1, "a", "en", None, 0), (2, "a", "en", None, 0), (3, "bb", "en", None, 0)], DOCS)
    rows = audit.audit(docs, spark.createDataFrame([], LABELS), lambda text: {"S": F.length(text) < 2}, "SR").collect()
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in rows}
    assert got == {("SR", 1): (1, 2, 0, 1, 3), ("SR", 2): (1, 0, 1, 0, 1), ("RS", 1): (2, 1, 0, 0, 1), ("RS", 2): (1, 1, 1, 1, 3)}


# importance resampling


def features(text):
    small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)
    return words, [*words, *[f"{a} {b}" for a, b in itertools.pairwise(words)]]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def resampled(docs, target):
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text, *_ in docs:
        words, own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20, None])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: len(able) * 25 // 100], 1):
        row[5] = rank
    return sorted(((*r[:4], r[5]) for r in rows), key=repr)


def test_buckets_of_pairs_come_from_their_words():
    rng = random.Random(2)
    for n in [0, 1, 2, 50, 400]:
        words = [bytes(rng.choice([97, 98, 200]) for _ in range(rng.choice([1, 3, 9, 254, 255, 256, 300]))) for _ in range(n)]
        want = [zlib.crc32(w) % 10_000 for w in words] + [zlib.crc32(a + b" " + b) % 10_000 for a, b in itertools.pairwise(words)]
        assert resampling.buckets(words).tolist() == want


def test_pieces_of_a_long_text_have_all_features(monkeypatch):
    words = [f"w{i % 7}".encode() for i in range(23)]
    whole = sorted(resampling.buckets(words).tolist())
    for size in (1, 2, 11, 22, 23, 24):
        monkeypatch.setattr(resampling, "AT_ONCE", size)
        assert sorted(b for p in resampling._pieces(words) for b in p.tolist()) == whole


def test_resampling_equals_brute_force(spark):
    docs, target = corpus(3), ["alpha beta gamma", "kappa Lambda mu", None, "", "rho rho-sigma"]
    df = spark.createDataFrame(docs, DOCS).withColumns({"id": F.lit("clash"), "row": F.lit("clash"), "score": F.lit("clash"), "rank": F.lit("clash")})
    got = resampling.resampled(df, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"))
    assert {k for _, k in got.dtypes} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=repr) == resampled(docs, target)


def test_radix_selection_finds_the_last_row_among_ties(spark, monkeypatch):
    monkeypatch.setattr(resampling, "DIGIT", 3)
    rng = random.Random(4)
    ids = [*range(-20, 60), None, None, 1 << 62, -(1 << 63), (1 << 63) - 1]
    for spread in (1, 3, 1000):
        rows = [(rng.random() < 0.9, rng.randrange(spread) - spread // 2, rng.choice(ids), i) for i in range(150)]
        df = spark.createDataFrame(rows, "eligible boolean, score long, id long, row long").cache()
        order = [r[3] for r in sorted((r for r in rows if r[0]), key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[3]))]
        for n in (0, 7, len(order)):
            drawn = df.where(resampling.chosen(df, n))
            assert sorted(r.row for r in drawn.collect()) == sorted(order[:n])
        assert [r.row for r in resampling.ranked(df.where(resampling.chosen(df, 60))).orderBy("rank").collect()] == order[:60]
        assert [r["rank"] for r in resampling.ranked(df.where(resampling.chosen(df, 60))).orderBy("rank").collect()] == list(range(1, 61))


def test_resampling_of_nothing(spark):
    none, target = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resampling.resampled(none, target).count() == 0
    few = spark.createDataFrame([(1, "too few words", "en", "s", 0), (2, None, "en", "s", 0)], DOCS)
    assert {(r.doc_id, r.n_features, r["rank"]) for r in resampling.resampled(few, target.limit(0)).collect()} == {(1, 5, None), (2, 0, None)}
    with pytest.raises(TypeError):
        resampling.resampled(few.withColumn("doc_id", F.lit("a")), target)


# nearest neighbours


def searched(rows, k=20, every=20):
    sound = {(i, tuple(np.float32(x) for x in v)) for i, v, _ in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)}
    out = []
    for query in sorted({i for i, _ in sound if i % every == 0}):
        q = min(v for i, v in sound if i == query)
        found = [(-sum(float(a) * float(b) for a, b in zip(q, v, strict=True)), i) for i, v in sound if i != query and len(v) == len(q)]
        out += [(query, rank, i, -score) for rank, (score, i) in enumerate(sorted(found)[:k], 1)]
    return out


def vectors(dim, n, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dim))
    return [(i, [float(np.float32(x)) for x in middle[i % 6] * 2 + rng.normal(size=dim)], i % 6) for i in range(n)]


@pytest.mark.parametrize(("dim", "n"), [(64, 700), (7, 300), (130, 300), (1, 100)])
def test_neighbours_equal_brute_force(spark, dim, n):
    rows = vectors(dim, n)
    rows += [(1000 + i, rows[40][1], 0) for i in range(90)]  # a hot vector
    got = neighbours.nearest(spark.createDataFrame(rows, VECTORS).withColumn("v", F.lit("clash")).withColumn("dim", F.lit("clash")), block=128, queries=16)
    got = sorted(tuple(r) for r in got.collect())
    want = searched(rows)
    found = {(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}
    assert len(got) == len(want) and len(found) >= 0.99 * len(want)
    assert [g[:3] for g in got] == [w[:3] for w in want] or dim == 1
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-12)


@pytest.mark.parametrize("dim", [16, 64, 500])
def test_bounds_hold_and_leave_most_out(dim):
    x = np.array([v for _, v, _ in vectors(dim, 3000)])
    turn, centre = neighbours.rotation(dim), x.mean(0)
    assert turn.shape == (dim, max(dim, neighbours.BITS)) and np.abs(turn @ turn.T - np.eye(dim)).max() < 1e-9
    signs = neighbours.Codes.of(x, centre, turn).signs(turn.shape[1])
    exact, of_centre = x[:100] @ x.T, (x[:100] @ centre)[:, None]
    upper = of_centre + neighbours.bounds(signs, x[:100], turn)
    assert (exact <= upper).mean() > 0.9999
    assert (exact >= of_centre + neighbours.bounds(signs, x[:100], turn, -neighbours.SPREAD)).mean() > 0.9999
    least = np.partition(exact, -20, axis=1)[:, -20]
    assert (upper >= least[:, None]).mean() < 0.3


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [0.0, 0.0], 1), (40, None, 1), (60, [nan, 1.0], 1), (80, [inf, 1.0], 1), (100, [], 1), (120, [None, 1.0], 1), (None, [1.0, 1.0], 1), (140, [1.0, 1.0, 1.0], 1)]
    rows += [(3, [2.0, 0.0], None), (4, [2.0, 0.0], 2), (4, [2.0, 0.0], 2), (5, [-1.0, 3.0], 2), (5, [4.0, 0.0], 2), (-20, [1.0, 1.0], 2), (160, [0.0, 2.0], 1), (160, [0.0, 1.0], 1)]
    got = sorted(tuple(r) for r in neighbours.nearest(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == searched(rows) and {g[0] for g in got} == {-20, 0, 160}
    assert neighbours.nearest(spark.createDataFrame([], VECTORS)).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1)], VECTORS)
    assert neighbours.nearest(alone).count() == 0
    with pytest.raises(TypeError):
        neighbours.nearest(alone.withColumn("vec_id", F.lit("a")))
