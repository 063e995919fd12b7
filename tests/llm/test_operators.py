"""Corpus operators against brute force on small tables, and what is defined for odd input."""

import bisect
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from covaria.llm import chat, components, decontamination, lines, mixing, quality, sharding, simhash, toxicity, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def documents(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(0)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(i, text(rng.randint(1, 60)), "en", f"s{rng.choice([0, 0, 0, 1, 2])}", 0) for i in range(300)]
    rows += [(300 + i, rows[5][1], "en", "s0", 0) for i in range(60)] + [(400, None, None, None, None), (401, "", "en", None, 0), (402, " \n\t", "en", "s1", 0), (None, "no id here", "en", "s1", 0), (403, "x" * 200_000, "en", "s2", 0)]
    rows += [rows[7], rows[7]]
    return documents(spark, rows)


def clashing(df, *names):
    return df.withColumns({n: F.lit("clash") for n in names})


# sharding


def test_minimax_cuts_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        sizes, k = [rng.randint(0, 9) for _ in range(rng.randint(1, 9))], rng.randint(1, 4)
        loads = lambda cuts, s=sizes: [sum(s[a:b]) for a, b in itertools.pairwise([0, *cuts, len(s)])]
        best = min(max(loads(c)) for n in range(k) for c in itertools.combinations(range(1, len(sizes)), n))
        cuts = sharding.minimax_cuts(sizes, k)
        assert len(cuts) < k and max(loads(cuts)) == best
    assert sharding.minimax_cuts([], 4) == []


def test_one_large_atom_leaves_no_shard_empty():
    loads = lambda cuts, s: [sum(s[a:b]) for a, b in itertools.pairwise([0, *cuts, len(s)])]
    sizes = [1] * 20 + [100] + [1] * 20
    assert sorted(loads(sharding.minimax_cuts(sizes, 16), sizes)) == [2] * 5 + [3] * 10 + [100]
    rng = random.Random(11)
    for _ in range(60):
        sizes, k = [rng.choice([1, 2, 5, 40]) for _ in range(rng.randint(1, 10))], rng.randint(1, 5)
        every = [loads(c, sizes) for c in itertools.combinations(range(1, len(sizes)), min(k, len(sizes)) - 1)]
        best = min((max(x), sum(v * v for v in x)) for x in every)
        got = loads(sharding.minimax_cuts(sizes, k), sizes)
        assert (max(got), sum(v * v for v in got)) == best and len(got) == min(k, len(sizes))


def test_pieces_are_looked_into_until_the_capacity_is_that_of_groups():
    rng = random.Random(12)
    for _ in range(300):
        groups = [(f"{rng.getrandbits(16):04x}", rng.choice([1, 2, 5, 9, 40])) for _ in range(rng.randint(1, 60))]
        groups, k = sorted(dict(groups).items()), rng.randint(1, 6)
        count = lambda n, rows: [sharding.Piece(p, sum(g), max(g), len(g)) for p, r in itertools.groupby(rows, key=lambda x: x[0][:n]) if (g := [s for _, s in r])]
        pieces = count(1, groups)
        while found := sharding.undecided(pieces, k):
            gone = {pieces[i].prefix for i in found}
            pieces = sorted([p for p in pieces if p.prefix not in gone] + [c for p in gone for c in count(len(p) + 1, [g for g in groups if g[0].startswith(p)])])
        assert sharding.minimax([p.size for p in pieces], k) == sharding.minimax([s for _, s in groups], k)


def test_shards(spark, corpus):
    rows = sharding.digest(corpus).collect()
    assert len(rows) == corpus.count()
    slots, shards = collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        shards[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert all(len(s) == 1 for s in shards.values())
    texts = {r.doc_id: r.text for r in corpus.collect()}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == (None if texts[r.doc_id] is None else zlib.crc32(texts[r.doc_id].encode())) for r in rows)
    texts = collections.Counter(r.text for r in corpus.collect())
    groups = [len((t or "").encode()) * n + n for t, n in sorted(texts.items(), key=lambda x: "" if x[0] is None else hashlib.md5(x[0].encode()).hexdigest())]
    loads = collections.Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert max(loads.values()) == sharding.minimax(groups, 16)
    odd = clashing(corpus, "size", "shard", "slot")
    helpers = ["k1", "k2", "many", "at", "digest", "piece", "spread", "before", "id", "doc", "found"]
    every = sharding.shard(clashing(corpus, *helpers), 4, digits=1)  # cuts lie within pieces
    assert every.columns == [*corpus.columns, *helpers, "size", "shard", "slot"]
    found, loads = every.collect(), collections.Counter()
    for r in found:
        loads[r.shard] += r.size
    assert max(loads.values()) == sharding.minimax(groups, 4) and all(r[h] == "clash" for r in found for h in helpers)
    assert collections.Counter((r.doc_id, r.text) for r in found) == collections.Counter((r.doc_id, r.text) for r in corpus.collect())
    assert all(sorted(r.slot for r in found if r.shard == k) == list(range(sum(r.shard == k for r in found))) for k in range(4))
    assert sharding.shard(odd).count() == len(rows) and sharding.digest(corpus.limit(0)).collect() == []


# mixing


def test_mix(spark, corpus):
    rows = mixing.digest(corpus).collect()
    assert len(rows) == corpus.count()
    text = {r.doc_id: (r.source, r.text) for r in corpus.collect()}
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        source, t = text[r.doc_id]
        assert r.size == len((t or "").encode().split()) and (r.taken == 0 or (r.taken % r.size == 0 and r.taken <= 3 * r.size))
        sizes[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, capped, want = {s: i % 3 + 1 for i, s in enumerate(order)}, set(), {}
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        want = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order}
        more = {s for s in order if want[s] > 3 * sizes[s] + 1e-9}
        if not more:
            break
        capped |= more
    assert target == {s: pytest.approx(want[s]) for s in order}
    assert all(abs(taken[s] - target[s]) <= max(60, 0.02 * target[s]) for s in order)
    assert sorted((r.doc_id or -1, r.taken) for r in mixing.digest(corpus).collect()) == sorted((r.doc_id or -1, r.taken) for r in rows)
    helpers = ["k1", "k2", "many", "at", "src", "cls", "spread", "share", "offset", "doc", "found", "nth"]
    odd = clashing(corpus.withColumn("size", F.lit(3).cast("long")), "target", "copies", "source_size", *helpers)
    found = mixing.mix(odd).collect()
    assert collections.Counter((r.doc_id, r.text) for r in found) == collections.Counter((r.doc_id, r.text) for r in corpus.collect()) and all(r[h] == "clash" for r in found for h in helpers)
    again = clashing(corpus, *helpers)
    drawn = mixing.taken(again).collect()
    assert mixing.taken(again).columns == again.columns
    sums = collections.Counter()
    for r in drawn:
        sums[r.source] += len((r.text or "").encode().split())
    assert all(abs(sums[s] - target[s]) <= max(60, 0.02 * target[s]) for s in order)
    assert len(found) == len(rows) and mixing.digest(corpus.limit(0)).collect() == []


# near-duplicates


def classes(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(150, 200)]
    want = classes(201, pairs)
    df = spark.createDataFrame([*pairs, (None, 3), (4, 4)], "a long, b long")
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == {x: want[x] for p in pairs for x in p if p[0] != p[1]}
    assert components.components(df.limit(0)).collect() == []


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    found = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, corpus):
    rows = corpus.collect()
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.fingerprint, r.component_id) for r in simhash.digest(corpus).collect())
    prints = [slow_fingerprint(r.text) for r in rows]
    group = classes(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {}
    for r, g in zip(rows, group, strict=True):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert got == sorted((r.doc_id if r.doc_id is not None else -1, f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, group, strict=True)) if all(g in least for g in group) else len(got) == len(rows)
    assert simhash.digest(corpus.limit(0)).collect() == []


def test_one_row_of_each_component_stays(spark):
    long = [" ".join(f"{w}{i}" for w in WORDS) for i in range(4)]
    rows = [(1, long[0]), (1, long[0]), (2, long[0]), (2, long[1]), (None, long[2]), (None, long[2]), (3, None), (4, ""), (4, ""), (5, long[3])]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "doc", "fp", "k1", "many", "least", "component_id")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, long[0]), (2, long[1]), (0, long[2]), (3, ""), (5, long[3])])
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_visitors_of_an_anchor_are_dealt_out(spark):
    """Two homes with hundreds of visitors: blocks are bounded on either side."""
    low = [0] + [1 << p for p in range(31)]  # all at the anchor 0, or next to it
    prints = sorted({(h << 40) | w for h in range(30) for w in low})
    want = classes(len(prints), [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3])
    at = {p: i for i, p in enumerate(prints)}
    seen = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), many=1, block=16)
    assert classes(len(prints), [(at[r.a], at[r.b]) for r in seen.collect()]) == want


def test_anchors_find_every_pair(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = classes(len(prints), [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3])
    for options in ({}, {"many": 1, "block": 2}):  # all compared in the join; nearly all dealt out in blocks
        found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), **options).collect()
        at = {s: i for i, s in enumerate(signed)}
        assert classes(len(prints), [(at[r.a], at[r.b]) for r in found]) == want


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 8))
    rows = [(i, [float(v) for v in base[i % 20] + rng.normal(size=8) * 0.08 * (i % 3)], i % 2) for i in range(240)]
    rows += [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [1.0, None] + [0.0] * 6, 0), (1003, [math.nan] * 8, 0), (1004, [1.0] * 8, None), (1005, [], 0), (1006, [1.0, 2.0], 0), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0)]
    unit = [np.array(v) / np.linalg.norm(v) if v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) else None for _, v, lab in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    group, n = classes(len(rows), near), collections.Counter(x for p in near for x in p)
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group)}
    want = {rows[i][0]: (n[i], least[group[i]], rows[i][0] == least[group[i]]) for i in range(len(rows))}
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "kept", "n_links")
    for options in ({}, {"per": 10, "block": 8, "n_pivots": 6}):  # the second: cells within cells
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.linked(df, **options).collect()} == want
    assert vectors.linked(df.limit(0)).collect() == []
    named = df.withColumn("label", F.concat(F.lit("label/"), "label"))
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.linked(named).collect()} == want
    unit = spark.createDataFrame([("a", i, 1, True, [float(x) for x in u]) for i, u in enumerate(unit) if u is not None and len(u) == 8], vectors.CELL)
    split = vectors.cells(unit, 10, 6, 8).groupBy("cell").agg(F.count_if("is_home").alias("homes"), F.count("cls").alias("rows")).collect()
    assert any(r.cell.count("/") > 1 for r in split) and sum(r.homes for r in split) == unit.count() and max(r.rows for r in split) < unit.count() / 2


# decontamination


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.randint(2, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "alpha0 beta1 gamma2 delta3 epsilon4 zeta5")] 
    items += [(53, items[3][1])]
    docs = []
    for i in range(80):
        words = [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.randint(0, 60))]
        item = rng.choice(items[:12])[1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            item[rng.randrange(len(item))] = "other"
        cut = rng.randint(0, len(words))
        docs.append((i, " ".join(words[:cut] + (item if i % 2 else []) + words[cut:]).upper(), "en", "s", 0))
    docs += [(90, None, None, None, None), (91, "", "", "", 0), (92, "alpha0 beta1", "", "", 0), (None, items[3][1], "", "", 0), (93, items[3][1], "", "", 0), (93, items[3][1], "", "", 0)]
    want = set()
    for doc, text, *_ in docs:
        w = decontamination.words_of(text)
        for item, body in items:
            b = decontamination.words_of(body)
            if not b or not w:
                continue
            k, size = min(5, len(b)), min(len(b), len(w))
            bag = collections.Counter(decontamination.shingles(b, k))
            if any(len(s := decontamination.shingles(w[i : i + size], k)) and decontamination.similarity(collections.Counter(s), bag) >= 0.8 for i in range(len(w) - size + 1)):
                want.add((doc, item))
    df, bench = clashing(documents(spark, docs), "similarity", "item_id"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(df, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want
    assert decontamination.clean(documents(spark, docs), bench).count() == sum(1 for d in docs if not any(d[0] == x for x, _ in want))
    assert len(decontamination.parts(bench, 400)) > 1
    in_parts = decontamination.contaminated(df, bench, max_bytes=400)
    assert {(r.doc_id, r.item_id) for r in in_parts.collect()} == want and in_parts.count() == got.count()
    rest = decontamination.clean(clashing(documents(spark, docs), "doc", "k1", "k2"), bench, max_bytes=400)
    assert collections.Counter(r.doc_id for r in rest.collect()) == collections.Counter(d[0] for d in docs if not any(d[0] == x for x, _ in want))
    assert decontamination.contaminated(df.limit(0), bench).collect() == [] and decontamination.contaminated(df, bench.limit(0)).collect() == []


def test_byte_tables_find_all_within_radius():
    rng = np.random.default_rng(5)
    items = rng.integers(0, 256, (6, 8), dtype=np.uint8)
    made = decontamination.Items([collections.Counter()] * 6, items, [[0]] * 6)
    flips = np.stack([np.packbits(np.isin(np.arange(64), rng.choice(64, k, replace=False)), bitorder="little") for k in range(40)])
    prints = (items[:, None] ^ flips[None]).reshape(-1, 8)
    far = np.bitwise_count(prints[:, None] ^ items[None]).sum(2)
    assert sorted(zip(*made.near(prints), strict=True)) == sorted(zip(*np.nonzero(far <= decontamination.RADIUS), strict=True))
    assert all(len(x) == 0 for x in made.near(prints[:0]))


# quality and toxicity


def test_quality(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 60)))
    rows = [(i, text() if i % 3 else " ".join(w.upper() + "!!" for w in text().split()), "en", "s", 0) for i in range(400)]
    rows += [(900, None, None, None, None), (901, "", "", "", 0), (None, text(), "", "", 0), (902, "word " * 50_000, "", "", 0)]
    docs, labels = clashing(documents(spark, rows), "score", "predicted"), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, None), (5, None, 1), (5000, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.digest(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    assert quality.digest(docs.limit(0), labels).collect() == [] and {r.score for r in quality.digest(docs, labels.limit(0)).collect()} == {1.0}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton():
    rng = random.Random(7)
    word = lambda a, b: "".join(rng.choice("abc") for _ in range(rng.randint(a, b)))
    terms = {word(2, 8): rng.choice([0.5, 1.0]) for _ in range(30)}
    automaton = toxicity.Automaton(terms, {"bcbca": 0.9, "aaac": 0.8})
    for w in {word(1, 9) for _ in range(4000)}:
        stem = next((v for s, v in {"bcbca": 0.9, "aaac": 0.8}.items() if w.startswith(s)), None)
        close = any(v == 1 and len(t) >= toxicity.LONG and distance(w, t) <= 1 for t, v in terms.items())
        assert automaton.hit(w) == (stem if stem is not None else max(terms.get(w, 0.0), toxicity.MISSPELLED if close else 0.0)), w


def test_toxicity(spark):
    rng = random.Random(8)
    clean = lambda: [rng.choice(WORDS) + rng.choice(WORDS)[:3] for _ in range(40)]
    bad, rows, labels = ["wretch", "vermin", "nitwit"], [], []
    for i in range(600):
        words = clean()
        if i % 5 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(900, " ".join(clean() + ["wretch", "vermiin", "nitwwit"]), "", "", 0), (901, " ".join(clean()), "", "", 0), (902, None, None, None, None), (903, "", "", "", 0), (None, "vermin " * 30_000, "", "", 0)]
    docs, marks = clashing(documents(spark, rows), "score", "held_out"), spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(docs, marks).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(600)) and {i for i in range(600) if got[i].held_out} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert got[900].predicted == 1 and got[901].predicted == got[902].predicted == got[903].predicted == 0 and got[None].predicted == 1
    quoted = toxicity.evidence(toxicity.Automaton({"vermin": 1.0}, {}), 'they said "you vermin" and left')[0]
    assert quoted == toxicity.QUOTED < toxicity.evidence(toxicity.Automaton({"vermin": 1.0}, {}), "you vermin and left")[0]
    assert toxicity.digest(docs.limit(0), marks).collect() == [] and {r.score for r in toxicity.digest(docs, marks.limit(0)).collect()} == {0.0}


def test_quotations():
    given = {'he said "you pig" and left': ["you pig"], 'a 5" pipe, then "you pig", he said': ["you pig"], '"a b." "c d!" e': ["a b.", "c d!"], "“a b” «c» „d e“ f": ["a b", "c", "d e"], "“never closed": [], '"' + "x " * 5000 + 'y" z': ["x " * 5000 + "y"], "": [], '"': [], 'say "“inner” words" now': ["“inner” words"]}
    for text, want in given.items():
        assert [text[a + 1 : b] for a, b in toxicity.quotations(text)] == want, text[:40]


def test_scores_equal_a_slow_scorer(spark):
    """Every hit sought by edit distances to all terms and stems, every window by its words."""
    rng = random.Random(13)
    clean = lambda: [rng.choice(WORDS) + rng.choice(WORDS)[:3] for _ in range(40)]
    bad, rows = ["wretch", "vermin", "nitwitted", "nitwitty", "nitwitish", "nitwits", "nitwitling"], []
    misspelled = lambda w: (lambda i: rng.choice([w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + "q" + w[i + 1 :]]))(rng.randrange(1, len(w)))
    for i in range(500):
        words = clean()
        for _ in range(3 * (i % 5 == 0)):
            w = rng.choice(bad)
            words.insert(rng.randrange(len(words)), misspelled(w) if i % 3 == 2 else f'"{w}"' if i % 3 == 1 else w)
        rows.append((i, " ".join(words), "en", "s", 0))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(500)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    model = toxicity.train(docs, labels)

    def slow_hit(w):
        begun = [v for s, v in model.stems.items() if w.startswith(s)]
        if begun:
            return begun[0]
        if w in model.exceptions:
            return model.terms.get(w, 0.0)
        off = [v for t, v in model.terms.items() if len(t) >= toxicity.LONG and distance(w, t) <= 1]
        off += [v for s, v in model.stems.items() if len(s) >= toxicity.LONG and min(distance(w[:k], s) for k in range(len(w) + 1)) <= 1]
        return max([model.terms.get(w, 0.0), *[toxicity.MISSPELLED * v for v in off]])

    known, seen = {}, collections.Counter()
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    for i, text, *_ in rows:
        words = [w.strip('"') for w in text.split()]
        hits = [known.setdefault(w, slow_hit(w)) for w in words]
        total = 0.0
        for k, h in enumerate(hits):
            near = any(hits[j] for j in range(max(0, k - toxicity.WINDOW), min(len(hits), k + toxicity.WINDOW + 1)) if j != k)
            total += h * (toxicity.BESIDE if near else 1) * (toxicity.QUOTED if text.split()[k][0] == '"' else 1)
            seen["misspelled" if h and words[k] not in bad else "exact"] += h > 0
        assert got[i] == pytest.approx(model.scores([(total, len(words))])[0]), text
    assert model.stems and min(seen.values()) > 20


def test_misspelled_stems_and_lesser_terms():
    rng = random.Random(9)
    word = lambda a, b: "".join(rng.choice("abc") for _ in range(rng.randint(a, b)))
    terms, stems = {word(4, 9): rng.choice([0.3, 0.5, 1.0]) for _ in range(30)}, {"bcbca": 0.9, "aaac": 0.8, "ccabac": 1.0}
    automaton = toxicity.Automaton(terms, stems, every=True)
    for w in {word(1, 9) for _ in range(4000)}:
        off = [v for t, v in terms.items() if len(t) >= toxicity.LONG and distance(w, t) <= 1]
        off += [v for s, v in stems.items() if len(s) >= toxicity.LONG and min(distance(w[:k], s) for k in range(len(w) + 1)) <= 1]
        begun = [v for s, v in stems.items() if w.startswith(s)]
        assert automaton.hit(w) == (begun[0] if begun else max([terms.get(w, 0.0), *[toxicity.MISSPELLED * v for v in off]])), w
        assert automaton.mistaken(w) == (not begun and automaton.hit(w) > terms.get(w, 0.0))
    spared = frozenset(w for w in {word(1, 9) for _ in range(4000)} if automaton.mistaken(w))
    assert spared and all(toxicity.Automaton(terms, stems, spared, every=True).hit(w) == terms.get(w, 0.0) for w in sorted(spared)[:40])


def test_planted_misspellings_and_quotations(spark):
    """Held-out documents whose only abuse is misspelled are caught; those that only quote it, spelled right or not, and clean ones are left alone."""
    rng = random.Random(12)
    clean = lambda: [rng.choice(WORDS) + rng.choice(WORDS)[:3] for _ in range(40)]
    bad = ["wretch", "vermin", "nitwit", "scoundrel", "blockhead"]

    def misspelled(word: str) -> str:
        at, kind = rng.randrange(1, len(word)), rng.randrange(3)
        return word[:at] + ("", "q", "q")[kind] + word[at + (kind != 2) :]

    def spread(words: list[str], of) -> str:
        for _ in range(3):
            words.insert(rng.randrange(len(words)), of())
        return " ".join(words)

    rows = [(i, spread(clean(), lambda: rng.choice(bad)) if i % 5 == 0 else " ".join(clean()), "en", "s", 0) for i in range(600)]
    held = [i for i in range(1000, 1400) if zlib.crc32(str(i).encode()) % 3 == 1][:120]
    off, quoted, plain = held[::3], held[1::3], held[2::3]
    rows += [(i, spread(clean(), lambda: misspelled(rng.choice(bad))), "en", "s", 0) for i in off]
    # one quoted passage a document, every other one misspelled
    rows += [(i, " ".join(clean()) + ' they said "you ' + (bad[k % 5] if k % 2 else misspelled(bad[k % 5])) + '" and left', "en", "s", 0) for k, i in enumerate(quoted)]
    rows += [(i, " ".join(clean()), "en", "s", 0) for i in plain]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(documents(spark, rows), labels).collect()}
    assert all(got[i].held_out for i in held)
    assert sum(got[i].predicted for i in off) >= 0.9 * len(off)
    assert all(got[i].score < toxicity.THRESHOLD for i in [*quoted, *plain])


def test_families_keep_their_misspellings(spark):
    rng = random.Random(10)
    clean = lambda: [rng.choice(WORDS) + rng.choice(WORDS)[:3] for _ in range(40)]
    bad, rows = ["wretch" + end for end in ("", "ed", "es", "edly", "edness", "ing")], []
    for i in range(600):
        words = clean()
        for _ in range(3 * (i % 5 == 0)):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "en", "s", 0))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    model = toxicity.train(documents(spark, rows), labels)
    assert any("wretched".startswith(s) for s in model.stems)  # the case at hand
    off = " ".join([*clean(), "wrwtched", "wetches", "wreetchedness"])
    assert toxicity.scored(documents(spark, [(901, off, "en", "s", 0), (902, " ".join(clean()), "en", "s", 0)]), model).orderBy("doc_id").select("predicted").collect() == [(1,), (0,)]


# chat


def test_chat(spark):
    rows = [(1, 0, "user", "a \\ b </turn> \\l <turn>x"), (1, 1, "assistant", "ok\nfine"), (1, 2, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", "é<"), (3, 5, "odd\nrole<", "t"), (None, 0, "user", "lost"), (1, 1, "assistant", "ok\nfine")]
    rows += [(4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", ""), (5, 0, "user", None), (5, 1, "assistant", "a"), (6, 0, "user", "human"), (6, 1, "user", "x"), (7, None, "user", "first"), (7, 0, "assistant", "second"), (7, 1, "human", "gpt")]
    rows += [(8, i, "assistant" if i % 2 else "user", f"{i}" * (i % 5)) for i in range(700)]  # more than one block of turns
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "turns", "output")
    got = {r.conv_id: r for r in chat.digest(df).collect()}
    talks = collections.defaultdict(list)
    for c, n, role, text in [*rows, (-7, 0, "user", chat.HOSTILE), (-7, 1, "assistant", chat.HOSTILE)]:
        talks[c].append((n, role or "", text or ""))
    assert set(got) == set(talks)
    for c, turns in talks.items():
        turns = sorted(turns, key=lambda t: (t[0] is not None, t))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert [r.conv_id for r in chat.digest(df.limit(0)).collect()] == [-7]
    layouts = chat.canonical(chat.dealt(chat.gathered(df)))
    assert {r.conv_id: r.layout for r in layouts.collect()} == {1: "messages", 2: "exchanges", 3: "messages", 4: "system and prompt", 5: "prompt", 6: "exchanges", 7: "messages", 8: "exchanges", None: "exchanges"}


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 17])
def test_sums_before(spark, n):
    rng = random.Random(n)
    a = [rng.randrange(9) for _ in range(n)]
    assert spark.createDataFrame([(a,)], "a array<long>").select(chat.before(F.col("a"), 4)).first()[0] == [sum(a[:i]) for i in range(n)]


def test_layouts(spark):
    schema = "id int, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, prompt string, response string, completion string, instruction string, input string, output string, system string"
    rows = [(1, [("user", "a"), ("assistant", "b")]) + (None,) * 8, (2, None, [("human", "a"), ("gpt", "b")]) + (None,) * 7, (3, None, None, "a", "b") + (None,) * 5, (4, None, None, "a", None, "b", None, None, None, None), (5,) + (None,) * 5 + ("a", None, "b", None), (6,) + (None,) * 5 + ("a", "i", "b", None), (7, None, None, "a", "b", None, None, None, None, "s"), (8,) + (None,) * 9]
    # more than a layout asks for: the largest that is there, the rest by name
    rows += [(9, None, None, "a", "b", None, "c", None, None, None), (10, [("user", "m")]) + (None,) * 7 + ("s",), (11,) + (None,) * 5 + ("a", None, None, None)]
    made = chat.canonical(spark.createDataFrame(rows, schema)).collect()
    assert {r.id: r.unmapped for r in made if r.unmapped} == {9: ["instruction"], 10: ["system"], 11: ["instruction"]}
    parts = spark.createDataFrame([(1, [("user", [("text", "a"), ("text", None), ("text", "b")]), ("assistant", None)])], "id int, messages array<struct<role:string,content:array<struct<type:string,text:string>>>>")
    assert [(t.role, t.text) for t in chat.canonical(parts).first().turns] == [("user", "ab"), ("assistant", "")]
    got = {r.id: [(t.role, t.text) for t in r.turns] for r in made}
    plain = [("user", "a"), ("assistant", "b")]
    assert got == {1: plain, 2: plain, 3: plain, 4: plain, 5: plain, 6: [("user", "a\n\ni"), ("assistant", "b")], 7: [("system", "s"), *plain], 8: [], 9: plain, 10: [("user", "m")], 11: []}


# URLs


def test_rules(spark):
    given = {"http://A.Example.com/en/1?x#y": ("a.example.com", "/en/1", "example.com/en/", "block"), "https://x.www.example.com/en/": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"), "ftp://com/": ("com", "/", "com/", "allow"), "http://a.net/es/a": ("a.net", "/es/a", "net/es/", "block"), "http://net": ("net", "", None, "allow"), "http://a.net/fr": ("a.net", "/fr", None, "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://x.com?u=://b.net/fr/": ("x.com", "", None, "allow"), "http://notcom/": ("notcom", "/", None, "allow")}
    pages = clashing(spark.createDataFrame(list(enumerate(given)), "page_id long, url string"), "host", "verdict")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.digest(pages, labels).collect()}
    assert got == dict(enumerate(given.values())) and urls.digest(pages.limit(0), labels).collect() == []


def test_templates(spark):
    rows = [("h", f"/news/{i}.html", i % 10 == 0) for i in range(40)] + [("h", f"/spam/{i}", True) for i in range(40)] + [("h", f"/tag/{'abcdefgh'[i % 8]}{'klmnopqrst'[i // 8]}", None) for i in range(80)] + [("other", "/news/1", None)]
    pages = spark.createDataFrame([(f"http://{h}{p}", bad) for h, p, bad in rows], "url string, bad boolean")
    found = {(r.host, r.template): r.rejected for r in urls.templates(pages.select(urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"), "bad")).select("host", "template", "rejected").distinct().collect()}
    assert found == {("h", "news/*.html"): False, ("h", "spam/*"): True, ("h", "tag/*"): False, ("other", "news/*"): False}
    verdicts = {(r.path.split("/")[1], r.verdict) for r in urls.judged(pages, []).collect()}
    assert verdicts == {("news", "allow"), ("spam", "block"), ("tag", "allow")}


def slow_verdicts(pages):
    """The tree by hand: (host, path, bad) to the paths that are rejected."""
    nodes = {(h, p): [re.sub(r"^.*$", lambda m: "*" + (re.search(r"\.[A-Za-z]{1,5}$", m[0]) or [""])[0], s) if re.search(r"\d", s) or len(s) > 40 else s for s in p.split("/") if s] for h, p, _ in pages}

    def z(k, b, ak, ab):
        if not k or not ak - k or not 0 < ab < ak:
            return 0.0
        p = ab / ak
        return abs(b / k - (ab - b) / (ak - k)) / math.sqrt(p * (1 - p) * (1 / k + 1 / (ak - k)))

    def counts(rows):
        return len(rows), sum(b is not None for _, b in rows), sum(bool(b) for _, b in rows)

    for depth in range(max(map(len, nodes.values()))):
        tree = collections.defaultdict(lambda: collections.defaultdict(list))
        for h, p, bad in pages:
            if len(nodes[h, p]) > depth:
                tree[h, tuple(nodes[h, p][:depth])][nodes[h, p][depth]].append(((h, p), bad))
        for children in tree.values():
            every = [r for rows in children.values() for r in rows]
            n, ak, ab = counts(every)
            if len(children) ** 2 <= n:
                continue
            for here, rows in list(children.items()):
                _, k, b = counts(rows)
                shown = "*" if z(k, b, ak, ab) <= urls.Z else urls.TOLD if here == "*" else here
                for key in {r[0] for r in rows}:
                    nodes[key] = [*nodes[key][:depth], shown, *nodes[key][depth + 1 :]]
    by, parents, usual = collections.defaultdict(list), collections.defaultdict(list), counts([(None, b) for *_, b in pages])
    for h, p, bad in pages:
        t = tuple(nodes[h, p])
        by[h, t].append((p, bad))
        parents[h, t[:-1]].append((p, bad))
    branches = collections.defaultdict(list)
    for (h, t), rows in by.items():
        _, k, b = counts(rows)
        _, ak, ab = counts(parents[h, t[:-1]])
        branches[(h, t[:-1], t) if z(k, b, ak, ab) > urls.Z else (h, t[:-1], None)] += rows
    out = {}
    for (h, *_), rows in branches.items():
        _, k, b = counts(rows)
        least = min(usual[2] / usual[1], urls.PURE / 2) if usual[1] else None
        for p, _ in rows:
            out[h, p] = least is not None and (b + urls.PRIOR * least) / (k + urls.PRIOR) >= urls.PURE
    return out


@pytest.mark.parametrize("case", range(3))
def test_tree_by_brute_force_and_sql(spark, case):
    """Random trees of random depth and fan whose labels follow the path; the registered SQL agrees."""
    rng = random.Random(case)
    word = lambda i: "abcdefghij"[i // 10 % 10] + "klmnopqrst"[i % 10]
    pages, marks = [], []
    for i in range(900):
        host, parts = f"h{rng.randrange(3)}", [word(rng.randrange((2, 40)[case % 2])) for _ in range(rng.randint(0, 3 + case))]
        named = rng.random() < 0.8
        if named:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([f"{i}", f"{i}.html"]))
        elif rng.random() < 0.5:
            parts.append(rng.choice([f"{i}abc", "1234567890123456789012", f"x{i}"]))  # name no document
        path = "/" + "/".join(parts)
        bad = sum(map(ord, "".join(p for p in parts if not p[0].isdigit())[:2])) % 3 == 0 if rng.random() < 0.9 else rng.random() < 0.5
        known = named and rng.random() < 0.7
        pages.append((i, f"http://{host}.org{path}", host + ".org", path, bad if known else None))
        if known:
            marks.append((i, int(not bad), 0))
    rows = clashing(spark.createDataFrame([p[:2] for p in pages], "page_id long, url string"), "bad", "named", "page", "first", "by_tree", "host")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = urls.digest(rows, labels)
    slow = slow_verdicts([p[2:] for p in pages])
    found = {r.page_id: r.verdict for r in got.collect()}
    assert found == {p[0]: "block" if slow[p[2], p[3]] else "allow" for p in pages} and set(found.values()) == {"allow", "block"}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [p[:2] for p in pages])
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", marks)
    columns = sorted(got.columns)
    assert sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({urls.ORACLE})").fetchall(), key=str) == sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    whole = urls.judged(urls.labelled(rows, labels), [])
    assert whole.columns == ["page_id", "url", "named", "page", "first", "by_tree", "bad", "host", "path", "rule", "verdict"] and whole.where("page = 'clash' AND first = 'clash'").count() == len(pages)


def test_sections_of_wide_and_deep_trees_are_judged(spark):
    word = lambda i: "abcdefgh"[i // 8] + "klmnopqr"[i % 8]
    rows = [(f"/{word(s)}/{i}", s == 7) for s in range(40) for i in range(25)]  # 40 fixed sections, one wholly bad
    rows += [(f"/wide/{word(s)}{word(i)}/{i}", s == 7) for s in range(40) for i in range(2)]  # too few pages for each: none is told apart
    rows += [(f"/a/b/c/d/{'casino' if i % 2 else 'docs'}/e/f/g/{i}", i % 2 == 1) for i in range(60)]
    # numbers are bad, words aren't
    rows += [(f"/mix/{i}/x" if i % 2 else f"/mix/{word(i)}/x", i % 2 == 1) for i in range(60)]
    for times in (1, 10):  # whatever the size of the table
        pages = spark.createDataFrame([(f"http://h{p}", bad) for p, bad in rows * times], "url string, bad boolean")
        got = urls.judged(pages, []).groupBy("path").agg(F.max("verdict").alias("verdict"), F.first("bad").alias("bad"), F.count_distinct("verdict").alias("n")).collect()
        assert all(r.n == 1 for r in got)
        sure = [r for r in got if not r.path.startswith("/wide")]
        assert {(r.path, r.verdict) for r in sure} == {(r.path, "block" if r.bad else "allow") for r in sure}


# lines


def signed_hash(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def slow_lines(docs, least):
    order = sorted(range(len(docs)), key=lambda r: (docs[r][0] is None, docs[r][0] or 0, signed_hash(docs[r][1]), r))
    seen, gone = collections.defaultdict(list), collections.defaultdict(set)
    said = {r: [] if docs[r][1] is None else docs[r][1].split("\n") for r in order}
    for r in order:
        t = said[r]
        for i, line in enumerate(t):
            best = 0
            for q, j in seen[line]:
                n = 0
                while i + n < len(t) and j + n < len(said[q]) and t[i + n] == said[q][j + n]:
                    n += 1
                best = max(best, n)
            if best and sum(len(x.encode().split()) for x in t[i : i + best]) >= least:
                gone[r].update(range(i, i + best))
            seen[line].append((r, i))
    return [None if docs[r][1] is None else "\n".join(x for i, x in enumerate(said[r]) if i not in gone[r]) for r in range(len(docs))]


@pytest.mark.parametrize("case", range(2))
def test_lines(spark, case):
    rng, docs = random.Random(case), []
    for i in range(90):
        if docs and rng.random() < 0.35:
            text = rng.choice(docs)[1]
            text = None if text is None else "\n".join(x for x in text.split("\n") if rng.random() < 0.92)
        else:
            text = "\n".join(" ".join(rng.choice("ab") for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 30)))
        docs.append((rng.choice([i, 5, None]) if case else i, docs[-1][1] if docs and case and rng.random() < 0.2 else None if rng.random() < 0.03 else text))
    df = spark.createDataFrame([(*d, k, "clash") for k, d in enumerate(docs)], "doc_id long, text string, k int, n_deleted string").coalesce(1)
    helpers = ["late", "doc", "row", "line", "copy", "whole", "spots", "rest", "n", "many"]
    found = lines.deduplicated(clashing(df, *helpers), together=(256, 2)[case])  # in one group, and in groups of groups
    assert found.columns == ["doc_id", "text", "k", *helpers, "n_lines", "n_deleted"]
    got = sorted(found.collect(), key=lambda r: r.k)
    assert all(r[h] == "clash" for r in got for h in helpers)
    want = slow_lines(docs, lines.LEAST_WORDS)
    # which of rows alike in id and text stays is open
    assert collections.Counter((docs[r.k], r.text) for r in got) == collections.Counter(zip(docs, want, strict=True))
    assert all(r.n_lines == (0 if r.text is None else len(docs[r.k][1].split("\n"))) for r in got)


def test_stacks_meet_as_one_scan_would():
    """Partitions put together by twos, and dealt back, begin as one scan of all would."""
    import pandas as pd

    rng = random.Random(14)
    for _ in range(30):
        order = [((0, rng.randrange(50), 0, i), rng.choice([0, 0, 1, 2, 3, 5])) for i in range(40)]
        cuts = sorted({0, *rng.sample(range(1, 40), 7)})
        rows = pd.DataFrame([(*p, lcp, t, bisect.bisect_right(cuts, t) - 1) for t, (p, lcp) in enumerate(order)], columns=[*lines.PLACE, "lcp", "t", "part"])
        found = pd.concat([lines._summary(g.copy()) for _, g in rows.groupby("part")])

        def dealt(found):
            found = found.assign(group=found["part"] // 2)
            above = lines._stacks(0, {}) if found["part"].max() < 2 else dealt(pd.concat([lines._group_summary(g) for _, g in found.groupby("group")]))
            return pd.concat([lines._dealt(g, above[above["part"] == n]) for n, g in found.groupby("group")])

        stacks = dealt(found)
        got = pd.concat([lines._copied(g.copy(), stacks[stacks["part"] == n]) for n, g in rows.groupby("part")])
        places, lcps = [p for p, _ in order], [n for _, n in order]
        want = {p: max([0, *[min(lcps[min(a, b) + 1 : max(a, b) + 1]) for b in range(40) if places[b] < p]]) for a, p in enumerate(places)}
        assert {tuple(r[:4]): r[4] for r in got[[*lines.PLACE, "copied"]].itertuples(index=False)} == want


def test_lines_of_nothing(spark):
    with pytest.raises(TypeError):
        lines.deduplicated(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.deduplicated(empty).collect() == []
    assert [r.text for r in lines.deduplicated(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()] == [None, ""]


# odd ids and labels


def test_items_without_ids_or_with_names_as_ids(spark):
    docs = documents(spark, [(1, "x y a b c d e f g z h i j k l m n w", "en", "s", 0)])
    texts = ["a b c d e f g", "h i j k l m n"]
    some = spark.createDataFrame([(None, texts[0]), (5, texts[1]), (None, texts[1])], "item_id long, text string")
    got = [(r.item_id, r.start_word) for r in decontamination.contaminated(docs, some).collect()]
    assert got[0] == (None, 2) and sorted(got[1:], key=repr) == [(5, 10), (None, 10)]
    assert decontamination.clean(docs, some).count() == 0
    named = spark.createDataFrame([("one", texts[0]), (None, texts[1])], "item_id string, text string")
    assert [r.item_id for r in decontamination.contaminated(docs, named, max_bytes=20).orderBy("start_word").collect()] == ["one", None]
    assert decontamination.clean(docs, named, max_bytes=20).count() == 0


def test_labels_of_absent_documents_take_no_place(spark):
    docs = documents(spark, [(i, f"text {i}", "en", "s", 0) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5000)], "doc_id long, quality int, toxic int")
    found = quality.labelled(docs, labels, "quality", quality.HELD_OUT, 100)
    want = {i for i in range(40) if zlib.crc32(str(i).encode()) % 5}
    assert {r.doc_id for r in found.collect()} == want


def test_integer_ids_are_asked_for(spark):
    with pytest.raises(TypeError):
        vectors.linked(spark.createDataFrame([("a", [1.0], 1)], "vec_id string, embedding array<float>, label int"))


def test_long_numbers_name_documents(spark):
    big = 8_000_000_000_000_000_001
    pages = spark.createDataFrame([(1, f"http://a.com/{big}"), (2, f"http://a.com/{big}0/7"), (3, "http://a.com/2024/7")], "page_id long, url string")
    labels = spark.createDataFrame([(big, 0, 0), (7, 0, 0), (2024, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.page_id: r.bad for r in urls.labelled(pages, labels).collect()} == {1: True, 2: None, 3: False}


def test_what_another_thread_wrote_stays(spark):
    import threading

    from covaria.llm import common

    kept = []
    other = threading.Thread(target=lambda: kept.append(common.cut(spark.range(3))))
    mark = common.written()
    other.start()
    other.join()
    common.cut(spark.range(2))
    common.tidy(spark, mark)
    assert kept[0].count() == 3


def test_mix_meets_its_targets(spark):
    rng = random.Random(7)
    rows = [(i, "w " * (3000 if rng.random() < 0.1 else rng.randint(1, 300)), "en", f"s{rng.randrange(8)}", 0) for i in range(500)]
    rows += [rows[3]] * 5 + [(600, "w " * 2000, "en", "alone", 0), (None, "w " * 2500, "en", "s1", 0), (None, None, "en", None, 0)]
    got = mixing.mix(documents(spark, rows).withColumn("size", mixing.word_count(F.col("text")))).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 3 for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        taken, largest = sum(r.size * r.copies for r in own), max(r.size for r in own)
        assert abs(taken - own[0].target) <= (0.03 * own[0].target if len(own) > 5 else largest)


def test_a_long_path_costs_no_more_rounds_than_a_short_one(spark, monkeypatch):
    rounds = []
    cut = urls.cut
    monkeypatch.setattr(urls, "cut", lambda df: rounds.append(1) or cut(df))
    loop = "/a/b" * 500
    pages = [("x.com", loop + f"/p{chr(97 + i)}", i % 2 == 0) for i in range(12)]  # labelled, parting at their ends
    pages += [("y.com", loop, True)] * 3 + [("y.com", "/c" * 300 + "/d", None)]
    found = {}
    for name, rows in (("long", pages), ("short", [(h, p.replace(loop, "/a/b").replace("/c" * 300, "/c"), b) for h, p, b in pages])):
        rounds.clear()
        df = spark.createDataFrame(rows, "host string, path string, bad boolean")
        found[name] = sorted((r.host, len(r.first) > 4, r.rejected) for r in urls.templates(df, urls.FEWEST).collect()), len(rounds)
    assert found["long"][1] == found["short"][1] <= 8
    assert [r[2] for r in found["long"][0]] == [r[2] for r in found["short"][0]]


def test_a_section_within_a_loop_is_still_rejected(spark):
    loop = "/a/b" * 100
    rows = [("x.com", f"{loop}/bad/{w}/q", True) for w in "abcdefghijklmnopqrstuvwxyz"] + [("x.com", f"{loop}/good/{w}/q", False) for w in "abcdefghijklmnopqrstuvwxyz"]
    found = urls.templates(spark.createDataFrame(rows, "host string, path string, bad boolean")).collect()
    assert len(found) == 52 and all(r.rejected == ("bad" in r.first) for r in found)


def test_subtrees_without_support_change_no_rejection(spark):
    rng = random.Random(13)
    words = [*"abcdef", "x1", "y2.html"]
    rows = []
    for _ in range(3000):
        path = [rng.choice(words[: rng.choice([2, 4, 8])]) for _ in range(rng.randint(0, 6))]
        rows.append((f"h{rng.randrange(3)}.com", "/" + "/".join(path), None if rng.random() < 0.3 else rng.random() < (0.8 if path[:1] == ["b"] or path[1:2] == ["c"] else 0.1)))
    df = spark.createDataFrame(rows, "host string, path string, bad boolean").cache()
    whole, pruned = ({(r.host, tuple(r.first)): r.rejected for r in urls.templates(df, fewest).collect()} for fewest in (0, urls.FEWEST))
    assert whole == pruned and True in whole.values() and False in whole.values()
