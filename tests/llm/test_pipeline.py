"""The pipeline's stages, each on what the one before kept, and the registered SQL."""

import collections

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from covaria.llm import common, decontamination, simhash
from covaria.llm.queries import ORACLES

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert i == 4 or docs.columns == columns, name
        kept.append([(r.doc_id, r.text, r.source) for r in docs.collect()])
    judged = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = {d for d, _, _ in kept[0]}
    assert sum(d in first for d, q in judged.items() if q == 1) >= 0.98 * sum(judged.values())
    assert sum(d in first for d, q in judged.items() if q == 0) <= 0.1 * sum(q == 0 for q in judged.values())
    prints = [simhash.fingerprint_of(t) for _, t, _ in kept[1]]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    index = decontamination.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert {d for d, _, _ in kept[2]} == {d for d, t, _ in kept[1] if not index.matches(t)}
    assert {d for d, _, _ in kept[3]} <= {d for d, _, _ in kept[2]} and max(collections.Counter(d for d, _, _ in kept[3]).values()) <= 3
    assert sorted(kept[4]) == sorted(kept[3])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


HELPERS = ["_size", "_copy", "doc", "k1", "k2", "many", "copies", "at", "fp", "digest", "late", "found", "score", "predicted", "held_out", "shares"]


def test_stages_on_odd_rows(spark):
    """Repeated ids and rows, nulls, a very long text, and columns named like those that operators add on the way."""
    rows = [(i, f"some words number {i} and a few more of them {i * 7}", "en", "a", 0, "x") for i in range(40)]
    rows += [(100, None, None, None, None, None), (101, "", "en", "b", 0, ""), (None, "no id", "en", None, 1, ""), (102, "word " * 40_000, "en", "c", 0, ""), rows[3], rows[3], (3, "the id of another, and words of its own", "en", "a", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, more string")
    docs = docs.selectExpr("*", *[f"'clash' AS {h}" for h in HELPERS])
    given = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        if name == "sharding":
            assert made.columns == [*docs.columns, "size", "shard", "slot"]
        else:
            assert made.columns == docs.columns, name
        kept = made.collect()
        assert kept and all(r[h] == "clash" for r in kept for h in HELPERS), name
        found = collections.Counter((r.doc_id, r.text) for r in kept)
        if name == "sharding":
            assert found == given
        elif name == "SimHash near-dedup":
            prints = {(d, t): simhash.fingerprint_of(t) for d, t in given}
            parts = {k: frozenset(o for o in prints if (prints[k] ^ prints[o]).bit_count() <= 3) for k in prints}
            assert set(found.values()) == {1} and {simhash.fingerprint_of(t) for _, t in found} <= set(prints.values())
            assert (3, "the id of another, and words of its own") in found and all(sum(o in found for o in part) <= 1 for part in parts.values())
        elif name == "mixing":
            assert set(found) <= set(given)
        else:
            assert all(n == given[k] for k, n in found.items()), name
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_run_leaves_no_tables_behind(spark):
    """The rows of run are those of the stages one after another, and only what the last stage reads is left."""
    before = common.written()
    rows = corpus_pipeline.run(spark, SF).collect()
    left = common.written() - before
    assert len(rows) == len({(r.shard, r.slot) for r in rows}) and {r.shard for r in rows} == set(range(16))
    common.tidy(spark)
    assert common.written() == 0 and left < 12
