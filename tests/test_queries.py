"""Registered queries run, and return what their SQL says."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from covaria import oracles, queries

SF = "/root/testdata/sf0.01"
FEW = ["coh", "wpli2_debiased", "psi_bands", "coh_multitaper", "plv_time", "envcorr_pairwise", "wsmi_k3", "var1_dynamic", "conn_topn", "surrogate_evoked", "mim_2x2", "mim_rank", "gc_rank_pairs", "cacoh_multi", "var_fb_pairs", "symmetric_orth_pairs", "wsmi_antialias", "events_coupled"]


@pytest.mark.parametrize("name", FEW)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "embeddings", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLES[name]})").fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 110
    assert set(oracles.ORACLES) <= set(queries.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_autoregressions_without_sql_take_every_channel(spark):
    sf = SF.replace("0.01", "0.001")
    x = {}
    for r in queries.days(spark, sf).collect():
        x.setdefault(r.epoch, {})[r.ch] = r.x
    x = {e: np.array([v[c] for c in sorted(v)]) for e, v in x.items()}
    k = len(next(iter(x.values())))
    assert k > 3
    fitted = lambda v, p: np.linalg.lstsq(np.concatenate([v[:, p - i : v.shape[1] - i] for i in range(1, p + 1)]).T, v[:, p:].T, rcond=None)[0].T
    got = {(r.epoch, r.i, r.j, r.lag): r.value for r in queries.QUERIES["var_p_dynamic"](spark, sf).collect()}
    want = {e: fitted(v, 2) for e, v in x.items()}
    assert got == {(e, i, j, lag): pytest.approx(a[i, j + (lag - 1) * k], abs=1e-4) for e, a in want.items() for i in range(k) for j in range(k) for lag in (1, 2)}
    got = {(r.epoch, r.row, r.col): r.value for r in queries.QUERIES["var_companion"](spark, sf).where(f"row < {k}").collect()}
    assert got == {(e, i, j): pytest.approx(a[i, j], abs=1e-4) for e, a in want.items() for i in range(k) for j in range(2 * k)}
    assert {(r.i, r.j) for r in queries.QUERIES["var_fb"](spark, sf).collect()} == {(i, j) for i in range(k) for j in range(k)}
    assert {r.ch for r in queries.QUERIES["var_simulate"](spark, sf).collect()} == set(range(k))


def test_order_criteria_take_every_day_of_a_quarter(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(queries.autoregression, "select_order", lambda x, lags: seen.setdefault("x", x).selectExpr("epoch"))
    queries.QUERIES["select_order_criteria"](spark, SF)
    got = seen["x"].selectExpr("epoch", "size(x) AS n", "aggregate(x, 0D, (s, v) -> s + v) AS total").collect()
    whole = queries.table(spark, SF, "orders").selectExpr("sum(o_totalprice)").first()[0]
    assert sum(r.total for r in got) == pytest.approx(whole)
    assert all(r.n == (92 if r.epoch % 4 in (3, 0) else 91 if r.epoch % 4 == 2 or (r.epoch - 1) // 4 % 4 == 0 else 90) for r in got)
