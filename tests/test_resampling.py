"""Permuted priors and paired bootstraps against plain versions."""

import numpy as np
import pytest

from alloscan.operators import candidates as cd
from alloscan.operators import resampling as rs


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000, 4097])
def test_bijection_and_its_inverse(n):
    x = np.arange(n)
    y = rs.bijection(x, n, 3, 5)
    assert sorted(y.tolist()) == x.tolist() and (rs.bijection(y, n, 3, 5, inverse=True) == x).all()
    if n > 60:
        assert (y != rs.bijection(x, n, 3, 6)).mean() > 0.9 and abs(np.corrcoef(x, y)[0, 1]) < 0.5


def test_places_are_uniform():
    at = np.array([rs.bijection(np.array([0, 7]), 50, 1, r) for r in range(4000)])
    for k in (0, 1):
        n = np.bincount(at[:, k], minlength=50)
        assert ((n - 80) ** 2 / 80).sum() < 90  # 49 degrees of freedom: p about 3e-4


def _plain(zg, zl, qtl, m, top):
    """Nested lift from the whole permuted table."""
    rec = {b: {q for q in qtl[np.argsort(-(zg + b * zl), kind="stable")[:top]] if q is not None} for b in cd.BETA_GRID}
    out = 0
    for q in set().union(*rec.values()):
        rest = {b: len(v - {q}) for b, v in rec.items()}
        best = max(rest, key=rest.get)
        b = cd.BETA_DEFAULT if rest[best] <= rest[0.0] or m - 1 < 5 else best
        out += (q in rec[b]) - (q in rec[0.0])
    return out / m


def _cand(n, n_qtl, seed=4):
    rng = np.random.default_rng(seed)
    zg, zl = rng.standard_normal(n), np.abs(rng.standard_normal(n))
    return [(i, float(zg[i]), None if i % 9 == 0 else float(zl[i]), f"q{i % n_qtl}", bool(i % 5 < 2)) for i in range(n)]


DDL = "id bigint, z_gwas double, z_llr_abs double, qtl string, in_window boolean"


@pytest.mark.parametrize("n_qtl", [4, 40])
def test_permuted_lifts_equal_the_whole_table(spark, n_qtl):
    n, top = 1500, 6
    rows = _cand(n, n_qtl)
    got = {r["rep"]: r["lift"] for r in rs.permuted_lifts(spark.createDataFrame(rows, DDL).repartition(5), top, 25, seed=2).collect()}
    scored = sorted((r for r in rows if r[2] is not None), key=lambda r: (-r[1], r[0]))
    prior = np.sort([r[2] for r in scored])[::-1]
    none = sorted((r for r in rows if r[2] is None), key=lambda r: (-r[1], r[0]))
    m = len({r[3] for r in rows if r[4]})
    qtl = np.array([r[3] if r[4] else None for r in scored + none], dtype=object)
    zg = np.array([r[1] for r in scored + none])
    assert len(got) == 25
    for rep, lift in got.items():
        zl = np.concatenate([prior[rs.bijection(np.arange(len(scored)), len(scored), 2, rep)], np.zeros(len(none))])
        assert abs(lift - _plain(zg, zl, qtl, m, top)) < 1e-12
        assert len(rs.permuted_pairs(len(scored), top, rep, 2)[0]) < 500  # not the table


def test_prior_lift_row(spark):
    rows = _cand(900, 30)
    # priors that point at the rows in windows
    rows = [(i, g, (l or 0.0) + (6 if w else 0), q, w) for i, g, l, q, w in rows]
    df = spark.createDataFrame(rows, DDL)
    r = rs.prior_lift(df, 12, 99, 500).first()
    own = [x["hit_fused"] - x["hit_gwas"] for x in cd.nested_lift(cd.recovered_by_beta(df, 12), df.where("in_window").select("qtl").distinct()).collect()]
    assert abs(r["lift"] - np.mean(own)) < 1e-12 and r["n_recoverable"] == len(own) and r["n_perm"] == 99 and not r["locked"]
    assert r["lo"] <= r["lift"] <= r["hi"] and 0.01 <= r["p_perm"] <= 1 and r["null_q50"] <= r["null_q95"] <= r["null_q99"]
    empty = df.where("id < 0")
    assert rs.permuted_lifts(empty, 5, 3).count() == 0 and rs.prior_lift(empty, 5, 3, 10).count() == 0


def test_paired_bootstrap_equals_resampled_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    d = {"a": np.round(rng.normal(0.05, 0.3, 400), 2), "b": np.round(rng.normal(0, 1, 50), 1)}
    rows = [(k, float(v)) for k, x in d.items() for v in x] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "arm string, d double")
    monkeypatch.setattr(rs, "BLOCK", 40)  # several blocks
    out = {r["arm"]: r for r in rs.paired_bootstrap(df, ["arm"], "d", 4000).collect()}
    again = {r["arm"]: r for r in rs.paired_bootstrap(df.repartition(11), ["arm"], "d", 4000).collect()}
    assert set(out) == {"a", "b"}
    for k, x in d.items():
        own = x[rng.integers(0, len(x), (6000, len(x)))].mean(1)
        r, sd = out[k], x.std() / np.sqrt(len(x))
        assert r["n"] == len(x) and abs(r["delta"] - x.mean()) < 1e-12
        assert abs(r["lo"] - np.quantile(own, 0.025)) < 0.15 * sd and abs(r["hi"] - np.quantile(own, 0.975)) < 0.15 * sd
        assert abs(r["p"] - (own <= 0).mean()) < 0.03
        assert all(abs(r[c] - again[k][c]) < 1e-12 for c in ("delta", "lo", "hi", "p"))


def test_permuted_pairs_are_never_broadcast(spark):
    c = spark.createDataFrame([(i, float(i % 7), float(i % 5), "a", True) for i in range(50)], "id bigint, z_gwas double, z_llr_abs double, qtl string, in_window boolean")
    plan = rs.permuted_lifts(c, 5, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


def test_signed_rank_score_of_many_differences(spark):
    from alloscan.catalog.expression_queries import signed_rank_z
    n = 4_000_000  # n (n + 1) (2 n + 1) is beyond a bigint
    g = spark.createDataFrame([(n, n * (n + 1) / 4 + 1e9, 0.0)], "n bigint, w double, tie double")
    assert signed_rank_z(g).first()["z"] == pytest.approx(1e9 / (n * (n + 1.0) * (2 * n + 1) / 24) ** 0.5)
