"""Numerical kernels against closed forms and independent dense algebra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alloscan.functions import mixed_model as mm
from alloscan.functions import special as sp
from alloscan.functions import stat_columns as sc
from alloscan.operators import pair_scan as ps
from alloscan.operators import relationship as rel
from alloscan.operators import replicates as rp
from alloscan.operators import score_scan as scan


def panel(n=60, m=150, seed=0):
    rng = np.random.default_rng(seed)
    g = rng.binomial(2, rng.uniform(0.1, 0.5, m)[:, None], (m, n)).astype(float)
    g[rng.random((m, n)) < 0.04] = np.nan
    y = rng.standard_normal(n) + 0.5 * np.nan_to_num(g[0])
    return g, y


def kernel(g):
    mu = np.nanmean(g, 1, keepdims=True)
    z = np.where(np.isnan(g), 0, g - mu)
    p = mu[:, 0] / 2
    return z.T @ z / (2 * p * (1 - p)).sum()


def variants(spark, g, parts=3):
    rows = [(i, f"c{i % 3}", [None if np.isnan(x) else float(x) for x in r]) for i, r in enumerate(g)]
    return spark.createDataFrame(rows, "v bigint, chrom string, dosage array<double>").repartition(parts)


def test_special_values():
    assert abs(sp.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(sp.chi2_sf(5.991464547107979, 2) - 0.05) < 1e-12
    assert abs(sp.t_sf2(2.2281388519649385, 10) - 0.05) < 1e-10
    assert abs(sp.f_sf(4.9646027437307145, 1, 10) - 0.05) < 1e-10
    assert abs(sp.beta_ppf(0.5, 2, 2) - 0.5) < 1e-10
    assert abs(sp.t_ppf(0.975, 10) - 2.2281388519649385) < 1e-8
    assert abs(sp.chibar_sf(2.705543454095404, sp.chibar_weights(1)) - 0.05) < 1e-12
    assert sp.chibar_sf(0, sp.chibar_weights(1)) == 1 and abs(sp.chibar_quantile(0.95, sp.chibar_weights(1)) - 2.705543454) < 1e-6
    assert abs(sp.hypergeom_sf(1, 10, 3, 2) - (1 - math.comb(7, 2) / math.comb(10, 2))) < 1e-12
    assert float(sp.chi2_1_sf(np.array([900.0]))[0]) > 0


def test_acat_columns(spark):
    df = spark.createDataFrame([(0.01, 1.0), (0.2, 2.0), (1e-200, 1.0), (1.0, 0.0), (None, 1.0)], "p double, w double")
    r = df.agg(sc.acat(F.col("p")).alias("a"), sc.acat_weighted(F.col("p"), F.col("w")).alias("b")).first()
    assert 0 < r["a"] < 1e-198 and 0 < r["b"] < 1e-198
    one = df.where("p = 0.2").agg(sc.acat(F.col("p")).alias("a")).first()["a"]
    assert abs(one - 0.2) < 1e-12


def test_gram_parts_any_partitioning(spark):
    g, _ = panel()
    want = kernel(g)
    for parts in (1, 5):
        v = variants(spark, g, parts).withColumn("all", F.lit("x"))
        k = rel.dense(rel.grm(rel.gram_parts(v, g.shape[1], "all")), g.shape[1])["x"]
        assert np.allclose(k, want)
    lk = rel.dense(rel.loco(rel.gram_parts(v, g.shape[1], "chrom"), spark.createDataFrame([(f"c{i}", "f") for i in range(3)], "grp string, family string")), g.shape[1])
    for i in range(3):
        assert np.allclose(lk[f"c{i}"], kernel(g[[j for j in range(len(g)) if j % 3 != i]]))


def test_reml_is_a_maximum_and_matches_single(spark):
    g, y = panel()
    k = kernel(g)
    x = np.ones((len(y), 1))
    one, multi = mm.fit_single(y, x, k), mm.fit_reml(y, x, {"K": k}, n_starts=3, seed=1)
    assert abs(one["loglik"] - multi.loglik) < 1e-5
    for f in (0.9, 1.1):
        th = np.array([multi.sigma2["K"] * f, multi.sigma2["e"]])
        assert mm._reml_state(th, [k, np.eye(len(y))], y, x)[0] <= multi.loglik + 1e-9
    ks = {"A": kernel(g[::2]), "B": kernel(g[1::2])}
    a, b = mm.fit_reml(y, x, ks, n_starts=2, seed=3), mm.fit_reml(y, x, dict(reversed(ks.items())), n_starts=2, seed=4)
    assert abs(a.loglik - b.loglik) < 1e-5 and abs(a.pve["A"] - b.pve["A"]) < 1e-3
    with pytest.raises(ValueError):
        mm.fit_reml(y, x, {"K": -k})


def test_scan_equals_gls_and_partitions_do_not_matter(spark):
    g, y = panel()
    k = kernel(g)
    x = np.ones((len(y), 1))
    f = mm.fit_reml(y, x, {"K": k}, seed=1)
    p, py = mm.null_context(y, x, {"K": k}, f.sigma2)
    out = [{r["v"]: r for r in scan.kernel_scan(variants(spark, g, n), {None: (p, py)}, 0.01, 0.5).collect()} for n in (1, 7)]
    vi = np.linalg.inv(f.sigma2["K"] * k + f.sigma2["e"] * np.eye(len(y)))
    for j in (0, 5, 77):
        gi = np.where(np.isnan(g[j]), np.nanmean(g[j]), g[j])
        d = np.column_stack([x, gi])
        b = np.linalg.solve(d.T @ vi @ d, d.T @ vi @ y)
        assert abs(out[0][j]["beta"] - b[1]) < 1e-8
        assert abs(out[0][j]["se"] - np.sqrt(np.linalg.inv(d.T @ vi @ d)[1, 1])) < 1e-8
        assert abs(out[0][j]["chi2"] - out[1][j]["chi2"]) < 1e-9
    with pytest.raises(Exception, match="no null-model context"):
        scan.kernel_scan(variants(spark, g), {"c0": (p, py)}, chrom_col="chrom", keep=["chrom"]).collect()


def test_scan_edge_markers():
    y = np.arange(30.0)
    x = np.ones((30, 1))
    p, py = mm.null_context(y, x, {}, {"e": 1.0})
    g = np.vstack([np.full(30, np.nan), np.ones(30), np.r_[np.full(20, np.nan), [0, 1, 2, 0, 1, 2, 0, 1, 2, 0]], np.r_[[1.0], np.zeros(29)], np.tile([0.0, 1, 2], 10)])
    assert list(scan.score_block(g, p, py, 0.05, 0.9)[7]) == ["zero_var_or_allmiss", "zero_var_or_allmiss", "call_rate", "maf", "ok"]


def test_interaction_matches_least_squares():
    rng = np.random.default_rng(3)
    n = 80
    bx, by = rng.standard_normal((2, 6, n))
    y = rng.standard_normal(n) + 0.6 * bx[0] * by[0]
    beta, t, p = mm.interaction_tests(np.eye(n), y, bx, by)
    for i in range(6):
        d = np.column_stack([np.ones(n), bx[i], by[i], bx[i] * by[i]])
        b, rss = np.linalg.lstsq(d, y, rcond=None)[:2]
        se = np.sqrt(rss[0] / (n - 4) * np.linalg.inv(d.T @ d)[3, 3])
        assert abs(beta[i] - b[3]) < 1e-9 and abs(t[i] - b[3] / se) < 1e-8
    assert p[0] < 1e-4 and mm.interaction_tests(np.eye(n), y, bx[:1], np.zeros((1, n)))[2][0] == 1.0


def burden_frames(spark, n, genes, seed):
    rng = np.random.default_rng(seed)
    vec = {f"g{i}": rng.standard_normal(n) for i in range(genes)}
    vec["flat"] = np.zeros(n)
    b = spark.createDataFrame([(k, v.tolist()) for k, v in vec.items()], "gene string, vec array<double>")
    names = [("g0", "g1"), ("g2", "g3"), ("g4", "g4"), ("g5", "flat")]
    return rng, vec, b, spark.createDataFrame(names, "gene_x string, gene_y string"), names


def rss_of(d, z):
    return float(((z - d @ np.linalg.lstsq(d, z, rcond=None)[0]) ** 2).sum())


def test_conditional_diagnostics_equal_least_squares(spark):
    n = 50
    rng, vec, b, pr, names = burden_frames(spark, n, 6, 5)
    y, c = rng.standard_normal(n), np.column_stack([np.ones(n), rng.standard_normal(n)])
    m = rng.standard_normal((n, n))
    wh = np.linalg.inv(np.linalg.cholesky(m @ m.T / n + np.eye(n)))
    got = {(r["gene_x"], r["gene_y"]): r for r in ps.conditional_diagnostics(pr, b, (wh, y, c)).collect()}
    for x, z in names[:2]:
        r = got[(x, z)]
        cx, cz, ci, c0, yw = wh @ vec[x], wh @ vec[z], wh @ (vec[x] * vec[z]), wh @ c, wh @ y
        null, main, full = c0, np.column_stack([c0, cx, cz]), np.column_stack([c0, cx, cz, ci])
        r0, rm, rf = (rss_of(d, yw) for d in (null, main, full))
        df, dm = n - 5, n - 4
        assert (r["design_rank"], r["estimable"]) == (5, True)
        assert np.isclose(r["beta"], np.linalg.lstsq(full, yw, rcond=None)[0][-1])
        assert np.isclose(r["f_int"], (rm - rf) / (rf / df)) and np.isclose(r["f_int"], r["t"] ** 2) and np.isclose(r["p_f_int"], r["p_wald"])
        assert np.isclose(r["f_main"], (r0 - rm) / 2 / (rm / dm)) and np.isclose(r["f_pair"], (r0 - rf) / 3 / (rf / df)) and r["t_resid_diff"] < 1e-8
        shared = 1 - rss_of(main, ci) / rss_of(null, ci)
        assert np.isclose(r["r2_int_marg"], shared) and np.isclose(r["vif_int"], 1 / (1 - shared))
        assert np.isclose(r["corr_int_x"], np.corrcoef(ci, cx)[0, 1]) and np.isclose(r["corr_int_y"], np.corrcoef(ci, cz)[0, 1])
        for col, alone, joint in ((cx, "p_x_alone", "p_x_joint"), (cz, "p_y_alone", "p_y_joint")):
            one, other = np.column_stack([c0, col]), np.column_stack([c0, cz if col is cx else cx])
            r1 = rss_of(one, yw)
            assert np.isclose(r[alone], sp.f_sf((r0 - r1) / (r1 / (n - 3)), 1, n - 3))
            assert np.isclose(r[joint], sp.f_sf((rss_of(other, yw) - rm) / (rm / dm), 1, dm))
    assert not got[("g4", "g4")]["estimable"] and not got[("g5", "flat")]["estimable"] and got[("g5", "flat")]["design_rank"] == 3


def test_dosage_balance_equals_least_squares(spark):
    n = 45
    rng, vec, b, pr, names = burden_frames(spark, n, 6, 9)
    y = rng.standard_normal(n) + vec["g0"] + vec["g1"] + 2 * vec["g2"] * vec["g3"]
    got = {(r["gene_x"], r["gene_y"]): r for r in ps.dosage_balance(pr, b, (np.eye(n), y, None)).collect()}
    for x, z in names[:2]:
        d = np.column_stack([np.ones(n), (vec[x] + vec[z]) / 2 ** 0.5, (vec[x] - vec[z]) / 2 ** 0.5, vec[x] * vec[z]])
        want = np.linalg.lstsq(d, y, rcond=None)[0][1:]
        r = got[(x, z)]
        assert np.allclose([r["b_s"], r["b_i"], r["b_q"]], want)
        for j, k in enumerate("siq"):
            f = (rss_of(np.delete(d, j + 1, 1), y) - rss_of(d, y)) / (rss_of(d, y) / (n - 4))
            assert np.isclose(r[f"p_{k}"], sp.f_sf(f, 1, n - 4))
    assert got[("g0", "g1")]["architecture"] == "dosage_S" and got[("g2", "g3")]["architecture"] == "epistasis_Q"


@pytest.mark.parametrize("refit", [False, True])
def test_leave_one_out_whitens_what_is_left(spark, refit):
    n = 16
    rng, vec, b, pr, names = burden_frames(spark, n, 6, 2)
    g = rng.standard_normal((n, 40))
    k = {"A": g @ g.T / 40}
    x = np.ones((n, 1))
    y = rng.standard_normal(n) + 0.5 * vec["g0"] * vec["g1"]
    got = {(r["gene_x"], r["gene_y"]): r for r in ps.leave_one_out(pr, b, (y, x), k, refit=refit).collect()}
    fit = mm.fit_reml(y, x, k, n_starts=3, seed=42)

    def tests(keep, cv):
        v = cv["A"] * k["A"][np.ix_(keep, keep)] + max(cv["e"], 1e-6) * np.eye(len(keep))
        values, vectors = np.linalg.eigh(v)
        root = (vectors / np.sqrt(values)) @ vectors.T  # another root of the same inverse
        return mm.interaction_tests(root, y[keep], *(np.stack([vec[p[j]][keep] for p in names[:2]]) for j in (0, 1)))
    whole = tests(np.arange(n), fit.component_var)
    each = []
    for i in range(n):
        keep = np.delete(np.arange(n), i)
        cv = mm.fit_reml(y[keep], x[keep], {"A": k["A"][np.ix_(keep, keep)]}, n_starts=3, seed=42).component_var if refit else fit.component_var
        each.append(tests(keep, cv))
    for j, name in enumerate(names[:2]):
        p, move = np.array([e[2][j] for e in each]), np.abs(np.array([e[0][j] for e in each]) - whole[0][j])
        r = got[name]
        assert np.isclose(r["p_all"], whole[2][j], rtol=1e-6) and np.isclose(r["p_max"], p.max(), rtol=1e-5) and np.isclose(r["p_min"], p.min(), rtol=1e-5)
        assert r["worst_sample"] == p.argmax() and np.isclose(r["dfbeta_max"], move.max(), rtol=1e-5) and r["dfbeta_sample"] == move.argmax()


def test_covariates_and_dependence():
    g, _ = panel(n=30, m=60, seed=4)
    k = {"A": kernel(g)}
    c = mm.covariates(k, 30, 3)
    assert c.shape == (30, 4) and np.allclose(c[:, 1:].std(0), 1) and mm.covariates(k, 30) is None
    values, vectors = np.linalg.eigh(k["A"])
    assert np.allclose(np.abs(np.corrcoef(c[:, 1], vectors[:, -1])[0, 1]), 1)
    with pytest.raises(ValueError):
        mm.covariates(k, 30, 0, np.column_stack([np.arange(30.0), 2 * np.arange(30.0) + 1]))


def test_tier_is_matched_with_rows_outside_it(spark):
    from alloscan.operators.expression import stratum_enrichment
    # two strata; the tier has the highest values, so its own rows would pull the null up
    rows = [(i, i % 2, i / 100, i >= 90) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, stratum int, pct double, top boolean")
    r = stratum_enrichment(df, 200).first()
    outside = np.mean([p for _, _, p, t in rows if not t])
    assert not r["infeasible"] and r["n_top"] == 10 and abs(r["null_mean"] - outside) < 0.03 and r["p_two_sided"] < 0.02
    few = spark.createDataFrame([(i, 0, i / 10, i >= 4) for i in range(10)], "id bigint, stratum int, pct double, top boolean")
    r = stratum_enrichment(few, 20).first()
    assert r["infeasible"] and r["null_mean"] is None and r["observed"] is not None


def test_fold_bootstrap_resamples_folds(spark):
    rng = np.random.default_rng(1)
    diff = rng.normal(0.02, 0.1, 20)
    rows = [(i // 5, i % 5, t, 0.3 + (float(diff[i]) if t == "tier1" else 0.0)) for i in range(20) for t in ("tier0", "tier1", "tier2")]
    out = {r["tier"]: r for r in rp.paired_fold_bootstrap(spark.createDataFrame(rows, "repeat bigint, fold bigint, tier string, r2 double"), 2000).collect()}
    own = np.array([diff[rng.integers(0, 20, 20)].mean() for _ in range(4000)])
    assert abs(out["tier1"]["lo"] - np.quantile(own, 0.025)) < 0.012 and abs(out["tier1"]["hi"] - np.quantile(own, 0.975)) < 0.012
    assert abs(out["tier2"]["hi"]) < 1e-12


def test_permutation_detects_planted_pair(spark):
    rng = np.random.default_rng(8)
    n = 60
    vec = {f"g{i}": rng.standard_normal(n) for i in range(8)}
    b = spark.createDataFrame([(k, v.tolist()) for k, v in vec.items()], "gene string, vec array<double>")
    pr = spark.createDataFrame([(f"g{2 * i}", f"g{2 * i + 1}") for i in range(4)], "gene_x string, gene_y string")
    y = rng.standard_normal(n) + 2 * vec["g0"] * vec["g1"]
    g, _ = panel(n)
    r = ps.permutation_summary(pr, b, {"t": y}, np.ones((n, 1)), {"K": kernel(g)}, n_perm=12).first()
    assert r["acat_obs"] < 1e-6 and abs(r["acat_emp"] - 1 / 13) < 1e-12 and r["n_perm"] == 12


@pytest.mark.parametrize("n_pairs,flat", [(9, False), (10, True)])
def test_permutation_summary_equals_all_rows(spark, n_pairs, flat):
    """Two traits, odd and even counts, ties at p = 1 (flat burdens): folded blocks against every (replicate, pair) row."""
    rng = np.random.default_rng(5)
    n, n_perm = 40, 6
    vec = {f"g{i}": rng.standard_normal(n) if i % 5 or not flat else np.zeros(n) for i in range(2 * n_pairs)}
    pr = [(f"g{2 * i}", f"g{2 * i + 1}") for i in range(n_pairs)]
    y = {"a": rng.standard_normal(n), "b": rng.standard_normal(n)}
    g, _ = panel(n)
    k, x = {"K": kernel(g)}, np.ones((n, 1))
    b = spark.createDataFrame([(i, v.tolist()) for i, v in vec.items()], "gene string, vec array<double>")
    got = ps.permutation_summary(spark.createDataFrame(pr, "gene_x string, gene_y string").repartition(3), b, y, x, k, n_perm).first()
    bx, by = (np.stack([vec[p[i]] for p in pr]) for i in (0, 1))
    rows = []
    for rep in range(n_perm + 1):
        terms = []
        for v in y.values():
            if rep:
                v = v.mean() + (v - v.mean())[np.random.default_rng(900_000 + rep - 1).permutation(n)]
            f = mm.fit_reml(v, x, k, n_starts=3, seed=(900_000 + rep - 1) % 100000 if rep else 1)
            cv = list(f.component_var.values())
            w, q = np.linalg.eigh(max(cv[-1], 1e-6) * np.eye(n) + cv[0] * k["K"])
            p = mm.interaction_tests((q / np.sqrt(np.clip(w, 1e-10, None))) @ q.T, v, bx, by, None)[2]
            terms.append(np.tan((0.5 - np.clip(np.where(np.isfinite(p), p, 1.0), 1e-300, 1 - 1e-16)) * np.pi))
        p = 0.5 - np.arctan(np.mean(terms, axis=0)) / np.pi
        acat = 0.5 - np.arctan(np.mean(np.tan((0.5 - np.minimum(p, 1 - 1e-16)) * np.pi))) / np.pi
        rows.append((acat, p.min(), np.median(sp.norm_ppf(p / 2) ** 2) / sp.CHI2_1_MEDIAN))
    obs, null = rows[0], np.array(rows[1:])
    assert got["n_pairs"] == n_pairs and got["n_perm"] == n_perm
    assert np.allclose([got["acat_obs"], got["min_p_obs"], got["lambda_obs"]], obs, rtol=1e-6, atol=1e-9)
    assert np.isclose(got["lambda_perm_median"], np.median(null[:, 2]), rtol=1e-6, atol=1e-9)
    if not flat:  # one p of 1 puts every combined p at 1 but for rounding
        assert np.isclose(got["acat_emp"], (1 + (null[:, 0] <= obs[0]).sum()) / (n_perm + 1))
    assert np.isclose(got["min_p_emp"], (1 + (null[:, 1] <= obs[1]).sum()) / (n_perm + 1))


def test_fan_out_is_reproducible(spark):
    g, y = panel(40)
    k = {"A": kernel(g[::2]), "B": kernel(g[1::2])}
    x = np.ones((len(y), 1))
    a = rp.bootstrap_lrt(spark, y, x, k, ["A"], ["A", "B"], 6).first()
    assert a == rp.bootstrap_lrt(spark, y, x, k, ["A"], ["A", "B"], 6).first()
    m = rp.nested_models(spark, y, x, k)
    assert m.count() == 4
    t = rp.boundary_tests(m)
    assert {(r["null_model"], r["alt_model"]) for r in t.collect()} == {("null", "A"), ("null", "B"), ("null", "A+B"), ("A", "A+B"), ("B", "A+B")}
    assert all(0 <= r["p_value"] <= 1 for r in t.collect())


def test_folds_balance_and_arms_sum_to_one(spark):
    y = np.random.default_rng(1).standard_normal(53)
    f = rp.stratified_fold_of(y, 5, 1)
    assert sorted(np.unique(f)) == [0, 1, 2, 3, 4] and np.bincount(f).max() - np.bincount(f).min() <= 5
    g, _ = panel(40)
    k = {"A": kernel(g[::2]), "B": kernel(g[1::2])}
    z = {s: np.nan_to_num(g[i:i + 4] - np.nanmean(g[i:i + 4], 1, keepdims=True)).T for i, s in enumerate(k)}
    s = rp.simulate_arms(spark, k, z, 2).groupBy("arm").count()
    assert s.count() == 6 and all(r["count"] == 14 for r in s.collect())


def test_poisson_band_wilson(spark):
    from alloscan.operators import design as d
    r = spark.range(1).select(sc.poisson_sf(4, F.lit(3.0)).alias("p"), d.band(F.lit(300)).alias("b"), *[c.alias(n) for c, n in zip(sc.wilson(F.lit(5), F.lit(100)), "lh")]).first()
    assert abs(r["p"] - (1 - sum(math.exp(-3) * 3 ** i / math.factorial(i) for i in range(4)))) < 1e-12
    assert r["b"] == "discovery-feasible"
    # the score limits are the roots of |p - x| = z sqrt(x (1 - x) / n)
    for x in (r["l"], r["h"]):
        assert abs(abs(0.05 - x) - 1.959963984540054 * math.sqrt(x * (1 - x) / 100)) < 1e-12
    assert r["l"] < 0.05 < r["h"]


@pytest.mark.parametrize("spread", [6.0, 0.0])
def test_enrichment_draws_equal_a_whole_order(spark, monkeypatch, spread):
    """Draws by hash borders are those of ordering every row; borders that miss are made good."""
    from alloscan.operators import expression as ex
    monkeypatch.setattr(ex, "SPREAD", spread)
    rows = [(i, i % 3, (i * 37 % 101) / 101, i % 7 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, stratum bigint, pct double, top boolean").repartition(4)
    reps = 150
    h = spark.createDataFrame([(r, i) for r in range(1, reps + 1) for i in range(400)], "rep int, id bigint").selectExpr("rep", "id", "xxhash64(7, rep, id) AS h")
    h = {(x.rep, x.id): x.h for x in h.collect()}
    means = []
    for r in range(1, reps + 1):
        drawn = []
        for s in range(3):
            k = sum(t for _, z, _, t in rows if z == s)
            drawn += [p for _, p in sorted((h[r, i], p) for i, z, p, t in rows if z == s and not t)[:k]]
        means.append(np.mean(drawn))
    got = ex.stratum_enrichment(df, reps).first()
    assert got.n_perm == reps and got.null_mean == pytest.approx(np.mean(means), abs=1e-12) and got.null_sd == pytest.approx(np.std(means, ddof=1), abs=1e-12)


def test_closed_form_of_interaction_p():
    rng = np.random.default_rng(8)
    n = 40
    wh, y = np.linalg.inv(np.linalg.cholesky(np.cov(rng.standard_normal((n, 90))))), rng.standard_normal(n)
    bx, by = rng.standard_normal((500, n)), rng.standard_normal((500, n))
    by[0], by[1], bx[2], by[3] = bx[0], bx[1] + 1e-9 * by[1], 0.0, bx[3] + 0.01 * by[3]
    bx[4] = by[4] * 0 + y / np.where(np.abs(by[4]) > 0.1, by[4], 1)  # a product close to the trait
    for c in (None, np.column_stack([np.ones(n), rng.standard_normal((n, 3))])):
        want = mm.interaction_tests(wh, y, bx, by, c)[2]
        assert np.allclose(mm.interaction_p(wh, y, bx, by, c), want, rtol=1e-7, atol=0)
    for df in (2, 3, 5, 36, 37):
        t = np.concatenate([[0.0], rng.standard_normal(300) * 4, [60.0, -1e6]])
        assert np.allclose(sp.t_sf2_whole(t, df), sp.t_sf2(t, df), rtol=1e-9, atol=0)
