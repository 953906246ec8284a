"""Homolog kernels without a chromosome, leave-one-out, thinning and matched controls against brute force."""

import numpy as np
import pytest

from alloscan.functions import mixed_model as mm
from alloscan.operators import design as ds
from alloscan.operators import expression as ex
from alloscan.operators import local_structure as ls
from alloscan.operators import pair_scan as ps
from alloscan.operators import relationship as rel
from alloscan.operators import score_scan as scan
from test_models import kernel, panel


@pytest.mark.parametrize("mode", ["hadamard", "mean"])
def test_homolog_kernel_without_a_chromosome_equals_dense_algebra(spark, mode):
    n, m = 40, 180
    g, y = panel(n, m, seed=2)
    of = [(f"c{c}", "ABD"[c // 2]) for c in range(6)]
    rows = [(i, f"c{i % 6}", "ABD"[i % 6 // 2], [None if np.isnan(x) else float(x) for x in r]) for i, r in enumerate(g)]
    v = spark.createDataFrame(rows, "v bigint, chrom string, sub string, dosage array<double>").repartition(4)
    left = rel.loco(rel.gram_parts(v, n, "chrom"), spark.createDataFrame(of, "grp string, family string"))
    full = rel.grm(rel.gram_parts(v, n, "sub"))
    got = rel.dense(rel.loco_homolog(left, full, ["A", "B", "D"], "auto", 3 if mode == "hadamard" else 2), n)
    sub = {s: kernel(g[[i for i in range(m) if "ABD"[i % 6 // 2] == s]]) for s in "ABD"}
    contexts = {}
    for chrom, s in of:
        own = {**sub, s: kernel(g[[i for i in range(m) if "ABD"[i % 6 // 2] == s and f"c{i % 6}" != chrom]])}
        want = mm.homolog_kernel(own, "auto", 3 if mode == "hadamard" else 2)
        assert np.allclose(got[chrom], want)
        contexts[chrom] = mm.null_context(y, np.ones((n, 1)), {**own, "K_hom": want}, {"A": 0.3, "B": 0.2, "D": 0.1, "K_hom": 0.2, "e": 0.5})
    one_by_one = scan.kernel_scan(v, ((c, x) for c, x in contexts.items()), chrom_col="chrom", keep=["chrom"]).collect()
    for r in one_by_one:
        if r["status"] == "ok":
            x = g[r["v"]]
            x = np.where(np.isnan(x), np.nanmean(x), x)
            p, py = contexts[r["chrom"]]
            assert np.isclose(r["chi2"], (x @ py) ** 2 / (x @ p @ x))
    assert rel.loco_homolog(left, full, ["A"]) is None


def burden(z):
    b = z.sum(0)
    return (b - b.mean()) / b.std() if b.std() > 1e-12 else b * 0


def test_floors_and_markers_left_out(spark):
    rng = np.random.default_rng(3)
    n, m = 30, 14
    maf = np.array([0.03, 0.3, 0.4, 0.08, 0.02, 0.25, 0.35, 0.06, 0.3, 0.2, 0.4, 0.3, 0.02, 0.07])
    g = np.minimum(2, rng.binomial(2, maf[:, None], (m, n)))
    g[:, 0] = 1
    gene = [f"g{i // 3}" for i in range(m)]  # the last gene has two markers
    seen = rng.random((m, n)) > 0.05
    calls = spark.createDataFrame([(i, j, int(g[i, j])) for i in range(m) for j in range(n) if seen[i, j]], "v bigint, s bigint, d bigint").repartition(3)
    from alloscan.operators import genotype as gt
    stats = gt.allele_stats(calls, n)
    genes = spark.createDataFrame([(i, x) for i, x in enumerate(gene)], "v bigint, gene string")
    pairs = spark.createDataFrame([("g0", "g1"), ("g2", "g4"), ("g1", "g3")], "gene_x string, gene_y string")
    y = rng.standard_normal(n)
    wh = np.eye(n) + 0.1 * np.tril(rng.standard_normal((n, n)), -1)
    f = np.where(seen, g, 0).sum(1) / seen.sum(1)
    z = np.where(seen, (g - f[:, None]), 0.0)
    z = z / np.sqrt((z * z).mean(1))[:, None]
    af = np.minimum(f / 2, 1 - f / 2)
    of = lambda name, keep: np.array([i for i in range(m) if gene[i] == name and keep(i)], int)
    test = lambda a, b: [x[0] for x in mm.interaction_tests(wh, y, burden(z[a])[None], burden(z[b])[None])]

    def same(r, a, b):
        beta, _, p = test(a, b)
        assert np.isclose(r["p"], p) and (np.isclose(r["beta"], beta) if r["beta"] is not None else np.isnan(beta)), (r, beta, p, a, b)
    got = ps.frequency_floors(pairs, calls, stats, genes, list(range(n)), (wh, y, None)).collect()
    assert len(got) == 9
    for r in got:
        a, b = of(r["gene_x"], lambda i: af[i] >= r["floor"]), of(r["gene_y"], lambda i: af[i] >= r["floor"])
        assert (r["n_snp_x"], r["n_snp_y"]) == (len(a), len(b))
        if len(a) and len(b):
            same(r, a, b)
        else:
            assert r["p"] is None
    got = ps.leave_one_marker_out(pairs, calls, stats, genes, list(range(n)), (wh, y, None)).collect()
    assert len(got) == sum(gene.count(x) for p in (("g0", "g1"), ("g2", "g4"), ("g1", "g3")) for x in p)
    for r in got:
        keep = lambda i: i != r["v"]
        a, b = of(r["gene_x"], keep), of(r["gene_y"], keep)
        same(r, a, b)
        assert r["n_left"] == (len(a) if r["side"] == "x" else len(b))
    alone = ps.leave_one_marker_out(pairs.limit(1), calls, stats, genes.where("v in (0, 3, 4)"), list(range(n)), (wh, y, None)).collect()
    assert {(r["v"], r["p"] is None) for r in alone} == {(0, True), (3, False), (4, False)}


def test_mean_shift_equals_leaving_the_sample_out():
    rng = np.random.default_rng(5)
    n = 25
    a = rng.standard_normal((n, n))
    v = a @ a.T + n * np.eye(n)
    c = np.column_stack([np.ones(n), rng.standard_normal(n)])
    bx, by = rng.standard_normal((2, 6, n))
    bx[4], by[5] = 0.0, bx[5]
    bx[3], by[3] = np.eye(n)[2], by[3]  # sample 2 alone carries the first burden
    y = rng.standard_normal(n)
    got = ps.mean_shift(mm.root_of_inverse(v), y, bx, by, c)
    for i in range(n):
        keep = np.delete(np.arange(n), i)
        beta, _, p = mm.interaction_tests(mm.root_of_inverse(v[np.ix_(keep, keep)]), y[keep], bx[:, keep], by[:, keep], c[keep])
        assert np.allclose(got["p"][i], p, rtol=1e-6) and np.allclose(got["beta"][i], beta, rtol=1e-6, equal_nan=True)


def test_thinning_as_counts_agrees_with_thinning_of_markers(spark):
    rng = np.random.default_rng(6)
    units = [(u, s, int(rng.integers(0, 15))) for u in range(120) for s in "ABD" if rng.random() < 0.9]
    sizes = spark.createDataFrame(units, "unit bigint, sub string, n bigint")
    got = {(r["mode"], r["rate"]): r for r in ds.thinned_curve(sizes, ["unit"], "sub", ["A", "B", "D"], (0.25, 0.5, 1.0), 400).collect()}
    n = np.zeros((120, 3), int)
    for u, s, k in units:
        n[u, "ABD".index(s)] = k
    count = lambda x: sum(((x[..., i] >= 3) & (x[..., j] >= 3)).sum(-1) for i, j in ((0, 1), (0, 2), (1, 2)))
    for rate in (0.25, 0.5):
        own = {"uniform": count(rng.binomial(n, rate, (4000, 120, 3))), "clustered": count(n * (rng.random((4000, 120, 3)) < rate))}
        for mode, x in own.items():
            r = got[(mode, rate)]
            assert abs(r["g_callable"] - x.mean()) < 5 * x.std() / 20 and abs(r["g_lo"] - np.quantile(x, 0.025)) <= 4 and abs(r["g_hi"] - np.quantile(x, 0.975)) <= 4
            assert 0 < r["held_out_error"] < 0.8
    assert got[("uniform", 1.0)]["g_callable"] == got[("clustered", 1.0)]["g_lo"] == count(n) and got[("uniform", 1.0)]["held_out_error"] == 0


@pytest.mark.parametrize("pool_min", [5, 1000])
def test_controls_within_a_caliper_equal_all_pairs(spark, pool_min):
    rng = np.random.default_rng(7)
    n = 500
    x = rng.standard_normal((n, 5))
    x[:, 2] = np.round(x[:, 2])  # ties
    x[100:200] = x[100]
    rows = [(i, float(rng.random()), bool(i % 12 == 0), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, pct double, top boolean, a double, b double, c double, d double, e double").repartition(4)
    got = {r["id"]: r for r in ex.caliper_controls(df, {"a": 3, "b": 2, "c": 0, "d": 0, "e": 0}, "top", 0.7, pool_min).collect()}
    z = (x - x.mean(0)) / x.std(0)
    pct, top = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def bins(v, k):
        rank = np.array([((v < q).sum() + 1 + (v <= q).sum()) / 2 for q in v])
        return np.minimum(k - 1, np.floor((rank - 0.5) / n * k))
    stratum = bins(x[:, 0], 3) * 10 + bins(x[:, 1], 2)
    assert set(got) == set(np.flatnonzero(top).tolist())
    for i in np.flatnonzero(top):
        own = ~top & (stratum == stratum[i])
        inside = own.sum() >= pool_min
        pool = (own if inside else ~top) & (np.abs(z - z[i]) <= 0.7).all(1)
        r = got[i]
        assert r["in_stratum"] == inside and r["n_matched"] == pool.sum()
        if pool.any():
            assert np.isclose(r["matched_mean"], pct[pool].mean()) and np.isclose(r["matched_sd"], pct[pool].std(), atol=1e-7)
            assert np.isclose(r["p_above"], ((pct[pool] >= pct[i]).sum() + 1) / (pool.sum() + 1))
        else:
            assert r["matched_mean"] is None
    assert max(r["n_matched"] for r in got.values()) > 50 and sum(r["n_matched"] > 0 for r in got.values()) > 10


@pytest.mark.parametrize("at_once", [16, 1])
def test_local_controls_equal_least_squares(spark, monkeypatch, at_once):
    monkeypatch.setattr(ls, "GENES_AT_ONCE", at_once)
    rng = np.random.default_rng(11)
    n = 36
    place = {"x1": ("A", 1_900_000), "x2": ("A", 2_300_000), "x3": ("A", 3_300_000), "y1": ("B", 500_000), "y2": ("B", 1_000_001), "z1": ("D", 10), "x9": ("C", 5)}
    vec = {g: rng.standard_normal(n) for g in place}
    marks = [(i, "AB"[i % 2], int(rng.integers(0, 5_000_000)), rng.standard_normal(n)) for i in range(40)]
    genes = spark.createDataFrame([(g, c, p) for g, (c, p) in place.items()], "gene string, chrom string, pos bigint")
    burdens = spark.createDataFrame([(g, v.tolist()) for g, v in vec.items()], "gene string, vec array<double>").repartition(3)
    markers = spark.createDataFrame([(i, c, p, v.tolist()) for i, c, p, v in marks], "v bigint, chrom string, pos bigint, vec array<double>").repartition(3)
    todo = [("x1", "y1", "z1"), ("x2", "y2", None), ("x9", "z1", "y1")]
    y = rng.standard_normal(n)
    wh = np.eye(n) + 0.1 * np.tril(rng.standard_normal((n, n)), -1)
    rows = ls.local_controls(spark.createDataFrame(todo, "gene_x string, gene_y string, focal string"), genes, burdens, markers, (wh, y, None), top=4).collect()
    got = {(r["gene_x"], r["gene_y"], r["window_bp"], r["control"]): r for r in rows}
    assert len(rows) == len(got) == len(todo) * 15

    def t(v):
        d = np.column_stack([wh @ np.ones(n), wh @ v])
        b, *_ = np.linalg.lstsq(d, wh @ y, rcond=None)
        r = wh @ y - d @ b
        return abs(b[1]) / np.sqrt(r @ r / (n - 2) * np.linalg.inv(d.T @ d)[1, 1])

    def components(m):
        u, s, _ = np.linalg.svd((m - m.mean(1, keepdims=True)).T, full_matrices=False)
        k = min(int(np.searchsorted(np.cumsum(s ** 2) / (s ** 2).sum(), 0.85) + 1), n - 8, len(m))
        return list((u[:, :k] * s[:k]).T)
    for a, b, f in todo:
        beta0 = mm.interaction_tests(wh, y, vec[a][None], vec[b][None])[0][0]
        for w in ls.WINDOWS:
            near = [vec[g] for e in (a, b) for g, (c, p) in place.items() if g != e and c == place[e][0] and abs(p - place[e][1]) <= w]
            local = [v for e in (a, b) for _, c, p, v in marks if c == place[e][0] and abs(p - place[e][1]) <= w]
            sets = dict(zip(ls.CONTROLS, ([] if f else None, near and [max(near, key=t)], near and components(np.stack(near)),
                                          sorted(local, key=t, reverse=True)[:4], local and components(np.stack(local)))))
            for control, extra in sets.items():
                r = got[(a, b, w, control)]
                assert np.isclose(r["beta0"], beta0)
                if extra is None or (control != "focal_copy" and not extra):
                    assert r["p"] is None and r["attenuation"] is None
                    continue
                c = np.column_stack([np.ones(n), *([vec[f]] if f else []), *extra])
                beta, _, p = mm.interaction_tests(wh, y, vec[a][None], vec[b][None], c)
                assert np.isclose(r["p"], p[0]) and np.isclose(r["beta"], beta[0]) and np.isclose(r["attenuation"], 1 - abs(beta[0]) / abs(beta0)), (a, b, w, control)
    assert any(r["control"] == "marker_components" and r["n_terms"] > 3 for r in rows)
