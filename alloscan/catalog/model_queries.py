"""Queries that fit models of the bounded panel and fan markers, pairs or replicates out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from alloscan.catalog import tables as t
from alloscan.catalog.kernel_queries import _G, kernels, panel, parts, wide
from alloscan.catalog.registry import big, query, r
from alloscan.functions import mixed_model as mm
from alloscan.operators import genotype as gt
from alloscan.operators import local_structure as ls
from alloscan.operators import pair_scan as ps
from alloscan.operators import relationship as rel
from alloscan.operators import replicates as rp
from alloscan.operators import score_scan as scan
from alloscan.session import cut_lineage


def trait(spark, d, which=1):
    """Trait vector in panel order (one value per panel sample)."""
    df = t.pheno(spark, d) if which == 1 else t.pheno2(spark, d)
    return np.array([x["y"] for x in df.orderBy("s").collect()], dtype=float)


def grms(spark, d, geno=None):
    n = len(panel(spark, d))
    return {k: mm.pull_psd(m, 1e-6) for k, m in sorted(rel.dense(kernels(spark, d, geno=geno), n).items())}


def model(spark, d, geno=None):
    y = trait(spark, d)
    return y, np.ones((len(y), 1)), grms(spark, d, geno)


def _rows(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


@query("k_reml1")
def k_reml1(spark, d):
    y, x, k = model(spark, d)
    f = mm.fit_single(y, x, mm.trace_scaled(sum(k.values())))
    return _rows(spark, [(float(f["sigma2_g"]), float(f["sigma2_e"]), float(f["h2"]), f["loglik"], f["at_boundary"])],
                 "sigma2_g double, sigma2_e double, h2 double, loglik double, at_boundary boolean")


@query("k_reml")
def k_reml(spark, d):
    y, x, k = model(spark, d)
    f = mm.fit_reml(y, x, k, n_starts=3, seed=42)
    return _rows(spark, [(c, float(f.sigma2[c]), float(f.pve[c]), float(f.component_var[c]), c in f.boundary, f.loglik) for c in f.sigma2],
                 "component string, sigma2 double, pve double, component_var double, at_boundary boolean, loglik double")


@query("k_reml0", """
, a AS (SELECT count(*) AS n, sum(y * y) AS rss FROM yc)
SELECT round(-0.5 * ((n - 1) * (ln(2 * pi() * rss / (n - 1)) + 1) + ln(n)), 6) AS loglik FROM a""")
def k_reml0(spark, d):
    c = scan.centered_trait(t.pheno(spark, d)).agg(F.max("n").alias("n"), F.sum(F.col("yc") * F.col("yc")).alias("rss"))
    n = F.col("n")
    return c.select(r(-0.5 * ((n - 1) * (F.log(2 * F.pi() * F.col("rss") / (n - 1)) + 1) + F.log(n)), "loglik"))


@query("k_fallback")
def k_fallback(spark, d):
    y, x, k = model(spark, d)
    c, add, full = mm.fit_with_fallback(y, x, k, n_starts=2, seed=1)
    return _rows(spark, [(c.drop_reason, add.loglik, full.loglik, float(full.pve["K_hom"]))],
                 "decision string, loglik_additive double, loglik_full double, pve_hom double")


def contexts(spark, d):
    y, x, k = model(spark, d)
    f = mm.fit_reml(y, x, k, n_starts=2, seed=1)
    return mm.null_context(y, x, k, f.sigma2)


@query("k_context")
def k_context(spark, d):
    """Row norms of the null projection (all of P stays on the panel)."""
    p, py = contexts(spark, d)
    return _rows(spark, [(i, float(np.linalg.norm(p[i])), float(py[i])) for i in range(len(py))], "i int, p_norm double, py double")


@query("k_scan")
def k_scan(spark, d):
    s = scan.kernel_scan(wide(spark, d).select("v", "chrom", "dosage"), {None: contexts(spark, d)}, keep=["chrom"])
    return s.where(F.col("status") == "ok").drop("status")


@query("k_scan_stream")
def k_scan_stream(spark, d):
    """The same scan in another chunking: results do not depend on how markers are split."""
    w = wide(spark, d).select("v", "snp", "sub", "chrom", "pos", "dosage").repartition(7)
    s = scan.kernel_scan(w, {None: contexts(spark, d)}, keep=["snp", "sub", "chrom", "pos"])
    return s.where(F.col("status") == "ok").select("snp", "sub", "chrom", "pos", F.col("v").alias("variant_index"), "beta", "se", "chi2", "p",
                                                   "n_obs", "maf", "call_rate")


@query("flt_scan_status", """
SELECT CASE WHEN n_obs = 0 OR flat THEN 'zero_var_or_allmiss' WHEN call_rate < 0.9 THEN 'call_rate' WHEN maf < 0.25 THEN 'maf' ELSE 'ok' END AS status, count(*) AS n FROM q GROUP BY 1""")
def flt_scan_status(spark, d):
    s = scan.kernel_scan(wide(spark, d).select("v", "dosage"), {None: contexts(spark, d)}, maf_min=0.25)
    return s.groupBy("status").agg(F.count("*").alias("n"))


def loco_context_pairs(spark, d, geno=None, homolog=False):
    """One context per chromosome, one by one: only its own subgenome's kernel loses the chromosome, and with ``homolog``
    the homolog kernel is made anew from what is left."""
    geno = cut_lineage(t.geno(spark, d)) if geno is None else geno
    y, x, k = model(spark, d, geno)
    full = {**k, "K_hom": mm.homolog_kernel(k)} if homolog else k
    f = mm.fit_reml(y, x, full, n_starts=2, seed=1)
    of = t.markers(spark, d).select(F.col("chrom").alias("grp"), F.col("sub").alias("family")).distinct()
    left = cut_lineage(rel.loco(parts(spark, d, "chrom", geno=geno), of))
    hom = cut_lineage(rel.loco_homolog(left, kernels(spark, d, geno=geno), sorted(k))) if homolog else None
    for row in of.orderBy("grp").collect():  # one row per chromosome of the karyotype
        chrom, sub = row["grp"], row["family"]
        own = {sub: mm.pull_psd(rel.dense(left.where(F.col("grp") == chrom), len(y))[chrom], 1e-6)}
        if homolog:
            own["K_hom"] = mm.pull_psd(rel.dense(hom.where(F.col("grp") == chrom), len(y))[chrom], 1e-6)
        yield chrom, mm.null_context(y, x, {**full, **own}, f.sigma2)


def loco_contexts(spark, d, geno=None):
    return dict(loco_context_pairs(spark, d, geno))


LOW_INFORMATION = 0.01


@query("k_loco_kernels", _G + """
, tr AS (SELECT sub, chrom, sum(num) FILTER (i = j) AS t FROM num GROUP BY ALL), td AS (SELECT sub, sum(den) AS td FROM den GROUP BY sub), tt AS (SELECT sub, sum(t) AS tt FROM tr GROUP BY sub)
SELECT chrom AS grp, sub AS family, round((tt - t) / (td - den), 6) + 0.0 AS trace, round((td - den) / td, 9) AS retained, (td - den) / td < 0.01 AS low_information
FROM tr JOIN den USING (sub, chrom) JOIN td USING (sub) JOIN tt USING (sub)""")
def k_loco_kernels(spark, d):
    """Trace and retained information of each chromosome's kernel; little retained is flagged."""
    of = t.markers(spark, d).select(F.col("chrom").alias("grp"), F.col("sub").alias("family")).distinct()
    k = rel.loco(parts(spark, d, "chrom"), of).groupBy("grp", "family").agg(
        F.sum(F.when(F.col("i") == F.col("j"), F.col("k"))).alias("trace"), F.max("retained").alias("retained"))
    return k.select("grp", "family", r("trace", "trace"), r("retained", "retained", 9), (F.col("retained") < LOW_INFORMATION).alias("low_information"))


@query("k_loco_ctx")
def k_loco_ctx(spark, d):
    return _rows(spark, [(c, float(np.trace(p)), float(py @ py)) for c, (p, py) in sorted(loco_contexts(spark, d).items())],
                 "chrom string, trace_p double, py_norm2 double")


@query("k_scan_loco")
def k_scan_loco(spark, d):
    geno = cut_lineage(t.geno(spark, d))
    s = scan.kernel_scan(wide(spark, d, geno).select("v", "chrom", "dosage"), loco_contexts(spark, d, geno), chrom_col="chrom", keep=["chrom"])
    return s.where(F.col("status") == "ok").drop("status")


@query("k_scan_hom")
def k_scan_hom(spark, d):
    """The scan under a null model with the homolog kernel beside the subgenomes' own."""
    geno = cut_lineage(t.geno(spark, d))
    y, x, k = model(spark, d, geno)
    k = {**k, "K_hom": mm.homolog_kernel(k)}
    context = mm.null_context(y, x, k, mm.fit_reml(y, x, k, n_starts=2, seed=1).sigma2)
    s = scan.kernel_scan(wide(spark, d, geno).select("v", "chrom", "dosage"), {None: context}, keep=["chrom"])
    return s.where(F.col("status") == "ok").drop("status")


@query("k_scan_loco_hom")
def k_scan_loco_hom(spark, d):
    geno = cut_lineage(t.geno(spark, d))
    pairs = loco_context_pairs(spark, d, geno, homolog=True)
    s = scan.kernel_scan(wide(spark, d, geno).select("v", "chrom", "dosage"), pairs, chrom_col="chrom", keep=["chrom"])
    return s.where(F.col("status") == "ok").drop("status")


@query("k_loco_hom", _G + """
, tt AS (SELECT sub, i, j, sum(num) AS tn FROM num GROUP BY ALL), td AS (SELECT sub, sum(den) AS td FROM den GROUP BY sub),
own AS (SELECT a.chrom, a.sub, a.i, a.j, (tt.tn - a.num) / (td.td - den.den) AS k FROM num a JOIN tt USING (sub, i, j) JOIN den USING (sub, chrom) JOIN td USING (sub))
SELECT o.chrom, o.i, o.j, round(any_value(o.k) * product(b.k), 6) + 0.0 AS k FROM own o JOIN kk b ON b.i = o.i AND b.j = o.j AND b.grp <> o.sub GROUP BY o.chrom, o.i, o.j""")
def k_loco_hom(spark, d):
    """Homolog kernel of every chromosome, from its subgenome's kernel without it and the other subgenomes' whole ones."""
    geno = cut_lineage(t.geno(spark, d))
    of = t.markers(spark, d).select(F.col("chrom").alias("grp"), F.col("sub").alias("family")).distinct()
    k = rel.loco_homolog(rel.loco(parts(spark, d, "chrom", geno=geno), of), kernels(spark, d, geno=geno), ["A", "B", "D"])
    return k.select(F.col("grp").alias("chrom"), big("i"), big("j"), r("k", "k"))


@query("agg_grm_x")
def agg_grm_x(spark, d):
    """Kernel of standardised markers, eigenvalues clipped at 1e-6, trace n."""
    n = len(panel(spark, d))
    z = wide(spark, d).select("sub", F.transform("dosage", lambda a: a).alias("dosage"))
    k = ps.standardized_kernels(z, n)
    return _rows(spark, [(s, i, float(m[i, i]), float(m[i].sum())) for s, m in sorted(k.items()) for i in range(n)],
                 "sub string, i int, diag double, row_sum double")


@query("agg_geometry")
def agg_geometry(spark, d):
    """How far the homolog kernel lies outside the span of the additive kernels."""
    k = grms(spark, d)
    n = len(next(iter(k.values())))
    h = np.eye(n) - 1 / n
    c = {s: h @ m @ h for s, m in {**k, "K_hom": mm.homolog_kernel(k)}.items()}
    iu = np.triu_indices(n, 1)

    def r2(y, xs):
        a = np.stack([np.ones_like(y), *xs], 1)
        e = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
        return float(1 - (e @ e) / ((y - y.mean()) @ (y - y.mean())))
    y, xs = c["K_hom"], [c[s] for s in k]
    full = np.triu_indices(n)
    w = np.linalg.eigvalsh(y)
    return _rows(spark, [(r2(y[full], [m[full] for m in xs]), r2(y[full], [*(m[full] for m in xs), np.eye(n)[full]]),
                          r2(y[iu], [m[iu] for m in xs]), float(w.sum() ** 2 / (w * w).sum()))],
                 "r2_vech double, r2_with_identity double, r2_offdiag double, effective_rank double")


@query("k_pcs")
def k_pcs(spark, d):
    k = grms(spark, d)
    n = len(next(iter(k.values())))
    c = mm.covariates(k, n, n_pcs=3)
    return _rows(spark, [(i, *(abs(float(v)) for v in c[i, 1:4])) for i in range(n)], "i int, pc1_abs double, pc2_abs double, pc3_abs double")


@query("k_whiten")
def k_whiten(spark, d):
    y, x, k = model(spark, d)
    wh, f = mm.whitener(y, x, k)
    return _rows(spark, [(i, float(v)) for i, v in enumerate(wh @ y)], "i int, y_white double")


def pair_setup(spark, d, **kw):
    geno = cut_lineage(t.geno(spark, d))  # the genotype table, read by kernels, statistics and burdens
    y, x, k = model(spark, d, geno)
    stats = gt.allele_stats(geno, len(panel(spark, d)))
    b = ps.burden_vectors(geno, stats, stats.select("v").transform(t.with_map).select("v", "gene"), panel(spark, d), **kw)
    b = cut_lineage(b)  # one row per gene, read by both sides of every pair
    g = t.markers(spark, d).select("gene", "sub", "base", "jj").distinct()
    a = g.select("base", "jj", F.col("gene").alias("gene_x"), F.col("sub").alias("sub_x"))
    c = g.select("base", "jj", F.col("gene").alias("gene_y"), F.col("sub").alias("sub_y"))
    pairs = a.join(c, ["base", "jj"]).where(F.col("sub_x") < F.col("sub_y")).select(
        F.concat_ws("_", F.col("base").cast("string"), F.col("jj").cast("string")).alias("grp"), "gene_x", "gene_y", "sub_x", "sub_y")
    return mm.normal_scores(y), x, k, b, pairs


@query("k_pair")
def k_pair(spark, d):
    y, x, k, b, pairs = pair_setup(spark, d)
    return ps.pair_tests(pairs, b, {"t": (mm.whitener(y, x, k)[0], y, None)})


@query("k_pair_dominance")
def k_pair_dominance(spark, d):
    y, x, k, b, pairs = pair_setup(spark, d)
    return ps.pair_tests(pairs, b, {"t": (mm.whitener(y, x, k)[0], y, None)}, dominance=True)


@query("k_marginal")
def k_marginal(spark, d):
    y, x, k, b, _ = pair_setup(spark, d)
    return ps.marginal_tests(b, (mm.whitener(y, x, k)[0], y, None))


@query("k_cov")
def k_cov(spark, d):
    """Pair tests with two genotype PCs as fixed effects."""
    y, x, k, b, pairs = pair_setup(spark, d)
    c = mm.covariates(k, len(y), n_pcs=2)
    return ps.pair_tests(pairs, b, {"t": (mm.whitener(y, c, k)[0], y, c)})


@query("k_pair_scan")
def k_pair_scan(spark, d):
    """Pair ranking of all pairs with marginal p."""
    y, x, k, b, pairs = pair_setup(spark, d)
    ctx = (mm.whitener(y, x, k)[0], y, None)
    tests = cut_lineage(ps.pair_tests(pairs, b, {"t": ctx}))
    ranked = ps.pair_ranking(tests, ps.marginal_tests(b, ctx), ps.gene_sizes(t.markers(spark, d)))
    return ranked


@query("sink_ranking")
def sink_ranking(spark, d):
    """Per-sample burdens of the five best pairs."""
    y, x, k, b, pairs = pair_setup(spark, d)
    tests = cut_lineage(ps.pair_tests(pairs, b, {"t": (mm.whitener(y, x, k)[0], y, None)}))
    from alloscan.operators import ranking as rk
    ranked = rk.rank_with_ties(tests, "p", ["gene_x", "gene_y"]).withColumnRenamed("rank0", "rank")
    return ps.top_burdens(ranked, b, y, y - y.mean())


@query("k_pair_perm")
def k_pair_perm(spark, d):
    """Observed combined p of all pairs against permuted traits."""
    y, x, k, b, pairs = pair_setup(spark, d)
    return ps.permutation_summary(pairs, b, {"t": y}, x, k, n_perm=2000)


@query("k_clique")
def k_clique(spark, d):
    """Every subgenome pair of each homolog group, combined per group."""
    y, x, k, b, pairs = pair_setup(spark, d)
    tests = ps.pair_tests(pairs, b, {"t": (mm.whitener(y, x, k)[0], y, None)})
    m = t.markers(spark, d)
    g = m.groupBy(F.concat_ws("_", F.col("base").cast("string"), F.col("jj").cast("string")).alias("grp")).agg(
        *[F.max(F.when(F.col("sub") == s, F.col("gene"))).alias(f"gene_{s}") for s in "ABD"])
    return ps.group_table(tests, g, ["A", "B", "D"], ps.gene_sizes(m))


@query("k_multitrait")
def k_multitrait(spark, d):
    """One combined p per pair over a fixed trait set."""
    y, x, k, b, pairs = pair_setup(spark, d)
    y2 = mm.normal_scores(trait(spark, d, 2))
    ctx = {"t1": (mm.whitener(y, x, k, 42)[0], y, None), "t2": (mm.whitener(y2, x, k, 43)[0], y2, None)}
    return ps.group_ranking(ps.pair_tests(pairs, b, ctx), ["grp", "gene_x", "gene_y"])


@query("k_multitrait_perm")
def k_multitrait_perm(spark, d):
    y, x, k, b, pairs = pair_setup(spark, d)
    y2 = mm.normal_scores(trait(spark, d, 2))
    return ps.permutation_summary(pairs, b, {"t1": y, "t2": y2}, x, k, n_perm=2000)


@query("k_cond_diag")
def k_cond_diag(spark, d):
    y, x, k, b, pairs = pair_setup(spark, d)
    return ps.conditional_diagnostics(pairs, b, (mm.whitener(y, x, k)[0], y, None))


@query("fn_siq")
def fn_siq(spark, d):
    y, x, k, b, pairs = pair_setup(spark, d)
    return ps.dosage_balance(pairs, b, (mm.whitener(y, x, k)[0], y, None))


@query("k_cap_sweep")
def k_cap_sweep(spark, d):
    """Whitening once, burden size cap varied."""
    y, x, k, _, pairs = pair_setup(spark, d)
    ctx = (mm.whitener(y, x, k)[0], y, None)
    out, ids = None, panel(spark, d)
    calls = cut_lineage(t.geno(spark, d))
    stats, genes = cut_lineage(t.stats(spark, d, calls)), t.markers(spark, d, calls).select("v", "gene")
    for cap in (2, 3, 5):
        b = ps.burden_vectors(calls, stats, genes, ids, cap=cap)
        s = ps.pair_tests(pairs, b, {"t": ctx}).agg(F.min("p").alias("min_p"), F.count("*").alias("n_pairs")).withColumn("cap", F.lit(cap))
        out = s if out is None else out.unionByName(s)
    return out


@query("k_loo")
def k_loo(spark, d):
    """Interaction p of every pair with each sample left out: smallest and largest."""
    y, x, k, b, pairs = pair_setup(spark, d)
    return ps.leave_one_out(pairs, b, (y, x), k)


@query("k_loo_floors")
def k_loo_floors(spark, d):
    """Product term of every pair from markers of at least a minor allele frequency."""
    y, x, k, _, pairs = pair_setup(spark, d)
    geno = cut_lineage(t.geno(spark, d))
    stats, genes = cut_lineage(t.stats(spark, d, geno)), t.markers(spark, d, geno).select("v", "gene")
    return ps.frequency_floors(pairs, geno, stats, genes, panel(spark, d), (mm.whitener(y, x, k)[0], y, None))


@query("k_loo_marker")
def k_loo_marker(spark, d):
    """Product term of every pair with each marker of its genes left out in turn."""
    y, x, k, _, pairs = pair_setup(spark, d)
    geno = cut_lineage(t.geno(spark, d))
    stats, genes = cut_lineage(t.stats(spark, d, geno)), t.markers(spark, d, geno).select("v", "gene")
    return ps.leave_one_marker_out(pairs, geno, stats, genes, panel(spark, d), (mm.whitener(y, x, k)[0], y, None))


@query("k_local_structure")
def k_local_structure(spark, d):
    """Every pair of copies under five controls for what lies around them, in three windows."""
    y, x, k, b, pairs = pair_setup(spark, d)
    ids, geno = panel(spark, d), cut_lineage(t.geno(spark, d))
    m = t.markers(spark, d, geno)
    g = m.select("gene", "base", "jj").distinct()
    third = pairs.join(g.select(F.col("gene").alias("gene_x"), "base", "jj"), "gene_x").join(g.select(F.col("gene").alias("focal"), "base", "jj"), ["base", "jj"])
    third = third.where((F.col("focal") != F.col("gene_x")) & (F.col("focal") != F.col("gene_y"))).groupBy("gene_x", "gene_y").agg(F.min("focal").alias("focal"))
    coord = gt.gene_coordinates(m.select("gene", "chrom", "pos"))
    # a gene of its own for every marker gives its standardised vector
    one = m.select("v", F.col("v").cast("string").alias("gene"))
    vectors = ps.burden_vectors(geno, gt.allele_stats(geno, len(ids)), one, ids).select(F.col("gene").cast("bigint").alias("v"), "vec")
    return ls.local_controls(pairs.select("gene_x", "gene_y").join(third, ["gene_x", "gene_y"], "left"), coord, b,
                             m.select("v", "chrom", "pos").join(vectors, "v"), (mm.whitener(y, x, k)[0], y, None))


@query("k_nested")
def k_nested(spark, d):
    y, x, k = model(spark, d)
    return rp.nested_models(spark, y, x, k)


@query("k_blrt")
def k_blrt(spark, d):
    y, x, k = model(spark, d)
    return rp.boundary_tests(rp.nested_models(spark, y, x, k))


@query("k_bootlrt")
def k_bootlrt(spark, d):
    y, x, k = model(spark, d)
    return rp.bootstrap_lrt(spark, y, x, k, null=["A", "B"], alt=["A", "B", "D"], n_boot=16)


@query("k_sens")
def k_sens(spark, d):
    y, x, k = model(spark, d)
    return rp.sensitivity_grid(spark, y, x, k)


@query("agg_drift")
def agg_drift(spark, d):
    """PVE range per component along each axis of the grid, others at the reference."""
    y, x, k = model(spark, d)
    return rp.drift_table(rp.sensitivity_grid(spark, y, x, k))


@query("k_calib")
def k_calib(spark, d):
    y, x, k = model(spark, d)
    return rp.null_calibration(spark, y, x, k, null=["A", "B"], alt=["A", "B", "D"], n_sim=24)


@query("k_self_liang")
def k_self_liang(spark, d):
    """One-component boundary test for every model pair that adds one kernel."""
    y, x, k = model(spark, d)
    return rp.boundary_tests(rp.nested_models(spark, y, x, k)).where(F.col("df_added") == 1)


@query("k_spike")
def k_spike(spark, d):
    y, x, k = model(spark, d)
    kp, kh = mm.trace_scaled(sum(k.values())), mm.trace_scaled(mm.homolog_kernel(k))
    return rp.spike_in(spark, kp, kh, [(0.4, 0.0), (0.3, 0.2)], n_rep=4)


@query("k_blup")
def k_blup(spark, d):
    y, x, k = model(spark, d)
    return rp.cross_validation(spark, y, x, k, n_folds=5, n_repeats=20, predictions=True)


@query("k_cv")
def k_cv(spark, d):
    y, x, k = model(spark, d)
    return rp.cross_validation(spark, y, x, k, n_folds=5, n_repeats=20)


@query("agg_fold")
def agg_fold(spark, d):
    y, x, k = model(spark, d)
    return rp.tier_summary(rp.cross_validation(spark, y, x, k, n_folds=5, n_repeats=20))


@query("agg_boot_ci")
def agg_boot_ci(spark, d):
    y, x, k = model(spark, d)
    return rp.paired_fold_bootstrap(rp.cross_validation(spark, y, x, k, n_folds=5, n_repeats=20), n_boot=1000)


@query("win_stratified")
def win_stratified(spark, d):
    """Fold of each sample, balanced over trait quantiles."""
    y = trait(spark, d)
    return _rows(spark, [(i, int(f)) for i, f in enumerate(rp.stratified_fold_of(y, 5, seed=2026))], "i int, fold int")


@query("k_sim")
def k_sim(spark, d):
    y, x, k = model(spark, d)
    return rp.simulate_arms(spark, k, rp.causal_dosages(wide(spark, d), 4), n_rep=3)


@query("top_select_causal")
def top_select_causal(spark, d):
    return rp.spaced_causal(t.markers(spark, d).select("v", "sub", "chrom", "pos"), per_sub=4, min_sep=400_000)


@query("k_benchmark")
def k_benchmark(spark, d):
    """Family-wise power of competing pair tests on simulated interaction traits."""
    y, x, k, b, pairs = pair_setup(spark, d)
    return rp.pair_benchmark(spark, b, pairs, k, n_rep=6)
