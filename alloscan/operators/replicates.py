"""Replicate fan-out: each model, fold, simulation or bootstrap draw is a row with its own seed."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alloscan.functions import mixed_model as mm
from alloscan.functions import special as sp
from alloscan.functions import stat_columns as sc
from alloscan.session import cut_lineage


def fan_out(spark: SparkSession, jobs: list[tuple], ddl_in: str, fn, ddl_out: str, shared) -> DataFrame:
    """Run ``fn(row, shared) -> list of dicts`` for each job row, spread over tasks.

    Jobs are a small table of settings and seeds, so results do not depend on how they are
    split; ``shared`` (bounded panel matrices) is broadcast once.
    """
    bc = spark.sparkContext.broadcast(shared)

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                rows = fn(row, bc.value)
                if rows:
                    yield pd.DataFrame(rows)
    width = max(1, min(len(jobs), spark.sparkContext.defaultParallelism * 4))
    return spark.createDataFrame(jobs, ddl_in).repartition(width).mapInPandas(run, ddl_out)


def seeds(base: int, n: int) -> list[int]:
    return [int(s.generate_state(1)[0]) for s in np.random.SeedSequence(base).spawn(n)]


def model_specs(names: list[str], strategy: str = "exhaustive") -> list[tuple[str, ...]]:
    """Sets of kernels: all subsets, leave-one-out plus full, or single kernels plus full."""
    if strategy == "exhaustive":
        return [c for k in range(len(names) + 1) for c in itertools.combinations(names, k)]
    if strategy == "leave_one_out":
        return [tuple(names), *[tuple(n for n in names if n != x) for x in names]]
    return [(), *[(x,) for x in names], tuple(names)]


def _fit(y, x, kernels, names, starts=2, seed=1):
    if not names:
        ll = mm.residual_loglik(y, x)
        return mm.Fit({"e": float(np.var(y, ddof=1))}, {"e": 1.0}, {"e": float(np.var(y, ddof=1))}, np.zeros(1), ll, [])
    return mm.fit_reml(y, x, {k: kernels[k] for k in names}, n_starts=starts, seed=seed)


def nested_models(spark, y, x, kernels, strategy="exhaustive") -> DataFrame:
    def fit(row, sh):
        names = [k for k in row.model.split("+") if k != "null"]
        f = _fit(*sh, names)
        return [{"model": row.model, "n_kernels": len(names), "log_lik": f.loglik, "converged": f.converged,
                 "sigma2_json": json.dumps({k: float(v) for k, v in f.sigma2.items()}),
                 "pve_json": json.dumps({k: float(v) for k, v in f.pve.items()}), "boundary": ",".join(f.boundary)}]
    jobs = [("+".join(s) or "null",) for s in model_specs(list(kernels), strategy)]
    out = fan_out(spark, jobs, "model string", fit, "model string, n_kernels bigint, log_lik double, converged boolean, "
                  "sigma2_json string, pve_json string, boundary string", (y, x, kernels))
    return out.orderBy(F.desc("log_lik"), "model")


def boundary_tests(models: DataFrame, tol: float = 1e-8) -> DataFrame:
    """Likelihood-ratio test of every strictly nested model pair against the boundary mixture.

    Each model lists its own proper subsets (a power set of a few kernel names), which then
    meet the fitted models by name.
    """
    ks = F.when(F.col("model") == "null", F.array().cast("array<string>")).otherwise(F.split("model", r"\+"))
    m = models.select("model", "log_lik", ks.alias("ks"))
    mask = F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, size(ks)) - 1")))
    sub = m.select("model", "log_lik", "ks", mask.alias("mask")).withColumn(
        "sub", F.expr("filter(ks, (k, i) -> (shiftright(mask, i) & 1) = 1)")).where(F.size("sub") < F.size("ks"))
    sub = sub.withColumn("null_model", F.when(F.size("sub") == 0, "null").otherwise(F.array_join("sub", "+")))
    j = sub.join(m.select(F.col("model").alias("null_model"), F.col("log_lik").alias("ll0")), "null_model")
    t = 2 * (F.col("log_lik") - F.col("ll0"))
    j = j.select("null_model", F.col("model").alias("alt_model"), (F.size("ks") - F.size("sub")).cast("bigint").alias("df_added"),
                 F.greatest(t, F.lit(0.0)).alias("lrt"), (t < -tol).alias("negative_clipped"))
    return j.withColumn("p_value", F.when(F.col("lrt") <= tol, 1.0).otherwise(sc.chibar_p("lrt", "df_added")))


def bootstrap_lrt(spark, y, x, kernels, null: list[str], alt: list[str], n_boot: int, seed: int = 11) -> DataFrame:
    """Parametric bootstrap of one nested comparison; p = (1 + exceed) / (B + 1) with its error."""
    f0, f1 = _fit(y, x, kernels, null), _fit(y, x, kernels, alt)
    obs = max(0.0, 2 * (f1.loglik - f0.loglik))
    reps = _null_draws(spark, y, x, kernels, null, alt, f0, n_boot, seed)
    p = (1 + F.count_if(F.col("lrt") >= obs)) / (F.count("lrt") + 1)
    a = reps.where("converged").agg(F.count("lrt").alias("n_used"), p.alias("p_boot"))
    return a.select(F.lit("+".join(null)).alias("null_model"), F.lit("+".join(alt)).alias("alt_model"), F.lit(obs).alias("lrt"), "n_used",
                    "p_boot", F.sqrt(F.col("p_boot") * (1 - F.col("p_boot")) / (F.col("n_used") + 1)).alias("mc_error"))


def _null_draws(spark, y, x, kernels, null, alt, f0, n, seed) -> DataFrame:
    def draw(row, sh):
        x_, ks, chol, mean = sh
        ys = mean + chol @ np.random.default_rng(row.seed).standard_normal(len(mean))
        try:
            a, b = _fit(ys, x_, ks, null), _fit(ys, x_, ks, alt)
        except np.linalg.LinAlgError:
            return []
        return [{"rep": row.rep, "lrt": max(0.0, 2 * (b.loglik - a.loglik)), "converged": a.converged and b.converged}]
    v = f0.sigma2["e"] * np.eye(len(y)) + sum((f0.sigma2[k] * kernels[k] for k in null), np.zeros((len(y), len(y))))
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    jobs = list(enumerate(seeds(seed, n)))
    return fan_out(spark, jobs, "rep bigint, seed bigint", draw, "rep bigint, lrt double, converged boolean",
                   (x, kernels, np.linalg.cholesky(v), x @ beta))


def null_calibration(spark, y, x, kernels, null, alt, n_sim: int, alphas=(0.1, 0.05, 0.01), seed: int = 5) -> DataFrame:
    """Rejection rates of the boundary test under simulated nulls, with score intervals."""
    f0 = _fit(y, x, kernels, null)
    reps = _null_draws(spark, y, x, kernels, null, alt, f0, n_sim, seed).where("converged")
    k = len(alt) - len(null)
    reps = reps.withColumn("p_chibar", F.when(F.col("lrt") <= 1e-8, 1.0).otherwise(sc.chibar_p("lrt", F.lit(k))))
    reps = reps.withColumn("p_chi2", sc.chi2_sf1("lrt"))
    return type1_table(reps, {"p_chibar": "chibar", "p_chi2": "chi2"}, alphas)


def type1_table(reps: DataFrame, methods: dict[str, str], alphas) -> DataFrame:
    """Share of p <= alpha per method and alpha, Wilson interval and verdict, in one pass."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(float(a)).alias("alpha"), F.when(ok(c), F.col(c)).alias("p"))
                                for c, m in methods.items() for a in alphas]))
    g = reps.select(cells.alias("x")).groupBy("x.method", "x.alpha").agg(
        F.count("x.p").alias("n_used"), F.count_if(F.col("x.p") <= F.col("x.alpha")).alias("n_reject"))
    n = F.col("n_used")
    lo, hi = sc.wilson(F.col("n_reject"), F.nullif(n, F.lit(0)))
    g = g.withColumn("type1_rate", F.col("n_reject") / F.nullif(n, F.lit(0))).withColumn("ci_lo", lo).withColumn("ci_hi", hi)
    return g.withColumn("verdict", F.when(n == 0, "no_data").when(F.col("ci_lo") > F.col("alpha"), "anti-conservative")
                        .when(F.col("ci_hi") < F.col("alpha"), "conservative").otherwise("calibrated"))


def _scaled(k, norm):
    if norm == "trace":
        return mm.trace_scaled(k)
    return k if norm == "none" else k * len(k) / np.linalg.norm(k)


def sensitivity_grid(spark, y, x, kernels, y_modes=("raw", "rank_int"), norms=("none", "trace", "frobenius"), starts=(1, 10)) -> DataFrame:
    def fit(row, sh):
        y_, x_, ks = sh
        yy = mm.normal_scores(y_) if row.y_mode == "rank_int" else y_
        f = mm.fit_reml(yy, x_, {k: _scaled(m, row.kernel_norm) for k, m in ks.items()}, n_starts=int(row.n_starts), seed=42)
        return [{"y_mode": row.y_mode, "kernel_norm": row.kernel_norm, "n_starts": row.n_starts, "component": c,
                 "pve": float(v), "log_lik": f.loglik} for c, v in f.pve.items()]
    jobs = [(a, b, int(c)) for a, b, c in itertools.product(y_modes, norms, starts)]
    return fan_out(spark, jobs, "y_mode string, kernel_norm string, n_starts bigint", fit,
                   "y_mode string, kernel_norm string, n_starts bigint, component string, pve double, log_lik double", (y, x, kernels))


def drift_table(grid: DataFrame, reference=("raw", "trace", 10)) -> DataFrame:
    """PVE range per component: along each axis with the others at the reference, and overall."""
    axes = ["y_mode", "kernel_norm", "n_starts"]
    at = {a: F.col(a) == v for a, v in zip(axes, reference)}
    rows = []
    for a in axes:
        others = [at[b] for b in axes if b != a]
        rows.append(F.when(others[0] & others[1], F.lit(a)))
    ax = F.array(*rows, F.lit("global"))
    g = grid.select("component", "pve", F.explode(F.filter(ax, lambda v: v.isNotNull())).alias("axis"))
    return g.groupBy("component", "axis").agg(F.min("pve").alias("pve_min"), F.max("pve").alias("pve_max"),
                                              (F.max("pve") - F.min("pve")).alias("pve_range"))


def stratified_fold_of(y, n_folds: int, seed: int) -> np.ndarray:
    """Fold per sample: shuffled round-robin inside trait quantile strata."""
    rng = np.random.default_rng(seed)
    cuts = np.quantile(y, np.linspace(0, 1, min(5, n_folds) + 1))[1:-1]
    stratum = np.searchsorted(cuts, y, side="right")
    fold = np.empty(len(y), dtype=int)
    for s in np.unique(stratum):
        ix = rng.permutation(np.flatnonzero(stratum == s))
        fold[ix] = np.arange(len(ix)) % n_folds
    return fold


def cv_tiers(kernels: dict) -> dict:
    n = {k: mm.trace_scaled(m) for k, m in kernels.items()}
    tiers = {"tier0": {"K_pool": mm.trace_scaled(sum(kernels.values()))}, "tier1": n}
    kh = mm.homolog_kernel(kernels)
    tiers["tier2"] = {**n, "K_hom": mm.trace_scaled(kh)} if kh is not None else n
    return tiers


def cross_validation(spark, y, x, kernels, n_folds=5, n_repeats=20, seed=2026, predictions=False) -> DataFrame:
    """One job per (repeat, fold, tier): fit on the rest, predict the fold."""
    def run(row, sh):
        y_, x_, tiers = sh
        fold = stratified_fold_of(y_, n_folds, seed + row.repeat)
        test, train = np.flatnonzero(fold == row.fold), np.flatnonzero(fold != row.fold)
        ks = tiers[row.tier]
        f = mm.fit_reml(y_[train], x_[train], {k: m[np.ix_(train, train)] for k, m in ks.items()}, n_starts=3, seed=seed + row.repeat)
        pred = mm.blup(y_[train], x_[train], x_[test], ks, train, test, f.sigma2, f.beta)
        base = {"repeat": row.repeat, "fold": row.fold, "tier": row.tier}
        if predictions:
            return [{**base, "i": int(i), "y": float(a), "y_pred": float(b)} for i, a, b in zip(test, y_[test], pred)]
        r = float(np.corrcoef(y_[test], pred)[0, 1]) if np.std(pred) > 0 else float("nan")
        k = max(1, round(0.1 * len(test)))  # half to even
        top = len(set(np.argsort(-y_[test])[:k]) & set(np.argsort(-pred)[:k])) / k / 0.1
        return [{**base, "r": r, "r2": r * r, "top10_enrichment": top, "drop_reason": "kept"}]
    jobs = [(a, b, c) for a in range(n_repeats) for b in range(n_folds) for c in ("tier0", "tier1", "tier2")]
    head = "repeat bigint, fold bigint, tier string, "
    ddl = head + ("i bigint, y double, y_pred double" if predictions else "r double, r2 double, top10_enrichment double, drop_reason string")
    return fan_out(spark, jobs, head[:-2], run, ddl, (y, x, cv_tiers(kernels)))


def tier_summary(folds: DataFrame) -> DataFrame:
    """Means over folds per tier; undefined correlations are skipped."""
    ok = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c))
    return folds.groupBy("tier").agg(
        F.avg(ok("r2")).alias("mean_r2"), (F.stddev_samp(ok("r2")) / F.sqrt(F.count(ok("r2")))).alias("se_r2"),
        F.avg(ok("r")).alias("mean_r"), F.avg(ok("top10_enrichment")).alias("mean_top10_enrichment"),
        F.count_if(F.col("drop_reason") != "kept").alias("n_dropped"))


def paired_fold_bootstrap(folds: DataFrame, n_boot: int = 1000, baseline: str = "tier0") -> DataFrame:
    """Percentile interval of the mean r2 difference to the baseline over resampled folds.

    A draw takes as many folds as there are, with replacement, by a hash of (draw, place). The fold
    table has repeats x folds rows; its numbering is a window over those few.
    """
    w = folds.groupBy("repeat", "fold").pivot("tier", ["tier0", "tier1", "tier2"]).agg(F.first("r2")).dropna()
    w = w.withColumn("i", F.row_number().over(Window.orderBy("repeat", "fold")) - 1).select(
        "i", F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), (F.col(t) - F.col(baseline)).alias("d"))
                                 for t in ("tier0", "tier1", "tier2") if t != baseline])).alias("x")).select("i", "x.*")
    w = cut_lineage(w)
    n = w.agg(F.countDistinct("i")).first()[0]
    draws = (w.sparkSession.range(1, n_boot + 1).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(1), F.lit(max(n, 1)))).alias("place"))
             .select("b", F.pmod(F.xxhash64(F.lit("fold"), "b", "place"), F.lit(max(n, 1))).cast("int").alias("i")))
    m = draws.join(w, "i").groupBy("tier", "b").agg(F.avg("d").alias("m"))
    return m.groupBy("tier").agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.5).alias("mid"), F.percentile("m", 0.975).alias("hi"))


# fixed values: variance budgets of the benchmark arms
ARMS = {
    "S1_C_dominant": dict(qtl=0.18, poly_first=0.09, poly_last=0.33, pooled=0.0, hom=0.0),
    "S2_A_dominant": dict(qtl=0.18, poly_first=0.33, poly_last=0.09, pooled=0.0, hom=0.0),
    "S3_pooled": dict(qtl=0.18, poly_first=0.0, poly_last=0.0, pooled=0.42, hom=0.0),
    "S4_balanced": dict(qtl=0.18, poly_first=0.21, poly_last=0.21, pooled=0.0, hom=0.0),
    "S5_null": dict(qtl=0.0, poly_first=0.09, poly_last=0.33, pooled=0.0, hom=0.0),
    "S6_hadamard": dict(qtl=0.18, poly_first=0.09, poly_last=0.23, pooled=0.0, hom=0.10),
}


def _exact_var(v, target):
    s = v.std(ddof=1)
    return v * np.sqrt(target) / s if target > 0 and s > 0 else np.zeros_like(v)


def simulate_arms(spark, kernels: dict, causal: dict, n_rep: int, seed: int = 2024) -> DataFrame:
    """Phenotypes per arm and replicate with exact component variances, unit total variance."""
    names = list(kernels)
    fac = {k: np.linalg.cholesky(mm.pull_psd(m, 1e-6) + 1e-8 * np.eye(len(m))) for k, m in kernels.items()}
    fac["pooled"] = np.linalg.cholesky(mm.trace_scaled(sum(kernels.values())) + 1e-8 * np.eye(len(next(iter(kernels.values())))))
    kh = mm.homolog_kernel(kernels)
    fac["hom"] = np.linalg.cholesky(mm.pull_psd(kh, 1e-6) + 1e-8 * np.eye(len(kh)))

    def draw(row, sh):
        fac_, causal_ = sh
        rng = np.random.default_rng(row.seed)
        a = ARMS[row.arm]
        n = len(fac_["hom"])
        g = lambda key, h: _exact_var(fac_[key] @ rng.standard_normal(n), h)
        q = lambda key: _exact_var(causal_[key] @ rng.standard_normal(causal_[key].shape[1]), a["qtl"])
        comp = {"qtl_first": q(names[0]), "qtl_last": q(names[-1]), "poly_first": g(names[0], a["poly_first"]),
                "poly_last": g(names[-1], a["poly_last"]), "pooled": g("pooled", a["pooled"]), "hom": g("hom", a["hom"])}
        rest = 1 - 2 * a["qtl"] - a["poly_first"] - a["poly_last"] - a["pooled"] - a["hom"]
        comp["residual"] = _exact_var(rng.standard_normal(n), rest)
        y = sum(comp.values())
        tot = y.var(ddof=1)
        return [{"arm": row.arm, "rep": row.rep, "component": c, "pve": float(v.var(ddof=1) / tot), "y_first": float((y - y.mean())[0] / np.sqrt(tot))}
                for c, v in comp.items()]
    jobs = [(arm, r, s) for arm in ARMS for r, s in enumerate(seeds(seed, n_rep))]
    return fan_out(spark, jobs, "arm string, rep bigint, seed bigint", draw, "arm string, rep bigint, component string, pve double, y_first double", (fac, causal))


def causal_dosages(wide: DataFrame, per_sub: int, seed: int = 3) -> dict:
    """Standardised dosages of a few markers per subgenome (panel x per_sub), hash-chosen."""
    from alloscan.operators.scan_order import top_k
    pick = top_k(wide.select("sub", "v", "dosage"), ["sub"], [F.xxhash64(F.lit(seed), "v"), F.col("v")], per_sub).toPandas()
    out = {}
    for sub, b in pick.groupby("sub"):
        g = np.stack([np.asarray(a, float) for a in b["dosage"]])
        z = np.where(np.isnan(g), 0, g - np.nanmean(g, axis=1, keepdims=True))
        sd = z.std(1)
        out[sub] = (z / np.where(sd > 0, sd, 1)[:, None]).T
    return out


def spaced_causal(markers: DataFrame, per_sub: int, min_sep: int, seed: int = 5) -> DataFrame:
    """Random markers at least ``min_sep`` apart: accept in hash order unless too close.

    Accepting in random order with rejection is the clump rule on a random key.
    """
    from alloscan.operators.clumping import clump_leads
    from alloscan.operators.scan_order import top_k
    h = markers.withColumn("p", F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(2 ** 40)).cast("double")).withColumnRenamed("v", "id")
    leads = clump_leads(h.select("chrom", "pos", "p", "id"), min_sep - 1).select(F.col("lkey.id").alias("id"), F.col("lkey.p").alias("p"))
    l = leads.join(h.select("id", "sub", "chrom", "pos"), "id")
    return top_k(l, ["sub"], [F.col("p"), F.col("id")], per_sub).select("sub", F.col("id").alias("v"), "chrom", "pos", "rnk")


def spike_in(spark, k_pool, k_hom, scenarios: list[tuple[float, float]], n_rep: int, seed: int = 17) -> DataFrame:
    """Draw additive plus homolog traits and re-estimate both shares."""
    for k in (k_pool, k_hom):
        if abs(np.trace(k) / len(k) - 1) > 0.05:
            raise ValueError("kernels must have trace n")
    n = len(k_pool)
    la, lh = (np.linalg.cholesky(mm.pull_psd(k, 1e-6) + 1e-8 * np.eye(n)) for k in (k_pool, k_hom))

    def draw(row, sh):
        la_, lh_, ka, kh = sh
        rng = np.random.default_rng(row.seed)
        y = (np.sqrt(row.h_a) * la_ @ rng.standard_normal(n) + np.sqrt(row.h_e) * lh_ @ rng.standard_normal(n)
             + np.sqrt(1 - row.h_a - row.h_e) * rng.standard_normal(n))
        f = mm.fit_reml(y, np.ones((n, 1)), {"K_pool": ka, "K_hom": kh}, n_starts=2, seed=1)
        return [{"h_a": row.h_a, "h_e": row.h_e, "rep": row.rep, "pve_pool": float(f.pve["K_pool"]), "pve_hom": float(f.pve["K_hom"])}]
    jobs = [(float(a), float(b), r, s) for a, b in scenarios for r, s in enumerate(seeds(seed, n_rep))]
    return fan_out(spark, jobs, "h_a double, h_e double, rep bigint, seed bigint", draw,
                   "h_a double, h_e double, rep bigint, pve_pool double, pve_hom double", (la, lh, k_pool, k_hom))


def pair_benchmark(spark, burdens: DataFrame, pairs: DataFrame, kernels: dict, n_rep: int, beta: float = 0.8) -> DataFrame:
    """Share of simulated interaction traits whose causal pair passes 0.05 / G, per test.

    Each replicate has its own causal pair (by hash order) and trait seed; the trait is built
    inside the pair pass from the broadcast causal vectors (n_rep x n values).
    """
    from alloscan.operators.pair_scan import map_pairs
    keys = pairs.select("gene_x", "gene_y")
    chosen = keys.orderBy(F.xxhash64("gene_x", "gene_y"), "gene_x", "gene_y").limit(n_rep)
    cv = map_pairs(chosen, burdens, lambda bx, by: {"prod": list(bx * by)}, "prod array<double>").collect()
    n = len(next(iter(kernels.values())))
    traits = {}
    for i, c in enumerate(sorted(cv, key=lambda r: (r["gene_x"], r["gene_y"]))):
        v = np.asarray(c["prod"])
        y = beta * (v - v.mean()) / (v.std() or 1) + np.random.default_rng(1000 + i).standard_normal(n)
        traits[i] = (c["gene_x"], c["gene_y"], y - y.mean())
    bc = spark.sparkContext.broadcast(traits)
    n_pairs = keys.agg(F.count("*")).scalar()

    def fn(bx, by):
        eye, out = np.eye(n), []
        for i, (gx, gy, y) in bc.value.items():
            out.append({"rep": i, "cx": gx, "cy": gy, "interaction": mm.interaction_tests(eye, y, bx, by)[2],
                        "marginal": np.minimum(mm.marginal_tests(eye, y, bx), mm.marginal_tests(eye, y, by)),
                        "product_alone": mm.marginal_tests(eye, y, bx * by)})
        return out
    t = map_pairs(keys, burdens, fn, "rep bigint, cx string, cy string, interaction double, marginal double, product_alone double")
    hit = t.where((F.col("gene_x") == F.col("cx")) & (F.col("gene_y") == F.col("cy")))
    long = hit.select("rep", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("p"))
                                                 for m in ("interaction", "marginal", "product_alone")])).alias("x")).select("rep", "x.*")
    g = long.groupBy("method").agg(F.count("*").alias("n"), F.count_if(F.col("p") < 0.05 / n_pairs).alias("n_detected"))
    lo, hi = sc.wilson(F.col("n_detected"), F.col("n"))
    return g.select("method", "n", "n_detected", (F.col("n_detected") / F.col("n")).alias("power"), lo.alias("ci_lo"), hi.alias("ci_hi"))


def chibar_quantiles(k: int, qs=(0.95, 0.99)) -> list[tuple[float, float]]:
    w = sp.chibar_weights(k)
    return [(q, sp.chibar_quantile(q, w)) for q in qs]
