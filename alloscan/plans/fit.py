"""Association run: settings -> samples -> kernels -> variance components -> scan -> tables."""

from __future__ import annotations

import time
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alloscan.functions import mixed_model as mm
from alloscan.functions.stat_columns import genomic_inflation
from alloscan.operators import relationship as rel
from alloscan.operators import score_scan as scan
from alloscan.sources import sinks
from alloscan.sources.plink import read_bed, sample_ids
from alloscan.sources.text import phenotype_means

MIN_SAMPLES = 20
KNOWN_KEYS = {"panel", "subgenomes", "bed", "grm_bed", "phenotype", "sample_col", "trait", "out_dir", "kernels", "loco",
              "maf_min", "call_rate_min", "grm_maf_min", "n_starts", "seed", "allow_integer_ids"}


def validate(cfg: dict) -> list[str]:
    """Problems of a run configuration; empty when it can start."""
    bad = [f"unknown key {k!r}" for k in sorted(set(cfg) - KNOWN_KEYS)]
    bad += [f"missing key {k!r}" for k in ("subgenomes", "bed", "phenotype", "sample_col", "trait", "out_dir") if not cfg.get(k)]
    subs = cfg.get("subgenomes") or []
    if len(set(subs)) != len(subs):
        bad.append("subgenomes repeat")
    for k, lo, hi in (("maf_min", 0, 0.5), ("call_rate_min", 0, 1)):
        if not lo <= float(cfg.get(k, lo)) <= hi:
            bad.append(f"{k} must lie in [{lo}, {hi}]")
    if not bad:
        for s in subs:
            pre = cfg["bed"].format(subgenome=s)
            bad += [f"{pre}{e} is missing" for e in (".bed", ".bim", ".fam") if not Path(pre + e).exists()]
        if not Path(cfg["phenotype"]).exists():
            bad.append(f"{cfg['phenotype']} is missing")
    return bad


def check_phenotype(ph: DataFrame, sample_col: str, trait: str, allow_integer_ids: bool = False) -> list[str]:
    """Blocking checks: columns exist, and ids that all look like integers need an explicit yes."""
    bad = [f"column {c!r} not in {ph.columns}" for c in (sample_col, trait) if c not in ph.columns]
    if not bad and not allow_integer_ids:
        if ph.agg(F.bool_and(F.col(sample_col).cast("string").rlike(r"^-?\d+$"))).first()[0]:
            bad.append(f"all values of {sample_col!r} look like integers; confirm they are sample ids")
    return bad


def join_samples(ph: DataFrame, typed: dict[str, list[str]], trait: str) -> tuple[list[str], np.ndarray]:
    """Samples typed in every subgenome with a trait value, in the order of the first panel."""
    first = next(iter(typed.values()))
    for s, ids in typed.items():
        if len(set(ids)) != len(ids):
            raise ValueError(f"sample ids repeat in subgenome {s}")
    if len(first) > rel.MAX_PANEL:
        raise ValueError(f"panel has over {rel.MAX_PANEL} samples")
    spark = ph.sparkSession
    want = spark.createDataFrame([(i, x) for i, x in enumerate(first)], "ord bigint, sample string")
    for ids in list(typed.values())[1:]:
        want = want.join(spark.createDataFrame([(x,) for x in ids], "sample string"), "sample", "left_semi")
    rows = want.join(ph, "sample").orderBy("ord").select("sample", trait).collect()  # the bounded panel
    if len(rows) < MIN_SAMPLES:
        raise ValueError(f"only {len(rows)} samples have genotypes and {trait}; at least {MIN_SAMPLES} are needed")
    return [r["sample"] for r in rows], np.array([float(r[trait]) for r in rows])


def aligned(variants: DataFrame, have: list[str], want: list[str]) -> DataFrame:
    """Dosage arrays reordered to the analysis samples."""
    slot = {s: i for i, s in enumerate(have)}
    missing = [s for s in want if s not in slot]
    if missing:
        raise ValueError(f"samples without genotypes: {missing[:5]}")
    idx = F.array(*[F.lit(slot[s]) for s in want])
    return variants.withColumn("dosage", F.transform(idx, lambda i: F.get("dosage", i).cast("double")))


def run_fit(spark: SparkSession, cfg: dict, dry_run: bool = False, force: bool = False) -> dict:
    """Run one trait; returns the summary that is also written as JSON."""
    problems = validate(cfg)
    if problems:
        raise ValueError("; ".join(problems))
    if dry_run:
        return {"status": "dry_run", "problems": []}
    out = Path(cfg["out_dir"])
    if out.exists() and any(out.iterdir()) and not force:
        raise FileExistsError(f"{out} is not empty; use force to write into it")
    t0 = time.time()
    subs, trait = list(cfg["subgenomes"]), cfg["trait"]
    raw = spark.read.csv(cfg["phenotype"], sep="\t", header=True)
    problems = check_phenotype(raw, cfg["sample_col"], trait, cfg.get("allow_integer_ids", False))
    if problems:
        raise ValueError("; ".join(problems))
    ph = phenotype_means(raw.withColumn(trait, F.col(trait).try_cast("double")), cfg["sample_col"], trait)
    pre = {s: cfg["bed"].format(subgenome=s) for s in subs}
    gpre = {s: cfg.get("grm_bed", cfg["bed"]).format(subgenome=s) for s in subs}
    typed = {s: sample_ids(pre[s]) for s in subs}
    ids, y = join_samples(ph, typed, trait)
    n, x = len(ids), np.ones((len(ids), 1))
    grm_in = [aligned(read_bed(spark, gpre[s], subgenome=s), sample_ids(gpre[s]), ids).withColumn("grp", F.concat_ws("|", "subgenome", "chrom"))
              for s in subs]
    both = grm_in[0]
    for g in grm_in[1:]:
        both = both.unionByName(g)
    parts = rel.gram_parts(both, n, "grp", float(cfg.get("grm_maf_min", cfg.get("maf_min", 0.01)))).persist()
    fam = F.split("grp", r"\|")[0]
    k = rel.grm(parts.withColumn("grp", fam))
    grms = {s: mm.pull_psd(m, 1e-6) for s, m in rel.dense(k, n).items()}
    kernels = {s: grms[s] for s in subs}
    hom = mm.homolog_kernel(kernels, cfg.get("kernels", "auto"))
    if hom is not None:
        kernels["K_hom"] = hom
    f = mm.fit_reml(y, x, kernels, n_starts=int(cfg.get("n_starts", 3)), seed=int(cfg.get("seed", 42)))
    totals = rel.part_totals(parts).withColumn("subgenome", fam).groupBy("subgenome").agg(F.sum("n_used").alias("n_used"), F.sum("n_in").alias("n_in"))
    n_used = {r["subgenome"]: (r["n_in"], r["n_used"]) for r in totals.collect()}
    maf, cr = float(cfg.get("maf_min", 0.01)), float(cfg.get("call_rate_min", 0.9))
    if cfg.get("loco"):
        of = parts.select("grp").distinct().withColumn("family", fam)
        dense = rel.dense(rel.loco(parts, of), n)
        ctx = {}
        for grp, m in dense.items():
            s = grp.split("|")[0]
            ks = {**kernels, s: mm.pull_psd(m, 1e-6)}
            if hom is not None:
                ks["K_hom"] = mm.homolog_kernel({q: ks[q] for q in subs}, cfg.get("kernels", "auto"))
            ctx[grp] = mm.null_context(y, x, ks, f.sigma2)
    else:
        ctx = {None: mm.null_context(y, x, kernels, f.sigma2)}
    res = None
    for s in subs:
        v = aligned(read_bed(spark, pre[s], subgenome=s), typed[s], ids).withColumn("grp", F.concat_ws("|", "subgenome", "chrom"))
        v = v.withColumnRenamed("variant_index", "v")
        keep = ["snp_id", "subgenome", "chrom", "pos", "grp"]
        one = scan.kernel_scan(v.select("v", "dosage", *keep), ctx, maf, cr, "grp" if cfg.get("loco") else None, keep)
        res = one if res is None else res.unionByName(one)
    full = f"{out}/scan_all"
    res.drop("grp").write.mode("overwrite").parquet(full)  # every marker with its status, read for all summaries
    res = spark.read.parquet(full)
    ok = res.where(F.col("status") == "ok").drop("status")
    stats = ok.select("snp_id", "subgenome", "chrom", "pos", F.col("v").alias("variant_index"), "beta", "se", "chi2", "p", "n_obs", "maf", "call_rate")
    sinks.write_sumstats(stats, f"{out}/sumstats")
    stats = spark.read.parquet(f"{out}/sumstats")
    lam = genomic_inflation(stats, ["subgenome", "chrom"])
    sinks.write_tsv(lam, f"{out}/lambda_gc", gzip=False)
    status = {r["status"]: r["count"] for r in res.groupBy("status").count().collect()}
    qc = scan.qc_summary(stats).first().asDict()
    lam_all = next((r["lambda_gc"] for r in lam.where("scope = 'all'").collect()), None)
    checks = {"scan_not_empty": qc["n_rows"] > 0, "p_in_range": qc["n_p_out_of_range"] == 0 and qc["n_p_nonfinite"] == 0,
              "chi2_valid": qc["n_chi2_negative"] == 0 and qc["n_chi2_nonfinite"] == 0, "reml_converged": f.converged,
              "counts_add_up": sum(status.values()) == res.count()}
    var = spark.createDataFrame([(c, float(f.pve[c]), float(f.sigma2[c]), "residual" if c == "e" else "homolog" if c == "K_hom" else "subgenome", c in f.boundary)
                                 for c in f.sigma2], "component string, pve double, sigma2 double, kind string, is_boundary boolean")
    sinks.write_tsv(var, f"{out}/variance", gzip=False)
    doc = {"trait": trait, "n_samples": n, "subgenomes": subs, "loco": bool(cfg.get("loco")), "loglik": f.loglik,
           "sigma2": f.sigma2, "pve": f.pve, "boundary": f.boundary, "grm_markers": {s: {"n_in": a, "n_used": b} for s, (a, b) in n_used.items()},
           "scan_status": status, "lambda_gc": lam_all, "qc": qc, "checks": checks, "accepted": all(checks.values()), "seconds": round(time.time() - t0, 2)}
    sinks.write_json(doc, f"{out}/summary.json")
    parts.unpersist()
    return doc


def top_hits(spark: SparkSession, out_dir: str, n: int = 10) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/sumstats").orderBy("p", "snp_id").limit(n)
