"""Candidate tables: allele frames, sequence windows, score fusion, tiers and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloscan.operators import scan_order as so


def check_chrom_map(cmap: DataFrame, panel_max: DataFrame, lengths: DataFrame) -> DataFrame:
    """Status of each mapped chromosome: missing record, no variants, overflow or fine."""
    j = (cmap.join(panel_max.select(F.col("chrom").alias("panel_chrom"), F.col("max_pos").alias("panel_max_pos")), "panel_chrom", "left")
         .join(lengths.select(F.col("chrom").alias("fasta_chrom"), F.col("length").alias("fasta_chrom_length")), "fasta_chrom", "left"))
    return j.withColumn("status", F.when(F.col("fasta_chrom_length").isNull(), "FASTA_MISSING")
                        .when(F.col("panel_max_pos").isNull(), "NO_VARIANTS")
                        .when(F.col("panel_max_pos") > F.col("fasta_chrom_length"), "OVERFLOW").otherwise("OK"))


def complement(base: Column) -> Column:
    return F.translate(base, "ACGT", "TGCA")


def allele_status(found: Column, agrees: Column, base: Column, a1: Column, a2: Column) -> Column:
    """Which allele the reference base is; a direct match precedes the other strand."""
    is1, is2 = a1.isin("A", "C", "G", "T"), a2.isin("A", "C", "G", "T")
    both = is1 & is2
    return (F.when(~found, "BIM_MISSING").when(~agrees, "BIM_CAND_DISAGREE").when(base.isNull(), "FASTA_KEYERR")
            .when(~base.isin("A", "C", "G", "T"), "FASTA_NON_ACGT")
            .when((base == a1) & is2, "A1_IS_REF").when((base == a2) & is1, "A2_IS_REF")
            .when(both & (complement(base) == a1), "A1_IS_REF_RC").when(both & (complement(base) == a2), "A2_IS_REF_RC")
            .otherwise("REF_MISMATCH"))


def harmonize(cand: DataFrame, bim: DataFrame, pieces: DataFrame) -> DataFrame:
    """Reference and alternate allele per candidate; effect columns are left alone.

    ``cand``: ``snp, chrom, pos``; ``bim``: ``snp, bim_chrom, bim_pos, a1, a2``.
    """
    from alloscan.sources.text import fasta_bases
    c = fasta_bases(pieces, cand, "snp").join(bim, "snp", "left")
    a1, a2, base = F.upper("a1"), F.upper("a2"), F.upper("base")
    agrees = (F.col("bim_chrom") == F.col("chrom")) & ((F.col("pos") <= 0) | (F.col("bim_pos") == F.col("pos")))
    st = allele_status(F.col("a1").isNotNull(), agrees, base, a1, a2)
    c = c.withColumn("ref_match_status", st)
    seen = F.col("ref_match_status").isin("A1_IS_REF", "A2_IS_REF", "A1_IS_REF_RC", "A2_IS_REF_RC", "REF_MISMATCH")
    s = F.col("ref_match_status")
    return (c.withColumn("ref_fasta", F.when(seen, base))
            .withColumn("alt_fasta", F.when(s == "A1_IS_REF", a2).when(s == "A2_IS_REF", a1)
                        .when(s == "A1_IS_REF_RC", complement(a2)).when(s == "A2_IS_REF_RC", complement(a1)))
            .withColumn("is_palindromic", F.coalesce(seen & F.concat(a1, a2).isin("AT", "TA", "CG", "GC"), F.lit(False))))


def sequence_window(df: DataFrame, half: int, near: int = 50) -> DataFrame:
    """Window of ``half`` bases around 1-based ``pos`` in ``seq`` with its status."""
    a = F.greatest(F.lit(0), F.col("pos") - 1 - half)
    w = df.withColumn("_a", a).withColumn("_w", F.substring("seq", (F.col("_a") + 1).cast("int"), (F.col("pos") + half - F.col("_a")).cast("int")))
    w = w.withColumn("_o", F.col("pos") - 1 - F.col("_a")).withColumn("_n", F.length("_w"))
    lo = F.greatest(F.lit(0), F.col("_o") - near)
    flank = F.substring("_w", (lo + 1).cast("int"), (F.least(F.col("_n"), F.col("_o") + near + 1) - lo).cast("int"))
    st = (F.when(F.col("_o") >= F.col("_n"), "WINDOW_OOB").when(F.col("_n") < 2 * half, "WINDOW_TRUNCATED")
          .when(flank.contains("N"), "WINDOW_HAS_N_NEAR_SNP").otherwise("OK"))
    w = w.withColumn("status", st)
    return w.withColumn("window", F.when(F.col("status") == "OK", F.translate("_w", "N", "A"))
                        .when(F.col("status") == "WINDOW_TRUNCATED", F.col("_w"))).drop("_a", "_w", "_o", "_n")


def collapse_sources(cand: DataFrame, key: str = "snp") -> DataFrame:
    """One row per marker: the row with smallest p (missing = 1), sources joined in order.

    The source labels are a handful of names, so the set per marker is bounded.
    """
    c = cand.withColumn("p", F.coalesce("p", F.lit(1.0)))
    rest = [x for x in cand.columns if x not in (key, "source")]
    return c.groupBy(key).agg(F.min(F.struct("p", *[x for x in rest if x != "p"])).alias("m"),
                              F.array_join(F.sort_array(F.collect_set("source")), ";").alias("source")).select(key, "m.*", "source")


def fuse(df: DataFrame, z_gwas: str, z_prior: str, beta) -> Column:
    return F.coalesce(z_gwas, F.lit(0.0)) + beta * F.coalesce(z_prior, F.lit(0.0))


def ensemble(*z: str) -> Column:
    """Mean of the available z scores; null when none is available."""
    n = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in z[1:]), F.when(F.col(z[0]).isNotNull(), 1).otherwise(0))
    s = sum((F.coalesce(c, F.lit(0.0)) for c in z[1:]), F.coalesce(z[0], F.lit(0.0)))
    return F.when(n > 0, s / n)


# fixed values: weights tried for the prior, and the weight used when they cannot be told apart
BETA_GRID = (0.0, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0)
BETA_DEFAULT = 0.25
MIN_QTLS = 5


def recovered_by_beta(cand: DataFrame, top_n: int, grid=BETA_GRID) -> DataFrame:
    """(beta, qtl): QTLs with an in-window marker among the top_n by fused score, per weight.

    ``cand``: ``id, z_gwas, z_llr_abs, qtl, in_window``. Only the top_n rows per weight are
    kept, found by a salted two-step top-k.
    """
    b = cand.withColumn("beta", F.explode(F.array(*[F.lit(float(x)) for x in grid])))
    b = b.withColumn("score", fuse(b, "z_gwas", "z_llr_abs", F.col("beta")))
    top = so.top_k(b.select("id", "beta", "score", "qtl", "in_window"), ["beta"], [F.desc("score"), F.asc("id")], top_n)
    return top.where(F.col("in_window")).select("beta", "qtl").distinct()


def choose_beta(rec: DataFrame, recoverable: DataFrame, grid=BETA_GRID) -> DataFrame:
    """Leave-one-QTL-out choice: mean recall over held-out QTLs per weight.

    Leaving out q, recall is |R minus q| / (m - 1); its mean over q equals |R| / m, so one
    count per weight decides. Under five QTLs or on a plateau the default weight is kept.
    """
    m = recoverable.agg(F.count("*")).scalar()
    n = rec.join(recoverable, "qtl", "left_semi").groupBy("beta").agg(F.count("*").alias("n"))
    pick = lambda x: F.max(F.when(F.col("beta") == x, F.col("n")))
    cnt = [F.coalesce(pick(x), F.lit(0)) for x in grid]
    a = n.agg(F.array(*[F.struct((c / m).alias("recall"), F.lit(-float(i)).alias("o"), F.lit(float(x)).alias("beta"))
                        for i, (x, c) in enumerate(zip(grid, cnt))]).alias("a"), F.first(F.lit(1)).alias("one"))
    best = F.array_max("a")
    base = F.col("a")[0]["recall"]
    beta = (F.when(m < 5, BETA_DEFAULT).when(best["recall"] - base < 1e-6, BETA_DEFAULT).otherwise(best["beta"]))
    mode = (F.when(m < 5, "locked_beta_low_recoverable").when(best["recall"] - base < 1e-6, "locked_beta_recall_plateau").otherwise("loqo_search"))
    return a.select(m.alias("n_recoverable"), base.alias("recall_base"), best["recall"].alias("recall_best"), beta.alias("beta"), mode.alias("mode"))


def nested_lift(rec: DataFrame, recoverable: DataFrame, grid=BETA_GRID) -> DataFrame:
    """Per QTL: weight chosen on the other QTLs, and whether it recovers this one (against weight 0).

    Where the others are fewer than ``MIN_QTLS``, or no weight finds more of them than weight 0, the default is used.
    """
    m = recoverable.agg(F.count("*")).scalar()
    n = rec.join(recoverable, "qtl", "left_semi").groupBy("beta").agg(F.count("*").alias("n"))
    cells = recoverable.select("qtl", F.explode(F.array(*[F.struct(F.lit(float(x)).alias("beta"), F.lit(-i).alias("o"))
                                                          for i, x in enumerate(grid)])).alias("g")).select("qtl", "g.*")
    f = cells.join(F.broadcast(n), "beta", "left").join(rec.withColumn("hit", F.lit(1)), ["beta", "qtl"], "left")
    f = f.select("qtl", "beta", "o", F.coalesce("hit", F.lit(0)).alias("hit"), (F.coalesce("n", F.lit(0)) - F.coalesce("hit", F.lit(0))).alias("others"))
    g = f.groupBy("qtl").agg(F.max(F.struct("others", "o", "beta", "hit")).alias("best"),
                             F.max(F.when(F.col("beta") == 0, F.struct("others", "hit"))).alias("base"),
                             F.max(F.when(F.col("beta") == BETA_DEFAULT, F.col("hit"))).alias("hit_default"))
    flat = (F.col("best.others") <= F.col("base.others")) | (m - 1 < MIN_QTLS)
    return g.select("qtl", F.when(flat, BETA_DEFAULT).otherwise(F.col("best.beta")).alias("beta"),
                    F.when(flat, F.col("hit_default")).otherwise(F.col("best.hit")).alias("hit_fused"), F.col("base.hit").alias("hit_gwas"))


def qtl_best_ranks(cand: DataFrame, beta: float) -> DataFrame:
    """Best rank of each QTL's in-window markers by scan evidence and by fused score."""
    c = cand.withColumn("_s", -fuse(cand, "z_gwas", "z_llr_abs", F.lit(beta))).withColumn("_g", -F.coalesce("z_gwas", F.lit(0.0)))
    c = so.row_position(so.row_position(c, ["_g", "id"], "r_gwas"), ["_s", "id"], "r_fused")
    q = c.where(F.col("in_window")).groupBy("qtl").agg(F.count("*").alias("n_in_window"), (F.min("r_gwas") + 1).alias("best_gwas_rank"),
                                                       (F.min("r_fused") + 1).alias("best_fused_rank"))
    return q.withColumn("rank_improvement", F.col("best_gwas_rank") - F.col("best_fused_rank"))


def confidence_tier(p_limit: float, r2_limit: float, min_envs: int) -> Column:
    """QUARANTINED by LD to a known locus, else HIGH_CONFIDENCE only if every support holds."""
    support = ((F.col("p") < p_limit) & F.col("concordant") & (F.col("n_envs_nominal") >= min_envs)
               & (F.col("n_envs_same_direction") >= min_envs))
    return F.when(F.col("max_r2_known") >= r2_limit, "QUARANTINED").when(support, "HIGH_CONFIDENCE").otherwise("SUPPLEMENTARY")


def environment_fits(calls: DataFrame, env: DataFrame, min_n: int = 20) -> DataFrame:
    """Slope, error, t and r of y on dosage per (lead, environment); at least ``min_n`` samples.

    ``calls``: ``lead, s, d`` already filled; ``env``: ``s, env, y``.
    """
    a = calls.join(env, "s").groupBy("lead", "env").agg(
        F.count("*").alias("n"), F.regr_slope("y", "d").alias("beta"), F.corr("y", "d").alias("r"),
        F.regr_sxx("y", "d").alias("sxx"), F.regr_syy("y", "d").alias("syy"))
    a = a.where((F.col("n") >= min_n) & (F.col("sxx") > 0))
    se = F.sqrt((1 - F.col("r") * F.col("r")) * F.col("syy") / F.col("sxx") / (F.col("n") - 2))
    return a.withColumn("se", se).withColumn("t", F.col("beta") / F.col("se")).drop("sxx", "syy")


def environment_summary(fits: DataFrame, nominal: Column, sign_of: DataFrame) -> DataFrame:
    """Per lead: environments tested, nominal, and agreeing in sign with the scan effect."""
    j = fits.join(sign_of.select("lead", F.col("beta").alias("beta_scan")), "lead")
    return j.groupBy("lead").agg(F.count("*").alias("n_envs_tested"), F.count_if(nominal).alias("n_envs_nominal"),
                                 F.count_if(F.signum("beta") == F.signum("beta_scan")).alias("n_envs_same_direction"),
                                 F.min(F.abs("t")).alias("min_abs_t"), F.max(F.abs("t")).alias("max_abs_t"))
