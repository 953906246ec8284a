"""Queries over candidates: fusion with priors, recall, tiers, environments, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alloscan.catalog import tables as t
from alloscan.catalog.interval_queries import nearest
from alloscan.catalog.kernel_queries import wide
from alloscan.catalog.registry import big, query, r
from alloscan.functions import stat_columns as sc
from alloscan.operators import candidates as cd
from alloscan.operators import clumping as cl
from alloscan.operators import genotype as gt
from alloscan.operators import ranking as rk
from alloscan.operators import resampling as rs
from alloscan.operators import scan_order as so
from alloscan.session import cut_lineage

_CAND = """
, nr AS (SELECT v, snp, ss.chrom, pos, chi2, p, qtl, abs(pos - qpos) AS dist FROM
         (SELECT ss.*, qtl, qpos, row_number() OVER (PARTITION BY v ORDER BY abs(pos - qpos), qid) AS rn FROM ss LEFT JOIN qt ON qt.chrom = ss.chrom) ss WHERE rn = 1),
sc1 AS (SELECT vec_id AS v, round(CAST(embedding[1] AS DOUBLE), 9) AS l1 FROM embeddings WHERE label <> 3),
sc2x AS (SELECT vec_id AS v, round(CAST(embedding[2] AS DOUBLE), 9) AS l2 FROM embeddings WHERE label <> 4),
ca AS (SELECT nr.v, snp, chi2, qtl, dist <= 100000 AS in_window, l1, l2 FROM nr LEFT JOIN sc1 USING (v) LEFT JOIN sc2x USING (v)),
md AS (SELECT median(chi2) AS mg, median(abs(l1)) AS m1, median(abs(l2)) AS m2 FROM ca),
ma AS (SELECT max(mg) AS mg, max(m1) AS m1, max(m2) AS m2, median(abs(chi2 - mg)) AS ag, median(abs(abs(l1) - m1)) AS a1, median(abs(abs(l2) - m2)) AS a2 FROM ca CROSS JOIN md),
cz AS (SELECT v, snp, qtl, in_window, round((chi2 - mg) / (1.4826 * ag), 9) AS zg, round((abs(l1) - m1) / (1.4826 * a1), 9) AS z1, round((abs(l2) - m2) / (1.4826 * a2), 9) AS z2 FROM ca CROSS JOIN ma)
"""


def scores(spark, d):
    """Two prior score tables; only rows with an accepted status are used."""
    e = t.table(spark, d, "embeddings")
    st = lambda i: F.when(F.col("label") != i, "OK").otherwise("FAILED")
    val = lambda i: F.round(F.col("embedding")[i].cast("double"), 9)
    a = e.select(F.col("vec_id").alias("v"), val(0).alias("l1"), st(3).alias("status")).where("status = 'OK'").drop("status")
    b = e.select(F.col("vec_id").alias("v"), val(1).alias("l2"), st(4).alias("status")).where("status = 'OK'").drop("status")
    return a, b


def joined(spark, d):
    a, b = scores(spark, d)
    n = nearest(spark, d).select("v", "snp", "chi2", F.col("near_name").alias("qtl"), (F.col("near_dist") <= 100000).alias("in_window"))
    return n.join(a, "v", "left").join(b, "v", "left")


def scored(spark, d):
    c = joined(spark, d).withColumn("a1", F.abs("l1")).withColumn("a2", F.abs("l2"))
    c = rk.robust_z(c, {"chi2": "z_gwas", "a1": "z1", "a2": "z2"})
    z = [F.round(x, 9).alias(x) for x in ("z_gwas", "z1", "z2")]
    return cut_lineage(c.select("v", "snp", "qtl", F.coalesce("in_window", F.lit(False)).alias("in_window"), *z))


def for_fusion(spark, d):
    return scored(spark, d).select(F.col("v").alias("id"), "snp", "qtl", "in_window", "z_gwas", F.col("z1").alias("z_llr_abs"))


@query("join_scores", _CAND + "SELECT snp, l1 AS llr_first, l2 AS llr_second FROM ca")
def join_scores(spark, d):
    return joined(spark, d).select("snp", F.col("l1").alias("llr_first"), F.col("l2").alias("llr_second"))


@query("fn_fusion", _CAND + """
SELECT snp, round(coalesce(zg, 0) + 0.5 * coalesce(z1, 0), 5) + 0.0 AS fusion,
  round(CASE WHEN z1 IS NULL THEN z2 WHEN z2 IS NULL THEN z1 ELSE (z1 + z2) / 2 END, 5) + 0.0 AS ensemble FROM cz""")
def fn_fusion(spark, d):
    return scored(spark, d).select("snp", r(cd.fuse(None, "z_gwas", "z1", F.lit(0.5)), "fusion", 5), r(cd.ensemble("z1", "z2"), "ensemble", 5))


_REC = _CAND + """
, bg AS (SELECT b, i FROM (VALUES (0.0, 0), (0.1, 1), (0.25, 2), (0.5, 3), (1.0, 4), (2.0, 5), (5.0, 6)) x(b, i)),
rb AS (SELECT CAST(b AS DOUBLE) AS b, i, qtl, in_window, row_number() OVER (PARTITION BY b ORDER BY coalesce(zg, 0) + CAST(b AS DOUBLE) * coalesce(z1, 0) DESC, v) AS rn FROM cz CROSS JOIN bg),
rc AS (SELECT DISTINCT b, i, qtl FROM rb WHERE rn <= 60 AND in_window),
rq AS (SELECT DISTINCT qtl FROM cz WHERE in_window),
nb AS (SELECT bg.i, CAST(bg.b AS DOUBLE) AS b, count(qtl) AS n FROM bg LEFT JOIN rc ON rc.i = bg.i GROUP BY ALL)
"""


@query("agg_recall_beta", _REC + "SELECT b AS beta, n AS n_recovered FROM nb WHERE n > 0")
def agg_recall_beta(spark, d):
    return cd.recovered_by_beta(for_fusion(spark, d), 60).groupBy("beta").agg(F.count("*").alias("n_recovered"))


@query("k_loqo", _REC + """
, b0 AS (SELECT n FROM nb WHERE i = 0), bb AS (SELECT n, b FROM nb ORDER BY n DESC, i LIMIT 1), m AS (SELECT count(*) AS m FROM rq)
SELECT m AS n_recoverable, round(b0.n / m, 6) AS recall_base, round(bb.n / m, 6) AS recall_best,
  CASE WHEN m < 5 OR bb.n = b0.n THEN 0.25 ELSE CAST(b AS DOUBLE) END AS beta,
  CASE WHEN m < 5 THEN 'locked_beta_low_recoverable' WHEN bb.n = b0.n THEN 'locked_beta_recall_plateau' ELSE 'loqo_search' END AS mode FROM b0 CROSS JOIN bb CROSS JOIN m""")
def k_loqo(spark, d):
    c = for_fusion(spark, d)
    rec = cd.recovered_by_beta(c, 60)
    rq = c.where("in_window").select("qtl").distinct()
    k = cd.choose_beta(rec, rq)
    return k.select(big("n_recoverable"), r("recall_base", "recall_base"), r("recall_best", "recall_best"), r("beta", "beta"), "mode")


@query("k_nested_loqo", _REC + """
, f AS (SELECT rq.qtl, nb.b, nb.i, CASE WHEN rc.qtl IS NULL THEN 0 ELSE 1 END AS hit, nb.n - CASE WHEN rc.qtl IS NULL THEN 0 ELSE 1 END AS oth
        FROM rq CROSS JOIN nb LEFT JOIN rc ON rc.i = nb.i AND rc.qtl = rq.qtl),
w AS (SELECT qtl, max(oth) FILTER (i = 0) AS o0, max(hit) FILTER (i = 0) AS h0, max(hit) FILTER (i = 2) AS hd, max(oth) AS om, arg_max(b, (oth, -i)) AS bm, arg_max(hit, (oth, -i)) AS hm FROM f GROUP BY qtl)
SELECT qtl, CASE WHEN om <= o0 OR few THEN 0.25 ELSE bm END AS beta, CAST(CASE WHEN om <= o0 OR few THEN hd ELSE hm END AS BIGINT) AS hit_fused, CAST(h0 AS BIGINT) AS hit_gwas
FROM w CROSS JOIN (SELECT count(*) - 1 < 5 AS few FROM rq)""")
def k_nested_loqo(spark, d):
    c = for_fusion(spark, d)
    n = cd.nested_lift(cd.recovered_by_beta(c, 60), c.where("in_window").select("qtl").distinct())
    return n.select("qtl", r("beta", "beta"), big("hit_fused"), big("hit_gwas"))


@query("k_nested_prior")
def k_nested_prior(spark, d):
    """Nested lift with its interval over resampled QTLs and its place among permuted priors."""
    p = rs.prior_lift(for_fusion(spark, d), 60, n_perm=2000, n_boot=10_000)
    return p.select(big("n_recoverable"), "locked", *[r(c, c) for c in ("lift", "lo", "hi", "p_perm", "null_q50", "null_q95", "null_q99")], big("n_perm"))


_BEST = _CAND + """
, rr AS (SELECT qtl, in_window, row_number() OVER (ORDER BY -coalesce(zg, 0), v) AS rg, row_number() OVER (ORDER BY -(coalesce(zg, 0) + 0.5 * coalesce(z1, 0)), v) AS rf FROM cz),
bq AS (SELECT qtl, count(*) AS n_in_window, min(rg) AS g, min(rf) AS f FROM rr WHERE in_window GROUP BY qtl)
"""


@query("agg_qtl_best", _BEST + "SELECT qtl, n_in_window, g AS best_gwas_rank, f AS best_fused_rank, g - f AS rank_improvement FROM bq")
def agg_qtl_best(spark, d):
    q = cd.qtl_best_ranks(for_fusion(spark, d), 0.5)
    return q.select("qtl", big("n_in_window"), big("best_gwas_rank"), big("best_fused_rank"), big("rank_improvement"))


@query("top_flip", _BEST + """
SELECT qtl, g AS best_gwas_rank, f AS best_fused_rank, round(g / greatest(f, 1), 6) AS ratio FROM bq WHERE f < g ORDER BY g / greatest(f, 1) DESC, qtl LIMIT 15""")
def top_flip(spark, d):
    q = cd.qtl_best_ranks(for_fusion(spark, d), 0.5).where("best_fused_rank < best_gwas_rank")
    q = q.withColumn("x", F.col("best_gwas_rank") / F.greatest(F.col("best_fused_rank"), F.lit(1)))
    return q.orderBy(F.desc("x"), "qtl").limit(15).select("qtl", big("best_gwas_rank"), big("best_fused_rank"), r("x", "ratio"))


@query("agg_collapse_src", """
, u AS (SELECT snp, p, 'lead' AS source FROM ss WHERE chi2 > 3 UNION ALL SELECT snp, NULL, 'sentinel' FROM mk JOIN qt ON qt.chrom = mk.chrom AND abs(pos - qpos) <= 30000
 UNION ALL SELECT mk.snp, ss2.p, 'second' FROM ss2 JOIN mk USING (v) WHERE ss2.chi2 > 3)
SELECT snp, round(min(coalesce(p, 1)), 6) AS p, string_agg(DISTINCT source, ';' ORDER BY source) AS source FROM u GROUP BY snp""")
def agg_collapse_src(spark, d):
    from alloscan.operators import intervals as iv
    a = t.sumstats(spark, d).where("chi2 > 3").select("snp", "p", F.lit("lead").alias("source"))
    q = t.qtl(spark, d).select("chrom", "qpos")
    b = iv.points_in_intervals(t.markers(spark, d).select("snp", "chrom", "pos"), q, F.col("qpos") - 30000, F.col("qpos") + 30000)
    b = b.select("snp", F.lit(None).cast("double").alias("p"), F.lit("sentinel").alias("source"))
    c = t.sumstats(spark, d, 2).where("chi2 > 3").select("snp", "p", F.lit("second").alias("source"))
    return cd.collapse_sources(a.unionByName(b).unionByName(c)).select("snp", r("p", "p"), "source")


_ENV = """
, le AS (SELECT v, sum(z * y) / sum(z * z) AS beta FROM zc JOIN yc USING (s) WHERE v IN (SELECT v FROM ss WHERE chi2 > 4) GROUP BY v),
yd AS (SELECT l_suppkey % 40 AS s, l_returnflag || l_linestatus AS env, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / count(*) / 100 AS y FROM lineitem GROUP BY ALL),
fd AS (SELECT le.v, ph.s, coalesce(g.d, q.mean) AS d FROM le CROSS JOIN ph JOIN q ON q.v = le.v LEFT JOIN g ON g.v = le.v AND g.s = ph.s),
fe AS (SELECT fd.v, env, count(*) AS n, regr_slope(yd.y, d) AS beta, corr(yd.y, d) AS rr, regr_sxx(yd.y, d) AS sxx, regr_syy(yd.y, d) AS syy FROM fd JOIN yd USING (s) GROUP BY ALL),
fx AS (SELECT *, beta / sqrt((1 - rr * rr) * syy / sxx / (n - 2)) AS tt FROM fe WHERE n >= 20 AND sxx > 0)
"""


def env_fits(spark, d, calls=None):
    calls = cut_lineage(t.geno(spark, d)) if calls is None else calls
    lead = t.sumstats(spark, d, p=False, calls=calls).where("chi2 > 4").select("v")
    w = wide(spark, d, calls).join(lead, "v", "left_semi")
    seen = F.filter("dosage", lambda x: x.isNotNull())
    mean = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.size(seen)
    from alloscan.catalog.kernel_queries import panel
    ids = F.array(*[F.lit(int(s)).cast("bigint") for s in panel(spark, d)])
    calls = w.select("v", mean.alias("m"), F.explode(F.arrays_zip(ids.alias("s"), F.col("dosage").alias("d"))).alias("x")).select(
        F.col("v").alias("lead"), F.col("x.s").alias("s"), F.coalesce(F.col("x.d").cast("double"), "m").alias("d"))
    li = t.table(spark, d, "lineitem")
    env = li.groupBy((F.col("l_suppkey") % 40).alias("s"), F.concat("l_returnflag", "l_linestatus").alias("env")).agg(
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / F.count("*") / 100).alias("y"))
    return cd.environment_fits(calls, env)


@query("agg_ols_env", _ENV + "SELECT 'm' || v AS lead_snp, env, n, round(beta, 4) + 0.0 AS beta_env, round(rr, 6) + 0.0 AS r_env, round(tt, 5) + 0.0 AS t_env FROM fx")
def agg_ols_env(spark, d):
    return env_fits(spark, d).select(F.concat(F.lit("m"), F.col("lead").cast("string")).alias("lead_snp"), "env", big("n"),
                                     r("beta", "beta_env", 4), r("r", "r_env"), r("t", "t_env", 5))


def scan_beta(spark, d, calls=None):
    return t.sumstats(spark, d, p=False, calls=calls).where("chi2 > 4").select(F.col("v").alias("lead"), "beta")


@query("agg_env", _ENV + """
SELECT 'm' || fx.v AS lead_snp, count(*) AS n_envs_tested, count(*) FILTER (abs(tt) > 1) AS n_envs_nominal, count(*) FILTER (sign(fx.beta) = sign(le.beta)) AS n_envs_same_direction,
  round(max(abs(tt)), 5) AS max_abs_t FROM fx JOIN le USING (v) GROUP BY fx.v""")
def agg_env(spark, d):
    e = cd.environment_summary(env_fits(spark, d), F.abs("t") > 1, scan_beta(spark, d))
    return e.select(F.concat(F.lit("m"), F.col("lead").cast("string")).alias("lead_snp"), big("n_envs_tested"), big("n_envs_nominal"),
                    big("n_envs_same_direction"), r("max_abs_t", "max_abs_t", 5))


_TIER = _ENV + """
, es AS (SELECT fx.v, count(*) FILTER (abs(tt) > 0.3) AS nn_, count(*) FILTER (sign(fx.beta) = sign(le.beta)) AS ns FROM fx JOIN le USING (v) GROUP BY fx.v),
qs AS (SELECT m.v AS kv FROM qt JOIN mk m ON m.chrom = qt.chrom AND abs(m.pos - qpos) <= 60000),
fa AS (SELECT q.v, ph.s, coalesce(zc.z, 0) AS z FROM q CROSS JOIN ph LEFT JOIN zc ON zc.v = q.v AND zc.s = ph.s),
kr AS (SELECT a.v, power(corr(x.z, y.z), 2) AS r2 FROM ss a JOIN mk b ON b.chrom = a.chrom AND b.v <> a.v JOIN (SELECT DISTINCT kv FROM qs) k ON k.kv = b.v JOIN fa x ON x.v = a.v JOIN fa y ON y.v = b.v AND y.s = x.s
       WHERE a.chi2 > 4 AND abs(a.pos - b.pos) <= 1000000 GROUP BY a.v, b.v),
mr AS (SELECT v, max(r2) AS mr FROM kr GROUP BY v)
"""


def tiered(spark, d):
    """Leads with LD to markers near known QTLs, second-scan support, environment support, tier."""
    from alloscan.operators import intervals as iv
    calls = cut_lineage(t.geno(spark, d))
    s = cut_lineage(t.sumstats(spark, d, calls=calls).where("chi2 > 4").select("v", "chrom", "pos", "p"))
    mk = t.markers(spark, d, calls).select("v", "chrom", "pos")
    known = iv.points_in_intervals(mk, t.qtl(spark, d).select("chrom", "qpos"), F.col("qpos") - 60000, F.col("qpos") + 60000).select(
        "chrom", F.col("v").alias("vb"), F.col("pos").alias("pb")).distinct()
    pr = iv.points_in_intervals(s.select(F.col("v").alias("va"), "chrom", "pos"), known, F.col("pb") - 1_000_000, F.col("pb") + 1_000_000)
    ld = gt.ld_pairs(calls, t.stats(spark, d, calls), pr.where("va <> vb").select("va", "vb").distinct())
    mr = ld.groupBy(F.col("va").alias("v")).agg(F.max("r2").alias("max_r2_known"))
    b = t.sumstats(spark, d, 2, p=False, calls=calls).select("v", (F.col("chi2") > 0.05).alias("concordant"))
    e = cd.environment_summary(env_fits(spark, d, calls), F.abs("t") > 0.3, scan_beta(spark, d, calls)).withColumnRenamed("lead", "v")
    j = s.join(mr, "v", "left").join(b, "v", "left").join(e, "v", "left").na.fill(0)
    j = j.withColumn("max_r2_known", F.coalesce("max_r2_known", F.lit(0.0))).withColumn("concordant", F.coalesce("concordant", F.lit(False)))
    return j.withColumn("tier", cd.confidence_tier(0.05, 0.2, 2))


@query("fn_tier", _TIER + """
SELECT ss.snp, CASE WHEN coalesce(mr, 0) >= 0.2 THEN 'QUARANTINED' WHEN ss.p < 0.05 AND coalesce(ss2.chi2 > 0.05, false) AND coalesce(nn_, 0) >= 2 AND coalesce(ns, 0) >= 2 THEN 'HIGH_CONFIDENCE' ELSE 'SUPPLEMENTARY' END AS tier
FROM ss LEFT JOIN mr USING (v) LEFT JOIN ss2 USING (v) LEFT JOIN es USING (v) WHERE ss.chi2 > 4""")
def fn_tier(spark, d):
    return tiered(spark, d).select(F.concat(F.lit("m"), F.col("v").cast("string")).alias("snp"), "tier")


@query("top_ld_clump", """
, h AS (SELECT v, snp, chrom, pos, p, row_number() OVER (ORDER BY p, v) AS i FROM ss WHERE p < 0.3),
fa AS (SELECT q.v, ph.s, coalesce(zc.z, 0) AS z FROM q CROSS JOIN ph LEFT JOIN zc ON zc.v = q.v AND zc.s = ph.s),
lk AS (SELECT a.i AS a, b.i AS b, power(corr(x.z, y.z), 2) AS r2 FROM h a JOIN h b ON a.chrom = b.chrom AND a.v <> b.v AND abs(a.pos - b.pos) <= 1000000 JOIN fa x ON x.v = a.v JOIN fa y ON y.v = b.v AND y.s = x.s GROUP BY a.i, b.i),
rec AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS leads, CAST(NULL AS BIGINT) AS lead UNION ALL
  SELECT h.i, CASE WHEN z.f IS NULL THEN list_append(rec.leads, h.i) ELSE rec.leads END, coalesce(z.f, h.i) FROM rec JOIN h ON h.i = rec.i + 1,
  LATERAL (SELECT min(lk.b) AS f FROM lk WHERE lk.a = h.i AND list_contains(rec.leads, lk.b) AND lk.r2 >= 0.05) z)
SELECT h.snp, l.snp AS lead_snp, h.i = l.i AS lead_of_locus, round(CASE WHEN h.i = l.i THEN 1.0 ELSE lk.r2 END, 6) AS r2_to_lead
FROM rec JOIN h ON h.i = rec.i JOIN h l ON l.i = rec.lead LEFT JOIN lk ON lk.a = h.i AND lk.b = l.i""")
def top_ld_clump(spark, d):
    from alloscan.catalog.genotype_queries import neighbour_pairs
    calls = cut_lineage(t.geno(spark, d))
    h = cut_lineage(t.sumstats(spark, d, calls=calls).where("p < 0.3").select("v", "chrom", "pos", "p"))
    # only the hits' calls and statistics meet the pairs
    calls = cut_lineage(calls.join(h.select("v"), "v", "left_semi"))
    pr = neighbour_pairs(h, 1_000_000)
    ld = gt.ld_pairs(calls, t.stats(spark, d, calls), pr).select(F.col("va").alias("a"), F.col("vb").alias("b"), "r2")
    x = cl.ld_loci(h.select(F.col("v").alias("id"), "chrom", "p"), ld, 0.05)
    m = lambda c: F.concat(F.lit("m"), F.col(c).cast("string"))
    return x.select(m("id").alias("snp"), m("lead_id").alias("lead_snp"), "lead_of_locus", r("r2_to_lead", "r2_to_lead"))


@query("agg_master", """
SELECT 't1' AS trait, count(*) AS n_markers, count(*) FILTER (chi2 > 10) AS n_strong, count(*) FILTER (chi2 > 5) AS n_suggestive, arg_min(snp, (p, v)) AS lead_snp, round(max(chi2), 6) AS lead_chi2 FROM ss
UNION ALL SELECT 't2', count(*), count(*) FILTER (chi2 > 10), count(*) FILTER (chi2 > 5), arg_min('m' || v, (p, v)), round(max(chi2), 6) FROM ss2""")
def agg_master(spark, d):
    a = t.sumstats(spark, d).withColumn("trait", F.lit("t1")).unionByName(t.sumstats(spark, d, 2).withColumn("trait", F.lit("t2")))
    return a.groupBy("trait").agg(F.count("*").alias("n_markers"), F.count_if(F.col("chi2") > 10).alias("n_strong"), F.count_if(F.col("chi2") > 5).alias("n_suggestive"),
                                  F.min_by("snp", F.struct("p", "v")).alias("lead_snp"), r(F.max("chi2"), "lead_chi2"))


@query("agg_concordance", """
SELECT ss.snp, round(ss.chi2, 6) AS chi2_first, round(ss2.chi2, 6) AS chi2_second, greatest(coalesce(ss.p, 2), 0) <= coalesce(ss2.p, 2) AS first_is_best,
  round(least(ss.p, coalesce(ss2.p, 1)), 6) AS best_p FROM ss LEFT JOIN ss2 ON ss2.v = ss.v AND ss2.chi2 > 0.01 ORDER BY least(ss.p, coalesce(ss2.p, 1)), ss.v LIMIT 15""")
def agg_concordance(spark, d):
    a = t.sumstats(spark, d).select("v", "snp", "chi2", "p")
    b = t.sumstats(spark, d, 2).where("chi2 > 0.01").select("v", F.col("chi2").alias("c2"), F.col("p").alias("p2"))
    j = a.join(b, "v", "left").withColumn("bp", F.least("p", F.coalesce("p2", F.lit(1.0))))
    return j.orderBy("bp", "v").limit(15).select("snp", r("chi2", "chi2_first"), r("c2", "chi2_second"),
                                                 (F.col("p") <= F.coalesce("p2", F.lit(2.0))).alias("first_is_best"), r("bp", "best_p"))


@query("fn_acat", "SELECT gene, round(0.5 - atan(avg(tan((0.5 - least(greatest(p, 1e-300), 1 - 1e-16)) * pi()))) / pi(), 6) AS p_acat, count(*) AS n FROM ss GROUP BY gene")
def fn_acat(spark, d):
    return t.sumstats(spark, d).groupBy("gene").agg(r(sc.acat(F.col("p")), "p_acat"), F.count("*").alias("n"))


@query("fn_acat_w", """
SELECT gene, round(0.5 - atan(sum(maf * tan((0.5 - least(greatest(p, 1e-300), 1 - 1e-16)) * pi())) / sum(maf)) / pi(), 6) AS p_acat FROM ss WHERE maf > 0 GROUP BY gene""")
def fn_acat_w(spark, d):
    return t.sumstats(spark, d).groupBy("gene").agg(r(sc.acat_weighted(F.col("p"), F.col("maf")), "p_acat"))


@query("fn_nlog10", "SELECT snp, round(-log10(greatest(least(p, 1), 1e-300)), 6) + 0.0 AS neglog10p FROM ss")
def fn_nlog10(spark, d):
    return t.sumstats(spark, d).select("snp", r(sc.neglog10(F.col("p")), "neglog10p"))


@query("fn_chi2sf", "SELECT snp, round(p, 9) AS p FROM ss")
def fn_chi2sf(spark, d):
    return t.sumstats(spark, d).select("snp", r("p", "p", 9))


@query("fn_normppf", "SELECT snp, round(chi2, 5) AS chi2 FROM ss WHERE p > 1e-12")
def fn_normppf(spark, d):
    """p back to its chi-square through the inverse normal."""
    return t.sumstats(spark, d).where("p > 1e-12").select("snp", r(sc.chi2_from_p(F.col("p")), "chi2", 5))


# two-sided Student p for whole degrees of freedom: finite sums of powers of a cosine, for even and for odd n - 2
_T = """
, th AS (SELECT v, env, n, tt, n - 2 AS nu, atan(abs(tt) / sqrt(n - 2)) AS a FROM fx),
tp AS (SELECT v, env, n, tt, 1 - CASE WHEN nu % 2 = 0 THEN sin(a) * list_sum(list_transform(range(0, nu // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - 2 * k * ln(2)) * power(cos(a), 2 * k)))
         ELSE 2 / pi() * (a + sin(a) * coalesce(list_sum(list_transform(range(0, (nu - 1) // 2), lambda k: exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * power(cos(a), 2 * k + 1))), 0)) END AS p FROM th)
"""


@query("fn_tsf", _ENV + _T + "SELECT v AS lead, env, round(tt, 5) + 0.0 AS t, round(p, 8) + 0.0 AS p FROM tp")
def fn_tsf(spark, d):
    e = env_fits(spark, d)
    return e.select("lead", "env", r("t", "t", 5), r(sc.student_p("t", (F.col("n") - 2).cast("double")), "p", 8))


@query("fn_fsf", _ENV + _T + "SELECT v AS lead, env, round(p, 8) + 0.0 AS p FROM tp")
def fn_fsf(spark, d):
    """F upper tail of t^2 equals the two-sided t p."""
    e = env_fits(spark, d)
    return e.select("lead", "env", r(sc.f_upper(F.col("t") * F.col("t"), F.lit(1.0), (F.col("n") - 2).cast("double")), "p", 8))


@query("fn_chibar", "SELECT snp, round(CASE WHEN chi2 <= 0 THEN 1.0 ELSE p / 2 END, 9) + 0.0 AS p1, round(CASE WHEN chi2 <= 0 THEN 1.0 ELSE p / 2 + exp(-chi2 / 2) / 4 END, 9) + 0.0 AS p2 FROM ss")
def fn_chibar(spark, d):
    s = t.sumstats(spark, d, p=False)
    return s.select("snp", r(sc.chibar_p("chi2", F.lit(1)), "p1", 9), r(sc.chibar_p("chi2", F.lit(2)), "p2", 9))


@query("plt_manhattan", """
, c AS (SELECT chrom, min(pos) AS lo, greatest(max(pos) - min(pos), 1) AS span FROM ss GROUP BY chrom),
o AS (SELECT chrom, lo, coalesce(sum(span + greatest(span * 0.01, 1)) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c)
SELECT sub AS subgenome, snp, round(CAST(off + pos - lo AS DOUBLE), 3) AS x, round(-log10(p), 6) + 0.0 AS y, CASE WHEN p <= 0.001 THEN 'genomewide' WHEN p <= 0.05 THEN 'suggestive' ELSE 'none' END AS level FROM ss JOIN o USING (chrom)""")
def plt_manhattan(spark, d):
    s = rk.genome_layout(t.sumstats(spark, d).select("sub", "snp", "chrom", "pos", "p"))
    return s.select(F.col("sub").alias("subgenome"), "snp", r("x", "x", 3), r(sc.neglog10(F.col("p")), "y"),
                    F.when(F.col("p") <= 0.001, "genomewide").when(F.col("p") <= 0.05, "suggestive").otherwise("none").alias("level"))


@query("plt_manhattan_labels", """
, c AS (SELECT sub, chrom, min(pos) AS lo, max(pos) AS hi, greatest(max(pos) - min(pos), 1) AS span FROM ss GROUP BY ALL),
o AS (SELECT *, coalesce(sum(span + greatest(span * 0.01, 1)) OVER (PARTITION BY sub ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c),
wd AS (SELECT sub, 0.02 * (max(off + hi - lo) + 1) AS gap FROM o GROUP BY sub),
b AS (SELECT sub, snp, chrom, pos, p, CAST(off + pos - lo AS DOUBLE) AS x, gap, row_number() OVER (PARTITION BY sub ORDER BY p, chrom, pos, snp) AS rn
  FROM ss JOIN o USING (sub, chrom) JOIN wd USING (sub) WHERE p <= 0.05 QUALIFY rn <= 5),
rec AS (SELECT DISTINCT sub, CAST(0 AS BIGINT) AS rn, CAST([] AS DOUBLE[]) AS kept, false AS shown FROM b UNION ALL
  SELECT b.sub, b.rn, CASE WHEN len(list_filter(rec.kept, lambda k: abs(k - b.x) < b.gap)) = 0 THEN list_append(rec.kept, b.x) ELSE rec.kept END,
    len(list_filter(rec.kept, lambda k: abs(k - b.x) < b.gap)) = 0 FROM rec JOIN b ON b.sub = rec.sub AND b.rn = rec.rn + 1)
SELECT b.sub AS subgenome, b.chrom || ':' || b.pos AS label, round(b.x, 3) AS x, round(-log10(b.p), 6) + 0.0 AS y FROM rec JOIN b USING (sub, rn) WHERE shown""")
def plt_manhattan_labels(spark, d):
    """Labels of the strongest markers of each subgenome's panel, at least 2 % of its width apart."""
    s = rk.panel_labels(t.sumstats(spark, d).select("sub", "snp", "chrom", "pos", "p"), "sub", ["snp"], 5, 0.05)
    return s.select(F.col("sub").alias("subgenome"), F.concat("chrom", F.lit(":"), F.col("pos").cast("string")).alias("label"), r("x", "x", 3), r(sc.neglog10(F.col("p")), "y"))


@query("plt_from_results", """
, o AS (SELECT *, row_number() OVER (PARTITION BY p <= 0.05 ORDER BY sub, chrom, pos, snp) - 1 AS rn FROM ss), n AS (SELECT greatest(1, ceil(count(*) / 100)) AS st FROM ss WHERE p > 0.05)
SELECT snp, sub AS subgenome, chrom, pos, round(p, 6) AS p FROM o CROSS JOIN n WHERE p <= 0.05 OR rn % st = 0""")
def plt_from_results(spark, d):
    """Plot frame of a finished scan: all strong markers, a regular sample of the others (display feature)."""
    from alloscan.plans.locus import plot_points
    s = t.sumstats(spark, d).select(F.col("snp").alias("snp_id"), F.col("sub").alias("subgenome"), "chrom", "pos", "p")
    return plot_points(cut_lineage(s), 100, 0.05).select(F.col("snp_id").alias("snp"), "subgenome", "chrom", "pos", r("p", "p"))


@query("plt_lambda", """
SELECT level, round(median(chi2) / 0.4549364231195724, 6) AS lambda_gc, CASE level WHEN 'all' THEN 0 WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END::BIGINT AS bar_order
FROM (SELECT 'all' AS level, chi2 FROM ss UNION ALL SELECT sub, chi2 FROM ss) GROUP BY level""")
def plt_lambda(spark, d):
    g = sc.genomic_inflation(t.sumstats(spark, d, p=False), ["sub"])
    order = F.when(F.col("level") == "all", 0).when(F.col("level") == "A", 1).when(F.col("level") == "B", 2).otherwise(3)
    return g.select("level", r("lambda_gc", "lambda_gc"), big(order, "bar_order"))


@query("plt_locus", """
, ld AS (SELECT chrom, v AS lead_v, pos AS lead_pos FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY chi2 DESC, v) AS rn FROM ss) WHERE rn = 1),
lr AS (SELECT ss.v, ld.lead_v, max(ss.snp) AS snp, max(ss.pos) AS pos, max(ss.chi2) AS chi2, CASE WHEN ss.v = ld.lead_v THEN 1.0 WHEN count(b.d) < 3 THEN NULL ELSE nullif(power(corr(a.d, b.d), 2), 'NaN'::DOUBLE) END AS r2
  FROM ss JOIN ld ON ld.chrom = ss.chrom AND abs(ss.pos - lead_pos) <= 500000 JOIN g a ON a.v = ss.v LEFT JOIN g b ON b.v = lead_v AND b.s = a.s GROUP BY ss.v, ld.lead_v)
SELECT 'm' || lead_v AS lead_snp, snp, pos, round(chi2, 6) AS chi2, CASE WHEN r2 IS NULL THEN 'NA' WHEN round(r2, 12) <= 0.2 THEN '0.0-0.2' WHEN round(r2, 12) <= 0.4 THEN '0.2-0.4' WHEN round(r2, 12) <= 0.6 THEN '0.4-0.6' WHEN round(r2, 12) <= 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS ld_bin FROM lr""")
def plt_locus(spark, d):
    """Locus frame around each chromosome's lead: markers in the window with LD colour bins."""
    from alloscan.catalog.genotype_queries import lead_targets
    lead, tg = lead_targets(spark, d)
    s = t.sumstats(spark, d, p=False).select("v", "snp", "pos", "chi2")
    ld = gt.ld_to_lead(t.geno(spark, d), lead, tg)
    return s.join(ld, "v").select(F.concat(F.lit("m"), F.col("lead_v").cast("string")).alias("lead_snp"), "snp", "pos", r("chi2", "chi2"), gt.ld_bin(F.col("r2")).alias("ld_bin"))


@query("plt_locus_genes")
def plt_locus_genes(spark, d):
    """Gene track of each lead's window with packed display rows."""
    from alloscan.plans.figures import gene_track
    from alloscan.catalog.genotype_queries import lead_targets
    lead, _ = lead_targets(spark, d)
    g = t.genes(spark, d).select("chrom", F.col("gene_id").alias("gname"), F.col("start").alias("gstart"), F.col("end").alias("gend"))
    return gene_track(lead.select("chrom", F.col("lead_v").alias("locus"), F.col("lead_pos").alias("center")), g, 500_000)


@query("plt_pve")
def plt_pve(spark, d):
    """Variance components in display order: subgenomes, other kernels, residual."""
    from alloscan.catalog.model_queries import k_reml
    c = k_reml(spark, d)
    order = F.when(F.col("component") == "e", 2).when(F.col("component").isin("A", "B", "D"), 0).otherwise(1)
    return c.select("component", "pve", "sigma2", order.alias("bar_order"), "at_boundary", (F.col("pve") >= 0.04).alias("labelled"))


@query("k_local_control")
def k_local_control(spark, d):
    """Interaction re-tested given the strongest burden near the first gene."""
    from alloscan.catalog.model_queries import pair_setup
    from alloscan.functions import mixed_model as mm
    from alloscan.operators import intervals as iv
    from alloscan.operators import pair_scan as ps
    y, x, k, b, pairs = pair_setup(spark, d)
    coord = gt.gene_coordinates(t.markers(spark, d).select("gene", "chrom", "pos"))
    near = iv.points_in_intervals(coord.select(F.col("gene").alias("near"), "chrom", "pos"),
                                  coord.select(F.col("gene").alias("gene_x"), "chrom", F.col("pos").alias("c")), F.col("c") - 1_000_000, F.col("c") + 1_000_000)
    return ps.local_control(pairs, b, near.where("near <> gene_x").select("gene_x", "near"), (mm.whitener(y, x, k)[0], y, None))


@query("top_stable", """
SELECT sub AS subgenome, chrom, pos, snp, row_number() OVER (ORDER BY sub, chrom, pos, v) - 1 AS row_no FROM ss""")
def top_stable(spark, d):
    s = so.row_position(t.sumstats(spark, d, p=False).select("sub", "chrom", "pos", "v", "snp"), ["sub", "chrom", "pos", "v"], "row_no")
    return s.select(F.col("sub").alias("subgenome"), "chrom", "pos", "snp", big("row_no"))
