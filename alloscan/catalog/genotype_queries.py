"""Queries over genotypes, allele statistics and association scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from alloscan.catalog import tables as t
from alloscan.catalog.registry import big, query, r
from alloscan.functions import stat_columns as sc
from alloscan.operators import genotype as gt
from alloscan.operators import scan_order as so
from alloscan.operators import score_scan as scan
from alloscan.session import cut_lineage


@query("entry_scan", """
SELECT snp, sub AS subgenome, chrom, pos, round(beta, 9) + 0.0 AS beta, round(se, 6) AS se,
       round(chi2, 6) AS chi2, round(p, 6) AS p, n_obs, round(maf, 6) AS maf,
       round(call_rate, 6) AS call_rate FROM ss""")
def entry_scan(spark, d):
    return t.sumstats(spark, d).select(
        "snp", F.col("sub").alias("subgenome"), "chrom", "pos", r("beta", "beta", 9), r("se", "se"),
        r("chi2", "chi2"), r("p", "p"), big("n_obs"), r("maf", "maf"), r("call_rate", "call_rate"))


@query("agg_af", """
SELECT v, n_obs, round(af, 6) AS af, round(maf, 6) AS maf, round(call_rate, 6) AS call_rate,
       round(var, 6) + 0.0 AS var FROM q""")
def agg_af(spark, d):
    return t.stats(spark, d).select("v", big("n_obs"), r("af", "af"), r("maf", "maf"),
                                    r("call_rate", "call_rate"), r("var", "var"))


@query("flt_qc", """
SELECT v, n_obs, round(maf, 6) AS maf FROM q
WHERE n_obs > 0 AND call_rate >= 0.9 AND maf >= 0.25 AND NOT flat""")
def flt_qc(spark, d):
    return gt.qc_filter(t.stats(spark, d), 0.25, 0.9).select("v", big("n_obs"), r("maf", "maf"))


@query("flt_qc_reason", """
SELECT CASE WHEN n_obs = 0 OR flat THEN 'zero_var_or_allmiss' WHEN call_rate < 0.9 THEN 'call_rate'
            WHEN maf < 0.25 THEN 'maf' ELSE 'kept' END AS reason, count(*) AS n
FROM q GROUP BY 1""")
def flt_qc_reason(spark, d):
    return (t.stats(spark, d).withColumn("reason", gt.drop_reason(0.25, 0.9))
            .groupBy("reason").agg(F.count("*").alias("n")))


@query("flt_grm_maf", "SELECT v, round(af, 6) AS p FROM q WHERE maf >= 0.25")
def flt_grm_maf(spark, d):
    return t.stats(spark, d).where(F.col("maf") >= 0.25).select("v", r("af", "p"))


@query("flt_std", """
SELECT s, v, round(z, 6) + 0.0 AS z FROM zs
WHERE v IN (SELECT v FROM q WHERE call_rate >= 0.9 AND maf >= 0.05)""")
def flt_std(spark, d):
    st = t.stats(spark, d).where((F.col("call_rate") >= 0.9) & (F.col("maf") >= 0.05))
    return gt.standardize(t.geno(spark, d), st).select("s", "v", r("z", "z"))


@query("k_scan_null", """
SELECT v, round(beta, 9) + 0.0 AS beta, round(se, 6) AS se, round(chi2, 6) AS chi2 FROM sc""")
def k_scan_null(spark, d):
    return (scan.null_scan(t.geno(spark, d), scan.centered_trait(t.pheno(spark, d)))
            .select("v", r("beta", "beta", 9), r("se", "se"), r("chi2", "chi2")))


@query("agg_lambda", """
SELECT scope, level, count(*) AS n_markers, round(median(chi2) / 0.4549364231195724, 6) AS lambda_gc
FROM (SELECT 'all' AS scope, 'all' AS level, chi2 FROM ss UNION ALL
      SELECT 'sub', sub, chi2 FROM ss UNION ALL SELECT 'chrom', chrom, chi2 FROM ss)
GROUP BY scope, level""")
def agg_lambda(spark, d):
    return (sc.genomic_inflation(t.sumstats(spark, d, p=False), ["sub", "chrom"])
            .select("scope", "level", big("n_markers"), r("lambda_gc", "lambda_gc")))


@query("agg_qc", """
SELECT count(*) AS n_rows, count(*) FILTER (p < 0 OR p > 1) AS n_p_out_of_range,
       count(*) FILTER (chi2 < 0) AS n_chi2_negative, round(min(p), 6) AS p_min,
       round(max(p), 6) AS p_max, round(min(chi2), 6) AS chi2_min, round(max(chi2), 6) AS chi2_max
FROM ss""")
def agg_qc(spark, d):
    s = scan.qc_summary(t.sumstats(spark, d))
    return s.select("n_rows", "n_p_out_of_range", "n_chi2_negative", r("p_min", "p_min"),
                    r("p_max", "p_max"), r("chi2_min", "chi2_min"), r("chi2_max", "chi2_max"))


@query("flt_p", "SELECT snp, chrom, pos, round(p, 6) AS p FROM ss WHERE p < 0.05")
def flt_p(spark, d):
    return (t.sumstats(spark, d).where(F.col("p") < 0.05)
            .select("snp", "chrom", "pos", r("p", "p")))


@query("flt_window", """
SELECT snp, pos, round(chi2, 6) AS chi2 FROM ss
WHERE chrom = '2B' AND sub = 'B' AND pos BETWEEN 1000001 - 500000 AND 1000001 + 500000""")
def flt_window(spark, d):
    s = t.sumstats(spark, d, p=False)
    return (s.where((F.col("chrom") == "2B") & (F.col("sub") == "B")
                    & F.col("pos").between(500001, 1500001))
            .select("snp", "pos", r("chi2", "chi2")))


@query("flt_find", "SELECT snp, chrom, pos, round(chi2, 6) AS chi2 FROM ss WHERE snp = 'm42'")
def flt_find(spark, d):
    s = t.sumstats(spark, d, p=False)
    return (s.where(F.col("snp") == "m42").select("snp", "chrom", "pos", r("chi2", "chi2")).limit(1))


def thin(stats, order, n_bg, max_points, keep_p):
    """Keep strong rows and every stride-th of the others, in table order."""
    strong = F.col("p") <= keep_p
    bg = so.row_position(stats.where(~strong), order, "bg0")
    stride = F.greatest(F.lit(1), F.ceil(n_bg / max_points))
    return stats.where(strong).unionByName(
        bg.where(F.col("bg0") % stride == 0).drop("bg0"))


@query("flt_thin", """
, ok AS (SELECT *, row_number() OVER (PARTITION BY p <= 0.05 ORDER BY chrom, pos, v) - 1 AS rn FROM ss),
n AS (SELECT greatest(1, ceil(count(*) / 60.0)) AS stride FROM ss WHERE p > 0.05)
SELECT snp, round(p, 6) AS p FROM ok CROSS JOIN n WHERE p <= 0.05 OR rn % stride = 0""")
def flt_thin(spark, d):
    s = t.sumstats(spark, d)
    n_bg = s.where(F.col("p") > 0.05).agg(F.count("*")).scalar()
    return thin(s, ["chrom", "pos", "v"], n_bg, 60, 0.05).select("snp", r("p", "p"))


@query("flt_thin_fit", """
, o AS (SELECT *, row_number() OVER (ORDER BY chrom, pos, v) - 1 AS rn,
        greatest(1, floor(count(*) OVER () / 50)) AS stride FROM ss)
SELECT snp, round(p, 6) AS p FROM o WHERE p <= 0.01 OR rn % stride = 0""")
def flt_thin_fit(spark, d):
    s = t.sumstats(spark, d)
    n = s.agg(F.count("*")).scalar()
    pos = so.row_position(s, ["chrom", "pos", "v"])
    return (pos.where((F.col("p") <= 0.01)
                      | (F.col("pos0") % F.greatest(F.lit(1), F.floor(n / 50)) == 0))
            .select("snp", r("p", "p")))


@query("top_hits", """
SELECT snp, chrom, pos, round(chi2, 6) AS chi2, round(p, 6) AS p FROM ss ORDER BY p, snp LIMIT 10""")
def top_hits(spark, d):
    return (t.sumstats(spark, d).orderBy("p", "snp").limit(10)
            .select("snp", "chrom", "pos", r("chi2", "chi2"), r("p", "p")))


@query("agg_burden", """
, sz AS (SELECT gene, count(*) AS n FROM mg GROUP BY gene)
SELECT gene, s, round(sum(z) / max(n), 6) + 0.0 AS burden
FROM zs JOIN mg USING (v) JOIN sz USING (gene) GROUP BY gene, s""")
def agg_burden(spark, d):
    calls = cut_lineage(t.geno(spark, d))
    sg = t.markers(spark, d, calls).select("v", "gene")
    return (gt.gene_burden(calls, t.stats(spark, d, calls), sg)
            .select("gene", "s", r("burden", "burden")))


@query("agg_burden_std", """
, sz AS (SELECT gene, count(*) AS n FROM mg GROUP BY gene),
b AS (SELECT gene, s, sum(z) / max(n) AS x FROM zs JOIN mg USING (v) JOIN sz USING (gene) GROUP BY gene, s),
m AS (SELECT gene, sum(x) / max(nn.n) AS mu, sum(x * x) / max(nn.n) AS m2 FROM b CROSS JOIN nn GROUP BY gene)
SELECT gene, s, CASE WHEN sqrt(greatest(m2 - mu * mu, 0)) <= 1e-12 THEN 0.0
       ELSE round((x - mu) / sqrt(greatest(m2 - mu * mu, 0)), 5) + 0.0 END AS burden_std
FROM b JOIN m USING (gene)""")
def agg_burden_std(spark, d):
    sg = t.markers(spark, d).select("v", "gene")
    b = gt.gene_burden(t.geno(spark, d), t.stats(spark, d), sg)
    return (gt.restandardize(b, t.panel_size(spark, d))
            .select("gene", "s", r("burden_std", "burden_std", 5)))


@query("agg_burden_capped")
def agg_burden_capped(spark, d):
    sg = t.markers(spark, d).select("v", "gene")
    return (gt.gene_burden(t.geno(spark, d), t.stats(spark, d), sg, cap=3)
            .select("gene", "s", r("burden", "burden")))


@query("agg_gene_coord", """
, c AS (SELECT gene, chrom, count(*) AS n FROM mg GROUP BY ALL)
SELECT gene, (SELECT chrom FROM c WHERE c.gene = mg.gene ORDER BY n DESC, chrom LIMIT 1) AS chrom,
       CAST(floor(quantile_cont(pos, 0.5)) AS BIGINT) AS pos FROM mg GROUP BY gene""")
def agg_gene_coord(spark, d):
    return gt.gene_coordinates(t.markers(spark, d).select("gene", "chrom", "pos"))


_NEIGHBOURS = """
, pr AS (SELECT a.v AS va, b.v AS vb FROM mk a JOIN mk b
         ON a.chrom = b.chrom AND b.pos > a.pos AND b.pos - a.pos <= 300000),
fl AS (SELECT s, p.s0 FROM (SELECT 1 AS s0) p CROSS JOIN ph),
fa AS (SELECT q.v, ph.s, coalesce(zc.z, 0) AS z FROM q CROSS JOIN ph LEFT JOIN zc ON zc.v = q.v AND zc.s = ph.s)
"""


def neighbour_pairs(mk, reach):
    """Marker pairs within ``reach`` bp; markers of one position bin meet by equi join."""
    b = F.floor(F.col("pos") / reach)
    left = mk.select(F.col("v").alias("va"), "chrom", F.col("pos").alias("pa"), b.alias("b"))
    right = mk.select(F.col("v").alias("vb"), "chrom", F.col("pos").alias("pb"),
                      F.explode(F.array(b, b - 1)).alias("b"))
    return (left.join(right, ["chrom", "b"])
            .where((F.col("pb") > F.col("pa")) & (F.col("pb") - F.col("pa") <= reach))
            .select("va", "vb"))


@query("fn_ldr2", _NEIGHBOURS + """
SELECT va, vb, CASE WHEN max(qa.flat) OR max(qb.flat) THEN 0.0
       ELSE round(least(1, power(corr(a.z, b.z), 2)), 6) END AS r2
FROM pr JOIN fa a ON a.v = va JOIN fa b ON b.v = vb AND b.s = a.s
JOIN q qa ON qa.v = va JOIN q qb ON qb.v = vb GROUP BY va, vb""")
def fn_ldr2(spark, d):
    pairs = neighbour_pairs(t.markers(spark, d), 300000)
    return gt.ld_pairs(t.geno(spark, d), t.stats(spark, d), pairs).select("va", "vb", r("r2", "r2"))


def lead_targets(spark, d):
    """Every marker within 500 kb of the best marker of its chromosome."""
    s = t.sumstats(spark, d, p=False)
    lead = s.groupBy("chrom").agg(F.max(F.struct("chi2", (-F.col("v")).alias("nv"), "v", "pos")).alias("l"))
    lead = lead.select("chrom", F.col("l.v").alias("lead_v"), F.col("l.pos").alias("lead_pos"))
    tg = (t.markers(spark, d).join(F.broadcast(lead), "chrom")
          .where(F.abs(F.col("pos") - F.col("lead_pos")) <= 500000).select("v", "lead_v"))
    return lead, tg


_LEAD = """
, ld AS (SELECT chrom, v AS lead_v, pos AS lead_pos FROM
         (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY chi2 DESC, v) AS rn FROM ss) WHERE rn = 1),
tg AS (SELECT mk.v, lead_v FROM mk JOIN ld USING (chrom) WHERE abs(pos - lead_pos) <= 500000),
lr AS (SELECT tg.v, tg.lead_v, count(b.d) AS n_shared,
       CASE WHEN tg.v = tg.lead_v THEN 1.0 WHEN count(b.d) < 3 THEN NULL
            ELSE nullif(power(corr(a.d, b.d), 2), 'NaN'::DOUBLE) END AS r2
       FROM tg JOIN g a ON a.v = tg.v LEFT JOIN g b ON b.v = tg.lead_v AND b.s = a.s GROUP BY tg.v, tg.lead_v)
"""


@query("fn_ld_lead", _LEAD + "SELECT v, lead_v, n_shared, round(r2, 6) AS r2 FROM lr")
def fn_ld_lead(spark, d):
    lead, tg = lead_targets(spark, d)
    return (gt.ld_to_lead(t.geno(spark, d), lead, tg)
            .select("v", "lead_v", big("n_shared"), r("r2", "r2")))


@query("fn_ldbin", _LEAD + """
SELECT CASE WHEN r2 IS NULL THEN 'NA' WHEN round(r2, 12) <= 0.2 THEN '0.0-0.2' WHEN round(r2, 12) <= 0.4 THEN '0.2-0.4'
       WHEN round(r2, 12) <= 0.6 THEN '0.4-0.6' WHEN round(r2, 12) <= 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS bin,
       count(*) AS n FROM lr GROUP BY 1""")
def fn_ldbin(spark, d):
    lead, tg = lead_targets(spark, d)
    return (gt.ld_to_lead(t.geno(spark, d), lead, tg).withColumn("bin", gt.ld_bin(F.col("r2")))
            .groupBy("bin").agg(F.count("*").alias("n")))
