"""Queries over ranks, multiplicity, curves, and greedy loci."""

from __future__ import annotations

from pyspark.sql import functions as F

from alloscan.catalog import tables as t
from alloscan.catalog.registry import big, query, r
from alloscan.functions import stat_columns as sc
from alloscan.operators import clumping as cl
from alloscan.operators import intervals as iv
from alloscan.operators import ranking as rk


@query("win_rank_ties", """
, x AS (SELECT snp, v, round(p, 2) AS p FROM ss)
SELECT snp, p, row_number() OVER (ORDER BY p, v) - 1 AS rank0, rank() OVER (ORDER BY p) - 1 AS tie_group FROM x""")
def win_rank_ties(spark, d):
    s = t.sumstats(spark, d).select("snp", "v", F.round("p", 2).alias("p"))
    return rk.rank_with_ties(s, "p", ["v"]).select("snp", "p", big("rank0"), big("tie_group"))


@query("win_decile", """
SELECT v, n_obs, least(9, greatest(0, CAST(floor((rank() OVER (ORDER BY n_obs) + (count(*) OVER (PARTITION BY n_obs) - 1) / 2.0 - 0.5)
       / count(*) OVER () * 10) AS BIGINT))) AS decile FROM q""")
def win_decile(spark, d):
    return rk.decile(t.stats(spark, d).select("v", "n_obs"), "n_obs").select("v", big("n_obs"), big("decile"))


@query("win_rank_int", """
SELECT s, round((rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 - 0.5) / count(*) OVER (), 6) AS u
FROM ph""")
def win_rank_int(spark, d):
    ph = t.pheno(spark, d)
    n = ph.agg(F.count("*")).scalar()
    return rk.average_rank(ph, "y").select("s", r((F.col("rank_avg") - 0.5) / n, "u"))


@query("win_rank_int_normal")
def win_rank_int_normal(spark, d):
    """Inverse-normal transform of the trait at (average rank - 1/2) / n."""
    ph = t.pheno(spark, d)
    n = ph.agg(F.count("*")).scalar()
    u = rk.average_rank(ph, "y").withColumn("u", (F.col("rank_avg") - 0.5) / n)
    return u.select("s", r(sc.normal_quantile(F.col("u")), "y_int"))


_BH = """
, b AS (SELECT snp, p, least(1, min(p * m / rn) OVER (ORDER BY p DESC, rn DESC ROWS UNBOUNDED PRECEDING)) AS q FROM
        (SELECT snp, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, v) AS rn FROM ss))
"""


@query("win_bh", _BH + "SELECT snp, round(p, 6) AS p, round(q, 6) AS q FROM b")
def win_bh(spark, d):
    return rk.bh(t.sumstats(spark, d).select("snp", "p"), "p").select("snp", r("p", "p"), r("q", "q"))


@query("win_bh_thr", _BH + "SELECT round(coalesce(max(p) FILTER (q <= 0.9), 0), 6) AS threshold FROM b")
def win_bh_thr(spark, d):
    q = rk.bh(t.sumstats(spark, d).select("snp", "p"), "p")
    return q.agg(r(F.coalesce(F.max(F.when(F.col("q") <= 0.9, F.col("p"))), F.lit(0.0)), "threshold"))


@query("win_bh_grid", """
, u AS (SELECT 't1' AS trait, snp, p FROM ss UNION ALL SELECT 't2', 'm' || v, p FROM ss2),
b AS (SELECT trait, snp, p, least(1, min(p * m / rn) OVER (ORDER BY p DESC, rn DESC ROWS UNBOUNDED PRECEDING)) AS q FROM
      (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, trait, snp) AS rn FROM u))
SELECT trait, snp, round(p, 6) AS p, round(q, 6) AS q FROM b ORDER BY b.p, trait, snp LIMIT 200""")
def win_bh_grid(spark, d):
    one = t.sumstats(spark, d).select(F.lit("t1").alias("trait"), "snp", "p")
    two = t.sumstats(spark, d, 2).select(F.lit("t2").alias("trait"), "snp", "p")
    q = rk.bh(one.unionByName(two), "p").orderBy("p", "trait", "snp").limit(200)
    return q.select("trait", "snp", r("p", "p"), r("q", "q"))


@query("win_holm", """
SELECT snp, round(max(least(1, (m - rn + 1) * p)) OVER (ORDER BY p, rn ROWS UNBOUNDED PRECEDING), 6) AS p_holm
FROM (SELECT snp, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, v) AS rn FROM ss)""")
def win_holm(spark, d):
    return rk.holm(t.sumstats(spark, d).select("snp", "p"), "p").select("snp", r("p_holm", "p_holm"))


_W = """
, w0 AS (SELECT ss.snp, ss.p, embedding[1] + 0.1 AS w FROM ss LEFT JOIN embeddings e ON e.vec_id = ss.v),
w1 AS (SELECT snp, p, CASE WHEN w > 0 THEN w ELSE 1 END AS w FROM w0),
w2 AS (SELECT snp, p, w / avg(w) OVER () AS w, count(*) OVER () AS gn FROM w1)
"""


def weighted(spark, d):
    e = t.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("v"), (F.col("embedding")[0] + F.lit(0.1).cast("float")).cast("double").alias("w0"))
    s = t.sumstats(spark, d).select("snp", "v", "p").join(e, "v", "left")
    return rk.unit_mean_weights(s, "w0", "w")


@query("join_matched", _W + "SELECT snp, round(w, 5) AS w FROM w2")
def join_matched(spark, d):
    return weighted(spark, d).select("snp", r("w", "w", 5))


@query("win_bonf", _W + """
SELECT snp, round(0.05 / gn, 9) AS alpha_bonf, round(p / w, 4) AS p_weighted, p < 0.05 / gn * w AS sig FROM w2""")
def win_bonf(spark, d):
    b = rk.bonferroni(weighted(spark, d), "p", "w")
    return b.select("snp", r("alpha_bonf", "alpha_bonf", 9), r("p_weighted", "p_weighted", 4), "sig")


@query("win_qq", """
SELECT snp, round(-log10(p), 6) + 0.0 AS observed,
       round(-log10((row_number() OVER (ORDER BY p, v) - 0.5) / count(*) OVER ()), 6) + 0.0 AS expected FROM ss""")
def win_qq(spark, d):
    q = rk.qq_expected(t.sumstats(spark, d).select("snp", "v", "p"), "p", ["v"], 1e-3)
    return q.select("snp", r(sc.neglog10(F.col("p")), "observed"), r("expected", "expected"))


@query("plt_qq", """
, st AS (SELECT *, row_number() OVER (PARTITION BY p <= 0.05 ORDER BY chrom, pos, v) - 1 AS bi FROM ss),
th AS (SELECT * FROM st WHERE p <= 0.05 OR bi % 5 = 0),
o AS (SELECT snp, p, row_number() OVER (ORDER BY p, v) AS i, count(*) OVER () AS m,
      count(*) FILTER (p <= 0.05) OVER () AS tail, (SELECT count(*) FROM ss) AS n FROM th)
SELECT snp, round(-log10((CASE WHEN i <= tail THEN i ELSE tail + (n - tail) * (i - tail - 0.5) / (m - tail) END - 0.5) / n), 6) + 0.0 AS expected
FROM o""")
def plt_qq(spark, d):
    """QQ frame of a thinned scan: complete tail, every fifth other marker."""
    from alloscan.operators import scan_order as so
    s = t.sumstats(spark, d).select("snp", "v", "p", "chrom", "pos")
    bg = so.row_position(s.where(F.col("p") > 0.05), ["chrom", "pos", "v"], "bi")
    thin = s.where(F.col("p") <= 0.05).unionByName(bg.where(F.col("bi") % 5 == 0).drop("bi"))
    n = s.agg(F.count("*")).scalar()
    return rk.qq_expected(thin, "p", ["v"], 0.05, n).select("snp", r("expected", "expected"))


@query("win_qq_band")
def win_qq_band(spark, d):
    """95 % null band of every order statistic: Beta(r, n - r + 1) quantiles."""
    s = t.sumstats(spark, d).select("snp", "v", "p")
    n = s.agg(F.count("*")).scalar()
    q = rk.qq_expected(s, "p", ["v"], 1e-3).withColumn("n", n.cast("double"))
    a, b = F.col("qq_rank"), F.col("n") - F.col("qq_rank") + 1
    return q.select("snp", r(sc.beta_quantile(F.lit(0.025), a, b), "lo"), r(sc.beta_quantile(F.lit(0.975), a, b), "hi"))


@query("win_layout", """
, c AS (SELECT chrom, min(pos) AS lo, greatest(max(pos) - min(pos), 1) AS span FROM ss GROUP BY chrom),
o AS (SELECT chrom, lo, span, coalesce(sum(span + greatest(span * 0.01, 1)) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
      row_number() OVER (ORDER BY chrom) - 1 AS chrom_index FROM c)
SELECT snp, ss.chrom, chrom_index, round(CAST(off + pos - lo AS DOUBLE), 3) AS x, round(CAST(off + span / 2 AS DOUBLE), 3) AS center FROM ss JOIN o USING (chrom)""")
def win_layout(spark, d):
    s = t.sumstats(spark, d, p=False).select("snp", "chrom", "pos")
    return rk.genome_layout(s).select("snp", "chrom", big("chrom_index"), r("x", "x", 3), r("center", "center", 3))


_Z = """
, rz AS (SELECT snp, v, chi2, median(chi2) OVER () AS m FROM ss),
rm AS (SELECT *, median(abs(chi2 - m)) OVER () AS mad FROM rz)
"""


@query("win_robust_z", _Z + "SELECT snp, round((chi2 - m) / (1.4826 * mad), 6) + 0.0 AS z FROM rm")
def win_robust_z(spark, d):
    return rk.robust_z(t.sumstats(spark, d, p=False).select("snp", "chi2"), {"chi2": "z"}).select("snp", r("z", "z"))


@query("win_runs", """
, o AS (SELECT CAST(floor(v / 60) AS BIGINT) AS blk, v, row_number() OVER (ORDER BY floor(v / 60), chrom, v) - 1 AS i, chrom FROM mk),
f AS (SELECT *, CASE WHEN lag(chrom) OVER (ORDER BY i) = chrom THEN 0 ELSE 1 END AS nw FROM o),
rr AS (SELECT *, sum(nw) OVER (ORDER BY i) AS run FROM f)
SELECT CAST(run AS BIGINT) AS run, chrom, min(i) AS start, max(i) + 1 AS "end" FROM rr GROUP BY run, chrom""")
def win_runs(spark, d):
    mk = t.markers(spark, d).select("chrom", "v", F.floor(F.col("v") / 60).alias("blk"))
    return rk.chrom_runs(mk, ["blk", "chrom", "v"]).select(big("run"), "chrom", big("start"), big("end"))


_CURVE = """
, tr AS (SELECT DISTINCT ss.v FROM ss JOIN qt ON qt.chrom = ss.chrom AND ss.pos BETWEEN qpos - 30000 AND qpos + 30000),
lb AS (SELECT p, v IN (SELECT v FROM tr) AS is_true FROM ss),
cv AS (SELECT DISTINCT p, count(*) OVER (ORDER BY p) AS called, count(*) FILTER (is_true) OVER (ORDER BY p) AS hits,
       (SELECT count(*) FROM tr) AS nt FROM lb),
cu AS (SELECT p, called, hits, CAST(hits AS DOUBLE) / nt AS power, CAST(called - hits AS DOUBLE) / called AS fdr FROM cv),
fe AS (SELECT fdr, max(power) AS power FROM cu GROUP BY fdr),
en AS (SELECT fdr, max(power) OVER (ORDER BY fdr) AS e FROM fe)
"""


def truth_curve(spark, d):
    """Curve of calling markers by p, markers within 30 kb of a QTL being true."""
    s = t.sumstats(spark, d).select("v", "chrom", "pos", "p")
    q = t.qtl(spark, d).select("chrom", "qid", "qpos")
    tr = iv.points_in_intervals(s.select("v", "chrom", "pos"), q, F.col("qpos") - 30000,
                                F.col("qpos") + 30000).select("v").distinct()
    lab = s.join(tr.withColumn("is_true", F.lit(True)), "v", "left").withColumn(
        "is_true", F.coalesce("is_true", F.lit(False)))
    return rk.power_curve(lab, "p", "is_true", ["v"])


@query("power_curve", _CURVE + "SELECT round(p, 6) AS p, called, hits, round(power, 6) AS power, round(fdr, 6) AS fdr FROM cu")
def power_curve(spark, d):
    return truth_curve(spark, d).select(r("p", "p"), big("called"), big("hits"), r("power", "power"), r("fdr", "fdr"))


@query("win_envelope", _CURVE + "SELECT round(fdr, 6) AS fdr, round(e, 6) AS envelope FROM en")
def win_envelope(spark, d):
    return rk.power_envelope(truth_curve(spark, d)).select(r("fdr", "fdr"), r("envelope", "envelope"))


@query("fn_pauc", _CURVE + """
, gr AS (SELECT i, i * 0.009 AS x FROM range(0, 101) t(i)),
en0 AS (SELECT fdr, e FROM en UNION ALL SELECT 0.0, 0.0 WHERE NOT EXISTS (SELECT 1 FROM en WHERE fdr = 0)),
gv AS (SELECT i, x, (SELECT max(fdr) FROM en0 WHERE fdr <= x) AS f0, (SELECT min(fdr) FROM en0 WHERE fdr > x) AS f1 FROM gr),
vv AS (SELECT i, CASE WHEN f1 IS NULL OR f0 = x THEN a.e ELSE a.e + (x - f0) * (b.e - a.e) / (f1 - f0) END AS y
       FROM gv JOIN en0 a ON a.fdr = f0 LEFT JOIN en0 b ON b.fdr = f1)
SELECT round(sum(y * CASE WHEN i IN (0, 100) THEN 0.5 ELSE 1 END) * 0.009 / 0.9, 5) AS pauc FROM vv""")
def fn_pauc(spark, d):
    return rk.partial_auc(truth_curve(spark, d), cap=0.9).select(r("pauc", "pauc", 5))


@query("fn_power_fdr", _CURVE + "SELECT round(coalesce(max(power) FILTER (fdr <= 0.95), 0), 6) AS power_at_fdr FROM cu")
def fn_power_fdr(spark, d):
    return rk.power_at_fdr(truth_curve(spark, d), 0.95).select(r("power_at_fdr", "power_at_fdr"))


_REC = """
, h AS (SELECT snp, v, chrom, pos, p, row_number() OVER (ORDER BY p, v) AS i FROM ss WHERE p < {cut}),
"""


@query("top_clump", _REC.format(cut=0.3) + """
rec AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS leads, CAST(NULL AS BIGINT) AS lead
        UNION ALL
        SELECT h.i, CASE WHEN z.f IS NULL THEN list_append(rec.leads, h.i) ELSE rec.leads END, coalesce(z.f, h.i)
        FROM rec JOIN h ON h.i = rec.i + 1,
        LATERAL (SELECT min(l.i) AS f FROM h l WHERE list_contains(rec.leads, l.i) AND l.chrom = h.chrom AND abs(l.pos - h.pos) <= 1000000) z)
SELECT l.chrom, l.snp AS lead_snp, round(l.p, 6) AS lead_p, count(*) AS clump_size, min(h.pos) AS clump_min_pos, max(h.pos) AS clump_max_pos
FROM rec JOIN h ON h.i = rec.i JOIN h l ON l.i = rec.lead GROUP BY ALL""")
def top_clump(spark, d):
    h = t.sumstats(spark, d).where(F.col("p") < 0.3).select("chrom", "pos", "p", F.col("v").alias("id"))
    return cl.clump_table(h, 1_000_000).select(
        "chrom", F.concat(F.lit("m"), F.col("lead_id").cast("string")).alias("lead_snp"), r("lead_p", "lead_p"),
        big("clump_size"), big("clump_min_pos"), big("clump_max_pos"))


@query("top_leads", _REC.format(cut=2) + """
rec AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS leads
        UNION ALL
        SELECT h.i, CASE WHEN (SELECT count(*) FROM h l WHERE list_contains(rec.leads, l.i) AND l.chrom = h.chrom AND abs(l.pos - h.pos) < 1000000) = 0
               THEN list_append(rec.leads, h.i) ELSE rec.leads END
        FROM rec JOIN h ON h.i = rec.i + 1 WHERE len(rec.leads) < 10)
SELECT snp, chrom, pos, round(p, 6) AS p FROM h WHERE list_contains((SELECT leads FROM rec ORDER BY i DESC LIMIT 1), i)""")
def top_leads(spark, d):
    h = t.sumstats(spark, d).select("chrom", "pos", "p", F.col("v").alias("id"))
    return cl.spaced_leads(h, 10, 1_000_000).select(
        F.concat(F.lit("m"), F.col("id").cast("string")).alias("snp"), "chrom", "pos", r("p", "p"))


_COLLAPSE = _REC.format(cut=0.3) + """
rec AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS lab
        UNION ALL
        SELECT h.i, list_append(rec.lab, coalesce((SELECT min(rec.lab[l.i]) FROM h l WHERE l.i < h.i AND l.chrom = h.chrom AND abs(l.pos - h.pos) <= 150000), h.i))
        FROM rec JOIN h ON h.i = rec.i + 1),
lc AS (SELECT h.i, h.snp, h.v, h.p, h.chrom, h.pos, (SELECT lab FROM rec ORDER BY i DESC LIMIT 1)[h.i] AS l FROM h)
"""


def collapsed(spark, d):
    h = t.sumstats(spark, d).where(F.col("p") < 0.3).select(
        F.col("chrom").alias("grp"), "pos", "p", F.col("v").alias("id"))
    return cl.collapse_loci(h, 150_000)


@query("top_collapse", _COLLAPSE + "SELECT lc.snp, f.snp AS locus FROM lc JOIN h f ON f.i = lc.l")
def top_collapse(spark, d):
    return collapsed(spark, d).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("snp"),
                                      F.concat(F.lit("m"), F.col("locus").cast("string")).alias("locus"))


@query("k_eval", _COLLAPSE + """
, tu AS (SELECT DISTINCT ss.v, qid FROM ss JOIN qt ON qt.chrom = ss.chrom AND ss.pos BETWEEN qpos - 150000 AND qpos + 150000),
tg AS (SELECT DISTINCT l, qid FROM lc JOIN tu USING (v)),
fi AS (SELECT qid, min(l) AS l FROM tg GROUP BY qid),
lo AS (SELECT DISTINCT l FROM lc)
SELECT count(*) AS n_loci, count(*) FILTER (l IN (SELECT l FROM fi)) AS n_tp_loci,
       count(*) FILTER (l NOT IN (SELECT l FROM fi)) AS n_fp_loci,
       count(*) FILTER (l NOT IN (SELECT l FROM fi) AND l IN (SELECT l FROM tg)) AS n_duplicate_loci,
       (SELECT count(*) FROM fi) AS n_detected_causal, (SELECT count(DISTINCT qid) FROM tu) AS n_causal,
       round((SELECT count(*) FROM fi) / (SELECT count(DISTINCT qid) FROM tu), 6) AS power,
       round(count(*) FILTER (l NOT IN (SELECT l FROM fi)) / greatest(count(*), 1), 6) AS fdp FROM lo""")
def k_eval(spark, d):
    q = t.qtl(spark, d).select("chrom", "qid", "qpos")
    s = t.sumstats(spark, d, p=False).select("v", "chrom", "pos")
    tu = iv.points_in_intervals(s, q, F.col("qpos") - 150000, F.col("qpos") + 150000)
    tu = tu.select(F.col("v").alias("id"), F.col("qid").alias("causal")).distinct()
    e = cl.claim_loci(collapsed(spark, d), tu)
    return e.select(*[big(c) for c in e.columns[:6]], r("power", "power"), r("fdp", "fdp"))
