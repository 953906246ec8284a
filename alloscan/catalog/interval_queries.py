"""Queries over range, nearest and lookup joins on the genome."""

from __future__ import annotations

from pyspark.sql import functions as F

from alloscan.catalog import tables as t
from alloscan.catalog.registry import big, query, r
from alloscan.operators import genotype as gt
from alloscan.operators import intervals as iv
from alloscan.operators import scan_order as so
from alloscan.session import cut_lineage


def gene_hits(spark, d, flank):
    g = t.genes(spark, d).select("chrom", "gene_id", "start", "end")
    mk = t.markers(spark, d).select("v", "chrom", "pos")
    return iv.points_in_intervals(mk, g, F.col("start") - flank, F.col("end") + flank)


@query("join_snp_gene", """
SELECT gene_id, gen.chrom, st AS start, en AS "end", count(*) AS n_snp
FROM mk JOIN gen ON gen.chrom = mk.chrom AND pos BETWEEN st - 5000 AND en + 5000 GROUP BY ALL""")
def join_snp_gene(spark, d):
    return gene_hits(spark, d, 5000).groupBy("gene_id", "chrom", "start", "end").agg(F.count("*").alias("n_snp"))


@query("join_snp_gene_map", """
SELECT gene_id, v FROM mk JOIN gen ON gen.chrom = mk.chrom AND pos BETWEEN st AND en""")
def join_snp_gene_map(spark, d):
    return gene_hits(spark, d, 0).select("gene_id", "v")


@query("join_snp_gene_total", """
SELECT count(DISTINCT v) AS n_assigned, count(*) AS n_links, count(DISTINCT gene_id) AS n_genes
FROM mk JOIN gen ON gen.chrom = mk.chrom AND pos BETWEEN st - 5000 AND en + 5000""")
def join_snp_gene_total(spark, d):
    return gene_hits(spark, d, 5000).agg(F.count_distinct("v").alias("n_assigned"), F.count("*").alias("n_links"),
                                         F.count_distinct("gene_id").alias("n_genes"))


@query("join_snp_win_full", """
SELECT gene_id, count(v) FILTER (pos BETWEEN st AND en) AS n_body, count(v) AS n_flank,
       count(v) FILTER (pos BETWEEN st AND en) >= 1 AS retained_body, count(v) >= 1 AS retained_flank
FROM gen LEFT JOIN mk ON gen.chrom = mk.chrom AND pos BETWEEN st - 2000 AND en + 2000 GROUP BY gene_id""")
def join_snp_win_full(spark, d, min_snp=1):
    g = t.genes(spark, d)
    n = gene_hits(spark, d, 2000).groupBy("gene_id").agg(
        F.count_if(F.col("pos").between(F.col("start"), F.col("end"))).alias("b"), F.count("*").alias("f"))
    z = F.lit(0)
    return g.join(n, "gene_id", "left").select(
        "gene_id", F.coalesce("b", z).alias("n_body"), F.coalesce("f", z).alias("n_flank"),
        (F.coalesce("b", z) >= min_snp).alias("retained_body"), (F.coalesce("f", z) >= min_snp).alias("retained_flank"))


@query("join_qtl_window", """
, hit AS (SELECT qt.*, snp, pos, chi2 FROM qt LEFT JOIN ss ON ss.chrom = qt.chrom AND pos BETWEEN qpos - win AND qpos + win)
SELECT qtl, chrom, qpos, count(snp) AS n_in_window, count(snp) FILTER (chi2 > 3) AS n_suggestive,
       count(snp) FILTER (chi2 > 5) AS n_strong, arg_max(snp, chi2) AS lead_snp, arg_max(pos, chi2) AS lead_pos,
       round(max(chi2), 6) AS lead_chi2, arg_max(pos, chi2) - qpos AS lead_dist, coalesce(max(chi2), 0) > 5 AS recovered
FROM hit GROUP BY qtl, chrom, qpos""")
def join_qtl_window(spark, d):
    s = t.sumstats(spark, d, p=False).select("snp", "chrom", "pos", "chi2")
    q = iv.window_leads(s, t.qtl(spark, d), ["qtl"], "qpos", "win", ["snp", "pos"],
                        {"n_suggestive": F.col("chi2") > 3, "n_strong": F.col("chi2") > 5})
    return q.select("qtl", "chrom", big("qpos"), big("n_in_window"), big("n_suggestive"), big("n_strong"),
                    "lead_snp", big("lead_pos"), r("lead_chi2", "lead_chi2"),
                    big(F.col("lead_pos") - F.col("qpos"), "lead_dist"),
                    (F.coalesce("lead_chi2", F.lit(0.0)) > 5).alias("recovered"))


_NEAR = """
, nr AS (SELECT v, snp, ss.chrom, pos, chi2, p, qtl, abs(pos - qpos) AS dist FROM
         (SELECT ss.*, qtl, qpos, row_number() OVER (PARTITION BY v ORDER BY abs(pos - qpos), qid) AS rn
          FROM ss LEFT JOIN qt ON qt.chrom = ss.chrom) ss WHERE rn = 1)
"""


def nearest(spark, d, p=False):
    s = t.sumstats(spark, d, p=p)
    q = t.qtl(spark, d).select("chrom", F.col("qpos").alias("rpos"), "qid", "qtl")
    return iv.nearest_point(s, q, "v", "qid", "qtl")


@query("join_nearest_qtl", _NEAR + """
SELECT snp, qtl AS nearest_qtl, dist, coalesce(dist <= 200000, false) AS in_known_window FROM nr""")
def join_nearest_qtl(spark, d):
    return nearest(spark, d).select("snp", F.col("near_name").alias("nearest_qtl"), big("near_dist", "dist"),
                                    F.coalesce(F.col("near_dist") <= 200000, F.lit(False)).alias("in_known_window"))


@query("join_nearest_gene", """
, c AS (SELECT snp, pos, gid, gene_id, st, en, CASE WHEN pos BETWEEN st AND en THEN 0 WHEN en < pos THEN pos - en ELSE st - pos END AS dist,
        CASE WHEN pos BETWEEN st AND en THEN 0 WHEN en < pos THEN 1 ELSE 2 END AS side FROM mk LEFT JOIN gen USING (chrom))
SELECT snp, gene_id AS nearest_gene, dist AS nearest_gene_dist FROM
 (SELECT *, row_number() OVER (PARTITION BY snp ORDER BY dist, side, st, gene_id) AS rn FROM c) WHERE rn = 1""")
def join_nearest_gene(spark, d):
    mk = t.markers(spark, d).select("snp", "chrom", "pos")
    g = t.genes(spark, d).select("chrom", F.col("start").alias("gstart"), F.col("end").alias("gend"),
                                 F.col("gene_id").alias("gname"))
    n = iv.nearest_gene(mk, g, "snp")
    return n.select("snp", "nearest_gene", big("nearest_gene_dist"))


@query("join_marker_first", """
, u AS (SELECT DISTINCT chrom, pos FROM mk),
c AS (SELECT u.chrom, u.pos, gene_id, st, en, row_number() OVER (PARTITION BY u.chrom, u.pos ORDER BY st DESC, gene_id DESC) AS rn
      FROM u JOIN gen ON gen.chrom = u.chrom AND st <= pos)
SELECT chrom, pos, arg_min(gene_id, rn) AS gene FROM c WHERE rn <= 9 AND pos BETWEEN st - 1000 AND en + 1000 GROUP BY chrom, pos""")
def join_marker_first(spark, d):
    mk = t.markers(spark, d).select("chrom", "pos").distinct()
    g = t.genes(spark, d).select("chrom", F.col("start").alias("gstart"), F.col("end").alias("gend"),
                                 F.col("gene_id").alias("gname"))
    return iv.first_gene(mk, g, 1000).select("chrom", "pos", F.col("gname").alias("gene"))


@query("join_emmax", """
SELECT ss.snp, round(ss.p, 6) AS p, round(ss2.chi2, 6) AS chi2_second, round(coalesce(ss2.p, 1), 6) AS p_second,
       ss.p < 0.1 AND coalesce(ss2.p, 1) < 0.1 AS concordant
FROM ss LEFT JOIN ss2 ON ss2.v = ss.v AND ss.maf >= 0.3""")
def join_emmax(spark, d):
    a = t.sumstats(spark, d).select("snp", "v", "p")
    b = t.sumstats(spark, d, 2).where(F.col("maf") >= 0.3).select("v", F.col("chi2").alias("c2"), F.col("p").alias("p2"))
    p2 = F.coalesce("p2", F.lit(1.0))
    return a.join(b, "v", "left").select("snp", r("p", "p"), r("c2", "chi2_second"), r(p2, "p_second"),
                                         ((F.col("p") < 0.1) & (p2 < 0.1)).alias("concordant"))


_RK = """
, rk AS (SELECT *, row_number() OVER (ORDER BY p, v) AS rn FROM ss), an AS (SELECT DISTINCT chrom, qpos FROM qt),
kg AS (SELECT CAST(unnest([10, 50, 100, 500]) AS BIGINT) AS k)
"""


def recall(spark, d, ks=(10, 50, 100, 500), half=100000, trait=1):
    """Anchors hit by the k best markers: the best rank near each anchor decides every k."""
    s = so.row_position(t.sumstats(spark, d, trait).select("v", "chrom", "pos", "p"), ["p", "v"], "r0")
    an = t.qtl(spark, d).select("chrom", "qpos").distinct()
    near = iv.points_in_intervals(s, an, F.col("qpos") - half, F.col("qpos") + half)
    best = near.groupBy("chrom", "qpos").agg((F.min("r0") + 1).alias("best_rank"))
    a = an.join(best, ["chrom", "qpos"], "left")
    return a.agg(F.count("*").alias("n_anchor"), *[F.count_if(F.col("best_rank") <= k).alias(f"h{k}") for k in ks]
                 ).select(F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"h{k}").alias("n_hit"),
                                                       F.col("n_anchor")) for k in ks])).alias("x")).select("x.*")


@query("top_recall", _RK + """
SELECT kg.k, count(*) FILTER (EXISTS (SELECT 1 FROM rk WHERE rk.chrom = an.chrom AND abs(pos - qpos) <= 100000 AND rn <= kg.k)) AS n_hit,
       count(*) AS n_anchor,
       round(count(*) FILTER (EXISTS (SELECT 1 FROM rk WHERE rk.chrom = an.chrom AND abs(pos - qpos) <= 100000 AND rn <= kg.k)) / count(*), 6) AS recall
FROM an CROSS JOIN kg GROUP BY kg.k""")
def top_recall(spark, d):
    return recall(spark, d).select("k", big("n_hit"), big("n_anchor"), r(F.col("n_hit") / F.col("n_anchor"), "recall"))


@query("join_anchor_hit", _RK + """
SELECT chrom, qpos FROM an WHERE EXISTS (SELECT 1 FROM rk WHERE rk.chrom = an.chrom AND abs(pos - qpos) <= 100000 AND rn <= 50)""")
def join_anchor_hit(spark, d):
    top = t.sumstats(spark, d).select("v", "chrom", "pos", "p").orderBy("p", "v").limit(50)
    an = t.qtl(spark, d).select("chrom", "qpos").distinct()
    return iv.points_in_intervals(top, an, F.col("qpos") - 100000, F.col("qpos") + 100000).select("chrom", big("qpos")).distinct()


@query("k_ablation", _RK + """
, rk2 AS (SELECT *, row_number() OVER (ORDER BY ss2.p, v) AS rn2 FROM ss2 JOIN mk USING (v)),
r1 AS (SELECT kg.k, count(*) FILTER (EXISTS (SELECT 1 FROM rk WHERE rk.chrom = an.chrom AND abs(pos - qpos) <= 100000 AND rn <= kg.k)) / count(*) AS a FROM an CROSS JOIN kg GROUP BY kg.k),
r2 AS (SELECT kg.k, count(*) FILTER (EXISTS (SELECT 1 FROM rk2 WHERE rk2.chrom = an.chrom AND abs(pos - qpos) <= 100000 AND rn2 <= kg.k)) / count(*) AS b FROM an CROSS JOIN kg GROUP BY kg.k)
SELECT k, round(a, 6) AS recall_without, round(b, 6) AS recall_with, round(b - a, 6) + 0.0 AS delta FROM r1 JOIN r2 USING (k)""")
def k_ablation(spark, d):
    """Recall of the anchors by two scans of the same markers, and the difference."""
    a = recall(spark, d).select("k", (F.col("n_hit") / F.col("n_anchor")).alias("a"))
    b = recall(spark, d, trait=2).select("k", (F.col("n_hit") / F.col("n_anchor")).alias("b"))
    return a.join(b, "k").select("k", r("a", "recall_without"), r("b", "recall_with"), r(F.col("b") - F.col("a"), "delta"))


@query("join_sentinel", """
, w AS (SELECT qtl, snp, row_number() OVER (PARTITION BY qtl ORDER BY pos, v) - 1 AS i, count(*) OVER (PARTITION BY qtl) AS n
        FROM qt JOIN mk ON mk.chrom = qt.chrom AND pos BETWEEN qpos - 400000 AND qpos + 400000)
SELECT qtl, snp FROM w WHERE i % greatest(1, CAST(floor(n / 3) AS BIGINT)) = 0 AND floor(i / greatest(1, CAST(floor(n / 3) AS BIGINT))) < 3""")
def join_sentinel(spark, d):
    mk = t.markers(spark, d).select("v", "snp", "chrom", "pos")
    q = t.qtl(spark, d).select("chrom", "qtl", "qpos")
    hit = iv.points_in_intervals(mk, q, F.col("qpos") - 400000, F.col("qpos") + 400000)
    return iv.spaced_picks(hit.select("qtl", "snp", "pos", "v"), ["qtl"], ["pos", "v"], 3).select("qtl", "snp")


@query("agg_callable", """
, gs AS (SELECT CAST(floor(gid / 9) AS BIGINT) AS t, chrom, count(v) AS n FROM
         (SELECT gen.gid, gen.chrom, v FROM gen LEFT JOIN mk ON gen.chrom = mk.chrom AND pos BETWEEN st - 50000 AND en + 50000) GROUP BY ALL),
pr AS (SELECT a.t, least(a.n, b.n) AS m FROM gs a JOIN gs b ON a.t = b.t AND left(a.chrom, 1) = left(b.chrom, 1) AND a.chrom < b.chrom)
SELECT CAST(k AS BIGINT) AS min_snp, count(*) FILTER (m >= k) AS g_callable,
  CASE WHEN count(*) FILTER (m >= k) < 70 THEN 'underpowered/null-likely' WHEN count(*) FILTER (m >= k) < 300 THEN 'borderline/risky'
       WHEN count(*) FILTER (m >= k) < 1000 THEN 'discovery-feasible' ELSE 'strong-design' END AS band
FROM pr CROSS JOIN range(1, 6) r(k) GROUP BY k""")
def agg_callable(spark, d):
    """Callable homolog pairs over all subgenome pairs, as a curve over the marker minimum."""
    from alloscan.operators.design import band
    g = t.genes(spark, d)
    n = gene_hits(spark, d, 50000).groupBy("gene_id").agg(F.count("*").alias("n"))
    c = g.join(n, "gene_id", "left").select(
        F.floor(F.col("gid") / 9).alias("t"), F.substring("chrom", 1, 1).alias("base"),
        F.substring("chrom", 2, 1).alias("sub"), F.coalesce("n", F.lit(0)).alias("n"))
    w = c.groupBy("t", "base").agg(*[F.max(F.when(F.col("sub") == s, F.col("n"))).alias(s) for s in "ABD"])
    # least() skips nulls: a group without one copy has no pair with it
    w2 = w.select(*[F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.least(x, y)).alias(x + y)
                    for x, y in (("A", "B"), ("A", "D"), ("B", "D"))])
    m = w2.select(F.explode(F.array("AB", "AD", "BD")).alias("m")).where(F.col("m").isNotNull())
    a = m.agg(*[F.count_if(F.col("m") >= k).alias(f"k{k}") for k in range(1, 6)])
    rows = a.select(F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("min_snp"), F.col(f"k{k}").alias("g_callable"))
                                        for k in range(1, 6)])).alias("x")).select("x.*")
    return rows.withColumn("band", band(F.col("g_callable")))


@query("agg_gene_maxscore", """
, gsc AS (SELECT gen.gid, gene_id, gen.chrom, max(abs(CAST(e.embedding[1] AS DOUBLE))) AS sc FROM gen JOIN mk ON gen.chrom = mk.chrom AND pos BETWEEN st - 20000 AND en + 20000
          JOIN embeddings e ON e.vec_id = mk.v GROUP BY ALL),
grp AS (SELECT CAST(floor(gid / 9) AS BIGINT) AS t, left(chrom, 1) AS base, avg(sc) AS x FROM gsc GROUP BY ALL),
z AS (SELECT t, base, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS z FROM grp)
SELECT t, base, round(exp(0.5 * z) / avg(exp(0.5 * z)) OVER (), 5) AS weight FROM z""")
def agg_gene_maxscore(spark, d):
    """Prior weight per homolog group: mean over copies of the best score near the gene."""
    e = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), F.abs(F.col("embedding")[0].cast("double")).alias("sc"))
    hit = gene_hits(spark, d, 20000).join(e, "v").groupBy("gene_id").agg(F.max("sc").alias("sc"))
    g = t.genes(spark, d).join(hit, "gene_id").groupBy(
        F.floor(F.col("gid") / 9).alias("t"), F.substring("chrom", 1, 1).alias("base")).agg(F.avg("sc").alias("x"))
    m = g.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = (F.col("x") - m.select("m").scalar()) / m.select("s").scalar()
    w = g.withColumn("w", F.exp(0.5 * z))
    return w.select("t", "base", r(F.col("w") / w.agg(F.avg("w")).scalar(), "weight", 5))


@query("k_truth", """
, ca AS (SELECT v AS cv, chrom, pos AS cpos FROM ss WHERE chi2 > 5),
fa AS (SELECT q.v, ph.s, coalesce(zc.z, 0) AS z FROM q CROSS JOIN ph LEFT JOIN zc ON zc.v = q.v AND zc.s = ph.s),
ld AS (SELECT cv, m.v, least(1, power(corr(a.z, b.z), 2)) AS r2 FROM ca JOIN mk m ON m.chrom = ca.chrom AND abs(pos - cpos) <= 600000 AND abs(pos - cpos) > 200000
       JOIN fa a ON a.v = cv JOIN fa b ON b.v = m.v AND b.s = a.s GROUP BY cv, m.v)
SELECT cv AS causal, m.v AS marker FROM ca JOIN mk m ON m.chrom = ca.chrom AND abs(pos - cpos) <= 200000
UNION SELECT cv, v FROM ld WHERE r2 >= 0.2""")
def k_truth(spark, d):
    """Markers tagging each causal marker: near it, or further out in LD with it."""
    calls = cut_lineage(t.geno(spark, d))
    mk = t.markers(spark, d, calls)
    ca = t.sumstats(spark, d, p=False, calls=calls).where(F.col("chi2") > 5).select("chrom", F.col("v").alias("cv"), F.col("pos").alias("cpos"))
    hit = iv.points_in_intervals(mk.select("v", "chrom", "pos"), ca, F.col("cpos") - 600000, F.col("cpos") + 600000)
    far = F.abs(F.col("pos") - F.col("cpos")) > 200000
    r2 = gt.ld_pairs(calls, t.stats(spark, d, calls), hit.where(far).select(F.col("cv").alias("va"), F.col("v").alias("vb")))
    return (hit.where(~far).select(F.col("cv").alias("causal"), F.col("v").alias("marker"))
            .unionByName(r2.where(F.col("r2") >= 0.2).select(F.col("va").alias("causal"), F.col("vb").alias("marker"))).distinct())


@query("fn_novel", _NEAR + """
SELECT nr.snp, round(nr.p, 6) AS p, row_number() OVER (ORDER BY nr.p, v) AS novel_rank FROM nr JOIN ss2 USING (v)
WHERE nr.p < 0.3 AND NOT coalesce(dist <= 50000, false) AND ss2.p < 0.5""")
def fn_novel(spark, d):
    s = nearest(spark, d, p=True).where((F.col("p") < 0.3) & ~F.coalesce(F.col("near_dist") <= 50000, F.lit(False)))
    b = t.sumstats(spark, d, 2).where(F.col("p") < 0.5).select("v")
    out = so.row_position(s.select("snp", "v", "p").join(b, "v"), ["p", "v"], "i")
    return out.select("snp", r("p", "p"), big(F.col("i") + 1, "novel_rank"))


@query("join_universe", "SELECT ss.snp, round(ss.chi2, 6) AS chi2 FROM ss WHERE v IN (SELECT v FROM ss2 WHERE chi2 > 0.1)")
def join_universe(spark, d):
    u = t.sumstats(spark, d, 2, p=False).where(F.col("chi2") > 0.1).select("v")
    return t.sumstats(spark, d, p=False).join(u, "v", "left_semi").select("snp", r("chi2", "chi2"))


@query("join_dosage", """
, ld AS (SELECT sub, v FROM (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY chi2 DESC, v) AS rn FROM ss) WHERE rn = 1)
SELECT s, max(d) FILTER (sub = 'A') AS dose_a, max(d) FILTER (sub = 'B') AS dose_b, max(d) FILTER (sub = 'D') AS dose_d
FROM g JOIN ld USING (v) GROUP BY s HAVING count(DISTINCT sub) = 3""")
def join_dosage(spark, d):
    """Dosages at the lead of every subgenome, for samples called at all of them."""
    s = t.sumstats(spark, d, p=False)
    lead = s.groupBy("sub").agg(F.max_by("v", F.struct("chi2", (-F.col("v")).alias("nv"))).alias("v"))
    j = t.geno(spark, d).join(F.broadcast(lead), "v")
    w = j.groupBy("s").agg(*[F.max(F.when(F.col("sub") == x, F.col("d"))).alias(f"dose_{x.lower()}") for x in "ABD"])
    return w.dropna()
