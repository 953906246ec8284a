"""Queries over relationship matrices and their algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from alloscan.catalog import tables as t
from alloscan.catalog.registry import big, query, r
from alloscan.operators import genotype as gt
from alloscan.operators import relationship as rel


def panel(spark, d):
    """Sample list of a data set (bounded and checked)."""
    return rel.panel_of(t.pheno(spark, d))


def wide(spark, d, geno=None):
    return t.with_map(gt.wide_variants(t.geno(spark, d) if geno is None else geno, panel(spark, d)))


def parts(spark, d, group="sub", maf=0.01, geno=None):
    w = wide(spark, d, geno).withColumn("all", F.lit("all"))
    return rel.gram_parts(w, len(panel(spark, d)), group, maf)


def kernels(spark, d, group="sub", geno=None):
    return rel.grm(parts(spark, d, group, geno=geno))


_G = """
, sl AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM ph),
num AS (SELECT mk.sub, mk.chrom, a.i AS i, b.i AS j, sum(x.z * y.z) AS num FROM zc x JOIN zc y ON x.v = y.v JOIN sl a ON a.s = x.s JOIN sl b ON b.s = y.s
        JOIN mk ON mk.v = x.v WHERE a.i <= b.i AND x.v IN (SELECT v FROM q WHERE maf >= 0.01) GROUP BY ALL),
den AS (SELECT sub, chrom, sum(2 * af * (1 - af)) AS den, count(*) AS n_used FROM q JOIN mk USING (v) WHERE maf >= 0.01 GROUP BY ALL),
kk AS (SELECT sub AS grp, i, j, sum(num) / max(den) AS k FROM num JOIN (SELECT sub, sum(den) AS den FROM den GROUP BY sub) USING (sub) GROUP BY ALL)
"""


@query("agg_grm", _G + "SELECT i, j, round(sum(num) / (SELECT sum(den) FROM den), 6) + 0.0 AS k FROM num GROUP BY i, j")
def agg_grm(spark, d):
    return kernels(spark, d, "all").select(big("i"), big("j"), r("k", "k"))


@query("agg_grm_parts", _G + """
SELECT chrom, round(sum(num) FILTER (i = j), 5) AS trace_num, round(max(den), 6) AS den, max(n_used) AS n_used
FROM num JOIN den USING (sub, chrom) GROUP BY chrom""")
def agg_grm_parts(spark, d):
    p = parts(spark, d, "chrom")
    tr = rel.numerators(p).where("i = j").groupBy("grp").agg(F.sum("num").alias("tr"))
    return rel.part_totals(p).join(tr, "grp").select(F.col("grp").alias("chrom"), r("tr", "trace_num", 5), r("den", "den"), big("n_used"))


@query("agg_grm_loco", _G + """
SELECT a.chrom, a.sub, a.i, a.j, round((tn - a.num) / (td - den.den), 6) + 0.0 AS k
FROM num a JOIN (SELECT sub, i, j, sum(num) AS tn FROM num GROUP BY ALL) b USING (sub, i, j)
JOIN den ON den.chrom = a.chrom JOIN (SELECT sub, sum(den) AS td FROM den GROUP BY sub) c ON c.sub = a.sub""")
def agg_grm_loco(spark, d):
    of = t.markers(spark, d).select(F.col("chrom").alias("grp"), F.col("sub").alias("family")).distinct()
    k = rel.loco(parts(spark, d, "chrom"), of)
    return k.select(F.col("grp").alias("chrom"), F.col("family").alias("sub"), big("i"), big("j"), r("k", "k"))


@query("agg_grm_checksum", _G + """
SELECT CAST(sum(n_used) AS BIGINT) AS n_used_parts, (SELECT count(*) FROM q WHERE maf >= 0.01) AS n_used_global, abs(sum(den) - (SELECT sum(2 * af * (1 - af)) FROM q WHERE maf >= 0.01)) <= 1e-8 * sum(den) AS den_ok FROM den""")
def agg_grm_checksum(spark, d):
    a = rel.part_totals(parts(spark, d, "chrom")).agg(F.sum("n_used").alias("n_used_parts"), F.sum("den").alias("da"))
    b = rel.part_totals(parts(spark, d, "all")).select(F.col("n_used").alias("n_used_global"), F.col("den").alias("db"))
    return a.join(F.broadcast(b)).select(big("n_used_parts"), big("n_used_global"), (F.abs(F.col("da") - F.col("db")) <= 1e-8 * F.col("da")).alias("den_ok"))


@query("agg_kernel_had", _G + "SELECT i, j, round(product(k), 6) + 0.0 AS k FROM kk GROUP BY i, j")
def agg_kernel_had(spark, d):
    return rel.hadamard(kernels(spark, d)).select(big("i"), big("j"), r("k", "k"))


@query("agg_kernel_auto", _G + "SELECT i, j, round(product(k), 6) + 0.0 AS k FROM kk GROUP BY i, j")
def agg_kernel_auto(spark, d):
    """Homolog kernel by the number of subgenomes (three here: the product)."""
    return rel.homolog_kernel(kernels(spark, d), 3).select(big("i"), big("j"), r("k", "k"))


@query("agg_kernel_pair", _G + """
SELECT a.i, a.j, round(avg(a.k * b.k), 6) + 0.0 AS k FROM kk a JOIN kk b ON a.i = b.i AND a.j = b.j AND a.grp < b.grp GROUP BY a.i, a.j""")
def agg_kernel_pair(spark, d):
    return rel.pairwise_mean(kernels(spark, d)).select(big("i"), big("j"), r("k", "k"))


@query("agg_kernel_sum", _G + "SELECT i, j, round(sum(k * CASE grp WHEN 'A' THEN 0.5 WHEN 'B' THEN 0.3 ELSE 1 END), 6) + 0.0 AS k FROM kk GROUP BY i, j")
def agg_kernel_sum(spark, d):
    return rel.weighted_sum(kernels(spark, d), {"A": 0.5, "B": 0.3}).select(big("i"), big("j"), r("k", "k"))


@query("agg_kernel_norm", _G + """
SELECT grp, i, j, round(k * n / tr, 6) + 0.0 AS k_trace, round(k * n / fr, 6) + 0.0 AS k_frobenius FROM kk
JOIN (SELECT grp, sum(k) FILTER (i = j) AS tr, sqrt(sum(k * k * CASE WHEN i = j THEN 1 ELSE 2 END)) AS fr FROM kk GROUP BY grp) USING (grp) CROSS JOIN nn""")
def agg_kernel_norm(spark, d):
    k, n = kernels(spark, d), len(panel(spark, d))
    a = rel.normalize(k, n).withColumnRenamed("k", "a")
    b = rel.normalize(k, n, "frobenius").withColumnRenamed("k", "b")
    return a.join(b, ["grp", "i", "j"]).select("grp", big("i"), big("j"), r("a", "k_trace"), r("b", "k_frobenius"))


@query("agg_kernel_diag", _G + """
SELECT a.grp AS grp_a, b.grp AS grp_b, round(corr(a.k, b.k), 6) + 0.0 AS r FROM kk a JOIN kk b ON a.i = b.i AND a.j = b.j AND a.grp < b.grp WHERE a.i < a.j GROUP BY ALL""")
def agg_kernel_diag(spark, d):
    return rel.kernel_correlation(kernels(spark, d)).select("grp_a", "grp_b", r("r", "r"))


@query("agg_kernel_gram", _G + """
, ka AS (SELECT grp, i, j, k FROM kk UNION ALL SELECT DISTINCT 'I', i, j, 1.0 FROM kk WHERE i = j)
SELECT a.grp AS grp_a, b.grp AS grp_b, round(sum(a.k * b.k * CASE WHEN a.i = a.j THEN 1 ELSE 2 END), 6) + 0.0 AS g
FROM ka a JOIN ka b ON a.i = b.i AND a.j = b.j AND a.grp <= b.grp GROUP BY ALL""")
def agg_kernel_gram(spark, d):
    """Inner products of the subgenome kernels and the identity, as vectors."""
    return rel.kernel_gram(kernels(spark, d)).select("grp_a", "grp_b", r("g", "g"))


@query("agg_kernel_condition")
def agg_kernel_condition(spark, d):
    """Condition number of the kernels and the identity, as vectors, from their Gram matrix."""
    return rel.kernel_condition(kernels(spark, d)).select("n_columns", r("condition", "condition"))


@query("join_panel", """
SELECT s FROM g JOIN mk USING (v) WHERE sub = 'A' INTERSECT SELECT s FROM g JOIN mk USING (v) WHERE sub = 'B'
INTERSECT SELECT s FROM g JOIN mk USING (v) WHERE sub = 'D'""")
def join_panel(spark, d):
    g = t.with_map(t.geno(spark, d)).select("s", "sub")
    return g.groupBy("s").agg(F.count_distinct("sub").alias("k")).where("k = 3").select("s")


@query("join_samples", """
SELECT s, row_number() OVER (ORDER BY s) - 1 AS ord, round(y, 6) AS y FROM ph WHERE y IS NOT NULL AND s IN (SELECT s FROM g)""")
def join_samples(spark, d):
    """Samples typed in every subgenome with a trait value, in panel order."""
    from alloscan.operators import scan_order as so
    ph = t.pheno(spark, d).where(F.col("y").isNotNull() & ~F.isnan("y"))
    keep = ph.join(join_panel(spark, d), "s", "left_semi")
    return so.row_position(keep, ["s"], "ord").select("s", big("ord"), r("y", "y"))


@query("join_align", """
, sl AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS slot FROM ph)
SELECT v, slot, d FROM g JOIN sl USING (s)""")
def join_align(spark, d):
    """Calls on the slots of the analysis panel, from the aligned arrays."""
    w = wide(spark, d).select("v", F.posexplode("dosage").alias("slot", "d"))
    return w.where(F.col("d").isNotNull()).select("v", big("slot"), big("d"))
