"""Queries over expression balance, calibration summaries, design and audits.

Expression is the quantity of a gene's parts per sample; a triad is the three copies of one
position on the three subgenomes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from alloscan.catalog import tables as t
from alloscan.catalog.registry import big, query, r
from alloscan.functions import stat_columns as sc
from alloscan.operators import design as ds
from alloscan.operators import expression as ex
from alloscan.operators import ranking as rk
from alloscan.operators import replicates as rp
from alloscan.operators import resampling as rs
from alloscan.operators import scan_order as so
from alloscan.session import cut_lineage

_EX = """
, lx AS (SELECT CAST(floor(l_partkey / 4) AS BIGINT) AS v, l_suppkey % 40 AS s, l_returnflag AS study, l_quantity AS x, l_extendedprice AS pr FROM lineitem),
xs AS (SELECT base, jj, s, study, coalesce(sum(x) FILTER (sub = 'A'), 0) AS a, coalesce(sum(x) FILTER (sub = 'B'), 0) AS b, coalesce(sum(x) FILTER (sub = 'D'), 0) AS d FROM lx JOIN mk USING (v) GROUP BY ALL),
tm AS (SELECT base, jj, sum(a) / 40 AS a, sum(b) / 40 AS b, sum(d) / 40 AS d FROM xs GROUP BY ALL),
fr AS (SELECT base, jj, a, b, d, a / (a + b + d) AS fa, b / (a + b + d) AS fb, d / (a + b + d) AS fd FROM tm WHERE a + b + d > 1e-9),
ide AS (SELECT * FROM (VALUES (0, 'balanced', 1/3, 1/3, 1/3), (1, 'A.dominant', 1, 0, 0), (2, 'B.dominant', 0, 1, 0), (3, 'D.dominant', 0, 0, 1), (4, 'A.suppressed', 0, 0.5, 0.5), (5, 'B.suppressed', 0.5, 0, 0.5), (6, 'D.suppressed', 0.5, 0.5, 0)) q(i, cat, xa, xb, xd)),
ba AS (SELECT base, jj, fa, fb, fd, max(sqrt(power(fa - xa, 2) + power(fb - xb, 2) + power(fd - xd, 2))) FILTER (i = 0) AS dist,
  arg_min(cat, (sqrt(power(fa - xa, 2) + power(fb - xb, 2) + power(fd - xd, 2)), i)) AS category FROM fr CROSS JOIN ide GROUP BY ALL)
"""


def long_expression(spark, d):
    li = t.table(spark, d, "lineitem")
    x = li.select(F.floor(F.col("l_partkey") / 4).alias("v"), (F.col("l_suppkey") % 40).alias("s"), F.col("l_returnflag").alias("study"), F.col("l_quantity").alias("x"))
    x = t.with_map(x)
    return x.groupBy("base", "jj", "s", "study").agg(*[F.sum(F.when(F.col("sub") == c, F.col("x")).otherwise(0.0)).alias(c.lower()) for c in "ABD"])


def triads(spark, d):
    m = long_expression(spark, d).groupBy("base", "jj").agg(*[(F.sum(c) / 40).alias(c) for c in "abd"])
    return ex.triad_balance(m)


@query("agg_triad_balance", _EX + "SELECT base, jj, round(fa, 6) AS fa, round(fb, 6) AS fb, round(fd, 6) AS fd, round(dist, 6) AS dist, category FROM ba")
def agg_triad_balance(spark, d):
    return triads(spark, d).where(F.col("dist").isNotNull()).select("base", "jj", r("fa", "fa"), r("fb", "fb"), r("fd", "fd"), r("dist", "dist"), "category")


@query("agg_pct_weight", _EX + "SELECT base, jj, round(0.5 + (rank() OVER (ORDER BY round(dist, 9)) - 1) / count(*) OVER (), 6) AS weight FROM ba")
def agg_pct_weight(spark, d):
    b = triads(spark, d).where(F.col("dist").isNotNull()).select("base", "jj", F.round("dist", 9).alias("dist"))
    return ex.strict_percentile(b, "dist", "pct").select("base", "jj", r(0.5 + F.col("pct"), "weight"))


@query("agg_upper_tail", _EX + """
SELECT base, jj, round((rank() OVER (ORDER BY round(dist, 9)) - 1) / count(*) OVER (), 6) AS percentile, round((1 + count(*) OVER () - rank() OVER (ORDER BY round(dist, 9)) + 1) / (count(*) OVER () + 1), 6) AS p_upper FROM ba""")
def agg_upper_tail(spark, d):
    b = triads(spark, d).where(F.col("dist").isNotNull()).select("base", "jj", F.round("dist", 9).alias("dist"))
    n = b.agg(F.count("*")).scalar()
    x = rk.average_rank(b, "dist")
    return x.select("base", "jj", r((F.col("rank_min") - 1) / n, "percentile"), r((1 + n - F.col("rank_min") + 1) / (n + 1), "p_upper"))


@query("agg_study_balanced", _EX + """
, st AS (SELECT base, jj, study, count(*) AS n, avg(a) AS a, avg(b) AS b, avg(d) AS d FROM xs WHERE a + b + d >= 20 GROUP BY ALL HAVING count(*) >= 5)
SELECT base, jj, count(*) AS n_studies, round(avg(a), 6) AS a, round(avg(b), 6) AS b, round(avg(d), 6) AS d FROM st GROUP BY ALL""")
def agg_study_balanced(spark, d):
    e = ex.study_balanced(long_expression(spark, d), ["base", "jj"], ["a", "b", "d"], 20.0, 5)
    return e.select("base", "jj", big("n_studies"), r("a", "a"), r("b", "b"), r("d", "d"))


@query("agg_share_bias", _EX + """
SELECT base, jj, round(fa, 6) AS share_a, round(fb, 6) AS share_b, round(fd, 6) AS share_d, round(greatest(abs(fa - 1/3), abs(fb - 1/3), abs(fd - 1/3)), 6) AS max_dev,
 CASE WHEN greatest(abs(fa - 1/3), abs(fb - 1/3), abs(fd - 1/3)) > 0.03 THEN 'biased' ELSE 'fair' END AS verdict FROM fr WHERE a + b + d >= 1""")
def agg_share_bias(spark, d):
    b = ex.copy_bias(triads(spark, d).select("base", "jj", "a", "b", "d"), ["a", "b", "d"], 1 / 3, 0.03)
    return b.select("base", "jj", r("share_a", "share_a"), r("share_b", "share_b"), r("share_d", "share_d"), r("max_dev", "max_dev"), "verdict")


_POP = _EX + """
, xg AS (SELECT base * 1000000 + jj AS u, s, sum(a) AS a, sum(b) AS b, sum(d) AS d FROM xs GROUP BY ALL),
bs AS (SELECT base * 1000000 + jj AS u, count(*) FILTER (sub = 'A') / count(*) AS ba, count(*) FILTER (sub = 'B') / count(*) AS bb, count(*) FILTER (sub = 'D') / count(*) AS bd FROM mk GROUP BY ALL),
dv AS (SELECT xg.u, a / (a + b + d) - ba AS a, b / (a + b + d) - bb AS b, d / (a + b + d) - bd AS d FROM xg JOIN bs USING (u) WHERE a + b + d >= 1),
ms AS (SELECT u, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(d) AS md, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(d) AS sd FROM dv GROUP BY u HAVING count(*) >= 8),
dm AS (SELECT *, CASE WHEN round(abs(ma), 12) >= round(abs(mb), 12) AND round(abs(ma), 12) >= round(abs(md), 12) THEN 'a' WHEN round(abs(mb), 12) >= round(abs(md), 12) THEN 'b' ELSE 'd' END AS c FROM ms),
dd AS (SELECT u, n, c, CASE c WHEN 'a' THEN ma WHEN 'b' THEN mb ELSE md END AS m, CASE c WHEN 'a' THEN sa WHEN 'b' THEN sb ELSE sd END AS s FROM dm)
"""


def population(spark, d):
    x = long_expression(spark, d).withColumn("u", F.col("base") * 1000000 + F.col("jj"))
    g = x.groupBy("u", "s").agg(*[F.sum(c).alias(c) for c in "abd"])
    m = t.markers(spark, d).groupBy((F.col("base") * 1000000 + F.col("jj")).alias("u")).agg(
        *[(F.count_if(F.col("sub") == c) / F.count("*")).alias(f"base_{c.lower()}") for c in "ABD"])
    return ex.population_bias(g, m, "u", ["a", "b", "d"], 1.0, 8)


@query("agg_pop_heb", _POP + """
SELECT dd.u, max(dd.n) AS n, max(c) AS dominant, round(max(m), 6) + 0.0 AS mean_dev, round(abs(max(m)), 6) AS effect, round(max(dd.s), 6) AS sd,
  round(count(*) FILTER (sign(CASE c WHEN 'a' THEN dv.a WHEN 'b' THEN dv.b ELSE dv.d END) = sign(m)) / max(dd.n), 6) AS sign_consistency FROM dd JOIN dv USING (u) GROUP BY dd.u""")
def agg_pop_heb(spark, d):
    p = population(spark, d)
    return p.select("u", big("n"), "dominant", r("mean_dev", "mean_dev"), r("effect", "effect"), r("sd", "sd"), r("sign_consistency", "sign_consistency"))


@query("agg_pop_heb_class")
def agg_pop_heb_class(spark, d):
    return ex.classify_bias(population(spark, d)).select("u", "n", "dominant", r("p_t", "p_t", 9), r("q_dom", "q_dom"), "class")


TOP_SHARE = 0.05


def enrichment_input(spark, d):
    """Triads in strata of marker-count decile x 10 + length decile; the top by scan evidence."""
    b = triads(spark, d).where(F.col("dist").isNotNull()).select("base", "jj", F.round("dist", 9).alias("dist"), "total")
    b = ex.strict_percentile(b, "dist", "pct")
    m = t.markers(spark, d).groupBy("base", "jj").agg(F.count("*").alias("n_snp"), (F.max("pos") - F.min("pos")).alias("len"))
    x = b.join(m, ["base", "jj"])
    x = rk.decile(x, "n_snp", "ds").drop("n_tie", "rank_min", "rank_max", "rank_avg")
    x = rk.decile(x, "len", "dl").drop("n_tie", "rank_min", "rank_max", "rank_avg")
    best = t.with_map(t.sumstats(spark, d, p=False).select("v", "chi2")).groupBy("base", "jj").agg(F.max("chi2").alias("best"))
    x = x.join(best, ["base", "jj"], "left")
    x = x.withColumn("best", F.coalesce("best", F.lit(0.0)))
    x = so.row_position(x.withColumn("_least", -F.col("best")), ["_least", "base", "jj"], "_place")
    n = x.agg(F.count("*")).scalar()
    return x.select((F.col("base") * 1000000 + F.col("jj")).alias("id"), (F.col("ds") * 10 + F.col("dl")).alias("stratum"), "pct",
                    (F.col("_place") < F.ceil(TOP_SHARE * n)).alias("top"), "total", F.col("n_snp").cast("double").alias("n_snp"))


@query("k_enrich")
def k_enrich(spark, d):
    return ex.stratum_enrichment(cut_lineage(enrichment_input(spark, d)))


MISSING_BELOW = 1.0


def matched_input(spark, d):
    """Triads with the five covariates of a match: expression level, its variation, share of low samples, length and markers."""
    e = long_expression(spark, d).select("base", "jj", (F.col("a") + F.col("b") + F.col("d")).alias("x"))
    e = e.groupBy("base", "jj").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.avg((F.col("x") < MISSING_BELOW).cast("double")).alias("missing"))
    e = e.select((F.col("base") * 1000000 + F.col("jj")).alias("id"), F.log1p("mean").alias("level"),
                 F.when(F.col("mean") > 1e-9, F.col("sd") / F.col("mean")).otherwise(0.0).alias("variation"), "missing")
    m = t.markers(spark, d).groupBy("base", "jj").agg((F.max("pos") - F.min("pos")).cast("double").alias("length"))
    m = m.select((F.col("base") * 1000000 + F.col("jj")).alias("id"), "length")
    return enrichment_input(spark, d).select("id", "pct", "top", "n_snp").join(e, "id").join(m, "id")


@query("k_matched_controls")
def k_matched_controls(spark, d):
    """Background of every top triad: triads of its stratum, or all, within a caliper of it in each of five covariates."""
    return ex.caliper_controls(cut_lineage(matched_input(spark, d)), {"level": 10, "missing": 5, "n_snp": 5, "variation": 0, "length": 0}, "top", 0.5, 50)


@query("k_matched_null")
def k_matched_null(spark, d):
    x = cut_lineage(enrichment_input(spark, d).withColumn("lm", F.log1p("total")))
    return ex.matched_controls(x.select("id", "pct", "top", "lm", "n_snp"), {"lm": 10, "n_snp": 5}, "top", 0.5, 50)


@query("agg_tpm_mean", """
SELECT 'g' || c_custkey AS gene, round(coalesce(avg(nullif(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END, 0)), 0), 6) AS tpm FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def agg_tpm_mean(spark, d):
    """Mean over samples of non-empty text cells; genes without any are 0."""
    c = t.table(spark, d, "customer").select("c_custkey")
    o = t.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_totalprice").cast("string")).alias("cell"))
    v = F.nullif("cell", F.lit("")).try_cast("double")
    g = o.groupBy("c_custkey").agg(F.avg(v).alias("m"))
    return c.join(g, "c_custkey", "left").select(F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("gene"), r(F.coalesce("m", F.lit(0.0)), "tpm"))


_EV = """
, ev AS (SELECT event_id, event_type, user_id, value, CAST(CAST(round(value * 100) AS BIGINT) % 101 AS DOUBLE) / 101 AS p1, CAST(CAST(round(value * 100) AS BIGINT) % 37 AS DOUBLE) / 37 AS p2 FROM events)
"""


def replicate_table(spark, d):
    c = F.round(F.col("value") * 100).cast("bigint")
    return t.table(spark, d, "events").select("event_id", "event_type", "user_id", "value", ((c % 101) / 101).alias("p1"), ((c % 37) / 37).alias("p2"))


@query("agg_type1", _EV + """
, lg AS (SELECT 'first' AS method, p1 AS p FROM ev UNION ALL SELECT 'second', p2 FROM ev),
a AS (SELECT CAST(unnest([0.1, 0.05, 0.01]) AS DOUBLE) AS alpha),
c AS (SELECT method, alpha, count(*) AS n, count(*) FILTER (p <= alpha) AS k FROM lg CROSS JOIN a GROUP BY ALL),
w AS (SELECT *, CAST(k AS DOUBLE) / n AS rate, 1.959963984540054 AS z FROM c),
i AS (SELECT *, (rate + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(rate * (1 - rate) / n + z * z / (4.0 * n * n)) / (1 + z * z / n) AS lo, (rate + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(rate * (1 - rate) / n + z * z / (4.0 * n * n)) / (1 + z * z / n) AS hi FROM w)
SELECT method, alpha, n AS n_used, k AS n_reject, round(rate, 6) AS type1_rate, round(greatest(lo, 0), 6) AS ci_lo, round(least(hi, 1), 6) AS ci_hi,
  CASE WHEN lo > alpha THEN 'anti-conservative' WHEN hi < alpha THEN 'conservative' ELSE 'calibrated' END AS verdict FROM i""")
def agg_type1(spark, d):
    x = rp.type1_table(replicate_table(spark, d), {"p1": "first", "p2": "second"}, (0.1, 0.05, 0.01))
    return x.select("method", "alpha", big("n_used"), big("n_reject"), r("type1_rate", "type1_rate"), r("ci_lo", "ci_lo"), r("ci_hi", "ci_hi"), "verdict")


@query("fn_wilson", _EV + """
, c AS (SELECT event_type, count(*) AS n, count(*) FILTER (p1 <= 0.2) AS k, 1.959963984540054 AS z FROM ev GROUP BY 1), w AS (SELECT *, CAST(k AS DOUBLE) / n AS rate FROM c)
SELECT event_type, round(greatest(0, (rate + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(rate * (1 - rate) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 6) AS ci_lo, round(least(1, (rate + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(rate * (1 - rate) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 6) AS ci_hi FROM w""")
def fn_wilson(spark, d):
    g = replicate_table(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("p1") <= 0.2).alias("k"))
    lo, hi = sc.wilson(F.col("k"), F.col("n"))
    return g.select("event_type", r(lo, "ci_lo"), r(hi, "ci_hi"))


@query("agg_calib_q", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS q95, round(quantile_cont(value, 0.99), 6) AS q99 FROM events GROUP BY 1")
def agg_calib_q(spark, d):
    e = t.table(spark, d, "events").select("event_type", "value")
    a = sc.grouped_quantile(e, ["event_type"], "value", 0.95).select("event_type", F.col("q").alias("a"))
    b = sc.grouped_quantile(e, ["event_type"], "value", 0.99).select("event_type", F.col("q").alias("b"))
    return a.join(b, "event_type").select("event_type", r("a", "q95"), r("b", "q99"))


@query("agg_calib_tail")
def agg_calib_tail(spark, d):
    """Empirical tail quantiles beside those of the boundary mixture."""
    e = t.table(spark, d, "events").select("event_type", "value")
    out = None
    for q, x in rp.chibar_quantiles(1):
        g = sc.grouped_quantile(e, ["event_type"], "value", q).select("event_type", F.lit(q).alias("prob"), F.col("q").alias("empirical"), F.lit(x).alias("reference"))
        out = g if out is None else out.unionByName(g)
    return out.withColumn("ratio", F.col("empirical") / F.col("reference"))


@query("agg_med_iqr", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY 1")
def agg_med_iqr(spark, d):
    e = t.table(spark, d, "events").select("event_type", "value")
    out = None
    for name, q in (("median", 0.5), ("q25", 0.25), ("q75", 0.75)):
        g = sc.grouped_quantile(e, ["event_type"], "value", q).withColumn(name, F.round("q", 6))
        g = g.select("event_type", "n", name) if out is None else g.select("event_type", name)
        out = g if out is None else out.join(g, "event_type")
    return out.select("event_type", big("n"), "median", "q25", "q75")


@query("agg_perm_emp", _EV + """
, ob AS (SELECT event_type, round(avg(value), 3) AS obs FROM ev GROUP BY 1)
SELECT event_type, obs, round((1 + count(*) FILTER (value <= obs)) / (count(*) + 1), 6) AS p_lower, round((1 + count(*) FILTER (value >= obs)) / (count(*) + 1), 6) AS p_upper FROM ev JOIN ob USING (event_type) GROUP BY event_type, obs""")
def agg_perm_emp(spark, d):
    e = t.table(spark, d, "events").select("event_type", "value")
    ob = e.groupBy("event_type").agg(F.round(F.avg("value"), 3).alias("obs"))
    j = e.join(F.broadcast(ob), "event_type")
    return j.groupBy("event_type", "obs").agg(r((1 + F.count_if(F.col("value") <= F.col("obs"))) / (F.count("*") + 1), "p_lower"),
                                              r((1 + F.count_if(F.col("value") >= F.col("obs"))) / (F.count("*") + 1), "p_upper"))


@query("agg_curve", _EV + """
SELECT user_id % 3 AS arm, event_type AS method, CAST(floor(value / 10) AS BIGINT) AS threshold, count(*) AS n, round(avg(p1), 6) AS mean_power, round(avg(p2) FILTER (p2 > 0.1), 6) AS mean_fdr FROM ev GROUP BY ALL""")
def agg_curve(spark, d):
    e = replicate_table(spark, d).withColumn("p2", F.when(F.col("p2") > 0.1, F.col("p2")))
    return e.groupBy((F.col("user_id") % 3).alias("arm"), F.col("event_type").alias("method"), F.floor(F.col("value") / 10).alias("threshold")).agg(
        F.count("*").alias("n"), r(F.avg("p1"), "mean_power"), r(F.avg("p2"), "mean_fdr"))


@query("agg_tier_pivot", _EV + """
SELECT user_id, round(avg(p1) FILTER (event_type = 'click'), 6) AS click, round(avg(p1) FILTER (event_type = 'view'), 6) AS view, round(avg(p1) FILTER (event_type = 'error'), 6) AS error,
  round(avg(p1) FILTER (event_type = 'purchase'), 6) AS purchase, round(avg(p1) FILTER (event_type = 'signup'), 6) AS signup,
  round(round(avg(p1) FILTER (event_type = 'view'), 6) - round(avg(p1) FILTER (event_type = 'click'), 6), 6) + 0.0 AS delta_view FROM ev GROUP BY user_id""")
def agg_tier_pivot(spark, d):
    p = replicate_table(spark, d).groupBy("user_id").pivot("event_type", ["click", "view", "error", "purchase", "signup"]).agg(F.round(F.avg("p1"), 6))
    return p.select("user_id", "click", "view", "error", "purchase", "signup", r(F.col("view") - F.col("click"), "delta_view"))


def signed_rank_z(g):
    """Normal score of a signed-rank sum: ``n, w, tie`` in. The cube of n leaves a bigint from 1.7 million differences on."""
    n = F.col("n").cast("double")
    return g.withColumn("z", (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48))


@query("k_paired_tests")
def k_paired_tests(spark, d):
    """Paired differences of two methods per arm: signed-rank sum and normal p from tie-aware ranks."""
    e = replicate_table(spark, d).select((F.col("user_id") % 3).alias("arm"), "event_id", F.round(F.col("p1") - F.col("p2"), 9).alias("diff"))
    e = e.where(F.col("diff") != 0).withColumn("ad", F.abs("diff"))
    c = e.groupBy("arm", "ad").agg(F.count("*").alias("k"), F.count_if(F.col("diff") > 0).alias("pos"))
    s = so.ordered_scan(c, ["arm", "ad"], {"upto": ("sum", "k")})
    first = s.groupBy("arm").agg(F.min(F.col("upto") - F.col("k")).alias("f"), F.sum("k").alias("n"))
    j = s.join(F.broadcast(first), "arm").withColumn("rank", F.col("upto") - F.col("f") - (F.col("k") - 1) / 2)
    g = j.groupBy("arm").agg(F.sum(F.col("rank") * F.col("pos")).alias("w"), F.first("n").alias("n"), F.sum(F.pow("k", F.lit(3)) - F.col("k")).alias("tie"))
    return signed_rank_z(g).select("arm", "n", "w", r("z", "z"), r(F.when(F.col("z") > 0, sc.chi2_sf1(F.col("z") * F.col("z")) / 2).otherwise(
        1 - sc.chi2_sf1(F.col("z") * F.col("z")) / 2), "p_greater", 9))


@query("k_paired_bootstrap")
def k_paired_bootstrap(spark, d):
    """Per arm: mean difference of two methods in power and in run time, with bootstrap interval and p."""
    e = replicate_table(spark, d).withColumn("c", F.round(F.col("value") * 100).cast("bigint"))
    x = e.select((F.col("user_id") % 3).alias("arm"), F.explode(F.create_map(
        F.lit("power"), F.round(F.col("p1") - F.col("p2"), 9), F.lit("runtime"), ((F.col("c") % 53) - (F.col("c") % 47)).cast("double"))).alias("metric", "diff"))
    return rs.paired_bootstrap(x, ["arm", "metric"], "diff", 2000).select("arm", "metric", big("n"), *[r(c, c) for c in ("delta", "lo", "hi", "p")])


@query("top_enrich", """
, o AS (SELECT s, row_number() OVER (ORDER BY y DESC, s) AS ro FROM ph), p AS (SELECT s, row_number() OVER (ORDER BY y DESC, s) AS rp FROM ph2),
k AS (SELECT greatest(1, CAST(round_even(0.1125 * count(*), 0) AS BIGINT)) AS k FROM ph)
SELECT max(k) AS k, count(*) FILTER (ro <= k AND rp <= k) AS overlap, round(count(*) FILTER (ro <= k AND rp <= k) / max(k) / 0.1125, 6) AS enrichment FROM o JOIN p USING (s) CROSS JOIN k""")
def top_enrich(spark, d):
    a = so.row_position(t.pheno(spark, d).withColumn("ny", -F.col("y")), ["ny", "s"], "ro")
    b = so.row_position(t.pheno2(spark, d).withColumn("ny", -F.col("y")), ["ny", "s"], "rp").select("s", "rp")
    k = t.pheno(spark, d).agg(F.greatest(F.lit(1), F.bround(0.1125 * F.count("*"), 0).cast("bigint"))).scalar()
    j = a.join(b, "s").agg(F.count_if((F.col("ro") < k) & (F.col("rp") < k)).alias("overlap"), F.first(k).alias("k"))
    return j.select(big("k"), big("overlap"), r(F.col("overlap") / F.col("k") / 0.1125, "enrichment"))


_DEPTH = """
, dep AS (SELECT p_partkey, count(l_orderkey) AS depth FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1),
md AS (SELECT 'marginal' AS mode, 4 AS k, 0.85 AS m UNION ALL SELECT 'interaction', 8, 0.55),
rt AS (SELECT p_partkey, depth, mode, greatest(0, 1 - exp(-depth * m) * list_sum(list_transform(range(0, k), lambda i: power(depth * m, i) / factorial(CAST(i AS INT))))) AS f FROM dep CROSS JOIN md),
cv AS (SELECT * FROM (VALUES (0.0, 0.0, 0.494, 0.0316), (0.494, 0.0316, 0.989, 0.1070), (0.989, 0.1070, 2.472, 0.3254), (2.472, 0.3254, 4.944, 0.5257), (4.944, 0.5257, 9.889, 0.6616), (9.889, 0.6616, 24.722, 0.7794), (24.722, 0.7794, 49.445, 0.8885)) c(x0, y0, x1, y1))
"""


def depth_rows(spark, d):
    """Read depth of a site = its line count; one row per part and test mode."""
    li = t.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return t.table(spark, d, "part").select("p_partkey").join(li, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("depth"))


@query("fn_poissf", _DEPTH + "SELECT p_partkey, mode, round(f, 6) + 0.0 AS retention FROM rt")
def fn_poissf(spark, d):
    x = depth_rows(spark, d)
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), ds.retention(F.col("depth").cast("double"), m).alias("f")) for m in ds.MODES])).alias("c")
    return x.select("p_partkey", cells).select("p_partkey", "c.mode", r("c.f", "retention"))


@query("fn_interp", _DEPTH + """
SELECT p_partkey, round(CASE WHEN depth >= 49.445 THEN 0.8885 ELSE (SELECT y0 + (depth - x0) * (y1 - y0) / (x1 - x0) FROM cv WHERE depth >= x0 AND depth < x1) END, 6) + 0.0 AS p_callable FROM dep""")
def fn_interp(spark, d):
    return depth_rows(spark, d).select("p_partkey", r(sc.interpolate(F.col("depth").cast("double"), ds.DENSITY, ds.CALLABLE), "p_callable"))


@query("k_design", _DEPTH + """
, bl AS (SELECT mode, depth, max(f) AS f FROM rt GROUP BY ALL), le AS (SELECT *, f * 40 AS lam FROM bl),
pe AS (SELECT mode, depth, f, (SELECT y0 + (lam - x0) * (y1 - y0) / (x1 - x0) FROM cv WHERE lam >= x0 AND lam < x1) AS pg, (SELECT y0 + (40.0 - x0) * (y1 - y0) / (x1 - x0) FROM cv WHERE 40.0 >= x0 AND 40.0 < x1) AS pf FROM le),
gp AS (SELECT mode, depth, f, 1200 * least(1, power(pg / pf, 2)) AS g FROM pe)
SELECT mode, depth, round(f, 6) + 0.0 AS retention, round(g, 4) + 0.0 AS g_pred, CASE WHEN g < 70 THEN 'underpowered/null-likely' WHEN g < 300 THEN 'borderline/risky' WHEN g < 1000 THEN 'discovery-feasible' ELSE 'strong-design' END AS band FROM gp""")
def k_design(spark, d):
    """Predicted callable pairs at every observed depth, per test mode."""
    x = depth_rows(spark, d).select("depth").distinct()
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), ds.retention(F.col("depth").cast("double"), m).alias("f")) for m in ds.MODES])).alias("c")
    y = x.select("depth", cells).select("c.mode", "depth", "c.f")
    g = ds.predicted_pairs(F.col("f"), F.lit(1200.0), F.lit(40.0))
    return y.withColumn("g", g).select("mode", "depth", r("f", "retention"), r("g", "g_pred", 4), ds.band(F.col("g")).alias("band"))


@query("fn_band", _DEPTH + """
SELECT CASE WHEN depth * 20 < 70 THEN 'underpowered/null-likely' WHEN depth * 20 < 300 THEN 'borderline/risky' WHEN depth * 20 < 1000 THEN 'discovery-feasible' ELSE 'strong-design' END AS band, count(*) AS n FROM dep GROUP BY 1""")
def fn_band(spark, d):
    return depth_rows(spark, d).groupBy(ds.band(F.col("depth") * 20).alias("band")).agg(F.count("*").alias("n"))


@query("k_design_inverse", _DEPTH + """
, bl AS (SELECT mode, depth, max(f) AS f FROM rt GROUP BY ALL), le AS (SELECT *, f * 40 AS lam FROM bl),
pe AS (SELECT mode, depth, (SELECT y0 + (lam - x0) * (y1 - y0) / (x1 - x0) FROM cv WHERE lam >= x0 AND lam < x1) AS pg, (SELECT y0 + (40.0 - x0) * (y1 - y0) / (x1 - x0) FROM cv WHERE 40.0 >= x0 AND 40.0 < x1) AS pf FROM le),
gp AS (SELECT mode, depth, 1200 * least(1, power(pg / pf, 2)) AS g FROM pe)
SELECT mode, min(depth) FILTER (g >= 300) AS depth_feasible, min(depth) FILTER (g >= 1000) AS depth_strong FROM gp GROUP BY mode""")
def k_design_inverse(spark, d):
    """Smallest observed depth reaching each band; null when none does."""
    x = depth_rows(spark, d).select("depth").distinct()
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), ds.retention(F.col("depth").cast("double"), m).alias("f")) for m in ds.MODES])).alias("c")
    y = x.select("depth", cells).select("c.mode", "depth", ds.predicted_pairs(F.col("c.f"), F.lit(1200.0), F.lit(40.0)).alias("g"))
    return y.groupBy("mode").agg(F.min(F.when(F.col("g") >= 300, F.col("depth"))).alias("depth_feasible"), F.min(F.when(F.col("g") >= 1000, F.col("depth"))).alias("depth_strong"))


DENSITY_RATES, DENSITY_DRAWS = (0.1, 0.25, 0.5, 1.0), 200


@query("k_density")
def k_density(spark, d):
    """Callable pairs after thinning at several rates: markers one by one, or genes as a whole, with the curve's held-out error."""
    m = t.markers(spark, d).groupBy("base", "jj", "sub").agg(F.count("*").alias("n"))
    return ds.thinned_curve(m, ["base", "jj"], "sub", ["A", "B", "D"], DENSITY_RATES, DENSITY_DRAWS)


@query("fn_mde")
def fn_mde(spark, d):
    """Smallest detectable variance share per trait panel at 80 % power over its pair tests."""
    ph = t.pheno(spark, d).agg(F.count("*").alias("n"))
    g = t.markers(spark, d).select("base", "jj").distinct().agg(F.count("*").alias("g"))
    return ds.detectable_share(ph.join(F.broadcast(g)), power=0.8, alpha=0.05)


@query("flt_regex", """
SELECT count(*) AS n, count(*) FILTER (regexp_full_match(chrom, '[1-7][ABD]')) AS n_chrom_ok, count(*) FILTER (regexp_full_match(snp, 'm\\d{1,2}')) AS n_short_ids FROM mk""")
def flt_regex(spark, d):
    return t.markers(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("chrom").rlike(r"^[1-7][ABD]$")).alias("n_chrom_ok"), F.count_if(F.col("snp").rlike(r"^m\d{1,2}$")).alias("n_short_ids"))


@query("flt_intlike", """
SELECT bool_and(regexp_full_match(CAST(s_suppkey AS VARCHAR), '-?\\d+')) AS ids_int_like, bool_and(regexp_full_match(s_name, '-?\\d+')) AS names_int_like FROM supplier""")
def flt_intlike(spark, d):
    s = t.table(spark, d, "supplier")
    return s.agg(F.bool_and(F.col("s_suppkey").cast("string").rlike(r"^-?\d+$")).alias("ids_int_like"), F.bool_and(F.col("s_name").rlike(r"^-?\d+$")).alias("names_int_like"))


@query("prj_chrom_norm", "SELECT DISTINCT regexp_replace(lower(trim('  Chr' || chrom || ' ')), '^chr', '') AS chrom_norm FROM mk")
def prj_chrom_norm(spark, d):
    return t.markers(spark, d).select(F.regexp_replace(F.lower(F.trim(F.concat(F.lit("  Chr"), "chrom", F.lit(" ")))), "^chr", "").alias("chrom_norm")).distinct()


@query("prj_chrom_last", "SELECT right(chrom, 1) AS subgenome, count(*) AS n FROM qt GROUP BY 1")
def prj_chrom_last(spark, d):
    return t.qtl(spark, d).groupBy(F.right("chrom", F.lit(1)).alias("subgenome")).agg(F.count("*").alias("n"))


@query("prj_gene_version", """
, x AS (SELECT DISTINCT 'T' || k || CASE WHEN jj % 2 = 0 THEN '01G' ELSE '03G' END || jj || '01G' AS gene FROM mk)
SELECT gene, CASE WHEN instr(gene, '01G') > 0 THEN substr(gene, 1, instr(gene, '01G') - 1) || '02G' || substr(gene, instr(gene, '01G') + 3) ELSE gene END AS gene_new FROM x""")
def prj_gene_version(spark, d):
    g = t.markers(spark, d).select(F.concat(F.lit("T"), F.col("k").cast("string"), F.when(F.col("jj") % 2 == 0, "01G").otherwise("03G"), F.col("jj").cast("string"), F.lit("01G")).alias("gene")).distinct()
    at = F.instr("gene", "01G")
    return g.select("gene", F.when(at > 0, F.overlay("gene", F.lit("02G"), at, 3)).otherwise(F.col("gene")).alias("gene_new"))


_BLUE = """
, yr AS (SELECT o_custkey AS s, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS a, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS b FROM orders GROUP BY 1)
"""


def two_years(spark, d):
    o = t.table(spark, d, "orders")
    f = lambda i: F.avg(F.when(F.col("o_orderkey") % 2 == i, F.col("o_totalprice")))
    return o.groupBy(F.col("o_custkey").alias("s")).agg(f(0).alias("a"), f(1).alias("b"))


@query("prj_blue", _BLUE + "SELECT s, round(coalesce((a + b) / 2, a, b), 6) AS blue FROM yr")
def prj_blue(spark, d):
    return two_years(spark, d).select("s", r(F.coalesce((F.col("a") + F.col("b")) / 2, "a", "b"), "blue"))


@query("prj_blue_corr", _BLUE + "SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, round(corr(a, b), 6) + 0.0 AS r FROM yr")
def prj_blue_corr(spark, d):
    y = two_years(spark, d)
    n = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return y.agg(n.alias("n_both"), r(F.when(n >= 5, F.corr("a", "b")), "r"))


@query("prj_env_mean", """
SELECT o_custkey AS s, round((coalesce(sum(e), 0)) / nullif(count(e), 0), 6) AS y FROM (SELECT o_custkey, o_orderpriority, avg(o_totalprice) AS e FROM orders GROUP BY ALL) GROUP BY 1""")
def prj_env_mean(spark, d):
    """Row mean over environment columns, missing cells skipped."""
    envs = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    w = t.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("s")).pivot("o_orderpriority", envs).agg(F.avg("o_totalprice"))
    v = F.filter(F.array(*[F.col(f"`{e}`") for e in envs]), lambda x: x.isNotNull())
    return w.select("s", r(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(v), F.lit(0)), "y"))


@query("agg_unpivot_env", """
, w AS (SELECT o_custkey AS s, avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS h_1, avg(o_totalprice) FILTER (o_orderpriority = '2-HIGH') AS h_2, avg(o_totalprice) FILTER (o_orderpriority = '3-MEDIUM') AS h_3, avg(o_totalprice) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS h_4 FROM orders GROUP BY 1)
SELECT c_custkey AS s, round((coalesce(h_1, 0) + coalesce(h_2, 0) + coalesce(h_3, 0) + coalesce(h_4, 0)) / nullif((h_1 IS NOT NULL)::INT + (h_2 IS NOT NULL)::INT + (h_3 IS NOT NULL)::INT + (h_4 IS NOT NULL)::INT, 0), 6) AS y FROM customer LEFT JOIN w ON s = c_custkey""")
def agg_unpivot_env(spark, d):
    """Columns whose name matches the trait, excluded prefixes left out, averaged per sample."""
    w = t.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("s")).pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).agg(F.avg("o_totalprice"))
    w = w.toDF("s", "height_1", "height_2", "height_3", "height_4", "Min.height")
    u = w.unpivot(["s"], [*(F.col(f"height_{i}") for i in range(1, 5)), F.col("`Min.height`")], "col", "value")
    ok = F.col("col").rlike("(?i)height") & ~F.col("col").rlike(r"^(Rep|date_ymd|Min\.|Max\.)") & F.col("value").isNotNull()
    m = u.where(ok).groupBy("s").agg(F.avg("value").alias("y"))
    return t.table(spark, d, "customer").select(F.col("c_custkey").alias("s")).join(m, "s", "left").select("s", r("y", "y"))


@query("join_complete_case", """
SELECT s, round(ph.y, 4) AS t1, round(ph2.y, 4) AS t2 FROM ph JOIN ph2 USING (s) WHERE ph.y IS NOT NULL AND ph2.y IS NOT NULL AND s IN (SELECT s FROM g)""")
def join_complete_case(spark, d):
    j = t.pheno(spark, d).select("s", F.col("y").alias("t1")).join(t.pheno2(spark, d).select("s", F.col("y").alias("t2")), "s", "left")
    j = j.dropna(how="any", subset=["t1", "t2"]).join(t.geno(spark, d).select("s").distinct(), "s", "left_semi")
    return j.select("s", r("t1", "t1", 4), r("t2", "t2", 4))


@query("join_outer_pheno", """
SELECT coalesce(a.s, b.s) AS s, round(a.y, 6) AS y_first, round(b.y, 6) AS y_second FROM (SELECT o_custkey AS s, avg(o_totalprice) AS y FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
FULL OUTER JOIN (SELECT o_custkey AS s, avg(o_totalprice) AS y FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.s = b.s""")
def join_outer_pheno(spark, d):
    o = t.table(spark, d, "orders")
    sheet = lambda s, c: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("s")).agg(F.avg("o_totalprice").alias(c))
    return sheet("F", "a").join(sheet("O", "b"), "s", "full_outer").select("s", r("a", "y_first"), r("b", "y_second"))


@query("agg_dedup_mean", "SELECT CAST(c_nationkey AS BIGINT) AS key, count(*) AS n, round(avg(c_acctbal), 4) AS acctbal FROM customer GROUP BY 1")
def agg_dedup_mean(spark, d):
    return t.table(spark, d, "customer").groupBy(big("c_nationkey", "key")).agg(F.count("*").alias("n"), r(F.avg("c_acctbal"), "acctbal", 4))


@query("join_anchor_coords", """
SELECT s_name AS gene, coalesce(gen.chrom, 'x' || s_nationkey) AS chrom, CAST(floor((coalesce(st, 1000) + coalesce(en, 2000)) / 2) AS BIGINT) AS qtl_pos, CAST(500000 AS BIGINT) AS window_bp
FROM supplier LEFT JOIN gen ON gid = s_suppkey * 20 WHERE coalesce(gen.chrom, 'x' || s_nationkey) <> 'x3'""")
def join_anchor_coords(spark, d):
    """Anchor genes with annotation coordinates, a manual fallback, and allowed chromosomes."""
    g = t.genes(spark, d).select("gid", "chrom", "start", "end")
    s = t.table(spark, d, "supplier").select("s_name", "s_nationkey", (F.col("s_suppkey") * 20).alias("gid")).join(g, "gid", "left")
    s = s.withColumn("chrom", F.coalesce("chrom", F.concat(F.lit("x"), F.col("s_nationkey").cast("string")))).where(F.col("chrom") != "x3")
    mid = F.floor((F.coalesce("start", F.lit(1000)) + F.coalesce("end", F.lit(2000))) / 2)
    return s.select(F.col("s_name").alias("gene"), "chrom", mid.alias("qtl_pos"), F.lit(500000).cast("bigint").alias("window_bp"))


@query("fn_sha", """
SELECT gene, substr(sha256(string_agg(snp, ',' ORDER BY v)), 1, 16) AS digest, count(*) AS n FROM mg GROUP BY gene""")
def fn_sha(spark, d):
    m = t.markers(spark, d)
    lst = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("v", "snp"))), lambda x: x["snp"]), ",")
    # a gene's marker list is bounded by the gene
    return m.groupBy("gene").agg(F.substring(F.sha2(lst, 256), 1, 16).alias("digest"), F.count("*").alias("n"))


@query("fn_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS packed FROM events""")
def fn_json(spark, d):
    e = t.table(spark, d, "events")
    m = F.from_json("props", "map<string,bigint>")
    return e.select("event_id", m["k"].alias("k"), F.to_json(F.create_map(F.lit("k"), m["k"])).alias("packed"))


@query("fn_audit", """
SELECT count(*) AS n_rows, count(DISTINCT s) AS n_unique, count(*) = count(DISTINCT s) AS unique_ok, (SELECT count(*) FROM (SELECT s FROM ph INTERSECT SELECT s FROM ph2)) AS n_common,
  CASE WHEN count(*) = count(DISTINCT s) AND count(*) = (SELECT count(*) FROM (SELECT s FROM ph INTERSECT SELECT s FROM ph2)) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ph""")
def fn_audit(spark, d):
    a, b = t.pheno(spark, d), t.pheno2(spark, d)
    c = a.select("s").intersect(b.select("s")).agg(F.count("*")).scalar()
    x = a.agg(F.count("*").alias("n_rows"), F.count_distinct("s").alias("n_unique"))
    ok = F.col("n_rows") == F.col("n_unique")
    return x.select("n_rows", "n_unique", ok.alias("unique_ok"), c.alias("n_common"), F.when(ok & (F.col("n_rows") == c), "PASS").otherwise("FAIL").alias("verdict"))


@query("fn_keyword", """
SELECT doc_id, concat_ws(';', CASE WHEN contains(upper(text), 'THE') OR contains(upper(text), 'AND') THEN 'english' END, CASE WHEN contains(upper(text), 'QUE') THEN 'romance' END) AS tags FROM documents""")
def fn_keyword(spark, d):
    """Category tags by case-insensitive keyword containment."""
    cats = {"english": ["the", "and"], "romance": ["que"]}
    up = F.upper("text")
    tag = [F.when(F.exists(F.array(*[F.lit(k.upper()) for k in ks]), lambda k: up.contains(k)), c) for c, ks in cats.items()]
    return t.table(spark, d, "documents").select("doc_id", F.concat_ws(";", *tag).alias("tags"))
