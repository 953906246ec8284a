"""Queries over similarity hits, homolog groups, set operations and graphs.

Hits come from orders: gene ``A<t>`` of customer t resembles ``B<t>`` or ``B<t+1>``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from alloscan.catalog import tables as t
from alloscan.catalog.registry import big, query, r
from alloscan.operators import homologs as hm
from alloscan.session import cut_lineage

_HIT = """
, hit AS (SELECT 'ab' AS pr, 'A' || o_custkey AS x, 'B' || (o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS y, o_totalprice AS bit, o_orderkey AS ok FROM orders
  UNION ALL SELECT 'bd', 'B' || o_custkey, 'D' || (o_custkey + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END), o_totalprice, o_orderkey FROM orders
  UNION ALL SELECT 'ad', 'A' || o_custkey, 'D' || (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END), o_totalprice, o_orderkey FROM orders),
fw AS (SELECT pr, x, y FROM (SELECT *, row_number() OVER (PARTITION BY pr, x ORDER BY bit DESC, y) AS rn FROM hit) WHERE rn = 1),
bw AS (SELECT pr, x, y FROM (SELECT *, row_number() OVER (PARTITION BY pr, y ORDER BY bit DESC, x) AS rn FROM hit) WHERE rn = 1),
rbh AS (SELECT pr, x, y FROM fw JOIN bw USING (pr, x, y)),
hx AS (SELECT 'Q' || o_custkey AS q, CASE WHEN o_orderkey % 4 = 0 THEN 'A' WHEN o_orderkey % 4 = 1 THEN 'B' ELSE 'D' END || CAST(floor(o_orderkey / 40) AS BIGINT) AS s,
        o_totalprice AS bit, CAST(o_orderkey % 97 AS DOUBLE) AS ev, substr('ABD', CAST(o_custkey % 3 + 1 AS INT), 1) AS qsub FROM orders)
"""


def hits(spark, d):
    o = t.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    def part(name, a, b, m):
        step = F.when(F.col("o_orderkey") % m == 0, 1).otherwise(0)
        return F.struct(F.lit(name).alias("pr"), F.concat(F.lit(a), F.col("o_custkey").cast("string")).alias("x"),
                        F.concat(F.lit(b), (F.col("o_custkey") + step).cast("string")).alias("y"))
    parts = F.array(part("ab", "A", "B", 3), part("bd", "B", "D", 4), part("ad", "A", "D", 5))
    return o.select(F.explode(parts).alias("e"), F.col("o_totalprice").alias("bit"), F.col("o_orderkey").alias("ok")
                    ).select("e.pr", "e.x", "e.y", "bit", "ok")


def subject_hits(spark, d):
    o = t.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    m = F.col("o_orderkey") % 4
    sub = F.when(m == 0, "A").when(m == 1, "B").otherwise("D")
    return o.select(F.concat(F.lit("Q"), F.col("o_custkey").cast("string")).alias("q"),
                    F.concat(sub, F.floor(F.col("o_orderkey") / 40).cast("string")).alias("sseqid"),
                    F.col("o_totalprice").alias("bitscore"), (F.col("o_orderkey") % 97).cast("double").alias("evalue"),
                    F.substring(F.lit("ABD"), 1 + (F.col("o_custkey") % 3).cast("int"), F.lit(1)).alias("qsub"))


def rbh(spark, d):
    return hm.reciprocal_best(hits(spark, d), "x", "y", "bit", ["pr"])


def _pair(b, name, a, c):
    return b.where(F.col("pr") == name).select(F.col("x").alias(a), F.col("y").alias(c))


@query("join_rbh", _HIT + "SELECT pr, x, y FROM rbh")
def join_rbh(spark, d):
    return rbh(spark, d)


@query("join_triangle", _HIT + """
SELECT ab.x AS a, ab.y AS b, bd.y AS c FROM rbh ab JOIN rbh bd ON bd.pr = 'bd' AND bd.x = ab.y
JOIN rbh ad ON ad.pr = 'ad' AND ad.x = ab.x AND ad.y = bd.y WHERE ab.pr = 'ab'""")
def join_triangle(spark, d):
    b = rbh(spark, d)
    return hm.consistent_triads(_pair(b, "ab", "a", "b"), _pair(b, "bd", "b", "c"), _pair(b, "ad", "a", "c"))


_UNIQ = _HIT + """
, dp AS (SELECT DISTINCT pr, x, y FROM hit WHERE bit > 450000),
up AS (SELECT pr, x, y FROM (SELECT *, count(*) OVER (PARTITION BY pr, x) AS nx, count(*) OVER (PARTITION BY pr, y) AS ny FROM dp) WHERE nx = 1 AND ny = 1),
t0 AS (SELECT ab.x AS a, ab.y AS c, ad.y AS d1, bd.y AS d2 FROM up ab LEFT JOIN up ad ON ad.pr = 'ad' AND ad.x = ab.x LEFT JOIN up bd ON bd.pr = 'bd' AND bd.x = ab.y WHERE ab.pr = 'ab'),
st AS (SELECT a, c, d1 AS d FROM t0 WHERE d1 = d2)
"""


def strong_unique(spark, d):
    h = hits(spark, d).where(F.col("bit") > 450000)
    return {n: hm.unique_pairs(_pair(h, n, "x", "y"), "x", "y") for n in ("ab", "bd", "ad")}


@query("join_unique_pairs", _UNIQ + "SELECT pr, x, y FROM up")
def join_unique_pairs(spark, d):
    u = strong_unique(spark, d)
    out = None
    for n, df in u.items():
        df = df.select(F.lit(n).alias("pr"), "x", "y")
        out = df if out is None else out.unionByName(df)
    return out


@query("join_unique_triads", _UNIQ + """
SELECT a, c, d, 'strict' AS tier FROM st UNION ALL
SELECT a, c, coalesce(d1, d2, '') AS d, 'tier2' FROM t0 WHERE (d1 IS NULL OR d2 IS NULL)
  AND coalesce(d1, d2, '') NOT IN (SELECT d FROM st)""")
def join_unique_triads(spark, d):
    u = strong_unique(spark, d)
    return hm.tiered_triads(u["ab"].toDF("a", "c"), u["ad"].toDF("a", "d"), u["bd"].toDF("c", "d"))


@query("join_liftover", _HIT + """
SELECT q, s AS sseqid, bit AS bitscore, ev AS evalue, CASE WHEN left(s, 1) = qsub THEN 'same_subgenome_best' ELSE 'cross_subgenome_fallback' END AS strategy
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN left(s, 1) = qsub THEN 0 ELSE 1 END, bit DESC, ev, s) AS rn FROM hx) WHERE rn = 1""")
def join_liftover(spark, d):
    return hm.preferred_hit(subject_hits(spark, d), "q", F.substring("sseqid", 1, 1) == F.col("qsub"))


_SECOND = _HIT + """
, ps AS (SELECT q, s, max(bit) AS bit FROM hx GROUP BY q, s),
b1 AS (SELECT q, s, bit FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bit DESC, s) AS rn FROM ps) WHERE rn = 1),
b2 AS (SELECT b1.q, b1.s, b1.bit, max(ps.bit) AS second FROM b1 LEFT JOIN ps ON ps.q = b1.q AND ps.s <> b1.s GROUP BY ALL)
"""


@query("agg_best_second", _SECOND + """
SELECT q, s AS best, bit AS best_score, second, second IS NULL OR bit >= 1.05 * second AS margin_ok FROM b2""")
def agg_best_second(spark, d):
    b = hm.best_and_second(subject_hits(spark, d), ["q"], "bitscore", "sseqid")
    return b.select("q", "best", "best_score", "second", hm.margin_ok(1.05).alias("margin_ok"))


@query("agg_best_bits", _HIT + """
SELECT least(x, y) AS x, greatest(x, y) AS y, max(bit) AS bit_score FROM
 (SELECT x, y, bit FROM hit UNION ALL SELECT y, x, bit - 1 FROM hit) GROUP BY 1, 2""")
def agg_best_bits(spark, d):
    h = hits(spark, d)
    both = h.select("x", "y", "bit").unionByName(h.select(F.col("y").alias("x"), F.col("x").alias("y"), (F.col("bit") - 1).alias("bit")))
    return hm.unordered_best_bits(both, "x", "y", "bit")


@query("join_crosswalk", _SECOND + """
, ok AS (SELECT q, s FROM b2 WHERE second IS NULL OR bit >= 1.05 * second),
ase AS (SELECT o_orderkey AS rid, 'Q' || o_custkey AS f, 'Q' || (o_custkey + 1) AS b FROM orders),
j AS (SELECT rid, f.s AS fs, b.s AS bs FROM ase LEFT JOIN ok f ON f.q = ase.f LEFT JOIN ok b ON b.q = ase.b)
SELECT CASE WHEN fs IS NOT NULL AND bs IS NOT NULL THEN
   CASE WHEN fs <> bs AND substr(fs, 2) = substr(bs, 2) THEN 'quartet_contained' WHEN fs = bs THEN 'same_gene_excluded' ELSE 'mapped_not_same_quartet' END
   WHEN fs IS NOT NULL OR bs IS NOT NULL THEN 'one_end_mapped' ELSE 'unmapped' END AS status, count(*) AS n FROM j GROUP BY 1""")
def join_crosswalk(spark, d):
    """Map both ends of each record by confident best hits; compare their homolog groups."""
    ok = hm.best_and_second(subject_hits(spark, d), ["q"], "bitscore", "sseqid").where(hm.margin_ok(1.05))
    o = t.table(spark, d, "orders")
    key = lambda c: F.concat(F.lit("Q"), c.cast("string"))
    ase = o.select("o_orderkey", key(F.col("o_custkey")).alias("f"), key(F.col("o_custkey") + 1).alias("b"))
    j = (ase.join(ok.select(F.col("q").alias("f"), F.col("best").alias("fs")), "f", "left")
         .join(ok.select(F.col("q").alias("b"), F.col("best").alias("bs")), "b", "left"))
    grp = lambda c: F.substr(F.col(c), F.lit(2))
    both = F.col("fs").isNotNull() & F.col("bs").isNotNull()
    st = (F.when(both & (F.col("fs") != F.col("bs")) & (grp("fs") == grp("bs")), "quartet_contained")
          .when(both & (F.col("fs") == F.col("bs")), "same_gene_excluded").when(both, "mapped_not_same_quartet")
          .when(F.col("fs").isNotNull() | F.col("bs").isNotNull(), "one_end_mapped").otherwise("unmapped"))
    return j.groupBy(st.alias("status")).agg(F.count("*").alias("n"))


_MEM = """
, un AS (SELECT gene, sub, CAST(base * 1000 + jj AS BIGINT) AS grp, count(*) AS n_snp FROM mg GROUP BY ALL),
lng AS (SELECT gene, grp FROM un UNION ALL SELECT gene, grp + 1 FROM un WHERE n_snp < 5 UNION ALL SELECT 'x' || gene, grp FROM un),
me AS (SELECT l.grp, u.sub, u.gene, u.n_snp FROM lng l JOIN un u USING (gene)),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, sub ORDER BY n_snp DESC, gene) AS rn, count(*) OVER (PARTITION BY grp, sub) AS nc FROM (SELECT DISTINCT * FROM me)) WHERE rn = 1)
"""


def members(spark, d):
    """Orthology table in long form: own group, a second group for small genes, unknown ids."""
    un = t.markers(spark, d).groupBy("gene", "sub", (F.col("base") * 1000 + F.col("jj")).alias("grp")).agg(F.count("*").alias("n_snp"))
    table = un.select("gene", "grp").unionByName(un.where("n_snp < 5").select("gene", (F.col("grp") + 1).alias("grp"))
                      ).unionByName(un.select(F.concat(F.lit("x"), "gene").alias("gene"), "grp"))
    return un, table


@query("join_orthology_long", _MEM + """
SELECT count(*) AS n_rows, count(*) FILTER (gene IN (SELECT gene FROM un)) AS n_mapped,
       count(*) FILTER (gene NOT IN (SELECT gene FROM un)) AS n_ignored FROM lng""")
def join_orthology_long(spark, d):
    un, table = members(spark, d)
    j = table.join(un.select("gene", F.lit(1).alias("hit")), "gene", "left")
    return j.agg(F.count("*").alias("n_rows"), F.count("hit").alias("n_mapped"), F.count_if(F.col("hit").isNull()).alias("n_ignored"))


@query("join_assemble", _MEM + """
SELECT grp, max(gene) FILTER (sub = 'A') AS "gene_A", max(gene) FILTER (sub = 'B') AS "gene_B", max(gene) FILTER (sub = 'D') AS "gene_D", bool_or(nc > 1) AS ambiguous
FROM pk GROUP BY grp HAVING count(DISTINCT sub) = 3""")
def join_assemble(spark, d):
    un, table = members(spark, d)
    m = table.join(un.select("gene", "sub", "n_snp"), "gene")
    return hm.assemble_groups(m, ["A", "B", "D"])


@query("join_orthology_wide", _MEM + """
, wd AS (SELECT grp, string_agg(gene, ', ' ORDER BY gene) AS genes FROM lng GROUP BY grp),
ex AS (SELECT grp, trim(unnest(string_split(genes, ','))) AS gene FROM wd)
SELECT ex.grp, un.sub, ex.gene, un.n_snp FROM ex JOIN un USING (gene)""")
def join_orthology_wide(spark, d):
    un, table = members(spark, d)
    # a wide row lists the genes of one homolog group: a handful by definition
    wide = table.groupBy("grp").agg(F.array_join(F.collect_list("gene"), ", ").alias("genes"))
    ex = wide.select("grp", F.explode(F.split("genes", ",")).alias("gene")).withColumn("gene", F.trim("gene")).where(F.col("gene") != "")
    return ex.join(un.select("gene", "sub", "n_snp"), "gene").select("grp", "sub", "gene", "n_snp")


_AUD = """
, pa AS (SELECT CAST(floor(o_orderkey / 500) AS BIGINT) AS block, 'A' || o_custkey AS a, 'D' || (o_custkey + o_orderkey % 3) AS d, o_totalprice AS e, o_orderkey AS ord FROM orders),
wa AS (SELECT *, row_number() OVER (PARTITION BY block, a ORDER BY e, ord) = 1 AS ba, row_number() OVER (PARTITION BY block, d ORDER BY e, ord) = 1 AS bd,
  row_number() OVER (PARTITION BY a ORDER BY e, ord) AS ra, row_number() OVER (PARTITION BY d ORDER BY e, ord) AS rd FROM pa),
au AS (SELECT *, CASE WHEN ba AND bd AND ra = 1 AND rd = 1 THEN '' WHEN NOT ba THEN 'within_block: same A has better D' WHEN NOT bd THEN 'within_block: same D has better A'
  WHEN ra > 1 THEN 'non-reciprocal: same A has better D in another block' WHEN rd > 1 THEN 'non-reciprocal: same D has better A in another block' ELSE 'tie/ambiguous' END AS reason FROM wa)
"""


def audit(spark, d):
    o = t.table(spark, d, "orders")
    p = o.select(F.floor(F.col("o_orderkey") / 500).alias("block"), F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("a"),
                 F.concat(F.lit("D"), (F.col("o_custkey") + F.col("o_orderkey") % 3).cast("string")).alias("d"),
                 F.col("o_totalprice").alias("e"), F.col("o_orderkey").alias("ord"))
    return hm.pair_audit(p)


@query("win_audit", _AUD + """
SELECT ord, block, a, d, ba AS within_block_best_a, bd AS within_block_best_d, ra AS rank_a, rd AS rank_d,
       ra = 1 AND rd = 1 AS reciprocal_best, ba AND bd AND ra = 1 AND rd = 1 AS final_1to1, reason AS reason_dropped FROM au""")
def win_audit(spark, d):
    return audit(spark, d).select("ord", "block", "a", "d", "within_block_best_a", "within_block_best_d", big("rank_a"), big("rank_d"),
                                  "reciprocal_best", "final_1to1", "reason_dropped")


@query("agg_value_counts", _AUD + "SELECT reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM au GROUP BY reason")
def agg_value_counts(spark, d):
    c = audit(spark, d).groupBy(F.col("reason_dropped").alias("reason")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n")).scalar()
    return c.select("reason", "n", r(F.col("n") / total, "share"))


@query("agg_attr_json", _AUD + """
SELECT ba AND bd AND ra = 1 AND rd = 1 AS final_1to1, count(*) AS n, count(DISTINCT a) AS n_unique_a, count(DISTINCT d) AS n_unique_d FROM au GROUP BY 1""")
def agg_attr_json(spark, d):
    return audit(spark, d).groupBy("final_1to1").agg(F.count("*").alias("n"), F.count_distinct("a").alias("n_unique_a"),
                                                     F.count_distinct("d").alias("n_unique_d"))


def edges(spark, d):
    """Reciprocal pairs in common with the strong-score pairs, and strong pairs alone."""
    one = rbh(spark, d).select(F.col("x").alias("a"), F.col("y").alias("b"))
    two = hits(spark, d).where(F.col("bit") > 480000).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    return one, two


_EDGE = _HIT + """
, e1 AS (SELECT x AS a, y AS b FROM rbh), e2 AS (SELECT DISTINCT x AS a, y AS b FROM hit WHERE bit > 480000)
"""


@query("set_intersect", _EDGE + "SELECT a, b FROM e1 INTERSECT SELECT a, b FROM e2")
def set_intersect(spark, d):
    one, two = edges(spark, d)
    return one.intersect(two)


@query("set_union_edges", _EDGE + "SELECT a, b FROM e1 UNION SELECT a, b FROM e2")
def set_union_edges(spark, d):
    one, two = edges(spark, d)
    return one.union(two).distinct()


@query("set_except", _EDGE + "SELECT a, b FROM e2 EXCEPT SELECT a, b FROM e1")
def set_except(spark, d):
    one, two = edges(spark, d)
    return two.subtract(one)


_COMP = _HIT + """
, ed AS (SELECT x AS a, y AS b FROM rbh),
b2 AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
reach AS (SELECT a AS n, a AS m FROM b2 UNION SELECT r.n, b2.b FROM reach r JOIN b2 ON b2.a = r.m),
cp AS (SELECT n AS node, min(m) AS comp FROM reach GROUP BY n)
"""


@query("set_graph_components", _COMP + "SELECT node, comp FROM cp")
def set_graph_components(spark, d):
    return hm.components(rbh(spark, d).select(F.col("x").alias("a"), F.col("y").alias("b")))


@query("set_graph", _COMP + """
, ne AS (SELECT comp, count(*) AS n_edges FROM (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM ed) e JOIN cp ON cp.node = e.a GROUP BY comp),
cc AS (SELECT comp, count(*) AS n_genes, count(DISTINCT left(node, 1)) AS k FROM cp GROUP BY comp)
SELECT comp, n_genes, CASE WHEN k < n_genes THEN 'ambiguous' WHEN k = 4 THEN 'strict4' WHEN k = 3 THEN 'partial3' ELSE 'pair' END AS kind,
       coalesce(n_edges, 0) AS n_edges, CASE WHEN k >= n_genes THEN round(n_edges / (k * (k - 1) / 2), 6) END AS completeness FROM cc LEFT JOIN ne USING (comp)""")
def set_graph(spark, d):
    e = cut_lineage(rbh(spark, d).select(F.col("x").alias("a"), F.col("y").alias("b")))
    c = hm.classify_components(hm.components(e), e, F.substring("node", 1, 1))
    return c.select("comp", big("n_genes"), "kind", big("n_edges"), r("completeness", "completeness"))


@query("set_union", """
SELECT snp, chi2, CAST(NULL AS VARCHAR) AS qtl, 'scan' AS source FROM (SELECT snp, round(chi2, 6) AS chi2 FROM ss WHERE chi2 > 4)
UNION ALL SELECT snp, NULL, qtl, 'sentinel' FROM mk JOIN qt ON qt.chrom = mk.chrom AND abs(pos - qpos) <= 30000""")
def set_union(spark, d):
    from alloscan.operators import intervals as iv
    a = t.sumstats(spark, d, p=False).where(F.col("chi2") > 4).select("snp", r("chi2", "chi2"), F.lit("scan").alias("source"))
    q = t.qtl(spark, d).select("chrom", "qtl", "qpos")
    b = iv.points_in_intervals(t.markers(spark, d).select("snp", "chrom", "pos"), q, F.col("qpos") - 30000, F.col("qpos") + 30000)
    return a.unionByName(b.select("snp", "qtl", F.lit("sentinel").alias("source")), allowMissingColumns=True)


@query("set_distinct", "SELECT DISTINCT chrom, CAST(floor(qpos / 1000000) AS BIGINT) AS mb FROM qt")
def set_distinct(spark, d):
    return t.qtl(spark, d).select("chrom", F.floor(F.col("qpos") / 1000000).alias("mb")).dropDuplicates()


@query("set_pairs", """
, sb AS (SELECT DISTINCT base, sub FROM mk)
SELECT a.base, a.sub AS sub_x, b.sub AS sub_y FROM sb a JOIN sb b ON a.base = b.base AND a.sub < b.sub""")
def set_pairs(spark, d):
    s = t.markers(spark, d).select("base", "sub").distinct()
    return (s.select("base", F.col("sub").alias("sub_x")).join(s.select("base", F.col("sub").alias("sub_y")), "base")
            .where(F.col("sub_x") < F.col("sub_y")))


@query("fn_homology_tier", _SECOND + """
, tr AS (SELECT b2.q, bit, second, (bit % 100) AS pid, (bit % 97) / 97 AS qc, (bit % 89) / 89 AS scv, pow(10, -(CAST(floor(bit) AS BIGINT) % 30)) AS ev FROM b2)
SELECT q, CASE WHEN ev <= 1e-10 AND qc >= 0.70 AND scv >= 0.60 AND pid >= 35 AND NOT (second IS NOT NULL AND second > 0 AND bit / second < 1.10) THEN 'ortholog_grade_oneway'
  WHEN ev <= 1e-5 AND qc >= 0.50 AND pid >= 25 THEN 'family_level' ELSE 'weak' END AS tier FROM tr""")
def fn_homology_tier(spark, d):
    b = hm.best_and_second(subject_hits(spark, d), ["q"], "bitscore", "sseqid").withColumnRenamed("best_score", "bitscore")
    bit = F.col("bitscore")
    b = (b.withColumn("pident", bit % 100).withColumn("qcov", bit % 97 / 97).withColumn("scov", bit % 89 / 89)
         .withColumn("evalue", F.pow(F.lit(10.0), -(F.floor(bit) % 30))))
    return b.select("q", hm.homology_tier().alias("tier"))


@query("fn_hyper", _HIT + """
, hm AS (SELECT pr, x, max(bit) > 490000 AS strong FROM hit GROUP BY ALL), rx AS (SELECT DISTINCT pr, x, true AS ins FROM rbh),
hg AS (SELECT pr, count(*) AS n, count(*) FILTER (strong) AS marked, count(ins) AS drawn, count(*) FILTER (strong AND ins) AS k FROM hm LEFT JOIN rx USING (pr, x) GROUP BY pr),
lc AS (SELECT *, unnest(range(greatest(k, drawn - (n - marked)), least(marked, drawn) + 1)) AS i FROM hg),
pu AS (SELECT pr, sum(exp(lgamma(marked + 1) - lgamma(i + 1) - lgamma(marked - i + 1) + lgamma(n - marked + 1) - lgamma(drawn - i + 1) - lgamma(n - marked - drawn + i + 1)
         - lgamma(n + 1) + lgamma(drawn + 1) + lgamma(n - drawn + 1))) AS p FROM lc GROUP BY pr)
SELECT pr, n, marked, drawn, k, round(k * n / (marked * drawn), 6) AS fold, round(least(1.0, coalesce(p, 0)), 8) + 0.0 AS p_upper FROM hg LEFT JOIN pu USING (pr)""")
def fn_hyper(spark, d):
    """Enrichment of strong genes among genes in reciprocal pairs, per pair type."""
    from alloscan.functions import stat_columns as sc
    h = hits(spark, d).groupBy("pr", "x").agg(F.max("bit").alias("m"))
    b = rbh(spark, d).select("pr", "x").distinct().withColumn("in_set", F.lit(1))
    g = h.join(b, ["pr", "x"], "left").groupBy("pr").agg(
        F.count("*").alias("n"), F.count_if(F.col("m") > 490000).alias("marked"), F.count("in_set").alias("drawn"),
        F.count_if((F.col("m") > 490000) & F.col("in_set").isNotNull()).alias("k"))
    return g.select("pr", "n", "marked", "drawn", "k", r(F.col("k") * F.col("n") / (F.col("marked") * F.col("drawn")), "fold"),
                    r(sc.hypergeom_p("k", "n", "marked", "drawn"), "p_upper", 8))


@query("agg_group_min", """
, pm AS (SELECT CAST(floor(o_custkey / 3) AS BIGINT) AS pair_id, exp(-o_totalprice / 50000) AS p FROM orders)
SELECT CAST(floor(c_custkey / 3) AS BIGINT) AS pair_id, round(coalesce(min(p), 1), 9) AS p_min FROM customer LEFT JOIN pm ON pair_id = floor(c_custkey / 3) GROUP BY 1""")
def agg_group_min(spark, d):
    o = t.table(spark, d, "orders").groupBy(F.floor(F.col("o_custkey") / 3).alias("pair_id")).agg(
        F.min(F.exp(-F.col("o_totalprice") / 50000)).alias("p"))
    c = t.table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 3).alias("pair_id")).distinct()
    return c.join(o, "pair_id", "left").select("pair_id", r(F.coalesce("p", F.lit(1.0)), "p_min", 9))
