"""Homolog groups from similarity hits: best hits, reciprocal pairs, triads, graph parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloscan.operators.scan_order import ordered_scan
from alloscan.operators.skew import hot_join, hot_keys, with_least
from alloscan.session import cut_lineage


def best_per(hits: DataFrame, by: list[str], score: str, other: str, carry: list[str] = ()) -> DataFrame:
    """Best hit per key: largest score, then smallest partner. One map-side combined max,
    so a hot query is folded before it is shuffled."""
    keep = [other, score, *carry]
    m = F.min_by(F.struct(*keep), F.struct((-F.col(score)).alias("s"), F.col(other)))
    return hits.groupBy(*by).agg(m.alias("_b")).select(*by, *[F.col(f"_b.{c}") for c in keep])


def reciprocal_best(hits: DataFrame, a: str, b: str, score: str, by: list[str] = ()) -> DataFrame:
    """Mutual best pairs (within ``by``)."""
    fw = best_per(hits, [*by, a], score, b).select(*by, a, b)
    bw = best_per(hits, [*by, b], score, a).select(*by, a, b)
    return fw.join(bw, [*by, a, b])


def consistent_triads(ab: DataFrame, bc: DataFrame, ac: DataFrame) -> DataFrame:
    """Triads whose three reciprocal pairs agree; inputs (a,b), (b,c), (a,c)."""
    return ab.join(bc, "b").join(ac, ["a", "c"]).select("a", "b", "c")


def unique_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs where each side has exactly one partner."""
    p = pairs.select(a, b).distinct()
    ua = p.groupBy(a).agg(F.count("*").alias("n"), F.min(b).alias(b)).where("n = 1")
    ub = p.groupBy(b).agg(F.count("*").alias("n"), F.min(a).alias(a)).where("n = 1")
    return ua.select(a, b).join(ub.select(a, b), [a, b])


def tiered_triads(ac: DataFrame, ad: DataFrame, cd: DataFrame) -> DataFrame:
    """Strict triads (three mutual pairs agree) and tier 2 (two of three, no conflict)."""
    t = (ac.select("a", "c").join(ad.select("a", F.col("d").alias("d_ad")), "a", "left")
         .join(cd.select("c", F.col("d").alias("d_cd")), "c", "left"))
    strict = t.where(F.col("d_ad") == F.col("d_cd")).select("a", "c", F.col("d_ad").alias("d"),
                                                              F.lit("strict").alias("tier"))
    d = F.coalesce("d_ad", "d_cd")
    used = strict.select(F.col("d").alias("ud"), F.lit(True).alias("taken"))
    rest = t.where(F.col("d_ad").isNull() | F.col("d_cd").isNull()).withColumn("d", d)
    rest = (rest.join(used, rest["d"] == used["ud"], "left").where(F.col("taken").isNull())
            .select("a", "c", F.coalesce("d", F.lit("")).alias("d"), F.lit("tier2").alias("tier")))
    return strict.unionByName(rest)


def best_and_second(hits: DataFrame, by: list[str], score: str, other: str) -> DataFrame:
    """Best partner, its score, and the best score of any other partner (null if none)."""
    per = hits.groupBy(*by, other).agg(F.max(score).alias(score))
    best = best_per(per, by, score, other)
    two = (per.join(best.select(*by, F.col(other).alias("_bo")), by)
           .where(F.col(other) != F.col("_bo")).groupBy(*by).agg(F.max(score).alias("second")))
    return best.select(*by, F.col(other).alias("best"), F.col(score).alias("best_score")).join(two, by, "left")


def margin_ok(k: float) -> Column:
    return F.col("second").isNull() | (F.col("best_score") >= k * F.col("second"))


def preferred_hit(hits: DataFrame, query: str, same: Column) -> DataFrame:
    """One hit per query: same-subgenome hits first, then bitscore, then e-value, then subject."""
    h = hits.withColumn("_same", same)
    key = F.struct((~F.col("_same")).alias("x"), (-F.col("bitscore")).alias("y"), "evalue", "sseqid")
    b = h.groupBy(query).agg(F.min_by(F.struct("sseqid", "bitscore", "evalue", "_same"), key).alias("b"))
    return b.select(query, "b.sseqid", "b.bitscore", "b.evalue", F.when(
        F.col("b._same"), "same_subgenome_best").otherwise("cross_subgenome_fallback").alias("strategy"))


def unordered_best_bits(hits: DataFrame, q: str, s: str, bits: str) -> DataFrame:
    return hits.groupBy(F.least(q, s).alias("x"), F.greatest(q, s).alias("y")).agg(
        F.max(bits).alias("bit_score"))


def assemble_groups(members: DataFrame, subs: list[str]) -> DataFrame:
    """One gene per subgenome and group (most markers, then smallest id); complete groups only.

    ``members``: ``grp, sub, gene, n_snp``. ``ambiguous`` marks groups that had a choice.
    """
    m = members.where(F.col("sub").isin(subs)).dropDuplicates(["grp", "sub", "gene"])
    pick = m.groupBy("grp", "sub").agg(
        F.min_by("gene", F.struct((-F.col("n_snp")).alias("n"), "gene")).alias("gene"),
        (F.count("*") > 1).alias("amb"))
    g = pick.groupBy("grp").agg(
        *[F.max(F.when(F.col("sub") == s, F.col("gene"))).alias(f"gene_{s}") for s in subs],
        F.bool_or("amb").alias("ambiguous"))
    return g.dropna(subset=[f"gene_{s}" for s in subs])


def pair_audit(pairs: DataFrame) -> DataFrame:
    """Keep/drop decision per collinear pair: ``block, a, d, e, ord`` (unique ``ord``).

    Best partner within the block for both sides, rank of the pair among all pairs of each
    gene (by e, then order), reciprocal best, final one-to-one flag and the drop reason.
    """
    p = pairs = cut_lineage(pairs)
    o = F.struct("e", "ord")
    for name, keys in (("ba", ["block", "a"]), ("bd", ["block", "d"])):
        m = pairs.groupBy(*keys).agg(F.min_by("ord", o).alias(f"_{name}"))
        p = hot_join(p, m, keys)
    for name, key in (("rank_a", "a"), ("rank_d", "d")):
        # position within a gene = global position minus the gene's first position
        s = ordered_scan(pairs.select(key, "e", "ord"), [key, "e", "ord"], {"_g": ("count", "")})
        f = s.groupBy(key).agg(F.min("_g").alias("_f"))
        s = s.join(f, key).select("ord", (F.col("_g") - F.col("_f") + 1).alias(name))
        p = p.join(s, "ord")
    wa, wd = F.col("_ba") == F.col("ord"), F.col("_bd") == F.col("ord")
    recip = (F.col("rank_a") == 1) & (F.col("rank_d") == 1)
    # fixed values: reason strings of the audit table
    reason = (F.when(wa & wd & recip, "")
              .when(~wa, "within_block: same A has better D")
              .when(~wd, "within_block: same D has better A")
              .when(F.col("rank_a") > 1, "non-reciprocal: same A has better D in another block")
              .when(F.col("rank_d") > 1, "non-reciprocal: same D has better A in another block")
              .otherwise("tie/ambiguous"))
    return p.select(*pairs.columns, wa.alias("within_block_best_a"), wd.alias("within_block_best_d"),
                    "rank_a", "rank_d", recip.alias("reciprocal_best"),
                    (wa & wd & recip).alias("final_1to1"), reason.alias("reason_dropped"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components as (node, comp = smallest node), by alternating star rounds.

    Each round links every node to the smallest of its neighbours, first over larger then
    over smaller neighbours; the number of rounds grows with the log of the diameter and
    a hub is folded by a map-side min before its edges are rewritten. Lineage is cut in
    the shared checkpoint folder after each round.
    """
    edges = cut_lineage(edges.select("a", "b"))
    e = cut_lineage(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
                    .where(F.col("lo") < F.col("hi")).distinct())
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()

    def large(e, hot):
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        return (with_least(both, "u", "v", hot).where(F.col("v") > F.col("u"))
                .select(F.least("u", "m").alias("lo"), F.col("v").alias("hi")).where(F.col("lo") < F.col("hi")).distinct())

    def small(e, hot):
        j = with_least(e, "hi", "lo", hot)
        return (j.select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
                .unionByName(j.select(F.col("m").alias("lo"), "hi"))
                .where(F.col("lo") < F.col("hi")).distinct())

    # a round that changes nothing has the same edges: their number and the sum of their 64-bit hashes tell
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
    seen, now = None, mark(e)
    while now != seen:
        # a node's edges grow in neither step, so those that are hot now hold for both
        ends = e.select(F.explode(F.array("lo", "hi")).alias("u"))
        hot = hot_keys(ends, "u", now[0])
        e = cut_lineage(small(large(e, hot), hot))
        seen, now = now, mark(e)
    return nodes.join(e.select(F.col("hi").alias("node"), F.col("lo").alias("comp")), "node", "left").select(
        "node", F.coalesce("comp", "node").alias("comp"))


def classify_components(comp: DataFrame, edges: DataFrame, sub: Column) -> DataFrame:
    """strict4 / partial3 / pair / ambiguous (a subgenome twice), edge count and completeness."""
    e = (edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
         .join(comp.select(F.col("node").alias("a"), "comp"), "a").groupBy("comp").agg(F.count("*").alias("n_edges")))
    c = comp.withColumn("sub", sub).groupBy("comp").agg(
        F.count("*").alias("n"), F.count_distinct("sub").alias("k"))
    kind = (F.when(F.col("k") < F.col("n"), "ambiguous").when(F.col("k") == 4, "strict4")
            .when(F.col("k") == 3, "partial3").otherwise("pair"))
    return c.join(e, "comp", "left").select(
        "comp", F.col("n").alias("n_genes"), kind.alias("kind"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"),
        F.when(kind != "ambiguous", F.col("n_edges") / (F.col("k") * (F.col("k") - 1) / 2)).alias("completeness"))


def homology_tier() -> Column:
    """Confidence of a one-way best hit from e, identity, coverages and score separation."""
    amb = F.col("second").isNotNull() & (F.col("second") > 0) & (F.col("bitscore") / F.col("second") < 1.10)
    return (F.when(F.col("bitscore").isNull(), "no_hit")
            .when((F.col("evalue") <= 1e-10) & (F.col("qcov") >= 0.70) & (F.col("scov") >= 0.60)
                  & (F.col("pident") >= 35) & ~amb, "ortholog_grade_oneway")
            .when((F.col("evalue") <= 1e-5) & (F.col("qcov") >= 0.50) & (F.col("pident") >= 25), "family_level")
            .otherwise("weak"))
