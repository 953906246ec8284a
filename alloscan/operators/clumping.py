"""Greedy reductions of hits to loci, computed in parallel with the greedy result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloscan.session import cut_lineage


def clump_leads(hits: DataFrame, reach: int) -> DataFrame:
    """Leads of the greedy rule: lowest (p, id) first, absorbing all within ``reach`` bp.

    ``hits``: ``chrom, pos, p, id``. With bins as wide as the reach, every two hits of a
    bin absorb each other, so only a bin's best hit can lead; it leads when no better
    undecided hit lies in reach in the two neighbouring bins. Each round settles all such
    local leads at once and drops what they cover (a covered hit can never lead). A round
    is one stored table: what is still open, and its new leads.
    """
    # equal positions share their fate: one row per position bounds a bin by its width
    left = (hits.groupBy("chrom", "pos").agg(F.min(F.struct("p", "id")).alias("key"))
            .withColumn("b", F.floor(F.col("pos") / reach)))
    leads = None
    while True:
        best = left.groupBy("chrom", "b").agg(F.min(F.struct("key", "pos")).alias("m")).select(
            "chrom", F.col("b").alias("cb"), F.col("m.key").alias("ckey"), F.col("m.pos").alias("cpos"))
        near = left.withColumn("cb", F.explode(F.array(F.col("b") - 1, F.col("b") + 1)))
        beaten = (near.join(best, ["chrom", "cb"])
                  .where((F.abs(F.col("pos") - F.col("cpos")) <= reach) & (F.col("key") < F.col("ckey")))
                  .select("chrom", "cb").distinct())
        new = best.join(beaten, ["chrom", "cb"], "left_anti").select(
            "chrom", F.explode(F.array(F.col("cb") - 1, F.col("cb"), F.col("cb") + 1)).alias("b"),
            F.col("cpos").alias("lpos"), F.col("ckey").alias("lkey"))
        hit = F.abs(F.col("pos") - F.col("lpos")) <= reach
        state = cut_lineage(left.join(new, ["chrom", "b"], "left").groupBy("chrom", "pos", "b").agg(
            F.first("key").alias("key"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("covered"),
            F.coalesce(F.bool_or(F.col("lpos") == F.col("pos")), F.lit(False)).alias("lead")))
        found = state.where("lead").select("chrom", F.col("pos").alias("lpos"), F.col("key").alias("lkey"))
        leads = found if leads is None else leads.unionByName(found)
        left = state.where(~F.col("covered")).select("chrom", "pos", "key", "b")
        if left.isEmpty():
            return leads


def clump(hits: DataFrame, reach: int) -> DataFrame:
    """Hits with their lead: the best lead within reach (leads lie further apart than
    the reach, so at most two compete). Adds ``lead_id, lead_p, lead_pos``."""
    leads = clump_leads(hits, reach).withColumn("lb", F.floor(F.col("lpos") / reach)).withColumn(
        "b", F.explode(F.array(F.col("lb") - 1, F.col("lb"), F.col("lb") + 1))).drop("lb")
    h = hits.withColumn("b", F.floor(F.col("pos") / reach)).join(leads, ["chrom", "b"]).where(
        F.abs(F.col("pos") - F.col("lpos")) <= reach)
    own = h.groupBy("id").agg(F.min(F.struct("lkey", "lpos")).alias("m"))
    return hits.join(own, "id").select(*hits.columns, F.col("m.lkey.id").alias("lead_id"),
                                       F.col("m.lkey.p").alias("lead_p"), F.col("m.lpos").alias("lead_pos"))


def clump_table(hits: DataFrame, reach: int) -> DataFrame:
    """One row per lead with clump size and extent."""
    return clump(hits, reach).groupBy("chrom", "lead_id", "lead_p", "lead_pos").agg(
        F.count("*").alias("clump_size"), F.min("pos").alias("clump_min_pos"),
        F.max("pos").alias("clump_max_pos"))


def spaced_leads(hits: DataFrame, top_n: int, apart: int, buffer: int | None = None) -> DataFrame:
    """First ``top_n`` hits by (p, id) that lie at least ``apart`` from every chosen one.

    ``apart`` is exclusive (a hit at exactly that distance is chosen), so it is the clump
    rule with a reach of ``apart - 1``; the report itself is the ``top_n``.
    """
    return (clump_leads(hits, apart - 1).select("chrom", F.col("lpos").alias("pos"),
                                                F.col("lkey.p").alias("p"), F.col("lkey.id").alias("id"))
            .orderBy("p", "id").limit(top_n))


def collapse_loci(hits: DataFrame, window: int) -> DataFrame:
    """Single-link loci in order of significance; adds ``locus`` (the founder's id).

    ``hits``: ``grp, pos, p, id``. Taken by ascending (p, id), a hit joins the earliest
    locus with a member within ``window``, else founds one. So the locus of a hit is the
    earliest locus among its better neighbours. Rounds pass it on from better to worse
    neighbouring hits until nothing changes; each stores one table.
    """
    key = F.struct("p", "id")
    b = F.floor(F.col("pos") / window)
    state = cut_lineage(hits.select("grp", "pos", "p", "id", key.alias("lab")))
    while True:
        src = state.select("grp", F.explode(F.array(b - 1, b, b + 1)).alias("b"),
                           F.col("pos").alias("np"), key.alias("nk"), F.col("lab").alias("nl"))
        best = (state.withColumn("b", b).join(src, ["grp", "b"])
                .where((F.abs(F.col("pos") - F.col("np")) <= window) & (F.col("nk") < key))
                .groupBy("id").agg(F.min("nl").alias("nl")))
        moved = cut_lineage(state.join(best, "id", "left").select(
            "grp", "pos", "p", "id", F.least("lab", "nl").alias("lab"), (F.col("nl") < F.col("lab")).alias("moved")))
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return state.select("grp", "pos", "p", "id", F.col("lab.id").alias("locus"))


def claim_loci(loci: DataFrame, truth: DataFrame) -> DataFrame:
    """Score loci against causal sets: strongest locus first, each causal claimed once.

    ``loci``: ``id, p, locus``; ``truth``: ``id, causal``. One row with the locus counts.
    """
    l = loci.groupBy("locus").agg(F.min("p").alias("lp"))
    tag = loci.join(truth, "id").select("locus", "causal").distinct().join(l, "locus")
    first = tag.groupBy("causal").agg(F.min(F.struct("lp", "locus")).alias("m")).select(
        F.col("m.locus").alias("locus"))
    mark = (l.join(first.distinct().withColumn("tp", F.lit(1)), "locus", "left")
            .join(tag.select("locus").distinct().withColumn("tagged", F.lit(1)), "locus", "left"))
    n_causal = truth.select("causal").distinct().agg(F.count("*")).scalar()
    n_found = first.agg(F.count("*")).scalar()
    tp, fp = F.count_if(F.col("tp") == 1), F.count_if(F.col("tp").isNull())
    return mark.agg(F.count("*").alias("n_loci"), tp.alias("n_tp_loci"), fp.alias("n_fp_loci"),
                    F.count_if(F.col("tp").isNull() & (F.col("tagged") == 1)).alias("n_duplicate_loci")
                    ).select("*", n_found.alias("n_detected_causal"), n_causal.alias("n_causal"),
                             F.when(n_causal > 0, n_found / n_causal).alias("power"),
                             (F.col("n_fp_loci") / F.greatest(F.col("n_loci"), F.lit(1))).alias("fdp"))


def ld_loci(hits: DataFrame, ld: DataFrame, r2_min: float = 0.5) -> DataFrame:
    """LD clumping of candidate leads: per chromosome, best first, a lead absorbs hits with
    r2 >= r2_min to itself. ``hits``: ``chrom, p, id``; ``ld``: ``a, b, r2``.

    Same rule as :func:`clump` on a graph: rounds settle every hit that beats all its open
    linked hits; the final owner is the best linked lead.
    """
    h = hits.select("id", "chrom", "p")
    links = ld.where(F.col("r2") >= r2_min).select("a", "b", "r2")
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "r2"))
    e = (links.join(h.select(F.col("id").alias("a"), F.col("chrom").alias("ca"),
                             F.struct("p", "id").alias("ka")), "a")
         .join(h.select(F.col("id").alias("b"), F.col("chrom").alias("cb"),
                        F.struct("p", "id").alias("kb")), "b")
         .where((F.col("ca") == F.col("cb")) & (F.col("a") != F.col("b")))
         .groupBy("a", "b", "ka", "kb").agg(F.max("r2").alias("r2")))
    e = cut_lineage(e)
    open_ = cut_lineage(h.select("id"))
    leads = None
    while not open_.isEmpty():
        lower = (e.join(open_.withColumnRenamed("id", "a"), "a").join(open_.withColumnRenamed("id", "b"), "b")
                 .where(F.col("kb") < F.col("ka")).select(F.col("a").alias("id")).distinct())
        new = cut_lineage(open_.join(lower, "id", "left_anti"))
        leads = new if leads is None else leads.unionByName(new)
        gone = new.unionByName(e.join(new.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")))
        open_ = cut_lineage(open_.join(gone.distinct(), "id", "left_anti"))
    if leads is None:
        leads = open_
    own = (e.join(leads.withColumnRenamed("id", "b"), "b").groupBy("a")
           .agg(F.min(F.struct("kb", "r2")).alias("m"))
           .select(F.col("a").alias("id"), F.col("m.kb.id").alias("lead_id"), F.col("m.r2").alias("r2_to_lead")))
    is_lead = leads.withColumn("lead_of_locus", F.lit(True))
    return (h.join(is_lead, "id", "left").join(own, "id", "left").select(
        "id", "chrom", "p", F.coalesce("lead_of_locus", F.lit(False)).alias("lead_of_locus"),
        F.when(F.col("lead_of_locus"), F.col("id")).otherwise(F.col("lead_id")).alias("lead_id"),
        F.when(F.col("lead_of_locus"), 1.0).otherwise(F.col("r2_to_lead")).alias("r2_to_lead")))
