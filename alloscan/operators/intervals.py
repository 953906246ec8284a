"""Range and nearest joins on genome positions.

A BETWEEN predicate alone plans as a nested loop. Here intervals are repeated once
per position bin they touch, a point has exactly one bin, and both meet in an equi
join on (chromosome, bin) followed by the exact test; hot bins are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloscan.operators.scan_order import ordered_scan
from alloscan.operators.skew import hot_join


def points_in_intervals(points: DataFrame, intervals: DataFrame, lo: Column, hi: Column,
                        bin_bp: int = 100_000) -> DataFrame:
    """Inner join: every (point, interval) with ``lo <= pos <= hi`` on one chromosome.

    ``points`` has ``chrom, pos``; ``lo`` and ``hi`` are expressions over ``intervals``,
    whose other columns must not clash with those of ``points``.
    """
    p = points.withColumn("_bin", F.floor(F.col("pos") / bin_bp))
    iv = (intervals.withColumn("_lo", lo.cast("bigint")).withColumn("_hi", hi.cast("bigint"))
          .where(F.col("_lo") <= F.col("_hi"))
          .withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") / bin_bp),
                                                   F.floor(F.col("_hi") / bin_bp)))))
    return (hot_join(p, iv, ["chrom", "_bin"])
            .where((F.col("pos") >= F.col("_lo")) & (F.col("pos") <= F.col("_hi")))
            .drop("_bin", "_lo", "_hi"))


def window_leads(points: DataFrame, windows: DataFrame, key: list[str], center: str, half: str,
                 carry: list[str], counts: dict[str, Column], bin_bp: int = 100_000) -> DataFrame:
    """Per window: lead point (largest chi2, then first position), point counts; empty kept.

    Windows without points keep null lead columns and zero counts.
    """
    w = windows.select(*key, "chrom", center, half)
    hit = points_in_intervals(points, w, F.col(center) - F.col(half), F.col(center) + F.col(half),
                              bin_bp)
    lead = F.max(F.struct("chi2", (-F.col("pos")).alias("_np"), *carry))
    agg = hit.groupBy(*key).agg(lead.alias("_l"), F.count("*").alias("n_in_window"),
                                *[F.count_if(c).alias(o) for o, c in counts.items()])
    out = windows.join(agg, key, "left")
    return out.select(*windows.columns, F.col("_l.chi2").alias("lead_chi2"),
                      *[F.col(f"_l.{c}").alias(f"lead_{c}") for c in carry],
                      *[F.coalesce(F.col(o), F.lit(0)).alias(o) for o in ("n_in_window", *counts)])


def _neighbours(points: DataFrame, refs: DataFrame, at: str, payload: list[str], prefix: str,
                before: bool, strict: bool) -> DataFrame:
    """Closest reference at or before (or after) each point, by an ordered scan of the union."""
    ref = F.struct(F.col("chrom"), F.col("_at"), *payload)
    # at equal positions references sort first when scanning upward, last when downward
    tag = (1 if strict else -1) * (1 if before else -1)
    pt = points.select("chrom", F.col("pos").alias("_at"), F.lit(0).alias("_tag"),
                       F.col("_pid").cast("string").alias("_id"),
                       F.lit(None).cast(_struct_type(refs, at, payload)).alias("_ref"), "_pid")
    rf = (refs.withColumn("_at", F.col(at)).select(
        "chrom", "_at", F.lit(tag).alias("_tag"),
        F.concat_ws("|", *[F.col(c).cast("string") for c in payload]).alias("_id"),
        ref.alias("_ref"), F.lit(None).cast(points.schema["_pid"].dataType).alias("_pid")))
    s = ordered_scan(pt.unionByName(rf), ["chrom", "_at", "_tag", "_id"],
                     {"_near": ("max" if before else "min", "_ref")}, descending=not before)
    same = F.col("_near.chrom") == F.col("chrom")
    return s.where(F.col("_pid").isNotNull()).select(
        "_pid", F.when(same, F.col("_near._at")).alias(f"{prefix}_at"),
        *[F.when(same, F.col(f"_near.{c}")).alias(f"{prefix}_{c}") for c in payload])


def _struct_type(refs: DataFrame, at: str, payload: list[str]):
    return refs.select(F.struct(F.col("chrom"), F.col(at).alias("_at"), *payload).alias("x")
                       ).schema["x"].dataType


def nearest_point(points: DataFrame, refs: DataFrame, pid: str, ord_col: str, name: str) -> DataFrame:
    """Nearest reference per point on its chromosome; equal distances go to the lower ``ord_col``.

    ``refs`` has ``chrom, rpos, ord_col, name``. Adds ``near_name`` and ``near_dist``.
    """
    # one reference per position is enough: the first in order
    refs = (refs.groupBy("chrom", "rpos").agg(F.min(F.struct(ord_col, name)).alias("m"))
            .select("chrom", "rpos", F.col(f"m.{ord_col}").alias("o"), F.col(f"m.{name}").alias("nm")))
    pts = points.select(F.col(pid).alias("_pid"), "chrom", "pos")
    lo = _neighbours(pts, refs, "rpos", ["o", "nm"], "b", True, False)
    hi = _neighbours(pts, refs, "rpos", ["o", "nm"], "a", False, False)
    both = pts.join(lo, "_pid").join(hi, "_pid")
    def cand(s):
        return F.when(F.col(f"{s}_at").isNotNull(),
                      F.struct(F.abs(F.col("pos") - F.col(f"{s}_at")).alias("d"),
                               F.col(f"{s}_o").alias("o"), F.col(f"{s}_nm").alias("nm")))
    near = both.select("_pid", F.least(cand("b"), cand("a")).alias("m"))
    return (points.join(near, points[pid] == near["_pid"], "left").drop("_pid")
            .withColumn("near_name", F.col("m.nm")).withColumn("near_dist", F.col("m.d")).drop("m"))


def nearest_gene(points: DataFrame, genes: DataFrame, pid: str) -> DataFrame:
    """Overlapping gene (first by start) at distance 0, else the closer side; ties go before.

    ``genes`` has ``chrom, gstart, gend, gname``.
    """
    pts = points.select(F.col(pid).alias("_pid"), "chrom", "pos")
    over = (points_in_intervals(pts, genes, F.col("gstart"), F.col("gend"))
            .groupBy("_pid").agg(F.min(F.struct("gstart", "gname")).alias("o")))
    ends = (genes.groupBy("chrom", "gend").agg(F.min(F.struct("gstart", "gname")).alias("m"))
            .select("chrom", "gend", F.col("m.gname").alias("gname")))
    starts = genes.groupBy("chrom", "gstart").agg(F.min("gname").alias("gname"))
    lo = _neighbours(pts, ends, "gend", ["gname"], "b", True, False)
    hi = _neighbours(pts, starts, "gstart", ["gname"], "a", False, False)
    far = F.lit(10 ** 12).cast("bigint")
    db = F.coalesce(F.col("pos") - F.col("b_at"), far)
    da = F.coalesce(F.col("a_at") - F.col("pos"), far)
    hit = F.col("o").isNotNull()
    none = (db == far) & (da == far)
    return (pts.join(lo, "_pid").join(hi, "_pid").join(over, "_pid", "left").select(
        F.col("_pid").alias(pid),
        F.when(hit, F.col("o.gname")).when(none, None).when(db <= da, F.col("b_gname"))
        .otherwise(F.col("a_gname")).alias("nearest_gene"),
        F.when(hit, F.lit(0).cast("bigint")).when(none, None).otherwise(F.least(db, da))
        .alias("nearest_gene_dist")))


def first_gene(points: DataFrame, genes: DataFrame, flank: int, look_back: int = 9) -> DataFrame:
    """At most one gene per point: among the last ``look_back`` genes starting at or before it,
    the latest whose span plus flank contains it. ``genes``: ``chrom, gstart, gend, gname``."""
    idx = ordered_scan(genes, ["chrom", "gstart", "gname"], {"gi": ("count", "")})
    pts = points.withColumn("_pid", F.concat_ws(":", "chrom", F.col("pos").cast("string")))
    at = _neighbours(pts.select("_pid", "chrom", "pos"),
                     idx.select("chrom", (F.col("gstart")).alias("gs"), "gi"), "gs", ["gi"],
                     "l", True, False)
    cand = (pts.join(at, "_pid").where(F.col("l_gi").isNotNull())
            .withColumn("gi", F.explode(F.expr(f"sequence(l_gi - {look_back - 1}, l_gi)"))))
    g = idx.select("gi", F.col("chrom").alias("gchrom"), "gstart", "gend", "gname")
    ok = cand.join(g, "gi").where(
        (F.col("gchrom") == F.col("chrom")) & (F.col("gstart") - flank <= F.col("pos"))
        & (F.col("gend") + flank >= F.col("pos")))
    return ok.groupBy("chrom", "pos").agg(F.max_by("gname", "gi").alias("gname"))


def spaced_picks(hits: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """Up to ``k`` evenly spaced rows per group: every ``max(1, n // k)``-th in order."""
    n = hits.groupBy(*group).agg(F.count("*").alias("_n"))
    pos = ordered_scan(hits, [*group, *order], {"_g": ("count", "")})
    first = pos.groupBy(*group).agg(F.min("_g").alias("_f"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    i = F.col("_g") - F.col("_f")
    return (pos.join(n, group).join(first, group)
            .where((i % step == 0) & (F.floor(i / step) < k)).drop("_n", "_g", "_f"))
