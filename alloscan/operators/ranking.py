"""Ranks, multiplicity adjustment and curve columns over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloscan.functions.stat_columns import grouped_median
from alloscan.operators import scan_order as so
from alloscan.session import cut_lineage


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def rank_with_ties(df: DataFrame, p: str, key: list[str]) -> DataFrame:
    """0-based stable position by (p, key) and the position of the first row with equal p."""
    pos = cut_lineage(so.row_position(df, [p, *key], "rank0"))
    ties = pos.groupBy(p).agg(F.min("rank0").alias("tie_group"), F.count("*").alias("n_tie"))
    return so.attach_by_value(pos, ties, p)


def average_rank(df: DataFrame, x: str) -> DataFrame:
    df = cut_lineage(df)  # read by the ranks and by the join back
    return so.attach_by_value(df, so.value_ranks(df, x), x)


def decile(df: DataFrame, x: str, out: str = "decile") -> DataFrame:
    """floor((average rank - 0.5) / n * 10) within 0..9; ties share a decile."""
    r = average_rank(df, x)
    n = r.agg(F.count(x)).scalar()
    d = F.floor((F.col("rank_avg") - 0.5) / n * 10)
    return r.withColumn(out, F.greatest(F.lit(0), F.least(F.lit(9), d)).cast("bigint"))


def bh(df: DataFrame, p: str, out: str = "q") -> DataFrame:
    """Step-up q values over the finite p; others keep null."""
    t = cut_lineage(df.withColumn("_p", F.when(finite(p), F.col(p))))
    ranks = cut_lineage(so.value_ranks(t, "_p"))
    m = ranks.agg(F.sum("n_tie")).scalar()
    raw = ranks.withColumn("_raw", F.col("_p") * m / F.col("rank_max"))
    q = so.ordered_scan(raw, ["_p"], {out: ("min", "_raw")}, descending=True)
    q = q.select("_p", "n_tie", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(out))).alias(out))
    return so.attach_by_value(t, q, "_p").drop("_p", "n_tie")


def holm(df: DataFrame, p: str, out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p: running maximum of (m - rank + 1) p, capped at 1."""
    df = cut_lineage(df)
    ranks = cut_lineage(so.value_ranks(df, p))
    m = ranks.agg(F.sum("n_tie")).scalar()
    raw = ranks.withColumn("_raw", F.least(F.lit(1.0), (m - F.col("rank_min") + 1) * F.col(p)))
    adj = so.ordered_scan(raw, [p], {out: ("max", "_raw")}).select(p, "n_tie", out)
    return so.attach_by_value(df, adj, p).drop("n_tie")


def bonferroni(df: DataFrame, p: str, w: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Flag p < alpha / G, or p < alpha * w / G with mean-one weights (p / w reported)."""
    g = df.agg(F.count("*")).scalar()
    limit = F.lit(alpha) / g
    out = df.withColumn("alpha_bonf", limit)
    if w is None:
        return out.withColumn("sig", F.col(p) < limit)
    return (out.withColumn("p_weighted", F.col(p) / F.col(w))
            .withColumn("sig", F.col(p) < limit * F.col(w)))


def unit_mean_weights(df: DataFrame, w: str, out: str) -> DataFrame:
    """Missing, non-finite or non-positive weights become 1, then the mean is scaled to 1."""
    c = F.when(finite(w) & (F.col(w) > 0), F.col(w)).otherwise(1.0)
    t = df.withColumn("_w", c)
    mean = t.agg(F.avg("_w")).scalar()
    return t.withColumn(out, F.col("_w") / mean).drop("_w")


def qq_expected(df: DataFrame, p: str, key: list[str], keep_p: float, n_true: Column | None = None) -> DataFrame:
    """Expected -log10 p. The tail (p <= keep_p) has exact ranks; thinned bulk rows stand at
    the midpoints of equal shares of the remaining true ranks."""
    pos = so.row_position(df, [p, *key], "i0")
    # both numbers come from the ordered pass, which is stored
    c = pos.agg(F.count("*").alias("m"), F.count_if(F.col(p) <= keep_p).alias("tail"))
    m, tail = c.select("m").scalar(), c.select("tail").scalar()
    n = m if n_true is None else F.greatest(n_true, m)
    i = F.col("i0") + 1
    rank = F.when((i <= tail) | (n == m), i.cast("double")).otherwise(
        tail + (n - tail) * (i - tail - 0.5) / (m - tail))
    return (pos.withColumn("qq_rank", rank)
            .withColumn("expected", -F.log10((F.col("qq_rank") - 0.5) / n)).drop("i0"))


def genome_layout(df: DataFrame) -> DataFrame:
    """Cumulative x by chromosome span plus a gap of max(1 %, 1), chromosomes in name order.

    The per-chromosome table is bounded by the karyotype, so its window is too.
    """
    from pyspark.sql import Window
    ch = df.groupBy("chrom").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1)).cast("double")
    step = span + F.greatest(span * 0.01, F.lit(1.0))
    w = Window.orderBy("chrom")
    before = F.coalesce(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ch = ch.withColumn("span", span).withColumn("step", step)
    ch = ch.select("chrom", "lo", before.alias("offset"), (before + F.col("span") / 2).alias("center"),
                   (F.row_number().over(w) - 1).cast("bigint").alias("chrom_index"))
    return (df.join(F.broadcast(ch), "chrom")
            .withColumn("x", F.col("offset") + F.col("pos") - F.col("lo")).drop("lo", "offset"))


def panel_labels(df: DataFrame, panel: str, key: list[str], n: int, level: float, share: float = 0.02) -> DataFrame:
    """``panel, x, p, *key`` of the labels of each panel: of its ``n`` smallest p, those up to ``level`` that keep ``share``
    of the panel's width away from every label with a smaller p. Ties go by chromosome, position and ``key``.

    ``x`` is laid out within the panel. ``n`` labels are the most a panel can have, so the choice is a fold over n points.
    """
    from pyspark.sql import Window

    from alloscan.operators import scan_order as so
    ch = df.groupBy(panel, "chrom").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1)).cast("double")
    w = Window.partitionBy(panel).orderBy("chrom")
    before = F.coalesce(F.sum(span + F.greatest(span * 0.01, F.lit(1.0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ch = ch.withColumn("offset", before)
    gap = F.max(F.col("offset") + F.col("hi") - F.col("lo")).over(Window.partitionBy(panel))
    ch = ch.select(panel, "chrom", "lo", "offset", ((gap + 1) * share).alias("gap"))
    best = so.top_k(df.where(F.col("p") <= level).select(panel, "chrom", "pos", "p", *key), [panel], [F.col(c) for c in ("p", "chrom", "pos", *key)], n)
    best = best.join(F.broadcast(ch), [panel, "chrom"]).withColumn("x", F.col("offset") + F.col("pos") - F.col("lo"))
    point = F.struct("rnk", "x", "p", "chrom", "pos", *key)
    lists = best.groupBy(panel).agg(F.sort_array(F.collect_list(point)).alias("points"), F.first("gap").alias("gap"))
    none = F.slice("points", 1, 0)
    kept = F.aggregate("points", none, lambda acc, q: F.when(F.exists(acc, lambda o: F.abs(o["x"] - q["x"]) < F.col("gap")), acc)
                       .otherwise(F.concat(acc, F.array(q))))
    return lists.select(panel, F.explode(kept).alias("q")).select(panel, "q.*").drop("rnk")


def robust_z(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """(x - median) / (1.4826 MAD) for each ``x -> output``; MAD = 0 falls back to the sd;
    under 2 values gives null. All columns share the passes; only their few medians, spreads
    and counts reach the driver."""
    def long(shift):
        cells = [F.struct(F.lit(c).alias("c"), F.when(finite(c), F.abs(F.col(c) - shift[c]) if shift else F.col(c)
                                                      ).cast("double").alias("x")) for c in cols]
        return df.select(F.explode(F.array(*cells)).alias("s")).select("s.c", "s.x").where(F.col("x").isNotNull())
    df = cut_lineage(df)
    med = {x["c"]: (x["n"], x["median"]) for x in grouped_median(long(None), ["c"], "x").collect()}
    mad = {x["c"]: x["median"] for x in grouped_median(long({c: med.get(c, (0, 0.0))[1] for c in cols}), ["c"], "x").collect()}
    out = df
    for c, o in cols.items():
        n, m = med.get(c, (0, 0.0))
        scale = 1.4826 * mad.get(c, 0.0)
        if n >= 2 and scale <= 0:
            scale = df.where(finite(c)).agg(F.stddev_pop(c)).first()[0] or 1.0
        out = out.withColumn(o, F.when(finite(c), (F.col(c) - m) / scale) if n >= 2 else F.lit(None).cast("double"))
    return out


def chrom_runs(df: DataFrame, order: list[str]) -> DataFrame:
    """Run-length split of the chromosome column in file order: start and end (exclusive)."""
    s = so.row_position(df.select(*dict.fromkeys([*order, "chrom"])), order, "i")
    prev = s.select((F.col("i") + 1).alias("i"), F.col("chrom").alias("pc"))
    s = s.join(prev, "i", "left").withColumn(
        "new", F.when(F.col("pc") == F.col("chrom"), 0).otherwise(1))
    s = so.ordered_scan(s.select("i", "chrom", "new"), ["i"], {"run": ("sum", "new")})
    return s.groupBy("run", "chrom").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"))


def power_curve(df: DataFrame, p: str, is_true: str, key: list[str]) -> DataFrame:
    """Power and false share among calls when calling every row up to each p threshold."""
    df = cut_lineage(df.select(p, is_true))
    n_true = df.agg(F.count_if(F.col(is_true))).scalar()
    c = df.groupBy(p).agg(F.count("*").alias("n"), F.count_if(F.col(is_true)).alias("t"))
    s = so.ordered_scan(c, [p], {"called": ("sum", "n"), "hits": ("sum", "t")})
    return s.select(p, "called", "hits", (F.col("hits") / n_true).alias("power"),
                    ((F.col("called") - F.col("hits")) / F.col("called")).alias("fdr"))


def power_envelope(curve: DataFrame) -> DataFrame:
    """Best power reachable at or below each false-discovery rate."""
    pts = curve.groupBy("fdr").agg(F.max("power").alias("power"))
    return so.ordered_scan(pts, ["fdr"], {"envelope": ("max", "power")})


def partial_auc(curve: DataFrame, cap: float = 0.1, points: int = 101) -> DataFrame:
    """Trapezoid area of the envelope on [0, cap] over ``points`` grid values, divided by cap.

    The grid is a fixed ``points``-row table. Each grid value takes the last curve point at
    or below it and the first above (the origin (0, 0) precedes all), then interpolates.
    """
    env = power_envelope(curve).groupBy("fdr").agg(F.max("envelope").alias("e"))
    last = env.agg(F.max_by("e", "fdr").alias("e"), F.max("fdr").alias("f"))
    h = cap / (points - 1)
    # curve points between two grid values only matter through their first and last
    cell = F.when(F.col("fdr") >= cap, F.lit(points - 1)).otherwise(F.floor(F.col("fdr") / h))
    cells = env.withColumn("cell", cell.cast("int")).groupBy("cell").agg(
        F.min(F.struct("fdr", "e")).alias("first"), F.max(F.struct("fdr", "e")).alias("last"))
    from pyspark.sql import Window
    grid = df_range(curve, points).join(F.broadcast(cells), "cell", "left")
    w = Window.orderBy("cell")  # the grid has a fixed number of rows
    x = F.col("cell") * h
    below = F.coalesce(
        F.when(F.col("first.fdr") <= x, F.col("first")),
        F.last(F.col("last"), True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        F.struct(F.lit(0.0).alias("fdr"), F.lit(0.0).alias("e")))
    above = F.coalesce(F.when(F.col("first.fdr") > x, F.col("first")),
                       F.first(F.col("first"), True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    g = grid.select("cell", x.alias("x"), below.alias("b"), above.alias("a"))
    end = last.select("e").scalar()
    fend = last.select("f").scalar()
    val = F.when(F.col("x") >= fend, end).when(F.abs(F.col("b.fdr") - F.col("x")) <= 1e-12, F.col("b.e")).otherwise(
        F.col("b.e") + (F.col("x") - F.col("b.fdr")) * (F.col("a.e") - F.col("b.e"))
        / (F.col("a.fdr") - F.col("b.fdr")))
    edge = F.when((F.col("cell") == 0) | (F.col("cell") == points - 1), 0.5).otherwise(1.0)
    return g.agg((F.sum(F.coalesce(val, F.lit(0.0)) * edge) * h / cap).alias("pauc"))


def df_range(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("cell"))


def power_at_fdr(curve: DataFrame, target: float) -> DataFrame:
    return curve.agg(F.coalesce(F.max(F.when(F.col("fdr") <= target, F.col("power"))), F.lit(0.0))
                     .alias("power_at_fdr"))
