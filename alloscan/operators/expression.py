"""Expression balance among homolog copies, k-mer uniqueness, matched enrichment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from alloscan.functions import stat_columns as sc
from alloscan.operators import ranking as rk
from alloscan.operators import scan_order as so
from alloscan.session import cut_lineage, shuffle_width

# fixed values: ideal expression shares (A, B, D) of the seven balance categories
IDEALS = {
    "balanced": (1 / 3, 1 / 3, 1 / 3),
    "A.dominant": (1.0, 0.0, 0.0),
    "B.dominant": (0.0, 1.0, 0.0),
    "D.dominant": (0.0, 0.0, 1.0),
    "A.suppressed": (0.0, 0.5, 0.5),
    "B.suppressed": (0.5, 0.0, 0.5),
    "D.suppressed": (0.5, 0.5, 0.0),
}


def triad_balance(df: DataFrame, a: str = "a", b: str = "b", d: str = "d") -> DataFrame:
    """Shares, distance to the centre and nearest ideal category; silent triads stay null."""
    tot = F.col(a) + F.col(b) + F.col(d)
    live = tot > 1e-9
    t = df.withColumn("total", tot)
    for name, c in (("fa", a), ("fb", b), ("fd", d)):
        t = t.withColumn(name, F.when(live, F.col(c) / tot))

    def dist(ideal):
        return F.sqrt(sum(((F.col(f) - x) * (F.col(f) - x) for f, x in zip(("fb", "fd"), ideal[1:])), (F.col("fa") - ideal[0]) * (F.col("fa") - ideal[0])))
    near = F.array_min(F.array(*[F.struct(dist(v).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(IDEALS.items())]))
    return (t.withColumn("dist", F.when(live, dist(IDEALS["balanced"])))
            .withColumn("category", F.when(live, near["k"])))


def strict_percentile(df: DataFrame, x: str, out: str) -> DataFrame:
    """Share of the background strictly below each value."""
    n = df.where(F.col(x).isNotNull()).agg(F.count("*")).scalar()
    r = rk.average_rank(df, x)
    return r.withColumn(out, (F.col("rank_min") - 1) / n).drop("n_tie", "rank_min", "rank_max", "rank_avg")


def study_balanced(expr: DataFrame, unit: list[str], copies: list[str], floor: float, min_samples: int) -> DataFrame:
    """Mean per study over expressed samples, then the equal-weight mean over studies.

    ``expr``: ``unit..., study`` and one column per copy; a sample counts when all copies are
    present and their total reaches ``floor``; a study counts from ``min_samples`` samples.
    """
    tot = sum((F.col(c) for c in copies[1:]), F.col(copies[0]))
    ok = expr.where(tot >= floor)
    st = ok.groupBy(*unit, "study").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in copies]).where(F.col("n") >= min_samples)
    return st.groupBy(*unit).agg(F.count("*").alias("n_studies"), *[F.avg(c).alias(c) for c in copies])


def copy_bias(df: DataFrame, copies: list[str], fair: float, limit: float, floor: float = 1.0) -> DataFrame:
    """Copy shares, largest deviation from the fair share, and the verdict; silent rows skipped."""
    tot = sum((F.col(c) for c in copies[1:]), F.col(copies[0]))
    d = df.where(tot >= floor).withColumn("max_dev", F.greatest(*[F.abs(F.col(c) / tot - fair) for c in copies]))
    return d.select(*df.columns, *[(F.col(c) / tot).alias(f"share_{c}") for c in copies], "max_dev",
                    F.when(F.col("max_dev") > limit, "biased").otherwise("fair").alias("verdict"))


def population_bias(expr: DataFrame, base: DataFrame, unit: str, copies: list[str], min_total: float = 1.0, min_n: int = 30) -> DataFrame:
    """Share minus baseline share per copy over genotypes: mean, sd, dominant copy, sign consistency, t.

    ``expr``: ``unit`` and copy columns per genotype; ``base``: ``unit`` and ``base_<copy>``.
    """
    tot = sum((F.col(c) for c in copies[1:]), F.col(copies[0]))
    e = expr.where(tot >= min_total).join(base, unit)
    e = e.select(unit, *[(F.col(c) / tot - F.col(f"base_{c}")).alias(c) for c in copies])
    g = e.groupBy(unit).agg(F.count("*").alias("n"), *[x for c in copies for x in (
        F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"), F.count_if(F.col(c) > 0).alias(f"p_{c}"), F.count_if(F.col(c) < 0).alias(f"q_{c}"))])
    dom = F.array_max(F.array(*[F.struct(F.round(F.abs(F.col(f"m_{c}")), 12).alias("eff"), F.lit(-i).alias("o"), F.lit(c).alias("copy"), F.col(f"m_{c}").alias("m"), F.col(f"s_{c}").alias("s"),
                                         F.when(F.col(f"m_{c}") > 0, F.col(f"p_{c}")).when(F.col(f"m_{c}") < 0, F.col(f"q_{c}")).otherwise(F.lit(0)).alias("same"))
                                for i, c in enumerate(copies)]))
    g = g.where(F.col("n") >= min_n).withColumn("dm", dom)
    sd1 = F.col("dm.s") * F.sqrt(F.col("n") / (F.col("n") - 1))
    return g.select(unit, "n", F.col("dm.copy").alias("dominant"), F.col("dm.m").alias("mean_dev"), F.col("dm.eff").alias("effect"), F.col("dm.s").alias("sd"),
                    (F.col("dm.same") / F.col("n")).alias("sign_consistency"),
                    F.when(sd1 > 0, F.col("dm.m") / (sd1 / F.sqrt("n"))).alias("t"))


def classify_bias(df: DataFrame) -> DataFrame:
    """BH over the dominant-copy tests, then conserved / variable / balanced."""
    t = df.withColumn("p_t", sc.student_p("t", (F.col("n") - 1).cast("double")))
    q = rk.bh(t, "p_t", "q_dom")
    return q.withColumn("class", F.when((F.col("effect") < 0.10) | (F.coalesce("q_dom", F.lit(1.0)) >= 0.05), "balanced")
                        .when(F.col("sign_consistency") >= 0.70, "conserved_HEB")
                        .when(F.col("sd") >= 0.10, "variable_HEB").otherwise("balanced"))


#: Letters of a group that one task holds at most (a larger group is dealt in parts), letters of a row, and length of the words that deal a group.
KMER_PART, KMER_ROW, KMER_WORD = 1 << 20, 1 << 16, 11


def kmer_runs(seq: str, k: int, parts: int) -> list[tuple[int, str]]:
    """(part, piece of ``seq``) so that every k-mer lies in one piece, and equal k-mers have equal parts.

    A k-mer's part comes from the least hash of its words, so neighbours mostly share it and go as one piece.
    """
    if parts == 1 or len(seq) <= k:
        return [(0, seq)]
    x = np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    m, h = min(k, KMER_WORD), np.zeros(1, np.uint64)
    for i in range(m):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[i:len(x) - m + 1 + i]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = h[:len(x) - k + 1].copy()
    for i in range(1, k - m + 1):
        np.minimum(least, h[i:i + len(least)], out=least)
    part = (least % np.uint64(parts)).astype(np.int64)
    starts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    return [(int(part[i]), seq[i:j + k - 1]) for i, j in zip(starts[:-1], starts[1:])]


def unique_kmers(seqs: DataFrame, k: int) -> DataFrame:
    """Distinct k-mers per copy and the share found in no other copy: ``grp, cp, seq`` in.

    Only text is shuffled, about once, and k-mers are made behind the shuffle: a small group meets whole, a group of
    more than KMER_PART letters in parts that each hold all copies of their k-mers. A task holds one part at a time.
    """
    s = seqs.where(F.length("seq") >= k)
    large = s.groupBy(F.col("grp").alias("_g")).agg(F.sum(F.length("seq").cast("bigint")).alias("_n")).where(F.col("_n") > KMER_PART)
    # at most one row for KMER_PART letters of the input
    s = s.join(F.broadcast(large.select("_g", F.ceil(F.col("_n") / KMER_PART).cast("int").alias("_parts"))), F.col("grp").eqNullSafe(F.col("_g")), "left")
    s = s.select("grp", "cp", F.coalesce("_parts", F.lit(1)).alias("_parts"), "seq", F.explode(
        F.sequence(F.lit(1), F.length("seq") - (k - 1), F.lit(KMER_ROW))).alias("_s"))
    s = s.select("grp", "cp", "_parts", F.substring("seq", F.col("_s"), F.lit(KMER_ROW + k - 1)).alias("seq"))
    kinds = pa.schema([(c, to_arrow_type(s.schema[c].dataType)) for c in ("grp", "cp")])

    def deal(batches):
        for batch in batches:
            at, part, piece = [], [], []
            for i, (seq, parts) in enumerate(zip(batch["seq"].to_pylist(), batch["_parts"].to_pylist())):
                for p, x in dict.fromkeys(kmer_runs(seq, k, parts)):
                    at.append(i)
                    part.append(p)
                    piece.append(x)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["grp"].take(rows), batch["cp"].take(rows), pa.array(part, pa.int32()), pa.array(piece, pa.string())],
                                             names=["grp", "cp", "part", "piece"])

    def count(batches):
        held, own = None, {}

        def done():
            seen, again = set(), set()
            for x in own.values():
                again |= seen & x
                seen |= x
            cps = list(own)
            return pa.RecordBatch.from_arrays([
                pa.array([held[0]] * len(cps), kinds.field("grp").type), pa.array(cps, kinds.field("cp").type), pa.array([len(own[c]) for c in cps], pa.int64()),
                pa.array([0 if held[0] is None or c is None else len(own[c] - again) for c in cps], pa.int64())], names=["grp", "cp", "n", "u"])
        for batch in batches:
            for g, c, p, piece in zip(*(batch[x].to_pylist() for x in ("grp", "cp", "part", "piece"))):
                if (g, p) != held:
                    if own:
                        yield done()
                    held, own = (g, p), {}
                own.setdefault(c, set()).update([piece[i:i + k] for i in range(len(piece) - k + 1)])
        if own:
            yield done()
    keys = ", ".join(f"{c} {s.schema[c].dataType.simpleString()}" for c in ("grp", "cp"))
    dealt = s.mapInArrow(deal, f"{keys}, part int, piece string").repartition("grp", "part").sortWithinPartitions("grp", "part")
    found = dealt.mapInArrow(count, f"{keys}, n bigint, u bigint").groupBy("grp", "cp").agg(F.sum("n").alias("n_kmers"), F.sum("u").alias("u"))
    return found.select("grp", F.col("cp").cast("bigint").alias("cp"), "n_kmers", (F.col("u") / F.col("n_kmers")).alias("unique_fraction"))


def mappability_tier(mean_fraction: Column, high: float = 0.5, medium: float = 0.2) -> Column:
    return F.when(mean_fraction >= high, "high").when(mean_fraction >= medium, "medium").otherwise("low")


#: Standard deviations around the expected place of a draw's last key within which keys are ordered.
SPREAD = 6.0
#: Replicates that a row of the pool meets in one task.
BLOCK = 100


def stratum_enrichment(df: DataFrame, n_perm: int = 10_000, seed: int = 7) -> DataFrame:
    """Mean percentile of the tier (``top`` rows) against draws of other rows with the same strata.

    ``df``: ``id, stratum, pct, top``. In replicate r every row outside the tier gets a hash key; per
    stratum as many rows with the smallest keys as the tier has there are drawn. The k-th smallest of n hashes
    lies near k / n: keys well below are drawn and summed where they are made, keys well above are not, and only
    the few between, about 2 * SPREAD * sqrt(k), are ordered. A (replicate, stratum) whose k-th key lies elsewhere
    is ordered whole. If some stratum has fewer other rows than it needs, there is no null: ``infeasible``
    is true, the rest null.
    """
    from pyspark.sql import Window
    sizes = cut_lineage(df.groupBy("stratum").agg(F.count_if(F.col("top")).alias("k"), F.count_if(~F.col("top")).alias("free")).where("k > 0"))
    obs = df.where(F.col("top")).agg(F.avg("pct").alias("obs"), F.count("*").alias("n_top"))
    short = sizes.agg(F.coalesce(F.bool_or(F.col("free") < F.col("k")), F.lit(False))).scalar()
    # borders as hashes: a share x of all hashes lies below (2 x - 1) * 2^63
    slack = SPREAD * F.sqrt("k") + SPREAD
    border = lambda n: ((2 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), n / F.col("free"))) - 1) * F.lit(2.0 ** 63)).cast("double")
    pool = df.where(~F.col("top")).join(sizes, "stratum").select(
        "stratum", "id", "pct", "k", border(F.col("k") - slack).alias("lo"), border(F.col("k") + slack).alias("hi"))
    # a row goes once to every block of replicates; replicates are made, cut and folded behind that shuffle
    blocks = -(-n_perm // BLOCK)
    pool = pool.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pool = pool.repartition(max(blocks, shuffle_width(df.sparkSession)), "stratum", "block")
    draws = pool.withColumn("rep", F.explode(F.sequence(F.col("block") * BLOCK + 1, F.least(F.col("block") * BLOCK + BLOCK, F.lit(n_perm)))))
    draws = draws.withColumn("h", F.xxhash64(F.lit(seed), "rep", "id"))
    below, between = F.col("h") < F.col("lo"), (F.col("h") >= F.col("lo")) & (F.col("h") <= F.col("hi"))
    cell = ["rep", "stratum"]
    near = F.when(between, F.struct("h", "id", "pct"))
    # rows well below fold to sums; a cell's list is bounded by its slack
    got = draws.where(below | between).groupBy("stratum", "block", "rep").agg(
        F.first("k").alias("k"), F.count_if(below).alias("n0"), F.count_if(below & F.col("pct").isNotNull()).alias("c0"),
        F.sum(F.when(below, F.col("pct"))).alias("s0"), F.sort_array(F.collect_list(near)).alias("near"))
    got = got.withColumn("rest", F.col("k") - F.col("n0"))
    inside = (F.col("rest") >= 0) & (F.col("rest") <= F.size("near"))
    picked = F.transform(F.slice("near", 1, F.greatest(F.col("rest"), F.lit(0)).cast("int")), lambda x: x["pct"])
    some = F.filter(picked, lambda x: x.isNotNull())
    got = cut_lineage(got.select(*cell, inside.alias("inside"), (F.col("c0") + F.size(some)).alias("c"),
                                 (F.coalesce("s0", F.lit(0.0)) + F.aggregate(some, F.lit(0.0), lambda x, y: x + y)).alias("s")))
    every = df.sparkSession.range(1, n_perm + 1).select(F.col("id").cast("int").alias("rep")).join(F.broadcast(sizes.select("stratum", "free")))
    missed = cut_lineage(every.join(got.where("inside").select(*cell), cell, "left_anti").where("free > 0"))
    whole = draws.join(missed.select(*cell), cell).withColumn("_r", F.row_number().over(Window.partitionBy(*cell).orderBy("h", "id"))).where("_r <= k")
    sums = got.where("inside").select("rep", "c", "s")
    if not missed.isEmpty():
        sums = sums.unionByName(whole.select("rep", F.when(F.col("pct").isNotNull(), 1).otherwise(0).cast("bigint").alias("c"), F.coalesce("pct", F.lit(0.0)).alias("s")))
    draw = cut_lineage(sums.groupBy("rep").agg(F.try_divide(F.sum("s"), F.sum("c")).alias("m")))
    o = obs.select("obs").scalar()
    mid = draw.agg(F.avg("m")).scalar()
    draw = draw.withColumn("far", F.abs(F.col("m") - mid) >= F.abs(o - mid))
    a = draw.agg(F.avg("m").alias("null_mean"), F.stddev_samp("m").alias("null_sd"), F.count("*").alias("n_perm"),
                 ((1 + F.count_if("far")) / (F.count("*") + 1)).alias("p_two_sided"))
    fits = lambda c: F.when(~short, F.col(c)).alias(c)
    return a.select(o.alias("observed"), obs.select("n_top").scalar().alias("n_top"), short.alias("infeasible"), fits("null_mean"), fits("null_sd"),
                    "n_perm", fits("p_two_sided"))


def matched_controls(df: DataFrame, covariates: dict[str, int], target: str, caliper: float, pool_min: int) -> DataFrame:
    """Per target row, size and mean of its matched background.

    Strata are exact quantile bins of the covariates. The pool of a target is its stratum when
    that holds ``pool_min`` rows, else all rows, and within it rows whose first covariate lies
    inside the caliper (in sd). Sums over a caliper come from running sums at its two ends, so
    no target is paired with its whole pool.
    """
    names = list(covariates)
    t = df
    for c, k in covariates.items():
        n = t.agg(F.count("*")).scalar()
        t = cut_lineage(so.attach_by_value(t, so.value_ranks(t, c), c))
        t = t.withColumn(f"_b_{c}", F.least(F.lit(k - 1), F.floor((F.col("rank_avg") - 0.5) / n * k))).drop(
            "n_tie", "rank_min", "rank_max", "rank_avg")
    t = t.withColumn("stratum", F.concat_ws("|", *[F.col(f"_b_{c}").cast("string") for c in names]))
    size = t.groupBy("stratum").agg(F.count("*").alias("_n"))
    x = names[0]
    sd = df.agg(F.stddev_pop(x)).scalar()
    t = cut_lineage(t.join(size, "stratum").withColumn("_w", caliper * sd))
    pts = t.select(F.col("stratum").alias("pool"), F.col(x).alias("_x"), F.lit(0).alias("_k"), F.col("id").alias("_id"), F.col("pct").alias("_y"), F.lit(1).alias("_c")).unionByName(
        t.select(F.lit("all").alias("pool"), F.col(x).alias("_x"), F.lit(0).alias("_k"), F.col("id").alias("_id"), F.col("pct").alias("_y"), F.lit(1).alias("_c")))
    tg = t.where(F.col(target)).withColumn("pool", F.when(F.col("_n") >= pool_min, F.col("stratum")).otherwise("all"))
    lo = tg.select("pool", (F.col(x) - F.col("_w")).alias("_x"), F.lit(-1).alias("_k"), F.col("id").alias("_id"), F.lit(0.0).alias("_y"), F.lit(0).alias("_c"))
    hi = tg.select("pool", (F.col(x) + F.col("_w")).alias("_x"), F.lit(1).alias("_k"), F.col("id").alias("_id"), F.lit(0.0).alias("_y"), F.lit(0).alias("_c"))
    s = so.ordered_scan(pts.unionByName(lo).unionByName(hi), ["pool", "_x", "_k", "_id"], {"cn": ("sum", "_c"), "cy": ("sum", "_y")})
    s = cut_lineage(s)
    end = s.where(F.col("_k") == 1).select("_id", F.col("cn").alias("n1"), F.col("cy").alias("y1"))
    beg = s.where(F.col("_k") == -1).select("_id", F.col("cn").alias("n0"), F.col("cy").alias("y0"))
    m = end.join(beg, "_id")
    return tg.join(m, tg["id"] == m["_id"]).select("id", "pool", (F.col("n1") - F.col("n0")).alias("n_matched"),
                                                   F.try_divide(F.col("y1") - F.col("y0"), F.col("n1") - F.col("n0")).alias("matched_mean"), "pct")


def caliper_controls(df: DataFrame, covariates: dict[str, int], target: str, caliper: float, pool_min: int) -> DataFrame:
    """Per target row, number, mean and spread of its controls, and its place among them.

    ``df``: ``id, pct, target`` and the covariates. Those with a number of bins make strata of quantile
    bins. A target's pool is its stratum, if that holds ``pool_min`` other rows outside the target set, else
    all such rows; of the pool, its controls are the rows within ``caliper`` standard deviations of it in every covariate.

    Cells of a grid as wide as the caliper, over the first three covariates, bring targets and pool together: a
    target looks into the 27 cells around its own, the pool is grouped by its covariates first, and the other
    covariates are tested in the join, so only rows that match are summed and none of them is sent on.
    """
    names = list(covariates)
    t = df
    for c, k in covariates.items():
        if k:
            n = t.agg(F.count("*")).scalar()
            t = cut_lineage(so.attach_by_value(t, so.value_ranks(t, c), c))
            t = t.withColumn(f"_b_{c}", F.least(F.lit(k - 1), F.floor((F.col("rank_avg") - 0.5) / n * k))).drop("n_tie", "rank_min", "rank_max", "rank_avg")
    stratum = F.concat_ws("|", *[F.col(f"_b_{c}").cast("string") for c, k in covariates.items() if k])
    scales = t.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in names]).first()  # two numbers per covariate
    z = [((F.col(c) - F.lit(scales[c][0])) / F.lit(scales[c][1] if scales[c][1] > 1e-12 else 1.0)).alias(f"_z{i}") for i, c in enumerate(names)]
    t = t.select("id", "pct", F.col(target).alias("_t"), stratum.alias("_s"), *z)
    keys = [F.floor(F.col(f"_z{i}") / caliper).cast("bigint").alias(f"_c{i}") for i in range(min(3, len(names)))]
    cells, zs = [f"_c{i}" for i in range(len(keys))], [f"_z{i}" for i in range(len(names))]
    t = cut_lineage(t.select("*", *keys))
    free = t.where(~F.col("_t"))
    size = free.groupBy("_s").agg(F.count("*").alias("_n"))
    aim = t.where("_t").join(size, "_s", "left").withColumn("pool", F.when(F.col("_n") >= pool_min, F.col("_s")).otherwise("all"))
    probe = aim.select("id", F.col("pct").alias("own"), "pool", *[F.col(x).alias(f"{x}t") for x in zs], *cells)
    for c in cells:
        probe = probe.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    pool = free.withColumn("pool", F.explode(F.array(F.col("_s"), F.lit("all"))))
    pool = pool.groupBy("pool", *cells, *zs, "pct").agg(F.count("*").alias("w"))
    near = [F.abs(F.col(x) - F.col(f"{x}t")) <= caliper for x in zs]
    test = near[0]
    for x in near[1:]:
        test = test & x
    same = F.col("p.pool") == F.col("q.pool")
    for c in cells:
        same = same & (F.col(f"p.{c}") == F.col(f"q.{c}"))
    hit = probe.alias("p").join(pool.alias("q"), same & test)
    w, y = F.col("w"), F.col("q.pct")
    s = hit.groupBy("id").agg(F.sum(w).alias("n"), F.sum(w * y).alias("s1"), F.sum(w * y * y).alias("s2"),
                              F.sum(F.when(y >= F.col("own"), w).otherwise(0)).alias("above"))
    n = F.col("n")
    return aim.join(s, "id", "left").select(
        "id", (F.col("pool") != "all").alias("in_stratum"), F.coalesce("n", F.lit(0)).alias("n_matched"), (F.col("s1") / n).alias("matched_mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / n - F.pow(F.col("s1") / n, F.lit(2)))).alias("matched_sd"),
        ((F.col("above") + 1) / (n + 1)).alias("p_above"), "pct")
