"""Genotype tables: allele statistics, quality filters, standardisation, LD, burdens.

Tall form: one row per observed call ``(s, v, d)``; a missing call has no row.
Replacing a missing call by the marker mean leaves the mean as it is and adds
nothing to centred sums, so every statistic below is a sum over observed calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allele_stats(geno: DataFrame, n_panel: Column | int) -> DataFrame:
    """Per marker: n_obs, sums, mean, af, maf, call_rate, variance after mean fill."""
    n = n_panel if isinstance(n_panel, Column) else F.lit(n_panel)
    sums = geno.groupBy("v").agg(F.count("d").alias("n_obs"), F.sum("d").alias("sum_d"),
                                 F.sum(F.col("d") * F.col("d")).alias("sum_dd"))
    mean = F.col("sum_d") / F.col("n_obs")
    af = mean / 2
    return sums.select(
        "v", "n_obs", "sum_d", "sum_dd", mean.alias("mean"), af.alias("af"),
        F.least(af, 1 - af).alias("maf"), (F.col("n_obs") / n).alias("call_rate"),
        ((F.col("sum_dd") - F.col("sum_d") * mean) / n).alias("var"),
        # exact integer test of zero variance
        (F.col("n_obs") * F.col("sum_dd") == F.col("sum_d") * F.col("sum_d")).alias("is_flat"))


def keep_rule(maf_min: float, call_rate_min: float) -> Column:
    return ((F.col("n_obs") > 0) & (F.col("call_rate") >= call_rate_min)
            & (F.col("maf") >= maf_min) & ~F.col("is_flat"))


def drop_reason(maf_min: float, call_rate_min: float) -> Column:
    """First failing rule in the order: no variance, call rate, allele frequency."""
    return (F.when((F.col("n_obs") == 0) | F.col("is_flat"), "zero_var_or_allmiss")
            .when(F.col("call_rate") < call_rate_min, "call_rate")
            .when(F.col("maf") < maf_min, "maf").otherwise("kept"))


def qc_filter(stats: DataFrame, maf_min: float = 0.01, call_rate_min: float = 0.9) -> DataFrame:
    return stats.where(keep_rule(maf_min, call_rate_min))


def _with_stats(geno: DataFrame, stats: DataFrame) -> DataFrame:
    # stats hold one row per marker and geno was grouped by marker upstream:
    # both sides share the marker key, so one exchange serves the join
    return geno.join(stats, "v")


def standardize(geno: DataFrame, stats: DataFrame) -> DataFrame:
    """z score per observed call (population sd over the filled panel); flat markers give 0."""
    return _with_stats(geno, stats).select(
        "s", "v", F.when(F.col("is_flat"), 0.0)
        .otherwise((F.col("d") - F.col("mean")) / F.sqrt("var")).alias("z"))


def center(geno: DataFrame, stats: DataFrame) -> DataFrame:
    return _with_stats(geno, stats).select("s", "v", (F.col("d") - F.col("mean")).alias("z"))


def ld_pairs(geno: DataFrame, stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """r² for the listed marker pairs ``(va, vb)``, missing calls filled by the mean.

    A marker is one array over the bounded panel, so a pair is one row when its two arrays meet, and
    no row of a pair and a sample is ever made.
    """
    from alloscan.operators.relationship import panel_of
    panel = panel_of(geno)
    z = center(geno, stats).join(F.broadcast(panel_slots(geno.sparkSession, panel)), F.col("s").cast("bigint") == F.col("_s"))
    arrays = in_slots(z.select("v", "slot", "z"), "v", "z", len(panel), F.lit(0.0))
    two = F.zip_with("za", "zb", lambda x, y: x * y)
    prod = (pairs.select("va", "vb").join(arrays.select(F.col("v").alias("va"), F.col("values").alias("za")), "va")
            .join(arrays.select(F.col("v").alias("vb"), F.col("values").alias("zb")), "vb")
            .select("va", "vb", F.aggregate(two, F.lit(0.0), lambda x, y: x + y).alias("sab")))
    ss = stats.select("v", (F.col("sum_dd") - F.col("sum_d") * F.col("mean")).alias("ss"), "is_flat")
    return (pairs.select("va", "vb").join(prod, ["va", "vb"], "left")
            .join(ss.select(F.col("v").alias("va"), F.col("ss").alias("ssa"),
                            F.col("is_flat").alias("fa")), "va")
            .join(ss.select(F.col("v").alias("vb"), F.col("ss").alias("ssb"),
                            F.col("is_flat").alias("fb")), "vb")
            .select("va", "vb", F.when(F.col("fa") | F.col("fb"), 0.0).otherwise(
                F.least(F.lit(1.0), F.coalesce("sab", F.lit(0.0)) * F.coalesce("sab", F.lit(0.0))
                        / F.col("ssa") / F.col("ssb"))).alias("r2")))


def ld_to_lead(geno: DataFrame, lead: DataFrame, targets: DataFrame, min_shared: int = 3) -> DataFrame:
    """r² to each target's lead over samples called for both markers (pairwise complete).

    ``targets`` maps ``v`` to ``lead_v``; fewer than ``min_shared`` shared samples
    or no spread gives null; a lead against itself is 1.
    """
    a = geno.join(targets, "v").select("v", "lead_v", "s", F.col("d").cast("bigint").alias("x"))
    b = geno.join(lead.select(F.col("lead_v").alias("v")).distinct(), "v").select(
        F.col("v").alias("lead_v"), "s", F.col("d").cast("bigint").alias("y"))
    x, y = F.col("x"), F.col("y")
    m = (a.join(b, ["lead_v", "s"], "left").groupBy("v", "lead_v")
         .agg(F.count("y").alias("n"), F.sum(F.when(y.isNotNull(), x)).alias("sx"),
              F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"),
              F.sum(F.when(y.isNotNull(), x * x)).alias("sxx"), F.sum(y * y).alias("syy")))
    n = F.col("n")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    vx = n * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = n * F.col("syy") - F.col("sy") * F.col("sy")
    return m.select("v", "lead_v", n.alias("n_shared"),
                    F.when(F.col("v") == F.col("lead_v"), 1.0)
                    .when((n < min_shared) | (vx == 0) | (vy == 0), None)
                    .otherwise(cov * cov / (vx.cast("double") * vy)).alias("r2"))


def ld_bin(r2: Column) -> Column:
    r2 = F.round(r2, 12)  # a value on a bin edge stays there whatever the summation order
    return (F.when(r2.isNull() | F.isnan(r2), "NA").when(r2 <= 0.2, "0.0-0.2")
            .when(r2 <= 0.4, "0.2-0.4").when(r2 <= 0.6, "0.4-0.6")
            .when(r2 <= 0.8, "0.6-0.8").otherwise("0.8-1.0"))


def gene_burden(geno: DataFrame, stats: DataFrame, snp_gene: DataFrame,
                cap: int | None = None, seed: int = 7) -> DataFrame:
    """Mean standardised dosage per (gene, sample).

    With ``cap`` a gene with more markers uses ``cap`` of them, chosen by a seeded
    hash order per gene (a sampling feature of the burden itself).
    """
    sg = snp_gene.select("v", "gene")
    if cap is not None:
        from alloscan.operators.scan_order import top_k
        sg = top_k(sg, ["gene"], [F.xxhash64(F.lit(seed), "v"), F.col("v")], cap).select("v", "gene")
    # every marker of the gene counts in the mean, a missing call contributes z = 0
    sizes = sg.groupBy("gene").agg(F.count("*").alias("n_snp"))
    z = standardize(geno, stats)
    return (z.join(sg, "v").groupBy("gene", "s").agg(F.sum("z").alias("zs"))
            .join(sizes, "gene").select("gene", "s", (F.col("zs") / F.col("n_snp")).alias("burden")))


def restandardize(burden: DataFrame, n_panel: int, sd_floor: float = 1e-12) -> DataFrame:
    """Centre and scale burden columns on the analysis samples (absent pair = 0)."""
    m = burden.groupBy("gene").agg((F.sum("burden") / n_panel).alias("mu"),
                                   (F.sum(F.col("burden") * F.col("burden")) / n_panel).alias("m2"))
    sd = F.sqrt(F.greatest(F.col("m2") - F.col("mu") * F.col("mu"), F.lit(0.0)))
    return burden.join(m, "gene").select(
        "gene", "s", F.when(sd <= sd_floor, 0.0)
        .otherwise((F.col("burden") - F.col("mu")) / sd).alias("burden_std"))


def gene_coordinates(snp_gene: DataFrame) -> DataFrame:
    """Dominant chromosome (ties: smallest name) and integer median position per gene."""
    chrom = (snp_gene.groupBy("gene", "chrom").agg(F.count("*").alias("n"))
             .groupBy("gene").agg(F.min(F.struct((-F.col("n")).alias("k"), "chrom")).alias("m")))
    pos = snp_gene.groupBy("gene").agg(F.floor(F.expr("percentile(pos, 0.5)")).cast("bigint").alias("pos"))
    return chrom.select("gene", F.col("m.chrom").alias("chrom")).join(pos, "gene")


def panel_slots(spark, panel: list) -> DataFrame:
    """``_s, slot``: the place of each sample of the bounded panel."""
    return spark.createDataFrame([(int(x), i) for i, x in enumerate(panel)], "_s bigint, slot int")


def in_slots(values: DataFrame, key: str, value: str, n: int, empty: Column) -> DataFrame:
    """``key, values``: one array of ``n`` places per key from rows ``key, slot, value``; places without a row hold ``empty``.

    The rows of a key are sorted by place and laid out in one pass: a run of empty places before each
    value, and one behind the last. The panel bounds a key's rows.
    """
    kind = values.schema[value].dataType.simpleString()
    rows = values.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("slot", F.col(value).alias("x")))).alias("r"))
    gap = lambda count: F.array_repeat(empty.cast(kind), count)
    before = F.transform("r", lambda e, i: F.concat(
        gap(e["slot"] - F.when(i == 0, F.lit(-1)).otherwise(F.get("r", i - 1)["slot"]) - 1), F.array(e["x"])))
    return rows.select(key, F.concat(F.flatten(before), gap(n - 1 - F.element_at("r", -1)["slot"])).alias("values"))


def wide_variants(geno: DataFrame, panel: list, extra: DataFrame | None = None) -> DataFrame:
    """One row per marker with a dosage array in panel order; missing = null.

    The panel is the bounded sample list of the study, so an array per marker is bounded.
    """
    slots = panel_slots(geno.sparkSession, panel)
    rows = geno.select("v", "s", F.col("d").cast("float").alias("d")).join(
        F.broadcast(slots), F.col("s").cast("bigint") == F.col("_s")).select("v", "slot", "d")
    out = in_slots(rows, "v", "d", len(panel), F.lit(None)).withColumnRenamed("values", "dosage")
    return out if extra is None else out.join(extra, "v")
