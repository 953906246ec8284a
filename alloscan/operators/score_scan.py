"""Per-marker score tests: fixed null model broadcast, markers spread over tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alloscan.functions.special import chi2_1_sf
from alloscan.functions.stat_columns import chi2_sf1
from alloscan.operators import genotype as gt
from alloscan.operators.relationship import MAX_PANEL

SCAN_DDL = ("v bigint, beta double, se double, chi2 double, p double, n_obs bigint, "
            "maf double, call_rate double, status string")


def centered_trait(pheno: DataFrame, y: str = "y") -> DataFrame:
    """Trait minus its panel mean, plus panel size and residual variance (n-1).

    ``pheno`` has one row per sample of the bounded panel, so its windows are bounded and the
    result may be broadcast to every marker task; a larger table is refused.
    """
    w = Window.partitionBy()
    n = F.count(y).over(w)
    size = F.when(n <= MAX_PANEL, n).otherwise(F.raise_error(F.lit("panel beyond its bound")))
    c = pheno.select("s", (F.col(y) - F.avg(y).over(w)).alias("yc"), size.alias("n"))
    return c.select("s", "yc", "n", (F.sum(F.col("yc") * F.col("yc")).over(w) / (F.col("n") - 1)).alias("sigma2"))


def null_scan(geno: DataFrame, trait: DataFrame, maf_min: float = 0.01,
              call_rate_min: float = 0.9) -> DataFrame:
    """Score test with an intercept-only null model, as one aggregation per marker.

    U = sum (d - mean) yc, I = sum (d - mean)^2; beta = U/I, chi2 = U^2 / (I sigma2).
    ``trait`` comes from :func:`centered_trait`: one row per panel sample, bounded.
    """
    d, yc = F.col("d"), F.col("yc")
    sums = (geno.join(F.broadcast(trait), "s").groupBy("v")
            .agg(F.count("d").alias("n_obs"), F.sum("d").alias("sum_d"),
                 F.sum(d * d).alias("sum_dd"), F.sum(d * yc).alias("s_dy"),
                 F.sum(yc).alias("s_y"), F.first("n").alias("n"), F.first("sigma2").alias("sigma2")))
    mean = F.col("sum_d") / F.col("n_obs")
    stats = sums.select(
        "*", mean.alias("mean"), F.least(mean / 2, 1 - mean / 2).alias("maf"),
        (F.col("n_obs") / F.col("n")).alias("call_rate"),
        (F.col("n_obs") * F.col("sum_dd") == F.col("sum_d") * F.col("sum_d")).alias("is_flat"))
    u = F.col("s_dy") - F.col("mean") * F.col("s_y")
    info = F.col("sum_dd") - F.col("sum_d") * F.col("mean")
    kept = stats.where(gt.keep_rule(maf_min, call_rate_min)).withColumn("u", u).withColumn("i", info)
    return (kept.where(F.col("i") > 0).select(
        "v", (F.col("u") / F.col("i")).alias("beta"),
        F.sqrt(F.col("sigma2") / F.col("i")).alias("se"),
        (F.col("u") * F.col("u") / F.col("i") / F.col("sigma2")).alias("chi2"),
        "n_obs", "maf", "call_rate"))


def with_p(scan: DataFrame, chi2: str = "chi2") -> DataFrame:
    return scan.withColumn("p", chi2_sf1(F.col(chi2)))


def _block_matrix(col: pd.Series, n: int) -> np.ndarray:
    return np.stack([np.asarray(a, dtype=float) for a in col]) if len(col) else np.empty((0, n))


def score_block(g: np.ndarray, proj: np.ndarray, py: np.ndarray, maf_min: float, cr_min: float):
    """Score statistics of a block (markers x samples, NaN = missing)."""
    n = g.shape[1]
    seen = ~np.isnan(g)
    n_obs = seen.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(seen, g, 0).sum(1) / n_obs
    x = np.where(seen, g, mean[:, None])
    x[n_obs == 0] = 0.0
    af = x.mean(1) / 2
    maf, cr = np.minimum(af, 1 - af), n_obs / n
    flat = (n_obs == 0) | (np.ptp(x, axis=1) <= 1e-12)
    u = x @ py
    info = np.einsum("ij,ij->i", x @ proj, x)
    status = np.where(flat, "zero_var_or_allmiss", np.where(cr < cr_min, "call_rate", np.where(
        maf < maf_min, "maf", np.where(~np.isfinite(info) | (info <= 0), "bad_info", "ok"))))
    with np.errstate(invalid="ignore", divide="ignore"):
        beta, se, chi2 = u / info, np.sqrt(1 / info), u * u / info
    bad = status != "ok"
    for a in (beta, se, chi2):
        a[bad] = np.nan
    p = np.where(bad, np.nan, chi2_1_sf(np.where(bad, 0.0, chi2)))
    return beta, se, chi2, p, n_obs, maf, cr, status


def kernel_scan(variants: DataFrame, contexts: dict | Iterable[tuple], maf_min: float = 0.01,
                call_rate_min: float = 0.9, chrom_col: str | None = None,
                keep: list[str] | None = None) -> DataFrame:
    """Score scan of wide variants (``v``, ``dosage`` array, carried ``keep`` columns).

    ``contexts`` maps a chromosome (or ``None``) to ``(P, Py)`` of the null model, or gives such pairs one by
    one, so that the driver need not hold them all. Each is n x n for the bounded sample panel and a broadcast of
    its own: a task loads those of the chromosomes that it meets. Markers never
    move: the scan is a narrow map over the input partitions, in Arrow batches.
    A chromosome without a context is an error, never a silent fallback.
    """
    sc = variants.sparkSession.sparkContext
    shared = {c: sc.broadcast(x) for c, x in (contexts.items() if isinstance(contexts, dict) else contexts)}
    keep = keep or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [(None, pdf)] if chrom_col is None else list(pdf.groupby(chrom_col, sort=False))
            for chrom, b in parts:
                if chrom not in shared:
                    raise KeyError(f"no null-model context for chromosome {chrom!r}")
                proj, py = shared[chrom].value
                g = _block_matrix(b["dosage"], len(py))
                beta, se, chi2, p, n_obs, maf, cr, st = score_block(
                    g, proj, py, maf_min, call_rate_min)
                out = pd.DataFrame({"v": b["v"].to_numpy(), "beta": beta, "se": se, "chi2": chi2,
                                    "p": p, "n_obs": n_obs, "maf": maf, "call_rate": cr,
                                    "status": st})
                for c in keep:
                    out[c] = b[c].to_numpy()
                yield out

    ddl = SCAN_DDL + "".join(f", {c} {variants.schema[c].dataType.simpleString()}" for c in keep)
    return variants.mapInPandas(run, ddl)


def qc_summary(sumstats: DataFrame) -> DataFrame:
    """Bounded-memory acceptance pass over a finished scan."""
    def bad(c: str) -> Column:
        return F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")))
    return sumstats.agg(
        F.count("*").alias("n_rows"), bad("p").alias("n_p_nonfinite"),
        bad("chi2").alias("n_chi2_nonfinite"),
        F.count_if((F.col("p") < 0) | (F.col("p") > 1)).alias("n_p_out_of_range"),
        F.count_if(F.col("chi2") < 0).alias("n_chi2_negative"),
        F.min("p").alias("p_min"), F.max("p").alias("p_max"),
        F.min("chi2").alias("chi2_min"), F.max("chi2").alias("chi2_max"))
