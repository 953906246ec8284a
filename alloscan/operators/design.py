"""Sequencing-depth planning: callable fraction, predicted pair counts and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloscan.functions.stat_columns import interpolate, poisson_sf

# fixed values: callable fraction of a gene at a usable marker density per gene copy
DENSITY = [0.0, 0.494, 0.989, 2.472, 4.944, 9.889, 24.722, 49.445]
CALLABLE = [0.0, 0.0316, 0.1070, 0.3254, 0.5257, 0.6616, 0.7794, 0.8885]
# fixed values: (minimum depth, mappability) per test mode
MODES = {"marginal": (4, 0.85), "interaction": (8, 0.55)}


def band(g: Column) -> Column:
    return (F.when(g < 70, "underpowered/null-likely").when(g < 300, "borderline/risky")
            .when(g < 1000, "discovery-feasible").otherwise("strong-design"))


def retention(depth: Column, mode: str, map_shift: float = 0.0) -> Column:
    """Probability that a site reaches the minimum depth (Poisson reads)."""
    min_dp, mappability = MODES[mode]
    m = min(1.0, max(1e-6, mappability + map_shift))
    return poisson_sf(min_dp, F.greatest(depth, F.lit(0.0)) * m)


def predicted_pairs(retained: Column, g_full: Column, lambda_full: Column) -> Column:
    """Pairs whose two copies stay callable: squared ratio of callable fractions, at most 1."""
    full = interpolate(lambda_full, DENSITY, CALLABLE)
    now = interpolate(lambda_full * retained, DENSITY, CALLABLE)
    rho = F.when(full > 0, F.least(F.lit(1.0), F.pow(now / full, 2))).otherwise(0.0)
    return g_full * rho


def at_least_three(n: Column, rate: float) -> Column:
    """Probability that a binomial draw from ``n`` at ``rate`` is 3 or more."""
    if rate >= 1:
        return (n >= 3).cast("double")
    q, x = 1.0 - rate, n.cast("double")
    few = F.pow(F.lit(q), x) + x * rate * F.pow(F.lit(q), x - 1) + x * (x - 1) / 2 * rate ** 2 * F.pow(F.lit(q), x - 2)
    return F.when(n < 3, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - few))


def thinned_curve(sizes: DataFrame, unit: list[str], side: str, sides: list[str], rates: tuple, draws: int, seed: int = 17, folds: int = 5) -> DataFrame:
    """Callable copy pairs of all units after thinning, by ``mode`` and ``rate``: mean, interval, band and held-out error.

    ``sizes``: ``unit, side, n`` with the number of markers of each copy. ``uniform`` keeps each marker with probability
    ``rate``: a copy stays callable if a binomial draw from its number is 3 or more, which one hash per (copy, draw) decides by
    the inverse of the distribution. ``clustered`` keeps or loses a copy as a whole. A pair of copies is callable if both are.
    No marker is a row, and what is counted of a unit is summed within its task.

    ``held_out_error``: the units are dealt into folds; the share of callable pairs that the other folds keep at
    the rate predicts the fold's, and the error is the mean of |predicted - own| / own over folds.
    """
    wide = sizes.groupBy(*unit).pivot(side, sides).agg(F.max("n")).na.fill(0, sides)
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), *unit), F.lit(folds)).cast("int")
    hashes = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda k: F.struct(k.alias("draw"), *[
        (F.pmod(F.xxhash64(F.lit(seed), *unit, F.lit(s), k), F.lit(2 ** 31)) / 2.0 ** 31).alias(f"u{s}") for s in sides]))
    each = wide.select(fold.alias("fold"), *sides, F.explode(hashes).alias("h")).select("fold", "h.*", *sides)
    called = []
    for mode in ("uniform", "clustered"):
        for rate in rates:
            stays = {s: (F.col(f"u{s}") >= 1 - at_least_three(F.col(s), rate)) & (F.col(s) >= 3) if mode == "uniform"
                     else (F.col(f"u{s}") < rate) & (F.col(s) >= 3) for s in sides}
            both = sum((stays[a] & stays[b]).cast("long") for i, a in enumerate(sides) for b in sides[i + 1:])
            called.append(F.struct(F.lit(mode).alias("mode"), F.lit(rate).alias("rate"), F.sum(both).alias("g")))
    full = sum(((F.col(a) >= 3) & (F.col(b) >= 3)).cast("long") for i, a in enumerate(sides) for b in sides[i + 1:])
    cells = (each.groupBy("fold", "draw").agg(F.sum(full).alias("full"), F.array(*called).alias("c"))
             .select("fold", "draw", "full", F.explode("c").alias("c")).select("fold", "draw", "full", "c.*"))
    g = (cells.groupBy("mode", "rate", "draw").agg(F.sum("g").cast("double").alias("g")).groupBy("mode", "rate")
         .agg(F.avg("g").alias("g_callable"), F.percentile("g", 0.025).alias("g_lo"), F.percentile("g", 0.975).alias("g_hi")))
    by_fold = cells.groupBy("mode", "rate", "fold").agg(F.avg("g").alias("own"), F.max("full").alias("full"))
    every = by_fold.groupBy("mode", "rate").agg(F.sum("own").alias("all_own"), F.sum("full").alias("all_full"))
    other = F.try_divide(F.col("all_own") - F.col("own"), F.col("all_full") - F.col("full")) * F.col("full")
    error = (by_fold.join(every, ["mode", "rate"]).where("own > 0").groupBy("mode", "rate")
             .agg(F.avg(F.abs(other - F.col("own")) / F.col("own")).alias("held_out_error")))
    return g.join(error, ["mode", "rate"], "left").select("mode", "rate", "g_callable", "g_lo", "g_hi", "held_out_error", band(F.col("g_callable")).alias("band"))


def detectable_share(df, power: float, alpha: float):
    """Variance share ncp^2 / (ncp^2 + n) with the exact noncentral-t power at alpha / g.

    ``df`` has columns ``n`` (samples) and ``g`` (tests); one small root search per row.
    """
    import numpy as np
    import pandas as pd

    from alloscan.functions import special as sp

    def power_at(ncp, crit, nu):
        # mean over the chi distribution of the scale, by quadrature
        w = np.linspace(1e-6, 1 - 1e-6, 400)
        q = np.array([sp.bisect_root(lambda x, p=p: (1 - sp.gamma_q(nu / 2, x / 2)) - p, 0.0, nu + 12 * np.sqrt(2 * nu) + 40, 60) for p in w[::8]])
        s = np.sqrt(q / nu)
        z = (ncp - crit * s) / np.sqrt(2)
        import math
        return float(np.mean([0.5 * math.erfc(-v) for v in z]))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                nu = max(int(r.n) - 4, 2)
                crit = sp.t_ppf(1 - alpha / max(int(r.g), 1) / 2, nu)
                ncp = sp.bisect_root(lambda v: power_at(v, crit, nu) - power, 0.0, crit + 20, 40)
                yield pd.DataFrame({"n": [r.n], "g": [r.g], "ncp": [ncp], "mde_pve": [ncp * ncp / (ncp * ncp + r.n)]})
    return df.select("n", "g").mapInPandas(run, "n bigint, g bigint, ncp double, mde_pve double")
