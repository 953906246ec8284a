"""Column functions: p-values, combination tests, intervals, small closed forms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alloscan.functions import special as sp


@F.pandas_udf(T.DoubleType())
def chi2_sf1(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with 1 df; erfc keeps p relative accuracy far out."""
    return pd.Series(sp.chi2_1_sf(x.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def normal_quantile(q: pd.Series) -> pd.Series:
    return pd.Series(sp.norm_ppf(q.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def chi2_from_p(p: pd.Series) -> pd.Series:
    """1-df chi-square whose upper tail is p."""
    v = p.to_numpy(float)
    with np.errstate(invalid="ignore"):
        v = np.where((v > 0) & (v <= 1), v, np.nan)
    return pd.Series(sp.norm_ppf(v / 2) ** 2)


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    t, df = t.to_numpy(float), df.to_numpy(float)
    ok = (df > 0) & ~np.isnan(t)
    return pd.Series(np.where(ok, sp.t_sf2(t, np.where(ok, df, 1.0)), np.nan))


@F.pandas_udf(T.DoubleType())
def f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    f = f.to_numpy(float)
    return pd.Series(np.where(np.isnan(f), np.nan, sp.f_sf(f, d1.to_numpy(float), d2.to_numpy(float))))


@F.pandas_udf(T.DoubleType())
def chibar_p(t: pd.Series, k: pd.Series) -> pd.Series:
    """Boundary likelihood-ratio p for k added variance components."""
    t, k = t.to_numpy(float), k.to_numpy(int)
    out = np.empty(len(t))
    for n in np.unique(k):
        out[k == n] = sp.chibar_sf(t[k == n], sp.chibar_weights(int(n)))
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def hypergeom_p(k: pd.Series, n: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series(sp.hypergeom_sf(*(v.to_numpy(float) for v in (k, n, marked, drawn))))


@F.pandas_udf(T.DoubleType())
def beta_quantile(q: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(sp.beta_ppf(*(v.to_numpy(float) for v in (q, a, b))))


def neglog10(p: Column) -> Column:
    return -F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300)))


# Cauchy combination: fixed clip limits of the test
_P_LOW, _P_HIGH, _P_TAIL, _T_TAIL = sp.P_LOW, sp.P_HIGH, sp.P_TAIL, sp.T_TAIL


def cauchy_term(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(_P_HIGH)), F.lit(_P_LOW))
    return (F.when(q < _P_TAIL, 1 / (q * F.pi()))
            .when(1 - q < _P_TAIL, -1 / ((1 - q) * F.pi()))
            .otherwise(F.tan((0.5 - q) * F.pi())))


def cauchy_p(t: Column) -> Column:
    return (F.when(t > _T_TAIL, 1 / (t * F.pi()))
            .when(t < -_T_TAIL, 1 + 1 / (t * F.pi()))
            .otherwise(0.5 - F.atan(t) / F.pi()))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def acat(p: Column) -> Column:
    """Aggregate: equal-weight Cauchy combination of the finite p in a group."""
    return cauchy_p(F.avg(F.when(_finite(p), cauchy_term(p))))


def acat_weighted(p: Column, w: Column) -> Column:
    ok = _finite(p) & _finite(w) & (w > 0)
    return cauchy_p(F.sum(F.when(ok, w * cauchy_term(p))) / F.sum(F.when(ok, w)))


def wilson(n_hit: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Score interval for a proportion, clipped to [0, 1]."""
    p = n_hit / n
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def poisson_sf(k: int, mu: Column) -> Column:
    """P(X >= k) for a fixed small k as a finite sum (stays inside codegen)."""
    acc, term = F.lit(1.0), F.lit(1.0)
    for i in range(1, k):
        term = term * mu / i
        acc = acc + term
    return F.greatest(F.lit(0.0), 1 - F.exp(-mu) * acc) if k > 0 else F.lit(1.0)


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear, clamped at both ends, for a short fixed curve."""
    out = F.when(x <= xs[0], F.lit(ys[0]))
    for i in range(1, len(xs)):
        out = out.when(x <= xs[i], ys[i - 1] + (x - xs[i - 1]) * ((ys[i] - ys[i - 1])
                                                                  / (xs[i] - xs[i - 1])))
    return out.otherwise(F.lit(ys[-1]))


def genomic_inflation(stats: DataFrame, levels: list[str], chi2: str = "chi2") -> DataFrame:
    """Median chi-square over its null median, overall and per level, in one pass.

    The exact percentile keeps value -> count maps; with continuous values that is
    all rows per group, so chi2 is first folded by value in (scope, bin) ranges:
    the bin holding the middle rank is found from counts, and only that bin's
    values are ordered. No group is ever gathered whole.
    """
    ok = stats.where(_finite(F.col(chi2))).select(
        F.explode(F.array(F.struct(F.lit("all").alias("scope"), F.lit("all").alias("level")),
                          *[F.struct(F.lit(c).alias("scope"), F.col(c).alias("level"))
                            for c in levels])).alias("g"), F.col(chi2).alias("x"))
    rows = ok.select("g.scope", "g.level", "x")
    med = grouped_median(rows, ["scope", "level"], "x")
    return med.select("scope", "level", F.col("n").alias("n_markers"),
                      (F.col("median") / sp.CHI2_1_MEDIAN).alias("lambda_gc"))


def grouped_median(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    return grouped_quantile(rows, by, x, 0.5).withColumnRenamed("q", "median")


def grouped_quantile(rows: DataFrame, by: list[str], x: str, prob: float) -> DataFrame:
    """Exact quantile (linear between ranks) per group; adds ``n`` and ``q``.

    Equal values of a group are folded to one row; one ordered pass over (group, value)
    gives every value its ranks, so no group is ever in one task.
    """
    from alloscan.operators.scan_order import ordered_scan
    folded = rows.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_q_k"))
    ranked = ordered_scan(folded, [*by, x], {"_q_upto": ("sum", "_q_k")})
    sizes = ranked.groupBy(*by).agg(F.sum("_q_k").alias("_q_n"), F.min(F.col("_q_upto") - F.col("_q_k")).alias("_q_base"))
    named = sizes.select(*[F.col(c).alias(f"_q_g{i}") for i, c in enumerate(by)], "_q_n", "_q_base")
    same = [F.col(c).eqNullSafe(F.col(f"_q_g{i}")) for i, c in enumerate(by)]
    at = (F.col("_q_n") - 1) * prob
    upto, first = F.col("_q_upto") - F.col("_q_base"), F.col("_q_upto") - F.col("_q_base") - F.col("_q_k")
    lo_rank, hi_rank = F.floor(at) + 1, F.ceil(at) + 1
    lo = F.min(F.when((first < lo_rank) & (upto >= lo_rank), F.col(x)))
    hi = F.min(F.when((first < hi_rank) & (upto >= hi_rank), F.col(x)))
    frac = F.max(at - F.floor(at))
    return ranked.join(named, same).groupBy(*by).agg(
        F.max("_q_n").alias("n"), (lo + frac * (hi - lo)).alias("q"))
