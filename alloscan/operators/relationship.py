"""Relationship matrices as mergeable partial sums over markers, and their algebra.

The panel (samples) is bounded and checked; markers are not. Each task folds its markers
into one n x n partial per group, so the shuffle carries n^2 values per task, whatever
the number of markers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PANEL = 20_000  # n x n doubles must fit one process


def panel_of(samples: DataFrame, limit: int = MAX_PANEL) -> list:
    """Ordered distinct sample ids; refuses a panel beyond the stated bound."""
    ids = [x["s"] for x in samples.select("s").distinct().orderBy("s").limit(limit + 1).collect()]
    if len(ids) > limit:
        raise ValueError(f"panel has over {limit} samples; a dense kernel would not fit")
    return ids


def gram_parts(variants: DataFrame, n: int, group: str, maf_min: float = 0.01) -> DataFrame:
    """Rows ``(grp, i, row, den, n_in, n_used)``: partial numerators per group and sample row.

    Missing calls take the marker mean, markers under ``maf_min`` are dropped; the
    denominator is the sum of 2p(1-p) over used markers (carried on row 0 only).
    """
    tasks = variants.sparkSession.sparkContext.defaultParallelism * 4

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for pdf in batches:
            for grp, b in pdf.groupby("grp", sort=False):
                g = np.stack([np.asarray(a, dtype=float) for a in b["dosage"]])
                seen = ~np.isnan(g)
                cnt = np.maximum(seen.sum(1), 1)
                mean = np.where(seen, g, 0).sum(1) / cnt
                use = (np.minimum(mean / 2, 1 - mean / 2) >= maf_min) & seen.any(1)
                z = np.where(seen, g - mean[:, None], 0.0)[use]
                p = mean[use] / 2
                a = acc.setdefault(grp, [np.zeros((n, n)), 0.0, 0, 0])
                a[0] += z.T @ z
                a[1] += float((2 * p * (1 - p)).sum())
                a[2] += len(g)
                a[3] += int(use.sum())
        for grp, (num, den, n_in, n_used) in acc.items():
            yield pd.DataFrame({"grp": grp, "i": np.arange(n), "row": list(num),
                                "den": [den] + [0.0] * (n - 1), "n_in": [n_in] + [0] * (n - 1),
                                "n_used": [n_used] + [0] * (n - 1)})

    v = variants.select(F.col(group).alias("grp"), "dosage")
    return v.coalesce(tasks).mapInPandas(
        fold, "grp string, i int, row array<double>, den double, n_in bigint, n_used bigint")


def part_totals(parts: DataFrame) -> DataFrame:
    return parts.groupBy("grp").agg(F.sum("den").alias("den"), F.sum("n_in").alias("n_in"),
                                    F.sum("n_used").alias("n_used"))


def numerators(parts: DataFrame) -> DataFrame:
    """Tall numerators (grp, i <= j, num) summed over tasks."""
    return (parts.select("grp", "i", F.posexplode("row").alias("j", "x")).where(F.col("j") >= F.col("i"))
            .groupBy("grp", "i", "j").agg(F.sum("x").alias("num")))


def grm(parts: DataFrame) -> DataFrame:
    """K = numerator / denominator per group; a group without information is an error."""
    t = part_totals(parts)
    den = F.when(F.col("den") > 0, F.col("den")).otherwise(
        F.raise_error(F.lit("no informative marker in this group")))
    return numerators(parts).join(F.broadcast(t), "grp").select("grp", "i", "j", (F.col("num") / den).alias("k"))


def loco(parts: DataFrame, of: DataFrame, min_fraction: float = 1e-6) -> DataFrame:
    """Leave-one-out kernels by subtraction inside each family: (total - part) / (D - d).

    ``of`` maps a part ``grp`` to its ``family`` (chromosome to subgenome).
    """
    num = numerators(parts).join(F.broadcast(of), "grp")
    den = part_totals(parts).join(F.broadcast(of), "grp")
    tn = num.groupBy("family", "i", "j").agg(F.sum("num").alias("tn"))
    td = den.groupBy("family").agg(F.sum("den").alias("td"))
    d = den.join(td, "family").select("grp", "den", "td")
    left = F.col("td") - F.col("den")
    safe = F.when(left / F.col("td") >= min_fraction, left).otherwise(
        F.raise_error(F.concat(F.lit("too little left without "), F.col("grp"))))
    return (num.join(tn, ["family", "i", "j"]).join(F.broadcast(d), "grp")
            .select("grp", "family", "i", "j", ((F.col("tn") - F.col("num")) / safe).alias("k"),
                    (left / F.col("td")).alias("retained")))


def hadamard(k: DataFrame) -> DataFrame:
    """Elementwise product over groups of (grp, i, j, k)."""
    n = k.select("grp").distinct().agg(F.count("*")).scalar()
    return (k.groupBy("i", "j").agg(F.product("k").alias("k"), F.count("*").alias("c"))
            .where(F.col("c") == n).select("i", "j", "k"))


def pairwise_mean(k: DataFrame) -> DataFrame:
    """Mean of products over all group pairs: ((sum k)^2 - sum k^2) / (S (S - 1))."""
    s1, s2, c = F.sum("k"), F.sum(F.col("k") * F.col("k")), F.count("*")
    return k.groupBy("i", "j").agg(((s1 * s1 - s2) / (c * (c - 1))).alias("k"))


def homolog_kernel(k: DataFrame, n_groups: int, mode: str = "auto", threshold: int = 3) -> DataFrame | None:
    """Product kernel for 2..threshold groups, mean of pair products beyond, none for one group."""
    if mode == "none" or n_groups < 2:
        return None
    return hadamard(k) if mode == "hadamard" or (mode == "auto" and n_groups <= threshold) else pairwise_mean(k)


def loco_homolog(left: DataFrame, full: DataFrame, families: list[str], mode: str = "auto", threshold: int = 3) -> DataFrame | None:
    """Homolog kernel of every left-out group, as tall cells ``grp, i, j, k``; none for one family.

    ``left`` comes from :func:`loco`: the family's own kernel without the group. ``full`` holds all families'
    kernels. The other families enter a cell by their product, or by their sum and sum of squares, so a
    group's cells need one join whatever the number of families.
    """
    if mode == "none" or len(families) < 2:
        return None
    other = full.select(F.explode(F.array(*map(F.lit, families))).alias("family"), "grp", "i", "j", "k").where(F.col("family") != F.col("grp"))
    other = other.groupBy("family", "i", "j").agg(F.product("k").alias("p"), F.sum("k").alias("s1"), F.sum(F.col("k") * F.col("k")).alias("s2"))
    k, c = F.col("k"), len(families)
    if mode == "hadamard" or (mode == "auto" and c <= threshold):
        cell = k * F.col("p")
    else:
        cell = ((F.col("s1") + k) * (F.col("s1") + k) - F.col("s2") - k * k) / (c * (c - 1))
    return left.join(other, ["family", "i", "j"]).select("grp", "i", "j", cell.alias("k"))


def weighted_sum(k: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    w = F.lit(1.0)
    for g, x in (weights or {}).items():
        w = F.when(F.col("grp") == g, x).otherwise(w)
    return k.groupBy("i", "j").agg(F.sum(F.col("k") * w).alias("k"))


def normalize(k: DataFrame, n, mode: str = "trace") -> DataFrame:
    """Scale to trace n, or to Frobenius norm n, per ``grp`` (upper triangle stored)."""
    size = (F.sum(F.when(F.col("i") == F.col("j"), F.col("k"))) if mode == "trace" else
            F.sqrt(F.sum(F.col("k") * F.col("k") * F.when(F.col("i") == F.col("j"), 1).otherwise(2))))
    d = k.groupBy("grp").agg(size.alias("d"))
    safe = F.when(F.abs("d") >= 1e-12, F.col("d")).otherwise(F.raise_error(F.lit("kernel has no scale")))
    return k.join(F.broadcast(d), "grp").select("grp", "i", "j", (F.col("k") * n / safe).alias("k"))


def kernel_correlation(k: DataFrame) -> DataFrame:
    """Pearson correlation of off-diagonal entries for each pair of kernels."""
    up = k.where(F.col("i") < F.col("j"))
    b = up.select(F.col("grp").alias("grp_b"), "i", "j", F.col("k").alias("kb"))
    return (up.join(b, ["i", "j"]).where(F.col("grp") < F.col("grp_b"))
            .groupBy(F.col("grp").alias("grp_a"), "grp_b").agg(F.corr("k", "kb").alias("r")))


def kernel_gram(k: DataFrame, identity: str = "I") -> DataFrame:
    """``grp_a, grp_b, g`` (grp_a <= grp_b): inner products of the vectorised kernels and the identity.

    ``k`` has the cells with i <= j; those off the diagonal count twice. The kernels of a cell meet in one row, so the
    cells are shuffled once and each task sends one partial sum for each pair of kernels.
    """
    unit = k.where("i = j").select(F.lit(identity).alias("grp"), "i", "j", F.lit(1.0).alias("k")).distinct()
    cells = (k.select(F.col("grp").cast("string").alias("grp"), "i", "j", F.col("k").cast("double").alias("k")).unionByName(unit)
             .groupBy("i", "j").agg(F.collect_list(F.struct("grp", "k")).alias("c")))
    weight = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    pairs = cells.select(weight.alias("w"), "c", F.explode("c").alias("a")).select("w", "a", F.explode("c").alias("b")).where("a.grp <= b.grp")
    return pairs.groupBy(F.col("a.grp").alias("grp_a"), F.col("b.grp").alias("grp_b")).agg(F.sum(F.col("w") * F.col("a.k") * F.col("b.k")).alias("g"))


def kernel_condition(k: DataFrame) -> DataFrame:
    """``n_columns, condition``: condition number of the vectorised kernels beside the identity, from their Gram matrix.

    One row; infinite where they are linearly dependent, none for an empty ``k``. The matrix is as wide as there
    are kernels, whatever the panel or the marker count.
    """
    def solve(gram: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*gram["grp_a"], *gram["grp_b"]})
        m = gram.set_index(["grp_a", "grp_b"])["g"].unstack().reindex(index=names, columns=names).fillna(0.0).to_numpy()
        roots = np.linalg.eigvalsh(m + np.triu(m, 1).T)
        ratio = roots[-1] / roots[0] if roots[0] > roots[-1] * len(names) * np.finfo(float).eps else np.inf
        return pd.DataFrame({"n_columns": [len(names)], "condition": [float(np.sqrt(ratio))]})

    return kernel_gram(k).groupBy(F.lit(0).alias("one")).applyInPandas(solve, "n_columns long, condition double")


def dense(k: DataFrame, n: int) -> dict[str, np.ndarray]:
    """Bring kernels of the bounded panel to the driver as {grp: n x n}."""
    if n > MAX_PANEL:
        raise ValueError("panel too large for a dense kernel")
    pdf = k.select("grp", "i", "j", "k").toPandas()
    out = {}
    for grp, b in pdf.groupby("grp"):
        m = np.zeros((n, n))
        m[b["i"], b["j"]] = b["k"]
        m[b["j"], b["i"]] = b["k"]
        out[str(grp)] = m
    return out

