"""Replicates over tables of any size: permuted priors by keyed bijections, paired bootstraps by counts.

No replicate sorts the table or repeats its rows: a permutation reads only the rows that can reach the top,
a bootstrap draws how often each distinct difference comes.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloscan.operators import candidates as cd
from alloscan.operators import scan_order as so
from alloscan.session import cut_lineage, shuffle_width

_ROUNDS = 8


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """64-bit finaliser of x plus a key."""
    x = x + np.uint64(key)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def bijection(x: np.ndarray, n: int, seed: int, replicate: int, inverse: bool = False) -> np.ndarray:
    """Places of ``x`` under a pseudorandom permutation of 0..n-1 that only (seed, replicate) names.

    A balanced Feistel network over the next even number of bits; values that land outside are sent on
    until they land inside, which keeps it a bijection.
    """
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    with np.errstate(over="ignore"):
        keys = _mixed(np.arange(_ROUNDS, dtype=np.uint64) + np.uint64(replicate * _ROUNDS), 0x9E3779B97F4A7C15 * (seed + 1) % 2**64).tolist()

        def once(v):
            left, right = v >> half, v & mask
            for key in reversed(keys) if inverse else keys:
                if inverse:
                    left, right = right ^ (_mixed(left, key) & mask), left
                else:
                    left, right = right, left ^ (_mixed(right, key) & mask)
            return (left << half) | right
        out = once(np.asarray(x, np.uint64))
        while (far := out >= n).any():
            out[far] = once(out[far])
    return out.astype(np.int64)


def permuted_pairs(n: int, top_n: int, replicate: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(place by scan evidence, place by prior) of every pair of a permutation that can reach its top ``top_n``.

    A pair beyond place R in both orders scores no more than any pair within R in both. R is widened until
    ``top_n`` pairs lie within it, so all others are out, whatever the weight of the prior.
    """
    r = min(n, math.ceil(2 * math.sqrt(top_n * n)))
    while True:
        i = np.arange(r)
        j = bijection(i, n, seed, replicate)
        if r == n or np.count_nonzero(j < r) >= top_n:
            break
        r = min(n, 2 * r)
    back = bijection(i, n, seed, replicate, inverse=True)
    far = back >= r
    return np.concatenate([i, back[far]]), np.concatenate([j, i[far]])


def _lift(zg, zl, place, qtl, top_n: int, m: int, grid) -> float:
    """Mean over ``m`` recoverable QTLs of recovery by the weight chosen on the others, minus recovery without the prior.

    ``qtl`` is None outside windows. A QTL that no weight recovers adds 0, so only recovered ones are looked at.
    """
    found = [{q for q in qtl[np.lexsort((place, -(zg + b * zl)))[:top_n]] if q is not None} for b in grid]
    names = sorted(set().union(*found))
    if not names:
        return 0.0
    hit = np.array([[q in f for q in names] for f in found], dtype=np.int64)
    others = hit.sum(1)[:, None] - hit
    pick = others.argmax(0)  # the first, as the least weight wins a tie
    pick[(others.max(0) <= others[grid.index(0.0)]) | (m - 1 < cd.MIN_QTLS)] = grid.index(cd.BETA_DEFAULT)
    return float((hit[pick, np.arange(len(names))] - hit[grid.index(0.0)]).sum()) / m


def permuted_lifts(cand: DataFrame, top_n: int, n_perm: int, seed: int = 31, grid=cd.BETA_GRID) -> DataFrame:
    """``rep, lift``: the nested lift after the prior scores were dealt anew among the scored candidates.

    ``cand``: ``id, z_gwas, z_llr_abs, qtl, in_window``. Scored rows are numbered once by scan evidence and once
    by prior; a replicate is a bijection between the two numberings, and only its pairs that can reach the top
    meet the table, about 4 * sqrt(top_n * rows) of them. That is also the size of a replicate's group. Rows
    without a prior keep none; of these the ``top_n`` best by scan evidence stand beside every replicate. Ties
    go to the row with more scan evidence. A candidate table without scored rows or QTLs gives no rows.
    """
    spark = cand.sparkSession
    c = cand.select("id", F.coalesce("z_gwas", F.lit(0.0)).alias("zg"), F.col("z_llr_abs").alias("zl"), F.when(F.col("in_window"), F.col("qtl")).alias("qtl"))
    m = c.agg(F.countDistinct("qtl")).first()[0]
    s = c.where(F.col("zl").isNotNull())
    s = so.row_position(s.withColumn("_g", -F.col("zg")), ["_g", "id"], "i").drop("_g")
    s = cut_lineage(so.row_position(s.withColumn("_p", -F.col("zl")), ["_p", "id"], "j").drop("_p"))
    n = s.count()
    ddl = "rep bigint, lift double"
    if not n or not m:
        return spark.createDataFrame([], ddl)
    rest = [tuple(r) for r in c.where(F.col("zl").isNull()).orderBy(F.desc("zg"), "id").limit(top_n).select("zg", "qtl").collect()]  # top_n rows

    def pairs(batches):
        for pdf in batches:
            for rep in pdf["id"]:
                i, j = permuted_pairs(n, top_n, int(rep), seed)
                yield pd.DataFrame({"rep": rep, "i": i, "j": j})

    def lift(pdf):
        zg = np.concatenate([pdf["zg"], [z for z, _ in rest]])
        zl = np.concatenate([pdf["zl"], np.zeros(len(rest))])
        place = np.concatenate([pdf["i"], n + np.arange(len(rest))])
        qtl = np.array([*pdf["qtl"], *[q for _, q in rest]], dtype=object)
        return pd.DataFrame({"rep": [pdf["rep"].iloc[0]], "lift": [_lift(zg, zl, place, qtl, top_n, m, list(grid))]})
    p = spark.range(1, n_perm + 1, 1, shuffle_width(spark)).mapInPandas(pairs, "rep bigint, i bigint, j bigint")
    # the planner takes the pairs for as few as the replicates and would broadcast them: both joins shuffle
    met = p.join(s.select("i", "zg", "qtl").hint("merge"), "i").join(s.select("j", "zl").hint("merge"), "j")
    return met.groupBy("rep").applyInPandas(lift, ddl)


#: Distinct differences that one task of a bootstrap holds, and replicates it draws at a time.
BLOCK, SLICE = 1 << 16, 64


def paired_bootstrap(diffs: DataFrame, keys: list[str], value: str, n_boot: int, seed: int = 13, level: float = 0.95) -> DataFrame:
    """Per group: ``n``, mean difference ``delta``, its percentile interval ``lo, hi`` and ``p`` of a mean above 0.

    Equal differences are folded to one row with a count; a replicate is a multinomial draw of counts, first
    over blocks of differences, then within each block, so a group of any size is spread over tasks and no row
    is repeated. A draw's seed is named by group and block: results do not depend on the partitioning. Null
    differences take no part; a group without differences has no row.
    """
    spark = diffs.sparkSession
    c = diffs.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_d")).agg(F.count("*").alias("_k"))
    c = cut_lineage(c)
    blocks = max(1, -(-c.count() // BLOCK))
    c = c.withColumn("_b", F.pmod(F.xxhash64("_d"), F.lit(blocks)).cast("int"))
    sizes: dict = {}
    for r in c.groupBy(*keys, "_b").agg(F.sum("_k").alias("n")).collect():  # groups x blocks rows
        sizes.setdefault(tuple(r[k] for k in keys), {})[r["_b"]] = r["n"]
    shared = spark.sparkContext.broadcast(sizes)
    ddl = ", ".join(f"{k} {c.schema[k].dataType.simpleString()}" for k in keys) + ", rep bigint, s double"

    def draw(key, pdf):
        *group, b = key
        mine = shared.value[tuple(getattr(g, "item", lambda g=g: g)() for g in group)]
        order = sorted(mine)
        name = zlib.crc32(repr([str(g) for g in group]).encode())
        n = np.array([mine[k] for k in order])
        dealt = np.random.default_rng([seed, name]).multinomial(n.sum(), n / n.sum(), size=n_boot)[:, order.index(int(b))]
        pdf = pdf.sort_values("_d")
        d, share = pdf["_d"].to_numpy(), pdf["_k"].to_numpy() / pdf["_k"].sum()
        rng = np.random.default_rng([seed, name, int(b)])
        s = np.concatenate([rng.multinomial(dealt[a:a + SLICE], share) @ d for a in range(0, n_boot, SLICE)])
        return pd.DataFrame({**dict(zip(keys, group)), "rep": np.arange(n_boot), "s": s})
    sums = c.groupBy(*keys, "_b").applyInPandas(draw, ddl).groupBy(*keys, "rep").agg(F.sum("s").alias("s"))
    total = c.groupBy(*keys).agg(F.sum("_k").alias("n"), (F.sum(F.col("_d") * F.col("_k")) / F.sum("_k")).alias("delta"))
    means = sums.join(F.broadcast(total), keys).withColumn("m", F.col("s") / F.col("n"))
    tail = (1 - level) / 2
    return means.groupBy(*keys, "n", "delta").agg(
        F.percentile("m", tail).alias("lo"), F.percentile("m", 1 - tail).alias("hi"),
        ((1 + F.count_if(F.col("m") <= 0)) / (F.count("*") + 1)).alias("p"))


def prior_lift(cand: DataFrame, top_n: int, n_perm: int, n_boot: int, seed: int = 31) -> DataFrame:
    """One row: the nested lift, its interval over resampled QTLs, and its rank among permuted priors.

    ``n_recoverable, locked`` (too few QTLs to choose a weight), ``lift, lo, hi, p_perm, null_q50, null_q95, null_q99, n_perm``.
    """
    rq = cand.where(F.col("in_window") & F.col("qtl").isNotNull()).select("qtl").distinct()
    own = cut_lineage(cd.nested_lift(cd.recovered_by_beta(cand, top_n), rq).select(
        F.lit("all").alias("set"), (F.col("hit_fused") - F.col("hit_gwas")).alias("d")))
    boot = paired_bootstrap(own, ["set"], "d", n_boot, seed).select("n", "delta", "lo", "hi")
    null = permuted_lifts(cand, top_n, n_perm, seed).join(F.broadcast(boot.select("delta")))
    q = null.agg(((1 + F.count_if(F.col("lift") >= F.col("delta") - 1e-12)) / (1 + F.count("*"))).alias("p_perm"),
                 *[F.percentile("lift", x / 100).alias(f"null_q{x}") for x in (50, 95, 99)], F.count("*").alias("n_perm"))
    return boot.join(F.broadcast(q)).select(F.col("n").alias("n_recoverable"), (F.col("n") - 1 < cd.MIN_QTLS).alias("locked"),
                                            F.col("delta").alias("lift"), "lo", "hi", "p_perm", "null_q50", "null_q95", "null_q99", "n_perm")
