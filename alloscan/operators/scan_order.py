"""Global ordered scans (row numbers, running min/max/sum) without a one-task window.

A window without PARTITION BY moves every row to one task. Here the rows are dealt
into ranges of the sort key; each range is numbered on its own, and the totals of
earlier ranges (one row per range) are added. Any bounds give exact results: Spark's
sample only balances the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alloscan.session import cut_lineage, shuffle_width

_FOLD = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def ordered_scan(df: DataFrame, keys: list[str], running: dict[str, tuple[str, Column | str]],
                 descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Add running aggregates over the total order of ``keys`` (a unique key last).

    ``running`` maps an output name to (kind, value): kind is ``count`` (value
    ignored), ``sum``, ``min`` or ``max``; the current row is included.
    """
    vals = {o: (F.lit(1).cast("bigint") if kind == "count" else
                (F.col(v) if isinstance(v, str) else v))
            for o, (kind, v) in running.items()}
    order = [F.col(k).desc() if descending else F.col(k).asc() for k in keys]
    dealt = df.select("*", *[v.alias(f"_v_{o}") for o, v in vals.items()]).repartitionByRange(
        ranges or shuffle_width(df.sparkSession), *order)
    # totals and rows must see the same ranges: they are stored once, with the range's number
    t = cut_lineage(dealt.withColumn("_rng", F.spark_partition_id()))
    upto = Window.unboundedPreceding, Window.currentRow
    # one row per range: this window is bounded by the range count
    carry_w = Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    totals = t.groupBy("_rng").agg(*[_FOLD[k](f"_v_{o}").alias(f"_t_{o}")
                                     for o, (k, _) in running.items()])
    carry = totals.select("_rng", *[_FOLD[k](f"_t_{o}").over(carry_w).alias(f"_c_{o}")
                                    for o, (k, _) in running.items()])
    w = Window.partitionBy("_rng").orderBy(*order).rowsBetween(*upto)
    out = t.join(F.broadcast(carry), "_rng")
    cols = []
    for o, (kind, _) in running.items():
        here, before = _FOLD[kind](f"_v_{o}").over(w), F.col(f"_c_{o}")
        if kind in ("sum", "count"):
            col = here + F.coalesce(before, F.lit(0))
        else:
            col = F.least(here, before) if kind == "min" else F.greatest(here, before)
        cols.append(col.alias(o))
    return out.select(*df.columns, *cols)


def row_position(df: DataFrame, keys: list[str], out: str = "pos0",
                 descending: bool = False) -> DataFrame:
    """0-based position in the total order of ``keys``."""
    return (ordered_scan(df, keys, {out: ("count", "")}, descending)
            .withColumn(out, F.col(out) - 1))


def value_ranks(df: DataFrame, value: str, descending: bool = False) -> DataFrame:
    """One row per distinct value: ``n_tie``, ``rank_min``, ``rank_max``, ``rank_avg``, 1-based.

    Ties are folded before anything is ordered, so a value shared by a third of
    the table is one row here.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n_tie"))
    s = ordered_scan(counts, [value], {"rank_max": ("sum", "n_tie")}, descending)
    return s.select(value, "n_tie", (F.col("rank_max") - F.col("n_tie") + 1).alias("rank_min"),
                    "rank_max", (F.col("rank_max") - (F.col("n_tie") - 1) / 2).alias("rank_avg"))


def attach_by_value(df: DataFrame, ranks: DataFrame, value: str) -> DataFrame:
    """Join per-value results back to the rows (null values keep null results).

    Values holding over 1/1000 of the rows number at most 1000, so they are joined
    by broadcast; all others are light and meet in an ordinary hash shuffle. Rows
    without a light key are spread by a salt instead of sharing the null partition.
    """
    cols = [c for c in ranks.columns if c != value]
    total = ranks.agg(F.sum("n_tie")).scalar()
    is_hot = F.col("n_tie") * 1000 > total
    hot = ranks.where(is_hot).select(F.col(value).alias("_hv"),
                                     *[F.col(c).alias(f"_h_{c}") for c in cols])
    light = ranks.where(~is_hot).select(F.col(value).alias("_lv"), F.lit(0).alias("_ls"),
                                        *[F.col(c).alias(f"_l_{c}") for c in cols])
    t = df.join(F.broadcast(hot), F.col(value) == F.col("_hv"), "left")
    t = t.withColumn("_k", F.when(F.col("_hv").isNull(), F.col(value)))
    t = t.withColumn("_s", F.when(F.col("_k").isNull(), F.floor(F.rand(3) * 1024).cast("int"))
                     .otherwise(F.lit(0)))
    t = t.join(light, (F.col("_k") == F.col("_lv")) & (F.col("_s") == F.col("_ls")), "left")
    return t.select(*df.columns, *[F.coalesce(f"_h_{c}", f"_l_{c}").alias(c) for c in cols])


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, salts: int = 16,
          rank_col: str = "rnk") -> DataFrame:
    """First ``k`` rows of each group; a hot group is thinned per salt before the final rank."""
    pre = Window.partitionBy(*group, "_salt").orderBy(*order)
    fin = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn("_salt", F.pmod(F.hash(*[c for c in df.columns]), F.lit(salts)))
            .withColumn("_r", F.row_number().over(pre)).where(F.col("_r") <= k)
            .withColumn(rank_col, F.row_number().over(fin).cast("bigint"))
            .where(F.col(rank_col) <= k).drop("_salt", "_r"))
