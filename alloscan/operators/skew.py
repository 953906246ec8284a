"""Joins whose left side may hold hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Parts of a hot key's rows.
SALTS = 64


def hot_keys(rows: DataFrame, key: str, n: int, share: float = 1e-3) -> list:
    """The keys with more than ``share`` of ``n`` rows: about 1 / share at most, so the driver may hold them."""
    return [r[0] for r in rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > share * n).select(key).collect()]


def with_least(edges: DataFrame, key: str, value: str, hot: list) -> DataFrame:
    """``edges`` with ``m``, the least ``value`` of their ``key``. The edges of a ``hot`` key are dealt to SALTS parts, each with its least."""
    least = edges.groupBy(key).agg(F.min(value).alias("m"))
    if not hot:
        return edges.join(least, key)
    is_hot = F.col(key).isin(hot)
    salt = F.when(is_hot, F.pmod(F.hash(value), F.lit(SALTS))).otherwise(0)
    parts = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return edges.withColumn("_salt", salt).join(least.withColumn("_salt", parts), [key, "_salt"]).drop("_salt")


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, of which a few may hold most of the left rows and few of the right.

    The join is stated plainly, as ``inner``, ``left`` or ``left_semi``: at run time Spark knows the
    sizes of the shuffled partitions, splits a large left one and sends each part the key's right rows
    (``spark.sql.adaptive.skewJoin``). Counting keys beforehand would read the left side twice.
    """
    return left.join(right, keys, how)
