"""Result writers: partitioned tables first, delimited text and JSON summaries beside them."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sumstats(df: DataFrame, path: str) -> None:
    """Parquet by subgenome, sorted inside files so that a window reads few row groups."""
    (df.repartitionByRange("subgenome", "chrom", "pos").sortWithinPartitions("subgenome", "chrom", "pos")
     .write.mode("overwrite").partitionBy("subgenome").parquet(path))


def write_tsv(df: DataFrame, path: str, gzip: bool = True) -> None:
    """Tab-separated parts with header; doubles keep full precision."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, compression="gzip" if gzip else "none")


def append_tsv(df: DataFrame, path: str, gzip: bool = True) -> None:
    df.write.mode("append").csv(path, sep="\t", header=True, compression="gzip" if gzip else "none")


def write_ranking(df: DataFrame, path: str, order: list[str]) -> None:
    """Ranking table in rank order over its files."""
    write_tsv(df.repartitionByRange(*order).sortWithinPartitions(*order), path, gzip=False)


def write_kernels(k: DataFrame, path: str) -> None:
    """Tall kernels ``(grp, i, j, k)``."""
    k.write.mode("overwrite").partitionBy("grp").parquet(path)


def read_kernels(spark, path: str, samples: list) -> DataFrame:
    """Stored kernels with their checks: finite, unique cells, square over the sample list."""
    k = spark.read.parquet(path)
    n = len(samples)
    if len(set(samples)) != n:
        raise ValueError("sample ids of the stored kernel repeat")
    bad = k.agg(F.count_if(F.isnan("k") | F.col("k").isNull()).alias("nan"), F.max("j").alias("j"), F.count("*").alias("n"),
                F.count_distinct("grp", "i", "j").alias("u")).first()
    if bad["nan"] or bad["n"] != bad["u"] or (bad["j"] is not None and bad["j"] >= n):
        raise ValueError("stored kernel is not a finite square matrix over the samples")
    return k


def write_json(doc: dict, path: str) -> None:
    def plain(o):
        if isinstance(o, np.generic):
            return o.item()
        if isinstance(o, np.ndarray):
            return o.tolist()
        raise TypeError(f"cannot write {type(o)}")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(doc, indent=2, default=plain))
