"""Demonstration panel: allele draws per marker from a seed, in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alloscan.sources.plink import write_bed


def demo_genotypes(markers: DataFrame, n_samples: int, seed: int) -> DataFrame:
    """Per marker ``v``: allele frequency U(0.05, 0.5) and binomial dosages, seeded by marker."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for v in pdf["v"]:
                rng = np.random.default_rng([seed, int(v)])
                maf = rng.uniform(0.05, 0.5)
                rows.append((int(v), float(maf), rng.binomial(2, maf, n_samples).astype(float).tolist()))
            yield pd.DataFrame(rows, columns=["v", "maf", "dosage"])
    return markers.mapInPandas(run, "v bigint, maf double, dosage array<double>")


def make_demo(spark: SparkSession, out_dir: str, n_samples: int = 120, n_snp: int = 250, n_causal: int = 6,
              h2: float = 0.5, seed: int = 7) -> dict:
    """Write a two-subgenome panel with bed files and a phenotype table; returns their paths."""
    samples = [f"line{i:03d}" for i in range(n_samples)]
    gen = demo_genotypes(spark.range(2 * n_snp).withColumnRenamed("id", "v"), n_samples, seed)
    v = gen.select("v", F.when(F.col("v") < n_snp, "A").otherwise("B").alias("sub"), (F.col("v") % n_snp).alias("j"), "dosage")
    v = v.select("*", F.concat("sub", F.when(F.col("j") < n_snp // 2, "1").otherwise("2")).alias("chrom"),
                 (F.col("j") % (n_snp // 2) * 1000 + 1000).alias("pos"))
    paths = {}
    for s in ("A", "B"):
        paths[s] = f"{out_dir}/{s}/all"
        write_bed(v.where(F.col("sub") == s).select(
            F.col("j").alias("variant_index"), F.concat(F.lit(s), F.lit("_snp"), F.col("j").cast("string")).alias("snp_id"),
            "chrom", "pos", F.lit("A").alias("a1"), F.lit("G").alias("a2"), F.col("dosage").cast("array<float>").alias("dosage")), paths[s], samples)
    step = max(1, 2 * n_snp // n_causal)
    causal = v.where((F.col("v") % step == 0) & (F.col("v") < step * n_causal)).orderBy("v").collect()  # n_causal rows
    rng = np.random.default_rng(seed)
    z = np.array([np.asarray(c["dosage"]) for c in causal])
    z = (z - z.mean(1, keepdims=True)) / np.where(z.std(1, keepdims=True) > 0, z.std(1, keepdims=True), 1)
    g = rng.standard_normal(len(causal)) @ z
    g = g / g.std() * np.sqrt(h2)
    y = g + rng.standard_normal(n_samples) * np.sqrt(1 - h2)
    with open(f"{out_dir}/phenotype.tsv", "w") as fh:
        fh.write("sample\ttrait\n" + "".join(f"{s}\t{v!r}\n" for s, v in zip(samples, map(float, y))))
    paths["phenotype"] = f"{out_dir}/phenotype.tsv"
    return paths
