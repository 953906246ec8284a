"""Genetics view of the driver tables.

A marker is a run of four parts, so markers grow with the data; a sample is one of
40 supplier classes, so the panel is bounded, as in a field panel. Absent rows are
missing calls. QTLs come from suppliers, gene intervals from customers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alloscan.operators import genotype as gt
from alloscan.operators import score_scan as scan

PANEL = 40
PARTS_PER_MARKER = 4


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chrom_of(k: Column) -> Column:
    return F.concat((F.floor(k / 3) + 1).cast("string"),
                    F.substring(F.lit("ABD"), 1 + (k % 3).cast("int"), F.lit(1)))


def geno(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    return (li.groupBy((F.col("l_suppkey") % PANEL).alias("s"),
                       F.floor(F.col("l_partkey") / PARTS_PER_MARKER).alias("v"))
            .agg(F.least(F.lit(2), F.count_if(F.col("l_quantity") > 40)).cast("bigint").alias("d")))


def with_map(df: DataFrame) -> DataFrame:
    """Add marker coordinates computed from ``v`` (no join)."""
    v = F.col("v")
    j = F.floor(v / 9)
    out = (df.withColumn("snp", F.concat(F.lit("m"), v.cast("string"))).withColumn("k", v % 9)
           .withColumn("j", j).withColumn("base", (F.floor((v % 9) / 3) + 1).cast("bigint"))
           .withColumn("sub", F.substring(F.lit("ABD"), 1 + (v % 3).cast("int"), F.lit(1)))
           .withColumn("chrom", chrom_of(v % 9)).withColumn("pos", j * 100000 + 1)
           .withColumn("jj", F.floor(j / 5)))
    return out.withColumn("gene", F.concat(F.lit("G"), "chrom", F.lit("_"), F.col("jj").cast("string")))


def markers(spark: SparkSession, d: str, calls: DataFrame | None = None) -> DataFrame:
    """All markers; ``calls`` is a genotype table that is at hand already."""
    if calls is not None:
        return with_map(calls.select("v").distinct())
    li = table(spark, d, "lineitem")
    return with_map(li.select(F.floor(F.col("l_partkey") / PARTS_PER_MARKER).alias("v")).distinct())


def _mean_cents(df: DataFrame, key: str, val: str) -> DataFrame:
    return (df.groupBy((F.col(key) % PANEL).alias("s"))
            .agg((F.sum(F.round(F.col(val) * 100).cast("bigint")).cast("double")
                  / F.count("*") / 100).alias("y")))


def pheno(spark: SparkSession, d: str) -> DataFrame:
    return _mean_cents(table(spark, d, "supplier"), "s_suppkey", "s_acctbal")


def pheno2(spark: SparkSession, d: str) -> DataFrame:
    p2 = _mean_cents(table(spark, d, "customer"), "c_custkey", "c_acctbal")
    return p2.join(F.broadcast(pheno(spark, d).select("s")), "s", "left_semi")


def panel_size(spark: SparkSession, d: str) -> Column:
    return pheno(spark, d).agg(F.count("*")).scalar()


def stats(spark: SparkSession, d: str, calls: DataFrame | None = None) -> DataFrame:
    return gt.allele_stats(geno(spark, d) if calls is None else calls, panel_size(spark, d))


def sumstats(spark: SparkSession, d: str, trait: int = 1, p: bool = True, calls: DataFrame | None = None) -> DataFrame:
    ph = pheno(spark, d) if trait == 1 else pheno2(spark, d)
    out = scan.null_scan(geno(spark, d) if calls is None else calls, scan.centered_trait(ph))
    out = with_map(out.withColumn("chi2", F.round("chi2", 9)))
    return scan.with_p(out) if p else out


def genes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    i = F.floor(F.col("c_custkey") / 9)
    return c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("gene_id"),
                    F.col("c_custkey").alias("gid"), chrom_of(F.col("c_custkey") % 9).alias("chrom"),
                    (i * 33000 + 1).alias("start"),
                    (i * 33000 + 501 + F.col("c_nationkey") * 2000).cast("bigint").alias("end"))


def qtl(spark: SparkSession, d: str, window_bp: int = 300000) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    return s.select(F.concat(F.lit("Q"), k.cast("string")).alias("qtl"), k.alias("qid"),
                    chrom_of(k % 9).alias("chrom"),
                    (F.floor(k / 9) * 500000 + (k * 7919) % 100000).alias("qpos"),
                    F.lit(window_bp).cast("bigint").alias("win"))
