"""Locus frames from finished results: leads, windows, LD to the lead, genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alloscan.operators.clumping import spaced_leads
from alloscan.operators.intervals import points_in_intervals


def results(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/sumstats")


def leads(stats: DataFrame, top_n: int = 3, apart_bp: int = 1_000_000, subgenome: str | None = None) -> DataFrame:
    s = stats.where(F.col("p").isNotNull() & ~F.isnan("p"))
    if subgenome is not None:
        s = s.where(F.col("subgenome") == subgenome)
    return spaced_leads(s.select("chrom", "pos", "p", F.col("snp_id").alias("id")), top_n, apart_bp)


def windows(stats: DataFrame, lead: DataFrame, half_bp: int = 500_000) -> DataFrame:
    """Markers within the half window of each lead."""
    w = lead.select("chrom", F.col("id").alias("lead_snp"), F.col("pos").alias("lead_pos"))
    return points_in_intervals(stats, w, F.col("lead_pos") - half_bp, F.col("lead_pos") + half_bp)


def one_window(stats: DataFrame, chrom: str, center: int, half_bp: int, subgenome: str | None = None) -> DataFrame:
    """A single window: plain predicates, so partitions and row groups outside are skipped."""
    s = stats.where((F.col("chrom") == chrom) & F.col("pos").between(center - half_bp, center + half_bp))
    return s if subgenome is None else s.where(F.col("subgenome") == subgenome)


def plot_points(stats: DataFrame, max_points: int = 300_000, keep_p: float = 1e-3) -> DataFrame:
    """Manhattan and QQ frame: all strong markers, every stride-th of the rest."""
    from alloscan.operators.scan_order import row_position
    s = stats.where(F.col("p").isNotNull() & ~F.isnan("p"))
    n_bg = s.where(F.col("p") > keep_p).count()
    stride = max(1, -(-n_bg // max_points))
    bg = row_position(s.where(F.col("p") > keep_p), ["subgenome", "chrom", "pos", "snp_id"], "bg0")
    return s.where(F.col("p") <= keep_p).unionByName(bg.where(F.col("bg0") % stride == 0).drop("bg0"))
