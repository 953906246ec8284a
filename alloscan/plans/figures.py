"""Figure frames: the data behind each figure, as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gene_track(loci: DataFrame, genes: DataFrame, half: int, bin_bp: int = 100_000) -> DataFrame:
    """Genes overlapping each locus window, packed into the fewest display rows (greedy by start).

    ``loci``: ``locus, chrom, center``; ``genes``: ``chrom, gname, gstart, gend``. A group is one
    fixed window, whose genes are bounded by its width.
    """
    w = loci.withColumn("lo", F.col("center") - half).withColumn("hi", F.col("center") + half)
    a = w.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / bin_bp), F.floor(F.col("hi") / bin_bp))))
    g = genes.withColumn("b", F.explode(F.sequence(F.floor(F.col("gstart") / bin_bp), F.floor(F.col("gend") / bin_bp))))
    hit = a.join(g, ["chrom", "b"]).where((F.col("gstart") <= F.col("hi")) & (F.col("gend") >= F.col("lo"))).drop("b").dropDuplicates(["locus", "gname"])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gstart", "gend", "gname"])
        ends, rows = [], []
        for s, e in zip(pdf["gstart"], pdf["gend"]):
            k = next((i for i, x in enumerate(ends) if x < s), len(ends))
            if k == len(ends):
                ends.append(e)
            else:
                ends[k] = e
            rows.append(k)
        return pdf[["locus", "gname", "gstart", "gend"]].assign(track=rows)
    return hit.select("locus", "gname", "gstart", "gend").groupBy("locus").applyInPandas(
        pack, "locus bigint, gname string, gstart bigint, gend bigint, track bigint")
