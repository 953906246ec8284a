"""Declared table layouts (DDL, as readers take them) and the required-column check."""

from __future__ import annotations

from pyspark.sql import DataFrame

VARIANT_ROW = ("variant_index bigint, snp_id string, subgenome string, chrom string, "
                 "pos bigint, a1 string, a2 string, dosage array<float>")
TALL_GENOTYPE = ("sample string, snp_id string, dosage tinyint")
SUMSTATS = ("snp_id string, subgenome string, chrom string, pos bigint, beta double, se double, "
              "chi2 double, p double, n_obs bigint, maf double, call_rate double")
BIM = ("chrom string, snp_id string, cm double, pos bigint, a1 string, a2 string")
GENES = ("gene_id string, subgenome string, chrom string, start bigint, end bigint, "
           "strand string, n_snp bigint")
KNOWN_QTL = ("qtl_name string, chrom string, start bigint, end bigint, qtl_pos bigint, "
               "window_bp bigint, qtl_class string")
BLAST6 = ("qseqid string, sseqid string, pident double, length bigint, mismatch bigint, "
            "gapopen bigint, qstart bigint, qend bigint, sstart bigint, send bigint, "
            "evalue double, bitscore double")
LAMBDA_GC = ("scope string, level string, n_markers bigint, lambda_gc double")


def require_columns(df: DataFrame, needed, what: str = "table") -> DataFrame:
    """Return ``df`` or raise naming both the missing and the available columns."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}; available: {df.columns}")
    return df
