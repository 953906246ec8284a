"""Homolog interaction run: burdens -> pair tests -> ranking, weights, permutations, groups."""

from __future__ import annotations

from itertools import combinations
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alloscan.functions import mixed_model as mm
from alloscan.functions import stat_columns as sc
from alloscan.operators import intervals as iv
from alloscan.operators import pair_scan as ps
from alloscan.operators import ranking as rk
from alloscan.operators import relationship as rel
from alloscan.schema import require_columns
from alloscan.session import cut_lineage
from alloscan.sources import sinks
from alloscan.sources.text import parse_gff, subgenome_map


def trait_set(names: list[str]) -> tuple[tuple[str, ...], str]:
    """Frozen trait family and its digest."""
    import hashlib
    if len(set(names)) != len(names) or not names:
        raise ValueError("a trait set needs distinct trait names")
    return tuple(names), hashlib.sha256("\0".join(names).encode()).hexdigest()[:16]


def prepare_snps(spark: SparkSession, gff: str, bims: dict[str, DataFrame], sgmap: DataFrame, flank_bp: int = 0,
                 min_snp: int = 1, feature: str = "gene", id_attr: str = "ID") -> tuple[DataFrame, DataFrame]:
    """Genes with marker counts, and the (subgenome, gene_id, snp_idx) map of each subgenome.

    ``bims``: subgenome -> (variant_index, chrom, pos). Duplicate gene ids are an error.
    """
    m = subgenome_map(sgmap).select("chrom", "subgenome")
    genes = parse_gff(spark.read.text(gff), feature, id_attr).join(F.broadcast(m), "chrom")
    dup = genes.groupBy("gene_id").count().where("count > 1").limit(5).collect()
    if dup:
        raise ValueError(f"gene ids repeat: {[r[0] for r in dup]}")
    snp = None
    for s, b in bims.items():
        x = b.select(F.lit(s).alias("sub"), "variant_index", "chrom", "pos")
        snp = x if snp is None else snp.unionByName(x)
    hit = iv.points_in_intervals(snp, genes, F.col("start") - flank_bp, F.col("end") + flank_bp).where("sub = subgenome")
    per = hit.groupBy("subgenome", "gene_id").agg(F.sort_array(F.collect_list("variant_index")).alias("snp_idx")).where(F.size("snp_idx") >= min_snp)
    table = genes.join(per.select("gene_id", F.size("snp_idx").cast("bigint").alias("n_snp")), "gene_id").select(
        "gene_id", "subgenome", "chrom", "start", "end", "strand", "n_snp")
    return table, per


def run_interact(spark: SparkSession, dosages: DataFrame, snp_gene: DataFrame, groups: DataFrame, pheno: DataFrame, traits: list[str],
                 out_dir: str, subgenomes: list[str], cap: int | None = 150, n_perm: int = 0, transform: str = "INT", n_pcs: int = 0,
                 weights: DataFrame | None = None, dominance: bool = False) -> dict:
    """Pair scan (two subgenomes), group scan (more), or a frozen multi-trait pair scan.

    ``dosages``: tall ``s, v, sub, d``; ``snp_gene``: ``v, gene, chrom, pos``; ``groups``: one row
    per group with ``gene_<S>`` columns; ``pheno``: ``s`` and trait columns.
    """
    from alloscan.operators import genotype as gt
    if len(subgenomes) < 2:
        raise ValueError("an interaction needs at least two subgenomes")
    require_columns(groups, [f"gene_{s}" for s in subgenomes], "groups")
    names, digest = trait_set(traits)
    cc = pheno.select("s", *names).dropna(how="any").join(dosages.select("s").distinct(), "s", "left_semi")
    ids = rel.panel_of(cc)
    if len(ids) < 10:
        raise ValueError(f"only {len(ids)} complete samples; at least 10 are needed")
    rows = cc.orderBy("s").collect()  # the bounded panel
    vals = {t: np.array([float(r[t]) for r in rows]) for t in names}
    keep = spark.createDataFrame([(i,) for i in ids], dosages.select("s").schema)
    geno = dosages.join(F.broadcast(keep), "s", "left_semi")
    stats = gt.allele_stats(geno.select("s", "v", "d"), len(ids))
    wide = gt.wide_variants(geno.select("s", "v", "d"), ids, dosages.select("v", "sub").distinct())
    parts = rel.gram_parts(wide, len(ids), "sub")
    kernels = {s: mm.pull_psd(m, 1e-6) for s, m in sorted(rel.dense(rel.grm(parts), len(ids)).items())}
    c = mm.covariates(kernels, len(ids), n_pcs) if n_pcs else None
    x = np.ones((len(ids), 1)) if c is None else c
    burden = cut_lineage(ps.burden_vectors(geno.select("s", "v", "d"), stats, snp_gene, ids, cap))
    y = {t: (mm.normal_scores(v) if transform == "INT" else v) for t, v in vals.items()}
    ctx = {t: (mm.whitener(v, x, kernels, 42 + i)[0], v, c) for i, (t, v) in enumerate(y.items())}
    g = groups.withColumn("grp", F.concat_ws("|", *[f"gene_{s}" for s in subgenomes]))
    pairs = None
    for a, b in combinations(subgenomes, 2):
        one = g.select("grp", F.col(f"gene_{a}").alias("gene_x"), F.col(f"gene_{b}").alias("gene_y"), F.lit(a).alias("sub_x"), F.lit(b).alias("sub_y"))
        pairs = one if pairs is None else pairs.unionByName(one)
    tests = cut_lineage(ps.pair_tests(pairs, burden, ctx, dominance))
    out = Path(out_dir)
    doc = {"traits": list(names), "trait_set_digest": digest, "n": len(ids), "transform": transform, "subgenomes": subgenomes}
    if len(subgenomes) == 2 and len(names) == 1:
        ranked = ps.pair_ranking(tests, ps.marginal_tests(burden, ctx[names[0]]), ps.gene_sizes(snp_gene))
        a, b = subgenomes
        names_out = {f"{c}_{side}": f"{c}_{s}" for c in ("gene", "n_snp", "gene_len") for side, s in (("x", a), ("y", b))}
        sinks.write_ranking(ranked.withColumnsRenamed(names_out), f"{out}/pair_ranking", ["rank"])
        yy = y[names[0]]
        resid = yy - x @ np.linalg.lstsq(x, yy, rcond=None)[0]
        sinks.write_tsv(ps.top_burdens(ranked, burden, yy, resid), f"{out}/top_burdens", gzip=False)
        p = "p_interaction"
    else:
        if len(names) == 1:
            ranked = ps.group_table(tests, g.select("grp", *[f"gene_{s}" for s in subgenomes]), subgenomes, ps.gene_sizes(snp_gene))
        else:
            ranked = ps.group_ranking(tests, ["grp"] if len(subgenomes) > 2 else ["grp", "gene_x", "gene_y"])
        sinks.write_ranking(ranked, f"{out}/group_ranking", ["rank"])
        p = "p_acat"
    ranked = cut_lineage(ranked)
    s = ranked.agg(F.count("*").alias("g"), sc.acat(F.col(p)).alias("acat"), F.min(p).alias("min_p")).first()
    doc |= {"G": s["g"], "acat": s["acat"], "min_p": s["min_p"], "bonferroni_alpha": 0.05 / max(s["g"], 1),
            "n_sig": ranked.where(F.col(p) < 0.05 / max(s["g"], 1)).count()}
    if weights is not None and p == "p_interaction":
        w = rk.unit_mean_weights(ranked.select("gene_x", "gene_y", p).join(weights.select("gene_x", "gene_y", F.col("weight")), ["gene_x", "gene_y"], "left"), "weight", "w")
        wb = rk.bonferroni(w, p, "w")
        z = wb.agg(sc.acat_weighted(F.col(p), F.col("w")).alias("a"), F.count_if("sig").alias("n")).first()
        doc["weighted"] = {"acat_weighted": z["a"], "n_sig": z["n"]}
    if n_perm:
        doc["permutation"] = ps.permutation_summary(pairs, burden, y, x, kernels, n_perm, c).first().asDict()
    sinks.write_json(doc, f"{out}/summary.json")
    return doc
