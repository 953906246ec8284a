"""Splitting a genotype set by subgenome: routing, filters and the plan of outputs."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alloscan.sources.config import SpeciesConfig
from alloscan.sources.plink import read_bed, write_bed, sample_ids
from alloscan.sources.text import parse_vcf, vcf_samples


def split_filter(stats: DataFrame, chroms: dict[str, list[str]], spark: SparkSession, maf: float = 0.0, geno: float = 1.0) -> DataFrame:
    """Markers of each subgenome that pass the frequency and missingness limits; ids chrom:pos.

    The chromosome map is the karyotype, a few dozen rows, hence the broadcast.
    """
    cmap = spark.createDataFrame([(s, c) for s, cs in chroms.items() for c in cs], "subgenome string, chrom string")
    out = stats.join(F.broadcast(cmap), "chrom")
    if maf > 0:
        out = out.where(F.col("maf") >= maf)
    if geno < 1:
        out = out.where(1 - F.col("call_rate") <= geno)
    return out.withColumn("snp_id", F.concat_ws(":", "chrom", F.col("pos").cast("string")))


def hwe_chi2(n0, n1, n2):
    """One-df Hardy-Weinberg chi-square of genotype counts (used only when a limit is set)."""
    n = n0 + n1 + n2
    p = (2 * n0 + n1) / (2 * n)
    e0, e1, e2 = n * p * p, 2 * n * p * (1 - p), n * (1 - p) * (1 - p)
    return sum((F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0) for o, e in ((n1, e1), (n2, e2))), F.when(e0 > 0, (n0 - e0) * (n0 - e0) / e0).otherwise(0.0))


@dataclass
class Work:
    subgenome: str
    chroms: list[str]
    sources: list[str]
    target: str
    status: str = "PLANNED"
    message: str = ""


@dataclass
class Plan:
    works: list[Work] = field(default_factory=list)


def route_chromosomes(files: list[str], chroms: list[str]) -> list[str]:
    """One file per chromosome: exact stem, then ``chr`` added, then ``chr`` removed, then containment."""
    stems = {Path(f).name.split(".")[0]: f for f in files}
    out = []
    for c in chroms:
        bare = c[3:] if c.lower().startswith("chr") else c
        hit = stems.get(c) or stems.get("chr" + c) or stems.get(bare)
        if hit is None:
            inside = sorted(f for s, f in stems.items() if c in s)
            hit = inside[0] if inside else None
        if hit is None:
            raise ValueError(f"no genotype file for chromosome {c}; have {sorted(stems)}")
        out.append(hit)
    return out


def plan_split(cfg: SpeciesConfig, out_dir: str) -> Plan:
    works = []
    for sg in cfg.subgenomes:
        target = str(Path(out_dir) / sg.id / "all")
        if cfg.geno.vcf_dir:
            src = route_chromosomes(sorted(str(p) for p in Path(cfg.geno.vcf_dir).glob("*.vcf*")), sg.chroms)
        else:
            src = [cfg.geno.vcf or cfg.geno.bed_root]
        done = Path(target + ".bed").exists()
        works.append(Work(sg.id, sg.chroms, src, target, "SKIPPED_EXISTING" if done else "PLANNED"))
    return Plan(works)


def execute_split(spark: SparkSession, plan: Plan, cfg: SpeciesConfig, dry_run: bool = False, force: bool = False) -> Plan:
    """Read, filter and write each planned subgenome; one failure does not stop the others."""
    for w in plan.works:
        if dry_run or (w.status == "SKIPPED_EXISTING" and not force):
            continue
        try:
            if w.sources[0].endswith((".vcf", ".vcf.gz")):
                lines = spark.read.text(w.sources)
                samples = vcf_samples(spark.read.text(w.sources[0]))
                v = parse_vcf(lines).select("chrom", "pos", F.col("alt").alias("a1"), F.col("ref").alias("a2"), "dosage").where(
                    (F.length("a1") == 1) & (F.length("a2") == 1))
            else:
                samples = sample_ids(w.sources[0])
                v = read_bed(spark, w.sources[0]).select("chrom", "pos", "a1", "a2", "dosage")
            seen = F.filter("dosage", lambda x: x.isNotNull())
            af = F.aggregate(seen, F.lit(0.0), lambda s, x: s + x) / F.size(seen) / 2
            v = v.withColumn("call_rate", F.size(seen) / F.lit(len(samples))).withColumn("maf", F.when(F.size(seen) > 0, F.least(af, 1 - af)).otherwise(0.0))
            if cfg.qc.hwe is not None:
                n = [F.size(F.filter("dosage", lambda x, k=k: x == k)) for k in (0.0, 1.0, 2.0)]
                from alloscan.functions.stat_columns import chi2_sf1
                v = v.where((F.size(seen) > 0) & (chi2_sf1(hwe_chi2(*n)) >= cfg.qc.hwe))
            v = split_filter(v, {w.subgenome: w.chroms}, spark, cfg.qc.maf, cfg.qc.geno)
            # file order of the target: chromosome, position, alleles
            from alloscan.operators.scan_order import row_position
            v = row_position(v, ["chrom", "pos", "a1", "a2"], "variant_index")
            n_out = write_bed(v, w.target, samples)
            w.status, w.message = "OK", f"{n_out} markers"
        except Exception as e:  # the plan reports each subgenome's outcome
            w.status, w.message = "ERROR", str(e)[:500]
    return plan
