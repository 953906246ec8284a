"""Readers for the text formats around a study. Each parser takes a table of lines.

``read_lines`` adds a total order of lines across splits, which the stateful formats
(collinearity blocks, FASTA) need for their forward fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alloscan.operators.scan_order import ordered_scan
from alloscan.schema import require_columns


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Lines with (path, split start, row in split) as their order; .gz is read as is."""
    t = spark.read.text(path)
    return t.select("value", F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))


LINE_ORDER = ["file", "split", "row"]


def read_table(spark: SparkSession, path, schema, sep: str = "\t", needed=()) -> DataFrame:
    """Delimited table with header under a declared schema (never inferred)."""
    return require_columns(spark.read.csv(path, sep=sep, header=True, schema=schema), needed, str(path))


def gff_attribute(attrs: Column, key: str) -> Column:
    """Value of ``key`` in GFF3 ``k=v`` or GTF ``k v`` attributes, quotes stripped; null when absent or empty.

    Fields end at semicolons; a field with an equals sign is of the first kind, others are of the second.
    """
    def parts(field: Column) -> Column:
        text = F.trim(field)
        at = F.instr(text, "=")
        blank = F.length(F.regexp_extract(text, r"^\S*", 0))
        cut = F.when(at > 0, at - 1).otherwise(blank)
        return F.struct(F.trim(F.substr(text, F.lit(1), cut)).alias("k"),
                        F.trim(F.substr(text, cut + F.when(at > 0, 2).otherwise(1))).alias("v"))
    own = F.filter(F.transform(F.split(attrs, ";"), parts), lambda x: x["k"] == key)
    return F.nullif(F.regexp_replace(F.get(own, F.lit(0))["v"], r'^"+|"+$', ""), F.lit(""))


def parse_gff(lines: DataFrame, feature: str = "gene", id_attr: str = "ID", keep_chroms=None) -> DataFrame:
    c = F.split("value", "\t")
    g = lines.where(~F.col("value").startswith("#") & (F.size(c) >= 9) & (F.get(c, F.lit(2)) == feature)).select(
        gff_attribute(F.get(c, F.lit(8)), id_attr).alias("gene_id"), F.get(c, F.lit(0)).alias("chrom"), F.get(c, F.lit(3)).cast("bigint").alias("start"),
        F.get(c, F.lit(4)).cast("bigint").alias("end"), F.get(c, F.lit(6)).alias("strand"))
    g = g.where(F.col("gene_id").isNotNull())
    return g if keep_chroms is None else g.where(F.col("chrom").isin(list(keep_chroms)))


def parse_genes_any(lines: DataFrame) -> DataFrame:
    """Gene track rows: name by priority of attributes, then position; strand defaults to +."""
    c = F.split("value", "\t")
    name = F.coalesce(*[gff_attribute(F.get(c, F.lit(8)), k) for k in ("gene_name", "Name", "gene_id", "ID")],
                      F.concat(F.get(c, F.lit(0)), F.lit(":"), F.get(c, F.lit(3))))
    return lines.where(~F.col("value").startswith("#") & (F.size(c) >= 9) & (F.get(c, F.lit(2)) == "gene")).select(
        name.alias("name"), F.get(c, F.lit(0)).alias("chrom"), F.get(c, F.lit(3)).cast("bigint").alias("start"), F.get(c, F.lit(4)).cast("bigint").alias("end"),
        F.when(F.get(c, F.lit(6)).isin("+", "-"), F.get(c, F.lit(6))).otherwise("+").alias("strand"))


def vcf_samples(lines: DataFrame) -> list[str]:
    """Sample names: fields 10 and on of the #CHROM line."""
    h = lines.where(F.col("value").startswith("#CHROM")).select(F.split("value", "\t").alias("c")).first()
    if h is None:
        raise ValueError("no #CHROM header line")
    return list(h["c"][9:])


def parse_vcf(lines: DataFrame, multiallelic: bool = False) -> DataFrame:
    """One row per variant: position, alleles and first-alternate dosage per sample (null = missing)."""
    c = F.split("value", "\t")
    v = lines.where(~F.col("value").startswith("#")).select(c.alias("c"))
    v = v if multiallelic else v.where(~F.get("c", F.lit(4)).contains(","))

    def dose(call):
        gt = F.split(F.get(F.split(call, ":"), F.lit(0)), r"[/|]")
        return F.when(F.exists(gt, lambda a: a == "."), None).otherwise(
            F.aggregate(gt, F.lit(0.0), lambda s, a: s + F.when(a == "1", 1.0).otherwise(0.0)))
    return v.select(F.get("c", F.lit(0)).alias("chrom"), F.get("c", F.lit(1)).cast("bigint").alias("pos"),
                    F.when(F.get("c", F.lit(2)) == ".", F.concat_ws(":", F.get("c", F.lit(0)), F.get("c", F.lit(1)))).otherwise(F.get("c", F.lit(2))).alias("snp_id"),
                    F.get("c", F.lit(3)).alias("ref"), F.get("c", F.lit(4)).alias("alt"),
                    F.transform(F.slice("c", F.lit(10), F.greatest(F.size("c") - 9, F.lit(0))), dose).alias("dosage"))


def call_to_gt(call: Column, ref: Column, alt: Column) -> Column:
    """Two-letter call -> 0/0, 0/1, 1/1; unknown letters, '-' and 'N' -> ./."""
    a, b = F.substring(call, 1, 1), F.substring(call, 2, 1)
    ok = a.isin("A", "C", "G", "T") & b.isin("A", "C", "G", "T")
    ra, rb = a == ref, b == ref
    known = (ra | (a == alt)) & (rb | (b == alt))
    return (F.when(~(ok & known), "./.").when(ra & rb, "0/0").when(ra | rb, "0/1").otherwise("1/1"))


def fill_ids(snp: Column, chrom: Column, pos: Column) -> Column:
    return F.when(snp == ".", F.concat_ws(":", chrom, pos.cast("string"))).otherwise(snp)


def parse_fasta(lines: DataFrame, order: list[str]) -> DataFrame:
    """Sequence pieces ``(chrom, start, seq)`` with 1-based start of each line in its record."""
    head = F.col("value").startswith(">")
    name = F.split(F.expr("substring(value, 2)"), r"\s+")[0]
    s = ordered_scan(
        lines.select(*order, "value", F.when(head, F.struct(*order, name.alias("name"))).alias("_h"),
                     F.when(head, 0).otherwise(F.length(F.trim("value"))).cast("bigint").alias("_len")),
        order, {"_rec": ("max", "_h"), "_end": ("sum", "_len")})
    base = s.where(head).select(F.col("_rec").alias("_rec"), F.col("_end").alias("_off"))
    return (s.where(~head).join(base, "_rec").select(
        F.col("_rec.name").alias("chrom"), (F.col("_end") - F.col("_len") - F.col("_off") + 1).alias("start"),
        F.upper(F.trim("value")).alias("seq")).where(F.length("seq") > 0))


def fasta_bases(pieces: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """Reference base per site ``(key, chrom, pos)``; sites outside every record stay null."""
    from alloscan.operators.intervals import points_in_intervals
    hit = points_in_intervals(sites.select(key, "chrom", "pos"), pieces, F.col("start"),
                              F.col("start") + F.length("seq") - 1, 1000)
    base = hit.select(key, F.substring("seq", (F.col("pos") - F.col("start") + 1).cast("int"), F.lit(1)).alias("base"))
    return sites.join(base, key, "left")


def record_lengths(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("chrom").agg(F.sum(F.length("seq")).alias("length"))


def parse_blast6(lines: DataFrame) -> DataFrame:
    """Tabular hits; rows with fewer than 12 fields or a bad score are skipped."""
    c = F.split("value", "\t")
    # fixed values: column names of the tabular format
    names = ["qseqid", "sseqid", "pident", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", "bitscore"]
    kinds = ["string", "string", "double"] + ["bigint"] * 7 + ["double", "double"]
    t = lines.withColumn("c", c).where(F.size("c") >= 12).select(
        *[F.get("c", F.lit(i)).try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))])
    return t.where(F.col("bitscore").isNotNull())


def parse_collinearity(lines: DataFrame, order: list[str], chroms: tuple[str, str] = ("aa", "dd"),
                       marks: tuple[str, str] = ("_A", "_D")) -> DataFrame:
    """Gene pairs of the blocks between two subgenomes, the first subgenome's gene first.

    A header names its block before the colon and two chromosomes joined by ``&``; only blocks with one
    chromosome of either prefix count. The pair lines below it have, behind a colon, two genes and an
    e-value (1 if it is no number), and count if one gene holds either mark.
    """
    v = F.col("value")
    fields = F.filter(F.split(F.substr(v, F.instr(v, ":") + 1), r"\s+"), lambda x: x != "")
    left = F.trim(F.substring_index(v, ":", 1))
    is_head = F.startswith(v, F.lit("## Alignment ")) & F.contains(v, F.lit("&"))
    names = F.split(F.get(F.filter(fields, lambda x: F.contains(x, F.lit("&"))), F.lit(0)), "&")
    x, y = F.get(names, F.lit(0)), F.get(names, F.lit(1))
    between = lambda a, b: F.startswith(a, F.lit(chroms[0])) & F.startswith(b, F.lit(chroms[1]))
    head = F.struct(*order, F.substring_index(left, " ", -1).try_cast("bigint").alias("block"), F.concat_ws("&", x, y).alias("pair"),
                    (between(x, y) | between(y, x)).alias("inter"))
    s = ordered_scan(lines.select(*order, "value", F.when(is_head, head).alias("_h")), order, {"_b": ("max", "_h")})
    one, two = F.get(fields, F.lit(0)), F.get(fields, F.lit(1))
    ordered = lambda a, b: F.contains(a, F.lit(marks[0])) & F.contains(b, F.lit(marks[1]))
    return (s.where(F.col("_b.inter") & left.rlike(r"^\d+-\s*\d+$") & (F.size(fields) >= 3))
            .where(ordered(one, two) | ordered(two, one)).select(
                F.col("_b.block").alias("block"), F.col("_b.pair").alias("header_pair"),
                F.when(ordered(one, two), one).otherwise(two).alias("gene1"), F.when(ordered(one, two), two).otherwise(one).alias("gene2"),
                F.coalesce(F.get(fields, F.lit(2)).try_cast("double"), F.lit(1.0)).alias("e_value"), *order))


def expression_matrix(quant: DataFrame, genotypes: list[str]) -> DataFrame:
    """Per-run transcript quantities -> gene x genotype sums; missing cells are 0."""
    g = F.regexp_replace("transcript", r"\.t[^.]*$", "")
    return quant.groupBy(g.alias("gene")).pivot("genotype", genotypes).agg(F.sum("tpm")).na.fill(0.0)


def subgenome_map(df: DataFrame, chrom_col: str = "chrom", sub_col: str = "subgenome") -> DataFrame:
    """Chromosome map; a chromosome listed twice is an error."""
    require_columns(df, [chrom_col, sub_col], "subgenome map")
    dup = df.groupBy(chrom_col).count().where("count > 1").limit(5).collect()
    if dup:
        raise ValueError(f"chromosomes mapped more than once: {[r[0] for r in dup]}")
    return df


def phenotype_means(df: DataFrame, sample_col: str, trait: str) -> DataFrame:
    """Average duplicate sample rows, drop missing values."""
    require_columns(df, [sample_col, trait], "phenotype")
    ok = df.where(F.col(trait).isNotNull() & ~F.isnan(trait))
    return ok.groupBy(F.col(sample_col).cast("string").alias("sample")).agg(F.avg(trait).alias(trait))
