"""Queries that push the tables through the text and binary formats of a study."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from alloscan.catalog import tables as t
from alloscan.catalog.kernel_queries import panel, wide
from alloscan.catalog.registry import big, query, r
from alloscan.operators import scan_order as so
from alloscan.session import shared_folder
from alloscan.sources import plink
from alloscan.sources import text as tx

S = lambda c: F.col(c).cast("string")


def stored_bed(spark, d, chunk_size):
    """All markers in order of ``v`` through a bed set in the shared folder; a marker without calls is all missing."""
    ids = panel(spark, d)
    none = F.array_repeat(F.lit(None).cast("float"), len(ids))
    m = so.row_position(t.markers(spark, d).select("v", "chrom", "pos"), ["v"], "variant_index")
    m = m.join(wide(spark, d).select("v", F.col("dosage").cast("array<float>").alias("dosage")), "v", "left")
    prefix = f"{shared_folder(spark)}/bed-{uuid.uuid4().hex}/all"
    plink.write_bed(m.select("variant_index", S("v").alias("snp_id"), "chrom", "pos", F.lit("A").alias("a1"), F.lit("G").alias("a2"),
                             F.coalesce("dosage", none).alias("dosage")), prefix, [f"s{i}" for i in ids])
    return plink.read_bed(spark, prefix, chunk_size).withColumn("v", F.col("snp_id").cast("bigint"))


@query("src_bed", "SELECT v, round(CAST(sum(d) AS DOUBLE), 3) AS dose_sum, count(*) AS n_called FROM g GROUP BY v")
def src_bed(spark, d):
    """Dosages of every marker, written as one bed set and read again."""
    e = stored_bed(spark, d, 20_000).select("v", F.explode("dosage").alias("d")).where(F.col("d").isNotNull())
    return e.groupBy("v").agg(r(F.sum("d"), "dose_sum", 3), F.count("d").alias("n_called"))


@query("src_bed_chunks", """
SELECT CAST(floor(i / 100) AS BIGINT) AS chunk, count(*) AS n, min(v) AS first_v, max(v) AS last_v FROM
 (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM mk) GROUP BY 1""")
def src_bed_chunks(spark, d):
    """The same set read in chunks of 100 markers: global index, chunk bounds."""
    s = stored_bed(spark, d, 100)
    return s.groupBy(F.floor(F.col("variant_index") / 100).alias("chunk")).agg(
        F.count("*").alias("n"), F.min("v").alias("first_v"), F.max("v").alias("last_v"))


def bim_lines(spark, d):
    m = t.markers(spark, d)
    a = F.substring(F.lit("ACGT"), 1 + (F.col("v") % 4).cast("int"), F.lit(1))
    b = F.substring(F.lit("ACGT"), 1 + ((F.col("v") + 1 + F.col("v") % 3) % 4).cast("int"), F.lit(1))
    sid = F.when(F.col("v") % 5 == 0, ".").otherwise(F.col("snp"))
    return m.select(F.concat_ws("\t", "chrom", sid, F.lit("0"), S("pos"), a, b).alias("value"))


_BIM = """
, bim AS (SELECT v, chrom, CASE WHEN v % 5 = 0 THEN '.' ELSE snp END AS snp_id, pos, substr('ACGT', CAST(1 + v % 4 AS INT), 1) AS a1,
          substr('ACGT', CAST(1 + (v + 1 + v % 3) % 4 AS INT), 1) AS a2 FROM mk)
"""


@query("src_bim", _BIM + "SELECT chrom, snp_id, pos, a1, a2 FROM bim")
def src_bim(spark, d):
    return plink.parse_bim(bim_lines(spark, d)).select("chrom", "snp_id", "pos", "a1", "a2")


@query("src_snpid_fix", _BIM + "SELECT CASE WHEN snp_id = '.' THEN chrom || ':' || pos ELSE snp_id END AS snp_id, chrom, pos FROM bim")
def src_snpid_fix(spark, d):
    b = plink.parse_bim(bim_lines(spark, d))
    return b.select(tx.fill_ids(F.col("snp_id"), F.col("chrom"), F.col("pos")).alias("snp_id"), "chrom", "pos")


def vcf_lines(spark, d):
    """VCF text of the panel genotypes: header and one line per marker."""
    w = wide(spark, d)
    gt_ = F.transform("dosage", lambda x: F.when(x.isNull(), "./.").when(x == 0, "0/0").when(x == 1, "0/1").otherwise("1|1"))
    body = w.select(F.concat_ws("\t", "chrom", S("pos"), F.when(F.col("v") % 5 == 0, ".").otherwise(F.col("snp")), F.lit("A"), F.lit("G"), F.lit("."),
                                F.lit("PASS"), F.lit("."), F.lit("GT"), F.array_join(gt_, "\t")).alias("value"))
    ids = t.pheno(spark, d).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: F.concat(F.lit("s"), s.cast("string"))), "\t").alias("x"))
    head = ids.select(F.concat(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"), "x").alias("value"))
    return head.unionByName(body)


@query("src_vcf", """
SELECT CASE WHEN v % 5 = 0 THEN chrom || ':' || pos ELSE snp END AS snp_id, chrom, pos, count(d) AS n_called, CAST(sum(d) AS DOUBLE) AS dose_sum
FROM g JOIN mk USING (v) GROUP BY v, snp, chrom, pos""")
def src_vcf(spark, d):
    v = tx.parse_vcf(vcf_lines(spark, d))
    e = v.select("snp_id", "chrom", "pos", F.explode("dosage").alias("x"))
    return e.groupBy("snp_id", "chrom", "pos").agg(F.count("x").alias("n_called"), F.sum("x").cast("double").alias("dose_sum"))


@query("src_vcf_header", "SELECT 's' || s AS sample FROM ph")
def src_vcf_header(spark, d):
    h = vcf_lines(spark, d).where(F.col("value").startswith("#CHROM"))
    return h.select(F.explode(F.slice(F.split("value", "\t"), F.lit(10), F.greatest(F.size(F.split("value", "\t")) - 9, F.lit(0)))).alias("sample"))


@query("src_csv_geno", """
, c AS (SELECT l_orderkey, l_linenumber, l_returnflag || CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END AS cl, l_partkey FROM lineitem),
c2 AS (SELECT replace(cl, 'R', CASE WHEN l_partkey % 2 = 0 THEN 'G' ELSE 'A' END) AS cl FROM c)
SELECT CASE WHEN left(cl, 1) NOT IN ('A', 'G') OR right(cl, 1) NOT IN ('A', 'G') THEN './.' WHEN cl = 'AA' THEN '0/0' WHEN left(cl, 1) = 'A' OR right(cl, 1) = 'A' THEN '0/1' ELSE '1/1' END AS gt, count(*) AS n
FROM c2 GROUP BY 1""")
def src_csv_geno(spark, d):
    li = t.table(spark, d, "lineitem")
    cl = F.concat("l_returnflag", F.when(F.col("l_linestatus") == "F", "A").otherwise("N"))
    cl = F.replace(cl, F.lit("R"), F.when(F.col("l_partkey") % 2 == 0, "G").otherwise("A"))
    return li.groupBy(tx.call_to_gt(cl, F.lit("A"), F.lit("G")).alias("gt")).agg(F.count("*").alias("n"))


@query("src_split", """
SELECT sub AS subgenome, chrom || ':' || pos AS snp_id, round(maf, 6) AS maf FROM q JOIN mk USING (v)
WHERE maf >= 0.25 AND 1 - call_rate <= 0.1""")
def src_split(spark, d):
    """Per-subgenome marker sets after the split filters (frequency, missingness), ids chrom:pos."""
    from alloscan.plans.split import split_filter
    s = t.with_map(t.stats(spark, d))
    return split_filter(s, {s_: [f"{k}{s_}" for k in (1, 2, 3)] for s_ in "ABD"}, spark, maf=0.25, geno=0.1).select("subgenome", "snp_id", r("maf", "maf"))


@query("src_pheno", """
SELECT CAST(c_custkey % 40 AS VARCHAR) AS sample, round(avg(c_acctbal), 4) AS y FROM customer WHERE c_acctbal > 0 GROUP BY 1""")
def src_pheno(spark, d):
    c = t.table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("y"))
    return tx.phenotype_means(c, "id", "y").select("sample", r("y", "y", 4))


def gff_lines(spark, d):
    g = t.genes(spark, d)
    kind = F.when(F.col("gid") % 7 == 0, "mRNA").otherwise("gene")
    attr = (F.when(F.col("gid") % 5 == 0, F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; note "x"')))
            .when(F.col("gid") % 5 == 1, F.concat(F.lit("Note=a;Name=N"), S("gid")))
            .otherwise(F.concat(F.lit("ID="), "gene_id", F.lit(";Name=N"), S("gid"))))
    strand = F.when(F.col("gid") % 3 == 0, "-").when(F.col("gid") % 3 == 1, "+").otherwise(".")
    rows = g.select(F.concat_ws("\t", "chrom", F.lit("src"), kind, S("start"), S("end"), F.lit("."), strand, F.lit("."), attr).alias("value"))
    note = t.table(spark, d, "region").select(F.concat(F.lit("# "), "r_name").alias("value"))
    return rows.unionByName(note)


@query("src_gff", """
SELECT gene_id, chrom, st AS start, en AS "end", CASE gid % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE '.' END AS strand FROM gen WHERE gid % 7 <> 0 AND gid % 5 NOT IN (0, 1)""")
def src_gff(spark, d):
    return tx.parse_gff(gff_lines(spark, d))


@query("fn_gff_attr", "SELECT gene_id AS gene, chrom FROM gen WHERE gid % 7 <> 0 AND gid % 5 = 0")
def fn_gff_attr(spark, d):
    return tx.parse_gff(gff_lines(spark, d), id_attr="gene_id").select(F.col("gene_id").alias("gene"), "chrom")


@query("src_genes_any", """
SELECT CASE WHEN gid % 5 = 0 THEN gene_id ELSE 'N' || gid END AS name, chrom, st AS start, en AS "end", CASE WHEN gid % 3 = 0 THEN '-' ELSE '+' END AS strand FROM gen WHERE gid % 7 <> 0""")
def src_genes_any(spark, d):
    return tx.parse_genes_any(gff_lines(spark, d))


@query("src_sgmap", "SELECT chrom, min(sub) AS subgenome, count(*) AS n_markers FROM mk GROUP BY chrom")
def src_sgmap(spark, d):
    m = t.markers(spark, d)
    sg = tx.subgenome_map(m.select("chrom", F.col("sub").alias("subgenome")).distinct())
    return m.join(F.broadcast(sg), "chrom").groupBy("chrom", "subgenome").agg(F.count("*").alias("n_markers"))


_SEQ = """
, sq AS (SELECT doc_id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz',
         'ACGTACGTACGTACGTACGTACGTANACGTACGTACGTACGTACGTACGTAN') AS seq FROM documents)
"""


def sequences(spark, d):
    """A nucleotide string per document: letters only, mapped onto ACGT and N."""
    al = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    to = "ACGTACGTACGTACGTACGTACGTAN"
    return t.table(spark, d, "documents").select("doc_id", F.translate(
        F.regexp_replace("text", "[^A-Za-z]", ""), al + al.lower(), to + to).alias("seq"))


def fasta_lines(spark, d):
    s = sequences(spark, d)
    body = s.select("doc_id", F.explode(F.sequence(F.lit(0), F.ceil(F.length("seq") / 60).cast("int"))).alias("ln"), "seq")
    return body.select("doc_id", "ln", F.when(F.col("ln") == 0, F.concat(F.lit(">d"), S("doc_id"), F.lit(" text"))).otherwise(
        F.substring("seq", (F.col("ln") - 1) * 60 + 1, F.lit(60))).alias("value"))


def pieces(spark, d):
    return tx.parse_fasta(fasta_lines(spark, d), ["doc_id", "ln"])


@query("src_fasta", _SEQ + "SELECT 'd' || doc_id AS chrom, length(seq) AS length FROM sq WHERE length(seq) > 0")
def src_fasta(spark, d):
    return tx.record_lengths(pieces(spark, d)).select("chrom", big("length"))


@query("src_fasta_fetch", _SEQ + """
SELECT snp, nullif(substr(seq, CAST(1 + (v * 37) % 400 AS INT), 1), '') AS base FROM mk LEFT JOIN sq ON doc_id = v""")
def src_fasta_fetch(spark, d):
    sites = t.markers(spark, d).select("snp", F.concat(F.lit("d"), S("v")).alias("chrom"), (1 + F.col("v") * 37 % 400).alias("pos"))
    return tx.fasta_bases(pieces(spark, d), sites, "snp").select("snp", "base")


@query("src_blast6", """
SELECT 'q' || o_custkey AS qseqid, 's' || (o_orderkey % 100) AS sseqid, max(o_totalprice) AS best_bits, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2""")
def src_blast6(spark, d):
    o = t.table(spark, d, "orders")
    bits = F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise(S("o_totalprice"))
    ln = o.select(F.concat_ws("\t", F.concat(F.lit("q"), S("o_custkey")), F.concat(F.lit("s"), (F.col("o_orderkey") % 100).cast("string")), F.lit("90.0"),
                              *[F.lit("1")] * 7, F.lit("1e-20"), bits).alias("value"))
    return tx.parse_blast6(ln).groupBy("qseqid", "sseqid").agg(F.max("bitscore").alias("best_bits"), F.count("*").alias("n"))


@query("src_collinearity", """
SELECT o_custkey AS block, 'A' || (o_custkey % 9) || '&D' || (o_custkey % 9) AS header_pair, 'gA' || o_orderkey AS gene1, 'gD' || (o_orderkey + 1) AS gene2,
       CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE o_totalprice END AS e_value FROM orders WHERE o_custkey % 5 <> 0""")
def src_collinearity(spark, d):
    """Block header lines followed by pair lines; the header state is carried forward. A fifth of the
    blocks lie within one subgenome, and odd lines have their genes the other way round."""
    o = t.table(spark, d, "orders")
    c = F.col("o_custkey")
    head = o.select(c.alias("blk")).distinct().select("blk", F.lit(-1).cast("bigint").alias("ln"), F.concat(
        F.lit("## Alignment "), S("blk"), F.lit(": score=1 A"), (F.col("blk") % 9).cast("string"), F.when(F.col("blk") % 5 == 0, "&A").otherwise("&D"), (F.col("blk") % 9).cast("string"), F.lit(" plus")).alias("value"))
    ga, gd = F.concat(F.lit("gA"), S("o_orderkey")), F.concat(F.lit("gD"), (F.col("o_orderkey") + 1).cast("string"))
    odd = F.col("o_orderkey") % 2 == 1
    body = o.select(c.alias("blk"), F.col("o_orderkey").alias("ln"), F.concat(
        F.lit("  0-  1:\t"), F.when(odd, gd).otherwise(ga), F.lit("\t"), F.when(odd, ga).otherwise(gd), F.lit("\t"),
        F.when(F.col("o_orderstatus") == "F", "bad").otherwise(S("o_totalprice"))).alias("value"))
    p = tx.parse_collinearity(head.unionByName(body), ["blk", "ln"], ("A", "D"), ("gA", "gD"))
    return p.select("block", "header_pair", "gene1", "gene2", "e_value")


@query("win_fill", """
SELECT o_custkey AS block, count(*) AS n_pairs FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1""")
def win_fill(spark, d):
    return src_collinearity(spark, d).groupBy("block").agg(F.count("*").alias("n_pairs"))


@query("src_quant_matrix", """
SELECT 'g' || (l_partkey % 500) AS gene, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS "A", coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS "N",
       coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS "R" FROM lineitem GROUP BY 1""")
def src_quant_matrix(spark, d):
    li = t.table(spark, d, "lineitem")
    qn = li.select(F.concat(F.lit("g"), (F.col("l_partkey") % 500).cast("string"), F.lit(".t"), S("l_linenumber")).alias("transcript"),
                   F.col("l_returnflag").alias("genotype"), F.col("l_quantity").alias("tpm"))
    return tx.expression_matrix(qn, ["A", "N", "R"])


@query("src_missing_code", "SELECT s, round(avg(CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_acctbal END), 4) AS y FROM (SELECT c_custkey % 40 AS s, c_acctbal FROM customer) WHERE s IN (SELECT s FROM g) GROUP BY s")
def src_missing_code(spark, d):
    """Sentinel -9 means missing; ids restricted to genotyped samples, missing traits kept as null."""
    c = t.table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("s"), F.when(F.col("c_acctbal") > 5000, -9.0).otherwise(F.col("c_acctbal")).alias("raw"))
    ok = c.select("s", F.nullif("raw", F.lit(-9.0)).alias("y"))
    return ok.join(t.geno(spark, d).select("s").distinct(), "s", "left_semi").groupBy("s").agg(r(F.avg("y"), "y", 4))


@query("agg_chrom_max", "SELECT chrom, max(pos) AS max_pos FROM mk GROUP BY chrom")
def agg_chrom_max(spark, d):
    return plink.parse_bim(bim_lines(spark, d)).groupBy("chrom").agg(F.max("pos").alias("max_pos"))


@query("join_chrommap", _SEQ + """
, cm AS (SELECT DISTINCT chrom AS panel_chrom, 'd' || (k * 40) AS fasta_chrom FROM mk UNION ALL SELECT 'x' || r_regionkey, 'd' || r_regionkey FROM region UNION ALL SELECT r_name, 'none' FROM region),
mp AS (SELECT chrom, max(j) AS max_pos FROM mk GROUP BY chrom), fl AS (SELECT 'd' || doc_id AS c, length(seq) AS n FROM sq WHERE length(seq) > 0)
SELECT panel_chrom, fasta_chrom, max_pos AS panel_max_pos, n AS fasta_chrom_length,
  CASE WHEN n IS NULL THEN 'FASTA_MISSING' WHEN max_pos IS NULL THEN 'NO_VARIANTS' WHEN max_pos > n THEN 'OVERFLOW' ELSE 'OK' END AS status
FROM cm LEFT JOIN mp ON mp.chrom = panel_chrom LEFT JOIN fl ON fl.c = fasta_chrom""")
def join_chrommap(spark, d):
    from alloscan.operators.candidates import check_chrom_map
    m = t.markers(spark, d)
    cm = m.select(F.col("chrom").alias("panel_chrom"), F.concat(F.lit("d"), (F.col("k") * 40).cast("string")).alias("fasta_chrom")).distinct()
    reg = t.table(spark, d, "region")
    cm = cm.unionByName(reg.select(F.concat(F.lit("x"), S("r_regionkey")).alias("panel_chrom"), F.concat(F.lit("d"), S("r_regionkey")).alias("fasta_chrom"))
                        ).unionByName(reg.select(F.col("r_name").alias("panel_chrom"), F.lit("none").alias("fasta_chrom")))
    mx = m.groupBy("chrom").agg(F.max("j").alias("max_pos"))
    return check_chrom_map(cm, mx, tx.record_lengths(pieces(spark, d))).select(
        "panel_chrom", "fasta_chrom", big("panel_max_pos"), big("fasta_chrom_length"), "status")


_HARM = _SEQ + """
, cd AS (SELECT v, snp, 'd' || v AS chrom, 1 + (v * 37) % 400 AS pos, maf FROM ss),
bm AS (SELECT v, substr('ACGT', CAST(1 + v % 4 AS INT), 1) AS a1, substr('ACGT', CAST(1 + (v + 1 + v % 3) % 4 AS INT), 1) AS a2, 1 + (v * 37) % 400 + CASE WHEN v % 11 = 0 THEN 1 ELSE 0 END AS bpos
       FROM q WHERE maf >= 0.25),
b AS (SELECT cd.*, a1, a2, bpos, nullif(substr(seq, CAST(cd.pos AS INT), 1), '') AS base FROM cd LEFT JOIN bm USING (v) LEFT JOIN sq ON doc_id = v),
h AS (SELECT *, translate(base, 'ACGT', 'TGCA') AS cb,
  CASE WHEN a1 IS NULL THEN 'BIM_MISSING' WHEN bpos <> pos THEN 'BIM_CAND_DISAGREE' WHEN base IS NULL THEN 'FASTA_KEYERR' WHEN base NOT IN ('A', 'C', 'G', 'T') THEN 'FASTA_NON_ACGT'
       WHEN base = a1 THEN 'A1_IS_REF' WHEN base = a2 THEN 'A2_IS_REF' WHEN translate(base, 'ACGT', 'TGCA') = a1 THEN 'A1_IS_REF_RC' WHEN translate(base, 'ACGT', 'TGCA') = a2 THEN 'A2_IS_REF_RC' ELSE 'REF_MISMATCH' END AS status FROM b)
"""


@query("fn_harmonize", _HARM + """
SELECT snp, status AS ref_match_status, CASE WHEN status LIKE 'A_\\_IS%' ESCAPE '\\' OR status = 'REF_MISMATCH' THEN base END AS ref_fasta,
  CASE status WHEN 'A1_IS_REF' THEN a2 WHEN 'A2_IS_REF' THEN a1 WHEN 'A1_IS_REF_RC' THEN translate(a2, 'ACGT', 'TGCA') WHEN 'A2_IS_REF_RC' THEN translate(a1, 'ACGT', 'TGCA') END AS alt_fasta,
  CASE WHEN status LIKE 'A_\\_IS%' ESCAPE '\\' OR status = 'REF_MISMATCH' THEN (a1 || a2) IN ('AT', 'TA', 'CG', 'GC') ELSE false END AS is_palindromic FROM h""")
def fn_harmonize(spark, d):
    from alloscan.operators.candidates import harmonize
    c = t.sumstats(spark, d, p=False).select("v", "snp", F.concat(F.lit("d"), S("v")).alias("chrom"), (1 + F.col("v") * 37 % 400).alias("pos"))
    b = t.stats(spark, d).where(F.col("maf") >= 0.25).select(
        F.concat(F.lit("m"), S("v")).alias("snp"), F.concat(F.lit("d"), S("v")).alias("bim_chrom"),
        (1 + F.col("v") * 37 % 400 + F.when(F.col("v") % 11 == 0, 1).otherwise(0)).alias("bim_pos"),
        F.substring(F.lit("ACGT"), 1 + (F.col("v") % 4).cast("int"), F.lit(1)).alias("a1"),
        F.substring(F.lit("ACGT"), 1 + ((F.col("v") + 1 + F.col("v") % 3) % 4).cast("int"), F.lit(1)).alias("a2"))
    return harmonize(c.select("snp", "chrom", "pos"), b, pieces(spark, d)).select("snp", "ref_match_status", "ref_fasta", "alt_fasta", "is_palindromic")


@query("join_alleles", _HARM + "SELECT status AS ref_match_status, count(*) AS n FROM h GROUP BY 1")
def join_alleles(spark, d):
    return fn_harmonize(spark, d).groupBy("ref_match_status").agg(F.count("*").alias("n"))


@query("fn_window_seq", _SEQ + """
, w AS (SELECT doc_id, 1 + (doc_id * 131) % 300 AS pos, seq FROM sq),
x AS (SELECT doc_id, pos, length(seq) AS n, greatest(0, pos - 1 - 100) AS a, substr(seq, CAST(greatest(0, pos - 1 - 100) + 1 AS INT), CAST(pos + 100 - greatest(0, pos - 1 - 100) AS INT)) AS s FROM w),
y AS (SELECT *, pos - 1 - a AS o FROM x)
SELECT doc_id, CASE WHEN o >= length(s) THEN 'WINDOW_OOB' WHEN length(s) < 200 THEN 'WINDOW_TRUNCATED'
   WHEN contains(substr(s, CAST(greatest(0, o - 50) + 1 AS INT), CAST(least(length(s), o + 51) - greatest(0, o - 50) AS INT)), 'N') THEN 'WINDOW_HAS_N_NEAR_SNP' ELSE 'OK' END AS status,
  CASE WHEN o >= length(s) THEN NULL WHEN length(s) < 200 THEN s WHEN contains(substr(s, CAST(greatest(0, o - 50) + 1 AS INT), CAST(least(length(s), o + 51) - greatest(0, o - 50) AS INT)), 'N') THEN NULL ELSE replace(s, 'N', 'A') END AS seq FROM y""")
def fn_window_seq(spark, d):
    from alloscan.operators.candidates import sequence_window
    s = sequences(spark, d).withColumn("pos", 1 + F.col("doc_id") * 131 % 300)
    return sequence_window(s, half=100, near=50).select("doc_id", "status", F.col("window").alias("seq"))


@query("agg_kmer", _SEQ + """
, cp AS (SELECT CAST(floor(doc_id / 4) AS BIGINT) AS grp, doc_id % 4 AS cp, seq FROM sq WHERE length(seq) >= 31),
km AS (SELECT DISTINCT grp, cp, substr(seq, CAST(i AS INT), 31) AS kmer FROM cp, LATERAL (SELECT unnest(range(1, length(seq) - 29)) AS i)),
un AS (SELECT grp, kmer, min(cp) AS cp, count(*) AS nc FROM km GROUP BY ALL),
t AS (SELECT grp, cp, count(*) AS n FROM km GROUP BY ALL)
SELECT t.grp, t.cp, n AS n_kmers, round((SELECT count(*) FROM un WHERE un.grp = t.grp AND un.cp = t.cp AND nc = 1) / n, 6) AS unique_fraction FROM t""")
def agg_kmer(spark, d):
    """Share of a copy's k-mers that no other copy of its group has."""
    from alloscan.operators.expression import unique_kmers
    s = sequences(spark, d).select(F.floor(F.col("doc_id") / 4).alias("grp"), (F.col("doc_id") % 4).alias("cp"), "seq")
    return unique_kmers(s, 31).select("grp", "cp", big("n_kmers"), r("unique_fraction", "unique_fraction"))


@query("agg_longest_tx", _SEQ + """
SELECT CAST(floor(doc_id / 3) AS BIGINT) AS gene, arg_max(doc_id, (length(seq), -doc_id)) AS transcript, max(length(seq)) AS n_bases FROM sq GROUP BY 1""")
def agg_longest_tx(spark, d):
    s = sequences(spark, d)
    return s.groupBy(F.floor(F.col("doc_id") / 3).alias("gene")).agg(
        F.max_by("doc_id", F.struct(F.length("seq").alias("n"), (-F.col("doc_id")).alias("o"))).alias("transcript"), big(F.max(F.length("seq")), "n_bases"))


@query("agg_longest_prot", """
, pr AS (SELECT regexp_replace('G' || CAST(floor(doc_id / 3) AS BIGINT) || '.' || (doc_id % 3 + 1), '\\.\\d+$', '') AS gene, doc_id, replace(replace(text, '.', ''), '*', '') AS aa FROM documents)
SELECT gene, arg_max(doc_id, (length(aa), -doc_id)) AS transcript, max(length(aa)) AS n_residues FROM pr GROUP BY gene""")
def agg_longest_prot(spark, d):
    x = t.table(spark, d, "documents").select("doc_id", F.regexp_replace(F.concat(
        F.lit("G"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit("."), (F.col("doc_id") % 3 + 1).cast("string")), r"\.\d+$", "").alias("gene"),
        F.length(F.translate("text", ".*", "")).alias("n"))
    return x.groupBy("gene").agg(F.max_by("doc_id", F.struct("n", (-F.col("doc_id")).alias("o"))).alias("transcript"), big(F.max("n"), "n_residues"))


@query("sink_demo")
def sink_demo(spark, d):
    """Demonstration panel whose markers come from the marker table: allele draws per marker seed."""
    from alloscan.plans.demo import demo_genotypes
    return demo_genotypes(t.markers(spark, d).select("v"), n_samples=120, seed=7)
