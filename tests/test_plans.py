"""Formats and whole runs on generated panels."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from alloscan.functions import mixed_model as mm
from alloscan.operators import candidates as cd
from alloscan.plans import demo, fit, interact, locus, split
from alloscan.sources import config, plink
from alloscan.sources import text as tx
from alloscan.streaming import scan_stream


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("demo"))
    return demo.make_demo(spark, d, n_samples=61, n_snp=60), d


def test_bed_roundtrip_and_chunks(spark, tmp_path):
    rng = np.random.default_rng(0)
    g = [[None if x == 3 else float(x) for x in row] for row in rng.integers(0, 4, (23, 11))]
    v = spark.createDataFrame([(i, f"r{i}", "1A", i * 10, "A", "C", row) for i, row in enumerate(g)],
                              "variant_index bigint, snp_id string, chrom string, pos bigint, a1 string, a2 string, dosage array<float>")
    pre = str(tmp_path / "x" / "all")
    assert plink.write_bed(v, pre, [f"s{i}" for i in range(11)]) == 23
    for chunk in (1, 7, 1000):
        got = {r["variant_index"]: list(r["dosage"]) for r in plink.read_bed(spark, pre, chunk).collect()}
        assert got == dict(enumerate(g))
    assert plink.read_bim(spark, pre + ".bim").count() == 23
    with pytest.raises(FileNotFoundError, match="bim"):
        plink.read_bed(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        plink.read_bed(spark, pre, 0)


def test_bed_index_seeks_to_every_chunk(spark, tmp_path, monkeypatch):
    """Small index blocks and steps: lines cross blocks, chunks start between stored offsets."""
    n = 500
    v = spark.range(n).select(F.col("id").alias("variant_index"), F.concat(F.lit("r"), F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")), "id").alias("snp_id"),
                              F.lit("1A").alias("chrom"), (F.col("id") * 7).alias("pos"), F.lit("A").alias("a1"), F.lit("C").alias("a2"),
                              F.array(*[((F.col("id") + k) % 3).cast("float") for k in range(5)]).alias("dosage"))
    pre = "file://" + str(tmp_path / "u" / "all")
    assert plink.write_bed(v.repartition(7), pre, [f"s{i}" for i in range(5)]) == n
    assert sorted(p.name for p in (tmp_path / "u").iterdir()) == ["all.bed", "all.bim", "all.fam"]
    want = sorted(tuple(r) for r in v.select("variant_index", "snp_id", "pos").collect())
    monkeypatch.setattr(plink, "INDEX_BLOCK", 97)
    monkeypatch.setattr(plink, "INDEX_STEP", 3)
    bim = pre + ".bim"
    blocks = [plink._index_block(bim, i) for i in plink._index_blocks(bim)]
    assert sum(k for k, _ in blocks) == n
    text = (tmp_path / "u" / "all.bim").read_bytes()
    for step in (1, 7, 64, 1000):
        starts = plink._chunk_starts(blocks, n, step)
        for a, (offset, skip) in zip(range(0, n, step), starts):
            assert text[:offset].count(b"\n") + skip == a and skip < 97 // 10 + 2 * 3
    monkeypatch.undo()
    for step in (64, 1000):
        got = plink.read_bed(spark, pre, step).select("variant_index", "snp_id", "pos").collect()
        assert sorted(tuple(r) for r in got) == want
    with pytest.raises(ValueError, match="fewer lines"):
        plink._chunk_starts(blocks, n + 2, 10)


def test_bed_set_without_markers(spark, tmp_path):
    v = spark.createDataFrame([], "variant_index bigint, snp_id string, chrom string, pos bigint, a1 string, a2 string, dosage array<float>")
    pre = str(tmp_path / "none")
    assert plink.write_bed(v, pre, ["a", "b"]) == 0
    assert plink.read_bed(spark, pre).count() == 0


def test_stateful_text_across_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 x\nACGT\nAC\n>c2\nTTTT\n")
    p = tx.parse_fasta(tx.read_lines(spark, str(tmp_path / "a.fa")), tx.LINE_ORDER)
    assert sorted((r["chrom"], r["start"], r["seq"]) for r in p.collect()) == [("c1", 1, "ACGT"), ("c1", 5, "AC"), ("c2", 1, "TTTT")]
    (tmp_path / "a.col").write_text("# x\n## Alignment 0: score=1 aa1&dd1 plus\n  0-  0:\tt_A1\tt_D1\t1e-5\n  0-  1:\tt_A2\tt_D2\tbad\n"
                                      "## Alignment 7: s dd2&aa2 minus\n  7-  0:\tt_D9\tt_A9\t0\n## Alignment 8: s aa2&aa3 plus\n  8-  0:\tt_A3\tt_D4\t0\n")
    c = tx.parse_collinearity(tx.read_lines(spark, str(tmp_path / "a.col")), tx.LINE_ORDER)
    assert sorted((r["block"], r["gene1"], r["e_value"]) for r in c.collect()) == [(0, "t_A1", 1e-5), (0, "t_A2", 1.0), (7, "t_A9", 0.0)]


def test_gff_attribute_forms(spark):
    cases = [("ID=g1;Name=x", "g1"), ('ID="g 2"; Note=a', "g 2"), ('gene_name "n"; ID g3', "g3"), ('ID "g4"', "g4"), ("Parent=g5;XID=g6", None), ("ID=", None), (None, None)]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string")
    got = {r["i"]: r["v"] for r in df.select("i", tx.gff_attribute(F.col("a"), "ID").alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_gff_windows_hand_table(spark, tmp_path):
    # two genes a subgenome, one with its end just short of a marker; a transcript that must not count
    spans = {"1": (1010, 1300), "2": (5000, 5750)}
    lines = [f"chr{s}\tx\tgene\t{a}\t{b}\t.\t+\t.\tName=n;ID=\"g{s}{k}\"" for s in "ABC" for k, (a, b) in spans.items()]
    lines += [f"chr{s}\tx\tmRNA\t1\t9000\t.\t-\t.\tID=m{s}" for s in "ABC"]
    (tmp_path / "g.gff").write_text("##gff\n" + "\n".join(lines) + "\n")
    bim = {s: spark.createDataFrame([(i, f"chr{s}", p) for i, p in enumerate((1010, 1312, 5400, 7000))], "variant_index bigint, chrom string, pos bigint") for s in "ABC"}
    sg = spark.createDataFrame([(f"chr{s}", s) for s in "ABC"], "chrom string, subgenome string")
    for flank, want in ((11, [0]), (12, [0, 1])):
        table, m = interact.prepare_snps(spark, str(tmp_path / "g.gff"), bim, sg, flank)
        got = {r["gene_id"]: list(r["snp_idx"]) for r in m.collect()}
        assert got["gA1"] == want and got["gB2"] == [2] and len(got) == 6 and table.count() == 6
    with pytest.raises(ValueError, match="more than once"):
        tx.subgenome_map(sg.unionByName(sg))


ALLELES = [("A", "G", "A", "A1_IS_REF", "A", "G", False), ("G", "A", "A", "A2_IS_REF", "A", "G", False), ("T", "C", "A", "A1_IS_REF_RC", "A", "G", False),
           ("C", "T", "A", "A2_IS_REF_RC", "A", "G", False), ("A", "T", "A", "A1_IS_REF", "A", "T", True), ("C", "G", "A", "REF_MISMATCH", "A", None, True),
           ("A", "G", "N", "FASTA_NON_ACGT", None, None, False)]


def test_allele_frames(spark):
    seq = "".join(a[2] for a in ALLELES)
    pieces = spark.createDataFrame([("c", 1, seq)], "chrom string, start bigint, seq string")
    cand = [(f"s{i}", "c", i + 1) for i in range(len(ALLELES))] + [("far", "c", 99), ("moved", "c", 1), ("gone", "c", 1)]
    bim = [(f"s{i}", "c", i + 1, a[0], a[1]) for i, a in enumerate(ALLELES)] + [("far", "c", 99, "A", "C"), ("moved", "c", 2, "A", "C")]
    h = cd.harmonize(spark.createDataFrame(cand, "snp string, chrom string, pos bigint"),
                     spark.createDataFrame(bim, "snp string, bim_chrom string, bim_pos bigint, a1 string, a2 string"), pieces)
    got = {r["snp"]: (r["ref_match_status"], r["ref_fasta"], r["alt_fasta"], r["is_palindromic"]) for r in h.collect()}
    for i, a in enumerate(ALLELES):
        assert got[f"s{i}"] == a[3:]
    assert (got["far"][0], got["moved"][0], got["gone"][0]) == ("FASTA_KEYERR", "BIM_CAND_DISAGREE", "BIM_MISSING")


@pytest.mark.parametrize("loco", [False, True])
def test_fit_end_to_end(spark, panel, tmp_path, loco):
    paths, d = panel
    cfg = {"subgenomes": ["A", "B"], "bed": d + "/{subgenome}/all", "phenotype": paths["phenotype"], "sample_col": "sample", "trait": "trait",
           "out_dir": str(tmp_path / "run"), "loco": loco, "maf_min": 0.05}
    assert fit.validate(cfg) == [] and fit.run_fit(spark, cfg, dry_run=True)["status"] == "dry_run"
    doc = fit.run_fit(spark, cfg)
    assert doc["accepted"] and doc["n_samples"] == 61 and doc["scan_status"]["ok"] > 80 and 0.3 < doc["lambda_gc"] < 3
    assert json.loads((tmp_path / "run" / "summary.json").read_text())["accepted"]
    s = locus.results(spark, cfg["out_dir"])
    lead = locus.leads(s, 2)
    assert lead.count() == 2 and locus.windows(s, lead, 5000).count() > 2 and locus.plot_points(s, 10).count() >= 10
    with pytest.raises(FileExistsError):
        fit.run_fit(spark, cfg)


def test_fit_refuses(spark, panel, tmp_path):
    assert any("unknown key" in p for p in fit.validate({"nope": 1}))
    ph = spark.createDataFrame([("1", 2.0), ("2", 3.0)], "sample string, trait double")
    assert fit.check_phenotype(ph, "sample", "trait") and not fit.check_phenotype(ph, "sample", "trait", True)
    with pytest.raises(ValueError, match="at least 20"):
        fit.join_samples(ph, {"A": ["1", "2"]}, "trait")
    with pytest.raises(ValueError, match="repeat"):
        fit.join_samples(ph, {"A": ["1", "1"]}, "trait")
    dup = tx.phenotype_means(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "s string, y double"), "s", "y")
    assert [(r["sample"], r["y"]) for r in dup.collect()] == [("a", 2.0)]


def test_interact_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(2)
    n, genes = 60, 6
    g = rng.integers(0, 3, (3, genes, 4, n))
    rows, sg = [], []
    for a, s in enumerate("ABD"):
        for i in range(genes):
            for j in range(4):
                v = a * 1000 + i * 10 + j
                sg.append((v, f"{s}{i}", f"1{s}", i * 1000 + j))
                rows += [(k, v, s, int(x)) for k, x in enumerate(g[a, i, j])]
    dos = spark.createDataFrame(rows, "s bigint, v bigint, sub string, d bigint")
    sgd = spark.createDataFrame(sg, "v bigint, gene string, chrom string, pos bigint")
    burden = lambda a, i: (lambda m: (m - m.mean()) / m.std())(sum((x - x.mean()) / x.std() for x in g[a, i]))
    y = rng.standard_normal(n) + 2 * burden(0, 0) * burden(1, 0)
    ph = spark.createDataFrame([(k, float(v), float(rng.standard_normal())) for k, v in enumerate(y)], "s bigint, t1 double, t2 double")
    grp = spark.createDataFrame([(f"A{i}", f"B{i}", f"D{i}") for i in range(genes)], "gene_A string, gene_B string, gene_D string")
    w = spark.createDataFrame([("A0", "B0", 3.0)], "gene_x string, gene_y string, weight double")
    two = interact.run_interact(spark, dos, sgd, grp, ph, ["t1"], str(tmp_path / "p"), ["A", "B"], n_perm=3, weights=w)
    assert two["G"] == genes and two["min_p"] < 1e-4 and two["n_sig"] >= 1 and two["permutation"]["n_perm"] == 3 and two["weighted"]["n_sig"] >= 1
    top = spark.read.csv(str(tmp_path / "p" / "pair_ranking"), sep="\t", header=True).where("rank = 0").first()
    # the full pair table: 25 columns, gene columns named by subgenome
    assert (top["gene_A"], top["gene_B"]) == ("A0", "B0") and len(top) == 25 and "gene_len_pair_sum" in top
    assert spark.read.csv(str(tmp_path / "p" / "top_burdens"), sep="\t", header=True).count() == 5 * n
    three = interact.run_interact(spark, dos, sgd, grp, ph, ["t1"], str(tmp_path / "c"), ["A", "B", "D"], n_pcs=1)
    assert three["G"] == genes and three["min_p"] < 1e-3
    assert {"p_AB", "p_AD", "p_BD", "p_acat", "n_snp_triad", "min_pair_tag"} <= set(spark.read.csv(str(tmp_path / "c" / "group_ranking"), sep="\t", header=True).columns)
    multi = interact.run_interact(spark, dos, sgd, grp, ph, ["t1", "t2"], str(tmp_path / "m"), ["A", "B"])
    assert multi["G"] == genes and len(multi["trait_set_digest"]) == 16
    with pytest.raises(ValueError):
        interact.run_interact(spark, dos, sgd, grp.drop("gene_B"), ph, ["t1"], str(tmp_path / "e"), ["A", "B"])


def test_split_routes_and_writes(spark, panel, tmp_path):
    assert split.route_chromosomes(["/x/chr1A.vcf.gz", "/x/2A.vcf", "/x/p_3A_q.vcf"], ["1A", "chr2A", "3A"]) == ["/x/chr1A.vcf.gz", "/x/2A.vcf", "/x/p_3A_q.vcf"]
    with pytest.raises(ValueError, match="no genotype file"):
        split.route_chromosomes(["/x/1A.vcf"], ["9Z"])
    vcf = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\td\n"
    vcf += "1A\t10\t.\tA\tG\t.\t.\t.\tGT\t0/0\t0/1\t1/1\t./.\n1A\t20\t.\tA\tG,T\t.\t.\t.\tGT\t0/0\t0/1\t1/1\t0/0\n1B\t5\trs\tC\tT\t.\t.\t.\tGT:DP\t0|1:3\t0|0:2\t0|0:1\t1|1:9\n"
    (tmp_path / "all.vcf").write_text(vcf)
    cfg = config.species_config({"species": "x", "ploidy": 4, "kind": "allopolyploid", "subgenomes": [{"id": "A", "chroms": ["1A"]}, {"id": "B", "chroms": ["1B"]}],
                                 "geno": {"vcf": str(tmp_path / "all.vcf")}, "qc": {"maf": 0.05, "geno": 0.5}})
    plan = split.plan_split(cfg, str(tmp_path / "out"))
    assert [w.status for w in split.execute_split(spark, plan, cfg, dry_run=True).works] == ["PLANNED", "PLANNED"]
    done = split.execute_split(spark, plan, cfg)
    assert [w.status for w in done.works] == ["OK", "OK"]
    r = plink.read_bed(spark, str(tmp_path / "out" / "A" / "all")).collect()
    assert [(x["snp_id"], list(x["dosage"])) for x in r] == [("1A:10", [0.0, 1.0, 2.0, None])]
    assert split.plan_split(cfg, str(tmp_path / "out")).works[0].status == "SKIPPED_EXISTING"


@pytest.mark.parametrize("change,msg", [({"kind": "diploid"}, "diploid"), ({"subgenomes": [{"id": "A", "chroms": ["1"]}]}, "at least two"),
                                        ({"subgenomes": [{"id": "A", "chroms": ["1"]}, {"id": "A", "chroms": ["2"]}]}, "unique"),
                                        ({"subgenomes": [{"id": "A", "chroms": ["1"]}, {"id": "B", "chroms": ["1"]}]}, "two subgenomes"),
                                        ({"geno": {}}, "exactly one"), ({"extra": 1}, "unknown keys")])
def test_species_rules(change, msg):
    doc = {"species": "x", "ploidy": 4, "kind": "allopolyploid", "subgenomes": [{"id": "A", "chroms": ["1"]}, {"id": "B", "chroms": ["2"]}], "geno": {"vcf": "f"}}
    config.species_config(doc)
    with pytest.raises(ValueError, match=msg):
        config.species_config({**doc, **change})


def test_stream_equals_batch(spark, tmp_path):
    from alloscan.operators.score_scan import kernel_scan
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, rng.integers(0, 3, 30).astype(float).tolist()) for i in range(40)], "v bigint, dosage array<double>")
    v.repartition(4).write.parquet(str(tmp_path / "in"))
    y = rng.standard_normal(30)
    ctx = {None: mm.null_context(y, np.ones((30, 1)), {}, {"e": float(y.var(ddof=1))})}
    q = scan_stream.start_scan(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), ctx, "v bigint, dosage array<double>", max_files=1)
    q.awaitTermination(120)
    got = {r["v"]: r["chi2"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["v"]: r["chi2"] for r in kernel_scan(v, ctx).where(F.col("status") == "ok").collect()}
    # batch shapes differ, so sums may differ in the last bits
    assert got.keys() == want.keys() and np.allclose([got[v] for v in want], list(want.values()), rtol=1e-10)
    assert scan_stream.inflation_of_sink(spark, str(tmp_path / "out"), []).first()["n_markers"] == len(want)


def test_stored_kernels_and_settings(spark, tmp_path):
    from alloscan.sources import sinks
    k = spark.createDataFrame([("A", 0, 0, 1.0), ("A", 0, 1, 0.1), ("A", 1, 1, 0.9)], "grp string, i int, j int, k double")
    sinks.write_kernels(k, str(tmp_path / "k"))
    assert sinks.read_kernels(spark, str(tmp_path / "k"), ["a", "b"]).count() == 3
    with pytest.raises(ValueError, match="square"):
        sinks.read_kernels(spark, str(tmp_path / "k"), ["a"])
    with pytest.raises(ValueError, match="repeat"):
        sinks.read_kernels(spark, str(tmp_path / "k"), ["a", "a"])
    (tmp_path / "panel.json").write_text('{"trait": "x", "loco": true}')
    (tmp_path / "run.json").write_text('{"panel_manifest": "panel.json", "trait": "y"}')
    assert config.load_run_config(str(tmp_path / "run.json")) == {"trait": "y", "loco": True}
    sinks.write_json({"a": np.float64(1.5), "b": np.arange(2)}, str(tmp_path / "o" / "s.json"))
    assert json.loads((tmp_path / "o" / "s.json").read_text()) == {"a": 1.5, "b": [0, 1]}
