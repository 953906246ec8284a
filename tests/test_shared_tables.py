"""What a query makes once, and how small the sums are that it sends."""

import numpy as np

from alloscan.catalog import candidate_queries as cq
from alloscan.operators import local_structure as ls


def test_ld_clump_makes_the_genotype_table_once(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    spark.createDataFrame([(s, float(rng.normal())) for s in range(40)], "s_suppkey bigint, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    calls = [(s, p, float(rng.integers(1, 51))) for s in range(40) for p in range(144)]
    spark.createDataFrame(calls, "l_suppkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    made, geno = [], cq.t.geno
    monkeypatch.setattr(cq.t, "geno", lambda *a: made.append(1) or geno(*a))
    rows = cq.top_ld_clump(spark, str(tmp_path)).collect()
    hits = {r.snp for r in cq.t.sumstats(spark, str(tmp_path)).where("p < 0.3").collect()}
    assert made == [1, 1] and {r.snp for r in rows} == hits  # the second call is that of the line above
    assert all(r.lead_of_locus == (r.snp == r.lead_snp) for r in rows)


def test_sums_around_genes_are_triangles_with_their_pairs(spark):
    rng = np.random.default_rng(4)
    n, g = 12, 6
    genes = spark.createDataFrame([(f"g{i}", "c", 100_000 * i) for i in range(g)], "gene string, chrom string, pos bigint")
    vec = rng.standard_normal((g, n))
    burdens = spark.createDataFrame([(f"g{i}", vec[i].tolist()) for i in range(g)], "gene string, vec array<double>")
    markers = spark.createDataFrame([], "v bigint, chrom string, pos bigint, vec array<double>")
    focal = spark.createDataFrame([("g0", ["g0", "g0"], ["g1", "g2"])], "gene string, xs array<string>, ys array<string>")
    got = ls.around(focal, genes, burdens, markers, (np.eye(n), rng.standard_normal(n), None), (250_000,)).collect()
    c = vec[1:3] - vec[1:3].mean(1, keepdims=True)
    assert len(got) == 1 and got[0].n == 2 and got[0].xs == ["g0", "g0"] and got[0].ys == ["g1", "g2"]
    assert len(got[0].gram) == n * (n + 1) // 2 and np.allclose(got[0].gram, (c.T @ c)[np.triu_indices(n)])
