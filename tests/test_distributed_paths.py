"""Distributed scans, quantiles, clumps and joins against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alloscan.functions import stat_columns as sc
from alloscan.operators import clumping as cl
from alloscan.operators import homologs as hm
from alloscan.operators import intervals as iv
from alloscan.operators import ranking as rk
from alloscan.operators import scan_order as so
from alloscan.operators.skew import hot_join


def hits(spark, n, seed, chroms=3, span=5000, pool=None):
    rnd = random.Random(seed)
    # a third of all hits share one chromosome and a narrow stretch
    rows = [("c0" if i % 3 == 0 else f"c{rnd.randrange(chroms)}", rnd.randrange(200) if i % 3 == 0 else rnd.randrange(span),
             rnd.choice(pool) if pool else rnd.random(), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "chrom string, pos bigint, p double, id bigint").repartition(5)


def test_ordered_scan(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([0.5, rnd.random()]), i, rnd.randrange(-5, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "x double, id bigint, v bigint").repartition(7)
    got = {r["id"]: r for r in so.ordered_scan(df, ["x", "id"], {"n": ("count", ""), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}).collect()}
    s = 0
    seen = []
    for n, (_, i, v) in enumerate(sorted(rows), 1):
        s += v
        seen.append(v)
        assert (got[i]["n"], got[i]["s"], got[i]["lo"], got[i]["hi"]) == (n, s, min(seen), max(seen))
    down = {r["id"]: r["n"] for r in so.ordered_scan(df, ["x", "id"], {"n": ("count", "")}, descending=True).collect()}
    assert all(down[i] == 501 - got[i]["n"] for i in down)


def test_bh_holm_ties_and_missing(spark):
    p = [1.0] * 60 + [0.01, 0.01, 0.2, 0.03, 1e-9] + [float(x) for x in np.linspace(0.001, 0.9, 55)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)] + [(999, None), (998, float("nan"))], "id bigint, p double")
    q = {r["id"]: r["q"] for r in rk.bh(df, "p").collect()}
    order = np.argsort(p, kind="stable")
    want = np.minimum(1, np.minimum.accumulate((np.array(p)[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
    assert q[999] is None and q[998] is None
    assert np.allclose([q[int(i)] for i in order], want)
    h = {r["id"]: r["p_holm"] for r in rk.holm(df.where("id < 900"), "p").collect()}
    hw = np.maximum.accumulate(np.minimum(1, (len(p) - np.arange(len(p))) * np.array(p)[order]))
    assert np.allclose([h[int(i)] for i in order], hw)


def test_ranks_with_hot_value(spark):
    x = [7.0] * 150 + list(np.random.default_rng(0).normal(size=150))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id bigint, x double")
    got = {r["id"]: r for r in rk.decile(df, "x").collect()}
    s = np.sort(x)
    for i, v in enumerate(x):
        lo, hi = np.searchsorted(s, v), np.searchsorted(s, v, side="right")
        avg = (lo + 1 + hi) / 2
        assert got[i]["rank_avg"] == avg and got[i]["decile"] == min(9, int((avg - 0.5) / len(x) * 10))


@pytest.mark.parametrize("n", [1, 2, 257, 400])
def test_exact_quantile(spark, n):
    x = np.random.default_rng(n).chisquare(1, n)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(x)], "g string, x double")
    for prob in (0.5, 0.95):
        got = {r["g"]: r["q"] for r in sc.grouped_quantile(df, ["g"], "x", prob).collect()}
        for g in got:
            assert np.isclose(got[g], np.quantile([v for i, v in enumerate(x) if ("a" if i % 3 else "b") == g], prob))


def greedy(rows, reach):
    rows = sorted(rows, key=lambda r: (r[2], r[3]))
    leads, own = [], {}
    for c, pos, p, i in rows:
        hit = next((l for l in leads if l[0] == c and abs(l[1] - pos) <= reach), None)
        if hit is None:
            leads.append((c, pos, p, i))
            hit = leads[-1]
        own[i] = hit[3]
    return own


@pytest.mark.parametrize("seed,pool", [(1, None), (2, [0.1, 0.2, 0.3]), (3, None)])
def test_clump_rounds_equal_greedy(spark, seed, pool):
    rows, df = hits(spark, 240, seed, pool=pool)
    got = {r["id"]: r["lead_id"] for r in cl.clump(df, 150).collect()}
    assert got == greedy(rows, 150)


def test_clump_monotone_chain(spark):
    rows = [("c", 100 * i, 1.0 / (i + 1), i) for i in range(12)]
    df = spark.createDataFrame(rows, "chrom string, pos bigint, p double, id bigint")
    assert {r["id"]: r["lead_id"] for r in cl.clump(df, 150).collect()} == greedy(rows, 150)


def test_collapse_equals_sequential(spark):
    rows, df = hits(spark, 120, 9)
    loci, want = [], {}
    for c, pos, p, i in sorted(rows, key=lambda r: (r[2], r[3])):
        k = next((l for l in loci if any(a == c and abs(b - pos) <= 60 for a, b, _ in l)), None)
        if k is None:
            loci.append([])
            k = loci[-1]
        k.append((c, pos, i))
        want[i] = k[0][2]
    got = cl.collapse_loci(df.withColumnRenamed("chrom", "grp"), 60)
    assert {r["id"]: r["locus"] for r in got.collect()} == want


def test_locus_hand_table(spark):
    # 40 and 90 reach each other through 65; 141 is one too far from 90; the same places elsewhere stay apart
    rows = [("u", 65, 0.02, 7), ("u", 40, 0.03, 5), ("u", 90, 0.01, 6), ("u", 141, 0.04, 4), ("w", 65, 0.05, 3), ("w", 66, 0.06, 2)]
    df = spark.createDataFrame(rows, "grp string, pos bigint, p double, id bigint")
    sizes = sorted(r["count"] for r in cl.collapse_loci(df, 50).groupBy("locus").count().collect())
    assert sizes == [1, 2, 3]


def test_claims_hand_table(spark):
    loci = spark.createDataFrame([(1, 1e-9, 1), (2, 1e-8, 1), (3, 1e-7, 3), (4, 1e-6, 4)], "id bigint, p double, locus bigint")
    truth = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (9, 1)], "id bigint, causal bigint")
    r = cl.claim_loci(loci, truth).first()
    assert (r["n_loci"], r["n_tp_loci"], r["n_fp_loci"], r["n_detected_causal"], r["power"]) == (3, 2, 1, 2, 1.0)
    assert abs(r["fdp"] - 1 / 3) < 1e-12


def test_robust_z_with_a_key_named_like_a_count(spark):
    rows = [(i, float(i * i % 97), float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, n double, k double")
    got = {r["id"]: r for r in rk.robust_z(df, {"n": "zn", "k": "zk"}).collect()}
    for j, c in ((1, "zn"), (2, "zk")):
        x = np.array([r[j] for r in rows])
        med = np.median(x)
        mad = np.median(np.abs(x - med))
        assert np.allclose([got[i][c] for i in range(200)], (x - med) / (1.4826 * mad))


def test_interval_join_edges_and_hot_bin(spark):
    pts = [("c", 150 if i % 2 else i * 3, i) for i in range(200)]
    gs = [("g1", "c", 100, 200), ("g2", "c", 300, 400), ("g3", "c", 150, 150), ("g4", "d", 0, 900)]
    p = spark.createDataFrame(pts, "chrom string, pos bigint, id bigint")
    g = spark.createDataFrame(gs, "gene string, chrom string, start bigint, end bigint")
    for flank in (0, 5):
        got = {(r["id"], r["gene"]) for r in iv.points_in_intervals(p, g, F.col("start") - flank, F.col("end") + flank, 64).collect()}
        assert got == {(i, n) for c, x, i in pts for n, gc, s, e in gs if gc == c and s - flank <= x <= e + flank}


def test_hot_join_is_the_join(spark):
    left = spark.createDataFrame([("h" if i % 3 else str(i), i) for i in range(300)], "k string, id bigint")
    right = spark.createDataFrame([("h", 1), ("h", 2), ("3", 3)], "k string, w bigint")
    got = sorted((r["k"], r["id"], r["w"]) for r in hot_join(left, right, ["k"]).collect())
    assert got == sorted((r["k"], r["id"], r["w"]) for r in left.join(right, "k").collect())


def test_nearest_point_and_gene(spark):
    rnd = random.Random(4)
    pts = [(i, f"c{i % 3}", rnd.randrange(1000)) for i in range(150)]
    refs = [(f"c{i % 2}", rnd.randrange(1000), i, f"q{i}") for i in range(40)]
    p = spark.createDataFrame(pts, "id bigint, chrom string, pos bigint")
    r = spark.createDataFrame(refs, "chrom string, rpos bigint, o bigint, nm string")
    got = {x["id"]: (x["near_name"], x["near_dist"]) for x in iv.nearest_point(p, r, "id", "o", "nm").collect()}
    for i, c, x in pts:
        best = min(((abs(x - rp), o, nm) for rc, rp, o, nm in refs if rc == c), default=None)
        assert got[i] == ((best[2], best[0]) if best else (None, None))
    gs = [(f"c{i % 2}", s, s + rnd.randrange(40), f"g{i:02d}") for i, s in enumerate(rnd.randrange(1000) for _ in range(30))]
    g = spark.createDataFrame(gs, "chrom string, gstart bigint, gend bigint, gname string")
    ng = {x["id"]: (x["nearest_gene"], x["nearest_gene_dist"]) for x in iv.nearest_gene(p, g, "id").collect()}
    for i, c, x in pts:
        cand = [(0 if s <= x <= e else x - e if e < x else s - x, 0 if s <= x <= e else 1 if e < x else 2, s, n) for gc, s, e, n in gs if gc == c]
        assert ng[i] == ((min(cand)[3], min(cand)[0]) if cand else (None, None))


def test_components(spark):
    rnd = random.Random(5)
    edges = [("hub", f"n{i}") for i in range(40)] + [(f"p{i}", f"p{i + 1}") for i in range(25)] + [(f"x{rnd.randrange(30)}", f"x{rnd.randrange(30)}") for _ in range(20)]
    got = {r["node"]: r["comp"] for r in hm.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert got == {n: find(n) for n in parent}
    assert all(got[n] == min(m for m in got if got[m] == got[n]) for n in got)


def test_top_k_hot_group(spark):
    df = spark.createDataFrame([("h" if i % 3 else f"g{i}", float(-i)) for i in range(200)], "g string, x double")
    got = so.top_k(df, ["g"], [F.col("x").asc()], 4).where("g = 'h'").orderBy("rnk").collect()
    assert [r["x"] for r in got] == [-199.0, -197.0, -196.0, -194.0]


def test_ld_loci_rounds(spark):
    rnd = random.Random(6)
    h = [(i, f"c{i % 2}", rnd.random()) for i in range(40)]
    ld = [(rnd.randrange(40), rnd.randrange(40), rnd.random()) for _ in range(120)]
    got = {r["id"]: r["lead_id"] for r in cl.ld_loci(spark.createDataFrame(h, "id bigint, chrom string, p double"),
                                                     spark.createDataFrame(ld, "a bigint, b bigint, r2 double"), 0.5).collect()}
    r2 = {}
    for a, b, v in ld:
        r2[a, b] = max(v, r2.get((a, b), 0))
        r2[b, a] = max(v, r2.get((b, a), 0))
    want, done = {}, set()
    for i, c, p in sorted(h, key=lambda x: (x[2], x[0])):
        if i in done:
            continue
        done.add(i)
        want[i] = i
        for j, cj, _ in h:
            if j not in done and cj == c and r2.get((i, j), 0) >= 0.5:
                done.add(j)
                want[j] = i
    assert got == want
