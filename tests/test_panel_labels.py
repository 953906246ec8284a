"""Labels of the Manhattan panels against a plain walk over the points."""

import random

from alloscan.operators import ranking as rk


def plain(rows, n, level, share):
    out = set()
    for panel in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == panel]
        offset, at = {}, 0.0
        for c in sorted({r[1] for r in mine}):
            pos = [r[2] for r in mine if r[1] == c]
            span = max(max(pos) - min(pos), 1)
            offset[c] = (at, min(pos))
            at += span + max(span * 0.01, 1)
        x = {r: offset[r[1]][0] + r[2] - offset[r[1]][1] for r in mine}
        gap, kept = share * (max(x.values()) + 1), []
        for r in sorted((r for r in mine if r[4] is not None and r[4] <= level), key=lambda r: (r[4], r[1], r[2], r[3]))[:n]:
            if all(abs(x[r] - x[k]) >= gap for k in kept):
                kept.append(r)
        out |= {(r[0], r[3], round(x[r], 6)) for r in kept}
    return out


def test_labels_equal_a_plain_walk(spark):
    rng = random.Random(8)
    rows = [(rng.choice("AB"), rng.choice(["c1", "c2", "c3"]), rng.randint(1, 5000), f"m{i}", rng.choice([0.001, 0.01, 0.02, 0.5, None])) for i in range(400)]
    rows += [("D", "c9", 7, "alone", 0.04), ("E", "c9", 7, "weak", 0.4)]
    df = spark.createDataFrame(rows, "sub string, chrom string, pos long, snp string, p double")
    for n in (1, 5, 40):
        got = rk.panel_labels(df, "sub", ["snp"], n, 0.05).collect()
        assert {(r["sub"], r["snp"], round(r["x"], 6)) for r in got} == plain(rows, n, 0.05, 0.02)
        assert len(got) == len({(r["sub"], r["snp"]) for r in got})
    assert rk.panel_labels(df.limit(0), "sub", ["snp"], 5, 0.05).count() == 0
