"""Unique k-mers against sets, in one part and in many."""

from collections import defaultdict

import numpy as np
import pytest

from alloscan.operators import expression as ex


def _plain(rows, k):
    own = defaultdict(set)
    for g, c, s in rows:
        if s is not None and len(s) >= k:
            own[g, c] |= {s[i:i + k] for i in range(len(s) - k + 1)}
    out = {}
    for (g, c), x in own.items():
        rest = set().union(*(y for (h, e), y in own.items() if h == g and e != c))
        out[g, c] = (len(x), 0 if g is None or c is None else len(x - rest) / len(x))
    return out


@pytest.mark.parametrize("letters", [1 << 20, 300])
def test_unique_kmers_in_parts(spark, monkeypatch, letters):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("ACGTN"), 700))
    rows = [(1, 0, base), (1, 1, base[:300] + "A" * 120 + base[300:]), (1, 1, base[100:400]), (2, 0, base[:31]), (2, 1, base[:30]), (2, 2, None),
            (None, 0, base[50:250]), (None, None, base[60:300]), (3, None, base[:200]), (3, 1, base[:90] + "é\U0001f600" + base[90:])]
    monkeypatch.setattr(ex, "KMER_PART", letters)
    got = ex.unique_kmers(spark.createDataFrame(rows, "grp bigint, cp int, seq string"), 31)
    assert {(r.grp, r.cp): (r.n_kmers, pytest.approx(r.unique_fraction)) for r in got.collect()} == _plain(rows, 31)
    # the k-mers are made behind the last exchange of text: one row for a sequence in a small group, not one for a k-mer
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(sequence(1, (length(piece" not in plan


def test_runs_keep_every_kmer_and_its_part():
    seq = "".join(np.random.default_rng(5).choice(list("ACGT"), 5000))
    runs = ex.kmer_runs(seq, 31, 7)
    assert len(runs) < 1500  # pieces, not k-mers
    part = defaultdict(set)
    for p, x in runs:
        for i in range(len(x) - 30):
            part[x[i:i + 31]].add(p)
    assert set(part) == {seq[i:i + 31] for i in range(len(seq) - 30)} and all(len(p) == 1 for p in part.values())
