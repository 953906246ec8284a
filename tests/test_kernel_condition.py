"""Gram matrix and condition number of vectorised kernels against dense algebra."""

import numpy as np
import pytest

from alloscan.functions import mixed_model as mm
from alloscan.operators import relationship as rel


def cells(spark, kernels):
    rows = [(g, i, j, float(k[i, j])) for g, k in kernels.items() for i in range(len(k)) for j in range(i, len(k))]
    return spark.createDataFrame(rows, "grp string, i int, j int, k double")


def test_condition_equals_dense_algebra(spark):
    rng = np.random.default_rng(4)
    z = {g: rng.normal(size=(9, 30)) for g in "ABD"}
    kernels = {g: x @ x.T / 30 for g, x in z.items()}
    row = rel.kernel_condition(cells(spark, kernels)).first()
    assert row["n_columns"] == 4
    assert row["condition"] == pytest.approx(mm.kernel_condition(kernels), rel=1e-8)
    gram = {(r["grp_a"], r["grp_b"]): r["g"] for r in rel.kernel_gram(cells(spark, kernels)).collect()}
    assert len(gram) == 10
    assert gram["A", "D"] == pytest.approx((kernels["A"] * kernels["D"]).sum())
    assert gram["B", "I"] == pytest.approx(np.trace(kernels["B"])) and gram["I", "I"] == pytest.approx(9)


def test_dependent_kernels_and_no_kernels(spark):
    one = np.eye(5) + 0.25
    assert rel.kernel_condition(cells(spark, {"A": one, "B": 2 * one})).first()["condition"] > 1e6
    assert rel.kernel_condition(cells(spark, {"A": one}).limit(0)).count() == 0


def test_query_equals_numpy(spark):
    from alloscan.catalog import QUERIES
    from alloscan.catalog import kernel_queries as kq
    d = "/root/testdata/sf0.001"
    dense = rel.dense(kq.kernels(spark, d), len(kq.panel(spark, d)))
    assert QUERIES["agg_kernel_condition"](spark, d).first()["condition"] == pytest.approx(mm.kernel_condition(dense), rel=1e-5)
