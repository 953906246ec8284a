"""Registered queries against their SQL. All of them with ALLOSCAN_ALL=1, else a quick choice."""

import os

import compare
import pytest

from alloscan.catalog import ORACLES, QUERIES

SF = os.environ.get("ALLOSCAN_SF", "/root/testdata/sf0.001")
QUICK = ("entry_scan agg_af flt_qc_reason agg_lambda agg_burden agg_grm agg_grm_loco agg_kernel_norm win_rank_ties win_bh "
         "win_holm join_snp_gene join_qtl_window join_nearest_qtl join_nearest_gene join_rbh join_triangle set_graph win_audit "
         "top_clump top_collapse k_eval fn_harmonize src_vcf src_gff src_collinearity agg_triad_balance agg_type1 k_design "
         "k_loqo fn_acat join_sentinel win_robust_z fn_ldr2").split()
NAMES = sorted(QUERIES) if os.environ.get("ALLOSCAN_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 200


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    res = compare.compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert res["ok"], res.get("why")
