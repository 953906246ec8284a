"""Time the headline queries on one data set; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "entry_scan", "agg_af", "agg_grm", "agg_grm_loco", "k_scan", "k_scan_loco", "agg_lambda", "agg_burden",
    "k_pair_scan", "k_clique", "join_snp_gene", "join_qtl_window", "join_nearest_qtl", "join_rbh",
    "set_graph", "win_audit", "win_bh", "win_rank_ties", "top_clump", "fn_acat", "fn_fusion", "src_vcf",
)


def main() -> None:
    from alloscan.catalog import QUERIES
    from alloscan.session import local_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "alloscan-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    # one untimed pass of the scan loads the JVM and the Python workers
    QUERIES["entry_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, only = {}, sys.argv[1:]
    for name in only or HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
