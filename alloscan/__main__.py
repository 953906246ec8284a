"""Command line: ``python -m alloscan <command>``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _spark() -> SparkSession:
    return SparkSession.builder.appName("alloscan").getOrCreate()


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="alloscan")
    sub = p.add_subparsers(dest="cmd", required=True)
    f = sub.add_parser("fit", help="association scan of one trait")
    f.add_argument("config")
    f.add_argument("--dry-run", action="store_true")
    f.add_argument("--force", action="store_true")
    v = sub.add_parser("validate", help="check a run configuration")
    v.add_argument("config")
    s = sub.add_parser("split", help="split genotypes by subgenome")
    s.add_argument("species")
    s.add_argument("out_dir")
    s.add_argument("--dry-run", action="store_true")
    s.add_argument("--force", action="store_true")
    d = sub.add_parser("demo", help="write a small demonstration panel")
    d.add_argument("out_dir")
    loc = sub.add_parser("locus", help="lead markers of a finished run")
    loc.add_argument("results")
    loc.add_argument("--top-n", type=int, default=3)
    t = sub.add_parser("top", help="smallest p-values of a finished run")
    t.add_argument("results")
    t.add_argument("-n", type=int, default=10)
    ds = sub.add_parser("design", help="predicted callable pairs over a depth grid")
    ds.add_argument("--g-full", type=float, required=True)
    ds.add_argument("--lambda-full", type=float, required=True)
    ds.add_argument("--depths", default="1,2,5,10,20,30")
    a = p.parse_args(argv)
    spark = _spark()
    if a.cmd in ("fit", "validate"):
        from alloscan.plans.fit import run_fit, validate
        from alloscan.sources.config import load_run_config
        cfg = load_run_config(a.config)
        if a.cmd == "validate":
            bad = validate(cfg)
            print("\n".join(bad) or "ok")
            return int(bool(bad))
        doc = run_fit(spark, cfg, a.dry_run, a.force)
        print(json.dumps({k: doc.get(k) for k in ("trait", "n_samples", "lambda_gc", "accepted")}, default=str))
        return int(not doc.get("accepted", True))
    if a.cmd == "split":
        from alloscan.plans.split import execute_split, plan_split
        from alloscan.sources.config import load_document, species_config
        cfg = species_config(load_document(a.species))
        plan = execute_split(spark, plan_split(cfg, a.out_dir), cfg, a.dry_run, a.force)
        for w in plan.works:
            print(w.subgenome, w.status, w.message)
        return int(any(w.status == "ERROR" for w in plan.works))
    if a.cmd == "demo":
        from alloscan.plans.demo import make_demo
        print(json.dumps(make_demo(spark, a.out_dir)))
    elif a.cmd == "locus":
        from alloscan.plans.locus import leads, results
        leads(results(spark, a.results), a.top_n).show(truncate=False)
    elif a.cmd == "top":
        from alloscan.plans.fit import top_hits
        top_hits(spark, a.results, a.n).show(truncate=False)
    elif a.cmd == "design":
        from pyspark.sql import functions as F

        from alloscan.operators import design as g
        grid = spark.createDataFrame([(float(x),) for x in a.depths.split(",")], "depth double")
        for mode in g.MODES:
            pred = g.predicted_pairs(g.retention(F.col("depth"), mode), F.lit(a.g_full), F.lit(a.lambda_full))
            grid.select(F.lit(mode).alias("mode"), "depth", g.retention(F.col("depth"), mode).alias("retention"),
                        pred.alias("g_pred"), g.band(pred).alias("band")).show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
