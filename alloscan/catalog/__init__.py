"""Every registered query; importing the package fills the registry."""

import importlib

from alloscan.catalog.registry import ORACLES, QUERIES

for _m in ("genotype_queries", "ranking_queries", "interval_queries", "homolog_queries", "kernel_queries",
           "model_queries", "source_queries", "candidate_queries", "expression_queries"):
    importlib.import_module(f"alloscan.catalog.{_m}")

__all__ = ["ORACLES", "QUERIES"]
