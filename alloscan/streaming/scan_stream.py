"""Scan of marker batches as they arrive: a stateless map with an append sink.

Chunked reading of a file is partitioning in Spark. The stream form serves panels whose
marker files land over time; summaries that need all rows (the median inflation) run in
batch over the sink.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alloscan.functions.stat_columns import genomic_inflation
from alloscan.operators.score_scan import kernel_scan


def start_scan(spark: SparkSession, source: str, sink: str, checkpoint: str, contexts: dict, schema: str,
               maf_min: float = 0.01, call_rate_min: float = 0.9, chrom_col: str | None = None,
               keep: list[str] | None = None, max_files: int = 64) -> StreamingQuery:
    """Read variant files under ``source``, scan each batch, append kept markers to ``sink``.

    ``checkpoint`` must lie in the shared folder; the file sink makes each batch exactly once.
    """
    v = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    cols = ["v", "dosage", *(keep or [])]
    out = kernel_scan(v.select(*cols), contexts, maf_min, call_rate_min, chrom_col, keep)
    return (out.where(F.col("status") == "ok").drop("status").writeStream.format("parquet").outputMode("append")
            .option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def inflation_of_sink(spark: SparkSession, sink: str, levels: list[str]):
    return genomic_inflation(spark.read.parquet(sink), levels)
