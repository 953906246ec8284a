"""Helpers shared by the text operators: shared folder, hashes of texts in NumPy, split rules."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The blanks that end a word: space and the control characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="alloscan-llm-")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, whichever executor is lost later."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def constant_array(values: list, kind: str) -> Column:
    """A literal array, for lambdas, which take no subquery; ``values`` is a table of a fixed size."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def bounded_sample(rows: DataFrame, *key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, those with the least hash of ``key``.

    Hashes are spread evenly, so a first cut at a fifth more than the wanted share leaves few rows to order,
    however many there are in all.
    """
    h = F.xxhash64(F.lit("sample"), *key)
    n = rows.count()
    if n > bound:
        share = min(1.0, (1.2 * bound + 50) / n)
        rows = rows.where(h <= int(-(1 << 63) + share * ((1 << 64) - 1)))
    return rows.orderBy(h).limit(bound)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id, which is neither held out nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (two multiply-xorshift rounds)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def blank(cp: np.ndarray) -> np.ndarray:
    return (cp == 32) | ((cp >= 9) & (cp <= 13))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def run_hashes(cp: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each run: its characters, scrambled with their place in the run, summed and scrambled."""
    if not len(start):
        return np.zeros(0, np.uint64)
    begins = np.zeros(len(cp), np.int64)
    begins[start] = start
    place = np.arange(len(cp)) - np.maximum.accumulate(begins)
    part = mix64(cp.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21)))
    part *= inside  # reduceat also adds what lies between two runs
    return mix64(np.add.reduceat(part, start) + (end - start).astype(np.uint64))


def lower_ascii(cp: np.ndarray) -> np.ndarray:
    return np.where((cp >= 65) & (cp <= 90), cp + 32, cp).astype(np.uint32)
