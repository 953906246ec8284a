"""Binary hard-call genotypes (bed/bim/fam) as a Spark data source, and its 2-bit codec."""

from __future__ import annotations

import itertools
import json
import os
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = b"\x6c\x1b\x01"
BIM_DDL = "chrom string, snp_id string, cm double, pos bigint, a1 string, a2 string"
# fixed values: 2-bit codes as counts of the first allele; code 1 is a missing call
CODE_TO_A1 = (2.0, float("nan"), 1.0, 0.0)


def decode_bytes(raw: np.ndarray, n: int) -> np.ndarray:
    """(markers x bytes) -> (markers x n) first-allele counts, NaN = missing."""
    codes = (raw[:, :, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3
    return np.array(CODE_TO_A1, dtype=np.float32)[codes.reshape(len(raw), -1)[:, :n]]


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local path or of a URI that pyarrow knows (file, hdfs, s3, gs, ...)."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def _size(path: str) -> int:
    where, p = _at(path)
    info = where.get_file_info(p)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(f"{path} is missing; write bed, bim and fam with the same prefix")
    return info.size


def _need(prefix: str) -> None:
    for ext in (".bed", ".bim", ".fam"):
        _size(prefix + ext)


def sample_ids(prefix: str) -> list[str]:
    """Within-family ids in file order (one line per panel sample)."""
    _need(prefix)
    where, p = _at(prefix + ".fam")
    with where.open_input_stream(p) as fh:
        return [ln.split()[1] for ln in fh.read().decode().splitlines() if ln.strip()]


#: Bytes of the marker file that one task of the index reads, and lines between two stored offsets.
INDEX_BLOCK, INDEX_STEP = 16 << 20, 1024


def _index_block(path: str, i: int) -> tuple[int, list[int]]:
    """Line ends in block ``i`` of a text file, and the byte after every INDEX_STEP-th of them."""
    where, p = _at(path)
    with where.open_input_file(p) as fh:
        ends = np.flatnonzero(np.frombuffer(fh.read_at(INDEX_BLOCK, i * INDEX_BLOCK), dtype=np.uint8) == 10)
    return len(ends), (i * INDEX_BLOCK + ends[INDEX_STEP - 1::INDEX_STEP] + 1).tolist()


def _chunk_starts(blocks: list[tuple[int, list[int]]], m: int, step: int) -> list[list[int]]:
    """Per chunk of ``step`` lines the stored offset at or before its first line, and the lines to pass over from there."""
    if sum(n for n, _ in blocks) < m - 1:  # the last line may lack its end
        raise ValueError("the bim file has fewer lines than the bed file has markers")
    line, offset, before = [0], [0], 0
    for n, marks in blocks:
        line += [before + (k + 1) * INDEX_STEP for k in range(len(marks))]
        offset += marks
        before += n
    first = np.arange(0, m, step)
    at = np.searchsorted(line, first, side="right") - 1
    return [[offset[j], int(a - line[j])] for j, a in zip(at, first)]


def _index_blocks(path: str) -> range:
    return range(-(-_size(path) // INDEX_BLOCK))


def index_bim(spark: SparkSession, path: str) -> list[tuple[int, list[int]]]:
    """The blocks of a marker file in order, each read once by a task of its own; one number per INDEX_STEP lines comes back."""
    n = len(_index_blocks(path))

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [_index_block(path, i) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f[0] for f in found], pa.int64()),
                                              pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["id", "n", "marks"])
    rows = spark.range(0, n, 1, max(n, 1)).mapInArrow(run, "id bigint, n bigint, marks array<bigint>").collect()
    return [(r["n"], list(r["marks"])) for r in sorted(rows, key=lambda r: r["id"])]


class _Range(InputPartition):
    def __init__(self, start: int, end: int, offset: int = 0, skip: int = 0):
        self.start, self.end, self.offset, self.skip = start, end, offset, skip


class BedReader(DataSourceReader):
    """Partitions are marker ranges; a range maps to one contiguous slice of the bed file and one of the marker file.

    ``starts`` holds the place of every range in the marker file (from ``index_bim``); without it the marker
    file is indexed here, block by block.
    """

    def __init__(self, options: dict):
        self.prefix = options["path"]
        self.step = int(options.get("chunk_size", 20_000))
        if self.step < 1:
            raise ValueError("chunk_size must be at least 1")
        self.subgenome = options.get("subgenome", "")
        self.n = len(sample_ids(self.prefix))
        self.width = (self.n + 3) // 4
        self.m = (_size(self.prefix + ".bed") - 3) // self.width
        self.starts = options.get("starts")

    def partitions(self):
        bim = self.prefix + ".bim"
        starts = json.loads(self.starts) if self.starts else _chunk_starts([_index_block(bim, i) for i in _index_blocks(bim)], self.m, self.step)
        return [_Range(i, min(i + self.step, self.m), *at) for i, at in zip(range(0, self.m, self.step), starts)] or [_Range(0, 0)]

    def _bim_lines(self, part: _Range):
        """Fields of the range's markers, read from its stored offset on."""
        where, p = _at(self.prefix + ".bim")
        with where.open_input_file(p) as fh:
            fh.seek(part.offset)
            rest, passed, left = b"", 0, part.end - part.start
            while left:
                buf = fh.read(1 << 16)
                *lines, rest = (rest + buf).split(b"\n") if buf else [rest, b""]
                for ln in lines[max(0, part.skip - passed):][:left]:
                    left -= 1
                    yield ln.decode().split()
                passed += len(lines)
                if not buf:
                    return

    def read(self, partition):
        a, b = partition.start, partition.end
        if b <= a:
            return
        bim = self._bim_lines(partition)
        where, p = _at(self.prefix + ".bed")
        with where.open_input_file(p) as fh:
            if fh.read_at(3, 0) != MAGIC:
                raise ValueError(f"{self.prefix}.bed is not a variant-major bed file")
            for lo in range(a, b, 4096):
                hi = min(lo + 4096, b)
                raw = np.frombuffer(fh.read_at((hi - lo) * self.width, 3 + lo * self.width), dtype=np.uint8)
                dose = decode_bytes(raw.reshape(hi - lo, self.width), self.n)
                part = list(itertools.islice(bim, hi - lo))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(lo, hi)), pa.array([f[1] for f in part]),
                    pa.array([self.subgenome] * len(part)), pa.array([f[0] for f in part]),
                    pa.array([int(f[3]) for f in part]), pa.array([f[4] for f in part]), pa.array([f[5] for f in part]),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * self.n, self.n, dtype=np.int32)),
                                             pa.array(dose.ravel(), from_pandas=True))],
                    names=["variant_index", "snp_id", "subgenome", "chrom", "pos", "a1", "a2", "dosage"])


class BedSource(DataSource):
    @classmethod
    def name(cls):
        return "plink_bed"

    def schema(self):
        return ("variant_index bigint, snp_id string, subgenome string, chrom string, pos bigint, "
                "a1 string, a2 string, dosage array<float>")

    def reader(self, schema):
        return BedReader(self.options)


def read_bed(spark: SparkSession, prefix: str, chunk_size: int = 20_000, subgenome: str = "") -> DataFrame:
    """One row per marker in file order of ``variant_index``; null dosage = missing call.

    The marker file is indexed by one job first, so every partition seeks to its own lines. ``prefix`` is a
    path that all executors share, or a URI.
    """
    _need(prefix)
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    spark.dataSource.register(BedSource)
    m = (_size(prefix + ".bed") - 3) // ((len(sample_ids(prefix)) + 3) // 4)
    starts = _chunk_starts(index_bim(spark, prefix + ".bim"), m, chunk_size)
    return (spark.read.format("plink_bed").option("chunk_size", chunk_size).option("starts", json.dumps(starts))
            .option("subgenome", subgenome).load(prefix))


def encode_dosages(dose: np.ndarray) -> np.ndarray:
    """(markers x n) first-allele counts, NaN = missing -> (markers x bytes)."""
    code = np.select([np.isnan(dose), dose == 2, dose == 1], [1, 0, 2], 3).astype(np.uint8)
    code = np.pad(code, ((0, 0), (0, -dose.shape[1] % 4))).reshape(len(dose), -1, 4)
    return (code << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(2).astype(np.uint8)


def pack_calls(variants: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``rec``: the binary bed record of each dosage array."""
    ddl = ", ".join(f"{c} {variants.schema[c].dataType.simpleString()}" for c in keep) + ", rec binary"

    def run(batches):
        for pdf in batches:
            if len(pdf):
                raw = encode_dosages(np.stack([np.asarray(a, float) for a in pdf["dosage"]]))
                yield pdf[keep].assign(rec=[r.tobytes() for r in raw])
    return variants.select(*keep, "dosage").mapInPandas(run, ddl)


def unpack_calls(records: DataFrame, keep: list[str], n: int) -> DataFrame:
    """``keep`` columns and ``dosage``: the decoded array of ``n`` samples (null = missing)."""
    ddl = ", ".join(f"{c} {records.schema[c].dataType.simpleString()}" for c in keep) + ", dosage array<float>"

    def run(batches):
        for pdf in batches:
            if len(pdf):
                dose = decode_bytes(np.stack([np.frombuffer(b, dtype=np.uint8) for b in pdf["rec"]]), n)
                yield pdf[keep].assign(dosage=[[None if x != x else x for x in row] for row in dose.tolist()])
    return records.select(*keep, "rec").mapInPandas(run, ddl)


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """Marker table: whitespace-separated columns under a declared schema."""
    return parse_bim(spark.read.text(path))


def parse_bim(lines: DataFrame) -> DataFrame:
    c = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select(
        F.get(c, F.lit(0)).alias("chrom"), F.get(c, F.lit(1)).alias("snp_id"), F.get(c, F.lit(2)).cast("double").alias("cm"),
        F.get(c, F.lit(3)).cast("bigint").alias("pos"), F.get(c, F.lit(4)).alias("a1"), F.get(c, F.lit(5)).alias("a2"))


def _append(where: fs.FileSystem, parts: list[str], target: str, head: bytes = b"") -> None:
    """One file from part files, byte block by byte block; it takes its name when it is whole."""
    with where.open_output_stream(target + ".tmp") as out:
        out.write(head)
        for part in parts:
            with where.open_input_stream(part) as fh:
                while buf := fh.read(INDEX_BLOCK):
                    out.write(buf)
    where.move(target + ".tmp", target)


def write_bed(variants: DataFrame, prefix: str, samples: list[str]) -> int:
    """Write a variant table as one bed/bim/fam set; returns the number of markers.

    Tasks write part files of consecutive markers, named by their attempt, so a repeated task does no harm; only one
    row per part comes back. The parts are then joined as bytes. ``prefix`` is a path that all executors share, or a URI.
    """
    where, base = _at(prefix)
    folder = f"{base}.parts-{uuid.uuid4().hex}"
    where.create_dir(folder, recursive=True)
    rows = pack_calls(variants, ["chrom", "snp_id", "pos", "a1", "a2", "variant_index"])

    def run(batches):
        at = TaskContext.get()
        name = f"{folder}/{at.partitionId()}-{at.taskAttemptId()}"
        store, n, first = _at(prefix)[0], 0, None
        with store.open_output_stream(name + ".bed") as bed, store.open_output_stream(name + ".bim") as bim:
            for pdf in batches:
                if len(pdf):
                    first = int(pdf["variant_index"].iloc[0]) if first is None else first
                    bed.write(b"".join(pdf["rec"]))
                    bim.write("".join(f"{c}\t{i}\t0\t{p}\t{x}\t{y}\n" for c, i, p, x, y in zip(
                        *(pdf[k] for k in ("chrom", "snp_id", "pos", "a1", "a2")))).encode())
                    n += len(pdf)
        yield pd.DataFrame({"first": [first], "name": [name], "n": [n]}).astype({"first": "Int64"})
    parts = (rows.repartitionByRange("variant_index").sortWithinPartitions("variant_index")
             .mapInPandas(run, "first bigint, name string, n bigint").where("n > 0").collect())
    names = [r["name"] for r in sorted(parts, key=lambda r: r["first"])]
    with where.open_output_stream(base + ".fam") as fam:
        fam.write("".join(f"{s} {s} 0 0 0 -9\n" for s in samples).encode())
    _append(where, [f"{x}.bed" for x in names], base + ".bed", MAGIC)
    _append(where, [f"{x}.bim" for x in names], base + ".bim")
    where.delete_dir(folder)
    return sum(r["n"] for r in parts)
