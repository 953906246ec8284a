"""Interaction tests again under what lies around the two genes: neighbouring burdens, markers and their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloscan.functions import mixed_model as mm
from alloscan.session import cut_lineage

WINDOWS = (500_000, 1_000_000, 2_000_000)
CONTROLS = ("focal_copy", "strongest_neighbour", "burden_components", "top_markers", "marker_components")
BIN = 1_000_000
#: Genes whose sums a task holds at once.
GENES_AT_ONCE = 16
_AROUND = ("gene string, xs array<string>, ys array<string>, window_bp bigint, kind int, n bigint, gram array<double>, t array<double>, key array<string>, vec array<array<double>>")


def _marginal_t(wh: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """|t| of each row alone beside an intercept, after whitening."""
    q = np.linalg.qr(wh @ np.ones((len(y), 1)))[0]
    x, t = rows @ wh.T, wh @ y
    x, t = x - (x @ q) @ q.T, t - q @ (q.T @ t)
    ss, xy = np.einsum("ij,ij->i", x, x), x @ t
    rss = np.maximum(t @ t - xy * xy / np.maximum(ss, 1e-300), 1e-300)
    return np.where(ss > 1e-10, np.abs(xy) / np.sqrt(np.maximum(ss, 1e-300) * rss / (len(y) - 2)), 0.0)


class _Sums:
    """What is kept of the vectors around a gene within a window: their number, Gram matrix over the panel, and the first by |t|."""

    def __init__(self, n: int, top: int):
        self.count, self.gram, self.top = 0, np.zeros((n, n)), top
        self.t, self.key, self.vec = np.zeros(0), np.zeros(0, object), np.zeros((0, n))

    def add(self, rows: np.ndarray, t: np.ndarray, key: np.ndarray) -> None:
        c = rows - rows.mean(1, keepdims=True)
        self.count += len(rows)
        self.gram += c.T @ c
        t, key, rows = np.concatenate((self.t, t)), np.concatenate((self.key, key)), np.concatenate((self.vec, rows))
        first = np.lexsort((key.astype(str), -t))[:self.top]
        self.t, self.key, self.vec = t[first], key[first], rows[first]


def around(focal: DataFrame, genes: DataFrame, burdens: DataFrame, markers: DataFrame, context: tuple, windows: tuple = WINDOWS, top: int = 10) -> DataFrame:
    """Sums over the burdens (kind 1) and markers (kind 2) within each window of each ``focal`` gene, itself left out.

    ``focal``: ``gene`` once, and ``xs, ys``, the pairs that its sums are for. ``gram`` is the upper triangle by rows.

    ``genes``: ``gene, chrom, pos``; ``markers``: ``v, chrom, pos, vec``. Vectors are sent to the bins that they
    can matter to; a task reads a bin's genes first and then adds vector after vector, so it holds n x n sums for
    GENES_AT_ONCE genes, however many markers there are. A bin of more genes is dealt in parts.
    """
    wh, y, _ = context
    n, widest = len(y), max(windows)
    shared = focal.sparkSession.sparkContext.broadcast((wh, y))
    at = focal.join(genes, "gene").withColumn("bin", F.floor(F.col("pos") / BIN))
    parts = at.groupBy("chrom", "bin").agg(F.ceil(F.count("*") / GENES_AT_ONCE).cast("int").alias("parts"))
    at = cut_lineage(at.join(parts, ["chrom", "bin"]).withColumn("part", F.pmod(F.hash("gene"), F.col("parts"))))
    vectors = (burdens.join(genes, "gene").select(F.lit(1).alias("kind"), F.col("gene").alias("key"), "chrom", "pos", "vec").unionByName(
        markers.select(F.lit(2).alias("kind"), F.col("v").cast("string").alias("key"), "chrom", "pos", "vec")))
    sent = (vectors.withColumn("bin", F.explode(F.sequence(F.floor((F.col("pos") - widest) / BIN), F.floor((F.col("pos") + widest) / BIN))))
            .join(parts, ["chrom", "bin"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))
    rows = at.select(F.lit(0).alias("kind"), F.col("gene").alias("key"), "chrom", "pos", F.lit(None).cast("array<double>").alias("vec"), "bin", "part", "xs", "ys").unionByName(sent, allowMissingColumns=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wh, y = shared.value
        held, here, sums, of = None, [], {}, {}
        upper = np.triu_indices(n)

        def done() -> pd.DataFrame:
            return pd.DataFrame([(g, *of[g], w, k, s.count, s.gram[upper].tolist(), s.t.tolist(), s.key.tolist(), s.vec.tolist()) for (g, w, k), s in sums.items()],
                                columns=[c.split()[0] for c in _AROUND.split(", ")])
        for pdf in batches:
            for place, b in pdf.groupby(["chrom", "bin", "part"], sort=False):
                if place != held:
                    if sums:
                        yield done()
                    held, here, sums, of = place, [], {}, {}
                own = b[b["kind"] == 0]
                here += list(zip(own["key"], own["pos"]))
                of |= {g: (list(x), list(y)) for g, x, y in zip(own["key"], own["xs"], own["ys"])}
                for kind, v in b[b["kind"] > 0].groupby("kind"):
                    vec, pos, key = np.stack(v["vec"].to_list()).astype(float), v["pos"].to_numpy(), v["key"].to_numpy(object)
                    t = _marginal_t(wh, y, vec)
                    for gene, p in here:
                        for w in windows:
                            near = (np.abs(pos - p) <= w) & ((kind == 2) | (key != gene))
                            if near.any():
                                sums.setdefault((gene, w, int(kind)), _Sums(n, 1 if kind == 1 else top)).add(vec[near], t[near], key[near])
        if sums:
            yield done()

    dealt = rows.repartition("chrom", "bin", "part").sortWithinPartitions("chrom", "bin", "part", "kind")
    return dealt.select("kind", "key", "chrom", "pos", "vec", "bin", "part", "xs", "ys").mapInPandas(run, _AROUND)


def _components(gram: np.ndarray, share: float, most: int) -> np.ndarray:
    """Leading components (columns) of the vectors with this Gram matrix, until they have ``share`` of the variance."""
    values, vectors = np.linalg.eigh(gram)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    if values.sum() <= 0:
        return np.zeros((len(gram), 0))
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), share) + 1)
    k = min(k, most, int((values > 1e-12 * values[0]).sum()))
    return vectors[:, :k] * np.sqrt(values[:k])


def local_controls(pairs: DataFrame, genes: DataFrame, burdens: DataFrame, markers: DataFrame, context: tuple,
                   windows: tuple = WINDOWS, share: float = 0.85, top: int = 10) -> DataFrame:
    """One row per pair, window and control: the product term with the control as covariates, and how much of it is gone.

    ``pairs``: ``gene_x, gene_y`` and ``focal``, the copy whose burden every control holds too (or null). The vectors around
    both genes count together: the strongest burden, the components of all burdens with ``share`` of their variance, the
    ``top`` markers by |t|, and the markers' components. A control with nothing around has no test (null).
    """
    wh, y, _ = context
    n = len(y)
    shared = pairs.sparkSession.sparkContext.broadcast((wh, y))
    # a gene's sums go straight to its pairs, each once; the light columns of the pairs meet them there
    once = pairs.select("gene_x", "gene_y").distinct().select(F.explode(F.array("gene_x", "gene_y")).alias("gene"), "gene_x", "gene_y")
    focal = once.groupBy("gene").agg(F.collect_list(F.struct("gene_x", "gene_y")).alias("of")).select("gene", F.col("of.gene_x").alias("xs"), F.col("of.gene_y").alias("ys"))
    key = ["gene_x", "gene_y", "window_bp"]
    near = around(focal, genes, burdens, markers, context, windows, top).withColumn("of", F.explode(F.arrays_zip("xs", "ys")))
    near = near.select(F.col("of.xs").alias("gene_x"), F.col("of.ys").alias("gene_y"), "window_bp", "gene", "kind", "n", "gram", "t", "key", "vec").repartition(*key)
    near = near.groupBy(*key).agg(F.collect_list(F.struct("gene", "kind", "n", "gram", "t", "key", "vec")).alias("s"))  # four at most
    x = pairs.select("gene_x", "gene_y", "focal", F.explode(F.array(*map(F.lit, windows)).cast("array<bigint>")).alias("window_bp"))
    for side in "xy":
        x = x.join(burdens.select(F.col("gene").alias(f"gene_{side}"), F.col("vec").alias(f"b{side}")), f"gene_{side}")
    x = x.join(burdens.select(F.col("gene").alias("focal"), F.col("vec").alias("bf")), "focal", "left")
    x = x.join(near, key, "left")
    upper = np.triu_indices(n)

    def whole(gram) -> np.ndarray:
        out = np.zeros((n, n))
        out[upper] = gram
        return out + np.triu(out, 1).T

    def covariates(row) -> Iterator[tuple[str, np.ndarray | None, int]]:
        first = [np.ones((n, 1))] + ([] if row.bf is None else [np.asarray(row.bf)[:, None]])
        yield CONTROLS[0], np.hstack(first) if row.bf is not None else None, len(first) - 1
        for kind, strongest, components in ((1, CONTROLS[1], CONTROLS[2]), (2, CONTROLS[3], CONTROLS[4])):
            own = [s for s in (row.s if row.s is not None else []) if s["kind"] == kind]
            own.sort(key=lambda s: s["gene"] != row.gene_x)
            if not own:
                yield strongest, None, 0
                yield components, None, 0
                continue
            t, key = np.concatenate([s["t"] for s in own]), np.concatenate([np.asarray(s["key"], object) for s in own])
            vec = np.concatenate([np.stack(list(s["vec"])).astype(float) for s in own])
            best = np.lexsort((key.astype(str), -t))[:1 if kind == 1 else top]
            yield strongest, np.hstack([*first, vec[best].T]), len(best)
            c = _components(sum(whole(s["gram"]) for s in own), share, max(n - 8, 1))
            yield components, np.hstack([*first, c]), c.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wh, y = shared.value
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                bx, by = np.asarray(row.bx)[None], np.asarray(row.by)[None]
                beta0 = mm.interaction_tests(wh, y, bx, by)[0][0]
                for control, c, k in covariates(row):
                    beta, p = None, None
                    if c is not None and c.shape[1] + 4 < n:
                        b, _, q = mm.interaction_tests(wh, y, bx, by, c)
                        beta, p = float(b[0]), float(q[0])
                    out.append((row.gene_x, row.gene_y, row.window_bp, control, k, beta0, beta, p, None if beta is None else 1 - abs(beta) / max(abs(beta0), 1e-12)))
            yield pd.DataFrame(out, columns=["gene_x", "gene_y", "window_bp", "control", "n_terms", "beta0", "beta", "p", "attenuation"])
    return x.select("gene_x", "gene_y", "window_bp", "bx", "by", "bf", "s").mapInPandas(
        run, "gene_x string, gene_y string, window_bp bigint, control string, n_terms int, beta0 double, beta double, p double, attenuation double")
