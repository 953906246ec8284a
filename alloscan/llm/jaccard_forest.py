"""N-gram Jaccard self-join of texts: MinHash LSH forest, then exact verification.

A text is the set of its runs of five words (all its words, if it has fewer). Texts with the same set are
one *set* from then on, with a number of copies. A set's signature is read as several trees' labels; in
each tree, sets that share a prefix of their label meet. The prefix is as long as the target recall at the threshold
allows, the same for all sets: a prefix that followed the similarities found so far would lose links at
the threshold where most copies are closer than that. Sets that meet and whose
signatures agree closely enough are joined into clusters; inside a cluster every pair of sets is compared
exactly. Links of at least the threshold make the classes, and a document's number of links counts the
other documents linked to it, copies included.

No pair is ever a row. Where sets meet, one row per set goes out, with the first set of its part; a group
that is larger than a block is dealt out as pairs of blocks, so that no task holds more than two.

Defined cases: a text without words (null, empty or blank) is a class of its own without links; ``class_id``
is the least id of the class (null if no member has one); repeated rows are copies of one another; an empty
table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from alloscan.llm.common import blank, code_points, mix64, run_hashes, runs, written

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET_RECALL = 16, 8, 0.999
#: Share of equal signature places from which two sets that meet are compared exactly: at a similarity of 0.8
#: the share is below it with a probability of 1e-6.
CLOSE = 0.62
#: Sets of a block; a group of more is dealt out as pairs of blocks.
BUCKET_BLOCK, CLUSTER_BLOCK = 512, 1024
BLOCK_CHARS = 1_000_000
#: Bits of the set that picks the texts to be read again. A fixed size; a fuller one only picks more.
PICK_BITS = 23
MULTIPLIERS = mix64(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def prefix_depth(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target probability."""
    for depth in range(DEPTH, 0, -1):
        if 1 - (1 - threshold ** depth) ** TREES >= target:
            return depth
    return 1


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BLOCK_CHARS):
            size += len(texts[hi]) + 1
            hi += 1
        cp = code_points("\n".join(texts[lo:hi]) + "\n")
        inside = ~blank(cp)
        start, end = runs(inside)
        words = run_hashes(cp, inside, start, end)
        edges = np.searchsorted(start, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[lo:hi]]))))
        joined = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            joined = (joined * np.uint64(0x100000001B3)) ^ words[k:k + len(joined)]
            joined = mix64(joined)
        for i in range(hi - lo):
            a, b = edges[i], edges[i + 1]
            if b - a >= WORDS:
                out[lo + i] = np.unique(joined[a:b - WORDS + 1])
            elif b > a:
                h = np.uint64(b - a)
                for w in words[a:b]:
                    h = mix64(h ^ w)
                out[lo + i] = np.array([h], np.uint64)
        lo = hi
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """TREES x DEPTH minima of the set under multiply-add hashes, as 16 bits each."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    a, b = MULTIPLIERS[::2, None] | np.uint32(1), MULTIPLIERS[1::2, None]
    for lo in range(0, len(low), 16384):
        best = np.minimum(best, (low[lo:lo + 16384] * a + b).min(axis=1))
    return (mix64(best.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def key_of(s: np.ndarray) -> str | None:
    """128-bit name of a set; none for the empty one."""
    if not len(s):
        return None
    one, two = mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return f"{int(mix64(one)):016x}{int(mix64(two)):016x}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 1000):
            batch = whole.slice(lo, 1000)
            sets = shingle_sets([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([key_of(s) for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())], names=["doc_id", "key", "size", "signature"])


def complete_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups with the groups' first rows and the end; rows of a group follow one another."""
    held: list[pa.RecordBatch] = []

    def starts(b: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(b.num_rows, bool)
        change[:1] = True
        for c in columns:
            v = b.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        whole = pa.concat_batches(held)
        first = starts(whole)
        if len(first) > 1:
            yield whole.slice(0, first[-1]), first
            held = [whole.slice(first[-1])]
        else:
            held = [whole]
    if held:
        whole = pa.concat_batches(held)
        yield whole, np.append(starts(whole), whole.num_rows)


def parts_of(near: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """First member of each row's connected part. ``near(some, rest)`` tells which of ``rest`` has a neighbour in ``some``
    and is asked only about rows that have no part yet."""
    first, rest = np.arange(n), np.arange(n)
    while len(rest):
        root, rest = rest[0], rest[1:]
        front = np.array([root])
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            for lo in range(0, len(front), 64):
                ask = ~hit
                hit[ask] = near(front[lo:lo + 64], rest[ask])
                if hit.all():
                    break
            front, rest = rest[hit], rest[~hit]
            first[front] = root
    return first


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``a, b`` from sets that meet to the first of their close part."""
    for batch, first in complete_groups(batches, ["tree", "prefix", "pair"]):
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, TREES * DEPTH)
        a, b = [], []
        for lo, hi in zip(first[:-1], first[1:]):
            s = sig[lo:hi]
            if hi - lo == 1:
                continue

            def near(some: np.ndarray, rest: np.ndarray, s: np.ndarray = s) -> np.ndarray:
                hit = np.zeros(len(rest), bool)
                for i in some:
                    hit |= (s[rest] == s[i]).mean(axis=1) >= CLOSE
                return hit

            root = parts_of(near, hi - lo)
            for i in np.flatnonzero(root != np.arange(hi - lo)):
                a.append(keys[lo + i])
                b.append(keys[lo + root[i]])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact comparison of two blocks of a cluster, or of one with itself: ``key, first, links`` per set with a link."""
    for batch, starts in complete_groups(batches, ["cluster", "pair"]):
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        copies, block = batch.column("copies").to_numpy(), batch.column("block").to_numpy()
        pair = batch.column("pair").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
        out: tuple[list, list, list] = ([], [], [])
        for lo, hi in zip(starts[:-1], starts[1:]):
            one, two = map(int, pair[lo].split("-"))
            left = lo + np.flatnonzero(block[lo:hi] == one)
            right = lo + np.flatnonzero(block[lo:hi] == two)
            linked = _linked([sets[i] for i in left], [sets[i] for i in right])
            if one == two:
                np.fill_diagonal(linked, False)
            every = left if one == two else np.concatenate((left, right))
            n, m = len(left), 0 if one == two else len(right)
            around = np.zeros((n + m, n + m), bool)
            if one == two:
                around[:] = linked
            else:
                around[:n, n:], around[n:, :n] = linked, linked.T
            root = parts_of(lambda some, rest, g=around: g[np.ix_(some, rest)].any(axis=0), n + m)
            links = around @ copies[every].astype(np.int64)
            for i in np.flatnonzero(links):
                out[0].append(keys[every[i]])
                out[1].append(keys[every[root[i]]])
                out[2].append(int(links[i]))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())],
                                         names=["key", "first", "links"])


def _linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs have a Jaccard similarity of at least THRESHOLD; shingles of one set only count in the sizes."""
    n, m = len(left), len(right)
    if not n or not m:
        return np.zeros((n, m), bool)
    l_size, r_size = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    shared = np.zeros((n, m), np.float32)

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        ok = common[at] == flat
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[ok], at[ok]

    if len(common):
        (lr, lc), (rr, rc) = cells(left), cells(right)
        for lo in range(0, len(common), 4096):
            width = min(4096, len(common) - lo)
            a, b = np.zeros((n, width), np.float32), np.zeros((m, width), np.float32)
            pick = (lc >= lo) & (lc < lo + width)
            a[lr[pick], lc[pick] - lo] = 1
            pick = (rc >= lo) & (rc < lo + width)
            b[rr[pick], rc[pick] - lo] = 1
            shared += a @ b.T
    return shared >= THRESHOLD * (l_size[:, None] + r_size - shared) - 1e-4


def components(edges: DataFrame) -> DataFrame:
    """``key, root`` for every end of the edges ``a, b``: the least key of its component.

    Rounds of large and small stars: each end is tied to the least key around it, until nothing changes.
    Every round is a written table; hot centres are aggregated before they are joined.
    """
    def star(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        return e.join(least, "u")

    oriented = lambda e: (e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    now, before = written(oriented(edges)), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("key"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("key"), F.col("b").alias("root"))).distinct()
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        small = star(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        tied = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = written(oriented(tied))


def _dealt(rows: DataFrame, group: list[str], counts: DataFrame, size: int) -> DataFrame:
    """``rows`` in pairs of blocks of their group: columns ``block`` and ``pair``. ``counts`` has ``group`` and ``n``, above 1.

    The rows are joined to the counts of those groups; a hot group is split by Spark, as only rows with a
    block of their own meet one row of counts.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("int")
    dealt = (rows.join(counts, group).withColumn("_nb", blocks).withColumn("block", F.pmod(F.hash("key"), F.col("_nb")).cast("int"))
             .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))))
    return dealt.withColumn("pair", F.concat_ws("-", F.least("block", "_o").cast("string"), F.greatest("block", "_o").cast("string"))).drop("_nb", "_o", "n")


def _shingles_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``key, shingles`` of the sets in ``members``, from a second reading of the texts.

    A bit set over the names, of a fixed size, tells most other texts apart before anything leaves the task;
    a task sends a set once, however many copies it meets.
    """
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % (1 << PICK_BITS)
    words = members.select(at.alias("a")).select(F.expr("cast(shiftright(a, 6) as int)").alias("w"),
                                                 F.expr("shiftleft(1L, cast(a & 63 as int))").alias("b"))
    bits = np.zeros(1 << (PICK_BITS - 6), np.uint64)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        bits[r.w] = np.int64(r.b).view(np.uint64)
    picked = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sent = picked.value, set()
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                keys, sets = [], []
                for s in shingle_sets([t or "" for t in whole.column(0).slice(lo, 1000).to_pylist()]):
                    key = key_of(s)
                    if key is None or key in sent:
                        continue
                    a = int(key[:8], 16) % (1 << PICK_BITS)
                    if int(bits[a >> 6]) >> (a & 63) & 1:
                        sent.add(key)
                        keys.append(key)
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sets, pa.binary())], names=["key", "shingles"])

    return docs.select("text").mapInArrow(run, "key string, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key`` per document and ``key, root, class_id, least_id, n_links`` per set (none for texts without words).

    ``root`` names the class, which ``class_id`` does not; it is null for a set without links to others.
    """
    rows = written(docs.select("doc_id", "text").mapInArrow(
        _read, docs.select("doc_id").schema.add("key", "string").add("size", "long").add("signature", "binary")))
    sets = written(rows.where("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature")))
    depth = prefix_depth()
    label = F.expr(f"substring(signature, tree * {2 * DEPTH} + 1, {2 * DEPTH})")
    # where sets meet: a first look with names only
    places = (sets.select("key", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
              .select("tree", F.expr(f"substring(signature, tree * {2 * DEPTH} + 1, {2 * depth})").alias("prefix"), "key"))
    crowds = places.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    meeting = (_dealt(places, ["tree", "prefix"], crowds, BUCKET_BLOCK).join(sets.select("key", "signature"), "key")
               .withColumn("label", label).repartition("tree", "prefix", "pair").sortWithinPartitions("tree", "prefix", "pair", "label"))
    close = meeting.select("tree", "prefix", "pair", "key", "signature").mapInArrow(_meet, "a string, b string")
    clusters = written(components(close).withColumnRenamed("root", "cluster"))
    members = clusters.join(sets.select("key", "copies"), "key").join(_shingles_of(docs, clusters), "key")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    compared = (_dealt(members, ["cluster"], sizes, CLUSTER_BLOCK).repartition("cluster", "pair").sortWithinPartitions("cluster", "pair")
                .select("cluster", "pair", "block", "key", "copies", "shingles"))
    links = written(compared.mapInArrow(_verify, "key string, first string, links long"))
    roots = components(links.select(F.col("key").alias("a"), F.col("first").alias("b"))).join(sets.select("key", "least_id"), "key")
    heads = roots.groupBy("root").agg(F.min("least_id").alias("class_id"))
    linked = roots.join(heads, "root").select("key", "root", "class_id").join(links.groupBy("key").agg(F.sum("links").alias("links")), "key")
    every = sets.select("key", "least_id", "copies").join(linked, "key", "left")
    return rows.select("doc_id", "key"), written(every.select(
        "key", "root", F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("class_id")).alias("class_id"), "least_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links``, one row per document."""
    rows, sets = classes(docs)
    return rows.join(sets, "key", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each class of ``docs`` one document, with the least id (or a null one, if it has no other), and all rows of texts without words.

    Rows meet the classes by the name of their set, computed again on the way.
    """
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                keys = [key_of(s) for s in shingle_sets([t or "" for t in batch.column(text).to_pylist()])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], names=[*aside, "key"])

    text, aside = docs.columns.index("text"), [f"_c{i}" for i in range(len(docs.columns))]
    own = aside[docs.columns.index("doc_id")]
    _, sets = classes(docs)
    # the head of a class is one set; of its documents the one with the least id
    heads = sets.groupBy(F.coalesce("root", "key").alias("class")).agg(
        F.min(F.struct((~F.col("least_id").eqNullSafe(F.col("class_id"))).alias("o"), "key", "class_id")).alias("h"))
    heads = heads.select("h.key", F.col("h.class_id").alias("_first"))
    named = docs.toDF(*aside)
    named = named.mapInArrow(name, StructType([*named.schema.fields, StructField("key", StringType())]))
    kept = named.join(heads, "key").where(F.col(own).eqNullSafe(F.col("_first"))).drop("_first").dropDuplicates(["key"])
    blank_ones = named.where("key is null").select(*aside)
    return kept.select(*aside).unionByName(blank_ones).toDF(*docs.columns)
