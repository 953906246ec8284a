"""Hard negatives by slots: which rows of other labels score just below an anchor's positives.

A row's score is its inner product with the anchor. An anchor's positives are its ``POSITIVES`` best rows of its own
label. For each positive the ``NEGATIVES`` best rows of other labels are wanted whose score lies between ``LOWER``
and ``UPPER`` percent of the positive's. The positives' upper limits cut the scores into disjoint slots: the slot of
a score is the last positive, in falling order, whose limit it keeps. Tasks keep the best of every slot; what a
positive may take is the union of its slot and those below, so one merge from the lowest slot upwards answers all
positives, and their lower limits are applied last.

Rows and anchors are packed into blocks once. Groups of anchor blocks and shares of the row blocks make a grid of tasks: an
anchor block goes to each share, a row block to each group, both by one shuffle and never by a broadcast, whose size the planner
would guess from the blocks before they are repeated. A task gets its anchors first and then one row block after the other;
it multiplies blocks by label (positives only with their own) and keeps its best over all of its row blocks. Once an
anchor has its k-th best, one comparison leaves few scores to order; products that stay whole numbers below 2^24 are taken
in single precision, which is exact there.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component take no part; rows of
another vector length are not compared; rows with the anchor's own id are not its positives; of several rows with an
anchor's id the least (label, vector) is the anchor, and as candidates each counts; equal scores are ordered by id; scores are exact
below 2^53; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloscan.llm.common import written
from alloscan.session import shuffle_width

#: fixed values: how many are wanted, and the limits in percent
POSITIVES, NEGATIVES, LOWER, UPPER = 5, 3, 50, 95
ROW_BLOCK, ANCHOR_BLOCK = 8192, 2048
#: What a task keeps of anchors: so many blocks and so many numbers in their vectors.
ANCHOR_GROUP, GROUP_NUMBERS = 32, 1 << 22
#: Scores computed at once.
CELLS = 1 << 21
#: Columns that give a first limit, and the share of scores (one in so many) above which all are ordered by rows.
FIRST, DENSE = 1024, 8
NO_SCORE = -float("inf")
_BLOCK = "task int, number int, size int, ids binary, labels binary, type string, numbers binary, limits binary"


def _matrix(kind: str, numbers: bytes, size: int) -> tuple[np.ndarray, float]:
    """Vectors, in single precision if that is exact, and the length of the longest; infinite if not all are whole numbers."""
    vectors = np.frombuffer(numbers, kind).reshape(-1, size).astype(np.float64)
    reach = float("inf") if kind == "<f8" else float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0)))
    return vectors.astype(np.float32) if reach < 2 ** 24 else vectors, reach


def _pack(block: int):
    """Rows (id, label, v, upper limits or null) as blocks of one vector length; whole numbers take the smallest type that fits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            size = np.asarray(whole.column(4))
            for length in np.unique(size):
                mine = whole.filter(pa.array(size == length))
                for lo in range(0, mine.num_rows, block):
                    b = mine.slice(lo, block)
                    flat = np.asarray(b.column(2).flatten(), np.float64)
                    top = np.abs(flat).max(initial=0)
                    kind = "<f8" if top >= 2 ** 31 or (flat != np.floor(flat)).any() else "<i4" if top >= 2 ** 15 else "<i2"
                    limits = None if b.column(3).null_count else np.asarray(b.column(3).flatten(), np.float64).tobytes()
                    row = (task, number, int(length), np.asarray(b.column(0), np.int64).tobytes(), np.asarray(b.column(1), np.int64).tobytes(),
                           kind, flat.astype(kind).tobytes(), limits)
                    number += 1
                    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[x.split()[0] for x in _BLOCK.split(", ")])
    return run


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (id, label, v, and ``limits`` if there are) packed where they are read."""
    limits = F.col("limits") if "limits" in rows.columns else F.lit(None).cast("array<double>")
    return written(rows.select("id", "label", "v", limits.alias("limits"), F.size("v").alias("size")).mapInArrow(_pack(size), _BLOCK))


def first_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """The columns of the ``k`` highest scores of each row, equal ones by column; all columns if there are fewer."""
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    finite = scores[scores > NO_SCORE]
    if np.abs(finite).max(initial=0) * n < 2 ** 52:
        return np.argpartition(np.arange(n) - scores * n, k - 1, axis=1)[:, :k]
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


class _Best:
    """The best scores of an anchor block so far: for each anchor and slot ``k`` of them, with their ids."""

    def __init__(self, row: dict, slots: int, k: int):
        self.size, self.k, self.slots = row["size"], k, slots
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vectors, self.reach = _matrix(row["type"], row["numbers"], row["size"])
        n = len(self.ids)
        self.limits = np.frombuffer(row["limits"]).reshape(n, POSITIVES) if slots > 1 else None
        #: the last slot there is, and its upper limit
        self.last = np.zeros(n, np.int64) if slots == 1 else np.maximum((self.limits > NO_SCORE).sum(1) - 1, 0)
        self.under = np.full(n, np.inf) if slots == 1 else self.limits[np.arange(n), self.last]
        self.score, self.id = np.full((n, slots, k), NO_SCORE), np.zeros((n, slots, k), np.int64)

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, reach: float) -> None:
        """Rows in order of their ids."""
        kind = np.float32 if self.reach * reach < 2 ** 24 else np.float64
        for label in np.unique(self.labels):
            mine = np.flatnonzero(self.labels == label)
            theirs = np.flatnonzero((labels == label) == (self.limits is None))
            if not len(theirs):
                continue
            step, own, other = max(1, CELLS // len(theirs)), ids[theirs], vectors[theirs].astype(kind, copy=False).T
            for lo in range(0, len(mine), step):
                part = mine[lo:lo + step]
                scores = self.vectors[part].astype(kind, copy=False) @ other
                found = self.above(part, scores, own)
                if len(found) * DENSE <= scores.size:
                    a, c = np.divmod(found, len(theirs))
                    self.put(part[a], scores.ravel()[found].astype(np.float64), own[c])
                else:
                    self.meet_all(part, scores.astype(np.float64, copy=False), own)

    def above(self, part: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places of the scores that can still be among the best; the limit of the last slot is below those of all others."""
        low = self.score[part, self.last[part], -1]
        if (low == NO_SCORE).any() and len(ids) >= self.k:
            some = scores[:, :max(FIRST, self.k)].astype(np.float64)
            out = some > self.under[part, None] if self.limits is not None else self.ids[part][:, None] == ids[:some.shape[1]]
            some[out] = NO_SCORE
            low = np.maximum(low, np.partition(some, -self.k, axis=1)[:, -self.k])
        high = self.limits[part, 0] if self.limits is not None else np.full(len(part), np.inf)
        with np.errstate(over="ignore"):
            low, high = low.astype(scores.dtype), high.astype(scores.dtype)
        return np.flatnonzero((scores >= low[:, None]) & (scores <= high[:, None]))

    def put(self, a: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of single rows ``ids`` with the anchors ``a``."""
        kept, names = self.score.reshape(-1, self.k), self.id.reshape(-1, self.k)
        slot = np.zeros(len(a), np.int64) if self.limits is None else (self.limits[a] >= score[:, None]).sum(1) - 1
        place = a * self.slots + slot
        good = (slot >= 0) & (score > NO_SCORE) & ((score > kept[place, -1]) | ((score == kept[place, -1]) & (ids < names[place, -1])))
        if self.limits is None:
            good &= ids != self.ids[a]
        full = np.unique(place[good])
        place, score, ids = (np.concatenate(x) for x in ((np.repeat(full, self.k), place[good]), (kept[full].ravel(), score[good]), (names[full].ravel(), ids[good])))
        by = np.lexsort((ids, -score, place))
        place = place[by]
        start = np.flatnonzero(np.diff(place, prepend=-1))
        rank = np.arange(len(place)) - np.repeat(start, np.diff(start, append=len(place)))
        best = rank < self.k
        kept[place[best], rank[best]], names[place[best], rank[best]] = score[by][best], ids[by][best]

    def meet_all(self, part: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.limits is None:
            scores[self.ids[part][:, None] == ids] = NO_SCORE
            self.take(part, 0, scores, ids)
            return
        slot = np.full(scores.shape, -1, np.int8)
        for j in range(self.slots):
            slot += scores <= self.limits[part, j, None]
        for j in range(self.slots):
            # what a block cannot better is left out before any order is made
            better = (slot == j) & (scores >= self.score[part, j, -1, None])
            some = np.flatnonzero(better.any(1))
            if len(some):
                self.take(part[some], j, np.where(better[some], scores[some], NO_SCORE), ids)

    def take(self, part: np.ndarray, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        best = first_columns(scores, self.k)
        score = np.concatenate((self.score[part, slot], np.take_along_axis(scores, best, 1)), axis=1)
        own = np.concatenate((self.id[part, slot], ids[best]), axis=1)
        by = np.lexsort((own, -score), axis=1)[:, :self.k]
        self.score[part, slot], self.id[part, slot] = np.take_along_axis(score, by, 1), np.take_along_axis(own, by, 1)

    def rows(self) -> pa.RecordBatch:
        a, s, k = np.nonzero(self.score > NO_SCORE)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[a]), pa.array(s.astype(np.int32)), pa.array(self.score[a, s, k].astype(np.int64)), pa.array(self.id[a, s, k])],
            names=["anchor", "slot", "score", "id"])


def _combine(slots: int, k: int):
    """Of each cell the anchor blocks come first, then the row blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, group = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                if row["cell"] != cell:
                    yield from (best.rows() for best in group)
                    cell, group = row["cell"], []
                if row["is_anchor"]:
                    group.append(_Best(row, slots, k))
                elif group:
                    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                    by = np.argsort(ids, kind="stable")
                    vectors, reach = _matrix(row["type"], row["numbers"], row["size"])
                    ids, labels, vectors = ids[by], labels[by], vectors[by]
                    for best in group:
                        if best.size == row["size"]:
                            best.meet(ids, labels, vectors, reach)
        yield from (best.rows() for best in group)
    return run


def grid(rows: int, anchors: int, numbers: int, tasks: int) -> tuple[int, int]:
    """Groups of anchors and shares of rows, about ``tasks`` in all; ``numbers`` counts the anchors' components.

    A row goes to each group; an anchor goes to each share and comes back with its best, about four times as long as a
    row. Groups are as many as make the two alike, but enough for a task to keep one.
    """
    even = min(tasks, round(math.sqrt(4 * tasks * anchors / max(1, rows))))
    groups = max(1, even, -(-anchors // (ANCHOR_GROUP * ANCHOR_BLOCK)), -(-numbers // GROUP_NUMBERS))
    return groups, -(-tasks // groups)


def best_of_slots(rows: DataFrame, anchors: DataFrame, groups: int, shares: int, slots: int, k: int) -> DataFrame:
    """``anchor, slot, best``: for each anchor and slot the ``k`` best of the row blocks, as (less, id) in order."""
    # multiples of two irrational numbers spread the tasks' blocks evenly
    spread = F.pmod(F.col("task") * F.lit(0.7548776662466927) + F.col("number") * F.lit(0.5698402909980532), F.lit(1.0))
    left = rows.select("*", F.least(F.floor(spread * shares), F.lit(shares - 1)).cast("int").alias("share"),
                       F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("team"), F.lit(False).alias("is_anchor"))
    right = anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"),
                           F.pmod("task", F.lit(groups)).alias("team"), F.lit(True).alias("is_anchor"))
    met = (left.unionByName(right).withColumn("cell", F.col("team") * shares + F.col("share")).drop("team", "share", "task", "number")
           .repartitionById(groups * shares, F.col("cell")).sortWithinPartitions("cell", F.desc("is_anchor")))
    found = met.mapInArrow(_combine(slots, k), "anchor long, slot int, score long, id long")
    return (found.groupBy("anchor", "slot")
            .agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))), 1, k).alias("best")))


def mine(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` over ``rows`` (id, label, v)."""
    rows = written(rows.where("id is not null and label is not null and v is not null")
                   .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
                   .select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v")))
    anchors = (rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"))
    anchors = written(anchors)
    n, numbers = anchors.agg(F.count("id"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    groups, shares = grid(rows.count(), n, numbers, shuffle_width(rows.sparkSession))
    packed = blocks(rows, ROW_BLOCK)
    positives = written(best_of_slots(packed, blocks(anchors.repartition(groups), ANCHOR_BLOCK), groups, shares, 1, POSITIVES)
                        .select(F.col("anchor").alias("id"), "best")).hint("merge")
    # upper limits in falling order, as whole numbers; a missing positive has one below all scores
    limits = F.transform(F.sequence(F.lit(1), F.lit(POSITIVES)), lambda j: F.coalesce(
        F.floor(F.try_element_at("best", j)["less"] * -UPPER / 100).cast("double"), F.lit(NO_SCORE)))
    limited = anchors.join(positives, "id").withColumn("limits", limits).repartition(groups)
    slots = best_of_slots(packed, blocks(limited, ANCHOR_BLOCK), groups, shares, POSITIVES, NEGATIVES)
    by_anchor = (slots.groupBy("anchor").agg(F.collect_list(F.struct("slot", "best")).alias("slots"))
                 .join(positives.withColumnRenamed("id", "anchor"), "anchor"))
    # from the lowest slot upwards: the best so far and what each positive takes of it
    merged = F.expr(f"""aggregate(sequence({POSITIVES} - 1, 0, -1),
        named_struct('best', cast(array() as array<struct<less:bigint,id:bigint>>), 'taken', cast(array() as array<struct<place:int,best:array<struct<less:bigint,id:bigint>>>>)),
        (a, j) -> transform(array(slice(array_sort(concat(a.best, flatten(transform(filter(slots, s -> s.slot = j), s -> s.best)))), 1, {NEGATIVES})),
                            b -> named_struct('best', b, 'taken', concat(a.taken, array(named_struct('place', j, 'best', b)))))[0],
        a -> a.taken)""")
    taken = (by_anchor.select("anchor", "best", F.explode(merged).alias("t")).where(F.col("t.place") < F.size("best"))
             .select("anchor", F.element_at("best", F.col("t.place") + 1).alias("p"), "t.best")
             .select("anchor", "p", F.posexplode(F.expr(f"filter(best, x -> {LOWER} * p.less >= 100 * x.less)")).alias("k", "x")))
    return taken.select(F.col("anchor").alias("anchor_id"), F.col("p.id").alias("positive_id"), (F.col("k") + 1).alias("rank"), F.col("x.id").alias("negative_id"),
                        (-F.col("p.less")).alias("positive_score"), (-F.col("x.less")).alias("negative_score"))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Negatives of every 50th vector, over whole numbers of 1/256; each 7th vector's label is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").alias("id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")).alias("v"),
                             F.col("embedding").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return mine(rows.where(finite).drop("e"), F.col("id") % 50 == 0)


ORACLE_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
      FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s USING (anchor_id)
      WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
