"""Language model by deleted interpolation of word n-grams.

A token's probability mixes three estimates: its frequency after its context, its own frequency, and one
share for every token there is. A context is the word before, by its 64-bit hash (the start of a text is a
word of its own). The weights depend on the bucket of the context's frequency, by
powers of two, and are learned by expectation-maximisation on held-out counts: every training token is
predicted from counts from which it has been deleted.

Counts are exact over all training tokens. Text is read in blocks; a block sends, for each word hash that
falls to a bucket, its contexts, texts and counts, packed as arrays. A bucket sees all counts of its words,
scores them, one range of the words' hashes after the other, and sends every block its part of the texts' sums. The counts of its contexts come to it from the
tasks that hold them: a block asks for them, by context, and each task answers the buckets it was asked for. Words with more than ``HOT_SHARE`` of all tokens
are spread over the buckets by context, and word pairs above that share are scored where they are read; both
are at most 1 / HOT_SHARE many, so their counts, also as contexts, are sent to all tasks.

Defined cases: a null or empty text has its end as the only token; with no training text N and V are 0, every
count is 0 and every score that of the uniform share; a null id is neither held out nor learned from; repeated
rows are counted and scored as often as they occur; an empty table gives an empty result. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from alloscan.llm.common import blank, code_points, lower_ascii, mix64, remainder, run_hashes, runs, written
from alloscan.session import shuffle_width

#: Upper bits of a word's hash by which context counts are also kept in a table of a fixed size. It only tells
#: contexts that were never seen, which then need not be asked for.
CLASS_BITS = 16
CLASSES = 1 << CLASS_BITS
END, START = np.uint64(0x5D5F454E445F5F01), np.uint64(0x7A5F53544152545F)
HOT_SHARE = 1e-4
#: Tokens and texts of a block, and characters read at once.
BLOCK_TOKENS, BLOCK_TEXTS, READ_CHARS = 1_200_000, 50_000, 1_000_000
#: Entries of a bucket that are weighed at once: a bucket is worked off by ranges of its words' hashes.
RANGE_ENTRIES = 1_500_000
#: Word buckets for each shuffle partition. More take less memory of a task, but send more parts of the texts' sums.
BUCKETS_PER_PARTITION = 1
#: Held-out counts are gathered in cells of a quarter power of two.
CELL = 4
ROUNDS = 60


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end last, and the number of tokens of each text."""
    cp = lower_ascii(code_points("\n".join(texts) + "\n"))
    inside = ~blank(cp)
    start, end = runs(inside)
    words = run_hashes(cp, inside, start, end)
    edge = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    return np.insert(words, edge, END), np.diff(edge, prepend=0) + 1


def contexts(tok: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the distinct tokens, in order, and of the start; each token's number among them, and that of the word before."""
    words, number = np.unique(tok, return_inverse=True)
    before = np.empty(len(tok), np.int64)
    before[1:] = number[:-1]
    before[np.cumsum(sizes) - sizes] = len(words)
    return np.append(words, START), number.astype(np.int64), before


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed one by one: the planes that are nearly constant cost little."""
    codec, out = pa.Codec("zstd", compression_level=1), []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = codec.compress(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes(), asbytes=True)
        out += [np.array([a.dtype.itemsize, len(a), len(planes)], np.uint64).tobytes(), planes]
    return b"".join(out)


def narrow(a: np.ndarray) -> np.ndarray:
    """Unsigned, in as few bytes as the largest needs."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def steps(a: np.ndarray) -> np.ndarray:
    """Differences in the array's own unsigned width, which wrap where it falls; small where it mostly rises."""
    return np.diff(a, prepend=a.dtype.type(0))


def unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    """The packed arrays, by kind: ``d`` floating, ``s`` unsigned given as steps, else unsigned of the packed width."""
    codec, out, at = pa.Codec("zstd"), [], 0
    for kind in kinds:
        width, n, size = (int(x) for x in np.frombuffer(blob, np.uint64, 3, at))
        at += 24
        planes = np.frombuffer(codec.decompress(blob[at:at + size], width * n, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
        at += size
        a = np.ascontiguousarray(planes.reshape(width, n).T).view(np.float64 if kind == "d" else f"u{width}").ravel()
        out.append(np.cumsum(a, dtype=a.dtype) if kind == "s" else a)
    return out


def _groups(batches: Iterable[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[tuple[int | None, list[tuple] | pa.RecordBatch]]:
    """Rows of each value of ``key``, which follow one another; rows of a negative value come first, as batches, under None."""
    held: list[tuple] = []
    now = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        ahead = int((keys < 0).sum())
        if ahead:
            yield None, batch.slice(0, ahead)
        values = [batch.column(c) for c in columns]
        for i in range(ahead, len(keys)):
            if held and keys[i] != now:
                yield now, held
                held = []
            now = int(keys[i])
            held.append(tuple(v[i].as_py() for v in values))
    if held:
        yield now, held


def _ranges(parts: list) -> Iterator[tuple[np.ndarray, np.ndarray, list[slice]]]:
    """A bucket's parts (words in order first, entries of each second) by ranges of the words' hashes, about
    ``RANGE_ENTRIES`` at once: the range's distinct words, each entry's number among them, each part's entries."""
    edges = [np.concatenate(([0], np.cumsum(p[1], dtype=np.int64))) for p in parts]
    count = max(1, -(-int(sum(e[-1] for e in edges)) // RANGE_ENTRIES))
    cuts = np.arange(1, count, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // count)
    at = [np.concatenate(([0], np.searchsorted(p[0], cuts), [len(p[0])])) for p in parts]
    for k in range(count):
        mine = [slice(a[k], a[k + 1]) for a in at]
        # each part's words are sorted and distinct, so the range's are found without its entries
        words = np.unique(np.concatenate([p[0][i] for p, i in zip(parts, mine)]))
        if len(words):
            number = np.concatenate([np.repeat(np.searchsorted(words, p[0][i]).astype(np.int32), p[1][i]) for p, i in zip(parts, mine)])
            yield words, number, [slice(e[i.start], e[i.stop]) for e, i in zip(edges, mine)]


def _pieces(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches without their texts, and with their tokens."""
    for batch in batches:
        lo, texts = 0, batch.column(text)
        values = [t or "" for t in texts.to_pylist()]
        batch = batch.drop_columns([text])
        while lo < len(values):
            hi, size = lo, 0
            while hi < len(values) and (hi == lo or size + len(values[hi]) <= READ_CHARS):
                size += len(values[hi]) + 1
                hi += 1
            yield batch.slice(lo, hi - lo), *tokens(values[lo:hi])
            lo = hi


def token_blocks(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    held, toks, sizes, n, texts = [], [], [], 0, 0
    for piece, tok, size in _pieces(batches, text):
        held.append(piece)
        toks.append(tok)
        sizes.append(size)
        n, texts = n + len(tok), texts + len(size)
        if n >= BLOCK_TOKENS or texts >= BLOCK_TEXTS:
            yield held, np.concatenate(toks), np.concatenate(sizes)
            held, toks, sizes, n, texts = [], [], [], 0, 0
    if held:
        yield held, np.concatenate(toks), np.concatenate(sizes)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def word_counts(training: DataFrame) -> DataFrame:
    """``h, n``: every distinct token's hash and count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tok, _ in token_blocks(batches):
            h, n = np.unique(tok, return_counts=True)
            for lo in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([_signed(h[lo:lo + 100_000]), pa.array(n[lo:lo + 100_000], pa.int64())], names=["h", "n"])

    return training.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Model:
    """What every task needs: N, V, the classes' counts, hot words and pairs with their counts, and the weights.

    ``asked`` stays with the driver: the table of ``context_counts``.
    """

    def __init__(self, total: int, distinct: int, classes: np.ndarray, hot: np.ndarray, hot_n: np.ndarray, texts: int):
        self.total, self.distinct, self.classes = total, distinct, classes
        order = np.argsort(hot)
        self.hot, self.hot_n = hot[order], hot_n[order]
        before, before_n = np.append(hot, START), np.append(hot_n, texts)
        order = np.argsort(before)
        self.before, self.before_n = before[order], before_n[order]
        self.asked: DataFrame | None = None
        self.pairs, self.pair_n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.weights = np.tile(np.array([0.0, 0.0, 1.0]), (64, 1))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"asked": None}

    def find_hot(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _find(words, self.hot, self.hot_n)

    def bucket(self, words: np.ndarray, ctx: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
        """By word; of a hot word by word and context."""
        return _dealt(np.where(hot, mix64(words ^ mix64(ctx)), words), buckets)

    def find_contexts(self, ctx: np.ndarray, blobs: list[bytes]) -> np.ndarray:
        """Counts of the contexts: known to all tasks, or in what the bucket was sent."""
        known, n = _find(ctx, self.before, self.before_n)
        if blobs:
            parts = [unpack(x, "su") for x in blobs]
            names, counts = (np.concatenate([p[k] for p in parts]) for k in range(2))
            order = np.argsort(names)
            n = np.where(known, n, _find(ctx, names[order], counts[order].astype(np.int64))[1])
        return n

    def levels(self, c: np.ndarray) -> np.ndarray:
        """Bucket of the contexts' frequencies: 0 if none, else 1 + the power of two."""
        return np.where(c > 0, 1 + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64), 0)

    def log10(self, ctx_n: np.ndarray, word_n: np.ndarray, pair_n: np.ndarray) -> np.ndarray:
        out = np.empty(len(ctx_n))
        for lo in range(0, len(ctx_n), 1 << 18):
            c, i = ctx_n[lo:lo + (1 << 18)], slice(lo, lo + (1 << 18))
            w = self.weights[self.levels(c)]
            out[i] = np.log10(w[:, 0] * pair_n[i] / np.maximum(c, 1) + w[:, 1] * word_n[i] / max(self.total, 1)
                              + w[:, 2] / (self.distinct + 1))
        return out


def _dealt(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def _find(x: np.ndarray, known: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    ok = known[at] == x
    return ok, np.where(ok, n[at], 0)


def pair_name(words: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return mix64(words + mix64(ctx + np.uint64(1)))


def count_model(training: DataFrame) -> Model:
    """N, V, class counts and hot words of the training texts; the driver gets CLASSES and 1 / HOT_SHARE rows at most."""
    counts = written(word_counts(training))
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("n")).first())
    classes = np.zeros(CLASSES, np.int64)
    signed = int(END.view(np.int64))
    for r in (counts.where(F.col("h") != signed).select(F.expr(f"cast(shiftrightunsigned(h, {64 - CLASS_BITS}) as int)").alias("c"), "n")
              .groupBy("c").agg(F.sum("n").alias("n")).collect()):
        classes[r.c] = r.n
    hot = counts.where(F.col("n") >= max(1, int(HOT_SHARE * total))).collect()
    texts = [r.n for r in hot if r.h == signed] or [r.n for r in counts.where(F.col("h") == signed).collect()]
    n_texts = texts[0] if texts else 0
    classes[int(START >> np.uint64(64 - CLASS_BITS))] += n_texts
    return Model(total, distinct, classes, np.array([r.h for r in hot], np.int64).view(np.uint64), np.array([r.n for r in hot], np.int64), n_texts)


def _rows(buckets: np.ndarray, sort: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    edge = np.searchsorted(buckets[sort], np.arange(count + 1))
    for b in range(count):
        if edge[b] < edge[b + 1]:
            yield b, sort[edge[b]:edge[b + 1]]


def context_counts(docs: DataFrame, model: Model, buckets: int) -> DataFrame:
    """``bucket, blob``: for every bucket of ``docs`` (``train, text``) its contexts and their counts in the training texts.

    Left out are those that all tasks know. A context's count is summed where its name is dealt to, and goes from
    there to the buckets that have a pair with it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def row(b: int, *arrays: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([pack(*arrays)], pa.binary())], names=["bucket", "blob"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for held, tok, sizes in token_blocks(batches):
            train = np.concatenate([x.column("train").to_numpy(zero_copy_only=False) for x in held]).astype(bool)
            names, number, before = contexts(tok, sizes)
            n = np.bincount(before, np.repeat(train, sizes), len(names)).astype(np.uint64)
            seen = model.classes[(names >> np.uint64(64 - CLASS_BITS)).astype(np.int64)] > 0
            sought = (seen & ~_find(names, model.before, model.before_n)[0])[before]
            w, v = np.divmod(np.unique(number[sought] * len(names) + before[sought]), len(names))
            to = model.bucket(names[w], names[v], model.find_hot(names)[0][w], buckets)
            v, to = np.divmod(np.unique(v * buckets + to), buckets)
            at = _dealt(names[v], buckets)
            for b, i in _rows(at, np.argsort(at, kind="stable"), buckets):
                own, count = np.unique(v[i], return_counts=True)
                yield row(b, steps(names[own]), narrow(n[own]), narrow(count), narrow(to[i]))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "bucket", ["blob"]):
            parts = [unpack(x, "suuu") for x, in rows]
            names, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(names)).astype(np.uint64)
            asked = np.repeat(at.astype(np.int64), np.concatenate([p[2] for p in parts])) * buckets + np.concatenate([p[3] for p in parts])
            v, to = np.divmod(np.unique(asked), buckets)
            v, to = v[n[v] > 0], to[n[v] > 0]
            for b, i in _rows(to, np.argsort(to, kind="stable"), buckets):
                yield row(b, steps(names[v[i]]), narrow(n[v[i]]))

    asked = docs.select("train", "text").mapInArrow(ask, "bucket int, blob binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return asked.mapInArrow(answer, "bucket int, blob binary")


def _places(parts: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct contexts of a bucket's parts (names third), and the place among them of each part's."""
    names = np.unique(np.concatenate([p[2] for p in parts]))
    return names, [np.searchsorted(names, p[2]).astype(np.int32) for p in parts]


def held_out_cells(training: DataFrame, model: Model, buckets: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Cells (level, cell of the deleted pair frequency, cell of the deleted word frequency, tokens), and the hot pairs."""
    shared = training.sparkSession.sparkContext.broadcast(model)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for _, tok, sizes in token_blocks(batches):
            names, number, before = contexts(tok, sizes)
            pair, n = np.unique(number * len(names) + before, return_counts=True)
            w, ctx = np.divmod(pair, len(names))
            to = model.bucket(names[w], names[ctx], model.find_hot(names)[0][w], buckets)
            for b, i in _rows(to, np.argsort(to, kind="stable"), buckets):
                own, count = np.unique(w[i], return_counts=True)
                around, at = np.unique(ctx[i], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([False]),
                     pa.array([pack(steps(names[own]), narrow(count), steps(names[around]), steps(narrow(at)), narrow(n[i]))], pa.binary())],
                    names=["bucket", "asked", "blob"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for _, rows in _groups(batches, "bucket", ["blob", "asked"]):
            asked = [x for x, a in rows if a]
            parts = [unpack(x, "sussu") for x, a in rows if not a]
            del rows
            if not parts:
                continue
            names, place = _places(parts)
            context_n = model.find_contexts(names, asked)
            for words, number, mine in _ranges(parts):
                before = np.concatenate([q[p[3][i]] for p, q, i in zip(parts, place, mine)])
                pair, at = np.unique(number.astype(np.int64) * len(names) + before, return_inverse=True)
                n = np.bincount(at, np.concatenate([p[4][i] for p, i in zip(parts, mine)])).astype(np.int64)
                w, ctx = np.divmod(pair, len(names))
                ctx_n = context_n[ctx]
                word_n = np.bincount(w, n, len(words)).astype(np.int64)
                is_hot, hot_n = model.find_hot(words)
                c = np.where(is_hot, hot_n, word_n)[w]
                f2 = (n - 1) / np.maximum(ctx_n - 1, 1)
                f1 = (c - 1) / max(model.total - 1, 1)
                cell = lambda f: np.where(f > 0, np.round(-CELL * np.log2(np.maximum(f, 1e-300))), -1).astype(np.int64)
                cells, where = np.unique((model.levels(ctx_n) << 40) | ((cell(f2) + 1) << 20) | (cell(f1) + 1), return_inverse=True)
                mass = np.bincount(where, n)
                top = np.flatnonzero(n >= max(1, HOT_SHARE * model.total))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((np.zeros(len(cells), np.int32), np.ones(len(top), np.int32))), pa.int32()),
                     pa.array(np.concatenate((cells, pair_name(words[w[top]], names[ctx[top]]).view(np.int64))), pa.int64()),
                     pa.array(np.concatenate((mass, n[top])).astype(np.int64), pa.int64())], names=["hot", "name", "n"])

    sent = training.select("text").mapInArrow(send, "bucket int, asked boolean, blob binary").unionByName(model.asked.select("bucket", F.lit(True).alias("asked"), "blob"))
    sent = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = sent.mapInArrow(gather, "hot int, name long, n long").groupBy("hot", "name").agg(F.sum("n").alias("n")).collect()
    cells = [(r.name >> 40, (r.name >> 20 & 0xFFFFF) - 1, (r.name & 0xFFFFF) - 1, r.n) for r in found if not r.hot]
    pairs = sorted((int(np.int64(r.name).view(np.uint64)), r.n) for r in found if r.hot)
    return cells, np.array([k for k, _ in pairs], np.uint64), np.array([n for _, n in pairs], np.int64)


def learn_weights(cells: list, distinct: int) -> np.ndarray:
    """Mixture weights by level (pair, word, uniform), by expectation-maximisation on the cells."""
    weights = np.tile(np.array([0.0, 0.9, 0.1]), (64, 1))
    if not cells:
        weights[:] = (0.0, 0.0, 1.0)
        return weights
    table = np.array(cells, np.int64)
    f = np.stack([np.where(table[:, k] >= 0, 2.0 ** (-table[:, k] / CELL), 0.0) for k in (1, 2)] + [np.full(len(table), 1 / (distinct + 1))], axis=1)
    everything = np.bincount(table[:, 0], table[:, 3], 64)
    for level in np.unique(table[:, 0]):
        mine = table[:, 0] == level
        x, n = f[mine], table[mine, 3]
        w = np.array([0.4, 0.4, 0.2]) if level else np.array([0.0, 0.8, 0.2])
        for _ in range(ROUNDS):
            share = w * x
            w = (share / share.sum(1, keepdims=True) * n[:, None]).sum(0) / everything[level]
        weights[level] = 0.999 * w + 0.001 * np.array([0.0, 0.0, 1.0])  # an unseen token keeps a probability
    return weights


def score(docs: DataFrame, model: Model, buckets: int) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, base_sum, score`` of ``docs`` (``doc_id, held_out, train, text``).

    ``base_sum`` is the sum of log10(c + 1) over the tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType
    id_arrow = to_arrow_type(id_type)
    packed = StructType([StructField("bucket", IntegerType()), StructField("block", LongType()), StructField("blob", BinaryType()),
                         StructField("ids", ArrayType(id_type)), StructField("held", ArrayType(BooleanType())), StructField("sizes", ArrayType(LongType()))])
    packed_arrow = to_arrow_schema(packed)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        model, block = shared.value, TaskContext.get().partitionId() << 32
        for held, tok, sizes in token_blocks(batches):
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, flags = whole.column("doc_id"), whole.column("held_out")
            train = whole.column("train").to_numpy().astype(bool)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            names, number, ctx = contexts(tok, sizes)
            known, pair_n = _find(pair_name(tok, names[ctx]), model.pairs, model.pair_n)
            is_hot, hot_n = model.find_hot(names)
            # pairs above the share are scored here: their contexts are above it too
            here = np.zeros((3, len(sizes)))
            word_n = hot_n[number[known]]
            for row, v in zip(here, (np.ones(known.sum()), np.log10(word_n + 1), model.log10(model.find_contexts(names, [])[ctx[known]], word_n, pair_n[known]))):
                row += np.bincount(owner[known], v, len(sizes))
            number, ctx, owner = number[~known], ctx[~known], owner[~known]
            order = np.lexsort((owner, number * len(names) + ctx))
            number, ctx, owner = number[order], ctx[order], owner[order]
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(number) != 0) | (np.diff(ctx) != 0) | (np.diff(owner) != 0)
            first = np.flatnonzero(new)
            w, ctx, owner, tf = number[first], ctx[first], owner[first], np.diff(np.append(first, len(order)))
            to = model.bucket(names[w], names[ctx], is_hot[w], buckets)
            flat = lambda v, kind: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v.combine_chunks() if isinstance(v, pa.ChunkedArray) else pa.array(v, kind))
            head = pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([block], pa.int64()),
                                               pa.array([pack(np.arange(len(sizes), dtype=np.uint32), *here)], pa.binary()),
                                               flat(ids, None), flat(flags, None), flat(sizes, pa.int64())], names=packed.names)
            schema = head.schema
            yield head
            for b, i in _rows(to, np.argsort(to, kind="stable"), buckets):
                own, count = np.unique(w[i], return_counts=True)
                around, at = np.unique(ctx[i], return_inverse=True)
                blob = pack(steps(names[own]), narrow(count), steps(names[around]), steps(narrow(at)), narrow(owner[i]), narrow(tf[i]), train.astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([block], pa.int64()), pa.array([blob], pa.binary()),
                                                  *(pa.nulls(1, schema.field(k).type) for k in range(3, 6))], names=packed.names)
            block += 1

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b, rows in _groups(batches, "bucket", ["block", "blob"]):
            if b is None:
                yield rows
                continue
            asked = [x for block, x in rows if block < 0]
            blocks, parts = [block for block, _ in rows if block >= 0], [unpack(x, "sussuuu") for block, x in rows if block >= 0]
            del rows
            if not parts:
                continue
            names, place = _places(parts)
            context_n = model.find_contexts(names, asked)
            texts = [np.unique(p[4]) for p in parts]
            sums = [np.zeros((3, len(x))) for x in texts]
            for words, number, mine in _ranges(parts):
                ctx = np.concatenate([q[p[3][i]] for p, q, i in zip(parts, place, mine)])
                tf = np.concatenate([p[5][i] for p, i in zip(parts, mine)]).astype(np.int32)
                learned = np.concatenate([p[6][p[4][i]] for p, i in zip(parts, mine)]) * tf
                known, at = np.unique(number.astype(np.int64) * len(names) + ctx, return_inverse=True)
                pair_n = np.bincount(at, learned, len(known)).astype(np.int64)
                is_hot, hot_n = model.find_hot(words)
                word_n = np.where(is_hot, hot_n, np.bincount(number, learned, len(words)).astype(np.int64))
                edge = np.cumsum([0] + [i.stop - i.start for i in mine])
                for k, (p, mine_of) in enumerate(zip(parts, mine)):
                    i = slice(edge[k], edge[k + 1])
                    own, times = word_n[number[i]], tf[i]
                    where = np.searchsorted(texts[k], p[4][mine_of])
                    for row, v in zip(sums[k], (times * (own > 0), times * np.log10(own + 1), times * model.log10(context_n[ctx[i]], own, pair_n[at[i]]))):
                        row += np.bincount(where, v, len(row))
            for block, t, own in zip(blocks, texts, sums):
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([block], pa.int64()), pa.array([pack(t.astype(np.uint32), *own)], pa.binary()),
                                                  *(pa.nulls(1, packed_arrow.field(j).type) for j in range(3, 6))], names=packed.names)

    result = StructType([StructField("doc_id", id_type), StructField("held_out", BooleanType()), StructField("n_tokens", LongType()),
                         StructField("n_known", LongType()), StructField("base_sum", DoubleType()), StructField("score", DoubleType())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "block", ["blob", "ids", "held", "sizes"]):
            ids, held, sizes = next(x[1:] for x in rows if x[1] is not None)
            sums = np.zeros((3, len(sizes)))
            for blob, *_ in rows:
                texts, *parts = unpack(blob, "uddd")
                sums[:, texts] += np.stack(parts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_arrow), pa.array(held, pa.bool_()), pa.array(sizes, pa.int64()),
                                              pa.array(np.round(sums[0]).astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=result.names)

    asked = model.asked.select("bucket", F.lit(-1).cast("long").alias("block"), "blob", *(F.lit(None).cast(packed[k].dataType).alias(k) for k in ("ids", "held", "sizes")))
    sent = docs.select("doc_id", "held_out", "train", "text").mapInArrow(send, packed).unionByName(asked)
    spread = F.when(F.col("bucket") >= 0, F.col("bucket").cast("long")).otherwise(F.col("block"))
    weighed = sent.repartition(buckets, spread).sortWithinPartitions("bucket", "block").mapInArrow(weigh, packed)
    return weighed.repartition(buckets, "block").sortWithinPartitions("block", "bucket").mapInArrow(finish, result)


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of every document, learned from those whose id's remainder by 7 is not 2."""
    side = remainder(F.col("doc_id"), 7)
    buckets = BUCKETS_PER_PARTITION * shuffle_width(docs.sparkSession)
    training = docs.where((side != 2) & (side != -1)).select("text")
    docs = docs.select("doc_id", (side == 2).alias("held_out"), ((side != 2) & (side != -1)).alias("train"), "text")
    model = count_model(training)
    model.asked = written(context_counts(docs, model, buckets))
    cells, model.pairs, model.pair_n = held_out_cells(training, model, buckets)
    model.weights = learn_weights(cells, model.distinct)
    out = score(docs, model, buckets)
    shift = float(np.log10(model.total + model.distinct + 1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
                      (F.col("base_sum") - F.col("n_tokens") * shift).alias("base_score"), "score")
