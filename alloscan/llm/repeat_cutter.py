"""Removal of byte strings that occur twice: suffix arrays of shards, common prefixes, merging across shards.

A text is its UTF-8 bytes. Every byte that lies in a string of ``LENGTH`` bytes which also starts anywhere else,
in the same text too, is removed; strings are judged on the input and never cross texts.

A string's *anchor* is the least hash among the runs of ``GRAM`` bytes inside it, so equal strings have equal
anchors. The starts of a text that share an anchor form a *stretch*: the bytes of all their strings, which
overlap. Stretches are named by (anchor, bytes), and only the names are counted over the whole corpus:

* a name that occurs twice settles all its strings at once, however often it occurs;
* an anchor with one name that occurs once holds nothing that is repeated;
* for any other anchor one copy of each of its stretches is dealt to a shard, by anchor, so equal strings meet.

A shard sorts its suffixes by Larsson-Sadakane refinement (prefix doubling over the groups that are not yet single)
and takes common prefixes in Kasai's order, in lanes of neighbouring positions that advance together. Strings in
neighbouring suffixes with a common prefix of ``LENGTH`` or more are repeated. The stretches of an anchor with more
than ``ANCHOR_BLOCK`` names are spread over several shards; each of these cuts its sorted list of distinct strings,
by 128-bit name, at the borders of the merging ranges, and a range's task looks every shard's list up in the merged
lists by binary search.

Defined cases: a null text is empty; a text shorter than ``LENGTH`` keeps all its bytes and counts for nothing;
copies and repeated rows are repeats of one another and lose all their bytes; an empty table gives an empty result;
columns named ``removed`` and ``kept`` are replaced, all others stay as they are. Texts are long only to the reader:
blocks of ``BLOCK_BYTES`` overlap by a string. Names are 128 bits of two hashes, taken as equal if they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from alloscan.llm.common import mix64, written

LENGTH = 400
#: Bytes of the runs whose hashes are compared; a string has LENGTH - GRAM + 1 of them.
GRAM = 128
#: Bytes hashed at once, and the bits of a place in a block.
BLOCK_BYTES, PLACE_BITS = 1 << 20, 21
#: Bytes from which a shard takes no further anchor, and names of an anchor in one shard.
SHARD_BYTES, ANCHOR_BLOCK = 1 << 20, 200
#: Strings of a range of the merge, at most about this many.
RANGE_STRINGS = 1 << 19
#: Neighbouring positions walked by a lane.
LANE = 128


def _powers(base: int) -> np.ndarray:
    """1, base, base squared, ... modulo 2^64, one more than a block has bytes."""
    steps = np.full(BLOCK_BYTES + 2, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class _Rolling:
    """Hashes of any run of bytes of a block, by differences of prefix sums modulo 2^64."""

    tables: dict[int, tuple] = {}

    def __init__(self, data: np.ndarray, base: int):
        if base not in self.tables:
            self.tables[base] = (_powers(base), _powers(pow(base, -1, 1 << 64)), mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(base)))
        ahead, self.back, letters = self.tables[base]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * ahead[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


ONE, TWO = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def _least_below(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks of that width in both directions."""
    n = len(x) - width + 1
    whole = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    whole[:len(x)] = x
    ahead = np.minimum.accumulate(whole.reshape(-1, width), axis=1).ravel()
    back = np.minimum.accumulate(whole.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """First start, number of starts, anchor and name of every stretch of the texts that end at ``ends`` in ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    one = _Rolling(data, ONE)
    at = np.arange(len(data) - GRAM + 1)
    grams = one.of(at, at + GRAM)
    place = np.uint64((1 << PLACE_BITS) - 1)
    anchor = (_least_below((grams & ~place) | at.astype(np.uint64), LENGTH - GRAM + 1) & place).astype(np.int64)
    stop = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
    start = np.flatnonzero(at[:len(anchor)] + LENGTH <= stop[:len(anchor)])
    if not len(start):
        return none, none, none, none
    first = np.flatnonzero(np.concatenate(([True], np.diff(anchor[start]) != 0)))
    count = np.diff(np.concatenate((first, [len(start)])))
    begin = start[first]
    two = _Rolling(data, TWO)
    return begin, count, grams[anchor[begin]].view(np.int64), two.of(begin, begin + count + LENGTH - 1).view(np.int64)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value starts (one place more at the end)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else np.zeros(0, np.uint8)
    return data, offsets


def _pieces(offsets: np.ndarray) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """Blocks of (row, first byte in the column, end in it): whole texts, or parts of a long one that overlap by a string less one byte."""
    rows, lo, hi, size = [], [], [], 0
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        while b - a >= LENGTH:
            end = min(b, a + BLOCK_BYTES)
            if size and size + end - a > BLOCK_BYTES:
                yield rows, lo, hi
                rows, lo, hi, size = [], [], [], 0
            rows.append(i)
            lo.append(a)
            hi.append(end)
            size += end - a
            if end == b:
                break
            a = end - LENGTH + 1
    if rows:
        yield rows, lo, hi


_NAME_SCHEMA = "k1 long, k2 long, at int, n_starts int, anchor long, name long, n int, lo array<int>, hi array<int>"
_NAME_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each stretch of each text (or part of a long one), the first of equal ones with their number; where there are
    equal ones, also a row with the runs of all their starts, so that a text of one repeated letter has few rows."""
    fields = [x.split()[0] for x in _NAME_SCHEMA.split(", ")]
    for batch in batches:
        data, offsets = _bytes_of(batch.column(2))
        keys = [np.asarray(batch.column(i)) for i in (0, 1)]
        for rows, lo, hi in _pieces(offsets):
            size = np.array(hi) - np.array(lo)
            ends = np.cumsum(size)
            begin, count, anchor, name = stretches(np.concatenate([data[a:b] for a, b in zip(lo, hi)]), ends)
            if not len(begin):
                continue
            part = np.searchsorted(ends, begin, side="right")
            at = begin + (np.array(lo) - offsets[rows] - (ends - size))[part]
            by = np.lexsort((at, name, anchor, part))
            new = np.concatenate(([True], (np.diff(part[by]) != 0) | (np.diff(anchor[by]) != 0) | (np.diff(name[by]) != 0)))
            heads = np.flatnonzero(new)
            n = np.diff(np.concatenate((heads, [len(by)])))
            first, row = by[heads], np.array(rows)[part[by[heads]]]
            none = pa.nulls(len(first), _NAME_TYPES[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip((keys[0][row], keys[1][row], at[first], count[first], anchor[first], name[first], n), _NAME_TYPES)]
                + [none, none], names=fields)
            again = np.sort(by[np.repeat(n > 1, n)])
            own = []
            for p in np.unique(part[again]):
                mine = again[part[again] == p]
                joined = np.flatnonzero(np.concatenate(([True], at[mine][1:] != (at[mine] + count[mine])[:-1])))
                last = np.concatenate((joined[1:], [len(mine)])) - 1
                own.append((int(keys[0][rows[p]]), int(keys[1][rows[p]]), *[None] * 5, at[mine][joined].tolist(), (at[mine] + count[mine] - 1)[last].tolist()))
            if own:
                yield _packed(own, fields, _NAME_TYPES)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text`` (values 1 to 256; a 0 ends a stretch and is less than all, by place among zeros).

    The first seven symbols are sorted as one number. Then groups of equal suffixes are refined: their members are
    sorted by the group of what follows the symbols known to be equal, which doubles those.
    """
    n = len(text)
    key, open_ = np.zeros(n, np.uint64), np.ones(n, bool)
    padded = np.concatenate((text, np.zeros(7, text.dtype)))
    for j in range(7):
        symbol = padded[j:j + n]
        key = (key << np.uint64(9)) | np.where(open_, symbol, 0).astype(np.uint64)
        open_ &= symbol > 0
    order = np.argsort(key, kind="stable")
    key, single = key[order], ~open_[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | single[1:]))
    group = np.empty(n, np.int64)
    group[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    # slots of groups with two members or more
    slots = np.flatnonzero(~(fresh & np.concatenate((fresh[1:], [True]))))
    depth = 7
    while len(slots):
        members = order[slots]
        pair = group[members] * np.int64(n + 1) + group[members + depth]
        by = np.argsort(pair, kind="stable")
        members, pair = members[by], pair[by]
        order[slots] = members
        fresh = np.concatenate(([True], pair[1:] != pair[:-1]))
        group[members] = slots[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        slots = slots[~(fresh & np.concatenate((fresh[1:], [True])))]
        depth *= 2
    return order


def common_prefixes(data: np.ndarray, room: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix, by slot, and the one before it in ``order``, up to LENGTH; ``room`` is what is left of its stretch.

    In Kasai's order a prefix is at least that of the position before, less one. Lanes of ``LANE`` neighbouring
    positions take their steps together; a lane starts from nothing.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(LENGTH + 16, np.uint8))), 8)
    words = np.ascontiguousarray(eight).view("<u8").ravel()
    out = np.zeros(n, np.int64)
    heads = np.arange(0, n, LANE)
    known = np.zeros(len(heads), np.int64)
    for step in range(LANE):
        i = heads[:np.searchsorted(heads, n - step)] + step
        j = before[i]
        known = np.maximum(known[:len(i)] - 1, 0)
        most = np.where(j >= 0, np.minimum(np.minimum(room[i], room[j]), LENGTH), 0)
        known = np.minimum(known, most)
        live = np.flatnonzero(known < most)
        while len(live):
            x = words[i[live] + known[live]] ^ words[j[live] + known[live]]
            # equal low bytes: those below the lowest set bit
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            known[live] = np.minimum(known[live] + same, most[live])
            live = live[(same == 8) & (known[live] < most[live])]
        out[i] = known
    return out[order]


def repeated_starts(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings of the stretches ``parts``, by suffix array.

    Gives (part, start in it) of every string in sorted order, whether it occurs twice, and whether it is the
    first of its equals.
    """
    sizes = np.array([len(p) + 1 for p in parts])
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    ends = np.cumsum(sizes)
    text = data.astype(np.uint16) + np.uint16(1)
    text[ends - 1] = 0
    part = np.repeat(np.arange(len(parts)), sizes)
    begin = np.repeat(ends - sizes, sizes)
    room = np.repeat(ends - 1, sizes) - np.arange(len(data))
    order = suffix_array(text)
    equal = common_prefixes(data, room, order) >= LENGTH
    twice = equal | np.concatenate((equal[1:], [False]))
    whole = room[order] >= LENGTH
    order = order[whole]
    return part[order], order - begin[order], twice[whole], ~equal[whole]


def _mask_runs(at: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of the runs of neighbouring numbers."""
    at = np.sort(at)
    new = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
    return at[new].tolist(), at[np.concatenate((new[1:], [len(at)])) - 1].tolist()


_SHARD_FIELDS = ("anchor", "name", "lo", "hi", "range", "names", "refs")
_SHARD_SCHEMA = "anchor long, name long, lo array<int>, hi array<int>, range int, names binary, refs binary"
#: What the merge needs to know of a string: its two names, its stretch and its start.
_REF = np.dtype([("anchor", "<i8"), ("name", "<i8"), ("at", "<i4"), ("twice", "<i4")])
_NAMES = np.dtype([("one", "<u8"), ("two", "<u8")])


def _shard(rows: list[tuple], ranges: int) -> Iterator[tuple]:
    """Results of one shard: runs of repeated starts for each stretch, and packed lists of the strings that other shards may hold."""
    anchors, names, spread, settled, parts = zip(*rows)
    part, at, twice, first = repeated_starts(list(parts))
    news = twice & ~np.array(settled)[part]
    by = np.argsort(part[news], kind="stable")
    found, places = part[news][by], at[news][by]
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(found) != 0))) if len(found) else []
    for a, b in zip(cuts, [*cuts[1:], len(found)]):
        yield anchors[found[a]], names[found[a]], *_mask_runs(places[a:b]), None, None, None
    spread = np.array(spread)
    send = np.flatnonzero(first & spread[part])
    if not len(send):
        return
    refs = np.zeros(len(send), _REF)
    refs["anchor"], refs["name"] = np.array(anchors)[part[send]], np.array(names)[part[send]]
    refs["at"], refs["twice"] = at[send], twice[send]
    keys = np.zeros(len(send), _NAMES)
    which = part[send]
    by = np.argsort(which, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(which[by]) != 0)))
    for a, b in zip(cuts, [*cuts[1:], len(by)]):
        mine = by[a:b]
        data = np.frombuffer(parts[which[mine[0]]], np.uint8)
        begin = at[send[mine]]
        keys["one"][mine] = _Rolling(data, ONE).of(begin, begin + LENGTH)
        keys["two"][mine] = _Rolling(data, TWO).of(begin, begin + LENGTH)
    by = np.argsort(keys, order=("one", "two"))
    keys, refs = keys[by], refs[by]
    borders = np.searchsorted(keys["one"], np.array([r * (1 << 64) // ranges for r in range(1, ranges)], np.uint64))
    for r, (a, b) in enumerate(zip([0, *borders], [*borders, len(keys)])):
        if b > a:
            yield None, None, None, None, r, keys[a:b].tobytes(), refs[a:b].tobytes()


def _packed(rows: list[tuple], fields: tuple[str, ...] | list[str], types: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(fields))


def _shards(ranges: int):
    types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last, seen = [], 0, None, None
        for batch in batches:
            for anchor, salt, name, spread, settled, part in zip(*(c.to_pylist() for c in batch.columns)):
                if (anchor, salt) != last and size >= SHARD_BYTES:
                    yield _packed(list(_shard(rows, ranges)), _SHARD_FIELDS, types)
                    rows, size = [], 0
                last = (anchor, salt)
                if (anchor, name) != seen:
                    rows.append((anchor, name, spread, settled, part))
                    size += len(part)
                seen = (anchor, name)
        if rows:
            yield _packed(list(_shard(rows, ranges)), _SHARD_FIELDS, types)
    return run


def _merge_range(lists: list[np.ndarray], refs: list[np.ndarray]) -> Iterator[tuple]:
    """Runs of starts whose strings other shards hold too: each list is looked up in all lists merged."""
    merged = np.sort(np.concatenate(lists), order=("one", "two"))
    one = merged["one"]
    hit = []
    for mine, ref in zip(lists, refs):
        lo, hi = np.searchsorted(one, mine["one"]), np.searchsorted(one, mine["one"], side="right")
        # equal first names are one string, but for a collision, which the second names tell
        many = np.flatnonzero((hi - lo > 1) & (ref["twice"] == 0))
        hit += [ref[k:k + 1] for k in many if (merged["two"][lo[k]:hi[k]] == mine["two"][k]).sum() > 1]
    if not hit:
        return
    hit = np.sort(np.concatenate(hit), order=("anchor", "name", "at"))
    cuts = np.flatnonzero(np.concatenate(([True], (np.diff(hit["anchor"]) != 0) | (np.diff(hit["name"]) != 0))))
    for a, b in zip(cuts, [*cuts[1:], len(hit)]):
        yield int(hit["anchor"][a]), int(hit["name"][a]), *_mask_runs(hit["at"][a:b])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    lists, refs, last = [], [], None
    for batch in batches:
        for r, names, ref in zip(*(c.to_pylist() for c in batch.columns)):
            if r != last and lists:
                yield _packed(list(_merge_range(lists, refs)), _SHARD_FIELDS[:4], types)
                lists, refs = [], []
            last = r
            lists.append(np.frombuffer(names, _NAMES))
            refs.append(np.frombuffer(ref, _REF))
    if lists:
        yield _packed(list(_merge_range(lists, refs)), _SHARD_FIELDS[:4], types)


def _cut(keep: int):
    """``removed`` and ``kept`` from the runs of repeated starts that come last in a row, after its bytes."""
    spans_type = pa.list_(pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                removed, kept = [], []
                for text, found in zip(batch.column(keep).to_pylist(), batch.column(keep + 1).to_pylist()):
                    text, spans = text or b"", []
                    for x in sorted((x["lo"], x["hi"]) for x in found or []):
                        if spans and x[0] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], x[1] + LENGTH)
                        else:
                            spans.append([x[0], x[1] + LENGTH])
                    edges = [0, *(e for s in spans for e in s), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    removed.append([{"start": a, "end": b} for a, b in spans])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(keep)), pa.array(removed, spans_type), pa.array(kept, pa.binary())],
                    names=[*batch.schema.names[:keep], "removed", "kept"])
    return run


def repeated(docs: DataFrame, text: str = "text") -> DataFrame:
    """``k1, k2, found``: for every text, by its two hashes, the runs ``lo`` to ``hi`` of starts of repeated strings."""
    texts = (docs.select(F.col(text).cast("binary").alias("b")).where(F.octet_length("b") >= LENGTH)
             .select(F.xxhash64("b").alias("k1"), F.xxhash64(F.lit(1), "b").alias("k2"), "b"))
    read = written(texts.mapInArrow(_name, _NAME_SCHEMA))
    runs = read.where("anchor is not null")
    named = runs.groupBy("anchor", "name").agg(
        F.sum("n").alias("n"), F.min("k1").alias("k1"), F.min_by("k2", "k1").alias("k2"), F.min_by("at", "k1").alias("at"),
        F.max("n_starts").alias("n_starts"))
    anchors = (named.groupBy("anchor").agg(F.count("*").alias("n_names"), F.sum("n").alias("total"))
               .where("total > 1").select("anchor", "n_names"))
    named = written(named.join(anchors, "anchor"))
    salts = F.ceil(F.col("n_names") / ANCHOR_BLOCK)
    wanted = (named.where("n_names > 1")
              .groupBy("k1", "k2").agg(F.collect_list(F.struct(
                  "anchor", F.pmod("name", salts).alias("salt"), "name", (F.col("n_names") > ANCHOR_BLOCK).alias("spread"),
                  (F.col("n") > 1).alias("settled"), "at", "n_starts")).alias("want")))
    ranges = 1 + named.where(F.col("n_names") > ANCHOR_BLOCK).agg(F.coalesce(F.sum("n_starts"), F.lit(0))).first()[0] // RANGE_STRINGS
    # one text of each hash, chosen before the shuffle, so that copies weigh no more than one
    parts = (texts.groupBy("k1", "k2").agg(F.first("b").alias("b")).join(wanted, ["k1", "k2"])
             .select(F.explode(F.transform("want", lambda x: F.struct(
                 x.anchor.alias("anchor"), x.salt.alias("salt"), x["name"].alias("name"), x.spread.alias("spread"),
                 x.settled.alias("settled"), F.substring(F.col("b"), x["at"] + 1, x.n_starts + (LENGTH - 1)).alias("part")))).alias("x")).select("x.*"))
    shards = written(parts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "name")
                     .mapInArrow(_shards(ranges), _SHARD_SCHEMA))
    merged = (shards.where("range is not null").select("range", "names", "refs").repartition("range").sortWithinPartitions("range")
              .mapInArrow(_merge, "anchor long, name long, lo array<int>, hi array<int>"))
    starts = (shards.where("range is null").select("anchor", "name", "lo", "hi").union(merged)
              .union(named.where("n > 1").select("anchor", "name", F.array(F.lit(0)), F.array(F.col("n_starts") - 1))))
    hits = (runs.drop("lo", "hi").join(starts, ["anchor", "name"])
            .select("k1", "k2", F.transform("lo", lambda x: x + F.col("at")).alias("lo"), F.transform("hi", lambda x: x + F.col("at")).alias("hi")))
    return (hits.union(read.where("anchor is null").select("k1", "k2", "lo", "hi"))
            .select("k1", "k2", F.explode(F.arrays_zip("lo", "hi")).alias("x")).groupBy("k1", "k2").agg(F.collect_set("x").alias("found")))


def cut(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``removed``, the maximal spans of bytes that were taken out, and ``kept``, the bytes that remain."""
    names = [c for c in docs.columns if c not in ("removed", "kept")]
    found = written(repeated(docs, text))
    body = docs.select(F.struct(*[F.col(c) for c in names]).alias("doc"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("b"))
    keyed = body.select("doc", "b", F.xxhash64("b").alias("k1"), F.xxhash64(F.lit(1), "b").alias("k2"))
    own = "_" * (1 + max(map(len, names), default=0))  # longer than any name there is
    joined = keyed.join(found, ["k1", "k2"], "left").select("doc.*", F.col("b").alias(own + "b"), F.col("found").alias(own + "f"))
    return joined.mapInArrow(_cut(len(names)), docs.select(*names).schema.add(
        "removed", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))).add("kept", "binary"))


def digest(docs: DataFrame) -> DataFrame:
    """What was removed from every document, and the hash of the rest."""
    return cut(docs.select("doc_id", "text")).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
