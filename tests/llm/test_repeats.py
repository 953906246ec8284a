"""Repeated byte strings, near words and hard negatives against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from alloscan.llm import repeat_cutter as rc
from alloscan.llm import slot_negatives as sn
from alloscan.llm import spelling_variants as sv


def plain_cut(texts):
    """Removed mask of every text, by a dictionary of all strings."""
    where = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - rc.LENGTH + 1):
            where.setdefault(t[p:p + rc.LENGTH], []).append((i, p))
    masks = [np.zeros(len(t), bool) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for i, p in places:
                masks[i][p:p + rc.LENGTH] = True
    return masks


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [f"{a}{b}" for a in ("ba", "é", "tor", "Lin", "sü") for b in ("ka", "mo", "nd", "x", "ly", "st")]


def corpus(rng):
    passages = [prose(rng, n) for n in (90, 110, 140, 200)]
    texts = [None, "", " ", "a" * 399, "b" * 400, "c" * 401, "d" * 3000, "hehely " * 400, prose(rng, 4000), "é" * 700, "x" * 50 + "y" * 399]
    for k in range(60):
        a = prose(rng, rng.randint(0, 150))
        texts.append(a + rng.choice(passages) + prose(rng, rng.randint(0, 60)))
    hot = prose(rng, 80) + passages[3]
    for k in range(40):  # a hot passage between different neighbours, and with single letters changed
        t = prose(rng, rng.randint(5, 90)) + hot + prose(rng, rng.randint(5, 90))
        p = rng.randrange(len(t))
        texts.append(t[:p] + "#" * (k % 2) + t[p + k % 2:])
    texts += [texts[20]] * 5 + [texts[8] + texts[8]]
    return texts


@pytest.mark.parametrize("block", [1000, 7])
def test_cut_equals_brute_force(spark, monkeypatch, block):
    texts = corpus(random.Random(5))
    rows = [(i if i % 9 else None, t, "extra", i) for i, t in enumerate(texts)]
    monkeypatch.setattr(rc, "ANCHOR_BLOCK", block)  # 7: anchors in several shards, merged by range
    monkeypatch.setattr(rc, "RANGE_STRINGS", 1000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string, n int").repartition(4)
    got = {r["n"]: r for r in rc.cut(docs).collect()}
    data = [(t or "").encode() for t in texts]
    masks = plain_cut(data)
    assert len(got) == len(texts)
    for i, (t, m) in enumerate(zip(data, masks)):
        r = got[i]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], m.view(np.int8), [0]))))
        assert [(s["start"], s["end"]) for s in r["removed"]] == list(zip(edge[::2].tolist(), edge[1::2].tolist())), i
        assert bytes(r["kept"]) == bytes(np.frombuffer(t, np.uint8)[~m])
        assert r["text"] == texts[i]


def test_digest_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "k" * 1000), (2, None), (3, "short é")], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in rc.digest(docs).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1] == (1000, 1000, 1, empty) and got[2] == (0, 0, 0, empty)
    assert got[3] == (8, 0, 0, hashlib.sha256("short é".encode()).hexdigest())
    assert rc.digest(docs.limit(0)).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = random.Random(2)
    for alphabet, sizes in ((b"ab", (1, 2, 30, 300, 7, 8, 500)), (b"a", (40, 900, 41)), (bytes(range(256)), (600, 600))):
        parts = [bytes(rng.choice(alphabet) for _ in range(n)) for n in sizes]
        parts.append(parts[-1][3:] + b"b")
        sizes = np.array([len(p) + 1 for p in parts])
        data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        ends = np.cumsum(sizes)
        text = data.astype(np.uint16) + np.uint16(1)
        text[ends - 1] = 0
        order = rc.suffix_array(text)
        part = np.repeat(np.arange(len(parts)), sizes)
        begin = np.repeat(ends - sizes, sizes)
        suffix = lambda i: parts[part[i]][i - begin[i]:]
        assert order.tolist() == sorted(range(len(data)), key=lambda i: (suffix(i), part[i]))
        room = np.repeat(ends - 1, sizes) - np.arange(len(data))
        got = rc.common_prefixes(data, room, order)
        for k in range(1, len(order)):
            a, b = suffix(order[k - 1]), suffix(order[k])
            n = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert got[k] == min(n, rc.LENGTH)


def test_parts_of_a_long_text_hold_every_start_once(monkeypatch):
    monkeypatch.setattr(rc, "BLOCK_BYTES", 1000)
    rng = random.Random(1)
    texts = [bytes(rng.randrange(97, 123) for _ in range(n)) for n in (5000, 0, 399, 400, 1000, 1001, 20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64())] * 2 + [pa.array(texts, pa.binary())], names=["k1", "k2", "b"])
    starts = [(r["k1"], r["at"] + k) for b in rc._name([batch.slice(0, 3), batch.slice(3)]) for r in b.to_pylist() for k in range(r["n_starts"])]
    assert sorted(starts) == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - rc.LENGTH + 1)]


def edits(w, letters):
    for i in range(len(w) + 1):
        for c in letters:
            yield w[:i] + c + w[i:]
            if i < len(w):
                yield w[:i] + c + w[i + 1:]
        if i < len(w):
            yield w[:i] + w[i + 1:]


def plain_group(rows):
    """The contract by a dictionary of all single edits."""
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    letters = sorted({c for w in words for c in w})
    near = {w: {x for x in edits(w, letters) if x != w and x in words} for w in words}
    form = {}
    for w, xs in near.items():
        if xs:
            best = min(xs, key=lambda x: (-words[x], x))
            if words[best] >= 5 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


@pytest.mark.parametrize("often", [8, 1])
def test_variants_equal_brute_force(spark, monkeypatch, often):
    monkeypatch.setattr(sv, "OFTEN", often)
    rng = random.Random(4)
    stems = ["".join(rng.choice("aaeinrstßéÀ") for _ in range(rng.randint(5, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "ababababab", "x" * 3000]
    rows = []
    for s in stems:
        for w in {s, *rng.sample(sorted(edits(s, "aeXé")), 6), s + "aaaa"[:rng.randint(0, 4)]}:
            n = rng.choice((4, 5, 6, 30, 160))
            for k in range(n):
                rows.append((rng.randrange(50), f"{w.upper() if k % 3 == 0 and w.isascii() else w}."))
    rows += [(None, "aaeinr " * 70), (1, None), (2, ""), (3, "123 ab × ÷÷÷÷÷÷÷")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in sv.group(docs).collect())
    assert got == plain_group(rows)
    assert sum(r[1] is not None for r in got) > 20 and any(r[1] != r[2] for r in got if r[1])
    assert sv.group(docs.limit(0)).count() == 0


def test_an_edit_affects_no_more_grams_than_its_bound():
    rng = random.Random(8)
    for _ in range(3000):
        letters = "ab" if rng.random() < 0.5 else "abcd"
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 12)))
        grams = ["".join(rng.choice(letters + "\x02\x03") for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(0, 40))]
        frequent = {g: 9 for g in grams}
        v = rng.choice(sorted(set(edits(w, letters)) - {w}))
        sets = []
        for x in (w, v):
            p = sv.EDGES[0] + x + sv.EDGES[1]
            d = sv.decompose(p, frequent)
            sets.append((d, {(p[a:b + 1], a) for a, b in d}, len(p)))
        shift = len(v) - len(w)
        here = [(g, a) for g, a in sets[0][1] if (g, a) in sets[1][1] or (g, a + shift) in sets[1][1]]
        assert len(here) >= len(sets[0][0]) - sv.most_affected(sets[0][0], sets[0][2]), (w, v, frequent)


def plain_negatives(rows, every):
    ok = [(i, y, v) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, y, v in ok:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    out = []
    for a, (label, vector) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(vector, v)), i, y) for i, y, v in ok if len(v) == len(vector)]
        own = sorted((s, i) for s, i, y in scored if y == label and i != a)[:sn.POSITIVES]
        for ps, p in own:
            fits = sorted((s, i) for s, i, y in scored if y != label and 50 * -ps <= 100 * -s <= 95 * -ps)[:sn.NEGATIVES]
            out += [(a, p, k + 1, i, int(-ps), int(-s)) for k, (s, i) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 2048), (7, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, blocks):
    from pyspark.sql import functions as F
    monkeypatch.setattr(sn, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(sn, "ANCHOR_BLOCK", blocks[1])
    rng = random.Random(6)
    rows = [(i, rng.randrange(3), [float(rng.randint(-3, 9)) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, 1, [2.0, 2.0, 2.0, 2.0]) for i in range(60)]  # one vector many times: ties by id
    rows += [(10, 2, [1.0] * 4), (11, None, [1.0] * 4), (20, 1, None), (None, 1, [9.0] * 4), (30, 1, [1.0, None, 1.0, 1.0]),
             (40, 1, [float("nan"), 1.0, 1.0, 1.0]), (50, 0, [float("inf"), 1.0, 1.0, 1.0]), (60, 0, [1.0, 2.0]), (70, 1, [3.0, 2.0]), (80, 1, [2.0, 2.0]),
             (90, 0, [1.0, 2.5]), (100, 2, [1e6, 1e6, 1e6, 1e6]), (101, 2, [9e5] * 4), (103, 0, [8.5e5, 8.5e5, 9e5, 8e5]), (110, 5, [1.0] * 4)]
    data = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, label int, v array<double>, anchor string, slot int").repartition(5)
    got = sorted(tuple(r) for r in sn.mine(data, F.col("id") % 10 == 0).collect())
    assert got == plain_negatives(rows, 10)
    assert sn.mine(data.limit(0), F.col("id") % 10 == 0).count() == 0


def test_first_columns_of_large_and_equal_scores():
    rng = np.random.default_rng(3)
    for scale in (1.0, 2.0 ** 50):
        s = rng.integers(0, 4, (20, 40)) * scale
        s[3] = sn.NO_SCORE
        for row, best in zip(s, sn.first_columns(s, 5)):
            if row[0] > sn.NO_SCORE:
                assert sorted(best.tolist()) == sorted(sorted(range(40), key=lambda i: (-row[i], i))[:5])


def test_negatives_of_many_groups_without_a_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F
    for name, value in (("ROW_BLOCK", 7), ("ANCHOR_BLOCK", 3), ("ANCHOR_GROUP", 1)):
        monkeypatch.setattr(sn, name, value, raising=False)
    plans, written = [], sn.written
    monkeypatch.setattr(sn, "written", lambda df: plans.append(df) or written(df))
    rng = random.Random(8)
    rows = [(i, rng.randrange(3), [float(rng.randint(-3, 9)) for _ in range(4)]) for i in range(200)]
    out = sn.mine(spark.createDataFrame(rows, "id long, label int, v array<double>").repartition(3), F.col("id") % 5 == 0)
    assert sorted(tuple(r) for r in out.collect()) == plain_negatives(rows, 5)
    # anchors repeated for every share are larger than the planner thinks: they must not pass through the driver
    for df in [*plans, out]:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_grid_of_groups_and_shares():
    assert sn.grid(51282, 1026, 1026 * 64, 12) == (1, 12)
    assert sn.grid(615384, 12312, 12312 * 64, 600) == (7, 86)
    assert sn.grid(100, 0, 0, 8) == (1, 8) and sn.grid(10, 10, 640, 1) == (1, 1)
    groups, shares = sn.grid(10 ** 9, 2 * 10 ** 7, 2 * 10 ** 7 * 1024, 600)
    assert groups * sn.GROUP_NUMBERS >= 2 * 10 ** 7 * 1024 and shares == 1


@pytest.mark.parametrize("dense, scale", [(1, 1), (8, 1), (10 ** 9, 1), (1, 1.5), (8, 10 ** 6)])
def test_best_of_a_block_equal_brute_force(monkeypatch, dense, scale):
    """Few scores above the limit, many, whole numbers in single and in double precision, and others."""
    monkeypatch.setattr(sn, "DENSE", dense)
    monkeypatch.setattr(sn, "FIRST", 20)
    rng = np.random.default_rng(9)
    kind = "<f8" if scale == 1.5 else "<i4"
    n, size, labels, ids = 12, 3, rng.integers(0, 3, 300), rng.integers(0, 200, 300)
    v = (rng.integers(-9, 10, (300, size)) * scale).astype(kind)
    own, anchors, mine = rng.integers(0, 3, n), (rng.integers(-9, 10, (n, size)) * scale).astype(kind), np.arange(n) * 10
    scores = anchors.astype(float) @ v.T.astype(float)
    limits = -np.sort(-rng.integers(-150, 150, (n, sn.POSITIVES)) * float(scale) ** 2, axis=1)
    limits[3, 2:], limits[4] = sn.NO_SCORE, sn.NO_SCORE
    row = {"size": size, "ids": mine.tobytes(), "labels": own.tobytes(), "type": kind, "numbers": anchors.tobytes(), "limits": limits.tobytes()}
    for slots, k in ((1, sn.POSITIVES), (sn.POSITIVES, sn.NEGATIVES)):
        best = sn._Best(row, slots, k)
        for lo in range(0, 300, 70):
            some = np.arange(lo, min(300, lo + 70))
            some = some[np.argsort(ids[some], kind="stable")]
            best.meet(ids[some], labels[some], *sn._matrix(kind, v[some].tobytes(), size))
        for a in range(n):
            for j in range(slots):
                fits = [labels[c] == own[a] and ids[c] != mine[a] if slots == 1 else labels[c] != own[a] and (limits[a] >= scores[a, c]).sum() == j + 1 for c in range(300)]
                want = sorted((-scores[a, c], ids[c]) for c in range(300) if fits[c])[:k]
                assert [(-s, i) for s, i in zip(best.score[a, j], best.id[a, j]) if s > sn.NO_SCORE] == want
