"""Toxicity by a bidirectional gated recurrent network with attention pooling, in NumPy.

A word (a run of letters and digits, lower-cased) enters as its vector, if it is one of the training
words, joined to the mean vector of its character trigrams. Two gated recurrent layers read a window of
words from either side, an attention weight per word pools their states, and a logistic unit gives the
window's score. A text is read whole in overlapping windows; its score is the highest of theirs.

It learns from a bounded sample of labelled rows. A label holds for a text, not for a window, so the
windows of an unmarked text are all examples against. At first any window of a marked text is an example
for; later only the one that scores highest now is, and the highest of an unmarked text are those against.

Defined cases: a null text, and one without a word, has the score of an empty window; without labelled
rows of both kinds every score is 0.5 and nothing is predicted; a null id is neither held out nor learned
from; an id with several labels counts as marked if one of them marks it; repeated rows get the same
result; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read, and of the labels
``doc_id`` and ``toxic``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloscan.llm.common import bounded_sample, code_points, mix64, remainder, run_hashes, runs

#: Labelled rows that are learned from, at most so many of either kind.
SAMPLE_MARKED, SAMPLE_UNMARKED = 1000, 2000
#: Words of a window, and by how many the next one begins later.
WINDOW, STRIDE = 32, 24
WORD_DIM, CHAR_DIM, HIDDEN, CHAR_ROWS = 12, 8, 8, 4096
#: A word gets a vector of its own if so many sample texts hold it; of these, the most frequent.
LEAST_TEXTS, VOCABULARY = 25, 20_000
STEPS, TEXTS_PER_STEP, RATE, DECAY = 450, 32, 0.01, 1e-3
#: Share of the marked texts in a step that teach, the highest scoring ones: some labels have no ground in the text.
TRUSTED = 0.7
#: Share of the steps, at first, in which every window has its text's label, and texts of either kind in such a step.
EARLY, EARLY_TEXTS = 0.5, 160
THRESHOLD = 0.7
BLOCK_CHARS = 1_000_000
SEED = 7


@functools.lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for c in range(0x110000):
        out[c] = not 0xD800 <= c < 0xE000 and chr(c).isalnum()
    return out


def read_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of some texts: the distinct words' hashes, per word its number among them, words per text,
    and the distinct words' trigram rows, flat with the start of each."""
    joined = "\n".join(t.lower() for t in texts) + "\n"
    cp = code_points(joined)
    inside = _word_characters()[cp]
    start, end = runs(inside)
    size = np.array([len(t.lower()) + 1 for t in texts], np.int64)
    per_text = np.diff(np.searchsorted(start, np.concatenate(([0], np.cumsum(size)))))
    hashes, first, number = np.unique(run_hashes(cp, inside, start, end), return_index=True, return_inverse=True)
    length = end[first] - start[first]
    begin = np.cumsum(length) - length
    at = np.arange(length.sum()) - np.repeat(begin, length) + np.repeat(start[first], length)
    shown = np.where(inside, cp, 0).astype(np.uint64)
    before, after = shown[at - 1], shown[at + 1]
    before[at == 0] = 0
    rows = (mix64(before | shown[at] << np.uint64(21) | after << np.uint64(42)) % np.uint64(CHAR_ROWS)).astype(np.int64)
    return hashes, number, per_text, rows, begin


def windows_of(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word (counted over all texts) and text of every window; a text without words has one window."""
    count = np.maximum(1, -(-(per_text - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(per_text)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(np.cumsum(per_text) - per_text, count) + k * STRIDE, text


def window_words(first: np.ndarray, text: np.ndarray, per_text: np.ndarray, number: np.ndarray, none: int) -> np.ndarray:
    """Word numbers of every window, ``none`` behind the end of the text."""
    at = first[:, None] + np.arange(WINDOW)
    ends = np.cumsum(per_text)[text][:, None]
    if not len(number):
        return np.full(at.shape, none)
    return np.where(at < ends, number[np.minimum(at, len(number) - 1)], none)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh(rng: np.random.Generator, words: int) -> dict[str, np.ndarray]:
    n, d = HIDDEN, WORD_DIM + CHAR_DIM
    p = {"word": rng.normal(0, 0.1, (words + 1, WORD_DIM)), "char": rng.normal(0, 0.1, (CHAR_ROWS, CHAR_DIM)),
         "attend": rng.normal(0, 0.3, 2 * n), "out": rng.normal(0, 0.3, 2 * n), "bias": np.array([-1.0])}
    for side in "fb":
        p |= {f"in_{side}": rng.normal(0, d ** -0.5, (d, 3 * n)), f"state_{side}": rng.normal(0, n ** -0.5, (n, 3 * n)),
              f"gate_{side}": np.zeros(3 * n)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def layer(x: np.ndarray, real: np.ndarray, state: np.ndarray, back: bool, keep: bool = False):
    """One gated recurrent layer over (time, windows, 3 x HIDDEN) gate inputs; padding leaves the state as it is."""
    n = HIDDEN
    steps, h = range(len(x))[::-1 if back else 1], np.zeros((x.shape[1], n), np.float32)
    out, tape = np.empty((*x.shape[:2], n), np.float32), []
    for t in steps:
        g = h @ state
        zr = _sigmoid(x[t, :, :2 * n] + g[:, :2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(x[t, :, 2 * n:] + r * g[:, 2 * n:])
        m = real[t][:, None]
        if keep:
            tape.append((t, h, z, r, c, g[:, 2 * n:], m))
        h = np.where(m, c + z * (h - c), h)
        out[t] = h
    return (out, tape) if keep else out


def layer_gradient(tape: list, dout: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of ``state``, given those of the layer's outputs."""
    n = HIDDEN
    dx, dstate, dh = np.zeros((*dout.shape[:2], 3 * n), np.float32), np.zeros_like(state), 0
    for t, h, z, r, c, gc, m in reversed(tape):
        d = dh + dout[t]
        dc = d * (1 - z) * (1 - c * c) * m
        dz = d * (h - c) * z * (1 - z) * m
        dr = dc * gc * r * (1 - r)
        dg = np.concatenate((dz, dr, dc * r), axis=1)
        dx[t] = np.concatenate((dz, dr, dc), axis=1)
        dstate += h.T @ dg
        dh = np.where(m, d * z, d) + dg @ state.T
    return dx, dstate


def pool(h: np.ndarray, real: np.ndarray, attend: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention weights over time and the pooled states; an empty window pools to zeros."""
    s = np.where(real, h @ attend, -np.inf)
    top = np.where(real.any(0), s.max(0), 0)
    w = np.exp(s - top)
    w /= np.maximum(w.sum(0), 1e-30)
    return w, np.einsum("tb,tbn->bn", w, h)


def score_windows(p: dict[str, np.ndarray], gates_f: np.ndarray, gates_b: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Logit of every window; ``gates``: one row of gate inputs per distinct word and a last one for padding."""
    out = np.empty(len(words), np.float32)
    for lo in range(0, len(words), 4096):
        w = words[lo:lo + 4096].T
        real = w < len(gates_f) - 1
        h = np.concatenate((layer(gates_f[w], real, p["state_f"], False), layer(gates_b[w], real, p["state_b"], True)), axis=2)
        out[lo:lo + 4096] = pool(h, real, p["attend"])[1] @ p["out"] + p["bias"][0]
    return out


def word_inputs(p: dict[str, np.ndarray], ids: np.ndarray, rows: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Word vector and mean trigram vector of each distinct word."""
    if not len(ids):
        return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
    count = np.diff(np.concatenate((begin, [len(rows)])))[:, None]
    return np.concatenate((p["word"][ids], np.add.reduceat(p["char"][rows], begin, axis=0) / count), axis=1).astype(np.float32)


def gates(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate((x @ p[f"in_{s}"] + p[f"gate_{s}"], np.zeros((1, 3 * HIDDEN), np.float32))) for s in "fb")


def ids_of(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """1 + place of a hash in the sorted training words, 0 for others."""
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at + 1, 0)


def train(texts: list[str], marked: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Training words (sorted hashes) and parameters. The number of steps is fixed."""
    rng = np.random.default_rng(SEED)
    parts = [read_words(texts[i:i + 100]) for i in range(0, len(texts), 100)]
    per_text = np.concatenate([x[2] for x in parts])
    word_hash = np.concatenate([x[0][x[1]] for x in parts])
    owner = np.repeat(np.arange(len(texts)), per_text)
    hashes, number = np.unique(word_hash, return_inverse=True)
    held = np.unique(number.astype(np.int64) * len(texts) + owner) // len(texts)
    in_texts = np.bincount(held, minlength=len(hashes))
    own = np.flatnonzero(in_texts >= LEAST_TEXTS)
    known = np.sort(hashes[own[np.argsort(-in_texts[own], kind="stable")[:VOCABULARY]]])
    ids = ids_of(hashes, known)
    # trigram rows of each distinct word, from the first part that holds it
    lists: list = [None] * len(hashes)
    for x in parts:
        for h, b, e in zip(np.searchsorted(hashes, x[0]), x[4], np.concatenate((x[4][1:], [len(x[3])]))):
            if lists[h] is None:
                lists[h] = x[3][b:e]
    del parts, word_hash
    p = fresh(rng, len(known))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    first, text = windows_of(per_text)
    spans = np.searchsorted(text, np.arange(len(texts) + 1))
    sides = np.flatnonzero(marked), np.flatnonzero(~marked)
    for step in range(STEPS):
        early = step < EARLY * STEPS
        half = EARLY_TEXTS if early else TEXTS_PER_STEP
        picked = np.concatenate([rng.choice(s, half) for s in sides])
        if early:
            w = spans[picked] + (rng.random(len(picked)) * (spans[picked + 1] - spans[picked])).astype(np.int64)
            group = np.arange(len(picked))
        else:
            w = np.concatenate([np.arange(spans[i], spans[i + 1]) for i in picked])
            group = np.repeat(np.arange(len(picked)), spans[picked + 1] - spans[picked])
        words = window_words(first[w], text[w], per_text, number, len(hashes))
        distinct, words = np.unique(words, return_inverse=True)
        words = words.reshape(len(w), WINDOW)
        real_words = distinct[distinct < len(hashes)]
        rows = [lists[i] for i in real_words]
        size = np.array([len(r) for r in rows], np.int64)
        flat, begin = (np.concatenate(rows) if rows else np.zeros(0, np.int64)), np.cumsum(size) - size
        use = ids[real_words] * (rng.random(len(real_words)) > 0.2)  # some words are shown by their characters alone
        x = word_inputs(p, use, flat, begin)
        words = np.where(words < len(real_words), words, len(real_words))
        take = np.arange(len(w))
        if not early:
            logits = score_windows(p, *gates(p, x), words)
            best = [mine[np.argsort(-logits[mine])] for i in range(len(picked)) for mine in [np.flatnonzero(group == i)]]
            sure = sorted(best[:half], key=lambda x: -logits[x[0]])[:int(TRUSTED * half)]
            take = np.concatenate([*(x[:1] for x in sure), *(x[:4] for x in best[half:])])
        y = (group[take] < half).astype(np.float32)
        grad = _gradient(p, x, words[take], y, np.where(y > 0, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum())).astype(np.float32))
        dx = grad.pop("x")
        grad["word"] = np.zeros_like(p["word"])
        np.add.at(grad["word"], use, dx[:, :WORD_DIM])
        grad["char"] = np.zeros_like(p["char"])
        np.add.at(grad["char"], flat, np.repeat(dx[:, WORD_DIM:] / np.maximum(size, 1)[:, None], size, axis=0))
        rate = RATE * min(1.0, 2 * (1 - step / STEPS))
        for k, g in grad.items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p[k] -= (rate * (m / (1 - 0.9 ** (step + 1)) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-6) + DECAY * p[k])).astype(np.float32)
    return known, p


def _gradient(p: dict[str, np.ndarray], x: np.ndarray, words: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the weighted log loss over windows, for all parameters and for the words' inputs ``x``."""
    n = HIDDEN
    w = words.T
    real = w < len(x)
    gate = gates(p, x)
    (hf, tape_f), (hb, tape_b) = (layer(g[w], real, p[f"state_{s}"], s == "b", True) for s, g in zip("fb", gate))
    h = np.concatenate((hf, hb), axis=2)
    a, pooled = pool(h, real, p["attend"])
    d = (_sigmoid(pooled @ p["out"] + p["bias"][0]) - y) * weight
    grad = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
    dpooled = d[:, None] * p["out"]
    da = np.einsum("bn,tbn->tb", dpooled, h)
    ds = a * (da - (a * da).sum(0))
    grad["attend"] = np.einsum("tb,tbn->n", ds, h)
    dh = a[:, :, None] * dpooled + ds[:, :, None] * p["attend"]
    dx = np.zeros((len(x) + 1, WORD_DIM + CHAR_DIM), np.float32)
    for side, tape, part in (("f", tape_f, dh[:, :, :n]), ("b", tape_b, dh[:, :, n:])):
        dgate, grad[f"state_{side}"] = layer_gradient(tape, part, p[f"state_{side}"])
        per_word = np.zeros((len(x) + 1, 3 * n), np.float32)
        np.add.at(per_word, w, dgate)
        per_word[-1] = 0
        grad[f"in_{side}"], grad[f"gate_{side}"] = x.T @ per_word[:-1], per_word.sum(0)
        dx += per_word @ p[f"in_{side}"].T
    grad["x"] = dx[:-1]
    return grad


def score_texts(texts: list[str], known: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Highest window score of each text."""
    hashes, number, per_text, rows, begin = read_words(texts)
    first, text = windows_of(per_text)
    logits = score_windows(p, *gates(p, word_inputs(p, ids_of(hashes, known), rows, begin)),
                           window_words(first, text, per_text, number, len(hashes)))
    return _sigmoid(np.maximum.reduceat(logits, np.searchsorted(text, np.arange(len(texts)))).astype(np.float64))


def pieces(text: str) -> list[str]:
    """A long text in parts that share the words of a window, cut at spaces where there are any."""
    out, at = [], 0
    while len(text) - at > BLOCK_CHARS:
        end = at + BLOCK_CHARS
        out.append(text[at:end])
        cut = end
        for _ in range(WINDOW):
            cut = text.rfind(" ", at + 1, cut)
            if cut < 0:
                break
        at = cut if cut > at + BLOCK_CHARS // 2 else end
    return [*out, text[at:]]


def predict(docs: DataFrame, known: np.ndarray, p: dict[str, np.ndarray] | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with ``score`` and ``predicted``."""
    model = docs.sparkSession.sparkContext.broadcast((known, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, p = model.value
        for batch in batches:
            parts, owner = [], []
            for i, t in enumerate(batch.column(len(keep)).to_pylist()):
                own = pieces(t or "")
                parts += own
                owner += [i] * len(own)
            scores, lo = np.zeros(batch.num_rows), 0
            while p is not None and lo < len(parts):
                hi, size = lo, 0
                while hi < len(parts) and size < BLOCK_CHARS:
                    size += len(parts[hi]) + 1
                    hi += 1
                np.maximum.at(scores, owner[lo:hi], score_texts(parts[lo:hi], known, p))
                lo = hi
            if p is None:
                scores[:] = 0.5
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(scores),
                                              pa.array((scores >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep, F.col("text")).mapInArrow(run, docs.select(*keep).schema.add("score", "double").add("predicted", "integer"))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray] | None]:
    """The network of a bounded sample: at most SAMPLE_MARKED + SAMPLE_UNMARKED ids are taken from the labels first."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    picked = [bounded_sample(one.where(F.col("_toxic") == k), "doc_id", bound=n) for k, n in ((1, SAMPLE_MARKED), (0, SAMPLE_UNMARKED))]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).join(ids, "doc_id")
            .select("t", F.col("_toxic").cast("int").alias("y"), "doc_id"))
    found = sorted((r.doc_id, r.y, r.t) for r in bounded_sample(rows, "doc_id", "t", bound=SAMPLE_MARKED + SAMPLE_UNMARKED).collect())
    marked = np.array([y == 1 for _, y, _ in found], bool)
    if not marked.any() or marked.all():
        return np.zeros(0, np.uint64), None
    return train([t for _, _, t in found], marked)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document, learned from labels of those whose id's remainder by 3 is not 1."""
    side = remainder(F.col("doc_id"), 3)
    known, p = learn(docs.select("doc_id", "text"), labels.where((side != 1) & (side != -1)))
    return predict(docs.select("doc_id", (side == 1).alias("held_out"), "text"), known, p, ["doc_id", "held_out"])
