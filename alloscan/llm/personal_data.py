"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF on top, in NumPy.

The network tags every character of a window as outside, begin or inside of an e-mail address, IP address,
card number or phone number. It learns from labelled spans: those that the fixed patterns find in a
bounded sample of documents, some of them rewritten the way people write them too (blanks around the
``@``, a phone number without its ``+``). Overlapping windows are decoded by Viterbi; each character then
takes the tag of the window that holds it nearest its middle, and spans are read off the whole text.

A span of the network is added if it overlaps no span of the patterns and passes a check of its kind: the patterns'
check of its digits; an e-mail address must touch a name, a mark (``@``, ``(at)``, ``[at]``) and a host with a dot, and
takes their borders. What passes holds a digit or a mark, so windows that have none, nor one within a window's length, are not run.

Defined cases: a null text is an empty one and has no spans; if the sample has no span, the patterns work
alone; spans are in code points, end exclusive; repeated rows get the same result; an empty table gives an
empty result. Only ``text`` is read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloscan.llm.common import bounded_sample, code_points

KINDS = ("email", "ip", "card", "phone")
#: Texts with a digit or ``@`` that are learned from, at most.
SAMPLE_DOCS = 3000
WINDOW, STRIDE = 64, 32
CHARACTERS, CHAR_DIM, HIDDEN = 131, 12, 16
TAGS = 1 + 2 * len(KINDS)
STEPS, BATCH, RATE = 420, 48, 0.01
#: Share of the labelled spans that are shown rewritten.
REWRITTEN = 0.3
#: Windows of a text that are learned from wherever they lie.
PLAIN_WINDOWS = 4
WINDOWS_AT_ONCE = 2048
SEED = 11

# fixed values: the base patterns, in a form that reads a text once
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


#: fixed values: what the network may add as an address, and the marks in it
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]*[A-Za-z0-9] ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.I)
_EVIDENCE = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I)


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def card_number(text: str) -> bool:
    d = _digits(text)
    if not 12 <= len(d) <= 19:
        return False
    twice = [2 * x - 9 * (x > 4) for x in d[-2::-2]]
    return (sum(d[-1::-2]) + sum(twice)) % 10 == 0


def ip_address(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), in order."""
    out, at = [], 0
    k = text.find("@")
    while k >= 0:
        start = k
        while start > at and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, k + 1) if start < k else None
        if m:
            out.append((start, 0, m.end()))
            at = m.end()
        k = text.find("@", max(at, k + 1))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if ip_address(m[0])]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if card_number(m[0])]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def character_rows(cp: np.ndarray) -> np.ndarray:
    """Input row of each character: its code below 128, other letters 128, the rest 129; 130 is padding."""
    other = np.where((cp >= 0xC0) & (cp < 0x3000), 128, 129)
    return np.where(cp < 128, cp, other).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    n = HIDDEN
    p = {"char": rng.normal(0, 0.3, (CHARACTERS, CHAR_DIM)), "out": rng.normal(0, 0.2, (2 * n, TAGS)), "bias": np.zeros(TAGS),
         "step": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
    for s in "fb":
        gate = np.zeros(4 * n)
        gate[n:2 * n] = 1
        p |= {f"in_{s}": rng.normal(0, CHAR_DIM ** -0.5, (CHAR_DIM, 4 * n)), f"state_{s}": rng.normal(0, n ** -0.5, (n, 4 * n)), f"gate_{s}": gate}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _forbidden() -> np.ndarray:
    """Steps into an inside tag from anything but its own kind; tag 1 + 2k begins kind k, 2 + 2k goes on."""
    f = np.zeros((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        f[:, 2 + 2 * k] = True
        f[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = False
    return f


_FORBIDDEN = _forbidden()
_NO_START = np.array([t > 0 and t % 2 == 0 for t in range(TAGS)])


def steps_of(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Step scores and first scores; a window may begin inside a span, at a price."""
    return np.where(_FORBIDDEN, -1e4, p["step"]).astype(np.float32), (p["start"] - 2.0 * _NO_START).astype(np.float32)


def lstm(x: np.ndarray, state: np.ndarray, back: bool, keep: bool = False):
    """Outputs of one direction over (time, windows, 4 x HIDDEN) gate inputs."""
    n = HIDDEN
    h = c = np.zeros((x.shape[1], n), np.float32)
    out, tape = np.empty((*x.shape[:2], n), np.float32), []
    for t in range(len(x))[::-1 if back else 1]:
        a = x[t] + h @ state
        s = _sigmoid(a[:, :3 * n])
        i, f, o, g = s[:, :n], s[:, n:2 * n], s[:, 2 * n:], np.tanh(a[:, 3 * n:])
        new = f * c + i * g
        tc = np.tanh(new)
        if keep:
            tape.append((t, h, c, i, f, o, g, tc))
        c, h = new, o * tc
        out[t] = h
    return (out, tape) if keep else out


def lstm_gradient(tape: list, dout: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = HIDDEN
    dx, dstate, dh, dc = np.zeros((*dout.shape[:2], 4 * n), np.float32), np.zeros_like(state), 0, 0
    for t, h, c, i, f, o, g, tc in reversed(tape):
        d = dh + dout[t]
        dc = dc + d * o * (1 - tc * tc)
        da = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
        dx[t] = da
        dstate += h.T @ da
        dh, dc = da @ state.T, dc * f
    return dx, dstate


def emissions(p: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Tag scores (time, windows, tags) of character rows (windows, time)."""
    h = [lstm((p["char"] @ p[f"in_{s}"] + p[f"gate_{s}"])[rows.T], p[f"state_{s}"], s == "b") for s in "fb"]
    return np.concatenate(h, axis=2) @ p["out"] + p["bias"]


def viterbi(p: dict[str, np.ndarray], e: np.ndarray) -> np.ndarray:
    """Best tags (windows, time)."""
    step, first = steps_of(p)
    best, back = first + e[0], []
    for t in range(1, len(e)):
        s = best[:, :, None] + step
        back.append(s.argmax(1))
        best = s.max(1) + e[t]
    tags = np.empty((e.shape[1], len(e)), np.int64)
    tags[:, -1] = best.argmax(1)
    for t in range(len(e) - 2, -1, -1):
        tags[:, t] = np.take_along_axis(back[t], tags[:, t + 1, None], 1)[:, 0]
    return tags


def may_hold_a_span(p: dict[str, np.ndarray], e: np.ndarray) -> np.ndarray:
    """Which windows can have a best path that is not outside throughout, by a bound with one tag for all others."""
    step, first = steps_of(p)
    gain = e[:, :, 1]
    for k in range(2, TAGS):
        gain = np.maximum(gain, e[:, :, k])
    gain = gain - e[:, :, 0]
    into, on, back = (x.max() - step[0, 0] for x in (step[0, 1:], step[1:, 1:], step[1:, 0]))
    outside, within = np.zeros(e.shape[1], np.float32), first[1:].max() - first[0] + gain[0]
    for g in gain[1:]:
        outside, within = np.maximum(outside, within + back), np.maximum(outside + into, within + on) + g
    return np.maximum(outside, within) > 0


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def crf_gradient(p: dict[str, np.ndarray], e: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the mean negative log-likelihood for emissions, steps and first scores."""
    step, first = steps_of(p)
    T, B, _ = e.shape
    ahead, after = np.empty_like(e), np.zeros_like(e)
    ahead[0] = first + e[0]
    for t in range(1, T):
        ahead[t] = _log_sum(ahead[t - 1][:, :, None] + step, 1) + e[t]
    for t in range(T - 2, -1, -1):
        after[t] = _log_sum(step + (e[t + 1] + after[t + 1])[:, None, :], 2)
    total = _log_sum(ahead[-1], 1)
    de = np.exp(ahead + after - total[:, None])
    pair = np.exp(ahead[:-1, :, :, None] + step + (e[1:] + after[1:])[:, :, None, :] - total[:, None, None]).sum((0, 1))
    w = np.arange(B)
    for t in range(T):
        de[t, w, gold[:, t]] -= 1
    np.subtract.at(pair, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    return de / B, np.where(_FORBIDDEN, 0, pair) / B, de[0].sum(0) / B


def rewritten(text: str, kind: int, rng: np.random.Generator) -> str:
    if kind == 0:
        return text.replace("@", (" @ ", " (at) ", " [at] ")[rng.integers(3)], 1)
    if kind == 3:
        return text[1:] if rng.random() < 0.7 else "00" + text[1:]
    return text


def examples(texts: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Character rows and tags of windows at random offsets around digits, ``@`` and spans of the texts, and at some other places."""
    rows, tags = [], []
    for text in texts:
        parts, marks, at = [], [], 0
        for start, kind, end in base_spans(text):
            if start < at:
                continue
            shown = text[start:end]
            if rng.random() < REWRITTEN:
                shown = rewritten(shown, kind, rng)
            parts += [text[at:start], shown]
            marks += [np.zeros(start - at, np.int64), np.concatenate(([1 + 2 * kind], np.full(len(shown) - 1, 2 + 2 * kind)))]
            at = end
        parts.append(text[at:])
        marks.append(np.zeros(len(text) - at, np.int64))
        r, g = character_rows(code_points("".join(parts))), np.concatenate(marks)
        spots = np.flatnonzero(((r >= 48) & (r < 58)) | (r == 64) | (g % 2 == 1))
        near = spots[np.concatenate(([True], np.diff(spots) > WINDOW // 2))] if len(spots) else spots
        for spot in (*near[:20], *rng.integers(len(r), size=PLAIN_WINDOWS if len(r) else 0)):
            lo = max(0, spot - int(rng.integers(WINDOW)))
            cut = slice(lo, lo + WINDOW)
            pad = WINDOW - len(r[cut])
            rows.append(np.concatenate((r[cut], np.full(pad, CHARACTERS - 1))))
            tags.append(np.concatenate((g[cut], np.zeros(pad, np.int64))))
    shape = (len(rows), WINDOW)
    return np.array(rows, np.int64).reshape(shape), np.array(tags, np.int64).reshape(shape)


def train(texts: list[str]) -> dict[str, np.ndarray] | None:
    """Parameters, after a fixed number of steps; none if no text has a span."""
    rng = np.random.default_rng(SEED)
    rows, gold = examples(texts, rng)
    sides = [s for s in (np.flatnonzero((gold > 0).any(1)), np.flatnonzero(~(gold > 0).any(1))) if len(s)]
    if not (gold > 0).any():
        return None
    p, n = fresh(rng), HIDDEN
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    for step in range(STEPS):
        pick = np.concatenate([rng.choice(s, BATCH // len(sides)) for s in sides])
        x, y = rows[pick], gold[pick]
        hidden = [lstm((p["char"] @ p[f"in_{s}"] + p[f"gate_{s}"])[x.T], p[f"state_{s}"], s == "b", True) for s in "fb"]
        h = np.concatenate([a for a, _ in hidden], axis=2)
        de, dstep, dstart = crf_gradient(p, h @ p["out"] + p["bias"], y)
        grad = {"step": dstep, "start": dstart, "out": np.einsum("tbn,tbk->nk", h, de), "bias": de.sum((0, 1))}
        dh = de @ p["out"].T
        dchar = np.zeros_like(p["char"])
        for s, (_, tape), part in zip("fb", hidden, (dh[:, :, :n], dh[:, :, n:])):
            dx, grad[f"state_{s}"] = lstm_gradient(tape, part, p[f"state_{s}"])
            per_char = np.zeros((CHARACTERS, 4 * n), np.float32)
            np.add.at(per_char, x.T, dx)
            grad[f"in_{s}"], grad[f"gate_{s}"] = p["char"].T @ per_char, per_char.sum(0)
            dchar += per_char @ p[f"in_{s}"].T
        grad["char"] = dchar
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * min(1.0, 2 * (1 - step / STEPS)) * min(1.0, 5 / (size + 1e-9))
        for k, g in grad.items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p[k] -= (rate * m / (1 - 0.9 ** (step + 1)) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-6)).astype(np.float32)
    return p


def evidence(r: np.ndarray) -> np.ndarray:
    """Which characters (rows of the input table) are a digit, an ``@`` or the first of another mark."""
    out = ((r >= 48) & (r < 58)) | (r == 64)
    if len(r) > 3:
        low = r | 32  # as the letters in lower case; brackets are compared as they are
        out[:-3] |= ((r[:-3] == 40) | (r[:-3] == 91)) & (low[1:-2] == 97) & (low[2:-1] == 116) & ((r[3:] == 41) | (r[3:] == 93))
    return out


def network_spans(texts: list[str], p: dict[str, np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Spans of each text by the network alone, before any check."""
    windows, places, out = [np.zeros((0, WINDOW), np.uint8)], [], [[] for _ in texts]
    for i, text in enumerate(texts):
        if not _EVIDENCE.search(text):
            continue
        r = character_rows(code_points(text))
        last = max(0, -(-(len(r) - WINDOW) // STRIDE))
        padded = np.full(last * STRIDE + WINDOW, CHARACTERS - 1, np.uint8)
        padded[:len(r)] = r
        first = np.arange(last + 1) * STRIDE
        seen = np.concatenate(([0], np.cumsum(evidence(r))))
        run = np.flatnonzero(seen[np.minimum(first + 2 * WINDOW, len(r))] > seen[np.maximum(first - WINDOW, 0)])
        windows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE][run])
        places += [(i, k, k == 0, k == last, min(WINDOW, len(r) - k * STRIDE)) for k in run.tolist()]
    rows = np.concatenate(windows)
    tags = np.zeros(rows.shape, np.int8)
    for lo in range(0, len(rows), WINDOWS_AT_ONCE):
        e = emissions(p, rows[lo:lo + WINDOWS_AT_ONCE])
        likely = np.flatnonzero(may_hold_a_span(p, e))
        if len(likely):
            tags[lo + likely] = viterbi(p, e[:, likely])
    edge = (WINDOW - STRIDE) // 2
    i_open, open_span = -1, None
    for w in np.flatnonzero(tags.any(1)):
        (i, k, head, tail, size), row = places[w], tags[w]
        lo, hi = 0 if head else edge, size if tail else edge + STRIDE
        if i != i_open:
            i_open, open_span = i, None
        for j in range(lo, hi):
            t = int(row[j])
            if t == 0:
                continue
            kind, at = (t - 1) // 2, k * STRIDE + j
            if open_span and open_span[1] == kind and open_span[2] == at and t % 2 == 0:
                open_span[2] = at + 1
            else:
                open_span = [at, kind, at + 1]
                out[i].append(open_span)
    return [[tuple(s) for s in spans] for spans in out]


def all_spans(texts: list[str], p: dict[str, np.ndarray] | None) -> list[tuple[list, list]]:
    """For each text the patterns' spans, and those with what the network adds."""
    likely = [i for i, t in enumerate(texts) if re.search("[0-9@]", t)]
    base = {i: base_spans(texts[i]) for i in likely}
    found = network_spans(texts, p) if p is not None else [[]] * len(texts)
    out = []
    for i, text in enumerate(texts):
        own, added = base.get(i, []), set()
        for start, kind, end in found[i]:
            part = text[start:end]
            start, end = start + len(part) - len(part.lstrip()), end - len(part) + len(part.rstrip())
            if kind == 0:
                near = _ADDRESS.finditer(text, max(0, start - WINDOW), end + WINDOW)
                start, end = next((m.span() for m in near if m.start() < end and start < m.end()), (start, start))
            part = text[start:end]
            if not part or any(s < end and start < e for s, _, e in own):
                continue
            if kind == 1 and not ip_address(part) or kind == 2 and not card_number(part) or kind == 3 and not 9 <= len(_digits(part)) <= 15:
                continue
            if kind == 3 and (text[max(0, start - 2):start].strip()[-1:].isdigit() or text[end:end + 2].strip()[:1].isdigit()):
                continue  # a part of a longer run of numbers
            added.add((start, kind, end))
        out.append((own, sorted([*own, *added])))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def learn(docs: DataFrame) -> dict[str, np.ndarray] | None:
    rows = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    return train(sorted(r.text for r in bounded_sample(rows, "text", bound=SAMPLE_DOCS).collect()))


def find(docs: DataFrame, p: dict[str, np.ndarray] | None, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the counts and digest of the patterns' spans and ``spans``, all of them."""
    keep = [c for c in docs.columns if c != text]
    model = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                found = all_spans([t or "" for t in batch.column(len(keep)).to_pylist()], model.value)
                counts = [pa.array([sum(k == kind for _, k, _ in own) for own, _ in found], pa.int64()) for kind in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(keep))), *counts,
                     pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own, _ in found], pa.string()),
                     pa.array([joined(every) for _, every in found], pa.string())],
                    names=[*keep, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = docs.select(*keep).schema
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    return docs.select(*keep, F.col(text)).mapInArrow(run, schema.add("base_sha256", "string").add("spans", "string"))


def scan(docs: DataFrame) -> DataFrame:
    """Personal data of every document, with a network learned from a sample of the same documents."""
    return find(docs.select("doc_id", "text"), learn(docs))
