"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector. A trigram is bound by multiplying its letters' vectors, the first
rolled by two places, the second by one. A text is the sum of its trigrams' vectors, a language the sum of
its training texts' unit vectors, and a text gets the language whose cosine is highest.

Texts are lower-cased; what is no letter becomes one space, so that word edges are part of the profile.

Defined cases: a null text and one without a letter give ``und`` with score 0, and so does every text if no
text was learned from; ties go to the first language by name; a null id is neither held out nor learned
from; repeated rows are learned from as often as they occur; an empty table gives an empty result. Only
``doc_id``, ``text`` and ``lang`` are read; a prediction reads the text alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloscan.llm.common import mix64, remainder

DIMENSIONS = 1024
#: Characters and texts that are worked on at once; a longer text is added up in parts.
BLOCK_CHARS, BLOCK_TEXTS = 1_000_000, 128
#: Trigrams whose vectors are held at once.
GRAMS = 8192
#: Prototypes are sent to every task, at 4 kB a language; beyond so many languages the query stops with an error.
MAX_LANGUAGES = 5000
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = c
    return out


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """+1/-1 int8 rows, a fixed function of the code points."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    bits = mix64(mix64(points.astype(np.uint64) + np.uint64(0x9E3779B9))[:, None] + words * np.uint64(0x9E3779B97F4A7C15))
    return (np.unpackbits(bits.view(np.uint8).reshape(len(points), -1), axis=1).astype(np.int8) << 1) - 1


def _letter_runs(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points and text numbers: each text lower-cased between two spaces, other characters as one space.

    Several texts come at once, a long one in parts that repeat the last two characters of the part before.
    """
    def collapsed(cp: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = cp == 32
        keep = np.ones(len(cp), bool)
        keep[1:] = ~(space[1:] & space[:-1] & (own[1:] == own[:-1]))
        return cp[keep], own[keep]

    points = lambda t: _letters()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)]
    held, numbers, size = [], [], 0
    for i, text in enumerate(texts):
        if len(text) <= BLOCK_CHARS:
            held.append(f" {text.lower()} ")
            numbers.append(i)
            size += len(text)
        else:
            tail = np.array([32], np.uint32)
            for lo in range(0, len(text), BLOCK_CHARS):
                end = [32] if lo + BLOCK_CHARS >= len(text) else []
                cp = np.concatenate((tail, points(text[lo:lo + BLOCK_CHARS].lower()), end)).astype(np.uint32)
                run = collapsed(cp, np.full(len(cp), i))
                yield run
                tail = run[0][-2:]
        if held and (size >= BLOCK_CHARS or i == len(texts) - 1):
            yield collapsed(points("".join(held)), np.repeat(numbers, [len(t) for t in held]))
            held, numbers, size = [], [], 0


def text_vectors(texts: list[str]) -> np.ndarray:
    """One row per text: the sum of its trigrams' vectors."""
    n = len(texts)
    out = np.zeros((n, DIMENSIONS), np.float32)
    for cp, own in _letter_runs(texts):
        if len(cp) < 3:
            continue
        seen = np.zeros(0x110000, bool)
        seen[cp] = True
        points = np.flatnonzero(seen)
        k = len(points)
        short = np.zeros(0x110000, np.int64)
        short[points] = np.arange(k)
        c = short[cp]
        whole = own[:-2] == own[2:]
        code, row = ((c[:-2] * k + c[1:-1]) * k + c[2:])[whole], own[:-2][whole]
        if k ** 3 <= 1 << 22:
            there = np.zeros(k ** 3, bool)
            there[code] = True
            grams = np.flatnonzero(there)
            place = np.cumsum(there)[code] - 1
        else:
            grams, place = np.unique(code, return_inverse=True)
        last = letter_vectors(points)
        first, middle = np.roll(last, 2, axis=1), np.roll(last, 1, axis=1)
        order = np.argsort(place, kind="stable") if len(grams) > GRAMS else slice(None)
        row, place = row[order], place[order]
        for lo in range(0, len(grams), GRAMS):
            g = grams[lo:lo + GRAMS]
            here = slice(*np.searchsorted(place, (lo, lo + GRAMS))) if len(grams) > GRAMS else slice(None)
            weight = np.bincount(row[here] * len(g) + place[here] - lo, minlength=n * len(g)).reshape(n, len(g)).astype(np.float32)
            out += weight @ (first[g // (k * k)] * middle[g // k % k] * last[g % k]).astype(np.float32)
    return out


def _units(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    return vectors / np.where(size == 0, 1, size)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_TEXTS):
            yield batch.slice(lo, BLOCK_TEXTS)


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in _parts(batches):
        unit = _units(text_vectors(batch.column("text").to_pylist()))
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in set(langs):
            sums[lang] = sums.get(lang, 0) + unit[langs == lang].sum(axis=0)
    for lang, v in sums.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang], "v": [v.tolist()]},
                                         schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name and their unit prototypes, from rows with ``text`` and ``lang``.

    Every task sends one vector a language; the sums are made dimension by dimension.
    """
    parts = rows.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_bundle, "lang string, v array<double>")
    sums = (parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.expr("transform(sort_array(collect_list(struct(d, x))), y -> y.x)").alias("v")))
    found = sums.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found:
        return [], np.zeros((0, DIMENSIONS))
    return [r.lang for r in found], _units(np.array([r.v for r in found]))


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred`` and ``score`` (the cosine, at least 0)."""
    model = docs.sparkSession.sparkContext.broadcast(prototypes.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        for batch in _parts(batches):
            v = _units(text_vectors([t or "" for t in batch.column("_text").to_pylist()]))
            some = v.any(axis=1) & bool(langs)
            cos = v @ p.T if langs else np.zeros((len(v), 1))
            best = cos.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep),
                 pa.array([langs[b] if s else UNKNOWN for b, s in zip(best, some)], pa.string()),
                 pa.array(np.where(some, np.clip(cos[np.arange(len(v)), best], 0, 1), 0.0).astype(np.float64))],
                names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(score, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Language of every document, learned from those whose id's remainder by 4 is not 2."""
    side = remainder(F.col("doc_id"), 4)
    learned = learn(docs.where((side != 2) & (side != -1)))
    return predict(docs.select("doc_id", (side == 2).alias("held_out"), "text"), *learned, ["doc_id", "held_out"])
