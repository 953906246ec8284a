"""SentencePiece encoding and decoding over a given vocabulary.

An Aho-Corasick automaton over the pieces reads a text once. At every position the pieces that end there
come out along its output links, longest first, and relax the best score up to that position, so that
encoding is one Viterbi pass. A character that no one-character piece covers costs the least score less
``UNKNOWN_PENALTY`` and is written as its UTF-8 bytes. On equal scores the longer last piece wins.

Pieces hold the word mark only at their start, so the best way through a text is the best way through each
run ``marks, other characters`` of it; runs that come back in a task are looked up.

Defined cases: a null text is an empty one and has no ids; a text that itself holds the mark U+2581 comes
back with a space in its place, and ``round_trip`` is false for it; repeated rows get the same result; an
empty table gives an empty result. Columns other than the text are passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Vocabulary file; a file of the same kind can be named instead.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# fixed value: what an uncovered character costs below the least score
UNKNOWN_PENALTY = 10.0
#: Runs up to this length are kept, at most so many at a time.
KEPT_LENGTH, KEPT_RUNS = 48, 600_000
ROWS = 256


class Codec:
    """``pieces``: (piece, score, kind) by id, of kinds ``piece``, ``byte`` and ``other``."""

    def __init__(self, pieces: tuple[tuple[str, float, str], ...]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        self.single, self.bytes_of, self.byte_ids = set(), [], {}
        least = 0.0
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == "piece":
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"the piece {piece!r} has the word mark behind a character")
                self.automaton.add_word(piece, (i, score, len(piece)))
                least = min(least, score)
                if len(piece) == 1:
                    self.single.add(piece)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
            elif kind == "byte":
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes_of.append(b"")
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.automaton.make_automaton()
        self.unknown = least - UNKNOWN_PENALTY
        self.runs: dict[str, bytes] = {}

    def run(self, text: str) -> list[int]:
        """Ids of one run, by the Viterbi pass."""
        ends: list[list[tuple[int, float, int]]] = [[] for _ in text]
        for end, found in self.automaton.iter(text):
            ends[end].append(found)
        best, back = [0.0], []
        for i, found in enumerate(ends):
            top, way = float("-inf"), None
            for piece in found:
                s = best[i + 1 - piece[2]] + piece[1]
                if s > top:
                    top, way = s, piece
            if text[i] not in self.single and best[i] + self.unknown > top:
                top, way = best[i] + self.unknown, None
            best.append(top)
            back.append(way)
        out, at = [], len(text)
        while at:
            way = back[at - 1]
            if way is None:
                out.extend(self.byte_ids[b] for b in reversed(text[at - 1].encode()))
                at -= 1
            else:
                out.append(way[0])
                at -= way[2]
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        parts, runs = [], self.runs
        for run in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)):
            ids = runs.get(run)
            if ids is None:
                ids = np.array(self.run(run), np.int32).tobytes()
                if len(run) <= KEPT_LENGTH:
                    if len(runs) >= KEPT_RUNS:
                        runs.clear()
                    runs[run] = ids
            parts.append(ids)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; the space that encoding puts first is taken off, bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


_codecs: dict[int, Codec] = {}


def load(path: str = MODEL) -> tuple[tuple[str, float, str], ...]:
    """Pieces of a vocabulary file whose normalizer changes nothing but spaces."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "a  Bé\n ć "
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError(f"{path} normalizes texts in another way")
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece"
    return tuple((sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size()))


def _shared(spark: SparkSession, path: str):
    """The pieces, read by the driver and sent to the tasks; a vocabulary is a file of fixed size."""
    return spark.sparkContext.broadcast(load(path))


def _of(shared) -> Codec:
    """The codec of a task's worker, built once for each vocabulary that it meets."""
    pieces = shared.value
    key = hash(pieces)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(pieces)
    return _codecs[key]


def encode(docs: DataFrame, text: str = "text", path: str = MODEL) -> DataFrame:
    """``docs`` without ``text``, with ``ids`` array<int>, ``n_tokens`` and ``round_trip`` (decoding gives the text)."""
    keep = [c for c in docs.columns if c != text]
    shared = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _of(shared)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
                ids = [codec.encode(t) for t in texts]
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()),
                                                pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
                same = [codec.decode(x) == t for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), flat, pa.array(sizes), pa.array(same, pa.bool_())],
                                                 names=[*keep, "ids", "n_tokens", "round_trip"])

    schema = docs.select(*keep).schema.add("ids", ArrayType(IntegerType())).add("n_tokens", "long").add("round_trip", "boolean")
    return docs.select(*keep, F.col(text)).mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", path: str = MODEL) -> DataFrame:
    """``encoded`` with ``text`` in place of ``ids``; null ids give an empty text."""
    keep = [c for c in encoded.columns if c != ids]
    shared = _shared(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _of(shared)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], np.int32)) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    return encoded.select(*keep, F.col(ids)).mapInArrow(run, encoded.select(*keep).schema.add("text", "string"))
