"""Spelling variants: words one edit apart, found by an index of grams of variable length.

Words are maximal runs of letters, A-Z in lower case; of every ``DROP_EVERY``-th run, by a hash of its document and
itself, one letter is taken out. Words of at least ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences are
compared. The *form* of a word is its most frequent neighbour at one inserted, deleted or replaced letter, if that
is ``RATIO`` times as frequent; its *root* is what following the forms leads to.

The gram dictionary holds every gram of ``SHORTEST`` letters and the longer ones, up to ``LONGEST``, whose beginning
is frequent, so that frequent grams are told apart by what follows. A word is decomposed, at each place, into the longest gram
of the dictionary there, unless a gram that begins earlier reaches as far. An edit affects a bounded number of a
word's grams, known for each word; all others come back in any word one edit away, at most one place further. So of
one more of a word's grams than that, at least one is shared: only the lists of the rarest so many are merged, and
what meets there is verified. A word whose grams may all be affected meets others of that kind by its grams of
the shortest length, of which an edit affects two at most.

Defined cases: a null text has no words; a null id counts as an empty one; repeated rows count as often as they
occur; of neighbours with equal counts the first in code-point order is the form; an empty table gives an empty
result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloscan.llm.common import written

#: fixed values: letters of a word, the rule that takes one out, and who is compared
LETTERS = r"A-Za-zÀ-ÿ"
DROP_EVERY, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
SHORTEST, LONGEST = 2, 5
#: A gram is frequent if it occurs more often than this and than 1 / DICTIONARY of all grams of its length, so of
#: each length at most DICTIONARY grams are frequent.
OFTEN, DICTIONARY = 8, 50_000
#: Rounds of doubling that follow any chain of forms: counts grow RATIO-fold, so it has under 2^5 steps.
ROUNDS = 5
EDGES = ("\x02", "\x03")


def occurrences(docs: DataFrame) -> DataFrame:
    """``word, n``: how often each result of at least LEAST_LENGTH letters occurs."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{LEAST_LENGTH},}})"), F.lit(1))
    w = (docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
         .select("id", F.translate("run", upper, upper.lower()).alias("run"))
         .select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % DROP_EVERY == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
                  ).otherwise(F.col("run"))
    return w.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """The grams of SHORTEST to LONGEST letters that are frequent among ``words``, with their counts; at most DICTIONARY of each length."""
    grams = (words.select(F.concat(F.lit(EDGES[0]), "word", F.lit(EDGES[1])).alias("w"))
             .select(F.explode(F.expr(f"flatten(transform(sequence({SHORTEST}, {LONGEST}), q -> "
                                      "transform(sequence(1, length(w) - q + 1), i -> substring(w, i, q))))")).alias("gram")))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > OFTEN)
    letters = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0]
    return {r["gram"]: r["n"] for r in counts.where(F.col("n") * DICTIONARY > letters).collect()}


def decompose(padded: str, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """First and last place of the grams of a word with its edges."""
    out, reach, n = [], -1, len(padded)
    for a in range(n - SHORTEST + 1):
        b = a + SHORTEST
        while b < n and b - a < LONGEST and padded[a:b] in frequent:
            b += 1
        if b - 1 > reach:
            reach = b - 1
            out.append((a, reach))
    return out


def most_affected(grams: list[tuple[int, int]], n: int) -> int:
    """How many of the grams one edit may take away, at most, of a word of ``n`` places with its edges.

    A letter replaced or taken out at i affects the grams that hold it, and those behind it that end before
    i + LONGEST, as a new gram may reach as far; a letter put in before i affects those that hold both its
    neighbours, and those behind it that end before i + LONGEST - 1. A gram that ends before the edit stays.
    """
    loss = [0] * (n + 1)  # by place of an edit of a letter
    gap = [0] * (n + 1)
    for a, b in grams:
        # held, or behind and within reach: b - LONGEST < i <= b
        for i in range(max(1, min(a, b - LONGEST + 1)), b + 1):
            loss[i] += 1
        for i in range(max(1, min(a + 1, b - LONGEST + 2)), b + 1):
            gap[i] += 1
    return max(max(loss[1:n - 1], default=0), max(gap[1:n], default=0))


def _index(frequent: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                rows = []
                for word, n in zip(*(c.to_pylist() for c in batch.columns)):
                    padded = EDGES[0] + word + EDGES[1]
                    grams = decompose(padded, frequent)
                    loss = most_affected(grams, len(padded))
                    sets = [(0, grams, loss)]
                    if loss >= len(grams):
                        sets = [(0, grams, -1), (1, [(a, a + SHORTEST - 1) for a in range(len(padded) - SHORTEST + 1)], SHORTEST)]
                    for kind, own, lost in sets:
                        named = sorted((frequent.get(padded[a:b + 1], 0), a, padded[a:b + 1]) for a, b in own)
                        rows += [(word, n, len(word), kind, gram, at, k <= lost) for k, (_, at, gram) in enumerate(named)]
                columns = list(zip(*rows)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_()))],
                    names=["word", "n", "length", "kind", "gram", "at", "probe"])
    return run


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every pair of ``words`` (word, n) that are one edit apart, both ways."""
    frequent = frequent_grams(words)
    index = written(words.select("word", "n").mapInArrow(
        _index(frequent), "word string, n long, length int, kind int, gram string, at int, probe boolean"))
    probes = (index.where("probe").withColumn("place", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)))
              .select(F.col("word").alias("w"), F.col("n").alias("w_n"), F.col("length").alias("w_length"), "kind", "gram", F.col("at").alias("w_at"),
                      F.col("place").alias("at")))
    i, p = index.select("word", "n", "length", "kind", "gram", "at").alias("i"), probes.alias("p")
    # letters behind the edit move by what the length changes by; the test is part of the join, so that no other pair is a row
    moved, longer = F.col("i.at") - F.col("p.w_at"), F.col("i.length") - F.col("p.w_length")
    met = i.join(p, (F.col("i.kind") == F.col("p.kind")) & (F.col("i.gram") == F.col("p.gram")) & (F.col("i.at") == F.col("p.at"))
                 & (F.abs(longer) <= 1) & ((moved == 0) | (moved == longer)) & (F.col("word") != F.col("w"))
                 & (F.levenshtein("word", "w", 1) == 1))
    pairs = met.select(F.explode(F.array(
        F.struct(F.col("word").alias("word"), F.col("i.n").alias("n"), F.col("w").alias("near"), F.col("w_n").alias("near_n")),
        F.struct(F.col("w").alias("word"), F.col("w_n").alias("n"), F.col("word").alias("near"), F.col("i.n").alias("near_n")))).alias("x"))
    return pairs.select("x.*").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form (word, form), by pointer doubling."""
    now = written(forms.select("word", F.col("form").alias("root")))
    for _ in range(ROUNDS):
        nxt = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = written(now.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            break
    return now


def group(docs: DataFrame) -> DataFrame:
    """Every compared word with its form, root, count, number of neighbours and its form's count."""
    words = written(occurrences(docs).where(F.col("n") >= LEAST_COUNT))
    near = (neighbours(words).groupBy("word", "n")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")))
    fits = -F.col("best.less") >= RATIO * F.col("n")
    near = written(near.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    ends = roots(near.where("form is not null"))
    return (words.join(near, "word", "left").join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
