"""Benchmark decontamination by spaced seeds (DataFrame operations only).

Texts are lower-cased runs of letters and digits. A fixed mask reads six of the tokens below it and
skips the others, so a substitution at a skipped place leaves its hash as it is. Hashes of the items and
of the documents meet in an equi-join; around every hit the item is laid on the document at the hit's
offset and the aligned tokens are compared. A document is contaminated by an item if some window of
n = ``WINDOW`` aligned tokens (the whole item, if it is shorter) has at most n div 5 - 1 substitutions: 3
of 20, 2 of 15 to 19, 1 of 13 or 14. The two masks below hit every such window, so none is lost. An item of
fewer than ``LEAST_MASKED`` tokens must be there word for word; the hash of all its tokens is its one seed.

Defined cases: a null text has no tokens; items without tokens match nothing; repeated rows get the same result;
rows with a null id, documents or items, are judged like others (items of one id give one row); empty tables give
no matches. Only the named columns are read, and ``clean`` returns all columns of its input as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloscan.llm.common import written

#: Places read by each mask, relative to its first token.
MASKS = ((0, 6, 8, 9, 10, 12), (0, 1, 2, 5, 6, 9))
SPAN = max(m[-1] for m in MASKS) + 1
WINDOW = 20
LEAST_MASKED = 13
#: Bits of the bit set for each item seed, and the range of its size: it only saves work, a full one drops no match.
BITS_PER_SEED, SET_BITS = 512, (16, 22)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _seed(hashes: str, number: int, places: tuple[int, ...]) -> str:
    """SQL for the hash of the tokens at ``places`` behind token ``i``; null where they reach beyond the last."""
    read = ", ".join(f"get({hashes}, i + {o})" for o in places)
    return f"if(i + {places[-1]} < size({hashes}), xxhash64({number}, {read}), cast(null as bigint))"


def _short(length: int) -> tuple[int, tuple[int, ...]]:
    """Number and places of the seed of a short item."""
    return 100 + length, tuple(range(length))


def benchmark_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``row, item, item_words`` of the items that have a token; ``row`` tells them apart whatever their ids."""
    return (benchmark.select(F.col(item_id).alias("item"), tokens(F.col(text)).alias("item_words")).where(F.size("item_words") > 0)
            .select(F.monotonically_increasing_id().alias("row"), "item", "item_words"))


def item_seeds(items: DataFrame) -> DataFrame:
    """``h, row, item_at``: one row per item, mask and place; one for a short item."""
    at = items.select("row", F.transform("item_words", lambda w: F.xxhash64(w)).alias("_h")).select(
        "row", "_h", F.explode(F.sequence(F.lit(0), F.size("_h") - 1)).alias("i"))
    masked = " ".join(f"when size(_h) = {n} then if(i = 0, array({_seed('_h', *_short(n))}), array())" for n in range(1, LEAST_MASKED))
    masked = f"case {masked} else array({', '.join(_seed('_h', k, m) for k, m in enumerate(MASKS))}) end"
    return at.select("row", F.col("i").alias("item_at"), F.explode(F.expr(masked)).alias("h")).where("h is not null").select("h", "row", "item_at")


def _bit_test(seeds: DataFrame) -> str:
    """SQL that tells for a hash ``{h}`` whether some seed may have it.

    The set has a fixed range of sizes, so that it can be a constant of the plan for any number of items.
    """
    n = max(1, seeds.count())
    bits = min(SET_BITS[1], max(SET_BITS[0], (BITS_PER_SEED * n - 1).bit_length()))
    rows = seeds.select(F.expr(f"cast(shiftrightunsigned(h, {64 - bits + 6}) as int)").alias("w"),
                        F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))").alias("b"))
    words = [0] * (1 << (bits - 6))
    for r in rows.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        words[r.w] = r.b
    constant = f"cast(split('{','.join(map(str, words))}', ',') as array<bigint>)"
    return (f"getbit({constant}[cast(shiftrightunsigned({{h}}, {64 - bits + 6}) as int)], "
            f"cast(shiftrightunsigned({{h}}, {64 - bits}) & 63 as int)) = 1")


def _best_window() -> Column:
    """Most equal tokens in a window of aligned tokens that lies within ``words``; -1 if none does.

    ``offset`` is the place in ``words`` of the item's first token. A running sum over the item adds the
    token that enters the window and takes off the one that leaves it; places outside ``words`` count -1000.
    """
    equal = ("transform(sequence(0, size(item_words) - 1), j -> case when j + offset < 0 or j + offset >= size(words) then -1000 "
             "when words[j + offset] = item_words[j] then 1 else 0 end)")
    n = f"least({WINDOW}, size(item_words))"
    run = (f"aggregate(sequence(0, size(v) - 1), named_struct('sum', 0, 'best', -1), (a, j) -> "
           f"transform(array(a.sum + v[j] - case when j >= {n} then v[j - {n}] else 0 end), x -> named_struct("
           f"'sum', x, 'best', case when j >= {n} - 1 then greatest(a.best, x) else a.best end))[0], a -> a.best)")
    return F.expr(f"transform(array({equal}), v -> {run})[0]")


def matches(docs: DataFrame, benchmark: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, item, best_equal``: the documents that hold an item, with the most equal tokens of a good window.

    Every place of a document becomes a row only within its task: those whose hashes pass the items' bit set
    go on, with the tokens around them, so verification needs no second look at the documents. Spark
    broadcasts the seeds if their written table is small and joins by hash if it is not.
    """
    items = written(benchmark_items(benchmark))
    seeds = written(item_seeds(items))
    lengths = [r[0] for r in items.where(F.size("item_words") < LEAST_MASKED).select(F.size("item_words")).distinct().collect()]
    kinds = [*enumerate(MASKS), *map(_short, sorted(lengths))]
    before, test = WINDOW - 1, _bit_test(seeds)
    places = (docs.select(*keys, tokens(F.col(text)).alias("_w")).where(F.size("_w") > 0)
              .withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
              .select(*keys, "_w", "_h", F.explode(F.sequence(F.lit(0), F.size("_h") - 1)).alias("i"))
              .select(*keys, "_w", "i", *[F.expr(_seed("_h", *k)).alias(f"_s{n}") for n, k in enumerate(kinds)]))
    likely = [test.format(h=f"_s{n}") for n in range(len(kinds))]
    passed = (places.where(" or ".join(likely))
              .select(*keys, F.least("i", F.lit(before)).alias("at"),
                      F.expr(f"slice(_w, greatest(i - {before}, 0) + 1, least(i, {before}) + {SPAN + before})").alias("words"),
                      F.explode(F.expr(f"array({', '.join(f'if({x}, _s{n}, null)' for n, x in enumerate(likely))})")).alias("h"))
              .where("h is not null"))
    n = F.least(F.lit(WINDOW), F.size("item_words"))
    most = F.when(n < LEAST_MASKED, 0).otherwise(F.floor(n / 5) - 1)
    return (passed.join(seeds, "h").join(items, "row")
            .withColumn("offset", F.col("at") - F.col("item_at"))
            .withColumn("best_equal", _best_window())
            .groupBy(*keys, "item")
            .agg(F.max(F.when(n - F.col("best_equal") <= most, F.col("best_equal"))).cast("long").alias("best_equal"))
            .where(F.col("best_equal").isNotNull()))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per pair of a document and a benchmark item that it holds."""
    return matches(docs, benchmark, ["doc_id"]).withColumnRenamed("item", "item_id").select("doc_id", "item_id", "best_equal")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item; rows meet by id and text, so a shared id does no harm."""
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("th"))
    # written first, so that its size is known before the documents are moved
    bad = written(matches(keyed.select("id", "th", "doc.text"), benchmark, ["id", "th"]).select(F.col("id").alias("bid"), F.col("th").alias("bth")).distinct())
    return (keyed.join(bad, F.col("id").eqNullSafe(F.col("bid")) & (F.col("th") == F.col("bth")), "left_anti")
            .select("doc.*"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT row_number() OVER () AS bid, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS bw FROM benchmark),
bi AS (SELECT bid, item_id, bw, least(20, len(bw)) AS n, CASE WHEN len(bw) < 13 THEN 0 ELSE least(20, len(bw)) // 5 - 1 END AS most FROM b WHERE len(bw) > 0),
dg AS (SELECT rid, i, ws[i:i + 4] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
bg AS (SELECT bid, j, bw[j:j + 4] AS g FROM (SELECT bid, bw, unnest(range(1, len(bw) - 3)) AS j FROM bi WHERE n >= 13)),
ds AS (SELECT rid, i, ws[i:i + l - 1] AS g FROM (SELECT rid, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT n AS l FROM bi WHERE n < 13))),
cand AS (SELECT DISTINCT rid, bid, i - j AS o FROM dg JOIN bg USING (g)
         UNION SELECT rid, bid, i - 1 FROM ds JOIN bi ON ds.g = bi.bw AND bi.n < 13),
al AS (SELECT rid, doc_id, item_id, n, most, [CASE WHEN j + o < 1 OR j + o > len(ws) THEN -1000 WHEN ws[j + o] = bw[j] THEN 1 ELSE 0 END
              FOR j IN range(1, len(bw) + 1)] AS v
       FROM cand JOIN d USING (rid) JOIN bi USING (bid)),
best AS (SELECT doc_id, item_id, n, most, list_max([list_sum(v[s:s + n - 1]) FOR s IN range(1, len(v) - n + 2)]) AS e FROM al)
SELECT doc_id, item_id, max(e)::BIGINT AS best_equal FROM best WHERE n - e <= most GROUP BY doc_id, item_id
"""
