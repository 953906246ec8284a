"""Quality rules by host (DataFrame operations only).

Every document is measured by a few countable rules. The failures are counted per host, each host's
rate is shrunk towards the other hosts' by a beta prior fitted to all of them, and hosts whose shrunk
rate is too high are rejected; that verdict goes back to their documents.

Defined cases: a null text has no words and fails the base rule, as an empty one does; a null source
belongs to the host ``''``; repeated rows count as often as they occur and get the same verdict; an
empty table gives an empty result. Other columns of the input pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloscan.llm.common import written

WORD_SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Share of words in repeated three-word windows, of symbols to words, of repeated lines to lines.
MAX_REPEAT_PCT, MAX_SYMBOL_PCT, MAX_DUP_LINE_PCT = 50, 50, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: Mean length of a word.
MEAN_WORD = (2, 20)
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: The beta prior's weight in documents stays in this range, so that neither one odd host nor equal hosts break it.
PRIOR_WEIGHT = (1.0, 1000.0)


def host_of(source: Column) -> Column:
    """Host of a source: scheme, user, port, path and a leading ``www.`` are taken off a URL."""
    return F.coalesce(F.regexp_extract(F.lower(source), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?(?:www\.)?([^/:?#]*)", 1),
                      F.lit(""))


def _repeat_words(w: str) -> Column:
    """Words of the array column ``w`` that lie in a three-word window found twice or more.

    One sort of longs per text: the upper bits hold a window's hash, the lower ones its place, as many
    as the text needs. Equal hashes are neighbours then, and the flagged places, sorted, give the words
    covered. Two different windows of one text pass for equal with probability 2^-44 at a million words.
    """
    windows = f"sequence(0, size({w}) - 3)"
    bits = f"length(bin(size({w})))"
    keys = f"sort_array(transform({windows}, i -> shiftleft(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]), {bits}) | i))"
    same = "shiftrightunsigned(k[j], b) = shiftrightunsigned(k[j {} 1], b)"
    flagged = (f"transform(filter(sequence(0, size(k) - 1), j -> (j > 0 and {same.format('-')}) "
               f"or (j < size(k) - 1 and {same.format('+')})), j -> k[j] & (shiftleft(1L, b) - 1L))")
    covered = ("aggregate({p}, struct(0L as n, -3L as last), (s, x) -> struct(s.n + least(3L, x - s.last) as n, x as last), "
               "s -> s.n)")
    # one-element arrays name a value once, so that it is computed once
    body = (f"transform(array(named_struct('k', {keys}, 'b', {bits})), v -> "
            + covered.format(p=f"sort_array({_on('v', flagged)})") + ")[0]")
    return F.expr(f"case when size({w}) < 3 then 0L else {body} end")


def _on(name: str, body: str) -> str:
    return body.replace("k[", f"{name}.k[").replace("size(k)", f"size({name}.k)").replace(", b)", f", {name}.b)")


def rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of the rules and ``base_failed``; ``_words`` is dropped again."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = (docs.withColumn("_t", t)
           .withColumn("_words", F.filter(F.split("_t", WORD_SPLIT), lambda x: x != ""))
           .withColumn("_lines", lines)
           .withColumn("n_words", F.size("_words").cast("long"))
           .withColumn("word_chars", F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long"))
           .withColumn("n_symbols", (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"))
           .withColumn("n_lines", F.size("_lines").cast("long"))
           .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
           .withColumn("n_repeat_words", _repeat_words("_words")))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))).drop("_t", "_words", "_lines")


def rules_failed() -> Column:
    """Any rule at all, of the counts of ``rule_counts``."""
    n = F.col("n_words")
    return (F.col("base_failed") | (100 * F.col("n_symbols") > MAX_SYMBOL_PCT * n)
            | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("n_lines"))
            | (F.col("word_chars") < MEAN_WORD[0] * n) | (F.col("word_chars") > MEAN_WORD[1] * n))


def host_rates(measured: DataFrame) -> DataFrame:
    """One row per host: documents, failures, and the failure rate under the beta prior of all hosts.

    The prior has the mean of the hosts' rates and the weight m(1 - m)/v - 1 of their variance v.
    """
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"),
                                         F.sum(F.col("failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.struct(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).alias("p")).select("p").scalar()
    weight = F.when(F.col("p.v") > 0, F.greatest(F.lit(PRIOR_WEIGHT[0]), F.least(
        F.lit(PRIOR_WEIGHT[1]), F.col("p.m") * (1 - F.col("p.m")) / F.col("p.v") - 1))).otherwise(F.lit(PRIOR_WEIGHT[1]))
    return (hosts.withColumn("p", prior).withColumn("w", weight)
            .withColumn("host_rate", (F.col("host_failed") + F.col("p.m") * F.col("w")) / (F.col("host_docs") + F.col("w")))
            .drop("p", "w"))


def judge(docs: DataFrame, carry: list[str], text: str = "text", source: str = "source") -> DataFrame:
    """Every row of ``docs`` with the columns ``carry``, its counts, ``host_rate`` and ``kept``.

    The measured rows are written once, because the hosts' rates need all of them before any is judged. The
    hosts are written too, so that Spark knows their size before it moves a document: it broadcasts them if
    they are small and splits a hot one if not.
    """
    measured = written(rule_counts(docs, text).withColumn("host", host_of(F.col(source))).withColumn("failed", rules_failed())
                       .select(*carry, "host", "failed", *COUNTS))
    hosts = written(host_rates(measured).select("host", "host_rate"))
    return (measured.join(hosts, "host")
            .withColumn("kept", ~F.col("failed") & (F.col("host_rate") <= MAX_HOST_RATE)))


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts and whether it is kept."""
    return judge(docs.select("doc_id", "text", "source"), ["doc_id"]).select("doc_id", *COUNTS, "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with its own columns; names that clash with the counts' are set aside meanwhile."""
    aside = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*aside).withColumns({"text": F.col(aside[docs.columns.index("text")]),
                                             "source": F.col(aside[docs.columns.index("source")])})
    return judge(renamed, aside).where("kept").select(*aside).toDF(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
                  coalesce(regexp_extract(lower(source), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?(?:www\.)?([^/:?#]*)', 1), '') AS host
           FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.rid, doc_id, host, len(ws)::BIGINT AS n_words,
             coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (rid) JOIN ln USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 30 * n_lines
             OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS failed FROM b),
h AS (SELECT host, count(*) AS n, sum(failed::INT) AS k FROM f GROUP BY host),
p AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v FROM h),
pw AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, least(1000.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS w FROM p),
hr AS (SELECT host, (k + m * w) / (n + w) AS host_rate FROM h, pw)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT failed AND host_rate <= 0.5 AS kept
FROM f JOIN hr USING (host)
"""
