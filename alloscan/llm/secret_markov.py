"""Secret scan (DataFrame operations only): fixed patterns, and character Markov models on what they miss.

Two first-order Markov chains over the characters ``+ - / 0-9 = A-Z _ a-z`` are counted from labelled
samples: random strings (secrets that the fixed patterns find, and hashes in usual encodings) and
ordinary identifiers (the other words, alone, joined by ``_ - /`` and in camel case). A token outside the fixed spans is
reported, as kind ``markov``, if the sum of its log-likelihood ratios over its steps reaches a threshold.

Defined cases: a null text is an empty one and has no spans; spans are in code points, end exclusive;
repeated rows get the same result; an empty table gives an empty result. Only ``text`` is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alloscan.llm.common import bounded_sample, constant_array, written


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# fixed values: the base patterns and their least lengths
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(_either(k) for k in KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS, ACCESS_LENGTH = r"AKIA[A-Z0-9]+", 16
HEX, HEX_LENGTH = r"[0-9a-f]+", 32

#: Tokens that the Markov models judge: runs of these characters of at least this length.
TOKEN_CLASS, TOKEN_LENGTH = r"A-Za-z0-9+/_=-", 20
#: Log-likelihood ratio (nats) from which a token counts as random.
THRESHOLD = 15.0
#: The models learn ordinary identifiers from at most so many documents (those with the least hash of their text) ...
SAMPLE_DOCS = 2000
#: ... and random strings from the secrets in them and from so many hashes.
RANDOM_STRINGS = 2000
FIRST, CODES = 43, 80
#: Matches that one inner list gathers, so that a text with n matches costs n * STRIDE and not n * n.
STRIDE = 500


def match_spans(text: str, pattern: str, least: int = 0, group: int = 0) -> Column:
    """Matches of ``pattern`` in the string column ``text`` as array<struct<s, e, m>>, leftmost and non-overlapping.

    The pieces between the matches and the matches themselves add up to the places. Matches whose
    ``group`` is shorter than ``least`` are dropped afterwards, so they still use up their characters.
    """
    p = pattern.replace("\\", "\\\\").replace('"', '\\"').replace("'", "\\'")
    item = "struct<s:bigint,e:bigint,m:string>"
    step = ("named_struct('at', a.at + length(v.p[i]) + length(v.m[i]), 'out', concat(a.out, array(named_struct("
            "'s', a.at + length(v.p[i]), 'e', a.at + length(v.p[i]) + length(v.m[i]), 'm', v.g[i]))))")
    inner = (f"aggregate(sequence(c, least(c + {STRIDE - 1}, size(v.m) - 1)), "
             f"named_struct('at', o.at, 'out', cast(array() as array<{item}>)), (a, i) -> {step})")
    outer = (f"aggregate(sequence(0, size(v.m) - 1, {STRIDE}), named_struct('at', 0L, 'out', cast(array() as array<array<{item}>>)), "
             f"(o, c) -> transform(array({inner}), r -> named_struct('at', r.at, 'out', concat(o.out, array(r.out))))[0], "
             "o -> flatten(o.out))")
    found = (f"transform(array(named_struct('m', regexp_extract_all({text}, '{p}', 0), 'g', regexp_extract_all({text}, '{p}', {group}), "
             f"'p', split({text}, '{p}', -1))), v -> {outer})[0]")
    return F.expr(f"case when {text} rlike '{p}' then filter({found}, x -> length(x.m) >= {least}) "
                  f"else cast(array() as array<{item}>) end")


def _kind(spans: Column, order: int, name: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x.s.alias("s"), F.lit(order).alias("o"), F.lit(name).alias("k"), x.e.alias("e")))


def base_spans(docs: DataFrame, text: str = "_t") -> DataFrame:
    """``docs`` with ``_assign``, ``_access``, ``_hex`` and ``_base``, all of them by start and kind.

    The patterns take whole runs, so a run's least length can be part of the pattern where it has one part.
    """
    return (docs.withColumn("_assign", _kind(match_spans(text, ASSIGN, ASSIGN_VALUE, 2), 0, "assign"))
            .withColumn("_access", _kind(match_spans(text, f"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}"), 1, "access"))
            .withColumn("_hex", _kind(match_spans(text, f"[0-9a-f]{{{HEX_LENGTH},}}"), 2, "hex"))
            .withColumn("_base", F.sort_array(F.concat("_assign", "_access", "_hex"))))


def labelled_samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """``token, random`` of the bounded sample of documents and of hashes in hex, upper hex, base 64 and its URL form."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    sample = bounded_sample(docs.select(t.alias("_t")), "_t", bound=SAMPLE_DOCS)
    base = [f"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}", f"[0-9a-f]{{{HEX_LENGTH},}}"]
    q = lambda p: p.replace("\\", "\\\\").replace('"', '\\"').replace("'", "\\'")
    found = F.concat(*[F.expr(f"regexp_extract_all(_t, '{q(p)}', {g})") for p, g in ((ASSIGN, 2), *((b, 0) for b in base))])
    secrets = sample.select(F.explode(found).alias("token")).where(F.length("token") >= ASSIGN_VALUE)
    rest = F.regexp_replace("_t", "|".join((ASSIGN, *base)), " ")
    words = F.filter(F.split(rest, f"[^{TOKEN_CLASS}]+"), lambda x: F.length(x) >= 2)
    joined = [F.expr(f"transform(sequence(1, greatest(size(w) - 1, 1), 3), i -> array_join(slice(w, i, 2), '{s}'))") for s in "_-/"]
    joined.append(F.expr("transform(sequence(1, greatest(size(w) - 2, 1), 3), i -> array_join(transform(slice(w, i, 3), x -> initcap(x)), ''))"))
    ordinary = (sample.select(words.alias("w")).where(F.size("w") > 0)
                .select(F.explode(F.concat(F.col("w"), *joined)).alias("token")))
    ids = spark.range(RANDOM_STRINGS).select(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256).alias("h"))
    b64 = F.base64(F.unhex("h"))
    hashes = ids.select(F.explode(F.array(F.col("h"), F.upper("h"), b64, F.translate(b64, "+/=", "-_"))).alias("token"))
    return written(secrets.unionByName(hashes).withColumn("random", F.lit(True))
                   .unionByName(ordinary.withColumn("random", F.lit(False))))


def ratio_table(samples: DataFrame) -> DataFrame:
    """One row, ``llr``: the log-likelihood ratio of each step, at ``(from - FIRST) * CODES + to - FIRST``.

    Counts of a step are smoothed by 10 imagined steps that follow the class's own character frequencies.
    """
    steps = (samples.where(F.length("token") >= 2).groupBy("token", "random").count()
             .select("random", "count", F.explode(F.expr("transform(sequence(1, length(token) - 1), i -> substring(token, i, 2))")).alias("ab"))
             .groupBy("random", "ab").agg(F.sum("count").alias("n")))
    a, b = F.ascii("ab") - FIRST, F.ascii(F.substring("ab", 2, 1)) - FIRST
    steps = steps.select("random", "n", a.alias("a"), b.alias("b")).where("a between 0 and 79 and b between 0 and 79")
    grid = samples.sparkSession.range(CODES * CODES).select("id", F.expr(f"cast(id div {CODES} as int)").alias("a"),
                                                             F.expr(f"cast(id % {CODES} as int)").alias("b"))
    for side, flag in (("r", True), ("o", False)):
        own = steps.where(F.col("random") == flag)
        grid = (grid.join(own.select("a", "b", F.col("n").alias(f"{side}_ab")), ["a", "b"], "left")
                .join(own.groupBy("a").agg(F.sum("n").alias(f"{side}_a")), "a", "left")
                .join(own.groupBy("b").agg(F.sum("n").alias(f"{side}_b")), "b", "left")
                .na.fill(0, [f"{side}_ab", f"{side}_a", f"{side}_b"])
                .withColumn(f"{side}_n", F.sum(f"{side}_ab").over(_whole_grid())))
    p = {s: (F.col(f"{s}_ab") + 10 * (F.col(f"{s}_b") + 0.5) / (F.col(f"{s}_n") + 0.5 * CODES)) / (F.col(f"{s}_a") + 10) for s in "ro"}
    return (grid.select("id", (F.log(p["r"]) - F.log(p["o"])).alias("v"))
            .agg(F.expr("transform(sort_array(collect_list(struct(id, v))), x -> x.v)").alias("llr")))


def _whole_grid():
    """A window over the grid, whose CODES * CODES rows are fixed."""
    from pyspark.sql import Window
    return Window.partitionBy(F.lit(0))


def with_spans(docs: DataFrame, text: str = "text", samples: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``secret_spans`` array<struct<s, o, k, e>> by start and kind, and the kinds' arrays ``_assign, _access, _hex, _base``."""
    llr = constant_array(ratio_table(labelled_samples(docs, text) if samples is None else samples).first().llr, "double")

    def ratio(token: Column) -> Column:
        codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - FIRST)
        return F.element_at(F.transform(F.array(codes), lambda v: F.aggregate(
            F.sequence(F.lit(1), F.size(v) - 1), F.lit(0.0),
            lambda acc, i: acc + F.get(llr, F.get(v, i - 1) * CODES + F.get(v, i)))), 1)

    out = base_spans(docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))))
    found = match_spans("_t", f"[{TOKEN_CLASS}]{{{TOKEN_LENGTH},}}")
    out = out.withColumn("_markov", _kind(F.filter(found, lambda x: ratio(x.m) >= THRESHOLD), 3, "markov"))
    free = F.filter("_markov", lambda m: ~F.exists("_base", lambda b: (b.s < m.e) & (m.s < b.e)))
    return out.withColumn("secret_spans", F.sort_array(F.concat("_base", free))).drop("_t", "_markov")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.k, x.s.cast("string"), x.e.cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    out = with_spans(docs.select("doc_id", "text"))
    return out.select("doc_id", F.size("_assign").cast("long").alias("n_assign"), F.size("_access").cast("long").alias("n_access"),
                      F.size("_hex").cast("long").alias("n_hex"), F.sha2(joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
                      joined(F.col("secret_spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; overlapping spans become one mark. All other columns stay as they are."""
    merged = F.aggregate(
        "secret_spans", F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x.s < F.element_at(acc, -1).e),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                                  F.element_at(acc, -1).s.alias("s"), F.greatest(F.element_at(acc, -1).e, x.e).alias("e")))))
        .otherwise(F.concat(acc, F.array(F.struct(x.s.alias("s"), x.e.alias("e"))))))
    parts = F.transform(F.sequence(F.lit(0), F.size("_m")), lambda i: F.substring(
        F.col("body"), (F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_m"), i - 1).e) + 1).cast("int"),
        (F.when(i == F.size("_m"), F.length("body")).otherwise(F.get(F.col("_m"), i).s)
         - F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_m"), i - 1).e)).cast("int")))
    aside = docs.select(F.col(text).alias("body"), F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    out = with_spans(aside, "body").withColumn("_m", merged)
    clean = F.when(F.size("_m") == 0, F.col("body")).otherwise(F.array_join(parts, mark))
    return out.select(*[clean.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])
