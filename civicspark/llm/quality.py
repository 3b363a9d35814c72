"""Operator 3, quality rules with adaptive thresholds.

Native: DataFrame functions only. Every measure of a text is computed inside
its row, without a shuffle. The measures that get an adaptive threshold are
whole numbers, put into buckets of a mergeable quantile sketch: 64 buckets
per power of two (a value is known within 1/64), a count per bucket. Counts
add up, so a sketch of a language is the sum of its sources' sketches. A
group's upper fence is q75 + ``spread`` * (q75 - q25), so it follows each
group's own distribution and does not reject a fixed share; ``LEAST`` guards
the width q75 - q25 of groups that hardly vary. Groups with fewer than
``min_group`` documents take their language's sketch, else that of all
documents. A group's limit is never above its language's, nor, for rates, above
that of all documents: a source that is mostly bad does not clear itself.
Word lengths differ by language and are held against the language only.

Most documents repeat nothing, so the quartiles of the two repetition rates
would be 0 whatever the others do: their sketches (``AMONG``) hold the
documents that repeat something.

Defined results: null text has no words and fails the base rules; null lang
or source is a group of its own; a group of any size is only a few hundred
bucket counts after the map-side sum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import bind, fresh, materialize, q

SPACE = r"[\x20\x09-\x0D]+"
SPREAD, MIN_GROUP = 6, 200
#: Measure -> least width of its quartiles.
LEAST = {"symbol_rate": 10, "dup_line_rate": 10, "repeat_rate": 10, "word_length": 1}
#: Measures sketched among the documents where they are not 0.
AMONG = ("dup_line_rate", "repeat_rate")
#: Measures that are held against all documents too.
RATES = ("symbol_rate", "dup_line_rate", "repeat_rate")


def words_of(text: Column) -> Column:
    """Runs of other characters than ASCII white space, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.
    Windows are sorted with their positions; equal neighbours are repeats;
    the covered words are summed over the gaps between repeat positions."""
    n = F.size(words)
    grams = F.zip_with(
        F.zip_with(words, F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.slice(words, 3, F.greatest(n, F.lit(1))),
        lambda ab, c: F.xxhash64(ab["a"], ab["b"], c))
    hashes = F.slice(grams, 1, F.greatest(n - 2, F.lit(0)))

    def covered(hs: Column) -> Column:
        pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def near(s: Column) -> Column:
            k = F.size(s)
            flag = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < k - 1) & (F.get(s, i + 1)["h"] == x["h"]))
            return F.transform(F.filter(s, flag), lambda x: x["i"])

        def span(pos: Column) -> Column:
            gaps = F.zip_with(F.slice(pos, 2, F.greatest(F.size(pos), F.lit(1))), pos, lambda b, a: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

        return bind(bind(pairs, near), lambda p: span(F.array_sort(p)))

    return bind(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(F.lit(0).cast("long")))


def add_measures(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and base_failed (each name after ``prefix``)."""
    w, lines = fresh(docs, "words", "lines")
    t = F.coalesce(q(text), F.lit(""))
    p = lambda n: f"{prefix}{n}"
    out = docs.withColumn(w, words_of(q(text)))
    out = out.withColumn(lines, F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0))
    out = (out.withColumn(p("n_words"), F.size(w).cast("long"))
           .withColumn(p("word_chars"), F.length(F.array_join(w, "")).cast("long"))
           .withColumn(p("n_symbols"), F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"))
           .withColumn(p("n_dup_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
           .withColumn(p("n_lines"), F.size(lines).cast("long"))
           .withColumn(p("n_repeat_words"), repeated_words(q(w))))
    n, r = q(p("n_words")), q(p("n_repeat_words"))
    return out.drop(w, lines).withColumn(p("base_failed"), (n < 50) | (100 * r > 50 * n))


def rates(prefix: str = "") -> dict[str, Column]:
    """The measures under adaptive thresholds, as whole numbers (per mille;
    word length in tenths of a character)."""
    share = lambda a, b, m: F.expr(f"{m} * `{prefix}{a}` div greatest(`{prefix}{b}`, 1)")
    return {"symbol_rate": share("n_symbols", "word_chars", 1000), "dup_line_rate": share("n_dup_lines", "n_lines", 1000),
            "repeat_rate": share("n_repeat_words", "n_words", 1000), "word_length": share("word_chars", "n_words", 10)}


def bucket(v: Column) -> Column:
    """The lower end of the value's bucket: exact below 128, then 64 buckets
    for each power of two."""
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(v)) - 7, F.lit(0))).cast("long")
    return (v - F.pmod(v, step)).cast("long")


def sketches(measured: DataFrame, lang: str, source: str, prefix: str = "") -> DataFrame:
    """(lang, source, measure, bucket, n): the sketch of each group, of the
    documents that pass the base rules."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in rates(prefix).items()]))
    return (measured.filter(~q(f"{prefix}base_failed"))
            .select(q(lang).alias("lang"), q(source).alias("source"), rows.alias("m"))
            .filter(~F.col("m.measure").isin(*AMONG) | (F.col("m.bucket") > 0))
            .groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("n")))


def fences(cells: DataFrame, keys: list[str], spread: int) -> DataFrame:
    """(*keys, measure, size, fence) from sketch cells summed by ``keys``.
    One partial sum per bucket reaches a group, however large it is."""
    s = cells.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    packed = s.groupBy(*keys, "measure").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("cells"), F.sum("n").alias("size"))

    def quantile(p: int) -> Column:
        run = F.aggregate(
            "cells", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")),
            lambda a, c: F.struct((a["seen"] + c["n"]).alias("seen"),
                                  F.when(a["at"].isNull() & (100 * (a["seen"] + c["n"]) >= p * F.col("size")), c["bucket"]).otherwise(a["at"]).alias("at")))
        return run["at"]

    lo, hi = quantile(25), quantile(75)
    least = reduce(lambda c, kv: c.when(F.col("measure") == kv[0], kv[1]), LEAST.items(), F.when(F.lit(False), 0))
    return packed.select(*keys, "measure", "size", (hi + spread * F.greatest(hi - lo, least)).alias("fence"))


def thresholds(cells: DataFrame, spread: int = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, measure, limit): for each group its own fence, its
    language's or that of all, whichever is the first with enough documents,
    but none above the later ones."""
    own = fences(cells, ["lang", "source"], spread)
    lang = fences(cells, ["lang"], spread).select(F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), F.col("size").alias("l_size"), F.col("fence").alias("l_fence"))
    every = fences(cells, [], spread).select(F.col("measure").alias("e_measure"), F.col("fence").alias("e_fence"))
    enough, l_enough = F.col("size") >= min_group, F.col("l_size") >= min_group
    cap = F.when(F.col("measure").isin(*RATES) | ~l_enough & ~enough, F.col("e_fence"))
    return (own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure")))
            .join(every, F.col("measure") == F.col("e_measure"))
            .select("lang", "source", "measure", F.least(F.when(enough, F.col("fence")), F.when(l_enough, F.col("l_fence")), cap).alias("limit")))


def judge(measured: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "",
          spread: int = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    """``measured`` (from :func:`add_measures`, written or cheap to repeat)
    with ``kept``: false under the base rules or above a fence."""
    limits = thresholds(sketches(measured, lang, source, prefix), spread, min_group)
    a, b, c = fresh(measured, "lang", "source", "limits")
    wide = limits.groupBy(F.col("lang").alias(a), F.col("source").alias(b)).agg(
        F.struct(*[F.max(F.when(F.col("measure") == k, F.col("limit"))).alias(k) for k in LEAST]).alias(c))
    over = reduce(lambda x, y: x | y, [v > F.coalesce(q(c)[k], F.lit(1 << 40)) for k, v in rates(prefix).items()])
    joined = measured.join(wide, q(lang).eqNullSafe(q(a)) & q(source).eqNullSafe(q(b)), "left")
    return joined.withColumn(f"{prefix}kept", ~(q(f"{prefix}base_failed") | over)).drop(a, b, c)


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", prefix: str = "", **limits) -> DataFrame:
    """``docs`` with the measures and ``kept``. The measured rows are written
    once to the shared folder, as the sketches and the filter both read them."""
    return judge(materialize(add_measures(docs, text, prefix), "quality"), lang, source, prefix, **limits)
