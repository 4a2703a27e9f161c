"""Quality rules: base counts per text, then thresholds that follow each language and source.

The counts are DataFrame expressions on one row. Thresholds come from relative-error quantile sketches
(logarithmic buckets with counts): sketches of parts add up to the sketch of the whole, so they are built by
one partial aggregate and merged from (language, source) to language to corpus without reading texts again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pandwerk.llm.common import checkpointed, let, small_side, words

#: Base rule.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

#: Ratio between two bucket borders: quantiles are within 1 % of a value that has the rank.
GAMMA = 1.02
ZERO_BUCKET = -1_000_000

#: signal -> (shares of the two quantiles that span its usual range, the sides with a fence). Most texts have none of
#: what the shares count, so their range ends at a high quantile. A fence lies FENCE times the range beyond its end.
SIGNALS = {"mean_word_length": (0.25, 0.75, ("low", "high")), "symbols_per_word": (0.5, 0.9, ("high",)),
           "dup_line_share": (0.5, 0.9, ("high",)), "repeat_share": (0.5, 0.9, ("high",))}
FENCE = 3.0
SHARES = (0.25, 0.5, 0.75, 0.9)

#: What chance alone moves a signal by in a text of its size; a range counts as this wide at least. Of a share: that
#: many occurrences in this text (ten repeated words are a third of a sentence said twice). Of the mean word length: the
#: standard error, if words spread by 0.6 of their length.
CHANCE_SYMBOLS, CHANCE_LINES, CHANCE_WORDS, WORD_SPREAD = 5.0, 1.0, 10.0, 0.6

#: Documents a wider group counts for when a group's own thresholds are mixed with it.
PRIOR = 200.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_words(w: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: sort the windows, keep those equal to a neighbour,
    then add up the places they cover."""
    def covered(places):
        gap = lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(places, i - 1)))
        return F.aggregate(F.transform(places, gap), F.lit(0), lambda a, x: a + x)

    def twice(windows):
        same = lambda a, b: (a["0"] == b["0"]) & (a["1"] == b["1"]) & (a["2"] == b["2"])
        hit = F.filter(windows, lambda x, i: F.coalesce(same(x, F.get(windows, i - 1)), F.lit(False))
                       | F.coalesce(same(x, F.get(windows, i + 1)), F.lit(False)))
        return let(F.sort_array(F.transform(hit, lambda x: x["3"])), covered)

    size = F.greatest(n - 2, F.lit(0))
    windows = F.sort_array(F.arrays_zip(F.slice(w, 1, size).alias("0"), F.slice(w, 2, size).alias("1"),
                                        F.slice(w, 3, size).alias("2"), F.sequence(F.lit(1), size).alias("3")))
    return F.when(n < 4, F.lit(0)).otherwise(let(windows, twice))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word)."""
    body = F.coalesce(F.col(text), F.lit(""))
    whole = docs.withColumn("_words", words(F.col(text)))
    whole = whole.withColumn("n_words", F.size("_words")).withColumn(
        "_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return whole.withColumns({
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")),
        "n_lines": F.size("_lines"), "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeated_words(F.col("_words"), F.col("n_words")),
    }).drop("_words", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words").cast("long") > MOST_REPEATED_PERCENT * F.col("n_words").cast("long"))


def _signals() -> dict[str, Column]:
    """Null where a text has no words."""
    share = lambda part, of: F.try_divide(F.col(part), F.col(of))
    return {"mean_word_length": share("word_chars", "n_words"), "symbols_per_word": share("n_symbols", "n_words"),
            "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words")}


def _chance() -> dict[str, Column]:
    return {"mean_word_length": F.lit(WORD_SPREAD) * F.try_divide("word_chars", "n_words") / F.sqrt("n_words"),
            "symbols_per_word": F.try_divide(F.lit(CHANCE_SYMBOLS), F.col("n_words")),
            "dup_line_share": F.try_divide(F.lit(CHANCE_LINES), F.col("n_lines")),
            "repeat_share": F.try_divide(F.lit(CHANCE_WORDS), F.col("n_words"))}


def sketch(values: DataFrame, keys: list[str]) -> DataFrame:
    """Quantile sketch of column `value` per `keys`: (keys, bucket, n). Adding `n` merges two sketches."""
    bucket = F.when(F.col("value") <= 0, F.lit(ZERO_BUCKET)).otherwise(
        F.ceil(F.log(F.col("value")) / math.log(GAMMA)).cast("int"))
    return values.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], shares=SHARES) -> DataFrame:
    """(keys, n, q0, q1, ...): the value of the first bucket that holds rank share * n or more. A group has as
    many rows here as buckets (a few hundred), whatever the number of values."""
    group = W.partitionBy(*keys)
    ranked = sketches.select("*", F.sum("n").over(group.orderBy("bucket")).alias("_upto"),
                             F.sum("n").over(group).alias("_all"))
    value = lambda b: F.when(b == ZERO_BUCKET, F.lit(0.0)).otherwise(
        F.pow(F.lit(GAMMA), b) * (2.0 / (1.0 + GAMMA)))
    at = [value(F.min(F.when(F.col("_upto") >= F.col("_all") * s, F.col("bucket")))).alias(f"q{i}")
          for i, s in enumerate(shares)]
    return ranked.groupBy(*keys).agg(F.max("_all").alias("n"), *at)


def thresholds(features: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per language and source: low_<signal>, high_<signal> (ends of the usual range) and spread_<signal>.

    Small groups lean on their language and languages on the corpus: a value is the mean of its own and the
    wider one, weighted by the group's documents and PRIOR.
    """
    names = list(SIGNALS)
    spread = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), v.alias("value"))
                                 for k, v in _signals().items()])).alias("s")
    values = (features.where(~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), spread)
              .select("lang", "source", "s.*"))
    fine = checkpointed(sketch(values, ["lang", "source", "signal"]))

    def end(which):
        return F.coalesce(*[F.when(F.col("signal") == k, F.col(f"q{SHARES.index(SIGNALS[k][which])}")) for k in names])

    def ranges(keys):
        merged = fine.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))
        return quantiles(merged, [*keys, "signal"]).select(
            *keys, "signal", "n", end(0).alias("low"), end(1).alias("high")).withColumn("spread", F.col("high") - F.col("low"))

    found = ("low", "high", "spread")
    corpus = ranges([]).select("signal", *[F.col(c).alias(f"{c}_c") for c in found])
    by_lang = ranges(["lang"]).select(F.col("lang").alias("_lang"), F.col("signal").alias("_signal"), F.col("n").alias("n_l"),
                                      *[F.col(c).alias(f"{c}_l") for c in found])
    mixed = (ranges(["lang", "source"]).join(corpus, "signal")
             .join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("signal") == F.col("_signal"))))

    def lean(c):
        wide = (F.col("n_l") * F.col(f"{c}_l") + PRIOR * F.col(f"{c}_c")) / (F.col("n_l") + PRIOR)
        return (F.col("n") * F.col(c) + PRIOR * wide) / (F.col("n") + PRIOR)

    leaned = mixed.select("lang", "source", "signal", *[lean(c).alias(c) for c in found])
    return leaned.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("signal") == k, F.col(c))).alias(f"{c}_{k}") for k in names for c in found])


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
           carry: tuple[str, ...] | None = None) -> DataFrame:
    """The `carry` columns (default: all), the counts (long), base_failed, kept and `reasons`: the signals that lie
    outside their fences, in order (empty for texts the base rule fails).

    A text fails the base rule with under 50 words or if more than half of its words lie in repeated 3-word
    windows; else it is kept unless a signal lies outside the fences of its language and source. Null and
    empty texts have no words and fail; null languages and sources are groups of their own; repeated rows
    are judged alike; columns of the added names are replaced. Counts are written once; the thresholds are
    joined to them.
    """
    carry = list(docs.columns) if carry is None else list(carry)
    taken = {*COUNTS, "n_lines", "base_failed", "kept", "reasons"}
    kept_columns = [c for c in carry if c.lower() not in taken]
    source_rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept_columns)],
                              F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").alias("_lang_key"),
                              F.col(f"`{source}`").alias("_source_key"))
    features = checkpointed(counted(source_rows, "_text").drop("_text"))
    limits = checkpointed(thresholds(features, "_lang_key", "_source_key"))
    joined = features.join(small_side(limits), F.col("_lang_key").eqNullSafe(F.col("lang"))
                           & F.col("_source_key").eqNullSafe(F.col("source")), "left")
    outside = []
    for k, value in _signals().items():
        reach = FENCE * F.greatest(F.col(f"spread_{k}"), _chance()[k])
        for side in SIGNALS[k][2]:
            off = value < F.col(f"low_{k}") - reach if side == "low" else value > F.col(f"high_{k}") + reach
            outside.append(F.when(off & ~base_failed(), F.lit(k)))
    joined = joined.withColumn("reasons", F.array_compact(F.array(*outside)))
    return joined.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept_columns)],
                         *[F.col(c).cast("long").alias(c) for c in COUNTS], base_failed().alias("base_failed"),
                         (~base_failed() & (F.size("reasons") == 0)).alias("kept"), "reasons")
