"""Document statistics as DataFrame expressions (no Python on executors)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import WORD, words_of

#: Derived ratios on which the models learn.
FEATURES = ["n_words", "mean_word_chars", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "distinct_ratio", "words_per_line"]


def with_counts(docs: DataFrame, window: int = 5) -> DataFrame:
    """Add counts over each whole text.

    word_chars, n_symbols, n_dup_lines and n_repeat_words as in the README;
    null text counts as empty. The arrays are projected step by step, so that
    each is computed once. Windows are compared by a 64-bit hash of their
    words; only texts in which a hash recurs are sorted.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    size = lambda c: F.length(c).cast("long")
    df = docs.withColumns({
        "_words": words_of(F.col("text")),
        "_lines": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)),
        "n_symbols": size(t) - size(F.regexp_replace(t, r"[#*$%&|<>]", "")),
        "n_upper": size(t) - size(F.regexp_replace(t, r"\p{Lu}", "")),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": size(F.array_join("_words", "")),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_distinct_words": F.size(F.array_distinct("_words")).cast("long"),
        "_hash": F.when(
            F.size("_words") >= window,
            F.transform(F.sequence(F.lit(0), F.size("_words") - window), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(window)])),
        ).otherwise(F.array().cast("array<long>")),
    })
    df = df.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_hash")) < F.size("_hash"),
            F.sort_array(F.transform("_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    kept = F.filter("_sorted", lambda x, k: F.coalesce(F.when(k > 0, F.get("_sorted", k - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get("_sorted", k + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), F.array_sort(F.transform(kept, lambda x: x["i"]))))
    df = df.withColumn(
        "n_repeat_words",
        F.coalesce(
            F.aggregate(
                F.transform("_starts", lambda s, k: F.least(F.lit(window), F.coalesce(F.get("_starts", k + 1) - s, F.lit(window)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
            F.lit(0).cast("long"),
        ),
    )
    return df.drop("_words", "_lines", "_hash", "_sorted", "_starts")


def with_features(df: DataFrame) -> DataFrame:
    """Ratios of with_counts(), 0 where the denominator is 0."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.withColumns({
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "upper_ratio": ratio("n_upper", "word_chars"),
        "distinct_ratio": ratio("n_distinct_words", "n_words"),
        "words_per_line": ratio("n_words", "n_lines"),
    })
