"""Quality rules: a learned decision list over document statistics.

Sequential covering: rules that reject are grown one threshold at a time by
information gain on two thirds of the labelled rows, pruned on the rest, and
kept while they are precise on that rest, of which they must cover some. Every count that growing and pruning use is
one Spark aggregation over the binned statistics of all labelled rows; the
driver sees a table of at most features x bins x 4 counts. The finished list
is one ordered Spark CASE expression.

Edge cases: null or empty text has zero words and fails the base rule; labels
that are null are left out; without labels the list is empty and the base rule
alone decides; repeated rows are judged one by one; several labels of a
document count as its lowest; columns of documents and labels other than
doc_id, text and quality are not read, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import forget, table, written
from panelforge.llm.text_stats import FEATURES, with_counts, with_features

BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Condition:
    """feature > threshold if above, else feature <= threshold."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    rejects: int
    covered: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def decision_list(rules: list[Rule]) -> Column:
    """True where no rejecting rule fires; the first that fires decides."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), F.lit(False))
    for r in rules[1:]:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def fit(labelled: DataFrame, features: list[str] = FEATURES, bins: int = 32, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.9, min_covered: int = 4) -> list[Rule]:
    """Rules from rows (features, bad boolean); all rows count.

    Thresholds are approximate quantiles of the labelled rows and of the bad rows among them.
    """
    probs = [k / bins for k in range(1, bins)]
    cuts_of = lambda cond: [F.percentile_approx(F.when(cond, F.col(f).cast("double")), probs, 10000).alias(f) for f in features]
    found = [labelled.agg(*cuts_of(F.lit(True))).first(), labelled.agg(*cuts_of(F.col("bad"))).first()]
    cuts = {f: sorted({x for row in found for x in (row[f] or [])}) for f in features}
    part = F.when(F.pmod(F.xxhash64(*[F.col(f) for f in features], F.col("bad")), F.lit(3)) == 0, F.lit(1)).otherwise(F.lit(0))
    binned = written(labelled.select(part.alias("part"), "bad", *features), "rules-fit")
    rules: list[Rule] = []
    rest = F.lit(True)
    try:
        while len(rules) < max_rules:
            rule = _one_rule(binned.where(rest), cuts, max_conditions, min_precision, min_covered)
            if rule is None:
                break
            rules.append(rule)
            rest = rest & ~rule.column()
    finally:
        forget(labelled.sparkSession, binned)
    return rules


def _counts(df: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """For each feature, rows by (bin, part * 2 + bad); bin k holds values above k thresholds."""
    bin_of = lambda f: F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts[f]]), lambda x: x < F.col(f)))
    cells = [F.struct(F.lit(f).alias("f"), bin_of(f).alias("bin")) for f, c in cuts.items() if c]
    if not cells:
        return {}
    long = df.select("part", "bad", F.explode(F.array(*cells)).alias("x"))
    out = {f: [[0] * 4 for _ in range(len(c) + 1)] for f, c in cuts.items()}
    for r in long.groupBy("x.f", "x.bin", "part", "bad").count().collect():  # at most features x bins x 4 rows
        out[r["f"]][r["bin"]][2 * r["part"] + int(r["bad"])] += r["count"]
    return out


def _one_rule(df: DataFrame, cuts: dict[str, list[float]], max_conditions: int, min_precision: float, min_covered: int) -> Rule | None:
    conditions: list[Condition] = []
    steps: list[list[int]] = []
    now = df
    for _ in range(max_conditions):
        counts = _counts(now, cuts)
        full = next(([sum(b[k] for b in bins) for k in range(4)] for f, bins in counts.items() if cuts[f]), None)
        if full is None or full[1] < min_covered:
            break
        base = math.log2(full[1] / (full[0] + full[1]))
        best: tuple[float, Condition, list[int]] | None = None
        for f, bins in counts.items():
            below = [0] * 4
            for k, x in enumerate(cuts[f]):
                below = [a + b for a, b in zip(below, bins[k], strict=True)]
                for above in (True, False):
                    cover = [a - b for a, b in zip(full, below, strict=True)] if above else below
                    if cover[1] < min_covered:
                        continue
                    gain = cover[1] * (math.log2(cover[1] / (cover[0] + cover[1])) - base)
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, Condition(f, above, x), cover
        if best is None or best[0] <= 1e-9:
            break
        conditions.append(best[1])
        steps.append(best[2])
        if best[2][0] == 0:
            break
        now = now.where(best[1].column())
    # prune: the prefix with the best worth on the held part, the shorter one among equals; it must be precise there
    worth = lambda c: (c[3] - c[2]) / max(1, c[2] + c[3])
    if not conditions:
        return None
    k = min(range(len(conditions)), key=lambda k: (-worth(steps[k]), k))
    good, bad = steps[k][2], steps[k][3]
    if not bad or bad < min_precision * (good + bad):
        return None
    return Rule(tuple(conditions[: k + 1]), steps[k][1] + bad, sum(steps[k]))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add base_failed and kept to a frame with statistics."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & decision_list(rules))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Judge every document: statistics, base rule and learned verdict; other columns of docs are not carried."""
    stats = written(with_features(with_counts(docs.select("doc_id", "text"))).drop("text"), "rules-stats")
    marked = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    rules = fit(stats.join(marked.hint("merge"), "doc_id").select("bad", *FEATURES))
    return apply_rules(stats, rules)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every row of documents, by rules learned from all labels."""
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(*BASE, "base_failed", "kept", "symbol_ratio", "upper_ratio", "dup_line_ratio")
