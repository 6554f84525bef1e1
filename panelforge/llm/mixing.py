"""Mixing sources to target weights.

Sizes are summed by source; targets follow the weights up to a cap, the rest
is shared out again until no source is above its cap; each document is then
emitted floor(rate) times, and once more with the probability of the rate's
fraction, by a draw hashed from a seed and its id.

Edge cases: null text has size 0; a null source is a source of its own, after
all others; sources of size 0 get target 0, and their documents, like all of
size 0, are taken at the source's rate (0). Rows that repeat a doc_id draw
alike; null doc_id draws as if it were empty. Very long texts count by their
words; other columns pass through whole, whatever their names; an empty table
gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.llm.common import BROADCAST_ROWS, n_words_of, table, whole_rows, written

WEIGHTS = (5, 2, 1)


def _ranked(sources: DataFrame) -> DataFrame:
    """Add place (from 0) by code point, null last: places inside ranges, plus the rows of the ranges before."""
    parts = written(sources.withColumn("_null", F.col("source").isNull()).repartitionByRange("_null", "source").withColumn("_range", F.spark_partition_id()), "mix-ranges")
    before = parts.groupBy("_range").count()
    before = before.select("_range", (F.sum("count").over(W.orderBy("_range")) - F.col("count")).alias("_before"))  # one row a range
    inside = F.row_number().over(W.partitionBy("_range").orderBy("_null", "source")) - 1
    return parts.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn("place", F.col("_inside") + F.col("_before")).drop("_null", "_range", "_inside", "_before")


def _level(sources: DataFrame, total: float) -> float:
    """The level at which min(level * weight, most) sums up to the total, or the highest cap's.

    Caps are sorted once, in ranges: with all lower caps full, a source's level is
    what is left over the weights from it on; the first that stays under its own
    cap is the level. Sums are running ones inside ranges, plus those of the
    ranges before (one row a range).
    """
    at = F.col("most") / F.col("weight")
    parts = written(sources.withColumn("_at", at).repartitionByRange("_at", "place").withColumn("_range", F.spark_partition_id()), "mix-caps")
    sums = parts.groupBy("_range").agg(F.sum("most").alias("m"), F.sum("weight").alias("w"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("m").over(earlier), F.lit(0.0)).alias("_m"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("_w"))
    inside = W.partitionBy("_range").orderBy("_at", "place").rowsBetween(W.unboundedPreceding, -1)
    full = F.col("_m") + F.coalesce(F.sum("most").over(inside), F.lit(0.0))
    weights = parts.agg(F.sum("weight")).first()[0] or 0
    left = F.lit(weights) - F.col("_w") - F.coalesce(F.sum("weight").over(inside), F.lit(0))
    rows = parts.join(F.broadcast(sums), "_range").withColumn("level", (F.lit(total) - full) / left)
    found = rows.where(F.col("level") <= F.col("_at")).agg(F.min_by("level", F.struct("_at", "place"))).first()[0]
    if found is not None:
        return float(found)
    return float(parts.agg(F.max("_at")).first()[0] or 0.0)  # every source is full


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = _ranked(sources)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", weight), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    most = F.lit(cap) * F.col("source_size")
    level = _level(ranked.select("place", "weight", most.alias("most")), share * total)
    target = F.least(F.lit(level) * F.col("weight"), most)
    return ranked.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, sizes: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """docs (with source, doc_id) plus source_size, target and copies: how often each row is emitted."""
    targets = written(source_targets(sizes, weights, cap, share), "mix-targets")
    side = targets.withColumnRenamed("source", "_source")
    side = F.broadcast(side) if targets.count() <= BROADCAST_ROWS else side.hint("merge")
    out = docs.join(side, F.col("source").eqNullSafe(F.col("_source")))
    copies = F.floor("rate") + (draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return out.withColumn("copies", copies.cast("long")).drop("_source", "rate")


def mixed(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix: rows of docs with its own columns, each as often as it is taken."""
    sizes = written(docs.select("source", n_words_of(F.col("text")).alias("size")), "mix-sizes")
    out = with_copies(whole_rows(docs).select("_row", "_row.doc_id", "_row.source"), sizes, seed, weights)
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies"))).otherwise(F.array().cast("array<long>"))
    return out.withColumn("_copy", F.explode(times)).select("_row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words that the mix takes of it."""
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size")), "mix-sizes")
    out = with_copies(sized, sized)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS k FROM w),
lev AS (SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(3.0 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
lvl AS (SELECT arg_min(level, k) AS level FROM lev WHERE level * weight <= 3.0 * source_size),
t AS (SELECT source, source_size, least(coalesce((SELECT level FROM lvl), 0) * weight, 3.0 * source_size)::DOUBLE AS target FROM w),
q AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
      ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + (u < rate - floor(rate))::INTEGER) * size)::BIGINT AS taken FROM q
"""
