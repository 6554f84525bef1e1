"""Linear recursions as blocked scans: no Python, no row-by-row step.

y[t] = decay[t] * y[t-1] + add[t], y before the first row = 0. Rows are cut
into blocks; inside a block the recursion has a closed form of window sums;
the values at the blocks' ends are carried by folds in two levels: over the
blocks of a run of 64 blocks, and over those runs (a series of a million rows
folds lists of at most 64 and 245 numbers). A decay of zero, or one so small
that a block's product would vanish, begins a block of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.frames import KEYS, series, upto


#: Decays below this begin a block: products of a block's other decays stay above TINY ** 64.
TINY = 1e-4


def linears(df: DataFrame, recursions: dict[str, tuple[Column, Column]], keys: tuple[str, ...] = KEYS, order: str = "trade_date", block: int = 64) -> DataFrame:
    """df plus a scan for each name -> (decay, add), all in one pass; null add counts as 0."""
    n = range(len(recursions))
    w = series(keys, order)
    cells = {f"_d{k}": d.cast("double") for k, (d, _) in enumerate(recursions.values())} | {f"_a{k}": F.coalesce(a, F.lit(0.0)).cast("double") for k, (_, a) in enumerate(recursions.values())}
    df = df.withColumns(cells)
    begins = reduce(lambda x, y: x | y, [F.abs(f"_d{k}") < TINY for k in n])
    df = df.withColumn("_block", F.floor((F.row_number().over(w) - 1) / block) + F.sum(F.when(begins, 1).otherwise(0)).over(upto(w)))
    inner = Window.partitionBy(*keys, "_block").orderBy(order)
    df = df.withColumn("_head", F.row_number().over(inner) == 1)
    # the first row's decay is no divisor: the block's products are taken from the second row on, and it multiplies what is carried in
    df = df.withColumns({f"_p{k}": F.product(F.when(F.col("_head"), 1.0).otherwise(F.col(f"_d{k}"))).over(upto(inner)) for k in n} | {f"_c{k}": F.first(f"_d{k}").over(upto(inner)) for k in n})
    df = df.withColumns({f"_s{k}": F.sum(F.col(f"_a{k}") / F.col(f"_p{k}")).over(upto(inner)) * F.col(f"_p{k}") for k in n} | {f"_p{k}": F.col(f"_p{k}") * F.col(f"_c{k}") for k in n})
    ends = df.groupBy(*keys, "_block").agg(F.max_by(F.struct(*[f"_{c}{k}" for k in n for c in "ps"]), order).alias("_end"))
    blocks = Window.partitionBy(*keys).orderBy("_block")
    ends = ends.withColumn("_run", F.floor((F.row_number().over(blocks) - 1) / 64))
    none = F.struct(*[F.lit(x).alias(f"_{c}{k}") for k in n for c, x in (("p", 1.0), ("s", 0.0))])
    both = lambda acc, e: F.struct(*[x for k in n for x in ((acc[f"_p{k}"] * e[f"_p{k}"]).alias(f"_p{k}"), (acc[f"_s{k}"] * e[f"_p{k}"] + e[f"_s{k}"]).alias(f"_s{k}"))])
    of_run = Window.partitionBy(*keys, "_run").orderBy("_block")
    ends = ends.withColumn("_so_far", F.aggregate(F.collect_list("_end").over(of_run.rowsBetween(Window.unboundedPreceding, -1)), none, both))
    ends = ends.withColumn("_whole", F.when(F.lead("_block").over(of_run).isNull(), both(F.col("_so_far"), F.col("_end"))))  # a run's last block knows the run
    runs = F.collect_list("_whole").over(blocks.rowsBetween(Window.unboundedPreceding, -1))
    start = F.struct(*[F.lit(0.0).alias(f"y{k}") for k in n])
    fold = lambda acc, e: F.struct(*[(acc[f"y{k}"] * e[f"_p{k}"] + e[f"_s{k}"]).alias(f"y{k}") for k in n])
    ends = ends.select(*keys, "_block", fold(F.aggregate(runs, start, fold), F.col("_so_far")).alias("_carry"))
    joined = df.join(ends.hint("merge"), [*keys, "_block"])
    joined = joined.withColumns({out: F.col(f"_p{k}") * F.col(f"_carry.y{k}") + F.col(f"_s{k}") for k, out in enumerate(recursions)})
    return joined.drop("_block", "_head", "_carry", *[f"_{c}{k}" for k in n for c in "dapsc"])


def linear(df: DataFrame, out: str, decay: Column, add: Column, keys: tuple[str, ...] = KEYS, order: str = "trade_date", block: int = 64) -> DataFrame:
    """df plus `out`, the scan of one recursion."""
    return linears(df, {out: (decay, add)}, keys, order, block)


def emas(df: DataFrame, wanted: dict[str, tuple[str, float]], keys: tuple[str, ...] = KEYS, order: str = "trade_date", least: int = 1) -> DataFrame:
    """Exponential means (name -> (x, alpha)) seeded by the first value, in one pass; rows with null x must be filled or dropped before. An alpha of 1 (span 1) is x itself."""
    w = series(keys, order)
    first = F.row_number().over(w) == 1
    plain = {out: F.col(x).cast("double") for out, (x, alpha) in wanted.items() if alpha >= 1}
    scans = {out: (F.lit(1 - alpha), F.when(first, F.col(x)).otherwise(alpha * F.col(x))) for out, (x, alpha) in wanted.items() if out not in plain}
    df = (linears(df, scans, keys, order) if scans else df).withColumns(plain)
    return df.withColumns({out: F.when(F.count(x).over(upto(w)) >= least, F.col(out)) for out, (x, _) in wanted.items()}) if least > 1 else df


def ema(df: DataFrame, out: str, x: str, alpha: float, keys: tuple[str, ...] = KEYS, order: str = "trade_date", least: int = 1) -> DataFrame:
    """One exponential mean."""
    return emas(df, {out: (x, alpha)}, keys, order, least)


def span(n: float) -> float:
    """Smoothing factor of a span."""
    return 2.0 / (n + 1.0)
