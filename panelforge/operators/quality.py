"""Checks of price tables; every violation is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.frames import series


def violations(df: DataFrame, max_return: float = 0.3, max_spread: float = 0.5, max_gap: int = 20) -> DataFrame:
    """(code, trade_date, rule) of each broken rule, null prices aside."""
    w = series()
    known = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    low, high = F.least("open", "close"), F.greatest("open", "close")
    any_of = lambda f: f("open") | f("high") | f("low") | f("close")
    rules = {
        "duplicate_date": F.col("trade_date") == F.lag("trade_date").over(w),
        "not_finite": any_of(lambda c: F.coalesce(bad(c), F.lit(False))),
        "not_positive": any_of(lambda c: F.coalesce(F.col(c) <= 0, F.lit(False))),
        "negative_volume": (F.col("volume") < 0) | (F.col("amount") < 0),
        "outside_range": (F.col("low") > low) | (F.col("high") < high),
        "spread": F.try_divide(F.col("high"), F.col("low")) - 1 > max_spread,
        "gap": F.datediff("trade_date", F.lag("trade_date").over(w)) > max_gap,
        "jump": F.abs(F.try_divide(F.col("close"), known) - 1) > max_return,
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    return df.select("code", "trade_date", found.alias("rules")).select("code", "trade_date", F.explode("rules").alias("rule"))


def first_violation(found: DataFrame) -> DataFrame:
    return found.groupBy("code").agg(F.min(F.struct("trade_date", "rule")).alias("v")).select("code", "v.trade_date", "v.rule")


def policy(name: Column) -> Column:
    """Name of the policy that a name's keywords ask for."""
    return F.when(name.rlike("(?i)bond|steel"), "bond").when(name.rlike("(?i)gold|copper|brass|tin"), "commodity").when(name.rlike("(?i)money|cash"), "cash").otherwise("equity")


def inconsistent_ranges(df: DataFrame) -> DataFrame:
    """Codes whose price bases differ in first or last date."""
    r = df.groupBy("code", "adjust").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    n = r.groupBy("code").agg(F.count_distinct("a").alias("starts"), F.count_distinct("b").alias("ends"))
    return n.where("starts > 1 OR ends > 1")


def readiness(df: DataFrame, least: int, max_missing: float) -> DataFrame:
    """Points, largest absolute return, share of the union calendar that is missing, and the verdict."""
    w = series()
    r = df.withColumn("_r", F.abs(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1))
    days = df.agg(F.count_distinct("trade_date").alias("_days"))  # one row
    out = r.groupBy("code").agg(F.count("close").alias("points"), F.max("_r").alias("max_abs_return")).crossJoin(F.broadcast(days))
    out = out.withColumn("missing", 1 - F.col("points") / F.col("_days"))
    return out.withColumn("ready", (F.col("points") >= least) & (F.col("missing") <= max_missing)).drop("_days")


def shared_days(df: DataFrame) -> DataFrame:
    """Days of any code and days of all codes."""
    n = df.agg(F.count_distinct("code").alias("_n"))
    per = df.groupBy("trade_date").agg(F.count_distinct("code").alias("_c")).crossJoin(F.broadcast(n))
    return per.agg(F.count("*").alias("union_days"), F.coalesce(F.sum((F.col("_c") == F.col("_n")).cast("long")), F.lit(0)).alias("common_days"))


def repaired(df: DataFrame, value: str, by: str, far: float) -> DataFrame:
    """value, or `by` where it is missing, not positive or too far from it; fixed marks the rows."""
    bad = F.col(value).isNull() | (F.col(value) <= 0) | F.coalesce(F.abs(F.try_divide(F.col(value), F.col(by)) - 1) > far, F.lit(False))
    return df.withColumn("fixed", bad).withColumn(value, F.when(bad, F.col(by)).otherwise(F.col(value)))


def errors(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """(code, field, n, mae, rmse, max_abs, mape, p95) of a against b on common dates."""
    right = b.select("code", "trade_date", *[F.col(f).alias(f"_{f}") for f in fields])
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("x"), F.col(f"_{f}").alias("y")) for f in fields]))
    long = a.join(right.hint("merge"), ["code", "trade_date"]).select("code", cells.alias("c")).select("code", "c.*").where("x IS NOT NULL AND y IS NOT NULL")
    e, p = F.abs(F.col("x") - F.col("y")), F.when(F.col("y") != 0, F.abs(F.col("x") / F.col("y") - 1))
    return long.groupBy("code", "field").agg(F.count("*").alias("n"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(e).alias("max_abs"), F.avg(p).alias("mape"), F.percentile(p, 0.95).alias("p95"))


def corrected(a: DataFrame, b: DataFrame, field: str, limit: float) -> DataFrame:
    """a with values that differ from b's by more than the limit replaced; was keeps what stood there."""
    right = b.select("code", "trade_date", F.col(field).alias("_y"))
    far = F.abs(F.try_divide(F.col(field), F.col("_y")) - 1) > limit
    out = a.join(right.hint("merge"), ["code", "trade_date"], "left")
    return out.withColumn("was", F.when(far, F.col(field))).withColumn(field, F.when(far, F.col("_y")).otherwise(F.col(field))).drop("_y")
