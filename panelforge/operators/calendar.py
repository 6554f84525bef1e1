"""Rebalance calendars, as-of alignment and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.frames import series, upto

ANCHORS = ("MON", "TUE", "WED", "THU", "FRI")
#: The most sessions that are broadcast, after having been counted.
MOST_DAYS = 100_000


def label(d: str, period: str, anchor: str = "FRI") -> Column:
    """The period of a day: D, W (ends on the anchor), M, Q or Y."""
    if period == "D":
        return F.col(d)
    if period == "W":
        return F.next_day(F.date_sub(d, 1), anchor)
    return F.trunc(d, {"M": "month", "Q": "quarter", "Y": "year"}[period])


def sessions(df: DataFrame) -> DataFrame:
    return df.select("trade_date").distinct()


def period_ends(days: DataFrame, period: str, anchor: str = "FRI") -> DataFrame:
    """Last session of each period."""
    return days.groupBy(label("trade_date", period, anchor).alias("label")).agg(F.max("trade_date").alias("decision_date"))


def nth_session(days: DataFrame, period: str, n: int) -> DataFrame:
    """The n-th session of each period, its last where it has fewer."""
    w = Window.partitionBy("label")
    rows = days.withColumn("label", label("trade_date", period)).withColumn("k", F.row_number().over(w.orderBy("trade_date"))).withColumn("n", F.count("*").over(w))
    return rows.where(F.col("k") == F.least(F.lit(n), F.col("n"))).select("label", F.col("trade_date").alias("decision_date"))


def snapped(targets: DataFrame, days: DataFrame, how: str, target: str = "target_date") -> DataFrame:
    """Targets with their session: prev, next, or skip (only exact ones). hit: exact, prev or next."""
    if how == "skip":
        return targets.join(days.hint("merge"), targets[target] == days.trade_date, "left_semi").withColumn("session", F.col(target)).withColumn("hit", F.lit("exact"))
    rows = days.select(F.col("trade_date").alias("_d"), F.lit(None).cast("date").alias("_t")).union(targets.select(F.col(target), F.col(target)).distinct())
    month = F.trunc("_d", "year")  # sessions are looked for inside years and, by the years' ends, across them
    rows = rows.withColumn("_p", month).withColumn("_s", F.when(F.col("_t").isNull(), F.col("_d")))
    edge = rows.groupBy("_p").agg(F.min("_s").alias("_first"), F.max("_s").alias("_last"))
    years = Window.orderBy("_p")  # one row a year
    edge = edge.select("_p", F.last("_last", True).over(years.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev"), F.first("_first", True).over(years.rowsBetween(1, Window.unboundedFollowing)).alias("_next"))
    w = Window.partitionBy("_p").orderBy("_d").rangeBetween(Window.unboundedPreceding, 0)
    v = Window.partitionBy("_p").orderBy("_d").rangeBetween(0, Window.unboundedFollowing)
    side = F.max("_s").over(w) if how == "prev" else F.min("_s").over(v)
    got = rows.withColumn("_got", side).where("_t IS NOT NULL").join(F.broadcast(edge), "_p").select(F.col("_t").alias(target), F.coalesce("_got", "_prev" if how == "prev" else "_next").alias("session")).distinct()
    hit = F.when(F.col("session") == F.col(target), "exact").when(F.col("session") < F.col(target), "prev").otherwise("next")
    return targets.join(got.hint("merge"), target).where("session IS NOT NULL").withColumn("hit", hit)


def month_anchor(days: DataFrame, day: int) -> DataFrame:
    """A day of each month: from its start, or from its end if negative."""
    m = F.trunc("trade_date", "month")
    target = F.date_add(m, day - 1) if day > 0 else F.date_add(F.last_day(m), day + 1)
    return days.select(target.alias("target_date")).distinct()


def as_of(left: DataFrame, right: DataFrame, value: str, keys: list[str], order: str = "trade_date") -> DataFrame:
    """Left rows with the last right value on or before their date, and its date: one union, one sort."""
    l = left.withColumn("_side", F.lit(1))
    r = right.where(F.col(value).isNotNull()).select(*keys, order, F.col(value).alias("_v"), F.col(order).alias("_vd"), F.lit(0).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(value, F.last("_v", True).over(w)).withColumn(f"{value}_date", F.last("_vd", True).over(w))
    return out.where("_side = 1").drop("_v", "_vd", "_side")


def on_days(intervals: DataFrame, days: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of intervals [start, end) once for each of `days` (trade_date) inside; an open end is the last day's.

    Intervals are cut into their months, days meet them by month; so only what
    is kept (and the ends' months) is made. `days` has a row a session, and is
    broadcast only after that is counted.
    """
    n, last = days.agg(F.count("*"), F.max("trade_date")).first()
    until = F.coalesce(F.date_sub(end, 1), F.lit(last).cast("date"))
    months = F.when(until >= F.col(start), F.sequence(F.trunc(start, "month"), F.trunc(until, "month"), F.expr("interval 1 month")))
    cut = intervals.withColumn("_until", until).withColumn("_month", F.explode(months))
    by_month = days.select("trade_date", F.trunc("trade_date", "month").alias("_month"))
    side = F.broadcast(by_month) if n <= MOST_DAYS else by_month.hint("merge")
    return cut.join(side, "_month").where((F.col("trade_date") >= F.col(start)) & (F.col("trade_date") <= F.col("_until"))).drop("_month", "_until")


def reindexed(df: DataFrame, days: DataFrame, values: list[str]) -> DataFrame:
    """Every code on every session from its first row on, values carried forward."""
    first = df.groupBy("code").agg(F.min("trade_date").alias("_first")).withColumn("_end", F.lit(None).cast("date"))
    grid = on_days(first, days, "_first", "_end").select("code", "trade_date")
    w = upto(series())
    return grid.join(df.hint("merge"), ["code", "trade_date"], "left").select("code", "trade_date", *[F.last(v, True).over(w).alias(v) for v in values])


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], days: int = 32) -> DataFrame:
    """Pairs of closed intervals (start, end) of left and right with a day in common, inside keys: `start`, `end` and `right_*`.

    Intervals are dealt into spans of `days`; a pair meets in the span in which
    the later of its two starts lies, and so once. No range join, no window over all.
    """
    span = lambda c: F.floor(F.unix_date(c) / days)
    r = right.select(*keys, *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in keys])
    a = left.withColumn("_span", F.explode(F.sequence(span("start"), span("end"))))
    b = r.withColumn("_span", F.explode(F.sequence(span("right_start"), span("right_end"))))
    late = F.greatest("start", "right_start")
    return a.join(b.hint("merge"), [*keys, "_span"]).where((late <= F.least("end", "right_end")) & (F.col("_span") == span(late))).drop("_span")


def resampled(df: DataFrame, period: str, anchor: str = "FRI") -> DataFrame:
    """Bars of a period."""
    return df.groupBy("code", label("trade_date", period, anchor).alias("label")).agg(
        F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "trade_date").alias("close"),
        F.sum("volume").alias("volume"), F.max("trade_date").alias("trade_date"),
    )


def held(days: DataFrame, decisions: DataFrame) -> DataFrame:
    """(trade_date, decision_date): a decision holds from the session after it through the next decision."""
    marked = days.join(decisions.select("decision_date").hint("merge"), days.trade_date == F.col("decision_date"), "left")
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)  # one row a session
    return marked.select("trade_date", F.last("decision_date", True).over(w).alias("decision_date")).where("decision_date IS NOT NULL")
