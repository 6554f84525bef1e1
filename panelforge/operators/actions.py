"""Corporate actions on lots: code changes along time, splits, and cash dividends on what was held."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.frames import upto
from panelforge.functions.storage import cut
from panelforge.operators.ledger import BOOK, EXACT


def code_paths(changes: DataFrame, most: int = 64) -> DataFrame:
    """(code, at_code, from_date, to_date): where lots of a code go by changes (code, new_code, effective_date).

    A change moves all that stands under its code on its date, so paths follow
    changes forward in time: A to B to C, each from its date; a name that comes
    back later is followed too. Codes without a change have no row (they stay
    where they are). Each round follows one change; a path of more than `most`
    changes is refused.
    """
    first = Window.partitionBy("code").orderBy("effective_date", "new_code")
    change = changes.where("code IS NOT NULL AND new_code IS NOT NULL AND code <> new_code AND effective_date IS NOT NULL").select("code", "new_code", "effective_date").distinct()
    ahead = cut(change.withColumn("_n", F.row_number().over(Window.partitionBy("code", "effective_date").orderBy("new_code"))).where("_n = 1").drop("_n"))
    start = ahead.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    never = F.lit(None).cast("date")
    out = start.select("code", F.col("code").alias("at_code"), never.alias("from_date"), F.col("effective_date").alias("to_date"))
    step = cut(start.select("code", F.col("new_code").alias("at_code"), F.col("effective_date").alias("from_date")))
    edge = ahead.select(F.col("code").alias("_old"), F.col("new_code").alias("_new"), F.col("effective_date").alias("_when"))
    for _ in range(most):
        met = step.join(edge.hint("merge"), (F.col("at_code") == F.col("_old")) & (F.col("_when") > F.col("from_date")), "left")
        near = met.groupBy("code", "at_code", "from_date").agg(F.min(F.struct("_when", "_new")).alias("_next"))
        near = cut(near.select("code", "at_code", "from_date", F.col("_next._when").alias("to_date"), F.col("_next._new").alias("_new")))
        out = out.unionByName(near.drop("_new"))
        step = near.where("to_date IS NOT NULL").select("code", F.col("_new").alias("at_code"), F.col("to_date").alias("from_date"))
        if not step.limit(1).count():
            return out
    raise ValueError(f"a code changes more than {most} times")


def on_paths(events: DataFrame, paths: DataFrame) -> DataFrame:
    """Events (code, effective_date, ...) under the code that lots began with: every code whose path stands at the event's code on its date (before changes of that day)."""
    e = events.withColumnRenamed("code", "_at")
    inside = (F.col("at_code") == F.col("_at")) & (F.col("from_date").isNull() | (F.col("effective_date") > F.col("from_date"))) & (F.col("to_date").isNull() | (F.col("effective_date") <= F.col("to_date")))
    moved = e.join(paths.withColumnRenamed("code", "_code").hint("merge"), inside).select(F.col("_code").alias("code"), *[c for c in events.columns if c != "code"])
    stay = events.join(paths.select("code").distinct().hint("merge"), "code", "left_anti").select(*moved.columns)
    return moved.unionByName(stay)


def _later(rows: DataFrame, splits: DataFrame, date: str) -> DataFrame:
    """rows plus _f: the product of ratios of their code's splits after the row's date (a split of the same date is before)."""
    s = splits.where("ratio > 0").select("code", F.col("effective_date").alias(date), F.col("ratio").cast("double").alias("_ratio"), F.lit(0).alias("_side"))
    both = rows.withColumn("_side", F.lit(1)).unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy("code").orderBy(date, "_side").rowsBetween(1, Window.unboundedFollowing)
    return both.withColumn("_f", F.coalesce(F.product(F.coalesce("_ratio", F.lit(1.0))).over(w), F.lit(1.0))).where("_side = 1").drop("_side", "_ratio")


def restated(trades: DataFrame, changes: DataFrame, splits: DataFrame) -> DataFrame:
    """Trades under the code that their lots end with, in units after all later splits: ready for fifo(), rounds() and holdings.

    Splits (code, effective_date, ratio) meet lots under the code that they have
    on the day; lots of several codes that become one keep the order in which
    they were bought.
    """
    paths = cut(code_paths(changes))
    t = _later(trades, on_paths(splits, paths), "trade_date")
    t = t.withColumn("quantity", F.col("quantity") * F.col("_f")).withColumn("price", F.col("price") / F.col("_f")).drop("_f")
    ends = paths.where("to_date IS NULL").select("code", F.col("at_code").alias("_end"))
    return t.join(ends.hint("merge"), "code", "left").withColumn("code", F.coalesce("_end", "code")).drop("_end").select(*trades.columns)


def dividends(trades: DataFrame, changes: DataFrame, splits: DataFrame, cash: DataFrame, book: tuple[str, ...] = BOOK) -> DataFrame:
    """(book, effective_date, quantity, cash): what each book had before the trades of a dividend's day (code, effective_date, cash_per_share), in units of that day, and what it got.

    The book's code is the one that its trades carry; quantities of several such
    codes that have become one are rows of their own and add up. Books that held
    nothing, or were sold short, get nothing.
    """
    paths = cut(code_paths(changes))
    moved = on_paths(splits, paths)
    account = [k for k in book if k != "code"]
    q = F.col("quantity").cast(EXACT)
    t = _later(trades, moved, "trade_date").select(*book, F.col("trade_date").alias("_day"), F.lit(1).alias("_side"), (F.when(F.col("side") == "BUY", q).otherwise(-q) * F.col("_f").cast("decimal(10,4)")).cast(EXACT).alias("_q"))
    paid = _later(on_paths(cash.where("cash_per_share > 0"), paths).select("code", "effective_date", F.col("cash_per_share").cast("double").alias("cash_per_share")), moved, "effective_date")
    met = trades.select(*book).distinct().join(paid.hint("merge"), "code").select(*book, F.col("effective_date").alias("_day"), F.lit(0).alias("_side"), F.lit(0).cast(EXACT).alias("_q"), "cash_per_share", "_f")
    w = Window.partitionBy(*book).orderBy("_day", "_side")
    rows = t.unionByName(met, allowMissingColumns=True).withColumn("_held", F.sum("_q").over(upto(w)).cast("double")).where("_side = 0 AND _held > 0")
    units = F.col("_held") / F.col("_f")
    return rows.select(*account, "code", F.col("_day").alias("effective_date"), units.alias("quantity"), (units * F.col("cash_per_share")).alias("cash"))
