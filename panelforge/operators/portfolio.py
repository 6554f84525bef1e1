"""Weights, execution timing, costs and net values.

Timing: a weight decided on the close of day t earns from t's close on with
`close`, from the next open on with `open`, and half of each with `oc2`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.frames import KEYS, day, series, upto


def equal(keys: tuple[str, ...] = ()) -> Column:
    return 1.0 / F.count("*").over(day(keys))


def inverse_vol(vol: str, keys: tuple[str, ...] = ()) -> Column:
    """Normalised 1 / vol; equal weights on dates without any usable vol."""
    xs = day(keys)
    inv = F.when(F.col(vol) > 0, 1 / F.col(vol))
    total = F.sum(inv).over(xs)
    return F.when(total > 0, F.coalesce(inv, F.lit(0.0)) / total).otherwise(equal(keys))


def risk_budget(budget: float, atr: str, keys: tuple[str, ...] = ()) -> Column:
    """budget * close / ATR, scaled down to a sum of 1 where it is above."""
    raw = F.coalesce(F.when(F.col(atr) > 0, budget * F.col("close") / F.col(atr)), F.lit(0.0))
    return raw / F.greatest(F.lit(1.0), F.sum(raw).over(day(keys)))


def vol_target(vol: str, target: float, stop: float) -> Column:
    """min(1, target / vol); 0 above the hard stop; 0 without vol."""
    return F.when(F.col(vol).isNull() | (F.col(vol) > stop), 0.0).otherwise(F.least(F.lit(1.0), target / F.col(vol)))


def drifted(df: DataFrame, period: str, r: str = "r", weight: str = "w0", keys: tuple[str, ...] = ()) -> DataFrame:
    """Weights that drift with returns inside a period and are reset to w0 at its start: w0 * growth so far, normalised a day."""
    w = Window.partitionBy(*keys, "code", period).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_g", F.col(weight) * F.coalesce(F.product(1 + F.coalesce(F.col(r), F.lit(0.0))).over(w), F.lit(1.0)))
    return df.withColumn("w", F.try_divide(F.col("_g"), F.sum("_g").over(day(keys)))).drop("_g")


def timed(w: str, how: str, keys: tuple[str, ...] = KEYS) -> Column:
    """Weight in force for the day's return."""
    before = F.coalesce(F.lag(w).over(series(keys)), F.lit(0.0))
    return {"open": F.col(w), "close": before, "oc2": (F.col(w) + before) / 2}[how]


def with_fallback(none: DataFrame, hfq: DataFrame, far: float = 0.02, most: float = 1.2) -> DataFrame:
    """Returns on the raw basis; the adjusted ones on days on which the two disagree or the raw one leaps."""
    w = series()
    a = none.withColumn("_rn", F.try_divide(F.col("close"), F.lag("close").over(w))).select("code", "trade_date", "_rn")
    b = hfq.withColumn("_rh", F.try_divide(F.col("close"), F.lag("close").over(w))).select("code", "trade_date", "_rh")
    off = (F.abs(F.try_divide(F.col("_rn"), F.col("_rh")) - 1) > far) | (F.col("_rn") > most) | (F.col("_rn") < 1 / most)
    j = a.join(b.hint("merge"), ["code", "trade_date"], "left")
    return j.select("code", "trade_date", F.when(off, F.col("_rh")).otherwise(F.col("_rn")).alias("gross"), F.coalesce(off, F.lit(False)).alias("fallback"))


def turnover(w: str, keys: tuple[str, ...] = KEYS) -> Column:
    """Half the absolute change of a code's weight; the sum over codes is the day's turnover."""
    return F.abs(F.col(w) - F.coalesce(F.lag(w).over(series(keys)), F.lit(0.0))) / 2


def daily_turnover(df: DataFrame, w: str = "w", r: str = "r", keys: tuple[str, ...] = ()) -> DataFrame:
    """Turnover against yesterday's weights after their drift."""
    df = df.withColumn("_pr", F.sum(F.col(w) * F.coalesce(F.col(r), F.lit(0.0))).over(day(keys)))
    s = series((*keys, "code"))
    before = F.lag(w).over(s) * (1 + F.coalesce(F.lag(r).over(s), F.lit(0.0))) / F.nullif(1 + F.lag("_pr").over(s), F.lit(0.0))
    return df.withColumn("_t", F.abs(F.col(w) - F.coalesce(before, F.lit(0.0))) / 2).groupBy(*keys, "trade_date").agg(F.sum("_t").alias("turnover"))


def net(df: DataFrame, w: str = "w", r: str = "r", cost_bps: float = 5.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, trade_date, gross, turnover, r): the portfolio's return net of costs."""
    df = df.withColumn("_t", turnover(w, (*keys, "code")))
    out = df.groupBy(*keys, "trade_date").agg(F.sum(F.col(w) * F.coalesce(F.col(r), F.lit(0.0))).alias("gross"), F.sum("_t").alias("turnover"))
    return out.withColumn("r", F.col("gross") - F.col("turnover") * 2 * cost_bps / 10_000)


def nav(df: DataFrame, r: str = "r", keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Net value: the running product of 1 + r; the first row is set to 1, later rows keep its return."""
    w = series(keys)
    value = F.product(1 + F.coalesce(F.col(r), F.lit(0.0))).over(upto(w))
    return df.withColumn("nav", F.when(F.row_number().over(w) == 1, 1.0).otherwise(value))


def with_cash(df: DataFrame, cash: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Weights of a date (sum_w) and returns r, plus the rest earning the cash series' return."""
    j = df.join(cash.select("trade_date", F.col("r").alias("_rc")).hint("merge"), "trade_date", "left")
    return j.withColumn("r", F.col("r") + (1 - F.col("sum_w")) * F.coalesce("_rc", F.lit(0.0))).drop("_rc")


def decomposed(df: DataFrame, w: str = "w", keys: tuple[str, ...] = ()) -> DataFrame:
    """Overnight, intraday and interaction parts of the close-to-close return, summed over weights."""
    s = series((*keys, "code"))
    on, intra = F.try_divide(F.col("open"), F.lag("close").over(s)) - 1, F.try_divide(F.col("close"), F.col("open")) - 1
    df = df.withColumn("_on", on).withColumn("_in", F.when(F.col("_on").isNotNull(), intra))
    part = lambda c: F.sum(F.col(w) * F.coalesce(c, F.lit(0.0)))
    return df.groupBy(*keys, "trade_date").agg(part(F.col("_on")).alias("overnight"), part(F.col("_in")).alias("intraday"), part(F.col("_on") * F.col("_in")).alias("interaction"))


def roll_adjusted(df: DataFrame, cost: float, w: str = "w") -> DataFrame:
    """On days on which the contract changes while a position is held: signed close return less two costs."""
    s = series()
    rolled = (F.col("contract") != F.lag("contract").over(s)) & (F.abs(F.lag(w).over(s)) > 1e-12)
    return df.withColumn("r_adj", F.when(rolled, F.lag(w).over(s) * F.col("r") - 2 * cost).otherwise(F.coalesce(F.lag(w).over(s), F.lit(0.0)) * F.col("r")))


def capacity(df: DataFrame, rates: tuple[float, ...] = (0.05, 0.1, 0.2), w: str = "w") -> DataFrame:
    """(rate, p10, p50): capital at which a day's trades take the rate of each code's notional; the tightest code binds."""
    df = df.withColumn("_d", F.abs(F.col(w) - F.coalesce(F.lag(w).over(series()), F.lit(0.0)))).where("_d > 1e-9")
    daily = df.withColumn("rate", F.explode(F.array(*[F.lit(x) for x in rates]))).groupBy("rate", "trade_date").agg(F.min(F.col("amount") * F.col("rate") / F.col("_d")).alias("c"))
    return daily.groupBy("rate").agg(F.percentile("c", 0.1).alias("p10"), F.percentile("c", 0.5).alias("p50"))


def contributions(df: DataFrame, c: str, r: str, keys: tuple[str, ...]) -> DataFrame:
    """An account with contributions: value after each day's return = growth * sum of contributions over growth before."""
    w = series(keys)
    g = F.product(1 + F.col(r)).over(upto(w))
    df = df.withColumn("_g", g).withColumn("_g0", F.coalesce(F.lag("_g").over(w), F.lit(1.0)))
    df = df.withColumn("account", F.col("_g") * F.sum(F.col(c) / F.col("_g0")).over(upto(w))).withColumn("invested", F.sum(c).over(upto(w)))
    return df.withColumn("twr", F.col("_g") - 1).drop("_g", "_g0")


def admitted(df: DataFrame, share: float, limit: int, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Fixed-ratio slots: held codes stay while wanted, new ones enter in score order until weight or number is full.

    Carried holdings make it a loop over dates; a group is one strategy's candidates.
    """

    def walk(pdf):
        import pandas as pd

        held, out = [], []
        for date, g in pdf.sort_values(["trade_date", "score", "code"], ascending=[True, False, True]).groupby("trade_date", sort=True):
            wanted = list(g["code"])
            held = [c for c in held if c in set(wanted)]
            for c in wanted:
                if c not in held:
                    ok = len(held) < limit and (len(held) + 1) * share <= 1 + 1e-12
                    if ok:
                        held.append(c)
                    else:
                        out.append((g["strategy"].iloc[0], date, c, 0.0, "skipped"))
            out += [(g["strategy"].iloc[0], date, c, share, "held") for c in held]
        return pd.DataFrame(out, columns=["strategy", "trade_date", "code", "w", "event"])

    return df.groupBy(*keys).applyInPandas(walk, "strategy string, trade_date date, code string, w double, event string")


def with_trades(df: DataFrame, w: str = "w", keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """Rows of round trips with their number: a run of w > 0 (held), and the day after it (_tail)."""
    s = series(keys)
    df = df.withColumn("_on", F.coalesce(F.col(w), F.lit(0.0)) > 0)
    df = df.withColumn("_new", F.col("_on") & ~F.coalesce(F.lag("_on").over(s), F.lit(False))).withColumn("_tail", ~F.col("_on") & F.coalesce(F.lag("_on").over(s), F.lit(False)))
    df = df.withColumn("trade", F.sum(F.col("_new").cast("int")).over(upto(s))).where("_on OR _tail")
    return df.withColumnRenamed("_on", "held").drop("_new")


def trades(df: DataFrame, w: str = "w", r: str = "r", keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """Round trips from weights: a run of w > 0 and the day after it, whose costs count; the last run of a series may be open."""
    df = with_trades(df, w, keys)
    return df.groupBy(*keys, "trade").agg(
        F.min("trade_date").alias("entry_date"), F.max(F.when(F.col("held"), F.col("trade_date"))).alias("last_date"), F.sum(F.col("held").cast("int")).alias("days"),
        (F.product(1 + F.coalesce(F.col(r), F.lit(0.0))) - 1).alias("ret"), F.max("_tail").alias("closed"),
    )
