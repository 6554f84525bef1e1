"""Performance aggregates: one row a strategy, code or period."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.frames import run_id, series, upto

YEAR = 252
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def with_drawdown(df: DataFrame, x: str = "nav", keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    w = series(keys)
    df = df.withColumn("_peak", F.max(x).over(upto(w))).withColumn("drawdown", F.try_divide(F.col(x), F.col("_peak")) - 1)
    df = df.withColumn("_at", F.last(F.when(F.col(x) >= F.col("_peak"), F.col("trade_date")), True).over(upto(w)))
    return df.withColumn("under_water", F.datediff("trade_date", "_at")).drop("_peak", "_at")


def safe(top: Column, bottom: Column) -> Column:
    return F.when(F.abs(bottom) > 1e-12, top / bottom)


def metrics(df: DataFrame, x: str = "nav", keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Returns, volatility, Sharpe, Sortino, drawdown and its days, ulcer index and ratios of net values."""
    w = series(keys)
    d = with_drawdown(df.withColumn("_r", F.try_divide(F.col(x), F.lag(x).over(w)) - 1), x, keys)
    sq = F.sqrt(F.lit(float(YEAR)))
    g = d.groupBy(*keys).agg(
        F.count(x).alias("n"), F.min_by(x, "trade_date").alias("_a"), F.max_by(x, "trade_date").alias("_b"), F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"),
        F.stddev_samp(F.least(F.col("_r"), F.when(F.col("_r").isNotNull(), 0.0))).alias("_d"), F.min("drawdown").alias("max_drawdown"), F.max("under_water").alias("max_under_water"), F.sqrt(F.avg(F.pow(F.col("drawdown") * 100, 2))).alias("ulcer"),
    )
    total = F.try_divide(F.col("_b"), F.col("_a"))
    g = g.withColumn("total", total - 1).withColumn("annual", F.when(F.col("n") > 1, F.pow(total, F.lit(float(YEAR)) / (F.col("n") - 1)) - 1)).withColumn("vol", F.col("_s") * sq)
    g = g.withColumn("sharpe", safe(F.col("_m"), F.col("_s")) * sq).withColumn("sortino", safe(F.col("_m"), F.col("_d")) * sq)
    g = g.withColumn("calmar", safe(F.col("annual"), F.abs("max_drawdown"))).withColumn("ulcer_performance", safe(F.col("annual") * 100, F.col("ulcer")))
    return g.drop("_a", "_b", "_m", "_s", "_d")


def excess_bundle(df: DataFrame, r: str, rf: float, keys: tuple[str, ...]) -> DataFrame:
    """Bundle of daily returns over a yearly risk-free rate: it is taken off each day's return in Sharpe and Sortino ratios, off the yearly return in `excess`."""
    x = F.col(r) - rf / YEAR
    g = df.groupBy(*keys).agg(F.count(r).alias("n"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"), F.sqrt(F.avg(F.pow(F.when(x.isNotNull(), F.least(x, F.lit(0.0))), 2))).alias("_d"), F.exp(F.avg(F.log1p(r)) * YEAR).alias("_g"))
    g = g.withColumn("annual", F.col("_g") - 1).withColumn("excess", F.col("_g") - 1 - rf).withColumn("vol", F.col("_s") * math.sqrt(YEAR))
    return g.withColumn("sharpe", safe(F.col("_m"), F.col("_s")) * math.sqrt(YEAR)).withColumn("sortino", safe(F.col("_m"), F.col("_d")) * math.sqrt(YEAR)).drop("_m", "_s", "_d", "_g")


def information_ratio(df: DataFrame, r: str, b: str, keys: tuple[str, ...]) -> DataFrame:
    e = F.col(r) - F.col(b)
    return df.groupBy(*keys).agg((safe(F.avg(e), F.stddev_samp(e)) * math.sqrt(YEAR)).alias("information_ratio"))


def win_stats(df: DataFrame, r: str, keys: tuple[str, ...]) -> DataFrame:
    """Win rate, payoff and Kelly shares: arithmetic, and of non-zero outcomes, and mean over variance; geometric mean."""
    x = F.col(r)
    g = df.groupBy(*keys).agg(
        F.count(r).alias("n"), F.avg(F.when(x.isNotNull(), (x > 0).cast("double"))).alias("win_rate"), F.avg(F.when(x > 0, x)).alias("_up"), F.avg(F.when(x < 0, -x)).alias("_down"),
        F.avg(F.when(x != 0, (x > 0).cast("double"))).alias("_p"), F.avg(r).alias("mean"), F.var_samp(r).alias("_v"), (F.exp(F.avg(F.when(x > -1, F.log1p(x)))) - 1).alias("geometric"),
    )
    payoff = safe(F.col("_up"), F.col("_down"))
    g = g.withColumn("payoff", payoff)
    g = g.withColumn("kelly", F.col("win_rate") - F.try_divide(1 - F.col("win_rate"), F.col("payoff"))).withColumn("kelly_nonzero", F.col("_p") - F.try_divide(1 - F.col("_p"), F.col("payoff"))).withColumn("kelly_mv", safe(F.col("mean"), F.col("_v")))
    return g.drop("_up", "_down", "_p", "_v")


def distribution(df: DataFrame, x: str, keys: tuple[str, ...]) -> DataFrame:
    q = F.percentile(x, [float(p) for p in QUANTILES])
    g = df.groupBy(*keys).agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), q.alias("_q"))
    return g.select(*keys, "n", "low", "high", "mean", "sd", *[F.get("_q", k).alias(f"p{round(100 * p):02d}") for k, p in enumerate(QUANTILES)])


def histogram(df: DataFrame, x: str, keys: tuple[str, ...], bins: int = 20) -> DataFrame:
    """(keys, bin, n) of equal bins between the 1 and 99 % points; 0 and bins + 1 hold what lies outside; a range of no width is widened."""
    ends = df.groupBy(*keys).agg(F.percentile(x, 0.01).alias("_lo"), F.percentile(x, 0.99).alias("_hi"))
    ends = ends.withColumn("_hi", F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 1e-9).otherwise(F.col("_hi")))
    j = df.where(F.col(x).isNotNull()).join(ends.hint("merge"), list(keys))
    b = F.when(F.col(x) < F.col("_lo"), 0).when(F.col(x) > F.col("_hi"), bins + 1).otherwise(F.least(F.lit(bins), F.floor((F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1))
    return j.groupBy(*keys, b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def rolling_pack(df: DataFrame, x: str, windows: dict[str, int], keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """(keys, trade_date, window, ret, drawdown) for each window of rows; all windows in one pass over one sort."""
    w = series(keys)
    cells = [F.struct(F.lit(name).alias("window"), (F.try_divide(F.col(x), F.lag(x, n).over(w)) - 1).alias("ret"), (F.col(x) / F.max(x).over(w.rowsBetween(-n, 0)) - 1).alias("drawdown")) for name, n in windows.items()]
    return df.withColumn("_c", F.array(*cells)).select(*keys, "trade_date", F.explode("_c").alias("c")).select(*keys, "trade_date", "c.*")


def attribution(df: DataFrame, w: str, r: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, code, contribution): shares of the log return, scaled to the total return."""
    s = df.groupBy(*keys, "code").agg(F.sum(F.log1p(F.col(w) * F.coalesce(F.col(r), F.lit(0.0)))).alias("_l"))
    p = df.groupBy(*keys, "trade_date").agg(F.sum(F.col(w) * F.coalesce(F.col(r), F.lit(0.0))).alias("_p"))
    total = p.groupBy(*keys).agg((F.product(1 + F.col("_p")) - 1).alias("_t"))
    all_codes = s.groupBy(*keys).agg(F.sum("_l").alias("_s"))
    ends = total.join(all_codes.hint("merge"), list(keys)) if keys else total.crossJoin(all_codes)  # one row each without keys
    j = s.join(ends.hint("merge"), list(keys)) if keys else s.crossJoin(F.broadcast(ends))
    return j.select(*keys, "code", (F.try_divide(F.col("_l"), F.col("_s")) * F.col("_t")).alias("contribution"))


def risk_contribution(df: DataFrame, w: str, r: str) -> DataFrame:
    """(code, weight, share): mean weight times covariance with the others, over the variance; by pairs of codes."""
    mean = df.groupBy("code").agg(F.avg(w).alias("mw"))
    rows = df.where(F.col(r).isNotNull()).select("trade_date", "code", F.col(r).alias("r"))
    a, b = rows.alias("a"), rows.alias("b")
    cov = a.join(b.hint("merge"), F.col("a.trade_date") == F.col("b.trade_date")).groupBy(F.col("a.code").alias("code"), F.col("b.code").alias("other")).agg(F.covar_samp("a.r", "b.r").alias("cov"))
    m2 = mean.select(F.col("code").alias("other"), F.col("mw").alias("mo"))
    j = cov.join(mean.hint("merge"), "code").join(m2.hint("merge"), "other").groupBy("code", "mw").agg(F.sum(F.col("mw") * F.col("mo") * F.col("cov")).alias("_c"))
    total = j.agg(F.sum("_c").alias("_t"))  # one row
    return j.crossJoin(F.broadcast(total)).select("code", F.col("mw").alias("weight"), F.try_divide(F.col("_c"), F.col("_t")).alias("share"))


def xirr(flows: DataFrame, keys: tuple[str, ...] = ("account_id",), rounds: int = 60, low: float = -0.99, high: float = 10.0) -> DataFrame:
    """Money-weighted rate of dated flows (flow_date, amount), Actual/365.2425, by bisection inside one expression; null where the value has no root in the range."""
    daily = flows.groupBy(*keys, "flow_date").agg(F.sum("amount").alias("amount"))
    first = F.min("flow_date").over(Window.partitionBy(*keys))
    cells = daily.withColumn("_t", F.datediff("flow_date", first) / 365.2425).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_t", "amount"))).alias("_f"))
    npv = lambda rate: F.aggregate("_f", F.lit(0.0), lambda acc, f: acc + f["amount"] / F.pow(1 + rate, f["_t"]))
    ends = F.struct(F.lit(low).alias("a"), F.lit(high).alias("b"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["a"] + s["b"]) / 2
        same = F.signum(npv(mid)) == F.signum(npv(F.lit(low)))
        return F.struct(F.when(same, mid).otherwise(s["a"]).alias("a"), F.when(same, s["b"]).otherwise(mid).alias("b"))

    got = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), ends, halve)
    has = F.signum(npv(F.lit(low))) * F.signum(npv(F.lit(high))) < 0
    return cells.select(*keys, F.when(has, (got["a"] + got["b"]) / 2).alias("xirr"))


def by_state(df: DataFrame, state: str, r: str) -> DataFrame:
    """Share of days, summed log return, win rate and mean of each state."""
    g = df.where(F.col(r).isNotNull() & F.col(state).isNotNull()).groupBy(state).agg(F.count("*").alias("days"), F.sum(F.log1p(r)).alias("log_return"), F.avg((F.col(r) > 0).cast("int")).alias("win_rate"), F.avg(r).alias("mean"))
    total = g.agg(F.sum("days").alias("_t"))  # one row
    return g.crossJoin(F.broadcast(total)).withColumn("share", F.col("days") / F.col("_t")).drop("_t")


def confusion(df: DataFrame, p: str, y: str, keys: tuple[str, ...]) -> DataFrame:
    both = F.col(p).isNotNull() & F.col(y).isNotNull()
    cell = lambda a, b: F.sum((a & b).cast("int"))
    up, yes = F.col(p) > 0, F.col(y) > 0
    g = df.where(both).groupBy(*keys).agg(cell(up, yes).alias("tp"), cell(up, ~yes).alias("fp"), cell(~up, yes).alias("fn"), cell(~up, ~yes).alias("tn"), F.percentile(F.when(up, F.col(y)), 0.5).alias("median_up"), F.percentile(F.when(~up, F.col(y)), 0.5).alias("median_down"))
    return g.withColumn("hit_rate", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def sign_runs(df: DataFrame, r: str, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """Runs of equal sign: number, compounded return and days."""
    df = df.where(F.col(r).isNotNull()).withColumn("sign", F.signum(r).cast("int"))
    df = df.withColumn("run", run_id(F.col("sign"), series(keys)))
    return df.groupBy(*keys, "run").agg(F.first("sign").alias("sign"), F.count("*").alias("days"), (F.product(1 + F.col(r)) - 1).alias("ret"))


def semi_variance(df: DataFrame, r: str, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.pow(F.when(F.col(r).isNotNull(), F.greatest(F.col(r), F.lit(0.0))), 2)).alias("up"), F.avg(F.pow(F.when(F.col(r).isNotNull(), F.least(F.col(r), F.lit(0.0))), 2)).alias("down"))


def trade_stats(trades: DataFrame, x: str, keys: tuple[str, ...], max_risk: float = 0.2) -> DataFrame:
    """Win statistics and the risk of ruin ((1 - P) / P) ^ (max_risk / A), P from the edge per unit of size A."""
    g = win_stats(trades, x, keys)
    size = trades.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(x, 2))).alias("_a"))
    g = g.join(size.hint("merge"), list(keys))
    p = 0.5 * (1 + F.try_divide(F.col("mean"), F.col("_a")))
    ruin = F.when((p > 0.5) & (p < 1), F.pow((1 - p) / p, max_risk / F.col("_a"))).when(p <= 0.5, 1.0)
    return g.withColumn("risk_of_ruin", ruin).drop("_a")


def sqn(trades: DataFrame, x: str, order: str, keys: tuple[str, ...], last: int = 100, least: int = 30) -> DataFrame:
    """System quality number of the last trades, population deviation; null below `least`; grade."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    g = trades.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= last).groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    v = F.when((F.col("n") >= least) & (F.col("_s") > 1e-12), F.col("_m") / F.col("_s") * F.sqrt(F.col("n")))
    grade = F.when(v.isNull(), "none").when(v < 1.6, "poor").when(v < 2.0, "average").when(v < 2.5, "good").when(v < 3.0, "very good").otherwise("excellent")
    return g.select(*keys, "n", v.alias("sqn"), grade.alias("grade"))


def rolling_sqn(trades: DataFrame, x: str, order: str, keys: tuple[str, ...], n: int = 100) -> DataFrame:
    f = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    sd = F.stddev_pop(x).over(f)
    return trades.withColumn("sqn", F.when((F.count(x).over(f) >= n) & (sd > 1e-12), F.avg(x).over(f) / sd * math.sqrt(n)))
