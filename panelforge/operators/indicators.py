"""Rolling, expanding and recursive indicators on long panels."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.frames import KEYS, enough, prior, ret, roll, series, upto
from panelforge.functions.ordered import ordered_scan
from panelforge.operators import scan

YEAR = 252


def sma(x: str, n: int, least: int | None = None, keys: tuple[str, ...] = KEYS) -> Column:
    f = roll(series(keys), n)
    return enough(F.col(x), F.avg(x).over(f), f, least or max(2, n // 2))


def rolling_std(x: str, n: int, least: int = 2, ddof: int = 1, keys: tuple[str, ...] = KEYS) -> Column:
    f = roll(series(keys), n)
    return enough(F.col(x), (F.stddev_samp if ddof else F.stddev_pop)(x).over(f), f, least)


def with_returns(df: DataFrame, x: str = "close", keys: tuple[str, ...] = KEYS) -> DataFrame:
    w = series(keys)
    return df.withColumn("r", ret(x, w)).withColumn("lr", F.when((F.col(x) > 0) & (F.lag(x).over(w) > 0), F.ln(F.try_divide(F.col(x), F.lag(x).over(w)))))


def donchian(n: int, keys: tuple[str, ...] = KEYS) -> tuple[Column, Column]:
    """High and low of the n rows before today."""
    f = prior(series(keys), n)
    full = lambda c: enough(F.col(c), F.max(c).over(f) if c == "high" else F.min(c).over(f), f, n)
    return full("high"), full("low")


def compounded(r: str, n: int, keys: tuple[str, ...] = KEYS) -> Column:
    f = roll(series(keys), n)
    return enough(F.col(r), F.product(1 + F.col(r)).over(f) - 1, f, n)


def with_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float, int | None, int]], keys: tuple[str, ...] = KEYS, order: str = "trade_date") -> DataFrame:
    """df plus quantiles known yesterday: name -> (x, q, n, least), of the n rows before today or (None) of all before.

    Null where fewer than `least` values lie in that window. The values seen stay
    in a sorted list, so a row costs a search, not a sort of its window.
    """

    names = list(wanted)

    def begin() -> Callable:
        held: list[list[float]] = [[] for _ in names]
        rows = [deque() for _ in names]

        def step(*xs: float | None) -> tuple:
            out = []
            for name, x, own, late in zip(names, xs, held, rows, strict=True):
                _, q, n, least = wanted[name]
                place = q * (len(own) - 1)
                low = int(place)
                out.append(own[low] + (own[min(low + 1, len(own) - 1)] - own[low]) * (place - low) if len(own) >= max(1, least) else None)
                if n:
                    late.append(x)
                    if len(late) > n and (old := late.popleft()) is not None:
                        del own[bisect_left(own, old)]
                if x is not None:
                    insort(own, x)
            return tuple(out)

        return step

    return ordered_scan(df, [v[0] for v in wanted.values()], dict.fromkeys(names, "double"), begin, keys, (order,))


def midrank(df: DataFrame, x: str, out: str, keys: tuple[str, ...] = KEYS, order: str = "trade_date") -> DataFrame:
    """(less + half of equal) / n over the history including today, from a sorted list of the values seen."""

    def begin() -> Callable:
        own: list[float] = []

        def step(v: float | None) -> tuple:
            if v is None:
                return (None,)
            insort(own, v)
            return ((bisect_left(own, v) + bisect_right(own, v)) / 2 / len(own),)

        return step

    return ordered_scan(df, [x], {out: "double"}, begin, keys, (order,))


def slope(x: Column, n: int, keys: tuple[str, ...] = KEYS) -> Column:
    """Least-squares slope of the last n values on their position."""
    f = roll(series(keys), n)
    place = F.unix_date("trade_date") * 0 + F.col("_rn")
    return F.when(F.count(x).over(f) >= n, F.regr_slope(x, place).over(f))


def rolling_drawdown(x: str, n: int, keys: tuple[str, ...] = KEYS) -> Column:
    return F.try_divide(F.col(x), F.max(x).over(roll(series(keys), n))) - 1


def window_drawdowns(x: str, n: int, keys: tuple[str, ...] = KEYS) -> tuple[Column, Column]:
    """Largest drawdown and ulcer index inside each window of n values."""
    values = F.collect_list(x).over(roll(series(keys), n))
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"), F.lit(0.0).alias("sq"))

    def step(acc: Column, v: Column) -> Column:
        peak = F.greatest(acc["peak"], v)
        dd = v / peak - 1
        return F.struct(peak.alias("peak"), F.least(acc["worst"], dd).alias("worst"), (acc["sq"] + dd * dd).alias("sq"))

    end = F.aggregate(values, start, step)
    return end["worst"], F.sqrt(end["sq"] / F.size(values))


def sharpe(r: str, n: int, keys: tuple[str, ...] = KEYS) -> Column:
    f = roll(series(keys), n)
    sd = F.stddev_samp(r).over(f)
    return F.when((F.count(r).over(f) >= n) & (sd > 1e-12), F.avg(r).over(f) / sd * math.sqrt(YEAR))


def sortino(r: str, n: int, keys: tuple[str, ...] = KEYS) -> Column:
    f = roll(series(keys), n)
    sd = F.stddev_samp(F.least(F.col(r), F.lit(0.0))).over(f)
    return F.when((F.count(r).over(f) >= n) & (sd > 1e-12), F.avg(r).over(f) / sd * math.sqrt(YEAR))


def efficiency_ratio(x: str, n: int, least: int | None = None, keys: tuple[str, ...] = KEYS) -> Column:
    """Net change over the path; needs the column _step = abs(x - previous x)."""
    w = series(keys)
    f = roll(w, n)
    path = F.sum("_step").over(f)
    return F.when((F.count("_step").over(f) >= (least or n)) & (path > 0), F.abs(F.col(x) - F.lag(x, n).over(w)) / path)


def with_steps(df: DataFrame, x: str = "close", keys: tuple[str, ...] = KEYS) -> DataFrame:
    return df.withColumn("_step", F.abs(F.col(x) - F.lag(x).over(series(keys))))


def kama(df: DataFrame, out: str, x: str = "close", n: int = 10, fast: int = 2, slow: int = 30, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adaptive mean: smoothing from the squared efficiency ratio; seeded by the first value."""
    f, s = scan.span(fast), scan.span(slow)
    df = with_steps(df, x, keys).withColumn("_er", F.coalesce(efficiency_ratio(x, n, keys=keys), F.lit(0.0)))
    df = df.withColumn("_alpha", F.pow(F.col("_er") * (f - s) + s, 2))
    first = F.row_number().over(series(keys)) == 1
    return scan.linear(df, out, 1 - F.col("_alpha"), F.when(first, F.col(x)).otherwise(F.col("_alpha") * F.col(x)), keys).drop("_er", "_alpha", "_step")


def vma(df: DataFrame, out: str, x: str = "close", n: int = 9, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Variable mean: smoothing of span n times the share of net in gross moves."""
    w = series(keys)
    df = df.withColumn("_d", F.col(x) - F.lag(x).over(w))
    f = roll(w, n)
    up, down = F.sum(F.greatest("_d", F.lit(0.0))).over(f), F.sum(F.greatest(-F.col("_d"), F.lit(0.0))).over(f)
    df = df.withColumn("_alpha", F.coalesce(F.when(up + down > 0, F.abs(up - down) / (up + down)), F.lit(0.0)) * scan.span(n))
    first = F.row_number().over(w) == 1
    return scan.linear(df, out, 1 - F.col("_alpha"), F.when(first, F.col(x)).otherwise(F.col("_alpha") * F.col(x)), keys).drop("_d", "_alpha")


def wma(x: str, n: int, keys: tuple[str, ...] = KEYS) -> Column:
    """Linearly weighted mean of the last n values, the latest heaviest."""
    w = series(keys)
    total = sum((F.lag(x, k).over(w) * (n - k) for k in range(n)), F.lit(0.0))
    return total / (n * (n + 1) / 2)


def moving_average(df: DataFrame, out: str, kind: str, n: int, x: str = "close", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Mean by name: sma, ema, wma, kama or vma."""
    if kind == "sma":
        return df.withColumn(out, sma(x, n, n, keys))
    if kind == "wma":
        return df.withColumn(out, wma(x, n, keys))
    if kind == "ema":
        return scan.ema(df, out, x, scan.span(n), keys)
    if kind == "kama":
        return kama(df, out, x, n, keys=keys)
    if kind == "vma":
        return vma(df, out, x, n, keys)
    raise ValueError(f"unknown mean {kind!r}")


def macd(df: DataFrame, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, keys: tuple[str, ...] = KEYS) -> DataFrame:
    df = scan.emas(df, {"_fast": (x, scan.span(fast)), "_slow": (x, scan.span(slow))}, keys)
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow"))
    df = scan.ema(df, "macd_signal", "macd", scan.span(signal), keys)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def with_true_range(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    before = F.lag("close").over(series(keys))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return df.withColumn("tr", tr)


def atr(df: DataFrame, out: str = "atr", n: int = 14, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Wilder mean of the true range; null before n rows."""
    return scan.ema(with_true_range(df, keys), out, "tr", 1.0 / n, keys, least=n)


def rsi(df: DataFrame, out: str = "rsi", x: str = "close", n: int = 14, flat: float = 50.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Wilder strength index: 100 without losses, 0 without gains, `flat` without either."""
    w = series(keys)
    rows = df.withColumn("_d", F.col(x) - F.lag(x).over(w))
    moved = rows.where(F.col("_d").isNotNull()).withColumn("_up", F.greatest("_d", F.lit(0.0))).withColumn("_down", F.greatest(-F.col("_d"), F.lit(0.0)))
    moved = scan.emas(moved, {"_u": ("_up", 1.0 / n), "_l": ("_down", 1.0 / n)}, keys, least=n)
    value = F.when((F.col("_u") == 0) & (F.col("_l") == 0), flat).when(F.col("_l") == 0, 100.0).when(F.col("_u") == 0, 0.0).otherwise(100 - 100 / (1 + F.col("_u") / F.col("_l")))
    got = moved.select(*keys, "trade_date", F.when(F.col("_u").isNotNull(), value).alias(out))
    return df.join(got.hint("merge"), [*keys, "trade_date"], "left")


def adx(df: DataFrame, n: int = 14, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Directional index (adx) and its mean with the value n rows before (adxr)."""
    w = series(keys)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    rows = with_true_range(df, keys).withColumn("_p", F.when((up > down) & (up > 0), up).otherwise(0.0)).withColumn("_m", F.when((down > up) & (down > 0), down).otherwise(0.0))
    rows = scan.emas(rows, {"_mean": ("tr", 1.0 / n), "_plus": ("_p", 1.0 / n), "_minus": ("_m", 1.0 / n)}, keys)
    rows = rows.withColumn("plus_di", F.when(F.col("_mean") > 0, 100 * F.col("_plus") / F.col("_mean"))).withColumn("minus_di", F.when(F.col("_mean") > 0, 100 * F.col("_minus") / F.col("_mean")))
    total = F.col("plus_di") + F.col("minus_di")
    rows = rows.withColumn("_dx", F.coalesce(F.when(total > 0, 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / total), F.lit(0.0)))
    rows = scan.ema(rows, "adx", "_dx", 1.0 / n, keys, least=n)
    rows = rows.withColumn("adxr", (F.col("adx") + F.lag("adx", n).over(w)) / 2)
    return rows.drop("tr", "_p", "_m", "_mean", "_plus", "_minus", "_dx")


def range_volatility(n: int = 20, keys: tuple[str, ...] = KEYS) -> dict[str, Column]:
    """Annualised Parkinson, Garman-Klass and Rogers-Satchell volatility; needs positive prices."""
    f = roll(series(keys), n)
    hl, co = F.ln(F.col("high") / F.col("low")), F.ln(F.col("close") / F.col("open"))
    rs = F.ln(F.col("high") / F.col("close")) * F.ln(F.col("high") / F.col("open")) + F.ln(F.col("low") / F.col("close")) * F.ln(F.col("low") / F.col("open"))
    year = lambda v: F.when(F.count("close").over(f) >= n, F.sqrt(F.greatest(F.avg(v).over(f), F.lit(0.0)) * YEAR))
    return {"parkinson": year(hl * hl / (4 * math.log(2))), "garman_klass": year(0.5 * hl * hl - (2 * math.log(2) - 1) * co * co), "rogers_satchell": year(rs)}


def yang_zhang(df: DataFrame, n: int = 20, keys: tuple[str, ...] = KEYS) -> DataFrame:
    w = series(keys)
    f = roll(w, n)
    df = df.withColumn("_on", F.ln(F.col("open") / F.lag("close").over(w))).withColumn("_oc", F.ln(F.col("close") / F.col("open")))
    rs = F.ln(F.col("high") / F.col("close")) * F.ln(F.col("high") / F.col("open")) + F.ln(F.col("low") / F.col("close")) * F.ln(F.col("low") / F.col("open"))
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    var = F.var_samp("_on").over(f) + k * F.var_samp("_oc").over(f) + (1 - k) * F.avg(rs).over(f)
    return df.withColumn("yang_zhang", F.when(F.count("_on").over(f) >= n, F.sqrt(F.greatest(var, F.lit(0.0)) * YEAR))).drop("_on", "_oc")


def ewma_volatility(df: DataFrame, out: str = "ewma_vol", decay: float = 0.94, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Recursive variance of log returns (column lr, null on the first row of a series), annualised."""
    moved = df.where(F.col("lr").isNotNull()).withColumn("_sq", F.col("lr") * F.col("lr"))
    moved = scan.ema(moved, "_var", "_sq", 1 - decay, keys)
    return df.join(moved.select(*keys, "trade_date", F.sqrt(F.col("_var") * YEAR).alias(out)).hint("merge"), [*keys, "trade_date"], "left")


def har_forecast(df: DataFrame, x: str, out: str = "har", n: int = 252, least: int = 20, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rolling regression of x on yesterday's x and its means over 5 and 22 days, at least zero.

    The products come from window sums; only the 4 x 4 systems are solved in numpy, batch by batch.
    """
    w = series(keys)
    df = df.withColumn("_1", F.lag(x).over(w)).withColumn("_5", F.avg(x).over(w.rowsBetween(-5, -1))).withColumn("_22", F.when(F.count(x).over(w.rowsBetween(-22, -1)) >= 22, F.avg(x).over(w.rowsBetween(-22, -1))))
    ok = F.col("_22").isNotNull() & F.col(x).isNotNull()
    cols = {"c": F.lit(1.0), "a": F.col("_1"), "b": F.col("_5"), "d": F.col("_22")}
    names = list(cols)
    f = prior(w, n)
    sums = [F.sum(F.when(ok, cols[p] * cols[q])).over(f) for i, p in enumerate(names) for q in names[i:]] + [F.sum(F.when(ok, cols[p] * F.col(x))).over(f) for p in names]
    df = df.withColumn("_sums", F.array(*[F.coalesce(s, F.lit(0.0)) for s in sums])).withColumn("_n", F.count(F.when(ok, 1)).over(f))
    ask = df.where((F.col("_n") >= least) & ok).select(*keys, "trade_date", "_sums", F.array(F.lit(1.0), "_1", "_5", "_22").alias("_x"))
    n_keys = len(keys) + 1

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.triu_indices(4)
        for b in batches:
            s = b.column(n_keys).flatten().to_numpy().reshape(-1, 14)
            v = b.column(n_keys + 1).flatten().to_numpy().reshape(-1, 4)
            gram = np.zeros((len(s), 4, 4))
            gram[:, at[0], at[1]] = gram[:, at[1], at[0]] = s[:, :10]
            beta = np.einsum("nij,nj->ni", np.linalg.pinv(gram), s[:, 10:])
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keys], pa.array(np.maximum((beta * v).sum(axis=1), 0))], [*keys, "trade_date", out])

    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in [*keys, "trade_date"])
    got = ask.mapInArrow(solve, f"{types}, {out} double")
    return df.drop("_1", "_5", "_22", "_sums", "_n").join(got.hint("merge"), [*keys, "trade_date"], "left")


def volatility(df: DataFrame, kind: str, n: int = 20, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Add vol, the volatility level by the estimator's name."""
    if kind == "yang_zhang":
        return yang_zhang(df, n, keys).withColumnRenamed("yang_zhang", "vol")
    if kind == "close":
        return with_returns(df, keys=keys).withColumn("vol", rolling_std("lr", n, n, keys=keys) * math.sqrt(YEAR)).drop("r", "lr")
    if kind == "ewma":
        return ewma_volatility(with_returns(df, keys=keys), "vol", keys=keys).drop("r", "lr")
    known = range_volatility(n, keys)
    if kind not in known:
        raise ValueError(f"unknown estimator {kind!r}")
    return df.withColumn("vol", known[kind])


def impulse(df: DataFrame, n: int = 13, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """BULL where the mean and the MACD histogram both rise, BEAR where both fall, else NEUTRAL."""
    w = series(keys)
    df = macd(scan.ema(df, "_ema", "close", scan.span(n), keys), keys=keys)
    e, h = F.col("_ema") - F.lag("_ema").over(w), F.col("macd_hist") - F.lag("macd_hist").over(w)
    return df.withColumn("impulse", F.when((e > 0) & (h > 0), "BULL").when((e < 0) & (h < 0), "BEAR").otherwise("NEUTRAL")).drop("_ema")


def autocorrelation(df: DataFrame, x: str, lags: int = 20, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, lag, acf, bound, q): autocorrelation, white-noise bound and Ljung-Box statistic up to each lag."""
    w, steps = series(keys), range(1, lags + 1)
    rows = df.where(F.col(x).isNotNull()).select(*keys, "trade_date", (F.col(x) - F.avg(x).over(Window.partitionBy(*keys))).alias("_y"))
    rows = rows.select(*keys, "_y", *[F.lead("_y", k).over(w).alias(f"_z{k}") for k in steps])
    g = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(F.col("_y") * F.col("_y")).alias("_v"), F.array(*[F.struct(F.lit(k).alias("lag"), F.sum(F.col("_y") * F.col(f"_z{k}")).alias("_c")) for k in steps]).alias("_l"))
    out = g.select(*keys, "_n", "_v", F.explode("_l").alias("_l")).select(*keys, "_n", "_v", "_l.*").where("_c IS NOT NULL").withColumn("acf", F.try_divide(F.col("_c"), F.col("_v")))
    q = F.sum(F.col("acf") * F.col("acf") / (F.col("_n") - F.col("lag"))).over(upto(Window.partitionBy(*keys).orderBy("lag")))
    return out.select(*keys, "lag", "acf", (1.96 / F.sqrt(F.col("_n"))).alias("bound"), (F.col("_n") * (F.col("_n") + 2) * q).alias("q"))


def spectrum(df: DataFrame, x: str, n: int = 126, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, k, period, power, share) of the last n values: a Hann-windowed Fourier sum over at most n/2 frequencies."""
    last = Window.partitionBy(*keys).orderBy(F.desc("trade_date"))
    rows = df.where(F.col(x).isNotNull()).withColumn("_back", F.row_number().over(last)).where(F.col("_back") <= n)
    size = Window.partitionBy(*keys)
    rows = rows.withColumn("_n", F.count("*").over(size)).withColumn("_t", F.col("_n") - F.col("_back")).withColumn("_y", F.col(x) - F.avg(x).over(size))
    rows = rows.withColumn("_y", F.col("_y") * (0.5 - 0.5 * F.cos(2 * math.pi * F.col("_t") / F.greatest(F.col("_n") - 1, F.lit(1)))))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n // 2)))).where(F.col("k") <= F.col("_n") / 2)
    angle = 2 * math.pi * F.col("k") * F.col("_t") / F.col("_n")
    got = rows.groupBy(*keys, "k", "_n").agg(F.sum(F.col("_y") * F.cos(angle)).alias("_re"), F.sum(F.col("_y") * F.sin(angle)).alias("_im"))
    got = got.withColumn("power", F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im"))
    total = F.sum("power").over(Window.partitionBy(*keys))
    return got.select(*keys, "k", (F.col("_n") / F.col("k")).alias("period"), "power", F.when(total > 0, F.col("power") / total).alias("share"))


def top_periods(spec: DataFrame, most: int = 3, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, rank, period, share) of a spectrum: its strongest periods, equal powers by the longer one."""
    w = Window.partitionBy(*keys).orderBy(F.desc("power"), F.desc("period"))
    return spec.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(*keys, "rank", "period", "share")


def deviations(df: DataFrame, n: int = 20, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Log return, log volatility and log activity minus their n-day means; volume relative to its mean."""
    w = series(keys)
    f = roll(w, n)
    df = with_returns(df, keys=keys).withColumn("_lv", F.ln(F.greatest(F.try_divide(F.col("high"), F.col("low")) - 1, F.lit(1e-9)))).withColumn("_la", F.ln("amount"))
    dev = lambda c: F.when(F.count(c).over(f) >= n, F.col(c) - F.avg(c).over(f))
    return df.withColumns({"ret_dev": dev("lr"), "vol_dev": dev("_lv"), "act_dev": dev("_la"), "rel_volume": F.when(F.count("volume").over(f) >= n, F.try_divide(F.col("volume"), F.avg("volume").over(f)))}).drop("_lv", "_la", "r", "lr")


def composite(df: DataFrame, features: list[str]) -> DataFrame:
    """(trade_date, composite): median over codes a day (to 9 places), its percentile in history for each feature, their mean (to 12 places), its percentile again."""
    long = df.select("trade_date", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])).alias("v")).select("trade_date", "v.feature", "v.x")
    daily = long.where(F.col("x").isNotNull()).groupBy("feature", "trade_date").agg(F.round(F.percentile("x", 0.5), 9).alias("x"))
    ranked = midrank(daily, "x", "p", ("feature",)).groupBy("trade_date").agg(F.round(F.avg("p"), 12).alias("x")).withColumn("feature", F.lit("mean"))
    return midrank(ranked, "x", "composite", ("feature",)).select("trade_date", "composite")
