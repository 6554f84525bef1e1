"""Chains over several operators: rotation and trend portfolios, index signals, lead-lag trading, reports."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.frames import KEYS, day, roll, series, upto
from panelforge.operators import calendar as cal
from panelforge.operators import cross_section as xs
from panelforge.operators import indicators as ind
from panelforge.operators import performance as perf
from panelforge.operators import portfolio as pf

YEAR = 252

#: Categories by what a name holds, in this order; CN_EQ where none fits (fixed values: names of the market).
CATEGORIES = [
    ("BOND", ["国债ETF", "30年国债"]), ("CONVERTIBLE_BOND", ["可转债"]), ("BOND", ["债"]), ("GOLD", ["黄金", "GOLD"]), ("COMMODITY", ["豆粕", "有色", "能源化工", "商品"]), ("HK_EQ", ["恒生", "港股"]),
    ("US_EQ", ["纳指", "标普", "道琼斯"]), ("JP_EQ", ["日经", "东证", "日本"]), ("EU_EQ", ["德国", "法国", "欧洲", "EURO"]), ("EM_EQ", ["东南亚", "亚太", "新兴亚洲", "沙特", "巴西"]),
]


def category(code: Column, name: Column) -> Column:
    """Category of an instrument by keywords in its code and name; a name with US and ETF counts as US_EQ after the other words of US_EQ."""
    text = F.upper(F.concat_ws("|", F.coalesce(code, F.lit("")), F.coalesce(name, F.lit(""))))
    out = None
    for label, words in CATEGORIES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        if label == "US_EQ":
            hit = hit | (F.contains(text, F.lit("US")) & F.contains(text, F.lit("ETF")))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("CN_EQ")


def fund_events(records: DataFrame) -> DataFrame:
    """(code, effective_date, event_type, event_key, cash_dividend, split_ratio) of records (code, kind, date, amount), all text.

    kind is dividend or split; amount is cash a share, or a ratio 'a:b' or '2x'.
    Records without a readable date are left out, repeated ones are one event.
    """
    from panelforge.operators.extras import ratio_of

    date = F.coalesce(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")), F.try_to_timestamp("date", F.lit("yyyyMMdd"))).cast("date")
    value = F.when(F.col("kind") == "split", ratio_of(F.col("amount"))).otherwise(F.col("amount").try_cast("double"))
    rows = records.where(F.col("kind").isin("dividend", "split")).withColumn("effective_date", date).where("effective_date IS NOT NULL").withColumn("_v", value)
    key = F.concat_ws(":", F.when(F.col("kind") == "split", "split").otherwise("div"), F.col("effective_date").cast("string"), F.coalesce(F.col("_v").cast("string"), F.lit("-")))
    out = rows.select("code", "effective_date", F.col("kind").alias("event_type"), key.alias("event_key"), F.when(F.col("kind") == "dividend", F.col("_v")).alias("cash_dividend"), F.when(F.col("kind") == "split", F.col("_v")).alias("split_ratio"))
    return out.dropDuplicates(["code", "event_type", "event_key"])


def level_distribution(df: DataFrame, x: str, years: dict[str, int | None], least: int = 20) -> DataFrame:
    """(code, window, kind, n, low, p10, p50, p90, high, current) of levels and of their log returns over the last so many years; windows with fewer than `least` levels are left out."""
    own = Window.partitionBy("code")
    rows = df.where(F.col(x) > 0).withColumn("_lr", F.ln(F.col(x) / F.lag(x).over(series()))).withColumn("_last", F.max("trade_date").over(own))
    cells = F.array(*[F.struct(F.lit(k).alias("window"), F.lit(None if n is None else 365 * n + 10).cast("int").alias("_days")) for k, n in years.items()])
    rows = rows.withColumn("c", F.explode(cells)).select("code", "trade_date", "_last", F.col(x).alias("_x"), "_lr", "c.*").where("_days IS NULL OR trade_date >= date_sub(_last, _days)")
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("code", "window"))).where(F.col("_n") >= least)
    rows = rows.withColumn("_lr", F.when(F.row_number().over(Window.partitionBy("code", "window").orderBy("trade_date")) > 1, F.col("_lr")))  # returns inside the window
    kinds = F.array(F.struct(F.lit("level").alias("kind"), F.col("_x").alias("v")), F.struct(F.lit("log_return").alias("kind"), F.col("_lr").alias("v")))
    long = rows.withColumn("k", F.explode(kinds)).select("code", "window", "trade_date", "k.*").where("v IS NOT NULL")
    g = long.groupBy("code", "window", "kind").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.percentile("v", [0.1, 0.5, 0.9]).alias("_q"), F.max("v").alias("high"), F.max_by("v", "trade_date").alias("current"))
    return g.select("code", "window", "kind", "n", "low", F.get("_q", 0).alias("p10"), F.get("_q", 1).alias("p50"), F.get("_q", 2).alias("p90"), "high", "current")


def spectral_features(df: DataFrame, x: str, windows: list[int | None], step: int | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, trade_date, window, n, low, mid, high, entropy, top_period, top_share) of Hann-windowed spectra.

    A window is the last n values (None: all), at the end of the series and, with
    `step`, at every so many rows once full. low, mid and high are the shares of
    power at periods of 60 days or more, of 20 up to 60, and below 20. One value
    holds a window; numpy transforms those of a batch.
    """
    own = Window.partitionBy(*keys)
    rows = df.where(F.col(x).isNotNull()).withColumn("_rn", F.row_number().over(own.orderBy("trade_date"))).withColumn("_n", F.count("*").over(own))
    parts = []
    for n in windows:
        values = F.collect_list(x).over(series(keys).rowsBetween(Window.unboundedPreceding if n is None else -(n - 1), 0))
        at_end = F.col("_rn") == F.col("_n")
        at = at_end if n is None or step is None else at_end | ((F.col("_rn") >= n) & ((F.col("_rn") - n) % step == 0))
        # the window of a row is made only where it is asked for
        asked = rows.withColumn("_v", values) if n is not None else rows.groupBy(*keys).agg(F.max("trade_date").alias("trade_date"), F.transform(F.array_sort(F.collect_list(F.struct("trade_date", F.col(x).alias("v")))), lambda s: s["v"]).alias("_v"))
        asked = asked.where(at) if n is not None else asked
        parts.append(asked.select(*keys, "trade_date", F.lit(n or 0).alias("window"), "_v").where(F.size("_v") >= 8))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    n_keys = len(keys) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full((7, b.num_rows), np.nan)
            for i in range(b.num_rows):
                v = b.column(n_keys)[i].values.to_numpy(zero_copy_only=False)
                power = np.abs(np.fft.rfft((v - v.mean()) * np.hanning(len(v))))[1:] ** 2
                freq = np.arange(1, len(power) + 1) / len(v)
                total = power.sum()
                if total <= 0:
                    continue
                p = power / total
                top = int(p.argmax())
                out[:, i] = len(v), p[freq <= 1 / 60].sum(), p[(freq > 1 / 60) & (freq <= 1 / 20)].sum(), p[freq > 1 / 20].sum(), -(p * np.log(p + 1e-12)).sum() / np.log(len(p) + 1e-12), 1 / freq[top], p[top]
            cols = [pa.array(c, mask=np.isnan(c)) for c in out]
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keys], cols[0].cast(pa.int32()), *cols[1:]], [*keys, "trade_date", "window", "n", "low", "mid", "high", "entropy", "top_period", "top_share"])

    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in (*keys, "trade_date"))
    return long.mapInArrow(run, f"{types}, window int, n int, low double, mid double, high double, entropy double, top_period double, top_share double")


def index_signal(df: DataFrame, r: str, window: int = 252, q: float = 0.8, least_move: float = 0.0, cost_bps: float = 5.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows (idx_close known before the day, r earned from the day on) with position, turnover and three net values.

    A rise of the index beyond the quantile of its absolute log moves so far
    (at least 20, of the last `window` days) asks for cash, a fall for the
    holding; else the last position stays, the first is long. A change costs;
    the last day neither trades nor earns.
    """
    w = series(keys)
    d = df.withColumn("_m", F.ln(F.col("idx_close") / F.lag("idx_close").over(w))).withColumn("_abs", F.abs("_m"))
    d = ind.with_quantiles(d, {"_cut": ("_abs", q, window, 20)}, keys)
    active = (F.col("_abs") >= F.greatest(F.col("_cut"), F.lit(least_move))) & F.col("_cut").isNotNull()
    d = d.withColumn("_e", F.when(active & (F.col("_m") > 0), 0).when(active, 1)).withColumn("pos", F.coalesce(F.last("_e", True).over(upto(w)), F.lit(1)))
    d = d.withColumn("_end", F.lead("trade_date").over(w).isNull())
    d = d.withColumn("turnover", F.when(F.col("_end"), 0.0).otherwise(F.coalesce(F.abs(F.col("pos") - F.lag("pos").over(w)), F.lit(0)).cast("double")))
    x = F.when(F.col("_end"), 0.0).otherwise(F.coalesce(F.col(r), F.lit(0.0)))
    d = d.withColumn("_b", 1 + x).withColumn("_s", (1 - cost_bps / 10_000 * F.col("turnover")) * (1 + F.col("pos") * x))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    nav = lambda c: F.coalesce(F.product(c).over(before), F.lit(1.0))
    d = d.withColumn("nav_strategy", nav("_s")).withColumn("nav_buy_hold", nav("_b")).withColumn("_x", 1 + F.col("_s") - F.col("_b")).withColumn("nav_excess", nav("_x"))
    return d.drop("_m", "_abs", "_cut", "_e", "_end", "_b", "_s", "_x")


def shifted_by(df: DataFrame, x: str, out: str, lags: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """df with x of `lag` rows before (after, if negative), the lag of each key from a table of one row a key."""
    rows = df.join(lags.select(*keys, "lag").hint("merge"), list(keys)).withColumn("_rn", F.row_number().over(series(keys)))
    back = rows.select(*keys, (F.col("_rn") + F.col("lag")).alias("_rn"), F.col(x).alias(out))
    return rows.join(back.hint("merge"), [*keys, "_rn"], "left").drop("_rn")


def hit_table(df: DataFrame, y: str, sig: str, corr: str = "corr", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Hits of the sign of a leading series (turned where corr is below zero): counts, rate, and y after its rises and falls."""
    pred = F.signum(F.col(sig)) * F.when(F.col(corr) > 0, 1).otherwise(-1)
    ok = (F.col(sig) != 0) & (F.col(y) != 0)
    up, was = pred > 0, F.col(y) > 0
    cell = lambda c: F.sum((ok & c).cast("int"))
    rise, fall = F.when(F.col(sig) > 0, F.col(y)), F.when(F.col(sig) < 0, F.col(y))
    both = df.where(F.col(sig).isNotNull() & F.col(y).isNotNull())
    g = both.groupBy(*keys).agg(cell(up & was).alias("tp"), cell(up & ~was).alias("fp"), cell(~up & was).alias("fn"), cell(~up & ~was).alias("tn"), F.avg(rise).alias("mean_rise"), F.percentile(rise, 0.5).alias("median_rise"), F.avg(fall).alias("mean_fall"), F.percentile(fall, 0.5).alias("median_fall"))
    return g.withColumn("hit_rate", F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def hold_last(df: DataFrame, r: str, sig: str, corr: str, cut: str | None, cost_bps: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Exposure 1 or 0 by the sign of a leading series, held where it stays below `cut` (a column) in size; first day invested; net return `x`.

    Days without a signal, and the day after one, have no exposure change and are left out.
    """
    w = series(keys)
    pred = F.signum(F.col(sig)) * F.when(F.col(corr) > 0, 1).otherwise(-1)
    active = F.col(sig).isNotNull() if cut is None else F.abs(F.col(sig)) >= F.col(cut)
    d = df.withColumn("_e", F.when(active & F.col(sig).isNotNull(), (pred >= 0).cast("int")))
    d = d.withColumn("exposure", F.when(F.col(sig).isNotNull(), F.coalesce(F.last("_e", True).over(upto(w)), F.lit(1))))
    turn = F.when(F.row_number().over(w) == 1, 0).otherwise(F.abs(F.col("exposure") - F.lag("exposure").over(w)))
    d = d.withColumn("x", F.col("exposure") * F.col(r) - turn * cost_bps / 10_000)
    return d.where("x IS NOT NULL").drop("_e")


def tier_timing(df: DataFrame, r: str, level: str, qs: list[float], exposures: list[float], cost_bps: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Exposure by how many quantiles (of the whole sample) the level passes; net return `x` a day."""
    from panelforge.operators.signals import tiered

    w = series(keys)
    own = Window.partitionBy(*keys)
    d = df.where(F.col(level).isNotNull()).withColumns({f"_q{k}": F.percentile(level, q).over(own) for k, q in enumerate(qs)})
    d = d.withColumn("exposure", tiered(level, [F.col(f"_q{k}") for k in range(len(qs))], exposures))
    turn = F.coalesce(F.abs(F.col("exposure") - F.lag("exposure").over(w)), F.lit(0.0))
    return d.withColumn("x", F.col("exposure") * F.col(r) - turn * cost_bps / 10_000).where("x IS NOT NULL").drop(*[f"_q{k}" for k in range(len(qs))])


def day_scores(df: DataFrame, x: str, keys: tuple[str, ...], more: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Days, mean, annualised Sharpe ratio and compounded return of daily returns x, and what `more` makes of them (name -> function of the column to an aggregate)."""
    extra = [f(F.col(x)).alias(name) for name, f in (more or {}).items()]
    g = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("_s"), (F.product(1 + F.col(x)) - 1).alias("total"), *extra)
    return g.withColumn("sharpe", perf.safe(F.col("mean"), F.col("_s")) * math.sqrt(YEAR)).drop("_s")


def rotation(panel: DataFrame, days: DataFrame, k: int, period: str = "W", vol_cap: float = 1.0, vol_stop: float = 10.0, stop_atr: float = 3.0, cost: dict[str, float] | None = None, default_bps: float = 5.0, cash: DataFrame | None = None, group: str = "grp") -> tuple[DataFrame, DataFrame]:
    """The rotation chain: (days, weights).

    panel has code, trade_date, OHLC, r, score, above (the code's own trend filter),
    vol, atr and a group. On each decision day: no picks where no code is above
    its filter (cash rule); else codes that pass it, the best of each group, the
    k best by score; inverse-vol weights, scaled to the vol cap by the picks' mean
    vol and to nothing beyond vol_stop. From the next session through the next
    decision the weights hold; a low under entry - stop_atr * ATR of the decision
    takes a code out from the day after, to the next decision. The rest earns
    the cash series; costs are by code, on both sides.
    """
    ends = cal.period_ends(days, period)
    at = panel.join(ends.select(F.col("decision_date").alias("trade_date")).hint("merge"), "trade_date", "left_semi")
    at = at.withColumn("_risk_off", xs.cash_rule(F.col("above"))).where("NOT _risk_off AND above AND score IS NOT NULL AND vol IS NOT NULL")
    best = xs.one_per_group(at, group, [F.desc("score")])
    chosen = xs.picks(best, "score", k).withColumn("w", pf.inverse_vol("vol")).withColumn("_mean", F.avg("vol").over(day()))
    chosen = chosen.withColumn("w", F.col("w") * pf.vol_target("_mean", vol_cap, vol_stop)).select(F.col("trade_date").alias("decision_date"), "code", "w", (F.col("close") - stop_atr * F.col("atr")).alias("stop"))
    grid = panel.join(cal.held(days, ends).hint("merge"), "trade_date")
    rows = grid.join(chosen.hint("merge"), ["decision_date", "code"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    hit = (F.col("low") < F.col("stop")).cast("int")
    gone = F.coalesce(F.max(hit).over(Window.partitionBy("code", "decision_date").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("w", F.when(gone == 1, 0.0).otherwise(F.col("w")))
    bps = F.lit(default_bps)
    for code, x in (cost or {}).items():
        bps = F.when(F.col("code") == code, x).otherwise(bps)
    rows = rows.withColumn("_t", pf.turnover("w")).withColumn("_c", F.col("_t") * 2 * bps / 10_000)
    daily = rows.groupBy("trade_date").agg(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("gross"), F.sum("_t").alias("turnover"), F.sum("_c").alias("cost"), F.sum("w").alias("sum_w"))
    daily = daily.withColumn("r", F.col("gross") - F.col("cost"))
    return (pf.with_cash(daily, cash) if cash is not None else daily), rows.select("code", "trade_date", "decision_date", "w")


def trend(panel: DataFrame, entry_gate: Column, budget: float, stop_atr: float, tiers: list[tuple[float, float]], cost_bps: float = 5.0, cap: float = 1.0) -> DataFrame:
    """The trend chain: (trade_date, gross, turnover, sum_w, r) of a panel with base (position signal), OHLC, r and atr.

    Positions of the signal that start with the gate open; a trailing stop of
    stop_atr ATR and a take profit by tiers, of which the first to fill ends the
    position; sizes by risk budget at the entry's ATR, scaled to the cap in sum;
    weights act from the day after; half of the change in weights costs twice the bps.
    """
    from panelforge.operators import extras as ex
    from panelforge.operators import signals as sig

    p = sig.gated_entry(panel, "base", entry_gate).drop("attempted", "blocked")
    p = sig.with_positions(p)
    rows = sig.atr_stops(p, "trailing", stop_atr).withColumnRenamed("active", "_a").drop("stop", "exit_price")
    rows = sig.r_take_profit(rows, "atr", tiers).withColumnRenamed("active", "_b").drop("exit_price")
    first = Window.partitionBy("code", "hold").orderBy("trade_date")
    atr0 = F.first("atr").over(first.rowsBetween(Window.unboundedPreceding, 0))
    size = F.when(F.col("hold").isNotNull() & F.col("_a") & F.col("_b"), F.when(atr0 > 0, F.least(F.lit(cap), budget * F.col("entry") / atr0)).otherwise(0.0)).otherwise(0.0)
    sized = ex.over_cap(rows.withColumn("w", size).withColumn("score", F.col("close")), "scale", cap)
    held = sized.withColumn("w", F.coalesce(F.lag("w").over(series()), F.lit(0.0))).withColumn("_t", pf.turnover("w"))
    daily = held.groupBy("trade_date").agg(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("gross"), F.sum("_t").alias("turnover"), F.sum("w").alias("sum_w"))
    return daily.withColumn("r", F.col("gross") - F.col("turnover") * 2 * cost_bps / 10_000)


def sleeves(df: DataFrame, cost_bps: float = 5.0) -> DataFrame:
    """(anchor, trade_date, gross, turnover, r): equal weights that drift and are reset each week, for each anchor weekday."""
    b = df.withColumn("anchor", F.explode(F.array(*[F.lit(a) for a in cal.ANCHORS])))
    label = F.coalesce(*[F.when(F.col("anchor") == a, cal.label("trade_date", "W", a)) for a in cal.ANCHORS])
    b = b.withColumn("period", label).withColumn("w0", 1.0 / F.count("*").over(Window.partitionBy("anchor", "trade_date")))
    return pf.net(pf.drifted(b, "period", keys=("anchor",)), cost_bps=cost_bps, keys=("anchor",))


def report(navs: DataFrame, benchmark: str) -> DataFrame:
    """(series, metric, value) of net values (strategy, trade_date, nav): the bundle of metrics, monthly win statistics and the information ratio against one of the series."""
    bundle = perf.metrics(navs)
    monthly = cal.resampled(navs.select(F.col("strategy").alias("code"), "trade_date", *[F.col("nav").alias(c) for c in ("open", "high", "low", "close", "volume")]), "M")
    wins = perf.win_stats(monthly.withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(series(order="label"))) - 1), "r", ("code",)).withColumnRenamed("code", "strategy")
    r = navs.withColumn("_r", F.try_divide(F.col("nav"), F.lag("nav").over(series(("strategy",)))) - 1)
    b = r.where(F.col("strategy") == benchmark).select("trade_date", F.col("_r").alias("_b"))
    info = perf.information_ratio(r.join(b.hint("merge"), "trade_date").where("_r IS NOT NULL AND _b IS NOT NULL"), "_r", "_b", ("strategy",))
    long = lambda d, names: d.select("strategy", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("strategy", "m.*")
    out = long(bundle, ["total", "annual", "vol", "sharpe", "sortino", "max_drawdown", "max_under_water", "ulcer", "calmar"])
    return out.unionByName(long(wins, ["win_rate", "payoff", "kelly"])).unionByName(long(info, ["information_ratio"]))


def walk_forward_runs(grid: DataFrame, years: int, radius: float, keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(choices, stitched) of daily returns (keys, param, trade_date, x).

    For each year the parameter is chosen on the `years` calendar years before
    it: the best mean of the training Sharpe ratios of its neighbours within
    `radius` (ties to the smaller), so that a lone peak does not win. The next
    year's returns of the choices are strung together and compounded.
    """
    daily = grid.withColumn("year", F.year("trade_date").cast("long"))
    sums = daily.groupBy(*keys, "param", "year").agg(F.count("x").alias("_n"), F.sum("x").alias("_s"), F.sum(F.col("x") * F.col("x")).alias("_q"))
    w = Window.partitionBy(*keys, "param").orderBy("year").rangeBetween(-years, -1)
    n, s, q = (F.sum(c).over(w) for c in ("_n", "_s", "_q"))
    span = F.count("*").over(w)
    var = (q - s * s / n) / (n - 1)
    train = sums.withColumn("train", F.when((span >= years) & (n > 1) & (var > 1e-18), s / n / F.sqrt(var) * math.sqrt(YEAR))).where("train IS NOT NULL").select(*keys, "param", "year", "train")
    by = Window.partitionBy(*keys, "year").orderBy("param").rangeBetween(-radius, radius)
    robust = train.withColumn("robust", F.round(F.avg("train").over(by), 9))
    best = Window.partitionBy(*keys, "year").orderBy(F.desc("robust"), "param")
    choices = robust.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
    run = daily.join(choices.hint("merge"), [*keys, "param", "year"]).select(*keys, "trade_date", "param", "x")
    return choices, run.withColumn("nav", F.product(1 + F.coalesce("x", F.lit(0.0))).over(upto(series(keys))))


def futures_rotation(contracts: DataFrame, n: int, k: int, side: str, warm_up: int, vol_n: int = 6) -> DataFrame:
    """(root, trade_date, r): the k best (long), worst (short) or both sides by trailing return inside each root, inverse-vol weights, after a warm-up of rows."""
    w = Window.partitionBy("root", "contract").orderBy("trade_date")
    m = contracts.withColumn("_r", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).withColumn("score", F.try_divide(F.col("close"), F.lag("close", n).over(w)) - 1)
    f = roll(w, vol_n)
    m = m.withColumn("vol", F.when(F.count("_r").over(f) >= 3, F.stddev_samp("_r").over(f))).withColumn("fwd", F.try_divide(F.lead("close").over(w), F.col("close")) - 1)
    m = m.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") > warm_up) & F.col("score").isNotNull() & (F.col("vol") > 0) & F.col("fwd").isNotNull())
    legs = []
    for sign in {"long": (1,), "short": (-1,), "both": (1, -1)}[side]:
        top = xs.picks(m, "score", sign * k, ("root",))
        legs.append(top.withColumn("w", sign * pf.inverse_vol("vol", ("root",))))
    rows = legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1])
    return rows.groupBy("root", "trade_date").agg((F.sum(F.col("w") * F.col("fwd")) / len(legs)).alias("r"))
