"""Smaller operators: price adjustment, rule tables, repo lending, attribution, sampling of factors, roll metadata."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.frames import series, upto
from panelforge.functions.ordered import ordered_scan
from panelforge.operators.calendar import on_days

#: Names of comparisons and what they mean (fixed values).
COMPARISONS = {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "=", "ne": "<>"}


def compare(name: str, a: Column, b: Column) -> Column:
    """Comparison by name or symbol."""
    op = COMPARISONS.get(name, name)
    ops = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "=": a == b, "<>": a != b}
    if op not in ops:
        raise ValueError(f"unknown comparison {name!r}")
    return ops[op]


def at_least(passes: list[Column], n: int = 0) -> Column:
    """At least n of the passes hold; 0 asks for all."""
    total = sum((F.coalesce(p, F.lit(False)).cast("int") for p in passes), F.lit(0))
    return total >= (n or len(passes))


def ratio_of(text: Column) -> Column:
    """'a:b' gives b / a, '2x' or a number gives itself, else null."""
    a, b = F.regexp_extract(text, r"^\s*([\d.]+)\s*:\s*([\d.]+)\s*$", 1), F.regexp_extract(text, r"^\s*([\d.]+)\s*:\s*([\d.]+)\s*$", 2)
    single = F.regexp_extract(text, r"^\s*([\d.]+)\s*[x×]?\s*$", 1)
    number = lambda c: c.try_cast("double")
    return F.coalesce(F.try_divide(number(b), number(a)), number(single))


def cash_adjusted(df: DataFrame, events: DataFrame) -> DataFrame:
    """hfq = price plus cash paid so far; qfq = hfq scaled so that the last closes agree. Events (code, trade_date, cash)."""
    e = events.groupBy("code", "trade_date").agg(F.sum("cash").alias("_c"))
    j = df.join(e.hint("merge"), ["code", "trade_date"], "left")
    j = j.withColumn("hfq", F.col("close") + F.coalesce(F.sum("_c").over(upto(series())), F.lit(0.0))).drop("_c")
    own = Window.partitionBy("code")
    return j.withColumn("qfq", F.col("hfq") * F.try_divide(F.max_by("close", "trade_date").over(own), F.max_by("hfq", "trade_date").over(own)))


def accumulated_adjusted(df: DataFrame) -> DataFrame:
    """From unit and accumulated value: hfq = the accumulated one, qfq = it over its last ratio; the unit itself where it is missing."""
    own = Window.partitionBy("code")
    ratio = F.try_divide(F.col("accum"), F.col("unit"))
    df = df.withColumn("_r", ratio).withColumn("_last", F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("trade_date"))).over(own))
    return df.withColumn("hfq", F.coalesce("accum", "unit")).withColumn("qfq", F.coalesce(F.try_divide(F.col("accum"), F.col("_last")), "unit")).drop("_r", "_last")


def stitched(segments: DataFrame, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Out-of-sample returns (keys, segment, trade_date, r) as one: the latest segment wins on a date; recompounded."""
    one = segments.groupBy(*keys, "trade_date").agg(F.max_by("r", "segment").alias("r"))
    w = Window.partitionBy(*keys).orderBy("trade_date")
    return one.withColumn("nav", F.product(1 + F.col("r")).over(upto(w)))


def factor_overlaps(df: DataFrame, factors: list[str]) -> DataFrame:
    """(mask, n): rows in which all factors of a subset have values, all subsets (at most 256) in one pass."""
    if len(factors) > 8:
        raise ValueError("at most eight factors")
    have = sum((F.when(F.col(f).isNotNull(), 1 << k).otherwise(0) for k, f in enumerate(factors)), F.lit(0))
    masks = df.select(have.alias("_m")).groupBy("_m").count()
    subsets = masks.withColumn("mask", F.explode(F.sequence(F.lit(1), F.lit((1 << len(factors)) - 1))))
    return subsets.where(F.col("_m").bitwiseAND(F.col("mask")) == F.col("mask")).groupBy("mask").agg(F.sum("count").alias("n"))


def next_session_signal(us: DataFrame, days: DataFrame, value: str) -> DataFrame:
    """Closes of another market on the first session after them; of several on one session the last wins."""
    from panelforge.operators.calendar import snapped

    t = us.select(F.date_add("trade_date", 1).alias("target_date"), F.col("trade_date").alias("_from"), value)
    on = snapped(t.select("target_date").distinct(), days, "next").select("target_date", "session")
    return t.join(on.hint("merge"), "target_date").groupBy(F.col("session").alias("trade_date")).agg(F.max_by(value, "_from").alias(value), F.max("_from").alias("from_date"))


def repo_interest(details: DataFrame, days: DataFrame) -> DataFrame:
    """Daily accrual of lending (id, principal, rate_pct, start, interest_days, basis): principal * rate / basis on each day held."""
    d = details.withColumn("_end", F.date_add("start", F.col("interest_days").cast("int")))
    j = on_days(d, days, "start", "_end").withColumnRenamed("trade_date", "_d")
    gap = F.least(F.coalesce(F.lead("_d").over(Window.partitionBy("id").orderBy("_d")), F.col("_end")), F.col("_end"))
    return j.select("id", F.col("_d").alias("trade_date"), (F.col("principal") * F.col("rate_pct") / 100 * F.datediff(gap, F.col("_d")) / F.col("basis")).alias("interest"))


def money_weighted(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(code, pnl, share): profit of an account by code: (value before + contribution) * w * r, over what was invested."""
    invested = df.groupBy("trade_date").agg(F.first("c").alias("c")).agg(F.sum("c").alias("_i"))  # one row
    p = df.groupBy("code").agg(F.sum((F.col("nav_before") + F.col("c")) * F.col("w") * F.coalesce("r", F.lit(0.0))).alias("pnl"))
    return p.crossJoin(F.broadcast(invested)).select("code", "pnl", F.try_divide(F.col("pnl"), F.col("_i")).alias("share"))


def excursions(rows: DataFrame, risk: float) -> DataFrame:
    """(code, trade, mfe, mfe_r) of bars numbered by trade (with_trades): highest high while held over the open of the first day, and in units of risk."""
    g = rows.where("held").groupBy("code", "trade").agg((F.max("high") / F.min_by("open", "trade_date") - 1).alias("mfe"))
    return g.withColumn("mfe_r", F.col("mfe") / risk)


def roll_metadata(contracts: DataFrame, switches: DataFrame) -> DataFrame:
    """Switches with open and close of both legs on the day."""
    bar = lambda s: contracts.select("root", F.col("contract").alias(f"{s}_contract"), "trade_date", F.col("open").alias(f"{s}_open"), F.col("close").alias(f"{s}_close"))
    return switches.join(bar("from").hint("merge"), ["root", "from_contract", "trade_date"], "left").join(bar("to").hint("merge"), ["root", "to_contract", "trade_date"], "left")


def over_cap(df: DataFrame, policy: str, cap: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Weights above the cap in sum: scale them all, or skip, in order of score, each that no longer fits beside those kept.

    For rules that carry positions from date to date see admission.admitted().
    """
    xs = Window.partitionBy(*keys, "trade_date")
    if policy == "scale":
        total = F.sum("w").over(xs)
        return df.withColumn("w", F.col("w") / F.greatest(F.lit(1.0), total / cap))
    if policy != "skip":
        raise ValueError(f"unknown policy {policy!r}")
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by"), "code", "w")))  # a date's universe

    def admit(acc, x):
        fits = acc["total"] + x["w"] <= cap + 1e-12
        return F.struct(F.when(fits, acc["total"] + x["w"]).otherwise(acc["total"]).alias("total"), F.when(fits, F.concat(acc["kept"], F.array(x["code"]))).otherwise(acc["kept"]).alias("kept"))

    code = df.schema["code"].dataType.simpleString()
    start = F.struct(F.lit(0.0).alias("total"), F.array().cast(f"array<{code}>").alias("kept"))
    kept = df.groupBy(*keys, "trade_date").agg(F.aggregate(rows, start, admit)["kept"].alias("_kept"))
    return df.join(kept.hint("merge"), [*keys, "trade_date"]).withColumn("w", F.when(F.array_contains("_kept", F.col("code")), F.col("w")).otherwise(0.0)).drop("_kept").select(*df.columns)


def dynamic_equal(df: DataFrame, least: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Equal weights over codes with a return on the date; cash where fewer than `least` have one."""
    n = F.count("r").over(Window.partitionBy(*keys, "trade_date"))
    return df.withColumn("w", F.when(F.col("r").isNotNull() & (n >= least), 1.0 / n).otherwise(0.0))


def mode_or_median(draws: DataFrame, value: str, how: str, keys: tuple[str, ...]) -> DataFrame:
    """One parameter a key from many draws; the median is snapped to the nearest drawn value, the mode's ties to the smaller."""
    if how == "mode":
        w = Window.partitionBy(*keys).orderBy(F.desc("count"), value)
        return draws.groupBy(*keys, value).count().withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*keys, value)
    mid = F.percentile(value, 0.5).over(Window.partitionBy(*keys))
    near = draws.withColumn("_d", F.abs(F.col(value) - mid))
    return near.groupBy(*keys).agg(F.min(F.struct("_d", value)).alias("m")).select(*keys, f"m.{value}")


def bias_take_profit(df: DataFrame, ma: str, atr: str, tiers: list[tuple[float, float]], keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """size and fill of a position (columns hold, entry) that sells shares at lines of tiers above a mean.

    A tier's line is mean + k * ATR of the day before and never falls inside a
    position; it is reached when the high touches it, at the better of line and
    open; each tier takes its share of the first size once.
    """
    w = Window.partitionBy(*keys, "hold").orderBy("trade_date")
    df = df.withColumn("_ma", F.lag(ma).over(w)).withColumn("_atr", F.lag(atr).over(w))
    for k, (level, _) in enumerate(tiers):
        df = df.withColumn(f"_l{k}", F.max(F.col("_ma") + level * F.col("_atr")).over(upto(w)))
        df = df.withColumn(f"_h{k}", F.max((F.col("high") >= F.col(f"_l{k}")).cast("int")).over(upto(w)))
        df = df.withColumn(f"_n{k}", (F.col(f"_h{k}") == 1) & (F.coalesce(F.lag(f"_h{k}").over(w), F.lit(0)) == 0))
    gone = sum((F.coalesce(F.col(f"_h{k}"), F.lit(0)) * share for k, (_, share) in enumerate(tiers)), F.lit(0.0))
    fills = [F.when(F.col(f"_n{k}"), F.greatest(F.col(f"_l{k}"), F.col("open"))) for k in range(len(tiers))]
    df = df.withColumn("size", F.greatest(F.lit(0.0), 1 - gone)).withColumn("fill", F.greatest(*fills) if len(fills) > 1 else fills[0])
    return df.drop("_ma", "_atr", *[f"_{c}{k}" for c in "lhn" for k in range(len(tiers))])


def stop_plan(df: DataFrame, stop: str, slippage: float) -> DataFrame:
    """Each code's last row if it is held: the stop for the next day and the fill that it expects."""
    last = df.groupBy("code").agg(F.max_by(F.struct("trade_date", "hold", stop, "close"), "trade_date").alias("l")).select("code", "l.*")
    return last.where("hold IS NOT NULL").select("code", "trade_date", stop, "close", (F.col(stop) * (1 - slippage)).alias("expected_fill"))


def own_return_sizing(df: DataFrame, r: str, n: int, cuts: list[float], exposures: list[float], keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Exposure by the strategy's own return over its last n sessions, itself scaled; a task keeps n values."""

    def begin():
        navs = deque([1.0], maxlen=n + 1)

        def step(x):
            past = navs[-1] / navs[0] - 1
            e = exposures[sum(past > c for c in cuts)]
            navs.append(navs[-1] * (1 + e * (x or 0.0)))
            return e, navs[-1]

        return step

    return ordered_scan(df, [r], {"exposure": "double", "nav": "double"}, begin, keys)


def correlation_gate(decisions: DataFrame, pairs: DataFrame, limit: float, k: int) -> DataFrame:
    """Held codes by decision: a new code enters only if no correlation with the held ones passes the limit.

    Rows (strategy, trade_date, code, place) of candidates and (a, b, corr); a group is one strategy's candidates.
    """
    both = pairs.select("a", "b", "corr").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).where(F.abs("corr") > limit)
    near = both.groupBy(F.col("a").alias("code")).agg(F.collect_set("b").alias("near"))
    rows = decisions.join(near.hint("merge"), "code", "left").select("strategy", "trade_date", "code", "place", F.coalesce("near", F.array().cast("array<string>")).alias("near"))

    def walk(pdf):
        import pandas as pd

        held, out = [], []
        for date, g in pdf.sort_values(["trade_date", "place"]).groupby("trade_date", sort=True):
            there = set(g["code"])
            held = [c for c in held if c in there]
            for c, close in zip(g["code"], g["near"], strict=True):
                if len(held) < k and c not in held and not set(held) & set(close):
                    held.append(c)
            out += [(g["strategy"].iloc[0], date, c) for c in held]
        return pd.DataFrame(out, columns=["strategy", "trade_date", "code"])

    return rows.groupBy("strategy").applyInPandas(walk, "strategy string, trade_date date, code string")


def marked(positions: DataFrame, prices: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Equity, peak and drawdown of stored positions (cash, JSON map of code to quantity) at the day's prices."""
    held = positions.select(*keys, "trade_date", "cash", F.explode_outer(F.from_json("positions", "map<string,double>")).alias("code", "quantity"))
    j = held.join(prices.select("code", "trade_date", "close").hint("merge"), ["code", "trade_date"], "left")
    e = j.groupBy(*keys, "trade_date").agg((F.first("cash") + F.coalesce(F.sum(F.col("quantity") * F.col("close")), F.lit(0.0))).alias("equity"))
    peak = F.max("equity").over(upto(Window.partitionBy(*keys).orderBy("trade_date")))
    return e.withColumn("peak", peak).withColumn("drawdown", F.try_divide(F.col("equity"), F.col("peak")) - 1)


def attributed(days: DataFrame) -> DataFrame:
    """Daily parts of a return: selection (w - wb) * (r - rb), position wb-weighted, cost, cash drag, and timing as what is left.

    Rows (trade_date, code, w, wb, r, cost, total), total being the account's return of the day.
    """
    b = F.sum(F.col("wb") * F.coalesce("r", F.lit(0.0))).over(Window.partitionBy("trade_date"))
    g = days.withColumn("_b", b).groupBy("trade_date").agg(
        F.sum((F.col("w") - F.col("wb")) * (F.coalesce("r", F.lit(0.0)) - F.col("_b"))).alias("selection"), F.first("_b").alias("position"), (-F.sum("cost")).alias("cost"),
        ((F.sum("w") - 1) * F.first("_b")).alias("cash_drag"), F.first("total").alias("total"),
    )
    return g.withColumn("timing", F.col("total") - F.col("selection") - F.col("position") - F.col("cost") - F.col("cash_drag"))


def missing_keys(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Values of a column that the known keys lack, with their number of rows."""
    return rows.where(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)).distinct().hint("merge"), column, "left_anti").groupBy(column).agg(F.count("*").alias("n"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def r_multiples(trades: DataFrame, bars: DataFrame, k: float, buffer: float) -> DataFrame:
    """Trades with the first risk (k ATR of the entry day over the entry price, plus a buffer) and the result in its units."""
    at = bars.select("code", F.col("trade_date").alias("entry_date"), F.col("open").alias("entry"), "atr")
    j = trades.join(at.hint("merge"), ["code", "entry_date"])
    risk = k * F.try_divide(F.col("atr"), F.col("entry")) + buffer
    return j.withColumn("risk", risk).withColumn("r_multiple", F.try_divide(F.col("ret"), F.col("risk")))


def continuous_of(pool: DataFrame, prices: DataFrame, suffix: str = "889") -> DataFrame:
    """Rows of each pool code's continuous series: the letters of the code and the suffix name the series."""
    named = pool.select("code", F.concat(F.regexp_extract("code", r"^([A-Za-z]+)", 1), F.lit(suffix)).alias("_series"))
    return named.join(prices.withColumnRenamed("code", "_series").hint("merge"), "_series").drop("_series")


def signal_and_execution(adjusted: DataFrame, raw: DataFrame) -> DataFrame:
    """Adjusted bars for signals beside raw bars for execution, on the dates that both have."""
    ex = raw.select("code", "trade_date", *[F.col(c).alias(f"exec_{c}") for c in ("open", "close")])
    return adjusted.join(ex.hint("merge"), ["code", "trade_date"])
