"""Positions from signals, gates on entries, states, and exits of open positions.

Native forms first: latches (two thresholds with memory) and runs (islands of
equal state). Rules whose next state depends on their last one in a way that
neither can say pass their sorted rows through a step that keeps that state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelforge.functions.frames import KEYS, latch, prior, roll, run_id, series, upto
from panelforge.functions.ordered import ordered_scan
from panelforge.operators import indicators as ind
from panelforge.operators.draws import uniform


def donchian_position(df: DataFrame, n: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """1 from a close above the highest of the n days before until one below their lowest."""
    f = prior(series(keys), n)
    full = F.count("close").over(f) >= n
    df = df.withColumn("_hi", F.when(full, F.max("close").over(f))).withColumn("_lo", F.when(full, F.min("close").over(f)))
    return df.withColumn("pos", latch(F.col("close") > F.col("_hi"), F.col("close") < F.col("_lo"), series(keys))).drop("_hi", "_lo")


def trailing_position(df: DataFrame, m: str, enter: float, leave: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """1 once m > enter until m <= leave or m is null (enter >= leave)."""
    if enter < leave:
        raise ValueError("enter must not lie below leave")
    return df.withColumn("pos", latch(F.col(m) > enter, F.col(m).isNull() | (F.col(m) <= leave), series(keys)))


def band_position(df: DataFrame, centre: str, width: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """1 from a close above centre + width until one below centre - width."""
    df = df.withColumn("_w", width)
    return df.withColumn("pos", latch(F.col("close") > F.col(centre) + F.col("_w"), F.col("close") < F.col(centre) - F.col("_w"), series(keys))).drop("_w")


def signed_position(df: DataFrame, up: Column, down: Column, direction: str = "both", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """-1, 0 or 1 from events; long and short keep one side and are flat otherwise."""
    event = F.when(up, 0 if direction == "short" else 1).when(down, 0 if direction == "long" else -1)
    df = df.withColumn("_e", event)
    return df.withColumn("pos", F.coalesce(F.last("_e", True).over(upto(series(keys))), F.lit(0))).drop("_e")


def bias_position(df: DataFrame, bias: str, enter: float, hot: float, cold: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """1 once bias > enter until bias >= hot or <= cold; an entry may hold above hot on its own day, so this is a loop."""

    def begin():
        state = 0.0

        def step(b):
            nonlocal state
            if b is None or b != b or (state and (b >= hot or b <= cold)):
                state = 0.0
            elif not state and b > enter:
                state = 1.0
            return (state,)

        return step

    return ordered_scan(df, [bias], {"pos": "double"}, begin, keys)


def random_entry(df: DataFrame, seed: int, chance: float, hold: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Entries drawn by a hash of seed, code and date; each holds `hold` days."""
    df = df.withColumn("_e", (uniform(seed, *keys, "trade_date") < chance).cast("int"))
    return df.withColumn("pos", F.max("_e").over(roll(series(keys), hold))).drop("_e")


def gated_entry(df: DataFrame, base: str, gate: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Positions of base that start on the first day of a run on which the gate is open; attempted and blocked mark the days."""
    w = series(keys)
    df = df.withColumn("_on", F.col(base) > 0).withColumn("_gate", F.coalesce(gate, F.lit(False)))
    df = df.withColumn("_run", run_id(F.col("_on"), w))
    in_run = Window.partitionBy(*keys, "_run").orderBy("trade_date")
    df = df.withColumn("_open", F.max("_gate").over(upto(in_run)))
    df = df.withColumn("attempted", F.col("_on") & (F.row_number().over(in_run) == 1)).withColumn("blocked", F.col("_on") & ~F.col("_open"))
    return df.withColumn("pos", F.when(F.col("_on") & F.col("_open"), F.col(base)).otherwise(0)).drop("_on", "_gate", "_run", "_open")


def gated_exit(df: DataFrame, base: str, hit: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Exit on a hit, back in the day after: inside a run of hits every second day is out."""
    w = series(keys)
    df = df.withColumn("_on", F.col(base) > 0).withColumn("_hit", F.coalesce(hit, F.lit(False)) & F.col("_on"))
    df = df.withColumn("_run", run_id(F.struct("_on", "_hit"), w))
    k = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("trade_date"))
    out = F.col("_hit") & (k % 2 == 1)
    return df.withColumn("pos", F.when(F.col("_on") & ~out, F.col(base)).otherwise(0)).drop("_on", "_hit", "_run")


def confirmed_side(df: DataFrame, side: str, confirm: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The wanted side takes effect on its run's first confirmed day; until then the last confirmed side stays."""
    w = series(keys)
    df = df.withColumn("_run", run_id(F.col(side), w)).withColumn("_ok", F.coalesce(confirm, F.lit(False)))
    df = df.withColumn("_seen", F.max("_ok").over(upto(Window.partitionBy(*keys, "_run").orderBy("trade_date"))))
    df = df.withColumn("_side", F.when(F.col("_seen"), F.col(side)))
    return df.withColumn("pos", F.coalesce(F.last("_side", True).over(upto(w)), F.lit(0))).drop("_run", "_ok", "_seen", "_side")


def range_state(df: DataFrame, er: str, adx: str, low: tuple[float, float] = (0.3, 20.0), high: tuple[float, float] = (0.45, 25.0), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """RANGE, TREND, TRANSITION or UNKNOWN (nulls) with memory between the two pairs of limits."""
    known = F.col(er).isNotNull() & F.col(adx).isNotNull()
    trend, ranging = (F.col(er) >= high[0]) & (F.col(adx) >= high[1]), (F.col(er) <= low[0]) & (F.col(adx) <= low[1])
    df = df.withColumn("_known", known).withColumn("_e", F.when(trend, "TREND").when(ranging, "RANGE")).withColumn("_seg", run_id(known, series(keys)))
    w = upto(Window.partitionBy(*keys, "_seg").orderBy("trade_date"))
    df = df.withColumn("state", F.when(~F.col("_known"), "UNKNOWN").otherwise(F.coalesce(F.last("_e", True).over(w), F.lit("TRANSITION"))))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (high[0] - F.col(er)) / (high[0] - low[0])))
    df = df.withColumn("range_score", score).withColumn("_run", run_id(F.col("state"), series(keys)))
    return df.withColumn("days", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("trade_date"))).drop("_known", "_e", "_seg", "_run")


def market_regime(df: DataFrame, slope: str, vol: str, q: float = 0.7, least: int = 60, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Direction of the slope and calm or wild volatility against its expanding quantile."""
    df = ind.with_quantiles(df, {"_cut": (vol, q, None, least)}, keys)
    direction = F.when(F.col(slope) > 0, "UP").when(F.col(slope) < 0, "DOWN").otherwise("FLAT")
    return df.withColumn("regime", F.when(F.col("_cut").isNotNull() & F.col(slope).isNotNull(), F.concat_ws("_", direction, F.when(F.col(vol) > F.col("_cut"), "WILD").otherwise("CALM")))).drop("_cut")


def volatility_regime(df: DataFrame, ratio: str, signal: str, keys: tuple[str, ...] = KEYS, reduce: float = 1.3, extreme: float = 2.0, back: float = 1.1, increase: float = 0.8) -> DataFrame:
    """FLAT, NORMAL, REDUCED, INCREASED or EXTREME; leaving a state needs another level than entering it, so this is a loop."""

    def begin():
        state = "FLAT"

        def step(x, on):
            nonlocal state
            if not on:
                state = "FLAT"
            elif x is None or x != x:
                state = "NORMAL" if state == "FLAT" else state
            elif x >= extreme:
                state = "EXTREME"
            elif x >= reduce or (state in ("REDUCED", "EXTREME") and x > back):
                state = "REDUCED"
            elif x <= increase:
                state = "INCREASED"
            else:
                state = "NORMAL"
            return (state,)

        return step

    return ordered_scan(df, [ratio, signal], {"vol_state": "string"}, begin, keys)


def index_position(df: DataFrame, move: str, q: float, n: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Long after a rise beyond the rolling quantile of absolute moves, flat after such a fall; the last one holds."""
    df = ind.with_quantiles(df.withColumn("_abs", F.abs(F.col(move))), {"_cut": ("_abs", q, n, n)}, keys)
    return df.withColumn("pos", latch(F.col(move) > F.col("_cut"), F.col(move) < -F.col("_cut"), series(keys))).drop("_abs", "_cut")


def tiered(level: str, cuts: list[Column], exposures: list[float]) -> Column:
    """Exposure by how many cuts the level passes; equal stays below; null level keeps the first."""
    passed = sum((F.coalesce((F.col(level) > c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
    return F.element_at(F.array(*[F.lit(float(e)) for e in exposures]), passed + 1)


def risk_control(df: DataFrame, signal: str, q: float, keys: tuple[str, ...] = KEYS, recover: float | None = None) -> DataFrame:
    """1 while yesterday's signal lies below its quantile over the whole sample; with `recover` out until it falls below that lower quantile."""
    own = Window.partitionBy(*keys)
    df = df.withColumn("_x", F.lag(signal).over(series(keys))).withColumn("_hi", F.percentile(signal, q).over(own))
    if recover is None:
        return df.withColumn("allowed", F.coalesce((F.col("_x") <= F.col("_hi")).cast("int"), F.lit(1))).drop("_x", "_hi")
    df = df.withColumn("_lo", F.percentile(signal, recover).over(own))
    out = latch(F.col("_x") > F.col("_hi"), F.col("_x") < F.col("_lo"), series(keys))
    return df.withColumn("allowed", 1 - out).drop("_x", "_hi", "_lo")


def with_positions(df: DataFrame, pos: str = "pos", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Add hold (number of the position, null when flat), day (from 1) and entry (open of its first day)."""
    df = df.withColumn("_on", F.col(pos) > 0).withColumn("_run", run_id(F.col("_on"), series(keys)))
    w = Window.partitionBy(*keys, "_run").orderBy("trade_date")
    df = df.withColumn("hold", F.when(F.col("_on"), F.col("_run"))).withColumn("day", F.when(F.col("_on"), F.row_number().over(w)))
    return df.withColumn("entry", F.when(F.col("_on"), F.first("open").over(upto(w)))).drop("_on", "_run")


def _position(keys: tuple[str, ...]) -> WindowSpec:
    return Window.partitionBy(*keys, "hold").orderBy("trade_date")


def stop_fill(stop: Column, mode: str = "intraday", keys: tuple[str, ...] = KEYS) -> Column:
    """Price of a long's stop on a day it is hit: the worse of stop and open; or the close; or the next open."""
    hit = F.col("low") < stop
    price = {"intraday": F.least(stop, F.col("open")), "close": F.col("close"), "next": F.lead("open").over(series(keys))}[mode]
    return F.when(hit, price)


def atr_stops(df: DataFrame, kind: str, k: float, atr: str = "atr", tighten: float = 0.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """stop in force each day of a position (set the day before), and stopped: the first day's fill; later days of the position are out.

    static: entry - k ATR at entry; trailing: the highest of close - k ATR so far;
    tightening: k falls by `tighten` for each ATR of gain.
    """
    w = _position(keys)
    df = df.withColumn("_atr0", F.first(atr).over(upto(w)))
    if kind == "static":
        df = df.withColumn("stop", F.col("entry") - k * F.col("_atr0"))
    else:
        gain = F.greatest(F.lit(0.0), F.floor(F.try_divide(F.max("close").over(upto(w)) - F.col("entry"), F.col("_atr0"))))
        width = F.greatest(F.lit(0.5), k - tighten * gain) if kind == "tightening" else F.lit(k)
        df = df.withColumn("_c", F.col("close") - width * F.col(atr))
        df = df.withColumn("_m", F.max("_c").over(upto(w)))
        df = df.withColumn("stop", F.coalesce(F.lag("_m").over(w), F.col("entry") - k * F.col("_atr0"))).drop("_c", "_m")
    df = df.withColumn("_fill", F.when(F.col("hold").isNotNull(), stop_fill(F.col("stop"), keys=keys)))
    return _first_exit(df, keys).drop("_atr0")


def _first_exit(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """From _fill: exit_price on the first day of a position with a fill; active until then."""
    w = _position(keys)
    df = df.withColumn("_before", F.count("_fill").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return df.withColumn("exit_price", F.when((F.col("_before") == 0) & F.col("hold").isNotNull(), F.col("_fill"))).withColumn("active", F.col("hold").isNotNull() & (F.col("_before") == 0)).drop("_before", "_fill")


def r_take_profit(df: DataFrame, risk: str, tiers: list[tuple[float, float]], arm: int = 2, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Exit when the profit falls back from its peak by the share of the highest tier (in R) reached; armed after `arm` sessions."""
    w = _position(keys)
    df = df.withColumn("_peak", F.max(F.try_divide(F.col("high"), F.col("entry")) - 1).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    back = F.lit(None).cast("double")
    for r, share in sorted(tiers, reverse=False):
        back = F.when(F.col("_peak") >= F.try_divide(r * F.col(risk), F.col("entry")), F.lit(share)).otherwise(back)
    df = df.withColumn("_back", back)
    line = F.col("entry") * (1 + F.col("_peak") * (1 - F.col("_back")))
    hit = (F.col("day") > arm) & F.col("_back").isNotNull() & (F.col("low") <= line)
    return _first_exit(df.withColumn("_fill", F.when(hit, F.least(line, F.col("open")))), keys).drop("_peak", "_back")


def scale_out(df: DataFrame, risk: str, tiers: list[tuple[float, float]], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """size: share of the first position left after the tiers (in R) reached so far; after the first tier a low at the entry ends it."""
    w = _position(keys)
    df = df.withColumn("_r", F.max(F.try_divide(F.col("high") - F.col("entry"), F.col(risk))).over(upto(w)))
    cut = sum((F.when(F.col("_r") >= r, share).otherwise(0.0) for r, share in tiers), F.lit(0.0))
    first = min(r for r, _ in tiers)
    df = df.withColumn("_was", F.lag("_r").over(w))
    df = df.withColumn("_back", F.max(((F.col("_was") >= first) & (F.col("low") <= F.col("entry"))).cast("int")).over(upto(w)))
    size = F.when(F.coalesce("_back", F.lit(0)) == 1, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - cut))
    return df.withColumn("size", F.when(F.col("hold").isNotNull(), size)).drop("_r", "_was", "_back")


def ma_trailing(df: DataFrame, short: str, long: str, delay: int, reduce: float = 0.5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """size: reduced from the first close under the short mean, zero from the first under the long one, after a delay."""
    w = _position(keys)
    late = F.col("day") > delay
    under = lambda m: F.max((late & (F.col("close") < F.col(m))).cast("int")).over(upto(w))
    df = df.withColumn("_s", under(short)).withColumn("_l", under(long))
    return df.withColumn("size", F.when(F.col("hold").isNotNull(), F.when(F.col("_l") == 1, 0.0).when(F.col("_s") == 1, reduce).otherwise(1.0))).drop("_s", "_l")


def arbitrated(events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Of a day's exits (share, stop) one: full before partial, then the highest stop, then the largest share."""
    w = Window.partitionBy(*keys, "trade_date").orderBy(F.desc((F.col("share") >= 1).cast("int")), F.desc("stop"), F.desc("share"))
    return events.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def budget_gate(entries: DataFrame, budget: float = 0.06, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Entries (trade_date, code, risk) admitted in order while the month's risk stays within the budget."""

    def begin():
        used = 0.0

        def step(risk):
            nonlocal used
            ok = risk is not None and used + risk <= budget + 1e-12
            used += risk if ok else 0.0
            return (ok,)

        return step

    return ordered_scan(entries.withColumn("month", F.trunc("trade_date", "month")), ["risk"], {"admitted": "boolean"}, begin, (*keys, "month"), ("trade_date", "code"))


def drawdown_sleep(df: DataFrame, r: str, limit: float, sleep: int, scale: float = 0.0, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Exposure and net value when a drawdown of the value itself beyond the limit cuts exposure for so many sessions."""

    def begin():
        nav = peak = 1.0
        left = 0

        def step(x):
            nonlocal nav, peak, left
            e = scale if left else 1.0
            nav *= 1 + e * (x or 0.0)
            left = max(0, left - 1)
            peak = nav if e < 1 and not left else max(peak, nav)
            if not left and nav / peak - 1 <= -limit:
                left, peak = sleep, nav
            return e, nav

        return step

    return ordered_scan(df, [r], {"exposure": "double", "nav": "double"}, begin, keys)


def equity_budget_stop(df: DataFrame, share: float, w: str = "w", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """stop, exit_price and active of positions whose loss may take `share` of the equity.

    The room is share / weight of the entry price, both of the day of entry; it
    stays for the position. Without a weight at entry there is no stop.
    """
    v = _position(keys)
    first = F.first(w).over(upto(v))
    df = df.withColumn("stop", F.when(F.col("hold").isNotNull() & (first > 0), F.col("entry") * (1 - share / first)))
    return _first_exit(df.withColumn("_fill", F.when(F.col("hold").isNotNull(), stop_fill(F.col("stop"), keys=keys))), keys)
