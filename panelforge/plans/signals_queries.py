"""Queries G and E: positions, gates, states and exits."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.frames import roll, series
from panelforge.operators import indicators as ind
from panelforge.operators import signals as sig
from panelforge.operators.reentry import MODES, AtrStop, RTakeProfit, with_exits
from panelforge.operators.draws import uniform_sql
from panelforge.plans.indicators_queries import ADX, NUMBERED, RET, W, ema_sql, frame
from panelforge.plans.registry import query
from panelforge.plans.views import BARS, bars

UPTO = "(PARTITION BY code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
P20 = "(PARTITION BY code ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
DON = f"{BARS}, h AS (SELECT *, CASE WHEN count(close) OVER {P20} >= 20 THEN max(close) OVER {P20} END AS hi, CASE WHEN count(close) OVER {P20} >= 20 THEN min(close) OVER {P20} END AS lo FROM bars), d AS (SELECT *, coalesce(last_value(CASE WHEN close > hi THEN 1 WHEN close < lo THEN 0 END IGNORE NULLS) OVER {UPTO}, 0)::INT AS pos FROM h)"


def donchian(spark, d):
    return sig.donchian_position(bars(spark, d), 20)


@query("g01_ma_signals", f"WITH {BARS} SELECT code, trade_date, close > avg(close) OVER {frame(20)} AS above, avg(close) OVER {frame(10)} > avg(close) OVER {frame(40)} AS crossed FROM bars")
def g01(spark, d):
    ma = lambda n: F.avg("close").over(roll(series(), n))
    return bars(spark, d).select("code", "trade_date", (F.col("close") > ma(20)).alias("above"), (ma(10) > ma(40)).alias("crossed"))


@query("g02_donchian", f"WITH {DON} SELECT code, trade_date, pos FROM d")
def g02(spark, d):
    return donchian(spark, d).select("code", "trade_date", "pos")


@query("g03_trailing_position", f"WITH {BARS}, m AS (SELECT *, close / lag(close, 20) OVER w - 1 AS mom FROM bars {W}) SELECT code, trade_date, coalesce(last_value(CASE WHEN mom > 0.1 THEN 1 WHEN mom IS NULL OR mom <= -0.05 THEN 0 END IGNORE NULLS) OVER {UPTO}, 0)::INT AS pos FROM m")
def g03(spark, d):
    m = bars(spark, d).withColumn("mom", F.col("close") / F.lag("close", 20).over(series()) - 1)
    return sig.trailing_position(m, "mom", 0.1, -0.05).select("code", "trade_date", "pos")


@query("g04_band_position", f"WITH {BARS}, m AS (SELECT *, avg(close) OVER {frame(20)} AS c, stddev_pop(close) OVER {frame(20)} AS s FROM bars) SELECT code, trade_date, coalesce(last_value(CASE WHEN close > c + s THEN 1 WHEN close < c - s THEN 0 END IGNORE NULLS) OVER {UPTO}, 0)::INT AS pos FROM m")
def g04(spark, d):
    f = roll(series(), 20)
    df = bars(spark, d).withColumn("centre", F.avg("close").over(f)).withColumn("sd", F.stddev_pop("close").over(f))
    return sig.band_position(df, "centre", F.col("sd")).select("code", "trade_date", "pos")


@query("g05_bias_position", f"""WITH RECURSIVE {BARS}, x AS MATERIALIZED (SELECT code, trade_date, close, close / avg(close) OVER {frame(20)} - 1 AS bias, row_number() OVER w AS rn FROM bars {W}), s AS (SELECT code, rn, CASE WHEN bias > 0.1 THEN 1 ELSE 0 END AS st FROM x WHERE rn = 1
  UNION ALL SELECT x.code, x.rn, CASE WHEN bias IS NULL OR (st = 1 AND (bias >= 0.5 OR bias <= -0.1)) THEN 0 WHEN st = 0 AND bias > 0.1 THEN 1 ELSE st END FROM s JOIN x ON x.code = s.code AND x.rn = s.rn + 1)
  SELECT x.code, trade_date, close, bias, st AS pos FROM x JOIN s ON x.code = s.code AND x.rn = s.rn""", "close bias pos")
def g05(spark, d):
    df = bars(spark, d).select("code", "trade_date", "close").withColumn("bias", F.col("close") / F.avg("close").over(roll(series(), 20)) - 1)
    return sig.bias_position(df, "bias", 0.1, 0.5, -0.1)


@query("g06_signed", f"WITH {BARS}, m AS (SELECT *, avg(close) OVER {frame(5)} AS a, avg(close) OVER {frame(20)} AS b FROM bars), e AS (SELECT *, CASE WHEN a > b AND lag(a) OVER w <= lag(b) OVER w THEN 1 WHEN a < b AND lag(a) OVER w >= lag(b) OVER w THEN -1 END AS ev FROM m {W}) SELECT code, trade_date, coalesce(last_value(ev IGNORE NULLS) OVER {UPTO}, 0)::INT AS pos FROM e")
def g06(spark, d):
    w = series()
    df = bars(spark, d).withColumn("a", F.avg("close").over(roll(w, 5))).withColumn("b", F.avg("close").over(roll(w, 20)))
    df = df.withColumn("up", (F.col("a") > F.col("b")) & (F.lag("a").over(w) <= F.lag("b").over(w))).withColumn("dn", (F.col("a") < F.col("b")) & (F.lag("a").over(w) >= F.lag("b").over(w)))
    return sig.signed_position(df, F.col("up"), F.col("dn")).select("code", "trade_date", "pos")


@query("g07_random_entry", f"WITH {BARS}, e AS (SELECT code, trade_date, ({uniform_sql(7, 'code', 'trade_date')} < 0.02)::INT AS e FROM bars) SELECT code, trade_date, max(e) OVER {frame(10)} AS pos FROM e")
def g07(spark, d):
    return sig.random_entry(bars(spark, d), 7, 0.02, 10).select("code", "trade_date", "pos")


@query("g08_entry_gate", f"""WITH {DON}, g AS (SELECT *, close > avg(close) OVER {frame(60)} AS gate, (pos > 0) AS b FROM d), r AS (SELECT *, sum(ch) OVER {UPTO} AS run FROM (SELECT *, (b IS DISTINCT FROM lag(b) OVER w)::INT AS ch FROM g {W})),
  o AS (SELECT *, bool_or(gate) OVER (PARTITION BY code, run ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS op, row_number() OVER (PARTITION BY code, run ORDER BY trade_date) AS k FROM r)
  SELECT code, trade_date, CASE WHEN b AND op THEN pos ELSE 0 END::INT AS pos, b AND k = 1 AS attempted, b AND NOT op AS blocked FROM o""")
def g08(spark, d):
    df = donchian(spark, d).withColumn("gate", F.col("close") > F.avg("close").over(roll(series(), 60)))
    return sig.gated_entry(df.withColumnRenamed("pos", "base"), "base", F.col("gate")).select("code", "trade_date", "pos", "attempted", "blocked")


@query("g09_exit_gate", f"""WITH {DON}, g AS (SELECT *, pos > 0 AS b, pos > 0 AND close > 1.2 * avg(close) OVER {frame(20)} AS hit FROM d), r AS (SELECT *, sum(ch) OVER {UPTO} AS run FROM (SELECT *, ((b, hit) IS DISTINCT FROM (lag(b) OVER w, lag(hit) OVER w))::INT AS ch FROM g {W})),
  k AS (SELECT *, row_number() OVER (PARTITION BY code, run ORDER BY trade_date) AS k FROM r) SELECT code, trade_date, CASE WHEN b AND NOT (hit AND k % 2 = 1) THEN pos ELSE 0 END::INT AS pos FROM k""")
def g09(spark, d):
    df = donchian(spark, d).withColumn("hit", F.col("close") > 1.2 * F.avg("close").over(roll(series(), 20)))
    return sig.gated_exit(df.withColumnRenamed("pos", "base"), "base", F.col("hit")).select("code", "trade_date", "pos")


@query("g10_confirmed_side", f"""WITH {BARS}, s AS (SELECT *, CASE WHEN close > avg(close) OVER {frame(20)} THEN 1 ELSE -1 END AS side, abs(close / avg(close) OVER {frame(20)} - 1) >= 0.2 AS ok FROM bars), r AS (SELECT *, sum(ch) OVER {UPTO} AS run FROM (SELECT *, (side IS DISTINCT FROM lag(side) OVER w)::INT AS ch FROM s {W})),
  c AS (SELECT *, CASE WHEN bool_or(ok) OVER (PARTITION BY code, run ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) THEN side END AS sd FROM r) SELECT code, trade_date, coalesce(last_value(sd IGNORE NULLS) OVER {UPTO}, 0)::INT AS pos FROM c""")
def g10(spark, d):
    ma = F.avg("close").over(roll(series(), 20))
    df = bars(spark, d).withColumn("side", F.when(F.col("close") > ma, 1).otherwise(-1)).withColumn("ok", F.abs(F.col("close") / ma - 1) >= 0.2)
    return sig.confirmed_side(df, "side", F.col("ok")).select("code", "trade_date", "pos")


@query("g11_range_state", f"""WITH RECURSIVE {ADX}, st AS (SELECT *, abs(close - lag(close) OVER w) AS step FROM adx {W}), er AS (SELECT *, CASE WHEN count(step) OVER {frame(10)} >= 10 AND sum(step) OVER {frame(10)} > 0 THEN abs(close - lag(close, 10) OVER w) / sum(step) OVER {frame(10)} END AS er FROM st {W}),
  kn AS (SELECT *, er IS NOT NULL AND adx IS NOT NULL AS known, CASE WHEN er >= 0.45 AND adx >= 25 THEN 'TREND' WHEN er <= 0.3 AND adx <= 20 THEN 'RANGE' END AS e FROM er), sg AS (SELECT *, sum(ch) OVER {UPTO} AS seg FROM (SELECT *, (known IS DISTINCT FROM lag(known) OVER w)::INT AS ch FROM kn {W})),
  ss AS (SELECT *, CASE WHEN NOT known THEN 'UNKNOWN' ELSE coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY code, seg ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'TRANSITION') END AS state FROM sg), rr AS (SELECT *, sum(c2) OVER {UPTO} AS run FROM (SELECT *, (state IS DISTINCT FROM lag(state) OVER w)::INT AS c2 FROM ss {W}))
  SELECT code, trade_date, state, greatest(0, least(1, (0.45 - er) / (0.45 - 0.3))) AS range_score, row_number() OVER (PARTITION BY code, run ORDER BY trade_date)::INT AS days FROM rr""", "range_score")
def g11(spark, d):
    df = ind.adx(bars(spark, d))
    df = ind.with_steps(df).withColumn("er", ind.efficiency_ratio("close", 10))
    return sig.range_state(df, "er", "adx").select("code", "trade_date", "state", "range_score", "days")


@query("g12_market_regime", f"""WITH {BARS}, x AS (SELECT *, row_number() OVER w AS rn FROM bars {W}), s AS (SELECT *, CASE WHEN count(close) OVER {frame(20)} >= 20 THEN regr_slope(ln(close), rn) OVER {frame(20)} END AS slope, high / low - 1 AS v FROM x),
  q AS (SELECT *, CASE WHEN count(v) OVER e >= 60 THEN quantile_cont(v, 0.7) OVER e END AS cut FROM s WINDOW e AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT code, trade_date, CASE WHEN cut IS NOT NULL AND slope IS NOT NULL THEN CASE WHEN slope > 0 THEN 'UP' WHEN slope < 0 THEN 'DOWN' ELSE 'FLAT' END || '_' || CASE WHEN v > cut THEN 'WILD' ELSE 'CALM' END END AS regime FROM q""")
def g12(spark, d):
    df = bars(spark, d).withColumn("_rn", F.row_number().over(series())).withColumn("v", F.col("high") / F.col("low") - 1)
    return sig.market_regime(df.withColumn("slope", ind.slope(F.ln("close"), 20)), "slope", "v").select("code", "trade_date", "regime")


@query("g13_volatility_regime", f"""WITH RECURSIVE {NUMBERED}, t AS MATERIALIZED (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM x {W}), {ema_sql('f', 't', 'tr', '(1.0 / 10)')}, {ema_sql('g', 't', 'tr', '(1.0 / 60)')},
  q AS MATERIALIZED (SELECT x.code, x.trade_date, x.rn, CASE WHEN x.rn >= 60 THEN f.y / g.y END AS ratio, close > avg(close) OVER (PARTITION BY x.code ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS "on" FROM x JOIN f ON x.code = f.code AND x.rn = f.rn JOIN g ON x.code = g.code AND x.rn = g.rn),
  s AS (SELECT DISTINCT code, 0::BIGINT AS rn, 'FLAT' AS st FROM q
  UNION ALL SELECT q.code, q.rn, CASE WHEN NOT "on" THEN 'FLAT' WHEN ratio IS NULL THEN CASE WHEN st = 'FLAT' THEN 'NORMAL' ELSE st END WHEN ratio >= 2.0 THEN 'EXTREME' WHEN ratio >= 1.3 OR (st IN ('REDUCED', 'EXTREME') AND ratio > 1.1) THEN 'REDUCED' WHEN ratio <= 0.8 THEN 'INCREASED' ELSE 'NORMAL' END FROM s JOIN q ON q.code = s.code AND q.rn = s.rn + 1)
  SELECT q.code, trade_date, ratio, "on", st AS vol_state FROM q JOIN s ON q.code = s.code AND q.rn = s.rn""", "ratio")
def g13(spark, d):
    df = ind.atr(ind.atr(bars(spark, d), "fast", 10).drop("tr"), "slow", 60)
    df = df.select("code", "trade_date", F.try_divide(F.col("fast"), F.col("slow")).alias("ratio"), (F.col("close") > F.avg("close").over(roll(series(), 60))).alias("on"))
    return sig.volatility_regime(df, "ratio", "on")


@query("g14_index_position", f"""WITH {RET}, q AS (SELECT *, abs(lr) AS a FROM r), c AS (SELECT *, CASE WHEN count(a) OVER p >= 60 THEN quantile_cont(a, 0.8) OVER p END AS cut FROM q WINDOW p AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
  SELECT code, trade_date, coalesce(last_value(CASE WHEN lr > cut THEN 1 WHEN lr < -cut THEN 0 END IGNORE NULLS) OVER {UPTO}, 0)::INT AS pos FROM c""")
def g14(spark, d):
    return sig.index_position(ind.with_returns(bars(spark, d)), "lr", 0.8, 60).select("code", "trade_date", "pos")


@query("g15_next_action", f"WITH {DON} SELECT code, max(trade_date) AS as_of, arg_max(pos, trade_date)::INT AS pos, arg_max(close, trade_date) AS close FROM d GROUP BY code", "close")
def g15(spark, d):
    return donchian(spark, d).groupBy("code").agg(F.max("trade_date").alias("as_of"), F.max_by("pos", "trade_date").alias("pos"), F.max_by("close", "trade_date").alias("close"))


@query("g16_tiers", f"""WITH {RET}, v AS (SELECT *, CASE WHEN count(lr) OVER {frame(20)} >= 20 THEN stddev_samp(lr) OVER {frame(20)} END AS vol FROM r),
  q AS (SELECT *, CASE WHEN count(vol) OVER e >= 60 THEN quantile_cont(vol, 0.5) OVER e END AS c1, CASE WHEN count(vol) OVER e >= 60 THEN quantile_cont(vol, 0.9) OVER e END AS c2 FROM v WINDOW e AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT code, trade_date, [1.0, 0.5, 0.2][(1 + coalesce((vol > c1)::INT, 0) + coalesce((vol > c2)::INT, 0))::INT]::DOUBLE AS exposure FROM q""", "exposure")
def g16(spark, d):
    df = ind.with_returns(bars(spark, d)).withColumn("vol", ind.rolling_std("lr", 20, 20))
    df = ind.with_quantiles(df.select("code", "trade_date", "vol"), {"c1": ("vol", 0.5, None, 60), "c2": ("vol", 0.9, None, 60)})
    return df.select("code", "trade_date", sig.tiered("vol", [F.col("c1"), F.col("c2")], [1.0, 0.5, 0.2]).alias("exposure"))


@query("g18_risk_control", f"WITH {RET}, q AS (SELECT code, trade_date, lag(abs(lr)) OVER w AS x, quantile_cont(abs(lr), 0.9) OVER (PARTITION BY code) AS hi FROM r {W}) SELECT code, trade_date, coalesce((x <= hi)::INT, 1) AS allowed FROM q")
def g18(spark, d):
    df = ind.with_returns(bars(spark, d)).withColumn("a", F.abs("lr"))
    return sig.risk_control(df, "a", 0.9).select("code", "trade_date", "allowed")


HOLD = f"""{DON}, n AS (SELECT *, sum(ch) OVER {UPTO} AS run FROM (SELECT *, ((pos > 0) IS DISTINCT FROM lag(pos > 0) OVER w)::INT AS ch FROM d {W})),
  hd AS (SELECT *, CASE WHEN pos > 0 THEN run END AS hold, row_number() OVER (PARTITION BY code, run ORDER BY trade_date) AS k, first(open) OVER (PARTITION BY code, run ORDER BY trade_date) AS entry, (high - low) AS risk FROM n)"""
INPOS = "(PARTITION BY code, hold ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BEFORE = "(PARTITION BY code, hold ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def positions(spark, d):
    return sig.with_positions(donchian(spark, d)).withColumn("atr", F.avg(F.col("high") - F.col("low")).over(roll(series(), 14)))


ATR = f"{HOLD}, a AS (SELECT *, avg(high - low) OVER {frame(14)} AS atr FROM hd)"


@query("e02_static_stop", f"""WITH {ATR}, s AS (SELECT *, entry - 2 * first(atr) OVER {INPOS} AS stop FROM a WHERE hold IS NOT NULL), f AS (SELECT *, CASE WHEN low < stop THEN least(stop, open) END AS fill FROM s), g AS (SELECT *, count(fill) OVER {BEFORE} AS bef FROM f)
  SELECT code, trade_date, stop, CASE WHEN bef = 0 THEN fill END AS exit_price, bef = 0 AS active FROM g""", "stop exit_price")
def e02(spark, d):
    return sig.atr_stops(positions(spark, d), "static", 2.0).where("hold IS NOT NULL").select("code", "trade_date", "stop", "exit_price", "active")


@query("e02_trailing_stop", f"""WITH {ATR}, m AS (SELECT *, max(close - 2 * atr) OVER {INPOS} AS mx, first(atr) OVER {INPOS} AS a0 FROM a WHERE hold IS NOT NULL), s AS (SELECT *, coalesce(lag(mx) OVER (PARTITION BY code, hold ORDER BY trade_date), entry - 2 * a0) AS stop FROM m),
  f AS (SELECT *, CASE WHEN low < stop THEN least(stop, open) END AS fill FROM s), g AS (SELECT *, count(fill) OVER {BEFORE} AS bef FROM f) SELECT code, trade_date, stop, CASE WHEN bef = 0 THEN fill END AS exit_price, bef = 0 AS active FROM g""", "stop exit_price")
def e02t(spark, d):
    return sig.atr_stops(positions(spark, d), "trailing", 2.0).where("hold IS NOT NULL").select("code", "trade_date", "stop", "exit_price", "active")


@query("e02_tightening_stop", f"""WITH {ATR}, z AS (SELECT *, first(atr) OVER {INPOS} AS a0, max(close) OVER {INPOS} AS top FROM a WHERE hold IS NOT NULL), c AS (SELECT *, close - greatest(0.5, 3 - 0.5 * greatest(0, floor((top - entry) / nullif(a0, 0)))) * atr AS c FROM z), m AS (SELECT *, max(c) OVER {INPOS} AS mx FROM c),
  s AS (SELECT *, coalesce(lag(mx) OVER (PARTITION BY code, hold ORDER BY trade_date), entry - 3 * a0) AS stop FROM m), f AS (SELECT *, CASE WHEN low < stop THEN least(stop, open) END AS fill FROM s), g AS (SELECT *, count(fill) OVER {BEFORE} AS bef FROM f) SELECT code, trade_date, stop, CASE WHEN bef = 0 THEN fill END AS exit_price, bef = 0 AS active FROM g""", "stop exit_price")
def e02g(spark, d):
    return sig.atr_stops(positions(spark, d), "tightening", 3.0, tighten=0.5).where("hold IS NOT NULL").select("code", "trade_date", "stop", "exit_price", "active")


BASE = f"""{BARS}, sg AS (SELECT code, trade_date, open, high, low, close, avg(high - low) OVER {frame(14)} AS atr, CASE WHEN close > 1.1 * avg(close) OVER {frame(20)} THEN 1 WHEN close < 0.9 * avg(close) OVER {frame(20)} THEN -1 ELSE 0 END AS b FROM bars),
  r AS MATERIALIZED (SELECT mode, sg.*, coalesce(lag(b) OVER (PARTITION BY mode, code ORDER BY trade_date), 0) AS pb, row_number() OVER (PARTITION BY mode, code ORDER BY trade_date) AS rn FROM sg, (SELECT unnest(['reenter', 'wait_next_entry']) AS mode))"""

#: One row after the other: side held, entry, the line set so far, and whether a new turn is awaited.
REENTRY = f"""WITH RECURSIVE {BASE}, s AS (SELECT DISTINCT mode, code, 0::BIGINT AS rn, NULL::DATE AS trade_date, 0 AS side, NULL::DOUBLE AS line, false AS locked, NULL::DOUBLE AS force, NULL::DOUBLE AS fill, NULL::VARCHAR AS event FROM r
  UNION ALL SELECT mode, code, rn, trade_date, CASE WHEN hit THEN 0 WHEN keeps THEN side WHEN b <> 0 AND NOT (locked AND b = pb) THEN b ELSE 0 END AS side,
    CASE WHEN keeps AND side > 0 THEN greatest(line, close - atr) WHEN keeps THEN least(line, close + atr) ELSE close - b * atr END AS line,
    CASE WHEN hit THEN mode = 'wait_next_entry' WHEN keeps THEN locked WHEN b <> 0 AND NOT (locked AND b = pb) THEN false ELSE locked END AS locked,
    CASE WHEN hit OR keeps THEN line END AS force, CASE WHEN hit AND side > 0 THEN least(line, open) WHEN hit THEN greatest(line, open) END AS fill,
    CASE WHEN hit THEN 'exit' WHEN keeps THEN NULL WHEN b <> 0 AND NOT (locked AND b = pb) THEN CASE WHEN side <> 0 THEN 'turn' WHEN b <> pb THEN 'entry' ELSE 'reentry' END WHEN side <> 0 THEN 'signal' END AS event
  FROM (SELECT r.*, s.side, s.line, s.locked, s.side <> 0 AND r.b = s.side AND CASE WHEN s.side > 0 THEN r.low < s.line ELSE r.high > s.line END AS hit, s.side <> 0 AND r.b = s.side AS keeps FROM s JOIN r ON r.mode = s.mode AND r.code = s.code AND r.rn = s.rn + 1))"""


def based(spark, d):
    m = F.avg("close").over(roll(series(), 20))
    b = bars(spark, d).withColumn("atr", F.avg(F.col("high") - F.col("low")).over(roll(series(), 14)))
    b = b.withColumn("base", F.when(F.col("close") > 1.1 * m, 1).when(F.col("close") < 0.9 * m, -1).otherwise(0))
    return b.withColumn("mode", F.explode(F.array(*map(F.lit, MODES))))


@query("e02_stop_reentry", f"{REENTRY} SELECT mode, code, trade_date, side::DOUBLE AS position, force AS line, fill, event FROM s WHERE rn > 0", "position line fill")
def e02r(spark, d):
    """Trailing stops, long and short, with and without entry again while the signal stands."""
    return with_exits(based(spark, d), "base", AtrStop("trailing", 1.0), "mode", keys=("mode", "code")).select("mode", "code", "trade_date", "position", "line", "fill", "event")


#: The same for a profit taker: peak is the best profit so far, in R of one ATR at entry.
TAKER = f"""WITH RECURSIVE {BASE}, s AS (SELECT DISTINCT mode, code, 0::BIGINT AS rn, NULL::DATE AS trade_date, 0 AS side, NULL::DOUBLE AS entry, NULL::DOUBLE AS risk, 0.0::DOUBLE AS peak, 0 AS nb, false AS locked, NULL::DOUBLE AS fill, NULL::VARCHAR AS event FROM r
  UNION ALL SELECT mode, code, rn, trade_date, CASE WHEN hit THEN 0 WHEN keeps THEN side WHEN goes THEN b ELSE 0 END AS side, CASE WHEN keeps THEN entry ELSE close END AS entry, CASE WHEN keeps THEN risk ELSE atr / close END AS risk, CASE WHEN keeps THEN top ELSE 0 END AS peak, CASE WHEN keeps THEN nb + 1 ELSE 0 END AS nb,
    CASE WHEN hit THEN mode = 'wait_next_entry' WHEN keeps THEN locked WHEN goes THEN false ELSE locked END AS locked, CASE WHEN hit AND side > 0 THEN least(line, open) WHEN hit THEN greatest(line, open) END AS fill,
    CASE WHEN hit THEN 'exit' WHEN keeps THEN NULL WHEN goes THEN CASE WHEN side <> 0 THEN 'turn' WHEN b <> pb THEN 'entry' ELSE 'reentry' END WHEN side <> 0 THEN 'signal' END AS event
  FROM (SELECT *, keeps AND share IS NOT NULL AND nb + 1 >= 2 AND side * (CASE WHEN side > 0 THEN low ELSE high END / entry - 1) <= top * (1 - share) AS hit, entry * (1 + side * top * (1 - share)) AS line, b <> 0 AND NOT (locked AND b = pb) AS goes FROM
    (SELECT *, CASE WHEN risk > 0 AND top / risk >= 2 THEN 0.3 WHEN risk > 0 AND top / risk >= 1 THEN 0.5 END AS share FROM
      (SELECT r.*, s.side, s.entry, s.risk, s.nb, s.locked, s.side <> 0 AND r.b = s.side AS keeps, greatest(s.peak, s.side * (CASE WHEN s.side > 0 THEN r.high ELSE r.low END / s.entry - 1)) AS top FROM s JOIN r ON r.mode = s.mode AND r.code = s.code AND r.rn = s.rn + 1))))"""


@query("e04_take_profit_reentry", f"{TAKER} SELECT mode, code, trade_date, side::DOUBLE AS position, fill, event FROM s WHERE rn > 0", "position fill")
def e04r(spark, d):
    """Profit takers in R, long and short, with and without entry again while the signal stands."""
    return with_exits(based(spark, d), "base", RTakeProfit(1.0, [(1.0, 0.5), (2.0, 0.3)]), "mode", keys=("mode", "code")).select("mode", "code", "trade_date", "position", "fill", "event")


@query("e04_r_take_profit", f"""WITH {ATR}, p AS (SELECT *, max(high / entry - 1) OVER {BEFORE} AS peak FROM a WHERE hold IS NOT NULL), b AS (SELECT *, CASE WHEN peak >= 2 * atr / entry THEN 0.3 WHEN peak >= atr / entry THEN 0.5 END AS back FROM p), l AS (SELECT *, entry * (1 + peak * (1 - back)) AS line FROM b),
  f AS (SELECT *, CASE WHEN k > 2 AND back IS NOT NULL AND low <= line THEN least(line, open) END AS fill FROM l), g AS (SELECT *, count(fill) OVER {BEFORE} AS bef FROM f) SELECT code, trade_date, CASE WHEN bef = 0 THEN fill END AS exit_price, bef = 0 AS active FROM g""", "exit_price")
def e04(spark, d):
    return sig.r_take_profit(positions(spark, d), "atr", [(1.0, 0.5), (2.0, 0.3)]).where("hold IS NOT NULL").select("code", "trade_date", "exit_price", "active")


@query("e06_scale_out", f"""WITH {ATR}, r AS (SELECT *, max((high - entry) / nullif(atr, 0)) OVER {INPOS} AS r FROM a WHERE hold IS NOT NULL), w AS (SELECT *, lag(r) OVER (PARTITION BY code, hold ORDER BY trade_date) AS was FROM r), b AS (SELECT *, max((coalesce(was >= 1, false) AND low <= entry)::INT) OVER {INPOS} AS back FROM w)
  SELECT code, trade_date, CASE WHEN back = 1 THEN 0 ELSE greatest(0, 1 - CASE WHEN r >= 1 THEN 0.3 ELSE 0 END - CASE WHEN r >= 2 THEN 0.3 ELSE 0 END) END::DOUBLE AS size FROM b""", "size")
def e06(spark, d):
    return sig.scale_out(positions(spark, d), "atr", [(1.0, 0.3), (2.0, 0.3)]).where("hold IS NOT NULL").select("code", "trade_date", "size")


@query("e07_ma_trailing", f"""WITH {HOLD}, m AS (SELECT *, avg(close) OVER {frame(10)} AS s, avg(close) OVER {frame(30)} AS l FROM hd), x AS (SELECT *, max((k > 3 AND close < s)::INT) OVER {INPOS} AS us, max((k > 3 AND close < l)::INT) OVER {INPOS} AS ul FROM m WHERE hold IS NOT NULL)
  SELECT code, trade_date, CASE WHEN ul = 1 THEN 0.0 WHEN us = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS size FROM x""", "size")
def e07(spark, d):
    ma = lambda n: F.avg("close").over(roll(series(), n))
    df = positions(spark, d).withColumn("ms", ma(10)).withColumn("ml", ma(30))
    return sig.ma_trailing(df, "ms", "ml", 3).where("hold IS NOT NULL").select("code", "trade_date", "size")


@query("e08_arbitration", f"WITH {ATR}, e AS (SELECT code, trade_date, 1.0 AS share, entry - 2 * atr AS stop FROM a WHERE hold IS NOT NULL AND low < entry - 2 * atr UNION ALL SELECT code, trade_date, 0.5, close FROM a WHERE hold IS NOT NULL AND high > entry * 1.2) SELECT code, trade_date, share, stop FROM e QUALIFY row_number() OVER (PARTITION BY code, trade_date ORDER BY (share >= 1) DESC, stop DESC, share DESC) = 1", "share stop")
def e08(spark, d):
    p = positions(spark, d).where("hold IS NOT NULL")
    stop = F.col("entry") - 2 * F.col("atr")
    full = p.where(F.col("low") < stop).select("code", "trade_date", F.lit(1.0).alias("share"), stop.alias("stop"))
    part = p.where(F.col("high") > F.col("entry") * 1.2).select("code", "trade_date", F.lit(0.5).alias("share"), F.col("close").alias("stop"))
    return sig.arbitrated(full.unionByName(part))


@query("e03_equity_budget_stop", f"""WITH {ATR}, s AS (SELECT *, entry * (1 - 0.05 / first(0.1 + 0.02 * day(trade_date)) OVER {INPOS}) AS stop FROM a WHERE hold IS NOT NULL), f AS (SELECT *, CASE WHEN low < stop THEN least(stop, open) END AS fill FROM s), g AS (SELECT *, count(fill) OVER {BEFORE} AS bef FROM f)
  SELECT code, trade_date, stop, CASE WHEN bef = 0 THEN fill END AS exit_price, bef = 0 AS active FROM g""", "stop exit_price")
def e03(spark, d):
    p = positions(spark, d).withColumn("w", 0.1 + 0.02 * F.dayofmonth("trade_date"))
    return sig.equity_budget_stop(p, 0.05).where("hold IS NOT NULL").select("code", "trade_date", "stop", "exit_price", "active")


@query("e09_budget_gate", f"""WITH RECURSIVE {ATR}, en AS MATERIALIZED (SELECT substr(code, 1, 1) AS strategy, trade_date, code, coalesce(2 * atr / entry / 20, 0.02) AS risk, date_trunc('month', trade_date)::DATE AS month, row_number() OVER (PARTITION BY substr(code, 1, 1), date_trunc('month', trade_date) ORDER BY trade_date, code) AS rn FROM a WHERE hold IS NOT NULL AND k = 1),
  g AS (SELECT strategy, month, 0::BIGINT AS rn, 0.0::DOUBLE AS used, false AS ok FROM (SELECT DISTINCT strategy, month FROM en) UNION ALL SELECT en.strategy, en.month, en.rn, CASE WHEN used + risk <= 0.06 + 1e-12 THEN used + risk ELSE used END, used + risk <= 0.06 + 1e-12 FROM g JOIN en ON en.strategy = g.strategy AND en.month = g.month AND en.rn = g.rn + 1)
  SELECT en.strategy, trade_date, code, risk, en.month, ok AS admitted FROM en JOIN g ON en.strategy = g.strategy AND en.month = g.month AND en.rn = g.rn""", "risk")
def e09(spark, d):
    """Entries of each class of instruments under that class's monthly budget."""
    entries = positions(spark, d).where("day = 1").select(F.substring("code", 1, 1).alias("strategy"), "trade_date", "code", F.coalesce(F.try_divide(2 * F.col("atr"), F.col("entry")) / 20, F.lit(0.02)).alias("risk"))
    return sig.budget_gate(entries)


@query("e11_drawdown_sleep", f"""WITH RECURSIVE {RET}, q AS MATERIALIZED (SELECT code, trade_date, r / 1000 AS r, row_number() OVER w AS rn FROM r WHERE r IS NOT NULL {W}), s AS (SELECT DISTINCT code, 0::BIGINT AS rn, 1.0::DOUBLE AS nav, 1.0::DOUBLE AS peak, 0 AS lft, 1.0::DOUBLE AS ex FROM q
  UNION ALL SELECT code, rn, nav, CASE WHEN lft = 0 AND nav / peak - 1 <= -0.002 THEN nav ELSE peak END, CASE WHEN lft = 0 AND nav / peak - 1 <= -0.002 THEN 10 ELSE lft END, ex FROM (SELECT code, rn, nav, lft, ex, CASE WHEN ex < 1 AND lft = 0 THEN nav ELSE greatest(peak, nav) END AS peak
    FROM (SELECT q.code, q.rn, nav * (1 + CASE WHEN lft > 0 THEN 0 ELSE 1 END * q.r) AS nav, peak, greatest(0, lft - 1) AS lft, CASE WHEN lft > 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS ex FROM s JOIN q ON q.code = s.code AND q.rn = s.rn + 1)))
  SELECT q.code AS strategy, trade_date, r, ex AS exposure, nav FROM q JOIN s ON q.code = s.code AND q.rn = s.rn""", "r exposure nav", 4)
def e11(spark, d):
    """Each instrument held alone, as a strategy of its own."""
    r = ind.with_returns(bars(spark, d)).where("r IS NOT NULL").select(F.col("code").alias("strategy"), "trade_date", (F.col("r") / 1000).alias("r"))
    return sig.drawdown_sleep(r, "r", 0.002, 10)


@query("e14_hit_counts", f"WITH {HOLD} SELECT code, hold::BIGINT AS hold, count(*) AS days, sum((high > entry * 1.1)::INT)::BIGINT AS hits FROM hd WHERE hold IS NOT NULL GROUP BY code, hold")
def e14(spark, d):
    return positions(spark, d).where("hold IS NOT NULL").groupBy("code", "hold").agg(F.count("*").alias("days"), F.sum((F.col("high") > F.col("entry") * 1.1).cast("int")).alias("hits"))
