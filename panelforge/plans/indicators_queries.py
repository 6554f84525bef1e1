"""Queries W1 to W30 and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelforge.functions.frames import ret, roll, series
from panelforge.functions.tails import chi_square_tail, erfc_sql
from panelforge.operators import indicators as ind
from panelforge.operators import scan
from panelforge.plans.registry import query
from panelforge.plans.views import BARS, bars

W = "WINDOW w AS (PARTITION BY code ORDER BY trade_date)"


def frame(n: int) -> str:
    return f"(PARTITION BY code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


RET = f"{BARS}, r AS (SELECT *, close / lag(close) OVER w - 1 AS r, ln(close / lag(close) OVER w) AS lr FROM bars {W})"


@query("w01_sma", f"WITH {BARS} SELECT code, trade_date, CASE WHEN count(close) OVER {frame(20)} >= 10 THEN avg(close) OVER {frame(20)} END AS sma20, CASE WHEN count(close) OVER {frame(5)} >= 2 THEN avg(close) OVER {frame(5)} END AS sma5 FROM bars", "sma20 sma5")
def w01(spark, d):
    return bars(spark, d).select("code", "trade_date", ind.sma("close", 20).alias("sma20"), ind.sma("close", 5).alias("sma5"))


@query("w02_rolling_vol", f"WITH {RET} SELECT code, trade_date, CASE WHEN count(r) OVER {frame(20)} >= 20 THEN stddev_samp(r) OVER {frame(20)} * sqrt(252) END AS vol, CASE WHEN count(close) OVER {frame(10)} >= 10 THEN stddev_pop(close) OVER {frame(10)} END AS sd0 FROM r", "vol sd0")
def w02(spark, d):
    df = ind.with_returns(bars(spark, d))
    return df.select("code", "trade_date", (ind.rolling_std("r", 20, 20) * math.sqrt(252)).alias("vol"), ind.rolling_std("close", 10, 10, 0).alias("sd0"))


@query("w03_donchian", f"WITH {BARS} SELECT code, trade_date, CASE WHEN count(high) OVER p >= 20 THEN max(high) OVER p END AS upper, CASE WHEN count(low) OVER p >= 20 THEN min(low) OVER p END AS lower FROM bars WINDOW p AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)", "upper lower")
def w03(spark, d):
    up, low = ind.donchian(20)
    return bars(spark, d).select("code", "trade_date", up.alias("upper"), low.alias("lower"))


@query("w04_compounded", f"WITH {RET} SELECT code, trade_date, CASE WHEN count(r) OVER {frame(10)} >= 10 THEN product(1 + r) OVER {frame(10)} - 1 END AS comp10, close / lag(close, 63) OVER w - 1 AS ret63 FROM r {W}", "comp10 ret63")
def w04(spark, d):
    df = ind.with_returns(bars(spark, d))
    return df.select("code", "trade_date", ind.compounded("r", 10).alias("comp10"), ret("close", series(), 63).alias("ret63"))


@query("w05_quantile", f"""WITH {RET} SELECT code, trade_date,
  CASE WHEN count(r) OVER p >= 60 THEN quantile_cont(r, 0.8) OVER p END AS q_roll, CASE WHEN count(r) OVER e >= 60 THEN quantile_cont(r, 0.8) OVER e END AS q_all FROM r
  WINDOW p AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), e AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "q_roll q_all")
def w05(spark, d):
    df = ind.with_returns(bars(spark, d)).select("code", "trade_date", "r")
    return ind.with_quantiles(df, {"q_roll": ("r", 0.8, 60, 60), "q_all": ("r", 0.8, None, 60)}).drop("r")


@query("w06_midrank", f"WITH {BARS} SELECT a.code, a.trade_date, (sum((b.close < a.close)::INT) + 0.5 * sum((b.close = a.close)::INT)) / count(*) AS pct FROM bars a JOIN bars b ON a.code = b.code AND b.trade_date <= a.trade_date GROUP BY a.code, a.trade_date", "pct", 9)
def w06(spark, d):
    return ind.midrank(bars(spark, d).select("code", "trade_date", "close"), "close", "pct").drop("close")


@query("w07_slope", f"WITH {BARS}, x AS (SELECT *, row_number() OVER w AS rn FROM bars {W}) SELECT code, trade_date, CASE WHEN count(close) OVER {frame(20)} >= 20 THEN regr_slope(ln(close), rn) OVER {frame(20)} END AS slope FROM x", "slope", 9)
def w07(spark, d):
    df = bars(spark, d).withColumn("_rn", F.row_number().over(series()))
    return df.select("code", "trade_date", ind.slope(F.ln("close"), 20).alias("slope"))


@query("w08_rolling_corr", f"""WITH {RET}, p AS (SELECT a.trade_date, a.code || '-' || b.code AS code, a.r AS x, b.r AS y FROM r a JOIN r b ON a.trade_date = b.trade_date AND a.code < b.code WHERE a.r IS NOT NULL AND b.r IS NOT NULL)
  SELECT code, trade_date, CASE WHEN count(*) OVER {frame(60)} >= 3 THEN corr(x, y) OVER {frame(60)} END AS corr60 FROM p""", "corr60")
def w08(spark, d):
    r = ind.with_returns(bars(spark, d)).where("r IS NOT NULL").select("code", "trade_date", "r")
    a, b = r.alias("a"), r.alias("b")
    pairs = a.join(b.hint("merge"), (F.col("a.trade_date") == F.col("b.trade_date")) & (F.col("a.code") < F.col("b.code"))).select(F.concat_ws("-", "a.code", "b.code").alias("code"), "a.trade_date", F.col("a.r").alias("x"), F.col("b.r").alias("y"))
    f = roll(series(), 60)
    return pairs.select("code", "trade_date", F.when(F.count("*").over(f) >= 3, F.corr("x", "y").over(f)).alias("corr60"))


@query("w09_drawdowns", f"""WITH {BARS}, l AS (SELECT code, trade_date, close, list(close) OVER {frame(20)} AS v FROM bars),
  d AS (SELECT *, list_transform(range(1, len(v) + 1), lambda i: v[i] / list_max(v[1:i]) - 1) AS dd FROM l)
  SELECT code, trade_date, close / list_max(v) - 1 AS dd20, list_min(dd) AS mdd20, sqrt(list_sum(list_transform(dd, lambda x: x * x)) / len(dd)) AS ulcer20 FROM d""", "dd20 mdd20 ulcer20")
def w09(spark, d):
    worst, ulcer = ind.window_drawdowns("close", 20)
    return bars(spark, d).select("code", "trade_date", ind.rolling_drawdown("close", 20).alias("dd20"), worst.alias("mdd20"), ulcer.alias("ulcer20"))


@query("w10_rolling_sharpe", f"WITH {RET} SELECT code, trade_date, CASE WHEN count(r) OVER {frame(60)} >= 60 THEN avg(r) OVER {frame(60)} / stddev_samp(r) OVER {frame(60)} * sqrt(252) END AS sharpe, CASE WHEN count(r) OVER {frame(60)} >= 60 THEN avg(r) OVER {frame(60)} / stddev_samp(least(r, 0)) OVER {frame(60)} * sqrt(252) END AS sortino FROM (SELECT * FROM r WHERE r IS NOT NULL)", "sharpe sortino")
def w10(spark, d):
    df = ind.with_returns(bars(spark, d)).where("r IS NOT NULL")
    return df.select("code", "trade_date", ind.sharpe("r", 60).alias("sharpe"), ind.sortino("r", 60).alias("sortino"))


def ema_sql(out: str, source: str, x: str, alpha: str) -> str:
    """CTEs of a recursive mean `out` over the rows (code, rn, x) of a source."""
    return f"""{out} AS (SELECT code, rn, {x}::DOUBLE AS y FROM {source} WHERE rn = 1
    UNION ALL SELECT s.code, s.rn, {alpha} * s.{x} + (1 - {alpha}) * e.y FROM {out} e JOIN {source} s ON s.code = e.code AND s.rn = e.rn + 1)"""


NUMBERED = f"{BARS}, x AS MATERIALIZED (SELECT *, row_number() OVER w AS rn FROM bars {W})"


@query("w11_ema", f"WITH RECURSIVE {NUMBERED}, {ema_sql('e', 'x', 'close', '(2.0 / 21)')}, {ema_sql('v', 'x', 'close', '(1.0 / 14)')} SELECT x.code, trade_date, e.y AS ema20, v.y AS wilder14 FROM x JOIN e ON x.code = e.code AND x.rn = e.rn JOIN v ON x.code = v.code AND x.rn = v.rn", "ema20 wilder14")
def w11(spark, d):
    return scan.emas(bars(spark, d), {"ema20": ("close", scan.span(20)), "wilder14": ("close", 1 / 14)}).select("code", "trade_date", "ema20", "wilder14")


@query("w12_kama", f"""WITH RECURSIVE {NUMBERED}, s AS (SELECT *, abs(close - lag(close) OVER w) AS step FROM x {W}),
  k AS (SELECT *, CASE WHEN count(step) OVER {frame(10)} >= 10 AND sum(step) OVER {frame(10)} > 0 THEN abs(close - lag(close, 10) OVER w) / sum(step) OVER {frame(10)} ELSE 0 END AS er FROM s {W}),
  a AS MATERIALIZED (SELECT *, pow(er * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS al FROM k), {ema_sql('e', 'a', 'close', 's.al')}
  SELECT x.code, trade_date, e.y AS kama FROM x JOIN e ON x.code = e.code AND x.rn = e.rn""", "kama")
def w12(spark, d):
    return ind.kama(bars(spark, d), "kama").select("code", "trade_date", "kama")


@query("w13_vma", f"""WITH RECURSIVE {NUMBERED}, m AS (SELECT *, close - lag(close) OVER w AS d FROM x {W}), g AS (SELECT *, sum(greatest(d, 0)) OVER {frame(9)} AS up, sum(greatest(-d, 0)) OVER {frame(9)} AS dn FROM m),
  a AS MATERIALIZED (SELECT *, coalesce(CASE WHEN up + dn > 0 THEN abs(up - dn) / (up + dn) END, 0) * 0.2 AS al FROM g), {ema_sql('e', 'a', 'close', 's.al')} SELECT x.code, trade_date, e.y AS vma FROM x JOIN e ON x.code = e.code AND x.rn = e.rn""", "vma")
def w13(spark, d):
    return ind.vma(bars(spark, d), "vma").select("code", "trade_date", "vma")


@query("w14_wma", f"WITH {BARS} SELECT code, trade_date, ({' + '.join(f'{5 - k} * lag(close, {k}) OVER w' for k in range(5))}) / 15 AS wma5 FROM bars {W}", "wma5")
def w14(spark, d):
    return ind.moving_average(bars(spark, d), "wma5", "wma", 5).select("code", "trade_date", "wma5")


@query("w15_macd", f"""WITH RECURSIVE {NUMBERED}, {ema_sql('f', 'x', 'close', '(2.0 / 13)')}, {ema_sql('g', 'x', 'close', '(2.0 / 27)')},
  m AS MATERIALIZED (SELECT f.code, f.rn, f.y - g.y AS macd FROM f JOIN g ON f.code = g.code AND f.rn = g.rn), {ema_sql('s', 'm', 'macd', '0.2').replace('JOIN m s ON s', 'JOIN m t ON t').replace('s.rn = e.rn', 't.rn = e.rn').replace('SELECT s.code, s.rn', 'SELECT t.code, t.rn').replace('s.macd', 't.macd')}
  SELECT x.code, trade_date, macd, s.y AS macd_signal, macd - s.y AS macd_hist FROM x JOIN m ON x.code = m.code AND x.rn = m.rn JOIN s ON x.code = s.code AND x.rn = s.rn""", "macd macd_signal macd_hist")
def w15(spark, d):
    return ind.macd(bars(spark, d)).select("code", "trade_date", "macd", "macd_signal", "macd_hist")


@query("w16_atr", f"""WITH RECURSIVE {NUMBERED}, t AS MATERIALIZED (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM x {W}), {ema_sql('e', 't', 'tr', '(1.0 / 14)')}
  SELECT x.code, trade_date, CASE WHEN x.rn >= 14 THEN e.y END AS atr FROM x JOIN e ON x.code = e.code AND x.rn = e.rn""", "atr")
def w16(spark, d):
    return ind.atr(bars(spark, d)).select("code", "trade_date", "atr")


@query("w17_rsi", f"""WITH RECURSIVE {BARS}, c AS (SELECT *, close - lag(close) OVER w AS d, row_number() OVER w - 1 AS rn FROM bars {W}),
  x AS MATERIALIZED (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS down FROM c), {ema_sql('u', 'x', 'up', '(1.0 / 14)')}, {ema_sql('l', 'x', 'down', '(1.0 / 14)')}
  SELECT x.code, trade_date, CASE WHEN x.rn < 14 THEN NULL WHEN u.y = 0 AND l.y = 0 THEN 50 WHEN l.y = 0 THEN 100 WHEN u.y = 0 THEN 0 ELSE 100 - 100 / (1 + u.y / l.y) END AS rsi
  FROM x LEFT JOIN u ON x.code = u.code AND x.rn = u.rn LEFT JOIN l ON x.code = l.code AND x.rn = l.rn""", "rsi")
def w17(spark, d):
    return ind.rsi(bars(spark, d)).select("code", "trade_date", "rsi")


#: Directional indices of bars as a CTE `adx`, from `x` (NUMBERED); after WITH RECURSIVE.
ADX = f"""{NUMBERED}, mv AS (SELECT *, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM x {W}),
  dm AS MATERIALIZED (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS m FROM mv), {ema_sql('et', 'dm', 'tr', '(1.0 / 14)')}, {ema_sql('ep', 'dm', 'p', '(1.0 / 14)')}, {ema_sql('em', 'dm', 'm', '(1.0 / 14)')},
  di AS (SELECT dm.*, CASE WHEN et.y > 0 THEN 100 * ep.y / et.y END AS plus_di, CASE WHEN et.y > 0 THEN 100 * em.y / et.y END AS minus_di FROM dm JOIN et ON dm.code = et.code AND dm.rn = et.rn JOIN ep ON dm.code = ep.code AND dm.rn = ep.rn JOIN em ON dm.code = em.code AND dm.rn = em.rn),
  dx AS MATERIALIZED (SELECT *, coalesce(CASE WHEN plus_di + minus_di > 0 THEN 100 * abs(plus_di - minus_di) / (plus_di + minus_di) END, 0) AS dx FROM di), {ema_sql('ex', 'dx', 'dx', '(1.0 / 14)')},
  ax AS (SELECT dx.*, CASE WHEN dx.rn >= 14 THEN ex.y END AS adx FROM dx JOIN ex ON dx.code = ex.code AND dx.rn = ex.rn), adx AS (SELECT *, (adx + lag(adx, 14) OVER w) / 2 AS adxr FROM ax {W})"""


@query("w18_adx", f"WITH RECURSIVE {ADX} SELECT code, trade_date, plus_di, minus_di, adx, adxr FROM adx", "plus_di minus_di adx adxr")
def w18(spark, d):
    return ind.adx(bars(spark, d)).select("code", "trade_date", "plus_di", "minus_di", "adx", "adxr")


@query("w19_efficiency_ratio", f"""WITH {BARS}, s AS (SELECT *, abs(close - lag(close) OVER w) AS step FROM bars {W})
  SELECT code, trade_date, CASE WHEN count(step) OVER {frame(10)} >= 10 AND sum(step) OVER {frame(10)} > 0 THEN abs(close - lag(close, 10) OVER w) / sum(step) OVER {frame(10)} END AS er FROM s {W}""", "er")
def w19(spark, d):
    return ind.with_steps(bars(spark, d)).select("code", "trade_date", ind.efficiency_ratio("close", 10).alias("er"))


@query("w20_bias", f"""WITH RECURSIVE {NUMBERED}, {ema_sql('e', 'x', 'close', '(2.0 / 21)')}
  SELECT x.code, trade_date, CASE WHEN count(close) OVER (PARTITION BY x.code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20 THEN close / avg(close) OVER (PARTITION BY x.code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - 1 END AS bias, 100 * (ln(close) - ln(e.y)) AS log_bias
  FROM x JOIN e ON x.code = e.code AND x.rn = e.rn""", "bias log_bias")
def w20(spark, d):
    df = scan.ema(bars(spark, d), "_e", "close", scan.span(20))
    return df.select("code", "trade_date", (F.col("close") / ind.sma("close", 20, 20) - 1).alias("bias"), (100 * (F.ln("close") - F.ln("_e"))).alias("log_bias"))


@query("w21_range_vol", f"""WITH {BARS}, l AS (SELECT *, ln(high / low) AS hl, ln(close / open) AS co, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs, ln(open / lag(close) OVER w) AS ov FROM bars {W})
  SELECT code, trade_date, CASE WHEN count(*) OVER {frame(20)} >= 20 THEN sqrt(greatest(avg(hl * hl / (4 * ln(2))) OVER {frame(20)}, 0) * 252) END AS parkinson,
  CASE WHEN count(*) OVER {frame(20)} >= 20 THEN sqrt(greatest(avg(0.5 * hl * hl - (2 * ln(2) - 1) * co * co) OVER {frame(20)}, 0) * 252) END AS garman_klass,
  CASE WHEN count(*) OVER {frame(20)} >= 20 THEN sqrt(greatest(avg(rs) OVER {frame(20)}, 0) * 252) END AS rogers_satchell,
  CASE WHEN count(ov) OVER {frame(20)} >= 20 THEN sqrt(greatest(var_samp(ov) OVER {frame(20)} + 0.34 / (1.34 + 21.0 / 19) * var_samp(co) OVER {frame(20)} + (1 - 0.34 / (1.34 + 21.0 / 19)) * avg(rs) OVER {frame(20)}, 0) * 252) END AS yang_zhang FROM l""", "parkinson garman_klass rogers_satchell yang_zhang")
def w21(spark, d):
    df = bars(spark, d).withColumns(ind.range_volatility(20))
    return ind.yang_zhang(df, 20).select("code", "trade_date", "parkinson", "garman_klass", "rogers_satchell", "yang_zhang")


@query("w22_ewma_vol", f"""WITH RECURSIVE {RET}, x AS MATERIALIZED (SELECT code, trade_date, lr * lr AS sq, row_number() OVER w AS rn FROM r WHERE lr IS NOT NULL {W}), {ema_sql('e', 'x', 'sq', '(1 - 0.94)')}
  SELECT r.code, r.trade_date, sqrt(e.y * 252) AS ewma_vol FROM r LEFT JOIN x ON r.code = x.code AND r.trade_date = x.trade_date LEFT JOIN e ON x.code = e.code AND x.rn = e.rn""", "ewma_vol")
def w22(spark, d):
    return ind.ewma_volatility(ind.with_returns(bars(spark, d))).select("code", "trade_date", "ewma_vol")


def eliminated(source: str, keep: str, rows: list[list[str]], pivots: list[int]) -> tuple[str, list[str]]:
    """CTEs that eliminate a bordered matrix of SQL expressions pivot by pivot, and the corner's column after each of `pivots`.

    With [G v; u 0] the corner after all pivots is -u G^-1 v; with [G v; v' yy] it is what a regression leaves of yy.
    """
    n = len(rows)
    cell = lambda k, i, j: f"c{k}_{i}_{j}"
    parts = [f"g0 AS (SELECT {keep}, " + ", ".join(f"{rows[i][j]} AS {cell(0, i, j)}" for i in range(n) for j in range(n)) + f" FROM {source})"]
    for k in range(n - 1):
        left = ", ".join(f"{cell(k, i, j)} - {cell(k, i, k)} / {cell(k, k, k)} * {cell(k, k, j)} AS {cell(k + 1, i, j)}" for i in range(k + 1, n) for j in range(k + 1, n))
        kept = ", ".join([keep, *(cell(p, n - 1, n - 1) for p in pivots if p <= k)])
        parts.append(f"g{k + 1} AS (SELECT {kept}, {left} FROM g{k})")
    return ", ".join(parts), [cell(p, n - 1, n - 1) for p in pivots]


def har_sql() -> str:
    names, asked = ["1.0", "l1", "l5", "l22"], ["1.0", "l1", "l5", "l22"]
    sums = [[f"sum(CASE WHEN ok THEN {a} * {b} END) OVER p" for b in (*names, "rv")] for a in names]
    steps, (corner,) = eliminated("sm", "code, trade_date", [[f"s_{i}_{j}" for j in range(5)] for i in range(4)] + [[*asked, "0.0"]], [4])
    flat = ", ".join(f"{sums[i][j]} AS s_{i}_{j}" for i in range(4) for j in range(5))
    return f"""WITH {BARS}, v AS (SELECT code, trade_date, pow(ln(high / low), 2) AS rv FROM bars), f AS (SELECT *, lag(rv) OVER w AS l1, avg(rv) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l5,
      CASE WHEN count(rv) OVER q >= 22 THEN avg(rv) OVER q END AS l22 FROM v WINDOW w AS (PARTITION BY code ORDER BY trade_date), q AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING)),
      k AS (SELECT *, l22 IS NOT NULL AND rv IS NOT NULL AS ok FROM f), z AS (SELECT *, count(CASE WHEN ok THEN 1 END) OVER p AS n, {flat} FROM k WINDOW p AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
      sm AS (SELECT * FROM z WHERE ok AND n >= 20), {steps} SELECT v.code, v.trade_date, CASE WHEN {corner} IS NOT NULL THEN greatest(-{corner}, 0) END AS har FROM v LEFT JOIN g4 ON v.code = g4.code AND v.trade_date = g4.trade_date"""


@query("w23_har", har_sql(), "har")
def w23(spark, d):
    df = bars(spark, d).withColumn("rv", F.pow(F.ln(F.col("high") / F.col("low")), 2))
    return ind.har_forecast(df, "rv").select("code", "trade_date", "har")


@query("w24_volatility_by_name", f"""WITH RECURSIVE {RET}, x AS MATERIALIZED (SELECT code, trade_date, lr * lr AS sq, row_number() OVER w AS rn FROM r WHERE lr IS NOT NULL {W}), {ema_sql('e', 'x', 'sq', '(1 - 0.94)')},
  l AS (SELECT *, ln(high / low) AS hl, ln(close / open) AS co, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs, ln(open / lag(close) OVER w) AS ov FROM r {W})
  SELECT code, trade_date, 'close' AS estimator, CASE WHEN count(lr) OVER {frame(20)} >= 20 THEN stddev_samp(lr) OVER {frame(20)} * sqrt(252) END AS vol FROM r
  UNION ALL SELECT r.code, r.trade_date, 'ewma', sqrt(e.y * 252) FROM r LEFT JOIN x ON r.code = x.code AND r.trade_date = x.trade_date LEFT JOIN e ON x.code = e.code AND x.rn = e.rn
  UNION ALL SELECT code, trade_date, 'parkinson', CASE WHEN count(*) OVER {frame(20)} >= 20 THEN sqrt(greatest(avg(hl * hl / (4 * ln(2))) OVER {frame(20)}, 0) * 252) END FROM l
  UNION ALL SELECT code, trade_date, 'yang_zhang', CASE WHEN count(ov) OVER {frame(20)} >= 20 THEN sqrt(greatest(var_samp(ov) OVER {frame(20)} + 0.34 / (1.34 + 21.0 / 19) * var_samp(co) OVER {frame(20)} + (1 - 0.34 / (1.34 + 21.0 / 19)) * avg(rs) OVER {frame(20)}, 0) * 252) END FROM l""", "vol")
def w24(spark, d):
    b = bars(spark, d)
    kinds = ("close", "ewma", "parkinson", "yang_zhang")
    parts = [ind.volatility(b, k).select("code", "trade_date", F.lit(k).alias("estimator"), "vol") for k in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("w25_impulse", f"""WITH RECURSIVE {NUMBERED}, {ema_sql('f', 'x', 'close', '(2.0 / 13)')}, {ema_sql('g', 'x', 'close', '(2.0 / 27)')}, {ema_sql('k', 'x', 'close', '(2.0 / 14)')},
  mm AS MATERIALIZED (SELECT f.code, f.rn, f.y - g.y AS macd FROM f JOIN g ON f.code = g.code AND f.rn = g.rn), {ema_sql('sg', 'mm', 'macd', '0.2')},
  h AS (SELECT x.code, trade_date, k.y - lag(k.y) OVER w AS e, macd - sg.y - lag(macd - sg.y) OVER w AS h FROM x JOIN mm ON x.code = mm.code AND x.rn = mm.rn JOIN sg ON x.code = sg.code AND x.rn = sg.rn JOIN k ON x.code = k.code AND x.rn = k.rn WINDOW w AS (PARTITION BY x.code ORDER BY trade_date))
  SELECT code, trade_date, CASE WHEN e > 0 AND h > 0 THEN 'BULL' WHEN e < 0 AND h < 0 THEN 'BEAR' ELSE 'NEUTRAL' END AS impulse FROM h""")
def w25(spark, d):
    return ind.impulse(bars(spark, d)).select("code", "trade_date", "impulse")


@query("w26_bands", f"WITH {BARS} SELECT code, trade_date, CASE WHEN count(*) OVER {frame(60)} >= 60 THEN avg(close) OVER {frame(60)} + 2 * stddev_samp(close) OVER {frame(60)} END AS upper, CASE WHEN count(*) OVER {frame(60)} >= 60 THEN avg(close) OVER {frame(60)} - 2 * stddev_samp(close) OVER {frame(60)} END AS lower FROM bars", "upper lower")
def w26(spark, d):
    mid, sd = ind.sma("close", 60, 60), ind.rolling_std("close", 60, 60)
    return bars(spark, d).select("code", "trade_date", (mid + 2 * sd).alias("upper"), (mid - 2 * sd).alias("lower"))


ACF = f"""WITH {RET}, x AS (SELECT code, lr - avg(lr) OVER (PARTITION BY code) AS y, row_number() OVER w AS rn, count(*) OVER (PARTITION BY code) AS n FROM r WHERE lr IS NOT NULL {W}),
  v AS (SELECT code, sum(y * y) AS v, max(n) AS n FROM x GROUP BY code),
  c AS (SELECT a.code, k AS lag, sum(a.y * b.y) AS c FROM x a CROSS JOIN range(1, 21) t(k) JOIN x b ON a.code = b.code AND b.rn = a.rn + k GROUP BY a.code, k)
  SELECT c.code, lag::INT AS lag, c / v AS acf, 1.96 / sqrt(n) AS bound, n * (n + 2) * sum((c / v) * (c / v) / (n - lag)) OVER (PARTITION BY c.code ORDER BY lag) AS q FROM c JOIN v ON c.code = v.code"""


@query("w27_autocorrelation", ACF, "acf bound q")
def w27(spark, d):
    return ind.autocorrelation(ind.with_returns(bars(spark, d)), "lr")


@query("w27_ljung_box", f"""WITH ac AS ({ACF}), h AS (SELECT code, lag, q, q / 2 AS h FROM ac)
  SELECT code, lag, q, least(1, CASE WHEN lag % 2 = 1 THEN {erfc_sql('sqrt(h)')} + coalesce(list_sum(list_transform(range(1, lag // 2 + 1), lambda j: exp(-h + (j - 0.5) * ln(h) - lgamma(j + 0.5)))), 0) ELSE list_sum(list_transform(range(0, lag // 2), lambda j: exp(-h + j * ln(h) - lgamma(j + 1.0)))) END) AS p FROM h""", "q p")
def w27p(spark, d):
    """Ljung-Box statistic up to each lag with its chi-square tail."""
    a = ind.autocorrelation(ind.with_returns(bars(spark, d)), "lr")
    return a.select("code", "lag", "q", chi_square_tail(F.col("q"), F.col("lag")).alias("p"))


SPECTRUM = f"""WITH {RET}, b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS back FROM r WHERE lr IS NOT NULL),
  y AS (SELECT code, count(*) OVER (PARTITION BY code) AS n, count(*) OVER (PARTITION BY code) - back AS t, lr - avg(lr) OVER (PARTITION BY code) AS y FROM b WHERE back <= 126),
  h AS (SELECT code, n, t, y * (0.5 - 0.5 * cos(2 * pi() * t / (n - 1))) AS y FROM y),
  s AS (SELECT code, k, n, sum(y * cos(2 * pi() * k * t / n)) AS re, sum(y * sin(2 * pi() * k * t / n)) AS im FROM h CROSS JOIN range(1, 64) q(k) WHERE k <= n / 2.0 GROUP BY code, k, n)
  SELECT code, k::INT AS k, n / k AS period, re * re + im * im AS power, (re * re + im * im) / sum(re * re + im * im) OVER (PARTITION BY code) AS share FROM s"""


@query("w28_spectrum", SPECTRUM, "period power share")
def w28(spark, d):
    return ind.spectrum(ind.with_returns(bars(spark, d)), "lr")


@query("w28_top_periods", f"WITH sp AS ({SPECTRUM}) SELECT code, row_number() OVER (PARTITION BY code ORDER BY power DESC, period DESC)::INT AS rank, period, share FROM sp QUALIFY rank <= 3", "period share")
def w28t(spark, d):
    """The three strongest periods of the last 126 days."""
    return ind.top_periods(ind.spectrum(ind.with_returns(bars(spark, d)), "lr"))


@query("w29_deviations", f"""WITH {RET}, l AS (SELECT *, ln(greatest(high / low - 1, 1e-9)) AS lv, ln(amount) AS la FROM r)
  SELECT code, trade_date, CASE WHEN count(lr) OVER {frame(20)} >= 20 THEN lr - avg(lr) OVER {frame(20)} END AS ret_dev, CASE WHEN count(lv) OVER {frame(20)} >= 20 THEN lv - avg(lv) OVER {frame(20)} END AS vol_dev,
  CASE WHEN count(la) OVER {frame(20)} >= 20 THEN la - avg(la) OVER {frame(20)} END AS act_dev, CASE WHEN count(volume) OVER {frame(20)} >= 20 THEN volume / avg(volume) OVER {frame(20)} END AS rel_volume FROM l""", "ret_dev vol_dev act_dev rel_volume")
def w29(spark, d):
    return ind.deviations(bars(spark, d)).select("code", "trade_date", "ret_dev", "vol_dev", "act_dev", "rel_volume")


COMPOSITE = f"""{RET}, l AS (SELECT *, ln(greatest(high / low - 1, 1e-9)) AS lv, ln(amount) AS la FROM r), dv AS (SELECT trade_date, CASE WHEN count(lr) OVER {frame(20)} >= 20 THEN lr - avg(lr) OVER {frame(20)} END AS ret_dev,
  CASE WHEN count(lv) OVER {frame(20)} >= 20 THEN lv - avg(lv) OVER {frame(20)} END AS vol_dev, CASE WHEN count(la) OVER {frame(20)} >= 20 THEN la - avg(la) OVER {frame(20)} END AS act_dev FROM l),
  lg AS (SELECT trade_date, unnest(['ret_dev', 'vol_dev', 'act_dev']) AS feature, unnest([ret_dev, vol_dev, act_dev]) AS v FROM dv), dy AS (SELECT feature, trade_date, round(quantile_cont(v, 0.5), 9) AS v FROM lg WHERE v IS NOT NULL GROUP BY ALL),
  p1 AS (SELECT a.feature, a.trade_date, (sum((b.v < a.v)::INT) + 0.5 * sum((b.v = a.v)::INT)) / count(*) AS p FROM dy a JOIN dy b ON a.feature = b.feature AND b.trade_date <= a.trade_date GROUP BY ALL), mn AS (SELECT trade_date, round(avg(p), 12) AS v FROM p1 GROUP BY trade_date),
  cp AS (SELECT a.trade_date, (sum((b.v < a.v)::INT) + 0.5 * sum((b.v = a.v)::INT)) / count(*) AS composite FROM mn a JOIN mn b ON b.trade_date <= a.trade_date GROUP BY ALL)"""


@query("w30_composite", f"WITH {COMPOSITE} SELECT trade_date, composite FROM cp", "composite")
def w30(spark, d):
    return ind.composite(ind.deviations(bars(spark, d)), ["ret_dev", "vol_dev", "act_dev"])
