"""Queries K: weights, timing, costs, net values, and the strategy chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.frames import day, roll, series
from panelforge.operators import calendar as cal
from panelforge.operators import cross_section as xs
from panelforge.operators import indicators as ind
from panelforge.operators import performance as perf
from panelforge.operators import portfolio as pf
from panelforge.plans.indicators_queries import RET, W, frame
from panelforge.plans.panel_queries import WEEK
from panelforge.plans.registry import query
from panelforge.plans.signals_queries import DON, donchian
from panelforge.plans.views import BARS, bars, flows, FLOWS

#: The tables' prices are noise; compounded values take a thousandth of their returns, so that they stay in range.
DAMP = 1000


@query("k01_equal", f"WITH {DON} SELECT code, trade_date, 1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date) AS w FROM d WHERE pos > 0", "w")
def k01(spark, d):
    return donchian(spark, d).where("pos > 0").select("code", "trade_date", pf.equal().alias("w"))


VOL = f"{RET}, v AS (SELECT *, CASE WHEN count(r) OVER {frame(20)} >= 20 THEN stddev_samp(r) OVER {frame(20)} END AS vol FROM r)"


def with_vol(spark, d):
    return ind.with_returns(bars(spark, d)).withColumn("vol", ind.rolling_std("r", 20, 20))


@query("k02_inverse_vol", f"WITH {VOL} SELECT code, trade_date, CASE WHEN sum(1 / vol) OVER (PARTITION BY trade_date) > 0 THEN coalesce(1 / vol, 0) / sum(1 / vol) OVER (PARTITION BY trade_date) ELSE 1.0 / count(*) OVER (PARTITION BY trade_date) END AS w FROM v", "w")
def k02(spark, d):
    return with_vol(spark, d).select("code", "trade_date", pf.inverse_vol("vol").alias("w"))


@query("k03_risk_budget", f"WITH {BARS}, a AS (SELECT *, avg(high - low) OVER {frame(14)} AS atr FROM bars), r AS (SELECT code, trade_date, coalesce(CASE WHEN atr > 0 THEN 0.1 * close / atr END, 0) AS raw FROM a) SELECT code, trade_date, raw / greatest(1, sum(raw) OVER (PARTITION BY trade_date)) AS w FROM r", "w")
def k03(spark, d):
    a = bars(spark, d).withColumn("atr", F.avg(F.col("high") - F.col("low")).over(roll(series(), 14)))
    return a.select("code", "trade_date", pf.risk_budget(0.1, "atr").alias("w"))


@query("k05_vol_target", f"WITH {VOL} SELECT code, trade_date, CASE WHEN vol IS NULL OR vol > 0.9 THEN 0 ELSE least(1, 0.3 / vol) END AS scale FROM v", "scale")
def k05(spark, d):
    return with_vol(spark, d).select("code", "trade_date", pf.vol_target("vol", 0.3, 0.9).alias("scale"))


DRIFT = f"""{RET}, c AS (SELECT *, date_trunc('month', trade_date) AS period, 1.0 / count(*) OVER (PARTITION BY trade_date) AS w0 FROM r),
  g AS (SELECT *, w0 * coalesce(product(1 + coalesce(r, 0)) OVER (PARTITION BY code, period ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS g FROM c), w AS (SELECT *, g / sum(g) OVER (PARTITION BY trade_date) AS w FROM g)"""


def drift(spark, d):
    b = ind.with_returns(bars(spark, d)).withColumn("period", cal.label("trade_date", "M")).withColumn("w0", pf.equal())
    return pf.drifted(b, "period")


@query("k06_drifted", f"WITH {DRIFT} SELECT code, trade_date, w FROM w", "w")
def k06(spark, d):
    return drift(spark, d).select("code", "trade_date", "w")


@query("k08_equal_benchmark", f"WITH {RET} SELECT trade_date, avg(r) AS r, sum(coalesce(r, 0)) / 6 AS r_static FROM r GROUP BY trade_date", "r r_static")
def k08(spark, d):
    return ind.with_returns(bars(spark, d)).groupBy("trade_date").agg(F.avg("r").alias("r"), (F.sum(F.coalesce("r", F.lit(0.0))) / 6).alias("r_static"))


@query("k09_timing", f"WITH {DON} SELECT code, trade_date, pos::DOUBLE AS w_open, coalesce(lag(pos) OVER w, 0)::DOUBLE AS w_close, (pos + coalesce(lag(pos) OVER w, 0)) / 2.0 AS w_oc2 FROM d {W}", "w_open w_close w_oc2")
def k09(spark, d):
    df = donchian(spark, d).withColumn("w", F.col("pos").cast("double"))
    return df.select("code", "trade_date", *[pf.timed("w", h).alias(f"w_{h}") for h in ("open", "close", "oc2")])


@query("k10_fallback", f"""WITH {BARS}, n AS (SELECT code, trade_date, close / lag(close) OVER w AS rn, (close + 20) / lag(close + 20) OVER w AS rh FROM bars {W}), o AS (SELECT *, abs(rn / rh - 1) > 0.02 OR rn > 1.2 OR rn < 1 / 1.2 AS off FROM n)
  SELECT code, trade_date, CASE WHEN off THEN rh ELSE rn END AS gross, coalesce(off, false) AS fallback FROM o""", "gross")
def k10(spark, d):
    b = bars(spark, d).select("code", "trade_date", "close")
    return pf.with_fallback(b, b.withColumn("close", F.col("close") + 20))


@query("k11_turnover", f"WITH {DRIFT} SELECT trade_date, sum(t) AS turnover, sum(t) * 2 * 0.0005 AS cost FROM (SELECT trade_date, abs(w - coalesce(lag(w) OVER x, 0)) / 2 AS t FROM w WINDOW x AS (PARTITION BY code ORDER BY trade_date)) GROUP BY trade_date", "turnover cost")
def k11(spark, d):
    t = drift(spark, d).withColumn("t", pf.turnover("w")).groupBy("trade_date").agg(F.sum("t").alias("turnover"))
    return t.withColumn("cost", F.col("turnover") * 2 * 0.0005)


@query("k12_daily_turnover", f"""WITH {RET}, w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY trade_date) AS w FROM r), p AS (SELECT *, sum(w * coalesce(r, 0)) OVER (PARTITION BY trade_date) AS pr FROM w),
  b AS (SELECT *, lag(w) OVER x * (1 + coalesce(lag(r) OVER x, 0)) / (1 + lag(pr) OVER x) AS bw FROM p WINDOW x AS (PARTITION BY code ORDER BY trade_date)) SELECT trade_date, sum(abs(w - coalesce(bw, 0)) / 2) AS turnover FROM b GROUP BY trade_date""", "turnover")
def k12(spark, d):
    return pf.daily_turnover(ind.with_returns(bars(spark, d)).withColumn("w", pf.equal()))


@query("k13_net_value", f"""WITH {DRIFT}, t AS (SELECT *, abs(w - coalesce(lag(w) OVER x, 0)) / 2 AS t FROM w WINDOW x AS (PARTITION BY code ORDER BY trade_date)),
  n AS (SELECT trade_date, sum(w * coalesce(r, 0)) / 1000 - sum(t) * 2 * 5 / 10000 AS r FROM t GROUP BY trade_date) SELECT trade_date, r, CASE WHEN row_number() OVER (ORDER BY trade_date) = 1 THEN 1 ELSE product(1 + r) OVER (ORDER BY trade_date) END AS nav FROM n""", "r nav")
def k13(spark, d):
    n = pf.net(drift(spark, d).withColumn("r", F.col("r") / DAMP)).withColumn("strategy", F.lit("s"))
    return pf.nav(n).select("trade_date", "r", "nav")


@query("k14_cash_leg", f"WITH {DON}, x AS (SELECT *, close / lag(close) OVER w - 1 AS r FROM d {W}), p AS (SELECT trade_date, sum(pos) / 6.0 AS sum_w, sum(pos / 6.0 * coalesce(r, 0)) AS r FROM x GROUP BY trade_date) SELECT trade_date, sum_w, r + (1 - sum_w) * 0.0001 AS r FROM p", "sum_w r")
def k14(spark, d):
    x = donchian(spark, d).withColumn("r", F.col("close") / F.lag("close").over(series()) - 1)
    p = x.groupBy("trade_date").agg((F.sum("pos") / 6).alias("sum_w"), F.sum(F.col("pos") / 6 * F.coalesce("r", F.lit(0.0))).alias("r"))
    return pf.with_cash(p, p.select("trade_date", F.lit(0.0001).alias("r"))).select("trade_date", "sum_w", "r")


@query("k15_decomposition", f"""WITH {BARS}, x AS (SELECT *, open / lag(close) OVER w - 1 AS onr, close / open - 1 AS inr, 1.0 / 6 AS w FROM bars {W}) SELECT trade_date, sum(w * coalesce(onr, 0)) AS overnight, sum(w * CASE WHEN onr IS NOT NULL THEN inr ELSE 0 END) AS intraday, sum(w * coalesce(onr * inr, 0)) AS interaction FROM x GROUP BY trade_date""", "overnight intraday interaction")
def k15(spark, d):
    return pf.decomposed(bars(spark, d).withColumn("w", F.lit(1 / 6)))


@query("k17_anchor_average", f"""WITH {BARS}, a AS (SELECT unnest([1, 2, 3, 4, 5]) AS k), e AS (SELECT k, max(trade_date) AS dd FROM (SELECT DISTINCT trade_date FROM bars), a GROUP BY k, trade_date + ((k - isodow(trade_date) + 7) % 7)::INTEGER)
  SELECT dd AS trade_date, count(*) / 5.0 AS share FROM e GROUP BY dd""", "share")
def k17(spark, d):
    days = cal.sessions(bars(spark, d))
    parts = [cal.period_ends(days, "W", a).select(F.lit(a).alias("anchor"), "decision_date") for a in cal.ANCHORS]
    all_parts = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])
    return all_parts.groupBy(F.col("decision_date").alias("trade_date")).agg((F.count("*") / 5).alias("share"))


@query("k18_capacity", f"""WITH {DRIFT}, cw AS (SELECT *, abs(w - coalesce(lag(w) OVER x, 0)) AS dw FROM w WINDOW x AS (PARTITION BY code ORDER BY trade_date)), m AS (SELECT rate, trade_date, min(amount * rate / dw) AS c FROM cw, (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS rate) WHERE dw > 1e-9 GROUP BY ALL)
  SELECT rate, quantile_cont(c, 0.1) AS p10, quantile_cont(c, 0.5) AS p50 FROM m GROUP BY rate""", "p10 p50", 2)
def k18(spark, d):
    return pf.capacity(drift(spark, d))


@query("k19_ma_cost_backtest", f"""WITH {RET}, p AS (SELECT *, (close > avg(close) OVER {frame(20)})::INT AS sig FROM r), q AS (SELECT *, coalesce(lag(sig) OVER w, 0) AS pos FROM p {W}), c AS (SELECT *, pos * coalesce(r, 0) - abs(pos - coalesce(lag(pos) OVER w, 0)) * 0.0005 AS net FROM q {W})
  SELECT code, product(1 + net) - 1 AS total, sum(abs(net) * 0 + (net <> 0)::INT)::BIGINT AS active FROM c GROUP BY code""", "total")
def k19(spark, d):
    w = series()
    p = ind.with_returns(bars(spark, d)).withColumn("sig", (F.col("close") > F.avg("close").over(roll(w, 20))).cast("int")).withColumn("pos", F.coalesce(F.lag("sig").over(w), F.lit(0)))
    n = p.withColumn("net", F.col("pos") * F.coalesce("r", F.lit(0.0)) - F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0))) * 0.0005)
    return n.groupBy("code").agg((F.product(1 + F.col("net")) - 1).alias("total"), F.sum((F.col("net") != 0).cast("int")).alias("active"))


def rotation(df, days, score: str, k: int, period: str = "W", cost_bps: float = 5.0, keys: tuple[str, ...] = ()):
    """Rotation chain: picks on decision days, held from the next session through the next decision, equal weights, net value."""
    decisions = cal.period_ends(days, period)
    at = df.join(decisions.select(F.col("decision_date").alias("trade_date")).hint("merge"), "trade_date", "left_semi")
    chosen = xs.picks(at, score, k, keys).withColumn("w", F.lit(1.0 / abs(k))).select(*keys, F.col("trade_date").alias("decision_date"), "code", "w")
    grid = df.join(cal.held(days, decisions).hint("merge"), "trade_date")
    rows = grid.join(chosen.hint("merge"), [*keys, "decision_date", "code"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    return pf.net(rows, cost_bps=cost_bps, keys=keys)


ROT = f"""{RET}, sc AS (SELECT *, lag(close, 5) OVER w / lag(close, 25) OVER w - 1 AS mom FROM r {W}), s AS (SELECT DISTINCT trade_date FROM bars), dd AS (SELECT max(trade_date) AS decision_date FROM s GROUP BY {WEEK}),
  pk AS (SELECT trade_date AS decision_date, code, 0.5 AS w FROM sc WHERE mom IS NOT NULL AND trade_date IN (SELECT decision_date FROM dd) QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY mom DESC, code) <= 2),
  h AS (SELECT trade_date, last_value(decision_date IGNORE NULLS) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS decision_date FROM (SELECT trade_date, decision_date FROM s LEFT JOIN dd ON trade_date = decision_date)),
  rw AS (SELECT sc.code, sc.trade_date, sc.r, coalesce(pk.w, 0) AS w FROM sc JOIN h ON sc.trade_date = h.trade_date AND h.decision_date IS NOT NULL LEFT JOIN pk ON pk.decision_date = h.decision_date AND pk.code = sc.code),
  tn AS (SELECT *, abs(w - coalesce(lag(w) OVER x, 0)) / 2 AS t FROM rw WINDOW x AS (PARTITION BY code ORDER BY trade_date)), nt AS (SELECT trade_date, sum(w * coalesce(r, 0)) / 1000 AS gross, sum(t) AS turnover, sum(w * coalesce(r, 0)) / 1000 - sum(t) * 2 * 5 / 10000 AS r FROM tn GROUP BY trade_date)"""


@query("k20_rotation", f"""WITH {ROT}, nv AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY trade_date) = 1 THEN 1 ELSE product(1 + r) OVER (ORDER BY trade_date) END AS nav FROM nt)
  SELECT trade_date, gross, turnover, r, nav, nav / max(nav) OVER (ORDER BY trade_date) - 1 AS drawdown FROM nv""", "gross turnover r nav drawdown")
def k20(spark, d):
    b = ind.with_returns(bars(spark, d)).withColumn("mom", xs.trailing_return(20, 5))
    n = rotation(b.withColumn("r", F.col("r") / DAMP), cal.sessions(b), "mom", 2).withColumn("strategy", F.lit("rotation"))
    return perf.with_drawdown(pf.nav(n)).select("trade_date", "gross", "turnover", "r", "nav", "drawdown")


@query("k21_trend_portfolio", f"""WITH {DON}, x AS (SELECT *, close / lag(close) OVER w - 1 AS r, coalesce(lag(pos) OVER w, 0) AS held FROM d {W}), q AS (SELECT code, trade_date, r, CASE WHEN held > 0 THEN 1.0 / sum(held) OVER (PARTITION BY trade_date) ELSE 0 END AS w FROM x),
  tn AS (SELECT *, abs(w - coalesce(lag(w) OVER y, 0)) / 2 AS t FROM q WINDOW y AS (PARTITION BY code ORDER BY trade_date)) SELECT trade_date, sum(w * coalesce(r, 0)) AS gross, sum(t) AS turnover, sum(w * coalesce(r, 0)) - sum(t) * 2 * 5 / 10000 AS r FROM tn GROUP BY trade_date""", "gross turnover r")
def k21(spark, d):
    w = series()
    x = donchian(spark, d).withColumn("r", F.col("close") / F.lag("close").over(w) - 1).withColumn("held", F.coalesce(F.lag("pos").over(w), F.lit(0)))
    return pf.net(x.withColumn("w", F.when(F.col("held") > 0, 1.0 / F.sum("held").over(day())).otherwise(0.0)))


@query("k22_contributions", f"""WITH {RET}, m AS (SELECT code, trade_date, r, CASE WHEN date_trunc('month', trade_date) IS DISTINCT FROM date_trunc('month', lag(trade_date) OVER w) THEN 1000.0 ELSE 0 END AS c FROM r WHERE r IS NOT NULL {W}), g AS (SELECT *, product(1 + r / 1000) OVER w AS g FROM m {W}), h AS (SELECT *, coalesce(lag(g) OVER w, 1) AS g0 FROM g {W})
  SELECT code, trade_date, g * sum(c / g0) OVER w AS account, sum(c) OVER w AS invested, g - 1 AS twr FROM h {W}""", "account invested twr", 3)
def k22(spark, d):
    m = ind.with_returns(bars(spark, d)).where("r IS NOT NULL")
    new = ~F.trunc("trade_date", "month").eqNullSafe(F.lag(F.trunc("trade_date", "month")).over(series()))
    m = m.withColumn("c", F.when(new, 1000.0).otherwise(0.0)).withColumn("r", F.col("r") / DAMP)
    return pf.contributions(m, "c", "r", ("code",)).select("code", "trade_date", "account", "invested", "twr")


@query("k24_calendar_timing", f"""WITH {BARS}, s AS (SELECT DISTINCT trade_date FROM bars), t AS (SELECT DISTINCT date_trunc('month', trade_date)::DATE + 9 AS td FROM s), e AS (SELECT DISTINCT min(s.trade_date) AS entry_date FROM t JOIN s ON s.trade_date >= td GROUP BY td),
  n AS (SELECT code, trade_date, close, lead(trade_date, 5) OVER w AS exit_date, lead(close, 5) OVER w AS exit_close FROM bars {W}) SELECT code, entry_date, exit_date, exit_close / close - 1 AS ret FROM e JOIN n ON entry_date = trade_date""", "ret")
def k24(spark, d):
    b = bars(spark, d)
    w = series()
    n = b.select("code", F.col("trade_date").alias("session"), "trade_date", "close").withColumn("exit_date", F.lead("trade_date", 5).over(w)).withColumn("ret", F.lead("close", 5).over(w) / F.col("close") - 1)
    days = cal.sessions(b)
    return cal.snapped(cal.month_anchor(days, 10), days, "next").select("session").distinct().join(n.hint("merge"), "session").select("code", F.col("session").alias("entry_date"), "exit_date", "ret")


#: Rows of round trips of the channel positions, numbered.
TRADE = f"""{DON}, x AS (SELECT *, close / lag(close) OVER w - 1 AS dr, coalesce(lag(pos) OVER w, 0) AS wt FROM d {W}), y AS (SELECT *, wt > 0 AS o, wt * coalesce(dr, 0) AS r FROM x), z AS (SELECT *, o AND NOT coalesce(lag(o) OVER w, false) AS nw, NOT o AND coalesce(lag(o) OVER w, false) AS tl FROM y {W}),
  q AS (SELECT *, sum(nw::INT) OVER w AS trade FROM z {W})"""
TRADES_OF = "tr AS (SELECT code, trade::BIGINT AS trade, min(trade_date) AS entry_date, max(CASE WHEN o THEN trade_date END) AS last_date, sum(o::INT)::BIGINT AS days, product(1 + r) - 1 AS ret, bool_or(tl) AS closed FROM q WHERE o OR tl GROUP BY code, trade)"


@query("t01_trades", f"WITH {TRADE}, {TRADES_OF} SELECT * FROM tr", "ret")
def t01(spark, d):
    return all_trades(spark, d)


def weighted(spark, d):
    """Channel positions as weights from the day after, and what they earn."""
    w = series()
    return donchian(spark, d).withColumn("w", F.coalesce(F.lag("pos").over(w), F.lit(0))).withColumn("r", F.col("w") * F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)))


def all_trades(spark, d):
    return pf.trades(weighted(spark, d))


NPV = "list_sum(list_transform(f, lambda x: x.amount / pow(1 + {0}, x.t)))"


@query("m16_xirr", f"""WITH RECURSIVE {FLOWS}, dl AS (SELECT account_id, flow_date, sum(amount) AS amount FROM flows GROUP BY ALL), ft AS (SELECT account_id, flow_date, amount, datediff('day', min(flow_date) OVER (PARTITION BY account_id), flow_date) / 365.2425 AS t FROM dl), fl AS MATERIALIZED (SELECT account_id, list({{'t': t::DOUBLE, 'amount': amount}} ORDER BY t) AS f FROM ft GROUP BY account_id),
  b AS (SELECT account_id, 0 AS k, -0.99::DOUBLE AS a, 10.0::DOUBLE AS b FROM fl UNION ALL SELECT account_id, k, CASE WHEN same THEN mid ELSE a END, CASE WHEN same THEN b ELSE mid END FROM (SELECT b.account_id, k + 1 AS k, a, b, (a + b) / 2 AS mid, sign({NPV.format('((a + b) / 2)')}) = sign({NPV.format('(-0.99::DOUBLE)')}) AS same FROM b JOIN fl ON b.account_id = fl.account_id WHERE k < 60))
  SELECT fl.account_id, CASE WHEN sign({NPV.format('(-0.99::DOUBLE)')}) * sign({NPV.format('10.0::DOUBLE')}) < 0 THEN (a + b) / 2 END AS xirr FROM fl JOIN b ON fl.account_id = b.account_id AND k = 60""", "xirr")
def m16(spark, d):
    return perf.xirr(flows(spark, d))


@query("m16_flow_totals", f"WITH {FLOWS} SELECT account_id, count(*) AS n, sum(amount) AS total, min(flow_date) AS first_date FROM flows GROUP BY account_id", "total")
def m16b(spark, d):
    return flows(spark, d).groupBy("account_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.min("flow_date").alias("first_date"))
