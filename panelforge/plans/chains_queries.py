"""Queries of the long chains, of trading diagnostics and reports, and of the operators that had none of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.frames import roll, series
from panelforge.functions.storage import shared_dir
from panelforge.operators import calendar as cal
from panelforge.operators import chains
from panelforge.operators import cross_section as xs
from panelforge.operators import indicators as ind
from panelforge.operators import performance as perf
from panelforge.operators import portfolio as pf
from panelforge.operators import studies as st
from panelforge.plans.indicators_queries import RET, W, frame
from panelforge.plans.portfolio_queries import DAMP, WEEK
from panelforge.plans.registry import query
from panelforge.plans.signals_queries import DON, UPTO, donchian
from panelforge.plans.studies_queries import MKT, bootstrap_sql, with_market
from panelforge.plans.views import BARS, BRANDS, CONTRACTS, TRADES, bars, brand_bars, contracts, table, trades
from panelforge.sources import prices

METRICS = ["total", "annual", "vol", "sharpe", "sortino", "max_drawdown", "max_under_water", "ulcer", "calmar", "ulcer_performance"]


def metrics_sql(source: str, key: str = "strategy") -> str:
    """CTEs over rows (key, trade_date, nav) that end in `mt`, the bundle of metrics."""
    w = f"PARTITION BY {key} ORDER BY trade_date"
    return f"""m1 AS (SELECT {key}, trade_date, nav, nav / lag(nav) OVER ({w}) - 1 AS r, max(nav) OVER ({w}) AS peak FROM {source}), m2 AS (SELECT *, nav / peak - 1 AS dd, last_value(CASE WHEN nav >= peak THEN trade_date END IGNORE NULLS) OVER ({w}) AS top FROM m1),
      m3 AS (SELECT {key}, count(nav) AS n, arg_max(nav, trade_date) / arg_min(nav, trade_date) AS g, avg(r) AS m, stddev_samp(r) AS s, stddev_samp(CASE WHEN r IS NOT NULL THEN least(r, 0) END) AS ds, min(dd) AS max_drawdown, max(datediff('day', top, trade_date))::INT AS max_under_water, sqrt(avg(pow(dd * 100, 2))) AS ulcer FROM m2 GROUP BY {key}),
      m4 AS (SELECT *, g - 1 AS total, CASE WHEN n > 1 THEN pow(g, 252.0 / (n - 1)) - 1 END AS annual, s * sqrt(252) AS vol, CASE WHEN abs(s) > 1e-12 THEN m / s * sqrt(252) END AS sharpe, CASE WHEN abs(ds) > 1e-12 THEN m / ds * sqrt(252) END AS sortino FROM m3),
      mt AS (SELECT {key}, n, max_drawdown, max_under_water, ulcer, total, annual, vol, sharpe, sortino, CASE WHEN abs(max_drawdown) > 1e-12 THEN annual / abs(max_drawdown) END AS calmar, CASE WHEN abs(ulcer) > 1e-12 THEN annual * 100 / ulcer END AS ulcer_performance FROM m4)"""


def rank_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY trade_date) END"


CHAIN = f"""{RET}, p0 AS (SELECT code, trade_date, open, high, low, close, r / {DAMP} AS r, lag(close, 5) OVER w / lag(close, 25) OVER w - 1 AS mom, CASE WHEN count(r) OVER {frame(20)} >= 20 THEN avg(r) OVER {frame(20)} / stddev_samp(r) OVER {frame(20)} END AS shp, CASE WHEN count(lr) OVER {frame(20)} >= 20 THEN stddev_samp(lr) OVER {frame(20)} END AS vol,
    avg(high - low) OVER {frame(14)} AS atr, close > avg(close) OVER {frame(20)} AS above, substr(code, 1, 1) AS grp FROM r {W}),
  pn AS (SELECT *, 0.6 * ({rank_sql('mom')}) + 0.4 * ({rank_sql('shp')}) AS score FROM p0), s AS (SELECT DISTINCT trade_date FROM bars), dd AS (SELECT max(trade_date) AS decision_date FROM s GROUP BY {WEEK}),
  da AS (SELECT *, bool_or(above) OVER (PARTITION BY trade_date) AS risk_on FROM pn WHERE trade_date IN (SELECT decision_date FROM dd)), ok AS (SELECT * FROM da WHERE risk_on AND above AND score IS NOT NULL AND vol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date, grp ORDER BY score DESC, code) = 1),
  tp AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, code) <= 2), iv AS (SELECT *, (1 / vol) / sum(1 / vol) OVER (PARTITION BY trade_date) AS iw, avg(vol) OVER (PARTITION BY trade_date) AS mv FROM tp),
  pk AS (SELECT trade_date AS decision_date, code, iw * CASE WHEN mv > 1.5 THEN 0 ELSE least(1, 0.7 / mv) END AS w, close - 3 * atr AS stop FROM iv),
  hd AS (SELECT trade_date, last_value(decision_date IGNORE NULLS) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS decision_date FROM (SELECT trade_date, decision_date FROM s LEFT JOIN dd ON trade_date = decision_date)),
  gr AS (SELECT pn.*, hd.decision_date, coalesce(pk.w, 0) AS w0, pk.stop FROM pn JOIN hd ON pn.trade_date = hd.trade_date AND hd.decision_date IS NOT NULL LEFT JOIN pk ON pk.decision_date = hd.decision_date AND pk.code = pn.code),
  ex AS (SELECT *, CASE WHEN coalesce(max((low < stop)::INT) OVER (PARTITION BY code, decision_date ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 0 ELSE w0 END AS w FROM gr),
  tn AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY code ORDER BY trade_date), 0)) / 2 AS t FROM ex), dl AS (SELECT trade_date, sum(w * coalesce(r, 0)) AS gross, sum(t) AS turnover, sum(t * 2 * CASE WHEN code = 'AF' THEN 2.0 ELSE 5.0 END / 10000) AS cost, sum(w) AS sum_w FROM tn GROUP BY trade_date),
  nr AS (SELECT *, gross - cost + (1 - sum_w) * month(trade_date) * 0.000001 AS r FROM dl)"""


def chain(spark, d):
    """Daily result and weights of the rotation chain with filters, groups, inverse vol, vol cap, stops, cash and costs by code."""
    b = ind.with_returns(bars(spark, d))
    b = b.withColumn("mom", xs.trailing_return(20, 5)).withColumn("shp", xs.ratio_score("r", 20)).withColumn("vol", ind.rolling_std("lr", 20, 20))
    b = b.withColumn("atr", F.avg(F.col("high") - F.col("low")).over(roll(series(), 14))).withColumn("above", F.col("close") > F.avg("close").over(roll(series(), 20))).withColumn("grp", F.substring("code", 1, 1))
    b = b.withColumn("_m", xs.pct_rank("mom")).withColumn("_s", xs.pct_rank("shp")).withColumn("score", xs.weighted({"_m": 0.6, "_s": 0.4})).withColumn("r", F.col("r") / DAMP)
    days = cal.sessions(b)
    cash = days.withColumn("r", F.month("trade_date") * 0.000001)
    return chains.rotation(b.select("code", "trade_date", "open", "high", "low", "close", "r", "score", "above", "vol", "atr", "grp"), days, 2, vol_cap=0.7, vol_stop=1.5, stop_atr=3.0, cost={"AF": 2.0}, cash=cash)


@query("k20_rotation_chain", f"WITH {CHAIN} SELECT trade_date, gross, turnover, cost, sum_w, r, CASE WHEN row_number() OVER (ORDER BY trade_date) = 1 THEN 1 ELSE product(1 + r) OVER (ORDER BY trade_date) END AS nav FROM nr", "gross turnover cost sum_w r nav", 7)
def k20c(spark, d):
    daily, _ = chain(spark, d)
    return pf.nav(daily.withColumn("strategy", F.lit("rotation"))).select("trade_date", "gross", "turnover", "cost", "sum_w", "r", "nav")


@query("k20_chain_weights", f"WITH {CHAIN} SELECT code, trade_date, decision_date, w FROM ex", "w")
def k20w(spark, d):
    return chain(spark, d)[1]


TREND = f"""{DON}, ge AS (SELECT *, pos > 0 AS b, abs(close - lag(close) OVER w) AS step, close / lag(close) OVER w - 1 AS r0, avg(high - low) OVER {frame(14)} AS atr FROM d {W}), gf AS (SELECT *, CASE WHEN count(step) OVER {frame(10)} >= 10 AND sum(step) OVER {frame(10)} > 0 THEN abs(close - lag(close, 10) OVER w) / sum(step) OVER {frame(10)} END > 0.1 AS gate FROM ge {W}),
  g1 AS (SELECT *, sum(ch) OVER {UPTO} AS run0 FROM (SELECT *, (b IS DISTINCT FROM lag(b) OVER w)::INT AS ch FROM gf {W})), g2 AS (SELECT *, CASE WHEN b AND bool_or(coalesce(gate, false)) OVER (PARTITION BY code, run0 ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) THEN 1 ELSE 0 END AS bp FROM g1),
  h1 AS (SELECT *, sum(c2) OVER {UPTO} AS run FROM (SELECT *, ((bp > 0) IS DISTINCT FROM lag(bp > 0) OVER w)::INT AS c2 FROM g2 {W})), h2 AS (SELECT *, CASE WHEN bp > 0 THEN run END AS hold, row_number() OVER i AS k, first(open) OVER i AS entry, first(atr) OVER i AS a0 FROM h1 WINDOW i AS (PARTITION BY code, run ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  s1 AS (SELECT *, max(close - 3 * atr) OVER i AS mx, max(high / entry - 1) OVER (PARTITION BY code, run ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM h2 WINDOW i AS (PARTITION BY code, run ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  s2 AS (SELECT *, coalesce(lag(mx) OVER (PARTITION BY code, run ORDER BY trade_date), entry - 3 * a0) AS stop, CASE WHEN peak >= 4 * atr / entry THEN 0.3 WHEN peak >= 2 * atr / entry THEN 0.5 END AS back FROM s1), s3 AS (SELECT *, CASE WHEN low < stop THEN least(stop, open) END AS f1, CASE WHEN k > 2 AND back IS NOT NULL AND low <= entry * (1 + peak * (1 - back)) THEN least(entry * (1 + peak * (1 - back)), open) END AS f2 FROM s2),
  s4 AS (SELECT *, count(f1) OVER i = 0 AND count(f2) OVER i = 0 AS act FROM s3 WINDOW i AS (PARTITION BY code, run ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), z1 AS (SELECT *, CASE WHEN hold IS NOT NULL AND act AND a0 > 0 THEN least(1, 0.05 * entry / a0) ELSE 0 END AS raw FROM s4),
  z2 AS (SELECT *, raw / greatest(1, sum(raw) OVER (PARTITION BY trade_date)) AS sw FROM z1), z3 AS (SELECT *, coalesce(lag(sw) OVER w, 0) AS w FROM z2 {W}), z4 AS (SELECT *, abs(w - coalesce(lag(w) OVER x, 0)) / 2 AS t FROM z3 WINDOW x AS (PARTITION BY code ORDER BY trade_date))"""


@query("k21_trend_chain", f"WITH {TREND} SELECT trade_date, sum(w * coalesce(r0 / {DAMP}, 0)) AS gross, sum(t) AS turnover, sum(w) AS sum_w, sum(w * coalesce(r0 / {DAMP}, 0)) - sum(t) * 2 * 5 / 10000 AS r FROM z4 GROUP BY trade_date", "gross turnover sum_w r", 7)
def k21c(spark, d):
    """Channel entries behind an efficiency gate, risk-budget sizes, a trailing stop and a tiered take profit, costs."""
    p = ind.with_steps(donchian(spark, d)).withColumn("er", ind.efficiency_ratio("close", 10)).withColumn("atr", F.avg(F.col("high") - F.col("low")).over(roll(series(), 14)))
    p = p.withColumn("r", (F.try_divide(F.col("close"), F.lag("close").over(series())) - 1) / DAMP).withColumnRenamed("pos", "base").drop("_step")
    return chains.trend(p, F.col("er") > 0.1, 0.05, 3.0, [(2.0, 0.5), (4.0, 0.3)])


INDEX = f"""{RET}, ix AS (SELECT trade_date, avg(close) AS idx FROM bars GROUP BY trade_date), sn AS (SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS before FROM (SELECT DISTINCT trade_date FROM bars)), mp AS (SELECT sn.trade_date, idx AS idx_close FROM sn JOIN ix ON ix.trade_date = sn.before),
  a AS (SELECT r.code, r.trade_date, (lead(open) OVER w / open - 1) / {DAMP} AS x, idx_close FROM r LEFT JOIN mp ON r.trade_date = mp.trade_date WINDOW w AS (PARTITION BY r.code ORDER BY r.trade_date)), b AS (SELECT *, ln(idx_close / lag(idx_close) OVER w) AS m FROM a {W}),
  c AS (SELECT *, abs(m) AS am, CASE WHEN count(abs(m)) OVER p >= 20 THEN quantile_cont(abs(m), 0.8) OVER p END AS cut FROM b WINDOW p AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)), e AS (SELECT *, CASE WHEN am >= cut AND m > 0 THEN 0 WHEN am >= cut THEN 1 END AS ev FROM c),
  f AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER {UPTO}, 1) AS pos, lead(trade_date) OVER w IS NULL AS fin FROM e {W}), g AS (SELECT *, CASE WHEN fin THEN 0 ELSE coalesce(abs(pos - lag(pos) OVER w), 0) END::DOUBLE AS turnover, CASE WHEN fin THEN 0 ELSE coalesce(x, 0) END AS y FROM f {W}),
  h AS (SELECT *, 1 + y AS bh, (1 - 0.0005 * turnover) * (1 + pos * y) AS sg FROM g), n AS (SELECT code, trade_date, pos::INT AS pos, turnover, coalesce(product(sg) OVER b, 1) AS nav_strategy, coalesce(product(bh) OVER b, 1) AS nav_buy_hold, coalesce(product(1 + sg - bh) OVER b, 1) AS nav_excess FROM h WINDOW b AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def index_signals(spark, d):
    b = bars(spark, d)
    days = cal.sessions(b)
    from panelforge.operators.extras import next_session_signal

    idx = next_session_signal(b.groupBy("trade_date").agg(F.avg("close").alias("idx_close")), days, "idx_close").select("trade_date", "idx_close")
    rows = b.select("code", "trade_date", ((F.try_divide(F.lead("open").over(series()), F.col("open")) - 1) / DAMP).alias("x")).join(idx.hint("merge"), "trade_date", "left")
    return chains.index_signal(rows, "x").select("code", "trade_date", "pos", "turnover", "nav_strategy", "nav_buy_hold", "nav_excess")


@query("k25_index_backtest", f"WITH {INDEX} SELECT * FROM n", "turnover nav_strategy nav_buy_hold nav_excess")
def k25(spark, d):
    return index_signals(spark, d)


K25_LONG = f"{INDEX}, lg AS (SELECT code || ':' || unnest(['strategy', 'buy_hold', 'excess']) AS strategy, trade_date, unnest([nav_strategy, nav_buy_hold, nav_excess]) AS nav FROM n)"


def k25_navs(spark, d):
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"nav_{k}").alias("nav")) for k in ("strategy", "buy_hold", "excess")])
    return index_signals(spark, d).withColumn("c", F.explode(cells)).select(F.concat_ws(":", "code", "c.k").alias("strategy"), "trade_date", "c.nav")


@query("k25_index_metrics", f"WITH {K25_LONG}, {metrics_sql('lg')} SELECT * FROM mt", " ".join(m for m in METRICS if m != "max_under_water"), 5)
def k25m(spark, d):
    return perf.metrics(k25_navs(spark, d))


@query("k25_period_returns", f"""WITH {K25_LONG}, lb AS (SELECT strategy, p, CASE p WHEN 'M' THEN date_trunc('month', trade_date) WHEN 'Q' THEN date_trunc('quarter', trade_date) ELSE date_trunc('year', trade_date) END::DATE AS label, trade_date, nav FROM lg, (SELECT unnest(['M', 'Q', 'Y']) AS p)), en AS (SELECT strategy, p, label, arg_max(nav, trade_date) AS nav FROM lb GROUP BY ALL),
  rt AS (SELECT strategy, p AS period, round(nav / lag(nav) OVER (PARTITION BY strategy, p ORDER BY label) - 1, 12) AS r FROM en) SELECT strategy, period, count(r) AS n, avg((r > 0)::INT) AS win_rate, avg(r) AS mean, quantile_cont(r, 0.5) AS median FROM rt WHERE r IS NOT NULL GROUP BY ALL""", "win_rate mean median")
def k25p(spark, d):
    navs = k25_navs(spark, d)
    ends = [navs.groupBy("strategy", F.lit(p).alias("period"), cal.label("trade_date", p).alias("label")).agg(F.max_by("nav", "trade_date").alias("nav")) for p in ("M", "Q", "Y")]
    rows = ends[0].unionByName(ends[1]).unionByName(ends[2])
    rows = rows.withColumn("r", F.round(F.try_divide(F.col("nav"), F.lag("nav").over(Window.partitionBy("strategy", "period").orderBy("label"))) - 1, 12)).where("r IS NOT NULL")
    return rows.groupBy("strategy", "period").agg(F.count("r").alias("n"), F.avg((F.col("r") > 0).cast("int")).alias("win_rate"), F.avg("r").alias("mean"), F.percentile("r", 0.5).alias("median"))


SLEEVES = f"""{RET}, a AS (SELECT code, trade_date, r / {DAMP} AS r, anchor, k, trade_date + ((k - isodow(trade_date) + 7) % 7)::INT AS period FROM r, (SELECT unnest(['MON', 'TUE', 'WED', 'THU', 'FRI']) AS anchor, unnest([1, 2, 3, 4, 5]) AS k)), c AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY anchor, trade_date) AS w0 FROM a),
  g AS (SELECT *, w0 * coalesce(product(1 + coalesce(r, 0)) OVER (PARTITION BY anchor, code, period ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS g FROM c), v AS (SELECT *, g / sum(g) OVER (PARTITION BY anchor, trade_date) AS w FROM g), t AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY anchor, code ORDER BY trade_date), 0)) / 2 AS t FROM v),
  n AS (SELECT anchor, trade_date, sum(w * coalesce(r, 0)) - sum(t) * 2 * 5 / 10000 AS r FROM t GROUP BY anchor, trade_date), nv AS (SELECT anchor, trade_date, r, CASE WHEN row_number() OVER w = 1 THEN 1 ELSE product(1 + r) OVER w END AS nav FROM n WINDOW w AS (PARTITION BY anchor ORDER BY trade_date))"""


def sleeve_navs(spark, d):
    b = ind.with_returns(bars(spark, d)).withColumn("r", F.col("r") / DAMP)
    return pf.nav(chains.sleeves(b), keys=("anchor",))


@query("m20_dashboard", f"WITH {SLEEVES}, {metrics_sql('nv', 'anchor')} SELECT * FROM mt", " ".join(m for m in METRICS if m != "max_under_water"), 5)
def m20(spark, d):
    """Equal weights with weekly reset: net value metrics of each anchor weekday's sleeve, all sleeves in one job."""
    return perf.metrics(sleeve_navs(spark, d), keys=("anchor",))


@query("m20_monthly", f"WITH {SLEEVES}, mo AS (SELECT anchor, date_trunc('month', trade_date)::DATE AS label, arg_max(nav, trade_date) AS nav FROM nv GROUP BY ALL) SELECT anchor, label, nav / lag(nav) OVER (PARTITION BY anchor ORDER BY label) - 1 AS r FROM mo", "r")
def m20m(spark, d):
    m = sleeve_navs(spark, d).groupBy("anchor", cal.label("trade_date", "M").alias("label")).agg(F.max_by("nav", "trade_date").alias("nav"))
    return m.select("anchor", "label", (F.try_divide(F.col("nav"), F.lag("nav").over(Window.partitionBy("anchor").orderBy("label"))) - 1).alias("r"))


@query("m20_sleeve_correlations", f"WITH {SLEEVES} SELECT a.anchor AS a, b.anchor AS b, count(*) AS n, corr(a.r, b.r) AS corr FROM nv a JOIN nv b ON a.trade_date = b.trade_date AND a.anchor < b.anchor GROUP BY ALL", "corr")
def m20c(spark, d):
    return xs.correlations(sleeve_navs(spark, d).withColumnRenamed("anchor", "code"))


BASE = f"""{RET}, rd AS (SELECT code, trade_date, r / {DAMP} AS r, lr FROM r), cn AS (SELECT code AS strategy, trade_date, product(1 + coalesce(r, 0)) OVER w AS nav FROM rd {W}), vo AS (SELECT *, date_trunc('month', trade_date) AS period, CASE WHEN count(lr) OVER {frame(20)} >= 20 THEN stddev_samp(lr) OVER {frame(20)} END AS vol FROM rd),
  sets AS (SELECT 'EW' AS st, *, 1.0 / count(*) OVER (PARTITION BY trade_date) AS w0 FROM vo UNION ALL SELECT 'IV', *, CASE WHEN sum(CASE WHEN vol > 0 THEN 1 / vol END) OVER (PARTITION BY trade_date) > 0 THEN coalesce(CASE WHEN vol > 0 THEN 1 / vol END, 0) / sum(CASE WHEN vol > 0 THEN 1 / vol END) OVER (PARTITION BY trade_date) ELSE 1.0 / count(*) OVER (PARTITION BY trade_date) END FROM vo
    UNION ALL SELECT 'CUSTOM', *, CASE WHEN code IN ('AF', 'NO') THEN 0.4 ELSE 0.05 END FROM vo),
  g AS (SELECT *, w0 * coalesce(product(1 + coalesce(r, 0)) OVER (PARTITION BY st, code, period ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS g FROM sets), v AS (SELECT *, CASE WHEN sum(g) OVER (PARTITION BY st, trade_date) <> 0 THEN g / sum(g) OVER (PARTITION BY st, trade_date) END AS w FROM g), t AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY st, code ORDER BY trade_date), 0)) / 2 AS t FROM v),
  n AS (SELECT st, trade_date, sum(w * coalesce(r, 0)) - sum(t) * 2 * 5 / 10000 AS r FROM t GROUP BY ALL), nv AS (SELECT st AS strategy, trade_date, CASE WHEN row_number() OVER w = 1 THEN 1 ELSE product(1 + r) OVER w END AS nav FROM n WINDOW w AS (PARTITION BY st ORDER BY trade_date)), al AS (SELECT * FROM cn UNION ALL SELECT * FROM nv)"""


def base_navs(spark, d):
    """Net values of each code held alone, and of equal, inverse-vol and custom weights with monthly reset."""
    b = ind.with_returns(bars(spark, d)).withColumn("r", F.col("r") / DAMP).withColumn("vol", ind.rolling_std("lr", 20, 20)).withColumn("period", cal.label("trade_date", "M"))
    alone = b.select(F.col("code").alias("strategy"), "trade_date", F.product(1 + F.coalesce("r", F.lit(0.0))).over(series().rowsBetween(Window.unboundedPreceding, 0)).alias("nav"))
    b = b.withColumn("_iv", pf.inverse_vol("vol"))
    sets = F.array(F.struct(F.lit("EW").alias("strategy"), pf.equal().alias("w0")), F.struct(F.lit("IV").alias("strategy"), F.col("_iv").alias("w0")), F.struct(F.lit("CUSTOM").alias("strategy"), F.when(F.col("code").isin("AF", "NO"), 0.4).otherwise(0.05).alias("w0")))
    rows = b.withColumn("_s", sets).select("code", "trade_date", "period", "r", F.explode("_s").alias("s")).select("code", "trade_date", "period", "r", "s.*")
    net = pf.net(pf.drifted(rows, "period", keys=("strategy",)), keys=("strategy",))
    return alone.unionByName(pf.nav(net).select("strategy", "trade_date", "nav"))


REPORT = ["total", "annual", "vol", "sharpe", "sortino", "max_drawdown", "max_under_water", "ulcer", "calmar"]


@query("m22_baseline_report", f"""WITH {BASE}, {metrics_sql('al')}, mo AS (SELECT strategy, date_trunc('month', trade_date)::DATE AS label, arg_max(nav, trade_date) AS nav FROM al GROUP BY ALL), mr AS (SELECT strategy, nav / lag(nav) OVER (PARTITION BY strategy ORDER BY label) - 1 AS r FROM mo),
  wn AS (SELECT strategy, avg((r > 0)::INT) AS win_rate, CASE WHEN abs(avg(-r) FILTER (r < 0)) > 1e-12 THEN avg(r) FILTER (r > 0) / avg(-r) FILTER (r < 0) END AS payoff FROM mr GROUP BY strategy), ir AS (SELECT a.strategy, CASE WHEN abs(stddev_samp(a.r - b.r)) > 1e-12 THEN avg(a.r - b.r) / stddev_samp(a.r - b.r) * sqrt(252) END AS x FROM m1 a JOIN m1 b ON b.strategy = 'EW' AND a.trade_date = b.trade_date WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY a.strategy)
  SELECT strategy, unnest([{', '.join(f"'{m}'" for m in REPORT)}]) AS metric, unnest([{', '.join(f'{m}::DOUBLE' for m in REPORT)}]) AS value FROM mt UNION ALL SELECT strategy, unnest(['win_rate', 'payoff', 'kelly']), unnest([win_rate, payoff, win_rate - (1 - win_rate) / payoff]) FROM wn UNION ALL SELECT strategy, 'information_ratio', x FROM ir""", "value", 5)
def m22(spark, d):
    return chains.report(base_navs(spark, d), "EW")


@query("m22_baseline_drawdowns", f"WITH {BASE}, {metrics_sql('al')} SELECT strategy, trade_date, nav, dd AS drawdown FROM m2", "nav drawdown")
def m22d(spark, d):
    return perf.with_drawdown(base_navs(spark, d)).select("strategy", "trade_date", "nav", "drawdown")


LAGGED = f"""{MKT}, nm AS (SELECT code, trade_date, r, m, row_number() OVER w AS rn, count(*) OVER (PARTITION BY code) AS n FROM mk {W}), ll AS (SELECT a.code, k AS lag, count(*) AS n, corr(a.m, b.r) AS corr FROM nm a CROSS JOIN range(-5, 6) t(k) JOIN nm b ON a.code = b.code AND b.rn = a.rn + k GROUP BY a.code, k),
  bl AS (SELECT code, lag, corr FROM ll QUALIFY row_number() OVER (PARTITION BY code ORDER BY abs(corr) DESC, abs(lag), lag) = 1), sg AS (SELECT a.code, a.trade_date, a.rn, a.r, b.m AS sig, lag, corr FROM nm a JOIN bl ON a.code = bl.code LEFT JOIN nm b ON a.code = b.code AND b.rn = a.rn - lag)"""


def best_lags(rows, keys=("code",)):
    return st.best_lag(st.lead_lag(rows, "m", "r", 5, keys), keys).select(*keys, "lag", "corr")


@query("r03_hit_table", f"""WITH {LAGGED}, b AS (SELECT *, sign(sig) * CASE WHEN corr > 0 THEN 1 ELSE -1 END > 0 AS up, sig <> 0 AND r <> 0 AS ok FROM sg WHERE sig IS NOT NULL), g AS (SELECT code, count(*) FILTER (ok AND up AND r > 0) AS tp, count(*) FILTER (ok AND up AND r <= 0) AS fp, count(*) FILTER (ok AND NOT up AND r > 0) AS fn, count(*) FILTER (ok AND NOT up AND r <= 0) AS tn,
  avg(r) FILTER (sig > 0) AS mean_rise, quantile_cont(r, 0.5) FILTER (sig > 0) AS median_rise, avg(r) FILTER (sig < 0) AS mean_fall, quantile_cont(r, 0.5) FILTER (sig < 0) AS median_fall FROM b GROUP BY code) SELECT *, (tp + tn) / (tp + fp + fn + tn) AS hit_rate FROM g""", "mean_rise median_rise mean_fall median_fall hit_rate")
def r03(spark, d):
    rows = with_market(spark, d)
    lags = best_lags(rows)
    return chains.hit_table(chains.shifted_by(rows, "m", "sig", lags).join(lags.select("code", "corr").hint("merge"), "code"), "r", "sig")


HOLD_LAST = f"""cu AS (SELECT *, quantile_cont(abs(sig), 0.6) OVER (PARTITION BY code) AS cut FROM sg), ev AS (SELECT *, CASE WHEN abs(sig) >= cut THEN (sign(sig) * CASE WHEN corr > 0 THEN 1 ELSE -1 END >= 0)::INT END AS e FROM cu), xp AS (SELECT *, CASE WHEN sig IS NOT NULL THEN coalesce(last_value(e IGNORE NULLS) OVER {UPTO}, 1) END AS exposure FROM ev),
  hl AS (SELECT *, exposure * r / {DAMP} - CASE WHEN row_number() OVER w = 1 THEN 0 ELSE abs(exposure - lag(exposure) OVER w) END * 5 / 10000.0 AS x FROM xp {W})"""


@query("r03_threshold_strategy", f"WITH {LAGGED}, {HOLD_LAST} SELECT code, count(x) AS n, avg(x) AS mean, product(1 + x) - 1 AS total, avg(x) / stddev_samp(x) * sqrt(252) AS sharpe, avg(exposure) AS invested FROM hl WHERE x IS NOT NULL GROUP BY code", "mean total sharpe invested")
def r03s(spark, d):
    """Held by the sign of the leading series where it passes its 60 % quantile in size."""
    rows = with_market(spark, d)
    lags = best_lags(rows)
    sig = chains.shifted_by(rows, "m", "sig", lags).join(lags.select("code", "corr").hint("merge"), "code").withColumn("r", F.col("r") / DAMP)
    sig = sig.withColumn("cut", F.percentile(F.abs("sig"), 0.6).over(Window.partitionBy("code")))
    x = chains.hold_last(sig, "r", "sig", "corr", "cut", 5.0)
    return chains.day_scores(x, "x", ("code",)).join(x.groupBy("code").agg(F.avg("exposure").alias("invested")).hint("merge"), "code")


@query("r03_level_timing", f"""WITH {MKT}, q AS (SELECT code, trade_date, r / {DAMP} AS r, high / low AS lv, quantile_cont(high / low, 0.5) OVER c AS q0, quantile_cont(high / low, 0.9) OVER c AS q1 FROM mk WINDOW c AS (PARTITION BY code)), e AS (SELECT *, CASE WHEN lv > q1 THEN 0.3 WHEN lv > q0 THEN 0.6 ELSE 1.0 END AS ex FROM q),
  x AS (SELECT code, ex * r - coalesce(abs(ex - lag(ex) OVER w), 0) * 5 / 10000.0 AS x FROM e {W}) SELECT code, count(x) AS n, avg(x) AS mean, product(1 + x) - 1 AS total, avg(x) / stddev_samp(x) * sqrt(252) AS sharpe FROM x GROUP BY code""", "mean total sharpe")
def r03l(spark, d):
    rows = with_market(spark, d).withColumn("lv", F.col("high") / F.col("low")).withColumn("r", F.col("r") / DAMP)
    return chains.day_scores(chains.tier_timing(rows, "r", "lv", [0.5, 0.9], [1.0, 0.6, 0.3], 5.0), "x", ("code",))


@query("r03_rolling_stability", f"WITH {LAGGED} SELECT code, trade_date, CASE WHEN count(*) OVER {frame(120)} >= 120 THEN corr(r, sig) OVER {frame(120)} END AS corr120, CASE WHEN count(*) OVER {frame(120)} >= 120 THEN avg((sign(sig) = sign(r))::INT) OVER {frame(120)} END AS same_sign FROM sg WHERE sig IS NOT NULL", "corr120 same_sign")
def r03r(spark, d):
    rows = with_market(spark, d)
    sig = chains.shifted_by(rows, "m", "sig", best_lags(rows)).where("sig IS NOT NULL")
    f = roll(series(), 120)
    full = F.count("*").over(f) >= 120
    return sig.select("code", "trade_date", F.when(full, F.corr("r", "sig").over(f)).alias("corr120"), F.when(full, F.avg((F.signum("sig") == F.signum("r")).cast("int")).over(f)).alias("same_sign"))


@query("r03_train_test", f"""WITH {MKT}, nm AS (SELECT code, trade_date, r, m, row_number() OVER w AS k, count(*) OVER (PARTITION BY code) AS n FROM mk {W}), pt AS (SELECT code, trade_date, r, m, CASE WHEN k <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS part, row_number() OVER (PARTITION BY code, k <= floor(n * 0.7) ORDER BY trade_date) AS rn FROM nm),
  ll AS (SELECT a.code, q.k AS lag, corr(a.m, b.r) AS corr FROM pt a CROSS JOIN range(-5, 6) q(k) JOIN pt b ON a.code = b.code AND b.rn = a.rn + q.k AND b.part = 'train' WHERE a.part = 'train' GROUP BY a.code, q.k), bl AS (SELECT code, lag, corr FROM ll QUALIFY row_number() OVER (PARTITION BY code ORDER BY abs(corr) DESC, abs(lag), lag) = 1),
  sg AS (SELECT a.code, a.part, a.trade_date, a.rn, a.r, b.m AS sig, corr FROM pt a JOIN bl ON a.code = bl.code LEFT JOIN pt b ON a.code = b.code AND a.part = b.part AND b.rn = a.rn - lag), xp AS (SELECT *, CASE WHEN sig IS NOT NULL THEN coalesce(last_value(CASE WHEN sig IS NOT NULL THEN (sign(sig) * CASE WHEN corr > 0 THEN 1 ELSE -1 END >= 0)::INT END IGNORE NULLS) OVER (PARTITION BY code, part ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) END AS ex FROM sg),
  x AS (SELECT code, part, ex * r / {DAMP} - CASE WHEN rn = 1 THEN 0 ELSE abs(ex - lag(ex) OVER (PARTITION BY code, part ORDER BY trade_date)) END * 5 / 10000.0 AS x FROM xp) SELECT code, part, count(x) AS n, avg(x) AS mean, product(1 + x) - 1 AS total, avg(x) / stddev_samp(x) * sqrt(252) AS sharpe FROM x WHERE x IS NOT NULL GROUP BY code, part""", "mean total sharpe")
def r03t(spark, d):
    """The lag is chosen on the first 70 % of each series and traded on both parts."""
    w = series()
    rows = with_market(spark, d).withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("code")))
    rows = rows.withColumn("part", F.when(F.col("_k") <= F.floor(F.col("_n") * 0.7), "train").otherwise("test"))
    lags = best_lags(rows.where("part = 'train'")).withColumn("part", F.explode(F.array(F.lit("train"), F.lit("test"))))
    keys = ("code", "part")
    sig = chains.shifted_by(rows, "m", "sig", lags, keys).join(lags.select(*keys, "corr").hint("merge"), list(keys)).withColumn("r", F.col("r") / DAMP)
    return chains.day_scores(chains.hold_last(sig, "r", "sig", "corr", None, 5.0, keys), "x", keys)


MACRO = """sv AS (SELECT event_type AS s, ts::DATE AS trade_date, avg(value) AS v FROM events GROUP BY ALL), dv AS (SELECT s, trade_date, v - lag(v) OVER (PARTITION BY s ORDER BY trade_date) AS dv FROM sv), pr AS (SELECT a.s AS a, b.s AS b, a.trade_date, a.dv AS x, b.dv AS y, row_number() OVER (PARTITION BY a.s, b.s ORDER BY a.trade_date) AS rn FROM dv a JOIN dv b ON a.trade_date = b.trade_date AND a.s <> b.s WHERE a.dv IS NOT NULL AND b.dv IS NOT NULL),
  ll AS (SELECT p.a, p.b, k AS lag, count(*) AS n, corr(p.x, q.y) AS corr FROM pr p CROSS JOIN range(-3, 4) t(k) JOIN pr q ON p.a = q.a AND p.b = q.b AND q.rn = p.rn + k GROUP BY p.a, p.b, k)"""


def macro_pairs(spark, d):
    """All ordered pairs of daily series (mean event value by type), as rows of one job."""
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("s"), F.to_date("ts").alias("trade_date")).agg(F.avg("value").alias("v"))
    s = s.withColumn("dv", F.col("v") - F.lag("v").over(Window.partitionBy("s").orderBy("trade_date"))).where("dv IS NOT NULL")
    a, b = s.select(F.col("s").alias("a"), "trade_date", F.col("dv").alias("x")), s.select(F.col("s").alias("b"), "trade_date", F.col("dv").alias("y"))
    return a.join(b.hint("merge"), "trade_date").where("a <> b")


@query("r12_macro_lags", f"WITH {MACRO} SELECT a, b, lag::INT AS lag, n, corr FROM ll", "corr")
def r12(spark, d):
    return st.lead_lag(macro_pairs(spark, d), "x", "y", 3, ("a", "b"))


@query("r12_macro_batch", f"""WITH {MACRO}, r AS (SELECT a, b, lag, n, round(corr, 9) AS corr FROM ll) SELECT a, b, lag::INT AS lag, n, corr, CASE WHEN lag > 0 THEN 'leads' WHEN lag < 0 THEN 'lags' ELSE 'together' END AS relation FROM r QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY abs(corr) DESC, abs(lag), lag) = 1""", "corr")
def r12b(spark, d):
    pairs = st.lead_lag(macro_pairs(spark, d), "x", "y", 3, ("a", "b")).withColumn("corr", F.round("corr", 9))
    return st.best_lag(pairs, ("a", "b"))


WALK = f"""{RET}, g AS (SELECT code, n AS param, trade_date, CASE WHEN close > avg(close) OVER (PARTITION BY n, code ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) * (1 + n / 100.0) THEN 1 ELSE 0 END AS pos, r FROM r, range(0, 50, 10) t(n)), x AS (SELECT code, param, trade_date, year(trade_date) AS y, coalesce(lag(pos) OVER (PARTITION BY param, code ORDER BY trade_date), 0) * coalesce(r, 0) / {DAMP} AS x FROM g),
  sm AS (SELECT code, param, y, count(x) AS n, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY ALL), ws AS (SELECT code, param, y, count(*) OVER w AS span, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM sm WINDOW w AS (PARTITION BY code, param ORDER BY y RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING)),
  tr AS (SELECT code, param, y, s / n / sqrt((q - s * s / n) / (n - 1)) * sqrt(252) AS train FROM ws WHERE span >= 2 AND n > 1 AND (q - s * s / n) / (n - 1) > 1e-18), rb AS (SELECT *, round(avg(train) OVER (PARTITION BY code, y ORDER BY param RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING), 9) AS robust FROM tr), ch AS (SELECT * FROM rb QUALIFY row_number() OVER (PARTITION BY code, y ORDER BY robust DESC, param) = 1)"""


def walk(spark, d):
    b = ind.with_returns(bars(spark, d)).withColumn("param", F.explode(F.sequence(F.lit(0), F.lit(40), F.lit(10))))
    w = series(("param", "code"))
    b = b.withColumn("pos", F.when(F.col("close") > F.avg("close").over(roll(w, 60)) * (1 + F.col("param") / 100), 1).otherwise(0))
    return chains.walk_forward_runs(b.withColumn("x", F.coalesce(F.lag("pos").over(w), F.lit(0)) * F.coalesce("r", F.lit(0.0)) / DAMP).select("code", "param", "trade_date", "x"), 2, 10)


@query("r13_robust_choices", f"WITH {WALK} SELECT code, y AS year, param::INT AS param, train, robust FROM ch", "train robust")
def r13c(spark, d):
    return walk(spark, d)[0].select("code", "year", "param", "train", "robust")


@query("r13_stitched", f"WITH {WALK} SELECT x.code, x.trade_date, x.param::INT AS param, x.x, product(1 + x.x) OVER (PARTITION BY x.code ORDER BY x.trade_date) AS nav FROM x JOIN ch ON x.code = ch.code AND x.param = ch.param AND x.y = ch.y", "x nav")
def r13s(spark, d):
    return walk(spark, d)[1]


@query("f08_futures_both_sides", f"""WITH {CONTRACTS}, m AS (SELECT *, close / lag(close) OVER w - 1 AS r1, close / lag(close, 3) OVER w - 1 AS score, lead(close) OVER w / close - 1 AS fwd, row_number() OVER w AS rn FROM contracts WINDOW w AS (PARTITION BY root, contract ORDER BY trade_date)), v AS (SELECT *, CASE WHEN count(r1) OVER f >= 3 THEN stddev_samp(r1) OVER f END AS vol FROM m WINDOW f AS (PARTITION BY root, contract ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
  o AS (SELECT * FROM v WHERE rn > 6 AND score IS NOT NULL AND vol > 0 AND fwd IS NOT NULL), l AS (SELECT root, trade_date, fwd, 1 / vol AS i FROM o QUALIFY row_number() OVER (PARTITION BY root, trade_date ORDER BY score DESC, contract) <= 3), s AS (SELECT root, trade_date, fwd, 1 / vol AS i FROM o QUALIFY row_number() OVER (PARTITION BY root, trade_date ORDER BY score, contract) <= 3),
  u AS (SELECT root, trade_date, sum(i * fwd) / sum(i) AS x FROM l GROUP BY ALL UNION ALL SELECT root, trade_date, -sum(i * fwd) / sum(i) FROM s GROUP BY ALL) SELECT root, trade_date, sum(x) / 2 AS r FROM u GROUP BY ALL""", "r")
def f08b(spark, d):
    c = contracts(spark, d).withColumn("code", F.col("contract"))
    return chains.futures_rotation(c, 3, 3, "both", 6)


@query("f07_rewritten_series", f"""WITH {CONTRACTS}, b AS (SELECT root || '88' AS code, root, trade_date, first(close ORDER BY hold DESC, contract) AS close FROM contracts GROUP BY ALL) SELECT code, root, trade_date, CASE WHEN root = 'BUILDING' THEN close + 1 ELSE close END AS close FROM b""", "close")
def f07(spark, d):
    """Synthetic series stored by root; one root is made anew and its partition alone is overwritten."""
    w = Window.partitionBy("root", "trade_date").orderBy(F.desc("hold"), "contract")
    made = contracts(spark, d).withColumn("_k", F.row_number().over(w)).where("_k = 1").select(F.concat("root", F.lit("88")).alias("code"), "root", "trade_date", "close")
    path = f"{shared_dir(spark)}/synthetic-{uuid.uuid4().hex}"
    made.write.partitionBy("root").parquet(path)
    prices.overwrite_partitions(made.where("root = 'BUILDING'").withColumn("close", F.col("close") + 1), path, "root")
    return spark.read.parquet(path).select("code", "root", "trade_date", "close")


@query("p10_category", """WITH n AS (SELECT p_partkey AS code, ['债券', '可转债', '黄金', '豆粕', '恒生', '标普', 'US ETF', '日经', '德国', '巴西', 'Steel'][(p_partkey % 11 + 1)::INT] || ' ' || p_brand AS name FROM part)
  SELECT code, ['BOND', 'CONVERTIBLE_BOND', 'GOLD', 'COMMODITY', 'HK_EQ', 'US_EQ', 'US_EQ', 'JP_EQ', 'EU_EQ', 'EM_EQ', 'CN_EQ'][(code % 11 + 1)::INT] AS category FROM n""")
def p10(spark, d):
    words = F.array(*[F.lit(x) for x in ("债券", "可转债", "黄金", "豆粕", "恒生", "标普", "US ETF", "日经", "德国", "巴西", "Steel")])
    name = F.concat_ws(" ", F.element_at(words, (F.col("p_partkey") % 11 + 1).cast("int")), "p_brand")
    return table(spark, d, "part").select(F.col("p_partkey").alias("code"), chains.category(F.col("p_partkey").cast("string"), name).alias("category"))


@query("p19_fund_events", """WITH e AS (SELECT o_custkey AS code, o_orderdate::DATE AS effective_date, CASE WHEN o_orderkey % 5 = 0 THEN 'split' ELSE 'dividend' END AS event_type, CASE WHEN o_orderkey % 5 = 0 THEN (1 + o_orderkey % 3) / 1.0 ELSE floor(o_totalprice) / 1000 END::DOUBLE AS v FROM orders WHERE o_orderkey % 7 <> 0)
  SELECT DISTINCT code, effective_date, event_type, CASE event_type WHEN 'split' THEN 'split:' ELSE 'div:' END || effective_date::VARCHAR || ':' || v::VARCHAR AS event_key, CASE WHEN event_type = 'dividend' THEN v END AS cash_dividend, CASE WHEN event_type = 'split' THEN v END AS split_ratio FROM e""", "cash_dividend split_ratio")
def p19(spark, d):
    """Orders as text records of two kinds; every seventh has a date that cannot be read."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    text = F.when(k % 7 == 0, "n/a").when(k % 2 == 0, F.date_format(day, "yyyyMMdd")).otherwise(day.cast("string"))
    amount = F.when(k % 5 == 0, F.concat(F.lit("1:"), (1 + k % 3).cast("string"))).otherwise((F.floor("o_totalprice") / 1000).cast("string"))
    return chains.fund_events(o.select(F.col("o_custkey").alias("code"), F.when(k % 5 == 0, "split").otherwise("dividend").alias("kind"), text.alias("date"), amount.alias("amount")))


@query("m13_level_distribution", f"""WITH {BARS}, l AS (SELECT code, trade_date, close, max(trade_date) OVER (PARTITION BY code) AS last FROM bars), x AS (SELECT code, trade_date, close, "window" FROM l, (SELECT unnest(['all', '3y', '1y']) AS "window", unnest([NULL, 1105, 375]) AS n) WHERE n IS NULL OR trade_date >= last - n::INT),
  c AS (SELECT *, count(*) OVER (PARTITION BY code, "window") AS k, ln(close / lag(close) OVER (PARTITION BY code, "window" ORDER BY trade_date)) AS lr FROM x), u AS (SELECT code, "window", trade_date, unnest(['level', 'log_return']) AS kind, unnest([close, lr]) AS v FROM c WHERE k >= 20)
  SELECT code, "window", kind, count(v) AS n, min(v) AS low, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90, max(v) AS high, arg_max(v, trade_date) AS current FROM u WHERE v IS NOT NULL GROUP BY ALL""", "low p10 p50 p90 high current")
def m13(spark, d):
    return chains.level_distribution(bars(spark, d), "close", {"all": None, "3y": 3, "1y": 1})


def spectrum_sql() -> str:
    """Windows of the last 252 and 126 values, at the end and at every 60 rows once full, and the whole series; a sum a frequency."""
    return f"""WITH {RET}, b AS (SELECT code, trade_date, lr, row_number() OVER w AS rn, count(*) OVER (PARTITION BY code) AS n FROM r WHERE lr IS NOT NULL {W}), e AS (SELECT code, trade_date, rn AS fin, wn FROM b, (SELECT unnest([252, 126]) AS wn) WHERE rn = n OR (rn >= wn AND (rn - wn) % 60 = 0)),
      wd AS (SELECT e.code, e.trade_date, wn AS "window", b.lr, b.rn - greatest(1, fin - wn + 1) AS t, least(wn, fin) AS n FROM e JOIN b ON b.code = e.code AND b.rn > fin - wn AND b.rn <= fin), y AS (SELECT *, (lr - avg(lr) OVER (PARTITION BY code, trade_date, "window")) * (0.5 - 0.5 * cos(2 * pi() * t / (n - 1))) AS y FROM wd WHERE n >= 8),
      p AS (SELECT code, trade_date, "window", n, k, pow(sum(y * cos(2 * pi() * k * t / n)), 2) + pow(sum(y * sin(2 * pi() * k * t / n)), 2) AS p FROM y, LATERAL (SELECT unnest(range(1, n // 2 + 1)) AS k) GROUP BY ALL), sh AS (SELECT *, p / sum(p) OVER (PARTITION BY code, trade_date, "window") AS s FROM p)
      SELECT code, trade_date, "window"::INT AS "window", max(n)::INT AS n, coalesce(sum(s) FILTER (k / n::DOUBLE <= 1.0 / 60), 0) AS low, coalesce(sum(s) FILTER (k / n::DOUBLE > 1.0 / 60 AND k / n::DOUBLE <= 1.0 / 20), 0) AS mid, coalesce(sum(s) FILTER (k / n::DOUBLE > 1.0 / 20), 0) AS high, -sum(s * ln(s + 1e-12)) / ln(count(*) + 1e-12) AS entropy, arg_max(n / k::DOUBLE, p) AS top_period, max(s) AS top_share FROM sh GROUP BY code, trade_date, "window" """


@query("w28_spectral_features", spectrum_sql(), "low mid high entropy top_period top_share")
def w28f(spark, d):
    return chains.spectral_features(ind.with_returns(bars(spark, d)), "lr", [252, 126], 60)


@query("w28_full_spectrum", f"""WITH {RET}, b AS (SELECT code, trade_date, lr, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY code) AS n FROM r WHERE lr IS NOT NULL {W}), y AS (SELECT *, max(trade_date) OVER (PARTITION BY code) AS last, (lr - avg(lr) OVER (PARTITION BY code)) * (0.5 - 0.5 * cos(2 * pi() * t / (n - 1))) AS y FROM b),
  p AS (SELECT code, last, n, k, pow(sum(y * cos(2 * pi() * (k * t % n) / n)), 2) + pow(sum(y * sin(2 * pi() * (k * t % n) / n)), 2) AS p FROM y, LATERAL (SELECT unnest(range(1, n // 2 + 1)) AS k) GROUP BY ALL), sh AS (SELECT *, p / sum(p) OVER (PARTITION BY code) AS s FROM p)
  SELECT code, last AS trade_date, 0::INT AS "window", max(n)::INT AS n, coalesce(sum(s) FILTER (k / n::DOUBLE <= 1.0 / 60), 0) AS low, coalesce(sum(s) FILTER (k / n::DOUBLE > 1.0 / 60 AND k / n::DOUBLE <= 1.0 / 20), 0) AS mid, coalesce(sum(s) FILTER (k / n::DOUBLE > 1.0 / 20), 0) AS high, -sum(s * ln(s + 1e-12)) / ln(count(*) + 1e-12) AS entropy, arg_max(n / k::DOUBLE, p) AS top_period, max(s) AS top_share FROM sh GROUP BY code, last""", "low mid high entropy top_period top_share")
def w28all(spark, d):
    return chains.spectral_features(ind.with_returns(bars(spark, d)), "lr", [None])


@query("j05_reindexed", f"WITH {BRANDS}, s AS (SELECT DISTINCT trade_date FROM bars), f AS (SELECT code, min(trade_date) AS f FROM bars GROUP BY code), g AS (SELECT code, s.trade_date FROM f JOIN s ON s.trade_date >= f) SELECT g.code, g.trade_date, b.close, b.volume FROM g ASOF JOIN bars b ON g.code = b.code AND g.trade_date >= b.trade_date", "close volume")
def j05(spark, d):
    b = brand_bars(spark, d)
    return cal.reindexed(b, cal.sessions(b), ["close", "volume"])


@query("j06_interval_overlap", f"""WITH {TRADES}, b AS (SELECT code, id, account_id AS a, trade_date AS s, trade_date + 30 AS e FROM trades WHERE side = 'BUY'), x AS (SELECT code, id, account_id AS a, trade_date AS s, trade_date + 10 AS e FROM trades WHERE side = 'SELL')
  SELECT b.code, b.id, b.a AS account_id, x.id AS right_id, x.a AS right_account_id, greatest(b.s, x.s) AS first_day, least(b.e, x.e) AS last_day FROM b JOIN x ON b.code = x.code AND b.s <= x.e AND x.s <= b.e""")
def j06(spark, d):
    """Holding windows of buys that meet the windows after sells of the same code."""
    t = trades(spark, d)
    span = lambda side, n: t.where(F.col("side") == side).select("code", "id", "account_id", F.col("trade_date").alias("start"), F.date_add("trade_date", n).alias("end"))
    o = cal.overlapping(span("BUY", 30), span("SELL", 10), ["code"])
    return o.select("code", "id", "account_id", "right_id", "right_account_id", F.greatest("start", "right_start").alias("first_day"), F.least("end", "right_end").alias("last_day"))


@query("s10_json_arrays", "SELECT event_type AS code, ts::DATE AS trade_date, max(value) AS close FROM events GROUP BY ALL", "close")
def s10(spark, d):
    """A vendor's array-shaped JSON (one array a column and code), read back and normalised."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("code"), F.to_date("ts").alias("trade_date")).agg(F.max("value").alias("close"))
    rows = F.sort_array(F.collect_list(F.struct(F.col("trade_date").cast("string").alias("d"), "close")))
    text = e.groupBy("code").agg(rows.alias("_r")).select("code", F.to_json(F.struct(F.transform("_r", lambda x: x["d"]).alias("Date"), F.transform("_r", lambda x: x["close"]).alias("Close Price"))).alias("body"))
    return prices.from_arrays(text, "body", {"Date": "string", "Close Price": "double"}, ["code"])


@query("s21_ledger_snapshot", f"WITH {TRADES} SELECT account_id, count(*) AS trades, count(DISTINCT code) AS codes, sum(CASE WHEN side = 'BUY' THEN -quantity * price ELSE quantity * price END - fee) AS cash, min(trade_date) AS first_date, max(trade_date) AS last_date FROM trades GROUP BY account_id", "cash", 3)
def s21s(spark, d):
    """Accounts written as JSON documents of their summary and read back, as a snapshot is."""
    t = trades(spark, d)
    delta = F.when(F.col("side") == "BUY", -F.col("quantity") * F.col("price")).otherwise(F.col("quantity") * F.col("price")) - F.col("fee")
    g = t.groupBy("account_id").agg(F.count("*").alias("trades"), F.count_distinct("code").alias("codes"), F.sum(delta).alias("cash"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    g.write.json(path)
    return spark.read.schema(g.schema).json(path)


#: Candidates of each root (a strategy) and month: contracts placed by their return over three months.
CANDIDATES = f"""{CONTRACTS}, cr AS (SELECT root, contract, trade_date, close, hold, close / lag(close) OVER w - 1 AS r, close / lag(close, 3) OVER w - 1 AS score FROM contracts WINDOW w AS (PARTITION BY root, contract ORDER BY trade_date)),
  cd AS MATERIALIZED (SELECT root AS strategy, trade_date, contract AS code, score, row_number() OVER (PARTITION BY root, trade_date ORDER BY score DESC, contract) AS place FROM cr WHERE score IS NOT NULL)"""
NEAR = "pc AS (SELECT a.contract AS a, b.contract AS b, corr(a.r, b.r) AS corr FROM cr a JOIN cr b ON a.root = b.root AND a.trade_date = b.trade_date AND a.contract < b.contract WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL HAVING count(*) >= 10), nb AS MATERIALIZED (SELECT code, list(other) AS near FROM (SELECT a AS code, b AS other FROM pc WHERE abs(corr) > {limit} UNION ALL SELECT b, a FROM pc WHERE abs(corr) > {limit}) GROUP BY code)"


def candidates(spark, d):
    w = Window.partitionBy("root", "contract").orderBy("trade_date")
    c = contracts(spark, d).withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).withColumn("score", F.try_divide(F.col("close"), F.lag("close", 3).over(w)) - 1)
    return c.withColumnRenamed("root", "strategy").withColumnRenamed("contract", "code")


def placed(c):
    return xs.picks(c, "score", 10_000, ("strategy",)).select("strategy", "trade_date", "code", "score", "place")


def near_pairs(c):
    """Correlations of contracts of one root; a contract's name begins with its root's."""
    return xs.correlations(c.select("strategy", "trade_date", "code", "r"), least=10, keys=("strategy",))


@query("x13_correlation_gate", f"""WITH RECURSIVE {CANDIDATES}, {NEAR.format(limit='0.3')}, ro AS MATERIALIZED (SELECT cd.*, coalesce(nb.near, []) AS near, row_number() OVER (PARTITION BY strategy ORDER BY trade_date, place) AS rn, list(cd.code) OVER (PARTITION BY strategy, trade_date) AS there, count(*) OVER (PARTITION BY strategy, trade_date) AS n FROM cd LEFT JOIN nb ON nb.code = cd.code),
  st AS (SELECT DISTINCT strategy, 0::BIGINT AS rn, []::VARCHAR[] AS held FROM ro UNION ALL SELECT strategy, rn, CASE WHEN len(h) < 4 AND NOT list_contains(h, code) AND NOT list_has_any(h, near) THEN list_append(h, code) ELSE h END FROM (SELECT ro.strategy, ro.rn, ro.code, ro.near, CASE WHEN place = 1 THEN list_filter(held, lambda x: list_contains(there, x)) ELSE held END AS h FROM st JOIN ro ON ro.strategy = st.strategy AND ro.rn = st.rn + 1))
  SELECT ro.strategy, trade_date, unnest(held) AS code FROM st JOIN ro ON st.strategy = ro.strategy AND st.rn = ro.rn WHERE place = n""")
def x13(spark, d):
    from panelforge.operators.extras import correlation_gate

    c = candidates(spark, d)
    return correlation_gate(placed(c), near_pairs(c), 0.3, 4)


@query("x14_inertia", f"""WITH RECURSIVE {CANDIDATES}, dy AS MATERIALIZED (SELECT strategy, trade_date, list({{'c': code, 's': score}} ORDER BY place) AS l, row_number() OVER (PARTITION BY strategy ORDER BY trade_date) AS rn FROM cd GROUP BY strategy, trade_date),
  st AS (SELECT DISTINCT strategy, 0::BIGINT AS rn, NULL::VARCHAR AS now, 0 AS age, false AS ch FROM dy UNION ALL SELECT strategy, rn, CASE WHEN c THEN l[1].c ELSE now END, CASE WHEN c THEN 1 ELSE age + 1 END, c FROM (SELECT dy.strategy, dy.rn, dy.l, now, age, now IS NULL OR len(list_filter(dy.l, lambda x: x.c = now)) = 0 OR (age >= 3 AND dy.l[1].c <> now AND dy.l[1].s - list_filter(dy.l, lambda x: x.c = now)[1].s > 0.05) AS c FROM st JOIN dy ON dy.strategy = st.strategy AND dy.rn = st.rn + 1))
  SELECT dy.strategy, trade_date, now AS code, ch AS changed FROM st JOIN dy ON st.strategy = dy.strategy AND st.rn = dy.rn""")
def x14(spark, d):
    return xs.gated(placed(candidates(spark, d)), 0.05, 3)


@query("x15_screening", f"""WITH RECURSIVE {CANDIDATES}, {NEAR.format(limit='0.3')}, ms AS (SELECT root, contract, avg(r) AS mean, avg((r > 0)::INT) AS win, avg(hold) AS liquidity FROM cr WHERE r IS NOT NULL GROUP BY ALL), sc AS (SELECT root AS screen, contract AS code, substr(contract, 3, 1) AS category, round((percent_rank() OVER (PARTITION BY root ORDER BY mean) + percent_rank() OVER (PARTITION BY root ORDER BY win) + percent_rank() OVER (PARTITION BY root ORDER BY liquidity)) / 3, 9) AS score FROM ms),
  ro AS MATERIALIZED (SELECT sc.*, coalesce(nb.near, []) AS near, row_number() OVER (PARTITION BY screen ORDER BY score DESC, sc.code) AS rn FROM sc LEFT JOIN nb ON nb.code = sc.code), st AS (SELECT DISTINCT screen, 0::BIGINT AS rn, []::VARCHAR[] AS taken, []::VARCHAR[] AS cats, '' AS why FROM ro
  UNION ALL SELECT screen, rn, CASE WHEN why = 'taken' THEN list_append(taken, code) ELSE taken END, CASE WHEN why = 'taken' THEN list_append(cats, category) ELSE cats END, why FROM (SELECT ro.screen, ro.rn, ro.code, ro.category, taken, cats, CASE WHEN len(list_filter(cats, lambda x: x = ro.category)) >= 3 THEN 'quota' WHEN list_has_any(taken, near) THEN 'correlation' WHEN len(taken) >= 6 THEN 'full' ELSE 'taken' END AS why FROM st JOIN ro ON ro.screen = st.screen AND ro.rn = st.rn + 1))
  SELECT ro.screen, ro.code, category, score, why AS reason FROM st JOIN ro ON st.screen = ro.screen AND st.rn = ro.rn""", "score")
def x15(spark, d):
    """A screen for each root: contracts by the mean of three ranks, with quotas by category and a limit on correlations."""
    c = candidates(spark, d)
    m = c.where("r IS NOT NULL").groupBy(F.col("strategy").alias("screen"), "code").agg(F.avg("r").alias("mean"), F.avg((F.col("r") > 0).cast("int")).alias("win"), F.avg("hold").alias("liquidity"))
    rank = lambda x: F.percent_rank().over(Window.partitionBy("screen").orderBy(x))
    m = m.select("screen", "code", F.substring("code", 3, 1).alias("category"), F.round((rank("mean") + rank("win") + rank("liquidity")) / 3, 9).alias("score"))
    return xs.screened(m, near_pairs(c), 6, 3, 0.3)


@query("k23_slots", f"""WITH RECURSIVE {CANDIDATES}, wt AS MATERIALIZED (SELECT strategy, trade_date, code, score, list(code) OVER (PARTITION BY strategy, trade_date) AS there, row_number() OVER d AS k, count(*) OVER (PARTITION BY strategy, trade_date) AS n, row_number() OVER (PARTITION BY strategy ORDER BY trade_date, score DESC, code) AS rn FROM cd WHERE score > 0 WINDOW d AS (PARTITION BY strategy, trade_date ORDER BY score DESC, code)),
  st AS (SELECT DISTINCT strategy, 0::BIGINT AS rn, []::VARCHAR[] AS held, false AS skip FROM wt UNION ALL SELECT strategy, rn, CASE WHEN ok THEN list_append(h, code) ELSE h END, NOT ok AND NOT list_contains(h, code) FROM (SELECT *, NOT list_contains(h, code) AND len(h) < 3 AND (len(h) + 1) * 0.3 <= 1 + 1e-12 AS ok FROM (SELECT wt.strategy, wt.rn, wt.code, CASE WHEN k = 1 THEN list_filter(held, lambda x: list_contains(there, x)) ELSE held END AS h FROM st JOIN wt ON wt.strategy = st.strategy AND wt.rn = st.rn + 1)))
  SELECT wt.strategy, trade_date, code, 0.0::DOUBLE AS w, 'skipped' AS event FROM st JOIN wt ON st.strategy = wt.strategy AND st.rn = wt.rn WHERE skip UNION ALL SELECT strategy, trade_date, code, 0.3, 'held' FROM (SELECT wt.strategy, trade_date, unnest(held) AS code FROM st JOIN wt ON st.strategy = wt.strategy AND st.rn = wt.rn WHERE k = n)""", "w")
def k23(spark, d):
    return pf.admitted(placed(candidates(spark, d)).where("score > 0"), 0.3, 3)


@query("z01_price_feed", f"""WITH {BARS}, px AS (SELECT code, trade_date, 100.0 + volume::BIGINT % 7 AS px, volume, amount FROM bars), j AS (SELECT *, abs(px / lag(px) OVER w - 1) > 0.1 OR datediff('day', lag(trade_date) OVER w, trade_date) > 20 AS bad FROM px {W}), bc AS (SELECT DISTINCT code FROM j WHERE bad)
  SELECT code, trade_date, 'none' AS adjust, px AS open, px AS high, px AS low, px AS close, volume, amount FROM px WHERE code NOT IN (SELECT code FROM bc)""", "open high low close volume amount")
def z01(spark, d):
    """Files of prices put through the stream into a table; codes with a violation stay out."""
    from panelforge.streaming.feeds import price_feed

    root = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    px = (100.0 + F.col("volume").cast("long") % 7).cast("double")
    rows = bars(spark, d).select("code", "trade_date", F.lit("none").alias("adjust"), *[px.alias(c) for c in ("open", "high", "low", "close")], "volume", "amount")
    rows.write.parquet(f"{root}/in")
    price_feed(spark, f"{root}/in", prices.PRICE_SCHEMA, f"{root}/table", f"{root}/checkpoint", max_return=0.1).awaitTermination()
    return spark.read.schema(prices.PRICE_SCHEMA).parquet(f"{root}/table").select(*rows.columns) if _exists(spark, f"{root}/table") else rows.limit(0)


def _exists(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@query("z04_metric_hooks", f"WITH {RET} SELECT code, count(r) AS n, avg(r) AS mean, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, quantile_cont(r, 0.95) - quantile_cont(r, 0.05) AS spread, max(r) AS best FROM (SELECT code, r / {DAMP} AS r FROM r) GROUP BY code", "mean sharpe spread best", 9)
def z04(spark, d):
    """Metrics that a caller passes as functions of a column, beside the built-in ones."""
    more = {"spread": lambda x: F.percentile(x, 0.95) - F.percentile(x, 0.05), "best": F.max}
    return chains.day_scores(ind.with_returns(bars(spark, d)).withColumn("r", F.col("r") / DAMP), "r", ("code",), more).drop("total")


@query("m06_excess_bundle", f"""WITH {RET}, x AS (SELECT code, r / {DAMP} AS r, r / {DAMP} - 0.02 / 252 AS x FROM r), g AS (SELECT code, count(r) AS n, avg(x) AS m, stddev_samp(x) AS s, sqrt(avg(pow(CASE WHEN x IS NOT NULL THEN least(x, 0) END, 2))) AS d, exp(avg(ln(1 + r)) * 252) AS g FROM x GROUP BY code)
  SELECT code, n, g - 1 AS annual, g - 1 - 0.02 AS excess, s * sqrt(252) AS vol, m / s * sqrt(252) AS sharpe, m / d * sqrt(252) AS sortino FROM g""", "annual excess vol sharpe sortino")
def m06(spark, d):
    return perf.excess_bundle(ind.with_returns(bars(spark, d)).withColumn("r", F.col("r") / DAMP), "r", 0.02, ("code",))


@query("c01_period_labels", f"WITH {BARS}, s AS (SELECT DISTINCT trade_date AS d FROM bars) SELECT d AS trade_date, d AS daily, d + ((3 - isodow(d) + 7) % 7)::INT AS to_wednesday, date_trunc('month', d)::DATE AS monthly, date_trunc('quarter', d)::DATE AS quarterly, date_trunc('year', d)::DATE AS yearly FROM s")
def c01(spark, d):
    labels = {"daily": ("D", "FRI"), "to_wednesday": ("W", "WED"), "monthly": ("M", "FRI"), "quarterly": ("Q", "FRI"), "yearly": ("Y", "FRI")}
    return cal.sessions(bars(spark, d)).select("trade_date", *[cal.label("trade_date", p, a).alias(name) for name, (p, a) in labels.items()])


@query("m21_buy_sell_grid", f"""WITH {BARS}, n AS (SELECT code, isodow(trade_date) AS anchor, open, close, lead(open) OVER w AS no, lead(close) OVER w AS nc FROM bars {W}), u AS (SELECT anchor, unnest(['open', 'open', 'close', 'close']) AS buy, unnest(['open', 'close', 'open', 'close']) AS sell, unnest([no / open - 1, nc / open - 1, no / close - 1, nc / close - 1]) / {DAMP} AS r FROM n WHERE anchor <= 5)
  SELECT anchor::INT AS anchor, buy, sell, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS sd, avg((r > 0)::INT) AS win_rate, quantile_cont(r, 0.05) AS p05 FROM u WHERE r IS NOT NULL GROUP BY ALL""", "mean sd win_rate p05", 9)
def m21g(spark, d):
    """Bought on an anchor weekday and sold on the next session, at open or close each: all cells in one job."""
    w = series()
    prices_of = [(b, s, F.try_divide(F.lead(s).over(w), F.col(b)) - 1) for b in ("open", "close") for s in ("open", "close")]
    cells = F.array(*[F.struct(F.lit(b).alias("buy"), F.lit(s).alias("sell"), (r / DAMP).alias("r")) for b, s, r in prices_of])
    g = bars(spark, d).withColumn("c", cells).select((F.weekday("trade_date") + 1).alias("anchor"), F.explode("c").alias("c")).select("anchor", "c.*").where("anchor <= 5 AND r IS NOT NULL")
    return g.groupBy("anchor", "buy", "sell").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.avg((F.col("r") > 0).cast("int")).alias("win_rate"), F.percentile("r", 0.05).alias("p05"))


LOOKBACKS = f"""{RET}, lb AS (SELECT code, trade_date, r, n AS lookback, coalesce((close > lag(close, n) OVER (PARTITION BY n, code ORDER BY trade_date))::INT, 0) AS p FROM r, (SELECT unnest([5, 20, 60]) AS n)), xs AS (SELECT code, lookback, trade_date, coalesce(lag(p) OVER (PARTITION BY lookback, code ORDER BY trade_date), 0) * r / {DAMP} AS x FROM lb),
  nb AS (SELECT *, row_number() OVER (PARTITION BY code, lookback ORDER BY trade_date) AS k, count(*) OVER (PARTITION BY code, lookback) AS n FROM xs WHERE x IS NOT NULL), sr AS (SELECT code, lookback, trade_date, x FROM nb WHERE k <= floor(n * 0.7))"""


@query("r07_out_of_sample", f"""WITH {LOOKBACKS}, {bootstrap_sql('sr', 100, 'code, lookback')}, si AS (SELECT code, lookback, sim, product(1 + x) - 1 AS total FROM path GROUP BY ALL), be AS (SELECT code, sim, lookback FROM si QUALIFY row_number() OVER (PARTITION BY code, sim ORDER BY round(total, 12) DESC, lookback) = 1),
  ct AS (SELECT code, lookback, count(*) AS c FROM be GROUP BY ALL), ch AS (SELECT code, lookback FROM ct QUALIFY row_number() OVER (PARTITION BY code ORDER BY c DESC, lookback) = 1) SELECT nb.code, nb.lookback, count(x) AS n, avg(x) AS mean, product(1 + x) - 1 AS total, avg(x) / stddev_samp(x) * sqrt(252) AS sharpe FROM nb JOIN ch ON nb.code = ch.code AND nb.lookback = ch.lookback WHERE k > floor(n * 0.7) GROUP BY nb.code, nb.lookback""", "mean total sharpe")
def r07o(spark, d):
    """The lookback that most resamples of the first 70 % choose, and what it earns on the rest."""
    from panelforge.operators.extras import mode_or_median

    b = ind.with_returns(bars(spark, d))
    moves = F.array(*[F.struct(F.lit(n).alias("lookback"), F.coalesce((F.col("close") > F.lag("close", n).over(series())).cast("int"), F.lit(0)).alias("p")) for n in (5, 20, 60)])
    x = b.withColumn("_m", moves).select("code", "trade_date", "r", F.explode("_m").alias("m")).select("code", "trade_date", "r", "m.*")
    keys = ("code", "lookback")
    w = Window.partitionBy(*keys).orderBy("trade_date")
    x = x.withColumn("x", F.coalesce(F.lag("p").over(w), F.lit(0)) * F.col("r") / DAMP).where("x IS NOT NULL")
    x = x.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    first = F.col("k") <= F.floor(F.col("n") * 0.7)
    sims = st.block_bootstrap(x.where(first).select(*keys, "trade_date", "x"), "x", 100, 20, keys=keys, draw=("code",))
    best = sims.groupBy("code", "sim").agg(F.max_by("lookback", F.struct(F.round("total", 12), -F.col("lookback"))).alias("lookback"))
    chosen = mode_or_median(best, "lookback", "mode", ("code",))
    return chains.day_scores(x.where(~first).join(chosen.hint("merge"), list(keys), "left_semi"), "x", keys)
