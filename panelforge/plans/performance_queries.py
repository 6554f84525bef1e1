"""Queries M and T: performance, distributions, attribution, trade statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.frames import roll, series
from panelforge.operators import calendar as cal
from panelforge.operators import indicators as ind
from panelforge.operators import performance as perf
from panelforge.plans.indicators_queries import RET, W, frame
from panelforge.plans.portfolio_queries import DRIFT, TRADE, TRADES_OF, all_trades, drift
from panelforge.plans.registry import query
from panelforge.plans.views import BARS, bars

NAV = f"{BARS}, v AS (SELECT code AS strategy, trade_date, close AS nav, close / lag(close) OVER w - 1 AS r FROM bars {W}), dd AS (SELECT *, max(nav) OVER s AS peak FROM v WINDOW s AS (PARTITION BY strategy ORDER BY trade_date)), pk AS (SELECT *, nav / peak - 1 AS drawdown, last_value(CASE WHEN nav >= peak THEN trade_date END IGNORE NULLS) OVER (PARTITION BY strategy ORDER BY trade_date) AS top_date FROM dd)"


def navs(spark, d):
    return bars(spark, d).select(F.col("code").alias("strategy"), "trade_date", F.col("close").alias("nav"))


@query("m01_metrics", f"""WITH {NAV}, g AS (SELECT strategy, count(nav) AS n, arg_min(nav, trade_date) AS a, arg_max(nav, trade_date) AS b, avg(r) AS m, stddev_samp(r) AS s, stddev_samp(CASE WHEN r IS NOT NULL THEN least(r, 0) END) AS ds, min(drawdown) AS max_drawdown, max(datediff('day', top_date, trade_date)) AS max_under_water, sqrt(avg(pow(drawdown * 100, 2))) AS ulcer FROM pk GROUP BY strategy)
  SELECT strategy, n, max_drawdown, max_under_water::INT AS max_under_water, ulcer, b / a - 1 AS total, pow(b / a, 252.0 / (n - 1)) - 1 AS annual, s * sqrt(252) AS vol, m / s * sqrt(252) AS sharpe, m / ds * sqrt(252) AS sortino, (pow(b / a, 252.0 / (n - 1)) - 1) / abs(max_drawdown) AS calmar, (pow(b / a, 252.0 / (n - 1)) - 1) * 100 / ulcer AS ulcer_performance FROM g""", "max_drawdown ulcer total annual vol sharpe sortino calmar ulcer_performance")
def m01(spark, d):
    return perf.metrics(navs(spark, d))


@query("m02_information_ratio", f"WITH {RET}, b AS (SELECT *, avg(r) OVER (PARTITION BY trade_date) AS bm FROM r WHERE r IS NOT NULL) SELECT code, avg(r - bm) / stddev_samp(r - bm) * sqrt(252) AS information_ratio FROM b GROUP BY code", "information_ratio")
def m02(spark, d):
    from pyspark.sql import Window

    r = ind.with_returns(bars(spark, d)).where("r IS NOT NULL").withColumn("bm", F.avg("r").over(Window.partitionBy("trade_date")))
    return perf.information_ratio(r, "r", "bm", ("code",))


@query("m03_drawdown", f"WITH {NAV} SELECT strategy, trade_date, drawdown, datediff('day', top_date, trade_date)::INT AS under_water FROM pk", "drawdown")
def m03(spark, d):
    return perf.with_drawdown(navs(spark, d)).select("strategy", "trade_date", "drawdown", "under_water")


@query("m07_win_stats", f"""WITH {BARS}, m AS (SELECT code, date_trunc('month', trade_date)::DATE AS label, arg_max(close, trade_date) AS close FROM bars GROUP BY 1, 2), r AS (SELECT code, close / lag(close) OVER (PARTITION BY code ORDER BY label) - 1 AS r FROM m),
  g AS (SELECT code, count(r) AS n, avg((r > 0)::INT) AS win_rate, avg(r) FILTER (r > 0) / avg(-r) FILTER (r < 0) AS payoff, avg((r > 0)::INT) FILTER (r <> 0) AS p, avg(r) AS mean, var_samp(r) AS v, exp(avg(ln(1 + r))) - 1 AS geometric FROM r GROUP BY code)
  SELECT code, n, win_rate, payoff, mean, geometric, win_rate - (1 - win_rate) / payoff AS kelly, p - (1 - p) / payoff AS kelly_nonzero, mean / v AS kelly_mv FROM g""", "win_rate payoff mean geometric kelly kelly_nonzero kelly_mv")
def m07(spark, d):
    m = cal.resampled(bars(spark, d), "M")
    return perf.win_stats(m.withColumn("r", F.col("close") / F.lag("close").over(series(order="label")) - 1), "r", ("code",))


@query("m08_rolling_packs", f"""WITH {BARS}, p AS ({' UNION ALL '.join(f"SELECT code AS strategy, trade_date, '{k}' AS \"window\", close / lag(close, {n}) OVER w - 1 AS ret, close / max(close) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM bars {W}" for k, n in (('4w', 20), ('3m', 63), ('1y', 252)))}) SELECT * FROM p""", "ret drawdown")
def m08(spark, d):
    return perf.rolling_pack(navs(spark, d), "nav", {"4w": 20, "3m": 63, "1y": 252})


@query("m10_distribution", f"WITH {RET} SELECT code, count(r) AS n, min(r) AS low, max(r) AS high, avg(r) AS mean, stddev_samp(r) AS sd, {', '.join(f'quantile_cont(r, {p}) AS p{round(100 * p):02d}' for p in perf.QUANTILES)} FROM r GROUP BY code", "low high mean sd " + " ".join(f"p{round(100 * p):02d}" for p in perf.QUANTILES))
def m10(spark, d):
    return perf.distribution(ind.with_returns(bars(spark, d)), "r", ("code",))


@query("m11_histogram", f"""WITH {RET}, e AS (SELECT code, quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi FROM r GROUP BY code) SELECT r.code, (CASE WHEN r < lo THEN 0 WHEN r > hi THEN 21 ELSE least(20, floor((r - lo) / (hi - lo) * 20) + 1) END)::INT AS bin, count(*) AS n FROM r JOIN e ON r.code = e.code WHERE r IS NOT NULL GROUP BY ALL""")
def m11(spark, d):
    return perf.histogram(ind.with_returns(bars(spark, d)), "r", ("code",))


@query("m12_feature_distributions", f"""WITH {BARS}, m AS (SELECT code, date_trunc('month', trade_date)::DATE AS label, arg_max(close, trade_date) AS close, sum(volume) AS volume, max(high) / min(low) - 1 AS range FROM bars GROUP BY 1, 2), x AS (SELECT code, close / lag(close) OVER w - 1 AS r, volume / lag(volume) OVER w AS rv, range FROM m WINDOW w AS (PARTITION BY code ORDER BY label)),
  u AS (SELECT code, unnest(['r', 'rv', 'range']) AS feature, unnest([r, rv, range]) AS x FROM x) SELECT code, feature, count(x) AS n, avg(x) AS mean, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90 FROM u GROUP BY ALL""", "mean p50 p90")
def m12(spark, d):
    m = cal.resampled(bars(spark, d), "M")
    w = series(order="label")
    feats = {"r": F.col("close") / F.lag("close").over(w) - 1, "rv": F.col("volume") / F.lag("volume").over(w), "range": F.col("high") / F.col("low") - 1}
    cells = F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("x")) for k, v in feats.items()])
    long = m.withColumn("c", cells).select("code", F.explode("c").alias("c")).select("code", "c.*")
    return perf.distribution(long, "x", ("code", "feature")).select("code", "feature", "n", "mean", "p50", "p90")


@query("m14_attribution", f"""WITH {DRIFT}, s AS (SELECT code, sum(ln(1 + w * coalesce(r, 0) / 1000)) AS l FROM w GROUP BY code), p AS (SELECT trade_date, sum(w * coalesce(r, 0) / 1000) AS p FROM w GROUP BY trade_date), t AS (SELECT product(1 + p) - 1 AS t FROM p) SELECT code, l / (SELECT sum(l) FROM s) * (SELECT t FROM t) AS contribution FROM s""", "contribution")
def m14(spark, d):
    return perf.attribution(drift(spark, d).withColumn("r", F.col("r") / 1000), "w", "r")


@query("m14_risk_contribution", f"""WITH {RET}, c AS (SELECT a.code, b.code AS other, covar_samp(a.r, b.r) AS cov FROM r a JOIN r b ON a.trade_date = b.trade_date WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL), q AS (SELECT code, sum(cov / 36) AS c FROM c GROUP BY code) SELECT code, 1.0::DOUBLE / 6 AS weight, c / sum(c) OVER () AS share FROM q""", "weight share")
def m14r(spark, d):
    return perf.risk_contribution(ind.with_returns(bars(spark, d)).withColumn("w", F.lit(1 / 6)), "w", "r")


@query("m17_by_regime", f"""WITH {RET}, s AS (SELECT *, CASE WHEN close > avg(close) OVER {frame(60)} THEN 'UP' ELSE 'DOWN' END AS state FROM r), g AS (SELECT state, count(*) AS days, sum(ln(1 + r)) AS log_return, avg((r > 0)::INT) AS win_rate, avg(r) AS mean FROM s WHERE r IS NOT NULL GROUP BY state) SELECT *, days / sum(days) OVER () AS share FROM g""", "log_return win_rate mean share")
def m17(spark, d):
    s = ind.with_returns(bars(spark, d)).withColumn("state", F.when(F.col("close") > F.avg("close").over(roll(series(), 60)), "UP").otherwise("DOWN"))
    return perf.by_state(s, "state", "r")


@query("m18_confusion", f"""WITH {RET}, y AS (SELECT code, r AS p, lead(r) OVER w AS y FROM r {W}), b AS (SELECT * FROM y WHERE p IS NOT NULL AND y IS NOT NULL), g AS (SELECT code, sum((p > 0 AND y > 0)::INT)::BIGINT AS tp, sum((p > 0 AND y <= 0)::INT)::BIGINT AS fp, sum((p <= 0 AND y > 0)::INT)::BIGINT AS fn, sum((p <= 0 AND y <= 0)::INT)::BIGINT AS tn, quantile_cont(CASE WHEN p > 0 THEN y END, 0.5) AS median_up, quantile_cont(CASE WHEN p <= 0 THEN y END, 0.5) AS median_down FROM b GROUP BY code) SELECT *, (tp + tn) / (tp + fp + fn + tn) AS hit_rate FROM g""", "median_up median_down hit_rate")
def m18(spark, d):
    y = ind.with_returns(bars(spark, d)).withColumn("y", F.lead("r").over(series()))
    return perf.confusion(y, "r", "y", ("code",))


@query("m19_semi_variance", f"WITH {RET} SELECT code, avg(pow(CASE WHEN r IS NOT NULL THEN greatest(r, 0) END, 2)) AS up, avg(pow(CASE WHEN r IS NOT NULL THEN least(r, 0) END, 2)) AS down FROM r GROUP BY code", "up down")
def m19(spark, d):
    return perf.semi_variance(ind.with_returns(bars(spark, d)), "r")


@query("t02_trade_stats", f"""WITH {TRADE}, {TRADES_OF}, g AS (SELECT code, count(ret) AS n, avg((ret > 0)::INT) AS win_rate, avg(ret) FILTER (ret > 0) / avg(-ret) FILTER (ret < 0) AS payoff, avg((ret > 0)::INT) FILTER (ret <> 0) AS p, avg(ret) AS mean, var_samp(ret) AS v, exp(avg(ln(1 + ret)) FILTER (ret > -1)) - 1 AS geometric, sqrt(avg(ret * ret)) AS a FROM tr GROUP BY code)
  SELECT code, n, win_rate, payoff, mean, geometric, win_rate - (1 - win_rate) / payoff AS kelly, p - (1 - p) / payoff AS kelly_nonzero, mean / v AS kelly_mv, CASE WHEN mean / a > 0 AND mean / a < 1 THEN pow((1 - 0.5 * (1 + mean / a)) / (0.5 * (1 + mean / a)), 0.2 / a) WHEN mean / a <= 0 THEN 1.0 END AS risk_of_ruin FROM g""", "win_rate payoff mean geometric kelly kelly_nonzero kelly_mv risk_of_ruin")
def t02(spark, d):
    return perf.trade_stats(all_trades(spark, d), "ret", ("code",))


@query("t04_sqn", f"""WITH {TRADE}, {TRADES_OF}, l AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY code ORDER BY entry_date DESC) <= 100), g AS (SELECT code, count(ret) AS n, avg(ret) AS m, stddev_pop(ret) AS s FROM l GROUP BY code), v AS (SELECT code, n, CASE WHEN n >= 30 AND s > 1e-12 THEN m / s * sqrt(n) END AS sqn FROM g)
  SELECT *, CASE WHEN sqn IS NULL THEN 'none' WHEN sqn < 1.6 THEN 'poor' WHEN sqn < 2.0 THEN 'average' WHEN sqn < 2.5 THEN 'good' WHEN sqn < 3.0 THEN 'very good' ELSE 'excellent' END AS grade FROM v""", "sqn")
def t04(spark, d):
    return perf.sqn(all_trades(spark, d), "ret", "entry_date", ("code",))


@query("t05_rolling_sqn", f"WITH {TRADE}, {TRADES_OF} SELECT code, trade, CASE WHEN count(ret) OVER f >= 30 AND stddev_pop(ret) OVER f > 1e-12 THEN avg(ret) OVER f / stddev_pop(ret) OVER f * sqrt(30) END AS sqn FROM tr WINDOW f AS (PARTITION BY code ORDER BY entry_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)", "sqn")
def t05(spark, d):
    return perf.rolling_sqn(all_trades(spark, d), "ret", "entry_date", ("code",), 30).select("code", "trade", "sqn")
