"""Queries X: scores, ranks, picks, screens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.frames import roll, series
from panelforge.operators import calendar as cal
from panelforge.operators import cross_section as xs
from panelforge.operators import indicators as ind
from panelforge.plans.indicators_queries import RET, W, frame
from panelforge.plans.registry import query
from panelforge.plans.views import BARS, BRANDS, bars, brand_bars

MOM = f"{BARS}, m AS (SELECT *, lag(close, 5) OVER w / lag(close, 25) OVER w - 1 AS mom FROM bars {W})"
BMOM = f"{BRANDS}, m AS (SELECT *, close / lag(close, 20) OVER w - 1 AS mom FROM bars {W})"


def scored(spark, d):
    return bars(spark, d).withColumn("mom", xs.trailing_return(20, 5))


def brands_scored(spark, d):
    return brand_bars(spark, d).withColumn("mom", xs.trailing_return(20))


@query("x01_trailing_return", f"WITH {MOM} SELECT code, trade_date, mom FROM m", "mom")
def x01(spark, d):
    return scored(spark, d).select("code", "trade_date", "mom")


@query("x02_ratio_scores", f"""WITH {RET}, x AS (SELECT *, stddev_samp(r) OVER {frame(20)} AS sd, stddev_samp(least(r, 0)) OVER {frame(20)} AS ds, avg(r) OVER {frame(20)} AS mean, count(r) OVER {frame(20)} AS n FROM r WHERE r IS NOT NULL)
  SELECT code, trade_date, CASE WHEN n >= 20 THEN CASE WHEN abs(sd) < 1e-12 THEN sign(mean) * 1e9 ELSE mean / sd END END AS sharpe, CASE WHEN n >= 20 THEN CASE WHEN abs(ds) < 1e-12 THEN sign(mean) * 1e9 ELSE mean / ds END END AS sortino FROM x""", "sharpe sortino")
def x02(spark, d):
    df = ind.with_returns(bars(spark, d)).where("r IS NOT NULL")
    return df.select("code", "trade_date", xs.ratio_score("r", 20).alias("sharpe"), xs.ratio_score("r", 20, True).alias("sortino"))


@query("x03_factors", f"""WITH {RET} SELECT code, trade_date, close / avg(close) OVER {frame(20)} - 1 AS sma_trend, -stddev_samp(r) OVER {frame(20)} AS low_vol, stddev_samp(r) OVER {frame(10)} / nullif(stddev_samp(r) OVER {frame(60)}, 0) - 1 AS vol_change, (close / lag(close, 10) OVER w - 1) - (close / lag(close, 60) OVER w - 1) AS decay FROM r {W}""", "sma_trend low_vol vol_change decay")
def x03(spark, d):
    w, c = series(), F.col("close")
    sd = lambda n: F.stddev_samp("r").over(roll(w, n))
    long = F.when(sd(60) != 0, sd(60))
    return ind.with_returns(bars(spark, d)).select("code", "trade_date", (c / F.avg("close").over(roll(w, 20)) - 1).alias("sma_trend"), (-sd(20)).alias("low_vol"), (sd(10) / long - 1).alias("vol_change"), ((c / F.lag(c, 10).over(w) - 1) - (c / F.lag(c, 60).over(w) - 1)).alias("decay"))


@query("x04_pct_rank", f"WITH {BMOM}, k AS (SELECT * FROM m WHERE mom IS NOT NULL) SELECT code, trade_date, (rank() OVER (PARTITION BY trade_date ORDER BY mom) + (count(*) OVER (PARTITION BY trade_date, mom) - 1) / 2.0) / count(*) OVER (PARTITION BY trade_date) AS pct FROM k UNION ALL SELECT code, trade_date, NULL FROM m WHERE mom IS NULL", "pct")
def x04(spark, d):
    return brands_scored(spark, d).select("code", "trade_date", xs.pct_rank("mom").alias("pct"))


@query("x05_multi_factor", f"""WITH {BRANDS}, m AS (SELECT *, close / lag(close, 20) OVER w - 1 AS mom, -amount AS small FROM bars {W}), k AS (SELECT * FROM m WHERE mom IS NOT NULL)
  SELECT code, trade_date, 0.7 * (rank() OVER (PARTITION BY trade_date ORDER BY mom) + (count(*) OVER (PARTITION BY trade_date, mom) - 1) / 2.0) / count(*) OVER (PARTITION BY trade_date) + 0.3 * (rank() OVER (PARTITION BY trade_date ORDER BY small) + (count(*) OVER (PARTITION BY trade_date, small) - 1) / 2.0) / count(*) OVER (PARTITION BY trade_date) AS score FROM k""", "score")
def x05(spark, d):
    df = brands_scored(spark, d).where("mom IS NOT NULL").withColumn("small", -F.col("amount"))
    df = df.withColumn("a", xs.pct_rank("mom")).withColumn("b", xs.pct_rank("small"))
    return df.select("code", "trade_date", xs.weighted({"a": 0.7, "b": 0.3}).alias("score"))


@query("x06_score_filter", f"WITH {MOM} SELECT code, trade_date, CASE WHEN close > avg(close) OVER {frame(20)} AND stddev_samp(close) OVER {frame(20)} / avg(close) OVER {frame(20)} < 0.6 THEN mom END AS score FROM m", "score")
def x06(spark, d):
    f = roll(series(), 20)
    ok = (F.col("close") > F.avg("close").over(f)) & (F.stddev_samp("close").over(f) / F.avg("close").over(f) < 0.6)
    return scored(spark, d).select("code", "trade_date", F.when(ok, F.col("mom")).alias("score"))


@query("x07_cash_rule", f"WITH {BARS}, a AS (SELECT *, close > 1.1 * avg(close) OVER {frame(20)} AS above FROM bars) SELECT trade_date, NOT bool_or(above) AS cash FROM a GROUP BY trade_date")
def x07(spark, d):
    df = bars(spark, d).withColumn("above", F.col("close") > 1.1 * F.avg("close").over(roll(series(), 20)))
    return df.withColumn("cash", xs.cash_rule(F.col("above"))).select("trade_date", "cash").distinct()


@query("x08_top_k", f"WITH {BMOM} SELECT code, trade_date, mom, row_number() OVER (PARTITION BY trade_date ORDER BY mom DESC, code)::INT AS place FROM m WHERE mom IS NOT NULL QUALIFY place <= 3", "mom")
def x08(spark, d):
    return xs.picks(brands_scored(spark, d), "mom", 3).select("code", "trade_date", "mom", "place")


@query("x08_bottom_k", f"WITH {BMOM} SELECT code, trade_date, mom, row_number() OVER (PARTITION BY trade_date ORDER BY mom, code)::INT AS place FROM m WHERE mom IS NOT NULL QUALIFY place <= 2", "mom")
def x08b(spark, d):
    return xs.picks(brands_scored(spark, d), "mom", -2).select("code", "trade_date", "mom", "place")


@query("x09_beats_benchmark", f"""WITH {MOM}, b AS (SELECT *, max(CASE WHEN code = 'AF' THEN mom END) OVER (PARTITION BY trade_date) AS bm FROM m), c AS (SELECT *, code <> 'AF' AND mom > bm AS beats FROM b)
  SELECT code, trade_date, mom FROM c QUALIFY coalesce(beats, false) OR (NOT bool_or(coalesce(beats, false)) OVER (PARTITION BY trade_date) AND code = 'AF')""", "mom")
def x09(spark, d):
    return xs.beating(scored(spark, d), "mom", "AF").select("code", "trade_date", "mom")


@query("x10_one_per_group", f"WITH {BMOM} SELECT code, trade_date, mom FROM m WHERE mom IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date, substr(code, 7, 1) ORDER BY mom DESC, code) = 1", "mom")
def x10(spark, d):
    df = brands_scored(spark, d).where("mom IS NOT NULL").withColumn("grp", F.substring("code", 7, 1))
    return xs.one_per_group(df, "grp", [F.desc("mom")]).select("code", "trade_date", "mom")


@query("x11_backfill", f"WITH {BMOM} SELECT code, trade_date, mom FROM m WHERE mom IS NOT NULL AND close > 60 QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY mom DESC, code) <= 3", "mom")
def x11(spark, d):
    return xs.filtered_picks(brands_scored(spark, d), "mom", F.col("close") > 60, 3, True).select("code", "trade_date", "mom")


@query("x12_entry_filters", f"WITH {BMOM} SELECT code, trade_date, (close > avg(close) OVER {frame(20)})::INT + (close / avg(close) OVER {frame(20)} - 1 < 0.5)::INT + coalesce((mom > 0)::INT, 0) >= 2 AS pass FROM m")
def x12(spark, d):
    ma = F.avg("close").over(roll(series(), 20))
    flags = (F.col("close") > ma).cast("int") + (F.col("close") / ma - 1 < 0.5).cast("int") + F.coalesce((F.col("mom") > 0).cast("int"), F.lit(0))
    return brands_scored(spark, d).select("code", "trade_date", (flags >= 2).alias("pass"))


@query("x16_trailing_significance", f"""WITH {MOM}, y AS (SELECT *, lead(close, 5) OVER w / close - 1 AS y FROM m {W}), k AS (SELECT * FROM y WHERE mom IS NOT NULL AND y IS NOT NULL),
  g AS (SELECT code, count(*) FILTER (mom > 0) AS n_up, count(*) FILTER (mom <= 0) AS n_down, avg(y) FILTER (mom > 0) AS mean_up, avg(y) FILTER (mom <= 0) AS mean_down, var_samp(y) FILTER (mom > 0) AS vu, var_samp(y) FILTER (mom <= 0) AS vd, corr(mom, y) AS ic FROM k GROUP BY code)
  SELECT code, n_up, n_down, mean_up, mean_down, mean_up - mean_down AS spread, (mean_up - mean_down) / sqrt(vu / n_up + vd / n_down) AS t, ic FROM g""", "mean_up mean_down spread t ic")
def x16(spark, d):
    df = scored(spark, d).withColumn("y", F.lead("close", 5).over(series()) / F.col("close") - 1)
    return xs.trailing_significance(df, "mom", "y")


CORR = f"{RET}, p AS (SELECT a.code AS a, b.code AS b, count(*) AS n, corr(a.r, b.r) AS corr FROM r a JOIN r b ON a.trade_date = b.trade_date AND a.code < b.code WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL)"


@query("x17_groups", f"""WITH RECURSIVE {CORR}, l AS (SELECT a, b FROM p WHERE abs(corr) >= 0.02 UNION SELECT b, a FROM p WHERE abs(corr) >= 0.02), c AS (SELECT DISTINCT code FROM bars), t AS (SELECT code, code AS reach FROM c UNION SELECT t.code, l.b FROM t JOIN l ON t.reach = l.a)
  SELECT code, min(reach) AS "group" FROM t GROUP BY code""")
def x17(spark, d):
    r = ind.with_returns(bars(spark, d))
    return xs.groups(xs.correlations(r, least=1), r.select("code").distinct(), 0.02)


@query("x18_correlations", f"WITH {CORR} SELECT * FROM p WHERE n >= 20", "corr")
def x18(spark, d):
    return xs.correlations(ind.with_returns(bars(spark, d)))


@query("x19_mean_correlation", f"WITH {CORR}, u AS (SELECT a AS code, corr FROM p UNION ALL SELECT b, corr FROM p) SELECT code, avg(corr) AS mean_corr, avg(abs(corr)) AS mean_abs_corr FROM u GROUP BY code", "mean_corr mean_abs_corr")
def x19(spark, d):
    return xs.mean_correlation(xs.correlations(ind.with_returns(bars(spark, d)), least=1))


GRID = f"""{RET}, g AS (SELECT n, code, CASE WHEN close > lag(close, n) OVER (PARTITION BY n, code ORDER BY trade_date) THEN 1 ELSE 0 END AS pos, lead(close) OVER (PARTITION BY n, code ORDER BY trade_date) / close - 1 AS fwd FROM r, range(5, 45, 5) t(n)),
  s AS (SELECT code, n::INT AS n, avg(pos * fwd) / stddev_samp(pos * fwd) AS sharpe, avg(pos * fwd) AS mean FROM g WHERE fwd IS NOT NULL GROUP BY code, n)"""


def grid(spark, d):
    """Score of a trend rule by lookback: all lookbacks as rows of one job."""
    b = bars(spark, d).withColumn("n", F.explode(F.sequence(F.lit(5), F.lit(40), F.lit(5))))
    w = series(("n", "code"))
    b = b.withColumn("hist", F.collect_list("close").over(w.rowsBetween(-40, 0)))
    pos = F.when(F.get("hist", F.size("hist") - 1 - F.col("n")) < F.col("close"), 1).otherwise(0)
    b = b.withColumn("x", pos * (F.lead("close").over(w) / F.col("close") - 1)).where("x IS NOT NULL")
    return b.groupBy("code", "n").agg((F.avg("x") / F.stddev_samp("x")).alias("sharpe"), F.avg("x").alias("mean"))


@query("x20_best_parameter", f"WITH {GRID} SELECT code, n, sharpe, mean FROM s QUALIFY row_number() OVER (PARTITION BY code ORDER BY sharpe DESC, n) = 1", "sharpe mean")
def x20(spark, d):
    return xs.best_parameters(grid(spark, d), [F.desc("sharpe"), F.asc("n")], ("code",))


@query("x21_composite_score", f"""WITH {GRID} SELECT code, n, 0.5 * (CASE WHEN max(sharpe) OVER c > min(sharpe) OVER c THEN (sharpe - min(sharpe) OVER c) / (max(sharpe) OVER c - min(sharpe) OVER c) ELSE 0.5 END)
  + 0.5 * (CASE WHEN max(mean) OVER c > min(mean) OVER c THEN (mean - min(mean) OVER c) / (max(mean) OVER c - min(mean) OVER c) ELSE 0.5 END) AS score FROM s WINDOW c AS (PARTITION BY code)""", "score")
def x21(spark, d):
    return grid(spark, d).select("code", "n", (0.5 * xs.min_max("sharpe", ("code",)) + 0.5 * xs.min_max("mean", ("code",))).alias("score"))


@query("x22_neighbourhood", f"""WITH {GRID}, m AS (SELECT *, sharpe >= quantile_cont(sharpe, 0.7) OVER (PARTITION BY code) AS top FROM s)
  SELECT a.code, a.n, count(*) AS neighbours, avg(b.top::INT) AS top_share, avg(b.sharpe) AS mean, stddev_pop(b.sharpe) AS sd FROM m a JOIN m b ON a.code = b.code AND abs(a.n - b.n) <= 5 GROUP BY a.code, a.n""", "top_share mean sd")
def x22(spark, d):
    g = grid(spark, d).withColumnRenamed("n", "lookback").withColumn("q", F.lit(0))
    out = xs.neighbourhood(g, "lookback", "q", (5, 0), "sharpe", 0.7)
    return out.select("code", F.col("lookback").alias("n"), F.col("n").alias("neighbours"), "top_share", "mean", "sd")


@query("x23_stable_lookback", f"WITH {GRID}, gp AS (SELECT *, greatest(abs(sharpe - lag(sharpe) OVER c), abs(sharpe - lead(sharpe) OVER c)) AS gap FROM s WINDOW c AS (PARTITION BY code ORDER BY n)), q AS (SELECT *, quantile_cont(gap, 0.8) OVER (PARTITION BY code) AS lim FROM gp) SELECT code, n, sharpe FROM q WHERE gap <= lim QUALIFY row_number() OVER (PARTITION BY code ORDER BY sharpe DESC, n) = 1", "sharpe")
def x23(spark, d):
    w = Window.partitionBy("code").orderBy("n")
    gap = F.greatest(F.abs(F.col("sharpe") - F.lag("sharpe").over(w)), F.abs(F.col("sharpe") - F.lead("sharpe").over(w)))
    g = grid(spark, d).withColumn("gap", gap).withColumn("lim", F.percentile("gap", 0.8).over(Window.partitionBy("code"))).where("gap <= lim")
    return xs.best_parameters(g, [F.desc("sharpe"), F.asc("n")], ("code",)).select("code", "n", "sharpe")
