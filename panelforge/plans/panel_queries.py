"""Queries C: calendars and resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.frames import series
from panelforge.operators import calendar as cal
from panelforge.plans.registry import query
from panelforge.plans.views import BARS, bars

DAYS = f"{BARS}, s AS (SELECT DISTINCT trade_date FROM bars)"
WEEK = "(trade_date + ((5 - isodow(trade_date) + 7) % 7)::INTEGER)"


@query("c02_week_ends", f"WITH {DAYS} SELECT {WEEK} AS label, max(trade_date) AS decision_date FROM s GROUP BY 1")
def c02(spark, d):
    return cal.period_ends(cal.sessions(bars(spark, d)), "W", "FRI")


@query("c02_month_ends", f"WITH {DAYS} SELECT date_trunc('month', trade_date)::DATE AS label, max(trade_date) AS decision_date FROM s GROUP BY 1")
def c02m(spark, d):
    return cal.period_ends(cal.sessions(bars(spark, d)), "M")


@query("c04_nth_session", f"WITH {DAYS}, r AS (SELECT *, date_trunc('quarter', trade_date)::DATE AS label, row_number() OVER (PARTITION BY date_trunc('quarter', trade_date) ORDER BY trade_date) AS k, count(*) OVER (PARTITION BY date_trunc('quarter', trade_date)) AS n FROM s) SELECT label, trade_date AS decision_date FROM r WHERE k = least(10, n)")
def c04(spark, d):
    return cal.nth_session(cal.sessions(bars(spark, d)), "Q", 10)


@query("c05_month_anchor", f"""WITH {DAYS}, t AS (SELECT DISTINCT last_day(trade_date) - 2 AS target_date FROM s), e AS (SELECT target_date, (SELECT min(trade_date) FROM s WHERE trade_date >= target_date) AS session FROM t),
  n AS (SELECT trade_date, lead(trade_date, 5) OVER (ORDER BY trade_date) AS exit_date FROM s) SELECT target_date, session AS entry_date, exit_date FROM e JOIN n ON session = trade_date""")
def c05(spark, d):
    days = cal.sessions(bars(spark, d))
    exits = days.select(F.col("trade_date").alias("session"), F.lead("trade_date", 5).over(Window.orderBy("trade_date")).alias("exit_date"))  # one row a session
    return cal.snapped(cal.month_anchor(days, -3), days, "next").join(exits.hint("merge"), "session").select("target_date", F.col("session").alias("entry_date"), "exit_date")


@query("c06_held_decisions", f"""WITH {DAYS}, m AS (SELECT max(trade_date) AS dd FROM s GROUP BY date_trunc('month', trade_date)), j AS (SELECT trade_date, dd FROM s LEFT JOIN m ON trade_date = dd),
  h AS (SELECT trade_date, last_value(dd IGNORE NULLS) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS decision_date FROM j) SELECT * FROM h WHERE decision_date IS NOT NULL""")
def c06(spark, d):
    days = cal.sessions(bars(spark, d))
    return cal.held(days, cal.period_ends(days, "M"))


@query("c07_weekly_bars", f"WITH {BARS} SELECT code, {WEEK} AS label, arg_min(open, trade_date) AS open, max(high) AS high, min(low) AS low, arg_max(close, trade_date) AS close, sum(volume) AS volume, max(trade_date) AS trade_date FROM bars GROUP BY ALL".replace("GROUP BY ALL", f"GROUP BY code, {WEEK}"), "open high low close volume")
def c07(spark, d):
    return cal.resampled(bars(spark, d), "W")


@query("c08_month_returns", f"WITH {BARS}, m AS (SELECT code, date_trunc('month', trade_date)::DATE AS label, arg_max(close, trade_date) AS close FROM bars GROUP BY 1, 2) SELECT code, label, close / lag(close) OVER (PARTITION BY code ORDER BY label) - 1 AS r FROM m", "r")
def c08(spark, d):
    return cal.resampled(bars(spark, d), "M").select("code", "label", (F.col("close") / F.lag("close").over(series(order="label")) - 1).alias("r"))


@query("c09_return_calendar", f"""WITH {BARS}, x AS (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY trade_date) - 1 AS r FROM bars)
  SELECT code, year(trade_date) AS y, month(trade_date) AS m, product(1 + r) - 1 AS total, count(r) AS days FROM x WHERE r IS NOT NULL GROUP BY ROLLUP (code, year(trade_date), month(trade_date)) HAVING code IS NOT NULL""", "total")
def c09(spark, d):
    x = bars(spark, d).withColumn("r", F.col("close") / F.lag("close").over(series()) - 1).where("r IS NOT NULL")
    x = x.withColumn("y", F.year("trade_date").cast("long")).withColumn("m", F.month("trade_date").cast("long"))
    return x.rollup("code", "y", "m").agg((F.product(1 + F.col("r")) - 1).alias("total"), F.count("r").alias("days")).where("code IS NOT NULL")


@query("c10_sessions_between", f"WITH {DAYS}, n AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS k FROM s), e AS (SELECT code, min(trade_date) AS a, max(trade_date) AS b FROM bars GROUP BY code) SELECT e.code, y.k - x.k + 1 AS sessions FROM e JOIN n x ON x.trade_date = a JOIN n y ON y.trade_date = b")
def c10(spark, d):
    b = bars(spark, d)
    n = cal.sessions(b).withColumn("k", F.row_number().over(Window.orderBy("trade_date")).cast("long"))  # one row a session
    e = b.groupBy("code").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    x, y = n.select(F.col("trade_date").alias("a"), F.col("k").alias("ka")), n.select(F.col("trade_date").alias("b"), F.col("k").alias("kb"))
    return e.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("code", (F.col("kb") - F.col("ka") + 1).alias("sessions"))
