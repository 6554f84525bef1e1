"""Queries of the smaller operators, and chains over several groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.frames import clean, series
from panelforge.functions.storage import shared_dir
from panelforge.functions.tails import erfc_sql
from panelforge.operators import calendar as cal
from panelforge.operators import extras as ex
from panelforge.operators import indicators as ind
from panelforge.operators import ledger
from panelforge.operators import performance as perf
from panelforge.operators import portfolio as pf
from panelforge.operators import signals as sig
from panelforge.operators.admission import POLICIES, admission_summary, admitted
from panelforge.operators.draws import many_draws_sql
from panelforge.operators.permutation import stratified_p
from panelforge.operators.universe import dynamic_weights
from panelforge.plans.indicators_queries import COMPOSITE, RET, W, frame
from panelforge.plans.ledger_queries import LEAD, SWITCH
from panelforge.plans.portfolio_queries import TRADE, TRADES_OF, all_trades, weighted
from panelforge.plans.registry import query
from panelforge.plans.signals_queries import ATR, positions
from panelforge.plans.studies_queries import bootstrap_sql
from panelforge.plans.views import BARS, BRANDS, CONTRACTS, FLOWS, TRADES, bars, brand_bars, contracts, flows, table, trades


@query("p01_clean", f"WITH {BARS}, x AS (SELECT code, trade_date, CASE WHEN day(trade_date) = 3 THEN NULL ELSE close END AS c FROM bars) SELECT code, trade_date, last_value(c IGNORE NULLS) OVER (PARTITION BY code ORDER BY trade_date) AS close FROM x", "close")
def p01(spark, d):
    x = bars(spark, d).withColumn("c", clean(F.when(F.dayofmonth("trade_date") == 3, float("inf")).otherwise(F.col("close"))))
    return x.select("code", "trade_date", F.last("c", True).over(series().rowsBetween(Window.unboundedPreceding, 0)).alias("close"))


@query("p04_compare", f"WITH {BARS} SELECT code, trade_date, close > open AS up, high >= 1.5 * low AS wide FROM bars")
def p04(spark, d):
    return bars(spark, d).select("code", "trade_date", ex.compare("gt", F.col("close"), F.col("open")).alias("up"), ex.compare(">=", F.col("high"), 1.5 * F.col("low")).alias("wide"))


@query("p06_rule_count", f"WITH {BARS} SELECT code, trade_date, (close > open)::INT + (volume > 60)::INT + (high > 2 * low)::INT >= 2 AS pass FROM bars")
def p06(spark, d):
    return bars(spark, d).select("code", "trade_date", ex.at_least([F.col("close") > F.col("open"), F.col("volume") > 60, F.col("high") > 2 * F.col("low")], 2).alias("pass"))


@query("p07_normalised_side", "SELECT l_orderkey AS id, l_linenumber, l_partkey, l_suppkey, CASE WHEN upper(trim(l_returnflag)) IN ('R', 'S', 'SELL') THEN 'SELL' ELSE 'BUY' END AS side, lpad(l_partkey::VARCHAR, 6, '0') AS code FROM lineitem")
def p07(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey", F.when(F.upper(F.trim("l_returnflag")).isin("R", "S", "SELL"), "SELL").otherwise("BUY").alias("side"), F.lpad(F.col("l_partkey").cast("string"), 6, "0").alias("code"))


@query("p09_ratio_text", "SELECT p_partkey AS code, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE / 2 WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN p_size::DOUBLE END AS ratio FROM part", "ratio")
def p09(spark, d):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("2:"), F.col("p_size").cast("string"))).when(k == 1, F.concat(F.col("p_size").cast("string"), F.lit("x"))).when(k == 2, F.col("p_size").cast("string")).otherwise("none")
    return table(spark, d, "part").select(F.col("p_partkey").alias("code"), ex.ratio_of(text).alias("ratio"))


@query("p11_tags", "SELECT event_id, array_to_string(list_sort(list_distinct([event_type, 'all', CASE WHEN value > 20 THEN 'large' ELSE 'small' END])), ',') AS tags FROM events")
def p11(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.array_distinct(F.array("event_type", F.lit("all"), F.when(F.col("value") > 20, "large").otherwise("small")))), ",").alias("tags"))


@query("p16_cash_adjusted", f"""WITH {BARS}, h AS (SELECT *, close + coalesce(sum(CASE WHEN day(trade_date) = 15 THEN 1.5 END) OVER w, 0) AS hfq FROM bars {W}), l AS (SELECT code, arg_max(close, trade_date) AS c, arg_max(hfq, trade_date) AS h FROM h GROUP BY code)
  SELECT h.code, trade_date, hfq, hfq * (l.c / l.h) AS qfq FROM h JOIN l ON h.code = l.code""", "hfq qfq")
def p16(spark, d):
    b = bars(spark, d).select("code", "trade_date", "close")
    return ex.cash_adjusted(b, b.where(F.dayofmonth("trade_date") == 15).select("code", "trade_date", F.lit(1.5).alias("cash"))).select("code", "trade_date", "hfq", "qfq")


@query("p17_accumulated", f"WITH {BARS}, x AS (SELECT code, trade_date, open AS unit, close AS accum FROM bars), l AS (SELECT code, arg_max(accum / unit, trade_date) AS r FROM x GROUP BY code) SELECT x.code, trade_date, accum AS hfq, accum / r AS qfq FROM x JOIN l ON x.code = l.code", "hfq qfq")
def p17(spark, d):
    return ex.accumulated_adjusted(bars(spark, d).select("code", "trade_date", F.col("open").alias("unit"), F.col("close").alias("accum"))).select("code", "trade_date", "hfq", "qfq")


@query("j04_cross_market", f"""WITH {BARS}, s AS (SELECT DISTINCT trade_date FROM bars WHERE code = 'AF'), u AS (SELECT trade_date AS f, close, (SELECT min(trade_date) FROM s WHERE s.trade_date >= u.trade_date + 1) AS t FROM bars u WHERE code = 'RO') SELECT t AS trade_date, arg_max(close, f) AS close, max(f) AS from_date FROM u WHERE t IS NOT NULL GROUP BY t""", "close")
def j04(spark, d):
    b = bars(spark, d)
    return ex.next_session_signal(b.where("code = 'RO'").select("trade_date", "close"), cal.sessions(b.where("code = 'AF'")), "close")


@query("j11_combine_first", f"WITH {BARS}, a AS (SELECT * FROM bars WHERE code = 'AF'), b AS (SELECT * FROM bars WHERE code = 'NO') SELECT coalesce(a.trade_date, b.trade_date) AS trade_date, coalesce(a.close, b.close) AS close FROM a FULL JOIN b ON a.trade_date = b.trade_date", "close")
def j11(spark, d):
    b = bars(spark, d)
    x, y = b.where("code = 'AF'").select("trade_date", F.col("close").alias("x")), b.where("code = 'NO'").select("trade_date", F.col("close").alias("y"))
    return x.join(y.hint("merge"), "trade_date", "full").select("trade_date", F.coalesce("x", "y").alias("close"))


@query("j13_stitch", f"WITH {RET}, s AS (SELECT code AS strategy, year(trade_date) AS segment, trade_date, r / 1000 AS r FROM r WHERE r IS NOT NULL UNION ALL SELECT code, year(trade_date) - 1, trade_date, 0 FROM r WHERE month(trade_date) = 1 AND r IS NOT NULL), o AS (SELECT strategy, trade_date, arg_max(r, segment) AS r FROM s GROUP BY ALL) SELECT strategy, trade_date, r, product(1 + r) OVER (PARTITION BY strategy ORDER BY trade_date) AS nav FROM o", "r nav")
def j13(spark, d):
    r = ind.with_returns(bars(spark, d)).where("r IS NOT NULL").select(F.col("code").alias("strategy"), F.year("trade_date").alias("segment"), "trade_date", (F.col("r") / 1000).alias("r"))
    old = r.where(F.month("trade_date") == 1).select("strategy", (F.col("segment") - 1).alias("segment"), "trade_date", F.lit(0.0).alias("r"))
    return ex.stitched(r.unionByName(old))


@query("j14_factor_overlap", f"""WITH {BARS}, p AS (SELECT trade_date, max(close) FILTER (code = 'AF') AS a, max(close) FILTER (code = 'NO') AS b, max(close) FILTER (code = 'RO') AS c FROM bars GROUP BY trade_date), m AS (SELECT (a IS NOT NULL)::INT + 2 * (b IS NOT NULL)::INT + 4 * (c IS NOT NULL)::INT AS m FROM p)
  SELECT mask::INT AS mask, count(*) AS n FROM m, range(1, 8) t(mask) WHERE (m & mask) = mask GROUP BY mask""")
def j14(spark, d):
    p = bars(spark, d).groupBy("trade_date").pivot("code", ["AF", "NO", "RO"]).agg(F.max("close"))
    return ex.factor_overlaps(p, ["AF", "NO", "RO"])


@query("c03_day_of_month", f"""WITH {BARS}, s AS (SELECT DISTINCT trade_date FROM bars WHERE volume > 60), t AS (SELECT DISTINCT date_trunc('month', trade_date)::DATE + 27 AS target_date FROM s), n AS (SELECT target_date, (SELECT max(trade_date) FROM s WHERE trade_date <= target_date) AS session FROM t)
  SELECT target_date, session, CASE WHEN session = target_date THEN 'exact' ELSE 'prev' END AS hit FROM n WHERE session IS NOT NULL""")
def c03(spark, d):
    days = cal.sessions(bars(spark, d).where("volume > 60"))
    return cal.snapped(cal.month_anchor(days, 28), days, "prev").select("target_date", "session", "hit")


@query("x24_parameter_vote", f"WITH {BARS}, v AS (SELECT code, year(trade_date) AS y, 5 * (1 + (count(*) % 4)) AS n FROM bars GROUP BY ALL), c AS (SELECT code, n, count(*) AS k FROM v GROUP BY ALL) SELECT code, n FROM c QUALIFY row_number() OVER (PARTITION BY code ORDER BY k DESC, n) = 1")
def x24(spark, d):
    v = bars(spark, d).groupBy("code", F.year("trade_date")).agg((5 * (1 + F.count("*") % 4)).alias("n"))
    return ex.mode_or_median(v, "n", "mode", ("code",))


@query("g17_index_timing", f"""WITH {RET}, v AS (SELECT *, CASE WHEN count(lr) OVER {frame(20)} >= 20 THEN stddev_samp(lr) OVER {frame(20)} END AS vol FROM r), l AS (SELECT code, trade_date, lag(vol) OVER w AS vol FROM v {W}) SELECT code, trade_date, 0.5 * CASE WHEN vol > 1.2 THEN 0.3 WHEN vol > 1.0 THEN 0.6 ELSE 1.0 END AS w FROM l""", "w")
def g17(spark, d):
    v = ind.with_returns(bars(spark, d)).withColumn("vol", ind.rolling_std("lr", 20, 20)).withColumn("vol", F.lag("vol").over(series()))
    return v.select("code", "trade_date", (0.5 * sig.tiered("vol", [F.lit(1.0), F.lit(1.2)], [1.0, 0.6, 0.3])).alias("w"))


@query("e01_stop_fills", f"WITH {ATR} SELECT code, trade_date, CASE WHEN low < entry * 0.8 THEN least(entry * 0.8, open) END AS intraday, CASE WHEN low < entry * 0.8 THEN close END AS at_close, CASE WHEN low < entry * 0.8 THEN nx END AS next_open FROM (SELECT *, lead(open) OVER (PARTITION BY code ORDER BY trade_date) AS nx FROM a) WHERE hold IS NOT NULL", "intraday at_close next_open")
def e01(spark, d):
    p, stop = positions(spark, d), F.col("entry") * 0.8
    return p.select("code", "trade_date", "hold", sig.stop_fill(stop).alias("intraday"), sig.stop_fill(stop, "close").alias("at_close"), sig.stop_fill(stop, "next").alias("next_open")).where("hold IS NOT NULL").drop("hold")


@query("k04_over_cap", f"""WITH RECURSIVE {BRANDS}, w AS (SELECT code, trade_date, 0.1 + 0.1 * (volume % 5)::INT AS w, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, code) AS rk FROM bars), a AS (SELECT trade_date, 0::BIGINT AS rk, NULL::VARCHAR AS code, 0.0::DOUBLE AS w, 0.0::DOUBLE AS total, 0.0::DOUBLE AS kept FROM (SELECT DISTINCT trade_date FROM w)
    UNION ALL SELECT w.trade_date, w.rk, w.code, w.w, CASE WHEN total + w.w <= 1 + 1e-12 THEN total + w.w ELSE total END, CASE WHEN total + w.w <= 1 + 1e-12 THEN w.w ELSE 0 END FROM a JOIN w ON w.trade_date = a.trade_date AND w.rk = a.rk + 1)
  SELECT code, trade_date, w / greatest(1, sum(w) OVER (PARTITION BY trade_date)) AS scaled, kept FROM a WHERE rk > 0""", "scaled kept")
def k04(spark, d):
    w = brand_bars(spark, d).select("code", "trade_date", (0.1 + 0.1 * (F.col("volume") % 5).cast("int")).alias("w"), F.col("amount").alias("score"))
    a = ex.over_cap(w, "scale").select("code", "trade_date", F.col("w").alias("scaled"))
    return a.join(ex.over_cap(w, "skip").select("code", "trade_date", F.col("w").alias("kept")).hint("merge"), ["code", "trade_date"])


#: The state after each row of a date, by score: positions as a list. Prices of a date and the codes to leave come as lists beside it.
ADMISSION = f"""WITH RECURSIVE {BRANDS}, g AS (SELECT code, trade_date, close AS px, amount AS score, close > avg(close) OVER {frame(20)} AS active, 0.1 + 0.1 * (volume % 4)::INT AS target FROM bars), me AS (SELECT * FROM g WHERE trade_date IN (SELECT max(trade_date) FROM g GROUP BY date_trunc('month', trade_date))),
  r AS MATERIALIZED (SELECT policy, me.*, row_number() OVER (PARTITION BY policy ORDER BY trade_date, score DESC, code) AS rn, row_number() OVER (PARTITION BY policy, trade_date ORDER BY score DESC, code) AS k FROM me, (SELECT unnest(['scale', 'skip', 'replace', 'leverage']) AS policy)),
  dd AS MATERIALIZED (SELECT trade_date, list(code) FILTER (NOT active) AS gone, map(list(code), list(px)) AS pxs, row_number() OVER (ORDER BY trade_date) AS day FROM me GROUP BY trade_date),
  s AS (SELECT DISTINCT policy, 0::BIGINT AS rn, NULL::DATE AS trade_date, NULL::VARCHAR AS code, []::STRUCT(code VARCHAR, w DOUBLE, px DOUBLE, day BIGINT)[] AS held, NULL::VARCHAR AS event, NULL::VARCHAR AS victim FROM r
    UNION ALL SELECT policy, rn, trade_date, code, CASE WHEN over AND lsum > lim + 1e-12 THEN list_transform(h2, lambda x: {{'code': x.code, 'w': x.w * (lim / lsum), 'px': x.px, 'day': x.day}}) ELSE h2 END,
      CASE WHEN NOT asks THEN NULL WHEN over AND policy = 'skip' THEN 'skip' WHEN over THEN 'enter_' || policy ELSE 'enter' END, victim
    FROM (SELECT *, list_sum(list_transform(h2, lambda x: x.w)) AS lsum, CASE WHEN policy = 'leverage' THEN 2.0 ELSE 1.0 END AS lim FROM
     (SELECT *, CASE WHEN NOT asks OR (over AND policy = 'skip') THEN h0 ELSE list_filter(h0, lambda x: victim IS NULL OR x.code <> victim) || [{{'code': code, 'w': target, 'px': px, 'day': day}}] END AS h2 FROM
      (SELECT *, CASE WHEN over AND policy = 'replace' AND len(h0) > 0 THEN list_sort(list_transform(h0, lambda x: {{'ret': coalesce(pxs[x.code] / x.px - 1, 'inf'::DOUBLE), 'day': x.day, 'code': x.code}}))[1].code END AS victim FROM
       (SELECT *, asks AND coalesce(list_sum(list_transform(h0, lambda x: x.w)), 0) + target > 1 + 1e-12 AS over FROM
        (SELECT *, coalesce(active, false) AND NOT list_contains(list_transform(h0, lambda x: x.code), code) AS asks FROM
         (SELECT r.policy, r.rn, r.trade_date, r.code, r.active, r.target, r.px, dd.day, dd.pxs, CASE WHEN r.k = 1 THEN list_filter(s.held, lambda x: NOT list_contains(coalesce(dd.gone, []), x.code)) ELSE s.held END AS h0
          FROM s JOIN r ON r.policy = s.policy AND r.rn = s.rn + 1 JOIN dd ON dd.trade_date = r.trade_date)))))))"""


@query("k04_admission", f"""{ADMISSION}, e AS (SELECT policy, trade_date, last(held ORDER BY rn) AS held FROM s WHERE rn > 0 GROUP BY policy, trade_date), m AS (SELECT policy, trade_date, coalesce(list_sum(list_transform(held, lambda x: x.w)), 0) AS multiple, unnest(held, recursive := false) AS h FROM e)
  SELECT r.policy, r.trade_date, r.code, coalesce(m.h.w, 0) AS weight FROM r LEFT JOIN m ON m.policy = r.policy AND m.trade_date = r.trade_date AND m.h.code = r.code""", "weight")
def k04a(spark, d):
    """Positions admitted at month ends under each policy."""
    return admissions(spark, d).select("policy", "trade_date", "code", "weight")


@query("k04_admission_counts", f"""{ADMISSION}, e AS (SELECT policy, trade_date, list_sum(list_transform(last(held ORDER BY rn), lambda x: x.w)) AS multiple FROM s WHERE rn > 0 GROUP BY policy, trade_date)
  SELECT policy, count(*) FILTER (event LIKE 'enter%') AS entries, count(*) FILTER (event = 'skip') AS skipped, count(victim) AS replaced, count(*) FILTER (starts_with(event, 'enter_')) AS over_cap, (SELECT coalesce(max(multiple), 0) FROM e WHERE e.policy = s.policy) AS largest FROM s WHERE rn > 0 GROUP BY policy""", "largest")
def k04c(spark, d):
    return admission_summary(admissions(spark, d), ("policy",))


def admissions(spark, d):
    g = brand_bars(spark, d).withColumn("active", F.col("close") > F.avg("close").over(series().rowsBetween(-19, 0)))
    last = g.groupBy(F.trunc("trade_date", "month").alias("_m")).agg(F.max("trade_date").alias("trade_date")).select("trade_date")
    g = g.join(last.hint("merge"), "trade_date", "left_semi").select("trade_date", "code", "active", (0.1 + 0.1 * (F.col("volume") % 4).cast("int")).alias("target"), F.col("close").alias("price"), F.col("amount").alias("score"))
    return admitted(g.withColumn("policy", F.explode(F.array(*map(F.lit, POLICIES)))), ("policy",))


@query("k07_period_universe", f"""WITH RECURSIVE {BRANDS}, r AS (SELECT code, trade_date, volume AS t, close / lag(close) OVER w - 1 AS r FROM bars {W}), st AS (SELECT unnest([2, 18]) AS least),
  d AS MATERIALIZED (SELECT least, trade_date, row_number() OVER (PARTITION BY least ORDER BY trade_date) AS i, date_trunc('month', trade_date)::DATE AS label, coalesce(list({{'code': code, 'r': r, 't': t}} ORDER BY code) FILTER (r IS NOT NULL), []) AS act FROM r, st GROUP BY least, trade_date),
  s AS (SELECT least, 0::BIGINT AS i, NULL::DATE AS trade_date, NULL::DATE AS label, map([]::VARCHAR[], []::DOUBLE[]) AS prev, map([]::VARCHAR[], []::DOUBLE[]) AS w, false AS reset FROM st
    UNION ALL SELECT least, i, trade_date, label, map(list_transform(g, lambda x: x.code), list_transform(g, lambda x: CASE WHEN gs > 1e-12 THEN x.w / gs ELSE 1.0 / len(g) END)), map(list_transform(g, lambda x: x.code), list_transform(wd, lambda x: x.w)), reset FROM
     (SELECT *, list_transform(wd, lambda x: {{'code': x.code, 'w': x.w * (1 + x.r)}}) AS g, list_sum(list_transform(wd, lambda x: x.w * (1 + x.r))) AS gs FROM
      (SELECT *, CASE WHEN len(act) < least THEN [] ELSE list_transform(raw, lambda x: {{'code': x.code, 'r': x.r, 'w': CASE WHEN rs > 1e-12 THEN x.w / rs ELSE 1.0 / len(raw) END}}) END AS wd FROM
       (SELECT *, list_sum(list_transform(raw, lambda x: x.w)) AS rs FROM
        (SELECT d.*, d.label IS DISTINCT FROM s.label AS reset, list_transform(d.act, lambda x: {{'code': x.code, 'r': x.r, 'w': CASE WHEN d.label IS DISTINCT FROM s.label THEN x.t::DOUBLE ELSE coalesce(s.prev[x.code], 0) END}}) AS raw FROM s JOIN d ON d.least = s.least AND d.i = s.i + 1)))))
  SELECT r.code, r.trade_date, s.least, coalesce(s.w[r.code], 0) AS w, s.reset FROM r JOIN s ON r.trade_date = s.trade_date""", "w", 9)
def k07p(spark, d):
    """Weights by volume at the month's first day, drifting, over the brands that trade on the day; cash below 2 or 18 of them."""
    r = ind.with_returns(brand_bars(spark, d)).withColumn("month", F.trunc("trade_date", "month"))
    parts = [dynamic_weights(r.withColumn("least", F.lit(n)), "month", target="volume", least=n, keys=("least",)) for n in (2, 18)]
    return parts[0].unionByName(parts[1]).select("code", "trade_date", "least", "w", "reset")


@query("k07_dynamic_universe", f"WITH {BRANDS}, r AS (SELECT code, trade_date, close / lag(close) OVER w - 1 AS r FROM bars {W}) SELECT code, trade_date, CASE WHEN r IS NOT NULL AND count(r) OVER (PARTITION BY trade_date) >= 12 THEN 1.0 / count(r) OVER (PARTITION BY trade_date) ELSE 0 END AS w FROM r", "w")
def k07(spark, d):
    return ex.dynamic_equal(ind.with_returns(brand_bars(spark, d)), 12).select("code", "trade_date", "w")


@query("k16_roll_adjusted", f"WITH {RET}, c AS (SELECT *, month(trade_date) AS contract, lag(1.0) OVER w AS lw, lag(month(trade_date)) OVER w AS lc FROM r {W}) SELECT code, trade_date, CASE WHEN contract <> lc AND lw > 0 THEN lw * r - 2 * 0.0003 ELSE coalesce(lw, 0) * r END AS r_adj FROM c", "r_adj")
def k16(spark, d):
    r = ind.with_returns(bars(spark, d)).withColumn("contract", F.month("trade_date")).withColumn("w", F.lit(1.0))
    return pf.roll_adjusted(r, 0.0003).select("code", "trade_date", "r_adj")


@query("m09_summary", f"WITH {BARS} SELECT code, count(close) AS n, min(close) AS low, quantile_cont(close, 0.1) AS p10, quantile_cont(close, 0.5) AS p50, quantile_cont(close, 0.9) AS p90, max(close) AS high, avg(close) AS mean, arg_max(close, trade_date) AS latest FROM bars GROUP BY code", "low p10 p50 p90 high mean latest")
def m09(spark, d):
    q = F.percentile("close", [0.1, 0.5, 0.9])
    g = bars(spark, d).groupBy("code").agg(F.count("close").alias("n"), F.min("close").alias("low"), q.alias("q"), F.max("close").alias("high"), F.avg("close").alias("mean"), F.max_by("close", "trade_date").alias("latest"))
    return g.select("code", "n", "low", F.get("q", 0).alias("p10"), F.get("q", 1).alias("p50"), F.get("q", 2).alias("p90"), "high", "mean", "latest")


@query("m15_money_weighted", f"""WITH {RET}, m AS (SELECT code, trade_date, coalesce(r, 0) / 1000 AS r, 1.0 / count(*) OVER (PARTITION BY trade_date) AS w FROM r), p AS (SELECT trade_date, sum(w * r) AS pr FROM m GROUP BY trade_date), g AS (SELECT *, product(1 + pr) OVER (ORDER BY trade_date) AS g FROM p), h AS (SELECT trade_date, 10.0 AS c, coalesce(lag(g) OVER (ORDER BY trade_date), 1) AS g0, g FROM g), a AS (SELECT *, g * sum(c / g0) OVER (ORDER BY trade_date) AS acc FROM h), n AS (SELECT *, coalesce(lag(acc) OVER (ORDER BY trade_date), 0) AS nb FROM a)
  SELECT code, sum((nb + c) * w * r) AS pnl, sum((nb + c) * w * r) / (SELECT sum(c) FROM n) AS share FROM m JOIN n ON m.trade_date = n.trade_date GROUP BY code""", "pnl share", 4)
def m15(spark, d):
    m = ind.with_returns(bars(spark, d)).withColumn("r", F.coalesce("r", F.lit(0.0)) / 1000).withColumn("w", pf.equal())
    p = m.groupBy("trade_date").agg(F.sum(F.col("w") * F.col("r")).alias("r")).withColumn("c", F.lit(10.0)).withColumn("strategy", F.lit("s"))
    a = pf.contributions(p, "c", "r", ("strategy",)).withColumn("nav_before", F.coalesce(F.lag("account").over(Window.partitionBy("strategy").orderBy("trade_date")), F.lit(0.0)))
    return ex.money_weighted(m.join(a.select("trade_date", "c", "nav_before").hint("merge"), "trade_date"))


@query("m21_calendar_effect_grid", f"""WITH {RET}, g AS (SELECT k AS anchor, px, CASE px WHEN 'close' THEN r / 1000 ELSE (open / lag(open) OVER (PARTITION BY k, px, code ORDER BY trade_date) - 1) / 1000 END AS r, isodow(trade_date) AS dow FROM r, range(1, 6) t(k), (SELECT unnest(['open', 'close']) AS px))
  SELECT anchor::INT AS anchor, px, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS sd, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM g WHERE dow = anchor AND r IS NOT NULL GROUP BY anchor, px""", "mean sd sharpe", 9)
def m21(spark, d):
    w = series()
    r = ind.with_returns(bars(spark, d)).withColumn("ro", F.try_divide(F.col("open"), F.lag("open").over(w)) - 1)
    cells = F.array(F.struct(F.lit("close").alias("px"), (F.col("r") / 1000).alias("r")), F.struct(F.lit("open").alias("px"), (F.col("ro") / 1000).alias("r")))
    g = r.withColumn("c", cells).select((F.weekday("trade_date") + 1).alias("anchor"), F.explode("c").alias("c")).select("anchor", "c.*").where("anchor <= 5 AND r IS NOT NULL")
    return g.groupBy("anchor", "px").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd")).withColumn("sharpe", perf.safe(F.col("mean"), F.col("sd")) * 252**0.5)


@query("t06_excursions", f"WITH {TRADE}, g AS (SELECT code, trade::BIGINT AS trade, max(high) / arg_min(open, trade_date) - 1 AS mfe FROM q WHERE o GROUP BY code, trade) SELECT code, trade, mfe, mfe / 0.1 AS mfe_r FROM g", "mfe mfe_r")
def t06(spark, d):
    return ex.excursions(pf.with_trades(weighted(spark, d)), 0.1)


@query("t09_groups", f"WITH {TRADES} SELECT side, code % 10 AS grp, count(*) AS n, avg(price) AS mean FROM trades GROUP BY GROUPING SETS ((side, code % 10), (side), ())", "mean")
def t09(spark, d):
    t = trades(spark, d).withColumn("grp", F.col("code") % 10)
    return t.groupingSets([["side", "grp"], ["side"], []], "side", "grp").agg(F.count("*").alias("n"), F.avg("price").alias("mean"))


@query("t10_dispersion", f"WITH {RET}, k AS (SELECT code, year(trade_date) AS y, avg(r) / var_samp(r) AS kelly FROM r GROUP BY ALL) SELECT code, count(kelly) AS n, avg(kelly) AS mean, stddev_samp(kelly) AS sd, min(kelly) AS low, max(kelly) AS high FROM k GROUP BY code", "mean sd low high")
def t10(spark, d):
    k = ind.with_returns(bars(spark, d)).groupBy("code", F.year("trade_date")).agg(perf.safe(F.avg("r"), F.var_samp("r")).alias("kelly"))
    return k.groupBy("code").agg(F.count("kelly").alias("n"), F.avg("kelly").alias("mean"), F.stddev_samp("kelly").alias("sd"), F.min("kelly").alias("low"), F.max("kelly").alias("high"))


@query("f06_roll_metadata", f"WITH RECURSIVE {LEAD}, {SWITCH} SELECT sw.*, a.open AS from_open, a.close AS from_close, b.open AS to_open, b.close AS to_close FROM sw LEFT JOIN contracts a ON a.root = sw.root AND a.contract = from_contract AND a.trade_date = sw.trade_date LEFT JOIN contracts b ON b.root = sw.root AND b.contract = to_contract AND b.trade_date = sw.trade_date", "from_open from_close to_open to_close")
def f06(spark, d):
    c = contracts(spark, d)
    return ex.roll_metadata(c, ledger.switches(ledger.dominant(c)))


@query("f08_group_rotation", f"""WITH {CONTRACTS}, m AS (SELECT *, close / lag(close, 3) OVER w - 1 AS mom, lead(close) OVER w / close - 1 AS fwd FROM contracts WINDOW w AS (PARTITION BY root, contract ORDER BY trade_date)), p AS (SELECT * FROM m WHERE mom IS NOT NULL QUALIFY row_number() OVER (PARTITION BY root, trade_date ORDER BY mom DESC, contract) <= 3) SELECT root, trade_date, avg(fwd) AS r FROM p WHERE fwd IS NOT NULL GROUP BY ALL""", "r")
def f08(spark, d):
    w = Window.partitionBy("root", "contract").orderBy("trade_date")
    m = contracts(spark, d).withColumn("mom", F.try_divide(F.col("close"), F.lag("close", 3).over(w)) - 1).withColumn("fwd", F.try_divide(F.lead("close").over(w), F.col("close")) - 1).where("mom IS NOT NULL")
    k = F.row_number().over(Window.partitionBy("root", "trade_date").orderBy(F.desc("mom"), "contract"))
    return m.withColumn("k", k).where("k <= 3 AND fwd IS NOT NULL").groupBy("root", "trade_date").agg(F.avg("fwd").alias("r"))


@query("l06_repo_interest", f"""WITH f AS (SELECT o_orderkey AS id, floor(o_totalprice) AS principal, o_orderdate::DATE AS start, (1 + o_orderkey % 14)::INT AS n FROM orders), s AS (SELECT DISTINCT l_shipdate::DATE AS d FROM lineitem),
  j AS (SELECT f.*, d, start + n AS e FROM f JOIN s ON d >= start AND d < start + n), g AS (SELECT *, least(coalesce(lead(d) OVER (PARTITION BY id ORDER BY d), e), e) AS nx FROM j) SELECT id, d AS trade_date, principal * 2.5 / 100 * datediff('day', d, nx) / 365 AS interest FROM g""", "interest")
def l06(spark, d):
    o = table(spark, d, "orders")
    details = o.select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("double").alias("principal"), F.lit(2.5).alias("rate_pct"), F.to_date("o_orderdate").alias("start"), (1 + F.col("o_orderkey") % 14).alias("interest_days"), F.lit(365).alias("basis"))
    return ex.repo_interest(details, cal.sessions(bars(spark, d)))


@query("q03_distinct", f"WITH {TRADES} SELECT side, count(DISTINCT code) AS codes, count(DISTINCT account_id) AS accounts, count(DISTINCT trade_date) AS days FROM trades GROUP BY side")
def q03(spark, d):
    return trades(spark, d).groupBy("side").agg(F.count_distinct("code").alias("codes"), F.count_distinct("account_id").alias("accounts"), F.count_distinct("trade_date").alias("days"))


@query("r11_volatility_timing", f"""WITH {RET}, v AS (SELECT *, CASE WHEN count(lr) OVER {frame(20)} >= 20 THEN stddev_samp(lr) OVER {frame(20)} END AS vol FROM r), q AS (SELECT *, CASE WHEN count(vol) OVER e >= 60 THEN quantile_cont(vol, 0.8) OVER e END AS cut FROM v WINDOW e AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  x AS (SELECT *, CASE WHEN coalesce(vol > cut, false) THEN 0.5 ELSE 1.0 END AS ex FROM q), n AS (SELECT code, r / 1000 AS bh, coalesce(lag(ex) OVER w, 0) * r / 1000 AS t FROM x {W}) SELECT code, product(1 + t) - 1 AS timed, product(1 + bh) - 1 AS held FROM n WHERE bh IS NOT NULL GROUP BY code""", "timed held")
def r11(spark, d):
    v = ind.with_returns(bars(spark, d)).withColumn("vol", ind.rolling_std("lr", 20, 20))
    v = ind.with_quantiles(v.select("code", "trade_date", "r", "vol"), {"cut": ("vol", 0.8, None, 60)}).withColumn("ex", sig.tiered("vol", [F.col("cut")], [1.0, 0.5]))
    n = v.withColumn("bh", F.col("r") / 1000).withColumn("t", F.coalesce(F.lag("ex").over(series()), F.lit(0.0)) * F.col("bh")).where("bh IS NOT NULL")
    return n.groupBy("code").agg((F.product(1 + F.col("t")) - 1).alias("timed"), (F.product(1 + F.col("bh")) - 1).alias("held"))


@query("z03_running_cash", f"WITH {FLOWS} SELECT account_id, id, sum(amount) OVER (PARTITION BY account_id ORDER BY flow_date, id ROWS UNBOUNDED PRECEDING) AS cash FROM flows", "cash")
def z03(spark, d):
    w = Window.partitionBy("account_id").orderBy("flow_date", "id").rowsBetween(Window.unboundedPreceding, 0)
    return flows(spark, d).select("account_id", "id", F.sum("amount").over(w).alias("cash"))


@query("e05_bias_take_profit", f"""WITH {ATR}, m AS (SELECT *, avg(close) OVER {frame(20)} AS ma FROM a), l AS (SELECT *, lag(ma) OVER p AS pm, lag(atr) OVER p AS pa FROM m WHERE hold IS NOT NULL WINDOW p AS (PARTITION BY code, hold ORDER BY trade_date)), ln AS (SELECT *, max(pm + pa) OVER q AS l0, max(pm + 2 * pa) OVER q AS l1 FROM l WINDOW q AS (PARTITION BY code, hold ORDER BY trade_date)),
  ht AS (SELECT *, coalesce(max((high >= l0)::INT) OVER q, 0) AS h0, coalesce(max((high >= l1)::INT) OVER q, 0) AS h1 FROM ln WINDOW q AS (PARTITION BY code, hold ORDER BY trade_date)) SELECT code, trade_date, greatest(0, 1 - h0 * 0.4 - h1 * 0.4)::DOUBLE AS size FROM ht""", "size")
def e05(spark, d):
    p = positions(spark, d).withColumn("ma", F.avg("close").over(series().rowsBetween(-19, 0))).where("hold IS NOT NULL")
    return ex.bias_take_profit(p, "ma", "atr", [(1.0, 0.4), (2.0, 0.4)]).select("code", "trade_date", "size")


@query("e10_stop_plan", f"WITH {ATR}, l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1) SELECT code, trade_date, entry * 0.9 AS stop, close, entry * 0.9 * 0.998 AS expected_fill FROM l WHERE hold IS NOT NULL", "stop close expected_fill")
def e10(spark, d):
    return ex.stop_plan(positions(spark, d).withColumn("stop", F.col("entry") * 0.9), "stop", 0.002)


@query("e12_own_return_sizing", f"""WITH RECURSIVE {RET}, q AS MATERIALIZED (SELECT code, trade_date, r / 1000 AS r, row_number() OVER w AS rn FROM r WHERE r IS NOT NULL {W}), s AS (SELECT DISTINCT code, 0::BIGINT AS rn, [1.0::DOUBLE] AS navs, 0.0::DOUBLE AS e FROM q
  UNION ALL SELECT code, rn, list_append(navs, navs[-1] * (1 + e * x))[-21:], e FROM (SELECT q.code, q.rn, q.r AS x, navs, CASE WHEN navs[-1] / navs[1] - 1 > 0.01 THEN 1.0 WHEN navs[-1] / navs[1] - 1 > 0.0 THEN 0.7 ELSE 0.3 END::DOUBLE AS e FROM s JOIN q ON q.code = s.code AND q.rn = s.rn + 1))
  SELECT q.code AS strategy, trade_date, r, e AS exposure, navs[-1] AS nav FROM q JOIN s ON q.code = s.code AND q.rn = s.rn""", "r exposure nav", 4)
def e12(spark, d):
    """Each instrument held alone, as a strategy of its own."""
    r = ind.with_returns(bars(spark, d)).where("r IS NOT NULL").select(F.col("code").alias("strategy"), "trade_date", (F.col("r") / 1000).alias("r"))
    return ex.own_return_sizing(r, "r", 20, [0.0, 0.01], [0.3, 0.7, 1.0])


@query("e13_composite_cap", f"WITH {COMPOSITE} SELECT trade_date, CASE WHEN composite > 0.95 THEN 0.3 WHEN composite > 0.8 THEN 0.6 ELSE 1.0 END AS cap FROM cp", "cap")
def e13(spark, d):
    c = ind.composite(ind.deviations(bars(spark, d)), ["ret_dev", "vol_dev", "act_dev"])
    return c.select("trade_date", sig.tiered("composite", [F.lit(0.8), F.lit(0.95)], [1.0, 0.6, 0.3]).alias("cap"))


@query("l09_attribution", f"""WITH {RET}, x AS (SELECT code, trade_date, coalesce(r, 0) / 1000 AS r, 0.12 AS w, 1.0 / count(*) OVER (PARTITION BY trade_date) AS wb FROM r), b AS (SELECT *, sum(wb * r) OVER (PARTITION BY trade_date) AS b, sum(w * r) OVER (PARTITION BY trade_date) - 0.0001 AS total FROM x),
  g AS (SELECT trade_date, sum((w - wb) * (r - b)) AS selection, any_value(b) AS position, -sum(0.00001) AS cost, (sum(w) - 1) * any_value(b) AS cash_drag, any_value(total) AS total FROM b GROUP BY trade_date) SELECT *, total - selection - position - cost - cash_drag AS timing FROM g""", "selection position cost cash_drag total timing", 9)
def l09(spark, d):
    xs_day = Window.partitionBy("trade_date")
    x = ind.with_returns(bars(spark, d)).select("code", "trade_date", (F.coalesce("r", F.lit(0.0)) / 1000).alias("r"), F.lit(0.12).alias("w"), F.lit(0.00001).alias("cost"))
    x = x.withColumn("wb", 1.0 / F.count("*").over(xs_day)).withColumn("total", F.sum(F.col("w") * F.col("r")).over(xs_day) - 0.0001)
    return ex.attributed(x)


@query("l12_marked_positions", f"WITH {BARS}, p AS (SELECT trade_date, 100.0 AS cash, sum(close * CASE code WHEN 'AF' THEN 2 WHEN 'RO' THEN 3 END) AS v FROM bars WHERE code IN ('AF', 'RO') GROUP BY trade_date), e AS (SELECT trade_date, cash + v AS equity FROM p) SELECT 1::BIGINT AS account_id, trade_date, equity, max(equity) OVER (ORDER BY trade_date) AS peak, equity / max(equity) OVER (ORDER BY trade_date) - 1 AS drawdown FROM e", "equity peak drawdown")
def l12(spark, d):
    b = bars(spark, d)
    held = b.where("code IN ('AF', 'RO')").select("trade_date").distinct().select(F.lit(1).cast("long").alias("account_id"), "trade_date", F.lit(100.0).alias("cash"), F.lit('{"AF": 2, "RO": 3}').alias("positions"))
    return ex.marked(held, b)


@query("s21_missing_keys", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY l_partkey")
def s21(spark, d):
    return ex.missing_keys(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part").where("p_size > 5"), "p_partkey")


@query("s21_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def s21k(spark, d):
    return ex.repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("t03_r_multiples", f"WITH {TRADE}, {TRADES_OF}, b AS (SELECT code, trade_date, open, avg(high - low) OVER {frame(14)} AS atr FROM bars), k AS (SELECT tr.code, trade, ret, 2.0 * atr / open + 0.001 AS risk FROM tr JOIN b ON tr.code = b.code AND entry_date = b.trade_date) SELECT code, trade, risk, ret / risk AS r_multiple FROM k", "risk r_multiple")
def t03(spark, d):
    b = bars(spark, d).withColumn("atr", F.avg(F.col("high") - F.col("low")).over(series().rowsBetween(-13, 0)))
    return ex.r_multiples(all_trades(spark, d), b, 2.0, 0.001).select("code", "trade", "risk", "r_multiple")


CONDITIONS = f"""WITH {TRADE}, {TRADES_OF}, j AS (SELECT ret, b.volume > 60 AS heavy, b.high > 2 * b.low AS wide, b.close > 1000 AS dear FROM tr JOIN bars b ON tr.code = b.code AND entry_date = b.trade_date), u AS (SELECT ret, unnest(['heavy', 'wide', 'dear']) AS condition, unnest([heavy, wide, dear]) AS i FROM j),
  g AS (SELECT condition, count(*) FILTER (i) AS n_in, count(*) FILTER (NOT i) AS n_out, avg((ret > 0)::INT) FILTER (i) AS win_in, avg((ret > 0)::INT) FILTER (NOT i) AS win_out, avg(ret) FILTER (i) AS mean_in, avg(ret) FILTER (NOT i) AS mean_out, var_samp(ret) FILTER (i) AS vi, var_samp(ret) FILTER (NOT i) AS vo FROM u GROUP BY condition),
  p AS (SELECT *, (coalesce(win_in, 0) * n_in + coalesce(win_out, 0) * n_out) / (n_in + n_out) AS pl FROM g) SELECT condition, n_in, n_out, win_in, win_out, mean_in, mean_out, CASE WHEN n_in > 0 AND n_out > 0 AND pl > 0 AND pl < 1 THEN (win_in - win_out) / sqrt(pl * (1 - pl) * (1.0 / n_in + 1.0 / n_out)) END AS z, CASE WHEN n_in > 1 AND n_out > 1 THEN (mean_in - mean_out) / sqrt(vi / n_in + vo / n_out) END AS t FROM p"""


@query("t07_entry_conditions", CONDITIONS, "win_in win_out mean_in mean_out z t")
def t07(spark, d):
    """Trades whose entry meets a condition against those whose does not."""
    return entry_conditions(spark, d)


@query("t07_q_values", f"""WITH ec AS ({CONDITIONS}), pv AS (SELECT *, {erfc_sql('abs(t) * sqrt(0.5)')} AS p FROM ec), rk AS (SELECT *, row_number() OVER (ORDER BY p NULLS FIRST) AS i, count(*) OVER () AS m FROM pv)
  SELECT * EXCLUDE (i, m), least(1, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM rk""", "win_in win_out mean_in mean_out z t p q")
def t07q(spark, d):
    """The same with normal p and q-values over the family of conditions."""
    from panelforge.operators import studies as st

    return st.benjamini_hochberg(entry_conditions(spark, d).withColumn("p", st.normal_p("t")), "p", count_untested=True)  # as its SQL has it


@query("t07_stratified", f"""WITH {TRADE}, {TRADES_OF}, j AS (SELECT tr.code, entry_date, ret, b.volume > 60 AS heavy, b.high > 2 * b.low AS wide, b.close > 1000 AS dear FROM tr JOIN bars b ON tr.code = b.code AND entry_date = b.trade_date),
  u AS (SELECT code, entry_date, ret, unnest(['heavy', 'wide', 'dear']) AS condition, unnest([heavy, wide, dear]) AS f FROM j), v AS (SELECT condition, 'return' AS measure, code, entry_date, f, ret AS v FROM u UNION ALL SELECT condition, 'win', code, entry_date, f, (ret > 0)::INT FROM u WHERE ret <> 0),
  k AS (SELECT condition, measure, code, count(*) AS n, count(*) FILTER (f) AS k, sum(v) AS a FROM v GROUP BY ALL), re AS (SELECT condition, measure, count(*) FILTER (f) AS n_in, count(*) FILTER (NOT f) AS n_out, sum(v) AS a, avg(v) FILTER (f) - avg(v) FILTER (NOT f) AS diff FROM v GROUP BY ALL),
  dr AS (SELECT v.*, trial, row_number() OVER (PARTITION BY v.condition, v.measure, v.code, trial ORDER BY {many_draws_sql('trial', 7, 'v.condition', 'v.measure', 'v.code', 'entry_date')}, entry_date) AS rn FROM v, range(0, 1000) t(trial)),
  su AS (SELECT dr.condition, dr.measure, trial, coalesce(sum(v) FILTER (rn <= k), 0) AS s FROM dr JOIN k USING (condition, measure, code) GROUP BY ALL),
  pv AS (SELECT condition, measure, any_value(n_in) AS n_in, any_value(n_out) AS n_out, any_value(diff) AS diff, CASE WHEN any_value(n_in) > 0 AND any_value(n_out) > 0 THEN (sum((abs(s / n_in - (a - s) / n_out) >= abs(diff) - 1e-12)::INT) + 1) / 1001 END AS p FROM su JOIN re USING (condition, measure) GROUP BY ALL),
  bh AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY p NULLS LAST) AS i, count(p) OVER (PARTITION BY measure) AS n FROM pv) SELECT condition, measure, n_in, n_out, diff, p, CASE WHEN p IS NOT NULL THEN least(1, min(p * n / i) OVER (PARTITION BY measure ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS q FROM bh""", "diff p q")
def t07s(spark, d):
    """Conditions at entry against returns and wins: labels shuffled within codes, q over the conditions that have a p."""
    from panelforge.operators import studies as st

    rows = condition_rows(spark, d)
    both = rows.select("condition", F.lit("return").alias("measure"), "code", "entry_date", "inside", F.col("ret").alias("v")).unionByName(rows.where("ret <> 0").select("condition", F.lit("win").alias("measure"), "code", "entry_date", "inside", (F.col("ret") > 0).cast("double").alias("v")))
    return st.benjamini_hochberg(stratified_p(both, "v", "inside", "code", "entry_date", 1000, keys=("condition", "measure")), "p", ("measure",))


def entry_conditions(spark, d):
    from panelforge.operators import studies as st

    return st.two_samples(condition_rows(spark, d), "ret", F.col("inside"), ("condition",))


def condition_rows(spark, d):
    b = bars(spark, d).select("code", F.col("trade_date").alias("entry_date"), F.col("close").alias("px"), "volume", "high", "low")
    t = all_trades(spark, d).join(b.hint("merge"), ["code", "entry_date"])
    conds = {"heavy": F.col("volume") > 60, "wide": F.col("high") > 2 * F.col("low"), "dear": F.col("px") > 1000}
    cells = F.array(*[F.struct(F.lit(k).alias("condition"), c.alias("inside")) for k, c in conds.items()])
    return t.withColumn("c", F.explode(cells)).select("code", "entry_date", "ret", "c.*")


@query("r07_grid_under_bootstrap", f"""WITH {RET}, lb AS (SELECT code, trade_date, r, n AS lookback, coalesce((close > lag(close, n) OVER (PARTITION BY n, code ORDER BY trade_date))::INT, 0) AS p FROM r, (SELECT unnest([5, 20, 60]) AS n)), sr AS (SELECT code, lookback, trade_date, coalesce(lag(p) OVER (PARTITION BY lookback, code ORDER BY trade_date), 0) * r / 1000 AS x FROM lb), {bootstrap_sql('sr', 100, 'code, lookback')},
  si AS (SELECT code, lookback, sim, product(1 + x) - 1 AS total FROM path GROUP BY ALL), be AS (SELECT code, sim, lookback FROM si QUALIFY row_number() OVER (PARTITION BY code, sim ORDER BY round(total, 12) DESC, lookback) = 1), ct AS (SELECT code, lookback, count(*) AS c FROM be GROUP BY ALL) SELECT code, lookback FROM ct QUALIFY row_number() OVER (PARTITION BY code ORDER BY c DESC, lookback) = 1""")
def r07(spark, d):
    """Best lookback of each resample by total return, and the lookback that most resamples choose."""
    from panelforge.operators import studies as st

    b = ind.with_returns(bars(spark, d)).withColumn("lookback", F.explode(F.array(F.lit(5), F.lit(20), F.lit(60))))
    w = series(("lookback", "code"))
    rule = F.when(F.col("lookback") == 5, F.lag("close", 5).over(w)).when(F.col("lookback") == 20, F.lag("close", 20).over(w)).otherwise(F.lag("close", 60).over(w))
    x = b.withColumn("_p", F.coalesce((F.col("close") > rule).cast("int"), F.lit(0))).withColumn("x", F.coalesce(F.lag("_p").over(w), F.lit(0)) * F.col("r") / 1000)
    sims = st.block_bootstrap(x, "x", 100, 20, keys=("code", "lookback"), draw=("code",))
    best = sims.groupBy("code", "sim").agg(F.max_by("lookback", F.struct(F.round("total", 12), -F.col("lookback"))).alias("lookback"))
    return ex.mode_or_median(best, "lookback", "mode", ("code",))


@query("s06_continuous_close", f"WITH {CONTRACTS}, c AS (SELECT root, trade_date, first(close ORDER BY hold DESC, contract) AS close FROM contracts GROUP BY ALL), p AS (SELECT DISTINCT c_mktsegment AS root, c_mktsegment || '01' AS code FROM customer) SELECT p.code, trade_date, close FROM p JOIN c ON p.root = c.root", "close")
def s06(spark, d):
    w = Window.partitionBy("root", "trade_date").orderBy(F.desc("hold"), "contract")
    series_rows = contracts(spark, d).withColumn("k", F.row_number().over(w)).where("k = 1").select(F.concat("root", F.lit("889")).alias("code"), "trade_date", "close")
    pool = table(spark, d, "customer").select(F.concat("c_mktsegment", F.lit("01")).alias("code")).distinct()
    return ex.continuous_of(pool, series_rows)


@query("s07_signal_and_execution", f"WITH {BARS} SELECT a.code, a.trade_date, a.close + 5 AS close, a.open AS exec_open, a.close AS exec_close FROM bars a WHERE a.volume > 60", "close exec_open exec_close")
def s07(spark, d):
    b = bars(spark, d)
    return ex.signal_and_execution(b.select("code", "trade_date", (F.col("close") + 5).alias("close")), b.where("volume > 60"))


@query("s20_run_table", f"WITH {BARS} SELECT code, year(trade_date) AS run, count(*) AS n, avg(close) AS mean FROM bars GROUP BY ALL", "mean")
def s20(spark, d):
    """A result table written by run and read back, as exports are."""
    import uuid

    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    g = bars(spark, d).groupBy("code", F.year("trade_date").alias("run")).agg(F.count("*").alias("n"), F.avg("close").alias("mean"))
    g.write.partitionBy("run").parquet(path)
    return spark.read.parquet(path).select("code", F.col("run").cast("long").alias("run"), "n", "mean")
