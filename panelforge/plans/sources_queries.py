"""Queries S, V, P, J, Q: sources, checks, projections, joins, slices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.frames import run_id, series
from panelforge.operators import calendar as cal
from panelforge.operators import quality
from panelforge.plans.registry import query
from panelforge.plans.views import BARS, BRANDS, CONTRACTS, TRADES, bars, brand_bars, contracts, table, trades
from panelforge.sources import prices

W = "WINDOW w AS (PARTITION BY code ORDER BY trade_date)"


@query("s01_load_close", f"WITH {BARS} SELECT code, trade_date, close FROM bars WHERE code IN ('AF', 'RO') AND trade_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'", "close")
def s01(spark, d):
    return prices.load(bars(spark, d), ["close"], ["AF", "RO"], "1996-01-01", "1998-12-31")


@query("s02_load_ohlcv", f"WITH {BARS} SELECT code, trade_date, open, high, low, close, volume, amount FROM bars WHERE trade_date >= DATE '1999-01-01'", "open high low close volume amount")
def s02(spark, d):
    return prices.load(bars(spark, d), ["open", "high", "low", "close", "volume", "amount"], start="1999-01-01")


@query("s05_event_series", "SELECT ts::DATE AS trade_date, arg_max(value, event_id) AS close, count(*) AS n FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' GROUP BY 1", "close")
def s05(spark, d):
    e = table(spark, d, "events").where((F.col("event_type") == "purchase") & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")))
    return e.groupBy(F.to_date("ts").alias("trade_date")).agg(F.max_by("value", "event_id").alias("close"), F.count("*").alias("n"))


@query("s08_ranges", f"WITH {BARS} SELECT code, min(trade_date) AS first_date, max(trade_date) AS last_date, count(*) AS n, count(DISTINCT trade_date) AS days FROM bars GROUP BY code")
def s08(spark, d):
    return bars(spark, d).groupBy("code").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count("*").alias("n"), F.count_distinct("trade_date").alias("days"))


@query("s09_liquidity", f"""WITH {BARS}, m AS (SELECT code, quantile_cont(amount / (volume * close), 0.5) AS ratio FROM bars GROUP BY code)
  SELECT bars.code, trade_date, coalesce(CASE WHEN volume >= 60 THEN amount END, volume * (open + high + low + close) / 4 * CASE WHEN ratio > 10 THEN 100 ELSE 1 END) AS notional FROM bars JOIN m ON bars.code = m.code""", "notional")
def s09(spark, d):
    b = bars(spark, d)
    ratio = b.groupBy("code").agg(F.percentile(F.col("amount") / (F.col("volume") * F.col("close")), 0.5).alias("ratio"))
    lot = F.when(F.col("ratio") > 10, 100).otherwise(1)
    guess = F.col("volume") * (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4 * lot
    return b.join(ratio.hint("merge"), "code").select("code", "trade_date", F.coalesce(F.when(F.col("volume") >= 60, F.col("amount")), guess).alias("notional"))


@query("s11_first_source", f"WITH {BARS}, s AS (SELECT *, CASE WHEN code < 'N' THEN 2 ELSE 1 END + (year(trade_date) % 2) AS source_rank FROM bars) SELECT code, trade_date, close, source_rank::INT AS source_rank FROM s WHERE source_rank = (SELECT min(t.source_rank) FROM s t WHERE t.code = s.code)", "close")
def s11(spark, d):
    b = bars(spark, d).withColumn("source_rank", (F.when(F.col("code") < "N", 2).otherwise(1) + F.year("trade_date") % 2).cast("int"))
    return prices.first_source(b).select("code", "trade_date", "close", "source_rank")


@query("s12_best_source", f"""WITH {BRANDS}, s AS (SELECT *, CASE WHEN volume > 25 THEN 'thick' ELSE 'thin' END AS source FROM bars),
  q AS (SELECT code, source, count(DISTINCT trade_date) + 120 * count(DISTINCT trade_date) / (datediff('day', min(trade_date), max(trade_date)) + 1) AS score FROM s GROUP BY ALL)
  SELECT code, source, score FROM q QUALIFY row_number() OVER (PARTITION BY code ORDER BY score DESC, source) = 1""", "score")
def s12(spark, d):
    return prices.best_source(brand_bars(spark, d).withColumn("source", F.when(F.col("volume") > 25, "thick").otherwise("thin")))


@query("s13_upsert", f"WITH {BARS}, n AS (SELECT code, trade_date, close + 1 AS close FROM bars WHERE trade_date >= DATE '2001-01-01') SELECT code, trade_date, close FROM bars WHERE (code, trade_date) NOT IN (SELECT (code, trade_date) FROM n) UNION ALL SELECT * FROM n", "close")
def s13(spark, d):
    b = bars(spark, d).select("code", "trade_date", "close")
    return prices.upserted(b, b.where("trade_date >= DATE '2001-01-01'").withColumn("close", F.col("close") + 1), ["code", "trade_date"])


@query("s14_purge", f"WITH {BARS} SELECT code, trade_date, close FROM bars WHERE NOT (code = 'AF' AND trade_date < DATE '1998-01-01')", "close")
def s14(spark, d):
    return bars(spark, d).where(~((F.col("code") == "AF") & (F.col("trade_date") < F.lit("1998-01-01").cast("date")))).select("code", "trade_date", "close")


@query("s15_ingest_audit", f"""WITH {BARS}, o AS (SELECT code, trade_date, close FROM bars WHERE trade_date < DATE '2001-01-01'), n AS (SELECT code, trade_date, CASE WHEN day(trade_date) = 1 THEN close + 1 ELSE close END AS close FROM bars WHERE trade_date >= DATE '2000-06-01')
  SELECT n.code, n.trade_date, n.close, o.close AS old_value, CASE WHEN o.code IS NULL THEN 'insert' WHEN o.close = n.close THEN 'same' ELSE 'update' END AS action FROM n LEFT JOIN o ON n.code = o.code AND n.trade_date = o.trade_date""", "close old_value")
def s15(spark, d):
    b = bars(spark, d).select("code", "trade_date", "close")
    new = b.where("trade_date >= DATE '2000-06-01'").withColumn("close", F.when(F.dayofmonth("trade_date") == 1, F.col("close") + 1).otherwise(F.col("close")))
    return prices.classified(b.where("trade_date < DATE '2001-01-01'"), new, ["code", "trade_date"], "close")


@query("s16_rollback", f"WITH {BARS} SELECT code, trade_date, close FROM bars WHERE trade_date < DATE '2001-01-01'", "close")
def s16(spark, d):
    b = bars(spark, d).select("code", "trade_date", "close")
    old = b.where("trade_date < DATE '2001-01-01'")
    new = b.where("trade_date >= DATE '2000-06-01'").withColumn("close", F.col("close") + 1)
    audit = prices.classified(old, new, ["code", "trade_date"], "close")
    return prices.rolled_back(prices.upserted(old, new, ["code", "trade_date"]), audit, ["code", "trade_date"], "close")


@query("s17_fingerprint", f"""WITH {BARS}, h AS (SELECT code, md5(trade_date::VARCHAR || '|' || (close * 100)::BIGINT || '|' || volume::BIGINT) AS m FROM bars),
  s AS (SELECT code, count(*) AS n, {', '.join(f"sum(('0x' || substr(m, {a}, 8))::BIGINT)::VARCHAR AS s{k}" for k, a in enumerate((1, 9, 17, 25)))} FROM h GROUP BY code)
  SELECT code, n, sha256(n || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) AS fingerprint FROM s""")
def s17(spark, d):
    b = bars(spark, d).select("code", "trade_date", F.round(F.col("close") * 100).cast("long").alias("close"), F.col("volume").cast("long").alias("volume"))
    return prices.fingerprint(b, ["code"], "trade_date", ["close", "volume"])


@query("s18_coverage", f"WITH {BRANDS} SELECT p.code, min(trade_date) AS first_date, max(trade_date) AS last_date, count(DISTINCT trade_date) AS days FROM (SELECT DISTINCT p_brand AS code FROM part) p LEFT JOIN bars ON p.code = bars.code GROUP BY p.code")
def s18(spark, d):
    return prices.coverage(brand_bars(spark, d), table(spark, d, "part").select(F.col("p_brand").alias("code")).distinct())


@query("s19_fetch_plan", f"""WITH {BRANDS}, l AS (SELECT code, max(trade_date) AS last FROM bars GROUP BY code)
  SELECT code, greatest(DATE '2001-01-01', last + 1) AS start, DATE '2001-11-02' AS "end" FROM l WHERE greatest(DATE '2001-01-01', last + 1) <= DATE '2001-11-02'""")
def s19(spark, d):
    b = brand_bars(spark, d)
    return prices.fetch_plan(b.select("code").distinct(), b, "2001-01-01", "2001-11-02")


@query("v01_violations", f"""WITH {BARS}, x AS (SELECT *, lag(close) OVER w AS known, lag(trade_date) OVER w AS before FROM bars {W})
  SELECT code, trade_date, 'spread' AS rule FROM x WHERE high / low - 1 > 0.5 UNION ALL SELECT code, trade_date, 'gap' FROM x WHERE datediff('day', before, trade_date) > 2 UNION ALL SELECT code, trade_date, 'jump' FROM x WHERE abs(close / known - 1) > 0.3
  UNION ALL SELECT code, trade_date, 'outside_range' FROM x WHERE low > least(open, close) OR high < greatest(open, close)""")
def v01(spark, d):
    return quality.violations(bars(spark, d), max_gap=2)


@query("v02_policy", "SELECT p_partkey AS code, CASE WHEN regexp_matches(p_name, '(?i)bond|steel') THEN 'bond' WHEN regexp_matches(p_name, '(?i)gold|copper|brass|tin') THEN 'commodity' WHEN regexp_matches(p_name, '(?i)money|cash') THEN 'cash' ELSE 'equity' END AS policy FROM part")
def v02(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("code"), quality.policy(F.col("p_name")).alias("policy"))


@query("v03_basis_ranges", f"WITH {BRANDS}, r AS (SELECT code, CASE WHEN volume > 25 THEN 'none' ELSE 'hfq' END AS adjust, min(trade_date) AS a, max(trade_date) AS b FROM bars GROUP BY ALL) SELECT code, count(DISTINCT a) AS starts, count(DISTINCT b) AS ends FROM r GROUP BY code HAVING count(DISTINCT a) > 1 OR count(DISTINCT b) > 1")
def v03(spark, d):
    return quality.inconsistent_ranges(brand_bars(spark, d).withColumn("adjust", F.when(F.col("volume") > 25, "none").otherwise("hfq")))


@query("v04_readiness", f"""WITH {BRANDS}, r AS (SELECT *, abs(close / lag(close) OVER w - 1) AS r FROM bars {W}), n AS (SELECT count(DISTINCT trade_date) AS days FROM bars)
  SELECT code, count(close) AS points, max(r) AS max_abs_return, 1 - count(close) / any_value(days) AS missing, count(close) >= 500 AND 1 - count(close) / any_value(days) <= 0.4 AS ready FROM r, n GROUP BY code""", "max_abs_return missing")
def v04(spark, d):
    return quality.readiness(brand_bars(spark, d), 500, 0.4)


@query("v05_shared_days", f"WITH {BARS}, c AS (SELECT trade_date, count(DISTINCT code) AS c FROM bars GROUP BY 1) SELECT count(*) AS union_days, sum((c = (SELECT count(DISTINCT code) FROM bars))::INT)::BIGINT AS common_days FROM c")
def v05(spark, d):
    return quality.shared_days(bars(spark, d))


@query("v06_repair", f"WITH {CONTRACTS} SELECT contract, trade_date, open IS NULL OR open <= 0 OR abs(open / close - 1) > 0.5 AS fixed, CASE WHEN open <= 0 OR abs(open / close - 1) > 0.5 THEN close ELSE open END AS settle FROM contracts", "settle")
def v06(spark, d):
    c = contracts(spark, d).select("contract", "trade_date", F.col("open").alias("settle"), "close")
    return quality.repaired(c, "settle", "close", 0.5).select("contract", "trade_date", "fixed", "settle")


@query("v07_errors", f"""WITH {BARS}, u AS (SELECT code, trade_date, unnest(['open', 'close']) AS field, unnest([open, close]) AS x, unnest([low, high]) AS y FROM bars)
  SELECT code, field, count(*) AS n, avg(abs(x - y)) AS mae, sqrt(avg((x - y) * (x - y))) AS rmse, max(abs(x - y)) AS max_abs, avg(abs(x / y - 1)) AS mape, quantile_cont(abs(x / y - 1), 0.95) AS p95 FROM u GROUP BY ALL""", "mae rmse max_abs mape p95")
def v07(spark, d):
    b = bars(spark, d)
    return quality.errors(b, b.select("code", "trade_date", F.col("low").alias("open"), F.col("high").alias("close")), ["open", "close"])


@query("v08_correct", f"WITH {BARS} SELECT code, trade_date, CASE WHEN abs(close / open - 1) > 0.2 THEN open ELSE close END AS close, CASE WHEN abs(close / open - 1) > 0.2 THEN close END AS was FROM bars", "close was")
def v08(spark, d):
    b = bars(spark, d)
    return quality.corrected(b.select("code", "trade_date", "close"), b.select("code", "trade_date", F.col("open").alias("close")), "close", 0.2)


@query("v09_latest_percentile", f"WITH {BARS}, l AS (SELECT code, arg_max(close, trade_date) AS latest FROM bars GROUP BY code) SELECT bars.code, avg((close <= latest)::INT) AS pct FROM bars JOIN l ON bars.code = l.code GROUP BY 1", "pct")
def v09(spark, d):
    b = bars(spark, d)
    latest = b.groupBy("code").agg(F.max_by("close", "trade_date").alias("latest"))
    return b.join(latest.hint("merge"), "code").groupBy("code").agg(F.avg((F.col("close") <= F.col("latest")).cast("int")).alias("pct"))


@query("p02_returns", f"WITH {BARS} SELECT code, trade_date, close / lag(close) OVER w - 1 AS r, ln(close / lag(close) OVER w) AS lr, lead(close) OVER w / close - 1 AS fwd, close - lag(close, 5) OVER w AS mom5 FROM bars {W}", "r lr fwd mom5")
def p02(spark, d):
    w = series()
    c = F.col("close")
    return bars(spark, d).select("code", "trade_date", (c / F.lag("close").over(w) - 1).alias("r"), F.ln(c / F.lag("close").over(w)).alias("lr"), (F.lead("close").over(w) / c - 1).alias("fwd"), (c - F.lag("close", 5).over(w)).alias("mom5"))


@query("p05_rule_overlay", f"""WITH {BARS}, r AS (SELECT * FROM (VALUES ('AF', 0.03), ('NO', 0.01)) t(code, lim)), x AS (SELECT *, abs(close / lag(close) OVER w - 1) AS r FROM bars {W})
  SELECT x.code, trade_date, x.r > coalesce(r.lim, 0.02) AS pass FROM x LEFT JOIN r ON x.code = r.code WHERE x.r IS NOT NULL""")
def p05(spark, d):
    rules = spark.createDataFrame([("AF", 0.03), ("NO", 0.01)], "code string, lim double")  # a handful of rules
    x = bars(spark, d).withColumn("r", F.abs(F.col("close") / F.lag("close").over(series()) - 1)).where("r IS NOT NULL")
    return x.join(F.broadcast(rules), "code", "left").select("code", "trade_date", (F.col("r") > F.coalesce("lim", F.lit(0.02))).alias("pass"))


@query("p08_code_parts", "SELECT o_orderkey AS id, upper(trim(substr(o_orderpriority, 3))) AS root, regexp_extract(o_orderpriority, '^(\\d+)', 1) AS suffix, lpad(o_custkey::VARCHAR, 6, '0') AS padded FROM orders")
def p08(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.upper(F.trim(F.substring(p, 3, 99))).alias("root"), F.regexp_extract(p, r"^(\d+)", 1).alias("suffix"), F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("padded"))


@query("p12_quick_range", f"WITH {BARS}, m AS (SELECT min(trade_date) AS a, max(trade_date) AS b FROM bars) SELECT k AS range, greatest(a, (b - to_months(n::INTEGER))::DATE) AS start, b AS \"end\" FROM m, (VALUES ('1m', 1), ('3m', 3), ('1y', 12), ('5y', 60), ('10y', 120)) t(k, n)")
def p12(spark, d):
    ends = bars(spark, d).agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    ranges = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in (("1m", 1), ("3m", 3), ("1y", 12), ("5y", 60), ("10y", 120))]))
    return ends.select("a", "b", ranges.alias("r")).select(F.col("r.k").alias("range"), F.greatest("a", F.add_months("b", -F.col("r.n"))).alias("start"), F.col("b").alias("end"))


@query("p13_buckets", f"WITH {BARS}, x AS (SELECT *, close / lag(close, 20) OVER w - 1 AS m FROM bars {W}) SELECT code, floor(m * 100)::BIGINT AS bucket, count(*) AS n FROM x WHERE m IS NOT NULL GROUP BY ALL")
def p13(spark, d):
    x = bars(spark, d).withColumn("m", F.col("close") / F.lag("close", 20).over(series()) - 1).where("m IS NOT NULL")
    return x.groupBy("code", F.floor(F.col("m") * 100).alias("bucket")).count().withColumnRenamed("count", "n")


@query("p14_fees", "SELECT l_orderkey AS id, l_linenumber, l_partkey, l_suppkey, greatest(5, l_extendedprice * 0.00025) + CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 0.0005 ELSE 0 END AS fee FROM lineitem", "fee", 9)
def p14(spark, d):
    amount = F.col("l_extendedprice")
    fee = F.greatest(F.lit(5.0), amount * 0.00025) + F.when(F.col("l_returnflag") == "R", amount * 0.0005).otherwise(0.0)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey", fee.alias("fee"))


@query("p15_pseudo_ohlc", f"WITH {BARS}, x AS (SELECT code, trade_date, close, coalesce(lag(close) OVER w, close) AS open FROM bars {W}) SELECT code, trade_date, open, greatest(open, close) AS high, least(open, close) AS low, close FROM x", "open high low close")
def p15(spark, d):
    x = bars(spark, d).select("code", "trade_date", F.coalesce(F.lag("close").over(series()), "close").alias("open"), "close")
    return x.select("code", "trade_date", "open", F.greatest("open", "close").alias("high"), F.least("open", "close").alias("low"), "close")


@query("p18_event_adjusted", f"""WITH {BARS}, x AS (SELECT code, trade_date, close, CASE WHEN month(trade_date) = 6 AND month(lag(trade_date) OVER w) < 6 THEN (lag(close) OVER w - 10) / lag(close) OVER w ELSE 1 END AS ratio FROM bars {W})
  SELECT code, trade_date, close * coalesce(product(ratio) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS qfq FROM x""", "qfq")
def p18(spark, d):
    w = series()
    event = (F.month("trade_date") == 6) & (F.month(F.lag("trade_date").over(w)) < 6)
    x = bars(spark, d).withColumn("ratio", F.when(event, (F.lag("close").over(w) - 10) / F.lag("close").over(w)).otherwise(1.0))
    after = w.rowsBetween(1, Window.unboundedFollowing)
    return x.select("code", "trade_date", (F.col("close") * F.coalesce(F.product("ratio").over(after), F.lit(1.0))).alias("qfq"))


@query("p20_contract_months", "SELECT DISTINCT c_mktsegment || strftime(m, '%y%m') AS contract FROM customer, (SELECT unnest(generate_series(DATE '1998-01-01', DATE '1999-06-01', INTERVAL 1 MONTH)) AS m)")
def p20(spark, d):
    roots = table(spark, d, "customer").select("c_mktsegment").distinct()
    m = F.explode(F.sequence(F.lit("1998-01-01").cast("date"), F.lit("1999-06-01").cast("date"), F.expr("INTERVAL 1 MONTH")))
    return roots.withColumn("m", m).select(F.concat("c_mktsegment", F.date_format("m", "yyMM")).alias("contract"))


@query("j01_union_calendar", f"""WITH {BRANDS}, f AS (SELECT code, min(trade_date) AS a FROM bars GROUP BY code), g AS (SELECT f.code, t.trade_date FROM f JOIN (SELECT DISTINCT trade_date FROM bars) t ON t.trade_date >= f.a)
  SELECT g.code, g.trade_date, last_value(close IGNORE NULLS) OVER (PARTITION BY g.code ORDER BY g.trade_date) AS close FROM g LEFT JOIN bars b ON g.code = b.code AND g.trade_date = b.trade_date""", "close")
def j01(spark, d):
    b = brand_bars(spark, d)
    return cal.reindexed(b.select("code", "trade_date", "close"), cal.sessions(b), ["close"])


@query("j02_as_of", f"WITH {BARS}, l AS (SELECT DISTINCT 'AF' AS code, o_orderdate::DATE AS trade_date FROM orders) SELECT l.code, l.trade_date, b.close, b.trade_date AS close_date FROM l ASOF LEFT JOIN bars b ON l.code = b.code AND l.trade_date >= b.trade_date", "close")
def j02(spark, d):
    left = table(spark, d, "orders").select(F.lit("AF").alias("code"), F.to_date("o_orderdate").alias("trade_date")).distinct()
    return cal.as_of(left, bars(spark, d), "close", ["code"]).select("code", "trade_date", "close", "close_date")


_SNAP = """WITH {b}, s AS (SELECT DISTINCT trade_date FROM bars WHERE code = 'AF'), t AS (SELECT DISTINCT date_trunc('month', trade_date)::DATE + 14 AS target_date FROM bars)
  SELECT target_date, (SELECT {f}(trade_date) FROM s WHERE trade_date {op} target_date) AS session FROM t WHERE EXISTS (SELECT 1 FROM s WHERE trade_date {op} target_date)"""


@query("j03_snap_next", _SNAP.format(b=BARS, f="min", op=">="))
def j03(spark, d):
    b = bars(spark, d)
    return cal.snapped(cal.month_anchor(b, 15), cal.sessions(b.where("code = 'AF'")), "next").select("target_date", "session")


@query("j03_snap_prev", _SNAP.format(b=BARS, f="max", op="<="))
def j03b(spark, d):
    b = bars(spark, d)
    return cal.snapped(cal.month_anchor(b, 15), cal.sessions(b.where("code = 'AF'")), "prev").select("target_date", "session")


@query("j07_anti", "SELECT count(*) AS parts_without_trades FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def j07(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(li.hint("merge"), "p_partkey", "left_anti").agg(F.count("*").alias("parts_without_trades"))


@query("j08_dimensions", "SELECT r_name, p_type, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL", "qty")
def j08(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    li = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))
    out = li.join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return out.groupBy("r_name", "p_type").agg(F.sum("n").alias("n"), F.sum("qty").alias("qty"))


@query("j12_set_operations", f"""WITH {BARS}, a AS (SELECT trade_date FROM bars WHERE code = 'AF'), b AS (SELECT trade_date FROM bars WHERE code = 'RO')
  SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def j12(spark, d):
    x = bars(spark, d)
    a, b = x.where("code = 'AF'").select("trade_date"), x.where("code = 'RO'").select("trade_date")
    n = lambda op, df: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n("union", a.union(b).distinct()).unionByName(n("intersect", a.intersect(b))).unionByName(n("except", a.subtract(b)))


@query("q02_top_per_code", f"WITH {BARS} SELECT code, trade_date, amount FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY amount DESC, trade_date) <= 5", "amount")
def q02(spark, d):
    w = Window.partitionBy("code").orderBy(F.desc("amount"), "trade_date")
    return bars(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 5").select("code", "trade_date", "amount")


@query("q04_grouping_sets", f"WITH {TRADES} SELECT side, year(trade_date) AS y, count(*) AS n, sum(quantity) AS qty FROM trades GROUP BY GROUPING SETS ((side, year(trade_date)), (side), ())", "qty")
def q04(spark, d):
    t = trades(spark, d).withColumn("y", F.year("trade_date").cast("long"))
    return t.groupingSets([["side", "y"], ["side"], []], "side", "y").agg(F.count("*").alias("n"), F.sum("quantity").alias("qty"))


@query("q05_pivot", f"WITH {BARS} SELECT trade_date, {', '.join(f'max(close) FILTER (code = {chr(39)}{c}{chr(39)}) AS {c}' for c in ('AF', 'NO', 'RO'))} FROM bars WHERE code IN ('AF', 'NO', 'RO') GROUP BY trade_date", "AF NO RO")
def q05(spark, d):
    return bars(spark, d).groupBy("trade_date").pivot("code", ["AF", "NO", "RO"]).agg(F.max("close")).where("AF IS NOT NULL OR NO IS NOT NULL OR RO IS NOT NULL")


@query("q06_named_aggregation", f"WITH {BARS} SELECT code, year(trade_date) AS y, count(close) AS n, sum(close) AS total, avg(close) AS mean, min(close) AS low, max(close) AS high, stddev_samp(close) AS sd FROM bars GROUP BY ALL", "total mean low high sd")
def q06(spark, d):
    return bars(spark, d).groupBy("code", F.year("trade_date").cast("long").alias("y")).agg(F.count("close").alias("n"), F.sum("close").alias("total"), F.avg("close").alias("mean"), F.min("close").alias("low"), F.max("close").alias("high"), F.stddev_samp("close").alias("sd"))


@query("q07_json", "SELECT event_type, (json_extract_string(props, '$.k')::BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def q07(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type", (k % 10).alias("k")).agg(F.count("*").alias("n"))


@query("t08_runs_of_sign", f"""WITH {BARS}, s AS (SELECT code, trade_date, close / lag(close) OVER w - 1 AS r FROM bars {W}), u AS (SELECT *, sign(r)::INT AS sg FROM s WHERE r IS NOT NULL), c AS (SELECT *, (sg IS DISTINCT FROM lag(sg) OVER w)::INT AS ch FROM u {W}), g AS (SELECT *, sum(ch) OVER w AS run FROM c {W})
  SELECT code, run::BIGINT AS run, any_value(sg) AS sg, count(*) AS n, product(1 + r) - 1 AS total FROM g GROUP BY code, run""", "total")
def t08(spark, d):
    x = bars(spark, d).withColumn("r", F.col("close") / F.lag("close").over(series()) - 1).where("r IS NOT NULL").withColumn("sg", F.signum("r").cast("int"))
    g = x.withColumn("run", run_id(F.col("sg"), series()))
    return g.groupBy("code", "run").agg(F.first("sg").alias("sg"), F.count("*").alias("n"), (F.product(1 + F.col("r")) - 1).alias("total"))
