"""Queries R and Z: tests, resampling, sweeps, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.frames import roll, series
from panelforge.functions.tails import erfc_sql
from panelforge.operators import indicators as ind
from panelforge.operators import studies as st
from panelforge.operators.draws import many_bits_sql, many_draws_sql, uniform_sql
from panelforge.operators.permutation import stratified_p
from panelforge.plans.indicators_queries import RET, W, eliminated, frame
from panelforge.plans.registry import query
from panelforge.plans.views import BARS, bars, table
from panelforge.streaming import feeds

MKT = f"{RET}, mk AS (SELECT *, avg(r) OVER (PARTITION BY trade_date) AS m FROM r WHERE r IS NOT NULL)"


def with_market(spark, d):
    return ind.with_returns(bars(spark, d)).where("r IS NOT NULL").withColumn("m", F.avg("r").over(Window.partitionBy("trade_date")))


LL = f"{MKT}, n AS (SELECT *, row_number() OVER w AS rn FROM mk {W}), ll AS (SELECT a.code, k AS lag, count(*) AS n, corr(a.r, b.m) AS corr FROM n a CROSS JOIN range(-5, 6) t(k) JOIN n b ON a.code = b.code AND b.rn = a.rn + k GROUP BY a.code, k)"


@query("r01_lead_lag", f"WITH {LL} SELECT code, lag::INT AS lag, n, corr FROM ll", "corr")
def r01(spark, d):
    return st.lead_lag(with_market(spark, d), "r", "m", 5, ("code",))


@query("r01_best_lag", f"WITH {LL} SELECT code, lag::INT AS lag, n, corr, CASE WHEN lag > 0 THEN 'leads' WHEN lag < 0 THEN 'lags' ELSE 'together' END AS relation FROM ll QUALIFY row_number() OVER (PARTITION BY code ORDER BY abs(corr) DESC, abs(lag), lag) = 1", "corr")
def r01b(spark, d):
    return st.best_lag(st.lead_lag(with_market(spark, d), "r", "m", 5, ("code",)), ("code",))


def granger_sql(p: int) -> str:
    """Gram sums of y, its lags and x's lags; what is left of yy after the own lags and after all gives F."""
    names = ["1.0", *[f"y{k}" for k in range(1, p + 1)], *[f"x{k}" for k in range(1, p + 1)], "r"]
    m = len(names) - 1
    steps, (rss0, rss1) = eliminated("gs", "code, n", [[f"s_{min(i, j)}_{max(i, j)}" for j in range(m + 1)] for i in range(m + 1)], [p + 1, m])
    lags = ", ".join([f"lag(r, {k}) OVER w AS y{k}" for k in range(1, p + 1)] + [f"lag(m, {k}) OVER w AS x{k}" for k in range(1, p + 1)])
    sums = ", ".join(f"sum({names[i]} * {names[j]}) AS s_{i}_{j}" for i in range(m + 1) for j in range(i, m + 1))
    have = " AND ".join(f"{c} IS NOT NULL" for c in names[1:])
    return f"WITH {MKT}, lg AS (SELECT code, r, {lags} FROM mk {W}), gs AS (SELECT code, count(*) AS n, {sums} FROM lg WHERE {have} GROUP BY code), {steps} SELECT code, n, (({rss0} - {rss1}) / {p}) / ({rss1} / (n - {m})) AS f FROM g{m}"


@query("r02_granger", granger_sql(3), "f")
def r02(spark, d):
    return st.granger(with_market(spark, d), "m", "r", 3, ("code",))


def events(spark, d):
    b = bars(spark, d)
    up = F.col("close") > 1.3 * F.avg("close").over(roll(series(), 20))
    return st.event_returns(b.withColumn("up", up), F.col("up"), 5)


@query("r04_event_returns", f"WITH {BARS}, e AS (SELECT *, close > 1.3 * avg(close) OVER {frame(20)} AS up, lead(close, 5) OVER w / close - 1 AS fwd FROM bars {W}) SELECT code, trade_date, fwd FROM e WHERE up AND fwd IS NOT NULL", "fwd")
def r04(spark, d):
    return events(spark, d).select("code", "trade_date", "fwd")


TRIALS, FLIPS, SIMS = 1000, 1000, 2000


@query("r04_event_study", f"""WITH {BARS}, e AS (SELECT *, close > 1.3 * avg(close) OVER {frame(20)} AS up, lead(close, 5) OVER w / close - 1 AS fwd FROM bars {W}), po AS (SELECT code, trade_date, fwd FROM e WHERE fwd IS NOT NULL), re AS (SELECT code, count(*) AS n, avg(fwd) AS mean, avg((fwd > 0)::INT) AS win_rate FROM e WHERE up AND fwd IS NOT NULL GROUP BY code),
  dr AS (SELECT po.code, trial, fwd, n, mean, row_number() OVER (PARTITION BY po.code, trial ORDER BY {many_draws_sql('trial', 5, 'po.code', 'trade_date')}, trade_date) AS k FROM po JOIN re ON po.code = re.code, range(0, {TRIALS}) t(trial)), me AS (SELECT code, trial, avg(fwd) AS m, any_value(mean) AS mean FROM dr WHERE k <= n GROUP BY code, trial),
  pv AS (SELECT code, (sum((m >= mean)::INT) + 1) / (count(*) + 1) AS p FROM me GROUP BY code) SELECT re.code, n, mean, win_rate, p FROM re JOIN pv ON re.code = pv.code""", "mean win_rate p")
def r04s(spark, d):
    pool = bars(spark, d).withColumn("fwd", F.lead("close", 5).over(series()) / F.col("close") - 1).where("fwd IS NOT NULL")
    return st.event_study(events(spark, d), pool, TRIALS)


def bootstrap_sql(source: str, sims: int, keys: str = "code", draw: str = "code") -> str:
    """Paths (keys, sim, t, x) of circular blocks of 20 over rows (keys, trade_date, x) as a CTE, `path`."""
    part = f"PARTITION BY {keys}"
    return f"""bn AS (SELECT {keys}, x, row_number() OVER ({part} ORDER BY trade_date) - 1 AS place, count(*) OVER ({part}) AS n FROM {source} WHERE x IS NOT NULL), bz AS (SELECT DISTINCT {keys}, n FROM bn),
      bs AS (SELECT {keys}, n, sim, b, floor({uniform_sql(9, *draw.split(', '), 'sim', 'b')} * n)::BIGINT AS s FROM bz, range(1, {sims + 1}) q(sim), LATERAL (SELECT unnest(range(0, (n - 1) // 20 + 1)) AS b)),
      bp AS (SELECT *, b * 20 + o AS t, (s + o) % n AS place FROM bs, range(0, 20) z(o) WHERE b * 20 + o < n), path AS (SELECT bp.*, bn.x FROM bp JOIN bn USING ({keys}, place))"""


@query("r05_block_bootstrap", f"""WITH {RET}, sr AS (SELECT code, trade_date, r / 1000 AS x FROM r), {bootstrap_sql('sr', SIMS)}, si AS (SELECT code, sim, product(1 + x) - 1 AS total FROM path GROUP BY code, sim)
  SELECT code, quantile_cont(total, 0.05) AS p05, quantile_cont(total, 0.5) AS p50, quantile_cont(total, 0.95) AS p95, avg((total <= 0)::INT) AS p_below_zero, count(*) AS sims FROM si GROUP BY code""", "p05 p50 p95 p_below_zero")
def r05(spark, d):
    r = ind.with_returns(bars(spark, d)).withColumn("r", F.col("r") / 1000)
    return st.bootstrap_summary(st.block_bootstrap(r, "r", SIMS, 20), "total")


@query("r05_bootstrap_paths", f"""WITH {RET}, sr AS (SELECT code, trade_date, r / 1000 AS x FROM r), {bootstrap_sql('sr', 50)}, nv AS (SELECT code, sim, t, x, product(1 + x) OVER w AS nav FROM path WINDOW w AS (PARTITION BY code, sim ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  dd AS (SELECT *, nav / greatest(1, max(nav) OVER (PARTITION BY code, sim ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS dd FROM nv) SELECT code, sim::INT AS sim, arg_max(nav, t) - 1 AS total, stddev_samp(x) * sqrt(252) AS vol, min(dd) AS max_drawdown FROM dd GROUP BY code, sim""", "total vol max_drawdown")
def r05p(spark, d):
    return st.block_bootstrap(ind.with_returns(bars(spark, d)).withColumn("r", F.col("r") / 1000), "r", 50, 20)


@query("r06_normal_fit", f"""WITH {RET}, g AS (SELECT code, count(lr) AS n, avg(lr) AS mu, stddev_pop(lr) AS sigma FROM r GROUP BY code), z AS (SELECT r.code, avg(pow((lr - mu) / sigma, 3)) AS skew, avg(pow((lr - mu) / sigma, 4)) - 3 AS kurtosis FROM r JOIN g ON r.code = g.code WHERE lr IS NOT NULL GROUP BY r.code)
  SELECT g.code, n, mu, sigma, skew, kurtosis, -n / 2.0 * (ln(2 * pi()) + 2 * ln(sigma) + 1) AS log_likelihood, 2 * ln(n) + n * (ln(2 * pi()) + 2 * ln(sigma) + 1) AS bic FROM g JOIN z ON g.code = z.code""", "mu sigma skew kurtosis log_likelihood bic")
def r06(spark, d):
    return st.normal_fit(ind.with_returns(bars(spark, d)), "lr")


CDF = lambda z: f"(CASE WHEN {z} > 0 THEN 1 - {erfc_sql(f'abs({z}) * sqrt(0.5)')} / 2 ELSE {erfc_sql(f'abs({z}) * sqrt(0.5)')} / 2 END)"


@query("r06_normality", f"""WITH {RET}, z AS (SELECT code, (lr - avg(lr) OVER (PARTITION BY code)) / stddev_samp(lr) OVER (PARTITION BY code) AS z FROM r WHERE lr IS NOT NULL), f AS (SELECT code, row_number() OVER (PARTITION BY code ORDER BY z) AS i, count(*) OVER (PARTITION BY code) AS n, {CDF('z')} AS f, {CDF('-z')} AS u FROM z)
  SELECT code, count(*) AS n, max(greatest(i / n - f, f - (i - 1) / n)) AS ks, -count(*) - sum((2 * i - 1) * ln(f) + (2 * (n - i) + 1) * ln(u)) / count(*) AS ad FROM f GROUP BY code""", "ks ad")
def r06n(spark, d):
    """Kolmogorov-Smirnov and Anderson-Darling statistics of log returns."""
    return st.normality(ind.with_returns(bars(spark, d)), "lr")


@query("r08_sign_flip", f"""WITH {MKT}, df AS (SELECT code, trade_date, round(r - m, 12) AS d FROM mk), re AS (SELECT code, count(*) AS n, avg(d) AS mean FROM df GROUP BY code), fl AS (SELECT code, trial, avg(CASE WHEN {many_bits_sql('trial', 3, 'trade_date')} = 1 THEN -d ELSE d END) AS m FROM df, range(0, {FLIPS}) t(trial) GROUP BY code, trial),
  pv AS (SELECT re.code, (sum((abs(m) >= abs(mean))::INT) + 1) / (count(*) + 1) AS p FROM fl JOIN re ON fl.code = re.code GROUP BY re.code), rk AS (SELECT code, d, rank() OVER (PARTITION BY code ORDER BY abs(d)) + (count(*) OVER (PARTITION BY code, abs(d)) - 1) / 2 AS rk FROM df WHERE d <> 0),
  pl AS (SELECT code, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS rank_sum FROM rk GROUP BY code) SELECT re.code, n, mean, p, rank_sum FROM re JOIN pv ON re.code = pv.code JOIN pl ON re.code = pl.code""", "mean p rank_sum")
def r08(spark, d):
    return st.sign_flip(with_market(spark, d).withColumn("diff", F.round(F.col("r") - F.col("m"), 12)), "diff", "trade_date", FLIPS)


@query("t07_market_conditions", f"""WITH {MKT}, x AS (SELECT *, close > avg(close) OVER {frame(20)} AS f, lead(r) OVER w AS y FROM mk {W}), g AS (SELECT code, count(y) FILTER (f) AS n_in, count(y) FILTER (NOT f) AS n_out, avg((y > 0)::INT) FILTER (f) AS win_in, avg((y > 0)::INT) FILTER (NOT f) AS win_out, avg(y) FILTER (f) AS mean_in, avg(y) FILTER (NOT f) AS mean_out, var_samp(y) FILTER (f) AS vi, var_samp(y) FILTER (NOT f) AS vo FROM x WHERE y IS NOT NULL GROUP BY code),
  p AS (SELECT *, (win_in * n_in + win_out * n_out) / (n_in + n_out) AS pl FROM g) SELECT code, n_in, n_out, win_in, win_out, mean_in, mean_out, (win_in - win_out) / sqrt(pl * (1 - pl) * (1.0 / n_in + 1.0 / n_out)) AS z, (mean_in - mean_out) / sqrt(vi / n_in + vo / n_out) AS t FROM p""", "win_in win_out mean_in mean_out z t")
def t07m(spark, d):
    x = with_market(spark, d).withColumn("f", F.col("close") > F.avg("close").over(roll(series(), 20))).withColumn("y", F.lead("r").over(series()))
    return st.two_samples(x, "y", F.col("f"), ("code",))


@query("r09_stratified_permutation", f"""WITH {MKT}, x AS (SELECT *, year(trade_date) AS y, close > avg(close) OVER {frame(20)} AS f, lead(r) OVER w AS v FROM mk {W}), o AS (SELECT * FROM x WHERE v IS NOT NULL), k AS (SELECT code, y, count(*) FILTER (f) AS k FROM o GROUP BY code, y),
  re AS (SELECT code, count(*) FILTER (f) AS n_in, count(*) FILTER (NOT f) AS n_out, sum(v) AS a, avg(v) FILTER (f) - avg(v) FILTER (NOT f) AS diff FROM o GROUP BY code),
  dr AS (SELECT o.code, o.y, trial, v, row_number() OVER (PARTITION BY o.code, o.y, trial ORDER BY {many_draws_sql('trial', 7, 'o.code', 'o.y', 'trade_date')}, trade_date) AS rn FROM o, range(0, {FLIPS}) t(trial)),
  su AS (SELECT dr.code, trial, sum(v) AS s FROM dr JOIN k ON dr.code = k.code AND dr.y = k.y WHERE rn <= k GROUP BY dr.code, trial)
  SELECT re.code, any_value(n_in) AS n_in, any_value(n_out) AS n_out, any_value(diff) AS diff, (sum((abs(s / n_in - (a - s) / n_out) >= abs(diff) - 1e-12)::INT) + 1) / ({FLIPS} + 1) AS p FROM su JOIN re ON su.code = re.code GROUP BY re.code""", "diff p")
def r09(spark, d):
    """Next day's return above and below the moving average, labels shuffled within years."""
    x = with_market(spark, d).withColumn("f", F.col("close") > F.avg("close").over(roll(series(), 20))).withColumn("v", F.lead("r").over(series())).withColumn("y", F.year("trade_date"))
    return stratified_p(x, "v", "f", "y", "trade_date", FLIPS)


@query("r10_style_exposure")
def r10(spark, d):
    r = with_market(spark, d)
    piv = r.where("code IN ('AF', 'NO', 'RO')").groupBy("trade_date").pivot("code", ["AF", "NO", "RO"]).agg(F.first("r"))
    return st.style_exposure(r.join(piv.hint("merge"), "trade_date"), "m", ["AF", "NO", "RO"], 120).select("code", "trade_date", F.round(F.get("exposure", 0), 6).alias("af"), F.round(F.get("exposure", 1), 6).alias("no"), F.round(F.get("exposure", 2), 6).alias("ro"), "r2")


LOOKBACKS, EXITS = [5, 10, 20, 40, 60], [-0.1, 0.0, 0.05]


@query("r14_parameter_sweep", f"""WITH {RET}, g AS (SELECT r.*, n AS lookback, x AS "exit", close / lag(close, n) OVER (PARTITION BY n, x, code ORDER BY trade_date) - 1 AS mom FROM r, (SELECT unnest([5, 10, 20, 40, 60]) AS n), (SELECT unnest([-0.1, 0.0, 0.05]::DOUBLE[]) AS x)),
  p AS (SELECT *, coalesce(last_value(CASE WHEN mom > 0.1 THEN 1 WHEN mom IS NULL OR mom <= "exit" THEN 0 END IGNORE NULLS) OVER v, 0) AS pos FROM g WINDOW v AS (PARTITION BY lookback, "exit", code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  q AS (SELECT *, coalesce(lag(pos) OVER v, 0) * coalesce(r, 0) AS x2 FROM p WINDOW v AS (PARTITION BY lookback, "exit", code ORDER BY trade_date)) SELECT lookback, "exit", code, avg(x2) AS mean, sum(pos)::BIGINT AS days, avg(x2) / stddev_samp(x2) * sqrt(252) AS sharpe FROM q GROUP BY lookback, "exit", code""", "mean sharpe")
def r14(spark, d):
    return st.sweep(ind.with_returns(bars(spark, d)), LOOKBACKS, EXITS)


@query("r13_walk_forward", f"""WITH {RET}, g AS (SELECT code, n AS param, trade_date, CASE WHEN close > avg(close) OVER (PARTITION BY n, code ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) * (1 + n / 100.0) THEN 1 ELSE 0 END AS pos, r FROM r, range(0, 50, 10) t(n)),
  x AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY param, code ORDER BY trade_date), 0) * coalesce(r, 0) AS x FROM g), y AS (SELECT param, year(trade_date) AS year, avg(x) AS score FROM x GROUP BY 1, 2), t AS (SELECT param, year, lag(score) OVER (PARTITION BY param ORDER BY year) AS train, score AS test FROM y)
  SELECT param::INT AS param, year, train, test FROM t WHERE train IS NOT NULL QUALIFY row_number() OVER (PARTITION BY year ORDER BY train DESC, param) = 1""", "train test")
def r13(spark, d):
    g = ind.with_returns(bars(spark, d)).withColumn("param", F.explode(F.sequence(F.lit(0), F.lit(40), F.lit(10))))
    w = series(("param", "code"))
    g = g.withColumn("pos", F.when(F.col("close") > F.avg("close").over(roll(w, 60)) * (1 + F.col("param") / 100), 1).otherwise(0))
    g = g.withColumn("x", F.coalesce(F.lag("pos").over(w), F.lit(0)) * F.coalesce("r", F.lit(0.0)))
    y = g.groupBy("param", F.year("trade_date").cast("long").alias("year")).agg(F.avg("x").alias("test"))
    y = y.withColumn("train", F.lag("test").over(Window.partitionBy("param").orderBy("year")))
    return st.walk_forward(y).select("param", "year", "train", "test")


@query("z02_event_bars", "SELECT event_type AS code, time_bucket(INTERVAL 1 HOUR, ts) AS start, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS n FROM events GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY event_type, time_bucket(INTERVAL 1 HOUR, ts)"), "open high low close")
def z02(spark, d):
    return feeds.tick_bars(table(spark, d, "events"))
