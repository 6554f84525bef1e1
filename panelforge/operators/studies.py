"""Statistical tests, resampling and parameter sweeps; draws come from hashes, so reruns agree."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.frames import series
from panelforge.functions.tails import normal_cdf, normal_two_sided
from panelforge.operators.draws import uniform
from panelforge.operators.permutation import flip_sums, subset_sums


def lead_lag(df: DataFrame, x: str, y: str, lags: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, lag, n, corr): correlation of x with y `lag` rows later, for lags -L..L, over one sort of each series."""
    w = series(keys)
    steps = range(-lags, lags + 1)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), *[F.lead(y, k).over(w).alias(f"_y{k + lags}") for k in steps])
    g = rows.groupBy(*keys).agg(*[f(k) for k in range(2 * lags + 1) for f in (lambda k: F.count(f"_y{k}").alias(f"_n{k}"), lambda k: F.corr("_x", f"_y{k}").alias(f"_c{k}"))])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_n{k + lags}").alias("n"), F.col(f"_c{k + lags}").alias("corr")) for k in steps])
    return g.select(*keys, F.explode(cells).alias("_l")).select(*keys, "_l.*").where("n > 0")


def best_lag(table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("corr")), F.abs("lag"), "lag")
    best = table.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return best.withColumn("relation", F.when(F.col("lag") > 0, "leads").when(F.col("lag") < 0, "lags").otherwise("together"))


def granger(df: DataFrame, x: str, y: str, p: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, n, f): does x add to y's own lags? Gram sums per key in Spark, small systems solved in numpy."""
    w = series(keys)
    names = ["one"] + [f"y{k}" for k in range(1, p + 1)] + [f"x{k}" for k in range(1, p + 1)]
    cols = {"one": F.lit(1.0)} | {f"y{k}": F.lag(y, k).over(w) for k in range(1, p + 1)} | {f"x{k}": F.lag(x, k).over(w) for k in range(1, p + 1)}
    rows = df.withColumns(cols).dropna(subset=[y, *names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("gram"), F.array(*[F.sum(F.col(a) * F.col(y)) for a in names]).alias("xy"))
    m, n_keys = len(names), len(keys)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.triu_indices(m)
        for b in batches:
            out = []
            for i in range(b.num_rows):
                g = np.zeros((m, m))
                g[at] = b.column(n_keys + 2)[i].as_py()
                g = g + g.T - np.diag(g.diagonal())
                v, n, yy = np.array(b.column(n_keys + 3)[i].as_py()), b.column(n_keys)[i].as_py(), b.column(n_keys + 1)[i].as_py()
                rss = [yy - v[:k] @ np.linalg.lstsq(g[:k, :k], v[:k], rcond=None)[0] for k in (p + 1, m)]
                out.append(((rss[0] - rss[1]) / p) / (rss[1] / (n - m)) if n > m and rss[1] > 1e-12 else None)
            yield pa.RecordBatch.from_arrays([*b.columns[: n_keys + 1], pa.array(out, pa.float64())], [*keys, "n", "f"])

    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return sums.select(*keys, "n", "yy", "gram", "xy").mapInArrow(solve, f"{types}, n long, f double")


def event_returns(df: DataFrame, event: Column, horizon: int, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """Events with the return of the `horizon` rows after them."""
    w = series(keys)
    df = df.withColumn("_e", event).withColumn("fwd", F.try_divide(F.lead("close", horizon).over(w), F.col("close")) - 1)
    return df.where(F.col("_e") & F.col("fwd").isNotNull()).drop("_e")


def event_study(events: DataFrame, pool: DataFrame, trials: int, seed: int = 5, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """Mean and win rate of events' fwd, and p: the share of draws of exactly as many dates of the pool with a mean as large.

    A draw is the n dates with the smallest hashes (see permutation.subset_sums).
    """
    real = events.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("fwd").alias("mean"), F.avg((F.col("fwd") > 0).cast("int")).alias("win_rate"))
    drawn = subset_sums(pool, real.select(*keys, F.col("n").alias("k")), "fwd", "trade_date", trials, seed, keys)
    met = drawn.join(real.hint("merge"), list(keys))
    p = met.groupBy(*keys).agg(((F.sum((F.col("total") / F.col("n") >= F.col("mean")).cast("int")) + 1) / (F.count("*") + 1)).alias("p"))
    return real.join(p.hint("merge"), list(keys))


def _block(values: Column) -> Column:
    """What a path needs to know of a block of returns: value at its end, lowest and highest value, worst fall inside, sums."""
    start = F.struct(*[F.lit(x).alias(n) for n, x in (("nav", 1.0), ("low", math.inf), ("high", -math.inf), ("worst", 0.0), ("s1", 0.0), ("s2", 0.0))])

    def step(acc: Column, r: Column) -> Column:
        nav = acc["nav"] * (1 + r)
        high = F.greatest(acc["high"], nav)
        return F.struct(nav.alias("nav"), F.least(acc["low"], nav).alias("low"), high.alias("high"), F.least(acc["worst"], nav / high - 1).alias("worst"), (acc["s1"] + r).alias("s1"), (acc["s2"] + r * r).alias("s2"))

    return F.aggregate(values, start, step)


def block_bootstrap(df: DataFrame, r: str, sims: int, block: int, seed: int = 9, keys: tuple[str, ...] = ("code",), draw: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, sim, total, vol, max_drawdown) of circular blocks with hashed starts.

    The starts depend on `draw` (by default the keys) alone: variants of one
    series among the keys meet the same resamples. Each place is summed up once
    as the block that starts there; a path is a fold over its blocks, so work is
    series + sims x blocks, not sims x rows.
    """
    own = Window.partitionBy(*keys)
    rows = df.where(F.col(r).isNotNull()).withColumn("_at", F.row_number().over(own.orderBy("trade_date")) - 1).withColumn("_n", F.count("*").over(own)).select(*keys, *[k for k in draw or () if k not in keys], "_at", "_n", F.col(r).alias("_r"))
    around = rows.withColumn("_at", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.floor((block - 1) / F.col("_n")).cast("int") + 1), lambda k: F.col("_at") + k * F.col("_n")), lambda at: at < F.col("_n") + block - 1)))
    ahead = F.collect_list("_r").over(Window.partitionBy(*keys).orderBy("_at").rowsBetween(0, block - 1))
    starts = around.withColumn("_v", ahead).where("_at < _n").select(*keys, "_at", _block(F.col("_v")).alias("_full"), _block(F.slice("_v", 1, F.pmod(F.col("_n"), F.lit(block)))).alias("_part"))
    size = rows.groupBy(*dict.fromkeys([*keys, *(draw or ())])).agg(F.count("*").alias("_n"))
    blocks = size.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(sims)))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / block).cast("int"))))
    blocks = blocks.withColumn("_at", F.floor(uniform(seed, *(draw or keys), "sim", "_b") * F.col("_n")).cast("int"))
    part = (F.col("_b") + 1) * block > F.col("_n")
    met = blocks.join(starts.hint("merge"), [*keys, "_at"]).select(*keys, "sim", "_n", F.struct("_b", F.when(part, F.col("_part")).otherwise(F.col("_full")).alias("x")).alias("_x"))
    paths = met.groupBy(*keys, "sim", "_n").agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    begin = F.struct(*[F.lit(x).alias(n) for n, x in (("nav", 1.0), ("peak", 1.0), ("worst", 0.0), ("s1", 0.0), ("s2", 0.0))])

    def fold(acc: Column, item: Column) -> Column:
        x = item["x"]
        worst = F.least(acc["worst"], x["worst"], acc["nav"] * x["low"] / acc["peak"] - 1)
        return F.struct((acc["nav"] * x["nav"]).alias("nav"), F.greatest(acc["peak"], acc["nav"] * x["high"]).alias("peak"), worst.alias("worst"), (acc["s1"] + x["s1"]).alias("s1"), (acc["s2"] + x["s2"]).alias("s2"))

    end = paths.withColumn("_e", F.aggregate("_x", begin, fold))
    var = F.when(F.col("_n") > 1, F.greatest(F.lit(0.0), F.col("_e.s2") - F.col("_e.s1") * F.col("_e.s1") / F.col("_n")) / (F.col("_n") - 1))
    return end.select(*keys, "sim", (F.col("_e.nav") - 1).alias("total"), (F.sqrt(var) * math.sqrt(252)).alias("vol"), F.col("_e.worst").alias("max_drawdown"))


def bootstrap_summary(sims: DataFrame, metric: str, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    q = F.percentile(metric, [0.05, 0.5, 0.95])
    g = sims.groupBy(*keys).agg(q.alias("_q"), F.avg((F.col(metric) <= 0).cast("int")).alias("p_below_zero"), F.count("*").alias("sims"))
    return g.select(*keys, F.get("_q", 0).alias("p05"), F.get("_q", 1).alias("p50"), F.get("_q", 2).alias("p95"), "p_below_zero", "sims")


def normal_fit(df: DataFrame, x: str, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """Moments, log-likelihood and BIC of a normal law."""
    g = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mu"), F.stddev_pop(x).alias("sigma"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"))
    ll = -F.col("n") / 2 * (math.log(2 * math.pi) + 2 * F.ln("sigma") + 1)
    return g.withColumn("log_likelihood", ll).withColumn("bic", 2 * F.ln("n") - 2 * F.col("log_likelihood"))


def normality(df: DataFrame, x: str, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """(keys, n, ks, ad): distance of a series from the normal law with its own mean and deviation.

    ks is the largest gap between both distribution functions (Kolmogorov and
    Smirnov), ad weighs the tails (Anderson and Darling). One sort a series.
    """
    own, up = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_z")
    rows = df.where(F.col(x).isNotNull()).select(*keys, F.try_divide(F.col(x) - F.avg(x).over(own), F.stddev_samp(x).over(own)).alias("_z")).where("_z IS NOT NULL")
    rows = rows.select(*keys, F.row_number().over(up).alias("_i"), F.count("*").over(own).alias("_n"), normal_cdf(F.col("_z")).alias("_f"), normal_cdf(-F.col("_z")).alias("_u"))
    gap = F.greatest(F.col("_i") / F.col("_n") - F.col("_f"), F.col("_f") - (F.col("_i") - 1) / F.col("_n"))
    # the i-th value from below has weight 2 i - 1 below and 2 (n - i) + 1 above
    term = (2 * F.col("_i") - 1) * F.ln("_f") + (2 * (F.col("_n") - F.col("_i")) + 1) * F.ln("_u")
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(gap).alias("ks"), F.sum(term).alias("_s"))
    return g.select(*keys, "n", "ks", (-F.col("n") - F.col("_s") / F.col("n")).alias("ad"))


def sign_flip(df: DataFrame, d: str, unit: str, trials: int, seed: int = 3, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """Paired differences: mean, sign-flip permutation p, signed-rank sum."""
    rows = df.where(F.col(d).isNotNull())
    real = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("mean"))
    met = flip_sums(rows, d, unit, trials, seed, keys).join(real.hint("merge"), list(keys)).withColumn("_m", F.col("total") / F.col("n"))
    p = met.groupBy(*keys).agg(((F.sum((F.abs("_m") >= F.abs("mean")).cast("int")) + 1) / (F.count("*") + 1)).alias("p"))
    w = Window.partitionBy(*keys).orderBy("_abs")
    nz = rows.where(F.col(d) != 0).withColumn("_abs", F.abs(F.col(d)))
    ranked = nz.withColumn("_rank", F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, "_abs")) - 1) / 2)
    plus = ranked.groupBy(*keys).agg(F.sum(F.when(F.col(d) > 0, F.col("_rank")).otherwise(0.0)).alias("rank_sum"))
    return real.join(p.hint("merge"), list(keys)).join(plus.hint("merge"), list(keys))


def two_samples(df: DataFrame, x: str, flag: Column, keys: tuple[str, ...]) -> DataFrame:
    """Rows inside and outside a condition: counts, win rates, means, two-proportion z, Welch t."""
    inside, out = F.when(flag, F.col(x)), F.when(~flag, F.col(x))
    g = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(
        F.count(inside).alias("n_in"), F.count(out).alias("n_out"), F.avg((inside > 0).cast("int")).alias("win_in"), F.avg((out > 0).cast("int")).alias("win_out"),
        F.avg(inside).alias("mean_in"), F.avg(out).alias("mean_out"), F.var_samp(inside).alias("_vi"), F.var_samp(out).alias("_vo"),
    )
    pool = (F.coalesce("win_in", F.lit(0.0)) * F.col("n_in") + F.coalesce("win_out", F.lit(0.0)) * F.col("n_out")) / (F.col("n_in") + F.col("n_out"))
    z = F.try_divide(F.col("win_in") - F.col("win_out"), F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), F.col("n_in")) + F.try_divide(F.lit(1.0), F.col("n_out")))))
    t = F.try_divide(F.col("mean_in") - F.col("mean_out"), F.sqrt(F.try_divide(F.col("_vi"), F.col("n_in")) + F.try_divide(F.col("_vo"), F.col("n_out"))))
    return g.withColumn("z", z).withColumn("t", t).drop("_vi", "_vo")


def normal_p(z: str) -> Column:
    """Two-sided tail of the normal law."""
    return normal_two_sided(F.col(z))


def benjamini_hochberg(df: DataFrame, p: str, keys: tuple[str, ...] = (), count_untested: bool = False) -> DataFrame:
    """q-values: the smallest p * n / rank among ranks from the row's on. A family (keys; without keys all rows) has one row a hypothesis and is sorted in one task.

    n counts the hypotheses that have a p; one without has no q. With
    count_untested those without count and come first, with the q of the rest.
    """
    fam = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    order, n = (F.asc_nulls_first(p), F.count("*")) if count_untested else (F.asc_nulls_last(p), F.count(p))
    df = df.withColumn("_k", F.row_number().over(fam.orderBy(order))).withColumn("_q", F.col(p) * n.over(fam) / F.col("_k"))
    q = F.least(F.lit(1.0), F.min("_q").over(fam.orderBy("_k").rowsBetween(0, Window.unboundedFollowing)))
    return df.withColumn("q", q if count_untested else F.when(F.col(p).isNotNull(), q)).drop("_k", "_q")


def sweep(panel: DataFrame, lookbacks: list[int], exits: list[float], r: str = "r") -> DataFrame:
    """(lookback, exit, code, ...): trend rules over a whole grid as rows of one job.

    The trailing return of every lookback is one projection over one sort; the grid is
    exploded after it, so the panel is sorted once for all variants.
    """
    w = series()
    moms = F.array(*[F.struct(F.lit(n).alias("lookback"), (F.try_divide(F.col("close"), F.lag("close", n).over(w)) - 1).alias("mom")) for n in lookbacks])
    rows = panel.withColumn("_m", moms).select("code", "trade_date", r, F.explode("_m").alias("_m")).select("code", "trade_date", r, "_m.*")
    rows = rows.withColumn("exit", F.explode(F.array(*[F.lit(x) for x in exits])))
    v = Window.partitionBy("lookback", "exit", "code").orderBy("trade_date")
    pos = F.coalesce(F.last(F.when(F.col("mom") > 0.1, 1).when(F.col("mom").isNull() | (F.col("mom") <= F.col("exit")), 0), True).over(v.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = rows.withColumn("pos", pos).withColumn("x", F.coalesce(F.lag("pos").over(v), F.lit(0)) * F.coalesce(F.col(r), F.lit(0.0)))
    g = rows.groupBy("lookback", "exit", "code").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.sum("pos").alias("days"))
    return g.withColumn("sharpe", F.when(F.col("sd") > 1e-12, F.col("mean") / F.col("sd") * math.sqrt(252))).drop("sd")


def walk_forward(rows: DataFrame, by: str = "year") -> DataFrame:
    """Scores (param, year, train, test): the best parameter of each training year and what it earned in the test year."""
    w = Window.partitionBy(by).orderBy(F.desc("train"), "param")
    return rows.where(F.col("train").isNotNull()).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def style_exposure(df: DataFrame, y: str, factors: list[str], n: int, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """Rolling exposures of y to at most four factors, none below zero, sum at most one, with R squared.

    Gram sums come from windows; the supports of so few factors are enumerated in numpy, batch by batch.
    """
    if len(factors) > 4:
        raise ValueError("at most four factors")
    f = series(keys).rowsBetween(-(n - 1), 0)
    m = len(factors)
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i:]]
    sums = [F.covar_pop(a, b).over(f) for a, b in pairs] + [F.covar_pop(a, y).over(f) for a in factors] + [F.var_pop(y).over(f)]
    rows = df.dropna(subset=[y, *factors]).withColumn("_n", F.count("*").over(f)).withColumn("_s", F.array(*sums)).where(F.col("_n") >= n)
    n_keys = len(keys) + 1

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.triu_indices(m)
        for b in batches:
            s = b.column(n_keys).flatten().to_numpy().reshape(-1, len(pairs) + m + 1)
            g = np.zeros((len(s), m, m))
            g[:, at[0], at[1]] = g[:, at[1], at[0]] = s[:, : len(pairs)]
            c, v = s[:, len(pairs) : -1], s[:, -1]
            best, loss = np.zeros((len(s), m)), v.copy()
            for mask in range(1, 1 << m):
                on = [k for k in range(m) if mask >> k & 1]
                for full in (False, True):  # sum below one, or held at one
                    if full:
                        kkt = np.zeros((len(s), len(on) + 1, len(on) + 1))
                        kkt[:, :-1, :-1] = g[:, on][:, :, on]
                        kkt[:, -1, :-1] = kkt[:, :-1, -1] = 1
                        w = np.einsum("nij,nj->ni", np.linalg.pinv(kkt), np.concatenate([c[:, on], np.ones((len(s), 1))], axis=1))[:, :-1]
                    else:
                        w = np.einsum("nij,nj->ni", np.linalg.pinv(g[:, on][:, :, on]), c[:, on])
                    x = np.zeros((len(s), m))
                    x[:, on] = w
                    err = v - 2 * (x * c).sum(axis=1) + np.einsum("ni,nij,nj->n", x, g, x)
                    ok = (x >= -1e-9).all(axis=1) & (x.sum(axis=1) <= 1 + 1e-9) & (err < loss - 1e-15)
                    best[ok], loss[ok] = x[ok], err[ok]
            r2 = np.where(v > 1e-18, 1 - loss / np.maximum(v, 1e-18), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keys], pa.array(list(best), pa.list_(pa.float64())), pa.array(r2)], [*keys, "trade_date", "exposure", "r2"])

    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in [*keys, "trade_date"])
    return rows.select(*keys, "trade_date", "_s").mapInArrow(solve, f"{types}, exposure array<double>, r2 double")
