"""Scores, ranks, picks and screens across the codes of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.frames import KEYS, day, roll, series
from panelforge.functions.storage import cut


def trailing_return(n: int, skip: int = 0, x: str = "close", keys: tuple[str, ...] = KEYS) -> Column:
    w = series(keys)
    return F.try_divide(F.lag(x, skip).over(w), F.lag(x, skip + n).over(w)) - 1


def ratio_score(r: str, n: int, downside: bool = False, keys: tuple[str, ...] = KEYS) -> Column:
    """Window mean over deviation; where the deviation vanishes, the sign times 1e9."""
    f = roll(series(keys), n)
    sd = F.stddev_samp(F.least(F.col(r), F.lit(0.0)) if downside else F.col(r)).over(f)
    mean = F.avg(r).over(f)
    return F.when(F.count(r).over(f) >= n, F.when(F.abs(sd) < 1e-12, F.signum(mean) * 1e9).otherwise(mean / sd))


def pct_rank(x: str, keys: tuple[str, ...] = ()) -> Column:
    """Average rank of ties over the count of non-null values of a date."""
    xs = day(keys)
    order = xs.orderBy(x)
    ties = F.count(x).over(Window.partitionBy(*keys, "trade_date", x))
    rank = F.rank().over(order) - (F.count("*").over(xs) - F.count(x).over(xs))  # nulls come first
    return F.when(F.col(x).isNotNull(), (rank + (ties - 1) / 2) / F.count(x).over(xs))


def weighted(scores: dict[str, float]) -> Column:
    """Sum of weights times ranked factors; null if any is."""
    return sum((F.lit(w) * F.col(c) for c, w in scores.items()), F.lit(0.0))


def picks(df: DataFrame, score: str, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The |k| best (worst for negative k) scored codes of each date, ties by code."""
    order = F.desc(score) if k > 0 else F.asc(score)
    w = day(keys).orderBy(order, "code")
    return df.where(F.col(score).isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= abs(k))


def beating(df: DataFrame, score: str, benchmark: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Codes whose score beats the benchmark's on the date; the benchmark itself where none does."""
    b = F.max(F.when(F.col("code") == benchmark, F.col(score))).over(day(keys))
    df = df.withColumn("_b", b).withColumn("_beats", (F.col("code") != benchmark) & (F.col(score) > F.col("_b")))
    none = F.max(F.coalesce("_beats", F.lit(False))).over(day(keys))
    return df.withColumn("_any", none).where(F.col("_beats") | (~F.col("_any") & (F.col("code") == benchmark))).drop("_b", "_beats", "_any")


def one_per_group(df: DataFrame, group: str, by: list[Column], most: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    w = Window.partitionBy(*keys, "trade_date", group).orderBy(*by, "code")
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def filtered_picks(df: DataFrame, score: str, passes: Column, k: int, backfill: bool, keys: tuple[str, ...] = ()) -> DataFrame:
    """Picks under an entry filter: with backfill lower-ranked codes fill the places of those that fail."""
    marked = df.withColumn("_pass", F.coalesce(passes, F.lit(False)))
    out = picks(marked.where("_pass"), score, k, keys) if backfill else picks(marked, score, k, keys).where("_pass")
    return out.drop("_pass")


def cash_rule(above: Column, keys: tuple[str, ...] = ()) -> Column:
    """True on dates on which no code holds the condition."""
    return ~F.max(F.coalesce(above, F.lit(False))).over(day(keys))


def correlations(df: DataFrame, r: str = "r", least: int = 20, keys: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, n, corr) of all pairs of codes on common dates (inside keys): one row a pair.

    The pairs are the output: c codes a date give c (c - 1) / 2 rows before they
    are summed up, so this is for universes of some thousand codes.
    """
    rows = df.where(F.col(r).isNotNull()).select(*keys, "trade_date", "code", F.col(r).alias("r"))
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.trade_date") == F.col("b.trade_date")) & (F.col("a.code") < F.col("b.code"))
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    pairs = a.join(b.hint("merge"), same)
    out = pairs.groupBy(F.col("a.code").alias("a"), F.col("b.code").alias("b")).agg(F.count("*").alias("n"), F.corr("a.r", "b.r").alias("corr"))
    return out.where(F.col("n") >= least)


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in pairs.columns if c not in ("a", "b")]))


def mean_correlation(pairs: DataFrame) -> DataFrame:
    return both_ways(pairs).groupBy(F.col("a").alias("code")).agg(F.avg("corr").alias("mean_corr"), F.avg(F.abs("corr")).alias("mean_abs_corr"))


def groups(pairs: DataFrame, codes: DataFrame, limit: float, most_rounds: int = 60) -> DataFrame:
    """(code, group): connected by |corr| >= limit; group is the smallest code reachable.

    Each round takes the smallest label among the neighbours and then that
    label's label, so a chain of n codes takes about log n rounds.
    """
    near = cut(both_ways(pairs.where(F.abs("corr") >= limit)).select("a", "b"))
    label = codes.select("code", F.col("code").alias("group"))
    for _ in range(most_rounds):
        best = near.join(label.hint("merge"), F.col("b") == F.col("code")).groupBy("a").agg(F.min("group").alias("_g"))
        step = label.join(best.hint("merge"), F.col("code") == F.col("a"), "left").select("code", F.least("group", "_g").alias("group"), F.col("group").alias("_was"))
        up = step.select(F.col("code").alias("_up"), F.col("group").alias("_top"))
        new = cut(step.join(up.hint("merge"), F.col("group") == F.col("_up"), "left").select("code", F.least("group", "_top").alias("group"), "_was"))
        label = new.select("code", "group")
        if not new.where("`group` <> _was").limit(1).count():
            return label
    raise RuntimeError(f"groups still change after {most_rounds} rounds")


def trailing_significance(df: DataFrame, m: str, y: str) -> DataFrame:
    """Forward return where the trailing one is above zero against the rest: means, spread, Welch t, information coefficient."""
    up = F.col(m) > 0
    rows = df.where(F.col(m).isNotNull() & F.col(y).isNotNull())
    side = lambda f, c: f(F.when(c, F.col(y)))
    g = rows.groupBy("code").agg(side(F.count, up).alias("n_up"), side(F.count, ~up).alias("n_down"), side(F.avg, up).alias("mean_up"), side(F.avg, ~up).alias("mean_down"), side(F.var_samp, up).alias("_vu"), side(F.var_samp, ~up).alias("_vd"), F.corr(m, y).alias("ic"))
    spread = F.col("mean_up") - F.col("mean_down")
    return g.select("code", "n_up", "n_down", "mean_up", "mean_down", spread.alias("spread"), F.try_divide(spread, F.sqrt(F.try_divide(F.col("_vu"), F.col("n_up")) + F.try_divide(F.col("_vd"), F.col("n_down")))).alias("t"), "ic")


def screened(metrics: DataFrame, pairs: DataFrame, n: int, quota: int, most_corr: float) -> DataFrame:
    """Greedy pick by score: at most `quota` a category, no correlation above the limit with a code taken before.

    The screen is one small group (a row a candidate); its order is a loop in Python.
    """
    near = both_ways(pairs).where(F.abs("corr") > most_corr).groupBy(F.col("a").alias("code")).agg(F.collect_list("b").alias("near"))
    rows = metrics.join(near.hint("merge"), "code", "left").select("screen", "code", "category", "score", F.coalesce("near", F.array().cast("array<string>")).alias("near"))

    def pick(pdf):
        taken, used, out = set(), {}, []
        for r in pdf.sort_values(["score", "code"], ascending=[False, True]).itertuples():
            why = "quota" if used.get(r.category, 0) >= quota else "correlation" if taken & set(r.near) else "full" if len(taken) >= n else "taken"
            if why == "taken":
                taken.add(r.code)
                used[r.category] = used.get(r.category, 0) + 1
            out.append((r.screen, r.code, r.category, r.score, why))
        import pandas as pd

        return pd.DataFrame(out, columns=["screen", "code", "category", "score", "reason"])

    return rows.groupBy("screen").applyInPandas(pick, "screen string, code string, category string, score double, reason string")


def gated(decisions: DataFrame, gap: float, least_periods: int, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Inertia: the held pick changes only after so many periods and if the new score leads by the gap.

    Rows (strategy, trade_date, code, score, place, ...) of scored candidates of each decision; one small group a strategy.
    """

    def walk(pdf):
        import pandas as pd

        out, now, age = [], None, 0
        for date, g in pdf.sort_values(["trade_date", "place"]).groupby("trade_date", sort=True):
            best = g.iloc[0]
            own = g[g["code"] == now]
            change = now is None or own.empty or (age >= least_periods and best["code"] != now and best["score"] - own.iloc[0]["score"] > gap)
            if change:
                now, age = best["code"], 0
            age += 1
            out.append((best["strategy"], date, now, bool(change)))
        return pd.DataFrame(out, columns=["strategy", "trade_date", "code", "changed"])

    return decisions.groupBy(*keys).applyInPandas(walk, "strategy string, trade_date date, code string, changed boolean")


def best_parameters(scores: DataFrame, by: list[Column], keys: tuple[str, ...] = ()) -> DataFrame:
    if not keys:
        return scores.orderBy(*by).limit(1)
    w = Window.partitionBy(*keys).orderBy(*by)
    return scores.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def min_max(x: str, keys: tuple[str, ...], low_is_good: bool = False) -> Column:
    """Scaled to 0..1 inside a run (keys); a constant metric gives 0.5."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    v = F.when(hi > lo, (F.col(x) - lo) / (hi - lo)).otherwise(0.5)
    return 1 - v if low_is_good else v


def neighbourhood(grid: DataFrame, p: str, q: str, radius: tuple[int, int], score: str, top: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Share of points among a point's grid neighbours whose score reaches the top quantile, and their mean and deviation."""
    w = Window.partitionBy(*keys)
    marked = grid.withColumn("_cut", F.percentile(score, top).over(w)).withColumn("_top", F.col(score) >= F.col("_cut"))
    a, b = marked.alias("a"), marked.alias("b")
    cond = (F.abs(F.col(f"a.{p}") - F.col(f"b.{p}")) <= radius[0]) & (F.abs(F.col(f"a.{q}") - F.col(f"b.{q}")) <= radius[1])
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    got = a.join(b.hint("merge"), cond).groupBy(*[F.col(f"a.{c}").alias(c) for c in (*keys, p, q)])
    return got.agg(F.count("*").alias("n"), F.avg(F.col("b._top").cast("int")).alias("top_share"), F.avg(f"b.{score}").alias("mean"), F.stddev_pop(f"b.{score}").alias("sd"))
