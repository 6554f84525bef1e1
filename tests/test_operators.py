"""Single operators on hand-made series."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions.frames import clean, series
from panelforge.operators import calendar as cal
from panelforge.operators import chains
from panelforge.operators import cross_section as xs
from panelforge.operators import indicators as ind
from panelforge.operators import ledger, performance, quality, scan, signals, studies
from panelforge.operators import portfolio as pf
from panelforge.sources import prices

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def panel(spark, closes, code="A", **more):
    n = len(closes)
    rows = pd.DataFrame({"code": code, "trade_date": [day(k) for k in range(n)], "close": [float("nan") if c is None else float(c) for c in closes]})
    for c in ("open", "high", "low"):
        rows[c] = [float(x) for x in more.get(c, closes)]
    for c in ("volume", "amount"):
        rows[c] = 1.0
    return spark.createDataFrame(rows)


def column(df, name, order="trade_date"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_clean(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(clean(F.col("x"))).collect()] == [1.0, None, None, None]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 200])
def test_scan_equals_loop(spark, n):
    values = [math.sin(k) + k % 7 for k in range(n)]
    got = column(scan.ema(panel(spark, values), "y", "close", 0.3), "y")
    y, want = values[0], []
    for k, v in enumerate(values):
        y = v if k == 0 else 0.3 * v + 0.7 * y
        want.append(y)
    assert got == pytest.approx(want, rel=1e-9)


def test_kama_equals_loop(spark):
    x = [10 + math.sin(k / 3) * 2 + k / 20 for k in range(150)]
    got = column(ind.kama(panel(spark, x), "k"), "k")
    f, s = 2 / 3, 2 / 31
    y, want = x[0], [x[0]]
    for k in range(1, len(x)):
        path = sum(abs(x[i] - x[i - 1]) for i in range(k - 9, k + 1)) if k >= 10 else 0
        er = abs(x[k] - x[k - 10]) / path if path else 0.0
        a = (er * (f - s) + s) ** 2
        y = a * x[k] + (1 - a) * y
        want.append(y)
    assert got == pytest.approx(want, rel=1e-9)


def test_rsi_edges(spark):
    up = column(ind.rsi(panel(spark, range(1, 40)), n=5), "rsi")
    assert up[:5] == [None] * 5 and up[5:] == [100.0] * 34
    assert set(column(ind.rsi(panel(spark, [3] * 20), n=5), "rsi")[5:]) == {50.0}
    assert set(column(ind.rsi(panel(spark, range(40, 1, -1)), n=5), "rsi")[5:]) == {0.0}


def test_midrank(spark):
    assert column(ind.midrank(panel(spark, [2, 1, 2, 3]), "close", "p"), "p") == pytest.approx([0.5, 0.25, (1 + 1) / 3, 3.5 / 4])


def test_look_ahead(spark):
    """What is known at a day does not change with later rows."""
    x = [10 + math.sin(k) * 3 + k / 10 for k in range(90)]
    y = x[:60] + [v * 5 for v in x[60:]]
    def run(v):
        b = panel(spark, v)
        b = ind.atr(ind.macd(b), n=5)
        b = signals.donchian_position(b, 10)
        return ind.with_quantiles(b, {"q": ("close", 0.8, 20, 5)}).select("trade_date", "macd_hist", "atr", "pos", "q")
    a, b = (run(v).orderBy("trade_date").limit(60).toPandas() for v in (x, y))
    pd.testing.assert_frame_equal(a, b)


def test_donchian_and_trailing_position(spark):
    x = [1, 2, 3, 4, 3, 2, 1, 2, 5]
    assert column(signals.donchian_position(panel(spark, x), 3), "pos") == [0, 0, 0, 1, 1, 0, 0, 0, 1]
    df = panel(spark, [0, 5, 3, 1, 0, 2, 5]).withColumn("m", F.col("close"))
    assert column(signals.trailing_position(df, "m", 4, 0), "pos") == [0, 1, 1, 1, 0, 0, 1]
    with pytest.raises(ValueError):
        signals.trailing_position(df, "m", 0, 1)


def test_bias_position(spark):
    df = panel(spark, [0, 3, 9, 4, 1, -2, 3]).select("code", "trade_date", F.col("close").alias("b"))
    assert column(signals.bias_position(df, "b", 2, 8, -1), "pos") == [0, 1, 0, 1, 1, 0, 1]


def test_entry_and_exit_gates(spark):
    df = panel(spark, [0, 1, 1, 1, 0, 1, 1, 0]).withColumnRenamed("close", "base")
    gate = F.dayofmonth("trade_date").isin(3, 8)
    out = signals.gated_entry(df, "base", gate).orderBy("trade_date").collect()
    assert [r["pos"] for r in out] == [0, 0, 1, 1, 0, 0, 0, 0]
    assert [r["attempted"] for r in out] == [False, True, False, False, False, True, False, False]
    hits = F.dayofmonth("trade_date").isin(2, 3, 4)
    assert column(signals.gated_exit(df, "base", hits), "pos") == [0, 0, 1, 0, 0, 1, 1, 0]


def test_confirmed_side(spark):
    df = panel(spark, [1, 1, -1, -1, 1, 1]).withColumn("side", F.col("close").cast("int"))
    assert column(signals.confirmed_side(df, "side", F.dayofmonth("trade_date").isin(2, 4)), "pos") == [0, 1, 1, -1, -1, -1]


def test_static_and_trailing_stop(spark):
    c = [10, 11, 12, 11, 9, 8]
    b = panel(spark, c, open=[10, 10.5, 11.5, 12, 10, 8.5], high=[10.5, 11.5, 12.5, 12, 10, 9], low=[9.5, 10.5, 11.5, 10.5, 8.5, 7.5]).withColumn("pos", F.lit(1)).withColumn("atr", F.lit(1.0))
    b = signals.with_positions(b)
    s = signals.atr_stops(b, "static", 1.0).orderBy("trade_date").collect()
    assert [r["stop"] for r in s] == [9.0] * 6 and [r["exit_price"] for r in s] == [None, None, None, None, 9.0, None]
    assert [r["active"] for r in s] == [True] * 5 + [False]
    t = signals.atr_stops(b, "trailing", 1.0).orderBy("trade_date").collect()
    assert [r["stop"] for r in t] == [9.0, 9.0, 10.0, 11.0, 11.0, 11.0] and [r["exit_price"] for r in t][:4] == [None, None, None, 11.0]


def test_scale_out_breakeven(spark):
    b = panel(spark, [10, 11, 12, 11, 10], open=[10] * 5, high=[10, 11.2, 12.1, 11, 10.5], low=[9.9, 10.5, 11, 10.5, 9.9]).withColumn("pos", F.lit(1)).withColumn("risk", F.lit(1.0))
    got = column(signals.scale_out(signals.with_positions(b), "risk", [(1.0, 0.3), (2.0, 0.3)]), "size")
    assert got == pytest.approx([1.0, 0.7, 0.4, 0.4, 0.0])


def test_budget_gate(spark):
    rows = [("s", day(0), "A", 0.03), ("s", day(1), "B", 0.02), ("s", day(2), "C", 0.02), ("s", day(3), "D", 0.01), ("s", day(40), "E", 0.05)]
    out = signals.budget_gate(spark.createDataFrame(rows, "strategy string, trade_date date, code string, risk double"))
    assert {r["code"]: r["admitted"] for r in out.collect()} == {"A": True, "B": True, "C": False, "D": True, "E": True}


def test_drawdown_sleep(spark):
    df = spark.createDataFrame([("s", day(k), x) for k, x in enumerate([0.1, -0.2, 0.5, 0.5, 0.1])], "strategy string, trade_date date, r double")
    assert column(signals.drawdown_sleep(df, "r", 0.1, 2), "exposure") == [1.0, 1.0, 0.0, 0.0, 1.0]


def test_violations(spark):
    df = panel(spark, [10, 10, 20, 0, 5])
    got = {(r["trade_date"], r["rule"]) for r in quality.violations(df, max_return=0.5).collect()}
    assert (day(2), "jump") in got and (day(3), "not_positive") in got and not any(d == day(1) for d, _ in got)


def test_upsert_and_rollback(spark):
    old = spark.createDataFrame([("A", day(0), 1.0), ("A", day(1), 2.0)], "code string, trade_date date, close double")
    new = spark.createDataFrame([("A", day(1), 3.0), ("A", day(2), 4.0)], "code string, trade_date date, close double")
    keys = ["code", "trade_date"]
    after = prices.upserted(old, new, keys)
    assert column(after, "close") == [1.0, 3.0, 4.0]
    audit = prices.classified(old, new, keys, "close")
    assert sorted(r["action"] for r in audit.collect()) == ["insert", "update"]
    assert column(prices.rolled_back(after, audit, keys, "close"), "close") == [1.0, 2.0]


def test_resolver(spark):
    df = spark.createDataFrame([("2024-01-02", "1.5", "x"), ("bad", "2", "3")], ["日期", "收盘", "最高"])
    assert [tuple(r) for r in prices.resolved(df).collect()] == [(dt.date(2024, 1, 2), None, 1.5)]


def test_calendars(spark):
    days = spark.createDataFrame([(day(k),) for k in range(60) if day(k).weekday() < 5], "trade_date date")
    ends = [r["decision_date"] for r in cal.period_ends(days, "W", "WED").orderBy("decision_date").collect()]
    assert ends[:2] == [dt.date(2024, 1, 3), dt.date(2024, 1, 10)]
    t = spark.createDataFrame([(dt.date(2024, 1, 6),), (dt.date(2024, 1, 8),)], "target_date date")
    assert {r["target_date"].day: (r["session"].day, r["hit"]) for r in cal.snapped(t, days, "next").collect()} == {6: (8, "next"), 8: (8, "exact")}
    assert {r["target_date"].day: (r["session"].day, r["hit"]) for r in cal.snapped(t, days, "prev").collect()} == {6: (5, "prev"), 8: (8, "exact")}
    assert cal.snapped(t, days, "skip").count() == 1


def test_held_starts_after_the_decision(spark):
    days = spark.createDataFrame([(day(k),) for k in range(5)], "trade_date date")
    decisions = spark.createDataFrame([(day(1),), (day(3),)], "decision_date date")
    assert [(r[0], r[1]) for r in cal.held(days, decisions).orderBy("trade_date").collect()] == [(day(2), day(1)), (day(3), day(1)), (day(4), day(3))]


def test_drift_equals_loop(spark):
    r = {"A": [0.1, -0.2, 0.3, 0.1], "B": [0.0, 0.4, -0.1, 0.2]}
    rows = [(c, day(k), x, 0.5, k // 2) for c, v in r.items() for k, x in enumerate(v)]
    df = pf.drifted(spark.createDataFrame(rows, "code string, trade_date date, r double, w0 double, period int"), "period")
    got = {(x["code"], x["trade_date"]): x["w"] for x in df.collect()}
    for start in (0, 2):
        g = {"A": 0.5, "B": 0.5}
        for k in (start, start + 1):
            for c in g:
                assert got[c, day(k)] == pytest.approx(g[c] / sum(g.values()))
            g = {c: v * (1 + r[c][k]) for c, v in g.items()}


def test_contributions_equal_loop(spark):
    rows = [("A", day(k), r, c) for k, (r, c) in enumerate([(0.1, 100.0), (-0.5, 0.0), (0.2, 50.0)])]
    got = column(pf.contributions(spark.createDataFrame(rows, "code string, trade_date date, r double, c double"), "c", "r", ("code",)), "account")
    account, want = 0.0, []
    for _, _, r, c in rows:
        account = (account + c) * (1 + r)
        want.append(account)
    assert got == pytest.approx(want)


def test_nav_first_row(spark):
    df = spark.createDataFrame([("s", day(0), 0.1), ("s", day(1), 0.1)], "strategy string, trade_date date, r double")
    assert column(pf.nav(df), "nav") == pytest.approx([1.0, 1.21])


def test_timing(spark):
    df = panel(spark, [0, 1, 1, 0]).withColumnRenamed("close", "w")
    got = {h: column(df.withColumn("x", pf.timed("w", h)), "x") for h in ("open", "close", "oc2")}
    assert got == {"open": [0, 1, 1, 0], "close": [0, 0, 1, 1], "oc2": [0, 0.5, 1, 0.5]}


def test_fifo(spark):
    rows = [("X", day(0), "09", 1, "BUY", 10.0, 5.0, 1.0), ("X", day(1), "09", 2, "BUY", 10.0, 6.0, 1.0), ("X", day(2), "09", 3, "SELL", 15.0, 8.0, 3.0)]
    t = spark.createDataFrame(rows, "code string, trade_date date, trade_time string, id long, side string, quantity double, price double, fee double")
    got = sorted((r["buy_id"], r["sell_id"], r["matched"], r["pnl"], r["fee"]) for r in ledger.fifo(t, ("code",)).collect())
    assert got == [(1, 3, 10.0, 30.0, pytest.approx(3.0)), (2, 3, 5.0, 10.0, pytest.approx(1.5))]
    assert ledger.oversold(t, ("code",)).count() == 0
    assert [r["closed"] for r in ledger.rounds(t).collect()] == [False]


TRADE = "account_id long, code string, trade_date date, trade_time string, id long, side string, quantity double, price double, fee double"


def test_fifo_never_matches_a_later_buy(spark):
    rows = [(1, "X", day(0), "09", 1, "SELL", 10.0, 8.0, 0.0), (1, "X", day(1), "09", 2, "BUY", 10.0, 7.0, 0.0), (1, "X", day(2), "09", 3, "SELL", 4.0, 9.0, 0.0), (1, "X", day(3), "09", 4, "SELL", 20.0, 9.0, 0.0), (1, "X", day(4), "09", 5, "BUY", 5.0, 1.0, 0.0), (1, "X", day(5), "09", 6, "SELL", 5.0, 2.0, 0.0)]
    rows += [(2, "X", day(0), "09", 7, "BUY", 3.0, 5.0, 0.0), (2, "X", day(1), "09", 8, "SELL", 3.0, 6.0, 0.0)]  # another holder's stock is not touched
    t = spark.createDataFrame(rows, TRADE)
    got = sorted((r["account_id"], r["buy_id"], r["sell_id"], r["matched"]) for r in ledger.fifo(t).collect())
    assert got == [(1, 2, 3, 4.0), (1, 2, 4, 6.0), (1, 5, 6, 5.0), (2, 7, 8, 3.0)]
    assert sorted(r["id"] for r in ledger.oversold(t).collect()) == [1, 3, 4, 5, 6]


def test_fifo_equals_a_queue_of_lots(spark):
    import random

    rng = random.Random(7)
    rows = [(rng.randrange(3), "AB"[rng.randrange(2)], day(rng.randrange(30)), f"{rng.randrange(9, 15):02d}", k, rng.choice(["BUY", "SELL"]), float(rng.randrange(1, 9)) / 4, 5.0, 0.0) for k in range(200)]
    want = []
    lots = {}
    for a, c, _, _, k, side, q, _, _ in sorted(rows, key=lambda r: (r[2], r[3], r[4])):
        own = lots.setdefault((a, c), [])
        if side == "BUY":
            own.append([k, q])
        while side == "SELL" and q > 0 and own:
            n = min(q, own[0][1])
            want.append((a, c, own[0][0], k, n))
            q, own[0][1] = q - n, own[0][1] - n
            if not own[0][1]:
                own.pop(0)
    got = [(r["account_id"], r["code"], r["buy_id"], r["sell_id"], r["matched"]) for r in ledger.fifo(spark.createDataFrame(rows, TRADE)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 40


def test_holdings_leave_flat_days_out(spark):
    rows = [(1, "X", day(0), "09", 1, "BUY", 10.0, 8.0, 0.0), (1, "X", day(3), "09", 2, "SELL", 10.0, 9.0, 0.0), (1, "X", day(5), "09", 3, "BUY", 2.0, 9.0, 0.0)]
    days = spark.createDataFrame([(day(k),) for k in range(8)], "trade_date date")
    px = spark.createDataFrame([("X", day(0), 8.0), ("X", day(6), 9.0)], "code string, trade_date date, close double")
    got = [(r["trade_date"], r["quantity"], r["close"], r["stale_days"]) for r in ledger.holdings(spark.createDataFrame(rows, TRADE), days, px).orderBy("trade_date").collect()]
    assert got == [(day(0), 10.0, 8.0, 0), (day(1), 10.0, 8.0, 1), (day(2), 10.0, 8.0, 2), (day(5), 2.0, 8.0, 5), (day(6), 2.0, 9.0, 0), (day(7), 2.0, 9.0, 1)]


def test_overlapping_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    make = lambda n: [("AB"[rng.randrange(2)], k, day(s := rng.randrange(200)), day(s + rng.randrange(90))) for k in range(n)]
    left, right = make(60), make(60)
    schema = "code string, id long, start date, end date"
    got = sorted((r["id"], r["right_id"]) for r in cal.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["code"]).collect())
    assert got == sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3])


def test_event_study_draws_as_many_dates_as_there_are_events(spark):
    pool = spark.createDataFrame([("A", day(k), 1.0) for k in range(12)], "code string, trade_date date, fwd double")
    few = studies.event_study(pool.where(f"trade_date <= '{day(2)}'"), pool.withColumn("fwd", F.lit(1.0)), 30)
    (r,) = few.collect()
    assert (r["n"], r["mean"], r["p"]) == (3, 1.0, 1.0)


def bootstrap_paths(values, key, sims, block, seed=9):
    """The same resamples as a plain loop: totals, deviations, drawdowns."""
    import hashlib

    n, out = len(values), {}
    for sim in range(1, sims + 1):
        path = []
        for b in range((n - 1) // block + 1):
            u = int(hashlib.md5(f"{seed}:{key}:{sim}:{b}".encode()).hexdigest()[:13], 16) / 2**52
            path += [values[(int(u * n) + o) % n] for o in range(block)]
        path, nav, peak, worst = path[:n], 1.0, 1.0, 0.0
        for x in path:
            nav *= 1 + x
            peak = max(peak, nav)
            worst = min(worst, nav / peak - 1)
        out[sim] = nav - 1, pd.Series(path).std() * math.sqrt(252), worst
    return out


@pytest.mark.parametrize("n", [3, 20, 47])
def test_block_bootstrap_equals_loop_and_shares_draws(spark, n):
    values = [math.sin(7 * k) / 20 for k in range(n)]
    rows = [("A", v, day(k), x * v) for v in (1, 2) for k, x in enumerate(values)]
    df = spark.createDataFrame(rows, "code string, variant int, trade_date date, r double")
    got = studies.block_bootstrap(df, "r", 5, 20, keys=("code", "variant"), draw=("code",)).collect()
    for v in (1, 2):
        want = bootstrap_paths([x * v for x in values], "A", 5, 20)
        assert {r["sim"]: (r["total"], r["vol"], r["max_drawdown"]) for r in got if r["variant"] == v} == {k: pytest.approx(x, abs=1e-12) for k, x in want.items()}


def test_quantiles_of_yesterday_equal_sorting(spark):
    x = [None if k % 11 == 5 else math.sin(k * 3) for k in range(80)]
    got = column(ind.with_quantiles(panel(spark, [1] * 80).withColumn("x", F.when(F.dayofyear("trade_date") % 11 == 6, None).otherwise(F.sin(3.0 * (F.dayofyear("trade_date") - 1)))), {"q": ("x", 0.8, 20, 5), "a": ("x", 0.3, None, 1)}), "q")
    for k in range(80):
        seen = sorted(v for v in x[max(0, k - 20) : k] if v is not None)
        want = None if len(seen) < 5 else float(pd.Series(seen).quantile(0.8))
        assert got[k] == (None if want is None else pytest.approx(want))


def test_style_exposure_against_a_grid(spark):
    import random

    rng = random.Random(5)
    f = [[rng.gauss(0, 1) for _ in range(2)] for _ in range(40)]
    rows = [("A", day(k), 0.6 * a - 0.3 * b + rng.gauss(0, 0.1), a, b) for k, (a, b) in enumerate(f)]
    (r,) = studies.style_exposure(spark.createDataFrame(rows, "code string, trade_date date, y double, a double, b double"), "y", ["a", "b"], 40).collect()
    y, a, b = (pd.Series([row[k] for row in rows]) for k in (2, 3, 4))
    best = min(((y - u / 200 * a - v / 200 * b).var(ddof=0), u / 200, v / 200) for u in range(201) for v in range(201 - u))
    assert r["exposure"] == pytest.approx(best[1:], abs=0.006) and r["r2"] == pytest.approx(1 - best[0] / y.var(ddof=0), abs=1e-4)


def test_normal_p(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (1.959963985,), (-2.575829304,), (None,)], "z double").select(studies.normal_p("z")).collect()]
    assert got[:3] == pytest.approx([1.0, 0.05, 0.01], rel=1e-6) and got[3] is None


def test_long_chain_is_one_group(spark):
    names = [f"c{k:02d}" for k in range(64)]
    pairs = spark.createDataFrame([(a, b, 9, 0.9) for a, b in zip(names, names[1:], strict=False)], "a string, b string, n long, corr double")
    codes = spark.createDataFrame([(c,) for c in names], "code string")
    assert {r[1] for r in xs.groups(pairs, codes, 0.7).collect()} == {"c00"}


def test_equity_budget_stop(spark):
    b = panel(spark, [10, 9.6, 9.4], open=[10, 9.8, 9.45], high=[10, 9.8, 9.5], low=[9.9, 9.55, 9.3]).withColumn("pos", F.lit(1)).withColumn("w", F.lit(0.5))
    out = signals.equity_budget_stop(signals.with_positions(b), 0.02).orderBy("trade_date").collect()
    assert [r["stop"] for r in out] == pytest.approx([9.6] * 3) and [r["exit_price"] for r in out] == [None, pytest.approx(9.6), None] and [r["active"] for r in out] == [True, True, False]


def test_categories(spark):
    names = {"30年国债": "BOND", "可转债ETF": "CONVERTIBLE_BOND", "国债ETF 可转债": "BOND", "美债": "BOND", "gold": "GOLD", "nasdaq us etf": "US_EQ", "日本": "JP_EQ", None: "CN_EQ", "沪深300": "CN_EQ"}
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("c", chains.category(F.lit("1"), F.col("name")))
    assert {r["name"]: r["c"] for r in df.collect()} == names


def test_fund_events(spark):
    rows = [("A", "dividend", "2024-01-05", "0.5"), ("A", "dividend", "20240105", "0.5"), ("A", "split", "2024-02-01", "1:2"), ("A", "split", "bad", "1:2"), ("B", "dividend", "2024-01-05", "x"), ("B", "other", "2024-01-05", "1")]
    got = sorted(tuple(r) for r in chains.fund_events(spark.createDataFrame(rows, "code string, kind string, date string, amount string")).select("code", "event_key", "cash_dividend", "split_ratio").collect())
    assert got == [("A", "div:2024-01-05:0.5", 0.5, None), ("A", "split:2024-02-01:2.0", None, 2.0), ("B", "div:2024-01-05:-", None, None)]


def test_index_signal_earns_nothing_of_the_day_before(spark):
    n = 60
    rows = [("A", day(k), 100.0 + (k % 2) * 0.1 + (20.0 if k == 40 else 0.0), 0.01) for k in range(n)]
    out = chains.index_signal(spark.createDataFrame(rows, "code string, trade_date date, idx_close double, x double"), "x", cost_bps=0.0).orderBy("trade_date").collect()
    assert out[40]["pos"] == 0 and out[39]["pos"] == 1 and out[41]["pos"] == 1
    assert out[41]["nav_strategy"] == pytest.approx(out[40]["nav_strategy"]) and out[40]["nav_strategy"] == pytest.approx(1.01**40)
    assert out[-1]["turnover"] == 0 and out[-1]["nav_buy_hold"] == pytest.approx(1.01 ** (n - 1))


def test_arrays_of_unlike_length(spark):
    df = spark.createDataFrame([("A", '{"date": ["2024-01-02", "2024-01-03"], "close": [1.5]}'), ("B", "no json")], "code string, body string")
    got = prices.from_arrays(df, "body", {"date": "string", "close": "double"}, ["code"]).orderBy("trade_date").collect()
    assert [tuple(r) for r in got] == [("A", dt.date(2024, 1, 2), 1.5), ("A", dt.date(2024, 1, 3), None)]


def test_dominant_and_continuous(spark):
    rows = []
    for k, (a, b) in enumerate([(100, 50), (100, 105), (90, 120), (130, 120)]):
        for c, h, px in (("C1", a, 10.0 + k), ("C2", b, 20.0 + 2 * k)):
            rows.append(("R", c, day(k), px, px, px, px + 0.5, h))
    df = spark.createDataFrame(rows, "root string, contract string, trade_date date, open double, high double, low double, close double, hold long")
    lead = ledger.dominant(df)
    assert column(lead, "contract") == ["C1", "C1", "C1", "C2"]  # 105 is not above 1.1 * 100; a former leader does not return
    out = ledger.continuous(df, lead).orderBy("trade_date").collect()
    gap_close, gap_open = (24.5 - 12.5), (26.0 - 13.0)
    assert [r["close_forward"] for r in out] == pytest.approx([10.5 + gap_close, 11.5 + gap_close, 12.5 + gap_close, 26.5])
    assert [r["close_backward"] for r in out] == pytest.approx([10.5, 11.5, 12.5, 26.5 - gap_open])


def test_xirr(spark):
    rows = [(1, DAY, -100.0), (1, DAY + dt.timedelta(days=365), 110.0), (2, DAY, 100.0)]
    got = {r[0]: r[1] for r in performance.xirr(spark.createDataFrame(rows, "account_id long, flow_date date, amount double")).collect()}
    assert got[1] == pytest.approx(1.1 ** (365.2425 / 365) - 1, rel=1e-6) and got[2] is None


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(p,) for p in (0.01, 0.04, 0.03, 0.5)], "p double")
    assert column(studies.benjamini_hochberg(df, "p"), "q", "p") == pytest.approx([0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5])


def test_benjamini_hochberg_counts_what_was_tested(spark):
    df = spark.createDataFrame([(k, p) for k, p in enumerate((0.01, None, 0.04, None))], "k int, p double")
    assert column(studies.benjamini_hochberg(df, "p"), "q", "k") == [0.02, None, 0.04, None]


def test_groups(spark):
    pairs = spark.createDataFrame([("A", "B", 9, 0.9), ("B", "C", 9, -0.8), ("C", "D", 9, 0.1)], "a string, b string, n long, corr double")
    codes = spark.createDataFrame([(c,) for c in "ABCD"], "code string")
    assert {r[0]: r[1] for r in xs.groups(pairs, codes, 0.7).collect()} == {"A": "A", "B": "A", "C": "A", "D": "D"}


def test_pct_rank_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("A", day(0), 1.0), ("B", day(0), 2.0), ("C", day(0), 2.0), ("D", day(0), None)], "code string, trade_date date, x double")
    assert {r[0]: r[1] for r in df.select("code", xs.pct_rank("x")).collect()} == {"A": pytest.approx(1 / 3), "B": pytest.approx(2.5 / 3), "C": pytest.approx(2.5 / 3), "D": None}


def test_empty_panel(spark):
    empty = panel(spark, [1]).limit(0)
    assert ind.macd(empty).count() == 0 and signals.donchian_position(empty, 5).count() == 0 and performance.distribution(empty, "close", ("code",)).count() == 0
    assert empty.withColumn("m", F.lag("close").over(series())).count() == 0
