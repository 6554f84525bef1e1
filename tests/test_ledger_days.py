"""Holdings as intervals and daily account values against spreading every book over every day."""

import datetime as dt
from collections import deque

import numpy as np

from panelforge.operators import ledger
from panelforge.plans.registry import QUERIES

TRADE = "account_id int, code string, trade_date date, trade_time string, id long, side string, quantity double, price double, fee double"
DAY0 = dt.date(2020, 1, 1)


def day(k):
    return DAY0 + dt.timedelta(days=k)


def spread(trades, prices, last):
    """{(account, code, day): (quantity, cost, close, close_date)} by queues of lots and a walk over days."""
    out = {}
    for book in {(t[0], t[1]) for t in trades}:
        own = sorted((t for t in trades if (t[0], t[1]) == book), key=lambda t: (t[2], t[3], t[4], t[7], t[6]))
        lots, net, cost_by_day, net_by_day = deque(), 0.0, {}, {}
        for t in own:
            q, px = t[6], t[7]
            if t[5] == "BUY":
                lots.append([q, px])
                net += q
            else:
                net -= q
                while q > 0 and lots:
                    used = min(q, lots[0][0])
                    lots[0][0] -= used
                    q -= used
                    if lots[0][0] == 0:
                        lots.popleft()
            net_by_day[t[2]], cost_by_day[t[2]] = net, sum(a * b for a, b in lots)
        quantity = cost = 0.0
        for k in range((last - min(net_by_day)).days + 1):
            d = min(net_by_day) + dt.timedelta(days=k)
            quantity, cost = net_by_day.get(d, quantity), cost_by_day.get(d, cost)
            seen = [p for p in prices if p[0] == book[1] and p[1] <= d]
            if quantity:
                close = max(seen, key=lambda p: p[1]) if seen else (None, None, None)
                out[(*book, d)] = (quantity, cost, close[2], close[1])
    return out


def ledger_rows(n=160):
    rng = np.random.default_rng(6)
    trades = []
    for k in range(n):
        side = "BUY" if rng.random() < 0.6 else "SELL"
        trades.append((int(rng.integers(0, 3)), f"c{rng.integers(0, 4)}", day(int(rng.integers(0, 50))), f"{rng.integers(9, 15):02d}", k, side, float(rng.integers(1, 6)), float(rng.integers(100, 900)) / 4, 1.0))
    prices = [(f"c{c}", day(int(k)), float(rng.integers(100, 900)) / 4) for c in range(3) for k in rng.choice(60, 14, replace=False) if not (c == 1 and k < 30)]  # c1 late, c3 never
    return trades, prices


def test_intervals_hold_every_day(spark):
    trades, prices = ledger_rows()
    last = day(70)
    out = ledger.holding_intervals(spark.createDataFrame(trades, TRADE), spark.createDataFrame(prices, "code string, trade_date date, close double")).collect()
    got = {}
    for r in out:
        assert r["missing"] == (r["close"] is None)
        for k in range(((r["to_date"] or last + dt.timedelta(days=1)) - r["from_date"]).days):
            at = (r["account_id"], r["code"], r["from_date"] + dt.timedelta(days=k))
            assert at not in got
            got[at] = (float(r["quantity"]), float(r["cost"]), None if r["close"] is None else float(r["close"]), r["close_date"])
    assert got == spread(trades, prices, last)


def test_daily_values_by_changes(spark):
    trades, prices = ledger_rows()
    last = day(70)
    frame = ledger.holding_intervals(spark.createDataFrame(trades, TRADE), spark.createDataFrame(prices, "code string, trade_date date, close double"))
    out = {(r["account_id"], r["trade_date"]): (r["value"], r["cost"], r["n_held"], r["n_missing"]) for r in ledger.daily_value(frame, str(last)).collect()}
    want = {}
    for (account, _, d), (q, cost, close, _) in spread(trades, prices, last).items():
        v, c, n, m = want.get((account, d), (0.0, 0.0, 0, 0))
        want[(account, d)] = (v + q * (close or 0.0), c + cost, n + 1, m + (close is None))
    assert {k: v for k, v in out.items() if v[2]} == want
    for account in {k[0] for k in want}:
        days = sorted(d for a, d in out if a == account)
        assert days == [days[0] + dt.timedelta(days=k) for k in range((last - days[0]).days + 1)]


def test_no_trades(spark):
    none = spark.createDataFrame([], TRADE)
    frame = ledger.holding_intervals(none, spark.createDataFrame([], "code string, trade_date date, close double"))
    assert frame.count() == 0 and ledger.daily_value(frame, "2020-01-01").count() == 0


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_changes_straight_from_holdings(spark):
    """The same days as from intervals; trades, prices and changes are shuffled once each."""
    trades, prices = ledger_rows()
    t, p = spark.createDataFrame(trades, TRADE), spark.createDataFrame(prices, "code string, trade_date date, close double")
    got = ledger.summed_changes(ledger.holding_changes(t, p), "2020-03-31")
    want = ledger.daily_value(ledger.holding_intervals(t, p), "2020-03-31")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
    assert plan_of(QUERIES["l07_daily_value"](spark, "/root/testdata/sf0.001")).count("Exchange ") == 3


def test_changes_of_any_magnitude(spark):
    t = spark.createDataFrame([(1, "a", day(0), "09", 1, "BUY", 9e8, 9e8, 0.0), (1, "a", day(1), "09", 2, "BUY", 1.0, 1.0, 0.0)], TRADE)
    p = spark.createDataFrame([("a", day(0), 9e8), ("a", day(2), 9e8), ("a", day(3), 1.0)], "code string, trade_date date, close double")
    got = {r["trade_date"]: r["value"] for r in ledger.summed_changes(ledger.holding_changes(t, p), "2020-01-05").collect()}
    assert got == {day(0): 81e16, day(1): 81e16 + 9e8, day(2): 81e16 + 9e8, day(3): 9e8 + 1, day(4): 9e8 + 1}


def test_holdings_meet_prices_by_code_alone(spark):
    """Trades and prices are shuffled once each, and no pair of a range join is made."""
    plan = plan_of(QUERIES["l07_holdings"](spark, "/root/testdata/sf0.001"))
    join = next(line for line in plan.splitlines() if "SortMergeJoin" in line)
    assert plan.count("Exchange ") == 2 and join.rstrip().endswith("LeftOuter")


def test_books_of_one_trade_or_one_side(spark):
    """Books that need no lots, beside one that does."""
    sides = {0: "B", 1: "S", 2: "BBB", 3: "SSS", 4: "BBSBSSSB", 5: "SB", 6: "BS"}
    trades = [(a, "c0", day(3 * k), "09", 10 * a + k, "BUY" if side == "B" else "SELL", float(2 + (a + k) % 3), 10.25 + a + k, 1.0) for a, s in sides.items() for k, side in enumerate(s)]
    trades.append((7, "c0", day(1), "09", 99, "BUY", 0.0, 5.0, 1.0))
    prices = [("c0", day(k), 20.0 + k) for k in (2, 5, 9, 30)]
    got = {}
    for r in ledger.holding_intervals(spark.createDataFrame(trades, TRADE), spark.createDataFrame(prices, "code string, trade_date date, close double")).collect():
        for k in range(((r["to_date"] or day(41)) - r["from_date"]).days):
            got[(r["account_id"], r["code"], r["from_date"] + dt.timedelta(days=k))] = (float(r["quantity"]), float(r["cost"]), None if r["close"] is None else float(r["close"]), r["close_date"])
    assert got == spread(trades, prices, day(40))


def test_holdings_round_before_they_meet_prices(spark):
    """Rounding is once a holding and once a price: rows made of them repeat what was rounded."""
    plan = plan_of(QUERIES["l07_holdings"](spark, "/root/testdata/sf0.001"))
    rows, rest = plan.split("Generate explode", 1)
    assert "round(" not in rows and "round(" in rest
