"""Exits with and without re-entry on hand-made bars; code changes, splits and dividends on a small ledger."""

import datetime as dt

import numpy as np
import pytest

from panelforge.operators import actions, ledger, reentry

BARS = "code string, trade_date int, base double, open double, high double, low double, close double, atr double"


def run(spark, rows, rule, mode):
    out = reentry.with_exits(spark.createDataFrame(rows, BARS), "base", rule, mode).orderBy("code", "trade_date").collect()
    return [(r["position"], None if r["fill"] is None else round(r["fill"], 9), r["event"]) for r in out]


def bars(closes, base=1.0, atr=2.0):
    return [("x", k, base, c, c, c, c, atr) for k, c in enumerate(closes)]


CLOSES = [100.0, 102.0, 104.0, 106.0, 108.0, 110.0, 106.5, 112.0, 120.0, 120.0]


def test_reenter_on_the_next_day_on_which_the_signal_stands(spark):
    got = run(spark, bars(CLOSES), reentry.AtrStop("trailing", 1.0), "reenter")
    assert got[0] == (1.0, None, "entry") and [g[0] for g in got] == [1, 1, 1, 1, 1, 1, 0, 1, 1, 1]
    assert got[6] == (0.0, 106.5, "exit") and got[7] == (1.0, None, "reentry")


def test_wait_for_the_signal_to_turn(spark):
    base = [1, 1, 1, 1, 1, 1, 1, 1, 0, 1]
    rows = [(c, k, float(b), o, h, low, close, atr) for (c, k, _, o, h, low, close, atr), b in zip(bars(CLOSES), base, strict=True)]
    got = run(spark, rows, reentry.AtrStop("trailing", 1.0), "wait_next_entry")
    assert [g[0] for g in got] == [1, 1, 1, 1, 1, 1, 0, 0, 0, 1] and got[9][2] == "entry"


def test_short_side_static_stop_and_gap(spark):
    rows = [("x", 0, -1.0, 100.0, 100.0, 100.0, 100.0, 2.0), ("x", 1, -1.0, 99.0, 103.9, 98.0, 99.0, 2.0), ("x", 2, -1.0, 105.0, 106.0, 104.0, 105.0, 2.0), ("x", 3, 1.0, 105.0, 106.0, 104.0, 105.0, 2.0), ("x", 4, -1.0, 100.0, 100.0, 100.0, 100.0, 2.0), ("x", 5, 0.0, 100.0, 100.0, 100.0, None, 2.0)]
    got = run(spark, rows, reentry.AtrStop("static", 2.0), "reenter")
    assert got == [(-1.0, None, "entry"), (-1.0, None, None), (0.0, 105.0, "exit"), (1.0, None, "entry"), (-1.0, None, "turn"), (0.0, None, "signal")]


def test_r_take_profit_falls_back_from_its_peak(spark):
    highs, lows = [100, 104, 112, 111, 111], [100, 100, 108, 107, 105]
    rows = [("x", k, 1.0, float(low), float(h), float(low), float(low), 5.0) for k, (h, low) in enumerate(zip(highs, lows, strict=True))]
    got = run(spark, rows, reentry.RTakeProfit(1.0, [(1.0, 0.5), (2.0, 0.3)]), "wait_next_entry")
    assert [g[2] for g in got] == ["entry", None, "exit", None, None]  # peak 12 % = 2.4 R: back 30 % of it is 108.4
    assert got[2][1] == pytest.approx(108.0)  # the open lay below


@pytest.mark.parametrize("rule", [reentry.AtrStop("tightening", 2.0, 0.5), reentry.RTakeProfit(1.0, [(1.0, 0.4)])])
def test_no_look_ahead(spark, rule):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(120):
        c = float(100 + 20 * np.sin(k / 7) + rng.normal())
        rows.append(("x", k, float(np.sign(np.sin(k / 20))), c, c + 2, c - 2, c + float(rng.normal()), 2.0))
    whole = run(spark, rows, rule, "reenter")
    changed = rows[:70] + [(*r[:3], *(v * 3 for v in r[3:7]), r[7]) for r in rows[70:]]
    assert run(spark, changed, rule, "reenter")[:70] == whole[:70]
    assert {g[2] for g in whole} >= {"entry", "reentry", "exit"}


TRADE = "account_id int, code string, trade_date date, trade_time string, id long, side string, quantity double, price double, fee double"


def d(m, day=1):
    return dt.date(2020, m, day)


def actions_of(spark):
    changes = spark.createDataFrame([("A", "B", d(3)), ("B", "C", d(6)), ("C", "A", d(11)), (None, "Z", d(1)), ("Q", "Q", d(1))], "code string, new_code string, effective_date date")
    splits = spark.createDataFrame([("B", d(4), 2.0), ("C", d(5), 10.0), ("A", d(2), 3.0)], "code string, effective_date date, ratio double")
    return changes, splits


def test_paths_follow_changes_in_time(spark):
    changes, _ = actions_of(spark)
    got = {(r["code"], r["at_code"], r["from_date"], r["to_date"]) for r in actions.code_paths(changes).collect()}
    assert {g for g in got if g[0] == "A"} == {("A", "A", None, d(3)), ("A", "B", d(3), d(6)), ("A", "C", d(6), d(11)), ("A", "A", d(11), None)}
    assert {g for g in got if g[0] == "B"} == {("B", "B", None, d(6)), ("B", "C", d(6), d(11)), ("B", "A", d(11), None)}
    assert actions.code_paths(changes.limit(0)).count() == 0


def test_fifo_across_a_code_change_with_a_split_between(spark):
    changes, splits = actions_of(spark)
    rows = [(1, "A", d(1), "10", 1, "BUY", 10.0, 12.0, 0.0), (1, "C", d(4), "10", 2, "BUY", 1.0, 50.0, 0.0), (1, "A", d(12), "10", 3, "SELL", 65.0, 4.0, 0.0), (1, "D", d(1), "10", 4, "BUY", 1.0, 1.0, 0.0)]
    out = actions.restated(spark.createDataFrame(rows, TRADE), changes, splits)
    got = {r["id"]: (r["code"], r["quantity"], r["price"]) for r in out.collect()}
    # A's lots: split by 3 as A, by 2 as B (C's split of May is not theirs); C's own: by 10
    assert got == {1: ("A", 60.0, 2.0), 2: ("A", 10.0, 5.0), 3: ("A", 65.0, 4.0), 4: ("D", 1.0, 1.0)}
    pieces = {(r["buy_id"], r["sell_id"]): r["matched"] for r in ledger.fifo(out).collect()}
    assert pieces == {(1, 3): 60.0, (2, 3): 5.0}


def test_dividends_on_what_was_held(spark):
    changes, splits = actions_of(spark)
    cash = spark.createDataFrame([("B", d(5), 1.0), ("A", d(5), 9.0), ("C", d(7), 0.5), ("D", d(2), 2.0), ("D", d(1), 2.0), ("D", d(8), 2.0)], "code string, effective_date date, cash_per_share double")
    rows = [(1, "A", d(1), "10", 1, "BUY", 10.0, 12.0, 0.0), (1, "C", d(6, 9), "10", 2, "BUY", 4.0, 50.0, 0.0), (2, "D", d(1), "10", 4, "BUY", 3.0, 1.0, 0.0), (2, "D", d(7), "10", 5, "SELL", 5.0, 1.0, 0.0)]
    got = {(r["account_id"], r["code"], r["effective_date"]): (r["quantity"], r["cash"]) for r in actions.dividends(spark.createDataFrame(rows, TRADE), changes, splits, cash).collect()}
    assert got == {(1, "A", d(5)): (60.0, 60.0), (1, "A", d(7)): (60.0, 30.0), (1, "C", d(7)): (4.0, 2.0), (2, "D", d(2)): (3.0, 6.0)}
