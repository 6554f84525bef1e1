"""Repo closes against a walk over lots: named ones first, then the oldest."""

import datetime as dt

import numpy as np
import pytest

from panelforge.operators import repo_lots

LOT = "account_id int, code string, id long, trade_date date, principal double, rate_pct double, interest_days int, basis int, fee double"
CLOSE = "account_id int, code string, id long, trade_date date, principal double, open_id long"


def day(k):
    return dt.date(2021, 1, 1) + dt.timedelta(days=k)


def walk(lots, closes):
    left = {x[2]: x[4] for x in lots}
    order = lambda x: (x[3], x[2])
    out = {}
    for named in (True, False):
        for c in sorted((c for c in closes if (c[5] is not None) == named), key=order):
            need = c[4]
            for x in sorted((x for x in lots if x[:2] == c[:2] and order(x) < order(c) and (not named or x[2] == c[5])), key=order):
                take = min(need, left[x[2]])
                if take > 0:
                    out[(x[2], c[2])] = (named, take)
                    left[x[2]] -= take
                    need -= take
    return out, left


def rows(seed):
    rng = np.random.default_rng(seed)
    lots = [(int(rng.integers(0, 3)), "R", 10 * k, day(int(rng.integers(0, 40))), float(rng.integers(1, 20)), 2.0, int(rng.integers(0, 3)) * 7, 365, 1.0) for k in range(40)]
    closes = [(int(rng.integers(0, 3)), "R", 10 * k + 5, day(int(rng.integers(0, 60))), float(rng.integers(1, 15)), 10 * int(rng.integers(0, 45)) if rng.random() < 0.5 else None) for k in range(40)]
    return lots, closes


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_against_a_walk(spark, seed):
    lots, closes = rows(seed)
    lf, cf = spark.createDataFrame(lots, LOT), spark.createDataFrame(closes, CLOSE)
    pieces = repo_lots.matched(lf, cf)
    got = {(r["open_id"], r["close_id"]): r for r in pieces.collect()}
    want, left = walk(lots, closes)
    assert {k: (r["named"], r["matched"]) for k, r in got.items()} == want
    assert min(left.values()) >= 0 and any(n for n, _ in want.values()) and not all(n for n, _ in want.values())
    terms, ends = {x[2]: x for x in lots}, {c[2]: c for c in closes}
    for (o, c), r in got.items():
        days = terms[o][6] or (ends[c][3] - terms[o][3]).days + 1
        assert r["interest"] == pytest.approx(r["matched"] * 0.02 * days / 365) and r["fee"] == pytest.approx(r["matched"] / terms[o][4])
    found = {c: sum(m for (_, k), (_, m) in want.items() if k == c) for c in ends}
    assert {r["id"]: r["missing"] for r in repo_lots.unmatched(cf, pieces).collect()} == {c: ends[c][4] - f for c, f in found.items() if ends[c][4] > f}


def test_nothing_lent(spark):
    closes = spark.createDataFrame([(1, "R", 5, day(1), 3.0, None), (1, "R", 6, day(1), 3.0, 77)], CLOSE)
    pieces = repo_lots.matched(spark.createDataFrame([], LOT), closes)
    assert pieces.count() == 0 and {r["missing"] for r in repo_lots.unmatched(closes, pieces).collect()} == {3.0}
