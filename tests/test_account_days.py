"""Daily values of accounts by groups: against intervals, whatever accounts, amounts, dates and batches are like."""

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelforge.operators import account_days, ledger
from panelforge.plans.registry import QUERIES  # isort: skip
from panelforge.plans.ledger_queries import books  # isort: skip

TRADE = "account_id {}, code string, trade_date date, trade_time string, id long, side string, quantity double, price double, fee double"
PRICES = "code string, trade_date date, close double"


def day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


def ledger_rows(accounts, n=300, scale=1.0):
    rng = np.random.default_rng(9)
    pick = lambda: accounts[int(rng.integers(0, len(accounts)))]
    trades = [(pick(), f"c{rng.integers(0, 5)}", day(int(rng.integers(0, 60))), f"{rng.integers(9, 15):02d}", k, "BUY" if rng.random() < 0.6 else "SELL", float(rng.integers(1, 9999)) / 1000 * scale, float(rng.integers(100, 900)) / 4 * scale, 1.0) for k in range(n)]
    prices = [(f"c{c}", day(int(k)), None if k == 40 else float(rng.integers(100, 90000)) / 400 * scale) for c in range(4) for k in sorted({40, *rng.choice(70, 20, replace=False)}) if c != 1 or k > 30]  # c1 late, c4 never
    return trades, prices


def both(spark, accounts, kind="int", **more):
    trades, prices = ledger_rows(accounts, **more)
    t, p = spark.createDataFrame(trades, TRADE.format(kind)), spark.createDataFrame(prices, PRICES)
    got = ledger.summed_changes(ledger.holding_changes(t, p), "2020-03-31")
    want = ledger.daily_value(ledger.holding_intervals(t, p), "2020-03-31")
    assert got.dtypes == want.dtypes
    key = lambda r: (str(r[0]), r[1])
    return sorted(map(tuple, got.collect()), key=key), sorted(map(tuple, want.collect()), key=key)


def test_accounts_of_any_kind(spark):
    for accounts, kind in (([1, 2, 3, 900], "int"), (["a", "b", None], "string"), ([-(2**63), -5, None, 7, 2**63 - 1], "long"), ([1.5, 2.5], "double")):
        got, want = both(spark, accounts, kind)
        assert got == want and len(got) > 100


def test_amounts_of_any_size(spark):
    for scale in (1e-3, 3e4, 1e6):
        got, want = both(spark, [1, 2], scale=scale)
        assert got == want and len(got) > 100


def test_dates_that_are_not_known(spark):
    """As intervals have it: held since the last price, until the next trade."""
    trades = [(1, "c0", None, "09", 1, "BUY", 5.0, 3.0, 0.0), (1, "c0", day(9), "09", 2, "SELL", 2.0, 3.0, 0.0), (2, "c0", None, "09", 3, "BUY", 4.0, 2.0, 0.0), (3, "c9", None, "09", 4, "BUY", 4.0, 2.0, 0.0)]
    t, p = spark.createDataFrame(trades, TRADE.format("int")), spark.createDataFrame([("c0", day(2), 7.0), ("c0", day(6), 8.0), ("c0", None, 1.0)], PRICES)
    got = ledger.summed_changes(ledger.holding_changes(t, p), "2020-01-12")
    want = ledger.daily_value(ledger.holding_intervals(t, p).where("from_date IS NOT NULL"), "2020-01-12")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 12


def test_groups_of_accounts(spark):
    """Neighbours share a group; a stretch with too many trades, or names, are dealt by hash; an account has one group."""
    cores = spark.sparkContext.defaultParallelism
    near = spark.range(4000 * cores).select((F.col("id") % 1000).alias("account_id"))
    group, n = ledger.account_groups(near)
    found = near.select("account_id", group.alias("g")).groupBy("account_id").agg(F.min("g").alias("g"), F.max("g").alias("most")).orderBy("account_id").collect()
    assert all(r["g"] == r["most"] for r in found) and [r["g"] for r in found] == sorted(r["g"] for r in found)
    assert found[0]["g"] == 0 and found[-1]["g"] == n - 1 and 3 * cores <= n <= 5 * cores
    far = near.union(spark.createDataFrame([(10**15,), (None,)], "account_id long"))
    for frame in (far, near.select(F.col("account_id").cast("string"))):
        group, n = ledger.account_groups(frame)
        sizes = [r["count"] for r in frame.groupBy(group.alias("g")).count().where(f"g >= 0 AND g < {n}").collect()]
        assert sum(sizes) == frame.count() and len(sizes) >= 3 * cores


def test_no_change_is_shuffled(spark):
    """Holdings and prices go to accounts, not a row a holding and price; trades and their prices come from one shuffle."""
    frame = QUERIES["l07_daily_value"](spark, "/root/testdata/sf0.001")
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Generate" not in plan and plan.count("ReusedExchange") == 1
    trades, prices = books(spark, "/root/testdata/sf0.001")
    assert ledger.holding_changes(trades, prices).count() <= trades.count()


def test_batches_and_sums_of_any_length(spark, monkeypatch):
    """Rows cut anywhere, sums taken at any time, prices short or wide: the same days."""
    rng = np.random.default_rng(3)
    lists = {"d": [], "c": []}
    begin, end, leads = [], [], []
    for _ in range(12):
        days = np.sort(rng.choice(200, 15, replace=False)).tolist()
        for k in range(int(rng.integers(1, 9))):
            leads.append(k == 0)
            lists["d"].append(days if k == 0 else None)
            lists["c"].append(rng.integers(1, 10**6, 15).tolist() if k == 0 else None)
            begin.append(int(rng.integers(days[0], 200)))
            end.append(None if rng.random() < 0.5 else begin[-1] + int(rng.integers(1, 60)))
    n = len(leads)
    date = lambda x: pa.array(x, pa.int32()).cast(pa.date32())
    columns = [
        pa.array(rng.integers(0, 4, n)), date(begin), date(end), pa.array(rng.integers(-(10**6), 10**6, n)), pa.array(rng.integers(0, 10**6, n).tolist()).cast(pa.decimal128(28, 6)), pa.array(leads),
    ]
    of = lambda x, held, kind: pa.array([v if h else None for v, h in zip(x, held, strict=True)], pa.list_(kind))

    def rows_of(slim):
        wide = [not x for x in slim]
        prices = [date([3] * n), of([v and [x - 3 for x in v] for v in lists["d"]], slim, pa.int16()), of(lists["c"], slim, pa.int32()), of(lists["d"], wide, pa.int32()).cast(pa.list_(pa.date32())), of(lists["c"], wide, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *prices], list("abcdefghijk"))

    def days_of(step, kept, slim):
        monkeypatch.setattr(account_days, "_KEPT", kept)
        group, rows = account_days._Group(), rows_of(slim)
        for k in range(0, n, step):
            group.add(rows.slice(k, step))
        names, found = list(group.accounts), [np.concatenate(c) for c in zip(*group.days(250), strict=True)]
        return sorted(zip([names[a] for a in found[0]], *(c.tolist() for c in found[1:]), strict=True))

    mixed = [bool(x) for x in rng.integers(0, 2, n)]
    want = days_of(n, 10**6, [True] * n)
    assert len(want) > 500 and all(days_of(*how) == want for how in ((1, 10**6, mixed), (5, 7, [False] * n), (n, 40, mixed)))


def test_prices_far_apart_or_large(spark):
    """Where six bytes do not hold a price."""
    trades = [(1, "c0", dt.date(1700, 1, 1), "09", 1, "BUY", 2.0, 3.0, 0.0), (2, "c1", day(1), "09", 2, "BUY", 3.0, 2.0, 0.0), (2, "c2", day(1), "09", 3, "BUY", 4.0, 2.0, 0.0)]
    prices = [("c0", dt.date(1700, 1, 1), 5.0), ("c0", day(1), 6.0), ("c1", day(0), 1e9), ("c1", day(2), 1e9 + 0.0001), ("c2", day(0), 7.0), ("c2", day(2), 8.0)]
    t, p = spark.createDataFrame(trades, TRADE.format("int")), spark.createDataFrame(prices, PRICES)
    got = {(r["account_id"], r["trade_date"]): r["value"] for r in ledger.summed_changes(ledger.holding_changes(t, p), "2020-01-03").collect()}
    assert got[(1, dt.date(2020, 1, 1))] == 10 and got[(1, day(1))] == 12 and got[(2, day(1))] == 3e9 + 28 and got[(2, day(2))] == 3e9 + 32.0003
    assert len(got) == (dt.date(2020, 1, 4) - dt.date(1700, 1, 1)).days + 2
