"""Daily figures of accounts from holdings and prices, a group of accounts at a time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No holding's end, and how many changes are kept before they are summed up.
_FAR, _KEPT = 2**31, 1_000_000


def _whole(column: pa.Array) -> np.ndarray:
    """Decimals as whole numbers of their last place: 64 bits wide where they fit, else Python's."""
    low, high = np.frombuffer(column.buffers()[1], np.int64).reshape(-1, 2)[column.offset : column.offset + len(column)].T
    if (low >> 63 == high).all():
        return low
    return high.astype(object) * 2**64 + (low.astype(object) & (2**64 - 1))


def _doubles(millionths: np.ndarray) -> np.ndarray:
    """The nearest doubles: a division of two numbers that doubles hold, or Python's."""
    if millionths.dtype != object and (len(millionths) == 0 or max(-millionths.min(), millionths.max()) < 2**53):
        return millionths / 1e6
    return np.array([x / 10**6 for x in millionths.tolist()], np.float64)


def _prices(since: pa.Array, short: pa.ListArray, small: pa.ListArray, days: pa.ListArray, closes: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Prices a row, and the days, closes and whether they are known of all: from short and small numbers, or from days and closes."""
    sizes = [np.diff(x.offsets.to_numpy()) for x in (short, days)]
    origin = since.cast(pa.int32()).cast(pa.int64()).fill_null(0).to_numpy()
    day = np.repeat(origin, sizes[0]) + short.flatten().to_numpy(), days.flatten().cast(pa.int32()).to_numpy().astype(np.int64)
    close = [x.flatten().cast(pa.int64()) for x in (small, closes)]
    found = [np.concatenate(c) for c in (day, [x.fill_null(0).to_numpy() for x in close], [x.is_valid().to_numpy(zero_copy_only=False) for x in close])]
    if sizes[1].any():
        order = np.argsort(np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes]), kind="stable")
        found = [x[order] for x in found]
    return sum(sizes), *found


class _Sums:
    """Exact sums by account and day: 64 bits wide, unless an account's amounts could exceed them."""

    def __init__(self) -> None:
        self.keys, self.sums, self.parts, self.most = np.empty(0, np.int64), np.empty(0, np.int64), [], np.zeros(0)

    def reach(self, account: np.ndarray, amounts: np.ndarray) -> None:
        """The accounts' sums may grow by these amounts, either way."""
        grown = np.bincount(account, np.abs(amounts).astype(np.float64), len(self.most))
        grown[: len(self.most)] += self.most
        self.most = grown

    def add(self, account: np.ndarray, day: np.ndarray, x: np.ndarray) -> None:
        self.parts.append((account << 32 | day + _FAR, x.astype(object) if self.most.max(initial=0) > 4e18 else x))
        if sum(len(k) for k, _ in self.parts) > _KEPT:
            self.settle()

    def settle(self) -> None:
        keys, x = (np.concatenate(c) for c in zip((self.keys, self.sums), *self.parts, strict=True))
        order = np.argsort(keys)
        keys = keys[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        self.keys, self.sums, self.parts = keys[at], np.add.reduceat(x[order], at) if len(at) else x, []

    def running(self, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Running sums at all of `keys`, from each account's first place on."""
        x = np.zeros(len(keys) + 1, self.sums.dtype)
        x[np.searchsorted(keys, self.keys) + 1] = self.sums
        x = np.cumsum(x)  # what leaves 64 bits from account to account comes back
        return x[1:] - np.repeat(x[first], np.diff(np.append(first, len(keys))))


class _Group:
    """Accounts of a group: their changes by day, and the last prices read."""

    def __init__(self) -> None:
        self.accounts: dict = {}
        self.value, self.cost, self.held, self.missing = sums = tuple(_Sums() for _ in range(4))
        self.sums = sums
        self.path = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))

    def add(self, rows: pa.RecordBatch) -> None:
        """Rows (account, _from, _to, _units, cost, _leads, then the prices): a row that leads brings the prices of those after it."""
        names = rows.column(0).dictionary_encode("encode")
        account = np.array([self.accounts.setdefault(a, len(self.accounts)) for a in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
        begin, end = (rows.column(c).cast(pa.int32()).cast(pa.int64()).fill_null(_FAR).to_numpy() for c in (1, 2))
        units, cost, leads = rows.column(3).to_numpy(), _whole(rows.column(4)), rows.column(5).to_numpy(zero_copy_only=False)
        n, *brought = _prices(*rows.columns[6:])
        starts = np.append(0, len(self.path[0]) + (np.cumsum(n) - n)[leads])
        day, close, known = (np.concatenate(c) for c in zip(self.path, brought, strict=True))
        ends = np.append(starts[1:], len(day))
        self.path = tuple(c[starts[-1] :].copy() for c in (day, close, known))
        # prices of a path are ordered by day, paths by number: one search finds each holding's
        path, span = np.cumsum(leads), 2**33
        order = np.repeat(np.arange(len(starts)), ends - starts) * span + day
        start, stop = starts[path], ends[path]
        undated = begin == _FAR  # held since the last price
        begin = np.where(undated & (stop > start), np.append(day, _FAR)[stop - 1], begin)
        low, high = np.searchsorted(order, path * span + begin, "right"), np.searchsorted(order, path * span + end, "left")
        kept = np.flatnonzero(begin < end)
        day, close, known = np.append(day, 0), np.append(close, 0), np.append(known, False)
        n = np.cumsum(high[kept] - low[kept] + 1)
        for part in np.split(kept, np.searchsorted(n, np.arange(_KEPT, n[-1], _KEPT))) if len(kept) else ():
            self._change(account[part], begin[part], end[part], units[part], cost[part], low[part], high[part], start[part], day, close, known)

    def _change(self, account: np.ndarray, begin: np.ndarray, end: np.ndarray, units: np.ndarray, cost: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, day: np.ndarray, close: np.ndarray, known: np.ndarray) -> None:
        if not len(account):
            return
        n = high - low + 1  # the price at the holding's begin, and those in it
        head = np.cumsum(n) - n
        tail, closed = head + n - 1, np.flatnonzero(end < _FAR)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) + np.repeat(low - 1 - head, n)
        valued = known[at] & (at >= start[row])
        most = np.abs(close[low.min() - 1 if low.min() else 0 : high.max() + 1].astype(np.float64)).max(initial=0)
        amounts = np.abs(units.astype(np.float64)) * most
        each = units.astype(object) if amounts.max() > 9e18 else units
        worth = np.where(valued, each[row] * close[at], 0)
        worth = np.where(worth < 0, -1, 1) * ((np.abs(worth) + 50) // 100)  # rounded to millionths
        self.value.reach(account, amounts / 100 + 1)
        self.cost.reach(account, cost)
        when = day[at]
        when[head] = begin
        owner, gone = account[row], account[closed]
        change, lost = worth.copy(), ~valued
        change[1:] -= worth[:-1]
        change[head] = worth[head]
        shift = lost.astype(np.int64)
        shift[1:] -= lost[:-1]
        shift[head] = lost[head]
        moved = np.flatnonzero(shift)
        one = np.ones(len(account), np.int64)
        self.value.add(owner, when, change)
        self.missing.add(owner[moved], when[moved], shift[moved])
        self.cost.add(account, begin, cost)
        self.held.add(account, begin, one)
        for total, x in ((self.value, worth[tail[closed]]), (self.missing, lost[tail[closed]].astype(np.int64)), (self.cost, cost[closed]), (self.held, one[closed])):
            total.add(gone, end[closed], -x)

    def days(self, last: int) -> Iterator[tuple]:
        """(account's place, day, value, cost, n_held, n_missing), from the account's first change to the last day."""
        for s in self.sums:
            s.settle()
        keys = np.unique(np.concatenate([s.keys for s in self.sums]))
        account, day = keys >> 32, (keys & (2**32 - 1)) - _FAR
        first = np.flatnonzero(np.append(True, account[1:] != account[:-1])[: len(keys)])
        until = np.append(day[1:], last + 1)[: len(keys)]
        until[first[1:] - 1] = last + 1
        until = np.minimum(until, last + 1)
        n = np.cumsum(np.maximum(until - day, 0))
        value, cost, held, missing = (s.running(keys, first) for s in self.sums)
        value, cost = _doubles(value), _doubles(cost)
        for k in range(0, int(n[-1]) if len(n) else 0, 2**16):
            place = np.arange(k, min(k + 2**16, n[-1]))
            at = np.searchsorted(n, place, "right")
            yield account[at], until[at] - (n[at] - place), value[at], cost[at], held[at], missing[at]


def account_days(rows: DataFrame, last_day: str, account: str) -> DataFrame:
    """(account, trade_date, value, cost, n_held, n_missing) of every calendar day.

    rows (_group, account, _from, _to, _units, cost, _leads, _path, _wide) come
    group by group, prices before the holdings that have them. A task keeps the
    sums by account and day of one group and one code's prices.
    """
    last, kind = (dt.date.fromisoformat(last_day) - dt.date(1970, 1, 1)).days, rows.schema[account].dataType.simpleString()
    names = [account, "trade_date", "value", "cost", "n_held", "n_missing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, typed = None, _Group(), None

        def worked(group: _Group) -> Iterator[pa.RecordBatch]:
            owners = pa.array(list(group.accounts), typed)
            for at, day, *figures in group.days(last):
                yield pa.RecordBatch.from_arrays([owners.take(pa.array(at)), pa.array(day, pa.int32()).cast(pa.date32()), *map(pa.array, figures)], names)

        for b in batches:
            of = b.column(0).to_numpy()
            for low, high in pairwise([0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]):
                if high > low and of[low] != now:
                    yield from worked(group)
                    now, group, typed = of[low], _Group(), b.column(1).type
                group.add(pa.RecordBatch.from_arrays(b.slice(low, high - low).columns[1:], b.schema.names[1:]))
        yield from worked(group)

    lists = [F.coalesce(c, F.array().cast(item)).alias(c.partition(".")[2]) for c, item in (("_path.short", "array<short>"), ("_path.small", "array<int>"), ("_wide.days", "array<date>"), ("_wide.closes", "array<long>"))]  # Arrow's writer is slow on long runs of null lists
    return rows.select("_group", account, "_from", "_to", "_units", "cost", "_leads", "_path._since", *lists).mapInArrow(run, f"`{account}` {kind}, trade_date date, value double, cost double, n_held long, n_missing long")
