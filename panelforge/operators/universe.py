"""Weights over a universe that changes inside a rebalance period."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelforge.functions.ordered import dated_scan

EPS = 1e-12


class Universe:
    """The drifted weights of one strategy and the period they belong to."""

    def __init__(self, least: int):
        self.least, self.period, self.before = least, None, {}

    def step(self, rows: list[tuple]) -> list[tuple[float, bool]]:
        """rows (code, return, target, period) of a date -> (weight, reset) of each."""
        active = {code: (r, target or 0.0) for code, r, target, _ in rows if r is not None}
        period = rows[0][3]
        reset, self.period = period != self.period, period
        if len(active) < self.least:
            self.before = {}
            return [(0.0, reset)] * len(rows)
        w = {c: max(0.0, t) if reset else self.before.get(c, 0.0) for c, (_, t) in active.items()}
        total = sum(w.values())
        w = {c: x / total if total > EPS else 1.0 / len(active) for c, x in w.items()}
        grown = {c: x * (1 + active[c][0]) for c, x in w.items()}
        total = sum(grown.values())
        self.before = {c: x / total if total > EPS else 1.0 / len(active) for c, x in grown.items()}
        return [(w.get(code, 0.0), reset) for code, *_ in rows]


def dynamic_weights(df: DataFrame, period: str, r: str = "r", target: str = "w0", least: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """df plus w (weight in force for the date's return) and reset, over the codes that have a return on the date.

    On the first date of a period the targets of the active codes are scaled to
    one. Inside it weights drift with returns; whenever codes go or come, what the
    active ones have is scaled to one again, so a code that comes in mid-period
    waits with weight zero for the next period, and one that goes leaves its share
    to the others. Fewer than `least` active codes make the date cash, and what
    follows inside the period begins with equal weights, as do active codes that
    have no weight among them. Missing targets count as zero.
    """
    return dated_scan(df, ["code", r, target, period], {"w": "double", "reset": "boolean"}, lambda: Universe(least).step, keys, ("code",))
