"""Exits that decide by themselves when a position may begin again: stops and profit takers over a base signal, long and short.

With `reenter` a position begins again on the first day after an exit on which
the base signal still stands; with `wait_next_entry` only when the signal turns
anew. So positions are no runs of the base signal, and what ends one decides
when the next begins: an automaton passes each series once, in order, and keeps
a few numbers. A day's exit uses only lines set before its bar, and its entry
the day's close; the position of a row holds from the next bar on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelforge.functions.frames import KEYS
from panelforge.functions.ordered import ordered_scan

MODES = ("reenter", "wait_next_entry")
BAR = ["open", "high", "low", "close"]


class AtrStop:
    """Stop at k ATR behind the entry (static), behind the best close - k ATR so far (trailing), or with k falling by `tighten` for each ATR gained (tightening, never below `least`)."""

    def __init__(self, kind: str, k: float, tighten: float = 0.0, least: float = 0.5):
        if kind not in ("static", "trailing", "tightening"):
            raise ValueError(f"unknown kind {kind!r}")
        self.kind, self.k, self.tighten, self.least = kind, k, tighten, least

    def enter(self, side: int, close: float, atr: float | None) -> None:
        self.side, self.entry, self.atr, self.best = side, close, atr, close
        self.line = close - side * self.k * atr if atr is not None else None

    def leave(self, o: float, h: float, low: float, close: float, atr: float | None) -> float | None:
        """The fill, if the bar crosses the line: the worse of line and open."""
        if self.line is None:
            return None
        if self.side > 0:
            return min(self.line, o) if low < self.line else None
        return max(self.line, o) if h > self.line else None

    def stay(self, o: float, h: float, low: float, close: float, atr: float | None) -> None:
        if self.kind == "static" or atr is None:
            return
        self.best = max(self.best, close) if self.side > 0 else min(self.best, close)
        width = self.k
        if self.kind == "tightening" and self.atr:
            width = max(self.least, self.k - self.tighten * max(0.0, self.side * (self.best - self.entry) // self.atr))
        line = close - self.side * width * atr
        self.line = line if self.line is None else max(self.line, line) if self.side > 0 else min(self.line, line)


class RTakeProfit:
    """Exit when the profit falls back from its peak by a share that depends on the highest tier (in R = k ATR at entry) reached; armed two bars after the entry."""

    def __init__(self, k: float, tiers: list[tuple[float, float]]):
        self.k, self.tiers, self.line = k, sorted(tiers), None

    def enter(self, side: int, close: float, atr: float | None) -> None:
        self.side, self.entry, self.bars, self.peak = side, close, 0, 0.0
        self.risk = self.k * atr / close if atr else None
        self.line = None

    def leave(self, o: float, h: float, low: float, close: float, atr: float | None) -> float | None:
        self.bars += 1
        best, worst = (h, low) if self.side > 0 else (low, h)
        self.peak = max(self.peak, self.side * (best / self.entry - 1))
        share = None
        for r, s in self.tiers:
            if self.risk and self.peak / self.risk >= r:
                share = s
        if share is None:
            return None
        self.line = self.entry * (1 + self.side * self.peak * (1 - share))
        if self.bars < 2 or self.side * (worst / self.entry - 1) > self.peak * (1 - share):
            return None
        return min(self.line, o) if self.side > 0 else max(self.line, o)

    def stay(self, *bar: float | None) -> None:
        pass


class Machine:
    """The automaton of one series."""

    def __init__(self, rule: AtrStop | RTakeProfit, mode: str | None):
        self.rule, self.mode = rule, mode
        self.side, self.before, self.locked = 0, 0, False

    def step(self, signal: float | None, o, h, low, close, atr, mode: str | None = None) -> tuple[float, float | None, float | None, str | None]:
        want = 0 if not signal else 1 if signal > 0 else -1
        fresh, self.before = want != 0 and want != self.before, want
        usable = close is not None and close > 0
        if usable:
            o, h, low = (close if x is None else x for x in (o, h, low))
        event = None
        if self.side and want != self.side:
            self.side, event = 0, "signal"
        elif self.side:
            if not usable:
                return float(self.side), None, None, None
            line = self.rule.line
            fill = self.rule.leave(o, h, low, close, atr)
            if fill is not None:
                self.side, self.locked = 0, (self.mode or mode) == "wait_next_entry"
                return 0.0, self.rule.line if isinstance(self.rule, RTakeProfit) else line, fill, "exit"
            self.rule.stay(o, h, low, close, atr)
            return float(self.side), line, None, None
        if not want or not usable or (self.locked and not fresh):
            return 0.0, None, None, event
        self.side, self.locked = want, False
        self.rule.enter(want, close, atr)
        return float(want), None, None, "turn" if event else "entry" if fresh else "reentry"


def with_exits(df: DataFrame, signal: str, rule: AtrStop | RTakeProfit, mode: str = "reenter", atr: str = "atr", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """df plus position (1, 0, -1 from the next bar on), line (in force on the bar), fill (of the bar's exit) and event.

    df has (keys, trade_date, open, high, low, close), a base signal by sign and
    the ATR. Event is entry (the signal turned), reentry, exit (the rule), signal
    (the base signal went), turn (it went to the other side, which is entered on the
    same close), or null. mode is one of MODES, or the name of a column that
    holds one. A bar without a close changes nothing; a missing open, high or low
    counts as the close; without an ATR at entry there is no line yet.
    """
    from copy import copy

    fixed = mode if mode in MODES else None
    inputs = [signal, *BAR, atr, *([] if fixed else [mode])]
    return ordered_scan(df, inputs, {"position": "double", "line": "double", "fill": "double", "event": "string"}, lambda: Machine(copy(rule), fixed).step, keys)
