"""Admission of positions under a cap on the sum of weights, date by date."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.ordered import dated_scan

POLICIES = ("scale", "skip", "replace", "leverage")
EPS = 1e-12


class Book:
    """Positions of one strategy: code -> [weight, price at entry, day of entry]."""

    def __init__(self, cap: float, most: float):
        self.cap, self.most, self.held, self.day = cap, most, {}, 0

    def total(self) -> float:
        return sum(h[0] for h in self.held.values())

    def scaled(self, to: float) -> None:
        total = self.total()
        if total > to + EPS:
            for h in self.held.values():
                h[0] *= to / total

    def worst(self, prices: dict[str, float | None]) -> str | None:
        """The position with the lowest return since entry (unknown ones last), then the oldest, then by code."""

        def rank(code: str) -> tuple[float, int, str]:
            _, paid, day = self.held[code]
            now = prices.get(code)
            return (now / paid - 1 if now and paid and now > 0 and paid > 0 else float("inf"), day, code)

        return min(self.held, key=rank, default=None)

    def step(self, rows: list[tuple]) -> list[tuple]:
        """rows (code, active, target, price, policy) of a date by score -> (weight, event, multiple) of each."""
        self.day += 1
        prices = {code: price for code, _, _, price, _ in rows}
        events: dict[str, list[str]] = defaultdict(list)
        for code, active, *_ in rows:
            if not active and self.held.pop(code, None):
                events[code].append("exit")
        for code, active, target, price, policy in rows:
            if not active or code in self.held or not target or target <= 0:
                continue
            over = self.total() + target > self.cap + EPS
            if over and policy == "skip":
                events[code].append("skip")
                continue
            gone = self.worst(prices) if over and policy == "replace" else None
            if gone:
                del self.held[gone]
                events[gone].append("replaced")
            self.held[code] = [target, price, self.day]
            events[code] += [f"enter_{policy}" if over else "enter", *(["evicts"] if gone else [])]
            if over:
                self.scaled(self.most if policy == "leverage" else self.cap)
        multiple = self.total()
        return [(self.held[code][0] if code in self.held else 0.0, "+".join(events[code]) or None, multiple) for code, *_ in rows]


def admitted(df: DataFrame, keys: tuple[str, ...], cap: float = 1.0, most: float = 2.0) -> DataFrame:
    """df plus weight, event and multiple: which positions a strategy holds when the sum of weights has a cap.

    df has (keys, trade_date, code, active, target, price, score, policy). A
    position enters at its target weight on a date on which it is active and not
    held, by falling score, and leaves when a row says that it is not active; a
    code without a row stays as it is. An entry that would lift the sum above cap
    follows the policy: scale all to the cap; skip the entry (a later, smaller one
    may still fit); replace the position with the lowest return since its entry
    (then scale if need be); or leverage up to `most`. event is what happened to the
    code on the date, joined by plus signs: enter, enter_<policy> (above the cap),
    evicts (another one, which may have no row on the date), skip, replaced, exit;
    null if nothing did. multiple is the sum after the date.
    """
    return dated_scan(df, ["code", "active", "target", "price", "policy"], {"weight": "double", "event": "string", "multiple": "double"}, lambda: Book(cap, most).step, keys, ("-score", "code"))


def admission_summary(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, entries, skipped, replaced, over_cap, largest): counts of events and the largest multiple."""
    count = lambda what: F.coalesce(F.sum(F.regexp_count("event", F.lit(what))), F.lit(0)).cast("long")
    return rows.groupBy(*keys).agg(count("enter").alias("entries"), count("skip").alias("skipped"), count("evicts").alias("replaced"), count("enter_").alias("over_cap"), F.max("multiple").alias("largest"))
