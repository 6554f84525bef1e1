"""The configuration linear program over a histogram of lengths, by multiplicative weights.

Find amounts x >= 0 of configurations (multisets of lengths that fit a
sequence) that cover every length as often as it is counted, with the least
sum. Each length has a weight, which makes its price: its length times
exp(rate * (what is left of it / what is left on average - 1)). A round prices
configurations by a knapsack dynamic program: its table gives the configuration
worth most, and for each length the best one that holds it. Those worth nearly
as much as the best are taken in amounts that cover a small step of each length;
lengths that are covered faster than others lose weight. At any prices, what all
pieces are worth over what the best configuration is worth is a lower bound of
the optimum; `bound` is that of the averaged prices, or all tokens over capacity.

Rounding: amounts go down to whole numbers. The pieces left are dealt by the
averaged prices, times weights that still fall as a length is used up: a knapsack
bounded by what is left, taken as often as it fits, until nothing is left. Work depends on the number of lengths (at most
`capacity`), not on the number of pieces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

Config = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Plan:
    """Configurations (length -> pieces of it) and how many sequences take each; bound: no plan takes fewer; by_program: pieces in rounded amounts of the linear program."""

    configs: list[dict[int, int]]
    times: list[int]
    bound: int
    by_program: int


class Knapsack:
    """Best worth of every capacity when lengths may repeat, and the configurations behind it.

    With jitter (a vector longer than lengths and capacity together) each capacity
    takes one of its nearly best choices; best is what its configuration is worth.
    """

    def __init__(self, price: np.ndarray, lengths: np.ndarray, capacity: int, jitter: np.ndarray | None = None):
        self.lengths, self.capacity = lengths.tolist(), capacity
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
        for c in range(int(lengths[0]), capacity + 1):
            worth = best[c - lengths[: fits[c]]] + price[: fits[c]]
            k = int((worth if jitter is None else worth + jitter[c : c + fits[c]]).argmax())
            best[c] = best[c - 1]
            if worth[k] > best[c]:
                best[c], last[c] = worth[k], k
        self.best, self.last = best, last.tolist()
        self.down = np.maximum.accumulate(np.where(last >= 0, np.arange(capacity + 1), 0)).tolist()  # the capacity that is used up

    def config(self, room: int, more: int = -1) -> dict[int, int]:
        """Places in lengths -> repeats of the best configuration within room, and one piece more."""
        out = {more: 1} if more >= 0 else {}
        c = self.down[room]
        while c:
            k = self.last[c]
            out[k] = out.get(k, 0) + 1
            c = self.down[c - self.lengths[k]]
        return out


def fractional(counts: dict[int, int], capacity: int, rounds: int | None = None, rate: float = 2.0, near: float = 0.01, fill: float = 4.0, noise: float = 0.002) -> tuple[dict[Config, float], np.ndarray, float]:
    """(amounts of configurations, price of each length in ascending order, lower bound); no length is covered more often than counted, few less."""
    lengths = np.array(sorted(counts))
    demand = np.array([counts[int(n)] for n in lengths], float)
    rounds = rounds or int(np.clip(60_000 // len(lengths), 120, 400))
    left = demand.copy()
    amounts: dict[Config, float] = {}
    step = 1.0 / rounds
    averaged = np.zeros(len(lengths))
    rng = np.random.default_rng(5)
    for turn in range(4 * rounds):
        open_ = np.flatnonzero(left > 1e-9 * demand)
        if not len(open_):
            break
        rest = (left / demand)[open_]
        price = lengths[open_] * np.exp(rate * np.minimum(rest / rest.mean() - 1, 10.0))
        worth = price[-1] * capacity / lengths[open_[-1]]  # about a full sequence's
        table = Knapsack(price, lengths[open_], capacity, noise * worth * rng.random(len(lengths) + capacity + 1))  # else ties fall to the same lengths
        top = float(table.best.max())
        if len(open_) == len(lengths):
            averaged += price / top
        target, room = np.minimum(step * demand, left)[open_], np.minimum(fill * step * demand, left)[open_]  # what this round should and may cover
        before, least = room.copy(), (1 - near * max(1, 2 * (turn // rounds))) * top  # late rounds take more
        for k in np.argsort(-rest, kind="stable").tolist():
            if target[k] <= 0 or price[k] + table.best[capacity - table.lengths[k]] < least:
                continue
            config = table.config(capacity - table.lengths[k], k)
            x = min(target[k] / config[k], min(room[i] / a for i, a in config.items()))
            if x > 1e-9 * demand[open_[k]]:
                key = tuple(sorted((table.lengths[i], a) for i, a in config.items()))
                amounts[key] = amounts.get(key, 0.0) + x
                for i, a in config.items():
                    room[i] -= a * x
                    target[i] -= a * x
        left[open_] -= before - room
    averaged /= float(Knapsack(averaged, lengths, capacity).best[-1])
    return amounts, averaged, max(float(averaged @ demand), float(lengths @ demand) / capacity)  # prices of lengths alone are feasible too


def bounded(price: np.ndarray, lengths: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """Places in lengths -> repeats of the configuration worth most that holds no length more often than is left."""
    parts = [(k, 1 << b if (2 << b) <= n + 1 else n + 1 - (1 << b)) for k, n in enumerate(np.minimum(left, capacity // lengths).tolist()) for b in range(n.bit_length())]
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(parts), capacity + 1), bool)
    for p, (k, m) in enumerate(parts):
        size = m * int(lengths[k])
        if size <= capacity:
            worth = best[: capacity + 1 - size] + m * price[k]
            np.greater(worth, best[size:], out=taken[p, size:])
            np.maximum(best[size:], worth, out=best[size:])
    out: dict[int, int] = {}
    c = capacity
    for p in range(len(parts) - 1, -1, -1):
        if taken[p, c]:
            k, m = parts[p]
            out[k] = out.get(k, 0) + m
            c -= m * int(lengths[k])
    return out


def plan(counts: dict[int, int], capacity: int = 1024, long: float = 0.05, rate: float = 0.02) -> Plan:
    """Whole configurations that hold exactly the counted pieces."""
    if not counts:
        return Plan([], [], 0, 0)
    amounts, price, bound = fractional(counts, capacity)
    left = dict(counts)
    configs: list[dict[int, int]] = []
    times: list[int] = []
    worth = dict(zip(sorted(counts), price.tolist(), strict=True))
    for key, x in sorted(amounts.items(), key=lambda t: (-t[1], t[0])):
        m = min(math.floor(x + 1e-9), *(left[n] // a for n, a in key))
        if m:
            configs.append(dict(key))
            times.append(m)
            for n, a in key:
                left[n] -= m * a
    by_program = sum(m * sum(c.values()) for c, m in zip(configs, times, strict=True))
    left = {n: m for n, m in left.items() if m}
    while left:
        lengths = np.array(sorted(left))
        own = np.array([worth[int(n)] * (1 + long * n / capacity) * math.exp(rate * (left[n] / counts[n] - 1)) for n in lengths.tolist()])
        found = bounded(own, lengths, np.array([left[int(n)] for n in lengths]), capacity)
        config = {int(lengths[k]): a for k, a in found.items()}
        m = min(left[n] // a for n, a in config.items())
        configs.append(config)
        times.append(m)
        for n, a in config.items():
            left[n] -= m * a
            if not left[n]:
                del left[n]
    return Plan(configs, times, math.ceil(bound - 1e-6), by_program)
