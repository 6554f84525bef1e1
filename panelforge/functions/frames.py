"""Window frames over long panels (keys..., code, trade_date, values)."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("code",)


def series(keys: tuple[str, ...] = KEYS, order: str = "trade_date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def day(keys: tuple[str, ...] = (), order: str = "trade_date") -> WindowSpec:
    """The cross-section of a date."""
    return Window.partitionBy(*keys, order)


def roll(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def prior(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the current one."""
    return w.rowsBetween(-n, -1)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def enough(x: Column, value: Column, frame: WindowSpec, least: int) -> Column:
    """value where at least `least` non-null x lie in the frame, else null."""
    return F.when(F.count(x).over(frame) >= least, value)


def clean(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ret(x: str | Column, w: WindowSpec, n: int = 1) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.try_divide(x, F.lag(x, n).over(w)) - 1


def run_id(state: Column, w: WindowSpec) -> Column:
    """Number of the run of equal states (needs a projected state column)."""
    return F.sum(F.when(state.eqNullSafe(F.lag(state).over(w)), 0).otherwise(1)).over(upto(w))


def latch(enter: Column, leave: Column, w: WindowSpec) -> Column:
    """1 from enter until leave, else 0; enter wins on a row with both."""
    return F.coalesce(F.last(F.when(enter, 1).when(leave, 0), ignorenulls=True).over(upto(w)), F.lit(0))
