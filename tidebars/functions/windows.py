"""Rolling expressions within continuity runs; a value needs a complete window, else it is NULL.

All share one partitioning and order, so a plan with many of them has one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

def by_run() -> WindowSpec:
    """Bars of a continuity run in order."""
    return Window.partitionBy("run_id").orderBy("bar_id")


def frame(n: int, over: WindowSpec | None = None) -> WindowSpec:
    """The last n rows, this one included; of the run, unless told otherwise."""
    return (over or by_run()).rowsBetween(-(n - 1), 0)


def complete(aggregate: Callable[[Column], Column], x: Column, n: int, over: WindowSpec | None = None) -> Column:
    """aggregate(x) over the last n rows, where all n have a value."""
    w = frame(n, over)
    return F.when(F.count(x).over(w) == n, aggregate(x).over(w))


def rsum(x: Column, n: int, over: WindowSpec | None = None) -> Column:
    return complete(F.sum, x, n, over)


def rmean(x: Column, n: int, over: WindowSpec | None = None) -> Column:
    return complete(F.avg, x, n, over)


def rstd(x: Column, n: int, over: WindowSpec | None = None) -> Column:
    """Population standard deviation."""
    return complete(F.stddev_pop, x, n, over)


def rmax(x: Column, n: int, over: WindowSpec | None = None) -> Column:
    return complete(F.max, x, n, over)


def rmin(x: Column, n: int, over: WindowSpec | None = None) -> Column:
    return complete(F.min, x, n, over)


def lag(x: Column, k: int = 1, over: WindowSpec | None = None) -> Column:
    return F.lag(x, k).over(over or by_run())


def rcorr(x: Column, y: Column, n: int, over: WindowSpec | None = None) -> Column:
    """Pearson correlation in [-1, 1]; NULL where either side doesn't vary."""
    w = frame(n, over)
    both = F.when(x.isNotNull() & y.isNotNull(), 1)
    varies = (F.max(x).over(w) > F.min(x).over(w)) & (F.max(y).over(w) > F.min(y).over(w))
    return F.when((F.count(both).over(w) == n) & varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)))))


def corr(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation of the pairs that are whole; NULL, not an error, where a side doesn't vary."""
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable isn't expanded where it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rslope(y: Column, x: Column, n: int, over: WindowSpec | None = None) -> Column:
    w = frame(n, over)
    both = F.when(x.isNotNull() & y.isNotNull(), 1)
    return F.when((F.count(both).over(w) == n) & (F.max(x).over(w) > F.min(x).over(w)), F.regr_slope(y, x).over(w))


def safe_div(a: Column, b: Column) -> Column:
    """NULL where the denominator is zero or missing."""
    return F.try_divide(a, b)


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b); NULL where either price is not positive."""
    return F.ln(F.when((a > 0) & (b > 0), F.try_divide(a, b)))


def log_return(k: int = 1) -> Column:
    return log_ratio(F.col("close"), lag(F.col("close"), k))


def true_range() -> Column:
    """The first bar of a run has no previous close: high - low."""
    before = lag(F.col("close"))
    span = F.col("high") - F.col("low")
    return F.when(before.isNull(), span).otherwise(F.greatest(span, F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
