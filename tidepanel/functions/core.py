"""NULL is the only missing value: ratios and correlations give NULL where they have no finite result."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window
from pyspark.sql import functions as F

EPS = 1e-12


def clean(x: Column) -> Column:
    """NaN and infinities to NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def sdiv(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def over(x: Column, w: WindowSpec | None) -> Column:
    return x if w is None else x.over(w)


def scorr(x: Column, y: Column, w: WindowSpec | None = None) -> Column:
    """Pearson correlation over rows where both are known; NULL for fewer than two or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return sdiv(over(F.covar_pop(x, y), w), over(F.stddev_pop(x), w) * over(F.stddev_pop(y), w))


def series(key: str = "security_id", date: str = "trade_date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(date)


def frame(d: int, key: str = "security_id", date: str = "trade_date") -> WindowSpec:
    """The last d rows of a series, this one included."""
    return series(key, date).rowsBetween(-(d - 1), 0)


def avg_rank(value: str, *by: str) -> Column:
    """Average rank (1-based) of ``value`` among the rows of a group; NULLs must be filtered before.

    The mean of the least and the largest rank of equal values, both over one ordered window.
    """
    w = Window.partitionBy(*by).orderBy(value)
    return (F.rank().over(w) + F.count("*").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2


def avg_rank_of(flag: str, value: str, *by: str) -> Column:
    """Average rank (1-based) of ``value`` among the rows of a group that ``flag`` marks; other rows have no use for theirs.

    Ranks by several flags share one ordered window, so subsets that overlap need neither copies of rows nor sorts of their own.
    """
    w = Window.partitionBy(*by).orderBy(value)
    marked = lambda start: F.count_if(F.col(flag)).over(w.rangeBetween(start, Window.currentRow))
    return marked(Window.unboundedPreceding) - (marked(Window.currentRow) - 1) / 2


def rounded(df, digits: int, *keys: str):
    """Double columns rounded, with no negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])
