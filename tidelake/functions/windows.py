"""Window expressions over ordered series: full-window rolling statistics and what builds on them.

A rolling value is NULL until its window holds ``m`` (by default all ``k``)
non-null values, as in data-frame libraries. Every window is partitioned by
the series key, so series are computed side by side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

Agg = Callable[[Column], Column]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Series:
    """Windows of one key and order; built when asked for, so that modules can hold one before there is a session."""

    def __init__(self, key: str | list[str] = "sym", order: str = "ts"):
        self.key, self.order = [key] if isinstance(key, str) else list(key), order

    @property
    def o(self):
        return Window.partitionBy(*self.key).orderBy(self.order)

    @property
    def past(self):
        return self.o.rowsBetween(Window.unboundedPreceding, 0)

    def w(self, k: int):
        return self.o.rowsBetween(-(k - 1), 0)

    def ahead(self, k: int):
        return self.o.rowsBetween(1, k)

    def roll(self, agg: Agg, c: Column | str, k: int, m: int | None = None) -> Column:
        c, w = col(c), self.w(k)
        return F.when(F.count(c).over(w) >= (k if m is None else m), agg(c).over(w))

    def expand(self, agg: Agg, c: Column | str, m: int = 1) -> Column:
        return F.when(F.count(col(c)).over(self.past) >= m, agg(col(c)).over(self.past))

    def lag(self, c: Column | str, k: int = 1) -> Column:
        return F.lag(col(c), k).over(self.o)

    def lead(self, c: Column | str, k: int = 1) -> Column:
        return F.lead(col(c), k).over(self.o)

    def diff(self, c: Column | str, k: int = 1) -> Column:
        return col(c) - self.lag(c, k)

    def pct_change(self, c: Column | str, k: int = 1) -> Column:
        """Relative change over k rows; gaps in c are filled forward first where the caller did so."""
        return F.try_divide(col(c), self.lag(c, k)) - 1

    def mean(self, c, k, m=None) -> Column:
        return self.roll(F.avg, c, k, m)

    def std(self, c, k, m=None) -> Column:
        return self.roll(F.stddev_samp, c, k, m)

    def zscore(self, c: Column | str, k: int, eps: float = 0.0) -> Column:
        return F.try_divide(col(c) - self.mean(c, k), self.std(c, k) + eps)

    def quantile(self, c: Column | str, k: int, q: float, m: int | None = None) -> Column:
        return self.roll(lambda x: F.percentile(x, q), c, k, m)

    def last_values(self, c: Column | str, k: Column, most: int) -> Column:
        """The non-null values of the last k rows (k may differ by series, ``most`` at most), sorted."""
        rows = F.collect_list(F.struct(col(c).alias("v"))).over(self.w(most))
        part = F.slice(rows, F.greatest(F.size(rows) - k + 1, F.lit(1)), k)
        return F.sort_array(F.transform(F.filter(part, lambda s: s.v.isNotNull()), lambda s: s.v.cast("double")))

    def mad(self, c: Column | str, k: int) -> Column:
        """Mean absolute deviation from the window's own mean."""
        w = self.w(k)
        xs = F.collect_list(col(c)).over(w)
        return F.when(F.count(col(c)).over(w) >= k, F.transform(F.array(F.struct(xs.alias("x"), F.avg(col(c)).over(w).alias("m"))), lambda s: F.aggregate(s.x, F.lit(0.0), lambda t, x: t + F.abs(x - s.m)) / F.size(s.x))[0])

    def rank_pct(self, c: Column | str, k: int, m: int | None = None) -> Column:
        """Average rank of the current value in its window, as a share."""
        w = self.w(k)
        xs = F.collect_list(col(c)).over(w)

        def rank(s):
            less = F.size(F.filter(s.x, lambda x: x < s.v))
            same = F.size(F.filter(s.x, lambda x: x == s.v))
            return (less + (same + 1) / 2) / F.size(s.x)

        return F.when((F.count(col(c)).over(w) >= (k if m is None else m)) & col(c).isNotNull(), F.transform(F.array(F.struct(xs.alias("x"), col(c).alias("v"))), rank)[0])

    def parkinson(self, high: str, low: str, k: int) -> Column:
        import math

        x = F.ln(F.try_divide(F.col(high), F.col(low)))
        return F.sqrt(self.roll(F.sum, x * x, k) / (4 * math.log(2) * k))

    def cumsum(self, c) -> Column:
        return F.sum(col(c)).over(self.past)

    def cumprod(self, c) -> Column:
        return F.product(col(c)).over(self.past)

    def cummax(self, c) -> Column:
        return F.max(col(c)).over(self.past)

    def ffill(self, c, limit: int | None = None) -> Column:
        """Last non-null value, at most ``limit`` rows back."""
        w = self.past if limit is None else self.o.rowsBetween(-limit, 0)
        return F.last(col(c), ignorenulls=True).over(w)

    def row(self) -> Column:
        return F.row_number().over(self.o)


def corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation of pairs without nulls as an aggregate; NULL (no error) where a side is constant."""
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = F.when(both, col(a)), F.when(both, col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def flag(c: Column) -> Column:
    """A condition as 0/1; unknown is 0."""
    return F.coalesce(c.cast("int"), F.lit(0))


def sorted_quantile(xs: Column, q: float) -> Column:
    """Linear quantile of a sorted array; NULL if it is empty."""
    at = (F.size(xs) - 1) * F.lit(q)
    low, high = F.get(xs, F.floor(at).cast("int")), F.get(xs, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def array_mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs))


def array_std(xs: Column, mean: Column) -> Column:
    """Sample deviation of an array about its given mean, which is computed once for the array."""

    def spread(s: Column) -> Column:
        return F.sqrt(F.aggregate(s.xs, F.lit(0.0), lambda a, x: a + (x - s.m) * (x - s.m)) / (F.size(s.xs) - 1))

    return F.when(F.size(xs) > 1, F.transform(F.array(F.struct(xs.alias("xs"), mean.alias("m"))), spread)[0])


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def row_sum(*cs: Column) -> Column:
    out = F.lit(0.0)
    for c in cs:
        out = out + F.coalesce(c, F.lit(0.0))
    return out


def row_mean(*cs: Column) -> Column:
    n = F.lit(0)
    for c in cs:
        n = n + c.isNotNull().cast("int")
    return F.try_divide(row_sum(*cs), n)


def quintile(rank: Column, n: Column, q: int = 5) -> Column:
    """The quantile group of rank 1..n by linear edges (not ntile)."""
    out = F.lit(1)
    for k in range(1, q):
        out = out + (rank > 1 + (n - 1) * (k / q)).cast("int")
    return out.cast("double")
