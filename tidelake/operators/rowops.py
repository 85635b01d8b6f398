"""Projections, filters and predicates that are built from data: patterns, rules, anti-patterns."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le, "==": operator.eq}


@dataclass(frozen=True)
class Condition:
    """feature operator threshold; ``between`` takes a pair and includes both ends."""

    feature: str
    operator: str
    threshold: float | tuple[float, float]

    def column(self, columns: list[str]) -> Column:
        """Unknown values are false; a feature that is not there is false; an unknown operator is true."""
        if self.feature not in columns:
            return F.lit(False)
        x = F.col(self.feature)
        if self.operator == "between":
            return F.coalesce(x.between(*self.threshold), F.lit(False))
        if self.operator not in COMPARE:
            return F.lit(True)
        return F.coalesce(COMPARE[self.operator](x, F.lit(self.threshold)), F.lit(False))


@dataclass(frozen=True)
class Rule:
    name: str
    conditions: tuple[Condition, ...]
    logic: str = "AND"
    direction: str = "LONG"
    stats: dict = field(default_factory=dict, hash=False, compare=False)

    def column(self, columns: list[str]) -> Column:
        parts = [c.column(columns) for c in self.conditions]
        if not parts:
            return F.lit(False)
        return functools.reduce(operator.and_ if self.logic == "AND" else operator.or_, parts)

    def signal(self, columns: list[str]) -> Column:
        return F.when(self.column(columns), 1 if self.direction == "LONG" else -1).otherwise(0)


def avoid(rules: list[tuple[Rule, float, float]], columns: list[str], top: int = 5) -> Column:
    """True where none of the ``top`` anti-patterns by loss rate times frequency holds."""
    worst = sorted(rules, key=lambda r: (-r[1] * r[2], r[0].name))[:top]
    hit = functools.reduce(operator.or_, [r.column(columns) for r, _, _ in worst], F.lit(False))
    return ~hit


def numeric(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]


def matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def fill_median(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Nulls become the exact median of the fitting rows (found at once, in two passes); a column without values stays null."""
    from tidelake.functions.quantiles import exact_quantiles

    m = exact_quantiles(df if fit_on is None else fit_on, columns, [0.5])
    return df.select(*[F.coalesce(F.col(c), F.lit(m[c][0])).alias(c) if c in columns else F.col(c) for c in df.columns])


def by_position(left: DataFrame, right: DataFrame, key: list[str], order: str) -> DataFrame:
    """Row i of one with row i of the other, within each key; longer sides are cut."""
    from tidelake.functions.windows import Series

    s = Series(key, order)
    return left.withColumn("_i", s.row()).join(right.withColumn("_i", s.row()).drop(order), [*key, "_i"]).drop("_i")


def long_format(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """One row for each value: indicator, value."""
    return df.unpivot(keep, columns, "indicator", "value")
