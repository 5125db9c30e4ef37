"""A small filter language over columns: ``col("age").gte(18) & col("city").starts_with("B")``.

Every method returns a Spark ``Column``, so Catalyst sees plain predicates and
pushes them to the scan. Comparisons with NULL are unknown and drop the row, as
in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Op(Enum):
    """The operators of the filter language."""

    EQ = "eq"
    NEQ = "neq"
    LT = "lt"
    LTE = "lte"
    GT = "gt"
    GTE = "gte"
    BETWEEN = "between"
    IS_NULL = "is_null"
    IS_NOT_NULL = "is_not_null"
    STARTS_WITH = "starts_with"
    ENDS_WITH = "ends_with"
    CONTAINS = "contains"
    IN = "is_in"
    NOT_IN = "not_in"


Value = int | float | str | bytes | bool | Decimal


@dataclass(frozen=True)
class Field:
    """A column by name; :func:`ordinal` makes one by position."""

    name: str

    @property
    def column(self) -> Column:
        return F.col(self.name)

    def eq(self, value: Value) -> Column:
        return self.column == F.lit(value)

    def neq(self, value: Value) -> Column:
        return self.column != F.lit(value)

    def lt(self, value: Value) -> Column:
        return self.column < F.lit(value)

    def lte(self, value: Value) -> Column:
        return self.column <= F.lit(value)

    def gt(self, value: Value) -> Column:
        return self.column > F.lit(value)

    def gte(self, value: Value) -> Column:
        return self.column >= F.lit(value)

    def between(self, low: Value, high: Value) -> Column:
        return self.column.between(F.lit(low), F.lit(high))

    def is_null(self) -> Column:
        return self.column.isNull()

    def is_not_null(self) -> Column:
        return self.column.isNotNull()

    def starts_with(self, text: str) -> Column:
        return self.column.startswith(F.lit(text))

    def ends_with(self, text: str) -> Column:
        return self.column.endswith(F.lit(text))

    def contains(self, text: str) -> Column:
        return self.column.contains(F.lit(text))

    def is_in(self, *values: Value) -> Column:
        return self.column.isin(list(values))

    def not_in(self, *values: Value) -> Column:
        return ~self.column.isin(list(values))

    def approx_eq(self, value: float, tolerance: float = 1e-12) -> Column:
        """Equal within ``tolerance``, absolute or relative to the larger of the two."""
        gap = F.abs(self.column - F.lit(float(value)))
        return (gap <= tolerance) | (gap <= tolerance * F.greatest(F.abs(self.column), F.lit(abs(float(value)))))

    def apply(self, op: Op, *values: Value) -> Column:
        return getattr(self, op.value)(*values)


def col(name: str) -> Field:
    return Field(name)


def ordinal(df: DataFrame, at: int) -> Field:
    return Field(df.columns[at])


def all_of(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def negate(condition: Column) -> Column:
    """Three-valued NOT: unknown stays unknown."""
    return ~condition
