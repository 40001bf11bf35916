"""Small column builders shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def texts(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def empty_texts() -> Column:
    return F.array().cast("array<string>")


def or_empty(column: str | Column) -> Column:
    """A list column with null read as the empty list."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, empty_texts())


def count_in(column: Column, values: Iterable[str]) -> Column:
    """How many elements of a list column are among ``values``."""
    values = list(values)
    return F.size(F.filter(column, lambda x: x.isin(values)))


def lookup(column: Column, table: dict, default) -> Column:
    """Value of a small fixed table for a scalar expression."""
    chain = None
    for key, value in table.items():
        chain = F.when(column == key, value) if chain is None else chain.when(column == key, value)
    return chain.otherwise(default)


def mean_of(column: Column) -> Column:
    """Mean of a numeric list; 0 for an empty one."""
    total = F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(column) > 0, total / F.size(column)).otherwise(0.0)


def rounded(column: Column, places: int = 6) -> Column:
    return F.round(column.cast("double"), places)


def as_flag(condition: Column) -> Column:
    """1 or 0; an unknown condition counts as 0."""
    return F.when(condition, 1).otherwise(0).cast("long")


def joined(column: Column, separator: str = "|") -> Column:
    return F.concat_ws(separator, column)
