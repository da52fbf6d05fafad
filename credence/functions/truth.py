"""The ways in which flags are read; they differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
YES = ["true", "t", "yes", "y", "1"]
NO = ["false", "f", "no", "n", "0"]
CHECK_YES = ["1", "true", "t", "yes", "y"]


def strict(column: Column, kind: T.DataType) -> Column:
    """A conversion flag, null where the value is no flag."""
    if isinstance(kind, T.BooleanType):
        return column
    if isinstance(kind, T.NumericType):
        return F.when(column == 1, True).when(column == 0, False)
    word = F.lower(F.trim(column.cast("string")))
    return F.when(word.isin(YES), True).when(word.isin(NO), False)


def lenient(column: Column, kind: T.DataType) -> Column:
    """A flag in checks: whatever is not clearly true is false (a float 1.0 reads "1.0")."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column, F.lit(False))
    return F.coalesce(F.lower(F.trim(column.cast("string"))).isin(CHECK_YES), F.lit(False))


def numeric(column: Column, kind: T.DataType) -> Column:
    """A flag in sampling: any number but 0."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column, F.lit(False))
    return F.coalesce(column.cast("string").try_cast("double") != 0, F.lit(False))
