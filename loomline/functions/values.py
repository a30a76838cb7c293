"""A value that is named more than once in an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is named, also inside of lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
