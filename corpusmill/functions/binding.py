"""A value worked out once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once per row, however often the body, or a function it maps
    over an array, reads it. A plain column expression there would be evaluated at every reading."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
