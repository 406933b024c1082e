"""Columns that are mentioned more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being worked out once; a Column named within a lambda is worked out again for every item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
