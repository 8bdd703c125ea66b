"""Local names inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Without it a value used in several branches is copied into each of them, and nested
    helpers grow the expression beyond what the planner handles quickly.
    """
    return F.transform(F.array(value), body).getItem(0)
