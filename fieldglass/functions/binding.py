"""Evaluate an expression once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    A CASE that mentions a costly expression in several branches would compute
    it in each; a one-item transform binds it to a variable instead.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
