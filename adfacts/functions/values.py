"""Naming an intermediate value inside one Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it.

    A Column that is written into an expression several times is evaluated several times,
    and nesting multiplies that; a lambda's argument is not.
    """
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))
