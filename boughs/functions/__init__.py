"""Functions that queries use: native ones, which Catalyst sees into, and tests for plain values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def isna(value: object) -> bool:
    """Whether a value is None. Branches know this function and use IS NULL for it."""
    return value is None


class Native:
    """A function from columns to a column, which runs in the JVM and can be pushed down to the scan.

    Over a depth path it gets the projected column, over a breadth path one
    column for each path, without a projection the fields as ``r["name"]``.
    """

    def __init__(self, func: Callable[..., Column]):
        self.func = func

    def __call__(self, *columns) -> Column:
        return self.func(*columns)


def native(func: Callable[..., Column]) -> Native:
    """Mark a function of columns. A plain lambda can't be told from one of values, so it never is taken for one."""
    return Native(func)


def flatten(value: object) -> object:
    """All items of nested lists in one list; anything else as it is."""
    if not isinstance(value, list):
        return value
    out: list = []
    todo = [iter(value)]
    while todo:
        for item in todo[-1]:
            if isinstance(item, list):
                todo.append(iter(item))
                break
            out.append(item)
        else:
            todo.pop()
    return out


def flatten_column(col: Column, depth: int) -> Column:
    """The same for a column of lists nested ``depth`` deep; null inner lists count as empty."""
    for _ in range(depth - 1):
        col = F.flatten(F.filter(col, lambda x: x.isNotNull()))
    return col
