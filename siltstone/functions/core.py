"""Helpers for building Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` refers to it.

    Without it every reference would copy the value's whole expression into the plan.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def lookup(table: dict, key: Column) -> Column:
    """The value of a key in a fixed table, null for others. The table is one literal, however long."""
    shown = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x)
    return F.try_element_at(F.expr("map(" + ", ".join(f"{shown(k)}, {shown(v)}" for k, v in table.items()) + ")"), key)
