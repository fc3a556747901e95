"""Names an intermediate value inside a column expression.

A plain Python composition of columns copies the whole expression of an argument at every use, and
nested uses grow it exponentially. Here a value is bound once, as a lambda variable."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def once(function: Callable[..., Column]) -> Callable[..., Column]:
    """Decorator for a function of one column: its argument is bound before use."""

    @functools.wraps(function)
    def bound(c: Column, *args, **kwargs) -> Column:
        return let(c, lambda value: function(value, *args, **kwargs))

    return bound


def let_sql(expression: str, name: str, body: str) -> str:
    """SQL text of body, in which name stands for expression."""
    return f"transform(array({expression}), {name} -> {body})[0]"


def apply_sql(c: Column, name: str, body: str) -> Column:
    """body as a column, in which name stands for c. One SQL text is parsed once by Spark, which is much
    quicker to build than hundreds of separate column calls."""
    return F.call_function("transform", F.array(c), F.expr(f"{name} -> {body}"))[0]
