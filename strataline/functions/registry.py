"""Extension points: custom operators, instrument processors, aggregates."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame

from strataline.plans import expr as E

_OPERATORS: dict[str, Callable[..., E.Expr]] = {}


def builtin(name: str) -> Callable[..., E.Expr] | None:
    return getattr(E, name, None)


def register_operator(name: str, make: Callable[..., E.Expr]) -> None:
    """Add a named operator; replacing one gives a warning."""
    if name in _OPERATORS or builtin(name) is not None:
        warnings.warn(f"operator {name} replaces an existing one", stacklevel=2)
    _OPERATORS[name] = make


def operator(name: str) -> Callable[..., E.Expr]:
    found = _OPERATORS.get(name) or builtin(name)
    if found is None:
        raise KeyError(f"no operator {name}")
    return found


def apply_per_instrument(panel: DataFrame, fn, schema: str) -> DataFrame:
    """Frame-in, frame-out processor per instrument, for histories known to fit a task."""
    return panel.groupBy("instrument").applyInPandas(fn, schema)


def window_aggregate(udaf, op: str, x, n: int) -> E.Expr:
    """Rolling window with a grouped-aggregate Pandas UDF."""
    return E.Expr("win", op, (E.as_expr(x),), (n,), lambda f, c: udaf(c).over(f.rows(n)), back=n - 1)
