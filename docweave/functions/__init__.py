"""Scalar functions over expressions, and how to apply your own."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

from ..model import Function, nested

__all__ = ["add", "apply", "concatenate", "divide", "lowercase", "multiply", "subtract", "uppercase"]


def concatenate(values: list[Any]) -> Function:
    """The values as one string; NULL counts as empty, whole doubles have no fraction."""
    return Function("concatenate", lambda texts: F.concat_ws("", *texts), nested(list(values)))


def lowercase(value: Any) -> Function:
    return Function("lowercase", F.lower, nested(value))


def uppercase(value: Any) -> Function:
    return Function("uppercase", F.upper, nested(value))


def add(left: Any, right: Any) -> Function:
    """The sum of numbers; if a side is a string, both as one string."""
    return Function("add", lambda x: x[0] + x[1], nested([left, right]))


def subtract(left: Any, right: Any) -> Function:
    return Function("subtract", lambda x: x[0] - x[1], nested([left, right]))


def multiply(left: Any, right: Any) -> Function:
    return Function("multiply", lambda x: x[0] * x[1], nested([left, right]))


def divide(left: Any, right: Any) -> Function:
    """Division of doubles; NULL if the divisor is 0."""
    return Function("divide", lambda x: F.try_divide(x[0].cast("double"), x[1].cast("double")), nested([left, right]))


def apply(inputs: Any, fn: Callable, return_type: str | None = None, deterministic: bool = True) -> Function:
    """A function of your own over an expression or nested lists of them.

    ``fn`` gets one argument in the shape of ``inputs``. Best, it takes columns and
    returns a column. With ``return_type`` (a Spark type) it is a Python function of
    values, run over Arrow batches; if it is deterministic and no input is a field,
    it is called once, when the query is bound.
    """
    return Function(getattr(fn, "__name__", "apply"), fn, nested(inputs), return_type, deterministic)
