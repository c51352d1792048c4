"""Filters on typed paths as boolean columns.

A value filter matches a row if the path holds a value of a kind that the literal can be compared
with and the comparison holds; of several kinds any may match. Other rows do not match, whatever the
operator, negated ones included.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, floor
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.paths import Typed

#: Doubles that are closer than this are equal.
EPSILON = 1e-10

COMPARISONS = ("=", "!=", ">", ">=", "<", "<=")
TEXT_OPS = ("startsWith", "notStartsWith", "endsWith", "notEndsWith", "contains", "notContains")
PRESENCE = ("isNull", "isNotNull", "exists", "notExists")
OPS = COMPARISONS + TEXT_OPS + PRESENCE


def _compare(c: Column, op: str, value) -> Column:
    match op:
        case "=":
            return c == value
        case "!=":
            return c != value
        case ">":
            return c > value
        case ">=":
            return c >= value
        case "<":
            return c < value
        case _:
            return c <= value


def _double(c: Column, op: str, value: float) -> Column:
    if op == "=":
        return F.abs(c - value) < EPSILON
    if op == "!=":
        return F.abs(c - value) >= EPSILON
    return _compare(c, op, value)


def _int(c: Column, op: str, value: int | float) -> Column | None:
    if isinstance(value, float):  # a fraction: no int equals it, and bounds move to the next int
        if op in ("=", "!="):
            return c.isNotNull() if op == "!=" else None
        value = floor(value) if op in (">", "<=") else ceil(value)
    return _compare(c, op, value)


def _text(c: Column, op: str, value: str) -> Column:
    match op:
        case "startsWith":
            return c.startswith(value)
        case "notStartsWith":
            return ~c.startswith(value)
        case "endsWith":
            return c.endswith(value)
        case "notEndsWith":
            return ~c.endswith(value)
        case "contains":
            return c.contains(value)
        case "notContains":
            return ~c.contains(value)
        case _:
            return _compare(c, op, value)


def matches(field: Typed, op: str, value=None) -> Column:
    """Rows whose field passes (op, value)."""
    match op:
        case "exists":
            return field.exists
        case "notExists":
            return ~field.exists
        case "isNull":
            return field.null
        case "isNotNull":
            return field.exists & ~field.null
    found: list[Column | None] = []
    near = None  # what a match implies in terms that a scan understands
    if isinstance(value, bool):
        if field.bool is not None and op in ("=", "!="):
            found.append(_compare(field.bool, op, value))
    elif isinstance(value, (int, float)):
        if op in COMPARISONS:
            if field.int is not None:
                found.append(_int(field.int, op, value))
            if field.double is not None:
                found.append(_double(field.double, op, float(value)))
                if op == "=":
                    near = field.double.between(value - EPSILON, value + EPSILON)
                    if len(found) == 2:  # as a range too: an equality that both sides share would be factored out
                        near = near | field.int.between(ceil(value), floor(value))
    elif isinstance(value, str) and field.string is not None:
        found.append(_text(field.string, op, value))
    found = [c for c in found if c is not None]
    if not found:
        return F.lit(False)
    exact = reduce(or_, found)
    return exact if near is None else near & exact


def combined(columns: list[Column], combinator: str = "AND") -> Column:
    """All of the columns, or any of them; without columns nothing matches."""
    if not columns:
        return F.lit(False)
    return reduce(and_ if combinator == "AND" else or_, columns)
