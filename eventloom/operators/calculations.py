"""Calculations over the rows of a group.

Results are doubles, except for the least and greatest of strings. Rows in which the field is missing
or of a kind that cannot be calculated with add nothing: COUNT counts rows, SUM of nothing is 0, and
AVG, MIN and MAX of nothing are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.paths import Typed

OPS = ("COUNT", "SUM", "AVG", "MIN", "MAX")
_KINDS = {"SUM": ("int", "double", "time"), "AVG": ("int", "double", "time"), "MIN": ("int", "double", "time", "string"), "MAX": ("int", "double", "time", "string")}


def requires_field(op: str) -> bool:
    return op != "COUNT"


def usable(field: Typed, op: str) -> Column:
    """Rows whose field the calculation can use."""
    found = [c.isNotNull() for k, c in field.kinds().items() if k in _KINDS[op]]
    out = F.lit(False)
    for c in found:
        out = c if len(found) == 1 else out | c
    return out


def calculate(field: Typed | None, op: str, of_strings: bool = False) -> Column:
    """of_strings: MIN and MAX look at the strings of a field and not at its numbers."""
    if op == "COUNT":
        return F.count(F.lit(1)).cast("double")
    number = field.number()
    if op in ("SUM", "AVG") and [k for k in field.kinds() if k in _KINDS[op]] == ["time"]:  # nanoseconds are too large to be added as doubles
        total = F.sum(field.time.cast("decimal(20,0)")).cast("double")
        return F.coalesce(total, F.lit(0.0)) if op == "SUM" else total / F.count(field.time)
    if op == "SUM":
        return F.coalesce(F.sum(number), F.lit(0.0)) if number is not None else F.max(F.lit(0.0))
    if op == "AVG":
        return F.avg(number) if number is not None else F.max(F.lit(None).cast("double"))
    best = F.min if op == "MIN" else F.max
    if of_strings and field.string is not None:
        return best(field.string)
    if number is None:
        return best(F.lit(None).cast("double"))
    only = [c for k, c in field.kinds().items() if k in ("int", "time")]
    # a single column of whole numbers is compared as such and then converted
    return best(only[0]).cast("double") if field.double is None and len(only) == 1 else best(number)
