"""The query specification: a JSON object, checked and resolved."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from typing import Any

from eventloom.functions.times import NANOS, duration, unit
from eventloom.operators import calculations, filters

#: Defaults: rows of a raw and groups of a grouped query; bounds of the granularity as parts of the time range.
RAW_LIMIT, GROUP_LIMIT = 100, 10
FINEST, COARSEST = 1000, 10
ORDERS = ("ascending", "descending")
COMBINATORS = ("AND", "OR")


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class FilterList:
    filters: tuple[Filter, ...]
    combinator: str = "AND"


@dataclass(frozen=True)
class Calculation:
    op: str
    field: str | None = None


@dataclass(frozen=True)
class OrderBy:
    """index: place in group_by or in calculations, as kind says; kind is raw, group or calculation."""

    kind: str
    field: str | None
    index: int = 0
    descending: bool = False


@dataclass(frozen=True)
class Query:
    """A resolved query. kind: raw, grouped or buckets. Times are in nanoseconds, the end is left out."""

    namespace: str
    start: int
    end: int
    granularity: int | None = None
    filters: tuple[FilterList, ...] = ()
    group_by: tuple[str, ...] = ()
    calculations: tuple[Calculation, ...] = ()
    order_by: tuple[OrderBy, ...] = ()
    limit: int | None = RAW_LIMIT
    kind: str = field(default="raw")


def parse(query: str | dict, now: int | None = None) -> Query:
    """Check and resolve a query; a ValueError says what is wrong. now: nanoseconds, for ranges without start and end."""
    q = json.loads(query) if isinstance(query, (str, bytes)) else query
    if not isinstance(q, dict):
        raise ValueError("a query must be a JSON object")
    namespace = q.get("namespace")
    if not namespace or not isinstance(namespace, str):
        raise ValueError("namespace: a name is needed")
    start, end, granularity = _times(q, now)
    lists = tuple(_filter_list(x) for x in _list(q, "filters"))
    group_by = tuple(_list(q, "group_by"))
    if granularity is not None and group_by:
        raise ValueError("group_by: buckets of time cannot be grouped further")
    for g in group_by:
        if not isinstance(g, str):
            raise ValueError(f"group_by: {g!r} is not a path")
    calcs = _calculations(q, granularity, group_by)
    order_by = tuple(_order_by(x, group_by, calcs, granularity) for x in _objects(q, "order_by"))
    limit = q.get("limit")
    if limit is not None and (not isinstance(limit, int) or isinstance(limit, bool) or limit <= 0):
        raise ValueError(f"limit: a whole number above 0, not {limit!r}")
    kind = "buckets" if granularity is not None else "grouped" if group_by else "raw"
    return Query(namespace, start, end, granularity, lists, group_by, calcs, order_by, limit or (GROUP_LIMIT if group_by else RAW_LIMIT), kind)


def _list(q: dict, key: str) -> list:
    found = q.get(key)
    if found is not None and not isinstance(found, list):
        raise ValueError(f"{key}: a list is needed")
    return found or []


def _objects(q: dict, key: str) -> list[dict]:
    found = _list(q, key)
    for x in found:
        if not isinstance(x, dict):
            raise ValueError(f"{key}: {x!r} is not an object")
    return found


def _integer(q: dict, key: str) -> int | None:
    x = q.get(key)
    if x is not None and (not isinstance(x, int) or isinstance(x, bool) or not 0 <= x < 2**63):
        raise ValueError(f"{key}: a whole number of 64 bits from 0 on, not {x!r}")
    return x


def _times(q: dict, now: int | None) -> tuple[int, int, int | None]:
    start, end = _integer(q, "start_time"), _integer(q, "end_time")
    span = None if q.get("time_range") is None else duration(q["time_range"])
    grain = None if q.get("time_granularity") is None else duration(q["time_granularity"])
    scale = NANOS["s"] if q.get("time_unit") is None else unit(q["time_unit"])
    if span is None and (start is None or end is None):
        raise ValueError("time_range: needed, unless start_time and end_time are both there")
    if span is not None and span <= 0:
        raise ValueError(f"time_range: {q['time_range']!r} is not above 0")
    if span is not None and start is not None and end is not None:
        raise ValueError("time_range: not beside both start_time and end_time")
    if grain is not None and grain <= 0:
        raise ValueError(f"time_granularity: {q['time_granularity']!r} is not above 0")
    if span is None:
        lo, hi = start * scale, end * scale
    elif start is not None:
        lo = start * scale
        hi = lo + span
    else:
        hi = end * scale if end is not None else time.time_ns() if now is None else now
        lo = hi - span
    if not all(-(2**63) <= x < 2**63 for x in (lo, hi)):
        raise ValueError("the time range is beyond what nanoseconds of 64 bits hold")
    if grain is not None:
        if grain > int((hi - lo) / COARSEST):
            raise ValueError(f"time_granularity: {q['time_granularity']!r} leaves fewer than {COARSEST} buckets")
        if grain < int((hi - lo) / FINEST):
            raise ValueError(f"time_granularity: {q['time_granularity']!r} makes more than {FINEST} buckets")
    return lo, hi, grain


def _filter_list(x: Any) -> FilterList:
    if not isinstance(x, dict):
        raise ValueError("filters: each list of filters must be an object")
    combinator = x.get("filter_combinator") or "AND"
    if combinator not in COMBINATORS:
        raise ValueError(f"filter_combinator: {combinator!r} is none of {', '.join(COMBINATORS)}")
    found = []
    for f in _objects(x, "filters"):
        name, op, value = f.get("field"), f.get("op"), f.get("value")
        if not isinstance(name, str) or not name:
            raise ValueError(f"filters: {name!r} is not a path")
        if op not in filters.OPS:
            raise ValueError(f"filters: there is no operator {op!r}")
        if op in filters.PRESENCE and value is not None:
            raise ValueError(f"filters: {op} takes no value, but {value!r} is given")
        if op not in filters.PRESENCE and value is None:
            raise ValueError(f"filters: {op} needs a value")
        found.append(Filter(name, op, literal(value)))
    return FilterList(tuple(found), combinator)


def literal(value: Any) -> Any:
    """A filter value as bool, int, float or str; a float that is whole becomes an int."""
    if isinstance(value, bytes):
        return value.decode()
    if value is None or isinstance(value, (bool, str)) or isinstance(value, int) and -(2**63) <= value < 2**63:
        return value
    if isinstance(value, float):
        return int(value) if value.is_integer() and abs(value) < 2**63 else value
    raise ValueError(f"filters: {value!r} is neither a truth value, a number of 64 bits nor a text")


def _calculations(q: dict, granularity: int | None, group_by: tuple[str, ...]) -> tuple[Calculation, ...]:
    found = _objects(q, "calculations")
    if found and granularity is not None:
        raise ValueError("calculations: buckets of time are counted only")
    if found and not group_by:
        raise ValueError("calculations: nothing is grouped that they could be made over")
    out = []
    for c in found:
        op, name = c.get("op"), c.get("field")
        if op not in calculations.OPS:
            raise ValueError(f"calculations: there is no {op!r}")
        if name is not None and not isinstance(name, str):
            raise ValueError(f"calculations: {name!r} is not a path")
        if name is not None and not calculations.requires_field(op):
            raise ValueError(f"calculations: {op} is made over rows and not over {name}")
        if name is None and calculations.requires_field(op):
            raise ValueError(f"calculations: {op} needs a field")
        out.append(Calculation(op, name))
    return tuple(out)


def _order_by(x: dict, group_by: tuple[str, ...], calcs: tuple[Calculation, ...], granularity: int | None) -> OrderBy:
    if granularity is not None:
        raise ValueError("order_by: buckets come in the order of time")
    name, op, order = x.get("field"), x.get("op"), x.get("order") or "ascending"
    if order not in ORDERS:
        raise ValueError(f"order_by: {order!r} is none of {', '.join(ORDERS)}")
    if name is not None and not isinstance(name, str):
        raise ValueError(f"order_by: {name!r} is not a path")
    down = order == "descending"
    if not group_by:
        if name is None:
            raise ValueError("order_by: rows are ordered by fields")
        return OrderBy("raw", name, descending=down)
    if op is not None and op not in calculations.OPS:
        raise ValueError(f"order_by: there is no {op!r}")
    if name is None or op is not None:
        if name is None and op is None:
            raise ValueError("order_by: groups are ordered by a key or a calculation")
        if name is not None and not calculations.requires_field(op):
            raise ValueError(f"order_by: {op} is made over rows and not over {name}")
        if name is None and calculations.requires_field(op):
            raise ValueError(f"order_by: {op} needs a field")
        for i, c in enumerate(calcs):
            if (c.op, c.field) == (op, name):
                return OrderBy("calculation", name, i, down)
    elif name in group_by:
        return OrderBy("group", name, group_by.index(name), down)
    raise ValueError(f"order_by: {x} is neither a key nor a calculation of the query")


def unparse(q: Query) -> dict:
    """A query object that parses to q again. Times are in nanoseconds."""
    out: dict[str, Any] = {"namespace": q.namespace, "start_time": q.start, "end_time": q.end, "time_unit": "1ns"}
    if q.granularity is not None:
        out["time_granularity"] = f"{q.granularity}ns"
    if q.filters:
        out["filters"] = [{"filters": [{"field": f.field, "op": f.op} | ({} if f.value is None else {"value": f.value}) for f in fl.filters], "filter_combinator": fl.combinator} for fl in q.filters]
    if q.group_by:
        out["group_by"] = list(q.group_by)
    if q.calculations:
        out["calculations"] = [{"op": c.op} | ({} if c.field is None else {"field": c.field}) for c in q.calculations]
    if q.order_by:
        out["order_by"] = [({} if o.field is None else {"field": o.field}) | ({"op": q.calculations[o.index].op} if o.kind == "calculation" else {}) | {"order": ORDERS[o.descending]} for o in q.order_by]
    return out | {"limit": q.limit}
