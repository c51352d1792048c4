"""The three shapes of queries as DataFrames."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.paths import KINDS, Typed
from eventloom.operators import calculations
from eventloom.operators.filters import combined, matches
from eventloom.plans.spec import Query
from eventloom.sources.bindings import Binding


def answer(query: Query, bound: Binding, strict: bool = False) -> DataFrame:
    """The rows, groups or buckets that a query asks for.

    strict: fields that are ordered by, grouped by or calculated with must be of one type in the rows
    that pass the filters, else a ValueError is raised. Otherwise several types are made one: numbers
    become doubles, and other mixtures strings.
    """
    return {"raw": raw, "grouped": grouped, "buckets": buckets}[query.kind](query, bound, strict)


def filtered(query: Query, bound: Binding) -> DataFrame:
    """Rows in the time range that pass all filter lists."""
    rows = bound.df.where(bound.in_time(start_of(query, bound), query.end))
    rows, fields = bound.resolve(rows, [f.field for fl in query.filters for f in fl.filters])
    for fl in query.filters:
        rows = rows.where(combined([matches(fields[f.field], f.op, f.value) for f in fl.filters], fl.combinator))
    return rows


def start_of(query: Query, bound: Binding) -> int:
    return query.start if bound.retention is None else max(query.start, time.time_ns() - bound.retention)


def kinds_of(rows: DataFrame, fields: dict[str, Typed], strict: bool = False) -> dict[str, set[str]]:
    """The kinds of values that occur at paths. Over fixed schemas and declared kinds they are known; else one aggregate over rows finds them."""
    found = {n: set(f.kinds()) for n, f in fields.items()}
    open_ = {n: f for n, f in fields.items() if len(found[n]) > 1}
    if open_:
        asked = [F.max(c.isNotNull()).alias(f"{i}/{k}") for i, f in enumerate(open_.values()) for k, c in f.kinds().items()]
        got = rows.agg(*asked).first().asDict()
        found |= {n: {k for k in f.kinds() if got[f"{i}/{k}"]} for i, (n, f) in enumerate(open_.items())}
    if strict:
        for n, k in found.items():
            if len(k) > 1:
                raise ValueError(f"field {n} has multiple types: {', '.join(sorted(k))}")
    return found


def value_of(field: Typed, kinds: set[str]) -> Column:
    """One column for a field of which the given kinds occur; a column of nulls if none does."""
    own = [field.kinds()[k] for k in KINDS if k in kinds]
    if not own:
        return F.lit(None).cast("string")
    if len(own) == 1:
        return own[0]
    kind = "double" if kinds <= {"int", "double", "time"} else "string"
    return F.coalesce(*(c.cast(kind) for c in own))


def first(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows; all of them if there is no limit."""
    return rows if limit is None else rows.limit(limit)


def raw(query: Query, bound: Binding, strict: bool = False) -> DataFrame:
    """Source columns of the first rows in order; rows that lack a field that is ordered by are left out."""
    rows, fields = bound.resolve(filtered(query, bound), [o.field for o in query.order_by])
    for f in fields.values():
        rows = rows.where(f.exists)
    kinds = kinds_of(rows, fields, strict)
    keys = [value_of(fields[o.field], kinds[o.field]) for o in query.order_by]
    if keys:
        rows = rows.orderBy(*(k.desc() if o.descending else k.asc() for o, k in zip(query.order_by, keys, strict=True)))
    return first(rows, query.limit).select(*(f"`{c}`" for c in bound.source()))


def grouped(query: Query, bound: Binding, strict: bool = False) -> DataFrame:
    """Columns key_0, key_1, ... and value_0, value_1, ... of the first groups in order.

    A row counts if it has all keys and, where some calculation has a field, one of those fields at
    least. Groups are complete, whatever the limit.
    """
    with_field = [c for c in query.calculations if c.field is not None]
    rows, fields = bound.resolve(filtered(query, bound), [*query.group_by, *(c.field for c in with_field)])
    for g in dict.fromkeys(query.group_by):
        rows = rows.where(fields[g].exists)
    if with_field:
        rows = rows.where(combined([calculations.usable(fields[c.field], c.op) for c in with_field], "OR"))
    kinds = kinds_of(rows, fields, strict)
    by = [value_of(fields[g], kinds[g]).alias(f"key_{i}") for i, g in enumerate(query.group_by)]
    values = []
    for i, c in enumerate(query.calculations):
        field = None if c.field is None else fields[c.field]
        text = c.field is not None and kinds[c.field] & {"int", "double", "time", "string"} == {"string"}
        values.append(calculations.calculate(field, c.op, text).alias(f"value_{i}"))
    names = [f"key_{i}" for i in range(len(by))]
    out = rows.groupBy(*by).agg(*values) if values else rows.select(*by).distinct()
    if query.order_by:
        order = []
        for o in query.order_by:
            column = F.col(f"key_{o.index}" if o.kind == "group" else f"value_{o.index}")
            if o.kind == "calculation":  # a calculation over nothing comes last
                order.append(column.desc_nulls_last() if o.descending else column.asc_nulls_last())
            else:
                order.append(column.desc() if o.descending else column.asc())
        out = out.orderBy(*order)
    return first(out, query.limit).select(*names, *(f"value_{i}" for i in range(len(values))))


def bucket_range(start: int, end: int, granularity: int) -> tuple[int, int]:
    """Start of the first bucket and number of buckets."""
    first = start // granularity * granularity
    return first, (-(-end // granularity) * granularity - first) // granularity


def buckets(query: Query, bound: Binding, strict: bool = False) -> DataFrame:
    """start_at_nanos and value, the number of rows, of every bucket in order; no buckets if no row matches.

    The counts of the at most about a thousand buckets become one map, in which each bucket looks itself up.
    """
    begin, n = bucket_range(start_of(query, bound), query.end, query.granularity)
    timed = filtered(query, bound).select(bound.nanos().alias("nanos"))
    counts = timed.select(F.expr(f"(nanos - {begin}) div {query.granularity}").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("counts")).where(F.size("counts") > 0)
    each = one.select("counts", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("bucket"))
    return each.select((F.lit(begin) + F.col("bucket") * F.lit(query.granularity)).alias("start_at_nanos"), F.coalesce(F.try_element_at("counts", F.col("bucket")), F.lit(0)).alias("value"))
