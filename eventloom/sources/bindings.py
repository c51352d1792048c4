"""What a namespace is bound to: a DataFrame, its time column, and how its paths are resolved."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import paths
from eventloom.functions.paths import Typed, missing
from eventloom.functions.times import micros_of

TIMESTAMP = "@timestamp"


@dataclass
class Binding:
    """Common to both kinds of bindings.

    retention: nanoseconds that a query may look back, or None. declared: path -> the kinds of values
    that occur there; other values of such a path are taken as values of no kind, and no look at the
    rows is needed to find out what it holds.
    """

    df: DataFrame
    retention: int | None = None
    separator: str = paths.SEPARATOR
    declared: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def resolve(self, rows: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, Typed]]:
        """rows of this binding with what the paths need, and the paths as typed columns of these rows.

        A JSON text is parsed once a row, and a path looked up once.
        """
        found = {n: self._resolve(n) for n in dict.fromkeys(names)}
        open_ = {n: x for n, x in found.items() if not isinstance(x, Typed)}
        if open_:
            docs = list(dict.fromkeys(c for c, _ in open_.values()))
            rows, parsed = paths.once(rows, [self._document(c) for c in docs])
            rows, looked_up = paths.look_up(rows, {n: paths.candidates(parsed[docs.index(c)], rest, self.separator) for n, (c, rest) in open_.items()})
            found |= looked_up
        return rows, {n: x.only(self.declared[n]) if n in self.declared else x for n, x in found.items()}

    def _resolve(self, path: str) -> Typed | tuple[str, str]:
        """A typed path of real columns, or a column of documents and the path in them."""
        raise NotImplementedError

    def _document(self, column: str) -> Column:
        """A column of documents as VARIANT."""
        return F.col(f"`{column}`")

    def in_time(self, start: int, end: int) -> Column:
        """Rows in [start, end), nanoseconds."""
        raise NotImplementedError

    def nanos(self) -> Column:
        raise NotImplementedError

    def source(self) -> list[str]:
        """Columns that a raw query returns."""
        raise NotImplementedError


@dataclass
class Table(Binding):
    """A table with a fixed schema. A raw query returns its columns.

    time: its timestamp column; None: every row is in any time range. nulls: whether SQL null is a
    missing value ("missing") or an explicit null ("null"). json: string columns of JSON objects,
    whose paths resolve below the column's name.
    """

    time: str | None = None
    nulls: str = "missing"
    json: tuple[str, ...] = ()

    def _document(self, column: str) -> Column:
        return F.try_parse_json(F.col(f"`{column}`"))

    def _resolve(self, path: str) -> Typed | tuple[str, str]:
        schema = self.df.schema
        head, _, rest = path.partition(self.separator)
        if rest and head in self.json:
            return head, rest
        if path == TIMESTAMP and self.time and path not in schema.names:
            path = self.time
        if path in schema.names:
            return paths.of_column(F.col(f"`{path}`"), schema[path].dataType, self.nulls)
        kind: T.DataType = schema
        for part in path.split(self.separator):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return missing()
            kind = kind[part].dataType
        return paths.of_column(F.col(".".join(f"`{p}`" for p in path.split(self.separator))), kind, self.nulls)

    def in_time(self, start: int, end: int) -> Column:
        if self.time is None:
            return F.lit(True)
        kind = {T.TimestampNTZType: "timestamp_ntz", T.DateType: "timestamp_ntz"}.get(type(self.df.schema[self.time].dataType), "timestamp")
        at = lambda n: F.timestamp_micros(F.lit(micros_of(n))).cast(kind)  # noqa: E731  folded, so the scan gets it
        return (F.col(self.time) >= at(start)) & (F.col(self.time) < at(end))

    def nanos(self) -> Column:
        return paths.nanos(F.col(self.time)) if self.time else F.lit(0).cast("long")

    def source(self) -> list[str]:
        return self.df.columns


@dataclass
class Documents(Binding):
    """Documents as ``sources.documents`` makes them: ts_nanos, _source and doc, a VARIANT.

    max_depth: objects nested deeper are empty, so longer paths are missing. excluded: keys that end
    so are missing. promoted: path -> kind -> the column that holds the path's values of that kind.
    """

    max_depth: int | None = None
    excluded: str | None = None
    promoted: dict[str, dict[str, str]] = field(default_factory=dict)
    timestamp: str = TIMESTAMP

    def _resolve(self, path: str) -> Typed | tuple[str, str]:
        if path == self.timestamp:
            return Typed(F.lit(True), F.lit(False), time=F.col("ts_nanos"))
        parts = path.split(self.separator)
        if self.max_depth is not None and len(parts) > self.max_depth or self.excluded and any(p.endswith(self.excluded) for p in parts):
            return missing()
        if path in self.promoted:
            own = {kind: F.col(f"`{c}`") for kind, c in self.promoted[path].items()}
            return Typed(reduce(or_, (c.isNotNull() for c in own.values())), own["null"].isNotNull(), **{k: c for k, c in own.items() if k != "null"})
        return "doc", path

    def in_time(self, start: int, end: int) -> Column:
        exact = (F.col("ts_nanos") >= start) & (F.col("ts_nanos") < end)
        if "dt" not in self.df.columns:
            return exact
        day = lambda n: F.to_date(F.timestamp_micros(F.lit(n // 1000)))  # noqa: E731  prunes partitions
        return (F.col("dt") >= day(start)) & (F.col("dt") <= day(end)) & exact

    def nanos(self) -> Column:
        return F.col("ts_nanos")

    def source(self) -> list[str]:
        return ["_source"]
