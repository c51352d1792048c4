"""Typed views of dotted paths.

A path of a document can be missing, null, or hold a value of one of several types, and differs from
row to row. A ``Typed`` has a column for each of those states; a column that cannot hold is None, so
that plans over tables with a fixed schema name only real columns and push down to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "."
#: Kinds of values, in the order in which they are looked for.
KINDS = ("bool", "int", "double", "string", "time")


@dataclass(frozen=True)
class Typed:
    """exists and null are booleans, never null themselves; the others are null where the value has another kind."""

    exists: Column
    null: Column
    bool: Column | None = None
    int: Column | None = None
    double: Column | None = None
    string: Column | None = None
    time: Column | None = None  # nanoseconds

    def kinds(self) -> dict[str, Column]:
        return {f.name: v for f in fields(self) if f.name in KINDS and (v := getattr(self, f.name)) is not None}

    def only(self, kinds: Iterable[str]) -> Typed:
        """The same, with columns of the given kinds alone."""
        return replace(self, **{k: None for k in KINDS if k not in kinds})

    def number(self) -> Column | None:
        """The value as a double, of a kind that can be calculated with."""
        found = [c.cast("double") for k, c in self.kinds().items() if k in ("int", "double", "time")]
        return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)



def missing() -> Typed:
    return Typed(F.lit(False), F.lit(False))


def _quoted(segments: list[str]) -> str:
    return "$" + "".join("['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']" for s in segments)


#: Paths of up to so many parts are looked up spelling by spelling; the others part by part, with the same result.
SPELLED = 4


def spellings(parts: list[str], separator: str = SEPARATOR) -> list[list[str]]:
    """Keys that the parts of a dotted path stand for: nested ones first, then such as hold the separator themselves."""
    if not parts:
        return [[]]
    return [[*keys, separator.join(parts[j:])] for j in range(len(parts) - 1, -1, -1) for keys in spellings(parts[:j], separator)]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_scalar(tag: Column) -> Column:
    """tag: what schema_of_variant says. Objects and arrays are none."""
    return ~(tag.startswith("OBJECT") | tag.startswith("ARRAY"))


def is_fraction(tag: Column) -> Column:
    """Of a kind that can hold fractions; whole numbers of it are ints all the same."""
    return tag.startswith("DECIMAL") | tag.startswith("DOUBLE") | tag.startswith("FLOAT")


def _stepwise(doc: Column, parts: list[str], separator: str) -> Column:
    """The first scalar below any spelling: of each number of leading parts, the values that they reach, and from these on."""
    get = lambda reached, j, i: F.transform(reached, lambda v: F.try_variant_get(v, _quoted([separator.join(parts[j:i])]), "variant"))

    def onward(reached: list[Column]) -> Column:
        i = len(reached)
        now = F.filter(F.concat(*(get(reached[j], j, i) for j in range(i - 1, -1, -1))), lambda v: v.isNotNull())
        if i < len(parts):
            return let(now, lambda found: onward([*reached, found]))
        return F.get(F.filter(now, lambda v: is_scalar(F.schema_of_variant(v))), F.lit(0))

    return let(F.array(doc), lambda found: onward([found]))


def candidates(doc: Column, path: str, separator: str = SEPARATOR) -> list[Column]:
    """VARIANTs of which the first scalar is the path's value in a VARIANT column."""
    parts = path.split(separator)
    if len(parts) > SPELLED:
        return [_stepwise(doc, parts, separator)]
    return [F.try_variant_get(doc, _quoted(keys), "variant") for keys in spellings(parts, separator)]


def first_scalar(values: list[Column], tags: list[Column]) -> tuple[Column, Column]:
    """The first value that is a scalar, and its tag."""
    picked = [(F.when(is_scalar(t), v), F.when(is_scalar(t), t)) for v, t in zip(values, tags, strict=True)]
    return picked[0] if len(picked) == 1 else tuple(F.coalesce(*x) for x in zip(*picked, strict=True))


def scalar(v: Column, tag: Column | None = None) -> Typed:
    """A VARIANT column of scalars, or SQL null where there is none. tag: what schema_of_variant says of it."""
    tag = F.schema_of_variant(v) if tag is None else tag
    number = F.when(is_fraction(tag), F.try_variant_get(v, "$", "double"))
    whole = (number == F.floor(number)) & (F.abs(number) < float(2**63))
    return Typed(
        exists=v.isNotNull(),
        null=F.coalesce(F.is_variant_null(v), F.lit(False)),
        bool=F.when(tag == "BOOLEAN", F.try_variant_get(v, "$", "boolean")),
        int=F.when(tag == "BIGINT", F.try_variant_get(v, "$", "bigint")).when(whole, number.cast("bigint")),
        double=F.when(~whole, number),
        string=F.when(tag == "STRING", F.try_variant_get(v, "$", "string")),
    )


def once(rows: DataFrame, columns: list[Column]) -> tuple[DataFrame, list[Column]]:
    """rows with columns that are computed once a row, however often they are used, and references to them.

    They come out of a generator of one row, which the optimizer neither merges with what is above nor
    pushes a condition on its output through; conditions on other columns still reach the scan.
    """
    taken = {c.lower() for c in rows.columns}
    names = [n for n in (f"__once_{i}" for i in range(len(taken) + len(columns))) if n not in taken][: len(columns)]
    made = F.inline(F.array(F.struct(*(c.alias(n) for c, n in zip(columns, names, strict=True)))))
    return rows.select("*", made), [F.col(n) for n in names]


def look_up(rows: DataFrame, at: dict[str, list[Column]]) -> tuple[DataFrame, dict[str, Typed]]:
    """rows with what paths need, and the paths by name, each the first scalar of its candidates: looked up and picked once a row.

    Objects and arrays count as missing; numbers that are whole are ints.
    """
    rows, values = once(rows, [v for x in at.values() for v in x])
    rows, tags = once(rows, [F.schema_of_variant(v) for v in values])
    picked, i = [], 0
    for x in at.values():
        picked += first_scalar(values[i : i + len(x)], tags[i : i + len(x)])
        i += len(x)
    rows, picked = once(rows, picked)
    return rows, {n: scalar(*picked[2 * i : 2 * i + 2]) for i, n in enumerate(at)}


def discover(docs: DataFrame, doc: str = "doc", max_depth: int = 8, separator: str = SEPARATOR) -> DataFrame:
    """path, kind and n of all scalars in a column of VARIANT objects: how many rows hold each kind at each path.

    Keys are joined by the separator. Arrays, and what is nested deeper than ``max_depth``, are left out.
    A null document has no paths. One pass over the rows.
    """
    kind = F.when(F.col("tag") == "BIGINT", "int").when(F.col("tag") == "STRING", "string").when(F.col("tag") == "BOOLEAN", "bool").when(F.col("tag") == "VOID", "null")
    fields = lambda v: F.coalesce(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
    level = docs.select(F.explode(fields(F.col(doc))).alias("e")).select(F.col("e.key").alias("path"), F.col("e.value").alias("v"))
    level = level.withColumn("tag", F.schema_of_variant("v"))
    for _ in range(max_depth - 1):
        inner = F.transform(fields(F.col("v")), lambda e: F.struct(F.concat_ws(separator, "path", e["key"]).alias("path"), e["value"].alias("v")))
        own = F.array(F.struct("path", "v"))
        level = level.select(F.explode(F.when(F.col("tag").startswith("OBJECT"), inner).otherwise(own)).alias("e")).select("e.path", "e.v").withColumn("tag", F.schema_of_variant("v"))
    number = F.try_variant_get("v", "$", "double")
    kind = kind.when(is_fraction(F.col("tag")), F.when((number == F.floor(number)) & (F.abs(number) < float(2**63)), "int").otherwise("double"))
    return level.where(is_scalar(F.col("tag"))).groupBy("path", kind.alias("kind")).agg(F.count("*").alias("n"))


def as_json(v: Column) -> Column:
    """JSON text of a VARIANT column; null for SQL null."""
    return F.to_json(v)


def of_column(c: Column, kind: T.DataType, nulls: str = "missing") -> Typed:
    """A column of fixed type. nulls says whether SQL null is a missing value or an explicit null; types that hold no scalar are missing."""
    exists, null = (c.isNotNull(), F.lit(False)) if nulls == "missing" else (F.lit(True), c.isNull())
    if isinstance(kind, T.BooleanType):
        return Typed(exists, null, bool=c)
    if isinstance(kind, T.IntegralType):
        return Typed(exists, null, int=c)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return Typed(exists, null, double=c)
    if isinstance(kind, T.DecimalType):
        return Typed(exists, null, int=c) if kind.scale == 0 else Typed(exists, null, double=c.cast("double"))
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return Typed(exists, null, string=c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Typed(exists, null, time=nanos(c))
    return missing()


def nanos(c: Column) -> Column:
    """Nanoseconds since the epoch of a timestamp or date (session time zone: UTC)."""
    return F.unix_micros(c.cast("timestamp")) * 1000
