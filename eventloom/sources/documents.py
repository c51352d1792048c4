"""JSON documents as rows: doc_id, namespace, ts_nanos, ts, _source and doc, a VARIANT of the whole text."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.paths import once, scalar
from eventloom.functions.times import rfc3339, rfc3339_nanos
from eventloom.sources.bindings import TIMESTAMP

NAMESPACE = "service"


def assemble(
    lines: DataFrame,
    namespace: str = NAMESPACE,
    timestamp: str = TIMESTAMP,
    on_error: str = "fail",
    precision: int | None = None,
    doc_id: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Documents from lines (value string), one JSON object each.

    A line that is no object, or that lacks the namespace or an RFC 3339 timestamp, fails the whole
    batch (on_error="fail") or is left out ("skip"). precision truncates times to so many nanoseconds.
    doc_id makes ids from the parsed document; they are random by default, and never looked at.
    """
    rows = lines.select(F.col("value").alias("_source"), F.try_parse_json("value").alias("doc"))
    rows, found = once(rows, [F.try_variant_get("doc", f"$['{key}']", "variant") for key in (namespace, timestamp)])
    space, time = (scalar(v).string for v in found)
    rows, (space, time) = once(rows, [space, rfc3339(time)])
    rows, (nanos,) = once(rows, [rfc3339_nanos(time)])
    if precision:
        nanos = nanos - F.pmod(nanos, F.lit(precision))
    # what has the fields is an object; the schema of a whole document is asked for only to tell what is wrong with it
    ends = F.rtrim("_source").endswith("}")
    good = ends & space.isNotNull() & nanos.isNotNull()
    if on_error == "skip":
        rows = rows.where(good)
    else:
        say = lambda what: F.raise_error(F.concat(F.lit(f"cannot parse document, {what}: "), F.col("_source")))
        object_ = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT") & ends, F.lit(False))
        wrong = F.when(~object_, say("not an object")).when(space.isNull(), say(f"no namespace field {namespace}")).when(nanos.isNull(), say(f"no timestamp field {timestamp}"))
        nanos = F.when(good, nanos).otherwise(wrong.cast("long"))
    rows = rows.select("_source", "doc", space.alias("namespace"), nanos.alias("ts_nanos"))
    made = F.uuid() if doc_id is None else doc_id(F.col("doc"))
    return rows.select(made.alias("doc_id"), "namespace", "ts_nanos", F.timestamp_micros(F.expr("ts_nanos div 1000")).alias("ts"), "_source", "doc")


def from_fields(spark: SparkSession, namespace: str, documents: list[dict[str, Any]]) -> DataFrame:
    """Documents whose fields are flat already: {"time_nanos", "fields": {path: scalar}, "id"?, "source"?}.

    Fields are taken as they are: no depth limit or key suffix leaves one out on the way in. A
    document without a source gets its fields as one JSON object.
    """
    rows = []
    for d in documents:
        for path, value in d["fields"].items():
            if not (value is None or isinstance(value, (bool, int, float, str))):
                raise ValueError(f"field {path} is no scalar")
        text = json.dumps(d["fields"], separators=(",", ":"), ensure_ascii=False)
        rows.append((d.get("id"), namespace, int(d["time_nanos"]), d.get("source") or text, text))
    got = spark.createDataFrame(rows, "doc_id string, namespace string, ts_nanos long, _source string, flat string")
    return got.select(F.coalesce("doc_id", F.uuid()).alias("doc_id"), "namespace", "ts_nanos", F.timestamp_micros(F.expr("ts_nanos div 1000")).alias("ts"), "_source", F.parse_json("flat").alias("doc"))


def read_lines(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Documents of newline-delimited JSON files."""
    return assemble(spark.read.text(path), **options)
