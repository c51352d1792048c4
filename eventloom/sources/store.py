"""Documents at rest: Parquet below namespace=.../dt=.../batch=..., sorted by time within files.

A write is atomic (Spark's commit protocol), and a batch with a faulty document writes nothing. Time
ranges prune days by partition and row groups by statistics of ts_nanos. Paths may be promoted from
some write on: notes beside the files tell which paths each write has promoted, and columns are read
only of paths that all have; other paths are looked up in the documents.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.paths import candidates, look_up
from eventloom.sources.bindings import Documents
from eventloom.sources.scratch import get_note, names, put_note

#: Types of the columns that hold a promoted path: one for each kind, and a mark for explicit nulls.
_TYPES = {"bool": "boolean", "int": "bigint", "double": "double", "string": "string", "null": "boolean"}


def columns_of(path: str) -> dict[str, str]:
    return {kind: f"{path}:{kind}" for kind in _TYPES}


def _promoted(docs: DataFrame, promote: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """docs with what the paths need, looked up once a row, and the columns of their own."""
    if not promote:
        return docs, []
    docs, typed = look_up(docs, {path: candidates(F.col("doc"), path) for path in promote})
    own = []
    for path, t in typed.items():
        values = t.kinds() | {"null": F.when(t.null, F.lit(True))}
        own += [values[kind].cast(_TYPES[kind]).alias(name) for kind, name in columns_of(path).items()]
    return docs, own


#: What every file has, and how the partitions are read.
SCHEMA = "doc_id string, _source string, doc variant, ts_nanos long, ts timestamp, namespace string, dt date, batch string"
#: The folder of notes, and the batch of plain writes.
NOTES, PLAIN = "_promoted", "0"


def laid_out(docs: DataFrame, promote: Sequence[str] = (), batch: str = PLAIN) -> DataFrame:
    """Documents with their promoted columns and partitions, as they are written."""
    rows, own = _promoted(docs, promote)
    rows = rows.select(*docs.columns, *own, F.to_date("ts").alias("dt"), F.lit(batch).alias("batch"))
    # adaptive execution splits a day that is large and joins days that are small
    return rows.hint("rebalance", "namespace", "dt").sortWithinPartitions("namespace", "dt", "ts_nanos")


def write(docs: DataFrame, root: str, promote: Sequence[str] = (), compression: str = "zstd", batch: str | None = None) -> None:
    """Append documents. promote: paths whose values get columns of their own, one a kind, that scans can filter on.

    Columns of kinds that do not occur are empty, which costs Parquet next to nothing. batch: a name;
    a batch of that name that is there already is replaced, so that a write can be repeated.
    """
    spark = docs.sparkSession
    rows = laid_out(docs, promote, batch or PLAIN)
    told = json.dumps(sorted(set(promote)))
    # before the files: a note too many only costs a push-down, one too few would cost rows
    put_note(spark, f"{root}/{NOTES}/{hashlib.sha256(told.encode()).hexdigest()[:16]}.json", told)
    out = rows.write.option("compression", compression).partitionBy("namespace", "dt", "batch")
    if batch is None:
        out.mode("append").parquet(root)
    else:
        out.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)


def promoted_by_all(spark: SparkSession, root: str) -> set[str]:
    """Paths that every write to a store has promoted."""
    notes = [set(json.loads(get_note(spark, f"{root}/{NOTES}/{n}"))) for n in names(spark, f"{root}/{NOTES}") if n.endswith(".json") and n[0] != "."]
    return set.intersection(*notes) if notes else set()


def bind(spark: SparkSession, root: str, namespace: str, promote: Sequence[str] = (), **options) -> Documents:
    """A namespace of a store. promote: paths that are read from columns of their own where all files have them."""
    if not any(n[0] not in "_." for n in names(spark, root)):
        raise ValueError(f"no documents below {root}")
    common = promoted_by_all(spark, root) & set(promote)
    schema = SCHEMA + "".join(f", `{c}` {_TYPES[kind]}" for p in sorted(common) for kind, c in columns_of(p).items())
    rows = spark.read.schema(schema).parquet(root).where(F.col("namespace") == namespace)
    return Documents(rows, promoted={p: columns_of(p) for p in common}, **options)
