"""What the corpus operators share: reading tables, Arrow batch limits and durable intermediate tables."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.sources.scratch import shared_dir

#: Rows and bytes of one Arrow batch handed to Python. Bytes matter more: a few texts can be very long.
ARROW_ROWS = "2000"
ARROW_BYTES = str(32 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables. Spark reads it, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that Python workers hold small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back, which cuts its lineage.

    The files outlive lost executors; they are deleted when the driver ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_at = path
    return made


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` has written and that nothing reads any more; other tables are left alone."""
    path = getattr(df, "_written_at", None)
    if path is not None:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the driver's JVM may have ended before
        pass


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    """A column's name as it is written where dots part fields."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """A name like the given one that df has no column of, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow for columns of any name, dots included."""
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(pa.RecordBatch.from_arrays(b.columns, names) for b in batches)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(named, schema)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str | None]:
    """A string column of a batch as Python strings."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def by_bytes(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes add up to about most; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def hashed_sample(rows: DataFrame, key: str, most: int, group: str | None = None) -> DataFrame:
    """(key[, group]) of about ``most`` rows, or ``most`` of each group, whose keys hash lowest; all of a smaller one.

    A count fixes the hash threshold below which twice as many rows are expected, so only those are
    ranked, however large the table is. The result is bounded by ``most`` per group.
    """
    by = [group] if group else []
    spread = (F.xxhash64(key) / F.lit(2.0**64) + 0.5).alias("__at")
    if group:
        count = materialize(rows.groupBy(group).agg(F.count("*").alias("__rows")), "counts")  # of known size: broadcast only if small
        few = rows.select(key, group, spread).join(count, group)
    else:
        few = rows.select(key, spread).withColumn("__rows", F.lit(rows.count()))
    few = few.where(F.col("__at") * F.col("__rows") < 2 * most).select(key, *by, "__at").distinct()  # a key that repeats counts once
    first = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__at", key)
    return few.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= most).select(key, *by)


def extended(schema: StructType, **more: str) -> StructType:
    """A copy of schema with more columns (name=type)."""
    out = StructType(list(schema.fields))
    for name, kind in more.items():
        out.add(name, kind)
    return out
