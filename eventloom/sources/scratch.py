"""Files beside tables: folders that driver and executors share, and small notes."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one in local mode, else an error."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="eventloom-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder; none if there is no such folder."""
    fs, at = _at(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def put_note(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written if it is not there."""
    fs, at = _at(spark, path)
    if not fs.exists(at):
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()


def get_note(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(size)).decode()
    finally:
        stream.close()
