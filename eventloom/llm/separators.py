"""Token counts of documents in flat token files by a separator scan.

A flat file is token ids one after the other, little-endian, each document closed by an end id, and
nothing that says where documents begin. Files are read as blocks of equal size, in any order and
on any worker. Each block is searched for the end id at once (a vector comparison). A document may
span blocks, so a prefix scan over the blocks of a file stitches them: the number of ends before a
block numbers its documents, and the last end before it says where the first of them began. The
scan has two levels, within groups of blocks and over the groups, so that even one huge file is
scanned by many tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, extended, materialize, table, texts_of

#: Tokens of a block, blocks of a group of the scan, and texts tokenized at a time.
BLOCK, GROUP, STEP = 1 << 18, 1024, 64
#: The id that ends a document, and how ids are stored.
END, WIDTH = 50256, "<u2"


@lru_cache(1)
def _encoding(path: str | None = None) -> tiktoken.Encoding:
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def flat_files(docs: DataFrame, block: int = BLOCK, path: str | None = None) -> DataFrame:
    """docs (doc_id, text) as flat token files, one for each partition, held as rows of a table.

    Rows with tokens are blocks (file, block, tokens); rows without say which document is the
    ordinal-th of a file (file, ordinal, doc_id). A null text has no tokens but still its end.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    schema = extended(rows.select("doc_id").schema, file="long", block="long", tokens="binary", ordinal="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, file = _encoding(path), TaskContext.get().partitionId()
        held, number, ordinal = [], 0, 0
        kind = None

        def out(tokens: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([file]), pa.array([number]), pa.array([tokens.tobytes()], pa.binary()), pa.nulls(1, pa.int64())], schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            n = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, file)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.arange(ordinal, ordinal + n))], schema.names)
            ordinal += n
            texts = texts_of(batch, "text")
            for i in range(0, n, STEP):
                for ids in encoding.encode_ordinary_batch([t or "" for t in texts[i : i + STEP]], num_threads=1):
                    held.append(np.array([*ids, END], WIDTH))
                if sum(map(len, held)) >= block:
                    flat = np.concatenate(held)
                    while len(flat) >= block:
                        yield out(flat[:block])
                        number, flat = number + 1, flat[block:]
                    held = [flat]
        if sum(map(len, held)):
            yield out(np.concatenate(held))

    return rows.mapInArrow(run, schema)


def read_flat(spark: SparkSession, path: str, block: int = BLOCK, width: str = WIDTH) -> DataFrame:
    """(path, file, block, tokens) of flat token files, for ``count``: a file is read by ranges of its bytes, each in a task of its own.

    path: a file, a folder or a pattern that Spark's readers take; file: a number made of the file's path.
    Files are opened by workers, from any store that Arrow knows. An empty file has no blocks. A
    file that does not end with a whole token raises an error.
    """
    step = block * np.dtype(width).itemsize
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")  # sizes only: no content is read
    last = F.floor((F.col("length") - 1) / step)
    parts = files.select("path", F.xxhash64("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (at, _, number, length) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if length % np.dtype(width).itemsize:
                    raise ValueError(f"{at} does not end with a whole token")
                store, name = (fs.LocalFileSystem(), "/" + at.removeprefix("file:").lstrip("/")) if at.startswith("file:") else fs.FileSystem.from_uri(quote(at, safe=":/@"))
                with store.open_input_file(name) as f:
                    raw = f.read_at(min(step, length - number * step), number * step)
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns[:3], pa.array([raw], pa.binary())], ["path", "file", "block", "tokens"])

    return parts.repartition("file", "block").mapInArrow(run, "path string, file long, block long, tokens binary")


def count(blocks: DataFrame, block: int = BLOCK, end: int = END, width: str = WIDTH) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document in blocks (file, block, tokens).

    All blocks of a file but the last hold ``block`` tokens. n_tokens leaves the end id out, and
    documents without tokens count 0. Tokens after a file's last end are one more document that is
    not closed. A file without blocks, or with empty ones only, has no documents.
    """
    bound_batches(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, number, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tokens = np.frombuffer(raw, width)
                base = number * block
                ends = np.flatnonzero(tokens == end).astype(np.int64) + base
                n = len(ends)
                # of the first document of a block the start is not known here; the last row is the block's own end
                start = pa.array(np.concatenate([[0], ends[:-1] + 1, [0]])[: n + 1] if n else [0], pa.int64(), mask=np.arange(n + 1) % (n or 1) == 0)
                yield pa.record_batch([pa.array(np.full(n + 1, file)), pa.array(np.full(n + 1, number)), pa.array(np.append(np.arange(n), -1)), start, pa.array(np.append(ends, base + len(tokens)))], ["file", "block", "k", "start", "end"])

    found = materialize(blocks.select("file", "block", "tokens").mapInArrow(run, "file long, block long, k long, start long, end long"), "ends")
    ends = found.where("k >= 0")
    each = ends.groupBy("file", "block").agg(F.count("*").alias("n"), F.max("end").alias("last")).withColumn("group", F.floor(F.col("block") / GROUP))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = each.groupBy("file", "group").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    groups = groups.select("file", "group", F.sum("n").over(before("file", "group")).alias("n0"), F.max("last").over(before("file", "group")).alias("last0"))
    inner = each.select("file", "group", "block", F.sum("n").over(before("file", "group", "block")).alias("n1"), F.max("last").over(before("file", "group", "block")).alias("last1"))
    carried = inner.join(groups, ["file", "group"]).select("file", "block", (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("so_far"), (F.coalesce("last1", "last0", F.lit(-1)) + 1).alias("open"))
    whole = ends.join(carried, ["file", "block"]).select("file", (F.col("so_far") + F.col("k")).alias("ordinal"), F.coalesce("start", "open").alias("start"), "end", F.lit(True).alias("closed"))
    tails = found.groupBy("file").agg(F.sum(F.when(F.col("k") >= 0, 1).otherwise(0)).alias("ordinal"), (F.coalesce(F.max(F.when(F.col("k") >= 0, F.col("end"))), F.lit(-1)) + 1).alias("start"), F.max(F.when(F.col("k") < 0, F.col("end"))).alias("end"))
    tails = tails.where("end > start").select("file", "ordinal", "start", "end", F.lit(False).alias("closed"))
    return whole.union(tails).select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "closed")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, counted in flat files of the documents: doc_id, file, ordinal, start, n_tokens.

    A null or empty text has 0 tokens. Repeated rows are documents of their own. An empty table gives no rows.
    """
    files = materialize(flat_files(table(spark, sf_dir, "documents")), "flat")
    names = files.where("tokens IS NULL").select("file", "ordinal", "doc_id")
    return count(files.where("tokens IS NOT NULL")).join(names, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
