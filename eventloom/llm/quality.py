"""Quality rules: fixed limits, and a likelihood ratio of hashed n-grams.

Two multinomials over hashed byte n-grams are estimated, one from all trusted documents and one
from all documents. The mean logarithm of their ratio over the n-grams of a text says whether the text
is more like the trusted ones than like the corpus, whatever its length. A text whose mean reaches
the threshold is kept. The threshold is a low quantile of the means of all trusted documents, so it
is fixed once the corpus is; nothing is drawn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, by_bytes, materialize, table, texts_of

#: Bytes of an n-gram, and hash buckets.
GRAM, BUCKETS = 4, 1 << 16
#: Share of the trusted documents that the threshold leaves below; pseudo-count of a bucket.
QUANTILE, PSEUDO = 0.002, 0.5
#: What the threshold stays below that quantile, in nats a gram.
MARGIN = 0.2
#: Fixed limits: least words, and greatest share of words in repeated windows (percent).
MIN_WORDS, MAX_REPEATED = 50, 50
WINDOW, SYMBOLS = 3, "#*$%&|<>"
#: Bytes hashed at a time.
CHUNK = 1 << 20
#: Trusted ids up to which they are broadcast; beyond, texts are shuffled once to meet them.
BROADCAST = 1_000_000
#: Values of which a rank is looked up in one go, and parts that a range of more values is cut into.
GATHER, PARTS = 100_000, 4096


@dataclass
class Ratio:
    """Per bucket log(p_trusted / p_corpus), and the threshold on its mean."""

    ratio: np.ndarray
    threshold: float

    def means(self, texts: list[bytes]) -> np.ndarray:
        """Mean ratio over the grams of each text; 0 for a text shorter than a gram."""
        total, size = np.zeros(len(texts)), np.zeros(len(texts))
        for owner, grams, cuts in _grams(texts):
            total[owner] += np.add.reduceat(self.ratio[grams], cuts)
            size[owner] += np.diff(np.append(cuts, len(grams)))
        return np.divide(total, size, out=np.zeros(len(texts)), where=size > 0)


def _grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices of texts, buckets of their grams, where each text's start); a long text comes in several parts."""
    use = [i for i, t in enumerate(texts) if len(t) >= GRAM]
    for lo, hi in by_bytes([texts[i] for i in use], CHUNK):
        if hi - lo == 1:
            whole = texts[use[lo]]
            parts = [whole[i : i + CHUNK + GRAM - 1] for i in range(0, len(whole) - GRAM + 1, CHUNK)]
        else:
            parts = [b"".join(texts[i] for i in use[lo:hi])]
        for flat in parts:
            b = np.frombuffer(flat, np.uint8).astype(np.uint32)
            key = b[: len(b) - GRAM + 1].copy()
            for j in range(1, GRAM):
                key = key << np.uint32(8) | b[j : len(b) - GRAM + 1 + j]
            bucket = (key * np.uint32(2654435761)) >> np.uint32(32 - 16)
            if hi - lo == 1:
                yield np.array([use[lo]]), bucket, np.array([0])
                continue
            size = np.array([len(texts[i]) for i in use[lo:hi]])
            # grams that straddle two texts are left out
            end = np.cumsum(size)
            keep = np.ones(len(bucket), bool)
            for j in range(1, GRAM):
                keep[end[:-1] - j] = False
            yield np.array(use[lo:hi]), bucket[keep], np.concatenate([[0], np.cumsum(size - GRAM + 1)[:-1]])


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def histogram(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts of docs (text, trusted): those not trusted, and those trusted. Every task sends a row a bucket of each at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            texts, trusted = _bytes(texts_of(batch, "text")), batch.column(1).to_pylist()
            for kind in (0, 1):
                for _, grams, _ in _grams([t for t, k in zip(texts, trusted, strict=True) if k == kind]):
                    total[kind] += np.bincount(grams, minlength=BUCKETS)
        kind, at = np.nonzero(total)
        yield pa.record_batch([pa.array(kind.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[kind, at])], ["kind", "bucket", "n"])

    got = docs.select("text", "trusted").mapInArrow(run, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, BUCKETS))
    out[got.column("kind").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def means_of(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text) that has a word."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _bytes(texts_of(batch, "text"))
            some = np.array([bool(t) and not t.isspace() for t in raw], bool)
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.means(raw))], ["doc_id", "score"])
            yield made.filter(pa.array(some))

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("score", "double"))


def ranked(values: DataFrame, rank: int) -> float:
    """The value (column score, not null) of a rank (from 0), exactly: the range that holds it is cut until few values are left to gather."""
    lo, hi, n = values.agg(F.min("score"), F.max("score"), F.count("score")).first()
    while n > GATHER and lo < hi:
        values = values.where(F.col("score").between(lo, hi))
        part = F.floor((F.col("score") - lo) / (hi - lo) * PARTS)
        for _, low, high, n in sorted(values.groupBy(part).agg(F.min("score"), F.max("score"), F.count("score")).collect()):
            if rank < n:
                lo, hi = low, high
                break
            rank -= n
    if lo == hi:
        return lo
    return float(np.sort(values.where(F.col("score").between(lo, hi)).select("score").toArrow().column(0).to_numpy())[rank])


def quantile_of(values: DataFrame, quantile: float) -> float:
    """That quantile of all values (column score), between two ranks as numpy has it; minus infinity without values."""
    n = values.count()
    if not n:
        return -np.inf
    at = quantile * (n - 1)
    low = int(at)
    ends = [ranked(values, k) for k in (low, min(low + 1, n - 1))]
    return float(np.interp(at, [low, low + 1], ends))


def fit(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> Ratio:
    """The ratio of the trusted documents, all rows whose id has quality 1, to all of docs.

    Without trusted documents all ratios are 0 and every text passes.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    ids = materialize(labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct(), "trusted")
    good = ids.withColumn("good", F.lit(True))
    good = F.broadcast(good) if ids.count() <= BROADCAST else good
    rest, target = histogram(rows.join(good, "doc_id", "left").select("text", F.col("good").isNotNull().alias("trusted")))
    if not target.sum():
        return Ratio(np.zeros(BUCKETS), -np.inf)
    p, q = ((x + PSEUDO) / (x + PSEUDO).sum() for x in (target, rest + target))
    made = Ratio(np.log(p / q), -np.inf)
    # scores meet the ids after texts are judged, as they are small
    means = materialize(means_of(rows, made).join(good, "doc_id", "left_semi").select("score"), "means")
    made.threshold = quantile_of(means, quantile) - MARGIN
    return made


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()  # of bytes: at ASCII white space
    n = len(words)
    flat = b"".join(words)
    chars = len(flat) if flat.isascii() else len(flat.decode("utf-8", "surrogatepass"))
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > WINDOW:
        place: dict[bytes, int] = {}
        ids = np.fromiter([place.setdefault(w, len(place)) for w in words], np.int64, n)
        k = len(place)
        if k < 2_000_000:
            windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
        else:  # three numbers no longer fit one
            pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
            windows = pairs[:-1] * k + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            cover[:-2] |= twice
            cover[1:-1] |= twice
            cover[2:] |= twice
            repeated = int(cover.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judge(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """doc_id and the counts, base_failed, kept and score (mean ratio) of every row of docs (doc_id, text).

    A null or empty text has no words and fails. Whole texts are judged; repeated rows come out repeated.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(ratio)
    rows = docs.select("doc_id", "text")
    schema = rows.select("doc_id").schema
    for part in _SCHEMA.split(", "):
        schema = schema.add(*part.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            raw = _bytes(texts_of(batch, "text"))
            counts = np.array([base(t) for t in raw], np.int64).reshape(-1, 5)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED * counts[:, 0])
            score = model.means(raw)
            kept = ~failed & (score >= model.threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(score)], schema.names)

    return rows.mapInArrow(run, schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every document; trusted are all documents that ``labels`` calls good."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
