"""Language identification by prediction by partial matching (PPM).

Every language has a context tree of orders 0 to K over bytes. A symbol that a context has not
seen costs that context's escape (method C: distinct symbols / (total + distinct)) and is then
coded one order lower, down to a uniform code. The statistics are frozen after training, so the
code length of a text is a sum over its positions, and the language with the shortest code wins.

The trees are compiled into sorted tables, one for each order: a row for each gram that some language
has seen, with its exact code length in every language, escapes included. A position of a text is
looked up in the table of the greatest order; if no language has seen its gram there, it costs the
context's escapes and is looked up one order lower. Scoring is a binary search and a segmented sum per
text, with no tree walk. Languages are compiled in groups, so that a group's tables stay small however
many languages there are; a group's code lengths do not depend on the others. What is sent to workers
are the counts of the trees; each worker compiles them once.

Bytes are those of the text in UTF-8, lower-cased first (whole strings, by Unicode).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, by_bytes, columns, hashed_sample, map_batches, quoted, table, texts_of

#: Labelled texts that the trees of one language are trained on, and distinct grams that it keeps (the most frequent), at most.
TRAIN_DOCS, TRAIN_GRAMS = 400, 1 << 20
#: The greatest order of a context, in bytes.
ORDER = 3
#: Rows times languages of a group's tables, about.
CELLS = 1 << 24
#: Bytes scored at a time.
CHUNK = 1 << 20
UNDETERMINED = "und"
#: Bits a byte of a code that knows nothing, and from which on a text is in none of the languages: the
#: escapes have made it half as long again. Ordinary text of languages learned from other texts takes 2 to 10.
FLAT, FOREIGN = 8.0, 12.0


@dataclass
class Group:
    """Compiled trees of some languages. Of each order: grams and contexts, ascending, and bits with a column for each language."""

    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def at(self, gram: np.ndarray, order: int) -> np.ndarray:
        """Code lengths of the last byte of grams of order + 1 bytes in the context of the others."""
        table = self.grams[order]
        place = np.minimum(np.searchsorted(table, gram), len(table) - 1)
        out = self.bits[order][place]
        new = np.flatnonzero(table[place] != gram)
        if len(new):
            gram = gram[new]
            known = self.contexts[order]
            place = np.minimum(np.searchsorted(known, gram >> 8), len(known) - 1)
            escape = np.where((known[place] == gram >> 8)[:, None], self.escapes[order][place], 0)
            out[new] = escape + (self.at(gram & ((1 << 8 * order) - 1), order - 1) if order else FLAT)
        return out


def compile_group(counts: list[tuple[np.ndarray, np.ndarray]], order: int) -> Group:
    """Tables from each language's counts of grams of order + 1 bytes (big-endian integers, ascending, and how often)."""
    made = Group([], [], [], [])
    lower = None
    for k in range(order + 1):
        mask = (1 << 8 * (k + 1)) - 1
        grams = np.unique(np.concatenate([g & mask for g, _ in counts]))
        n = np.stack([np.bincount(np.searchsorted(grams, g & mask), c, len(grams)) for g, c in counts], 1)
        contexts, of = np.unique(grams >> 8, return_inverse=True)
        total, distinct = (np.stack([np.bincount(of, x, len(contexts)) for x in y.T], 1) for y in (n, n > 0))
        seen = total > 0
        every = np.where(seen, total + distinct, 1.0)
        escape = np.where(seen, np.log2(every / np.maximum(distinct, 1)), 0.0)
        below = FLAT if lower is None else lower[np.searchsorted(made.grams[-1], grams & (mask >> 8))]
        with np.errstate(divide="ignore"):
            bits = np.where(n > 0, np.log2(every[of]) - np.log2(n), escape[of] + below)
        lower = bits
        made.grams.append(grams)
        made.bits.append(bits.astype(np.float32))
        made.contexts.append(contexts)
        made.escapes.append(escape.astype(np.float32))
    return made


@dataclass
class Trees:
    """Context trees of several languages, as counts of grams of order + 1 bytes."""

    langs: list[str]
    order: int
    counts: list[tuple[np.ndarray, np.ndarray]]  # of each language: grams, ascending, and how often

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "groups"}

    @cached_property
    def groups(self) -> list[Group]:
        """The languages in groups of consecutive ones whose grams, times languages, are about CELLS at most."""
        out, held, rows = [], [], 0
        for c in self.counts:
            if held and (rows + len(c[0])) * (len(held) + 1) > CELLS:
                out.append(compile_group(held, self.order))
                held, rows = [], 0
            held.append(c)
            rows += len(c[0])
        return [*out, compile_group(held, self.order)]

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths of grams in all languages."""
        found = [g.at(grams, self.order) for g in self.groups]
        return found[0] if len(found) == 1 else np.concatenate(found, 1)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code lengths in bits, one row per text and one column per language.

        Every text starts in the context of spaces; an empty text costs nothing.
        """
        k = self.order
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        out = np.zeros((len(raw), len(self.langs)))
        for lo, hi in by_bytes(raw, CHUNK):
            pad = b" " * k
            if hi - lo == 1 and len(raw[lo]) > CHUNK:  # a long text goes piece by piece, with its context
                whole = pad + raw[lo]
                pieces, owner = [whole[i : i + CHUNK + k] for i in range(0, len(whole) - k, CHUNK)], lo
            else:
                pieces, owner = [pad + pad.join(raw[lo:hi])], None
            for piece in pieces:
                s = np.frombuffer(piece, np.uint8).astype(np.int64)
                at = s[: len(s) - k].copy()
                for j in range(1, k + 1):
                    at = at << 8 | s[j : len(s) - k + j]
                if owner is not None:
                    out[owner] += self.bits(at).sum(0, dtype=np.float64)
                    continue
                # positions of text i in `at`: its bytes, then the k that belong to the next one's padding
                size = np.fromiter(map(len, raw[lo:hi]), np.int64, hi - lo)
                start = np.concatenate([[0], np.cumsum(size + k)[:-1]])
                full = size > 0
                if full.any():
                    cuts = np.stack([start[full], (start + size)[full]], 1).ravel()
                    if cuts[-1] == len(at):
                        cuts = cuts[:-1]
                    out[lo:hi][full] = np.add.reduceat(self.bits(at), cuts, axis=0, dtype=np.float64)[::2]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Best language, its posterior under equal priors, and the bits a byte that it takes."""
        bits = self.lengths(texts)
        best = bits.argmin(1)
        low = bits[np.arange(len(best)), best]
        share = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
        size = np.array([max(1, len(t.lower().encode("utf-8", "surrogatepass"))) for t in texts])
        return [self.langs[i] for i in best], share, low / size


def compile_trees(langs: list[str], grams: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Trees:
    """Trees from each language's counts of grams of order + 1 bytes (big-endian integers, counts)."""
    counts = []
    for keys, n in grams:
        by = np.argsort(keys)
        counts.append((keys[by].astype(np.int64), n[by].astype(np.int64)))
    return Trees(langs, order, counts)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n): four-byte grams of each batch, counted."""
    for batch in batches:
        langs = np.array(texts_of(batch, "lang"), object)
        raw = [b"   " + t.lower().encode("utf-8", "surrogatepass") for t in texts_of(batch, "text")]
        for lang in set(langs):
            mine = [raw[i] for i in np.flatnonzero(langs == lang)]
            for lo, hi in by_bytes(mine, 1 << 22):
                keys = []
                for r in mine[lo:hi]:
                    b = np.frombuffer(r, np.uint8).astype(np.uint32)
                    keys.append(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:])
                gram, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def train(labelled: DataFrame, docs: int = TRAIN_DOCS) -> Trees | None:
    """Trees from (doc_id, lang, text) rows: of each language the ``docs`` rows whose ids hash lowest.

    Rows without a language or text are not used, and of an id that repeats only its least text. None if no row is left. Only gram counts of
    that sample reach the driver, the ``TRAIN_GRAMS`` most frequent ones of a language.
    """
    spark = labelled.sparkSession
    bound_batches(spark)
    rows = labelled.select("doc_id", "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    ids = hashed_sample(rows, "doc_id", docs, "lang")
    sample = rows.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    got = sample.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    often = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    got = got.withColumn("rank", F.row_number().over(often)).where(F.col("rank") <= TRAIN_GRAMS).drop("rank").toArrow()
    lang, gram, n = (got.column(c).to_numpy() for c in ("lang", "gram", "n"))
    langs = sorted(set(lang))
    if not langs:
        return None
    return compile_trees(langs, [(gram[lang == x], n[lang == x]) for x in langs])


def identify(docs: DataFrame, trees: Trees | None, text: str = "text", carry: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """The ``carry`` columns of docs (all, by default) and a language, a score and bits per byte.

    A text that is null or has no letter, and any text if there are no trees, is ``und`` with
    score 0 and null bits. Every whole text is scored. Carried columns called like one of
    ``names`` are left out. Repeated rows are scored each, with equal results.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in names]
    schema = docs.select(*map(quoted, carry)).schema
    for name, kind in zip(names, ("string", "double", "double"), strict=True):
        schema = schema.add(name, kind)
    sent = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = texts_of(batch, text)
            use = [i for i, t in enumerate(texts) if t and model is not None and any(map(str.isalpha, t))]
            lang, score, rate = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            if use:
                best, share, per_byte = model.predict([texts[i] for i in use])
                score[use] = share
                for i, x, r in zip(use, best, per_byte.tolist(), strict=True):
                    lang[i], rate[i] = x, r
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in carry), pa.array(lang, pa.string()), pa.array(score), pa.array(rate, pa.float64())],
                [*carry, *names],
            )

    return map_batches(docs.select(*map(quoted, dict.fromkeys([*carry, text]))), run, schema)


def held_out():
    """Column: the document is kept from training (crc32 of its id as text, mod 4, is 2)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out.

    Returns doc_id, held_out, lang_pred, score, bits_per_byte. A null doc_id counts as not held out.
    """
    docs = table(spark, sf_dir, "documents")
    trees = train(docs.where(~held_out()))
    return identify(docs, trees, carry=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_identified(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """Rows of docs whose text is in one of the languages.

    ``und`` goes, and so does a text that the best language codes in ``FOREIGN`` bits a byte or more: one in
    a script that no language has, or noise. Without trees nothing stays.
    """
    names = ("__found_lang", "__found_score", "__found_bits")
    found = identify(docs, trees, names=names).where((F.col(names[0]) != UNDETERMINED) & (F.col(names[2]) < FOREIGN))
    return found.select(*columns(docs))
