"""Secret scanning with expressions of Spark SQL alone.

Three kinds of spans come from fixed patterns. The method then adds spans: long tokens whose
characters follow a Markov model of random strings rather than one of ordinary identifiers. Both
are first-order models over ``ALPHABET``, trained on labelled samples; what counts is the
logarithm of the ratio of the two probabilities, summed over the transitions of a token.

Positions are code points. A pattern's matches and the pieces between them give them: a match
starts after all pieces up to it and all matches before it. Running sums and maxima over the spans of
a text go block by block (``running``), as an array that grows by one element at each step would be
copied each time; so the work is linear in the text, however many spans it has.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, hashed_sample, quoted, table

#: Fixed patterns: kind, pattern, group whose length is judged, least length. As their runs are
#: maximal, asking for the least length within `access` and `hex` drops exactly the shorter matches.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Kind of the spans that the method adds.
LEARNED = "markov"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Tokens that the models compare.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Least log-likelihood ratio (nats) of a secret, in all and for each transition.
LEAST, LEAST_EACH = 24.0, 0.8
#: Documents whose words make up the sample of ordinary identifiers; random strings of each form.
SAMPLE_DOCS, RANDOM_STRINGS = 80, 1500
#: What redaction puts in place of a span.
MASK = "[SECRET]"

#: Elements of an array that are scanned as one block.
BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(xs: Column, value: Callable[[Column], Column], join: Callable[[Column, Column], Column], start: Column) -> Column:
    """For each element the join of start and the values of all elements before it.

    Blocks of the array are joined first, then the joins of whole blocks, then the elements of each block.
    """

    def exclusive(ys: Column, of: Callable[[Column], Column], begin: Column) -> Column:
        none = F.slice(F.array(begin), 1, 0)
        step = lambda acc, y: F.struct(join(acc["at"], of(y)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(ys, F.struct(begin.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda k: F.slice(xs, k * BLOCK + 1, BLOCK))

    def whole(blocks: Column) -> Column:
        joins = F.transform(blocks, lambda b: F.aggregate(b, start, lambda acc, x: join(acc, value(x))))
        return F.flatten(F.zip_with(blocks, exclusive(joins, lambda x: x, start), lambda b, begin: exclusive(b, value, begin)))

    return let(xs, lambda v: F.when(F.size(v) > 0, let(cut(v), whole)).otherwise(F.slice(F.array(start), 1, 0)))


#: A match: its kind, its place in code points and in bytes, and its text where it is to be judged.
_SPAN = "array<struct<start:int,kind:int,end:int,from:int,to:int,token:string>>"


def _matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, judge: bool = False) -> Column:
    """The pattern's leftmost matches that do not overlap, by start; texts without any cost one scan. judge: with their text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.zip_with(
        F.arrays_zip(found.alias("found"), judged.alias("judged")),
        F.split(text, pattern, -1),
        lambda x, gap: F.struct(F.length(gap).alias("gap"), F.octet_length(gap).alias("wide"), F.length(x["found"]).alias("size"), F.octet_length(x["found"]).alias("bytes"), F.length(x["judged"]).alias("judged"), x["found"].alias("found")),
    )

    def placed(rows: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"))
        before = running(rows, lambda x: F.struct((x["gap"] + x["size"]).alias("at"), (x["wide"] + x["bytes"]).alias("byte")), lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), (a["byte"] + b["byte"]).alias("byte")), zero)
        spans = F.zip_with(
            rows,
            before,
            lambda x, b: F.struct(
                (b["at"] + x["gap"]).alias("start"),
                F.lit(kind).alias("kind"),
                (b["at"] + x["gap"] + x["size"]).alias("end"),
                (b["byte"] + x["wide"]).alias("from"),
                (b["byte"] + x["wide"] + x["bytes"]).alias("to"),
                (x["found"] if judge else F.lit(None).cast("string")).alias("token"),
            ),
        )
        if group == 0 and not least:
            return spans
        return F.filter(F.zip_with(spans, rows, lambda s, x: F.when(x["judged"] >= least, s)), lambda s: s.isNotNull())

    # the last piece has no match after it
    spans = let(F.filter(rows, lambda x: x["size"].isNotNull()), placed).cast(_SPAN)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and then kind."""
    return F.array_sort(F.concat(*(_matches(text, pattern, i, group, least) for i, (_, pattern, group, least) in enumerate(KINDS))))


def samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, random_strings: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled samples (token, random boolean).

    Random strings are digests in base 64, hexadecimal and base 32-like forms. Ordinary identifiers
    are words of the ``sample_docs`` documents whose ids hash lowest, alone and joined in pairs the
    ways that identifiers are; words in spans of the fixed patterns are left out.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("random string "), F.col("id").cast("string")), 256)
    b64 = F.rtrim(F.base64(F.unhex(digest)), F.lit("="))
    forms = F.array(b64, digest, F.upper(F.substring(F.translate(b64, "+/", ""), 1, 32)), F.translate(b64, "+/", "-_"), F.translate(b64, "+/=", ""))
    noise = spark.range(random_strings).select(F.explode(forms).alias("token"), F.lit(True).alias("random"))
    ids = hashed_sample(docs.where("text IS NOT NULL"), "doc_id", sample_docs)
    text = F.col("text")
    for _, pattern, _, _ in KINDS:
        text = F.regexp_replace(text, pattern, " ")
    words = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w"))
    pair = words.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))").alias("b"))).alias("p")).select(F.col("p")["a"].alias("a"), F.coalesce(F.col("p")["b"], F.lit("id")).alias("b")).distinct()
    number = F.pmod(F.xxhash64("a", "b"), F.lit(100)).cast("string")
    plain = pair.select(F.explode(F.array(F.concat("a", "b"), F.concat_ws("_", "a", "b"), F.concat_ws("-", F.lower("a"), F.lower("b")), F.concat_ws("/", F.lower("a"), "b"), F.concat(F.initcap("a"), F.initcap("b")), F.upper(F.concat_ws("_", "a", "b")), F.concat("a", number), F.concat_ws("_", F.lower("b"), number))).alias("token"))
    return noise.union(plain.select("token", F.lit(False).alias("random")))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, row-wise over ALPHABET, from samples (token, random).

    Counts are smoothed by one half. At most 2 * len(ALPHABET)^2 counts reach the driver. Null and
    short tokens lend no transition; without samples all ratios are 0.
    """
    n = len(ALPHABET)
    ch = lambda at: F.instr(F.lit(ALPHABET), F.col("token").substr(at, F.lit(1)))
    at = labelled.where(F.length("token") > 1).select("token", "random", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"))
    pair = at.select("random", ch(F.col("i")).alias("a"), ch(F.col("i") + 1).alias("b")).where("a > 0 AND b > 0")
    count = {(r["random"], r["a"] - 1, r["b"] - 1): r["count"] for r in pair.groupBy("random", "a", "b").count().collect()}
    ratios = []
    for a in range(n):
        of = {r: sum(count.get((r, a, b), 0) for b in range(n)) + n / 2 for r in (True, False)}
        ratios += [log((count.get((True, a, b), 0) + 0.5) / of[True]) - log((count.get((False, a, b), 0) + 0.5) / of[False]) for b in range(n)]
    return ratios


def _ratio(token: Column, ratios: list[float]) -> Column:
    """Summed log-likelihood ratio of a token's transitions; all its characters are in ALPHABET."""
    model = F.split(F.lit(",".join(f"{x:.3f}" for x in ratios)), ",").cast("array<double>")  # folded to a literal
    place = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))

    def step(acc: Column, at: Column) -> Column:
        more = F.when(acc["last"] >= 0, F.get(model, acc["last"] * len(ALPHABET) + at)).otherwise(0.0)
        return F.struct((acc["sum"] + more).alias("sum"), at.alias("last"))

    return F.aggregate(F.filter(place, lambda p: p >= 0), start, step, lambda acc: acc["sum"])


def apart(tokens: Column, base: Column) -> Column:
    """Those of tokens that touch no base span; both by start."""
    mark = lambda xs, is_token: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(is_token).alias("is_token"), s.alias("span")))
    far = 2**31 - 1

    def judged(all_: Column) -> Column:
        ended = running(all_, lambda x: F.when(x["is_token"], F.lit(0)).otherwise(x["end"]), F.greatest, F.lit(0))
        ahead = F.reverse(running(F.reverse(all_), lambda x: F.when(x["is_token"], F.lit(far)).otherwise(x["start"]), F.least, F.lit(far)))
        rows = F.arrays_zip(all_.alias("x"), ended.alias("ended"), ahead.alias("ahead"))
        free = F.filter(rows, lambda r: r["x"]["is_token"] & (r["ended"] <= r["x"]["start"]) & (r["ahead"] >= r["x"]["end"]))
        return F.transform(free, lambda r: r["x"]["span"])

    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), let(F.array_sort(F.concat(mark(tokens, True), mark(base, False))), judged)).otherwise(tokens)


def learned_spans(text: Column, base: Column, ratios: list[float], least: float = LEAST, each: float = LEAST_EACH) -> Column:
    """Spans of tokens that look random and touch no base span."""
    random = lambda s: _ratio(s["token"], ratios) >= F.greatest(F.lit(least), (s["end"] - s["start"] - 1) * F.lit(each))
    return F.filter(let(_matches(text, TOKEN, len(KINDS), judge=True), lambda found: apart(found, base)), random)


def spans(docs: DataFrame, ratios: list[float], base: str = "__base", all_: str = "__spans") -> DataFrame:
    """docs with its base spans and all spans in two more columns, by start and then kind. A null text has none."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn(base, base_spans(text)).withColumn(all_, F.array_sort(F.concat(base, learned_spans(text, F.col(base), ratios))))


def _told(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k, *_ in KINDS), F.lit(LEARNED))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs (doc_id, text).

    A null text is empty; no spans are an empty string. Repeated rows come out repeated.
    """
    found = spans(docs.select("doc_id", "text"), ratios).drop("text")
    of_kind = lambda i: F.filter("__base", lambda s: s["kind"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{kind}") for i, (kind, *_) in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_told(F.col("__base")).cast("binary"), 256).alias("base_sha256"), _told(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """docs with every span of text replaced by MASK (one for spans that overlap), and n_chars, where there, set anew for changed texts."""
    raw = F.coalesce("text", F.lit("")).cast("binary")  # cut by bytes, as code points would be counted from the start each time
    piece = lambda a, b: F.substring(raw, a + 1, b - a).cast("string")

    def masked(spans: Column) -> Column:
        done = running(spans, lambda s: s["to"], F.greatest, F.lit(0))  # where the spans before end
        parts = F.zip_with(spans, done, lambda s, d: F.when(s["from"] >= d, F.concat(piece(d, s["from"]), F.lit(MASK))).otherwise(""))
        return F.concat(F.array_join(parts, ""), piece(F.array_max(F.transform(spans, lambda s: s["to"])), F.octet_length(raw)))

    base, all_, clean = (fresh(docs, x) for x in ("__base", "__spans", "__clean"))
    joined = let(F.col(all_), masked)
    changed = F.size(all_) > 0
    found = spans(docs, ratios, base, all_).withColumn(clean, F.when(changed, joined).otherwise(F.col("text")))
    size = F.length(clean).cast(dict(docs.dtypes).get("n_chars", "long"))
    own = {"text": F.col(clean).alias("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(changed, size).otherwise(F.col("n_chars")).alias("n_chars")
    return found.select(*(own.get(c, F.col(quoted(c))) for c in docs.columns))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(samples(docs)))
