"""Mixing sources to target weights by temperature, with expressions of Spark SQL alone.

A source's share of the tokens is raised to an exponent between 0 (uniform) and 1 (as it is) and
normalised. The exponent is found by bisection, several cuts at once, on aggregates over the table
of sources: it is the largest whose entropy reaches the target, or the smallest that keeps every
source within the repetition limit, whichever is larger. So nothing depends on how many sources
there are.

A source is cut into hash blocks of about ``BLOCK_TOKENS`` tokens of its own. Its budget, weight times
total, is spent in epochs: whole passes over all its blocks, each in an order of its own, and then as
many blocks of one more order as come closest to what is left. A row's ``mix_at`` in [0, 1) says where
in the mixture it stands; ``in_order`` puts rows there.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, quoted, table

#: Entropy to reach, as a share of that of uniform weights, and how often a source may be repeated.
ENTROPY, REPEATS = 0.97, 2.0
#: Tokens of a block, about, and the most blocks that a source is cut into.
BLOCK_TOKENS, BLOCKS = 1 << 16, 4096
#: Bytes of a table of sources or blocks up to which it is broadcast.
BROADCAST = 32 << 20
#: Cuts of the exponent's interval in a step, and steps.
CUTS, STEPS = 16, 8
SEED = 42

#: A document's tokens are estimated as tokenizers split before they merge: runs of Latin letters, single
#: digits, runs of ASCII signs, single letters of scripts that are written without spaces, and runs of
#: anything else beyond ASCII; and an end. Ranges of code points only, which cost little to test.
_ALONE = r"\u0E00-\u0E7F\u2E80-\u9FFF\uF900-\uFAFF\uFF66-\uFF9D"
_LATIN = r"A-Za-z\u00C0-\u024F"
TOKEN = rf"[{_LATIN}]++|[0-9]|[!-/:-@\[-`{{-~]++|[{_ALONE}\x{{20000}}-\x{{3FFFF}}]|[^\x00-\x7F\u00C0-\u024F{_ALONE}\x{{20000}}-\x{{3FFFF}}]++"
#: Columns that mixing adds.
NAMES = ("block", "epoch", "mix_at", "n_tokens")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long") + 1


def exponent(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None) -> float:
    """The exponent for sources (source, n_tokens).

    budget: tokens of the mixture; None lets it grow until every source is used once at least, and
    then ``repeats`` bounds the ratio of the most to the least repeated source. 1 if there is no
    source. A target that cannot be met is approached as far as it can be.
    """
    total, k = sources.agg(F.sum("n_tokens"), F.count("*")).first()
    if not k or k == 1:
        return 1.0

    def search(good: Column, rising: bool) -> float:
        """Edge of the exponents in [0, 1] for which good holds; it holds above the edge if rising, else below."""
        lo, hi = 0.0, 1.0
        for _ in range(STEPS):
            at = [lo + (hi - lo) * i / CUTS for i in range(CUTS + 1)]
            ok = sources.select(F.explode(F.array(*map(F.lit, at))).alias("t"), (F.col("n_tokens") / F.lit(float(total))).alias("share")).withColumn("w", F.pow("share", "t"))
            ok = {r["t"]: r["ok"] for r in ok.groupBy("t").agg(good.alias("ok")).collect()}
            held = [ok[t] for t in at]
            if all(held) or not any(held):
                return (lo if rising else hi) if all(held) else (hi if rising else lo)
            i = held.index(True) if rising else held.index(False)
            lo, hi = at[i - 1], at[i]
        return hi if rising else lo

    z = F.sum("w")
    spread = F.log(z) - F.sum(F.col("w") * F.log("w")) / z  # entropy of w / z
    by_entropy = search(spread >= entropy * log(k), rising=False)
    each = F.col("w") / F.col("share")
    most = F.max(each) / F.min(each) if budget is None else F.max(each) / z * (budget / total)
    return max(by_entropy, search(most <= repeats * (1 + 1e-9), rising=True))


def weights(sources: DataFrame, power: float, budget: float | None = None) -> DataFrame:
    """sources (source, n_tokens) with weight and with epochs, the number of passes, fractional."""
    total = sources.agg(F.sum("n_tokens")).first()[0] or 0
    raw = sources.withColumn("__w", F.pow(F.col("n_tokens") / F.lit(float(max(total, 1))), F.lit(power)))
    z, least = raw.agg(F.sum("__w"), F.min(F.col("__w") / F.col("n_tokens"))).first()
    if z is None:
        return raw.withColumn("weight", F.lit(0.0)).withColumn("epochs", F.lit(0.0)).drop("__w")
    tokens_in_all = z / least if budget is None else budget
    return raw.withColumn("weight", F.col("__w") / F.lit(z)).withColumn("epochs", F.col("weight") * F.lit(tokens_in_all) / F.col("n_tokens")).drop("__w")


def schedule(blocks: DataFrame, weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, block, uses): uses are the (epoch, mix_at) of a block, as many as it is repeated.

    blocks: (source, block, n_tokens), a null block not among them; weighted: as ``weights`` gives it. A
    null source is a source. A source has at most ``BLOCKS`` blocks, so the running sums over its blocks
    are small; ties in a permutation's order go to smaller blocks.
    """
    whole = F.floor(F.col("epochs") + 1e-9).cast("int")
    rest = F.greatest(F.col("epochs") - whole, F.lit(0.0)) * F.col("__all")
    rows = blocks.join(weighted.select(F.col("source").alias("__source"), F.col("n_tokens").alias("__all"), "epochs"), F.col("source").eqNullSafe(F.col("__source")))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), whole)))
    order = Window.partitionBy("__source", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "block"), "block")
    rows = rows.withColumn("__before", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens"))
    rows = rows.where((F.col("epoch") < whole) | (F.col("__before") + F.col("n_tokens") / 2 <= rest))
    rows = rows.withColumn("mix_at", (F.col("epoch") * F.col("__all") + F.col("__before")) / F.greatest(F.col("epochs"), F.lit(1e-12)) / F.col("__all"))
    return rows.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", F.least("mix_at", F.lit(1 - 1e-12)).alias("mix_at")))).alias("uses"))


def _sized(small: DataFrame, row: Column) -> DataFrame:
    """A written table, to be broadcast if its rows take ``BROADCAST`` bytes at most; row: bytes of one."""
    size = small.agg(F.sum(F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + row)).first()[0] or 0
    return F.broadcast(small) if size <= BROADCAST else small


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None, seed: int = SEED, names: tuple[str, str, str, str] = NAMES) -> DataFrame:
    """docs with block int, epoch int, mix_at double, n_tokens long: a row for each time that a document is used.

    A null source is a source of its own; a null text counts one token. With the default budget
    every document is used once at least; a given budget may leave blocks out. names: of the added
    columns; columns of docs that are called so are left out, all others are carried as they are.
    Equal rows share a block and are used alike. An empty table gives no rows.
    """
    own = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    # the row is carried in one column, so that no name of its columns meets one from here
    rows = docs.select(F.struct(F.lit(0).alias("__any"), *(F.col(quoted(c)) for c in own)).alias("row"), F.col("source").alias("source"), F.col("doc_id").alias("doc_id"), tokens(F.col("text")).alias("n_tokens"))
    fine = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(BLOCKS)).cast("int").alias("fine")
    total = materialize(rows.groupBy("source", fine).agg(F.sum("n_tokens").alias("n_tokens")), "fine")
    # the blocks of a source are unions of the fine ones, so the texts are counted once for both
    n_blocks = F.least(F.greatest(F.round(F.sum("n_tokens") / BLOCK_TOKENS), F.lit(1)), F.lit(BLOCKS)).cast("int")
    sources = materialize(total.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), n_blocks.alias("n_blocks")), "sources")
    per = _sized(sources, F.lit(64)).select(F.col("source").alias("__source"), "n_blocks")
    of_source = F.col("source").eqNullSafe(F.col("__source"))
    block = F.pmod(F.col("fine"), F.col("n_blocks")).alias("block")
    blocks = materialize(total.join(per, of_source).groupBy("source", block).agg(F.sum("n_tokens").alias("n_tokens")), "blocks")
    power = exponent(sources, entropy, repeats, budget)
    uses = materialize(schedule(blocks, weights(sources.select("source", "n_tokens"), power, budget), seed), "uses")
    uses = _sized(uses, F.lit(64) + 32 * F.size("uses")).select(F.col("source").alias("__from"), F.col("block").alias("__block"), F.col("uses").alias("__uses"))
    placed = rows.select("*", fine).join(per, of_source).select("row", "source", "n_tokens", block)
    joined = placed.join(uses, F.col("source").eqNullSafe(F.col("__from")) & (F.col("block") == F.col("__block")))
    used = joined.select("row", "n_tokens", "block", F.explode("__uses").alias("use"))
    added = dict(zip(NAMES, names, strict=True))
    return used.select(*(F.col(f"row.{quoted(c)}").alias(c) for c in own), F.col("n_tokens").alias(added["n_tokens"]), F.col("block").alias(added["block"]), F.col("use.epoch").alias(added["epoch"]), F.col("use.mix_at").alias(added["mix_at"]))


def in_order(mixed: DataFrame, mix_at: str = "mix_at") -> DataFrame:
    """Rows in the order of the mixture: partition by partition, and by mix_at within; one shuffle, dealt by the place itself."""
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.col(quoted(mix_at))
    return mixed.repartitionById(n, F.floor(place * n).cast("int")).sortWithinPartitions(place)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of every document in the mixture: doc_id, source, n_tokens, block, epoch, mix_at."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens", "block", "epoch", "mix_at")
