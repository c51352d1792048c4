"""Near-duplicate detection: SimHash fingerprints linked by a binary trie self-join.

Two fingerprints link when they differ in at most ``budget`` bits. Cut into B blocks, they then
agree in B - budget blocks at least, so for each choice of that many blocks the fingerprints that
agree in them form a trie of their own (a shard), and every link lies within some shard. In a
shard the trie is joined with itself: pairs of nodes descend together, bits that differ add to
the pair's error, and a pair beyond the budget is pruned. Pairs of small nodes are compared
outright.

A shard returns a spanning forest of its links and not the links, so a dense group of near
copies costs its size and not the square of it. A shard of more than ``SHARD`` fingerprints is cut
anew along the bits in which it may still differ; as fingerprints are distinct and agreed bits
only grow, this ends, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, columns, fresh, materialize, table, texts_of
from .components import connected

#: Words of a shingle, hash seed, and the most bits that linked fingerprints differ in.
WORDS, SEED, BUDGET = 4, 42, 4
#: Fingerprints that a shard joins in one go; pairs of trie nodes up to this product are compared outright.
SHARD, LEAF = 2048, 64
#: Rows gathered before shards are joined; expected shard size from which more blocks are used.
ROWS, CROWDED = 100_000, 32
#: Shingles hashed at a time, so that a long text needs little memory.
STEP = 1 << 16

_FULL = (1 << 64) - 1


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def of_hashes(hashes: np.ndarray) -> int:
    """SimHash of given hashes (uint64): the bits that over half of them have; 0 of none."""
    return _majority(sum((_ones(hashes[i : i + STEP]) for i in range(0, len(hashes), STEP)), np.zeros(64, np.int64)), len(hashes))


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text, repeats included; 0 if it has no word (or is null)."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    if len(found) < words:
        found = [b" ".join(found)]
        size = np.array([len(found[0])])
        words = 1
    else:
        size = np.fromiter(map(len, found), np.int64, len(found))
    flat = b" ".join(found)
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    begin, end = start[: len(start) - words + 1], (start + size)[words - 1 :]
    hashed, n = np.zeros(64, np.int64), len(begin)
    for i in range(0, n, STEP):
        hashed += _ones(np.array([xxhash.xxh64_intdigest(flat[a:b], seed) for a, b in zip(begin[i : i + STEP].tolist(), end[i : i + STEP].tolist(), strict=True)], np.uint64))
    return _majority(hashed, n)


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long) of every row of docs (doc_id, text); fp is the fingerprint's two's complement."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words, seed) for t in texts_of(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("fp", "long"))


def _cut(mask: int, blocks: int, agreed: int) -> list[int]:
    """Masks that add, to the bits of mask, each choice of ``agreed`` of ``blocks`` blocks of the other bits."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    parts = [sum(1 << b for b in x.tolist()) for x in np.array_split(np.array(free, int), blocks)]
    return [mask | sum(c) for c in combinations(parts, agreed)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_join(group: np.ndarray, fp: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a, b) of rows of one group whose fingerprints differ in at most budget bits.

    group, fp: equally long, sorted by group and then by fp (unsigned); distinct within a group.
    """
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(fp) else np.array([], np.int64)
    lo, hi = cuts, np.append(cuts[1:], len(fp))
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    self_lo, self_hi = lo.astype(np.int64), hi.astype(np.int64)
    pair = np.empty((5, 0), np.int64)  # u's range, v's range, differing bits so far
    found_a, found_b = [], []

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        ok = _popcount(fp[a] ^ fp[b]) <= budget
        found_a.append(a[ok])
        found_b.append(b[ok])

    def outright(p: np.ndarray) -> None:
        ul, uh, vl, vh = p[:4]
        nv, n = vh - vl, (uh - ul) * (vh - vl)
        which = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        compare(ul[which] + k // nv[which], vl[which] + k % nv[which])

    for bit in range(63, -1, -1):
        if not len(self_lo) and not pair.shape[1]:
            break
        small = self_hi - self_lo <= 8
        if small.any():
            sl, sh = self_lo[small], self_hi[small]
            for gap in range(1, 8):
                for at in range(0, 8 - gap):
                    ok = sl + at + gap < sh
                    compare(sl[ok] + at, sl[ok] + at + gap)
            self_lo, self_hi = self_lo[~small], self_hi[~small]
        small = (pair[1] - pair[0]) * (pair[3] - pair[2]) <= LEAF
        if small.any():
            outright(pair[:, small])
            pair = pair[:, ~small]
        ones = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        middle = lambda lo, hi: hi - (ones[hi] - ones[lo])  # noqa: E731  in a node the zeros stand first
        mid = middle(self_lo, self_hi)
        um, vm = middle(pair[0], pair[1]), middle(pair[2], pair[3])
        pair = np.concatenate(
            [
                [self_lo, mid, mid, self_hi, np.ones(len(mid), np.int64)],
                [pair[0], um, pair[2], vm, pair[4]],
                [um, pair[1], vm, pair[3], pair[4]],
                [pair[0], um, vm, pair[3], pair[4] + 1],
                [um, pair[1], pair[2], vm, pair[4] + 1],
            ],
            axis=1,
        )
        pair = pair[:, (pair[4] <= budget) & (pair[0] < pair[1]) & (pair[2] < pair[3])]
        self_lo, self_hi = np.concatenate([self_lo, mid]), np.concatenate([mid, self_hi])
        more = self_hi - self_lo > 1
        self_lo, self_hi = self_lo[more], self_hi[more]
    if pair.shape[1]:
        outright(pair)
    return np.concatenate([*found_a, np.array([], np.int64)]), np.concatenate([*found_b, np.array([], np.int64)])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n nodes the least that it reaches over the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return label


def _join_shards(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """(mask, part, fp) sorted -> (mask, u, v): links u-v of a forest with mask null, or, of shards that are too large, fp as u under finer masks."""

    def out(mask: np.ndarray | None, u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(u), pa.int64())
        signed = lambda x: none if x is None else pa.array(x.view(np.int64))
        return pa.record_batch([signed(mask), signed(u), signed(v)], ["mask", "u", "v"])

    def finer(mask: int, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for m in _cut(mask, budget + 1, 1):
            yield out(np.full(len(fp), m, np.uint64), fp, None)

    def solve(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        change = np.concatenate([[True], (key[1:] != key[:-1]).any(1)])
        group = np.cumsum(change)
        size = np.bincount(group)[1:]
        order = np.lexsort((fp, group))
        fp = fp[order]  # of a group the rows stay in place as a whole
        ends = np.cumsum(size)
        start = 0
        while start < len(size):  # as many shards at once as have a bounded number of pairs
            work = np.cumsum(size[start:].astype(float) ** 2)
            stop = start + max(1, int(np.searchsorted(work, SHARD**2, "right")))
            lo, hi = (ends[start - 1] if start else 0), ends[stop - 1]
            if hi - lo > stop - start:
                a, b = trie_join(group[lo:hi], fp[lo:hi], budget)
                root = forest(hi - lo, a, b)
                own = np.flatnonzero(root != np.arange(hi - lo))
                if len(own):
                    yield out(None, fp[lo:hi][own], fp[lo:hi][root[own]])
            start = stop

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows, hot = 0, None
    for batch in batches:
        mask, part, fp = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
        key = np.stack([mask, part], 1)
        if hot is not None:  # the shard that was found too large goes on
            n = int((key == hot).all(1).sum())
            yield from finer(int(hot[0]), fp[:n]) if n else ()
            key, fp = key[n:], fp[n:]
            if not len(fp):
                continue
            hot = None
        held.append((key, fp))
        rows += len(fp)
        if rows < ROWS:
            continue
        key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        yield from _whole(key, fp, solve, finer)
        last = (key == key[-1]).all(1)
        first = int(np.flatnonzero(last)[0])
        key, fp = key[first:], fp[first:]
        held, rows = [(key, fp)], len(fp)
        if rows > SHARD:
            yield from finer(int(key[0, 0]), fp)
            held, rows, hot = [], 0, key[0]
    if held:
        key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        end = np.full((1, 2), _FULL, np.uint64)
        if (key[-1] == end).all():  # such a key has one fingerprint
            key, fp = key[:-1], fp[:-1]
        yield from _whole(np.concatenate([key, end]), np.concatenate([fp, fp[:1]]), solve, finer) if len(fp) else ()


def _whole(key: np.ndarray, fp: np.ndarray, solve, finer) -> Iterator[pa.RecordBatch]:
    """Deal with all shards but the last, which may go on."""
    n = int(np.flatnonzero((key == key[-1]).all(1))[0])
    key, fp = key[:n], fp[:n]
    if not n:
        return
    change = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
    size = np.diff(np.append(change, n))
    for i in np.flatnonzero(size > SHARD):
        yield from finer(int(key[change[i], 0]), fp[change[i] : change[i] + size[i]])
    keep = np.repeat((size <= SHARD) & (size > 1), size)
    if keep.any():
        yield from solve(key[keep], fp[keep])


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp) distinct -> (u, v): a forest whose trees are exactly the groups that the links join.

    The number of blocks follows the number of fingerprints, so that shards stay small.
    """
    n = max(1, distinct.count())
    blocks = next(b for b in range(budget + 1, 33) if n / 2 ** (64 * (b - budget) / b) <= CROWDED or comb(b + 1, budget) > 500)
    masks = [_signed(m) for m in _cut(0, blocks, blocks - budget)]
    todo = distinct.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    found = None
    while True:
        rows = todo.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")
        dealt = rows.repartition("mask", "part").sortWithinPartitions("mask", "part")
        got = materialize(dealt.mapInArrow(lambda x: _join_shards(x, budget), "mask long, u long, v long"), "links")
        own = got.where("mask IS NULL").select("u", "v")
        found = own if found is None else found.union(own)
        todo = got.where("mask IS NOT NULL").select(F.col("u").alias("fp"), "mask").distinct()
        if got.where("mask IS NOT NULL").isEmpty():
            return found


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text).

    component_id is the least doc_id that links reach, the row's own included. A null text is
    empty; texts without words share fingerprint zero and are linked like any other. Rows with a
    null doc_id get a component but lend it no id; it is null if no row of it has one. Repeated
    rows come out repeated. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    fps = materialize(fingerprints(docs, words, seed), "fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected(links(distinct.select("fp"), budget))
    by_fp = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = by_fp.join(by_fp.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one_of_each(docs: DataFrame, mark: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """The rows of docs, less all but one row of each component that mark gives (doc_id, text) rows.

    The row with the component's least doc_id stays; of several rows with that id, the one whose
    id and text hash lowest, and of equal rows one. A row without an id comes after all that have one.
    """
    row = F.xxhash64("doc_id", "text")
    named = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", row.alias("row"))  # an id of its own for each text of a doc_id
    marked = mark(docs.select(named.alias("doc_id"), "text"))
    own, copy = fresh(docs, "__row"), fresh(docs, "__copy")
    leaders = marked.where("doc_id = component_id").select(F.col("component_id.row").alias(own)).distinct()
    # join and window deal rows by the same key, so texts are shuffled once
    kept = docs.withColumn(own, row).join(leaders, own, "left_semi")
    return kept.withColumn(copy, F.row_number().over(Window.partitionBy(own).orderBy(own))).where(F.col(copy) == 1).select(*columns(docs))
