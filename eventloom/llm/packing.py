"""Best-fit packing of token sequences by a configuration linear program.

Pieces of at most ``capacity`` tokens go into as few sequences as possible. What matters of them is
the histogram of their lengths, which has at most ``capacity`` entries however many pieces there
are. A configuration is a multiset of lengths that fits a sequence; the linear program covers the
histogram with the least total of configurations. It is solved by multiplicative weights: every
length has a price, a knapsack dynamic program finds the dearest configurations, and the lengths
that they cover become cheaper. Rounding uses each configuration as often as whole counts allow;
the program is solved anew over what is left, until that is a few percent of the tokens, which
configurations around the largest remaining length that leave the least slack pack. The gap to the
dual bound comes with the plan.

Only the histogram reaches the driver. Pieces of a length are numbered within hash buckets, so no
length is gathered in one task, and the number looks up the place that the plan gives it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, extended, materialize, table, texts_of
from .tokens import tokenizer

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 4096, 1
#: Rounds of multiplicative weights, doubled up to so many while the duality gap is above GAP; how fast prices fall.
ROUNDS, MOST_ROUNDS, GAP, RATE = 4, 32, 0.01, 0.3
#: Difference of prices that counts as none, less than that of one token; share of tokens that is left to the remainder.
TIE, REST = 1e-4, 0.03
#: Pieces of a length in a bucket, about, as long as that takes no more than so many buckets.
BUCKET, BUCKETS = 1000, 4096
#: Texts tokenized at a time.
STEP = 64


@dataclass
class Plan:
    """configurations: (copies, {length: times}); lengths of a configuration are laid out in the order of the dict.

    rounded: sequences that come from configurations of the linear program; the others pack what
    rounding left. bound: sequences that any packing needs at least, by the program's dual. gap: by
    how much the first fractional solution is above it, as a share.
    """

    configurations: list[tuple[int, dict[int, int]]]
    rounded: int = 0
    bound: float = 0.0
    gap: float = 0.0

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.configurations)


def _knapsack(price: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """For each room up to the capacity, the price of the dearest multiset of lengths that fits it; each length at most ``most`` times."""
    best = np.zeros(capacity + 1)
    for length, p, n in zip(lengths.tolist(), price.tolist(), most.tolist(), strict=True):
        n, k = min(n, capacity // length), 1
        while n > 0:  # counts in powers of two
            k = min(k, n)
            size = k * length
            np.maximum(best[size:], best[: capacity + 1 - size] + k * p, out=best[size:])
            n, k = n - k, 2 * k
    return best


class _Covering:
    """The covering program of a histogram, and its solution by multiplicative weights.

    A length is to be covered ``count`` times, and a configuration has it at most that often. Prices
    start in proportion to length, which is dual feasible. In a round each length is to be covered
    by a further share of its count: the knapsack program prices every room, and from the longest
    length on that lacks cover, the dearest configuration around it is walked through the program,
    among equally dear ones by what lacks most. It is used until one of its lengths has its share
    and that of the next round. Prices fall with the cover that a length has ahead of its share.
    """

    def __init__(self, left: dict[int, int], capacity: int, seed: int) -> None:
        self.lengths = np.array(sorted(left))
        self.count = np.array([left[x] for x in self.lengths.tolist()], float)
        self.capacity = capacity
        self.most = np.minimum(self.count, capacity // self.lengths).astype(np.int64)
        self.random = np.random.default_rng(seed)

    def _walk(self, first: int, price: np.ndarray, best: np.ndarray, weight: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and times of lengths in the dearest configuration around one length; weight chooses among equals."""
        lengths = self.lengths
        taken = {first: 1}
        room = self.capacity - int(lengths[first])
        while room >= lengths[0]:
            n = int(np.searchsorted(lengths, room, "right"))
            worth = best[room - lengths[:n]] + price[:n]
            worth[most[:n] == 0] = -1.0
            for i, k in taken.items():
                if i < n and k >= most[i]:
                    worth[i] = -1.0
            top = worth.max()
            if top <= 0:
                break
            near = np.flatnonzero(worth >= top - TIE)
            so_far = np.cumsum(weight[near])
            i = int(near[min(np.searchsorted(so_far, self.random.random() * so_far[-1], "right"), len(near) - 1)])
            k = max(1, min(int(most[i]) - taken.get(i, 0), room // int(lengths[i]) // 8))  # short lengths that repeat, several at a time
            taken[i] = taken.get(i, 0) + k
            room -= k * int(lengths[i])
        return np.fromiter(taken, np.int64, len(taken)), np.fromiter(taken.values(), np.int64, len(taken))

    def solve(self, rounds: int, rate: float) -> tuple[list[tuple[float, dict[int, int]]], float, float]:
        """(how often, configuration), most often first; their total; and the best dual bound."""
        count, capacity = self.count, self.capacity
        flat, least = self.lengths / capacity, 1e-9 * self.count
        covered, used, bound = np.zeros(len(count)), {}, 0.0
        for t in range(1, rounds + 1):
            price = flat * np.exp(-rate * np.maximum(rounds * covered / count - (t - 1), 0.0))
            best = _knapsack(price, self.lengths, self.most, capacity)
            bound = max(bound, float(count @ price) / float(best[capacity]))
            lack = np.maximum(count * (t / rounds) - covered, 0.0)
            free = np.maximum(count * (min(t + 1, rounds) / rounds) - covered, 0.0)  # what may be covered in this round
            lack[lack < least], free[free < least] = 0.0, 0.0
            most = np.where(free > 0, self.most, 0)
            weight = (lack + 1e-3 * free) * self.lengths.astype(float) ** 2
            for first in range(len(count) - 1, -1, -1):
                while lack[first] > 0:
                    at, times = self._walk(first, price, best, weight, most)
                    step = float((free[at] / times).min())
                    if lack[first] < step:  # the others may go ahead, the first need not
                        step = max(float(lack[first]), float((lack[at] / times).min()))
                    key = tuple(zip(self.lengths[at].tolist(), times.tolist(), strict=True))
                    used[key] = used.get(key, 0.0) + step
                    covered[at] += step * times
                    for x in (lack, free):
                        x[at] = np.maximum(x[at] - step * times, 0.0)
                        x[at[x[at] < least[at]]] = 0.0
                    most[at[free[at] == 0]] = 0
                    weight[at] = (lack[at] + 1e-3 * free[at]) * self.lengths[at].astype(float) ** 2
        found = sorted(((x, dict(key)) for key, x in used.items()), key=lambda e: -e[0])
        return found, sum(used.values()), bound


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit decreasing on a histogram; equal bins are filled together, which gives the same bins."""
    out: list[tuple[int, dict[int, int]]] = []
    lengths = sorted(left)
    left = dict(left)
    while lengths:
        room, take = capacity, {}
        while room and (i := bisect_right(lengths, room)):
            length = next((x for x in reversed(lengths[:i]) if left[x] > take.get(x, 0)), None)
            if length is None:
                break
            n = min(room // length, left[length] - take.get(length, 0))
            take[length] = take.get(length, 0) + n
            room -= n * length
        copies = min(left[x] // n for x, n in take.items())
        out.append((copies, take))
        for x, n in take.items():
            left[x] -= copies * n
        lengths = [x for x in lengths if left[x]]
    return out


def _tightest(left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Configurations around the largest remaining length that leave the least slack, until nothing is left."""
    out: list[tuple[int, dict[int, int]]] = []
    left = {x: n for x, n in left.items() if n}
    while left:
        top = max(left)
        room, take = capacity - top, {top: 1}
        # bounded subset sum over bit sets: reach[i] has the sums that the i largest lengths make
        lengths = [x for x in sorted(left, reverse=True) if x <= room]
        reach, full = [1], (1 << (room + 1)) - 1
        for x in lengths:
            n, k, bits = min(left[x] - (x == top), room // x), 1, reach[-1]
            while n > 0:  # counts in powers of two
                k = min(k, n)
                bits |= bits << (k * x) & full
                n, k = n - k, 2 * k
            reach.append(bits)
            if bits >> room & 1:
                break
        at = reach[-1].bit_length() - 1
        for i in range(len(reach) - 1, 0, -1):
            x, n = lengths[i - 1], 0
            while not reach[i - 1] >> (at - n * x) & 1:
                n += 1
            if n:
                take[x] = take.get(x, 0) + n
                at -= n * x
        copies = min(left[x] // n for x, n in take.items())
        out.append((copies, take))
        for x, n in take.items():
            left[x] -= copies * n
            if not left[x]:
                del left[x]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = RATE) -> Plan:
    """A plan that packs exactly the pieces of a histogram (length -> count, lengths 1 to capacity).

    The covering program is solved and rounded, and again over what rounding leaves, as long as
    that is more than ``REST`` of all tokens. A configuration is rounded down, but not below one, as
    far as its lengths last, if no other around its longest length is fuller. The remainder is packed
    by the fullest configurations around its longest pieces.
    """
    left = {int(x): int(n) for x, n in histogram.items() if n}
    if not left:
        return Plan([])
    tokens = lambda: sum(x * n for x, n in left.items())
    made, every, phase = Plan([]), tokens(), 0
    while left and tokens() > max(REST * every, 2 * capacity):
        program = _Covering(left, capacity, phase)
        if phase == 0:
            found, total, made.bound = program.solve(rounds, rate)
            while total > (1 + GAP) * made.bound and rounds < MOST_ROUNDS:
                rounds *= 2
                found, total, made.bound = program.solve(rounds, rate)
            made.gap = total / made.bound - 1
        else:
            found, _, _ = program.solve(1, rate)
        fullest = _knapsack(program.lengths.astype(float), program.lengths, program.most, capacity)
        phase, before = phase + 1, made.rounded
        for slack in (False, True)[: 2 if phase == 1 else 1]:  # with more slack only where the first solution has no others, and then rounded down
            for x, take in found:
                top = max(take)
                if not slack and sum(length * n for length, n in take.items()) < top + fullest[capacity - top]:
                    continue
                copies = min([int(x) if slack else max(1, int(x)), *(left.get(length, 0) // n for length, n in take.items())])
                if copies > 0:
                    made.configurations.append((copies, take))
                    made.rounded += copies
                    for length, n in take.items():
                        left[length] -= copies * n
                        if not left[length]:
                            del left[length]
            if made.rounded > before:
                break
    made.configurations += _tightest(left, capacity)
    return made


class Places:
    """Looks up, for the r-th piece of a length, its sequence and its offset there."""

    def __init__(self, made: Plan) -> None:
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        self.runs, base, so_far = {}, 0, {}
        for copies, take in made.configurations:
            at = 0
            for length, times in take.items():
                for k in range(times):
                    runs.setdefault(length, []).append((so_far.get(length, 0), base, at + k * length, copies))
                    so_far[length] = so_far.get(length, 0) + copies
                at += times * length
            base += copies
        self.runs = {x: np.array(r, np.int64) for x, r in runs.items()}

    def look_up(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
            first, base, at, _ = self.runs[int(length[mine[0]])].T
            run = np.searchsorted(first, rank[mine], "right") - 1
            sequence[mine], offset[mine] = base[run] + rank[mine] - first[run], at[run]
        return sequence, offset


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of the token ids of every row of docs (doc_id, text).

    A document is its ids and the end id; longer ones are cut every ``capacity`` ids. A null text is
    empty, and an empty text is its end id alone. Repeated rows give repeated pieces.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    schema = rows.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    schema = schema.add("ids", "array<int>") if with_ids else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        for batch in batches:
            for i in range(0, len(batch), STEP):
                part = batch.slice(i, STEP)
                owner, piece, start, length, crc, kept = [], [], [], [], [], []
                for k, ids in enumerate(words.ids(texts_of(part, "text"))):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for j in range(0, len(ids), capacity):
                        cut = ids[j : j + capacity]
                        owner.append(k)
                        piece.append(j // capacity)
                        start.append(j)
                        length.append(len(cut))
                        crc.append(crc32(cut))
                        kept.append(cut.astype(np.int32) if with_ids else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else [])],
                    schema.names,
                )

    return rows.mapInArrow(run, schema)


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (doc_id, piece, length and more) with sequence_id and offset appended; cut must be a written table."""
    count = cut.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = {r["length"]: r["count"] for r in count}
    buckets = max(1, min(BUCKETS, max(histogram.values(), default=0) // BUCKET))
    places = cut.sparkSession.sparkContext.broadcast(Places(plan(histogram, capacity)))
    rows = cut.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    # the buckets of a length follow one another; their sizes are summed over a small table
    before = rows.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = before.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("__n")
    key = ["length", "__bucket"]
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece")).cast("long") - 1)
    ranked = ranked.join(before, key).withColumn("__rank", F.col("__rank") + F.coalesce("__before", F.lit(0))).select(*cut.columns, "__rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.look_up(batch.column("length").to_numpy(), batch.column("__rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, extended(cut.schema, sequence_id="long", offset="long"))


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text).

    Sequences are numbered from 0; the pieces of one fill it from offset 0 without gaps. An empty
    table gives no pieces. Columns of docs other than doc_id and text are not looked at.
    """
    return assign(materialize(pieces(docs, capacity, end, path), "pieces"), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
