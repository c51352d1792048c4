"""Exact top-k search by inner product with ball trees.

The vectors are dealt into cells around pivots, each cell into shards; a shard builds a ball tree over its
own and answers queries by branch and bound. A ball of centre c and radius r holds no vector with an
inner product above q.c + |q| r, so nodes are taken in the order of that bound, and a node whose bound
is below the query's current k-th score is cut off with all that is below it.

The k-th scores are shared: a first round has every query search one shard of its own cell, and the
k-th score that it finds there is the bound for all others. A cell is a ball too, so pairs of a query
and a cell that the bound rules out are dropped before anything is sent. The other queries stream past
the shards of the cells that may hold better: a task holds one shard and one batch of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, hashed_sample, materialize, table

#: Neighbours, factor of the components, and which rows are queries.
K, SCALE, EVERY = 5, 256, 50
#: Vectors of a shard, queries of a block, and vectors of a leaf, about.
SHARD, BLOCK, LEAF = 32_768, 1 << 18, 128
#: Vectors of a shard where there would be fewer shards than cores.
SMALLEST = 4096
#: Pivots, at most; what workers are sent of the cells is bounded by them.
PIVOTS = 4096
#: Sums up to this are exact in float64; larger ones are made of 64-bit whole numbers.
EXACT = 2**53
#: In place of a score where there is none. Scores beyond a long are held at its ends.
NONE = np.iinfo(np.int64).min


def quantized(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<long>): floor(256 x) of each component as double.

    Rows whose vector is null or holds a null or a component that is not finite are left out, as are
    rows without an id. An empty vector takes part; only vectors of equal length meet.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select("vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite)
    return rows.select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v"))


class BallTree:
    """Balls over rows of a matrix: each node splits along the line between two far-apart rows, at the median."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(rows))
        lo, hi, left, right, centre, radius = [], [], [], [], [], []
        todo = [(0, len(rows), -1, False)]
        while todo:
            a, b, parent, is_right = todo.pop()
            me = len(lo)
            if parent >= 0:
                (right if is_right else left)[parent] = me
            mine = rows[self.order[a:b]]
            c = mine.mean(0)
            far = ((mine - c) ** 2).sum(1)
            lo.append(a), hi.append(b), left.append(-1), right.append(-1), centre.append(c), radius.append(np.sqrt(far.max()))
            if b - a > leaf and far.max() > 0:
                p = mine[far.argmax()]
                q = mine[((mine - p) ** 2).sum(1).argmax()]
                along = np.argsort(mine @ (q - p), kind="stable")
                self.order[a:b] = self.order[a:b][along]
                m = (a + b) // 2
                todo += [(m, b, me, True), (a, m, me, False)]
        self.lo, self.hi, self.left, self.right = map(np.array, (lo, hi, left, right))
        self.centre, self.radius = np.array(centre), np.array(radius)


def _bound(queries: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products with what balls hold; bounds may round, so they are widened."""
    with np.errstate(invalid="ignore"):
        upper = queries @ centre.T + np.sqrt((queries**2).sum(1))[:, None] * radius
    return upper + 1e-9 * np.abs(upper) + 1e-6


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; those beyond a long at its ends."""
    size = [float(np.abs(x.astype(float)).max(initial=0)) for x in (queries, rows)]
    about = queries.astype(float) @ rows.astype(float).T
    if size[0] * size[1] * max(rows.shape[1], 1) < EXACT:
        return about.astype(np.int64)
    exact = queries @ rows.T  # modulo 2**64, which is right wherever the score is a long
    return np.where(about >= 2.0**63, 2**63 - 1, np.where(about <= -(2.0**63), NONE + 1, exact))


def search(tree: BallTree, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of each query's best rows other than itself, at most k; rows below its bound are left out.

    rows, queries: whole numbers. bound: a k-th score known from elsewhere, or NONE. Ties go to smaller
    ids. The node with the greatest bound over the queries that may still find better there comes next;
    those for which its bound is too low drop out, and where all do, nothing below it is looked at.
    """
    n = len(queries)
    best = np.full((n, k), NONE)
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    floor = bound.astype(np.int64)  # a row below it is not among the k best
    near = queries.astype(float)
    todo = [(0.0, 0, np.arange(n), np.full(n, np.inf))]
    while todo:
        _, node, live, upper = heappop(todo)
        go = (upper >= floor[live]) | (floor[live] == NONE)
        live, upper = live[go], upper[go]
        if not len(live):
            continue
        if tree.left[node] >= 0:
            for child in (int(tree.left[node]), int(tree.right[node])):
                # a node's bound holds for what is below it too
                below = np.minimum(upper, _bound(near[live], tree.centre[child : child + 1], tree.radius[child : child + 1])[:, 0])
                go = (below >= floor[live]) | (floor[live] == NONE)
                if go.any():
                    heappush(todo, (-float(below[go].max()), child, live[go], below[go]))
            continue
        mine = tree.order[tree.lo[node] : tree.hi[node]]
        for part in np.array_split(live, -(-len(live) // 4096)):
            score = products(queries[part], rows[mine])
            score[query_ids[part][:, None] == ids[mine][None, :]] = NONE
            all_scores = np.concatenate([best[part], score], 1)
            all_ids = np.concatenate([best_id[part], np.broadcast_to(ids[mine], score.shape)], 1)
            pick = _first(all_scores, all_ids, k)
            best[part], best_id[part] = np.take_along_axis(all_scores, pick, 1), np.take_along_axis(all_ids, pick, 1)
            floor[part] = np.maximum(floor[part], best[part, -1])
    found = (best > NONE) & (best >= floor[:, None])
    return np.nonzero(found)[0], best_id[found], best[found]


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores of each row, ties to smaller ids."""
    cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    out = np.empty((len(scores), k), np.int64)
    for i, (s, x, c) in enumerate(zip(scores, ids, cut, strict=True)):
        maybe = np.flatnonzero(s >= c)
        out[i] = maybe[np.lexsort((x[maybe], ~s[maybe]))[:k]]  # ~s falls as s rises, and has no overflow
    return out


def _by_length(ids: np.ndarray, v: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (ids, matrix, places in v) of vectors."""
    offsets = v.offsets.to_numpy()
    size, start = np.diff(offsets), offsets[:-1] - offsets[0]
    flat = v.flatten().to_numpy()
    out = {}
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        out[int(n)] = ids[rows], flat[(start[rows][:, None] + np.arange(n)).ravel()].reshape(len(rows), n), rows
    return out


class Shard:
    """Candidates of one shard, a tree for each length of vectors."""

    def __init__(self, parts: list[tuple[np.ndarray, pa.Array]]) -> None:
        self.held = _by_length(np.concatenate([i for i, _ in parts]), pa.concat_arrays([v for _, v in parts])) if parts else {}
        self.trees: dict[int, BallTree] = {}

    def answer(self, ids: np.ndarray, v: pa.Array, bound: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query ids, ids, scores) of the best candidates for each query; bound is NONE where none is known."""
        out = []
        for n, (query_ids, queries, place) in _by_length(ids, v).items():
            if n not in self.held:
                continue
            own, rows, _ = self.held[n]
            if n not in self.trees:
                self.trees[n] = BallTree(rows.astype(float))
            q, i, s = search(self.trees[n], rows, own, queries, query_ids, bound[place], k)
            out.append((query_ids[q], i, s))
        return out


def _stream(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(shard, block, asks, vec_id, v, bound) in order: the candidates of a key come first, then its queries."""
    key, parts, shard = None, [], None
    for batch in batches:
        group = np.stack([batch.column(i).to_numpy() for i in range(2)] + [batch.column(2).to_numpy(zero_copy_only=False).astype(int)], 1)
        starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(1)]))
        for a, b in zip(starts, [*starts[1:], len(group)], strict=True):
            if key != tuple(group[a, :2]):
                key, parts, shard = tuple(group[a, :2]), [], None
            rows = batch.slice(a, b - a)
            ids, v = rows.column(3).to_numpy(), rows.column(4)
            if not group[a, 2]:
                parts.append((ids, v))
                continue
            if shard is None:
                shard, parts = Shard(parts), []
            found = shard.answer(ids, v, rows.column(5).fill_null(int(NONE)).to_numpy(), k)
            if found:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query_id", "vec_id", "score"])


class Cells:
    """Pivots by length of vectors: each vector belongs to the cell of the nearest pivot of its length; -1 is the cell of lengths without one."""

    def __init__(self, pivots: list[list[int]]) -> None:
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(p) for p in pivots}:
            at = [i for i, p in enumerate(pivots) if len(p) == n]
            self.of[n] = np.array(at), np.array([pivots[i] for i in at], float).reshape(len(at), n)

    def nearest(self, v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot."""
        cell, far = np.full(len(v), -1, np.int32), np.zeros(len(v))
        for n, (_, rows, place) in _by_length(np.arange(len(v)), v).items():
            if n not in self.of:
                continue
            at, pivot = self.of[n]
            for part in np.array_split(np.arange(len(rows)), -(-len(rows) // 1024)):
                x = rows[part].astype(float)
                d = (x**2).sum(1)[:, None] - 2 * x @ pivot.T + (pivot**2).sum(1)
                near = d.argmin(1)
                cell[place[part]] = at[near]
                far[place[part]] = np.sqrt(((x - pivot[near]) ** 2).sum(1))
        return cell, far

    def reach(self, v: pa.Array, bound: np.ndarray, radius: dict[int, float]) -> list[np.ndarray]:
        """Of each query the cells that may hold a score of its bound or more."""
        out: list[np.ndarray] = [np.array([-1])] * len(v)
        for n, (_, queries, place) in _by_length(np.arange(len(v)), v).items():
            if n not in self.of:
                continue
            at, pivot = self.of[n]
            r = np.array([radius.get(int(i), -np.inf) for i in at])  # a cell without vectors has no radius
            for part in np.array_split(np.arange(len(queries)), -(-len(queries) // 1024)):
                may = (_bound(queries[part].astype(float), pivot, r) >= bound[place[part], None]) | (bound[place[part], None] == NONE)
                for i, row in zip(place[part].tolist(), may & (r > -np.inf), strict=True):
                    out[i] = at[row]
        return out


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates by inner product, itself left out.

    candidates, queries: (vec_id, v array<long>) as ``quantized`` gives them, as written tables. All
    candidates are searched; ties go to smaller vec_ids. A query with fewer than k candidates of its
    length gets all of them; one without any gets no row. Rows repeated among the candidates count
    each; a repeated query is answered once. A score beyond a long is held at its end.
    """
    spark = candidates.sparkSession
    bound_batches(spark)
    n, asked = candidates.count(), queries.count()
    cores = spark.sparkContext.defaultParallelism
    shards, blocks = max(1, -(-n // shard), min(cores, n // SMALLEST)), max(1, -(-asked // block))
    few = hashed_sample(candidates, "vec_id", min(shards, PIVOTS))
    pivots = candidates.join(F.broadcast(few), "vec_id", "left_semi").dropDuplicates(["vec_id"]).orderBy("vec_id").select("v").limit(PIVOTS).collect()
    cells = spark.sparkContext.broadcast(Cells([r["v"] for r in pivots]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far = cells.value.nearest(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), pa.array(far)], ["vec_id", "v", "cell", "far"])

    kinds = "vec_id long, v array<long>, cell int, far double"
    held = materialize(candidates.select("vec_id", "v").mapInArrow(deal, kinds), "cells")
    most = -(-n // shards)
    size = {r["cell"]: (r["n"], r["far"]) for r in held.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    first, parts, so_far = {}, {}, 0  # a cell's first shard, and how many it has
    for cell in sorted(size):
        first[cell], parts[cell] = so_far, -(-size[cell][0] // most)
        so_far += parts[cell]
    told = spark.createDataFrame([(c, first[c], parts[c]) for c in size], "cell int, first int, parts int")
    in_shard = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("shard")
    dealt = held.join(F.broadcast(told), "cell").select("vec_id", "v", in_shard)
    queries = queries.dropDuplicates(["vec_id"]).select("vec_id", "v").mapInArrow(deal, kinds)
    # a query whose cell holds no candidate starts without a bound
    home = materialize(queries.join(F.broadcast(told), "cell", "left").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"), in_shard.alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")), "queries")

    def round_of(at: DataFrame) -> DataFrame:
        """at: queries with a shard and a bound."""
        sent = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False), "vec_id", "v", F.lit(None).cast("long"))
        both = sent.union(at.select("shard", "block", F.lit(True), "query_id", "query", "bound")).toDF("shard", "block", "asks", "vec_id", "v", "bound")
        dealt_out = both.repartition("shard", "block").sortWithinPartitions("shard", "block", "asks")
        return dealt_out.mapInArrow(lambda x: _stream(x, k), "query_id long, vec_id long, score long")

    found = materialize(round_of(home.where("shard IS NOT NULL").withColumn("bound", F.lit(None).cast("long"))), "first")
    if so_far > 1:
        bound = found.groupBy("query_id").agg(F.min("score").alias("bound"), F.count("*").alias("__n")).select("query_id", F.when(F.col("__n") >= k, F.col("bound")).alias("bound"))
        radius, shards_of = {c: far for c, (_, far) in size.items()}, {c: np.arange(first[c], first[c] + parts[c]) for c in size}

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                to = cells.value.reach(b.column(1), b.column(4).fill_null(int(NONE)).to_numpy(), radius)
                to = [np.concatenate([np.array([], np.int64), *(shards_of[c] for c in x.tolist() if c in shards_of)]) for x in to]
                which = np.repeat(np.arange(len(to)), [len(x) for x in to])
                away = pa.array(np.concatenate([np.array([], np.int64), *to]).astype(np.int32))
                for i in range(0, len(which), 4096):
                    rows = b.take(pa.array(which[i : i + 4096]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, away.slice(i, 4096)], [*b.schema.names, "away"])

        kinds = "query_id long, query array<long>, shard int, block int, bound long"
        away = home.join(bound, "query_id", "left").select("query_id", "query", "shard", "block", "bound").mapInArrow(reach, f"{kinds}, away int")
        away = away.where("shard IS NULL OR away <> shard").select("query_id", "query", F.col("away").alias("shard"), "block", "bound")
        found = found.union(round_of(away))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def chosen(vec_id: Column, every: int = EVERY) -> Column:
    return vec_id % every == 0


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best vectors for every query, those whose id is divisible by 50."""
    rows = materialize(quantized(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(rows, rows.where(chosen(F.col("vec_id"))))


ORACLE = """
WITH x AS (
    SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM x q JOIN x c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
