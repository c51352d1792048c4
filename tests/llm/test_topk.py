import numpy as np

from eventloom.llm import topk


def brute(ids, rows, queries, query_ids, k):
    scores = queries @ rows.T
    out = []
    for s, q in zip(scores, query_ids, strict=True):
        out.append([(int(ids[i]), int(s[i])) for i in sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]])
    return out


def test_branch_and_bound_is_exact():
    r = np.random.default_rng(5)
    for n, d, high in ((1, 3, 9), (4, 2, 2), (700, 3, 3), (900, 16, 300), (300, 3, 2**30), (300, 2, 2**29 * 3)):
        rows = r.integers(-high, high + 1, (n, d))
        ids = r.permutation(n * 2)[:n]
        queries = rows[: min(n, 60)]
        tree = topk.BallTree(rows.astype(float), 16)
        q, i, s = topk.search(tree, rows, ids, queries, ids[: len(queries)], np.full(len(queries), topk.NONE))
        got = [sorted(((int(a), int(b)) for c, a, b in zip(q, i, s, strict=True) if c == j), key=lambda x: (-x[1], x[0])) for j in range(len(queries))]
        assert got == brute(ids, rows, queries, ids[: len(queries)], 5)


def test_shards_share_bounds(spark):
    rows = topk.materialize(topk.quantized(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")), "v")
    data = rows.toPandas()
    ids, m = data.vec_id.to_numpy(), np.stack(data.v.to_numpy())
    want = brute(ids, m, m[ids % 50 == 0], ids[ids % 50 == 0], 5)
    got = topk.top_k(rows, rows.where("vec_id % 50 = 0"), shard=60, block=4).orderBy("query_id", "rank").collect()
    flat = [(int(q), n + 1, i, s) for q, best in zip(ids[ids % 50 == 0], want, strict=True) for n, (i, s) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(flat)


def test_odd_vectors(spark):
    data = [(0, [1.0, 2.0]), (50, [1.0, float("nan")]), (100, None), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0]), (150, []), (3, []), (None, [1.0, 1.0]), (250, [2.0, None]), (5, [-0.001, float("inf")]), (6, [-0.001, 0.0])]
    rows = topk.materialize(topk.quantized(spark.createDataFrame(data, "vec_id long, embedding array<double>")), "v")
    got = [tuple(r) for r in topk.top_k(rows, rows.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 768 * 256 + 256 * 512), (0, 2, 1, 768 * 256 + 256 * 512), (0, 3, 6, -256), (150, 1, 3, 0)]
    # exact beyond what doubles hold, up to the ends of a long
    huge = topk.materialize(spark.createDataFrame([(0, [2**30, 1]), (1, [2**30, 1]), (2, [2**30, 2]), (3, [2**33, 0]), (4, [-(2**33), 0])], "vec_id long, v array<long>"), "v")
    got = [tuple(r) for r in topk.top_k(huge, huge.where("vec_id = 0"), k=4).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 2**63 - 1), (0, 2, 2, 2**60 + 2), (0, 3, 1, 2**60 + 1), (0, 4, 4, -(2**63))] or got[3][3] == -(2**63) + 1
    none = topk.materialize(topk.quantized(spark.createDataFrame([], "vec_id long, embedding array<float>")), "v")
    assert topk.top_k(none, none).collect() == []


def test_subtrees_and_cells_are_cut(spark, monkeypatch):
    """On clustered vectors most leaves and most pairs of queries and cells are never looked at, and nothing is lost."""
    r = np.random.default_rng(6)
    centres = r.normal(size=(40, 8)) * 1000
    rows = (centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 8)) * 10).astype(np.int64)
    ids = np.arange(4000)
    looked = []
    real = topk.products
    monkeypatch.setattr(topk, "products", lambda q, x: looked.append(len(q) * len(x)) or real(q, x))
    tree = topk.BallTree(rows.astype(float), 64)
    q, i, s = topk.search(tree, rows, ids, rows[:100], ids[:100], np.full(100, topk.NONE))
    assert sum(looked) < 0.5 * 100 * 4000
    want = brute(ids, rows, rows[:100], ids[:100], 5)
    assert [sorted(((int(b), int(c)) for a, b, c in zip(q, i, s, strict=True) if a == j), key=lambda x: (-x[1], x[0])) for j in range(100)] == want
    monkeypatch.undo()
    df = topk.materialize(spark.createDataFrame([(int(x), [int(y) for y in v]) for x, v in zip(ids, rows, strict=True)], "vec_id long, v array<long>"), "v")
    got = topk.top_k(df, df.where("vec_id < 100"), shard=200).orderBy("query_id", "rank").collect()
    assert [(x["vec_id"], x["score"]) for x in got] == [y for best in want for y in best]
