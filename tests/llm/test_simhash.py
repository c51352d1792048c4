import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from eventloom.llm import simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def closure(fps):
    """fp -> least fp reachable over links."""
    x = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(1)
        if (new == label).all():
            return {int(a): int(x[b]) for a, b in zip(x, label, strict=True)}
        label = new


def planted(seed, groups, most, flips):
    r = random.Random(seed)
    out = set()
    for _ in range(groups):
        base = r.getrandbits(64)
        out.add(base)
        for _ in range(r.randrange(most)):
            x = base
            for _ in range(r.randint(1, flips)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    return out


def test_fingerprints(texts, monkeypatch):
    for t in [*texts.values(), None, "", " \n", "One two", "A b c D", "é È x y Z", "\x85 \x1c a"]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)
    long = " ".join(str(i) for i in range(5000))
    want = simhash.fingerprint(long)
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.fingerprint(long) == want


def test_trie_join_finds_all_pairs():
    for seed, args in enumerate([(200, 12, 5), (3, 400, 3), (1, 1500, 6), (800, 1, 1)]):
        fp = np.array(sorted(planted(seed, *args)), np.uint64)
        group = np.sort(np.random.default_rng(seed).integers(0, 2, len(fp)))
        order = np.lexsort((fp, group))
        fp = fp[order]
        a, b = simhash.trie_join(group, fp)
        x = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4) & (group[:, None] == group[None, :])
        want = set(zip(*(i.tolist() for i in np.nonzero(np.triu(x, 1))), strict=True))
        assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == want and len(a) == len(want)


def roots(rows, fps):
    label = {f: f for f in fps}
    def find(f):
        while label[f] != f:
            f = label[f]
        return f
    for u, v in rows:
        a, b = find(u), find(v)
        label[max(a, b)] = min(a, b)
    return {f: find(f) for f in fps}


def test_large_shards_are_cut_anew_and_lose_no_link(monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 8)
    monkeypatch.setattr(simhash, "ROWS", 50)
    fps = planted(7, 40, 40, 4) | {simhash._FULL, 0}
    todo = {(m, f) for f in fps for m in simhash._cut(0, 5, 1)}
    links, rounds = [], 0
    while todo:
        rows = sorted(((m, f & m, f) for m, f in todo), key=lambda x: x[:2])
        cols = [np.array([x[i] for x in rows], np.uint64).view(np.int64) for i in range(3)]
        batch = pa.record_batch([pa.array(c) for c in cols], ["mask", "part", "fp"])
        todo = set()
        for out in simhash._join_shards((batch.slice(i, 17) for i in range(0, len(rows), 17)), 4):
            for m, u, v in zip(*(c.to_pylist() for c in out.columns), strict=True):
                if m is None:
                    links.append((u % 2**64, v % 2**64))
                else:
                    todo.add((m % 2**64, u % 2**64))
        rounds += 1
    assert rounds > 2
    assert roots(links, fps) == closure(fps)


def test_components_of_documents(spark, texts):
    got = {r["doc_id"]: r for r in simhash.op8_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    root = closure(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{f:016x}", least[root[f]]) for i, f in fps.items()}
    kept = simhash.keep_one_of_each(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())


def test_chains_join_up(spark):
    from eventloom.llm.components import connected

    n = 300
    got = connected(spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 999), (5, 5)], "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in got} == {i: 0 for i in range(n + 1)} | {999: 999, 1000: 999}
    assert connected(spark.createDataFrame([], "u long, v long")).collect() == []


def test_odd_rows(odd, empty):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    assert {(i, c) for i, f, c in got if f == "0" * 16} == {(1, 1), (2, 1), (3, 1)}
    assert [c for i, _, c in got if i is None] == [None]
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns and all(r[c] == 777 for r in kept.collect() for c in ("__row", "__copy", "fp", "a.b"))
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 7]
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_one_of_each(empty).collect() == []


def test_a_repeated_id_with_other_texts_loses_no_component(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "abcd"}
    rows = [(1, text["a"]), (5, text["a"]), (5, text["b"]), (7, text["c"]), (7, text["d"]), (None, text["d"])]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, text["a"]), (5, text["b"]), (7, text["c"]), (7, text["d"])]
