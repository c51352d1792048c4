import random

import numpy as np

from eventloom.llm import separators


def test_scan_against_a_walk(spark, monkeypatch):
    monkeypatch.setattr(separators, "GROUP", 3)
    r, rows, want = random.Random(3), [], []
    for f, n in enumerate([0, 1, 40, 7, 64, 500]):
        tokens = [r.choice([9, 9, 1, 2]) if f != 3 else 1 for _ in range(n)]
        rows += [(f, b // 8, bytearray(np.array(tokens[b : b + 8], "<u2").tobytes())) for b in range(0, n, 8)]
        start = ordinal = 0
        for i, x in enumerate(tokens):
            if x == 9:
                want.append((f, ordinal, start, i - start, True))
                start, ordinal = i + 1, ordinal + 1
        if start < n:
            want.append((f, ordinal, start, n - start, False))
    blocks = spark.createDataFrame(rows, "file long, block long, tokens binary").repartition(7)
    assert sorted(map(tuple, separators.count(blocks, 8, 9).collect())) == sorted(want)


def test_round_trip_of_documents(spark, odd, empty, texts):
    encoding = separators._encoding()
    got = {r["doc_id"]: r["n_tokens"] for r in separators.op3_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: len(encoding.encode_ordinary(t)) for i, t in texts.items()}
    files = separators.materialize(separators.flat_files(odd, block=1000), "flat")
    counts = separators.count(files.where("tokens IS NOT NULL"), block=1000).join(files.where("tokens IS NULL").select("file", "ordinal", "doc_id"), ["file", "ordinal"])
    want = sorted((r["doc_id"] or -1, len(encoding.encode_ordinary(r["text"] or ""))) for r in odd.collect())
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in counts.collect()) == want
    none = separators.materialize(separators.flat_files(empty), "flat")
    assert separators.count(none.where("tokens IS NOT NULL")).collect() == []


def test_flat_files_are_read_by_ranges(spark, tmp_path):
    r, want = random.Random(8), []
    for name, n in (("a.bin", 5000), ("b.bin", 1), ("c.bin", 0), ("d d.bin", 777)):
        tokens = np.array([r.choice([9, 9, 1, 2, 60_000]) for _ in range(n)], "<u2")
        (tmp_path / name).write_bytes(tokens.tobytes())
        start = 0
        for i in np.flatnonzero(tokens == 9).tolist():
            want.append((i - start, True))
            start = i + 1
        if start < n:
            want.append((n - start, False))
    blocks = separators.read_flat(spark, str(tmp_path), block=64)
    assert blocks.count() == 79 + 1 + 13
    assert sorted((x["n_tokens"], x["closed"]) for x in separators.count(blocks, 64, 9).collect()) == sorted(want)
