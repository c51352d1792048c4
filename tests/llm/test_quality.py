import re
from collections import Counter

from eventloom.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows, cover = Counter(zip(words, words[1:], words[2:], strict=False)), set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_counts(texts):
    for t in [*texts.values(), "", " \n a\n a\n\n", "a b c a b c a b", "é é é é # | \x1c \x85 \xa0", "x\ry\rx", "a a a", "a a a a"]:
        assert quality.base(t.encode()) == brute(t), t


def test_verdicts(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.op5_quality_rules(spark, d).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for i, t in texts.items():
        r, b = got[i], brute(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b
        assert r["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r["base_failed"] and r["kept"])
    judged = [(labels[i], r["kept"]) for i, r in got.items() if i in labels and not r["base_failed"]]
    assert all(kept for q, kept in judged if q == 1)
    assert sum(kept for q, kept in judged if q == 0) <= 0.05 * sum(q == 0 for q, _ in judged)


def test_mean_is_the_same_in_any_chunks(monkeypatch):
    import numpy as np

    r = quality.Ratio(np.random.default_rng(1).normal(size=quality.BUCKETS), 0.0)
    many = [b"", b"abc", b"abcd", "hélo wörld".encode() * 30, b"x" * 1000]
    alone = [r.means([t])[0] for t in many]
    assert np.allclose(r.means(many), alone)
    monkeypatch.setattr(quality, "CHUNK", 50)
    assert np.allclose(r.means(many), alone)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (None, 1), (9, None)], "doc_id long, quality int")
    rows = quality.judge(odd, quality.fit(odd, labels)).collect()
    assert len(rows) == odd.count()
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 4, 5))
    nothing = quality.fit(empty, labels.where("false"))
    assert quality.judge(empty, nothing).collect() == []


def test_all_trusted_documents_count(spark, monkeypatch):
    import numpy as np

    texts = [f"text {i * 7919} of {i * i}" + " more" * (i % 50) for i in range(11_000)]
    rows = [*enumerate(texts), (3, "another text of an id that repeats"), (4, " "), (None, "a row without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 10_500)) for i in range(11_000)] + [(None, 1)], "doc_id long, quality int")
    count = lambda some: sum(np.bincount(g, minlength=quality.BUCKETS) for _, g, _ in quality._grams(some)) + quality.PSEUDO
    good = [t.encode() for i, t in rows if i is not None and i < 10_500]
    p, q = count(good), count([t.encode() for _, t in rows])
    want = quality.Ratio(np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)
    means = want.means([t for t in good if t.strip()])
    # ids broadcast and not; means gathered, and found by ranges
    for sent, gather in ((quality.BROADCAST, quality.GATHER), (0, 10)):
        monkeypatch.setattr(quality, "BROADCAST", sent)
        monkeypatch.setattr(quality, "GATHER", gather)
        got = quality.fit(docs, labels)
        assert np.allclose(got.ratio, want.ratio)
        assert np.isclose(got.threshold, np.quantile(means, quality.QUANTILE) - quality.MARGIN)


def test_quantile_is_that_of_all_values(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(quality, "GATHER", 5)
    monkeypatch.setattr(quality, "PARTS", 4)
    r = np.random.default_rng(2)
    for values in (r.normal(size=300), np.round(r.normal(size=300)), np.full(20, 0.25), [1.0], [-1e300, 0.0, 1e-300, 1e300, 2.0, 3.0, 4.0]):
        df = spark.createDataFrame([(float(v),) for v in values], "score double")
        for q in (0.002, 0.5, 1.0):
            assert np.isclose(quality.quantile_of(df, q), np.quantile(values, q)), (values, q)
