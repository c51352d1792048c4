from math import log2
from zlib import crc32

import numpy as np

from eventloom.llm import language


def brute(trees_of, alphabet, text, order):
    """Code length by walking contexts: counts of one language, method C escapes."""
    def p(context, s):
        total = sum(n for (c, _), n in trees_of.items() if c == context)
        seen = [n for (c, _), n in trees_of.items() if c == context]
        lower = 1 / alphabet if not context else None
        if total == 0:
            return lower if lower else p(context[1:], s)
        own = trees_of.get((context, s), 0)
        if own:
            return own / (total + len(seen))
        return len(seen) / (total + len(seen)) * (lower if lower else p(context[1:], s))

    padded = " " * order + text
    return -sum(log2(p(padded[i : i + order], padded[i + order])) for i in range(len(text)))


def test_code_lengths_are_those_of_the_trees():
    sample = "abra cadabra aba"
    grams = {}
    counts = {}
    padded = "   " + sample
    for i in range(len(sample)):
        g = padded[i : i + 4].encode()
        grams[int.from_bytes(g, "big")] = grams.get(int.from_bytes(g, "big"), 0) + 1
        for k in range(4):
            key = (padded[i + 3 - k : i + 3], padded[i + 3])
            counts[key] = counts.get(key, 0) + 1
    trees = language.compile_trees(["x"], [(np.array(list(grams)), np.array(list(grams.values())))], order=3)
    for text in ("abra", "cab dab", "a", "bbbbb", "rd c", "xyz", "ab~ra"):
        assert abs(trees.lengths([text])[0, 0] - brute(counts, 256, text, 3)) < 1e-4
    # texts in one batch, empty ones among them, and a text in pieces cost the same as alone
    many = ["abra", "", "cab", "a" * 50, ""]
    together = trees.lengths(many)[:, 0]
    assert np.allclose(together, [trees.lengths([t])[0, 0] for t in many])
    chunk, language.CHUNK = language.CHUNK, 7
    assert np.allclose(trees.lengths(many)[:, 0], together)
    language.CHUNK = chunk


def test_no_language_changes_another(monkeypatch):
    """Order and contexts are the same for 1, 17 and 200 languages, in one group or many."""
    r = np.random.default_rng(3)
    grams = []
    for _ in range(200):
        letters = r.choice(np.arange(97, 256), 12, replace=False)
        text = r.choice(letters, 400)
        keys, n = np.unique(text[:-3].astype(np.int64) << 24 | text[1:-2] << 16 | text[2:-1] << 8 | text[3:], return_counts=True)
        grams.append((keys, n))
    texts = ["abc defg", "þß÷ é ñandú", "zzz", "日本"]
    alone = np.concatenate([language.compile_trees(["x"], [g]).lengths(texts) for g in grams], 1)
    for n in (17, 200):
        for cells in (1 << 24, 10_000):
            monkeypatch.setattr(language, "CELLS", cells)
            trees = language.compile_trees([str(i) for i in range(n)], grams[:n])
            assert trees.order == 3 and np.allclose(trees.lengths(texts), alone[:, :n], rtol=1e-5)


def test_held_out_accuracy(spark, documents):
    got = language.op1_language_id(spark, "/root/testdata/sf0.01").toPandas()
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    assert (got.held_out == [crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert len(held) > 200 and (held.lang_pred == lang[held.doc_id].values).mean() > 0.99
    assert got.score.between(0, 1).all() and set(got.lang_pred) <= {*lang, "und"}


def test_odd_rows(spark, odd, empty, documents):
    trees = language.train(documents)
    got = language.identify(odd, trees, carry=["doc_id"]).collect()
    assert len(got) == odd.count()
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3)) for r in got)
    assert language.identify(empty, trees).collect() == []
    assert language.train(empty) is None and language.identify(odd, None).where("lang_pred <> 'und'").isEmpty()
    kept = language.keep_identified(odd, trees)
    assert kept.columns == odd.columns and kept.where("doc_id IN (1, 2, 3)").isEmpty() and kept.where("doc_id = 4").count() == 2


def test_noise_and_other_scripts_go(spark, documents):
    r = np.random.default_rng(7)
    noise = ["".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 400)), "これは日本語の文章です。" * 10, "Это русский текст, и его никто не учил. " * 5]
    rows = spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string").selectExpr("*", "NULL `a.b`")
    assert language.keep_identified(rows, language.train(documents)).collect() == []


def test_clean_documents_are_kept(documents):
    trees = language.train(documents.where(~language.held_out()))
    assert language.keep_identified(documents, trees).count() == documents.count()


def test_an_id_that_repeats_counts_once(spark, documents):
    more = documents.unionByName(documents.where("doc_id < 20").crossJoin(spark.range(50).select()).withColumn("text", documents["text"]))
    a, b = language.train(documents), language.train(more.repartition(5))
    assert a.langs == b.langs and all((x[0] == y[0]).all() and (x[1] == y[1]).all() for x, y in zip(a.counts, b.counts, strict=True))
