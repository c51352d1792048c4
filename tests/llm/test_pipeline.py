"""The pipeline's stages, each held against what it must do on its own input."""

import itertools
import re
import string

import __spark_entry__
import corpus_pipeline
import pytest

from eventloom.llm import language, secrets
from pyspark.sql.functions import lit as spark_lit

from eventloom.llm.common import materialize

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        new = materialize(stage(spark, docs, DATA), "test")
        out.append((name, docs, new))
        docs = new
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_all_but_the_last_return_documents(stages):
    assert [n for n, *_ in stages] == ["language_id", "simhash_near_dedup", "secret_scan", "source_mixing", "best_fit_packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def least_of_similar(docs):
    """The least id of each group that 5-word Jaccard similarities of 0.8 or more join, by comparing all pairs."""
    sets, group = {}, {}
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
        n = min(5, len(words))
        sets[r["doc_id"]] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
        group[r["doc_id"]] = r["doc_id"]

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            x, y = sorted((root(i), root(j)))
            group[y] = x
    return sorted({root(i) for i in sets})


def test_stages(stages):
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = stages
    assert ids(a.where("text RLIKE '\\\\p{L}'")) == ids(b)
    assert ids(c) == least_of_similar(b)
    assert ids(d) == ids(c)
    ratios = secrets.train(secrets.samples(c))
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(c, ratios).collect()}
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    before, after = text(c), text(d)
    assert all((before[i] != after[i]) == bool(found[i]) for i in before)
    assert set(ids(e)) == set(ids(d))
    assert sorted(set(ids(f))) == sorted(set(ids(e)))
    assert f.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").isEmpty()


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, DATA)) == key(stages[-1][2])


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_columns_of_any_name_pass(spark, documents):
    docs = documents.withColumns({c: spark_lit(777) for c in ("epoch", "block", "mix_at", "n_tokens", "__row", "__spans", "a.b")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, DATA), "test")
        assert all(r[c] == 777 for r in docs.collect() for c in ("epoch", "block", "mix_at", "n_tokens", "__row", "__spans", "a.b"))


def test_empty_documents(spark, empty):
    docs = materialize(empty, "test")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), "test")
    assert docs.collect() == []


def test_rejects_what_is_no_language(spark, documents):
    junk = spark.createDataFrame([(10**6, "12345 67890 !!! 111"), (10**6 + 1, None)], "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "CAST(5 AS BIGINT) n_chars")
    kept = language.keep_identified(documents.unionByName(junk), language.train(documents))
    assert ids(kept) == ids(documents)
