import pytest

DOC = "doc_id long, text string"
#: Rows that every operator on documents must bear: null, empty, blank, repeated, very long, extra columns with clashing names.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four five"), (4, "one two three four five"), (5, "word " * 60_000), (None, "no id here"), (6, "日本語 \x00 ﬁ 𝒳"), (7, "é" * 300_000)]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    more = {c: F.lit(777) for c in ("score", "block", "fp", "lang_pred", "n_tokens", "rank", "u", "__rank", "epoch", "mix_at", "__source", "__uses", "__keep", "__copy", "__row", "__block", "__spans", "__base", "__clean", "a.b")}
    return spark.createDataFrame(ODD, DOC).withColumns(more | {"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC + ", lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}
