import re
from collections import Counter, defaultdict
from math import log

from eventloom.llm import mixing

ALONE = "\u0e00-\u0e7f\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[A-Za-z\u00c0-\u024f]+|[0-9]|[!-/:-@\[-`{{-~]+|[{ALONE}]|[^\x00-\x7f\u00c0-\u024f{ALONE}]+")


def test_tokens(spark, texts):
    more = ["日本語のテキスト 12 a-b c.d!? é́x", "ไทย abc", "", "a\u00a0b\x85", "한국어 text", "Привет, мир! 𠀀𠀁 x₂", "\x00\x01 a\x7fb", "5×3÷2"]
    rows = [(i, t) for i, t in enumerate([*texts.values(), *more])]
    got = spark.createDataFrame(rows, "i long, text string").select("i", mixing.tokens(mixing.F.col("text")).alias("n")).collect()
    assert all(r["n"] == len(TOKEN.findall(rows[r["i"]][1])) + 1 for r in got)


def weights(tokens, power):
    total = sum(tokens.values())
    w = {s: (n / total) ** power for s, n in tokens.items()}
    return {s: x / sum(w.values()) for s, x in w.items()}


def entropy(p):
    return -sum(x * log(x) for x in p.values() if x)


def test_exponent_meets_its_targets(spark):
    tokens = {"a": 1000, "b": 100, "c": 10, "d": 10}
    sources = spark.createDataFrame(list(tokens.items()), "source string, n_tokens long")
    for share in (0.5, 0.8, 0.95):
        power = mixing.exponent(sources, share, 1e9)
        assert 0 < power < 1 and abs(entropy(weights(tokens, power)) - share * log(4)) < 1e-3
    for limit in (1.5, 4.0):
        power = mixing.exponent(sources, 1.0, limit)
        w = weights(tokens, power)
        use = [w[s] / n for s, n in tokens.items()]
        assert max(use) / min(use) <= limit * 1.001 and max(use) / min(use) > limit * 0.99
    power = mixing.exponent(sources, 1.0, 3.0, budget=1120.0)
    assert abs(max(weights(tokens, power)[s] * 1120 / n for s, n in tokens.items()) - 3.0) < 0.01
    assert mixing.exponent(sources, 0.01, 1e9) == 1.0 and mixing.exponent(sources, 1.0, 1e9) < 1e-6
    assert mixing.exponent(sources.limit(1)) == 1.0 and mixing.exponent(sources.where("false")) == 1.0


def test_every_document_and_the_weights(spark, documents):
    rows = documents.selectExpr("doc_id", "text", "CASE WHEN doc_id % 3 = 0 THEN 'hot' WHEN doc_id % 20 = 1 THEN NULL ELSE 'rest' END AS source")
    got = mixing.mix(rows, entropy=0.95, repeats=2.0).collect()
    count = {r["doc_id"]: len(TOKEN.findall(r["text"])) + 1 for r in rows.collect()}
    uses = Counter(r["doc_id"] for r in got)
    assert set(uses) == set(count) and max(uses.values()) <= 3
    assert all(r["n_tokens"] == count[r["doc_id"]] and 0 <= r["mix_at"] < 1 for r in got)
    tokens, used, blocks = Counter(), Counter(), {}
    for r in rows.collect():
        tokens[r["source"]] += count[r["doc_id"]]
    for r in got:
        used[r["source"]] += r["n_tokens"]
        blocks.setdefault((r["source"], r["epoch"]), {}).setdefault(r["mix_at"], set()).add(r["block"])
    power = mixing.exponent(spark.createDataFrame(list(tokens.items()), "source string, n_tokens long"), 0.95, 2.0)
    w = weights(tokens, power)
    least = min(w[s] / tokens[s] for s in tokens)
    largest = max(Counter((r["source"], r["block"]) for r in got).values()) * max(count.values())
    for s in tokens:  # as close as blocks allow
        assert abs(used[s] - w[s] / least) <= largest
    assert all(len(x) == 1 for at in blocks.values() for x in at.values())


def test_blocks_hold_about_as_many_tokens(spark, monkeypatch):
    """Each source is cut by its own tokens, however many sources there are."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 5000)
    docs = spark.range(20_000).selectExpr("id doc_id", "repeat('w ', 99) text", "IF(id % 2 = 0, 'big', concat('s', id % 200)) source")
    rows = mixing.mix(docs).where("epoch = 0").groupBy("source", "block").sum("n_tokens").collect()
    size = defaultdict(list)
    for r in rows:
        size[r[0]].append(r[2])
    assert len(size) == 101 and len(size["big"]) == 200 and all(len(x) == 2 for s, x in size.items() if s != "big")
    assert 2000 < min(map(min, size.values())) and max(map(max, size.values())) < 9000


def test_schedule_against_a_walk(spark):
    """Whole passes, each in an order of its own, then blocks of one more as long as they fit to half a block."""
    blocks = [("a", b, 10 + b) for b in range(7)] + [(None, 0, 40), ("c", 0, 5), ("c", 1, 6)]
    weighted = [("a", sum(10 + b for b in range(7)), 0.5, 2.4), (None, 40, 0.3, 1.0), ("c", 11, 0.2, 0.6)]
    got = mixing.schedule(spark.createDataFrame(blocks, "source string, block int, n_tokens long"), spark.createDataFrame(weighted, "source string, n_tokens long, weight double, epochs double")).collect()
    hashed = {(e, b): x for e, b, x in spark.range(3).crossJoin(spark.range(7).toDF("b")).selectExpr("CAST(id AS INT) e", "CAST(b AS INT) b").selectExpr("e", "b", f"xxhash64({mixing.SEED}, e, b)").collect()}
    want = {}
    for source, all_, _, epochs in weighted:
        own = [(b, n) for s, b, n in blocks if s == source]
        for epoch in range(int(epochs) + 1):
            before = 0
            for b, n in sorted(own, key=lambda x: (hashed[epoch, x[0]], x[0])):
                if epoch < int(epochs) or before + n / 2 <= (epochs - int(epochs)) * all_:
                    want.setdefault((source, b), []).append((epoch, (epoch * all_ + before) / epochs / all_))
                before += n
    told = {(r["source"], r["block"]): [(e, round(x, 9)) for e, x in r["uses"]] for r in got}
    assert told == {k: [(e, round(x, 9)) for e, x in sorted(v)] for k, v in want.items()}


def test_budget_takes_blocks(spark):
    docs = spark.createDataFrame([(i, "w " * 99, f"s{i % 2}") for i in range(8000)], "doc_id long, text string, source string")
    got = mixing.mix(docs, entropy=0.0, budget=400_000.0).groupBy("source").sum("n_tokens").collect()
    assert len(got) == 2
    # six blocks a source: the budget is met to half a block
    assert all(abs(r[1] - 200_000) < 60_000 for r in got)


def test_rows_in_the_order_of_the_mixture(spark, documents, tmp_path):
    mixed = mixing.mix(documents)
    mixing.in_order(mixed).write.parquet(str(tmp_path / "out"))
    at = []
    for f in sorted((tmp_path / "out").glob("*.parquet")):
        at += [r["mix_at"] for r in spark.read.parquet(str(f)).select("mix_at").collect()]
    assert at == sorted(at) and len(at) == mixed.count()


def test_own_columns_are_carried_as_they_are(odd, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST", 0)  # and tables too large to broadcast
    got = mixing.mix(odd, names=("b_", "e_", "m_", "n_"))
    assert got.columns == [*odd.columns, "n_", "b_", "e_", "m_"]
    assert all(r[c] == 777 for r in got.collect() for c in ("block", "epoch", "mix_at", "n_tokens", "__source", "__uses", "a.b"))


def test_odd_rows(odd, empty):
    got = mixing.mix(odd)
    assert got.count() == odd.count()  # one source, used once
    assert set(got.columns) == {*odd.columns, "n_tokens", "block", "epoch", "mix_at"}
    assert mixing.mix(empty).collect() == []


def test_no_python_in_the_plan(documents):
    plan = mixing.mix(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
