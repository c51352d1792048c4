from eventloom.llm.common import hashed_sample


def test_samples_are_bounded_and_lasting(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', CONCAT('s', id % 50)) AS source")
    a = hashed_sample(rows, "doc_id", 20, "source").collect()
    per = {}
    for r in a:
        per[r["source"]] = per.get(r["source"], 0) + 1
    assert len(per) == 51 and max(per.values()) <= 20 and min(per.values()) >= 10
    assert sorted(map(tuple, a)) == sorted(map(tuple, hashed_sample(rows.repartition(7), "doc_id", 20, "source").collect()))
    assert hashed_sample(rows, "doc_id", 100).count() == 100
    assert hashed_sample(rows.limit(30), "doc_id", 100).count() == 30
    assert hashed_sample(rows.where("false"), "doc_id", 100).count() == 0
