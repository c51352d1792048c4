"""Documents in a store: writing them, and queries of them, held against a walk over the same documents."""

import json
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from eventloom.database import Database
from eventloom.functions.paths import as_json, discover
from eventloom.functions.times import rfc3339, rfc3339_nanos
from eventloom.sources import store
from eventloom.sources.documents import assemble

FIRST = datetime(2021, 5, 3, 6, 0, 30, tzinfo=timezone(timedelta(hours=2)))
SKIES = ["clear", "cloud", "fog", "rain", "snow"]


def reading(i):
    """The i-th reading of three stations that take turns, every 7 minutes."""
    return {
        "service": "weather",
        "@timestamp": (FIRST + timedelta(minutes=7 * i, microseconds=i)).isoformat(),
        "station": {"code": "NSW"[i % 3], "floor": i % 4},
        "wet": SKIES[i % 5] in ("fog", "rain", "snow"),
        "sky": SKIES[i % 5],
        "temp": i - 10 if i % 2 else i / 8 - 2,  # whole numbers and fractions
        "serial": 1000 + i % 3,
    }


READINGS = [reading(i) for i in range(30)]
LINES = [json.dumps(r, separators=(",", ":")) for r in READINGS]
SECOND = [int(datetime.fromisoformat(r["@timestamp"]).timestamp()) for r in READINGS]
START, END = SECOND[0] - 60, SECOND[-1] + 60


@pytest.fixture(scope="module")
def weather(spark, tmp_path_factory):
    made = Database(spark, str(tmp_path_factory.mktemp("weather") / "store"), promote=["serial"], max_depth=3, excluded="_noindex")
    made.write_batch("\n".join(LINES) + "\n")
    return made


def ask(start=START, end=END, **more):
    return {"namespace": "weather", "start_time": start, "end_time": end, **more}


def where(*filters, combinator=None):
    return [{"filters": [dict(zip(("field", "op", "value"), f, strict=False)) for f in filters], **({"filter_combinator": combinator} if combinator else {})}]


def those(keep):
    return [x for r, x in zip(READINGS, LINES, strict=True) if keep(r)]


BY_TIME = [{"field": "@timestamp"}]


def sources(df):
    return [r["_source"] for r in df.collect()]


def test_raw_in_order(weather):
    assert sources(weather.query(ask(order_by=BY_TIME))) == LINES
    assert sources(weather.query(ask(SECOND[12], order_by=BY_TIME))) == LINES[12:]
    assert sources(weather.query(ask(end=SECOND[4] + 1, order_by=BY_TIME))) == LINES[:5]
    assert sources(weather.query(ask(order_by=[{"field": "@timestamp", "order": "descending"}], limit=4))) == LINES[:25:-1]
    by_two = sorted(range(30), key=lambda i: (READINGS[i]["station"]["code"], -i))
    assert sources(weather.query(ask(order_by=[{"field": "station.code"}, {"field": "@timestamp", "order": "descending"}]))) == [LINES[i] for i in by_two]
    assert len(set(sources(weather.query(ask(limit=9))))) == 9


@pytest.mark.parametrize(
    ("filters", "keep"),
    [
        (where(("serial", "=", 1001), ("station.floor", "=", 3)), lambda r: r["serial"] == 1001 and r["station"]["floor"] == 3),
        (where(("station.code", "=", "W"), ("wet", "=", False)), lambda r: r["station"]["code"] == "W" and not r["wet"]),
        (where(("sky", "startsWith", "c"), ("sky", "endsWith", "w"), combinator="OR"), lambda r: r["sky"][0] == "c" or r["sky"][-1] == "w"),
        (where(("sky", "notContains", "o"), ("sky", "!=", "fog")), lambda r: "o" not in r["sky"] and r["sky"] != "fog"),
        (where(("temp", "=", 5)), lambda r: r["temp"] == 5),
        (where(("temp", "=", -1.75)), lambda r: r["temp"] == -1.75),
        (where(("temp", ">", 0.5)) + where(("serial", "<", 1002)), lambda r: r["temp"] > 0.5 and r["serial"] < 1002),
        (where(("temp", "exists"), ("rain", "notExists")), lambda r: True),
        (where(("serial", "=", 7)), lambda r: False),
        ([{"filters": []}], lambda r: False),
        (where(("@timestamp", "=", SECOND[3])), lambda r: False),
        (where(("@timestamp", "isNotNull")), lambda r: True),
    ],
)
def test_raw_filters(weather, filters, keep):
    assert sources(weather.query(ask(order_by=BY_TIME, filters=filters))) == those(keep)


def test_no_rows_as_json(weather):
    assert weather.query_json(ask(filters=where(("serial", "=", 7)))) == '{"raw":null}'


def test_grouped(weather):
    q = ask(filters=where(("wet", "=", True)), group_by=["wet", "sky"], calculations=[{"op": "COUNT"}], order_by=[{"field": "sky"}])
    assert [tuple(r) for r in weather.query(q).collect()] == [(True, s, 6.0) for s in ("fog", "rain", "snow")]
    q = ask(group_by=["station.floor"], calculations=[{"op": "COUNT"}], order_by=[{"field": "station.floor"}])
    n = Counter(r["station"]["floor"] for r in READINGS)
    assert json.loads(weather.query_json(q)) == {"groups": [{"key": k, "values": [n[k]]} for k in sorted(n)]}


def test_grouped_calculations(weather):
    q = ask(group_by=["station.code"], calculations=[{"op": "SUM", "field": "temp"}, {"op": "MAX", "field": "sky"}, {"op": "MIN", "field": "@timestamp"}, {"op": "AVG", "field": "temp"}, {"op": "COUNT"}], order_by=[{"op": "SUM", "field": "temp", "order": "descending"}])
    by = defaultdict(list)
    for r, s in zip(READINGS, SECOND, strict=True):
        by[r["station"]["code"]].append((r["temp"], r["sky"], s))
    want = sorted(((c, float(sum(t for t, *_ in x)), max(s for _, s, _ in x), min(x)[2] and min(n for *_, n in x), len(x)) for c, x in by.items()), key=lambda r: -r[1])
    got = weather.query(q).collect()
    assert [(r[0], r[1], r[2], int(r[3] // 1e9), r[5]) for r in got] == want
    assert all(abs(r[4] - r[1] / r[5]) < 1e-12 for r in got)


def test_sum_and_average_of_times(weather):
    row = weather.query(ask(group_by=["service"], calculations=[{"op": "SUM", "field": "@timestamp"}, {"op": "AVG", "field": "@timestamp"}])).first()
    total = sum(s * 10**9 + i * 1000 for i, s in enumerate(SECOND))
    assert (row["value_0"], row["value_1"]) == (float(total), float(total) / 30)


def test_buckets(weather):
    start, end, step = SECOND[0] - 1000, SECOND[-1] + 500, 900

    def counts(keep=lambda r: True, **more):
        got = json.loads(weather.query_json(ask(start, end, time_granularity="15m", **more)))
        begin = start // step * step
        n = Counter((s - begin) // step for r, s in zip(READINGS, SECOND, strict=True) if keep(r))
        want = [(begin + step * i, n[i]) for i in range((-(-end // step) * step - begin) // step)]
        assert [(b["startAtNanos"] // 10**9, b["value"]) for b in got["buckets"]] == want and got["granularity"] == step * 10**9

    counts()
    counts(lambda r: r["serial"] == 1000 and r["sky"] != "fog", filters=where(("serial", "=", 1000), ("sky", "!=", "fog")))
    assert weather.query(ask(start, end, time_granularity="15m", filters=where(("sky", "=", "hail")))).collect() == []


def test_promoted_path_is_pushed_down(spark, weather):
    df = weather.query(ask(filters=where(("serial", "=", 1001)), order_by=BY_TIME))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "serial:int" in plan.split("PushedFilters")[1].split("ReadSchema")[0] and "doc" not in plan.split("ReadSchema")[1]
    assert "isnotnull(dt#" in plan and "GreaterThanOrEqual(ts_nanos" in plan and "TakeOrderedAndProject" in plan


def test_a_path_is_looked_up_once(spark):
    """However many filters and calculations use it, and over a JSON column after one parse."""
    from eventloom.plans import spec
    from eventloom.plans.queries import answer
    from eventloom.sources.bindings import Table

    df = spark.createDataFrame([(i, '{"k": %d, "a": {"b": "x"}}' % i) for i in range(50)], "id long, s string")
    spark.conf.set("spark.sql.maxToStringFields", "1000")
    q = {"namespace": "n", "start_time": 0, "end_time": 10, "filters": where(("s.k", ">", 3), ("s.k", "<", 40.5), ("s.k", "!=", 7)) + where(("s.a.b", "=", "x"), ("s.k", "=", 1), combinator="OR")}
    got = answer(spec.parse(q | {"limit": 100}), Table(df, json=("s",)))
    assert sorted(r["id"] for r in got.collect()) == [i for i in range(4, 41) if i != 7]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1
    assert plan.count("schemaOfVariant(") == 3  # one for each spelling: s.k, s.a.b, s."a.b"


def test_a_write_looks_each_path_up_once(spark):
    """And matches a time once; the schema of a whole document is taken only where an error tells of it."""
    spark.conf.set("spark.sql.maxToStringFields", "1000")
    rows = store.laid_out(assemble(spark.createDataFrame([(LINES[0],)], "value string")), ["sky", "station.code"])
    assert [(r["sky:string"], r["station.code:string"], r["sky:int"], r["sky:null"]) for r in rows.collect()] == [("clear", "N", None, None)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f"$[{p}]") for p in ("'service'", "'@timestamp'", "'sky'", "'station']['code'", "'station.code'")] == [1] * 5
    assert plan.count("regexp_extract(") == 1 and plan.count("RLIKE") == 0 and plan.count("gettimestamp(") == 0
    assert plan.count("schemaOfVariant(doc#") == 1 and "raise_error" in plan.split("schemaOfVariant(doc#")[1].split("\n")[0]


@pytest.mark.parametrize(
    ("text", "nanos"),
    [
        ("2024-01-01T02:00:00.1234567891+02:00", 1704067200123456789),
        ("2024-01-01T00:00:00-18:00", 1704132000000000000),
        ("1969-12-31T23:59:59.5Z", -500000000),
        ("1677-09-21T00:12:44Z", -9223372036000000000),
        ("1677-09-21T00:12:43.2Z", None),
        ("2262-04-11T23:47:16.854775807Z", 2**63 - 1),
        ("2262-04-11T23:47:16.854775808Z", None),
        *((t, None) for t in ("2023-02-29T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01T00:00:00+18:01", "2024-01-01T00:00:00", "2024-01-01 00:00:00Z", "2024-01-01T00:00:00.Z", "2024-1-01T00:00:00Z", "", None)),
    ],
)
def test_times(spark, text, nanos):
    assert spark.createDataFrame([(text,)], "t string").select(rfc3339_nanos(rfc3339(F.col("t")))).first()[0] == nanos


def test_paths_of_any_depth(spark, tmp_path):
    db = Database(spark, str(tmp_path / "store"))
    base = '{"service":"n","@timestamp":"2024-01-01T00:00:00Z","id":%d,%s}'
    docs = ['"n":{"p":{"q.r":{"s":3}}}', '"t":{"a.b":{"c":{"d":5}}}', '"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":1}}}}}}}', '"a.b.c.d.e.f.g.h":2', '"a.b":{"c.d.e":{"f":{"g.h":3}}}', '"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{}}}}}}}},"a.b.c.d":{"e.f.g.h":4}']
    db.write_batch([base % (i, d) for i, d in enumerate(docs)])
    assert ids(db, ("n.p.q.r.s", "=", 3)) == [0] and ids(db, ("t.a.b.c.d", "=", 5)) == [1]
    assert [ids(db, ("a.b.c.d.e.f.g.h", "=", k)) for k in (1, 2, 3, 4)] == [[2], [3], [4], [5]]
    assert ids(db, ("a.b.c.d.e.f.g.h", "notExists")) == [0, 1]


def test_paths_that_are_promoted_later(spark, tmp_path):
    root = str(tmp_path / "store")
    line = '{"service":"n","@timestamp":"2024-01-01T00:00:00Z","id":%d,"late":%d}'
    Database(spark, root).write_batch([line % (i, i % 3) for i in range(6)])
    both = Database(spark, root, promote=["late"])
    assert ids(both, ("late", "=", 1)) == [1, 4]
    both.write_batch([line % (i, i % 3) for i in range(6, 12)])
    assert ids(both, ("late", "=", 1)) == ids(Database(spark, root), ("late", "=", 1)) == [1, 4, 7, 10]
    assert store.promoted_by_all(spark, root) == set()


def test_discovery_and_json_of_documents(spark, weather):
    df = weather.binding("weather").df
    got = {(r["path"], r["kind"]): r["n"] for r in discover(df).collect()}
    want = Counter()
    for r in READINGS:
        flat = {k: v for k, v in r.items() if k != "station"} | {f"station.{k}": v for k, v in r["station"].items()}
        want.update((k, "bool" if isinstance(v, bool) else "string" if isinstance(v, str) else "int" if v == int(v) else "double") for k, v in flat.items())
    assert got == want
    assert all(json.loads(r["_source"]) == json.loads(r["j"]) for r in df.select("_source", as_json(df["doc"]).alias("j")).collect())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    db = Database(spark, str(tmp_path_factory.mktemp("odd") / "store"), max_depth=3, excluded="_noindex")
    values = ["1", "1.0", "1e3", "1.5", '"x"', "true", "null", "{}", "[1]", None, "9007199254740993", "12345678901234567890"]
    docs = []
    for i, v in enumerate(values):
        more = "" if v is None else f',"k":{v}'
        docs.append('{"service":"n","@timestamp":"2024-01-01T00:00:%02d.000000%03dZ","id":%d%s,"a.b":%d,"deep":{"x":{"y":{"z":1}}},"q_noindex":1,"lone":{"r_noindex":2}}' % (i, i, i, more, i))
    docs.append('{"service":"n","@timestamp":"2024-01-01T00:01:00Z","id":12,"a":{"b":77},"a.b":1}')
    db.write_batch(docs)
    return db


def ids(db, *filters, **more):
    q = {"namespace": "n", "start_time": 1704067200, "time_range": "1h", "filters": where(*filters), "order_by": [{"field": "id"}], **more}
    return [json.loads(s)["id"] for s in sources(db.query(q))]


@pytest.mark.parametrize(
    ("filter_", "expected"),
    [
        (("k", "exists"), [0, 1, 2, 3, 4, 5, 6, 10, 11]),
        (("k", "notExists"), [7, 8, 9, 12]),
        (("k", "isNull"), [6]),
        (("k", "isNotNull"), [0, 1, 2, 3, 4, 5, 10, 11]),
        (("k", "=", 1), [0, 1]),
        (("k", "!=", 1), [2, 3, 10, 11]),
        (("k", "!=", 1.5), [0, 1, 2, 10, 11]),
        (("k", "=", True), [5]),
        (("k", "=", "x"), [4]),
        (("k", "!=", "y"), [4]),
        (("k", ">", True), []),
        (("k", "startsWith", 1), []),
        (("k", "=", 9007199254740993), [10]),
        (("k", "=", 9007199254740992), []),
        (("deep.x.y", "exists"), []),
        (("deep.x.y.z", "exists"), []),
        (("q_noindex", "exists"), []),
        (("lone.r_noindex", "exists"), []),
        (("a.b", "=", 77), [12]),
        (("a.b", "=", 3), [3]),
        (("no.such", "notExists"), list(range(13))),
    ],
)
def test_states_of_a_path(odd, filter_, expected):
    assert ids(odd, filter_) == expected


def test_null_key_and_missing_key(odd):
    q = {"namespace": "n", "start_time": 1704067200, "time_range": "1h", "filters": where(("k", "isNull")), "group_by": ["k"], "calculations": [{"op": "COUNT"}]}
    assert odd.query_json(q) == '{"groups":[{"key":null,"values":[1]}]}'
    assert odd.query_json(q | {"filters": where(("k", "notExists"))}) == "{}"


def test_strict_types(odd, spark):
    db = Database(spark, odd.root, strict=True)
    with pytest.raises(ValueError, match="multiple types"):
        db.query({"namespace": "n", "start_time": 1704067200, "time_range": "1h", "order_by": [{"field": "k"}]})


def test_count_beside_sum_counts_rows_with_the_field(odd):
    q = {"namespace": "n", "start_time": 1704067200, "time_range": "1h", "group_by": ["service"], "calculations": [{"op": "COUNT"}, {"op": "AVG", "field": "k"}, {"op": "SUM", "field": "nothing"}]}
    row = odd.query(q).first()
    assert row["value_0"] == 6 and row["value_2"] == 0
    assert odd.query(q | {"calculations": [{"op": "COUNT"}]}).first()["value_0"] == 13


@pytest.mark.parametrize("bad", ['{"service":"n"}', '{"@timestamp":"2024-01-01T00:00:00Z"}', '{"service":"n","@timestamp":"yesterday"}', '{"service":1,"@timestamp":"2024-01-01T00:00:00Z"}', "[1]", "{", "", '{"service":"n","@timestamp":"2024-01-01T00:00:00Z"} tail'])
def test_a_faulty_document_fails_its_batch(spark, tmp_path, bad):
    db = Database(spark, str(tmp_path / "store"))
    good = '{"service":"n","@timestamp":"2024-01-01T00:00:00Z"}'
    with pytest.raises(Exception, match="cannot parse document"):
        db.write_batch([good, bad])
    with pytest.raises(Exception):
        db.query({"namespace": "n", "start_time": 0, "end_time": 2**31}).collect()
    db.write_batch([good, bad], on_error="skip")
    assert db.query({"namespace": "n", "start_time": 0, "end_time": 2**31}).count() == 1


def test_times_that_64_bits_do_not_hold(spark, tmp_path):
    db = Database(spark, str(tmp_path / "store"))
    lines = ['{"service":"n","@timestamp":"9999-12-31T00:00:00Z"}', '{"service":"n","@timestamp":"2024-01-01T00:00:00Z"}', '{"service":"n","@timestamp":"0001-01-01T00:00:00Z"}']
    with pytest.raises(Exception, match="cannot parse document"):
        db.write_batch(lines)
    db.write_batch(lines, on_error="skip")
    assert sources(db.query({"namespace": "n", "start_time": 0, "end_time": 2**31})) == [lines[1]]


def test_stream_into_store(spark, tmp_path):
    from eventloom.streaming.ingest import follow

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([*LINES, "broken", '{"service":"weather","@timestamp":"9999-12-31T00:00:00Z"}']))
    follow(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "check"), available_now=True).awaitTermination()
    db = Database(spark, str(tmp_path / "store"))
    assert sources(db.query(ask(order_by=BY_TIME))) == LINES
    # the commit of the batch is lost, so it is run again
    for f in (tmp_path / "check" / "commits").iterdir():
        f.unlink()
    follow(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "check"), available_now=True).awaitTermination()
    assert sources(db.query(ask(order_by=BY_TIME))) == LINES


def test_load_files_and_precision(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"service":"n","@timestamp":"2024-01-01T00:00:00.123456789Z"}\n')
    db = Database(spark, str(tmp_path / "store"))
    db.load(str(tmp_path / "x.json"))
    db.load(str(tmp_path / "x.json"), precision=10**6)
    got = db.query({"namespace": "n", "start_time": 0, "end_time": 2**31, "group_by": ["@timestamp"], "calculations": [{"op": "COUNT"}], "order_by": [{"field": "@timestamp"}]}).collect()
    assert [r["key_0"] for r in got] == [1704067200123000000, 1704067200123456789]


def test_retention_clamps_the_start(spark, weather):
    db = Database(spark, weather.root, retention=3600 * 10**9)
    assert db.query(ask(order_by=BY_TIME)).collect() == []


def test_flat_fields(spark, tmp_path):
    db = Database(spark, str(tmp_path / "store"))
    db.write_fields("n", [{"time_nanos": 10**18 + i, "fields": {"a.b": i, "c": None if i else "x"}} for i in range(3)] + [{"id": "z", "time_nanos": 10**18, "source": "raw text", "fields": {}}])
    q = {"namespace": "n", "start_time": 0, "end_time": 2**31}
    assert sources(db.query(q | {"filters": where(("a.b", ">=", 1)), "order_by": BY_TIME})) == ['{"a.b":1,"c":null}', '{"a.b":2,"c":null}']
    assert sources(db.query(q | {"filters": where(("a.b", "notExists"))})) == ["raw text"]
    with pytest.raises(ValueError):
        db.write_fields("n", [{"time_nanos": 1, "fields": {"a": [1]}}])


def test_kinds_of_queries_and_namespaces(spark, weather):
    assert weather.health() and weather.query_raw(ask(limit=1)).count() == 1
    assert weather.query_grouped(ask(group_by=["wet"])).count() == 2
    assert weather.query_time_bucket(ask(SECOND[0], SECOND[0] + 6000, time_granularity="10m")).count() == 11
    with pytest.raises(ValueError):
        weather.query_raw(ask(group_by=["wet"]))
    with pytest.raises(ValueError, match="no such namespace"):
        Database(spark).query(ask())
    assert weather.query(ask() | {"namespace": "other"}).collect() == []
