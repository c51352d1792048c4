"""Query objects: what they resolve to, and what is wrong with wrong ones."""

import base64
import json

import pytest

from eventloom.functions.times import NANOS, duration
from eventloom.plans import spec
from eventloom.plans.queries import bucket_range
from eventloom import render

S = NANOS["s"]
BASE = {"namespace": "n", "start_time": 100, "end_time": 200}


def test_a_whole_query():
    q = spec.parse(
        """{"namespace": "shop", "start_time": 86400, "time_range": "36h",
            "filters": [{"filters": [{"field": "cart.total", "op": ">=", "value": 99.5}, {"field": "coupon", "op": "exists"}], "filter_combinator": "OR"}, {"filters": [{"field": "land", "op": "!=", "value": "is"}]}],
            "group_by": ["land", "cart.size"], "calculations": [{"op": "SUM", "field": "cart.total"}, {"op": "COUNT"}, {"op": "MAX", "field": "at"}],
            "order_by": [{"op": "MAX", "field": "at"}, {"field": "cart.size", "order": "descending"}, {"op": "COUNT", "order": "descending"}], "limit": 3}"""
    )
    assert (q.start, q.end, q.limit, q.kind) == (86400 * S, 216000 * S, 3, "grouped")
    assert [(o.kind, o.index, o.descending) for o in q.order_by] == [("calculation", 2, False), ("group", 1, True), ("calculation", 1, True)]
    assert [fl.combinator for fl in q.filters] == ["OR", "AND"] and q.filters[0].filters[1] == spec.Filter("coupon", "exists")
    assert spec.parse(spec.unparse(q)) == q


@pytest.mark.parametrize(
    "more",
    [{}, {"time_granularity": "10s"}, {"filters": [{"filters": [{"field": "a", "op": "exists"}], "filter_combinator": "OR"}, {"filters": []}]}, {"order_by": [{"field": "a", "order": "descending"}], "limit": 3}, {"group_by": ["a"], "calculations": [{"op": "COUNT"}], "order_by": [{"op": "COUNT"}]}],
)
def test_round_trip(more):
    q = spec.parse(BASE | more)
    assert spec.parse(spec.unparse(q)) == q


def test_times():
    ask = lambda **x: spec.parse({"namespace": "n", **x}, now=10**18)
    assert (lambda q: (q.start, q.end))(ask(start_time=5, end_time=7)) == (5 * S, 7 * S)
    assert (lambda q: (q.start, q.end))(ask(start_time=5, time_range="2s")) == (5 * S, 7 * S)
    assert (lambda q: (q.start, q.end))(ask(end_time=7, time_range="2s")) == (5 * S, 7 * S)
    assert (lambda q: (q.start, q.end))(ask(time_range="1m")) == (10**18 - 60 * S, 10**18)
    assert ask(start_time=5, end_time=7, time_unit="1ms").end == 7 * 10**6
    assert ask(start_time=9, end_time=7).kind == "raw"


def test_defaults():
    assert spec.parse(BASE).limit == 100
    assert spec.parse(BASE | {"group_by": ["a"]}).limit == 10
    assert spec.parse(BASE | {"time_granularity": "10s"}).kind == "buckets"
    assert spec.parse(BASE | {"filters": [{"filters": [{"field": "a", "op": "=", "value": 2.0}]}]}).filters[0].filters[0].value == 2


@pytest.mark.parametrize(
    "change",
    [
        {"namespace": ""},
        {"namespace": None},
        {"start_time": -1},
        {"end_time": -1},
        {"end_time": None},
        {"time_range": "1h"},
        {"end_time": None, "time_range": "0s"},
        {"end_time": None, "time_range": "-1h"},
        {"end_time": None, "time_range": "1x"},
        {"time_unit": "2s"},
        {"time_granularity": "0s"},
        {"time_granularity": "11s"},
        {"time_granularity": "99ms"},
        {"time_granularity": "10s", "group_by": ["a"]},
        {"time_granularity": "10s", "order_by": [{"field": "a"}]},
        {"time_granularity": "10s", "calculations": [{"op": "COUNT"}]},
        {"calculations": [{"op": "COUNT"}]},
        {"group_by": ["a"], "calculations": [{"op": "COUNT", "field": "a"}]},
        {"group_by": ["a"], "calculations": [{"op": "SUM"}]},
        {"group_by": ["a"], "calculations": [{"op": "MEDIAN", "field": "a"}]},
        {"group_by": ["a"], "order_by": [{"field": "b"}]},
        {"group_by": ["a"], "order_by": [{}]},
        {"group_by": ["a"], "order_by": [{"op": "COUNT"}]},
        {"group_by": ["a"], "order_by": [{"op": "SUM"}]},
        {"group_by": ["a"], "order_by": [{"op": "COUNT", "field": "a"}]},
        {"order_by": [{"order": "ascending"}]},
        {"order_by": [{"field": "a", "order": "up"}]},
        {"limit": 0},
        {"limit": -5},
        {"filters": [{"filters": [{"op": "=", "value": 1}]}]},
        {"filters": [{"filters": [{"field": "a", "op": "like", "value": 1}]}]},
        {"filters": [{"filters": [{"field": "a", "op": "=", "value": None}]}]},
        {"filters": [{"filters": [{"field": "a", "op": "exists", "value": 1}]}]},
        {"filters": [{"filters": [{"field": "a", "op": "=", "value": [1]}]}]},
        {"filters": [{"filters": [], "filter_combinator": "XOR"}]},
        {"filters": [{"filters": ["a"]}]},
        {"filters": [{"filters": [{"field": 3, "op": "exists"}]}]},
        {"filters": [{"filters": [{"field": "a", "op": "=", "value": 2**63}]}]},
        {"filters": ["a"]},
        {"group_by": ["a"], "calculations": ["COUNT"]},
        {"group_by": ["a"], "calculations": [{"op": "SUM", "field": 1}]},
        {"order_by": ["a"]},
        {"order_by": [{"field": 1}]},
        {"end_time": 2**64},
        {"end_time": 2**62},
    ],
)
def test_wrong_queries(change):
    with pytest.raises(ValueError):
        spec.parse(BASE | change)


def test_durations():
    assert duration("1h30m") == 5400 * S and duration("1.5s") == 1_500_000_000 and duration("-2ms") == -2_000_000 and duration("0") == 0 and duration("3us4ns") == 3004
    for bad in ("", "s", "1", "1 s", "1d"):
        with pytest.raises(ValueError):
            duration(bad)


def test_bucket_range():
    assert bucket_range(90 * S, 400 * S, 60 * S) == (60 * S, 6)
    assert bucket_range(0, 10, 5) == (0, 2) and bucket_range(3, 11, 5) == (0, 3)


def test_rendering():
    docs = ['{"n":1}', "é"]
    assert json.loads(render.raw(docs)) == {"raw": [base64.b64encode(d.encode()).decode() for d in docs]}
    assert render.raw([]) == '{"raw":null}' and render.groups([]) == "{}"
    one = [(["oak"], [4.0, 0.25]), ([None], [float("nan"), None])]
    assert json.loads(render.groups(one)) == {"groups": [{"key": "oak", "values": [4, 0.25]}, {"key": None, "values": [None, None]}]}
    assert '"values":[4,0.25]' in render.groups(one)  # a whole double has no fraction
    assert json.loads(render.groups([(["oak", 7, True], ["tall"])])) == {"groups": [{"key": ["oak", 7, True], "values": ["tall"]}]}
    assert json.loads(render.buckets(60, [(120, 0), (180, 5)])) == {"granularity": 60, "buckets": [{"startAtNanos": 120, "value": 0}, {"startAtNanos": 180, "value": 5}]}
