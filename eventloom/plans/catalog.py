"""The registered queries: each operator of the engine over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.database import Database
from eventloom.functions.paths import discover
from eventloom.plans import spec
from eventloom.plans.queries import answer
from eventloom.sources.bindings import Binding, Table
from eventloom.sources.scratch import shared_dir

#: All of the tables' times lie in this range.
ALL = {"start_time": 0, "end_time": 4102444800}
#: In place of a limit: all rows or groups, however many.
EVERY = "every"
_TIMES = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
#: A JSON column in which k is missing, null, a number, a string, a fraction or a boolean.
STATES = "CASE WHEN event_id % 6 = 0 THEN '{}' WHEN event_id % 6 = 1 THEN '{\"k\": null}' WHEN event_id % 6 = 2 THEN '{\"k\": \"s\"}' WHEN event_id % 6 = 3 THEN '{\"k\": 2.5}' WHEN event_id % 6 = 4 THEN '{\"k\": true}' ELSE props END"


def bound(spark: SparkSession, sf_dir: str, name: str) -> Binding:
    """A table as a namespace; states and flags are events with a derived column."""
    table = "events" if name in ("states", "flags") else name
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name == "states":
        df = df.withColumn("s", F.expr(STATES))
    if name == "flags":
        df = df.withColumn("large", F.col("value") > 50)
    declared = {"props.k": ("int",)} if name == "events" else {}
    return Table(df, time=_TIMES.get(table), json=("s",) if name == "states" else ("props",) if name == "events" else (), declared=declared)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: dict, columns: dict[str, str], oracle: str) -> None:
    """Register a query under its name; columns renames (or, for a raw query, selects) what it returns."""
    query = (ALL if "start_time" not in query and "end_time" not in query else {}) | query
    every = query.get("limit") == EVERY
    query = {k: v for k, v in query.items() if not (every and k == "limit")}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = spec.parse(query)
        q = replace(q, limit=None) if every else q
        return answer(q, bound(spark, sf_dir, q.namespace)).select(*(F.col(f"`{a}`").alias(b) for a, b in columns.items()))

    QUERIES[name], ORACLES[name] = run, oracle


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def _where(*filters: tuple, combinator: str | None = None) -> dict:
    out: dict = {"filters": [dict(zip(("field", "op", "value"), f, strict=False)) for f in filters]}
    return out | ({"filter_combinator": combinator} if combinator else {})


def _order(*keys: str) -> list[dict]:
    return [{"field": k.removeprefix("-"), "order": "descending" if k[0] == "-" else "ascending"} for k in keys]


_EVENT = _same("event_id", "user_id", "event_type", "value")
_E = "event_id, user_id, event_type, value"


def _filter(name: str, namespace: str, key: str, filters: list[dict], where: str, table: str | None = None, limit: int | str = EVERY) -> None:
    """A raw query that returns the keys of all rows that pass."""
    _add(name, {"namespace": namespace, "filters": filters, "limit": limit}, _same(key), f"SELECT {key} FROM {table or namespace} WHERE {where}")


# raw: order, limit, time

_add("raw_unfiltered_ordered", {"namespace": "events", "order_by": _order("ts", "event_id"), "limit": 500}, _EVENT, f"SELECT {_E} FROM events ORDER BY ts, event_id LIMIT 500")
_add("raw_multi_order", {"namespace": "events", "order_by": _order("event_type", "-value", "event_id"), "limit": 50}, _EVENT, f"SELECT {_E} FROM events ORDER BY event_type, value DESC, event_id LIMIT 50")
_add("raw_desc", {"namespace": "orders", "order_by": _order("-o_totalprice", "o_orderkey"), "limit": 20}, _same("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_add("raw_default_limit", {"namespace": "orders", "order_by": _order("@timestamp", "o_orderkey")}, _same("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
_add("raw_order_presence", {"namespace": "states", "order_by": _order("event_id", "s.k"), "limit": 50}, _same("event_id"), "SELECT event_id FROM events WHERE event_id % 6 <> 0 ORDER BY event_id LIMIT 50")


def _unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any 37 of the rows that pass: how many come, and how many of them pass."""
    q = spec.parse({"namespace": "events", **ALL, "filters": [_where(("event_type", "=", "click"))], "limit": 37})
    return answer(q, bound(spark, sf_dir, "events")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("passing"))


QUERIES["raw_unordered_limit"] = _unordered
ORACLES["raw_unordered_limit"] = "SELECT count(*) AS n, count(*) AS passing FROM (SELECT 1 FROM events WHERE event_type = 'click' LIMIT 37)"

_T = "ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-07 00:00:00'"
_add("time_start_end", {"namespace": "events", "start_time": 1704412800, "end_time": 1704585600, "limit": EVERY}, _EVENT, f"SELECT {_E} FROM events WHERE {_T}")
_add("time_start_range", {"namespace": "events", "start_time": 1704412800, "time_range": "48h", "limit": EVERY}, _EVENT, f"SELECT {_E} FROM events WHERE {_T}")
_add("time_end_range", {"namespace": "events", "end_time": 1704585600, "time_range": "47h60m", "limit": EVERY}, _EVENT, f"SELECT {_E} FROM events WHERE {_T}")
_add("time_units_ms", {"namespace": "events", "start_time": 1704412800000, "end_time": 1704585600000, "time_unit": "1ms", "limit": EVERY}, _EVENT, f"SELECT {_E} FROM events WHERE {_T}")
_add("time_units_hour", {"namespace": "events", "start_time": 473448, "end_time": 473496, "time_unit": "1h", "limit": EVERY}, _EVENT, f"SELECT {_E} FROM events WHERE {_T}")

# filters

_SQL = {"=": "=", "!=": "<>", ">": ">", ">=": ">=", "<": "<", "<=": "<="}
_NAMES = {"=": "eq", "!=": "ne", ">": "gt", ">=": "ge", "<": "lt", "<=": "le"}
for _op, _short in _NAMES.items():
    _filter(f"filter_{_short}_string", "orders", "o_orderkey", [_where(("o_orderpriority", _op, "3-MEDIUM"))], f"o_orderpriority {_SQL[_op]} '3-MEDIUM'")
    _filter(f"filter_{_short}_int", "part", "p_partkey", [_where(("p_size", _op, 20))], f"p_size {_SQL[_op]} 20")
    _filter(f"filter_{_short}_int_double_literal", "part", "p_partkey", [_where(("p_size", _op, 20.5))], f"p_size {_SQL[_op]} 20.5")
    _double = {"=": "abs(value - 42.5) < 1e-10", "!=": "abs(value - 42.5) >= 1e-10"}.get(_op, f"value {_SQL[_op]} 42.5")
    _filter(f"filter_{_short}_double", "events", "event_id", [_where(("value", _op, 42.5))], _double)
    _double = {"=": "abs(l_quantity - 25) < 1e-10", "!=": "abs(l_quantity - 25) >= 1e-10"}.get(_op, f"l_quantity {_SQL[_op]} 25")
    _add(f"filter_{_short}_double_int_literal", {"namespace": "lineitem", "filters": [_where(("l_quantity", _op, 25))], "limit": EVERY}, _same("l_orderkey", "l_linenumber"), f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_double}")
for _op in ("=", "!="):
    _filter(f"filter_{_NAMES[_op]}_bool", "flags", "event_id", [_where(("large", _op, True))], f"(value > 50) {_SQL[_op]} true", "events")
for _op, _short, _sql, _type, _name in (
    ("startsWith", "starts", "starts_with({}, '{}')", "ST", "small"),
    ("notStartsWith", "not_starts", "NOT starts_with({}, '{}')", "ST", "small"),
    ("endsWith", "ends", "ends_with({}, '{}')", "UM", "gear"),
    ("notEndsWith", "not_ends", "NOT ends_with({}, '{}')", "UM", "gear"),
    ("contains", "contains", "contains({}, '{}')", "AN", "e w"),
    ("notContains", "not_contains", "NOT contains({}, '{}')", "AN", "e w"),
):
    for _field, _lit, _suffix in (("p_type", _type, ""), ("p_name", _name, "_name")):
        _filter(f"filter_{_short}{_suffix}", "part", "p_partkey", [_where((_field, _op, _lit))], _sql.format(_field, _lit))
for _op, _short, _sql in (
    ("exists", "exists", "event_id % 6 <> 0"),
    ("notExists", "not_exists", "event_id % 6 = 0"),
    ("isNull", "is_null", "event_id % 6 = 1"),
    ("isNotNull", "is_not_null", "event_id % 6 NOT IN (0, 1)"),
):
    _filter(f"filter_{_short}", "states", "event_id", [_where(("s.k", _op))], _sql, "events")
    _filter(f"filter_{_short}_column", "orders", "o_orderkey", [_where(("o_orderpriority", _op))], {"exists": "true", "isNotNull": "true"}.get(_op, "false"))
_filter("filter_mixed_types", "states", "event_id", [_where(("s.k", ">", 2.25))], "event_id % 6 = 3 OR event_id % 6 = 5 AND CAST(props->>'$.k' AS BIGINT) > 2.25", "events")
_filter("filter_json_path", "events", "event_id", [_where(("props.k", ">=", 50))], "CAST(props->>'$.k' AS BIGINT) >= 50")
_filter("filter_missing_path", "events", "event_id", [_where(("no.such.path", "notExists"))], "true")
_filter("filter_time_takes_no_literal", "events", "event_id", [_where(("@timestamp", ">", 0))], "false")
_filter("filter_other_type", "events", "event_id", [_where(("event_type", "=", 1))], "false")
_filter("filter_and_list", "events", "event_id", [_where(("event_type", "=", "click"), ("value", ">", 30), ("value", "<", 80.5))], "event_type = 'click' AND value > 30 AND value < 80.5")
_filter("filter_or_list", "events", "event_id", [_where(("event_type", "=", "click"), ("value", ">", 100), combinator="OR")], "event_type = 'click' OR value > 100")
_filter("filter_and_of_ors", "events", "event_id", [_where(("event_type", "=", "click"), ("event_type", "=", "view"), combinator="OR"), _where(("value", "<", 5), ("value", ">", 100), combinator="OR")], "event_type IN ('click', 'view') AND (value < 5 OR value > 100)")
_filter("filter_empty_list", "events", "event_id", [{"filters": []}], "false")
_filter("presence_all_fields", "states", "event_id", [_where(("s.k", "exists"), ("value", "exists"))], "event_id % 6 <> 0", "events")
_filter("presence_any_field", "states", "event_id", [_where(("s.k", "exists"), ("event_type", "=", "view"), combinator="OR")], "event_id % 6 <> 0 OR event_type = 'view'", "events")

# groups

def _group(name: str, namespace: str, by: dict[str, str], calcs: dict[str, tuple[str, str | None]], sql: str, limit: int | str | None = EVERY, **more) -> None:
    """by: alias -> field; calcs: alias -> (op, field)."""
    q = {"namespace": namespace, "group_by": list(by.values()), "calculations": [{"op": op} | ({"field": f} if f else {}) for op, f in calcs.values()], **more}
    columns = {f"key_{i}": a for i, a in enumerate(by)} | {f"value_{i}": a for i, a in enumerate(calcs)}
    _add(name, q | ({"limit": limit} if limit else {}), columns, sql)


_group("group_count_single", "events", {"event_type": "event_type"}, {"n": ("COUNT", None)}, "SELECT event_type, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1")
_group("group_count_multi", "lineitem", {"flag": "l_returnflag", "status": "l_linestatus"}, {"n": ("COUNT", None)}, "SELECT l_returnflag AS flag, l_linestatus AS status, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2")
_group("group_no_calculation", "lineitem", {"flag": "l_returnflag", "number": "l_linenumber"}, {}, "SELECT DISTINCT l_returnflag AS flag, l_linenumber AS number FROM lineitem")
_group("group_by_int", "part", {"size": "p_size"}, {"n": ("COUNT", None)}, "SELECT p_size AS size, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY 1")
_group("group_by_bool", "flags", {"large": "large"}, {"n": ("COUNT", None)}, "SELECT value > 50 AS large, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1")
_group("group_by_double", "lineitem", {"discount": "l_discount"}, {"n": ("COUNT", None)}, "SELECT l_discount AS discount, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1")
_group("group_by_time", "orders", {"at": "o_orderdate"}, {"n": ("COUNT", None)}, "SELECT epoch_ns(o_orderdate) AS at, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1")
_group("group_sum_num", "lineitem", {"number": "l_linenumber"}, {"total": ("SUM", "l_quantity"), "keys": ("SUM", "l_suppkey")}, "SELECT l_linenumber AS number, sum(l_quantity) AS total, CAST(sum(l_suppkey) AS DOUBLE) AS keys FROM lineitem GROUP BY 1")
_group("group_avg_num", "lineitem", {"flag": "l_returnflag"}, {"mean": ("AVG", "l_quantity")}, "SELECT l_returnflag AS flag, avg(l_quantity) AS mean FROM lineitem GROUP BY 1")
_group("group_min_num", "orders", {"status": "o_orderstatus"}, {"least": ("MIN", "o_totalprice"), "key": ("MIN", "o_custkey")}, "SELECT o_orderstatus AS status, min(o_totalprice) AS least, CAST(min(o_custkey) AS DOUBLE) AS key FROM orders GROUP BY 1")
_group("group_max_num", "orders", {"status": "o_orderstatus"}, {"most": ("MAX", "o_totalprice"), "key": ("MAX", "o_custkey")}, "SELECT o_orderstatus AS status, max(o_totalprice) AS most, CAST(max(o_custkey) AS DOUBLE) AS key FROM orders GROUP BY 1")
_group("group_min_string", "part", {"brand": "p_brand"}, {"least": ("MIN", "p_name")}, "SELECT p_brand AS brand, min(p_name) AS least FROM part GROUP BY 1")
_group("group_max_string", "part", {"brand": "p_brand"}, {"most": ("MAX", "p_name")}, "SELECT p_brand AS brand, max(p_name) AS most FROM part GROUP BY 1")
_group("group_min_time", "events", {"event_type": "event_type"}, {"least": ("MIN", "@timestamp")}, "SELECT event_type, CAST(epoch_ns(min(ts)) AS DOUBLE) AS least FROM events GROUP BY 1")
_group("group_max_time", "events", {"event_type": "event_type"}, {"most": ("MAX", "ts")}, "SELECT event_type, CAST(epoch_ns(max(ts)) AS DOUBLE) AS most FROM events GROUP BY 1")
_group("group_sum_time", "events", {"event_type": "event_type"}, {"total": ("SUM", "@timestamp")}, "SELECT event_type, CAST(sum(epoch_ns(ts)) AS DOUBLE) AS total FROM events GROUP BY 1")
_group("group_avg_time", "orders", {"status": "o_orderstatus"}, {"mean": ("AVG", "o_orderdate")}, "SELECT o_orderstatus AS status, CAST(sum(epoch_ns(o_orderdate)) AS DOUBLE) / count(*) AS mean FROM orders GROUP BY 1")
_group("group_several", "orders", {"priority": "o_orderpriority"}, {"n": ("COUNT", None), "least": ("MIN", "o_orderkey"), "most": ("MAX", "o_orderstatus")}, "SELECT o_orderpriority AS priority, CAST(count(*) AS DOUBLE) AS n, CAST(min(o_orderkey) AS DOUBLE) AS least, max(o_orderstatus) AS most FROM orders GROUP BY 1")
_group("group_filtered", "events", {"user": "user_id"}, {"n": ("COUNT", None)}, "SELECT user_id AS user, CAST(count(*) AS DOUBLE) AS n FROM events WHERE event_type <> 'view' AND value >= 20 GROUP BY 1", filters=[_where(("event_type", "!=", "view"), ("value", ">=", 20))])
_group("group_order_by_calc_desc", "orders", {"customer": "o_custkey"}, {"n": ("COUNT", None)}, "SELECT o_custkey AS customer, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1 ORDER BY n DESC, customer LIMIT 25", 25, order_by=[{"op": "COUNT", "order": "descending"}, {"field": "o_custkey"}])
_group("group_order_key_then_calc", "lineitem", {"flag": "l_returnflag", "number": "l_linenumber"}, {"least": ("MIN", "l_orderkey")}, "SELECT l_returnflag AS flag, l_linenumber AS number, CAST(min(l_orderkey) AS DOUBLE) AS least FROM lineitem GROUP BY 1, 2 ORDER BY flag DESC, least, number LIMIT 8", 8, order_by=[{"field": "l_returnflag", "order": "descending"}, {"op": "MIN", "field": "l_orderkey"}, {"field": "l_linenumber"}])
_group("group_default_limit", "orders", {"customer": "o_custkey"}, {"most": ("MAX", "o_orderkey")}, "SELECT o_custkey AS customer, CAST(max(o_orderkey) AS DOUBLE) AS most FROM orders GROUP BY 1 ORDER BY most DESC LIMIT 10", None, order_by=[{"op": "MAX", "field": "o_orderkey", "order": "descending"}])
_group("group_calc_presence", "states", {"event_type": "event_type"}, {"n": ("COUNT", None), "most": ("MAX", "s.k")}, "SELECT event_type, CAST(count(*) AS DOUBLE) AS n, max(CASE WHEN event_id % 6 = 3 THEN 2.5 ELSE CAST(props->>'$.k' AS DOUBLE) END) AS most FROM events WHERE event_id % 6 IN (3, 5) GROUP BY 1", filters=[_where(("s.k", "!=", -1))])
_group("group_null_key", "states", {"k": "s.k"}, {"n": ("COUNT", None)}, "SELECT CAST(NULL AS VARCHAR) AS k, CAST(count(*) AS DOUBLE) AS n FROM events WHERE event_id % 6 = 1 HAVING count(*) > 0", filters=[_where(("s.k", "isNull"))])
_group("group_missing_key", "states", {"k": "s.k"}, {"n": ("COUNT", None)}, "SELECT CAST(NULL AS VARCHAR) AS k, CAST(0 AS DOUBLE) AS n FROM events WHERE false", filters=[_where(("s.k", "notExists"))])
_group("group_json_path", "events", {"k": "props.k"}, {"n": ("COUNT", None)}, "SELECT CAST(props->>'$.k' AS BIGINT) AS k, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1")
_group("group_sum_of_none", "events", {"event_type": "event_type"}, {"n": ("COUNT", None), "total": ("SUM", "event_type"), "ids": ("MIN", "event_id")}, "SELECT event_type, CAST(count(*) AS DOUBLE) AS n, CAST(0 AS DOUBLE) AS total, CAST(min(event_id) AS DOUBLE) AS ids FROM events GROUP BY 1")

# buckets


def _bucket(name: str, query: dict, start: int, end: int, step: int, where: str = "true", table: str = "events", time: str = "ts") -> None:
    """start, end: of the buckets, seconds; step in seconds."""
    sql = f"""
    WITH rows AS (SELECT (epoch_ns({time}) - {start}000000000) // {step}000000000 AS b FROM {table} WHERE {where}),
         counts AS (SELECT b, count(*) AS n FROM rows GROUP BY b)
    SELECT CAST(({start} + i * {step}) * 1000000000 AS BIGINT) AS start_at_nanos, CAST(coalesce(n, 0) AS BIGINT) AS value
    FROM generate_series(0, {(end - start) // step - 1}) AS g(i) LEFT JOIN counts ON b = i
    WHERE EXISTS (SELECT 1 FROM counts)"""
    _add(name, {"namespace": table} | query, _same("start_at_nanos", "value"), sql)


_JAN = {"start_time": 1704067200, "end_time": 1706745600}
_IN = "ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts < TIMESTAMP '2024-02-01 00:00:00'"
_bucket("bucket_hour", _JAN | {"time_granularity": "1h"}, 1704067200, 1706745600, 3600, _IN)
_bucket("bucket_filtered", _JAN | {"time_granularity": "6h", "filters": [_where(("event_type", "=", "purchase"), ("value", ">", 60))]}, 1704067200, 1706745600, 21600, f"{_IN} AND event_type = 'purchase' AND value > 60")
_bucket("bucket_zero_fill", {"start_time": 1704067200, "end_time": 1709251200, "time_granularity": "24h"}, 1704067200, 1709251200, 86400, "ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts < TIMESTAMP '2024-03-01 00:00:00'")
_bucket("bucket_unaligned_start", {"start_time": 1704070000, "end_time": 1704420001, "time_granularity": "35m"}, 1704070000 // 2100 * 2100, -(-1704420001 // 2100) * 2100, 2100, "epoch_ns(ts) >= 1704070000000000000 AND epoch_ns(ts) < 1704420001000000000")
_bucket("bucket_orders", {"start_time": 788918400, "end_time": 820454400, "time_granularity": "720h"}, 788918400 // 2592000 * 2592000, -(-820454400 // 2592000) * 2592000, 2592000, "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'", "orders", "o_orderdate")
_bucket("bucket_empty", _JAN | {"time_granularity": "24h", "filters": [_where(("event_type", "=", "none"))]}, 1704067200, 1706745600, 86400, "false")

# a store of documents

_STORES: dict[tuple[str, str], Database] = {}


def stored(spark: SparkSession, sf_dir: str) -> Database:
    """The events as JSON documents in a store, written once a session: half of them before user.id is promoted, and the rest after."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        # a few bytes a row that become documents: dealt out first, as a file's row groups may be fewer than the cores
        tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        events = spark.read.parquet(f"{sf_dir}/events.parquet").repartition(tasks, "event_id")
        at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        fields = [F.lit("events").alias("service"), at.alias("@timestamp"), F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("id")).alias("user"), F.col("event_type").alias("kind"), "value", F.parse_json("props").alias("props"), F.struct(F.struct(F.lit(1).alias("y")).alias("x")).alias("deep"), F.col("event_id").alias("id_noindex")]
        lines = events.select("event_id", F.to_json(F.struct(*fields)).alias("value"))
        root = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
        Database(spark, root, promote=["kind"]).write_batch(lines.where("event_id % 2 = 0").select("value"))
        made = Database(spark, root, promote=["kind", "user.id"], max_depth=2, excluded="_noindex")
        made.write_batch(lines.where("event_id % 2 = 1").select("value"))
        _STORES[key] = made
    return _STORES[key]


def _stored(name: str, query: dict, columns: dict[str, str], oracle: str) -> None:
    """A query of the store. A raw one returns event_id, read from its documents."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = spec.parse({"namespace": "events"} | (ALL if "start_time" not in query else {}) | query)
        db = stored(spark, sf_dir)
        got = answer(replace(q, limit=None) if "limit" not in query and q.kind != "buckets" else q, db.binding("events"))
        if q.kind == "raw":
            return got.select(F.get_json_object("_source", "$.id").cast("long").alias("event_id"))
        return got.select(*(F.col(a).alias(b) for a, b in columns.items()))

    QUERIES[name], ORACLES[name] = run, oracle


_stored("store_raw_ordered", {"order_by": _order("-@timestamp", "id"), "limit": 30}, {}, "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 30")
_stored("store_filter_promoted", {"filters": [_where(("kind", "startsWith", "p"))]}, {}, "SELECT event_id FROM events WHERE starts_with(event_type, 'p')")
_stored("store_filter_promoted_late", {"filters": [_where(("user.id", "<=", 20), ("value", ">", 30.5))]}, {}, "SELECT event_id FROM events WHERE user_id <= 20 AND value > 30.5")
_stored("store_filter_nested", {"filters": [_where(("props.k", "=", 42), ("props.k", ">", 90), combinator="OR")]}, {}, "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS BIGINT) = 42 OR CAST(props->>'$.k' AS BIGINT) > 90")
_stored("store_depth_and_suffix", {"filters": [_where(("deep.x.y", "notExists"), ("id_noindex", "notExists"), ("id", "<", 50))]}, {}, "SELECT event_id FROM events WHERE event_id < 50")
_stored("store_time", {"start_time": 1704412800, "time_range": "36h"}, {}, "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-06 12:00:00'")
_stored("store_group", {"group_by": ["kind", "user.id"], "calculations": [{"op": "COUNT"}, {"op": "MAX", "field": "value"}, {"op": "MIN", "field": "@timestamp"}]}, {"key_0": "kind", "key_1": "user", "value_0": "n", "value_1": "most", "value_2": "first"}, "SELECT event_type AS kind, user_id AS user, CAST(count(*) AS DOUBLE) AS n, max(value) AS most, CAST(epoch_ns(min(ts)) AS DOUBLE) AS first FROM events GROUP BY 1, 2")
_stored("store_group_top", {"group_by": ["user.id"], "calculations": [{"op": "COUNT"}], "order_by": [{"op": "COUNT", "order": "descending"}, {"field": "user.id"}], "limit": 7}, {"key_0": "user", "value_0": "n"}, "SELECT user_id AS user, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1 ORDER BY n DESC, user LIMIT 7")
_stored("store_buckets", _JAN | {"time_granularity": "12h", "filters": [_where(("kind", "!=", "view"))]}, {"start_at_nanos": "start_at_nanos", "value": "value"}, f"""
    WITH counts AS (SELECT (epoch_ns(ts) - 1704067200000000000) // 43200000000000 AS b, count(*) AS n FROM events WHERE {_IN} AND event_type <> 'view' GROUP BY b)
    SELECT CAST((1704067200 + i * 43200) * 1000000000 AS BIGINT) AS start_at_nanos, CAST(coalesce(n, 0) AS BIGINT) AS value FROM generate_series(0, 61) AS g(i) LEFT JOIN counts ON b = i""")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and kinds that the documents of the store have."""
    return discover(stored(spark, sf_dir).binding("events").df)


QUERIES["store_paths"] = _paths
ORACLES["store_paths"] = """
    SELECT path, kind, count(*) AS n FROM (
        SELECT unnest([{'path': 'service', 'kind': 'string'}, {'path': '@timestamp', 'kind': 'string'}, {'path': 'id', 'kind': 'int'}, {'path': 'user.id', 'kind': 'int'}, {'path': 'kind', 'kind': 'string'},
                       {'path': 'value', 'kind': CASE WHEN value = floor(value) THEN 'int' ELSE 'double' END}, {'path': 'props.k', 'kind': 'int'}, {'path': 'deep.x.y', 'kind': 'int'}, {'path': 'id_noindex', 'kind': 'int'}], recursive := true)
        FROM events) GROUP BY 1, 2"""

_group(
    "flagship",
    "events",
    {"user": "user_id", "event_type": "event_type"},
    {"n": ("COUNT", None), "most": ("MAX", "value"), "last": ("MAX", "@timestamp")},
    "SELECT user_id AS user, event_type, CAST(count(*) AS DOUBLE) AS n, max(value) AS most, CAST(epoch_ns(max(ts)) AS DOUBLE) AS last FROM events "
    f"WHERE {_IN} AND event_type <> 'error' AND (value >= 10 OR starts_with(event_type, 'pur')) GROUP BY 1, 2 ORDER BY n DESC, user, event_type LIMIT 100",
    100,
    **_JAN,
    filters=[_where(("event_type", "!=", "error")), _where(("value", ">=", 10), ("event_type", "startsWith", "pur"), combinator="OR")],
    order_by=[{"op": "COUNT", "order": "descending"}, {"field": "user_id"}, {"field": "event_type"}],
)
flagship = QUERIES["flagship"]
