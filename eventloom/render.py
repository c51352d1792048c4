"""Results as JSON text. Results are small: limits bound rows and groups, and granularity bounds buckets."""

from __future__ import annotations

import base64
import json
import math
from typing import Any

from pyspark.sql import DataFrame

from eventloom.plans.spec import Query


def _plain(x: Any) -> Any:
    if isinstance(x, float):
        return None if math.isnan(x) else int(x) if x.is_integer() and abs(x) < 2**63 else x
    return x


def _dumps(x: Any) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def raw(documents: list[str]) -> str:
    """{"raw": [base64, ...]}; null instead of an empty list."""
    return _dumps({"raw": [base64.b64encode(d.encode()).decode() for d in documents] or None})


def groups(rows: list[tuple[list, list]]) -> str:
    """{"groups": [{"key": ..., "values": [...]}, ...]}; a single key stands alone, and no groups are {}."""
    if not rows:
        return "{}"
    return _dumps({"groups": [{"key": _plain(k[0]) if len(k) == 1 else [_plain(x) for x in k], "values": [_plain(x) for x in v]} for k, v in rows]})


def buckets(granularity: int, rows: list[tuple[int, int]]) -> str:
    return _dumps({"granularity": granularity, "buckets": [{"startAtNanos": s, "value": v} for s, v in rows]})


def render(query: Query, result: DataFrame) -> str:
    rows = result.collect()
    if query.kind == "raw":
        return raw([r["_source"] if "_source" in result.columns else _dumps(r.asDict(True)) for r in rows])
    if query.kind == "grouped":
        n = len(query.group_by)
        return groups([(list(r)[:n], list(r)[n:]) for r in rows])
    return buckets(query.granularity, [tuple(r) for r in rows])
