"""URL filtering by a sort-merge range join.

A host becomes its labels in reverse order, each closed by a separator, so that a rule's host and
all its subdomains are one interval of keys. Both sides sorted, one sweep over the urls keeps the
stack of rule hosts whose intervals are open; intervals of hosts nest or are disjoint, so the
stack is the chain of rule hosts that the url's host lies in. Each of those holds its paths sorted,
again intervals that nest, in which the longest prefix is found by a search and parent links.

A table of up to ``RUN`` rules is broadcast: the urls are sorted within their partitions and not
exchanged, so a hot host costs nothing. A larger one is joined by ranges: the keys of urls are cut at
quantiles, and a rule goes to every range that its interval meets. Rules are open at a cut only if
they enclose it, so copies are few; each range is swept with a stack of the rules that are open, and
no table of rules is ever held whole. Urls are cut by host, path and row, so a hot host, and even a
url that repeats, is dealt to many ranges.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, extended, materialize, table, texts_of

#: Rules that are broadcast, at most; urls that the cuts are taken from, about.
RUN, CUTS_FROM = 200_000, 20_000
#: Verdict where no rule fits.
DEFAULT = "allow"
#: The fixed rules (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Closes a label in a key; sorts before all characters of hosts.
CLOSE = "\x01"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty for null or without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def key_of(host: str) -> str:
    """Canonical key: labels in reverse order, each closed, so that a host's key begins those of its subdomains. Labels that hold what closes them are escaped."""
    return "".join(label.replace("\x02", "\x02\x03").replace(CLOSE, "\x02\x02") + CLOSE for label in reversed(host.split(".")))


def key_column(host: Column) -> Column:
    """The same of a column."""
    plain = F.replace(F.replace(host, F.lit("\x02"), F.lit("\x02\x03")), F.lit(CLOSE), F.lit("\x02\x02"))
    return F.concat(F.concat_ws(CLOSE, F.reverse(F.split(plain, r"\."))), F.lit(CLOSE))


class Rules:
    """A run of rules as nested intervals, for a sweep in key order."""

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        paths: dict[str, dict[str, tuple[str, str]]] = {}
        for host, path, verdict in rules:
            # of rules that are written alike, block stands
            own = paths.setdefault(key_of(host), {})
            if own.get(path, ("", ""))[1] != "block":
                own[path] = (host + path, verdict)
        self.keys = sorted(paths)
        self.paths = [sorted(paths[k]) for k in self.keys]
        self.told = [[paths[k][p] for p in ps] for k, ps in zip(self.keys, self.paths, strict=True)]
        self.parent = [self._parents(ps) for ps in self.paths]

    @staticmethod
    def _parents(paths: list[str]) -> list[int]:
        out: list[int] = []
        stack: list[int] = []
        for i, p in enumerate(paths):
            while stack and not p.startswith(paths[stack[-1]]):
                stack.pop()
            out.append(stack[-1] if stack else -1)
            stack.append(i)
        return out

    def longest(self, at: int, path: str) -> tuple[str, str] | None:
        """The rule of one host with the longest prefix of path."""
        paths = self.paths[at]
        i = bisect_right(paths, path) - 1
        while i >= 0 and not path.startswith(paths[i]):
            i = self.parent[at][i]
        return self.told[at][i] if i >= 0 else None

    def sweep(self, urls: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str] | None]:
        """The longest rule for each (key, path), keys ascending."""
        keys, stack, ahead, first = self.keys, [], 0, True
        for key, path in urls:
            if first:  # start of the sweep: open what encloses the first key
                first, ahead = False, bisect_right(keys, key)
                prefix = ""
                for label in key.split(CLOSE)[:-1]:
                    prefix += label + CLOSE
                    i = bisect_right(keys, prefix) - 1
                    if i >= 0 and keys[i] == prefix:
                        stack.append(i)
            while ahead < len(keys) and keys[ahead] <= key:
                while stack and not keys[ahead].startswith(keys[stack[-1]]):
                    stack.pop()
                stack.append(ahead)
                ahead += 1
            while stack and not key.startswith(keys[stack[-1]]):
                stack.pop()
            best = None
            for i in reversed(stack):
                found = self.longest(i, path)
                # longer wins; of equally long ones the longer host, which comes first here
                if found and (best is None or len(found[0]) > len(best[0])):
                    best = found
            yield best


def _sweep(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """urls (page_id, host, path) with rule and ruled, the verdict of the longest rule."""
    sent = urls.sparkSession.sparkContext.broadcast(rules)
    schema = extended(urls.schema, rule="string", ruled="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque[pa.RecordBatch] = deque()

        def keys() -> Iterator[tuple[str, str]]:
            for batch in batches:
                if len(batch):
                    held.append(batch)
                yield from zip(texts_of(batch, "key"), texts_of(batch, "path"), strict=True)

        found = Rules(sent.value).sweep(keys())  # one sweep over all of a partition, in the order of keys
        for first in found:
            batch = held.popleft()
            told = [first, *islice(found, len(batch) - 1)]
            rule, verdict = ([x and x[j] for x in told] for j in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], schema.names)

    return urls.withColumn("key", key_column(F.col("host"))).sortWithinPartitions("key").mapInArrow(run, schema)


def _range_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for a table of rules (host, path, verdict) of any size."""
    spark = urls.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.concat("key", "path", F.lit("\x00"), F.hex(F.xxhash64("page_id", "host", "path")), F.hex(F.xxhash64(F.monotonically_increasing_id())))
    keyed = materialize(urls.withColumn("key", key_column(F.col("host"))).withColumn("place", place), "urls")
    every = max(1, keyed.count() // CUTS_FROM)
    some = sorted(r["place"] for r in keyed.where(F.pmod(F.xxhash64("place"), F.lit(every)) == 0).select("place").collect())
    cuts = [some[len(some) * i // n] for i in range(1, n)] if some else []
    schema = extended(urls.schema, rule="string", ruled="string")
    width = len(urls.columns)
    kinds = extended(urls.schema, key="string", verdict="string", part="integer")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = [bisect_right(cuts, x) for x in texts_of(b, "place")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.nulls(len(b), pa.string()), pa.array(part, pa.int32())], kinds.names)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [(bisect_right(cuts, k), bisect_right(cuts, k + "\U0010ffff")) for k in texts_of(b, "key")]
            which = pa.array([i for i, (lo, hi) in enumerate(spans) for _ in range(lo, hi + 1)], pa.int64())
            part = pa.array([p for lo, hi in spans for p in range(lo, hi + 1)], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.take(which).columns, part], kinds.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, list, list[Rules]]] = []  # key, rules of the host, and these made ready for search
        for b in batches:
            keep, told = [], []
            rows = zip(*(texts_of(b, c) for c in ("key", "host", "path", "verdict")), strict=True)
            for i, (key, host, path, verdict) in enumerate(rows):
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if verdict is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, [], []))
                    stack[-1][1].append((host, path, verdict))
                    continue
                best = None
                for _, own, ready in reversed(stack):
                    if not ready:
                        ready.append(Rules(own))
                    found = ready[0].longest(0, path)
                    if found and (best is None or len(found[0]) > len(best[0])):
                        best = found
                keep.append(i)
                told.append(best)
            if keep:
                rule, verdict = ([x and x[j] for x in told] for j in (0, 1))
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(keep)).columns[:width], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], schema.names)

    as_urls = rules.select(F.lit(None).cast(urls.schema["page_id"].dataType).alias("page_id"), "host", "path", key_column(F.col("host")).alias("key"), "verdict")
    both = keyed.mapInArrow(deal, kinds).union(as_urls.mapInArrow(copy, kinds))
    # of one key the rules come before the urls
    return both.repartitionById(n, "part").sortWithinPartitions("key", F.col("verdict").isNull()).mapInArrow(run, schema)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url).

    rules: (host, path, verdict), hosts in lower case; rules with a null are left out. A rule
    fits its host and all subdomains if the path starts with the rule's; the longest rule, as host
    and path written together, wins, and of equally long ones that of the longer host. A url that no
    rule fits, a null one too, gets a null rule and the default. Repeated rows come out repeated.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    if isinstance(rules, list) and len(rules) > RUN:
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    if isinstance(rules, DataFrame):
        rules = rules.select("host", "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        if rules.count() <= RUN:
            rules = [tuple(r) for r in rules.collect()]
    found = _sweep(urls, rules) if isinstance(rules, list) else _range_join(urls, rules)
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge(table(spark, sf_dir, "pages"), RULES)


_HOST = "regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')"
_FITS = [f"(translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = '{h}' OR ends_with(translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.{h}')) AND starts_with(regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's'), '{p}')" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
_CASE = " ".join(f"WHEN {fit} THEN '{{{i}}}'" for i, fit in enumerate(_FITS))
_LONGEST = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
ORACLE = f"""
SELECT page_id,
       translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
       CASE {_CASE.format(*(h + p for h, p, _ in _LONGEST))} END AS rule,
       CASE {_CASE.format(*(v for *_, v in _LONGEST))} ELSE '{DEFAULT}' END AS verdict
FROM pages
"""
