"""The engine's front: namespaces that documents are written to and queries are asked of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from eventloom import render
from eventloom.plans import spec
from eventloom.plans.queries import answer
from eventloom.sources import store
from eventloom.sources.bindings import Binding
from eventloom.sources.documents import assemble, from_fields, read_lines


class Database:
    """Namespaces by name: tables bound by hand, and those of a store below root."""

    def __init__(self, spark: SparkSession, root: str | None = None, bindings: dict[str, Binding] | None = None, promote: Sequence[str] = (), strict: bool = False, **options) -> None:
        """promote, options: passed on to the store and its bindings (max_depth, excluded, retention). strict: see ``plans.queries.answer``."""
        self.spark, self.root, self.bindings, self.promote, self.strict, self.options = spark, root, dict(bindings or {}), promote, strict, options

    def bind(self, namespace: str, binding: Binding) -> None:
        self.bindings[namespace] = binding

    def health(self) -> bool:
        return not self.spark.sparkContext._jsc.sc().isStopped()

    def write_batch(self, documents: list[str] | str | DataFrame, **options) -> None:
        """Append documents: JSON texts, newline-delimited JSON in one string, or a DataFrame of lines (value)."""
        if isinstance(documents, str):
            documents = documents.removesuffix("\n").split("\n")
        if not isinstance(documents, DataFrame):
            documents = self.spark.createDataFrame([(d,) for d in documents], "value string")
        store.write(assemble(documents, **options), self._root(), self.promote)

    def write_fields(self, namespace: str, documents: list[dict]) -> None:
        """Append documents of flat fields, see ``sources.documents.from_fields``."""
        store.write(from_fields(self.spark, namespace, documents), self._root(), self.promote)

    def load(self, path: str | list[str], **options) -> None:
        """Append the documents of newline-delimited JSON files."""
        store.write(read_lines(self.spark, path, **options), self._root(), self.promote)

    def _root(self) -> str:
        if self.root is None:
            raise ValueError("the database has no store")
        return self.root

    def binding(self, namespace: str) -> Binding:
        if namespace in self.bindings:
            return self.bindings[namespace]
        if self.root is None:
            raise ValueError(f"no such namespace {namespace}")
        return store.bind(self.spark, self.root, namespace, self.promote, **self.options)

    def query(self, query: str | dict, now: int | None = None) -> DataFrame:
        """The answer to a query of any kind as a DataFrame."""
        q = spec.parse(query, now)
        return answer(q, self.binding(q.namespace), self.strict)

    def query_json(self, query: str | dict, now: int | None = None) -> str:
        """The answer as JSON text."""
        q = spec.parse(query, now)
        return render.render(q, answer(q, self.binding(q.namespace), self.strict))

    def _of_kind(self, kind: str, query: str | dict) -> DataFrame:
        q = spec.parse(query)
        if q.kind != kind:
            raise ValueError(f"not a {kind} query")
        return answer(q, self.binding(q.namespace), self.strict)

    def query_raw(self, query: str | dict) -> DataFrame:
        return self._of_kind("raw", query)

    def query_grouped(self, query: str | dict) -> DataFrame:
        return self._of_kind("grouped", query)

    def query_time_bucket(self, query: str | dict) -> DataFrame:
        return self._of_kind("buckets", query)
