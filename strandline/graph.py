"""The graph: queries in text over a catalog of tables, and the calls that stand for single mutations."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import temporal, vectors
from strandline.operators.mutations import Mutations
from strandline.plans.compiler import Compiler
from strandline.plans.expressions import QueryProblem
from strandline.plans.parser import parse
from strandline.sources.catalog import Catalog, EmbeddingTable, NodeTable, RelTable, Time, literal_time


class Graph:
    """A temporal property graph.

    clock: what "now" is in queries (by default the time of the query); embedder and model: how texts become vectors;
    versioned: whether property changes keep history.
    """

    def __init__(self, spark: SparkSession, *, clock: datetime.datetime | None = None, embedder: vectors.Embedder | None = None, model: str = "hashing", versioned: bool = True):
        self.catalog = Catalog(spark)
        self.clock, self.model = clock, model
        self.embedder = embedder or vectors.hashing_embedder()
        self.mutations = Mutations(self, versioned)

    # tables

    def add_nodes(self, df: DataFrame, label: str, key: str = "id", labels: tuple[str, ...] = ()) -> Graph:
        self.catalog.put_node(NodeTable(df, key, (label, *labels)))
        return self

    def add_rels(self, df: DataFrame, kind: str, source: str, target: str, src: str = "src", dst: str = "dst", key: str | None = None) -> Graph:
        self.catalog.put_rel(RelTable(df, kind, source, target, src, dst, key))
        return self

    def add_embeddings(self, df: DataFrame, label: str) -> Graph:
        self.catalog.embeddings[label] = EmbeddingTable(df, label)
        return self

    def now(self) -> Column:
        return literal_time(self.clock) if self.clock else F.localtimestamp()

    def embeddings_of(self, labels: tuple[str, ...]) -> DataFrame:
        for label in labels:
            if label in self.catalog.embeddings:
                return self.catalog.embeddings[label].df
        raise QueryProblem(f"no embeddings for {' or '.join(labels)}")

    def vector_of(self, query: Any) -> list[float]:
        return self.embedder([query])[0] if isinstance(query, str) else [float(x) for x in query]

    # queries

    def query(self, text: str, params: dict[str, Any] | None = None, **options: Any) -> DataFrame:
        """The result of a query. options: time (a datetime, or "all" versions), per_path (every walk of a
        variable-length pattern), self_loops_twice, undirected_paths (default True)."""
        return Compiler(self, params or {}, **options).query(parse(text))

    @staticmethod
    def validate(text: str) -> None:
        """Raise SyntaxProblem if the text is no query."""
        parse(text)

    @contextmanager
    def transaction(self) -> Iterator[Graph]:
        """A graph whose changes take this one's place at the end, or none if an exception leaves the block."""
        tx = Graph(self.catalog.spark, clock=self.clock, embedder=self.embedder, model=self.model, versioned=self.mutations.versioned)
        tx.catalog = self.catalog.copy()
        yield tx
        self.catalog = tx.catalog

    # single mutations

    def _when(self, at: datetime.datetime | None) -> dict[str, Any]:
        return {"time": at} if at is not None else {}

    def create_node(self, label: str, props: dict[str, Any], at: datetime.datetime | None = None) -> None:
        names = ", ".join(f"{k}: ${k}" for k in props)
        self.query(f"CREATE (n:{label} {{{names}}})", props, **self._when(at))

    def create_rel(self, kind: str, source: tuple[str, Any], target: tuple[str, Any], props: dict[str, Any] | None = None, at: datetime.datetime | None = None) -> None:
        a, b = (self.catalog.node(x[0]).key for x in (source, target))
        names = "{" + ", ".join(f"{k}: ${k}" for k in props or {}) + "}"
        self.query(f"MATCH (a:{source[0]} {{{a}: $__a}}), (b:{target[0]} {{{b}: $__b}}) CREATE (a)-[:{kind} {names}]->(b)", {**(props or {}), "__a": source[1], "__b": target[1]}, **self._when(at))

    def set_property(self, label: str, node_id: Any, name: str, value: Any) -> None:
        key = self.catalog.node(label).key
        self.query(f"MATCH (n:{label} {{{key}: $__id}}) SET n.{name} = $__v", {"__id": node_id, "__v": value})

    def remove_property(self, label: str, node_id: Any, name: str) -> None:
        key = self.catalog.node(label).key
        self.query(f"MATCH (n:{label} {{{key}: $__id}}) REMOVE n.{name}", {"__id": node_id})

    def delete_node(self, label: str, node_id: Any, cascade: bool = True) -> None:
        key = self.catalog.node(label).key
        self.query(f"MATCH (n:{label} {{{key}: $__id}}) {'DETACH ' if cascade else ''}DELETE n", {"__id": node_id})

    # views

    def snapshot(self, at: Time) -> Graph:
        """The graph as it was at a time, to be queried like any other."""
        from dataclasses import replace

        from strandline.sources.catalog import valid

        out = Graph(self.catalog.spark, clock=self.clock, embedder=self.embedder, model=self.model)
        drop = lambda df: valid(df, at).drop("valid_from", "valid_to")
        out.catalog.nodes = [replace(t, df=drop(t.df)) for t in self.catalog.nodes]
        out.catalog.rels = [replace(t, df=drop(t.df)) for t in self.catalog.rels]
        return out

    def timeline(self) -> DataFrame:
        return temporal.timeline(self.catalog)

    def stats(self) -> DataFrame:
        return temporal.stats(self.catalog)

    def versions(self, label: str, node_id: Any) -> DataFrame:
        return temporal.versions(self.catalog.node(label), node_id)

    def export(self, at: Time = None) -> DataFrame:
        return temporal.export(self.catalog, at)

    def path_exists(self, label: str, a: Any, b: Any) -> bool:
        """Whether there is a path between two nodes of a label; a node reaches itself."""
        key = self.catalog.node(label).key
        found = self.query(f"MATCH p = shortestPath((a:{label} {{{key}: $a}})-[*]-(b:{label} {{{key}: $b}})) RETURN length(p) AS n", {"a": a, "b": b})
        return a == b or found.limit(1).count() > 0
