"""The catalog of a temporal property graph: a typed DataFrame for each label and relationship type."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FROM, TO = "valid_from", "valid_to"


@dataclass(frozen=True)
class NodeTable:
    """Versions of the nodes of one kind. key: the column of ids; labels: all labels of these nodes, the table's own
    first. Columns valid_from and valid_to (timestamp_ntz, UTC, closed and open end) are optional: without them, nodes
    are always valid. Every other column is a property."""

    df: DataFrame
    key: str
    labels: tuple[str, ...]

    @property
    def label(self) -> str:
        return self.labels[0]

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema if f.name not in (FROM, TO)}

    @property
    def versioned(self) -> bool:
        return FROM in self.df.columns


@dataclass(frozen=True)
class RelTable:
    """Versions of the relationships of one type between two kinds of nodes; src and dst name the columns of their
    ids, and key, if there is one, that of the relationship's own."""

    df: DataFrame
    type: str
    source: str
    target: str
    src: str = "src"
    dst: str = "dst"
    key: str | None = None

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema if f.name not in (FROM, TO, self.src, self.dst)}

    @property
    def versioned(self) -> bool:
        return FROM in self.df.columns


@dataclass(frozen=True)
class EmbeddingTable:
    """Versions of vectors of the nodes with a label: node_id, vector, valid_from, valid_to and, if kept, model and
    property_snapshot. seq breaks ties of valid_from."""

    df: DataFrame
    label: str


@dataclass
class Catalog:
    """What a graph consists of. Tables are immutable; a mutation puts a new one in an old one's place."""

    spark: SparkSession
    nodes: list[NodeTable] = field(default_factory=list)
    rels: list[RelTable] = field(default_factory=list)
    embeddings: dict[str, EmbeddingTable] = field(default_factory=dict)

    def copy(self) -> Catalog:
        return Catalog(self.spark, list(self.nodes), list(self.rels), dict(self.embeddings))

    def labelled(self, labels: tuple[str, ...]) -> list[NodeTable]:
        """Tables whose nodes have all the labels; all tables for none."""
        return [t for t in self.nodes if set(labels) <= set(t.labels)]

    def node(self, label: str) -> NodeTable | None:
        return next((t for t in self.nodes if t.label == label), None)

    def put_node(self, table: NodeTable) -> None:
        self.nodes = [t for t in self.nodes if t.label != table.label] + [table]

    def put_rel(self, table: RelTable, old: RelTable | None = None) -> None:
        self.rels = [t for t in self.rels if t is not old] + [table]


Time = datetime.datetime | str | None


def literal_time(t: datetime.datetime) -> Column:
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def valid(df: DataFrame, at: Time) -> DataFrame:
    """Versions valid at a time: None is now (no end yet), "all" every version. Intervals are closed below, open above."""
    if FROM not in df.columns or at == "all":
        return df
    if at is None:
        return df.where(F.col(TO).isNull())
    t = literal_time(at)
    return df.where((F.col(FROM) <= t) & (F.col(TO).isNull() | (t < F.col(TO))))


def with_validity(table: NodeTable | RelTable) -> NodeTable | RelTable:
    """The table with columns for validity, all valid since 1970 if it had none."""
    if table.versioned:
        return table
    since = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return replace(table, df=table.df.withColumns({FROM: since, TO: F.lit(None).cast("timestamp_ntz")}))
