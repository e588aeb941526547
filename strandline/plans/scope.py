"""What the variables of a query stand for, and where their columns are."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.typed import STRING, Typed, null


def at(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class NodeVar:
    """A node: columns "v.__id", "v.__labels", "v.__from", "v.__to" and "v.<property>"."""

    name: str
    labels: tuple[str, ...]  # the tables it may come from
    id_kind: T.DataType
    props: dict[str, T.DataType]
    versioned: bool

    def columns(self) -> list[str]:
        own = ["__id", "__labels", *(["__from", "__to"] if self.versioned else []), *self.props]
        return [f"{self.name}.{p}" for p in own]

    def identity(self) -> Column:
        return at(f"{self.name}.__id")


@dataclass(frozen=True)
class RelVar:
    """A relationship: columns "r.__type", "r.__src", "r.__dst", "r.__from", "r.__to" and "r.<property>"."""

    name: str
    id_kinds: tuple[T.DataType, T.DataType]
    props: dict[str, T.DataType]
    versioned: bool
    key: str | None = None

    def columns(self) -> list[str]:
        own = ["__type", "__src", "__dst", *(["__from", "__to"] if self.versioned else []), *self.props]
        return [f"{self.name}.{p}" for p in own]

    def identity(self) -> Column:
        own = at(f"{self.name}.{self.key}") if self.key and self.key in self.props else F.lit(None).cast("string")
        since = at(f"{self.name}.__from") if self.versioned else F.lit(None).cast("timestamp_ntz")
        return F.struct(at(f"{self.name}.__type").alias("type"), at(f"{self.name}.__src").alias("src"), at(f"{self.name}.__dst").alias("dst"), own.alias("key"), since.alias("since"))


@dataclass(frozen=True)
class ValueVar:
    """A value in the column of its name."""

    name: str
    kind: T.DataType | None
    column: Column | None = None  # of a list's element, inside a lambda

    def columns(self) -> list[str]:
        return [self.name]


Binding = NodeVar | RelVar | ValueVar


@dataclass
class Frame:
    """Rows of bindings; df None is the one empty row that a query starts from."""

    df: DataFrame | None = None
    scope: dict[str, Binding] = field(default_factory=dict)


def entity(b: NodeVar | RelVar) -> Typed:
    """A node as (id, labels, properties), a relationship as (type, src, dst, properties)."""
    props = F.struct(*(at(f"{b.name}.{p}").alias(p) for p in b.props)) if b.props else F.lit(None).cast("string")
    if isinstance(b, NodeVar):
        missing = b.identity().isNull()
        s = F.struct(b.identity().alias("id"), at(f"{b.name}.__labels").alias("labels"), props.alias("properties"))
    else:
        missing = at(f"{b.name}.__src").isNull()
        s = F.struct(*(at(f"{b.name}.__{x}").alias(x) for x in ("type", "src", "dst")), props.alias("properties"))
    return Typed(F.when(~missing, s))


def prop(b: Binding, name: str) -> Typed:
    if isinstance(b, ValueVar):
        if isinstance(b.kind, T.StructType) and name in b.kind.names:
            return Typed((b.column if b.column is not None else at(b.name))[name], b.kind[name].dataType)
        return null()
    if name in b.props:
        return Typed(at(f"{b.name}.{name}"), b.props[name])
    return null()


def introspect(f: str, b: NodeVar | RelVar) -> Typed | None:
    """The functions that look at an entity as a whole."""
    if f in ("id", "elementid"):
        return Typed(b.identity() if isinstance(b, NodeVar) else (at(f"{b.name}.{b.key}") if b.key in b.props else F.lit(None).cast("string")), b.id_kind if isinstance(b, NodeVar) else b.props.get(b.key or ""))
    if f == "labels":
        return Typed(at(f"{b.name}.__labels"), T.ArrayType(STRING)) if isinstance(b, NodeVar) else null()
    if f == "type":
        return Typed(at(f"{b.name}.__type"), STRING) if isinstance(b, RelVar) else null()
    if f == "keys":
        names = [F.when(at(f"{b.name}.{p}").isNotNull(), F.lit(p)) for p in sorted(b.props)]
        return Typed(F.array_compact(F.array(*names)) if names else F.array().cast("array<string>"), T.ArrayType(STRING))
    if f == "properties":
        return Typed(F.struct(*(at(f"{b.name}.{p}").alias(p) for p in b.props)), T.StructType([T.StructField(p, k) for p, k in b.props.items()])) if b.props else null()
    if f in ("startnode", "endnode") and isinstance(b, RelVar):
        k = 0 if f == "startnode" else 1
        return Typed(at(f"{b.name}.{('__src', '__dst')[k]}"), b.id_kinds[k])
    return None
