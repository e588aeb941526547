"""What a query text is parsed into: expressions, patterns and clauses."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    """Base of all expressions."""


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    of: Expr
    name: str


@dataclass(frozen=True)
class Op(Expr):
    """A binary operator, by its upper-case symbol."""

    symbol: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not(Expr):
    of: Expr


@dataclass(frozen=True)
class Neg(Expr):
    of: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    of: Expr
    negated: bool


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapOf(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Index(Expr):
    of: Expr
    at: Expr


@dataclass(frozen=True)
class Slice(Expr):
    of: Expr
    low: Expr | None
    high: Expr | None


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    default: Expr | None


@dataclass(frozen=True)
class Quantified(Expr):
    kind: str
    var: str
    over: Expr
    where: Expr


@dataclass(frozen=True)
class Comprehension(Expr):
    var: str
    over: Expr
    where: Expr | None
    value: Expr


@dataclass(frozen=True)
class PatternValue(Expr):
    """A pattern comprehension, or with value None an existential pattern."""

    part: Part
    where: Expr | None
    value: Expr | None


@dataclass(frozen=True)
class Similar(Expr):
    var: Expr
    query: Expr
    threshold: Expr | None


@dataclass(frozen=True)
class NodeP:
    var: str | None
    labels: tuple[str, ...]
    props: tuple[tuple[str, Expr], ...] = ()


@dataclass(frozen=True)
class RelP:
    var: str | None
    types: tuple[str, ...]
    direction: str  # "out", "in" or "both"
    hops: tuple[int | None, int | None] | None = None
    props: tuple[tuple[str, Expr], ...] = ()


@dataclass(frozen=True)
class Part:
    """A path: nodes and the relationships between them; function: shortestPath and its like."""

    nodes: tuple[NodeP, ...]
    rels: tuple[RelP, ...]
    var: str | None = None
    function: str | None = None


@dataclass
class Clause:
    kind: str
    fields: dict[str, Any] = field(default_factory=dict)

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["fields"][name]
        except KeyError:
            raise AttributeError(name) from None


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None
    text: str


@dataclass
class Query:
    """Branches of clauses, joined by UNION; all_flags[i] tells whether UNION ALL stands before branch i + 1."""

    branches: list[list[Clause]]
    all_flags: list[bool]
