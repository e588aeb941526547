"""Expressions to columns: three-valued logic, typed comparison, arithmetic in doubles."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import scalars
from strandline.functions.typed import BOOL, DOUBLE, LONG, STRING, Typed, common, element, items, null, number, text, to_common

from .nodes import Call, Case, Comprehension, Expr, Index, IsNull, ListOf, Lit, MapOf, Neg, Not, Op, Param, PatternValue, Prop, Quantified, Similar, Slice, Var
from .scope import Binding, NodeVar, RelVar, ValueVar, at, entity, introspect, prop

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}


class QueryProblem(ValueError):
    """A query that can be parsed but not run: an unknown variable, function or parameter, or clauses that don't go together."""


def has_aggregate(e: Any) -> bool:
    if isinstance(e, Call) and e.name in AGGREGATES:
        return True
    if isinstance(e, (Expr,)):
        return any(has_aggregate(v) for v in vars(e).values())
    if isinstance(e, (tuple, list)):
        return any(has_aggregate(v) for v in e)
    return False


def constant(e: Expr, params: dict[str, Any]) -> Any:
    """The Python value of an expression of literals and parameters."""
    if isinstance(e, Lit):
        return e.value
    if isinstance(e, Param):
        if e.name not in params:
            raise QueryProblem(f"no parameter ${e.name}")
        return params[e.name]
    if isinstance(e, Neg):
        return -constant(e.of, params)
    if isinstance(e, ListOf):
        return [constant(x, params) for x in e.items]
    if isinstance(e, MapOf):
        return {k: constant(v, params) for k, v in e.items}
    raise QueryProblem("a literal or parameter is needed here")


def literal(v: Any) -> Typed:
    if v is None:
        return null()
    if isinstance(v, bool):
        return Typed(F.lit(v), BOOL)
    if isinstance(v, int):
        return Typed(F.lit(v).cast("long"), LONG)
    if isinstance(v, float):
        return Typed(F.lit(v), DOUBLE)
    if isinstance(v, str):
        return Typed(F.lit(v), STRING)
    if isinstance(v, (list, tuple)):
        return list_of([literal(x) for x in v])
    if isinstance(v, dict):
        return map_of([(k, literal(x)) for k, x in v.items()])
    return Typed(F.lit(v))


def list_of(values: list[Typed]) -> Typed:
    if not values:
        return Typed(F.array().cast("array<string>"), T.ArrayType(STRING))
    columns, kind = to_common(values)
    return Typed(F.array(*columns), T.ArrayType(kind) if kind is not None else None)


def map_of(values: list[tuple[str, Typed]]) -> Typed:
    if not values:
        return null()
    kinds = [v.kind for _, v in values]
    kind = None if any(k is None for k in kinds) else T.StructType([T.StructField(n, v.kind) for n, v in values])
    return Typed(F.struct(*(v.col.alias(n) for n, v in values)), kind)


class Expressions:
    """Compiles expressions over a scope. replaced: expressions that stand in columns already (keys and aggregates)."""

    def __init__(self, scope: dict[str, Binding], params: dict[str, Any], now: Column, *, replaced: dict[Expr, Typed] | None = None, aggregate: Callable[[Call], Typed] | None = None, pattern: Callable[[PatternValue], Typed] | None = None, similar: Callable[[Similar], Typed] | None = None):
        self.scope, self.params, self.now = scope, params, now
        self.replaced, self.on_aggregate, self.on_pattern, self.on_similar = replaced or {}, aggregate, pattern, similar

    def within(self, name: str, value: Typed) -> Expressions:
        return Expressions({**self.scope, name: ValueVar(name, value.kind, value.col)}, self.params, self.now, replaced=self.replaced, aggregate=self.on_aggregate, pattern=self.on_pattern, similar=self.on_similar)

    def __call__(self, e: Expr) -> Typed:
        if self.replaced and e in self.replaced:
            return self.replaced[e]
        return getattr(self, f"_{type(e).__name__.lower()}")(e)

    def condition(self, e: Expr) -> Column:
        """A boolean column; null and what is no boolean don't hold."""
        t = self(e)
        if isinstance(t.kind, T.BooleanType) or t.kind is None:
            return t.col
        if t.is_null:
            return F.lit(None).cast("boolean")
        raise QueryProblem("a condition must be a boolean")

    def _binding(self, name: str) -> Binding:
        if name not in self.scope:
            raise QueryProblem(f"unknown variable {name}")
        return self.scope[name]

    def _lit(self, e: Lit) -> Typed:
        return literal(e.value)

    def _param(self, e: Param) -> Typed:
        return literal(constant(e, self.params))

    def _var(self, e: Var) -> Typed:
        b = self._binding(e.name)
        if isinstance(b, ValueVar):
            return Typed(b.column if b.column is not None else at(b.name), b.kind)
        return entity(b)

    def _prop(self, e: Prop) -> Typed:
        if isinstance(e.of, Var) and (not self.replaced or e.of not in self.replaced):
            b = self._binding(e.of.name)
            value = Typed(b.column if b.column is not None else at(b.name), b.kind) if isinstance(b, ValueVar) else None
            if value is not None and (part := scalars.component(value, e.name)):
                return part
            return prop(b, e.name)
        of = self(e.of)
        if part := scalars.component(of, e.name):
            return part
        if isinstance(of.kind, T.StructType) and e.name in of.kind.names:
            return Typed(of.col[e.name], of.kind[e.name].dataType)
        return null()

    def _not(self, e: Not) -> Typed:
        return Typed(~self.condition(e.of), BOOL)

    def _neg(self, e: Neg) -> Typed:
        of = self(e.of)
        return Typed(-of.col, of.kind) if of.is_number else Typed(-number(of), DOUBLE)

    def _isnull(self, e: IsNull) -> Typed:
        if isinstance(e.of, Var) and isinstance(b := self._binding(e.of.name), (NodeVar, RelVar)):
            of = at(f"{b.name}.__id") if isinstance(b, NodeVar) else at(f"{b.name}.__src")
        else:
            of = self(e.of).col
        return Typed(of.isNotNull() if e.negated else of.isNull(), BOOL)

    def _identity(self, e: Expr) -> Typed | None:
        """A node or relationship, compared as a whole."""
        if isinstance(e, Var) and isinstance(b := self.scope.get(e.name), (NodeVar, RelVar)):
            return Typed(b.identity())
        return None

    def _op(self, e: Op) -> Typed:
        if e.symbol in ("AND", "OR", "XOR"):
            a, b = self.condition(e.left), self.condition(e.right)
            return Typed({"AND": lambda: a & b, "OR": lambda: a | b, "XOR": lambda: a.cast("boolean") != b.cast("boolean")}[e.symbol](), BOOL)
        if e.symbol in ("=", "<>") and (x := self._identity(e.left)) and (y := self._identity(e.right)):
            return Typed(x.col == y.col if e.symbol == "=" else x.col != y.col, BOOL)
        a, b = self(e.left), self(e.right)
        if e.symbol in ("=", "<>", "<", "<=", ">", ">="):
            return Typed(self._compare(e.symbol, a, b), BOOL)
        if e.symbol == "IN":
            return Typed(self._in(a, b), BOOL)
        if e.symbol in ("STARTS", "ENDS", "CONTAINS"):
            x, y = text(a), text(b)
            return Typed({"STARTS": x.startswith, "ENDS": x.endswith, "CONTAINS": x.contains}[e.symbol](y), BOOL)
        if e.symbol == "+" and a.is_list:
            columns, kind = to_common([Typed(F.lit(None), element(a)), Typed(F.lit(None), element(b) if b.is_list else b.kind)])
            other = b.col if b.is_list else F.array(b.col)
            return Typed(F.concat(a.col, other), T.ArrayType(kind) if kind else None)
        if e.symbol == "+" and (a.is_text or b.is_text):
            return Typed(F.concat(text(a), text(b)), STRING)
        x, y = number(a), number(b)
        if e.symbol == "/":
            return Typed(F.try_divide(x, y), DOUBLE)
        if e.symbol == "%":
            return Typed(F.try_mod(x, y), DOUBLE)
        return Typed({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "^": lambda: F.pow(x, y)}[e.symbol](), DOUBLE)

    @staticmethod
    def _compare(symbol: str, a: Typed, b: Typed) -> Column:
        if a.is_text != b.is_text and a.kind is not None and b.kind is not None and not a.is_null and not b.is_null:
            if a.is_number or b.is_number:
                a, b = Typed(number(a), DOUBLE), Typed(number(b), DOUBLE)
            elif a.is_time or b.is_time:
                a, b = (Typed(scalars.instant(x)) for x in (a, b))
            else:
                a, b = Typed(text(a), STRING), Typed(text(b), STRING)
        x, y = a.col, b.col
        return {"=": lambda: x == y, "<>": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[symbol]()

    @staticmethod
    def _in(a: Typed, b: Typed) -> Column:
        kind = element(b)
        both = common([a.kind, kind]) if kind is not None else None
        if kind is None or both is None or (a.kind == kind):
            return F.array_contains(items(b) if b.is_list else b.col, a.col) if not a.is_null else F.lit(None).cast("boolean")
        if both == STRING:
            return F.array_contains(F.transform(b.col, lambda v: text(Typed(v, kind))), text(a))
        return F.array_contains(b.col.cast(T.ArrayType(both)), a.col.cast(both))

    def _listof(self, e: ListOf) -> Typed:
        return list_of([self(x) for x in e.items])

    def _mapof(self, e: MapOf) -> Typed:
        return map_of([(k, self(v)) for k, v in e.items])

    def _index(self, e: Index) -> Typed:
        of, k = self(e.of), self(e.at)
        if isinstance(of.kind, T.StructType):
            return self._prop(Prop(e.of, str(constant(e.at, self.params))))
        place = k.col.cast("int")
        return Typed(F.get(items(of), F.when(place < 0, F.size(items(of)) + place).otherwise(place)), element(of))

    def _slice(self, e: Slice) -> Typed:
        of = self(e.of)
        n = F.size(items(of))

        def place(x: Expr | None, default: Column) -> Column:
            if x is None:
                return default
            p = self(x).col.cast("int")
            return F.greatest(F.least(F.when(p < 0, n + p).otherwise(p), n), F.lit(0))

        low, high = place(e.low, F.lit(0)), place(e.high, n)
        return Typed(F.slice(items(of), low + 1, F.greatest(high - low, F.lit(0))), of.kind)

    def _case(self, e: Case) -> Typed:
        results = [self(v) for _, v in e.whens] + ([self(e.default)] if e.default is not None else [])
        columns, kind = to_common(results)
        subject = self(e.subject) if e.subject is not None else None
        out = None
        for (when, _), value in zip(e.whens, columns, strict=False):
            test = self.condition(when) if subject is None else self._compare("=", subject, self(when))
            out = F.when(test, value) if out is None else out.when(test, value)
        return Typed(out.otherwise(columns[-1]) if e.default is not None else out, kind)

    def _quantified(self, e: Quantified) -> Typed:
        over = self(e.over)
        if not over.is_list:
            return Typed(F.lit(False), BOOL)
        test = lambda v: F.coalesce(self.within(e.var, Typed(v, element(over))).condition(e.where), F.lit(False))
        out = {
            "ANY": lambda: F.exists(over.col, test),
            "ALL": lambda: F.forall(over.col, test),
            "NONE": lambda: ~F.exists(over.col, test),
            "SINGLE": lambda: F.size(F.filter(over.col, test)) == 1,
        }[e.kind]()
        return Typed(out, BOOL)

    def _comprehension(self, e: Comprehension) -> Typed:
        over = self(e.over)
        inner = element(over)
        source = items(over)
        if e.where is not None:
            source = F.filter(source, lambda v: F.coalesce(self.within(e.var, Typed(v, inner)).condition(e.where), F.lit(False)))
        kind = None

        def value(v: Column) -> Column:
            nonlocal kind
            t = self.within(e.var, Typed(v, inner))(e.value)
            kind = t.kind
            return t.col

        out = F.transform(source, lambda v: value(v))
        return Typed(out, T.ArrayType(kind) if kind is not None else None)

    def _call(self, e: Call) -> Typed:
        if e.name in AGGREGATES:
            if self.on_aggregate is None:
                raise QueryProblem(f"{e.name} can't stand here")
            return self.on_aggregate(e)
        if len(e.args) == 1 and isinstance(e.args[0], Var) and isinstance(b := self._binding(e.args[0].name), (NodeVar, RelVar)):
            if e.name == "duration":
                return self._duration(b)
            if e.name == "exists":
                return self._isnull(IsNull(e.args[0], True))
            if (found := introspect(e.name, b)) is not None:
                return found
        elif e.name in ("id", "elementid", "labels", "type", "keys", "properties", "startnode", "endnode", "duration"):
            return null()
        if len(e.args) == 1 and isinstance(e.args[0], PatternValue) and e.name == "exists":
            return self(e.args[0])
        try:
            return scalars.call(e.name, [self(a) for a in e.args], self.now)
        except scalars.FunctionProblem as problem:
            raise QueryProblem(str(problem)) from problem

    def _duration(self, b: NodeVar | RelVar) -> Typed:
        """Days from the start of validity to its end, or to now."""
        if not b.versioned:
            return null()
        a, z = at(f"{b.name}.__from"), F.coalesce(at(f"{b.name}.__to"), self.now)
        return Typed(F.timestamp_diff("MICROSECOND", a, z) / F.lit(8.64e10), DOUBLE)

    def _patternvalue(self, e: PatternValue) -> Typed:
        if self.on_pattern is None:
            raise QueryProblem("a pattern can't stand here")
        return self.on_pattern(e)

    def _similar(self, e: Similar) -> Typed:
        if self.on_similar is None:
            raise QueryProblem("SIMILAR TO can't stand here")
        return self.on_similar(e)
