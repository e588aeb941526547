"""Patterns to joins.

A pattern is compiled once for each way in which its nodes and relationships can be typed: labels and types narrow each
other, so that most patterns have one way, with typed keys and pruned columns; the ways are united. Within a way, each
hop is an equi-join with the relationships and one with the far nodes, which must be valid; Catalyst orders them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.paths import both_ways, reach
from strandline.sources.catalog import FROM, TO, Catalog, NodeTable, RelTable, Time, valid

from .expressions import QueryProblem
from .nodes import Expr, NodeP, Part, RelP
from .scope import Binding, Frame, NodeVar, RelVar, at

MOST_WAYS = 256
#: Hops of a walk where the pattern has no upper bound and every walk counts.
MOST_STEPS = 10
Compare = Callable[[Column, T.DataType, Expr], Column]


def scan_node(t: NodeTable, var: str, time: Time) -> tuple[DataFrame, NodeVar]:
    columns = [F.col(f"`{t.key}`").alias(f"{var}.__id"), F.array(*(F.lit(x) for x in t.labels)).alias(f"{var}.__labels")]
    if t.versioned:
        columns += [F.col(FROM).alias(f"{var}.__from"), F.col(TO).alias(f"{var}.__to")]
    columns += [F.col(f"`{p}`").alias(f"{var}.{p}") for p in t.props]
    return valid(t.df, time).select(*columns), NodeVar(var, (t.label,), t.df.schema[t.key].dataType, t.props, t.versioned)


def scan_rel(t: RelTable, var: str, time: Time) -> tuple[DataFrame, RelVar]:
    columns = [F.lit(t.type).alias(f"{var}.__type"), F.col(f"`{t.src}`").alias(f"{var}.__src"), F.col(f"`{t.dst}`").alias(f"{var}.__dst")]
    if t.versioned:
        columns += [F.col(FROM).alias(f"{var}.__from"), F.col(TO).alias(f"{var}.__to")]
    columns += [F.col(f"`{p}`").alias(f"{var}.{p}") for p in t.props]
    kinds = (t.df.schema[t.src].dataType, t.df.schema[t.dst].dataType)
    return valid(t.df, time).select(*columns), RelVar(var, kinds, t.props, t.versioned, t.key)


def edges(tables: list[RelTable], time: Time, direction: str, tagged: bool) -> DataFrame | None:
    """(a, b) of the relationships in a direction; tagged: ids with their label before them."""
    out = None
    for t in tables:
        def key(column: str, label: str) -> Column:
            return F.concat(F.lit(f"{label}:"), F.col(f"`{column}`").cast("string")) if tagged else F.col(f"`{column}`")

        one = valid(t.df, time).select(key(t.src, t.source).alias("a"), key(t.dst, t.target).alias("b"))
        out = one if out is None else out.unionByName(one)
    if out is None or direction == "out":
        return out
    return out.selectExpr("b as a", "a as b") if direction == "in" else both_ways(out)


class Patterns:
    """Compiles patterns over a catalog at a time. compare gives the condition that a property equals an expression."""

    def __init__(self, catalog: Catalog, time: Time, compare: Compare, *, self_loops_twice: bool = False, per_path: bool = False):
        self.catalog, self.time, self.compare = catalog, time, compare
        self.self_loops_twice, self.per_path = self_loops_twice, per_path
        self.early: Callable[[str, Frame], Frame] | None = None

    def frame(self, parts: list[Part], scope: dict[str, Binding], early: Callable[[str, Frame], Frame] | None = None) -> Frame:
        """All matches of the parts; variables that scope holds as nodes are typed as there. early: takes the nodes of a
        variable by conditions that hold later too; used where the variable has one type, as ids and properties then
        have theirs."""
        parts = self._named(parts)
        nodes: dict[str, NodeP] = {}
        for p in parts:
            for n in p.nodes:
                old = nodes.get(n.var)
                nodes[n.var] = n if old is None else replace(old, labels=tuple(dict.fromkeys(old.labels + n.labels)), props=old.props + n.props)
        rels = [(r, p.nodes[i].var, p.nodes[i + 1].var) for p in parts for i, r in enumerate(p.rels)]
        tables = {}
        for v, n in nodes.items():
            found = self.catalog.labelled(n.labels)
            if isinstance(b := scope.get(v), NodeVar):
                found = [t for t in found if t.label in b.labels]
            tables[v] = found
        self.early = early and (lambda v, f: early(v, f) if len(tables[v]) == 1 else f)
        frames = [self._way(nodes, rels, way, kinds) for way, kinds in self._ways(rels, tables)]
        found = unite(frames) if frames else self._nothing(nodes, rels, scope)
        # what has no name can't be referred to again
        named = {v: b for v, b in found.scope.items() if not v.startswith("__")}
        return Frame(found.df.drop(*(c for v, b in found.scope.items() if v not in named for c in b.columns())), named)

    def _named(self, parts: list[Part]) -> list[Part]:
        count = iter(range(10**6))
        name = lambda v, k: v or f"__{k}{next(count)}"
        return [replace(p, nodes=tuple(replace(n, var=name(n.var, "n")) for n in p.nodes), rels=tuple(replace(r, var=name(r.var, "r")) for r in p.rels)) for p in parts]

    def _ways(self, rels: list, tables: dict[str, list[NodeTable]]) -> Iterator[tuple[dict[str, NodeTable], list]]:
        """Every typing of the nodes, with the typing of the relationships that fits."""
        made = 0

        def step(k: int, way: dict[str, NodeTable], kinds: list) -> Iterator[tuple[dict, list]]:
            nonlocal made
            if k < len(rels):
                r, left, right = rels[k]
                for a in [way[left]] if left in way else tables[left]:
                    for b in [way[right]] if right in way else [a] if right == left else tables[right]:
                        if right == left and a is not b:
                            continue
                        for fit in self._fits(r, a, b):
                            yield from step(k + 1, {**way, left: a, right: b}, [*kinds, fit])
                return
            free = [v for v in tables if v not in way]
            if free:
                for t in tables[free[0]]:
                    yield from step(k, {**way, free[0]: t}, kinds)
                return
            made += 1
            if made > MOST_WAYS:
                raise QueryProblem("the pattern can be typed in too many ways: name labels and types")
            yield way, kinds

        return step(0, {}, [])

    def _fits(self, r: RelP, a: NodeTable, b: NodeTable) -> list:
        """(table, turned) for each relationship table that may lead from a to b; for several hops, all at once."""
        some = [t for t in self.catalog.rels if not r.types or t.type in r.types]
        if r.hops is not None:
            labels = {a.label}
            if r.direction in ("out", "both"):
                ends = {(t.source, t.target) for t in some}
            else:
                ends = {(t.target, t.source) for t in some}
            if r.direction == "both":
                ends |= {(y, x) for x, y in ends}
            reached: set[str] = set()
            while new := {y for x, y in ends if x in labels | reached} - reached:
                reached |= new
            return [(some, False)] if b.label in reached else []
        out = []
        for t in some:
            if r.direction in ("out", "both") and (t.source, t.target) == (a.label, b.label):
                out.append((t, False))
            if r.direction in ("in", "both") and (t.target, t.source) == (a.label, b.label):
                out.append((t, True))
        return out

    def _node(self, n: NodeP, t: NodeTable) -> tuple[DataFrame, NodeVar]:
        df, b = scan_node(t, n.var, self.time)
        for k, e in n.props:
            df = df.where(self.compare(at(f"{n.var}.{k}"), b.props[k], e) if k in b.props else F.lit(False))
        return (self.early(n.var, Frame(df, {n.var: b})).df if self.early else df), b

    def _way(self, nodes: dict[str, NodeP], rels: list, way: dict[str, NodeTable], kinds: list) -> Frame:
        out: Frame | None = None
        left = list(range(len(rels)))
        waiting = list(nodes)
        while waiting:
            start = waiting.pop(0)
            df, b = self._node(nodes[start], way[start])
            part = Frame(df, {start: b})
            grown = True
            while grown:
                grown = False
                for k in list(left):
                    r, x, y = rels[k]
                    if x in part.scope or y in part.scope:
                        part = self._hop(part, r, x, y, kinds[k], nodes, way)
                        left.remove(k)
                        waiting = [v for v in waiting if v not in part.scope]
                        grown = True
                        break
            out = part if out is None else Frame(out.df.crossJoin(part.df), {**out.scope, **part.scope})
        return out

    def _hop(self, f: Frame, r: RelP, x: str, y: str, kind: tuple, nodes: dict[str, NodeP], way: dict[str, NodeTable]) -> Frame:
        if r.hops is not None:
            return self._hops(f, r, x, y, kind[0], nodes, way)
        table, turned = kind
        df, b = scan_rel(table, r.var, self.time)
        for k, e in r.props:
            df = df.where(self.compare(at(f"{r.var}.{k}"), b.props[k], e) if k in b.props else F.lit(False))
        if turned and r.direction == "both" and not self.self_loops_twice and table.source == table.target:
            df = df.where(at(f"{r.var}.__src") != at(f"{r.var}.__dst"))
        near, far = (f"{r.var}.__dst", f"{r.var}.__src") if turned else (f"{r.var}.__src", f"{r.var}.__dst")
        known, new = (x, y) if x in f.scope else (y, x)
        here, there = (near, far) if known == x else (far, near)
        on = at(f"{known}.__id") == at(here)
        if new in f.scope:
            return Frame(f.df.join(df, on & (at(f"{new}.__id") == at(there))), {**f.scope, r.var: b})
        other, nb = self._node(nodes[new], way[new])
        joined = f.df.join(df, on).join(other, at(there) == at(f"{new}.__id"))
        return Frame(joined, {**f.scope, r.var: b, new: nb})

    def _hops(self, f: Frame, r: RelP, x: str, y: str, tables: list[RelTable], nodes: dict[str, NodeP], way: dict[str, NodeTable]) -> Frame:
        """Each far node once, at its least distance, from each distinct near node."""
        low, high = max(r.hops[0] or 1, 1), r.hops[1]
        if high is None and self.per_path:
            high = max(low, MOST_STEPS)  # walks over a cycle have no end
        if high is not None and high < low:
            return Frame(f.df.where(F.lit(False)), f.scope) if x in f.scope and y in f.scope else self._hops(f, replace(r, hops=(low, low)), x, y, tables, nodes, way)
        labels = {t.source for t in tables} | {t.target for t in tables}
        tagged = len(labels) > 1
        known, new = (x, y) if x in f.scope else (y, x)
        direction = r.direction if known == x else {"out": "in", "in": "out"}.get(r.direction, "both")
        links = edges(tables, self.time, direction, tagged)

        def key(v: str) -> Column:
            return F.concat(F.lit(f"{way[v].label}:"), at(f"{v}.__id").cast("string")) if tagged else at(f"{v}.__id")

        start = f.df.select(key(known).alias("src")).distinct()
        found = reach(links, start, low, high, self.per_path).select(F.col("src").alias("__src"), F.col("dst").alias("__dst"))
        met = f.df.join(found, key(known) == F.col("__src"))
        if new in f.scope:
            return Frame(met.where(key(new) == F.col("__dst")).drop("__src", "__dst"), f.scope)
        other, nb = self._node(nodes[new], way[new])
        return Frame(met.join(other, F.col("__dst") == key(new)).drop("__src", "__dst"), {**f.scope, new: nb})

    def _nothing(self, nodes: dict[str, NodeP], rels: list, scope: dict[str, Binding]) -> Frame:
        """No rows, with the pattern's variables: an unknown label or type isn't an error."""
        fields, out = [], {}
        for v in nodes:
            b = scope.get(v)
            known = self.catalog.labelled(nodes[v].labels)
            kind = b.id_kind if isinstance(b, NodeVar) else known[0].df.schema[known[0].key].dataType if known else T.StringType()
            props = b.props if isinstance(b, NodeVar) else known[0].props if known else {}
            out[v] = NodeVar(v, (), kind, props, False)
            fields += [T.StructField(f"{v}.__id", kind), T.StructField(f"{v}.__labels", T.ArrayType(T.StringType())), *(T.StructField(f"{v}.{p}", t) for p, t in props.items())]
        for r, _, _ in rels:
            out[r.var] = RelVar(r.var, (T.StringType(), T.StringType()), {}, False)
            fields += [T.StructField(f"{r.var}.__{k}", T.StringType()) for k in ("type", "src", "dst")]
        return Frame(self.catalog.spark.createDataFrame([], T.StructType(fields)), out)


def unite(frames: list[Frame]) -> Frame:
    """One frame with the rows of all: missing properties are null, ids and properties of unlike types are text."""
    if len(frames) == 1:
        return frames[0]
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for c, k in f.df.dtypes:
            kinds.setdefault(c, set()).add(k)
    mixed = {c for c, k in kinds.items() if len(k) > 1}
    out = None
    for f in frames:
        df = f.df.select(*(at(c).cast("string").alias(c) if c in mixed else at(c) for c in f.df.columns))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    scope: dict[str, Binding] = {}
    for v in frames[0].scope:
        all_of = [f.scope[v] for f in frames]
        props: dict[str, T.DataType] = {}
        for b in all_of:
            props |= {p: T.StringType() if f"{v}.{p}" in mixed else k for p, k in b.props.items()}
        versioned = any(b.versioned for b in all_of)
        if isinstance(all_of[0], NodeVar):
            labels = tuple(dict.fromkeys(x for b in all_of for x in b.labels))
            scope[v] = NodeVar(v, labels, T.StringType() if f"{v}.__id" in mixed else all_of[0].id_kind, props, versioned)
        else:
            ends = tuple(T.StringType() if f"{v}.__{e}" in mixed else all_of[0].id_kinds[i] for i, e in enumerate(("src", "dst")))
            scope[v] = RelVar(v, ends, props, versioned, next((b.key for b in all_of if b.key), None))
    return Frame(out, scope)
