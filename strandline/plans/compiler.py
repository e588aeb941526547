"""Clauses to one DataFrame: reads are planned as a whole and left to Catalyst; mutations act on the graph's tables."""

from __future__ import annotations

import datetime
from dataclasses import replace
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.typed import DOUBLE, LONG, Typed, number
from strandline.operators import algorithms, paths, vectors
from strandline.sources.catalog import FROM, TO, Time, valid

from .expressions import Expressions, QueryProblem, constant, has_aggregate
from .nodes import Call, Clause, Expr, IsNull, Item, ListOf, Lit, Neg, Not, Op, Param, Part, PatternValue, Prop, Query, Similar, Var
from .patterns import Patterns, edges, scan_node
from .scope import Frame, NodeVar, RelVar, ValueVar, at

if TYPE_CHECKING:
    from strandline.graph import Graph

WRITES = {"create", "merge", "set", "delete", "remove", "foreach", "embed"}


def conjuncts(e: Expr | None) -> list[Expr]:
    if e is None:
        return []
    return [*conjuncts(e.left), *conjuncts(e.right)] if isinstance(e, Op) and e.symbol == "AND" else [e]


def settled(e: Any) -> bool:
    """Whether an expression has no function or pattern in it, so that it says the same wherever it is computed."""
    if isinstance(e, (tuple, list)):
        return all(map(settled, e))
    return not isinstance(e, Expr) or (isinstance(e, (Lit, Var, Param, Prop, Op, Not, Neg, IsNull, ListOf)) and all(map(settled, vars(e).values())))


def variables(e: Any) -> set[str]:
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, (tuple, list)):
        return set().union(*(variables(x) for x in e)) if e else set()
    if hasattr(e, "__dataclass_fields__"):
        return set().union(*(variables(v) for v in vars(e).values())) if vars(e) else set()
    return set()


class Compiler:
    def __init__(self, graph: Graph, params: dict[str, Any], **options: Any):
        self.graph, self.params, self.options = graph, params, options
        self.spark = graph.catalog.spark
        self.now = graph.now()
        self.time: Time = options.pop("time", None)
        self.columns: list[str] = []

    def query(self, q: Query) -> DataFrame:
        out: DataFrame | None = None
        for k, clauses in enumerate(q.branches):
            df = self.branch(clauses)
            if out is None:
                out = df
                continue
            if len(df.columns) != len(out.columns):
                raise QueryProblem("branches of a UNION return different columns")
            df = df.toDF(*out.columns) if set(df.columns) != set(out.columns) else df
            out = out.unionByName(df)
            if not q.all_flags[k - 1]:
                out = out.distinct()
        return out

    # clauses

    def branch(self, clauses: list[Clause]) -> DataFrame:
        at_time = next((c for c in clauses if c.kind == "at_time"), None)
        saved = self.time
        if at_time is not None:
            self.time = self._time(at_time.time)
        try:
            return self._branch([c for c in clauses if c.kind != "at_time"])
        finally:
            self.time = saved

    def _time(self, e: Any) -> Time:
        if e == "earliest":
            starts = [t.df.agg(F.min(FROM).alias("t")) for t in [*self.graph.catalog.nodes, *self.graph.catalog.rels] if t.versioned]
            first = reduce(DataFrame.unionByName, starts).agg(F.min("t")).first()[0] if starts else None
            return first or datetime.datetime(1970, 1, 1)
        value = constant(e, self.params)
        if isinstance(value, datetime.datetime):
            return value
        if isinstance(value, str):
            return datetime.datetime.fromisoformat(value.replace("Z", ""))
        return datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=value)

    def _branch(self, clauses: list[Clause]) -> DataFrame:
        frame = Frame()
        k, wrote = 0, None
        while k < len(clauses):
            c = clauses[k]
            k += 1
            following = clauses[k].kind if k < len(clauses) else ""
            if c.kind == "match":
                where = clauses[k].expr if following == "where" else None
                k += where is not None
                similar = clauses[k] if k < len(clauses) and clauses[k].kind == "similar" else None
                if similar is not None:
                    k += 1
                    if where is None and k < len(clauses) and clauses[k].kind == "where":
                        where, k = clauses[k].expr, k + 1
                frame = self._match(frame, c, where, similar)
            elif c.kind == "where":
                frame = Frame(self._df(frame).where(self._expressions(frame).condition(c.expr)), frame.scope)
            elif c.kind == "unwind":
                frame = self._unwind(frame, c)
            elif c.kind == "call":
                frame = self._call(c)
            elif c.kind in ("with", "return"):
                frame = self._project(frame, c)
                if c.kind == "return":
                    if k < len(clauses):
                        raise QueryProblem("nothing may follow RETURN")
                    return self._output(frame)
            elif c.kind in WRITES:
                frame, wrote = self.graph.mutations.apply(self, frame, c, wrote)
            else:
                raise QueryProblem(f"{c.kind} can't stand here")
        if wrote is None:
            raise QueryProblem("the query returns nothing: it needs RETURN")
        return self.spark.createDataFrame([tuple(wrote.values())], ", ".join(f"{n} long" for n in wrote))

    def _df(self, f: Frame) -> DataFrame:
        return self.spark.range(1).select() if f.df is None else f.df

    def _output(self, f: Frame) -> DataFrame:
        columns = []
        for name, b in f.scope.items():
            columns.append((at(name) if isinstance(b, ValueVar) else self._expressions(f)(Var(name)).col).alias(name))
        return f.df.select(*columns)

    def _expressions(self, f: Frame, **more: Any) -> Expressions:
        return Expressions(f.scope, self.params, self.now, **more)

    # matching

    def patterns(self) -> Patterns:
        def compare(column: Column, kind: T.DataType, e: Expr) -> Column:
            return Expressions._compare("=", Typed(column, kind), Expressions({}, self.params, self.now)(e))

        return Patterns(self.graph.catalog, self.time, compare, **{k: v for k, v in self.options.items() if k in ("self_loops_twice", "per_path")})

    @staticmethod
    def lift(parts: list[Part]) -> tuple[list[Part], list[Expr]]:
        """The parts without the inline properties that refer to variables, and those as conditions."""
        conditions: list[Expr] = []
        count = iter(range(10**6))

        def plain(n: Any) -> Any:
            bound = [(k, e) for k, e in n.props if variables(e)]
            if not bound:
                return n
            n = replace(n, var=n.var or f"inline {next(count)}", props=tuple((k, e) for k, e in n.props if not variables(e)))
            conditions.extend(Op("=", Prop(Var(n.var), k), e) for k, e in bound)
            return n

        return [replace(p, nodes=tuple(map(plain, p.nodes)), rels=tuple(map(plain, p.rels))) for p in parts], conditions

    def _match(self, frame: Frame, c: Clause, where: Expr | None, similar: Clause | None) -> Frame:
        parts, lifted = self.lift(c.parts)
        if lifted:
            c = Clause(c.kind, {**c.fields, "parts": parts})
            where = reduce(lambda x, y: Op("AND", x, y), lifted if where is None else [where, *lifted])
        special = [p for p in c.parts if p.function]
        if special:
            found, where = self._paths(frame, c.parts, where)
        else:
            found = self._pattern(c.parts, frame.scope, where)
        if similar is not None:
            # conditions choose the candidates before the search
            if where is not None:
                found, where = Frame(self._where(found, where), found.scope), None
            found = self._similar_search(found, c.parts[0].nodes[0].var, similar)
        return self._join(frame, found, where, c.optional)

    def _pattern(self, parts: list[Part], scope: dict, where: Expr | None = None) -> Frame:
        early = None
        if any(r.hops is not None for p in parts for r in p.rels):
            # searches start from the nodes that meet the conditions on them alone, which the plan can't move there
            alone = [(v, e) for e in conjuncts(where) if settled(e) and len(v := variables(e)) == 1]

            def early(var: str, f: Frame) -> Frame:
                for v, e in alone:
                    f = Frame(self._where(f, e), f.scope) if v == {var} else f
                return f

        found = self.patterns().frame(parts, scope, early)
        for p in parts:
            if p.var and not p.rels:
                raise QueryProblem("a path needs relationships")
        return found

    def _where(self, f: Frame, e: Expr) -> DataFrame:
        """Rows that meet a condition; existential patterns in it become semi-joins, or anti-joins where negated."""
        df = f.df if f.df is not None else self._df(f)
        rest = []
        for one in conjuncts(e):
            negated = type(one).__name__ == "Not"
            inner = one.of if negated else one
            if isinstance(inner, Call) and inner.name == "exists" and len(inner.args) == 1 and isinstance(inner.args[0], PatternValue):
                inner = inner.args[0]
            if isinstance(inner, PatternValue) and inner.value is None:
                df = self._exists(Frame(df, f.scope), inner, "left_anti" if negated else "left_semi")
            else:
                rest.append(one)
        for one in rest:
            df, condition = self._with_values(Frame(df, f.scope), one)
            df = df.where(condition)
        extra = [x for x in df.columns if x.startswith("__pv")]
        return df.drop(*extra)

    def _with_values(self, f: Frame, e: Expr) -> tuple[DataFrame, Column]:
        """The condition e, over f with a column for each pattern comprehension and similarity in it."""
        df, expressions = self._valued(f)
        condition = expressions.condition(e)
        return df[0], condition

    def _valued(self, f: Frame, **more: Any) -> tuple[list[DataFrame], Expressions]:
        holder = [self._df(f)]
        count = iter(range(10**6))

        def pattern(p: PatternValue) -> Typed:
            name = f"__pv{next(count)}"
            inner, shared = self._inner(f, p)
            value = Expressions(inner.scope, self.params, self.now)(p.value) if p.value is not None else Typed(F.lit(True), T.BooleanType())
            keys = [at(f"{v}.__id").alias(f"{name}.{v}") for v in shared]
            grouped = inner.df.select(*keys, value.col.alias("__value")).groupBy(*(at(f"{name}.{v}") for v in shared)).agg(F.sort_array(F.collect_list("__value")).alias(name))
            on = reduce(Column.__and__, [at(f"{v}.__id") == at(f"{name}.{v}") for v in shared], F.lit(True))
            holder[0] = holder[0].join(grouped, on, "left").drop(*(f"{name}.{v}" for v in shared))
            if p.value is None:
                return Typed(at(name).isNotNull(), T.BooleanType())
            kind = value.kind
            return Typed(F.coalesce(at(name), F.array().cast(dict(grouped.dtypes)[name])), T.ArrayType(kind) if kind is not None else None)

        def similar(s: Similar) -> Typed:
            name = f"__pv{next(count)}"
            if not isinstance(s.var, Var) or not isinstance(b := f.scope.get(s.var.name), NodeVar):
                raise QueryProblem("SIMILAR TO needs a node")
            table = self.graph.embeddings_of(b.labels)
            query = self.graph.vector_of(constant(s.query, self.params))
            near = vectors.vector_at(table, self.time).select(F.col("node_id").alias(f"{name}.id"), vectors.cosine_to(F.col("vector"), query).alias(name))
            holder[0] = holder[0].join(near, b.identity() == at(f"{name}.id"), "left").drop(f"{name}.id")
            least = constant(s.threshold, self.params) if s.threshold is not None else 0.7
            return Typed(F.coalesce(at(name) >= F.lit(float(least)), F.lit(False)), T.BooleanType())

        return holder, self._expressions(f, pattern=pattern, similar=similar, **more)

    def _inner(self, f: Frame, p: PatternValue) -> tuple[Frame, list[str]]:
        inner = self.patterns().frame([p.part], f.scope)
        if p.where is not None:
            inner = Frame(self._where(inner, p.where), inner.scope)
        return inner, [v for v in inner.scope if isinstance(f.scope.get(v), NodeVar)]

    def _exists(self, f: Frame, p: PatternValue, how: str) -> DataFrame:
        inner, shared = self._inner(f, p)
        keys = inner.df.select(*(at(f"{v}.__id").alias(f"__e.{v}") for v in shared)).distinct()
        on = reduce(Column.__and__, [at(f"{v}.__id") == at(f"__e.{v}") for v in shared], F.lit(True))
        return f.df.join(keys, on, how)

    def _join(self, frame: Frame, found: Frame, where: Expr | None, optional: bool) -> Frame:
        """Natural join of what is bound with what a pattern found, by the ids of shared variables."""
        shared = [v for v in found.scope if v in frame.scope]
        if frame.df is None and not optional:
            df = self._where(found, where) if where is not None else found.df
            return Frame(df, found.scope)
        outer = self._df(frame)
        hidden = {c: f"__m.{c}" for v in shared for c in found.scope[v].columns()}
        new = {v: b for v, b in found.scope.items() if v not in frame.scope}
        scope = {**frame.scope, **new}
        if optional:
            # what can be decided inside the pattern is decided there, the rest in the join
            inside = [e for e in conjuncts(where) if not self._outer(e, frame, found)]
            rest = [e for e in conjuncts(where) if self._outer(e, frame, found)]
            inner = found.df
            for e in inside:
                inner = self._where(Frame(inner, found.scope), e)
            inner = inner.select(*(at(c).alias(hidden.get(c, c)) for c in inner.columns))
            on = self._on(shared, frame, found, hidden)
            joined_scope = Frame(None, scope)
            for e in rest:
                on = on & self._expressions(joined_scope).condition(e)
            return Frame(outer.join(inner, on, "left").drop(*hidden.values()), scope)
        inner = found.df.select(*(at(c).alias(hidden.get(c, c)) for c in found.df.columns))
        df = outer.join(inner, self._on(shared, frame, found, hidden)) if shared else outer.crossJoin(inner)
        df = df.drop(*hidden.values())
        out = Frame(df, scope)
        return Frame(self._where(out, where), scope) if where is not None else out

    @staticmethod
    def _outer(e: Expr, frame: Frame, found: Frame) -> bool:
        return any(v in frame.scope and v not in found.scope for v in variables(e))

    @staticmethod
    def _on(shared: list[str], frame: Frame, found: Frame, hidden: dict[str, str]) -> Column:
        on = F.lit(True)
        for v in shared:
            a, b = frame.scope[v], found.scope[v]
            if isinstance(a, NodeVar) and isinstance(b, NodeVar):
                left, right = at(f"{v}.__id"), at(hidden[f"{v}.__id"])
                one = left.cast("string") == right.cast("string") if a.id_kind != b.id_kind else left == right
            elif isinstance(a, RelVar) and isinstance(b, RelVar):
                one = reduce(Column.__and__, [at(f"{v}.__{x}").eqNullSafe(at(hidden[f"{v}.__{x}"])) for x in ("type", "src", "dst")])
            else:
                raise QueryProblem(f"{v} is a value, and can't stand in a pattern")
            on = one if isinstance(on, Column) and str(on) == "Column<'true'>" else on & one
        return on

    def _paths(self, frame: Frame, parts: list[Part], where: Expr | None) -> tuple[Frame, Expr | None]:
        """Path functions: the ends are found first, by whatever conditions they have, then the paths between them."""
        if len(parts) != 1:
            raise QueryProblem("a path function stands alone in its MATCH")
        p = parts[0]
        if len(p.nodes) != 2:
            raise QueryProblem("a path function takes one relationship pattern")
        a, b = (n if n.var else type(n)(f"end {i}", n.labels, n.props) for i, n in enumerate(p.nodes))
        ends, rest = [], conjuncts(where)
        for n in (a, b):
            found = self.patterns().frame([Part((n,), ())], frame.scope)
            if n.var in frame.scope:
                keys = frame.df.select(at(f"{n.var}.__id").alias("__k")).distinct()
                found = Frame(found.df.join(keys, at(f"{n.var}.__id") == F.col("__k"), "left_semi"), found.scope)
            for e in [e for e in rest if variables(e) == {n.var}]:
                rest.remove(e)
                found = Frame(self._where(found, e), found.scope)
            ends.append(found)
        r = p.rels[0]
        tables = [t for t in self.graph.catalog.rels if not r.types or t.type in r.types]
        labels = {t.source for t in tables} | {t.target for t in tables} | set(ends[0].scope[a.var].labels) | set(ends[1].scope[b.var].labels)
        tagged = len(labels) > 1

        def key(f: Frame, v: str) -> Column:
            if not tagged:
                return at(f"{v}.__id")
            return F.concat(F.get(at(f"{v}.__labels"), F.lit(0)), F.lit(":"), at(f"{v}.__id").cast("string"))

        left, right = (f.df.withColumn(f"__key{i}", key(f, n.var)) for i, (f, n) in enumerate(zip(ends, (a, b), strict=True)))
        pairs = left.select(F.col("__key0").alias("src")).distinct().crossJoin(right.select(F.col("__key1").alias("dst")).distinct())
        name = p.var or "__path"
        if p.function == "earliest":
            found = self._earliest(tables, tagged, r.direction, left)
            value = F.struct("node_ids", (F.size("node_ids") - 1).alias("length"))
            extra = {"arrival_time": ValueVar("arrival_time", T.StringType())}
            found = found.select("src", "dst", value.alias(name), F.date_format("arrival", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("arrival_time"))
        else:
            links = edges(tables, self.time, "both" if r.direction == "both" or self.options.get("undirected_paths", True) else r.direction, tagged)
            if links is None:
                raise QueryProblem("no such relationship type")
            most = r.hops[1] if r.hops else None
            if p.function == "all_simple":
                found = paths.simple_paths(links, pairs, most or 10)
            else:
                found = paths.shortest(links, pairs, every=p.function == "all_shortest", most=most)
            found = found.select("src", "dst", F.struct("node_ids", "length").alias(name))
            extra = {}
        kind = found.schema[name].dataType
        joined = left.join(found, F.col("__key0") == F.col("src")).join(right, F.col("dst") == F.col("__key1"))
        joined = joined.drop("src", "dst", "__key0", "__key1")
        scope = {**ends[0].scope, **ends[1].scope, name: ValueVar(name, kind), **extra}
        return Frame(joined, scope), reduce(lambda x, y: Op("AND", x, y), rest) if rest else None

    def _earliest(self, tables: list, tagged: bool, direction: str, left: DataFrame) -> DataFrame:
        """Uses every version of the relationships; nodes must be valid now."""
        births, links = None, None

        def key(c: str, label: str) -> Column:
            return F.concat(F.lit(f"{label}:"), F.col(f"`{c}`").cast("string")) if tagged else F.col(f"`{c}`")

        early = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        for label in {t.source for t in tables} | {t.target for t in tables}:
            n = self.graph.catalog.node(label)
            if n is None:
                continue
            born = F.col(FROM) if n.versioned else early
            first = n.df.groupBy(key(n.key, label).alias("id")).agg(F.min(born).alias("born"))
            now = valid(n.df, None).select(key(n.key, label).alias("id")).distinct()
            one = first.join(now, "id", "left_semi")
            births = one if births is None else births.unionByName(one)
        for t in tables:
            since, until = (F.col(FROM), F.col(TO)) if t.versioned else (early, F.lit(None).cast("timestamp_ntz"))
            one = t.df.select(key(t.src, t.source).alias("a"), key(t.dst, t.target).alias("b"), since.alias("since"), until.alias("until"))
            links = one if links is None else links.unionByName(one)
        if direction != "out":
            turned = links.selectExpr("b as a", "a as b", "since", "until")
            links = turned if direction == "in" else links.unionByName(turned)
        return paths.earliest(births, links, left.select(F.col("__key0").alias("src")))

    def _similar_search(self, f: Frame, var: str | None, c: Clause) -> Frame:
        if var is None or not isinstance(b := f.scope.get(var), NodeVar):
            raise QueryProblem("SIMILAR TO needs a node with a variable")
        table = self.graph.embeddings_of(b.labels)
        query = self.graph.vector_of(constant(c.query, self.params))
        k = constant(c.limit, self.params) if c.limit is not None else None
        least = constant(c.threshold, self.params) if c.threshold is not None else None
        ids = f.df.select(b.identity().alias("node_id")).distinct()
        candidates = table.join(ids, "node_id", "left_semi")
        scope = {**f.scope, "similarity": ValueVar("similarity", DOUBLE)}
        if c.mode == "current":
            near = vectors.top_k(candidates, query, 100 if k is None else k, least, self.time)
            near = near.withColumnRenamed("node_id", "__node_id")
            return Frame(f.df.join(near, b.identity() == F.col("__node_id")).drop("__node_id"), scope)
        near = vectors.versions(candidates, query, k, least, c.mode == "drift")
        keep = ["similarity", *(["drift_from_previous", "drift_from_first"] if c.mode == "drift" else [])]
        near = near.select(F.col("node_id").alias("__node_id"), "valid_from", "valid_to", *keep)
        scope |= {n: ValueVar(n, DOUBLE) for n in keep} | {n: ValueVar(n, T.TimestampNTZType()) for n in ("valid_from", "valid_to")}
        return Frame(f.df.join(near, b.identity() == F.col("__node_id")).drop("__node_id"), scope)

    def _unwind(self, f: Frame, c: Clause) -> Frame:
        over = self._expressions(f)(c.over)
        kind = over.kind.elementType if isinstance(over.kind, T.ArrayType) else None
        df = self._df(f)
        if over.is_null:
            return Frame(df.where(F.lit(False)).withColumn(c.var, F.lit(None)), {**f.scope, c.var: ValueVar(c.var, T.NullType())})
        df = df.withColumn(c.var, F.explode(over.col))
        return Frame(df, {**f.scope, c.var: ValueVar(c.var, kind or df.schema[c.var].dataType)})

    def _call(self, c: Clause) -> Frame:
        """A procedure: its rows, with node bound where its label is one table."""
        if c.name not in ("pagerank", "louvain"):
            raise QueryProblem(f"unknown procedure {c.name}")
        config = {k: constant(v, self.params) for k, v in c.config}
        label, unit = config.get("label"), config.get("every", "second")
        names = [t for t in self.graph.catalog.nodes if label is None or label in t.labels]
        through = c.through and self.time is None
        nodes = links = None
        tagged = len(names) > 1
        for t in names:
            one = t.df if through else valid(t.df, self.time)
            key = F.concat(F.lit(f"{t.label}:"), F.col(f"`{t.key}`").cast("string")) if tagged else F.col(f"`{t.key}`")
            bounds = [F.col(FROM).alias("since"), F.col(TO).alias("until")] if t.versioned else [F.lit("1970-01-01").cast("timestamp_ntz").alias("since"), F.lit(None).cast("timestamp_ntz").alias("until")]
            one = one.select(key.alias("id"), *bounds)
            nodes = one if nodes is None else nodes.unionByName(one)
        some = {t.label for t in names}
        for t in self.graph.catalog.rels:
            if t.source not in some or t.target not in some or config.get("type", t.type) != t.type:
                continue
            one = t.df if through else valid(t.df, self.time)
            a, b = (F.concat(F.lit(f"{x}:"), F.col(f"`{k}`").cast("string")) if tagged else F.col(f"`{k}`") for x, k in ((t.source, t.src), (t.target, t.dst)))
            bounds = [F.col(FROM).alias("since"), F.col(TO).alias("until")] if t.versioned else [F.lit("1970-01-01").cast("timestamp_ntz").alias("since"), F.lit(None).cast("timestamp_ntz").alias("until")]
            one = one.select(a.alias("a"), b.alias("b"), *bounds)
            links = one if links is None else links.unionByName(one)
        if nodes is None:
            raise QueryProblem(f"no nodes are labelled {label}")
        if links is None:
            links = nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), "since", "until").where(F.lit(False))
        value = "score" if c.name == "pagerank" else "community"
        if through:
            out = algorithms.through_time(nodes, links, c.name, every=unit)
        elif c.name == "pagerank":
            out = algorithms.pagerank(nodes, links, damping=config.get("damping", algorithms.DAMPING), rounds=config.get("iterations", algorithms.ROUNDS))
        else:
            out = algorithms.louvain(nodes, links)
        kinds = dict(zip(out.columns, (f.dataType for f in out.schema), strict=True))
        scope: dict = {}
        for name, alias in c.yields:
            shown = alias or name
            if name == "node" and not tagged:
                nodes_df, b = scan_node(names[0], shown, None if through else self.time)
                out = out.join(nodes_df.dropDuplicates([f"{shown}.__id"]) if names[0].versioned else nodes_df, F.col("id") == at(f"{shown}.__id"), "left" if through else "inner")
                scope[shown] = b
            elif name == "node":
                out = out.withColumn(shown, F.col("id"))
                scope[shown] = ValueVar(shown, kinds["id"])
            elif name in (value, "valid_from", "valid_to") and name in kinds:
                if shown != name:
                    out = out.withColumnRenamed(name, shown)
                scope[shown] = ValueVar(shown, kinds[name])
            else:
                raise QueryProblem(f"{c.name} yields no {name}")
        return Frame(out, scope)

    # projection

    def _integer(self, e: Expr) -> int:
        value = constant(e, self.params)
        if not isinstance(value, int) or value < 0:
            raise QueryProblem("SKIP and LIMIT take whole numbers")
        return value

    def _project(self, f: Frame, c: Clause) -> Frame:
        items = list(c.items)
        if c.star:
            items = [Item(Var(v), v, v) for v in f.scope if not v.startswith("__") and " " not in v] + items
        names = [i.alias or (i.expr.name if isinstance(i.expr, Var) else i.text) for i in items]
        if len(set(names)) < len(names):
            raise QueryProblem(f"columns of one name: {names}")
        if any(has_aggregate(i.expr) for i in items):
            frame, order = self._aggregate(f, items, names, c)
        else:
            frame, order = self._plain(f, items, names, c)
        df = frame.df
        if c.distinct:
            keys = [x for v, b in frame.scope.items() for x in ([f"{v}.__id"] if isinstance(b, NodeVar) else b.columns())]
            df = df.dropDuplicates(keys) if keys else df.limit(1)
        if c.where is not None and c.kind == "with":
            df = self._where(Frame(df, frame.scope), c.where)
        if order:
            df = df.orderBy(*order)
        if c.skip is not None:
            df = df.offset(self._integer(c.skip))
        if c.limit is not None:
            df = df.limit(self._integer(c.limit))
        extra = [x for x in df.columns if x.startswith("__o")]
        return Frame(df.drop(*extra), frame.scope)

    def _select(self, item: Item, name: str, value: Typed | None, scope: dict) -> tuple[list[Column], Any]:
        """The columns of an item under its name, and what the name then stands for."""
        if isinstance(item.expr, Var) and isinstance(b := scope.get(item.expr.name), (NodeVar, RelVar)):
            renamed = type(b)(**{**vars(b), "name": name})
            return [at(x).alias(y) for x, y in zip(b.columns(), renamed.columns(), strict=True)], renamed
        return [value.col.alias(name)], ValueVar(name, value.kind)

    @staticmethod
    def _direction(column: Column, descending: bool) -> Column:
        return column.desc_nulls_first() if descending else column.asc_nulls_last()

    def _plain(self, f: Frame, items: list[Item], names: list[str], c: Clause) -> tuple[Frame, list[Column]]:
        holder, e = self._valued(f)
        columns, scope = [], {}
        for item, name in zip(items, names, strict=True):
            whole = isinstance(item.expr, Var) and isinstance(f.scope.get(item.expr.name), (NodeVar, RelVar))
            made, scope[name] = self._select(item, name, None if whole else e(item.expr), f.scope)
            columns += made
        order = []
        both = Frame(None, {**f.scope, **scope})
        for k, (key, descending) in enumerate(c.order):
            match = next((n for n, i in zip(names, items, strict=True) if i.expr == key or isinstance(key, Var) and key.name == n), None)
            if match is not None and isinstance(scope[match], ValueVar):
                order.append(self._direction(at(match), descending))
                continue
            if c.distinct and not isinstance(key, Prop):
                raise QueryProblem("with DISTINCT, rows are ordered by what is returned")
            column = self._order_key(key, f, both, e)
            columns.append(column.alias(f"__o{k}"))
            order.append(self._direction(at(f"__o{k}"), descending))
        df = holder[0]
        out = df.select(*columns) if df.columns or columns else df
        kinds = dict(zip(out.columns, (x.dataType for x in out.schema), strict=True))
        scope = {n: ValueVar(n, kinds[n]) if isinstance(b, ValueVar) and b.kind is None else b for n, b in scope.items()}
        return Frame(out, scope), order

    def _order_key(self, key: Expr, f: Frame, both: Frame, e: Expressions) -> Column:
        t = e(key) if not isinstance(key, Var) else None
        if t is None:
            b = f.scope.get(key.name)
            if b is None:
                raise QueryProblem(f"unknown variable {key.name}")
            return b.identity() if isinstance(b, (NodeVar, RelVar)) else at(key.name)
        return t.col

    def _aggregate(self, f: Frame, items: list[Item], names: list[str], c: Clause) -> tuple[Frame, list[Column]]:
        """One hash aggregation: keys are the items without aggregates; what stands around aggregates comes after."""
        holder, before = self._valued(f)
        keys: list[Column] = []
        carried: list[Column] = []
        scope: dict = {}
        replaced: dict[Expr, Typed] = {}
        entities: dict[str, Any] = {}
        for item, name in zip(items, names, strict=True):
            if has_aggregate(item.expr):
                continue
            if isinstance(item.expr, Var) and isinstance(b := f.scope.get(item.expr.name), NodeVar):
                # a node is its id; the rest follows from it
                renamed = type(b)(**{**vars(b), "name": name})
                keys.append(b.identity().alias(f"{name}.__id"))
                carried += [F.first(at(x)).alias(y) for x, y in zip(b.columns(), renamed.columns(), strict=True) if not y.endswith(".__id")]
                scope[name] = renamed
                entities[item.expr.name] = renamed
            else:
                value = None if isinstance(f.scope.get(getattr(item.expr, "name", "")), RelVar) and isinstance(item.expr, Var) else before(item.expr)
                made, scope[name] = self._select(item, name, value, f.scope)
                keys += made
                if value is not None:
                    replaced[item.expr] = Typed(at(name), value.kind)
        sums: list[Column] = []
        found: dict[Call, Typed] = {}

        def aggregate(call: Call) -> Typed:
            if call not in found:
                column, kind = self._aggregate_call(call, f, before)
                sums.append(column.alias(f"__a{len(found)}"))
                found[call] = Typed(at(f"__a{len(found)}"), kind)
            return found[call]

        after = Expressions({**entities, **scope}, self.params, self.now, replaced=replaced, aggregate=aggregate)
        late = [(name, after(item.expr)) for item, name in zip(items, names, strict=True) if has_aggregate(item.expr)]
        order_exprs = []
        for key, descending in c.order:
            match = next((n for n, i in zip(names, items, strict=True) if i.expr == key or isinstance(key, Var) and key.name == n), None)
            order_exprs.append((match, None if match is not None and match not in entities.values() and isinstance(scope.get(match, ValueVar(match, None)), ValueVar) else after(key), descending))
        df = holder[0]
        grouped = df.groupBy(*keys).agg(*sums, *carried) if keys else df.agg(*sums)
        columns = [at(x) for b in scope.values() for x in b.columns()] + [t.col.alias(n) for n, t in late]
        order = []
        for k, (match, value, descending) in enumerate(order_exprs):
            if value is None:
                order.append(self._direction(at(match), descending))
            else:
                columns.append(value.col.alias(f"__o{k}"))
                order.append(self._direction(at(f"__o{k}"), descending))
        out = grouped.select(*columns)
        kinds = dict(zip(out.columns, (x.dataType for x in out.schema), strict=True))
        scope |= {n: ValueVar(n, t.kind if t.kind is not None else kinds[n]) for n, t in late}
        scope = {n: scope[n] for n in names}
        return Frame(out, scope), order

    def _aggregate_call(self, call: Call, f: Frame, e: Expressions) -> tuple[Column, T.DataType | None]:
        if call.name == "count" and (call.star or not call.args):
            return F.count(F.lit(1)), LONG
        if len(call.args) != 1:
            raise QueryProblem(f"{call.name} takes one argument")
        arg = call.args[0]
        if isinstance(arg, Var) and isinstance(b := f.scope.get(arg.name), (NodeVar, RelVar)):
            whole = b.identity() if isinstance(b, NodeVar) else F.when(at(f"{b.name}.__src").isNotNull(), b.identity())
            value = Typed(whole) if call.name == "count" else e(arg)
        else:
            value = e(arg)
        column, distinct = value.col, call.distinct
        if call.name == "count":
            return (F.count_distinct(column) if distinct else F.count(column)), LONG
        if call.name == "sum":
            n = number(value)
            return F.coalesce(F.sum_distinct(n) if distinct else F.sum(n), F.lit(0.0)), DOUBLE
        if call.name == "avg":
            n = number(value)
            return (F.sum_distinct(n) / F.count_distinct(n) if distinct else F.avg(n)), DOUBLE
        if call.name in ("min", "max"):
            return (F.min if call.name == "min" else F.max)(column), value.kind
        listed = F.collect_set(column) if distinct else F.collect_list(column)
        return F.sort_array(listed), T.ArrayType(value.kind) if value.kind is not None else None


