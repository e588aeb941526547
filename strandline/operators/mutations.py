"""Mutations of a graph's version log: each makes new tables and puts them in the old ones' places.

Property changes close the current version and append a new one; with versioned=False they overwrite it. Deletes close.
Every change is a join of a table with the keys that a pattern matched, written once, so that later queries read a
table and not a history of plans.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators import vectors
from strandline.plans.expressions import Expressions, QueryProblem
from strandline.plans.nodes import Clause, Comprehension, Expr, Lit, NodeP, Op, Part
from strandline.plans.scope import Frame, NodeVar, RelVar, ValueVar, at
from strandline.sources.catalog import FROM, TO, EmbeddingTable, NodeTable, RelTable, literal_time, with_validity
from strandline.sources.shared import written

if TYPE_CHECKING:
    from strandline.graph import Graph

NULL = Lit(None)

class Mutations:
    def __init__(self, graph: Graph, versioned: bool = True):
        self.graph, self.versioned = graph, versioned

    @property
    def catalog(self):
        return self.graph.catalog

    def apply(self, compiler: Any, f: Frame, c: Clause, wrote: dict[str, int] | None) -> tuple[Frame, dict[str, int]]:
        when = compiler.now if compiler.time in (None, "all") else literal_time(compiler.time)
        f, name, n = getattr(self, f"_{c.kind}")(compiler, f, c, when)
        wrote = dict(wrote or {})
        wrote[name] = wrote.get(name, 0) + n
        return f, wrote

    # creation

    def _create(self, compiler: Any, f: Frame, c: Clause, when: Column) -> tuple[Frame, str, int]:
        f, n = self.create(compiler, f, c.parts, when)
        return f, "created", n

    def create(self, compiler: Any, f: Frame, parts: list[Part], when: Column) -> tuple[Frame, int]:
        """Nodes and relationships of the parts for each row of f; bound variables are used, not made again."""
        scope, made = dict(f.scope), []
        df = compiler._df(f)
        count = iter(range(10**6))
        named = [replace(p, nodes=tuple(replace(n, var=n.var or f"__c{next(count)}") for n in p.nodes)) for p in parts]
        for n in (n for p in named for n in p.nodes):
            if n.var in scope or not (n.labels or n.props):
                continue
            df, b = self._new_node(compiler, Frame(df, f.scope), n, when)
            scope[n.var] = b
            made.append(n.var)
        df = written(df, "create") if made or f.df is not None else df
        total = 0
        for v in made:
            b = scope[v]
            table = self.catalog.node(b.labels[0])
            rows = df.select(*(at(f"{v}.{p}").alias(p) for p in b.props), at(f"{v}.__from").alias(FROM), at(f"{v}.__to").alias(TO))
            total += rows.count()
            self._append_node(table, rows, b)
        for p in named:
            for i, r in enumerate(p.rels):
                a, b = p.nodes[i].var, p.nodes[i + 1].var
                if r.direction == "in":
                    a, b = b, a
                if a not in scope or b not in scope or len(r.types) != 1:
                    raise QueryProblem("a relationship is created between named nodes, with one type")
                total += self._new_rel(compiler, Frame(df, scope), r.types[0], a, b, r.props, when)
        return Frame(df, scope), total

    def _new_node(self, compiler: Any, f: Frame, n: NodeP, when: Column) -> tuple[DataFrame, NodeVar]:
        labels = n.labels or ("",)
        table = self.catalog.node(labels[0])
        e = Expressions(f.scope, compiler.params, compiler.now)
        values = {k: e(v) for k, v in n.props}
        key = table.key if table is not None else "id"
        kind = table.df.schema[key].dataType if table is not None else (values["id"].kind if "id" in values else T.StringType())
        if key not in values and not isinstance(kind, T.StringType):
            raise QueryProblem(f"a new {labels[0]} needs its key, {key}")
        props = {key: kind} | (table.props if table is not None else {}) | {k: v.kind if v.kind is not None else T.StringType() for k, v in values.items() if table is None or k not in table.props}
        props = {k: T.StringType() if isinstance(t, T.NullType) else t for k, t in props.items()}
        columns = {f"{n.var}.{p}": (values[p].col.cast(t) if p in values else F.uuid() if p == key else F.lit(None).cast(t)) for p, t in props.items()}
        df = f.df.select("*", *(c.alias(k) for k, c in columns.items()))
        df = df.select("*", at(f"{n.var}.{key}").alias(f"{n.var}.__id"), F.array(*(F.lit(x) for x in labels)).alias(f"{n.var}.__labels"), when.alias(f"{n.var}.__from"), F.lit(None).cast("timestamp_ntz").alias(f"{n.var}.__to"))
        b = NodeVar(n.var, labels, kind, props, True)
        if table is None:
            schema = T.StructType([T.StructField(k, t) for k, t in props.items()] + [T.StructField(FROM, T.TimestampNTZType()), T.StructField(TO, T.TimestampNTZType())])
            self.catalog.put_node(NodeTable(self.catalog.spark.createDataFrame([], schema), key, labels))
        return df, b

    def _append_node(self, table: NodeTable, rows: DataFrame, b: NodeVar) -> None:
        table = with_validity(table)
        out = table.df.unionByName(rows, allowMissingColumns=True)
        self.catalog.put_node(replace(table, df=written(out, "nodes"), labels=tuple(dict.fromkeys(table.labels + b.labels))))

    def _new_rel(self, compiler: Any, f: Frame, kind: str, a: str, b: str, props: tuple, when: Column) -> int:
        x, y = f.scope[a], f.scope[b]
        if not isinstance(x, NodeVar) or not isinstance(y, NodeVar):
            raise QueryProblem("relationships are created between nodes")
        e = Expressions(f.scope, compiler.params, compiler.now)
        values = {k: e(v).col for k, v in props}
        total = 0
        for source in x.labels[:1]:
            for target in y.labels[:1]:
                old = next((t for t in self.catalog.rels if (t.type, t.source, t.target) == (kind, source, target)), None)
                src, dst = (old.src, old.dst) if old else ("src", "dst")
                rows = f.df.select(x.identity().alias(src), y.identity().alias(dst), *(v.alias(k) for k, v in values.items()), when.alias(FROM), F.lit(None).cast("timestamp_ntz").alias(TO))
                rows = written(rows, "rels")
                total += rows.count()
                table = with_validity(old) if old else RelTable(rows, kind, source, target)
                if old:
                    table = replace(table, df=written(table.df.unionByName(rows, allowMissingColumns=True), "rels"))
                self.catalog.put_rel(table, old)
        return total

    def _merge(self, compiler: Any, f: Frame, c: Clause, when: Column) -> tuple[Frame, str, int]:
        """Each row keeps its matches; rows without one make the pattern, once for equal properties."""
        parts, conditions = compiler.lift([c.part])
        where = reduce(lambda x, y: Op("AND", x, y), conditions) if conditions else None
        row = "merge row"
        df = written(compiler._df(f).withColumn(row, F.monotonically_increasing_id()), "merge")
        rows = Frame(df, {**f.scope, row: ValueVar(row, T.LongType())})

        def matches() -> Frame:
            return compiler._join(rows, compiler.patterns().frame(parts, rows.scope), where, False)

        found = matches()
        found = Frame(written(found.df, "merge"), found.scope)
        missing = df.join(found.df.select(row).distinct(), row, "left_anti")
        e = Expressions(rows.scope, compiler.params, compiler.now)
        values = {f"merge {k}": e(v).col for k, v in enumerate(v for n in (*c.part.nodes, *c.part.rels) for _, v in n.props)}
        bound = {f"merge {n.var}": rows.scope[n.var].identity() for n in c.part.nodes if isinstance(rows.scope.get(n.var), NodeVar)}
        keys = values | bound
        missing = missing.withColumns(keys).dropDuplicates(list(keys)).drop(*keys) if keys else missing.limit(1)
        missing = written(missing, "merge")
        if found.df.limit(1).count():
            self._assign(compiler, found, c.on_match, when)
        made = missing.count()
        if made:
            new, _ = self.create(compiler, Frame(missing, rows.scope), [c.part], when)
            self._assign(compiler, new, c.on_create, when)
        out = matches()
        return Frame(out.df.drop(row), {v: b for v, b in out.scope.items() if v != row}), "merged", made

    def _again(self, compiler: Any, f: Frame) -> Frame:
        """The same rows, with the current versions of their nodes."""
        out = Frame(f.df, f.scope)
        for v, b in f.scope.items():
            if isinstance(b, NodeVar):
                now = compiler.patterns().frame([Part((NodeP(v, (b.labels[0],)),), ())], {})
                keep = [c for x, y in out.scope.items() if x != v for c in y.columns()]
                ids = out.df.select(*(at(c) for c in keep), b.identity().alias("__k"))
                out = Frame(ids.join(now.df, F.col("__k") == at(f"{v}.__id")).drop("__k"), {**out.scope, v: now.scope[v]})
        return out

    # change

    def _set(self, compiler: Any, f: Frame, c: Clause, when: Column) -> tuple[Frame, str, int]:
        n = self._assign(compiler, f, c.items, when)
        return self._again(compiler, f), "updated", n

    def _assign(self, compiler: Any, f: Frame, items: list, when: Column) -> int:
        grouped: dict[str, dict[str, Any]] = {}
        e = Expressions(f.scope, compiler.params, compiler.now)
        for var, prop, how, value in items:
            b = f.scope.get(var)
            if not isinstance(b, (NodeVar, RelVar)):
                raise QueryProblem(f"SET needs a node or relationship, not {var}")
            into = grouped.setdefault(var, {})
            if prop is not None:
                into[prop] = e(value)
                continue
            if how == "=":
                key = self.catalog.node(b.labels[0]).key if isinstance(b, NodeVar) else b.key
                into.update({p: e(NULL) for p in b.props if p != key})
            into.update({k: e(v) for k, v in value.items})
        total = 0
        for var, values in grouped.items():
            total = max(total, self.change(f, var, values, when))
        return total

    def change(self, f: Frame, var: str, values: dict[str, Any], when: Column) -> int:
        """Set properties of var's current versions; a version that already has the values stays. Nodes that f binds
        more than once take the value of one row."""
        b = f.scope[var]
        total = 0
        if isinstance(b, NodeVar):
            rows = f.df.select(b.identity().alias("__k"), *(v.col.alias(f"__v.{p}") for p, v in values.items())).where("__k is not null").dropDuplicates(["__k"])
            for label in b.labels:
                if (t := self.catalog.node(label)) is None:
                    continue
                t = with_validity(t)
                df = self._with_columns(t.df, values)
                out, n = self._change(df, rows, df[t.key] == F.col("__k"), values, when)
                self.catalog.put_node(replace(t, df=out))
                total += n
            return total
        keys = [at(f"{var}.__src").alias("__a"), at(f"{var}.__dst").alias("__b")]
        keys.append((at(f"{var}.{b.key}") if b.key else at(f"{var}.__from") if b.versioned else F.lit(None).cast("string")).alias("__k"))
        rows = f.df.select(at(f"{var}.__type").alias("__t"), *keys, *(v.col.alias(f"__v.{p}") for p, v in values.items())).dropDuplicates(["__t", "__a", "__b", "__k"])
        for t in list(self.catalog.rels):
            df = self._with_columns(with_validity(t).df, values)
            own = df[t.key] if t.key else df[FROM] if b.versioned else F.lit(None).cast("string")
            some = rows.where(F.col("__t") == t.type)
            if not some.limit(1).count():
                continue
            out, n = self._change(df, some.drop("__t"), (df[t.src] == F.col("__a")) & (df[t.dst] == F.col("__b")) & own.eqNullSafe(F.col("__k")), values, when)
            self.catalog.put_rel(replace(with_validity(t), df=out), t)
            total += n
        return total

    @staticmethod
    def _with_columns(df: DataFrame, values: dict[str, Any]) -> DataFrame:
        return df.withColumns({p: F.lit(None).cast("string" if v.kind is None or isinstance(v.kind, T.NullType) else v.kind) for p, v in values.items() if p not in df.columns})

    def _change(self, df: DataFrame, rows: DataFrame, on: Column, values: dict[str, Any], when: Column) -> tuple[DataFrame, int]:
        columns = df.columns
        met = df.join(rows.withColumn("__hit", F.lit(True)), on & df[TO].isNull(), "left")
        new = {p: F.col(f"`__v.{p}`").cast(df.schema[p].dataType) for p in values}
        same = F.lit(True)
        for p, v in new.items():
            same = same & F.col(f"`{p}`").eqNullSafe(v)
        hit = F.coalesce(F.col("__hit"), F.lit(False)) & ~same
        if self.versioned:
            old = F.struct(*(when.alias(TO) if c == TO else F.col(f"`{c}`") for c in columns))
            now = F.struct(*((when.alias(FROM) if c == FROM else new[c].alias(c) if c in new else F.col(f"`{c}`")) for c in columns))
            made = F.array(old, now)
        else:
            made = F.array(F.struct(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns)))
        keep = F.array(F.struct(*(F.col(f"`{c}`") for c in columns)))
        exploded = met.select(hit.alias("__h"), F.explode(F.when(hit, made).otherwise(keep)).alias("__r"))
        out = written(exploded.select("__r.*", "__h"), "changed")
        n = out.where("__h").count() // (2 if self.versioned else 1)
        return out.drop("__h"), n

    def _remove(self, compiler: Any, f: Frame, c: Clause, when: Column) -> tuple[Frame, str, int]:
        total = 0
        for var, what, name in c.items:
            b = f.scope.get(var)
            if not isinstance(b, NodeVar):
                raise QueryProblem("REMOVE needs a node")
            if what == "property":
                if name in b.props:
                    total += self.change(f, var, {name: Expressions({}, {}, compiler.now)(NULL)}, when)
                continue
            for label in b.labels:
                t = self.catalog.node(label)
                if t is not None and name in t.labels[1:]:
                    # the nodes move to a table without the label
                    raise QueryProblem("a label that a whole table has can't be taken from some of its nodes")
                if t is not None and name == t.label:
                    raise QueryProblem("the label that names a table can't be removed")
        return self._again(compiler, f), "removed", total

    def _foreach(self, compiler: Any, f: Frame, c: Clause, when: Column) -> tuple[Frame, str, int]:
        """SET for each element of a list: the last element's values hold, so they alone are computed."""
        items = []
        for var, prop, how, value in c.items:
            items.append((var, prop, how, LastOf(c.var, c.over, value)))
        return f, "updated", self._assign_last(compiler, f, items, when)

    def _assign_last(self, compiler: Any, f: Frame, items: list, when: Column) -> int:
        e = Expressions(f.scope, compiler.params, compiler.now)
        grouped: dict[str, dict[str, Any]] = {}
        for var, prop, _, value in items:
            values = e(Comprehension(value.var, value.over, None, value.value))
            kind = values.kind.elementType if isinstance(values.kind, T.ArrayType) else None
            grouped.setdefault(var, {})[prop] = replace(values, col=F.element_at(values.col, -1), kind=kind)
            # an empty list sets nothing
            f = Frame(f.df.where(F.size(values.col) > 0), f.scope)
        return max((self.change(f, var, values, when) for var, values in grouped.items()), default=0)

    # deletion

    def _delete(self, compiler: Any, f: Frame, c: Clause, when: Column) -> tuple[Frame, str, int]:
        total = 0
        f = Frame(written(f.df, "delete"), f.scope)
        for var in c.vars:
            b = f.scope.get(var)
            if not isinstance(b, (NodeVar, RelVar)):
                raise QueryProblem(f"DELETE needs a node or relationship, not {var}")
            total += self.delete(f, var, when, cascade=c.detach)
        return f, "deleted", total

    def delete(self, f: Frame, var: str, when: Column, cascade: bool = False) -> int:
        """Close the current versions; cascade: those of a node's relationships too."""
        b = f.scope[var]
        total = 0
        if isinstance(b, NodeVar):
            keys = f.df.select(b.identity().alias("__k")).where("__k is not null").distinct()
            for label in b.labels:
                if (t := self.catalog.node(label)) is None:
                    continue
                t = with_validity(t)
                out, n = self._close(t.df, keys, t.df[t.key] == F.col("__k"), when)
                self.catalog.put_node(replace(t, df=out))
                total += n
                for r in [r for r in self.catalog.rels if cascade and label in (r.source, r.target)]:
                    x = with_validity(r)
                    df = x.df
                    for column in [x.src] * (r.source == label) + [x.dst] * (r.target == label):
                        df, _ = self._close(df, keys, df[column] == F.col("__k"), when)
                    self.catalog.put_rel(replace(x, df=df), r)
            return total
        rows = f.df.select(*(at(f"{var}.__{k}").alias(f"__{k}") for k in ("type", "src", "dst")), (at(f"{var}.__from") if b.versioned else F.lit(None).cast("timestamp_ntz")).alias("__k")).distinct()
        for t in list(self.catalog.rels):
            some = rows.where(F.col("__type") == t.type)
            if not some.limit(1).count():
                continue
            x = with_validity(t)
            on = (x.df[x.src] == F.col("__src")) & (x.df[x.dst] == F.col("__dst")) & (F.col("__k").isNull() | (x.df[FROM] == F.col("__k")))
            out, n = self._close(x.df, some, on, when)
            self.catalog.put_rel(replace(x, df=out), t)
            total += n
        return total

    @staticmethod
    def _close(df: DataFrame, keys: DataFrame, on: Column, when: Column) -> tuple[DataFrame, int]:
        met = df.join(keys.withColumn("__hit", F.lit(True)), on & df[TO].isNull(), "left")
        closed = met.select(*(F.when(F.col("__hit"), when).otherwise(F.col(TO)).alias(TO) if c == TO else F.col(f"`{c}`") for c in df.columns), F.coalesce("__hit", F.lit(False)).alias("__h"))
        out = written(closed, "closed")
        return out.drop("__h"), out.where("__h").count()

    # embeddings

    def _embed(self, compiler: Any, f: Frame, c: Clause, when: Column) -> tuple[Frame, str, int]:
        """Embed every version of the matched nodes: a property, a given text, or labels and properties in the order of
        their names. The nodes' embedding versions are replaced."""
        b = f.scope.get(c.var)
        if not isinstance(b, NodeVar):
            raise QueryProblem("EMBED needs a node")
        label = b.labels[0]
        t = with_validity(self.catalog.node(label))
        ids = f.df.select(b.identity().alias("__k")).distinct()
        rows = t.df.join(ids, t.df[t.key] == F.col("__k"), "left_semi")
        if c.text is not None:
            words = F.lit(c.text)
        elif c.prop is not None:
            words = F.col(f"`{c.prop}`").cast("string") if c.prop in t.props else F.lit(None).cast("string")
        else:
            parts = [F.concat(F.lit(f"{p}: "), F.col(f"`{p}`").cast("string")) for p in sorted(t.props)]
            words = F.concat_ws(". ", F.lit(" ".join(t.labels)), *parts)
        texts = rows.select(F.col(f"`{t.key}`").alias("node_id"), words.alias("text"), F.col(FROM).alias("valid_from"), F.col(TO).alias("valid_to")).where("text is not null")
        new = vectors.embed(texts, self.graph.embedder, self.graph.model)
        old = self.catalog.embeddings.get(label)
        if old is not None:
            new = new.unionByName(old.df.join(ids, old.df["node_id"] == F.col("__k"), "left_anti"), allowMissingColumns=True)
        table = written(new, "embeddings")
        self.catalog.embeddings[label] = EmbeddingTable(table, label)
        return f, "embedded", ids.count()


class LastOf:
    """The value that the last element of a list gives."""

    def __init__(self, var: str, over: Expr, value: Expr):
        self.var, self.over, self.value = var, over, value

