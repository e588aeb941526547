"""PageRank and community detection on edge tables (a, b), and both through time.

A graph of at most local_edges edges (checked by a count) is computed in one place with NumPy; larger ones by rounds of
joins and aggregations over written tables. Through time, the snapshots of a larger graph are dealt to tasks.
"""

from __future__ import annotations

import datetime
import hashlib
from collections import defaultdict
from collections.abc import Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandline.sources.shared import forget, written

DAMPING, ROUNDS, TOLERANCE, PASSES, LOCAL_EDGES = 0.85, 20, 1e-6, 10, 200_000
#: Rows of a graph's history that a task holds, at about 100 bytes each.
TASK_ROWS = 8_000_000


def _ranks(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Scores of nodes 0 to n - 1; edges from a to b, each w times."""
    degree = np.bincount(a, w, n)
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        given = np.bincount(b, rank[a] / degree[a] * w, n) if len(a) else np.zeros(n)
        new = (1 - damping) / n + damping * (given + rank[degree == 0].sum() / n)
        change = np.abs(new - rank).sum()
        rank = new
        if change < tolerance:
            break
    return rank


def local_pagerank(ids: list, pairs: list[tuple], damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> dict:
    """Scores by id, rounded to six places; pairs: edges between ids, parallel ones repeated; others are left out."""
    n = len(ids)
    if not n:
        return {}
    place = {v: k for k, v in enumerate(ids)}
    inside = [(place[a], place[b]) for a, b in pairs if a in place and b in place]
    a, b = (np.array(x, np.int64) for x in (zip(*inside, strict=True) if inside else ([], [])))
    rank = _ranks(n, a, b, np.ones(len(a)), damping, rounds, tolerance)
    return {v: round(float(r), 6) for v, r in zip(ids, rank, strict=True)}


def pagerank(nodes: DataFrame, edges: DataFrame, *, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """id, score for each of nodes (id): parallel edges weigh, a node without edges out gives to all alike, scores are
    rounded to six places. Edges to or from other nodes are left out."""
    spark = nodes.sparkSession
    kind = nodes.schema["id"].dataType.simpleString()
    members = nodes.select("id").distinct()
    inside = edges.join(members.withColumnRenamed("id", "a"), "a", "left_semi").join(members.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    weights = written(inside.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")), "edges")
    if weights.count() <= local_edges and members.limit(local_edges + 1).count() <= local_edges:
        ids = [r.id for r in members.orderBy("id").collect()]
        pairs = [(r.a, r.b) for r in weights.collect() for _ in range(r.w)]
        return spark.createDataFrame(list(local_pagerank(ids, pairs, damping, rounds, tolerance).items()), f"id {kind}, score double")
    degrees = weights.groupBy("a").agg(F.sum("w").alias("degree"))
    shares = written(weights.join(degrees, "a").select("a", "b", (F.col("w") / F.col("degree")).alias("share")), "shares")
    n = members.count()
    now = written(members.join(degrees, members["id"] == degrees["a"], "left").select("id", F.col("a").isNull().alias("dangling"), F.lit(1 / n).alias("score"), F.lit(1.0).alias("change")), "ranks")
    for _ in range(rounds):
        # one scan of the last round gives the mass to spread
        spread = now.where("dangling").agg(F.sum("score")).first()[0] or 0.0
        given = now.join(shares, now["id"] == shares["a"]).groupBy("b").agg(F.sum(F.col("score") * F.col("share")).alias("given"))
        score = F.lit((1 - damping) / n + damping * spread / n) + damping * F.coalesce("given", F.lit(0.0))
        new = written(now.join(given, now["id"] == given["b"], "left").select("id", "dangling", score.alias("score"), F.abs(score - F.col("score")).alias("change")), "ranks")
        forget(now)
        now = new
        if now.agg(F.sum("change")).first()[0] < tolerance:
            break
    return now.select("id", F.round("score", 6).alias("score"))


def local_louvain(ids: list, pairs: list[tuple], passes: int = PASSES, total: float | None = None) -> dict:
    """Communities by id from the local moves of Louvain's method: nodes in the order of their ids move to the
    neighbouring community with the largest gain of modularity, the least one of equals, until a pass moves none.
    Communities are numbered by first appearance. Edges are undirected, parallel ones weigh. total: the edges of the
    whole graph, where ids are a part of it; by default those given."""
    ids = sorted(ids)
    place = {v: k for k, v in enumerate(ids)}
    near: list[dict[int, float]] = [defaultdict(float) for _ in ids]
    found = 0.0
    for a, b in pairs:
        if a in place and b in place:
            i, j = place[a], place[b]
            found += 1
            near[i][j] += 1
            near[j][i] += 1
    total = found if total is None else total
    degree = [sum(x.values()) for x in near]
    home, weight = list(range(len(ids))), list(degree)
    for _ in range(passes if total else 0):
        moved = False
        for i, mine in enumerate(near):
            links: dict[int, float] = defaultdict(float)
            for j, w in mine.items():
                if j != i:
                    links[home[j]] += w
            old = home[i]
            weight[old] -= degree[i]
            gain = lambda c: links.get(c, 0.0) - degree[i] * weight[c] / (2 * total)  # noqa: B023, E731
            best = min(links, key=lambda c: (-gain(c), c), default=old)
            if gain(best) <= gain(old) + 1e-12:
                best = old
            weight[best] += degree[i]
            home[i] = best
            moved |= best != old
        if not moved:
            break
    number: dict[int, int] = {}
    return {v: number.setdefault(home[k], len(number)) for k, v in enumerate(ids)}


def _homes(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """local_louvain's communities of nodes 0 to n - 1, each move over arrays; edges between a and b, each w times."""
    total, degree = w.sum(), np.bincount(a, w, n) + np.bincount(b, w, n)
    other = a != b
    a, b, w = a[other], b[other], w[other].astype(np.float64)
    ends = np.concatenate([a, b])
    order = np.argsort(ends, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))])
    near, far = np.concatenate([b, a])[order], np.concatenate([w, w])[order]
    del ends, order
    home, weight, links = np.arange(n), degree.astype(np.float64), np.zeros(n)
    movable = np.flatnonzero(np.diff(start)).tolist()
    for _ in range(passes):
        moved = False
        for i in movable:
            at = slice(start[i], start[i + 1])
            old, around = home[i], home[near[at]]
            weight[old] -= degree[i]
            np.add.at(links, around, far[at])
            gain = links[around] - degree[i] * weight[around] / (2 * total)
            most = gain.max()
            best = around[gain == most].min()
            if most <= links[old] - degree[i] * weight[old] / (2 * total) + 1e-12:
                best = old
            links[around] = 0
            weight[best] += degree[i]
            home[i] = best
            moved |= bool(best != old)
        if not moved:
            break
    _, first, number = np.unique(home, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[number]


def louvain(nodes: DataFrame, edges: DataFrame, *, passes: int = PASSES, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """id, community (long), numbered by first appearance in the order of ids. Communities never cross components, so a larger graph is split into its components and
    each is computed in a task, by the whole graph's number of edges; a component must fit into one."""
    spark = nodes.sparkSession
    kind = nodes.schema["id"].dataType.simpleString()
    members = nodes.select("id").distinct()
    inside = written(edges.join(members.withColumnRenamed("id", "a"), "a", "left_semi").join(members.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"), "edges")
    total = inside.count()
    if total <= local_edges and members.limit(local_edges + 1).count() <= local_edges:
        found = local_louvain([r.id for r in members.collect()], [(r.a, r.b) for r in inside.collect()], passes)
        return spark.createDataFrame(list(found.items()), f"id {kind}, community long")
    roots = components(members, inside)
    # a row without b is a node, any other an edge
    rows = inside.join(roots, inside["a"] == roots["id"]).select("root", "a", "b").unionByName(roots.selectExpr("root", "id as a", f"cast(null as {kind}) as b"))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, ids, pairs = None, [], []
        for b in batches:
            for r, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                root = r
                ids.append(x) if y is None else pairs.append((x, y))
        members, least = local_louvain(ids, pairs, passes, total), {}
        for i in sorted(members):
            least.setdefault(members[i], i)
        yield pa.RecordBatch.from_arrays([pa.array(list(members), t), pa.array([least[c] for c in members.values()], t)], names=["id", "least"])

    t = to_arrow_type(nodes.schema["id"].dataType)
    parts = written(rows.groupBy("root").applyInArrow(one, f"id {kind}, least {kind}"), "communities")
    # numbers by first appearance in the order of ids: row numbers by ranges, offset by the rows of the ranges before
    firsts = parts.select("least").distinct().orderBy("least").select("least", F.spark_partition_id().alias("part"))
    firsts = written(firsts.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("least"))), "firsts")
    sizes = firsts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbers = firsts.join(F.broadcast(offsets), "part").select("least", (F.col("before") + F.col("k") - 1).cast("long").alias("community"))
    return parts.join(numbers, "least").select("id", "community")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, root: the least id that can be reached, edges taken both ways; by large-star and small-star rounds."""
    now = written(edges.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "stars")
    before = None
    while True:
        both = now.unionByName(now.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m")
        large = both.where("b > a").join(least, "a").selectExpr("m as a", "b").where("a <> b").distinct()
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b").selectExpr("inline(array(struct(m as a, a as b), struct(m as a, b as b)))").where("a <> b").distinct()
        now = written(small, "stars")
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if mark == before:
            break
        before = mark
    leaves = now.selectExpr("b as id", "a as root")
    return nodes.select("id").join(leaves, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def intervals(snapshots: list[tuple[Hashable, dict]], changed) -> list[tuple]:
    """(id, value, from, to): values folded over snapshots (time, {id: value}) in the order of time.

    An interval opens where an id appears or its value has changed from the one the interval opened with, and closes
    at the snapshot that shows it; to is None for the last ones.
    """
    open_at: dict = {}
    out = []
    for time, values in snapshots:
        for i in [i for i in open_at if i not in values]:
            value, since = open_at.pop(i)
            out.append((i, value, since, time))
        for i, value in values.items():
            if i not in open_at:
                open_at[i] = (value, time)
            elif changed(open_at[i][0], value):
                old, since = open_at[i]
                out.append((i, old, since, time))
                open_at[i] = (value, time)
    return out + [(i, value, since, None) for i, (value, since) in open_at.items()]


def through_time(nodes: DataFrame, edges: DataFrame, what: str, *, every: str = "second", most: int = 10_000, local_edges: int = LOCAL_EDGES, task_rows: int = TASK_ROWS) -> DataFrame:
    """id, score or community, valid_from, valid_to: an algorithm at every time the graph changes.

    nodes: id, since, until; edges: a, b, since, until. Times are cut to every (second, hour, day ...). An interval
    closes when its node goes, its score moves by more than 1e-4 from where it opened, or the set of members of its
    community changes. Beyond local_edges edges the times are dealt to tasks, each of which holds the graph's whole
    history; beyond task_rows rows of it, parallel edges of one time counted once, each time is computed by itself, as
    pagerank() and louvain() do. Member sets are then compared by 128-bit hashes. Raises ValueError beyond most times:
    then ask for a coarser unit.
    """
    cut = lambda c: F.date_trunc(every, c).cast("timestamp_ntz")
    bounds = nodes.select("since", "until").unionByName(edges.select("since", "until"))
    times = [r.t for r in bounds.select(F.explode(F.array(cut("since"), cut("until"))).alias("t")).where("t is not null").distinct().orderBy("t").limit(most + 1).collect()]
    if len(times) > most:
        raise ValueError(f"the graph has more than {most} times")
    kind, value = nodes.schema["id"].dataType.simpleString(), "score double" if what == "pagerank" else "community long"
    fields = f"id {kind}, {value}, valid_from timestamp_ntz, valid_to timestamp_ntz"
    if not times:
        return nodes.sparkSession.createDataFrame([], fields)
    if edges.limit(local_edges + 1).count() > local_edges or nodes.limit(local_edges + 1).count() > local_edges:
        return _folded(_snapshots(nodes, edges, times, what, cut, task_rows), times, fields)
    nodes_at = [(r.id, r.f, r.u) for r in nodes.select("id", cut("since").alias("f"), cut("until").alias("u")).collect()]
    edges_at = [(r.a, r.b, r.f, r.u) for r in edges.select("a", "b", cut("since").alias("f"), cut("until").alias("u")).collect()]
    snapshots = []
    for t in times:
        ids = sorted({i for i, f, u in nodes_at if f <= t and (u is None or t < u)})
        pairs = [(a, b) for a, b, f, u in edges_at if f <= t and (u is None or t < u)]
        if what == "pagerank":
            snapshots.append((t, local_pagerank(ids, pairs)))
        else:
            found = local_louvain(ids, pairs)
            members = defaultdict(set)
            for i, c in found.items():
                members[c].add(i)
            snapshots.append((t, {i: (c, frozenset(members[c])) for i, c in found.items()}))
    if what == "pagerank":
        return nodes.sparkSession.createDataFrame(intervals(snapshots, lambda a, b: abs(a - b) > 1e-4), fields)
    rows = [(i, v[0], f, u) for i, v, f, u in intervals(snapshots, lambda a, b: a[1] != b[1])]
    return nodes.sparkSession.createDataFrame(rows, fields)


def _snapshots(nodes: DataFrame, edges: DataFrame, times: list[datetime.datetime], what: str, cut, task_rows: int) -> DataFrame:
    """id, k, value, mark: the algorithm's values at times[k]; mark: a hash of the members of the id's community."""
    spark = nodes.sparkSession
    kind, arrow_kind = nodes.schema["id"].dataType.simpleString(), to_arrow_type(nodes.schema["id"].dataType)
    value, arrow_value = ("double", pa.float64()) if what == "pagerank" else ("long", pa.int64())
    span = [cut("since").alias("f"), cut("until").alias("u")]
    spans = written(nodes.where("id is not null").select("id", *span).distinct(), "nodes")
    weights = written(edges.groupBy("a", "b", *span).agg(F.count(F.lit(1)).alias("w")), "edges")
    if spans.count() + weights.count() > task_rows:
        parts = []
        for k, t in enumerate(times):
            now = F.coalesce(F.col("f") <= F.lit(t), F.lit(True)) & (F.col("u").isNull() | (F.col("u") > F.lit(t)))
            members, links = spans.where(now).select("id").distinct(), weights.where(now).select("a", "b", F.explode(F.expr("sequence(1L, w)"))).select("a", "b")
            if what == "pagerank":
                out = pagerank(members, links).select("id", F.col("score").alias("value"), F.lit(None).cast("binary").alias("mark"))
            else:
                found = written(louvain(members, links).withColumnRenamed("community", "value"), "communities")
                both = [F.bit_xor(F.xxhash64("id", F.lit(seed))) for seed in (0, 1)]
                out = found.join(found.groupBy("value").agg(F.concat_ws(" ", F.count(F.lit(1)), *both).cast("binary").alias("mark")), "value").select("id", "value", "mark")
            parts.append(written(out.select("id", F.lit(k).alias("k"), "value", "mark"), "snapshot"))
        return spark.read.schema(parts[0].schema).parquet(*(p._strandline_path for p in parts))
    # every group has all rows and each groups-th time, so that late and early times are mixed
    groups = min(len(times), spark.sparkContext.defaultParallelism)
    rows = spans.selectExpr("id as a", f"cast(null as {kind}) as b", "f", "u", "0L as w").unionByName(weights)
    rows = rows.select("a", "b", "f", "u", "w", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    moments = np.array(times, "datetime64[us]").astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, near, far, numbers, group = [], [], [], [], None
        for x in batches:
            if not x.num_rows:
                continue
            a, b, f, u, w, g = x.columns
            group = g[0].as_py()
            f, u = (pc.fill_null(c.cast(pa.int64()), end).to_numpy(zero_copy_only=False) for c, end in ((f, moments[0]), (u, moments[-1] + 1)))
            w = w.to_numpy(zero_copy_only=False)
            held = np.stack([np.searchsorted(moments, f), np.searchsorted(moments, u), w]).astype(np.int32)
            node = w == 0
            ids.append((a.filter(pa.array(node)), held[:2, node]))
            near.append(a.filter(pa.array(~node)))
            far.append(b.filter(pa.array(~node)))
            numbers.append(held[:, ~node])
        if group is None:
            return
        named = pa.concat_arrays([i for i, _ in ids])
        names = named.unique()
        names = names.take(pc.sort_indices(names))
        place = lambda c: pc.fill_null(pc.index_in(c, value_set=names), -1).to_numpy(zero_copy_only=False)
        owner, (begin, end) = place(named), np.concatenate([h for _, h in ids], axis=1)
        a, b = (np.concatenate([place(c) for c in column]) for column in (near, far))
        since, until, w = np.concatenate(numbers, axis=1)
        del ids, near, far, numbers, named
        for k in range(group, len(times), groups):
            here = np.unique(owner[(begin <= k) & (k < end)])
            if not len(here):
                continue
            # one more place, for ends that aren't nodes
            inner = np.full(len(names) + 1, -1, np.int32)
            inner[here] = np.arange(len(here))
            on = (since <= k) & (k < until)
            x, y = inner[a[on]], inner[b[on]]
            inside = (x >= 0) & (y >= 0)
            x, y, times_each = x[inside], y[inside], w[on][inside]
            if what == "pagerank":
                values, marks = _ranks(len(here), x, y, times_each), pa.nulls(len(here), pa.binary())
                values = pa.array([round(v, 6) for v in values.tolist()], arrow_value)
            else:
                found = _homes(len(here), x, y, times_each)
                order = np.argsort(found, kind="stable")
                members = np.split(here[order].astype(np.int64), np.flatnonzero(np.diff(found[order])) + 1)
                marks = pa.array([hashlib.blake2b(m.tobytes(), digest_size=16).digest() for m in members], pa.binary()).take(pa.array(found))
                values = pa.array(found, arrow_value)
            out = pa.RecordBatch.from_arrays([names.take(pa.array(here)), pa.array(np.full(len(here), k, np.int32)), values, marks], names=["id", "k", "value", "mark"])
            yield from (out.slice(i, 1 << 16) for i in range(0, len(here), 1 << 16))

    return rows.repartitionById(groups, F.col("g")).mapInArrow(run, f"id {kind}, k int, value {value}, mark binary")


def _folded(values: DataFrame, times: list[datetime.datetime], fields: str) -> DataFrame:
    """intervals() over rows of id, k, value and mark, of which an id's are in one task, in order."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, 0

        def closed(until: int) -> tuple:
            i, value, _, since = now
            return i, value, times[since], times[until] if until < len(times) else None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", values_name, "valid_from", "valid_to"])

        for b in batches:
            kinds, out = [b.schema.field(0).type, b.schema.field(2).type, pa.timestamp("us"), pa.timestamp("us")], []
            for i, k, value, mark in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now[0] != i or k > last + 1 or (abs(now[1] - value) > 1e-4 if mark is None else now[2] != mark):
                    if now is not None:
                        out.append(closed(last + 1))
                    now = (i, value, mark, k)
                last = k
            if out:
                yield table(out)
        if now is not None:
            yield table([closed(last + 1)])

    values_name = fields.split(", ")[1].split(" ")[0]
    return values.repartition("id").sortWithinPartitions("id", "k").mapInArrow(fold, fields)
