"""Reachability and paths over edge tables (a, b), by rounds of joins on a frontier.

Every round is one join of the frontier with the edges and one aggregation; longer searches write the frontier between
rounds, so that plans stay short and lost executors cost a round at most. A search ends when its frontier is empty.
Reachability over few enough edges takes no rounds: each task has all edges and searches from its share of the sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources.shared import forget, written

#: Rounds that are planned as one query; beyond them the frontier is written each round.
LAZY_ROUNDS = 3
#: Distinct edges that every task may hold, at about 20 bytes each.
TASK_EDGES = 2_000_000


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.selectExpr("b as a", "a as b"))


def reach(edges: DataFrame, sources: DataFrame, low: int = 1, high: int | None = 10, per_path: bool = False, *, task_edges: int = TASK_EDGES) -> DataFrame:
    """src, dst, depth: every node other than the source within low to high hops (None: any number), once, at its least
    distance.

    sources: one column, src. per_path: one row for each walk instead, at its length, the source included; it needs high.
    """
    edges = edges.select("a", "b")
    if not per_path:
        edges = edges.distinct()
    step = lambda level: level.join(edges, level["dst"] == edges["a"]).select("src", F.col("b").alias("dst"))
    level = sources.select("src").distinct().select("src", F.col("src").alias("dst"))
    if per_path or (high is not None and high <= LAZY_ROUNDS):
        out = None
        for depth in range(1, high + 1):
            level = step(level) if per_path else step(level).distinct()
            rows = level.withColumn("depth", F.lit(depth))
            out = rows if out is None else out.unionByName(rows)
        if per_path:
            return out.where(F.col("depth") >= low)
        return out.where("src <> dst").groupBy("src", "dst").agg(F.min("depth").alias("depth")).where(F.col("depth") >= low)
    edges = written(edges.where("a is not null and b is not null"), "edges")
    if len({f.dataType for f in (*edges.schema, level.schema["src"])}) == 1 and edges.count() <= task_edges:
        return _searched(edges, level.select("src"), low, high)
    seen = written(level.withColumn("depth", F.lit(0)), "reach")
    parts, frontier, depth = [seen._strandline_path], seen.select("src", "dst"), 0
    together = lambda: edges.sparkSession.read.schema(seen.schema).parquet(*parts)
    while high is None or depth < high:
        depth += 1
        new = step(frontier).distinct().join(together().select("src", "dst"), ["src", "dst"], "left_anti")
        now = written(new.withColumn("depth", F.lit(depth)), "reach")
        if now.limit(1).count() == 0:
            break
        parts.append(now._strandline_path)
        frontier = now.select("src", "dst")
    return together().where((F.col("src") != F.col("dst")) & (F.col("depth") >= low))


def _searched(edges: DataFrame, sources: DataFrame, low: int, high: int | None) -> DataFrame:
    """reach() by breadth-first searches in tasks that hold all edges."""
    context, kind = edges.sparkSession.sparkContext, edges.schema["a"].dataType.simpleString()
    table = edges.toArrow()
    a, b = (table.column(c).combine_chunks() for c in ("a", "b"))
    names = pa.chunked_array([a, b]).unique()
    a, b = (pc.index_in(c, value_set=names).to_numpy(zero_copy_only=False).astype(np.int32) for c in (a, b))
    first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(names)))])
    graph = context.broadcast((names, first, b[np.argsort(a, kind="stable")]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, near = graph.value
        for batch in batches:
            found = pc.index_in(batch.column(0), value_set=names).to_pylist()
            for k in [k for k, place in enumerate(found) if place is not None]:
                front, depth = np.array([found[k]]), 0
                seen = np.zeros(len(names), bool)
                seen[front] = True
                while len(front) and (high is None or depth < high):
                    depth += 1
                    sizes = first[front + 1] - first[front]
                    at = np.arange(sizes.sum()) + np.repeat(first[front] - np.cumsum(sizes) + sizes, sizes)
                    front = np.unique(near[at][~seen[near[at]]])
                    seen[front] = True
                    for i in range(0, len(front) if depth >= low else 0, 1 << 16):
                        ends = pa.array(front[i : i + (1 << 16)])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(ends), k))), names.take(ends), pa.array(np.full(len(ends), depth, np.int32))], names=["src", "dst", "depth"])

    return sources.repartition(context.defaultParallelism).mapInArrow(search, f"src {kind}, dst {kind}, depth int")


def shortest(edges: DataFrame, pairs: DataFrame, *, every: bool = False, most: int | None = None) -> DataFrame:
    """src, dst, node_ids, length: a shortest path for each pair (src, dst; src <> dst) that has one.

    Of equally short paths the one with the least ids in order is kept; every: all of them are.
    """
    edges = edges.select("a", "b").distinct()
    pairs = written(pairs.select("src", "dst").where("src <> dst").distinct(), "pairs")
    front = written(pairs.select("src").distinct().selectExpr("src", "src as node", "array(src) as node_ids"), "front")
    seen, found = front.select("src", "node"), []
    depth, open_pairs = 0, pairs
    while most is None or depth < most:
        depth += 1
        new = front.join(edges, front["node"] == edges["a"]).select("src", F.col("b").alias("node"), F.concat("node_ids", F.array("b")).alias("node_ids"))
        new = new.join(seen, ["src", "node"], "left_anti")
        if not every:
            new = new.groupBy("src", "node").agg(F.min("node_ids").alias("node_ids"))
        now = written(new, "front")
        if now.limit(1).count() == 0:
            break
        hits = written(now.join(open_pairs.withColumnRenamed("dst", "node"), ["src", "node"]).select("src", F.col("node").alias("dst"), "node_ids"), "hits")
        found.append(hits.withColumn("length", F.lit(depth)))
        open_pairs = open_pairs.join(hits, ["src", "dst"], "left_anti")
        left = written(open_pairs, "pairs")
        open_pairs = left
        if left.limit(1).count() == 0:
            break
        # sources with nothing left to find stop here
        front = now.join(left.select("src").distinct(), "src", "left_semi")
        seen = written(seen.unionByName(now.select("src", "node").distinct()), "seen")
    out = pairs.limit(0).select("src", "dst", F.array("src").alias("node_ids"), F.lit(0).alias("length"))
    for hits in found:
        out = out.unionByName(hits)
    return out


def simple_paths(edges: DataFrame, pairs: DataFrame, most: int = 10) -> DataFrame:
    """src, dst, node_ids, length: all paths of at most most edges without a repeated node, for each pair.

    Their number may grow exponentially with most; parallel edges count once.
    """
    edges = edges.select("a", "b").distinct()
    pairs = written(pairs.select("src", "dst").where("src <> dst").distinct(), "pairs")
    front = pairs.selectExpr("src", "dst", "src as node", "array(src) as node_ids")
    out = pairs.limit(0).select("src", "dst", F.array("src").alias("node_ids"), F.lit(0).alias("length"))
    for depth in range(1, most + 1):
        new = front.join(edges, front["node"] == edges["a"]).where(~F.array_contains("node_ids", F.col("b")))
        now = written(new.select("src", "dst", F.col("b").alias("node"), F.concat("node_ids", F.array("b")).alias("node_ids")), "front")
        if now.limit(1).count() == 0:
            break
        out = out.unionByName(now.where("node = dst").select("src", "dst", "node_ids", F.lit(depth).alias("length")))
        front = now.where("node <> dst")
    return out


def earliest(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """src, dst, arrival, node_ids: the earliest arrival at every node that can be reached in time.

    nodes: id, born; edges: a, b, since, until (null: open). A walk starts at its source's birth and takes an edge at
    the later of its arrival and the edge's start, if the edge hasn't ended by its arrival (ending then is in time) and
    the next node is born by then. Labels are corrected until none improves; ties go to shorter, then lesser paths.
    """
    # of open edges between two nodes, the one that starts first is as good as all
    first = edges.where("until is null").groupBy("a", "b").agg(F.min("since").alias("since"))
    edges = written(first.select("a", "b", "since", F.lit(None).cast(edges.schema["until"].dataType).alias("until")).unionByName(edges.where("until is not null").select("a", "b", "since", "until")), "edges")
    nodes = written(nodes.select("id", "born"), "births")
    births = nodes.selectExpr("id as b", "born")
    start = sources.select("src").distinct().join(nodes, F.col("src") == F.col("id")).select("src", F.col("id").alias("node"), F.struct(F.col("born").alias("arrival"), F.lit(0).alias("length"), F.array("id").alias("node_ids")).alias("best"))
    table = written(start, "labels")
    known = changed = table
    while True:
        steps = changed.join(edges, changed["node"] == edges["a"]).where("until is null or until >= best.arrival")
        steps = steps.select("src", "b", F.greatest("best.arrival", F.coalesce("since", "best.arrival")).alias("arrival"), F.col("best.length").alias("length"), F.col("best.node_ids").alias("node_ids"))
        steps = steps.join(births, "b").where("born <= arrival")
        offer = F.min(F.struct("arrival", (F.col("length") + 1).alias("length"), F.concat("node_ids", F.array("b")).alias("node_ids")))
        steps = steps.groupBy("src", F.col("b").alias("node")).agg(offer.alias("offer"))
        better = F.col("offer").isNotNull() & (F.col("best").isNull() | (F.col("offer") < F.col("best")))
        merged = known.join(steps, ["src", "node"], "full").select("src", "node", F.least("best", "offer").alias("best"), better.alias("better"))
        now = written(merged, "labels")
        forget(table)
        table, known, changed = now, now.select("src", "node", "best"), now.where("better").select("src", "node", "best")
        if changed.limit(1).count() == 0:
            return known.select("src", F.col("node").alias("dst"), F.col("best.arrival").alias("arrival"), F.col("best.node_ids").alias("node_ids")).where("src <> dst")
