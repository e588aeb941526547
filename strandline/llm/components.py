"""Connected components of an edge table, by rounds of large-star and small-star, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (a, b): root is the least node of its component.

    Large-star links every node's larger neighbours to its least neighbour, small-star its smaller ones; the two
    alternate until the edges are stars, after a number of rounds that grows with the logarithm of the longest path.
    Both are one aggregation and one join by node, of no more rows than there are edges; each round is a written
    table, and the rounds end as soon as one leaves stars. Loops and repeated edges are allowed.
    """
    now = written(edges.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "components")
    while True:
        both = now.unionByName(now.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m")
        large = written(both.where("b > a").join(least, "a").selectExpr("m as a", "b").where("a <> b").distinct(), "components")
        # small-star: a node's smaller neighbours, and itself, go to the least of them
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b").selectExpr("explode(array(named_struct('a', m, 'b', a), named_struct('a', m, 'b', b))) as e").select("e.*").where("a <> b").distinct()
        after = written(small, "components")
        forget(large)
        forget(now)
        now = after
        if _stars(now):
            break
    return now.selectExpr("b as node", "a as root").unionByName(now.selectExpr("a as node", "a as root").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether no node is both a centre and a leaf, and no leaf has two centres."""
    ends = edges.selectExpr("b as node", "1 as leaf", "0 as centre").unionByName(edges.selectExpr("a as node", "0 as leaf", "1 as centre"))
    return not ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 or leaf = 1 and centre = 1").limit(1).count()
