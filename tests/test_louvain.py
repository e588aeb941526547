import datetime
import random

import pytest

from strandline.operators.algorithms import louvain, through_time


@pytest.mark.parametrize("kind", ["long", "string"])
def test_both_paths_agree(spark, kind):
    """Several components, self-loops, parallel edges and nodes without edges: alike in one place and by component."""
    r = random.Random(7)
    name = int if kind == "long" else str
    edges = []
    for c in range(6):
        part = range(c, 120, 8)
        edges += [(name(r.choice(part)), name(r.choice(part))) for _ in range(30)]
    edges += [(a, a) for a, _ in edges[::9]] + edges[::11]
    nodes, table = spark.createDataFrame([(name(i),) for i in range(120)], f"id {kind}"), spark.createDataFrame(edges, f"a {kind}, b {kind}")
    one, many = ({x.id: x.community for x in louvain(nodes, table, local_edges=n).collect()} for n in (200_000, 0))
    assert len(one) == 120 and one == many


@pytest.mark.parametrize("what", ["pagerank", "louvain"])
def test_through_time_alike_at_any_size(spark, what):
    """In one place, by tasks that hold the history, and time by time: nodes and edges that come and go, and come again."""
    r, day = random.Random(5), lambda d: datetime.datetime(2024, 1, d)

    def span():
        a = r.randrange(1, 4)
        return day(a), r.choice([None, day(a + r.randrange(1, 3))])

    name = "n{:02}".format
    nodes = spark.createDataFrame([(name(i % 40), *span()) for i in range(60)], "id string, since timestamp_ntz, until timestamp_ntz")
    edges = [(name(r.randrange(44)), name(r.randrange(44)), *span()) for _ in range(150)]
    edges = spark.createDataFrame(edges + edges[::5] + [(name(i), name(i), day(3), None) for i in range(5)], "a string, b string, since timestamp_ntz, until timestamp_ntz")
    one, tasks, rounds = (through_time(nodes, edges, what, every="day", **k).collect() for k in ({}, {"local_edges": 0}, {"local_edges": 0, "task_rows": 0}))
    key = lambda x: (x.id, x.valid_from, str(x.valid_to))
    assert len(one) > 60
    for other in (tasks, rounds):
        assert sorted(map(key, one)) == sorted(map(key, other))
        assert [x[1] for x in sorted(one, key=key)] == pytest.approx([x[1] for x in sorted(other, key=key)], abs=2e-6)
