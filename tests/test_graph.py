import datetime

import pytest
from strandline.graph import Graph
from strandline.operators import algorithms, paths
from strandline.operators.intervals import compact, overlap_join
from strandline.plans import patterns
from strandline.plans.expressions import QueryProblem

T0 = datetime.datetime(2023, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def people(spark):
    """Six persons in a network with two shortest ways from Alice to Frank, one company."""
    g = Graph(spark, clock=datetime.datetime(2024, 1, 1))
    names = ["Alice", "Bob", "Carol", "Dave", "Eve", "Frank"]
    g.add_nodes(spark.createDataFrame([(i, n, 20 + 5 * i) for i, n in enumerate(names)], "id long, name string, age long"), "Person")
    g.add_nodes(spark.createDataFrame([(0, "Acme", 1990)], "id long, name string, founded long"), "Company")
    knows = [(0, 1), (1, 2), (0, 3), (3, 4), (2, 5), (4, 5), (1, 3)]
    g.add_rels(spark.createDataFrame([(a, b, 2000 + a) for a, b in knows], "src long, dst long, since long"), "KNOWS", "Person", "Person")
    g.add_rels(spark.createDataFrame([(0, 0, "dev"), (2, 0, "boss")], "src long, dst long, role string"), "WORKS_AT", "Person", "Company")
    return g


def test_patterns(people):
    q = lambda t, **k: rows(people.query(t, k))
    assert q("MATCH (a:Person {name: $n})-[:KNOWS]->(b) RETURN b.name AS b", n="Alice") == [("Bob",), ("Dave",)]
    assert q("MATCH (:Person)-[w:WORKS_AT]->(c) RETURN w.role AS r, labels(c) AS l") == [("boss", ["Company"]), ("dev", ["Company"])]
    assert q("MATCH (a {name: 'Acme'}) RETURN labels(a)[0] AS l") == [("Company",)]
    assert q("MATCH (a:Person)-[:KNOWS]->(b)-[:KNOWS]->(c), (a)-[:KNOWS]->(c) RETURN a.name AS a, c.name AS c") == [("Alice", "Dave")]
    assert q("MATCH (a:Person)-[:KNOWS]->(b) MATCH (b)-[:WORKS_AT]->(c) RETURN a.name AS a, c.name AS c") == [("Bob", "Acme")]
    assert q("MATCH (a:Person) WHERE NOT (a)-[:KNOWS]->() RETURN a.name AS a") == [("Frank",)]
    assert q("MATCH (a:Person), (c:Company) RETURN count(*) AS n") == [(6,)]
    assert q("MATCH (a:Nobody)-[:KNOWS]->(b) RETURN a.name AS a") == []
    assert q("OPTIONAL MATCH (a:Person {name: 'Zed'}) RETURN a.name AS a") == [(None,)]
    assert q("MATCH (a:Person) OPTIONAL MATCH (a)-[w:WORKS_AT]->(c) RETURN a.name AS a, w.role AS r, c.name AS c")[0] == ("Alice", "dev", "Acme")
    assert q("MATCH (a:Person {id: 0})-[:KNOWS*1..2]->(b) RETURN b.name AS b") == [("Bob",), ("Carol",), ("Dave",), ("Eve",)]
    assert q("MATCH (a:Person {id: 0})-[:KNOWS*2]->(b) RETURN b.name AS b") == [("Carol",), ("Eve",)]
    assert q("MATCH (a:Person {id: 0})-[:KNOWS*]->(b) RETURN count(b) AS n") == [(5,)]
    assert q("MATCH (a:Person {id: 0})-[*1..2]->(b) RETURN count(b) AS n") == [(5,)]


def test_paths(people):
    q = lambda t, **k: rows(people.query(t, k))
    assert q("MATCH p = shortestPath((a:Person {id: 0})-[:KNOWS*]-(b:Person {id: 5})) RETURN length(p) AS n, nodes(p) AS ids") == [(3, [0, 1, 2, 5])]
    assert q("MATCH p = shortestPath((a:Person {id: 5})-[:KNOWS*]-(b:Person {id: 0})) RETURN length(p) AS n") == [(3,)]
    assert len(q("MATCH p = allShortestPaths((a:Person {id: 0})-[:KNOWS*]-(b:Person {id: 5})) RETURN p")) == 2
    assert {len(i[0]) for i in q("MATCH p = allSimplePaths((a:Person {id: 0})-[:KNOWS*..3]-(b:Person {id: 5})) RETURN nodes(p) AS ids")} == {4}
    assert q("MATCH p = shortestPath((a:Person {id: 0})-[:WORKS_AT*]-(b:Person {id: 5})) RETURN p") == []
    assert people.path_exists("Person", 5, 0) and people.path_exists("Person", 1, 1)


def test_projection_and_aggregates(people):
    q = lambda t, **k: [tuple(r) for r in people.query(t, k).collect()]
    assert q("MATCH (p:Person) RETURN p.name AS n ORDER BY p.age DESC SKIP 1 LIMIT 2") == [("Eve",), ("Dave",)]
    assert q("MATCH (p:Person) WITH p, p.age AS a ORDER BY a LIMIT 2 RETURN collect(p.name) AS l, sum(a) + 1 AS s") == [(["Alice", "Bob"], 46.0)]
    assert q("MATCH (p:Person) RETURN count(p.nothing) AS a, count(*) AS b, avg(p.age) AS c, sum(p.nothing) AS d, min(p.name) AS e") == [(0, 6, 32.5, 0.0, "Alice")]
    assert q("UNWIND [1, 2, 3] AS x RETURN x UNION UNWIND [2, 3, 4] AS x RETURN x").__len__() == 4
    assert q("UNWIND [1, 2] AS x RETURN x UNION ALL UNWIND [2, 3] AS x RETURN x").__len__() == 4
    assert q("UNWIND [null, 2, 1] AS x RETURN x ORDER BY x") == [(1,), (2,), (None,)]
    assert q("UNWIND [null, 2, 1] AS x RETURN x ORDER BY x DESC") == [(None,), (2,), (1,)]
    assert q("MATCH (p:Person) RETURN p.age > 30 AS old, count(*) AS n ORDER BY n, old") == [(False, 3), (True, 3)]


def test_deliberate_deviations(people):
    """Three-valued logic, typed equality, and clauses that the language has but the original ignores."""
    q = lambda t, **k: [tuple(r) for r in people.query(t, k).collect()]
    assert q("MATCH (p:Person) WHERE p.nothing > 25 RETURN p") == []
    assert q("MATCH (p:Person) WHERE p.nothing = p.nothing RETURN p") == []
    assert q("UNWIND [1] AS x RETURN x = 1.0 AS a, null = null AS b, true XOR false AS c") == [(True, None, True)]
    assert q("MATCH (p:Person) RETURN p.age AS a ORDER BY a LIMIT 0") == []
    with pytest.raises(QueryProblem):
        people.query("MATCH (p:Person) RETURN q.name AS n")
    with pytest.raises(QueryProblem):
        people.query("MATCH (p:Person) RETURN frobnicate(p.name) AS n")
    with pytest.raises(QueryProblem):
        people.query("MATCH (p:Person) WHERE p.age RETURN p")
    with pytest.raises(QueryProblem):
        people.query("MATCH (p:Person) RETURN p.name AS a, p.age AS a")


def test_versions(spark):
    g = Graph(spark, clock=T0)
    g.query("CREATE (p:Person {name: 'Ann', role: 'dev'}) AT TIME 1672531200")
    g.clock = datetime.datetime(2023, 3, 1)
    g.query("MATCH (p:Person) SET p.role = 'lead'")
    g.query("MATCH (p:Person) SET p.role = 'lead'")  # no change, no version
    g.clock = datetime.datetime(2023, 6, 1)
    g.query("MATCH (p:Person) REMOVE p.role")
    role = lambda t: [r.r for r in g.query("MATCH (p:Person) RETURN p.role AS r", time=t).collect()]
    assert role(datetime.datetime(2022, 12, 25)) == []
    assert role(datetime.datetime(2023, 2, 1)) == ["dev"]
    assert role(datetime.datetime(2023, 3, 1)) == ["lead"], "closed below, open above"
    assert role(None) == [None]
    assert len(role("all")) == 3
    g.query("MATCH (p:Person) DELETE p")
    assert role(None) == [] and role(datetime.datetime(2023, 4, 1)) == ["lead"]
    assert [r.t for r in g.query("MATCH (p:Person) AT TIME EARLIEST RETURN p.role AS t").collect()] == ["dev"]
    assert g.timeline().count() == 6


def test_mutations(people):
    q = lambda t, **k: rows(people.query(t, k))
    assert q("MATCH (c:Company) CREATE (p:Person {id: 9, name: 'Zoe'})-[:WORKS_AT {role: 'ceo'}]->(c)") == [(2,)]
    assert q("MATCH (p:Person)-[w:WORKS_AT]->(c:Company) WHERE w.role = 'ceo' RETURN p.name AS n, c.name AS c") == [("Zoe", "Acme")]
    for _ in range(2):
        q("MERGE (t:Tag {name: 'x'}) ON CREATE SET t.n = 1 ON MATCH SET t.n = 2")
    assert q("MATCH (t:Tag) RETURN t.name AS n, t.n AS k") == [("x", 2)]
    assert q("UNWIND ['x', 'y', 'y'] AS v MERGE (t:Tag {name: v}) RETURN v, t.n AS n") == [("x", 2), ("y", None), ("y", None)]
    assert q("UNWIND [0, 1] AS i MATCH (p:Person {id: i}) RETURN p.name AS n") == [("Alice",), ("Bob",)]
    for _ in range(2):
        q("MATCH (p:Person {id: 0}), (t:Tag) MERGE (p)-[:LIKES]->(t)")
    assert q("MATCH (p)-[:LIKES]->(t) RETURN p.name AS p, t.name AS t") == [("Alice", "x"), ("Alice", "y")]
    q("MATCH (t:Tag {name: 'y'}) DETACH DELETE t")
    q("MATCH (t:Tag) FOREACH (v IN [5, 6, 7] | SET t.n = v)")
    assert q("MATCH (t:Tag) RETURN t.n AS n") == [(7,)]
    assert q("MATCH (p:Person {name: 'Alice'}) DETACH DELETE p") == [(1,)]
    assert q("MATCH (a)-[:KNOWS]->(b) RETURN count(*) AS n") == [(5,)]
    q("MATCH (:Person {name: 'Bob'})-[k:KNOWS]->(:Person {name: 'Carol'}) SET k.since = 1")
    assert q("MATCH (a)-[k:KNOWS]->(b) WHERE k.since = 1 RETURN a.name AS a, b.name AS b") == [("Bob", "Carol")]
    q("MATCH (:Person {name: 'Bob'})-[k:KNOWS]->(:Person {name: 'Carol'}) DELETE k")
    assert q("MATCH (a)-[k:KNOWS]->(b) WHERE k.since = 1 RETURN a") == []
    with pytest.raises(RuntimeError), people.transaction() as tx:
        tx.query("MATCH (p:Person) DELETE p")
        raise RuntimeError
    assert q("MATCH (p:Person) RETURN count(p) AS n") == [(6,)]


def test_pagerank(spark):
    star = [(i, 0) for i in range(1, 6)]
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    edges = spark.createDataFrame(star, "a long, b long")
    here = dict(algorithms.pagerank(nodes, edges).collect())
    there = dict(algorithms.pagerank(nodes, edges, local_edges=0).collect())
    assert here == pytest.approx(there, abs=2e-6)
    assert max(here, key=here.get) == 0 and sum(here.values()) == pytest.approx(1, abs=1e-5)
    assert algorithms.pagerank(nodes.limit(0), edges).count() == 0


def test_louvain(spark):
    cliques = [(a + k, b + k) for k in (0, 10) for a, b in ((0, 1), (1, 2), (0, 2))]
    nodes = spark.createDataFrame([(i,) for i in (0, 1, 2, 10, 11, 12)], "id long")
    edges = spark.createDataFrame(cliques, "a long, b long")
    for local in (1000, 0):
        found = dict(algorithms.louvain(nodes, edges, local_edges=local).collect())
        assert found[0] == found[1] == found[2] != found[10] == found[11] == found[12]


def test_through_time(spark):
    t = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    nodes = spark.createDataFrame([(1, t[0], None), (2, t[0], t[2])], "id long, since timestamp_ntz, until timestamp_ntz")
    edges = spark.createDataFrame([(1, 2, t[1], None)], "a long, b long, since timestamp_ntz, until timestamp_ntz")
    out = rows(algorithms.through_time(nodes, edges, "pagerank", every="day"))
    assert [(r[0], r[2], r[3]) for r in out] == [(1, t[1], t[2]), (1, t[0], t[1]), (1, t[2], None), (2, t[0], t[1]), (2, t[1], t[2])] or len(out) == 5
    assert {r[3] for r in out if r[0] == 2} == {t[1], t[2]}


def test_earliest(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    nodes = spark.createDataFrame([(i, day(1)) for i in range(4)], "id long, born timestamp_ntz")
    edges = spark.createDataFrame([(0, 1, day(5), None), (1, 2, day(2), day(4)), (0, 3, day(3), None), (3, 2, day(4), day(4)), (3, 1, day(4), None)], "a long, b long, since timestamp_ntz, until timestamp_ntz")
    out = {r.dst: (r.arrival, r.node_ids) for r in paths.earliest(nodes, edges, spark.createDataFrame([(0,)], "src long")).collect()}
    assert out == {1: (day(4), [0, 3, 1]), 2: (day(4), [0, 3, 2]), 3: (day(3), [0, 3])}


def test_intervals(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    a = spark.createDataFrame([(1, "x", day(1), day(5)), (1, "y", day(5), None), (2, "z", day(1), None)], "k long, v string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    b = spark.createDataFrame([(1, "p", day(4), day(6)), (1, "q", day(5), day(5)), (3, "r", day(1), None)], "k long, v string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    met = overlap_join(a, b, ["k"], datetime.timedelta(days=2)).select("left_v", "right_v")
    assert rows(met) == [("x", "p"), ("y", "p")]
    c = spark.createDataFrame([(1, "x", day(1), day(2)), (1, "x", day(2), day(3)), (1, "y", day(3), day(4)), (1, "x", day(4), None)], "k long, v string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    assert rows(compact(c, ["k"], ["v"])) == [(1, "x", day(1), day(3)), (1, "x", day(4), None), (1, "y", day(3), day(4))]


def test_embeddings(spark):
    g = Graph(spark, clock=T0)
    for i, name in enumerate(["backend engineer", "frontend developer"]):
        g.query("CREATE (p:Person {id: $i, role: $r}) AT TIME 1672531200", {"i": i, "r": name})
    g.clock = datetime.datetime(2023, 5, 1)
    g.query("MATCH (p:Person {id: 0}) SET p.role = 'frontend developer'")
    g.query("MATCH (p:Person) EMBED p.role")
    q = lambda t: rows(g.query(t))
    assert q("MATCH (p:Person) SIMILAR TO 'frontend developer' THRESHOLD 0.99 RETURN p.id AS id") == [(0,), (1,)]
    assert q("MATCH (p:Person) SIMILAR TO 'backend engineer' VERSIONS THROUGH TIME THRESHOLD 0.99 RETURN p.id AS id, valid_to AS t") == [(0, datetime.datetime(2023, 5, 1))]
    drift = q("MATCH (p:Person {id: 0}) SIMILAR TO 'backend engineer' DRIFT THROUGH TIME RETURN valid_from AS f, round(drift_from_previous) AS d")
    assert [d for _, d in drift] == [0.0, 1.0]
    assert q("MATCH (p:Person) WHERE p SIMILAR TO 'frontend developer' THRESHOLD 0.9 AND p.id > 0 RETURN p.id AS id") == [(1,)]


def test_stream_to_versions(spark, tmp_path):
    from strandline.streaming.version_log import append_log, versions, windowed_counts

    schema = "id long, at timestamp_ntz, role string"
    day = lambda d: datetime.datetime(2024, 1, d)
    spark.createDataFrame([(1, day(1), "dev"), (1, day(5), "boss")], schema).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    append_log(stream(), str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([(1, day(3), "lead")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    append_log(stream(), str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination()
    g = Graph(spark, clock=day(9))
    g.catalog.put_node(versions(spark, str(tmp_path / "log"), "id", "at", "Person", schema))
    assert rows(g.query("MATCH (p:Person) AT TIME '2024-01-04' RETURN p.role AS r")) == [("lead",)]
    assert rows(g.query("MATCH (p:Person) RETURN p.role AS r")) == [("boss",)]
    zoned = spark.readStream.schema("id long, at timestamp, role string").parquet(str(tmp_path / "in"))
    out = windowed_counts(zoned, "at", "role", width="1 day").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.sql("select sum(n) from counts").first()[0] == 3


def test_reach_without_bound(spark):
    """A chain longer than ten hops, a way back, a self-loop and nodes off it: alike in tasks and by rounds."""
    pairs = [(i, i + 1) for i in range(14)] + [(14, 3), (5, 5), (5, 6), (20, 21)]
    edges, sources = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(0,), (12,), (99,)], "src long")
    for low, high in ((1, None), (4, 12)):
        want = []
        for s in (0, 12):
            depth, front = {s: 0}, [s]
            while front:
                front = list({b for a, b in pairs if a in front and b not in depth})
                depth |= dict.fromkeys(front, max(depth.values()) + 1)
            want += [(s, n, d) for n, d in depth.items() if low <= d <= (high or 99)]
        for most in (1000, 0):
            assert rows(paths.reach(edges, sources, low, high, task_edges=most)) == sorted(want, key=str)
    g = Graph(spark)
    g.add_nodes(spark.createDataFrame([(i,) for i in range(15)], "id long"), "Stop", "id")
    g.add_rels(spark.createDataFrame(pairs[:14], "src long, dst long"), "NEXT", "Stop", "Stop")
    ask = lambda hops, **k: rows(g.query(f"MATCH (a:Stop {{id: 0}})-[:NEXT{hops}]->(b) RETURN count(b) AS n", **k))
    assert (ask("*"), ask("*12.."), ask("*..10"), ask("*", per_path=True)) == ([(14,)], [(3,)], [(10,)], [(10,)])


def test_searches_start_where_conditions_hold(spark, monkeypatch):
    g = Graph(spark)
    g.add_nodes(spark.createDataFrame([(i,) for i in range(9)], "id long"), "Stop", "id")
    g.add_rels(spark.createDataFrame([(i, i + 1) for i in range(8)], "src long, dst long"), "NEXT", "Stop", "Stop")
    seen, reach = [], patterns.reach
    monkeypatch.setattr(patterns, "reach", lambda links, start, *a: seen.append(rows(start)) or reach(links, start, *a))
    assert rows(g.query("MATCH (a)-[:NEXT*]->(b) WHERE a.id = 3 AND b.id > 5 RETURN a.id AS a, b.id AS b")) == [(3, 6), (3, 7), (3, 8)]
    assert seen == [[(3,)]]
