"""Queries over the supplied tables, one or more for each operator, with the SQL that says the same."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import algorithms, temporal, vectors
from strandline.sources.tables import follows, table, tpch_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FOLLOWS = "follows AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, lead(ts) OVER (ORDER BY ts, event_id) AS since FROM events QUALIFY dst IS NOT NULL)"
STATES = "states AS (SELECT user_id, event_type, value, event_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events)"


def text(name: str, query: str, sql: str | None = None, params: dict | None = None, **options):
    """Register a query given as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tpch_graph(spark, sf_dir).query(query, params, **options)

    run.__doc__ = query
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def code(name: str, sql: str | None = None):
    """Register a query given as a function."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# scans

text("s1_label_scan", "MATCH (n:Nation) RETURN n.n_nationkey AS id, n.n_name AS name", "SELECT n_nationkey AS id, n_name AS name FROM nation")
text(
    "s2_all_nodes",
    "MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n",
    """SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer
    UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders
    UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'Page', count(*) FROM pages UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events
    UNION ALL SELECT 'EventType', count(DISTINCT event_type) FROM events UNION ALL SELECT 'Label', count(*) FROM labels
    UNION ALL SELECT 'Topic', count(DISTINCT label) FROM embeddings UNION ALL SELECT 'Vec', count(*) FROM embeddings""",
)
text("s3_node_by_id", "MATCH (c:Customer {c_custkey: 42}) RETURN id(c) AS id, c.c_name AS name, c.c_acctbal AS balance", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey = 42")


@code("s4_node_versions", f"WITH {STATES} SELECT event_id, event_type, valid_from, valid_to FROM states WHERE user_id = 7")
def s4_node_versions(spark, sf_dir):
    states = temporal.chain(table(spark, sf_dir, "events").withColumnRenamed("user_id", "id"), "id", "ts", ["event_id"])
    g = tpch_graph(spark, sf_dir).add_nodes(states.drop("ts"), "State", "id")
    return g.versions("State", 7).select("event_id", "event_type", "valid_from", "valid_to")


text("s5_adjacency", "MATCH (n:Nation {n_nationkey: 3})--(x) RETURN labels(x)[0] AS label, count(*) AS n", "SELECT 'Region' AS label, count(*) AS n FROM nation WHERE n_nationkey = 3 HAVING count(*) > 0 UNION ALL SELECT 'Customer', count(*) FROM customer WHERE c_nationkey = 3 HAVING count(*) > 0 UNION ALL SELECT 'Supplier', count(*) FROM supplier WHERE s_nationkey = 3 HAVING count(*) > 0")
text("s6_snapshot", "MATCH (u:User)-[s:STATE]->(e:EventType) AT TIME 1705276800 RETURN u.id AS id, e.name AS state, s.event_id AS event_id", f"WITH {STATES} SELECT user_id AS id, event_type AS state, event_id FROM states WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR TIMESTAMP '2024-01-15' < valid_to)")


@code(
    "s7_timeline",
    f"""WITH {STATES} SELECT valid_from AS timestamp, 'CREATE_REL' AS type, 'STATE ' || user_id || ' -> ' || event_type AS description FROM states
    UNION ALL SELECT valid_to, 'DELETE_REL', 'STATE ' || user_id || ' -> ' || event_type FROM states WHERE valid_to IS NOT NULL""",
)
def s7_timeline(spark, sf_dir):
    g = tpch_graph(spark, sf_dir)
    g.catalog.nodes, g.catalog.rels = [], [r for r in g.catalog.rels if r.type == "STATE"]
    return g.timeline()


text("s8_all_versions", "MATCH (u:User)-[s:STATE]->(e:EventType) RETURN e.name AS state, count(*) AS versions", "SELECT event_type AS state, count(*) AS versions FROM events GROUP BY event_type", time="all")


@code("s9_stats", f"WITH {STATES} SELECT 'relationship' AS kind, 'STATE' AS name, count(*) AS versions, count(*) - count(valid_to) AS current FROM states UNION ALL SELECT 'relationship', 'PLACED', count(*), count(*) FROM orders")
def s9_stats(spark, sf_dir):
    return tpch_graph(spark, sf_dir).stats().where("name in ('STATE', 'PLACED')")


@code("s10_debug_versions", "SELECT user_id AS id, count(*) AS n_versions, min(ts) AS first_from FROM events GROUP BY user_id")
def s10_debug_versions(spark, sf_dir):
    states = temporal.chain(table(spark, sf_dir, "events").withColumnRenamed("user_id", "id"), "id", "ts", ["event_id"])
    g = tpch_graph(spark, sf_dir).add_nodes(states, "State", "id")
    out = temporal.grouped_versions(g.catalog.node("State"))
    return out.select("id", "n_versions", F.col("versions")[0]["valid_from"].alias("first_from"))


@code("s11_embedding_load", "SELECT label AS node_id, count(*) AS versions, sum(len(embedding))::BIGINT AS numbers FROM embeddings GROUP BY label")
def s11_embedding_load(spark, sf_dir):
    df = tpch_graph(spark, sf_dir).catalog.embeddings["Topic"].df
    return df.groupBy("node_id").agg(F.count(F.lit(1)).alias("versions"), F.sum(F.size("vector")).alias("numbers"))


text("s12_unwind", "UNWIND [3, 1, 2] AS x RETURN x", "SELECT unnest([3, 1, 2])::BIGINT AS x")


@code("s13_sink", "SELECT n_nationkey, n_name FROM nation")
def s13_sink(spark, sf_dir):
    from strandline.sources.shared import written

    g = tpch_graph(spark, sf_dir)
    return written(g.catalog.node("Nation").df, "sink").select("n_nationkey", "n_name")


@code("s15_export", "SELECT 'Nation' AS label, n_nationkey::VARCHAR AS id FROM nation UNION ALL SELECT 'Region', r_regionkey::VARCHAR FROM region")
def s15_export(spark, sf_dir):
    return tpch_graph(spark, sf_dir).export().where("kind = 'node' and label in ('Nation', 'Region') and get_json_object(json, '$.n_name') is not null or label = 'Region'").select("label", "id")


# joins

text("j1_out", "MATCH (c:Customer)-[:LOCATED_IN]->(n:Nation) WHERE c.c_acctbal > 0 RETURN n.n_name AS nation, COUNT(c) AS customers", "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name")
text("j2_in", "MATCH (n:Nation)<-[:LOCATED_IN]-(s:Supplier) RETURN n.n_name AS nation, COUNT(s) AS suppliers", "SELECT n_name AS nation, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
text("j3_undirected", "MATCH (a:User)-[:FOLLOWS]-(b:User) WHERE a.id = 7 RETURN b.id AS id, COUNT(*) AS n", f"WITH {FOLLOWS} SELECT id, count(*) AS n FROM (SELECT dst AS id FROM follows WHERE src = 7 UNION ALL SELECT src FROM follows WHERE dst = 7 AND src <> dst) GROUP BY id")
text("j3_self_loops_twice", "MATCH (a:User)-[:FOLLOWS]-(b:User) WHERE a.id = 7 RETURN b.id AS id, COUNT(*) AS n", f"WITH {FOLLOWS} SELECT id, count(*) AS n FROM (SELECT dst AS id FROM follows WHERE src = 7 UNION ALL SELECT src FROM follows WHERE dst = 7) GROUP BY id", self_loops_twice=True)
text("j4_types", "MATCH (o:Order)-[r:CONTAINS|SUPPLIED_BY]->(x) WHERE o.o_orderkey < 100 RETURN type(r) AS type, count(*) AS n", "SELECT 'CONTAINS' AS type, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderkey < 100 UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderkey < 100")
text("j5_chain", "MATCH (c:Customer)-[:LOCATED_IN]->(n:Nation)-[:PART_OF]->(r:Region) RETURN r.r_name AS region, COUNT(c) AS n", "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
text("j5_four_hops", "MATCH (r:Region)<-[:PART_OF]-(n:Nation)<-[:LOCATED_IN]-(c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE p.p_size < 10 RETURN r.r_name AS region, round(sum(l.l_quantity)) AS quantity", "SELECT r_name AS region, round(sum(l_quantity)) AS quantity FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY r_name")
text("j6_target_filter", "MATCH (c:Customer)-[:LOCATED_IN]->(:Nation {n_name: 'NATION_3'}) RETURN count(c) AS n", "SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
text("j7_cartesian", "MATCH (a:Region), (b:Nation) RETURN a.r_name AS a, count(b) AS n", "SELECT r_name AS a, count(*) AS n FROM region, nation GROUP BY r_name")
text("j8_multi_match", "MATCH (c:Customer)-[:LOCATED_IN]->(n:Nation) MATCH (s:Supplier)-[:LOCATED_IN]->(n) RETURN n.n_name AS nation, count(*) AS pairs", "SELECT n_name AS nation, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
text("j9_cycle", "MATCH (a:User)-[:FOLLOWS]->(b:User)-[:FOLLOWS]->(a) WHERE a.id < b.id RETURN a.id AS a, b.id AS b, count(*) AS n", f"WITH {FOLLOWS} SELECT x.src AS a, x.dst AS b, count(*) AS n FROM follows x JOIN follows y ON x.dst = y.src AND y.dst = x.src WHERE x.src < x.dst GROUP BY 1, 2")
text("j10_optional", "MATCH (d:Document) OPTIONAL MATCH (d)-[:LABELLED]->(l:Label) WHERE l.quality = 1 RETURN d.lang AS lang, COUNT(*) AS documents, COUNT(l) AS good", "SELECT lang, count(*) AS documents, count(l.doc_id) AS good FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND quality = 1 GROUP BY lang")
text("j10_optional_alone", "OPTIONAL MATCH (n:Nation {n_name: 'nowhere'}) RETURN n.n_name AS name", "SELECT NULL::VARCHAR AS name")
text("j11_varlen_1_2", "MATCH (a:User)-[:FOLLOWS*1..2]->(b:User) WHERE a.id = 3 RETURN b.id AS id", f"WITH {FOLLOWS}, one AS (SELECT DISTINCT dst FROM follows WHERE src = 3) SELECT dst AS id FROM (SELECT dst FROM one UNION SELECT f.dst FROM one JOIN follows f ON one.dst = f.src) WHERE dst <> 3")
text("j11_varlen_exact", "MATCH (a:User)-[:FOLLOWS*2]->(b:User) WHERE a.id < 5 RETURN a.id AS a, b.id AS b", f"WITH {FOLLOWS}, e AS (SELECT DISTINCT src, dst FROM follows) SELECT DISTINCT x.src AS a, y.dst AS b FROM e x JOIN e y ON x.dst = y.src WHERE x.src < 5 AND x.src <> y.dst AND (x.src, y.dst) NOT IN (SELECT src, dst FROM e)")
text("j11_varlen_deep", "MATCH (a:User)-[:FOLLOWS*]->(b:User) WHERE a.id = 3 RETURN count(b) AS n", f"WITH RECURSIVE {FOLLOWS}, r(id) AS (SELECT 3 UNION SELECT f.dst FROM r JOIN follows f ON f.src = r.id) SELECT count(*) - 1 AS n FROM r")
text("j12_snapshot_hops", "MATCH (u:User)-[:STATE]->(e:EventType), (u)-[:FOLLOWS]->(v:User) AT TIME 1704240000 RETURN e.name AS state, count(v) AS n", f"WITH {FOLLOWS}, {STATES} SELECT event_type AS state, count(*) AS n FROM states s JOIN follows f ON s.user_id = f.src WHERE valid_from <= TIMESTAMP '2024-01-03' AND (valid_to IS NULL OR TIMESTAMP '2024-01-03' < valid_to) AND since <= TIMESTAMP '2024-01-03' GROUP BY event_type")
text("j14_inline_props", "MATCH (c:Customer {c_mktsegment: 'BUILDING', c_nationkey: 5})-[:PLACED]->(o:Order {o_orderstatus: 'O'}) RETURN count(o) AS n", "SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 5 AND o_orderstatus = 'O'")
text("j14_rel_props", "MATCH (o:Order)-[:CONTAINS {l_returnflag: 'R'}]->(p:Part) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'")
text("j15_exists", "MATCH (n:Nation) WHERE EXISTS { (n)<-[:LOCATED_IN]-(s:Supplier) WHERE s.s_acctbal > 9000 } RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
text("j15_not_exists", "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order) RETURN c.c_custkey AS id", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
text("j16_pattern_comprehension", "MATCH (n:Nation) RETURN n.n_name AS name, size([(n)<-[:LOCATED_IN]-(c:Customer) WHERE c.c_acctbal > 5000 | c.c_custkey]) AS rich", "SELECT n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 5000)::BIGINT AS rich FROM nation")


@code(
    "j17_interval_join",
    f"""WITH {STATES} SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM states a JOIN states b ON a.user_id < b.user_id AND a.user_id // 50 = b.user_id // 50
    AND a.valid_from < coalesce(b.valid_to, TIMESTAMP '2100-01-01') AND b.valid_from < coalesce(a.valid_to, TIMESTAMP '2100-01-01')
    WHERE a.event_type = 'error' AND b.event_type = 'purchase' GROUP BY 1, 2""",
)
def j17_interval_join(spark, sf_dir):
    from strandline.operators.intervals import overlap_join

    states = temporal.chain(table(spark, sf_dir, "events"), "user_id", "ts", ["event_id"]).select("user_id", "event_type", "valid_from", "valid_to", F.floor(F.col("user_id") / 50).alias("team"))
    a, b = states.where("event_type = 'error'"), states.where("event_type = 'purchase'")
    met = overlap_join(a, b, ["team"], datetime.timedelta(days=1))
    return met.where("left_user_id < right_user_id").groupBy(F.col("left_event_type").alias("a"), F.col("right_event_type").alias("b")).agg(F.count(F.lit(1)).alias("n"))


# predicates

_C = "MATCH (c:Customer) WHERE {} RETURN c.c_custkey AS id"
_S = "SELECT c_custkey AS id FROM customer WHERE {}"
for _name, _where, _sql in [
    ("p1_and_or", "c.c_acctbal > 5000 AND (c.c_mktsegment = 'BUILDING' OR c.c_nationkey = 3)", "c_acctbal > 5000 AND (c_mktsegment = 'BUILDING' OR c_nationkey = 3)"),
    ("p2_equality", "c.c_nationkey = 7 AND c.c_mktsegment <> 'MACHINERY'", "c_nationkey = 7 AND c_mktsegment <> 'MACHINERY'"),
    ("p3_ordering", "c.c_acctbal <= -500 OR c.c_name >= 'Customer#000001490'", "c_acctbal <= -500 OR c_name >= 'Customer#000001490'"),
    ("p4_text", "c.c_name STARTS WITH 'Customer#00000' AND c.c_name ENDS WITH '7' AND c.c_name CONTAINS '12'", "starts_with(c_name, 'Customer#00000') AND ends_with(c_name, '7') AND contains(c_name, '12')"),
    ("p5_not", "NOT (c.c_acctbal > 0 OR c.c_nationkey > 10)", "NOT (c_acctbal > 0 OR c_nationkey > 10)"),
    ("p6_xor", "c.c_acctbal > 0 XOR c.c_nationkey > 10", "(c_acctbal > 0) <> (c_nationkey > 10)"),
    ("p7_in", "c.c_nationkey IN [1, 2, 3] AND NOT c.c_mktsegment IN ['BUILDING', 'MACHINERY']", "c_nationkey IN (1, 2, 3) AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    ("p8_null", "c.nothing IS NULL AND c.c_name IS NOT NULL", "true"),
    ("p9_exists", "exists(c.c_acctbal) AND NOT exists(c.nothing)", "true"),
    ("p11_functions", "toUpper(substring(c.c_mktsegment, 0, 3)) = 'BUI' AND abs(c.c_acctbal) < 1000", "substr(c_mktsegment, 1, 3) = 'BUI' AND abs(c_acctbal) < 1000"),
]:
    text(_name, _C.format(_where), _S.format(_sql))

text("p10_quantifiers", "MATCH (p:Part) WITH p.p_partkey AS id, split(p.p_name, ' ') AS w RETURN id, ANY(x IN w WHERE size(x) > 6) AS a, ALL(x IN w WHERE size(x) > 3) AS b, NONE(x IN w WHERE x STARTS WITH 'a') AS c, SINGLE(x IN w WHERE x CONTAINS 'e') AS d", "SELECT id, len(list_filter(w, lambda x: length(x) > 6)) > 0 AS a, len(list_filter(w, lambda x: length(x) > 3)) = len(w) AS b, len(list_filter(w, lambda x: starts_with(x, 'a'))) = 0 AS c, len(list_filter(w, lambda x: contains(x, 'e'))) = 1 AS d FROM (SELECT p_partkey AS id, string_split(p_name, ' ') AS w FROM part)")
text("p13_similar_where", "MATCH (v:Vec) WHERE v SIMILAR TO $q THRESHOLD 0.2 RETURN v.id AS id", f"SELECT vec_id AS id FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {[round(((i * 37) % 11 - 5) / 10, 1) for i in range(64)]}::DOUBLE[]) >= 0.2", {"q": [round(((i * 37) % 11 - 5) / 10, 1) for i in range(64)]})
text("p12_bare", "MATCH (c:Customer) WITH c.c_custkey AS id, c.c_acctbal > 0 AS good WHERE good RETURN id", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0")
text("p14_path_where", "MATCH p = shortestPath((a:User)-[:FOLLOWS*]-(b:User)) WHERE a.id < 3 AND (b.id = 10 OR b.id = 12) RETURN a.id AS a, b.id AS b, length(p) AS n", f"""WITH RECURSIVE {FOLLOWS}, e AS (SELECT src AS a, dst AS b FROM follows UNION SELECT dst, src FROM follows),
    r(s, id, d) AS (SELECT src, src, 0 FROM (SELECT DISTINCT src FROM follows WHERE src < 3) UNION SELECT s, e.b, d + 1 FROM r JOIN e ON e.a = r.id WHERE d < 5)
    SELECT s AS a, id AS b, min(d) AS n FROM r WHERE id IN (10, 12) AND s <> id GROUP BY s, id""")
text("p16_params", "MATCH (c:Customer {c_nationkey: $n}) WHERE c.c_acctbal > $least AND c.c_mktsegment IN $s RETURN c.c_custkey AS id, $tag AS tag SKIP $skip", "SELECT c_custkey AS id, 'x' AS tag FROM customer WHERE c_nationkey = 4 AND c_acctbal > 100.5 AND c_mktsegment IN ('BUILDING', 'MACHINERY')", {"n": 4, "least": 100.5, "s": ["BUILDING", "MACHINERY"], "tag": "x", "skip": 0})

# projection

text("r1_project", "MATCH (s:Supplier) RETURN s.s_suppkey AS id, s.s_acctbal * 2 + 1 AS twice, s.s_name + '!' AS name, [s.s_nationkey, 1] AS l, s.s_acctbal > 0 AS positive", "SELECT s_suppkey AS id, s_acctbal * 2 + 1 AS twice, s_name || '!' AS name, [s_nationkey::BIGINT, 1] AS l, s_acctbal > 0 AS positive FROM supplier")
text("r2_names", "MATCH (r:Region) RETURN r.r_name, COUNT(r)", 'SELECT r_name AS "r.r_name", count(*) AS "COUNT(r)" FROM region GROUP BY r_name')
text("r3_star", "MATCH (r:Region) WITH r.r_name AS name, r.r_regionkey AS id RETURN *", "SELECT r_name AS name, r_regionkey AS id FROM region")
text("r4_values", "UNWIND [[1, 2, 3, 4]] AS l RETURN l[0] AS a, l[-1] AS b, l[9] AS c, l[1..3] AS d, {k: 1}.k AS e, 5 AS f, NOT true AS g, 1 < 2 AND 2 < 1 AS h", "SELECT 1::BIGINT AS a, 4::BIGINT AS b, NULL::BIGINT AS c, [2, 3]::BIGINT[] AS d, 1::BIGINT AS e, 5::BIGINT AS f, false AS g, false AS h")
text("r5_distinct", "MATCH (o:Order) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
text("r6_order_limit", "MATCH (c:Customer) RETURN c.c_custkey AS id, c.c_acctbal AS b ORDER BY b DESC, id LIMIT 20", "SELECT c_custkey AS id, c_acctbal AS b FROM customer ORDER BY b DESC, id LIMIT 20")
text("r7_nulls_last", "MATCH (d:Document) OPTIONAL MATCH (d)-[:LABELLED]->(l:Label) RETURN d.doc_id AS id, l.quality AS q ORDER BY q, id LIMIT 600", "SELECT d.doc_id AS id, quality AS q FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY q NULLS LAST, id LIMIT 600")
text("r8_skip_limit", "MATCH (p:Part) RETURN p.p_partkey AS id ORDER BY p.p_retailprice DESC, id SKIP 10 LIMIT 5", "SELECT p_partkey AS id FROM part ORDER BY p_retailprice DESC, id LIMIT 5 OFFSET 10")
text("r10_union", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
text("r11_union_all", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
text("r13_with", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, SUM(o.o_totalprice) AS t, COUNT(o) AS n WHERE t > 1000000 AND n > 5 WITH c.c_nationkey AS k, count(*) AS customers, max(n) AS most ORDER BY customers DESC, k LIMIT 7 RETURN k, customers, most", "SELECT c_nationkey AS k, count(*) AS customers, max(n) AS most FROM (SELECT c_custkey, c_nationkey, sum(o_totalprice) AS t, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 HAVING sum(o_totalprice) > 1000000 AND count(*) > 5) GROUP BY 1 ORDER BY customers DESC, k LIMIT 7")
text("r13_with_match", "MATCH (n:Nation) WITH n ORDER BY n.n_name LIMIT 3 MATCH (c:Customer)-[:LOCATED_IN]->(n) RETURN n.n_name AS name, count(c) AS n", "SELECT n_name AS name, count(*) AS n FROM (SELECT * FROM nation ORDER BY n_name LIMIT 3) JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
text("r14_unwind_where", "UNWIND range(1, 20) AS x WITH x WHERE x % 3 = 0 RETURN x, x * x AS y", "SELECT x, (x * x)::DOUBLE AS y FROM range(1, 21) t(x) WHERE x % 3 = 0")
text("r14_unwind_property", "MATCH (p:Part) WHERE p.p_partkey < 50 UNWIND split(p.p_name, ' ') AS w RETURN w, count(*) AS n", "SELECT unnest(string_split(p_name, ' ')) AS w, count(*) AS n FROM part WHERE p_partkey < 50 GROUP BY 1")

# aggregation

text("a1_count_star", "MATCH (:Order)-[:CONTAINS]->(p:Part) RETURN p.p_brand AS brand, count(*) AS n", "SELECT p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
text("a2_count_property", "MATCH (d:Document) OPTIONAL MATCH (d)-[:LABELLED]->(l:Label) RETURN d.lang AS lang, count(l.quality) AS n", "SELECT lang, count(quality) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
text("a3_count_distinct", "MATCH (c:Customer)-[:PLACED]->(:Order)-[:SUPPLIED_BY]->(s:Supplier) RETURN c.c_mktsegment AS m, count(DISTINCT s) AS suppliers, count(DISTINCT s.s_nationkey) AS nations", "SELECT c_mktsegment AS m, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT s_nationkey) AS nations FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
text("a4_a5_sum_avg", "MATCH (:Order)-[l:CONTAINS]->(:Part) RETURN l.l_returnflag AS f, l.l_linestatus AS s, round(sum(l.l_quantity)) AS q, round(avg(l.l_discount) * 10000) AS d, sum(l.nothing) AS z, count(*) AS n", "SELECT l_returnflag AS f, l_linestatus AS s, round(sum(l_quantity)) AS q, round(avg(l_discount) * 10000) AS d, 0.0::DOUBLE AS z, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
text("a6_min_max", "MATCH (p:Part) RETURN p.p_brand AS b, min(p.p_retailprice) AS low, max(p.p_retailprice) AS high, min(p.p_name) AS first", "SELECT p_brand AS b, min(p_retailprice) AS low, max(p_retailprice) AS high, min(p_name) AS first FROM part GROUP BY 1")
text("a7_collect", "MATCH (n:Nation)-[:PART_OF]->(r:Region) RETURN r.r_name AS region, collect(n.n_name) AS names", "SELECT r_name AS region, list(n_name ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
text("a8_group_expression", "MATCH (o:Order) RETURN o.o_orderdate.year AS y, left(o.o_orderpriority, 1) AS p, count(*) AS n", "SELECT year(o_orderdate) AS y, o_orderpriority[1:1] AS p, count(*) AS n FROM orders GROUP BY 1, 2")
text("a9_global_empty", "MATCH (c:Customer) WHERE c.c_custkey < 0 RETURN count(c) AS n, sum(c.c_acctbal) AS s, avg(c.c_acctbal) AS a, collect(c.c_name) AS l", "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS s, NULL::DOUBLE AS a, []::VARCHAR[] AS l")
text("a10_distinct_in", "MATCH (l:Supplier) RETURN sum(DISTINCT l.s_nationkey) AS s, avg(DISTINCT l.s_nationkey) AS a, collect(DISTINCT l.s_nationkey) AS c", "SELECT sum(DISTINCT s_nationkey)::DOUBLE AS s, avg(DISTINCT s_nationkey) AS a, list(DISTINCT s_nationkey ORDER BY s_nationkey) AS c FROM supplier")
text("a11_around", "MATCH (c:Customer) RETURN c.c_mktsegment AS m, count(c) + 1 AS n, round(sum(c.c_acctbal * 2) / count(*)) AS a", "SELECT c_mktsegment AS m, count(*) + 1.0::DOUBLE AS n, round(sum(c_acctbal * 2) / count(*)) AS a FROM customer GROUP BY 1")

# windows inside the engine

@code("wn2_islands", "WITH s AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, sum(c)::BIGINT AS runs FROM s GROUP BY user_id")
def wn2_islands(spark, sf_dir):
    from strandline.operators.intervals import compact

    states = temporal.chain(table(spark, sf_dir, "events"), "user_id", "ts", ["event_id"])
    return compact(states, ["user_id"], ["event_type"], ["event_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"))


text("wn3_version_chain", "MATCH (u:User)-[s:STATE]->(e:EventType) WHERE u.id < 20 RETURN u.id AS id, s.event_id AS event, round(duration(s) * 1000) AS days", f"WITH {STATES} SELECT user_id AS id, event_id AS event, round(epoch_us(coalesce(valid_to, TIMESTAMP '2024-02-01')) / 8.64e10 * 1000 - epoch_us(valid_from) / 8.64e10 * 1000) AS days FROM states WHERE user_id < 20", time="all")

# functions

text("f1_f15_text", "MATCH (d:Document) WHERE d.doc_id < 300 WITH d.doc_id AS id, left(d.text, 40) AS t RETURN id, toLower(t) AS lower, trim('  ' + t + ' ') AS trimmed, ltrim(' x') AS l, rtrim('x ') AS r, reverse(t) AS rev, size(t) AS n, bytesize(t) AS bytes, toString(id) AS s, substring(t, 3, 5) AS sub, replace(t, 'e', 'E') AS rep, split(t, ' ')[1] AS second, left(t, 4) AS a, right(t, 4) AS z, join(split(t, ' '), '-') AS j, t + '!' AS plus", """WITH d AS (SELECT doc_id AS id, "left"(text, 40) AS t FROM documents WHERE doc_id < 300)
    SELECT id, lower(t) AS lower, regexp_replace(t, '\\s+$', '') AS trimmed, 'x' AS l, 'x' AS r, list_aggregate(list_reverse(regexp_extract_all(t, '(?s).')), 'string_agg', '') AS rev, length(t) AS n, strlen(t) AS bytes, id::VARCHAR AS s, substring(t, 4, 5) AS sub, replace(t, 'e', 'E') AS rep, string_split(t, ' ')[2] AS second, "left"(t, 4) AS a, "right"(t, 4) AS z, array_to_string(string_split(t, ' '), '-') AS j, t || '!' AS plus FROM d""")
text("f1_upper", "MATCH (p:Part) RETURN p.p_partkey AS id, toUpper(p.p_name) AS u", "SELECT p_partkey AS id, upper(p_name) AS u FROM part")
text("f16_f19_convert", "UNWIND ['3', '3.9', 'x', '-7', 'true', 'FALSE', '1e2'] AS s RETURN s, toInteger(s) AS i, toFloat(s) AS f, toBoolean(s) AS b, coalesce(toInteger(s), -1) AS c", "SELECT * FROM (VALUES ('3', 3::BIGINT, 3.0::DOUBLE, NULL::BOOLEAN, 3::BIGINT), ('3.9', 3, 3.9, NULL, 3), ('x', NULL, NULL, NULL, -1), ('-7', -7, -7.0, NULL, -7), ('true', NULL, NULL, true, -1), ('FALSE', NULL, NULL, false, -1), ('1e2', 100, 100.0, NULL, 100)) t(s, i, f, b, c)")
text("f20_f39_math", "MATCH (c:Customer) WITH c.c_custkey AS id, c.c_acctbal AS x RETURN id, abs(x) AS a, ceil(x) AS c, floor(x) AS f, round(x) AS r, round(sqrt(abs(x)) * 1000000) AS q, sign(x) AS s, round(exp(x / 10000) * 1000000) AS e, round(log(abs(x) + 1) * 1000000) AS l, round(log10(abs(x) + 1) * 1000000) AS g, round(sin(x) * 1000000) AS si, round(cos(x) * 1000000) AS co, round(tan(x / 10000) * 1000000) AS ta, round(asin(x / 20000) * 1000000) AS asi, round(acos(x / 20000) * 1000000) AS aco, round(atan(x) * 1000000) AS ata, pow(x, 2) AS p, x ^ 2 AS h, round(pi() * 1000000) AS pi, round(e() * 1000000) AS ee, x % 7 AS m, x / 0 AS z, -x AS n, log(0) AS l0", """SELECT c_custkey AS id, abs(x) AS a, ceil(x) AS c, floor(x) AS f, round(x) AS r, round(sqrt(abs(x)) * 1000000) AS q, sign(x)::DOUBLE AS s, round(exp(x / 10000) * 1000000) AS e, round(ln(abs(x) + 1) * 1000000) AS l, round(log10(abs(x) + 1) * 1000000) AS g, round(sin(x) * 1000000) AS si, round(cos(x) * 1000000) AS co, round(tan(x / 10000) * 1000000) AS ta, round(asin(x / 20000) * 1000000) AS asi, round(acos(x / 20000) * 1000000) AS aco, round(atan(x) * 1000000) AS ata, pow(x, 2) AS p, pow(x, 2) AS h, round(pi() * 1000000) AS pi, round(exp(1.0::DOUBLE) * 1000000) AS ee, x % 7 AS m, NULL::DOUBLE AS z, -x AS n, '-Infinity'::DOUBLE AS l0 FROM (SELECT c_custkey, c_acctbal AS x FROM customer)""")
text("f36_rand", "UNWIND range(1, 5) AS x RETURN x, rand() >= 0 AND rand() < 1 AS unit", "SELECT x, true AS unit FROM range(1, 6) t(x)")
text("f41_f47_time", "UNWIND ['2024-03-05', '2023-12-31T23:59:58Z', '2024-02-29 01:02:03', 'x'] AS s RETURN s, date(s) AS d, datetime(s) AS t, s.year AS y, s.month AS mo, s.day AS da, s.hour AS h, s.minute AS mi, s.second AS se, s.millisecond AS ms, s.dayOfWeek AS w, s.dayOfYear AS yd", "SELECT * FROM (VALUES ('2024-03-05', '2024-03-05', '2024-03-05T00:00:00Z', 2024::BIGINT, 3::BIGINT, 5::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 2::BIGINT, 65::BIGINT), ('2023-12-31T23:59:58Z', '2023-12-31', '2023-12-31T23:59:58Z', 2023, 12, 31, 23, 59, 58, 0, 0, 365), ('2024-02-29 01:02:03', '2024-02-29', '2024-02-29T01:02:03Z', 2024, 2, 29, 1, 2, 3, 0, 4, 60), ('x', NULL, 'x', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)) t(s, d, t, y, mo, da, h, mi, se, ms, w, yd)")
text("f41_now", "RETURN timestamp() AS ms, date() AS d, datetime() AS t, localtime() AS l", "SELECT 1706745600000::BIGINT AS ms, '2024-02-01' AS d, '2024-02-01T00:00:00Z' AS t, '00:00:00' AS l")
text("f44_f46_local", "MATCH (n:Nation) RETURN n.n_name AS name, localdatetime(n.n_name) AS ld, time(n.n_name) AS t, localdatetime() AS now, time() AS clock", "SELECT n_name AS name, n_name AS ld, n_name AS t, '2024-02-01T00:00:00' AS now, '00:00:00' AS clock FROM nation")
text("f48_f54_entities", "MATCH (n:Nation)-[r:PART_OF]->(x:Region) RETURN id(n) AS id, labels(n) AS l, type(r) AS t, keys(n) AS k, startNode(r) AS a, endNode(r) AS b, properties(x).r_name AS p, exists(n.nothing) AS e, elementId(x) AS xi", "SELECT n_nationkey AS id, ['Nation'] AS l, 'PART_OF' AS t, ['n_name', 'n_nationkey', 'n_regionkey'] AS k, n_nationkey AS a, n_regionkey AS b, r_name AS p, false AS e, r_regionkey AS xi FROM nation JOIN region ON n_regionkey = r_regionkey")
text("l1_l3_lists", "UNWIND range(3, 1, -1) AS x RETURN x, range(1, x) AS up, range(x, 1) AS wrong, [y IN range(1, 6) WHERE y % 2 = 0 | y * x] AS c, [x, x + 1] AS l", "SELECT x, list_transform(range(1, x + 1), lambda v: v) AS up, CASE WHEN x = 1 THEN [1::BIGINT] ELSE [] END AS wrong, [2.0 * x, 4.0 * x, 6.0 * x]::DOUBLE[] AS c, [x, x + 1]::DOUBLE[] AS l FROM (VALUES (3::BIGINT), (2), (1)) t(x)")
text("l6_case", "MATCH (c:Customer) RETURN c.c_custkey AS id, CASE WHEN c.c_acctbal > 5000 THEN 'rich' WHEN c.c_acctbal > 0 THEN 'fine' ELSE 'poor' END AS a, CASE c.c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS b", "SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_acctbal > 0 THEN 'fine' ELSE 'poor' END AS a, CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS b FROM customer")


# mutations: the result is the state after them

def mutated(name: str, changes: list[str], query: str, sql: str, params: dict | None = None, versioned: bool = True, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = tpch_graph(spark, sf_dir)
        g.mutations.versioned = versioned
        for c in changes:
            g.query(c, params)
        return g.query(query, params, **options)

    run.__doc__ = "; ".join([*changes, query])
    QUERIES[name], ORACLE_SQL[name] = run, sql


mutated("m1_create", ["CREATE (a:Nation {n_nationkey: 100, n_name: 'NEW', n_regionkey: 1})-[:PART_OF]->(b:Region {r_regionkey: 50, r_name: 'MARS'})"], "MATCH (n:Nation)-[:PART_OF]->(r:Region) RETURN n.n_name AS n, r.r_name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'NEW', 'MARS'")
mutated("m1_create_at_time", ["CREATE (a:Nation {n_nationkey: 100, n_name: 'OLD'}) AT TIME 1672531200"], "MATCH (n:Nation) AT TIME 1675209600 RETURN n.n_name AS n", "SELECT n_name AS n FROM nation UNION ALL SELECT 'OLD'")
mutated("m2_match_create", ["MATCH (c:Customer {c_nationkey: 3}) CREATE (c)-[:KNOWS {since: 2024}]->(x:Friend {name: c.c_name})"], "MATCH (c:Customer)-[k:KNOWS]->(f:Friend) RETURN c.c_custkey AS id, f.name AS name, k.since AS since", "SELECT c_custkey AS id, c_name AS name, 2024::BIGINT AS since FROM customer WHERE c_nationkey = 3")
mutated("m3_merge", ["MERGE (n:Nation {n_name: 'NATION_1'}) ON CREATE SET n.hit = 1 ON MATCH SET n.hit = 2", "MERGE (r:Planet {name: 'MARS'}) ON CREATE SET r.hit = 1 ON MATCH SET r.hit = 2", "MERGE (r:Planet {name: 'MARS'}) ON CREATE SET r.hit = 1 ON MATCH SET r.hit = 2"], "MATCH (n:Nation) WHERE n.hit IS NOT NULL RETURN n.n_name AS name, n.hit AS hit UNION ALL MATCH (p:Planet) RETURN p.name AS name, p.hit AS hit", "SELECT 'NATION_1' AS name, 2::BIGINT AS hit UNION ALL SELECT 'MARS', 2")
mutated("m4_set", ["MATCH (c:Customer) WHERE c.c_acctbal < 0 SET c.c_acctbal = 0, c.c_mktsegment = 'DEBT ' + c.c_mktsegment"], "MATCH (c:Customer) RETURN c.c_mktsegment AS m, count(*) AS n, round(sum(c.c_acctbal)) AS s", "SELECT CASE WHEN c_acctbal < 0 THEN 'DEBT ' ELSE '' END || c_mktsegment AS m, count(*) AS n, round(sum(greatest(c_acctbal, 0))) AS s FROM customer GROUP BY 1")
mutated("m4_set_history", ["MATCH (n:Nation {n_nationkey: 2}) SET n.n_name = 'X'"], "MATCH (n:Nation) WHERE n.n_nationkey < 4 RETURN n.n_nationkey AS id, n.n_name AS name", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 4 UNION ALL SELECT 2, 'X'", time="all")
mutated("m4_set_in_place", ["MATCH (n:Nation {n_nationkey: 2}) SET n.n_name = 'X'"], "MATCH (n:Nation) WHERE n.n_nationkey < 4 RETURN n.n_nationkey AS id, n.n_name AS name", "SELECT n_nationkey AS id, CASE WHEN n_nationkey = 2 THEN 'X' ELSE n_name END AS name FROM nation WHERE n_nationkey < 4", versioned=False, time="all")
mutated("m5_remove", ["MATCH (s:Supplier) WHERE s.s_acctbal < 0 REMOVE s.s_acctbal"], "MATCH (s:Supplier) RETURN count(s) AS n, count(s.s_acctbal) AS kept", "SELECT count(*) AS n, count(*) FILTER (s_acctbal >= 0) AS kept FROM supplier")
mutated("m6_delete", ["MATCH (s:Supplier) WHERE s.s_nationkey < 5 DELETE s"], "MATCH (n:Nation) OPTIONAL MATCH (s:Supplier)-[:LOCATED_IN]->(n) RETURN n.n_nationkey AS n, count(s) AS s", "SELECT n_nationkey AS n, count(s_suppkey) AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_nationkey >= 5 GROUP BY 1")
mutated("m6_detach_delete_at_time", ["MATCH (n:Nation {n_nationkey: 3}) DETACH DELETE n AT TIME 1685577600"], "MATCH (c:Customer)-[:LOCATED_IN]->(n:Nation) RETURN n.n_nationkey AS n, count(c) AS c UNION ALL MATCH (n:Nation) AT TIME 1675209600 RETURN -1 AS n, count(n) AS c", "SELECT c_nationkey AS n, count(*) AS c FROM customer WHERE c_nationkey <> 3 GROUP BY 1 UNION ALL SELECT -1, count(*) FROM nation")
mutated("m7_foreach", ["MATCH (r:Region) FOREACH (x IN [1, 2, 3] | SET r.last = x * 10)"], "MATCH (r:Region) RETURN r.r_name AS name, r.last AS last", "SELECT r_name AS name, 30.0::DOUBLE AS last FROM region")


@code("m9_transaction", "SELECT n_nationkey AS id, CASE WHEN n_nationkey = 1 THEN 'kept' ELSE n_name END AS name FROM nation")
def m9_transaction(spark, sf_dir):
    g = tpch_graph(spark, sf_dir)
    try:
        with g.transaction() as tx:
            tx.set_property("Nation", 2, "n_name", "lost")
            raise RuntimeError("rolled back")
    except RuntimeError:
        pass
    with g.transaction() as tx:
        tx.set_property("Nation", 1, "n_name", "kept")
    return g.query("MATCH (n:Nation) RETURN n.n_nationkey AS id, n.n_name AS name")


@code("m8_single_mutations", "SELECT n_nationkey AS id, CASE WHEN n_nationkey = 3 THEN NULL ELSE n_name END AS name FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 100, 'made'")
def m8_single_mutations(spark, sf_dir):
    g = tpch_graph(spark, sf_dir)
    g.create_node("Nation", {"n_nationkey": 100, "n_name": "made"})
    g.remove_property("Nation", 3, "n_name")
    g.delete_node("Nation", 4)
    return g.query("MATCH (n:Nation) RETURN n.n_nationkey AS id, n.n_name AS name")


@code("m8_create_rel", "SELECT r_name AS region, count(*) + CASE WHEN r_regionkey = 1 THEN 1 ELSE 0 END AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def m8_create_rel(spark, sf_dir):
    g = tpch_graph(spark, sf_dir)
    g.create_rel("PART_OF", ("Nation", 0), ("Region", 1))
    return g.query("MATCH (n:Nation)-[:PART_OF]->(r:Region) RETURN r.r_name AS region, count(n) AS n")


@code("j13_p15_transaction_reads", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 2 AND n_name <> 'NATION_3' GROUP BY r_name")
def j13_p15_transaction_reads(spark, sf_dir):
    with tpch_graph(spark, sf_dir).transaction() as tx:
        tx.set_property("Nation", 2, "n_name", "seen inside")
        return tx.query("MATCH (n:Nation)-[:PART_OF]->(r:Region) WHERE n.n_name <> 'seen inside' AND n.n_name <> 'NATION_3' RETURN r.r_name AS region, count(n) AS n")


mutated("m10_embed", ["MATCH (r:Region) EMBED r.r_name"], "MATCH (r:Region) SIMILAR TO 'ASIA' LIMIT 1 RETURN r.r_name AS name, round(similarity) AS s", "SELECT 'ASIA' AS name, 1.0::DOUBLE AS s")

# algorithms


@code("g1_pagerank")
def g1_pagerank(spark, sf_dir):
    return tpch_graph(spark, sf_dir).query("CALL pagerank({label: 'User'}) YIELD node, score RETURN node.id AS id, score")


def _pagerank_sql(rounds: int, links: str = FOLLOWS) -> str:
    steps = [f"WITH {links}", "n AS (SELECT DISTINCT user_id AS id FROM events)", "e AS (SELECT src, dst, count(*) AS w FROM follows GROUP BY 1, 2)", "d AS (SELECT src, sum(w) AS k FROM e GROUP BY 1)", "r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS s FROM n)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS (SELECT n.id, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce(c.s, 0) + (SELECT coalesce(sum(s), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM d)) / (SELECT count(*) FROM n)) AS s FROM n LEFT JOIN (SELECT e.dst, sum(r.s * e.w / d.k) AS s FROM e JOIN r{i} r ON e.src = r.id JOIN d ON d.src = e.src GROUP BY 1) c ON c.dst = n.id)")
    return ", ".join(steps) + f" SELECT id, round(s, 6) AS score FROM r{rounds}"


text("g1_pagerank_rounds", "CALL pagerank({label: 'User', iterations: 3}) YIELD node, score RETURN node.id AS id, score", _pagerank_sql(3))


@code("g1_pagerank_distributed", _pagerank_sql(3))
def g1_pagerank_distributed(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return algorithms.pagerank(events.selectExpr("user_id as id").distinct(), follows(events).selectExpr("src as a", "dst as b"), rounds=3, local_edges=0)


text("g2_louvain", "CALL louvain({label: 'User'}) YIELD node, community RETURN node.id AS id, community")
text("p17_call_where", "CALL pagerank({label: 'User', iterations: 3}) YIELD node, score WHERE score > 0.0071 RETURN node.id AS id, score", f"SELECT * FROM ({_pagerank_sql(3)}) WHERE score > 0.0071")
text("g3_pagerank_at_time", "CALL pagerank({label: 'User', iterations: 3}) YIELD node, score AT TIME 1704240000 RETURN node.id AS id, score", _pagerank_sql(3, FOLLOWS.replace("follows AS", "every AS") + ", follows AS (SELECT * FROM every WHERE since <= TIMESTAMP '2024-01-03')"))
text("g4_pagerank_through_time", "CALL pagerank({label: 'User', every: 'day'}) YIELD node, score, valid_from, valid_to THROUGH TIME RETURN node.id AS id, score, valid_from, valid_to")
text("g4_louvain_through_time", "CALL louvain({label: 'User', every: 'week'}) YIELD node, community, valid_from, valid_to THROUGH TIME RETURN node.id AS id, community, valid_from, valid_to")
_BFS = f"WITH RECURSIVE {FOLLOWS}, e AS (SELECT src AS a, dst AS b FROM follows UNION SELECT dst, src FROM follows), r(s, id, d) AS (SELECT src, src, 0 FROM (SELECT DISTINCT src FROM follows WHERE src < 4) UNION SELECT s, e.b, d + 1 FROM r JOIN e ON e.a = r.id WHERE d < 5)"
text("g5_shortest", "MATCH p = shortestPath((a:User)-[:FOLLOWS*]-(b:User)) WHERE a.id < 4 RETURN a.id AS a, b.id AS b, length(p) AS n", f"{_BFS} SELECT s AS a, id AS b, min(d) AS n FROM r WHERE s <> id GROUP BY s, id")
text("g6_all_shortest", "MATCH p = allShortestPaths((a:User {id: 1})-[:FOLLOWS*]-(b:User)) WHERE b.id < 30 RETURN b.id AS b, length(p) AS n, count(*) AS paths", f"""WITH RECURSIVE {FOLLOWS}, e AS (SELECT src AS a, dst AS b FROM follows UNION SELECT dst, src FROM follows), p(id, d, path) AS (SELECT 1, 0, [1] UNION ALL SELECT e.b, d + 1, list_append(path, e.b) FROM p JOIN e ON e.a = p.id WHERE d < 2 AND NOT list_contains(path, e.b)),
    b AS (SELECT id, min(d) AS n FROM p GROUP BY id) SELECT p.id AS b, b.n AS n, count(*) AS paths FROM p JOIN b ON p.id = b.id AND p.d = b.n WHERE p.id < 30 AND p.id <> 1 GROUP BY 1, 2""")
text("g6_all_simple", "MATCH p = allSimplePaths((a:Nation {n_nationkey: 1})-[*..2]-(b:Nation)) RETURN b.n_nationkey AS b, length(p) AS n, count(*) AS paths", "SELECT y.n_nationkey AS b, 2 AS n, count(*) AS paths FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey WHERE x.n_nationkey = 1 AND y.n_nationkey <> 1 GROUP BY 1")
text("g7_earliest", "MATCH p = earliestPath((a:User {id: 1})-[:FOLLOWS*]->(b:User)) RETURN b.id AS b, arrival_time AS arrival", f"""WITH RECURSIVE {FOLLOWS}, e AS (SELECT src, dst, min(since) AS since FROM follows GROUP BY 1, 2),
    r(id, t) AS (SELECT 1, TIMESTAMP '1970-01-01' UNION SELECT e.dst, greatest(e.since, r.t) FROM r JOIN e ON e.src = r.id)
    SELECT id AS b, strftime(min(t), '%Y-%m-%dT%H:%M:%SZ') AS arrival FROM r WHERE id <> 1 GROUP BY id""")


@code("g8_path_exists", "SELECT true AS found, true AS own")
def g8_path_exists(spark, sf_dir):
    g = tpch_graph(spark, sf_dir)
    return spark.createDataFrame([(g.path_exists("Nation", 1, 2), g.path_exists("Nation", 1, 1))], "found boolean, own boolean")


# vectors

_Q = [round(((i * 37) % 11 - 5) / 10, 1) for i in range(64)]
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[])"


@code("v1_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def v1_cosine(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    a, b = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(vectors.cosine(F.col("x"), F.col("y")), 6).alias("s"))


text("v2_top_k", "MATCH (v:Vec) SIMILAR TO $q LIMIT 10 RETURN v.id AS id, round(similarity * 1000000) AS s", f"SELECT vec_id AS id, round({_COS} * 1000000) AS s FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10", {"q": _Q})
text("v2_threshold", "MATCH (v:Vec) SIMILAR TO $q LIMIT 50 THRESHOLD 0.2 RETURN v.id AS id", f"SELECT vec_id AS id FROM (SELECT vec_id, {_COS} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 50) WHERE s >= 0.2", {"q": _Q})
text("v3_versions", "MATCH (t:Topic) SIMILAR TO $q VERSIONS THROUGH TIME LIMIT 40 THRESHOLD 0.05 RETURN t.id AS id, round(similarity * 1000000) AS s, valid_from", f"SELECT label AS id, round({_COS} * 1000000) AS s, TIMESTAMP '2024-01-01' + to_seconds(vec_id) AS valid_from FROM embeddings WHERE {_COS} >= 0.05 ORDER BY {_COS} DESC LIMIT 40", {"q": _Q})
text("v4_drift", "MATCH (t:Topic) SIMILAR TO $q DRIFT THROUGH TIME RETURN t.id AS id, valid_from, round(drift_from_previous * 1000000) AS p, round(drift_from_first * 1000000) AS f", "SELECT label AS id, TIMESTAMP '2024-01-01' + to_seconds(vec_id) AS valid_from, round(coalesce(1 - list_cosine_similarity(embedding::DOUBLE[], (lag(embedding) OVER w)::DOUBLE[]), 0) * 1000000) AS p, round((1 - list_cosine_similarity(embedding::DOUBLE[], (first_value(embedding) OVER w)::DOUBLE[])) * 1000000) AS f FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)", {"q": _Q})


@code("v5_vector_at", "SELECT label AS node_id, round(max_by(embedding, vec_id)[1]::DOUBLE, 5) AS x FROM embeddings WHERE vec_id <= 300 GROUP BY label")
def v5_vector_at(spark, sf_dir):
    df = tpch_graph(spark, sf_dir).catalog.embeddings["Topic"].df
    return vectors.vector_at(df, datetime.datetime(2024, 1, 1, 0, 5)).select("node_id", F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("x"))


# services that have a counterpart


@code("x6_validate", "SELECT true AS good, false AS bad")
def x6_validate(spark, sf_dir):
    from strandline.graph import Graph
    from strandline.plans.lexer import SyntaxProblem

    def good(t: str) -> bool:
        try:
            Graph.validate(t)
        except SyntaxProblem:
            return False
        return True

    return spark.createDataFrame([(good("MATCH (n) RETURN n"), good("MATCH (n RETURN n"))], "good boolean, bad boolean")




# the same over whole tables and texts, beside the queries above that take a part of them

for _name, _cuts, _options in [
    ("f1_f15_text", [(" WHERE d.doc_id < 300", ""), ("left(d.text, 40) AS t", "d.text AS t"), ('"left"(text, 40) AS t', "text AS t"), (" WHERE doc_id < 300", "")], {}),
    ("wn3_version_chain", [(" WHERE u.id < 20", ""), (" WHERE user_id < 20", "")], {"time": "all"}),
    ("r14_unwind_property", [(" WHERE p.p_partkey < 50", ""), (" WHERE p_partkey < 50", "")], {}),
    ("j4_types", [(" WHERE o.o_orderkey < 100", ""), (" WHERE o_orderkey < 100", "")], {}),
    ("j11_varlen_exact", [(" WHERE a.id < 5", ""), ("x.src < 5 AND ", "")], {}),
    ("g6_all_shortest", [(" WHERE b.id < 30", ""), ("p.id < 30 AND ", "")], {}),
    ("r7_nulls_last", [(" LIMIT 600", "")], {}),
]:
    _query, _sql = QUERIES[_name].__doc__ or "", ORACLE_SQL[_name]
    for _cut, _instead in _cuts:
        _query, _sql = _query.replace(_cut, _instead), _sql.replace(_cut, _instead)
    text(f"{_name}_whole", _query, _sql, **_options)


@code("s7_timeline_whole")
def s7_timeline_whole(spark, sf_dir):
    return tpch_graph(spark, sf_dir).timeline()


@code("s9_stats_whole")
def s9_stats_whole(spark, sf_dir):
    return tpch_graph(spark, sf_dir).stats()


@code("s15_export_whole")
def s15_export_whole(spark, sf_dir):
    return tpch_graph(spark, sf_dir).export()
