from pathlib import Path

import pytest

from strandline import queries

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.is_dir(), reason="no supplied tables")
@pytest.mark.parametrize("name", [n for n in queries.ORACLE_SQL if n.endswith("_whole")])
def test_whole_tables_like_sql(spark, name):
    db = duckdb.connect()
    for p in SF.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries.QUERIES[name](spark, str(SF))
    want = db.execute(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    rows = want.fetchall()
    mine = [tuple(r) for r in got.select(*(c[0] for c in want.description)).collect()]
    assert sorted(map(str, mine)) == sorted(map(str, rows))


@pytest.mark.skipif(not SF.is_dir(), reason="no supplied tables")
def test_all_tables_are_counted_and_exported(spark):
    nodes = {r.label: r.n for r in queries.QUERIES["s2_all_nodes"](spark, str(SF)).collect()}
    stats = {r["name"]: r.current for r in queries.QUERIES["s9_stats_whole"](spark, str(SF)).where("kind = 'node'").collect()}
    export = {r.label: r["count"] for r in queries.QUERIES["s15_export_whole"](spark, str(SF)).where("kind = 'node'").groupBy("label").count().collect()}
    assert stats == nodes == export
    kinds = {r.type for r in queries.QUERIES["s7_timeline_whole"](spark, str(SF)).select("type").distinct().collect()}
    assert "CREATE_REL" in kinds and "CREATE_NODE" in kinds
