import random

import pytest
from brute import DOCS, components, documents, empty, fingerprint
from pyspark.sql import functions as F

from strandline.llm import simhash as S


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(spark):
    out = {r.doc_id: r.fingerprint for r in S.near_duplicates(documents(spark)).collect()}
    assert out == {i: f"{fingerprint(t):016x}" for i, t, _ in DOCS}


def test_components_of_documents(spark):
    out = {r.doc_id: r.component_id for r in S.near_duplicates(documents(spark)).collect()}
    assert out == components({i: fingerprint(t) for i, t, _ in DOCS})


@pytest.mark.parametrize(("radius", "dense"), [(2, 64), (2, 3), (1, 64), (1, 3), (2, 1)])
def test_links_close_like_all_pairs(spark, radius, dense):
    r = random.Random(radius * 10 + dense)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(r.choice([1, 1, 2, 3])):
                x ^= 1 << r.randrange(64)
    fps = sorted(fps)
    got = S.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), radius, dense).collect()

    def closure(pairs):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return {x: find(x) for x in fps}

    real = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= radius]
    mine = [(p.a % (1 << 64), p.b % (1 << 64)) for p in got]
    assert closure(mine) == closure(real)
    # every pair once, however fine the grid becomes
    assert len(mine) == len(real) and {frozenset(p) for p in mine} == {frozenset(p) for p in real}


def test_bound_is_below_hamming(spark):
    r = random.Random(5)
    rows = [(signed(r.getrandbits(64)), signed(r.getrandbits(64))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", F.expr(S._embedding("a")).alias("x"), F.expr(S._embedding("b")).alias("y"))
    for row in df.select("a", "b", F.expr(S._manhattan("x", "y")).alias("m")).collect():
        a, b = row.a % (1 << 64), row.b % (1 << 64)
        want = sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2))
        assert row.m == want <= (a ^ b).bit_count()


def test_empty_nulls_repeats(spark):
    assert S.near_duplicates(empty(spark)).count() == 0
    rows = [(None, "a b c", "a"), (5, "a b c", "a"), (5, "a b c", "a"), (None, None, "a")]
    out = S.near_duplicates(documents(spark, rows)).collect()
    assert len(out) == 4
    assert sorted(r.component_id for r in out if r.fingerprint != "0" * 16) == [5, 5, 5]
