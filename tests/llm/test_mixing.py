import math
import random
from collections import Counter, defaultdict

import pytest
from brute import documents, empty, words

from strandline.llm.mixing import mix, temperature


def corpus(seed=1):
    r = random.Random(seed)
    sizes = {"big": 300, "mid": 60, "small": 9, None: 20, "one": 1}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * r.choice([0, 1, 5, 30])), s))
            i += 1
    r.shuffle(rows)
    return rows


def sums(rows):
    t = Counter()
    for _, x, s in rows:
        t[s] += max(1, len(words(x)))
    return t


@pytest.mark.parametrize("options", [{"repetition_limit": 3.0}, {"repetition_limit": None, "target_entropy": 0.9}, {"repetition_limit": 2.0, "total_tokens": 5000.0}, {"repetition_limit": None}])
def test_budgets(spark, options):
    rows = corpus()
    t = sums(rows)
    total = sum(t.values())
    df = spark.createDataFrame([(s, n, 1) for s, n in t.items()], "source string, tokens long, docs long")
    m = temperature(df, **options)
    weight = {r.source: r.weight for r in m.weights.collect()}
    z = sum((n / total) ** m.alpha for n in t.values())
    assert all(math.isclose(weight[s], (n / total) ** m.alpha / z) for s, n in t.items())
    if options.get("target_entropy"):
        assert math.isclose(-sum(w * math.log(w) for w in weight.values()), 0.9, abs_tol=1e-6)
    seen = defaultdict(Counter)
    text = {i: (x, s) for i, x, s in rows}
    out = mix(documents(spark, rows), block_docs=20, **options).collect()
    for r in out:
        seen[r.source][r.doc_id] += 1
    for s, n in t.items():
        budget = weight[s] * m.total
        took = sum(k * max(1, len(words(text[i][0]))) for i, k in seen[s].items())
        assert budget - 30 < took <= budget + 1e-3, (s, budget, took)
        counts = {seen[s][i] for i, (_, x) in text.items() if x == s}
        assert max(counts) - min(counts) <= 1, "whole epochs, then part of one"
        if options.get("repetition_limit") and not options.get("total_tokens"):
            assert min(counts) >= 1 and budget / n <= options["repetition_limit"] * (1 + 1e-9)
    key = [(r.source, r.epoch, r.block_order, r.doc_order) for r in out]
    assert len(set(key)) == len(key)


def test_edges(spark):
    assert mix(empty(spark)).count() == 0
    assert mix(documents(spark, corpus()).selectExpr("*", "1 as whole", "2 as salt", "3 as tokens", "4 as place")).columns[-7:] == ["whole", "salt", "tokens", "place", "epoch", "block_order", "doc_order"]
    one = mix(documents(spark, [(1, None, None), (1, None, None), (None, "a", None)]).withColumnRenamed("lang", "epoch")).collect()
    assert len(one) == 3 and {r.epoch for r in one} == {0}
    a = sorted(tuple(r) for r in mix(documents(spark, corpus()), seed=3).collect() if r.source)
    b = sorted(tuple(r) for r in mix(documents(spark, corpus()).repartition(3), seed=3).collect() if r.source)
    assert a == b
