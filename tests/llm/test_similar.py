import random

import corpus_pipeline
import pytest
from brute import documents, empty, words

from strandline.llm import similar


def grams(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_groups(texts):
    """{id: text} -> {id: least id reachable over links of Jaccard 0.8 or more}"""
    ids, sets = sorted(texts), {i: grams(t) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    """Families of near copies on both sides of the threshold, of 1 to 400 words, and passages that many share."""
    r = random.Random(11)
    shared = [f"common{i}" for i in range(30)]
    out = []
    for _ in range(25):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([1, 4, 5, 6, 20, 60, 150, 400]))] + shared * r.randrange(2)
        for _ in range(8):
            copy = list(base)
            for _ in range(r.randrange(1 + len(base) // 30)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(5000)}"
            out.append(" ".join(copy[: len(copy) - r.randrange(1 + len(copy) // 8)]))
    return dict(enumerate([*out, None, "", " \n", out[0].upper()]))


@pytest.mark.parametrize("often", [2, 8, 10_000])
def test_groups_are_those_of_brute_force_jaccard(spark, texts, often):
    want = brute_groups(texts)
    assert 30 < len(set(want.values())) < len(texts) - 30
    rows = similar.groups(documents(spark, [(i, t, "a") for i, t in texts.items()]), one_in=1, often=often).collect()
    least = {}
    for row in rows:
        least[row.group] = min(row.doc_id, least.get(row.group, row.doc_id))
    assert {row.doc_id: least[row.group] for row in rows} == want


def test_stage_keeps_one_of_each_group(spark, texts):
    docs = documents(spark, [(i, t, "a") for i, t in texts.items()])
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_groups(texts).values()))


def test_no_rows(spark):
    assert similar.groups(empty(spark)).count() == 0


def test_distinct_texts_under_null_or_equal_ids_stay(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a, "a"), (None, b, "a"), (1, b, "a"), (2, c, "a"), (2, d, "a"), (2, d, "a"), (3, c, "b"), (None, c, "a"), (4, None, "a"), (4, None, "a")]
    kept = corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted([("None", a), ("1", b), ("2", c), ("2", d), ("4", "None")])
