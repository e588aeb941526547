import sys
from pathlib import Path

import pyarrow as pa
import pytest
from brute import documents
from test_similar import brute_groups

from strandline.llm.common import written

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

GOOD = "The {0} has a long and proper sentence about {1}, with enough words in it to be kept by every rule that there is, number {1}.\nIt goes on for a second line about the {0} as well."


def test_stages(spark):
    rows = [(i, GOOD.format(f"thing{i} of {i * 7}", f"{i * i}-th {i}"), "a" if i % 3 else "b") for i in range(60)]
    rows += [(100, rows[0][1], "b"), (101, rows[1][1] + "\nMenu | News | Home | More.", "b"), (102, "too short.", "a"), (103, None, "a"), (104, rows[7][1] + "\nWrite to bob.smith@example.com at once, dear reader of this.", "b")]
    docs = documents(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "mixing", "packing"]
    q = stages["quality"](spark, docs, "")
    kept = {r.doc_id: r.text for r in q.collect()}
    assert q.columns == docs.columns and set(kept) == {i for i, _, _ in rows} - {102, 103}
    assert kept[101] == rows[1][1]
    d = stages["near_dedup"](spark, q, "")
    # 100 is a copy of 0 and 101 of 1; 104 is like 7 (40 of 49 shingles), the others have a sentence of their own
    assert sorted(r.doc_id for r in d.collect()) == sorted(set(brute_groups(kept).values())) == list(range(60))
    p = stages["pii"](spark, d, "")
    texts = {r.doc_id: r for r in p.collect()}
    assert all("bob.smith@" not in r.text and r.n_chars == len(r.text) for r in texts.values())
    m = stages["mixing"](spark, p, "")
    assert {r.doc_id for r in m.collect()} == set(texts) and m.columns == docs.columns
    m = written(m, "mixed")
    stream = [r.doc_id for r in m.collect()]
    out = stages["packing"](spark, m, "").collect()
    assert {r.doc_id for r in out} == set(texts)
    # the sequences hold the mixture's stream, and what comes twice comes an epoch apart
    pieces = sorted(out, key=lambda r: (r.sequence_id, r.offset))
    assert sorted(stream) == sorted(r.doc_id for r in pieces if r.start == 0)
    for part in {r.sequence_id >> 40 for r in pieces}:
        ids = [r.doc_id for r in pieces if r.sequence_id >> 40 == part and r.start == 0]
        assert ids in [stream[k : k + len(ids)] for k in range(len(stream))]
    twice = [i for i in set(stream) if stream.count(i) > 1]
    assert twice and all(stream.index(i) < len(texts) <= len(stream) - 1 - stream[::-1].index(i) for i in twice)


def test_empty(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_packing_leaves_no_words_in_the_workers(spark):
    """Idle workers count to an executor's memory while the other stages run."""
    corpus_pipeline.packing(spark, documents(spark, [(i, GOOD.format(f"thing{i}", f"{i}-th"), "a") for i in range(60)]), "").collect()

    def held(batches):
        from strandline.llm.encoding import CachedEncoder

        for b in batches:
            n = sum(len(e.known) for e in CachedEncoder._open.values())
            yield pa.RecordBatch.from_arrays([pa.array([n] * b.num_rows, pa.int64())], names=["n"])

    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}
