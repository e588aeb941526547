import hashlib
import unicodedata

from brute import DOCS, documents, empty
from pyspark.sql import functions as F

import strandline.llm.fingerprints as P


def canon(t):
    t = unicodedata.normalize("NFKC", t or "")
    return " ".join(unicodedata.normalize("NFKC", t.upper().lower()).split())


def test_classes_and_edits(spark):
    rows = [*DOCS, (20, DOCS[0][1].upper().replace(" ", "  "), "a")]
    out = {r.doc_id: r for r in P.edited_fingerprints(documents(spark, rows)).collect()}
    rows.sort(key=lambda r: r[0])
    texts = [t or "" for _, t, _ in rows]
    for k, (i, t, _) in enumerate(rows):
        t, after = t or "", texts[(k + 1) % len(rows)]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        assert out[i].n_chars == len(t)
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert out[i].near_edited == float(canon(edited) == canon(t))
        assert out[i].near_next == float(canon(after) == canon(t))
        same = [j for j, x, _ in rows if canon(x) == canon(t)]
        assert (out[i].group_id, out[i].copies) == (min(same), len(same))
        assert all((out[j].fingerprint == out[i].fingerprint) == (j in same) for j in out)


def test_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(P, "wide_hash", lambda c: (F.length(c).cast("long"), F.lit(0).cast("long")))
    rows = [(1, "ab", "a"), (2, "cd", "a"), (3, "AB", "a"), (4, "xyz", "a")]
    out = {r.doc_id: r for r in P.fingerprints(documents(spark, rows)).collect()}
    assert out[1].fingerprint == out[3].fingerprint != out[2].fingerprint
    assert (out[3].group_id, out[2].group_id, out[2].copies) == (1, 2, 1)


def test_edges(spark):
    assert P.edited_fingerprints(empty(spark)).count() == 0
    one = P.edited_fingerprints(documents(spark, [(7, "abcd", "a")])).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    rows = [(None, "aaaa", "a"), (1, "bbbb", "a"), (1, "cccc", "a"), (2, "dddd", "a")]
    out = sorted(r.edited_sha256 for r in P.edited_fingerprints(documents(spark, rows)).collect())
    assert out == sorted(hashlib.sha256(x).hexdigest() for x in (b"aabb", b"bbcc", b"ccdd", b"ddaa"))


def test_next_over_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        ids = [i * i for i in range(200)]
        got = {r.id: r.next_id for r in P.with_next(documents(spark, [(i, str(i), "a") for i in ids])).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == dict(zip(ids, [*ids[1:], ids[0]], strict=True))


def test_ids_of_any_type(spark):
    """Successors by the order of the ids, whatever their type: the same as for numbers in the same order."""
    from strandline.llm.fingerprints import with_next

    rows = [(f"k{i:03d}", f"text {i}") for i in range(90)] + [(None, "none"), ("k005", "text 5b")]
    got = with_next(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    want = {a: b for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    assert {(r.id, r.text): (r.next_id, r.next_text) for r in got} == want and len(got) == len(rows)
