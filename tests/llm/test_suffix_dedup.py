import hashlib
import random
from collections import Counter

import pytest
from brute import DOCS, documents, empty

from strandline.llm.suffix_dedup import remove_repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        rest = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    noise = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared = [noise(r.choice([39, 40, 41, 60, 120, 300])) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [noise(r.randrange(80))]
        for _ in range(r.randrange(4)):
            s = r.choice(shared)
            a = r.randrange(0, max(1, len(s) - 30))
            parts += [s[a:] if r.random() < 0.5 else s, noise(r.randrange(1, 40))]
        texts.append("".join(parts))
    near = noise(500)
    for _ in range(12):
        x = list(near)
        x[r.randrange(len(x))] = "X"
        texts.append("".join(x))
    return [*texts, texts[0], texts[0], "ab" * 300, "a" * 500, "b" * 45, None, "", near + near]


@pytest.mark.parametrize(("seed", "most"), [(1, 50_000), (2, 50_000), (3, 2)])
def test_against_brute_force(spark, seed, most):
    texts = corpus(seed)
    out = remove_repeats(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]).repartition(3), 40, most=most).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
    for i, want in enumerate(brute(texts, 40)):
        assert got[i] == want, (i, texts[i])


@pytest.mark.parametrize("most", [50_000, 1])
def test_texts_made_to_have_equal_sums_of_powers_stay(spark, most):
    # the sums of each with the base's powers are equal modulo 2 ** 64, whatever stands around them
    x, y = "kmolmonoooknlnonlmnnnlmmmm", "omlnnlmkklomolkmnnlmmnnnmn"
    r = random.Random(5)
    before, after = ("".join(r.choice("abcdefgh") for _ in range(390)) for _ in range(2))
    texts = [before + x + after, before + y + after, "z" + before + x + after[:300]]
    for some in (texts[:2], texts):
        out = remove_repeats(documents(spark, [(i, t, "a") for i, t in enumerate(some)]), most=most).collect()
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
        assert [got[i] for i in range(len(some))] == brute(some, 400)


def test_long_text_over_segments(spark):
    r = random.Random(9)
    long = "".join(r.choice("abcdefghij") for _ in range(2_300_000))
    texts = [long, long[1_048_000:1_049_500], "x" + long[2_000_000:2_000_399] + "y"]
    out = {x.doc_id: x for x in remove_repeats(documents(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert (out[0].n_removed, out[0].n_spans) == (1500, 1) and out[1].n_removed == 1500 and out[2].n_removed == 0


def test_edges(spark):
    assert remove_repeats(empty(spark)).count() == 0
    assert remove_repeats(documents(spark)).count() == len(DOCS)
    text = "".join(random.Random(1).choice("abcdef") for _ in range(600))
    rows = [(None, text, "a"), (1, text + "x", "a"), (1, text + "x", "a"), (1, "other", "a")]
    out = remove_repeats(documents(spark, rows)).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in out) == [(5, 0), (600, 600), (601, 601), (601, 601)]


def test_multikey_quicksort_sorts_within_groups():
    import numpy as np

    from strandline.llm.suffix_dedup import multikey_quicksort

    r = np.random.default_rng(3)
    for n in (0, 1, 2, 500):
        rows, groups = r.integers(0, 3, (n, 5)).astype(np.uint64), r.integers(0, 4, n)
        order, number = multikey_quicksort(lambda which, depth: rows[which, depth], groups, 5)
        keys = [(groups[i], *rows[i].tolist()) for i in order]
        assert keys == sorted((groups[i], *rows[i].tolist()) for i in range(n))
        assert all((a == b) == (i == j) for a, b, i, j in zip(keys, keys[1:], number, number[1:], strict=False))
