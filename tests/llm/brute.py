"""Plain reference computations that the operators are held against."""

import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOCS = [
    (1, "The quick brown fox jumps over the lazy dog. It was a sunny day.\nAnother line here, with words.", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, "The quick brown fox jumps over the lazy dog. It was a sunny day.\nAnother line here, with words.", "b"),
    (5, "THE QUICK  brown fox\tjumps over the lazy dog. it was a sunny day. another line here, with words. ", "b"),
    (6, " ".join(f"word{i % 9}" for i in range(300)) + ".", "a"),
    (7, "one two", "c"),
    (8, "   \n \t ", "c"),
    (9, "Ａ ﬁne Straße — naïve café; 東京。 😀 emoji\x85next space", "a"),
    (10, "\n".join("A proper sentence ends here, number %d." % i for i in range(400)), "a"),
    (11, "\n".join("A proper sentence ends here, number %d." % i for i in range(1, 401)), "a"),
    (12, "Home | News | About | Contact | Login\nAccept cookies to go on.\nx\nSome text that is long enough to be kept as a line.", "d"),
]


def documents(spark, rows=None):
    rows = DOCS if rows is None else rows
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def empty(spark):
    return documents(spark, [])


def words(text):
    return WORD.findall(text or "")


def repeat_words(text, window=8):
    w = words(text)
    grams = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
    n = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(window)})


def fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(fps):
    """{id: fingerprint} -> {id: least id reachable over links of two bits}"""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
