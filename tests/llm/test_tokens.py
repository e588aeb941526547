import base64
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import DOCS, documents, empty
from tokenizers import Tokenizer

from strandline.llm.common import fresh_path
from strandline.llm.encoding import CachedEncoder
from strandline.llm.packing import best_cuts, pack
from strandline.llm.token_counts import UnigramTrie, token_counts
from strandline.llm.token_files import TokenFile, read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_cached_encoder_is_the_library(encode):
    r = random.Random(3)
    texts = ["".join(r.choice("ab '\n\t \x1c\x85 .,1sé<|>ñ東") for _ in range(r.randrange(40))) for _ in range(3000)]
    texts += ["".join(r.choice(["\n", " ", "word", "Éß", "***", ".,", "'s", "'", "1", "\n\n", "#$%", "_"]) for _ in range(r.randrange(12))) for _ in range(3000)]
    texts += [t for _, t, _ in DOCS if t] + ["<|endoftext|>", "a <|endoftext|>.\n b"]
    e = CachedEncoder(PATH, most=500)
    for at in range(0, len(texts), 100):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts[at : at + 100])] == [encode(t) for t in texts[at : at + 100]]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("width", [16, 2048])
def test_token_files_round_trip(spark, encode, width):
    uri = fresh_path(spark, "test-tokens")
    shards = write_token_files(documents(spark), uri, PATH, width=width, rows=3)
    out = {r.doc_id: r for r in read_token_files(spark, uri, shards, "bigint").collect()}
    start = 0
    for i, t, _ in sorted(DOCS):
        ids = [*encode(t), 2]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    first = TokenFile(uri, shards[0][1])
    ids, mask = first[0]
    assert len(ids) == width and not ids.flags.owndata
    flat = np.concatenate([first[i][0][np.unpackbits(first[i][1]) > 0] for i in range(len(first))])
    assert len(flat) == shards[0][3]


def test_token_files_edges(spark, encode):
    uri = fresh_path(spark, "test-tokens")
    assert write_token_files(empty(spark), uri, PATH) == []
    assert read_token_files(spark, uri, [], "bigint").count() == 0
    rows = [(None, "b", "a"), (1, "x", "a"), (1, "x", "a"), (1, None, "a")]
    shards = write_token_files(documents(spark, rows), fresh_path(spark, "t"), PATH)
    assert sum(s[2] for s in shards) == 4


def check_pieces(rows, docs, encode, size=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _, _ in docs}
    for i, t, _ in docs:
        ids, at = [*encode(t), 0], 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / total


def test_packing(spark, encode):
    r = random.Random(4)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 8))) + r.choice(["", "", "", "."]) for _ in range(n))
    docs = [(i, text(r.choice([0, 3, 50, 400, 3000])), "a") for i in range(150)] + [(1000, "x" * 30000, "a")]
    assert check_pieces(pack(documents(spark, docs), PATH).collect(), docs, encode) < 0.02
    check_pieces(pack(documents(spark), PATH, block=50).collect(), DOCS, encode)
    assert pack(empty(spark), PATH).count() == 0
    assert pack(documents(spark, [(None, "a", "a"), (1, "b", "a"), (1, "b", "a")]), PATH).count() == 3


def test_best_cuts_against_all_cuts():
    r = random.Random(5)
    for _ in range(200):
        size = 16
        points = [0]
        while len(points) < 12:
            points.append(points[-1] + r.randrange(1, size + 1))
        penalty = [0, *(r.choice([0, 2, 5]) for _ in points[1:])]

        def cost(cuts):
            out = 0
            for a, b in zip(cuts, cuts[1:], strict=False):
                n = points[b] - points[a]
                if n > size:
                    return None
                out += (0 if n in (4, 8, 16) else size - n) + penalty[b]
            return out

        best = None
        for mask in range(1 << (len(points) - 2)):
            cuts = [0, *(i for i in range(1, len(points) - 1) if mask >> (i - 1) & 1), len(points) - 1]
            c = cost(cuts)
            best = c if best is None or c is not None and c < best else best
        assert cost(best_cuts(points, penalty, size, 4)) == best


def test_token_counts(spark):
    import regex

    from strandline.llm.token_counts import PATTERN

    trie = UnigramTrie(RANKS)
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
    total = sum(1 / (r + 256) for r in ranks.values())
    cost = {p: round(1e6 * math.log((r + 256) * total)) for p, r in ranks.items()}
    longest = max(map(len, ranks))

    def best(word):
        scores = [(0, 0)]
        for i in range(1, len(word) + 1):
            scores.append(min((scores[j][0] + cost[word[j:i]], scores[j][1] + 1) for j in range(max(0, i - longest), i) if word[j:i] in cost))
        return scores[-1]

    r = random.Random(3)
    docs = [*DOCS, (50, "".join(r.choice("acgt") for _ in range(9001)) + " " + "z" * 300, "a"), (51, "prefix prefixes prefixed pre", "a")]
    out = {r.doc_id: r for r in token_counts(documents(spark, docs), RANKS).collect()}
    for i, t, _ in docs:
        found = [best(x.encode()) for x in regex.findall(PATTERN, t or "")]
        assert (out[i].n_pretokens, out[i].n_tokens, out[i].cost) == (len(found), sum(n for _, n in found), sum(c for c, _ in found))
    assert token_counts(empty(spark), RANKS).count() == 0
    small = UnigramTrie(RANKS, most=2)
    assert [small.count([c]) for c in (["ab", "abc"], ["abd", "xyz", "ab"])] == [[x] for x in trie.count([["ab", "abc"], ["abd", "xyz", "ab"]])]
    # a prefix is one node
    one = UnigramTrie(RANKS)
    one.count([["abc"], ["abd"], ["ab"]])
    assert len(one.score) == 5 and len(one.terminal) == 3
