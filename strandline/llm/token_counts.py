"""Token counts under a unigram model, by dynamic programming over a trie (operator 8).

Pieces and their order come from a public vocabulary file; a piece's probability falls with its rank (Zipf). The best
segmentation of a pre-token is found forward: best(i) = min over pieces that end at i of best(i - length) + cost. Equal
prefixes have equal scores, so distinct pre-tokens are inserted in a trie, each node is scored once from the nodes above
it, and a terminal keeps its count of pieces for every text that holds the pre-token.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, small_batches

#: The pre-token pattern that the vocabulary goes with, as its package states it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Pre-tokens of more bytes are scored by themselves, in the same way; they share no more of a trie than they would fill.
LONG = 256
_PIECE = 40


class UnigramTrie:
    """Counts of pieces for pre-tokens. path: a file of base64 pieces and ranks that holds every single byte.

    A piece of rank r has probability proportional to 1 / (r + shift); its cost is a whole number of millionths of a
    nat, so that sums and ties are the same everywhere. Of equally cheap segmentations the one with fewer pieces holds.
    A node is a prefix of pre-tokens and keeps its forward score; the trie stays from batch to batch, so that a prefix
    is scored once. most: nodes kept before the trie starts anew (bounds memory; results don't depend on it).
    """

    _open: dict[tuple[str, int], UnigramTrie] = {}

    def __init__(self, path: str, shift: int = 256, most: int = 1_000_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        total = sum(1 / (r + shift) for r in ranks.values())
        # the low bits count pieces, so that fewer pieces win among equal costs
        self.cost = {p: (round(1e6 * math.log((r + shift) * total)) << _PIECE) + 1 for p, r in ranks.items()}
        if any(bytes([b]) not in self.cost for b in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        ends: dict[int, set[int]] = {}
        for p in ranks:
            ends.setdefault(p[-1], set()).add(len(p))
        self.lengths = [sorted(ends[b]) for b in range(256)]
        self.most = most
        self.clear()

    def clear(self) -> None:
        #: children by node and byte, the nodes' forward scores, and the terminals
        self.child: dict[int, int] = {}
        self.score: list[int] = [0]
        self.terminal: dict[str, tuple[int, int]] = {}

    @classmethod
    def of(cls, path: str, shift: int = 256) -> UnigramTrie:
        """One trie for each Python worker and file."""
        if (path, shift) not in cls._open:
            cls._open[path, shift] = cls(path, shift)
        return cls._open[path, shift]

    def _best(self, word: bytes, i: int, scores: list[int]) -> int:
        """The forward score of the first i bytes, from those of fewer."""
        cost, best = self.cost, None
        for length in self.lengths[word[i - 1]]:
            if length > i:
                break
            c = cost.get(word[i - length : i])
            if c is not None and (best is None or scores[i - length] + c < best):
                best = scores[i - length] + c
        return best

    def insert(self, text: str) -> tuple[int, int]:
        """Walk a pre-token down the trie, score the nodes that it adds, and store what it ends with: its pieces and
        their cost."""
        word, scores = text.encode("utf-8", "surrogatepass"), [0]
        if len(word) > LONG:
            for i in range(1, len(word) + 1):
                scores.append(self._best(word, i, scores))
            return scores[-1] & ((1 << _PIECE) - 1), scores[-1] >> _PIECE
        node, child, score = 0, self.child, self.score
        for i, byte in enumerate(word, 1):
            step = node << 8 | byte
            node = child.get(step)
            if node is None:
                node = child[step] = len(score)
                score.append(self._best(word, i, scores))
            scores.append(score[node])
        out = self.terminal[text] = (scores[-1] & ((1 << _PIECE) - 1), scores[-1] >> _PIECE)
        return out

    def count(self, cuts: list[list[str]]) -> list[tuple[int, int]]:
        """(pieces, millionths of a nat) for each text, given as its pre-tokens."""
        if len(self.score) > self.most:
            self.clear()
        out, get, insert = [], self.terminal.get, self.insert
        for c in cuts:
            found = [get(t) or insert(t) for t in c]
            out.append((sum(n for n, _ in found), sum(x for _, x in found)))
        return out


def token_counts(docs: DataFrame, vocabulary: str, *, shift: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_pretokens, n_tokens, cost (millionths of a nat, the best segmentation's) for each row of docs.

    No shuffle: each task keeps the trie of what it has seen. Pre-tokens are scored whole, however long. A null or empty text counts nothing; repeated rows give repeated rows; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, trie = regex.compile(PATTERN).findall, UnigramTrie.of(vocabulary, shift)
        for b in batches:
            cuts = [find(t) if t else [] for t in b.column(1).to_pylist()]
            found = trie.count(cuts)
            columns = [pa.array(x, pa.int64()) for x in ([len(c) for c in cuts], [n for n, _ in found], [c for _, c in found])]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", "n_pretokens", "n_tokens", "cost"])

    return only(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n_pretokens long, n_tokens long, cost long").withColumnRenamed("id", id_col)
