"""Packing into sequences by order-preserving dynamic programming (operator 4).

The documents' tokens, in the order of their ids, are one stream. A window of the stream becomes a sequence; cuts may
lie at ends of documents, of sentences and, dearer, of their clauses, and, where a clause is longer than a sequence,
inside it. A window costs
its padding, and a cut inside a document a penalty. The cheapest cuts come from f(j) = min f(i) + pad(i, j) + penalty(j)
over windows of at most size tokens: pad is size - (p(j) - p(i)), so the minimum over i is a sliding minimum of
f(i) + p(i), kept in a monotone queue; windows whose length is a power of two need no padding and are tried beside it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, only, small_batches
from .encoding import CachedEncoder

#: What the last token of a sentence ends with, and that of a clause.
SENTENCE_END = (".", "!", "?", "…", "\n", '."', '!"', '?"', ".)", ".'")
CLAUSE_END = (",", ";", ":", " |")
DOCUMENT, SENTENCE, CLAUSE, HARD = 1, 2, 3, 4


@lru_cache(4)
def token_ends(tokenizer: str) -> np.ndarray:
    """For each id, SENTENCE or CLAUSE if one may end with it, else 0."""
    t = CachedEncoder.of(tokenizer).tokenizer
    n = t.get_vocab_size()
    texts = t.decode_batch([[i] for i in range(n)], skip_special_tokens=False)
    return np.array([SENTENCE if x.endswith(SENTENCE_END) else CLAUSE if x.endswith(CLAUSE_END) else 0 for x in texts], np.int8)


def best_cuts(points: list[int], penalty: list[int], size: int, least_power: int = 64) -> list[int]:
    """The indices into points at which the cheapest windows start and end.

    points: ascending places, the first and last of which are cuts, never more than size apart; penalty: of a cut at
    each. A window may be least_power, twice that and so on up to size tokens without padding.
    """
    m = len(points)
    # where a window of a power of two ends, and the windows' starts
    at = np.array(points)
    fits: dict[int, list[int]] = {}
    while least_power < size:
        start = np.minimum(np.searchsorted(at, at - least_power), m - 1)
        for j in np.flatnonzero(at[start] == at - least_power).tolist():
            fits.setdefault(j, []).append(int(start[j]))
        least_power *= 2
    cost, back = [0] * m, [0] * m
    # the queue's indices, places and keys; head is its first entry
    queue, places, keys, head = [0], [points[0]], [points[0]], 0
    for j in range(1, m):
        p = points[j]
        first = p - size
        while places[head] < first:
            head += 1
        i, best = queue[head], keys[head] + size - p
        if best and j in fits:
            for k in fits[j]:
                if cost[k] < best:
                    best, i = cost[k], k
        best += penalty[j]
        cost[j], back[j] = best, i
        key = best + p
        while len(keys) > head and keys[-1] >= key:
            queue.pop()
            places.pop()
            keys.pop()
        queue.append(j)
        places.append(p)
        keys.append(key)
    out = [m - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, size: int, penalties: tuple[int, int, int]) -> tuple[list[int], list[int]]:
    """Places where a window may end, and the penalty of each: none at a document's end, penalties at a sentence's and
    a clause's; where two such places are more than size apart, every size tokens between them at the last one."""
    kind = np.append(np.int8(DOCUMENT), ends[ids])
    kind[doc_ends] = DOCUMENT
    places = np.flatnonzero(kind)
    for k in np.flatnonzero(np.diff(places) > size).tolist():
        kind[places[k] + size : places[k + 1] : size] = HARD
    places = np.flatnonzero(kind)
    return places.tolist(), np.array([0, 0, *penalties])[kind[places]].tolist()


def pack(
    docs: DataFrame, tokenizer: str, *, size: int = 1024, end_id: int = 0, penalties: tuple[int, int, int] = (2, 6, 64), block: int = 1 << 19, by_id: bool = True, keep_words: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each piece: id_col, start (its document's ids before it), length, ids_crc32, doc_tokens (with the
    end id), sequence_id, offset (in the sequence, gapless from 0).

    Documents ascend by id (nulls first; equal ids by text), dealt by one range exchange; without by_id they keep the
    order in which docs is stored, and nothing is exchanged. A task packs its range in
    blocks of whole documents of about block tokens, which bounds its memory to a block and the longest document; a
    block's last window ends with it. A null or empty text is the end id alone; repeated rows are packed as often as
    they occur; an empty table gives no row. sequence_id ascends in the order of the documents, with gaps. keep_words:
    whether a Python worker keeps its encoded words (up to a million, about 200 MB) from task to task; without, that
    memory is free for whatever else runs in the session.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table, end = CachedEncoder.of(tokenizer), token_ends(tokenizer), np.uint32(end_id).tobytes()
        sequence = TaskContext.get().partitionId() << 40
        names: list = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held
            raw = b"".join(texts)
            ids = np.frombuffer(raw, "<u4")
            lengths = np.array([len(t) // 4 for t in texts], np.int64)
            ends = np.cumsum(lengths)
            begins = ends - lengths
            points, penalty = cut_points(ids, ends, table, size, penalties)
            cuts = np.array([points[i] for i in best_cuts(points, penalty, size)], np.int64)
            starts = np.union1d(begins, cuts[:-1])
            stops = np.append(starts[1:], len(ids))
            doc, window = np.searchsorted(begins, starts, "right") - 1, np.searchsorted(cuts, starts, "right") - 1
            view = memoryview(raw)
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, kinds).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (starts - begins[doc], stops - starts, crc, lengths[doc], sequence + window, starts - cuts[window]))],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += len(cuts) - 1
            names.clear()
            texts.clear()
            held = 0
            return out

        for b in batches:
            kinds = b.schema.field(0).type
            for name, text in zip(b.column(0).to_pylist(), encoder.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                names.append(name)
                texts.append(text + end)
                held += len(text) // 4 + 1
                if held >= block:
                    yield flush()
        if texts:
            yield flush()
        if not keep_words:
            encoder.forget_words()
            hand_back()

    ordered = only(docs, id_col, text_col)
    if by_id:
        order = F.col(f"`{id_col}`").asc_nulls_first()
        ordered = ordered.repartitionByRange(order).sortWithinPartitions(order, F.col(f"`{text_col}`"))
    return ordered.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)
