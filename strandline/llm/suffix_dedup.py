"""Removal of repeated byte strings by a sparse suffix sort (operator 7).

A byte goes if some string of length bytes that covers it also starts anywhere else. Sorting the suffixes that start at
every byte would shuffle many times the input, so suffixes are anchored first: among the hashes of the grams inside a
string of length bytes, the least marks its anchor, and equal strings have equal anchors at equal distances. Anchors
whose whole surroundings are equal are one class, which settles them; only classes that share a gram with another
class, but not the surroundings, have open strings.

Those are sorted: their surroundings are range-partitioned by the leading bytes of the anchored suffix (splitters come
from a sample), and in each range the suffixes that start at the open places are sorted by multikey quicksort, on their
own bytes, eight to a key. Suffixes of one gram don't cross a range's boundary, except where a gram has so
many classes that no task should hold them: the suffixes of those are dealt by their own fingerprint and counted.
Classes and those fingerprints are BLAKE2b digests of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches, written

SEGMENT = 1 << 20
#: Shares of all places: a class with more than one of them is dealt to a task for each.
SHARES = 1024
_BASE = 0x9E3779B97F4A7C15
_ONE = np.uint64(1)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base modulo 2 ** 64, and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(SEGMENT + 1, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that carries every bit to every other."""
    for shift in (32, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of all grams of a byte string, from one prefix sum.

    Sums of powers modulo 2 ** 64: texts that differ can be made to have equal ones, so they choose anchors and never
    say that bytes are equal."""

    def __init__(self, data: bytes | memoryview):
        n = len(data)
        self.up, self.down = _powers() if n <= SEGMENT else self._longer(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + _ONE) * self.up[:n], out=self.sums[1:])

    @staticmethod
    def _longer(n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        return out[0], out[1]

    def all(self, size: int) -> np.ndarray:
        return _mixed((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def digests(data: bytes | memoryview, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves (int64) of a BLAKE2b digest of 128 bits of each range, which stands for its bytes."""
    out = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), stop.tolist(), strict=True))
    halves = np.frombuffer(out, np.int64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def anchors(data: memoryview, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """place, first, last, gram_hash, class, class2 of each anchor: the strings of length bytes that start from first to
    last have their anchor at place. Long texts are cut into segments that overlap by all but one byte of a string.
    class and class2 are of the bytes from first to the last string's end, which fix the anchor's place among them."""
    out, n, step = [], len(data), SEGMENT - length
    for at in range(0, max(n - length + 1, 0), step):
        part = data[at : min(n, at + step + length - 1)]
        h = Hashes(part)
        grams, starts, width = h.all(gram), len(part) - length + 1, length - gram + 1
        # the place is in the low bits, so that a minimum is an anchor, the first one among equal grams
        key = (grams & ~np.uint64(SEGMENT - 1)) | np.arange(len(grams), dtype=np.uint64)
        rows = np.concatenate([key, np.full(-len(key) % width, ~np.uint64(0))]).reshape(-1, width)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = (np.minimum(after[:starts], before[width - 1 : width - 1 + starts]) & np.uint64(SEGMENT - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
        last = np.append(first[1:] - 1, starts - 1)
        place = least[first]
        out.append((place + at, first + at, last + at, grams[place], *digests(part, first, last + length)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def multikey_quicksort(word: Callable[[np.ndarray, np.ndarray], np.ndarray], groups: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort strings within their groups; (order, number): strings in sorted order, of which those that are alike in all
    words have one number. word(which, depth): the words (uint64) of those strings at those depths.

    Ternary partition at a pivot, word by word: smaller and larger strings go on at the same word, equal ones at the
    next. All parts of all groups are partitioned in the same pass; a part that is settled, by being one string or by
    having no words left, leaves the passes.
    """
    order = np.argsort(groups, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(groups[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    # of the parts that are open: where they start and end in order, and their depth
    low, high, depth = first, np.append(first[1:], len(order)), np.zeros(len(first), np.int64)
    starts = np.zeros(len(order) + 1, bool)  # where a part of strings that are alike starts
    starts[first] = True
    while True:
        open_ = (high - low > 1) & (depth < words)
        low, high, depth = low[open_], high[open_], depth[open_]
        if not len(low):
            break
        sizes = high - low
        part = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[part]
        key = word(order[at], depth[part])
        # the median of the first, the middle and the last string
        edge = np.cumsum(sizes)
        three = np.sort(np.stack([key[edge - sizes], key[edge - sizes + sizes // 2], key[edge - 1]]), axis=0)
        pivot = three[1][part]
        side = part * 3 + 1 + (key > pivot) - (key < pivot)
        rank = np.argsort(side, kind="stable")
        order[at] = order[at][rank]
        side = side[rank]
        new = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
        starts[at[new]] = True
        depth = depth[side[new] // 3] + (side[new] % 3 == 1)
        low, high = at[new], at[np.append(new[1:], len(at)) - 1] + 1
    return order, np.cumsum(starts[: len(order)]) - 1


def repeated(rows: list[bytes], counts: np.ndarray, groups: np.ndarray, length: int) -> np.ndarray:
    """For the strings of length bytes that start at the first counts[i] bytes of rows[i], whether each occurs again.

    Strings are compared within a group only, and only with those of the same distance to their anchor (groups has a
    number for each string that says both): they are sorted by their bytes, eight at a time, and equal ones are
    neighbours then. Strings that are alone in their group aren't sorted.
    """
    data = b"".join(rows)
    sizes = np.array([len(r) for r in rows], np.int64)
    base = np.repeat(np.cumsum(sizes) - sizes, counts)
    at = base + np.arange(len(base)) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(at):
        return np.zeros(0, bool)
    view = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    # the last word overlaps the one before it where length isn't a multiple of eight
    offsets = np.array([*range(0, length - 7, 8), *([length - 8] if length % 8 else [])], np.int64)
    _, number = np.unique(groups, return_inverse=True)
    some = np.flatnonzero(np.bincount(number)[number] > 1)
    order, alike = multikey_quicksort(lambda which, depth: view[at[some[which]] + offsets[depth]].astype(np.uint64), number[some], len(offsets))
    found = np.zeros(len(at), bool)
    found[some[order]] = np.bincount(alike, minlength=1)[alike] > 1
    return found


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last places of each run of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def remove_repeats(docs: DataFrame, length: int = 400, *, gram: int | None = None, most: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    Texts are UTF-8 bytes (null: empty), and strings are judged on the input. Rows with equal ids and texts are
    documents of their own, so what is long enough in them goes; equal ids with different texts stay apart; null ids
    count like others; an empty table gives none. most: classes of one gram that a task holds (about 5 kB each); a gram
    with more has its strings counted by fingerprint over all tasks instead.

    Documents that hold open strings meet their places in one join by id, and all documents their spans in another.
    """
    if length < 40:
        raise ValueError("strings of under 40 bytes have no room for anchors")
    gram = gram or length // 2
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    arrow_kind = to_arrow_type(docs.schema[id_col].dataType)
    payload = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), payload.alias("data"))
    base = base.withColumn("sum", F.xxhash64("data"))
    same_doc = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.sum") == F.col(f"{b}.sum"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, at = [], []
            for i, data in enumerate(b.column(1)):
                one = anchors(memoryview(data.as_buffer()), length, gram)
                if len(one[0]):
                    found.append(one)
                    at.append(np.full(len(one[0]), i))
            if found:
                rows = pa.array(np.concatenate(at))
                place, first, last, g, c, c2 = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(2).take(rows), *(pa.array(x) for x in (place, first, last - first)), pa.array(g.view(np.int64)), pa.array(c), pa.array(c2)],
                    names=["id", "sum", "place", "first", "more", "gram", "class", "class2"],
                )

    found = written(base.mapInArrow(find, f"id {kind}, sum long, place long, first long, more long, gram long, class long, class2 long"), "suffix-anchors")
    alike = ["gram", "class", "class2"]
    # one row for each class, with one member to stand for it
    classes = written(found.groupBy(*alike).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "sum", "place", "first", "more")).alias("one")), "suffix-classes")
    grams = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    places = classes.join(grams, "gram").select(*alike, "n", "classes", "one.*")
    per_doc = places.groupBy("id", "sum").agg(F.collect_list(F.struct("gram", "n", "classes", "place", "first", "more")).alias("places"))

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, (data, at) in enumerate(zip(b.column(1), b.column(3).to_pylist(), strict=True)):
                view = memoryview(data.as_buffer())
                for p in at:
                    lead = int.from_bytes(view[p["place"] : p["place"] + 8], "big") - (1 << 63)
                    out.append((i, lead, p["gram"], p["n"], p["classes"], p["place"] - p["first"], p["first"], view[p["first"] : p["first"] + p["more"] + length].tobytes()))
            for k in range(0, len(out), 4096):
                i, *rest = zip(*out[k : k + 4096], strict=True)
                rows = pa.array(i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(2).take(rows), *(pa.array(x) for x in rest)], names=["id", "sum", "lead", "gram", "n", "classes", "back", "first", "bytes"])

    met = base.alias("d").join(per_doc.alias("p"), same_doc("d", "p")).select("d.id", "d.data", "d.sum", "p.places")
    # copies of a document (equal id and sum) have the same places; the class needs one of them
    met = met.mapInArrow(surroundings, f"id {kind}, sum long, lead long, gram long, n long, classes long, back long, first long, bytes binary")
    opened = written(met, "suffix-open")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for b in batches:
            for row in b.to_pylist():
                if held and size > 1 << 20 and row["gram"] != held[-1]["gram"]:
                    yield from flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["bytes"]) - length + 1
        if held:
            yield from flush(held)

    def flush(held: list[dict]) -> Iterator[pa.RecordBatch]:
        # a place that came twice, from copies of its document, is one string and no repeat of itself
        unique = list({(r["id"], r["sum"], r["first"], r["back"]): r for r in held}.values())
        counts = np.array([len(r["bytes"]) - length + 1 for r in unique], np.int64)
        number = {g: k for k, g in enumerate({r["gram"] for r in unique})}
        start = np.repeat(np.cumsum(counts) - counts, counts)
        distance = np.repeat(np.array([r["back"] for r in unique], np.int64), counts) - (np.arange(len(start)) - start)
        groups = np.repeat(np.array([number[r["gram"]] for r in unique], np.int64), counts) * (2 * length) + distance
        again = repeated([r["bytes"] for r in unique], counts, groups, length)
        spans, at = [], 0
        for r, n in zip(unique, counts.tolist(), strict=True):
            if r["n"] == 1:
                for a, b in zip(*_runs(again[at : at + n]), strict=True):
                    spans.append({"id": r["id"], "sum": r["sum"], "a": r["first"] + int(a), "b": r["first"] + int(b) + length})
            at += n
        if spans:
            yield pa.RecordBatch.from_pylist(spans, schema=pa.schema([("id", arrow_kind), ("sum", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))

    span = f"id {kind}, sum long, a long, b long"
    ordered = opened.where(F.col("classes") <= most).repartitionByRange("lead", "gram").sortWithinPartitions("lead", "gram")
    spans = [ordered.mapInArrow(sort, span)]

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = len(row["bytes"]) - length + 1
                starts = np.arange(n)
                x, y = digests(row["bytes"], starts, starts + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["id"]] * n, arrow_kind), *(pa.array(v) for v in (np.full(n, row["sum"]), np.full(n, row["gram"]), row["back"] - starts, x, y, row["first"] + starts, np.full(n, row["n"])))],
                    names=["id", "sum", "gram", "distance", "x", "y", "at", "n"],
                )

    each = opened.where(F.col("classes") > most).dropDuplicates(["id", "sum", "first", "back"]).mapInArrow(strings, f"id {kind}, sum long, gram long, distance long, x long, y long, at long, n long")
    key = ["gram", "distance", "x", "y"]
    often = each.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    spans.append(each.where("n = 1").join(often, key).select("id", "sum", F.col("at").alias("a"), (F.col("at") + length).alias("b")))
    # classes of several members: all strings of all members
    # a class is dealt to so many tasks by its share of all places; those with more than one task are under SHARES
    total = classes.agg(F.sum("n")).first()[0] or 1
    several = classes.where("n > 1").select(*alike, F.ceil(F.col("n") * SHARES / F.lit(total)).cast("int").alias("tasks"))
    hot = F.broadcast(several.where("tasks > 1"))
    dealt = found.join(hot, alike, "left").withColumn("task", F.expr("pmod(xxhash64(id, sum, first), coalesce(tasks, 1))"))
    several = several.select(*alike, F.explode(F.expr("sequence(0L, tasks - 1L)")).alias("task"))
    spans.append(dealt.join(several, [*alike, "task"]).select("id", "sum", F.col("first").alias("a"), (F.col("first") + F.col("more") + length).alias("b")))
    joined = reduce(DataFrame.unionByName, spans)
    merged = written(joined.groupBy("id", "sum").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "suffix-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                view = memoryview(data.as_buffer())
                kept, at, removed, runs, end = [], 0, 0, 0, -1
                for s in sorted((s["a"], s["b"]) for s in spans or []):
                    if s[0] > end:  # touching spans are one run
                        kept.append(view[max(at, 0) : s[0]])
                        runs += 1
                        removed += s[1] - s[0]
                        end = s[1]
                    elif s[1] > end:
                        removed += s[1] - end
                        end = s[1]
                    at = end
                kept.append(view[max(at, 0) :])
                rest = b"".join(kept)
                out.append((len(view), removed, runs, hashlib.sha256(rest).hexdigest(), rest))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in zip(*out, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    final = base.alias("d").join(merged.alias("m"), same_doc("d", "m"), "left").select("d.id", "d.data", "m.spans")
    return final.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)
