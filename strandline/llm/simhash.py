"""SimHash near-duplicates by segment popcounts (operator 3).

A fingerprint's 64 bits are cut into segments; its embedding is the vector of their bit counts. Flipping one bit moves
one coordinate by one, so the Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints. The range-join works on a grid over the embedding: segments are dealt into radius + 2 groups; two points
within the radius differ in at most radius groups, so they agree in at least two whole groups, and they meet in the
grid cell of such a pair of groups. Inside a cell, pairs are held against the Manhattan bound first and then verified
by the exact Hamming distance.

A cell of many members (near copies that share almost every bit) is gridded again over the bits that its members may
still differ in, by the same rule, until few are left together: the same pairs meet, in finer cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, small_batches, written
from .components import components

SEGMENT_BITS = 2


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 hashes (seed 42, uint64) of a text's shingles, at most 65,536 at once. A-Z lower-cased; words are runs
    without ASCII white space; shingles count as often as they occur; fewer words are one, no words give none."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if 0 < len(words) <= shingle:
        yield np.array([digest(b" ".join(words), 42)], "<u8")
        return
    total = len(words) - shingle + 1
    for first in range(0, total, 65536):
        last = min(first + 65536, total)
        grams = map(b" ".join, zip(*(words[first + i : last + i] for i in range(shingle)), strict=True))
        yield np.fromiter((digest(g, 42) for g in grams), "<u8", last - first)


def simhash(texts: list[str | None], shingle: int = 3) -> np.ndarray:
    """Fingerprints (uint64). A bit is 1 if set in over half of the shingles' hashes; no words give zero."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for at, text in enumerate(texts):
        ones, total = np.zeros(64, np.int64), 0
        for hashes in shingle_hashes(text, shingle):
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
        out[at] = weights[ones * 2 > total].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp (long: the fingerprint's bits as a signed number). A null or wordless text has fingerprint zero.
    Repeated rows and null ids stay rows of their own."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = simhash(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, id_col, text_col).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def _embedding(fp: str) -> str:
    """SQL for the bit counts of all two-bit segments, two bits each, in one long (6148914691236517205 is 0x5555...)."""
    p, q = f"({fp} & 6148914691236517205L)", f"(shiftrightunsigned({fp}, 1) & 6148914691236517205L)"
    return f"(shiftleft({p} & {q}, 1) | ({p} ^ {q}))"


def _manhattan(a: str, b: str) -> str:
    """SQL for the sum over all segments of |count - count|, counts being 0, 1 or 2 in two bits each.

    |x - y| of such counts is 0 where they are equal, 2 where one is 0 and the other 2 (x ^ y is binary 10), else 1.
    """
    d = f"({a} ^ {b})"
    low, high = f"({d} & 6148914691236517205L)", f"(shiftrightunsigned({d}, 1) & 6148914691236517205L)"
    return f"(bit_count({low}) + 2 * bit_count({high} & ~{low}))"


def _slabs(bits: list[int], radius: int) -> list[int]:
    """Masks of pairs of groups, of radius + 2 groups of the given segments (by their first bits)."""
    groups = radius + 2
    masks = [sum(3 << i for i in bits[g * len(bits) // groups : (g + 1) * len(bits) // groups]) for g in range(groups)]
    return [a | b for a, b in combinations(masks, 2)]


def links(fps: DataFrame, radius: int = 2, dense: int = 64) -> DataFrame:
    """a, b (longs, a < b): all pairs of distinct fingerprints (column fp, unique) within radius bits, each once.

    Cells of more than dense members are gridded again, inside, over the segments that they don't fix: for radius 2, 16,
    8, 4 and 2 of the 32 segments are left free. A count of a level's cells says whether there is a next one.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    if radius == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    # a cell is the mask of its fixed segments and their counts
    rows = fps.selectExpr("fp", f"{_embedding('fp')} as e", "0L as mask")
    found: list[DataFrame] = []
    free = {0: list(range(0, 64, SEGMENT_BITS))}
    while True:
        finer = {m: _slabs(bits, radius) for m, bits in free.items()}
        # at most 6, 36, 216 rows: the masks of a level are few and fixed
        ways = fps.sparkSession.createDataFrame([(_signed(m), sorted({_signed(m | s) for s in slabs})) for m, slabs in finer.items()], "mask long, finer array<long>")
        cells = rows.join(F.broadcast(ways), "mask").select("fp", "e", F.explode("finer").alias("mask")).distinct().withColumn("cell", F.expr("e & mask"))
        sizes = cells.groupBy("mask", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        cells = written(cells.join(sizes, ["mask", "cell"]), "simhash-cells")
        free = {m | s: [i for i in free[m] if not s >> i & 1] for m, slabs in finer.items() for s in slabs}
        last = all(len(bits) < radius + 2 for bits in free.values())
        few = cells if last else cells.where(F.col("n") <= dense)
        # equality of mask and cell is the grid; then the lower bound; then the exact distance
        on = f"x.mask = y.mask and x.cell = y.cell and x.fp < y.fp and {_manhattan('x.e', 'y.e')} <= {radius} and bit_count(x.fp ^ y.fp) <= {radius}"
        found.append(few.alias("x").join(few.alias("y"), F.expr(on)).selectExpr("x.fp as a", "y.fp as b"))
        rows = cells.where(F.col("n") > dense).select("fp", "e", "mask")
        if last or not rows.limit(1).count():
            return reduce(DataFrame.unionByName, found).distinct()
        held = {r["mask"] for r in cells.where(F.col("n") > dense).select("mask").distinct().collect()}
        free = {m: bits for m, bits in free.items() if _signed(m) in held}


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, dense: int = 64) -> DataFrame:
    """One row for each row of docs: id_col, fingerprint (16 lower-case hex digits), component_id.

    component_id: the least id reachable over links of at most radius differing bits, the own one included. Equal
    fingerprints are one class, so copies are never expanded into pairs. Null texts count as empty; a null id is never
    the least unless all ids of a component are null; repeated rows give repeated rows; an empty table gives none.
    """
    rows = written(fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    classes = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    edges = written(links(classes.select("fp"), radius, dense), "simhash-links")
    # classes without a link are their own component
    roots = components(edges).withColumnRenamed("node", "fp")
    labelled = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    reach = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = labelled.select("fp", "root").join(reach, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
