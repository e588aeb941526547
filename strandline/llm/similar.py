"""Near copies by word shingles (operator 3 as the pipeline's stage takes it): fingerprints first, then all the rest.

Two texts are linked if their sets of five-word shingles overlap in at least the threshold (four fifths) of their union;
groups are the closure of the links. Every link is verified on the whole sets. Equal sets are one class, and only classes
are compared. Candidates come in two passes:

1. The grid join over SimHash fingerprints of the shingles (simhash.links); for each class its neighbour by size and the
   hub with which it shares most shingles. What these find alike is one group already and needs no pairs in itself.
2. Fingerprints of such texts may differ in a dozen bits, so what is left comes from a prefix filter, which misses
   none: in any one order of all shingles, two such sets share a shingle among the first n - ceil(threshold * n) + 1 of
   each, and at the first one that they share, what follows it in both still has room for the whole overlap. The order
   is that of 64-bit hashes, except that shingles which a sample shows to be common come last. Only pairs of different
   groups are made, and only with those that aren't of a shingle's largest group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, hand_back, only, small_batches, written
from .components import components
from .simhash import links, shingle_hashes, simhash

SHINGLE, THRESHOLD = 5, (4, 5)
#: Members of a shingle or fingerprint that are put in a row; more are dealt to several rows by hash.
ROW = 4096
#: Classes (24 bytes each) that are broadcast to the texts at most.
FEW = 500_000
#: Segments of the shingles' hashes by which they are counted (their leading nine bits), up to 127 in each: counts that
#: stop there are no further apart than the real ones.
SEGMENTS = 512


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes (int64) of a text's shingles, as the fingerprints take them; no words give none."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(text, size)]).view(np.int64))


def _common(docs: DataFrame, text_col: str, size: int, one_in: int, often: int, most: int = 50_000) -> np.ndarray:
    """Sorted hashes of the shingles that at least often texts of a sample hold, the most frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, size))], names=["s"])
        hand_back()

    sample = only(docs, text_col).where(F.expr(f"pmod(xxhash64(`{text_col}`), {one_in}) = 0"))
    counts = sample.mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)
    return np.array(sorted(r.s for r in counts.orderBy(F.desc("n"), "s").limit(most).collect()), np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row1, row2: two hashes of a row's whole content, in which nulls count."""
    parts = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return docs.withColumns({"row1": F.xxhash64(*parts), "row2": F.xxhash64(F.lit("2"), *parts)})


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, one_in: int = 64, often: int = 8) -> DataFrame:
    """One row for each row of docs: id_col, row1, row2 (as keyed() gives them), group (long).

    Texts without words are one group. Null ids and repeated ids stay rows of their own.
    """
    small_batches(docs.sparkSession)
    num, den = threshold
    source = only(keyed(docs), id_col, text_col, "row1", "row2")
    kind = docs.schema[id_col].dataType.simpleString()

    common = _common(docs, text_col, size, one_in, often)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in (b for b in batches if b.num_rows):
            texts = b.column(1).to_pylist()
            sets = [shingles(t, size) for t in texts]
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            counts = [np.minimum(np.bincount(s.view(np.uint64) >> np.uint64(55), minlength=SEGMENTS), 127).astype(np.int8) for s in sets]
            heads = []
            for s in sets:
                late = np.isin(s, common)
                heads.append(np.concatenate([s[~late], s[late]])[: len(s) - -(-len(s) * num // den) + 1 if len(s) else 0])
            columns = [pa.array([len(s) for s in sets], pa.int32()), pa.array(simhash(texts, size).view(np.int64)), pa.array(counts, pa.list_(pa.int8())), pa.array(heads, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(keys[:, 0]), pa.array(keys[:, 1]), *columns], names=["id", "row1", "row2", "key1", "key2", "n", "fp", "counts", "head"])
        hand_back()

    rows = written(source.mapInArrow(described, f"id {kind}, row1 long, row2 long, key1 long, key2 long, n int, fp long, counts array<tinyint>, head array<long>"), "similar-rows")
    classes = rows.groupBy("key1", "key2").agg(F.min(F.struct("row1", "row2")).alias("row"), *(F.first(x).alias(x) for x in ("n", "fp", "counts", "head")))
    classes = written(classes.select(F.monotonically_increasing_id().alias("c"), "key1", "key2", "row.row1", "row.row2", "n", "fp", "counts", "head"), "similar-classes")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingles(t, size) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], names=["c", "items"])
        hand_back()

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) of classes whose sets are similar enough: first by the Manhattan distance of their counts
        by segment, which never exceeds the number of shingles that only one of them holds, then by the sets."""
        x, y = (classes.select(F.col("c").alias(side), F.col("n").alias(f"n{side}"), F.col("counts").alias(f"counts{side}")) for side in "ab")
        apart = "aggregate(zip_with(countsa, countsb, (p, q) -> abs(p - q)), 0, (p, q) -> p + q)"
        near = pairs.join(x, "a").join(y, "b").where(f"{num + den} * {apart} <= {den - num} * (na + nb)").select("a", "b")
        near = written(near, f"similar-near-{name}")
        wanted = written(near.selectExpr("a as c").unionByName(near.selectExpr("b as c")).distinct().join(classes.select("c", "row1", "row2"), "c"), f"similar-wanted-{name}")
        # their texts are fetched once; where they are few, the corpus stays where it is
        wanted_rows = F.broadcast(wanted) if wanted.count() <= FEW else wanted
        texts = source.join(wanted_rows, ["row1", "row2"]).select("c", text_col)
        # rows that repeat whole come several times
        sets = written(texts.mapInArrow(sets_of, "c long, items array<long>").groupBy("c").agg(F.first("items").alias("items")), f"similar-sets-{name}")
        both = near.join(sets.selectExpr("c as a", "items as x"), "a").join(sets.selectExpr("c as b", "items as y"), "b")
        alike = f"{num + den} * size(array_intersect(x, y)) >= {num} * (size(x) + size(y))"
        out = written(both.where(alike).select("a", "b"), f"similar-links-{name}")
        for used in (near, wanted, sets):
            forget(used)
        return out

    # by fingerprint: those that link, each by one class, and its other classes
    prints = written(classes.groupBy("fp").agg(F.min("c").alias("one"), F.count(F.lit(1)).alias("many")), "similar-prints")
    grid = links(prints.select("fp")).join(prints.selectExpr("fp as a", "one as x"), "a").join(prints.selectExpr("fp as b", "one as y"), "b").selectExpr("x as a", "y as b")
    equal = classes.select("fp", "c").join(prints.where("many > 1"), "fp").where("c > one").selectExpr("one as a", "c as b")
    # by shingle: next to each other by size, with whom a class shares most; what these miss is found below
    heads = classes.select("c", "n", F.posexplode("head").alias("at", "s"))
    shared = heads.join(heads.groupBy("s").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "s")
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num)) + 1e-9).cast("int")
    shared = written(shared.select("s", "c", "n", "at", step.alias("step"), F.pmod(F.col("c"), F.ceil(F.col("many") / ROW)).alias("row")), "similar-shared")
    chain = shared.withColumn("before", F.lag(F.struct("c", "n")).over(Window.partitionBy("s", "row").orderBy("n", "c"))).where(f"before is not null and {den} * before.n >= {num} * n")
    chain = chain.groupBy(F.col("before.c").alias("a"), F.col("c").alias("b")).agg(F.count(F.lit(1)).alias("k")).groupBy("b").agg(F.max_by("a", F.struct("k", "a")).alias("a"))
    # and with the one of about its size that has it foremost, which has the least of its own before it
    hubs = shared.groupBy("s", "step").agg(F.min(F.struct("at", "c")).alias("hub")).select("s", "step", F.col("hub.c").alias("hub"))
    stars = shared.join(hubs, ["s", "step"]).where("c <> hub").groupBy(F.col("hub").alias("a"), F.col("c").alias("b")).agg(F.count(F.lit(1)).alias("k")).groupBy("b").agg(F.max_by("a", F.struct("k", "a")).alias("a"))
    first = verified(grid.unionByName(equal).unionByName(chain).unionByName(stars).selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "first")
    room = f"{num + den} * least(x.n - x.at, y.n - y.at) >= {num} * (x.n + y.n)"
    # groups that came of this may be alike by many pairs: of each shingle, the foremost of each group meets that of the largest
    met = shared.join(written(components(first), "similar-joined").withColumnRenamed("node", "c"), "c")
    fronts = met.groupBy("s", "root").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("at", "c", "n")).alias("front")).select("s", "root", "k", "front.*")
    fronts = written(fronts, "similar-fronts")
    chief = fronts.groupBy("s").agg(F.max(F.struct("k", "root", "at", "c", "n")).alias("y"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("s", "y")
    between = fronts.select("s", F.struct("root", "at", "c", "n").alias("x")).join(chief, "s").where(f"x.root <> y.root and {room}")
    first = written(first.unionByName(verified(between.selectExpr("least(x.c, y.c) as a", "greatest(x.c, y.c) as b").distinct(), "second")), "similar-early")
    joined = written(components(first), "similar-joined")
    # all other pairs that share a shingle of their prefixes: each that isn't of the shingle's largest group against all,
    # dealt by the shingle and the size (sets that are alike lie in the same step of sizes, or in the next one)
    known = shared.drop("row").join(joined.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    known = written(known, "similar-known")
    forget(shared)
    largest = known.groupBy("s", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("s").agg(F.max_by("root", F.struct("k", "root")).alias("largest"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    open_ = written(known.join(largest, "s"), "similar-open")
    x = open_.where("root <> largest").withColumn("step", F.explode(F.expr("array(step - 1, step, step + 1)"))).alias("x")
    y = open_.alias("y")
    # of two that both aren't of the largest group, one order is enough
    once = "(y.root = y.largest or x.c < y.c)"
    met = x.join(y, F.expr(f"x.s = y.s and x.step = y.step and x.root <> y.root and {once} and {room}"))
    rest = verified(met.selectExpr("least(x.c, y.c) as a", "greatest(x.c, y.c) as b").distinct(), "rest")
    roots = components(first.unionByName(rest)).withColumnRenamed("node", "c")
    by_key = classes.join(roots, "c", "left").select("key1", "key2", F.coalesce("root", "c").alias("group"))
    return rows.join(by_key, ["key1", "key2"]).select(F.col("id").alias(id_col), "row1", "row2", "group")
