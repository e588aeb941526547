"""Exact vector search over embedding versions, and their drift."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.catalog import Time, valid

Embedder = Callable[[list[str]], list[list[float]]]


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine similarity to a known vector: one product for each dimension, unrolled into generated code. Vectors of
    other lengths, and zero vectors, have similarity 0."""
    norm = math.sqrt(sum(x * x for x in query))
    if not norm:
        return F.lit(0.0)
    at = [F.get(vector, F.lit(i)).cast("double") for i in range(len(query))]

    def total(terms: list[Column]) -> Column:  # balanced, so that the expression isn't deep
        while len(terms) > 1:
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        return terms[0]

    dot, own = total([x * F.lit(float(q)) for x, q in zip(at, query, strict=True)]), F.sqrt(total([x * x for x in at]))
    return F.when((F.size(vector) == len(query)) & (own > 0), dot / (own * norm)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two columns; null if one is null, 0 for other lengths or a zero vector."""
    def sums(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(sums(a, a)) * F.sqrt(sums(b, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((F.size(a) == F.size(b)) & (size > 0), sums(a, b) / size).otherwise(F.lit(0.0))


def top_k(embeddings: DataFrame, query: list[float], k: int | None = 100, threshold: float | None = None, at: Time = None) -> DataFrame:
    """node_id, similarity of the k most similar vectors valid at a time, of those with at least the threshold; ties go
    to lesser ids. Sorting and limit are one step that keeps k rows for each task."""
    scored = valid(embeddings, at).select("node_id", cosine_to(F.col("vector"), query).alias("similarity"))
    if k is not None:
        scored = scored.orderBy(F.desc("similarity"), "node_id").limit(k)
    return scored if threshold is None else scored.where(F.col("similarity") >= threshold)


def versions(embeddings: DataFrame, query: list[float], k: int | None = None, threshold: float | None = None, drift: bool = False) -> DataFrame:
    """All versions above the threshold, then the k most similar (ties: the later, then the lesser id): the columns of
    embeddings but vector, similarity, and with drift drift_from_previous and drift_from_first (cosine distances to the
    previous and first version of the node that are above the threshold)."""
    scored = embeddings.withColumn("similarity", cosine_to(F.col("vector"), query))
    if threshold is not None:
        scored = scored.where(F.col("similarity") >= threshold)
    if drift:
        order = ["valid_from", "seq"] if "seq" in embeddings.columns else ["valid_from"]
        w = Window.partitionBy("node_id").orderBy(*order)
        scored = scored.withColumns({"__before": F.lag("vector").over(w), "__first": F.first("vector").over(w)})
        scored = scored.withColumns({"drift_from_previous": F.coalesce(1 - cosine(F.col("vector"), F.col("__before")), F.lit(0.0)), "drift_from_first": 1 - cosine(F.col("vector"), F.col("__first"))}).drop("__before", "__first")
    out = scored.drop("vector")
    if k is not None:
        out = out.orderBy(F.desc("similarity"), F.desc("valid_from"), "node_id").limit(k)
    return out


def vector_at(embeddings: DataFrame, at: Time = None) -> DataFrame:
    """node_id, vector: each node's last version valid at a time."""
    return valid(embeddings, at).groupBy("node_id").agg(F.max_by("vector", "valid_from").alias("vector"))


def embed(texts: DataFrame, embedder: Embedder, model: str) -> DataFrame:
    """Embedding versions of text versions (node_id, text, valid_from, valid_to): successive versions of a node with
    equal texts become one interval (gaps and islands), then each text is embedded, in Arrow batches."""
    w = Window.partitionBy("node_id").orderBy("valid_from")
    marked = texts.withColumn("__change", F.when(F.lag("text").over(w).eqNullSafe(F.col("text")) & F.lag("valid_to").over(w).eqNullSafe(F.col("valid_from")), 0).otherwise(1))
    marked = marked.withColumn("__island", F.sum("__change").over(w))
    last = F.max_by("valid_to", "valid_from")
    spans = marked.groupBy("node_id", "__island", "text").agg(F.min("valid_from").alias("valid_from"), last.alias("valid_to"))
    kind = spans.schema["node_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = embedder([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32())), b.column(2), b.column(3)], names=["node_id", "vector", "valid_from", "valid_to"])

    out = spans.select("node_id", "text", "valid_from", "valid_to").mapInArrow(run, f"node_id {kind}, vector array<float>, valid_from timestamp_ntz, valid_to timestamp_ntz")
    return out.withColumn("model", F.lit(model))


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """Words hashed into dimensions: deterministic, for tests and offline use."""
    import zlib

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimensions
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dimensions] += 1.0 if h >> 16 & 1 else -1.0
            out.append(v)
        return out

    return run
