"""Canonical exact fingerprints (operator 6): built-in functions only.

A text is normalised (NFKC), case-folded and its white space folded; two xxHash64 values of that form, 128 bits, are
its fingerprint. Buckets of equal hashes are split by the canonical bytes themselves, so that texts which collide get
different fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, written

#: Bytes of text for which there is a range, and the most ranges, which are branches of an expression.
RANGE, MOST_RANGES = 1 << 26, 4096


def canonical(text: Column) -> Column:
    """NFKC, full case folding (upper, then lower), runs of white space to one space, none at the ends."""
    # a static method that Spark's own ICU library has, called by the SQL function for such methods
    compose = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    return F.trim(F.regexp_replace(compose(F.lower(F.upper(compose(F.coalesce(text, F.lit("")))))), r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def wide_hash(canon: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes."""
    return F.xxhash64(canon), F.xxhash64(F.lit(1), canon)


def as_hex(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h1, h2, canon, first_id, copies, place: one row for each different canonical text.

    Grouping by both hashes and the text itself is the comparison of bytes inside equal buckets; copies are summed up
    before the shuffle, so a group of any size is one row for each task. canon is null, and place 0, where the bucket
    holds one text; the texts of a bucket that holds more are numbered in their order.
    """
    canon = canonical(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), canon.alias("canon"))
    h1, h2 = wide_hash(F.col("canon"))
    texts = rows.withColumns({"h1": h1, "h2": h2}).groupBy("h1", "h2", "canon").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    # the buckets' sizes: texts of a bucket are neighbours after the exchange by hash
    bucket = Window.partitionBy("h1", "h2")
    sized = texts.withColumn("texts", F.count(F.lit(1)).over(bucket)).withColumn("place", F.row_number().over(bucket.orderBy("canon")) - 1)
    return sized.select("h1", "h2", F.when(F.col("texts") > 1, F.col("canon")).alias("canon"), "first_id", "copies", "place")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (32 hex digits), group_id (the least id of the rows with the same canonical text), copies.

    One row for each row of docs. A null text counts as empty; null ids are never the least unless all are null; an
    empty table gives none. Fingerprints are equal exactly if the canonical texts are: of texts that collide, all but
    the first carry their number after a dash.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), canonical(F.col(f"`{text_col}`")).alias("canon"))
    return _named(rows, written(classes(docs, id_col, text_col), "fingerprint-classes")).select(F.col("id").alias(id_col), "fingerprint", "group_id", "copies")


def _named(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (with canon) with fingerprint, group_id and copies in place of canon. Texts travel to the classes only if
    some bucket holds two."""
    h1, h2 = wide_hash(F.col("canon"))
    rows = rows.withColumns({"h1": h1, "h2": h2})
    if found.where("canon is not null").limit(1).count():
        met = rows.join(found.withColumnRenamed("canon", "held"), ["h1", "h2"]).where("held is null or canon = held").drop("canon", "held")
    else:
        met = rows.drop("canon").join(found.drop("canon"), ["h1", "h2"])
    mark = F.when(F.col("place") > 0, F.concat(F.lit("-"), F.col("place").cast("string"))).otherwise("")
    return met.withColumn("fingerprint", F.concat(as_hex(F.col("h1"), F.col("h2")), mark)).withColumnRenamed("first_id", "group_id").drop("h1", "h2", "place")


def _bucket(key: Column, bounds: list, low: int, high: int) -> Column:
    """The last k with bounds[k] <= key, by halving, as nested CASEs; 0 for a null or smaller key."""
    if low == high:
        return F.lit(low)
    mid = (low + high + 1) // 2
    return F.when(key >= F.lit(bounds[mid]), _bucket(key, bounds, mid, high)).otherwise(_bucket(key, bounds, low, mid - 1))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, next_id, next_text: each document beside the one that follows it by id (the first follows the last).

    Ids are cut into ranges at quantiles, which are ids that occur: the first document of a range is dealt to the
    range before it too, so a window in each range finds every successor in one exchange. A range is sorted on disk
    where it outgrows memory. Equal ids ascend by text;
    null ids come first; one document follows itself.
    """
    rows = only(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    # a range for each RANGE bytes of text; the splitters are quantiles of the ids with the least hashes, which works
    # for ids of any type that has an order
    stats = rows.agg(F.min("id").alias("least"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (stats.bytes or 0) // RANGE), MOST_RANGES)
    some = [r.id for r in rows.where("id is not null").select("id").distinct().orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(parts * 16).collect()]
    quantiles = sorted(some)[16::16]
    bounds = sorted({stats.least, *quantiles}) if stats.least is not None else [0]
    bucket = _bucket(F.col("id"), bounds, 0, len(bounds) - 1)
    opens = F.col("id").isin(bounds[1:]) if len(bounds) > 1 else F.lit(False)
    first = F.col("id").isNull() if stats.nulls else F.col("id") == F.lit(bounds[0])
    again = F.when(F.coalesce(first, F.lit(False)), F.lit(len(bounds) - 1)).when(F.coalesce(opens, F.lit(False)), F.col("bucket") - 1)
    dealt = rows.withColumn("bucket", bucket).withColumn("again", again)
    dealt = dealt.select("id", "text", F.explode(F.when(F.col("again").isNull(), F.array(F.struct("bucket", F.lit(False).alias("ghost")))).otherwise(F.array(F.struct("bucket", F.lit(False).alias("ghost")), F.struct(F.col("again").alias("bucket"), F.lit(True).alias("ghost"))))).alias("to"))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("id").asc_nulls_first(), "text")
    return dealt.select("id", "text", "to.bucket", "to.ghost").withColumns({"next_id": F.lead("id").over(order), "next_text": F.lead("text").over(order)}).where("not ghost").select("id", "text", "next_id", "next_text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id, copies.

    The edited text: the last half of a text (rounded down) replaced by as many first code points of the next
    document, or all it has. An exact fingerprint is like another fully or not at all: near_edited and near_next are 1
    where the canonical texts are equal, else 0. An edited text isn't in the table, so no number follows its hashes.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs, id_col, text_col)
    rows = rows.select("id", F.length("text").cast("long").alias("n_chars"), "text", "next_text", F.concat(F.left("text", F.length("text") - half), F.left("next_text", half)).alias("edited"))

    canon = rows.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), canonical(F.col("text")).alias("canon"), canonical(F.col("edited")).alias("b"), canonical(F.col("next_text")).alias("c"))
    pairs = canon.select("id", "n_chars", "edited_sha256", "canon", as_hex(*wide_hash(F.col("b"))).alias("edited_fingerprint"), (F.col("canon") == F.col("b")).cast("double").alias("near_edited"), (F.col("canon") == F.col("c")).cast("double").alias("near_next"))
    named = _named(pairs, written(classes(docs, id_col, text_col), "fingerprint-classes"))
    return named.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id", "copies")
