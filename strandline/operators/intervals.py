"""Joins and compaction of validity intervals."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.catalog import FROM, TO


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: datetime.timedelta, end: datetime.datetime = datetime.datetime(2100, 1, 1)) -> DataFrame:
    """Pairs with equal keys whose intervals overlap; columns are prefixed left_ and right_.

    Both sides are dealt to the buckets of time that they touch, so the join is on keys and bucket; a pair is kept in
    the bucket where the later of the two starts lies, once. Open intervals end at end, and touch the last bucket of
    the other side's starts at most.
    """
    size = int(bucket.total_seconds())
    seconds = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1_000_000 / size).cast("long")
    stop = F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz")
    # no bucket lies after the last start: nothing can meet there
    bounds = left.agg(F.max(FROM).alias("t")).unionByName(right.agg(F.max(FROM).alias("t"))).agg(F.max("t")).first()[0]
    last = F.lit(None).cast("long") if bounds is None else seconds(F.lit(bounds.isoformat(sep=" ")).cast("timestamp_ntz"))

    def dealt(df: DataFrame, side: str) -> DataFrame:
        out = df.select(*(F.col(f"`{c}`").alias(f"{side}_{c}") for c in df.columns))
        a, z = seconds(F.col(f"{side}_{FROM}")), F.least(seconds(F.coalesce(f"{side}_{TO}", stop)), last)
        return out.withColumn(f"{side}__bucket", F.explode(F.sequence(a, F.greatest(a, z))))

    x, y = dealt(left, "left"), dealt(right, "right")
    on = x["left__bucket"] == y["right__bucket"]
    for k in keys:
        on = on & (x[f"left_{k}"] == y[f"right_{k}"])
    on = on & (F.col(f"left_{FROM}") < F.coalesce(f"right_{TO}", stop)) & (F.col(f"right_{FROM}") < F.coalesce(f"left_{TO}", stop))
    on = on & (F.col("left__bucket") == seconds(F.greatest(f"left_{FROM}", f"right_{FROM}")))
    return x.join(y, on).drop("left__bucket", "right__bucket")


def compact(df: DataFrame, keys: list[str], values: list[str], order: list[str] | None = None) -> DataFrame:
    """Successive versions of a key with equal values become one (gaps and islands): keys, values, valid_from, valid_to."""
    w = Window.partitionBy(*keys).orderBy(FROM, *(order or []))
    same = F.lit(True)
    for v in values:
        same = same & F.lag(v).over(w).eqNullSafe(F.col(v))
    first = F.row_number().over(w) == 1
    marked = df.withColumn("__new", F.when(~first & same, 0).otherwise(1)).withColumn("__island", F.sum("__new").over(w))
    last = F.max_by(F.struct(TO), F.struct(FROM, *(order or [])))
    out = marked.groupBy(*keys, "__island", *values).agg(F.min(FROM).alias(FROM), last.alias("__last"))
    return out.select(*keys, *values, FROM, F.col(f"__last.{TO}").alias(TO))
