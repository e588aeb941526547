"""From raw documents to packed training sequences: quality rules, near-duplicates, pseudonyms, mixture, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import where_known, written
from strandline.llm.mixing import mix
from strandline.llm.packing import pack
from strandline.llm.pii import pseudonyms
from strandline.llm.quality import quality_rules
from strandline.llm.similar import groups, keyed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A deployment passes its own key, from where it keeps secrets.
DEMO_KEY = b"strandline queries"


def _documents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail."""
    return _documents(where_known(quality_rules(docs.select(*COLUMNS)), F.col("kept")).withColumn("text", F.col("clean_text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, Jaccard 0.8 or more): that with the least id, null ids
    last, and of its rows any one, but always the same. Equal ids or null ones make no copies."""
    docs = docs.select(*COLUMNS)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row1", "row2")
    first = groups(docs).groupBy("group").agg(F.min(order).alias("first")).select("first.row1", "first.row2")
    return keyed(docs).join(first, ["row1", "row2"], "left_semi").dropDuplicates(["row1", "row2"]).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data."""
    return _documents(pseudonyms(docs.select(*COLUMNS), DEMO_KEY))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of rarer sources up to twice: the flattest mixture within that limit. Rows lie
    in the mixture's order, in which the next stage takes them."""
    return mix(docs.select(*COLUMNS), repetition_limit=2.0, in_order=True).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of 1,024 tokens, from documents in the order in which they are stored. Words aren't
    kept from task to task: all stages share the executors' memory."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), by_id=False, keep_words=False)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]
#: Hashes, pseudonyms and tokens aren't SQL's; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
