"""The operators' queries over the supplied tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


@query(
    "op1_quality_rules",
    r"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM words, unnest(range(1, len(w) - 6)) AS r(i) WHERE len(w) > 8),
twins AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
steps AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS s FROM twins),
reps AS (SELECT doc_id, sum(s)::BIGINT AS n FROM steps GROUP BY doc_id),
flat AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM lines),
judged AS (SELECT doc_id, line, len(string_split(line, ' ')) AS nw, length(regexp_replace(line, '[^!*#$%&<=_|>»›•·]+', '', 'g')) AS marks,
  length(regexp_replace(line, '[^|>»›•·]+', '', 'g')) AS menu, lower(line) AS low,
  regexp_matches(line, '[.!?:;,…。！？；：،؟।][\x20\x09-\x0D"''”’»)\]}]*$') AS prose FROM flat),
clean AS (SELECT doc_id, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars FROM judged
  WHERE prose AND NOT (marks > 0.3 * nw OR (menu >= 2 AND menu >= 0.2 * nw))
  AND NOT (low LIKE '%cookie%' OR low LIKE '%javascript%' OR low LIKE '%terms of%' OR low LIKE '%privacy policy%' OR low LIKE '%rights reserved%'
    OR low LIKE '%copyright%' OR low LIKE '%licensed under%' OR low LIKE '%lorem ipsum%' OR low LIKE '%click here%') GROUP BY doc_id),
base AS (SELECT words.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(reps.n, 0)::BIGINT AS n_repeat_words, coalesce(clean.chars, 0)::BIGINT AS clean_chars
  FROM words JOIN lines USING (doc_id) LEFT JOIN reps USING (doc_id) LEFT JOIN clean USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, clean_chars,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND word_chars - clean_chars <= 0.5 * word_chars AS kept FROM base
""",
)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_chars", "base_failed", "kept")


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fresh_path
    from .token_files import read_token_files, write_token_files

    docs, uri = _table(spark, sf_dir, "documents"), fresh_path(spark, "token-files")
    shards = write_token_files(docs, uri, _tokenizer())
    return read_token_files(spark, uri, shards, docs.schema["doc_id"].dataType.simpleString())


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer())


@query(
    "op5_warc",
    """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < kept THEN kept END AS refers_to FROM p LEFT JOIN k USING (payload_digest)
""",
)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fresh_path
    from .warc import read_warc, write_warc

    uri, pages = fresh_path(spark, "warc"), _table(spark, sf_dir, "pages")
    return read_warc(spark, uri, write_warc(pages, uri), id_type=pages.schema["page_id"].dataType.simpleString())


@query("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited_fingerprints

    return edited_fingerprints(_table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


#: The queries' key; a deployment passes its own, from where it keeps secrets.
DEMO_KEY = b"strandline queries"


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonyms

    out = pseudonyms(_table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), F.concat_ws(",", F.array_sort(F.transform("pii", lambda x: x["kind"]))).alias("kinds"))


@query("op10_mixing")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "epoch", "block_order", "doc_order")


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    # a cut may fall inside a character, whose bytes the text then shows as U+FFFD; the digest is of the bytes
    return remove_repeats(_table(spark, sf_dir, "documents")).withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")
