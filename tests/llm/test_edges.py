"""Every operator on rows that are null in any column, repeated, very long, and beside columns with its own names."""

import public_tokenizers
import pytest
from brute import documents
from pyspark.sql import functions as F

from strandline.llm.fingerprints import edited_fingerprints
from strandline.llm.mixing import mix
from strandline.llm.packing import pack
from strandline.llm.pii import pseudonyms
from strandline.llm.quality import quality_rules
from strandline.llm.simhash import near_duplicates
from strandline.llm.suffix_dedup import remove_repeats
from strandline.llm.token_counts import token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CLASHES = ["id", "fp", "data", "sum", "kept", "epoch", "pii", "words", "bucket", "next_text", "canon", "h1", "component_id", "n_tokens", "clean_text", "whole", "place", "spans"]
LONG = " ".join(f"word{i * 7919 % 100003}" for i in range(200_000))

OPERATORS = {
    "quality": lambda d: quality_rules(d),
    "simhash": lambda d: near_duplicates(d),
    "packing": lambda d: pack(d, BPE).where("start = 0"),
    "fingerprints": lambda d: edited_fingerprints(d),
    "suffix": lambda d: remove_repeats(d),
    "counts": lambda d: token_counts(d, RANKS),
    "pii": lambda d: pseudonyms(d, b"k"),
    "mixing": lambda d: mix(d).where("epoch = 0"),
}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, None, None), (None, "a b", None), (1, None, "a"), (2, "", "a"), (3, LONG, "a"), (4, "tie", "b"), (4, "tie", "b"), (4, "other", "b"), (5, "\x00퟿\U0010ffff", "b")]
    docs = documents(spark, rows).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long"))
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)}).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_has_its_result(odd, name):
    out = OPERATORS[name](odd).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(odd, name):
    assert OPERATORS[name](odd.where("false")).count() == 0
