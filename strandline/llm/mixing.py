"""Mixing sources to target weights by temperature (operator 10): built-in functions only.

A source's share p of the tokens becomes a weight proportional to p ** alpha. The exponent is found by bisection, many
points in one pass over the per-source sums: the smallest one that keeps to a repetition limit, or the one that meets a
target entropy. A source's budget is its weight's part of the total. It is realised in epochs: whole passes over the
source, each a permutation of blocks of documents, and a last pass that takes blocks in their permuted order, then
documents of one block in theirs, as far as the budget goes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mixture:
    """alpha, total (tokens of the mixture), and per source a row of weights: source, tokens, docs, weight, budget."""

    alpha: float
    total: float
    weights: DataFrame


def words(text: Column) -> Column:
    """The token count that budgets are kept in: words, one at least, so that an empty document takes its turn."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)), F.lit(1)).cast("long")


def _moments(sums: DataFrame, tokens: float, alphas: list[float]) -> list[dict[str, float]]:
    """Per exponent: z (the sum of p ** alpha), entropy of the weights, and the largest and least p ** (alpha - 1)."""
    share = F.col("tokens") / F.lit(tokens)
    columns = []
    for i, a in enumerate(alphas):
        power = F.pow(share, F.lit(a))
        columns += [F.sum(power).alias(f"z{i}"), F.sum(power * F.ln(share)).alias(f"l{i}"), F.max(power / share).alias(f"most{i}"), F.min(power / share).alias(f"least{i}")]
    row = sums.agg(*columns).first()
    return [{"z": row[f"z{i}"], "entropy": math.log(row[f"z{i}"]) - a * row[f"l{i}"] / row[f"z{i}"], "most": row[f"most{i}"], "least": row[f"least{i}"]} for i, a in enumerate(alphas)]


def temperature(sums: DataFrame, *, repetition_limit: float | None = None, target_entropy: float | None = None, total_tokens: float | None = None, points: int = 16, exact: float = 1e-10) -> Mixture:
    """The mixture for per-source sums (source, tokens, docs; no source without tokens).

    repetition_limit: no source is seen more often on average; target_entropy: of the weights, in nats, at most; both:
    both hold. Both quantities fall as alpha grows from 0 (equal weights) to 1 (the sources' own shares); where even
    alpha = 1 doesn't meet a target, 1 is taken. total_tokens: by default the least total that uses every document of
    every source. The driver sees sums over sources only, however many sources there are.
    """
    tokens = sums.agg(F.sum("tokens")).first()[0]
    if not tokens:
        return Mixture(1.0, 0.0, sums.withColumns({"weight": F.lit(0.0), "budget": F.lit(0.0)}))

    def repeats(m: dict[str, float]) -> float:
        return m["most"] / m["least"] if total_tokens is None else total_tokens / tokens / m["z"] * m["most"]

    def meets(m: dict[str, float]) -> bool:
        return (repetition_limit is None or repeats(m) <= repetition_limit * (1 + 1e-12)) and (target_entropy is None or m["entropy"] <= target_entropy + 1e-12)

    low, high = 0.0, 1.0
    if meets(_moments(sums, tokens, [0.0])[0]):
        high = 0.0
    while high - low > exact:
        grid = [low + (high - low) * (i + 1) / (points + 1) for i in range(points)]
        good = [a for a, m in zip(grid, _moments(sums, tokens, grid), strict=True) if meets(m)]
        high, low = min([*good, high]), max([low, *(a for a in grid if not good or a < good[0])])
    at = _moments(sums, tokens, [high])[0]
    total = tokens * at["z"] / at["least"] if total_tokens is None else float(total_tokens)
    weight = F.pow(F.col("tokens") / F.lit(tokens), F.lit(high)) / F.lit(at["z"])
    return Mixture(high, total, sums.withColumn("weight", weight).withColumn("budget", F.col("weight") * F.lit(total)))


def mix(
    docs: DataFrame, *, repetition_limit: float | None = 2.0, target_entropy: float | None = None, total_tokens: float | None = None, seed: int = 0,
    block_docs: int = 1000, in_order: bool = False, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """docs, each row as often as the mixture takes it, with epoch (from 0), block_order and doc_order (longs).

    Within an epoch and source, the permutation is by block_order, then doc_order. The last, partial epoch of a source
    stops before the document that would exceed its budget, so a source's tokens miss its budget by less than one
    document (rows that tie in the permutation, such as repeated rows, are taken or left together). A null source is a
    source of its own; a null id is permuted by its text; a null or empty text counts as one word; an empty table
    gives none. Columns of docs with one of the three new names are replaced. in_order: rows are dealt by ranges of epoch,
    block_order and doc_order and lie in that order, over all sources, so that a table written from them can be read as
    the mixture's stream; copies of a document are an epoch apart.

    A source is dealt into blocks by hash, so that no task holds a source: sums are per source and block, the cut block
    alone is ordered by document, and documents meet a table with one row for each source, whose size the planner
    checks before it broadcasts it; else the join is salted by block.
    """
    docs = docs.drop("epoch", "block_order", "doc_order")
    source, ident = F.col(f"`{source_col}`"), F.col(f"`{id_col}`")
    place = F.xxhash64(F.lit(seed), ident, F.when(ident.isNull(), F.col(f"`{text_col}`")))
    slim = written(docs.select(source.alias("source"), place.alias("place"), words(F.col(f"`{text_col}`")).alias("tokens")), "mixing-rows")
    sums = written(slim.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mixing-sums")
    mixture = temperature(sums, repetition_limit=repetition_limit, target_entropy=target_entropy, total_tokens=total_tokens)
    most = sums.agg(F.max("docs")).first()[0] or 1
    blocks = 1 << max(6, math.ceil(math.log2(most / block_docs + 1)))

    def block(p: Column) -> Column:
        return F.pmod(p, F.lit(blocks))

    def block_order(p: Column, epoch: Column) -> Column:
        return F.xxhash64(F.lit(seed), F.lit("block"), epoch, block(p))

    def doc_order(p: Column, epoch: Column) -> Column:
        return F.xxhash64(F.lit(seed), F.lit("document"), epoch, p)

    # whole epochs, and the tokens left for the last one
    plan = mixture.weights.withColumn("whole", F.floor(F.col("budget") / F.col("tokens") + 1e-9)).withColumn("rest", F.greatest(F.col("budget") - F.col("whole") * F.col("tokens"), F.lit(0.0)))
    plan = written(plan.select("source", "weight", "budget", "whole", "rest"), "mixing-plan")
    per_block = slim.groupBy("source", block(F.col("place")).alias("place")).agg(F.sum("tokens").alias("tokens"))
    ordered = per_block.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select("p.source", "p.rest", "b.place", "b.tokens", block_order(F.col("place"), F.col("whole")).alias("order"))
    run = Window.partitionBy("source").orderBy("order", "place")
    cut = ordered.withColumn("before", F.sum("tokens").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    # the first block that doesn't fit whole; no such block: every block does
    cut = cut.where(F.col("before") + F.col("tokens") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct("order", "place", (F.col("rest") - F.col("before")).alias("left")), "before").alias("cut"))
    cut = written(cut.select("source", F.col("cut.order").alias("cut_order"), F.col("cut.place").alias("cut_block"), F.col("cut.left").alias("left")), "mixing-cuts")
    whole = plan.select(F.col("source").alias("s"), "whole")
    edge = slim.alias("d").join(cut.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (block(F.col("d.place")) == F.col("c.cut_block"))).join(whole, F.col("c.source").eqNullSafe(F.col("s")))
    edge = edge.select("c.source", "left", "tokens", doc_order(F.col("place"), F.col("whole")).alias("order"))
    fits = Window.partitionBy("source").orderBy("order").rangeBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("so_far", F.sum("tokens").over(fits)).where("so_far <= left").groupBy("source").agg(F.max("order").alias("cut_doc"))
    rules = plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").join(edge.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
    salts = 32
    names = ["source", "whole", "cut_order", "cut_block", "cut_doc", "salt"]
    rules = rules.select(F.col("p.source").alias("source"), "whole", "cut_order", "cut_block", "cut_doc").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # names that no column of docs has
    rules = written(rules.toDF(*(f"__strandline_{n}" for n in names)), "mixing-rules")
    rule_source, whole, cut_order, cut_block, cut_doc, salt = (F.col(f"__strandline_{n}") for n in names)

    p = F.col("__strandline_place")
    met = docs.withColumn("__strandline_place", place).join(rules, source.eqNullSafe(rule_source) & (F.pmod(p, F.lit(salts)) == salt))
    order = block_order(p, whole)
    in_cut = (order == cut_order) & (block(p) == cut_block)
    last = cut_order.isNull() | F.when(in_cut, F.coalesce(doc_order(p, whole) <= cut_doc, F.lit(False))).otherwise(F.struct(order, block(p)) < F.struct(cut_order, cut_block))
    copies = (whole + last.cast("int")).cast("int")
    epochs = F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))
    out = met.withColumn("epoch", F.explode(epochs)).withColumns({"block_order": block_order(p, F.col("epoch").cast("long")), "doc_order": doc_order(p, F.col("epoch").cast("long"))})
    out = out.drop("__strandline_place", *(f"__strandline_{n}" for n in names))
    if not in_order:
        return out
    # repeated rows tie in the permutation: their place in the input deals them to several ranges
    order = ["epoch", "block_order", "doc_order", "__strandline_row"]
    return out.withColumn(order[-1], F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop(order[-1])
