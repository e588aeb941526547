"""Views over the version log: snapshots, versions, the timeline, statistics and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.catalog import FROM, TO, Catalog, NodeTable, Time, valid, with_validity


def chain(df: DataFrame, key: str | list[str], since: str, order: list[str] | None = None) -> DataFrame:
    """Events of a key as versions: each is valid from its time to the next one's (valid_from, valid_to)."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(since, *(order or []))
    return df.withColumn(FROM, F.col(since)).withColumn(TO, F.lead(since).over(w))


def versions(table: NodeTable, node_id: object) -> DataFrame:
    """All versions of a node, oldest first."""
    t = with_validity(table)
    return t.df.where(F.col(f"`{t.key}`") == F.lit(node_id)).orderBy(FROM, TO)


def _json(table: NodeTable) -> Column:
    return F.to_json(F.struct(*(F.col(f"`{p}`") for p in table.props)))


def timeline(catalog: Catalog) -> DataFrame:
    """timestamp, type, description for the creation and end of every version of every table."""
    parts = []
    for t in catalog.nodes:
        x = with_validity(t).df
        who = F.concat(F.lit(f"{t.label} "), F.col(f"`{t.key}`").cast("string"))
        parts.append(x.select(F.col(FROM).alias("timestamp"), F.lit("CREATE_NODE").alias("type"), who.alias("description")))
        parts.append(x.where(F.col(TO).isNotNull()).select(F.col(TO).alias("timestamp"), F.lit("DELETE_NODE").alias("type"), who.alias("description")))
    for t in catalog.rels:
        x = with_validity(t).df
        who = F.concat(F.lit(f"{t.type} "), F.col(f"`{t.src}`").cast("string"), F.lit(" -> "), F.col(f"`{t.dst}`").cast("string"))
        parts.append(x.select(F.col(FROM).alias("timestamp"), F.lit("CREATE_REL").alias("type"), who.alias("description")))
        parts.append(x.where(F.col(TO).isNotNull()).select(F.col(TO).alias("timestamp"), F.lit("DELETE_REL").alias("type"), who.alias("description")))
    return reduce(DataFrame.unionByName, parts)


def stats(catalog: Catalog) -> DataFrame:
    """kind, name, versions, current for each table."""
    parts = []
    for kind, tables in (("node", catalog.nodes), ("relationship", catalog.rels)):
        for t in tables:
            name = t.label if isinstance(t, NodeTable) else t.type
            current = F.count(F.when(F.col(TO).isNull(), 1)) if t.versioned else F.count(F.lit(1))
            parts.append(t.df.agg(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("versions"), current.alias("current")))
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "name").agg(F.sum("versions").alias("versions"), F.sum("current").alias("current"))


def grouped_versions(table: NodeTable) -> DataFrame:
    """id, n_versions and the versions' intervals in order, for each node."""
    t = with_validity(table)
    spans = F.sort_array(F.collect_list(F.struct(FROM, TO)))
    return t.df.groupBy(F.col(f"`{t.key}`").alias("id")).agg(F.count(F.lit(1)).alias("n_versions"), spans.alias("versions"))


def export(catalog: Catalog, at: Time = None) -> DataFrame:
    """kind, label, id, source, target, json of all that is valid at a time."""
    parts = []
    for t in catalog.nodes:
        none = F.lit(None).cast("string")
        parts.append(valid(t.df, at).select(F.lit("node").alias("kind"), F.lit(t.label).alias("label"), F.col(f"`{t.key}`").cast("string").alias("id"), none.alias("source"), none.alias("target"), _json(t).alias("json")))
    for r in catalog.rels:
        props = F.to_json(F.struct(*(F.col(f"`{p}`") for p in r.props))) if r.props else F.lit("{}")
        key = F.col(f"`{r.key}`").cast("string") if r.key else F.lit(None).cast("string")
        parts.append(valid(r.df, at).select(F.lit("relationship").alias("kind"), F.lit(r.type).alias("label"), key.alias("id"), F.col(f"`{r.src}`").cast("string").alias("source"), F.col(f"`{r.dst}`").cast("string").alias("target"), props.alias("json")))
    return reduce(DataFrame.unionByName, parts)
