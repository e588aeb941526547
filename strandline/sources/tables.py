"""The supplied tables as a graph."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.graph import Graph
from strandline.operators.temporal import chain
from strandline.sources.catalog import Catalog

CLOCK = datetime.datetime(2024, 2, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def follows(events: DataFrame) -> DataFrame:
    """src, dst, valid_from: each event's user follows the user of the event before it.

    The order is global, so events are cut into days: a window for each day, and one over the days' last events.
    """
    day = F.to_date("ts")
    rows = events.select("event_id", "ts", F.col("user_id").alias("src"), day.alias("day"))
    inside = Window.partitionBy("day").orderBy("ts", "event_id")
    rows = rows.withColumn("dst", F.lead("src").over(inside)).withColumn("since", F.lead("ts").over(inside))
    firsts = rows.groupBy("day").agg(F.min_by("src", F.struct("ts", "event_id")).alias("first_src"), F.min("ts").alias("first_ts"))
    days = firsts.select("day", F.lead("first_src").over(Window.orderBy("day")).alias("next_src"), F.lead("first_ts").over(Window.orderBy("day")).alias("next_ts"))
    out = rows.join(F.broadcast(days), "day")  # one row a day
    out = out.select("src", F.coalesce("dst", "next_src").alias("dst"), F.coalesce("since", "next_ts").alias("valid_from"))
    return out.where("dst is not null").withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))


_catalogs: dict[tuple[str, str], Catalog] = {}


def tpch_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The tables in a folder as a graph; its plans are made once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _catalogs:
        _catalogs[key] = _tables(spark, sf_dir).catalog
    g = Graph(spark, clock=CLOCK)
    g.catalog = _catalogs[key].copy()
    return g


def _tables(spark: SparkSession, sf_dir: str) -> Graph:
    """Region, Nation, Customer, Supplier, Part, Order, Document, Label, Page, User, EventType and Vec nodes, and their
    relationships. Nothing is read before a query needs it, and then only the columns that it names."""
    t = lambda name: table(spark, sf_dir, name)
    g = Graph(spark, clock=CLOCK)
    for label, name, key in (("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey"), ("Document", "documents", "doc_id"), ("Page", "pages", "page_id")):
        g.add_nodes(t(name), label, key)
    events = t("events")
    g.add_nodes(events.select(F.col("user_id").alias("id")).distinct(), "User", "id")
    g.add_nodes(events.select(F.col("event_type").alias("name")).distinct(), "EventType", "name")
    labels = t("labels")
    g.add_nodes(labels.select(F.col("doc_id").alias("label_id"), "quality", "toxic"), "Label", "label_id")
    g.add_rels(labels.select(F.col("doc_id").alias("src"), F.col("doc_id").alias("dst")), "LABELLED", "Document", "Label")
    g.add_rels(t("nation").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")), "PART_OF", "Nation", "Region")
    g.add_rels(t("customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")), "LOCATED_IN", "Customer", "Nation")
    g.add_rels(t("supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst")), "LOCATED_IN", "Supplier", "Nation")
    orders, items = t("orders"), t("lineitem")
    g.add_rels(orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderdate").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to")), "PLACED", "Customer", "Order")
    measures = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    g.add_rels(items.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), *measures), "CONTAINS", "Order", "Part")
    g.add_rels(items.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_quantity"), "SUPPLIED_BY", "Order", "Supplier")
    states = chain(events.select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), "value", "ts", "event_id"), "src", "ts", ["event_id"])
    g.add_rels(states.select("src", "dst", "value", "event_id", "valid_from", "valid_to"), "STATE", "User", "EventType", key="event_id")
    g.add_rels(follows(events), "FOLLOWS", "User", "User")
    vectors = t("embeddings")
    g.add_nodes(vectors.select("label").distinct().withColumnRenamed("label", "id"), "Topic", "id")
    g.add_nodes(vectors.select(F.col("vec_id").alias("id"), "label"), "Vec", "id")
    single = vectors.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"), F.lit("1970-01-01").cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    g.add_embeddings(single, "Vec")
    since = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("vec_id").cast("decimal(18,6)"))
    stamped = vectors.select(F.col("label").alias("node_id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("seq"), since.alias("since"))
    g.add_embeddings(chain(stamped, "node_id", "since", ["seq"]).drop("since"), "Topic")
    return g
