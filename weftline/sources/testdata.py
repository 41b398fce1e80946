"""The TPC-H-like tables as a graph: customers, vendors, products, sales, departments, threads and emails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.graph import ContextGraph, last_wins
from weftline.runtime import table


def _nodes(df: DataFrame, node_type: str, key: str, title: str, summary: str | None = None) -> DataFrame:
    return df.select(
        T.node_id(node_type, F.col(key)).alias("node_id"), F.lit(node_type).alias("node_type"), F.col(key).cast("long").alias("ord"),
        F.col(title).cast("string").alias("title"), (F.col(summary).cast("string") if summary else F.lit("")).alias("summary"), F.col(title).cast("string").alias("text"),
    )


def nodes(spark: SparkSession, d: str) -> DataFrame:
    out = _nodes(table(spark, d, "customer"), "Customer", "c_custkey", "c_name", "c_mktsegment")
    out = out.unionByName(_nodes(table(spark, d, "supplier"), "Vendor", "s_suppkey", "s_name"))
    out = out.unionByName(_nodes(table(spark, d, "part"), "Product", "p_partkey", "p_name", "p_brand"))
    out = out.unionByName(_nodes(table(spark, d, "orders"), "Sale", "o_orderkey", "o_orderkey", "o_orderpriority"))
    out = out.unionByName(_nodes(table(spark, d, "nation"), "Department", "n_nationkey", "n_name"))
    threads = table(spark, d, "conversations").select("conv_id").distinct()
    return out.unionByName(_nodes(threads, "EmailThread", "conv_id", "conv_id"))


def _edge(src, dst, rel: str, order) -> list:
    return [src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel_type"), order.cast("long").alias("ord")]


def written_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges as they are written, repetitions included."""
    c, s, o, li = (table(spark, d, x) for x in ("customer", "supplier", "orders", "lineitem"))
    dept = lambda x: T.node_id("Department", F.col(x))
    out = c.select(*_edge(T.node_id("Customer", F.col("c_custkey")), dept("c_nationkey"), "works_in", F.col("c_custkey")))
    out = out.unionByName(s.select(*_edge(T.node_id("Vendor", F.col("s_suppkey")), dept("s_nationkey"), "works_in", F.col("s_suppkey"))))
    out = out.unionByName(o.select(*_edge(T.node_id("Customer", F.col("o_custkey")), T.node_id("Sale", F.col("o_orderkey")), "purchased", F.col("o_orderkey"))))
    return out.unionByName(li.select(*_edge(T.node_id("Sale", F.col("l_orderkey")), T.node_id("Product", F.col("l_partkey")), "product_in_sale", F.col("l_linenumber"))))


def graph(spark: SparkSession, d: str) -> ContextGraph:
    return ContextGraph(nodes(spark, d), last_wins(written_edges(spark, d)))


#: Sources of the change feed, by event_id modulo their number.
FEED_SOURCES = ("Human_Resource_Management", "Enterprise_Mail_System", "Customer_Relation_Management", "Collaboration_tools", "Business_and_Management")


def change_feed(spark: SparkSession, d: str) -> DataFrame:
    """events as upserts of a user's properties: node_id, node_type, key, value, source_system, ord, human."""
    e = table(spark, d, "events")
    src = F.element_at(F.array(*[F.lit(x) for x in FEED_SOURCES]), (F.pmod("event_id", F.lit(len(FEED_SOURCES))) + 1).cast("int"))
    kind = F.when(F.col("user_id") % 3 == 0, "Employee").when(F.col("user_id") % 3 == 1, "Customer").otherwise("Email")
    return e.select(
        F.concat(kind, F.lit(":"), F.col("user_id").cast("string")).alias("node_id"), kind.alias("node_type"), F.col("event_type").alias("key"),
        F.floor("value").cast("string").alias("value"), src.alias("source_system"), F.col("event_id").alias("ord"), (F.col("event_id") % 97 == 0).alias("human"),
    )
