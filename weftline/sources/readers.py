"""Scans of JSON, CSV, Markdown and graph files, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.graph import ContextGraph


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, as a plain CSV reader has them."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def markdown_dir(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the policy documents: no dot files, order papers, readmes or blank files."""
    t = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    t = t.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    skip = F.lower("file").rlike("^(\\.|invoice|purchase_order|shipping_order|readme)")
    return t.where(~skip & (F.trim(F.regexp_replace("text", "\\s", "")) != ""))


def any_file(spark: SparkSession, path: str, limit: int = 1000) -> DataFrame:
    """JSON list, object of objects (the key as `_key`), single object or CSV; at most `limit` records, as a sampling operator."""
    if path.lower().endswith(".csv"):
        return csv(spark, path).limit(limit)
    df = json_array(spark, path)
    fields = [f for f in df.schema.fields if f.name != "_corrupt_record"]
    if len(fields) > 1 and all(isinstance(f.dataType, T.StructType) for f in fields) and len(df.take(2)) == 1:
        value = T._parse_datatype_string("map<string,string>")
        raw = spark.read.text(path, wholetext=True).select(F.from_json("value", value).alias("m")).select(F.explode("m").alias("_key", "_json"))
        sample = fields[0].dataType
        for f in fields[1:]:
            sample = T.StructType(sample.fields + [x for x in f.dataType.fields if x.name not in sample.names])
        return raw.select("_key", F.from_json("_json", sample).alias("r")).select("_key", "r.*").limit(limit)
    return df.limit(limit)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of all JSON and CSV files below a folder; the files' contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,csv}").load(root)
    return f.select("path", F.col("length").alias("size"))


def save_graph(g: ContextGraph, path: str) -> None:
    """Tables partitioned by type and relation, so that lookups by either prune files."""
    g.nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> ContextGraph:
    return ContextGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def import_graph_json(spark: SparkSession, path: str) -> ContextGraph:
    """A graph document {nodes: [...], edges: [...]}; property values become JSON text, in a map."""
    schema = "nodes array<struct<id:string,type:string,properties:map<string,string>>>, edges array<struct<source:string,target:string,rel_type:string>>"
    d = spark.read.option("multiLine", True).schema(schema).json(path)
    n = d.select(F.posexplode("nodes").alias("ord", "n")).select(
        F.col("n.id").alias("node_id"), F.col("n.type").alias("node_type"), F.col("ord").cast("long").alias("ord"),
        F.coalesce(*[F.try_element_at("n.properties", F.lit(k)) for k in "name business_name subject issue title summary".split()], F.col("n.id")).alias("title"),
        F.array_join(F.map_values("n.properties"), " ").alias("text"), F.col("n.properties").alias("properties"),
    )
    e = d.select(F.posexplode("edges").alias("ord", "e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.col("e.rel_type").alias("rel_type"), F.col("ord").cast("long").alias("ord"))
    return ContextGraph(n, e)


def export_texts(nodes: DataFrame, path: str, node_types: list[str] | None = None, limit: int | None = None) -> None:
    """One JSON line per node: id, type, text; for an index elsewhere. `limit` is the exporter's own option."""
    n = nodes.where(F.lower("node_type").isin([t.lower() for t in node_types])) if node_types else nodes
    n = n.orderBy("ord", "node_id").limit(limit) if limit else n
    n.select("node_id", "node_type", F.coalesce("text", F.lit("")).alias("text")).write.mode("overwrite").json(path)
