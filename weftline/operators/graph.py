"""The property graph as DataFrames, and the lookups over it.

A graph holds nodes (node_id, node_type, ord, title, summary, text) and edges (src, dst, rel_type, ord,
role). `ord` is the order in which records came; an edge is identified by (src, dst, rel_type) and the
last one written counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import Scratch, shuffle_partitions


@dataclass
class ContextGraph:
    nodes: DataFrame
    edges: DataFrame

    # ---- single lookups

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("node_id") == node_id)

    def by_type(self, node_type: str) -> DataFrame:
        return self.nodes.where(F.col("node_type") == node_type).orderBy("ord", "node_id")

    def page(self, node_type: str, offset: int, limit: int) -> DataFrame:
        """A page in order of arrival, each row with the total."""
        rows = self.nodes.where(F.col("node_type") == node_type)
        total = rows.agg(F.count("*").alias("total"))
        return rows.orderBy("ord", "node_id").offset(offset).limit(limit).join(F.broadcast(total))  # one row

    def both_ways(self) -> DataFrame:
        """Each edge from both of its ends: node_id, other, rel_type, direction, ord."""
        e = self.edges
        out = e.select(F.col("src").alias("node_id"), F.col("dst").alias("other"), "rel_type", F.lit("outgoing").alias("direction"), "ord")
        return out.unionByName(e.select(F.col("dst").alias("node_id"), F.col("src").alias("other"), "rel_type", F.lit("incoming").alias("direction"), "ord"))

    def neighbours(self, ids: DataFrame, rel_type: str | None = None, direction: str = "both") -> DataFrame:
        """A row per edge at the given nodes (column node_id), with the other end's type and title."""
        e = self.both_ways().where((F.col("rel_type") == rel_type) if rel_type else F.lit(True))
        if direction != "both":
            e = e.where(F.col("direction") == direction)
        far = self.nodes.select(F.col("node_id").alias("other"), F.col("node_type").alias("other_type"), F.col("title").alias("other_title"))
        return e.join(ids.select("node_id").distinct(), "node_id", "left_semi").join(far, "other")

    def degree(self) -> DataFrame:
        return self.both_ways().groupBy("node_id").agg(F.count("*").alias("degree"))

    # ---- statistics

    def nodes_by_type(self) -> DataFrame:
        return self.nodes.groupBy("node_type").agg(F.count("*").alias("n"))

    def edges_by_rel(self) -> DataFrame:
        return self.edges.groupBy("rel_type").agg(F.count("*").alias("n"))

    def stats(self, conflicts: DataFrame | None = None) -> DataFrame:
        """(metric, name, n): totals, counts by type and relation, conflicts by status."""
        one = lambda df, m: df.agg(F.count("*").alias("n")).select(F.lit(m).alias("metric"), F.lit("").alias("name"), "n")
        by = lambda df, m, c: df.groupBy(c).agg(F.count("*").alias("n")).select(F.lit(m).alias("metric"), F.col(c).alias("name"), "n")
        out = one(self.nodes, "nodes").unionByName(one(self.edges, "edges"))
        out = out.unionByName(by(self.nodes, "nodes_by_type", "node_type")).unionByName(by(self.edges, "edges_by_rel", "rel_type"))
        return out.unionByName(by(conflicts, "conflicts", "status")) if conflicts is not None else out

    # ---- search and walks

    def substring_search(self, text: str, limit: int = 20) -> DataFrame:
        """The first nodes, in order of arrival, whose search text contains the words."""
        hit = F.contains(F.lower("text"), F.lit(text.lower()))
        return self.nodes.where(hit).orderBy("ord", "node_id").limit(max(limit, 1))

    def related(self, start: str, *, hops: int = 1, limit: int = 6) -> DataFrame:
        """Breadth-first: (node_id, depth, rank), out-edges before in-edges, each node once, at most `limit`.

        The driver holds the walk, at most `limit` nodes. Each hop names its nodes as literals, a filter that
        reaches below the edges' deduplication, so only the edges at hand are shuffled.
        """
        walk = self.both_ways().withColumn("way", F.when(F.col("direction") == "outgoing", 0).otherwise(1))
        found: list[tuple[str, int, int]] = []
        front = {start: 0}
        for depth in range(1, hops + 1):
            left = limit - len(found)
            if left <= 0 or not front:
                break
            place = F.create_map(*[F.lit(x) for kv in front.items() for x in kv])[F.col("node_id")]
            step = walk.where(F.col("node_id").isin(*front) & ~F.col("other").isin(start, *(n for n, _, _ in found)))
            first = step.groupBy("other").agg(F.min(F.struct(place.alias("p"), "way", "ord", "rel_type")).alias("o"))
            got = [r["other"] for r in first.orderBy("o", "other").limit(left).collect()]
            front = {n: len(found) + i for i, n in enumerate(got, 1)}
            found += [(n, depth, r) for n, r in front.items()]
        return self.nodes.sparkSession.createDataFrame(found, "node_id string, depth int, rank int")

    def layers(self, focus: DataFrame, scenario: DataFrame | None = None) -> DataFrame:
        """(node_id, layer): core, direct (one hop, or named), context (two hops), ambient; edges count both ways.

        Each ring is stored, so a hop walks the edges once.
        """
        scratch = Scratch(self.nodes.sparkSession)
        e = self.both_ways().select("node_id", "other")  # what is reached is made distinct, not all edges
        core = focus.select("node_id").distinct()
        direct = e.join(core, "node_id", "left_semi").select(F.col("other").alias("node_id"))
        if scenario is not None:
            direct = direct.unionByName(scenario.select("node_id"))
        direct = scratch.save(direct.distinct().join(core, "node_id", "left_anti"), "direct")
        context = e.join(direct, "node_id", "left_semi").select(F.col("other").alias("node_id")).distinct()
        context = scratch.save(context.join(direct, "node_id", "left_anti").join(core, "node_id", "left_anti"), "context")
        known = core.withColumn("layer", F.lit("core")).unionByName(direct.withColumn("layer", F.lit("direct"))).unionByName(context.withColumn("layer", F.lit("context")))
        return self.nodes.select("node_id").join(known, "node_id", "left").select("node_id", F.coalesce("layer", F.lit("ambient")).alias("layer"))

    def link_strength(self, layers: DataFrame) -> DataFrame:
        """Strong: touches the core, or both ends are direct; else soft."""
        a = layers.select(F.col("node_id").alias("src"), F.col("layer").alias("a"))
        b = layers.select(F.col("node_id").alias("dst"), F.col("layer").alias("b"))
        strong = (F.col("a") == "core") | (F.col("b") == "core") | ((F.col("a") == "direct") & (F.col("b") == "direct"))
        return self.edges.join(a, "src").join(b, "dst").select("src", "dst", "rel_type", F.when(strong, "strong").otherwise("soft").alias("strength"))


def last_wins(edges: DataFrame, key: tuple[str, ...] = ("src", "dst", "rel_type"), order: str = "ord") -> DataFrame:
    """One edge for each key, the last written. The aggregate combines before the shuffle, unlike a window.

    Without further columns it is the greatest order, which is hashed, not sorted; then rows are shuffled first, so that
    no task gathers the keys of a whole file.
    """
    rest = [c for c in edges.columns if c not in (*key, order)]
    if not rest:
        return edges.repartition(shuffle_partitions(edges.sparkSession), *key).groupBy(*key).agg(F.max(order).alias(order))
    best = edges.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("_r"))
    return best.select(*key, f"_r.{order}", *[f"_r.{c}" for c in rest])


def guarded(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*edges.columns)


def top_per(df: DataFrame, by: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group, with rank `rn` and the group's size `group_size`; rows without a group go.

    Both are windows over one shuffle, so the rows are made once; a group's rows spill.
    """
    w = Window.partitionBy(by)
    ranked = df.where(F.col(by).isNotNull()).withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("group_size", F.count("*").over(w))
    return ranked.where(F.col("rn") <= n).select(by, *[c for c in df.columns if c != by], "rn", "group_size")
