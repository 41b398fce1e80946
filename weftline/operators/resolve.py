"""Entity resolution: block, score pairs, cluster, decide, mutate.

Blocking is an equi-join on (rule, block key). Exact-name clusters come from key equality without any
pairs, so a block of thousands of equal names costs no pair table; pairs are made only where scores are
asked for. Clusters never span blocks, since every node has one block key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.dims import CONFLICT_CAP, CROSS_LINK_AT, LINK_AT, MERGE_AT
from weftline.functions import text as T
from weftline.runtime import Scratch, shuffle_partitions


@dataclass(frozen=True)
class Rule:
    name: str
    types: tuple[str, ...]
    prefix: int


RULES = (Rule("business_orgs", ("Client", "Vendor"), 4), Rule("products", ("Product",), 8), Rule("policies", ("Policy",), 4))

#: Columns a candidate table may have; missing ones count as null.
FIELDS = ("name", "tax_id", "address", "industry", "contact_email", "phone_number", "representative")


def candidates(nodes: DataFrame, rule: Rule) -> DataFrame:
    """Nodes of the rule's types with their normalised fields and block key (node_id, node_type, ord, plus FIELDS)."""
    n = nodes.where(F.col("node_type").isin(*rule.types))
    for f in FIELDS:
        if f not in n.columns:
            n = n.withColumn(f, F.lit(None).cast("string"))
    n = n.withColumn("nn", T.business_name(F.col("name"))).withColumn("na", T.address(F.col("address")))
    n = n.withColumn("zip", T.zip_code(F.col("address"))).withColumn("em", T.email(F.col("contact_email"))).withColumn("ph", T.phone(F.col("phone_number")))
    return n.withColumn("block", F.substring("nn", 1, rule.prefix)).select("node_id", "node_type", "ord", "block", "nn", "na", "zip", "em", "ph", F.trim("tax_id").alias("tax"), F.lower(F.trim("industry")).alias("ind"), F.trim("representative").alias("rep"))


def block_sizes(cands: DataFrame) -> DataFrame:
    return cands.groupBy("block").agg(F.count("*").alias("n")).select("block", "n", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))


def pairs(cands: DataFrame) -> DataFrame:
    """Unordered pairs inside a block, the lower ordinal as a.

    Blocks are spread over all shuffle partitions: few rows make many pairs, so their bytes don't tell how many tasks they need.
    """
    cands = cands.repartition(shuffle_partitions(cands.sparkSession), "block")
    a = cands.select(*[F.col(c).alias(f"a_{c}") for c in cands.columns])
    b = cands.select(*[F.col(c).alias(f"b_{c}") for c in cands.columns])
    return a.join(b, (F.col("a_block") == F.col("b_block")) & (F.struct("a_ord", "a_node_id") < F.struct("b_ord", "b_node_id")))


def _both(c: str) -> Column:
    return (F.col(f"a_{c}") == F.col(f"b_{c}")) & (F.col(f"a_{c}") != "")


def _differ(c: str) -> Column:
    return (F.col(f"a_{c}") != F.col(f"b_{c}")) & (F.col(f"a_{c}") != "") & (F.col(f"b_{c}") != "")


def _strategies(name_sim: Column, addr_sim: Column) -> list[tuple[Column, str]]:
    """What each strategy gives, null where it says nothing."""
    zips = F.col("a_zip").isNotNull() & (F.col("a_zip") == F.col("b_zip"))
    return [
        (F.when(_both("tax"), 1.0), "tax_id identical"),
        (F.when(_both("nn"), 0.55), "name exact"),
        (F.when(name_sim >= 0.92, 0.45).when(name_sim >= 0.80, 0.25), "name similar"),
        (F.when(_both("na"), 0.7).when(addr_sim >= 0.85, 0.5).when(zips & (addr_sim >= 0.6), 0.35), "address"),
        (F.when(_both("ind"), 0.1), "industry"),
        (F.when(_both("em"), 0.8), "contact_email"),
        (F.when(_both("ph"), 0.7), "phone_number"),
        (F.when(_both("rep"), 0.75), "representative"),
    ]


def _miss(strategies: list[tuple[Column, str]]) -> Column:
    miss = F.lit(1.0)
    for s, _ in strategies:
        miss = miss * (F.lit(1.0) - F.coalesce(s, F.lit(0.0)))
    return miss


def _most() -> Column:
    """A bound of the score from above: a ratio is at most twice the shorter length by the sum of both."""

    def bound(c: str) -> Column:
        a, b = F.length(f"a_{c}"), F.length(f"b_{c}")
        return F.when(_differ(c), F.lit(2.0) * F.least(a, b) / (a + b) + 1e-9)

    return F.lit(1.0) - _miss(_strategies(bound("nn"), bound("na")))


def score(p: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Pairs with score (noisy-OR of the strategies), reasons and id_conflict; below the link score they drop.

    The sequence-matcher UDF sees only pairs that it could lift to the link score: names or addresses are present,
    differ, and are of lengths that allow the least ratio that counts.
    """
    if fuzzy:
        sim = lambda c: F.when(_differ(c), T.similarity(F.col(f"a_{c}"), F.col(f"b_{c}")))
        p = p.where(_most() >= LINK_AT - 1e-9)
        p = p.withColumn("name_sim", sim("nn")).withColumn("addr_sim", sim("na"))
    else:
        p = p.withColumn("name_sim", F.lit(None).cast("double")).withColumn("addr_sim", F.lit(None).cast("double"))
    strategies = _strategies(F.col("name_sim"), F.col("addr_sim"))
    miss = _miss(strategies)
    reasons = F.array_compact(F.array(*[F.when(s.isNotNull(), F.lit(r)) for s, r in strategies]))
    p = p.withColumn("raw", F.lit(1.0) - miss).withColumn("reasons", reasons).where(F.col("raw") >= LINK_AT)
    clash = (F.col("a_tax") != "") & (F.col("b_tax") != "") & (F.col("a_tax") != F.col("b_tax"))
    p = p.withColumn("id_conflict", F.coalesce(clash, F.lit(False)))
    return p.withColumn("score", F.when(F.col("id_conflict"), F.least("raw", F.lit(CONFLICT_CAP))).otherwise(F.col("raw")))


def clusters(cands: DataFrame, scored: DataFrame) -> DataFrame:
    """(node_id, cluster): the least ordinal's node stands for its cluster; nodes without a pair are left out.

    One union-find per block, over that block's surviving pairs.
    """
    edges = scored.select(F.col("a_block").alias("block"), F.col("a_node_id").alias("a"), F.col("b_node_id").alias("b"), F.col("a_ord").alias("ao"), F.col("b_ord").alias("bo"))

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        order = {**dict(zip(g["a"], g["ao"])), **dict(zip(g["b"], g["bo"]))}
        up = {n: n for n in order}

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in zip(g["a"], g["b"]):
            ra, rb = root(a), root(b)
            if ra != rb:
                lo, hi = sorted((ra, rb), key=lambda n: (order[n], n))
                up[hi] = lo
        return pd.DataFrame({"node_id": list(order), "cluster": [root(n) for n in order]})

    return edges.groupBy("block").applyInPandas(solve, "node_id string, cluster string")


def linked(cands: DataFrame, fuzzy: bool = True, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs that link, clusters), both stored: what is made of them reads them several times, and pairs are many."""
    scratch = scratch or Scratch(cands.sparkSession)
    s = score(pairs(cands), fuzzy).select("a_block", "a_node_id", "b_node_id", "a_ord", "b_ord", "score", "id_conflict", "reasons")
    s = scratch.save(s, "links")
    return s, scratch.save(clusters(cands, s), "members")


def name_clusters(cands: DataFrame) -> DataFrame:
    """Clusters of equal normalised names, by key equality alone: (node_id, cluster, size)."""
    best = cands.where("nn <> ''").groupBy("block", "nn").agg(F.min(F.struct("ord", "node_id")).alias("_b"), F.count("*").alias("size"))
    best = best.where("size > 1").select("block", "nn", F.col("_b.node_id").alias("cluster"), "size")
    return cands.join(best, ["block", "nn"]).select("node_id", "cluster", "size")


def decide(cands: DataFrame, members: DataFrame, scored: DataFrame) -> DataFrame:
    """(cluster, size, types, top_score, id_conflict, reasons, decision): merge, auto_link or review.

    Reasons are those of the cluster's pairs, each once, in the order of the pairs' first ordinals.
    """
    m = members.join(cands.select("node_id", "node_type"), "node_id")
    shape = m.groupBy("cluster").agg(F.count("*").alias("size"), F.count_distinct("node_type").alias("types"))
    s = scored.join(members.select(F.col("node_id").alias("a_node_id"), "cluster"), "a_node_id")
    why = s.select("cluster", "score", "id_conflict", F.struct("a_ord", "b_ord").alias("o"), F.posexplode_outer("reasons").alias("pos", "reason"))
    why = why.groupBy("cluster", "reason").agg(F.max("score").alias("score"), F.max("id_conflict").alias("id_conflict"), F.min(F.struct("o", "pos")).alias("o"))
    listed = F.array_compact(F.transform(F.sort_array(F.collect_list(F.struct("o", "reason"))), lambda x: x["reason"]))
    s = why.groupBy("cluster").agg(F.max("score").alias("top_score"), F.max("id_conflict").alias("id_conflict"), listed.alias("reasons"))
    merge = (F.col("top_score") >= MERGE_AT) & (F.col("types") == 1) & ~F.col("id_conflict")
    link = (F.col("top_score") >= CROSS_LINK_AT) & (F.col("types") > 1) & ~F.col("id_conflict")
    return shape.join(s, "cluster").withColumn("decision", F.when(merge, "merge").when(link, "auto_link").otherwise("review"))


def same_as(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Both directions of every pair of a linked or flagged cluster's members, with the cluster's score (three places) and reasons.

    Clusters are spread over all shuffle partitions, since few members make many edges; a broadcast of the members
    would leave the edges to as many tasks as wrote them.
    """
    d = decisions.where(F.col("decision") != "merge")
    d = d.select("cluster", F.round("top_score", 3).alias("score"), "reasons", F.when(F.col("decision") == "auto_link", "auto_linked").otherwise("needs_review").alias("status"))
    m = members.join(d, "cluster").repartition(shuffle_partitions(members.sparkSession), "cluster")
    a, b = m.select("cluster", "status", "score", "reasons", F.col("node_id").alias("src")), m.select("cluster", F.col("node_id").alias("dst"))
    return a.join(b.hint("merge"), "cluster").where("src <> dst").select("src", "dst", F.lit("same_as").alias("rel_type"), "status", "score", "reasons")


def review_conflicts(decisions: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, conflict_type, members, score, reasons, status) of the clusters that somebody has to look at."""
    m = members.groupBy("cluster").agg(F.sort_array(F.collect_set("node_id")).alias("members"))
    d = decisions.where("decision = 'review'").join(m, "cluster")
    return d.select("cluster", F.lit("entity_match_review").alias("conflict_type"), "members", F.round("top_score", 3).alias("score"), "reasons", F.lit("pending_review").alias("status"))


def run_stats(cands: DataFrame, scored: DataFrame, decisions: DataFrame) -> DataFrame:
    """(metric, n): what one run of a rule did."""
    one = lambda df, name, v: df.agg(F.coalesce(v, F.lit(0)).cast("long").alias("n")).select(F.lit(name).alias("metric"), "n")
    sizes = block_sizes(cands)
    of = lambda d: decisions.where(F.col("decision") == d)
    linked = F.col("size") * (F.col("size") - 1)
    return reduce(DataFrame.unionByName, [
        one(cands, "candidates", F.count("*")), one(sizes, "blocks", F.count("*")), one(sizes, "pairs_compared", F.sum("pairs")), one(scored, "pairs_linked", F.count("*")),
        one(decisions, "clusters", F.count("*")), one(of("merge"), "merged_clusters", F.count("*")), one(of("merge"), "nodes_removed", F.sum(F.col("size") - 1)),
        one(of("auto_link"), "auto_linked_clusters", F.count("*")), one(of("review"), "review_clusters", F.count("*")), one(decisions.where("decision <> 'merge'"), "same_as_edges", F.sum(linked)),
    ])


def _inside(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The edges with `_in`: a same_as between two members of one cluster (node_id, cluster). Edges are looked up, no pairs are made."""
    one = members.groupBy("node_id").agg(F.collect_set("cluster").alias("_c"))
    a, b = one.select(F.col("node_id").alias("src"), F.col("_c").alias("_a")), one.select(F.col("node_id").alias("dst"), F.col("_c").alias("_b"))
    j = edges.join(a, "src", "left").join(b, "dst", "left")
    return j.withColumn("_in", F.coalesce((F.col("rel_type") == "same_as") & (F.col("src") != F.col("dst")) & F.arrays_overlap("_a", "_b"), F.lit(False)))


def remove_same_as(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The edges without same_as between members of one of the clusters (node_id, cluster)."""
    return _inside(edges, members).where(~F.col("_in")).select(*edges.columns)


def upgrade_same_as(edges: DataFrame, members: DataFrame, status: str = "auto_linked") -> DataFrame:
    """The edges with same_as between members of one of the clusters set to a status."""
    return _inside(edges, members).withColumn("status", F.when(F.col("_in"), F.lit(status)).otherwise(F.col("status"))).select(*edges.columns)


def canonical_of(first_seen: DataFrame, members: DataFrame) -> DataFrame:
    """(node_id, canonical) of merged clusters: the earliest ingested, then the least id; first_seen is (node_id, at)."""
    m = members.join(first_seen, "node_id", "left")
    best = m.groupBy("cluster").agg(F.min(F.struct(F.coalesce("at", F.lit("~")), "node_id")).alias("_b"))
    return members.join(best, "cluster").select("node_id", F.col("_b.node_id").alias("canonical"))


def rewire(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges with both ends moved to the canonical nodes (node_id, canonical); those inside a cluster go.

    A moved edge is written after the canonical node's own, so it wins where both exist.
    """
    a = aliases.select(F.col("node_id").alias("src"), F.col("canonical").alias("_s"))
    b = aliases.select(F.col("node_id").alias("dst"), F.col("canonical").alias("_d"))
    e = edges.join(a, "src", "left").join(b, "dst", "left")
    s, d = F.coalesce("_s", "src"), F.coalesce("_d", "dst")
    moved = F.when((s != F.col("src")) | (d != F.col("dst")), 1).otherwise(0)
    e = e.select(s.alias("src"), d.alias("dst"), "rel_type", "ord", moved.alias("_m")).where("src <> dst")
    # the greatest (_m, ord) as numbers, which are hashed instead of sorted
    e = e.repartition(shuffle_partitions(e.sparkSession), "src", "dst", "rel_type").groupBy("src", "dst", "rel_type")
    best = e.agg(F.max("_m").alias("_m"), *[F.max(F.when(F.col("_m") == i, F.col("ord"))).alias(f"_o{i}") for i in (0, 1)])
    return best.select("src", "dst", "rel_type", F.when(F.col("_m") == 1, F.col("_o1")).otherwise(F.col("_o0")).alias("ord"))


def merge_properties(facts: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts after merging, conflicts): the canonical node's value wins, disagreements go to review."""
    f = facts.join(aliases, "node_id", "left").withColumn("owner", F.coalesce("canonical", "node_id"))
    f = f.withColumn("_own", F.when(F.col("owner") == F.col("node_id"), 0).otherwise(1))
    best = f.groupBy("owner", "key").agg(F.min(F.struct("_own", "node_id", "value")).alias("_b"))
    merged = best.select(F.col("owner").alias("node_id"), "key", F.col("_b.value").alias("value"))
    lost = f.where("_own = 1").join(best.select("owner", "key", F.col("_b.value").alias("kept"), F.col("_b.node_id").alias("_from")), ["owner", "key"])
    lost = lost.where("value <> kept").select(F.col("owner").alias("node_id"), "key", F.col("kept").alias("existing_value"), F.col("value").alias("merged_value"), F.col("node_id").alias("merged_from"))
    return merged, lost.withColumn("conflict_type", F.lit("field_after_merge")).withColumn("status", F.lit("pending_review"))


def drop_aliases(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    return nodes.join(aliases.where("node_id <> canonical").select("node_id"), "node_id", "left_anti")


@dataclass(frozen=True)
class Merge:
    """Who merges, which decides how the traces are marked."""

    source_system: str = "resolver"
    conflict_type: str = "field_after_merge"


def merge_graph(nodes: DataFrame, edges: DataFrame, facts: DataFrame, provenance: DataFrame, aliases: DataFrame, how: Merge = Merge()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, facts, provenance, conflicts) after folding aliases (node_id, canonical) into their canonical nodes.

    The canonical node's values win and disagreements become conflicts; it takes over its aliases' provenance, and
    one more record names what was merged in. Edges move to it, those inside a cluster go, aliases are deleted.
    """
    moved = aliases.where("node_id <> canonical")
    merged, clash = merge_properties(facts.select("node_id", "key", "value"), aliases)
    p = provenance.join(moved, "node_id", "left").withColumn("node_id", F.coalesce("canonical", "node_id")).drop("canonical")
    note = moved.groupBy(F.col("canonical").alias("node_id")).agg(F.concat(F.lit("merged_in:"), F.array_join(F.sort_array(F.collect_set("node_id")), ",")).alias("file"))
    p = p.unionByName(note.select("node_id", F.lit(how.source_system).alias("source_system"), "file"), allowMissingColumns=True)
    return drop_aliases(nodes, aliases), rewire(edges, aliases), merged, p, clash.withColumn("conflict_type", F.lit(how.conflict_type)).withColumn("source_system", F.lit(how.source_system))
