"""Keyed, ordered upserts with conflict detection, source authority and a change log.

Every incoming value is compared with the property's value at that moment. A differing value is a
conflict, settled by: no provenance, pending; same source as the existing one, the new value; the node
type's canonical source; an authority gap of 20; else pending, and the old value stays.

The existing provenance is the node's first, unless an edit by hand has named the field before. So
whether a record wins depends on that record and on the node's first source alone, never on the values
in between, and the ordered fold becomes running window aggregates: they sort and spill, and no node's
history has to fit into an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.dims import AUTHORITY, AUTHORITY_GAP, CANONICAL, lookup
from weftline.runtime import shuffle_partitions

HUMAN = "Human"


def verdict(existing: Column, new: Column, node_type: Column) -> Column:
    """struct(status, winner) of a conflict between two sources."""
    canon, a, b = lookup(CANONICAL, node_type), lookup(AUTHORITY, existing, 0), lookup(AUTHORITY, new, 0)
    case = lambda status, winner: F.struct(F.lit(status).alias("status"), F.lit(winner).alias("winner"))
    return (
        F.when(existing.isNull() | new.isNull(), case("pending_review", None))
        .when((existing == new) & (existing != ""), case("auto_resolved", "new"))
        .when(existing == canon, case("auto_resolved", "existing"))
        .when(new == canon, case("auto_resolved", "new"))
        .when(F.abs(a - b) >= AUTHORITY_GAP, F.when(a > b, case("auto_resolved", "existing")).otherwise(case("auto_resolved", "new")))
        .otherwise(case("pending_review", None))
    )


def fold(feed: DataFrame) -> DataFrame:
    """The feed (node_id, node_type, key, value, source_system, ord, human) with, for each record, what it met and did.

    A record may carry `edited`: its property was set by hand before. Adds first_source (of the node), existing_source, current (value before), is_first (for its key),
    node_is_new, outcome (created, added, unchanged, updated, kept, pending), status and winner.
    """
    # one shuffle by node for all windows, over all partitions: columns of few values pack so well that their bytes would make a few huge tasks
    f = feed.where("node_id is not null").repartition(shuffle_partitions(feed.sparkSession), "node_id")
    n = Window.partitionBy("node_id").orderBy("ord", "source_system").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("first_source", F.first("source_system").over(n)).withColumn("_first_ord", F.first("ord").over(n))
    w = Window.partitionBy("node_id", "key").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("is_first", F.row_number().over(w) == 1).withColumn("node_is_new", F.col("ord") == F.col("_first_ord"))
    by_hand = F.col("human") | F.col("edited") if "edited" in feed.columns else F.col("human")
    edited = F.max(F.when(by_hand, 1).otherwise(0)).over(before) == 1
    f = f.withColumn("existing_source", F.when(edited, F.lit(HUMAN)).otherwise(F.col("first_source")))
    src = F.when(F.col("human"), F.lit(HUMAN)).otherwise(F.col("source_system"))
    f = f.withColumn("_v", verdict(F.col("existing_source"), src, F.col("node_type")))
    # an edit by hand always applies
    wins = F.col("human") | F.coalesce(F.col("_v.winner") == "new", F.lit(False))
    f = f.withColumn("_set", F.when(F.col("is_first") | wins, F.col("value")))
    f = f.withColumn("current", F.last("_set", ignorenulls=True).over(before))
    differs = F.col("current") != F.col("value")
    outcome = (
        F.when(F.col("node_is_new"), "created").when(F.col("is_first"), "added").when(~differs, "unchanged").when(wins, "updated").when(F.col("_v.winner") == "existing", "kept").otherwise("pending")
    )
    clash = F.col("is_first") | ~differs
    f = f.withColumn("outcome", outcome).withColumn("status", F.when(~clash, F.when(F.col("human"), "manually_resolved").otherwise(F.col("_v.status"))))
    f = f.withColumn("winner", F.when(~clash, F.when(F.col("human"), "new").otherwise(F.col("_v.winner"))))
    return f.withColumn("applied", F.col("_set")).drop("_v", "_set", "_first_ord")


def state(folded: DataFrame) -> DataFrame:
    """(node_id, key, value): the properties after the whole feed."""
    best = folded.where(F.col("applied").isNotNull()).groupBy("node_id", "key").agg(F.max(F.struct("ord", "applied")).alias("_b"))
    return best.select("node_id", "key", F.col("_b.applied").alias("value"))


def facts(folded: DataFrame) -> DataFrame:
    """(node_id, key, value, ord, source_system) after the whole feed, each with the record that set it."""
    src = F.when(F.col("human"), F.lit(HUMAN)).otherwise(F.col("source_system"))
    best = folded.where(F.col("applied").isNotNull()).groupBy("node_id", "key").agg(F.max(F.struct("ord", "applied", src.alias("source"))).alias("_b"))
    return best.select("node_id", "key", F.col("_b.applied").alias("value"), F.col("_b.ord").alias("ord"), F.col("_b.source").alias("source_system"))


def change_log(folded: DataFrame) -> DataFrame:
    """Additions to nodes that were there before, and updates."""
    kept = folded.where(F.col("outcome").isin("added", "updated"))
    return kept.select("node_id", "key", F.col("outcome").alias("kind"), F.col("current").alias("old_value"), F.col("value").alias("new_value"), F.col("source_system"), "ord")


def conflicts(folded: DataFrame) -> DataFrame:
    kept = folded.where(F.col("status").isNotNull())
    return kept.select("node_id", "key", F.col("current").alias("existing_value"), F.col("value").alias("new_value"), "existing_source", F.when(F.col("human"), F.lit(HUMAN)).otherwise(F.col("source_system")).alias("new_source"), "status", "winner", "ord")


def resolve_manually(conflicts: DataFrame, choices: DataFrame) -> DataFrame:
    """Pending conflicts with a choice (node_id, key, ord, winner in existing/new) become manually resolved."""
    c = choices.where(F.col("winner").isin("existing", "new")).withColumnRenamed("winner", "_w")
    j = conflicts.join(c, ["node_id", "key", "ord"], "left")
    hit = (F.col("status") == "pending_review") & F.col("_w").isNotNull()
    return j.select(*[c for c in conflicts.columns if c not in ("status", "winner")], F.when(hit, "manually_resolved").otherwise(F.col("status")).alias("status"), F.when(hit, F.col("_w")).otherwise(F.col("winner")).alias("winner"))


def list_conflicts(conflicts: DataFrame, status: str | None = None) -> DataFrame:
    """All conflicts, or those of one status."""
    return conflicts.where(F.col("status") == status) if status else conflicts


def apply_resolutions(state: DataFrame, resolved: DataFrame) -> DataFrame:
    """The properties with the values that manual resolutions chose; of several for one property the last counts."""
    won = resolved.where((F.col("status") == "manually_resolved") & (F.col("winner") == "new"))
    won = won.groupBy("node_id", "key").agg(F.max(F.struct("ord", "new_value")).alias("_b")).select("node_id", "key", F.col("_b.new_value").alias("_v"))
    return state.join(won, ["node_id", "key"], "left").withColumn("value", F.coalesce("_v", "value")).drop("_v")


def make_provenance(source: Column, file: Column | None = None, record_id: Column | None = None, field: Column | None = None, confidence: Column | None = None, at: Column | None = None) -> Column:
    """A provenance record; empty texts count as absent, confidence as 1."""
    text = lambda c: F.nullif(c.cast("string"), F.lit("")) if c is not None else F.lit(None).cast("string")
    return F.struct(
        source.cast("string").alias("source_system"), text(file).alias("file"), text(record_id).alias("record_id"), text(field).alias("field"),
        F.coalesce(confidence, F.lit(1.0)).cast("double").alias("confidence") if confidence is not None else F.lit(1.0).alias("confidence"), text(at).alias("ingested_at"),
    )


def merge_into(base: DataFrame, folded: DataFrame) -> DataFrame:
    """A state table brought up to date: full outer join, the feed's result over the base's."""
    new = state(folded).withColumnRenamed("value", "_new")
    return base.join(new, ["node_id", "key"], "full_outer").select("node_id", "key", F.coalesce("_new", "value").alias("value"))


def provenance_of(provenance: Column, field: str) -> Column:
    """The first provenance that names the field, else the first, else null."""
    return F.coalesce(F.try_element_at(F.filter(provenance, lambda p: p["field"] == field), F.lit(1)), F.try_element_at(provenance, F.lit(1)))
