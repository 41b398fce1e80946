"""Incremental re-ingest: a file stream of upserts, merged into versioned state tables.

Each micro-batch is folded onto the properties so far: the base's values come first as one record per
property, with a mark where it was set by hand, so the same window logic settles conflicts and the result is
that of one batch over all files, as long as files arrive in the order of their records. A batch writes a new version of the tables and
then its number, so a batch that is run again after a failure starts from the same base and gives the
same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import schema
from weftline.operators import upsert
from weftline.runtime import Scratch


def _version(spark: SparkSession, root: str, n: int) -> DataFrame | None:
    return spark.read.parquet(f"{root}/state/v={n}") if n >= 0 else None


def fold_batch(base: DataFrame | None, batch: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, change log, conflicts) after a batch; state: node_id, node_type, key, value, source_system, edited.

    With a scratch folder the fold is stored there, since five tables are made of it.
    """
    feed = batch.select("node_id", "node_type", "key", "value", "source_system", "ord", "human", F.lit(False).alias("edited"))
    if base is not None:
        feed = feed.unionByName(base.select("node_id", "node_type", "key", "value", "source_system", F.lit(-1).cast("long").alias("ord"), F.lit(False).alias("human"), "edited"))
    f = upsert.fold(feed)
    f = scratch.save(f, "folded") if scratch else f
    old = F.col("ord") >= 0
    kinds = f.groupBy("node_id").agg(F.first("node_type").alias("node_type"), F.first("first_source").alias("source_system"))
    marks = f.groupBy("node_id", "key").agg(F.max(F.col("human") | F.col("edited")).alias("edited"))
    state = upsert.state(f).join(kinds, "node_id").join(marks, ["node_id", "key"]).select("node_id", "node_type", "key", "value", "source_system", "edited")
    return state, upsert.change_log(f).where(old), upsert.conflicts(f).where(old)


def start(spark: SparkSession, landing: str, root: str, available_now: bool = True, files_per_batch: int | None = None):
    """A query that merges what arrives in `landing` (Parquet of the feed's columns) below `root`."""
    src = spark.readStream.schema(schema.FEED)
    src = (src.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else src).parquet(landing)

    def merge(batch: DataFrame, n: int) -> None:
        s = batch.sparkSession
        scratch = Scratch(s)
        state, changes, conflicts = fold_batch(_version(s, root, n - 1), batch, scratch)
        changes.write.mode("overwrite").parquet(f"{root}/changes/v={n}")
        conflicts.write.mode("overwrite").parquet(f"{root}/conflicts/v={n}")
        state.write.mode("overwrite").parquet(f"{root}/state/v={n}")
        scratch.close()

    w = src.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/checkpoint")
    return (w.trigger(availableNow=True) if available_now else w).start()
