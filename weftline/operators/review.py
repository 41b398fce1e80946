"""What a reviewer sees: severity, verdicts, differences of two values, and the order of the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T


def match_severity(score: Column) -> Column:
    return F.when(score < 0.6, "HIGH").when(score < 0.8, "MED").otherwise("LOW")


def name_severity(n: Column) -> Column:
    return F.when(n >= 50, "HIGH").when(n >= 10, "MED").otherwise("LOW")


def name_confidence(variants: Column) -> Column:
    return F.greatest(F.lit(0.3), 1.0 - 0.15 * variants)


def verdict(conflict_type: Column, status: Column, winner: Column) -> Column:
    return (
        F.when(status == "pending_review", "needs review")
        .when(conflict_type == "human_edit", "edited by hand")
        .when(winner == "new", "new value accepted")
        .when(winner == "existing", "existing value kept")
        .otherwise("resolved")
    )


def queue(conflicts: DataFrame) -> DataFrame:
    """Adds severity, confidence, verdict and place; conflicts that are neither of a known type nor about a field drop.

    conflicts: conflict_ix, conflict_type, score, n_mismatched, n_variants, key, status, winner.
    """
    c = conflicts.where(F.col("conflict_type").isin("entity_match_review", "employee_name_inconsistency", "human_edit") | F.col("key").isNotNull())
    match, names = F.col("conflict_type") == "entity_match_review", F.col("conflict_type") == "employee_name_inconsistency"
    c = c.withColumn("severity", F.when(match, match_severity(F.col("score"))).when(names, name_severity(F.col("n_mismatched"))).otherwise(F.when(F.col("status") == "pending_review", "MED").otherwise("LOW")))
    c = c.withColumn("confidence", F.when(match, F.col("score")).when(names, name_confidence(F.col("n_variants"))).otherwise(F.lit(0.5)))
    c = c.withColumn("verdict", verdict(F.col("conflict_type"), F.col("status"), F.col("winner")))
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MED", 1).otherwise(2)
    return c.withColumn("rank", rank).orderBy("rank", F.desc("confidence"), "conflict_ix")


def string_diff(a: Column, b: Column) -> Column:
    """identical, suffix, alias variation (half of the words shared) or different value."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    wx, wy = F.array_distinct(F.split(x, "\\s+")), F.array_distinct(F.split(y, "\\s+"))
    share = F.size(F.array_intersect(wx, wy)) / F.greatest(F.size(wx), F.size(wy), F.lit(1))
    return F.when(x == y, "identical").when(F.startswith(x, y) | F.startswith(y, x), "suffix").when(share >= 0.5, "alias variation").otherwise("different value")


def field_diff(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds diff_kind, delta and warn: amounts of one currency, ISO dates, else texts."""
    ca, na = T.amount(F.col(a))
    cb, nb = T.amount(F.col(b))
    da, db = F.to_date(F.regexp_extract(a, "^(\\d{4}-\\d{2}-\\d{2})", 1).try_cast("date")), F.to_date(F.regexp_extract(b, "^(\\d{4}-\\d{2}-\\d{2})", 1).try_cast("date"))
    money, dates = ca.isNotNull() & (ca == cb) & na.isNotNull() & nb.isNotNull(), da.isNotNull() & db.isNotNull()
    df = df.withColumn("diff_kind", F.when(money, "amount").when(dates, "date").otherwise(string_diff(F.col(a), F.col(b))))
    df = df.withColumn("delta", F.when(money, nb - na).when(dates, F.datediff(db, da).cast("double")))
    return df.withColumn("warn", F.when(money, F.abs(nb - na) > 0.10 * F.abs(na)).when(dates, F.abs(F.datediff(db, da)) > 7).otherwise(F.col("diff_kind") == "different value"))
