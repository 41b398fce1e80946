"""Profiling of unknown tables: types, keys, foreign keys and links between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

_NUMERIC = {"tinyint", "smallint", "int", "bigint"}


def cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(field, value, kind): every cell as text, unpivoted in one scan."""
    kinds = dict(df.dtypes)
    fields = columns or df.columns

    def kind(c: str):
        v = F.col(c).cast("string")
        t = kinds[c]
        if t in _NUMERIC:
            return F.when(v.isNull(), "null").otherwise("integer")
        if t in ("double", "float") or t.startswith("decimal"):
            return F.when(v.isNull(), "null").otherwise("float")
        if t == "boolean":
            return F.when(v.isNull(), "null").otherwise("boolean")
        if t.startswith("array"):
            return F.when(v.isNull(), "null").otherwise("list")
        if t.startswith(("map", "struct")):
            return F.when(v.isNull(), "null").otherwise("dict")
        return T.classify(v)

    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), kind(c).alias("kind")) for c in fields])).alias("c")).select("c.*")


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(field, dominant, n_non_null, n_distinct, null_rate, uniqueness); rates have three places.

    One shuffle: values are counted per (field, kind, value) first, which also feeds the distinct count.
    """
    c = cells(df, columns)
    per = c.groupBy("field", "kind", "value").agg(F.count("*").alias("n"))
    live = (F.col("kind") != "null").cast("long")
    by_kind = per.groupBy("field", "kind").agg(F.sum("n").alias("n"), F.sum(live).alias("d"))
    non = F.sum(F.when(F.col("kind") != "null", F.col("n")).otherwise(0))
    best = F.max(F.when(F.col("kind") != "null", F.struct("n", "kind")))
    p = by_kind.groupBy("field").agg(F.coalesce(best["kind"], F.lit("null")).alias("dominant"), non.alias("n_non_null"), F.sum("d").alias("n_distinct"), F.sum("n").alias("n_rows"))
    rate = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 3)
    return p.select("field", "dominant", "n_non_null", "n_distinct", rate(F.col("n_rows") - F.col("n_non_null"), F.col("n_rows")).alias("null_rate"), rate(F.col("n_distinct"), F.col("n_non_null")).alias("uniqueness"))


def keys(p: DataFrame) -> DataFrame:
    """The profile with is_key and is_foreign."""
    name_id = F.col("field").rlike("(?i)(?:^|_)(?:uuid|key|id)$")
    typed = F.col("dominant").isin("uuid", "prefixed_id", "short_code", "integer")
    unique = (F.col("uniqueness") >= 0.99) & (F.col("n_non_null") > 1)
    name_fk = F.col("field").rlike("(?i)_id$|_uuid$|_key$")
    repeats = (F.col("uniqueness") < 0.95) & (F.col("n_non_null") > 1)
    foreign = name_fk & (F.col("dominant").isin("uuid", "prefixed_id", "short_code") | repeats)
    return p.withColumn("is_key", (name_id | typed) & unique).withColumn("is_foreign", foreign)


def containment(child: DataFrame, child_field: str, parent: DataFrame, parent_field: str) -> DataFrame:
    """(n_values, n_contained, coverage): how many of the child's distinct values the parent has."""
    c = child.select(F.col(child_field).cast("string").alias("v")).where("v is not null").distinct()
    p = parent.select(F.col(parent_field).cast("string").alias("v"), F.lit(1).alias("hit")).where("v is not null").distinct()
    j = c.join(p, "v", "left").agg(F.count("*").alias("n_values"), F.count("hit").alias("n_contained"))
    return j.withColumn("coverage", F.round(F.col("n_contained") / F.greatest("n_values", F.lit(1)), 3))


def cross_links(tables: dict[str, DataFrame], pairs: list[tuple[str, str, str, str]], least: float = 0.8) -> DataFrame:
    """Links between tables by value containment, best first; pairs: (child, field, parent, field)."""
    out = None
    for a, x, b, y in pairs:
        r = containment(tables[a], x, tables[b], y).withColumn("link", F.lit(f"{a}.{x} -> {b}.{y}"))
        out = r if out is None else out.unionByName(r)
    return out.where(F.col("coverage") >= least).select("link", "n_values", "n_contained", "coverage").orderBy(F.desc("coverage"), "link")


def type_distribution(df: DataFrame, most: int = 4) -> DataFrame:
    """(field, kind, n, rn): each field's most frequent kinds."""
    c = cells(df).where("kind <> 'null'").groupBy("field", "kind").agg(F.count("*").alias("n"))
    return c.withColumn("rn", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "kind"))).where(F.col("rn") <= most)
