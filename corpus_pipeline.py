"""The corpus pipeline: stages over `documents`, each on all that the one before kept.

Every stage takes and returns the columns of `documents` (the last one pieces), whatever further columns there
are and what they are called. Null text counts as empty and is rejected by the first stage, like every text of
fewer than ten words; null languages and sources are values of their own; rows that repeat an id are judged
each, and of equal texts under one id one row stays; an empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from weftline.runtime import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go, null and empty texts among them; a folder without labels has no learnt rule."""
    from pyspark.errors import AnalysisException

    try:
        labels = table(spark, sf_dir, "labels")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        labels = None
    return quality_rules.filter_documents(docs, labels=labels)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines of any length and share leave the texts, which may become empty; n_chars follows where it is there."""
    from pyspark.sql import functions as F

    out = line_dedup.remove_boilerplate(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, the one with the smallest id; empty texts are near to nothing."""
    return ngram_join.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; empty items and texts match nothing."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences; a text that has become empty is one id."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("decontamination", leaks), ("packing", packed)]

#: Tokenising and packing are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "_").replace(".", ""))
    return STAGES[-1][1](spark, docs, sf_dir)
