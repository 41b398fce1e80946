"""Token counts (5): an exact length histogram answers every context limit.

Each text is encoded once; documents are aggregated by encoded length, which leaves one row per distinct
length. Suffix sums over that histogram give, for any context limit, how many documents exceed it, how
many tokens remain when texts are truncated to it, and exact quantiles. Ids are those of the byte-level
BPE vocabulary `byte_bpe_50k`; special tokens' strings are ordinary text.

Defined results: null text counts as empty and has no tokens (plus `extra` ids where asked for); texts
of any length are encoded whole; an empty table gives an empty histogram and a report of zeros and nulls.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import common as C
from weftline.runtime import ship_package, table

LIMITS = (128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768)
QUANTILES = (0.5, 0.9, 0.95, 0.99)


@lru_cache(4)
def encoding(name: str = "byte_bpe_50k", path: str | None = None):
    """The vocabulary's ranks as a tiktoken encoding; it gives the ids of the tokenizers file of that name."""
    import public_tokenizers as P
    import tiktoken

    with open(path or P.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text: str | None, name: str = "byte_bpe_50k", path: str | None = None) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    return np.asarray(encoding(name, path)._core_bpe.encode_ordinary(text), np.uint32)


def _lengths(name: str, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, path)._core_bpe
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in C.column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_tokens"])

    return run


def length_histogram(docs: DataFrame, name: str = "byte_bpe_50k", path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many documents have exactly that many tokens."""
    ship_package(docs.sparkSession)
    n = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_lengths(name, path), "n_tokens long")
    return n.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with, for each length, the documents and tokens at that length or above.

    The global window runs in one task over the distinct lengths, which the longest document bounds, not
    the number of documents.
    """
    w = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.select("n_tokens", "n_docs", F.sum("n_docs").over(w).alias("docs_from"), F.sum(F.col("n_docs") * F.col("n_tokens")).over(w).alias("tokens_from"))


def _longer(limit: int, docs: bool) -> Column:
    return F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs") if docs else F.col("n_docs") * F.col("n_tokens"))), F.lit(0))


def context_report(hist: DataFrame, limits: tuple[int, ...] = LIMITS, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(metric, at, value): totals, quantiles (least length that the share of documents reaches), and for each limit truncated tokens and longer documents."""
    w = Window.partitionBy().orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = Window.partitionBy()
    h = hist.withColumn("upto", F.sum("n_docs").over(w)).withColumn("all", F.sum("n_docs").over(one))
    row = lambda m, at, v: F.struct(F.lit(m).alias("metric"), F.lit(float(at)).alias("at"), v.cast("long").alias("value"))
    total = F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0))
    cells = [row("documents", 0, F.coalesce(F.sum("n_docs"), F.lit(0))), row("tokens", 0, total), row("longest", 0, F.max("n_tokens"))]
    cells += [row("quantile", q, F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("n_tokens")))) for q in quantiles]
    for x in limits:
        cells.append(row("longer_docs", x, _longer(x, True)))
        cells.append(row("truncated_tokens", x, total - _longer(x, False) + _longer(x, True) * x))
    return h.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram with suffix sums: a row per distinct length answers totals and truncated totals for that limit."""
    h = with_suffix_sums(length_histogram(table(spark, sf_dir, "documents")))
    total_t, total_d = F.sum(F.col("n_docs") * F.col("n_tokens")).over(Window.partitionBy()), F.sum("n_docs").over(Window.partitionBy())
    # truncated to n_tokens: what is shorter counts whole, the rest counts n_tokens each
    return h.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from",
        (total_t - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("truncated_tokens"),
        ((total_d - F.col("docs_from") + F.col("n_docs")) / total_d).alias("quantile"),
    )
