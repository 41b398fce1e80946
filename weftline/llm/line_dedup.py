"""Line dedup (1): cross-site boilerplate by distinct-site spread.

Lines are keyed by hash. A HyperLogLog sketch of the sites (column `source`) that show a line is merged
by aggregation, so a line that a third of all rows carry costs one sketch per map task. Lines whose
estimate is near the threshold get an exact distinct count; the others are decided by the sketch. A line
seen on at least `min_sites` sites is boilerplate and leaves every document, whatever its length and its
share of the document.

Candidates (lines whose estimate reaches the margin) are written once. Up to `broadcast_keys` of them,
counted first, lines are held against them in place: neither texts nor occurrences of lines are shuffled.
Beyond that both steps join by line, occurrences reduced to one row for each (line, site) or (line,
document) before the shuffle. Both ways give the same rows.

Defined results: null text counts as empty text; a null source is a site of its own; lines without a
word are never boilerplate; a document may end up with empty text but never disappears; rows that repeat
an id are judged each by their own lines; an empty table gives no rows; other columns pass through,
whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weftline.llm.common import release
from weftline.runtime import Scratch, ship_package, table

MIN_SITES, LG_K = 8, 10
#: 12 bytes each; 12 MB at most are sent to a task.
BROADCAST_KEYS = 1_000_000
#: Documents that Python splits into lines at a time.
ROWS = 1000
_WORD = "[^ \\t\\n\\x0B\\f\\r]"
#: Spark's seed for xxhash64, so that Python finds the same keys.
_SEED = 42


def _packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct r beside what is needed, so that no column's name can clash."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col("doc_id").alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"), F.coalesce(F.col("source").cast("string"), F.lit("\0null")).alias("site"),
    )


def _lines(d: DataFrame, *keep: str) -> DataFrame:
    """The keys of all lines with a word."""
    d = d.select(*keep, F.explode(F.split("t", "\n", -1)).alias("line"))
    d = d.where(F.col("line").rlike(_WORD))
    return d.select(*keep, F.xxhash64("line").alias("h1"), F.crc32(F.encode("line", "UTF-8")).alias("h2"))


def _boilerplate(d: DataFrame, min_sites: int, lg_k: int, broadcast_keys: int, scratch: Scratch) -> DataFrame:
    lines = _lines(d.select("t", "site"), "site")
    est = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("est"))
    margin = 1 + math.ceil(4 * 1.04 / math.sqrt(2**lg_k) * min_sites)
    cand = scratch.save(est.where((F.col("n") >= min_sites) & (F.col("est") >= min_sites - margin)).select("h1", "h2", "est"), "candidates")
    near = cand.where(F.col("est") <= min_sites + margin).select("h1", "h2")
    if near.count() <= broadcast_keys:
        pairs = lines.join(F.broadcast(near), ["h1", "h2"], "left_semi").distinct()
    else:
        pairs = lines.distinct().join(near, ["h1", "h2"], "left_semi")
    exact = pairs.groupBy("h1", "h2").count().where(F.col("count") >= min_sites).select("h1", "h2")
    return scratch.save(cand.where(F.col("est") > min_sites + margin).select("h1", "h2").unionByName(exact), "boilerplate")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, broadcast_keys: int = BROADCAST_KEYS, scratch: Scratch | None = None) -> DataFrame:
    """Keys (h1, h2) of the lines that at least min_sites sites show."""
    return _boilerplate(_packed(docs), min_sites, lg_k, broadcast_keys, scratch or Scratch(docs.sparkSession))


def _cut(h1: np.ndarray, h2: np.ndarray, at: int, counts: bool):
    """Takes the lines with the given keys (sorted by h1) out of column number `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_ = xxhash.xxh64_intdigest
        for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
            col = b.column(at).cast(pa.string())
            texts = col.cast(pa.binary()).to_pylist()
            docs = [(t or b"").split(b"\n") for t in texts]
            n = np.array([len(x) for x in docs], np.int64)
            h = np.fromiter((hash_(x, _SEED) for ls in docs for x in ls), np.uint64, int(n.sum()))
            lo = np.searchsorted(h1, h, side="left")
            hi = np.searchsorted(h1, h, side="right")
            hit = np.flatnonzero(hi > lo)
            row = np.searchsorted(np.cumsum(n), hit, side="right")
            first = np.cumsum(n) - n
            gone: dict[int, set[int]] = {}
            for i, r in zip(hit.tolist(), row.tolist()):
                k = i - int(first[r])
                if zlib.crc32(docs[r][k]) in h2[lo[i] : hi[i]]:
                    gone.setdefault(r, set()).add(k)
            for r, ks in gone.items():
                texts[r] = b"\n".join(x for k, x in enumerate(docs[r]) if k not in ks)
            cols = list(b.columns)
            if gone:
                cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            else:
                cols[at] = col
            if counts:
                cut = np.zeros(len(n), np.int64)
                for r, ks in gone.items():
                    cut[r] = len(ks)
                cols += [pa.array(n), pa.array(cut)]
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])
        release()

    return run


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, counts: bool = False, lg_k: int = LG_K, broadcast_keys: int = BROADCAST_KEYS, scratch: Scratch | None = None) -> DataFrame:
    """The documents with boilerplate lines taken out of `text`; with counts=True also _n_lines, _n_removed."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark)
    d = _packed(docs)
    keys = _boilerplate(d, min_sites, lg_k, broadcast_keys, scratch)
    more = ["_n_lines", "_n_removed"] if counts else []
    if keys.count() <= broadcast_keys:
        k = keys.orderBy("h1").toArrow()
        h1, h2 = k.column("h1").to_numpy(), k.column("h2").to_numpy()
        o = np.argsort(h1.view(np.uint64), kind="stable")
        fields = [StructField(f.name, StringType() if f.name == "text" else f.dataType, True) for f in docs.schema]
        at = docs.columns.index("text")
        same = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
        return same.mapInArrow(_cut(h1.view(np.uint64)[o], h2[o], at, counts), StructType(fields + [StructField(x, LongType()) for x in more]))
    hits = _lines(d.select("t", "id"), "id").distinct().join(keys, ["h1", "h2"], "left_semi")
    # rows that share an id get each other's keys too, and look them up by their own lines' hashes
    hits = hits.groupBy(F.col("id").alias("hid")).agg(F.collect_set(F.struct("h1", "h2")).alias("found"))
    j = d.join(hits, F.col("id").eqNullSafe(F.col("hid")), "left")
    ls = F.split("t", "\n", -1)
    gone = lambda x: F.array_contains("found", F.struct(F.xxhash64(x).alias("h1"), F.crc32(F.encode(x, "UTF-8")).alias("h2")))
    j = j.withColumn("kept", F.when(F.col("found").isNotNull(), F.filter(ls, lambda x: ~gone(x))))
    j = j.withColumn("act", F.coalesce(F.size("kept") < F.size(ls), F.lit(False)) & F.col("kept").isNotNull())
    out = [F.when(F.col("act"), F.array_join("kept", "\n")).otherwise(F.col("r.text").cast("string")).alias(c) if c == "text" else F.col(f"r.`{c}`").alias(c) for c in docs.columns]
    if counts:
        out += [F.size(ls).cast("long").alias("_n_lines"), F.when(F.col("act"), F.size(ls) - F.size("kept")).otherwise(0).cast("long").alias("_n_removed")]
    return j.select(*out)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), counts=True)
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.coalesce("text", F.lit("")).alias("text"))


OP1_SQL = f"""
WITH l AS (
  SELECT doc_id, site, line, pos, regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') AS ok
  FROM (SELECT doc_id, coalesce(source, '<null>') AS site,
               unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), b AS (SELECT line FROM l WHERE ok GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
m AS (SELECT l.*, b.line IS NOT NULL AND l.ok AS hit FROM l LEFT JOIN b ON l.line = b.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hit) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '') AS text
FROM m GROUP BY doc_id
"""
