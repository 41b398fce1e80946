"""Quality classifier (3): interpolated modified Kneser-Ney n-grams over bytes.

The model counts every 5-byte sequence of every trusted document (quality 1, not toxic). Counts live in
shards keyed by the two bytes before the predicted one, so that a shard holds all it needs for orders 5
to 3; orders 2 and 1 have at most 65,536 entries and are broadcast. Each block of documents asks each
shard for its distinct n-grams once and gets log-probabilities back in the same order; a document's
perplexity is that of its bytes. A document is kept unless its perplexity exceeds a quantile, set for
each language, of trusted documents' perplexities under a model that hasn't read them: the trusted documents
are split by id into two folds, and each is scored by the other's model.

What is shuffled is one packed row for each block and shard, and each block's compressed text once.
Trusted ids are broadcast up to `broadcast_ids`; beyond, they are joined by shuffle. Quantiles come from a
histogram of log-perplexity in steps of 0.001, so no task collects a language. Log-probabilities travel with
32 bits, so a perplexity is exact to about one part in ten million.

Defined results: null or empty text has no perplexity and is not kept; a null language is a language of
its own; a language without trusted documents uses the quantile over all of them, and without any
trusted document everything with text is kept; repeated rows are scored alike; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common as C
from weftline.runtime import Scratch, release_shuffles, ship_package, shuffle_partitions, table

ORDER = 5
SHARDED = (3, 4, 5)
BLOCK = 4 << 20
QUANTILE, FOLDS = 0.99, 2
_MASK = {k: C.U((1 << 8 * k) - 1) for k in range(1, ORDER + 1)}


def grams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte the 5 bytes that end there, the last one lowest; zeros before a text's start."""
    g = data.astype(C.U)
    n = len(data)
    for j in range(1, ORDER):
        prev = np.zeros(n, C.U)
        prev[j:] = data[:-j] if j < n else 0
        for t in range(j):
            at = off[:-1] + t
            prev[at[at < off[1:]]] = 0
        g |= prev << C.U(8 * j)
    return g


def shard_of(g: np.ndarray, shards: int) -> np.ndarray:
    return (C.mix((g >> C.U(8)) & _MASK[2]) % C.U(shards)).astype(np.int64)


def _shard_rows(u: np.ndarray, cnt: np.ndarray | None, shards: int) -> Iterator[tuple[int, bytes, bytes]]:
    s = shard_of(u, shards)
    o = np.argsort(s, kind="stable")
    first = np.searchsorted(s[o], np.arange(shards + 1))
    for k in range(shards):
        i = o[first[k] : first[k + 1]]
        if len(i):
            yield k, C.pack40(u[i]), _packed_counts(cnt[i]) if cnt is not None else b""


def _packed_counts(c: np.ndarray) -> bytes:
    """Four bytes each, or eight where a count needs them."""
    return c.astype("<u4" if not len(c) or c.max() < 1 << 32 else "<u8").tobytes()


def _counts(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, "<u8" if n and len(b) == 8 * n else "<u4").astype(np.int64)


def _count(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off in C.slices(batches, limit=BLOCK):
            if not len(data):
                continue
            u, c = np.unique(grams(data, off), return_counts=True)
            cols = list(zip(*_shard_rows(u, c, shards)))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["shard", "grams", "counts"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed partial counts of a shard, summed; a task may hold several shards."""
    by: dict[int, list] = {}
    for b in batches:
        for s, g, c in zip(*(x.to_pylist() for x in b.columns)):
            by.setdefault(s, []).append((C.unpack40(g), _counts(c, len(g) // 5)))
    for s, parts in by.items():
        g = np.concatenate([p[0] for p in parts])
        u, inv = np.unique(g, return_inverse=True)
        c = np.zeros(len(u), np.int64)
        np.add.at(c, inv, np.concatenate([p[1] for p in parts]))
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([C.pack40(u)], pa.binary()), pa.array([_packed_counts(c)], pa.binary())], names=["shard", "grams", "counts"])


def levels(u: np.ndarray, c: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By order 5 to 3, and 2 as far as one shard knows it: distinct n-grams and their (continuation) counts."""
    out = {ORDER: (u, c)}
    for k in range(ORDER - 1, 1, -1):
        out[k] = np.unique(out[k + 1][0] & _MASK[k], return_counts=True)
    return out


def _of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (order, key, value): counts of counts of orders 3 to 5 (keys 1 to 4), and this shard's bigrams."""
    for b in batches:
        for g, c in zip(C.column(b, "grams").to_pylist(), C.column(b, "counts").to_pylist()):
            lv = levels(C.unpack40(g), _counts(c, len(g) // 5))
            order = [k for k in SHARDED for _ in range(4)] + [2] * len(lv[2][0])
            key = np.concatenate((np.tile(np.arange(1, 5), len(SHARDED)), lv[2][0].astype(np.int64)))
            value = np.concatenate([_of_counts(lv[k][1]) for k in SHARDED] + [lv[2][1]])
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int32()), pa.array(key), pa.array(value)], names=["order", "key", "value"])


def discounts(n: np.ndarray) -> np.ndarray:
    """D0 (0), D1, D2, D3+ from the counts of counts n1..n4, kept within what a count can give."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if n1 == 0 or n2 == 0:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))])


def bigrams(key: np.ndarray, cont: np.ndarray) -> np.ndarray:
    """p(b | a) of orders 2 and 1, as a 256 x 256 table."""
    c2 = np.zeros((256, 256))
    c2[key >> 8, key & 255] = cont
    c1 = (c2 > 0).sum(0)
    d1 = discounts(_of_counts(c1[c1 > 0].astype(np.int64)))
    cut = d1[np.minimum(c1, 3)]
    total = max(1, c1.sum())
    p1 = (c1 - cut) / total + (cut.sum() / total if c1.sum() else 1.0) / 256
    d2 = discounts(_of_counts(c2[c2 > 0].astype(np.int64)))
    cut = d2[np.minimum(c2, 3).astype(np.int64)]
    total = c2.sum(1, keepdims=True)
    return np.where(total > 0, (c2 - cut) / np.maximum(total, 1) + cut.sum(1, keepdims=True) / np.maximum(total, 1) * p1, p1)


def log_probabilities(model: dict[int, tuple[np.ndarray, np.ndarray]], ds: dict[int, np.ndarray], p2: np.ndarray, q: np.ndarray) -> np.ndarray:
    """ln p(last byte | four before) for n-grams q of one shard."""
    p = p2[((q >> C.U(8)) & C.U(255)).astype(np.int64), (q & C.U(255)).astype(np.int64)]
    for k in SHARDED:
        u, c = model[k]
        if not len(u):
            continue
        d = ds[k]
        ctx = u >> C.U(8)
        st = C.starts_of_groups(ctx)  # u is sorted, so its contexts are
        total = np.add.reduceat(c, st)
        cut = np.add.reduceat(d[np.minimum(c, 3)], st)
        want = q & _MASK[k]
        i = np.minimum(np.searchsorted(ctx[st], want >> C.U(8)), len(st) - 1)
        known = ctx[st][i] == want >> C.U(8)
        j = np.minimum(np.searchsorted(u, want), len(u) - 1)
        own = np.where(u[j] == want, c[j], 0)
        p = np.where(known, (own - d[np.minimum(own, 3)]) / total[i] + cut[i] / total[i] * p, p)
    return np.log(p)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    z, part = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
    for n, (rows, data, off) in enumerate(C.slices(batches, limit=BLOCK)):
        meta = pa.array([rows.select(["doc_id", "lang", "trusted"]).to_pylist()], pa.list_(pa.struct([("doc_id", pa.int64()), ("lang", pa.string()), ("trusted", pa.bool_())])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([(part << 24) | n], pa.int64()), pa.array([z.compress(data.tobytes())], pa.binary()), pa.array([np.diff(off).astype("<i8").tobytes()], pa.binary()), meta], names=["block", "packed", "lens", "meta"]
        )


def _open(packed: bytes, lens: bytes) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate(([0], np.cumsum(np.frombuffer(lens, "<i8"))))
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, int(off[-1]))), np.uint8), off


def _ask(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, packed, lens in zip(*(C.column(b, c).to_pylist() for c in ("block", "packed", "lens"))):
                data, off = _open(packed, lens)
                if not len(data):
                    continue
                u = np.sort(grams(data, off))
                u = u[C.starts_of_groups(u)]
                cols = list(zip(*_shard_rows(u, None, shards)))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([block] * len(cols[0]), pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["shard", "block", "grams", "counts"])

    return run


def _answer(ds: dict[int, np.ndarray], p2: np.ndarray):
    """For each shard and salt its counts (block null) come first, then the blocks' questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, model = None, None
        for b in batches:
            out: list[list] = [[], [], []]
            for s, salt, block, g, c in zip(*(C.column(b, x).to_pylist() for x in ("shard", "salt", "block", "grams", "counts"))):
                if (s, salt) != shard:
                    shard, model = (s, salt), levels(np.zeros(0, C.U), np.zeros(0, np.int64))
                if block is None:
                    model = levels(C.unpack40(g), _counts(c, len(g) // 5))
                    continue
                lp = log_probabilities(model, ds, p2, C.unpack40(g))
                for col, x in zip(out, (block, s, lp.astype("<f4").tobytes())):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["block", "shard", "lp"])

    return run


def _lookup(u: np.ndarray, value: np.ndarray, q: np.ndarray) -> np.ndarray:
    """value of each q, all of which are among the sorted u: a hash table, and a search for what it lost."""
    bits = max(8, int(len(u)).bit_length() + 3)
    slot = lambda x: ((x * C.U(0x9E3779B97F4A7C15)) >> C.U(64 - bits)).astype(np.int64)
    t = np.zeros(1 << bits, np.int32)
    t[slot(u)] = np.arange(len(u), dtype=np.int32)
    i = t[slot(q)]
    miss = np.flatnonzero(u[i] != q)
    i[miss] = np.searchsorted(u, q[miss])
    return value[i]


def _score(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed, lens, meta, answers in zip(*(C.column(b, c).to_pylist() for c in ("packed", "lens", "meta", "answers"))):
                data, off = _open(packed, lens)
                n = np.diff(off)
                total = np.zeros(len(n))
                if len(data):
                    g = grams(data, off)
                    u = np.sort(g)
                    u = u[C.starts_of_groups(u)]
                    lp, s = np.zeros(len(u), np.float32), shard_of(u, shards)
                    o = np.argsort(s, kind="stable")
                    first = np.searchsorted(s[o], np.arange(shards + 1))
                    for a in answers:
                        lp[o[first[a["shard"]] : first[a["shard"] + 1]]] = np.frombuffer(a["lp"], "<f4")
                    c = np.concatenate(([0], np.cumsum(_lookup(u, lp, g), dtype=np.float64)))
                    total = c[off[1:]] - c[off[:-1]]
                ppl = np.exp(-total / np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m["doc_id"] for m in meta], pa.int64()), pa.array([m["lang"] for m in meta], pa.string()), pa.array([m["trusted"] for m in meta], pa.bool_()), pa.array(n), pa.array(ppl, mask=n == 0)],
                    names=["doc_id", "lang", "trusted", "n_bytes", "perplexity"],
                )

    return run


def perplexities(docs: DataFrame, trusted: DataFrame, scratch: Scratch | None = None, broadcast_ids: int = 1_000_000, docs_per_salt: int = 500_000) -> DataFrame:
    """(doc_id, lang, trusted, n_bytes, perplexity); trusted holds the doc_id of the texts to learn from.

    A shard exists once for every docs_per_salt documents, so that the task of a frequent context answers a
    bounded number of blocks; counts are merged by shard and salt before they are merged by shard.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark)
    shards = shuffle_partitions(spark)
    ids = trusted.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct().withColumn("trusted", F.lit(True))
    if ids.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    d = d.join(ids, d["doc_id"] == ids["_id"], "left").select("doc_id", "lang", "text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    packed = "shard int, grams binary, counts binary"
    salts = 1 + d.count() // docs_per_salt
    counts = d.where("trusted").select("text").mapInArrow(_count(shards), packed)
    if salts > 1:
        part = counts.repartition(shards, "shard", F.pmod(F.spark_partition_id(), F.lit(salts)))
        counts = part.mapInArrow(_merge, packed)
    counts = scratch.save(counts.repartition(shards, "shard").mapInArrow(_merge, packed), "ngrams")

    st = counts.select("grams", "counts").mapInArrow(_statistics, "order int, key long, value long").groupBy("order", "key").agg(F.sum("value").alias("value")).collect()  # at most 65,548 rows
    ds = {k: discounts(np.array([sum(r["value"] for r in st if r["order"] == k and r["key"] == i) for i in range(1, 5)])) for k in SHARDED}
    two = [(r["key"], r["value"]) for r in st if r["order"] == 2]
    p2 = bigrams(np.array([x[0] for x in two], np.int64), np.array([x[1] for x in two], np.float64))

    blocks = d.mapInArrow(_blocks, "block long, packed binary, lens binary, meta array<struct<doc_id:long,lang:string,trusted:boolean>>").repartition(shards, "block")
    ask = blocks.select("block", "packed", "lens", "meta").mapInArrow(_ask(shards), "shard int, block long, grams binary, counts binary")
    ask = ask.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    copies = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("shard", F.lit(None).cast("long").alias("block"), "grams", "counts", F.col("salt").cast("long"))
    ask = copies.unionByName(ask).repartition(shards, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("block").asc_nulls_first())
    got = ask.mapInArrow(_answer(ds, p2), "block long, shard int, lp binary").groupBy("block").agg(F.collect_list(F.struct("shard", "lp")).alias("answers"))
    j = blocks.join(got, "block", "left").select("packed", "lens", "meta", F.coalesce("answers", F.array().cast("array<struct<shard:int,lp:binary>>")).alias("answers"))
    return j.mapInArrow(_score(shards), "doc_id long, lang string, trusted boolean, n_bytes long, perplexity double")


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, threshold) for every language, from trusted documents' log-perplexities."""
    lang = F.coalesce("lang", F.lit("\0null")).alias("lang")
    bins = scored.where("perplexity is not null").groupBy(lang, F.floor(F.log("perplexity") * 1000).alias("bin")).agg(F.sum(F.col("trusted").cast("long")).alias("n"))
    own = bins.where("n > 0")

    def cut(rows: DataFrame, *by: str) -> DataFrame:
        r = rows.groupBy(*by, "bin").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("h"), F.sum("n").alias("all"))
        need = F.ceil(F.col("all") * quantile)
        at = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("long").alias("b")), lambda a, x: F.struct((a["c"] + x["n"]).alias("c"), F.when(a["b"].isNull() & (a["c"] + x["n"] >= need), x["bin"]).otherwise(a["b"]).alias("b")))
        return r.select(*by, F.exp((at["b"] + 1) / 1000).alias("t"))

    one = cut(own.withColumn("_", F.lit(1)), "_").select(F.col("t").alias("t0"))
    langs = bins.select("lang").distinct()
    # one row against the languages
    return langs.join(cut(own, "lang"), "lang", "left").join(one.withColumn("_1", F.lit(1)), F.lit(1) == F.col("_1"), "left").select("lang", F.coalesce("t", "t0").alias("threshold"))


def held_out(docs: DataFrame, trusted: DataFrame, scratch: Scratch, folds: int = FOLDS, broadcast_ids: int = 1_000_000) -> DataFrame:
    """perplexities() of the trusted documents, each by the model of the other folds."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    small = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").join(small, "doc_id", "left_semi")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(folds))
    out = None
    for k in range(folds):
        p = scratch.save(perplexities(own, ids.where(fold != k), scratch).where(fold == k), "held_out")
        release_shuffles(docs.sparkSession)
        out = p if out is None else out.unionByName(p)
    return out


def classify(docs: DataFrame, trusted: DataFrame, scratch: Scratch | None = None, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, kept) of every document."""
    scratch = scratch or Scratch(docs.sparkSession)
    unseen = held_out(docs, trusted, scratch)
    s = scratch.save(perplexities(docs, trusted, scratch), "perplexities")
    flag = lambda d, x: d.select("lang", "perplexity", F.lit(x).alias("trusted"))
    t = thresholds(flag(s, False).unionByName(flag(unseen, True)), quantile).withColumnRenamed("lang", "_l")
    j = s.join(t, F.coalesce("lang", F.lit("\0null")) == F.col("_l"), "left")
    kept = (F.col("n_bytes") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return j.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", kept.alias("kept"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return classify(table(spark, sf_dir, "documents"), labels.where("quality = 1 and coalesce(toxic, 0) = 0"))
