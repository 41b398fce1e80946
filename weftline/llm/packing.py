"""Packing (8): shortest-pack-first over the length histogram.

A document's ids (byte BPE, then id 0) fill whole sequences of `size` tokens as far as they go; what
remains is shorter than a sequence. The remainders' length histogram has at most `size` entries, so the
driver packs it: lengths longest first, each into the pattern with the most room that still takes it,
whole counts at a time. Patterns are then joined back to the pieces by each piece's rank among those of
its length. Ranks come from counts per (length, salt); salts follow the most frequent length, so no task orders
more than about `RANKED` pieces. Pieces that fill a sequence need no order: each task numbers its own, and
sequence ids follow from the tasks' counts, without a shuffle.

Defined results: null text counts as empty and yields the single id 0; every id lies in exactly one
piece; equal doc_ids keep their own pieces; sequence ids are 0.. without gaps; an empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import common as C
from weftline.llm.tokens import encoding
from weftline.runtime import Scratch, ship_package, table

SIZE, RANKED = 1024, 1_000_000


def shortest_pack_first(hist: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used. Every pattern's sum is at most size; lengths fall within it."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # room left: (count, pattern)
    for length in sorted((x for x, c in hist.items() if c > 0), reverse=True):
        todo = hist[length]
        space = size
        while todo and space >= length:  # the emptiest pack first
            while todo and room[space]:
                count, pattern = room[space].pop()
                used = min(count, todo)
                if count > used:
                    room[space].append((count - used, pattern))
                # several of one length may go into a pack at once, as long as all used packs get as many
                n = min(space // length, max(1, todo // used))
                room[space - n * length].append((used, pattern + (length,) * n))
                todo -= used * n
            space -= 1
        if todo:
            n = size // length
            if whole := todo // n:
                room[size - n * length].append((whole, (length,) * n))
            if rest := todo - whole * n:
                room[size - rest * length].append((1, (length,) * rest))
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for packs in room.values():
        for count, pattern in packs:
            merged[pattern] += count
    return sorted(merged.items())


def assignments(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Intervals of rank by length: (length, first rank, first sequence, offset), sorted."""
    at: dict[int, int] = defaultdict(int)
    rows, seq = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, at[length], seq, offset))
            at[length] += count
            offset += length
        seq += count
    rows.sort()
    cols = list(zip(*rows)) if rows else [[]] * 4
    return {k: np.array(v, np.int64) for k, v in zip(("length", "rank", "seq", "offset"), cols)} | {"used": np.int64(seq)}


def _pieces(size: int, name: str, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, full = encoding(name, path)._core_bpe, TaskContext.get().partitionId(), 0
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            out: list[list[int]] = [[] for _ in range(7)]
            for d, t in zip(C.column(b, "doc_id").to_pylist(), C.column(b, "text").to_pylist()):
                ids = np.asarray([*(enc.encode_ordinary(t) if t else ()), 0], "<u4")
                for s in range(0, len(ids), size):
                    one = ids[s : s + size]
                    for col, v in zip(out, (d, s, len(one), zlib.crc32(one.tobytes()), len(ids), part, full)):
                        col.append(v)
                    full += len(one) == size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"])
        C.release()

    return run


def pieces(docs: DataFrame, size: int = SIZE, name: str = "byte_bpe_50k", path: str | None = None) -> DataFrame:
    """The pieces of every document, without their sequences; (part, place) numbers those that fill one."""
    ship_package(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_pieces(size, name, path), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, place long")


_KEEP = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, size: int = SIZE, name: str = "byte_bpe_50k", path: str | None = None, ranked: int = RANKED) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    p = scratch.save(pieces(docs, size, name, path), "pieces")
    by_part = sorted(map(tuple, p.where(F.col("length") == size).groupBy("part").agg(F.count("*")).collect()))  # a row for each task that read documents
    rest = p.where(F.col("length") < size).drop("part", "place")
    hottest = rest.groupBy("length").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    salts = 1 + hottest // ranked
    rest = rest.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    rows = rest.groupBy("length", "_salt").agg(F.count("*").alias("_n")).collect()  # at most size * salts rows
    hist: dict[int, int] = defaultdict(int)
    offsets = np.zeros((size + 1, salts), np.int64)
    for length, s, n in sorted(map(tuple, rows)):
        offsets[length, s] = hist[length]
        hist[length] += n
    t = assignments(shortest_pack_first(hist, size))
    parts = np.array([x[0] for x in by_part], np.int64)
    begin = int(t["used"]) + np.cumsum([0] + [x[1] for x in by_part])[:-1]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, place = (C.column(b, c).to_numpy(zero_copy_only=False) for c in ("part", "place"))
            seq = begin[np.searchsorted(parts, part)] + place if len(parts) else place
            yield pa.RecordBatch.from_arrays([*(C.column(b, k) for k in _KEEP), pa.array(seq), pa.array(np.zeros(len(seq), np.int64))], names=[*_KEEP, "sequence_id", "offset"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = np.searchsorted(t["length"], np.arange(size + 2))
        for b in batches:
            length, salt, r = (C.column(b, c).to_numpy(zero_copy_only=False) for c in ("length", "_salt", "_r"))
            rank = offsets[length, salt] + r - 1
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                m = np.flatnonzero(length == x)
                i = lo[x] + np.searchsorted(t["rank"][lo[x] : lo[x + 1]], rank[m], side="right") - 1
                seq[m] = t["seq"][i] + rank[m] - t["rank"][i]
                off[m] = t["offset"][i]
            yield pa.RecordBatch.from_arrays([*(C.column(b, k) for k in _KEEP), pa.array(seq), pa.array(off)], names=[*_KEEP, "sequence_id", "offset"])

    w = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    some = rest.withColumn("_r", F.row_number().over(w).cast("long")).mapInArrow(place, _PLACED)
    return p.where(F.col("length") == size).mapInArrow(fill, _PLACED).unionByName(some)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
