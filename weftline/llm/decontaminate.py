"""Benchmark decontamination (4): pigeonhole edit matching.

Each test item of m bytes has an error budget of k edits and is split into k + 1 pieces; a passage within
k edits holds at least one piece unchanged. A rolling hash finds the pieces at every position of every
text, and Myers' bit-parallel algorithm verifies the windows around the hits. Texts are compared as
lower-cased (A-Z) bytes with every white-space byte turned into a space, so positions carry over.

Items are broadcast in blocks of at most `block_bytes`; a benchmark of any size is a stated query set run
against all rows, block by block.

Defined results: null or empty texts match nothing; null, empty or blank items match nothing; an item shorter
than 16 bytes must occur exactly; repeated items and documents are each reported; for a document and item
the match of least distance counts, the leftmost of equals; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common as C
from weftline.runtime import ship_package, table

SEED, RATE = 16, 0.06
_NORM = C.LOWER.copy()
_NORM[C.WS] = 0x20


def normal(text: str) -> bytes:
    return _NORM[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tobytes()


def budget(m: int, rate: float = RATE, seed: int = SEED) -> int:
    """Edits allowed for an item of m bytes: a share of its length, and pieces of at least `seed` bytes."""
    return max(0, min(int(m * rate), m // seed - 1))


def myers(pattern: bytes, text: bytes, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of the pattern inside text within k edits, leftmost end of equals.

    Bit-parallel; the whole pattern is one Python integer of as many bits as it has bytes.
    """
    m = len(pattern)
    if not m:
        return None
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (m, 0) if m <= k else None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full  # row 0 stays 0: an occurrence may begin anywhere
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
    return best


def occurrence(pattern: bytes, text: bytes, k: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best occurrence within k edits."""
    if (at := text.find(pattern)) >= 0 and pattern:
        return 0, at, at + len(pattern)
    if not k or (hit := myers(pattern, text, k)) is None:
        return None
    d, end = hit
    lo = max(0, end - len(pattern) - k)
    back = myers(pattern[::-1], text[lo:end][::-1], d)
    return d, end - back[1], end


class Items:
    """Seeds of a block of test items, looked up by hash."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE):
        self.items = items
        by_len: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # seed length: (hash, item, offset)
        for n, (_, t) in enumerate(items):
            if not t:
                continue
            k = budget(len(t), rate)
            size = len(t) // (k + 1)
            q = min(SEED, size)
            r = C.Rolling(np.frombuffer(t, np.uint8))
            at = np.arange(k + 1) * size
            for a, h in zip(at, r(at, at + q)):
                by_len[q].append((int(h), n, int(a)))
        self.tables = []
        for q, rows in sorted(by_len.items()):
            rows.sort()
            h = np.array([x[0] for x in rows], C.U)
            bits = np.zeros(1 << 20, bool)
            bits[(h >> C.U(44)).astype(np.int64)] = True
            self.tables.append((q, h, np.array([x[1] for x in rows]), np.array([x[2] for x in rows]), bits))
        self.budgets = [budget(len(t), rate) for _, t in items]

    def find(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, distance, start, end), positions in bytes of the row; the best for each row and item."""
        low = _NORM[data]
        n = len(low)
        roll = C.Rolling(low)
        cand: dict[tuple[int, int], list[int]] = defaultdict(list)
        for q, hs, item, offset, bits in self.tables:
            if n < q:
                continue
            h = roll.windows(q)
            at = np.flatnonzero(bits[(h >> C.U(44)).astype(np.int64)])
            lo = np.searchsorted(hs, h[at], side="left")
            hi = np.searchsorted(hs, h[at], side="right")
            some = hi > lo
            at, lo, hi = at[some], lo[some], hi[some]
            row = np.searchsorted(off, at, side="right") - 1
            ok = at + q <= off[row + 1]
            for a, l, u, r in zip(at[ok].tolist(), lo[ok].tolist(), hi[ok].tolist(), row[ok].tolist()):
                for e in range(l, u):
                    cand[r, int(item[e])].append(a - int(offset[e]) - int(off[r]))
        for (r, i), diagonals in sorted(cand.items()):
            pattern, k = self.items[i][1], self.budgets[i]
            doc = low[off[r] : off[r + 1]]
            best = None
            diagonals.sort()
            j = 0
            while j < len(diagonals):
                first = last = diagonals[j]
                while j < len(diagonals) and diagonals[j] <= last + 2 * k + 1:
                    last = diagonals[j]
                    j += 1
                lo = max(0, first - k)
                hit = occurrence(pattern, doc[lo : max(0, last) + len(pattern) + k].tobytes(), k)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], hit[1] + lo, hit[2] + lo)
                    if not hit[0]:
                        break
            if best:
                yield r, i, *best


def blocks(benchmark: DataFrame, block_bytes: int = 1 << 20) -> Iterator[list[tuple[int, bytes]]]:
    """The test items, normalised, in blocks of bounded size; the driver holds one block."""
    out, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if r[1] and (t := normal(r[1])).strip():
            out.append((r[0], t))
            size += len(out[-1][1])
            if size >= block_bytes:
                yield out
                out, size = [], 0
    if out:
        yield out


def _matches(items: list[tuple[int, bytes]], rate: float):
    made: list[Items] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = made[0] if made else Items(items, rate)
        for rows, data, off in C.slices(batches):
            ids = C.column(rows, "doc_id").to_pylist()
            cp = C.code_points(data)
            found = [(ids[r], items[i][0], d, int(cp[off[r] + s] - cp[off[r]]), int(cp[off[r] + e] - cp[off[r]])) for r, i, d, s, e in finder.find(data, off)]
            cols = list(zip(*found)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "distance", "start", "end"])

    return run


SCHEMA = "doc_id long, item_id long, distance long, start long, end long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """A row for each document and test item found in it: edits, and the span in code points."""
    ship_package(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for b in blocks(benchmark):
        part = d.mapInArrow(_matches(b, rate), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def _without(items: list[tuple[int, bytes]], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Items(items, rate)
        for rows, data, off in C.slices(batches):
            keep = np.ones(rows.num_rows, bool)
            for r, *_ in finder.find(data, off):
                keep[r] = False
            yield rows.filter(pa.array(keep))

    return run


def remove_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents in which no test item is found, with all their columns."""
    ship_package(docs.sparkSession)
    for b in blocks(benchmark):
        docs = docs.mapInArrow(_without(b, rate), docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
