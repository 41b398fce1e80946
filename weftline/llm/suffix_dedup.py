"""Suffix-array dedup (2): repeated 200-byte strings by a distributed difference-cover algorithm.

A difference cover D modulo v (v = 91, 10 residues) has the property that for any two positions i and j
some offset d < v puts both i + d and j + d into the sample {p : p mod v in D}. So

1. the prefixes of 110 bytes at all sampled positions are named and the names sorted; a name that one
   position alone has is settled: no 200-byte string through that sample occurs twice;
2. the algorithm recurses on the sampled positions whose names are shared: their names are refined to the
   whole context that decides (up to 90 bytes before and 200 after) and sorted again. Positions with equal
   refined names settle all 200-byte strings through them at once. Where a name has several refined ones,
   strings may still agree in part, so one position of each class goes on; where it has one alone, none does;
3. the suffixes that are left are merged in: every position that such a sample anchors, by its 200-byte
   prefix; adjacent equal prefixes mark both.

Marked positions cover 200 bytes each. The modulus is 91 instead of the textbook's 3, because only prefixes
of 200 bytes have to be ordered: 11 % of the positions are sampled instead of 67 %, and two levels of names
reach 200 bytes. Names are fingerprints, sorted by value: repeats need equal strings to be adjacent, and the
order of different strings doesn't matter. Names of step 1 have 40 bits, where a clash costs work and never
a result. What decides has 96 bits of two independent fingerprints beside the bucket (steps 2 and 3), or 128
bits of BLAKE2b beside the length (copies of whole texts). Among n compared strings n * n / (2**97 * buckets)
false matches are expected, under 1e-8 for the 1e13 strings that may be left of 100 TB.

Texts are packed once into blocks of about SLICE bytes in the shared folder, and every position is known by
(block, offset), so all steps join by block: one row for 2 MB of text. Names travel as packed rows, one for
each block and bucket; a block sends any name once and settles its own repetitions, so a name that a third
of all rows hold costs one entry per block. The number of buckets follows the size of the input; a task
sorts its rows by bucket and holds one bucket at a time. Beyond FAN buckets names are scattered twice, so
that a block never writes more than FAN rows. Copies of whole texts are covered entirely, and one of them
stands for all in the search.

Defined results: null text is empty; texts under 200 bytes keep everything; repeated rows are copies of
each other and lose everything from 200 bytes on; an empty table gives no rows; very long texts are read
whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common as C
from weftline.runtime import Scratch, release_shuffles, ship_package, shuffle_partitions, table

MATCH, V = 200, 91
COVER = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)
PREFIX = MATCH - V + 1
SLICE = 2 << 20
#: Text whose names share a bucket, and how many buckets one row is scattered to at most.
BUCKET_BYTES, FAN = 16 << 20, 2048
#: Beyond so many buckets (or shuffle partitions, if there are more) a task takes several, one after the other.
MOST_TASKS = 10_000
#: What an answer says of its positions: the name is shared (0); the context is (1); its strings need not be compared (2).
SHARED, MATCHED, SILENT = 0, 1, 2

_BLOCKS = "block long, size long, ids array<bigint>, keys array<binary>, packed binary, lens binary"
_NAMES = "bucket int, blocks binary, counts binary, vals binary, names binary"
_FLAT = "block long, kind int, vals binary"


# ---- packed rows


def pack_offsets(v: np.ndarray) -> bytes:
    """Ascending numbers as 16-bit differences, one of 65,535 ahead for every 65,535 beyond."""
    d = np.diff(v, prepend=0)
    q = d // 65535
    if not q.any():
        return d.astype("<u2").tobytes()
    out = np.full(len(d) + int(q.sum()), 65535, "<u2")
    out[np.cumsum(q + 1) - 1] = d % 65535
    return out.tobytes()


def unpack_offsets(b: bytes) -> np.ndarray:
    a = np.frombuffer(b, "<u2")
    return np.cumsum(a, dtype=np.int64)[a != 65535]


#: Bytes of the parts of a name, by step: 40 bits of a fingerprint; these and a context; 64 bits of one and 32 of another fingerprint.
_PARTS = {"names": (5,), "contexts": (5, 8, 4), "prefixes": (8, 4)}


def _bytes_of(h: tuple[np.ndarray, ...], parts: tuple[int, ...]) -> np.ndarray:
    """Names as rows of bytes: the low bytes of each part."""
    return np.concatenate([x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n] for x, n in zip(h, parts)], axis=1)


def _of_bytes(a: np.ndarray, parts: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    out, lo = [], 0
    for n in parts:
        w = np.zeros((len(a), 8), np.uint8)
        w[:, :n] = a[:, lo : lo + n]
        out.append(w.view("<u8").ravel())
        lo += n
    return tuple(out)


def _bucket_of(h: tuple[np.ndarray, ...], step: str, nb: int) -> np.ndarray:
    """Drawn from bits that the names don't carry, so that it adds to them; a context goes where its name goes."""
    spare = h[1] >> C.U(32) if step == "prefixes" else h[0] >> C.U(40)
    return (C.mix(spare) % C.U(nb)).astype(np.int64)


def _names_batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "blocks", "counts", "vals", "names"])


def _flat_batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["block", "kind", "vals"])


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    st = C.starts_of_groups(key)
    return st, np.append(st[1:], len(key))


def _equal(h: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(order, class) of the entries whose whole name another entry has too; equal entries stay in their order."""
    order = np.argsort(h[0], kind="stable")
    s = h[0][order]
    eq = s[1:] == s[:-1]
    same = np.zeros(len(s), bool)
    same[1:] |= eq
    same[:-1] |= eq
    e = order[same]
    if len(h) > 1:
        e = e[np.lexsort((e, h[1][e], h[0][e]))]
    new = np.ones(len(e), bool)
    new[1:] = h[0][e[1:]] != h[0][e[:-1]]
    if len(h) > 1:
        new[1:] |= h[1][e[1:]] != h[1][e[:-1]]
    cls = np.cumsum(new) - 1
    many = np.bincount(cls, minlength=0)[cls] > 1 if len(cls) else np.zeros(0, bool)
    return e[many], cls[many]


# ---- the two sides of a sort by name


def _send(block: int, at: np.ndarray, h: tuple[np.ndarray, ...], fan: int, step: str) -> Iterator[pa.RecordBatch]:
    """A block's names at ascending offsets: each goes out once, repetitions inside the block are answered here (bucket -1)."""
    e, cls = _equal(h[-2:])
    keep = np.ones(len(at), bool)
    if len(e):
        later = np.zeros(len(e), bool)
        later[1:] = cls[1:] == cls[:-1]
        keep[e[later]] = False
        head = block.to_bytes(8, "little", signed=True)
        answers = [(-1, head, bytes([MATCHED if step == "contexts" else SHARED]), pack_offsets(np.sort(at[e])), b"")]
        if step == "contexts":
            answers.append((-1, head, bytes([SILENT]), pack_offsets(np.sort(at[e[later]])), b""))
        yield from _names_batch(answers)
    at, h = at[keep], tuple(x[keep] for x in h)
    bucket = _bucket_of(h, step, fan)
    order = np.argsort(bucket, kind="stable")
    first = np.searchsorted(bucket[order], np.arange(fan + 1))
    raw, rows = _bytes_of(h, _PARTS[step]), []
    for b in range(fan):
        o = order[first[b] : first[b + 1]]
        if len(o):
            rows.append((b, block.to_bytes(8, "little", signed=True), len(o).to_bytes(4, "little"), pack_offsets(at[o]), raw[o].tobytes()))
    yield from _names_batch(rows)


def _entries(rows: list[tuple], parts: tuple[int, ...]) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """(names, block, offset) of the entries in rows of one bucket."""
    hs, bs, vs = [], [], []
    for blocks, counts, vals, names in rows:
        n = np.frombuffer(counts, "<u4").astype(np.int64)
        v = unpack_offsets(vals)
        if len(n) > 1:  # offsets run on from block to block
            st = np.cumsum(n) - n
            v -= np.repeat(np.where(st > 0, v[st - 1], 0), n)
        hs.append(np.frombuffer(names, np.uint8).reshape(-1, sum(parts)))
        bs.append(np.repeat(np.frombuffer(blocks, "<i8"), n))
        vs.append(v)
    return _of_bytes(np.concatenate(hs), parts), np.concatenate(bs), np.concatenate(vs)


def _by_bucket(batches: Iterator[pa.RecordBatch], limit: int | None = None) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of one bucket after the other, from rows sorted by bucket; with a limit, of at most about so many bytes."""
    bucket, rows, size = None, [], 0
    for b in batches:
        for k, *row in zip(*(b.column(i) for i in range(b.num_columns))):
            k = k.as_py()
            if rows and (k != bucket or limit and size > limit):
                yield bucket, rows
                rows, size = [], 0
            bucket = k
            rows.append(tuple(x.as_py() for x in row))
            size += sum(map(len, rows[-1]))
    if rows:
        yield bucket, rows


def _split(per: int, step: str):
    """Second scatter, beyond FAN buckets: of one coarse bucket to its fine ones, drawn from the names."""
    parts = _PARTS[step]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches, 64 << 20):
            if bucket < 0:
                yield from _names_batch([(bucket, *r) for r in rows])
                continue
            h, block, at = _entries(rows, parts)
            fine = bucket * per + (C.mix(h[0]) % C.U(per)).astype(np.int64)
            order = np.lexsort((at, block, fine))
            raw, out = _bytes_of(h, parts), []
            for b in range(bucket * per, (bucket + 1) * per):
                lo, hi = np.searchsorted(fine[order], (b, b + 1))
                o = order[lo:hi]
                if len(o):
                    st, en = _groups(block[o])
                    v = at[o].copy()
                    v += np.repeat(np.concatenate(([0], np.cumsum(v[en - 1])[:-1])), en - st)
                    out.append((b, block[o][st].astype("<i8").tobytes(), (en - st).astype("<u4").tobytes(), pack_offsets(v), raw[o].tobytes()))
            yield from _names_batch(out)
        C.release()

    return run


def _compare(h: tuple[np.ndarray, ...], step: str) -> list[tuple[int, np.ndarray]]:
    """(kind, entries) from one bucket's sorted names: neighbours that are equal."""
    if step != "contexts":
        return [(SHARED, _equal(h)[0])]
    order = np.lexsort((h[2], h[1], h[0]))
    name, one, two = (x[order] for x in h)
    other = np.ones(len(order), bool)
    other[1:] = name[1:] != name[:-1]
    new = other.copy()
    new[1:] |= (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    cls, group = np.cumsum(new) - 1, np.cumsum(other) - 1
    size, classes = np.bincount(cls), np.bincount(group, weights=new)
    # where a name has one context alone, nothing else can be compared with its strings
    return [(MATCHED, order[size[cls] > 1]), (SILENT, order[(classes[group] == 1) | ~new])]


def _answer(step: str):
    """Rows (block, kind, offsets) of what a bucket's names tell about its entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            if bucket < 0:
                yield from _flat_batch([(int.from_bytes(r[0], "little", signed=True), r[1][0], r[2]) for r in rows])
                continue
            h, block, at = _entries(rows, _PARTS[step])
            out = []
            for kind, e in _compare(h, step):
                o = e[np.lexsort((at[e], block[e]))]
                st, en = _groups(block[o])
                v = at[o]
                out += [(int(block[o[a]]), kind, pack_offsets(v[a:b])) for a, b in zip(st.tolist(), en.tolist())]
            del h, block, at, rows
            yield from _flat_batch(out)
        C.release()

    return run


# ---- texts in blocks


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    z, part = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
    for n, (rows, data, off) in enumerate(C.slices(batches, limit=SLICE)):
        lens, raw = np.diff(off), data.tobytes()
        o = off.tolist()
        keys = [(b - a).to_bytes(8, "little") + hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(o, o[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([(part << 32) | n], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([C.column(rows, "doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([keys], pa.list_(pa.binary())), pa.array([z.compress(raw)], pa.binary()), pa.array([lens.astype("<i8").tobytes()], pa.binary())],
            names=["block", "size", "ids", "keys", "packed", "lens"],
        )


def _open(packed: bytes, lens: bytes) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate(([0], np.cumsum(np.frombuffer(lens, "<i8"))))
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, int(off[-1]))), np.uint8), off


class Fingerprints:
    """Two independent 64-bit fingerprints of any substring: one over bytes, one over mixed 8-byte strings."""

    def __init__(self, data: np.ndarray):
        self.one = C.Rolling(data)
        n = max(0, len(data) - 7)
        w = np.zeros(n, C.U)
        for j in range(8):
            w |= data[j : j + n].astype(C.U) << C.U(8 * j)
        p, self.inv = C._powers(n + 1)
        v = C.mix(w + C.U(0x5851F42D4C957F2D))
        v *= p[:n]
        self.pre = np.zeros(n + 1, C.U)
        np.cumsum(v, out=self.pre[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray, shape: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of strings of at least 8 bytes; `shape` is a number that must be equal as well."""
        h = self.pre[end - 7] - self.pre[start]
        h *= self.inv[start]
        h += (end - start).astype(C.U) * C._LEN
        one = self.one(start, end)
        if shape is not None:
            h += shape.astype(C.U) * C.U(0xA24BAED4963EE407)
            one = C.mix(one + shape.astype(C.U))
        return one, C.mix(h)


def _sample(fan: int, match: int):
    prefix = match - V + 1
    inside = np.zeros(V, bool)
    inside[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, off = _open(row["packed"], row["lens"])
            size = np.diff(off)
            _, extra = _copies(row["flags"], len(size))
            n = np.where((size >= match) & ~extra, np.maximum(size - prefix + 1, 0), 0)  # positions that may be sampled
            if not n.any():
                continue
            doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
            local = np.arange(len(doc), dtype=np.int32) - (np.cumsum(n) - n).astype(np.int32)[doc]
            m = inside[local % V]
            at = off[doc[m]] + local[m]
            del doc, local, m
            yield from _send(row["block"], at, (C.Rolling(data)(at, at + prefix),), fan, "names")
        C.release()

    return run


def _copies(flags: list[dict] | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of a block's texts have copies, and which of these don't stand for the others."""
    copied, extra = np.zeros(n, bool), np.zeros(n, bool)
    for f in flags or ():
        copied[f["i"]], extra[f["i"]] = True, f["extra"]
    return copied, extra


def _answers(col: list[dict] | None, kind: int) -> np.ndarray:
    """Ascending offsets of one kind among a block's answers."""
    parts = [unpack_offsets(a["vals"]) for a in col or () if a["kind"] == kind]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _reach(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any of [lo, hi]."""
    c = np.zeros(n + 1, np.int32)
    np.add.at(c, lo, 1)
    np.add.at(c, hi + 1, -1)
    return np.cumsum(c[:-1]) > 0


class Block:
    """One block with the answers about it and its copied texts."""

    def __init__(self, row: dict, match: int):
        self.block, self.match = row["block"], match
        self.data, self.off = _open(row["packed"], row["lens"])
        self.copied, _ = _copies(row["flags"], len(self.off) - 1)
        self.p = _answers(row["answers"], SHARED)
        doc = np.searchsorted(self.off, self.p, side="right") - 1
        # the strings through each sample begin in [lo, hi]
        self.lo = np.maximum(self.p - V + 1, self.off[doc])
        self.hi = np.minimum(self.p, self.off[doc + 1] - match)
        some = self.lo <= self.hi
        self.p, self.lo, self.hi = self.p[some], self.lo[some], self.hi[some]
        self.matched = np.isin(self.p, _answers(row["answers"], MATCHED))
        self.silent = np.isin(self.p, _answers(row["answers"], SILENT))

    def contexts(self) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        f = Fingerprints(self.data)
        return self.p, (f.one(self.p, self.p + self.match - V + 1), *f(self.lo, self.hi + self.match, (self.p - self.lo) * 1024 + (self.hi - self.p + V)))

    def left(self) -> np.ndarray:
        """Positions that step 3 compares."""
        speak = ~self.silent
        return np.flatnonzero(_reach(len(self.data), self.lo[speak], self.hi[speak]))

    def known(self) -> np.ndarray:
        return _reach(len(self.data), self.lo[self.matched], self.hi[self.matched])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _contexts(fan: int, match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Block(row, match)
            if len(b.p):
                yield from _send(b.block, *b.contexts(), fan, "contexts")
        C.release()

    return run


def _prefixes(fan: int, match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Block(row, match)
            at = b.left()
            if len(at):
                yield from _send(b.block, at, Fingerprints(b.data)(at, at + match), fan, "prefixes")
        C.release()

    return run


def _cover(match: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Block(row, match)
            data, off = b.data, b.off
            mark = b.known()
            mark[_answers(row["last"], SHARED)] = True
            at = np.flatnonzero(mark)
            gone = _reach(len(data), at, at + match - 1) if len(at) else np.zeros(len(data), bool)
            lens = np.diff(off)
            gone |= np.repeat(b.copied & (lens >= match), lens)
            n = len(lens)
            st, _ = C.runs(gone, off)
            spans = C.per_row(np.searchsorted(off, st, side="right") - 1, n)
            c = np.concatenate(([0], np.cumsum(gone)))
            removed = c[off[1:]] - c[off[:-1]]
            kept = data[~gone].tobytes()
            end = np.cumsum(lens - removed)
            parts = [kept[x:y] for x, y in zip((end - (lens - removed)).tolist(), end.tolist())]
            cols = [pa.array(row["ids"], pa.int64()), pa.array(lens), pa.array(removed), pa.array(spans.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in parts])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                cols.append(pa.array([x.decode("utf-8", "ignore") for x in parts], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names=names)
        C.release()

    return run


def copied_texts(blocks: DataFrame, hot: int = 1000) -> DataFrame:
    """(block, flags) of blocks with copies: rows whose text another row has, `extra` on all but one of them.

    Texts with more than `hot` copies are broadcast, at most 100,000 of them because the bound on copies grows
    with the table; the others are joined by key.
    """
    meta = blocks.select("block", F.posexplode("keys").alias("i", "key"))
    n = meta.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("block", "i")).alias("rep")).where("n > 1")
    total = blocks.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    bound = max(hot, total // 100_000)
    often = meta.join(F.broadcast(n.where(F.col("n") > bound)), "key")
    seldom = meta.join(n.where(F.col("n") <= bound), "key")
    one = often.unionByName(seldom).select("block", F.struct("i", (F.struct("block", "i") != F.col("rep")).alias("extra")).alias("f"))
    return one.groupBy("block").agg(F.collect_list("f").alias("flags"))


def remove_repeats(docs: DataFrame, match: int = MATCH, texts: bool = False, scratch: Scratch | None = None, bucket_bytes: int = BUCKET_BYTES, most: int = FAN) -> DataFrame:
    """What is left of each text: sizes, spans and SHA-256; with texts=True the text too (cut code points dropped).

    `match` may be any length of at least 110 bytes.
    """
    if match < V + 19:
        raise ValueError("match is too short for this difference cover")
    spark = docs.sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    blocks = scratch.save(d.mapInArrow(_block_rows, _BLOCKS), "blocks")
    total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    nb = max(1, -(-total // bucket_bytes))
    fan, per = min(nb, most), -(-nb // min(nb, most))

    def answers(names: DataFrame, step: str) -> DataFrame:
        # rows that are answers already need no place; they are spread by block
        bucket = lambda n: F.when(F.col("bucket") < 0, F.pmod(F.hash("blocks"), F.lit(n))).otherwise(F.col("bucket") % n)
        if per > 1:
            names = names.repartitionById(fan, bucket(fan)).sortWithinPartitions("bucket").mapInArrow(_split(per, step), _NAMES)
        n = min(fan * per, max(shuffle_partitions(spark), MOST_TASKS))
        names = names.repartitionById(n, bucket(n)).sortWithinPartitions("bucket")
        a = scratch.save(names.mapInArrow(_answer(step), _FLAT), step)
        release_shuffles(spark)
        return a

    flags = scratch.save(copied_texts(blocks), "copies")
    release_shuffles(spark)
    sampled = blocks.select("block", "packed", "lens").join(flags, "block", "left").mapInArrow(_sample(fan, match), _NAMES)
    first = answers(sampled, "names")

    def of_block(a: DataFrame, name: str) -> DataFrame:
        return a.groupBy("block").agg(F.collect_list(F.struct("kind", "vals")).alias(name))

    def known(a: DataFrame, *cols: str) -> DataFrame:
        j = blocks.select("block", *cols, "packed", "lens").join(of_block(a, "answers"), "block", "left")
        return j.join(flags, "block", "left")

    second = answers(known(first).mapInArrow(_contexts(fan, match), _NAMES), "contexts")
    both = first.unionByName(second)
    third = answers(known(both).mapInArrow(_prefixes(fan, match), _NAMES), "prefixes")
    last = known(both, "ids").join(of_block(third, "last"), "block", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts
    return last.mapInArrow(_cover(match, texts), schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
