"""License scans (10): fuzzy search for short notices.

Base phrases are exact word sequences. The method adds fuzzy labels: each notice of m characters may
have k errors and is split into k + 1 exact seeds; a rolling hash over the normalised text finds the
seeds, and the `regex` library's bounded-error matching verifies a window around them and gives span
and error count.

Normalised text: A-Z lower-cased, words joined by single spaces. Defined results: null text counts as
empty; a document without a word has no label, null first and last word and score 0; score is the best
match's 1 - errors / length, 1 for a base phrase; texts of any length are read whole; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common as C
from weftline.runtime import ship_package, table

#: Everything but 0-9, a-z and bytes from 0x80, after lower-casing.
SEPARATOR = np.ones(256, bool)
SEPARATOR[48:58] = SEPARATOR[97:123] = SEPARATOR[128:] = False

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

NOTICES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "is licensed under the gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc", "licensed under a creative commons attribution"),
    ("public-domain", "this work is dedicated to the public domain"),
)
SEED = 12


def budget(m: int) -> int:
    """Errors allowed in a notice of m bytes."""
    return m // SEED - 1


def _seeds() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = []
    for n, (_, t) in enumerate(NOTICES):
        b = t.encode()
        size = len(b) // (budget(len(b)) + 1)
        r = C.Rolling(np.frombuffer(b, np.uint8))
        at = np.arange(budget(len(b)) + 1) * size
        rows += [(int(h), n, int(a)) for h, a in zip(r(at, at + SEED), at)]
    rows.sort()
    h = np.array([x[0] for x in rows], C.U)
    bits = np.zeros(1 << 20, bool)
    bits[(h >> C.U(44)).astype(np.int64)] = True
    return h, np.array([x[1] for x in rows]), np.array([x[2] for x in rows]), bits


class Scanner:
    def __init__(self):
        self.hash, self.notice, self.offset, self.bits = _seeds()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(t)}){{e<={budget(len(t))}}}") for _, t in NOTICES]
        self.phrases = []
        for p, label in BASE:
            data, off = C.buffers(pa.array([p]))
            st, en, _ = C.words(data, off)
            self.phrases.append((C.Rolling(data)(st, en), label))

    def base(self, roll: C.Rolling, st, en, row) -> list[tuple[np.ndarray, str]]:
        """Word index of every place of every phrase."""
        h = roll(st, en)
        out = []
        for want, label in self.phrases:
            k = len(want)
            hit = np.zeros(max(0, len(h) - k + 1), bool)
            if len(hit):
                hit = h[: len(hit)] == want[0]
                for j in range(1, k):
                    hit &= h[j : j + len(hit)] == want[j]
                hit &= row[: len(hit)] == row[k - 1 :]
            out.append((np.flatnonzero(hit), label))
        return out

    def fuzzy(self, low: np.ndarray, off: np.ndarray, st, en, row) -> Iterator[tuple[int, str, int, int, int, int]]:
        """(row, label, start byte, end byte, errors, length of notice), byte positions in the slice."""
        if not len(st):
            return
        # normalised stream: each word and one space after it
        lens = en - st
        word_at = np.cumsum(np.concatenate(([0], lens + 1)))[:-1]  # where each word begins in norm
        src = np.repeat(st - word_at, lens + 1)
        src += np.arange(len(src))
        gap = word_at + lens
        src[gap] -= 1
        norm = low[src]
        norm[gap] = 32
        first = np.searchsorted(row, np.arange(len(off) - 1), side="left")
        bound = np.append(word_at, len(norm))[np.append(first, len(st))]  # row r is norm[bound[r]:bound[r + 1]]
        n = len(norm)
        if n < SEED:
            return
        h = C.Rolling(norm).windows(SEED)
        at = np.flatnonzero(self.bits[(h >> C.U(44)).astype(np.int64)])
        lo = np.searchsorted(self.hash, h[at], side="left")
        hi = np.searchsorted(self.hash, h[at], side="right")
        cand: dict[tuple[int, int], list[int]] = defaultdict(list)
        rr = np.searchsorted(bound, at, side="right") - 1
        for a, l, u, w in zip(at.tolist(), lo.tolist(), hi.tolist(), rr.tolist()):
            for e in range(l, u):
                if a + SEED <= bound[w + 1]:
                    cand[w, int(self.notice[e])].append(a - int(self.offset[e]))
        for (w, i), diagonals in sorted(cand.items()):
            label, t = NOTICES[i]
            k, m = budget(len(t)), len(t)
            diagonals.sort()
            j, b0, b1 = 0, int(bound[w]), int(bound[w + 1])
            while j < len(diagonals):
                lo_d = hi_d = diagonals[j]
                while j < len(diagonals) and diagonals[j] <= hi_d + 2 * k + 1:
                    hi_d = diagonals[j]
                    j += 1
                p, q = max(b0, lo_d - k), min(b1, max(b0, hi_d) + m + k)
                while p < q and (norm[p] & 0xC0) == 0x80:
                    p += 1
                while p < q < b1 and (norm[q] & 0xC0) == 0x80:
                    q -= 1
                window = norm[p:q].tobytes().decode("utf-8", "replace")
                if hit := self.patterns[i].search(window):
                    s = p + len(window[: hit.start()].encode())
                    e = p + len(window[: hit.end()].encode())
                    if e > s:
                        yield w, label, int(src[s]), int(src[e - 1]) + 1, sum(hit.fuzzy_counts), m


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for rows, data, off in C.slices(batches):
        low = C.LOWER[data]
        n = rows.num_rows
        st, en, row = C.words(low, off, SEPARATOR)
        n_words = C.per_row(row, n)
        word0 = np.concatenate(([0], np.cumsum(n_words)))
        n_base = np.zeros(n, np.int64)
        first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        base: list[set[str]] = [set() for _ in range(n)]
        more: list[set[str]] = [set() for _ in range(n)]
        spans: list[list[tuple[int, int, str, int]]] = [[] for _ in range(n)]
        score = np.zeros(n)
        roll = C.Rolling(low)
        for places, label in scanner.base(roll, st, en, row):
            r = row[places]
            n_base += C.per_row(r, n)
            at = places - word0[r]
            np.minimum.at(first, r, at)
            np.maximum.at(last, r, at)
            for x in np.unique(r).tolist():
                base[x].add(label)
                score[x] = 1.0
        cp = C.code_points(data)
        for r, label, s, e, errors, m in scanner.fuzzy(low, off, st, en, row):
            more[r].add(label)
            score[r] = max(score[r], 1 - errors / m)
            spans[r].append((int(cp[s] - cp[off[r]]), int(cp[e] - cp[off[r]]), label, errors))
        none = n_base == 0
        yield pa.RecordBatch.from_arrays(
            [
                C.column(rows, "doc_id"),
                pa.array(n_words.astype(np.int64)),
                pa.array(n_base),
                pa.array(first, pa.int64(), mask=none),
                pa.array(last, pa.int64(), mask=none),
                pa.array([",".join(sorted(b)) for b in base]),
                pa.array([",".join(sorted(b | m)) for b, m in zip(base, more)]),
                pa.array(np.clip(score, 0.0, 1.0)),
                pa.array([",".join(f"{l}:{s}:{e}:{k}" for s, e, l, k in sorted(x)) for x in spans]),
            ],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
        )


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Notices of every document: base phrases, labels, score and spans (label:start:end:errors, code points)."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, SCHEMA)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10_licenses says about the base phrases, for comparison with SQL."""
    return op10_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


LICENSE_BASE_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p(phrase, label) AS (VALUES {", ".join(f"({p.split()!r}, '{l}')" for p, l in BASE)}),
hit AS (SELECT rid, label, i FROM (SELECT rid, ws, label, phrase, unnest(list_filter(range(0, len(ws)), lambda i: ws[i + 1:i + len(phrase)] = phrase)) AS i FROM w, p)),
h AS (SELECT rid, count(*) AS n, min(i) AS a, max(i) AS b, array_to_string(list_sort(list(DISTINCT label)), ',') AS l FROM hit GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(l, '') AS base_labels FROM w LEFT JOIN h USING (rid)
"""
