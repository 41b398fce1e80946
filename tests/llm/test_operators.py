"""Each operator against a brute-force version, with nulls, empty and long texts, ties, copies and empty tables."""

import collections
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import NASTY, rows_of
from weftline.llm import common as C
from weftline.llm import components, decontaminate, licenses, line_dedup, ngram_join, packing, pii, quality_model, quality_rules, suffix_dedup, tokens
from weftline.runtime import Scratch

WORD = r"[^\x20\x09-\x0D]+"
lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t)


def by_id(df, *cols):
    rows = df.select("doc_id", *cols).collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


# ---- shared primitives


@given(st.lists(st.text(max_size=30), max_size=12))
@settings(max_examples=60, deadline=None)
def test_words_and_hashes(ts):
    data, off = C.buffers(pa.array(ts, pa.string()))
    s, e, row = C.words(data, off)
    got = [[] for _ in ts]
    for a, b, r in zip(s, e, row):
        got[r].append(data[a:b].tobytes())
    assert got == [[w.encode() for w in re.findall(WORD, t)] for t in ts]
    h = C.Rolling(data)(s, e)
    seen = {}
    for a, b, x in zip(s, e, h):
        assert seen.setdefault(data[a:b].tobytes(), x) == x
    assert len(set(seen.values())) == len(seen)


@given(st.lists(st.integers(0, 2000), max_size=200))
@settings(max_examples=50, deadline=None)
def test_packed_numbers(v):
    a = np.array(v, np.int64)
    assert C.unpack_small(C.pack_small(a)).tolist() == v
    assert C.unpack40(C.pack40(a.astype(np.uint64))).tolist() == v


# ---- 1 line dedup


def brute_lines(rows, min_sites=line_dedup.MIN_SITES):
    """(id, number of lines, removed, text) of each row."""
    sites = collections.defaultdict(set)
    ok = lambda x: re.search(r"[^ \t\n\x0b\f\r]", x)
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            if ok(x):
                sites[x].add(s)
    out = []
    for i, t, s in rows:
        ls = (t or "").split("\n")
        left = [x for x in ls if len(sites.get(x, ())) < min_sites]
        out.append((i, len(ls), len(ls) - len(left), "\n".join(left) if len(left) < len(ls) else t))
    return out


@pytest.mark.parametrize("broadcast_keys", [line_dedup.BROADCAST_KEYS, 0])
def test_line_dedup(spark, none, broadcast_keys):
    long = "a line of a great many words that all pages of all sites carry " * 80
    rows = []
    for i in range(300):
        t = f"body {i} with some words of its own\nbanner\nseven sites\n\n{long}\nbanner" if i % 3 else f"text {i} alone here"
        if i % 3 and i % 17 >= 7:
            t = t.replace("\nseven sites", "")
        rows.append((i, t, None if i % 17 == 16 else f"site{i % 17}"))
    rows += [(1000, None, "site1"), (1001, "", None), (1002, "banner", "site2"), (1003, "banner\nbanner", "site3"), (1004, "x" * 400 + "\nbanner", "site4")]
    rows += [(1005, "one\nbanner", "s"), (1005, "another text under the same id\nbanner\n \t", None), (1005, "one\nbanner", "s"), (1006, long, "s"), (1007, "é ü\r\nbanner\n\n", "t")]
    d = spark.createDataFrame([(i, t, None, s, None, 1, "x", 2, 3, 4, "l", "t", 5, 6) for i, t, s in rows], NASTY).repartition(3)
    out = line_dedup.remove_boilerplate(d, counts=True, broadcast_keys=broadcast_keys)
    assert sorted(map(str, map(tuple, out.select("doc_id", "_n_lines", "_n_removed", "text").collect()))) == sorted(map(str, brute_lines(rows)))
    plain = line_dedup.remove_boilerplate(d, broadcast_keys=broadcast_keys)
    assert plain.columns == d.columns and plain.count() == len(rows)
    assert line_dedup.remove_boilerplate(none, broadcast_keys=broadcast_keys).count() == 0


def test_keys_in_python_are_those_of_spark(spark, texts):
    import xxhash

    ts = [t for t in texts if t is not None]
    rows = spark.createDataFrame([(t,) for t in ts], "line string").select(F.xxhash64("line"), F.crc32(F.encode("line", "UTF-8"))).collect()
    assert [(a % 2**64, b) for a, b in rows] == [(xxhash.xxh64_intdigest(t.encode(), 42), zlib.crc32(t.encode())) for t in ts]


# ---- 2 suffix-array dedup


def brute_repeats(rows, n=200):
    count = collections.Counter()
    bs = [(i, (t or "").encode()) for i, t in rows]
    for _, b in bs:
        count.update(b[k : k + n] for k in range(len(b) - n + 1))
    out = []
    for i, b in bs:
        gone = bytearray(len(b) + 1)
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        spans = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_cover_is_a_difference_cover():
    assert {(a - b) % suffix_dedup.V for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.V))


def test_suffix_dedup(docs, texts, none):
    short = [t if t is None or len(t) < 20_000 else t[:4000] for t in texts]
    d = docs.sparkSession.createDataFrame(rows_of(short), NASTY).repartition(5)
    got = sorted(map(tuple, suffix_dedup.remove_repeats(d).collect()))
    assert got == brute_repeats(list(enumerate(short)))
    # many buckets, scattered once and twice
    for most in (100_000, 7):
        assert got == sorted(map(tuple, suffix_dedup.remove_repeats(d, bucket_bytes=4096, most=most).collect()))
    assert suffix_dedup.remove_repeats(none).count() == 0


@given(st.lists(st.integers(0, 300_000), max_size=60))
@settings(max_examples=60, deadline=None)
def test_packed_offsets(v):
    a = np.unique(np.array(v, np.int64))
    assert suffix_dedup.unpack_offsets(suffix_dedup.pack_offsets(a)).tolist() == a.tolist()


def test_fingerprints_agree_with_equality():
    r = np.random.default_rng(2)
    data = r.integers(97, 99, 400).astype(np.uint8)
    s = r.integers(0, 360, 3000)
    e = s + r.integers(8, 40, 3000)
    f = suffix_dedup.Fingerprints(data)
    one, two = f(s, e)
    for h in (one, two):
        by, back = {}, {}
        for a, b, x in zip(s, e, h):
            t = data[a:b].tobytes()
            assert by.setdefault(t, x) == x and back.setdefault(x, t) == t
    assert (f(s, e, s)[0] != one).any() and (f(s, e, s)[1] != two).any()


def test_hot_copies_are_broadcast(spark):
    rows = [(i, ("copy of one text " * 20) if i % 2 else f"text of its own number {i} " * 12) for i in range(60)] + [(100 + i, "pair " * 50 + "x") for i in range(2)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from weftline.runtime import Scratch

    blocks = Scratch(spark).save(d.mapInArrow(suffix_dedup._block_rows, suffix_dedup._BLOCKS))
    flags = [[f for r in suffix_dedup.copied_texts(blocks, hot=h).collect() for f in r.flags] for h in (1000, 5)]
    assert [(len(x), sum(f.extra for f in x)) for x in flags] == [(32, 30)] * 2


def test_suffix_dedup_shifted_and_periodic(spark):
    import random

    r = random.Random(3)
    p = "".join(r.choice("abcdefghij \n") for _ in range(260))
    rows = [(i, "".join(r.choice("klmnopqrst ") for _ in range(i * 7)) + p[i % 30 :] + "uvw" * (i % 3)) for i in range(40)]
    rows += [(100, p[:199]), (101, "ab" * 300), (102, "é" * 150 + "z"), (103, "é" * 150 + "y")] + [(104 + i, p[:200] + str(i)) for i in range(3)]
    rows += [(7, rows[7][1]), (7, "another text under the same id " * 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.remove_repeats(d).collect())) == brute_repeats(rows)


# ---- 3 quality classifier


def brute_kn(texts, queries):
    """Interpolated modified Kneser-Ney over bytes with dictionaries."""
    n = quality_model.ORDER
    pad = lambda b: b"\0" * (n - 1) + b
    c = {n: collections.Counter()}
    for t in texts:
        b = pad(t.encode())
        c[n].update(b[i - n + 1 : i + 1] for i in range(n - 1, len(b)))
    for k in range(n - 1, 0, -1):
        c[k] = collections.Counter(g[1:] for g in c[k + 1])
    ds = {k: quality_model.discounts(np.bincount([min(x, 5) for x in c[k].values()], minlength=6)[1:5]) for k in c}
    ctx = {k: collections.defaultdict(list) for k in c}
    for k in c:
        for g, x in c[k].items():
            ctx[k][g[:-1]].append(x)

    def p(k, g):
        if k == 0:
            return 1 / 256
        xs = ctx[k].get(g[:-1])
        low = p(k - 1, g[1:])
        if not xs:
            return low
        x = c[k].get(g, 0)
        return (x - ds[k][min(x, 3)]) / sum(xs) + sum(ds[k][min(y, 3)] for y in xs) / sum(xs) * low

    out = []
    for q in queries:
        b = pad(q.encode())
        m = len(b) - n + 1
        out.append(math.exp(-sum(math.log(p(n, b[i - n + 1 : i + 1])) for i in range(n - 1, len(b))) / m) if m else None)
    return out


def test_kneser_ney(spark, docs, texts, none):
    small = [t if t is None or len(t) < 20_000 else t[:3000] for t in texts]
    d = spark.createDataFrame(rows_of(small), NASTY).repartition(4)
    trusted = spark.createDataFrame([(i,) for i in range(0, len(small), 3)] + [(None,), (0,)], "doc_id long")
    got = by_id(quality_model.perplexities(d, trusted), "perplexity")
    salted = by_id(quality_model.perplexities(d, trusted, docs_per_salt=9, broadcast_ids=0), "perplexity")
    assert {k: v[0] and round(v[0], 2) for k, v in got.items()} == {k: v[0] and round(v[0], 2) for k, v in salted.items()}
    want = brute_kn([t or "" for t in small[::3]], [t or "" for t in small])
    for i, w in enumerate(want):
        assert (got[i][0] is None) == (w is None)
        assert w is None or abs(math.log(got[i][0]) - math.log(w)) < 1e-5
    out = by_id(quality_model.classify(d, trusted), "kept", "n_bytes")
    assert len(out) == len(small) and all(not k for k, n in out.values() if not n)
    assert quality_model.classify(none, trusted).count() == 0
    assert all(k for k, n in by_id(quality_model.classify(d, trusted.where("doc_id < 0")), "kept", "n_bytes").values() if n)


def test_counts_beyond_32_bits():
    c = np.array([1, 2**32, 2**40])
    assert quality_model._counts(quality_model._packed_counts(c), 3).tolist() == c.tolist()
    assert quality_model._counts(quality_model._packed_counts(c[:1]), 1).tolist() == [1] and len(quality_model._packed_counts(c[:1])) == 4
    part = lambda c: pa.RecordBatch.from_arrays([pa.array([7], pa.int32()), pa.array([b"abcde"], pa.binary()), pa.array([quality_model._packed_counts(np.array([c]))], pa.binary())], names=["shard", "grams", "counts"])
    out = next(quality_model._merge(iter([part(2**32 - 1), part(5)])))
    assert quality_model._counts(out.column(2)[0].as_py(), 1).tolist() == [2**32 + 4]


def test_kneser_ney_sums_to_one():
    data, off = C.buffers(pa.array(["abracadabra abba", "cabal bar"]))
    u, c = np.unique(quality_model.grams(data, off), return_counts=True)
    lv = quality_model.levels(u, c)
    p2 = quality_model.bigrams(lv[2][0].astype(np.int64), lv[2][1])
    ds = {k: quality_model.discounts(quality_model._of_counts(lv[k][1])) for k in quality_model.SHARDED}
    for h in (b"abra", b"zzzz", b"\0\0\0a"):
        q = np.array([int.from_bytes(h + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs(np.exp(quality_model.log_probabilities(lv, ds, p2, q)).sum() - 1) < 1e-9


def test_perplexity_tells_junk(spark):
    import random

    r = random.Random(1)
    word = lambda: "".join(r.choice(("the", "an", "er", "ing", "ou")) for _ in range(r.randint(1, 3)))
    good = [" ".join(word() for _ in range(60)) for _ in range(60)]
    junk = ["".join(r.choice("#$%&QXZJ0987") for _ in range(200)) for _ in range(10)]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + junk)], "doc_id long, text string, lang string")
    kept = by_id(quality_model.classify(d, spark.createDataFrame([(i,) for i in range(40)], "doc_id long")), "kept")
    assert all(kept[i][0] for i in range(60)) and not any(kept[i][0] for i in range(60, 70))


def test_threshold_is_the_quantile_of_unseen_documents(spark):
    from weftline.runtime import Scratch

    d = spark.createDataFrame([(i, f"some words of text {i * 7919 % 101} and {'more ' * (i % 5)}of them", "en") for i in range(60)], "doc_id long, text string, lang string")
    ids = d.select("doc_id").where("doc_id < 40")
    unseen = sorted(v[0] for v in by_id(quality_model.held_out(d, ids, Scratch(spark)), "perplexity").values())
    assert len(unseen) == 40
    got = {v[0] for v in by_id(quality_model.classify(d, ids, quantile=0.5), "threshold").values()}
    assert len(got) == 1 and abs(math.log(got.pop() / unseen[19])) < 2e-3


# ---- 4 benchmark decontamination


def edit_search(p, t):
    """Least distance of p to any substring of t, by dynamic programming."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@given(st.binary(min_size=1, max_size=80), st.binary(max_size=120), st.integers(0, 9))
@settings(max_examples=150, deadline=None)
def test_myers(p, t, k):
    best = edit_search(p, t)
    got = decontaminate.myers(p, t, k)
    assert (got[0] if got else None) == (best if best <= k else None)


def test_decontaminate(spark, texts, none):
    import random

    r = random.Random(2)
    items = [" ".join("".join(r.choice("mnopqr") for _ in range(r.randint(2, 6))) for _ in range(n)) for n in (12, 30, 60, 90)] + [None, "", "tiny", "  "]
    planted = []
    for i, t in enumerate(items[:4] * 6):
        b = list(t)
        k = decontaminate.budget(len(t))
        for _ in range(0 if i < 4 else min(k + (i % 3 == 0) * 0, i // 4 * 2)):
            j = r.randrange(len(b))
            b[j : j + 1] = r.choice((["#"], [], [b[j], "!"]))
        planted.append(f"start of it {i} " + "".join(b).upper() + " end\nof it")
    small = [t if t is None or len(t) < 9000 else t[:2000] for t in texts] + planted + ["a tiny thing"]
    d = spark.createDataFrame(rows_of(small), NASTY)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(d, bench).collect()}
    want = {}
    for i, t in enumerate(small):
        if not t or not any(c in t.lower() for c in "mnopqry"):
            continue
        n = decontaminate.normal(t)
        for j, x in enumerate(items):
            if x and (p := decontaminate.normal(x)).strip():
                k = decontaminate.budget(len(p))
                dist = (0 if p in n else edit_search(p, n)) if k else (0 if p in n else 1)
                if dist <= k:
                    want[i, j] = dist
    assert got == want and len(want) > 15
    for r in decontaminate.find_leaks(d, bench).collect():  # the span holds the item within the distance, and touches it at both ends
        p, t = decontaminate.normal(items[r.item_id]).decode(), small[r.doc_id]
        assert 0 <= r.start < r.end <= len(t) and edit_search(p, decontaminate.normal(t[r.start : r.end]).decode()) == r.distance
        assert r.end - r.start <= len(p) + r.distance and r.end - r.start >= len(p) - r.distance
    left = decontaminate.remove_leaks(d, bench)
    assert {r.doc_id for r in left.collect()} == set(range(len(small))) - {i for i, _ in want} and left.columns == d.columns
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(d, bench.limit(0)).count() == 0


# ---- 5 and 8 tokens, packing


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_tokenizers_file(bpe, texts):
    for t in [x or "" for x in texts] + ["<|endoftext|> it's we'll  two   spaces\t\n x 1234 ½ ٣", "a" * 3000]:
        assert tokens.ids_of(t).tolist() == bpe.encode(t, add_special_tokens=False).ids


def test_token_counts(docs, texts, none):
    n = [len(tokens.ids_of(t)) for t in texts]
    h = {r.n_tokens: r.n_docs for r in tokens.length_histogram(docs).collect()}
    assert h == dict(collections.Counter(n))
    rep = {(r.metric, r.at): r.value for r in tokens.context_report(tokens.length_histogram(docs)).collect()}
    assert rep["tokens", 0] == sum(n) and rep["documents", 0] == len(n) and rep["longest", 0] == max(n)
    for x in tokens.LIMITS:
        assert rep["truncated_tokens", x] == sum(min(v, x) for v in n) and rep["longer_docs", x] == sum(v > x for v in n)
    for q in tokens.QUANTILES:
        assert rep["quantile", q] == sorted(n)[math.ceil(len(n) * q) - 1]
    s = {r.n_tokens: (r.docs_from, r.tokens_from) for r in tokens.with_suffix_sums(tokens.length_histogram(docs)).collect()}
    assert all(v == (sum(y >= x for y in n), sum(y for y in n if y >= x)) for x, v in s.items())
    assert {(r.metric, r.value) for r in tokens.context_report(tokens.length_histogram(none)).collect() if r.metric in ("tokens", "longest")} == {("tokens", 0), ("longest", None)}


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
@settings(max_examples=80, deadline=None)
def test_shortest_pack_first(hist):
    pats = packing.shortest_pack_first(hist, 64)
    used = collections.Counter()
    for p, c in pats:
        assert c > 0 and sum(p) <= 64
        for x in p:
            used[x] += c
    assert used == collections.Counter(hist)


def check_packing(rows, texts_by_id, size=1024):
    seqs = collections.defaultdict(list)
    ids = {k: np.array([*tokens.ids_of(t).tolist(), 0], "<u4") for k, t in texts_by_id.items()}
    parts = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.start, r.length))
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for k, x in ids.items():
        at = 0
        for s, n in sorted(parts[k]):
            assert s == at
            at += n
        assert at == len(x)
    for x in seqs.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= size
    assert sorted(seqs) == list(range(len(seqs)))
    return len(seqs)


def test_packing(docs, texts, none):
    n = check_packing(packing.pack(docs).collect(), dict(enumerate(texts)))
    assert n <= math.ceil(sum(len(tokens.ids_of(t)) + 1 for t in texts) / 1024) + 2
    assert check_packing(packing.pack(docs, ranked=3).collect(), dict(enumerate(texts))) == n  # salted ranks
    assert packing.pack(none).count() == 0
    assert struct.pack("<I", 5) == np.array([5], "<u4").tobytes()


def test_packing_of_repeated_and_missing_ids(spark, texts):
    """Rows that share an id or have none keep their own pieces; every piece of every row is there once."""
    ts = [t for t in texts if t is None or len(t) < 9000][:30] + ["w " * 3000] * 3
    rows = [(None if i % 7 == 0 else i % 5, t) for i, t in enumerate(ts)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*tokens.ids_of(t).tolist(), 0], "<u4")
        want.update((i, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)) for s in range(0, len(ids), 1024))
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for x in seqs.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and x[-1][0] + x[-1][1] <= 1024


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_ids_equal_the_tokenizers_file_for_any_text(bpe, t):
    t = t.encode("utf-8", "ignore").decode()
    assert tokens.ids_of(t).tolist() == bpe.encode(t, add_special_tokens=False).ids


def test_token_counts_query(spark, texts, tmp_path):
    """op5_token_counts as registered, against brute force: its truncated totals and quantiles too."""
    short = [t for t in texts if t is None or len(t) < 9000]
    spark.createDataFrame(rows_of(short), NASTY).write.parquet(f"{tmp_path}/documents.parquet")
    n = sorted(len(tokens.ids_of(t)) for t in short)
    got = {r.n_tokens: tuple(r)[1:] for r in tokens.op5_token_counts(spark, str(tmp_path)).collect()}
    assert set(got) == set(n)
    for x, (docs_, from_, tok, cut, q) in got.items():
        assert (docs_, from_, tok, cut) == (n.count(x), sum(v >= x for v in n), sum(v for v in n if v >= x), sum(min(v, x) for v in n))
        assert abs(q - sum(v <= x for v in n) / len(n)) < 1e-12


# ---- 6 PII

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(t):
    out = []
    for k, rx in BASE.items():
        for m in re.finditer(rx, t):
            d = [c for c in m.group() if c in "0123456789"]
            if k == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if k == "card" and not (12 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0):
                continue
            if k == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], list(BASE).index(x[2])))


@given(st.text(alphabet="ab1204589.@+-() _%:é\n", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans(t):
    assert pii.base_spans(t) == brute_pii(t)


def test_base_spans_of_long_runs_are_linear():
    for t in ("a" * 200_000 + "@", "1" * 200_000 + "x", "+1" + " " * 200_000, ("a" * 50 + "@") * 4000, "1." * 100_000):
        pii.base_spans(t)


def test_gradients():
    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in pii.init(3).items()}
    x, y = r.integers(0, pii.N_CLASS, (6, 4)), np.zeros((6, 4), np.int64)
    y[2:4] = r.integers(1, 5, 4)
    _, g = pii.loss_and_gradients(p, x, y)
    for k in ("E", "Uf", "Wb", "e"):
        i = tuple(r.integers(0, s) for s in p[k].shape)
        lo, hi = dict(p), dict(p)
        lo[k], hi[k] = p[k].copy(), p[k].copy()
        lo[k][i] -= 2e-2
        hi[k][i] += 2e-2
        slope = (pii.loss_and_gradients(hi, x, y)[0] - pii.loss_and_gradients(lo, x, y)[0]) / 4e-2
        assert abs(slope - g[k][i]) < 5e-3


@pytest.fixture(scope="module")
def real_docs(spark):
    """Documents of the smallest folder in two halves: for training lines, and held out."""
    ts = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if x.text and 100 < len(x.text) < 5000]
    return ts[::2], ts[1::2]


@pytest.fixture(scope="module")
def model(real_docs):
    return pii.train(*pii.labelled([x for t in real_docs[0] for x in t.split("\n") if len(x) > 20], 6000))


def test_held_out_accuracy(model):
    x, y = pii.labelled([], 400, seed=1234)
    tags = pii.decode(model, x.T).T
    assert (tags == y).mean() > 0.95
    for k in range(1, 1 + len(pii.TAGGED)):
        both, any_ = ((tags == k) & (y == k)).sum(), ((tags == k) | (y == k)).sum()
        assert both / any_ > 0.8


def test_viterbi_is_exact(model):
    r = np.random.default_rng(4)
    x = r.integers(1, pii.N_CLASS, (5, 60))
    tags = pii.decode(model, x)
    hf = pii._lstm(model["Wf"], model["Uf"], x)
    hb = pii._lstm(model["Wb"], model["Ub"], x[::-1])
    em = np.einsum("kh,thb->tkb", model["E"], np.concatenate((hf, hb[::-1]), 1)) + model["e"][None, :, None]
    tr = np.where(pii._ALLOWED, model["T"], -1e9)
    import itertools

    for b in range(60):
        score = lambda s: sum(em[i, k, b] for i, k in enumerate(s)) + sum(tr[a, c] for a, c in zip(s, s[1:]))  # noqa: E731,B023
        best = max(itertools.product(range(1 + len(pii.TAGGED)), repeat=5), key=score)
        assert score(best) - score(tags[:, b]) < 1e-3


def test_windows_agree_with_whole_texts(model, texts):
    t = next(x for x in texts if x and len(x) > 100_000)[:3000] + " mail jo.doe@example.org now " + "word " * 90 + "10.20.30.40 end"
    cls = pii.classes(np.frombuffer(t.encode("latin-1"), np.uint8))
    whole = pii.decode(model, cls[:, None])[:, 0]
    cut = pii.tag(model, cls, np.array([0, len(cls)]))
    assert (whole != cut).mean() < 0.01


def test_find_pii(spark, docs, texts, none, model):
    extra = ["reach me at jo.doe@example.org or 10.0.0.1, +1 (325) 555-8094", "card 4111 1111 1111 1111.", "4539 1488 0343 6467 and 4539-1488-0343-6467", "no data here"]
    all_ = texts + extra
    d = spark.createDataFrame(rows_of(all_), NASTY).repartition(3)
    got = by_id(pii.find_pii(d, model), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for i, t in enumerate(all_):
        b = brute_pii(t or "")
        s = ",".join(f"{k}:{x}:{y}" for x, y, k in b)
        assert got[i][:5] == (*(sum(z[2] == k for z in b) for k in BASE), hashlib.sha256(s.encode()).hexdigest())
        assert set(filter(None, s.split(","))) <= set(got[i][5].split(","))
        for x in filter(None, got[i][5].split(",")):
            k, a, e = x.split(":")
            assert 0 <= int(a) < int(e) <= len(t) and k in pii.TAGGED
    assert pii.find_pii(none, model).count() == 0


def test_the_model_adds_spans(spark, model):
    """What no rule finds, by a query's way; a model that adds nothing fails here."""
    ts = ["ring (325) 555-8094 or 0325 5558094 soon", 'here is token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" now', "mail jo.doe (at) example.org today", "card 4539 1488 0343 6468 ends", "nothing at all is here. dot"]
    d = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    got = by_id(pii.find_pii(d, model), "n_added", "n_spans", "spans", "n_phone")
    assert [got[i][0] for i in range(5)] == [2, 1, 1, 1, 0] and all(v[0] == v[1] and v[3] == 0 for v in got.values())
    kind, a, b = got[2][2].split(":")
    assert got[1][2] == "secret:17:57" and kind == "email" and int(a) <= 5 and int(b) == 28


def test_kept_weights_are_read_again(none, monkeypatch):
    a = pii.learn(none, windows=301, steps=3)
    monkeypatch.setattr(pii, "_models", {})
    monkeypatch.setattr(pii, "train", None)
    b = pii.learn(none, windows=301, steps=3)
    assert a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)


def found(model, text):
    """Added and base spans of one text as (start, end, kind)."""
    b = next(pii._find(model)(iter([pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], names=["doc_id", "text"])])))
    return [(int(a), int(e), k) for k, a, e in (x.split(":") for x in b.column("spans")[0].as_py().split(",") if x)]


@pytest.mark.parametrize("kind", pii.TAGGED)
def test_recall_in_held_out_documents(real_docs, model, kind):
    """Entities that no training line has seen, written into real documents; most are beyond the rules."""
    import random

    r = random.Random(77)
    hit = n = exact = 0
    for t in real_docs[1] * 3:
        _, lead, s, tail = pii._entity(r, kind)
        at = t.find(" ", r.randrange(len(t) // 2)) + 1 or len(t)
        text = t[:at] + lead + s + tail + " " + t[at:]
        lo = at + len(lead)
        got = [x for x in found(model, text) if x[2] == kind and x[0] < lo + len(s) and x[1] > lo]
        n, hit, exact = n + 1, hit + bool(got), exact + any(x[:2] == (lo, lo + len(s)) for x in got)
    assert n > 150 and hit >= 0.9 * n and exact >= 0.85 * n


def test_precision_on_look_alikes(real_docs, model):
    import random

    r = random.Random(78)
    wrong = 0
    for t in real_docs[1] * 3:
        at = t.find(" ", len(t) // 2) + 1 or len(t)
        s = pii._alike(r)
        wrong += any(a < at + len(s) and e > at for a, e, _ in found(model, t[:at] + s + " " + t[at:]))
    assert wrong <= 0.05 * 3 * len(real_docs[1])


def test_windows_without_an_anchor_hold_nothing():
    for t, want in (("no data at all. dot", 0), ("mail x (at) y", 1), ("x at y dot net", 1), ("a@b", 1), ("7", 1), ("[AT]", 1), ("at", 0), ("", 0)):
        assert pii.anchors(pii.classes(np.frombuffer(t.encode(), np.uint8))).sum() == want, t


# ---- 7 n-gram Jaccard join


def brute_jaccard(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(WORD, lower(t or ""))
        sets[i] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()
    link = {i: {j for j in sets if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])} for i in sets}
    comp = {}
    for i in sets:
        if i in comp:
            continue
        todo, seen = [i], {i}
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        for j in seen:
            comp[j] = min(seen)
    return {i: (len(sets[i]), len(link[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("chunk", [2048, 3])
def test_ngram_join(spark, texts, none, chunk):
    small = [t if t is None or len(t) < 9000 else t[:2500] for t in texts]
    d = spark.createDataFrame(rows_of(small), NASTY).repartition(5)
    got = by_id(ngram_join.similar_documents(d, chunk=chunk), "n_shingles", "n_similar", "component_id")
    assert got == brute_jaccard(small)
    if chunk > 3:
        kept = ngram_join.keep_one(d)
        assert {r.doc_id for r in kept.collect()} == {i for i, v in got.items() if v[2] == i} and kept.columns == d.columns
        assert ngram_join.similar_documents(none).count() == 0 and ngram_join.keep_one(none).count() == 0


def test_ngram_join_short_and_chained(spark):
    import random

    r = random.Random(9)
    v = [f"w{i}" for i in range(9)]
    ts = [" ".join(r.choice(v) for _ in range(r.randint(1, 7))) for _ in range(150)]
    long = [f"t{i}" for i in range(200)]
    ts += [" ".join(long[3 * i : 3 * i + 60]) for i in range(40)]
    d = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").repartition(3)
    for chunk in (2048, 4):
        assert by_id(ngram_join.similar_documents(d, chunk=chunk), "n_shingles", "n_similar", "component_id") == brute_jaccard(ts)
    # many buckets scattered twice, blocks cut by shingles
    assert by_id(ngram_join.similar_documents(d, chunk_shingles=150, bucket_bytes=2000, most=5), "n_shingles", "n_similar", "component_id") == brute_jaccard(ts)


def test_pairs_of_a_hot_token_come_in_steps(monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS", 10)
    r = np.random.default_rng(3)
    g = (r.integers(0, 2**50, 40).astype(np.uint64) << np.uint64(6)) | np.uint64(3)
    t = np.concatenate((np.full(40, 5), np.full(7, 9))).astype(np.uint64)
    got = collections.Counter()
    for b in ngram_join._count_pairs(t, np.concatenate((g, g[:7]))):
        assert b.num_rows <= 10
        for x, y, n in zip(*(c.to_pylist() for c in b.columns)):
            got[frozenset((x, y))] += n
    assert len(got) == 40 * 39 // 2 and sum(got.values()) == 40 * 39 // 2 + 21


def test_pairs_are_counted_in_passes_of_bounded_size(spark, monkeypatch):
    import random

    r = random.Random(4)
    v = [f"w{i}" for i in range(25)]
    ts = [" ".join(r.choice(v) for _ in range(r.randint(8, 40))) for _ in range(160)]
    ts += [f"{t} tail" for t in ts[:20]] + ts[:5]
    d = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").repartition(3)
    seen, totals, reach, full = [], [], ngram_join._reach, brute_jaccard(ts)

    def counted(pairs):
        seen.append(pairs.count())
        return reach(pairs)

    monkeypatch.setattr(ngram_join, "_reach", counted)
    for at_once in (None, 1000):
        seen.clear()
        got = ngram_join.similar_documents(d, bucket_bytes=2000, pairs_at_once=at_once)
        assert by_id(got, "n_shingles", "n_similar", "component_id") == full
        totals.append(sum(seen))
    assert len(seen) > 3 and totals[0] == totals[1] and max(seen) < 2 * 1000  # no pair is left out or counted twice


def test_blocks_are_compared_in_passes_of_bounded_size(spark):
    ts = [" ".join(f"t{j}" for j in range(3 * i, 3 * i + 60)) for i in range(40)] + ["some other text"]
    d = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    saved = []

    class Kept(Scratch):
        def save(self, df, name="t", by=()):
            saved.append(name)
            return super().save(df, name, by)

    got = ngram_join.similar_documents(d, Kept(spark), chunk=4, sets_at_once=20_000)
    assert by_id(got, "n_shingles", "n_similar", "component_id") == brute_jaccard(ts)
    assert saved.count("links") > 2


def test_sets_with_equal_hashes_are_told_apart(spark):
    m = spark.createDataFrame([(1, 5, 7, 1, 2), (2, 5, 7, 1, 3), (3, 5, 7, 1, 3), (4, 5, 8, 9, 9)], "doc_id long, n long, g long, s1 long, s2 long")
    s = by_id(ngram_join.tell_apart(m), "s")
    assert s[2] == s[3] and len(set(s.values())) == 3
    assert by_id(ngram_join.tell_apart(m.where("doc_id <> 1")), "s")[4] == (9,)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "q r s t"), (2, "x y z")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, ngram_join.similar_documents(d).collect()))
    assert len(got) == 5 and sum("n_similar=2" in x and "component_id=1)" in x for x in got) == 3
    # rows without an id stay as long as one of them does
    assert ngram_join.keep_one(d).count() == 4 and ngram_join.keep_one(d, broadcast_ids=0).count() == 4


def test_components_in_rounds_equal_one_task(spark):
    from weftline.runtime import Scratch

    r = np.random.default_rng(1)
    e = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(25)]
    d = spark.createDataFrame(e, "a long, b long")
    s = Scratch(spark)
    one = {tuple(x) for x in components.connected_components(d, s).collect()}
    many = {tuple(x) for x in components.connected_components(d, s, small=0).collect()}
    assert one == many and len(one) > 200


# ---- 9 quality rules


def brute_rules(t):
    t = t or ""
    w = re.findall(WORD, t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(WORD, x):
            dup += x in seen
            seen.add(x)
    win = collections.defaultdict(list)
    for k in range(len(w) - 4):
        win[tuple(w[k : k + 5])].append(k)
    rep = len({j for v in win.values() if len(v) > 1 for k in v for j in range(k, k + 5)})
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, rep


def test_quality_rules(docs, texts, none):
    got = by_id(quality_rules.score_documents(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t in enumerate(texts):
        m = brute_rules(t)
        assert got[i][:5] == m
        assert got[i][5] == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        assert not (got[i][5] and got[i][6])
    kept = {r.doc_id for r in quality_rules.filter_documents(docs).collect()}
    assert kept == {i for i, v in got.items() if v[6]} and kept
    assert quality_rules.filter_documents(docs).columns == docs.columns
    assert quality_rules.score_documents(none).count() == 0 and quality_rules.filter_documents(none).count() == 0


@given(st.permutations([r.name for r in quality_rules.RULES]))
@settings(max_examples=20, deadline=None)
def test_order_of_rules_does_not_matter(order):
    ts = ["A LOUD SHOUTING TEXT OF MANY WORDS IN ALL", "fine words that go on and on until the end", "## ## $$ %% && ** || << >> ##", "no no no no no no no no no no no", "stupid idiot moron words in a short text here", "", "ok\nok\nok\nok"]
    data, off = C.buffers(pa.array(ts))
    s = quality_rules.Slice(data, off)
    kept = quality_rules.cascade(s, np.ones(s.n, bool), tuple(order))
    want = ~np.any([r.fails(quality_rules.Slice(data, off)) for r in quality_rules.RULES], axis=0)
    assert kept.tolist() == want.tolist()


def test_toxic_words_are_learnt_from_labels(spark):
    fine = lambda i: " ".join(f"{c}lang {c}{i}" for c in "abcdefghijklmnopqrst")
    bad = lambda i: fine(i) + f" zwärkig zwärkens{'mnop'[i % 4]} Zwärker zwärk{i}"
    rows = [(i, bad(i) if i % 2 else fine(i), "de") for i in range(100)] + [(200, bad(3), None), (201, fine(3) + " zwärkig", "de"), (202, "Zwärk zwärk", "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(90)] + [(None, 1, 1), (95, 0, None)], "doc_id long, quality int, toxic int")
    assert quality_rules.toxic_terms(d, labels) == ("zwärk",)
    assert quality_rules.toxic_terms(d, labels.where("doc_id < 38")) == ()
    got = by_id(quality_rules.score_documents(d, labels=labels), "kept", "rejected_by")
    assert got == {i: (False, "toxic") if i < 200 and i % 2 or i == 200 else (True, None) for i, *_ in rows if i != 202} | {202: (False, "base")}
    assert {r.doc_id for r in quality_rules.filter_documents(d, labels=labels).collect()} == {i for i, v in got.items() if v[0]}
    assert all(v[0] for i, v in by_id(quality_rules.score_documents(d), "kept").items() if i != 202)


# ---- 10 license scans


def brute_base(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    at, labels = [], set()
    for p, label in licenses.BASE:
        p = p.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(spark, texts, none):
    notices = [
        "Licensed under the Apache License, Version 2.0.", "x Licensd under the Apache Licence, Version 2.0", "released under the\nMIT license", "Releasd under the MIT License!", "All rights reserved. All Rights Reserved",
        "CC-BY 4.0 and cc by", "This work is licensed under the GNU General Public License, version 3.", "the MIT institute released a report", "Permission is hereby granted, free of charge, to any persn obtaining a copy of this", "accby", "cc", "by",
        "cc by", "ends with all rights", "reserved starts", "Licensed under CC BY-NC 4.0.", "ünder Ünder licensed under the apache license version 2 0 ñ",
    ]
    all_ = texts + notices
    d = spark.createDataFrame(rows_of(all_), NASTY).coalesce(1)
    rows = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    for i, t in enumerate(all_):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)
        for x in filter(None, r.spans.split(",")):
            label, a, b, k = x.rsplit(":", 3)
            assert 0 <= int(a) < int(b) <= len(t)
    n = len(texts)
    assert [rows[n + k].labels for k in (0, 1, 2, 3, 7, 8, 15)] == ["apache", "apache", "mit", "mit", "", "mit", "cc-by,cc-by-nc"]
    assert all_[n + 16][slice(*map(int, rows[n + 16].spans.split(":")[1:3]))] == "licensed under the apache license version 2 0"
    assert licenses.scan_licenses(none).count() == 0


def test_fuzzy_search_finds_every_edit_within_budget():
    import random

    import regex

    r = random.Random(8)
    s = licenses.Scanner()
    for i, (label, t) in enumerate(licenses.NOTICES):
        for k in range(licenses.budget(len(t)) + 1):
            b = list(t)
            for _ in range(k):
                j = r.randrange(len(b))
                b[j] = r.choice("abcxyz")
            text = "lead in " + "".join(b) + " tail"
            data, off = C.buffers(pa.array([text]))
            got = {x[1] for x in s.fuzzy(data, off, *C.words(data, off, licenses.SEPARATOR))}
            norm = " ".join(re.findall("[a-z0-9]+", text)) + " "
            assert (label in got) or not regex.search(f"(?:{regex.escape(t)}){{e<={licenses.budget(len(t))}}}", norm)


# ---- extra columns stay


def test_unrelated_columns_do_not_matter(docs):
    plain = docs.select("doc_id", "text", "lang", "source")
    a = sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()))
    assert a == sorted(map(tuple, suffix_dedup.remove_repeats(plain).collect()))
    assert docs.where(F.col("text").isNull()).count() == 1
