"""Retrieval: TF-IDF postings, graph scores, hybrid ranking, evidence and routing.

A document is a row (node_id, node_type, title, text, relations, degree). The index is stored: postings in
folders by term bucket, with idf and norms beside them, so a query reads the buckets of its few terms and no
text. Documents without a token stay in the index with a norm of 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.dims import STOP_WORDS, TYPE_HINTS
from weftline.functions import text as T
from weftline.runtime import Scratch, ship_package

ROUTES = ("\\bemp(?:-|_)?[0-9]+\\b", "\\b[a-z]+[:]\\S+\\b", "\\bcustomer(?:-|_)?[0-9a-z]+\\b")
MODES = ("auto", "graph", "vector", "hybrid")


def query_terms(query: str) -> list[str]:
    return [t for t in re.findall(r"[a-z0-9_]+", query.lower()) if len(t) > 1 and t not in STOP_WORDS]


def route(query: Column) -> Column:
    """Which mode `auto` picks."""
    q = F.lower(query)
    terms = T.tokens(q)
    cue = F.arrays_overlap(terms, F.array(*[F.lit(w) for w in ("about", "like", "overview", "similar")]))
    by_pattern = F.lit(False)
    for r in ROUTES:
        by_pattern = by_pattern | q.rlike(r)
    return F.when(by_pattern | (F.size(terms) <= 2), "graph").when(F.size(terms) >= 7, "hybrid").when(cue, "vector").otherwise("hybrid")


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, node_id, tf)."""
    t = docs.select("node_id", F.explode(T.tokens(F.col(text))).alias("term"))
    return t.groupBy("term", "node_id").agg(F.count("*").alias("tf"))


_WORD = np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789_"]] = True
#: Bytes of one field that are cut into words at a time; a longer single document is a slice of its own.
SLICE_BYTES = 4 << 20
_FIELDS = ("whole", "text", "relations", "title")
_POSTS = "term string, node_id string, tf long, in_text int, in_relations int, in_title int"


def _words(low: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, row of each) of lower-case texts: what T.tokens finds, stop words included."""
    low = low.cast(pa.string())  # some sessions send large offsets
    off = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    on = _WORD[data]
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    begin = off[:-1][off[:-1] < len(data)]  # a text's first byte begins a word, whatever the one before ends with
    first[begin] = on[begin]
    last[:-1] = on[:-1] & (~on[1:] | first[1:])
    st, en = np.flatnonzero(first), np.flatnonzero(last) + 1
    lone = en - st == 1
    on[st[lone]] = False
    st, size = st[~lone], (en - st)[~lone]
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data[on])]), np.searchsorted(off, st, side="right") - 1


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of each row: how often the whole has a term, and which of the other fields have it."""
    stop = pa.array(STOP_WORDS)
    for b in batches:
        fields = [b.column(b.schema.get_field_index(f)) for f in _FIELDS]
        size = np.cumsum(np.max([pc.binary_length(f).to_numpy(zero_copy_only=False) for f in fields], axis=0)) if b.num_rows else np.zeros(0)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE_BYTES, side="right")))
            own = [f.slice(lo, hi - lo) for f in fields]
            cut = [None if i == 0 and own[0].equals(own[1]) else _words(f) for i, f in enumerate(own)]
            cut[0] = cut[0] or cut[1]
            enc = pa.concat_arrays([c[0] for c in cut]).dictionary_encode()
            key = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (hi - lo) + np.concatenate([c[1] for c in cut])  # a term's postings together
            u, at = np.unique(key, return_inverse=True)
            ends = np.cumsum([0, *(len(c[1]) for c in cut)])
            counts = [np.bincount(at[i:j], minlength=len(u)) for i, j in zip(ends[:-1], ends[1:])]
            keep = ~pc.is_in(enc.dictionary, value_set=stop).to_numpy(zero_copy_only=False)[u // (hi - lo)]
            ids = b.column(b.schema.get_field_index("node_id"))
            yield pa.RecordBatch.from_arrays(
                [enc.dictionary.take(pa.array(u[keep] // (hi - lo))), ids.take(pa.array(lo + u[keep] % (hi - lo))), pa.array(counts[0][keep].astype(np.int64)), *[pa.array((c[keep] > 0).astype(np.int32)) for c in counts[1:]]],
                names=["term", "node_id", "tf", "in_text", "in_relations", "in_title"],
            )
            lo = hi


def idf(posts: DataFrame, n_docs: int) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


def weighted(posts: DataFrame, idfs: DataFrame) -> DataFrame:
    return posts.join(idfs, "term").withColumn("w", (1.0 + F.log(F.col("tf"))) * F.col("idf"))


def norms(docs: DataFrame, w: DataFrame) -> DataFrame:
    n = w.groupBy("node_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return docs.select("node_id").join(n, "node_id", "left").select("node_id", F.coalesce("norm", F.lit(0.0)).alias("norm"))


def query_vector(query: str, idfs: DataFrame) -> DataFrame:
    """(term, qw, qnorm); a term that no document has counts with idf 1, in the norm as well."""
    tf = Counter(query_terms(query))
    spark = idfs.sparkSession
    q = spark.createDataFrame([(t, 1.0 + math.log(n)) for t, n in sorted(tf.items())], "term string, m double")
    own = idfs.where(F.col("term").isin(*tf)).select("term", "idf") if tf else idfs.select("term", "idf").limit(0)
    q = q.join(own, "term", "left").withColumn("qw", F.col("m") * F.coalesce("idf", F.lit(1.0)))
    norm = q.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    return q.select("term", "qw").join(F.broadcast(norm))  # one row


def vector_scores(query: str, w: DataFrame, nrm: DataFrame, idfs: DataFrame) -> DataFrame:
    """(node_id, vector): cosine, where it isn't 0. The query's terms are as many as its words."""
    q = F.broadcast(query_vector(query, idfs))
    terms = sorted(set(query_terms(query)))
    dots = w.where(F.col("term").isin(*terms)) if terms else w.limit(0)
    dots = dots.join(q, "term").groupBy("node_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.first("qnorm").alias("qnorm"))
    return dots.join(nrm.where("norm > 0"), "node_id").where("dot <> 0").select("node_id", (F.col("dot") / (F.col("qnorm") * F.col("norm"))).alias("vector"))


def candidates(docs: DataFrame, posts: DataFrame, query: str, node_type: str | None = None) -> DataFrame:
    """Nodes with a term of the query; all nodes where there are none. The type filter comes after."""
    terms = sorted(set(query_terms(query)))
    hit = posts.where(F.col("term").isin(*terms)).select("node_id").distinct() if terms else posts.select("node_id").limit(0)
    got = docs.join(hit, "node_id", "left_semi") if not hit.isEmpty() else docs
    return got.where(F.lower("node_type") == node_type.lower()) if node_type else got


def graph_scores(docs: DataFrame, query: str) -> DataFrame:
    """(node_id, graph): coverage by text, relations and title, type hints, exact matches and degree; where above 0."""
    terms = sorted(set(query_terms(query)))
    if not terms:
        return docs.select("node_id", F.lit(0.0).alias("graph")).limit(0)
    q = F.array(*[F.lit(t) for t in terms])
    return _graph(docs, query, lambda c: F.size(F.array_intersect(q, T.tokens(F.col(c)))) / float(len(terms)))


def _graph(docs: DataFrame, query: str, cover) -> DataFrame:
    """Graph scores from each field's coverage."""
    low = query.lower()
    hinted = sorted({t for w in set(query_terms(query)) for t in TYPE_HINTS.get(w, ())})
    s = 0.45 * cover("text") + 0.20 * cover("relations") + 0.20 * cover("title")
    s = s + F.when(F.col("node_type").isin(*hinted), 0.20).otherwise(0.0) if hinted else s
    s = s + F.when(F.contains(F.lower("node_id"), F.lit(low)), 0.5).otherwise(0.0) + F.when(F.contains(F.lower("title"), F.lit(low)), 0.35).otherwise(0.0)
    s = s + F.when(F.contains(F.lit(low), F.lower("node_type")), 0.15).otherwise(0.0) + F.least("degree", F.lit(20)) / 100.0
    return docs.select("node_id", s.alias("graph")).where("graph > 0")


def hybrid(graph: DataFrame, vector: DataFrame) -> DataFrame:
    """0.55 graph + 0.45 vector, each divided by its maximum, over all nodes that either names."""
    top = lambda df, c: df.join(F.broadcast(df.agg(F.max(c).alias("_m")))).select("node_id", (F.col(c) / F.when(F.col("_m") == 0, 1.0).otherwise(F.col("_m"))).alias(c))
    j = top(graph, "graph").join(top(vector, "vector"), "node_id", "full_outer")
    return j.select("node_id", (0.55 * F.coalesce("graph", F.lit(0.0)) + 0.45 * F.coalesce("vector", F.lit(0.0))).alias("score"))


def top_k(scores: DataFrame, column: str, k: int) -> DataFrame:
    """The best k (at least one); equal scores in order of node_id."""
    return scores.orderBy(F.desc(column), "node_id").limit(max(k, 1))


def evidence(facts: DataFrame, query: str, most: int = 3) -> DataFrame:
    """(node_id, key, rn): the first properties, in their order, whose first 120 characters contain a term."""
    from weftline.operators.graph import top_per

    terms = sorted(set(query_terms(query)))
    value = F.lower(F.substring("value", 1, 120))
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(value, F.lit(t))
    return top_per(facts.where(hit), "node_id", most, F.col("ord"), F.col("key")).select("node_id", "key", "rn")


def evidence_lines(nodes: DataFrame, facts: DataFrame, relations: DataFrame, query: str, most: int = 5) -> DataFrame:
    """(node_id, evidence) of each node: property hits, or "generated view" where there are none, then up to two relations; five lines in all.

    relations: node_id, rel_type, other_title, way, ord.
    """
    from weftline.operators.graph import top_per

    hits = evidence(facts, query).select("node_id", F.lit(0).alias("s"), F.col("rn").cast("long").alias("n"), F.concat(F.lit("property "), "key").alias("t"))
    view = nodes.select("node_id").join(hits.select("node_id").distinct(), "node_id", "left_anti").select("node_id", F.lit(0).alias("s"), F.lit(0).cast("long").alias("n"), F.lit("generated view").alias("t"))
    rel = top_per(relations, "node_id", 2, F.col("way"), F.col("ord"), F.col("other_title"))
    rel = rel.select("node_id", F.lit(1).alias("s"), F.col("rn").cast("long").alias("n"), F.concat_ws(" ", "rel_type", "other_title").alias("t"))
    rows = hits.unionByName(view).unionByName(rel).join(nodes.select("node_id"), "node_id", "left_semi")
    return rows.groupBy("node_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("s", "n", "t"))), lambda x: x["t"]), 1, most).alias("evidence"))


def stringify(value: Column, kind: Column, most: int = 20, chars: int = 400, item_chars: int = 120) -> Column:
    """A property's JSON text as flat text: lists and objects item by item, the first `most`, each cut, and the whole cut too."""
    items = F.from_json(value, "array<string>")
    pairs = F.from_json(value, "map<string,string>")
    cut = lambda x: F.substring(x, 1, item_chars)
    listed = F.array_join(F.transform(F.slice(items, 1, most), cut), " ")
    named = F.array_join(F.transform(F.slice(F.map_entries(pairs), 1, most), lambda e: F.concat(e["key"], F.lit(" "), cut(e["value"]))), " ")
    return F.when(kind == "list", listed).when(kind == "dict", named).otherwise(F.substring(F.coalesce(value, F.lit("")), 1, chars))


class Index:
    """Postings, idf and norms of a document table, stored in the shared folder; `search` runs any mode.

    A query's terms are literals, so only their buckets are read; graph scores come from the postings too.
    """

    BUCKETS = 64
    #: Terms of more than one document that are broadcast, some 50 bytes each.
    BROADCAST_TERMS = 500_000

    def __init__(self, docs: DataFrame, scratch: Scratch | None = None, whole: Column | None = None):
        scratch = scratch or Scratch(docs.sparkSession)
        if whole is None:
            whole = F.concat_ws(" ", "node_type", "node_id", "title", "text", "relations")
        ship_package(docs.sparkSession)
        low = docs.select("node_id", *[F.lower(F.coalesce(c.cast("string"), F.lit(""))).alias(n) for n, c in zip(_FIELDS, (whole, F.col("text"), F.col("relations"), F.col("title")))])
        posted = lambda d: d.mapInArrow(_posted, _POSTS)
        # a row's postings are complete; only those of ids that several rows have are added up, so no other posting is shuffled
        again = scratch.save(docs.groupBy("node_id").count().where("count > 1").select("node_id"), "repeated")
        if again.isEmpty():
            t = posted(low)
        else:
            some = posted(low.join(again, "node_id", "left_semi")).groupBy("term", "node_id")
            some = some.agg(F.sum("tf").alias("tf"), *[F.max(f"in_{c}").alias(f"in_{c}") for c in ("text", "relations", "title")])
            t = posted(low.join(again, "node_id", "left_anti")).unionByName(some)
        t = t.withColumn("bucket", F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(self.BUCKETS)).cast("int"))
        self.posts = scratch.save(t.sortWithinPartitions("bucket"), "postings", by=("bucket",))
        self.docs = scratch.save(docs.select("node_id", "node_type", "title", "degree"), "documents")
        self.n = self.docs.count()
        self.idf = scratch.save(idf(self.posts.where("tf > 0").select("term", "node_id"), self.n), "idf")
        self.w = self._weighted()
        self.norms = scratch.save(norms(self.docs, self.w), "norms")

    def _weighted(self) -> DataFrame:
        """All postings with their weights. Terms of several documents are broadcast, counted first; the others share one idf. Beyond, idf is joined by shuffle."""
        posts = self.posts.where("tf > 0")
        often = self.idf.where("df > 1").select("term", "idf")
        if often.count() > self.BROADCAST_TERMS:
            return weighted(posts, self.idf)
        once = F.log(F.lit((1.0 + self.n) / 2.0)) + 1.0
        w = posts.join(F.broadcast(often), "term", "left").withColumn("idf", F.coalesce("idf", once))
        return w.withColumn("w", (1.0 + F.log(F.col("tf"))) * F.col("idf"))

    def of_terms(self, terms: list[str]) -> DataFrame:
        """The postings of some terms."""
        where = sorted({zlib.crc32(t.encode()) % self.BUCKETS for t in terms})
        return self.posts.where(F.col("bucket").isin(*where) & F.col("term").isin(*terms)) if terms else self.posts.limit(0)

    def vector(self, query: str) -> DataFrame:
        """(node_id, vector): cosine, where it isn't 0."""
        own = self.of_terms(sorted(set(query_terms(query)))).where("tf > 0")
        return vector_scores(query, weighted(own, self.idf), self.norms, self.idf)

    def graph(self, query: str, docs: DataFrame | None = None) -> DataFrame:
        """graph_scores() of the documents, from their postings."""
        terms = sorted(set(query_terms(query)))
        docs = self.docs if docs is None else docs
        if not terms:
            return docs.select("node_id", F.lit(0.0).alias("graph")).limit(0)
        found = self.of_terms(terms).groupBy("node_id").agg(*[F.sum(f"in_{c}").alias(f"n_{c}") for c in ("text", "relations", "title")])
        d = docs.join(found, "node_id", "left")
        return _graph(d, query, lambda c: F.coalesce(F.col(f"n_{c}"), F.lit(0)) / float(len(terms)))

    def candidates(self, query: str, node_type: str | None = None) -> DataFrame:
        terms = sorted(set(query_terms(query)))
        return candidates(self.docs, self.of_terms(terms).where("tf > 0"), query, node_type)

    def search(self, query: str, mode: str = MODES[-1], k: int = 5, node_type: str | None = None) -> DataFrame:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if mode == "auto":
            mode = self.docs.sparkSession.range(1).select(route(F.lit(query)).alias("m")).first()["m"]
        c = self.candidates(query, node_type)
        g, v = self.graph(query, c), self.vector(query).join(c.select("node_id"), "node_id", "left_semi")
        s = {"graph": g.withColumnRenamed("graph", "score"), "vector": v.withColumnRenamed("vector", "score")}.get(mode)
        return top_k(s if s is not None else hybrid(g, v), "score", k)

    def matched(self, query: str) -> DataFrame:
        """(node_id, matched): the query's terms that each document has, sorted."""
        own = self.of_terms(sorted(set(query_terms(query)))).where("tf > 0")
        return own.groupBy("node_id").agg(F.sort_array(F.collect_set("term")).alias("matched"))
