"""Quality rules (9): a short-circuit cascade.

Each rule's cost and rejection rate are estimated on a bounded sample; the rules then run in order of
rejections per second, each only on the documents that all earlier ones let through. A document's
verdict is the conjunction of all rules, so the order changes the cost and never the result: `rejected_by`
names the first rule that fails in the order of `RULES`, found for rejected documents alone.

Where a table of labels is given, a rule against toxic text is learnt from it: of each language at most
`SAMPLE_PER_CLASS` toxic and as many clean documents, those with the least hashes of their ids, are read
whole. Beginnings of words that many toxic documents hold and clean ones use far less often become terms;
a document with at least two, and more than one in a hundred words, is toxic. The terms of all languages
count in every document. A language with fewer than `MIN_TOXIC` toxic or clean documents gives no terms;
without labels only the list of insults decides.

Defined results: null text counts as empty and fails the base rule; documents of any length are read
whole; repeated rows get a verdict each; an empty table gives no rows; other columns are ignored by
`op9` and passed on by `filter_documents`, whatever their names.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import common as C
from weftline.runtime import ship_package, table

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
ALPHA = UPPER.copy()
ALPHA[97:123] = True
ALPHA[0xC3] = True  # lead byte of the accented letters of Latin-1

#: Insults, by language; the rule counts whole words, lower-cased.
INSULTS = {
    "en": "stupid worthless loser scum idiot clown pathetic moron disgusting trash imbecile bastard".split(),
    "de": "dumm wertlos verlierer abschaum idiot trottel erbärmlich ekelhaft müll dummkopf".split(),
    "fr": "stupide minable perdant ordure idiot imbécile pathétique crétin dégoûtant déchet".split(),
    "es": "estúpido inútil perdedor escoria idiota payaso patético imbécil asqueroso basura".split(),
}

#: The sample of labelled documents that toxic terms are learnt from, by language and class.
SAMPLE_PER_CLASS, MIN_TOXIC = 500, 20
#: What makes a term: its length in code points, toxic documents that hold it (number, share), its rate among toxic words against clean ones.
TERM_CHARS, TERM_DOCS, TERM_SHARE, TERM_RATIO = range(4, 13), 10, 0.2, 6


class Slice:
    """Lazily computed views of one slice of documents; what a rule doesn't ask for is never computed."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n = data, off, len(off) - 1
        self._memo: dict[str, object] = {}

    def get(self, name: str, make: Callable[[], object]):
        if name not in self._memo:
            self._memo[name] = make()
        return self._memo[name]

    def take(self, rows: np.ndarray) -> "Slice":
        """The same for some of the rows only."""
        if len(rows) == self.n:
            return self
        lens = np.diff(self.off)
        mask = np.zeros(self.n, bool)
        mask[rows] = True
        return Slice(self.data[np.repeat(mask, lens)], np.concatenate(([0], np.cumsum(lens[rows]))))

    @property
    def words(self):
        return self.get("words", lambda: C.words(self.data, self.off))

    @property
    def rolling(self) -> C.Rolling:
        return self.get("rolling", lambda: C.Rolling(self.data))

    @property
    def word_hash(self) -> np.ndarray:
        st, en, _ = self.words
        return self.get("word_hash", lambda: self.rolling(st, en))

    @property
    def n_words(self) -> np.ndarray:
        return self.get("n_words", lambda: C.per_row(self.words[2], self.n))

    def count(self, bytes_: np.ndarray) -> np.ndarray:
        """How many of the bytes marked in a 256-entry table each row has."""
        c = np.concatenate(([0], np.cumsum(bytes_[self.data])))
        return c[self.off[1:]] - c[self.off[:-1]]

    @property
    def n_chars(self) -> np.ndarray:
        return self.get("n_chars", lambda: np.diff(C.code_points(self.data)[self.off]))


def word_chars(s: Slice) -> np.ndarray:
    st, en, row = s.words
    c = C.code_points(s.data)
    return C.per_row(row, s.n, c[en] - c[st])


def n_symbols(s: Slice) -> np.ndarray:
    return s.count(SYMBOLS)


def n_dup_lines(s: Slice) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same document."""
    nl = s.data == 10
    st = np.unique(np.concatenate((s.off[:-1], np.flatnonzero(nl) + 1)))  # a row may begin right after the last one's newline
    row = np.searchsorted(s.off, st, side="right") - 1
    # a line that would begin at a row's end belongs to no row; an empty row has an empty line
    keep = st <= len(s.data)
    st, row = st[keep], row[keep]
    nxt = np.concatenate((np.flatnonzero(nl), [len(s.data)]))
    en = nxt[np.searchsorted(nxt, st)]
    en = np.minimum(en, s.off[np.minimum(row + 1, s.n)])
    c = np.concatenate(([0], np.cumsum(~C.WS[s.data])))
    some = (c[en] - c[st]) > 0
    st, en, row = st[some], en[some], row[some]
    if not len(st):
        return np.zeros(s.n, np.int64)
    h = s.rolling(st, en)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    again = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    return C.per_row(row[1:][again], s.n)


def n_repeat_words(s: Slice, window: int = 5) -> np.ndarray:
    """Words inside a window of five words that the document has at least twice; the first counts too."""
    _, _, row = s.words
    m = len(row)
    if m < window:
        return np.zeros(s.n, np.int64)
    h = np.zeros(m - window + 1, C.U)
    w = s.word_hash
    for k in range(window):
        h = h * C.U(0xC2B2AE3D27D4EB4F) + w[k : m - window + 1 + k]
    h = C.mix(h + row[: len(h)].astype(C.U) * C.U(0x165667B19E3779F9))
    inside = row[: len(h)] == row[window - 1 :]
    at = np.flatnonzero(inside)
    order = np.argsort(h[at], kind="stable")
    sh = h[at][order]
    same = np.zeros(len(sh), bool)
    eq = sh[1:] == sh[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    cover = np.zeros(m + 1, np.int64)
    p = at[order[same]]
    np.add.at(cover, p, 1)
    np.add.at(cover, p + window, -1)
    return C.per_row(row[np.cumsum(cover[:-1]) > 0], s.n)


def base(s: Slice) -> dict[str, np.ndarray]:
    return {
        "n_words": s.n_words,
        "word_chars": word_chars(s),
        "n_symbols": n_symbols(s),
        "n_dup_lines": n_dup_lines(s),
        "n_repeat_words": n_repeat_words(s),
    }


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def _mean_word(s: Slice) -> np.ndarray:
    wc = word_chars(s)
    return (wc > 25 * s.n_words) | (wc < 2 * s.n_words)


def _symbols(s: Slice) -> np.ndarray:
    return 10 * n_symbols(s) > s.n_words


def _shouting(s: Slice) -> np.ndarray:
    return 2 * s.count(UPPER) > s.count(ALPHA)


def _bangs(s: Slice) -> np.ndarray:
    t = np.zeros(256, bool)
    t[33] = True
    return 5 * s.count(t) > s.n_words


def _adjacent(s: Slice) -> np.ndarray:
    """A fifth of the words equal the word before."""
    _, _, row = s.words
    w = s.word_hash
    same = (w[1:] == w[:-1]) & (row[1:] == row[:-1])
    return 5 * C.per_row(row[1:][same], s.n) > s.n_words


def _dup_lines(s: Slice) -> np.ndarray:
    lines = s.count(np.arange(256) == 10) + 1
    return 10 * n_dup_lines(s) > 3 * lines


_insults: dict[tuple, np.ndarray] = {}


def _insult_hashes(lexicon: tuple[str, ...]) -> np.ndarray:
    if lexicon not in _insults:
        data, off = C.buffers(pa.array(sorted(set(lexicon))))
        _insults[lexicon] = np.sort(C.Rolling(data)(off[:-1], off[1:]))
    return _insults[lexicon]


_LETTER = np.ones(256, bool)
_LETTER[:128] = False
_LETTER[97:123] = True
ALL_INSULTS = tuple(sorted({w for ws in INSULTS.values() for w in ws}))


def _abusive(s: Slice) -> np.ndarray:
    """At least two insults and more than one in two hundred words."""
    low = C.LOWER[s.data]
    st, en, row = C.words(low, s.off, ~_LETTER)
    lens = en - st
    some = (lens >= 4) & (lens <= 12)
    st, en, row = st[some], en[some], row[some]
    known = _insult_hashes(ALL_INSULTS)
    h = C.Rolling(low)(st, en)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    n = C.per_row(row[known[at] == h], s.n)
    return (n >= 2) & (200 * n > s.n_words)


def _toxic(terms: tuple[str, ...], s: Slice) -> np.ndarray:
    """At least two words that begin with a term, and more than one in a hundred."""
    low = C.LOWER[s.data]
    st, en, row = C.words(low, s.off, ~_LETTER)
    roll, hit = C.Rolling(low), np.zeros(len(st), bool)
    by: dict[int, list[str]] = {}
    for t in terms:
        by.setdefault(len(t.encode()), []).append(t)
    for size, ts in by.items():
        known = _insult_hashes(tuple(ts))
        at = np.flatnonzero((en - st >= size) & ~hit)
        h = roll(st[at], st[at] + size)
        hit[at] = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    n = C.per_row(row[hit], s.n)
    return (n >= 2) & (100 * n > s.n_words)


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Slice], np.ndarray]


#: The rules that decide about what the base lets through.
RULES = (
    Rule("mean_word", _mean_word),
    Rule("symbols", _symbols),
    Rule("shouting", _shouting),
    Rule("bangs", _bangs),
    Rule("adjacent", _adjacent),
    Rule("dup_lines", _dup_lines),
    Rule("abusive", _abusive),
)


_LETTERS = re.compile("[a-z\u0080-\U0010ffff]+")
_UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, toxic, piece, words, docs): word beginnings of sampled documents; the empty one stands for every word."""
    for b in batches:
        words, docs = Counter(), Counter()
        for lang, toxic, text in zip(*(C.column(b, c).to_pylist() for c in ("lang", "toxic", "text"))):
            ws = _LETTERS.findall((text or "").translate(_UPPER))
            own = Counter(w[:n] for w in ws for n in TERM_CHARS if len(w) >= n)
            own[""] = len(ws)
            for p, n in own.items():
                words[lang, toxic, p] += n
                docs[lang, toxic, p] += 1
        cols = list(zip(*words)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string()), pa.array(words.values(), pa.int64()), pa.array(docs.values(), pa.int64())], names=["lang", "toxic", "piece", "words", "docs"]
        )


def select_terms(pieces: dict[str, tuple[int, int, int, int]]) -> set[str]:
    """Terms of one language from (toxic words, toxic documents, clean words, clean documents) by beginning; "" holds the totals."""
    tw, td, cw, cd = pieces.get("", (0, 0, 0, 0))
    if td < MIN_TOXIC or cd < MIN_TOXIC:
        return set()
    good = {p for p, (a, n, b, _) in pieces.items() if p and n >= TERM_DOCS and n >= TERM_SHARE * td and a * (cw + 1) >= TERM_RATIO * (b + 1) * tw}
    # the longest of those that begin as many toxic words, then the shortest of those that remain
    longest = {p for p in good if not any(q != p and q.startswith(p) and pieces[q][0] == pieces[p][0] for q in good)}
    return {p for p in longest if not any(p[:n] in longest for n in range(TERM_CHARS[0], len(p)))}


def toxic_terms(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[str, ...]:
    """The terms of all languages, from a bounded sample of the labelled documents."""
    ship_package(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("\0null")).alias("lang"), F.col("text").cast("string").alias("text"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).alias("toxic"))
    rank = F.row_number().over(Window.partitionBy("lang", "toxic").orderBy(F.xxhash64("id"), "id"))
    chosen = d.select("id", "lang").distinct().join(known, "id").withColumn("rank", rank).where(F.col("rank") <= per_class)
    # at most per_class rows for each language and class
    texts = d.join(F.broadcast(chosen.select("id", "lang", "toxic")), ["id", "lang"]).select("lang", "toxic", "text")
    got = texts.mapInArrow(_beginnings, "lang string, toxic boolean, piece string, words long, docs long").groupBy("lang", "piece")
    of = lambda c, k: F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col(c))), F.lit(0)).alias(f"{c}{int(k)}")
    got = got.agg(of("words", True), of("docs", True), of("words", False), of("docs", False)).where((F.col("docs1") >= TERM_DOCS) | (F.col("piece") == ""))
    langs: dict[str, dict] = {}
    for lang, piece, *n in got.collect():
        langs.setdefault(lang, {})[piece] = tuple(n)
    return tuple(sorted(set().union(*map(select_terms, langs.values()))))


def rules_for(docs: DataFrame, labels: DataFrame | None) -> tuple[Rule, ...]:
    """The fixed rules, and the one learnt from labels if they give any terms."""
    terms = toxic_terms(docs, labels) if labels is not None else ()
    return RULES + ((Rule("toxic", partial(_toxic, terms)),) if terms else ())


def estimate_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_docs: int = 400) -> list[tuple[str, float, float]]:
    """(rule, seconds per document, rejected share), best first, from at most sample_docs documents.

    The sample only steers the order of evaluation; its bound is `sample_docs`. One-off costs that
    several rules share are charged to the first rule of the sample run that needs them, which is what
    the cascade pays as well.
    """
    texts = [r[0] for r in docs.select("text").limit(sample_docs).collect()]
    data, off = C.buffers(pa.array(texts, pa.string()))
    out = []
    for r in rules:
        s = Slice(data, off)
        r.fails(s) if len(texts) else None  # tables are made before the clock runs
        s, t = Slice(data, off), time.perf_counter()
        share = float(np.mean(r.fails(s))) if len(texts) else 0.0
        cost = (time.perf_counter() - t) / max(1, len(texts))
        out.append((r.name, max(cost, 1e-9), share))
    return sorted(out, key=lambda x: (-(x[2] + 1e-6) / x[1], x[0]))


def cascade(s: Slice, alive: np.ndarray, order: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> np.ndarray:
    """Which rows all rules let through, starting from the rows in `alive`."""
    by = {r.name: r for r in rules}
    kept = alive.copy()
    rows = np.flatnonzero(alive)
    part = s.take(rows)
    for name in order:
        if not len(rows):
            break
        bad = by[name].fails(part)
        kept[rows[bad]] = False
        if bad.mean() > 0.1:  # a new, smaller slice pays once enough rows are gone
            rows, part = rows[~bad], part.take(np.flatnonzero(~bad))
    return kept


def reasons(s: Slice, rejected: np.ndarray, rules: tuple[Rule, ...] = RULES) -> np.ndarray:
    """Of the rejected rows the first rule, in the order of `rules`, that fails; -1 for the others. The cascade's order plays no part."""
    why = np.full(s.n, -1, np.int32)
    rows = np.flatnonzero(rejected)
    if len(rows):
        part = s.take(rows)
        for i, rule in reversed(list(enumerate(rules))):
            why[rows[rule.fails(part)]] = i
    return why


def _verdicts(order: tuple[str, ...], rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in C.slices(batches):
            s = Slice(data, off)
            m = base(s)
            failed = base_failed(m)
            kept = cascade(s, ~failed, order, rules)
            why = reasons(s, ~failed & ~kept, rules)
            names = [rules[i].name if i >= 0 else ("base" if f else None) for i, f in zip(why, failed)]
            yield pa.RecordBatch.from_arrays(
                [C.column(rows, "doc_id"), *(pa.array(m[k].astype(np.int64)) for k in m), pa.array(failed), pa.array(kept), pa.array(names, pa.string())],
                names=["doc_id", *m, "base_failed", "kept", "rejected_by"],
            )

    return run


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def score_documents(docs: DataFrame, sample_docs: int = 400, labels: DataFrame | None = None) -> DataFrame:
    """Base figures, verdict and deciding rule of every document."""
    ship_package(docs.sparkSession)
    rules = rules_for(docs, labels)
    order = tuple(n for n, _, _ in estimate_order(docs, rules, sample_docs))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_verdicts(order, rules), SCHEMA)


def _keep(order: tuple[str, ...], rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in C.slices(batches):
            s = Slice(data, off)
            # what is cheap and decisive comes first here as well
            short = s.n_words < 10
            part = s.take(alive := np.flatnonzero(~short))
            ok = np.zeros(s.n, bool)
            ok[alive] = 100 * n_repeat_words(part) <= 20 * part.n_words
            kept = cascade(s, ok, order, rules)
            yield rows.filter(pa.array(kept))

    return run


def filter_documents(docs: DataFrame, sample_docs: int = 400, labels: DataFrame | None = None) -> DataFrame:
    """The documents that all rules let through, with all their columns."""
    ship_package(docs.sparkSession)
    rules = rules_for(docs, labels)
    order = tuple(n for n, _, _ in estimate_order(docs, rules, sample_docs))
    return docs.mapInArrow(_keep(order, rules), docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9_quality_rules says about the base figures, for comparison with SQL."""
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_BASE_SQL = """
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
win AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 4)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(5) r(k) GROUP BY 1),
m AS (SELECT rid, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM w)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed FROM m LEFT JOIN rep USING (rid)
"""
