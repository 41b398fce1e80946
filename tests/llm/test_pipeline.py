"""The pipeline against the stages' brute-force versions on a small folder of tables."""

import collections
import re

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_jaccard, brute_lines, check_packing
from tests.llm.conftest import NASTY, rows_of
from tests.oracle import same
from weftline.llm import decontaminate, quality_rules, registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    return d


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    cols = docs.columns
    bench = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    verdict = {r.doc_id: r.kept for r in quality_rules.score_documents(docs).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    cur = {i: (r.text, r.source) for i, r in rows.items()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name == "quality rules":
            cur = {i: v for i, v in cur.items() if verdict[i]}
        elif name == "line dedup":
            new = {i: t for i, _, _, t in brute_lines([(i, t, s) for i, (t, s) in cur.items()])}
            cur = {i: (new[i], s) for i, (_, s) in cur.items()}
        elif name == "n-gram Jaccard join":
            ids = sorted(cur)
            comp = brute_jaccard([cur[i][0] for i in ids])
            cur = {i: cur[i] for k, i in enumerate(ids) if comp[k][2] == k}
        elif name == "decontamination":
            finder = decontaminate.Items([(k, b) for k, b in enumerate(bench)])
            bad = {i for i, (t, _) in cur.items() if any(decontaminate.occurrence(b, decontaminate.normal(t), k) for b, k in zip(bench, finder.budgets))}
            cur = {i: v for i, v in cur.items() if i not in bad}
        else:
            check_packing(out.collect(), {i: t for i, (t, _) in cur.items()})
            continue
        assert out.columns == cols and {r.doc_id: (r.text, r.source) for r in out.collect()} == cur
        out.write.mode("overwrite").parquet(f"{folder}/out_{re.sub('[^a-z]', '', name)}")
        docs = spark.read.parquet(f"{folder}/out_{re.sub('[^a-z]', '', name)}")
    whole = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == set(cur) and 0 < len(cur) < len(rows)


def test_long_lines_are_boilerplate(spark):
    long = "we use cookies to make this page work and " * 12
    d = spark.createDataFrame([(i, f"own words of page {i} " * 40 + "\n" + long, "en", f"site{i}", 0) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, d, "").collect()}
    assert out == {i: (t := f"own words of page {i} " * 40, len(t)) for i in range(8)}


def test_boilerplate_goes_whatever_its_share(spark):
    d = spark.createDataFrame([(i, "a banner on every page\n" * 3 + f"page {i}", "en", f"site{i}", 0) for i in range(8)] + [(8, "a banner on every page", "en", "site8", 22)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, d, "").collect()}
    assert out == {i: (f"page {i}", 6) for i in range(8)} | {8: ("", 0)}


def test_nulls_repeated_rows_and_clashing_columns(spark, tmp_path):
    """Null and empty texts, null ids, languages and sources, copies, and columns named as the operators name theirs."""
    import random

    r = random.Random(11)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))
    ts = [text(40) for _ in range(12)]
    item = text(30)
    texts = [None, "", " \n\n", "too short", ts[0], ts[0], *ts[1:], ts[3] + " end", f"{text(15)} {item} {text(10)}", text(20_000), "same line\n" * 50, *(f"banner of all sites\n{text(30)}" for _ in range(9))]
    rows = rows_of(texts, ids=[None if i == 8 else 3 if i in (5, 6) else i for i in range(len(texts))], sources=[None if i == 0 else f"s{i}" for i in range(len(texts))])
    spark.createDataFrame(rows, NASTY).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cols, left = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == cols, name
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        left.append(sorted(x.text for x in docs.collect()))
    good = [t for t in texts if t and len(t.split()) >= 10 and not t.startswith("same line")]
    assert left[0] == sorted(good)
    cut = sorted(t.removeprefix("banner of all sites\n") for t in good)
    assert left[1] == cut
    # of the two equal texts one stays, and of the near copies too
    assert left[2] == sorted(set(cut) - {ts[3] + " end"}) or left[2] == sorted(set(cut) - {ts[3]})
    assert left[3] == [t for t in left[2] if item not in t] and len(left[3]) == len(left[2]) - 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(x.start == 0 for x in got) == len(left[3]) and {x.offset for x in got if x.length == 1024} <= {0}


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, "/root/testdata/sf0.001", registry.QUERIES[name], registry.ORACLES[name])


def test_registered_names():
    n = collections.Counter(int(m[1]) for q in registry.QUERIES if (m := re.match(r"op(\d+)_", q)))
    assert n == {k: 1 for k in range(1, 11)}
