import re
from difflib import SequenceMatcher

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import text as T


def values(spark, f, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_names_and_addresses(spark):
    assert values(spark, T.business_name, ["Tide & Sons, Inc.", "GROUP Blau GmbH", "Co-op Partners Ltd", None, "  "]) == ["tide sons", "blau", "op", "", ""]
    assert values(spark, T.address, ["12 Main St. Apt 4-B, Bonn", "Unit 7 Quay Road"]) == ["12 main st bonn", "quay road"]
    assert values(spark, T.zip_code, ["Bonn 53113-1234 x", "123456", None]) == ["53113", None, None]
    assert values(spark, T.phone, ["+1 (325) 555-8094", "12-34", None]) == ["3255558094", None, None]
    assert values(spark, T.email, [" Jo@X.org ", "none", None]) == ["jo@x.org", None, None]
    assert values(spark, T.email_domain, ["a@b.c@d", "x"]) == ["b.c@d", None]
    assert values(spark, T.clean_price, ["₹1,299 ", "5"]) == ["1299", "5"]


def test_policy_fields(spark):
    assert values(spark, T.slug, ["Data  Privacy (v2).md", "....", "A.b.md"]) == ["data-privacy-v2", "policy", "a-b"]
    assert values(spark, lambda c: T.title(c, F.lit("f")), ["\n\n## Leave rules\nx", "###\n body", ""]) == ["Leave rules", "body", "f"]
    assert values(spark, T.summary, ["# T\none\n\ntwo", "x" * 500]) == ["one two", "x" * 400]
    assert values(spark, T.category, ["GDPR.md", "Travel.md", "Risk.md", "z.md"]) == ["Data & Privacy", "Finance", "Risk", None]


def python_summary(t, limit=400):
    lines = [x for x in (y.strip(" ") for y in t.split("\n")) if x and x[0] != "#"]
    text, room = [], limit
    for x in lines:
        text.append(x[:room])
        if len(x) > room:
            break
        room -= len(x) + 1
    return " ".join(text).strip(" ")


@given(st.lists(st.text(alphabet="ab# ", max_size=30), max_size=8))
@settings(max_examples=10, deadline=None)
def test_summary_equals_a_loop(spark, ls):
    t = "\n".join(ls)
    assert values(spark, lambda c: T.summary(c, 40), [t]) == [python_summary(t, 40)]


def test_signature_and_tokens(spark):
    assert values(spark, T.signature_name, ["--\n Ana Bo \nCFO", "\nPhone: 1\nTEL: 2\nCy", "--\nemail: x", None]) == ["Ana Bo", "Cy", None, None]
    assert values(spark, T.tokens, ["The emp_0431 IS a B2 x", None]) == [["emp_0431", "b2"], []]


def test_classify(spark):
    xs = ["", "123e4567-e89b-12d3-a456-426614174000", "emp_0431", "a@b.co", "2024-01-31T0", "abcd", "0042", "Hello there", None]
    assert values(spark, T.classify, xs) == ["null", "uuid", "prefixed_id", "email", "date", "short_code", "numeric_string", "string", "null"]
    assert values(spark, T.entity_type, ["x/employees.json", "it_tickets.json", "policies.csv", "bus.csv"]) == ["Employee", "It", "Policy", "Bus"]


def test_labels(spark):
    xs = ["0.85", "0.84", "0.6", "0.59"]
    assert values(spark, lambda c: T.confidence_label(c.cast("double")), xs) == ["high", "medium", "medium", "low"]
    assert values(spark, T.ticket_status, [" ", None, "done"]) == ["open", "open", "resolved"]


@pytest.mark.parametrize("a,b", [("tide", "diet"), ("diet", "tide"), ("", ""), ("a", ""), ("same", "same"), ("x" * 250 + "y", "x" * 240)])
def test_similarity(a, b):
    want = 1.0 if a == b else 0.0 if not a or not b else SequenceMatcher(None, a, b).ratio()
    assert T.similarity.func(pd.Series([a]), pd.Series([b]))[0] == want


def test_tokens_equal_a_regex(spark):
    from weftline.dims import STOP_WORDS

    t = "What is The Überblick of policy_7, x-ray & 42 things?"
    assert values(spark, T.tokens, [t])[0] == [w for w in re.findall("[a-z0-9_]+", t.lower()) if w not in STOP_WORDS and len(w) > 1]


def brute_normal(t):
    t = t or ""
    squeeze = lambda x: re.sub(" +", " ", re.sub("[^a-z0-9 ]", "", x)).strip()
    business = re.sub(r"\b(inc|llc|ltd|gmbh|corp|corporation|co|company|group|holdings?|partners?|associates|sa|ag|plc|pvt|pte|kgaa)\b\.?", "", t.lower())
    address = re.sub(r"\b(apt|suite|ste|unit|box|psc|apartment)\.?\s*[\w-]+", "", t.lower())
    zips = re.search(r"\b([0-9]{5})(-[0-9]{4})?\b", t)
    digits = re.sub("[^0-9]", "", t)
    email = t.lower().strip(" ")
    return squeeze(business), squeeze(address), zips and zips[1], digits[-10:] if len(digits) >= 7 else None, email if "@" in email else None, re.sub(r"[₹, \t\n\r\f\v]", "", t)


def test_whole_texts_are_normalised(spark, tmp_path):
    from weftline.plans import registry

    far = "word " * 40
    ts = [None, "", "Müller & Söhne GmbH", far + "Nord Company, Unit größe-7 é12345 Bonn 53113-1234", "éco coé Co. café", far + "Box\u00a0Ñu 5", "Straße Suite 4ñ\nÜber AG.", far + "Ä 12345é +49 30 1234567 ₹1,299", " Jö@X.org " + far]
    spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: tuple(r)[1:] for r in registry.QUERIES["normalise_whole_text"](spark, str(tmp_path)).collect()}
    assert rows == {i: brute_normal(t) for i, t in enumerate(ts)}


def test_ages_count_parts_of_a_second(spark):
    """59.7 seconds are no minute, though the whole seconds are 60 apart; SQL says the same."""
    rows = [("2024-01-02 00:01:00.2", "2024-01-02 00:00:00.5"), ("2024-01-02 01:00:00", "2024-01-02 00:00:00.000001"), ("2024-01-02 01:00:00", "2024-01-02 00:00:00")]
    d = spark.createDataFrame(rows, "now string, then string").select(*[F.col(c).cast("timestamp").alias(c) for c in ("now", "then")])
    assert [r.a for r in d.select(T.age_label(F.col("now"), F.col("then")).alias("a")).collect()] == ["0m ago", "59m ago", "1h ago"]
