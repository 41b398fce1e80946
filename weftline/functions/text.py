"""Scalar functions as Column expressions; all stay in the JVM but `similarity`."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weftline.dims import STOP_WORDS

_SUFFIXES = "ag|associates|company|corporation|corp|co|gmbh|group|holdings?|inc|kgaa|llc|ltd|partners?|plc|pte|pvt|sa"
#: Word characters and white space of any script; Java's own classes know only ASCII.
_W, _S = "\\p{L}\\p{N}_", "\\s\\x1c-\\x1f\\x85\\p{Z}"
_UNITS = "apartment|apt|suite|ste|unit|box|psc"
CATEGORIES = (
    ("Data & Privacy", "data|privacy|gdpr"),
    ("Security", "security|password|breach"),
    ("People & HR", "leave|medical|health|harassment|ethics"),
    ("Compliance", "code|compliance|governance"),
    ("Finance", "expense|travel|reimbursement"),
    ("Engineering & IT", "sdlc|software development|asset"),
    ("Communication", "social|acceptable use|aup"),
    ("ESG", "environment|sustainab|ecological"),
    ("Performance", "performance"),
    ("Risk", "risk"),
)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def node_id(node_type: str | Column, key: Column) -> Column:
    """Type:key."""
    t = F.lit(node_type) if isinstance(node_type, str) else node_type
    return F.concat(t, F.lit(":"), key.cast("string"))


def node_key(nid: Column) -> Column:
    """What follows the first colon."""
    return F.substring(nid, F.instr(nid, ":") + 1, F.length(nid))


def clean_price(c: Column) -> Column:
    return F.regexp_replace(c, "[₹,\\s]", "")


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^a-z0-9 ]", ""), " +", " "))


def business_name(c: Column) -> Column:
    """Lower case without legal suffixes, punctuation and double spaces."""
    return _squeeze(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), f"(?<![{_W}])({_SUFFIXES})(?![{_W}])\\.?", ""))


def address(c: Column) -> Column:
    return _squeeze(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), f"(?<![{_W}])({_UNITS})\\.?[{_S}]*[{_W}-]+", ""))


def zip_code(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c.cast("string"), f"(?<![{_W}])([0-9]{{5}})(?:-[0-9]{{4}})?(?![{_W}])", 1))


def phone(c: Column) -> Column:
    d = F.regexp_replace(c.cast("string"), "\\D", "")
    return F.when(F.length(d) >= 7, F.right(d, F.lit(10)))


def email(c: Column) -> Column:
    e = F.trim(F.lower(c.cast("string")))
    return F.when(F.contains(e, F.lit("@")), e)


def email_domain(c: Column) -> Column:
    return F.try_element_at(F.split(email(c), "@", 2), F.lit(2))


@lru_cache(1 << 16)
def ratio(x: str | None, y: str | None) -> float:
    """Sequence-matcher ratio of two texts; a worker keeps the last ones, since the pairs of a block repeat its few names."""
    x, y = x or "", y or ""
    if x == y:
        return 1.0
    return SequenceMatcher(None, x, y).ratio() if x and y else 0.0


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sequence-matcher ratio; the argument order matters, the lesser ordinal goes first. Null counts as empty."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def signature_name(sig: Column) -> Column:
    """First line that is no blank, separator or contact line."""
    lines = F.transform(F.split(sig, "\n"), lambda x: F.trim(x))
    ok = lambda s: (s != "") & (s != "--") & ~F.lower(s).rlike("^(phone|email|tel|mobile|fax):")
    return F.try_element_at(F.filter(lines, ok), F.lit(1))


def slug(name: Column) -> Column:
    base = F.regexp_replace(F.lower(F.regexp_replace(name, "\\.[^.]*$", "")), "[^a-z0-9]+", "-")
    return F.coalesce(blank_to_null(F.regexp_replace(base, "^-+|-+$", "")), F.lit("policy"))


def title(markdown: Column, fallback: Column) -> Column:
    lines = F.transform(F.split(markdown, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^#+", "")))
    return F.coalesce(F.substring(F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1)), 1, 200), fallback)


def summary(markdown: Column, limit: int = 400) -> Column:
    """Lines that are no headings, up to `limit` characters, the last one cut to fit."""
    lines = F.filter(F.transform(F.split(markdown, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        over = a["used"] + F.length(x) > limit
        part = F.when(over, F.substring(x, F.lit(1), F.lit(limit) - a["used"])).otherwise(x)
        return F.when(a["full"], a).otherwise(F.struct((a["used"] + F.length(x) + 1).alias("used"), over.alias("full"), F.concat(a["out"], F.array(part)).alias("out")))

    return F.trim(F.array_join(F.aggregate(lines, start, step)["out"], " "))


def category(name: Column) -> Column:
    n, out = F.lower(name), None
    for label, words in CATEGORIES:
        out = F.when(n.rlike(words), label) if out is None else out.when(n.rlike(words), label)
    return out


def classify(value: Column) -> Column:
    """Kind of a value given as text: null, uuid, prefixed_id, email, date, short_code, numeric_string or string."""
    s = F.trim(value)
    return (
        F.when(value.isNull() | (value == ""), "null")
        .when(s.rlike("^\\p{XDigit}{8}(-\\p{XDigit}{4}){3}-\\p{XDigit}{12}$"), "uuid")
        .when(s.rlike("(?i)^[a-z]+_\\d{3,}$"), "prefixed_id")
        .when(s.rlike("^[^\\s@]+@[^\\s@]+[.][^\\s@]+$"), "email")
        .when(s.rlike("^[0-9]{4}(-[0-9]{2}){2}"), "date")
        .when(s.rlike("^[a-z]{3,8}$"), "short_code")
        .when(s.rlike("^\\d+$"), "numeric_string")
        .otherwise("string")
    )


def entity_type(filename: Column) -> Column:
    """employees.json gives Employee."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract(filename, "([^/]*)$", 1), "\\.[^.]*$", ""), "[_\\-]+", " ")
    first = F.coalesce(blank_to_null(F.regexp_extract(stem, "(\\S+)", 1)), F.lit("Entity"))
    one = F.when(first.rlike("ies$"), F.regexp_replace(first, "ies$", "y")).when(first.rlike("s$") & (F.length(first) > 3), F.regexp_replace(first, "s$", "")).otherwise(first)
    return F.concat(F.upper(F.substring(one, 1, 1)), F.lower(F.substring(one, 2, 1_000)))


def tokens(c: Column) -> Column:
    """Lower-cased words of letters, digits and underscores, without stop words and single characters."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def first_present(*cs: Column) -> Column:
    return F.coalesce(*[blank_to_null(c.cast("string")) for c in cs])


def display_summary(fields: dict[str, Column], limit: int = 80, most: int = 3) -> Column:
    """`name: value` of the first present fields, joined by bars."""
    parts = F.array(*[F.when(v.isNotNull() & (v != ""), F.concat(F.lit(k.replace("_", " ") + ": "), F.substring(v, 1, limit))) for k, v in fields.items()])
    return F.array_join(F.slice(F.array_compact(parts), 1, most), " | ")


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.85, "high").when(c >= 0.6, "medium").otherwise("low")


def ticket_status(resolution: Column) -> Column:
    return F.when(F.trim(F.coalesce(resolution, F.lit(""))) != "", "resolved").otherwise("open")


def age_label(now: Column, then: Column) -> Column:
    """Minutes below an hour, hours below two days, else days; parts of a second count, so whole minutes are those of the exact difference."""
    m = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 60_000_000)
    return F.when(m < 60, F.concat(m, F.lit("m ago"))).when(m < 48 * 60, F.concat(F.floor(m / 60), F.lit("h ago"))).otherwise(F.concat(F.floor(m / 1440), F.lit("d ago")))


def amount(c: Column) -> tuple[Column, Column]:
    """(currency, number) of a text that begins with a currency mark."""
    rx = "^\\s*([€$£¥]|[A-Z]{2,3})\\s*([0-9][0-9,]*(?:\\.[0-9]+)?)"
    return blank_to_null(F.regexp_extract(c, rx, 1)), F.regexp_replace(F.regexp_extract(c, rx, 2), ",", "").try_cast("double")


def link(label: Column, section: Column | str, key: Column) -> Column:
    """Markdown link; the bare label where there is no key."""
    s = F.lit(section) if isinstance(section, str) else section
    return F.when(key.isNotNull() & (key != ""), F.concat(F.lit("["), label, F.lit("](/"), s, F.lit("/"), key, F.lit(")"))).otherwise(label)
