"""From source records to nodes, facts and edges.

Each ingester takes a table of records and gives Batch(nodes, facts, edges): facts are (node_id, key,
value, ord), edges are guarded against missing ends by the pipeline. Which values count as empty differs
by source and is kept that way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import dims
from weftline.functions import text as T
from weftline.operators.decisions import signature_mismatch
from weftline.operators.graph import ContextGraph, guarded, last_wins


@dataclass
class Batch:
    nodes: DataFrame
    facts: DataFrame
    edges: DataFrame | None = None


def _ordinal(df: DataFrame) -> DataFrame:
    return df if "ord" in df.columns else df.withColumn("ord", F.monotonically_increasing_id())


def facts_of(df: DataFrame, node: Column, fields: dict[str, Column], falsy: bool = True) -> DataFrame:
    """One row per property; `falsy` drops "", the number 0 and the boolean false like null, else only "" goes. Texts are kept, "0" and "false" too."""
    kinds = dict(df.select(*[v.alias(f"_{i}") for i, v in enumerate(fields.values())]).dtypes)

    def text(i: int, v: Column) -> Column:
        kind = kinds[f"_{i}"]
        if falsy and kind == "boolean":
            return F.when(v, v.cast("string"))
        if falsy and (kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")):
            return F.when(v != 0, v.cast("string"))
        return v.cast("string")

    cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("key"), text(i, v).alias("value")) for i, (k, v) in enumerate(fields.items())])
    f = df.select(node.alias("node_id"), "ord", F.explode(cells).alias("c")).select("node_id", "ord", "c.pos", "c.key", "c.value")
    return f.where(F.col("value").isNotNull() & (F.col("value") != ""))


def _nodes(df: DataFrame, node: Column, kind: str, title: Column) -> DataFrame:
    return df.select(node.alias("node_id"), F.lit(kind).alias("node_type"), "ord", F.coalesce(title, node).alias("title"), F.lower(F.coalesce(title, F.lit(""))).alias("text"))


def _edges(df: DataFrame, src: Column, dst: Column, rel: str) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel_type"), "ord").where("src is not null and dst is not null")


def _union(*xs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, xs)


def employees(df: DataFrame) -> Batch:
    """Employees and their departments; only "" counts as empty."""
    df = _ordinal(df)
    nid = T.node_id("Employee", F.trim("emp_id"))
    rest = {c.lower().replace(" ", "_"): F.trim(F.col(f"`{c}`").cast("string")) for c in df.columns if c not in ("emp_id", "category", "ord", "Name")}
    fields = {"name": F.trim("Name"), "department": F.trim("category"), **rest}
    dept = df.where(F.trim("category") != "").groupBy(F.trim("category").alias("d")).agg(F.min("ord").alias("ord"))
    did = T.node_id("Department", F.col("d"))
    nodes = _union(_nodes(df, nid, "Employee", F.trim("Name")), _nodes(dept, did, "Department", F.col("d")))
    return Batch(nodes, _union(facts_of(df, nid, fields, falsy=False), facts_of(dept, did, {"name": F.col("d")})), _edges(df, nid, T.node_id("Department", T.blank_to_null(F.trim("category"))), "works_in"))


def enrich_resumes(facts: DataFrame, resumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with résumés, (matched, unmatched)): resume_text overwrites, cv_* only where absent; no conflict logic."""
    r = resumes.withColumn("node_id", T.node_id("Employee", F.trim("emp_id")))
    known = facts.select("node_id").distinct()
    hit = r.join(known, "node_id", "left_semi")
    fields = {"resume_text": F.coalesce(*[F.col(c) for c in ("Resume", "resume") if c in r.columns])}
    fields |= {f"cv_{c}": F.col(f"`{c}`") for c in r.columns if c not in ("emp_id", "Resume", "resume", "node_id", "ord")}
    new = facts_of(_ordinal(hit), F.col("node_id"), fields)
    if "source_system" in facts.columns:
        new = new.withColumn("source_system", F.lit(dims.HR))
    kept = facts.join(new.where("key = 'resume_text'").select("node_id", "key"), ["node_id", "key"], "left_anti")
    new = new.where("key = 'resume_text'").unionByName(new.where("key <> 'resume_text'").join(facts.select("node_id", "key"), ["node_id", "key"], "left_anti"))
    counts = r.join(known.withColumn("k", F.lit(1)), "node_id", "left").agg(F.count("k").alias("matched"), (F.count("*") - F.count("k")).alias("unmatched"))
    return kept.unionByName(new), counts


def customers(df: DataFrame) -> Batch:
    df = _ordinal(df)
    nid = T.node_id("Customer", F.trim("customer_id"))
    fields = {"name": F.trim("customer_name"), "invoice_path": F.col("invoice_paths"), "purchase_order_path": F.col("purchase_order_paths"), "shipping_order_path": F.col("shipping_order_paths")}
    return Batch(_nodes(df, nid, "Customer", F.trim("customer_name")), facts_of(df, nid, fields))


def products(df: DataFrame) -> Batch:
    df = _ordinal(df)
    nid = T.node_id("Product", F.trim("product_id"))
    cats = F.to_json(F.filter(F.transform(F.split("category", "\\|"), lambda x: F.trim(x)), lambda x: x != ""))
    fields = {"name": F.trim("product_name"), "category_hierarchy": cats, "discounted_price": T.clean_price(F.col("discounted_price")), "actual_price": T.clean_price(F.col("actual_price")), "rating": F.col("rating"), "about": F.col("about_product")}
    return Batch(_nodes(df, nid, "Product", F.trim("product_name")), facts_of(df, nid, fields))


def sales(df: DataFrame) -> Batch:
    df = _ordinal(df)
    nid = T.node_id("Sale", F.col("sales_record_id"))
    fields = {"product_id": F.col("product_id"), "customer_id": F.col("customer_id"), "discounted_price": T.clean_price(F.col("discounted_price")), "actual_price": T.clean_price(F.col("actual_price")), "discount_percentage": F.col("discount_percentage"), "date_of_purchase": F.col("Date_of_Purchase")}
    bought = _edges(df, T.node_id("Customer", F.col("customer_id")), nid, "purchased")
    return Batch(_nodes(df, nid, "Sale", F.col("sales_record_id").cast("string")), facts_of(df, nid, fields), bought.unionByName(_edges(df, nid, T.node_id("Product", F.col("product_id")), "product_in_sale")))


def clients(df: DataFrame) -> Batch:
    df = _ordinal(df)
    nid = T.node_id("Client", F.trim(F.col("client_id").cast("string")))
    fields = {c: F.trim(F.col(c).cast("string")) for c in df.columns if c not in ("client_id", "ord")}
    rep = F.trim("business_representative_employee")
    return Batch(_nodes(df, nid, "Client", F.trim("business_name")), facts_of(df, nid, fields), _edges(df, T.node_id("Employee", rep), nid, "represents_client"))


def vendors(df: DataFrame) -> Batch:
    """Any columns: lower-cased with underscores; the key is vendor_id, id, vendor_name or the ordinal."""
    df = _ordinal(df)
    low = {c: c.lower().replace(" ", "_") for c in df.columns if c != "ord"}
    by = {v: F.col(f"`{k}`").cast("string") for k, v in low.items()}
    key = F.coalesce(*[T.blank_to_null(by[k]) for k in ("vendor_id", "id", "vendor_name") if k in by], F.concat(F.lit("vendor_"), F.col("ord").cast("string")))
    nid = T.node_id("Vendor", key)
    return Batch(_nodes(df, nid, "Vendor", by.get("vendor_name", key)), facts_of(df, nid, {k: F.trim(v) for k, v in by.items()}))


def emails(df: DataFrame) -> Batch:
    """Emails, the first subject of each thread, and three kinds of edges; null and "" are dropped."""
    df = _ordinal(df)
    nid, tid = T.node_id("Email", F.col("email_id")), T.node_id("EmailThread", F.col("thread_id"))
    off = signature_mismatch(F.col("sender_name"), F.col("signature"))
    fields = {c: F.col(c) for c in df.columns if c not in ("email_id", "ord")} | {"_signature_mismatch": F.when(off, "true")}
    t = df.where("thread_id is not null").groupBy("thread_id").agg(F.min(F.struct("ord", "subject")).alias("_b")).select("thread_id", F.col("_b.ord").alias("ord"), F.col("_b.subject").alias("subject"))
    nodes = _union(_nodes(df, nid, "Email", F.col("subject")), _nodes(t, tid, "EmailThread", F.col("subject")))
    edges = _union(_edges(df, nid, tid, "part_of_thread"), _edges(df, T.node_id("Employee", F.col("sender_emp_id")), nid, "sent_email"), _edges(df, T.node_id("Employee", F.col("recipient_emp_id")), nid, "received_email"))
    return Batch(nodes, _union(facts_of(df, nid, fields, falsy=False), facts_of(t, tid, {"subject": F.col("subject")})), edges)


def chats(df: DataFrame, limit: int = 200) -> Batch:
    df = _ordinal(df)
    nid = T.node_id("Conversation", F.col("conversation_id"))
    short = F.when(F.length("text") > limit, F.concat(F.substring("text", 1, limit), F.lit("..."))).otherwise(F.col("text"))
    fields = {"date": F.col("date"), "text": F.col("text"), "summary": short, "sender_emp_id": F.col("sender_emp_id"), "recipient_emp_id": F.col("recipient_emp_id")}
    # the recipient's edge is written second, so it stays where both are one person
    edges = _edges(df, T.node_id("Employee", F.col("sender_emp_id")), nid, "chatted_in").withColumn("role", F.lit("sender"))
    edges = edges.unionByName(_edges(df, T.node_id("Employee", F.col("recipient_emp_id")), nid, "chatted_in").withColumn("role", F.lit("zrecipient")))
    best = edges.groupBy("src", "dst", "rel_type").agg(F.max(F.struct("ord", "role")).alias("_b"))
    edges = best.select("src", "dst", "rel_type", F.col("_b.ord").alias("ord"), F.ltrim(F.col("_b.role"), F.lit("z")).alias("role"))
    return Batch(_nodes(df, nid, "Conversation", short), facts_of(df, nid, fields), edges)


def tickets(df: DataFrame) -> Batch:
    df = _ordinal(df)
    nid = T.node_id("ITTicket", F.col("id"))
    fields = {"priority": F.col("priority"), "assigned_date": F.col("assigned_date"), "issue": F.col("Issue"), "resolution": F.col("Resolution"), "raised_by": F.col("raised_by_emp_id"), "assigned_to": F.col("emp_id"), "status": T.ticket_status(F.col("Resolution"))}
    return Batch(_nodes(df, nid, "ITTicket", F.col("Issue")), facts_of(df, nid, fields), _edges(df, T.node_id("Employee", F.col("raised_by_emp_id")), nid, "raised_ticket").unionByName(_edges(df, T.node_id("Employee", F.col("emp_id")), nid, "assigned_ticket")))


def policies(df: DataFrame) -> Batch:
    """Markdown files (file, text)."""
    df = _ordinal(df)
    nid = T.node_id("Policy", T.slug(F.col("file")))
    head = T.title(F.col("text"), F.col("file"))
    fields = {"title": head, "category": T.category(F.col("file")), "summary": T.summary(F.col("text")), "content": F.col("text"), "char_count": F.length("text"), "line_count": F.size(F.split("text", "\n"))}
    return Batch(_nodes(df, nid, "Policy", head), facts_of(df, nid, fields, falsy=False))


#: Phases in their fixed order, since edges need ends that exist.
INGESTERS = {
    "hr": {"employees": employees}, "crm": {"customers": customers, "products": products, "sales": sales}, "bm": {"clients": clients, "vendors": vendors},
    "communications": {"emails": emails, "chats": chats, "tickets": tickets}, "policies": {"policies": policies},
}


#: Where each record kind comes from.
SOURCE_OF = {
    "employees": dims.HR, "customers": dims.CRM, "products": dims.CRM, "sales": dims.CRM, "clients": dims.BM, "vendors": dims.BM,
    "emails": "Enterprise_Mail_System", "chats": "Collaboration_tools", "tickets": dims.IT, "policies": "Policy_Documents",
}
#: Ordinals of one record table stay below; the table's own number is above, so later tables come later.
ORD_BITS = 53


def build(records: dict[str, DataFrame], sources: list[str] | None = None, base: ContextGraph | None = None, after: int | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[ContextGraph, DataFrame]:
    """(graph, facts) of the given record tables; `sources` picks phases, `base` is a graph to go on with.

    Facts carry the source of their record. Ordinals follow the phases and tables, and those of a re-ingest come
    after the base's and after `after`, so what is written later wins. `keep` stores the nodes, which edges are checked
    against twice.
    """
    chosen = [(n, f) for phase, fs in INGESTERS.items() if not sources or phase in sources for n, f in fs.items() if n in records]
    if not chosen:
        raise ValueError("no records for the chosen sources")
    first = 0
    if base is not None:
        top = base.nodes.select("ord").unionByName(base.edges.select("ord")).agg(F.max("ord")).first()[0]
        first = 0 if top is None else (top >> ORD_BITS) + 1
    if after is not None:
        first = max(first, (after >> ORD_BITS) + 1)
    later = lambda df, k: df.withColumn("ord", F.col("ord") + F.lit((first + k) << ORD_BITS))
    nodes, facts, edges = [], [], []
    for k, (n, f) in enumerate(chosen):
        b = f(records[n])
        nodes.append(later(b.nodes, k))
        facts.append(later(b.facts, k).withColumn("source_system", F.lit(SOURCE_OF[n])))
        if b.edges is not None:
            edges.append(later(b.edges, k))
    more = lambda xs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), xs)
    all_nodes = last_wins(more(nodes + ([base.nodes] if base is not None else [])), ("node_id", "node_type"))
    all_nodes = keep(all_nodes, "nodes") if keep else all_nodes
    es = edges + ([base.edges] if base is not None else [])
    none = all_nodes.sparkSession.createDataFrame([], "src string, dst string, rel_type string, ord long, role string")
    return ContextGraph(all_nodes, guarded(last_wins(more([none, *es])), all_nodes)), _union(*facts)
