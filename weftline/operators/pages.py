"""Markdown pages of employees, teams, policies, threads, tickets and projects.

Pages come from the graph's edges and long-form facts, all nodes of a type at once; each section is a
table of lines, so a page costs the joins of its sections and one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.graph import ContextGraph, top_per
from weftline.operators.views import assemble, listed, section
from weftline.runtime import Scratch


#: Sections of the caller's own (notes, recent changes), put on the pages of the nodes at hand.
Extra = tuple[DataFrame, ...] | list[DataFrame]


def _extra(nodes: DataFrame, extra: Extra) -> list[DataFrame]:
    ids = nodes.select("node_id")
    return [x.join(ids, "node_id", "left_semi") for x in extra]


def source_tag(source: Column) -> Column:
    """Where a value comes from, as text behind it; nothing where that isn't known."""
    return F.when(T.blank_to_null(source).isNotNull(), F.concat(F.lit(" _("), source, F.lit(")_"))).otherwise("")


def filtered_properties(facts: DataFrame, most: int = 8, chars: int = 200) -> DataFrame:
    """(node_id, key, value, rn): each node's first properties that aren't empty, long values cut."""
    f = top_per(facts.where(T.blank_to_null(F.col("value")).isNotNull()), "node_id", most, F.col("ord"), F.col("key"))
    return f.select("node_id", "key", F.substring("value", 1, chars).alias("value"), "rn")


def wide(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(node_id, one column per key) of long facts; the last written value counts."""
    best = [F.max(F.when(F.col("key") == k, F.struct("ord", "value")))["value"].alias(k) for k in keys]
    return facts.where(F.col("key").isin(*keys)).groupBy("node_id").agg(*best)


def _title(nodes: DataFrame) -> DataFrame:
    return section(nodes, 0, F.lit(0), F.concat(F.lit("# "), "title", F.lit(" ("), T.node_key(F.col("node_id")), F.lit(")\n")))


def _bullets(nodes: DataFrame, facts: DataFrame, number: int, head: str, fields: dict[str, str]) -> list[DataFrame]:
    """A heading and one line per present field, in the given order."""
    f = facts.join(nodes.select("node_id"), "node_id", "left_semi").where(F.col("key").isin(*fields))
    source = F.col("source_system") if "source_system" in facts.columns else F.lit(None).cast("string")
    f = f.groupBy("node_id", "key").agg(F.max(F.struct("ord", "value", source.alias("source"))).alias("b")).select("node_id", "key", F.col("b.value").alias("value"), F.col("b.source").alias("source"))
    pos = F.create_map(*[F.lit(x) for i, k in enumerate(fields, 1) for x in (k, i)])[F.col("key")]
    label = F.create_map(*[F.lit(x) for k, v in fields.items() for x in (k, v)])[F.col("key")]
    rows = section(f, number, pos, F.concat(F.lit("- "), label, F.lit(": "), "value", source_tag(F.col("source"))))
    return [section(f.select("node_id").distinct(), number, F.lit(0), F.lit(f"\n## {head}")), rows]


def _listed(rows: DataFrame, number: int, head: str, most: int, order: list[Column], text: Column) -> list[DataFrame]:
    """A heading with the count, the first lines and how many more there are; rows: node_id and what order and text use."""
    return [_ranked(top_per(rows, "node_id", most, *order), number, head, most, text)]


def _ranked(rows: DataFrame, number: int, head: str, most: int, text: Column) -> DataFrame:
    """_listed() of rows that have their ranks and counts."""
    more = F.when(F.col("group_size") > most, F.concat(F.lit("- ... and "), (F.col("group_size") - most).cast("string"), F.lit(" more")))
    return listed(rows, number, F.concat(F.lit(f"\n## {head} ("), F.col("group_size").cast("string"), F.lit(")")), text, more)


def _sources(nodes: DataFrame, provenance: DataFrame) -> DataFrame:
    """provenance: node_id, source_system, file."""
    p = provenance.join(nodes.select("node_id"), "node_id", "left_semi")
    s = p.groupBy("node_id").agg(F.array_sort(F.collect_set(F.concat_ws("/", "source_system", T.blank_to_null(F.col("file"))))).alias("s"))
    return section(s, 99, F.lit(0), F.concat(F.lit("\n## Data sources\n- "), F.array_join("s", "\n- ")))


def _linked(g: ContextGraph, nodes: DataFrame, rel: str, direction: str) -> DataFrame:
    return g.neighbours(nodes, rel, direction).select("node_id", "other", "other_title", "ord")


def _link(kind: str) -> Column:
    return T.link(F.col("other_title"), kind, T.node_key(F.col("other")))


def _of(g: ContextGraph, kind: str, ids: DataFrame | None) -> DataFrame:
    n = g.nodes.where(F.col("node_type") == kind).select("node_id", "title", "ord")
    return n.join(ids.select("node_id"), "node_id", "left_semi") if ids is not None else n


def employees(g: ContextGraph, facts: DataFrame, provenance: DataFrame, ids: DataFrame | None = None, extra: Extra = ()) -> DataFrame:
    """(node_id, page): basics, activity counts, clients, the last ten emails, tickets, sources."""
    n = _of(g, "Employee", ids)
    parts = [_title(n), *_bullets(n, facts, 1, "Basic information", {"email": "Email", "department": "Department", "level": "Level", "doj": "Joined"}), *_bullets(n, facts, 2, "Profile", {"skills": "Skills", "resume_text": "Résumé"})]
    rels = ["sent_email", "received_email", "chatted_in", "raised_ticket", "assigned_ticket", "represents_client"]
    counts = g.both_ways().where(F.col("rel_type").isin(*rels) & (F.col("direction") == "outgoing")).join(n.select("node_id"), "node_id", "left_semi").groupBy("node_id", "rel_type").agg(F.count("*").alias("c"))
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rels, 1) for x in (r, i)])[F.col("rel_type")]
    parts += [section(counts.select("node_id").distinct(), 3, F.lit(0), F.lit("\n## Activity")), section(counts, 3, place, F.concat(F.lit("- "), F.regexp_replace("rel_type", "_", " "), F.lit(": "), F.col("c").cast("string")))]
    parts += _listed(_linked(g, n, "represents_client", "outgoing"), 4, "Clients", 50, [F.col("other_title"), F.col("other")], F.concat(F.lit("- "), _link("clients")))
    dates = wide(facts, ["date"]).select(F.col("node_id").alias("other"), F.coalesce("date", F.lit("")).alias("date"))
    mails = _linked(g, n, "sent_email", "outgoing").join(dates, "other", "left").withColumn("date", F.coalesce("date", F.lit("")))
    parts += _listed(mails, 5, "Recent emails", 10, [F.desc("date"), F.col("ord"), F.col("other")], F.concat(F.lit("- ["), "date", F.lit("] "), "other_title"))
    parts += _listed(_linked(g, n, "raised_ticket", "outgoing"), 6, "IT tickets", 10, [F.col("ord"), F.col("other")], F.concat(F.lit("- "), _link("it-tickets")))
    return assemble(*parts, _sources(n, provenance), *_extra(n, extra))


def teams(g: ContextGraph, facts: DataFrame, provenance: DataFrame, ids: DataFrame | None = None, extra: Extra = ()) -> DataFrame:
    """(node_id, page): members by name as a table, and their summed activity; edges are read once."""
    n = _of(g, "Department", ids)
    members = _linked(g, n, "works_in", "incoming")
    levels = wide(facts, ["level"]).select(F.col("node_id").alias("other"), "level")
    rows = members.join(levels, "other", "left")
    head = "Members"
    parts = [_title(n), *_listed(rows, 1, head, 10**9, [F.col("other_title"), F.col("other")], F.concat(F.lit("| "), _link("people"), F.lit(" | "), F.coalesce("level", F.lit("")), F.lit(" |")))]
    act = g.both_ways().where("direction = 'outgoing' and rel_type in ('sent_email', 'raised_ticket')").groupBy(F.col("node_id").alias("other"), "rel_type").agg(F.count("*").alias("c"))
    total = members.join(act, "other").groupBy("node_id", "rel_type").agg(F.sum("c").alias("c"))
    return assemble(*parts, section(total, 2, F.when(F.col("rel_type") == "sent_email", 1).otherwise(2), F.concat(F.lit("- "), F.regexp_replace("rel_type", "_", " "), F.lit(": "), F.col("c").cast("string"))), _sources(n, provenance), *_extra(n, extra))


def policies(g: ContextGraph, facts: DataFrame, provenance: DataFrame, ids: DataFrame | None = None, extra: Extra = ()) -> DataFrame:
    """(node_id, page): metadata, summary, full text, sources."""
    n = _of(g, "Policy", ids)
    w = wide(facts, ["summary", "content"]).join(n.select("node_id"), "node_id", "left_semi")
    parts = [_title(n), *_bullets(n, facts, 1, "Metadata", {"category": "Category", "char_count": "Characters", "line_count": "Lines"})]
    parts += [section(w.where("summary is not null"), 2, F.lit(0), F.concat(F.lit("\n## Summary\n"), "summary")), section(w.where("content is not null"), 3, F.lit(0), F.concat(F.lit("\n## Full text\n"), "content"))]
    return assemble(*parts, _sources(n, provenance), *_extra(n, extra))


def _thread_mails(g: ContextGraph, n: DataFrame, facts: DataFrame) -> DataFrame:
    """The mails of threads, stored, since several sections are made of them."""
    w = wide(facts, ["date", "body", "sender_name", "sender_emp_id", "recipient_emp_id", "recipient_name"]).withColumnRenamed("node_id", "other")
    m = _linked(g, n, "part_of_thread", "incoming").join(w, "other").withColumn("date", F.coalesce("date", F.lit("")))
    return Scratch(m.sparkSession).save(m, "mails")


def _participants(mails: DataFrame) -> DataFrame:
    """(node_id, who, name, first): both ends of each mail, in order of appearance."""
    ends = F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("sender_emp_id").alias("who"), F.col("sender_name").alias("name")), F.struct(F.lit(1).alias("e"), F.col("recipient_emp_id").alias("who"), F.col("recipient_name").alias("name")))).alias("p")
    p = mails.select("node_id", "ord", ends).where("p.who is not null and p.who <> ''")
    p = p.groupBy("node_id", "p.who").agg(F.min(F.struct("ord", "p.e", "p.name")).alias("first"))
    return p.select("node_id", "who", F.coalesce("first.name", "who").alias("name"), F.struct("first.ord", "first.e").alias("first"))


def _span(mails: DataFrame, number: int) -> DataFrame:
    s = mails.groupBy("node_id").agg(F.count("*").alias("n"), F.min(F.substring("date", 1, 10)).alias("a"), F.max(F.substring("date", 1, 10)).alias("b"))
    return section(s, number, F.lit(0), F.concat(F.lit("- Emails: "), F.col("n").cast("string"), F.lit("\n- Span: "), "a", F.lit(" to "), "b"))


def threads(g: ContextGraph, facts: DataFrame, provenance: DataFrame, ids: DataFrame | None = None, extra: Extra = (), snippet: int = 180) -> DataFrame:
    """(node_id, page): counts, span, participants as first seen, timeline with snippets."""
    n = _of(g, "EmailThread", ids)
    m = _thread_mails(g, n, facts)
    parts = [_title(n), _span(m, 1), *_listed(_participants(m), 2, "Participants", 10**9, [F.col("first"), F.col("who")], F.concat(F.lit("- "), T.link(F.col("name"), "people", F.col("who"))))]
    text = F.concat(F.lit("- ["), F.substring("date", 1, 10), F.lit("] "), F.coalesce("sender_name", F.lit("")), F.lit(": "), F.regexp_replace(F.substring(F.coalesce("body", F.lit("")), 1, snippet), "\\s+", " "))
    return assemble(*parts, *_listed(m, 3, "Timeline", 10**9, [F.col("date"), F.col("ord"), F.col("other")], text), _sources(n, provenance), *_extra(n, extra))


def tickets(g: ContextGraph, facts: DataFrame, provenance: DataFrame, ids: DataFrame | None = None, extra: Extra = ()) -> DataFrame:
    n = _of(g, "ITTicket", ids)
    w = wide(facts, ["resolution"]).join(n.select("node_id"), "node_id", "right")
    status = section(w, 1, F.lit(0), F.concat(F.lit("- Status: "), T.ticket_status(F.col("resolution"))))
    people = [*_listed(_linked(g, n, "raised_ticket", "incoming"), 3, "Raised by", 5, [F.col("ord")], F.concat(F.lit("- "), _link("people"))), *_listed(_linked(g, n, "assigned_ticket", "incoming"), 4, "Assigned to", 5, [F.col("ord")], F.concat(F.lit("- "), _link("people")))]
    return assemble(_title(n), status, *_bullets(n, facts, 2, "Ticket", {"priority": "Priority", "assigned_date": "Assigned", "issue": "Issue", "resolution": "Resolution"}), *people, _sources(n, provenance), *_extra(n, extra))


def _first_tickets(people: DataFrame, raised: DataFrame, most: int) -> DataFrame:
    """(node_id, ticket, o, rn, group_size): the first tickets that participants raised, and how many there are; people: node_id, who, first; raised: who, ticket, tord.

    A thread's participants may have raised most of all tickets, so pairs aren't made. Tickets with one raiser are
    counted by raiser, and only participants whose forerunners have fewer than `most` give any, `most` at most.
    Tickets that several have raised could count twice; they are few, and theirs are the pairs that are made.
    """
    raised = raised.groupBy("who", "ticket").agg(F.min("tord").alias("tord"))
    raised = raised.withColumn("raisers", F.count("*").over(Window.partitionBy("ticket")))
    one = raised.where("raisers = 1").withColumn("k", F.row_number().over(Window.partitionBy("who").orderBy("tord", "ticket")))
    counts = one.groupBy("who").agg(F.count("*").alias("n"))
    w = Window.partitionBy("node_id")
    upto, equal = F.sum("n").over(w.orderBy("first")), F.sum("n").over(Window.partitionBy("node_id", "first"))
    p = people.join(counts, "who").withColumn("before", upto - equal).withColumn("total", F.sum("n").over(w)).where(F.col("before") < most)
    rows = p.join(one.where(F.col("k") <= most), "who").select("node_id", "ticket", F.struct("first", "tord").alias("o"), "total", F.lit(0).alias("shared"))
    shared = people.join(raised.where("raisers > 1"), "who").groupBy("node_id", "ticket").agg(F.min(F.struct("first", "tord")).alias("o"))
    rows = rows.unionByName(shared.withColumn("total", F.lit(0).cast("long")).withColumn("shared", F.lit(1)))
    rows = rows.withColumn("rn", F.row_number().over(w.orderBy("o", "ticket"))).withColumn("group_size", F.max("total").over(w) + F.sum("shared").over(w))
    return rows.where(F.col("rn") <= most).select("node_id", "ticket", "o", "rn", "group_size")


def projects(g: ContextGraph, facts: DataFrame, provenance: DataFrame, ids: DataFrame | None = None, extra: Extra = ()) -> DataFrame:
    """(node_id, page): a thread's snapshot, contributing departments, participants and their tickets.

    The listing's thresholds aren't checked again.
    """
    n = _of(g, "EmailThread", ids)
    m = _thread_mails(g, n, facts)
    p = _participants(m)
    dept = wide(facts, ["department"]).select(T.node_key(F.col("node_id")).alias("who"), "department").where("department is not null")
    touch = m.select("node_id", F.explode(F.array("sender_emp_id", "recipient_emp_id")).alias("who")).join(dept, "who").groupBy("node_id", "department").agg(F.count("*").alias("c"))
    raised = g.both_ways().where("direction = 'outgoing' and rel_type = 'raised_ticket'").select(T.node_key(F.col("node_id")).alias("who"), F.col("other").alias("ticket"), F.col("ord").alias("tord"))
    tick = _first_tickets(p.select("node_id", "who", "first"), raised, 25)
    parts = [_title(n), _span(m, 1), *_listed(touch, 2, "Departments", 10**9, [F.desc("c"), F.col("department")], F.concat(F.lit("- "), T.link(F.col("department"), "teams", F.col("department")), F.lit(" ("), F.col("c").cast("string"), F.lit(" touches)")))]
    parts += _listed(p, 3, "Participants", 10**9, [F.col("first"), F.col("who")], F.concat(F.lit("- "), T.link(F.col("name"), "people", F.col("who"))))
    return assemble(*parts, _ranked(tick, 4, "Related IT tickets", 25, F.concat(F.lit("- #"), T.node_key(F.col("ticket")))), _sources(n, provenance), *_extra(n, extra))


def documents(g: ContextGraph, facts: DataFrame, pages: DataFrame | None = None, page_chars: int = 5000) -> DataFrame:
    """Index documents of all nodes: type, id, title, properties, page, relation examples and counts, degree.

    At most six outgoing and twelve relation examples a node, out-edges first.
    """
    props = facts.withColumn("t", F.concat_ws(" ", "key", F.substring("value", 1, 400))).groupBy("node_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), "\n").alias("props"))
    e = g.both_ways().join(g.nodes.select(F.col("node_id").alias("other"), F.col("title").alias("ot")), "other")
    way = F.when(F.col("direction") == "outgoing", 0).otherwise(1)
    e = e.withColumn("way", way).withColumn("k", F.row_number().over(Window.partitionBy("node_id", "way").orderBy("ord", "other", "rel_type")))
    e = e.where("way = 1 and k <= 12 or way = 0 and k <= 6").withColumn("j", F.row_number().over(Window.partitionBy("node_id").orderBy("way", "k"))).where("j <= 12")
    ex = e.groupBy("node_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", F.concat_ws(" ", "direction", "rel_type", "ot").alias("t")))), lambda x: x["t"]), "\n").alias("examples"))
    counts = g.both_ways().groupBy("node_id", "rel_type").agg(F.count("*").alias("c")).groupBy("node_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", F.regexp_replace("rel_type", "_", " "), F.col("c").cast("string")))), "\n").alias("counts"), F.sum("c").alias("degree"))
    d = g.nodes.select("node_id", "node_type", "title").join(props, "node_id", "left").join(ex, "node_id", "left").join(counts, "node_id", "left")
    d = d.join(pages.select("node_id", F.substring("page", 1, page_chars).alias("page")), "node_id", "left") if pages is not None else d.withColumn("page", F.lit(None).cast("string"))
    return d.select("node_id", "node_type", "title", F.concat_ws("\n", "props", "page").alias("text"), F.concat_ws("\n", "examples", "counts").alias("relations"), F.coalesce("degree", F.lit(0)).alias("degree"))
