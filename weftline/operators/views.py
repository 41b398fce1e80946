"""Stitched views: histories, teams, threads, projects, listings and Markdown pages.

A page is assembled from rows (node_id, section, line, text) and put together per node in that order, so
any number of pages is one aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.graph import top_per


def purchase_history(purchases: DataFrame, items: DataFrame, products: DataFrame, most: int = 20) -> DataFrame:
    """Each customer's last sales with the first product of each.

    purchases: customer, sale, date; items: sale, product, ord; products: product, name.
    """
    last = top_per(purchases, "customer", most, F.desc("date"), F.col("sale"))
    first = items.join(last.select("sale"), "sale", "left_semi").groupBy("sale").agg(F.min(F.struct("ord", "product")).alias("_i")).select("sale", F.col("_i.product").alias("product"))
    return last.join(first, "sale", "left").join(products, "product", "left").select("customer", "rn", "sale", "date", "product", "name", F.col("group_size").alias("n_sales"))


def team_members(members: DataFrame, teams: DataFrame) -> DataFrame:
    """(team, member, name, rn) by name; members: team, member, name."""
    w = Window.partitionBy("team").orderBy("name", "member")
    return members.join(teams.select("team"), "team", "left_semi").withColumn("rn", F.row_number().over(w)).select("team", "member", "name", "rn")


def team_activity(members: DataFrame, activity: DataFrame) -> DataFrame:
    """(team, n_members, one count per kind of activity); activity: member, kind, aggregated before the join."""
    per = activity.groupBy("member").pivot("kind", ["sent", "received", "raised"]).count()
    j = members.join(per, "member", "left")
    return j.groupBy("team").agg(F.count("*").alias("n_members"), *[F.coalesce(F.sum(k), F.lit(0)).alias(f"n_{k}") for k in ("sent", "received", "raised")])


def thread_timeline(emails: DataFrame, snippet: int = 180) -> DataFrame:
    """(thread, rn, ord, who, snippet) in order; emails: thread, ord, who, body."""
    s = F.regexp_replace(F.substring("body", 1, snippet), "\\s+", " ")
    return emails.withColumn("rn", F.row_number().over(Window.partitionBy("thread").orderBy("ord"))).select("thread", "rn", "ord", "who", s.alias("snippet"))


def threads(emails: DataFrame) -> DataFrame:
    return emails.groupBy("thread").agg(F.count("*").alias("n_emails"), F.count_distinct("who").alias("n_participants"), F.max("ord").alias("latest"))


def top_threads(emails: DataFrame, most: int = 200) -> DataFrame:
    return threads(emails).orderBy(F.desc("n_emails"), F.desc("thread")).limit(most)


def projects(emails: DataFrame, min_emails: int = 3, min_participants: int = 2) -> DataFrame:
    """Threads of substance, with their place by (-emails, latest)."""
    p = threads(emails).where((F.col("n_emails") >= min_emails) & (F.col("n_participants") >= min_participants))
    return p.orderBy(F.desc("n_emails"), "latest", "thread")


def recent(rows: DataFrame, by: str, order: str, most: int = 10) -> DataFrame:
    """Each group's latest rows, and how many more it has."""
    return top_per(rows, by, most, F.desc(order)).withColumn("more", F.greatest(F.col("group_size") - most, F.lit(0))).drop("group_size")


def department_touches(emails: DataFrame, departments: DataFrame) -> DataFrame:
    """(thread, department, n): sender and recipient each count; departments: who, department."""
    e = emails.select("thread", F.explode(F.array("sender", "recipient")).alias("who")).join(departments, "who")
    return e.groupBy("thread", "department").agg(F.count("*").alias("n"))


def related_tickets(participants: DataFrame, tickets: DataFrame, most: int = 25) -> DataFrame:
    """Each thread's tickets raised by a participant, once each; participants: thread, who, ord; tickets: ticket, who, tord."""
    j = participants.join(tickets, "who").groupBy("thread", "ticket").agg(F.min(F.struct("ord", "tord")).alias("o"))
    return top_per(j, "thread", most, F.col("o"), F.col("ticket")).select("thread", "ticket", "rn", "group_size")


def listing(nodes: DataFrame, section: str, node_type: str) -> DataFrame:
    """(path, label, ord) of a section's directory."""
    rows = nodes.where(F.col("node_type") == node_type)
    return rows.select(F.concat(F.lit(f"/{section}/"), T.node_key(F.col("node_id"))).alias("path"), F.col("title").alias("label"), "ord")


def root_listing(counts: DataFrame, sections: dict[str, str]) -> DataFrame:
    """(path, n) of the top directories; counts: node_type, n."""
    s = counts.sparkSession.createDataFrame([(f"/{k}", v) for k, v in sections.items()], "path string, node_type string")
    return F.broadcast(s).join(counts, "node_type", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))


def section(df: DataFrame, number: int, line: Column, text: Column) -> DataFrame:
    return df.select("node_id", F.lit(number).alias("section"), line.cast("long").alias("line"), text.alias("text"))


def assemble(*sections: DataFrame) -> DataFrame:
    """(node_id, page): each node's lines in order of section and line."""
    rows = reduce(DataFrame.unionByName, sections)
    lines = F.sort_array(F.collect_list(F.struct("section", "line", "text")))
    return rows.groupBy("node_id").agg(lines.alias("l")).select("node_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("page"))


def listed(ranked: DataFrame, number: int, head: Column, text: Column, more: Column) -> DataFrame:
    """A whole section as one row: the heading, the lines of top_per() in their order, and what follows where there are more; head and more are of group_size.

    Lines become one text where the ranks are counted, so a section is shuffled once and the page gets a row of it.
    """
    t = ranked.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("rn", text.alias("t")))).alias("l"), F.max("group_size").alias("group_size"))
    return section(t, number, F.lit(0), F.array_join(F.concat(F.array(head), F.transform("l", lambda x: x["t"]), F.array(more)), "\n"))


def customer_pages(customers: DataFrame, history: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Markdown of customers (node_id, key, name): basics, purchases as a table, sources."""
    c = customers
    head = section(c, 0, F.lit(0), F.concat(F.lit("# "), "name", F.lit(" ("), "key", F.lit(")\n\n## Basics\n- ID: "), "key", F.lit("\n- Name: "), "name", F.lit("\n")))
    h = history.join(c.select("node_id", F.col("key").alias("customer")), "customer")
    title = section(h.where("rn = 1"), 1, F.lit(0), F.concat(F.lit("## Purchases ("), F.col("n_sales").cast("string"), F.lit(" orders)\n| Date | Product |\n|---|---|")))
    rows = section(h, 1, F.col("rn"), F.concat(F.lit("| "), F.coalesce("date", F.lit("")), F.lit(" | "), F.coalesce(T.link(F.col("name"), "products", F.col("product").cast("string")), F.lit("")), F.lit(" |")))
    more = section(h.where("rn = 1 and n_sales > 20"), 1, F.lit(1000), F.concat(F.lit("\n*... and "), (F.col("n_sales") - 20).cast("string"), F.lit(" more*")))
    parts = [head, title, rows, more]
    if sources is not None:
        s = sources.groupBy("node_id").agg(F.array_sort(F.collect_set("source")).alias("s"))
        parts.append(section(s, 9, F.lit(0), F.concat(F.lit("\n## Sources\n- "), F.array_join("s", "\n- "))))
    return assemble(*parts)


def change_block(changes: DataFrame, most: int = 10) -> list[DataFrame]:
    """A page's recent changes, latest first, as sections; changes: node_id, key, old_value, new_value, source_system, ord."""
    c = top_per(changes, "node_id", most, F.desc("ord"), F.col("key"))
    text = F.concat(F.lit("- "), "key", F.lit(": "), F.coalesce("old_value", F.lit("(none)")), F.lit(" to "), "new_value", F.lit(" ("), F.coalesce("source_system", F.lit("unknown")), F.lit(")"))
    more = F.when(F.col("group_size") > most, F.concat(F.lit("- ... and "), (F.col("group_size") - most).cast("string"), F.lit(" more")))
    return [listed(c, 8, F.concat(F.lit("\n## Recent changes ("), F.col("group_size").cast("string"), F.lit(")")), text, more)]


def notes_block(notes: DataFrame) -> list[DataFrame]:
    """Notes on a node, latest first, as sections; notes: node_id, created_at, author, body."""
    n = notes.withColumn("rn", F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("created_at"), "body")))
    return [section(n.where("rn = 1"), 7, F.lit(0), F.lit("\n## Notes")), section(n, 7, F.col("rn"), F.concat(F.lit("- "), "author", F.lit(": "), "body"))]
