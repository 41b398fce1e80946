"""Registered queries of pages, of the write path and of what follows decisions, over records made from the test tables.

Employees are the customers, emails the orders, tickets the suppliers, policies the parts; each whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import dims
from weftline.functions import text as T
from weftline.operators import decisions, pages, profile, resolve, upsert, views
from weftline.plans import registry as R
from weftline.plans.engine import Engine
from weftline.plans.registry import query
from weftline.runtime import Scratch, table

MAIL, POLICY = "Enterprise_Mail_System", "Policy_Documents"


def _records(spark, d, *kinds: str) -> dict[str, DataFrame]:
    s = lambda c: F.col(c).cast("string")
    emp = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations
    out = {"employees": emp.select(s("c_custkey").alias("emp_id"), F.col("c_name").alias("Name"), F.concat(F.lit("c"), s("c_custkey"), F.lit("@ex.org")).alias("email"), F.col("n_name").alias("category"), F.col("c_mktsegment").alias("Level"), F.col("c_custkey").cast("long").alias("ord"))}
    o = table(spark, d, "orders")
    to = (F.col("o_custkey") % 100 + 1).cast("string")
    out["emails"] = o.select(
        s("o_orderkey").alias("email_id"), F.concat(F.lit("T"), F.floor(F.col("o_orderkey") / 7).cast("string")).alias("thread_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        s("o_custkey").alias("sender_emp_id"), F.concat(F.lit("P "), s("o_custkey")).alias("sender_name"), to.alias("recipient_emp_id"), F.concat(F.lit("P "), to).alias("recipient_name"),
        F.concat(F.lit("Order "), s("o_orderkey")).alias("subject"), F.concat("o_orderpriority", F.lit("  "), "o_orderstatus").alias("body"), F.concat(F.lit("--\nP "), s("o_custkey")).alias("signature"), F.col("o_orderkey").cast("long").alias("ord"),
    )
    k = F.col("s_suppkey")
    out["tickets"] = table(spark, d, "supplier").select(
        s("s_suppkey").alias("id"), F.concat(F.lit("P"), (k % 3).cast("string")).alias("priority"), (k % 100 + 1).cast("string").alias("raised_by_emp_id"), F.lit("2024-01-01").alias("assigned_date"), (k % 77 + 1).cast("string").alias("emp_id"),
        F.col("s_name").alias("Issue"), F.when(k % 3 == 0, "done").otherwise(" ").alias("Resolution"), k.cast("long").alias("ord"),
    )
    file = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Leave ").otherwise("Risk "), s("p_partkey"), F.lit(".md"))
    out["policies"] = table(spark, d, "part").select(file.alias("file"), F.concat(F.lit("# "), "p_name", F.lit("\n"), "p_type", F.lit("\n"), "p_brand").alias("text"), F.col("p_partkey").cast("long").alias("ord"))
    return {n: x for n, x in out.items() if n in kinds}


def _engine(spark, d, *kinds: str) -> Engine:
    return Engine.ingest(_records(spark, d, *kinds))


EMP = """emp AS (SELECT 'Employee:' || c_custkey AS nid, c_custkey AS k, c_name AS name, n_name AS dept, c_mktsegment AS lvl FROM customer JOIN nation ON n_nationkey = c_nationkey)"""
MAILS = """mail AS (SELECT o_orderkey AS o, 'EmailThread:T' || (o_orderkey // 7) AS tid, 'T' || (o_orderkey // 7) AS tkey, o_custkey AS s, o_custkey % 100 + 1 AS r, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Order ' || o_orderkey AS subject, o_orderpriority || ' ' || o_orderstatus AS body FROM orders),
 subj AS (SELECT tid, any_value(tkey) AS tkey, arg_min(subject, o) AS title, count(*) AS n, min(date) AS a, max(date) AS b FROM mail GROUP BY 1),
 ends AS (SELECT tid, o, 0 AS e, s AS who FROM mail UNION ALL SELECT tid, o, 1, r FROM mail),
 people AS (SELECT tid, who, min({'o': o, 'e': e}) AS first FROM ends GROUP BY 1, 2),
 placed AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY first, who::VARCHAR) AS rn, count(*) OVER (PARTITION BY tid) AS n FROM people)"""
TICKETS = """tick AS (SELECT s_suppkey AS k, 'ITTicket:' || s_suppkey AS nid, s_name AS issue, 'P' || (s_suppkey % 3) AS prio, s_suppkey % 100 + 1 AS raiser, s_suppkey % 77 + 1 AS worker, s_suppkey % 3 = 0 AS done FROM supplier)"""
NL = "chr(10)"


def _page(*lines: str) -> str:
    return "lines(nid, sec, ln, t) AS (" + " UNION ALL ".join(lines) + f") SELECT nid AS node_id, string_agg(t, {NL} ORDER BY sec, ln) AS page FROM lines GROUP BY nid"


def _tag(source: str) -> str:
    return f" _({source})_"


def _source(rows: str, nid: str, source: str) -> str:
    return f"SELECT {nid}, 99, 0, {NL} || '## Data sources' || {NL} || '- {source}' FROM {rows}"


_ACTS = """act AS (SELECT k, 1 AS place, 'sent email' AS rel, count(*) AS n FROM emp JOIN mail ON s = k GROUP BY 1 UNION ALL SELECT k, 2, 'received email', count(*) FROM emp JOIN mail ON r = k GROUP BY 1
 UNION ALL SELECT k, 4, 'raised ticket', count(*) FROM emp JOIN tick USING (k) WHERE false GROUP BY 1
 UNION ALL SELECT raiser, 4, 'raised ticket', count(*) FROM tick GROUP BY 1 UNION ALL SELECT worker, 5, 'assigned ticket', count(*) FROM tick GROUP BY 1),
 sent AS (SELECT s, date, subject, row_number() OVER (PARTITION BY s ORDER BY date DESC, o) AS rn, count(*) OVER (PARTITION BY s) AS n FROM mail),
 mine AS (SELECT raiser, k, issue, row_number() OVER (PARTITION BY raiser ORDER BY k) AS rn, count(*) OVER (PARTITION BY raiser) AS n FROM tick)"""


@query(f"WITH {EMP}, {MAILS}, {TICKETS}, {_ACTS}, " + _page(
    f"SELECT nid, 0, 0, '# ' || name || ' (' || k || ')' || {NL} FROM emp",
    f"SELECT nid, 1, 0, {NL} || '## Basic information' FROM emp",
    f"SELECT nid, 1, 1, '- Email: c' || k || '@ex.org{_tag(dims.HR)}' FROM emp",
    f"SELECT nid, 1, 2, '- Department: ' || dept || '{_tag(dims.HR)}' FROM emp",
    f"SELECT nid, 1, 3, '- Level: ' || lvl || '{_tag(dims.HR)}' FROM emp",
    f"SELECT DISTINCT 'Employee:' || k, 3, 0, {NL} || '## Activity' FROM act",
    "SELECT 'Employee:' || k, 3, place, '- ' || rel || ': ' || n FROM act",
    f"SELECT 'Employee:' || s, 5, 0, {NL} || '## Recent emails (' || n || ')' FROM sent WHERE rn = 1",
    "SELECT 'Employee:' || s, 5, rn, '- [' || date || '] ' || subject FROM sent WHERE rn <= 10",
    "SELECT 'Employee:' || s, 5, 1000000, '- ... and ' || (n - 10) || ' more' FROM sent WHERE rn = 1 AND n > 10",
    f"SELECT 'Employee:' || raiser, 6, 0, {NL} || '## IT tickets (' || n || ')' FROM mine WHERE rn = 1",
    "SELECT 'Employee:' || raiser, 6, rn, '- [' || issue || '](/it-tickets/' || k || ')' FROM mine WHERE rn <= 10",
    "SELECT 'Employee:' || raiser, 6, 1000000, '- ... and ' || (n - 10) || ' more' FROM mine WHERE rn = 1 AND n > 10",
    _source("emp", "nid", dims.HR),
))
def q_employee_pages(spark, d):
    e = _engine(spark, d, "employees", "emails", "tickets")
    return pages.employees(e.graph, e.facts, e.provenance)


@query(f"WITH {EMP}, {MAILS}, {TICKETS}, m AS (SELECT dept, k, name, lvl, row_number() OVER (PARTITION BY dept ORDER BY name, nid) AS rn, count(*) OVER (PARTITION BY dept) AS n FROM emp),"
       " a AS (SELECT dept, 1 AS p, 'sent email' AS rel, count(*) AS n FROM emp JOIN mail ON s = k GROUP BY 1 UNION ALL SELECT dept, 2, 'raised ticket', count(*) FROM emp JOIN tick ON raiser = emp.k GROUP BY 1), " + _page(
    f"SELECT DISTINCT 'Department:' || dept, 0, 0, '# ' || dept || ' (' || dept || ')' || {NL} FROM emp",
    f"SELECT 'Department:' || dept, 1, 0, {NL} || '## Members (' || n || ')' FROM m WHERE rn = 1",
    "SELECT 'Department:' || dept, 1, rn, '| [' || name || '](/people/' || k || ') | ' || lvl || ' |' FROM m",
    "SELECT 'Department:' || dept, 2, p, '- ' || rel || ': ' || n FROM a",
    _source("(SELECT DISTINCT dept FROM emp)", "'Department:' || dept", dims.HR),
))
def q_team_pages(spark, d):
    e = _engine(spark, d, "employees", "emails", "tickets")
    return pages.teams(e.graph, e.facts, e.provenance)


@query("WITH p AS (SELECT p_partkey AS k, p_name, p_type, p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'leave-' ELSE 'risk-' END || p_partkey AS slug FROM part), " + _page(
    f"SELECT 'Policy:' || slug, 0, 0, '# ' || p_name || ' (' || slug || ')' || {NL} FROM p",
    f"SELECT 'Policy:' || slug, 1, 0, {NL} || '## Metadata' FROM p",
    f"SELECT 'Policy:' || slug, 1, 1, '- Category: ' || CASE WHEN k % 2 = 0 THEN 'People & HR' ELSE 'Risk' END || '{_tag(POLICY)}' FROM p",
    f"SELECT 'Policy:' || slug, 1, 2, '- Characters: ' || (length(p_name) + length(p_type) + length(p_brand) + 4) || '{_tag(POLICY)}' FROM p",
    f"SELECT 'Policy:' || slug, 1, 3, '- Lines: 3{_tag(POLICY)}' FROM p",
    f"SELECT 'Policy:' || slug, 2, 0, {NL} || '## Summary' || {NL} || trim(p_type) || ' ' || trim(p_brand) FROM p",
    f"SELECT 'Policy:' || slug, 3, 0, {NL} || '## Full text' || {NL} || '# ' || p_name || {NL} || p_type || {NL} || p_brand FROM p",
    _source("p", "'Policy:' || slug", POLICY),
))
def q_policy_pages(spark, d):
    e = _engine(spark, d, "policies")
    return pages.policies(e.graph, e.facts, e.provenance)


_SPAN = f"SELECT tid, 1, 0, '- Emails: ' || n || {NL} || '- Span: ' || a || ' to ' || b FROM subj"
_TITLE = f"SELECT tid, 0, 0, '# ' || title || ' (' || tkey || ')' || {NL} FROM subj"


@query(f"WITH {MAILS}, line AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY date, o) AS rn, count(*) OVER (PARTITION BY tid) AS n FROM mail), " + _page(
    _TITLE, _SPAN,
    f"SELECT tid, 2, 0, {NL} || '## Participants (' || n || ')' FROM placed WHERE rn = 1",
    "SELECT tid, 2, rn, '- [P ' || who || '](/people/' || who || ')' FROM placed",
    f"SELECT tid, 3, 0, {NL} || '## Timeline (' || n || ')' FROM line WHERE rn = 1",
    "SELECT tid, 3, rn, '- [' || date || '] P ' || s || ': ' || body FROM line",
    _source("subj", "tid", MAIL),
))
def q_thread_pages(spark, d):
    e = _engine(spark, d, "employees", "emails")
    return pages.threads(e.graph, e.facts, e.provenance)


@query(f"WITH {EMP}, {TICKETS}, " + _page(
    f"SELECT nid, 0, 0, '# ' || issue || ' (' || k || ')' || {NL} FROM tick",
    "SELECT nid, 1, 0, '- Status: ' || CASE WHEN done THEN 'resolved' ELSE 'open' END FROM tick",
    f"SELECT nid, 2, 0, {NL} || '## Ticket' FROM tick",
    f"SELECT nid, 2, 1, '- Priority: ' || prio || '{_tag(dims.IT)}' FROM tick",
    f"SELECT nid, 2, 2, '- Assigned: 2024-01-01{_tag(dims.IT)}' FROM tick",
    f"SELECT nid, 2, 3, '- Issue: ' || issue || '{_tag(dims.IT)}' FROM tick",
    f"SELECT nid, 2, 4, '- Resolution: ' || CASE WHEN done THEN 'done' ELSE ' ' END || '{_tag(dims.IT)}' FROM tick",
    f"SELECT nid, 3, 0, {NL} || '## Raised by (1)' FROM tick",
    "SELECT tick.nid, 3, 1, '- [' || name || '](/people/' || raiser || ')' FROM tick JOIN emp ON emp.k = raiser",
    f"SELECT nid, 4, 0, {NL} || '## Assigned to (1)' FROM tick",
    "SELECT tick.nid, 4, 1, '- [' || name || '](/people/' || worker || ')' FROM tick JOIN emp ON emp.k = worker",
    _source("tick", "nid", dims.IT),
))
def q_ticket_pages(spark, d):
    e = _engine(spark, d, "employees", "tickets")
    return pages.tickets(e.graph, e.facts, e.provenance)


@query(f"WITH {EMP}, {MAILS}, {TICKETS}, touch AS (SELECT tid, dept, count(*) AS c FROM ends JOIN emp ON emp.k = who GROUP BY 1, 2),"
       " dep AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY c DESC, dept) AS rn, count(*) OVER (PARTITION BY tid) AS n FROM touch),"
       " t1 AS (SELECT tid, k, nid, min({'f': first, 'o': k}) AS o FROM people JOIN tick ON raiser = who GROUP BY 1, 2, 3),"
       " t2 AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY o, nid) AS rn, count(*) OVER (PARTITION BY tid) AS n FROM t1), " + _page(
    _TITLE, _SPAN,
    f"SELECT tid, 2, 0, {NL} || '## Departments (' || n || ')' FROM dep WHERE rn = 1",
    "SELECT tid, 2, rn, '- [' || dept || '](/teams/' || dept || ') (' || c || ' touches)' FROM dep",
    f"SELECT tid, 3, 0, {NL} || '## Participants (' || n || ')' FROM placed WHERE rn = 1",
    "SELECT tid, 3, rn, '- [P ' || who || '](/people/' || who || ')' FROM placed",
    f"SELECT tid, 4, 0, {NL} || '## Related IT tickets (' || n || ')' FROM t2 WHERE rn = 1",
    "SELECT tid, 4, rn, '- #' || k FROM t2 WHERE rn <= 25",
    "SELECT tid, 4, 1000000, '- ... and ' || (n - 25) || ' more' FROM t2 WHERE rn = 1 AND n > 25",
    _source("subj", "tid", MAIL),
))
def q_project_pages(spark, d):
    e = _engine(spark, d, "employees", "emails", "tickets")
    return pages.projects(e.graph, e.facts, e.provenance)


# ---- blocks of pages


@query(f"WITH {R.FOLD}, c AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ord DESC, key) AS rn, count(*) OVER (PARTITION BY node_id) AS n FROM f7 WHERE outcome IN ('added', 'updated')), " + _page(
    f"SELECT node_id, 8, 0, {NL} || '## Recent changes (' || n || ')' FROM c WHERE rn = 1",
    "SELECT node_id, 8, rn, '- ' || key || ': ' || coalesce(current, '(none)') || ' to ' || value || ' (' || source_system || ')' FROM c WHERE rn <= 10",
    "SELECT node_id, 8, 1000, '- ... and ' || (n - 10) || ' more' FROM c WHERE rn = 1 AND n > 10",
))
def q_recent_changes(spark, d):
    return views.assemble(*views.change_block(upsert.change_log(R._folded(spark, d))))


@query("WITH n AS (SELECT 'EmailThread:' || conv_id AS nid, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS rn FROM conversations), " + _page(
    f"SELECT nid, 7, 0, {NL} || '## Notes' FROM n WHERE rn = 1",
    "SELECT nid, 7, rn, '- ' || role || ': ' || text FROM n",
))
def q_notes_on_nodes(spark, d):
    n = table(spark, d, "conversations").select(T.node_id("EmailThread", F.col("conv_id")).alias("node_id"), F.lpad(F.col("turn").cast("string"), 12, "0").alias("created_at"), F.col("role").alias("author"), F.coalesce("text", F.lit("")).alias("body"))
    return views.assemble(*views.notes_block(n))


@query("""WITH f AS (SELECT 'Product:' || p_partkey AS node_id, unnest([{'o': 1, 'key': 'name', 'value': p_name}, {'o': 2, 'key': 'brand', 'value': p_brand}, {'o': 3, 'key': 'type', 'value': p_type}, {'o': 4, 'key': 'note', 'value': ''}, {'o': 5, 'key': 'size', 'value': p_size::VARCHAR}], recursive := true) FROM part)
 SELECT node_id, key, substring(value, 1, 20) AS value, rn FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY o) AS rn FROM f WHERE value <> '') WHERE rn <= 3""")
def q_filtered_properties(spark, d):
    cells = [("name", F.col("p_name")), ("brand", F.col("p_brand")), ("type", F.col("p_type")), ("note", F.lit("")), ("size", F.col("p_size").cast("string"))]
    f = table(spark, d, "part").select(T.node_id("Product", F.col("p_partkey")).alias("node_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), v.alias("value")) for i, (k, v) in enumerate(cells)])).alias("c")).select("node_id", "c.*")
    return pages.filtered_properties(f, 3, 20).withColumn("rn", F.col("rn").cast("long"))


# ---- the write path


@query("""SELECT 'Employee:' || c_custkey AS node_id, 'level' AS key, c_mktsegment AS existing_value, 'L' || c_custkey % 4 AS new_value, 'auto_resolved' AS status, 'new' AS winner FROM customer WHERE c_custkey % 3 = 0""")
def q_ingest_conflicts(spark, d):
    """Employees ingested again, every third with another level: a later record of the same source wins."""
    emp = _records(spark, d, "employees")["employees"]
    again = emp.withColumn("Level", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("L"), (F.col("ord") % 4).cast("string"))).otherwise(F.col("Level")))
    e = Engine.ingest({"employees": again}, base=Engine.ingest({"employees": emp}))
    return e.conflicts("auto_resolved").select("node_id", "key", "existing_value", "new_value", "status", "winner")


@query("""SELECT 'Employee:' || c_custkey AS node_id, CASE WHEN c_custkey = 1 THEN 'Head of all' ELSE c_mktsegment END AS level, CASE WHEN c_custkey = 1 THEN 'Human' ELSE 'Human_Resource_Management' END AS source_system, c_custkey = 1 AS on_page FROM customer""")
def q_edit_visible(spark, d):
    """After an edit by hand the facts have it, with its source, and so has the page."""
    e = _engine(spark, d, "employees").edit("Employee:1", "level", "Head of all", at=2**62)
    page = e.page("people", "1").select("node_id", F.contains("page", F.lit("- Level: Head of all _(Human)_")).alias("p"))
    f = e.facts.where("key = 'level'").join(page, "node_id", "left")
    return f.select("node_id", F.col("value").alias("level"), "source_system", F.coalesce("p", F.lit(False)).alias("on_page"))


@query(f"WITH {R.FOLD} SELECT node_id, key, ord, status FROM f7 WHERE status = 'pending_review'")
def q_list_conflicts(spark, d):
    return upsert.list_conflicts(upsert.conflicts(R._folded(spark, d)), "pending_review").select("node_id", "key", "ord", "status")


@query(f"""WITH {R.FOLD}, s AS (SELECT node_id, key, arg_max(set_to, ord) FILTER (WHERE set_to IS NOT NULL) AS value FROM f7 GROUP BY 1, 2),
 w AS (SELECT node_id, key, arg_max(value, ord) AS v FROM f7 WHERE status = 'pending_review' AND ord % 4 = 0 GROUP BY 1, 2)
 SELECT node_id, key, coalesce(v, value) AS value FROM s LEFT JOIN w USING (node_id, key)""")
def q_apply_resolutions(spark, d):
    """The state after half of the pending conflicts were settled, every other one for the new value."""
    f = R._folded(spark, d)
    c = upsert.conflicts(f)
    # conflicts settled by hand at ingest have their value already
    chosen = c.where("status = 'pending_review' and ord % 2 = 0").select("node_id", "key", "ord", F.when(F.col("ord") % 4 == 0, "new").otherwise("existing").alias("winner"))
    done = upsert.resolve_manually(c.where("status = 'pending_review'"), chosen)
    return upsert.apply_resolutions(upsert.state(f), done)


# ---- after decisions


def _chain(spark, d) -> tuple[DataFrame, DataFrame]:
    """same_as edges between neighbouring customers both ways, and clusters of five."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    a = c.select(T.node_id("Client", k).alias("src"), T.node_id("Client", k + 1).alias("dst"), F.lit("same_as").alias("rel_type"), F.lit("needs_review").alias("status"))
    e = a.unionByName(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type", "status"))
    return e, c.select(T.node_id("Client", k).alias("node_id"), F.floor(k / 5).cast("string").alias("cluster"), k.alias("k"))


_CHAIN = """e AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer UNION ALL SELECT c_custkey + 1, c_custkey FROM customer), c AS (SELECT c_custkey AS k FROM customer),
 j AS (SELECT a, b, x.k IS NOT NULL AND y.k IS NOT NULL AND a // 5 = b // 5 AND (a // 5) % 2 = 0 AS hit FROM e LEFT JOIN c x ON x.k = a LEFT JOIN c y ON y.k = b)"""


@query(f"WITH {_CHAIN} SELECT 'Client:' || a AS src, 'Client:' || b AS dst, 'same_as' AS rel_type FROM j WHERE NOT hit")
def q_remove_same_as(spark, d):
    e, m = _chain(spark, d)
    return resolve.remove_same_as(e, m.where("cast(cluster as int) % 2 = 0").select("node_id", "cluster")).select("src", "dst", "rel_type")


@query(f"WITH {_CHAIN} SELECT 'Client:' || a AS src, 'Client:' || b AS dst, CASE WHEN hit THEN 'auto_linked' ELSE 'needs_review' END AS status FROM j")
def q_upgrade_same_as(spark, d):
    e, m = _chain(spark, d)
    return resolve.upgrade_same_as(e, m.where("cast(cluster as int) % 2 = 0").select("node_id", "cluster")).select("src", "dst", "status")


@query(f"""WITH {_CHAIN} SELECT 'Client:' || a AS src, 'Client:' || b AS dst, CASE WHEN x.k IS NOT NULL AND y.k IS NOT NULL AND a // 5 = b // 5 AND (a // 5) % 3 = 1 THEN 'auto_linked' ELSE 'needs_review' END AS status
 FROM e LEFT JOIN c x ON x.k = a LEFT JOIN c y ON y.k = b WHERE NOT (x.k IS NOT NULL AND y.k IS NOT NULL AND a // 5 = b // 5 AND (a // 5) % 3 = 0)""")
def q_dispatch_actions(spark, d):
    """Every third cluster is taken apart, every third linked, the rest is left."""
    e, m = _chain(spark, d)
    n = F.col("cluster").cast("int")
    members = m.select(n.alias("conflict_ix"), "node_id")
    act = members.select("conflict_ix").distinct().withColumn("action", F.when(F.col("conflict_ix") % 3 == 0, "remove_same_as_edges").when(F.col("conflict_ix") % 3 == 1, "upgrade_to_auto_linked").otherwise("no_action"))
    return decisions.apply_actions(e, m.select("node_id"), members, act)[0].select("src", "dst", "status")


@query(f"WITH {R._CASES} SELECT id AS conflict_ix, CASE WHEN id % 2 = 1 THEN 'pending_review' WHEN action <> 'no_action' AND risk < 5 THEN 'llm_resolved' ELSE 'pending_human_after_llm' END AS status FROM r")
def q_annotate_conflicts(spark, d):
    a = decisions.assess(R._cases(spark, d)).withColumnRenamed("id", "conflict_ix")
    c = a.select("conflict_ix", F.lit("pending_review").alias("status"))
    return decisions.annotate(c, a.where("conflict_ix % 2 = 0")).select("conflict_ix", "status")


@query(f"""WITH {R._CASES}, x AS (SELECT *, CASE WHEN action <> 'no_action' AND risk < 5 THEN 'auto_act' ELSE 'escalate' END AS rec FROM r)
 SELECT 'decided' AS metric, '' AS name, count(*)::DOUBLE AS value FROM x UNION ALL SELECT 'mean_confidence', '', round(avg(confidence), 6) FROM x UNION ALL SELECT 'mean_risk', '', round(avg(risk), 6) FROM x
 UNION ALL SELECT 'auto_acted', '', count(*) FILTER (WHERE rec = 'auto_act')::DOUBLE FROM x UNION ALL SELECT 'decision', decision, count(*)::DOUBLE FROM x GROUP BY 2
 UNION ALL SELECT 'action', action, count(*)::DOUBLE FROM x GROUP BY 2 UNION ALL SELECT 'recommended', rec, count(*)::DOUBLE FROM x GROUP BY 2""")
def q_decision_stats(spark, d):
    return decisions.run_stats(decisions.assess(R._cases(spark, d))).withColumn("value", F.round("value", 6))


@query(f"""WITH RECURSIVE {R._DECISIONS}, b AS (SELECT block, count(*) AS n FROM (SELECT substring(nn, 1, 4) AS block FROM parties) GROUP BY 1)
 SELECT 'candidates' AS metric, count(*) AS n FROM parties UNION ALL SELECT 'blocks', count(*) FROM b UNION ALL SELECT 'pairs_compared', sum(n * (n - 1) // 2)::BIGINT FROM b UNION ALL SELECT 'pairs_linked', count(*) FROM kept
 UNION ALL SELECT 'clusters', count(*) FROM decided UNION ALL SELECT 'merged_clusters', count(*) FROM decided WHERE decision = 'merge' UNION ALL SELECT 'nodes_removed', coalesce(sum(size - 1), 0)::BIGINT FROM decided WHERE decision = 'merge'
 UNION ALL SELECT 'auto_linked_clusters', count(*) FROM decided WHERE decision = 'auto_link' UNION ALL SELECT 'review_clusters', count(*) FROM decided WHERE decision = 'review'
 UNION ALL SELECT 'same_as_edges', coalesce(sum(size * (size - 1)), 0)::BIGINT FROM decided WHERE decision <> 'merge'""")
def q_resolver_stats(spark, d):
    c, s, m = R._clusters(spark, d)
    return resolve.run_stats(c, s, Scratch(spark).save(resolve.decide(c, m, s), "decisions"))


@query(f"""WITH {R._NAMES} SELECT 'Product:' || keep AS node_id, p_brand AS source_system, '' AS file FROM part JOIN nc USING (p_partkey)
 UNION ALL SELECT 'Product:' || keep, 'resolver', 'merged_in:' || string_agg('Product:' || p_partkey, ',' ORDER BY 'Product:' || p_partkey) FROM nc WHERE keep <> p_partkey GROUP BY keep""")
def q_merge_provenance(spark, d):
    """Products of one name folded into one node, which takes over their provenance."""
    p = table(spark, d, "part").select(T.node_id("Product", F.col("p_partkey")).alias("node_id"), F.col("p_brand").alias("source_system"), F.lit("").alias("file"))
    g = R._g(spark, d)
    return resolve.merge_graph(g.nodes, g.edges, p.select("node_id", F.lit("k").alias("key"), F.lit("v").alias("value")), p, R._merged(spark, d))[3]


@query("""WITH c AS (SELECT c_nationkey::BIGINT AS cluster, c_mktsegment AS name, count(*) AS n, min(c_custkey) AS o FROM customer GROUP BY 1, 2)
 SELECT cluster, arg_min(name, {'n': -n, 'o': o}) AS name FROM c GROUP BY 1""")
def q_headlines(spark, d):
    return decisions.headline(table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("cluster"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("ord")))


@query("""WITH c AS (SELECT 'user_id' AS field, 'integer' AS kind FROM events WHERE user_id IS NOT NULL UNION ALL SELECT 'value', 'float' FROM events WHERE value IS NOT NULL
 UNION ALL SELECT 'event_type', CASE WHEN regexp_full_match(trim(event_type), '[a-z]{3,8}') THEN 'short_code' ELSE 'string' END FROM events WHERE event_type <> '' UNION ALL SELECT 'ts', 'date' FROM events WHERE ts IS NOT NULL)
 SELECT field, kind, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, kind) AS rn FROM c GROUP BY 1, 2""")
def q_type_distribution(spark, d):
    return profile.type_distribution(table(spark, d, "events").select("user_id", "value", "event_type", "ts")).withColumn("rn", F.col("rn").cast("long"))


_FILES = {"employees.json": "Employee", "data/policies.csv": "Policy", "it_tickets.json": "It", "bus.csv": "Bus", "gas.json": "Gas", "sales-2024.json": "Sale", "x/Companies_old.json": "Company"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _FILES.items()) + ") t(file, entity)")
def q_entity_types(spark, d):
    return spark.createDataFrame([(k,) for k in _FILES], "file string").select("file", T.entity_type(F.col("file")).alias("entity"))


@query("SELECT event_id, CASE WHEN m < 60 THEN m || 'm ago' WHEN m < 2880 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS age FROM (SELECT event_id, floor(epoch((SELECT max(ts) FROM events) - ts) / 60)::BIGINT AS m FROM events)")
def q_age_labels(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    return e.join(F.broadcast(now)).select("event_id", T.age_label(F.col("now"), F.col("ts")).alias("age"))
