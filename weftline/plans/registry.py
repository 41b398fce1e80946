"""Registered queries of the context-graph engine, each with DuckDB SQL for comparison where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import dims
from weftline.functions import text as T
from weftline.operators import decisions, profile, resolve, review, search, upsert, views
from weftline.operators.graph import ContextGraph, last_wins
from weftline.runtime import ship_package, table
from weftline.sources import testdata

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, without the leading q_."""

    def put(f):
        name = f.__name__.removeprefix("q_")

        def call(spark: SparkSession, d: str) -> DataFrame:
            ship_package(spark)
            return f(spark, d)

        QUERIES[name] = call
        if sql:
            ORACLES[name] = sql
        return f

    return put


# ---- the graph, in SQL

NODES = """nodes AS (
 SELECT 'Customer:' || c_custkey AS node_id, 'Customer' AS node_type, c_custkey::BIGINT AS ord, c_name AS title, c_mktsegment AS summary FROM customer
 UNION ALL SELECT 'Vendor:' || s_suppkey, 'Vendor', s_suppkey, s_name, '' FROM supplier
 UNION ALL SELECT 'Product:' || p_partkey, 'Product', p_partkey, p_name, p_brand FROM part
 UNION ALL SELECT 'Sale:' || o_orderkey, 'Sale', o_orderkey, o_orderkey::VARCHAR, o_orderpriority FROM orders
 UNION ALL SELECT 'Department:' || n_nationkey, 'Department', n_nationkey, n_name, '' FROM nation
 UNION ALL SELECT DISTINCT 'EmailThread:' || conv_id, 'EmailThread', conv_id, conv_id::VARCHAR, '' FROM conversations)"""
EDGES = """written AS (
 SELECT 'Customer:' || c_custkey AS src, 'Department:' || c_nationkey AS dst, 'works_in' AS rel_type, c_custkey::BIGINT AS ord FROM customer
 UNION ALL SELECT 'Vendor:' || s_suppkey, 'Department:' || s_nationkey, 'works_in', s_suppkey FROM supplier
 UNION ALL SELECT 'Customer:' || o_custkey, 'Sale:' || o_orderkey, 'purchased', o_orderkey FROM orders
 UNION ALL SELECT 'Sale:' || l_orderkey, 'Product:' || l_partkey, 'product_in_sale', l_linenumber FROM lineitem),
edges AS (SELECT src, dst, rel_type, max(ord) AS ord FROM written GROUP BY 1, 2, 3)"""
WAYS = """ways AS (SELECT src AS node_id, dst AS other, rel_type, 'outgoing' AS direction, ord FROM edges
 UNION ALL SELECT dst, src, rel_type, 'incoming', ord FROM edges)"""


def _g(spark: SparkSession, d: str) -> ContextGraph:
    return testdata.graph(spark, d)


# ---- graph lookups


@query(f"WITH {NODES} SELECT node_type, count(*) AS n FROM nodes GROUP BY 1")
def q_graph_nodes_by_type(spark, d):
    return _g(spark, d).nodes_by_type()


@query(f"WITH {EDGES} SELECT rel_type, count(*) AS n FROM edges GROUP BY 1")
def q_graph_edges_by_rel(spark, d):
    return _g(spark, d).edges_by_rel()


@query(f"""WITH {NODES}, {EDGES} SELECT 'nodes' AS metric, '' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', '', count(*) FROM edges
 UNION ALL SELECT 'nodes_by_type', node_type, count(*) FROM nodes GROUP BY node_type UNION ALL SELECT 'edges_by_rel', rel_type, count(*) FROM edges GROUP BY rel_type""")
def q_graph_stats(spark, d):
    return _g(spark, d).stats()


@query(f"WITH {NODES} SELECT node_id, node_type, title FROM nodes WHERE node_id = 'Customer:7'")
def q_get_node(spark, d):
    return _g(spark, d).node("Customer:7").select("node_id", "node_type", "title")


@query(f"WITH {NODES} SELECT node_id, ord, (SELECT count(*) FROM nodes WHERE node_type = 'Product') AS total FROM nodes WHERE node_type = 'Product' ORDER BY ord LIMIT 25 OFFSET 50")
def q_entities_page(spark, d):
    return _g(spark, d).page("Product", 50, 25).select("node_id", "ord", "total")


@query(f"""WITH {NODES}, {EDGES}, {WAYS} SELECT w.node_id, w.other, w.rel_type, w.direction, n.node_type AS other_type FROM ways w JOIN nodes n ON n.node_id = w.other
 WHERE w.node_id IN ('Customer:1', 'Sale:1', 'Department:3')""")
def q_neighbors(spark, d):
    ids = spark.createDataFrame([("Customer:1",), ("Sale:1",), ("Department:3",)], "node_id string")
    return _g(spark, d).neighbours(F.broadcast(ids)).select("node_id", "other", "rel_type", "direction", "other_type")


@query(f"""WITH {NODES}, {EDGES} SELECT e.src AS node_id, e.dst AS other, n.title AS other_title FROM edges e JOIN nodes n ON n.node_id = e.dst WHERE e.rel_type = 'product_in_sale'""")
def q_neighbors_by_rel(spark, d):
    g = _g(spark, d)
    return g.neighbours(g.nodes.where("node_type = 'Sale'"), "product_in_sale", "outgoing").select("node_id", "other", "other_title")


@query(f"WITH {EDGES}, {WAYS} SELECT node_id, count(*) AS degree, least(count(*), 20) / 100.0::DOUBLE AS bonus FROM ways GROUP BY 1")
def q_degree(spark, d):
    return _g(spark, d).degree().select("node_id", "degree", (F.least("degree", F.lit(20)) / 100.0).alias("bonus"))


@query("""SELECT l_orderkey, l_partkey, max(l_linenumber)::BIGINT AS ord, count(*) AS written FROM lineitem GROUP BY 1, 2""")
def q_edge_last_wins(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("long").alias("ord"))
    kept = last_wins(li, ("l_orderkey", "l_partkey"))
    n = li.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("written"))
    return kept.join(n, ["l_orderkey", "l_partkey"])


@query(f"WITH {NODES} SELECT node_id, title FROM nodes WHERE contains(lower(title), 'supplier#00000000') ORDER BY ord LIMIT 20")
def q_substring_search(spark, d):
    return _g(spark, d).substring_search("Supplier#00000000", 20).select("node_id", "title")


@query(f"""WITH RECURSIVE {EDGES}, {WAYS}, w AS (SELECT node_id, other, CASE direction WHEN 'outgoing' THEN 0 ELSE 1 END AS way, ord, rel_type FROM ways),
 h1 AS (SELECT other, min({{'r': 0, 'way': way, 'ord': ord, 'rel': rel_type}}) AS o FROM w WHERE node_id = 'Customer:1' AND other <> 'Customer:1' GROUP BY other),
 r1 AS (SELECT other, row_number() OVER (ORDER BY o, other) AS rank FROM (SELECT * FROM h1 ORDER BY o, other LIMIT 12)),
 h2 AS (SELECT w.other, min({{'r': r1.rank, 'way': way, 'ord': ord, 'rel': rel_type}}) AS o FROM w JOIN r1 ON w.node_id = r1.other
        WHERE w.other <> 'Customer:1' AND w.other NOT IN (SELECT other FROM r1) GROUP BY w.other),
 r2 AS (SELECT other, (SELECT max(rank) FROM r1) + row_number() OVER (ORDER BY o, other) AS rank FROM h2)
 SELECT other AS node_id, 1 AS depth, rank::INT AS rank FROM r1 UNION ALL SELECT other, 2, rank::INT FROM r2 WHERE rank <= 12""")
def q_related_bfs(spark, d):
    return _g(spark, d).related("Customer:1", hops=2, limit=12)


_LAYERS = f"""{NODES}, {EDGES}, {WAYS},
 core AS (SELECT 'Customer:1' AS node_id UNION ALL SELECT 'Customer:2'),
 direct AS (SELECT DISTINCT other AS node_id FROM ways SEMI JOIN core USING (node_id) ANTI JOIN core c ON c.node_id = other),
 context AS (SELECT DISTINCT other AS node_id FROM ways SEMI JOIN direct USING (node_id) ANTI JOIN direct d ON d.node_id = other ANTI JOIN core c ON c.node_id = other),
 known AS (SELECT node_id, 'core' AS layer FROM core UNION ALL SELECT node_id, 'direct' FROM direct UNION ALL SELECT node_id, 'context' FROM context),
 layers AS (SELECT node_id, coalesce(layer, 'ambient') AS layer FROM nodes LEFT JOIN known USING (node_id))"""


def _focus(spark):
    return spark.createDataFrame([("Customer:1",), ("Customer:2",)], "node_id string")


@query(f"WITH {_LAYERS} SELECT node_id, layer FROM layers")
def q_hop_layers(spark, d):
    return _g(spark, d).layers(_focus(spark))


@query(f"""WITH {_LAYERS} SELECT e.src, e.dst, e.rel_type, CASE WHEN a.layer = 'core' OR b.layer = 'core' OR (a.layer = 'direct' AND b.layer = 'direct') THEN 'strong' ELSE 'soft' END AS strength
 FROM edges e JOIN layers a ON a.node_id = e.src JOIN layers b ON b.node_id = e.dst""")
def q_link_strength(spark, d):
    g = _g(spark, d)
    return g.link_strength(g.layers(_focus(spark)))


# ---- views

_HISTORY = """last AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n_sales, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders),
 first_item AS (SELECT l_orderkey, min({'ord': l_linenumber::BIGINT, 'product': l_partkey}) AS i FROM lineitem GROUP BY 1)"""


def _history(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("sale"), F.col("o_orderdate").alias("date"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sale"), F.col("l_partkey").alias("product"), F.col("l_linenumber").cast("long").alias("ord"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("product"), F.col("p_name").alias("name"))
    return views.purchase_history(o, li, p)


@query(f"""WITH {_HISTORY} SELECT o_custkey AS customer, rn, o_orderkey AS sale, strftime(o_orderdate, '%Y-%m-%d') AS date, i.product AS product, p_name AS name, n_sales
 FROM last LEFT JOIN first_item ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = i.product WHERE rn <= 20""")
def q_customer_purchase_history(spark, d):
    return _history(spark, d).withColumn("date", F.date_format("date", "yyyy-MM-dd")).withColumn("rn", F.col("rn").cast("long"))


@query(f"""WITH {_HISTORY}, l AS (
 SELECT c_custkey AS k, 0 AS s, 0 AS n, '# ' || c_name || ' (' || c_custkey || ')' || chr(10) || chr(10) || '## Basics' || chr(10) || '- ID: ' || c_custkey || chr(10) || '- Name: ' || c_name || chr(10) AS t FROM customer
 UNION ALL SELECT o_custkey, 1, 0, '## Purchases (' || n_sales || ' orders)' || chr(10) || '| Date | Product |' || chr(10) || '|---|---|' FROM last WHERE rn = 1
 UNION ALL SELECT o_custkey, 1, rn, '| ' || strftime(o_orderdate, '%Y-%m-%d') || ' | ' || coalesce('[' || p_name || '](/products/' || i.product || ')', '') || ' |'
   FROM last LEFT JOIN first_item ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = i.product WHERE rn <= 20
 UNION ALL SELECT o_custkey, 1, 1000, chr(10) || '*... and ' || (n_sales - 20) || ' more*' FROM last WHERE rn = 1 AND n_sales > 20
 UNION ALL SELECT c_custkey, 9, 0, chr(10) || '## Sources' || chr(10) || '- Customer_Relation_Management' FROM customer)
 SELECT 'Customer:' || k AS node_id, string_agg(t, chr(10) ORDER BY s, n) AS page FROM l WHERE k IN (SELECT c_custkey FROM customer) GROUP BY k""")
def q_customer_pages(spark, d):
    key = F.col("c_custkey").cast("string")
    c = table(spark, d, "customer").select(T.node_id("Customer", F.col("c_custkey")).alias("node_id"), key.alias("key"), F.col("c_name").alias("name"))
    h = _history(spark, d).withColumn("customer", F.col("customer").cast("string")).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return views.customer_pages(c, h, c.select("node_id", F.lit(dims.CRM).alias("source")))


@query("""SELECT n_nationkey::BIGINT AS team, c_custkey AS member, c_name AS name, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_name, c_custkey) AS rn FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def q_team_members(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("team"), F.col("c_custkey").alias("member"), F.col("c_name").alias("name"))
    return views.team_members(c, table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("team"))).withColumn("rn", F.col("rn").cast("long"))


@query("""SELECT c_nationkey::BIGINT AS team, count(DISTINCT c_custkey) AS n_members, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_sent, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_received,
 count(*) FILTER (WHERE o_orderstatus = 'P') AS n_raised FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def q_team_activity(spark, d):
    m = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("team"), F.col("c_custkey").alias("member"))
    kind = F.when(F.col("o_orderstatus") == "O", "sent").when(F.col("o_orderstatus") == "F", "received").when(F.col("o_orderstatus") == "P", "raised")
    return views.team_activity(m, table(spark, d, "orders").select(F.col("o_custkey").alias("member"), kind.alias("kind")))


def _mails(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("ord"), F.col("role").alias("who"), F.col("text").alias("body"))


@query("""SELECT conv_id AS thread, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, turn AS ord, role AS who, regexp_replace(substring(text, 1, 180), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS snippet FROM conversations""")
def q_thread_timeline(spark, d):
    return views.thread_timeline(_mails(spark, d)).withColumn("rn", F.col("rn").cast("long"))


_THREADS = "t AS (SELECT conv_id AS thread, count(*) AS n_emails, count(DISTINCT role) AS n_participants, max(turn) AS latest FROM conversations GROUP BY 1)"


@query(f"WITH {_THREADS} SELECT * FROM t ORDER BY n_emails DESC, thread DESC LIMIT 200")
def q_thread_top200(spark, d):
    return views.top_threads(_mails(spark, d))


@query(f"WITH {_THREADS} SELECT * FROM t WHERE n_emails >= 3 AND n_participants >= 2")
def q_projects(spark, d):
    return views.projects(_mails(spark, d))


@query("""SELECT user_id, event_id, rn, greatest(n - 10, 0) AS more FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn <= 10""")
def q_recent_activity(spark, d):
    return views.recent(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id").withColumn("rn", F.col("rn").cast("long"))


@query("SELECT o_orderkey AS thread, n_name AS department, count(*) AS n FROM (SELECT o_orderkey, o_custkey AS who FROM orders UNION ALL SELECT o_orderkey, o_custkey % 100 + 1 FROM orders) JOIN customer ON c_custkey = who JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def q_department_touches(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("thread"), F.col("o_custkey").alias("sender"), (F.col("o_custkey") % 100 + 1).alias("recipient"))
    dep = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("who"), F.col("n_name").alias("department"))
    return views.department_touches(e, dep)


@query("""WITH p AS (SELECT DISTINCT c_nationkey AS thread, c_custkey AS who FROM customer), j AS (SELECT thread, o_orderkey AS ticket, min({'a': who, 'b': o_orderkey}) AS o FROM p JOIN orders ON o_custkey = who GROUP BY 1, 2)
 SELECT thread, ticket, rn, group_size FROM (SELECT thread, ticket, row_number() OVER (PARTITION BY thread ORDER BY o, ticket) AS rn, count(*) OVER (PARTITION BY thread) AS group_size FROM j) WHERE rn <= 25""")
def q_related_tickets(spark, d):
    p = table(spark, d, "customer").select(F.col("c_nationkey").alias("thread"), F.col("c_custkey").alias("who"), F.col("c_custkey").alias("ord"))
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("ticket"), F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("tord"))
    return views.related_tickets(p, t).withColumn("rn", F.col("rn").cast("long"))


@query(f"WITH {NODES} SELECT '/products/' || ord AS path, title AS label FROM nodes WHERE node_type = 'Product'")
def q_dir_products(spark, d):
    return views.listing(_g(spark, d).nodes, "products", "Product").select("path", "label")


@query("SELECT '/teams/' || n_nationkey AS path, n_name AS label, count(c_custkey) AS n_members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def q_dir_teams(spark, d):
    teams = views.listing(_g(spark, d).nodes, "teams", "Department")
    n = table(spark, d, "customer").groupBy(F.concat(F.lit("/teams/"), F.col("c_nationkey").cast("string")).alias("path")).agg(F.count("*").alias("n_members"))
    return teams.join(n, "path", "left").select("path", "label", F.coalesce("n_members", F.lit(0)).alias("n_members"))


@query(f"""WITH {NODES}, s(path, t) AS (VALUES {', '.join(f"('/{k}', '{v}')" for k, v in dims.SECTIONS.items())}) SELECT path, count(node_id) AS n FROM s LEFT JOIN nodes ON node_type = t GROUP BY 1""")
def q_dir_root(spark, d):
    return views.root_listing(_g(spark, d).nodes_by_type(), dims.SECTIONS)


# ---- upserts

_AUTH, _CANON = (lambda c: dims.sql_case(dims.AUTHORITY, c, "0")), (lambda c: dims.sql_case(dims.CANONICAL, c))
_SOURCES = "[" + ", ".join(f"'{s}'" for s in testdata.FEED_SOURCES) + "]"
FOLD = f"""feed AS (SELECT CASE user_id % 3 WHEN 0 THEN 'Employee' WHEN 1 THEN 'Customer' ELSE 'Email' END AS node_type, user_id, event_type AS key, floor(value)::BIGINT::VARCHAR AS value,
  {_SOURCES}[event_id % {len(testdata.FEED_SOURCES)} + 1] AS source_system, event_id AS ord, event_id % 97 = 0 AS human FROM events),
 f1 AS (SELECT *, node_type || ':' || user_id AS node_id FROM feed),
 f2 AS (SELECT *, first_value(source_system) OVER n AS first_source, min(ord) OVER n2 = ord AS node_is_new, row_number() OVER k = 1 AS is_first,
  coalesce(bool_or(human) OVER (PARTITION BY node_id, key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS edited
  FROM f1 WINDOW n AS (PARTITION BY node_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), n2 AS (PARTITION BY node_id), k AS (PARTITION BY node_id, key ORDER BY ord)),
 f3 AS (SELECT *, CASE WHEN edited THEN 'Human' ELSE first_source END AS es, CASE WHEN human THEN 'Human' ELSE source_system END AS ns FROM f2),
 f4 AS (SELECT *, CASE WHEN es = ns THEN 'new' WHEN es = {_CANON('node_type')} THEN 'existing' WHEN ns = {_CANON('node_type')} THEN 'new'
   WHEN abs({_AUTH('es')} - {_AUTH('ns')}) >= 20 THEN CASE WHEN {_AUTH('es')} > {_AUTH('ns')} THEN 'existing' ELSE 'new' END END AS w FROM f3),
 f5 AS (SELECT *, CASE WHEN is_first OR human OR coalesce(w = 'new', false) THEN value END AS set_to FROM f4),
 f6 AS (SELECT *, last_value(set_to IGNORE NULLS) OVER (PARTITION BY node_id, key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current FROM f5),
 f7 AS (SELECT *, CASE WHEN node_is_new THEN 'created' WHEN is_first THEN 'added' WHEN current = value THEN 'unchanged' WHEN human OR coalesce(w = 'new', false) THEN 'updated' WHEN w = 'existing' THEN 'kept' ELSE 'pending' END AS outcome,
   CASE WHEN is_first OR current = value THEN NULL WHEN human THEN 'manually_resolved' WHEN w IS NULL THEN 'pending_review' ELSE 'auto_resolved' END AS status,
   CASE WHEN is_first OR current = value THEN NULL WHEN human THEN 'new' ELSE w END AS winner FROM f6)"""


def _folded(spark, d) -> DataFrame:
    return upsert.fold(testdata.change_feed(spark, d))


@query(f"WITH {FOLD} SELECT node_id, key, arg_max(set_to, ord) FILTER (WHERE set_to IS NOT NULL) AS value FROM f7 GROUP BY 1, 2")
def q_upsert_state(spark, d):
    return upsert.state(_folded(spark, d))


@query(f"WITH {FOLD} SELECT node_id, key, outcome AS kind, current AS old_value, value AS new_value, source_system, ord FROM f7 WHERE outcome IN ('added', 'updated')")
def q_upsert_change_log(spark, d):
    return upsert.change_log(_folded(spark, d))


@query(f"WITH {FOLD} SELECT node_id, key, current AS existing_value, value AS new_value, es AS existing_source, ns AS new_source, status, winner, ord FROM f7 WHERE status IS NOT NULL")
def q_upsert_conflicts(spark, d):
    return upsert.conflicts(_folded(spark, d))


@query(f"WITH {FOLD} SELECT outcome, coalesce(status, '-') AS status, count(*) AS n FROM f7 GROUP BY 1, 2")
def q_run_summary(spark, d):
    return _folded(spark, d).groupBy("outcome", F.coalesce("status", F.lit("-")).alias("status")).agg(F.count("*").alias("n"))


@query(f"""WITH {FOLD} SELECT node_id, key, ord, CASE WHEN status = 'pending_review' AND ord % 2 = 0 THEN 'manually_resolved' ELSE status END AS status,
 CASE WHEN status = 'pending_review' AND ord % 2 = 0 THEN CASE WHEN ord % 4 = 0 THEN 'new' ELSE 'existing' END ELSE winner END AS winner FROM f7 WHERE status IS NOT NULL""")
def q_resolve_manually(spark, d):
    c = upsert.conflicts(_folded(spark, d))
    choices = c.where("ord % 2 = 0").select("node_id", "key", "ord", F.when(F.col("ord") % 4 == 0, "new").otherwise("existing").alias("winner"))
    return upsert.resolve_manually(c, choices).select("node_id", "key", "ord", "status", "winner")


_ALL_SOURCES = [*sorted(dims.AUTHORITY), "Elsewhere", None]
_KINDS = ["Employee", "Customer", "Client", "ITTicket", "Policy"]
_VALUES = ", ".join("(" + ("NULL" if s is None else f"'{s}'") + ")" for s in _ALL_SOURCES)


@query(f"""WITH s(v) AS (VALUES {_VALUES}), k(node_type) AS (VALUES {', '.join(f"('{x}')" for x in _KINDS)}), m AS (SELECT a.v AS es, b.v AS ns, node_type FROM s a, s b, k),
 w AS (SELECT *, CASE WHEN es IS NULL OR ns IS NULL THEN NULL WHEN es = ns THEN 'new' WHEN es = {_CANON('node_type')} THEN 'existing' WHEN ns = {_CANON('node_type')} THEN 'new'
  WHEN abs({_AUTH('es')} - {_AUTH('ns')}) >= 20 THEN CASE WHEN {_AUTH('es')} > {_AUTH('ns')} THEN 'existing' ELSE 'new' END END AS winner FROM m)
 SELECT es AS existing_source, ns AS new_source, node_type, CASE WHEN winner IS NULL THEN 'pending_review' ELSE 'auto_resolved' END AS status, winner FROM w""")
def q_auto_resolve_matrix(spark, d):
    rows = [(a, b, k) for a in _ALL_SOURCES for b in _ALL_SOURCES for k in _KINDS]
    m = spark.createDataFrame(rows, "existing_source string, new_source string, node_type string")
    return m.withColumn("v", upsert.verdict(F.col("existing_source"), F.col("new_source"), F.col("node_type"))).select("existing_source", "new_source", "node_type", "v.status", "v.winner")


# ---- scalar functions


@query("""WITH x AS (SELECT p_partkey, p_name, lpad((p_partkey % 90000 + 10000)::VARCHAR, 5, '0') AS z FROM part), y AS (SELECT *, lower('The ' || p_name || ', Inc. & Partner GmbH') AS n, lower(p_name || ' Apt. ' || p_partkey || 'b, ' || z || '-6789 Suite 9') AS a FROM x)
 SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(n, '\\b(ag|associates|company|corporation|corp|co|gmbh|group|holdings?|inc|kgaa|llc|ltd|partners?|plc|pte|pvt|sa)\\b\\.?', '', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS business,
 trim(regexp_replace(regexp_replace(regexp_replace(a, '\\b(apartment|apt|suite|ste|unit|box|psc)\\.?\\s*[\\w-]+', '', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS address,
 z AS zip, right('1325555' || z, 10) AS phone, 'u' || p_partkey || '@' || regexp_extract(lower(p_name), '^[a-z]+') || '.org' AS email, '1299' || p_partkey AS price FROM y""")
def q_normalise_text(spark, d):
    """The normalisers over names made from those of all products; normalise_whole_text has whole documents."""
    k = F.col("p_partkey").cast("string")
    z = F.lpad((F.col("p_partkey") % 90000 + 10000).cast("string"), 5, "0")
    return table(spark, d, "part").select(
        "p_partkey", T.business_name(F.concat(F.lit("The "), "p_name", F.lit(", Inc. & Partner GmbH"))).alias("business"), T.address(F.concat("p_name", F.lit(" Apt. "), k, F.lit("b, "), z, F.lit("-6789 Suite 9"))).alias("address"),
        T.zip_code(F.concat("p_name", F.lit(" "), z, F.lit("-6789"))).alias("zip"), T.phone(F.concat(F.lit("+1 (325) 555-"), z)).alias("phone"),
        T.email(F.concat(F.lit(" U"), k, F.lit("@"), F.regexp_extract("p_name", "^[A-Za-z]+", 0), F.lit(".Org "))).alias("email"), T.clean_price(F.concat(F.lit("₹1,2 99"), k)).alias("price"),
    )


@query()
def q_normalise_whole_text(spark, d):
    """The normalisers over the whole text of every document, null as empty; DuckDB's \\b and \\w know only ASCII, so there is no SQL."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return table(spark, d, "documents").select("doc_id", T.business_name(t).alias("business"), T.address(t).alias("address"), T.zip_code(t).alias("zip"), T.phone(t).alias("phone"), T.email(t).alias("email"), T.clean_price(t).alias("price"))


@query("""SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(f), '\\.[^.]*$', ''), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'policy') AS slug,
 CASE WHEN regexp_matches(f, 'data|privacy|gdpr') THEN 'Data & Privacy' WHEN regexp_matches(f, 'security|password|breach') THEN 'Security' WHEN regexp_matches(f, 'leave|medical') THEN 'People & HR' WHEN regexp_matches(f, 'risk') THEN 'Risk' END AS category
 FROM (SELECT doc_id, lower(lang || '_' || source || ' ' || ['Data policy', 'Password rules', 'Leave', 'Risk register', 'Other'][doc_id % 5 + 1] || '.MD') AS f FROM documents)""")
def q_policy_fields(spark, d):
    pick = F.element_at(F.array(*[F.lit(x) for x in ("Data policy", "Password rules", "Leave", "Risk register", "Other")]), (F.col("doc_id") % 5 + 1).cast("int"))
    f = table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("_"), "source", F.lit(" "), pick, F.lit(".MD")).alias("f"))
    return f.select("doc_id", T.slug(F.col("f")).alias("slug"), T.category(F.col("f")).alias("category"))


@query("""SELECT doc_id, substring(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(trim(x), '^#+', ''))), lambda x: x <> '')[1], 'none'), 1, 200) AS title FROM documents""")
def q_policy_title(spark, d):
    return table(spark, d, "documents").select("doc_id", T.title(F.col("text"), F.lit("none")).alias("title"))


@query()
def q_policy_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


_STOP = "[" + ", ".join(f"'{w}'" for w in dims.STOP_WORDS) + "]"
_TOK = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))"


@query(f"SELECT doc_id, len({_TOK}) AS n_tokens, len(list_distinct({_TOK})) AS n_distinct FROM documents")
def q_tokenise(spark, d):
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


# ---- entity resolution


def _org(spark, d) -> DataFrame:
    """Products by name; clients and vendors made from customers and suppliers with shared fields."""
    p = table(spark, d, "part").select(T.node_id("Product", F.col("p_partkey")).alias("node_id"), F.lit("Product").alias("node_type"), F.col("p_partkey").cast("long").alias("ord"), F.col("p_name").alias("name"))
    return p


def _parties(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    mod = F.lit(500)
    name = F.concat(F.lpad(F.floor(k / 7).cast("string"), 6, "0"), F.lit(" Trading "), F.when(k % 2 == 0, "Inc").otherwise("LLC"))
    return c.select(
        T.node_id(F.when(k % 5 == 0, "Vendor").otherwise("Client"), k).alias("node_id"), F.when(k % 5 == 0, "Vendor").otherwise("Client").alias("node_type"), k.cast("long").alias("ord"), name.alias("name"),
        F.concat(F.lit("T"), (F.floor(k / 14)).cast("string")).alias("tax_id"), F.col("c_mktsegment").alias("industry"), F.concat(F.lit("u"), F.pmod(k, mod).cast("string"), F.lit("@ex.org")).alias("contact_email"),
    )


_PARTIES = """parties AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'Vendor' ELSE 'Client' END AS node_type, CASE WHEN c_custkey % 5 = 0 THEN 'Vendor:' ELSE 'Client:' END || c_custkey AS node_id, c_custkey::BIGINT AS ord,
  lpad((c_custkey // 7)::VARCHAR, 6, '0') || ' trading' AS nn, 'T' || (c_custkey // 14) AS tax, lower(c_mktsegment) AS ind, 'u' || (c_custkey % 500) || '@ex.org' AS em FROM customer),
 scored AS (SELECT a.nn AS block_name, substring(a.nn, 1, 4) AS block, a.node_id AS a_node_id, b.node_id AS b_node_id, a.ord AS a_ord, a.tax <> b.tax AS id_conflict,
  1 - (CASE WHEN a.tax = b.tax THEN 0.0 ELSE 1.0 END) * (CASE WHEN a.nn = b.nn THEN 0.45 ELSE 1.0 END) * (CASE WHEN a.ind = b.ind THEN 0.9 ELSE 1.0 END) * (CASE WHEN a.em = b.em THEN 0.2 ELSE 1.0 END) AS raw
  FROM parties a JOIN parties b ON substring(a.nn, 1, 4) = substring(b.nn, 1, 4) AND (a.ord, a.node_id) < (b.ord, b.node_id)),
 kept AS (SELECT *, round((CASE WHEN id_conflict THEN least(raw, 0.55) ELSE raw END)::DOUBLE, 6) AS score FROM scored WHERE round(raw, 9) >= 0.5)"""


@query("SELECT substring(lower(regexp_replace(p_name, '[^A-Za-z0-9 ]', '', 'g')), 1, 8) AS block, count(*) AS n, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM part GROUP BY 1")
def q_block_sizes(spark, d):
    return resolve.block_sizes(resolve.candidates(_org(spark, d), resolve.RULES[1]))


@query(f"WITH {_PARTIES} SELECT a_node_id, b_node_id, score, id_conflict FROM kept")
def q_pair_scores(spark, d):
    c = resolve.candidates(_parties(spark, d), resolve.RULES[0])
    return resolve.score(resolve.pairs(c), fuzzy=False).select("a_node_id", "b_node_id", F.round("score", 6).alias("score"), "id_conflict")


@query()
def q_pair_scores_fuzzy(spark, d):
    c = resolve.candidates(_parties(spark, d), resolve.RULES[0])
    return resolve.score(resolve.pairs(c)).select("a_node_id", "b_node_id", F.round("score", 6).alias("score"), F.array_join("reasons", ", ").alias("reasons"))


def _clusters(spark, d):
    c = resolve.candidates(_parties(spark, d), resolve.RULES[0])
    return c, *resolve.linked(c, fuzzy=False)


_CLUSTERS = f"""{_PARTIES}, RECURSIVE_EDGES AS (SELECT a_node_id AS a, b_node_id AS b FROM kept UNION ALL SELECT b_node_id, a_node_id FROM kept),
 walk(node_id, other) AS (SELECT DISTINCT a, a FROM RECURSIVE_EDGES UNION SELECT w.node_id, e.b FROM walk w JOIN RECURSIVE_EDGES e ON e.a = w.other),
 members AS (SELECT w.node_id, arg_min(w.other, p.ord) AS cluster FROM walk w JOIN parties p ON p.node_id = w.other GROUP BY 1)"""


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT node_id, cluster FROM members")
def q_clusters(spark, d):
    return _clusters(spark, d)[2]


_DECISIONS = f"""{_CLUSTERS}, shape AS (SELECT cluster, count(*) AS size, count(DISTINCT node_type) AS types FROM members JOIN parties USING (node_id) GROUP BY 1),
 top AS (SELECT m.cluster, max(score) AS top_score, bool_or(id_conflict) AS id_conflict FROM kept JOIN members m ON m.node_id = a_node_id GROUP BY 1),
 decided AS (SELECT cluster, size, types, top_score, id_conflict, CASE WHEN top_score >= 0.85 AND types = 1 AND NOT id_conflict THEN 'merge' WHEN top_score >= 0.75 AND types > 1 AND NOT id_conflict THEN 'auto_link' ELSE 'review' END AS decision
  FROM shape JOIN top USING (cluster))"""


@query(f"WITH RECURSIVE {_DECISIONS} SELECT cluster, size, types, top_score, id_conflict, decision FROM decided")
def q_cluster_decisions(spark, d):
    c, s, m = _clusters(spark, d)
    return resolve.decide(c, m, s).withColumn("top_score", F.round("top_score", 6)).drop("reasons")


@query(f"""WITH RECURSIVE {_DECISIONS} SELECT a.node_id AS src, b.node_id AS dst, 'same_as' AS rel_type, CASE decision WHEN 'auto_link' THEN 'auto_linked' ELSE 'needs_review' END AS status, round(top_score, 3) AS score
 FROM members a JOIN members b USING (cluster) JOIN decided USING (cluster) WHERE decision <> 'merge' AND a.node_id <> b.node_id""")
def q_same_as_edges(spark, d):
    c, s, m = _clusters(spark, d)
    return resolve.same_as(m, resolve.decide(c, m, s)).drop("reasons")


def _merged(spark, d) -> DataFrame:
    names = resolve.name_clusters(resolve.candidates(_org(spark, d), resolve.RULES[1]))
    return names.select("node_id", F.col("cluster").alias("canonical"))


_NAMES = """nc AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS keep, count(*) OVER (PARTITION BY p_name) AS size FROM part)"""


@query(f"WITH {_NAMES} SELECT 'Product:' || p_partkey AS node_id, 'Product:' || keep AS cluster, size FROM nc WHERE size > 1")
def q_name_clusters(spark, d):
    return resolve.name_clusters(resolve.candidates(_org(spark, d), resolve.RULES[1]))


@query(f"""WITH {_NAMES}, e AS (SELECT l_orderkey, keep, max({{'m': (keep <> p_partkey)::INT, 'o': l_linenumber::BIGINT}}) AS b
  FROM (SELECT l_orderkey, l_partkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2) JOIN nc ON p_partkey = l_partkey GROUP BY 1, 2)
 SELECT 'Sale:' || l_orderkey AS src, 'Product:' || keep AS dst, 'product_in_sale' AS rel_type, b.o AS ord FROM e""")
def q_merge_rewire(spark, d):
    e = _g(spark, d).edges.where("rel_type = 'product_in_sale'")
    return resolve.rewire(e, _merged(spark, d))


@query(f"""WITH {_NAMES}, f AS (SELECT keep, p.p_partkey, p_brand AS value FROM part p JOIN nc USING (p_partkey)), k AS (SELECT keep, arg_min(value, p_partkey) AS kept FROM f GROUP BY 1)
 SELECT 'Product:' || f.keep AS node_id, 'brand' AS key, kept AS existing_value, value AS merged_value, 'Product:' || p_partkey AS merged_from FROM f JOIN k USING (keep) WHERE f.keep <> p_partkey AND value <> kept""")
def q_merge_conflicts(spark, d):
    facts = table(spark, d, "part").select(T.node_id("Product", F.col("p_partkey")).alias("node_id"), F.lit("brand").alias("key"), F.col("p_brand").alias("value"))
    return resolve.merge_properties(facts, _merged(spark, d))[1].select("node_id", "key", "existing_value", "merged_value", "merged_from")


# ---- detector, risk, proposals


def _signed(spark, d) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_custkey")
    name = lambda x: F.concat(F.lit("Person "), x.cast("string"))
    signer = F.when(F.col("o_orderkey") % 3 == 0, k).otherwise(k + F.col("o_orderkey") % 4)
    e = table(spark, d, "orders").select(k.alias("sender"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("--\n"), name(signer), F.lit("\nPhone: 1")).alias("signature"))
    e = e.withColumn("mismatch", decisions.signature_mismatch(F.concat(name(F.col("sender")), F.lit("\n")), F.col("signature")))
    # every fifth has no record in HR, so no name
    return e, table(spark, d, "customer").select(F.col("c_custkey").alias("sender"), F.when(F.col("c_custkey") % 5 != 0, name(F.col("c_custkey"))).alias("hr_name"))


_SIGNED = """m AS (SELECT o_custkey AS sender, o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + o_orderkey % 4 END AS signer FROM orders),
 v AS (SELECT sender, 'Person ' || signer AS variant, count(*) AS n, min(ord) AS first_ord FROM m
  JOIN (SELECT c_custkey AS sender, CASE WHEN c_custkey % 5 <> 0 THEN 'Person ' || c_custkey END AS hr_name FROM customer) h USING (sender) WHERE signer <> sender AND hr_name <> 'Person ' || signer GROUP BY 1, 2)"""


@query(f"WITH {_SIGNED} SELECT sender, variant, n FROM v")
def q_signature_variants(spark, d):
    return decisions.name_variants(*_signed(spark, d)).select("sender", "variant", "n")


@query(f"""WITH {_SIGNED} SELECT sender, 'Person ' || sender AS hr_name, sum(n)::BIGINT AS total_mismatched, count(*) AS distinct_variants, arg_min(variant, (-n, first_ord)) AS top_variant FROM v GROUP BY sender HAVING sum(n) >= 2""")
def q_name_inconsistency(spark, d):
    return decisions.name_inconsistencies(*_signed(spark, d)).select("sender", "hr_name", "total_mismatched", "distinct_variants", F.col("variants")[0]["variant"].alias("top_variant"))


_RISKY = ["different", "same_entity", "alias", "shared_mailbox", "wrong_assignment", "uncertain", "else"]


def _cases(spark, d) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(x) for x in _RISKY]), (F.col("o_orderkey") % len(_RISKY) + 1).cast("int"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), pick.alias("decision"), (F.pmod(F.col("o_custkey"), F.lit(101)) / 100.0).alias("confidence"), (F.col("o_orderkey") % 2 == 0).alias("same_type"),
        (F.col("o_custkey") % 6 + 1).alias("cluster_size"), (F.col("o_orderkey") % 5 == 0).alias("id_conflict"), (F.col("o_orderkey") % 3 == 0).alias("small_model"),
        (F.col("o_orderkey") % 11 == 0).alias("about_names"), F.concat(F.lit("Client:"), F.col("o_custkey").cast("string")).alias("entity"),
    )


_CASES = f"""c AS (SELECT o_orderkey AS id, {_RISKY!r}[o_orderkey % {len(_RISKY)} + 1] AS decision, (o_custkey % 101) / 100.0::DOUBLE AS confidence, o_orderkey % 2 = 0 AS same_type, o_custkey % 6 + 1 AS cluster_size,
  o_orderkey % 5 = 0 AS id_conflict, o_orderkey % 3 = 0 AS small_model, o_orderkey % 11 = 0 AS about_names, 'Client:' || o_custkey AS entity FROM orders),
 a AS (SELECT *, CASE decision WHEN 'different' THEN 'remove_same_as_edges' WHEN 'same_entity' THEN CASE WHEN same_type THEN 'merge_nodes' ELSE 'upgrade_to_auto_linked' END WHEN 'alias' THEN 'mark_alias'
  WHEN 'shared_mailbox' THEN 'mark_shared_mailbox' WHEN 'wrong_assignment' THEN 'flag_email_reassignment' ELSE 'no_action' END AS action FROM c),
 r AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - confidence)) * (({dims.sql_case({k: v[0] for k, v in dims.ACTIONS.items()}, 'action')})::DOUBLE * ((CASE WHEN cluster_size > 3 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END)
  * (CASE WHEN id_conflict AND decision = 'same_entity' THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN small_model THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN decision = 'uncertain' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END))) AS risk FROM a)"""


@query(f"WITH {_CASES} SELECT id, action, round(risk, 6) AS risk, CASE WHEN action <> 'no_action' AND risk < 5 THEN 'auto_act' ELSE 'escalate' END AS recommended FROM r")
def q_risk_matrix(spark, d):
    a = decisions.assess(_cases(spark, d))
    return a.select("id", "action", F.round("risk", 6).alias("risk"), "recommended")


@query(f"""WITH {_CASES}, s AS (SELECT list_sort(list(round(risk, 6))) AS l, count(*) AS n FROM r) SELECT l[n // 2 + 1] AS p50, l[least(n - 1, floor(0.95 * n)::BIGINT) + 1] AS p95, l[n] AS max FROM s""")
def q_risk_percentiles(spark, d):
    a = decisions.assess(_cases(spark, d)).withColumn("risk", F.round("risk", 6))
    return decisions.percentiles(a)


@query(f"""WITH {_CASES}, m AS (SELECT *, CASE WHEN about_names THEN ['mark_alias', 'mark_shared_mailbox', 'flag_email_reassignment', 'no_action', 'investigate_further']
  WHEN same_type THEN ['merge_nodes', 'remove_same_as_edges', 'no_action', 'investigate_further'] ELSE ['upgrade_to_auto_linked', 'remove_same_as_edges', 'no_action', 'investigate_further'] END AS menu FROM r)
 SELECT id, array_to_string(list_filter(menu, lambda x: x <> action), ',') AS alternatives, CASE WHEN action <> 'no_action' AND risk < 5 THEN 'post_hoc_audit' ELSE 'pending_confirmation' END AS kind,
  CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS confidence_label FROM m""")
def q_proposals(spark, d):
    p = decisions.propose(decisions.assess(_cases(spark, d)))
    return p.select("id", F.array_join("alternatives", ",").alias("alternatives"), "kind", "confidence_label")


@query()
def q_expected_changes(spark, d):
    p = decisions.propose(decisions.assess(_cases(spark, d)))
    return decisions.pending(p).select("id", "action", F.array_join("expected_changes", "; ").alias("changes"))


@query(f"""WITH {_CASES} SELECT id AS conflict_ix, CASE WHEN action <> 'no_action' AND id % 4 = 0 THEN 'human_resolved' ELSE 'pending_review' END AS status, CASE WHEN action <> 'no_action' AND id % 4 = 0 THEN action END AS applied_action FROM r""")
def q_apply_actions(spark, d):
    a = decisions.assess(_cases(spark, d))
    c = a.select(F.col("id").alias("conflict_ix"), F.lit("pending_review").alias("status"))
    return decisions.apply_status(c, a.where("action <> 'no_action' and id % 4 = 0").select(F.col("id").alias("conflict_ix"), "action"))


# ---- retrieval

_QUERY = "customer policy of thon ernt the handhe ering"


def _docs(spark, d) -> DataFrame:
    t = table(spark, d, "documents")
    n = F.concat(F.lit("Policy:"), F.col("doc_id").cast("string"))
    first = F.substring_index("text", "\n", 1)
    return t.select(n.alias("node_id"), F.lit("Policy").alias("node_type"), F.substring(first, 1, 160).alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.concat_ws(" ", "lang", "source").alias("relations"), F.length("lang").alias("degree"))


_POSTS = f"""docs AS (SELECT 'Policy:' || doc_id AS node_id, coalesce(text, '') AS text, substring(string_split(text, chr(10))[1], 1, 160) AS title, lang || ' ' || source AS relations, length(lang) AS degree FROM documents),
 posts AS (SELECT term, node_id, count(*) AS tf FROM (SELECT node_id, unnest({_TOK}) AS term FROM docs) GROUP BY 1, 2),
 idf AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + count(*))) + 1.0 AS idf FROM posts GROUP BY 1),
 w AS (SELECT term, node_id, (1.0 + ln(tf)) * idf AS w FROM posts JOIN idf USING (term)),
 norms AS (SELECT node_id, coalesce(sqrt(sum(w * w)), 0.0) AS norm FROM docs LEFT JOIN w USING (node_id) GROUP BY 1)"""
_TERMS = search.query_terms(_QUERY)
_VEC = f"""{_POSTS}, q AS (SELECT t.term, t.m * coalesce(idf, 1.0) AS qw FROM (VALUES {', '.join(f"('{t}', {1.0})" for t in sorted(set(_TERMS)))}) t(term, m) LEFT JOIN idf USING (term)),
 qn AS (SELECT sqrt(sum(qw * qw)) AS qnorm FROM q),
 vec AS (SELECT node_id, sum(w * qw) / ((SELECT qnorm FROM qn) * any_value(norm)) AS vector FROM w JOIN q USING (term) JOIN norms USING (node_id) WHERE norm > 0 GROUP BY 1)"""
_SETS = f"[{', '.join(repr(t) for t in sorted(set(_TERMS)))}]"
_COVER = lambda c: f"len(list_intersect({_SETS}, {_TOK.replace('text', c)})) / {float(len(set(_TERMS)))}"
_GRAPH = f"""gs AS (SELECT node_id, 0.45::DOUBLE * ({_COVER('text')}) + 0.20::DOUBLE * ({_COVER('relations')}) + 0.20::DOUBLE * ({_COVER('title')}) + 0.20::DOUBLE + 0.15::DOUBLE + least(degree, 20) / 100.0::DOUBLE AS graph FROM docs)"""


_indexes: dict[tuple[str, str], search.Index] = {}


def _index(spark, d) -> search.Index:
    """The documents' index, stored once for each session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        _indexes[key] = search.Index(_docs(spark, d), whole=F.col("text"))
    return _indexes[key]


@query(f"WITH {_POSTS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def q_tfidf_idf(spark, d):
    return _index(spark, d).idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_POSTS} SELECT node_id, round(norm, 5) AS norm FROM norms")
def q_doc_norms(spark, d):
    return _index(spark, d).norms.select("node_id", F.round("norm", 5).alias("norm"))


@query(f"WITH {_VEC} SELECT node_id, round(vector, 6) AS vector FROM vec")
def q_vector_scores(spark, d):
    return _index(spark, d).vector(_QUERY).select("node_id", F.round("vector", 6).alias("vector"))


@query(f"WITH {_POSTS}, {_GRAPH} SELECT node_id, round(graph, 6) AS graph FROM gs WHERE graph > 0")
def q_graph_scores(spark, d):
    """Without an index; graph_scores_indexed has the same from postings."""
    return search.graph_scores(_docs(spark, d), _QUERY).select("node_id", F.round("graph", 6).alias("graph"))


@query(f"WITH {_POSTS}, {_GRAPH} SELECT node_id, round(graph, 6) AS graph FROM gs WHERE graph > 0")
def q_graph_scores_indexed(spark, d):
    return _index(spark, d).graph(_QUERY).select("node_id", F.round("graph", 6).alias("graph"))


@query(f"""WITH {_VEC}, {_GRAPH} SELECT node_id, round(0.55::DOUBLE * coalesce(graph / (SELECT max(graph) FROM gs), 0) + 0.45::DOUBLE * coalesce(vector / (SELECT max(vector) FROM vec), 0), 6) AS score
 FROM gs FULL JOIN vec USING (node_id) ORDER BY score DESC, node_id LIMIT 10""")
def q_hybrid_topk(spark, d):
    i = _index(spark, d)
    s = search.hybrid(i.graph(_QUERY), i.vector(_QUERY))
    return search.top_k(s.withColumn("score", F.round("score", 6)), "score", 10)


@query(f"WITH {_POSTS} SELECT node_id, list_sort(list(DISTINCT term)) AS matched FROM posts WHERE term IN ({', '.join(repr(t) for t in sorted(set(_TERMS)))}) GROUP BY 1")
def q_matched_terms(spark, d):
    return _index(spark, d).matched(_QUERY)


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(q, '\\bemp(?:-|_)?[0-9]+\\b') OR regexp_matches(q, '\\b[a-z]+:\\S+\\b') OR regexp_matches(q, '\\bcustomer(?:-|_)?[0-9a-z]+\\b') OR len(t) <= 2 THEN 'graph'
 WHEN len(t) >= 7 THEN 'hybrid' WHEN list_has_any(t, ['about', 'like', 'overview', 'similar']) THEN 'vector' ELSE 'hybrid' END AS mode
 FROM (SELECT doc_id, q, {_TOK.replace('text', 'q')} AS t FROM (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9:_ -]', ' ', 'g')) || CASE WHEN doc_id % 4 = 0 THEN ' overview' WHEN doc_id % 7 = 0 THEN ' emp_0431' ELSE '' END AS q FROM documents
  UNION ALL SELECT -p_partkey, lower(p_name) || CASE WHEN p_partkey % 3 = 0 THEN ' overview of' ELSE '' END FROM part))""")
def q_route_modes(spark, d):
    """Whole texts and all product names as queries; other characters than ASCII words become spaces, since regex dialects differ about them."""
    tail = F.when(F.col("doc_id") % 4 == 0, " overview").when(F.col("doc_id") % 7 == 0, " emp_0431").otherwise("")
    q = table(spark, d, "documents").select("doc_id", F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9:_ -]", " "), tail).alias("q"))
    p = table(spark, d, "part").select((-F.col("p_partkey")).cast("long").alias("doc_id"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " overview of").otherwise("")).alias("q"))
    return q.unionByName(p).select("doc_id", search.route(F.col("q")).alias("mode"))


@query(f"""SELECT node_id, key, rn FROM (SELECT node_id, key, row_number() OVER (PARTITION BY node_id ORDER BY ord, key) AS rn FROM (
  SELECT 'Product:' || p_partkey AS node_id, 1 AS ord, 'name' AS key, p_name AS value FROM part UNION ALL SELECT 'Product:' || p_partkey, 2, 'brand', p_brand FROM part UNION ALL SELECT 'Product:' || p_partkey, 3, 'type', p_type FROM part)
 WHERE contains(lower(substring(value, 1, 120)), 'brand') OR contains(lower(substring(value, 1, 120)), 'steel') OR contains(lower(substring(value, 1, 120)), 'red')) WHERE rn <= 3""")
def q_evidence(spark, d):
    p = table(spark, d, "part")
    f = p.select(T.node_id("Product", F.col("p_partkey")).alias("node_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), F.col(c).alias("value")) for i, (k, c) in enumerate((("name", "p_name"), ("brand", "p_brand"), ("type", "p_type")), 1)])).alias("c")).select("node_id", "c.*")
    return search.evidence(f, "steel brand red").withColumn("rn", F.col("rn").cast("long"))


# ---- profiling

_PROFILE = """cells AS (SELECT 'o_orderkey' AS field, o_orderkey::VARCHAR AS value, 'integer' AS kind FROM orders UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR, 'integer' FROM orders
 UNION ALL SELECT 'o_orderstatus', o_orderstatus, 'string' FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, 'string' FROM orders),
 p AS (SELECT field, min(kind) AS dominant, count(value) AS n_non_null, count(DISTINCT value) AS n_distinct, round(1.0 - count(value) / count(*)::DOUBLE, 3) AS null_rate, round(count(DISTINCT value) / count(value)::DOUBLE, 3) AS uniqueness FROM cells GROUP BY 1)"""
_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(f"WITH {_PROFILE} SELECT * FROM p")
def q_column_profile(spark, d):
    return profile.profile(table(spark, d, "orders").select(*_FIELDS))


@query(f"""WITH {_PROFILE} SELECT field, (regexp_matches(lower(field), '(?:^|_)(?:uuid|key|id)$') OR dominant = 'integer') AND uniqueness >= 0.99 AND n_non_null > 1 AS is_key,
 regexp_matches(lower(field), '_id$|_uuid$|_key$') AND uniqueness < 0.95 AND n_non_null > 1 AS is_foreign FROM p""")
def q_pk_fk_candidates(spark, d):
    return profile.keys(profile.profile(table(spark, d, "orders").select(*_FIELDS))).select("field", "is_key", "is_foreign")


_LINKS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "part", "p_partkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("part", "p_partkey", "supplier", "s_suppkey")]


@query("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}.{x} -> {b}.{y}' AS link, count(*) AS n_values, count(*) FILTER (WHERE v IN (SELECT {y}::VARCHAR FROM {b})) AS n_contained, round(count(*) FILTER (WHERE v IN (SELECT {y}::VARCHAR FROM {b})) / count(*)::DOUBLE, 3) AS coverage FROM (SELECT DISTINCT {x}::VARCHAR AS v FROM {a})"
    for a, x, b, y in _LINKS) + ") WHERE coverage >= 0.8")
def q_cross_file_links(spark, d):
    return profile.cross_links({t: table(spark, d, t) for t in ("orders", "customer", "lineitem", "part", "nation", "supplier")}, _LINKS)


# ---- review


def _conflicts(spark, d) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("entity_match_review", "employee_name_inconsistency", "human_edit", "field", "unknown")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("conflict_ix"), kind.alias("conflict_type"), (F.pmod("o_custkey", F.lit(100)) / 100.0).alias("score"), (F.col("o_custkey") % 70).alias("n_mismatched"), (F.col("o_custkey") % 6).alias("n_variants"),
        F.when(kind == "field", "phone").alias("key"), F.when(F.col("o_orderkey") % 3 == 0, "pending_review").otherwise("auto_resolved").alias("status"), F.when(F.col("o_orderkey") % 3 != 0, F.when(F.col("o_custkey") % 2 == 0, "new").otherwise("existing")).alias("winner"),
    )


@query("""WITH c AS (SELECT o_orderkey AS ix, ['entity_match_review', 'employee_name_inconsistency', 'human_edit', 'field', 'unknown'][o_orderkey % 5 + 1] AS t, (o_custkey % 100) / 100.0::DOUBLE AS score, o_custkey % 70 AS n, o_custkey % 6 AS v,
  o_orderkey % 3 = 0 AS pend, CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'new' ELSE 'existing' END END AS winner FROM orders)
 SELECT ix AS conflict_ix, CASE t WHEN 'entity_match_review' THEN CASE WHEN score < 0.6 THEN 'HIGH' WHEN score < 0.8 THEN 'MED' ELSE 'LOW' END WHEN 'employee_name_inconsistency' THEN CASE WHEN n >= 50 THEN 'HIGH' WHEN n >= 10 THEN 'MED' ELSE 'LOW' END
  ELSE CASE WHEN pend THEN 'MED' ELSE 'LOW' END END AS severity, round(CASE t WHEN 'entity_match_review' THEN score WHEN 'employee_name_inconsistency' THEN greatest(0.3::DOUBLE, 1.0::DOUBLE - 0.15::DOUBLE * v) ELSE 0.5::DOUBLE END, 6) AS confidence,
  CASE WHEN pend THEN 'needs review' WHEN t = 'human_edit' THEN 'edited by hand' WHEN winner = 'new' THEN 'new value accepted' WHEN winner = 'existing' THEN 'existing value kept' ELSE 'resolved' END AS verdict FROM c WHERE t <> 'unknown'""")
def q_review_queue(spark, d):
    return review.queue(_conflicts(spark, d)).select("conflict_ix", "severity", F.round("confidence", 6).alias("confidence"), "verdict")


@query("""WITH x AS (SELECT o_orderkey AS id, o_orderkey % 3 AS k, o_totalprice, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS da, strftime(o_orderdate + to_days((o_custkey % 12)::INT), '%Y-%m-%d') AS db FROM orders),
 m AS (SELECT *, (floor(o_totalprice))::BIGINT AS na, (floor(o_totalprice))::BIGINT + o_custkey % 9000 AS nb FROM x)
 SELECT id, CASE k WHEN 0 THEN 'amount' WHEN 1 THEN 'date' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'identical' ELSE 'different value' END END AS diff_kind,
  CASE k WHEN 0 THEN (nb - na)::DOUBLE WHEN 1 THEN (o_custkey % 12)::DOUBLE END AS delta,
  CASE k WHEN 0 THEN nb - na > 0.10 * na WHEN 1 THEN o_custkey % 12 > 7 ELSE o_custkey % 2 <> 0 END AS warn FROM m""")
def q_field_diff(spark, d):
    o = table(spark, d, "orders")
    k, n = F.col("o_orderkey") % 3, F.floor("o_totalprice")
    a = F.when(k == 0, F.concat(F.lit("EUR "), n.cast("string"))).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("Nordic Trading"))
    b = F.when(k == 0, F.concat(F.lit("EUR "), (n + F.col("o_custkey") % 9000).cast("string"))).when(k == 1, F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 12).cast("int")), "yyyy-MM-dd"))
    b = b.otherwise(F.when(F.col("o_custkey") % 2 == 0, F.lit("nordic trading ")).otherwise(F.lit("Iberian Foods")))
    x = o.select(F.col("o_orderkey").alias("id"), a.alias("a"), b.alias("b"))
    return review.field_diff(x, "a", "b").select("id", "diff_kind", "delta", "warn")


# ---- streaming


@query(ORACLES["upsert_state"])
def q_stream_upsert(spark, d):
    """The change feed in four files, one to a micro-batch, edits by hand among them; the state equals that of one batch."""
    from weftline.runtime import Scratch
    from weftline.streaming import reingest

    s = Scratch(spark)
    feed = testdata.change_feed(spark, d)
    lo, hi = feed.agg(F.min("ord"), F.max("ord")).first()
    for i in range(4):  # files come in the order of their records
        a, b = lo + (hi + 1 - lo) * i // 4, lo + (hi + 1 - lo) * (i + 1) // 4
        feed.where((F.col("ord") >= a) & (F.col("ord") < b)).coalesce(1).write.mode("append").parquet(f"{s.path}/landing")
    reingest.start(spark, f"{s.path}/landing", f"{s.path}/graph", files_per_batch=1).awaitTermination()
    last = max(int(r[0].rsplit("=", 1)[1]) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{s.path}/graph/state").select(F.regexp_extract("path", "(v=[0-9]+)", 1)).distinct().collect())
    return spark.read.parquet(f"{s.path}/graph/state/v={last}").select("node_id", "key", "value")


from weftline.plans import page_queries  # noqa: E402, F401 - registers the rest
