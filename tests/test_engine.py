"""The engine's behaviour on small invented records."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from weftline import dims
from weftline.operators import decisions, profile, resolve, review, search, upsert, views
from weftline.operators.graph import ContextGraph, guarded, last_wins
from weftline.sources import ingest, readers
from weftline.streaming import reingest


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- upserts


def fold_in_python(feed):
    """The rules as a loop over one record after the other."""
    first, state, edited, log, clashes = {}, {}, set(), [], []
    for nid, kind, key, value, src, o, human in sorted(feed, key=lambda r: r[5]):
        new_node = nid not in first
        first.setdefault(nid, src)
        old = state.get((nid, key))
        if old is None:
            if not new_node:
                log.append((nid, key, "added", None, value))
            state[nid, key] = value
        elif old != value:
            es, ns = ("Human" if (nid, key) in edited else first[nid]), ("Human" if human else src)
            canon, gap = dims.CANONICAL.get(kind), dims.AUTHORITY.get(es, 0) - dims.AUTHORITY.get(ns, 0)
            w = "new" if es == ns else "existing" if es == canon else "new" if ns == canon else ("existing" if gap > 0 else "new") if abs(gap) >= 20 else None
            if human:
                w = "new"
            clashes.append((nid, key, old, value, es, ns, w))
            if w == "new":
                log.append((nid, key, "updated", old, value))
                state[nid, key] = value
        if human:
            edited.add((nid, key))
    return state, log, clashes


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_a_loop(spark, seed):
    r = random.Random(seed)
    src = [*sorted(dims.AUTHORITY)[:6], "Elsewhere"]
    feed = [(f"n{r.randint(0, 4)}", r.choice(["Employee", "Email", "Client"]), r.choice("pq"), str(r.randint(0, 3)), r.choice(src), i, r.random() < 0.1) for i in range(250)]
    kinds = {}
    feed = [(n, kinds.setdefault(n, k), *rest) for n, k, *rest in feed]
    f = upsert.fold(frame(spark, feed, "node_id string, node_type string, key string, value string, source_system string, ord long, human boolean")).cache()
    state, log, clashes = fold_in_python(feed)
    assert {(x.node_id, x.key): x.value for x in upsert.state(f).collect()} == state
    assert sorted((x.node_id, x.key, x.kind, str(x.old_value), x.new_value) for x in upsert.change_log(f).collect()) == sorted((a, b, c, str(d), e) for a, b, c, d, e in log)
    assert sorted((x.node_id, x.key, x.existing_value, x.new_value, x.existing_source, x.new_source, str(x.winner)) for x in upsert.conflicts(f).collect()) == sorted((*x[:6], str(x[6])) for x in clashes)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"Email:{i % 7}", "Email", "pq"[i % 2], str(i % 5), ["Workspace", "Elsewhere", "Enterprise_Mail_System"][i % 3], i, False) for i in range(120)]
    schema = "node_id string, node_type string, key string, value string, source_system string, ord long, human boolean"
    want = {(x.node_id, x.key): x.value for x in upsert.state(upsert.fold(frame(spark, rows, schema))).collect()}
    for k in range(3):
        frame(spark, rows[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        reingest.start(spark, str(tmp_path / "in"), str(tmp_path / "g")).awaitTermination()
    got = {(x.node_id, x.key): x.value for x in spark.read.parquet(str(tmp_path / "g/state/v=2")).collect()}
    assert got == want


def test_stream_remembers_edits_by_hand(spark, tmp_path):
    """HR sets 1, somebody sets 2 by hand, IT sets 3: one record a batch gives what one batch gives."""
    schema = "node_id string, node_type string, key string, value string, source_system string, ord long, human boolean"
    rows = [("Email:1", "Email", "p", "1", "Human_Resource_Management", 0, False), ("Email:1", "Email", "p", "2", "IT_Service_Management", 1, True), ("Email:1", "Email", "p", "3", "IT_Service_Management", 2, False), ("Email:1", "Email", "q", "4", "Workspace", 3, False)]
    f = upsert.fold(frame(spark, rows, schema))
    want = {(x.node_id, x.key): x.value for x in upsert.state(f).collect()}
    for r in rows:
        frame(spark, [r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    reingest.start(spark, str(tmp_path / "in"), str(tmp_path / "g"), files_per_batch=1).awaitTermination()
    assert {(x.node_id, x.key): x.value for x in spark.read.parquet(str(tmp_path / "g/state/v=3")).collect()} == want == {("Email:1", "p"): "3", ("Email:1", "q"): "4"}
    clashes = lambda d: sorted((x.key, x.existing_source, x.new_source, str(x.winner)) for x in d.collect())
    assert clashes(spark.read.parquet(str(tmp_path / "g/conflicts/v=*"))) == clashes(upsert.conflicts(f))


def test_resolutions_and_provenance(spark):
    c = frame(spark, [("A:1", "k", "a", "b", 1, "pending_review", None), ("A:1", "k", "a", "c", 2, "pending_review", None), ("A:1", "m", "x", "y", 3, "auto_resolved", "new")], "node_id string, key string, existing_value string, new_value string, ord long, status string, winner string")
    done = upsert.resolve_manually(c, frame(spark, [("A:1", "k", 1, "new"), ("A:1", "k", 2, "existing"), ("A:1", "m", 3, "existing")], "node_id string, key string, ord long, winner string"))
    s = upsert.apply_resolutions(frame(spark, [("A:1", "k", "a"), ("A:1", "m", "y")], "node_id string, key string, value string"), done)
    assert {r.key: r.value for r in s.collect()} == {"k": "b", "m": "y"}
    assert upsert.list_conflicts(done, "pending_review").count() == 0 and upsert.list_conflicts(done).count() == 3
    p = frame(spark, [("s", "", "f")], "a string, b string, c string").select(upsert.make_provenance(F.col("a"), F.col("b"), field=F.col("c")).alias("p")).first().p
    assert (p.source_system, p.file, p.field, p.confidence) == ("s", None, "f", 1.0)
    q = frame(spark, [([("s1", "x"), ("s2", "y")],), ([],)], "p array<struct<source_system:string,field:string>>").select(upsert.provenance_of(F.col("p"), "y").alias("y"), upsert.provenance_of(F.col("p"), "z").alias("z")).collect()
    assert [(r.y and r.y.source_system, r.z and r.z.source_system) for r in q] == [("s2", "s1"), (None, None)]


def test_merging_and_actions(spark):
    nodes = frame(spark, [("C:1", "C"), ("C:2", "C"), ("C:3", "C"), ("E:1", "E")], "node_id string, node_type string")
    edges = frame(spark, [("E:1", "C:2", "r", 1), ("E:1", "C:1", "r", 2), ("C:1", "C:2", "same_as", 3), ("C:3", "E:1", "s", 4)], "src string, dst string, rel_type string, ord long")
    facts = frame(spark, [("C:1", "k", "a"), ("C:2", "k", "b"), ("C:2", "m", "c")], "node_id string, key string, value string")
    prov = frame(spark, [("C:1", "x", "f1"), ("C:2", "y", "f2")], "node_id string, source_system string, file string")
    n, e, f, p, c = resolve.merge_graph(nodes, edges, facts, prov, frame(spark, [("C:1", "C:1"), ("C:2", "C:1")], "node_id string, canonical string"), resolve.Merge("human", "field_after_human_merge"))
    assert {r.node_id for r in n.collect()} == {"C:1", "C:3", "E:1"} and {(r.src, r.dst) for r in e.collect()} == {("E:1", "C:1"), ("C:3", "E:1")}
    assert {(r.node_id, r.key): r.value for r in f.collect()} == {("C:1", "k"): "a", ("C:1", "m"): "c"}
    assert {(r.node_id, r.source_system, r.file) for r in p.collect()} == {("C:1", "x", "f1"), ("C:1", "y", "f2"), ("C:1", "human", "merged_in:C:2")}
    assert [(r.merged_value, r.conflict_type, r.status) for r in c.collect()] == [("b", "field_after_human_merge", "pending_review")]
    same = frame(spark, [("C:1", "C:2", "same_as", "needs_review"), ("C:2", "C:3", "same_as", "needs_review")], "src string, dst string, rel_type string, status string")
    members = frame(spark, [(1, "C:1"), (1, "C:2"), (2, "C:2"), (2, "C:3"), (3, "E:1"), (4, "C:1"), (4, "C:3")], "conflict_ix int, node_id string")
    act = frame(spark, [(1, "remove_same_as_edges"), (2, "upgrade_to_auto_linked"), (3, "mark_shared_mailbox"), (4, "merge_nodes")], "conflict_ix int, action string")
    e2, n2, alias = decisions.apply_actions(same, nodes, members, act)
    assert [(r.src, r.status) for r in e2.collect()] == [("C:2", "auto_linked")] and {r.node_id for r in n2.where("is_shared_mailbox").collect()} == {"E:1"}
    assert {(r.node_id, r.canonical) for r in alias.collect()} == {("C:1", "C:1"), ("C:3", "C:1")}
    assert [r.x for r in frame(spark, [("names disagree",), ("vat_id differs",), ("similar names",), (None,)], "w string").coalesce(1).select(decisions.id_conflict(F.col("w")).alias("x")).collect()] == [True, True, False, False]


def test_evidence_and_flat_values(spark):
    nodes = frame(spark, [("A:1",), ("A:2",)], "node_id string")
    facts = frame(spark, [("A:1", "k", "steel rod", 1), ("A:1", "m", "red", 2), ("A:2", "k", "glass", 1)], "node_id string, key string, value string, ord long")
    rel = frame(spark, [("A:1", "r", "X", 0, 1), ("A:1", "r", "Y", 1, 1), ("A:1", "r", "Z", 1, 2)], "node_id string, rel_type string, other_title string, way int, ord long")
    got = {r.node_id: r.evidence for r in search.evidence_lines(nodes, facts, rel, "red steel").collect()}
    assert got == {"A:1": ["property k", "property m", "r X", "r Y"], "A:2": ["generated view"]}
    v = frame(spark, [('["a","b"]', "list"), ('{"x":"1","y":"2"}', "dict"), ("t" * 500, "string"), (None, "string")], "v string, k string").coalesce(1)
    assert [r.s for r in v.select(search.stringify(F.col("v"), F.col("k")).alias("s")).collect()] == ["a b", "x 1 y 2", "t" * 400, ""]


def test_falsy_by_type(spark):
    d = frame(spark, [(1, "0", "false", 0, False, 0.0, "", 7), (2, "1", "x", 3, True, 0.5, None, 0)], "id int, a string, b string, c int, d boolean, e double, f string, g int").withColumn("ord", F.col("id").cast("long"))
    cells = {c: F.col(c) for c in "abcdefg"}
    got = lambda falsy: {(r.node_id, r.key): r.value for r in ingest.facts_of(d, F.concat(F.lit("N:"), F.col("id").cast("string")), cells, falsy).collect()}
    assert {k: v for k, v in got(True).items() if k[0] == "N:1"} == {("N:1", "a"): "0", ("N:1", "b"): "false", ("N:1", "g"): "7"}
    assert {k[1] for k in got(False) if k[0] == "N:1"} == set("abcdeg") and {k[1] for k in got(True) if k[0] == "N:2"} == set("abcde")


# ---- risk, proposals


@pytest.mark.parametrize(
    "decision,confidence,same,ok",
    [("different", 0.9, True, True), ("different", 0.6, True, False), ("same_entity", 0.97, True, True), ("same_entity", 0.9, True, False), ("same_entity", 0.9, False, True), ("alias", 0.55, True, True), ("uncertain", 1.0, True, False), ("nonsense", 1.0, True, False)],
)
def test_risk(spark, decision, confidence, same, ok):
    d = frame(spark, [(decision, confidence, same, 2, False, False)], "decision string, confidence double, same_type boolean, cluster_size int, id_conflict boolean, small_model boolean")
    assert (decisions.assess(d).first().recommended == "auto_act") == ok


def test_risk_modifiers(spark):
    s = "decision string, confidence double, same_type boolean, cluster_size int, id_conflict boolean, small_model boolean"
    rows = [("same_entity", 0.5, True, 4, True, True), ("same_entity", 1.7, True, 3, False, False), ("different", 0.5, True, 2, True, False)]
    cost = [(round(x.final_cost, 6), round(x.error_probability, 6)) for x in decisions.assess(frame(spark, rows, s).coalesce(1)).collect()]
    assert cost == [(round(90 * 1.3 * 1.6 * 1.25, 6), 0.5), (90.0, 0.0), (15.0, 0.5)]


def test_alternatives(spark):
    d = frame(spark, [("merge_nodes", True, False), ("remove_same_as_edges", False, False), ("mark_alias", True, True)], "a string, s boolean, n boolean").coalesce(1)
    got = [r[0] for r in d.select(decisions.alternatives(F.col("a"), F.col("s"), F.col("n"))).collect()]
    assert got == [["remove_same_as_edges", "no_action", "investigate_further"], ["upgrade_to_auto_linked", "no_action", "investigate_further"], "mark_shared_mailbox flag_email_reassignment no_action investigate_further".split()]


def test_percentiles(spark):
    for n in (1, 2, 5, 40):
        v = [float(x) for x in range(n)]
        p = decisions.percentiles(frame(spark, [(x,) for x in v], "risk double")).first()
        assert (p.p50, p.p95, p.max) == (v[n // 2], v[min(n - 1, int(0.95 * n))], v[-1])


def test_parse_decision(spark):
    xs = ['{"decision": "alias", "confidence": 0.9}', '```json\n{"decision": "different", "confidence": 0.4}\n```', 'Well: {"confidence": 0.1, "decision": "uncertain"} so', "nothing"]
    d = frame(spark, [(x,) for x in xs], "x string").coalesce(1).select(decisions.parse_decision(F.col("x")).alias("p"))
    assert [r.p.decision if r.p else None for r in d.collect()] == ["alias", "different", "uncertain", None]


def test_detector(spark):
    e = [("1", f"--\nOther One\nPhone: {i}", True, i) for i in range(3)] + [("1", "--\nThird Name", True, 9), ("2", "--\nReal Two", True, 10), ("3", "--\nLone Odd", True, 11), ("box", "--\nSome Team", True, 12)]
    names = frame(spark, [("1", "Real One"), ("2", "real two"), ("3", "Real Three")], "sender string, hr_name string")
    mails = frame(spark, e, "sender string, signature string, mismatch boolean, ord long")
    got = decisions.name_inconsistencies(mails, names).collect()
    assert [(r.sender, r.total_mismatched, r.distinct_variants, [v.variant for v in r.variants]) for r in got] == [("1", 4, 2, ["Other One", "Third Name"])]
    assert {r.sender for r in decisions.name_inconsistencies(mails, names, least=1).collect()} == {"1", "3"}


# ---- resolution


def test_resolution_end_to_end(spark):
    rows = [
        ("Client:1", "Client", 1, "Nordlicht Trading GmbH", "T1", "3 Quay Road", "food"), ("Client:2", "Client", 2, "Nordlicht Trading", "T1", "3 Quay Road", "food"),
        ("Client:3", "Client", 3, "Bergmann Steel", "T3", "9 Hill St", "metal"), ("Vendor:4", "Vendor", 4, "Bergmann Steel", None, "9 Hill St", "metal"),
        ("Client:5", "Client", 5, "Solar Uno", "T5", None, None), ("Client:6", "Client", 6, "Solar Uno", "T6", None, None), ("Client:7", "Client", 7, "Quite Alone", None, None, None),
    ]
    n = frame(spark, rows, "node_id string, node_type string, ord long, name string, tax_id string, address string, industry string")
    c = resolve.candidates(n, resolve.RULES[0]).cache()
    s = resolve.score(resolve.pairs(c)).cache()
    m = resolve.clusters(c, s).cache()
    d = resolve.decide(c, m, s)
    got = {r.cluster: (r.decision, round(r.top_score, 4)) for r in d.collect()}
    assert got == {"Client:1": ("merge", 1.0), "Client:3": ("auto_link", round(1 - 0.45 * 0.3 * 0.9, 4)), "Client:5": ("review", 0.55)}
    links = resolve.same_as(m, d)
    assert {(r.src, r.dst, r.status) for r in links.collect()} == {("Client:3", "Vendor:4", "auto_linked"), ("Vendor:4", "Client:3", "auto_linked"), ("Client:5", "Client:6", "needs_review"), ("Client:6", "Client:5", "needs_review")}
    al = resolve.canonical_of(frame(spark, [("Client:1", "2024-02"), ("Client:2", "2024-01")], "node_id string, at string"), m.where("cluster = 'Client:1'"))
    assert {(r.node_id, r.canonical) for r in al.collect()} == {("Client:1", "Client:2"), ("Client:2", "Client:2")}
    e = frame(spark, [("Client:1", "X", "r", 1), ("Client:2", "X", "r", 5), ("Y", "Client:1", "s", 2), ("Client:1", "Client:2", "same_as", 3)], "src string, dst string, rel_type string, ord long")
    assert {tuple(r) for r in resolve.rewire(e, al).collect()} == {("Client:2", "X", "r", 1), ("Y", "Client:2", "s", 2)}
    facts = frame(spark, [("Client:1", "k", "a"), ("Client:2", "k", "b"), ("Client:1", "only", "c")], "node_id string, key string, value string")
    merged, clash = resolve.merge_properties(facts, al)
    assert {(r.node_id, r.key, r.value) for r in merged.collect()} == {("Client:2", "k", "b"), ("Client:2", "only", "c")}
    assert [(r.existing_value, r.merged_value, r.merged_from) for r in clash.collect()] == [("b", "a", "Client:1")]
    assert resolve.remove_same_as(links.select("src", "dst", "rel_type"), m.where("cluster = 'Client:3'")).count() == 2
    up = resolve.upgrade_same_as(links, m.where("cluster = 'Client:5'"))
    assert {r.status for r in up.collect()} == {"auto_linked"}
    assert resolve.drop_aliases(n, al).count() == 6


def test_rules_without_contact_fields_only_flag(spark):
    n = frame(spark, [("Product:1", "Product", 1, "Red Lamp"), ("Product:2", "Product", 2, "Red Lamp")], "node_id string, node_type string, ord long, name string")
    c = resolve.candidates(n, resolve.RULES[1])
    s = resolve.score(resolve.pairs(c))
    assert [r.decision for r in resolve.decide(c, resolve.clusters(c, s), s).collect()] == ["review"]


def test_actions(spark):
    n = frame(spark, [("E:1", ["Bo"], None), ("E:2", None, True)], "node_id string, aliases array<string>, is_shared_mailbox boolean")
    a = decisions.mark_alias(n, frame(spark, [("E:1", ["Bo", "Al"])], "node_id string, names array<string>"))
    assert {r.node_id: r.aliases for r in a.collect()} == {"E:1": ["Bo", "Al"], "E:2": []}
    assert {r.node_id: r.is_shared_mailbox for r in decisions.mark_shared_mailbox(n, n.where("node_id = 'E:1'")).collect()} == {"E:1": True, "E:2": True}
    m = frame(spark, [("1", True), ("1", False), ("2", True)], "sender string, mismatch boolean")
    f = decisions.flag_reassignment(m, frame(spark, [("1", "Zoe")], "sender string, suggested_sender string"))
    assert sorted((r.sender, r.disputed, str(r.suggested_sender)) for r in f.collect()) == [("1", False, "None"), ("1", True, "Zoe"), ("2", False, "None")]


# ---- graph, search, views


@pytest.fixture(scope="module")
def small(spark):
    n = [("A:1", "A", 1, "Alpha plan"), ("A:2", "A", 2, "Beta plan"), ("B:1", "B", 3, "Gamma policy"), ("B:2", "B", 4, "Delta"), ("C:1", "C", 5, "")]
    e = [("A:1", "B:1", "r", 1), ("A:1", "A:2", "r", 2), ("B:2", "A:1", "s", 1), ("B:1", "C:1", "r", 1)]
    nodes = spark.createDataFrame(n, "node_id string, node_type string, ord long, title string").withColumn("text", F.lower("title"))
    return ContextGraph(nodes, spark.createDataFrame(e, "src string, dst string, rel_type string, ord long"))


def test_walks(spark, small):
    assert [tuple(r) for r in small.related("A:1", hops=2, limit=10).orderBy("rank").collect()] == [("B:1", 1, 1), ("A:2", 1, 2), ("B:2", 1, 3), ("C:1", 2, 4)]
    assert small.related("A:1", hops=1, limit=2).count() == 2
    assert {(r.node_id, r.layer) for r in small.layers(frame(spark, [("B:2",)], "node_id string")).collect()} == {("B:2", "core"), ("A:1", "direct"), ("B:1", "context"), ("A:2", "context"), ("C:1", "ambient")}
    assert small.substring_search("PLAN", 0).count() == 1 and small.by_type("A").count() == 2
    assert guarded(small.edges.unionByName(frame(spark, [("A:1", "Z:9", "r", 3)], "src string, dst string, rel_type string, ord long")), small.nodes).count() == 4


def test_last_edge_wins(spark):
    e = frame(spark, [("a", "b", "r", 1, "x"), ("a", "b", "r", 3, "y"), ("a", "b", "q", 2, "z")], "src string, dst string, rel_type string, ord long, role string")
    assert {tuple(r) for r in last_wins(e).collect()} == {("a", "b", "r", 3, "y"), ("a", "b", "q", 2, "z")}


def test_search(spark):
    d = frame(spark, [("Policy:1", "Policy", "Travel policy", "travel cost rules", "", 1), ("Client:2", "Client", "Nord", "travel firm", "policy", 30), ("Client:3", "Client", "", "", "", 0)], "node_id string, node_type string, title string, text string, relations string, degree int")
    i = search.Index(d)
    assert i.search("travel policy", k=1).first().node_id == "Policy:1"
    assert [r.node_id for r in i.search("client nord", "graph").collect()][0] == "Client:2"
    assert i.search("zebra", "graph").count() == 2  # no candidate: every node with a degree
    assert i.search("zebra", "vector").count() == 0 and i.search("", "hybrid").count() == 0
    assert {r.node_id for r in i.search("travel", "hybrid", 9, "client").collect()} == {"Client:2"}
    assert {r.node_id: r.norm > 0 for r in i.norms.collect()}["Client:3"]
    with pytest.raises(ValueError):
        i.search("x", "dense")


def test_views(spark):
    h = views.purchase_history(frame(spark, [(1, 10 + i, f"2024-01-{i + 1:02d}") for i in range(25)], "customer int, sale int, date string"), frame(spark, [(10 + i, 5, 2) for i in range(25)] + [(34, 4, 1)], "sale int, product int, ord int"), frame(spark, [(4, "Lamp"), (5, "Desk")], "product int, name string"))
    rows = {r.rn: r for r in h.collect()}
    assert len(rows) == 20 and rows[1].sale == 34 and rows[1].name == "Lamp" and rows[2].name == "Desk" and rows[1].n_sales == 25
    page = views.customer_pages(frame(spark, [("Customer:1", "1", "Ann")], "node_id string, key string, name string"), h.withColumn("customer", F.col("customer").cast("string"))).first().page
    assert "# Ann (1)" in page and "(25 orders)" in page and "[Lamp](/products/4)" in page and "5 more" in page and page.index("2024-01-25") < page.index("2024-01-24")


def test_profile_and_links(spark):
    d = frame(spark, [(f"emp_{i:03d}", i % 3, "a@b.co", "") for i in range(30)], "emp_id string, team int, mail string, note string")
    p = {r.field: r for r in profile.keys(profile.profile(d)).collect()}
    assert p["emp_id"].is_key and not p["mail"].is_key and p["emp_id"].dominant == "prefixed_id" and p["note"].null_rate == 1.0 and p["note"].dominant == "null"
    c = profile.containment(frame(spark, [("a",), ("b",), (None,)], "x string"), "x", frame(spark, [("a",)], "y string"), "y").first()
    assert (c.n_values, c.n_contained, c.coverage) == (2, 1, 0.5)


def test_review(spark):
    d = frame(spark, [("EUR 100", "EUR 120"), ("2024-01-01", "2024-01-05T10"), ("Nord AG", "Nord"), ("one two", "two three x"), ("€5", "$5")], "a string, b string").coalesce(1)
    got = [(r.diff_kind, r.delta, r.warn) for r in review.field_diff(d, "a", "b").collect()]
    assert got == [("amount", 20.0, True), ("date", 4.0, False), ("suffix", None, False), ("different value", None, True), ("different value", None, True)]


# ---- sources


def test_ingest(spark):
    emp = frame(spark, [("1", "Ana Bo", "a@x", "HR", "L1", ""), ("2", "Cy Do", "c@x", "HR", None, "7"), ("3", "Ed Fi", "", "IT", "L2", "")], "emp_id string, Name string, email string, category string, Level string, Salary string")
    cust = frame(spark, [("c1", "Zed", "p.pdf", "", None)], "customer_id string, customer_name string, invoice_paths string, purchase_order_paths string, shipping_order_paths string")
    prod = frame(spark, [("p1", "Lamp", "a| b |", "₹1,0", "₹2", "4", "x")], "product_id string, product_name string, category string, discounted_price string, actual_price string, rating string, about_product string")
    sale = frame(spark, [(1, "p1", "c1", "₹1", "₹2", "5%", "2024"), (2, "p9", "c1", "1", "2", "", "2024")], "sales_record_id int, product_id string, customer_id string, discounted_price string, actual_price string, discount_percentage string, Date_of_Purchase string")
    mail = frame(spark, [("m1", "t1", "d1", "1", "Ana Bo", "2", "First", "--\nana bo"), ("m2", "t1", "d2", "9", "Xi", "1", "Second", "--\nYu")], "email_id string, thread_id string, date string, sender_emp_id string, sender_name string, recipient_emp_id string, subject string, signature string")
    chat = frame(spark, [("k1", "1", "1", "d", "t" * 300)], "conversation_id string, sender_emp_id string, recipient_emp_id string, date string, text string")
    g, facts = ingest.build({"employees": emp, "customers": cust, "products": prod, "sales": sale, "emails": mail, "chats": chat})
    e = {(r.src, r.dst, r.rel_type) for r in g.edges.collect()}
    assert ("Employee:1", "Department:HR", "works_in") in e and ("Sale:1", "Product:p1", "product_in_sale") in e and not any("p9" in x[1] for x in e)
    assert ("Employee:1", "Email:m1", "sent_email") in e and not any(x[0] == "Employee:9" for x in e)
    f = {(r.node_id, r.key): r.value for r in facts.collect()}
    assert f["Product:p1", "discounted_price"] == "10" and json.loads(f["Product:p1", "category_hierarchy"]) == ["a", "b"] and ("Employee:1", "salary") not in f
    assert f["EmailThread:t1", "subject"] == "First" and f["Email:m2", "_signature_mismatch"] == "true" and ("Email:m1", "_signature_mismatch") not in f
    assert f["Conversation:k1", "summary"] == "t" * 200 + "..." and {r.role for r in ingest.chats(chat).edges.collect()} == {"recipient"}
    new, counts = ingest.enrich_resumes(facts, frame(spark, [("1", "my cv", "x"), ("77", "no", "y")], "emp_id string, Resume string, school string"))
    assert {(r.node_id, r.key): r.value for r in new.collect()}["Employee:1", "resume_text"] == "my cv" and tuple(counts.first()) == (1, 1)


def test_vendor_keys_and_policies(spark):
    v = ingest.vendors(frame(spark, [("v9", "Nord", 5), (None, "Sud", 6), (None, None, 7)], "`Vendor ID` string, `Vendor Name` string, Score int"))
    assert {r.node_id.split(":")[1][:6] for r in v.nodes.collect()} == {"v9", "Sud", "vendor"}
    p = ingest.policies(frame(spark, [("Data Use.md", "# Use\nbody line\n")], "file string, text string"))
    assert {r.key: r.value for r in p.facts.collect()}["category"] == "Data & Privacy" and p.nodes.first().node_id == "Policy:data-use"


def test_readers(spark, tmp_path, small):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"k1": {"x": 1}, "k2": {"x": 2, "y": "z"}}')
    (tmp_path / "c.csv").write_text('x,y\n1,"a\nb"\n')
    for n, t in (("Leave.md", "# L\nx"), ("README.md", "no"), ("invoice_1.md", "no"), ("blank.md", " \n"), (".hid.md", "no")):
        (tmp_path / n).write_text(t)
    assert readers.any_file(spark, str(tmp_path / "a.json")).count() == 2
    assert sorted((r._key, r.x) for r in readers.any_file(spark, str(tmp_path / "b.json")).collect()) == [("k1", 1), ("k2", 2)]
    assert readers.any_file(spark, str(tmp_path / "c.csv")).first().y == "a\nb"
    assert [r.file for r in readers.markdown_dir(spark, str(tmp_path)).collect()] == ["Leave.md"]
    assert {r.path.rsplit("/", 1)[1] for r in readers.discover(spark, str(tmp_path)).collect()} == {"a.json", "b.json", "c.csv"}
    readers.save_graph(small, str(tmp_path / "g"))
    assert readers.load_graph(spark, str(tmp_path / "g")).nodes.count() == 5
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "A:1", "type": "A", "properties": {"name": "N", "age": 3}}], "edges": [{"source": "A:1", "target": "A:1", "rel_type": "r"}]}))
    g = readers.import_graph_json(spark, str(tmp_path / "g.json"))
    assert g.nodes.first().title == "N" and g.edges.count() == 1
    readers.export_texts(small.nodes, str(tmp_path / "x"), ["a"], 1)
    assert spark.read.json(str(tmp_path / "x")).count() == 1


def test_each_pair_of_names_is_matched_once(monkeypatch):
    import pandas as pd

    from weftline.functions import text as T

    calls = []

    class Counted(T.SequenceMatcher):
        def __init__(self, *a):
            calls.append(a[1:])
            super().__init__(*a)

    monkeypatch.setattr(T, "SequenceMatcher", Counted)
    a, b = pd.Series(["once only nord", "once only sued"] * 500), pd.Series(["once only sued", "once only nord"] * 500)
    assert T.similarity.func(a, b).nunique() <= 2 and sorted(calls) == [("once only nord", "once only sued"), ("once only sued", "once only nord")]


def test_pairs_that_cannot_link_are_left_out_before_names_are_matched(spark, monkeypatch):
    r = random.Random(5)
    word = lambda: r.choice(["Nord", "Nordlicht", "Nordlichter", "Nord A", "Nord Bank of the Far East"])
    rows = [(f"Client:{i}", "Client", i, f"{word()} {r.choice('abc')}", r.choice(["T1", "T2", None]), r.choice(["1 Quay 53113", "1 Quay Rd 53113", "77 Some Other Street", None]), r.choice(["food", "steel"])) for i in range(60)]
    c = resolve.candidates(frame(spark, rows, "node_id string, node_type string, ord long, name string, tax_id string, address string, industry string"), resolve.RULES[0])
    got = lambda: sorted(map(repr, resolve.score(resolve.pairs(c)).select("a_node_id", "b_node_id", "score", "reasons", "id_conflict").collect()))
    few = got()
    monkeypatch.setattr(resolve, "_most", lambda: F.lit(1.0))
    assert few == got() and len(few) > 100


def test_edges_of_small_clusters_are_made_by_all_partitions(spark):
    """A few members make many edges, so neither adaptive coalescing nor a broadcast may leave them to one task."""
    n = frame(spark, [(f"Client:{i}", "Client", i, f"Nord {i // 4}", "T1" if i % 2 else "T2") for i in range(40)], "node_id string, node_type string, ord long, name string, tax_id string")
    c = resolve.candidates(n, resolve.RULES[0])
    s, m = resolve.linked(c, fuzzy=False)
    e = resolve.same_as(m, frame(spark, [(r.cluster, 0.6, [], "review") for r in m.select("cluster").distinct().collect()], "cluster string, top_score double, reasons array<string>, decision string"))
    assert e.count() == sum(k * (k - 1) for k in [r["count"] for r in m.groupBy("cluster").count().collect()]) > 0
    e.write.format("noop").mode("overwrite").save()
    assert e.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = resolve.pairs(c)
    assert p.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "/weftline-" in "".join(s.inputFiles()) and "/weftline-" in "".join(m.inputFiles())


def test_words_in_buffers_are_those_of_a_regex():
    import re

    import pyarrow as pa

    ts = ["", "ab", "cd e fg", "", "é_x9é ab-ab\x00zz", "q", "Kelvin".lower(), "end", "", "tail x"]
    a = pa.array(["skipped", *ts, "skipped"]).slice(1, len(ts))
    words, row = search._words(a)
    assert list(zip(row.tolist(), words.to_pylist())) == [(i, w) for i, t in enumerate(ts) for w in re.findall("[a-z0-9_]+", t) if len(w) > 1]


@pytest.mark.parametrize("most", [0, 10**6])
def test_index_of_repeated_ids_equals_a_count(spark, monkeypatch, most):
    """Postings are not shuffled but for ids of several rows; the weights are the same with and without a broadcast of idf."""
    from collections import Counter

    monkeypatch.setattr(search.Index, "BROADCAST_TERMS", most)
    monkeypatch.setattr(search, "SLICE_BYTES", 30)
    rows = [("P:1", "P", "Red", "the red fox red", "fox den", 1), ("P:1", "P", "Red", "red again", None, 1), ("P:2", "P", None, "Fox İ x y", "", 2), ("P:3", "P", "", None, "", 0)]
    d = frame(spark, rows, "node_id string, node_type string, title string, text string, relations string, degree int")
    i = search.Index(d, whole=F.col("text"))
    want = Counter((w, r[0]) for r in rows for w in search.query_terms(r[3] or ""))
    assert {(p.term, p.node_id): p.tf for p in i.posts.where("tf > 0").collect()} == want
    assert {(p.term, p.node_id) for p in i.posts.where("in_relations = 1").collect()} == {("fox", "P:1"), ("den", "P:1")}
    df = Counter(t for t, _ in want)
    for x in i.w.collect():
        assert x.w == pytest.approx((1 + math.log(want[x.term, x.node_id])) * (math.log(5 / (1 + df[x.term])) + 1))
    assert search.Index(d.dropDuplicates(["node_id"])).posts.count() > 0


def test_edges_are_hashed_after_one_shuffle(spark):
    rows = [("a", "b", "r", 1), ("a", "b", "r", 3), ("a", "c", "r", 2), ("c", "b", "r", None)]
    e = frame(spark, rows, "src string, dst string, rel_type string, ord long")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    best = last_wins(e)
    assert "SortAggregate" not in plan(best) and plan(best).count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in best.collect()} == {("a", "b", "r", 3), ("a", "c", "r", 2), ("c", "b", "r", None)}
    moved = resolve.rewire(e, frame(spark, [("c", "b"), ("b", "b")], "node_id string, canonical string"))
    assert "SortAggregate" not in plan(moved) and {tuple(r) for r in moved.collect()} == {("a", "b", "r", 2)}


def test_layers_walk_the_edges_once_a_hop(spark, tmp_path):
    frame(spark, [("a", "b", "r", 1), ("b", "c", "r", 2), ("c", "d", "r", 3)], "src string, dst string, rel_type string, ord long").write.parquet(f"{tmp_path}/e")
    g = ContextGraph(frame(spark, [(x,) for x in "abcd"], "node_id string"), spark.read.parquet(f"{tmp_path}/e"))
    layers = g.layers(frame(spark, [("a",)], "node_id string"))
    assert not any(f.startswith(f"file://{tmp_path}") for f in layers.inputFiles())
    assert {r.node_id: r.layer for r in layers.collect()} == {"a": "core", "b": "direct", "c": "context", "d": "ambient"}
    assert {(r.src, r.strength) for r in g.link_strength(layers).collect()} == {("a", "strong"), ("b", "soft"), ("c", "soft")}


def test_a_batch_is_folded_once(spark, monkeypatch, tmp_path):
    from weftline.runtime import Scratch

    rows = [("Email:1", "Email", "p", "1", "Workspace", 0, False), ("Email:1", "Email", "p", "2", "Workspace", 1, False)]
    frame(spark, rows, "node_id string, node_type string, key string, value string, source_system string, ord long, human boolean").write.parquet(f"{tmp_path}/b")
    s = Scratch(spark)
    for t in reingest.fold_batch(None, spark.read.parquet(f"{tmp_path}/b"), s):
        assert t.count() == 1 and all(s.path.removeprefix("file://") in f for f in t.inputFiles())
    s.close()
