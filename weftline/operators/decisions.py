"""Detection of inconsistent names, risk, proposals, and applying what was decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.dims import ACTIONS, RISK_THRESHOLD, lookup
from weftline.functions import text as T

# ---- detector


def signature_mismatch(sender: Column, signature: Column) -> Column:
    return ~F.contains(F.lower(signature), F.lower(sender))


def name_variants(emails: DataFrame, names: DataFrame) -> DataFrame:
    """(sender, hr_name, variant, n, first_ord) of signed names that aren't the sender's own.

    emails: sender, signature, mismatch, ord; names: sender, hr_name. Senders without a name are mailboxes and drop.
    """
    e = emails.where("mismatch").withColumn("variant", T.blank_to_null(T.signature_name(F.col("signature"))))
    e = e.where("variant is not null").groupBy("sender", "variant").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    return e.join(names, "sender").where(F.lower("variant") != F.lower("hr_name"))


def name_inconsistencies(emails: DataFrame, names: DataFrame, least: int = 2, top: int = 20) -> DataFrame:
    """One row per sender whose foreign signatures number at least `least`: totals and the top variants, most frequent first."""
    v = name_variants(emails, names)
    totals = v.groupBy("sender", "hr_name").agg(F.sum("n").alias("total_mismatched"), F.count("*").alias("distinct_variants")).where(F.col("total_mismatched") >= least)
    w = Window.partitionBy("sender").orderBy(F.desc("n"), "first_ord")
    best = v.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)
    best = best.groupBy("sender").agg(F.sort_array(F.collect_list(F.struct("rn", "variant", "n"))).alias("variants"))
    return totals.join(best, "sender")


# ---- risk


def action_of(decision: Column, same_type: Column) -> Column:
    return (
        F.when(decision == "different", "remove_same_as_edges")
        .when(decision == "same_entity", F.when(same_type, "merge_nodes").otherwise("upgrade_to_auto_linked"))
        .when(decision == "alias", "mark_alias")
        .when(decision == "shared_mailbox", "mark_shared_mailbox")
        .when(decision == "wrong_assignment", "flag_email_reassignment")
        .otherwise("no_action")
    )


def assess(d: DataFrame, threshold: float = RISK_THRESHOLD) -> DataFrame:
    """Adds action, base_cost, reversibility, final_cost, error_probability, risk and recommended.

    d: decision, confidence, same_type, cluster_size, id_conflict, small_model.
    """
    costs, undo = {k: v[0] for k, v in ACTIONS.items()}, {k: v[1] for k, v in ACTIONS.items()}
    one = F.lit(1.0)
    d = d.withColumn("action", action_of(F.col("decision"), F.col("same_type")))
    d = d.withColumn("base_cost", lookup(costs, F.col("action"), 0.0)).withColumn("reversibility", lookup(undo, F.col("action")))
    factor = F.when(F.col("cluster_size") > 3, 1.3).otherwise(one)
    factor = factor * F.when(F.col("id_conflict") & (F.col("decision") == "same_entity"), 1.6).otherwise(one)
    factor = factor * F.when(F.col("small_model"), 1.25).otherwise(one) * F.when(F.col("decision") == "uncertain", 2.0).otherwise(one)
    d = d.withColumn("final_cost", F.col("base_cost") * factor)
    d = d.withColumn("error_probability", F.greatest(F.lit(0.0), F.least(one, one - F.col("confidence"))))
    d = d.withColumn("risk", F.col("error_probability") * F.col("final_cost"))
    ok = (F.col("action") != "no_action") & (F.col("risk") < threshold)
    return d.withColumn("recommended", F.when(ok, "auto_act").otherwise("escalate"))


def percentiles(d: DataFrame, value: str = "risk") -> DataFrame:
    """Median and 95th by index n // 2 and min(n - 1, int(0.95 n)), and the maximum.

    Ranks come from counts of distinct values, so no array of all values is built.
    """
    h = d.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    all_ = F.col("all")
    return h.agg(at(F.floor(all_ / 2)).alias("p50"), at(F.least(all_ - 1, F.floor(all_ * 0.95))).alias("p95"), F.max("v").alias("max"))


# ---- proposals

_MATCH_MENU = tuple("merge_nodes upgrade_to_auto_linked remove_same_as_edges no_action investigate_further".split())
_NAME_MENU = tuple("mark_alias mark_shared_mailbox flag_email_reassignment no_action investigate_further".split())


def alternatives(action: Column, same_type: Column, about_names: Column) -> Column:
    menu = lambda xs: F.array(*[F.lit(x) for x in xs])
    match = F.when(same_type, menu([x for x in _MATCH_MENU if x != "upgrade_to_auto_linked"])).otherwise(menu(_MATCH_MENU[1:]))
    return F.array_remove(F.when(about_names, menu(_NAME_MENU)).otherwise(match), action)


def expected_changes(action: Column, size: Column, entity: Column) -> Column:
    """What would happen, as short lines."""
    n = (size * (size - 1)).cast("string")
    s = size.cast("string")
    line = lambda *xs: F.array(*[F.concat(*[y if isinstance(y, Column) else F.lit(y) for y in (x if isinstance(x, tuple) else (x,))]) for x in xs])
    return (
        F.when(action == "merge_nodes", line(("keep ", entity, " as the canonical node"), ("fold ", (size - 1).cast("string"), " alias nodes into it"), "record the merge in its provenance"))
        .when(action == "upgrade_to_auto_linked", line(("set ", n, " same_as edges between ", s, " members to auto_linked"), "all nodes stay"))
        .when(action == "remove_same_as_edges", line(("delete ", n, " same_as edges between ", s, " members"), "records stay apart"))
        .when(action == "mark_alias", line(("add aliases to ", entity), "edges and nodes stay"))
        .when(action == "mark_shared_mailbox", line(("flag ", entity, " as a shared mailbox"), "edges and nodes stay"))
        .when(action == "flag_email_reassignment", line(("dispute the sender of ", s, " emails under ", entity), "edges stay until reviewed"))
        .otherwise(line("the conflict stays in the queue"))
    )


def propose(assessed: DataFrame) -> DataFrame:
    """Adds kind, auto_applied, confidence_label, alternatives and expected_changes (needs about_names, entity)."""
    auto = F.col("recommended") == "auto_act"
    p = assessed.withColumn("kind", F.when(auto, "post_hoc_audit").otherwise("pending_confirmation")).withColumn("auto_applied", auto)
    p = p.withColumn("confidence_label", T.confidence_label(F.col("confidence")))
    p = p.withColumn("alternatives", alternatives(F.col("action"), F.col("same_type"), F.col("about_names")))
    return p.withColumn("expected_changes", expected_changes(F.col("action"), F.col("cluster_size"), F.col("entity")))


def pending(proposals: DataFrame) -> DataFrame:
    return proposals.where(F.col("kind") == "pending_confirmation")


# ---- applying


def headline(members: DataFrame) -> DataFrame:
    """(cluster, name): each cluster's most frequent name, the first seen of equals; members: cluster, name, ord."""
    c = members.where(T.blank_to_null(F.col("name")).isNotNull()).groupBy("cluster", "name").agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    return c.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "o", "name")).alias("b")).select("cluster", F.col("b.name").alias("name"))


def mark_alias(nodes: DataFrame, variants: DataFrame) -> DataFrame:
    """Adds unseen names to `aliases` (array); variants: node_id, names."""
    j = nodes.join(variants, "node_id", "left")
    return j.withColumn("aliases", F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("names", F.array().cast("array<string>")))).drop("names")


def mark_shared_mailbox(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    if "is_shared_mailbox" not in nodes.columns:
        nodes = nodes.withColumn("is_shared_mailbox", F.lit(False))
    hit = ids.select("node_id").distinct().withColumn("_hit", F.lit(True))
    return nodes.join(hit, "node_id", "left").withColumn("is_shared_mailbox", F.coalesce("_hit", "is_shared_mailbox", F.lit(False))).drop("_hit")


def flag_reassignment(emails: DataFrame, suggested: DataFrame) -> DataFrame:
    """Emails of the given senders whose signature differs become disputed; suggested: sender, suggested_sender."""
    j = emails.join(suggested, "sender", "left")
    hit = F.col("mismatch") & F.col("suggested_sender").isNotNull()
    return j.withColumn("disputed", hit).withColumn("suggested_sender", F.when(hit, F.col("suggested_sender")))


def apply_status(conflicts: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Confirmed conflicts (conflict_ix, action) become human_resolved; the action is kept as audit."""
    c = confirmed.select("conflict_ix", F.col("action").alias("applied_action"))
    j = conflicts.join(c, "conflict_ix", "left")
    return j.withColumn("status", F.when(F.col("applied_action").isNotNull(), "human_resolved").otherwise(F.col("status")))


def select_pending(conflicts: DataFrame, most: int | None = None) -> DataFrame:
    """Conflicts that a decider takes: cluster matches and name inconsistencies under review, at most `most` if given."""
    p = conflicts.where(F.col("conflict_type").isin("entity_match_review", "employee_name_inconsistency") & (F.col("status") == "pending_review"))
    return p.orderBy("conflict_ix").limit(most) if most else p


def id_conflict(reason: Column) -> Column:
    """Whether a review's reason speaks of identifiers that disagree."""
    return F.coalesce(F.lower(reason).rlike("tax_id|disagree|_id"), F.lit(False))


def annotate(conflicts: DataFrame, decided: DataFrame) -> DataFrame:
    """Conflicts with what was decided about them: `review` (decision, confidence, action, risk, recommended) and the status that follows.

    What may be done at once becomes llm_resolved, what is risky pending_human_after_llm; undecided conflicts stay.
    decided: conflict_ix and the columns of assess().
    """
    r = decided.select("conflict_ix", F.struct("decision", "confidence", "action", "risk", "recommended").alias("review"))
    j = conflicts.join(r, "conflict_ix", "left")
    status = F.when(F.col("review").isNull(), F.col("status")).when(F.col("review.recommended") == "auto_act", "llm_resolved").otherwise("pending_human_after_llm")
    return j.withColumn("status", status)


def run_stats(decided: DataFrame) -> DataFrame:
    """(metric, name, value) of a run: totals, mix of decisions, actions and recommendations, and means."""
    one = lambda name, v: F.struct(F.lit(name).alias("metric"), F.lit("").alias("name"), v.cast("double").alias("value"))
    cells = decided.agg(F.array(one("decided", F.count("*")), one("mean_confidence", F.avg("confidence")), one("mean_risk", F.avg("risk")), one("auto_acted", F.count_if(F.col("recommended") == "auto_act"))).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    for c in ("decision", "action", "recommended"):
        cells = cells.unionByName(decided.groupBy(c).agg(F.count("*").cast("double").alias("value")).select(F.lit(c).alias("metric"), F.col(c).alias("name"), "value"))
    return cells


def audit(decided: DataFrame, members: DataFrame) -> DataFrame:
    """(node_id, conflict_ix, action, kind): one entry for each member that an action touches; members: conflict_ix, node_id."""
    d = decided.where("action <> 'no_action'").select("conflict_ix", "action", F.when(F.col("recommended") == "auto_act", "llm").otherwise("human").alias("kind"))
    return members.join(d, "conflict_ix").select("node_id", "conflict_ix", "action", "kind")


def apply_actions(edges: DataFrame, nodes: DataFrame, members: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, nodes, aliases) after the decided actions; members: conflict_ix, node_id; decided: conflict_ix, action.

    Removals and upgrades act on same_as edges, marks on nodes (columns aliases, is_shared_mailbox); for merge_nodes
    the aliases (node_id, canonical) come back, for resolve.merge_graph. Other actions change nothing here.
    """
    from weftline.operators import resolve

    m = members.join(decided.select("conflict_ix", "action"), "conflict_ix")
    of = lambda a: m.where(F.col("action") == a).select("node_id", F.col("conflict_ix").cast("string").alias("cluster"))
    e = resolve.upgrade_same_as(resolve.remove_same_as(edges, of("remove_same_as_edges")), of("upgrade_to_auto_linked"))
    n = mark_shared_mailbox(nodes, of("mark_shared_mailbox"))
    merged = of("merge_nodes")
    keep = merged.groupBy("cluster").agg(F.min("node_id").alias("canonical"))
    return e, n, merged.join(keep, "cluster").select("node_id", "canonical")


def recorded(pending_: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending conflicts with their recorded decision by cluster key, model and prompt version; uncertain where none."""
    j = pending_.join(decisions, ["cluster_key", "model", "prompt_version"], "left")
    return j.withColumn("decision", F.coalesce("decision", F.lit("uncertain"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def parse_decision(text: Column) -> Column:
    """struct(decision, confidence, reasoning) of a model's answer: a fenced or bare JSON object, else the outermost braces."""
    schema = "decision string, confidence double, reasoning string"
    bare = F.regexp_replace(F.trim(text), "^```[a-z]*\\s*|\\s*```$", "")
    inner = F.regexp_extract(bare, "(?s)(\\{.*\\})", 1)
    first = F.from_json(bare, schema)
    return F.when(first["decision"].isNotNull(), first).otherwise(F.from_json(inner, schema))
