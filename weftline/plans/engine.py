"""The library's front: a graph with its facts, feed and conflicts behind one object.

Every call returns DataFrames; nothing is mutated in place. Writes append to the feed, and the state is
the fold of the feed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline import dims
from weftline.operators import decisions, pages, resolve, search, upsert, views
from weftline.operators.graph import ContextGraph
from weftline.runtime import Scratch
from weftline.sources import ingest

#: A decider turns pending conflicts into (cluster_key, decision, confidence); the default reads a recorded table.
Decider = Callable[[DataFrame], DataFrame]


def table_decider(recorded: DataFrame) -> Decider:
    return lambda pending: decisions.recorded(pending, recorded)


def payload(members: DataFrame, fields: tuple[str, ...] = ("business_name", "name", "industry", "tax_id", "registered_address", "contact_email", "phone_number")) -> DataFrame:
    """(cluster, payload): JSON of whitelisted fields of each member, for a decider elsewhere."""
    have = [f for f in fields if f in members.columns]
    return members.groupBy("cluster").agg(F.to_json(F.sort_array(F.collect_list(F.struct("node_id", "node_type", *have)))).alias("payload"))


def prompt(payloads: DataFrame) -> DataFrame:
    """(cluster, prompt): instructions and the payload as one text."""
    head = "Decide whether these records describe one entity. Answer with a JSON object: decision (same_entity, different or uncertain), confidence (0 to 1), reasoning.\n\n"
    return payloads.select("cluster", F.concat(F.lit(head), "payload").alias("prompt"))


#: Properties that name a node.
TITLES = ("name", "business_name", "subject", "issue", "title", "summary")


@dataclass
class Engine:
    """Records go through one path: they join the feed, the feed is folded, and the fold gives facts, conflicts and changes.

    Graph, feed and facts are tables in the shared folder, so pages and the index read a state instead of folding
    the feed for every section.
    """

    graph: ContextGraph
    facts: DataFrame
    provenance: DataFrame
    feed: DataFrame | None = None
    notes: DataFrame | None = None
    _index: search.Index | None = field(default=None, repr=False)

    @classmethod
    def ingest(cls, records: dict[str, DataFrame], sources: list[str] | None = None, base: Engine | None = None) -> Engine:
        """An engine over record tables; on a base, the records come after all that it has."""
        first = next(iter(records.values()), None)
        s = Scratch(first.sparkSession) if first is not None else None
        g, facts = ingest.build(records, sources, base.graph if base else None, base._last() if base else None, s and s.save)
        kind = F.substring_index("node_id", ":", 1)
        feed = facts.select("node_id", kind.alias("node_type"), "key", "value", "source_system", "ord", F.lit(False).alias("human"))
        prov = facts.select("node_id", "source_system", F.lit("").alias("file")).distinct()
        if base is not None:
            feed = base.feed.unionByName(feed) if base.feed is not None else feed
            prov = base.provenance.unionByName(prov, allowMissingColumns=True).distinct()
        feed = s.save(feed, "feed")
        g = ContextGraph(g.nodes, s.save(g.edges, "edges"))
        return cls(g, s.save(upsert.facts(upsert.fold(feed)), "facts"), s.save(prov, "provenance"), feed, base.notes if base else None)

    def _last(self) -> int | None:
        """The feed's last ordinal."""
        return self.feed.agg(F.max("ord")).first()[0] if self.feed is not None else None

    def _folded(self) -> DataFrame | None:
        return upsert.fold(self.feed) if self.feed is not None else None

    def conflicts(self, status: str | None = None) -> DataFrame:
        """Conflicts of the feed, or those of one status."""
        return upsert.list_conflicts(upsert.conflicts(self._folded()), status)

    def changes(self) -> DataFrame:
        return upsert.change_log(self._folded())

    def stats(self) -> DataFrame:
        return self.graph.stats(self.conflicts() if self.feed is not None else None)

    def status(self) -> DataFrame:
        """(ready, documents, modes): whether the index is built, how many documents it has, what it can do."""
        row = (self._index is not None, self._index.n if self._index is not None else 0, list(search.MODES))
        return self.graph.nodes.sparkSession.createDataFrame([row], "ready boolean, documents long, modes array<string>")

    def ls(self, section: str = "") -> DataFrame:
        """The root's directories, or a section's entries; an unknown section is an error."""
        if not section:
            return views.root_listing(self.graph.nodes_by_type(), dims.SECTIONS)
        if section not in dims.SECTIONS:
            raise KeyError(section)
        return views.listing(self.graph.nodes, section, dims.SECTIONS[section])

    def page(self, section: str, key: str) -> DataFrame:
        """One page as (node_id, page), with notes and recent changes; clients, vendors and products are their properties as JSON."""
        kind = dims.SECTIONS[section]
        one = self.graph.nodes.where(F.col("node_id") == f"{kind}:{key}").select("node_id")
        make = {"people": pages.employees, "teams": pages.teams, "policies": pages.policies, "threads": pages.threads, "it-tickets": pages.tickets, "projects": pages.projects}.get(section)
        if make:
            extra = views.change_block(self.changes().join(one, "node_id", "left_semi")) if self.feed is not None else []
            if self.notes is not None:
                extra += views.notes_block(self.notes.join(one, "node_id", "left_semi"))
            return make(self.graph, self.facts, self.provenance, one, extra)
        return self.facts.join(one, "node_id", "left_semi").groupBy("node_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", "value"))))).alias("page"))

    def index(self) -> search.Index:
        if self._index is None:
            self._index = search.Index(pages.documents(self.graph, self.facts))
        return self._index

    def retrieve(self, query: str, mode: str = "auto", k: int = 5, node_type: str | None = None, hops: int = 1, related: int = 6) -> DataFrame:
        """The best nodes: rank, node_id, title, score, matched terms, evidence, up to `related` neighbours' titles, and the context as one text."""
        if k < 1 or hops < 0 or related < 0:
            raise ValueError("k must be at least 1, hops and related at least 0")
        top = self.index().search(query, mode, k, node_type)
        w = Window.orderBy(F.desc("score"), "node_id")  # at most k rows
        top = top.withColumn("rank", F.row_number().over(w)).withColumn("score", F.round("score", 4))
        near = self.graph.neighbours(top).withColumn("way", F.when(F.col("direction") == "outgoing", 0).otherwise(1))
        proof = search.evidence_lines(top, self.facts, near, query)
        near = near.groupBy("node_id").agg(F.slice(F.transform(F.sort_array(F.collect_set(F.struct("way", "ord", "other", "other_title"))), lambda x: x["other_title"]), 1, related).alias("relations"))
        out = top.join(self.graph.nodes.select("node_id", "title"), "node_id").join(self.index().matched(query), "node_id", "left").join(proof, "node_id", "left").join(near, "node_id", "left")
        none = F.array().cast("array<string>")
        out = out.select("rank", "node_id", "title", "score", F.coalesce("matched", none).alias("matched"), F.coalesce("evidence", none).alias("evidence"), F.coalesce("relations", none).alias("relations"))
        context = F.concat_ws("\n", F.concat(F.col("rank").cast("string"), F.lit(". "), "title", F.lit(" ("), "node_id", F.lit(")")), F.array_join("evidence", "; "), F.array_join("relations", "; "))
        return out.withColumn("context", context).orderBy("rank")

    def edit(self, node_id: str, key: str, value: str, at: int) -> Engine:
        """An edit by hand, as a record of the feed at ordinal `at` or after all that is there; it always applies, and pages and the index follow."""
        last = self._last()
        at = at if last is None else max(at, last + 1)
        spark = self.graph.nodes.sparkSession
        kind = node_id.split(":", 1)[0]
        row = spark.createDataFrame([(node_id, kind, key, value, upsert.HUMAN, at, True)], "node_id string, node_type string, key string, value string, source_system string, ord long, human boolean")
        if self.feed is not None:
            feed = self.feed.unionByName(row)
        else:  # the facts at hand come first
            source = F.col("source_system") if "source_system" in self.facts.columns else F.lit(None).cast("string")
            old = self.facts.select("node_id", F.substring_index("node_id", ":", 1).alias("node_type"), "key", "value", source.alias("source_system"), F.lit(-1).cast("long").alias("ord"), F.lit(False).alias("human"))
            feed = old.unionByName(row)
        facts = Scratch(spark).save(upsert.facts(upsert.fold(feed)), "facts")
        nodes = self.graph.nodes
        if key in TITLES:
            best = F.coalesce(*[F.max(F.when(F.col("key") == k, F.col("value"))) for k in TITLES])
            mine = facts.where(F.col("node_id") == node_id).agg(best.alias("_t"))  # one row
            here = F.col("node_id") == node_id
            nodes = nodes.join(F.broadcast(mine)).withColumn("title", F.when(here, F.coalesce("_t", "title")).otherwise(F.col("title"))).withColumn("text", F.when(here, F.lower("title")).otherwise(F.col("text"))).drop("_t")
        return Engine(ContextGraph(nodes, self.graph.edges), facts, self.provenance, feed, self.notes)

    def annotate(self, node_id: str, author: str, body: str, at: str) -> Engine:
        """A note on a node: a Note node with a 12-digit hex id, and an annotates edge."""
        spark = self.graph.nodes.sparkSession
        n = spark.createDataFrame([(node_id, author, body, at)], "node_id string, author string, body string, created_at string")
        n = n.withColumn("note_id", F.concat(F.lit("Note:"), F.substring(F.sha2(F.concat_ws("\0", "node_id", "author", "body", "created_at"), 256), 1, 12)))
        nodes = self.graph.nodes.unionByName(n.select(F.col("note_id").alias("node_id"), F.lit("Note").alias("node_type"), F.lit(2**62).alias("ord"), F.col("body").alias("title"), F.lower("body").alias("text")), allowMissingColumns=True)
        edges = self.graph.edges.unionByName(n.select(F.col("note_id").alias("src"), F.col("node_id").alias("dst"), F.lit("annotates").alias("rel_type"), F.lit(2**62).alias("ord")), allowMissingColumns=True)
        notes = n.drop("note_id") if self.notes is None else self.notes.unionByName(n.drop("note_id"))
        return Engine(ContextGraph(nodes, edges), self.facts, self.provenance, self.feed, notes)

    def resolve(self, rule: resolve.Rule, fuzzy: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(members, decisions, same_as edges) of one rule over the graph's nodes and their properties."""
        keys = ["tax_id", "registered_address", "industry", "contact_email", "phone_number", "business_representative_employee"]
        w = pages.wide(self.facts, keys)
        n = self.graph.nodes.join(w, "node_id", "left").withColumnsRenamed({"title": "name", "registered_address": "address", "business_representative_employee": "representative"})
        c = resolve.candidates(n, rule)
        s, m = resolve.linked(c, fuzzy)
        d = resolve.decide(c, m, s)
        return m, d, resolve.same_as(m, d)
