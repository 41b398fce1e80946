"""Small fixed tables of the engine: authority, canonical sources, action costs, hints, stop words.

They are literals of bounded size and used as map or CASE expressions, so no join is planned for them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HR, CRM, BM, IT = "Human_Resource_Management", "Customer_Relation_Management", "Business_and_Management", "IT_Service_Management"

#: Trust in a source; one that isn't listed counts 0.
AUTHORITY = {BM: 85, "Collaboration_tools": 50, CRM: 90, "Enterprise_Mail_System": 60, "Enterprise_Social_Platform": 40, HR: 100, IT: 80, "Inazuma_overflow": 30, "Workspace": 75}
AUTHORITY_GAP = 20

_DECIDES = {"Workspace": "GitHubIssue GitHubRepo", IT: "ITTicket", BM: "Vendor Client", CRM: "Sale Review Product Customer", HR: "Department Employee"}
#: Which source decides about a node type whatever the authority gap.
CANONICAL = {t: s for s, ts in _DECIDES.items() for t in ts.split()}

#: (cost of a wrong decision, how easily it is undone) by action.
ACTIONS = {
    "no_action": (0.0, "trivial"),
    "mark_alias": (10.0, "trivial"),
    "remove_same_as_edges": (15.0, "trivial"),
    "mark_shared_mailbox": (25.0, "easy"),
    "upgrade_to_auto_linked": (40.0, "medium"),
    "flag_email_reassignment": (50.0, "medium"),
    "merge_nodes": (90.0, "hard"),
}
RISK_THRESHOLD = 5.0

MERGE_AT, LINK_AT, CROSS_LINK_AT, CONFLICT_CAP = 0.85, 0.50, 0.75, 0.55

STOP_WORDS = sorted("with who which where when what were was to this their the that or on of it is into in how from for by be at as are and an a".split())

_HINTS = {
    "Client": "client clients", "Conversation": "chat conversation conversations", "Customer": "customer customers", "Department": "department team teams",
    "Email": "email emails", "EmailThread": "email emails thread threads", "Employee": "employee employees people", "GitHubIssue": "github issue issues",
    "GitHubRepo": "github repo repository", "ITTicket": "issue issues ticket tickets", "Policy": "policies policy", "Product": "product products",
    "Review": "review reviews", "Sale": "sale sales", "SupportChat": "chat support", "Vendor": "vendor vendors",
}
#: Query words that speak for node types.
TYPE_HINTS: dict[str, list[str]] = {}
for _t, _ws in _HINTS.items():
    for _w in _ws.split():
        TYPE_HINTS.setdefault(_w, []).append(_t)

#: Section of a path to node type.
SECTIONS = {
    "clients": "Client", "customers": "Customer", "it-tickets": "ITTicket", "people": "Employee", "policies": "Policy", "products": "Product",
    "projects": "EmailThread", "teams": "Department", "threads": "EmailThread", "vendors": "Vendor",
}


def lookup(table: dict, key: Column, default=None) -> Column:
    """A dictionary as an expression."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def sql_case(table: dict, key: str, default: str = "NULL") -> str:
    """The same as SQL text, for comparisons."""
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in table.items()) + f" ELSE {default} END"
