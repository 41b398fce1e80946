"""Row types of the graph's tables. Property values are canonical JSON texts, so that they compare and group."""

NODES = "node_id string, node_type string, ord long"
FACTS = "node_id string, key string, value string, ord long"
EDGES = "src string, dst string, rel_type string, ord long"
PROVENANCE = "struct<source_system:string,file:string,record_id:string,field:string,confidence:double,ingested_at:string>"
CHANGES = "node_id string, key string, kind string, old_value string, new_value string, source_system string, ord long"
CONFLICTS = "node_id string, key string, existing_value string, new_value string, existing_source string, new_source string, status string, winner string, ord long"
FEED = "node_id string, node_type string, key string, value string, source_system string, ord long, human boolean"
