"""Schemas of the stored tables."""

DOMAINS = "id STRING, name STRING, description STRING, created TIMESTAMP, last_access TIMESTAMP"

TAG_STRUCT = (
    "STRUCT<category: STRING, confidence: DOUBLE, domain: STRING, attributes: MAP<STRING, STRING>>"
)

NODES = (
    "id STRING, type STRING, doc_id STRING, page_no INT, content STRING, path STRING, "
    "content_summary STRING, summary_ts TIMESTAMP, ts TIMESTAMP, confidence DOUBLE, "
    f"ontology ARRAY<{TAG_STRUCT}>, domain STRING"
)

EDGES = (
    "id STRING, source STRING, target STRING, type STRING, strength DOUBLE, confidence DOUBLE, "
    "evidence ARRAY<STRING>, ts TIMESTAMP, domain STRING"
)

TAGS = "node_id STRING, tag STRING"

DOMAIN_REFS = (
    "node_id STRING, domain STRING, target_domain STRING, target_node_id STRING, "
    "description STRING, bidirectional BOOLEAN"
)

TABLES = {
    "domains": DOMAINS,
    "nodes": NODES,
    "edges": EDGES,
    "tags": TAGS,
    "domain_refs": DOMAIN_REFS,
}

# Tables laid out by domain: a rebuild of one domain replaces its partition only.
PARTITIONED = {"nodes": "domain", "edges": "domain"}

NODE_TYPES = ["document", "section", "page", "concept", "entity", "summary", "metadata"]
EDGE_TYPES = [
    "part_of", "precedes", "references", "relates_to", "contains", "summarizes",
    "derived_from", "similar_to", "contradicts", "supports", "defines", "example_of",
]
