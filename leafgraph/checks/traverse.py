"""Walks and statistics."""

from pyspark.sql import functions as F

from leafgraph.checks.base import CTES, query
from leafgraph.checks.graph import DOC, NEXT, PAGE
from leafgraph.checks.search import memo, memo_edges
from leafgraph.operators import graph, shape, traverse
from leafgraph.schemas import TAG_STRUCT
from leafgraph.sources import adapters as A

CTES["c_graph"] = f"""c_nodes AS (
    SELECT {PAGE} AS id, 'page' AS type, doc_id, page_no, text AS content FROM docs
    UNION ALL SELECT DISTINCT {DOC}, 'document', doc_id, NULL, 'Document: ' || doc_id FROM docs),
  c_links AS (
    SELECT {PAGE} AS source, {DOC} AS target, 'part_of' AS type FROM docs
    UNION ALL SELECT {PAGE}, {NEXT}, 'precedes' FROM docs p WHERE EXISTS (
      SELECT 1 FROM docs q WHERE q.doc_id = p.doc_id AND q.page_no = p.page_no + 1)),
  c_both AS (SELECT source, target FROM c_links UNION ALL SELECT target, source FROM c_links)"""
CGRAPH = ("conv_docs", "c_graph")


def conv_nodes(spark, d):
    pages = A.convs(spark, d)
    page = pages.select(
        graph.page_node("documents").alias("id"), F.lit("page").alias("type"), "doc_id", "page_no",
        F.col("text").alias("content"),
    )
    doc = pages.select("doc_id").distinct().select(
        graph.document_node("documents").alias("id"), F.lit("document").alias("type"), "doc_id",
        F.lit(None).cast("int").alias("page_no"), F.concat(F.lit("Document: "), "doc_id").alias("content"),
    )
    return page.unionByName(doc).withColumn("path", F.lit("/"))


def conv_links(spark, d):
    return graph.structural_edges(A.convs(spark, d), min_length=0)


def first_pages(spark, d):
    return A.convs(spark, d).filter("page_no = 0").select(graph.page_node("documents").alias("start"))


def all_pages(spark, d):
    return A.convs(spark, d).select(graph.page_node("documents").alias("start"))


def _walk_sql(links: str, depth: int, starts: str = "page_no = 0") -> str:
    return f"""walk AS (SELECT {PAGE} AS start, {PAGE} AS node, 0 AS depth FROM docs WHERE {starts}
      UNION SELECT w.start, l.target, w.depth + 1 FROM walk w JOIN {links} l ON l.source = w.node WHERE w.depth < {depth}),
    seen AS (SELECT start, node, min(depth) AS depth FROM walk GROUP BY start, node)"""


CTES["walk_out"] = _walk_sql("c_links", 2)
CTES["walk_both"] = _walk_sql("c_both", 2)
CTES["walk_out_all"] = _walk_sql("c_links", 2, "true")
CTES["walk_both_all"] = _walk_sql("c_both", 2, "true")


@query(
    "Q8_outgoing_nodes",
    """SELECT start, node, depth, CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END
      AS content FROM seen JOIN c_nodes ON id = node""",
    (*CGRAPH, "walk_out"),
    recursive=True,
)
def q8(spark, d):
    nodes, _ = traverse.outgoing_graph(first_pages(spark, d), conv_nodes(spark, d), conv_links(spark, d))
    return nodes.select("start", "node", "depth", "content")


@query(
    "Q8_outgoing_edges",
    "SELECT start, source, target, type FROM seen JOIN c_links ON source = node",
    (*CGRAPH, "walk_out"),
    recursive=True,
)
def q8b(spark, d):
    _, edges = traverse.outgoing_graph(first_pages(spark, d), conv_nodes(spark, d), conv_links(spark, d))
    return edges.select("start", "source", "target", "type")


@query(
    "Q9_subgraph_nodes",
    "SELECT start, node, depth FROM seen",
    (*CGRAPH, "walk_both"),
    recursive=True,
)
def q9(spark, d):
    nodes, _ = traverse.subgraph(first_pages(spark, d), conv_links(spark, d), 2)
    return nodes


@query(
    "Q9_subgraph_edges",
    """SELECT DISTINCT start, source, target, type FROM seen JOIN c_links ON source = node OR target = node""",
    (*CGRAPH, "walk_both"),
    recursive=True,
)
def q9b(spark, d):
    _, edges = traverse.subgraph(first_pages(spark, d), conv_links(spark, d), 2)
    return edges.select("start", "source", "target", "type")


@query(
    "Q8_outgoing_nodes_whole",
    """SELECT start, node, depth, CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END
      AS content FROM seen JOIN c_nodes ON id = node""",
    (*CGRAPH, "walk_out_all"),
    recursive=True,
)
def q8_whole(spark, d):
    nodes, _ = traverse.outgoing_graph(all_pages(spark, d), conv_nodes(spark, d), conv_links(spark, d))
    return nodes.select("start", "node", "depth", "content")


@query(
    "Q8_outgoing_edges_whole",
    "SELECT start, source, target, type FROM seen JOIN c_links ON source = node",
    (*CGRAPH, "walk_out_all"),
    recursive=True,
)
def q8b_whole(spark, d):
    _, edges = traverse.outgoing_graph(all_pages(spark, d), conv_nodes(spark, d), conv_links(spark, d))
    return edges.select("start", "source", "target", "type")


@query(
    "Q9_subgraph_nodes_whole",
    "SELECT start, node, depth FROM seen",
    (*CGRAPH, "walk_both_all"),
    recursive=True,
)
def q9_whole(spark, d):
    nodes, _ = traverse.subgraph(all_pages(spark, d), conv_links(spark, d), 2)
    return nodes


@query(
    "Q9_subgraph_edges_whole",
    """SELECT DISTINCT start, source, target, type FROM seen JOIN c_links ON source = node OR target = node""",
    (*CGRAPH, "walk_both_all"),
    recursive=True,
)
def q9b_whole(spark, d):
    _, edges = traverse.subgraph(all_pages(spark, d), conv_links(spark, d), 2)
    return edges.select("start", "source", "target", "type")


@query(
    "Q10_shortest_path",
    """WITH ends AS (SELECT 'n' || CAST(doc_id AS VARCHAR) AS start, 'n' || CAST(doc_id + 1 AS VARCHAR) AS goal
        FROM documents),
      links AS (SELECT source, target FROM memo_edges UNION ALL SELECT target, source FROM memo_edges),
      up AS (SELECT start, start AS node, 0 AS hops FROM ends
        UNION ALL SELECT u.start, e.target, u.hops + 1 FROM up u JOIN memo_edges e ON e.source = u.node WHERE u.hops < 4)
    SELECT p.start, p.goal, min(a.hops + b.hops) AS hops FROM ends p
    JOIN up a ON a.start = p.start JOIN up b ON b.start = p.goal AND b.node = a.node
    GROUP BY p.start, p.goal HAVING min(a.hops + b.hops) <= 4""",
    ("memo",),
    recursive=True,
)
def q10(spark, d):
    name = F.col("id")
    pairs = memo(spark, d).select(
        name.alias("start"),
        F.concat(F.lit("n"), (F.substring(name, 2, 20).cast("bigint") + 1).cast("string")).alias("goal"),
    )
    # The tree joins n0 to n1 only, so every path is the one in the tree.
    out = traverse.shortest_path(pairs, memo_edges(spark, d), 4)
    return out.select("start", "goal", "hops")


@query(
    "Q11_type_stats",
    """SELECT 'node' AS kind, type, count(*) AS n FROM c_nodes GROUP BY type
    UNION ALL SELECT 'edge', type, count(*) FROM c_links GROUP BY type""",
    CGRAPH,
)
def q11(spark, d):
    return traverse.type_stats(conv_nodes(spark, d), conv_links(spark, d))


@query(
    "Q12_coverage",
    """SELECT count(*) AS total_nodes, round(avg(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END), 6) AS ontology_coverage,
      count(*) AS total_pages, CAST(sum(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS summary_count,
      round(avg(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END), 6) AS semantic_coverage FROM memo""",
    ("memo",),
)
def q12(spark, d):
    k = F.substring("id", 2, 20).cast("bigint")
    tag = F.array(graph.ontology_tag(F.col("domain"), F.lit(1.0), F.lit("general")))
    none = F.array().cast(tag_type())
    nodes = memo(spark, d).withColumns(
        {
            "ontology": F.when(k % 3 == 0, tag.cast(tag_type())).otherwise(none),
            "content_summary": F.when(k % 2 == 0, F.col("content_summary")),
        }
    )
    out = traverse.coverage(nodes)
    return out.withColumns(
        {c: F.round(c, 6) for c in ("ontology_coverage", "semantic_coverage")}
    )


def tag_type():
    return f"array<{TAG_STRUCT}>"


CTES["islands"] = f"""admitted AS (SELECT doc_id, page_no FROM books
    WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) >= 50),
  islands AS (SELECT doc_id, page_no, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS g FROM admitted),
  chain AS (SELECT doc_id, page_no, first_value(page_no) OVER (PARTITION BY doc_id, g ORDER BY page_no) AS head_no FROM islands)"""


@query(
    "Q13_chains",
    f"""SELECT {PAGE.replace('page_no', 'head_no')} AS head, CAST(page_no - head_no AS BIGINT) AS position,
      {PAGE} AS node FROM chain""",
    ("books", "islands"),
)
def q13(spark, d):
    members, _, _ = traverse.chains(*_book_pages(spark, d))
    return members


@query(
    "Q13_chain_stats",
    """SELECT count(*) AS count, count(*) FILTER (has_next) AS traversable_count,
      round(avg(CASE WHEN has_next THEN 1 ELSE 0 END), 6) AS traversal_share,
      CAST(max(page_no - head_no) + 1 AS BIGINT) AS longest_chain FROM (
        SELECT *, lead(page_no) OVER (PARTITION BY doc_id ORDER BY page_no) = page_no + 1 AS has_next FROM chain)""",
    ("books", "islands"),
)
def q13b(spark, d):
    _, stats, _ = traverse.chains(*_book_pages(spark, d))
    return stats.withColumn("traversal_share", F.round("traversal_share", 6))


def _book_pages(spark, d):
    pages = A.books(spark, d)
    edges = graph.structural_edges(pages)
    nodes = shape.admit(pages).select(graph.page_node("documents").alias("id"), F.lit("page").alias("type"))
    return nodes, edges
