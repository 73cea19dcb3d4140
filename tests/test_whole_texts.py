"""Nothing after the first characters, words or rows of an input is left out."""

import __spark_entry__ as entry
from leafgraph.operators import enrich, search
from leafgraph.sources import adapters as A

FOLDER = "/root/testdata/sf0.001"


def test_augmented_prompts_use_whole_texts(spark):
    start = "long words " * 30
    nodes = spark.createDataFrame(
        [("n1", "d", start + "apple", "", "/a"), ("n2", "d", start + "pear", "", "/b")],
        "id STRING, domain STRING, content STRING, content_summary STRING, path STRING")
    tags = spark.createDataFrame([("n1", "t"), ("n2", "t")], "node_id STRING, tag STRING")
    index = search.build_index(nodes, tags, "none")
    items = spark.createDataFrame([(1, start + "apple"), (2, start + "pear")], "query_id LONG, text STRING")
    got = {r.query_id: r.prompt for r in enrich.augment_prompts(items, "long", index, nodes, tags).collect()}
    assert start + "apple" in got[1] and "pear" not in got[1]
    assert start + "pear" in got[2] and "apple" not in got[2]
    cut = {r.query_id: r.prompt for r in enrich.augment_prompts(items, "long", index, nodes, tags, excerpt=15).collect()}
    assert cut[1] == cut[2] and start[:15] + "...\n" in cut[1] and "apple" not in cut[1]


def test_whole_queries_leave_no_row_out(spark):
    run = entry.queries()
    parts = A.table(spark, FOLDER, "part").selectExpr("upper(p_name) || ' ' || p_type AS name")
    assert parts.join(run["G8_resolve_concepts_whole"](spark, FOLDER), "name", "left_anti").count() == 0
    pages = A.convs(spark, FOLDER).count()
    assert run["Q9_subgraph_nodes_whole"](spark, FOLDER).select("start").distinct().count() == pages
    # Every node found for a whole text holds each of its words.
    texts = {r.item_id: r.text for r in A.table(spark, FOLDER, "benchmark").collect()}
    nodes = {f"n{r.doc_id}": r.text for r in A.table(spark, FOLDER, "documents").collect()}
    for r in run["Q2_search_batch_whole"](spark, FOLDER).collect():
        assert {w.lower() for w in texts[r.query_id].split() if w.isalpha() and w.isascii()} <= set(
            "".join(c if c.isalnum() else " " for c in nodes[r.node_id].lower()).split())
