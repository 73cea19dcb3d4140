"""Faults found by the third review."""

import random

import duckdb

import __spark_entry__ as entry
from leafgraph.llm import repeats, stages
from leafgraph.operators import graph, lexical, search, stored
from tests.compare import difference


def test_nodes_of_equal_shown_score_come_in_order_of_id(spark, tmp_path):
    # Every node has both items, so the scores differ by less than six digits show.
    rows = [(i, "the tional " * (1 + 7 * i % 13) + "word " * i, "en", "s", 10) for i in range(1, 40)]
    documents = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    documents.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = "Q2_search_structured"
    assert difference(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name]) is None


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_postings_are_counted_within_the_row(spark):
    nodes = spark.createDataFrame(
        [("n1", "d", "b a b", "", "/a"), ("n2", "d", None, None, None)],
        "id STRING, domain STRING, content STRING, content_summary STRING, path STRING")
    index = search.build_index(nodes, stemmer="none")
    assert _exchanges(index.postings) == 0 and _exchanges(index.term_df) == 1
    assert {(r.node_id, r.term, r.field, r.tf) for r in index.postings.collect()} == {
        ("n1", "a", "content", 1), ("n1", "b", "content", 2), ("n1", "a", "path", 1)}
    assert {(r.term, r.df) for r in index.term_df.collect()} == {("a", 1), ("b", 1)}


def test_stems_are_counted_within_the_row(spark):
    pages = spark.createDataFrame([("d", 0, "cats cat dogs cat"), ("d", 1, ""), ("d", 2, None)], "doc_id STRING, page_no INT, text STRING")
    out, terms = lexical.stems(pages, "light"), lexical.significance(pages)
    assert _exchanges(out) == 0 and _exchanges(terms) == 0
    assert {(r.page_no, r.stem, tuple(r.words), r.freq) for r in out.collect()} == {
        (0, "cat", ("cat", "cats"), 3), (0, "dog", ("dogs",), 1)}
    assert {(r.term, r.freq) for r in terms.collect()} == {("cat", 2), ("cats", 1), ("dogs", 1)}


def test_runs_of_concepts_are_not_broadcast(spark):
    concepts = spark.createDataFrame([("c1", "Red  old box", 1), ("c2", "old box", 2)], "concept_id STRING, text STRING, ord LONG")
    names = spark.createDataFrame([("OLD box",), ("box red",)], "name STRING")
    out = graph.resolve_concepts(names, concepts, "contains", grams=2)
    joins = [x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x and "_gram" in x]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
    assert {(r.name, r.concept_id) for r in out.collect()} == {("OLD box", "c1"), ("box red", None)}


def test_similar_sets_are_found_without_sending_candidates(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [rnd.sample(words, rnd.choice([1, 2, 3, 5, 9, 20, 33])) for _ in range(60)]
    texts += [t[: -1 - k % 4] + rnd.sample(words, k % 3) for k, t in enumerate(texts)] + [["W0"], ["w0", "w0"], []]
    frame = spark.createDataFrame([(f"n{i}", " ".join(t)) for i, t in enumerate(texts)], "id STRING, content STRING")
    sets: dict[tuple, list] = {}
    for i, t in enumerate(texts):
        if t:
            sets.setdefault(tuple(sorted({x.lower() for x in t})), []).append(f"n{i}")
    firsts = {min(ids): set(w) for w, ids in sets.items()}
    expected = {(min(ids), i, 1.0) for ids in sets.values() for i in ids if i != min(ids)}
    for threshold in (0.3, 0.5, 0.7, 0.9, 1.0):
        pairs = {(a, b, round(len(x & y) / len(x | y), 9)) for a, x in firsts.items() for b, y in firsts.items()
                 if a < b and len(x & y) >= threshold * len(x | y) - 1e-12}
        out = graph.similar_edges(frame, threshold)
        assert {(r.source, r.target, round(r.similarity, 9)) for r in out.collect()} == expected | pairs
    # Words are put in order within the rows of a set: the only exchange of them is that of the prefix.
    plan = graph.similar_edges(frame)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "_salt" not in plan


def test_stored_postings_are_made_within_the_row(spark, tmp_path):
    nodes = spark.createDataFrame(
        [("n1", "d", "b a b", None, "/a"), ("n2", "d", None, None, None)],
        "id STRING, domain STRING, content STRING, content_summary STRING, path STRING")
    tags = spark.createDataFrame([("n1", "b"), ("lost", "a")], "node_id STRING, tag STRING")
    tokens = stored._tokens(nodes.selectExpr("id AS node_id", "domain", "0L AS seq", "content", "content_summary", "path", "'b' AS tags"), "none")
    assert _exchanges(stored._postings(tokens, 3.0)) == 0
    index = stored.build_stored(nodes, tags, str(tmp_path), "none")
    assert (index.nodes, index.length) == (2, 5)
    assert {(r.node_id, r.term, r.tf, r.length, tuple(r.at_content), tuple(r.at_path), tuple(r.at_tags)) for r in index.table("postings").collect()} == {
        ("n1", "a", 2, 5, (1,), (0,), ()), ("n1", "b", 3, 5, (0, 2), (), (0,))}
    assert {(r.term, r.df) for r in index.df(["a", "b"]).collect()} == {("a", 1), ("b", 1)}


def test_texts_are_cut_and_decoded_in_one_step(spark):
    passage = " ".join(map(str, range(100)))
    docs = spark.createDataFrame([(1, "é" + passage, 1), (2, passage + "b", 2), (3, None, 3)], "doc_id long, text string, n_chars long")
    out = repeats.without_repeats(docs)
    # Texts are packed before the shuffle and unpacked after it; each step more holds a Python worker a core.
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow ") == 2
    assert {tuple(r) for r in out.collect()} == {(1, "é", 1), (2, "b", 1), (3, "", 0)}


def test_rebuild_ranks_pages_once_and_writes_nodes_as_they_lie(spark, tmp_path, monkeypatch):
    from leafgraph.sources import adapters, store

    ranked, calls = adapters.ranked, []
    monkeypatch.setattr(adapters, "ranked", lambda *a: calls.append(a) or ranked(*a))
    out = entry.queries()["S9_rebuild"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and out.count() == out.distinct().count() > 0
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x")], "id STRING, domain STRING").repartition(4)
    none = spark.createDataFrame([], "id STRING, domain STRING")
    store.save_graph({"nodes": nodes, "edges": none, "tags": none.selectExpr("id AS node_id", "id AS tag")}, str(tmp_path), ["x"])
    assert len(list(tmp_path.glob("nodes/domain=x/*.parquet"))) == nodes.rdd.glom().filter(len).count()
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/nodes").collect()} == set("abcd")


def test_stages_send_texts_in_short_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    sizes = lambda batches: (type(b).from_pydict({"n": [b.nbytes]}) for b in batches)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 3000) AS text", "'en' AS lang", "'s' AS source", "3000L AS n_chars")
    old = spark.conf.get(key)
    try:
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) > 2 * stages.BATCH_BYTES
        for kept, most in ((old, stages.BATCH_BYTES), ("1m", 1 << 20)):
            spark.conf.set(key, kept)
            out = stages.pack(spark, docs.limit(1), "")
            seen = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
            assert max(seen) < most + 100_000 and len(out.collect()) > 0
    finally:
        spark.conf.set(key, old)
