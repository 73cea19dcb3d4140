"""Faults found by the fourth review."""

import dataclasses
import random

from leafgraph.operators import graph, search, stored


def test_similar_sets_are_compared_in_cells(spark, monkeypatch):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(30)]
    texts = [base[: 24 + k % 7] + [f"x{k % 9}"] for k in range(40)] + [rnd.sample(base, 6) for _ in range(20)]
    firsts = {}
    for i, t in enumerate(texts):
        firsts.setdefault(" ".join(sorted(set(t))), f"n{i:02d}")
    # Two sets have one name: each is compared for its own, and with the other.
    rows = [(k // 2 if k < 10 else k, i, w) for k, (w, i) in enumerate(sorted(firsts.items()))]
    frame = spark.createDataFrame(rows, "k INT, id STRING, w STRING")
    names = sorted({k for k, *_ in rows})
    pairs = graph.cut(spark.createDataFrame([(a, b) for a in names for b in names if a < b or a == b < 5], "a INT, b INT"))
    expected = {}
    for i, x in enumerate(rows):
        for y in rows[:i]:
            a, b = set(x[2].split()), set(y[2].split())
            if len(a & b) >= 0.7 * len(a | b):
                expected[tuple(sorted((x[1], y[1])))] = round(len(a & b) / len(a | b), 9)
    for cell in (4, 2048):
        monkeypatch.setattr(graph, "CELL", cell)
        out = graph._compared(frame, pairs, 0.7).collect()
        assert len(out) == len(expected) > 100
        assert {tuple(sorted((r.a, r.b))): round(r.similarity, 9) for r in out} == expected


def test_names_of_several_sets_meet_once(spark):
    words = [f"w{i:02d}" for i in range(40)]
    rows = [(i % 2, f"n{i}", " ".join(words[: 36 + i])) for i in range(4)] + [(-7, "n4", " ".join(words[1:]))]
    pairs = graph._pairs_to_compare(spark.createDataFrame(rows, "k INT, id STRING, w STRING"), 0.7)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(-7, 0), (-7, 1), (0, 0), (0, 1), (1, 1)]


def test_similar_sets_are_sent_once_a_cell(spark):
    words = [f"w{i}" for i in range(60)]
    nodes = spark.createDataFrame([(None if i == 0 else f"n{i:02d}", " ".join(words + [f"x{i // 2}"])) for i in range(60)], "id STRING, content STRING")
    out = graph.similar_edges(nodes)
    # 30 sets, all alike: the join with their words has a row for a set, not for a pair.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "wa#" not in plan
    found = {(r.source, r.target, round(r.similarity, 6)) for r in out.collect()}
    firsts = ["n01"] + [f"n{i:02d}" for i in range(2, 60, 2)]
    assert found == {(a, b, round(60 / 62, 6)) for a in firsts for b in firsts if a < b} | {(a, f"n{int(a[1:]) + 1:02d}", 1.0) for a in firsts[1:]}


def test_search_reads_texts_once_and_makes_postings_of_its_terms_only(spark):
    rows = [("n1", "d", "the tion in the box", "in", "/the"), ("n2", "d", "box of thé tional", None, None), ("n3", "e", "in box the", "of the", "/in"),
            ("n3", "e", "the in the", None, "/x"), ("n4", None, None, None, None), (None, "d", "in the box", None, None), ("n5", "d", "", "tion in the", None)]
    nodes = spark.createDataFrame(rows, "id STRING, domain STRING, content STRING, content_summary STRING, path STRING")
    tags = spark.createDataFrame([("n1", "pdf:the"), ("n5", "the"), ("n5", "box"), ("n5", "the"), ("lost", "in")], "node_id STRING, tag STRING")
    index = search.build_index(nodes, tags, "none")
    whole = dataclasses.replace(index, texts=None, tag_texts=None)  # as an index in files is searched
    for asked in (
        dict(any_terms=["the", "box"]), dict(all_terms=["in"], any_terms=["box"], domain="d"), dict(all_terms=["the"], none_terms=["of"]),
        dict(all_terms=["the"], prefix="tion", fields=["content"]), dict(prefix="t", any_terms=["the"], domain="d"),
        dict(any_terms=["the"], none_terms=["in"], fields=["content", "tags"]), dict(any_terms=["lost"]),
        dict(phrase="in the"), dict(phrase="in the", fields=["content"]), dict(phrase="the box", domain="d")):
        out = search.search(index, limit=None, **asked)
        text = dict(nodes=nodes) if "phrase" in asked else {}
        expected = search.search(whole, limit=None, **asked, **text)
        assert sorted((r.node_id, r.domain, round(r.score, 9)) for r in out.collect()) == sorted((r.node_id, r.domain, round(r.score, 9)) for r in expected.collect())
        assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = search.search(index, phrase="the box", limit=None)
    assert {r.node_id for r in found.collect()} == {"n1"}
    # Only in the tags: "box the".
    assert {r.node_id for r in search.search(index, phrase="box the", limit=None).collect()} == {"n5"}
    assert search.search(index, phrase="box the", limit=None, phrase_fields=["content", "path"]).collect() == []


def test_stored_postings_are_made_by_arrays_and_counted_by_blocks(spark, tmp_path):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 12))) or None for _ in range(50)]
    nodes = [(f"n{i}", "d", t, texts[-i - 1], None, None, i % 9 == 0, 1) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(nodes, "id STRING, domain STRING, content STRING, content_summary STRING, path STRING, tags ARRAY<STRING>, deleted BOOLEAN, seq LONG")
    tokens = stored._tokens(frame.selectExpr("id AS node_id", "domain", "seq", "content", "content_summary", "path", "array_join(tags, ' ') AS tags"), "none")
    out = stored._postings(tokens, 5.0)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    expected = {}
    for i, _, content, summary, *_ in nodes:
        for k, t in enumerate((content, summary)):
            for at, w in enumerate((t or "").split()):
                expected.setdefault((i, w), ([], []))[k].append(at)
    assert {(r.node_id, r.term): (r.at_content, r.at_content_summary) for r in out.collect()} == expected
    # Few tokens at a time give the same rows.
    fields = list(stored.FIELDS)
    short = tokens.select("node_id", "domain", "length", *fields).mapInArrow(
        stored._runs(fields, 5), f"term STRING, node_id STRING, domain STRING, length INT, tf INT, {stored._POSITIONS}")
    assert {(r.node_id, r.term): (r.at_content, r.at_content_summary) for r in short.collect()} == expected
    # Nodes come, are replaced and deleted: the dictionary keeps their number.
    path, held = f"{tmp_path}/index", {}
    for batch in range(3):
        some = [(i, d, texts[(k + batch) % 50], *r[:-2], (k + batch) % 5 == 0, batch) for k, (i, d, _, *r) in enumerate(nodes) if k % (batch + 1) == 0]
        stored.write_segment(spark.createDataFrame(some, frame.schema), path, batch, "none")
        held |= {r[0]: set() if r[6] else set(((r[2] or "") + " " + (r[3] or "")).split()) for r in some}
    counts = {r.term: r.df for r in stored.open_index(spark, path, "none").df(list("abcdefg")).collect()}
    assert counts == {w: n for w in "abcdefg" if (n := sum(w in x for x in held.values()))}


def test_few_changes_are_dealt_to_all_cores(spark):
    text = spark.range(3).selectExpr("repeat('word ', 1000000) AS content", "'' AS content_summary", "'' AS path")
    assert stored._shards(text) == min(8, 15) and stored._shards(text.limit(0)) == 1
