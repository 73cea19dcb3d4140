"""Hand-made inputs with exact expected rows."""

import json
import random

import numpy as np
import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafgraph.functions import text as X
from leafgraph.functions.rank import sentence_scores
from leafgraph.functions import stem
from leafgraph.functions.stem import porter
from leafgraph.operators import enrich, graph, lexical, ordered, search, shape, structure, traverse
from leafgraph.plans import ingest
from leafgraph.schemas import TAG_STRUCT
from leafgraph.sources import files, store
from leafgraph.operators import stored
from leafgraph.streaming import index as stream

PAGES = "doc_id STRING, page_no INT, text STRING"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- ordered scans ------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """One key has most of the rows."""
    rnd = random.Random(7)
    data = [("hot", i, rnd.randint(0, 3)) for i in range(400)] + [(f"k{i}", j, j) for i in range(20) for j in range(5)]
    return spark.createDataFrame(data, "k STRING, pos INT, v INT"), data


def test_blocked_scans_equal_plain_loops(skewed):
    df, data = skewed
    total, last, first = {}, {}, {}
    keys = sorted({k for k, _, _ in data})
    for k in keys:
        run, seen = 0, None
        mine = [(p, v) for kk, p, v in data if kk == k]
        for p, v in mine:
            run += v
            total[k, p] = run
            last[k, p] = seen
            seen = v if v > 1 else seen
        seen = None
        for p, v in reversed(mine):
            first[k, p] = seen
            seen = v if v > 1 else seen
    big = F.when(F.col("v") > 1, F.col("v"))
    for size in (1, 7, 64, 10_000):
        out = ordered.running_sum(df, ["k"], ["pos"], size, F.col("v"), "s")
        assert {(r.k, r.pos): r.s for r in out.collect()} == total
        out = ordered.last_before(df, ["k"], ["pos"], size, {"x": big})
        assert {(r.k, r.pos): r.x for r in out.collect()} == last
        out = ordered.next_after(df, ["k"], ["pos"], size, {"x": big})
        assert {(r.k, r.pos): r.x for r in out.collect()} == first
    out = ordered.ranked(df, ["k"], ["pos"], 16, "r")
    assert all(r.r == r.pos for r in out.collect())


def test_scans_do_not_put_a_key_into_one_window(skewed):
    df, _ = skewed
    plan = ordered.ranked(df, ["k"], ["pos"], 16, "r")._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" in [x for x in plan.splitlines() if "Window" in x][0]


def test_scans_carry_over_groups_of_blocks(skewed, monkeypatch):
    df, _ = skewed
    plain = {(r.k, r.pos): r.r for r in ordered.ranked(df, ["k"], ["pos"], 100_000, "r").collect()}
    monkeypatch.setattr(ordered, "GROUP", 3)
    for size in (1, 7):
        got = ordered.ranked(df, ["k"], ["pos"], size, "r")
        assert {(r.k, r.pos): r.r for r in got.collect()} == plain
        first = ordered.next_after(df, ["k"], ["pos"], size, {"x": F.col("pos")})
        assert all(r.x in (r.pos + 1, None) for r in first.collect())
        last = ordered.last_before(df, ["k"], ["pos"], size, {"x": F.col("pos")})
        assert all(r.x == (r.pos - 1 if r.pos else None) for r in last.collect())
    plan = ordered.ranked(df, ["k"], ["pos"], 7, "r")._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window" in x]
    assert any("_group" in x.split("], [")[1] for x in windows), windows


def test_fold_over_blocks_of_blocks(spark):
    rows = [(k, p, p % 7) for k, n in (("big", 300), ("small", 3)) for p in range(n)]
    df = spark.createDataFrame([*rows, ("far", 0, 1), ("far", 1 << 33, 2), ("far", 1 << 50, 3)], "k STRING, p BIGINT, v INT")
    # The last three different values, oldest first: associative, and order matters.
    def merge(a, b):
        kept = F.filter(a, lambda e: ~F.array_contains(b, e))
        both = F.concat(kept, b)
        return F.slice(both, F.greatest(F.size(both) - 2, F.lit(1)), 3)

    for sizes in ((1, 2, 8), (4, 16), (1000,), (1 << 10, 1 << 22, 1 << 42)):
        got = ordered.fold_before(df, ["k"], "p", F.array("v"), merge, "array<int>", "f", sizes)
        seen = {(r.k, r.p): r.f for r in got.collect()}
        assert len(seen) == 306
        for (k, p), f in seen.items():
            if k != "far":
                assert f == [x % 7 for x in range(max(0, p - 3), p)]
        assert seen["far", 1 << 33] == [1] and seen["far", 1 << 50] == [1, 2]


# --- structure ------------------------------------------------------------------------


def test_toc_hierarchy_equals_a_stack(spark):
    rnd = random.Random(3)
    data, expected = [], {}
    for d in range(40):
        stack = []
        for seq in range(rnd.randint(1, 30)):
            level = rnd.randint(1, 5)
            while stack and stack[-1][0] >= level:
                stack.pop()
            expected[f"d{d}", seq] = (
                stack[-1][1] if stack else None, "/".join(f"t{s}" for _, s in stack + [(level, seq)])
            )
            stack.append((level, seq))
            data.append((f"d{d}", seq, level, f"t{seq}"))
    toc = spark.createDataFrame(data, "doc_id STRING, seq BIGINT, level INT, title STRING")
    for block in (3, 1000):
        out = structure.toc_tree(toc, block=block)
        assert {(r.doc_id, r.seq): (r.parent_seq, r.path) for r in out.collect()} == expected


def test_contents_of_200_levels(spark):
    # Down 200 levels, back up by ten at a time; sequence numbers as of lines on pages.
    levels = [*range(1, 201), *range(190, 0, -10), None, 3]
    data = [("d", (i // 5) * structure.SEQ_PAGE + i % 5, level, f"t{i}") for i, level in enumerate(levels)]
    toc = spark.createDataFrame(data, "doc_id STRING, seq BIGINT, level INT, title STRING")
    expected, stack = {}, []
    for _, seq, level, _ in data:
        if level is None:
            expected[seq] = (None, 0)
            continue
        while stack and stack[-1][0] >= level:
            stack.pop()
        expected[seq] = (stack[-1][1] if stack else None, len(stack))
        stack.append((level, seq))
    for block in (2, 1024):
        out = structure.with_depth(toc, block)
        assert len(out.columns) == 6
        assert {r.seq: (r.parent_seq, r.depth) for r in out.collect()} == expected


def test_small_table_of_contents(spark):
    text = "Table of Contents\n1. Introduction ........... 1\n1.1 Background ..... 2\n2. Methodology ..... 6"
    pages = spark.createDataFrame([("a", 0, text), ("a", 1, "x"), ("b", 0, "no contents here")], PAGES)
    out = structure.toc_parents(structure.detect_toc(pages, offset=-1)).orderBy("seq").collect()
    assert [(r.number, r.title, r.page, r.level, r.format) for r in out] == [
        ("1.", "Introduction", 0, 1, "dot_leader"),
        ("1.1", "Background", 1, 2, "dot_leader"),
        ("2.", "Methodology", 5, 1, "dot_leader"),
    ]
    assert [r.parent_seq for r in out] == [None, out[0].seq, None]


def test_continuation_skips_missing_pages_and_stops_at_prose(spark):
    more = "a 1\nb 2\nc 3"
    toc = "Contents\na .... 1\nb .... 2\nc .... 3\nCont."
    pages = spark.createDataFrame(
        [("x", 0, toc), *[("x", i, more) for i in range(2, 9)], ("x", 9, "prose"), ("x", 10, more), ("y", 5, toc), ("y", 6, "prose"), ("y", 7, more)],
        PAGES,
    )
    assert rows(structure.toc_pages(pages), "doc_id", "page_no") == [("x", 0), *[("x", i) for i in range(2, 9)], ("y", 5)]


def test_format_tie_and_generic_entry(spark):
    lines = spark.createDataFrame(
        [("tie", 0, "1 A .... 2"), ("none", 0, "plain words 12"), ("none", 1, "no number")],
        "doc_id STRING, seq INT, line STRING",
    )
    formats = structure.toc_format(lines)
    assert rows(formats, "doc_id", "format") == [("none", "unknown"), ("tie", "dot_leader")]
    assert rows(structure.parse_toc(lines, formats), "doc_id", "title", "page") == [
        ("none", "plain words", 12), ("tie", "A", 2),
    ]


def test_toc_sections_ranges(spark):
    pages = spark.createDataFrame([("d", i, f"page {i}" if i != 2 else "  ") for i in range(6)], PAGES)
    toc = spark.createDataFrame(
        [("d", 0, "1", "One", 0, 1), ("d", 1, "", "Two", 2, 1), ("d", 2, "3", "Back", 1, 1), ("d", 3, "4", "Past", 99, 1)],
        "doc_id STRING, seq BIGINT, number STRING, title STRING, page INT, level INT",
    ).withColumn("path", F.col("title"))
    for per_part in (1000, 2):
        out = structure.toc_sections(toc, pages, per_part=per_part).orderBy("seq", "part").collect()
        got = {}
        for r in out:
            got.setdefault(r.title, []).extend(r.pages)
        # "Two" would run from 2 to 0 and is empty; "Past" lies behind the document.
        assert got == {"One": [0, 1], "Back": [1, 3, 4, 5]}
    assert rows(structure.uncovered_pages(pages, toc, per_part=2), "page_no") == []


def test_headings(spark):
    text = "\n    # Chapter 1: Introduction\n\n  Some text.\n  ## 1.1 Background\n  More.\nA. First\nIV. Four\nLOUD WORDS\n1.2.3 Deep Title"
    lines = shape.lines(spark.createDataFrame([("d", 0, text)], PAGES))
    out = structure.headings(lines).orderBy("pos").collect()
    assert [(r.kind, r.title, r.level) for r in out] == [
        ("markdown", "Chapter 1: Introduction", 1), ("markdown", "1.1 Background", 2), ("lettered", "First", 2),
        ("roman", "Four", 1), ("uppercase", "LOUD WORDS", 1), ("numbered", "Deep Title", 3),
    ]
    assert out[0].confidence == pytest.approx(0.95)  # keyword
    assert out[1].confidence == pytest.approx(0.85)


def test_pattern_sections_span_pages(spark):
    pages = spark.createDataFrame([("d", 0, "lost\n# A\none"), ("d", 1, "two\n## B\nthree")], PAGES)
    out = structure.pattern_sections(shape.lines(pages), block=1).orderBy("seq").collect()
    assert [(r.title, r.level, r.pages, r.content) for r in out] == [
        ("A", 1, [0, 1], "A\none\ntwo\n"), ("B", 2, [1], "B\nthree\n"),
    ]
    parts = structure.pattern_sections(shape.lines(pages), per_part=1).orderBy("seq", "part").collect()
    assert [(r.title, r.part, r.content) for r in parts] == [
        ("A", 0, "A\none\n"), ("A", 1, "two\n"), ("B", 1, "B\nthree\n"),
    ]


# --- shape ------------------------------------------------------------------------------


def test_admission_bound(spark):
    pages = spark.createDataFrame([("d", 0, "x" * 49 + "  "), ("d", 1, "x" * 50), ("d", 2, "")], PAGES)
    assert rows(shape.admit(pages), "page_no") == [(1,)]


def test_page_spec_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([("d", i, "t") for i in range(12)], PAGES).write.parquet(path)
    out = shape.select_pages(spark.read.parquet(path), "0,2-5,10")
    assert [r[0] for r in rows(out, "page_no")] == [0, 2, 3, 4, 5, 10]
    assert "PushedFilters: [Or" in out._jdf.queryExecution().executedPlan().toString()


def test_pipeline_names_the_step(spark):
    df = spark.range(3)
    chain = shape.Pipeline().add(lambda d: d.filter("id > 0"), "keep").add(lambda d: d.select("nope"), "break")
    with pytest.raises(RuntimeError, match="step 'break'"):
        chain.run(df)


def test_html(spark):
    html = "<head><title>T</title></head><h1>A &amp; B</h1><script>x<1</script><p>One <b>two</b><br>three</p><ul><li>i</li></ul>"
    out = spark.range(1).select(X.html_to_markdown(F.lit(html)).alias("t")).first().t
    assert out == "# A & B\n\nOne **two**\nthree\n\n* i"


# --- lexical -----------------------------------------------------------------------------


def test_porter_as_columns_and_as_sql(spark):
    rnd = random.Random(5)
    ends = ["", *stem.STEP_4, *(e for e, _ in stem.STEP_2), "s", "sses", "ies", "eed", "ed", "ing", "y", "e", "ll", "ness"]
    words = {
        "".join(rnd.choices("aeiouybcdlstzwx1é", k=rnd.randint(0, 7))) + rnd.choice(ends) + rnd.choice(["", "", "s", "ly", "ed"])
        for _ in range(20_000)
    }
    words |= {"y" * n + e for n in range(9) for e in ("ed", "ing", "e", "")} | {"a" + "y" * n + "ed" for n in range(9)}
    words |= {"b" * 50_000 + "ational", "ba" * 50_000 + "tted", "by" * 50_000 + "ing", "a" + "y" * 100_001 + "ed"}
    expected = {w: stem.porter(w) for w in words}
    df = spark.createDataFrame([(w,) for w in words], "word STRING").repartition(8)
    got = df.select("word", stem.stem_word(F.col("word"), "porter").alias("stem"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.word: r.stem for r in got.collect()} == expected
    odd = spark.createDataFrame([(None,), ([],), (["flies", None],)], "w ARRAY<STRING>")
    assert [r[0] for r in odd.select(stem.stem_array(F.col("w"), "porter")).collect()] == [None, [], ["fli", None]]
    con = duckdb.connect()
    con.register("given", pd.DataFrame({"word": sorted(words)}))
    assert dict(con.execute(f"WITH {stem.porter_sql('s', 'given')} SELECT word, stem FROM s").fetchall()) == expected


def test_porter():
    # Examples of the paper, step by step, and words that pass through several.
    for word, stem in {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "agreed": "agre", "plastered": "plaster",
        "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
        "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file",
        "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
        "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "formaliti": "formal",
        "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electrical": "electr",
        "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
        "airliner": "airlin", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt",
        "homologou": "homolog", "communism": "commun", "activate": "activ", "effective": "effect", "probate": "probat",
        "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener",
        "oscillators": "oscil", "learning": "learn",
    }.items():
        assert porter(word) == stem, word


def test_relations_of_the_sample(spark):
    text = (
        "Machine learning is a subset of artificial intelligence. Deep learning is a type of machine learning "
        "that uses neural networks."
    )
    pages = spark.createDataFrame([("d", 0, text)], PAGES)
    assert "learn" in [r[0] for r in rows(lexical.stems(pages), "stem")]
    found = lexical.pattern_relations(lexical.sentences(pages))
    assert ("machine learning", "subset artificial intelligence", "type_of") in rows(found, "source", "target", "type")
    names = dict(rows(lexical.relation_names(pages), "key", "name"))
    merged = lexical.with_evidence(lexical.page_relations(pages), pages).collect()
    assert all(r.source_key in names and r.target_key in names and r.evidence for r in merged)


def test_entities_of_many_capitals(spark):
    text = "The Big Red Dog met X_1 and Y-2 " + " ".join(f"C{i}" for i in range(100)) + "."
    sents = lexical.sentences(spark.createDataFrame([("d", 0, text)], PAGES))
    out = set(lexical.entities(sents).first().entities)
    assert {"Big Red Dog", "Red Dog", "Dog", "x_1", "y-2"} <= out and "The Big Red Dog" not in out
    n = len(out)
    assert lexical.cooccurrence(lexical.entity_keys(sents)).count() == n * (n - 1) // 2


def test_key_term_contexts_hold_their_term(spark):
    pages = spark.createDataFrame([("d", 0, "Cats purr. Cats sleep! A cat naps"), ("e", 0, "")], PAGES)
    out = lexical.key_terms(pages, threshold=0.0).collect()
    assert {r.term for r in out} == {"cats", "cat", "purr", "sleep", "naps"}
    assert all(r.contexts and all(r.term in s.lower() for s in r.contexts) for r in out)
    assert {r.term: sorted(r.related) for r in out}["cats"] == ["cat"]


def brute_scores(sentences, rounds=20, d=0.85):
    ws = [s.split() for s in sentences]
    n = len(ws)
    w = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            if i != j and ws[i] and ws[j]:
                norm = np.log(len(ws[i])) + np.log(len(ws[j]))
                w[i, j] = len(set(ws[i]) & set(ws[j])) / norm if norm > 0 else 0
    out = w.sum(1)
    s = np.ones(n)
    for _ in range(rounds):
        s = (1 - d) + d * np.array(
            [sum(w[i, j] / out[i] * s[i] for i in range(n) if out[i] > 0) for j in range(n)]
        )
    return s


def test_sentence_scores_equal_all_pairs():
    rnd = random.Random(1)
    for _ in range(20):
        s = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 6))) for _ in range(12)]
        assert sentence_scores(s) == pytest.approx(brute_scores(s))
    assert len(sentence_scores([])) == 0


def test_summaries_keep_the_budget(spark):
    rnd = random.Random(5)
    vocab = [f"word{i}" for i in range(60)]
    long = "\n".join(" ".join(rnd.choice(vocab) for _ in range(12)) + "." for _ in range(40))
    pages = spark.createDataFrame([("d", 0, long), ("d", 1, "short text"), ("d", 2, "")], PAGES)
    out = {r.page_no: r for r in lexical.summarize(pages).collect()}
    assert out[0].shortened and 20 <= len(out[0].summary.split()) <= 75
    assert (out[1].summary, out[1].shortened) == ("short text", False)
    assert out[2].summary == ""
    full = {r.page_no: r for r in lexical.summarize(pages, ratio=1.0).collect()}
    assert full[0].summary == long and not full[0].shortened


# --- graph -------------------------------------------------------------------------------


def test_edge_scores_of_the_sample(spark):
    nodes = spark.createDataFrame(
        [("a", "Machine learning algorithms"), ("b", "Deep learning networks"), ("c", "Document root")],
        "id STRING, content STRING",
    )
    ends = spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "gone")], "source STRING, target STRING")
    edges = graph.make_edges(ends, F.col("source"), F.col("target"), "relates_to", 1.0)
    scored = {(r.source, r.target): r.strength for r in graph.score_edges(edges, nodes, 0.9).collect()}
    assert scored == {("a", "b"): pytest.approx(0.38), ("c", "a"): 0.0, ("a", "gone"): 0.0}
    update = spark.createDataFrame([("a-b-relates_to", 0.95, 0.8)], "id STRING, confidence DOUBLE, boost DOUBLE")
    at = F.timestamp_seconds(F.lit(0))
    new = {r.id: r for r in graph.update_scores(edges, nodes, update, at).collect()}
    assert len(new) == 3
    assert (new["a-b-relates_to"].strength, new["a-b-relates_to"].confidence) == (pytest.approx(0.36), 0.95)


def test_upsert_takes_the_later_row(spark):
    def edges(strength, at):
        ends = spark.createDataFrame([("a", "b")], "source STRING, target STRING").withColumn("ts", F.timestamp_seconds(F.lit(at)))
        return graph.make_edges(ends, F.col("source"), F.col("target"), "t", strength)

    assert graph.upsert_edges(edges(0.1, 5), edges(0.2, 9)).first().strength == 0.2
    assert graph.upsert_edges(edges(0.1, 9), edges(0.2, 5)).first().strength == 0.1
    assert graph.upsert_edges(edges(0.1, 5), edges(0.2, 5)).first().strength == 0.2


def test_inference_is_idempotent(spark):
    node = spark.range(1).select(
        F.array(
            graph.ontology_tag(F.lit("algorithm"), F.lit(1.0), F.lit("technical")),
            graph.ontology_tag(F.lit("research"), F.lit(1.0), F.lit("academic")),
        ).cast(f"array<{TAG_STRUCT}>").alias("ontology")
    )
    once = graph.infer_ontology(node)
    tags = [(t.category, round(t.confidence, 6), t.domain) for t in graph.infer_ontology(once).first().ontology]
    assert tags == [("algorithm", 1.0, "technical"), ("research", 1.0, "academic"), ("computational", 0.9, "technical")]


def test_tags_are_prefixed_once(spark):
    docs = spark.createDataFrame([("d", "pdf:d.pdf", "T", None, None, 1)],
                                 "doc_id STRING, filename STRING, title STRING, author STRING, subject STRING, pages INT")
    pages = spark.createDataFrame([("d", 0, "x" * 60)], PAGES)
    assert {r.tag for r in graph.build_tags(docs, pages).collect()} == {
        "pdf:document", "pdf:root", "pdf:d.pdf", "pdf:page", "pdf:page:0",
    }


def test_contains_finds_names_longer_than_the_lookup(spark):
    concepts = spark.createDataFrame(
        [("c1", "the quick brown fox jumps over the lazy dog", 2), ("c2", "the quick brown fox jumps high", 1)],
        "concept_id STRING, text STRING, ord INT",
    )
    mentions = spark.createDataFrame(
        [("Quick  Brown fox jumps OVER the",), ("quick brown",), ("ick brown",), ("fox jumps high now",)], "name STRING"
    )
    got = dict(rows(graph.resolve_concepts(mentions, concepts, "contains", grams=2).na.fill("-"), "name", "concept_id"))
    assert got == {
        "Quick  Brown fox jumps OVER the": "c1", "quick brown": "c2", "ick brown": "-", "fox jumps high now": "-",
    }


def test_similar_edges_equal_all_pairs(spark):
    rnd = random.Random(11)
    texts = [" ".join(rnd.sample("abcdefghijkl", rnd.randint(2, 8))) for _ in range(80)]
    texts += ["same words here"] * 30
    nodes = spark.createDataFrame([(f"n{i:03d}", t) for i, t in enumerate(texts)], "id STRING, content STRING")
    out = {(r.source, r.target): r.similarity for r in graph.similar_edges(nodes, 0.6).collect()}
    sets, first = [set(t.split()) for t in texts], {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    expected = {}
    for s, i in first.items():
        expected.update({(f"n{i:03d}", f"n{j:03d}"): 1.0 for j, x in enumerate(sets) if x == s and j != i})
        for r, j in first.items():
            if i < j and len(s & r) / len(s | r) >= 0.6:
                expected[f"n{i:03d}", f"n{j:03d}"] = len(s & r) / len(s | r)
    assert out == pytest.approx(expected)


# --- walks --------------------------------------------------------------------------------


def chain_graph(spark):
    pairs = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "y"), ("s", "t1"), ("s", "t2"), ("p", "c"), ("lost", "a")]
    edges = spark.createDataFrame([(s, t, "precedes", f"{s}-{t}") for s, t in pairs], "source STRING, target STRING, type STRING, id STRING")
    nodes = spark.createDataFrame([(n, "page") for n in ["a", "b", "c", "x", "y", "z", "s", "t1", "t2", "p", "alone"]], "id STRING, type STRING")
    return nodes, edges


def test_chains_with_cycles_and_branches(spark):
    nodes, edges = chain_graph(spark)
    members, stats, cyclic = traverse.chains(nodes, edges)
    got = {}
    for r in members.orderBy("position").collect():
        got.setdefault(r.head, []).append(r.node)
    assert got == {"a": ["a", "b", "c"], "p": ["p", "c"], "s": ["s", "t1"], "t2": ["t2"], "alone": ["alone"]}
    assert {r.node for r in cyclic.collect()} == {"x", "y", "z"}
    s = stats.first()
    assert (s["count"], s.traversable_count, s.longest_chain) == (11, 7, 3)


def test_long_chain(spark):
    n = 37
    nodes = spark.createDataFrame([(f"{i:03d}", "page") for i in range(n)], "id STRING, type STRING")
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}", "precedes") for i in range(n - 1)], "source STRING, target STRING, type STRING")
    members, stats, cyclic = traverse.chains(nodes, edges)
    assert rows(members, "head", "position", "node") == [("000", i, f"{i:03d}") for i in range(n)]
    assert stats.first().longest_chain == n and cyclic.isEmpty()


def test_walks_and_paths(spark):
    edges = spark.createDataFrame(
        [("1", "a", "b", "t", 1.0), ("2", "b", "c", "t", 1.0), ("3", "c", "d", "t", 1.0), ("4", "a", "d", "t", 1.0), ("5", "z", "a", "t", 1.0)],
        "id STRING, source STRING, target STRING, type STRING, strength DOUBLE",
    )
    nodes = spark.createDataFrame([(x, "x" * 300, "/") for x in "abcdz"], "id STRING, content STRING, path STRING")
    starts = spark.createDataFrame([("a",)], "start STRING")
    found, links = traverse.outgoing_graph(starts, nodes, edges, depth=1)
    assert rows(found, "node", "depth") == [("a", 0), ("b", 1), ("d", 1)]
    assert found.first().content == "x" * 200 + "..."
    assert rows(links, "id") == [("1",), ("2",), ("4",)]
    seen, touching = traverse.subgraph(starts, edges, depth=1)
    assert rows(seen, "node", "depth") == [("a", 0), ("b", 1), ("d", 1), ("z", 1)]
    assert rows(touching, "id") == [("1",), ("2",), ("3",), ("4",), ("5",)]
    pairs = spark.createDataFrame([("a", "c"), ("z", "c"), ("a", "a"), ("a", "nowhere")], "start STRING, goal STRING")
    paths = {(r.start, r.goal): (r.hops, r.path) for r in traverse.shortest_path(pairs, edges).collect()}
    assert paths == {("a", "c"): (2, ["a", "b", "c"]), ("z", "c"): (3, ["z", "a", "b", "c"]), ("a", "a"): (0, ["a"])}


# --- search, store, enrichment, stream ------------------------------------------------------


def test_search_stems_and_folds(spark):
    nodes = spark.createDataFrame(
        [("1", "d", "Les études learning machines", None, "/a"), ("2", "d", "he learned an etude", None, "/b"), ("3", "e", "nothing", "learns", "/c")],
        "id STRING, domain STRING, content STRING, content_summary STRING, path STRING",
    )
    index = search.build_index(nodes)
    assert rows(search.search(index, all_terms=["Learn"]), "node_id") == [("1",), ("2",), ("3",)]
    assert rows(search.search(index, all_terms=["learn"], domain="d", none_terms=["machine"]), "node_id") == [("2",)]
    assert rows(search.search(index, any_terms=["étude", "c"]), "node_id") == [("1",), ("2",), ("3",)]
    assert rows(search.search(index, phrase="an etude", nodes=nodes), "node_id") == [("2",)]
    assert search.search(index, all_terms=["learn", "absent"]).count() == 0


def test_stored_index_gives_the_same_and_is_pruned(spark, tmp_path):
    nodes = spark.createDataFrame(
        [(str(i), "d" if i % 2 else "e", f"word{i % 7} common text", None, "/") for i in range(50)],
        "id STRING, domain STRING, content STRING, content_summary STRING, path STRING",
    )
    index = search.build_index(nodes, stemmer="none")
    search.write_index(index, str(tmp_path / "i"))
    again = search.read_index(spark, str(tmp_path / "i"), "none")
    one = search.search(index, any_terms=["word3", "common"], domain="d", limit=5)
    two = search.search(again, any_terms=["word3", "common"], domain="d", limit=5)
    assert rows(one, "node_id", "score") == rows(two, "node_id", "score")
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(domain" in plan and "PushedFilters: [In(term" in plan


def test_stream_equals_batch(spark, tmp_path):
    def change(i, text, deleted, seq):
        return (str(i), "d", text, None, "/", ["t"], deleted, seq)

    first = [change(i, f"alpha beta{i}", False, 1) for i in range(6)]
    second = [change(0, "gamma", False, 2), change(1, "", True, 2), change(0, "older delta", False, 1), change(9, "alpha", False, 1)]
    source = str(tmp_path / "in")
    for batch in (first, second):
        spark.createDataFrame(batch, stream.CHANGES).coalesce(1).write.mode("append").parquet(source)
    incoming = spark.readStream.schema(stream.CHANGES).option("maxFilesPerTrigger", 1).parquet(source)
    index = str(tmp_path / "index")
    stream.stream_index(incoming, index, str(tmp_path / "cp"), "none").awaitTermination()
    live = {str(i): f"alpha beta{i}" for i in range(2, 6)} | {"0": "gamma", "9": "alpha"}
    nodes = spark.createDataFrame(
        [(i, "d", t, None, "/") for i, t in live.items()], "id STRING, domain STRING, content STRING, content_summary STRING, path STRING"
    )
    tags = nodes.select(F.col("id").alias("node_id"), F.lit("t").alias("tag"))
    batch = search.build_index(nodes, tags, "none")
    def live_postings():
        counts = [F.struct(F.lit(f).alias("field"), F.col(f"tf_{f}").cast("bigint").alias("tf")) for f in search.FIELDS]
        got = stored.open_index(spark, index, "none").unmarked("postings")
        got = got.select("node_id", "term", F.explode(F.array(*counts)).alias("x")).select("node_id", "term", "x.*").where("tf > 0")
        return rows(got, "node_id", "term", "field", "tf")

    assert live_postings() == rows(batch.postings, "node_id", "term", "field", "tf")
    # A batch that is run again changes nothing.
    stored.write_segment(spark.createDataFrame(second, stream.CHANGES), index, 1, "none")
    assert live_postings() == rows(batch.postings, "node_id", "term", "field", "tf")


def test_extracted_pages(spark, tmp_path):
    folder = tmp_path / "book" / "markdown"
    folder.mkdir(parents=True)
    (folder / "book_contents.json").write_text(json.dumps({
        "document_name": "book",
        "pages": [{"page_number": 1, "markdown_file": "p1.md"}, {"page_number": 2}, {"page_number": 3, "markdown_file": "gone.md"}],
    }, indent=1))
    (folder / "p1.md").write_text("# Page 1\n\nfirst\ntext")
    (folder / "page_0001.md").write_text("no header")
    out = rows(files.read_extracted(spark, str(tmp_path)), "doc_id", "page_no", "text")
    assert out == [("book", 0, "first\ntext"), ("book", 1, "no header"), ("book", 2, "")]
    found = files.scan_files(spark, str(tmp_path), "*.md", recursive=True)
    assert found.count() == 2 and files.scan_files(spark, str(folder), "*.json").count() == 1


SAMPLE = (
    "Table of Contents\n1. Introduction ........ 1\n2. Background ........ 3\n3. Method ........ 7",
    "# Introduction\nThis document introduces a sample with enough words to become a node of the graph.",
    "Second page of the introduction, also long enough to be admitted as a node of the graph.",
    "# Background\nThe background is told on the third printed page, in as many words as are needed here.",
)


def test_rebuild_twice_is_the_same_and_valid(spark, tmp_path):
    pages = spark.createDataFrame([("sample", i, t) for i, t in enumerate(SAMPLE)], PAGES)
    at = F.timestamp_seconds(F.lit(1000))
    path = str(tmp_path / "store")
    seen = []
    for _ in range(2):
        g = ingest.rebuild(spark, pages, path, now=at)
        seen.append({t: rows(g[t], *[c for c in g[t].columns if c != "ontology"]) for t in ("nodes", "edges", "tags")})
        assert store.violations(g).count() == 0
    assert seen[0] == seen[1]
    kinds = [r[1] for r in seen[0]["nodes"]]
    assert kinds.count("page") == 4 and kinds.count("document") == 1 and kinds.count("section") >= 2


def test_violations(spark):
    nodes = spark.createDataFrame([("a", "d", "x"), ("a", "d", "x"), ("b", "no", None)], "id STRING, domain STRING, content STRING")
    edges = spark.createDataFrame(
        [("e1", "a", "gone", "t", 1.2, "d"), ("e2", "a", "b", "t", 0.5, "d")],
        "id STRING, source STRING, target STRING, type STRING, strength DOUBLE, domain STRING",
    )
    tags = spark.createDataFrame([("a", "t"), ("a", "t"), ("lost", "t")], "node_id STRING, tag STRING")
    domains = spark.createDataFrame([("d",)], "id STRING")
    g = {"nodes": nodes, "edges": edges, "tags": tags, "domains": domains}
    assert rows(store.violations(g), "rule", "table", "key") == [
        ("foreign key domain", "nodes", "no"), ("foreign key node_id", "tags", "lost"),
        ("foreign key target", "edges", "gone"), ("not null content", "nodes", "b"),
        ("primary key", "nodes", "a"), ("primary key", "tags", "a|t"), ("strength range", "edges", "e1"),
    ]
    assert rows(store.valid_edges(g), "id") == [("e2",)]


def test_answers(spark):
    good = {"summary": "s", "key_concepts": ["a", "b", "c"], "relationships": [["x", "contains", "y"], ["y", "follows", "z"]],
            "ontology_tags": ["t1", "t2", "t3"], "confidence": 0.9, "evidence": ["q"]}
    other = {"semantic_summary": "t", "key_insights": ["i"], "confidence_score": 0.4,
             "relationships": [{"concept1": "m", "relationship": "supports", "concept2": "n"}]}
    texts = [json.dumps(good), "not json", "```json\n" + json.dumps(other) + "\n```", json.dumps(good)[:-4], "[1, 2]", "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, response STRING")
    out = {r.id: r for r in enrich.parse_responses(df).collect()}
    assert (out[0].summary, len(out[0].key_concepts), len(out[0].relationships), out[0].confidence, out[0].evidence) == ("s", 3, 2, 0.9, ["q"])
    assert (out[1].summary, out[1].confidence, out[1].key_concepts) == ("not json", 0.5, [])
    assert (out[2].summary, out[2].confidence) == ("t", 0.4)
    assert tuple(out[2].relationships[0]) == ("m", "supports", "n")
    assert (out[3].confidence, out[4].confidence) == (0.5, 0.5)
    assert (out[5].summary, out[5].confidence) == ("", 0.7)
    valid = {r.id: r.valid for r in enrich.validate_responses(df).collect()}
    assert valid == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False}


def test_prompt_of_the_sample(spark):
    pages = spark.createDataFrame([("d", i, "This is the page content." if i == 0 else "{text} is no field") for i in range(10)], PAGES)
    structure_text = spark.createDataFrame([("d", "1 Introduction (p.0)")], "doc_id STRING, structure STRING")
    summaries = pages.select("doc_id", "page_no", F.concat(F.lit("sum"), "page_no").alias("summary"), F.lit(True).alias("shortened"))
    out = {r.page_no: r.prompt for r in enrich.build_prompts(pages, structure_text, summaries).collect()}
    assert len(out) == 10 and "1 of 10 (long text)" in out[0] and "1 Introduction (p.0)" in out[0]
    assert "{text} is no field" in out[5] and "sum3\nsum4" in out[5] and "sum2" not in out[5]


def test_scorer_counts_each_prompt_once(spark):
    prompts = spark.createDataFrame([("d", i, f"h{i % 2}", f"## Text\nSome words of prompt {i % 2}.\n## x") for i in range(6)],
                                    "doc_id STRING, page_no INT, prompt_hash STRING, prompt STRING")
    assert enrich.score(prompts, calls=2).count() == 2
    at = F.timestamp_seconds(F.lit(10_000))
    cache = spark.createDataFrame([("h0", "kept")], "prompt_hash STRING, response STRING").withColumn("ts", F.timestamp_seconds(F.lit(9_000)))
    answers, new = enrich.score_cached(prompts, cache, at)
    assert answers.count() == 6 and new.count() == 1
    assert answers.filter("response = 'kept'").count() == 3
    parsed = enrich.parse_responses(answers.filter("response <> 'kept'"))
    assert parsed.first().confidence == 0.9


def test_cost_and_time(spark):
    usage = spark.createDataFrame([("d", "gpt-4o", 1000, 1000, 2), ("d", "llava:7b", 1000, 0, 1), ("e", "PHI-3", 0, 1000, 3)],
                                  "doc_id STRING, model STRING, input_tokens INT, output_tokens INT, pages INT")
    assert rows(enrich.estimate_cost(usage), "doc_id", F.round("cost", 6)) == [("d", 0.03), ("e", 0.03)]
    assert rows(enrich.estimate_time(usage), "doc_id", "seconds") == [("d", 13.0), ("e", 9.0)]


# --- findings of a review ------------------------------------------------------------


def test_page_markers_keep_every_character(spark):
    docs = spark.createDataFrame([("a", "x\nPage 1\nabc\x01def\n\nPage 2\nxyz\n"), ("b", "no marker")], "doc_id STRING, text STRING")
    assert rows(shape.split_on_markers(docs, 1), "doc_id", "page_no", "text") == [
        ("a", 0, "Page 1\nabc\x01def\n"), ("a", 1, "Page 2\nxyz"), ("b", 0, "no marker")]


def test_an_entry_far_beyond_the_last_page_unfolds_nothing(spark):
    pages = spark.createDataFrame([("a", 0, "one"), ("a", 1, "two")], PAGES)
    toc = spark.createDataFrame(
        [("a", 0, "1", "First", 0, 1), ("a", 1, "2", "Far", 2_000_000_000, 1)],
        "doc_id STRING, seq INT, number STRING, title STRING, page INT, level INT",
    )
    assert rows(structure.toc_ranges(toc, pages), "seq", "page", "end_page") == [(0, 0, 1)]


def test_a_relation_on_two_pages_is_one_edge(spark):
    pages = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], PAGES)
    relations = spark.createDataFrame(
        [("a", p, "k1", "k2", "type_of", 0.7, [p]) for p in (1, 0)],
        "doc_id STRING, page_no INT, source_key STRING, target_key STRING, type STRING, strength DOUBLE, evidence_at ARRAY<INT>",
    )
    terms = spark.createDataFrame([], "doc_id STRING, page_no INT, term STRING, significance DOUBLE")
    edges = graph.analysis_edges(pages, terms, relations).collect()
    assert len({e.id for e in edges}) == len(edges)
    found = [e for e in edges if e.evidence and e.evidence[0].startswith("a:")]
    assert [(e.confidence, list(e.evidence)) for e in found] == [(1.0, ["a:0:0"])]


def test_phrases_are_words_of_any_field(spark):
    nodes = spark.createDataFrame(
        [("1", "d", "beginning them", None, "/x"), ("2", "d", "in\nthe house", None, "/x"), ("3", "d", "the", "in", "/in the end"), ("4", "d", "café noir", None, "/x")],
        "id STRING, domain STRING, content STRING, content_summary STRING, path STRING",
    )
    index = search.build_index(nodes, stemmer="none")
    found = lambda phrase: rows(search.search(index, phrase=phrase, nodes=nodes), "node_id")
    assert found("in the") == [("2",), ("3",)] and found("cafe noir") == [("4",)]


def test_one_edge_per_id_is_the_same_in_every_run(spark):
    edges = spark.createDataFrame([("e", 0.2), ("e", 0.9), ("f", 0.1)], "id STRING, strength DOUBLE")
    assert rows(graph.one_per_id(edges.repartition(3)), "id", "strength") == [("e", 0.9), ("f", 0.1)]


def test_a_rebuilt_domain_keeps_its_time_of_creation(spark, tmp_path):
    pages = spark.createDataFrame([("a", 0, "some text that is long enough to be admitted as a page of its own, surely")], PAGES)
    path = str(tmp_path / "store")
    for stamp in (1000, 2000):
        g = ingest.rebuild(spark, pages, path, now=F.timestamp_seconds(F.lit(stamp)))
    assert rows(g["domains"], F.unix_seconds("created"), F.unix_seconds("last_access")) == [(1000, 2000)]
