"""Graph construction."""

from pyspark.sql import functions as F

from leafgraph.checks.base import CTES, NL, WS, clean_sql, lit, query
from leafgraph.checks.lexical import LEX, REL
from leafgraph.checks.shape import book_docs
from leafgraph.checks.structure import SECTION_CTES, book_sections
from leafgraph.config import ONTOLOGY_DOMAINS
from leafgraph.functions import patterns as P
from leafgraph.functions import text as X
from leafgraph.functions.ids import edge_id
from leafgraph.operators import graph, lexical
from leafgraph.sources import adapters as A


def nid(kind: str, key: str, doc: str = "doc_id", node: str | None = None) -> str:
    return f"md5('documents|' || {doc} || '|{node or kind}|' || CAST({key} AS VARCHAR))"


def eid(a: str, b: str, kind: str) -> str:
    return f"{a} || '-' || {b} || '-' || {kind}"


DOC, PAGE = nid("document", "doc_id"), nid("page", "page_no")
NEXT = nid("page", "page_no + 1")
SECTION = nid("section", "CAST(seq AS VARCHAR) || ':' || CAST(part AS VARCHAR)")

CTES["g_pages"] = f"g_pages AS (SELECT * FROM books WHERE length({clean_sql('text')}) >= 50)"
CTES["g_sections"] = (
    f"g_sections AS (SELECT * FROM book_sections WHERE length({clean_sql('content')}) >= 50)"
)
BOOK_GRAPH = (*SECTION_CTES, "book_docs", "book_text", "g_pages", "g_sections")


def documents(spark, d):
    return book_docs(spark, d).withColumn("filename", F.concat("doc_id", F.lit(".pdf")))


@query(
    "G1_build_nodes",
    f"""SELECT {DOC} AS id, 'document' AS type, doc_id, CAST(NULL AS INTEGER) AS page_no, content,
      '/documents/' || doc_id AS path, 'documents' AS domain FROM book_text
    UNION ALL SELECT {PAGE}, 'page', doc_id, page_no, text,
      '/documents/' || doc_id || '/pages/' || CAST(page_no AS VARCHAR), domain FROM g_pages
    UNION ALL SELECT {SECTION}, 'section', doc_id, NULL, content,
      '/documents/' || doc_id || '/sections/' || section_id, 'documents' FROM g_sections""",
    BOOK_GRAPH,
    recursive=True,
)
def g1(spark, d):
    nodes = graph.build_nodes(documents(spark, d), A.books(spark, d), book_sections(spark, d))
    return nodes.select("id", "type", "doc_id", "page_no", "content", "path", "domain")


CTES["g_edges"] = f"""g_edges AS (
    SELECT {PAGE} AS source, {DOC} AS target, 'part_of' AS type, CAST(1.0 AS DOUBLE) AS strength FROM g_pages
    UNION ALL SELECT {PAGE}, {NEXT}, 'precedes', 1.0 FROM g_pages p WHERE EXISTS (
      SELECT 1 FROM g_pages q WHERE q.doc_id = p.doc_id AND q.page_no = p.page_no + 1)
    UNION ALL SELECT {SECTION}, {DOC}, 'part_of', 0.9 FROM g_sections
    UNION ALL SELECT {SECTION}, {PAGE}, 'contains', 0.8 FROM (
      SELECT s.doc_id, s.seq, s.part, unnest(s.pages) AS page_no FROM g_sections s) u
      WHERE EXISTS (SELECT 1 FROM g_pages p WHERE p.doc_id = u.doc_id AND p.page_no = u.page_no))"""


@query(
    "G3_structural_edges",
    f"SELECT {eid('source', 'target', 'type')} AS id, source, target, type, strength FROM g_edges",
    (*BOOK_GRAPH, "g_edges"),
    recursive=True,
)
def g3(spark, d):
    edges = graph.structural_edges(A.books(spark, d), book_sections(spark, d))
    return edges.select("id", "source", "target", "type", "strength")


CTES["conv_docs"] = (
    "docs AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS INTEGER) AS page_no, text, "
    "'documents' AS domain FROM conversations)"
)
CONV_LEX = ("conv_docs", "tokens", "sents", "ents", "pattern_rel", "cooc", "relations", "stems", "scores", "key_terms")
RAW, RAW_NEXT = nid("raw", "page_no"), nid("raw", "page_no + 1")
SUM, SUM_NEXT = nid("summary", "page_no"), nid("summary", "page_no + 1")
TERM = nid("term", "CAST(page_no AS VARCHAR) || ':' || term")
FIRST_SENTENCE = "left(regexp_split_to_array(text, '[.!?]\\s+')[1], 500)"


def conv_terms(spark, d):
    return lexical.key_terms(A.convs(spark, d), threshold=0.02, stemmer="light")


def conv_summaries(spark, d):
    return A.convs(spark, d).select(
        "doc_id", "page_no", X.first_sentence(F.col("text")).alias("summary"), F.lit(0.9).alias("confidence")
    )


@query(
    "G2_analysis_nodes",
    f"""WITH names AS (SELECT DISTINCT name FROM (SELECT source AS name FROM pattern_rel UNION ALL
      SELECT target FROM pattern_rel UNION ALL SELECT entity FROM ents))
    SELECT {PAGE} AS id, 'page' AS type, doc_id, page_no, text AS content, CAST(0.8 AS DOUBLE) AS confidence,
      0 AS tags FROM docs
    UNION ALL SELECT {RAW}, 'document', doc_id, page_no, text, 1.0, 0 FROM docs
    UNION ALL SELECT {TERM}, 'concept', doc_id, page_no, term, round(significance, 6), 1 FROM key_terms
    UNION ALL SELECT md5('documents|concept|' || md5(name)), 'concept', NULL, NULL, name, 0.7, 0 FROM names
    UNION ALL SELECT {SUM}, 'summary', doc_id, page_no, {FIRST_SENTENCE}, 0.9, 0 FROM docs""",
    CONV_LEX,
)
def g2(spark, d):
    convs = A.convs(spark, d)
    nodes = graph.analysis_nodes(
        convs, conv_terms(spark, d), lexical.relation_names(convs), conv_summaries(spark, d)
    )
    return nodes.select(
        "id", "type", "doc_id", "page_no", "content", F.round("confidence", 6).alias("confidence"),
        F.size("ontology").alias("tags"),
    )


_MAP = " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in P.RELATION_TYPE_EDGES.items())
_HAS_NEXT = (
    "EXISTS (SELECT 1 FROM docs q WHERE q.doc_id = p.doc_id AND q.page_no = p.page_no + 1)"
)
_SRC, _DST = "md5('documents|concept|' || source_key)", "md5('documents|concept|' || target_key)"
CTES["a_edges"] = f"""a_edges AS (
    SELECT {PAGE} AS source, {RAW} AS target, 'derived_from' AS type, CAST(1.0 AS DOUBLE) AS confidence,
      'Markdown content directly extracted from document' AS evidence FROM docs
    UNION ALL SELECT {PAGE}, {NEXT}, 'precedes', 1.0, 'Sequential page order in document' FROM docs p WHERE {_HAS_NEXT}
    UNION ALL SELECT {RAW}, {RAW_NEXT}, 'precedes', 1.0, 'Sequential page order in document' FROM docs p WHERE {_HAS_NEXT}
    UNION ALL SELECT {PAGE}, {TERM}, 'contains', round(significance, 6), '' FROM key_terms
    UNION ALL SELECT source, target, type, round(least(sum(strength), 1.0), 6), min_by(evidence, (doc_id, page_no, evidence)) FROM (
      SELECT {_SRC} AS source, {_DST} AS target, CASE type {_MAP} ELSE 'relates_to' END AS type, strength, doc_id, page_no,
        array_to_string(list_transform(evidence_at, lambda s: doc_id || ':' || CAST(page_no AS VARCHAR) || ':'
          || CAST(s AS VARCHAR)), '|') AS evidence FROM relations) GROUP BY source, target, type
    UNION ALL SELECT {SUM}, {PAGE}, 'summarizes', 0.9, 'Generated by semantic analysis' FROM docs
    UNION ALL SELECT {SUM}, {SUM_NEXT}, 'precedes', 1.0, 'Sequential page order in document' FROM docs p WHERE {_HAS_NEXT})"""


def conv_edges(spark, d):
    convs = A.convs(spark, d)
    return graph.analysis_edges(
        convs, conv_terms(spark, d), lexical.page_relations(convs), conv_summaries(spark, d)
    )


@query("G4_analysis_edges", "SELECT * FROM a_edges", (*CONV_LEX, "a_edges"))
def g4(spark, d):
    return conv_edges(spark, d).select(
        "source", "target", "type", F.round("confidence", 6).alias("confidence"),
        F.array_join("evidence", "|").alias("evidence"),
    )


CTES["g_tags"] = f"""g_tags AS (SELECT DISTINCT node_id, CASE WHEN tag LIKE 'pdf:%' THEN tag ELSE 'pdf:' || tag END AS tag
  FROM (SELECT {DOC} AS node_id, unnest(['document', 'root', doc_id || '.pdf']) AS tag FROM book_docs
    UNION ALL SELECT {PAGE}, unnest(['page', 'page:' || CAST(page_no AS VARCHAR), doc_id || '.pdf']) FROM g_pages
    UNION ALL SELECT {PAGE}, 'ontology:' || domain FROM g_pages
    UNION ALL SELECT {PAGE}, 'insight:' || w FROM (
      SELECT doc_id, page_no, unnest(string_split(text, ' ')) AS w FROM g_pages)
    UNION ALL SELECT {SECTION}, unnest(['section', 'section:' || CAST(level AS VARCHAR), title]) FROM g_sections))"""


def book_tags(spark, d):
    pages = A.books(spark, d)
    insights = pages.select(
        "doc_id", "page_no", F.split("text", " ").alias("key_insights"), F.array("domain").alias("ontology_tags")
    )
    return graph.build_tags(documents(spark, d), pages, book_sections(spark, d), insights)


@query("G5_build_tags", "SELECT node_id, tag FROM g_tags", (*BOOK_GRAPH, "g_tags"), recursive=True)
def g5(spark, d):
    return book_tags(spark, d)


@query(
    "G6_map_relation_type",
    f"""SELECT type, CASE type {_MAP} ELSE 'relates_to' END AS edge_type, count(*) AS n FROM (
      SELECT type FROM pattern_rel UNION ALL SELECT event_type FROM events) GROUP BY ALL""",
    ("docs", "sents", "pattern_rel"),
)
def g6(spark, d):
    stated = lexical.pattern_relations(lexical.sentences(A.docs(spark, d))).select("type")
    types = stated.unionByName(A.table(spark, d, "events").select(F.col("event_type").alias("type")))
    return types.groupBy("type", graph.map_relation_type(F.col("type")).alias("edge_type")).agg(
        F.count("*").alias("n")
    )


_WORDS = [w for w, _, _ in P.RELATION_TEXT_EDGES]
CTES["said"] = "said AS (SELECT event_id, 'It ' || ['" + "', '".join(_WORDS) + (
    f"', 'touches'][event_id % {len(_WORDS) + 1} + 1] || ' ' || event_type AS relation FROM events)"
)
_TEXT = " ".join(f"WHEN contains(lower(relation), {lit(w)}) THEN {lit(t)}" for w, t, _ in P.RELATION_TEXT_EDGES)


@query(
    "G7_map_relation_text",
    f"""SELECT event_id, CASE {_TEXT} ELSE 'relates_to' END AS type,
      NOT contains(lower(relation), 'precedes') AND contains(lower(relation), 'follows') AS reversed FROM said""",
    ("said",),
)
def g7(spark, d):
    events = A.table(spark, d, "events").select("event_id", "event_type")
    words = F.array(*[F.lit(w) for w in _WORDS], F.lit("touches"))
    relation = F.concat(
        F.lit("It "),
        F.element_at(words, (F.col("event_id") % (len(_WORDS) + 1) + 1).cast("int")),
        F.lit(" "), "event_type",
    )
    return events.select("event_id", graph.map_relation_text(relation).alias("m")).select("event_id", "m.*")


def _normal(c):
    return f"array_to_string(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> ''), ' ')"


def concepts_of_parts(spark, d):
    return A.table(spark, d, "part").select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("concept_id"),
        F.concat("p_name", F.lit("  "), "p_type").alias("text"),
        F.col("p_partkey").alias("ord"),
    )


@query(
    "G8_resolve_concepts",
    f"""WITH mentions AS (SELECT DISTINCT upper(p_name) || ' ' || p_type AS name FROM part
        WHERE p_partkey % 3 = 0 UNION SELECT text FROM benchmark),
      known AS (SELECT {_normal("p_name || '  ' || p_type")} AS key, arg_min('part-' || CAST(p_partkey AS VARCHAR), p_partkey)
        AS concept_id FROM part GROUP BY 1)
    SELECT name, concept_id FROM mentions LEFT JOIN known ON known.key = {_normal('name')}""",
)
def g8(spark, d):
    part = A.table(spark, d, "part").filter("p_partkey % 3 = 0")
    mentions = part.select(F.concat(F.upper("p_name"), F.lit(" "), "p_type").alias("name")).unionByName(
        A.table(spark, d, "benchmark").select(F.col("text").alias("name"))
    )
    return graph.resolve_concepts(mentions, concepts_of_parts(spark, d))


@query(
    "G8_resolve_concepts_whole",
    f"""WITH mentions AS (SELECT DISTINCT upper(p_name) || ' ' || p_type AS name FROM part UNION SELECT text FROM benchmark),
      known AS (SELECT {_normal("p_name || '  ' || p_type")} AS key, arg_min('part-' || CAST(p_partkey AS VARCHAR), p_partkey)
        AS concept_id FROM part GROUP BY 1)
    SELECT name, concept_id FROM mentions LEFT JOIN known ON known.key = {_normal('name')}""",
)
def g8_whole(spark, d):
    part = A.table(spark, d, "part")
    mentions = part.select(F.concat(F.upper("p_name"), F.lit(" "), "p_type").alias("name")).unionByName(
        A.table(spark, d, "benchmark").select(F.col("text").alias("name"))
    )
    return graph.resolve_concepts(mentions, concepts_of_parts(spark, d))


@query(
    "G8_resolve_concepts_contains",
    f"""WITH mentions AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT event_type FROM events),
      known AS (SELECT {_normal("p_name || '  ' || p_type")} AS key, 'part-' || CAST(p_partkey AS VARCHAR) AS concept_id,
        p_partkey AS ord FROM part)
    SELECT name, (SELECT arg_min(concept_id, ord) FROM known
      WHERE contains(' ' || key || ' ', ' ' || {_normal('name')} || ' ')) AS concept_id FROM mentions""",
)
def g8b(spark, d):
    mentions = A.table(spark, d, "part").select(F.col("p_name").alias("name")).unionByName(
        A.table(spark, d, "events").select(F.col("event_type").alias("name"))
    )
    return graph.resolve_concepts(mentions, concepts_of_parts(spark, d), "contains", grams=2)


# --- scores over the pages of conversations ------------------------------------------

CTES["c_edges"] = f"""c_edges AS (
  SELECT {eid(PAGE, NEXT, "'precedes'")} AS id, {PAGE} AS source, {NEXT} AS target, 'precedes' AS type,
    CAST(1.0 AS DOUBLE) AS strength, p.doc_id, p.page_no,
    (SELECT epoch_us(min(ts)) FROM events e WHERE e.user_id = CAST(p.doc_id AS BIGINT)) AS us
  FROM docs p WHERE {_HAS_NEXT})"""
CTES["c_scored"] = """c_words AS (SELECT doc_id, page_no, list_distinct(list_filter(
    regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS ws FROM docs),
  c_scored AS (
    SELECT e.*, CASE WHEN len(a.ws) = 0 OR len(b.ws) = 0 THEN 0 ELSE
      CAST(len(list_intersect(a.ws, b.ws)) AS DOUBLE) / len(list_distinct(list_concat(a.ws, b.ws))) END AS lexical
    FROM c_edges e JOIN c_words a ON a.doc_id = e.doc_id AND a.page_no = e.page_no
      JOIN c_words b ON b.doc_id = e.doc_id AND b.page_no = e.page_no + 1)"""
SCORED = ("conv_docs", "c_edges", "c_scored")
AS_OF = 1_705_276_800  # 2024-01-15


def conv_nodes(spark, d):
    return A.convs(spark, d).select(
        graph.page_node("documents").alias("id"), F.lit("page").alias("type"), "doc_id", "page_no",
        F.col("text").alias("content"),
    )


def conv_chain(spark, d, touched=True):
    """precedes edges of the conversations, touched at the first event of that user."""
    chain = graph.precedes(A.convs(spark, d))
    if touched:
        seen = A.table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("doc_id")).agg(
            F.min("ts").cast("timestamp").alias("ts")
        )
        chain = chain.join(seen, "doc_id", "left")
    return graph.make_edges(
        chain, graph.page_node("documents"), graph.page_node("documents", F.col("page_no") + 1),
        "precedes", 1.0,
    )


@query("G9_lexical_similarity", "SELECT id, round(lexical, 6) AS lexical FROM c_scored", SCORED)
def g9(spark, d):
    out = graph.lexical_similarity(conv_chain(spark, d, False), conv_nodes(spark, d))
    return out.select("id", F.round("lexical", 6).alias("lexical"))


@query(
    "G10_score_edges",
    "SELECT id, round(least(lexical * 1.9, 1.0), 6) AS strength FROM c_scored",
    SCORED,
)
def g10(spark, d):
    out = graph.score_edges(conv_chain(spark, d, False), conv_nodes(spark, d), 0.9)
    return out.select("id", F.round("strength", 6).alias("strength"))


def as_of():
    return F.timestamp_seconds(F.lit(AS_OF))


@query(
    "G11_decay_edges",
    f"""SELECT id, round(strength * coalesce(exp(-0.1 * ({AS_OF}000000 - us) / 3.6e9), 1.0), 9) AS strength
    FROM c_edges""",
    ("conv_docs", "c_edges"),
)
def g11(spark, d):
    out = graph.decay_edges(conv_chain(spark, d), as_of())
    return out.select("id", F.round("strength", 9).alias("strength"))


@query(
    "G12_update_scores",
    f"""SELECT id, round(CASE WHEN page_no % 2 = 0 THEN least(lexical * 1.8
        * coalesce(exp(-0.001 * ({AS_OF}000000 - us) / 3.6e9), 1.0), 1.0) ELSE strength END, 6) AS strength,
      CASE WHEN page_no % 2 = 0 THEN CAST(0.95 AS DOUBLE) ELSE 1.0 END AS confidence,
      CASE WHEN page_no % 2 = 0 THEN {AS_OF}000000 ELSE us END AS us FROM c_scored""",
    SCORED,
)
def g12(spark, d):
    even = graph.precedes(A.convs(spark, d)).filter("page_no % 2 = 0").select(
        edge_id(graph.page_node("documents"), graph.page_node("documents", F.col("page_no") + 1), "precedes").alias("id"),
        F.lit(0.95).alias("confidence"), F.lit(0.8).alias("boost"),
    )
    out = graph.update_scores(conv_chain(spark, d), conv_nodes(spark, d), even, as_of(), rate=0.001)
    return out.select(
        "id", F.round("strength", 6).alias("strength"), "confidence", F.unix_micros("ts").alias("us")
    )


CTES["user_edges"] = """user_edges AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || event_type || '-references' AS id, CAST(user_id AS VARCHAR) AS source,
    event_type AS target, 'references' AS type, round((value * 100) % 100 / 100, 6) AS strength,
    epoch_us(ts) AS us, event_id FROM events)"""


def user_edges(spark, d):
    """Edges from users to event types, many with the same id and different times."""
    e = A.table(spark, d, "events")
    e = e.select(
        F.col("user_id").cast("string").alias("u"), "event_type", F.col("ts").cast("timestamp").alias("ts"),
        F.round((F.col("value") * 100) % 100 / 100, 6).alias("s"), "event_id",
    )
    keep = graph.make_edges(e, F.col("u"), F.col("event_type"), "references", F.col("s"))
    return keep


@query(
    "G13_upsert_edges",
    "SELECT id, arg_max(strength, us) AS strength, max(us) AS us FROM user_edges GROUP BY id",
    ("user_edges",),
)
def g13(spark, d):
    edges = user_edges(spark, d)
    hour = F.hour("ts")
    out = graph.upsert_edges(edges.filter(hour < 12), edges.filter(hour >= 12))
    return out.select("id", "strength", F.unix_micros("ts").alias("us"))


@query(
    "G14_update_summaries",
    f"""SELECT {PAGE} AS id, CASE WHEN page_no % 2 = 0 THEN {FIRST_SENTENCE} END AS content_summary,
      CASE WHEN page_no % 2 = 0 THEN CAST({AS_OF} AS BIGINT) END AS summary_at FROM docs""",
    ("conv_docs",),
)
def g14(spark, d):
    nodes = conv_nodes(spark, d).withColumns(
        {"content_summary": F.lit(None).cast("string"), "summary_ts": F.lit(None).cast("timestamp")}
    )
    new = conv_summaries(spark, d).filter("page_no % 2 = 0").select(
        graph.page_node("documents").alias("id"), "summary"
    )
    out = graph.update_summaries(nodes, new, as_of())
    return out.select("id", "content_summary", F.unix_seconds("summary_ts").alias("summary_at"))


_TAGS = [k for ks in ONTOLOGY_DOMAINS.values() for k in ks] + ["misc"]
_DOMAIN = " ".join(
    f"WHEN regexp_matches(lower(tag), {lit(X.any_of(k))}) THEN {lit(n)}" for n, k in ONTOLOGY_DOMAINS.items()
)
CTES["part_tags"] = (
    "part_tags AS (SELECT p_partkey, ['" + "', '".join(_TAGS)
    + f"'][p_partkey % {len(_TAGS)} + 1] || '_' || upper(p_type) AS tag FROM part)"
)


@query(
    "G15_ontology_domain",
    f"SELECT p_partkey, tag, CASE {_DOMAIN} ELSE 'general' END AS domain FROM part_tags",
    ("part_tags",),
)
def g15(spark, d):
    tags = F.array(*[F.lit(t) for t in _TAGS])
    tag = F.concat(
        F.element_at(tags, (F.col("p_partkey") % len(_TAGS) + 1).cast("int")), F.lit("_"), F.upper("p_type")
    )
    return A.table(spark, d, "part").select(
        "p_partkey", tag.alias("tag"), graph.ontology_domain(tag).alias("domain")
    )


@query(
    "G16_infer_ontology",
    """SELECT p_partkey, CASE
        WHEN p_partkey % 3 = 0 AND p_size / 50.0 > 0.8 THEN 'algorithm|computational'
        WHEN p_partkey % 3 = 1 AND p_size / 50.0 > 0.7 THEN 'hypothesis|research_question'
        ELSE ['algorithm', 'hypothesis', 'computational'][p_partkey % 3 + 1] END AS tags,
      round(CASE WHEN p_partkey % 3 = 0 AND p_size / 50.0 > 0.8 THEN p_size / 50.0 * 0.9
        WHEN p_partkey % 3 = 1 AND p_size / 50.0 > 0.7 THEN p_size / 50.0 * 0.8 ELSE p_size / 50.0 END, 6) AS last_confidence
    FROM part""",
)
def g16(spark, d):
    name = F.element_at(
        F.array(F.lit("algorithm"), F.lit("hypothesis"), F.lit("computational")), (F.col("p_partkey") % 3 + 1).cast("int")
    )
    tag = graph.ontology_tag(name, F.col("p_size") / 50.0, graph.ontology_domain(name))
    nodes = A.table(spark, d, "part").select("p_partkey", F.array(tag).alias("ontology"))
    out = graph.infer_ontology(graph.infer_ontology(nodes))
    return out.select(
        "p_partkey",
        F.array_join(F.transform("ontology", lambda t: t["category"]), "|").alias("tags"),
        F.round(F.element_at("ontology", -1)["confidence"], 6).alias("last_confidence"),
    )


def book_enrichments(spark, d):
    """A summary and key concepts for the even pages of the books."""
    pages = A.books(spark, d).filter("page_no % 2 = 0")
    return pages.select(
        "doc_id", "page_no", X.first_sentence(F.col("text"), 120).alias("summary"),
        F.slice(F.split("text", " "), 1, 2).alias("key_concepts"),
    )


_SHORT = "left(regexp_split_to_array(text, '[.!?]\\s+')[1], 120)"


@query(
    "G17_apply_enrichment",
    f"""SELECT doc_id, page_no, CASE WHEN page_no % 2 = 0 AND {_SHORT} <> '' THEN '# Semantic Summary' || {NL} || {NL}
        || {_SHORT} || {NL} || {NL} || '# Original Content' || {NL} || {NL} || text ELSE text END AS content,
      CASE WHEN page_no % 2 = 0 THEN array_to_string(list_slice(string_split(text, ' '), 1, 2), '|') END AS concepts
    FROM books""",
    ("books",),
)
def g17(spark, d):
    out = graph.apply_enrichment(A.books(spark, d), book_enrichments(spark, d))
    return out.select("doc_id", "page_no", "content", F.array_join("key_concepts", "|").alias("concepts"))


@query(
    "G17_enrich_sections",
    f"""WITH e AS (SELECT doc_id, page_no, {_SHORT} AS summary FROM books WHERE page_no % 2 = 0 AND {_SHORT} <> ''),
    f AS (SELECT u.doc_id, u.seq, u.part, string_agg(e.summary, {NL} || {NL} ORDER BY u.page_no) AS body FROM (
      SELECT doc_id, seq, part, unnest(pages) AS page_no FROM book_sections) u
      JOIN e ON e.doc_id = u.doc_id AND e.page_no = u.page_no GROUP BY ALL)
    SELECT s.doc_id, s.seq, s.part, CASE WHEN f.body IS NOT NULL THEN '## ' || s.title || {NL} || {NL} || f.body
      ELSE s.content END AS content
    FROM book_sections s LEFT JOIN f ON f.doc_id = s.doc_id AND f.seq = s.seq AND f.part = s.part""",
    SECTION_CTES,
    recursive=True,
)
def g17b(spark, d):
    out = graph.enrich_sections(book_sections(spark, d), book_enrichments(spark, d))
    return out.select("doc_id", "seq", "part", "content")


def conv_enrichments(spark, d):
    """Each turn relates to its second word by one of three phrases."""
    word = F.regexp_extract("text", r"^\S+\s+(\S+)", 1)
    phrase = F.element_at(
        F.array(F.lit("Defines the"), F.lit("follows"), F.lit("contains")), F.col("page_no") % 3 + 1
    )
    relation = F.struct(F.lit("page").alias("source"), phrase.alias("relation"), word.alias("target"))
    return A.convs(spark, d).filter(word != "").select(
        "doc_id", "page_no", X.first_sentence(F.col("text")).alias("summary"), F.lit(0.5).alias("confidence"),
        F.array(relation).alias("relationships"),
    )


_TARGET = "coalesce(k.concept_id, md5('documents|concept|' || md5(w.key)))"
CTES["enriched"] = f"""said_words AS (SELECT doc_id, page_no, text, regexp_extract(text, '^\\S+\\s+(\\S+)', 1) AS name,
      {_normal("regexp_extract(text, '^\\S+\\s+(\\S+)', 1)")} AS key FROM docs
      WHERE regexp_extract(text, '^\\S+\\s+(\\S+)', 1) <> ''),
  known AS (SELECT {_normal('term')} AS key, min(term) AS concept_id FROM (
      SELECT DISTINCT regexp_extract(text, '^\\S+', 0) AS term FROM benchmark) GROUP BY 1),
  enriched AS (
    SELECT CASE WHEN w.page_no % 3 = 1 THEN {_TARGET} ELSE {PAGE} END AS source,
      CASE WHEN w.page_no % 3 = 1 THEN {PAGE} ELSE {_TARGET} END AS target,
      ['defines', 'precedes', 'contains'][w.page_no % 3 + 1] AS type, w.key, w.text, k.concept_id
    FROM said_words w LEFT JOIN known k ON k.key = w.key)"""


def _enriched(spark, d):
    first = F.regexp_extract("text", r"^\S+", 0)
    concepts = A.table(spark, d, "benchmark").select(first.alias("concept_id"), first.alias("text"), first.alias("ord"))
    return graph.enrichment_edges(conv_enrichments(spark, d), concepts, A.convs(spark, d))


@query(
    "G18_enrichment_edges",
    f"""SELECT DISTINCT source, target, type, round(least(2.0 / len(list_distinct(list_concat([key], list_filter(
        regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')))), 1.0), 6) AS strength,
      CAST(0.5 AS DOUBLE) AS confidence FROM enriched""",
    ("conv_docs", "enriched"),
)
def g18(spark, d):
    _, edges = _enriched(spark, d)
    return edges.select("source", "target", "type", F.round("strength", 6).alias("strength"), "confidence")


@query(
    "G18_enrichment_concepts",
    """SELECT md5('documents|concept|' || md5(key)) AS id, CAST(0.4 AS DOUBLE) AS confidence, count(*) AS n FROM (
      SELECT DISTINCT key FROM enriched WHERE concept_id IS NULL) GROUP BY key""",
    ("conv_docs", "enriched"),
)
def g18b(spark, d):
    nodes, _ = _enriched(spark, d)
    return nodes.groupBy("id", F.round("confidence", 6).alias("confidence")).agg(F.count("*").alias("n"))


@query(
    "G19_link_documents",
    """WITH p AS (SELECT DISTINCT md5('documents|' || a.source || '|document|' || a.source) AS s,
        md5('documents|' || a.lang || '|document|' || a.lang) AS t FROM documents a)
    SELECT s || '-' || t || '-related_to' AS id, s AS source, t AS target, 'related_to' AS type,
      CAST(0.7 AS DOUBLE) AS strength FROM p""",
)
def g19(spark, d):
    pairs = A.table(spark, d, "documents").select("source", "lang").distinct()

    def root(c):
        return F.md5(F.concat_ws("|", F.lit("documents"), c, F.lit("document"), c))

    pairs = pairs.select(root("source").alias("source"), root("lang").alias("target"))
    return graph.link_documents(pairs).select("id", "source", "target", "type", "strength")


@query(
    "G21_score_edges_by_type",
    """WITH e AS (SELECT event_id, ['contains', 'references', 'relates_to', 'supports', 'contradicts', 'defines',
        'precedes'][event_id % 7 + 1] AS type, (value * 100) % 100 / 100 AS base, event_id % 2 = 0 AS sem,
        event_id % 5 AS age FROM events),
      s AS (SELECT event_id, base * CASE WHEN sem THEN 1.5 ELSE 1 END * CASE WHEN age = 0 THEN 1 ELSE
        pow(0.9, age) * (1 - age * CAST(CASE type WHEN 'contains' THEN 0 WHEN 'references' THEN 0.1
          WHEN 'relates_to' THEN 0.2 WHEN 'supports' THEN 0.1 WHEN 'contradicts' THEN 0.05 WHEN 'defines' THEN 0
          ELSE 0.1 END AS DOUBLE)) END AS raw FROM e)
    SELECT event_id, round(CASE WHEN raw < 0.3 THEN 0 ELSE least(raw, 1.0) END, 10) AS score FROM s""",
)
def g21(spark, d):
    kinds = F.array(*[F.lit(k) for k in P.RELATION_DECAY], F.lit("precedes"))
    edges = A.table(spark, d, "events").select(
        "event_id",
        F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")).alias("type"),
        ((F.col("value") * 100) % 100 / 100).alias("base_score"),
        (F.col("event_id") % 2 == 0).alias("is_semantic"),
        (F.lit(10) - F.col("event_id") % 5).alias("created_step"),
    )
    return graph.score_edges_by_type(edges, 10).select("event_id", F.round("score", 10).alias("score"))


CTES["book_graph_edges"] = "book_graph_edges AS (SELECT source || '-' || target || '-' || type AS id, * FROM g_edges)"


@query(
    "G22_add_inverse_edges",
    """SELECT id, source, target, type, strength FROM book_graph_edges
    UNION ALL SELECT target || '-' || source || '-is_part_of', target, source, 'is_part_of', strength
    FROM book_graph_edges WHERE type = 'contains'""",
    (*BOOK_GRAPH, "g_edges", "book_graph_edges"),
    recursive=True,
)
def g22(spark, d):
    edges = graph.structural_edges(A.books(spark, d), book_sections(spark, d))
    return graph.add_inverse_edges(edges).select("id", "source", "target", "type", "strength")


@query(
    "G23_similar_edges",
    """WITH sets AS (SELECT doc_id AS id, list_sort(list_distinct(list_filter(
        regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''))) AS w FROM docs),
      firsts AS (SELECT w, min(id) AS id FROM sets WHERE len(w) > 0 GROUP BY w),
      words AS (SELECT id, len(w) AS n, unnest(w) AS word FROM firsts),
      pairs AS (SELECT a.id AS source, b.id AS target, CAST(count(*) AS DOUBLE) / (any_value(a.n) + any_value(b.n) - count(*)) AS s
        FROM words a JOIN words b ON a.word = b.word AND a.id < b.id GROUP BY a.id, b.id)
    SELECT source, target, round(s, 6) AS similarity FROM pairs WHERE s >= 0.7
    UNION ALL SELECT f.id, s.id, 1.0 FROM sets s JOIN firsts f ON f.w = s.w WHERE s.id <> f.id""",
    ("docs",),
)
def g23(spark, d):
    nodes = A.docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return graph.similar_edges(nodes).withColumn("similarity", F.round("similarity", 6))
