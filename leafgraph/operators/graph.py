"""Nodes, edges and tags of the graph, and the arithmetic on them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.config import ONTOLOGY_DOMAINS, Settings
from leafgraph.functions import patterns as P
from leafgraph.functions import text as X
from leafgraph.functions.durable import cut, scratch_folder
from leafgraph.functions.ids import edge_id, node_id
from leafgraph.operators import shape
from leafgraph.operators.ordered import attach
from leafgraph.schemas import TAG_STRUCT

PAGE = ["doc_id", "page_no"]
NODE_COLUMNS = [
    "id", "type", "doc_id", "page_no", "content", "path", "content_summary", "summary_ts", "ts",
    "confidence", "ontology", "domain",
]
EDGE_COLUMNS = ["id", "source", "target", "type", "strength", "confidence", "evidence", "ts", "domain"]


def _nodes(df: DataFrame, space: str, kind: str, key: Column, **columns: Column) -> DataFrame:
    """Rows of the node table; columns not given take their default."""
    defaults = {
        "id": node_id(space, F.col("doc_id"), kind, key),
        "type": F.lit(kind),
        "page_no": F.lit(None).cast("int"),
        "content_summary": F.lit(None).cast("string"),
        "summary_ts": F.lit(None).cast("timestamp"),
        "ts": F.lit(None).cast("timestamp"),
        "confidence": F.lit(1.0),
        "ontology": F.array().cast(f"ARRAY<{TAG_STRUCT}>"),
        "domain": F.col("domain") if "domain" in df.columns else F.lit(space),
        "path": F.lit("/"),
    }
    for name in ("doc_id", "page_no", "ts"):
        if name in df.columns and name not in columns:
            defaults[name] = F.col(name)
    cells = {**defaults, **columns}
    return df.select(*[cells[c].alias(c) for c in NODE_COLUMNS])


def make_edges(df: DataFrame, source: Column, target: Column, kind, strength, confidence=1.0,
               evidence: Column | None = None, space: str = Settings.domain) -> DataFrame:
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    return df.select(
        edge_id(source, target, kind).alias("id"),
        source.alias("source"),
        target.alias("target"),
        col(kind).alias("type"),
        col(strength).cast("double").alias("strength"),
        col(confidence).cast("double").alias("confidence"),
        (F.array().cast("array<string>") if evidence is None else evidence).alias("evidence"),
        (F.col("ts") if "ts" in df.columns else F.lit(None).cast("timestamp")).alias("ts"),
        F.lit(space).alias("domain"),
    )


def document_node(space: str) -> Column:
    return node_id(space, F.col("doc_id"), "document", F.col("doc_id"))


def page_node(space: str, page: Column | None = None) -> Column:
    return node_id(space, F.col("doc_id"), "page", F.col("page_no") if page is None else page)


def section_node(space: str) -> Column:
    return node_id(space, F.col("doc_id"), "section", F.concat_ws(":", "seq", "part"))


# --- stored graph -------------------------------------------------------------


def build_nodes(
    documents: DataFrame, pages: DataFrame, sections: DataFrame | None = None,
    space: str = Settings.domain, min_length: int = 50,
) -> DataFrame:
    """Document roots, admitted pages and sections under their paths."""
    roots = shape.document_text(documents, pages)
    base = F.concat(F.lit("/documents/"), F.col("doc_id"))
    parts = [
        _nodes(roots, space, "document", F.col("doc_id"), content=F.col("content"), path=base),
        _nodes(
            shape.admit(pages, min_length), space, "page", F.col("page_no"), content=F.col("text"),
            path=F.concat_ws("/", base, F.lit("pages"), F.col("page_no").cast("string")),
        ),
    ]
    if sections is not None:
        long_enough = sections.filter(F.length(X.clean(F.col("content"))) >= min_length)
        parts.append(
            _nodes(
                long_enough, space, "section", F.concat_ws(":", "seq", "part"), content=F.col("content"),
                path=F.concat_ws("/", base, F.lit("sections"), F.col("section_id")),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def precedes(pages: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Pairs of a page and the next page number, where both exist: an equi-join, no window."""
    following = pages.select("doc_id", (F.col("page_no") - 1).alias("page_no"))
    return pages.select(*PAGE, *keep).join(following, PAGE, "left_semi")


def structural_edges(
    pages: DataFrame, sections: DataFrame | None = None, space: str = Settings.domain, min_length: int = 50
) -> DataFrame:
    """part_of, precedes and contains between documents, pages and sections."""
    admitted = shape.admit(pages, min_length).select(*PAGE)
    parts = [
        make_edges(admitted, page_node(space), document_node(space), "part_of", 1.0, space=space),
        make_edges(
            precedes(admitted), page_node(space), page_node(space, F.col("page_no") + 1), "precedes", 1.0,
            space=space,
        ),
    ]
    if sections is not None:
        kept = sections.filter(F.length(X.clean(F.col("content"))) >= min_length)
        parts.append(make_edges(kept, section_node(space), document_node(space), "part_of", 0.9, space=space))
        spans = kept.select("doc_id", "seq", "part", F.explode("pages").alias("page_no"))
        inside = spans.join(admitted, PAGE, "left_semi")
        parts.append(make_edges(inside, section_node(space), page_node(space), "contains", 0.8, space=space))
    return reduce(DataFrame.unionByName, parts)


def build_tags(
    documents: DataFrame, pages: DataFrame, sections: DataFrame | None = None,
    enrichments: DataFrame | None = None, space: str = Settings.domain, prefix: str = "pdf:",
    min_length: int = 50, insights: int | None = None, topics: int | None = None,
) -> DataFrame:
    """Tags of every node, prefixed once; of a page's insights and ontology tags the first so many, or all."""
    names = documents.select("doc_id", "filename")
    roots = documents.select(
        document_node(space).alias("node_id"), F.array(F.lit("document"), F.lit("root"), F.col("filename")).alias("tags")
    )
    admitted = attach(shape.admit(pages, min_length).select(*PAGE), names, "doc_id", "page_no")
    tags = F.array(F.lit("page"), F.concat(F.lit("page:"), F.col("page_no").cast("string")), F.col("filename"))
    if enrichments is not None:
        extra = enrichments.select(*PAGE, "key_insights", "ontology_tags")
        admitted = admitted.join(extra, PAGE, "left")

        def top(c, n, label):
            some = F.coalesce(c, F.array().cast("array<string>"))
            some = some if n is None else F.slice(some, 1, n)
            return F.transform(some, lambda t: F.concat(F.lit(label), t))

        tags = F.concat(tags, top("key_insights", insights, "insight:"), top("ontology_tags", topics, "ontology:"))
    parts = [roots, admitted.select(page_node(space).alias("node_id"), tags.alias("tags"))]
    if sections is not None:
        kept = sections.filter(F.length(X.clean(F.col("content"))) >= min_length)
        parts.append(
            kept.select(
                section_node(space).alias("node_id"),
                F.array(F.lit("section"), F.concat(F.lit("section:"), F.col("level").cast("string")), F.col("title")).alias("tags"),
            )
        )
    # A node is in one row, so its duplicate tags are too: no shuffle to drop them.
    prefixed = F.array_distinct(
        F.transform("tags", lambda t: F.when(t.startswith(prefix), t).otherwise(F.concat(F.lit(prefix), t)))
    )
    return reduce(DataFrame.unionByName, parts).select("node_id", F.explode(prefixed).alias("tag"))


# --- analysis graph -------------------------------------------------------------


def raw_node(space: str, page: Column | None = None) -> Column:
    return node_id(space, F.col("doc_id"), "raw", F.col("page_no") if page is None else page)


def summary_node(space: str, page: Column | None = None) -> Column:
    return node_id(space, F.col("doc_id"), "summary", F.col("page_no") if page is None else page)


def term_node(space: str) -> Column:
    return node_id(space, F.col("doc_id"), "term", F.concat_ws(":", "page_no", "term"))


def concept_node(space: str, key: Column) -> Column:
    """Concepts of relations belong to the whole space, not to a document."""
    return F.md5(F.concat_ws("|", F.lit(space), F.lit("concept"), key))


def ontology_tag(category: Column, confidence: Column, domain: Column) -> Column:
    return F.struct(
        category.alias("category"), confidence.alias("confidence"), domain.alias("domain"),
        F.create_map().cast("map<string,string>").alias("attributes"),
    )


def analysis_nodes(
    pages: DataFrame, key_terms: DataFrame, names: DataFrame | None = None,
    summaries: DataFrame | None = None, space: str = Settings.domain,
) -> DataFrame:
    """Page (0.8), raw text (1.0), key term, relation concept (0.7) and summary nodes.

    ``names`` is ``key, name`` of the ends of relations.
    """
    stem_tag = F.array(
        ontology_tag(F.col("stem"), F.col("significance"), ontology_domain(F.col("stem")))
    )
    parts = [
        _nodes(pages, space, "page", F.col("page_no"), content=F.col("text"), confidence=F.lit(0.8)),
        _nodes(
            pages, space, "document", F.col("page_no"), id=raw_node(space), content=F.col("text"),
        ),
        _nodes(
            key_terms, space, "concept", F.lit(""), id=term_node(space), content=F.col("term"),
            confidence=F.col("significance"), ontology=stem_tag,
        ),
    ]
    if names is not None:
        parts.append(
            _nodes(
                names.withColumn("doc_id", F.lit(None).cast("string")), space, "concept", F.lit(""),
                id=concept_node(space, F.col("key")), content=F.col("name"), confidence=F.lit(0.7),
            )
        )
    if summaries is not None:
        parts.append(
            _nodes(
                summaries, space, "summary", F.col("page_no"), id=summary_node(space),
                content=F.col("summary"), confidence=F.col("confidence"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def analysis_edges(
    pages: DataFrame, key_terms: DataFrame, relations: DataFrame | None = None,
    summaries: DataFrame | None = None, space: str = Settings.domain,
) -> DataFrame:
    """Edges of the analysis graph.

    Concepts belong to the whole space, so a relation found on several pages is one edge:
    strengths add up to 1 at most.  Its evidence is ``page:sentence`` pointers to the first
    of these pages, and with them to all that is needed to find it.
    """
    chain = precedes(pages)
    order = F.array(F.lit("Sequential page order in document"))
    origin = F.array(F.lit("Markdown content directly extracted from document"))
    following = F.col("page_no") + 1
    parts = [
        make_edges(pages, page_node(space), raw_node(space), "derived_from", 1.0, evidence=origin, space=space),
        make_edges(chain, page_node(space), page_node(space, following), "precedes", 1.0, evidence=order, space=space),
        make_edges(chain, raw_node(space), raw_node(space, following), "precedes", 1.0, evidence=order, space=space),
        make_edges(
            key_terms, page_node(space), term_node(space), "contains", 1.0, F.col("significance"), space=space
        ),
    ]
    if relations is not None:
        pointers = F.transform(
            "evidence_at", lambda s: F.concat_ws(":", "doc_id", F.col("page_no").cast("string"), s.cast("string"))
        )
        merged = (
            relations.withColumns({"type": map_relation_type(F.col("type")), "_at": pointers})
            .groupBy("source_key", "target_key", "type")
            .agg(
                F.least(F.sum("strength"), F.lit(1.0)).alias("strength"),
                F.min(F.struct("doc_id", "page_no", F.col("_at").alias("at"))).alias("_first"),
            )
            .withColumn("_at", F.col("_first.at"))
        )
        parts.append(
            make_edges(
                merged, concept_node(space, F.col("source_key")), concept_node(space, F.col("target_key")),
                F.col("type"), F.col("strength"), F.col("strength"), F.col("_at"), space,
            )
        )
    if summaries is not None:
        made = F.array(F.lit("Generated by semantic analysis"))
        parts.append(
            make_edges(
                summaries, summary_node(space), page_node(space), "summarizes", 1.0, F.col("confidence"), made, space
            )
        )
        parts.append(
            make_edges(
                precedes(summaries), summary_node(space), summary_node(space, following), "precedes", 1.0,
                evidence=order, space=space,
            )
        )
    return reduce(DataFrame.unionByName, parts)


# --- types, concepts, ontology ----------------------------------------------------


def map_relation_type(c: Column) -> Column:
    cells = [F.lit(x) for pair in P.RELATION_TYPE_EDGES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*cells), c), F.lit("relates_to"))


def map_relation_text(c: Column) -> Column:
    """``struct(type, reversed)`` of the first keyword in a free-text relation."""
    low = F.lower(c)
    out = F.struct(F.lit("relates_to").alias("type"), F.lit(False).alias("reversed"))
    for word, kind, turned in reversed(P.RELATION_TEXT_EDGES):
        hit = F.struct(F.lit(kind).alias("type"), F.lit(turned).alias("reversed"))
        out = F.when(F.contains(low, F.lit(word)), hit).otherwise(out)
    return out


def normal_name(c: Column) -> Column:
    return F.array_join(X.words(F.lower(c)), " ")


def resolve_concepts(
    mentions: DataFrame, concepts: DataFrame, mode: str = "exact", grams: int = 5
) -> DataFrame:
    """Concept of each distinct mention (``name``): the earliest that matches, or null.

    ``concepts`` is ``concept_id, text, ord``.  ``exact`` compares names without case
    and spacing; ``contains`` accepts a concept whose text has the name as whole words.
    A name is looked up by its first words (up to ``grams``) and then verified, so
    longer names are found as well and nothing is compared with everything.
    """
    names = mentions.select("name").distinct().withColumn("_key", normal_name(F.col("name")))
    known = concepts.select("concept_id", "ord", normal_name(F.col("text")).alias("_text"))
    if mode == "exact":
        first = known.groupBy(F.col("_text").alias("_key")).agg(F.min_by("concept_id", "ord").alias("concept_id"))
        return names.join(first, "_key", "left").select("name", "concept_id")
    ws = F.split("_text", " ")
    starts = F.sequence(F.lit(1), F.size(ws))
    runs = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(grams), F.size(ws) - i + 1)),
                lambda n: F.array_join(F.slice(ws, i, n), " "),
            ),
        )
    )
    keyed = known.filter("_text <> ''").select(
        "concept_id", "ord", "_text", F.explode(F.array_distinct(runs)).alias("_gram")
    )
    anchored = names.withColumn("_gram", F.array_join(F.slice(F.split("_key", " "), 1, grams), " "))

    def padded(c):
        return F.concat(F.lit(" "), F.col(c), F.lit(" "))

    # By the size of their files the runs of millions of concepts pass for a small table; they are never broadcast.
    hits = (
        anchored.filter("_key <> ''")
        .join(keyed.hint("merge"), "_gram")
        .filter(F.contains(padded("_text"), padded("_key")))
        .groupBy("name")
        .agg(F.min_by("concept_id", "ord").alias("concept_id"))
    )
    return names.select("name").join(hits, "name", "left")


def ontology_domain(c: Column, domains: dict = ONTOLOGY_DOMAINS) -> Column:
    low = F.lower(c)
    out = F.lit("general")
    for domain, keywords in reversed(list(domains.items())):
        out = F.when(low.rlike(X.any_of(keywords)), domain).otherwise(out)
    return out


# Category, least confidence (exclusive), derived category, factor, domain.
INFERENCE_RULES = [
    ("algorithm", 0.8, "computational", 0.9, "technical"),
    ("hypothesis", 0.7, "research_question", 0.8, "academic"),
]


def infer_ontology(nodes: DataFrame, rules=INFERENCE_RULES) -> DataFrame:
    """Adds derived tags a node does not have yet.  Stays within the row."""
    ontology = F.col("ontology")
    for category, least, derived, factor, domain in rules:
        cause = F.filter(ontology, lambda t: (t["category"] == category) & (t["confidence"] > least))
        present = F.exists(ontology, lambda t: t["category"] == derived)
        new = ontology_tag(
            F.lit(derived), F.array_max(F.transform(cause, lambda t: t["confidence"])) * factor, F.lit(domain)
        )
        ontology = F.when((F.size(cause) > 0) & ~present, F.concat(ontology, F.array(new))).otherwise(ontology)
    return nodes.withColumn("ontology", ontology)


# --- scores ------------------------------------------------------------------------


def word_set(c: Column) -> Column:
    return F.array_distinct(X.words(F.lower(c)))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        common / (F.size(a) + F.size(b) - common)
    )


def lexical_similarity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds the share of common words of the two ends."""
    sets = nodes.select("id", word_set(F.coalesce("content", F.lit(""))).alias("_w"))
    source = sets.select(F.col("id").alias("source"), F.col("_w").alias("_a"))
    target = sets.select(F.col("id").alias("target"), F.col("_w").alias("_b"))
    empty = F.array().cast("array<string>")
    return (
        edges.join(source, "source", "left")
        .join(target, "target", "left")
        .withColumn("lexical", jaccard(F.coalesce("_a", empty), F.coalesce("_b", empty)))
        .drop("_a", "_b")
    )


def hours_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3.6e9


def recency(touched: Column, as_of: Column, rate: float = 0.1) -> Column:
    """exp(-rate * hours); an edge that was never touched keeps its full weight."""
    return F.coalesce(F.exp(-F.lit(rate) * hours_between(touched, as_of)), F.lit(1.0))


def edge_score(lexical: Column, semantic: Column, recent: Column) -> Column:
    return F.least(lexical * (F.lit(1.0) + semantic) * recent, F.lit(1.0))


def score_edges(edges: DataFrame, nodes: DataFrame, semantic: Column | float = 0.0) -> DataFrame:
    """Strength of new edges from the words of their ends."""
    s = semantic if isinstance(semantic, Column) else F.lit(semantic)
    return (
        lexical_similarity(edges, nodes)
        .withColumn("strength", edge_score(F.col("lexical"), s, F.lit(1.0)))
        .drop("lexical")
    )


def decay_edges(edges: DataFrame, as_of: Column, rate: float = 0.1) -> DataFrame:
    return edges.withColumn("strength", F.col("strength") * recency(F.col("ts"), as_of, rate))


def update_scores(
    edges: DataFrame, nodes: DataFrame, updates: DataFrame, as_of: Column, rate: float = 0.1
) -> DataFrame:
    """New confidence, strength and time of the edges in ``updates`` (id, confidence, boost)."""
    new = updates.select("id", F.col("confidence").alias("_c"), F.col("boost").alias("_boost"))
    touched = lexical_similarity(edges.join(new, "id"), nodes)
    touched = touched.select(
        *[c for c in EDGE_COLUMNS if c not in ("strength", "confidence", "ts")],
        edge_score(F.col("lexical"), F.col("_boost"), recency(F.col("ts"), as_of, rate)).alias("strength"),
        F.col("_c").alias("confidence"),
        as_of.cast("timestamp").alias("ts"),
    )
    return edges.join(new.select("id"), "id", "left_anti").unionByName(touched)


def score_edges_by_type(edges: DataFrame, step: int, threshold: float = 0.3) -> DataFrame:
    """Score by type and age in steps: ``base_score, is_semantic, created_step, type``."""
    cells = [F.lit(x) for pair in P.RELATION_DECAY.items() for x in pair]
    decay = F.coalesce(F.try_element_at(F.create_map(*cells), F.col("type")), F.lit(0.1))
    age = F.lit(step) - F.col("created_step")
    fade = F.when(age == 0, 1.0).otherwise(F.pow(F.lit(0.9), age) * (1 - decay * age))
    raw = F.col("base_score") * F.when(F.col("is_semantic"), 1.5).otherwise(1.0) * fade
    return edges.withColumn("score", F.when(raw < threshold, 0.0).otherwise(F.least(raw, F.lit(1.0))))


def upsert_edges(base: DataFrame, new: DataFrame) -> DataFrame:
    """Union by id; the later row wins, a new row over an old one of the same time."""
    both = base.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    row = F.struct(*[c for c in EDGE_COLUMNS if c != "id"])
    return (
        both.groupBy("id")
        .agg(F.max_by(row, F.struct(F.coalesce("ts", F.lit(0).cast("timestamp")), "_seq", "strength")).alias("r"))
        .select("id", "r.*")
    )


def update_summaries(nodes: DataFrame, summaries: DataFrame, as_of: Column) -> DataFrame:
    """Sets summary and its time for the nodes in ``summaries`` (id, summary)."""
    new = summaries.select("id", F.col("summary").alias("_new"))
    fresh = F.col("_new").isNotNull()
    return (
        nodes.join(new, "id", "left")
        .withColumns(
            {
                "content_summary": F.coalesce("_new", "content_summary"),
                "summary_ts": F.when(fresh, as_of.cast("timestamp")).otherwise(F.col("summary_ts")),
            }
        )
        .drop("_new")
    )


def link_documents(pairs: DataFrame, kind: str = "related_to", strength: float = 0.7,
                   space: str = Settings.domain) -> DataFrame:
    """Edges between documents given as ``source, target`` node ids."""
    return make_edges(pairs, F.col("source"), F.col("target"), kind, strength, space=space)


def one_per_id(edges: DataFrame) -> DataFrame:
    """Of edges with one id the greatest by all its columns, so that every run keeps the same."""
    best = edges.groupBy("id").agg(F.max(F.struct(*[c for c in edges.columns if c != "id"])).alias("_best"))
    return best.select("id", "_best.*").select(*edges.columns)


def add_inverse_edges(edges: DataFrame) -> DataFrame:
    """Adds the inverse of every edge whose type has one; an edge already there stays."""
    cells = [F.lit(x) for pair in P.INVERSE_TYPES.items() for x in pair]
    inverse = F.try_element_at(F.create_map(*cells), F.col("type"))
    turned = edges.withColumn("_inv", inverse).filter("_inv is not null").select(
        edge_id(F.col("target"), F.col("source"), F.col("_inv")).alias("id"),
        F.col("target").alias("source"),
        F.col("source").alias("target"),
        F.col("_inv").alias("type"),
        *[c for c in EDGE_COLUMNS if c not in ("id", "source", "target", "type")],
    )
    return edges.select(*EDGE_COLUMNS).unionByName(one_per_id(turned.join(edges.select("id"), "id", "left_anti")))


# --- enrichment ----------------------------------------------------------------------


def apply_enrichment(pages: DataFrame, enrichments: DataFrame, keep: int | None = None) -> DataFrame:
    """Page text, or its first ``keep`` characters, below its summary, and the key concepts of the page."""
    new = enrichments.select(*PAGE, "summary", "key_concepts")
    content = F.when(
        F.coalesce("summary", F.lit("")) != "",
        F.concat(
            F.lit("# Semantic Summary\n\n"), "summary", F.lit("\n\n# Original Content\n\n"),
            F.col("text") if keep is None else F.left("text", F.lit(keep)),
        ),
    ).otherwise(F.col("text"))
    return pages.join(new, PAGE, "left").withColumn("content", content)


def enrich_sections(sections: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Section text replaced by the summaries of its pages, where there are any."""
    summaries = enrichments.filter("summary <> ''").select(*PAGE, "summary")
    found = (
        sections.select("doc_id", "seq", "part", F.explode("pages").alias("page_no"))
        .join(summaries, PAGE)
        .groupBy("doc_id", "seq", "part")
        .agg(F.array_sort(F.collect_list(F.struct("page_no", "summary"))).alias("_rows"))
    )
    body = F.array_join(F.transform("_rows", lambda r: r["summary"]), "\n\n")
    return (
        sections.join(found, ["doc_id", "seq", "part"], "left")
        .withColumn(
            "content",
            F.when(
                F.col("_rows").isNotNull(), F.concat(F.lit("## "), "title", F.lit("\n\n"), body)
            ).otherwise(F.col("content")),
        )
        .drop("_rows")
    )


def enrichment_relations(enrichments: DataFrame, space: str = Settings.domain) -> DataFrame:
    """One row per relation of a page with its edge type and the concept it points to."""
    rows = enrichments.select(
        *PAGE, "summary", "confidence", F.explode("relationships").alias("r")
    ).withColumn("m", map_relation_text(F.col("r.relation")))
    return rows.select(
        *PAGE, "summary", "confidence", F.col("r.target").alias("name"),
        F.col("m.type").alias("type"), F.col("m.reversed").alias("reversed"),
        concept_node(space, F.md5(normal_name(F.col("r.target")))).alias("new_id"),
        page_node(space).alias("page_id"),
    )


def enrichment_edges(
    enrichments: DataFrame, concepts: DataFrame, pages: DataFrame, space: str = Settings.domain
) -> tuple[DataFrame, DataFrame]:
    """Concept nodes that are new and edges from pages to concepts, semantic strength 1."""
    relations = enrichment_relations(enrichments, space)
    resolved = resolve_concepts(relations, concepts).withColumnRenamed("concept_id", "known_id")
    rows = relations.join(resolved, "name").withColumn("target_id", F.coalesce("known_id", "new_id"))
    fresh = (
        rows.filter("known_id is null")
        .groupBy("new_id")
        .agg(F.min("name").alias("name"), F.max("confidence").alias("confidence"))
        .withColumn("doc_id", F.lit(None).cast("string"))
    )
    nodes = _nodes(
        fresh, space, "concept", F.lit(""), id=F.col("new_id"), content=F.col("name"),
        confidence=F.col("confidence") * 0.8,
    )
    texts = pages.select(*PAGE, word_set(F.col("text")).alias("_a"))
    scored = rows.join(texts, PAGE).withColumn(
        "lexical", jaccard(F.col("_a"), word_set(F.col("name")))
    )
    first = F.when(F.col("reversed"), F.col("target_id")).otherwise(F.col("page_id"))
    second = F.when(F.col("reversed"), F.col("page_id")).otherwise(F.col("target_id"))
    edges = make_edges(
        scored, first, second, F.col("type"), edge_score(F.col("lexical"), F.lit(1.0), F.lit(1.0)),
        F.col("confidence"), F.array("summary"), space,
    )
    return nodes, edges.dropDuplicates(["id"])


# --- similar nodes ---------------------------------------------------------------------


#: Words with more than this share of all (set, word) rows are ordered by their frequency, so at most its inverse of them are.
FREQUENT = 1 / 500_000
#: Words that two sets have to share at the start of their orders before they are compared.
SHARED = 6
#: Sets that are compared in one task, about.
CELL = 2048


def similar_edges(nodes: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``source, target, similarity`` of nodes whose word sets are alike (Jaccard).

    Nodes with the same word set are linked to the first of them, not to each other,
    and stand as one in the comparison.  The words of each set are put in one order, rare
    ones about first: any order common to all sets gives the same pairs.  A pair at or above
    the threshold shares ``ceil(t / (1 + t) * (na + nb))`` words, so the first ``SHARED`` of
    them (all, if fewer) lie among the first ``n - ceil(t * n) + SHARED`` of the larger set and
    ``n - ceil(2 * t / (1 + t) * n) + SHARED`` of the smaller, where enough words follow.  Only
    pairs with that many are compared, so no pair is missed.

    Up to the comparison words and sets go by 32-bit names; equal names of different words or
    sets only add pairs to be compared.  Sets are compared by their words, in cells of pairs that
    have most of their sets in common, and each cell gets the words of a set once.
    """
    sets = nodes.filter("id IS NOT NULL").select("id", F.array_join(F.array_sort(word_set(F.col("content"))), " ").alias("w")).filter("w <> ''")
    keyed = _kept(sets.withColumn("set_key", F.md5("w")), "word_sets")
    firsts = keyed.groupBy("set_key").agg(F.min(F.struct("id", "w")).alias("f"))
    firsts = _kept(firsts.select(F.hash("set_key").alias("k"), F.col("f.id").alias("id"), "f.w"), "first_sets")
    ids = keyed.groupBy("set_key").agg(F.min("id").alias("first"))
    copies = (
        keyed.select("id", "set_key")
        .join(ids, "set_key")
        .filter("id <> first")
        .select(F.col("first").alias("source"), F.col("id").alias("target"), F.lit(1.0).alias("similarity"))
    )
    found = _compared(firsts, _pairs_to_compare(firsts, threshold), threshold)
    verified = found.filter("a <> b").select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), "similarity")
    return copies.unionByName(verified)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Rows in files next to the checkpoints."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _pairs_to_compare(firsts: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: names of sets that share enough of their first words, each pair once, in one order."""
    hashes = firsts.select("k", F.transform(F.split("w", " "), lambda x: F.hash(x)).alias("h"))
    counted = hashes.select(F.explode("h").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    frequent = counted.filter(F.col("df") > counted.agg(F.sum("df")).scalar() * F.lit(FREQUENT)).toArrow()  # at most 1 / FREQUENT rows
    rows = hashes.mapInArrow(_first_words(frequent["word"].to_numpy(), frequent["df"].to_numpy(), threshold), "word INT, k INT, n INT, pos INT")
    a, b = (rows.select("word", *[F.col(c).alias(f"{c[0]}{x}") for c in ("k", "n", "pos")]) for x in "ab")
    # Length filter, and the most words the two can still share from here on.
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + SHARED
    wanted = F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9
    early = F.col("pa") <= F.col("na") - F.ceil(F.col("na") * (2 * threshold / (1 + threshold)) - 1e-9) + SHARED
    first = (F.col("ka") != F.col("kb")) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("ka") < F.col("kb"))))
    # All in one condition on both sides, so that they read the same shuffled rows.
    meet = F.when(first, early & (F.col("na") >= threshold * F.col("nb") - 1e-9) & (reach >= wanted)).otherwise(False)
    both = F.shiftleft(F.least("ka", "kb").cast("bigint"), 32).bitwiseOR(F.greatest("ka", "kb").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    pairs = (
        a.join(b, "word")
        .filter(meet)
        .groupBy(both.alias("p"))
        .agg(F.count("*").alias("shared"), F.min(F.least(F.ceil(wanted), F.lit(SHARED)).cast("int")).alias("needed"))
        .filter("shared >= needed")
        .select(F.shiftright("p", 32).cast("int").alias("a"), F.shiftright(F.shiftleft("p", 32), 32).cast("int").alias("b"))
    )
    twins = firsts.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("k").alias("a"), F.col("k").alias("b"))
    return cut(pairs.unionByName(twins))


def _first_words(frequent: np.ndarray, df: np.ndarray, threshold: float):
    """``word, k, n, pos`` of the first words of each set, in order of (frequency, word)."""
    order = np.argsort(frequent)
    frequent, df = np.append(frequent[order], 0), np.append(df[order], 0)

    def first(batches):
        for batch in batches:
            k, h = batch.column(0).to_numpy(), batch.column(1)
            word, n = h.flatten().to_numpy(), np.diff(h.offsets.to_numpy())
            row = np.repeat(np.arange(len(k)), n)
            at = np.searchsorted(frequent[:-1], word)
            word = word[np.lexsort((word, np.where(frequent[at] == word, df[at], 0), row))]
            pos = np.arange(1, len(word) + 1) - np.repeat(np.cumsum(n) - n, n)
            kept = pos <= (n - np.ceil(n * threshold - 1e-9) + SHARED)[row]
            yield pa.RecordBatch.from_pydict({"word": word[kept], "k": k[row[kept]], "n": n[row[kept]], "pos": pos[kept].astype(np.int32)})

    return first


def _compared(firsts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` of the pairs of names that belong to sets which are alike.

    A set is at home with the least of its partners, so sets that are all alike have one home.
    A cell holds the pairs of some homes, or a part of the pairs of a large one.
    """
    homes = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    homes = cut(homes.groupBy(F.col("x.a").alias("b")).agg(F.least(F.min("x.b"), F.col("x.a")).alias("home")))
    cells = max(1, -(-homes.count() // CELL))
    placed = pairs.join(homes, "b")
    parts = F.ceil(F.sqrt(2 * F.count("*")) / CELL).alias("parts")
    large = placed.groupBy("home").agg(parts).filter("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    cell = F.when(parts > 1, F.col("home")).otherwise(F.pmod("home", F.lit(cells)))
    placed = placed.join(large, "home", "left").select(
        cell.alias("cell"), F.pmod("a", parts).alias("i"), F.pmod("b", parts).alias("j"), (parts > 1).alias("large"), "a", "b")
    by = ["cell", "i", "j", "large"]
    members = placed.select(*[F.col(c).alias(f"of_{c}") for c in by], F.explode(F.array("a", "b")).alias("k")).distinct()
    id_type = firsts.schema["id"].dataType.simpleString()
    return members.join(firsts, "k").groupBy(*[f"of_{c}" for c in by]).cogroup(placed.groupBy(*by)).applyInArrow(
        _alike(threshold), f"a {id_type}, b {id_type}, similarity DOUBLE")


def _alike(threshold: float):
    def ramp(n: np.ndarray) -> np.ndarray:
        """0, 1, ... for each of the lengths."""
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def alike(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        sets = sets.sort_by("k").combine_chunks()
        words = pc.split_pattern(sets["w"], " ").combine_chunks()
        code = words.flatten().dictionary_encode().indices.to_numpy()
        names, ends = sets["k"].to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()
        n, out = np.diff(ends), []
        seen = np.zeros(code.max(initial=-1) + 1, bool)
        pairs = pairs.sort_by("a")
        different, at = np.unique(pairs["a"].to_numpy(), return_index=True)
        for name, some in zip(different, np.split(pairs["b"].to_numpy(), at[1:]), strict=True):
            # A name may have several sets.
            lo, hi = np.searchsorted(names, some), np.searchsorted(names, some, "right")
            others = np.repeat(lo, hi - lo) + ramp(hi - lo)
            for x in range(np.searchsorted(names, name), np.searchsorted(names, name, "right")):
                y = others[(names[others] != name) | (others > x)]
                seen[code[ends[x] : ends[x + 1]]] = True
                hits = seen[code[np.repeat(ends[y], n[y]) + ramp(n[y])]]
                seen[code[ends[x] : ends[x + 1]]] = False
                common = np.diff(np.append(0, np.cumsum(hits))[np.append(0, np.cumsum(n[y]))])
                share = common / (n[x] + n[y] - common)
                out.append((np.full(len(y), x)[share >= threshold], y[share >= threshold], share[share >= threshold]))
        x, y, share = (np.concatenate([o[i] for o in out] or [[]]) for i in range(3))
        return pa.table({"a": sets["id"].take(pa.array(x, pa.int64())), "b": sets["id"].take(pa.array(y, pa.int64())), "similarity": share})

    return alike
