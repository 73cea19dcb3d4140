"""From pages to a stored graph, as one plan over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.config import Settings
from leafgraph.functions.durable import cut
from leafgraph.operators import graph, shape, structure
from leafgraph.sources.store import load_graph, save_graph, stored_domain


def page_documents(pages: DataFrame) -> DataFrame:
    """Attributes of documents of which nothing but the pages is known."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages")).select(
        "doc_id", F.col("doc_id").alias("filename"), F.col("doc_id").alias("title"),
        F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("subject"), "pages",
    )


def sections_of(pages: DataFrame, outline: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """Sections by outline or detected contents; pages in none of them by their headings."""
    sources = [structure.detect_toc(pages, settings.page_offset)]
    if outline is not None:
        sources.insert(0, structure.outline_toc(outline))
    # The entries are few next to the pages and used three times: found once, kept.
    toc = cut(structure.toc_tree(cut(structure.resolve_toc(sources)), settings.entries_per_block))
    columns = ["doc_id", "seq", "section_id", "part", "title", "level", "path", "pages", "content"]
    by_toc = structure.toc_sections(toc, pages, settings.entries_per_block, settings.pages_per_part)
    rest = structure.uncovered_pages(pages, toc, settings.entries_per_block, settings.pages_per_part)
    by_heading = structure.pattern_sections(
        shape.lines(rest.select("doc_id", "page_no", "text")), settings.pages_per_block, settings.pages_per_part
    )
    # Entries of a contents page count from 0 up; sections by heading from -1 down.
    by_heading = by_heading.withColumns({"seq": -F.col("seq"), "path": F.col("title")})
    return by_toc.select(*columns).unionByName(by_heading.select(*columns))


def graph_of(
    pages: DataFrame, documents: DataFrame | None = None, sections: DataFrame | None = None,
    enrichments: DataFrame | None = None, domain: str = Settings.domain, now: Column | None = None,
    settings: Settings = Settings(),
) -> dict[str, DataFrame]:
    """Nodes, edges, tags and the domain of a corpus of pages."""
    at = F.lit(None).cast("timestamp") if now is None else now.cast("timestamp")
    pages = pages.select("doc_id", "page_no", "text").withColumn("ts", at)
    documents = (page_documents(pages) if documents is None else documents).withColumn("ts", at)
    if sections is None:
        sections = sections_of(pages.drop("ts"), settings=settings)
    sections = sections.withColumn("ts", at)
    least = settings.min_content_length
    nodes = graph.build_nodes(documents, pages, sections, domain, least)
    edges = graph.structural_edges(pages, sections, domain, least).withColumn("ts", at)
    tags = graph.build_tags(documents, pages, sections, enrichments, domain, settings.tag_prefix, least)
    return {"nodes": nodes, "edges": edges, "tags": tags}


def rebuild(
    spark: SparkSession, pages: DataFrame, path: str, domain: str = Settings.domain,
    now: Column | None = None, settings: Settings = Settings(), sections: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Build the graph of stored pages anew and replace the domain in the store.

    Ids depend on the content only, so a second run writes the same rows.  Sections go
    into nodes, edges and tags; they are worked out once, those that are given by the caller
    (``cut`` keeps them).  A domain that is stored keeps its name, description and time of
    creation.
    """
    pages = pages.select("doc_id", "page_no", "text")
    sections = cut(sections_of(pages, settings=settings)) if sections is None else sections
    built = graph_of(pages, sections=sections, domain=domain, now=now, settings=settings)
    at = F.current_timestamp() if now is None else now.cast("timestamp")
    old = stored_domain(spark, path, domain)
    name, description = (old["name"], old["description"]) if old else (domain, "")
    created = F.lit(old["created"]).cast("timestamp") if old else at
    built["domains"] = spark.range(1).select(
        F.lit(domain).alias("id"), F.lit(name).alias("name"), F.lit(description).alias("description"),
        created.alias("created"), at.alias("last_access"),
    )
    built["domain_refs"] = spark.createDataFrame(
        [], "node_id STRING, domain STRING, target_domain STRING, target_node_id STRING, "
        "description STRING, bidirectional BOOLEAN",
    )
    save_graph(built, path, [domain])
    return load_graph(spark, path)
