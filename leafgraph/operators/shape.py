"""Pages and lines: splitting, selecting, measuring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.functions import patterns as P
from leafgraph.functions import text as X


def lines(pages: DataFrame) -> DataFrame:
    """Trimmed, non-blank lines with their position on the page."""
    keep = [c for c in pages.columns if c != "text"]
    return (
        pages.select(*keep, F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
        .select(*keep, "pos", X.clean(F.col("raw")).alias("line"))
        .filter("line <> ''")
    )


def chunk_pages(docs: DataFrame, n: int) -> DataFrame:
    """Cut each text into ``n`` pages of equal line count; the last takes the rest."""
    rows = F.split("text", "\n")
    size = F.greatest(F.lit(1), F.floor(F.size(rows) / n)).cast("int")
    chunks = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.array_join(
            F.slice(
                F.col("rows"),
                i * F.col("size") + 1,
                F.when(i == n - 1, F.size("rows")).otherwise(F.col("size")),
            ),
            "\n",
        ),
    )
    return (
        docs.select("doc_id", rows.alias("rows"), size.alias("size"))
        .select("doc_id", F.posexplode(chunks).alias("page_no", "text"))
    )


def split_on_markers(docs: DataFrame, n: int) -> DataFrame:
    """Split at ``Page k`` lines (page k-1, marker kept); texts without one fall back to chunks."""
    marked = F.col("text").rlike(P.PAGE_MARKER)
    # Cut before each marker; lines end at a line feed only, as in P.PAGE_MARKER elsewhere.
    segments = F.filter(F.split("text", r"(?md)(?=^Page \d)"), lambda s: s.rlike(r"^Page \d+"))
    by_marker = docs.filter(marked).select("doc_id", F.explode(segments).alias("segment")).select(
        "doc_id",
        (F.regexp_extract("segment", r"^Page (\d+)", 1).try_cast("int") - 1).alias("page_no"),
        F.when(F.col("segment").endswith("\n"), F.left("segment", F.length("segment") - 1))
        .otherwise(F.col("segment")).alias("text"),
    )
    return by_marker.unionByName(chunk_pages(docs.filter(~marked), n))


def page_predicate(spec: str) -> Column:
    """``"0,2-5,10"`` as one predicate that reaches the scan."""
    out = F.lit(False)
    for part in spec.split(","):
        if "-" in part:
            low, high = (int(x) for x in part.split("-"))
            out = out | F.col("page_no").between(low, high)
        else:
            out = out | (F.col("page_no") == int(part))
    return out


def select_pages(pages: DataFrame, spec: str) -> DataFrame:
    return pages.filter(page_predicate(spec))


def limit_pages(pages: DataFrame, n: int) -> DataFrame:
    return pages.filter(F.col("page_no") < n)


def admit(pages: DataFrame, min_length: int = 50) -> DataFrame:
    """Pages long enough to become a node."""
    return pages.filter(F.length(X.clean(F.col("text"))) >= min_length)


def markdown_pages(pages: DataFrame) -> DataFrame:
    """Marked-up pages (``html``) as pages of markdown text."""
    keep = [c for c in pages.columns if c != "html"]
    return pages.select(*keep, X.html_to_markdown(F.col("html")).alias("text"))


def page_markdown(pages: DataFrame) -> DataFrame:
    return pages.select(
        "doc_id",
        "page_no",
        F.concat(F.lit("# Page "), (F.col("page_no") + 1).cast("string"), F.lit("\n\n"), "text").alias(
            "markdown"
        ),
    )


def page_stats(pages: DataFrame) -> DataFrame:
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n")))
    open_end = (F.col("text") != "") & ~F.endswith("text", F.lit("\n"))
    return pages.select(
        "doc_id",
        "page_no",
        F.length("text").cast("bigint").alias("chars"),
        X.word_count(F.col("text")).cast("bigint").alias("words"),
        (newlines + open_end.cast("int")).cast("bigint").alias("lines"),
        F.split("text", "\n", 2)[0].alias("first_line"),
    )


def content_stats(pages: DataFrame) -> DataFrame:
    """Characters, words and lines per document."""
    return page_stats(pages).groupBy("doc_id").agg(
        F.sum("chars").alias("chars"),
        F.sum("words").alias("words"),
        F.sum("lines").alias("lines"),
        F.count("*").alias("pages"),
    )


def document_text(documents: DataFrame, pages: DataFrame, excerpt: int = 500) -> DataFrame:
    """Text of the document root: its attributes and the start of page 0."""
    first = pages.filter("page_no = 0").select(
        "doc_id",
        X.clean(F.left("text", F.lit(excerpt))).alias("_excerpt"),
        (F.length("text") > excerpt).alias("_cut"),
        (F.col("text") != "").alias("_any"),
    )
    has_page = F.coalesce("_any", F.lit(False))
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("Document: "), F.coalesce("title", F.lit("Untitled"))),
        F.concat(F.lit("Author: "), F.nullif("author", F.lit(""))),
        F.concat(F.lit("Subject: "), F.nullif("subject", F.lit(""))),
        F.concat(F.lit("Pages: "), F.col("pages").cast("string")),
        F.lit(""),
        F.when(has_page, F.lit("First page excerpt:")),
        F.when(has_page, F.col("_excerpt")),
        F.when(has_page & F.col("_cut"), F.lit("...")),
    )
    return documents.join(first, "doc_id", "left").withColumn("content", content).drop(
        "_excerpt", "_cut", "_any"
    )


class Pipeline:
    """Named steps from DataFrame to DataFrame; an error names its step."""

    def __init__(self):
        self._steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []

    def add(self, step: Callable[[DataFrame], DataFrame], name: str | None = None) -> Pipeline:
        self._steps.append((name or step.__name__, step))
        return self

    def run(self, df: DataFrame) -> DataFrame:
        for name, step in self._steps:
            try:
                df = df.transform(step)
            except (PySparkException, AssertionError, ValueError, TypeError) as e:
                raise RuntimeError(f"step '{name}' failed: {e}") from e
        return df
