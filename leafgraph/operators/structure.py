"""Document structure: tables of contents, headings, sections.

A table of contents is a table of entries ``doc_id, seq, number, title, page, level,
raw_text, format``; ``seq`` orders the entries of a document and is unique in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.functions import patterns as P
from leafgraph.functions import text as X
from leafgraph.functions.ids import short_hash
from leafgraph.operators.ordered import attach, fold_before, next_after, running_sum

# Lines of one page are numbered below this; the page is above it.
SEQ_PAGE = 1 << 32


def line_seq() -> Column:
    """Order of a line in its document as one number."""
    return F.col("page_no").cast("bigint") * F.lit(SEQ_PAGE) + F.col("pos").cast("bigint")


# --- finding and parsing a table of contents ---------------------------------


def is_toc_page(c: Column) -> Column:
    hits = (
        F.regexp_count(c, F.lit(P.LINE_END_NUMBER))
        + F.regexp_count(c, F.lit(P.DOTS_NUMBER))
        + F.regexp_count(c, F.lit(P.TAB_NUMBER))
    )
    return F.lower(c).rlike(X.any_of(P.TOC_INDICATORS)) & (hits >= 3)


def toc_pages(pages: DataFrame) -> DataFrame:
    """First contents page of each document and all that continue it."""
    first = (
        pages.filter(is_toc_page(F.col("text")))
        .groupBy("doc_id")
        .agg(F.min_by(F.struct("page_no", "text"), "page_no").alias("p"))
        .select("doc_id", F.col("p.page_no").alias("page_no"), F.col("p.text").alias("text"))
    )
    last_line = F.lower(F.element_at(F.split(X.clean(F.col("text")), "\n"), -1))
    goes_on = F.contains(last_line, F.lit("continued")) | F.contains(last_line, F.lit("cont."))
    begun = first.filter(goes_on).select("doc_id", F.col("page_no").alias("first_no"))
    later = attach(pages.select("doc_id", "page_no", "text"), begun, "doc_id", "page_no").filter("page_no > first_no")
    # The run ends at the first page that fails the test; a missing page does not end it.
    fails = F.regexp_count("text", F.lit(P.LINE_END_NUMBER)) < 3
    stops = later.filter(fails).groupBy("doc_id").agg(F.min("page_no").alias("stop"))
    more = (
        attach(later, stops, "doc_id", "page_no", "left")
        .filter(F.col("stop").isNull() | (F.col("page_no") < F.col("stop")))
        .select("doc_id", "page_no", "text")
    )
    return first.unionByName(more)


def toc_format(lines: DataFrame) -> DataFrame:
    """Format of each document by the score of its lines; ties go in this order."""
    line = F.col("line")
    dots = F.sum(line.rlike(P.DOT_LEADER).cast("int"))
    tabs = F.sum(F.contains(line, F.lit("\t")).cast("int"))
    numbered = F.sum(line.rlike(P.NUMBERED_START).cast("int"))
    scores = lines.groupBy("doc_id").agg(dots.alias("d"), tabs.alias("t"), numbered.alias("n"))
    return scores.select(
        "doc_id",
        F.expr(
            "case when greatest(d, t, n) = 0 then 'unknown' when d >= t and d >= n then 'dot_leader' "
            "when t >= n then 'tab_separated' else 'numbered' end"
        ).alias("format"),
    )


def toc_level(number: Column) -> Column:
    """Dots of the section number plus one; a trailing dot does not count."""
    n = F.regexp_replace(number, r"\.$", "")
    return (F.length(n) - F.length(F.replace(n, F.lit("."))) + 1).cast("int")


def _groups(pattern: str, number: int, title: int, page: int) -> Column:
    def group(i):
        return F.regexp_extract("line", pattern, i) if i else F.lit("")

    return F.when(
        F.col("line").rlike(pattern),
        F.struct(
            group(number).alias("number"),
            X.clean(group(title)).alias("title"),
            group(page).alias("page"),
        ),
    )


def parse_toc(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """Entries of the lines (``doc_id, seq, line``) under the format of their document."""
    rest = X.clean(F.regexp_replace("line", P.TRAILING_NUMBER, ""))
    numbered_rest = rest.rlike(P.LEADING_NUMBER)
    generic = F.when(
        F.col("line").rlike(P.TRAILING_NUMBER),
        F.struct(
            F.when(numbered_rest, F.regexp_extract(rest, P.LEADING_NUMBER, 1)).otherwise("").alias("number"),
            X.clean(F.regexp_replace(rest, P.LEADING_NUMBER, "")).alias("title"),
            F.regexp_extract("line", P.TRAILING_NUMBER, 1).alias("page"),
        ),
    )
    entry = (
        F.when(F.col("format") == "dot_leader", _groups(P.DOT_ENTRY, 1, 2, 3))
        .when(
            F.col("format") == "tab_separated",
            F.coalesce(_groups(P.TAB_ENTRY_3, 1, 2, 3), _groups(P.TAB_ENTRY_2, 0, 1, 2)),
        )
        .when(F.col("format") == "numbered", _groups(P.NUMBERED_ENTRY, 1, 2, 3))
        .otherwise(generic)
    )
    return (
        attach(lines, formats, "doc_id", "seq")
        .withColumn("e", entry)
        .select(
            "doc_id",
            F.col("seq").cast("bigint").alias("seq"),
            "e.number",
            "e.title",
            F.col("e.page").try_cast("int").alias("page"),
            F.col("line").alias("raw_text"),
            "format",
        )
        .filter("page is not null")
        .withColumn("level", toc_level(F.col("number")))
    )


def detect_toc(pages: DataFrame, offset: int = 0) -> DataFrame:
    """Contents pages, their format and their entries in one go."""
    from leafgraph.operators.shape import lines as split_lines

    found = split_lines(toc_pages(pages)).select("doc_id", line_seq().alias("seq"), "line")
    entries = parse_toc(found, toc_format(found))
    return entries.withColumn("page", F.col("page") + offset)


def outline_toc(outline: DataFrame) -> DataFrame:
    """Entries of an outline (level, title, 1-based page)."""
    return outline.select(
        "doc_id",
        F.col("seq").cast("bigint").alias("seq"),
        F.lit("").alias("number"),
        "title",
        (F.col("page") - 1).alias("page"),
        "level",
        F.col("title").alias("raw_text"),
        F.lit("unknown").alias("format"),
    )


# --- hierarchy ----------------------------------------------------------------


OPEN = "array<struct<seq:bigint,level:bigint,title:string>>"


def _merge_open(before: Column, after: Column) -> Column:
    """Open entries of two stretches of a table of contents, one after the other.

    The first open entry of a stretch has its smallest level, so it closes all entries
    of that level or a larger one before it.
    """
    kept = F.filter(before, lambda e: e["level"] < F.element_at(after, 1)["level"])
    return F.when(F.size(after) == 0, before).otherwise(F.concat(kept, after))


def _with_open(toc: DataFrame, block: int) -> DataFrame:
    """Adds ``_open``: the ancestors of each entry from the root down.

    A stretch of entries is known by its open ones (those without a later entry of the
    same or a smaller level), which merge associatively: the number of levels costs no
    columns, and nothing about the data is asked beforehand.
    """
    entry = F.struct(F.col("seq").alias("seq"), F.col("level").alias("level"), F.col("title").alias("title"))
    own = F.filter(F.array(entry), lambda e: e["level"].isNotNull())
    sizes = (block, block << 12, block << 32)
    out = fold_before(toc, ["doc_id"], "seq", own, _merge_open, OPEN, "_open", sizes)
    return out.withColumn("_open", F.filter("_open", lambda e: e["level"] < F.col("level")))


def toc_tree(toc: DataFrame, block: int = 1024) -> DataFrame:
    """Adds ``parent_seq``, the nearest earlier entry of a smaller level, and ``path``.

    An entry without a level is a root and no one's parent.  Blocks are ``block``
    numbers of ``seq`` wide.
    """
    tree = _with_open(toc, block)
    return tree.withColumns(
        {
            "parent_seq": F.try_element_at("_open", F.lit(-1))["seq"],
            "path": F.array_join(F.concat(F.transform("_open", lambda e: e["title"]), F.array("title")), "/"),
        }
    ).drop("_open")


def toc_parents(toc: DataFrame, **kw) -> DataFrame:
    return toc_tree(toc, **kw).drop("path")


def toc_text(toc: DataFrame, per_part: int = 4096) -> DataFrame:
    """Indented text of a table of contents, one row per ``per_part`` of its sequence.

    ``toc`` has ``depth`` (0 for a root); parts of a document join in order.
    """
    line = F.concat(
        F.repeat(F.lit("  "), F.col("depth")), "number", F.lit(" "), "title", F.lit(" (p."),
        F.col("page").cast("string"), F.lit(")"),
    )
    return (
        toc.withColumn("part", F.floor(F.col("seq") / per_part).cast("bigint"))
        .groupBy("doc_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("rows"))
        .select("doc_id", "part", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))
    )


def with_depth(toc: DataFrame, block: int = 1024) -> DataFrame:
    """Adds ``depth`` and ``parent_seq``: depth in the tree is the number of open ancestors."""
    return _with_open(toc, block).withColumns(
        {"depth": F.size("_open"), "parent_seq": F.try_element_at("_open", F.lit(-1))["seq"]}
    ).drop("_open")


def toc_page_map(toc: DataFrame) -> DataFrame:
    """Per page the first entry that starts there and the last one (which wins the map)."""
    entry = F.struct(
        F.when(F.col("number") != "", F.col("number")).otherwise(F.col("title")).alias("section"),
        F.col("title").alias("title"),
        F.col("level").alias("level"),
        F.col("path").alias("path"),
    )
    picked = toc.groupBy("doc_id", "page").agg(
        F.min_by("title", "seq").alias("first_title"), F.max_by(entry, "seq").alias("e")
    )
    return picked.select("doc_id", "page", "first_title", "e.*")


def orphan_pages(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """Pages on which no entry starts."""
    starts = toc.select("doc_id", F.col("page").alias("page_no"))
    return pages.select("doc_id", "page_no").join(starts, ["doc_id", "page_no"], "left_anti")


def toc_confidence(toc: DataFrame, documents: DataFrame) -> DataFrame:
    scored = toc.groupBy("doc_id").agg(
        F.bool_and(F.col("page") >= 0).alias("a"),
        F.bool_or(F.col("level") > 1).alias("b"),
        F.bool_or(F.col("number") != "").alias("c"),
        (F.count("*") >= 5).alias("d"),
        F.bool_or(F.col("format") != "unknown").alias("e"),
    )
    score = F.expr(
        "least(1.0D, if(a, 0.3D, 0D) + if(b, 0.3D, 0D) + if(c, 0.2D, 0D) + if(d, 0.2D, 0D) "
        "+ if(e, 0.1D, 0D))"
    )
    return documents.select("doc_id").join(
        scored.select("doc_id", score.alias("s")), "doc_id", "left"
    ).select("doc_id", F.coalesce("s", F.lit(0.0)).alias("confidence"))


def resolve_toc(sources: list[DataFrame]) -> DataFrame:
    """Entries of the first source, in order of preference, that has any for a document."""
    columns = ["doc_id", "seq", "number", "title", "page", "level", "raw_text", "format"]
    ranked = [
        s.select(*columns, F.lit(i).alias("source_rank")) for i, s in enumerate(sources, start=1)
    ]
    union = reduce(DataFrame.unionByName, ranked)
    best = union.groupBy("doc_id").agg(F.min("source_rank").alias("source_rank"))
    # A long document is joined by many tasks.
    best = best.withColumnRenamed("source_rank", "_best")
    return attach(union, best, "doc_id", "seq").filter("source_rank = _best").drop("_best")


# --- sections from a table of contents ----------------------------------------


def toc_ranges(toc: DataFrame, pages: DataFrame, block: int = 4096) -> DataFrame:
    """Adds the last page of each entry: before the next entry, or the end of the document."""
    ends = pages.groupBy("doc_id").agg(F.max("page_no").alias("_last"))
    ranged = next_after(toc, ["doc_id"], ["seq"], block, {"_next": F.col("page")})
    return (
        attach(ranged, ends, "doc_id", "seq")
        .withColumn("end_page", F.least(F.col("_next") - 1, F.col("_last")))
        .filter("page <= end_page")
        .drop("_next", "_last")
    )


def _pages_in_ranges(ranges: DataFrame, pages: DataFrame, per_part: int) -> DataFrame:
    """Range join as an equi-join on blocks of pages; a range never unfolds page by page."""
    cells = ranges.withColumn(
        "part",
        F.explode(F.expr(f"sequence(cast(greatest(page, 0) div {per_part} as int), "
                         f"cast(end_page div {per_part} as int))")),
    ).filter("end_page >= 0")
    parts = pages.withColumn("part", F.expr(f"cast(page_no div {per_part} as int)"))
    return parts.join(cells, ["doc_id", "part"]).filter("page_no between page and end_page")


def toc_section_pages(
    toc: DataFrame, pages: DataFrame, block: int = 4096, per_part: int = 256
) -> DataFrame:
    """The non-blank pages of every section."""
    filled = pages.filter(X.clean(F.col("text")) != "").select("doc_id", "page_no", "text")
    return _pages_in_ranges(toc_ranges(toc, pages, block), filled, per_part)


def section_key(number: Column, title: Column) -> Column:
    return F.when(number != "", F.replace(number, F.lit("."), F.lit("_"))).otherwise(short_hash(title))


def toc_sections(
    toc: DataFrame, pages: DataFrame, block: int = 4096, per_part: int = 256
) -> DataFrame:
    """Sections of a table of contents with their text.

    ``toc`` carries ``path``.  The text of a section is one row per ``per_part``
    pages (column ``part``), so that no row or task holds a whole long document.
    """
    body = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return (
        toc_section_pages(toc, pages, block, per_part)
        .groupBy("doc_id", "seq", "part", "number", "title", "level", "path")
        .agg(body.alias("rows"))
        .select(
            "doc_id",
            "seq",
            section_key(F.col("number"), F.col("title")).alias("section_id"),
            "part",
            "title",
            "level",
            "number",
            "path",
            F.transform("rows", lambda r: r["page_no"]).alias("pages"),
            F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n").alias("content"),
        )
    )


def uncovered_pages(pages: DataFrame, toc: DataFrame, block: int = 4096, per_part: int = 256) -> DataFrame:
    """Pages in no section at all; these go on to the heading patterns."""
    covered = _pages_in_ranges(
        toc_ranges(toc, pages, block), pages.select("doc_id", "page_no"), per_part
    ).select("doc_id", "page_no")
    return pages.join(covered, ["doc_id", "page_no"], "left_anti")


# --- headings -------------------------------------------------------------------


def heading_basic(line: Column) -> Column:
    """``struct(title, level, kind)`` or null; first matching pattern."""

    def found(title, level, kind):
        return F.struct(title.alias("title"), level.cast("int").alias("level"), F.lit(kind).alias("kind"))

    number = F.regexp_extract(line, P.DOTTED_HEADING, 1)
    return (
        F.when(
            line.rlike(P.MARKDOWN_HEADING),
            found(
                F.regexp_extract(line, P.MARKDOWN_HEADING, 2),
                F.length(F.regexp_extract(line, P.MARKDOWN_HEADING, 1)),
                "markdown",
            ),
        )
        .when(
            line.rlike(P.DOTTED_HEADING),
            found(
                F.regexp_extract(line, P.DOTTED_HEADING, 2),
                F.length(number) - F.length(F.replace(number, F.lit("."))),
                "numbered",
            ),
        )
        .when(
            line.rlike(P.FORMAL_HEADING),
            found(F.regexp_extract(line, P.FORMAL_HEADING, 1), F.lit(1), "formal"),
        )
        .when(line.rlike(P.CAPS_HEADING), found(line, F.lit(1), "allcaps"))
    )


def headings_basic(lines: DataFrame) -> DataFrame:
    return lines.withColumn("h", heading_basic(F.col("line"))).filter("h is not null").select(
        "doc_id", "page_no", "pos", "h.title", "h.level", "h.kind"
    )


def heading_level(number: Column, kind: Column) -> Column:
    """Level from the number (inner dots), else from the type of heading."""
    inner = F.regexp_replace(number, r"\.$", "")
    return (
        F.when(F.contains(inner, F.lit(".")), toc_level(number))
        .when(kind.isin("chapter", "uppercase", "roman", "numbered"), F.lit(1))
        .when(kind == "markdown", number.try_cast("int"))
        .otherwise(F.lit(2))
    )


def headings(lines: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Headings by six patterns with title, number, confidence, type and level."""
    line = F.col("line")
    found = F.lit(None)
    for kind, pattern, confidence in reversed(P.HEADING_PATTERNS):
        first = F.regexp_extract(line, pattern, 1)
        if kind == "uppercase":
            number, title = F.lit(None).cast("string"), first
        elif kind == "markdown":
            number, title = F.length(first).cast("string"), F.regexp_extract(line, pattern, 2)
        else:
            number, title = first, F.regexp_extract(line, pattern, 2)
        found = F.when(
            line.rlike(pattern),
            F.struct(
                title.alias("title"), number.alias("number"),
                F.lit(confidence).alias("base"), F.lit(kind).alias("kind"),
            ),
        ).otherwise(found)
    boosted = F.when(
        F.lower("h.title").rlike(X.any_of(P.HEADING_KEYWORDS)), F.least(F.col("h.base") + 0.1, F.lit(1.0))
    ).otherwise(F.col("h.base"))
    return (
        lines.withColumn("h", found)
        .filter("h is not null")
        .select("doc_id", "page_no", "pos", "h.title", "h.number", boosted.alias("confidence"), "h.kind")
        .withColumn("level", heading_level(F.col("number"), F.col("kind")))
        .filter(F.col("confidence") >= min_confidence)
    )


def construct_toc(lines: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Entries from the headings of documents without a table of contents."""
    return headings(lines, min_confidence).select(
        "doc_id",
        line_seq().alias("seq"),
        F.coalesce("number", F.lit("")).alias("number"),
        "title",
        F.col("page_no").alias("page"),
        "level",
        F.col("title").alias("raw_text"),
        F.lit("unknown").alias("format"),
    )


def pattern_sections(lines: DataFrame, block: int = 4096, per_part: int = 256) -> DataFrame:
    """Sections opened by a heading and running to the next, over page ends.

    Text before the first heading is dropped.  The heading is the first line of the
    text; a long section has one row per ``per_part`` pages (column ``part``).
    """
    marked = lines.withColumn("h", heading_basic(F.col("line")))
    opened = running_sum(
        marked, ["doc_id"], ["page_no", "pos"], block, F.col("h").isNotNull().cast("bigint"), "grp"
    ).filter("grp > 0")
    heads = marked.filter("h is not null")
    heads = running_sum(heads, ["doc_id"], ["page_no", "pos"], block, F.lit(1).cast("bigint"), "grp").select(
        "doc_id", "grp", "h.title", "h.level",
        short_hash(F.concat_ws("-", "h.title", F.col("page_no").cast("string"))).alias("section_id"),
    )
    shown = F.when(F.col("h").isNotNull(), F.col("h.title")).otherwise(F.col("line"))
    parts = (
        opened.withColumn("part", F.expr(f"cast(page_no div {per_part} as int)"))
        .groupBy("doc_id", "grp", "part")
        .agg(
            F.array_sort(F.collect_list(F.struct("page_no", "pos", shown.alias("line")))).alias("rows")
        )
    )
    return parts.join(heads, ["doc_id", "grp"]).select(
        "doc_id",
        "section_id",
        F.col("grp").alias("seq"),
        "part",
        "title",
        "level",
        F.array_distinct(F.transform("rows", lambda r: r["page_no"])).alias("pages"),
        F.concat(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("content"),
    )
