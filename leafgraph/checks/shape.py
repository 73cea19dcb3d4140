"""Pages and lines."""

from pyspark.sql import functions as F

from leafgraph.checks.base import CTES, NL, WS, clean_sql, lit, query
from leafgraph.functions import patterns as P
from leafgraph.functions import text as X
from leafgraph.operators import shape
from leafgraph.sources import adapters as A

CTES["lines"] = f"""lines AS (
  SELECT doc_id, page_no, CAST(i - 1 AS BIGINT) AS pos, {clean_sql('raw')} AS line FROM (
    SELECT doc_id, page_no, unnest(string_split(text, {NL})) AS raw,
           generate_subscripts(string_split(text, {NL}), 1) AS i FROM docs)
  WHERE {clean_sql('raw')} <> '')"""


@query("P1_lines", "SELECT * FROM lines", ("docs", "lines"))
def p1(spark, d):
    out = shape.lines(A.docs(spark, d).drop("domain"))
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "P2_chunk_pages",
    f"""WITH parts AS (
      SELECT doc_id, string_split(text, {NL}) AS rows FROM docs),
    sized AS (SELECT doc_id, rows, greatest(1, len(rows) // 4) AS size FROM parts),
    cut AS (
      SELECT doc_id, least((i - 1) // size, 3) AS page_no, i, row FROM (
        SELECT doc_id, size, unnest(rows) AS row, generate_subscripts(rows, 1) AS i FROM sized)),
    full_pages AS (SELECT doc_id, page_no, string_agg(row, {NL} ORDER BY i) AS text
      FROM cut GROUP BY ALL)
    SELECT d.doc_id, CAST(g.page_no AS BIGINT) AS page_no, coalesce(f.text, '') AS text
    FROM docs d CROSS JOIN (SELECT unnest(generate_series(0, 3)) AS page_no) g
    LEFT JOIN full_pages f ON f.doc_id = d.doc_id AND f.page_no = g.page_no""",
    ("docs",),
)
def p2(spark, d):
    out = shape.chunk_pages(A.docs(spark, d), 4)
    return out.withColumn("page_no", F.col("page_no").cast("bigint"))


@query(
    "P3_split_on_markers",
    f"""WITH marked AS (
      SELECT doc_id, CASE WHEN CAST(doc_id AS BIGINT) % 2 = 0 THEN array_to_string(list_transform(
        string_split(text, {NL}), lambda x, i: 'Page ' || CAST(i AS VARCHAR) || {NL} || x), {NL})
        ELSE text END AS text FROM docs),
    rows AS (SELECT doc_id, unnest(string_split(text, {NL})) AS row,
        generate_subscripts(string_split(text, {NL}), 1) AS i
      FROM marked WHERE regexp_matches(text, {lit(P.PAGE_MARKER)})),
    numbered AS (SELECT *, sum(CASE WHEN regexp_matches(row, '^Page \\d+') THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY i) AS part FROM rows),
    joined AS (SELECT doc_id, part, string_agg(row, {NL} ORDER BY i) AS piece,
        part = max(part) OVER (PARTITION BY doc_id) AS last FROM numbered WHERE part > 0 GROUP BY doc_id, part),
    pieces AS (SELECT doc_id, CASE WHEN last AND suffix(piece, {NL}) THEN left(piece, length(piece) - 1)
      ELSE piece END AS piece FROM joined),
    parts AS (SELECT doc_id, string_split(text, {NL}) AS rows FROM marked
      WHERE NOT regexp_matches(text, {lit(P.PAGE_MARKER)})),
    sized AS (SELECT doc_id, rows, greatest(1, len(rows) // 2) AS size FROM parts),
    cut AS (
      SELECT doc_id, least((i - 1) // size, 1) AS page_no, i, row FROM (
        SELECT doc_id, size, unnest(rows) AS row, generate_subscripts(rows, 1) AS i FROM sized)),
    full_pages AS (SELECT doc_id, page_no, string_agg(row, {NL} ORDER BY i) AS text
      FROM cut GROUP BY ALL)
    SELECT doc_id, CAST(regexp_extract(piece, '^Page (\\d+)', 1) AS BIGINT) - 1 AS page_no,
      piece AS text
    FROM pieces
    UNION ALL
    SELECT p.doc_id, CAST(g.page_no AS BIGINT), coalesce(f.text, '')
    FROM parts p CROSS JOIN (SELECT unnest([0, 1]) AS page_no) g
    LEFT JOIN full_pages f ON f.doc_id = p.doc_id AND f.page_no = g.page_no""",
    ("docs",),
)
def p3(spark, d):
    docs = A.docs(spark, d)
    marked = F.array_join(
        F.transform(
            F.split("text", "\n"),
            lambda x, i: F.concat(F.lit("Page "), (i + 1).cast("string"), F.lit("\n"), x),
        ),
        "\n",
    )
    even = F.col("doc_id").cast("bigint") % 2 == 0
    docs = docs.withColumn("text", F.when(even, marked).otherwise(F.col("text")))
    out = shape.split_on_markers(docs, 2)
    return out.withColumn("page_no", F.col("page_no").cast("bigint"))


@query(
    "P4_select_pages",
    "SELECT doc_id, page_no, text FROM convs "
    "WHERE page_no = 0 OR page_no BETWEEN 2 AND 3 OR page_no = 6",
    ("convs",),
)
def p4(spark, d):
    return shape.select_pages(A.convs(spark, d), "0,2-3,6")


@query("P5_limit_pages", "SELECT doc_id, page_no, text FROM convs WHERE page_no < 3", ("convs",))
def p5(spark, d):
    return shape.limit_pages(A.convs(spark, d), 3)


def _markdown_sql(c: str) -> str:
    for pattern, replacement in X.HTML_STEPS:
        replacement = replacement.replace("$", "\\")
        c = f"regexp_replace({c}, {lit(pattern)}, {lit(replacement)}, 'g')"
    for entity, char in X.HTML_ENTITIES:
        c = f"replace({c}, {lit(entity)}, {lit(char)})"
    for pattern, replacement in X.HTML_SPACING:
        c = f"regexp_replace({c}, {lit(pattern)}, {lit(replacement)}, 'g')"
    return clean_sql(c)


CTES["webtext"] = (
    f"webtext AS (SELECT doc_id, page_no, {_markdown_sql('html')} AS text FROM web)"
)


@query("P6_html_to_markdown", "SELECT * FROM webtext", ("web", "webtext"))
def p6(spark, d):
    return shape.markdown_pages(A.html(spark, d))


CTES["page_stats"] = f"""page_stats AS (
  SELECT doc_id, page_no, length(text) AS chars,
    len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words,
    length(text) - length(replace(text, {NL}, ''))
      + CASE WHEN text <> '' AND NOT ends_with(text, {NL}) THEN 1 ELSE 0 END AS lines,
    string_split(text, {NL})[1] AS first_line FROM docs)"""


@query("P7_page_stats", "SELECT * FROM page_stats", ("docs", "page_stats"))
def p7(spark, d):
    return shape.page_stats(A.docs(spark, d))


@query(
    "P7_content_stats",
    """WITH s AS (SELECT doc_id, length(text) AS chars,
         len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words,
         length(text) - length(replace(text, chr(10), ''))
           + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines
       FROM convs)
    SELECT doc_id, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(words) AS BIGINT) AS words,
      CAST(sum(lines) AS BIGINT) AS lines, count(*) AS pages FROM s GROUP BY doc_id""",
    ("convs",),
)
def p7b(spark, d):
    return shape.content_stats(A.convs(spark, d))


CTES["book_docs"] = (
    "book_docs AS (SELECT source AS doc_id, source AS title, min(lang) AS author, "
    "CAST(NULL AS VARCHAR) AS subject, count(*) AS pages FROM documents GROUP BY source)"
)
CTES["book_text"] = f"""book_text AS (
  SELECT d.doc_id, concat_ws({NL}, 'Document: ' || coalesce(d.title, 'Untitled'),
    'Author: ' || nullif(d.author, ''), 'Subject: ' || nullif(d.subject, ''),
    'Pages: ' || CAST(d.pages AS VARCHAR), '',
    CASE WHEN p.text <> '' THEN 'First page excerpt:' END,
    CASE WHEN p.text <> '' THEN trim(left(p.text, 500), {WS}) END,
    CASE WHEN p.text <> '' AND length(p.text) > 500 THEN '...' END) AS content
  FROM book_docs d LEFT JOIN books p ON p.doc_id = d.doc_id AND p.page_no = 0)"""


def book_docs(spark, d):
    """Attributes of the books: title, author and number of pages."""
    return (
        A.table(spark, d, "documents")
        .groupBy(F.col("source").alias("doc_id"))
        .agg(F.min("lang").alias("author"), F.count("*").alias("pages"))
        .withColumns({"title": F.col("doc_id"), "subject": F.lit(None).cast("string")})
    )


@query("P8_document_text", "SELECT * FROM book_text", ("books", "book_docs", "book_text"))
def p8(spark, d):
    return shape.document_text(book_docs(spark, d), A.books(spark, d)).select("doc_id", "content")


@query(
    "P9_admit",
    f"SELECT doc_id, page_no, text FROM docs WHERE length({clean_sql('text')}) >= 50",
    ("docs",),
)
def p9(spark, d):
    return shape.admit(A.docs(spark, d)).select("doc_id", "page_no", "text")


@query(
    "P10_pipeline",
    f"""SELECT doc_id, count(*) AS lines FROM lines WHERE length(line) >= 20 GROUP BY doc_id""",
    ("docs", "lines"),
)
def p10(spark, d):
    chain = (
        shape.Pipeline()
        .add(shape.lines, "lines")
        .add(lambda df: df.filter(F.length("line") >= 20), "long lines")
        .add(lambda df: df.groupBy("doc_id").agg(F.count("*").alias("lines")), "count")
    )
    return chain.run(A.docs(spark, d).drop("domain"))


@query(
    "S7_page_markdown",
    f"SELECT doc_id, page_no, '# Page ' || CAST(page_no + 1 AS VARCHAR) || {NL} || {NL} || text "
    "AS markdown FROM convs",
    ("convs",),
)
def s7(spark, d):
    return shape.page_markdown(A.convs(spark, d))
