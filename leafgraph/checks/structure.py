"""Tables of contents, headings and sections."""

from pyspark.sql import functions as F

from leafgraph.checks.base import CTES, NL, WS, clean_sql, lit, query
from leafgraph.functions import patterns as P
from leafgraph.functions import text as X
from leafgraph.operators import shape, structure
from leafgraph.sources import adapters as A

NUMBER = (
    "CAST(p_size % 9 + 1 AS VARCHAR) || CASE WHEN p_partkey % 3 > 0 THEN '.' || "
    "CAST(p_partkey % 5 + 1 AS VARCHAR) ELSE '' END || CASE WHEN p_partkey % 3 = 2 THEN '.' || "
    "CAST(p_partkey % 4 + 1 AS VARCHAR) ELSE '' END"
)
CTES["toc_lines"] = f"""toc_lines AS (
  SELECT p_brand AS doc_id, p_partkey AS seq,
    CASE CAST(substr(p_brand, 7) AS INTEGER) % 4
      WHEN 0 THEN {NUMBER} || ' ' || p_name || ' ........ ' || CAST(p_partkey % 300 AS VARCHAR)
      WHEN 1 THEN {NUMBER} || chr(9) || p_name || chr(9) || CAST(p_partkey % 300 AS VARCHAR)
      WHEN 2 THEN {NUMBER} || '  ' || p_name || '  ' || CAST(p_partkey % 300 AS VARCHAR)
      ELSE p_name || ' ' || CAST(p_partkey % 300 AS VARCHAR) END AS line
  FROM part)"""
CTES["toc_pages"] = f"""toc_pages AS (
  SELECT doc_id, CAST(seq // 200 AS INTEGER) AS page_no,
    CASE WHEN seq // 200 % 4 = 1 THEN 'Table of Contents' || {NL} ELSE '' END
    || string_agg(line, {NL} ORDER BY seq)
    || CASE WHEN seq // 200 % 4 = 1 THEN {NL} || '(Continued)' ELSE '' END AS text
  FROM toc_lines GROUP BY doc_id, seq // 200)"""


def _hits(c, *patterns):
    return " + ".join(f"len(regexp_extract_all({c}, {lit(p)}))" for p in patterns)


CTES["toc_flags"] = f"""toc_flags AS (
  SELECT doc_id, page_no, text,
    regexp_matches(lower(text), {lit(X.any_of(P.TOC_INDICATORS))})
      AND {_hits('text', P.LINE_END_NUMBER, P.DOTS_NUMBER, P.TAB_NUMBER)} >= 3 AS is_toc,
    {_hits('text', P.LINE_END_NUMBER)} >= 3 AS follows
  FROM toc_pages)"""
CTES["toc_found"] = f"""first_toc AS (
    SELECT doc_id, min(page_no) AS first_no FROM toc_flags WHERE is_toc GROUP BY doc_id),
  toc_found AS (
    SELECT f.doc_id, f.page_no, f.text FROM toc_flags f JOIN first_toc t
      ON t.doc_id = f.doc_id AND t.first_no = f.page_no
    UNION ALL
    SELECT n.doc_id, n.page_no, n.text FROM toc_flags n JOIN first_toc t ON t.doc_id = n.doc_id
      JOIN toc_flags f ON f.doc_id = t.doc_id AND f.page_no = t.first_no
    WHERE n.page_no > t.first_no
      AND regexp_matches(lower(list_last(string_split({clean_sql('f.text')}, {NL}))), 'continued|cont\\.')
      AND n.follows AND NOT EXISTS (
        SELECT 1 FROM toc_flags x WHERE x.doc_id = n.doc_id AND NOT x.follows
          AND x.page_no > t.first_no AND x.page_no < n.page_no))"""

TOC_PAGE_CTES = ("toc_lines", "toc_pages", "toc_flags", "toc_found")


@query("T1_is_toc_page", "SELECT doc_id, page_no, is_toc FROM toc_flags", TOC_PAGE_CTES[:3])
def t1(spark, d):
    pages = A.toc_pages(spark, d)
    return pages.select("doc_id", "page_no", structure.is_toc_page(F.col("text")).alias("is_toc"))


@query("T2_toc_pages", "SELECT doc_id, page_no, text FROM toc_found", TOC_PAGE_CTES)
def t2(spark, d):
    return structure.toc_pages(A.toc_pages(spark, d))


CTES["toc_formats"] = f"""toc_formats AS (
  SELECT doc_id, CASE WHEN greatest(d, t, n) = 0 THEN 'unknown' WHEN d >= t AND d >= n THEN 'dot_leader'
    WHEN t >= n THEN 'tab_separated' ELSE 'numbered' END AS format
  FROM (SELECT doc_id, count(*) FILTER (regexp_matches(line, {lit(P.DOT_LEADER)})) AS d,
      count(*) FILTER (contains(line, chr(9))) AS t,
      count(*) FILTER (regexp_matches(line, {lit(P.NUMBERED_START)})) AS n
    FROM toc_lines GROUP BY doc_id))"""


@query("T3_toc_format", "SELECT doc_id, format FROM toc_formats", ("toc_lines", "toc_formats"))
def t3(spark, d):
    return structure.toc_format(A.toc_lines(spark, d))


def _ex(pattern, i):
    return f"regexp_extract(line, {lit(pattern)}, {i})"


def _pick(dot, tab3, tab2, num, generic):
    return f"""CASE format
      WHEN 'dot_leader' THEN CASE WHEN regexp_matches(line, {lit(P.DOT_ENTRY)}) THEN {dot} END
      WHEN 'tab_separated' THEN CASE WHEN regexp_matches(line, {lit(P.TAB_ENTRY_3)}) THEN {tab3}
        WHEN regexp_matches(line, {lit(P.TAB_ENTRY_2)}) THEN {tab2} END
      WHEN 'numbered' THEN CASE WHEN regexp_matches(line, {lit(P.NUMBERED_ENTRY)}) THEN {num} END
      ELSE CASE WHEN regexp_matches(line, {lit(P.TRAILING_NUMBER)}) THEN {generic} END END"""


_REST = f"trim(regexp_replace(line, {lit(P.TRAILING_NUMBER)}, ''), {WS})"
CTES["toc"] = f"""toc_raw AS (
    SELECT doc_id, seq, line, format,
      {_pick(_ex(P.DOT_ENTRY, 1), _ex(P.TAB_ENTRY_3, 1), "''", _ex(P.NUMBERED_ENTRY, 1),
             f"regexp_extract({_REST}, {lit(P.LEADING_NUMBER)}, 1)")} AS number,
      trim({_pick(_ex(P.DOT_ENTRY, 2), _ex(P.TAB_ENTRY_3, 2), _ex(P.TAB_ENTRY_2, 1), _ex(P.NUMBERED_ENTRY, 2),
             f"regexp_replace({_REST}, {lit(P.LEADING_NUMBER)}, '')")}, {WS}) AS title,
      {_pick(_ex(P.DOT_ENTRY, 3), _ex(P.TAB_ENTRY_3, 3), _ex(P.TAB_ENTRY_2, 2), _ex(P.NUMBERED_ENTRY, 3),
             _ex(P.TRAILING_NUMBER, 1))} AS page
    FROM toc_lines JOIN toc_formats USING (doc_id)),
  toc AS (
    SELECT doc_id, seq, number, title, TRY_CAST(page AS INTEGER) AS page,
      CAST(length(regexp_replace(number, '\\.$', ''))
        - length(replace(regexp_replace(number, '\\.$', ''), '.', '')) + 1 AS INTEGER) AS level,
      line AS raw_text, format
    FROM toc_raw WHERE TRY_CAST(page AS INTEGER) IS NOT NULL)"""
TOC_CTES = ("toc_lines", "toc_formats", "toc")


def toc(spark, d):
    lines = A.toc_lines(spark, d)
    return structure.parse_toc(lines, structure.toc_format(lines))


@query("T4_parse_toc", "SELECT doc_id, seq, number, title, page, raw_text, format FROM toc", TOC_CTES)
def t4(spark, d):
    return toc(spark, d).drop("level")


@query(
    "T4_detect_toc",
    f"""WITH found AS (
      SELECT doc_id, page_no * 4294967296 + i - 1 AS seq, {clean_sql('raw')} AS line FROM (
        SELECT doc_id, CAST(page_no AS BIGINT) AS page_no, unnest(string_split(text, {NL})) AS raw,
          generate_subscripts(string_split(text, {NL}), 1) AS i FROM toc_found)
      WHERE {clean_sql('raw')} <> ''),
    votes AS (SELECT doc_id, count(*) FILTER (regexp_matches(line, {lit(P.DOT_LEADER)})) AS d,
      count(*) FILTER (contains(line, chr(9))) AS t,
      count(*) FILTER (regexp_matches(line, {lit(P.NUMBERED_START)})) AS n FROM found GROUP BY doc_id),
    formats AS (SELECT doc_id, CASE WHEN greatest(d, t, n) = 0 THEN 'unknown'
      WHEN d >= t AND d >= n THEN 'dot_leader' WHEN t >= n THEN 'tab_separated' ELSE 'numbered' END AS format
      FROM votes),
    raw_entries AS (SELECT doc_id, seq, {_pick(_ex(P.DOT_ENTRY, 3), _ex(P.TAB_ENTRY_3, 3),
        _ex(P.TAB_ENTRY_2, 2), _ex(P.NUMBERED_ENTRY, 3), _ex(P.TRAILING_NUMBER, 1))} AS page
      FROM found JOIN formats USING (doc_id))
    SELECT doc_id, count(*) AS entries, min(seq) AS first_seq, max(seq) AS last_seq,
      CAST(sum(CAST(page AS BIGINT) - 1) AS BIGINT) AS page_sum
    FROM raw_entries WHERE TRY_CAST(page AS INTEGER) IS NOT NULL GROUP BY doc_id""",
    TOC_PAGE_CTES,
)
def t4b(spark, d):
    found = structure.detect_toc(A.toc_pages(spark, d), offset=-1)
    return found.groupBy("doc_id").agg(
        F.count("*").alias("entries"), F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"), F.sum("page").alias("page_sum"),
    )


@query("T5_toc_level", "SELECT doc_id, seq, number, level FROM toc", TOC_CTES)
def t5(spark, d):
    return toc(spark, d).select("doc_id", "seq", "number", "level")


CTES["toc_parents"] = """toc_parents AS (
  SELECT t.*, (SELECT max(p.seq) FROM toc p WHERE p.doc_id = t.doc_id AND p.seq < t.seq
    AND p.level < t.level) AS parent_seq FROM toc t)"""
CTES["toc_tree"] = """toc_tree AS (
  SELECT doc_id, seq, number, title, page, level, parent_seq, title AS path, 0 AS depth
  FROM toc_parents WHERE parent_seq IS NULL
  UNION ALL
  SELECT c.doc_id, c.seq, c.number, c.title, c.page, c.level, c.parent_seq, p.path || '/' || c.title,
    p.depth + 1
  FROM toc_parents c JOIN toc_tree p ON p.doc_id = c.doc_id AND p.seq = c.parent_seq)"""
TREE_CTES = (*TOC_CTES, "toc_parents", "toc_tree")


@query("T6_toc_parents", "SELECT doc_id, seq, level, parent_seq FROM toc_parents", TREE_CTES[:4])
def t6(spark, d):
    return structure.toc_parents(toc(spark, d), block=500).select("doc_id", "seq", "level", "parent_seq")


@query("T7_toc_paths", "SELECT doc_id, seq, path FROM toc_tree", TREE_CTES, recursive=True)
def t7(spark, d):
    return structure.toc_tree(toc(spark, d)).select("doc_id", "seq", "path")


@query(
    "T7_toc_text",
    f"""SELECT doc_id, seq // 4096 AS part, string_agg(repeat('  ', depth) || number || ' ' || title
      || ' (p.' || CAST(page AS VARCHAR) || ')', {NL} ORDER BY seq) AS text
    FROM toc_tree GROUP BY doc_id, seq // 4096""",
    TREE_CTES,
    recursive=True,
)
def t7b(spark, d):
    return structure.toc_text(structure.with_depth(toc(spark, d)))


@query(
    "T8_toc_page_map",
    """SELECT doc_id, page, arg_min(title, seq) AS first_title,
      arg_max(CASE WHEN number <> '' THEN number ELSE title END, seq) AS section,
      arg_max(title, seq) AS title, arg_max(level, seq) AS level, arg_max(path, seq) AS path
    FROM toc_tree GROUP BY doc_id, page""",
    TREE_CTES,
    recursive=True,
)
def t8(spark, d):
    return structure.toc_page_map(structure.toc_tree(toc(spark, d)))


CTES["outline"] = """outline AS (
  SELECT 'src' || CAST(p_partkey % 20 AS VARCHAR) AS doc_id, p_partkey AS seq,
    CAST(p_partkey % 3 + 1 AS INTEGER) AS level, p_name AS title,
    CAST((p_partkey // 20) * 2 + p_size % 3 + 1 AS INTEGER) AS page FROM part),
  toc AS (SELECT doc_id, seq, '' AS number, title, page - 1 AS page, level, title AS raw_text,
    'unknown' AS format FROM outline)"""
BOOK_TOC = ("books", "outline", "toc_parents", "toc_tree")
CTES["ranges"] = """ranges AS (
  SELECT * FROM (SELECT t.*, coalesce(lead(page) OVER (PARTITION BY t.doc_id ORDER BY seq) - 1, e.last_no)
      AS end_page FROM toc_tree t
    JOIN (SELECT doc_id, max(page_no) AS last_no FROM books GROUP BY doc_id) e ON e.doc_id = t.doc_id)
  WHERE page <= end_page)"""


def book_toc(spark, d):
    return structure.toc_tree(structure.outline_toc(A.outline(spark, d)))


@query(
    "T9_orphan_pages",
    "SELECT doc_id, page_no FROM books b WHERE NOT EXISTS "
    "(SELECT 1 FROM toc t WHERE t.doc_id = b.doc_id AND t.page = b.page_no)",
    ("books", "outline"),
)
def t9(spark, d):
    return structure.orphan_pages(A.books(spark, d), structure.outline_toc(A.outline(spark, d)))


@query(
    "T9_uncovered_pages",
    """SELECT doc_id, page_no, text FROM books b WHERE NOT EXISTS
      (SELECT 1 FROM ranges r WHERE r.doc_id = b.doc_id AND b.page_no BETWEEN r.page AND r.end_page)""",
    (*BOOK_TOC, "ranges"),
    recursive=True,
)
def t9b(spark, d):
    return structure.uncovered_pages(
        A.books(spark, d).drop("domain"), structure.outline_toc(A.outline(spark, d)), per_part=64
    )


CTES["book_sections"] = f"""book_sections AS (
  SELECT r.doc_id, r.seq, CASE WHEN number <> '' THEN replace(number, '.', '_')
      ELSE substr(md5(title), 1, 8) END AS section_id,
    CAST(b.page_no // 256 AS INTEGER) AS part, title, level, path,
    list(b.page_no ORDER BY b.page_no) AS pages,
    string_agg(b.text, {NL} || {NL} ORDER BY b.page_no) AS content
  FROM ranges r JOIN books b ON b.doc_id = r.doc_id AND b.page_no BETWEEN r.page AND r.end_page
  WHERE {clean_sql('b.text')} <> ''
  GROUP BY r.doc_id, r.seq, r.number, r.title, r.level, r.path, b.page_no // 256)"""
SECTION_CTES = (*BOOK_TOC, "ranges", "book_sections")


def book_sections(spark, d):
    return structure.toc_sections(book_toc(spark, d), A.books(spark, d))


@query(
    "T10_toc_sections",
    """SELECT doc_id, seq, section_id, part, title, level, path,
      array_to_string(list_transform(pages, lambda p: CAST(p AS VARCHAR)), '|') AS pages, content
    FROM book_sections""",
    SECTION_CTES,
    recursive=True,
)
def t10(spark, d):
    out = book_sections(spark, d).drop("number")
    return out.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), "|"))


CTES["weblines"] = f"""weblines AS (
  SELECT doc_id, page_no, CAST(i - 1 AS INTEGER) AS pos, {clean_sql('raw')} AS line FROM (
    SELECT doc_id, page_no, unnest(string_split(text, {NL})) AS raw,
      generate_subscripts(string_split(text, {NL}), 1) AS i FROM webtext)
  WHERE {clean_sql('raw')} <> '')"""
WEB_CTES = ("web", "webtext", "weblines")


def weblines(spark, d):
    return shape.lines(shape.markdown_pages(A.html(spark, d)))


_BASIC = f"""CASE
    WHEN regexp_matches(line, {lit(P.MARKDOWN_HEADING)}) THEN 'markdown'
    WHEN regexp_matches(line, {lit(P.DOTTED_HEADING)}) THEN 'numbered'
    WHEN regexp_matches(line, {lit(P.FORMAL_HEADING)}) THEN 'formal'
    WHEN regexp_matches(line, {lit(P.CAPS_HEADING)}) THEN 'allcaps' END"""
CTES["basic"] = f"""basic AS (
  SELECT doc_id, page_no, pos, line, kind,
    CASE kind WHEN 'markdown' THEN regexp_extract(line, {lit(P.MARKDOWN_HEADING)}, 2)
      WHEN 'numbered' THEN regexp_extract(line, {lit(P.DOTTED_HEADING)}, 2)
      WHEN 'formal' THEN regexp_extract(line, {lit(P.FORMAL_HEADING)}, 1) WHEN 'allcaps' THEN line END AS title,
    CAST(CASE kind WHEN 'markdown' THEN length(regexp_extract(line, {lit(P.MARKDOWN_HEADING)}, 1))
      WHEN 'numbered' THEN length(regexp_extract(line, {lit(P.DOTTED_HEADING)}, 1))
        - length(replace(regexp_extract(line, {lit(P.DOTTED_HEADING)}, 1), '.', ''))
      ELSE 1 END AS INTEGER) AS level
  FROM (SELECT *, {_BASIC} AS kind FROM weblines))"""


@query(
    "T11_headings_basic",
    "SELECT doc_id, page_no, pos, title, level, kind FROM basic WHERE kind IS NOT NULL",
    (*WEB_CTES, "basic"),
)
def t11(spark, d):
    return structure.headings_basic(weblines(spark, d))


_KIND = " ".join(
    f"WHEN regexp_matches(line, {lit(p)}) THEN {lit(k)}" for k, p, _ in P.HEADING_PATTERNS
)
_BASE = " ".join(f"WHEN {lit(k)} THEN CAST({c} AS DOUBLE)" for k, _, c in P.HEADING_PATTERNS)
_TITLE = " ".join(
    f"WHEN {lit(k)} THEN regexp_extract(line, {lit(p)}, {1 if k == 'uppercase' else 2})"
    for k, p, _ in P.HEADING_PATTERNS
)
_NUMBER = " ".join(
    f"WHEN {lit(k)} THEN "
    + (
        "NULL" if k == "uppercase"
        else f"CAST(length(regexp_extract(line, {lit(p)}, 1)) AS VARCHAR)" if k == "markdown"
        else f"regexp_extract(line, {lit(p)}, 1)"
    )
    for k, p, _ in P.HEADING_PATTERNS
)
CTES["headings"] = f"""headings_raw AS (
    SELECT doc_id, page_no, pos, kind, CASE kind {_TITLE} END AS title, CASE kind {_NUMBER} END AS number,
      CASE kind {_BASE} END AS base
    FROM (SELECT *, CASE {_KIND} END AS kind FROM weblines) WHERE kind IS NOT NULL),
  headings AS (
    SELECT doc_id, page_no, pos, title, number, kind,
      CASE WHEN regexp_matches(lower(title), {lit(X.any_of(P.HEADING_KEYWORDS))})
        THEN least(base + CAST(0.1 AS DOUBLE), 1.0) ELSE base END AS confidence,
      CAST(CASE WHEN contains(regexp_replace(number, '\\.$', ''), '.')
          THEN length(regexp_replace(number, '\\.$', ''))
            - length(replace(regexp_replace(number, '\\.$', ''), '.', '')) + 1
        WHEN kind IN ('chapter', 'uppercase', 'roman', 'numbered') THEN 1
        WHEN kind = 'markdown' THEN TRY_CAST(number AS INTEGER) ELSE 2 END AS INTEGER) AS level
    FROM headings_raw)"""
HEADING_CTES = (*WEB_CTES, "headings")


@query(
    "T12_headings",
    "SELECT doc_id, page_no, pos, title, number, kind, round(confidence, 6) AS confidence FROM headings "
    "WHERE confidence >= 0.6",
    HEADING_CTES,
)
def t12(spark, d):
    out = structure.headings(weblines(spark, d), 0.6).drop("level")
    return out.withColumn("confidence", F.round("confidence", 6))


@query("T13_heading_level", "SELECT doc_id, page_no, pos, kind, number, level FROM headings", HEADING_CTES)
def t13(spark, d):
    return structure.headings(weblines(spark, d)).select(
        "doc_id", "page_no", "pos", "kind", "number", "level"
    )


CTES["web_sections"] = f"""web_groups AS (
    SELECT *, CAST(sum(CASE WHEN kind IS NULL THEN 0 ELSE 1 END)
      OVER (PARTITION BY doc_id ORDER BY page_no, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM basic),
  web_sections AS (
    SELECT g.doc_id, substr(md5(h.title || '-' || CAST(h.page_no AS VARCHAR)), 1, 8) AS section_id,
      g.grp AS seq, CAST(g.page_no // 256 AS INTEGER) AS part, h.title, h.level,
      list_sort(list(DISTINCT g.page_no)) AS pages,
      string_agg(CASE WHEN g.kind IS NULL THEN g.line ELSE g.title END, {NL} ORDER BY g.page_no, g.pos)
        || {NL} AS content
    FROM web_groups g JOIN web_groups h ON h.doc_id = g.doc_id AND h.grp = g.grp AND h.kind IS NOT NULL
    WHERE g.grp > 0 GROUP BY g.doc_id, g.grp, g.page_no // 256, h.title, h.page_no, h.level)"""


@query(
    "T14_pattern_sections",
    """SELECT doc_id, section_id, seq, part, title, level, content,
      array_to_string(list_transform(pages, lambda p: CAST(p AS VARCHAR)), '|') AS pages
    FROM web_sections""",
    (*WEB_CTES, "basic", "web_sections"),
)
def t14(spark, d):
    out = structure.pattern_sections(weblines(spark, d), block=4)
    return out.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), "|"))


CTES["constructed"] = """toc AS (
    SELECT doc_id, CAST(page_no AS BIGINT) * 4294967296 + pos AS seq, coalesce(number, '') AS number, title,
      page_no AS page, level, title AS raw_text, 'unknown' AS format FROM headings WHERE confidence >= 0.5),
  toc_parents AS (
    SELECT t.*, (SELECT max(p.seq) FROM toc p WHERE p.doc_id = t.doc_id AND p.seq < t.seq
      AND p.level < t.level) AS parent_seq FROM toc t)"""


@query(
    "T15_construct_toc",
    "SELECT doc_id, seq, number, title, page, level, parent_seq FROM toc_parents",
    (*HEADING_CTES, "constructed"),
)
def t15(spark, d):
    built = structure.toc_parents(structure.construct_toc(weblines(spark, d)))
    return built.select("doc_id", "seq", "number", "title", "page", "level", "parent_seq")


@query(
    "T16_outline_toc",
    """SELECT t.doc_id, t.seq, t.title, t.page, t.level, (SELECT max(p.seq) FROM toc p
      WHERE p.doc_id = t.doc_id AND p.seq < t.seq AND p.level < t.level) AS parent_seq FROM toc t""",
    ("outline",),
)
def t16(spark, d):
    tree = structure.toc_parents(structure.outline_toc(A.outline(spark, d)))
    return tree.select("doc_id", "seq", "title", "page", "level", "parent_seq")


@query(
    "T17_resolve_toc",
    """WITH all_sources AS (
      SELECT 1 AS source_rank, p_brand AS doc_id, p_partkey AS seq, p_name AS title FROM part
        WHERE CAST(substr(p_brand, 7) AS INTEGER) % 3 = 0
      UNION ALL SELECT 2, doc_id, seq, title FROM toc WHERE CAST(substr(doc_id, 7) AS INTEGER) % 3 < 2
      UNION ALL SELECT 3, p_brand, p_partkey, p_name FROM part)
    SELECT source_rank, doc_id, seq, title FROM all_sources a
    WHERE source_rank = (SELECT min(source_rank) FROM all_sources b WHERE b.doc_id = a.doc_id)""",
    TOC_CTES,
)
def t17(spark, d):
    part = A.table(spark, d, "part")
    plain = part.select(
        F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("seq"), F.lit("").alias("number"),
        F.col("p_name").alias("title"), F.lit(0).alias("page"), F.lit(1).alias("level"),
        F.col("p_name").alias("raw_text"), F.lit("unknown").alias("format"),
    )
    brand = F.expr("cast(substring(doc_id, 7) as int)")
    chosen = structure.resolve_toc(
        [plain.filter(brand % 3 == 0), toc(spark, d).filter(brand % 3 < 2), plain]
    )
    return chosen.select("source_rank", "doc_id", "seq", "title")


@query(
    "T18_toc_confidence",
    """WITH d AS (SELECT DISTINCT p_brand AS doc_id FROM part UNION ALL SELECT 'empty'),
    s AS (SELECT doc_id, least(1.0, CASE WHEN bool_and(page >= 0) THEN CAST(0.3 AS DOUBLE) ELSE 0 END
      + CASE WHEN bool_or(level > 1) THEN CAST(0.3 AS DOUBLE) ELSE 0 END
      + CASE WHEN bool_or(number <> '') THEN CAST(0.2 AS DOUBLE) ELSE 0 END
      + CASE WHEN count(*) >= 5 THEN CAST(0.2 AS DOUBLE) ELSE 0 END
      + CASE WHEN bool_or(format <> 'unknown') THEN CAST(0.1 AS DOUBLE) ELSE 0 END) AS score
      FROM toc GROUP BY doc_id)
    SELECT d.doc_id, round(coalesce(score, 0), 6) AS confidence FROM d LEFT JOIN s USING (doc_id)""",
    TOC_CTES,
)
def t18(spark, d):
    brands = A.table(spark, d, "part").select(F.col("p_brand").alias("doc_id")).distinct()
    brands = brands.unionByName(spark.range(1).select(F.lit("empty").alias("doc_id")))
    return structure.toc_confidence(toc(spark, d), brands).withColumn(
        "confidence", F.round("confidence", 6)
    )
