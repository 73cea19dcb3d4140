"""Batch enrichment."""

from pyspark.sql import functions as F

from leafgraph.checks.base import CTES, NL, lit, query
from leafgraph.checks.graph import FIRST_SENTENCE
from leafgraph.checks.search import BM25, MEMO_INDEX, _toks, memo, memo_index, memo_tags
from leafgraph.checks.structure import BOOK_TOC, book_toc
from leafgraph.functions import text as X
from leafgraph.operators import enrich, structure
from leafgraph.sources import adapters as A

NOW = 1_705_276_800


def now():
    return F.timestamp_seconds(F.lit(NOW))


def conv_summaries(spark, d):
    return A.convs(spark, d).select(
        "doc_id", "page_no", X.first_sentence(F.col("text")).alias("summary"), F.lit(False).alias("shortened")
    )


@query(
    "E1_previous_summaries",
    f"""WITH s AS (SELECT doc_id, page_no, {FIRST_SENTENCE} AS summary FROM convs)
    SELECT a.doc_id, a.page_no, coalesce(string_agg(b.summary, '|' ORDER BY b.page_no), '') AS previous FROM s a
    LEFT JOIN s b ON b.doc_id = a.doc_id AND b.page_no BETWEEN a.page_no - 3 AND a.page_no - 1
    GROUP BY a.doc_id, a.page_no""",
    ("convs",),
)
def e1(spark, d):
    out = enrich.previous_summaries(conv_summaries(spark, d), 3)
    return out.select("doc_id", "page_no", F.array_join("previous", "|").alias("previous"))


def trim_sql(c: str, n: int) -> str:
    return (
        f"CASE WHEN length({c}) > {n} THEN left({c}, {n // 2}) || {NL} || '...[truncated]...' || {NL} || "
        f"right({c}, {n // 2}) ELSE {c} END"
    )


@query("E2_trim_middle", f"SELECT doc_id, page_no, {trim_sql('text', 2048)} AS text FROM docs", ("docs",))
def e2(spark, d):
    return A.docs(spark, d).select("doc_id", "page_no", X.trim_middle(F.col("text"), 2048).alias("text"))


CTES["windows"] = f"""book_tocs AS (SELECT doc_id, string_agg(repeat('  ', depth) || number || ' ' || title
    || ' (p.' || CAST(page AS VARCHAR) || ')', {NL} ORDER BY seq) AS text FROM toc_tree GROUP BY doc_id),
  windows AS (SELECT doc_id, {trim_sql('text', 1024)} AS structure FROM book_tocs)"""


def windows(spark, d):
    toc = structure.outline_toc(A.outline(spark, d))
    return enrich.toc_window(structure.with_depth(toc), 1024)


@query("E2_toc_window", "SELECT * FROM windows", (*BOOK_TOC, "windows"), recursive=True)
def e2b(spark, d):
    return windows(spark, d)


SHORT = "Page {page} of {pages}{shortened} in:\n{structure}\n---\n{text}\n---\n{before}"


@query(
    "E3_build_prompts",
    f"""WITH s AS (SELECT doc_id, page_no, text, {FIRST_SENTENCE} AS summary,
        count(*) OVER (PARTITION BY doc_id) AS n FROM books),
      p AS (SELECT a.doc_id, a.page_no, a.text, a.n, coalesce(string_agg(b.summary, {NL} ORDER BY b.page_no), '') AS before
        FROM s a LEFT JOIN s b ON b.doc_id = a.doc_id AND b.page_no BETWEEN a.page_no - 2 AND a.page_no - 1 GROUP BY ALL),
      q AS (SELECT doc_id, page_no, 'Page ' || CAST(page_no + 1 AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) || ' in:' || {NL}
        || {trim_sql("coalesce(structure, '')", 1024)} || {NL} || '---' || {NL} || {trim_sql('text', 2048)} || {NL} || '---'
        || {NL} || before AS prompt FROM p LEFT JOIN windows w USING (doc_id))
    SELECT doc_id, page_no, prompt, md5(prompt) AS prompt_hash FROM q""",
    (*BOOK_TOC, "windows"),
    recursive=True,
)
def e3(spark, d):
    pages = A.books(spark, d)
    summaries = pages.select(
        "doc_id", "page_no", X.first_sentence(F.col("text")).alias("summary"), F.lit(False).alias("shortened")
    )
    return enrich.build_prompts(pages, windows(spark, d), summaries, template=SHORT)


def conv_prompts(spark, d):
    pages = A.convs(spark, d)
    empty = pages.select("doc_id", F.lit("").alias("structure")).distinct()
    return enrich.build_prompts(pages, empty, conv_summaries(spark, d))


@query("E4_score")
def e4(spark, d):
    return enrich.score(conv_prompts(spark, d), calls=8)


def answered(spark, d):
    """A cache: the even turns of the first half of the conversations, some too old."""
    rows = A.convs(spark, d).filter("page_no % 2 = 0")
    age = F.when(F.col("doc_id").cast("bigint") % 2 == 0, 60).otherwise(7200)
    return rows.select(
        F.md5("text").alias("prompt_hash"), F.lit("known").alias("response"),
        F.timestamp_seconds(F.lit(NOW) - age).alias("ts"),
    )


def plain_prompts(spark, d):
    return A.convs(spark, d).select(
        "doc_id", "page_no", F.md5("text").alias("prompt_hash"), F.col("text").alias("prompt")
    )


@query(
    "E5_uncached",
    """WITH cache AS (SELECT md5(text) AS h FROM convs WHERE page_no % 2 = 0 AND CAST(doc_id AS BIGINT) % 2 = 0)
    SELECT doc_id, page_no, md5(text) AS prompt_hash FROM convs c WHERE md5(text) NOT IN (SELECT h FROM cache)""",
    ("convs",),
)
def e5(spark, d):
    out = enrich.uncached(plain_prompts(spark, d), answered(spark, d), now())
    return out.select("doc_id", "page_no", "prompt_hash")


@query(
    "E5_score_cached",
    """WITH cache AS (SELECT md5(text) AS h FROM convs WHERE page_no % 2 = 0 AND CAST(doc_id AS BIGINT) % 2 = 0)
    SELECT doc_id, page_no, md5(text) IN (SELECT h FROM cache) AS cached FROM convs""",
    ("convs",),
)
def e5b(spark, d):
    answers, _ = enrich.score_cached(plain_prompts(spark, d), answered(spark, d), now())
    return answers.select("doc_id", "page_no", (F.col("response") == "known").alias("cached"))


CTES["resp"] = f"""resp_raw AS (SELECT event_id, '{{"summary":"' || event_type || '","key_concepts":["' || event_type
      || '","x"],"relationships":[["a","relates to","' || CAST(user_id AS VARCHAR) || '"]]'
      || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"ontology_tags":["t"],"confidence":' || CAST(event_id % 100 AS VARCHAR) || 'e-2' END
      || '}}' AS r FROM events),
  resp AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN left(r, length(r) - 1)
    WHEN event_id % 5 = 0 THEN 'Here:' || {NL} || '```json' || {NL} || r || {NL} || '```' ELSE r END AS response FROM resp_raw)"""


def resp(spark, d):
    """Answers: some broken, some fenced, some without tags and confidence."""
    e = A.table(spark, d, "events").select("event_id", "event_type", "user_id")
    body = F.concat(
        F.lit('{"summary":"'), "event_type", F.lit('","key_concepts":["'), "event_type",
        F.lit('","x"],"relationships":[["a","relates to","'), F.col("user_id").cast("string"), F.lit('"]]'),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(
            F.concat(F.lit(',"ontology_tags":["t"],"confidence":'), (F.col("event_id") % 100).cast("string"), F.lit("e-2"))
        ),
        F.lit("}"),
    )
    return e.withColumn("r", body).select(
        "event_id",
        F.when(F.col("event_id") % 7 == 0, F.left("r", F.length("r") - 1))
        .when(F.col("event_id") % 5 == 0, F.concat(F.lit("Here:\n```json\n"), "r", F.lit("\n```")))
        .otherwise(F.col("r"))
        .alias("response"),
    )


@query(
    "E6_parse_responses",
    """SELECT p.event_id, CASE WHEN p.event_id % 7 = 0 THEN response ELSE event_type END AS summary,
      CASE WHEN p.event_id % 7 = 0 THEN '' ELSE event_type || '|x' END AS key_concepts,
      CASE WHEN p.event_id % 7 = 0 THEN '' ELSE 'a|relates to|' || CAST(user_id AS VARCHAR) END AS relationships,
      CASE WHEN p.event_id % 7 = 0 OR p.event_id % 3 = 0 THEN '' ELSE 't' END AS ontology_tags,
      CASE WHEN p.event_id % 7 = 0 THEN 0.5 WHEN p.event_id % 3 = 0 THEN 0.7
        ELSE round(CAST(p.event_id % 100 AS DOUBLE) / 100, 6) END AS confidence
    FROM resp p JOIN events e ON e.event_id = p.event_id""",
    ("resp",),
)
def e6(spark, d):
    out = enrich.parse_responses(resp(spark, d))
    triple = F.transform("relationships", lambda r: F.concat_ws("|", r["source"], r["relation"], r["target"]))
    return out.select(
        "event_id", "summary", F.array_join("key_concepts", "|").alias("key_concepts"),
        F.array_join(triple, ";").alias("relationships"), F.array_join("ontology_tags", "|").alias("ontology_tags"),
        F.round("confidence", 6).alias("confidence"),
    )


@query("E7_validate_responses", "SELECT event_id, event_id % 7 <> 0 AND event_id % 3 <> 0 AS valid FROM events")
def e7(spark, d):
    return enrich.validate_responses(resp(spark, d)).select("event_id", "valid")


def usage(spark, d):
    models = F.create_map(
        F.lit("user"), F.lit("gpt-4o"), F.lit("assistant"), F.lit("gpt-4o-mini"), F.lit("system"), F.lit("phi-local")
    )
    return A.table(spark, d, "conversations").groupBy(
        F.col("conv_id").cast("string").alias("doc_id"), F.try_element_at(models, F.col("role")).alias("model")
    ).agg(
        F.sum(F.length("text")).alias("input_tokens"), F.count("*").alias("output_tokens"), F.count("*").alias("pages")
    )


CTES["usage"] = """usage AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id,
    CASE role WHEN 'user' THEN 'gpt-4o' WHEN 'assistant' THEN 'gpt-4o-mini' WHEN 'system' THEN 'phi-local' END AS model,
    sum(length(text)) AS input_tokens, count(*) AS n FROM conversations GROUP BY 1, 2)"""


@query(
    "E8_estimate_cost",
    """SELECT doc_id, round(sum(CASE model WHEN 'gpt-4o' THEN input_tokens * 5e-6 + n * 15e-6
      WHEN 'gpt-4o-mini' THEN input_tokens * 15e-8 + n * 6e-7 ELSE input_tokens * 1e-5 + n * 3e-5 END), 9) AS cost
    FROM usage GROUP BY doc_id""",
    ("usage",),
)
def e8(spark, d):
    return enrich.estimate_cost(usage(spark, d)).withColumn("cost", F.round("cost", 9))


@query(
    "E9_estimate_time",
    """SELECT doc_id, CAST(sum(n * CASE WHEN model = 'phi-local' THEN 3.0 ELSE 4.0 END) AS DOUBLE) AS seconds
    FROM usage GROUP BY doc_id""",
    ("usage",),
)
def e9(spark, d):
    return enrich.estimate_time(usage(spark, d))


@query(
    "E10_augment_prompts",
    f"""WITH q AS (SELECT item_id, list_sort(list_distinct({_toks("'The ' || left(text, 200)")})) AS ts FROM benchmark),
      qt AS (SELECT item_id, len(ts) AS n, unnest(ts) AS term FROM q),
      tf AS (SELECT node_id, term, sum(tf) AS tf FROM postings GROUP BY ALL),
      scored AS (SELECT item_id, n, tf.node_id, count(*) AS m, sum({BM25}) AS score FROM qt JOIN tf USING (term)
        JOIN term_df USING (term) JOIN lengths l ON l.node_id = tf.node_id GROUP BY item_id, n, tf.node_id),
      hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, node_id) AS rank
        FROM scored WHERE m = n) WHERE rank <= 3),
      blocks AS (SELECT item_id, rank, {NL} || '**Context ' || CAST(rank AS VARCHAR) || '** (' || path || '):' || {NL}
        || 'Tags: ' || (SELECT string_agg(tag, ', ' ORDER BY tag) FROM memo_tags t WHERE t.node_id = m.id) || {NL}
        || CASE WHEN content_summary <> '' THEN content_summary WHEN length(content) > 200 THEN left(content, 200) || '...'
          ELSE content END AS b FROM hits JOIN memo m ON m.id = hits.node_id),
      joined AS (SELECT item_id, string_agg(b, {NL} ORDER BY rank) AS body FROM blocks GROUP BY item_id)
    SELECT i.item_id AS query_id, CASE WHEN body IS NULL THEN 'The' ELSE 'The' || {NL} || {NL}
      || '### Relevant Context from Knowledge Graph:' || {NL} || body || {NL} || {NL} || '### Task:' || {NL}
      || 'Based on the above context, The' END AS prompt FROM benchmark i LEFT JOIN joined USING (item_id)""",
    MEMO_INDEX,
)
def e10(spark, d):
    items = A.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return enrich.augment_prompts(
        items, "The", memo_index(spark, d), memo(spark, d), memo_tags(spark, d), k=3, excerpt=200
    )


@query(
    "E10_augment_prompts_whole",
    f"""WITH q AS (SELECT item_id, list_sort(list_distinct({_toks("'The ' || text")})) AS ts FROM benchmark),
      qt AS (SELECT item_id, len(ts) AS n, unnest(ts) AS term FROM q),
      tf AS (SELECT node_id, term, sum(tf) AS tf FROM postings GROUP BY ALL),
      scored AS (SELECT item_id, n, tf.node_id, count(*) AS m, sum({BM25}) AS score FROM qt JOIN tf USING (term)
        JOIN term_df USING (term) JOIN lengths l ON l.node_id = tf.node_id GROUP BY item_id, n, tf.node_id),
      hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, node_id) AS rank
        FROM scored WHERE m = n) WHERE rank <= 3),
      blocks AS (SELECT item_id, rank, {NL} || '**Context ' || CAST(rank AS VARCHAR) || '** (' || path || '):' || {NL}
        || 'Tags: ' || (SELECT string_agg(tag, ', ' ORDER BY tag) FROM memo_tags t WHERE t.node_id = m.id) || {NL}
        || CASE WHEN content_summary <> '' THEN content_summary ELSE content END AS b
        FROM hits JOIN memo m ON m.id = hits.node_id),
      joined AS (SELECT item_id, string_agg(b, {NL} ORDER BY rank) AS body FROM blocks GROUP BY item_id)
    SELECT i.item_id AS query_id, CASE WHEN body IS NULL THEN 'The' ELSE 'The' || {NL} || {NL}
      || '### Relevant Context from Knowledge Graph:' || {NL} || body || {NL} || {NL} || '### Task:' || {NL}
      || 'Based on the above context, The' END AS prompt FROM benchmark i LEFT JOIN joined USING (item_id)""",
    MEMO_INDEX,
)
def e10_whole(spark, d):
    items = A.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return enrich.augment_prompts(
        items, "The", memo_index(spark, d), memo(spark, d), memo_tags(spark, d), k=3
    )


@query(
    "E11_results_to_nodes",
    f"""SELECT md5('documents|' || doc_id || '|metadata|result:' || CAST(page_no AS VARCHAR) || ':'
        || md5('Summarize|' || {FIRST_SENTENCE})) AS id,
      'AI Processing Result:' || {NL} || {NL} || 'Original Content:' || {NL} || text || {NL} || {NL} || 'Prompt:' || {NL} || 'Summarize' || {NL} || {NL}
        || 'Result:' || {NL} || {FIRST_SENTENCE} AS content,
      '/ai_results' AS path, {FIRST_SENTENCE} AS content_summary FROM convs""",
    ("convs",),
)
def e11(spark, d):
    rows = A.convs(spark, d).select(
        "doc_id", "page_no", F.col("text").alias("content"), F.lit("Summarize").alias("prompt"),
        X.first_sentence(F.col("text")).alias("result"),
    )
    nodes, _ = enrich.results_to_nodes(rows)
    return nodes.select("id", "content", "path", "content_summary")
