"""Lexical analysis."""

from pyspark.sql import functions as F

from leafgraph.checks.base import CTES, NL, STOP_SQL, WS, lit, query, tokens_sql
from leafgraph.functions import patterns as P
from leafgraph.functions import text as X
from leafgraph.functions.stem import porter_sql
from leafgraph.operators import lexical
from leafgraph.sources import adapters as A


def sentences_cte(name: str, source: str) -> str:
    return f"""{name}_lists AS (
    SELECT doc_id, page_no, list_filter(list_transform(regexp_split_to_array(text, {lit(P.SENTENCE_END)}),
      lambda s: trim(s, {WS})), lambda s: s <> '') AS ss FROM {source}),
  {name} AS (SELECT doc_id, page_no, CAST(generate_subscripts(ss, 1) - 1 AS BIGINT) AS sent_no,
    unnest(ss) AS sentence FROM {name}_lists)"""


CTES["sents"] = sentences_cte("sents", "docs")
CTES["conv_sents"] = sentences_cte("conv_sents", "convs")
CTES["tokens"] = f"""tokens AS (SELECT * FROM (
  SELECT doc_id, page_no, unnest({tokens_sql('text')}) AS token FROM docs) WHERE token NOT IN {STOP_SQL})"""
CTES["stems"] = """stems AS (
  SELECT doc_id, page_no, stem, list_sort(list(DISTINCT token)) AS words, count(*) AS freq FROM (
    SELECT *, CASE WHEN token LIKE '%sses' OR token LIKE '%ies' THEN left(token, length(token) - 2)
      WHEN token LIKE '%ss' THEN token WHEN token LIKE '%s' THEN left(token, length(token) - 1)
      ELSE token END AS stem FROM tokens) GROUP BY doc_id, page_no, stem)"""
CTES["scores"] = """scores AS (
  SELECT doc_id, page_no, term, freq, (freq / total) * ((freq / total) / 0.5) * ln(freq + 1) AS significance
  FROM (SELECT doc_id, page_no, token AS term, CAST(count(*) AS DOUBLE) AS freq,
      CAST(sum(count(*)) OVER (PARTITION BY doc_id, page_no) AS DOUBLE) AS total
    FROM tokens GROUP BY doc_id, page_no, token))"""
LEX = ("docs", "tokens")


def pages(spark, d):
    return A.docs(spark, d).drop("domain")


@query("L1_sentences", "SELECT * FROM sents", ("docs", "sents"))
def l1(spark, d):
    out = lexical.sentences(pages(spark, d))
    return out.withColumn("sent_no", F.col("sent_no").cast("bigint"))


@query(
    "L2_tokens",
    "SELECT doc_id, page_no, token, count(*) AS n FROM tokens GROUP BY doc_id, page_no, token",
    LEX,
)
def l2(spark, d):
    return lexical.tokens(pages(spark, d)).groupBy("doc_id", "page_no", "token").agg(F.count("*").alias("n"))


@query(
    "L3_stems_light",
    "SELECT doc_id, page_no, stem, array_to_string(words, '|') AS words, freq FROM stems",
    (*LEX, "stems"),
)
def l3(spark, d):
    return lexical.stems(pages(spark, d), "light").withColumn("words", F.array_join("words", "|"))


CTES["porter_stems"] = porter_sql("stem_of", "(SELECT token AS word FROM tokens)") + """,
  porter_stems AS (
    SELECT doc_id, page_no, stem, list_sort(list(DISTINCT token)) AS words, count(*) AS freq
    FROM tokens JOIN stem_of ON word = token GROUP BY doc_id, page_no, stem)"""


@query(
    "L3_stems_porter",
    "SELECT doc_id, page_no, stem, array_to_string(words, '|') AS words, freq FROM porter_stems",
    (*LEX, "porter_stems"),
)
def l3b(spark, d):
    return lexical.stems(pages(spark, d)).withColumn("words", F.array_join("words", "|"))


CTES["tf_idf"] = """tf_idf AS (
  SELECT s.doc_id, s.page_no, s.stem, s.freq, f.df,
    s.freq * ln(CAST((SELECT count(*) FROM docs) AS DOUBLE) / f.df) AS tf_idf
  FROM stems s JOIN (SELECT stem, count(*) AS df FROM stems GROUP BY stem) f ON f.stem = s.stem)"""


@query(
    "L4_tf_idf",
    "SELECT doc_id, page_no, stem, freq, df, round(tf_idf, 6) AS tf_idf FROM tf_idf",
    (*LEX, "stems", "tf_idf"),
)
def l4(spark, d):
    p = pages(spark, d)
    return lexical.tf_idf(lexical.stems(p, "light"), p).select(
        "doc_id", "page_no", "stem", "freq", "df", F.round("tf_idf", 6).alias("tf_idf")
    )


@query(
    "L5_significance",
    "SELECT doc_id, page_no, term, CAST(freq AS BIGINT) AS freq, round(significance, 6) AS significance FROM scores",
    (*LEX, "scores"),
)
def l5(spark, d):
    return lexical.significance(pages(spark, d)).withColumn("significance", F.round("significance", 6))


@query(
    "L5_significance_priors",
    f"""WITH priors AS (SELECT token AS term, least(count(*) / 100.0, CAST(1.0 AS DOUBLE)) AS prior FROM (
        SELECT unnest({tokens_sql('text')}) AS token FROM benchmark) GROUP BY token),
    counted AS (SELECT doc_id, page_no, token AS term, CAST(count(*) AS DOUBLE) AS freq,
      CAST(sum(count(*)) OVER (PARTITION BY doc_id, page_no) AS DOUBLE) AS total
      FROM tokens GROUP BY doc_id, page_no, token)
    SELECT doc_id, page_no, c.term, CAST(freq AS BIGINT) AS freq,
      round((freq / total) * ((freq / total) / coalesce(prior, CAST(0.1 AS DOUBLE))) * ln(freq + 1), 6) AS significance
    FROM counted c LEFT JOIN priors p ON p.term = c.term""",
    LEX,
)
def l5b(spark, d):
    words = A.table(spark, d, "benchmark").select(F.explode(X.token_array(F.col("text"))).alias("term"))
    priors = words.groupBy("term").agg(
        F.least(F.count("*") / F.lit(100.0), F.lit(1.0)).alias("prior")
    )
    return lexical.significance(pages(spark, d), priors).withColumn(
        "significance", F.round("significance", 6)
    )


CTES["key_terms"] = """ranked_terms AS (
    SELECT *, CASE WHEN term LIKE '%sses' OR term LIKE '%ies' THEN left(term, length(term) - 2)
      WHEN term LIKE '%ss' THEN term WHEN term LIKE '%s' THEN left(term, length(term) - 1)
      ELSE term END AS stem,
      row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round(significance, 9) DESC, term) AS rank
    FROM scores WHERE significance > 0.02),
  key_terms AS (
    SELECT r.doc_id, r.page_no, r.term, r.stem, r.significance, r.rank, s.freq AS frequency,
      list_filter(s.words, lambda w: w <> r.term) AS related,
      coalesce((SELECT list(sentence ORDER BY sent_no) FROM sents x WHERE x.doc_id = r.doc_id
        AND x.page_no = r.page_no AND contains(lower(x.sentence), r.term)), []) AS contexts
    FROM ranked_terms r JOIN stems s ON s.doc_id = r.doc_id AND s.page_no = r.page_no AND s.stem = r.stem
    WHERE r.rank <= 20)"""


@query(
    "L6_key_terms",
    """SELECT doc_id, page_no, term, stem, rank, frequency, round(significance, 6) AS significance,
      array_to_string(related, '|') AS related, array_to_string(contexts, '|') AS contexts FROM key_terms""",
    (*LEX, "sents", "stems", "scores", "key_terms"),
)
def l6(spark, d):
    out = lexical.key_terms(pages(spark, d), threshold=0.02, stemmer="light")
    return out.withColumns(
        {
            "rank": F.col("rank").cast("bigint"),
            "significance": F.round("significance", 6),
            "related": F.array_join("related", "|"),
            "contexts": F.array_join("contexts", "|"),
        }
    )


def _entity_sql(piece: str) -> str:
    ws = f"list_filter(regexp_extract_all({piece}, {lit(P.TOKEN)}), lambda w: w NOT IN {STOP_SQL})"
    return f"nullif(array_to_string(list_slice({ws}, greatest(len({ws}) - 2, 1), len({ws})), ' '), '')"


_IND = ", ".join(f"({lit(p)}, {lit(t)})" for p, t in P.RELATION_INDICATORS)
CTES["pattern_rel"] = f"""pattern_rel AS (
  SELECT * FROM (SELECT doc_id, page_no, sent_no, sentence,
      {_entity_sql("split_part(lower(sentence), phrase, 1)")} AS source,
      {_entity_sql("split_part(lower(sentence), phrase, 2)")} AS target, type, CAST(0.7 AS DOUBLE) AS strength
    FROM sents JOIN (VALUES {_IND}) i(phrase, type) ON contains(lower(sentence), phrase))
  WHERE source IS NOT NULL AND target IS NOT NULL)"""


@query(
    "L7_pattern_relations",
    "SELECT doc_id, page_no, sent_no, source, target, type, strength FROM pattern_rel",
    ("docs", "sents", "pattern_rel"),
)
def l7(spark, d):
    out = lexical.pattern_relations(lexical.sentences(pages(spark, d)))
    return out.withColumn("sent_no", F.col("sent_no").cast("bigint"))


CTES["ents"] = f"""ent_tokens AS (
    SELECT doc_id, page_no, sent_no, ts, generate_subscripts(ts, 1) AS i, unnest(ts) AS t FROM (
      SELECT doc_id, page_no, sent_no, regexp_extract_all(sentence, {lit(P.ENTITY_TOKEN)}) AS ts FROM sents)),
  ent_runs AS (
    SELECT *, regexp_matches(t, '^\\p{{Lu}}') AS cap,
      coalesce(min(CASE WHEN NOT regexp_matches(t, '^\\p{{Lu}}') THEN i END) OVER (
        PARTITION BY doc_id, page_no, sent_no ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
        len(ts) + 1) AS stop FROM ent_tokens),
  ents AS (
    SELECT DISTINCT doc_id, page_no, sent_no, array_to_string(list_slice(ts, i, stop - 1), ' ') AS entity
      FROM ent_runs WHERE cap AND lower(t) NOT IN {STOP_SQL}
    UNION
    SELECT doc_id, page_no, sent_no, lower(t) FROM ent_runs WHERE regexp_matches(lower(t), {lit(P.TECHNICAL)}))"""
ENT = ("docs", "sents", "ents")


@query("L8_entities", "SELECT doc_id, page_no, sent_no, entity FROM ents", ENT)
def l8(spark, d):
    out = lexical.entities(lexical.sentences(pages(spark, d)))
    return out.select("doc_id", "page_no", F.col("sent_no").cast("bigint").alias("sent_no"), F.explode("entities").alias("entity"))


CTES["cooc"] = """keyed AS (SELECT doc_id, page_no, sent_no, md5(entity) AS key FROM ents),
  cooc AS (
  SELECT a.doc_id, a.page_no, a.sent_no, a.key AS source_key, b.key AS target_key, 'co_occurrence' AS type,
    CAST(0.5 AS DOUBLE) AS strength
  FROM keyed a JOIN keyed b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.sent_no = b.sent_no
    AND a.key < b.key)"""


@query("L9_cooccurrence", "SELECT * FROM cooc", (*ENT, "cooc"))
def l9(spark, d):
    out = lexical.cooccurrence(lexical.entity_keys(lexical.sentences(pages(spark, d))))
    return out.withColumn("sent_no", F.col("sent_no").cast("bigint"))


CTES["relations"] = """relations AS (
  SELECT doc_id, page_no, source_key, target_key, type, least(sum(strength), 1.0) AS strength,
    list_sort(list(DISTINCT sent_no)) AS evidence_at
  FROM (SELECT doc_id, page_no, sent_no, md5(source) AS source_key, md5(target) AS target_key, type, strength
      FROM pattern_rel UNION ALL SELECT * FROM cooc)
  GROUP BY doc_id, page_no, source_key, target_key, type)"""
REL = (*ENT, "pattern_rel", "cooc", "relations")


@query(
    "L10_merge_relations",
    """SELECT doc_id, page_no, source_key, target_key, type, round(strength, 6) AS strength,
      array_to_string(list_transform(evidence_at, lambda i: CAST(i AS VARCHAR)), '|') AS evidence_at
    FROM relations""",
    REL,
)
def l10(spark, d):
    out = lexical.page_relations(pages(spark, d))
    return out.withColumns(
        {
            "strength": F.round("strength", 6),
            "evidence_at": F.array_join(F.col("evidence_at").cast("array<string>"), "|"),
        }
    )


CTES["page_analysis"] = """page_analysis AS (
  SELECT d.doc_id, d.page_no, coalesce(a.n, 0) AS total_stems, coalesce(b.n, 0) AS unique_terms,
    coalesce(c.n, 0) AS relationships, coalesce(b.s, 0) AS avg_significance
  FROM docs d
  LEFT JOIN (SELECT doc_id, page_no, count(*) AS n FROM stems GROUP BY ALL) a USING (doc_id, page_no)
  LEFT JOIN (SELECT doc_id, page_no, count(*) AS n, avg(significance) AS s FROM scores GROUP BY doc_id, page_no) b
    USING (doc_id, page_no)
  LEFT JOIN (SELECT doc_id, page_no, count(*) AS n FROM relations GROUP BY ALL) c USING (doc_id, page_no))"""


@query(
    "L11_analysis_stats",
    """SELECT doc_id, page_no, total_stems, unique_terms, relationships,
      round(avg_significance, 6) AS avg_significance FROM page_analysis""",
    ("docs", "tokens", "sents", "ents", "pattern_rel", "cooc", "relations", "stems", "scores", "page_analysis"),
)
def l11(spark, d):
    out = lexical.analysis_stats(pages(spark, d), "light")
    return out.withColumn("avg_significance", F.round("avg_significance", 6))


@query(
    "L11_corpus_stats",
    """SELECT CAST(sum(n) AS BIGINT) AS total_stems, count(*) AS unique_stems,
      (SELECT count(*) FROM relations) AS relationships
    FROM (SELECT stem, count(*) AS n FROM stems GROUP BY stem)""",
    ("docs", "tokens", "sents", "ents", "pattern_rel", "cooc", "relations", "stems"),
)
def l11b(spark, d):
    return lexical.corpus_stats(pages(spark, d), "light")


@query(
    "L12_first_sentence",
    "SELECT doc_id, page_no, left(regexp_split_to_array(text, '[.!?]\\s+')[1], 500) AS summary FROM docs",
    ("docs",),
)
def l12(spark, d):
    return pages(spark, d).select("doc_id", "page_no", X.first_sentence(F.col("text")).alias("summary"))


_COUNT = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"
CTES["summaries"] = f"""summary_parts AS (
    SELECT doc_id, page_no, text, len(regexp_extract_all(text, {lit(P.WORD)})) AS words,
      string_split(text, {NL})[1] AS line,
      string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM docs),
  summary_start AS (
    SELECT *, concat_ws(' ', CASE WHEN line = '' OR ends_with(line, '.') THEN line
      ELSE trim(line, {WS}) || '.' END, ss[2]) AS start FROM summary_parts),
  summaries AS (
    SELECT doc_id, page_no, words > 75 AS shortened, CASE WHEN words <= 75 THEN text
      ELSE concat_ws(' ', start, CASE WHEN {_COUNT.format('start')} < 75 THEN ss[3] END) END AS summary
    FROM summary_start)"""


@query("L13_summarize_short", "SELECT * FROM summaries", ("docs", "summaries"))
def l13(spark, d):
    return lexical.summarize(pages(spark, d), ratio=0.0)


@query("L13_summarize_ranked")
def l13b(spark, d):
    return lexical.summarize(pages(spark, d))


def _textrank_sql(rounds: int) -> str:
    """The same iteration over explicit pairs, one step per common table."""
    steps = [
        f"""r{i} AS (SELECT n.id, 0.15 + 0.85 * coalesce(sum(e.w / e.total * p.score), 0) AS score
        FROM nodes n LEFT JOIN shares e ON e.b = n.id LEFT JOIN r{i - 1} p ON p.id = e.a GROUP BY n.id)"""
        for i in range(1, rounds + 1)
    ]
    return f"""WITH nodes AS (
      SELECT row_number() OVER (ORDER BY doc_id, page_no, sent_no) AS id, * FROM (
        SELECT doc_id, page_no, sent_no, sentence,
          list_filter({tokens_sql('sentence')}, lambda w: w NOT IN {STOP_SQL}) AS ts FROM conv_sents)),
    words AS (SELECT DISTINCT id, doc_id, page_no, unnest(ts) AS t, len(ts) AS n FROM nodes),
    edges AS (SELECT a.id AS a, b.id AS b, count(*) / (ln(a.n) + ln(b.n)) AS w
      FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.t = b.t AND a.id <> b.id
      WHERE a.n > 1 OR b.n > 1 GROUP BY a.id, b.id, a.n, b.n),
    shares AS MATERIALIZED (SELECT a, b, w, sum(w) OVER (PARTITION BY a) AS total FROM edges),
    r0 AS (SELECT id, CAST(1 AS DOUBLE) AS score FROM nodes), {', '.join(steps)}
    SELECT doc_id, page_no, sent_no, sentence, round(score, 6) AS score FROM nodes JOIN r{rounds} USING (id)"""


@query("L14_textrank", _textrank_sql(20), ("convs", "conv_sents"))
def l14(spark, d):
    out = lexical.textrank(A.convs(spark, d))
    return out.withColumns({"sent_no": F.col("sent_no").cast("bigint"), "score": F.round("score", 6)})


@query(
    "G20_thresholds",
    """SELECT 'stem' AS kind, count(*) AS n FROM stems WHERE freq >= 2
    UNION ALL SELECT 'relation', count(*) FROM relations WHERE strength >= 0.7""",
    ("docs", "tokens", "sents", "ents", "pattern_rel", "cooc", "relations", "stems"),
)
def g20(spark, d):
    p = pages(spark, d)
    kept_stems = lexical.stems(p, "light", min_frequency=2).agg(F.count("*").alias("n"))
    kept_relations = lexical.page_relations(p, min_strength=0.7).agg(F.count("*").alias("n"))
    return kept_stems.select(F.lit("stem").alias("kind"), "n").unionByName(
        kept_relations.select(F.lit("relation").alias("kind"), "n")
    )
