"""The operators as queries over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op8_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from leafgraph.llm import packing

    packed = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
        F.lit(0).cast("long").alias("offset"), "bucket",
    )


@query("op10_bpe")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from leafgraph.llm import bpe

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.round_trip(table(spark, folder, "documents"), ranks)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text("ids"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_site_template")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from leafgraph.llm import site_template

    return site_template.main_text(table(spark, folder, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from leafgraph.llm import toxicity

    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query("op6_multi_index")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from leafgraph.llm import multi_index

    return multi_index.search(table(spark, folder, "embeddings"), "vec_id % 20 = 0")


VALID = """
valid AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
"""


@query(
    "op9_knn_join",
    f"""
WITH {VALID},
whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM valid),
scored AS (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
    FROM whole q JOIN whole d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from leafgraph.llm import knn_join

    return knn_join.knn_join(table(spark, folder, "embeddings"), "vec_id % 20 = 0")


@query("op7_near_copies")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from leafgraph.llm import near_dedup

    return near_dedup.near_copies(table(spark, folder, "documents"), words=2)


@query("op5_repeats")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from leafgraph.llm import repeats

    found = repeats.cut_out(table(spark, folder, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op4_personal_data")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from leafgraph.llm import personal_data as P

    found = P.personal_spans(table(spark, folder, "documents"))

    def number(kind: int):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    n = [number(i).alias(f"n_{k}") for i, k in enumerate(P.KINDS)]
    return found.select("doc_id", *n, F.sha2(P.listed("base"), 256).alias("base_sha256"), P.listed("spans").alias("spans"))


@query("op3_pitman_yor")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from leafgraph.llm import pitman_yor, stages

    stages.short_batches(spark)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return pitman_yor.score(table(spark, folder, "documents"), held_out)


def _quality_sql() -> str:
    from leafgraph.llm import quality_rules as Q

    word = r"[^\x20\x09-\x0D]+"
    rates = {r: sql.replace(" div ", " // ") for r, (sql, _, _) in Q.RATES.items()}

    def level(name: str, keys: str) -> str:
        comma = f"{keys}, " if keys else ""
        bounds = []
        for r, (_, allowance, lower) in Q.RATES.items():
            bounds.append(f"max(CASE WHEN rate = '{r}' THEN q3 + greatest({Q.REACH} * (q3 - q1), {allowance}) END) AS high_{r}")
            if lower:
                bounds.append(f"max(CASE WHEN rate = '{r}' THEN q1 - greatest({Q.REACH} * (q3 - q1), {allowance}) END) AS low_{r}")
        return f"""{name} AS (SELECT {comma}max(n) AS n_docs, {', '.join(bounds)} FROM (
            SELECT {comma}rate, max(n) AS n, min(CASE WHEN 4 * seen >= n THEN bucket END) AS q1, min(CASE WHEN 4 * seen >= 3 * n THEN bucket END) AS q3
            FROM (SELECT *, sum(k) OVER (PARTITION BY {comma}rate ORDER BY bucket) AS seen, sum(k) OVER (PARTITION BY {comma}rate) AS n
                FROM (SELECT {comma}rate, bucket, count(*) AS k FROM buckets GROUP BY ALL)) GROUP BY ALL) {f'GROUP BY {keys}' if keys else ''})"""

    names = [f"{side}_{r}" for r, (_, _, lower) in Q.RATES.items() for side in (("high", "low") if lower else ("high",))]
    pick = ", ".join(
        f"CASE WHEN o.n_docs >= {Q.LEAST} THEN o.{c} WHEN l.n_docs >= {Q.LEAST} THEN l.{c} ELSE (SELECT {c} FROM whole) END AS {c}" for c in names)
    usual = " AND ".join(f"({rates[c.split('_', 1)[1]]}) {'<=' if c.startswith('high') else '>='} {c}" for c in names)
    value = "CASE rate " + " ".join(f"WHEN '{r}' THEN {sql}" for r, sql in rates.items()) + " END"
    rate_list = ", ".join(f"'{r}'" for r in rates)
    return f"""WITH split AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS l,
        row_number() OVER () AS row FROM documents),
    windows AS (SELECT row, unnest(range(1, len(w) - 1)) AS i, w FROM split),
    again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, w[i], w[i + 1], w[i + 2]) AS n FROM windows) WHERE n > 1),
    repeated AS (SELECT row, count(DISTINCT i + d) AS n FROM again, (SELECT unnest([0, 1, 2]) AS d) GROUP BY row),
    counts AS (SELECT row, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
        FROM split LEFT JOIN repeated USING (row)),
    judged AS (SELECT *, n_words < {Q.LEAST_WORDS} OR 100 * n_repeat_words > {Q.MOST_REPEATED} * n_words AS base_failed FROM counts),
    buckets AS (SELECT lang, source, rate, v >> greatest(length(bin(v)) - {Q.DIGITS}, 0) << greatest(length(bin(v)) - {Q.DIGITS}, 0) AS bucket
        FROM (SELECT lang, source, rate, {value} AS v FROM (SELECT *, unnest([{rate_list}]) AS rate FROM judged WHERE NOT base_failed))),
    {level('own', 'lang, source')}, {level('of_lang', 'lang')}, {level('whole', '')},
    found AS (SELECT o.lang, o.source, {pick} FROM own o LEFT JOIN of_lang l ON o.lang IS NOT DISTINCT FROM l.lang)
    SELECT doc_id, j.n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        CASE WHEN base_failed THEN false ELSE coalesce({usual}, false) END AS kept
    FROM judged j LEFT JOIN found f ON j.lang IS NOT DISTINCT FROM f.lang AND j.source IS NOT DISTINCT FROM f.source"""


@query("op12_quality_rules", _quality_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from leafgraph.llm import quality_rules

    return quality_rules.quality(table(spark, folder, "documents")).drop("lang", "source", "n_lines")


def _spelling_sql() -> str:
    from leafgraph.llm import spelling as S

    latin = "".join(chr(c) for c in range(0xC0, 0x100))
    # One byte for each letter, as edits are to be counted in code points.
    plain = "".join(chr(c) for c in range(33, 127) if not chr(c).islower() and chr(c) not in "'")[:64]
    code = "CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)] END"
    return f"""WITH RECURSIVE
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
    runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id,
        unnest(regexp_extract_all(translate(text, '{S.UPPER}', '{S.LOWER}'), '{S.LETTERS}')) AS run FROM documents) GROUP BY ALL),
    bytes AS (SELECT *, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda x: {code})) AS b FROM runs),
    hashed AS (SELECT doc_id, run, k, xor(4294967295, list_reduce(list_prepend(4294967295, CAST(b AS BIGINT[])),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM bytes, crc_table),
    heard AS (SELECT k, CASE WHEN doc_id IS NOT NULL AND h % 199 = 0
        THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) + 2 AS INTEGER)) ELSE run END AS word FROM hashed),
    vocabulary AS (SELECT word, CAST(sum(k) AS BIGINT) AS n, translate(word, '{latin}', '{plain}') AS w, length(word) AS size
        FROM heard WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
    near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM vocabulary a JOIN vocabulary b
        ON b.size BETWEEN a.size - 1 AND a.size + 1 AND levenshtein(a.w, b.w) = 1),
    best AS (SELECT word, count(*) AS n_near, min_by(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
    found AS (SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form,
        CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n FROM vocabulary v LEFT JOIN best USING (word)),
    walk AS (SELECT word, word AS here, 0 AS step FROM found
        UNION ALL SELECT walk.word, found.form, step + 1 FROM walk JOIN found ON found.word = walk.here WHERE found.form IS NOT NULL),
    last AS (SELECT word, max_by(here, step) AS root FROM walk GROUP BY word)
    SELECT word, n, n_near, form, form_n, root FROM found JOIN last USING (word)"""


@query("op13_spelling_variants", _spelling_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from leafgraph.llm import spelling

    return spelling.variants(spelling.words(table(spark, folder, "documents")))


@query(
    "op11_hard_negatives",
    """
WITH valid AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, x.vec_id, x.label = a.label AS same, CAST(list_inner_product(a.v, x.v) AS BIGINT) AS score
    FROM valid a JOIN valid x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0),
positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from leafgraph.llm import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"), "vec_id % 100 = 0", label)
