"""Batch enrichment: what goes into a model, the call as a hook, what comes out.

A hook is ``Callable[[Iterator[pandas.DataFrame]], Iterator[pandas.DataFrame]]`` from
``prompt_hash, prompt`` to ``prompt_hash, response``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.config import Settings
from leafgraph.functions import patterns as P
from leafgraph.functions import text as X
from leafgraph.functions.rules import score_by_rules
from leafgraph.operators.graph import _nodes
from leafgraph.operators.ordered import attach, ranked
from leafgraph.operators.search import Index, index_tokens, search_batch, tag_arrays

PAGE = ["doc_id", "page_no"]

TEMPLATE = """Describe one page of a document in the light of its structure.

## Structure
{structure}

## Page
{page} of {pages}{shortened}

## Text
{text}

## Before
{before}

## Answer
One JSON object with summary, key_concepts (list), relationships (list of
[source, relation, target]), ontology_tags (list) and confidence (0 to 1)."""


def previous_summaries(summaries: DataFrame, n: int = 3) -> DataFrame:
    """Adds ``previous``: the summaries of the ``n`` pages before, in order; gaps are skipped.

    Every page hands its summary to the next ``n`` page numbers, so the groups have at
    most ``n`` rows however long the document is.
    """
    given = summaries.filter("summary is not null").select(
        "doc_id",
        F.explode(F.sequence(F.col("page_no") + 1, F.col("page_no") + n)).alias("to"),
        F.struct("page_no", "summary").alias("s"),
    )
    lists = given.groupBy("doc_id", F.col("to").alias("page_no")).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return summaries.join(lists, PAGE, "left").withColumn(
        "previous",
        F.coalesce(F.transform("s", lambda r: r["summary"]), F.array().cast("array<string>")),
    ).drop("s")


def toc_window(toc: DataFrame, budget: int = 1024, block: int = 4096) -> DataFrame:
    """Indented contents of each document within ``budget`` characters, cut in the middle.

    A line has at least one character, so the first and the last ``budget`` lines are
    enough; a long table of contents is never put together.
    """
    line = F.concat(
        F.repeat(F.lit("  "), F.col("depth")), "number", F.lit(" "), "title", F.lit(" (p."),
        F.col("page").cast("string"), F.lit(")"),
    )
    rows = ranked(toc.select("doc_id", "seq", line.alias("line")), ["doc_id"], ["seq"], block, "i")
    sizes = rows.groupBy("doc_id").agg(
        F.count("*").alias("n"), (F.sum(F.length("line") + 1) - 1).alias("size")
    )
    ends = (
        attach(rows, sizes, "doc_id", "i")
        .filter((F.col("i") < budget) | (F.col("i") >= F.col("n") - budget))
        .groupBy("doc_id", "size", "n")
        .agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("r"))
    )
    def joined(keep) -> Column:
        return F.array_join(F.transform(F.filter("r", keep), lambda x: x["line"]), "\n")

    half = budget // 2
    head = joined(lambda x: x["i"] < budget)
    tail = joined(lambda x: x["i"] >= F.col("n") - budget)
    whole = joined(lambda x: F.lit(True))
    text = F.when(F.col("size") <= budget, whole).otherwise(
        F.concat(F.left(head, F.lit(half)), F.lit("\n...[truncated]...\n"), F.right(tail, F.lit(half)))
    )
    return ends.select("doc_id", text.alias("structure"))


def build_prompts(
    pages: DataFrame, structure: DataFrame, summaries: DataFrame, window: int = 4096, context: int = 2,
    template: str = TEMPLATE,
) -> DataFrame:
    """``doc_id, page_no, prompt_hash, prompt``.

    ``structure`` is ``doc_id, structure``; ``summaries`` is ``doc_id, page_no, summary,
    shortened``.  Pages do not wait for each other: their context is the extractive
    summaries of the pages before.
    """
    documents = pages.groupBy("doc_id").agg(F.count("*").alias("_pages")).join(structure, "doc_id", "left")
    before = previous_summaries(summaries.select(*PAGE, "summary", "shortened"), context)
    rows = (
        attach(pages.select(*PAGE, "text"), documents, "doc_id", "page_no")
        .join(before.select(*PAGE, "previous", "shortened"), PAGE, "left")
    )
    cells = {
        "structure": X.trim_middle(F.coalesce("structure", F.lit("")), window // 4),
        "page": (F.col("page_no") + 1).cast("string"),
        "pages": F.col("_pages").cast("string"),
        "shortened": F.when(F.coalesce("shortened", F.lit(False)), " (long text)").otherwise(""),
        "text": X.trim_middle(F.col("text"), window // 2),
        "before": F.coalesce(F.array_join("previous", "\n"), F.lit("")),
    }
    # The template is cut at its fields: text of a page can not be taken for a field.
    pieces = []
    for piece in template.split("{"):
        name, brace, rest = piece.partition("}")
        if brace and name in cells:
            pieces += [cells[name], F.lit(rest)]
        else:
            pieces.append(F.lit(piece))
    prompt = F.concat(*pieces)
    return rows.select(*PAGE, prompt.alias("prompt")).withColumn("prompt_hash", F.md5("prompt"))


def score(prompts: DataFrame, hook: Callable = score_by_rules, calls: int | None = None) -> DataFrame:
    """``prompt_hash, response`` of distinct prompts; ``calls`` bounds the calls at a time."""
    distinct = prompts.select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"])
    if calls is not None:
        distinct = distinct.repartition(calls, "prompt_hash")
    return distinct.mapInPandas(hook, "prompt_hash string, response string")


def uncached(prompts: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Prompts without an answer that is still fresh."""
    fresh = cache.filter(F.unix_seconds("ts") > F.unix_seconds(now.cast("timestamp")) - ttl_seconds)
    return prompts.join(fresh.select("prompt_hash"), "prompt_hash", "left_anti")


def score_cached(
    prompts: DataFrame, cache: DataFrame, now: Column, hook: Callable = score_by_rules,
    ttl_seconds: int = 3600, calls: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answers for all prompts, and the new rows to append to the cache."""
    fresh = cache.filter(F.unix_seconds("ts") > F.unix_seconds(now.cast("timestamp")) - ttl_seconds)
    new = score(uncached(prompts, cache, now, ttl_seconds), hook, calls).withColumn("ts", now.cast("timestamp"))
    latest = fresh.groupBy("prompt_hash").agg(F.max_by("response", "ts").alias("response"))
    known = latest.join(prompts.select("prompt_hash"), "prompt_hash", "left_semi")
    answers = known.unionByName(new.select("prompt_hash", "response"))
    return prompts.select(*PAGE, "prompt_hash").join(answers, "prompt_hash"), new


# --- answers ----------------------------------------------------------------------------

FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
FIELDS = (
    "summary STRING, semantic_summary STRING, key_concepts ARRAY<STRING>, key_insights ARRAY<STRING>, "
    "ontology_tags ARRAY<STRING>, confidence DOUBLE, confidence_score DOUBLE, evidence ARRAY<STRING>"
)


def json_text(c: Column) -> Column:
    """The JSON in a fenced block, or the whole answer."""
    fenced = F.regexp_extract(c, FENCE, 1)
    return F.when(fenced != "", fenced).otherwise(X.clean(c))


def parse_responses(responses: DataFrame, default_confidence: float = 0.7) -> DataFrame:
    """Typed fields of each answer; text that is no JSON object becomes the summary at 0.5."""
    body = responses.withColumn("_json", json_text(F.col("response")))
    body = body.withColumn("_ok", F.try_parse_json("_json").isNotNull() & F.col("_json").startswith("{"))
    text = F.when(F.col("_ok"), F.col("_json"))
    triples = F.from_json(text, "relationships ARRAY<ARRAY<STRING>>")["relationships"]
    objects = F.from_json(
        text, "relationships ARRAY<STRUCT<concept1: STRING, relationship: STRING, concept2: STRING>>"
    )["relationships"]

    def relation(source, kind, target):
        return F.struct(source.alias("source"), kind.alias("relation"), target.alias("target"))

    from_triples = F.transform(
        F.filter(triples, lambda t: F.size(t) >= 3),
        lambda t: relation(F.get(t, F.lit(0)), F.get(t, F.lit(1)), F.get(t, F.lit(2))),
    )
    from_objects = F.transform(
        F.filter(objects, lambda o: o["concept2"].isNotNull()),
        lambda o: relation(o["concept1"], o["relationship"], o["concept2"]),
    )
    none = F.array().cast("array<string>")
    no_relation = F.array().cast("array<struct<source: string, relation: string, target: string>>")
    keep = [c for c in responses.columns if c != "response"]
    parsed = body.withColumns({"_p": F.from_json(text, FIELDS), "_t": from_triples, "_o": from_objects})
    return parsed.select(
        *keep,
        F.when(F.col("_ok"), F.coalesce("_p.summary", "_p.semantic_summary", F.lit(""))).otherwise(F.col("response")).alias("summary"),
        F.coalesce("_p.key_concepts", "_p.key_insights", none).alias("key_concepts"),
        F.when(F.size(F.coalesce("_t", no_relation)) > 0, F.col("_t")).otherwise(F.coalesce("_o", no_relation)).alias("relationships"),
        F.coalesce("_p.ontology_tags", none).alias("ontology_tags"),
        F.when(
            F.col("_ok"), F.coalesce("_p.confidence", "_p.confidence_score", F.lit(default_confidence))
        ).otherwise(0.5).alias("confidence"),
        F.coalesce("_p.evidence", none).alias("evidence"),
    )


# Fields an answer must have.
REQUIRED_FIELDS = ["summary", "key_concepts", "relationships", "ontology_tags", "confidence"]


def validate_responses(responses: DataFrame) -> DataFrame:
    """Adds ``valid``: all fields are there, lists are lists and the confidence is a number."""
    body = responses.withColumn("_v", F.try_parse_json(json_text(F.col("response"))))

    def kind(field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(F.col("_v"), f"$.{field}", "variant"))

    valid = F.lit(True)
    for field in REQUIRED_FIELDS:
        valid = valid & kind(field).isNotNull()
    for field in ("key_concepts", "relationships"):
        valid = valid & kind(field).startswith("ARRAY")
    valid = valid & kind("confidence").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return body.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("_v")


# --- estimates ----------------------------------------------------------------------------


def estimate_cost(usage: DataFrame, prices: dict = P.MODEL_PRICES, default=P.DEFAULT_PRICE) -> DataFrame:
    """Dollars per document of ``doc_id, model, input_tokens, output_tokens``."""
    def price(i: int) -> Column:
        cells = [F.lit(x) for m, p in prices.items() for x in (m, p[i])]
        return F.coalesce(F.try_element_at(F.create_map(*cells), F.col("model")), F.lit(default[i]))

    cost = F.col("input_tokens") * price(0) + F.col("output_tokens") * price(1)
    return usage.groupBy("doc_id").agg(F.sum(cost).alias("cost"))


def seconds_per_page(model: Column) -> Column:
    out = F.lit(P.DEFAULT_SECONDS_PER_PAGE)
    for word, seconds in reversed(P.SECONDS_PER_PAGE):
        out = F.when(F.contains(F.lower(model), F.lit(word)), seconds).otherwise(out)
    return out


def estimate_time(usage: DataFrame) -> DataFrame:
    """Seconds per document of ``doc_id, model, pages``."""
    return usage.groupBy("doc_id").agg(F.sum(F.col("pages") * seconds_per_page(F.col("model"))).alias("seconds"))


# --- retrieval and results -------------------------------------------------------------------


def augment_prompts(
    items: DataFrame, instruction: str, index: Index, nodes: DataFrame, tags: DataFrame,
    k: int = 5, excerpt: int | None = None,
) -> DataFrame:
    """``query_id, prompt``: the instruction with up to ``k`` related nodes of each item.

    ``items`` is ``query_id, text``.  The words of the instruction and of the text
    must all occur in a node, as in a plain full-text match.  With ``excerpt`` only so many
    characters of the text are asked for, and of a node without a summary shown.
    """
    text, whole = F.col("text"), F.col("content")
    if excerpt is not None:
        text = F.left(text, F.lit(excerpt))
        whole = F.when(F.length("content") > excerpt, F.concat(F.left("content", F.lit(excerpt)), F.lit("..."))).otherwise(whole)
    asked = F.concat(F.lit(instruction + " "), text)
    queries = items.select("query_id", index_tokens(asked, index.stemmer).alias("terms"))
    hits = search_batch(index, queries, k).select("query_id", "node_id", "rank")
    used = hits.select("node_id").distinct()
    content = F.when(F.coalesce("content_summary", F.lit("")) != "", F.col("content_summary")).otherwise(whole)
    shown = (
        nodes.join(used, nodes["id"] == used["node_id"], "left_semi")
        .select(F.col("id").alias("node_id"), "path", content.alias("shown"))
        .join(tag_arrays(tags.join(used, "node_id", "left_semi")), "node_id", "left")
    )
    block = F.concat(
        F.lit("\n**Context "), F.col("rank").cast("string"), F.lit("** ("), "path", F.lit("):\n"),
        F.when(F.size("tags") > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", "), F.lit("\n"))).otherwise(""),
        "shown",
    )
    contexts = (
        hits.join(shown, "node_id")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    )
    head = "\n\n### Relevant Context from Knowledge Graph:\n"
    foot = f"\n\n### Task:\nBased on the above context, {instruction}"
    prompt = F.concat(
        F.lit(instruction + head), F.array_join(F.transform("bs", lambda x: x["b"]), "\n"), F.lit(foot)
    )
    return items.select("query_id").join(contexts, "query_id", "left").select(
        "query_id", F.coalesce(prompt, F.lit(instruction)).alias("prompt")
    )


def results_to_nodes(results: DataFrame, space: str = Settings.domain, keep: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and tags for answers worth keeping: ``doc_id, page_no, content, prompt, result``.

    With ``keep`` only so many characters of the content are stored.
    """
    some = F.col("content")
    if keep is not None:
        some = F.concat(F.left("content", F.lit(keep)), F.when(F.length("content") > keep, "...").otherwise(""))
    text = F.concat(
        F.lit("AI Processing Result:\n\nOriginal Content:\n"), some,
        F.lit("\n\nPrompt:\n"), "prompt", F.lit("\n\nResult:\n"), "result",
    )
    key = F.concat_ws(":", F.lit("result"), "page_no", F.md5(F.concat_ws("|", "prompt", "result")))
    nodes = _nodes(
        results, space, "metadata", key, content=text, path=F.lit("/ai_results"),
        content_summary=F.col("result"),
    )
    tags = nodes.select(
        F.col("id").alias("node_id"), F.explode(F.array(F.lit("pdf:ai_result"), F.lit("pdf:processed"))).alias("tag")
    )
    return nodes, tags
