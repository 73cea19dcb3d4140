"""Sources, sinks and what is done to the store as a whole."""

from pyspark.sql import functions as F

from leafgraph.checks.base import CTES, query
from leafgraph.checks.graph import BOOK_GRAPH, DOC, PAGE, SECTION, documents
from leafgraph.checks.search import BM25, EPOCH, index_cte, memo, memo_edges, memo_tags
from leafgraph.checks.structure import book_toc
from leafgraph.functions.durable import cut, scratch_folder
from leafgraph.operators import search, shape, structure
from leafgraph.plans import ingest
from leafgraph.schemas import TAG_STRUCT
from leafgraph.sources import adapters as A
from leafgraph.sources import files, store
from leafgraph.operators import stored as stored_index
from leafgraph.streaming import index as stream

NOW = 1_705_276_800


def now():
    return F.timestamp_seconds(F.lit(NOW))


def memo_graph(spark, d):
    """The memo graph with its domains: the languages and one without nodes."""
    nodes = memo(spark, d).withColumns(
        {
            "page_no": F.lit(None).cast("int"),
            "summary_ts": F.lit(None).cast("timestamp"),
            "confidence": F.lit(1.0),
            "ontology": F.array().cast(f"array<{TAG_STRUCT}>"),
        }
    )
    edges = memo_edges(spark, d).join(
        nodes.select(F.col("id").alias("source"), F.col("domain").alias("_d")), "source"
    ).withColumn("domain", F.col("_d")).drop("_d")
    langs = nodes.select("domain").distinct().unionByName(spark.range(1).select(F.lit("xx").alias("domain")))
    start = F.timestamp_seconds(F.lit(EPOCH))
    domains = langs.select(
        F.col("domain").alias("id"), F.concat(F.lit("lang-"), "domain").alias("name"),
        F.lit(None).cast("string").alias("description"), start.alias("created"), start.alias("last_access"),
    )
    k = F.col("k")
    refs = A.table(spark, d, "documents").select(F.col("doc_id").alias("k"), "lang").select(
        F.concat(F.lit("n"), k.cast("string")).alias("node_id"), F.col("lang").alias("domain"),
        F.lit("en").alias("target_domain"), F.concat(F.lit("n"), (k * 3).cast("string")).alias("target_node_id"),
        F.lit("see also").alias("description"), (k % 2 == 0).alias("bidirectional"),
    )
    return {"nodes": nodes, "edges": edges, "tags": memo_tags(spark, d), "domains": domains, "domain_refs": refs}


CTES["memo_store"] = """dom AS (SELECT DISTINCT domain AS id FROM memo UNION ALL SELECT 'xx'),
  st_edges AS (SELECT e.source || '-' || e.target || '-references' AS id, e.*, m.domain FROM memo_edges e
    JOIN memo m ON m.id = e.source),
  refs AS (SELECT 'n' || CAST(doc_id AS VARCHAR) AS node_id, lang AS domain, 'en' AS target_domain,
    'n' || CAST(doc_id * 3 AS VARCHAR) AS target_node_id, doc_id % 2 = 0 AS bidirectional FROM documents)"""
STORE = ("memo", "memo_store")


@query("S1_scan_files")
def s1(spark, d):
    return files.scan_files(spark, d, "*.parquet").select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length"
    )


def stored(spark, d):
    folder = scratch_folder(spark, "graph")
    store.save_graph(memo_graph(spark, d), folder)
    return folder


@query(
    "S3_load_graph",
    """SELECT id, path, stamp, (SELECT count(*) FROM memo_tags t WHERE t.node_id = m.id) AS tags,
      (SELECT count(*) FROM memo_edges e WHERE e.source = m.id) AS edges FROM memo m WHERE domain = 'fr'""",
    STORE,
)
def s3(spark, d):
    g = store.load_graph(spark, stored(spark, d), "fr")
    tags = g["tags"].groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("tags"))
    edges = g["edges"].groupBy(F.col("source").alias("id")).agg(F.count("*").alias("edges"))
    rows = g["nodes"].select("id", "path", F.unix_seconds("ts").alias("stamp"))
    return rows.join(tags, "id", "left").join(edges, "id", "left").na.fill(0, ["tags", "edges"])


@query("S4_write_graph_json", "SELECT id, domain, path, content FROM memo", STORE)
def s4(spark, d):
    folder = scratch_folder(spark, "json")
    store.write_graph_json(memo_graph(spark, d), folder, now())
    return spark.read.schema("id STRING, domain STRING, path STRING, content STRING").json(f"{folder}/memories")


TAGS_OF = "(SELECT string_agg(tag, ';' ORDER BY tag) FROM memo_tags t WHERE t.node_id = m.id)"


@query(
    "S5_write_graph_csv",
    f"SELECT id, domain, path, coalesce(content_summary, '') AS summary, {TAGS_OF} AS tags FROM memo m",
    STORE,
)
def s5(spark, d):
    folder = scratch_folder(spark, "csv")
    store.write_graph_csv(memo_graph(spark, d), folder)
    read = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    rows = read.schema(
        "id STRING, domain STRING, path STRING, content STRING, summary STRING, tags STRING, timestamp STRING"
    ).csv(f"{folder}/memories")
    return rows.select("id", "domain", "path", F.coalesce("summary", F.lit("")).alias("summary"), "tags")


@query(
    "S6_save_graph",
    """SELECT domain, count(*) AS nodes, CAST(sum(length(content)) AS BIGINT) AS chars,
      CASE WHEN domain = 'de' THEN 0 ELSE (SELECT count(*) FROM memo_edges e JOIN memo m ON m.id = e.source WHERE m.domain = memo.domain) END AS edges
    FROM memo GROUP BY domain""",
    STORE,
)
def s6(spark, d):
    """Saved twice, the second time one domain only and without its edges: nothing is doubled, nothing stays."""
    folder = stored(spark, d)
    again = memo_graph(spark, d)
    again["nodes"] = again["nodes"].filter("domain = 'de'")
    again["edges"] = again["edges"].filter("false")
    store.save_graph(again, folder, ["de"])
    g = store.load_graph(spark, folder)
    edges = g["edges"].groupBy("domain").agg(F.count("*").alias("edges"))
    return g["nodes"].groupBy("domain").agg(
        F.count("*").alias("nodes"), F.sum(F.length("content")).alias("chars")
    ).join(edges, "domain", "left").withColumn("edges", F.coalesce("edges", F.lit(0)).cast("bigint"))


@query(
    "S8_violations",
    """WITH e AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS source,
        'c' || CAST(o_custkey % 50 AS VARCHAR) AS target, o_totalprice / 400000 AS strength FROM orders
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), 'c' || CAST(o_custkey % 50 AS VARCHAR),
        o_totalprice / 400000 FROM orders WHERE o_orderkey % 100 = 0),
      n AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 10 > 0
        UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey < 45)
    SELECT 'primary key' AS rule, 'edges' AS "table", id AS key FROM e GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'foreign key source', 'edges', source FROM e WHERE source NOT IN (SELECT id FROM n)
    UNION ALL SELECT DISTINCT 'foreign key target', 'edges', target FROM e WHERE target NOT IN (SELECT id FROM n)
    UNION ALL SELECT 'strength range', 'edges', id FROM e WHERE strength < 0 OR strength > 1
    UNION ALL SELECT DISTINCT 'foreign key domain', 'nodes', 'd' || CAST(c_custkey % 3 AS VARCHAR) FROM customer
      WHERE (c_custkey % 10 > 0 OR c_custkey < 45)
        AND 'd' || CAST(c_custkey % 3 AS VARCHAR) NOT IN (SELECT 'd' || CAST(r_regionkey AS VARCHAR) FROM region WHERE r_regionkey < 2)
    """,
)
def s8(spark, d):
    g = faulty_graph(spark, d)
    return store.violations(g)


def faulty_graph(spark, d):
    """Orders as edges from customers to groups: some ends missing, some ids twice, some out of range."""
    def name(prefix, number):
        return F.concat(F.lit(prefix), number.cast("string"))

    orders = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    orders = orders.unionByName(orders.filter("o_orderkey % 100 = 0"))
    edges = orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("source"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("target"), F.lit("references").alias("type"),
        (F.col("o_totalprice") / 400000).alias("strength"), name("d", F.col("o_orderkey") % 2).alias("domain"),
    )
    customer = A.table(spark, d, "customer").select("c_custkey")
    key, home = F.col("c_custkey"), name("d", F.col("c_custkey") % 3).alias("domain")
    nodes = customer.filter("c_custkey % 10 > 0").select(key.cast("string").alias("id"), home).unionByName(
        customer.filter("c_custkey < 45").select(name("c", key).alias("id"), home)
    ).withColumn("content", F.lit("customer"))
    domains = A.table(spark, d, "region").filter("r_regionkey < 2").select(name("d", F.col("r_regionkey")).alias("id"))
    tags = nodes.select(F.col("id").alias("node_id"), F.lit("pdf:customer").alias("tag"))
    return {"nodes": nodes, "edges": edges, "tags": tags, "domains": domains}


@query(
    "S8_valid_edges",
    """WITH n AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 10 > 0
        UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey < 45)
    SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE CAST(o_custkey AS VARCHAR) IN (SELECT id FROM n)
      AND 'c' || CAST(o_custkey % 50 AS VARCHAR) IN (SELECT id FROM n) AND o_totalprice / 400000 <= 1""",
)
def s8b(spark, d):
    return store.valid_edges(faulty_graph(spark, d)).select("id")


@query(
    "S9_rebuild",
    f"""SELECT 'node' AS kind, {DOC} AS id FROM book_text UNION ALL SELECT 'node', {PAGE} FROM g_pages
    UNION ALL SELECT 'node', {SECTION} FROM g_sections
    UNION ALL SELECT 'edge', source || '-' || target || '-' || type FROM g_edges""",
    (*BOOK_GRAPH, "g_edges"),
    recursive=True,
)
def s9(spark, d):
    """Pages go to a table of page texts, come back and are built into a store, twice."""
    folder = scratch_folder(spark, "pages")
    shape.page_markdown(A.books(spark, d)).write.option("compression", "zstd").parquet(folder)
    pages = spark.read.parquet(folder).select(
        "doc_id", "page_no", F.regexp_replace("markdown", r"^# Page [^\n]*\n[^\n]*\n?", "").alias("text")
    )
    path = scratch_folder(spark, "store")
    sections = cut(structure.toc_sections(book_toc(spark, d), pages))
    for _ in range(2):
        g = ingest.rebuild(spark, pages, path, now=now(), sections=sections)
    return g["nodes"].select(F.lit("node").alias("kind"), "id").unionByName(
        g["edges"].select(F.lit("edge").alias("kind"), "id")
    )


# --- domains, references, deletion, overview ---------------------------------------------


@query(
    "Q14_overview",
    """SELECT d.id, 'lang-' || d.id AS name, (SELECT count(*) FROM memo m WHERE m.domain = d.id) AS nodes,
      (SELECT count(*) FROM st_edges e WHERE e.domain = d.id) AS edges FROM dom d
    UNION ALL SELECT NULL, NULL, (SELECT count(*) FROM memo), (SELECT count(*) FROM st_edges)""",
    STORE,
)
def q14(spark, d):
    return store.overview(memo_graph(spark, d)).drop("description")


@query("Q14_newest", "SELECT id, path, stamp FROM memo ORDER BY stamp DESC, id LIMIT 5", ("memo",))
def q14b(spark, d):
    return store.newest_nodes(memo_graph(spark, d)).select("id", "path", F.unix_seconds("ts").alias("stamp"))


@query(
    "Q15_ensure_domain",
    f"""WITH wanted AS (SELECT DISTINCT source AS name FROM documents UNION SELECT 'lang-fr')
    SELECT 'lang-' || id AS name, CASE WHEN 'lang-' || id IN (SELECT name FROM wanted) THEN CAST({NOW} AS BIGINT) ELSE {EPOCH} END AS stamp,
      id FROM dom
    UNION ALL SELECT name, {NOW}, md5('domain|' || name) FROM wanted WHERE name NOT IN (SELECT 'lang-' || id FROM dom)""",
    STORE,
)
def q15(spark, d):
    rows = A.table(spark, d, "documents")
    french = rows.filter("lang = 'fr'").select(F.concat(F.lit("lang-"), "lang").alias("name"))
    wanted = rows.select(F.col("source").alias("name")).unionByName(french).distinct().withColumn(
        "description", F.lit("from sources")
    )
    out = store.ensure_domain(memo_graph(spark, d)["domains"], wanted, now())
    return out.select("id", "name", F.unix_seconds("last_access").alias("stamp"))


CTES["refs_known"] = """refs_known AS (SELECT r.* FROM refs r JOIN memo m ON m.id = r.target_node_id
  AND m.domain = r.target_domain)"""


@query(
    "Q16_domain_refs",
    """SELECT node_id, domain, target_node_id, target_domain FROM refs_known
    UNION SELECT target_node_id, target_domain, node_id, domain FROM refs_known WHERE bidirectional""",
    (*STORE, "refs_known"),
)
def q16(spark, d):
    known, _ = store.resolve_refs(memo_graph(spark, d))
    return known.drop("description")


@query(
    "Q16_dangling_refs",
    """SELECT node_id, target_node_id FROM refs r WHERE NOT EXISTS (SELECT 1 FROM memo m
      WHERE m.id = r.target_node_id AND m.domain = r.target_domain)""",
    STORE,
)
def q16b(spark, d):
    _, dangling = store.resolve_refs(memo_graph(spark, d))
    return dangling.select("node_id", "target_node_id")


@query(
    "Q17_delete_nodes",
    """WITH gone AS (SELECT 'n' || CAST(doc_id AS VARCHAR) AS id FROM labels WHERE quality = 0)
    SELECT 'nodes' AS what, count(*) AS n FROM memo WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'edges', count(*) FROM st_edges WHERE source NOT IN (SELECT id FROM gone)
      AND target NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'tags', count(*) FROM memo_tags WHERE node_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'domain_refs', count(*) FROM refs WHERE node_id NOT IN (SELECT id FROM gone)
      AND target_node_id NOT IN (SELECT id FROM gone)""",
    STORE,
)
def q17(spark, d):
    gone = A.table(spark, d, "labels").filter("quality = 0").select(
        F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("id")
    )
    g = store.delete_nodes(memo_graph(spark, d), gone)
    counts = [
        g[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        for name in ("nodes", "edges", "tags", "domain_refs")
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(
    "Q18_export_frames",
    f"SELECT id, domain, path, content, content_summary, stamp, {TAGS_OF.replace(';', '|')} AS tags FROM memo m",
    ("memo",),
)
def q18(spark, d):
    memories, _ = store.export_frames(memo_graph(spark, d))
    return memories.select(
        "id", "domain", "path", "content", "content_summary", F.unix_seconds("timestamp").alias("stamp"),
        F.array_join("tags", "|").alias("tags"),
    )


# --- the index kept by a stream -----------------------------------------------------------


CTES["live"] = """live AS (SELECT * FROM memo WHERE k % 11 > 0)"""
CTES["live_index"] = index_cte("live", "memo_tags")


def streamed(spark, d):
    """The folder of an index fed by a stream: inserts, then updates of every node and deletion of some."""
    base = memo(spark, d).join(
        memo_tags(spark, d).groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_list("tag")).alias("tags")), "id"
    )
    k = F.substring("id", 2, 20).cast("bigint")
    columns = ["id", "domain", "content", "content_summary", "path", "tags"]
    first = base.withColumns(
        {"content": F.concat(F.lit("ther ther old "), "content"), "deleted": F.lit(False), "seq": F.lit(1).cast("bigint")}
    )
    second = base.withColumns({"deleted": k % 11 == 0, "seq": F.lit(2).cast("bigint")})
    source = scratch_folder(spark, "changes")
    for changes in (first, second):
        changes.select(*columns, "deleted", "seq").write.mode("append").parquet(source)
    # Four batches, which the last of them merges.
    files = max(1, -(-len(spark.read.parquet(source).inputFiles()) // 4))
    index = scratch_folder(spark, "index")
    incoming = spark.readStream.schema(stream.CHANGES).option("maxFilesPerTrigger", files).parquet(source)
    stream.stream_index(incoming, index, scratch_folder(spark, "offsets"), "none").awaitTermination()
    return index


_LIVE_SCORES = f"""WITH hits AS (SELECT node_id, term, sum(tf) AS tf FROM postings WHERE term IN ('ther', 'than') GROUP BY ALL)
    SELECT h.node_id, round(sum({BM25}), 6) AS score FROM hits h JOIN term_df USING (term)
      JOIN lengths l ON l.node_id = h.node_id GROUP BY h.node_id"""


@query("I1_stream_index", _LIVE_SCORES, ("memo", "live", "live_index"))
def i1(spark, d):
    """All hits of two words, after the stream has been read and its segments have been merged."""
    live = stored_index.open_index(spark, streamed(spark, d), "none")
    found = stored_index.search(live, any_terms=["ther", "than"], limit=None)
    return found.select("node_id", F.round("score", 6).alias("score"))


@query("I1_term_df", "SELECT term, df FROM term_df", ("memo", "live", "live_index"))
def i1b(spark, d):
    """Document frequencies, which segments keep as sums of changes."""
    rows = stored_index.open_index(spark, streamed(spark, d), "none").table("dictionary")
    return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
