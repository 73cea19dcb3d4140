"""The stored graph: five Parquet tables, and what is done to them as a whole."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.operators.graph import one_per_id
from leafgraph.operators.search import newest, with_tags
from leafgraph.schemas import DOMAIN_REFS, DOMAINS, EDGES, NODES, TAGS

Graph = dict[str, DataFrame]  # nodes, edges, tags, domains, domain_refs


def save_graph(graph: Graph, path: str, domains: list[str] = ()) -> None:
    """Write the tables.  Only the domains at hand are replaced, so a rebuild can be repeated.

    ``domains`` are those built anew as a whole: where a table has no rows of one of them
    any more, the old ones go too.  Files are balanced by size within a domain, also where
    one domain has most rows.  Nodes hold the texts: of one domain they are written as they
    lie, a file a task, and not shuffled.
    """
    def write(df: DataFrame, name: str, column: str) -> None:
        df = df if name == "nodes" and len(domains) == 1 else df.hint("rebalance", column)
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
            "compression", "zstd"
        ).partitionBy(column).parquet(f"{path}/{name}")
        for domain in domains:
            if df.filter(F.col(column) == domain).isEmpty():
                remove_partition(df.sparkSession, f"{path}/{name}", column, domain)

    write(graph["nodes"], "nodes", "domain")
    write(graph["edges"], "edges", "domain")
    owner = graph["nodes"].select(F.col("id").alias("node_id"), "domain")
    write(graph["tags"].select("node_id", "tag").join(owner, "node_id"), "tags", "domain")
    if "domains" in graph:
        write(graph["domains"].withColumn("domain_id", F.col("id")), "domains", "domain_id")
    if "domain_refs" in graph:
        write(graph["domain_refs"], "domain_refs", "domain")


def remove_partition(spark: SparkSession, path: str, column: str, value: str) -> None:
    """Delete the files of one value of the partition column, in whatever store they are."""
    jvm = spark._jvm
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={name}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def load_graph(spark: SparkSession, path: str, domain: str | None = None) -> Graph:
    """Read the tables; with ``domain`` only the files of that domain."""
    def read(name: str, schema: str) -> DataFrame:
        df = spark.read.schema(schema).parquet(f"{path}/{name}")
        return df if domain is None else df.filter(F.col("domain") == domain)

    return {
        "nodes": read("nodes", NODES),
        "edges": read("edges", EDGES),
        "tags": read("tags", TAGS + ", domain STRING").drop("domain"),
        "domains": spark.read.schema(DOMAINS).parquet(f"{path}/domains"),
        "domain_refs": read("domain_refs", DOMAIN_REFS),
    }


# --- constraints ---------------------------------------------------------------------


def violations(graph: Graph) -> DataFrame:
    """``rule, table, key`` of every row that breaks a constraint."""
    nodes, edges, tags = graph["nodes"], graph["edges"], graph["tags"]
    domains = graph["domains"].select(F.col("id").alias("domain"))
    ids = nodes.select(F.col("id").alias("_id"))  # repeats do not matter where rows are only looked up

    def found(df: DataFrame, rule: str, table: str, key: Column) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table"), key.cast("string").alias("key"))

    def duplicates(df: DataFrame, table: str, *keys: str) -> DataFrame:
        twice = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
        return found(twice, "primary key", table, F.concat_ws("|", *keys))

    def dangling(df: DataFrame, table: str, column: str) -> DataFrame:
        lost = df.join(ids, df[column] == ids["_id"], "left_anti")
        return found(lost, f"foreign key {column}", table, F.col(column)).distinct()

    def no_domain(df: DataFrame, table: str) -> DataFrame:
        lost = df.select("domain").distinct().join(domains, "domain", "left_anti")
        return found(lost, "foreign key domain", table, F.col("domain"))

    checks = [
        duplicates(nodes, "nodes", "id"),
        duplicates(edges, "edges", "id"),
        duplicates(tags, "tags", "node_id", "tag"),
        dangling(edges, "edges", "source"),
        dangling(edges, "edges", "target"),
        dangling(tags, "tags", "node_id"),
        no_domain(nodes, "nodes"),
        no_domain(edges, "edges"),
        found(edges.filter("strength is null or strength < 0 or strength > 1"), "strength range", "edges", F.col("id")),
        found(nodes.filter("content is null"), "not null content", "nodes", F.col("id")),
        found(edges.filter("type is null or source is null or target is null"), "not null", "edges", F.col("id")),
    ]
    if "domain_refs" in graph:
        refs = graph["domain_refs"]
        checks += [dangling(refs, "domain_refs", "node_id"), no_domain(refs, "domain_refs")]
    return reduce(DataFrame.unionByName, checks)


def stored_domain(spark: SparkSession, path: str, domain: str):
    """The stored row of a domain, or None."""
    try:
        return spark.read.schema(DOMAINS).parquet(f"{path}/domains").filter(F.col("id") == domain).first()
    except AnalysisException:  # nothing is stored yet
        return None


def valid_edges(graph: Graph) -> DataFrame:
    """Edges with both ends, a known domain and a strength in range, one per id."""
    ids = graph["nodes"].select("id")
    edges = graph["edges"].filter("strength between 0 and 1 and type is not null")
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    edges = edges.join(graph["domains"].select(F.col("id").alias("domain")), "domain", "left_semi")
    return one_per_id(edges)


# --- domains -------------------------------------------------------------------------


def ensure_domain(domains: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Domains by name: the missing ones are added, all wanted ones are touched.

    ``wanted`` is ``name, description``.
    """
    at = now.cast("timestamp")
    touched = domains.join(
        wanted.select("name", F.lit(True).alias("_hit")).distinct(), "name", "left"
    ).select(
        "id", "name", "description", "created",
        F.when(F.col("_hit"), at).otherwise(F.col("last_access")).alias("last_access"),
    )
    new = wanted.dropDuplicates(["name"]).join(domains, "name", "left_anti").select(
        F.md5(F.concat(F.lit("domain|"), "name")).alias("id"), "name", "description",
        at.alias("created"), at.alias("last_access"),
    )
    return touched.unionByName(new)


def domain_id(domains: DataFrame, name_or_id: str) -> DataFrame:
    """Row of a domain given by name or id; a search accepts either."""
    return domains.filter((F.col("id") == name_or_id) | (F.col("name") == name_or_id)).select("id")


def resolve_refs(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """References between domains with their target (both ways where marked), and the dangling ones."""
    refs = graph["domain_refs"]
    targets = graph["nodes"].select(
        F.col("id").alias("target_node_id"), F.col("domain").alias("target_domain"), F.col("path").alias("target_path")
    )
    keys = ["target_node_id", "target_domain"]
    known = refs.join(targets, keys)
    forward = known.select("node_id", "domain", "target_node_id", "target_domain", "description")
    back = known.filter("bidirectional").select(
        F.col("target_node_id").alias("node_id"), F.col("target_domain").alias("domain"),
        F.col("node_id").alias("target_node_id"), F.col("domain").alias("target_domain"), "description",
    )
    return forward.unionByName(back).distinct(), refs.join(targets, keys, "left_anti")


# --- overview, deletion, export --------------------------------------------------------


def overview(graph: Graph) -> DataFrame:
    """One row per domain (also empty ones) and one, without a name, for the whole store."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("domain").alias("id")).agg(F.count("*").alias(name))

    rows = (
        graph["domains"].select("id", "name", "description")
        .join(counted(graph["nodes"], "nodes"), "id", "left")
        .join(counted(graph["edges"], "edges"), "id", "left")
        .na.fill(0, ["nodes", "edges"])
    )
    total = rows.agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges")).select(
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("description"), "nodes", "edges",
    )
    return rows.unionByName(total)


def newest_nodes(graph: Graph, n: int = 5) -> DataFrame:
    return newest(graph["nodes"].select("id", "path", "ts"), n)


def delete_nodes(graph: Graph, ids: DataFrame) -> Graph:
    """The graph without the given nodes (``id``) and all that hangs on them."""
    gone = ids.select("id")

    def without(df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = df.join(gone.withColumnRenamed("id", c), c, "left_anti")
        return df

    out = dict(graph)
    out["nodes"] = without(graph["nodes"], "id")
    out["edges"] = without(graph["edges"], "source", "target")
    out["tags"] = without(graph["tags"], "node_id")
    if "domain_refs" in graph:
        out["domain_refs"] = without(graph["domain_refs"], "node_id", "target_node_id")
    return out


def export_frames(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Memories with their tags, and relationships."""
    memories = with_tags(
        graph["nodes"].select("id", "domain", "content", F.col("ts").alias("timestamp"), "path", "content_summary"),
        graph["tags"],
    )
    relationships = graph["edges"].select(
        "id", "source", "target", "type", "strength", F.col("ts").alias("timestamp"), "domain"
    )
    return memories, relationships


def csv_frames(graph: Graph) -> tuple[DataFrame, DataFrame]:
    memories, relationships = export_frames(graph)
    flat = memories.select(
        "id", "domain", "path", "content", F.coalesce("content_summary", F.lit("")).alias("summary"),
        F.concat_ws(";", "tags").alias("tags"), "timestamp",
    )
    return flat, relationships.select("id", "source", "target", "type", "strength", "domain", "timestamp")


def write_graph_json(graph: Graph, path: str, exported_at: Column, source: str = "") -> None:
    """Three folders of JSON lines: memories, relationships, metadata (one row of totals)."""
    memories, relationships = export_frames(graph)
    memories.write.mode("overwrite").json(f"{path}/memories")
    relationships.write.mode("overwrite").json(f"{path}/relationships")
    totals = memories.agg(F.count("*").alias("total_memories")).withColumns(
        {
            "total_relationships": relationships.agg(F.count("*")).scalar(),
            "exported_at": exported_at,
            "source": F.lit(source),
        }
    )
    totals.write.mode("overwrite").json(f"{path}/metadata")


def write_graph_csv(graph: Graph, path: str) -> None:
    options = {
        "header": "true", "quoteAll": "true", "escape": '"',
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    }
    memories, relationships = csv_frames(graph)
    memories.write.mode("overwrite").options(**options).csv(f"{path}/memories")
    relationships.write.mode("overwrite").options(**options).csv(f"{path}/relationships")
