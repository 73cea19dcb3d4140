"""Page tables from the tables at hand.

Every adapter returns ``doc_id STRING, page_no INT, text STRING`` (plus what its
name says), read with only the columns it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.operators.ordered import ranked

# Rows of one source that are numbered together in one task.
RANK_BLOCK = 16384


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, if the scan has fewer splits than there are cores.

    A file with one row group is one split.  A table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def docs(spark: SparkSession, root: str) -> DataFrame:
    """Each document is a document of one page.  Nothing is shuffled."""
    rows = table(spark, root, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.lit(0).alias("page_no"),
        "text",
        F.col("lang").alias("domain"),
    )
    return spread(rows)


def books(spark: SparkSession, root: str) -> DataFrame:
    """Each source is a document; its rows are the pages, in order of ``doc_id``."""
    rows = table(spark, root, "documents").select("source", "doc_id", "text", "lang")
    rows = ranked(rows, ["source"], ["doc_id"], RANK_BLOCK, "page_no")
    return rows.select(
        F.col("source").alias("doc_id"),
        F.col("page_no").cast("int").alias("page_no"),
        "text",
        F.col("lang").alias("domain"),
    )


def convs(spark: SparkSession, root: str) -> DataFrame:
    """Each conversation is a document; its turns are the pages."""
    rows = table(spark, root, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"),
        F.col("turn").cast("int").alias("page_no"),
        "text",
    )
    return spread(rows)


def html(spark: SparkSession, root: str) -> DataFrame:
    """Ten web pages make a document."""
    rows = table(spark, root, "pages").select(
        F.expr("cast(page_id div 10 as string)").alias("doc_id"),
        F.expr("cast(page_id % 10 as int)").alias("page_no"),
        "html",
    )
    return spread(rows)


TOC_NUMBER = (
    "concat(cast(p_size % 9 + 1 as string), "
    "case when p_partkey % 3 > 0 then concat('.', cast(p_partkey % 5 + 1 as string)) else '' end, "
    "case when p_partkey % 3 = 2 then concat('.', cast(p_partkey % 4 + 1 as string)) else '' end)"
)


def toc_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of a table of contents per brand; the brand sets the format."""
    kind = F.expr("cast(substring(p_brand, 7) as int) % 4")
    page = F.expr("cast(p_partkey % 300 as string)")
    number = F.expr(TOC_NUMBER)
    line = (
        F.when(kind == 0, F.concat(number, F.lit(" "), "p_name", F.lit(" ........ "), page))
        .when(kind == 1, F.concat(number, F.lit("\t"), "p_name", F.lit("\t"), page))
        .when(kind == 2, F.concat(number, F.lit("  "), "p_name", F.lit("  "), page))
        .otherwise(F.concat("p_name", F.lit(" "), page))
    )
    return table(spark, root, "part").select(
        F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("seq"), line.alias("line")
    )


def toc_pages(spark: SparkSession, root: str) -> DataFrame:
    """The same lines as pages of 200 keys; every fourth page opens a table."""
    grouped = (
        toc_lines(spark, root)
        .withColumn("page_no", F.expr("cast(seq div 200 as int)"))
        .groupBy("doc_id", "page_no")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("rows"))
    )
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    opens = F.col("page_no") % 4 == 1
    return grouped.select(
        "doc_id",
        "page_no",
        F.concat(
            F.when(opens, F.lit("Table of Contents\n")).otherwise(F.lit("")),
            body,
            F.when(opens, F.lit("\n(Continued)")).otherwise(F.lit("")),
        ).alias("text"),
    )


def outline(spark: SparkSession, root: str) -> DataFrame:
    """An outline (level, title, 1-based page) for the books, from the parts."""
    return table(spark, root, "part").select(
        F.expr("concat('src', cast(p_partkey % 20 as string))").alias("doc_id"),
        F.col("p_partkey").alias("seq"),
        F.expr("cast(p_partkey % 3 + 1 as int)").alias("level"),
        F.col("p_name").alias("title"),
        F.expr("cast((p_partkey div 20) * 2 + p_size % 3 + 1 as int)").alias("page"),
    )
