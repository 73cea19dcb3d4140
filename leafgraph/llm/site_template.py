"""Main text of web pages by removing what the pages of a site have in common.

Every page is read as a tree. A digest of each element's subtree is counted per host over
pages of different content; a subtree that recurs on ``MIN_PAGES`` of them, however many
pages the host has, is part of the site's template and deleted. Menus, headers, footers, adverts, forms and comments that differ from
page to page go by element name, class and role. If a page has an ``article`` (else a
``main``), only that is text, and single paragraphs in it are never taken for a template:
short sentences recur by chance, and passages are quoted.

Null or empty html gives an empty text; a null url has no host, so no template. Rows with
equal keys stay separate rows. Pages of any length are read whole. Copies of a page count
once, however many there are, so that a copied article is not taken for a template.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.durable import cut
from leafgraph.llm.html_tree import BLOCK, CONTAINERS, Page, digest, joined

#: A subtree is a template's if it stands on so many pages of a host.
MIN_PAGES = 5
#: Subtrees on this share of all pages: there are at most 1 / HOT_SHARE times those of a page.
HOT_SHARE = 1e-3


def with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower("url"), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return pages.withColumn("host", F.coalesce(host, F.lit("")))


def scope(page: Page) -> tuple[list[bool], list[bool], bool]:
    """(in the main part, out by rule, whether the page marks its main part) of each element."""
    inside, out = page.rules()
    if any(a and not b for a, b in zip(inside, out)):
        return inside, out, True
    main = [False] * len(page.tags)
    for n in range(1, len(main)):
        main[n] = main[page.parents[n]] or page.tags[n] == "main" or "role=\"main\"" in page.attributes[n]
    if any(a and not b for a, b in zip(main, out)):
        return main, out, True
    return [True] * len(main), out, False


def subtrees_of(html: str) -> tuple[int, set[int]]:
    """What marks the page's content, and the subtrees that a template may hold."""
    page = Page(html)
    main, out, marked = scope(page)
    digests, has_text = page.subtrees(), page.has_text()
    found, longest = set(), ""
    for n in range(1, len(page.tags)):
        tag = page.tags[n]
        if main[n] and not out[n] and tag in BLOCK:
            own = joined([x for x in page.items[n] if isinstance(x, str)])
            longest = max(longest, own, key=lambda x: (len(x), x))
        if has_text[n] and tag in BLOCK and tag not in ("html", "body", "head", "main", "article", "title"):
            if tag in CONTAINERS or not (marked and main[n]):
                found.add(digests[n])
    return digest(longest), found


def text_of(html: str, template: set[int]) -> str:
    """The article's text, without the template's subtrees."""
    page = Page(html)
    main, out, marked = scope(page)
    digests = page.subtrees() if template else None
    gone = list(out)
    for n in range(1, len(gone)):
        gone[n] |= gone[page.parents[n]]
        if digests and not gone[n] and digests[n] in template:
            tag = page.tags[n]
            gone[n] = tag in BLOCK and tag not in ("html", "body", "main", "article") and (tag in CONTAINERS or not (marked and main[n]))
    texts: list[str] = []
    todo: list = [0]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            texts.append(x)
        elif isinstance(x, tuple):
            if main[x[0]]:
                texts.append(x[1])
        elif not gone[x]:
            edge = [" "] if page.tags[x] in BLOCK else []
            todo += edge
            todo += [y if isinstance(y, int) else (x, y) for y in reversed(page.items[x])]
            todo += edge
    return joined(texts)


def _subtree_batches(batches):
    for batch in batches:
        at, subtree, content = [], [], []
        for i, html in enumerate(batch.column("html").to_pylist()):
            mark, found = subtrees_of(html or "")
            at += [i] * len(found)
            subtree += found
            content += [mark] * len(found)
        at = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("page").take(at), batch.column("host").take(at), pa.array(subtree, pa.int64()), pa.array(content, pa.int64())],
            names=["page", "host", "subtree", "content"])


def _found(pages: DataFrame) -> DataFrame:
    """(page, host, subtree, content) of each page's subtrees; ``pages`` has host and page."""
    rows = pages.where("host <> ''").select("page", "host", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_subtree_batches, "page long, host string, subtree long, content long")


def templates(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, subtree, pages, recurs): how many rows have each subtree of a host, and whether it is a template's."""
    counts = found.groupBy("host", "subtree").agg(F.countDistinct("content").alias("n"), F.count("*").alias("pages"))
    return counts.select("host", "subtree", "pages", (F.col("n") >= min_pages).alias("recurs"))


def _text_batches(batches):
    for batch in batches:
        texts = [text_of(html or "", set(t or ())) for html, t in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text) of every page."""
    rows = with_host(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), "host")
    rows = rows.withColumn("page", F.xxhash64("page_id", "url", "html"))
    found = cut(_found(rows))
    share = rows.count() * HOT_SHARE
    of = templates(found, min_pages)
    of = cut(of.where(F.col("recurs") | (F.col("pages") > share)))
    found = found.select("page", "host", "subtree")
    # Subtrees on many pages go to every task, template or not; the others have no hot key.
    hot = of.where(F.col("pages") > share).select("host", "subtree", "recurs")
    found = found.join(F.broadcast(hot), ["host", "subtree"], "left")
    rest = of.where(F.col("pages") <= share).select("host", "subtree")
    gone = found.where("recurs").select("page", "subtree").unionByName(
        found.where("recurs IS NULL").join(rest, ["host", "subtree"], "left_semi").select("page", "subtree"))
    gone = gone.groupBy("page").agg(F.collect_set("subtree").alias("template"))
    rows = rows.join(gone, "page", "left").select("page_id", "url", "html", "template")
    return rows.mapInArrow(_text_batches, "page_id long, url string, text string")
