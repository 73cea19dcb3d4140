"""Registry of queries with the SQL that must give the same rows.

``query`` registers a callable (spark, data folder) -> DataFrame.  ``sql`` holds an
equivalent statement over the same tables; ``ctes`` names the shared input
definitions it needs, so that each input is written once.
"""

from __future__ import annotations

from leafgraph.functions import patterns as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


WS = lit(P.WHITESPACE)
NL = "chr(10)"
STOP_SQL = "(" + ", ".join(lit(w) for w in P.STOP_WORDS) + ")"


def clean_sql(c: str) -> str:
    return f"trim({c}, {WS})"


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all(lower({c}), {lit(P.TOKEN)})"


CTES: dict[str, str] = {
    "docs": (
        "docs AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 0 AS page_no, text, lang AS domain "
        "FROM documents)"
    ),
    "books": (
        "books AS (SELECT source AS doc_id, CAST(row_number() OVER (PARTITION BY source "
        "ORDER BY doc_id) - 1 AS INTEGER) AS page_no, text, lang AS domain FROM documents)"
    ),
    "convs": (
        "convs AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS INTEGER) AS page_no, "
        "text FROM conversations)"
    ),
    "web": (
        "web AS (SELECT CAST(page_id // 10 AS VARCHAR) AS doc_id, "
        "CAST(page_id % 10 AS INTEGER) AS page_no, html FROM pages)"
    ),
}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = (), recursive: bool = False):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            head = ", ".join(CTES[c] for c in ctes)
            if head:
                word = "WITH RECURSIVE" if recursive else "WITH"
                body = sql.strip()
                if body.upper().startswith("WITH "):
                    body = ", " + body[5:]
                    ORACLES[name] = f"{word} {head}{body}"
                else:
                    ORACLES[name] = f"{word} {head} {body}"
            else:
                ORACLES[name] = sql.strip()
        return fn

    return register
