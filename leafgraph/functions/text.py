"""Column expressions on text.  All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafgraph.functions import patterns as P


def clean(c) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(c, F.lit(P.WHITESPACE))


def any_of(words) -> str:
    """One alternation instead of a chain of tests."""
    return "|".join(words)


def is_stop(c: Column) -> Column:
    return c.isin(P.STOP_WORDS)


def token_array(c) -> Column:
    """Lower-case alphanumeric tokens, stop words included."""
    return F.regexp_extract_all(F.lower(c), F.lit(P.TOKEN), F.lit(0))


def content_tokens(c) -> Column:
    return F.filter(token_array(c), lambda t: ~is_stop(t))


def words(c) -> Column:
    """White-space separated words, as they stand."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def runs(c, key, entry) -> Column:
    """``entry(i, j)`` of each run ``c[i], ..., c[j - 1]`` of one ``key`` in a sorted array.

    ``c`` is looked up by place, so it has to be a column rather than an expression to be worked out.
    """
    places = F.sequence(F.lit(0), F.size(c))
    starts = F.filter(places, lambda i: (i == 0) | (i == F.size(c)) | (key(F.get(c, i)) != key(F.get(c, i - 1))))
    return F.zip_with(
        F.slice(starts, F.lit(1), F.size(starts) - 1), F.slice(starts, F.lit(2), F.size(starts)), entry
    )


def counts(c) -> Column:
    """``term, n`` of each distinct value of a sorted column without nulls."""
    return runs(c, lambda x: x, lambda i, j: F.struct(F.get(c, i).alias("term"), (j - i).cast("bigint").alias("n")))


def word_count(c) -> Column:
    return F.size(words(c))


def sentence_array(c) -> Column:
    parts = F.transform(F.split(c, P.SENTENCE_END), clean)
    return F.filter(parts, lambda s: s != "")


def sentences_with_end(c) -> Column:
    """Split after a sentence end, keeping its mark."""
    return F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\u0001"), "\u0001")


def first_sentence(c, limit: int = 500) -> Column:
    return F.substring(F.split(c, r"[.!?]\s+", 2)[0], 1, limit)


def light_stem(c) -> Column:
    """Step 1a of Porter's algorithm: plural endings."""
    return (
        F.when(F.endswith(c, F.lit("sses")), F.regexp_replace(c, "es$", ""))
        .when(F.endswith(c, F.lit("ies")), F.regexp_replace(c, "es$", ""))
        .when(F.endswith(c, F.lit("ss")), c)
        .otherwise(F.regexp_replace(c, "s$", ""))
    )


def trim_middle(c, limit: int) -> Column:
    """Head and tail of a text that is over its budget."""
    half = limit // 2
    return F.when(
        F.length(c) > limit,
        F.concat(F.left(c, F.lit(half)), F.lit("\n...[truncated]...\n"), F.right(c, F.lit(half))),
    ).otherwise(c)


# Element, pattern, replacement ($n is a group).
HTML_STEPS = [
    (r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<head\b.*?</head>", ""),
    (r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)"),
    (r"(?i)</?(?:b|strong)>", "**"),
    (r"(?i)</?(?:i|em)>", "*"),
    (r"(?i)<li\b[^>]*>", "\n* "),
    (r"(?i)<h1\b[^>]*>", "\n\n# "),
    (r"(?i)<h2\b[^>]*>", "\n\n## "),
    (r"(?i)<h3\b[^>]*>", "\n\n### "),
    (r"(?i)<h4\b[^>]*>", "\n\n#### "),
    (r"(?i)<h5\b[^>]*>", "\n\n##### "),
    (r"(?i)<h6\b[^>]*>", "\n\n###### "),
    (r"(?i)</?(?:p|h[1-6]|div|article|section|ul|ol|table|blockquote|pre)\b[^>]*>", "\n\n"),
    (r"(?i)</?(?:br|tr|li|nav|header|footer|title|body|html)\b[^>]*>", "\n"),
    (r"<[^>]+>", ""),
]
HTML_ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"),
    ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
]
HTML_SPACING = [(r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n")]


def html_to_markdown(c) -> Column:
    for pattern, replacement in HTML_STEPS:
        c = F.regexp_replace(c, pattern, replacement)
    for entity, char in HTML_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    for pattern, replacement in HTML_SPACING:
        c = F.regexp_replace(c, pattern, replacement)
    return clean(c)
