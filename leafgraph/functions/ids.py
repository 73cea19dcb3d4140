"""Deterministic identifiers: a retried task must produce the same id again."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return c if isinstance(c, Column) else F.lit(c)


def node_id(domain, doc_id, kind, key) -> Column:
    """md5 of domain, document, node type and a key unique within them."""
    return F.md5(
        F.concat_ws("|", _col(domain), _col(doc_id), _col(kind), _col(key).cast("string"))
    )


def edge_id(source, target, kind) -> Column:
    return F.concat_ws("-", _col(source), _col(target), _col(kind))


def short_hash(text) -> Column:
    return F.substring(F.md5(text), 1, 8)
