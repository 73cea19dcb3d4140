"""Quality rules whose limits are learned per language and source.

Each document is counted (``counts``) and its rates are put in whole numbers (``RATES``).
The rates of a group, the documents of one language and source, go into a quantile sketch: a
count for every bucket of a fixed log-linear scale, exact below 64 and within 1/32 above. Two
sketches merge by adding counts, so partial sketches are summed before they are shuffled and
sketches of a language, and of all documents, are sums of those of their groups. A limit is
the upper quartile plus ``REACH`` times the distance of the quartiles, at least the rate's
``ALLOWANCE`` (and the like below, for rates with a lower limit), so that it follows what is
usual in the group instead of being a fixed cutoff. A group of fewer than ``LEAST`` documents
takes the limits of its language, a language of fewer those of all documents. Documents are
then joined with the limits of their group.

Documents that fail the base rule are never kept and do not count in the sketches. Null texts
have no words, so they fail it. A null language or source is a group value like any other, a
null doc_id and repeated rows are judged row by row, an empty table gives no rows, and extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafgraph.functions.durable import cut
from leafgraph.llm import text_arrays as A

#: The base rule: fewer words, or a greater percentage of repeated words, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Documents a group needs for limits of its own.
LEAST = 100
REACH = 3
#: rate: (SQL of its whole number, least distance of the limit from the quartile, has a lower limit)
RATES = {
    "word_length": ("100 * word_chars div n_words", 100, True),
    "symbols": ("1000 * n_symbols div n_words", 100, False),
    "dup_lines": ("1000 * n_dup_lines div n_lines", 400, False),
    "repeats": ("1000 * n_repeat_words div n_words", 300, False),
}
#: Leading binary digits of a value that its bucket keeps.
DIGITS = 6
#: Groups of more than this share of all documents are sent to every task: at most 1 / share of them.
HEAVY = 64

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums between the offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each piece, equal for equal bytes only, and how many there are."""
    coded = A.pieces(data, starts, ends).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)


def repeated_words(words: np.ndarray, n_distinct: int, doc: np.ndarray) -> np.ndarray:
    """Which words (numbers, with the document of each) lie in a window of three found again in the document."""
    out = np.zeros(len(words), bool)
    if len(words) < 3:
        return out
    pair = np.unique(words[:-1] * n_distinct + words[1:], return_inverse=True)[1]
    at = np.flatnonzero(doc[:-2] == doc[2:])
    triple = np.unique(pair[at] * n_distinct + words[at + 2], return_inverse=True)[1]
    _, window, times = np.unique(doc[at] * (len(at) + 1) + triple, return_inverse=True, return_counts=True)
    hit = at[times[window] > 1]
    for i in range(3):
        out[hit + i] = True
    return out


def counts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The six counts of each document, in the order of ``COUNTS``."""
    starts, ends = A.words(data, off)
    edge = np.searchsorted(starts, off)
    doc = A.owners(off, starts)
    solid = (data != 32) & ((data - np.uint8(9)) > 4)
    chars = _sums(solid & ((data & 0xC0) != 0x80), off)
    repeated = repeated_words(*_codes(data, starts, ends), doc)
    # Lines end at a line feed or with the document; empty documents have one empty line.
    feed = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([off[:-1], feed + 1]), kind="stable")
    line_end = np.sort(np.concatenate([feed, off[1:]]), kind="stable")
    full = np.searchsorted(starts, line_start) < np.searchsorted(starts, line_end)
    line_start, line_end = line_start[full], line_end[full]
    owner = A.owners(off, line_start)
    n_lines = np.bincount(owner, minlength=len(off) - 1)
    code, n_codes = _codes(data, line_start, line_end)
    distinct = np.unique(owner * max(n_codes, 1) + code) // max(n_codes, 1)
    n_dup = n_lines - np.bincount(distinct, minlength=len(off) - 1)
    return [np.diff(edge), chars, _sums(_SYMBOL[data], off), n_lines, n_dup, _sums(repeated, edge)]


def _count_batches(batches):
    for batch in batches:
        data, off = A.utf8(batch.column("text"))
        for i, j in A.runs(off):
            found = counts(data[off[i]:off[j]], off[i:j + 1] - off[i])
            own = [batch.column(c).slice(i, j - i) for c in ("doc_id", "lang", "source")]
            names = [x.split()[0] for x in COUNTS.split(", ")]
            yield pa.RecordBatch.from_arrays(own + [pa.array(x.astype(np.int64)) for x in found], names=names)


def counted(docs: DataFrame) -> DataFrame:
    """The counts of every row."""
    kinds = {"doc_id": "long", "lang": "string", "source": "string", "text": "string"}
    return docs.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()]).mapInArrow(_count_batches, COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n): the sketch of each group and rate, of the rows that pass the base rule."""
    rates = F.array(*[F.struct(F.lit(r).alias("rate"), F.expr(sql).alias("v")) for r, (sql, _, _) in RATES.items()])
    rows = counts.where(~base_failed()).select("lang", "source", F.explode(rates).alias("x")).select("lang", "source", "x.*")
    rows = rows.selectExpr("lang", "source", "rate", "v", f"greatest(length(bin(v)) - {DIGITS}, 0) AS s")
    rows = rows.selectExpr("lang", "source", "rate", "shiftleft(shiftright(v, s), s) AS bucket")
    return rows.groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups."""
    return sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, *keys: str) -> DataFrame:
    """Per group its number of documents and, for each rate, ``low`` and ``high`` (null: no limit)."""
    group = Window.partitionBy(*keys, "rate")
    # A group has a bounded number of buckets, whatever its size.
    rows = sketch.withColumn("seen", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("all", F.sum("n").over(group))
    quarter = lambda q: F.min(F.when(4 * F.col("seen") >= q * F.col("all"), F.col("bucket")))
    rows = rows.groupBy(*keys, "rate").agg(F.max("all").alias("n_docs"), quarter(1).alias("q1"), quarter(3).alias("q3"))
    one = lambda r, c: F.max(F.when(F.col("rate") == r, c))
    reach = lambda a: F.greatest(REACH * (F.col("q3") - F.col("q1")), F.lit(a))
    out = [F.max("n_docs").alias("n_docs")]
    for r, (_, allowance, lower) in RATES.items():
        out.append(one(r, F.col("q3") + reach(allowance)).alias(f"high_{r}"))
        if lower:
            out.append(one(r, F.col("q1") - reach(allowance)).alias(f"low_{r}"))
    return rows.groupBy(*keys).agg(*out)


def _same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    on = [left[k].eqNullSafe(right[k]) for k in keys]
    return on[0] if len(on) == 1 else on[0] & on[1]


def group_limits(sketch: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, n_docs, limits): those of the group, of its language or of all documents."""
    own = limits(sketch, "lang", "source")
    names = [c for c in own.columns if c.startswith(("high_", "low_"))]
    lang = limits(merged(sketch, "lang"), "lang")
    rows = limits(merged(sketch)).limit(1).collect()  # one row, a few numbers
    whole = {c: rows[0][c] for c in names} if rows else dict.fromkeys(names)
    pick = [
        F.when(own["n_docs"] >= least, own[c]).when(lang["n_docs"] >= least, lang[c]).otherwise(F.lit(whole[c]).cast("long")).alias(c)
        for c in names
    ]
    return own.join(lang, _same(own, lang, "lang"), "left").select(own["lang"], own["source"], own["n_docs"], *pick)


def judged(counts: DataFrame, found: DataFrame) -> DataFrame:
    """The counts with ``base_failed`` and ``kept``, by the limits of each row's group.

    The few groups of many documents are met in every task, the others by key.
    """
    total = found.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).first()["n"]
    frequent = HEAVY * F.col("n_docs") > total
    heavy = F.broadcast(found.where(frequent).withColumnsRenamed({"lang": "lang_", "source": "source_"}))
    light = found.where(~frequent).withColumnsRenamed({"lang": "lang_", "source": "source_"})
    same = lambda right: counts["lang"].eqNullSafe(right["lang_"]) & counts["source"].eqNullSafe(right["source_"])
    rest = counts.join(heavy, same(heavy), "left_anti")
    joined = counts.join(heavy, same(heavy)).unionByName(
        rest.join(light, rest["lang"].eqNullSafe(light["lang_"]) & rest["source"].eqNullSafe(light["source_"]), "left"))
    usual = F.lit(True)
    for r, (sql, _, lower) in RATES.items():
        value = F.expr(f"CASE WHEN n_words > 0 THEN {sql} END")
        usual = usual & (value <= F.col(f"high_{r}"))
        if lower:
            usual = usual & (value >= F.col(f"low_{r}"))
    joined = joined.withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & F.coalesce(usual, F.lit(False))
    return joined.withColumn("kept", kept).select(*counts.columns, "base_failed", "kept")


def quality(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The counts, ``base_failed`` and ``kept`` of every row of (doc_id, text, lang, source)."""
    rows = cut(counted(docs))
    return judged(rows, cut(group_limits(cut(sketches(rows)), least)))
