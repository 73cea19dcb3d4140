"""Near copies by MinHash, banding and sequential Bayesian verification.

A document is the set of its distinct runs of ``words`` words. Rows with equal sets are one
class, whatever their number; the rest works on classes, each with the text of one of its
rows. Classes whose signatures agree on all rows of a band are candidates. Their
signatures are compared batch by batch; a pair is dropped as soon as the posterior
probability that its similarity reaches the threshold, given the agreements so far and a
flat prior, is below ``MISS``. Survivors are confirmed on their full sets.

Buckets of a band can hold any number of classes, so pairs are not formed within them. First
every member is compared with the member that shares most bands with others, its hub, as the
original of a group of edited copies is: one pair a member. A hub's row comes first in its
groups of at most ``STAR`` members, which stream past it. What is then known to be connected
is not compared again. Of buckets with the same members the one of the first band is kept,
and there the members outside the hub's component meet all others but the hub that they are
not connected with, in blocks, and in the first band that two share only; blocks give links,
not pairs. So a group of near copies costs one comparison a member and what its stragglers
need, and no pair that could join two components is left out.

Null texts count as empty; a document without words is linked with nothing. Rows with a null
doc_id are linked with nothing and kept. Rows with equal doc_id and equal text are one
document; different texts under one doc_id are told apart. Extra columns are ignored, or kept
as they are by ``without_near_copies``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.durable import cut
from leafgraph.llm import text_arrays as A
from leafgraph.llm.repeats import packed

#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: all but 3e-6 at 0.8, 7e-9 at 0.85.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BATCH = 32
#: The probability at which a pair is given up though its similarity may reach the threshold.
MISS = 1e-7
#: Members of a bucket that meet at a time, and members that stream past one copy of their hub.
BLOCK = 512
STAR = 512
#: Bytes of full sets that a task keeps at a time.
KEPT_BYTES = 32 << 20
#: Short rows of a partition of an intermediate table.
PARTITION_ROWS = 500_000
#: Keys with more than this share of all rows, at most as many, are met in every task instead of by key.
HEAVY = 64


@lru_cache(1)
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names of the distinct shingles of each document, one document after another, and where each starts."""
    low = A.lower_ascii(data)
    s, e = A.words(low, off)
    h = A.names(low, s, e)
    edge = np.searchsorted(s, off)
    g = h.copy()
    for t in range(1, words):
        g = A.finish(g[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[t:]) if len(g) else g
    sets, size = [], np.zeros(len(off) - 1, np.int64)
    for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
        if b - a >= words:
            own = np.unique(g[a:b - words + 1])
        elif b > a:
            own = np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes())], np.uint64)
        else:
            continue
        sets.append(own)
        size[i] = len(own)
    return np.concatenate(sets or [np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(size)])


def signatures(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One byte of each of HASHES least values a set; no set may be empty."""
    a, b = _hashes()
    out = np.empty((len(starts), HASHES), np.uint8)
    for j in range(HASHES):
        least = np.minimum.reduceat(((names * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), starts)
        out[:, j] = A.finish(least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(255)
    return out


SKETCH = "doc_id long, t long, n_shingles long, s1 long, s2 long, signature binary"


def _sketch_batches(words: int):
    def run(batches):
        for batch in batches:
            data, off = A.utf8(batch.column("text"))
            for i, j in A.runs(off, A.RUN_BYTES // 2):
                names, edge = shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i], words)
                size = np.diff(edge)
                full = np.flatnonzero(size)
                s1, s2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                sign: list = [None] * (j - i)
                if len(full):
                    start = edge[full]
                    s1[full] = np.add.reduceat(A.finish(names ^ np.uint64(0x5851F42D4C957F2D)), start)
                    s2[full] = np.bitwise_xor.reduceat(A.finish(names * np.uint64(0xD1342543DE82EF95)), start)
                    for k, x in zip(full.tolist(), signatures(names, start)):
                        sign[k] = x.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("t").slice(i, j - i), pa.array(size), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(sign, pa.binary())],
                    names=["doc_id", "t", "n_shingles", "s1", "s2", "signature"])

    return run


def _band_keys(sign: np.ndarray) -> np.ndarray:
    """The key of each band's bucket, a row for each signature: the bytes of the band and its number."""
    sign = sign.reshape(-1, BANDS, ROWS)
    key = np.zeros((len(sign), BANDS), np.int64)
    for r in range(ROWS):
        key = key << 8 | sign[:, :, r]
    return key * BANDS + np.arange(BANDS)[None, :]


def _band_batches(batches):
    for batch in batches:
        n = batch.num_rows
        if n:
            key = _band_keys(_signatures(batch.column("signature")))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), batch.column("rep").take(pa.array(np.repeat(np.arange(n), BANDS)))], names=["key", "rep"])


@lru_cache(4)
def least_agreements(threshold: float, miss: float) -> tuple[int, ...]:
    """For each batch's end: agreements below which the posterior of reaching the threshold is under ``miss``.

    The posterior of an agreement's probability s after m agreements of n is
    Beta(m + 1, n - m + 1). Bytes of different values agree once in 256 times, so s is the
    similarity and a 256th of what it lacks of 1.
    """
    threshold += (1 - threshold) / 256
    s = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(log - log.max())
            if p[s >= threshold].sum() >= miss * p.sum():
                out.append(m)
                break
    return tuple(out)


def alive(own: np.ndarray, others: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Rows of ``others`` that may reach the threshold with the signature ``own``, compared batch by batch, most agreements first."""
    at, m = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k, floor in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        m += (others[at, part] == own[part]).sum(1)
        at, m = at[m >= floor], m[m >= floor]
    return at[np.argsort(-m, kind="stable")]


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def set_of(packed_text: bytes, words: int) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(packed_text), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), words)[0]


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _star_batches(words: int, percent: int, least: tuple[int, ...]):
    """Links between hubs and the members that follow each; rows are sorted by (a, salt), hubs first (b is null)."""

    def run(batches):
        group, sign, own = None, None, None
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                a, salt = part.column("a").to_numpy(), part.column("salt").to_numpy()
                hub = np.array(part.column("b").is_null())
                signs, texts = _signatures(part.column("signature")), part.column("packed")
                edge = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (salt[1:] != salt[:-1])) + 1).tolist(), len(a)]
                out = []
                for i, j in zip(edge[:-1], edge[1:]):
                    if hub[i]:
                        group, sign, own, i = (a[i], salt[i]), signs[i], set_of(texts[i].as_py(), words), i + 1
                    assert i == j or group == (a[i], salt[i])
                    for x in np.sort(i + alive(sign, signs[i:j], least)).tolist():
                        if reaches(own, set_of(texts[x].as_py(), words), percent):
                            out.append(x)
                yield part.select(["a", "b"]).take(pa.array(out, pa.int64()))

    return run


def _meet_batches(words: int, percent: int, threshold: float):
    """Links between the left and right rows of each (key, a, t), by which the rows are sorted.

    Pairs known to be connected are left out, and pairs that share an earlier band. A row
    of the left needs no second link into a component.
    """

    def links(table: pa.Table):
        left = table["left"].to_numpy(zero_copy_only=False)
        rep, comp = table["rep"].to_numpy(), table["least"].to_numpy()
        sign = _signatures(table["signature"])
        key = table["key"].to_numpy()[0]
        keys = _band_keys(sign)
        band = int(key) % BANDS
        within = table["t"].to_numpy()[0] < 0 and table["a"].to_numpy()[0] == -1 - table["t"].to_numpy()[0]
        ask, meet = np.flatnonzero(left), np.flatnonzero(left if within else ~left)
        texts, sets, held, out = table["packed"], {}, 0, []
        least = least_agreements(threshold, MISS)
        for i in ask.tolist():
            others = meet[comp[meet] != comp[i]]
            if within:
                others = others[others > i]
            others = others[~(keys[others, :band] == keys[i, :band]).any(1)] if band else others
            done = set()
            for j in others[alive(sign[i], sign[others], least)].tolist():
                if comp[j] in done:
                    continue
                if held > KEPT_BYTES:
                    sets.clear()
                    held = 0
                for x in (i, j):
                    if x not in sets:
                        sets[x] = set_of(texts[x].as_py(), words)
                        held += sets[x].nbytes
                if reaches(sets[i], sets[j], percent):
                    done.add(comp[j])
                    out.append((rep[i], rep[j]))
        return out

    def batch_of(pairs):
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                table = pa.Table.from_batches([part])
                table = table if held is None else pa.concat_tables([held, table])
                edge = _group_edges(table)
                held = table.slice(edge[-2])
                yield batch_of([x for a, b in zip(edge[:-2], edge[1:-1]) for x in links(table.slice(a, b - a))])
        if held is not None:
            yield batch_of(links(held))

    return run


def _group_edges(table: pa.Table) -> list[int]:
    k, a, t = (table[c].to_numpy() for c in ("key", "a", "t"))
    new = (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (t[1:] != t[:-1])
    return [0, *(np.flatnonzero(new) + 1).tolist(), len(k)]


def small(df: DataFrame, rows: int) -> DataFrame:
    """Written out, in as few partitions as ``rows`` short rows need."""
    return cut(df.coalesce(1 + rows // PARTITION_ROWS))


def frequent(counts: DataFrame, total: int, *keys: str) -> list:
    """Keys of ``counts`` (keys, n) with more than their share of all rows; fewer than HEAVY."""
    return counts.where(HEAVY * F.col("n") > total).select(*keys).collect()


def matched(left: DataFrame, right: DataFrame, *keys: str, heavy: list, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key; rows of the ``heavy`` keys are met in every task."""
    if not heavy:
        return left.join(right, list(keys), how)
    is_heavy = F.lit(False)
    for row in heavy:
        one = F.lit(True)
        for k in keys:
            one = one & (F.col(k) == F.lit(row[k]))
        is_heavy = is_heavy | one
    rest = left.where(~is_heavy).join(right.where(~is_heavy), list(keys), how)
    return left.where(is_heavy).join(F.broadcast(right.where(is_heavy)), list(keys), how).unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """(node, least): the least node that each node of the links (a, b) is connected with.

    Every round tells each node the least label next to it, and then the label of its label,
    so that a chain takes as many rounds as its length has binary digits, about. Nodes with
    very many links, and labels of very many nodes, are met in every task.
    """
    edges = cut(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    total = edges.count()
    edges = small(edges, total)
    labels = small(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("least")), total)
    nodes = labels.count()
    hubs = frequent(edges.groupBy("b").agg(F.count("*").alias("n")), total, "b")
    while True:
        far = matched(edges, labels.select(F.col("node").alias("b"), "least"), "b", heavy=hubs)
        far = far.groupBy(F.col("a").alias("node")).agg(F.min("least").alias("near"))
        near = small(labels.join(far, "node").select("node", F.least("least", "near").alias("least"), F.col("least").alias("old")), total)
        hop = near.select(F.col("node").alias("least"), F.col("least").alias("next"))
        large = frequent(near.groupBy("least").agg(F.count("*").alias("n")), nodes, "least")
        new = small(matched(near, hop, "least", heavy=large, how="left").select("node", F.coalesce("next", "least").alias("least"), "old"), total)
        labels = new.select("node", "least")
        if new.where("least <> old").isEmpty():
            return labels


def _star_links(pairs: DataFrame, bodies: DataFrame, words: int, percent: int, least: tuple[int, ...]) -> DataFrame:
    """The pairs (hub a, member b) that reach the threshold."""
    total = pairs.count()
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salted = matched(pairs, sizes.withColumn("salts", F.ceil(F.col("n") / STAR)).drop("n"), "a", heavy=frequent(sizes, total, "a"))
    salted = small(salted.select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt")), total)
    body = lambda key: bodies.withColumnRenamed("rep", key)
    members = salted.join(body("b"), "b").select("a", "salt", "b", "signature", "packed")
    hubs = salted.select("a", "salt").distinct().join(body("a"), "a")
    hubs = hubs.select("a", "salt", F.lit(None).cast("long").alias("b"), "signature", "packed")
    rows = members.unionByName(hubs).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_star_batches(words, percent, least), "a long, b long")


def _straggler_links(members: DataFrame, first: DataFrame, heavy: list, of: DataFrame, bodies: DataFrame, words: int, percent: int, threshold: float) -> DataFrame:
    """Links of members that their bucket's hub does not reach with the others of the bucket."""
    label = lambda n, c: of.select(F.col("node").alias(n), F.col("least").alias(c))
    total = members.count()
    main = small(first.join(label("a", "main"), "a", "left").select("key", "a", F.coalesce("main", "a").alias("main")), total)
    now = matched(members.select("key", "rep"), main, "key", heavy=heavy).where("rep <> a").drop("a")
    now = now.join(label("rep", "least"), "rep", "left").withColumn("least", F.coalesce("least", "rep"))
    now = small(now.select("key", "rep", "least", (F.col("least") != F.col("main")).alias("asks")), total)
    name = F.xxhash64("rep")
    number = lambda asks: F.count(F.when(F.col("asks") == asks, 1))
    buckets = now.groupBy("key").agg(
        number(True).alias("askers"), number(False).alias("others"), F.sum(F.shiftright(name, 20)).alias("x"), F.bit_xor(name).alias("y"))
    # Fewer than two members besides the hub have all been compared.
    buckets = buckets.where("askers > 0 AND askers + others > 1")
    band = F.pmod("key", F.lit(BANDS))
    buckets = buckets.groupBy("x", "y", "askers", "others").agg(F.min_by("key", band).alias("key"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int").alias(n)
    buckets = small(buckets.select("key", blocks("askers"), blocks("others")), total)
    now = matched(now, buckets, "key", heavy=heavy)
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("asks"), F.col("askers")).otherwise(F.col("others"))).cast("int")
    now = now.withColumn("own", own)
    each = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda a, t, left: F.struct(a.cast("int").alias("a"), t.cast("int").alias("t"), F.lit(left).alias("left"))
    own = F.col("own")
    meets = F.when(
        F.col("asks"),
        F.concat(
            F.transform(each("others"), lambda t: place(own, t, True)),
            F.transform(F.filter(each("askers"), lambda u: u >= own), lambda u: place(own, -1 - u, True)),
            F.transform(F.filter(each("askers"), lambda u: u < own), lambda u: place(u, -1 - own, False)),
        ),
    ).otherwise(F.transform(each("askers"), lambda u: place(u, own, False)))
    now = now.select("key", "rep", "least", F.explode(meets).alias("x")).select("key", "x.a", "x.t", "x.left", "rep", "least")
    now = now.join(bodies, "rep").select("key", "a", "t", "left", "rep", "least", "signature", "packed")
    order = ["key", "a", "t"]
    now = now.repartition(*order).sortWithinPartitions(*order)
    return now.mapInArrow(_meet_batches(words, percent, threshold), "a long, b long")


def _text_hash(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def _judged(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, t, n_shingles, component_id, kept) of every row; t is a hash of its text."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), _text_hash(docs).alias("t"))
    sketch = cut(rows.mapInArrow(_sketch_batches(words), SKETCH))
    full = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = full.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "t")).alias("own"), F.first("signature").alias("signature"), F.count("*").alias("rows"))
    # Numbered as it is written; what is read back has the same numbers every time.
    reps = cut(classes.select(F.monotonically_increasing_id().alias("rep"), "s1", "s2", "own.doc_id", "own.t", "signature", "rows"))
    total = BANDS * reps.count()
    members = reps.select("rep", "signature").mapInArrow(_band_batches, "key long, rep long")
    counts = small(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), total)
    heavy = frequent(counts, counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"], "key")
    members = small(matched(members, counts, "key", heavy=heavy), total)
    weights = small(members.groupBy("rep").agg(F.sum("n").alias("weight")), total)
    # Texts of the candidates only; their sets are made where a pair is confirmed.
    asked = reps.join(weights.select("rep"), "rep", "left_semi").select("rep", "doc_id", "t")
    texts = rows.join(asked, ["doc_id", "t"]).groupBy("rep").agg(F.first("text").alias("text"))
    bodies = cut(packed(texts).join(reps.select("rep", "signature"), "rep"))
    threshold = percent / 100
    least = least_agreements(threshold, MISS)
    first = small(members.join(weights, "rep").groupBy("key").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("a")), total)
    pairs = matched(members.select("key", "rep"), first, "key", heavy=heavy).where("rep <> a")
    pairs = small(pairs.select(F.col("a"), F.col("rep").alias("b")).distinct(), total)
    links = cut(_star_links(pairs, bodies, words, percent, least))
    of = components(links)
    more = cut(_straggler_links(members, first, heavy, of, bodies, words, percent, threshold))
    if not more.isEmpty():
        of = components(links.unionByName(more))
    # A component is named by the least doc_id of its classes.
    least_id = of.join(reps.select(F.col("rep").alias("node"), "doc_id"), "node").groupBy("least").agg(F.min("doc_id").alias("component"))
    of = matched(of, least_id, "least", heavy=frequent(of.groupBy("least").agg(F.count("*").alias("n")), of.count(), "least"))
    of = of.select(F.col("node").alias("rep"), "component")
    named = small(reps.join(of, "rep", "left").select("s1", "s2", "rows", F.coalesce("component", "doc_id").alias("component")), total)
    copied = frequent(named.withColumnRenamed("rows", "n"), sketch.count(), "s1", "s2")
    found = matched(sketch.select("doc_id", "t", "n_shingles", "s1", "s2"), named.drop("rows"), "s1", "s2", heavy=copied, how="left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    found = found.select("doc_id", "t", "n_shingles", own.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    return _judged(docs, words, percent).drop("t")


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies, the one of least doc_id, as it is."""
    gone = _judged(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias("_gone_id"), F.col("t").alias("_gone_text")).distinct()
    gone = cut(gone)
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["_gone_id"]) & (_text_hash(docs) == gone["_gone_text"]), "left_anti")
