"""Spelling variants: words one inserted, deleted or replaced letter apart, by a frequency-vector trie.

Letters are dealt to ``GROUPS`` groups of about equal weight in the vocabulary. A word is the
vector of its counts of letters of each group, and the words are arranged in a trie by the
successive counts. One edit adds at most one letter and takes at most one away, so the vector
of a near word has a surplus of at most one over all groups and a deficit of at most one: a
depth-first search spends a budget of one each, and the words of the leaves it reaches are
verified letter by letter. Counts are kept modulo 8, in which a difference of one is still
seen as one, so a level has at most eight branches.

The upper trie, of nodes with more than ``LEAF_WORDS`` words (or a 1,024th of all, if more), is
found level by level by counting, so it has at most 1,024 nodes a level and fits every task.
Its leaves are shards. A word goes to its own shard, and as a query to each shard that its
search reaches; shards that are larger than a leaf though their counts are spent, and queries
of any number, meet in blocks. In a block the search goes on over the sorted vectors, where a
node of the trie is a range. Each pair is met once: in the later of its two shards.

Words come from ``words``: runs of letters of all rows; null texts have none, a null doc_id
leaves its words as they are, repeated rows count again, extra columns are ignored and an
empty table gives no words. Words of any length are compared.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.durable import cut

#: Groups of letters: levels of the trie.
GROUPS = 16
#: Words of a leaf of the upper trie, and queries that meet it at a time.
LEAF_WORDS = 20_000
#: Bound of the open nodes of a level of the upper trie.
OPEN_NODES = 1024

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, least_length: int = 6, least_count: int = 5, slip: int = 199) -> DataFrame:
    """(word, n): runs of letters with their number; every ``slip``-th occurrence loses a letter.

    Which occurrence and which letter follows from the crc32 of document and run.
    """
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    h = runs.select("run", F.crc32(F.encode(F.concat_ws(":", "id", "run"), "UTF-8")).alias("h"), F.col("id").isNotNull().alias("named"))
    at = F.expr("cast(h % length(run) as int)")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("named") & (F.col("h") % slip == 0), shorter).otherwise(F.col("run"))
    found = h.select(word.alias("word")).where(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letter_groups(vocabulary: DataFrame, groups: int) -> np.ndarray:
    """The group of each code point (modulo 256), frequent letters spread over the groups first."""
    letter = F.explode(F.split("word", "")).alias("letter")
    code = (F.ascii("letter") % 256).alias("code")
    seen = vocabulary.select(letter).where("letter <> ''").groupBy(code).count().collect()  # at most 256 rows
    weight, table = [0] * groups, np.zeros(256, np.int64)
    for r in sorted(seen, key=lambda r: (-r["count"], r["code"])):
        table[r["code"]] = weight.index(min(weight))
        weight[table[r["code"]]] += r["count"]
    return table


def _code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after another, and where each starts."""
    text = words.to_pylist()
    return np.frombuffer("".join(text).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in text], dtype=np.int64)])


def vectors(words: pa.Array, table: np.ndarray, groups: int) -> np.ndarray:
    """A row of counts modulo 8 for each word."""
    letters, off = _code_points(words)
    owner = np.repeat(np.arange(len(words)), np.diff(off))
    return (np.bincount(owner * groups + table[letters & 255], minlength=len(words) * groups).reshape(-1, groups) % 8).astype(np.int64)


def packed(counts: np.ndarray) -> np.ndarray:
    """The counts of a row as one number, three binary digits each, the first ones highest."""
    key = np.zeros(len(counts), np.int64)
    for level in range(counts.shape[1]):
        key = key << 3 | counts[:, level]
    return key


def branches(counts: np.ndarray, surplus: np.ndarray, deficit: np.ndarray):
    """The count of the next level that each search may take: its own, or one off if the budget allows."""
    yield counts, np.ones(len(counts), bool), surplus, deficit
    yield (counts + 1) % 8, surplus > 0, surplus - 1, deficit
    yield (counts - 1) % 8, deficit > 0, surplus, deficit - 1


class UpperTrie:
    """Leaves of the upper trie as sorted ranges of full keys; shard i holds keys from ``first[i]`` on."""

    def __init__(self, leaves: list[tuple[int, int]], groups: int):
        """leaves: (depth, key of that depth)."""
        full = sorted((key << 3 * (groups - depth), depth) for depth, key in leaves)
        self.groups = groups
        self.first = np.array([x for x, _ in full], np.int64)
        self.last = np.array([x + (1 << 3 * (groups - d)) - 1 for x, d in full], np.int64)

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, keys, "right") - 1

    def reached(self, counts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, shard) of each shard from the word's own on that its search reaches."""
        n = len(counts)
        who, key = np.arange(n), np.zeros(n, np.int64)
        surplus, deficit = np.ones(n, np.int64), np.ones(n, np.int64)
        found = []
        for level in range(self.groups):
            step = 3 * (self.groups - level - 1)
            parts = []
            for c, may, s, d in branches(counts[who, level], surplus, deficit):
                w, k = who[may], key[may] | c[may] << step
                # Shards that overlap the node's range of keys.
                a = np.searchsorted(self.last, k, "left")
                b = np.searchsorted(self.first, k + (1 << step) - 1, "right")
                live = (a < b) & (b - 1 >= own[w])
                inside = live & (b - a == 1)
                found.append((w[inside], a[inside]))
                on = live & ~inside
                parts.append((w[on], k[on], s[may][on], d[may][on]))
            who, key, surplus, deficit = (np.concatenate(x) for x in zip(*parts))
        word, shard = (np.concatenate(x) for x in zip(*found))
        keep = shard >= own[word]
        both = np.unique(word[keep] * len(self.first) + shard[keep])
        return both // len(self.first), both % len(self.first)


def upper_trie(keys: DataFrame, groups: int, leaf_words: int) -> tuple[UpperTrie, list[int]]:
    """Count the nodes of each level below those that are too large; also the size of each shard."""
    most = max(leaf_words, keys.count() // OPEN_NODES)
    leaves, sizes, open_nodes = [], {}, [0]
    for depth in range(1, groups + 1):
        node = F.shiftright("key", 3 * (groups - depth))
        inside = keys.where(F.shiftright("key", 3 * (groups - depth + 1)).isin(open_nodes)) if depth > 1 else keys
        counted = inside.groupBy(node.alias("node")).count().collect()  # at most eight for each open node
        open_nodes = []
        for r in counted:
            if r["count"] > most and depth < groups:
                open_nodes.append(r["node"])
            else:
                leaves.append((depth, r["node"]))
                sizes[r["node"] << 3 * (groups - depth)] = r["count"]
        if not open_nodes:
            break
    trie = UpperTrie(leaves, groups)
    return trie, [sizes[x] for x in trie.first.tolist()]


HELD = "shard int, block int, chunk int, word string, n long"
ASKED = "shard int, word string, n long, own boolean"
ASKING = "shard int, block int, chunk int, word string, n long, own boolean"


def _key_batches(table: np.ndarray, groups: int):
    def run(batches):
        for batch in batches:
            key = packed(vectors(batch.column("word"), table, groups))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(key)], names=["word", "n", "key"])

    return run


def _ask_batches(trie: UpperTrie, table: np.ndarray):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                counts = vectors(part.column("word"), table, trie.groups)
                own = trie.shard(part.column("key").to_numpy())
                word, shard = trie.reached(counts, own)
                at = pa.array(word)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int32)), part.column("word").take(at), part.column("n").take(at), pa.array(shard == own[word])],
                    names=["shard", "word", "n", "own"])

    return run


def _dealt(words: pa.Array, parts: np.ndarray) -> np.ndarray:
    """One of the parts for each word."""
    name = np.fromiter((zlib.crc32(w.encode()) for w in words.to_pylist()), np.int64, len(words))
    return name % parts


def _each(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row i n[i] times, with a number from 0 on."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _held_batches(trie: UpperTrie, blocks: np.ndarray, chunks: np.ndarray):
    """Each word in its block of its shard, once for each chunk of queries."""
    def run(batches):
        for batch in batches:
            shard = trie.shard(batch.column("key").to_numpy())
            block = _dealt(batch.column("word"), blocks[shard])
            row, chunk = _each(chunks[shard])
            at = pa.array(row)
            place = [pa.array(x.astype(np.int32)) for x in (shard[row], block[row], chunk)]
            yield pa.RecordBatch.from_arrays(
                [*place, batch.column("word").take(at), batch.column("n").take(at)], names=["shard", "block", "chunk", "word", "n"])

    return run


def _asking_batches(blocks: np.ndarray, chunks: np.ndarray):
    """Each query in its chunk, once for each block of the shard."""
    def run(batches):
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            chunk = _dealt(batch.column("word"), chunks[shard])
            row, block = _each(blocks[shard])
            at = pa.array(row)
            place = [pa.array(x.astype(np.int32)) for x in (shard[row], block, chunk[row])]
            yield pa.RecordBatch.from_arrays(
                [*place, *[batch.column(c).take(at) for c in ("word", "n", "own")]], names=["shard", "block", "chunk", "word", "n", "own"])

    return run


def search(counts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each search that reaches a leaf of the sorted ``keys``: who, and the leaf's range."""
    n, groups = counts.shape
    who, lo, hi = np.arange(n), np.zeros(n, np.int64), np.full(n, len(keys))
    key, surplus, deficit = np.zeros(n, np.int64), np.ones(n, np.int64), np.ones(n, np.int64)
    for level in range(groups):
        step = 3 * (groups - level - 1)
        parts = []
        for c, may, s, d in branches(counts[who, level], surplus, deficit):
            k = key[may] | c[may] << step
            a, b = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k + (1 << step) - 1, "right")
            on = a < b
            parts.append((who[may][on], a[on], b[on], k[on], s[may][on], d[may][on]))
        who, lo, hi, key, surplus, deficit = (np.concatenate(x) for x in zip(*parts))
    return who, lo, hi


def one_edit(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether word i of a and word j of b differ by exactly one inserted, deleted or replaced letter."""
    n, m = np.diff(a_off)[i], np.diff(b_off)[j]
    out = np.zeros(len(i), bool)
    same, near = np.flatnonzero(n == m), np.flatnonzero(np.abs(n - m) == 1)

    def leading(rows: np.ndarray, backwards: bool) -> np.ndarray:
        """Equal letters from the front, or from the back."""
        x, y, most = a_off[i[rows]], b_off[j[rows]], np.minimum(n[rows], m[rows])
        if backwards:
            x, y = x + n[rows] - 1, y + m[rows] - 1
        step, run, live, d = -1 if backwards else 1, np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(live):
            live = live[most[live] > d]
            live = live[a[x[live] + step * d] == b[y[live] + step * d]]
            run[live] += 1
            d += 1
        return run

    front, back = leading(same, False), leading(same, True)
    out[same] = front + back == n[same] - 1
    front, back = leading(near, False), leading(near, True)
    out[near] = front + back >= np.minimum(n[near], m[near])
    return out


#: Pairs that are verified at a time.
PAIRS = 1 << 20
LINKS = "a string, n_a long, b string, n_b long"


def _meet(table: np.ndarray, groups: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        if left.num_rows and right.num_rows:
            own = packed(vectors(left["word"].combine_chunks(), table, groups))
            order = np.argsort(own, kind="stable")
            left, keys = left.take(pa.array(order)), own[order]
            b, b_off = _code_points(left["word"].combine_chunks())
            for part in right.to_batches(max_chunksize=2048):
                a, a_off = _code_points(part.column("word"))
                who, lo, hi = search(vectors(part.column("word"), table, groups), keys)
                size = hi - lo
                edge = np.concatenate([[0], np.cumsum(size)])
                for start in range(0, int(edge[-1]), PAIRS):
                    at = np.arange(start, min(start + PAIRS, int(edge[-1])))
                    leaf = np.searchsorted(edge, at, "right") - 1
                    i, j = who[leaf], lo[leaf] + at - edge[leaf]
                    hit = one_edit(a, a_off, b, b_off, i, j)
                    i, j = pa.array(i[hit]), pa.array(j[hit])
                    found.append(pa.table(
                        [part.column("word").take(i), part.column("n").take(i), left["word"].take(j), left["n"].take(j),
                         part.column("own").take(i)], names=["a", "n_a", "b", "n_b", "own"]))
        if not found:
            return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.int64())], names=["a", "n_a", "b", "n_b"])
        links = pa.concat_tables(found)
        # Within a shard both words ask; the smaller one's find stays.
        return links.filter(pc.or_(pc.invert(links["own"]), pc.less(links["a"], links["b"]))).select(["a", "n_a", "b", "n_b"])

    return run


def near_words(vocabulary: DataFrame, groups: int = GROUPS, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """(a, n_a, b, n_b): every two words of (word, n) that are one edit apart, each pair once."""
    table = letter_groups(vocabulary, groups)
    keyed = cut(vocabulary.mapInArrow(_key_batches(table, groups), "word string, n long, key long"))
    trie, sizes = upper_trie(keyed, groups, leaf_words)
    asks = cut(keyed.mapInArrow(_ask_batches(trie, table), ASKED))
    asked = np.zeros(len(sizes), np.int64)
    for r in asks.groupBy("shard").count().collect():  # a row for each shard
        asked[r["shard"]] = r["count"]
    blocks, chunks = (np.maximum(1, -(-n // leaf_words)) for n in (np.array(sizes, np.int64), asked))
    by = ("shard", "block", "chunk")
    held = keyed.mapInArrow(_held_batches(trie, blocks, chunks), HELD).groupBy(*by)
    asking = asks.mapInArrow(_asking_batches(blocks, chunks), ASKING).groupBy(*by)
    return held.cogroup(asking).applyInArrow(_meet(table, groups), LINKS)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): follow the forms to the last, doubling the step each round.

    A form is more frequent than its word by a fixed factor, so a chain is as long as the
    logarithm of the greatest count and takes as many rounds as that has binary digits.
    """
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def variants(vocabulary: DataFrame, factor: int = 5, groups: int = GROUPS, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n)."""
    vocabulary = cut(vocabulary.select("word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL AND n IS NOT NULL"))
    links = cut(near_words(vocabulary, groups, leaf_words))
    swapped = links.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    # The least of (-n, word) is the most frequent near word, of equal ones the first in code-point order.
    best = F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("w"))).alias("best")
    near = links.unionByName(swapped).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best)
    found = vocabulary.join(near, "word", "left")
    frequent = -F.col("best.n") >= factor * F.col("n")
    found = cut(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.w")).alias("form"),
        F.when(frequent, -F.col("best.n")).alias("form_n")))
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
