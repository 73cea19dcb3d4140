"""A hierarchical Pitman-Yor language model with forward seating.

The restaurant of a token is that of the token before it (of the end, for the first of a
text), and all restaurants share one parent, the restaurant of all tokens, whose base is
uniform over the distinct training tokens and one more, which stands for any other token.

Each sweep seats all customers of every dish anew, given the tables of the others as the
sweep before left them, so that pairs are independent within a sweep and spread over
tasks. Tables of contexts are the parent's customers. The first sweep is left out; a pair's
probability is the average predictive probability of the others, and a document's score the
sum of its logarithms over all tokens and the end. A pair seen once always has one table,
so only pairs seen more often are seated and kept by the sweeps.

Tokens with a share of ``FREQUENT`` of all, of which there are at most 1 / FREQUENT, are
known to every task by their rank. A pair goes to one of many parts: that of its token if
this is rare, else that of its context if this is rare, else one by both. So a part has all
of a rare token's customers, and only contexts of pairs of two rare tokens lie elsewhere:
their tables are asked for. Tasks send pairs as packed arrays, in order of the documents; a
pair that a task meets ``HOT`` times is sent once with its count, so no key is hot. The same
shuffled pairs serve to count them, and again to score them.

Null texts count as empty and hold the end only. A null doc_id is not held out. Rows with
equal doc_id are scored one by one. Extra columns are ignored; without training
tokens every token has probability 1.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.durable import scratch_folder
from leafgraph.llm import text_arrays as A
from leafgraph.llm.packed import packed, unpacked
from leafgraph.llm.repeats import keyed

SWEEPS = 4
FREQUENT = 2e-6
#: Discount and concentration of the contexts' restaurants and of their parent.
CONTEXT = (0.8, 10.0)
PARENT = (0.5, 10.0)
#: Customers seated one by one; later ones come in groups of at most GROUP of those seated.
SINGLY, GROUP = 64, 0.02

END = 0  # stands for the end of a text, and for what is before its first token
#: Tokens whose pairs a task sends at once, and tokens a part of the pairs is meant to hold.
COUNTED, PART = 1 << 20, 3 << 19
#: Times a pair is met in them to be sent once with its count.
HOT = 64
#: Parts of the frequent tokens in which their customers are added up.
SLICES = 16


def seat(customers: np.ndarray, base: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers came one after another.

    strength: concentration plus discount times all tables, by dish or alike for all. A new
    table is opened with weight strength * base, against the customers seated less the
    discount for each table. Beyond SINGLY customers, groups small against those seated are
    seated at once, at the probability of the group's middle.
    """
    n = customers.astype(np.int64)
    tables = (n > 0).astype(np.int64)
    weight = strength * base
    for k in range(1, SINGLY):
        more = np.flatnonzero(n > k)
        if not len(more):
            return tables
        w = weight[more]
        tables[more] += rng.random(len(more)) * (w + k - discount * tables[more]) < w
    seated = np.minimum(n, SINGLY)
    while len(more := np.flatnonzero(n > seated)):
        w, old = weight[more], seated[more] - discount * tables[more]
        step = np.minimum(np.maximum(((w + old) * GROUP).astype(np.int64), 1), n[more] - seated[more])
        tables[more] += rng.binomial(step, np.clip(w / (w + old + step / 2), 0, 1))
        seated[more] += step
    return tables


def _tokens(batch):
    """Runs of documents: (first, last, names, owners) of all tokens in order, ends included."""
    data, off = A.utf8(batch.column("text"))
    for i, j in A.runs(off):
        low, o = A.lower_ascii(data[off[i]:off[j]]), off[i:j + 1] - off[i]
        s, e = A.words(low, o)
        number = np.diff(np.searchsorted(s, o))
        ends = np.cumsum(number)
        h = np.insert(A.names(low, s, e) >> np.uint64(1), ends, np.uint64(END)).view(np.int64)
        yield i, j, h, np.repeat(np.arange(j - i), number + 1)


def _codes(h: np.ndarray, names: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The rank of each token among the frequent ones, whose ``names`` are sorted, or a negative number of its own."""
    if not len(names):
        return ~h
    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
    return np.where(names[at] == h, rank[at], ~h)


def _last_marks(mark: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each token the last mark before it in its document, or -1."""
    at = np.where(mark >= 0, np.arange(len(mark)), -1)
    last = np.maximum.accumulate(np.concatenate([[-1], at]))[:-1] if len(at) else at
    same = (last >= 0) & (doc[last] == doc)
    return np.where(same, mark[last], -1)


def _count_batches(batches):
    """Partial counts: all, and those in training documents."""
    for batch in batches:
        held = batch.column("held_out").to_numpy(zero_copy_only=False)
        for i, j, h, doc in _tokens(batch):
            name, inverse = np.unique(h, return_inverse=True)
            train = np.bincount(inverse, ~held[i + doc], len(name)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(train), pa.array(np.bincount(inverse, minlength=len(name)))], names=["h", "c", "n"])


def _before(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The token before each in its document, or END."""
    last = _last_marks(np.arange(len(h)), doc)
    return np.where(last >= 0, h[last], END) if len(h) else h


def _mixed(*keys: np.ndarray) -> np.ndarray:
    mixed = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        mixed = A.finish(mixed * np.uint64(A._MULT) + k.view(np.uint64))
    return mixed


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows with equal keys together."""
    mixed = _mixed(*keys)
    order = np.argsort(mixed)
    mixed = mixed[order]
    new, other = np.ones(len(order), bool), np.zeros(len(order), bool)
    new[1:] = mixed[1:] != mixed[:-1]
    for k in keys:
        k = k[order]
        other[1:] |= k[1:] != k[:-1]
    if np.any(other & ~new):  # two keys are mixed alike
        order = np.lexsort(keys)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new)


def _homes(u: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    """The part of each pair."""
    key = np.where(w < 0, w, np.where(u < 0, u, u * (1 << 32) + w)).view(np.uint64)
    return (A.finish(A.finish(key * np.uint64(A._MULT))) % np.uint64(parts)).astype(np.int64)


def _split(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks, -1 for rare tokens; and these."""
    return np.maximum(codes, -1), codes[codes < 0]


def _merged(ranks: np.ndarray, rare: np.ndarray) -> np.ndarray:
    ranks[ranks < 0] = rare
    return ranks


def _pair_batches(names: np.ndarray, rank: np.ndarray, c_top: np.ndarray, totals: dict, parts: int):
    """Pairs of some millions of tokens, a row for each part they go to, and one with what is known of the documents."""
    base_top = np.append(np.log10(c_top + 0.5) - _base_less(totals), 0.0)  # that of a rare token is added where its pairs are
    known_top = np.append(c_top > 0, False)

    def flushed(number: int, docs: list, held: np.ndarray):
        n = len(held)
        key, prints, doc, u, w = (np.concatenate(x) for x in zip(*docs))
        ranks = np.maximum(w, -1)
        base, found = np.bincount(doc, base_top[ranks], n), np.bincount(doc, known_top[ranks], n).astype(np.int64)
        flush = (TaskContext.get().partitionId(), number, int(prints.sum(dtype=np.uint64)))
        train = ~held[doc]
        bins = (_mixed(u, w) >> np.uint64(44)).view(np.int64)
        crowded = np.flatnonzero((np.bincount(bins) >= HOT)[bins])
        order, start = _distinct(u[crowded], w[crowded])
        order = crowded[order]
        size = np.diff(np.append(start, len(order)))
        hot = size >= HOT
        inside = np.repeat(hot, size)
        which = np.full(len(u), -1, np.int64)
        which[order[inside]] = np.repeat(np.arange(hot.sum()), size[hot])
        first = order[start[hot]]
        hu, hw, hn = u[first], w[first], size[hot]
        hc = np.bincount(which[which >= 0], train[which >= 0], len(hn)).astype(np.int64)
        cold = which < 0
        doc_hot, which, doc, u, w, train = doc[~cold], which[~cold], doc[cold], u[cold], w[cold], train[cold]
        place, hot_place = _homes(u, w, parts), _homes(hu, hw, parts)
        by, hot_by = np.argsort(place.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable"), np.argsort(hot_place, kind="stable")
        edges, hot_edges = (np.searchsorted(p, np.arange(parts + 1)) for p in (place[by], hot_place[hot_by]))
        used = np.flatnonzero((np.diff(edges) > 0) | (np.diff(hot_edges) > 0))
        home = hash(flush[:2]) % parts
        for p in used.tolist():
            at, hot_at = by[edges[p]:edges[p + 1]], hot_by[hot_edges[p]:hot_edges[p + 1]]
            yield p, flush, ("pairs", home, packed(
                *_split(u[at]), *_split(w[at]), np.diff(doc[at], prepend=0), train[at].astype(np.int8),
                *_split(hu[hot_at]), *_split(hw[hot_at]), hot_at, hc[hot_at], hn[hot_at]))
        tokens = np.bincount(np.concatenate([doc, doc_hot]), minlength=n)
        none = np.array([k is None for k in key], bool)
        ids = np.array([0 if k is None else k for k in key], np.int64)
        yield home, flush, ("docs", len(used), packed(ids, none.astype(np.int8), held.astype(np.int8), tokens, base, found, np.diff(doc_hot, prepend=0), which))

    def blocks(batches):
        docs, held, size, number = [], [], 0, 0
        for batch in batches:
            out = batch.column("held_out").to_numpy(zero_copy_only=False)
            key = np.array(batch.column("doc_id").to_pylist(), object)
            prints = [batch.column(x).to_numpy().view(np.uint64) for x in ("d1", "d2")]
            prints = A.finish(A.finish(prints[0]) + prints[1])
            for i, j, h, doc in _tokens(batch):
                code = _codes(np.append(h, END), names, rank)
                w, u = code[:-1], _before(code[:-1], doc)
                u[np.diff(doc, prepend=-1) != 0] = code[-1]
                docs.append((key[i:j], prints[i:j], doc + sum(map(len, held)), u, w))
                held.append(out[i:j])
                size += len(h)
                if size >= COUNTED:
                    yield from flushed(number, docs, np.concatenate(held))
                    docs, held, size, number = [], [], 0, number + 1
        if docs:
            yield from flushed(number, docs, np.concatenate(held))

    def run(batches):
        for p, flush, value in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([pickle.dumps((value[0], flush, *value[1:]))], pa.binary())], names=["p", "value"])

    return run


def _base_less(totals: dict) -> float:
    return math.log10(totals["train_tokens"] + 0.5 * (totals["distinct"] + 1))


def parent(c, t, totals: dict):
    """Probability of tokens in the restaurant of all; arrays or columns."""
    d0, th0 = PARENT
    return (c - t * d0 + (th0 + d0 * totals["parent_t"]) / (totals["distinct"] + 1)) / (th0 + totals["parent_c"])


def predictive(c, t, parent_c, parent_t, totals: dict) -> np.ndarray:
    """Probability of each token in each context, a column a context."""
    d, th = CONTEXT
    p0 = parent(parent_c, parent_t, totals)
    return (c - d * t + (th + d * totals["t"])[None, :] * p0[:, None]) / (th + totals["c"])[None, :]


def _place(p: int) -> int:
    return p


def _by_tag(items) -> dict:
    found = defaultdict(list)
    for _, value in items:
        found[value[0]].append(value[1:])
    return found


def _grouped(values: list):
    """(blocks, u, w, trained and all occurrences, group of each) of the pairs of a part.

    A block is its flush, the home of its documents, the document of each cold pair, and
    the numbers of its hot ones.
    """
    blocks, u, w, c, n = [], [], [], [], []
    for flush, home, x in sorted(values):
        u0, u1, w0, w1, doc, train, hu0, hu1, hw0, hw1, hot, hc, hn = unpacked(x)
        blocks.append((flush, home, np.cumsum(doc).astype(np.int32), hot))
        u += [_merged(u0, u1), _merged(hu0, hu1)]
        w += [_merged(w0, w1), _merged(hw0, hw1)]
        c += [train, hc]
        n += [np.ones(len(train), np.int64), hn]
    none = np.zeros(0, np.int64)
    u = np.concatenate([none, *u])  # one by one, so that few arrays stand twice
    w = np.concatenate([none, *w])
    c = np.concatenate([none, *c])
    n = np.concatenate([none, *n])
    order, start = _distinct(u, w)
    group = np.empty(len(u), np.int32)
    group[order] = np.repeat(np.arange(len(start), dtype=np.int32), np.diff(np.append(start, len(u))))
    first = order[start]
    return blocks, u[first], w[first], *(np.add.reduceat(x[order], start) if len(u) else none for x in (c, n)), group


def _total(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, values, size).astype(np.int64)


class _Part:
    """The pairs of a part that are seated, and its rare tokens: ``own``, and contexts that lie elsewhere, ``far``.

    Dishes are numbered as the frequent tokens and then the own ones, contexts likewise and then the far ones.
    """

    def __init__(self, values, size: int):
        self.u, self.w, self.c, self.own, self.own_c, self.own_n, self.own_tu, self.own_c0, self.far, self.far_tu = unpacked(values)
        self.size, self.by_name = size, np.argsort(self.far)

    def dishes(self, w: np.ndarray) -> np.ndarray:
        at, rare = w.copy(), np.flatnonzero(w < 0)
        at[rare] = self.size + np.searchsorted(self.own, w[rare])
        return at

    def contexts(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        at = u.copy()
        near, away = np.flatnonzero((u < 0) & (w >= 0)), np.flatnonzero((u < 0) & (w < 0))
        at[near] = self.size + np.searchsorted(self.own, u[near])
        at[away] = self.size + len(self.own) + self.by_name[np.searchsorted(self.far, u[away], sorter=self.by_name)]
        return at

    def sums(self, context: np.ndarray, dish: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
        """Tables by frequent context and dish, own contexts and dishes, and far contexts."""
        edge = self.size + len(self.own)
        tu, c0 = _total(context, t, edge + len(self.far)), _total(dish, t, edge)
        return [tu[:self.size], c0[:self.size], tu[self.size:edge], c0[self.size:], tu[edge:]]


def _sliced(p: int, top: list[np.ndarray], *more: int):
    return p, ("top", [packed(*x) for x in zip(*(np.array_split(a, SLICES) for a in top))], more)


def _static(size: int, parts: int):
    """Counts the pairs of a part; what no sweep changes."""

    def run(p, items):
        _, u, w, c, n, _ = _grouped(_by_tag(items)["pairs"])
        rare, many, once = w < 0, c > 1, c == 1
        own = np.unique(w[rare])
        far = np.unique(u[rare & (u < 0)])
        far = far[np.argsort(_homes(far, far, parts), kind="stable")]
        none = np.zeros(0, np.int64)
        at = np.searchsorted(own, w[rare])
        part = _Part(packed(none, none, none, own, none, none, none, none, far, none), size)
        tu, c0, own_tu, own_c0, far_tu = part.sums(part.contexts(u[once], w[once]), part.dishes(w[once]), np.ones(int(once.sum()), np.int64))
        yield p, ("part", packed(u[many], w[many], c[many], own, _total(at, c[rare], len(own)), _total(at, n[rare], len(own)), own_tu, own_c0, far, far_tu))
        yield _sliced(p, [tu, c0])

    return run


def _asks(parts: int):
    """Names of the contexts that lie elsewhere, to where they lie."""

    def run(item):
        p, value = item
        if value[0] == "part":
            far = unpacked(value[1][8:9])[0]
            for home, a, b in _ranges(far, parts):
                yield home, ("ask", p, packed(far[a:b]))

    return run


def _ranges(far: np.ndarray, parts: int):
    home = _homes(far, far, parts)
    start = np.flatnonzero(np.diff(home, prepend=-1))
    return zip(home[start].tolist(), start.tolist(), np.append(start[1:], len(home)).tolist())


def _asked(p, items):
    """Where the contexts that others ask for stand among the own ones, and their customers."""
    found = _by_tag(items)
    own, own_c = unpacked(found["part"][0][0][3:5])
    for asker, names in found["ask"]:
        at = np.searchsorted(own, unpacked(names)[0])
        yield p, ("asked", asker, packed(at, own_c[at]))


def _due(item):
    """Tables of far contexts that are due to pairs here, to where they lie."""
    p, value = item
    if value[0] == "due":
        yield value[1], ("told", p, value[2])


def _replies(p, items):
    """Tables of the own contexts, with those due to pairs elsewhere, and of those asked for."""
    found = _by_tag(items)
    told, tu = dict(found["told"]), unpacked(found["state"][0][0][2:3])[0]
    asked = [(asker, *unpacked(x)) for asker, x in found["asked"]]
    if asked:
        tu = tu + _total(np.concatenate([at for _, at, _ in asked]), np.concatenate([unpacked(told[asker])[0] for asker, _, _ in asked]), len(tu))
    yield p, ("full", packed(tu))
    for asker, at, c in asked:
        yield asker, ("reply", p, packed(tu[at], c))


def _far_tables(found: dict) -> list[np.ndarray]:
    got = [unpacked(x) for _, x in sorted(found["reply"])]
    return [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*got)] if got else [np.zeros(0, np.int64)] * 2


def _past(state: list, found: dict, counts: bool) -> tuple[list, list]:
    """([tables of own and far contexts, own customers and tables in the parent], with those of counted sweeps before)."""
    last = [unpacked(found["full"][0][0])[0], _far_tables(found)[0], *unpacked(state[3:5])]
    return last, state[5:] + packed(*last) * counts


def _step(sweep: int, size: int, parts: int, top: tuple | None, before: dict, now: dict, counted: list):
    """Seats all pairs of a part and its own dishes in the parent.

    State: (tables of pairs, their sum over counted sweeps, tables of own contexts due to
    pairs here, own customers and tables in the parent), and what ``_past`` keeps.
    """
    d, th = CONTEXT
    d0, th0 = PARENT

    def run(p, items):
        found = _by_tag(items)
        for (values,) in found["part"]:
            part = _Part(values, size)
            dish, context = part.dishes(part.w), part.contexts(part.u, part.w)
            if sweep:
                (state,) = found["state"][0]
                (tu, far, c0, t0), kept = _past(state, found, sweep - 1 in counted)
                p0 = np.concatenate([top[0], parent(c0, t0, before)])[dish]
                strength = th + d * np.concatenate([top[1], tu, far])[context]
                t = seat(part.c, p0, strength, d, np.random.default_rng([sweep, 2, p]))
                ts = unpacked(state[1:2])[0]
            else:
                t, ts, kept = np.ones(len(part.c), np.int64), np.zeros(len(part.c), np.int64), []
            tu_top, c0_top, own_tu, c0, far_tu = part.sums(context, dish, t)
            c0 = c0 + part.own_c0
            if sweep:
                t0 = seat(c0, np.full(len(c0), 1 / (now["distinct"] + 1)), np.full(len(c0), th0 + d0 * now["parent_t"]), d0, np.random.default_rng([sweep, 1, p]))
            else:
                t0 = np.minimum(c0, 1)
            yield p, ("state", packed(t, ts + t * (sweep in counted), own_tu + part.own_tu, c0, t0) + kept)
            far_tu = far_tu + part.far_tu
            for home, a, b in _ranges(part.far, parts):
                yield p, ("due", home, packed(far_tu[a:b]))
            yield _sliced(p, [tu_top, c0_top], int(c0.sum()), int(t0.sum()))

    return run


def _added(rdd: RDD) -> tuple[list[np.ndarray], list[int]]:
    """Sums over all parts of what they have of the frequent tokens, and of what else they give."""

    def slices(item):
        if item[1][0] == "top":
            for k, values in enumerate(item[1][1]):
                yield k, (unpacked(values), item[1][2])

    got = dict(rdd.flatMap(slices).reduceByKey(lambda a, b: ([x + y for x, y in zip(a[0], b[0])], tuple(x + y for x, y in zip(a[1], b[1]))), SLICES).collect())
    return [np.concatenate([got[k][0][x] for k in range(SLICES)]) for x in range(2)], list(got[0][1])


def fit(docs: DataFrame, sweeps: int = SWEEPS, frequent: float = FREQUENT) -> tuple[DataFrame, dict]:
    """((h, c, n, p), of): counts of every token and its probabilities in the parent, by sweep.

    ``docs`` is keyed, with held_out. ``of`` has the totals, what is known of the frequent
    tokens in ``tops``, and in "pairs" and "last" the pairs and the last state by part.
    """
    spark = docs.sparkSession
    counts = docs.select("text", "held_out").mapInArrow(_count_batches, "h long, c long, n long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    folder = scratch_folder(spark, "pitman_yor")
    counts.write.parquet(f"{folder}/counts")
    counts = spark.read.schema(counts.schema).parquet(f"{folder}/counts")
    d0, th0 = PARENT
    of = counts.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    totals = {"train_tokens": of["c"] or 0, "distinct": of["v"] or 0, "tokens": of["n"] or 0}
    top = counts.where(F.col("n") >= frequent * totals["tokens"]).toArrow().sort_by("h")
    names, size = top["h"].to_numpy(), len(top)
    by_count = np.lexsort((names, -top["n"].to_numpy()))
    rank = np.empty(size, np.int64)
    rank[by_count] = np.arange(size)
    c_top, n_top = (top[x].to_numpy()[by_count] for x in "cn")

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), totals["tokens"] // PART + 1)
    rows = docs.select("doc_id", "d1", "d2", "text", "held_out").mapInArrow(_pair_batches(names, rank, c_top, totals, parts), "p long, value binary")

    def dealt(rdd: RDD) -> RDD:
        return rdd.partitionBy(parts, _place)

    def on_parts(run, *rdds: RDD, stay: bool = False) -> RDD:
        """``run`` on what all of them have of a part; what it gives may ``stay`` there."""
        both = rdds[0]
        for r in rdds[1:]:
            both = both.union(r)
        return both.mapPartitionsWithIndex(run, stay)

    pairs = dealt(rows.rdd.map(lambda r: (r[0], pickle.loads(r[1]))))
    part = on_parts(_static(size, parts), pairs, stay=True).persist(StorageLevel.DISK_ONLY)
    (tu_once, c0_once), _ = _added(part)
    asked = on_parts(_asked, part, dealt(part.flatMap(_asks(parts))), stay=True).persist(StorageLevel.DISK_ONLY)

    counted = [s for s in range(sweeps + 1) if s > 1 or sweeps < 2]  # the first adds nothing yet, the last only adds
    tops, nows, parent_t, now, last = [], [], totals["distinct"], totals, [part]
    p0 = tu = None
    for sweep in range(sweeps + 1):
        state = on_parts(_step(sweep, size, parts, (p0, tu), now, totals | {"parent_t": parent_t}, counted), *last, stay=True).persist(StorageLevel.DISK_ONLY)
        (tu, c0), (own_c0, own_t0) = _added(state)
        tu, c0 = tu + tu_once, c0 + c0_once
        if sweep:
            t0 = seat(c0, np.full(size, 1 / (totals["distinct"] + 1)), np.full(size, th0 + d0 * parent_t), d0, np.random.default_rng([sweep]))
        else:
            t0 = np.minimum(c0, 1)
        parent_t = int(t0.sum()) + own_t0
        now = totals | {"parent_c": int(c0.sum()) + own_c0, "parent_t": parent_t}
        p0 = parent(c0, t0, now)
        if sweep in counted:
            tops.append((p0, tu))
            nows.append(now)
        last = [part, state, dealt(on_parts(_replies, state, asked, dealt(state.flatMap(_due))))]
    totals |= {"pairs": pairs, "last": last, "c_top": c_top, "tops": tops, "nows": nows, "on_parts": on_parts, "dealt": dealt}
    whole = pa.table({"h": names[by_count], "c": c_top, "n": n_top, "p": pa.array(np.stack([p for p, _ in tops], 1).tolist(), pa.list_(pa.float64()))})
    rare = spark.createDataFrame(on_parts(_words(nows), *last), "h long, c long, n long, p array<double>")
    return rare.unionByName(spark.createDataFrame(whole)), totals


def _words(nows: list):
    """Rare tokens with their probabilities in the parent."""

    def run(p, items):
        found = _by_tag(items)
        for (values,), (state,) in zip(found["part"], found["state"]):
            part = _Part(values, 0)
            kept = unpacked(_past(state, found, True)[1])
            cells = np.stack([parent(c0, t0, now) for c0, t0, now in zip(kept[2::4], kept[3::4], nows)], 1)
            yield from zip((~part.own).tolist(), part.own_c.tolist(), part.own_n.tolist(), cells.tolist())

    return run


def _score_parts(totals: dict, c_top: np.ndarray, tops: list, nows: list):
    """Sums over the pairs of a part for each document, and values of hot pairs, to where the document's other sums are."""
    d, th = CONTEXT
    less = _base_less(totals)

    def run(p, items):
        found = _by_tag(items)
        for flush, replies, values in found["docs"]:
            yield p, ("docs", flush, replies, values)
        if not found["pairs"]:
            return
        (values,), (state,) = found["part"][0], found["state"][0]
        part, size = _Part(values, len(c_top)), len(c_top)
        blocks, u, w, c, _, group = _grouped(found["pairs"])
        kept = unpacked(_past(state, found, True)[1])
        far_c = _far_tables(found)[1]
        t = np.minimum(c, 1) * len(tops)
        t[c > 1] = unpacked(state[1:2])[0]
        total = len(tops) * c - d * t
        dish, context = part.dishes(w), part.contexts(u, w)
        del u, w, c, t
        for (p0, tu), now, own_tu, far_tu, own_c0, own_t0 in zip(tops, nows, kept[::4], kept[1::4], kept[2::4], kept[3::4]):
            total += (th + d * np.concatenate([tu, own_tu, far_tu]))[context] * np.concatenate([p0, parent(own_c0, own_t0, now)])[dish]
        score = np.log10(total / (len(tops) * (th + np.concatenate([c_top, part.own_c, far_c]))[context]))
        del total, context
        none = np.zeros(size, np.int64)  # what is known of frequent tokens is added where the documents are
        base = np.concatenate([none, np.log10(part.own_c + 0.5) - less])[dish]
        known = np.concatenate([none, np.minimum(part.own_c, 1)])[dish]
        at = 0
        for flush, home, doc, hot in blocks:
            mine, theirs = group[at:at + len(doc)], group[at + len(doc):at + len(doc) + len(hot)]
            at += len(doc) + len(hot)
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            cold = [np.add.reduceat(v[mine], first) if len(doc) else v[:0] for v in (score, base, known)]
            yield home, ("sums", flush, packed(np.diff(doc[first], prepend=0), *cold, hot, score[theirs], base[theirs], known[theirs]))

    return run


def _documents(train_tokens: int):
    """A row for each document, from the sums of all parts."""

    def run(p, items):
        found, sums = _by_tag(items), defaultdict(list)
        for flush, values in found["sums"]:
            sums[flush].append(values)
        for flush, replies, values in found["docs"]:
            got = sums.pop(flush, [])
            if len(got) != replies:
                raise RuntimeError("a task that ran again met other documents; store them before they are scored")
            ids, none, held, tokens, base, known, doc, which = unpacked(values)
            whole, hot = [np.zeros(len(ids)), base, known], [np.zeros(which.max() + 1 if len(which) else 0) for _ in range(3)]
            for at, *cold, hot_at, hot_score, hot_base, hot_known in sorted(map(unpacked, got), key=lambda x: (len(x[0]), x[1].sum())):
                at = np.cumsum(at)
                for k, v in enumerate(cold):
                    whole[k][at] += v
                for k, v in enumerate((hot_score, hot_base, hot_known)):
                    hot[k][hot_at] = v
            doc = np.cumsum(doc)
            score, base, known = (a + np.bincount(doc, v[which], len(ids)) for a, v in zip(whole, hot))
            for i, missing, h, n, k, b, s in zip(ids.tolist(), none.tolist(), held.tolist(), tokens.tolist(), known.tolist(), base.tolist(), score.tolist()):
                yield None if missing else i, bool(h), n, int(k), train_tokens, b, s
        if sums:
            raise RuntimeError("a task that ran again met other documents; store them before they are scored")

    return run


def score(docs: DataFrame, held_out, sweeps: int = SWEEPS, frequent: float = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``held_out`` is a condition on the rows; the model learns from those that do not meet it.
    """
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    _, of = fit(rows, sweeps, frequent)
    totals = {k: of[k] for k in ("train_tokens", "distinct")}
    parts = of["on_parts"](_score_parts(totals, of["c_top"], of["tops"], of["nows"]), of["pairs"], *of["last"])
    rows = of["dealt"](parts).mapPartitionsWithIndex(_documents(of["train_tokens"]))
    return docs.sparkSession.createDataFrame(
        rows, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", verifySchema=False)


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity a token of the training and the held-out documents."""
    return scored.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))
