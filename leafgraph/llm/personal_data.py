"""Personal data in texts: fixed patterns, and weak supervision for what they leave out.

The patterns' matches (email, ip, card, phone) always count. Further candidates are written
more loosely: addresses spelled out, numbers in groups without a country code, addresses of
the longer kind. Labelers vote on every candidate or abstain: two read its form, two look it
up in word lists, two read its context. Expectation-maximisation over all candidates of the
corpus estimates how reliable each labeler is, without labels; a logistic span classifier is
then trained on the posteriors, and candidates that it accepts count too.

All of it is column expressions. What is fitted are counts by kind and votes, of which there
are at most 4 * 3^6; the fit itself is an expression over that list.

Null texts count as empty. Texts of any length are searched whole, in one pass a pattern:
the patterns give the same matches as plain ones but never go back. ``doc_id`` may be null
or repeated, extra columns are ignored or kept. Of equal candidates in many copies each
counts, as the corpus is what the fit describes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.columns import carried

KINDS = ("email", "ip", "card", "phone")

# The patterns asked for, written so that a failed attempt never backtracks: a run of
# characters is tried from its start or from the end of the match before, nowhere else.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?![0-9])"

# Looser forms.
SPELLED = (
    r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,40}+(?: ?[(\[]at[)\]] ?| at )[a-z0-9-]{2,40}+"
    r"(?:(?: ?[(\[]dot[)\]] ?| dot |\.)[a-z0-9-]{2,40}+){1,4}"
)
LONG_IP = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
GROUPED = r"(?<![0-9+.,-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])"

# Word lists: values the lookups depend on.
TOP_DOMAINS = "com org net edu gov info io eu de fr es uk us it nl ch at be pt pl se no fi dk ca au jp br mx".split()
CUES = {
    "email": "mail e-mail email contact write reach correo courriel kontakt address".split(),
    "ip": "ip host server address client from login adresse".split(),
    "card": "card visa mastercard credit debit payment pay karte carte tarjeta".split(),
    "phone": "phone tel telephone call mobile cell fax dial contact whatsapp telefon telefono".split(),
}
OTHER_NUMBERS = "isbn issn version release order invoice ticket serial article section page id ref no nr date doi".split()
RESERVED = r"^(?:0|10|127|169\.254|192\.168|22[4-9]|2[3-5][0-9])\."

ROUNDS = 60
STEPS = 300
LABELERS = 6


def spans_of(text: Column, pattern: str, worth: Column) -> Column:
    """(start, end, value) of all matches: the pieces between them tell where they stand."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    parts = F.arrays_zip(found.alias("value"), between.alias("gap"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(state, x):
        start = state["at"] + x["gap"]
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    real = F.filter(parts, lambda x: x["value"].isNotNull())
    whole = F.aggregate(real, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda s: s["out"])
    return F.when(worth, whole).otherwise(empty)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits' check sum is right."""
    n = F.length(number)

    def value(i):
        d = F.substr(number, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + value(i))
    return total % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    octets = f"^{BYTE}" + rf"(?:\.{BYTE}){{3}}$"
    size = lambda x: F.length(digits(x))
    return {
        "email": spans_of(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(spans_of(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: x["value"].rlike(octets)),
        "card": F.filter(
            spans_of(text, CARD, text.rlike("[0-9][ -]?[0-9]")),
            lambda x: F.when(size(x["value"]).between(14, 19), luhn(digits(x["value"]))).otherwise(False)),
        "phone": F.filter(spans_of(text, PHONE, F.contains(text, F.lit("+"))), lambda x: size(x["value"]).between(10, 15)),
    }


def loose_spans(text: Column) -> dict[str, Column]:
    return {
        "email": spans_of(text, SPELLED, text.rlike(r"(?i)[(\[]at[)\]]| at [a-z0-9-]+(?:\.|[ (\[]+dot)")),
        "ip": spans_of(text, LONG_IP, text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")),
        "phone": spans_of(text, GROUPED, text.rlike("[0-9][ .)-]+[0-9]{3}")),
    }


def word_list(words: list[str]) -> str:
    return r"(?<![\p{L}0-9])(?:" + "|".join(words) + r")(?![\p{L}0-9])"


def votes(text: Column, kind: str, span: Column) -> list[Column]:
    """One vote a labeler: 1 personal, 0 not, null no opinion."""
    value, start, end = span["value"], span["start"], span["end"]
    n = F.length(digits(value))
    before = F.lower(F.substr(text, F.greatest(start - 39, F.lit(1)), F.least(start, F.lit(40))))
    left = F.when(start > 0, F.substr(text, start, F.lit(1))).otherwise("")
    right = F.substr(text, end + 1, F.lit(1))
    yes, no, none = F.lit(1), F.lit(0), F.lit(None).cast("int")
    top = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS)
    form = {
        "email": F.when(value.rlike(r"^[A-Za-z0-9]") & value.rlike(r"[A-Za-z]$"), yes).otherwise(no),
        "ip": F.when(value.contains(":") | value.rlike(r"^[1-9]"), yes).otherwise(no),
        "card": F.when(value.rlike("^[0-9]+$|^[0-9]{4}(?:[ -][0-9]{4}){3}$"), yes).otherwise(no),
        "phone": F.when(value.rlike(r"^\+") | n.between(10, 12), yes).otherwise(no),
    }[kind]
    shape = {
        "email": F.when(value.contains("@"), yes).when(value.rlike(r"(?i)[(\[]at"), yes).when(value.rlike("(?i) at .* dot "), none).otherwise(no),
        "ip": F.when(value.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), yes).when(value.contains(":"), none).otherwise(no),
        "card": F.when(n.isin(14, 15, 16), yes).otherwise(none),
        "phone": F.when(value.rlike(r"^\+"), yes).when(value.rlike(r"^\("), none).otherwise(no),
    }[kind]
    known = {
        "email": F.when(top, yes).otherwise(no),
        "ip": F.when(value.rlike(RESERVED), no).otherwise(none),
        "card": F.when(value.rlike("^[3-6]"), yes).otherwise(no),
        "phone": F.when(value.rlike(r"^(?:\+|00)[1-9]"), yes).otherwise(none),
    }[kind]
    cue = F.when(before.rlike(word_list(CUES[kind])), yes).otherwise(none)
    other = F.when(before.rlike(word_list(OTHER_NUMBERS) + r"[ .:#=-]*$"), no).otherwise(none)
    alone = F.when(left.rlike(r"[\p{L}0-9_/=#]") | right.rlike(r"[\p{L}0-9_/]"), no).otherwise(yes)
    return [form, shape, known, cue, other, alone]


def candidates(docs: DataFrame) -> DataFrame:
    """With ``base`` and ``loose``: (start, kind, end, key) of what the patterns and looser forms find.

    kind is the place in KINDS; key holds kind and votes, one letter each.
    """
    text = F.col("text")

    def keyed(kind: str, spans: Column) -> Column:
        def one(x):
            letters = [F.when(v.isNull(), "n").otherwise(v.cast("string")) for v in votes(text, kind, x)]
            number = KINDS.index(kind)
            return F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), F.concat(F.lit(str(number)), *letters).alias("key"))

        return F.transform(spans, one)

    rows = docs.withColumn("text", F.coalesce(text.cast("string"), F.lit("")))
    rows = rows.withColumn("base", F.array_sort(F.concat(*[keyed(k, s) for k, s in base_spans(text).items()])))
    rows = rows.withColumn("loose", F.concat(*[keyed(k, s) for k, s in loose_spans(text).items()]))
    clear = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    return rows.withColumn("loose", F.array_sort(F.filter("loose", clear)))


def total(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda s, r: s + value(r))


def accepted(counts: DataFrame) -> DataFrame:
    """Keys that the span classifier accepts, from (key, n) of all candidates."""
    vote = [F.when(F.substr("key", F.lit(i + 2), F.lit(1)) == "n", None).otherwise(F.substr("key", F.lit(i + 2), F.lit(1)).cast("int")) for i in range(LABELERS)]
    one = F.struct("key", F.col("n").cast("double").alias("n"), F.substr("key", F.lit(1), F.lit(1)).cast("int").alias("kind"), F.array(*vote).alias("v"))
    table = counts.agg(F.array_sort(F.collect_list(one)).alias("rows"))  # one row; the keys are bounded by their letters
    labelers = F.sequence(F.lit(0), F.lit(LABELERS - 1))

    def logit(p):
        return F.log(p / (1 - p))

    def posterior(state, r):
        def weigh(l):
            a, b, v = state["a"][l], state["b"][l], r["v"][l]
            return F.when(v == 1, F.log(a / b)).when(v == 0, F.log((1 - a) / (1 - b))).otherwise(0.0)

        odds = logit(state["pi"]) + F.aggregate(labelers, F.lit(0.0), lambda s, l: s + weigh(l))
        return 1 / (1 + F.exp(-odds))

    def seen(rows, q, l, side):
        """Share of 1 among the votes of labeler l, by posterior; smoothed towards better than chance."""
        pairs = F.arrays_zip(rows.alias("r"), q.alias("q"))
        weight = lambda x: x["r"]["n"] * (x["q"] if side else 1 - x["q"])
        ones = total(pairs, lambda x: F.when(x["r"]["v"][l] == 1, weight(x)).otherwise(0.0))
        cast = total(pairs, lambda x: F.when(x["r"]["v"][l].isNotNull(), weight(x)).otherwise(0.0))
        return (ones + (1.6 if side else 0.4)) / (cast + 2.0)

    def em(rows):
        first = F.transform(rows, lambda r: 0.1 + 0.8 * F.coalesce(
            total(r["v"], lambda v: F.coalesce(v.cast("double"), F.lit(0.0))) / F.nullif(total(r["v"], lambda v: v.isNotNull().cast("double")), F.lit(0.0)), F.lit(0.5)))
        start = F.struct(
            F.lit(0.5).alias("pi"), F.transform(labelers, lambda l: F.lit(0.8)).alias("a"), F.transform(labelers, lambda l: F.lit(0.3)).alias("b"), first.alias("q"))

        def step(state, _):
            n = total(rows, lambda r: r["n"])
            yes = total(F.arrays_zip(rows.alias("r"), state["q"].alias("q")), lambda x: x["r"]["n"] * x["q"])
            return F.struct(
                ((yes + 1) / (n + 2)).alias("pi"), F.transform(labelers, lambda l: seen(rows, state["q"], l, True)).alias("a"),
                F.transform(labelers, lambda l: seen(rows, state["q"], l, False)).alias("b"), F.transform(rows, lambda r: posterior(state, r)).alias("q"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["q"])

    width = 1 + len(KINDS) + LABELERS
    places = F.sequence(F.lit(0), F.lit(width - 1))

    def features(r):
        kinds = [(r["kind"] == i).cast("double") for i in range(len(KINDS))]
        return F.array(F.lit(1.0), *kinds, *[F.coalesce(r["v"][l] * 2.0 - 1.0, F.lit(0.0)) for l in range(LABELERS)])

    def train(rows):
        """Weighted logistic regression on the posteriors, by gradient steps."""
        n = total(rows, lambda r: r["n"])
        start = F.struct(F.transform(places, lambda f: F.lit(0.0)).alias("w"), F.transform(rows, lambda r: F.lit(0.5)).alias("p"))

        def step(state, _):
            pairs = F.arrays_zip(rows.alias("r"), state["p"].alias("p"))
            slope = lambda f: total(pairs, lambda x: x["r"]["n"] * (x["p"] - x["r"]["q"]) * x["r"]["x"][f]) / n
            w = F.transform(places, lambda f: state["w"][f] - 0.5 * (slope(f) + 1e-4 * state["w"][f]))
            score = lambda r: F.aggregate(places, F.lit(0.0), lambda s, f: s + state["w"][f] * r["x"][f])
            return F.struct(w.alias("w"), F.transform(rows, lambda r: 1 / (1 + F.exp(-score(r)))).alias("p"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["p"])

    fitted = table.where(F.size("rows") > 0).withColumn("q", em(F.col("rows")))
    joined = F.transform(F.arrays_zip("rows", "q"), lambda x: F.struct(x["rows"]["key"].alias("key"), x["rows"]["n"].alias("n"), x["q"].alias("q"), features(x["rows"]).alias("x")))
    fitted = fitted.select(joined.alias("rows"))
    fitted = fitted.withColumn("p", train(F.col("rows")))
    return fitted.select(F.explode(F.arrays_zip("rows", "p")).alias("x")).select(F.col("x.rows.key").alias("key"), F.col("x.rows.n").alias("n"), F.col("x.rows.q").alias("q"), F.col("x.p").alias("p"))


def personal_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: (start, kind, end, key) of the patterns' matches and of all spans."""
    rows = candidates(docs)
    counts = rows.select(F.explode(F.concat("base", "loose")).alias("x")).groupBy(F.col("x.key").alias("key")).agg(F.count("*").alias("n"))
    keys = [r["key"] for r in accepted(counts).where("p >= 0.5").select("key").collect()]  # at most 4 * 3^6
    taken = F.filter("loose", lambda x: x["key"].isin(keys)) if keys else F.filter("loose", lambda x: F.lit(False))
    return rows.withColumn("spans", F.array_sort(F.concat("base", taken))).drop("loose")


def listed(spans: str) -> Column:
    """kind:start:end of each, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name[x["kind"]], x["start"], x["end"])), ",")


def masked(docs: DataFrame) -> DataFrame:
    """Texts with [EMAIL], [IP], [CARD] or [PHONE] in place of each span.

    ``n_chars`` follows the text, other columns may have any names and stay as they are.
    """
    inner, restored = carried(docs, "doc_id", "text", "n_chars")
    rows = personal_spans(inner)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")
    # Spans that begin inside an earlier one are part of it.
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(state, x):
        piece = F.substr(text, state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
        out = F.when(x["start"] >= state["at"], F.concat(state["out"], F.array(piece, marks[x["kind"]]))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), out.alias("out"))

    built = F.aggregate("spans", first, add, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, s["at"] + 1, F.greatest(F.length(text) - s["at"], F.lit(0)))))
    new = rows.withColumn("text", F.when(F.size("spans") > 0, built).otherwise(text))
    return restored(new, n_chars=F.length("text").cast("long"))
