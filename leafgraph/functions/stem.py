"""Porter's suffix-stripping algorithm (1980) for English words.

The rules are a table, ``STEPS``, which is compiled to column expressions (``stem_array``,
inside the JVM) and to SQL (``porter_sql``, for engines that check results).  ``porter`` is
the plain form for a single word of a query.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafgraph.functions.text import light_stem

VOWELS = "aeiou"

# Suffix and replacement where the stem before it has measure > 0.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
]
# Suffix removed where the stem before it has measure > 1.
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """The word as a string of v and c; y after a consonant is a vowel."""
    out = ""
    for ch in word:
        vowel = ch in VOWELS or (ch == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _ends_cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes):
    hits = [s for s in suffixes if word.endswith(s)]
    return max(hits, key=len) if hits else None


def _replace_measured(word: str, table, least: int) -> str:
    table = dict(table)
    suffix = _longest(word, table)
    if suffix and _measure(word[: -len(suffix)]) > least:
        return word[: -len(suffix)] + table[suffix]
    return word


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix):
            if "v" not in _shape(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double_consonant(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _ends_cvc(stem) else stem
    return word


def _drop_long_suffix(word: str) -> str:
    suffix = _longest(word, STEP_4)
    if not suffix:
        return word
    stem = word[: -len(suffix)]
    if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
        return stem
    return word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _ends_cvc(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def porter(word: str) -> str:
    if len(word) < 3:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace_measured(word, STEP_2, 0)
    word = _replace_measured(word, STEP_3, 0)
    return _tidy(_drop_long_suffix(word))


# --- the same rules as a table ------------------------------------------------

# While rules run, three characters that no word has stand for: a first y (a consonant),
# a word too short to stem, an ending that step 1b took off.
FIRST_Y, SHORT, TAKEN = "\x1e", "\x1f", "\x1d"

# A run of consonants or vowels; y is a vowel after a consonant and a consonant elsewhere.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
MEASURE_1 = f"^({_C})?{_V}[^aeiou]"  # at least one vowel-consonant change
MEASURE_2 = f"^({_C})?{_V}{_C}{_V}[^aeiou]"
HAS_VOWEL = f"^({_C})?[aeiouy]"
SHORT_STEM = f"^{_C}[aeiouy][^aeiouwxy]$"  # measure 1 and consonant, vowel, consonant at its end
# The last of two equal letters is a consonant, and none of l, s, z.
DOUBLE_END = "[^aeioulszy]$|[aeiou]y(yy)*$|[^aeiouy](yy)+$"


class Rule(NamedTuple):
    """A word with this ending whose part before the last ``stem`` letters fits ``test``
    loses ``cut`` letters and gets ``add``.  If it does not fit, it stays as it is, or
    goes to the next rule (``go_on``).  ``twice`` asks for two equal letters at the end
    of that part."""

    suffix: str
    test: str | None = None
    stem: int = 0
    cut: int = 0
    add: str = ""
    go_on: bool = False
    twice: bool = False


def _by_length(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: -len(r.suffix))


STEPS: list[list[Rule]] = [
    [Rule("sses", cut=2), Rule("ies", cut=2), Rule("ss"), Rule("s", cut=1)],
    [
        Rule("eed", MEASURE_1, 3, 1),
        Rule("ed", HAS_VOWEL, 2, 2, TAKEN),
        Rule("ing", HAS_VOWEL, 3, 3, TAKEN),
    ],
    [
        *[Rule(end + TAKEN, cut=1, add="e") for end in ("at", "bl", "iz")],
        Rule(TAKEN, DOUBLE_END, 1, 2, go_on=True, twice=True),
        Rule(TAKEN, SHORT_STEM, 1, 1, "e", go_on=True),
        Rule(TAKEN, cut=1),
    ],
    [Rule("y", HAS_VOWEL, 1, 1, "i")],
    _by_length([Rule(s, MEASURE_1, len(s), len(s), add) for s, add in STEP_2]),
    _by_length([Rule(s, MEASURE_1, len(s), len(s), add) for s, add in STEP_3]),
    _by_length(
        [Rule(s, MEASURE_2, len(s), len(s)) for s in STEP_4 if s != "ion"]
        + [Rule("sion", MEASURE_2, 3, 3), Rule("tion", MEASURE_2, 3, 3), Rule("ion")]
    ),
    [Rule("e", SHORT_STEM, 1, go_on=True), Rule("e", MEASURE_1, 1, 1)],
    [Rule("ll", MEASURE_2, 0, 1)],
]


def _by_last_letter(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules of different last letters never meet, so one test of a letter skips them all."""
    groups: dict[str, list[Rule]] = {}
    for r in rules:
        groups.setdefault(r.suffix[-1], []).append(r)
    return groups


def _rule_column(w: Column, rules: list[Rule]) -> Column:
    size = F.length(w)

    def fits(r):
        test = F.lit(True)
        if r.twice:
            test = (size > r.stem + 1) & (
                F.substring(w, size - r.stem, F.lit(1)) == F.substring(w, size - r.stem - 1, F.lit(1))
            )
        return test & F.left(w, size - r.stem).rlike(r.test) if r.test else test

    def chain(group):
        out = F
        for r in group:
            ends = F.endswith(w, F.lit(r.suffix))
            changed = F.concat(F.left(w, size - r.cut), F.lit(r.add)) if r.cut else w
            if r.go_on or not r.test:
                out = out.when(ends & fits(r), changed)
            else:
                out = out.when(ends, F.when(fits(r), changed).otherwise(w))
        return out.otherwise(w)

    out = F
    for letter, group in _by_last_letter(rules).items():
        out = out.when(F.endswith(w, F.lit(letter)), chain(group))
    return out.otherwise(w)


def _porter_columns(words: Column) -> Column:
    """Each step is a ``transform`` of its own, so that a word is an expression once."""

    def opened(w):
        return (
            F.when(F.length(w) < 3, F.concat(w, F.lit(SHORT)))
            .when(F.startswith(w, F.lit("y")), F.concat(F.lit(FIRST_Y), F.substring(w, 2, 1 << 30)))
            .otherwise(w)
        )

    def closed(w):
        return (
            F.when(F.endswith(w, F.lit(SHORT)), F.left(w, F.length(w) - 1))
            .when(F.startswith(w, F.lit(FIRST_Y)), F.concat(F.lit("y"), F.substring(w, 2, 1 << 30)))
            .otherwise(w)
        )

    def step(rules):
        return lambda w: _rule_column(w, rules)

    words = F.transform(words, opened)
    for rules in STEPS:
        words = F.transform(words, step(rules))
    return F.transform(words, closed)


def _rule_sql(rules: list[Rule]) -> str:
    cases = []
    for r in rules:
        ends = f"w LIKE '%{r.suffix}'"
        fits = ""
        if r.twice:
            fits += f" AND length(w) > {r.stem + 1} AND substr(w, length(w) - {r.stem}, 1) = "
            fits += f"substr(w, length(w) - {r.stem + 1}, 1)"
        if r.test:
            fits += f" AND regexp_matches(left(w, length(w) - {r.stem}), '{r.test}')"
        changed = f"left(w, length(w) - {r.cut}) || '{r.add}'" if r.cut else "w"
        cases.append(f"WHEN {ends}{fits} THEN {changed}")
        if r.test and not r.go_on:
            cases.append(f"WHEN {ends} THEN w")
    return f"CASE {' '.join(cases)} ELSE w END"


def porter_sql(name: str, source: str) -> str:
    """CTEs that end in ``name`` (word, stem) for the distinct words of ``source`` (word)."""
    ctes = [
        f"{name}_0 AS (SELECT word, CASE WHEN length(word) < 3 THEN word || '{SHORT}' WHEN word LIKE 'y%' "
        f"THEN '{FIRST_Y}' || substr(word, 2) ELSE word END AS w FROM (SELECT DISTINCT word FROM {source}))"
    ]
    for i, rules in enumerate(STEPS):
        ctes.append(f"{name}_{i + 1} AS (SELECT word, {_rule_sql(rules)} AS w FROM {name}_{i})")
    ctes.append(
        f"{name} AS (SELECT word, CASE WHEN w LIKE '%{SHORT}' THEN left(w, length(w) - 1) "
        f"WHEN w LIKE '{FIRST_Y}%' THEN 'y' || substr(w, 2) ELSE w END AS stem FROM {name}_{len(STEPS)})"
    )
    return ",\n  ".join(ctes)


def stem_word(c: Column, stemmer: str) -> Column:
    return F.get(stem_array(F.array(c), stemmer), F.lit(0)) if stemmer == "porter" else (
        light_stem(c) if stemmer == "light" else c
    )


def stem_array(c: Column, stemmer: str) -> Column:
    """``porter``, ``light`` (plural endings only) or ``none``."""
    if stemmer == "porter":
        return _porter_columns(c)
    return F.transform(c, light_stem) if stemmer == "light" else c
