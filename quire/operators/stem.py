"""Porter stems (Porter, "An algorithm for suffix stripping", 1980) as Column
expressions on distinct words.

A step looks at the longest of its suffixes that the word ends in; if the
stem before it meets the step's condition, the suffix is replaced.  Conditions
are regular expressions over the form [C](VC)^m[V] of the stem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import bind
from quire.operators import lookup as L
from quire.session import cut_lineage

# Consonant and vowel runs (y is a vowel after a consonant) and
# the conditions of the algorithm.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_START = f"^({_C})?"
M_POSITIVE = f"{_START}{_V}{_C}"  # m > 0
M_ONE = f"{_START}{_V}{_C}({_V})?$"  # m = 1
M_MORE = f"{_START}{_V}{_C}{_V}{_C}"  # m > 1
HAS_VOWEL = f"{_START}[aeiouy]"  # *v*
ENDS_CVC = f"^{_C}[aeiouy][^aeiouwxy]$"  # *o of a stem with m = 1

# Suffixes and their replacements, by step.
STEP_1A = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]


class Sql:
    """Renders the steps as SQL text; ``Spark`` below renders Columns."""

    lit = staticmethod(lambda s: f"'{s}'")
    like = staticmethod(lambda w, pattern: f"regexp_matches({w}, '{pattern}')")
    ends = staticmethod(lambda w, s: f"suffix({w}, '{s}')")
    cut = staticmethod(lambda w, n: f"left({w}, length({w}) - {n})")
    join = staticmethod(lambda a, b: f"({a} || {b})")
    rest = staticmethod(lambda w: f"substr({w}, 2)")
    both = staticmethod(lambda a, b: f"({a} AND {b})")
    either = staticmethod(lambda a, b: f"({a} OR {b})")
    no = staticmethod(lambda a: f"(NOT {a})")

    @staticmethod
    def case(pairs, other):
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


class Spark:
    lit = staticmethod(F.lit)
    like = staticmethod(lambda w, pattern: w.rlike(pattern))
    ends = staticmethod(lambda w, s: w.endswith(s))
    cut = staticmethod(lambda w, n: F.substring(w, F.lit(1), F.length(w) - n))
    join = staticmethod(lambda a, b: F.concat(a, b))
    rest = staticmethod(lambda w: F.substring(w, F.lit(2), F.length(w)))
    both = staticmethod(lambda a, b: a & b)
    either = staticmethod(lambda a, b: a | b)
    no = staticmethod(lambda a: ~a)

    @staticmethod
    def case(pairs, other):
        out = F
        for c, v in pairs:
            out = out.when(c, v)
        return out.otherwise(other)


def _suffixes(r, w, rules, condition):
    """The longest suffix decides; ``rules`` are (suffix, replacement)."""
    arms = []
    for suffix, new in sorted(rules, key=lambda x: -len(x[0])):
        stem = r.cut(w, len(suffix))
        kept = r.join(stem, r.lit(new)) if new else stem
        arms.append((r.ends(w, suffix), kept if condition is None else r.case([(r.like(stem, condition), kept)], w)))
    return r.case(arms, w)


def _tidy(r, w):
    """What follows when -ed or -ing went."""
    last = r.cut(w, 1)
    double = r.both(r.like(w, "[^aeiouylsz]$"), r.like(w, "(" + "|".join(f"{c}{c}" for c in "bcdfghjkmnpqrtvwx") + ")$"))
    e = r.join(w, r.lit("e"))
    return r.case([(r.like(w, "(at|bl|iz)$"), e), (double, last), (r.both(r.like(w, M_ONE), r.like(w, ENDS_CVC)), e)], w)


def _step_1b(r, w):
    """A word that loses -ed or -ing is marked by a leading #, for the next step."""
    arms = [(r.ends(w, "eed"), r.case([(r.like(r.cut(w, 3), M_POSITIVE), r.cut(w, 1))], w))]
    for suffix in ("ed", "ing"):
        stem = r.cut(w, len(suffix))
        arms.append((r.both(r.ends(w, suffix), r.like(stem, HAS_VOWEL)), r.join(r.lit("#"), stem)))
    return r.case(arms, w)


def _final_e(r, w):
    stem = r.cut(w, 1)
    short = r.both(r.like(stem, M_ONE), r.no(r.like(stem, ENDS_CVC)))
    return r.case([(r.both(r.ends(w, "e"), r.either(r.like(stem, M_MORE), short)), stem)], w)


def _step_4(r, w):
    ion = r.both(r.like(w, "[st]ion$"), r.like(r.cut(w, 3), M_MORE))
    others = _suffixes(r, w, [(s, "") for s in STEP_4 if s != "ion"], M_MORE)
    return r.case([(ion, r.cut(w, 3))], others)


def steps(r):
    """The steps as functions of a word, in order; each runs on the result before."""
    stem = lambda w: r.cut(w, 1)
    return [
        lambda w: _suffixes(r, w, STEP_1A, None),
        lambda w: _step_1b(r, w),
        lambda w: r.case([(r.like(w, "^#"), _tidy(r, r.rest(w)))], w),
        lambda w: r.case([(r.both(r.ends(w, "y"), r.like(stem(w), HAS_VOWEL)), r.join(stem(w), r.lit("i")))], w),
        lambda w: _suffixes(r, w, STEP_2, M_POSITIVE),
        lambda w: _suffixes(r, w, STEP_3, M_POSITIVE),
        lambda w: _step_4(r, w),
        lambda w: _final_e(r, w),
        lambda w: r.case([(r.both(r.ends(w, "ll"), r.like(stem(w), M_MORE)), stem(w))], w),
    ]


def stemmed(words: DataFrame, word_col: str = "word", out_col: str = "stem") -> DataFrame:
    """Adds the stem of each word; lower-case a-z words, others come out as they are."""
    plain = F.col(word_col).rlike("^[a-z]{3,}$")
    stem = F.col(word_col)
    for step in steps(Spark):
        stem = bind(stem, step)  # evaluated once, however often the step reads it
    return words.withColumn(out_col, F.when(plain, stem).otherwise(F.col(word_col)))


def stem_tokens(df: DataFrame, tokens_cols: list[str], longer_than: int = 3) -> DataFrame:
    """The tokens of some array columns replaced by their stems (words of up to
    ``longer_than`` characters stay).  Distinct words are stemmed once."""
    kept = df.columns
    every = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in tokens_cols])
    rows = L.numbered(df, L.coded(every).alias("_coded"))
    words = L.pairs(rows, F.col("_coded.words")).select("word").distinct().where(F.length("word") > longer_than)
    table = cut_lineage(stemmed(words, "word", "value").where(F.col("word") != F.col("value")), "stems")
    rows = L.hits(rows, F.col("_coded.words"), table, "_hits")
    values = L.per_token(F.col("_hits"), F.col("_coded.codes"), T.StringType())
    rows = rows.withColumn("_values", values).select(*kept, "_values", F.col("_coded.words").alias("_w"), F.col("_coded.codes").alias("_c"))
    whole = F.transform("_values", lambda v, i: F.coalesce(v, F.get(F.col("_w"), F.get(F.col("_c"), i))))
    rows = rows.withColumn("_all", whole)
    parts, first = {}, F.lit(1)
    for c in tokens_cols:
        size = F.coalesce(F.array_size(c), F.lit(0))
        parts[c] = F.when(F.col(c).isNotNull(), F.slice("_all", first, size)).alias(c)
        first = first + size
    return rows.select(*[parts.get(c, F.col(c)) for c in kept])
