"""Scalar text functions as Column expressions (JVM-side, codegen friendly).

The character classes reproduce Python's ``str`` semantics with Java regex:
``WS`` equals ``str.isspace`` and ``NW`` equals Python's ``[^\\w\\s]``.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python-equal whitespace and "not word, not space" classes.
WS_CLASS = r"\x09-\x0d\x1c-\x1f\x85\p{Z}"
WS = f"[{WS_CLASS}]"
NW = rf"[^\p{{L}}\p{{N}}_{WS_CLASS}]"
# a "word character" in Python's sense (used for explicit boundaries)
WORD = r"[\p{L}\p{N}_]"

# Contraction rules, applied in this order.
CONTRACTIONS = [
    ("can't", "cannot"),
    ("won't", "will not"),
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` as a lambda variable.

    An expression used inside a higher-order function's lambda is
    re-evaluated for every element; binding it first keeps, for example,
    the tokenisation of a document to one pass however many windows are
    cut from it.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def collapse_ws(c) -> Column:
    """Every whitespace run becomes one space; nothing is trimmed."""
    return F.regexp_replace(_col(c), f"{WS}+", " ")


def strip_punct(c) -> Column:
    """Drop every character that is neither a word character nor whitespace."""
    return F.regexp_replace(_col(c), NW, "")


def py_strip(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends."""
    return F.regexp_replace(_col(c), rf"\A{WS}+|{WS}+\z", "")


def normalize_contractions(c, rules=CONTRACTIONS) -> Column:
    """Word-bounded literal rules, in order (boundaries as in Python ``\\b``)."""
    out = _col(c)
    for src, dst in rules:
        pat = rf"(?<!{WORD}){_quote(src)}(?!{WORD})"
        # a byte search first: the regex (a look-behind tried at every
        # position) only runs on texts that contain the literal at all
        out = bind(out, _guarded_rule(src, pat, dst))
    return out


def _guarded_rule(src: str, pat: str, dst: str):
    # one-argument lambda (PySpark picks (x) or (x, i) from the arity)
    return lambda t: F.when(t.contains(src), F.regexp_replace(t, pat, dst)).otherwise(t)


def _quote(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in s)


def clean_text(c, lower: bool = True, contractions=CONTRACTIONS) -> Column:
    """Collapse whitespace, remove punctuation, lower-case, contraction rules.

    Punctuation is removed before the contraction rules run, as in the
    original pipeline, so ``can't`` has already become ``cant``.
    """
    out = strip_punct(collapse_ws(c))
    if lower:
        out = F.lower(out)
    return normalize_contractions(out, contractions)


def ws_tokens(c) -> Column:
    """Python ``str.split()``: whitespace runs, no empty tokens."""
    return F.filter(F.split(_col(c), f"{WS}+"), lambda t: t != "")


def template_parts(template: str):
    """Split a ``str.format`` template into (literal, field) pairs on the driver."""
    parts = []
    for literal, field, spec, conv in Formatter().parse(template):
        if spec or conv:
            raise ValueError("format specs and conversions are not supported")
        parts.append((literal, field))
    return parts


def render_template(template: str, **fields) -> Column:
    """``template.format(**fields)`` as a ``concat`` of literals and columns.

    Braces inside the data are never re-expanded because the data is never
    parsed as a template.
    """
    pieces = []
    for literal, field in template_parts(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            if field not in fields:
                raise KeyError(field)
            pieces.append(_col(fields[field]))
    return F.concat(*pieces) if pieces else F.lit("")


def format_metadata(case_type, issue) -> Column:
    """Two labelled lines; a null value prints ``None`` like ``str(None)``."""
    # The labels of the metadata lines.
    return F.concat(
        F.lit("案件類型: "),
        F.coalesce(_col(case_type).cast("string"), F.lit("None")),
        F.lit("\n爭點: "),
        F.coalesce(_col(issue).cast("string"), F.lit("None")),
        F.lit("\n"),
    )


def translate_chars(c, mapping: dict) -> Column:
    """One-to-one character conversion (script folding, accent folding)."""
    src = "".join(mapping.keys())
    dst = "".join(mapping.values())
    if any(len(k) != 1 for k in mapping) or any(len(v) != 1 for v in mapping.values()):
        raise ValueError("translate_chars takes single characters only")
    return F.translate(_col(c), src, dst)


def fold_script(c, chars: dict | None = None, phrases: dict | None = None) -> Column:
    """Phrase lexicon applied longest-first, then 1:1 character table."""
    out = _col(c)
    for src in sorted(phrases or {}, key=lambda s: (-len(s), s)):
        out = F.replace(out, F.lit(src), F.lit(phrases[src]))
    if chars:
        out = translate_chars(out, chars)
    return out


# Java regex: one Han character is a token, other letter/digit runs are tokens.
SEGMENT_PATTERN = r"\p{IsHan}|(?:[\p{L}\p{N}&&[^\p{IsHan}]])+"


def segment_words(c) -> Column:
    """Class-rule word segmentation (stand-in for a statistical segmenter)."""
    return F.regexp_extract_all(_col(c), F.lit(SEGMENT_PATTERN), 0)


def ascii_tokens(c) -> Column:
    """Lower-case, keep ``[a-z0-9]`` runs (the ROUGE-score tokenizer rule)."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), 0)


def explode_rows(df, arr: Column, keep: list, names: tuple, with_pos: bool = True):
    """One row per array element; rows with a null or empty array vanish.

    Written as ``posexplode_outer`` plus a filter on the produced position:
    the same rows as ``posexplode``, but the optimizer does not infer a
    ``size(arr) > 0`` filter that it would push below the generator (and
    below any exchange), evaluating an expensive array expression twice.
    """
    pos_name = names[0] if with_pos else "_pos"
    val_name = names[1] if with_pos else names[0]
    out = df.select(*keep, F.posexplode_outer(arr).alias(pos_name, val_name)).filter(F.col(pos_name).isNotNull())
    return out if with_pos else out.drop("_pos")
