"""Queries: row filters, cleaning functions, lexicons, ids, augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import chunk as C
from quire.operators import clean as K
from quire.operators import replace as RP
from quire.operators import segment as SG
from quire.operators import subword as SW
from quire.operators.aggregate import tap
from quire.plans.registry import D_NW, D_NWORD, D_WS, ORACLES, d_clean, d_strip, d_tokens, query, sql_lit
from quire.session import scratch_path
from quire.sources import io as IO
from quire.sources.tables import documents, table

BOILERPLATE = "Licensed under the"

# Lexicons passed by the caller (inline for the queries over the test corpus).
STOP_WORDS = ["the", "and", "le", "la"]
SYNONYMS = {"the": "a", "and": "plus", "le": "el", "der": "die", "und": "plus"}
ACCENTS = {"é": "e", "è": "e", "ê": "e", "à": "a", "ç": "c", "ü": "u", "ö": "o", "ä": "a"}
PHRASES = {"ß": "ss", "œ": "oe"}


@query(
    "filter_boilerplate",
    sql=f"""
SELECT doc_id, lang, n_chars FROM documents
WHERE text IS NOT NULL AND NOT contains(text, '{BOILERPLATE}')
""",
)
def filter_boilerplate(spark, sf_dir):
    """Drop documents containing a boilerplate phrase (null text dropped)."""
    d = documents(spark, sf_dir).select("doc_id", "lang", "n_chars", "text")
    return K.drop_boilerplate(d, "text", BOILERPLATE).drop("text")


@query(
    "dropna_subset",
    sql="""
SELECT d.doc_id, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE d.text IS NOT NULL AND l.quality IS NOT NULL
""",
)
def dropna_subset(spark, sf_dir):
    """Keep rows where both text and label are present."""
    d = documents(spark, sf_dir).select("doc_id", "text")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    return K.dropna_subset(j, ["text", "quality"]).select("doc_id", "quality", "toxic")


@query(
    "clean_text",
    sql=f"""
SELECT doc_id, {d_clean('text')} AS text, {d_clean("split_part(text, chr(10), 1)")} AS summary
FROM documents WHERE text IS NOT NULL
""",
)
def clean_text(spark, sf_dir):
    """I1-I5 on both columns, the whole text and its summary (the first line):
    whitespace collapse, punctuation removal, lower case, contractions."""
    d = K.dropna_subset(documents(spark, sf_dir), ["text"])
    summary = F.substring_index(F.col("text"), "\n", 1)
    return d.select("doc_id", X.clean_text(F.col("text")).alias("text"), X.clean_text(summary).alias("summary"))


@query(
    "normalize_contractions",
    sql=f"""
SELECT doc_id,
  regexp_replace(regexp_replace(lower(text), '(^|{D_NWORD})can''t({D_NWORD}|$)', '\\1cannot\\2', 'g'),
                 '(^|{D_NWORD})won''t({D_NWORD}|$)', '\\1will not\\2', 'g') AS text
FROM documents
""",
)
def normalize_contractions(spark, sf_dir):
    """I4: contraction rules on lower-cased text (rules before punctuation removal)."""
    d = documents(spark, sf_dir)
    return d.select("doc_id", X.normalize_contractions(F.lower("text")).alias("text"))


_STOP_SQL_LIST = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))


@query(
    "remove_stop_words",
    sql=f"""
WITH t AS (SELECT doc_id, {d_tokens(d_clean('text'))} AS tok FROM documents WHERE text IS NOT NULL)
SELECT doc_id,
  array_to_string(list_filter(tok, lambda x: NOT list_contains([{_STOP_SQL_LIST}], x)), ' ') AS text,
  CAST(len(tok) - len(list_filter(tok, lambda x: NOT list_contains([{_STOP_SQL_LIST}], x))) AS INTEGER) AS n_removed
FROM t
""",
)
def remove_stop_words(spark, sf_dir):
    """D3: lexicon exclusion on token arrays (duplicates and order kept)."""
    d = K.dropna_subset(documents(spark, sf_dir), ["text"])
    tok = d.select("doc_id", X.ws_tokens(X.clean_text(F.col("text"))).alias("tok"))
    kept = K.remove_stop_words(F.col("tok"), STOP_WORDS)
    return tok.select(
        "doc_id",
        F.array_join(kept, " ").alias("text"),
        (F.size("tok") - F.size(kept)).alias("n_removed"),
    )


_SYN_SQL_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(SYNONYMS.items())) + "}"


@query(
    "replace_synonyms",
    sql=f"""
SELECT doc_id,
  array_to_string(list_transform({d_tokens('text')},
     lambda w: coalesce({_SYN_SQL_MAP}[w], w)), ' ') AS text
FROM documents WHERE text IS NOT NULL
""",
)
def replace_synonyms(spark, sf_dir):
    """Whitespace split, word -> synonym if present, joined by one space."""
    d = K.dropna_subset(documents(spark, sf_dir), ["text"])
    return d.select(
        "doc_id",
        F.array_join(K.replace_synonyms(X.ws_tokens(F.col("text")), SYNONYMS), " ").alias("text"),
    )


def _stop_lexicon(spark):
    """The stop words through a lexicon file, as a caller would keep them."""
    path = scratch_path(spark, "stop-words")
    IO.write_lines(spark.createDataFrame([(f" {w}",) for w in STOP_WORDS], "line string"), "line", path)
    return IO.read_lexicon(spark, path)


@query("stop_words_table", sql=ORACLES["remove_stop_words"])
def stop_words_table(spark, sf_dir):
    """D3 with the lexicon as a table of any size, read from a lexicon file."""
    d = K.dropna_subset(documents(spark, sf_dir), ["text"])
    tok = d.select("doc_id", X.ws_tokens(X.clean_text(F.col("text"))).alias("tok"))
    out = K.remove_stop_words_df(tok, "doc_id", "tok", _stop_lexicon(spark), "kept")
    return out.select("doc_id", F.array_join("kept", " ").alias("text"), (F.size("tok") - F.size("kept")).alias("n_removed"))


@query("synonyms_table", sql=ORACLES["replace_synonyms"])
def synonyms_table(spark, sf_dir):
    """D4 with the synonyms as a table of any size."""
    d = K.dropna_subset(documents(spark, sf_dir), ["text"]).select("doc_id", X.ws_tokens(F.col("text")).alias("tok"))
    lexicon = spark.createDataFrame(sorted(SYNONYMS.items()), "word string, synonym string")
    out = K.replace_synonyms_df(d, "doc_id", "tok", lexicon, "out")
    return out.select("doc_id", F.array_join("out", " ").alias("text"))


_D_PLAIN = f"regexp_replace(regexp_replace(text, '{D_WS}+', ' ', 'g'), '{D_NW}', '', 'g')"


@query(
    "clean_pipeline",
    sql=f"""
WITH t AS (SELECT doc_id, {d_tokens(_D_PLAIN)} AS tok FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, array_to_string(list_filter(tok, lambda x: NOT list_contains([{_STOP_SQL_LIST}], x)), ' ') AS text FROM t)
SELECT doc_id,
  regexp_replace(regexp_replace(lower(text), '(^|{D_NWORD})can''t({D_NWORD}|$)', '\\1cannot\\2', 'g'),
                 '(^|{D_NWORD})won''t({D_NWORD}|$)', '\\1will not\\2', 'g') AS text
FROM k
""",
)
def clean_pipeline(spark, sf_dir):
    """I5 in its order: drop nulls, white space and punctuation, stop words, then
    lower case and contractions."""
    d = K.dropna_subset(documents(spark, sf_dir), ["text"])
    tok = d.select("doc_id", X.ws_tokens(X.strip_punct(X.collapse_ws(F.col("text")))).alias("tok"))
    kept = K.remove_stop_words_df(tok, "doc_id", "tok", _stop_lexicon(spark), "kept")
    return kept.select("doc_id", X.normalize_contractions(F.lower(F.array_join("kept", " "))).alias("text"))


def _d_fold(expr: str) -> str:
    out = expr
    for src in sorted(PHRASES, key=lambda s: (-len(s), s)):
        out = f"replace({out}, '{src}', '{PHRASES[src]}')"
    src = "".join(ACCENTS)
    dst = "".join(ACCENTS.values())
    return f"translate({out}, '{src}', '{dst}')"


@query(
    "fold_script",
    sql=f"SELECT doc_id, {_d_fold('text')} AS text FROM documents",
)
def fold_script(spark, sf_dir):
    """Character conversion table (1:1) after a longest-first phrase lexicon."""
    d = documents(spark, sf_dir)
    return d.select("doc_id", X.fold_script(F.col("text"), ACCENTS, PHRASES).alias("text"))


_SEG_D = r"\p{Han}|(?:[^\P{L}\p{Han}]|[^\P{N}\p{Han}])+"


@query(
    "segment_words",
    sql=f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_SEG_D}') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, array_to_string(w, ' ') AS words FROM t
""",
)
def segment_words(spark, sf_dir):
    """Class-rule segmentation: one token per Han character, letter/digit runs."""
    d = documents(spark, sf_dir)
    w = X.segment_words(F.col("text"))
    return d.select("doc_id", F.size(w).alias("n_words"), F.array_join(w, " ").alias("words"))


# lexicon of the phrase replacement: frequent longer runs of the corpus, marked
# wherever they stand, inside other words too
MARK_LEAST, MARK_FROM, MARK_TO = 20, 5, 12


@query(
    "replace_lexicon",
    sql=rf"""
WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
rn AS (SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS w FROM d),
lx AS (SELECT w FROM rn WHERE length(w) BETWEEN {MARK_FROM} AND {MARK_TO} GROUP BY w HAVING count(*) >= {MARK_LEAST}),
ps AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS a FROM d),
sb AS (SELECT doc_id, a, n, substr(text, a, n) AS s FROM ps, range({MARK_FROM}, {MARK_TO + 1}) t(n)),
mt AS (SELECT doc_id, a, max(n) AS n FROM sb JOIN lx ON lx.w = sb.s GROUP BY doc_id, a),
ml AS (SELECT doc_id, list([a, n] ORDER BY a) AS m FROM mt GROUP BY doc_id),
pk AS (SELECT doc_id, list_reduce(m, lambda acc, x: CASE WHEN x[1] >= acc[1] THEN [x[1] + x[2]] || acc[2:] || x ELSE acc END, [0::BIGINT]) AS k FROM ml),
pc AS (SELECT d.doc_id, text, coalesce(k, [1::BIGINT]) AS k, (len(coalesce(k, [1::BIGINT])) - 1) // 2 AS many FROM d LEFT JOIN pk USING (doc_id))
SELECT doc_id, array_to_string(list_transform(range(1, many + 1), lambda i:
    substr(text, CASE WHEN i = 1 THEN 1 ELSE k[2 * i - 2] + k[2 * i - 1] END, k[2 * i] - CASE WHEN i = 1 THEN 1 ELSE k[2 * i - 2] + k[2 * i - 1] END)
    || '<' || substr(text, k[2 * i], k[2 * i + 1]) || '>'), '')
  || substr(text, CASE WHEN many = 0 THEN 1 ELSE k[2 * many] + k[2 * many + 1] END) AS text
FROM pc
""",
)
def replace_lexicon(spark, sf_dir):
    """Leftmost-longest replacement from a lexicon taken from the corpus."""
    d = K.dropna_subset(documents(spark, sf_dir), ["text"]).select("doc_id", "text")
    words = X.explode_rows(d, SG.runs(F.col("text")), [], ("w",), with_pos=False)
    counts = words.where(F.length("w").between(MARK_FROM, MARK_TO)).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= MARK_LEAST)
    lexicon = counts.select(F.col("w").alias("source"), F.concat(F.lit("<"), F.col("w"), F.lit(">")).alias("target"))
    return RP.replace_phrases(d, "text", lexicon)


# lexicon of the segmenter: frequent short runs of the corpus itself
SEG_LEAST, SEG_LONGEST, SEG_UNKNOWN = 50, 6, 64
_RUN_D = r"[\p{L}\p{N}]+"

# runs, the unigram lexicon, the lattice of each distinct run (edges by end) and
# the cheapest prefix cuts; path[i] is the cut of the first i characters
D_SEGMENTED = f"""
rn AS (SELECT doc_id, regexp_extract_all(lower(text), '{_RUN_D}') AS r FROM documents WHERE text IS NOT NULL),
wn AS (SELECT w, count(*) AS n FROM (SELECT unnest(r) AS w FROM rn) GROUP BY w),
lx AS (SELECT w, length(bin((SELECT sum(n) FROM wn)::BIGINT // n)) + 1 AS cost FROM wn WHERE n >= {SEG_LEAST} AND length(w) <= {SEG_LONGEST}),
sp AS (SELECT w AS run, b, unnest(range(greatest(0, b - {SEG_LONGEST}), b)) AS a FROM (SELECT w, unnest(range(1, length(w) + 1)) AS b FROM wn)),
eg AS (SELECT run, b, a, cost FROM sp JOIN lx ON lx.w = substr(run, a + 1, b - a)),
es AS (SELECT run, b, list(struct_pack(a := a, cost := cost)) AS e FROM eg GROUP BY run, b),
vt(run, i, cost, path) AS (
  SELECT w, 0, [0::BIGINT], [''] FROM wn
  UNION ALL
  SELECT run, i + 1, cost || [best // 100000], path || [CASE WHEN best % 100000 = 0 THEN '' ELSE path[best % 100000 + 1] || ' ' END || substr(run, best % 100000 + 1, i + 1 - best % 100000)]
  FROM (SELECT vt.*, list_min([(cost[i + 1] + {SEG_UNKNOWN}) * 100000 + i] || coalesce(list_transform(e, lambda x: (cost[x.a + 1] + x.cost) * 100000 + x.a), [])) AS best
        FROM vt LEFT JOIN es ON es.run = vt.run AND es.b = vt.i + 1 WHERE i < length(vt.run))),
sg AS (SELECT run, path[length(run) + 1] AS parts FROM vt WHERE i = length(run))"""


@query(
    "segment_lexicon",
    sql=f"""WITH RECURSIVE {D_SEGMENTED},
ra AS (SELECT doc_id, unnest(r) AS run, generate_subscripts(r, 1) AS k FROM rn),
ws AS (SELECT doc_id, string_agg(parts, ' ' ORDER BY k) AS words FROM ra JOIN sg USING (run) GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN words IS NULL THEN 0 ELSE len(string_split(words, ' ')) END AS INTEGER) AS n_words, coalesce(words, '') AS words
FROM rn LEFT JOIN ws USING (doc_id)
""",
)
def segment_lexicon(spark, sf_dir):
    """Every run of letters and digits cut into words of a lexicon along the
    cheapest path of its lattice."""
    rows = segmented_documents(spark, sf_dir)
    return rows.select("doc_id", F.size("words").alias("n_words"), F.array_join("words", " ").alias("words"))


def segmented_documents(spark, sf_dir):
    """(doc_id, words): the documents in lexicon words."""
    d = K.dropna_subset(documents(spark, sf_dir), ["text"]).select("doc_id", SG.runs(F.lower("text")).alias("runs"))
    lexicon = SG.unigram_lexicon(d, "runs", SEG_LEAST, SEG_LONGEST)
    return SG.segment_df(d, "runs", lexicon, "words", SEG_UNKNOWN).select("doc_id", "words")


@query(
    "segmented_stop_words",
    sql=f"""WITH RECURSIVE {D_SEGMENTED},
ra AS (SELECT doc_id, unnest(r) AS run, generate_subscripts(r, 1) AS k FROM rn),
pt AS (SELECT doc_id, k, unnest(string_split(parts, ' ')) AS w, generate_subscripts(string_split(parts, ' '), 1) AS j FROM ra JOIN sg USING (run)),
ws AS (SELECT doc_id, string_agg(w, ' ' ORDER BY k, j) AS text FROM pt WHERE w NOT IN ({', '.join(f"'{w}'" for w in STOP_WORDS)}) GROUP BY doc_id)
SELECT doc_id, coalesce(text, '') AS text FROM rn LEFT JOIN ws USING (doc_id)
""",
)
def segmented_stop_words(spark, sf_dir):
    """D3 on I7's words: the text segmented first, then without stop words."""
    rows = K.remove_stop_words_df(segmented_documents(spark, sf_dir), "doc_id", "words", _stop_lexicon(spark), "kept")
    return rows.select("doc_id", F.array_join("kept", " ").alias("text"))


@query(
    "content_id",
    sql="""
SELECT doc_id, md5(concat_ws(chr(31), coalesce(lang, '␀'), coalesce(source, '␀'), coalesce(text, '␀'))) AS cid
FROM documents
""",
)
def content_id(spark, sf_dir):
    """Deterministic content id (md5), stable under task retries."""
    d = documents(spark, sf_dir)
    parts = [F.coalesce(F.col(c), F.lit("␀")) for c in ("lang", "source", "text")]
    return d.select("doc_id", F.md5(F.concat_ws("\x1f", *parts)).alias("cid"))


@query(
    "truncate_tokens",
    sql=f"""
WITH t AS (SELECT doc_id, {d_tokens(d_clean('text'))} AS tok FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_slice(tok, 1, 64), ' ') AS text, len(tok) > 64 AS was_truncated FROM t
""",
)
def truncate_tokens(spark, sf_dir):
    """Hard cut to the first 64 tokens, with a truncation flag."""
    d = K.dropna_subset(documents(spark, sf_dir), ["text"])
    tok = d.select("doc_id", X.ws_tokens(X.clean_text(F.col("text"))).alias("tok"))
    return tok.select(
        "doc_id",
        F.array_join(C.truncate_tokens(F.col("tok"), 64), " ").alias("text"),
        (F.size("tok") > 64).alias("was_truncated"),
    )


@query(
    "split_keep_end",
    sql="""
SELECT doc_id, CAST(piece_no - 1 AS INTEGER) AS piece_no, piece FROM (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS piece_no
  FROM (SELECT doc_id, regexp_extract_all(text, '(?s)(?:.*?(?:\\Q. \\E)|.+)') AS p FROM documents))
""",
)
def split_keep_end(spark, sf_dir):
    """Split on '. ' keeping the separator at the end of each piece."""
    d = documents(spark, sf_dir)
    return X.explode_rows(d, C.split_keep_end(F.col("text"), ". "), ["doc_id"], ("piece_no", "piece"))


@query(
    "split_keep_start",
    sql="""
SELECT doc_id, CAST(piece_no - 1 AS INTEGER) AS piece_no, piece FROM (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS piece_no
  FROM (SELECT doc_id,
          list_filter(list_transform(string_split(text, chr(10)),
                      lambda x, i: CASE WHEN i = 1 THEN x ELSE chr(10) || x END),
                      lambda x: x <> '') AS p
        FROM documents))
""",
)
def split_keep_start(spark, sf_dir):
    """Split on newline keeping the separator at the start of the next piece."""
    d = documents(spark, sf_dir)
    return X.explode_rows(d, C.split_keep_start(F.col("text"), "\n"), ["doc_id"], ("piece_no", "piece"))


# recursive splitter settings for the test corpus (texts up to 33k characters)
RC_SIZE, RC_OVERLAP = 1000, 200


def recursive_cfg(size=RC_SIZE, overlap=RC_OVERLAP):
    return C.SplitterConfig(
        chunk_size=size, chunk_overlap=overlap, separators=tuple(C.CJK_SEPARATORS), keep_separator="end"
    )


def _d_len_chars(e: str) -> str:
    return f"length({e})"


def _d_len_tokens(e: str) -> str:
    return f"len({d_tokens(e)})"


def _d_recursive_chunks(size: int, overlap: int, separators, length=_d_len_chars, size_col: str = "n_chars") -> str:
    """DuckDB twin of the recursive splitter (characters, separators kept at
    the end): a recursive CTE builds the piece tree (first separator that
    occurs, split, recurse on pieces not below the size while separators
    remain); runs of small sibling pieces are packed by a second recursive
    CTE that carries the window, its lengths and its total."""
    seps = "[" + ", ".join(sql_lit(x) for x in separators) + "]"
    return f"""
WITH RECURSIVE
tree(doc_id, path, txt, seps, terminal) AS (
  SELECT doc_id, []::INTEGER[], text, {seps}, {length('text')} < {size} FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, path || [CAST(k AS INTEGER)], piece, rest, {length('piece')} < {size} OR len(rest) = 0
  FROM (
    SELECT doc_id, path, rest, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k
    FROM (
      SELECT doc_id, path, rest,
        regexp_extract_all(txt, '(?s)(?:.*?(?:' || regexp_escape(sep) || ')|.+)') AS pieces
      FROM (
        SELECT doc_id, path, txt, m,
          coalesce(m[1], seps[len(seps)]) AS sep,
          CASE WHEN len(m) = 0 THEN []::VARCHAR[]
               ELSE list_slice(seps, list_position(seps, m[1]) + 1, len(seps)) END AS rest
        FROM (SELECT *, list_filter(seps, lambda s: contains(txt, s)) AS m FROM tree WHERE NOT terminal))))
),
kids AS (
  SELECT doc_id, path, txt, terminal, {length('txt')} < {size} AS small,
    list_slice(path, 1, len(path) - 1) AS parent, path[len(path)] AS k
  FROM tree),
runs AS (
  SELECT doc_id, parent, run, min(path) AS first_path,
         list(txt ORDER BY k) AS pieces, list({length('txt')} ORDER BY k) AS plen
  FROM (SELECT *, sum(CASE WHEN small THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, parent ORDER BY k
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
        FROM kids WHERE len(path) > 0 OR terminal)
  WHERE small
  GROUP BY doc_id, parent, run),
merge(doc_id, first_path, idx, pieces, plen, win, wl, total, emit) AS (
  SELECT doc_id, first_path, 0, pieces, plen, []::VARCHAR[], []::BIGINT[], 0::BIGINT, NULL::VARCHAR FROM runs
  UNION ALL
  SELECT doc_id, first_path, idx + 1, pieces, plen,
    CASE WHEN brk THEN list_slice(win, p + 1, len(win)) || [d] ELSE win || [d] END,
    CASE WHEN brk THEN list_slice(wl, p + 1, len(wl)) || [n] ELSE wl || [n] END,
    CASE WHEN brk THEN total - list_sum(list_slice(wl, 1, p))::BIGINT + n ELSE total + n END,
    CASE WHEN brk THEN nullif({d_strip("array_to_string(win, '')")}, '') END
  FROM (
    SELECT *,
      list_filter(range(0, len(wl) + 1), lambda q:
          (total - coalesce(list_sum(list_slice(wl, 1, q)), 0)) <= {overlap}
          AND ((total - coalesce(list_sum(list_slice(wl, 1, q)), 0)) + n <= {size}
               OR (total - coalesce(list_sum(list_slice(wl, 1, q)), 0)) = 0))[1] AS p
    FROM (SELECT *, pieces[idx + 1] AS d, plen[idx + 1] AS n,
                 total + plen[idx + 1] > {size} AND len(win) > 0 AS brk
          FROM merge WHERE idx < len(pieces)))
),
chunks AS (
  SELECT doc_id, first_path AS key, idx AS sub, emit AS chunk FROM merge WHERE emit IS NOT NULL
  UNION ALL
  SELECT doc_id, first_path, idx + 1, nullif({d_strip("array_to_string(win, '')")}, '') FROM merge WHERE idx = len(pieces)
  UNION ALL
  SELECT doc_id, path, 0, txt FROM kids WHERE terminal AND NOT small)
SELECT c.doc_id, d.lang, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY key, sub) - 1 AS INTEGER) AS chunk_no,
  c.chunk, CAST({length('c.chunk')} AS INTEGER) AS {size_col}, {length('c.chunk')} > {size} AS is_oversize
FROM chunks c JOIN documents d USING (doc_id) WHERE c.chunk IS NOT NULL
"""


@query("recursive_chunks", sql=_d_recursive_chunks(RC_SIZE, RC_OVERLAP, C.CJK_SEPARATORS))
def recursive_chunks(spark, sf_dir):
    """Recursive separator-aware chunks, flat, with oversize flag."""
    cfg = recursive_cfg()
    d = documents(spark, sf_dir).select("doc_id", "lang", "text")
    ch = C.recursive_chunks(F.col("text"), cfg)
    out = X.explode_rows(d, ch, ["doc_id", "lang"], ("chunk_no", "chunk"))
    out = out.select(
        "doc_id",
        "lang",
        "chunk_no",
        "chunk",
        F.char_length("chunk").alias("n_chars"),
        C.oversize_flag(F.col("chunk"), cfg).alias("is_oversize"),
    )
    # C13 report: chunk and oversize counts observed as the rows flow by
    return tap(out, "recursive_chunks", F.count(F.lit(1)).alias("n_chunks"),
               F.sum(F.col("is_oversize").cast("long")).alias("n_oversize"))


@query(
    "recursive_chunks_short",
    sql=f"""
SELECT doc_id, CAST(CASE WHEN {d_strip('text')} = '' THEN 0 ELSE 1 END AS INTEGER) AS n_chunks,
       CASE WHEN {d_strip('text')} = '' THEN NULL ELSE {d_strip('text')} END AS chunk
FROM documents WHERE text IS NOT NULL
""",
)
def recursive_chunks_short(spark, sf_dir):
    """C6/C10 native path: a text below the chunk size is one stripped chunk; a
    longer one has a row for each of its chunks."""
    cfg = recursive_cfg(size=1_000_000, overlap=0)
    d = documents(spark, sf_dir).filter(F.col("text").isNotNull())
    ch = C.recursive_chunks(F.col("text"), cfg)
    rows = d.select("doc_id", ch.alias("chunks"))
    return rows.select("doc_id", F.size("chunks").alias("n_chunks"), F.explode_outer("chunks").alias("chunk"))


@query(
    "augment_union",
    sql=f"""
SELECT doc_id, false AS is_augmented, text FROM documents
UNION ALL
SELECT doc_id, true AS is_augmented,
  array_to_string(list_transform({d_tokens('text')}, lambda w: coalesce({_SYN_SQL_MAP}[w], w)), ' ') AS text
FROM documents
""",
)
def augment_union(spark, sf_dir):
    """Original rows plus one synonym-replaced copy per row."""
    return augmented(spark, sf_dir)


def augmented(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "text")
    variant = F.array_join(K.replace_synonyms(X.ws_tokens(F.col("text")), SYNONYMS), " ")
    # one row per (row, variant): the flat-map of the augmentation step
    ex = d.select(
        "doc_id",
        F.explode(
            F.array(
                F.struct(F.lit(False).alias("is_augmented"), F.col("text").alias("text")),
                F.struct(F.lit(True).alias("is_augmented"), variant.alias("text")),
            )
        ).alias("v"),
    )
    return ex.select("doc_id", "v.is_augmented", "v.text")


@query(
    "metadata_lines",
    sql=f"""
SELECT doc_id, {sql_lit('案件類型: ')} || coalesce(lang, 'None') || {sql_lit(chr(10) + '爭點: ')} || coalesce(source, 'None')
       || chr(10) || text AS page_content
FROM documents
""",
)
def metadata_lines(spark, sf_dir):
    """Labelled metadata lines (null prints None) ahead of the text."""
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.concat(X.format_metadata(F.col("lang"), F.col("source")), F.col("text")).alias("page_content"))


def ws_token_count(text: str) -> int:
    """Length function: number of whitespace tokens (Python ``str.split``)."""
    return len(text.split())


RT_SIZE, RT_OVERLAP = 200, 40


@query(
    "recursive_chunks_tokens",
    sql=_d_recursive_chunks(RT_SIZE, RT_OVERLAP, C.CJK_SEPARATORS, length=_d_len_tokens, size_col="n_tokens"),
)
def recursive_chunks_tokens(spark, sf_dir):
    """The recursive splitter measuring pieces with a pluggable length
    function (whitespace tokens) instead of characters: no fast path, every
    text goes through the Arrow UDF."""
    cfg = C.SplitterConfig(
        chunk_size=RT_SIZE, chunk_overlap=RT_OVERLAP, separators=tuple(C.CJK_SEPARATORS),
        keep_separator="end", length_function=ws_token_count,
    )
    d = documents(spark, sf_dir).select("doc_id", "lang", "text")
    out = X.explode_rows(d, C.recursive_chunks(F.col("text"), cfg), ["doc_id", "lang"], ("chunk_no", "chunk"))
    n = F.size(X.ws_tokens(F.col("chunk")))
    return out.select("doc_id", "lang", "chunk_no", "chunk", n.alias("n_tokens"), (n > RT_SIZE).alias("is_oversize"))


@query(
    "split_drop",
    sql="""
SELECT doc_id, CAST(piece_no - 1 AS INTEGER) AS piece_no, piece FROM (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS piece_no
  FROM (SELECT doc_id, list_filter(string_split(text, '. '), lambda x: x <> '') AS p FROM documents))
""",
)
def split_drop(spark, sf_dir):
    """C2 third mode: split on '. ' dropping the separator; empty pieces removed."""
    d = documents(spark, sf_dir)
    return X.explode_rows(d, C.split_drop(F.col("text"), ". "), ["doc_id"], ("piece_no", "piece"))


def _d_recursive_profile() -> str:
    base = _d_recursive_chunks(RC_SIZE, RC_OVERLAP, C.CJK_SEPARATORS)
    head, final_select = base.rsplit("SELECT c.doc_id, d.lang", 1)
    return (head.rstrip() + ",\nrc AS (SELECT c.doc_id, d.lang" + final_select + ")\n"
            "SELECT lang, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, CAST(count(*) AS BIGINT) AS n_chunks,\n"
            "  round(avg(n_chars), 4) AS avg_chars, CAST(max(n_chars) AS INTEGER) AS max_chars,\n"
            "  CAST(sum(CASE WHEN is_oversize THEN 1 ELSE 0 END) AS BIGINT) AS n_oversize\n"
            "FROM rc GROUP BY lang")


@query("recursive_profile", sql=_d_recursive_profile())
def recursive_profile(spark, sf_dir):
    """Recursive chunks per language: documents, chunks, average and
    longest chunk, oversize chunks."""
    rc = recursive_chunks(spark, sf_dir)
    return rc.groupBy("lang").agg(
        F.sum(F.when(F.col("chunk_no") == 0, 1).otherwise(0)).cast("bigint").alias("n_docs"),
        F.count(F.lit(1)).cast("bigint").alias("n_chunks"),
        F.round(F.avg("n_chars"), 4).alias("avg_chars"),
        F.max("n_chars").alias("max_chars"),
        F.sum(F.col("is_oversize").cast("bigint")).alias("n_oversize"),
    )


LINE_SIZE, LINE_OVERLAP = 120, 20
_LINE_SEPARATORS = ["\n"]


@query(
    "oversize_chunks",
    sql=f"""SELECT doc_id, lang, chunk_no, n_chars FROM ({_d_recursive_chunks(LINE_SIZE, LINE_OVERLAP, _LINE_SEPARATORS)}) WHERE is_oversize""",
)
def oversize_chunks(spark, sf_dir):
    """Chunks that cannot be cut down to the size, as lines are the only
    separators given."""
    d = documents(spark, sf_dir).select("doc_id", "lang", "text")
    cfg = C.SplitterConfig(chunk_size=LINE_SIZE, chunk_overlap=LINE_OVERLAP, separators=tuple(_LINE_SEPARATORS), keep_separator="end")
    out = X.explode_rows(d, C.recursive_chunks(F.col("text"), cfg), ["doc_id", "lang"], ("chunk_no", "chunk"))
    return out.withColumn("n_chars", F.length("chunk")).where(F.col("n_chars") > LINE_SIZE).select("doc_id", "lang", "chunk_no", "n_chars")


def paragraphs(text: str) -> list[str]:
    """A caller's splitter: lines that hold a full stop, stripped of blanks."""
    return [line.strip(" ") for line in text.split("\n") if "." in line]


@query(
    "splitter_hook",
    sql="""
WITH p AS (SELECT doc_id, lang, list_transform(list_filter(string_split(text, chr(10)), lambda l: contains(l, '.')), lambda l: trim(l, ' ')) AS c
           FROM documents WHERE text IS NOT NULL)
SELECT doc_id, lang, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS chunk_no, unnest(c) AS chunk FROM p
""",
)
def splitter_hook(spark, sf_dir):
    """M5: a caller's splitter as a table function, joined laterally."""
    return C.split_rows(documents(spark, sf_dir), "text", paragraphs, ["doc_id", "lang"])


@query(
    "stage_chain",
    sql=f"""
WITH c AS (SELECT doc_id, lang, {d_clean('text')} AS text FROM documents WHERE text IS NOT NULL AND NOT contains(text, '{BOILERPLATE}')),
t AS (SELECT lang, {d_tokens('text')} AS tok FROM c)
SELECT lang, count(*) AS n_docs, CAST(sum(len(tok)) AS BIGINT) AS n_tokens, CAST(max(len(tok)) AS INTEGER) AS longest FROM t GROUP BY lang
""",
)
def stage_chain(spark, sf_dir):
    """M7: stages composed as a chain of DataFrame functions."""
    return (
        documents(spark, sf_dir)
        .select("doc_id", "lang", "text")
        .transform(K.drop_boilerplate, "text", BOILERPLATE)
        .transform(lambda d: d.withColumn("text", X.clean_text("text")))
        .transform(lambda d: d.withColumn("n", F.size(X.ws_tokens("text"))))
        .transform(lambda d: d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest")))
    )


SUB_SIZE, SUB_OVERLAP = 128, 32
SUB_FILE = "byte_bpe_50k.json"


def subword_codec(name: str = SUB_FILE) -> SW.Subword:
    """The codec of a public tokenizer file."""
    import public_tokenizers

    return SW.Subword.from_file(public_tokenizers.path(name))


@query("subword_roundtrip", sql="SELECT doc_id, md5(text) AS digest, text = '' AS is_empty FROM documents WHERE text IS NOT NULL")
def subword_roundtrip(spark, sf_dir):
    """I16 with sub-words: whole texts to ids of a byte-level vocabulary and back,
    without a loss and without unknown tokens."""
    codec = subword_codec()
    d = K.dropna_subset(documents(spark, sf_dir), ["text"])
    ids = d.select("doc_id", codec.encode_column(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.md5(codec.decode_column(F.col("ids"))).alias("digest"), (F.size("ids") == 0).alias("is_empty"))


@query("recursive_chunks_subword")
def recursive_chunks_subword(spark, sf_dir):
    """C9 with a sub-word length: chunks measured by a public tokenizer (no SQL:
    a tokenizer has no SQL form; tested against a plain splitter)."""
    codec = subword_codec()
    cfg = C.SplitterConfig(
        chunk_size=SUB_SIZE, chunk_overlap=SUB_OVERLAP, separators=tuple(C.CJK_SEPARATORS),
        keep_separator="end", length_function=codec.length,
    )
    d = documents(spark, sf_dir).select("doc_id", "lang", "text")
    return X.explode_rows(d, C.recursive_chunks(F.col("text"), cfg), ["doc_id", "lang"], ("chunk_no", "chunk"))
