"""Queries: cleaning + chunking of the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import clean_text, ws_tokens
from quire.operators import chunk as C
from quire.operators.clean import drop_boilerplate
from quire.plans.registry import d_clean, d_tokens, query
from quire.sources.tables import documents

WIN, OVL = 128, 32
STRIDE = WIN - OVL
# boilerplate line of the test corpus (the library default is
# ``quire.operators.clean.DEFAULT_BOILERPLATE``)
BOILERPLATE = "Licensed under the"

_WINDOWS_SQL = f"""
WITH t AS (SELECT doc_id, lang, {d_tokens('text')} AS tok FROM documents),
n AS (
  SELECT doc_id, lang, tok,
    CASE WHEN len(tok) = 0 THEN 0 WHEN len(tok) <= {WIN} THEN 1
         ELSE CAST(ceil((len(tok) - {WIN}) / {STRIDE}.0) AS BIGINT) + 1 END AS nw
  FROM t),
w AS (SELECT doc_id, lang, tok, unnest(generate_series(0, nw - 1)) AS chunk_no FROM n WHERE nw > 0)
SELECT doc_id, lang, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(chunk_no * {STRIDE} AS INTEGER) AS chunk_start,
  array_to_string(list_slice(tok, chunk_no * {STRIDE} + 1, chunk_no * {STRIDE} + {WIN}), ' ') AS chunk,
  CAST(len(list_slice(tok, chunk_no * {STRIDE} + 1, chunk_no * {STRIDE} + {WIN})) AS BIGINT) AS n_tokens
FROM w
"""


@query("token_windows", sql=_WINDOWS_SQL)
def token_windows(spark, sf_dir):
    """Whitespace-token windows, one row per chunk (flat form)."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    return C.token_chunks(docs, "text", WIN, OVL, keep=["doc_id", "lang"])


_NESTED_SQL = f"""
WITH t AS (SELECT doc_id, {d_tokens('text')} AS tok FROM documents),
n AS (
  SELECT doc_id, tok,
    CASE WHEN len(tok) = 0 THEN 0 WHEN len(tok) <= {WIN} THEN 1
         ELSE CAST(ceil((len(tok) - {WIN}) / {STRIDE}.0) AS BIGINT) + 1 END AS nw
  FROM t)
SELECT doc_id, CAST(nw AS INTEGER) AS n_chunks,
  array_to_string(list_transform(
      CASE WHEN nw > 0 THEN generate_series(0, nw - 1) ELSE [] END,
      lambda i: array_to_string(list_slice(tok, i * {STRIDE} + 1, i * {STRIDE} + {WIN}), ' ')), chr(30)) AS chunks
FROM n
"""


@query("token_windows_nested", sql=_NESTED_SQL)
def token_windows_nested(spark, sf_dir):
    """One row per document with its chunk array (zero-chunk rows kept)."""
    docs = documents(spark, sf_dir)
    w = C.window_texts(ws_tokens(F.col("text")), WIN, OVL)
    return docs.select(
        "doc_id",
        F.size(w).alias("n_chunks"),
        F.array_join(w, "\x1e").alias("chunks"),
    )


_PROFILE_SQL = f"""
WITH d AS (
  SELECT doc_id, lang, {d_tokens(d_clean('text'))} AS tok
  FROM documents
  WHERE text IS NOT NULL AND NOT contains(text, '{BOILERPLATE}')),
n AS (
  SELECT doc_id, lang, tok,
    CASE WHEN len(tok) = 0 THEN 0 WHEN len(tok) <= {WIN} THEN 1
         ELSE CAST(ceil((len(tok) - {WIN}) / {STRIDE}.0) AS BIGINT) + 1 END AS nw
  FROM d),
w AS (SELECT doc_id, lang, len(list_slice(tok, i * {STRIDE} + 1, i * {STRIDE} + {WIN})) AS nt, i
      FROM (SELECT doc_id, lang, tok, unnest(generate_series(0, nw - 1)) AS i FROM n WHERE nw > 0))
SELECT lang,
  CAST(sum(CASE WHEN i = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_docs,
  CAST(count(*) AS BIGINT) AS n_chunks,
  round(avg(nt), 4) AS avg_tokens,
  CAST(max(nt) AS BIGINT) AS max_tokens
FROM w GROUP BY lang
"""


def cleaned_chunks(spark, sf_dir, size=WIN, overlap=OVL):
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    docs = drop_boilerplate(docs, "text", BOILERPLATE)
    docs = docs.select("doc_id", "lang", clean_text(F.col("text")).alias("text"))
    return C.token_chunks(docs, "text", size, overlap, keep=["doc_id", "lang"])


@query("chunk_profile", sql=_PROFILE_SQL)
def chunk_profile(spark, sf_dir):
    """Minimum slice: filter -> clean -> tokens -> windows -> profile per language."""
    ch = cleaned_chunks(spark, sf_dir)
    return ch.groupBy("lang").agg(
        F.sum(F.when(F.col("chunk_no") == 0, 1).otherwise(0)).cast("bigint").alias("n_docs"),
        F.count(F.lit(1)).cast("bigint").alias("n_chunks"),
        F.round(F.avg("n_tokens"), 4).alias("avg_tokens"),
        F.max("n_tokens").cast("bigint").alias("max_tokens"),
    )
