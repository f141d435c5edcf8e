"""Queries: sinks written to the shared folder and read back with schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import clean_text, explode_rows, ws_tokens
from quire.operators import clean as K
from quire.operators import vector as V
from quire.plans.folds import outputs
from quire.plans.ranking import d_ranked
from quire.plans.registry import d_clean, d_tokens, query
from quire.session import scratch_path
from quire.sources import io as IO
from quire.sources.tables import documents, embeddings

BOILERPLATE = "Licensed under the"
EMBED_DIM = 64  # of the vectors that are made here


@query(
    "parquet_roundtrip",
    sql=f"""
SELECT doc_id, md5(concat_ws(chr(31), text, source)) AS id, md5(text) AS digest
FROM documents WHERE text IS NOT NULL AND NOT contains(text, '{BOILERPLATE}')
""",
)
def parquet_roundtrip(spark, sf_dir):
    """Filter, project, content id, write, read back."""
    d = K.drop_boilerplate(documents(spark, sf_dir), "text", BOILERPLATE).select("doc_id", "text", "source")
    d = d.withColumn("id", K.content_id("text", "source"))
    path = scratch_path(spark, "preprocessed")
    IO.write_parquet(d, path)
    back = IO.read_parquet(spark, path, "doc_id long, text string, source string, id string")
    return back.select("doc_id", "id", F.md5("text").alias("digest"))


@query(
    "jsonl_roundtrip",
    sql=f"""
SELECT CAST(coalesce(vec_id, doc_id) AS VARCHAR) AS id, d.text AS page_content, d.text AS text, d.lang, d.source, CAST(NULL AS VARCHAR) AS issue,
  CAST(CASE WHEN embedding IS NOT NULL THEN len(embedding) WHEN coalesce(len({d_tokens(d_clean('text'))}), 0) = 0 THEN NULL ELSE {EMBED_DIM} END AS INTEGER) AS dim
FROM embeddings e FULL JOIN documents d ON d.doc_id = e.vec_id
""",
)
def jsonl_roundtrip(spark, sf_dir):
    """Nested vector points to JSON Lines and back (explicit schema):
    every document and every stored vector.  A document without a stored vector
    gets one embedded from its whole text."""
    d = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    e = embeddings(spark, sf_dir).select("vec_id", "embedding")
    made = V.hash_embed(ws_tokens(clean_text(F.coalesce("text", F.lit("")))), EMBED_DIM).cast("array<float>")
    d = d.withColumn("made", made)
    pts = e.join(d, e.vec_id == d.doc_id, "full").select(
        F.coalesce("vec_id", "doc_id").cast("string").alias("id"),
        F.coalesce(F.col("embedding").cast("array<float>"), "made").alias("vector"),
        F.struct(
            F.col("text").alias("page_content"),
            F.struct(
                F.col("text").alias("text"),
                F.col("lang").alias("lang"),
                F.col("source").alias("source"),
                F.lit(None).cast("string").alias("issue"),
            ).alias("metadata"),
        ).alias("payload"),
    )
    path = scratch_path(spark, "points")
    IO.write_jsonl(pts, path)
    back = IO.read_jsonl(spark, path, IO.POINT_SCHEMA)
    return back.select(
        "id",
        F.col("payload.page_content").alias("page_content"),
        F.col("payload.metadata.text").alias("text"),
        F.col("payload.metadata.lang").alias("lang"),
        F.col("payload.metadata.source").alias("source"),
        F.col("payload.metadata.issue").alias("issue"),
        F.when(F.size("vector") >= 0, F.size("vector")).alias("dim"),
    )


@query("csv_roundtrip", sql="SELECT doc_id, lang, text FROM documents")
def csv_roundtrip(spark, sf_dir):
    """Submission CSV (texts with newlines and quotes) written and read back."""
    d = documents(spark, sf_dir).select("doc_id", "lang", "text")
    path = scratch_path(spark, "submission")
    IO.write_csv(d, path)
    return IO.read_csv(spark, path, "doc_id long, lang string, text string")


@query("results_roundtrip", sql=f"{d_ranked(True, True)} SELECT doc_id, step, output FROM ranked")
def results_roundtrip(spark, sf_dir):
    """Every fold step written as keyed JSON (one line per document)
    and read back into (doc_id, step, output) rows."""
    res = outputs(spark, sf_dir).select("doc_id", F.col("outputs").alias("steps"))
    path = scratch_path(spark, "results")
    IO.write_jsonl(res, path)
    back = IO.read_jsonl(spark, path, "doc_id long, steps array<string>")
    return explode_rows(back, F.col("steps"), ["doc_id"], ("step", "output"))


@query(
    "lexicon_roundtrip",
    sql=f"""
WITH tk AS (SELECT {d_tokens(d_clean('text'))} AS tok FROM documents WHERE text IS NOT NULL),
c AS (SELECT DISTINCT unnest(tok) AS word FROM tk)
SELECT word FROM c UNION ALL SELECT ''
""",
)
def lexicon_roundtrip(spark, sf_dir):
    """A4: the corpus' words as a lexicon file (padded lines and a blank line), read into a set."""
    d = documents(spark, sf_dir).filter(F.col("text").isNotNull())
    tok = explode_rows(d, ws_tokens(clean_text(F.col("text"))), [], ("t",), with_pos=False)
    lines = tok.select("t").distinct().select(F.concat(F.lit("  "), F.col("t"), F.lit("\t")).alias("line")).unionByName(
        spark.range(1).select(F.lit(" ").alias("line"))
    )
    path = scratch_path(spark, "lexicon")
    IO.write_lines(lines, "line", path)
    return IO.read_lexicon(spark, path)
