"""Queries: folding chunk outputs back to documents; distinct; zip; refusals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import explode_rows, ws_tokens
from quire.operators import chunk as C
from quire.operators import rank as RK
from quire.operators import summarise as SM
from quire.operators.aggregate import blocked_row_number, ordered_concat
from quire.operators.prompt import FOLLOW_PROMPT, INIT_PROMPT
from quire.plans.ranking import OVL, WIN, d_ranked
from quire.plans.registry import d_template, query, sql_lit
from quire.session import cut_lineage, scratch_path
from quire.sources import io as IO
from quire.sources.tables import conversations, documents


def texts(spark, sf_dir, *keep):
    return documents(spark, sf_dir).filter(F.col("text").isNotNull()).select("doc_id", *keep, "text")


def outputs(spark, sf_dir, *keep, carry=True, chunks_col=None, alone_col=None):
    """(doc_id, *keep, outputs): the ranked sentences of every chunk of the whole texts."""
    return RK.ranked_outputs(texts(spark, sf_dir, *keep), "text", WIN, OVL, carry=carry, chunks_col=chunks_col, alone_col=alone_col)


def chunk_rows(spark, sf_dir):
    chunks = C.window_texts(ws_tokens(F.col("text")), WIN, OVL)
    return explode_rows(texts(spark, sf_dir), chunks, ["doc_id"], ("chunk_no", "chunk"))


@query("rolling_summary", sql=f"{d_ranked(True, True)} SELECT doc_id, step, output FROM ranked")
def rolling_summary(spark, sf_dir):
    """Each step ranks the sentences of the previous output and of the
    next chunk and keeps the best; every step is returned."""
    return explode_rows(outputs(spark, sf_dir), F.col("outputs"), ["doc_id"], ("step", "output"))


def _stand_in_model(prompt: str) -> str:
    """Model of the pluggable fold: ranks the sentences of the prompt's document
    part, whose first paragraph is the previous output if there is one."""
    body = prompt.split("<DOCUMENT>\n", 1)[-1].rsplit("\n</DOCUMENT>", 1)[0]
    previous, blank, chunk = body.partition("\n\n")
    return RK.summarise(previous, chunk) if blank else RK.summarise(None, body)


_D_CHUNK_TEXT = "cr AS c JOIN ranked r ON r.doc_id = c.doc_id AND r.step = c.chunk_no"


@query(
    "rolling_summary_udf",
    sql=f"""{d_ranked(False, True)},
b AS (SELECT c.doc_id, r.step, array_to_string(c.w, ' ') AS chunk, r.output, lag(r.output) OVER (PARTITION BY c.doc_id ORDER BY r.step) AS prev
      FROM {_D_CHUNK_TEXT})
SELECT doc_id, step,
  CASE WHEN step = 0 THEN {d_template(INIT_PROMPT, document='chunk')}
       ELSE {d_template(FOLLOW_PROMPT, summary='prev', document='chunk')} END AS prompt, output
FROM b
""",
)
def rolling_summary_udf(spark, sf_dir):
    """K2 with a pluggable model: prompts (first / follow-up) built per step, the
    previous output inside; the model ranks sentences without corpus counts."""
    return SM.rolling_apply(chunk_rows(spark, sf_dir), "doc_id", "chunk_no", "chunk", _stand_in_model)


@query(
    "map_combine_summary",
    sql=f"{d_ranked(True, False)} SELECT doc_id, string_agg(output, '' ORDER BY step) AS summary FROM ranked GROUP BY doc_id",
)
def map_combine_summary(spark, sf_dir):
    """K3/E2 by document: each chunk summarised alone, joined in chunk order
    inside the row."""
    out = outputs(spark, sf_dir, carry=False).where(F.size("outputs") > 0)
    return out.select("doc_id", F.array_join("outputs", "").alias("summary"))


def _model_batch(chunks):
    """Batched model of the map hook."""
    return [None if c is None else RK.summarise(None, c) for c in chunks]


@query(
    "map_combine_udf",
    sql=f"{d_ranked(False, False)} SELECT doc_id, string_agg(output, '' ORDER BY step) AS summary FROM ranked GROUP BY doc_id",
)
def map_combine_udf(spark, sf_dir):
    """K3/M2 with a pluggable batched model (Arrow ``pandas_udf``) per chunk,
    then the ordered combine by document."""
    rows = chunk_rows(spark, sf_dir).withColumn("out", SM.map_outputs(F.col("chunk"), _model_batch))
    return ordered_concat(rows, "doc_id", "chunk_no", "out", "", "summary")


_D_LAST = f"""{d_ranked(True, True)},
la AS (SELECT doc_id, max_by(output, step) AS summary FROM ranked GROUP BY doc_id)"""


@query("last_summary", sql=f"{_D_LAST} SELECT tk.doc_id, la.summary FROM tk LEFT JOIN la USING (doc_id)")
def last_summary(spark, sf_dir):
    """The final step of each document's fold (null without chunks)."""
    return outputs(spark, sf_dir).select("doc_id", SM.last_output(F.col("outputs")).alias("summary"))


@query(
    "attach_results",
    sql=f"{_D_LAST} SELECT d.doc_id, d.lang, d.source, la.summary FROM documents d LEFT JOIN la USING (doc_id) WHERE d.text IS NOT NULL",
)
def attach_results(spark, sf_dir):
    """Replace the summary column of the document table by the final
    fold output, matched by key; a document without a result row fails, and so
    does a result without a document."""
    res = last_summary(spark, sf_dir).withColumn("_hit", F.lit(True))
    d = texts(spark, sf_dir, "lang", "source").drop("text").withColumn("_doc", F.lit(True))
    j = d.join(res, "doc_id", "full")
    name = F.col("doc_id").cast("string")
    wrong = F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("no result for document "), name))).when(
        F.col("_doc").isNull(), F.raise_error(F.concat(F.lit("no document for result "), name))
    )
    return j.select("doc_id", "lang", "source", F.coalesce(wrong.cast("string"), F.col("summary")).alias("summary"))


RUN_PART = 256  # documents whose outputs one row of a run holds at most


@query(
    "run_concat",
    sql=f"""{d_ranked(True, False)},
o AS (SELECT doc_id, string_agg(output, '' ORDER BY step) AS out FROM ranked GROUP BY doc_id),
dd AS (SELECT doc_id, d.lang FROM documents d JOIN o USING (doc_id)),
fl AS (SELECT doc_id, lang, coalesce(lag(lang) OVER (ORDER BY doc_id) IS DISTINCT FROM lang, true) AS st FROM dd),
rs AS (SELECT doc_id, lang, max(CASE WHEN st THEN doc_id END) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run_start FROM fl)
SELECT run_start, doc_id // {RUN_PART} AS part, CAST(count(*) AS BIGINT) AS n_docs, min(lang) AS lang, string_agg(o.out, '' ORDER BY doc_id) AS text
FROM rs JOIN o USING (doc_id) GROUP BY 1, 2
""",
)
def run_concat(spark, sf_dir):
    """E2/F1 positional form: outputs concatenated while consecutive documents
    share a key (here the language).  A run may be as long as the table, so
    its text comes in parts of at most ``RUN_PART`` ids, in order."""
    out = outputs(spark, sf_dir, "lang", carry=False).where(F.size("outputs") > 0)
    out = cut_lineage(out.select("doc_id", "lang", F.array_join("outputs", "").alias("out")), "outputs")
    runs = SM.run_ids(out, "doc_id", "lang").select("doc_id", "run_start")
    part = F.expr(f"doc_id div {RUN_PART}").alias("part")
    r = out.join(runs, "doc_id").select("run_start", part, "doc_id", "lang", "out")
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "out")))  # at most RUN_PART of them
    text = F.array_join(F.transform(rows, lambda x: x["out"]), "")
    return r.groupBy("run_start", "part").agg(F.count("*").alias("n_docs"), F.min("lang").alias("lang"), text.alias("text"))


@query(
    "ordered_distinct",
    sql="SELECT text, min(doc_id) AS first_pos FROM documents GROUP BY 1",
)
def ordered_distinct(spark, sf_dir):
    """Distinct texts with the position of their first appearance."""
    return documents(spark, sf_dir).groupBy("text").agg(F.min("doc_id").alias("first_pos"))


@query(
    "zip_shortest",
    sql="""
WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, CAST(u.k AS INTEGER) AS k, u.text AS user_text, a.text AS assistant_text FROM u JOIN a USING (conv_id, k)
""",
)
def zip_shortest(spark, sf_dir):
    """User and assistant turns paired by position; the longer side is cut."""
    cv = conversations(spark, sf_dir).where(F.col("role").isin("user", "assistant")).select("conv_id", "role", "turn", "text")
    blk = F.floor(F.col("turn") / F.lit(4096))  # a long conversation spans many blocks
    rows = blocked_row_number(cv, ["conv_id", "role"], blk, [F.col("turn")], "k")
    side = lambda role: F.max(F.when(F.col("role") == role, F.struct("text")))
    both = rows.groupBy("conv_id", "k").agg(side("user").alias("u"), side("assistant").alias("a"))
    both = both.where(F.col("u").isNotNull() & F.col("a").isNotNull())
    return both.select("conv_id", F.col("k").cast("int").alias("k"), F.col("u.text").alias("user_text"), F.col("a.text").alias("assistant_text"))


# phrases that the corpus itself holds, to screen its outputs for
SCREENED = ["of the", "que la", "die der"]


def _d_screen(phrases) -> str:
    found = " OR ".join(f"contains(c.text, {sql_lit(p)})" for p in phrases)
    return f"""
WITH s AS (SELECT conv_id, bool_or(role = 'system') AS has_system FROM conversations GROUP BY conv_id),
a AS (SELECT c.conv_id, s.has_system, ({found}) AS refused
      FROM conversations c JOIN s USING (conv_id) WHERE c.role = 'assistant')
SELECT has_system, CAST(count(*) AS BIGINT) AS n_outputs, CAST(sum(CASE WHEN refused THEN 1 ELSE 0 END) AS BIGINT) AS n_refused,
  round(avg(CASE WHEN refused THEN 1.0 ELSE 0.0 END), 6) AS refusal_rate
FROM a GROUP BY has_system
"""


def _screen(cv, phrases):
    """Outputs that hold a phrase, with vs without a system turn: flags and counts
    of a conversation in one map-side combined aggregation, no join."""
    output = F.col("role") == "assistant"
    hit = (output & SM.refusal_flag(F.col("text"), phrases)).cast("bigint")
    each = cv.groupBy("conv_id").agg(
        F.max(F.col("role") == "system").alias("has_system"), F.sum(output.cast("bigint")).alias("n"), F.sum(hit).alias("hits")
    )
    rows = each.where("n > 0").groupBy("has_system").agg(F.sum("n").alias("n_outputs"), F.sum("hits").alias("n_refused"))
    return rows.withColumn("refusal_rate", F.round(F.col("n_refused") / F.col("n_outputs"), 6))


@query("refusal_rate", sql=_d_screen(SM.REFUSAL_PHRASES))
def refusal_rate(spark, sf_dir):
    """K4: share of outputs that decline, with vs without a system turn."""
    return _screen(conversations(spark, sf_dir), SM.REFUSAL_PHRASES)


@query("phrase_screen", sql=_d_screen(SCREENED))
def phrase_screen(spark, sf_dir):
    """K4 with the caller's phrases, here some that the outputs do hold."""
    return _screen(conversations(spark, sf_dir), SCREENED)


@query(
    "positional_results",
    sql=f"""{d_ranked(True, True)},
la AS (SELECT doc_id, count(*) AS n, max_by(output, step) AS last FROM ranked GROUP BY doc_id)
SELECT d.doc_id, d.lang, CAST(coalesce(n, 0) AS INTEGER) AS n_steps, last FROM documents d LEFT JOIN la USING (doc_id) WHERE d.text IS NOT NULL
""",
)
def positional_results(spark, sf_dir):
    """Results as JSON lists without keys, written in the rows' order, read
    back and attached by place; a length mismatch fails."""
    path = scratch_path(spark, "positional")
    IO.write_positional(outputs(spark, sf_dir), "doc_id", "outputs", path, rows_per_file=100)
    docs = texts(spark, sf_dir, "lang").select("doc_id", "lang")
    rows = IO.attach_positional(docs, "doc_id", IO.read_positional(spark, path))
    return rows.select("doc_id", "lang", F.size("steps").alias("n_steps"), SM.last_output(F.col("steps")).alias("last"))
