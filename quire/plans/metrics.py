"""Queries: training-log metrics over the events table, model profiles.

The events table stands in for a batch loss log: epoch = event_id mod 10,
phase = train for even user ids and val for odd, loss = value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import ws_tokens
from quire.operators import chunk as C
from quire.operators import metrics as M
from quire.plans.registry import d_tokens, query
from quire.sources.tables import documents, events


def loss_log(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select(
        F.pmod(F.col("event_id"), F.lit(10)).alias("epoch"),
        F.when(F.pmod(F.col("user_id"), F.lit(2)) == 0, "train").otherwise("val").alias("phase"),
        F.col("value").alias("loss"),
    )


_D_LOG = """
log AS (SELECT event_id % 10 AS epoch, CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'val' END AS phase, value AS loss
        FROM events),
pe AS (SELECT epoch, phase, sum(loss) AS sum_loss, count(loss) AS n_batches, sum(loss) / count(loss) AS mean_loss
       FROM log GROUP BY epoch, phase)"""


@query(
    "epoch_loss",
    sql=f"""
WITH {_D_LOG}
SELECT epoch, phase, round(mean_loss, 6) AS mean_loss, n_batches FROM pe
""",
)
def epoch_loss(spark, sf_dir):
    """E5: mean loss per epoch and phase."""
    pe = M.epoch_loss(loss_log(spark, sf_dir))
    return pe.select("epoch", "phase", F.round("mean_loss", 6).alias("mean_loss"), "n_batches")


@query(
    "overfit_flag",
    sql=f"""
WITH {_D_LOG},
v AS (SELECT epoch, mean_loss,
        min(mean_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far,
        min(mean_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best
      FROM pe WHERE phase = 'val'),
b AS (SELECT *, max(CASE WHEN mean_loss = best_so_far THEN epoch END)
        OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_epoch FROM v)
SELECT epoch, round(mean_loss, 6) AS mean_loss, round(best_so_far, 6) AS best_so_far,
  epoch - best_epoch AS epochs_since_best, coalesce(mean_loss > prev_best, false) AS is_rising
FROM b
""",
)
def overfit_flag(spark, sf_dir):
    """Validation loss rising after its minimum."""
    f = M.overfit_flags(M.epoch_loss(loss_log(spark, sf_dir)))
    return f.select(
        "epoch",
        F.round("mean_loss", 6).alias("mean_loss"),
        F.round("best_so_far", 6).alias("best_so_far"),
        "epochs_since_best",
        "is_rising",
    )


@query(
    "cumulative_metric",
    sql=f"""
WITH {_D_LOG}
SELECT epoch, phase, round(sum(sum_loss) OVER w / sum(n_batches) OVER w, 6) AS cumulative_loss
FROM pe WINDOW w AS (PARTITION BY phase ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""",
)
def cumulative_metric(spark, sf_dir):
    """the never-reset metric, as a batch-weighted running mean."""
    c = M.cumulative_mean(M.epoch_loss(loss_log(spark, sf_dir)))
    return c.select("epoch", "phase", F.round("cumulative_loss", 6).alias("cumulative_loss"))


# Model profiles: prefix and window limits per summarisation model.  The
# prefixes are fixed values of the original setup; the limits are parameters.
PROFILES = [
    ("bart", "summary: ", 1024, 1024),
    ("mt5", "summarize: ", 1_000_000_000_000, None),
]
LANG_PROFILE = {"en": "bart", "de": "mt5", "fr": "mt5", "es": "mt5"}


@query(
    "profile_dispatch",
    sql=f"""
WITH p AS (SELECT * FROM (VALUES ('bart', 'summary: ', 1024, 1024), ('mt5', 'summarize: ', 1000000000000, NULL))
           s(profile, prefix, tok_max, max_pos)),
pw AS (SELECT profile,
         CASE WHEN tok_max < 10000 THEN tok_max ELSE coalesce(max_pos, 512) END
           - len({d_tokens('prefix')}) AS chunk_size FROM p),
lp AS (SELECT * FROM (VALUES ('en', 'bart'), ('de', 'mt5'), ('fr', 'mt5'), ('es', 'mt5')) s(lang, profile)),
d AS (SELECT d.doc_id, lp.profile, len({d_tokens('d.text')}) AS nt FROM documents d JOIN lp USING (lang))
SELECT d.doc_id, d.profile, CAST(pw.chunk_size AS INTEGER) AS chunk_size, CAST(pw.chunk_size // 4 AS INTEGER) AS chunk_overlap,
  CAST(CASE WHEN nt = 0 THEN 0 WHEN nt <= pw.chunk_size THEN 1
       ELSE ceil((nt - pw.chunk_size) / (pw.chunk_size - pw.chunk_size // 4)) + 1 END AS INTEGER) AS n_chunks
FROM d JOIN pw USING (profile)
""",
)
def profile_dispatch(spark, sf_dir):
    """Per-document chunk size and overlap from its model profile.

    window = tokenizer limit if below 10000, else the model's positions,
    else 512; chunk = window - prefix tokens; overlap = chunk // 4.  The
    profile table is tiny and broadcast; an unknown profile raises.
    """
    prof = spark.createDataFrame(PROFILES, "profile string, prefix string, tok_max long, max_pos long")
    window = F.when(F.col("tok_max") < 10000, F.col("tok_max")).otherwise(F.coalesce("max_pos", F.lit(512)))
    prof = prof.select(
        "profile", (window - F.size(ws_tokens(F.col("prefix")))).cast("int").alias("chunk_size")
    ).withColumn("chunk_overlap", F.floor(F.col("chunk_size") / 4).cast("int"))
    lp = F.create_map(*[F.lit(x) for kv in sorted(LANG_PROFILE.items()) for x in kv])
    d = documents(spark, sf_dir).select("doc_id", F.element_at(lp, F.col("lang")).alias("profile"), "text")
    j = d.join(F.broadcast(prof), "profile", "left")
    size = F.when(F.col("chunk_size").isNull(), F.raise_error(F.lit("unsupported model profile"))).otherwise(F.col("chunk_size"))
    n = C.n_windows_col(F.size(ws_tokens(F.col("text"))), size, F.col("chunk_overlap"))
    return j.select("doc_id", "profile", size.cast("int").alias("chunk_size"), "chunk_overlap", n.alias("n_chunks"))


_D_PROFILE_ROWS = f"""
WITH p AS (SELECT * FROM (VALUES ('bart', 'summary: ', 1024, 1024), ('mt5', 'summarize: ', 1000000000000, NULL))
           s(profile, prefix, tok_max, max_pos)),
pw AS (SELECT profile,
         CASE WHEN tok_max < 10000 THEN tok_max ELSE coalesce(max_pos, 512) END
           - len({d_tokens('prefix')}) AS cs FROM p),
lp AS (SELECT * FROM (VALUES ('en', 'bart'), ('de', 'mt5'), ('fr', 'mt5'), ('es', 'mt5')) s(lang, profile)),
d AS (SELECT d.doc_id, lp.profile, {d_tokens('d.text')} AS tok FROM documents d JOIN lp USING (lang)),
n AS (SELECT d.*, pw.cs, pw.cs - pw.cs // 4 AS st,
        CASE WHEN len(tok) = 0 THEN 0 WHEN len(tok) <= pw.cs THEN 1
             ELSE CAST(ceil((len(tok) - pw.cs) / (pw.cs - pw.cs // 4)) AS BIGINT) + 1 END AS nw
      FROM d JOIN pw USING (profile)),
w AS (SELECT doc_id, profile, tok, cs, st, unnest(generate_series(0, nw - 1)) AS i FROM n WHERE nw > 0)
SELECT doc_id, profile, CAST(i AS INTEGER) AS chunk_no, CAST(i * st AS INTEGER) AS chunk_start,
  CAST(len(list_slice(tok, i * st + 1, i * st + cs)) AS INTEGER) AS n_tokens,
  md5(array_to_string(list_slice(tok, i * st + 1, i * st + cs), ' ')) AS chunk_md5
FROM w
"""


@query("profile_chunks", sql=_D_PROFILE_ROWS)
def profile_chunks(spark, sf_dir):
    """B9 + C4: every document cut into token windows with the chunk size and
    overlap of its own model profile (per-row window parameters)."""
    from quire.functions.text import explode_rows

    prof = spark.createDataFrame(PROFILES, "profile string, prefix string, tok_max long, max_pos long")
    window = F.when(F.col("tok_max") < 10000, F.col("tok_max")).otherwise(F.coalesce("max_pos", F.lit(512)))
    prof = prof.select("profile", (window - F.size(ws_tokens(F.col("prefix")))).cast("int").alias("cs"))
    prof = prof.withColumn("ov", F.floor(F.col("cs") / 4).cast("int"))
    lp = F.create_map(*[F.lit(x) for kv in sorted(LANG_PROFILE.items()) for x in kv])
    d = documents(spark, sf_dir).select("doc_id", F.element_at(lp, F.col("lang")).alias("profile"), "text")
    j = d.join(F.broadcast(prof), "profile", "left")
    size = F.when(F.col("cs").isNull(), F.raise_error(F.lit("unsupported model profile"))).otherwise(F.col("cs"))
    j = j.withColumn("cs", size.cast("int"))
    j = j.select("doc_id", "profile", "cs", "ov", ws_tokens(F.col("text")).alias("tok"))
    w = explode_rows(j, C.token_windows_col(F.col("tok"), F.col("cs"), F.col("ov")), ["doc_id", "profile", "cs", "ov"], ("chunk_no", "w"))
    return w.select(
        "doc_id", "profile", "chunk_no",
        (F.col("chunk_no") * (F.col("cs") - F.col("ov"))).alias("chunk_start"),
        F.size("w").alias("n_tokens"),
        F.md5(F.array_join("w", " ")).alias("chunk_md5"),
    )
