"""Queries: chats, prompts, token records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import clean_text, collapse_ws, explode_rows, normalize_contractions, strip_punct, ws_tokens
from quire.operators import chunk as C
from quire.operators import clean as K
from quire.operators import prompt as P
from quire.operators import tokens as TK
from quire.plans.cleaning import STOP_WORDS
from quire.plans.folds import outputs
from quire.plans.ranking import d_ranked
from quire.plans.registry import D_NW, D_NWORD, D_WS, d_clean, d_template, d_tokens, query, sql_lit
from quire.sources.tables import conversations, documents

PREFIX = "summary: "
PAIR_WIN, PAIR_OVL = 64, 16  # windows of the long side of a pair
PAIR_STRIDE = PAIR_WIN - PAIR_OVL


def _d_turn(role: str, content: str) -> str:
    return d_template(P.DEFAULT_TURN_TEMPLATE, role=role, content=content)


def pairs(spark, sf_dir, cleaned: bool = False):
    """(conv_id, turn, text, summary): an assistant turn as the document, the
    user turn before it as its summary."""
    cv = conversations(spark, sf_dir)
    side = (lambda c: clean_text(c)) if cleaned else (lambda c: c)
    text = cv.where("role = 'assistant'").select("conv_id", "turn", side(F.col("text")).alias("text"))
    summary = cv.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), side(F.col("text")).alias("summary"))
    return text.join(summary, ["conv_id", "turn"])


def _d_pairs(side=lambda c: c) -> str:
    return (f"SELECT a.conv_id, a.turn, {side('a.text')} AS text, {side('u.text')} AS summary FROM conversations a "
            "JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant'")


def _d_pair_windows(src: str) -> str:
    """DuckDB rows (conv_id, turn, summary, chunk_no, chunk) of the windows of ``src``."""
    return f"""
(SELECT conv_id, turn, summary, CAST(i AS INTEGER) AS chunk_no,
        array_to_string(list_slice(tok, i * {PAIR_STRIDE} + 1, i * {PAIR_STRIDE} + {PAIR_WIN}), ' ') AS chunk
 FROM (SELECT *, unnest(generate_series(0, nw - 1)) AS i FROM (
   SELECT *, CASE WHEN len(tok) = 0 THEN 0 WHEN len(tok) <= {PAIR_WIN} THEN 1
          ELSE CAST(ceil((len(tok) - {PAIR_WIN}) / {PAIR_STRIDE}.0) AS BIGINT) + 1 END AS nw
   FROM (SELECT *, {d_tokens('text')} AS tok FROM ({src}))) WHERE nw > 0))
"""


def pair_chunks(spark, sf_dir, cleaned: bool = False):
    """(conv_id, turn, summary, chunk_no, chunk): windows of the pairs' documents."""
    keep = ["conv_id", "turn", "summary"]
    return C.token_chunks(pairs(spark, sf_dir, cleaned), "text", PAIR_WIN, PAIR_OVL, keep=keep).select(*keep, "chunk_no", "chunk")


_D_PLAIN = lambda c: f"regexp_replace(regexp_replace({c}, '{D_WS}+', ' ', 'g'), '{D_NW}', '', 'g')"


def _d_cleaned(column: str) -> str:
    """DuckDB: the clean pipeline of one column, in its order."""
    stop = ", ".join(sql_lit(w) for w in STOP_WORDS)
    kept = f"array_to_string(list_filter({d_tokens(_D_PLAIN(column))}, lambda x: NOT list_contains([{stop}], x)), ' ')"
    out = f"lower({kept})"
    for src, dst in (("can''t", "cannot"), ("won''t", "will not")):
        out = f"regexp_replace({out}, '(^|{D_NWORD}){src}({D_NWORD}|$)', '\\1{dst}\\2', 'g')"
    return out


@query("clean_pairs", sql=f"SELECT conv_id, turn, {_d_cleaned('text')} AS text, {_d_cleaned('summary')} AS summary FROM ({_d_pairs()})")
def clean_pairs(spark, sf_dir):
    """I5 for both columns of a pair: white space, punctuation, stop words from a
    table, then lower case and contractions."""
    lexicon = spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")
    rows = pairs(spark, sf_dir).na.drop(subset=["text", "summary"])
    for c in ("text", "summary"):
        rows = rows.withColumn(c, ws_tokens(strip_punct(collapse_ws(F.col(c)))))
        rows = K.remove_stop_words_df(rows, ["conv_id", "turn"], c, lexicon, c)
        rows = rows.withColumn(c, normalize_contractions(F.lower(F.array_join(c, " "))))
    return rows.select("conv_id", "turn", "text", "summary")


_SFT_SQL = f"""
SELECT conv_id, turn, chunk_no,
  {_d_turn("'system'", sql_lit(P.SYSTEM_PROMPT))} ||
  {_d_turn("'user'", d_template(P.INIT_PROMPT, document='chunk'))} ||
  {_d_turn("'assistant'", 'summary')} AS text
FROM {_d_pair_windows(_d_pairs())}
"""


@query("sft_chat", sql=_SFT_SQL)
def sft_chat(spark, sf_dir):
    """Chunk + summary -> three-message chat -> rendered training text."""
    ch = pair_chunks(spark, sf_dir)
    chat = P.format_chat(F.col("chunk"), F.col("summary"))
    return ch.select("conv_id", "turn", "chunk_no", P.render_chat(chat).alias("text"))


@query(
    "chat_render",
    sql=f"""
SELECT conv_id, string_agg({_d_turn('role', 'text')}, '' ORDER BY turn) AS text,
       CAST(count(*) AS BIGINT) AS n_turns
FROM conversations GROUP BY conv_id
""",
)
def chat_render(spark, sf_dir):
    """J2 from turn rows: one rendered chat per conversation, in turn order."""
    cv = conversations(spark, sf_dir)
    out = P.render_turn_rows(cv, "conv_id", "turn", "role", "text", count_col="n_turns")
    return out.select("conv_id", "text", F.col("n_turns").cast("bigint").alias("n_turns"))


@query(
    "prompt_first_follow",
    sql=f"""{d_ranked(True, True)},
b AS (SELECT c.doc_id, c.chunk_no, array_to_string(c.w, ' ') AS chunk, lag(r.output) OVER (PARTITION BY c.doc_id ORDER BY r.step) AS prev
      FROM cr c JOIN ranked r ON r.doc_id = c.doc_id AND r.step = c.chunk_no)
SELECT doc_id, chunk_no,
  CASE WHEN chunk_no = 0 THEN {d_template(P.INIT_PROMPT, document='chunk')}
       ELSE {d_template(P.FOLLOW_PROMPT, summary='prev', document='chunk')} END AS prompt
FROM b
""",
)
def prompt_first_follow(spark, sf_dir):
    """Step 0 prompts the chunk; later steps the previous step's output first.

    A row holds its chunks and its outputs side by side, so the previous
    output is the array's element before: no window, no join.
    """
    out = outputs(spark, sf_dir, chunks_col="chunks")
    steps = F.transform("chunks", lambda c, i: F.struct(c.alias("chunk"), F.get(F.col("outputs"), i - 1).alias("prev")))
    rows = explode_rows(out, steps, ["doc_id"], ("chunk_no", "s"))
    return rows.select("doc_id", "chunk_no", P.first_or_follow_prompt(F.col("s.chunk"), F.col("chunk_no"), F.col("s.prev")).alias("prompt"))


# ----------------------------------------------------------------- vocabulary

_D_TOK = f"SELECT doc_id, {d_tokens(d_clean('text'))} AS tok FROM documents WHERE text IS NOT NULL"
_D_VOCAB = """
cnt AS (SELECT t AS token, count(*) AS n FROM (SELECT unnest(tok) AS t FROM tk) GROUP BY t),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS id, n FROM cnt)
"""


def _d_ids(name: str, src: str, keys: str, tok: str, limit: int | None = None) -> str:
    """CTE ``name(keys, ids)``: the ids of a token list, with both markers."""
    ids = "coalesce(e.ids, [])" if limit is None else f"list_slice(coalesce(e.ids, []), 1, {limit - 2})"
    return f"""
{name}_at AS (SELECT {keys}, unnest({tok}) AS token, generate_subscripts({tok}, 1) AS pos FROM {src}),
{name}_e AS (SELECT {keys}, list(coalesce(id, 1) ORDER BY pos) AS ids FROM {name}_at LEFT JOIN vocab USING (token) GROUP BY {keys}),
{name} AS (SELECT {keys}, [2] || {ids} || [3] AS ids FROM {src} LEFT JOIN {name}_e e USING ({keys}))
"""


def _d_ids_text(ids: str) -> str:
    return f"array_to_string(list_transform({ids}, lambda i: CAST(i AS VARCHAR)), ' ')"


def _d_pad(ids: str, n: int) -> str:
    return f"list_slice({ids} || list_transform(range({n}), lambda x: 0), 1, {n})"


def vocab_and_tokens(spark, sf_dir):
    d = documents(spark, sf_dir).filter(F.col("text").isNotNull())
    tk = d.select("doc_id", ws_tokens(clean_text(F.col("text"))).alias("tok"))
    return TK.build_vocab(tk, "tok"), tk


@query(
    "vocab_build",
    sql=f"WITH tk AS ({_D_TOK}), {_D_VOCAB} SELECT token, id, n FROM vocab",
)
def vocab_build(spark, sf_dir):
    """I16: vocabulary table: all tokens by count, dense ids after the specials."""
    return vocab_and_tokens(spark, sf_dir)[0]


@query(
    "encode_ids",
    sql=f"""
WITH tk AS ({_D_TOK}), {_D_VOCAB}, {_d_ids('x', 'tk', 'doc_id', 'tok')}
SELECT doc_id, {_d_ids_text('ids')} AS ids, CAST(len(ids) AS INTEGER) AS n_ids,
  CAST(len(list_filter(ids, lambda i: i = 1)) AS INTEGER) AS n_unk
FROM x
""",
)
def encode_ids(spark, sf_dir):
    """I16: tokens -> ids by a join with the vocabulary (unknown -> [UNK])."""
    vocab, tk = vocab_and_tokens(spark, sf_dir)
    e = TK.encode_df(tk, "doc_id", "tok", vocab, keep=["doc_id"])
    return e.select(
        "doc_id",
        TK.ids_text(F.col("ids")).alias("ids"),
        F.size("ids").alias("n_ids"),
        F.size(F.filter("ids", lambda i: i == TK.UNK)).alias("n_unk"),
    )


@query(
    "decode_ids",
    sql=f"SELECT doc_id, array_to_string(tok, ' ') AS text FROM ({_D_TOK})",
)
def decode_ids(spark, sf_dir):
    """I16: ids -> text; the round trip restores the cleaned tokens."""
    vocab, tk = vocab_and_tokens(spark, sf_dir)
    e = TK.encode_df(tk, "doc_id", "tok", vocab, keep=["doc_id"])
    return TK.decode_df(e.select("doc_id", "ids"), "doc_id", "ids", vocab).select("doc_id", "text")


@query(
    "pad_mask",
    sql=f"""
WITH tk AS ({_D_TOK}), {_D_VOCAB}, {_d_ids('x', 'tk', 'doc_id', 'tok', 512)}
SELECT doc_id, {_d_ids_text(_d_pad('ids', 512))} AS input_ids,
  {_d_ids_text("list_slice(list_transform(range(len(ids)), lambda x: 1) || list_transform(range(512), lambda x: 0), 1, 512)")} AS attention_mask
FROM x
""",
)
def pad_mask(spark, sf_dir):
    """Ids cut to 512 with both markers kept, or padded, and the attention mask."""
    vocab, tk = vocab_and_tokens(spark, sf_dir)
    e = TK.encode_df(tk, "doc_id", "tok", vocab, limit=512, keep=["doc_id"])
    return e.select(
        "doc_id",
        TK.ids_text(TK.pad_truncate(F.col("ids"), 512)).alias("input_ids"),
        TK.ids_text(TK.attention_mask(F.col("ids"), 512)).alias("attention_mask"),
    )


def _labels(spark, sf_dir):
    vocab, _ = vocab_and_tokens(spark, sf_dir)
    x = pairs(spark, sf_dir, cleaned=True).select("conv_id", "turn", ws_tokens(F.col("summary")).alias("stok"))
    e = TK.encode_df(x, ["conv_id", "turn"], "stok", vocab, limit=128, keep=["conv_id", "turn"])
    return e.select("conv_id", "turn", TK.mask_labels(TK.pad_truncate(F.col("ids"), 128)).alias("labels"))


_D_LABELS = f"""WITH tk AS ({_D_TOK}), {_D_VOCAB},
sp AS (SELECT conv_id, turn, {d_tokens('summary')} AS stok FROM ({_d_pairs(d_clean)})),
{_d_ids('x', 'sp', 'conv_id, turn', 'stok', 128)}, l AS (SELECT conv_id, turn, {_d_pad('ids', 128)} AS labels FROM x)"""


@query(
    "label_mask",
    sql=f"{_D_LABELS} SELECT conv_id, turn, {_d_ids_text('list_transform(labels, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)')} AS labels FROM l",
)
def label_mask(spark, sf_dir):
    """Summary ids padded to 128 with padding replaced by -100."""
    return _labels(spark, sf_dir).select("conv_id", "turn", TK.ids_text(F.col("labels")).alias("labels"))


@query("label_unmask", sql=f"{_D_LABELS} SELECT conv_id, turn, {_d_ids_text('labels')} AS labels FROM l")
def label_unmask(spark, sf_dir):
    """-100 back to the padding id (round trip of the label mask)."""
    return _labels(spark, sf_dir).select("conv_id", "turn", TK.ids_text(TK.unmask_labels(F.col("labels"))).alias("labels"))


@query(
    "seq2seq_pairs",
    sql=f"""
WITH tk AS ({_D_TOK}), {_D_VOCAB},
c AS (SELECT conv_id, turn, chunk_no, {d_tokens(sql_lit(PREFIX) + ' || chunk')} AS itok, {d_tokens('summary')} AS ltok
      FROM {_d_pair_windows(_d_pairs(d_clean))}),
{_d_ids('i', 'c', 'conv_id, turn, chunk_no', 'itok', PAIR_WIN)}, {_d_ids('l', 'c', 'conv_id, turn, chunk_no', 'ltok', PAIR_WIN)}
SELECT conv_id, turn, chunk_no, {_d_ids_text('i.ids')} AS input_ids, {_d_ids_text('l.ids')} AS labels,
  len(itok) + 2 > {PAIR_WIN} AS was_truncated
FROM c JOIN i USING (conv_id, turn, chunk_no) JOIN l USING (conv_id, turn, chunk_no)
""",
)
def seq2seq_pairs(spark, sf_dir):
    """Prefix + chunk -> input ids, summary -> labels, both cut at the window
    with their markers kept.

    The prefix counts against the cut, so a full chunk loses its tail
    (flagged by ``was_truncated``).  Both sides are encoded in one pass.
    """
    vocab, _ = vocab_and_tokens(spark, sf_dir)
    ch = pair_chunks(spark, sf_dir, cleaned=True)
    itok = ws_tokens(F.concat(F.lit(PREFIX), F.col("chunk")))
    x = ch.select("conv_id", "turn", "chunk_no", itok.alias("itok"), ws_tokens(F.col("summary")).alias("ltok"))
    x = x.select("conv_id", "turn", "chunk_no", F.size("itok").alias("n"), F.concat("itok", "ltok").alias("tok"))
    ids = TK.token_ids(x, F.col("tok"), vocab, "ids", keep=["conv_id", "turn", "chunk_no", "n"])
    left, right = F.slice("ids", F.lit(1), F.col("n")), F.slice("ids", F.col("n") + 1, F.size("ids"))
    return ids.select(
        "conv_id", "turn", "chunk_no",
        TK.ids_text(TK.with_markers(left, limit=PAIR_WIN)).alias("input_ids"),
        TK.ids_text(TK.with_markers(right, limit=PAIR_WIN)).alias("labels"),
        (F.col("n") + 2 > PAIR_WIN).alias("was_truncated"),
    )
