"""Row filters, column replacement and lexicon operators.

Lexicon operators (stop words, synonyms) take a list or a table of any size.
A small table goes to the tasks; a larger one is joined with the distinct tokens
of each row, and only the tokens that it holds come back to their row
(``operators.lookup``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import lookup as L

# Fixed value: the boilerplate phrase of the original corpus ("click the
# attachment link below"); documents containing it are dropped.
DEFAULT_BOILERPLATE = "點選下方附件連結"


def drop_boilerplate(df: DataFrame, text_col: str = "text", phrase: str = DEFAULT_BOILERPLATE) -> DataFrame:
    """Keep rows whose text does not contain ``phrase`` (literal); null text dropped."""
    c = F.col(text_col)
    return df.filter(c.isNotNull() & ~c.contains(phrase))


def dropna_subset(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(how="any", subset=cols)


def drop_columns_strict(df: DataFrame, *cols: str) -> DataFrame:
    """``drop`` that raises when a column is missing (pandas behaviour)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def content_id(*cols) -> Column:
    """Deterministic surrogate id: md5 over the content, stable across retries."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("␀")) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("\x1f", *parts))


def remove_stop_words(tokens: Column, stop_words: list[str]) -> Column:
    """Drop tokens found in the stop set; duplicates and order kept."""
    stop = F.array(*[F.lit(w) for w in sorted(set(stop_words))]) if stop_words else F.array().cast("array<string>")
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def _token_values(df: DataFrame, tokens_col: str, lexicon: DataFrame) -> DataFrame:
    """Adds ``_value``: per token its value in a lexicon table (word, value), or null."""
    kept, kind = df.columns, lexicon.schema["value"].dataType
    small = L.small_table(lexicon)
    if small is not None:
        return df.withColumn("_value", L.in_place(F.col(tokens_col), small, kind))
    rows = L.numbered(df, L.coded(F.col(tokens_col)).alias("_coded"))
    rows = L.hits(rows, F.col("_coded.words"), lexicon, "_hits")
    return rows.select(*kept, L.per_token(F.col("_hits"), F.col("_coded.codes"), kind).alias("_value"))


def remove_stop_words_df(df: DataFrame, key, tokens_col: str, lexicon: DataFrame, out_col: str = "tokens") -> DataFrame:
    """Stop-word removal against a lexicon table (column ``word``) of any size.
    Rows are numbered, so ``key`` may repeat or be null."""
    words = lexicon.select("word").distinct().withColumn("value", F.lit(True))
    rows = _token_values(df, tokens_col, words)
    return rows.withColumn(out_col, F.filter(tokens_col, lambda t, i: F.get(F.col("_value"), i).isNull())).drop("_value")


def replace_synonyms(tokens: Column, synonyms: dict[str, str]) -> Column:
    """Word -> first synonym if present, else itself (literal map)."""
    if not synonyms:
        return tokens
    m = F.create_map(*[F.lit(x) for kv in sorted(synonyms.items()) for x in kv])
    return F.transform(tokens, lambda t: F.coalesce(F.element_at(m, t), t))


def replace_synonyms_df(df: DataFrame, key, tokens_col: str, lexicon: DataFrame, out_col: str = "tokens") -> DataFrame:
    """Synonym replacement with a lexicon table (``word``, ``synonym``).

    The lexicon is reduced to one synonym per word (the first by order of
    the ``rank`` column when present, else the smallest), then joined.
    """
    lex = lexicon
    if "rank" in lex.columns:
        lex = lex.groupBy("word").agg(F.min_by("synonym", "rank").alias("value"))
    else:
        lex = lex.groupBy("word").agg(F.min("synonym").alias("value"))
    rows = _token_values(df, tokens_col, lex)
    return rows.withColumn(out_col, F.transform(tokens_col, lambda t, i: F.coalesce(F.get(F.col("_value"), i), t))).drop("_value")
