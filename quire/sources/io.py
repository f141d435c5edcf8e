"""File sources and sinks with explicit schemas.

Excel is not available (no codec in this environment); the same tables
travel as Parquet, JSON Lines and CSV.  Every reader takes an explicit
schema, so nothing is inferred from the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import py_strip
from quire.operators.aggregate import in_order
from quire.session import cut_lineage

POINT_SCHEMA = (
    "id string, vector array<float>, "
    "payload struct<page_content:string, metadata:struct<text:string, lang:string, source:string, issue:string>>"
)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Columnar sink without any index column."""
    df.write.mode(mode).parquet(path)


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read
    if schema:
        r = r.schema(schema)
    return r.parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, UTF-8; null fields are kept as keys."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines with an explicit schema (malformed lines fail the read)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 50_000) -> None:
    """Submission CSV: header, quotes escaped by doubling, newlines kept inside quotes.

    A file with newlines in its values is read by one task, so files are
    bounded by ``rows_per_file``.
    """
    (
        df.write.mode(mode)
        .option("maxRecordsPerFile", rows_per_file)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("quoteAll", True)
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """One word per line; each line stripped; a blank line is the empty word."""
    return spark.read.text(path).select(py_strip(F.col("value")).alias("word")).distinct()


def write_lines(df: DataFrame, col: str, path: str, mode: str = "overwrite") -> None:
    df.select(F.col(col).cast("string").alias("value")).write.mode(mode).text(path)


def read_nested_results(spark: SparkSession, path: str) -> DataFrame:
    """Read the original results format: one JSON array of arrays of strings
    per file, position-aligned with the input rows.

    A single JSON document cannot be split, so each file is read by one
    task; our own sink writes keyed JSON Lines instead.  Output rows
    (file, doc_pos, step, output).
    """
    raw = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    docs = raw.select("file", F.posexplode(F.from_json("value", "array<array<string>>")).alias("doc_pos", "steps"))
    return docs.select("file", "doc_pos", F.posexplode("steps").alias("step", "output"))


# ------------------------------------------------------- positional results


def write_positional(df: DataFrame, order_col: str, steps_col: str, path: str, rows_per_file: int = 1000, mode: str = "overwrite") -> None:
    """Results as JSON arrays of arrays of strings, aligned with the rows' order.

    A single document would be one task's, so the rows are cut into files of
    ``rows_per_file``; a file's folder names the place of its first row.  The
    rows are written before they are dealt to ranges, which reads them twice.
    """
    rows = in_order(cut_lineage(df.select(order_col, F.col(steps_col).alias("steps")), "results"), order_col)
    first = F.expr(f"pos - pos % {int(rows_per_file)}").alias("first")
    lists = rows.groupBy(first).agg(F.sort_array(F.collect_list(F.struct("pos", "steps"))).alias("l"))  # rows_per_file of them
    lists.select("first", F.to_json(F.transform("l", lambda x: x["steps"])).alias("value")).write.mode(mode).partitionBy("first").text(path)


def read_positional(spark: SparkSession, path: str) -> DataFrame:
    """(pos, steps) of files that ``write_positional`` wrote."""
    files = spark.read.schema("value string, first long").option("wholetext", True).option("basePath", path).text(path)
    rows = files.select("first", F.posexplode(F.from_json("value", "array<array<string>>")).alias("i", "steps"))
    return rows.select((F.col("first") + F.col("i")).alias("pos"), "steps")


def attach_positional(df: DataFrame, order_col: str, results: DataFrame, out_col: str = "steps") -> DataFrame:
    """``df`` with the result of each row's place; a row without a result or a
    result without a row fails."""
    rows = in_order(df, order_col, "_pos").withColumn("_row", F.lit(True))
    both = rows.join(results.select(F.col("pos").alias("_at"), F.col("steps").alias("_steps"), F.lit(True).alias("_got")), F.col("_pos") == F.col("_at"), "full")
    place = F.coalesce("_pos", "_at").cast("string")
    wrong = F.when(F.col("_got").isNull(), F.raise_error(F.concat(F.lit("no result for row "), place))).when(
        F.col("_row").isNull(), F.raise_error(F.concat(F.lit("no row for result "), place))
    )
    kind = results.schema["steps"].dataType
    return both.select(*[c for c in df.columns if c != out_col], F.coalesce(wrong.cast(kind), F.col("_steps")).alias(out_col))
