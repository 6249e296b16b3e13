"""Text in and out: lines, argument lists, request bodies; plain, JSON and NDJSON sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import format_floats

STREAM_ERROR = "tokenization failed"


def lines(spark: SparkSession, path: str, streaming: bool = False, **options: str) -> DataFrame:
    """text: the lines of files, blank ones skipped, ends trimmed of their newline. Lines of any length are whole."""
    reader = (spark.readStream if streaming else spark.read).options(**options)
    return reader.text(path).select(F.rtrim(F.col("value"), F.lit("\r")).alias("text")).where("length(text) > 0")


def arguments(spark: SparkSession, args: Sequence[str]) -> DataFrame:
    """pos, text from command-line arguments: what follows ``--`` is text, whatever it looks like."""
    args = list(args)
    cut = args.index("--") if "--" in args else len(args)
    texts = [a for a in args[:cut] if not a.startswith("-")] + args[cut + 1 :]
    return spark.createDataFrame(list(enumerate(texts)), "pos int, text string")


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """request_id, body: one JSON request a line."""
    return spark.read.text(path).select(F.xxhash64("value", F.monotonically_increasing_id()).alias("request_id"), F.col("value").alias("body"))


def plain(vec: str | Column) -> Column:
    """Components with eight decimals between spaces."""
    return format_floats(vec, "%.8f")


def json_array(vec: str | Column, pattern: str = "%.8f") -> Column:
    return F.concat(F.lit("["), format_floats(vec, pattern, ","), F.lit("]"))


def ndjson(embedding: str | Column, n_tokens: str | Column, error: str | Column, ms: str | Column | None = None, workspace: int = 0) -> Column:
    """One line of a stream's answer: the embedding with dim, tokens, ms and workspace_bytes, or the error."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    n = F.col(n_tokens) if isinstance(n_tokens, str) else n_tokens
    bad = F.col(error) if isinstance(error, str) else error
    took = F.lit(None).cast("double") if ms is None else F.col(ms) if isinstance(ms, str) else ms
    good = F.concat(F.lit('{"embedding":'), json_array(e), F.lit(',"dim":'), F.size(e), F.lit(',"tokens":'), n, F.lit(',"ms":'), F.format_string("%.3f", F.coalesce(took, F.lit(0.0))), F.lit(f',"workspace_bytes":{workspace}}}'))
    return F.when(bad.isNull(), good).otherwise(F.to_json(F.struct(bad.alias("error"))))


def matrix_lines(pairs: DataFrame) -> DataFrame:
    """left_id, line: the rows of a cosine matrix (left_id, right_id, cosine) with six decimals."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("right_id", "cosine"))), lambda x: F.format_string("%.6f", x["cosine"]))
    return pairs.groupBy("left_id").agg(F.array_join(row, " ").alias("line"))
