"""Streams of texts: stateless embedding of every line, windows and load limits through the trigger and the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.embedding import embed
from ..operators.registry import ModelRegistry, Served
from ..sources.text import lines, ndjson


def embed_lines(stream: DataFrame, model: Served, keys: list[str] | None = None) -> DataFrame:
    """keys, line (NDJSON) for every row of a stream or table with a ``text``; a bad row becomes an error line, the rest go on."""
    keys = keys or []
    made = embed(stream, [*keys, "text"], "text", model, cut=True)
    return made.select(*keys, ndjson("embedding", "n_tokens", "error").alias("line"))


def merge_by_model(stream: DataFrame, registry: ModelRegistry, model_col: str = "model") -> DataFrame:
    """A stream of texts for several models: compatible rows are merged by one branch for each model."""
    out: DataFrame | None = None
    for m in registry.models.values():
        part = embed(stream.where(F.col(model_col) == m.label), [model_col, "text"], "text", m)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the registry is empty")
    return out


def start(stream: DataFrame, sink: str, checkpoint: str, window_ms: int | None = None, path: str | None = None, name: str | None = None) -> StreamingQuery:
    """Start a query. ``window_ms``: rows that arrive within it share micro-batches; None: what there is, then stop."""
    writer = stream.writeStream.outputMode("append").format(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if window_ms is None else writer.trigger(processingTime=f"{window_ms} milliseconds")
    writer = writer.queryName(name) if name else writer
    return writer.start(path) if path else writer.start()


def embed_files(spark: SparkSession, source: str, target: str, checkpoint: str, model: Served, files_per_trigger: int = 128, bytes_per_trigger: str | None = None) -> StreamingQuery:
    """Every line of the files that arrive in ``source`` as an NDJSON line in ``target``. The limits shed load: what a
    micro-batch may take is bounded, the rest waits in the source."""
    options = {"maxFilesPerTrigger": str(files_per_trigger)} if bytes_per_trigger is None else {"maxBytesPerTrigger": bytes_per_trigger}
    return start(embed_lines(lines(spark, source, streaming=True, **options), model), "text", checkpoint, path=target)
