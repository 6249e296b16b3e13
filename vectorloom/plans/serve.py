"""The three routes over tables of requests: validate, run, answer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import embedding as E
from ..operators import similarity as S
from ..operators.registry import ModelRegistry, Served
from ..session import ship
from . import requests as R


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _settled(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, or these columns of them, behind a boundary: the many checks are computed once a row, not again in every filter and column above."""
    df = df.select(*columns) if columns else df
    return df.mapInArrow(_same, df.schema)


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return batches


def _rendered(how: dict[str, tuple[bool, bool, int]]):
    """Embedding, dims, encoding, model to JSON text: truncated, made a unit vector again where the model asks for it, encoded. ``how``:
    whether a model's API is native, whether it asks for unit vectors, and its whole size."""
    def one(vec: list | None, dims: int, encoding: str, model: str) -> str | None:
        if vec is None:
            return None
        native, renormalize, full = how[model]
        x = np.array(vec, np.float32)[:dims]
        if renormalize and dims < full and (n := float(np.linalg.norm(x.astype(np.float64)))) > 0:
            x = (x / n).astype(np.float32)
        q = np.clip(np.rint(np.tanh(x.astype(np.float64)) * 127), -128, 127).astype(np.int8)
        if encoding == "float":
            return "[" + ",".join(f"{f:.9g}" for f in (q / 128 if native else x).tolist()) + "]"
        data = x.astype("<f4").tobytes() if encoding == "base64" else q.tobytes() if encoding == "base64_int8" else np.packbits(x >= 0, bitorder="little").tobytes()
        return f'"{base64.b64encode(data).decode()}"'

    def render(vec: pa.Array, dims: pa.Array, encoding: pa.Array, model: pa.Array) -> pa.Array:
        return pa.array([one(*row) for row in zip(*(c.to_pylist() for c in (vec, dims, encoding, model)), strict=True)], pa.string())

    return F.arrow_udf(render, "string")


def _encoded(models: list[Served], standard: bool) -> Column:
    how = {m.label: (m.api == "perplexity", standard and m.config.normalize and m.config.pooling == "last", m.dim) for m in models}
    return _rendered(how)("embedding", "dims", "encoding", "model")


def _answers(checked: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """key, status, response: answers of what was run, errors of the rest."""
    refused = checked.where(F.size("errors") > 0).select(key, F.lit(422).alias("status"), R.error_response(F.col("errors")).alias("response"))
    return done.unionByName(refused)


def _outcome() -> list[Column]:
    """Aggregates of a request's items: errors of those that failed, and tokens."""
    limit = F.col("error").endswith("token limit")
    what = F.struct(F.col("at").alias("loc"), F.when(limit, F.col("error")).otherwise("tokenization failed").alias("msg"), F.when(limit, "value_error.context_length").otherwise("value_error.tokenization").alias("type"))
    return [F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), what))).alias("failed"), F.sum(F.coalesce("n_tokens", F.lit(0))).alias("tokens")]


def _limited(made: DataFrame, field: str) -> DataFrame:
    """The same with an error for requests of too many tokens."""
    over = R.over_request_limit(F.col("tokens"), field)
    return made.withColumn("failed", F.filter(F.concat(F.col("failed"), F.array(over)), lambda e: e.isNotNull()))


def embeddings(requests: DataFrame, registry: ModelRegistry, key: str = "request_id", body: str = "body", auto_truncate: bool = False) -> DataFrame:
    """key, status (200 or 422), response. Texts beyond a model's cap are cut with ``auto_truncate``, else refused. Requests are exploded to inputs, embedded model by model and gathered again;
    a refused request goes along as one input without model, index or text, so that bodies are made, parsed and checked once."""
    ship(requests.sparkSession)
    checked = _settled(R.validate_embeddings(requests, registry, body), key, "model", "inputs", "encoding", "dims", "text_type", "errors")
    standard = [m for m in registry.models.values() if m.kind == "standard"]
    if not standard:
        return _answers(checked, checked.limit(0).select(key, F.lit(200).alias("status"), F.lit("").alias("response")), key)
    good = F.size("errors") == 0
    inputs = checked.select(key, F.when(good, F.col("model")).alias("model"), "encoding", "dims", "text_type", "errors", F.posexplode_outer(F.when(good, F.col("inputs"))).alias("index", "text"))
    text = F.when(F.col("text_type") == "query", F.concat(R.of_model(registry, F.col("model"), "query", ""), "text")).otherwise(F.col("text"))
    tasks = requests.sparkSession.sparkContext.defaultParallelism
    parts = []
    for i in range(0, len(standard), E.MODELS_HELD):
        some = standard[i : i + E.MODELS_HELD]
        rows = E.embed_each(inputs.withColumn("text", text), [key, "index", "model", "encoding", "dims", "errors"], "model", "text", some, auto_truncate, tasks, unlabelled=i == 0)
        parts.append(rows.withColumn("embedding", _encoded(some, True)))
    asked = F.col("index").isNotNull()
    rows = _union(parts).withColumn("at", F.array(F.lit("body"), F.lit("input"), F.col("index").cast("string")))
    item = F.concat(F.lit('{"object":"embedding","index":'), F.col("index"), F.lit(',"embedding":'), F.col("embedding"), F.lit("}"))
    items = F.transform(F.array_sort(F.collect_list(F.when(asked, F.struct("index", item.alias("json"))))), lambda x: x["json"])
    refused = F.collect_list(F.when(~asked, F.col("errors"))).alias("refused")
    made = _limited(rows.groupBy(key).agg(F.first("model", ignorenulls=True).alias("model"), items.alias("items"), refused, *_outcome()), "input")  # once: each use of the rows would run the models again
    made = made.withColumn("failed", F.explode(F.when(F.col("model").isNull(), F.col("refused")).otherwise(F.concat("refused", F.array("failed")))))
    response = F.concat(F.lit('{"object":"list","data":['), F.array_join("items", ","), F.lit('],"model":'), _quoted("model"), F.lit(',"usage":{"prompt_tokens":'), "tokens", F.lit(',"total_tokens":'), "tokens", F.lit("}}"))
    return _status(made, key, response)


def contextual(requests: DataFrame, registry: ModelRegistry, key: str = "request_id", body: str = "body") -> DataFrame:
    """key, status, response: nested lists, a list of chunks for each document. Nothing is cut or normalised."""
    ship(requests.sparkSession)
    checked = _settled(R.validate_contextual(requests, registry, body))
    docs = checked.where(F.size("errors") == 0).select(key, "model", "encoding", "dims", F.posexplode("documents").alias("doc", "chunks"))
    chunks = docs.select(F.struct(key, "doc", "model", "encoding", "dims").alias("d"), F.posexplode("chunks").alias("index", "text"))
    parts = []
    for m in (m for m in registry.models.values() if m.kind == "contextual"):
        rows = E.embed_chunks(chunks.where(F.col("d.model") == m.label), "d", "index", "text", m).select("d.*", "index", "embedding", "n_tokens", "error")
        parts.append(rows.withColumn("embedding", _encoded([m], False)))
    if not parts:
        return _answers(checked, checked.limit(0).select(key, F.lit(200).alias("status"), F.lit("").alias("response")), key)
    rows = _union(parts).withColumn("at", F.array(F.lit("body"), F.lit("input"), F.col("doc").cast("string")))
    item = F.concat(F.lit('{"object":"embedding","index":'), F.col("index"), F.lit(',"embedding":'), F.col("embedding"), F.lit("}"))
    by_doc = rows.groupBy(key, "doc").agg(F.first("model").alias("model"), F.max("n_tokens").alias("n_tokens"), F.first("error").alias("error"), F.first("at").alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("index", item.alias("json")))), lambda x: x["json"]).alias("items"))
    listed = F.concat(F.lit('{"object":"list","index":'), F.col("doc"), F.lit(',"data":['), F.array_join("items", ","), F.lit("]}"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("doc", listed.alias("json")))), lambda x: x["json"])
    made = _limited(by_doc.groupBy(key).agg(F.first("model").alias("model"), items.alias("items"), *_outcome()), "input")
    response = F.concat(F.lit('{"object":"list","data":['), F.array_join("items", ","), F.lit('],"model":'), _quoted("model"), F.lit(',"usage":{"prompt_tokens":'), "tokens", F.lit(',"total_tokens":'), "tokens", F.lit("}}"))
    return _answers(checked, _status(made, key, response), key)


def rerank(requests: DataFrame, registry: ModelRegistry, key: str = "request_id", body: str = "body") -> DataFrame:
    """key, status, response: results by score, ties by index, at most top_n, with the documents where asked for."""
    ship(requests.sparkSession)
    checked = _settled(R.validate_rerank(requests, registry, body))
    good = checked.where(F.size("errors") == 0)
    parts = []
    for m in (m for m in registry.models.values() if m.kind == "late"):
        own = good.where(F.col("model") == m.label)
        q = E.late_vectors(own.select(key, "query"), [key], "query", m, True)
        d = E.late_vectors(own.select(key, F.posexplode("documents").alias("index", "text")), [key, "index"], "text", m, False)
        pair = F.struct(F.col(key).alias("r"), F.col("index").alias("i"))
        scores = S.rerank(d.select(F.col(key).alias("qid"), pair.alias("doc_id")), q.select(F.col(key).alias("qid"), "vectors"), d.select(pair.alias("doc_id"), "vectors"))
        tokens = q.select(key, "n_tokens", "error", F.array(F.lit("body"), F.lit("query")).alias("at"), F.lit(True).alias("is_q")).union(d.select(key, "n_tokens", "error", F.array(F.lit("body"), F.lit("documents"), F.col("index").cast("string")), F.lit(False)))
        use = tokens.groupBy(key).agg(F.sum(F.when(F.col("is_q"), F.col("n_tokens")).otherwise(0)).alias("query_tokens"), F.sum(F.when(~F.col("is_q"), F.col("n_tokens")).otherwise(0)).alias("document_tokens"))
        top = scores.join(own.select(F.col(key).alias("qid"), "top_n", "return_documents", "documents"), "qid").where(F.col("rank") <= F.col("top_n"))
        text = F.when(F.col("return_documents"), F.get("documents", F.col("doc_id.i")))
        item = F.to_json(F.struct(F.col("doc_id.i").alias("index"), F.col("score").alias("relevance_score"), text.alias("document")))
        by = top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("json")))), lambda x: x["json"]).alias("items"))
        parts.append(by.withColumnRenamed("qid", key).join(use, key).join(_limited(tokens.groupBy(key).agg(*_outcome()), "documents"), key).withColumn("model", F.lit(m.label)))
    if not parts:
        return _answers(checked, checked.limit(0).select(key, F.lit(200).alias("status"), F.lit("").alias("response")), key)
    response = F.concat(F.lit('{"object":"list","model":'), _quoted("model"), F.lit(',"results":['), F.array_join("items", ","), F.lit('],"usage":{"query_tokens":'), "query_tokens", F.lit(',"document_tokens":'), "document_tokens", F.lit(',"total_tokens":'), F.col("query_tokens") + F.col("document_tokens"), F.lit("}}"))
    return _answers(checked, _status(_union(parts), key, response), key)


def _quoted(column: str) -> Column:
    text = F.to_json(F.struct(F.col(column).alias("x")))
    return text.substr(F.lit(6), F.length(text) - 6)


def _status(made: DataFrame, key: str, response: Column) -> DataFrame:
    failed = F.size("failed") > 0
    return made.select(key, F.when(failed, 422).otherwise(200).alias("status"), F.when(failed, R.error_response(F.col("failed"))).otherwise(response).alias("response"))


