"""Texts to tokens, embeddings, contextual chunk embeddings and late-interaction token vectors.

Each operator is one Arrow stage that carries its key columns; a row that fails keeps its place with ``error``
set. Nothing is shuffled but chunks, which meet by document. Tokenisation and model run in one Python stage.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..nn import model as nn
from ..session import ship
from ..tokenizers import Tokenizer, open_tokenizer, truncate
from .batching import run_packed
from .registry import Served


#: Models and tokenizers that a worker keeps open.
MODELS_HELD = nn.MODELS_HELD


@lru_cache(maxsize=MODELS_HELD)
def _tokenizer(directory: str, append_terminal: bool) -> Tokenizer:
    return open_tokenizer(directory, append_terminal)


def _stage(df: DataFrame, keys: list[str], value: str, columns: str, work: Callable[[list], dict[str, list]], tasks: int | None = None, deal: Column | None = None) -> DataFrame:
    """``keys`` beside the columns that ``work`` makes of a batch's values. With ``tasks`` the rows are dealt out to as many tasks
    first, equal values (or values of ``deal``) to the same one: worth a shuffle where few bytes make much work, which partitions by size don't see."""
    ship(df.sparkSession)
    schema = df.select(*keys).schema
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = work(b.column(len(keys)).to_pylist())
            arrays = [pa.array(v, _ARROW[c]) for c, v in made.items()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *arrays], names=[*keys, *made])

    rows = df.select(*keys, value)
    return (rows.repartition(tasks, F.xxhash64(value) if deal is None else deal) if tasks else rows).mapInArrow(run, ddl)


_ints, _floats = pa.list_(pa.int32()), pa.list_(pa.float32())
_ARROW = {"ids": _ints, "keep": _ints, "n_tokens": pa.int32(), "error": pa.string(), "embedding": _floats, "embeddings": pa.list_(_floats), "vectors": pa.list_(_floats)}


def _encoded(t: Tokenizer, text: str | None, instruct: str | None, cap: int, cut: bool, keep_tail: bool) -> tuple[np.ndarray | None, str | None]:
    if not text:
        return None, "input must not be empty"
    try:
        ids = t.encode_array(text, instruct)
    except ValueError as e:
        return None, str(e)
    if len(ids) > cap:
        return (truncate(ids, cap, keep_tail), None) if cut else (None, f"input exceeds {cap} token limit")
    return ids, None


def tokenize(df: DataFrame, keys: list[str], text: str, model: Served, instruct: str | None = None, cut: bool = True, tasks: int | None = None) -> DataFrame:
    """keys, ids, n_tokens, error. Null and empty texts are errors; texts beyond the model's cap are cut, or errors if not ``cut``."""
    place, terminal, cap, tail = model.directory, model.config.append_terminal, model.token_cap, model.keep_tail

    def work(texts: list) -> dict[str, list]:
        t = _tokenizer(place, terminal)
        got = [_encoded(t, x, instruct, cap, cut, tail) for x in texts]
        return {"ids": [i for i, _ in got], "n_tokens": [None if i is None else len(i) for i, _ in got], "error": [e for _, e in got]}

    return _stage(df, keys, text, "ids array<int>, n_tokens int, error string", work, tasks)


def tokenize_late(df: DataFrame, keys: list[str], text: str, model: Served, is_query: bool) -> DataFrame:
    """keys, ids, keep, n_tokens, error in the late-interaction layout."""
    place, terminal, cap = model.directory, model.config.append_terminal, model.token_cap

    def one(t: Tokenizer, x: str | None) -> tuple:
        try:
            ids, keep = t.encode_late(x or "", is_query)
            return (ids, keep, None) if len(ids) <= cap else (None, None, f"{'query' if is_query else 'document'} exceeds {cap} token limit")
        except (ValueError, IndexError) as e:
            return None, None, str(e)

    def work(texts: list) -> dict[str, list]:
        t = _tokenizer(place, terminal)
        got = [one(t, x) for x in texts]
        return {"ids": [g[0] for g in got], "keep": [g[1] for g in got], "n_tokens": [len(g[0]) if g[0] else None for g in got], "error": [g[2] for g in got]}

    return _stage(df, keys, text, "ids array<int>, keep array<int>, n_tokens int, error string", work)


#: Bytes of vectors that a worker keeps to answer copies of their texts.
KEPT = 16 << 20


@lru_cache(maxsize=MODELS_HELD)
def _answered(place: str, *how: object) -> OrderedDict[bytes, tuple]:
    """A worker's answers (vector, tokens, error) by the digests of their texts, the latest last."""
    return OrderedDict()


def _pooled(model: Served, instruct: str | None, cut: bool) -> Callable[[list], dict[str, list]]:
    """What makes embedding, n_tokens and error of a batch's texts. Batches are packed by length within a token budget; of equal texts in a
    batch, or among the worker's latest, one is run."""
    place, terminal, cap, tail = model.directory, model.config.append_terminal, model.token_cap, model.keep_tail
    most = max(1, KEPT // (4 * model.config.hidden))

    def work(texts: list) -> dict[str, list]:
        t, m, kept = _tokenizer(place, terminal), nn.load(place), _answered(place, terminal, cap, tail, instruct, cut)
        digests = [blake2b((x or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in texts]
        answers = {d: kept[d] for d in digests if d in kept}
        new = {d: x for d, x in zip(digests, texts, strict=True) if d not in answers}
        got = [_encoded(t, x, instruct, cap, cut, tail) for x in new.values()]
        good = [i for i, (ids, _) in enumerate(got) if ids is not None]
        rows = [got[i][0] for i in good]
        made = dict(zip(good, run_packed(rows, lambda b: [(v.copy(), None) for v in m.embed([rows[i] for i in b])], lambda e: (None, str(e))), strict=True))
        for i, (d, (ids, e)) in enumerate(zip(new, got, strict=True)):
            vector, error = made.get(i, (None, e))
            answers[d] = vector, None if ids is None else len(ids), error
        for d, x in answers.items():
            kept[d] = x
            kept.move_to_end(d)
        while len(kept) > most:
            kept.popitem(last=False)
        return {c: [answers[d][k] for d in digests] for k, c in enumerate(("embedding", "n_tokens", "error"))}

    return work


_POOLED = "embedding array<float>, n_tokens int, error string"


def embed(df: DataFrame, keys: list[str], text: str, model: Served, instruct: str | None = None, cut: bool = True, tasks: int | None = None) -> DataFrame:
    """keys, embedding, n_tokens, error: one pooled vector a text."""
    return _stage(df, keys, text, _POOLED, _pooled(model, instruct, cut), tasks)


def embed_each(df: DataFrame, keys: list[str], label: str, text: str, models: Sequence[Served], cut: bool = True, tasks: int | None = None, unlabelled: bool = False) -> DataFrame:
    """``embed`` of rows whose ``label`` names one of a few models, in one stage: the rows are made once, however many models there are.
    Rows of other labels are left out; those without a label too, or they go along with nothing made (``unlabelled``). A worker holds all of these models (it keeps ``MODELS_HELD``)."""
    works = {m.label: _pooled(m, None, cut) for m in models}

    def work(rows: list) -> dict[str, list]:
        out: dict[str, list] = {c: [None] * len(rows) for c in ("embedding", "n_tokens", "error")}
        for name, own in works.items():
            at = [i for i, r in enumerate(rows) if r["label"] == name]
            for c, made in own([rows[i]["text"] for i in at]).items() if at else ():
                for i, x in zip(at, made, strict=True):
                    out[c][i] = x
        return out

    known = F.col(label).isin(list(works))
    value = F.struct(F.col(label).alias("label"), F.col(text).alias("text"))
    deal = F.when(F.col("_value.label").isNull(), F.xxhash64(*keys)).otherwise(F.xxhash64("_value"))
    return _stage(df.where(known | F.col(label).isNull() if unlabelled else known).withColumn("_value", value), keys, "_value", _POOLED, work, tasks, deal)


def embed_distinct(df: DataFrame, keys: list[str], text: str, model: Served, instruct: str | None = None) -> DataFrame:
    """``embed``, with each distinct text encoded once: worth its two shuffles where texts repeat and the model is slow."""
    digest = df.withColumn("_digest", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    once = embed(digest.groupBy("_digest").agg(F.min(text).alias("_text")), ["_digest"], "_text", model, instruct)
    return digest.select(*keys, "_digest").join(once, "_digest").drop("_digest")


def pack_chunks(df: DataFrame, keys: list[str], chunk_index: str, ids: str, separator: int, error: str | None = None) -> DataFrame:
    """keys, ids, spans, chunks: each document's chunks in order with separators between; spans leave the separators out. With ``error`` (a
    column's name) also the largest of a document's errors."""
    more = [F.max(error).alias("error")] if error else []
    chunks = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(chunk_index).alias("i"), F.col(ids).alias("t")))).alias("c"), *more)
    first = F.lit(None).cast("array<int>")
    packed = F.aggregate("c", F.struct(first.alias("ids"), F.array().cast("array<struct<start:int,n_tokens:int>>").alias("spans")), lambda a, x: F.struct(
        F.when(a["ids"].isNull(), x["t"]).otherwise(F.concat(a["ids"], F.array(F.lit(separator)), x["t"])).alias("ids"),
        F.concat(a["spans"], F.array(F.struct(F.when(a["ids"].isNull(), 0).otherwise(F.size(a["ids"]) + 1).alias("start"), F.size(x["t"]).alias("n_tokens")))).alias("spans"),
    ))
    return chunks.withColumn("p", packed).select(*keys, "p.ids", "p.spans", F.transform("c", lambda x: x["i"]).alias("chunks"), *(["error"] if error else []))


def embed_chunks(df: DataFrame, doc: str, chunk_index: str, text: str, model: Served, tasks: int | None = None) -> DataFrame:
    """doc, chunk index, embedding, n_tokens (of the packed document), error: each chunk in its document's context.

    A document with a bad chunk, or beyond the model's cap, is an error in all of its chunks; nothing is cut."""
    tokens = tokenize(df, [doc, chunk_index], text, model, cut=False)
    packed = pack_chunks(tokens, [doc], chunk_index, "ids", model.tokenizer().separator, "error")
    value = packed.select(doc, "chunks", F.struct("ids", "spans", "error").alias("value"))
    place, cap = model.directory, model.token_cap

    def work(values: list) -> dict[str, list]:
        m = nn.load(place)
        good = [i for i, v in enumerate(values) if v["error"] is None]
        rows = [values[i]["ids"] for i in good]
        spans = [[(s["start"], s["n_tokens"]) for s in values[i]["spans"]] for i in good]

        def run(batch: list[int]) -> list[tuple]:
            if any(len(rows[i]) > cap for i in batch):
                raise nn.ModelError(f"document exceeds {cap} token limit")
            return [(x.tolist(), None) for x in m.embed_spans([rows[i] for i in batch], [spans[i] for i in batch])]

        out: dict[str, list] = {"embeddings": [None] * len(values), "n_tokens": [None] * len(values), "error": [v["error"] for v in values]}
        for i, row, (x, e) in zip(good, rows, run_packed(rows, run, lambda e: (None, str(e))), strict=True):
            out["embeddings"][i], out["n_tokens"][i], out["error"][i] = x, len(row), e
        return out

    out = _stage(value, [doc, "chunks"], "value", "embeddings array<array<float>>, n_tokens int, error string", work, tasks or df.sparkSession.sparkContext.defaultParallelism)
    return out.select(doc, "n_tokens", "error", F.posexplode("chunks").alias("k", chunk_index), "embeddings").select(doc, chunk_index, F.get("embeddings", "k").alias("embedding"), "n_tokens", "error")


def late_vectors(df: DataFrame, keys: list[str], text: str, model: Served, is_query: bool, tasks: int | None = None) -> DataFrame:
    """keys, vectors (unit vectors of the scored tokens), n_tokens, error. Made once, a document's vectors serve every query."""
    tokens = tokenize_late(df, keys, text, model, is_query)
    place = model.directory

    def work(values: list) -> dict[str, list]:
        m = nn.load(place)
        good = [i for i, v in enumerate(values) if v["ids"]]
        rows, keep = [values[i]["ids"] for i in good], [values[i]["keep"] for i in good]
        made = run_packed(rows, lambda b: [(x.astype(np.float32).tolist(), None) for x in m.late_tokens([rows[i] for i in b], [keep[i] for i in b])], lambda e: (None, str(e)))
        out: dict[str, list] = {"vectors": [None] * len(values), "n_tokens": [len(v["ids"]) if v["ids"] else None for v in values], "error": [v["error"] for v in values]}
        for i, (v, e) in zip(good, made, strict=True):
            out["vectors"][i], out["error"][i] = v, e
        return out

    return _stage(tokens.select(*keys, F.struct("ids", "keep", "error").alias("value")), keys, "value", "vectors array<array<float>>, n_tokens int, error string", work, tasks)
