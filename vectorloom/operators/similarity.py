"""Cosine matrices, nearest neighbours, MaxSim ranking, pooling of groups: vectors against vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..nn import model as nn
from ..session import ship

#: Query components that one block may hold (a block goes to every task): 8 bytes each.
BLOCK_COMPONENTS = 4_000_000


def cosine_matrix(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_vec: str, right_vec: str) -> DataFrame:
    """left_id, right_id, cosine for every pair, diagonal and both triangles: as large as its result is meant to be."""
    return left.select(F.col(left_id).alias("left_id"), F.col(left_vec).alias("_a")).crossJoin(right.select(F.col(right_id).alias("right_id"), F.col(right_vec).alias("_b"))).select("left_id", "right_id", v.cosine_similarity("_a", "_b").alias("cosine"))


def _matrix(vectors: list) -> np.ndarray:
    """Unit rows in double precision; zero, missing and non-finite vectors are zero rows, so that their cosine is 0."""
    m = np.array(vectors, dtype=np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(np.isfinite(n) & (n > 0), m / np.where(n > 0, n, 1), 0.0)


def query_blocks(queries: DataFrame, id_col: str, vec_col: str, components: int = BLOCK_COMPONENTS) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and matrices of the queries, in blocks of bounded size, streamed through the driver."""
    ids, rows, dim = [], [], 0
    for i, x in queries.select(id_col, vec_col).where(F.col(vec_col).isNotNull()).toLocalIterator():
        dim = len(x)
        ids.append(i)
        rows.append(x)
        if len(rows) * dim >= components:
            yield ids, _matrix(rows)
            ids, rows = [], []
    if rows:
        yield ids, _matrix(rows)


def _kept(k: int, old: tuple[np.ndarray, np.ndarray] | None, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of each query (row) among those kept so far and further ones, ties by id."""
    if scores.shape[1] > 4 * k:  # all that reach the k-th best score, so that ties stay whole
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        near = (scores >= least[:, None]).any(0)
        scores, ids = scores[:, near], ids[near]
    ids = np.broadcast_to(ids, scores.shape)
    if old is not None:
        scores, ids = np.concatenate([old[0], scores], axis=1), np.concatenate([old[1], ids], axis=1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def top_k(queries: DataFrame, base: DataFrame, k: int, query_id: str = "qid", query_vec: str = "qvec", base_id: str = "id", base_vec: str = "vec", exclude_same: bool = False, components: int = BLOCK_COMPONENTS) -> DataFrame:
    """qid, id, cosine, rank: the ``k`` most similar rows of ``base`` for each query, ties by id.

    Queries are sent in blocks of at most ``components`` numbers; each task multiplies its rows with a block, keeps the best of each query
    over all its batches and passes them on once: what is shuffled grows with queries and tasks, not with pairs. Each further
    block is a further pass over ``base``. Base rows must be of one length, nulls are skipped."""
    ship(base.sparkSession)
    id_kind = base.schema[base_id].dataType.simpleString()
    qid_kind = queries.schema[query_id].dataType.simpleString()
    out: DataFrame | None = None
    for ids, matrix in query_blocks(queries, query_id, query_vec, components):
        shared = base.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            best = None
            for b in batches:
                if len(b):
                    best = _kept(k + 1, best, q @ _matrix(b.column(1).to_pylist()).T, np.array(b.column(0).to_pylist()))
            if best is not None:
                n = best[0].shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([i for i in qids for _ in range(n)]), pa.array(best[1].ravel().tolist()), pa.array(best[0].ravel())], names=["qid", "id", "cosine"])

        found = base.select(F.col(base_id).alias("id"), F.col(base_vec).alias("vec")).where("vec IS NOT NULL").mapInArrow(run, f"qid {qid_kind}, id {id_kind}, cosine double")
        out = found if out is None else out.union(found)
    if out is None:
        return base.sparkSession.createDataFrame([], f"qid {qid_kind}, id {id_kind}, cosine double, rank int")
    out = out.where("qid <> id") if exclude_same else out
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cosine"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


#: Pairs that one Arrow batch of ``cosine_blocks`` may hold.
BATCH_PAIRS = 200_000


def cosine_blocks(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_vec: str, right_vec: str) -> DataFrame:
    """left_id, right_id, cosine for every pair, as ``cosine_matrix`` gives them: the left rows go out in blocks as in ``top_k``, each task
    multiplies its right rows with a block, and nothing is shuffled. Vectors are of one length; with a null one the cosine is 0."""
    ship(right.sparkSession)
    kinds = left.schema[left_id].dataType.simpleString(), right.schema[right_id].dataType.simpleString()
    schema = f"left_id {kinds[0]}, right_id {kinds[1]}, cosine double"
    zero = [0.0] * (left.agg(F.max(F.size(left_vec))).first()[0] or 0)
    filled = left.select(F.col(left_id).alias("id"), F.coalesce(F.col(left_vec).cast("array<double>"), F.array(*map(F.lit, zero)).cast("array<double>")).alias("vec"))
    out: DataFrame | None = None
    for ids, matrix in query_blocks(filled, "id", "vec"):
        shared = right.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lids, q = shared.value
            step = max(1, BATCH_PAIRS // len(lids))
            for b in batches:
                for at in range(0, len(b), step):
                    part = b.slice(at, step)
                    scores = _matrix([x if x is not None else zero for x in part.column(1).to_pylist()]) @ q.T
                    own = part.column(0).take(pa.array(np.repeat(np.arange(len(part)), len(lids))))
                    yield pa.RecordBatch.from_arrays([pa.array(lids * len(part)), own, pa.array(scores.ravel())], names=["left_id", "right_id", "cosine"])

        found = right.select(F.col(right_id).alias("id"), F.col(right_vec).alias("vec")).mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return right.sparkSession.createDataFrame([], schema) if out is None else out


def maxsim_scores(candidates: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, qid: str = "qid", doc_id: str = "doc_id") -> DataFrame:
    """qid, doc_id, score by joins and aggregates only. ``query_vectors``: qid, pos, vec; ``doc_vectors``: doc_id, pos, vec.
    The pairs of a candidate's vectors are maximised by query position, then summed; both have partial sums."""
    q = query_vectors.select(F.col(qid).alias("qid"), F.col("pos").alias("q_pos"), F.col("vec").alias("q"))
    d = doc_vectors.select(F.col(doc_id).alias("doc_id"), F.col("vec").alias("d"))
    pairs = candidates.select(F.col(qid).alias("qid"), F.col(doc_id).alias("doc_id")).join(q, "qid").join(d, "doc_id")
    best = pairs.withColumn("s", v.dot("q", "d")).groupBy("qid", "doc_id", "q_pos").agg(F.max(F.when(~F.isnan("s"), F.col("s"))).alias("best"))
    return best.groupBy("qid", "doc_id").agg(F.sum(F.coalesce("best", F.lit(0.0))).alias("score"))


def ranked(scores: DataFrame, top_n: int | Column | None = None, qid: str = "qid", score: str = "score", index: str = "doc_id") -> DataFrame:
    """Adds ``rank`` within each query: score descending, index ascending; at most ``top_n`` rows a query."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc(score), index)))
    return out if top_n is None else out.where(F.col("rank") <= top_n)


def _shared_queries(query_vectors: DataFrame, components: int) -> dict | None:
    """qid to its matrix, or None where the queries hold more than ``components`` numbers or repeat an id; one pass, which stops there."""
    out, left = {}, components
    for qid, vectors in query_vectors.select("qid", "vectors").where("qid IS NOT NULL").toLocalIterator():
        left -= sum(map(len, vectors or ())) + 1
        if left < 0 or qid in out:
            return None
        out[qid] = np.array(vectors or (), np.float32)
    return out


def rerank(candidates: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame, top_n: int | None = None, share_queries: bool = False, components: int = BLOCK_COMPONENTS) -> DataFrame:
    """qid, doc_id, score, rank from ``candidates`` (qid, doc_id), ``query_vectors`` (qid, vectors) and ``doc_vectors``
    (doc_id, vectors). With ``share_queries``, queries of at most ``components`` numbers (read here to be counted) are broadcast: a
    document's vectors then travel once, with the ids of its queries, and a query meets a batch's documents in products of many. Otherwise
    nested vectors of both sides travel once a candidate, and each pair is one product."""
    ship(candidates.sparkSession)
    queries = _shared_queries(query_vectors, components) if share_queries else None
    if queries is not None:
        return ranked(_scores_by_document(candidates, queries, doc_vectors), top_n)
    both = candidates.select("qid", "doc_id").join(query_vectors.select("qid", F.col("vectors").alias("q")), "qid").join(doc_vectors.select("doc_id", F.col("vectors").alias("d")), "doc_id")
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            qs, ds = b.column(2).to_pylist(), b.column(3).to_pylist()
            scores = [nn.maxsim(np.array(q, np.float32), np.array(d, np.float32)) if q and d else 0.0 for q, d in zip(qs, ds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float32())], names=["qid", "doc_id", "score"])

    return ranked(both.select("qid", "doc_id", "q", "d").mapInArrow(run, f"qid {kinds['qid']}, doc_id {kinds['doc_id']}, score float"), top_n)


def _scores_by_document(candidates: DataFrame, queries: dict, doc_vectors: DataFrame) -> DataFrame:
    """qid, doc_id, score of the candidates of known queries; a document's list of queries is no longer than ``queries``, unless pairs repeat."""
    shared = candidates.sparkSession.sparkContext.broadcast(queries)
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    wanted = candidates.groupBy("doc_id").agg(F.collect_list("qid").alias("qids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            docs = [np.array(d or (), np.float32) for d in b.column(2).to_pylist()]
            rows: dict = {}
            for i, qids in enumerate(b.column(1).to_pylist()):
                for qid in qids:
                    if qid in known:
                        rows.setdefault(qid, []).append(i)
            for qid, at in rows.items():
                scores, full = np.zeros(len(at), np.float32), [k for k, i in enumerate(at) if len(docs[i])]
                if len(known[qid]) and full:
                    scores[full] = nn.maxsim_batch(known[qid], [docs[at[k]] for k in full])
                yield pa.RecordBatch.from_arrays([pa.array([qid] * len(at), b.schema.field(1).type.value_type), b.column(0).take(pa.array(at)), pa.array(scores)], names=["qid", "doc_id", "score"])

    both = wanted.join(doc_vectors.select("doc_id", "vectors"), "doc_id").select("doc_id", "qids", "vectors")
    return both.mapInArrow(run, f"qid {kinds['qid']}, doc_id {kinds['doc_id']}, score float")


def pool_groups(df: DataFrame, keys: list[str], vec: str, mode: str = "mean", position: str | None = None) -> DataFrame:
    """keys, vec: the mean of each group's vectors, or the first or last by ``position``. Means go by (group, component), with partial sums."""
    if mode != "mean":
        pick = F.max_by if mode == "last" else F.min_by
        return df.groupBy(*keys).agg(pick(vec, position).alias("vec"))
    parts = df.select(*keys, F.posexplode(vec).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("vec"))


def span_means(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """key, span, vec: means over spans by a join of spans (key, span, start, n_tokens) with positions (key, pos, vec)."""
    at = spans.select(key, "span", F.explode(F.sequence("start", F.col("start") + F.col("n_tokens") - 1)).alias("pos"))
    return pool_groups(at.join(tokens.select(key, "pos", "vec"), [key, "pos"]), [key, "span"], "vec")
