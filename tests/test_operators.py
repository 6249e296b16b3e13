from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions import stats
from vectorloom.functions import vectors as v
from vectorloom.nn.fixtures import write_model
from vectorloom.operators import embedding as E
from vectorloom.operators import similarity as S
from vectorloom.operators.batching import packed
from vectorloom.operators.registry import ModelRegistry, SpecError, inspect, parse_spec
from vectorloom.plans import catalog, serve
from vectorloom.sources import text as T
from vectorloom.streaming.texts import embed_files


def one(spark, vec, expr):
    return spark.createDataFrame([([float(x) for x in vec],)], "a array<float>").select(expr.alias("x")).first().x


def test_vector_functions(spark):
    assert one(spark, [0.0, 0.5, -0.5, 100.0], v.int8_quantize("a")) == [0, 59, -59, 127]
    assert bytes(one(spark, [1.0, -1, 1, -1, -1, -1, -1, 1], v.sign_bits("a"))) == b"\x85"
    assert bytes(one(spark, [0.0, -0.0] * 4, v.sign_bits("a"))) == b"\xff"
    assert bytes(one(spark, [float("nan")] * 8, v.sign_bits("a"))) == b"\x00"
    assert one(spark, [0.5], v.int8_float_view("a")) == [0.4609375]
    assert one(spark, [1e19], v.cosine_similarity("a", "a")) == pytest.approx(1)
    assert one(spark, [0.0, 0.0], v.cosine_similarity("a", "a")) == 0
    assert one(spark, [0.0, 0.0], v.l2_normalize("a")) is None
    assert one(spark, [0.1] * 100, v.encode("a", "base64")).count("\n") == 0
    assert one(spark, [3.0, 4.0, 5.0], v.matryoshka("a", 2, 3, True, True)) == pytest.approx([0.6, 0.8])
    assert one(spark, [3.0, 4.0, 5.0], v.matryoshka("a", 2, 3, True, False)) == [3, 4]
    assert sum(one(spark, [1.0, 2.0], v.softmax("a"))) == pytest.approx(1)
    assert one(spark, [1.0, -1.0], v.gelu_tanh("a")) == pytest.approx([0.841191991, -0.158808009])


def test_rounding_keeps_signs_and_goes_by_products(spark):
    cases = [(-1e-8, "-0.0"), (-0.0, "-0.0"), (5e-7, "1e-06"), (-2.5e-6, "-3e-06"), (1.5e-6, "2e-06"), (4e-7, "0.0"), (1e305, "1e+305"), (float("inf"), "inf"), (float("nan"), "nan"), (0.123456499, "0.123456")]
    got = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x double").select("i", v.rounded("x", 6).alias("x")).collect()
    assert [repr(r.x) for r in sorted(got)] == [w for _, w in cases]


def test_maxsim_forms_agree(spark):
    rng = np.random.default_rng(3)
    q, d = rng.normal(size=(3, 4)).tolist(), rng.normal(size=(5, 4)).tolist()
    df = spark.createDataFrame([(q, d)], "q array<array<double>>, d array<array<double>>")
    want = float((np.array(q) @ np.array(d).T).max(1).sum())
    assert df.select(v.maxsim("q", "d")).first()[0] == pytest.approx(want)
    qs = spark.createDataFrame([(1, i, x) for i, x in enumerate(q)], "qid int, pos int, vec array<double>")
    ds = spark.createDataFrame([(7, i, x) for i, x in enumerate(d)], "doc_id int, pos int, vec array<double>")
    pair = spark.createDataFrame([(1, 7)], "qid int, doc_id int")
    assert S.maxsim_scores(pair, qs, ds).first().score == pytest.approx(want)
    nested = S.rerank(pair, spark.createDataFrame([(1, q)], "qid int, vectors array<array<float>>"), spark.createDataFrame([(7, d)], "doc_id int, vectors array<array<float>>"))
    assert nested.first().score == pytest.approx(want, abs=1e-4)


def test_rerank_with_shared_queries(spark):
    rng = np.random.default_rng(6)
    qs = [(i, rng.normal(size=(i % 3, 4)).tolist()) for i in range(6)]
    ds = [(f"d{i}", rng.normal(size=(i % 4, 4)).tolist()) for i in range(30)]
    q = spark.createDataFrame(qs, "qid int, vectors array<array<float>>")
    d = spark.createDataFrame([*ds, ("none", None)], "doc_id string, vectors array<array<float>>").repartition(3)
    pairs = spark.createDataFrame([*((i, k) for i, _ in qs for k, _ in ds), (1, "none"), (1, "absent"), (9, "d1"), (None, "d1")], "qid int, doc_id string")
    plain = sorted(S.rerank(pairs, q, d).collect(), key=lambda r: (r.qid, r["rank"]))
    assert len(plain) == 181
    for components in (1 << 20, 3):
        got = sorted(S.rerank(pairs, q, d, share_queries=True, components=components).collect(), key=lambda r: (r.qid, r["rank"]))
        assert [(r.qid, r.doc_id) for r in got] == [(r.qid, r.doc_id) for r in plain]
        assert np.allclose([r.score for r in got], [r.score for r in plain], atol=1e-4)
    assert S._shared_queries(q, 3) is None and S._shared_queries(q.union(q), 1 << 20) is None


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<float>").repartition(4)
    assert len(list(S.query_blocks(df.where("id < 5"), "id", "vec", 16))) == 3
    for block in (16, 1 << 20):
        got = {(r.qid, r["rank"]): r.id for r in S.top_k(df.where("id < 5"), df, 3, "id", "vec", "id", "vec", exclude_same=True, components=block).collect()}
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        for q in range(5):
            order = [i for i in np.argsort(-(u @ u[q])) if i != q][:3]
            assert [got[q, r] for r in (1, 2, 3)] == order


def test_kept_of_batches_with_ties():
    rng = np.random.default_rng(9)
    scores = rng.integers(0, 4, (3, 200)) / 4
    ids = rng.permutation(200)
    best = None
    for at in range(0, 200, 40):
        best = S._kept(5, best, scores[:, at : at + 40], ids[at : at + 40])
    for q in range(3):
        assert best[1][q].tolist() == [i for _, i in sorted(zip(-scores[q], ids.tolist()))][:5]


def test_packing():
    assert list(packed([600, 300, 200], max_tokens=1000)) == [[2, 1], [0]]
    assert list(packed([5, 1, 1], max_rows=2)) == [[1, 2], [0]]
    assert list(packed([2000], max_tokens=1000)) == [[0]]


def test_specs(tmp_path):
    assert parse_spec("a=/m:api=perplexity:min_dim=8:query=x: \\n") == {"label": "a", "directory": "/m", "api": "perplexity", "min_dim": 8, "query": "x: \n"}
    for bad in ("", "a", "a=", "=b", "a=/m:api=z", "a=/m:min_dim=-1"):
        with pytest.raises(SpecError):
            parse_spec(bad)
    r = ModelRegistry()
    at = write_model(tmp_path / "m", late_dim=2)
    r.register("a", at)
    with pytest.raises(SpecError):
        r.register("a", at)
    with pytest.raises(SpecError):
        r.register("b", at, min_dim=99)
    assert inspect(at) == {"tokenizer": "bpe", "weights": "single", "kind": "late", "pipeline": "plain"}


def test_embedding_isolates_bad_rows(spark):
    m = catalog.models(spark).models["embed"]
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "hello")], "id int, text string")
    rows = {r.id: r for r in E.embed(df, ["id"], "text", m).collect()}
    assert rows[2].error and rows[3].error and rows[2].embedding is None
    assert np.linalg.norm(rows[1].embedding) == pytest.approx(1, abs=1e-5)
    alone = E.embed(df.where("id = 4"), ["id"], "text", m).first().embedding
    assert np.allclose(alone, rows[4].embedding, atol=5e-5)
    again = {r.id: r.embedding for r in E.embed_distinct(df, ["id"], "text", m).collect()}
    assert np.allclose(again[1], rows[1].embedding, atol=5e-5)


def test_copies_are_run_once(tmp_path, monkeypatch):
    """Of equal texts, in a batch or in later ones of the worker, the model sees one; each row has its answer."""
    r = ModelRegistry()
    r.register("a", write_model(tmp_path / "m"))
    work, ran, embed = E._pooled(r.models["a"], None, True), [], E.nn.Model.embed
    monkeypatch.setattr(E.nn.Model, "embed", lambda m, rows: ran.extend(rows) or embed(m, rows))
    texts = ["hello", "world", "hello", "", None, "hello"]
    first = work(texts)
    assert len(ran) == 2 and first["n_tokens"] == [len(r.models["a"].tokenizer().encode(t)) if t else None for t in texts]
    assert np.array_equal(first["embedding"][0], first["embedding"][5]) and not np.array_equal(first["embedding"][0], first["embedding"][1])
    assert [e is not None for e in first["error"]] == [not t for t in texts]
    again = work(["world", "held", "hello"])
    assert len(ran) == 3 and np.array_equal(again["embedding"][0], first["embedding"][1]) and np.array_equal(again["embedding"][2], first["embedding"][0])
    monkeypatch.setattr(E, "KEPT", 1)
    little = E._pooled(r.models["a"], None, True)
    assert [np.array_equal(a, b) for a, b in zip(little(texts)["embedding"][:2], first["embedding"])] == [True, True] and len(E._answered(r.models["a"].directory, True, r.models["a"].token_cap, r.models["a"].keep_tail, None, True)) == 1


def test_contextual(spark):
    m = catalog.models(spark).models["context"]
    df = spark.createDataFrame([(1, 0, "hello"), (1, 1, "world"), (2, 0, "held"), (3, 0, "x"), (3, 1, "")], "doc int, i int, text string")
    rows = {(r.doc, r.i): r for r in E.embed_chunks(df, "doc", "i", "text", m).collect()}
    assert len(rows) == 5 and rows[3, 0].error and rows[3, 1].error
    lone = E.embed(df.where("doc = 2"), ["doc"], "text", m).first().embedding
    assert np.allclose(rows[2, 0].embedding, lone, atol=1e-4)
    neighbour = E.embed(df.where("doc = 1 AND i = 1"), ["doc"], "text", m).first().embedding
    assert np.abs(np.array(rows[1, 1].embedding) - neighbour).max() > 1e-4


def ask(spark, route, **body):
    df = spark.createDataFrame([(1, json.dumps(body))], "request_id int, body string")
    r = getattr(serve, route)(df, catalog.models(spark)).first()
    return r.status, json.loads(r.response)


def test_served_embeddings(spark):
    status, out = ask(spark, "embeddings", model="embed", input=["hello", "world"])
    assert status == 200 and [d["index"] for d in out["data"]] == [0, 1] and out["usage"]["total_tokens"] > 0
    query = ask(spark, "embeddings", model="embed", input="hello", text_type="query")[1]["data"][0]["embedding"]
    manual = ask(spark, "embeddings", model="embed", input="query: hello")[1]["data"][0]["embedding"]
    assert np.allclose(query, manual, atol=1e-6)
    short = ask(spark, "embeddings", model="embed", input="hello", dimensions=16)[1]["data"][0]["embedding"]
    assert len(short) == 16 and np.linalg.norm(short) == pytest.approx(1, abs=1e-5)
    native = ask(spark, "embeddings", model="native", input="hello")[1]["data"][0]["embedding"]
    assert isinstance(native, str)


@pytest.mark.parametrize(("body", "loc", "kind"), [
    ({"input": "x"}, ["body", "model"], "missing"),
    ({"model": 3, "input": "x"}, ["body", "model"], "type_error.string"),
    ({"model": "late", "input": "x"}, ["body", "model"], "enum"),
    ({"model": "embed"}, ["body", "input"], "missing"),
    ({"model": "embed", "input": ["a", ""]}, ["body", "input", 1], "value_error.empty"),
    ({"model": "embed", "input": [3]}, ["body", "input", 0], "type_error.string"),
    ({"model": "embed", "input": "x", "dimensions": 5.5}, ["body", "dimensions"], "type_error.integer"),
    ({"model": "embed", "input": "x", "dimensions": 4}, ["body", "dimensions"], "value_error.range"),
    ({"model": "native", "input": "x", "text_type": "query"}, ["body", "text_type"], "extra_fields"),
])
def test_refusals(spark, body, loc, kind):
    status, out = ask(spark, "embeddings", **body)
    assert status == 422 and [(e["loc"], e["type"]) for e in out["detail"]] == [(loc, kind)]


def test_served_contextual_and_rerank(spark):
    status, out = ask(spark, "contextual", model="context", input=[["hello", "world"], ["held"]])
    assert status == 200 and [len(d["data"]) for d in out["data"]] == [2, 1] and out["usage"]["total_tokens"] > 0
    assert ask(spark, "contextual", model="context", input=[[]])[0] == 422
    status, out = ask(spark, "rerank", model="late", query="hello", documents=["hello", "world", "held"], top_n=2, return_documents=True)
    assert status == 200 and len(out["results"]) == 2 and out["usage"]["query_tokens"] == 32
    assert out["results"][0]["relevance_score"] >= out["results"][1]["relevance_score"] and out["results"][0]["document"]
    status, out = ask(spark, "rerank", model="late", query="", documents=[], top_n=1, top_k=1)
    assert status == 422 and {e["type"] for e in out["detail"]} == {"value_error.empty", "value_error.list.min_items", "value_error.conflict", "value_error.range"}


def test_stats(spark, monkeypatch):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3)] + [("b", float(x)) for x in (4, 5, 6)], "s string, x double").withColumn("k", F.lit(1))
    assert stats.mann_whitney(df, ["k"], "s", "x", "a").first().u == 0
    assert stats.summary(df, ["k"], "x", (0.5,)).first().p50 == 3.5
    assert stats.nearest_rank(df, ["k"], "x", 0.5).first().value == 3
    rng = np.random.default_rng(4)
    rows = [(k, "ab"[int(rng.integers(2))], float(x)) for k, n in (("p", 3000), (None, 500), ("q", 1)) for x in np.round(rng.exponential(size=n), 2)]
    skewed = spark.createDataFrame([*rows, ("p", "a", None), ("empty", "a", None)], "k string, s string, x double").repartition(4)
    for most in (1000, 1):  # sliced groups, and whole ones
        monkeypatch.setattr(stats, "MOST_GROUPS", most)
        got = {r.k: r for r in stats.summary(skewed, ["k"], "x", (0.5, 0.95), (0.9,)).collect()}
        tests = {r.k: r for r in stats.mann_whitney(skewed, ["k"], "s", "x", "a").collect()}
        assert got["empty"].n == 0 and got["empty"].p50 is None and "empty" not in tests
        for k in ("p", None, "q"):
            x = np.array([v for g, _, v in rows if g == k])
            assert (got[k].n, got[k].min, got[k].max) == (len(x), x.min(), x.max()) and got[k].mean == pytest.approx(x.mean())
            assert (got[k].p50, got[k].p95) == pytest.approx(tuple(np.quantile(x, (0.5, 0.95)))) and got[k].rank90 == np.sort(x)[int(np.ceil(0.9 * len(x))) - 1]
            a, b = (np.array([v for g, s, v in rows if g == k and s == w]) for w in "ab")
            assert tests[k].n1 == len(a) and tests[k].u == (a[:, None] > b).sum() + (a[:, None] == b).sum() / 2
    same = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [1], [1])], "a array<double>, b array<double>, p array<int>, q array<int>")
    assert stats.drift(same, "a", "b", "p", "q").first() == (0.0, 1.0, 0.0)


def test_text_sinks_and_stream(spark, tmp_path):
    assert [r.text for r in T.arguments(spark, ["a", "--", "-b"]).collect()] == ["a", "-b"]
    m = catalog.models(spark).models["embed"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello\n\nworld\n")
    q = embed_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), m)
    q.awaitTermination()
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(rows) == 2 and all(len(r["embedding"]) == r["dim"] == 64 for r in rows)
    line = spark.createDataFrame([([0.5, 1.0],)], "v array<float>").select(T.plain("v")).first()[0]
    assert line == "0.50000000 1.00000000"


@pytest.mark.parametrize("route, body", [(serve.embeddings, '{"model": "native", "input": ["hello", "held"]}'), (serve.contextual, '{"model": "context", "input": [["hello", "world"], ["held"]]}')])
def test_served_rows_meet_the_models_once(spark, route, body):
    """However many models there are, and for usage and errors as for answers, one stage runs them."""
    answers = route(spark.createDataFrame([(1, body)], "request_id int, body string"), catalog.models(spark))
    plan = answers._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("embedding#") and sum("MapInArrow run" in line and "error" in line and "embedding" in line for line in plan.splitlines()) == 1
    assert answers.first().status == 200


def test_served_bodies_are_checked_once(spark):
    """Refused requests go along with the others: nothing is parsed again for them, and each keeps its own answer, even beside others of its id."""
    good, none, empty = '{"model": "native", "input": ["hello", "held"]}', '{"model": "nobody", "input": "x"}', '{"model": "embed", "input": ""}'
    answers = serve.embeddings(spark.createDataFrame([(1, good), (1, none), (1, empty), (2, "x"), (None, none)], "request_id int, body string"), catalog.models(spark))
    assert answers._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    wrong = sorted((r.request_id or 0, json.loads(r.response)["detail"][0]["type"]) for r in answers.where("status = 422").collect())
    assert wrong == [(0, "enum"), (1, "enum"), (1, "value_error.empty"), (2, "value_error.json")]
    right = answers.where("status = 200").collect()
    assert [r.request_id for r in right] == [1] and len(json.loads(right[0].response)["data"]) == 2
