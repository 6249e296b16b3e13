from __future__ import annotations

import math
import time

import numpy as np
import pytest

from vectorloom.nn import kernels as k
from vectorloom.nn.config import ConfigError, read_config
from vectorloom.nn.fixtures import write_model
from vectorloom.nn.model import Model, ModelError, maxsim, maxsim_batch, pool_spans
from vectorloom.sources import safetensors as st


@pytest.mark.parametrize("kind", ["base", "qwen3", "qwen2", "bert", "xlm-roberta"])
def test_batch_equals_single(tmp_path, kind):
    m = Model(write_model(tmp_path / kind, kind, tokenizer="none"))
    a, b = [1, 2, 3, 15], [4, 15]
    both = m.embed([a, b])
    assert np.allclose(both, np.concatenate([m.embed([a]), m.embed([b])]), atol=1e-5)
    assert not np.allclose(m.embed([a]), m.embed([[1, 2, 4, 15]]))
    with pytest.raises(ModelError):
        m.embed([[99]])


@pytest.mark.parametrize("dtype", ["F32", "F16"])
def test_storage_types_agree(tmp_path, dtype):
    ids = [[i % 14 + 1 for i in range(24)]]
    a, b = (Model(write_model(tmp_path / t, "qwen3", "none", t)).embed(ids) for t in ("BF16", dtype))
    assert np.allclose(a, b, atol=2e-3 if dtype == "F16" else 2e-5)


def test_prefixes_and_families(tmp_path):
    m = Model(write_model(tmp_path / "x", "xlm-roberta", "none", prefix="roberta."))
    assert m.prefix == "roberta." and m.config.position_offset == 2 and m.config.encoder
    q = read_config(write_model(tmp_path / "q", "qwen3", "none"))
    assert (q.causal, q.pooling, q.normalize, q.append_terminal) == (True, "last", True, True)
    (tmp_path / "q" / "1_Pooling").mkdir()
    (tmp_path / "q" / "1_Pooling" / "config.json").write_text('{"pooling_mode_max_tokens": true}')
    with pytest.raises(ConfigError):
        read_config(tmp_path / "q")
    (tmp_path / "q" / "1_Pooling" / "config.json").write_text('{"pooling_mode_cls_token": true}')
    (tmp_path / "q" / "modules.json").write_text("[]")
    (tmp_path / "q" / "tokenizer_config.json").write_text('{"add_eos_token": false}')
    q = read_config(tmp_path / "q")
    assert (q.pooling, q.normalize, q.append_terminal) == ("cls", False, False)
    with pytest.raises(ConfigError):
        read_config(write_model(tmp_path / "odd", "base", "none", config={"head_dim": 3}))


def test_spans(tmp_path):
    m = Model(write_model(tmp_path / "m", "base", "none"))
    ids = [1, 2, 3, 4]
    whole = m.embed_spans([ids], [[(0, 4)]])[0]
    assert np.allclose(whole, m.embed([ids]), atol=1e-6)
    halves = m.embed_spans([ids, ids], [[(0, 2), (2, 2)], [(0, 4)]])
    assert np.allclose(halves[0].mean(0), whole[0], atol=1e-6)
    for bad in ((0, 0), (3, 2), (-1, 1)):
        with pytest.raises(ModelError):
            pool_spans(np.ones((4, 2), np.float32), [bad])


def test_late(tmp_path):
    m = Model(write_model(tmp_path / "m", "base", "none", late_dim=6))
    v = m.late_tokens([[1, 2, 3]], [[0, 2]])[0]
    assert v.shape == (2, 6) and np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-6)
    q, d = np.array([[1, 0], [0, 1]], np.float32), np.array([[1, 0], [0, -1]], np.float32)
    assert maxsim(q, d) == 1.0 and maxsim(q[:0], d) == 0.0
    rng = np.random.default_rng(1)
    q, docs = rng.normal(size=(3, 4)), [rng.normal(size=(n, 4)) for n in (4100, 10, 3)]
    assert np.allclose(maxsim_batch(q, docs), [maxsim(q, d) for d in docs], atol=1e-4)


def test_kernels():
    assert np.allclose(k.gelu(np.array([1.0, -1.0])), [0.841344746, -0.158655254], atol=1e-6)
    assert np.allclose(k.gelu(np.array([1.0, -1.0]), True), [0.841191991, -0.158808009], atol=1e-6)
    rng = np.random.default_rng(0)
    q, kv = rng.normal(size=(600, 4, 8)).astype(np.float32), rng.normal(size=(600, 2, 8)).astype(np.float32)
    for causal in (False, True):
        got = k.attention(q, kv, kv, [500, 100], causal)
        for i in (0, 3, 499, 500, 599):
            lo, hi = (0, 500) if i < 500 else (500, 600)
            keys = kv[lo : i + 1 if causal else hi]
            for h in range(4):
                w = k.softmax(keys[:, h // 2] @ q[i, h] / np.sqrt(8))
                assert np.allclose(got[i, h], w @ keys[:, h // 2], atol=1e-5)


def test_safetensors(tmp_path, spark):
    at = write_model(tmp_path / "m", "base", "none", "F32")
    assert st.payload_bytes(at) == sum(t.end - t.start for t in st.tensors(at).values())
    spark.dataSource.register(st.SafetensorsSource)
    rows = spark.read.format("safetensors").load(str(at)).collect()
    assert {r.name for r in rows} == set(st.tensors(at))
    st.convert_bf16(at, tmp_path / "b")
    assert np.allclose(Model(tmp_path / "b").embed([[1, 2]]), Model(at).embed([[1, 2]]), atol=1e-5)
    for name, data in (("short", b"1234"), ("long", (99).to_bytes(8, "little") + b"{}")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(st.SafetensorsError):
            st.read_directory(tmp_path / name)
    shards = tmp_path / "s"
    shards.mkdir()
    (shards / "model-00001-of-00002.safetensors").write_bytes(b"")
    with pytest.raises(st.SafetensorsError):
        st.shards(shards)


def plain_states(m, ids):
    """Hidden states of one sequence in double precision, head by head and position by position."""
    c, w = m.config, lambda name: m.tensors[m.prefix + name].read().astype(np.float64)
    n, d = len(ids), c.head_dim

    def attend(q, key, value):
        out = np.zeros_like(q)
        for i in range(n):
            for h in range(c.heads):
                g = h * c.kv_heads // c.heads
                seen = range(i + 1) if c.causal else range(n)
                e = np.exp([q[i, h] @ key[j, g] / np.sqrt(d) for j in seen])
                out[i, h] = sum(a * value[j, g] for a, j in zip(e / e.sum(), seen, strict=True))
        return out.reshape(n, -1)

    if c.encoder:
        lin = lambda x, name: x @ w(f"{name}.weight").T + w(f"{name}.bias")
        ln = lambda x, name: (x - x.mean(1)[:, None]) / np.sqrt(x.var(1)[:, None] + c.ln_eps) * w(f"{name}.weight") + w(f"{name}.bias")
        x = np.stack([w("embeddings.word_embeddings.weight")[t] + w("embeddings.position_embeddings.weight")[p + c.position_offset] for p, t in enumerate(ids)])
        x = ln(x + w("embeddings.token_type_embeddings.weight")[0], "embeddings.LayerNorm")
        for k_ in range(c.layers):
            p = f"encoder.layer.{k_}."
            q, key, value = (lin(x, f"{p}attention.self.{s}").reshape(n, c.heads, d) for s in ("query", "key", "value"))
            x = ln(x + lin(attend(q, key, value), f"{p}attention.output.dense"), f"{p}attention.output.LayerNorm")
            y = lin(x, f"{p}intermediate.dense")
            y = y / 2 * (1 + np.vectorize(math.erf)(y / math.sqrt(2)))
            x = ln(x + lin(y, f"{p}output.dense"), f"{p}output.LayerNorm")
        return x
    rms = lambda x, weight: x / np.sqrt((x * x).mean(-1)[..., None] + c.rms_eps) * weight

    def turned(x):
        """Components k and k + d / 2 of a head as complex numbers, turned by position times theta ** (-2 k / d)."""
        z = x[..., : d // 2] + 1j * x[..., d // 2 :]
        z = z * np.exp(1j * np.outer(np.arange(n), c.rope_theta ** (-np.arange(d // 2) * 2 / d)))[:, None]
        return np.concatenate([z.real, z.imag], -1)

    x = w("embed_tokens.weight")[ids]
    for k_ in range(c.layers):
        p, sides = f"layers.{k_}.", []
        y = rms(x, w(f"{p}input_layernorm.weight"))
        for s, heads in (("q", c.heads), ("k", c.kv_heads), ("v", c.kv_heads)):
            z = y @ w(f"{p}self_attn.{s}_proj.weight").T + (w(f"{p}self_attn.{s}_proj.bias") if c.qkv_bias else 0)
            z = z.reshape(n, heads, d)
            if s != "v":
                z = turned(rms(z, w(f"{p}self_attn.{s}_norm.weight")) if c.qk_norm else z)
            sides.append(z)
        x = x + attend(*sides) @ w(f"{p}self_attn.o_proj.weight").T
        y = rms(x, w(f"{p}post_attention_layernorm.weight"))
        gate = y @ w(f"{p}mlp.gate_proj.weight").T
        x = x + (gate / (1 + np.exp(-gate)) * (y @ w(f"{p}mlp.up_proj.weight").T)) @ w(f"{p}mlp.down_proj.weight").T
    return rms(x, w("norm.weight"))


@pytest.mark.parametrize("kind", ["base", "qwen3", "qwen2", "bert", "xlm-roberta"])
def test_states_against_plain_formulas(tmp_path, kind):
    m = Model(write_model(tmp_path / kind, kind, "none", "F32", hidden=16, heads=4, layers=2, intermediate=24))
    rows = [[1, 2, 3, 15, 7, 9, 2], [4], [5, 5, 6]]
    got, start = m.states(rows), 0
    for ids in rows:
        want = plain_states(m, ids)
        assert np.allclose(got[start : start + len(ids)], want, atol=5e-5)
        pooled = {"last": want[-1], "cls": want[0], "mean": want.mean(0)}[m.config.pooling]
        assert np.allclose(m.embed([ids])[0], pooled / np.linalg.norm(pooled) if m.config.normalize else pooled, atol=5e-5)
        start += len(ids)


@pytest.mark.parametrize("causal", [True, False])
@pytest.mark.parametrize("size", [1.0, 40.0])
def test_attention_in_tiles(causal, size):
    """Tiles of queries and keys, with and without a shift of the scores, against the plain formula; one query a sequence alike."""
    rng = np.random.default_rng(9)
    lengths = [1, 700, 127, 2, 1100]
    q, key, val = (rng.normal(size=(sum(lengths), h, 16)).astype(np.float32) for h in (4, 2, 2))
    q = q * np.float32(size)
    got, start = k.attention(q, key, val, lengths, causal), 0
    ends = np.cumsum(lengths) - 1
    for n in lengths:
        for h in range(4):
            s = slice(start, start + n)
            w = q[s, h].astype(np.float64) @ key[s, h // 2].T.astype(np.float64) / 4
            w = np.where(np.tri(n, dtype=bool), w, -np.inf) if causal else w
            w = np.exp(w - w.max(1, keepdims=True))
            assert np.abs(got[s, h] - w / w.sum(1, keepdims=True) @ val[s, h // 2]).max() < 5e-5
        start += n
    assert np.abs(k.attention_of(q[ends], key, val, lengths, lengths) - got[ends]).max() < 5e-5


def test_attention_needs_a_tile_of_memory():
    import tracemalloc

    x = np.random.default_rng(1).normal(size=(8192, 2, 16)).astype(np.float32)
    tracemalloc.start()
    k.attention(x, x[:, :1], x[:, :1], [len(x)], True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


@pytest.mark.parametrize("kind", ["qwen3", "base", "bert"])
def test_states_of_one_position(tmp_path, kind):
    """A pooled position's state alone, where the last block skips the others, is the one among all."""
    m = Model(write_model(tmp_path / kind, kind, hidden=16, heads=4, layers=3, intermediate=24))
    rows = [[1, 2, 3, 4, 5], [6], [7, 8]]
    every, ends = m.states(rows), np.cumsum([len(r) for r in rows])
    assert np.abs(m.states(rows, "last") - every[ends - 1]).max() < 1e-5
    assert np.abs(m.states(rows, "cls") - every[ends - [len(r) for r in rows]]).max() < 1e-5


def test_attention_of_large_scores_is_not_slow():
    """Exponentials far below the largest one of their row were subnormal, which made products some twenty times slower."""
    rng = np.random.default_rng(5)
    q, key, val = (rng.normal(size=(1200, n, 16)).astype(np.float32) for n in (4, 2, 2))

    def seconds(x):
        times = []
        for _ in range(3):
            start = time.process_time()
            k.attention(x, key, val, [len(x)], False)
            times.append(time.process_time() - start)
        return min(times)

    assert seconds(q * 30) < 8 * seconds(q)
    scores = np.einsum("ihd,jhd->hij", q.astype(float) * 30 / 4, key.astype(float).repeat(2, axis=1))
    weights = np.exp(scores - scores.max(axis=2, keepdims=True))
    right = np.einsum("hij,jhd->ihd", weights / weights.sum(axis=2, keepdims=True), val.repeat(2, axis=1))
    assert np.abs(k.attention(q * 30, key, val, [len(q)], False) - right).max() < 2e-4


def test_first_block_projects_distinct_tokens(tmp_path, monkeypatch):
    """The first block's queries, keys and values are made once for each token of the vocabulary, not for each position."""
    m = Model(write_model(tmp_path / "m", "qwen3", "none", layers=2))
    seen, linear = [], k.linear
    monkeypatch.setattr(k, "linear", lambda x, weight, bias=None: seen.append((id(weight), len(x))) or linear(x, weight, bias))
    rows = [[1, 2, 3, 2, 1, 3] * 20, [3, 1, 1]]
    both = m.embed(rows)
    assert {n for w, n in seen for s in "qkv" if w == id(m.w(f"layers.0.self_attn.{s}_proj.weight"))} == {3}
    assert np.allclose(both, np.concatenate([m.embed([r]) for r in rows]), atol=1e-5)


@pytest.mark.parametrize(("heads", "d"), [(2, 8), (40, 64)])
def test_turns_start_anew_with_each_sequence(heads, d):
    """In slices, with a table as wide as the heads or one head's where that would be large, the same floats as one position at a time."""
    lengths = [1, 5, k.SLICE + 3, 2]
    x = np.random.default_rng(0).normal(size=(sum(lengths), heads, d)).astype(np.float32)
    at = np.concatenate([np.arange(n) for n in lengths])
    angle = at[:, None, None] * 10000.0 ** (-2 * np.arange(d // 2) / d)
    c, s, a, b = np.cos(angle).astype(np.float32), np.sin(angle).astype(np.float32), x[..., : d // 2], x[..., d // 2 :]
    plain = np.concatenate([a * c - b * s, b * c + a * s], axis=-1)
    assert np.array_equal(k.rope(x, lengths, 10000.0), plain) and np.array_equal(k.rope(x, lengths, 10000.0, at), plain)
