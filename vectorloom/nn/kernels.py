"""Array kernels in 32-bit floats."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from numpy.lib.introspect import opt_func_info

#: Scores of so many queries (of all heads, and of one) and keys are made at a time: 960 KB at most, in products small enough that BLAS copies nothing.
QUERY_TILE, HEAD_TILE, KEY_TILE = 512, 128, 352
#: Tokens that are turned at a time, and floats of a table of turns that has its columns for every head: 4 MB.
SLICE, WIDE_TURNS = 512, 1 << 20
#: Scores up to this size need no shift: exponentials and their sums over 2**30 keys stay within 32-bit floats' normal range.
PLAIN_SCORES = 60.0


def _exponential() -> tuple[np.ufunc, float]:
    """The faster of the exponentials in 32-bit floats on this machine, and the logarithm of e to its base. Either is right to 3e-7."""
    wide = opt_func_info(func_name="^exp2$", signature="float32").get("exp2", {}).values()
    return (np.exp2, float(np.log2(np.e))) if any("AVX512_SKX" in kind["current"] for kind in wide) else (np.exp, 1.0)


_EXP, _LOG_E = _exponential()


def rms_norm(x: np.ndarray, weight: np.ndarray, eps: float) -> np.ndarray:
    return x * (1 / np.sqrt(_squares(x) / np.float32(x.shape[-1]) + np.float32(eps)))[..., None] * weight


def layer_norm(x: np.ndarray, gamma: np.ndarray, beta: np.ndarray, eps: float) -> np.ndarray:
    centred = x - x.mean(axis=-1, keepdims=True)
    return centred / np.sqrt(np.mean(centred * centred, axis=-1, keepdims=True) + np.float32(eps)) * gamma + beta


def linear(x: np.ndarray, weight: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    y = x @ weight.T
    return y if bias is None else y + bias


def softmax(x: np.ndarray) -> np.ndarray:
    return softmax_inplace(x.copy())


def softmax_inplace(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def swiglu(gate: np.ndarray, up: np.ndarray) -> np.ndarray:
    y = np.exp(-gate)
    y += 1
    np.divide(gate, y, out=y)
    y *= up
    return y


def erf(x: np.ndarray) -> np.ndarray:
    """Error function to 1.5e-7 (Abramowitz and Stegun, 7.1.26)."""
    z = np.abs(x.astype(np.float64))
    t = 1 / (1 + 0.3275911 * z)
    y = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return np.copysign(y, x)


def gelu(x: np.ndarray, tanh: bool = False) -> np.ndarray:
    if tanh:
        return (0.5 * x * (1 + np.tanh(np.float32(0.7978845608028654) * (x + np.float32(0.044715) * x**3)))).astype(np.float32)
    return (0.5 * x * (1 + erf(x / np.sqrt(2.0)))).astype(np.float32)


@lru_cache(maxsize=16)
def _turns(n: int, head_dim: int, theta: float, heads: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and signed sines for the halves of a head, or of so many heads side by side."""
    angle = np.arange(n)[:, None] * theta ** (-2 * np.arange(head_dim // 2) / head_dim)
    cos, sin = np.cos(angle).astype(np.float32), np.sin(angle).astype(np.float32)
    return np.tile(np.hstack([cos, cos])[:, None], (1, heads, 1)), np.tile(np.hstack([-sin, sin])[:, None], (1, heads, 1))


def rope(x: np.ndarray, lengths: list[int], theta: float, at: np.ndarray | None = None) -> np.ndarray:
    """Rotate the halves of each head; x: [tokens, heads, head_dim]; positions start anew with each sequence, or are ``at``."""
    longest, (heads, d) = 1 << max(12, (max(lengths) - 1).bit_length()), x.shape[1:]
    cos, sin = _turns(longest, d, theta, heads if at is None and longest * heads * d <= WIDE_TURNS else 1)
    if at is not None:
        return x * cos[at] + np.roll(x, d // 2, axis=-1) * sin[at]
    out, swapped, start = np.empty_like(x), np.empty_like(x[:SLICE]), 0
    for n in lengths:
        for a in range(0, n, SLICE):
            m = min(SLICE, n - a)
            some, turned, other = (y[:m] for y in (x[start + a :], out[start + a :], swapped))
            other[..., : d // 2], other[..., d // 2 :] = some[..., d // 2 :], some[..., : d // 2]
            np.multiply(some, cos[a : a + m], out=turned)
            turned += np.multiply(other, sin[a : a + m], out=other)
        start += n
    return out


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, lengths: list[int], causal: bool) -> np.ndarray:
    """Grouped-query attention within each sequence of a packed batch; q: [tokens, heads, d], k and v: [tokens, kv heads, d].

    Scores are made in tiles that stay in the cache, so a long sequence needs memory for a tile only. Where no score can leave the range in
    which sums of exponentials are exact to rounding (by the longest query and key), none is shifted and one pass does; else each query's
    largest score is taken off first."""
    heads, groups, d = q.shape[1], k.shape[1], q.shape[2]
    each = heads // groups
    out, scale, start = np.empty_like(q), np.float32(_LOG_E / np.sqrt(d)), 0
    tile = max(1, min(HEAD_TILE, QUERY_TILE // each))
    at_once = max(1, min(groups, QUERY_TILE // (each * tile)))
    ones = np.ones(KEY_TILE + tile, np.float32)
    scores = np.empty(at_once * each * tile * (KEY_TILE + tile), np.float32)
    seen = np.tri(tile, dtype=np.float32)
    later = seen == 0
    for n in lengths:
        part = slice(start, start + n)
        for g in range(0, groups, at_once):
            h = min(at_once, groups - g)
            qs = np.ascontiguousarray((q[part, g * each : (g + h) * each] * scale).transpose(1, 0, 2), np.float32).reshape(h, each, n, d)
            ks, vs = k[part, g : g + h].transpose(1, 2, 0)[:, None].astype(np.float32, "C"), v[part, g : g + h].transpose(1, 0, 2)[:, None].astype(np.float32, "C")
            plain = np.sqrt((_squares(qs).max(axis=(1, 2)) * np.einsum("hoij,hoij->hoj", ks, ks).max(axis=(1, 2))).max()) <= PLAIN_SCORES * _LOG_E
            sides = {(a, a + KEY_TILE): (np.ascontiguousarray(ks[..., a : a + KEY_TILE]), vs[:, :, a : a + KEY_TILE]) for a in range(0, n - KEY_TILE + 1, KEY_TILE)}
            for t in range(0, n, tile):
                m = min(tile, n - t)
                rows, reach = qs[:, :, t : t + m], t + m if causal else n
                blocks = [(a, min(a + KEY_TILE, reach)) for a in range(0, reach, KEY_TILE)]
                if causal and len(blocks) > 1 and blocks[-1][0] > t:  # the diagonal is whole in the last one
                    blocks[-2:] = [(blocks[-2][0], reach)]
                top = None if plain else _largest(rows, ks, blocks, later[:m, :m] if causal else None)
                mixed, total = None, None
                for a, b in blocks:
                    flat = scores[: h * each * m * (b - a)]
                    own_k, own_v = sides.get((a, b)) or (ks[..., a:b], vs[:, :, a:b])
                    w = np.matmul(rows, own_k, out=flat.reshape(h, each, m, b - a))
                    if top is not None:
                        w -= top
                        np.clip(w, -PLAIN_SCORES * _LOG_E, 0, out=w)  # below, all keys together are less than rounding, but subnormal; above are later ones, which count for nothing
                    _EXP(w, out=w)
                    if causal and b == reach:
                        w[..., -m:] *= seen[:m, :m]
                    got, sums = np.matmul(w, own_v), flat.reshape(-1, b - a) @ ones[: b - a]
                    mixed, total = (got, sums) if mixed is None else (np.add(mixed, got, out=mixed), np.add(total, sums, out=total))
                mixed /= total.reshape(h, each, m, 1)
                out[start + t : start + t + m, g * each : (g + h) * each] = mixed.reshape(h * each, m, d).transpose(1, 0, 2)
        start += n
    return out


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", x, x)


def _largest(rows: np.ndarray, ks: np.ndarray, blocks: list[tuple[int, int]], later: np.ndarray | None) -> np.ndarray:
    """Each query's largest score; with ``later`` the last block ends with the diagonal."""
    top = np.full((*rows.shape[:-1], 1), -np.inf, np.float32)
    for i, (a, b) in enumerate(blocks):
        w = np.matmul(rows, ks[..., a:b])
        if later is not None and i == len(blocks) - 1:
            w[..., -len(later) :][..., later] = -np.inf
        np.maximum(top, w.max(axis=-1, keepdims=True), out=top)
    return top


def attention_of(q: np.ndarray, k: np.ndarray, v: np.ndarray, lengths: list[int], reach: list[int]) -> np.ndarray:
    """``attention`` of one query a sequence, over the first ``reach`` positions of it; q: [sequences, heads, d]."""
    groups = k.shape[1]
    out, scale, start = np.empty_like(q), np.float32(1 / np.sqrt(q.shape[2])), 0
    for i, (n, own) in enumerate(zip(lengths, reach, strict=True)):
        qs = (q[i] * scale).reshape(groups, -1, q.shape[2])
        ks, vs = k[start : start + own].transpose(1, 2, 0), v[start : start + own].transpose(1, 0, 2)
        out[i] = (softmax_inplace(qs @ ks) @ vs).reshape(q.shape[1:])
        start += n
    return out
