"""Column functions over vectors (arrays of float): all JVM-side but those that pack raw bytes or print decimals.

Sums run in double precision. A vector with a null element, or no vector, gives null, unless a function says otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _double(x: ColumnLike) -> Column:
    return _c(x).cast("array<double>")


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    """Null where the lengths differ."""
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: ColumnLike) -> Column:
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x * x)))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def unit(a: ColumnLike) -> Column:
    """Unit vector in double precision; null where the norm is zero or not finite."""
    n = norm(a)
    return F.when(_finite(n) & (n > 0), F.transform(_double(a), lambda x: x / n))


def over_norm(a: ColumnLike) -> Column:
    """Each component by the norm of those that are not null, in double precision, as IEEE and SQL have it: null components stay null, and
    where the norm is zero or not finite no vector is left out (0 / 0 is NaN). The norm is computed once a vector."""
    vec = _double(a)
    n = norm(F.filter(vec, lambda x: x.isNotNull()))
    return F.get(F.transform(F.array(n), lambda n: F.transform(vec, lambda x: F.when(n == 0, x * float("nan")).otherwise(x / n))), F.lit(0))


def rounded(x: ColumnLike, places: int) -> Column:
    """Half away from zero, of the product with the power of ten, as SQL engines in C round doubles. Small negative numbers give -0.0:
    ``F.round`` goes by way of decimals, which have no sign at zero and other ties."""
    y = _c(x) * float(10**places)
    near = F.rint(y)
    away = F.when(F.abs(y) - F.abs(near) == 0.5, near + F.signum(y)).otherwise(near) / float(10**places)
    return F.when(_finite(y), away).otherwise(_c(x))


def l2_normalize(a: ColumnLike) -> Column:
    """Unit vector of floats; null where the norm is zero or not finite."""
    return unit(a).cast("array<float>")


def cosine_similarity(a: ColumnLike, b: ColumnLike) -> Column:
    """0 where a vector is missing, zero or not finite, or the lengths differ."""
    d, n = dot(a, b), norm(a) * norm(b)
    return F.coalesce(F.when((F.size(_c(a)) == F.size(_c(b))) & _finite(d) & _finite(n) & (n > 0), d / n), F.lit(0.0))


def truncate_dims(a: ColumnLike, dims: int | Column) -> Column:
    """The first components of a Matryoshka vector."""
    return F.slice(_c(a), F.lit(1), F.lit(dims) if isinstance(dims, int) else dims)


def matryoshka(a: ColumnLike, dims: int, full: int, normalize: bool, last_token: bool) -> Column:
    """Truncated; made a unit vector again only for normalised models that pool the last token, and only where dims < full."""
    short = truncate_dims(a, dims)
    return F.coalesce(l2_normalize(short), short) if normalize and last_token and dims < full else short


def int8_quantize(a: ColumnLike) -> Column:
    """Half-even rounding of 127 tanh x."""
    return F.transform(_double(a), lambda x: F.greatest(F.least(F.rint(F.tanh(x) * 127), F.lit(127.0)), F.lit(-128.0)).cast("tinyint"))


def int8_dequantize(q: ColumnLike) -> Column:
    """The float view of an int8 vector: q / 128."""
    return F.transform(_c(q), lambda x: (x.cast("double") / 128).cast("float"))


def _bytes(numbers: Column) -> Column:
    """Binary from an array of numbers from 0 to 255."""
    return F.unhex(F.array_join(F.transform(numbers, lambda b: F.lpad(F.hex(b.cast("long")), 2, "0")), ""))


def int8_bytes(a: ColumnLike) -> Column:
    return _bytes(F.transform(int8_quantize(a), lambda q: F.pmod(q.cast("int"), F.lit(256))))


def sign_bits(a: ColumnLike) -> Column:
    """Bit i of byte i / 8, lowest bit first, is 1 where the component is at least 0 (a NaN is not). Null where the length is no multiple of 8."""
    v = _double(a)
    powers = F.array(*(F.lit(1 << i) for i in range(8)))
    is_set = lambda x: F.coalesce(~F.isnan(x) & (x >= 0), F.lit(False))
    byte = lambda k: F.aggregate(F.zip_with(F.slice(v, k * 8 + 1, 8), powers, lambda x, p: F.when(is_set(x), p).otherwise(0)), F.lit(0), lambda s, x: s + x)
    packed = _bytes(F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 8).cast("int") - 1), byte))
    return F.when((F.size(v) > 0) & (F.size(v) % 8 == 0), packed)


def base64_text(b: ColumnLike) -> Column:
    """RFC 4648 with padding and without line breaks, whatever the session's setting."""
    return F.regexp_replace(F.base64(_c(b)), "[\r\n]", "")


def _packed_floats(a: pa.Array) -> pa.Array:
    return pa.array([None if v is None else np.asarray(v, "<f4").tobytes() for v in a.to_pylist()], pa.binary())


def _int8_floats(b: pa.Array) -> pa.Array:
    return pa.array([None if v is None else np.frombuffer(v, np.int8).astype(np.float32).tolist() for v in b.to_pylist()], pa.list_(pa.float32()))


def float_bytes(a: ColumnLike) -> Column:
    """Raw little-endian 32-bit floats."""
    return F.arrow_udf(_packed_floats, "binary")(_c(a))


def floats_of_int8(b: ColumnLike) -> Column:
    """Client-side view of an int8 embedding's bytes: numbers from -128 to 127."""
    return F.arrow_udf(_int8_floats, "array<float>")(_c(b))


def encode(a: ColumnLike, encoding: str) -> Column:
    """A vector in an API's encoding: float (the array), base64 (raw floats), base64_int8, base64_binary."""
    if encoding == "float":
        return _c(a)
    packed = {"base64": lambda: float_bytes(_c(a)), "base64_int8": lambda: int8_bytes(a), "base64_binary": lambda: sign_bits(a)}[encoding]()
    return base64_text(packed)


def int8_float_view(a: ColumnLike) -> Column:
    """Floats as an API with int8 as its native form shows them."""
    return int8_dequantize(int8_quantize(a))


def maxsim(query: ColumnLike, doc: ColumnLike) -> Column:
    """Sum over query vectors of the best dot product with a document vector; NaN products don't count. 0 for empty sides."""
    best = lambda q: F.array_max(F.filter(F.transform(_c(doc), lambda d: dot(q, d)), lambda x: ~F.isnan(x)))
    return F.coalesce(_sum(F.transform(_c(query), lambda q: F.coalesce(best(q), F.lit(0.0)))), F.lit(0.0))


def mean_pool(states: ColumnLike) -> Column:
    """Mean of a sequence of vectors."""
    s = _c(states)
    n = F.size(F.get(s, F.lit(0)))
    total = F.aggregate(s, F.array_repeat(F.lit(0.0), n), lambda acc, v: F.zip_with(acc, v.cast("array<double>"), lambda x, y: x + y))
    return F.transform(total, lambda x: (x / F.size(s)).cast("float"))


def last_pool(states: ColumnLike) -> Column:
    return F.try_element_at(_c(states), F.lit(-1))


def cls_pool(states: ColumnLike) -> Column:
    return F.get(_c(states), F.lit(0))


def span_pool(states: ColumnLike, start: ColumnLike, n_tokens: ColumnLike) -> Column:
    """Mean over a span, never normalised; null for empty spans and such as reach beyond the sequence."""
    s, a, n = _c(states), _c(start), _c(n_tokens)
    return F.when((a >= 0) & (n > 0) & (a + n <= F.size(s)), mean_pool(F.slice(s, F.greatest(a, F.lit(0)) + 1, F.greatest(n, F.lit(1)))))


def softmax(a: ColumnLike) -> Column:
    e = F.transform(_double(a), lambda x: F.exp(x - F.array_max(_double(a))))
    return F.transform(e, lambda x: x / _sum(e))


def swiglu(gate: ColumnLike, up: ColumnLike) -> Column:
    return F.zip_with(_double(gate), _double(up), lambda g, u: g / (1 + F.exp(-g)) * u)


def gelu_tanh(a: ColumnLike) -> Column:
    return F.transform(_double(a), lambda x: 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))))


def late_layout(ids: ColumnLike, mark: int, mask: int | None = None, length: int = 32) -> Column:
    """The late mark as the second id; with ``mask`` padded to ``length``, never cut."""
    i = _c(ids)
    out = F.concat(F.slice(i, 1, 1), F.array(F.lit(mark)), F.slice(i, F.lit(2), F.greatest(F.size(i) - 1, F.lit(0))))
    return out if mask is None else F.concat(out, F.array_repeat(F.lit(mask), F.greatest(F.lit(length) - F.size(out), F.lit(0))))


def keep_positions(ids: ColumnLike, skip: list[int]) -> Column:
    """Positions from 0 whose id is not skipped."""
    i = _c(ids)
    kept = F.filter(F.transform(i, lambda t, k: F.struct(k.alias("k"), t.alias("t"))), lambda x: ~x["t"].isin(skip) if skip else F.lit(True))
    return F.transform(kept, lambda x: x["k"])


def truncate_ids(ids: ColumnLike, cap: int | Column, keep_tail: bool = False) -> Column:
    i = _c(ids)
    n = F.lit(cap) if isinstance(cap, int) else cap
    short = F.concat(F.slice(i, F.lit(1), n - 1), F.array(F.element_at(i, -1))) if keep_tail else F.slice(i, F.lit(1), n)
    return F.when(F.size(i) > n, short).otherwise(i)


def token_cap(max_positions: ColumnLike, offset: ColumnLike, max_batch_tokens: ColumnLike) -> Column:
    room, batch = _c(max_positions) - _c(offset), _c(max_batch_tokens)
    return F.least(F.lit(32768), F.when(room > 0, room), F.when(batch > 0, batch))


def layout(ids: ColumnLike, prefix: list[int], suffix: list[int]) -> Column:
    parts = [F.array(*map(F.lit, p)) for p in (prefix,) if p] + [_c(ids)] + [F.array(*map(F.lit, p)) for p in (suffix,) if p]
    return F.concat(*parts)


def format_floats(a: ColumnLike, pattern: str = "%.8f", separator: str = " ") -> Column:
    """Components in C's notation: rounded from their exact values, ties to even, nan and inf; null ones are the word null. (The JVM's
    formatter rounds the shortest decimal that names a number, half up: 0.103515625 and large numbers print otherwise.)"""

    def printed(a: pa.Array) -> pa.Array:
        def line(v: list) -> str:
            return separator.join("null" if x is None else pattern % x for x in v) if None in v else separator.join([pattern] * len(v)) % tuple(v)

        return pa.array([None if v is None else line(v) for v in a.to_pylist()], pa.string())

    return F.arrow_udf(printed, "string")(_double(a))
