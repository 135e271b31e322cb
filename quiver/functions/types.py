"""Codecs, casts and validation of vector columns.

vector: ``array<float>``; halfvec: ``array<float>`` of values that a 16-bit
float holds; sparsevec: ``struct<dim:int,indices:array<int>,values:array<float>>``
with ascending 0-based indices and no zeros; bit(n): a string of 0 and 1.
All functions return null for null.
"""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# limits and wordings fixed by the data model
VECTOR_MAX_DIM = 16000
HALFVEC_MAX_DIM = 16000
SPARSEVEC_MAX_DIM = 1_000_000_000
SPARSEVEC_MAX_NNZ = 16000
HALF_MAX = 65504.0

SPARSE = "struct<dim:int,indices:array<int>,values:array<float>>"


class VectorError(ValueError):
    """A value that is no vector of the asked type."""


def vector_type(dim: int | None = None, kind: str = "vector") -> T.StructField:
    """A field ``kind(dim)`` for a schema; dim is kept as column metadata."""
    most = {"vector": VECTOR_MAX_DIM, "halfvec": HALFVEC_MAX_DIM, "sparsevec": SPARSEVEC_MAX_DIM}[kind]
    if dim is not None and dim < 1:
        raise VectorError(f"dimensions for type {kind} must be at least 1")
    if dim is not None and dim > most:
        raise VectorError(f"dimensions for type {kind} cannot exceed {most}")
    meta = {"vtype": kind} | ({"dim": dim} if dim else {})
    if kind == "sparsevec":
        return T.StructField("v", T._parse_datatype_string(SPARSE), True, meta)
    return T.StructField("v", T.ArrayType(T.FloatType(), False), True, meta)


_NUMBER = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?nan|[+-]?inf(?:inity)?)\s*", re.IGNORECASE)


def _number(text: str, kind: str, whole: str, strict: bool = False) -> float:
    if not (m := _NUMBER.fullmatch(text)):
        raise VectorError(f'invalid input syntax for type {kind}: "{whole}"')
    x = float(m[1])
    if np.isnan(x):
        raise VectorError(f"NaN not allowed in {kind}")
    if np.isinf(x) and "inf" in m[1].lower():
        raise VectorError(f"infinite value not allowed in {kind}")
    with np.errstate(all="ignore"):
        y = float(np.float16(np.float32(x)) if kind == "halfvec" else np.float32(x))
    nonzero = re.search(r"[1-9]", m[1].lower().split("e")[0])
    if np.isinf(y) or strict and y == 0 and nonzero:
        raise VectorError(f'"{m[1]}" is out of range for type {kind}')
    return y


def parse_vector(text: str, dim: int | None = None, kind: str = "vector") -> list[float]:
    """``[1,2,3]`` with white space anywhere around numbers and brackets."""
    body = text.strip(" \t\n\r\v\f")
    if not body.startswith("["):
        raise VectorError(f'invalid input syntax for type {kind}: "{text}"\nVector contents must start with "[".')
    end = body.find("]")
    if end < 0:
        raise VectorError(f'invalid input syntax for type {kind}: "{text}"')
    if body[end + 1 :].strip(" \t\n\r\v\f"):
        raise VectorError(f'invalid input syntax for type {kind}: "{text}"\nJunk after closing right brace.')
    inner = body[1:end]
    if not inner.strip():
        raise VectorError(f"{kind} must have at least 1 dimension")
    parts = inner.split(",")
    if len(parts) > VECTOR_MAX_DIM:
        raise VectorError(f"{kind} cannot have more than {VECTOR_MAX_DIM} dimensions")
    out = [_number(p, kind, text) for p in parts]
    return _expected(out, len(out), dim)


def _expected(out, n: int, dim: int | None):
    if dim is not None and n != dim:
        raise VectorError(f"expected {dim} dimensions, not {n}")
    return out


def _shortest(x: float) -> str:
    """Shortest text that reads back as the same 32-bit float: 1, 1.5, 3e+38."""
    y = np.float32(x)
    if y == 0:
        return "-0" if np.signbit(y) else "0"
    digits = np.format_float_scientific(y, unique=True, trim="-")
    mantissa, exponent = digits.split("e")
    e = int(exponent)
    if -4 <= e < 6:
        return np.format_float_positional(y, unique=True, trim="-")
    return f"{mantissa}e{'+' if e >= 0 else '-'}{abs(e):02d}"


def format_vector(v) -> str:
    return "[" + ",".join(_shortest(x) for x in v) + "]"


def parse_sparse(text: str, dim: int | None = None) -> dict:
    """``{index:value,...}/dim``, indices from 1, in any order; zeros are dropped."""
    bad = VectorError(f'invalid input syntax for type sparsevec: "{text}"')
    m = re.fullmatch(r"\s*\{([^{}]*)\}\s*/\s*([+-]?\d+)\s*", text)
    if not m:
        raise bad
    n = int(m[2])
    if n < 1:
        raise VectorError("sparsevec must have at least 1 dimension")
    if n > SPARSEVEC_MAX_DIM:
        raise VectorError(f"sparsevec cannot have more than {SPARSEVEC_MAX_DIM} dimensions")
    found: list[tuple[int, float]] = []
    for part in m[1].split(",") if m[1].strip() else ():
        pair = re.fullmatch(r"\s*([+-]?\d+)\s*:(.*)", part, re.DOTALL)
        if not pair:
            raise bad
        i, x = int(pair[1]), _number(pair[2], "sparsevec", text, strict=True)
        if not 1 <= i <= n:
            raise VectorError("sparsevec index out of bounds")
        found.append((i - 1, x))
    found.sort(key=lambda t: t[0])
    if any(a[0] == b[0] for a, b in zip(found, found[1:], strict=False)):
        raise VectorError("sparsevec indices must not contain duplicates")
    found = [t for t in found if t[1] != 0]
    if len(found) > SPARSEVEC_MAX_NNZ:
        raise VectorError(f"sparsevec cannot have more than {SPARSEVEC_MAX_NNZ} non-zero elements")
    return _expected({"dim": n, "indices": [t[0] for t in found], "values": [t[1] for t in found]}, n, dim)


def format_sparse(v) -> str:
    return "{" + ",".join(f"{i + 1}:{_shortest(x)}" for i, x in zip(v["indices"], v["values"], strict=True)) + f"}}/{v['dim']}"


# --- binary codecs: int16 dim, int16 zero, floats, all big-endian ---


def pack_vector(v, half: bool = False) -> bytes:
    return np.array([len(v), 0], ">i2").tobytes() + np.asarray(v, ">f2" if half else ">f4").tobytes()


def unpack_vector(data: bytes, half: bool = False) -> list[float]:
    kind = "halfvec" if half else "vector"
    dim, unused = (int(x) for x in np.frombuffer(data, ">i2", 2))
    if dim < 1:
        raise VectorError(f"{kind} must have at least 1 dimension")
    if unused != 0:
        raise VectorError(f"expected unused to be 0, not {unused}")
    out = np.frombuffer(data, ">f2" if half else ">f4", dim, 4).astype(float)
    if np.isnan(out).any():
        raise VectorError(f"NaN not allowed in {kind}")
    if np.isinf(out).any():
        raise VectorError(f"infinite value not allowed in {kind}")
    return out.tolist()


def pack_sparse(v) -> bytes:
    return np.array([v["dim"], len(v["indices"]), 0], ">i4").tobytes() + np.asarray(v["indices"], ">i4").tobytes() + np.asarray(v["values"], ">f4").tobytes()


def unpack_sparse(data: bytes, expected: int | None = None) -> dict:
    dim, n, unused = (int(x) for x in np.frombuffer(data, ">i4", 3))
    if dim < 1:
        raise VectorError("sparsevec must have at least 1 dimension")
    if dim > SPARSEVEC_MAX_DIM:
        raise VectorError(f"sparsevec cannot have more than {SPARSEVEC_MAX_DIM} dimensions")
    if n < 0:
        raise VectorError("sparsevec cannot have negative number of elements")
    if n > SPARSEVEC_MAX_NNZ:
        raise VectorError(f"sparsevec cannot have more than {SPARSEVEC_MAX_NNZ} non-zero elements")
    if n > dim:
        raise VectorError("sparsevec cannot have more elements than dimensions")
    _expected(None, dim, expected)
    if unused != 0:
        raise VectorError(f"expected unused to be 0, not {unused}")
    indices = np.frombuffer(data, ">i4", n, 12)
    values = np.frombuffer(data, ">f4", n, 12 + 4 * n)
    if (np.diff(indices) <= 0).any():
        raise VectorError("sparsevec indices must not contain duplicates" if (np.diff(np.sort(indices)) == 0).any() else "sparsevec indices must be in ascending order")
    if n and (indices[0] < 0 or indices[-1] >= dim):
        raise VectorError("sparsevec index out of bounds")
    if np.isnan(values).any():
        raise VectorError("NaN not allowed in sparsevec")
    if np.isinf(values).any():
        raise VectorError("infinite value not allowed in sparsevec")
    if (values == 0).any():
        raise VectorError("binary representation of sparsevec cannot contain zero values")
    return {"dim": dim, "indices": indices.tolist(), "values": values.astype(float).tolist()}


_ARROW = {"array<float>": pa.list_(pa.float32()), "string": pa.string(), "binary": pa.binary(), SPARSE: pa.struct([("dim", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])}


def _each(f, kind: str, batch=None):
    """``batch`` takes a whole array without nulls, or returns None where values must go one by one (for the error's wording, say)."""

    @F.arrow_udf(kind)
    def run(x: pa.Array) -> pa.Array:
        if batch is not None and len(x):
            known = x.drop_null()
            out = batch(known) if len(known) else None
            if out is not None:
                if len(known) == len(x):
                    return out
                at = np.cumsum(np.asarray(x.is_valid())) - 1
                return out.take(pa.array(np.where(np.asarray(x.is_valid()), at, -1), mask=np.asarray(x.is_null())))
        return pa.array([None if v is None else f(v) for v in x.to_pylist()], _ARROW[kind])

    return run


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.float32()))


def _lengths(x: pa.Array) -> np.ndarray:
    return pc.list_value_length(x).to_numpy(zero_copy_only=False)


def _batch_in(dim: int | None, half: bool):
    """Plain texts of finite numbers, all in order."""

    def run(x: pa.Array) -> pa.Array | None:
        try:
            if not pc.all(pc.match_substring_regex(x, r"^\[[-+.eE\d,]+\]$")).as_py():
                return None
            parts = pc.split_pattern(pc.utf8_slice_codeunits(x, 1, -1), ",")
            flat = parts.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False)
        except pa.ArrowInvalid:
            return None
        n = _lengths(parts)
        if n.max() > VECTOR_MAX_DIM or dim is not None and (n != dim).any() or not np.isfinite(flat).all():
            return None
        if half:
            with np.errstate(over="ignore"):
                flat = flat.astype(np.float16).astype(np.float32)
            if not np.isfinite(flat).all():
                return None
        return _lists(flat, np.concatenate(([0], np.cumsum(n))))

    return run


def _batch_out(x: pa.Array) -> pa.Array:
    flat = x.flatten().cast(pa.float32())
    text = flat.cast(pa.string())
    values = flat.to_numpy(zero_copy_only=False)
    size = np.abs(values)
    odd = np.flatnonzero((size != 0) & ((size < 1e-4) | (size >= 1e6)) | ~np.isfinite(size))
    if len(odd):  # those that take an exponent
        mask = np.zeros(len(values), dtype=bool)
        mask[odd] = True
        text = pc.replace_with_mask(text, mask, pa.array([_shortest(v) for v in values[odd]], pa.string()))
    offsets = np.concatenate(([0], np.cumsum(_lengths(x))))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text), ",")
    return pc.binary_join_element_wise("[", joined, "]", "")


def _batch_send(half: bool):
    def run(x: pa.Array) -> pa.Array | None:
        n = _lengths(x)
        if n.min() != n.max() or n[0] > VECTOR_MAX_DIM:
            return None
        out = np.empty(len(x), dtype=[("dim", ">i2"), ("unused", ">i2"), ("v", ">f2" if half else ">f4", (int(n[0]),))])
        out["dim"], out["unused"], out["v"] = n[0], 0, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        offsets = np.arange(len(x) + 1, dtype=np.int32) * out.dtype.itemsize
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())])

    return run


def _batch_recv(half: bool):
    def run(x: pa.Array) -> pa.Array | None:
        n = pc.binary_length(x).to_numpy(zero_copy_only=False)
        dim, rest = divmod(int(n[0]) - 4, 2 if half else 4)
        if n.min() != n.max() or rest or dim < 1:
            return None
        got = np.frombuffer(b"".join(x.to_pylist()), dtype=[("dim", ">i2"), ("unused", ">i2"), ("v", ">f2" if half else ">f4", (dim,))])
        flat = got["v"].astype(np.float32).ravel()
        if (got["dim"] != dim).any() or got["unused"].any() or not np.isfinite(flat).all():
            return None
        return _lists(flat, np.arange(len(x) + 1) * dim)

    return run


def vector_in(text: Column, dim: int | None = None) -> Column:
    return _each(lambda s: parse_vector(s, dim), "array<float>", _batch_in(dim, False))(text)


def halfvec_in(text: Column, dim: int | None = None) -> Column:
    return _each(lambda s: parse_vector(s, dim, "halfvec"), "array<float>", _batch_in(dim, True))(text)


def sparsevec_in(text: Column, dim: int | None = None) -> Column:
    return _each(lambda s: parse_sparse(s, dim), SPARSE)(text)


def vector_out(v: Column) -> Column:
    return _each(format_vector, "string", _batch_out)(v)


halfvec_out = vector_out


def sparsevec_out(v: Column) -> Column:
    return _each(format_sparse, "string")(v)


def sparsevec_send(v: Column) -> Column:
    return _each(pack_sparse, "binary")(v)


def vector_send(v: Column) -> Column:
    return _each(pack_vector, "binary", _batch_send(False))(v)


def vector_recv(data: Column) -> Column:
    return _each(unpack_vector, "array<float>", _batch_recv(False))(data)


def halfvec_send(v: Column) -> Column:
    return _each(lambda x: pack_vector(x, True), "binary", _batch_send(True))(v)


def halfvec_recv(data: Column) -> Column:
    return _each(lambda x: unpack_vector(x, True), "array<float>", _batch_recv(True))(data)


def sparsevec_recv(data: Column, dim: int | None = None) -> Column:
    return _each(lambda x: unpack_sparse(x, dim), SPARSE)(data)


# --- casts, as expressions ---


def fail(message) -> Column:
    return F.raise_error(message if isinstance(message, Column) else F.lit(message))


def check_dim(v: Column, dim: int, size: Column | None = None) -> Column:
    """``v`` if it has ``dim`` dimensions; an error otherwise."""
    n = F.size(v) if size is None else size
    return F.when(v.isNull() | (n == dim), v).otherwise(fail(F.concat(F.lit(f"expected {dim} dimensions, not "), n.cast("string"))))


def array_to_vector(a: Column, dim: int | None = None, kind: str = "vector") -> Column:
    """From an array of integers, floats, doubles or decimals."""
    half = kind == "halfvec"
    v = F.transform(a, lambda x: x.cast("double").cast("float"))
    bad = (
        F.when(F.exists(a, lambda x: x.isNull()), fail("array must not contain nulls"))
        .when(F.size(a) < 1, fail(f"{kind} must have at least 1 dimension"))
        .when(F.size(a) > VECTOR_MAX_DIM, fail(f"{kind} cannot have more than {VECTOR_MAX_DIM} dimensions"))
        .when(F.exists(v, lambda x: F.isnan(x)), fail(f"NaN not allowed in {kind}"))
        .when(F.exists(v, lambda x: F.abs(x) == float("inf")), fail(f"infinite value not allowed in {kind}"))
    )
    out = F.when(a.isNotNull(), bad.otherwise(vector_to_halfvec(v) if half else v))
    return check_dim(out, dim) if dim else out


def to_half(v: Column) -> Column:
    """Values rounded to the nearest 16-bit float, ties to even, by arithmetic in doubles."""

    def one(x: Column) -> Column:
        d = x.cast("double")
        size = F.abs(d)
        # spacing of 16-bit floats: 2 ** (exponent - 10), 2 ** -24 at least
        power = F.greatest(F.lit(-24.0), F.floor(F.log2(F.when(size > 0, size).otherwise(1.0))) - 10)
        step = F.pow(F.lit(2.0), power)
        return (F.rint(d / step) * step).cast("float")

    return F.transform(v, one)


def vector_to_halfvec(v: Column, dim: int | None = None) -> Column:
    big = F.filter(v, lambda x: F.abs(x) >= 65520.0)
    out = F.when(F.size(big) > 0, fail(F.concat(F.lit('"'), F.format_string("%.0f", big[0].cast("double")), F.lit('" is out of range for type halfvec')))).otherwise(to_half(v))
    return check_dim(out, dim) if dim else out


def halfvec_to_vector(v: Column, dim: int | None = None) -> Column:
    return check_dim(v, dim) if dim else v


def vector_to_float4(v: Column) -> Column:
    return v


def vector_to_sparsevec(v: Column, dim: int | None = None) -> Column:
    held = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] != 0)
    out = F.when(v.isNotNull(), F.struct(F.size(v).alias("dim"), F.transform(held, lambda s: s["i"]).alias("indices"), F.transform(held, lambda s: s["x"]).alias("values")).cast(SPARSE))
    return check_dim(out, dim, F.size(v)) if dim else out


def array_to_sparsevec(a: Column, dim: int | None = None) -> Column:
    return vector_to_sparsevec(array_to_vector(a, None, "sparsevec"), dim)


def sparsevec_to_vector(s: Column, dim: int | None = None, kind: str = "vector") -> Column:
    """Dense values: each stored one after the zeros before it, in one pass."""
    zero = F.lit(0.0).cast("float")

    def fill(t: Column) -> Column:
        parts = F.transform(t["indices"], lambda i, j: F.concat(F.array_repeat(zero, i - F.coalesce(F.get(t["indices"], j - 1), F.lit(-1)) - 1), F.array(F.get(t["values"], j))))
        return F.concat(F.flatten(parts), F.array_repeat(zero, t["dim"] - 1 - F.coalesce(F.array_max(t["indices"]), F.lit(-1))))

    dense = F.get(F.transform(F.array(s), fill), F.lit(0))  # a lambda's variable is computed once
    out = F.when(s["dim"] > VECTOR_MAX_DIM, fail(f"{kind} cannot have more than {VECTOR_MAX_DIM} dimensions")).when(s.isNotNull(), dense)
    out = vector_to_halfvec(out) if kind == "halfvec" else out
    return check_dim(out, dim) if dim else out


def decimal_array(values) -> list[Decimal]:
    try:
        return [Decimal(str(v)) for v in values]
    except InvalidOperation as e:
        raise VectorError(str(e)) from e
