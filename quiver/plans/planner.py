"""Settings with their ranges, the six operator spellings, and the choice between exact and indexed search."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hnsw, ivf
from ..operators.knn import knn

# names and ranges fixed by the settings' meaning
RANGES = {"ivfflat.probes": (1, 32768, 1), "ivfflat.max_probes": (1, 32768, 32768), "hnsw.ef_search": (1, 1000, 40), "hnsw.max_scan_tuples": (1, 2**31 - 1, 20000), "hnsw.scan_mem_multiplier": (1, 1000, 1)}
CHOICES = {"ivfflat.iterative_scan": ("off", "relaxed_order"), "hnsw.iterative_scan": ("off", "relaxed_order", "strict_order")}


class Settings(dict):
    """Values by name; unset ones have their defaults."""

    def __missing__(self, name: str):
        return RANGES[name][2] if name in RANGES else CHOICES[name][0]

    def put(self, name: str, value) -> None:
        if name in RANGES:
            low, high, _ = RANGES[name]
            if not low <= value <= high:
                raise ValueError(f'{value} is outside the valid range for parameter "{name}" ({low} .. {high})')
        elif name not in CHOICES:
            raise KeyError(name)
        elif value not in CHOICES[name]:
            raise ValueError(f'invalid value for parameter "{name}": "{value}"')
        self[name] = value


@dataclass
class VectorTable:
    """A table with an optional index."""

    df: DataFrame
    vec: str = "embedding"
    key: str = "id"
    metric: str = "l2"
    ivf: ivf.IvfIndex | None = None
    hnsw: hnsw.HnswIndex | None = None
    rows: int | None = None

    def choose(self, k: int | None, settings: Settings, selectivity: float = 1.0) -> str:
        """exact without a limit, for small tables, or where the filter leaves less than an index would read; else the index that reads the smaller share."""
        if k is None or self.ivf is None and self.hnsw is None:
            return "exact"
        n = self.rows if self.rows is not None else self.df.count()
        share = {}
        if self.ivf:
            share["ivf"] = min(1.0, settings["ivfflat.probes"] / self.ivf.lists)
        if self.hnsw and n > 1:
            ef, m = settings["hnsw.ef_search"], 16
            share["hnsw"] = min(1.0, (m + 2 * m * ef * 0.55 * math.log(n) / (math.log(m) * (1 + math.log(ef)))) / n)
        best = min(share, key=share.get)
        return "exact" if n < 10_000 or selectivity <= share[best] or share[best] > 0.5 else best

    def search(self, query, k: int, method: str = "auto", settings: Settings | None = None, where: Column | None = None, filter_mode: str = "pre") -> DataFrame:
        """(key, distance), nearest first.

        Exact search filters first. An indexed search (filter_mode "post", or
        a method named) meets the filter inside its scan: without an iterative
        scan it may return fewer than k rows, with one it goes on until k rows
        pass or the settings' limits are reached. With "pre", "auto" makes a
        filter an exact search.
        """
        settings = settings or Settings()
        if method == "auto":
            method = "exact" if where is not None and filter_mode == "pre" else self.choose(k, settings)
        if method == "exact":
            return knn(self.df, self.vec, query, k, self.metric, self.key, where).select(self.key, "distance")
        passing = None if where is None else self.df.where(where).select(F.col(self.key).cast("long").alias("id"))
        if method == "ivf":
            kept = None if passing is None else lambda rows: rows.join(passing, "id", "left_semi")
            found = self.ivf.search(query, k, settings["ivfflat.probes"], settings["ivfflat.iterative_scan"], settings["ivfflat.max_probes"], kept)
            order = ["batch", F.col("distance").asc_nulls_last(), "id"]
        elif method == "hnsw":
            found = self.hnsw.search(query, k, settings["hnsw.ef_search"], settings["hnsw.iterative_scan"], passing, settings["hnsw.max_scan_tuples"], settings["hnsw.scan_mem_multiplier"])
            order = [F.col("distance").asc_nulls_last(), "id"]
        else:
            raise ValueError(f"unknown method {method!r}: auto, exact, ivf or hnsw")
        return found.orderBy(*order).select(F.col("id").alias(self.key), "distance")


# the operators' spellings and functions
OPERATORS = {"<->": "l2_distance", "<#>": "negative_inner_product", "<=>": "cosine_distance", "<+>": "l1_distance", "<~>": "hamming_distance", "<%>": "jaccard_distance"}
_OPEN, _CLOSE = {")": "(", "]": "["}, {"(": ")", "[": "]"}


def _tokens(sql: str) -> list[str]:
    """Quoted strings, quoted names, comments, operators, words and single characters."""
    spelled = "|".join(map(re.escape, OPERATORS))
    return re.findall(rf"'(?:[^']|'')*'|`[^`]*`|--[^\n]*|/\*.*?\*/|{spelled}|::|[\w.]+|\s+|.", sql, re.S)


def _operand(tokens: list[str], at: int, step: int) -> int:
    """One past the operand that begins at ``at`` and goes on in the direction ``step``: a literal, a name, a call, an index or a bracketed expression."""
    pairs = _CLOSE if step > 0 else _OPEN
    end, name = at, False
    while 0 <= end < len(tokens) and tokens[end].isspace():
        end += step
    while 0 <= end < len(tokens):
        t = tokens[end]
        if t in pairs and not (step < 0 and name):
            depth = 0
            while 0 <= end < len(tokens):
                depth += (tokens[end] == t) - (tokens[end] == pairs[t])
                end += step
                if not depth:
                    break
            name = step > 0
            if step < 0 and not (0 <= end < len(tokens) and (tokens[end] in pairs or _word(tokens[end]))):
                return end
        elif t == "::" or t[0] in "'`" or _word(t):
            if name and t != "::" and not (step < 0 and tokens[end + 1] == "::") and not (step > 0 and tokens[end - 1] == "::"):
                return end
            name = t != "::"
            end += step
        else:
            return end
    return end


def _word(t: str) -> bool:
    return bool(re.fullmatch(r"[\w.]+|`[^`]*`", t)) and t.upper() not in {"SELECT", "BY", "WHERE", "AND", "OR", "NOT", "ON", "WHEN", "THEN", "ELSE", "CASE", "AS", "FROM", "IN", "BETWEEN", "HAVING", "DISTINCT"}


def _literal(text: str) -> str:
    """'[1,2,3]' as an array."""
    m = re.fullmatch(r"\s*'\s*\[([-+.eE\d,\s]*)\]\s*'\s*(?:::\s*(?:vector|halfvec))?\s*", text)
    return f"array({', '.join(f'float({x.strip()})' for x in m[1].split(','))})" if m else text.strip()


def rewrite(sql: str) -> str:
    """Operator spellings as function calls, outside strings and comments.

    Operands are names, literals, calls (nested ones too), indexed or
    bracketed expressions; '[1,2,3]' becomes an array. ``<=>`` would otherwise
    mean null-safe equality.
    """
    tokens = _tokens(sql)
    at = 0
    while at < len(tokens):
        if tokens[at] in OPERATORS:
            a, b = _operand(tokens, at - 1, -1) + 1, _operand(tokens, at + 1, 1)
            left, right = "".join(tokens[a:at]), "".join(tokens[at + 1 : b])
            space = left[: len(left) - len(left.lstrip())]
            call = f"{OPERATORS[tokens[at]]}({_literal(left)}, {_literal(right)})"
            tail = right[len(right.rstrip()) :]
            tokens[a:b] = [x for x in (space, call, tail) if x]
            at = a
        at += 1
    return "".join(tokens)


_DOT = "aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, v) -> s + v)"
_L2 = "aggregate(zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, v) -> s + v)"
_NORM = "aggregate({v}, 0D, (s, x) -> s + double(x) * double(x))"
_SIZE = f"sqrt({_NORM.format(v='a')} * {_NORM.format(v='b')})"
_COSINE = f"CASE WHEN {_SIZE} = 0 OR isnan({_SIZE}) THEN double('NaN') ELSE 1D - greatest(-1D, least(1D, try_divide({_DOT}, {_SIZE}))) END"
_CHECKED = "transform({v}, x -> CASE WHEN abs(x) = float('Infinity') THEN float(raise_error('value out of range: overflow')) ELSE x END)"
_WORDS = "transform(sequence(0, greatest(0, int((length({v}) - 1) / 63))), i -> cast(conv(concat('0', substring({v}, i * 63 + 1, 63)), 2, 10) AS BIGINT))"
_COUNT = "aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x {{op}} y)), 0, (s, v) -> s + v)".format(a=_WORDS.format(v="a"), b=_WORDS.format(v="b"))
_HALF = "transform(a, x -> CASE WHEN abs(x) >= 65520 THEN float(raise_error('value out of range: overflow')) WHEN x = 0 THEN x ELSE float(rint(x / pow(2D, greatest(-24D, floor(log2(abs(double(x)))) - 10))) * pow(2D, greatest(-24D, floor(log2(abs(double(x)))) - 10))) END)"
_TERMS = "map_values(map_zip_with(map_from_arrays(a.indices, a.values), map_from_arrays(b.indices, b.values), (k, x, y) -> {f}))"
_X, _Y = "double(coalesce(x, 0))", "double(coalesce(y, 0))"
_SUM = "aggregate({v}, 0D, (s, v) -> s + v)"


def functions() -> dict[str, tuple[str, str, str]]:
    """Name, to parameters, result type and body, of the SQL functions."""
    two, one = "a ARRAY<FLOAT>, b ARRAY<FLOAT>", "a ARRAY<FLOAT>"

    def guarded(body: str, kind: str) -> str:
        return f"CASE WHEN size(a) = size(b) THEN {body} WHEN a IS NOT NULL AND b IS NOT NULL THEN cast(raise_error(concat('different vector dimensions ', size(a), ' and ', size(b))) AS {kind}) END"

    out = {}
    pairs = {
        "l2_distance": f"sqrt({_L2})", "vector_l2_squared_distance": _L2, "inner_product": _DOT, "negative_inner_product": f"-{_DOT}", "vector_negative_inner_product": f"-{_DOT}",
        "l1_distance": _SUM.format(v="zip_with(a, b, (x, y) -> abs(double(x) - double(y)))"), "cosine_distance": _COSINE, "vector_spherical_distance": f"acos(greatest(-1D, least(1D, {_DOT}))) / pi()",
    }
    out |= {name: (two, "DOUBLE", guarded(body, "DOUBLE")) for name, body in pairs.items()}
    for name, op in (("vector_add", "+"), ("vector_sub", "-"), ("vector_mul", "*")):
        body = _CHECKED.format(v=f"zip_with(a, b, (x, y) -> float(x {op} y))")
        out[name] = (two, "ARRAY<FLOAT>", guarded(body, "ARRAY<FLOAT>"))
    out["vector_concat"] = (two, "ARRAY<FLOAT>", "CASE WHEN size(a) + size(b) > 16000 THEN cast(raise_error('vector cannot have more than 16000 dimensions') AS ARRAY<FLOAT>) ELSE concat(a, b) END")
    for name, op in (("lt", "<"), ("le", "<="), ("eq", "="), ("ne", "<>"), ("ge", ">="), ("gt", ">")):
        out[f"vector_{name}"] = (two, "BOOLEAN", f"a {op} b")
    out["vector_cmp"] = (two, "INT", "CASE WHEN a < b THEN -1 WHEN a > b THEN 1 WHEN a = b THEN 0 END")
    out["vector_dims"] = (one, "INT", "CASE WHEN a IS NOT NULL THEN size(a) END")
    out["vector_norm"] = out["l2_norm"] = (one, "DOUBLE", f"sqrt({_NORM.format(v='a')})")
    out["l2_normalize"] = (one, "ARRAY<FLOAT>", f"transform(a, v -> float(coalesce(try_divide(double(v), sqrt({_NORM.format(v='a')})), 0)))")
    out["binary_quantize"] = (one, "STRING", "array_join(transform(a, x -> CASE WHEN x > 0 THEN '1' ELSE '0' END), '')")
    cut = "slice(a, greatest(1, start), greatest(1, int(least(bigint(start) + n, size(a) + 1) - greatest(1, start))))"
    none = "n < 1 OR least(bigint(start) + n, size(a) + 1) - greatest(1, start) < 1"
    out["subvector"] = (f"{one}, start INT, n INT", "ARRAY<FLOAT>", f"CASE WHEN {none} THEN cast(raise_error('vector must have at least 1 dimension') AS ARRAY<FLOAT>) WHEN a IS NOT NULL THEN {cut} END")
    out["vector_to_halfvec"] = (one, "ARRAY<FLOAT>", _HALF)
    out["vector_to_float4"] = out["halfvec_to_vector"] = (one, "ARRAY<FLOAT>", "a")
    made = "transform(a, x -> CASE WHEN x IS NULL THEN float(raise_error('array must not contain nulls')) WHEN isnan(x) THEN float(raise_error('NaN not allowed in vector')) WHEN abs(float(x)) = float('Infinity') THEN float(raise_error('infinite value not allowed in vector')) ELSE float(x) END)"
    wrong = "CASE WHEN size(a) < 1 THEN cast(raise_error('vector must have at least 1 dimension') AS ARRAY<FLOAT>) WHEN dim > 0 AND size(a) <> dim THEN cast(raise_error(concat('expected ', dim, ' dimensions, not ', size(a))) AS ARRAY<FLOAT>)"
    out["array_to_vector"] = ("a ARRAY<DOUBLE>, dim INT", "ARRAY<FLOAT>", f"{wrong} ELSE {made} END")
    bits = "CASE WHEN length(a) = length(b) THEN {body} WHEN a IS NOT NULL AND b IS NOT NULL THEN double(raise_error(concat('different bit lengths ', length(a), ' and ', length(b)))) END"
    out["hamming_distance"] = ("a STRING, b STRING", "DOUBLE", bits.format(body=f"double({_COUNT.format(op='^')})"))
    both, either = _COUNT.format(op="&"), _COUNT.format(op="|")
    out["jaccard_distance"] = ("a STRING, b STRING", "DOUBLE", bits.format(body=f"CASE WHEN {both} = 0 THEN 1D ELSE 1D - {both} / {either} END"))
    sparse = "STRUCT<dim: INT, indices: ARRAY<INT>, values: ARRAY<FLOAT>>"
    fit = "CASE WHEN a.dim = b.dim THEN {body} WHEN a IS NOT NULL AND b IS NOT NULL THEN double(raise_error(concat('different sparsevec dimensions ', a.dim, ' and ', b.dim))) END"
    terms = lambda f: _SUM.format(v=_TERMS.format(f=f))
    dot, square = terms(f"{_X} * {_Y}"), terms(f"({_X} - {_Y}) * ({_X} - {_Y})")
    size = f"sqrt({_NORM.format(v='a.values')} * {_NORM.format(v='b.values')})"
    cosine = f"CASE WHEN {size} = 0 OR isnan({size}) THEN double('NaN') ELSE 1D - greatest(-1D, least(1D, try_divide({dot}, {size}))) END"
    for name, body in (("l2_distance", f"sqrt({square})"), ("inner_product", dot), ("negative_inner_product", f"-{dot}"), ("l1_distance", terms(f"abs({_X} - {_Y})")), ("cosine_distance", cosine)):
        out[f"sparsevec_{name}"] = (f"a {sparse}, b {sparse}", "DOUBLE", fit.format(body=body))
    out["sparsevec_l2_norm"] = (f"a {sparse}", "DOUBLE", f"sqrt({_NORM.format(v='a.values')})")
    held = "filter(transform(a, (x, i) -> struct(i, x)), s -> s.x <> 0)"
    out["vector_to_sparsevec"] = (one, sparse, f"CASE WHEN a IS NOT NULL THEN named_struct('dim', size(a), 'indices', transform({held}, s -> s.i), 'values', transform({held}, s -> s.x)) END")
    return out


def register(spark: SparkSession) -> None:
    """SQL functions over vector columns, inlined by the optimiser. In ORDER BY name a selected column instead.

    Sparse ones have the prefix sparsevec_. Averages and sums of vectors are
    not among them: SQL functions can't aggregate; see ``vectors.avg_vector``.
    """
    for name, (parameters, kind, body) in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
