import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.functions import types as T
from quiver.functions import vectors as V

BAD = {
    "[hello,1]": 'invalid input syntax for type vector: "[hello,1]"', "[NaN,1]": "NaN not allowed in vector", "[Infinity,1]": "infinite value not allowed in vector", "[-Infinity,1]": "infinite value not allowed in vector",
    "[4e38,1]": '"4e38" is out of range for type vector', "[-4e38,1]": '"-4e38" is out of range for type vector', "[1,2,3": "invalid input syntax", "[1,2,3]9": "invalid input syntax", "1,2,3": "invalid input syntax", "": "invalid input syntax",
    "[": "invalid input syntax", "[,": "invalid input syntax", "[]": "vector must have at least 1 dimension", "[ ]": "vector must have at least 1 dimension", "[,]": "invalid input syntax", "[1,]": "invalid input syntax", "[1a]": "invalid input syntax", "[1,,3]": "invalid input syntax", "[1, ,3]": "invalid input syntax",
}
GOOD = {"[1,2,3]": "[1,2,3]", "[-1,-2,-3]": "[-1,-2,-3]", "[1.,2.,3.]": "[1,2,3]", " [ 1,  2 ,    3  ] ": "[1,2,3]", "[1.23456]": "[1.23456]", "[1.5e38,-1.5e38]": "[1.5e+38,-1.5e+38]", "[1e-46,1]": "[0,1]", "[-1e-46,1]": "[-0,1]"}
BAD_SPARSE = {
    "{1:hello,2:1}/2": "invalid input syntax", "{1:NaN,2:1}/2": "NaN not allowed in sparsevec", "{1:Infinity,2:1}/2": "infinite value not allowed in sparsevec", "{1:4e38,2:1}/2": '"4e38" is out of range for type sparsevec', "{1:1e-46,2:1}/2": '"1e-46" is out of range for type sparsevec',
    "": "invalid input syntax", "{}": "invalid input syntax", "{}/1a": "invalid input syntax", "{1,}/1": "invalid input syntax", "{1:1,}/1": "invalid input syntax", "{1:1,1:1}/2": "duplicates", "{}/-1": "at least 1 dimension", "{}/1000000001": "more than 1000000000", "{0:1}/1": "out of bounds", "{2:1}/1": "out of bounds",
}


@pytest.mark.parametrize("text", BAD)
def test_vector_in_rejects(text):
    with pytest.raises(T.VectorError) as e:
        T.parse_vector(text)
    assert BAD[text] in str(e.value)


@pytest.mark.parametrize("text", GOOD)
def test_vector_text(text):
    assert T.format_vector(T.parse_vector(text)) == GOOD[text]


@pytest.mark.parametrize("text", BAD_SPARSE)
def test_sparsevec_in_rejects(text):
    with pytest.raises(T.VectorError) as e:
        T.parse_sparse(text)
    assert BAD_SPARSE[text] in str(e.value)


def test_sparse_text_and_binary():
    v = T.parse_sparse("{3:3.5,1:1.5,2:0}/5")
    assert v == {"dim": 5, "indices": [0, 2], "values": [1.5, 3.5]}
    assert T.format_sparse(v) == "{1:1.5,3:3.5}/5"
    assert T.unpack_sparse(T.pack_sparse(v)) == v


def test_half_text():
    with pytest.raises(T.VectorError, match='"65520" is out of range for type halfvec'):
        T.parse_vector("[65520,-65520]", None, "halfvec")
    assert T.parse_vector("[65519,1e-8]", None, "halfvec") == [65504.0, 0.0]


def test_mutated_input_never_breaks():
    rng = random.Random(0)
    for _ in range(500):
        s = list(rng.choice(["[1,2,3]", "{1:1,2:2}/3"]))
        for _ in range(rng.randint(1, 3)):
            s[rng.randrange(len(s))] = rng.choice("[]{},:/0123456789.eE+- \x00a")
        for f in (T.parse_vector, T.parse_sparse):
            try:
                f("".join(s))
            except T.VectorError:
                pass


def test_type_modifiers():
    assert T.vector_type(3).metadata == {"vtype": "vector", "dim": 3}
    for n in (0, 16001):
        with pytest.raises(T.VectorError):
            T.vector_type(n)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def vec(*x):
    return F.array(*(F.lit(float(v)).cast("float") for v in x))


def test_columns_of_codecs(spark):
    df = spark.createDataFrame([("[1,2.5]", "{2:7}/3"), (None, None)], "v string, s string")
    got = df.select(T.vector_out(T.vector_recv(T.vector_send(T.vector_in("v", 2)))).alias("v"), T.sparsevec_out(T.sparsevec_in("s")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("[1,2.5]", "{2:7}/3"), (None, None)]


def test_distances(spark):
    a, b = vec(0, 0), vec(3, 4)
    r = one(spark, V.l2_distance(a, b), V.inner_product(vec(1, 2), b), V.negative_inner_product(vec(1, 2), b), V.l1_distance(a, b), V.cosine_distance(vec(1, 2), vec(2, 4)), V.cosine_distance(vec(1, 2), vec(0, 0)), V.cosine_distance(vec(1, 1), vec(-1, -1)), V.l2_distance(a, b, 2), V.l2_distance(a, F.lit(None).cast("array<float>")), V.spherical_distance(vec(1, 0), vec(0, 1)))
    assert r[:5] == (5, 11, -11, 7, 0) and math.isnan(r[5]) and r[6:] == (2, 5, None, 0.5)


def test_f32_overflow(spark):
    big, small = vec(3e38), vec(-3e38)
    r = one(spark, V.f32_distance("l2", big, small), V.f32_distance("ip", big, big), V.f32_distance("cosine", big, big), V.f32_distance("l1", big, small))
    assert r[0] == r[1] == r[3] == math.inf and math.isnan(r[2])


@pytest.mark.parametrize(
    ("expr", "message"),
    [
        (lambda: V.l2_distance(vec(1, 2), vec(3)), "different vector dimensions 2 and 1"), (lambda: V.add(vec(3e38), vec(3e38)), "value out of range: overflow"), (lambda: V.subtract(vec(-3e38), vec(3e38)), "value out of range: overflow"), (lambda: V.multiply(vec(1e37), vec(1e37)), "value out of range: overflow"),
        (lambda: V.multiply(vec(1e-37), vec(1e-37)), "value out of range: underflow"), (lambda: V.subvector(vec(1, 2, 3), 1, 0), "at least 1 dimension"), (lambda: V.subvector(vec(1, 2, 3), -1, 2), "at least 1 dimension"), (lambda: T.check_dim(vec(1, 2, 3), 2), "expected 2 dimensions, not 3"),
        (lambda: T.array_to_vector(F.array(F.lit(None).cast("float"))), "array must not contain nulls"), (lambda: T.array_to_vector(F.array(F.lit(4e38))), "infinite value not allowed in vector"), (lambda: T.array_to_vector(F.array(F.lit(float("nan")))), "NaN not allowed"), (lambda: T.vector_to_halfvec(vec(65520)), '"65520" is out of range for type halfvec'),
        (lambda: V.hamming_distance(F.lit("111"), F.lit("11")), "different bit lengths 3 and 2"), (lambda: V.concat(F.array_repeat(F.lit(0.0), 16000), vec(1)), "more than 16000"),
    ],
)
def test_errors(spark, expr, message):
    with pytest.raises(Exception, match=message):
        spark.range(1).select(expr()).collect()


def test_elementwise(spark):
    a, b = vec(1, 2, 3), vec(4, 5, 6)
    r = one(spark, V.add(a, b), V.subtract(a, b), V.multiply(a, b), V.concat(a, b), V.vector_norm(vec(3, 4)), V.l2_normalize(vec(3, 4)), V.l2_normalize(vec(0, 0)), V.binary_quantize(vec(1, 0, -1)), V.vector_dims(a))
    assert r[0] == [5, 7, 9] and r[1] == [-3, -3, -3] and r[2] == [4, 10, 18] and r[3] == [1, 2, 3, 4, 5, 6] and r[4] == 5
    assert np.allclose(r[5], [0.6, 0.8]) and r[6] == [0, 0] and r[7] == "100" and r[8] == 3


@pytest.mark.parametrize(("start", "count", "want"), [(1, 3, [1, 2, 3]), (3, 2, [3, 4]), (-1, 3, [1]), (3, 9, [3, 4, 5]), (3, 2147483647, [3, 4, 5]), (-2147483644, 2147483647, [1, 2])])
def test_subvector(spark, start, count, want):
    assert one(spark, V.subvector(vec(1, 2, 3, 4, 5), start, count))[0] == want


def test_compare_and_order(spark):
    assert one(spark, V.compare(vec(1, 2), vec(1, 2, 3)), V.compare(vec(2, 3), vec(1, 2, 3)), V.compare(vec(1), vec(1))) == (-1, 1, 0)
    rows = spark.createDataFrame([([0.0, 0.0],), ([1.0, 2.0],), (None,), ([1.0, 1.0],)], "v array<float>")
    assert [r.v for r in rows.orderBy(F.col("v").asc_nulls_last()).collect()] == [[0, 0], [1, 1], [1, 2], None]


def test_bits(spark):
    r = one(spark, V.hamming_distance(F.lit("111"), F.lit("110")), V.hamming_distance(F.lit(""), F.lit("")), V.jaccard_distance(F.lit("1111"), F.lit("1110")), V.jaccard_distance(F.lit(""), F.lit("")), V.jaccard_distance(F.lit("1100"), F.lit("0011")), V.hamming_distance(F.lit("10" * 100), F.lit("01" * 100)))
    assert r == (1, 0, 0.25, 1, 1, 200)


def test_types_agree(spark):
    """Dense, half and sparse distances of small integers are the same, and comparisons follow the arrays."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-2, 1)) for _ in range(5)], [float(rng.randint(-2, 1)) for _ in range(5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    ha, hb, sa, sb = T.vector_to_halfvec(a), T.vector_to_halfvec(b), T.vector_to_sparsevec(a), T.vector_to_sparsevec(b)
    got = df.select("a", "b", V.l2_distance(a, b).alias("d"), V.l2_distance(ha, hb).alias("h"), V.sparse_l2_distance(sa, sb).alias("s"), V.l1_distance(a, b).alias("d1"), V.sparse_l1_distance(sa, sb).alias("s1"), V.compare(a, b).alias("c"), V.sparse_compare(sa, sb).alias("sc"), T.sparsevec_to_vector(sa).alias("back")).collect()
    for r in got:
        assert r.d == r.h and abs(r.d - r.s) < 1e-12 and r.d1 == r.s1 and r.back == r.a
        assert r.c == r.sc == (r.a > r.b) - (r.a < r.b)


def test_half_rounding(spark):
    x = [float(np.float32(v)) for v in [0.1, 1e-8, 6e-8, 65519, -2049.0, 2051.0, 3e-6, *np.random.default_rng(0).normal(size=200) * 100]]
    assert one(spark, T.to_half(vec(*x)))[0] == [float(v) for v in np.array(x, dtype=np.float32).astype(np.float16)]


def test_aggregates(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (1, [3.0, 5.0, 7.0]), (2, None)], "g int, v array<float>")
    assert V.avg_vector(df, "v").first()[0] == [2, 3.5, 5]
    assert V.sum_vector(df, "v").first()[0] == [4, 7, 10]
    assert [tuple(r) for r in V.sum_vector(df, "v", ("g",)).collect()] == [(1, [4, 7, 10])]
    assert V.avg_vector(df.where("g = 2"), "v").first()[0] is None
    with pytest.raises(Exception, match="expected 1 dimensions, not 2"):
        V.avg_vector(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<float>"), "v").collect()


def test_codecs_by_batch(spark):
    """Batches agree with values one by one: odd texts, exponents, nulls, several lengths."""
    rng = np.random.default_rng(0)
    values = [np.float32(x) for x in (0.0, -0.0, 1.5, 1e-7, -3e38, 123456.0, 1234567.0, 0.1, 1e-4, 9.999e5)]
    rows = [(i, [float(values[j]) for j in rng.integers(0, len(values), n)]) for i, n in enumerate([3] * 20 + [1, 5, 2])] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = df.select("id", "v", T.vector_out(F.col("v")).alias("t")).withColumn("back", T.vector_in(F.col("t"))).withColumn("bin", T.vector_recv(T.vector_send(F.col("v")))).collect()
    for r in got:
        if r.v is None:
            assert r.t is None and r.back is None and r.bin is None
        else:
            assert r.t == T.format_vector(r.v) and r.back == r.v == r.bin
    same = spark.createDataFrame([(i, [0.5 * i, -1.0, 2.0]) for i in range(50)] + [(60, None)], "id long, v array<float>")
    got = same.select("v", T.halfvec_recv(T.halfvec_send(F.col("v"))).alias("h"), T.vector_recv(T.vector_send(F.col("v"))).alias("b"), T.halfvec_in(T.vector_out(F.col("v"))).alias("t")).collect()
    assert all(r.v == r.h == r.b == r.t for r in got)
    for text, words in (("[1,nan]", "NaN"), ("[1,]", "invalid"), ("[1,4e38]", "out of range"), ("[1,2,3]", "expected 2")):
        with pytest.raises(Exception, match=words):
            spark.createDataFrame([("[1,2]",), (text,)], "t string").select(T.vector_in(F.col("t"), 2)).collect()
    assert spark.createDataFrame([(" [ 1 , 2 ] ",), ("[3,4]",)], "t string").select(T.vector_in(F.col("t")).alias("v")).collect()[0].v == [1.0, 2.0]


@pytest.mark.parametrize(("dim", "n", "index", "value", "words"), [(-3, 0, 0, 1.0, "at least 1"), (5, -1, 0, 1.0, "negative"), (5, 1, 0, float("nan"), "NaN"), (5, 1, 0, float("inf"), "infinite"), (5, 1, 7, 1.0, "bounds"), (5, 1, 0, 0.0, "zero"), (1_000_000_001, 0, 0, 1.0, "dimensions"), (1, 2, 0, 1.0, "more elements")])
def test_sparse_binary_is_checked(dim, n, index, value, words):
    data = np.array([dim, n, 0], ">i4").tobytes() + np.array([index] * max(0, n), ">i4").tobytes() + np.array([value] * max(0, n), ">f4").tobytes()
    with pytest.raises(T.VectorError, match=words):
        T.unpack_sparse(data)
    with pytest.raises(T.VectorError, match="expected 4 dimensions, not 3"):
        T.unpack_sparse(T.pack_sparse({"dim": 3, "indices": [1], "values": [2.0]}), 4)


def test_aggregates_of_known_dimensions(spark):
    """One aggregate without a row a place; the same results and errors."""
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (1, [3.0, 5.0, 7.0]), (2, None)], "g long, v array<float>")
    for by in ((), ("g",)):
        for f in (V.avg_vector, V.sum_vector):
            assert sorted(map(repr, f(df, "v", by, dim=3).collect())) == sorted(map(repr, f(df, "v", by).collect()))
    assert V.avg_vector(df.where("g = 2"), "v", dim=3).first()[0] is None
    assert "Generate" not in V.avg_vector(df, "v", ("g",), dim=3)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="expected 4 dimensions, not 3"):
        V.sum_vector(df, "v", dim=4).collect()
