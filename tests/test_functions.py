import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import mathfn, text, vectors


def values(spark, column, xs):
    return [r[0] for r in spark.createDataFrame([(float(x),) for x in xs], "x double").select(column).collect()]


def test_erf_and_erfc_against_the_library(spark):
    xs = [-math.inf, -3.5, -1, -0.1, 0.0, 0.1, 0.7, 2, 5, math.inf]
    assert values(spark, mathfn.erf(F.col("x")), xs) == pytest.approx([math.erf(x) for x in xs], abs=2e-7)
    assert values(spark, mathfn.erfc(F.col("x")), xs) == pytest.approx([math.erfc(x) for x in xs], abs=2e-7)


def test_erfinv_inverts_erf(spark):
    xs = [-0.9, -0.3, 0.0, 0.1, 0.5, 0.9]
    assert [math.erf(y) for y in values(spark, mathfn.erfinv(F.col("x")), xs)] == pytest.approx(xs, abs=1e-12)
    assert values(spark, mathfn.erfinv(F.col("x")), [1, -1]) == [math.inf, -math.inf]


def test_probit_is_the_normal_quantile(spark):
    ps = [1e-300, 1e-9, 0.02, 0.3, 0.5, 0.8, 0.999, 1 - 1e-12]
    assert values(spark, mathfn.probit(F.col("x")), ps) == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-12)
    assert values(spark, mathfn.probit(F.col("x")), [0, 1]) == [-math.inf, math.inf]
    with pytest.raises(Exception, match="illegal input"):
        values(spark, mathfn.probit(F.col("x")), [1.5])


def test_known_answers(spark):
    one = spark.range(1)
    assert one.select(vectors.zero_out(F.array(*map(F.lit, [5, 4, 3, 2, 1])).cast("array<double>"))).first()[0] == [5, 0, 0, 0, 0]
    table = spark.createDataFrame([(k, float(k)) for k in range(10)], "id int, value double")
    rows = spark.createDataFrame([(0, [2, 5, 8], [1.0, 1.5, 2.5]), (1, [3, 4], [3.5, 4.5]), (2, [], [])], "row int, ids array<int>, weights array<double>")
    assert sorted(map(tuple, vectors.lookup_sum(rows, "row", "ids", table, "weights").collect())) == [(0, 29.5), (1, 28.5), (2, 0.0)]


def test_sparse_and_dense_round_trip(spark):
    rows = spark.createDataFrame([([0.0, 2.0, 0.0, -1.0],), ([],), ([0.0],)], "v array<double>").withColumn("s", vectors.to_sparse(F.col("v")))
    assert all(r[0] == r[1] for r in rows.select("v", vectors.to_dense(F.col("s.ids"), F.col("s.weights"), F.size("v"))).collect())


def test_last_of_repeated_ids_stands(spark):
    row = spark.createDataFrame([([1, 1], [3.0, 4.0])], "i array<int>, w array<double>")
    assert row.select(vectors.to_dense(F.col("i"), F.col("w"), 3)).first()[0] == [0, 4, 0]


def test_empty_vectors_keep_a_coordinate(spark):
    rows = spark.createDataFrame([(1, [], []), (2, [7], [0.5])], "row int, i array<int>, w array<double>")
    assert sorted(map(tuple, vectors.coordinates(rows, "row", "i", "w").collect())) == [(1, 0, 0, 0.0), (2, 0, 7, 0.5)]


def test_skipgrams_do_not_wrap(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, ["x"])], "k int, w array<string>")
    assert sorted((r.center, r.context) for r in text.skipgrams(rows, "k", "w", 1).collect()) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]


def test_text_of_other_character_sets(spark):
    row = spark.createDataFrame([("中文 ab",), (None,)], "t string").select(text.decoded(text.encoded(F.col("t"))))
    assert [r[0] for r in row.collect()] == ["中文 ab", None]


def test_pad_cuts_and_fills(spark):
    row = spark.createDataFrame([(["a", "b", "c"],)], "w array<string>")
    assert list(row.select(text.pad(F.col("w"), 2, "-"), text.pad(F.col("w"), 4, "-")).first()) == [["a", "b"], ["a", "b", "c", "-"]]


def test_ngrams_against_slices(spark):
    rows = [(list("abcdefg")[:n],) for n in range(8)]
    df = spark.createDataFrame(rows, "w array<string>")
    for n, skip in ((1, 0), (2, 0), (2, 1), (3, 2)):
        span = (n - 1) * (skip + 1)
        want = sorted([" ".join(w[i : i + span + 1 : skip + 1]) for i in range(len(w) - span)] for (w,) in rows)
        assert sorted(r[0] for r in df.select(text.ngrams(F.col("w"), n, skip)).collect()) == want


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(vectors.normalised(F.col("v"))).collect()] == [[0.6, 0.8], [None], [], None]
