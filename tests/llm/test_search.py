import math
import random

import pytest

from lumenframe.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    out = []
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, a in {i: v for i, v in fine if i % 5 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q and len(a) == len(b))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(k, [float(rng.gauss(0, 1)) for _ in range(16)]) for k in range(300)]
    rows = [(i, [round(x * 64) / 64 for x in v]) for i, v in rows]
    rows += [(k, rows[7][1]) for k in range(300, 360)]  # ties
    rows += [(400, None), (405, [None] * 16), (410, [math.nan] * 16), (415, [math.inf] * 16), (None, rows[0][1]), (420, [1.0, 2.0]), (421, [2.0, 2.0]), (425, []), (426, [])]
    df = spark.createDataFrame(rows, SCHEMA)
    for blocks in ({}, {"vector_block": 40, "query_block": 10}):
        got = topk.top_k(df, df.filter("vec_id % 5 = 0"), 5, **blocks).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 5)


def test_fewer_than_k_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id = 0"), 5).collect()] == [(0, 1, 256 * 128)]
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(empty, empty, 5).collect() == []


def test_large_components_and_repeated_queries(spark):
    """Nothing finite is left out; scores beyond doubles, and sums beyond 64 bits on the way, are exact."""
    rng = random.Random(4)
    rows = [(k, [float(rng.randint(-400, 400)) / 64 for _ in range(3)]) for k in range(60)]
    rows += [(65, [70000.0, 1.0, 0.25]), (66, [2.0**26 + 1, 0.5, 1.0]), (70, [2.0**20, 2.0**20, -1.0]), (71, [2.0**18 + 0.125, 7.0, 2.0**20]), (72, [-(2.0**25), 5.0, 1.0])]
    rows += [(77, [2.0**27, -(2.0**27) + 1, 3.0]), (78, [-(2.0**27), 2.0**27 + 3, 3.0]), (79, [1.0, 1.0, 2.0**27])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for blocks in ({}, {"vector_block": 20, "query_block": 3}):
        got = topk.top_k(df, df.filter("vec_id % 5 = 0"), 4, **blocks).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 4)
    huge = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)overflow|too large|out of bounds|too big"):
        topk.top_k(huge, huge, 4).collect()
    with pytest.raises(Exception, match="too large"):
        topk.top_k(spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>"), df.filter("vec_id = 0"), 4).collect()
    again = spark.createDataFrame([(0, [1.0, 0.0]), (0, [-1.0, 0.0]), (1, [2.0, 0.0]), (2, [-2.0, 0.0])], "vec_id long, embedding array<double>")
    assert {tuple((r.vec_id, r.score) for r in sorted(topk.top_k(again.repartition(n), again.filter("vec_id = 0").repartition(n), 2).collect(), key=lambda r: r.rank)) for n in (1, 3, 4)} == {((2, 2 * 65536), (1, -2 * 65536))}
