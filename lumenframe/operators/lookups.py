"""Dictionary-like joins: enrichment, membership, first match, nearest vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import vectors

#: Queries and rows that are multiplied at once.
_LINES, _ROWS = 256, 4096


def enrich(df: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Rows with their entity; those without one vanish."""
    return df.join(entities, key)


def exists_flag(df: DataFrame, known: DataFrame, key: str, name: str = "is_known") -> DataFrame:
    """df with a flag for keys that `known` has. Its keys are made distinct first, so that no row is doubled."""
    marked = known.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    return df.join(marked, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def not_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key), key, "left_anti")


def first_match(df: DataFrame, table: DataFrame, key: str, order: list[str | Column], columns: list[str]) -> DataFrame:
    """df with the columns of the key's first row in the table, in ascending order; null where there is none. The first row is an
    aggregate, combined before the shuffle, so that a hot key is no task of its own."""
    first = table.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__first"))
    return df.join(first.select(key, "__first.*"), key, "left")


def top_k_cosine(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, most_queries: int = 1 << 17) -> DataFrame:
    """query_id, neighbor_id, rank, similarity of each query's k nearest others, ties by neighbor_id. queries: key and vector.

    Queries and rows are counted, dealt to blocks of about most_queries and 32 MB of vectors at most, and every block of queries meets every
    block of rows in a task, which multiplies them piece by piece and returns k a query; nothing is broadcast. Vectors without a direction
    (null, zero, not a number) or of another length than the longest are compared pair by pair."""
    asked = queries.filter(F.col(key).isNotNull()).select(F.col(key).alias("query_id"), vectors.normalised(F.col(vector)).alias("q"))
    given = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("neighbor_id"), vectors.normalised(F.col(vector)).alias("v"))
    n, most_q = asked.agg(F.count("*"), F.max(F.size("q"))).first()
    m, most_v = given.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(1, most_q or 0, most_v or 0)
    plain = lambda x: F.coalesce((F.size(x) == width) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e)), F.lit(False))
    odd_q, odd_v = (d.filter(~plain(x)).count() for d, x in ((asked, "q"), (given, "v")))
    most, most_rows = max(1, min(most_queries, (32 << 20) // (8 * width))), max(1, min(1 << 17, (32 << 20) // (8 * width)))
    cells = min(4 * df.sparkSession.sparkContext.defaultParallelism, 1 + m * n // (1 << 22))
    high = max(1, -(-n // most), round(math.sqrt(cells * n / max(1, m))))
    wide = max(1, -(-m // most_rows), -(-cells // high))
    near = _met(given.filter(plain("v")), asked.filter(plain("q")), "query_id", "neighbor_id", k, high, wide)
    if odd_q or odd_v:
        pairs = given.filter(~plain("v")).crossJoin(asked).unionByName(given.filter(plain("v")).crossJoin(asked.filter(~plain("q"))))
        apart = pairs.filter(F.col("neighbor_id") != F.col("query_id")).select("query_id", "neighbor_id", vectors.dot(F.col("v"), F.col("q")).alias("similarity"))
        near = near.unionByName(apart.withColumn("near", F.round("similarity", 9)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "neighbor_id"))
    return near.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k).select("query_id", "neighbor_id", "similarity", "rank")


def _met(given: DataFrame, asked: DataFrame, query: str, neighbor: str, k: int, high: int, wide: int) -> DataFrame:
    """query_id, neighbor_id, similarity and near (rounded to 9 digits, for the order) of k nearest others a query and block of rows."""
    dealt = lambda name, count: F.pmod(F.xxhash64(name), F.lit(count)).cast("int")
    column, line = dealt(neighbor, wide), dealt(query, high) * wide
    left = given.select(neighbor, "v", F.explode(F.sequence(column, column + (high - 1) * wide, F.lit(wide))).alias("cell"))
    right = asked.select(query, "q", F.explode(F.sequence(line, line + wide - 1)).alias("cell"))
    kinds = {f.name: f.dataType.simpleString() for f in [*given.schema, *asked.schema]}
    schema = f"query_id {kinds[query]}, neighbor_id {kinds[neighbor]}, similarity double, near double"
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_nearest(k), schema)


def _nearest(k: int):
    """Of a block of rows and one of queries: single-precision products find what may be among the k nearest, which is then summed up in
    doubles, component by component, so that a pair's similarity doesn't depend on its block."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows["neighbor_id"]))  # ties go to the first
        v, q = _matrix(rows["v"]), _matrix(asked["q"])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        if len(v) and len(q):
            code = _combined(rows["neighbor_id"], asked["query_id"])
            own, theirs = code[: len(v)], code[len(v) :]
            slack = 2e-9 + 4 * v.shape[1] * float(np.finfo(np.float32).eps)
            v32, q32 = v.astype(np.float32), q.astype(np.float32)
            for low in range(0, len(q), _LINES):
                found.append(_of_lines(q, q32, theirs, low, min(len(q), low + _LINES), v, v32, own, k, slack))
        line, place, similarity, near = (np.concatenate([f[x] for f in found]) if found else np.empty(0, kind) for x, kind in enumerate((np.int64, np.int64, float, float)))
        return pa.table([asked["query_id"].take(pa.array(line)), rows["neighbor_id"].take(pa.array(place)), pa.array(similarity), pa.array(near)], names=["query_id", "neighbor_id", "similarity", "near"])

    return run


def _of_lines(q: np.ndarray, q32: np.ndarray, theirs: np.ndarray, low: int, high: int, v: np.ndarray, v32: np.ndarray, own: np.ndarray, k: int, slack: float):
    """Places of queries low to high - 1 and of their k nearest rows, similarities, and these rounded."""
    held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))
    floor, at, step = np.full(high - low, -np.inf, np.float32), 0, max(256, 2 * k)
    while at < len(v):
        end = min(len(v), at + step)
        product = q32[low:high] @ v32[at:end].T
        if not at and end > k + 1:  # the first rows set a floor; one more, as a query may be among them
            floor = np.partition(product, end - k - 1, axis=1)[:, end - k - 1] - np.float32(slack)
        line, place = np.nonzero(product >= floor[:, None])
        line, place = line + low, place + at
        other = theirs[line] != own[place]
        line, place = line[other], place[other]
        if len(line):
            sums = np.zeros(len(line))
            for c in range(v.shape[1]):
                sums += q[line, c] * v[place, c]
            every = tuple(np.concatenate(x) for x in zip(held, (line, place, sums, np.round(sums, 9)), strict=True))
            order = np.lexsort((every[1], -every[3], every[0]))
            line = every[0][order]
            first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
            rank = np.arange(len(line)) - np.repeat(first, np.diff(np.r_[first, len(line)]))
            held = tuple(x[order[rank < k]] for x in every)
            full = order[rank == k - 1]
            floor[every[0][full] - low] = every[3][full] - slack
        at, step = end, min(2 * step, _ROWS)
    return held


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of an array column, all of one length and without nulls."""
    if not len(column):
        return np.empty((0, 1))
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks if len(c)]).reshape(len(column), -1)


def _combined(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """Numbers of the keys of two columns, equal where the keys are."""
    if a.type != b.type:
        a, b = a.cast(pa.string()), b.cast(pa.string())
    return pa.chunked_array([*a.chunks, *b.chunks]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
