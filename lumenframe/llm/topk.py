"""Exact top-k inner products by a three-phase uniform threshold over blocks of vectors.

A vector's score for a query is the sum of partial scores, one for each slice of components; each block of vectors is a node with one
score list for each slice and query.

1. Every node takes the best k entries of each of its lists, totals them and reports its best k totals. The k-th best of all reports is
   a score that k vectors reach: a safe cutoff for the query.
2. The cutoff goes to all nodes. A vector that reaches it must, in one slice at least, lie above that list's least entry by an equal
   share of what the cutoff leaves above all of the lists' least entries: the uniform threshold. Each node collects the entries above it
   and drops those whose upper bound (the threshold for what wasn't collected) stays below the cutoff.
3. What remains is totalled exactly; each node returns its best k that reach the cutoff, and the best k of all are the answer.

Queries and vectors meet in cells of bounded size (query block by vector block), keyed and shuffled; nothing grows in a task or on the
driver. Scores are whole numbers: components are floor(scale * x), and double arithmetic is used only where it is exact; vectors with
large components (beyond 2**16 once scaled) meet others in cells of their own, in 64-bit or, where that might not do, unbounded integers.

Defined results: rows without an id, and vectors that are null or hold null or non-finite components, take no part. A component beyond
2**62 once scaled, or an answer's score beyond 64 bits, can't be told as a long: the query fails and says so. Vectors meet only vectors
with as many components; empty ones score 0. A query never meets rows with its own id. Other rows that repeat an id are candidates each;
a repeated query is answered once, by the least of its vectors. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import small, stage

SLICES = 4


def quantised(x: Column, scale: int) -> Column:
    """floor(scale * component) as whole numbers; null for vectors that take no part."""
    value = lambda c: c.cast("double") * scale
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = lambda c: F.when(F.abs(value(c)) <= 2.0**62, F.floor(value(c)).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for scores of 64 bits")).cast("long"))
    return F.when(x.isNotNull() & fine, F.transform(x, whole))


def _partials(queries: np.ndarray, vectors: np.ndarray) -> list[np.ndarray]:
    """The score lists of a node: for each slice a matrix, query by vector, of exact partial scores."""
    d = queries.shape[1]
    bound = d * _most(queries) * _most(vectors)
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    cuts = np.array_split(np.arange(d), max(1, min(SLICES, d)))
    return [(queries[:, c].astype(kind) @ vectors[:, c].astype(kind).T) for c in cuts] if d else [np.zeros((len(queries), len(vectors)))]


def _most(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _best(total: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best, ties to smaller ids."""
    if len(total) > 4 * k:
        floor = np.partition(total, len(total) - k)[len(total) - k]
        at = np.flatnonzero(total >= floor)
    else:
        at = np.arange(len(total))
    return at[sorted(range(len(at)), key=lambda n: (-total[at[n]], ids[at[n]]))[:k] if total.dtype == object else np.lexsort((ids[at], -total[at]))[:k]]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0), np.int64)


def search_cell(queries: pa.Table, vectors: pa.Table, k: int, phase: int) -> pa.Table:
    """query_id, vec_id, score of one cell: local reports (phase 1), or all that can be among the best (phases 2 and 3)."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(queries) and len(vectors):
        asked, given = queries["query_id"].to_numpy(), vectors["vec_id"].to_numpy()
        q, v = _matrix(queries["vector"]), _matrix(vectors["vector"])
        cutoffs = queries["cutoff"].to_pylist() if phase > 1 else [None] * len(asked)
        step = max(1, 2_000_000 // len(given))
        for low in range(0, len(asked), step):
            lists = _partials(q[low : low + step], v)
            for row, query in enumerate(asked[low : low + step]):
                part, cutoff = [x[row] for x in lists], cutoffs[low + row]
                others = given != query
                if phase == 1:
                    best = [np.argpartition(x, len(x) - k)[len(x) - k :] if len(x) > k else np.arange(len(x)) for x in part]
                    seen = np.unique(np.concatenate(best))
                    seen = seen[others[seen]]
                elif cutoff is None:
                    seen = np.flatnonzero(others)
                else:
                    least = [int(x.min()) for x in part]
                    share = (cutoff - sum(least)) // len(part)
                    collected = [x - low_ >= share for x, low_ in zip(part, least, strict=True)]
                    near = others & np.logical_or.reduce(collected)
                    upper = sum(np.where(c, x, low_ + share) for c, x, low_ in zip(collected, part, least, strict=True))
                    seen = np.flatnonzero(near & (upper >= cutoff))
                total = sum(x[seen] for x in part)
                if total.dtype != object:
                    total = total.astype(np.int64)
                if cutoff is not None:
                    seen, total = seen[total >= cutoff], total[total >= cutoff]
                at = _best(total, given[seen], k)
                out.append((np.full(len(at), query), given[seen[at]], total[at]))
    columns = [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ()))]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, vector_block: int = 32_768, query_block: int = 8_192) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best. rows, queries: vec_id and embedding."""
    if k < 1:
        raise ValueError("k must be 1 or more")

    def prepared(df: DataFrame) -> DataFrame:
        given = df.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("vector"))
        return given.filter("vec_id is not null and vector is not null")

    def sized(df: DataFrame, label: str, wide: str) -> DataFrame:
        return stage(df.withColumn("size", F.size("vector")).withColumn(wide, F.exists("vector", lambda c: F.abs(c) > 2**16)), label)

    vectors = sized(prepared(rows), "vectors", "wide")
    asked = sized(prepared(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector")), "queries", "asks_wide")
    n, m = vectors.count(), asked.count()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-n // vector_block), min(tasks, -(-n // 1024)), 1)
    asks = max(-(-m // query_block), 1)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    ask = F.pmod(F.xxhash64("query_id"), F.lit(asks)).cast("int")
    # Cells of wide vectors, or of wide queries, exist only where there are some.
    kinds = lambda df, name: F.explode(F.array(*(F.lit(x[0]) for x in df.select(name).distinct().collect()) or F.lit(False)))
    spread = vectors.select("vec_id", "vector", "size", "wide", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("ask")).withColumn("asks_wide", kinds(asked, "asks_wide"))
    cell = ["size", "block", "ask", "wide", "asks_wide"]
    asked = asked.withColumn("wide", kinds(vectors, "wide"))

    def everywhere(df: DataFrame) -> DataFrame:
        return df.withColumn("ask", ask).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def phase(df: DataFrame, number: int) -> DataFrame:
        cells = everywhere(df).groupBy(*cell).cogroup(spread.groupBy(*cell))
        return cells.applyInArrow(lambda left, right: search_cell(left, right, k, number), "query_id long, vec_id long, score long")

    reports = phase(asked, 1)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    cutoffs = stage(reports.withColumn("place", place).filter(F.col("place") <= k).filter(F.col("place") == k).select("query_id", F.col("score").alias("cutoff")), "cutoffs")
    found = phase(asked.join(small(cutoffs), "query_id", "left"), 2)
    return found.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
